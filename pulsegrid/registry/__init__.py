"""Checked queries over the test tables, with their SQL."""

from __future__ import annotations

from . import boards, flows, links, roster, signals, stores, stories, versions

CASES = {**versions.CASES, **boards.CASES, **signals.CASES, **links.CASES, **stories.CASES, **roster.CASES, **stores.CASES, **flows.CASES}
