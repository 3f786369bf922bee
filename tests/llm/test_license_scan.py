from __future__ import annotations

import re
from pathlib import Path

from conftest_llm import ODD

from pulsegrid.llm import license_scan as ls

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def by_hand(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    places = [(i, label) for phrase, label in BASE.items() for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    found = [t.label for t in ls.TEMPLATES for s in range(-len(t.words), len(words))
             if s + t.key_at >= 0 and words[s + t.key_at:s + t.key_at + len(t.key_words)] == t.key_words
             and sum(0 <= s + i < len(words) and words[s + i] == w for i, w in enumerate(t.words)) >= ls.COVERAGE * len(t.words)]
    starts = [i for i, _ in places]
    base = sorted({label for _, label in places})
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted({*base, *found}))


NOTICES = [
    "Released under the MIT License.", "MIT License text alone", "Licensed under the Apache License, Version 2.0.",
    "licensed under the APACHE license version 2 of long ago", "This work is under the GNU General Public License, version 3; GNU General Public License.",
    "CC BY-NC 4.0", "Licensed under CC BY-NC 4.0.", "CC-BY cc by CC BY", "All rights reserved. all  rights reserved", "All rights\nreserved",
    "Permission is hereby granted, free of charge, to any person obtaining one copy of this software", "rights reserved all", "İ cc by",
]


def test_against_brute_force(corpus, sample):
    texts = [*ODD, *NOTICES, *sample.text]
    got = sorted(ls.license_labels(corpus(texts)).collect())
    assert [tuple(r)[1:7] for r in got] == [by_hand(t) for t in texts]
    assert all((r.labels == "") == (r.score == 0) and 0 <= r.score <= 1 for r in got)
    assert ls.license_labels(corpus([])).count() == 0


def test_key_decides_whatever_is_rare(corpus):
    """A corpus full of the key's rare words changes what is looked up, not what is found."""
    found = lambda extra: sorted(tuple(r) for r in ls.license_labels(corpus(NOTICES + extra)).collect())[:len(NOTICES)]
    assert found([]) == found(["mit apache reserved cc version public"] * 50)


def test_main_path_has_no_python(corpus):
    from pulsegrid.llm.pii_boosting import find_personal_data

    for df in (ls.license_labels(corpus(NOTICES)), find_personal_data(corpus(NOTICES))):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|Pandas", plan)
    for name in ("license_scan", "pii_boosting"):
        source = Path(ls.__file__).with_name(f"{name}.py").read_text()
        assert not re.search(r"pandas|udf|\.rdd|mapIn", source)
