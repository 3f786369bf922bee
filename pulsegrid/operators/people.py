"""Leadership: mentions, profiles, rosters, changes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.common import blank_to_null, col, let, moment, on_or_after, once, strip
from ..functions.mentions import leadership_mentions
from ..functions.titles import (
    arrival_type,
    change_severity,
    departure_type,
    is_leadership,
    is_person_name,
    title_rank,
    token_pairs,
)
from ..functions.urls import normalize_profile
from .changes import with_company
from .latest import latest_per_key
from .tables import first_per_key, new_rows, update_by_key

def extract_mentions(snapshots: DataFrame, companies: DataFrame | None = None, text: str = "content_markdown") -> DataFrame:
    """Leaders named in page texts, once per snapshot, person and title, at the surest priority."""
    found = snapshots.select(
        F.col("id").alias("snapshot_id"), "company_id", F.posexplode(leadership_mentions(text)).alias("position", "m")
    ).select("snapshot_id", "company_id", "position", "m.*")
    if companies is not None:
        names = companies.select(F.col("id").alias("company_id"), F.col("name").alias("__company"))
        found = found.join(names, "company_id", "left").filter(is_person_name("person_name", "__company")).drop("__company")
    else:
        found = found.filter(is_person_name("person_name"))
    keyed = found.withColumn("__n", F.lower("person_name")).withColumn("__t", F.lower("title_context"))
    return first_per_key(keyed, ["snapshot_id", "__n", "__t"], ["priority", "position"]).drop("__n", "__t", "position")


def filter_leaders(people: DataFrame, most_senior: int | None = None) -> DataFrame:
    """People with a leadership title, once per profile, by seniority (``rank``)."""
    leaders = people.filter(is_leadership("title") & (F.coalesce("profile_url", F.lit("")) != ""))
    unique = first_per_key(leaders, ["company_id", "profile_url"], ["position"]).withColumn("rank", title_rank("title"))
    if most_senior is not None:
        unique = unique.filter(F.col("rank") <= most_senior)
    return unique


def profile_url(text: str | Column) -> Column:
    """The first personal profile URL in a text."""
    return blank_to_null(F.regexp_extract(col(text), f"({fixed.PROFILE_LINK})", 1))


def parse_profiles(results: DataFrame) -> DataFrame:
    """Search results (title, snippet, url) with ``name``, ``person_title`` and ``profile_url``;
    results without a profile or a name are dropped."""
    shape = fixed.RESULT_TITLE
    own = F.when(F.col("url").rlike("^" + fixed.PROFILE_LINK), F.regexp_replace(F.substring_index("url", "?", 1), "/+$", ""))
    part = lambda a, i: F.coalesce(strip(F.get(a, F.lit(i))), F.lit(""))

    def person(r: Column) -> Column:
        title = r["title"]
        head, dashed = F.split(strip(F.substring_index(title, "|", 1)), "-"), F.split(title, "-")
        shaped = F.when(title.rlike(shape), F.struct(
            strip(F.regexp_extract(title, shape, 1)).alias("name"), strip(F.regexp_extract(title, shape, 2)).alias("person_title")))
        plain = F.struct(part(head, 0).alias("name"), part(head, 1).alias("person_title"))
        loose = F.struct(part(dashed, 0).alias("name"), part(dashed, 1).alias("person_title"))
        return let(F.coalesce(shaped, plain), lambda first: F.when(
            F.coalesce(r["own"], r["named"]).isNotNull() & (first["name"] != ""),
            first.withField("profile_url", F.coalesce(r["own"], r["named"])),
        ).otherwise(loose.withField("profile_url", F.coalesce(r["named"], r["anywhere"]))))

    row = F.struct(F.coalesce("title", F.lit("")).alias("title"), own.alias("own"),
                   profile_url("snippet").alias("named"), profile_url("url").alias("anywhere"))
    kept = lambda p: (p["name"] != "") & p["profile_url"].isNotNull()
    return results.select("*", once(let(row, person), kept))


def parse_cards(cards: DataFrame, html: str = "card_html") -> DataFrame:
    """People cards (HTML fragments) with ``name``, ``person_title`` and ``profile_url``."""
    path = F.regexp_extract(html, fixed.CARD_LINK, 1)
    name = strip(F.regexp_extract(html, fixed.CARD_NAME, 1))
    title = strip(F.regexp_extract(html, fixed.CARD_TITLE, 1))
    parsed = cards.withColumn("name", name).withColumn("person_title", title).withColumn("__path", path)
    return parsed.filter("name <> '' and __path <> ''").withColumn(
        "profile_url", F.concat(F.lit("https://www.linkedin.com"), "__path")).drop("__path")


def compare_rosters(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Departures and arrivals by profile URL, with type and severity."""
    keys = ["company_id", "linkedin_profile_url"]
    side = lambda df, n: df.select(*keys, F.struct("person_name", "title").alias(n))
    both = side(previous, "old").join(side(current, "new"), keys, "full_outer")
    gone = F.col("new").isNull()
    changed = both.filter(gone | F.col("old").isNull())
    person = F.when(gone, F.col("old")).otherwise(F.col("new"))
    typed = changed.select(*keys, person["person_name"].alias("person_name"), person["title"].alias("title"), gone.alias("gone"))
    kind = F.when(F.col("gone"), departure_type("title")).otherwise(arrival_type("title"))
    return typed.withColumn("change_type", kind).withColumn("severity", change_severity("change_type")).drop("gone")


def roster_events(previous: DataFrame, current: DataFrame, as_of, confidence: float, method: str) -> DataFrame:
    """Rows for the change log. A company's first roster logs nothing."""
    known = previous.select("company_id").distinct()
    return compare_rosters(previous, current).join(known, "company_id", "left_semi").select(
        "company_id", "change_type", F.coalesce(blank_to_null("person_name"), F.lit("Unknown")).alias("person_name"),
        blank_to_null("title").alias("title"), "linkedin_profile_url", "severity",
        moment(as_of).alias("detected_at"), F.lit(confidence).alias("confidence"),
        F.lit(method).alias("discovery_method"))


def roster_change_evidence(changes: DataFrame) -> DataFrame:
    """The evidence behind ``roster_change_summary``, a row for each change."""
    line = F.concat("person_name", F.lit(" ("), "title", F.lit(") - "), "change_type")
    return changes.select("company_id", line.alias("evidence"))


def roster_change_summary(changes: DataFrame) -> DataFrame:
    """Per company the verdict on its roster changes."""
    kind = F.col("change_type")
    counted = changes.groupBy("company_id").agg(
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "notable").alias("notable"),
        F.max(kind.endswith("_departure")).alias("departures"), F.max(kind.startswith("new_")).alias("arrivals"),
        F.array_sort(F.collect_set("change_type")).alias("matched_keywords"),
        F.array_sort(F.collect_set("severity")).alias("matched_categories"))
    any_ = (F.col("critical") + F.col("notable")) > 0
    mood = (
        F.when(~any_, "neutral").when(F.col("departures") & F.col("arrivals"), "mixed")
        .when(F.col("departures"), "negative").when(F.col("arrivals"), "positive").otherwise("neutral"))
    note = lambda c, word: F.concat(F.col(c).cast("string"), F.lit(f" {word} leadership change(s) detected"))
    return counted.select(
        "company_id", F.when(any_, "significant").otherwise("insignificant").alias("classification"),
        mood.alias("sentiment"),
        F.when(F.col("critical") > 0, 0.95).when(F.col("notable") > 0, 0.80).otherwise(0.75).alias("confidence"),
        "matched_keywords", "matched_categories",
        F.when(F.col("critical") > 0, note("critical", "critical")).when(F.col("notable") > 0, note("notable", "notable"))
        .otherwise("No significant leadership changes").alias("notes"))


def apply_departures(leaders: DataFrame, changes: DataFrame, current: DataFrame, as_of) -> DataFrame:
    """The leader table with departed people no longer current and those seen again verified."""
    keys = ["company_id", "linkedin_profile_url"]
    gone = changes.filter(F.col("change_type").endswith("_departure")).select(*keys).distinct()
    marked = update_by_key(leaders, gone.withColumn("is_current", F.lit(False)), keys, ["is_current"])
    seen = current.select(*keys).distinct().withColumn("last_verified_at", moment(as_of))
    return update_by_key(marked, seen, keys, ["last_verified_at"])


def reconcile(mentions: DataFrame, leaders: DataFrame) -> DataFrame:
    """Website mentions against the roster: matched, missing_in_db, missing_on_website.

    Names match when they share two words. Both sides meet on word pairs, for each of
    which only the first leader is kept, so that common names never pair up in bulk.
    """
    said = mentions.filter(F.coalesce(strip("person_name"), F.lit("")) != "").select(
        "company_id", F.col("id").alias("mention_id"), strip("person_name").alias("mention_name"), "title_context")
    held = leaders.filter(F.coalesce(strip("person_name"), F.lit("")) != "").select(
        "company_id", F.col("id").alias("leader_id"), strip("person_name").alias("leader_name"), "title")
    pair = lambda df, c: df.withColumn("pair", F.explode(token_pairs(c)))
    first = pair(held, "leader_name").groupBy("company_id", "pair").agg(F.min("leader_id").alias("leader_id"))
    hits = pair(said, "mention_name").select("company_id", "mention_id", "pair").join(first, ["company_id", "pair"]).groupBy(
        "company_id", "mention_id").agg(F.min("leader_id").alias("leader_id"))
    matched = hits.join(said, ["company_id", "mention_id"]).join(held, ["company_id", "leader_id"]).select(
        "company_id", F.lit("matched").alias("flag"), F.col("leader_name").alias("person_name"), "title",
        F.lit("leadership_mentions + company_leadership").alias("source"), "mention_id", "leader_id")
    not_held = said.join(hits.select("company_id", "mention_id"), ["company_id", "mention_id"], "left_anti").select(
        "company_id", F.lit("missing_in_db").alias("flag"), F.col("mention_name").alias("person_name"),
        blank_to_null("title_context").alias("title"), F.lit("leadership_mentions").alias("source"), "mention_id",
        F.lit(None).cast("bigint").alias("leader_id"))
    not_said = held.join(hits.select("company_id", "leader_id").distinct(), ["company_id", "leader_id"], "left_anti").select(
        "company_id", F.lit("missing_on_website").alias("flag"), F.col("leader_name").alias("person_name"),
        blank_to_null("title").alias("title"), F.lit("company_leadership").alias("source"),
        F.lit(None).cast("bigint").alias("mention_id"), "leader_id")
    return matched.unionByName(not_held).unionByName(not_said)


def _names_company(text: Column, company: Column) -> Column:
    """The text holds the company's name, with or without its legal suffix."""
    text, company = F.lower(F.coalesce(text, F.lit(""))), F.lower(company)
    hit = F.contains(text, company)
    for suffix in fixed.COMPANY_SUFFIXES:
        stem = strip(F.substring(company, F.lit(1), F.length(company) - len(suffix)))
        hit = hit | (company.endswith(suffix) & (stem != "") & F.contains(text, stem))
    return hit


def employment_status(profiles: DataFrame, companies: DataFrame) -> DataFrame:
    """Whether a person still works at the company: ``employment``, ``confidence``, ``evidence``,
    ``current_title``, ``current_employer``.

    A verdict record decides; without one the headline, then the experience entries.
    Columns: company_id, verdict struct<is_employed, never_employed, evidence, current_title,
    current_employer, error>, headline, experience array<struct<title, company, dates>>.
    """
    names = companies.select(F.col("id").alias("company_id"), F.col("name").alias("__company"))
    joined = profiles.join(names, "company_id")
    company, v = F.col("__company"), F.col("verdict")
    told = v.isNotNull() & (F.coalesce(v["error"], F.lit("")) == "")
    headline = F.coalesce("headline", F.lit(""))
    jobs = F.coalesce("experience", F.array().cast("array<struct<title:string,company:string,dates:string>>"))
    here = F.filter(jobs, lambda j: _names_company(j["company"], company))
    now = F.get(F.filter(here, lambda j: F.lower(j["dates"]).rlike("present|current")), F.lit(0))
    with_data = joined.withColumn("__now", now).withColumn("__here", F.size(here)).withColumn("__jobs", F.size(jobs))
    now, in_headline = F.col("__now"), (headline != "") & _names_company(headline, company)
    nothing = F.col("headline").isNull() & F.col("experience").isNull()

    def outcome(status: str, confidence: float, evidence: Column, title: Column, employer: Column) -> Column:
        return F.struct(F.lit(status).alias("employment"), F.lit(confidence).alias("confidence"),
                        evidence.alias("evidence"), title.alias("current_title"), employer.alias("current_employer"))

    empty = F.lit("")
    about = lambda text, *values: F.format_string(re.sub(r"\{\d\}", "%s", text), *values)
    from_verdict = lambda text: F.concat(about(text, company), F.coalesce(v["evidence"], empty))
    v_title, v_employer = F.coalesce(v["current_title"], empty), F.coalesce(v["current_employer"], empty)
    result = (
        F.when(told & F.coalesce(v["never_employed"], F.lit(False)),
               outcome("wrong_person", 0.85, from_verdict(fixed.EVIDENCE_NEVER), v_title, v_employer))
        .when(told & F.coalesce(v["is_employed"], F.lit(False)),
              outcome("employed", 0.90, from_verdict(fixed.EVIDENCE_NOW), v_title, v_employer))
        .when(told, outcome("departed", 0.85, from_verdict(fixed.EVIDENCE_NO_LONGER), v_title, v_employer))
        .when(nothing, outcome("unknown", 0.0, F.lit(fixed.EVIDENCE_NO_DATA), empty, empty))
        .when(in_headline, outcome("employed", 0.75, F.concat(F.lit(fixed.EVIDENCE_HEADLINE), headline), headline, company))
        .when(now.isNotNull(), outcome(
            "employed", 0.80, F.concat(F.lit(fixed.EVIDENCE_ROLE), now["company"], F.lit(": "), now["title"],
                                       F.lit(" ("), now["dates"], F.lit(")")), now["title"], now["company"]))
        .when(F.col("__here") > 0, outcome(
            "departed", 0.70, F.lit(fixed.EVIDENCE_PAST), empty, empty))
        .when(F.col("__jobs") > 0, outcome(
            "wrong_person", 0.60, about(fixed.EVIDENCE_ABSENT, company, F.col("__jobs").cast("string")), empty, empty))
        .otherwise(outcome("unknown", 0.3, F.lit(fixed.EVIDENCE_THIN), empty, empty))
    )
    return with_data.withColumn("__r", result).select(*profiles.columns, "__r.*")


def _substrings(name: Column, lengths: Column) -> Column:
    """Every part of a name that has one of ``lengths`` and begins and ends in a non-blank."""
    starts = F.sequence(F.lit(1), F.length(name))
    parts = F.flatten(F.transform(starts, lambda i: F.transform(
        F.filter(lengths, lambda n: n <= F.length(name) - i + 1), lambda n: F.substring(name, i, n))))
    return F.when(F.length(name) > 0, F.array_distinct(F.filter(parts, lambda p: p == F.trim(p))))


def _key_lengths(people: DataFrame) -> Column:
    """The lengths that the names of a roster have: one small list."""
    return people.agg(F.collect_set(F.length("__key")).alias("lengths")).scalar()


def merge_people(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Two extractions of one roster (company_id, position, name, title, profile_url) as one.

    The primary keeps its URLs; the first secondary person whose name equals, contains or
    is part of it fills an empty title and a shorter name. Secondary people not seen by
    URL or name are added. Containment is an equality join on the parts of a name that are as
    long as some name of the other side, each part held by its first person only.
    """
    key = F.lower(F.array_join(F.split(strip(F.coalesce("name", F.lit(""))), r"(?U)\s+"), " "))
    a = primary.withColumn("__key", key)
    b = secondary.withColumn("__key", key)
    first_b = b.filter("__key <> ''").groupBy("company_id", "__key").agg(F.min("position").alias("__b"))
    part_of_a = a.withColumn("__lengths", _key_lengths(b)).select(
        "company_id", "position", F.explode(_substrings(F.col("__key"), F.col("__lengths"))).alias("__key"))
    contained = part_of_a.join(first_b, ["company_id", "__key"]).select("company_id", "position", "__b")
    parts_of_b = b.withColumn("__lengths", _key_lengths(a)).select(
        "company_id", F.col("position").alias("__p"), F.explode(_substrings(F.col("__key"), F.col("__lengths"))).alias("__key"))
    first_part = parts_of_b.groupBy("company_id", "__key").agg(F.min("__p").alias("__b"))
    containing = a.filter("__key <> ''").select("company_id", "position", "__key").join(
        first_part, ["company_id", "__key"]).select("company_id", "position", "__b")
    hits = contained.unionByName(containing).groupBy("company_id", "position").agg(F.min("__b").alias("__b"))
    match = b.select("company_id", F.col("position").alias("__b"), F.col("name").alias("__name"),
                     F.col("title").alias("__title"), F.col("__key").alias("__match_key"))
    enriched = a.join(hits, ["company_id", "position"], "left").join(match, ["company_id", "__b"], "left")
    longer = F.length(F.coalesce("__name", F.lit(""))) > F.length(F.coalesce("name", F.lit("")))
    merged = enriched.select(
        "company_id", "position", F.when(longer, F.col("__name")).otherwise(F.col("name")).alias("name"),
        F.coalesce(blank_to_null("title"), blank_to_null("__title"), F.lit("")).alias("title"), "profile_url",
        F.lit("primary").alias("origin"))
    seen_names = enriched.select("company_id", "__key").unionByName(
        enriched.select("company_id", F.col("__match_key").alias("__key"))).filter(F.coalesce("__key", F.lit("")) != "").distinct()
    seen_urls = a.filter(F.coalesce("profile_url", F.lit("")) != "").select("company_id", "profile_url").distinct()
    extra = b.join(seen_urls, ["company_id", "profile_url"], "left_anti").join(seen_names, ["company_id", "__key"], "left_anti")
    own_name = F.coalesce(blank_to_null("__key"), F.concat(F.lit("#"), F.col("position").cast("string")))
    own_url = F.coalesce(blank_to_null("profile_url"), F.concat(F.lit("#"), F.col("position").cast("string")))
    extra = first_per_key(extra.withColumn("__n", own_name), ["company_id", "__n"], ["position"])
    extra = first_per_key(extra.withColumn("__u", own_url), ["company_id", "__u"], ["position"])
    return merged.unionByName(extra.select(
        "company_id", "position", "name", "title", "profile_url", F.lit("secondary").alias("origin")))


def ceo_mentions(mentions: DataFrame) -> DataFrame:
    return mentions.filter(F.lower("title_context").rlike("ceo|founder|president|chief executive"))


def best_ceo_name(mentions: DataFrame) -> DataFrame:
    """Per company the surest CEO, founder or president mention."""
    return first_per_key(ceo_mentions(mentions), ["company_id"], [F.col("priority"), F.col("confidence").desc(), F.col("id")])


def store_ceo_profiles(found: DataFrame, leaders: DataFrame, links: DataFrame, as_of, method: str = "kagi_ceo_search") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Leader and link tables with found profiles (company_id, position, name, title, profile_url)
    stored or re-verified, and counts per company."""
    keys = ["company_id", "linkedin_profile_url"]
    clean = found.withColumn("linkedin_profile_url", normalize_profile("profile_url")).filter(
        F.col("linkedin_profile_url").contains("linkedin.com/in/"))
    now = moment(as_of)
    rows = clean.select(
        "company_id", F.coalesce("name", F.lit("Unknown")).alias("person_name"), F.coalesce("title", F.lit("")).alias("title"),
        "linkedin_profile_url", F.lit(method).alias("discovery_method"), F.lit(0.65).alias("confidence"),
        F.lit(True).alias("is_current"), now.alias("discovered_at"), now.alias("last_verified_at"), "position")
    added = new_rows(leaders, rows, keys, ["position"]).drop("position")
    seen = clean.select(*keys).distinct().withColumn("last_verified_at", now)
    verified = update_by_key(leaders, seen, keys, ["last_verified_at"])
    link_rows = clean.select(
        "company_id", F.lit("linkedin").alias("platform"), F.col("linkedin_profile_url").alias("profile_url"),
        F.lit(method).alias("discovery_method"), F.lit("unverified").alias("verification_status"),
        now.alias("discovered_at"), "position")
    fresh_links = new_rows(links, link_rows, ["company_id", "profile_url"], ["position"]).drop("position")
    # Profiles are parsed once for all counts: a row per company and profile, and where it is known.
    held = leaders.select(*keys).distinct().withColumn("__held", F.lit(True))
    linked = links.select("company_id", F.col("profile_url").alias("linkedin_profile_url")).distinct().withColumn("__linked", F.lit(True))
    counts = (
        clean.groupBy(*keys).agg(F.count("*").alias("__n")).join(held, keys, "left").join(linked, keys, "left")
        .groupBy("company_id").agg(
            F.sum("__n").alias("profiles"), F.count_if(F.col("__held").isNull()).alias("profiles_found"),
            F.sum(F.when(F.col("__held"), F.col("__n")).otherwise(0)).alias("reverified"),
            F.count_if(F.col("__linked").isNull()).alias("links_added"))
        .withColumn("already_existed", F.col("profiles") - F.col("links_added"))
    )
    return (verified.unionByName(added, allowMissingColumns=True),
            links.unionByName(fresh_links, allowMissingColumns=True), counts)


def leadership_overview(leaders: DataFrame, companies: DataFrame, profile_snapshots: DataFrame, current_only: bool = True) -> DataFrame:
    """Leaders with their company and the newest capture of their profile, if the company made it."""
    people = leaders.filter("is_current") if current_only else leaders
    newest = latest_per_key(
        profile_snapshots.filter("url_type = 'person'").select(
            "id", "linkedin_url", "company_id", "captured_at", "vision_data_json"),
        ["linkedin_url"], ["captured_at", "id"]
    ).select(F.col("linkedin_url").alias("linkedin_profile_url"), "company_id",
             F.col("captured_at").alias("last_snapshot_at"), F.col("vision_data_json").alias("latest_vision_data"))
    named = with_company(people, companies).drop("company_homepage")
    return named.join(newest, ["linkedin_profile_url", "company_id"], "left")


def leadership_changes(changes: DataFrame, companies: DataFrame, as_of, days: int = 90, severity: str | None = None, company_id: int | None = None) -> DataFrame:
    """The change log with companies, newest first."""
    hits = changes.filter(on_or_after("detected_at", as_of, days))
    if severity:
        hits = hits.filter(F.col("severity") == severity)
    if company_id is not None:
        hits = hits.filter(F.col("company_id") == company_id)
    return with_company(hits, companies)


def leadership_departures(changes: DataFrame, companies: DataFrame, as_of, days: int = 90) -> DataFrame:
    """Recent critical leadership changes."""
    return leadership_changes(changes, companies, as_of, days, "critical")


def leadership_digest(leaders: DataFrame, checks: DataFrame) -> DataFrame:
    """Current leaders and verification rows for a reviewer: ``company_id, section, id, changed, line``.

    ``checks``: company_id, id, captured_at, person_name, title, status, confidence, evidence,
    change_detected. Every current leader and every check is a row; ``changed`` is NULL for leaders.
    """
    person = F.concat(F.coalesce("person_name", F.lit("Unknown")), F.lit(" ("), F.coalesce("title", F.lit("")), F.lit(")"))
    known = F.concat(
        person, F.lit(" [verified: "), F.coalesce(F.col("last_verified_at").cast("string"), F.lit("never")),
        F.lit(", method: "), F.coalesce("discovery_method", F.lit("unknown")), F.lit("]"))
    verdict = F.concat(
        person, F.lit(": "), F.coalesce("status", F.lit("unknown")), F.lit(" [confidence: "),
        F.format_number(F.coalesce("confidence", F.lit(0.0)), 2), F.lit("] "), F.coalesce("evidence", F.lit("")))
    shape = lambda df, section, changed, line: df.select(
        "company_id", F.lit(section).alias("section"), "id", changed.alias("changed"), line.alias("line"))
    return shape(leaders.filter("is_current"), "leader", F.lit(None).cast("boolean"), known).unionByName(
        shape(checks, "check", F.coalesce("change_detected", F.lit(False)), verdict))
