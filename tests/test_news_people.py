from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import titles as T
from pulsegrid.functions.mentions import leadership_mentions
from pulsegrid.operators import news as N
from pulsegrid.operators import people as P

AS_OF = "2024-02-01 00:00:00"
NOW = dt.datetime(2024, 2, 1)


@pytest.mark.parametrize(("text", "domain", "hit"), [
    ("https://acme.com/x", "acme.com", True), ("https://www.acme.com", "acme.com", False), ("https://notacme.com", "acme.com", False),
    ("see ACME.com.", "acme.com", True), ("acme.community", "acme.com", False), ("acme.com-x", "acme.com", False), ("x", "", False), (None, "a.b", False)])
def test_domain(rows, text, domain, hit):
    assert rows([(text, domain)], N.domain_match("t", "d"), "t string, d string") == [hit]


@pytest.mark.parametrize(("text", "name", "hit"), [
    ("Acme announced", "acme", True), ("Acme went home", "acme", False), ("Acme Technology", "Acme Technology", True),
    ("Acme" + " " * 197 + "ceo", "acme", True), ("Acme" + " " * 198 + "ceo", "acme", False),
    ("ceo" + " " * 197 + "Acme", "acme", True), ("ceo" + " " * 198 + "Acme", "acme", False),
    ("anana" + "." * 198 + "ceo", "ana", False), ("anana" + "." * 197 + "ceo", "ana", True), ("", "a", False), ("ceo", "", False)])
def test_context(rows, text, name, hit):
    assert rows([(text, name)], N.name_in_context("t", "d"), "t string, d string") == [hit]


@pytest.mark.parametrize(("url", "domain", "hit"), [
    ("https://wand.ai/x", "wand.app", True), ("https://techcrunch.com", "wand.app", False), ("https://wand.app", "wand.app", False),
    ("https://wandtech.com", "wand.app", True), ("https://ab.com", "abc.com", False), ("https://www.wand.ai:8080", "wand.app", True), ("x", "wand.app", False)])
def test_competitors(rows, url, domain, hit):
    assert rows([(url, domain)], N.competing_domain("t", "d"), "t string, d string") == [hit]


def news_input(spark):
    companies = spark.createDataFrame([(1, "Acme", "https://www.acme.com"), (2, "Zed", None)], "id long, name string, homepage_url string")
    articles = spark.createDataFrame([
        (1, "Acme raised", "https://acme.com/news", "Acme raised a seed round", "acme.com"),
        (1, "Other", "https://acme.io/x", "Acme announced things", "acme.io"),
        (1, "Plain", "https://n.org/1", "Acme announced", "n.org"),
        (1, "Known", "https://n.org/0", "Acme announced on acme.com", "n.org"),
        (2, "Zed", "https://n.org/1", "Zed announced", "n.org")], "company_id long, title string, url string, snippet string, source string")
    return companies, articles.withColumn("published", F.lit(None).cast("timestamp_ntz"))


def test_matching_and_ingest(spark):
    companies, articles = news_input(spark)
    verdicts = spark.createDataFrame([
        (1, "https://n.org/1", True, "same name"), (1, "https://acme.com/news", False, "no"), (2, "https://n.org/1", True, "yes")],
        "company_id long, url string, is_match boolean, reasoning string")
    got = {(r.company_id, r.title): (round(r.match_confidence, 6), r.is_match) for r in N.match_articles(articles, companies, verdicts).collect()}
    assert got == {(1, "Acme raised"): (0.6, True), (1, "Other"): (0.18, False), (1, "Plain"): (0.65, True), (1, "Known"): (0.6, True), (2, "Zed"): (0.65, True)}
    existing = spark.createDataFrame([("https://n.org/0",)], "content_url string")
    stored, counts = N.ingest_news(articles, companies, existing, AS_OF, verdicts)
    rows = {r.content_url: r for r in stored.collect()}
    assert set(rows) == {"https://acme.com/news", "https://n.org/1"} and rows["https://n.org/1"].company_id == 1
    assert rows["https://acme.com/news"].significance_classification == "significant"  # raised, seed round, ...
    assert rows["https://n.org/1"].match_evidence == ["Name in business context: Acme", "LLM verification: same name"]
    assert {r.company_id: (r.found, r.verified, r.stored) for r in counts.collect()} == {1: (4, 2, 2), 2: (1, 1, 0)}


def test_counting_news_matches_once_and_judges_nothing(spark):
    companies, articles = news_input(spark)
    existing = spark.createDataFrame([("https://n.org/0",)], "content_url string")
    stored, counts = N.ingest_news(articles, companies, existing, AS_OF)
    generators = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Generate ")
    assert generators(counts) == 1 and generators(stored) > 1


@pytest.mark.parametrize(("text", "found"), [
    ("CEO: John Smith", [("John Smith", "CEO", 1)]), ("Our ceo, Jane O'Brien-Doe", [("Jane O'Brien-Doe", "CEO", 1), ("Jane O'Brien-Doe", "CEO", 1)]),
    ("our founder Jane Doe", [("Jane Doe", "Founder", 1)]), ("**John Smith**, [President](u)", [("John Smith", "President", 2)]),
    ("Ann Lee (CEO and co-founder)", [("Ann Lee", "CEO and Co-Founder", 2)]), ("Bo Li is the chief executive officer of", [("Bo Li", "Chief Executive Officer", 3)]),
    ("Founded by Ann Lee and Bo Li. Co-founded by Cy Day", [("Ann Lee", "Founder", 4), ("Bo Li", "Founder", 4), ("Cy Day", "Founder", 4)]),
    ("the ceo said", []), (None, [])])
def test_mentions(rows, text, found):
    got = rows([text], leadership_mentions("t"))[0]
    assert [(m.person_name, m.title_context, m.priority) for m in got] == found


def test_mention_snippet(rows):
    text = "x" * 40 + " CEO: John Smith " + "y" * 40
    (m,) = rows([text], leadership_mentions("t"))[0]
    assert m.snippet == "..." + "x" * 29 + " CEO: John Smith " + "y" * 29 + "..."


def test_person_names(rows):
    names = ["John Smith", "Acme Team", "John", "john Smith", "Www Smith.com", "A" * 61 + " B", "Our Co"]
    assert rows(names, T.is_person_name("t", F.lit("our co"))) == [True, False, False, False, False, False, False]


def test_reconcile_first_match_wins(spark):
    mentions = spark.createDataFrame([
        (1, 1, "Dr. Jane Q. Smith", "CEO"), (2, 1, "Smith, Jane", "CEO"), (3, 1, "John Roe", "CTO"), (4, 1, " ", "x"), (5, 2, "Jane Smith", "CEO")],
        "id long, company_id long, person_name string, title_context string")
    leaders = spark.createDataFrame([
        (10, 1, "Jane Smith", "CEO"), (11, 1, "Jane Ann Smith", "CFO"), (12, 1, "Mary Major", "COO")], "id long, company_id long, person_name string, title string")
    got = {(r.flag, r.person_name, r.mention_id, r.leader_id) for r in P.reconcile(mentions, leaders).collect()}
    assert got == {("matched", "Jane Smith", 1, 10), ("matched", "Jane Smith", 2, 10), ("missing_in_db", "John Roe", 3, None), ("missing_in_db", "Jane Smith", 5, None),
                   ("missing_on_website", "Jane Ann Smith", None, 11), ("missing_on_website", "Mary Major", None, 12)}


def test_roster_changes(spark):
    roster = lambda *people: spark.createDataFrame(list(people), "company_id long, linkedin_profile_url string, person_name string, title string")
    old = roster((1, "u/a", "A", "CEO"), (1, "u/b", "B", "VP"))
    new = roster((1, "u/b", "B", "VP"), (1, "u/c", "C", "ceo "), (2, "u/d", "D", "CTO"))
    got = {(r.company_id, r.linkedin_profile_url): (r.change_type, r.severity) for r in P.compare_rosters(old, new).collect()}
    assert got == {(1, "u/a"): ("ceo_departure", "critical"), (1, "u/c"): ("new_ceo", "notable"), (2, "u/d"): ("new_leadership", "notable")}
    assert {r.company_id for r in P.roster_events(old, new, AS_OF, 0.8, "scan").collect()} == {1}
    (summary,) = P.roster_change_summary(P.roster_events(old, new, AS_OF, 0.8, "scan")).collect()
    assert (summary.classification, summary.sentiment, summary.confidence) == ("significant", "mixed", 0.95)


def test_merging_people(spark):
    schema = "company_id long, position long, name string, title string, profile_url string"
    dom = spark.createDataFrame([(1, 1, "J. Smith", "", "u/1"), (1, 2, "Ann Lee", "CTO", "u/2")], schema)
    seen = spark.createDataFrame([(1, 1, "Dr J. Smith", "CEO", ""), (1, 2, "Lee", "X", ""), (1, 3, "New One", "CFO", ""), (1, 4, "new  one", "Y", ""), (1, 5, "Z", "Z", "u/1")], schema)
    got = {(r.name, r.title, r.profile_url, r.origin) for r in P.merge_people(dom, seen).collect()}
    assert got == {("Dr J. Smith", "CEO", "u/1", "primary"), ("Ann Lee", "CTO", "u/2", "primary"), ("New One", "CFO", "", "secondary")}


def test_titles(rows):
    given = ["CEO", "chief happiness officer", "Head VP, Sales", "Co Founder", "general manager", "engineer", "President and COO"]
    assert rows(given, T.title_rank("t")) == [1, 4, 5, 2, 5, 99, 99]
    assert rows(given, T.is_leadership("t")) == [True, True, True, True, True, False, True]
    assert rows(given, T.classify_role("t")) == ["ceo", "other_executive", "other_executive", "co_founder", "other_executive", "other", "other"]
    assert rows(given, T.extract_title("t")) == ["CEO", "chief happiness officer", "VP", "Co Founder", "general manager", None, "President"]


def test_profiles_are_read_once_for_their_counts(spark):
    schema = "company_id long, position long, name string, title string, profile_url string"
    found = spark.createDataFrame([
        (1, 1, "A", "CEO", "https://linkedin.com/in/a"), (1, 2, "A", "CEO", "https://www.linkedin.com/in/a/?x=1"),
        (1, 3, "B", "CEO", "https://linkedin.com/in/b"), (1, 4, "C", "CEO", "https://linkedin.com/in/c"), (2, 5, "A", "CEO", "https://linkedin.com/in/a")], schema)
    leaders = spark.createDataFrame([(1, "A", "CEO", "https://linkedin.com/in/a", True, None)],
                                    "company_id long, person_name string, title string, linkedin_profile_url string, is_current boolean, last_verified_at timestamp_ntz")
    links = spark.createDataFrame([(1, "linkedin", "https://linkedin.com/in/b")] * 2, "company_id long, platform string, profile_url string")
    calls = found.withColumn("name", F.concat(F.lit("once-"), "name")).hint("rebalance")
    counts = P.store_ceo_profiles(calls, leaders, links, AS_OF)[2]
    assert {tuple(r) for r in counts.collect()} == {(1, 4, 2, 2, 2, 2), (2, 1, 1, 0, 1, 0)}
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("RebalancePartitions") == 1
