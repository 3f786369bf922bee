from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import html as H
from pulsegrid.functions import markup as M
from pulsegrid.functions import urls as U
from pulsegrid.operators.links import classify_accounts, discover_links, page_links
from pulsegrid.operators.groups import connected
from pulsegrid.operators.logos import logo_classes, malformed_hashes, similar_logos
from pulsegrid.operators.timelines import dedupe_links, merge_links

AS_OF = "2024-02-01 00:00:00"
PAGE = """<!DOCTYPE html><html><head>
<meta name="twitter:creator" content="@initech"><meta property="og:image" content="https://initech.example/banner.png">
<link rel="shortcut icon" href="/f.ico">
<script type="application/ld+json">{"@graph": [{"@type": "Organization", "logo": {"url": "https://initech.example/logo.png"},
 "sameAs": "https://www.linkedin.com/company/initech/about"}], "sameAs": ["https://github.com/initech/tool", "mailto:x"]}</script>
</head><body><header><a href="/"><img src="/head.png"></a></header>
<!-- <a href="https://hidden.example.com">no</a> -->
<div class="Main-Menu"><a href="/press?a=1&amp;b=2">Press</a></div>
<main><a href='https://twitter.com/fan/status/12'>t</a><a href="https://twitter.com/fan">fan</a>
<p>unclosed <a href="https://www.youtube.com/@initech/videos" aria-label="Our YouTube">y</a></main>
<div role="contentinfo"><a title="Instagram" href="https://instagram.com/initech">i</a></div>
<section id="page-foot"><span><a href="https://fb.com/initech">f</a></span></section>
<script>var s = '<a href="https://script.example.com">x</a>';</script></body></html>"""


@pytest.mark.parametrize(("url", "kind"), [
    ("https://LinkedIn.com/company/a", "linkedin"), ("https://linkedin.com/jobs", None), ("https://x.com/a", "twitter"),
    ("https://youtube.com/watch?v=1", None), ("https://youtube.com/@a", "youtube"), ("https://bsky.app/profile/a", "bluesky"),
    ("https://fb.com/a", "facebook"), ("https://github.com/a", "github"), ("https://tiktok.com/@a", "tiktok"), ("https://a.medium.com/x", "medium"),
    ("https://any.host/@name", "mastodon"), ("https://threads.net/@a", "mastodon"), ("https://pinterest.com/a", "pinterest")])
def test_platforms(rows, url, kind):
    assert rows([url], U.detect_platform("t")) == [kind]


@pytest.mark.parametrize(("url", "canonical"), [
    (" https://www.GitHub.com/Initech/Repo?x#y ", "https://github.com/Initech"), ("HTTPS://linkedin.com/in/Joe/details/", "https://linkedin.com/in/Joe"),
    ("http://youtube.com/c/initech/videos", "http://youtube.com/c/initech"), ("https://x.com/initech///", "https://x.com/initech"), ("https://youtube.com/user/a/b", "https://youtube.com/user/a/b")])
def test_canonical_profiles(rows, url, canonical):
    assert rows([url], U.normalize_profile("t")) == [canonical]


@pytest.mark.parametrize(("handle", "company", "fits"), [
    ("initech-inc", "Initech Inc", True), ("initech", "Initech Global", True), ("ag", "Alpha Global", True), ("zeta", "Initech", False), ("", "Initech", False), ("@Initech_HQ", "initech", True)])
def test_handle_fits(rows, handle, company, fits):
    assert rows([(handle, company)], U.handle_fits_company("t", "c"), "t string, c string") == [fits]


def test_links_of_a_page(rows):
    get = lambda c: rows([PAGE], c)[0]
    assert get(H.links_from_html("t", F.lit("https://initech.example/x"))) == [
        "https://initech.example/", "https://initech.example/press?a=1&b=2", "https://twitter.com/fan/status/12", "https://twitter.com/fan",
        "https://www.youtube.com/@initech/videos", "https://instagram.com/initech", "https://fb.com/initech"]
    assert get(H.schema_org_links("t")) == ["https://github.com/initech/tool"]
    assert get(H.schema_org_links("t", recursive=True)) == ["https://www.linkedin.com/company/initech/about", "https://github.com/initech/tool"]
    assert get(H.meta_links("t")) == ["https://twitter.com/initech", "https://initech.example/banner.png"]
    assert get(H.labelled_links("t")) == ["https://www.youtube.com/@initech/videos", "https://instagram.com/initech"]
    assert rows(["[a](https://a.com \"T\") [b](/rel) https://b.com) https://a.com"], H.links_from_markdown("t")) == [["https://a.com", "https://b.com"]]


def test_embedded_tweets_drop_untrusted_profiles(spark):
    pages = spark.createDataFrame([(1, 7, "https://initech.example", PAGE)], "page_id long, company_id long, url string, html string")
    links = page_links(pages).first().links
    assert "https://twitter.com/initech" in links and not any("fan" in u for u in links)
    social, blogs = discover_links(pages, AS_OF)
    assert {(r.platform, r.profile_url) for r in social.collect()} == {
        ("twitter", "https://twitter.com/initech"), ("youtube", "https://youtube.com/@initech"), ("instagram", "https://instagram.com/initech"),
        ("facebook", "https://fb.com/initech"), ("github", "https://github.com/initech")}
    assert [(r.blog_type, r.blog_url) for r in blogs.collect()] == [("company_blog", "https://initech.example/press")]


def test_regions(spark):
    pages = spark.createDataFrame([(1, PAGE)], "page_id long, html string")
    got = {r.href: r.region for r in pages.select(F.inline(M.link_regions("html"))).collect()}
    assert got == {"/": "header", "/press?a=1&b=2": "nav", "https://twitter.com/fan/status/12": "main", "https://twitter.com/fan": "main",
                   "https://www.youtube.com/@initech/videos": "main", "https://instagram.com/initech": "footer", "https://fb.com/initech": "footer"}


@pytest.mark.parametrize("threshold", [0.85, 0.9, 0.97])
def test_similar_logos_finds_all_pairs(spark, threshold):
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = [b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 12))) for b in base for _ in range(5)]
    left, right = [f"{v:016x}" for v in base], [f"{v:016x}" for v in near]
    frame = lambda v: spark.createDataFrame([(1, x) for x in v] + [(1, "zz"), (1, "0" * 17), (2, v[0])], "company_id long, perceptual_hash string")
    got = {(r.hash_a, r.hash_b): r.similarity for r in similar_logos(frame(left), frame(right), threshold).filter("company_id = 1").collect()}
    assert {r.perceptual_hash for r in malformed_hashes(frame(left)).collect()} == {"zz", "0" * 17}
    expected = {}
    for x in set(left):
        for y in set(right):
            s = 1 - bin(int(x, 16) ^ int(y, 16)).count("1") / 64
            if s >= threshold:
                expected[(x, y)] = s
    assert got == expected


def test_merging_links(spark):
    schema = "id long, company_id long, profile_url string, similarity_score double"
    old = spark.createDataFrame([(1, 1, "https://A.com/x/", 0.5), (2, 1, "", None)], schema)
    new = spark.createDataFrame([(3, 1, "https://a.com/x", 0.5), (4, 1, "https://a.com/y", None), (5, 1, "https://a.com/y/", 0.1)], schema)
    assert {r.id for r in merge_links(old, new).collect()} == {1, 5}
    assert {r.id for r in dedupe_links(new).collect()} == {3, 5}


def test_accounts(spark):
    links = spark.createDataFrame([
        (1, 1, "https://x.com/initech", "footer", None), (2, 1, "https://x.com/zed", "main", 0.5), (3, 1, "https://x.com/initech", None, 0.85)],
        "id long, company_id long, profile_url string, html_location string, logo_similarity double")
    companies = spark.createDataFrame([(1, "Initech")], "id long, name string")
    got = {r.id: (r.account_type, round(r.account_confidence, 6)) for r in classify_accounts(links, companies).collect()}
    assert got == {1: ("company", 0.7), 2: ("personal", 0.9), 3: ("unknown", 0.4)}


def test_connected(spark):
    rng = random.Random(8)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 260)]
    root = {x: x for link in links for x in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    ends = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in ends}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_logo_classes_span_companies(spark):
    rng = random.Random(3)
    rows, family = [], {}
    for k in range(20):
        centre = rng.getrandbits(64)
        for n in range(12):
            value = centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 9))) if n else centre
            family[f"{value:016x}"] = k
            rows += [(n, f"{value:016x}")] * (5 if n == 0 else 1)
    rows += [(1, None), (1, "rubbish")]
    got = {r.perceptual_hash: r for r in logo_classes(spark.createDataFrame(rows, "company_id long, perceptual_hash string")).collect()}
    assert set(got) == set(family)
    for k in range(20):
        own = [h for h, f in family.items() if f == k]
        assert {got[h]["class"] for h in own} == {min(own)}
    assert sum(r.logos for r in got.values()) == 20 * 16
