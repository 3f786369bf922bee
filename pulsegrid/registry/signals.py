"""Keyword significance, change records, status."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import dates as D
from ..functions import text as T
from ..functions.keywords import Term
from ..operators import changes as I
from ..operators import significance as J
from ..operators import social as M
from ..operators import status as S
from ..operators.latest import snapshot_pairs
from ..operators.line_order import line_added_in_order
from ..operators.text_diff import line_added, line_similarity
from ..plans.full_scan import full_scan
from ..sources.testbed import CAPTURES_AS_OF, STATUS_AS_OF
from .case import Case, joined, stamp, time_sql, with_tables
from .versions import NEWEST_STATUS

# Frequent words stand in for business terms, as the test texts are invented prose.
WORDS = [
    Term("that", "growth", "positive"), Term("this", "launch", "positive"), Term("the en", "launch", "positive"),
    Term("with", "closure", "negative"), Term("from", "legal_issues", "negative"), Term("have", "acquisition", "negative"),
    Term("was", "styling", "insignificant"),
]
OPTIONS = {
    "negation_words": ("and", "in"), "negation_suffixes": ("the", "of"),
    "false_positives": ("with that", "that the", "from the"),
}
KEPT = [t for t in WORDS if t.category not in fixed.SELF_REPORT_EXCLUDED]
BLANK = "chr(32) || chr(10) || chr(9) || chr(13)"


def terms_sql(terms) -> str:
    rows = ", ".join(f"('{t.keyword}', '{t.category}', '{t.polarity}', {i})" for i, t in enumerate(terms))
    return f"terms AS (SELECT * FROM (VALUES {rows}) v(keyword, category, polarity, rank))"


def _any(template: str, values) -> str:
    return "(" + " OR ".join(template.format(v) for v in values) + ")" if values else "false"


def hits_sql(source: str, key: str = "doc_id", text: str = "text", options=OPTIONS) -> str:
    """CTEs ending in ``hits``: every whole-word occurrence, found by cutting at the plain
    occurrences and looking at the characters on both sides."""
    word = r"'[\p{L}\p{N}_]'"
    negation = f"""({_any("ends_with(prefix, '{0}') OR contains(' ' || prefix || ' ', ' {0} ')", options['negation_words'])}
        OR {_any("starts_with(suffix, '{0}')", options['negation_suffixes'])})"""
    phrase = _any("(strpos(low, '{0}') > 0 AND strpos(low, '{0}') - 1 <= pos AND pos < strpos(low, '{0}') - 1 + length('{0}'))",
                  options["false_positives"])
    return f"""low AS (SELECT {key} AS k, {text} AS txt, lower({text}) AS low FROM {source} WHERE {text} IS NOT NULL),
    cut AS (SELECT k, t.*, unnest(string_split(low, keyword)) AS piece, generate_subscripts(string_split(low, keyword), 1) AS i
      FROM low, terms t WHERE contains(low, keyword)),
    seq AS (SELECT *, CAST(sum(length(piece) + length(keyword)) OVER w - length(keyword) AS BIGINT) AS pos,
      lead(piece) OVER (PARTITION BY k, rank ORDER BY i) AS nxt, lead(piece, 2) OVER (PARTITION BY k, rank ORDER BY i) AS nxt2
      FROM cut WINDOW w AS (PARTITION BY k, rank ORDER BY i)),
    places AS (SELECT k, keyword, category, polarity, rank, pos FROM seq WHERE nxt IS NOT NULL
      AND (CASE WHEN piece = '' THEN i = 1 ELSE NOT regexp_matches(right(piece, 1), {word}) END)
      AND (CASE WHEN nxt = '' THEN nxt2 IS NULL ELSE NOT regexp_matches(left(nxt, 1), {word}) END)),
    around AS (SELECT p.*, l.low, trim(substr(txt, greatest(pos - 50, 0) + 1, least(pos, 50)), {BLANK}) AS context_before,
      trim(substr(txt, pos + length(keyword) + 1, 50), {BLANK}) AS context_after,
      trim(substr(low, greatest(pos - 20, 0) + 1, least(pos, 20)), {BLANK}) AS prefix,
      trim(substr(low, pos + length(keyword) + 1, 30), {BLANK}) AS suffix FROM places p JOIN low l USING (k)),
    hits AS (SELECT k, keyword, category, polarity, rank, pos, context_before, context_after,
      polarity <> 'insignificant' AND {negation} AS is_negated, polarity <> 'insignificant' AND {phrase} AS is_false_positive FROM around)"""


def verdict_sql(docs: str, key: str, magnitude: str) -> str:
    """CTEs ending in ``verdicts`` over ``hits``: one row per document of ``docs``."""
    return f"""eff AS (SELECT *, polarity = 'positive' AND NOT is_negated AND NOT is_false_positive AS p,
      polarity = 'negative' AND NOT is_negated AND NOT is_false_positive AS n FROM hits),
    tally AS (SELECT d.{key} AS k, {magnitude} AS magnitude, count(*) FILTER (p) AS p, count(*) FILTER (n) AS n,
      count(*) FILTER (polarity = 'insignificant') AS c,
      count(*) FILTER (is_negated) * 0.20 + count(*) FILTER (is_false_positive) * 0.30 AS off,
      coalesce(string_agg(keyword, '|' ORDER BY n, rank, pos) FILTER (p OR n), '') AS words,
      coalesce(array_to_string(list_sort(list_distinct(list(category) FILTER (p OR n))), '|'), '') AS kinds,
      coalesce(string_agg(keyword, '|' ORDER BY rank, pos) FILTER (polarity = 'insignificant'), '') AS c_words,
      coalesce(string_agg(category, '|' ORDER BY rank, pos) FILTER (polarity = 'insignificant'), '') AS c_kinds,
      coalesce(string_agg(context_before || ' [' || keyword || '] ' || context_after, '|' ORDER BY n, rank, pos) FILTER (p OR n), '') AS proof
      FROM {docs} d LEFT JOIN eff e ON e.k = d.{key} GROUP BY ALL),
    rules AS (SELECT *, c > 0 AND p + n = 0 AND magnitude = 'minor' AS cosmetic, n >= 2 OR p >= 2 OR p + n = 1 AS scored FROM tally),
    verdicts AS (SELECT k, magnitude,
      CASE WHEN cosmetic THEN 'insignificant' WHEN n >= 2 OR p >= 2 OR (p + n = 1 AND magnitude = 'major') THEN 'significant'
        WHEN p + n = 1 THEN 'uncertain' ELSE 'insignificant' END AS classification,
      CASE WHEN NOT scored THEN 'neutral' WHEN p >= 2 AND n >= 2 THEN 'mixed' WHEN n >= 2 THEN 'negative' WHEN p >= 2 THEN 'positive' ELSE 'neutral' END AS sentiment,
      round(CASE WHEN cosmetic THEN 0.85 WHEN NOT scored THEN 0.75 ELSE greatest(0.0, CASE WHEN n >= 2 THEN 0.80 + least(0.15, n * 0.05)
        WHEN p >= 2 THEN 0.80 + least(0.10, p * 0.05) WHEN magnitude = 'major' THEN 0.70 WHEN magnitude = 'minor' THEN 0.50 ELSE 0.60 END - off) END, 6)::DOUBLE AS confidence,
      CASE WHEN cosmetic THEN c_words WHEN scored THEN words ELSE '' END AS keywords,
      CASE WHEN cosmetic THEN c_kinds WHEN scored THEN kinds ELSE '' END AS categories,
      CASE WHEN cosmetic THEN 'Only insignificant patterns detected with minor changes'
        WHEN n >= 2 THEN concat('Multiple negative signals detected (', n, ' negative keywords)')
        WHEN p >= 2 THEN concat('Multiple positive signals detected (', p, ' positive keywords)')
        WHEN p + n = 1 THEN concat('Single keyword with ', magnitude, ' content change') ELSE 'No significant keywords detected' END AS notes,
      CASE WHEN scored THEN proof ELSE '' END AS evidence FROM rules)"""


LEVEL = "CASE doc_id % 3 WHEN 0 THEN 'minor' WHEN 1 THEN 'moderate' ELSE 'major' END"
VERDICT = """classification AS significance_classification, sentiment AS significance_sentiment,
    confidence AS significance_confidence, keywords AS matched_keywords, categories AS matched_categories, notes AS significance_notes"""


def judged(df, *ids):
    return df.select(
        *ids, "significance_classification", "significance_sentiment", F.round("significance_confidence", 6).alias("significance_confidence"),
        joined("matched_keywords", "matched_keywords"), joined("matched_categories", "matched_categories"), "significance_notes")


def classified(b, **more):
    return J.classify_significance(b.raw("documents"), "text", F.expr(LEVEL), terms=WORDS, **OPTIONS, **more)


def reviewed(b):
    return J.needs_review(classified(b).withColumn("change_magnitude", F.expr(LEVEL)), ("growth",))


def verdict_table(b):
    return b.raw("labels").select(
        "doc_id", F.when(F.col("quality") == 1, "significant").otherwise("insignificant").alias("classification"),
        F.when(F.col("toxic") == 1, "negative").alias("sentiment"), F.lit(0.99).alias("confidence"),
        F.when(F.col("doc_id") % 2 == 0, "second look").otherwise("").alias("reasoning"),
        F.when(F.col("doc_id") % 5 == 0, "timeout").alias("error"))


def changes_sql(table: str, keys: str, social: bool, every: bool, terms=KEPT) -> str:
    """CTEs ending in ``records``: the whole comparison and classification with line measures."""
    first = ", ".join(f"s.{k}" for k in keys.split())
    order = "captured_at, id" if every else "captured_at DESC, id DESC"
    step = "lag" if every else "lead"
    text = lambda c: f"coalesce({c}, '')" if social else f"nullif({c}, '')"
    failed = "false" if social else "trim(coalesce(new_error, '')) <> ''"
    moved = "false" if social else """((a IS NOT NULL AND z IS NULL) OR (a IS NULL AND z IS NOT NULL)
        OR (a IS NULL AND z IS NULL AND trim(coalesce(old_error, '')) <> trim(coalesce(new_error, '')) AND trim(coalesce(new_error, '')) <> ''))"""
    subject = "added" if social else f"coalesce(nullif(trim(added, {BLANK}), ''), nullif(trim(new_text, {BLANK}), ''), trim(old_text, {BLANK}), '')"
    quiet, quiet_score = ("NULL", "NULL") if social else ("'insignificant'", "1.0")
    empty, empty_score = ("NULL", "NULL") if social else ("'insignificant'", "0.5")
    return f"""pairs AS (SELECT {first}, s.id AS new_id, {step}(s.id) OVER w AS old_id, row_number() OVER w AS place,
        content_markdown AS new_text, {step}(content_markdown) OVER w AS old_text, error_message AS new_error, {step}(error_message) OVER w AS old_error,
        {text('content_checksum')} AS z, {step}({text('content_checksum')}) OVER w AS a FROM {table} s
        WINDOW w AS (PARTITION BY {first} ORDER BY {order})),
    cmp AS (SELECT *, CASE WHEN a IS NOT DISTINCT FROM z THEN 'unchanged' WHEN a IS NULL OR z IS NULL OR old_text IS NULL OR new_text IS NULL THEN 'replaced'
        ELSE 'compare' END AS outcome, {failed} AS failed FROM pairs WHERE old_id IS NOT NULL {'' if every else 'AND place = 1'}),
    chg AS (SELECT *, outcome <> 'unchanged' OR {moved} AS has_changed FROM cmp),
    old_lines AS (SELECT new_id, unnest(string_split(old_text, chr(10))) AS line FROM chg WHERE outcome = 'compare'),
    new_lines AS (SELECT new_id, unnest(string_split(new_text, chr(10))) AS line FROM chg WHERE outcome = 'compare'),
    counts AS (SELECT new_id, line, sum(o) AS o, sum(n) AS n FROM (SELECT new_id, line, 1 AS o, 0 AS n FROM old_lines
        UNION ALL SELECT new_id, line, 0, 1 FROM new_lines) GROUP BY new_id, line),
    score AS (SELECT new_id, 2.0 * sum(least(o, n)) / sum(o + n) AS similarity FROM counts GROUP BY new_id),
    measured AS (SELECT c.*, CASE outcome WHEN 'unchanged' THEN 'minor' WHEN 'replaced' THEN 'major' ELSE
        CASE WHEN similarity >= 0.9 THEN 'minor' WHEN similarity >= 0.5 THEN 'moderate' ELSE 'major' END END AS change_magnitude,
        array_to_string(list_filter(string_split(coalesce(new_text, ''), chr(10)),
          lambda x: NOT list_contains(string_split(coalesce(old_text, ''), chr(10)), x)), chr(10)) AS added
        FROM chg c LEFT JOIN score USING (new_id)),
    docs AS (SELECT *, {subject} AS subject FROM measured),
    {terms_sql(terms)}, {hits_sql('docs', 'new_id', 'subject', DEFAULT_OPTIONS)},
    {verdict_sql('docs', 'new_id', 'd.change_magnitude')},
    records AS (SELECT {first.replace('s.', 'd.')}, old_id AS snapshot_id_old, new_id AS snapshot_id_new, has_changed, change_magnitude,
      CASE WHEN has_changed AND failed THEN 'uncertain' WHEN NOT has_changed THEN {quiet} WHEN trim(subject, {BLANK}) = '' THEN {empty} ELSE classification END AS significance_classification,
      CASE WHEN has_changed AND failed THEN 'neutral' WHEN NOT has_changed THEN {'NULL' if social else "'neutral'"} WHEN trim(subject, {BLANK}) = '' THEN {'NULL' if social else "'neutral'"} ELSE sentiment END AS significance_sentiment,
      CASE WHEN has_changed AND failed THEN 0.0 WHEN NOT has_changed THEN {quiet_score} WHEN trim(subject, {BLANK}) = '' THEN {empty_score} ELSE confidence END AS significance_confidence,
      CASE WHEN NOT has_changed OR failed OR trim(subject, {BLANK}) = '' THEN '' ELSE keywords END AS matched_keywords,
      CASE WHEN NOT has_changed OR failed OR trim(subject, {BLANK}) = '' THEN '' ELSE categories END AS matched_categories,
      CASE WHEN has_changed AND failed THEN concat('Snapshot capture failed: ', trim(new_error)) WHEN NOT has_changed THEN {'NULL' if social else "'No content change detected.'"}
        WHEN trim(subject, {BLANK}) = '' THEN {'NULL' if social else "'No analyzable content in diff.'"} ELSE notes END AS significance_notes
      FROM docs d JOIN verdicts v ON v.k = d.new_id)"""


DEFAULT_OPTIONS = {
    "negation_words": fixed.NEGATION_WORDS, "negation_suffixes": fixed.NEGATION_SUFFIXES,
    "false_positives": fixed.FALSE_POSITIVE_PHRASES,
}
SHIPPED = [t for t in J.default_terms() if t.category not in fixed.SELF_REPORT_EXCLUDED]
RECORD = """snapshot_id_old, snapshot_id_new, has_changed, change_magnitude, significance_classification, significance_sentiment,
    significance_confidence, matched_keywords, matched_categories, significance_notes"""


# Sentences with terms of the shipped lexicon, put behind the mapped texts.
PHRASES = ("Our revenue growth is strong", "They announced layoffs and a lawsuit", "A data breach led to a shutdown",
           "We raised a series b funding round", "No news here")
PHRASED = "CASE WHEN content_markdown IS NOT NULL THEN concat(content_markdown, chr(10), CASE id % 5 " + " ".join(
    f"WHEN {i} THEN '{p}.'" for i, p in enumerate(PHRASES)) + " END) END"


def phrased(b, table):
    return b[table].withColumn("content_markdown", F.expr(PHRASED.replace("chr(10)", "'\\n'")))


def phrased_sql(table: str) -> str:
    return f"phrased AS (SELECT * REPLACE ({PHRASED} AS content_markdown) FROM {table}), "


def records(df, *keys):
    return judged(df, *keys, "snapshot_id_old", "snapshot_id_new", "has_changed", "change_magnitude")


def text_pairs(b):
    pairs = snapshot_pairs(b["snapshots"], mode="all", carry=("content_markdown",))
    return pairs.filter("old_content_markdown is not null and new_content_markdown is not null")


# Pages with a notice and a deal put behind the text.
NOTICES = """SELECT doc_id AS id, CAST(substr(source, 4) AS BIGINT) AS company_id, {captured} AS captured_at,
    concat(text, ' (c) ', CAST(2010 + doc_id % 9 AS VARCHAR(20)), CASE WHEN doc_id % 2 = 0 THEN concat('-', CAST(2014 + doc_id % 10 AS VARCHAR(20))) ELSE '' END,
      CASE doc_id % 5 WHEN 0 THEN ' Goods Sold to  customers.' WHEN 1 THEN ' All sold to dealers, later sold to Big Group for cash.' WHEN 2 THEN ' We are Now part of Mega.' ELSE '' END) AS content_markdown,
    CASE WHEN doc_id % 7 < 4 THEN 'timeout' END AS error_message,
    CASE WHEN doc_id % 3 = 0 THEN {captured} - (doc_id % 500) * INTERVAL '1' DAY END AS http_last_modified,
    CASE WHEN (doc_id % 720 > 360) = (CAST(substr(source, 4) AS BIGINT) % 2 = 0) THEN 'positive' ELSE 'negative' END AS baseline_sentiment FROM {documents}"""
CAPTURED = "TIMESTAMP '2024-01-31 00:00:00' - (doc_id % 720) * INTERVAL '1' HOUR"
NOTICES_SQL = "notices AS (" + NOTICES.format(captured=CAPTURED, documents="documents") + ")"


def notices(b):
    return b.spark.sql(NOTICES.replace("{captured}", CAPTURED), documents=b.raw("documents"))


YEAR = r"""list_max(list_transform(regexp_extract_all(content_markdown, '(?:\([cC]\)|[Cc]opyright|©)\s*\d{4}(?:\s*[-–]\s*\d{4})?'),
    lambda m: CAST(regexp_extract(m, '(\d{4})$', 1) AS INT)))"""
MASKED = rf"""regexp_replace(lower(content_markdown), 'sold to(\s*(?:{'|'.join(fixed.COMMERCE_FOLLOWERS)}))', 'SOLD TO\1', 'g')"""
DEAL = "coalesce(" + ", ".join(
    f"""CASE WHEN strpos(masked, '{p}') > 0 THEN trim(substr(content_markdown, greatest(strpos(masked, '{p}') - 31, 0) + 1,
        strpos(masked, '{p}') - 1 + {len(p) + 50} - greatest(strpos(masked, '{p}') - 31, 0)), {BLANK}) END""" for p in fixed.ACQUISITION_PHRASES) + ")"
FACTS_SQL = f"""newest AS (SELECT * FROM notices QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY captured_at DESC, id DESC) = 1),
    masks AS (SELECT *, {MASKED} AS masked FROM newest),
    facts AS (SELECT company_id, {YEAR} AS yr, {DEAL} AS deal,
      CAST(floor((epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(http_last_modified)) / 86400) AS INT) AS age FROM masks),
    page_signals AS (SELECT company_id, 'copyright_year' AS type, CAST(yr AS VARCHAR) AS value,
        CASE WHEN yr >= 2023 THEN 'positive' WHEN yr >= 2021 THEN 'neutral' ELSE 'negative' END AS signal FROM facts WHERE yr IS NOT NULL
      UNION ALL SELECT company_id, 'acquisition_text', deal, 'negative' FROM facts WHERE coalesce(deal, '') <> ''
      UNION ALL SELECT company_id, 'http_last_modified', concat(age, ' days ago'),
        CASE WHEN age <= 90 THEN 'positive' WHEN age <= 365 THEN 'neutral' ELSE 'negative' END FROM facts WHERE age IS NOT NULL)"""
SOCIAL_SQL = """active AS (SELECT *, CAST(floor((epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(latest_post_date)) / 86400) AS INT) AS days
      FROM social_media_snapshots QUALIFY captured_at = max(captured_at) OVER (PARTITION BY company_id, source_url)),
    social_signals AS (SELECT company_id, CASE WHEN coalesce(days > 365, true) THEN 'social_media_inactive' ELSE 'social_media_active' END AS type,
      concat(source_type, ': ', CASE WHEN days IS NULL THEN 'no posting date found' ELSE concat(days, ' days since last post') END) AS value,
      CASE WHEN coalesce(days > 365, true) THEN 'negative' ELSE 'positive' END AS signal FROM active)"""
# News moved to the days of the captures.
NEWS_SQL = """late_news AS (SELECT * REPLACE (published_at + INTERVAL '8122' DAY AS published_at) FROM news_articles),
    recent_news AS (SELECT * FROM late_news WHERE significance_classification = 'significant' AND CAST(published_at AS DATE) >= DATE '2024-01-31' - 90),
    news_signals AS (SELECT company_id, concat('news_', significance_sentiment) AS type, concat(source, ': ', title) AS value, significance_sentiment AS signal
      FROM recent_news WHERE significance_sentiment IN ('positive', 'negative'))"""
LEADERS_SQL = """leader_signals AS (SELECT company_id, CASE WHEN change_type = 'new_ceo' THEN 'leadership_new_ceo' ELSE 'leadership_departure' END AS type,
      concat(change_type, ': ', person_name, ' (', title, ')') AS value, CASE WHEN change_type = 'new_ceo' THEN 'positive' ELSE 'negative' END AS signal
      FROM leadership_changes WHERE detected_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '90' DAY
        AND ((severity = 'critical' AND ends_with(change_type, '_departure')) OR change_type = 'new_ceo'))"""
ERRORS_SQL = """last5 AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY captured_at DESC, id DESC) AS place FROM notices QUALIFY place <= 5),
    error_signals AS (SELECT company_id, 'error_pattern' AS type, concat(bad, '/', n, ' recent snapshots failed: ', error) AS value, 'negative' AS signal
      FROM (SELECT company_id, count(*) AS n, count(error_message) AS bad, arg_min(error_message, place) FILTER (error_message IS NOT NULL) AS error
        FROM last5 GROUP BY company_id) WHERE bad >= 3)"""
DRIFT_SQL = """history AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY captured_at DESC, id DESC) AS place FROM notices),
    ends AS (SELECT company_id, max(place) AS n FROM history GROUP BY company_id),
    drift_signals AS (SELECT e.company_id, 'baseline_drift' AS type, 'sentiment flipped positive -> negative since first snapshot' AS value, 'neutral' AS signal
      FROM ends e JOIN history o ON o.company_id = e.company_id AND o.place = e.n JOIN history z ON z.company_id = e.company_id AND z.place = 1
      WHERE e.n >= 2 AND o.baseline_sentiment = 'positive' AND z.baseline_sentiment = 'negative')"""
VETO_SQL = """proof AS (SELECT *, list_sort(list_filter(CAST(matched_categories AS JSON)::VARCHAR[], lambda x: x IN ('closure', 'financial_distress', 'acquisition'))) AS p FROM recent_news),
    veto AS (SELECT company_id, arg_max(concat('news_veto: ', source, ' -- ', title, ' [', array_to_string(p, ', '), ', conf=', printf('%.2f', significance_confidence), ']'),
      (published_at, id)) AS reason FROM proof WHERE significance_sentiment = 'negative' AND significance_confidence >= 0.75 AND len(p) > 0 GROUP BY company_id)"""
SIGNALS = "page_signals social_signals news_signals leader_signals error_signals drift_signals".split()
STATUS_SQL = f"""signals AS ({' UNION ALL '.join(f'SELECT * FROM {s}' for s in SIGNALS)}),
    subjects AS (SELECT c.id AS company_id, l.status AS previous FROM companies c JOIN newest w ON w.company_id = c.id
      LEFT JOIN latest l ON l.company_id = c.id WHERE coalesce(w.content_markdown, '') <> '' AND NOT coalesce(l.is_manual_override, false)),
    tally AS (SELECT b.company_id, any_value(previous) AS previous, count(*) FILTER (signal = 'positive') AS p, count(*) FILTER (signal = 'negative') AS n,
      count(*) FILTER (signal = 'neutral') AS u FROM subjects b LEFT JOIN signals g ON g.company_id = b.company_id GROUP BY b.company_id),
    sure AS (SELECT *, least(1.0, (p + n) * 0.4 + u * 0.2) AS confidence FROM tally),
    decided AS (SELECT s.company_id, p, n, u, reason, CASE WHEN reason IS NOT NULL THEN 0.95 ELSE confidence END::DOUBLE AS confidence,
      CASE WHEN reason IS NOT NULL THEN 'likely_closed'
        WHEN n = 0 THEN CASE WHEN previous = 'uncertain' AND p >= 2 THEN 'operational' ELSE coalesce(previous, 'operational') END
        WHEN confidence < 0.4 THEN 'uncertain' WHEN confidence >= 0.7 THEN 'likely_closed' WHEN p > n THEN 'operational'
        WHEN n > p THEN 'likely_closed' ELSE 'uncertain' END AS status FROM sure s LEFT JOIN veto v ON v.company_id = s.company_id)"""
STATUS_CTES = ", ".join([NOTICES_SQL, NEWEST_STATUS, FACTS_SQL, SOCIAL_SQL, NEWS_SQL, LEADERS_SQL, ERRORS_SQL, DRIFT_SQL, VETO_SQL, STATUS_SQL])
STATUS_TABLES = "companies company_statuses social_media_snapshots news_articles leadership_changes"


def late_news(b):
    return b["news_articles"].withColumn("published_at", F.expr("published_at + INTERVAL '8122' DAY"))


def analyzed(b, **options):
    return S.analyze_status(b["companies"], notices(b), b["company_statuses"], CAPTURES_AS_OF, b["social_media_snapshots"],
                            late_news(b), b["leadership_changes"], **options)


def override_requests(b):
    return b["companies"].selectExpr(
        "id AS company_id", "CASE WHEN id % 3 = 0 THEN 'likely_closed' WHEN id % 3 = 1 THEN 'bogus' ELSE 'operational' END AS status")


def signal_rows(df):
    return df.select("company_id", "type", "value", "signal")


DATED = """SELECT event_id, concat('Posted ', CASE event_id % 6
    WHEN 0 THEN concat('2023-0', CAST(1 + event_id % 9 AS VARCHAR(20)), '-1', CAST(event_id % 10 AS VARCHAR(20)))
    WHEN 1 THEN concat('February ', CAST(20 + event_id % 12 AS VARCHAR(20)), ', 2023')
    WHEN 2 THEN concat(CAST(1 + event_id % 28 AS VARCHAR(20)), ' Sept 2022')
    WHEN 3 THEN concat(CAST(event_id % 50 AS VARCHAR(20)), ' weeks ago and 1 Jan 1999')
    WHEN 4 THEN 'Dec 5 2031 or 2 months ago' ELSE 'never' END, '.') AS post FROM {events}"""


def dated(b):
    return b.spark.sql(DATED, events=b.raw("events"))


DATED_SQL = "dated AS (" + DATED.replace("{events}", "events") + ")"


CASES = {
    "keyword_matches": Case(
        lambda b: J.keyword_matches(b.raw("documents"), ["doc_id"], "text", WORDS, **OPTIONS),
        "WITH " + terms_sql(WORDS) + ", " + hits_sql("documents") + """ SELECT k AS doc_id, keyword, category, polarity, CAST(pos AS INT) AS position,
            context_before, context_after, is_negated, is_false_positive FROM hits"""),
    "classify_significance": Case(
        lambda b: judged(classified(b), "doc_id"),
        "WITH " + terms_sql(WORDS) + ", " + hits_sql("documents") + ", " + verdict_sql("documents", "doc_id", LEVEL)
        + f" SELECT k AS doc_id, {VERDICT} FROM verdicts"),
    "classify_homepage_significance": Case(
        lambda b: judged(classified(b, exclude_categories=fixed.SELF_REPORT_EXCLUDED), "doc_id"),
        "WITH " + terms_sql(KEPT) + ", " + hits_sql("documents") + ", " + verdict_sql("documents", "doc_id", LEVEL)
        + f" SELECT k AS doc_id, {VERDICT} FROM verdicts"),
    "significance_evidence": Case(
        lambda b: classified(b).select("doc_id", F.md5(F.array_join("evidence_snippets", "|")).alias("evidence")),
        "WITH " + terms_sql(WORDS) + ", " + hits_sql("documents") + ", " + verdict_sql("documents", "doc_id", LEVEL)
        + " SELECT k AS doc_id, md5(evidence) AS evidence FROM verdicts"),
    "business_significance": Case(
        lambda b: judged(J.classify_significance(b.raw("documents")), "doc_id"),
        "WITH " + terms_sql(J.default_terms()) + ", " + hits_sql("documents", options=DEFAULT_OPTIONS) + ", "
        + verdict_sql("documents", "doc_id", "'minor'") + f" SELECT k AS doc_id, {VERDICT} FROM verdicts"),
    "needs_review": Case(
        lambda b: reviewed(b).select("doc_id"),
        "WITH " + terms_sql(WORDS) + ", " + hits_sql("documents") + ", " + verdict_sql("documents", "doc_id", LEVEL)
        + """ SELECT k AS doc_id FROM verdicts WHERE NOT ((classification = 'insignificant' AND magnitude = 'minor' AND confidence >= 0.85)
            OR (classification = 'significant' AND confidence >= 0.90 AND contains('|' || categories || '|', '|growth|')))"""),
    "overlay_verdicts": Case(
        lambda b: judged(J.overlay_verdicts(classified(b), verdict_table(b), ["doc_id"]), "doc_id"),
        "WITH " + terms_sql(WORDS) + ", " + hits_sql("documents") + ", " + verdict_sql("documents", "doc_id", LEVEL)
        + """ SELECT k AS doc_id, CASE WHEN ok THEN CASE WHEN quality = 1 THEN 'significant' ELSE 'insignificant' END ELSE classification END AS significance_classification,
            CASE WHEN ok AND toxic = 1 THEN 'negative' ELSE sentiment END AS significance_sentiment,
            CASE WHEN ok THEN 0.99 ELSE confidence END AS significance_confidence, keywords AS matched_keywords, categories AS matched_categories,
            CASE WHEN ok AND k % 2 = 0 THEN 'second look' ELSE notes END AS significance_notes
            FROM verdicts LEFT JOIN (SELECT *, doc_id % 5 <> 0 AS ok FROM labels) l ON l.doc_id = k"""),
    "line_similarity": Case(
        lambda b: text_pairs(b).select("new_id", F.round(line_similarity("old_content_markdown", "new_content_markdown"), 6).alias("similarity")),
        with_tables("snapshots", """SELECT new_id, round(2.0 * sum(least(o, n)) / sum(o + n), 6)::DOUBLE AS similarity FROM (
            SELECT new_id, line, sum(o) AS o, sum(n) AS n FROM (
              SELECT new_id, unnest(string_split(old_text, chr(10))) AS line, 1 AS o, 0 AS n FROM pairs
              UNION ALL SELECT new_id, unnest(string_split(new_text, chr(10))), 0, 1 FROM pairs) GROUP BY new_id, line) GROUP BY new_id""",
            """pairs AS (SELECT * FROM (SELECT id AS new_id, content_markdown AS new_text, lag(content_markdown) OVER (PARTITION BY company_id
            ORDER BY captured_at, id) AS old_text FROM snapshots) WHERE old_text IS NOT NULL AND new_text IS NOT NULL)""")),
    "moved_lines": Case(
        # Each text against itself with its first line at the end.
        lambda b: b.raw("documents").withColumn("lines", F.split("text", "\n")).filter(
            (F.size("lines") > 1) & (F.size("lines") == F.size(F.array_distinct("lines"))) & ~F.array_contains("lines", "")).select(
            "doc_id", line_added_in_order("text", F.array_join(F.concat(F.slice("lines", 2, F.size("lines")), F.slice("lines", 1, 1)), "\n")).alias("added")),
        """SELECT doc_id, l[1] AS added FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
            WHERE len(l) > 1 AND len(l) = len(list_distinct(l)) AND NOT list_contains(l, '')"""),
    "added_lines": Case(
        lambda b: text_pairs(b).select("new_id", F.md5(line_added("old_content_markdown", "new_content_markdown")).alias("added")),
        with_tables("snapshots", """SELECT new_id, md5(array_to_string(list_filter(string_split(new_text, chr(10)),
            lambda x: NOT list_contains(string_split(old_text, chr(10)), x)), chr(10))) AS added FROM (SELECT id AS new_id, content_markdown AS new_text,
            lag(content_markdown) OVER (PARTITION BY company_id ORDER BY captured_at, id) AS old_text FROM snapshots)
            WHERE old_text IS NOT NULL AND new_text IS NOT NULL""")),
    "error_transitions": Case(
        lambda b: I.error_transitions(snapshot_pairs(b["snapshots"], mode="all")).filter("transition is not null").select("new_id", "transition"),
        with_tables("snapshots", """SELECT new_id, CASE WHEN a IS NOT NULL AND z IS NULL THEN concat('Content recovery -> error: ', new_error)
            WHEN a IS NULL AND z IS NOT NULL THEN 'Site recovered from previous error' ELSE concat('Error state changed: ', new_error) END AS transition
            FROM (SELECT id AS new_id, content_checksum AS z, error_message AS new_error, lag(id) OVER w AS old_id, lag(content_checksum) OVER w AS a,
              lag(error_message) OVER w AS old_error FROM snapshots WINDOW w AS (PARTITION BY company_id ORDER BY captured_at, id))
            WHERE old_id IS NOT NULL AND ((a IS NULL) <> (z IS NULL) OR (a IS NULL AND z IS NULL AND old_error <> new_error))""")),
    "change_records": Case(
        lambda b: records(I.change_records(phrased(b, "snapshots"), CAPTURES_AS_OF), "company_id"),
        with_tables("snapshots", f"SELECT company_id, {RECORD} FROM records",
                    phrased_sql("snapshots") + changes_sql("phrased", "company_id", False, False, SHIPPED))),
    "change_records_by_line": Case(
        lambda b: records(I.change_records(b["snapshots"], CAPTURES_AS_OF, terms=KEPT), "company_id"),
        with_tables("snapshots", f"SELECT company_id, {RECORD} FROM records", changes_sql("snapshots", "company_id", False, False))),
    "change_history_by_line": Case(
        lambda b: records(I.change_records(b["snapshots"], CAPTURES_AS_OF, terms=KEPT, pairing="all"), "company_id"),
        with_tables("snapshots", f"SELECT company_id, {RECORD} FROM records", changes_sql("snapshots", "company_id", False, True))),
    "social_change_records": Case(
        lambda b: records(I.social_change_records(phrased(b, "social_media_snapshots"), CAPTURES_AS_OF), "company_id", "source_url"),
        with_tables("social_media_snapshots", f"SELECT company_id, source_url, {RECORD} FROM records",
                    phrased_sql("social_media_snapshots") + changes_sql("phrased", "company_id source_url", True, False, SHIPPED))),
    "social_change_records_by_line": Case(
        lambda b: records(I.social_change_records(b["social_media_snapshots"], CAPTURES_AS_OF, terms=KEPT), "company_id", "source_url"),
        with_tables("social_media_snapshots", f"SELECT company_id, source_url, {RECORD} FROM records",
                    changes_sql("social_media_snapshots", "company_id source_url", True, False))),
    "snapshot_baselines": Case(
        lambda b: I.baseline(b["snapshots"], KEPT).select("id", "company_id", "baseline_classification", "baseline_sentiment",
                                                          F.round("baseline_confidence", 6).alias("baseline_confidence"), "baseline_notes"),
        with_tables("snapshots", """SELECT k AS id, d.company_id, classification AS baseline_classification, sentiment AS baseline_sentiment,
            confidence AS baseline_confidence, notes AS baseline_notes FROM verdicts JOIN docs d ON d.id = k""",
            """docs AS (SELECT s.* FROM snapshots s JOIN (SELECT company_id, min(captured_at) AS first_at FROM snapshots
              WHERE baseline_classification IS NULL AND content_markdown IS NOT NULL GROUP BY company_id) f
              ON s.company_id = f.company_id AND s.captured_at = f.first_at WHERE s.baseline_classification IS NULL AND s.content_markdown IS NOT NULL
              AND s.company_id NOT IN (SELECT company_id FROM snapshots WHERE baseline_classification IS NOT NULL)), """
            + terms_sql(KEPT) + ", " + hits_sql("docs", "id", "content_markdown", DEFAULT_OPTIONS) + ", " + verdict_sql("docs", "id", "'minor'"))),
    "significant_changes": Case(
        lambda b: I.significant_changes(b["change_records"], b["companies"], CAPTURES_AS_OF, 20, "negative", 0.7).select(
            "id", "company_id", "company_name", F.round("significance_confidence", 6).alias("significance_confidence")),
        with_tables("change_records companies", """SELECT r.id, r.company_id, c.name AS company_name, round(significance_confidence, 6) AS significance_confidence
            FROM change_records r JOIN companies c ON c.id = r.company_id WHERE significance_classification = 'significant'
            AND significance_sentiment = 'negative' AND significance_confidence >= 0.7 AND CAST(detected_at AS DATE) >= DATE '2024-01-31' - 20""")),
    "uncertain_changes": Case(
        lambda b: I.uncertain_changes(b["change_records"], b["companies"]).select("id", "company_name"),
        with_tables("change_records companies", """SELECT r.id, c.name AS company_name FROM change_records r JOIN companies c ON c.id = r.company_id
            WHERE significance_classification = 'uncertain'""")),
    "active_companies": Case(
        lambda b: I.active_companies(b["change_records"], b["companies"], CAPTURES_AS_OF, 2).select("company_name", "homepage_url", stamp("detected_at")).distinct(),
        with_tables("change_records companies", f"""SELECT DISTINCT c.name AS company_name, c.homepage_url, {time_sql('detected_at')}
            FROM change_records r JOIN companies c ON c.id = r.company_id WHERE has_changed AND CAST(detected_at AS DATE) >= DATE '2024-01-31' - 2""")),
    "inactive_companies": Case(
        lambda b: I.inactive_companies(b["change_records"], b["companies"], CAPTURES_AS_OF, 1),
        with_tables("change_records companies", """SELECT id, name, homepage_url FROM companies WHERE id NOT IN (SELECT company_id FROM change_records
            WHERE has_changed AND CAST(detected_at AS DATE) >= DATE '2024-01-31' - 1)""")),
    "copyright_year": Case(
        lambda b: notices(b).select("id", F.coalesce(T.copyright_year("content_markdown"), F.lit(-1)).alias("year")),
        "WITH " + NOTICES_SQL + f" SELECT id, coalesce({YEAR}, -1) AS year FROM notices"),
    "acquisition_mention": Case(
        lambda b: notices(b).select("id", T.acquisition_mention("content_markdown").alias("deal")),
        "WITH " + NOTICES_SQL + f", masks AS (SELECT *, {MASKED} AS masked FROM notices) SELECT id, {DEAL} AS deal FROM masks"),
    "snapshot_indicators": Case(
        lambda b: signal_rows(S.snapshot_indicators(S.newest_texts(notices(b)), CAPTURES_AS_OF)),
        "WITH " + NOTICES_SQL + ", " + FACTS_SQL + " SELECT company_id, type, value, signal FROM page_signals"),
    "social_indicators": Case(
        lambda b: signal_rows(S.social_indicators(b["social_media_snapshots"], CAPTURES_AS_OF)),
        with_tables("social_media_snapshots", "SELECT company_id, type, value, signal FROM social_signals", SOCIAL_SQL)),
    "news_indicators": Case(
        lambda b: signal_rows(S.news_indicators(late_news(b), CAPTURES_AS_OF)),
        with_tables("news_articles", "SELECT company_id, type, value, signal FROM news_signals", NEWS_SQL)),
    "leadership_indicators": Case(
        lambda b: signal_rows(S.leadership_indicators(b["leadership_changes"], CAPTURES_AS_OF)),
        with_tables("leadership_changes", "SELECT company_id, type, value, signal FROM leader_signals", LEADERS_SQL)),
    "error_pattern": Case(
        lambda b: signal_rows(S.error_pattern(notices(b))),
        "WITH " + NOTICES_SQL + ", " + ERRORS_SQL + " SELECT company_id, type, value, signal FROM error_signals"),
    "baseline_drift": Case(
        lambda b: signal_rows(S.baseline_drift(notices(b))),
        "WITH " + NOTICES_SQL + ", " + DRIFT_SQL + " SELECT company_id, type, value, signal FROM drift_signals"),
    "news_veto": Case(
        lambda b: S.news_veto(late_news(b), CAPTURES_AS_OF),
        with_tables("news_articles", "SELECT company_id, reason FROM veto", NEWS_SQL + ", " + VETO_SQL)),
    "analyze_status": Case(
        lambda b: analyzed(b)[0].select("company_id", "status", F.round("confidence", 6).alias("confidence"), "positive_count", "negative_count",
                                        "neutral_count", "status_reason"),
        with_tables(STATUS_TABLES, """SELECT company_id, status, round(confidence, 6) AS confidence, p AS positive_count, n AS negative_count,
            u AS neutral_count, reason AS status_reason FROM decided""", STATUS_CTES)),
    "status_signals": Case(
        lambda b: signal_rows(analyzed(b)[1]),
        with_tables(STATUS_TABLES, "SELECT company_id, type, value, signal FROM signals JOIN subjects USING (company_id)", STATUS_CTES)),
    "scan_takes_effect": Case(
        lambda b: S.current_status(full_scan({
            "companies": b["companies"], "snapshots": notices(b), "company_statuses": b["company_statuses"],
            "social_media_snapshots": b["social_media_snapshots"], "news_articles": late_news(b), "leadership_changes": b["leadership_changes"],
        }, CAPTURES_AS_OF, without=("captures", "changes", "news"))[0]["company_statuses"]).select("company_id", "status"),
        with_tables(STATUS_TABLES, """SELECT company_id, status FROM decided UNION ALL
            SELECT company_id, status FROM latest WHERE company_id NOT IN (SELECT company_id FROM decided)""", STATUS_CTES)),
    "override_takes_effect": Case(
        lambda b: S.current_status(S.manual_override(b["company_statuses"], override_requests(b), STATUS_AS_OF, "me")[0]).select(
            "company_id", "status", "is_manual_override"),
        with_tables("company_statuses companies", """SELECT id AS company_id, CASE WHEN id % 3 = 0 THEN 'likely_closed' ELSE 'operational' END AS status,
            true AS is_manual_override FROM companies WHERE id % 3 <> 1 UNION ALL SELECT company_id, status, is_manual_override FROM latest
            WHERE company_id NOT IN (SELECT id FROM companies WHERE id % 3 <> 1)""", NEWEST_STATUS)),
    "clear_takes_effect": Case(
        lambda b: S.current_status(S.clear_override(b["company_statuses"], b["company_statuses"], STATUS_AS_OF, "me")).select(
            "company_id", "status", "is_manual_override"),
        with_tables("company_statuses", "SELECT company_id, status, false AS is_manual_override FROM latest", NEWEST_STATUS)),
    "manual_override": Case(
        lambda b: S.manual_override(b["company_statuses"], override_requests(b), STATUS_AS_OF, "me")[0].groupBy("status", "is_manual_override", "performed_by").agg(F.count("*").alias("n")),
        with_tables("company_statuses companies", """SELECT status, is_manual_override, performed_by, count(*) AS n FROM (
            SELECT status, is_manual_override, NULL AS performed_by FROM company_statuses UNION ALL
            SELECT CASE WHEN id % 3 = 0 THEN 'likely_closed' ELSE 'operational' END, true, 'me' FROM companies WHERE id % 3 <> 1) GROUP BY ALL""")),
    "clear_override": Case(
        lambda b: S.clear_override(b["company_statuses"], S.current_status(b["company_statuses"]).filter("is_manual_override"), STATUS_AS_OF, "me")
        .filter("performed_by = 'me'").select("company_id", "status", "confidence", "is_manual_override", stamp("last_checked")),
        with_tables("company_statuses", """SELECT company_id, status, confidence, false AS is_manual_override, '2001-08-01 00:00:00' AS last_checked
            FROM latest WHERE is_manual_override""", NEWEST_STATUS)),
    "latest_post_date": Case(
        lambda b: dated(b).select("event_id", stamp(D.latest_post_date("post", CAPTURES_AS_OF), "latest")),
        "WITH " + DATED_SQL + """ SELECT event_id, strftime(CASE event_id % 6
            WHEN 0 THEN try_cast(concat('2023-0', 1 + event_id % 9, '-1', event_id % 10) AS TIMESTAMP)
            WHEN 1 THEN try_cast(concat('2023-02-', 20 + event_id % 12) AS TIMESTAMP)
            WHEN 2 THEN make_timestamp(2022, 9, 1 + event_id % 28, 0, 0, 0)
            WHEN 3 THEN TIMESTAMP '2024-01-31 00:00:00' - CAST(event_id % 50 * 7 AS INT) * INTERVAL '1' DAY
            WHEN 4 THEN TIMESTAMP '2024-01-31 00:00:00' - 60 * INTERVAL '1' DAY END, '%Y-%m-%d %H:%M:%S') AS latest FROM dated"""),
    "posting_activity": Case(
        lambda b: S.posting_activity(b["social_media_snapshots"], CAPTURES_AS_OF).select(
            "id", "is_inactive", F.coalesce("days_since_post", F.lit(-1)).alias("days_since_post")),
        with_tables("social_media_snapshots", """SELECT id, coalesce(days > 365, true) AS is_inactive, coalesce(days, -1) AS days_since_post
            FROM active""", SOCIAL_SQL)),
    "social_digest": Case(
        lambda b: M.social_digest(b["social_media_snapshots"], CAPTURES_AS_OF).select(
            "company_id", "source_type", "source_url", "id", "last_post", "state", F.md5("content").alias("content")),
        with_tables("social_media_snapshots", f"""SELECT company_id, source_type, source_url, id,
            CASE WHEN latest_post_date IS NULL THEN 'None detected' WHEN days > 365 THEN strftime(latest_post_date, '%Y-%m-%d %H:%M:%S')
              ELSE concat(strftime(latest_post_date, '%Y-%m-%d %H:%M:%S'), ' (', days, ' days ago)') END AS last_post,
            CASE WHEN days IS NULL THEN 'INACTIVE (no posting date found)' WHEN days > 365 THEN concat('INACTIVE (', days, ' days since last post)') ELSE 'ACTIVE' END AS state,
            md5(trim(coalesce(content_markdown, ''), {BLANK})) AS content FROM active""", SOCIAL_SQL)),
}
