"""The whole monitoring run: new captures, changes, news, status."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError

from ..operators.changes import change_records, latest_pairs
from ..operators.latest import skippable
from ..operators.news import ingest_news
from ..operators.status import analyze_status, capture_history
from ..operators.tables import NATURAL_KEYS, append_log, new_rows
from ..session import cut_lineage, sized
from ..sources.feeds import match_documents, prepare_articles, prepare_snapshots

Tables = Mapping[str, DataFrame]
Stage = Callable[[Tables], DataFrame]


def stages(as_of) -> dict[str, tuple[str, Stage]]:
    """Stage name: the table it adds to, and what it adds."""

    def captures(t: Tables) -> DataFrame:
        scrapes = t["scrapes"]
        if "company_id" not in scrapes.columns:
            scrapes = match_documents(scrapes, t["companies"])[0].drop("matched_url")
        return prepare_snapshots(scrapes, as_of)

    def changes(t: Tables) -> DataFrame:
        # Pairs are narrow; once their size is known, page texts meet them where they lie if they are few.
        pairs = sized(latest_pairs(t["snapshots"], skippable(t["company_statuses"])))
        ids = pairs.select("company_id", F.explode(F.array("old_id", "new_id")).alias("id"))
        records = change_records(t["snapshots"].join(ids, ["company_id", "id"], "left_semi"), as_of, pairs=pairs)
        return new_rows(t["change_records"], records, NATURAL_KEYS["change_records"], ["detected_at"])

    def news(t: Tables) -> DataFrame:
        return ingest_news(prepare_articles(t["search_hits"], as_of), t["companies"], t["news_articles"], as_of)[0]

    def status(t: Tables) -> DataFrame:
        return analyze_status(
            t["companies"], t["snapshots"], t["company_statuses"], as_of, t.get("social_media_snapshots"),
            t.get("news_articles"), t.get("leadership_changes"),
            sized(capture_history(t["snapshots"])))[0]

    return {
        "captures": ("snapshots", captures), "changes": ("change_records", changes),
        "news": ("news_articles", news), "status": ("company_statuses", status),
    }


def full_scan(tables: Tables, as_of, performed_by: str = "scan", without: Collection[str] = ()) -> tuple[dict[str, DataFrame], DataFrame]:
    """Run the stages in order. Returns the grown tables and ``stage, outcome, rows, error``.

    Each stage's result is written to the shared checkpoint folder before the next begins,
    so later stages read it instead of computing it again. A stage that fails leaves its
    table as it was; a stage without input, or named in ``without``, is skipped. Scrapes without
    ``company_id`` are matched to companies by URL. Added rows get ids above those of their table,
    so that they are the latest ones.
    """
    state = dict(tables)
    summary: list[tuple[str, str, int, str]] = []
    needs = {"captures": "scrapes", "news": "search_hits"}
    for name, (table, stage) in stages(as_of).items():
        if name in without or needs.get(name, table) not in state:
            summary.append((name, "skip", 0, ""))
            continue
        try:
            added = cut_lineage(stage(state))
            rows = added.count()
        except (PySparkException, Py4JJavaError) as error:
            summary.append((name, "failure", 0, str(error)))
            continue
        state[table] = append_log(state[table], added, performed_by, kept=True)
        summary.append((name, "success", rows, ""))
    spark = state["companies"].sparkSession
    return state, spark.createDataFrame(summary, "stage string, outcome string, rows bigint, error string")
