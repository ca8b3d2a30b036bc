"""Queries of this package's operators and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import contamination, distinct, frequent, seen, spam, tokenize
from siltstone.session import work_dir
from siltstone.sources.tables import table


def _probed(spark: SparkSession, d: str) -> DataFrame:
    return seen.probed(table(spark, d, "sst_write"), table(spark, d, "index_entry"), work_dir(spark, "seen"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Records whose key came before in its store."""
    return seen.seen_records(_probed(spark, d))


def p2_error_rate(spark: SparkSession, d: str) -> DataFrame:
    """How often the filters answer wrongly, by number of filters asked."""
    return seen.error_report(_probed(spark, d))


def p2_totals(spark: SparkSession, d: str) -> DataFrame:
    """How many keys of generations were probed, and how many of them were unseen, as the filters and the check after them tell."""
    report = seen.error_report(_probed(spark, d))
    return report.agg(F.coalesce(F.sum("probes"), F.lit(0)).alias("probes"), F.coalesce(F.sum("unseen"), F.lit(0)).alias("unseen"))


def _patterns(spark: SparkSession, d: str) -> DataFrame:
    return distinct.patterns(distinct.memberships(table(spark, d, "sst_write")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Days on which a store's distinct keys jump."""
    return distinct.jumps(_patterns(spark, d))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct keys of every day, store, level and combination of them."""
    return distinct.count_by(
        _patterns(spark, d), ("day",), ("store_id",), ("level",), ("day", "store_id"), ("day", "level"), ("store_id", "level"), ("day", "store_id", "level")
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The 30 keys with most log entries."""
    return frequent.most_frequent(table(spark, d, "log_entry")).select("key")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """The same keys with approximate and exact counts."""
    return frequent.most_frequent(table(spark, d, "log_entry"))


def p6_exact(spark: SparkSession, d: str) -> DataFrame:
    """The same keys with their exact counts."""
    return frequent.most_frequent(table(spark, d, "log_entry")).select("key", "n")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokenize.encode_corpus(table(spark, d, "documents"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return contamination.leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_item"), work_dir(spark, "leaks"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the items that leaked into them."""
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of each document to remove."""
    return contamination.removal_spans(_leaks(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages of which more than half is keywords, links or tags."""
    return spam.spam_pages(table(spark, d, "documents"))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """The stuffed share of every page."""
    return spam.score_pages(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_error_rate, p2_totals, p5_found, p5_counts, p6_found, p6_counts, p6_exact, p7_ids, p8_found, p8_spans, p9_found, p9_scores)}

_SST = """r AS (SELECT DISTINCT key, strftime(make_timestamp("timestamp"*1000), '%Y-%m-%d') AS day, store_id, level FROM sst_write
  WHERE key IS NOT NULL AND "timestamp" IS NOT NULL AND "timestamp" <> 0)"""

ORACLE: dict[str, str] = {
    "p2_found": """WITH o AS (SELECT store_id, run_id, key FROM sst_write UNION ALL SELECT store_id, run_id, key FROM index_entry),
      f AS (SELECT store_id, key, min(run_id) AS r0 FROM o WHERE key IS NOT NULL AND store_id IS NOT NULL AND run_id IS NOT NULL GROUP BY 1,2)
      SELECT DISTINCT s.store_id, s.run_id, s.key FROM sst_write s JOIN f USING (store_id, key) WHERE s.run_id > f.r0""",
    "p2_totals": """WITH o AS (SELECT store_id, run_id, key FROM sst_write UNION ALL SELECT store_id, run_id, key FROM index_entry),
      w AS (SELECT greatest(64, (max(run_id)-min(run_id)+1+31)//32) AS width FROM o), k AS (SELECT DISTINCT store_id, key, run_id//width AS gen FROM o, w WHERE key IS NOT NULL AND store_id IS NOT NULL AND run_id IS NOT NULL)
      SELECT count(*) AS probes, count(DISTINCT (store_id, key)) AS unseen FROM k""",
    "p6_exact": "SELECT key, count(*) AS n FROM log_entry WHERE key IS NOT NULL GROUP BY key ORDER BY count(*) DESC, key LIMIT 30",
    "p6_found": "SELECT key FROM log_entry WHERE key IS NOT NULL GROUP BY key ORDER BY count(*) DESC, key LIMIT 30",
    "p5_found": f"""WITH {_SST}, c AS (SELECT day, store_id, level, count(DISTINCT key) AS n FROM r GROUP BY 1,2,3
        UNION ALL SELECT day, store_id, -1, count(DISTINCT key) FROM r GROUP BY 1,2)
      SELECT a.day, a.store_id, a.level FROM c a JOIN c b ON a.store_id=b.store_id AND a.level=b.level AND CAST(a.day AS DATE)=CAST(b.day AS DATE)+1
      WHERE b.n>=8 AND a.n*10>=b.n*16""",
    "p5_counts": f"""WITH {_SST} SELECT CASE WHEN grouping(day)=0 AND grouping(store_id)=1 AND grouping(level)=1 THEN 'day'
        WHEN grouping(day)=1 AND grouping(store_id)=0 AND grouping(level)=1 THEN 'store_id' WHEN grouping(day)=1 AND grouping(store_id)=1 THEN 'level'
        WHEN grouping(level)=1 THEN 'day+store_id' WHEN grouping(store_id)=1 THEN 'day+level' WHEN grouping(day)=1 THEN 'store_id+level' ELSE 'day+store_id+level' END AS "grouping",
        day, store_id, level, count(DISTINCT key) AS n FROM r
      GROUP BY GROUPING SETS ((day),(store_id),(level),(day,store_id),(day,level),(store_id,level),(day,store_id,level))""",
}
