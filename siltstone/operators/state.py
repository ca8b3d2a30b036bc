"""Last-writer-wins state of a mutation log, lookups and routing of puts.

Input logs have ``seq`` (unique, the total order), ``op``, ``key``, ``value``. Rows with a
null key are no mutations and are dropped. Further columns are ignored unless said otherwise.
Equal ``seq`` (repeated rows): one of the rows decides, the greatest by (op, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.sources.tables import PUT_BODY


def latest(log: DataFrame, *by: str, keep: tuple[str, ...] = ("op", "value")) -> DataFrame:
    """The last entry of each key (and of each further column in ``by``): key, seq and ``keep``.

    One aggregation with map-side combining, so a key with a third of all rows is one row
    per map task before the shuffle.
    """
    order = F.struct("seq", *keep)
    return log.where(F.col("key").isNotNull()).groupBy("key", *by).agg(F.max(order).alias("last")).select("key", *by, "last.*")


def live(log: DataFrame) -> DataFrame:
    """Current map: key, value. Deleted keys are left out; expiring puts are a map of their own."""
    plain = log.where(F.col("op").isin("PUT", "DELETE"))
    return latest(plain).where(F.col("op") == "PUT").select("key", "value")


def multi_get(requests: DataFrame, state: DataFrame) -> DataFrame:
    """Value of each requested key, null where it is missing. Repeated requests are answered each; a null key gives null."""
    return requests.select("key").join(state.select("key", "value"), "key", "left")


def get(state: DataFrame, key: str) -> DataFrame:
    """At most one row; the equality reaches the scan."""
    return state.where(F.col("key") == key)


def as_json(answers: DataFrame) -> DataFrame:
    """Answers as JSON objects with both fields, null ones too."""
    return answers.select("key", F.to_json(F.struct("key", "value"), {"ignoreNullFields": "false"}).alias("body"))


def key_range(state: DataFrame, low: str, high: str) -> DataFrame:
    """Entries with low <= key <= high, an extension beyond point reads."""
    return state.where(F.col("key").between(low, high))


def route_puts(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Parse put bodies: those with a positive ``ttl`` go to the expiring map, others to the plain one.

    A body that is no JSON object gives null key and value and route PUT.
    """
    parsed = bodies.withColumn("__p", F.from_json(body, PUT_BODY))
    ttl: Column = F.col("__p.ttl")
    return parsed.withColumn("route", F.when(ttl > 0, "PUT_TTL").otherwise("PUT")).withColumn("key", F.col("__p.key")).withColumn("value", F.col("__p.value")).withColumn("ttl", ttl).drop("__p")
