"""Apply a feed of inserts, updates and deletes in order, whatever order it arrives in.

Changes are rows (store_id, key, wal_gen, seq, is_put), with a value where the table holds values. They are divided by
(store_id, key) into groups, the folders of the table, and each group into buckets. Every call chooses the number of buckets by what
the touched groups hold and what comes in, so a table may grow without bound while a bucket does not;
each bucket is one embedded DuckDB table with a primary key, into which
changes are upserted: a conflict overwrites only if the incoming (wal_gen, seq) is greater
than the stored one. Deletes stay as tombstone rows, so a late older put cannot bring a key
back. The same upsert first runs over each input split, so a key with a third of all rows
reaches its bucket as one row per split. Bucket results are written to a new version folder,
and one rename of a manifest makes all of them current at once.

Defined results: rows with a null store_id, key, wal_gen, seq or is_put are no changes and are
dropped. Repeated rows have no effect. If a put and a delete claim the same (wal_gen, seq), the
delete counts; if two puts with different values claim it, the greater value counts, null least.
Values decide nothing else. Empty and very long keys are keys like any other. No changes give no rows.
Further columns are ignored, so they may clash with any name used here.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.session import delete_path, hadoop_path, list_names, publish, published, vacuum_manifests

COLUMNS = ("store_id", "key", "wal_gen", "seq", "is_put")
STATE = "store_id int, key string, wal_gen int, seq long, is_put boolean"
VALUE = ", value string"

# Fixed values
PUT_WORDS = ("PUT", "0")
DELETE_WORDS = ("DELETE", "DEL", "1")

#: Rows and bytes of changes after which a split's table is passed on; bounds a worker's memory.
SPLIT_ROWS, SPLIT_BYTES = 400_000, 192 << 20
#: Rows and bytes upserted at once.
STEP_ROWS, STEP_BYTES = 60_000, 32 << 20
#: Rows of state passed on at once.
EXPORT_ROWS = 10_000
#: Keys and changes, and bytes of values, that a bucket holds at most, but for the unevenness of a hash.
BUCKET_ROWS, BUCKET_BYTES = 300_000, 128 << 20
#: Groups of a table at most; bounds its folders, its manifest and what reaches the driver.
GROUPS = 4096
#: How many times larger values are taken to be than their compressed files.
EXPANSION = 6
#: Memory of one bucket's table; what is beyond goes to a scratch folder of the task, which nothing else reads.
MEMORY = "512MB"


def is_put(op: Column) -> Column:
    """True for a put, false for a delete, null for what is no change."""
    word = F.upper(F.trim(op))
    return F.when(word.isin(*PUT_WORDS), True).when(word.isin(*DELETE_WORDS), False)


def from_log(log: DataFrame) -> DataFrame:
    return log.select("store_id", "key", "wal_gen", "seq", is_put(F.col("op")).alias("is_put"), "value")


def from_runs(records: DataFrame) -> DataFrame:
    """Run records as changes; an unset tombstone flag means a put."""
    return records.select("store_id", "key", "wal_gen", "seq", (~F.coalesce(F.col("isTombstone"), F.lit(False))).alias("is_put"), "value")


class _Table:
    """One bucket's state in an embedded DuckDB table."""

    def __init__(self, values: bool) -> None:
        import duckdb

        self.values = values
        # what is compared, in this order; in SQL terms for incoming and stored rows
        order = ["{0}wal_gen", "{0}seq", "NOT {0}is_put"] + (["{0}value IS NOT NULL", "coalesce({0}value, '')"] if values else [])
        kept = ["wal_gen", "seq", "is_put"] + (["value"] if values else [])
        fields = ", ".join(f"'o{i}': {o.format('')}" for i, o in enumerate(order)) + ", " + ", ".join(f"'{k}': {k}" for k in kept)
        # a command may touch a row once only, so a batch is first reduced to its last change per key
        self.command = f"""INSERT INTO state SELECT store_id, key, {", ".join(f"w.{k}" for k in kept)}
            FROM (SELECT store_id, key, max({{{fields}}}) AS w FROM incoming GROUP BY store_id, key)
            ON CONFLICT (store_id, key) DO UPDATE SET {", ".join(f"{k} = excluded.{k}" for k in kept)}
            WHERE ({", ".join(o.format("excluded.") for o in order)}) > ({", ".join(o.format("state.") for o in order)})"""

        self.scratch = tempfile.mkdtemp(prefix="bucket-", dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": self.scratch})
        self.con.execute("SET preserve_insertion_order=false")
        self.clear()

    def clear(self) -> None:
        self.con.execute("CREATE OR REPLACE TABLE state (store_id INTEGER, key VARCHAR, wal_gen INTEGER, seq BIGINT, is_put BOOLEAN" + ", value VARCHAR" * self.values + ", PRIMARY KEY (store_id, key))")
        self.rows = 0

    def upsert(self, batch: pa.Table) -> None:
        self.con.register("incoming", batch)
        self.con.execute(self.command)
        self.con.unregister("incoming")
        self.rows = self.con.execute("SELECT count(*) FROM state").fetchall()[0][0]

    def export(self) -> Iterator[pa.RecordBatch]:
        yield from self.con.sql("SELECT * FROM state").to_arrow_reader(EXPORT_ROWS)

    def close(self) -> None:
        self.con.close()
        shutil.rmtree(self.scratch, ignore_errors=True)


def _upserter(split_rows: int | None, values: bool):
    """Arrow batches of changes to batches of state; passes state on early beyond ``split_rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, n, size, taken = _Table(values), [], 0, 0, 0
        try:
            for b in batches:
                held.append(b)
                n += b.num_rows
                size += b.nbytes
                if n >= STEP_ROWS or size >= STEP_BYTES:
                    table.upsert(pa.Table.from_batches(held))
                    taken += size
                    held, n, size = [], 0, 0
                    if split_rows and (table.rows > split_rows or taken > SPLIT_BYTES):
                        yield from table.export()
                        table.clear()
                        taken = 0
            if n:
                table.upsert(pa.Table.from_batches(held))
            if table.rows:
                yield from table.export()
        finally:
            table.close()

    return run


def _hash() -> Column:
    return F.xxhash64("store_id", "key")


def _group(groups: int) -> Column:
    return F.pmod(_hash(), F.lit(groups)).cast("int")


def resolve(changes: DataFrame, groups: int, per_group: int = 1, touched: list[int] | None = None, values: bool = False) -> DataFrame:
    """The last change of each key with its group: store_id, key, wal_gen, seq, is_put, value if asked for, group. Tombstones included.

    Each of the ``touched`` groups (all of them by default) is ``per_group`` buckets, and a bucket one task.
    """
    schema = STATE + VALUE * values
    clean = changes.select(*COLUMNS, *["value"] * values).na.drop(subset=list(COLUMNS))
    partial = clean.mapInArrow(_upserter(SPLIT_ROWS, values), schema)
    touched = list(range(groups)) if touched is None else touched
    rank = {g: i for i, g in enumerate(touched)}
    at = F.array(*(F.lit(rank.get(g, -1)) for g in range(groups)))[_group(groups)] if len(touched) < groups else _group(groups)
    bucket = at * per_group + F.pmod(F.floor(_hash() / groups), F.lit(per_group)).cast("int")
    routed = partial.repartitionById(max(1, len(touched) * per_group), bucket)
    return routed.mapInArrow(_upserter(None, values), schema).withColumn("group", _group(groups))


class ChangeTable:
    """A versioned table of current state in a shared folder, for one writer and any readers.

    ``apply`` folds changes into the groups they touch and publishes the next version; the
    manifest names the version folder, rows and bytes of every group, so groups without changes are neither
    read nor written. A failed or repeated call leaves the published state whole; applying
    changes twice gives the same state. The number of groups is fixed by the first call, that of buckets by none.
    """

    def __init__(self, spark: SparkSession, path: str, values: bool = False):
        """``values``: whether the table holds the changes' ``value``, too."""
        self.spark, self.path, self.values = spark, path, values
        self.schema = STATE + VALUE * values

    def _read(self, at: dict[str, dict]) -> DataFrame:
        if not at:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{held['version']}/group={g}" for g, held in at.items()))

    def state(self) -> DataFrame:
        """Live keys and tombstones of the published version; no rows before the first."""
        now = published(self.spark, self.path)
        return self._read(now["at"] if now else {})

    def live(self) -> DataFrame:
        return self.state().where("is_put").drop("is_put")

    def _plan(self, fed: DataFrame, now: dict | None, groups: int | None) -> tuple[int, list[int] | None, int]:
        """Groups of the table, those that are touched (None: all), and buckets of each."""
        size = F.sum(F.octet_length("value")) if self.values else F.lit(0)
        if now is None:
            rows = fed.count()  # from file footers where the source has them
            size = (fed.agg(size).first()[0] or 0) if self.values else 0
            buckets = max(-(-rows // BUCKET_ROWS), -(-size // BUCKET_BYTES))
            groups = groups or min(GROUPS, max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), buckets))
            return groups, None, max(1, -(-buckets // groups))
        groups, at = now["groups"], now["at"]
        coming = fed.na.drop(subset=list(COLUMNS)).groupBy(_group(groups).alias("g")).agg(F.count("*").alias("n"), size.alias("b")).collect()  # at most GROUPS rows
        none = {"rows": 0, "bytes": 0}
        held = {r.g: at.get(str(r.g), none) for r in coming}
        rows = max((held[r.g]["rows"] + r.n for r in coming), default=0)
        size = max((held[r.g]["bytes"] * EXPANSION + (r.b or 0) for r in coming), default=0) if self.values else 0
        return groups, sorted(held), max(1, -(-rows // BUCKET_ROWS), -(-size // BUCKET_BYTES))

    def apply(self, changes: DataFrame, groups: int | None = None) -> str:
        """Apply changes and publish; returns the new version's name.

        ``groups`` counts for the first call only; its default is one per BUCKET_ROWS changes
        or per BUCKET_BYTES of values, and at most GROUPS.
        """
        now = published(self.spark, self.path)
        fed = changes.select(*COLUMNS, *["value"] * self.values)
        groups, touched, per_group = self._plan(fed, now, groups)
        at = now["at"] if now else {}
        if touched is not None:
            fed = self._read({str(g): at[str(g)] for g in touched if str(g) in at}).unionByName(fed)
        version = f"version-{uuid.uuid4().hex[:12]}"
        resolve(fed, groups, per_group, touched, self.values).write.partitionBy("group").parquet(f"{self.path}/{version}")
        publish(self.spark, self.path, version, groups=groups, at={**at, **self._written(version)})
        return version

    def _written(self, version: str) -> dict[str, dict]:
        """What a version's groups hold: rows from file footers, bytes from the file system."""
        folder = f"{self.path}/{version}"
        names = [n[6:] for n in list_names(self.spark, folder) if n.startswith("group=")]
        if not names:
            return {}
        rows = self.spark.read.schema(f"{self.schema}, group int").parquet(folder).groupBy("group").count().collect()  # one row per group
        out = {str(r["group"]): {"version": version, "rows": r["count"], "bytes": 0} for r in rows}
        if self.values:
            for g in out:
                fs, p = hadoop_path(self.spark, f"{folder}/group={g}")
                out[g]["bytes"] = fs.getContentSummary(p).getLength()
        return out

    def forget(self, wal_gen: int, seq: int) -> None:
        """Drop tombstones before (wal_gen, seq), where no change before it will come any more. Groups without any are not rewritten."""
        now = published(self.spark, self.path)
        if now is None:
            return
        old = ~F.col("is_put") & (F.struct("wal_gen", "seq") < F.struct(F.lit(wal_gen).alias("wal_gen"), F.lit(seq).cast("long").alias("seq")))
        groups = _group(now["groups"])
        touched = [str(r.g) for r in self.state().where(old).select(groups.alias("g")).distinct().collect()]  # at most GROUPS rows
        if not touched:
            return
        version = f"version-{uuid.uuid4().hex[:12]}"
        kept = self._read({g: now["at"][g] for g in touched}).where(~old).withColumn("group", groups)
        kept.write.partitionBy("group").parquet(f"{self.path}/{version}")
        rest = {g: held for g, held in now["at"].items() if g not in touched}
        publish(self.spark, self.path, version, groups=now["groups"], at={**rest, **self._written(version)})

    def follow(self, stream: DataFrame, checkpoint: str) -> None:
        """Apply what a stream of changes holds, batch by batch, and stop; a later call goes on from the checkpoint.

        A batch that is repeated after a failure changes nothing, so each change counts once.
        """
        q = stream.writeStream.foreachBatch(lambda batch, _: self.apply(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        finally:
            q.stop()

    def vacuum(self) -> None:
        """Remove version folders that no group of the published version lies in, and manifests before its own."""
        now = published(self.spark, self.path)
        kept = {held["version"] for held in now["at"].values()} if now else set()
        for name in list_names(self.spark, self.path):
            if name.startswith("version-") and name not in kept:
                delete_path(self.spark, f"{self.path}/{name}")
        vacuum_manifests(self.spark, self.path)
