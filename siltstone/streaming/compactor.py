"""Consolidate many small files of run records into few well-sized ones, as a checkpointed stream.

The stream source discovers each file once and notes it in its checkpoint; every micro-batch is
written to a folder named by its batch number and attempt. A manifest, switched by one rename, says which folders hold the data, so
readers see a batch's former attempt until a retry has been written whole. A record is the triple (store_id, run_id, key):
repeated rows and copies in other files of the batch are reduced to one, and records that earlier batches hold are left out.
Files are sorted by (store_id, run_id, key) and sized by bytes. When a later batch comes, each folder gets a list of the blocks of runs that its
files hold; a batch is compared only with files that hold one of its own blocks. Where batches themselves are small, ``settle``, which every run
ends with, brings them together.

Defined results: among copies of a record the one with the least (file_id, offset, value) is kept.
Rows with a null store_id, run_id or key name no record and are dropped. No input gives no batches
and an empty table; a batch that holds nothing new leaves no folder. Further columns of the source are kept as they are, apart from names beginning
with two underscores.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.ordinal import whole_div
from siltstone.session import delete_path, hadoop_path, list_names, publish, published, vacuum_manifests

RECORD = ("store_id", "run_id", "key")
#: Bytes and rows aimed at per output file; whatever is reached first.
FILE_BYTES, FILE_ROWS = 256 << 20, 50_000_000
#: Runs of a store that make a block in the lists of what files hold.
BLOCK_RUNS = 256
#: Rows whose width is looked at to size the files of a first batch; nothing else depends on them.
WIDTH_ROWS = 500


def _one_each(df: DataFrame) -> DataFrame:
    """One row per record; a partially aggregated minimum, no window."""
    rest = [c for c in df.columns if c not in RECORD]
    order = F.struct(*(c for c in ("file_id", "offset", "value") if c in rest), *(c for c in rest if c not in ("file_id", "offset", "value")))
    best = df.na.drop(subset=list(RECORD)).groupBy(*RECORD).agg(F.min(order).alias("__best"))
    return best.select(*RECORD, *(F.col(f"__best.`{c}`").alias(c) for c in rest)).select(*df.columns)


def _file() -> Column:
    """A data file's path below the data folder."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"/data/([^/]+(?:/[^/]+)*)$", 1)


class Compactor:
    """``run`` processes what is there and stops; calling it again takes only new files."""

    def __init__(self, spark: SparkSession, source: str, target: str, schema, files_per_batch: int = 100_000, file_rows: int = FILE_ROWS, file_bytes: int = FILE_BYTES):
        self.spark, self.source, self.target, self.schema = spark, source, target, schema
        self.files_per_batch, self.file_rows, self.file_bytes = files_per_batch, file_rows, file_bytes

    def _parts(self) -> dict[str, dict]:
        """Committed batches: number -> folder, its rows and bytes as written."""
        now = published(self.spark, self.target)
        return now["parts"] if now else {}

    def _publish(self, parts: dict[str, dict]) -> None:
        publish(self.spark, self.target, str(len(parts)), parts=parts)

    def _read(self, parts: dict[str, dict]) -> DataFrame:
        folders = sorted({p["folder"] for p in parts.values()})
        return self.spark.read.schema(self.schema).parquet(*(f"{self.target}/data/{f}" for f in folders))

    def _width(self, df: DataFrame) -> float:
        """Bytes a row takes in a file: as in what was written so far, or about half of some rows' texts."""
        held = {p["folder"]: p for p in self._parts().values()}.values()
        rows = sum(p["rows"] for p in held)
        if rows:
            return sum(p["bytes"] for p in held) / rows
        return (df.limit(WIDTH_ROWS).agg(F.avg(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0] or 0) / 2

    def _save(self, df: DataFrame, rows: int, width: float, folder: str) -> dict | None:
        """Write a folder; what was written, or None if it was nothing. ``rows`` is an upper bound, ``width`` a row's bytes."""
        size = rows * width
        # an exchange even for one file, so that the step before it keeps its tasks
        n = max(1, -(-rows // self.file_rows), int(-(-size // self.file_bytes)))
        path = f"{self.target}/data/{folder}"
        df.repartitionByRange(n, *RECORD).sortWithinPartitions(*RECORD).write.mode("overwrite").parquet(path)
        written = self.spark.read.schema(self.schema).parquet(path)
        rows = written.count()  # from file footers
        if not rows:
            delete_path(self.spark, path)
            return None
        fs, p = hadoop_path(self.spark, path)
        return {"folder": folder, "rows": rows, "bytes": fs.getContentSummary(p).getLength()}

    def overlapping(self, df: DataFrame, parts: dict[str, dict]) -> list[str]:
        """Data files of ``parts`` that hold a block of runs of ``df``; at most one name per file reaches the driver."""
        folders = sorted({p["folder"] for p in parts.values()})
        if not folders:
            return []
        for f in folders:
            # the list of a folder is made when it is first asked for, from two columns, and kept
            if "_SUCCESS" not in list_names(self.spark, f"{self.target}/blocks/{f}"):
                data = self.spark.read.schema(self.schema).parquet(f"{self.target}/data/{f}")
                blocks = data.select(_file().alias("file"), F.col("store_id").cast("int").alias("store_id"), whole_div("run_id", BLOCK_RUNS).alias("block")).distinct()
                blocks.coalesce(1).write.mode("overwrite").parquet(f"{self.target}/blocks/{f}")
        held = self.spark.read.schema("file string, store_id int, block long").parquet(*(f"{self.target}/blocks/{f}" for f in folders))
        mine = df.na.drop(subset=["store_id", "run_id"]).select(F.col("store_id").cast("int").alias("store_id"), whole_div("run_id", BLOCK_RUNS).alias("block")).distinct()
        return sorted(r.file for r in held.join(mine, ["store_id", "block"], "left_semi").select("file").distinct().toLocalIterator())

    def _write(self, df: DataFrame, batch: int) -> None:
        parts, me = self._parts(), str(batch)
        if me in parts and sum(p["folder"] == parts[me]["folder"] for p in parts.values()) > 1:
            return  # a repeated batch that has been brought together with others already
        rows = df.count()  # from file footers
        if not rows:
            return
        fresh = _one_each(df)
        earlier = {b: p for b, p in parts.items() if int(b) < batch}  # the same for every attempt of this batch
        files = self.overlapping(df, earlier)
        if files:
            held = self.spark.read.schema(self.schema).parquet(*(f"{self.target}/data/{f}" for f in files)).select(*RECORD)
            fresh = fresh.join(held, list(RECORD), "left_anti")
        written = self._save(fresh, rows, self._width(df), f"batch={batch:010d}/attempt={uuid.uuid4().hex[:12]}")
        if written or me in parts:
            self._publish({**{b: p for b, p in parts.items() if b != me}, **({me: written} if written else {})})

    def settle(self) -> None:
        """Bring folders of less than half a file together; their records are distinct already."""
        parts = self._parts()
        small = {b: p for b, p in parts.items() if p["rows"] < self.file_rows / 2 and p["bytes"] < self.file_bytes / 2}
        if len({p["folder"] for p in small.values()}) < 2:
            return
        order = sorted(map(int, small))
        rows = sum({p["folder"]: p["rows"] for p in small.values()}.values())
        folder = f"merged={order[0]:010d}-{order[-1]:010d}-{len(order)}/attempt={uuid.uuid4().hex[:12]}"
        held = self._read(small)
        written = self._save(held, rows, self._width(held), folder)
        self._publish({**parts, **dict.fromkeys(small, written)})

    def vacuum(self) -> None:
        """Remove folders that the manifest no longer names, and manifests before the newest."""
        kept = {p["folder"] for p in self._parts().values()}
        for kind in ("data", "blocks"):
            for name in list_names(self.spark, f"{self.target}/{kind}"):
                attempts = list_names(self.spark, f"{self.target}/{kind}/{name}")
                for attempt in attempts:
                    if f"{name}/{attempt}" not in kept:
                        delete_path(self.spark, f"{self.target}/{kind}/{name}/{attempt}")
                if not any(f"{name}/{attempt}" in kept for attempt in attempts):
                    delete_path(self.spark, f"{self.target}/{kind}/{name}")
        vacuum_manifests(self.spark, self.target)

    def run(self, settle: bool = True) -> None:
        fs, p = hadoop_path(self.spark, self.source)
        # the stream source takes folders and patterns; a single file is named by a pattern that only it matches
        source = f"{self.source[:-1]}[{self.source[-1]}]" if fs.isFile(p) else self.source
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", str(self.files_per_batch)).parquet(source)
        q = stream.writeStream.foreachBatch(self._write).option("checkpointLocation", f"{self.target}/checkpoint").trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        finally:
            q.stop()
        if settle:
            self.settle()

    def records(self) -> DataFrame:
        """The consolidated records of all committed batches."""
        parts = self._parts()
        return self._read(parts) if parts else self.spark.createDataFrame([], self.schema)

    def locations(self) -> DataFrame:
        """Where each record lies now: store_id, run_id, key, data_file, row_in_file."""
        parts = self._parts()
        if not parts:
            return self.spark.createDataFrame([], "store_id int, run_id long, key string, data_file string, row_in_file long")
        return self._read(parts).select(*RECORD, _file().alias("data_file"), F.col("_metadata.row_index").alias("row_in_file"))


def catalogue(files: DataFrame, records: DataFrame) -> DataFrame:
    """What became of each file: file_id, store_id, run_id, n_found distinct records read from it, and its fate.

    ``absorbed`` files have records in the data, ``archived`` ones had theirs removed, ``empty`` ones
    hold none. The counts that the files claim are not used, as they may be null or wrong.
    """
    held = records.na.drop(subset=[*RECORD, "file_id"]).groupBy("file_id", *RECORD).agg(F.count("*").alias("__n")).groupBy("file_id").agg(F.count("*").alias("n_found"))
    n = F.coalesce("n_found", F.lit(0))
    fate = F.when(n > 0, "absorbed").when(F.col("archived_at").isNotNull(), "archived").otherwise("empty")
    return files.select("file_id", "store_id", "run_id", "archived_at").join(held, "file_id", "left").select("file_id", "store_id", "run_id", n.alias("n_found"), fate.alias("fate"))


def remap_index(index: DataFrame, locations: DataFrame) -> DataFrame:
    """Index entries brought to the consolidated files: store_id, run_id, key, data_file, row_in_file.

    Old offsets may be null, stale or doubled, so the entry's key decides; entries whose record is
    gone are dropped, and repeated entries become one. Within a file rows are sorted by
    (store_id, run_id, key), so the entries still bracket any key of their run.
    """
    asked = index.na.drop(subset=list(RECORD)).select(*RECORD).distinct()
    return asked.join(locations, list(RECORD))
