"""Session helpers: the shared work folder and its publication by rename."""

from __future__ import annotations

import atexit
import json
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(app: str = "siltstone", cores: int | str = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and all executors are threads of one machine (tests, local mode) a temporary folder is made
    and set; it is removed when the program ends. On a cluster an unset folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder path under the shared root (not created yet)."""
    return f"{shared_root(spark)}/siltstone/{name}-{uuid.uuid4().hex[:12]}"


def hadoop_path(spark: SparkSession, path: str):
    """(FileSystem, Path) of a path, through the JVM, so any Hadoop scheme works."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that it appears whole: to a side name, then renamed. ``path`` must not exist."""
    fs, target = hadoop_path(spark, path)
    _, side = hadoop_path(spark, f"{path}.{uuid.uuid4().hex[:8]}.tmp")
    out = fs.create(side, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(target) or not fs.rename(side, target):
        fs.delete(side, False)
        raise OSError(f"cannot publish {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None where it is absent."""
    fs, p = hadoop_path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of a folder's entries; empty where the folder is absent."""
    fs, p = hadoop_path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    if fs.exists(p):
        fs.delete(p, True)


def _numbered(spark: SparkSession, base: str, kind: str) -> list[int]:
    return sorted(int(m.group(1)) for n in list_names(spark, f"{base}/_manifests") if (m := re.fullmatch(kind + r"-(\d+)(?:\.json)?", n)))


def publish(spark: SparkSession, base: str, version: str, **facts: object) -> None:
    """Make ``version`` the current one of ``base``; readers see the old or the new, never a mix.

    A writer first claims the next number by creating a file that must not exist, so of two writers one fails.
    The manifest of that number is then written whole to a side name and renamed to its own, which nothing
    else ever had, so the switch is one rename. A number that was claimed and never published is left out.
    """
    n = max(_numbered(spark, base, "claim") + _numbered(spark, base, "manifest"), default=-1) + 1
    fs, claim = hadoop_path(spark, f"{base}/_manifests/claim-{n:010d}")
    fs.create(claim, False).close()
    write_text(spark, f"{base}/_manifests/manifest-{n:010d}.json", json.dumps({"version": version, **facts}))


def published(spark: SparkSession, base: str) -> dict | None:
    """The newest manifest of ``base``."""
    numbers = _numbered(spark, base, "manifest")
    return json.loads(read_text(spark, f"{base}/_manifests/manifest-{numbers[-1]:010d}.json")) if numbers else None


def vacuum_manifests(spark: SparkSession, base: str) -> None:
    """Remove all manifests and claims before the newest manifest."""
    for kind, ending in (("manifest", ".json"), ("claim", "")):
        for n in _numbered(spark, base, kind):
            if n < max(_numbered(spark, base, "manifest"), default=0):
                delete_path(spark, f"{base}/_manifests/{kind}-{n:010d}{ending}")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
