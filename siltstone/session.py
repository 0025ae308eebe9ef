"""Session helpers: the shared folder, written intermediate tables and small file operations.

Everything that cuts lineage goes to the folder named by ``spark.checkpoint.dir``, which all
executors share.  Only a ``local`` master may fall back to a folder of its own.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_dropping: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one where it is unset on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    if sc.applicationId not in _own:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        sc.setCheckpointDir(_own[sc.applicationId])
    return _own[sc.applicationId]


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_dir(spark)}/siltstone/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for an intermediate table; what is there is deleted when the application ends."""
    _drop_at_exit(spark)
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def _drop_at_exit(spark: SparkSession) -> None:
    application = spark.sparkContext.applicationId
    if application in _dropping:
        return
    _dropping.add(application)
    fs, path = _fs(spark, scratch_root(spark))

    def drop() -> None:
        try:
            fs.delete(path, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone already; nothing depends on it
            pass

    atexit.register(drop)


def write_table(df: DataFrame, label: str) -> str:
    """Write ``df`` to the shared folder and give its path."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return path


def read_tables(like: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Written tables with the columns of ``like``, as one scan."""
    return like.sparkSession.read.schema(like.schema).parquet(*paths)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a fault-tolerant cut of the lineage."""
    return read_tables(df, [write_table(df, label)])


def drop_scratch(spark: SparkSession) -> None:
    """Delete every intermediate table of this application now, once their results are no longer read."""
    fs, path = _fs(spark, scratch_root(spark))
    fs.delete(path, True)


def buckets_for(rows: int, per_bucket: int, least: int) -> int:
    """A bucket count that keeps a bucket at about ``per_bucket`` rows whatever the size of the input."""
    return max(least, -(-rows // per_bucket))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder, sorted; empty where it does not exist."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Publish a new small file: write beside it, then rename, so that readers see all of it or nothing.

    A file that is there already is never replaced: that would need a moment without it.
    """
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    _, temporary = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(temporary, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(p) or not fs.rename(temporary, p):
        fs.delete(temporary, False)
        raise OSError(f"cannot publish {path}: is there another writer?")


#: Versions of a manifest that stay behind the newest.
KEPT_VERSIONS = 8


def latest_version(spark: SparkSession, home: str, name: str) -> tuple[int, str] | None:
    """Number and text of the newest version of a manifest; None where there is none."""
    numbers = [int(m[1]) for x in list_names(spark, home) if (m := re.fullmatch(rf"{re.escape(name)}-(\d+)", x))]
    if not numbers:
        return None
    return max(numbers), get_text(spark, f"{home}/{name}-{max(numbers):09d}") or ""


def put_version(spark: SparkSession, home: str, name: str, text: str) -> int:
    """Publish the next version of a manifest.  Older ones are deleted only after it, and never the last few."""
    newest = latest_version(spark, home, name)
    number = 0 if newest is None else newest[0] + 1
    put_text(spark, f"{home}/{name}-{number:09d}", text)
    if number > KEPT_VERSIONS:
        remove(spark, f"{home}/{name}-{number - KEPT_VERSIONS - 1:09d}")
    return number


def get_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)
