"""What the operators share: the shared folder, staged tables, tokens in SQL."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_staged: list[str] = []
_registered: list[bool] = []
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new temporary one if driver and executors are one process (tests); else an error, since no other folder is known to be shared."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="ledgerlight-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/ledgerlight-{name}-{uuid.uuid4().hex}"
    if not _registered:
        atexit.register(release, spark)
        _registered.append(True)
    _staged.append(path)
    return path


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: lineage ends here and a lost executor costs no recomputation."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in frames:
        if df._staged_at in _staged:
            _staged.remove(df._staged_at)
            _delete(df.sparkSession, df._staged_at)


def settle(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Stages what make() returns and deletes what was staged on the way."""
    before = len(_staged)
    out = stage(make(), name)
    while len(_staged) > before + 1:
        _delete(spark, _staged.pop(-2))
    return out


def _delete(spark: SparkSession, name: str) -> None:
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Deletes the staged tables of this process. Frames built on them can't be read afterwards."""
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    while _staged:
        _delete(spark, _staged.pop())


def ship(spark: SparkSession) -> None:
    """Sends this package's modules to the executors, once for each application."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent.parent
    if sc.applicationId not in _shipped:
        archive = f"{tempfile.mkdtemp(prefix='ledgerlight-')}/{root.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(archive)
        _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def remainder(column: str, n: int) -> Column:
    """crc32 of a key as text, modulo n: the fixed split into learning and held-out rows."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def partitions(rows: int, each: int, least: int = 1) -> int:
    return max(least, -(-int(rows) // each))


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """Whole rows of docs in one column, beside keys made from them: no name of docs can clash with a name used here. `row.*` gives the rows back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[v.alias(k) for k, v in keys.items()])


def free_name(name: str, docs: DataFrame) -> str:
    """name, with as many underscores behind it as it takes to be no column of docs."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name
