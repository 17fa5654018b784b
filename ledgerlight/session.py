"""Session settings that the engine's results rely on, and the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTC days, ANSI arithmetic, run-time re-planning. Sizes of shuffles and broadcasts are left to the cluster.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}


def session(master: str = "local[*]", **settings: str) -> SparkSession:
    builder = SparkSession.builder.master(master)
    for k, v in (SETTINGS | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


class Tables:
    """The Parquet tables of a folder by name; midnight timestamps of business dates become dates at the scan."""

    DATES = {"orders": ["o_orderdate"], "lineitem": ["l_shipdate"]}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return df.withColumns({c: F.col(c).cast("date") for c in self.DATES.get(name, [])})
