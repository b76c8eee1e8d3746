"""Tables written to the shared folder of the cluster: they cut lineage and
survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local session may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    folder = spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="themeloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextmanager
def session_setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Scratch:
    """The tables of one run, all below one new folder."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.run = uuid.uuid4().hex
        self.root = f"{shared_folder(spark)}/themeloom-{self.run}"
        self._tables: set[str] = set()

    def keep(self, rows: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        """Write rows as Parquet and read them back."""
        path = f"{self.root}/{name}"
        rows.write.mode("overwrite").parquet(path, compression=compression)
        return self.spark.read.schema(rows.schema).parquet(path)

    def keep_bucketed(
        self, rows: DataFrame, name: str, buckets: int, columns: Sequence[str], compression: str = "zstd"
    ) -> DataFrame:
        """Write rows that are hash-partitioned by ``columns`` as a bucketed table.

        Each task holds one bucket and writes it through one open file, so no
        sort by bucket is needed; later scans keep the partitioning.
        """
        table = f"themeloom_{self.run}_{name}"
        most = str(max(buckets, 100_000))
        with (
            session_setting(self.spark, "spark.sql.maxConcurrentOutputFileWriters", "4"),
            session_setting(self.spark, "spark.sql.sources.bucketing.maxBuckets", most),
        ):
            (
                rows.write.format("parquet")
                .mode("overwrite")
                .bucketBy(buckets, *columns)
                .option("path", f"{self.root}/{name}")
                .option("compression", compression)
                .saveAsTable(table)
            )
        self._tables.add(name)
        return self.spark.table(table)

    def keep_routes(self, state: DataFrame, name: str, key: str) -> DataFrame:
        """(key, bucket): the buckets that hold a key, bucketed by the key."""
        held = state.groupBy("bucket", key).agg(F.lit(0).alias("_")).select(key, "bucket")
        return self._keep_by(held, name, key)

    def keep_pairs(self, held: DataFrame, name: str, key: str) -> DataFrame:
        """``keep_routes`` of pairs (bucket, key), some of which come several times."""
        return self._keep_by(held.select(key, "bucket"), name, key, distinct=True)

    def _keep_by(self, held: DataFrame, name: str, key: str, distinct: bool = False) -> DataFrame:
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = held.repartition(parts, key)
        return self.keep_bucketed(dealt.distinct() if distinct else dealt, name, parts, [key])

    def drop(self, name: str) -> None:
        """Forget a table and delete its files."""
        if name in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS themeloom_{self.run}_{name}")
            self._tables.discard(name)
        self._delete(f"{self.root}/{name}")

    def release(self) -> None:
        """Delete everything this run wrote."""
        for name in list(self._tables):
            self.drop(name)
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        context = self.spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
