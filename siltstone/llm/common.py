"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the tokenizer that the contracts name.
TOKENIZER = "word_bpe_49k.json"

#: Fixed value: separators of words, as in ``[^\x20\x09-\x0D]+``.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the installed vocabulary file is (the same place on every executor)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds by bytes, so long texts don't pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1200")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is configured (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and outlives any executor."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Remove a table that ``materialize`` has written, once nothing reads it any more."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name).getParent()
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Rows of a few short columns that may be broadcast; a side that turns out larger is shuffled.
BROADCAST_ROWS = 100_000


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcast if its rows are counted and few."""
    return F.broadcast(df) if df.count() <= rows else df


def with_global_rank(df: DataFrame, order: list[str], per: str, rank: str = "_rank") -> DataFrame:
    """Number the rows of each value of ``per`` from 0 in the given order, without one task per value.

    ``order`` starts with ``per``. Rows are range-sorted (ties in ``per`` are split
    over partitions by the further columns), numbered within their partition, and
    shifted by the rows that earlier partitions hold of the same value. The table of
    shifts has at most partitions + values rows. The result is materialized, as the
    numbers must not be computed twice from different partitions.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_m", F.monotonically_increasing_id())
    )
    numbered = materialize(numbered, "ranked").withColumn("_p", F.shiftright("_m", 33))
    runs = numbered.groupBy("_p", per).agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    from pyspark.sql import Window

    before = Window.partitionBy(per).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
    return numbered.join(runs.select("_p", per, "_shift"), ["_p", per]).withColumn(rank, F.col("_m") + F.col("_shift")).drop("_m", "_p", "_shift")


class Recent(dict):
    """A bounded cache of two generations, each value made when it is first asked for.

    When the young one is full it becomes the old one, whose entries come back when they are asked
    for; so frequent keys stay, and at most ``2 * most`` (and one text's) are held.
    """

    def __init__(self, make, most: int) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        out = self.old.pop(key, None)
        if out is None:
            out = self.make(key)
        self[key] = out
        return out

    def age(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
