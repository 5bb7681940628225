"""What a session must offer: table reading, and a place where lineage is cut."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key of more rows than this is joined by broadcasting its row of the other side; there are at most rows / HOT such keys.
HOT = 100_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session. Where it names none, a temporary one, but only if all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "stellate-checkpoint")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage of df by a reliable checkpoint, which survives the loss of executors."""
    spark = df.sparkSession
    sc = spark.sparkContext
    folder = checkpoint_dir(spark)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    """Partitions that keep all cores busy without making a task too small."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(scan: DataFrame) -> DataFrame:
    """A scan for work that costs far more than reading: in as many parts as there are cores, if the files give fewer."""
    spark = scan.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return scan.repartition(2 * cores) if scan._jdf.queryExecution().toRdd().getNumPartitions() < cores else scan


def join_counted(rows: DataFrame, keys: DataFrame, on: list[str], count: str, hot: int = HOT) -> DataFrame:
    """An inner join with one row for each key, whose column count says how many rows it has: hot keys stay where they are."""
    many = F.broadcast(keys.where(F.col(count) > hot))
    rest = rows.join(many.select(*on), on, "left_anti").join(keys.where(F.col(count) <= hot), on)
    return rows.join(many, on).unionByName(rest)
