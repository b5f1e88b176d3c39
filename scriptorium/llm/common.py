"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only in local mode, where it may be unset, a new one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if sc.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir names no folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back from there, so that a lost executor costs no recomputation. Keeps partitions and order of rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Intermediate tables of one job: compressed files in the shared folder, deleted as soon as nothing needs them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.made = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", {}

    def table(self, df: DataFrame) -> DataFrame:
        """df, written and read back; order and partitions may change."""
        path = f"{self.folder}/{len(self.made)}"
        df.write.parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.made[id(found)] = (found, path)  # holds the frame, so that its id stays its own
        return found

    def drop(self, *tables: DataFrame | None) -> None:
        """Deletes tables of this scratch folder; anything else is left alone."""
        for df in tables:
            path = self.made.get(id(df), (None, None))[1]
            if path is not None:
                place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
