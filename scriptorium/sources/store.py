"""Tables that are made once and kept in the shared folder: written under a name that depends on what they were made from, and found again there."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Only in local mode, where it may be unset, a new one."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if folder is None:
            if sc.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir names no folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(folder)
    return folder or sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back, so that what it took is not done again, whatever executors are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fingerprint(df: DataFrame) -> str:
    """Of the files that df reads: paths, sizes, times of change and rows. A frame that is not read from files, or no longer tells from which, is like no other."""
    try:
        known = bool(df.inputFiles()) and df.select("_metadata.file_path") is not None
    except AnalysisException:
        known = False
    if not known:
        return uuid.uuid4().hex
    told = df.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time"), F.lit(1 << 31))).alias("files")).first()
    return f"{told['n']}-{told['files']}"


def stored(spark: SparkSession, name: str, told: str, make: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The tables that make() gives, read from the shared folder; made and written only if no earlier call did so under the same name and `told`, which
    says what they are made from (`fingerprint`) and how.

    They are written under a name of their own and moved to their place when complete, so that a lost driver leaves nothing half done, and of two
    writers one wins.
    """
    folder = f"{shared_folder(spark)}/stored/{name}-{hashlib.sha256(told.encode()).hexdigest()[:24]}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path(folder)):
        fresh = f"{folder}-{uuid.uuid4().hex}"
        for table, df in make().items():
            df.write.parquet(f"{fresh}/{table}")
        if not files.rename(path(fresh), path(folder)) or files.exists(path(folder, path(fresh).getName())):
            files.delete(path(folder, path(fresh).getName()), True)  # another writer was first
            files.delete(path(fresh), True)
    return {path(str(p.getPath())).getName(): spark.read.parquet(str(p.getPath())) for p in files.listStatus(path(folder))}
