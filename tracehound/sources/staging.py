"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Where none is set, a folder of our own, but on a single machine only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tracehound-"))
    return sc.getCheckpointDir()


#: Rows of a few numbers for which a task of their own is worth while, the fewest tasks, and the most rows of a table that
#: counts as small.
TASK_ROWS, LEAST_TASKS, SMALL = 100_000, 8, 1_000_000


def staged(df: DataFrame, label: str, rows: int | None = None, by: str | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again.

    This cuts the lineage: what follows depends on files that outlive any executor, and work that several branches
    need is done once. Where the number of rows is known to be at most `rows`, and these are few, the last stage has no
    more tasks than they are worth, whatever the number of shuffle partitions is; it should have no sort-merge join, as
    a task holds the sorted pages of all the partitions it takes. With `by`, a filter on that string column reads its
    own files only.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    if rows is not None and rows <= SMALL:
        df = df.coalesce(max(LEAST_TASKS, -(-rows // TASK_ROWS)))
    (df.write if by is None else df.write.partitionBy(by)).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def near(df: DataFrame, rows: int) -> DataFrame:
    """df, sent to every task in a join if it has no more rows than a small table; beyond that the join shuffles."""
    return F.broadcast(df) if rows <= SMALL else df


def discard(*tables: DataFrame | None) -> None:
    """Deletes staged tables. Only for those whose every reader has been staged itself: nothing can make them anew."""
    for df in tables:
        if df is not None:
            path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_path)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table's files up to which its rows may be dealt out anew.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """df as it is read, or dealt to all cores where its files are small and make fewer tasks than there are cores: for work
    that takes long for each row. Larger tables are many tasks by themselves and are not moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SPREAD_BYTES and df._jdf.rdd().getNumPartitions() < cores else df
