"""Tables written to the folder that driver and executors share.

A written table cuts lineage and survives the loss of any executor; localCheckpoint does not.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: dict[int, tuple[SparkSession, str, DataFrame]] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset and driver and executors are one process (tests), a
    temporary folder that is then set. A cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='trigrid-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/trigrid-scratch/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")  # once the table is written nobody reads this write's shuffles again
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = (spark, path, out)
    return out


def drop(table: DataFrame) -> None:
    """Delete a table that materialise() gave, once nothing will read it any more."""
    spark, path, _ = _written.pop(id(table))
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(docs: DataFrame) -> None:
    """Delete all tables that materialise() gave but those that docs reads."""
    read = docs.inputFiles()
    for _, path, table in list(_written.values()):
        if not any(path.rpartition("/")[2] in f for f in read):
            drop(table)


@atexit.register
def _sweep() -> None:
    for _, _, table in list(_written.values()):
        with contextlib.suppress(Exception):  # the session may be gone; the folder is the cluster's to sweep then
            drop(table)


#: Rows an Arrow batch may have where whole texts go to Python workers.
ROWS_PER_BATCH = 1000


def lean(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, for workers that hold whole texts; a smaller bound stays. Spark reads
    the bound when a plan runs, which is after the operator has returned, so it holds from here on."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names, whatever their case: an input column named like an output gives way."""
    lost = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in lost])
