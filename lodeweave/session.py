"""Session helpers: checkpoint folder, size-checked broadcasts, table reading."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimated size, in bytes, of a side that may be broadcast.
BROADCAST_BYTES = 8 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of ``df``; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast if its estimated size is under ``max_bytes``.

    Beyond the bound it is returned as it is, so that the join shuffles."""
    return F.broadcast(df) if estimated_bytes(df) <= max_bytes else df


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a local relation: its size is known to the optimizer, and no
    Python worker is needed to read it."""
    import pyarrow as pa

    names = [f.split()[0] for f in schema.split(",")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    columns = [pa.array([r[i] for r in rows], kinds[f.split()[1]]) for i, f in enumerate(schema.split(","))]
    return spark.createDataFrame(pa.table(columns, names=names))


def spread(scan: DataFrame) -> DataFrame:
    """A table scan with at least one partition per core, for work that costs more than moving
    the rows. Large tables have more file splits than cores and are left as they are. For
    scans only: anything with a shuffle in it would be run to count its partitions."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.queryExecution().toRdd().getNumPartitions() < cores else scan


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of ``spark.checkpoint.dir``. Where none is set, a local session, as in
    tests, takes a temporary folder; on a cluster, whose machines share no such folder, a
    ValueError is raised."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodeweave-"))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
