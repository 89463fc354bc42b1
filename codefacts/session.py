"""Session helpers: settings the operators rely on, and lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that matter at corpus scale. All of them are session-level, so a cluster may override any.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # source files travel to the parser in Arrow batches; bound a batch by bytes, not only by rows
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
}


def local_session(app: str = "codefacts", cpus: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, bring your own session."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in {**RECOMMENDED_CONF, "spark.ui.enabled": "false", **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``; make one up only for a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master == "local" or sc.master.startswith("local["):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="codefacts-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result of one iteration is on shared storage before the next one starts."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, true_size: bool = False) -> DataFrame:
    """Write a table that several consumers read to the shared folder and read it back.

    Unlike a checkpoint the result is columnar, so each consumer still reads only the columns it needs. The optimizer takes the size
    of the files for that of the rows; keys pack to a tenth of it, so with ``true_size`` (for narrow tables that are joined) they
    are written unpacked, and a side is sent through the driver only if its rows are as small as its files.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/tables/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "none").option("parquet.enable.dictionary", "false") if true_size else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def grow(seen: DataFrame, fresh: DataFrame, round_: int) -> DataFrame:
    """Add the rows of one iteration to the visited set; the union is compacted now and then so plans stay short."""
    both = seen.unionByName(fresh)
    return cut_lineage(both) if round_ % 16 == 0 else both
