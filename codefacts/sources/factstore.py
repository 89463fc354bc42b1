"""A keyed store of facts (E19): one row for each file that is there, bucketed by (repo, path).

A run compares the listing of the files with the keys of the store. The store is bucketed, so only the listing is dealt out, and
the keys are read without the facts beside them. Contents are looked at last, only of files whose signature is new, and where they
lie: the keys to look at are sent to the files if their size allows it, and no text is ever shuffled. A new version of the store is
written beside the old one; a version counts once its writer has finished.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.operators import facts as fx
from codefacts.session import materialize

KEY = ["repo", "path"]
SIGNATURE = ["mtime", "size"]
#: buckets of a new store
BUCKETS = 64
#: bytes of keys that are sent to the files
SENT = 64 << 20


def _versions(spark: SparkSession, folder: str) -> list[tuple[int, int, str]]:
    """(version, buckets, path) of the finished versions, oldest first."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for status in store.listStatus(root) if store.exists(root) else []:
        name = status.getPath().getName()
        number, _, buckets = name.removeprefix("v").partition("-b")
        done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("v") and number.isdigit() and buckets.isdigit() and store.exists(done):
            out.append((int(number), int(buckets), f"{folder.rstrip('/')}/{name}"))
    return sorted(out)


def _has_rows(spark: SparkSession, path: str) -> bool:
    """A bucketed table without rows has no files, so its schema is not known to another session."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return any(s.getPath().getName().startswith("part-") for s in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder))


def _table(path: str) -> str:
    return f"codefacts_facts_{hashlib.md5(path.encode()).hexdigest()}"


def load(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest version of a store, null if there is none or nothing in it: facts with ``mtime`` and ``size``, known to be bucketed by (repo, path)."""
    versions = _versions(spark, folder)
    if not versions:
        return None
    _, buckets, path = versions[-1]
    name = _table(path)
    if not spark.catalog.tableExists(name):
        if not _has_rows(spark, path):
            return None
        columns = spark.read.parquet(path)._jdf.schema().toDDL()
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (path '{path}') CLUSTERED BY (repo, path) SORTED BY (repo, path) INTO {buckets} BUCKETS")
    return spark.table(name)


def save(rows: DataFrame, folder: str, buckets: int = BUCKETS) -> DataFrame:
    """Writes the next version of a store; rows that already lie in buckets stay in their tasks."""
    spark = rows.sparkSession
    versions = _versions(spark, folder)
    path = f"{folder.rstrip('/')}/v{(versions[-1][0] + 1 if versions else 0):06}-b{buckets}"
    rows.write.format("parquet").mode("overwrite").option("path", path).bucketBy(buckets, *KEY).sortBy(*KEY).saveAsTable(_table(path))
    return spark.table(_table(path))


def judge(listing: DataFrame, known: DataFrame) -> DataFrame:
    """repo, path, mtime, size, old_hash and state of every file of either side: ``keep``, ``look`` (new or changed) or ``gone``."""
    now = listing.select(*KEY, *SIGNATURE, F.lit(True).alias("here"))
    old = known.select(*KEY, *[F.col(c).alias(f"old_{c}") for c in SIGNATURE], F.col("code_hash").alias("old_hash"))
    both = now.join(old, KEY, "full_outer")
    same = F.coalesce((F.col("mtime") == F.col("old_mtime")) & (F.col("size") == F.col("old_size")), F.lit(False))
    state = F.when(F.col("here").isNull(), "gone").when(same, "keep").otherwise("look")
    return both.select(*KEY, *SIGNATURE, "old_hash", state.alias("state"))


def refresh(files: DataFrame, folder: str, buckets: int = BUCKETS, sent: int = SENT) -> DataFrame:
    """The facts of the files (repo, path, mtime, size, content) as they are now; only new contents are parsed.

    Facts of deleted files leave. A file whose content is the same under a new signature keeps its facts and gets the
    signature. If so much is new that its keys cannot be sent, every file is parsed where it lies.
    """
    spark = files.sparkSession
    old = load(spark, folder)
    if old is None:
        return save(fx.extract_facts(files, SIGNATURE), folder, buckets)
    sources = files.where(fx.is_parsed("path"))
    state = materialize(judge(sources, old))
    look = state.where("state = 'look'").select(*KEY, "old_hash")
    size = look.agg(F.sum(F.octet_length("repo") + F.octet_length("path") + 64)).first()[0] or 0
    if size <= sent:
        met = sources.join(F.broadcast(look), KEY).where(~fx.content_key("content").eqNullSafe(F.col("old_hash")))
    else:
        met = sources
    fresh = materialize(fx.extract_facts(met, SIGNATURE))
    stay = state.where("state <> 'gone'").select(*KEY, *SIGNATURE).join(fresh.select(*KEY), KEY, "left_anti")
    kept = old.drop(*SIGNATURE).join(stay, KEY)
    return save(kept.unionByName(fresh), folder, _versions(spark, folder)[-1][1])  # buckets stay as they were
