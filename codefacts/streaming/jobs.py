"""Streaming jobs (K1-K6). State is a table that batches replace by partition, or a watermarked aggregate.

Every ``foreachBatch`` body may be replayed after a failure, so each of them gives the same table when run twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codefacts.operators import churn as ch
from codefacts.operators import facts as fx
from codefacts.operators import matching as mt
from codefacts.session import ensure_checkpoint_dir, materialize
from codefacts.streaming.levels import Levels

#: K6: results are at most this old while a query runs
FRESHNESS = "15 seconds"


def read_stream(spark: SparkSession, path: str, schema, glob: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """A directory of parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def table_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """One table as a stream, be it a parquet file or a folder of them.

    The last letter is written as a pattern: a plain path is taken as the base folder of partitions, which a file cannot be.
    """
    path = path.rstrip("/")
    return read_stream(spark, f"{path[:-1]}[{path[-1]}]", schema)


def start(writer, checkpoint: str, available_now: bool = False, freshness: str = FRESHNESS) -> StreamingQuery:
    """K6: run continuously with the freshness interval, or once over what is there."""
    trigger = {"availableNow": True} if available_now else {"processingTime": freshness}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


# ------------------------------------------------------------------ churn
def daily_churn(changes: DataFrame, lateness: str = "7 days") -> DataFrame:
    """K1: per file and day, change count and lines; one state row per file and open day.

    As a stream it leaves out rows later than ``lateness`` once later batches have passed them; ``write_partials`` does not.
    The sliding window over these rows is ``operators.churn.rolling_churn`` on the result: a 90-day window sliding by one
    day would keep and emit ninety rows per change.
    """
    marked = changes.withWatermark("ts", lateness)
    agg = marked.groupBy("repo", "path", F.window("ts", "1 day")).agg(
        F.count("*").alias("n"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted")
    )
    return agg.select("repo", "path", F.to_date("window.start").alias("day"), "n", "added", "deleted")


def sliding_churn(changes: DataFrame, days: int = 90, lateness: str = "7 days") -> DataFrame:
    """K1: the direct form, for few files and consumers that want every window as it closes; late rows as in ``daily_churn``."""
    marked = changes.withWatermark("ts", lateness)
    agg = marked.groupBy("repo", "path", F.window("ts", f"{days} days", "1 day")).agg(F.count("*").alias("churn"), F.sum("added").alias("added_lines"))
    return agg.select("repo", "path", F.date_sub(F.to_date("window.end"), 1).alias("day"), "churn", "added_lines")


def partials(spark: SparkSession, path: str, keys: Sequence[str] = ("repo", "path", "day")) -> Levels:
    """K1: the sums of batches as levelled runs, in folders by month: per key and run one row."""

    def combine(rows: DataFrame) -> DataFrame:
        values = [c for c in rows.columns if c not in (*keys, "month")]
        return rows.groupBy(*keys, "month").agg(*[F.sum(c).alias(c) for c in values]).select(*rows.columns)

    return Levels(spark, path, combine, partition_by=("month",))


def write_partials(changes: DataFrame, aggregate, path: str, checkpoint: str, available_now: bool = False, keys: Sequence[str] = ("repo", "path", "day")) -> StreamingQuery:
    """K1: the sums of each batch, whatever its days; no watermark, no state, and no change is too late.

    ``aggregate``: ``daily_churn`` or ``sliding_churn``, whose values are sums (their watermark has no effect on the rows of
    one batch). Batches are folded by level, so their number bounds neither folders nor reads. ``partials_state`` adds up
    what is left.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        rows = aggregate(batch).withColumn("month", F.date_format("day", "yyyy-MM"))
        partials(batch.sparkSession, path, keys).add(rows, batch_id)

    return start(changes.writeStream.foreachBatch(save), checkpoint, available_now)


def partials_state(spark: SparkSession, path: str, keys: Sequence[str], months: Sequence[str] | None = None) -> DataFrame:
    """The sums over all batches of ``write_partials``; of some months (``2024-05``) only their folders are read."""
    log = partials(spark, path, keys).read()
    if log is None:
        raise ValueError(f"no batch has been written to {path}")
    log = log if months is None else log.where(F.col("month").isin(*months))
    return log.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in log.columns if c not in (*keys, "month")])


def write_changelog(updates: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Keep the updates of an aggregate as a changelog with the batch that wrote them; a replayed batch replaces itself."""

    def save(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return start(updates.writeStream.outputMode("update").foreachBatch(save), checkpoint, available_now)


def changelog_state(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The current rows of a changelog: per key the one of the latest batch."""
    log = spark.read.parquet(path)
    values = [c for c in log.columns if c not in (*keys, "batch_id")]
    latest = log.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v"))
    return latest.select(*keys, "v.*")


def replace_days(rewritten: DataFrame, changes: DataFrame, daily_path: str) -> None:
    """K2: history was rewritten: recompute the (repo, month) partitions it touches from the current change table.

    Months keep the number of files low; the rows inside stay daily. A month that has no change left is replaced by a
    marker row, because a partition without rows would not be replaced.
    """
    month = F.to_date(F.date_trunc("month", "ts"))
    touched = materialize(rewritten.select("repo", month.alias("month")).distinct())
    span = touched.agg(F.min("month").alias("first"), F.add_months(F.max("month"), 1).alias("end")).first()
    if span.first is None:
        return
    # the range of the touched months reaches the scan of the change table, so others are not read
    changes = changes.where((F.col("ts") >= F.lit(span.first).cast("timestamp")) & (F.col("ts") < F.lit(span.end).cast("timestamp")))
    current = changes.withColumn("month", month).join(touched, ["repo", "month"], "left_semi")
    fresh = ch.churn_daily(current.drop("month")).withColumn("month", F.to_date(F.date_trunc("month", "day")))
    gone = touched.join(fresh.select("repo", "month").distinct(), ["repo", "month"], "left_anti")
    zero = F.lit(0).cast("long")
    marker = gone.select("repo", F.lit(None).cast("string").alias("path"), F.col("month").alias("day"), zero.alias("n"), zero.alias("added"), zero.alias("deleted"), "month")
    rows = fresh.unionByName(marker)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo", "month").parquet(daily_path)


def read_daily(spark: SparkSession, daily_path: str) -> DataFrame:
    """Daily rows without the markers of emptied months."""
    return spark.read.parquet(daily_path).where("path is not null").drop("month")


def watch_rewrites(rewrites: DataFrame, changes_path: str, daily_path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """K2: a stream of retracted changes drives ``replace_days``."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        replace_days(batch, batch.sparkSession.read.parquet(changes_path), daily_path)

    return start(rewrites.writeStream.foreachBatch(apply), checkpoint, available_now)


# ------------------------------------------------------------------ facts
def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


FACT_KEYS = ["repo", "path", "code_hash"]
#: folders of a run of facts, by hash of the file; bytes of keys of a batch that are sent to every task
FACT_BUCKETS, SENT = 16, 16 << 20


def _same(left: str, right: str) -> Column:
    """Null-safe equality of the keys of two sides whose columns begin with ``left`` and ``right``."""
    out = F.lit(True)
    for k in FACT_KEYS:
        out = out & F.col(f"{left}{k}").eqNullSafe(F.col(f"{right}{k}"))
    return out


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(k).alias(f"{prefix}{k}") for k in FACT_KEYS])


def _bucket() -> Column:
    return F.pmod(F.xxhash64("repo", "path"), F.lit(FACT_BUCKETS)).cast("int").alias("bucket")


def fact_runs(spark: SparkSession, path: str) -> Levels:
    """K3: the facts of all contents that were parsed, in folders by hash of the file."""
    return Levels(spark, f"{path.rstrip('/')}/facts", lambda rows: rows, partition_by=("bucket",))


def version_runs(spark: SparkSession, path: str) -> Levels:
    """K3: repo, path, ts, code_hash and deleted of all versions that came."""
    return Levels(spark, f"{path.rstrip('/')}/versions", lambda rows: rows.distinct())


def extract_continuously(files: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """K3: parse only contents that are new for their path and keep their facts; needs ``ts``, the version of a file.

    A row with a true ``deleted`` (a column that may be missing) says that the file was deleted at ``ts``. Versions are kept
    beside the facts and joined by ``read_versions``, so contents may come late, in any order and again (A, B, A). Only keys
    are moved: those of a batch are sent to the stored keys, in the folders they fall into, and what is not there is sent to
    the batch's own rows, which are parsed where they lie. Both tables are levelled, so a replayed batch changes nothing.
    """

    def parse(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        facts, versions = fact_runs(spark, path), version_runs(spark, path)
        deleted = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in batch.columns else F.lit(False)
        keyed = batch.withColumn("code_hash", F.when(~deleted, fx.content_key("content")))
        arrived = materialize(keyed.select(*FACT_KEYS, "ts", deleted.alias("deleted")).distinct())
        if not facts.covers(batch_id):
            wanted = arrived.where(~F.col("deleted")).select(*FACT_KEYS).distinct().withColumn("bucket", _bucket())
            stored = facts.read()
            if stored is not None:
                wanted = materialize(wanted)
                touched = [r.bucket for r in wanted.select("bucket").distinct().collect()]  # FACT_BUCKETS numbers at most
                keys = stored.where(F.col("bucket").isin(touched))
                known = materialize(_prefixed(keys, "old_").join(_sent(_prefixed(wanted, "new_")), _same("old_", "new_"), "left_semi"))
                wanted = wanted.join(_sent(known), _same("", "old_"), "left_anti")
            wanted = materialize(wanted)
            new = keyed.where(~deleted).join(_sent(_prefixed(wanted, "new_")), _same("", "new_"), "left_semi")
            # a content that a batch holds several times is parsed where it lies, and its facts are dealt out instead
            facts.add(fx.extract_facts(new).dropDuplicates(FACT_KEYS).withColumn("bucket", _bucket()), batch_id)
        versions.add(arrived, batch_id)

    return start(files.writeStream.foreachBatch(parse), checkpoint, available_now)


def _sent(keys: DataFrame) -> DataFrame:
    """Keys that are sent to every task, if they are small enough; else the join deals them out.

    That is said by a hint: of tables that pack well, or whose other columns are wide, sizes are guessed far too small.
    """
    size = keys.agg(F.sum(sum((F.octet_length(F.coalesce(c, F.lit(""))) for c in keys.columns), F.lit(48)))).first()[0] or 0
    return F.broadcast(keys) if size <= SENT else keys.hint("merge")


def _all_versions(spark: SparkSession, path: str) -> DataFrame:
    seen = version_runs(spark, path).read()
    if seen is None:
        raise ValueError(f"no batch has been written to {path}")
    return seen


def _with_facts(spark: SparkSession, path: str, versions: DataFrame) -> DataFrame:
    facts = fact_runs(spark, path).read().drop("bucket").withColumnsRenamed({k: f"f_{k}" for k in FACT_KEYS})
    return versions.join(facts.hint("merge"), _same("", "f_")).drop(*[f"f_{k}" for k in FACT_KEYS])


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """K3: the facts of every version (repo, path, ts) of a file; versions in a row with the same content are one, the first."""
    # of a content and a deletion at the same time, the deletion is later
    order = Window.partitionBy("repo", "path").orderBy("ts", "deleted", "code_hash")
    rows = _all_versions(spark, path).distinct().withColumn("before", F.lag(F.struct("code_hash")).over(order))
    changed = rows.where(F.col("before").isNull() | ~F.col("code_hash").eqNullSafe(F.col("before.code_hash")))
    return _with_facts(spark, path, changed.where(~F.col("deleted")).select(*FACT_KEYS, "ts"))


def _current(spark: SparkSession, path: str) -> DataFrame:
    """The last version of each file that is there."""
    last = _all_versions(spark, path).groupBy("repo", "path").agg(F.max(F.struct("ts", "deleted", "code_hash")).alias("v"))
    return last.where(~F.col("v.deleted")).select("repo", "path", "v.code_hash", "v.ts")


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """K3: the facts of the latest version of each file; files whose latest version is a deletion are not there."""
    return _with_facts(spark, path, _current(spark, path).select(*FACT_KEYS, "ts"))


def evict(spark: SparkSession, path: str) -> None:
    """K3: facts of contents that no file has any more leave the store, and so do the versions that had them.

    What is left answers ``read_current`` as before; a deletion stays as a version, so an older content that comes late
    cannot bring a file back. A content that comes again is parsed again.
    """
    current = materialize(_current(spark, path))
    live = _sent(_prefixed(current, "live_"))
    fact_runs(spark, path).rewrite(lambda rows: rows.join(live, _same("", "live_"), "left_semi"))
    last = lambda rows: rows.groupBy("repo", "path").agg(F.max(F.struct("ts", "deleted", "code_hash")).alias("v"))
    version_runs(spark, path).rewrite(lambda rows: last(rows).select("repo", "path", "v.code_hash", "v.ts", "v.deleted"))


def merge_latest(batch: DataFrame, path: str, buckets: int = 64) -> None:
    """K4: last version of each file wins, deleted files leave; only the touched buckets are rewritten.

    ``batch``: repo, path, version, deleted and any other columns. A repository with a third of all files still spreads
    over all buckets. Deleted files stay as markers, so an older version that arrives late cannot bring them back.
    """
    spark = batch.sparkSession
    rows = batch.withColumn("bucket", F.pmod(F.xxhash64("repo", "path"), F.lit(buckets)).cast("int"))
    if _exists(spark, path):
        stored = spark.read.schema(rows.schema).parquet(path)
        rows = rows.unionByName(stored.join(rows.select("bucket").distinct(), "bucket", "left_semi"))
    values = [c for c in rows.columns if c not in ("repo", "path", "bucket")]
    newest = F.max_by(F.struct(*values), F.struct("version", "deleted")).alias("v")
    latest = rows.groupBy("bucket", "repo", "path").agg(newest).select("repo", "path", "v.*", "bucket")
    merged = materialize(latest)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """K4: the files that exist now."""
    return spark.read.parquet(path).where("not deleted").drop("bucket", "deleted")


def track_latest(versions: DataFrame, path: str, checkpoint: str, buckets: int = 64, available_now: bool = False) -> StreamingQuery:
    """K4: a stream of file versions and deletions kept as a table of latest states."""
    return start(versions.writeStream.foreachBatch(lambda batch, _: merge_latest(batch, path, buckets)), checkpoint, available_now)


# ------------------------------------------------------------------ rules
def continuous_rules(files: DataFrame, rules: tuple[mt.LineRule, ...] = mt.BUILTIN_LINE_RULES) -> DataFrame:
    """K5: rule hits of arriving files: no state, append only, the same expressions as in batch."""
    return mt.line_rule_hits(files, rules)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append a stateless stream to a parquet table."""
    return start(stream.writeStream.outputMode("append").format("parquet").option("path", path), checkpoint, available_now)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for one run below the shared checkpoint folder."""
    import uuid

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
