"""Streaming queries, run once over what is there (``availableNow``) and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from codefacts.operators import churn as ch
from codefacts.plans import adapters as ad
from codefacts.plans import sql_text as st
from codefacts.plans.catalog_matching import PROSE_RULES
from codefacts.plans.registry import query
from codefacts.streaming import jobs

_EV = """with e as (select event_type as repo, 'u' || user_id || '.py' as path, ts::date as day, floor(value)::int as added from events),
d as (select repo, path, day, count(*) as n, sum(added)::bigint as added from e group by all)
"""


def _change_stream(spark, sf):
    schema = ad.table(spark, sf, "events").schema
    ev = jobs.table_stream(spark, f"{sf.rstrip('/')}/events.parquet", schema)
    return ev.select(
        F.col("event_type").alias("repo"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".py")).alias("path"),
        F.col("ts").cast("timestamp").alias("ts"), F.floor("value").cast("int").alias("added"), F.lit(0).alias("deleted"),
    )


def _daily(spark, sf):
    out = jobs.scratch(spark, "daily")
    jobs.write_partials(_change_stream(spark, sf), jobs.daily_churn, out, jobs.scratch(spark, "ck"), available_now=True).awaitTermination()
    return jobs.partials_state(spark, out, ["repo", "path", "day"])


@query("stream_daily_churn", "K1 K6", _EV + "select repo, path, day, n, added from d")
def stream_daily_churn(spark, sf):
    return _daily(spark, sf).select("repo", "path", "day", "n", "added")


@query(
    "stream_rolling_churn",
    "K1 F7",
    _EV + """select repo, path, day, sum(n) over w::bigint as churn, sum(added) over w::bigint as added_lines from d
    window w as (partition by repo, path order by day range between interval 6 days preceding and current row)""",
)
def stream_rolling_churn(spark, sf):
    return ch.rolling_churn(_daily(spark, sf), days=7)


@query(
    "stream_sliding_churn",
    "K1",
    _EV + """select repo, path, (e.day + o::int)::date as day, count(*) as churn, sum(added)::bigint as added_lines from e, range(3) r(o) group by all""",
)
def stream_sliding_churn(spark, sf):
    out = jobs.scratch(spark, "sliding")
    sliding = lambda batch: jobs.sliding_churn(batch, days=3)
    jobs.write_partials(_change_stream(spark, sf), sliding, out, jobs.scratch(spark, "ck"), available_now=True).awaitTermination()
    return jobs.partials_state(spark, out, ["repo", "path", "day"])


@query(
    "stream_rule_hits",
    "K5",
    f"""with l as (select source as repo, text, unnest(ls) as line, generate_subscripts(ls, 1) as line_no, {ad.DOC_PATH_SQL} as path from (select *, {st.split_lines('text')} as ls from documents))
    select repo, path, line_no, 'KEY' as rule_id from l where regexp_matches(line, '(?i)(api[_-]?key|secret|token|password)') and not regexp_matches(line, '(?i)example') and {st.strip('line')} not like '#%'""",
)
def stream_rule_hits(spark, sf):
    schema = ad.table(spark, sf, "documents").schema
    docs = jobs.table_stream(spark, f"{sf.rstrip('/')}/documents.parquet", schema)
    files = docs.select(F.col("source").alias("repo"), ad.doc_path().alias("path"), F.col("text").alias("content"))
    out = jobs.scratch(spark, "hits")
    hits = jobs.continuous_rules(files, tuple(r for r in PROSE_RULES if r.rule_id == "KEY"))
    jobs.run_to_table(hits, out, jobs.scratch(spark, "ck"), available_now=True).awaitTermination()
    return spark.read.schema(hits.schema).parquet(out).select("repo", "path", "line_no", "rule_id")


@query(
    "stream_latest_files",
    "K4",
    """with v as (select l_returnflag as repo, 'p' || l_partkey as path, l_orderkey * 10 + l_linenumber as version, l_discount > 0.09 as deleted, l_suppkey from lineitem),
    m as (select repo, path, max_by(struct_pack(d := deleted, s := l_suppkey), (version, deleted, l_suppkey)) as x, max(version) as version from v group by all)
    select repo, path, version from m where not x.d""",
)
def stream_latest_files(spark, sf):
    schema = ad.table(spark, sf, "lineitem").schema
    lines = jobs.table_stream(spark, f"{sf.rstrip('/')}/lineitem.parquet", schema)
    versions = lines.select(
        F.col("l_returnflag").alias("repo"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("version"), (F.col("l_discount") > 0.09).alias("deleted"),
    )
    out = jobs.scratch(spark, "latest")
    jobs.track_latest(versions, out, jobs.scratch(spark, "ck"), buckets=8, available_now=True).awaitTermination()
    return jobs.read_latest(spark, out).select("repo", "path", "version")


@query(
    "stream_python_facts",
    "K3",
    why_no_oracle="parses source text; checked against the batch facts job in the tests",
)
def stream_python_facts(spark, sf):
    """Documents as file versions in upload order; contents that repeat for a path are parsed once."""
    schema = ad.table(spark, sf, "documents").schema
    docs = jobs.table_stream(spark, f"{sf.rstrip('/')}/documents.parquet", schema)
    files = docs.select(
        F.col("source").alias("repo"), F.concat(F.lit("en/doc_"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
        F.col("text").alias("content"), F.timestamp_seconds(F.col("doc_id") + 86400).alias("ts"),
    )
    out = jobs.scratch(spark, "facts")
    jobs.extract_continuously(files, out, jobs.scratch(spark, "ck"), available_now=True).awaitTermination()
    return jobs.read_versions(spark, out).select("repo", "path", "ok", "loc_total", "loc_code")


_SOURCE_VERSIONS = """with v as (select l_returnflag as repo, 'p' || l_partkey || '.py' as path, l_orderkey * 10 + l_linenumber as ts, l_discount > 0.085 as deleted,
  case l_quantity::int % 3 when 0 then 'a = 1' || chr(10) when 1 then 'b = 1' || chr(10) || 'c = 2' || chr(10) else 'def (' end as content from lineitem),
  m as (select repo, path, max((ts, deleted, case when deleted then null else substr(sha1(content), 1, 12) end, case when deleted then null else content end)) as x from v group by all)
"""


@query(
    "stream_current_facts",
    "K3",
    _SOURCE_VERSIONS + "select repo, path, x[1] as version, x[4] not like 'def%' as ok, case when x[4] like 'b%' then 2 else 1 end as loc_total, x[3] as code_hash from m where not x[2]",
)
def stream_current_facts(spark, sf):
    """File versions in four batches whose times go back and forth; contents come again, files are deleted and come back, facts are evicted."""
    lines = ad.table(spark, sf, "lineitem")
    kind = F.col("l_quantity").cast("int") % 3
    versions = lines.select(
        F.col("l_returnflag").alias("repo"), F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit(".py")).alias("path"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ts"), (F.col("l_discount") > 0.085).alias("deleted"),
        F.when(kind == 0, "a = 1\n").when(kind == 1, "b = 1\nc = 2\n").otherwise("def (").alias("content"),
    )
    src, out, ck = (jobs.scratch(spark, n) for n in ("versions", "facts", "ck"))
    for part in range(4):
        versions.where(F.pmod(F.xxhash64("ts"), F.lit(4)) == part).coalesce(4).write.parquet(f"{src}/{part}")
    for upto in range(4):
        arriving = jobs.read_stream(spark, f"{src}/{{{','.join(str(k) for k in range(upto + 1))}}}", versions.schema)
        jobs.extract_continuously(arriving, out, ck, available_now=True).awaitTermination()
        if upto == 2:
            jobs.evict(spark, out)
    return jobs.read_current(spark, out).select("repo", "path", F.col("ts").alias("version"), "ok", F.col("loc_total").cast("int").alias("loc_total"), "code_hash")


@query(
    "stream_rewritten_history",
    "K2",
    """with e as (select event_type as repo, 'u' || user_id || '.py' as path, ts::date as day, floor(value)::int as added from events where value < 50 and event_type <> 'error')
    select repo, path, day, count(*) as n, sum(added)::bigint as added from e group by all""",
)
def stream_rewritten_history(spark, sf):
    """All large changes and all error events leave the history; the stream of them drives the recomputation."""
    changes = ad.event_changes(spark, sf)
    stays = (F.col("added") < 50) & (F.col("repo") != "error")
    daily, current = jobs.scratch(spark, "daily"), jobs.scratch(spark, "changes")
    jobs.replace_days(changes, changes, daily)
    changes.where(stays).write.parquet(current)
    gone = _change_stream(spark, sf).where(~stays)
    jobs.watch_rewrites(gone, current, daily, jobs.scratch(spark, "ck"), available_now=True).awaitTermination()
    return jobs.read_daily(spark, daily).select("repo", "path", "day", "n", "added")
