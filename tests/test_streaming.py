"""Streaming against batch: late rows, replays, rewrites, deletions, new contents."""

import datetime as dt
import tempfile

from conftest import rows
from pyspark.sql import functions as F

from codefacts.operators import churn as ch
from codefacts.operators import facts as fx
from codefacts.operators import matching as mt
from codefacts.streaming import jobs
from codefacts.streaming.levels import Levels

CHANGES = "repo string, path string, sha string, ts timestamp, added int, deleted int"


def at(day, hour=12):
    return dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=day)


def drop(spark, data, schema, folder, name):
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def source(spark, folder, schema):
    df = spark.createDataFrame([], schema)
    return jobs.read_stream(spark, f"{folder}/*", df.schema, files_per_trigger=1)


def test_daily_churn_in_batches_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    one = [("r", "a.py", "1", at(0), 5, 1), ("r", "a.py", "2", at(0), 2, 0), ("r", "b.py", "3", at(10), 1, 0)]
    two = [("r", "a.py", "4", at(9), 7, 0), ("r", "b.py", "5", at(10), 1, 1)]  # one late row inside the watermark
    drop(spark, one, CHANGES, src, "p1")
    args = (str(tmp_path / "log"), str(tmp_path / "ck"))
    jobs.write_changelog(jobs.daily_churn(source(spark, src, CHANGES)), *args, available_now=True).awaitTermination()
    drop(spark, two, CHANGES, src, "p2")
    jobs.write_changelog(jobs.daily_churn(source(spark, src, CHANGES)), *args, available_now=True).awaitTermination()
    state = jobs.changelog_state(spark, args[0], ["repo", "path", "day"])
    want = ch.churn_daily(spark.createDataFrame(one + two, CHANGES))
    assert rows(state, "repo", "path", "day", "n", "added", "deleted") == rows(want, "repo", "path", "day", "n", "added", "deleted")
    assert rows(ch.rolling_churn(state), "path", "churn") == rows(ch.rolling_churn(want), "path", "churn")


def test_rows_behind_the_watermark_are_left_to_recomputation(spark, tmp_path):
    src = str(tmp_path / "in")
    args = (str(tmp_path / "log"), str(tmp_path / "ck"))
    for i, data in enumerate([[("r", "a.py", "1", at(60), 1, 0)], [("r", "a.py", "2", at(61), 1, 0)], [("r", "a.py", "3", at(0), 1, 0)]]):
        drop(spark, data, CHANGES, src, f"p{i}")
        jobs.write_changelog(jobs.daily_churn(source(spark, src, CHANGES)), *args, available_now=True).awaitTermination()
    assert jobs.changelog_state(spark, args[0], ["repo", "path", "day"]).count() == 2


def test_rewritten_days(spark, tmp_path):
    daily, changes = str(tmp_path / "daily"), str(tmp_path / "changes")
    before = [("r", "a.py", "1", at(0), 5, 0), ("r", "a.py", "2", at(1), 1, 0), ("r", "b.py", "3", at(1), 1, 0), ("s", "c.py", "4", at(1), 1, 0)]
    df = spark.createDataFrame(before, CHANGES)
    jobs.replace_days(df, df, daily)
    after = [("r", "b.py", "3", at(1), 9, 0), ("s", "c.py", "4", at(1), 1, 0)]  # commits 1 and 2 are no longer part of the history
    spark.createDataFrame(after, CHANGES).write.parquet(changes)
    gone = str(tmp_path / "gone")
    drop(spark, [b for b in before if b[2] in ("1", "2", "3")], CHANGES, gone, "p")
    for _ in range(2):  # replayed, same table
        ck = jobs.scratch(spark, "ck")
        jobs.watch_rewrites(source(spark, gone, CHANGES), changes, daily, ck, available_now=True).awaitTermination()
        want = ch.churn_daily(spark.createDataFrame(after, CHANGES))
        assert rows(jobs.read_daily(spark, daily), "repo", "path", "n", "added") == rows(want, "repo", "path", "n", "added")


VERSIONS = "repo string, path string, version long, deleted boolean, size long"


def test_latest_version_wins(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    batches = [
        [("r", "a", 1, False, 10), ("r", "b", 1, False, 20), ("r", "a", 3, False, 30)],
        [("r", "a", 2, False, 99), ("r", "b", 2, True, 0), ("r", "c", 1, False, 40)],
        [("r", "b", 1, False, 21), ("r", "c", 2, True, 0), ("r", "c", 3, False, 41)],
    ]
    for i, data in enumerate(batches):
        drop(spark, data, VERSIONS, src, f"p{i}")
        jobs.track_latest(source(spark, src, VERSIONS), out, ck, buckets=4, available_now=True).awaitTermination()
    want = [("a", 3, 30), ("c", 3, 41)]
    assert rows(jobs.read_latest(spark, out), "path", "version", "size") == want
    jobs.merge_latest(spark.createDataFrame(batches[1], VERSIONS), out, 4)  # a replay changes nothing
    assert rows(jobs.read_latest(spark, out), "path", "version", "size") == want


def test_only_new_contents_are_parsed(spark, tmp_path):
    schema = "repo string, path string, content string, ts timestamp"
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    one = [("r", "a.py", "def f(): pass\n", at(0)), ("r", "a.py", "def f(): pass\n", at(0, 13)), ("r", "b.py", "x = (", at(0))]
    two = [("r", "a.py", "def f(): pass\n", at(0, 14)), ("r", "a.py", "def g(): pass\n", at(0, 15))]
    for i, data in enumerate([one, two]):
        drop(spark, data, schema, src, f"p{i}")
        jobs.extract_continuously(source(spark, src, schema), out, ck, available_now=True).awaitTermination()
    got = jobs.fact_runs(spark, out).read()
    distinct = spark.createDataFrame(one + two, schema).dropDuplicates(["repo", "path", "content"])
    assert rows(got, "path", "code_hash", "ok") == rows(fx.extract_facts(distinct), "path", "code_hash", "ok")


def test_continuous_rules_equal_batch(spark, tmp_path):
    schema = "repo string, path string, content string"
    data = [("r", "a.py", "requests.get(u)\ncur.execute(f'x')\n"), ("r", "b.py", "requests.get(u)\nurl_guard(u)\n")]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    drop(spark, data, schema, src, "p")
    hits = jobs.continuous_rules(source(spark, src, schema))
    jobs.run_to_table(hits, out, str(tmp_path / "ck"), available_now=True).awaitTermination()
    assert rows(spark.read.parquet(out)) == rows(mt.line_rule_hits(spark.createDataFrame(data, schema)))


def test_sliding_windows(spark, tmp_path):
    src = str(tmp_path / "in")
    drop(spark, [("r", "a.py", "1", at(0), 5, 0), ("r", "a.py", "2", at(2), 2, 0)], CHANGES, src, "p")
    q = jobs.sliding_churn(source(spark, src, CHANGES), days=3)
    jobs.write_changelog(q, str(tmp_path / "log"), str(tmp_path / "ck"), available_now=True).awaitTermination()
    got = jobs.changelog_state(spark, str(tmp_path / "log"), ["repo", "path", "day"])
    by_day = {str(r.day): (r.churn, r.added_lines) for r in got.collect()}
    assert by_day["2024-01-03"] == (2, 7) and by_day["2024-01-01"] == (1, 5) and by_day["2024-01-05"] == (1, 2) and len(by_day) == 5
    assert got.where(F.col("churn") > 2).count() == 0


def shuffled_changes(spark, src):
    """Files of one row each, whose days go back and forth by months."""
    days = [200, 0, 90, 201, 3, 150, 0, 91]
    data = [("r", f"{'ab'[i % 2]}.py", str(i), at(d), i + 1, i) for i, d in enumerate(days)]
    for i, row in enumerate(data):
        drop(spark, [row], CHANGES, src, f"p{i}")
    return spark.createDataFrame(data, CHANGES)


def test_partial_sums_keep_late_rows(spark, tmp_path):
    src, log, ck = (str(tmp_path / n) for n in ("in", "log", "ck"))
    want = shuffled_changes(spark, src)
    sliding = lambda batch: jobs.sliding_churn(batch, days=3)
    for name, aggregate, whole in (("d", jobs.daily_churn, ch.churn_daily(want)), ("s", sliding, sliding(want))):
        jobs.write_partials(source(spark, src, CHANGES), aggregate, log + name, ck + name, available_now=True).awaitTermination()
        got = jobs.partials_state(spark, log + name, ["repo", "path", "day"])
        runs = jobs.partials(spark, log + name).runs()
        assert [(r.level, r.first, r.last) for r in runs] == [(1, 0, 7)]
        one = jobs.partials_state(spark, log + name, ["repo", "path", "day"], ["2024-01"])
        assert {str(r.day)[:7] for r in one.collect()} == {"2024-01"}
        assert rows(got, *whole.columns) == rows(whole)


def test_facts_of_late_and_repeated_contents(spark, tmp_path):
    schema = "repo string, path string, content string, ts timestamp"
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    a, b = "def f(): pass\n", "x = 1\ny = 2\n"
    data = [("r", "a.py", a, at(0)), ("r", "a.py", a, at(40)), ("r", "a.py", b, at(20)), ("r", "b.py", b, at(1)), ("r", "a.py", a, at(41))]
    for i, row in enumerate(data):
        drop(spark, [row], schema, src, f"p{i}")
        jobs.extract_continuously(source(spark, src, schema), out, ck, available_now=True).awaitTermination()
    got = [(r.path, r.ts, r.loc_total) for r in jobs.read_versions(spark, out).orderBy("path", "ts").collect()]
    assert got == [("a.py", at(0), 1), ("a.py", at(20), 2), ("a.py", at(40), 1), ("b.py", at(1), 2)]
    assert rows(jobs.read_current(spark, out), "path", "loc_total") == [("a.py", 1), ("b.py", 2)]
    assert jobs.fact_runs(spark, out).read().count() == 3  # each content of a path is parsed once


def test_deleted_files_and_eviction(spark, tmp_path):
    schema = "repo string, path string, content string, ts timestamp, deleted boolean"
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    a, b = "def f(): pass\n", "x = 1\ny = 2\n"

    def arrive(name, *data):
        drop(spark, list(data), schema, src, name)
        jobs.extract_continuously(source(spark, src, schema), out, ck, available_now=True).awaitTermination()

    def current():
        return rows(jobs.read_current(spark, out), "path", "loc_total", "ts")

    arrive("p0", ("r", "a.py", a, at(0), False), ("r", "a.py", a, at(0), None), ("r", "b.py", b, at(1), None), ("r", "c.py", a, at(2), None))
    arrive("p1", ("r", "b.py", None, at(5), True), ("r", "a.py", b, at(3), False), ("r", "d.py", None, at(9), True))
    assert current() == [("a.py", 2, at(3)), ("c.py", 1, at(2))]
    arrive("p2", ("r", "a.py", a, at(4), False), ("r", "b.py", b, at(2), False), ("r", "d.py", a, at(8), False))  # A again, and two that come late
    want = [("a.py", 1, at(4)), ("c.py", 1, at(2))]
    assert current() == want and jobs.fact_runs(spark, out).read().count() == 5
    assert rows(jobs.read_versions(spark, out), "path", "ts") == sorted([("a.py", at(0)), ("a.py", at(3)), ("a.py", at(4)), ("b.py", at(1)), ("c.py", at(2)), ("d.py", at(8))])
    jobs.evict(spark, out)
    assert current() == want and jobs.fact_runs(spark, out).read().count() == 2
    arrive("p3", ("r", "b.py", b, at(3), False), ("r", "a.py", b, at(10), False))  # late again, and evicted content again
    assert current() == [("a.py", 2, at(10)), ("c.py", 1, at(2))]


def test_batches_move_no_text(spark, tmp_path, monkeypatch):
    schema = "repo string, path string, content string, ts timestamp"
    out, plans = str(tmp_path / "out"), []
    real = fx.extract_facts
    monkeypatch.setattr(jobs.fx, "extract_facts", lambda files: plans.append(files._jdf.queryExecution().executedPlan().toString()) or real(files))
    for i in range(2):
        drop(spark, [("r", f"{k}.py", f"x = {k % 3 + i}\n", at(i)) for k in range(20)], schema, str(tmp_path / "in"), f"p{i}")
        jobs.extract_continuously(source(spark, str(tmp_path / "in"), schema), out, str(tmp_path / "ck"), available_now=True).awaitTermination()
    assert len(plans) == 2 and all("Exchange hashpartitioning" not in p and "BroadcastHashJoin" in p for p in plans)
    assert jobs.fact_runs(spark, out).read().count() == 40


def test_many_batches_leave_few_folders(spark, tmp_path):
    """Two hundred batches; replays and runs that no manifest names change nothing."""
    root = str(tmp_path / "log")
    levels = Levels(spark, root, lambda df: df.groupBy("k").agg(F.sum("n").alias("n")).select("k", "n"), fan=6)
    batch = lambda i: spark.range(1).select((F.lit(i) % 3).alias("k"), F.lit(i).cast("long").alias("n")).coalesce(1)
    assert levels.read() is None and not levels.covers(0)
    for i in range(200):
        levels.add(batch(i), i)
        if i % 50 == 0:
            levels.add(batch(1000), i)  # a replay
            batch(7).write.parquet(f"{root}/runs/0-{i}-{i}-lost")
    folders = [f for f in (tmp_path / "log" / "runs").iterdir() if not f.name.endswith("lost")]
    assert len(levels.runs()) <= 5 * 4 and len(folders) <= 5 * 4 + 6 and len(list((tmp_path / "log" / "manifest").iterdir())) <= 5
    got = {r.k: r.n for r in levels.read().groupBy("k").agg(F.sum("n").alias("n")).collect()}
    assert got == {k: sum(i for i in range(200) if i % 3 == k) for k in range(3)}
    assert levels.covers(199) and not levels.covers(200)
    levels.rewrite(lambda df: df.where("k <> 1"))
    assert len(levels.runs()) == 1 and {r.k for r in levels.read().collect()} == {0, 2} and levels.covers(199)


def test_a_table_of_one_file_or_a_folder_of_them_is_a_stream(spark, tmp_path):
    spark.range(5).repartition(2).write.parquet(str(tmp_path / "t.parquet"))
    part = next((tmp_path / "t.parquet").glob("part-*.parquet"))
    for path, n in ((tmp_path / "t.parquet", 5), (part, spark.read.parquet(str(part)).count())):
        out = tempfile.mkdtemp(dir=tmp_path)
        jobs.run_to_table(jobs.table_stream(spark, str(path), "id long"), f"{out}/rows", f"{out}/ck", available_now=True).awaitTermination()
        assert spark.read.schema("id long").parquet(f"{out}/rows").count() == n


def test_many_keys_are_merged_and_not_sent(spark, monkeypatch):
    monkeypatch.setattr(jobs, "SENT", 0)
    keys = spark.createDataFrame([("r", "p", "h")], "repo string, path string, code_hash string")
    joined = keys.join(jobs._sent(jobs._prefixed(keys, "new_")), jobs._same("", "new_"), "left_semi")
    assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
