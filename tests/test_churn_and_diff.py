"""Churn windows, hotspots, commit figures and differences."""

import datetime as dt
import random

from conftest import rows
from pyspark.sql import functions as F

from codefacts.operators import churn as ch
from codefacts.operators import diff as df_

NUMSTAT = "repo string, sha string, path string, added int, deleted int, ts timestamp"


def day(n):
    return dt.datetime(2024, 1, 1, 12) + dt.timedelta(days=n)


def changes(spark, seed=1, n=400):
    rng = random.Random(seed)
    data = [("r", str(i), f"d/f{rng.randrange(6)}.py", rng.randrange(50), rng.randrange(9), day(rng.randrange(200))) for i in range(n)]
    return data, spark.createDataFrame(data, NUMSTAT)


def test_rolling_sum_equals_recount(spark):
    data, df = changes(spark)
    for r in ch.rolling_churn(ch.churn_daily(df)).collect():
        inside = [x for x in data if x[2] == r.path and 0 <= (r.day - x[5].date()).days < 90]
        assert (r.churn, r.added_lines) == (len(inside), sum(x[3] for x in inside))


def test_window_advance_equals_recompute(spark):
    data, df = changes(spark, seed=9)
    a, b = F.lit("2024-05-01").cast("date"), F.lit("2024-05-20").cast("date")
    state = ch.churn_per_file(df.where(ch.in_window("ts", a)))
    d = F.to_date("ts")
    entering, leaving = df.where((d > a) & (d <= b)), df.where((d > F.date_sub(a, 90)) & (d <= F.date_sub(b, 90)))
    moved = ch.advance_churn(state, ch.churn_per_file(entering), ch.churn_per_file(leaving))
    assert rows(moved) == rows(ch.churn_per_file(df.where(ch.in_window("ts", b))))
    gone = ch.advance_churn(state, ch.churn_per_file(df.limit(0)), state)
    assert gone.count() == 0


def test_hotspots(spark):
    churn = spark.createDataFrame([("r", "plugins/a/x.py", 6, 10), ("r", "plugins/a/y.py", 6, 1), ("r", "z.py", 1, 1), ("r", "deleted.py", 99, 1)], "repo string, path string, churn long, added_lines long")
    locs = spark.createDataFrame([("r", "plugins/a/x.py", 900), ("r", "plugins/a/y.py", 799), ("r", "z.py", 0)], "repo string, path string, loc long")
    spots = ch.hotspots(churn, locs)
    got = {r.path: (r.score, r.high_risk, r.group) for r in spots.collect()}
    assert got == {"plugins/a/x.py": (18.0, True, "plugins/a"), "plugins/a/y.py": (round(6 * 799**0.5 / 10, 1), False, "plugins/a"), "z.py": (0.1, False, "<root>")}
    assert [r.path for r in ch.top_hotspots(spots).orderBy("rank").collect()] == ["plugins/a/x.py", "plugins/a/y.py", "z.py"]
    g = ch.hotspot_groups(spots).orderBy("rank").first()
    assert (g.group, g.churn, g.files, g.high_risk_files) == ("plugins/a", 12, 2, 1)


def test_commit_figures(spark):
    commits = spark.createDataFrame([("r", "1", "Ann", "a@x", day(0), "m"), ("r", "2", "Bob", "b@x", day(5), "m"), ("r", "3", "Ann", "a@x", day(9), "m")],
                                    "repo string, sha string, author_name string, author_email string, ts timestamp, message string")
    stat = spark.createDataFrame([("r", "1", "x", 1, 2, day(0)), ("r", "1", "bin", None, None, day(0)), ("r", "3", "x", 4, 0, day(9))], NUMSTAT)
    s = ch.commit_summary(ch.commit_changes(commits, stat)).first()
    assert (s.total_commits, s.total_additions, s.total_deletions) == (3, 5, 2)
    assert rows(ch.commit_changes(commits, stat), "sha", "files_changed") == [("1", 2), ("2", 0), ("3", 1)]
    assert rows(ch.commit_authors(commits), "author", "commits", "share_pct") == [("Ann", 2, 66.7), ("Bob", 1, 33.3)]
    assert rows(ch.select_commits(commits, author="b@x>$"), "sha") == [("2",)]
    assert rows(ch.select_commits(commits, newest=1), "sha") == [("3",)]
    assert rows(ch.commit_files(commits, stat), "path", "commits") == [("bin", 1), ("x", 2)]


def test_growth(spark):
    stat = spark.createDataFrame([("r", "1", "plugins/a/x.py", 9, 2, day(0)), ("r", "1", "y.py", 1, 5, day(0)), ("r", "2", "plugins/a/z.py", 1, 0, day(0))], NUMSTAT)
    assert rows(ch.growth(stat), "group", "net") == [("<root>", -4), ("plugins", 8)]
    assert rows(ch.growth(stat, by="component"), "group", "net") == [("<root>", -4), ("plugins/a", 8)]
    assert rows(ch.growth_files(stat), "path", "net") == [("plugins/a/x.py", 7), ("plugins/a/z.py", 1)]


SNAP = "repo string, entity_kind string, entity string, version string, loc_code long, routes long, manifest_errors array<string>, depends_on array<string>"


def test_snapshot_diff(spark):
    base = spark.createDataFrame([
        ("r", "plugins", "a", "1.0.0", 100, 2, ["e1"], ["x"]), ("r", "plugins", "old", "1.0.0", 50, 1, ["e"], []), ("r", "core", "m", None, 10, 1, [], []), ("r", "frontend", "fe", None, 5, 0, [], [])], SNAP)
    cur = spark.createDataFrame([
        ("r", "plugins", "a", "1.1.0", 130, 3, ["e2"], ["y"]), ("r", "plugins", "new", "0.1.0", 70, 4, ["bad"], []), ("r", "core", "n", None, 20, 0, [], []), ("r", "frontend", "fe", None, 9, 0, [], [])], SNAP)
    d = df_.snapshot_diff(base, cur).cache()
    assert rows(d, "entity", "status") == [("a", "common"), ("fe", "common"), ("m", "removed"), ("n", "added"), ("new", "added"), ("old", "removed")]
    assert [(r.target, r.delta) for r in df_.loc_changes(d).orderBy("rank").collect()] == [("plugins/new", 70), ("plugins/old", -50), ("plugins/a", 30), ("core/n", 20), ("core/m", -10)]
    assert rows(df_.frontend_changes(d), "target", "delta") == [("frontend/fe", 4)]
    assert rows(df_.route_changes(d), "target", "delta") == [("core/m", -1), ("plugins/a", 1)]
    assert rows(df_.version_changes(d), "entity", "base_version", "cur_version") == [("a", "1.0.0", "1.1.0")]
    assert rows(df_.manifest_changes(d), "entity", "new_errors", "fixed_errors") == [("a", ["e2"], ["e1"]), ("new", ["bad"], [])]
    assert rows(df_.dependency_changes(d), "entity", "deps_added", "deps_removed") == [("a", ["y"], ["x"])]
    assert df_.diff_summary(d).first().has_changes and not df_.diff_summary(df_.snapshot_diff(base, base)).first().has_changes


def test_table_diff(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", "p"), (3, "z", "q")], "k int, a string, b string")
    b = spark.createDataFrame([(2, "y", None), (3, "z", "q"), (4, "w", "r")], "k int, a string, b string")
    assert rows(df_.diff_tables(a, b, ["k"], ["a", "b"])) == [(1, "removed", []), (2, "changed", ["b"]), (4, "added", [])]
