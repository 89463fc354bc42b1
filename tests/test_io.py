"""Sources and sinks on real folders."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from codefacts.functions.ranking import top_k, top_k_array
from codefacts.operators import facts as fx
from codefacts.operators import overview as ov
from codefacts.operators import structure as st
from codefacts.operators import symbols as sy
from codefacts.sources import corpus as sc
from codefacts.sources import gitlog as gl
from codefacts.sources import sinks


def test_scan_files(spark, tmp_path):
    for rel, raw in {"one/a.py": b"\xef\xbb\xbfx = 1\n", "one/sub/b.md": "路径".encode("gbk"), "two/c.txt": b"c"}.items():
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(raw)
    assert rows(sc.scan_files(spark, str(tmp_path)), "repo", "path", "content") == [("one", "a.py", "x = 1\n"), ("one", "sub/b.md", "路径"), ("two", "c.txt", "c")]
    assert rows(sc.scan_files(spark, str(tmp_path / "one"), repo="r", glob="*.py"), "repo", "path") == [("r", "a.py")]
    sc.scan_files(spark, str(tmp_path)).select("repo", "path", F.encode("content", "utf-8").alias("content"), "size", "mtime").write.parquet(str(tmp_path / "pq"))
    assert sc.read_corpus(spark, str(tmp_path / "pq")).count() == 3


def test_log_with_tiny_splits(spark, tmp_path):
    """The commit of a line is found however the file is cut."""
    rng = random.Random(6)
    want, out = [], []
    for i in range(300):
        out.append(f"{i:040x}|{i:07x}|Ann|a@x|2024-01-0{1 + i % 9} 10:00:00|a | piped subject {i}")
        for j in range(rng.choice([0, 1, 3, 20])):
            binary = rng.random() < 0.1
            out.append(("-\t-" if binary else f"{j}\t{i % 7}") + f"\tdir/f{j}.py")
            want.append((f"{i:040x}", f"dir/f{j}.py", None if binary else j, None if binary else i % 7))
        if rng.random() < 0.5:
            out.append("")
    (tmp_path / "repo1.log").write_text("\n".join(out) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        lines = gl.read_log_lines(spark, str(tmp_path / "repo1.log"))
        assert lines.select("split").distinct().count() > 5
        commits, numstat = gl.read_commit_log(spark, str(tmp_path / "repo1.log"))
        assert rows(numstat, "sha", "path", "added", "deleted") == sorted(want, key=repr)
        assert commits.count() == 300 and commits.select("repo").distinct().first().repo == "repo1"
        assert commits.where("message like '% | piped subject%'").count() == 300 and commits.where("ts is null").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_renames(spark):
    cases = {"a => b": "b", "d/{x => y}/f.py": "d/y/f.py", "d/{ => y}/f.py": "d/y/f.py", "d/{x => }/f.py": "d/f.py", "plain.py": "plain.py"}
    df = spark.createDataFrame(list(cases.items()), "p string, want string")
    assert all(r.want == r.got for r in df.select("want", gl.new_path(F.col("p")).alias("got")).collect())


def test_tags_and_roles(spark, make_files):
    lines = spark.createDataFrame([("r", "abc\trefs/tags/v1"), ("r", "abc\trefs/tags/v1^{}"), ("r", "abc\trefs/heads/main")], "repo string, value string")
    assert rows(gl.remote_tags(lines), "tag") == [("v1",)]
    files = make_files({"roles/Agent-Boss.md": "", "roles/agent-Help.md": "", "roles/sub/x.md": "", "roles/plain.md": ""})
    assert rows(sc.role_names(files, "roles", ".md", r"[Aa]gent-(\w+)"), "role") == [("boss",), ("help",), ("plain",)]


def test_sections_snapshots_and_runs(spark, tmp_path, make_files):
    sizes = ov.file_sizes(make_files({"a.py": "x\n"}, "r1").union(make_files({"b.py": "y\n"}, "r2")))
    root = str(tmp_path / "out")
    assert sinks.write_sections({"sizes": sizes, "other": sizes}, root, "s1", only=["sizes"]) == ["sizes"]
    sinks.write_sections({"sizes": sizes.where("repo = 'r1'")}, root, "s2")
    sinks.write_sections({"sizes": sizes.where("repo = 'r1'").withColumn("code", F.lit(7).cast("long"))}, root, "s1")
    got = rows(spark.read.parquet(f"{root}/sizes"), "snapshot", "repo", "code")
    assert got == [("s1", "r1", 7), ("s1", "r2", 1), ("s2", "r1", 1)]
    assert rows(sc.read_snapshot(spark, f"{root}/sizes", "s2"), "repo") == [("r1",)]
    assert rows(sc.list_snapshots(spark, f"{root}/sizes")) == [("s1",), ("s2",)]
    with pytest.raises(ValueError):
        sinks.write_sections({"sizes": sizes}, root, "s", only=["nope"])
    for d in ("2024-01-01", "2024-01-02"):
        sinks.write_run(sizes.select("repo", "path"), str(tmp_path / "runs"), d)
    assert {str(r.run_date) for r in sc.latest_run(spark.read.parquet(str(tmp_path / "runs"))).collect()} == {"2024-01-02"}


def test_mirror_and_index(spark, tmp_path, make_files):
    files = make_files({"plugins/a/__init__.py": "class A: pass\n", "plugins/a/plugin.json": '{"identifier": "a"}', "core/m.py": "def f(): pass\n"})
    from codefacts.plans.analysis import load_corpus

    c = load_corpus(files)
    comps, mods = st.components(files, c.tables), st.modules(files, c.tables)
    symbols = sy.symbol_table(c.tables.classes, c.tables.functions, c.tables.routes)
    mirror = sinks.mirror_tables(comps, c.tables.routes, symbols, ov.file_sizes(files), mods)
    assert {k: v.count() for k, v in mirror.items()} == {"plugins": 1, "routes": 0, "symbols": 2, "files": 3, "core_modules": 1}
    assert '"identifier":"a"' in mirror["plugins"].first().payload
    assert rows(mirror["files"], "relpath", "lang", "plugin")[0] == ("core/m.py", "python", None)
    sinks.write_symbol_index(symbols, str(tmp_path / "sym"))
    assert spark.read.parquet(str(tmp_path / "sym")).where("name = 'A'").count() == 1
    sinks.write_lines(spark.createDataFrame([("r", "x")], "repo string, value string"), str(tmp_path / "txt"))
    assert spark.read.text(str(tmp_path / "txt")).first().value == "x"


def test_top_k_forms_agree(spark):
    rng = random.Random(8)
    data = [("hot" if rng.random() < 0.4 else f"g{rng.randrange(5)}", i, rng.randrange(100)) for i in range(5000)]
    df = spark.createDataFrame(data, "g string, i int, v int")
    for k in (3, 1200):
        want = []
        for g in {d[0] for d in data}:
            best = sorted((d for d in data if d[0] == g), key=lambda d: (-d[2], d[1]))[:k]
            want += [(g, d[1], n + 1) for n, d in enumerate(best)]
        assert rows(top_k(df, ["g"], [F.desc("v"), F.col("i")], k), "g", "i", "rank") == sorted(want, key=repr)
    arr = top_k_array(df, ["g"], [F.desc("v"), F.col("i")], 3, F.col("i"), "best").where("g = 'hot'").first().best
    assert arr == [w[1] for w in sorted((w for w in want if w[0] == "hot"), key=lambda w: w[2])][:3]


def test_frequent_names_are_split_into_blocks(spark):
    df = spark.range(2500).select(F.lit("r").alias("repo"), F.lit("main").alias("name"), F.lit("function").alias("kind"),
                                  F.concat(F.lit("f"), F.col("id").cast("string")).alias("file"), F.lit(1).alias("line"), F.lit("o").alias("owner"))
    out = sy.inverted_index(df).collect()
    assert len(out) == 3 and sum(len(r.entries) for r in out) == 2500 and max(len(r.entries) for r in out) < 1100


def test_search(spark):
    df = spark.createDataFrame([("r", n, "function", f, 1, "o") for n, f in [("Run", "b.py"), ("run", "a.py"), ("runner", "c.py"), ("other", "d.py")]],
                               "repo string, name string, kind string, file string, line int, owner string")
    assert rows(sy.search(df, "run"), "symbol", "match", "total", "truncated") == [("run", "exact", 1, False)]
    got = sy.search(df, "RUN", 2)
    assert [r.symbol for r in got.collect()] == ["run", "Run"] and got.first().total == 3 and got.first().truncated
    assert sy.search(df, " ").count() == 0 and sy.search(df, "zzz").count() == 0


def test_parse_cache_round_trip(spark, tmp_path, make_files):
    facts = fx.extract_facts(make_files({"a.py": "def f(): pass\n"}))
    facts.write.parquet(str(tmp_path / "facts"))
    assert rows(fx.functions(spark.read.parquet(str(tmp_path / "facts"))), "name") == [("f",)]


def test_rows_of_one_row_group_reach_every_core(spark, tmp_path):
    """A file with one row group is cut into many splits, all but one of them empty."""
    from codefacts.sources.corpus import spread_scan

    spark.range(0, 100_000, 1, 1).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        scan = spark.read.parquet(str(tmp_path / "t"))
        assert scan.rdd.getNumPartitions() > 4 and sum(n > 0 for n in scan.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()) == 1
        sizes = spread_scan(scan).rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(sizes) == 100_000 and min(sizes) > 0
