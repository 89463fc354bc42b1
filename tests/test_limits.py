"""Inputs beyond limits that once were, and single bad rows: nothing is lost, nothing stops."""

from pyspark.sql import functions as F

from codefacts.functions.matches import match_positions
from codefacts.operators import census, cxx, documents, matching
from codefacts.operators import endpoints as ep
from codefacts.operators import symbols as sy
from codefacts.sources import manifests as mf
from conftest import rows


def test_large_script_is_judged(make_files):
    big = make_files({"tool.py": "x = 1\n" * 40_000})
    assert census.census_files(big).count() == 1


def test_all_headings_whole(make_files):
    md = make_files({"a.md": "".join(f"## {'h' * 200}{i}\n" for i in range(60))})
    got = [r.heading for r in documents.headings(md, 2).orderBy("pos").collect()]
    assert got == [f"{'h' * 200}{i}" for i in range(60)]


def test_imports_are_followed_to_the_end(spark):
    edges = spark.createDataFrame([("r", f"m{i}.py", "bp", f"m{i + 1}.py", "bp") for i in range(12)], "repo string, path string, var string, src_path string, src_var string")
    goal = spark.createDataFrame([("r", "m12.py", "bp")], "repo string, path string, var string")
    got = {r.path: r.hops for r in ep.follow(edges, goal).collect()}
    assert got["m0.py"] == 12 and len(got) == 13


def test_one_name_in_very_many_files(spark):
    many = spark.range(1001).select(F.lit("r").alias("repo"), F.lit("run").alias("name"), F.concat(F.lit("f"), "id").alias("file"), F.lit(1).alias("line"),
                                    F.lit("function").alias("kind"), F.lit("o").alias("owner"))
    assert sy.postings(many).count() == 1001
    assert sum(len(r.entries) for r in sy.inverted_index(many).collect()) == 1001
    assert sy.search(many, "run", 800).count() == 800


def test_mark_characters_in_texts(make_files, spark):
    files = make_files({"a.c": "int a(int x) {\n\x01\n}\nint b(void) {\n}\n"})
    assert rows(cxx.functions(files), "name", "lineno") == [("a", 1), ("b", 4)]
    df = spark.createDataFrame([("x \x01 y\nkey=1 key=2",)], "t string").select(match_positions(F.col("t"), "key=[0-9]").alias("m"))
    assert [(m.match, m.line, m.before) for m in df.first().m] == [("key=1", 2, ""), ("key=2", 2, "key=1 ")]


def test_repeated_dependency_in_a_manifest(make_files):
    files = make_files({"plugins/a/plugin.json": '{"identifier": "a", "depends_on": ["x", "x", "y"]}', "plugins/a/__init__.py": ""})
    got = mf.manifest_columns(mf.read_manifests(files), mf.read_manifest_contract(files)).first()
    assert set(got.depends_on) == {"x", "y"}


def test_pairing_takes_names_literally(make_files):
    rule = matching.PairRule(name="t", assign=r"^\s*([\w.]+)\s*=\s*open_raw\(\)", use=r"{var}\.run\(", escape="", desc="")
    files = make_files({"a.py": "self.x = open_raw()\nselfax.run(1)\nself.x.run(2)\n"})
    assert rows(matching.pair_rule_hits(files, (rule,)), "line_no", "snippet") == [(3, "self.x.run(2)")]
