"""The name index next to the full scan, and the digest tree next to a recomputation."""

import hashlib
import random

import pytest
from conftest import rows

from codefacts.operators import digest as dg
from codefacts.operators import nameindex as nx
from codefacts.operators import symbols as sy


@pytest.fixture(scope="module")
def symbols(spark):
    rng = random.Random(9)
    names = ["a", "ab", "abc", "ABCabc", "load_file", "LoadFile", "unload", "über_Straße", "/admin/list", "x" * 300, "aaaa", "%_", "the hot name"]
    data = [("r", rng.choice(names), rng.choice(["class", "function"]), f"f{rng.randrange(9)}.py", rng.randrange(50), "o") for _ in range(200)]
    data += [("s", "the hot name", "function", f"h{k}.py", k, "o") for k in range(120)]
    return spark.createDataFrame(data, "repo string, name string, kind string, file string, line int, owner string")


def test_index_gives_what_a_scan_gives(spark, symbols, tmp_path):
    root = str(tmp_path / "index")
    nx.write_index(symbols, root)
    for text in ["load", "LOAD_", "abc", "ABCabc", "b", "ab", " the hot name ", "HOT", "aaa", "aaaaa", "%_", "nothing", "", "ÜBER", "/admin", "x" * 299]:
        for limit in (3, 500):
            assert rows(nx.search_index(spark, root, text, limit)) == rows(sy.search(symbols, text, limit)), text


def test_index_reads_its_own_triples(spark, symbols, tmp_path):
    root = str(tmp_path / "index")
    nx.write_index(symbols, root)
    found = nx.matching_names(spark, root, "oad_")
    assert found.inputFiles() and all("/triples/" in f for f in found.inputFiles())
    assert "In(gram, [ad_,oad])" in found._jdf.queryExecution().executedPlan().toString()
    empty = str(tmp_path / "empty")
    nx.write_index(symbols.limit(0), empty)
    assert nx.search_index(spark, empty, "abc").count() == 0


def corpus(spark, files):
    return spark.createDataFrame([(r, p, m, s) for r, p, m, s in files], "repo string, path string, mtime long, size long")


def test_digests_of_directories(spark):
    files = [("r", "a/b/c.py", 1, 2), ("r", "a/d.py", 3, 4), ("r", "e.py", 5, 6), ("s", "a/d.py", 3, 4)]

    def digest(repo, prefix):
        below = [hashlib.md5(f"{p}|{m}|{s}".encode()).hexdigest() for r, p, m, s in files if r == repo and (p + "/").startswith(prefix)]
        sums = [sum(int(d[8 * i : 8 * i + 8], 16) for d in below) for i in range(4)]
        return len(below), hashlib.md5("|".join(map(str, [len(below), *sums])).encode()).hexdigest()

    got = {(r.repo, r.path): (r.files, r.digest) for r in dg.digest_tree(corpus(spark, files)).collect()}
    assert got == {(repo, path): digest(repo, path + "/" if path else "") for repo, path in got} and len(got) == 6 + 3
    assert {(r.repo, r.files, r.fingerprint) for r in dg.corpus_fingerprint(corpus(spark, files)).collect()} == {(r, *digest(r, "")) for r in "rs"}
    kinds = {(r.path, r.parent, r.level, r.is_file) for r in dg.digest_tree(corpus(spark, files)).where("repo = 's'").collect()}
    assert kinds == {("", None, 0, False), ("a", "", 1, False), ("a/d.py", "a", 2, True)}


def test_difference_from_the_root_down(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    paths = {"/".join(rng.choice("abc") + str(rng.randrange(3)) for _ in range(rng.randrange(1, 6))) + ".py" for _ in range(150)}
    one = {(r, p): (1, 1) for r in "rs" for p in sorted(paths)}
    two = {k: v for k, v in one.items() if k[0] == "s" or rng.random() < 0.9}
    two.update({k: (2, 1) for k in rng.sample([k for k in two if k[0] == "r"], 7)})
    two.update({("r", "a0/new.py"): (1, 1), ("t", "x/y.py"): (1, 1), ("r", "a0"): (1, 1)})  # a file that is called like a folder
    a, b, same = (str(tmp_path / n) for n in "abc")
    flat = lambda d: [(r, p, *v) for (r, p), v in d.items()]
    dg.write_tree(corpus(spark, flat(one)), a)
    dg.write_tree(corpus(spark, flat(two)), b)
    dg.write_tree(corpus(spark, flat(one)).repartition(5, "path"), same)
    want = {(*k, "removed") for k in one.keys() - two.keys()} | {(*k, "added") for k in two.keys() - one.keys()} | {(*k, "changed") for k in one.keys() & two.keys() if one[k] != two[k]}
    assert {tuple(r) for r in dg.corpus_difference(spark, a, b).collect()} == want
    rounds, real = [], dg.materialize
    monkeypatch.setattr(dg, "materialize", lambda df: rounds.append(1) or real(df))
    assert dg.corpus_difference(spark, a, same).count() == 0 and len(rounds) == 1


def test_sums_before_work_out_their_array_once(spark):
    """The counts of a long file were taken anew for each of its blocks and elements."""
    import itertools

    from pyspark.sql import functions as F

    from codefacts.functions.arrays import BLOCK, sums_before

    assert str(sums_before(F.transform("a", lambda x: x + F.col("marker")))).count("marker") == 1
    for n in (0, 1, 7, BLOCK, BLOCK + 1, 3 * BLOCK + 5):
        lengths = [(k * 37) % 11 for k in range(n)]
        df = spark.createDataFrame([(lengths,)], "a array<bigint>")
        assert df.select(sums_before(F.col("a"))).first()[0] == [0, *itertools.accumulate(lengths)][:n]
