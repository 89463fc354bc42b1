"""Graph operators: call and include resolution, cycles against brute force, reachability, divergence."""

import itertools
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from codefacts.functions import skew
from codefacts.operators import contraction as co
from codefacts.operators import cxx
from codefacts.operators import cycles as cy
from codefacts.operators import divergence as dv
from codefacts.operators import facts as fx
from codefacts.operators import graph as gr


def edges_of(files, make_files):
    f = fx.extract_facts(make_files(files)).cache()
    defs = gr.definitions(fx.classes(f), fx.methods(f), fx.functions(f))
    return gr.symbol_edges(gr.resolve_calls(fx.calls(f), fx.import_facts(f), defs, f.select("repo", "path")))


def test_call_resolution(make_files):
    got = rows(edges_of({
        "pkg/a.py": "def helper(): pass\ndef outer(): inner()\ndef inner(): pass\n",
        "pkg/b.py": "from pkg.a import helper\ndef run(): helper()\n",
        "pkg/c.py": "import requests\nfrom .a import helper\nfrom . import a\ndef f():\n    requests.get(1)\n    helper()\n    a.helper()\n    lonely()\n    twice()\n",
        "pkg/d.py": "def lonely(): pass\ndef twice(): pass\nclass User:\n    def save(self): pass\n",
        "pkg/e.py": "def twice(): pass\nfrom pkg.d import User\ndef do(): User.save()\ndef self_(): self_()\n",
    }, make_files), "src", "dst", "weight")
    # helper and a.helper are two spellings of one edge
    assert got == sorted([
        ("pkg/a.py::outer", "pkg/a.py::inner", 1), ("pkg/b.py::run", "pkg/a.py::helper", 1), ("pkg/c.py::f", "pkg/a.py::helper", 2),
        ("pkg/c.py::f", "pkg/d.py::lonely", 1), ("pkg/e.py::do", "pkg/d.py::save", 1)], key=repr)


def test_import_fallback_needs_one_other_file(make_files):
    got = rows(edges_of({
        "a.py": "from elsewhere import thing\nfrom elsewhere import many\ndef f():\n    thing()\n    many()\n",
        "b.py": "def thing(): pass\ndef many(): pass\n", "c.py": "def many(): pass\n",
    }, make_files), "src", "dst")
    assert got == [("a.py::f", "b.py::thing")]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_counted_joins_spread_hot_keys_only(spark, monkeypatch, how):
    rng = random.Random(7)
    left = spark.createDataFrame([("hot" if rng.random() < 0.4 else f"k{rng.randrange(30)}", i) for i in range(500)] + [(None, 1)], "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k2", 4), ("lone", 5), (None, 6)], "k string, v int")
    want = rows(left.join(right, ["k"], how))
    for least in (1000, 100, 1):
        got = skew.counted_join(left, right, ["k"], ["i"], how, 4, least)
        assert rows(got) == want, least
        if least == 100:
            assert "__salt" in got._jdf.queryExecution().optimizedPlan().toString()


def test_includes(spark, make_files):
    inc = spark.createDataFrame([("r", "a/a.h", t, s) for t, s in [("b/b.h", False), ("x/y.h", False), ("./x/y.h", False), ("dup.h", False), ("one/dup.h", False), ("vector", True), ("none.h", False)]],
                                "repo string, path string, target string, system boolean")
    files = make_files({p: "" for p in ["a/a.h", "a/b.h", "lib/x/y.h", "one/dup.h", "two/dup.h"]})
    got = {r.target: r.dst_path for r in gr.resolve_includes(inc, files).collect()}
    assert got == {"b/b.h": "a/b.h", "x/y.h": "lib/x/y.h", "./x/y.h": "lib/x/y.h", "dup.h": None, "one/dup.h": "one/dup.h", "none.h": None}


def brute_components(edges):
    """node -> smallest node of its component, by closing reachability."""
    nodes = sorted({n for e in edges for n in e})
    reach = {n: {b for a, b in edges if a == n} for n in nodes}
    for mid in nodes:
        for n in nodes:
            if mid in reach[n]:
                reach[n] |= reach[mid]
    own = {n: min([n, *(m for m in reach[n] if n in reach[m])]) for n in nodes}
    return {n: c for n, c in own.items() if any(m != n and own[m] == c for m in nodes)}


def brute_cycles(edges):
    """For each component the shortest cycle through its smallest node whose end is smallest, and loops."""
    own, out = brute_components(edges), [(a,) for a, b in set(edges) if a == b]
    for root in set(own.values()):
        paths, done = [[root]], []
        while not done:
            grown = [[*p, b] for p in paths for a, b in set(edges) if a == p[-1] and own.get(b) == root and a != b]
            done = [p[:-1] for p in grown if p[-1] == root]
            paths = [p for p in grown if len(set(p)) == len(p)]
        out.append(tuple(min(done, key=lambda p: p[::-1])))
    return sorted(out)


def graphs(spark, by_repo):
    return spark.createDataFrame([(g, a, b) for g, es in by_repo.items() for a, b in es], "repo string, src string, dst string")


def random_graphs():
    rng = random.Random(11)
    out = {}
    for g in range(40):  # dense ones, sparse ones with long stretches, rings with tails and shortcuts
        names = [f"{rng.randrange(100):02}{k}" for k in range(rng.randrange(2, 12))]
        es = {(a, b) for a, b in itertools.product(names, names) if rng.random() < rng.choice((0.08, 0.15, 0.4))}
        if g % 3 == 0:
            es |= {(names[k - 1], names[k]) for k in range(rng.randrange(len(names)))} | {(names[-1], names[0])}
        if g % 4 == 0:
            ring = [f"x{rng.randrange(1000)}" for _ in range(rng.randrange(2, 30))]
            es |= {(ring[k - 1], ring[k]) for k in range(len(ring))} | {(ring[0], names[0])}
        if es:
            out[f"g{g}"] = sorted(es)
    return out


def test_components_and_cycles_against_brute_force(spark):
    data = random_graphs()
    df = graphs(spark, data).withColumn("weight", F.lit(1)).withColumn("tail", F.lit("t"))
    got: dict = {}
    for r in gr.strong_components(df).collect():
        got.setdefault(r.repo, {})[r.node] = r.component
    want = {g: brute_components(es) for g, es in data.items()}
    assert got == {g: w for g, w in want.items() if w}
    cycles: dict = {}
    for r in gr.cycles(df).collect():
        cycles.setdefault(r.repo, []).append(tuple(r.cycle))
        assert r.length == len(r.cycle) and r.chain == " -> ".join([*r.cycle, r.cycle[0]])
    want = {g: brute_cycles(es) for g, es in data.items()}
    assert {g: sorted(c) for g, c in cycles.items()} == {g: w for g, w in want.items() if w}


def test_no_cycles(spark):
    df = graphs(spark, {"r": [(f"n{i:02}", f"n{i + 1:02}") for i in range(20)]})
    assert gr.strong_components(df).count() == 0 and gr.cycles(df).count() == 0 and gr.cycles(df.limit(0)).count() == 0
    back = df.union(graphs(spark, {"r": [("n07", "n03")]}))
    assert rows(gr.cycles(back), "length", "chain") == [(5, "n03 -> n04 -> n05 -> n06 -> n07 -> n03")]
    assert rows(gr.cycles(graphs(spark, {"r": [("a", "a")]}), self_loops=False)) == []


def test_long_rings_take_few_rounds(spark, monkeypatch):
    """A ring of ten thousand nodes, one with shortcuts and a line into it; rounds are tables written."""
    n = 10_000
    names = [f"n{(k * 7919) % n:05}" for k in range(n)]
    ring = [(names[k - 1], names[k]) for k in range(n)]
    other = [("m" + a, "m" + b) for a, b in ring] + [("m" + names[5], "m" + names[4000]), ("m" + names[9000], "m" + names[8000])]
    line = [(f"l{k:05}", f"l{k + 1:05}") for k in range(3000)] + [("l03000", "m" + names[17])]
    written, real = [], cy.materialize
    monkeypatch.setattr(cy, "materialize", lambda df: written.append(1) or real(df))
    got = {r.repo: (r.length, r.cycle[0]) for r in gr.cycles(graphs(spark, {"ring": ring, "both": other + line})).collect()}
    assert got == {"ring": (n, "n00000"), "both": (n - 3994, "mn00000")}
    one, before = graphs(spark, {"ring": ring}), len(written)
    assert before < 100 and gr.cycles(one).first().length == n and len(written) - before < 60


def test_reachable_stops_in_loops(spark):
    df = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c"), ("r", "c", "a"), ("r", "c", "d")], "repo string, src string, dst string")
    starts = spark.createDataFrame([("r", "a", "a")], "repo string, start string, node string")
    assert rows(gr.reachable(starts, df), "node", "hops") == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert rows(gr.reachable(starts, df, 1), "node") == [("a",), ("b",)]


def test_spread_like_a_walk(spark):
    rng = random.Random(6)
    data, starts, want = {}, [], {}
    for g, es in random_graphs().items():
        es = es + [(f"t{k}", f"t{k + 1}") for k in range(rng.randrange(20))] + [(es[0][0], "t0")]
        nodes = sorted({x for e in es for x in e})
        begin = rng.sample(nodes, rng.choice((0, 1, 2))) + ["nowhere"] * rng.randrange(2)
        data[g], hops = es, {b: 0 for b in begin}
        starts += [(g, b) for b in begin]
        todo = list(hops)
        while todo:
            a = todo.pop(0)
            for x, b in es:
                if x == a and b not in hops:
                    hops[b] = hops[a] + 1
                    todo.append(b)
        want.update({(g, n): h for n, h in hops.items()})
    got = gr.spread(spark.createDataFrame(starts, "repo string, node string"), graphs(spark, data)).collect()
    assert {(r.repo, r.node): r.hops for r in got} == want and len(got) == len(want)


def test_a_long_history_takes_few_rounds(spark, monkeypatch):
    """A hundred thousand commits in a line, one branch of it further than the other."""
    n = 100_000
    ids = spark.range(n)
    parents = ids.select(F.lit("r").alias("repo"), F.concat(F.lit("c"), F.col("id") + 1).alias("sha"), F.concat(F.lit("c"), F.col("id")).alias("parent"))
    side = spark.createDataFrame([("r", "x1", "c70000"), ("r", "x2", "x1"), ("r", "x3", "x2")], "repo string, sha string, parent string")
    written, real = [], co.materialize
    count = lambda df: written.append(1) or real(df)
    monkeypatch.setattr(co, "materialize", count)
    monkeypatch.setattr(dv, "materialize", count)
    head = lambda *shas: spark.createDataFrame([("r", s) for s in shas], "repo string, sha string")
    got = dv.exclusive_commits(head("x3"), head(f"c{n}"), parents.union(side)).groupBy("side").count().collect()
    assert {r.side: r["count"] for r in got} == {"ahead": 3, "behind": n - 70000} and len(written) < 40
    assert dv.exclusive_commits(head("c5"), head("c5"), parents).count() == 0


def test_divergence_on_random_histories(spark):
    rng = random.Random(2)
    data, want, heads = [], {}, {"l": [], "r": []}
    for k in range(8):
        repo, n = f"r{k}", 25
        parents = {i: sorted(rng.sample(range(i), min(i, rng.choice([1, 1, 2])))) for i in range(n)}
        data += [(repo, str(i), str(p)) for i, ps in parents.items() for p in ps]
        a, b = rng.randrange(n), rng.randrange(n)
        heads["l"].append((repo, str(a)))
        heads["r"].append((repo, str(b)))

        def ancestors(x, parents=parents):
            out, todo = set(), [x]
            while todo:
                y = todo.pop()
                if y not in out:
                    out.add(y)
                    todo += parents[y]
            return out

        la, lb = ancestors(a), ancestors(b)
        want[repo] = (len(la - lb), len(lb - la))
    parents_df = spark.createDataFrame(data, "repo string, sha string, parent string")
    left, right = (spark.createDataFrame(heads[s], "repo string, sha string") for s in "lr")
    got = dv.divergence(left, dv.exclusive_commits(left, right, parents_df)).collect()
    assert {r.repo: (r.ahead, r.behind) for r in got} == want
    for r in got:
        assert r.status == ("diverged" if r.ahead and r.behind else "ahead" if r.ahead else "behind" if r.behind else "synced")


def test_degrees_and_subgraph(spark):
    df = spark.createDataFrame([("r", "a", "b", 2), ("r", "a", "c", 1), ("r", "b", "c", 5)], "repo string, src string, dst string, weight long")
    assert rows(gr.degrees(df), "node", "in_deg", "out_deg", "in_w", "out_w") == [("a", 0, 2, 0, 3), ("b", 1, 1, 2, 5), ("c", 2, 0, 6, 0)]
    assert rows(gr.core_subgraph(df, 2), "src", "dst") == [("a", "b")]
    assert rows(gr.ego_network(df, "b"), "src", "dst", "direction") == [("a", "b", "in"), ("b", "c", "out")]


def test_sides_that_grow_with_the_files_are_not_broadcast(make_files):
    files = make_files({f"lib/p{i}.h": f'#include "p{i + 1}.h"\n' for i in range(4)})
    text = gr.resolve_includes(cxx.includes(files), files.select("repo", "path"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text


def test_a_cycle_for_each_closing_edge(spark):
    edges = spark.createDataFrame([("r", *e) for e in ("ab", "ba", "bc", "ca", "cb", "cc", "xy")], "repo string, src string, dst string")
    assert rows(gr.closing_cycles(edges), "length", "chain") == [(1, "c -> c"), (2, "a -> b -> a"), (2, "b -> c -> b"), (3, "a -> b -> c -> a")]
    assert gr.closing_cycles(edges.where("src = 'x'")).count() == 0


def test_straight_stretches_are_joined_by_merging(spark, monkeypatch):
    from codefacts.operators import contraction as co

    plans, real = [], co.materialize
    monkeypatch.setattr(co, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    co.straight(spark.createDataFrame([("r", "a", "b"), ("r", "b", "c"), ("r", "c", "d")], "repo string, src string, dst string"))
    assert plans and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans)
