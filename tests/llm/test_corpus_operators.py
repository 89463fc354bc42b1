"""Line dedup, spelling variants and ranked search next to plain versions of themselves."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codefacts.llm import line_dedup, search, spelling
from codefacts.llm.queries import QUERIES


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


class TestLineDedup:
    def brute(self, rows, least=10):
        key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
        docs_of: dict = {}
        for i, text in rows:
            for line in (text or "").split("\n"):
                docs_of.setdefault(key(line), set()).add(i)
        common = {k for k, ids in docs_of.items() if k and len(ids) >= least}
        out = []
        for i, text in rows:
            lines = (text or "").split("\n")
            kept = [x for x in lines if key(x) not in common]
            out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
        return sorted(out, key=repr)

    def rows(self):
        rng = random.Random(5)
        pool = ["Shared  line", " shared  LINE\t", "ÀB", "àb", "", "  ", "x", "\x0b\x0cx\r", "once " * 3, " x", " y", "long " * 3000]
        made = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(12)))) for k in range(60)]
        made += [(100 + k, "hot\n" * 40 + str(k)) for k in range(30)]  # a line that a third of all rows have, many times
        made += [(k, f"nine {k}\nonly nine") for k in range(200, 209)]
        # repeated ids, ids that are missing, texts that are missing, empty ones, breaks of other kinds
        return made + [(7, "only nine"), (7, "Shared  line\nq"), (7, "Shared  line\nq"), (None, "ten\nhot"), (None, None), (300, None), (301, ""), (302, "\n"), (303, "a\r\nb\rc\x85d")] + [(400 + k, "ten") for k in range(9)]

    def test_like_a_loop(self, spark):
        rows = self.rows()
        got = line_dedup.bitmaps(documents(spark, rows))
        kept = line_dedup.kept_text("text", F.col("__keep"), F.col("__dropped"))
        assert sorted(((r[0], r[1], r[2], r[3]) for r in got.select("doc_id", "__lines", "__dropped", kept).collect()), key=repr) == self.brute(rows)

    def test_columns_and_bitmaps(self, spark):
        rows = [(k, f"a\nB {k}\na\na\nc") for k in range(12)]
        docs = documents(spark, rows).withColumn("a", F.lit(1)).withColumn("pos", F.lit("p")).withColumn("dropped", F.lit(2)).withColumn("key", F.lit(3))
        out = line_dedup.drop_lines(docs)
        assert out.columns == docs.columns and {r.text for r in out.collect()} == {f"B {k}" for k in range(12)}
        runs = line_dedup.bitmaps(documents(spark, rows)).select("__keep").first()[0]
        assert [tuple(r) for r in runs] == [(1, 1)]
        assert {r.text for r in line_dedup.drop_lines(docs, least=2).collect()} == {f"a\nB {k}\na\na\nc" for k in range(12)}
        assert line_dedup.drop_lines(docs.limit(0)).count() == 0
        assert line_dedup.drop_lines(documents(spark, [(1, None)])).first().text is None

    def test_nothing_moves_after_the_ranges(self, spark):
        lines = line_dedup.hashed_lines(documents(spark, self.rows()))
        plan = line_dedup.frequent_keys(lines)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("rangepartitioning") >= 1 and plan.count("hashpartitioning(a") == 1 and "Python" not in plan


def one_edit(a, b):
    """Exactly one inserted, deleted or replaced code point, by trying them all."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(counts, ratio=10):
    out = {}
    for w, n in counts.items():
        close = [x for x in counts if one_edit(w, x)]
        best = min(close, key=lambda x: (-counts[x], x), default=None)
        out[w] = [n, len(close), best if best and counts[best] >= ratio * n else None]
    def root(w):
        return root(out[w][2]) if out[w][2] else w
    return sorted((w, n, k, f, counts[f] if f else None, root(w)) for w, (n, k, f) in out.items())


class TestSpelling:
    COLUMNS = ("word", "n", "n_near", "form", "form_n", "root")

    def variants(self, spark, counts, **kw):
        rows = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), **kw).select(*self.COLUMNS).collect()
        return sorted(tuple(r) for r in rows)

    @pytest.mark.parametrize("most", [512, 2])
    def test_like_all_pairs(self, spark, monkeypatch, most):
        """Blocks of any size, divided or not, tiled or not, give each pair once."""
        if most == 2:
            monkeypatch.setattr(spelling, "CELLS", 64)
        rng = random.Random(most)
        words = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 10))) for _ in range(220)}
        words |= {"same front " + x + y for x in "abcdeé" for y in "xyz€"} | {x + " same back" for x in ("", "a", "b", "ab", "ba", "aa")}
        words |= {"x" * k for k in (60, 61, 62, 64)} | {"x" * 30 + "y" + "x" * 30}
        counts = {w: rng.choice((2, 3, 30, 31, 400, 5000, 60000)) for w in words}
        assert self.variants(spark, counts, most=most) == brute_variants(counts)

    def test_ties_and_chains(self, spark):
        counts = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaaac": 20, "aaaaabb": 200, "aaaabbb": 2000, "zzzzzzz": 5}
        got = {r[0]: r[2:] for r in self.variants(spark, counts)}
        assert got["aaaaaaa"] == (2, "aaaaaab", 20, "aaaabbb") and got["aaaaaac"] == (2, None, None, "aaaaaac") and got["zzzzzzz"] == (0, None, None, "zzzzzzz")
        assert self.variants(spark, {}) == []

    def count(self, rows):
        total = Counter()
        for i, text in rows:
            for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
                run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % 31 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                total[run] += 1
        return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}

    def test_words(self, spark, monkeypatch):
        monkeypatch.setattr(spelling, "HELD", 50)
        rng = random.Random(3)
        pool = ["Zebracrossing", "zebraCROSSING", "ÉCOLESéco", "écoleséco", "x" * 3000, "seventy", "sixsix", "a1bcdefgh", "under_scored_words", "ωμέγαωμέγα", "naïveté×÷ÿ", "ſstraße"]
        rows = [(k, " ".join(rng.choice(pool) + rng.choice(["", "", "s"]) for _ in range(rng.randrange(40)))) for k in range(120)]
        rows += [(1, "Zebracrossing"), (None, "seventy seventy"), (5, None), (6, "")]
        got = spelling.count_words(documents(spark, rows).withColumn("word", F.lit(1)).withColumn("n", F.lit(2)))
        want = self.count(rows)
        assert {r.word: r.n for r in got.collect()} == want and len(want) > 12
        assert spelling.count_words(documents(spark, [])).count() == 0

    def test_query(self, spark):
        sf = "/root/testdata/sf0.001"
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
        want = brute_variants(self.count(rows))
        assert sorted(tuple(r) for r in QUERIES["op13_spelling_variants"](spark, sf).collect()) == want and any(r[3] for r in want)


class TestSearch:
    def terms(self, text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)

    def brute(self, docs, items, k):
        bags = [(i, Counter(self.terms(t))) for i, t in docs]
        bags = [(i, b) for i, b in bags if b]
        n, total = len(bags), sum(sum(b.values()) for _, b in bags)
        out = []
        for item, text in items:
            scores = []
            for i, bag in bags:
                m = 100 - 25 + 25 * sum(bag.values()) * n // total
                score = 0
                for t in self.terms(text):
                    df = sum(t in b for _, b in bags)
                    if t in bag:
                        score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (1000000000 * bag[t] // (1000 * bag[t] + 12 * m))
                if score > 0:
                    scores.append((-score, i is None, i))
            out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
        return sorted(out, key=repr)

    def tables(self, seed, n):
        rng = random.Random(seed)
        vocabulary = ["the", "The", "of", "é", "É", "12", "a1"] + [f"w{k}" for k in range(120)]
        text = lambda size: " ".join(vocabulary[min(int(rng.expovariate(0.04)), len(vocabulary) - 1)] + rng.choice(["", ",", ".\n", "-x"]) for _ in range(rng.randrange(size)))
        docs = [(k, text(60)) for k in range(n)]
        docs += [(1000 + k, "w5 w6 w7 w8") for k in range(40)]  # a group of copies, all equally good
        docs += [(3, "w9 w9"), (None, "w9 the"), (None, None), (5000, ""), (5001, "?!"), (5002, "w110 " * 3000), (-7, "w9 w9")]
        items = [(k, text(30)) for k in range(25)] + [(30, None), (31, ""), (32, "nowhere"), (33, "w5 w5 w6"), (34, "w9"), (35, "the " * 300 + "w110")]
        return docs, items

    @pytest.mark.parametrize("small", [False, True])
    def test_like_all_pairs(self, spark, monkeypatch, small):
        """Whatever the sizes of hierarchies, groups, blocks and samples."""
        docs, items = self.tables(8, 300)
        if small:
            for name, value in (("TREE", 40), ("LEAF_DOCS", 3), ("LEAF_ITEMS", 2), ("GROUP", 7), ("ITEMS", 13), ("SAMPLE", 10), ("SALTS", 3), ("CELLS", 200)):
                monkeypatch.setattr(search, name, value)
        table = documents(spark, docs).withColumn("terms", F.lit(1)).withColumn("rank", F.lit(2)).repartition(3)
        asked = spark.createDataFrame(items, "item_id long, text string").withColumn("number", F.lit(1)).coalesce(1)
        got = search.search(table, asked, 5)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == self.brute(docs, items, 5)

    def test_empty(self, spark):
        asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
        assert search.search(documents(spark, []), asked).count() == 0
        assert search.search(documents(spark, [(1, "a")]), asked.limit(0)).count() == 0
        assert [tuple(r)[:3] for r in search.search(documents(spark, [(1, "a")]), asked).collect()] == [(1, 1, 1)]

    def test_bounds_leave_out_pairs(self):
        """Documents that share nothing with an item are never scored against it, and no result is lost."""
        rng = np.random.default_rng(2)
        at = np.arange(0, 4 * 2001, 4)
        columns = np.sort(np.stack([rng.choice(200, 4, replace=False) + 200 * (r % 10) for r in range(2000)]), 1).ravel()
        docs = search.Sparse(at, columns, rng.integers(1, 1000, len(columns)))
        wanted = search.Sparse(np.arange(0, 4 * 41, 4), np.sort(np.stack([rng.choice(200, 4, replace=False) + 200 * (r % 10) for r in range(40)]), 1).ravel(), rng.integers(1, 5000, 160))
        (group,) = search.group_items(wanted)
        column = np.full(2000, -1)
        column[group.terms] = np.arange(len(group.terms))
        mine = np.flatnonzero(column[docs.columns] >= 0)
        rows = np.repeat(np.arange(2000), 4)[mine]
        known = search.Sparse(np.searchsorted(rows, np.arange(2001)), column[docs.columns[mine]], docs.values[mine].astype(float))
        best = search.Best(group.numbers, np.zeros(40, np.int64), 20)
        scored = search.dual_search(group, known, np.arange(2000), np.zeros(2000, bool), best)
        dense, asked = np.zeros((2000, 2000)), np.zeros((40, 2000))
        dense[np.repeat(np.arange(2000), 4), docs.columns] = docs.values
        asked[np.repeat(np.arange(40), 4), wanted.columns] = wanted.values
        every = asked @ dense.T
        for number, (scores, ids, _) in zip(best.numbers, best.found, strict=True):
            order = [i for i in np.lexsort((np.arange(2000), -every[number]))[:20] if every[number, i] > 0]
            assert sorted(ids) == sorted(order) and sorted(scores) == sorted(every[number, order])
        assert scored < 40 * 2000 / 2
