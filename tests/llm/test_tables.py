"""Duplicates, shards, archives and classifiers: against brute force, and on odd rows."""

import io
import random
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codefacts.llm import exact_dedup, linear, minhash, near_dedup, quality, shards, toxicity, warc
from codefacts.llm.queries import ORACLES, QUERIES
from llm.test_text_operators import ODD, docs_of, word_list

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    w = word_list(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_classes(rows):
    """doc_id -> smallest id of its class, all pairs compared."""
    text = {i: t or "" for i, t in rows if i is not None}
    sets, parent = {i: shingle_set(t) for i, t in text.items()}, {i: i for i in text}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(text)
    for a in ids:
        for b in ids:
            if a < b and (text[a] == text[b] or (sets[a] | sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9)):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


class TestExactDedup:
    def test_heavy_and_light_groups(self, spark):
        rng = random.Random(4)
        texts = ["hot"] * 60 + [rng.choice("abcdefgh") for _ in range(60)] + [*ODD, None, "", "A", "a "]
        rows = exact_dedup.groups(docs_of(spark, texts), tracked=4).collect()
        assert len(rows) == len(texts)
        for r in rows:
            same = [i for i, t in enumerate(texts) if (t or "") == (texts[r.doc_id] or "")]
            assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), r.doc_id == max(same))

    def test_frequent_are_verified_and_few(self, spark):
        rows = docs_of(spark, ["hot"] * 50 + [str(i) for i in range(200)]).select("doc_id", F.col("text").alias("digest"))
        found = exact_dedup.frequent(rows, 10).collect()
        assert [(r.digest, r.keep_id, r.group_size) for r in found] == [("hot", 49, 50)]

    def test_nulls_repeats_and_empty_table(self, spark):
        df = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (None, "a"), (None, "b"), (3, None), (4, "")], "doc_id long, text string")
        got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.groups(df).collect()), key=repr)
        want = [(1, 2, 4, False), (2, 2, 4, True), (2, 2, 4, True), (3, 4, 2, False), (4, 4, 2, True), (None, 2, 4, False), (None, None, 1, True)]
        assert got == sorted(want, key=repr)
        kept = exact_dedup.keep_one(docs_of(spark, ["x", "x", "y"]))
        assert kept.columns == docs_of(spark, ["x"]).columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
        assert exact_dedup.groups(df.limit(0)).count() == 0

    def test_main_path_has_no_python(self, spark):
        plan = exact_dedup.groups(docs_of(spark, ["a"]))._jdf.queryExecution().toString()
        assert "Python" not in plan and "InArrow" not in plan and "Pandas" not in plan


class TestNearDedup:
    def variants(self):
        rng = random.Random(6)
        base = [f"w{i}" for i in range(120)]
        texts = []
        for _ in range(25):  # a group that drifts: some pairs are alike enough, others are not
            words = base[:]
            for _ in range(rng.randrange(6)):
                words[rng.randrange(len(words))] = f"z{rng.randrange(1000)}"
            texts.append(" ".join(words))
            base = words if rng.random() < 0.3 else base
        return [*ODD, *texts, texts[0], "a b c", "A, b. c", "a b d", " ".join(f"q{i}" for i in range(40))]

    def test_same_as_all_pairs(self, spark):
        texts = self.variants()
        rows = near_dedup.classes(docs_of(spark, texts)).collect()
        want = brute_classes(list(enumerate(texts)))
        assert {r.doc_id: r.class_id for r in rows} == want
        sizes = {c: list(want.values()).count(c) for c in want.values()}
        assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in rows)

    def test_repeats_nulls_and_empty_table(self, spark):
        df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
        assert sorted((r.doc_id, r.class_id) for r in near_dedup.classes(df).collect()) == [(1, 1), (2, 1)]
        assert near_dedup.classes(df.limit(0)).count() == 0
        docs = docs_of(spark, ["a b c d e f", "A b c d e f", "other"])
        kept = near_dedup.keep_one(docs)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2]

    def test_repeated_lines_weigh_once(self, spark):
        """The same shingles, of which some occur k times."""
        texts = [" ".join(f"t{i}w{j}" for j in range(200)) + f" footer {' '.join(f'f{i}w{j}' for j in range(10))}" * k for i in range(6) for k in (1, 100)]
        got = {r.doc_id: r.class_id for r in near_dedup.classes(docs_of(spark, texts)).collect()}
        assert got == brute_classes(list(enumerate(texts))) == {i: i - i % 2 for i in range(len(texts))}

    def test_components(self, spark):
        rng = random.Random(2)
        links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
        got = {r.doc: r["class"] for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
        label = {x: x for p in links for x in p}
        for _ in range(80):
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        assert {k: v for k, v in label.items() if k in got} == got
        assert all(label[k] == k for k in label if k not in got)

    def test_registers_estimate_probability_jaccard(self):
        """Weights are counts: the share of equal registers follows the probability Jaccard similarity."""
        x, y = {1: 3, 2: 1, 3: 1, 4: 2}, {1: 1, 2: 1, 3: 4, 5: 2}
        want = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in {*x, *y}) for i in x if i in y)
        value = minhash.W.mix(np.arange(1, 6, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        rows = np.array([0] * 4 + [1] * 4)
        values = np.concatenate([value[[k - 1 for k in x]], value[[k - 1 for k in y]]])
        owner, _ = minhash.signatures(rows, values, np.array([*x.values(), *y.values()]), 2, 4096)
        assert abs((owner[0] == owner[1]).mean() - want) < 0.04

    def test_ids_with_several_texts(self, spark):
        a, b = "one two three four five six", "seven eight nine ten eleven twelve"
        long = " ".join(f"w{k}" for k in range(60))
        rows = [(1, a), (2, a), (2, b), (3, b), (4, "alone"), (5, long), (6, long + " end"), (6, "other words"), (7, "other words"), (8, None), (8, "x y"), (9, "")]
        got = {r.doc_id: (r.class_id, r.class_size, r.kept) for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        classes = [{1, 2, 3}, {4}, {5, 6, 7}, {8, 9}]
        assert got == {i: (min(c), len(c), i == min(c)) for c in classes for i in c}

    def test_sketches_rule_out_only_unlike_texts(self, spark):
        n = near_dedup.REGISTERS // 16
        df = spark.createDataFrame([([0] * n, [0] * n), ([0] * n, [-1] * n)], "a array<long>, b array<long>")
        assert [r.x for r in df.select(near_dedup.sketches_agree(F.col("a"), F.col("b"), 0.69).alias("x")).collect()] == [True, False]


class TestRanges:
    def test_many_tiny_records_are_divided(self, spark, monkeypatch):
        """A third of all rows are empty: no window of one task holds them, and the law holds as ever."""
        texts = ["x" * 400 + str(k) for k in range(4000)] + [""] * 2000 + [None] * 500
        frames, real = [], shards.materialize
        monkeypatch.setattr(shards, "materialize", lambda df: frames.append(real(df)) or frames[-1])
        rows = shards.assign(docs_of(spark, texts), 8).collect()
        held = {(r["range"], r["sub"]): r["count"] for f in frames if "sub" in f.columns and "shard" not in f.columns for r in f.groupBy("range", "sub").count().collect()}
        assert max(held.values()) < 5 * len(texts) / shards.LEAST_RANGES
        total = sum(r.size for r in rows)
        for k in range(8):
            mine = [r for r in rows if r.shard == k]
            assert abs(sum(r.size for r in mine) - total / 8) <= 404 and sorted(r.slot for r in mine) == list(range(len(mine)))


class TestShards:
    @pytest.mark.parametrize("texts", [["x" * (k % 37) for k in range(900)], ["copy of a long text"] * 500 + [str(k) * (k % 9 + 1) for k in range(700)], [*ODD], ["a"]])
    def test_law(self, spark, texts):
        rows = shards.assign(docs_of(spark, texts), 8).collect()
        assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
        size = [len((t or "").encode()) + 1 for t in texts]
        assert all(r.size == size[r.doc_id] and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in rows)
        held = [sum(r.size for r in rows if r.shard == k) for k in range(8)]
        assert all(abs(h - sum(size) / 8) <= max(size) for h in held)
        for k in range(8):
            assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))

    def test_nulls_repeats_and_empty_table(self, spark):
        df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, None)], "doc_id long, text string")
        assert shards.assign(df, 2).count() == 4
        assert shards.assign(df.limit(0), 2).count() == 0


class TestWarc:
    def pages(self, spark):
        long = "<p>" + "text " * 60
        rows = [(5, "http://a", long), (2, "http://b", long), (9, None, long), (7, "u\r\nx", "short"), (8, "u", "short"), (1, "u", None), (3, "u", ""), (4, "ü", "é" * 5000), (5, "http://a", long)]
        return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("response", F.lit("x")).withColumn("payload_digest", F.lit("x"))

    def test_round_trip(self, spark, monkeypatch):
        pages = self.pages(spark).repartition(1)
        monkeypatch.setattr(warc, "PACKAGE", 700)  # several packages in a task
        packages = warc.materialize(warc.write_packages(pages, warc.archive_folder(spark)))
        assert packages.agg(F.sum("records")).first()[0] == 9
        rows = warc.read_packages(packages).collect()
        html = {r.page_id: r.html or "" for r in pages.collect()}
        assert sorted(r.page_id for r in rows) == sorted([5, 2, 9, 7, 8, 1, 3, 4, 5])
        for r in rows:
            payload = html[r.page_id].encode()
            assert r.payload_bytes == len(payload)
            same = [i for i, h in html.items() if h.encode() == payload and len(payload) >= 100]
            first = min(same, default=r.page_id)
            assert (r.record_type, r.refers_to) == (("response", None) if first == r.page_id else ("revisit", first))
            assert r.payload == (payload if r.record_type == "response" else None)
        assert warc.read_packages(warc.materialize(warc.write_packages(pages.limit(0), warc.archive_folder(spark)))).count() == 0

    def test_ids_that_repeat_or_are_missing(self, spark):
        """A role belongs to an id and its payload together; what is written is read back whole."""
        a, b, c, d = "a" * 150, "b" * 150, "c" * 150, "d" * 150
        given = [(1, a), (2, a), (2, b), (None, b), (None, c), (3, c), (None, d), (None, d), (None, "x"), (4, None), (4, ""), (5, a), (5, a), (1, a)]
        pages = spark.createDataFrame(given, "page_id long, html string").withColumn("url", F.lit("u"))
        rows = warc.read_packages(warc.materialize(warc.write_packages(pages, warc.archive_folder(spark)))).collect()
        first = {a: 1, b: 2, c: 3}
        want = []
        for i, h in given:
            to = first.get(h) if h in first and first[h] != i else None
            want.append((i, "revisit" if to else "response", to, len(h or ""), None if to else (h or "").encode()))
        assert sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload) for r in rows), key=repr) == sorted(want, key=repr)

    @pytest.mark.parametrize("zip64", [False, True])
    def test_packages_and_zipfile_agree(self, zip64):
        class Kept(io.BytesIO):
            def close(self):
                pass

        out = Kept()
        writer = warc.PackageWriter(out, zip64)
        writer.member("a/x", iter([b"one", b"two"]))
        writer.member("é", iter([b""]))
        writer.close()
        data = out.getvalue()
        found = warc.members(lambda a, n: data[a : a + n], len(data))
        assert [(m.name, data[m.start : m.start + m.size]) for m in found] == [("a/x", b"onetwo"), ("é", b"")]
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            assert z.testzip() is None and z.read("a/x") == b"onetwo"

    def test_reads_packages_of_others(self):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            z.writestr("one", b"1" * 10)
            with z.open("two", "w", force_zip64=True) as f:
                f.write(b"22")
            z.comment = b"PK\x05\x06 a comment"
        data = out.getvalue()
        assert [(m.name, data[m.start : m.start + m.size]) for m in warc.members(lambda a, n: data[a : a + n], len(data))] == [("one", b"1" * 10), ("two", b"22")]
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("packed", b"1" * 100)
        with pytest.raises(ValueError, match="not stored"):
            warc.members(lambda a, n: out.getvalue()[a : a + n], len(out.getvalue()))
        with pytest.raises(ValueError, match="no end"):
            warc.members(lambda a, n: b"x" * n, 100)


class TestClassifiers:
    def auc(self, scores, labels):
        order = np.argsort(np.argsort(scores))
        ones = labels == 1
        return (order[ones].mean() - (ones.sum() - 1) / 2) / max(1, (~ones).sum())

    @pytest.mark.parametrize(("module", "target", "least"), [(toxicity, "toxic", 0.85), (quality, "quality", 0.95)])
    def test_held_out(self, spark, module, target, least):
        sf = "/root/testdata/sf0.1"
        docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
        scored = module.score(docs, module.fit(docs, labels)).join(labels, "doc_id").filter(linear.fold(F.col("doc_id")) == 2)
        rows = scored.select("score", target).collect()
        assert self.auc(np.array([r.score for r in rows]), np.array([r[target] for r in rows])) > least

    def test_odd_rows_and_tables(self, spark):
        docs = docs_of(spark, [*ODD, "good words here"])
        labels = spark.createDataFrame([(None, 1, 0), (1, None, None), (4, 1, 0), (4, 1, 0), (9, 0, 1), (11, 1, 0)], "doc_id long, quality int, toxic int")
        for module in (toxicity, quality):
            for known in (labels, labels.limit(0)):
                rows = module.score(docs, module.fit(docs, known)).collect()
                assert len(rows) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in rows)
            assert module.score(docs.limit(0), module.fit(docs.limit(0), labels)).count() == 0
        kept = toxicity.reject(docs, toxicity.fit(docs, labels.limit(0)), threshold=0.6)
        assert kept.columns == docs.columns and kept.count() == docs.count()

    def test_swaps_of_group_names(self):
        alter = toxicity.swaps((("cats", "dogs"),), 2)
        assert alter("All CATS run.") == ["All dogs run."] * 2
        assert all("cats" in x or "dogs" in x for x in alter("Nothing here. At all."))

    def test_fairness_pulls_group_names_to_nothing(self):
        """Rows that differ in a group's name only: the more the change of score costs, the smaller it is."""

        def features(text):
            return toxicity.FEATURES.of(pa.array([text]))[1].astype(np.int32)

        rng = random.Random(0)
        texts, labels = [], []
        for k in range(400):
            bad = k % 2
            texts.append(" ".join(["the"] + ([rng.choice(["rotten", "vile"])] if bad and rng.random() < 0.8 else ["nice"]) + (["dogs"] if rng.random() < (0.9 if bad else 0.1) else ["cats"])))
            labels.append(bad)
        alter = toxicity.swaps((("cats", "dogs"),), 1)
        sample = linear.Sample(np.array(labels), [features(t) for t in texts], [[features(a) for a in alter(t)] for t in texts])
        change = []
        for fairness in (0.0, 50.0):
            model = toxicity.fit_sample(sample, fairness)
            a, b = model.margins(pa.array(["the nice cats", "the nice dogs"]))
            change.append(abs(a - b))
        assert change[1] < 0.3 * change[0]

    def test_labels_of_the_held_out_fold_are_not_read(self, spark):
        docs = docs_of(spark, [f"w{i}" for i in range(40)])
        labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
        sample = linear.labelled_sample(docs, labels, "toxic", toxicity.FEATURES)
        assert len(sample.labels) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(40))
        assert len(linear.labelled_sample(docs, labels, "toxic", toxicity.FEATURES, rows=5).labels) == 5


def test_pipeline_against_brute_force(spark):
    """Each stage on its own input; toxicity and encoding are held against their operators, the rest against brute force."""
    import corpus_pipeline
    from llm.test_text_operators import brute_hits

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "bpe"]
    read = lambda df: {r.doc_id: r.text for r in df.collect()}
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        new = warc.materialize(stage(spark, at, SF))
        before = read(at)
        if name == "toxicity":
            model = toxicity.fit(at, spark.read.parquet(f"{SF}/labels.parquet"))
            want = {r.doc_id for r in toxicity.score(at, model).collect() if r.score < toxicity.THRESHOLD}
        elif name == "exact_dedup":
            want = set({t or "": i for i, t in sorted(before.items())}.values())
        elif name == "near_dedup":
            want = {i for i, c in brute_classes(list(before.items())).items() if i == c}
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            ids = list(before)
            want = {i for i, (n, h, _) in zip(ids, brute_hits([before[i] for i in ids], items), strict=True) if not (h and 20 * h >= n)}
        else:
            want = set(before)
        assert {r.doc_id for r in new.select("doc_id").collect()} == want, name
        if name != "bpe":
            assert new.columns == docs.columns
        at = new


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SF)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(key, got.select(*want.columns).collect())) == sorted(map(lambda r: tuple(str(x) for x in r), want.fetchall()))
