"""Encoding, decontamination, personal data, page texts: against brute force, and on odd rows."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codefacts.llm import bpe, decontamination, maintext, pii
from codefacts.llm import words as W
from codefacts.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def word_list(text):
    return WORD.findall(lower(text or ""))


ODD = [None, "", " ", "...", "a", "é日🎉", "A b" * 3, "x" * 5000, "w1 " * 9000, "\x00\x01 a\x00b", "'ll don't  x \n\n y "]


def docs_of(spark, texts, extra=True):
    """A documents table with columns whose names the operators use themselves."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    if extra:
        for name in ("n_words", "spans", "items", "digest", "ids", "label", "score", "kept", "class", "key", "email", "doc", "a b.c"):
            df = df.withColumn(name, F.lit("x"))
    return df


class TestWords:
    def test_words_of_rows_in_pieces(self):
        texts = [*ODD, "abc", "def", "é" * 70, "one two three " * 50]
        data, offsets = W.string_buffers(pa.array(texts))
        for size in (7, 64, 1 << 20):
            got = {}
            for lo, hi in W.pieces(data, offsets, size):
                w = W.words_of(data, offsets, lo, hi)
                for row, a, b in zip(w.rows.tolist(), w.starts.tolist(), w.ends.tolist(), strict=True):
                    got.setdefault(row, []).append(lower(bytes(data[a:b]).decode()))
            assert [got.get(i, []) for i in range(len(texts))] == [word_list(t) for t in texts]

    def test_equal_words_have_equal_hashes(self):
        found = list(W.row_words(pa.array(["The cat", "the CAT", "cat"])))
        hashes = np.concatenate([h for h, _ in found])
        assert hashes[0] == hashes[2] and hashes[1] == hashes[3] == hashes[4] and hashes[0] != hashes[1]


@pytest.fixture(scope="module")
def machine():
    return bpe.automaton(bpe.packed_file(tokenizer_path()))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


class TestBpe:
    def test_same_ids_as_the_library(self, machine, library):
        rng = random.Random(5)
        alphabet = ["a", "b", "the", " ", "  ", "\n", "é", "日", "🎉", "'s", "'", "0", "19", "-=", "<|endoftext|>", "ing", "e", "t"]
        texts = [t or "" for t in ODD] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(1500)] + ["a" * k for k in range(1, 40)]
        for text, found in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
            ids = machine.encode(text)
            assert np.frombuffer(ids, "<u4").tolist() == found.ids, text
            assert machine.decode(ids) == library.decode(found.ids, skip_special_tokens=False)

    def test_long_text_is_cut_only_where_no_token_is(self, machine, library, monkeypatch):
        monkeypatch.setattr(bpe, "PIECE", 50)
        text = "One two, three   four\n five's 66 " * 40
        assert np.frombuffer(machine.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids

    def test_only_right_paths_exist(self, machine):
        """Of all token sequences that spell a word, the automaton has a path for one."""

        def spell(word, path):
            if not word:
                yield path
            for n in range(1, len(word) + 1):
                for token in by_label.get(word[:n], ()):
                    yield from spell(word[n:], [*path, token])

        by_label = {}
        for token in machine.ends:
            by_label.setdefault(machine.labels[token], []).append(token)
        for word in (b"hello", b" there", b"aaaa", b"ation"):
            right = [p for p in spell(word, []) if all(machine._arc(a, b) for a, b in zip(p, p[1:], strict=False))]
            assert right == [machine.encode_word(word)]

    def test_table(self, spark, library):
        texts = [*ODD, "same", "same"]
        rows = bpe.encode(docs_of(spark, texts), tokenizer_path(), decoded=True).orderBy("doc_id").collect()
        assert [r.decoded for r in rows] == [t or "" for t in texts]
        assert [r.n_tokens for r in rows] == [len(library.encode(t or "").ids) for t in texts]
        back = bpe.decode(bpe.encode(docs_of(spark, texts), tokenizer_path()), tokenizer_path()).orderBy("doc_id").collect()
        assert [r.text for r in back] == [t or "" for t in texts]
        assert bpe.encode(docs_of(spark, texts).limit(0), tokenizer_path()).count() == 0


def brute_hits(texts, items):
    phrases = {}
    for item, text in items:
        w = word_list(text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            phrases.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for text in texts:
        w, found = word_list(text), set()
        hit = [0] * len(w)
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                if (owners := phrases.get(tuple(w[k : k + n]))) is not None:
                    found |= owners
                    hit[k : k + n] = [1] * n
        out.append((len(w), sum(hit), sorted(str(i) for i in found if i is not None)))
    return out


class TestDecontamination:
    def texts(self):
        rng = random.Random(2)
        words = ["a", "b", "c", "Dé"]
        say = lambda n: " ".join(rng.choice(words) for _ in range(n))
        return [*ODD, *[say(rng.randrange(90)) for _ in range(40)], "one two " * 30], [(k, say(rng.randrange(1, 22))) for k in range(12)] + [(90, None), (91, "..."), (None, "one two"), (92, "b a"), (92, "b a")]

    @pytest.mark.parametrize("block", [16 << 20, 40])
    def test_same_as_brute_force(self, spark, block):
        texts, items = self.texts()
        benchmark = spark.createDataFrame(items, "item_id long, text string")
        got = decontamination.mark(docs_of(spark, texts), benchmark, block).orderBy("doc_id").collect()
        want = brute_hits(texts, items)
        assert [(r.n_words, r.n_hit, list(r["items"])) for r in got] == want
        assert [r.contaminated for r in got] == [h > 0 and 20 * h >= n for n, h, _ in want]
        for r, text in zip(got, texts, strict=True):
            for s in r.spans:
                assert word_list(text[s.start : s.end]) == word_list(text)[s.first_word : s.end_word]

    def test_drop_keeps_columns_and_clean_rows(self, spark):
        texts, items = self.texts()
        docs, benchmark = docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")
        kept = decontamination.drop(docs, benchmark, 40)
        assert kept.columns == docs.columns
        want = [i for i, (n, h, _) in enumerate(brute_hits(texts, items)) if not (h and 20 * h >= n)]
        assert sorted(r.doc_id for r in kept.collect()) == want

    def test_empty_tables(self, spark):
        docs, benchmark = docs_of(spark, ["a b c"]), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
        assert decontamination.mark(docs.limit(0), benchmark).count() == 0
        assert decontamination.mark(docs, benchmark.limit(0)).first().n_hit == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def right(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        doubled = [int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return True


class TestPii:
    def test_base_matches(self, spark):
        rng = random.Random(3)
        parts = ["a", "b@c.d", ".", "@", "x.y", "+1", " ", "-", "4111111111111111", "1.2.3.4", "255", "256", "(", "9", "é", "🎉", "..", "%", "\n", "+44 20 7946 0958"]
        texts = [*ODD, "a@b" + ".c" * 2000, "a@b.c " * 600, "1" * 3000, *["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(400)]]
        rows = pii.span_texts(pii.find(docs_of(spark, texts))).orderBy("doc_id").collect()
        for r, text in zip(rows, texts, strict=True):
            found = {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if right(k, m.group())] for k, p in PATTERNS.items()}
            assert r.base == ",".join(f"{k}:{a}:{b}" for k, spans in found.items() for a, b in spans), text
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(x) for x in found.values()]
            assert set(r.base.split(",")) <= set(r.spans.split(","))

    def test_contexts_discover_and_leave_the_rest(self, spark):
        texts = [f"call me at +1 (415) 555-{1000 + i} please" for i in range(20)] + ["call me at 555-12345 please now", "I saw 555-12345 rows", "room 12"]
        rows = pii.span_texts(pii.find(docs_of(spark, texts))).orderBy("doc_id").collect()
        assert [r.spans for r in rows[20:]] == ["phone:11:20", "", ""]

    def test_all_trusted_patterns_count(self, spark):
        """More patterns than the 2000 that were once kept; every one discovers its token."""
        name = lambda g: "".join(chr(97 + g // 26**k % 26) for k in range(3))
        texts = [" ".join(f"{name(g)}x {name(g)}y +1 415 {1000000 + 10 * g + i} {name(g)}z" for i in range(5)) for g in range(2100)]
        docs = docs_of(spark, texts + [f"{name(g)}x {name(g)}y 555-{12345 + g} {name(g)}z" for g in range(2100)] * 2, extra=False)
        rows = pii.find(docs).filter("doc_id >= 2100").select(F.col("found.kind").alias("kinds")).collect()
        assert len(rows) == 4200 and all(r.kinds == ["phone"] for r in rows)

    def test_secrets_are_discovered_by_their_context(self, spark):
        """Digests after ``token =`` are seeds; what else stands there is discovered, what stands elsewhere is not."""
        digest = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
        texts = [f'set token = "{digest(i)}" now' for i in range(8)] + ['my token = "sk_live_9aZ8bY7cX6dW5e" here', f"commit {digest(99)} done", "token = 7", "total: 1234567890abcdefXYZ"]
        rows = pii.span_texts(pii.find(docs_of(spark, texts))).orderBy("doc_id").collect()
        assert [r.spans for r in rows[:8]] == ["secret:13:53"] * 8 and [r.spans for r in rows[8:]] == ["secret:12:34", "", "", ""]
        assert all(r.n_found == (r.spans != "") and r.base == "" for r in rows)

    def test_scoring_like_a_loop(self, spark):
        """Trust of patterns and belief of instances, computed from the edges by hand until the trusted set repeats."""
        rng = random.Random(12)
        edges = {(f"p{rng.randrange(14)}", f"i{rng.randrange(60)}") for _ in range(260)}
        seeds = {f"i{k}": ("phone" if k % 3 else "email") for k in range(36)}
        kinds = {(p, i): (seeds[i] if i in seeds and rng.random() < 0.95 else None) for p, i in edges}
        belief = {(p, i, k): 1.0 if k else 0.0 for (p, i), k in kinds.items()}
        seen, trusted = [], {}
        while True:
            trusted = {}
            for p in {p for p, _, _ in belief}:
                instances = {i for q, i, _ in belief if q == p}
                for kind in ("phone", "email"):
                    own = [(i, b) for (q, i, k), b in belief.items() if q == p and k == kind and b > 0]
                    if len({i for i, _ in own}) >= pii.SUPPORT and sum(b for _, b in own) / len(instances) >= 0.35:
                        trusted[p, kind] = sum(b for _, b in own) / len(instances)
            if not trusted or set(trusted) in seen:
                break
            seen.append(set(trusted))
            belief = {(p, i, k): 1.0 for (p, i), k in kinds.items() if k}
            for (p, i), k in kinds.items():
                if k is None:
                    near = {}
                    for (q, j), kk in kinds.items():
                        if j == i and kk is None:
                            for kind in ("phone", "email"):
                                if (q, kind) in trusted:
                                    near.setdefault(kind, []).append(trusted[q, kind])
                    for kind, ts in near.items():
                        belief[p, i, kind] = 1 - math.prod(max(1e-9, 1 - t) for t in ts)
                    if not near:
                        belief[p, i, None] = 0.0
        old, pii.TRUST = pii.TRUST, 0.35
        try:
            table = spark.createDataFrame([(p, i, k, 1) for (p, i), k in kinds.items()], "pattern string, instance string, kind string, n long")
            got = {(r.pattern, r.kind): r.trust for r in pii.trusted_patterns(table).collect()}
        finally:
            pii.TRUST = old
        assert got.keys() == trusted.keys() and len(got) >= 3 and all(abs(got[k] - trusted[k]) < 1e-9 for k in got)

    def test_contexts_are_general(self, spark):
        texts = [f"{w} {n}: +1 415 {5551000 + n} {w}" for n, w in enumerate(["Ring", "ring,", "(RING", "ring", "ring!", "ring;"])] + ["ring 77 555-12345 now"]
        rows = pii.span_texts(pii.find(docs_of(spark, texts))).orderBy("doc_id").collect()
        assert rows[-1].spans == "phone:8:17"

    def test_empty_table(self, spark):
        assert pii.span_texts(pii.find(docs_of(spark, ["a"]).limit(0))).count() == 0


class TestMainText:
    PAGE = (
        '<html><head><title>T</title></head><body><nav>menu one</nav><div class="cookie-notice">we use</div><article><h1>Head</h1>'
        "<p>One &lt;two&gt; <b>thr</b>ee.<p>More   text\n here.<aside>side</aside><form><button>Send</button></form>"
        "<section class=comments><p>reader says</p></section><ul><li>last</ul></article><footer>&copy; foot</footer><script>var x = '<p>no</p>'</script>"
    )
    TEXT = "Head One <two> three. More text here. last"

    def table(self, spark, pages):
        return spark.createDataFrame([(i, f"u{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string").withColumn("text", F.lit("x"))

    def test_regions(self, spark):
        pages = [self.PAGE] * 3 + [None, "", "plain words only", "<p>a", "<<<>>", "<script>x", "<!-- a", "<p>" * 3000 + "deep", self.PAGE.replace("One", "One " * 3000)]
        df = self.table(spark, pages)
        for scores in (maintext.fit(df), {}):
            got = [r.text for r in maintext.extract(df, scores).orderBy("page_id").collect()]
            assert got[:3] == [self.TEXT] * 3 and got[3:10] == ["", "", "plain words only", "a", "<<<>>", "", ""]
            assert got[10] == "deep" or scores == {} or got[10] == ""
            assert got[11] == self.TEXT.replace("One", ("One " * 3000).strip())

    @pytest.mark.parametrize("attribute", ['class="layout has-sidebar"', 'class="no-comments"', 'id="sidebar-layout"', 'class="related"', 'class="widget"', "role=banner"])
    def test_class_words_around_the_article_leave_it(self, attribute):
        page = self.PAGE.replace("<article>", f"<div {attribute}><article>").replace("</article>", "</article></div>")
        assert maintext.main_text(page, {}) == self.TEXT

    def test_class_words_lower_scores(self):
        text = "<p>" + "some words of the text " * 10 + "</p>"
        whole = " ".join(("some words of the text " * 10).split())
        parts = [f'<div class="x-widget x-widget-text-editor">{text}</div>' for _ in range(3)]
        assert maintext.main_text("".join(parts), {}) == " ".join([whole] * 3)
        assert maintext.main_text(f"<div class=comments>{text}</div>", {}) == whole
        share = '<div class="share-buttons"><a>one</a> <a>two</a></div><section class="related-posts"><article>card</article></section>'
        assert maintext.main_text(f"<main>{text}{share}{text}</main>", {}) == f"{whole} {whole}"
        assert maintext.label_counts(f"<article>{parts[0]}</article>")["w p", True] == 50

    def test_attributes_of_any_length(self):
        long = "<p>before <img src=data:" + "x" * 5000 + ' alt=y> after<p title="' + "<" * 9000 + '">end'
        assert maintext.main_text(long, {}) == "before after end"

    def test_scan_finds_the_best_region(self):
        """The linear scan against all regions."""
        rng = random.Random(1)
        tags = ["<p>", "</p>", "<div>", "</div>", "<li>", "<a>", "</a>", "words here ", "one "]
        for _ in range(60):
            page = "".join(rng.choice(tags) for _ in range(25))
            seen = maintext.tokens(page)
            value = [maintext.default_score(k) * (n if k[0] == "w" else 1) for k, _, n, _ in seen]
            best = max((sum(value[a:b]) for a in range(len(value)) for b in range(a + 1, len(value) + 1)), default=0)
            text = maintext.main_text(page, {})
            assert (best > 0) == bool(text.strip()) or best <= 1e-9

    def test_empty_table(self, spark):
        df = self.table(spark, ["a"]).limit(0)
        assert maintext.fit(df) == {} and maintext.extract(df, {}).count() == 0


def test_queries_have_their_columns(spark):
    from codefacts.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    tokens = QUERIES["op10_bpe"](spark, sf)
    assert tokens.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r.decoded_sha256 == hashlib.sha256((text[r.doc_id] or "").encode()).hexdigest() for r in tokens.collect())
