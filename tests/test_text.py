"""Decoding, white space and line counting against Python's own behaviour."""

import random

from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from codefacts.functions import paths, text

ODD = "a#/ \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0  　é中"


def py_decode(raw: bytes) -> str:
    raw = raw.removeprefix(b"\xef\xbb\xbf")
    for enc in ("utf-8", "gb18030"):
        try:
            return raw.decode(enc)
        except UnicodeDecodeError:
            pass
    return raw.decode("utf-8", errors="replace")


def py_code(t: str) -> int:
    return sum(1 for ln in t.splitlines() if ln.strip() and not ln.strip().startswith(("#", "//")))


def test_lines_like_python(spark):
    rng = random.Random(7)
    texts = ["", "\n", "a", "a\n", "\r\n", "a\r\nb\r", " # x\n// y\nz"] + ["".join(rng.choice(ODD) for _ in range(rng.randrange(40))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = df.select("i", text.split_lines("t").alias("ls"), text.code_lines("t").alias("code"), text.total_lines("t").alias("n"), text.strip("t").alias("s"))
    for r in out.collect():
        t = texts[r.i]
        assert r.ls == t.splitlines(), repr(t)
        assert r.code == py_code(t), repr(t)
        assert r.n == t.count("\n") + (1 if t and not t.endswith("\n") else 0)
        assert r.s == t.strip(), repr(t)


def test_decode_like_python(spark):
    rng = random.Random(3)
    blobs = [b"", b"\xef\xbb\xbfx = 1", "路径".encode("gbk"), "é".encode(), b"\xff\xff\xff", b"a\x00b"] + [bytes(rng.randrange(256) for _ in range(6)) for _ in range(200)]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blobs)], "i int, c binary")
    for r in df.select("i", text.decode_text("c").alias("t")).collect():
        assert r.t == py_decode(blobs[r.i]), blobs[r.i]


def test_path_functions(spark):
    cases = {"a/b.PY": ".py", ".bashrc": "", "a/.x": "", "x.tar.gz": ".gz", "noext": "", "a.b/c": ""}
    df = spark.createDataFrame(list(cases.items()), "p string, want string")
    assert all(r.want == r.got for r in df.select("want", paths.extension("p").alias("got")).collect())
    one = spark.range(1).select(
        paths.posix(F.lit("./.x\\a")).alias("posix"), paths.module_name(F.lit("a/b/__init__.py")).alias("m"), paths.owner(F.lit("plugins/x/y.py")).alias("o"),
        paths.owner(F.lit("top.py")).alias("r"), paths.hotspot_group(F.lit("plugins/x/y.py")).alias("g"), paths.hotspot_group(F.lit("plugins/y.py")).alias("g2"),
        paths.churn_group(F.lit("plugins/x/y.py"), "component").alias("c"), paths.stem(F.lit("a/b.c.py")).alias("s"),
    ).first()
    assert tuple(one) == (".x/a", "a.b", "x", "<root>", "plugins/x", "plugins", "plugins/x", "b.c")


@settings(max_examples=20, deadline=None)
@given(hs.text(alphabet=ODD, max_size=30))
def test_first_line(spark, t):
    got = spark.createDataFrame([(t,)], "t string").select(text.first_line("t")).first()[0]
    stripped = t.strip()
    assert got == (stripped.splitlines()[0].strip() if stripped else None)


def test_ends_of_a_text_are_looked_at_without_a_regex(spark):
    """A pattern that ends in ``$`` is tried at every character; line rules strip every line of every file."""
    odd = ["\u2003 a b\u3000\x85", "\x1c\x1d", "\u200b kept \u200b", "\u180e", "x" + " " * 50 + "y \r\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string")
    out = df.select("i", text.strip("t").alias("s"), text.strip_right("t").alias("r"), text.indent_width("t").alias("w"))
    assert "regexp" not in out._jdf.queryExecution().optimizedPlan().toString()
    for r in out.collect():
        t = odd[r.i]
        assert (r.s, r.r, r.w) == (t.strip(), t.rstrip(), len(t) - len(t.lstrip())), repr(t)


def test_a_code_line_is_matched_whole():
    """Else every character of it is tried as the start of another line; negated classes are slow in Java."""
    assert "[^" not in str(text.code_lines("t"))
    assert str(text.code_lines("t")).count("]*+") == 2


def test_lines_are_split_by_a_pattern_that_begins_with_one_class():
    """And the break at the end is looked for at the end: both patterns were tried at every character."""
    plan = str(text.split_lines("t"))
    assert "regexp" not in plan and "\\r\\n|" not in plan
