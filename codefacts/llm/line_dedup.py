"""Lines that many documents share, found by range-partitioned hashes, in DataFrame functions only.

Every line is reduced to its key (white space stripped at both ends, A-Z as a-z) and the key to 128 bits of hash. Hashes are
range-partitioned together with the document, and sorted within a range by hash, document and position: the first
occurrence of a key in a document is where the sorted stream changes, and a key that a third of all lines have spans as
many ranges as it needs. First occurrences are summed up to documents per key before they are dealt out again. What
comes back for a document is not its text but a compressed bitmap of the lines that stay: runs of kept lines.

Null and empty texts have one empty line. Lines of any length count whole. A key shorter than ``least`` code points is
never dropped. Rows that repeat a ``doc_id`` are one document for the counts, and so are all rows without one; each row
still has its own result. An empty table gives an empty result. Other columns are ignored by ``dropped_lines`` and passed on by
``drop_lines``.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codefacts.functions.skew import salted_join
from codefacts.session import materialize

#: white space that is stripped from both ends of a line
BLANKS = " \t\n\x0b\x0c\r"
#: documents from which on a key is dropped, and code points that it has at least
DOCUMENTS, LEAST = 10, 1
#: rows of hashes for each range
RANGE = 1 << 20


def lines_of(text: Column | str) -> Column:
    """The lines of a text, split at line feeds only."""
    return F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), ascii_uppercase, ascii_lowercase)


def _digest(text: Column) -> Column:
    """128 bits of a string."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b"))


def hashed_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, text_a and text_b (the row's text), pos, a and b (its key) of every line whose key is long enough; written once."""
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", _digest(body).alias("t"), F.posexplode(lines_of("text")).alias("pos", "line"))
    keyed = rows.select("doc_id", "t", "pos", key_of(F.col("line")).alias("key"))
    # at least one code point is a test of bytes; counting them is for larger limits
    long = (F.octet_length("key") >= least) if least <= 1 else (F.char_length("key") >= least)
    found = keyed.where(long).select("doc_id", "t", "pos", _digest(F.col("key")).alias("k"))
    return materialize(found.select("doc_id", F.col("t.a").alias("text_a"), F.col("t.b").alias("text_b"), "pos", "k.a", "k.b"))


def frequent_keys(lines: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """a, b and n_docs of keys that at least ``documents`` documents have."""
    ranges = max(1, -(-lines.count() // RANGE))
    dealt = lines.select("a", "b", "doc_id", "pos").repartitionByRange(max(ranges, lines.sparkSession.sparkContext.defaultParallelism), "a", "b", "doc_id")
    # ranges already hold every line of a key and document together, so neither the sort nor the stream moves a row
    stream = Window.partitionBy("a", "b", "doc_id").orderBy("pos")
    first = dealt.withColumn("nth", F.row_number().over(stream)).where("nth = 1")
    return first.groupBy("a", "b").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= documents)


def dropped_lines(docs: DataFrame, documents: int = DOCUMENTS, least: int = LEAST) -> DataFrame:
    """For each document that loses lines, one row per (doc_id, text_a, text_b): ``dropped``, the sorted positions that go.

    The compressed bitmap of a row's lines follows from it by ``runs``.
    """
    lines = hashed_lines(docs, least)
    frequent = materialize(frequent_keys(lines, documents).select("a", "b"))
    gone = salted_join(lines, frequent, ["a", "b"], ["doc_id", "text_a"], "left_semi")
    return gone.groupBy("doc_id", "text_a", "text_b").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def runs(dropped: Column, n_lines: Column) -> Column:
    """The bitmap of kept lines as runs (start from 0, length): what lies between the dropped positions."""
    edges = F.zip_with(
        F.concat(F.array(F.lit(-1)), dropped), F.concat(dropped, F.array(n_lines.cast("int"))),
        lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("length")),
    )
    return F.filter(edges, lambda r: r["length"] > 0)


def bitmaps(docs: DataFrame, documents: int = DOCUMENTS, least: int = LEAST) -> DataFrame:
    """The columns of ``docs`` and ``__lines``, ``__keep`` (runs of kept lines) and ``__dropped`` (how many go) of every row."""
    marked = dropped_lines(docs, documents, least).toDF("__id", "__a", "__b", "__gone")
    rows = docs.withColumn("__t", _digest(F.coalesce(F.col("text"), F.lit("")))).withColumn("__lines", F.size(lines_of("text")).cast("long"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__t.a") == F.col("__a")) & (F.col("__t.b") == F.col("__b"))
    joined = rows.join(marked, same, "left").drop("__t", "__id", "__a", "__b")
    gone = F.coalesce("__gone", F.array().cast("array<int>"))
    return joined.withColumn("__keep", runs(gone, F.col("__lines"))).withColumn("__dropped", F.size(gone).cast("long")).drop("__gone")


def kept_text(text: Column | str, keep: Column, dropped: Column) -> Column:
    """The text of the kept lines; whole texts are passed on as they are."""
    whole = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    # the outer array holds the lines once, so that they are not split again for every run
    once = F.transform(F.array(lines_of(text)), lambda ls: F.flatten(F.transform(keep, lambda r: F.slice(ls, r["start"] + 1, r["length"]))))
    parts = F.flatten(once)
    return F.when(dropped == 0, whole).otherwise(F.array_join(parts, "\n"))


def drop_lines(docs: DataFrame, documents: int = DOCUMENTS, least: int = LEAST) -> DataFrame:
    """``docs`` with texts that have lost the lines that many documents share; rows whose text is null stay null."""
    rows = bitmaps(docs, documents, least)
    text = F.when(F.col("text").isNotNull(), kept_text("text", F.col("__keep"), F.col("__dropped")))
    return rows.withColumn("text", text).select(*docs.columns)
