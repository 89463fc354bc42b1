"""The registered queries of this subpackage and, where SQL can say it, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.llm import bpe, decontamination, exact_dedup, line_dedup, linear, maintext, near_dedup, pii, quality, search, shards, spelling, toxicity, warc
from codefacts.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_pii")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = pii.span_texts(pii.find(table(spark, sf_dir, "documents")))
    return listed.select("doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2("base", 256).alias("base_sha256"), "spans", "n_found")


@query(
    "op2_warc",
    """
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN first IS NOT DISTINCT FROM page_id THEN NULL ELSE first END AS refers_to
    FROM f
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = materialize(warc.write_packages(table(spark, sf_dir, "pages"), warc.archive_folder(spark)))
    return warc.read_packages(packages, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    "op3_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def _classified(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id", (linear.fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _classified(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))), toxicity.THRESHOLD)


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _classified(quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"))), quality.THRESHOLD)


@query("op9_sharding")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.assign(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def tokenizer_path() -> str:
    """The vocabulary file of the public tokenizers package; a parameter everywhere else."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op5_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


@query("op6_maintext")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return maintext.extract(pages, maintext.fit(pages)).withColumn("n_chars", F.char_length("text").cast("long"))


@query("op7_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontamination.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


@query("op10_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


def token_digests(docs: DataFrame) -> DataFrame:
    coded = bpe.encode(docs, tokenizer_path(), decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
_TERMS = f"unnest(regexp_extract_all(translate(text, {_UPPER}, {_LOWER}), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"


@query(
    "op11_search",
    f"""
    WITH t AS (SELECT doc_id, {_TERMS} AS term FROM documents WHERE text IS NOT NULL),
    s AS (SELECT count(DISTINCT doc_id) AS docs, count(*) AS total FROM t),
    l AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
    i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_TERMS} AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
    f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM i) GROUP BY ALL),
    w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY term, docs),
    c AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::BIGINT AS score
          FROM i JOIN f USING (term) JOIN w USING (term) JOIN l USING (doc_id), s GROUP BY ALL)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
    FROM c WHERE score > 0 QUALIFY rank <= 20
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LINE_KEY = f"translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_UPPER}, {_LOWER})"


@query(
    "op12_line_dedup",
    f"""
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
    k AS (SELECT *, {_LINE_KEY} AS key FROM l),
    f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
    SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
    FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.bitmaps(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = line_dedup.kept_text("text", F.col("__keep"), F.col("__dropped"))
    return rows.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


@query("op13_spelling_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.variants(spelling.count_words(table(spark, sf_dir, "documents")))
    return words.select("word", "n", "n_near", "form", "form_n", "root")
