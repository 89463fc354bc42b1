"""Queries over file listings and sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from codefacts.operators import digest as dg
from codefacts.operators import overview as ov
from codefacts.plans import adapters as ad
from codefacts.plans import sql_text as st
from codefacts.plans.registry import query
from codefacts.profile import Profile

_SIZES_SQL = f"""
with f as (select source as repo, {ad.DOC_PATH_SQL} as path, text as content, strlen(text) as bytes, lang from documents),
sizes as (
  select repo, path, lang as top, regexp_extract(path, '(\\.[^.]+)$', 1) as ext, bytes,
    case when lang = 'es' then 0 else {st.total_lines('content')} end as lines,
    case when lang = 'es' then 0 else {st.code_lines('content')} end as code,
    lang <> 'es' as is_code, lang = 'es' as is_asset
  from f)
"""


def _sizes(spark, sf):
    return ov.file_sizes(ad.document_files(spark, sf))


@query(
    "file_size_table",
    "A1 B6 C11 D6",
    _SIZES_SQL + "select repo, path, top, ext, bytes::bigint as bytes, lines::bigint as lines, code::bigint as code, is_code, is_asset from sizes",
)
def file_size_table(spark, sf):
    return _sizes(spark, sf)


@query(
    "overview_totals",
    "D1",
    _SIZES_SQL + """select repo, count(*) as files, count(*) filter (is_asset) as assets, sum(lines)::bigint as lines,
    sum(code)::bigint as code, sum(bytes)::bigint as bytes, coalesce(sum(bytes) filter (is_code), 0)::bigint as code_bytes
    from sizes group by repo""",
)
def overview_totals(spark, sf):
    return ov.totals(_sizes(spark, sf))


@query(
    "overview_by_language",
    "D2",
    _SIZES_SQL + """select repo, ext, count(*) as files, sum(code)::bigint as code, sum(bytes)::bigint as bytes
    from sizes where is_code group by repo, ext""",
)
def overview_by_language(spark, sf):
    return ov.by_language(_sizes(spark, sf))


@query(
    "overview_by_top_dir",
    "D3",
    _SIZES_SQL + """, e as (select repo, top, ext, count(*) as n from sizes group by all)
    select s.repo, s.top, s.files, s.lines, s.code, s.bytes, x.exts from (
      select repo, top, count(*) as files, sum(lines)::bigint as lines, sum(code)::bigint as code, sum(bytes)::bigint as bytes
      from sizes group by repo, top) s
    join (select repo, top, string_agg(ext || '=' || n, ',' order by ext) as exts from e group by repo, top) x using (repo, top)""",
)
def overview_by_top_dir(spark, sf):
    shown = F.transform(F.map_entries("exts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return ov.by_top_dir(_sizes(spark, sf)).withColumn("exts", F.array_join(shown, ","))


@query(
    "extension_histogram",
    "D4 F1",
    _SIZES_SQL + """select repo, ext, files, rank from (
      select repo, ext, count(*) as files, row_number() over (partition by repo order by count(*) desc, ext) as rank
      from sizes group by repo, ext) where rank <= 15""",
)
def extension_histogram(spark, sf):
    return ov.extension_histogram(_sizes(spark, sf))


@query(
    "overview_one_pass",
    "D5",
    _SIZES_SQL + """select repo, case when grouping(ext) = 0 then 'ext' when grouping(top) = 0 then 'top' else 'total' end as level,
      coalesce(ext, top, '') as key, count(*) as files, count(*) filter (is_asset) as assets,
      count(*) filter (is_code) as code_files, sum(lines)::bigint as lines, sum(code)::bigint as code,
      sum(bytes)::bigint as bytes, sum(case when is_code then bytes else 0 end)::bigint as code_bytes
    from sizes group by grouping sets ((repo), (repo, ext), (repo, top))""",
)
def overview_one_pass(spark, sf):
    return ov.overview(_sizes(spark, sf))


@query(
    "largest_files",
    "D6 F1",
    _SIZES_SQL + """select repo, rank, path, bytes::bigint as bytes, lines::bigint as lines, code::bigint as code from (
      select *, row_number() over (partition by repo order by code desc, path) as rank from sizes) where rank <= 25""",
)
def largest_files(spark, sf):
    return ov.largest_files(_sizes(spark, sf))


_SHAPES = [
    Profile(name="german-first", signature_dirs=("de", "fr", "es", "en")),
    Profile(name="no-spanish", signature_dirs=("de", "fr", "en")),
    Profile(name="any", signature_dirs=()),
]


@query(
    "repo_shape",
    "B11",
    """select source as repo, case when bool_or(lang='de') and bool_or(lang='fr') and bool_or(lang='es') and bool_or(lang='en') then 'german-first'
    when bool_or(lang='de') and bool_or(lang='fr') and bool_or(lang='en') then 'no-spanish' else 'any' end as profile
    from documents group by source""",
)
def repo_shape(spark, sf):
    return ov.infer_shape(ad.document_files(spark, sf), _SHAPES)


_DIGEST = """with f as (select source as repo, """ + ad.DOC_PATH_SQL + """ as path, n_chars as mtime, strlen(text) as size, doc_id from documents),
d as (select repo, md5(path || '|' || mtime || '|' || size) as m from f)
"""


@query(
    "corpus_fingerprint",
    "D40",
    _DIGEST + """select repo, count(*) as files, md5(count(*) || '|' || sum(('0x' || substr(m, 1, 8))::bigint) || '|' || sum(('0x' || substr(m, 9, 8))::bigint) || '|' || sum(('0x' || substr(m, 17, 8))::bigint)
      || '|' || sum(('0x' || substr(m, 25, 8))::bigint)) as fingerprint from d group by repo""",
)
def corpus_fingerprint(spark, sf):
    return dg.corpus_fingerprint(ad.document_files(spark, sf))


@query(
    "corpus_difference",
    "D40",
    _DIGEST + """select repo, path, case when doc_id % 50 = 1 then 'removed' when doc_id % 50 = 2 then 'added' else 'changed' end as status from f where doc_id % 50 in (1, 2, 3) and repo <> 'src0'""",
)
def corpus_difference(spark, sf):
    """Two states of a corpus: some files are gone, some new, some touched; one repository is as it was."""
    from codefacts.streaming.jobs import scratch

    files = ad.document_files(spark, sf).withColumn("k", F.when(F.col("repo") != "src0", F.regexp_extract("path", r"(\d+)\.", 1).cast("long") % 50).otherwise(0))
    before, after = scratch(spark, "tree"), scratch(spark, "tree")
    dg.write_tree(files.where("k <> 2"), before)
    dg.write_tree(files.where("k <> 1").withColumn("mtime", F.col("mtime") + (F.col("k") == 3).cast("long")), after)
    return dg.corpus_difference(spark, before, after)


#: url host and path stand for a stray file's location
def _stray(spark, sf):
    pages = ad.table(spark, sf, "pages")
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    path = F.regexp_replace(F.regexp_replace("url", r"^https?://[^/]+/", ""), r"[?#].*$", "")
    docs = ad.table(spark, sf, "documents")
    doc_dir = F.when(F.col("lang") == "en", "dist").when(F.col("lang") == "fr", "layout").otherwise("logs")
    doc_ext = F.when(F.col("lang") == "de", ".log").when(F.col("lang") == "es", ".sqlite").otherwise(".rs")
    doc_path = F.concat(doc_dir, F.lit("/d"), F.col("doc_id").cast("string"), doc_ext)
    return pages.select(host.alias("repo"), path.alias("path")).unionByName(
        docs.select(F.col("source").alias("repo"), doc_path.alias("path"))
    )


_STRAY_SQL = """
with f as (
  select regexp_extract(url, '^https?://([^/]+)', 1) as repo,
         regexp_replace(regexp_replace(url, '^https?://[^/]+/', ''), '[?#].*$', '') as path from pages
  union all
  select source, case lang when 'en' then 'dist' when 'fr' then 'layout' else 'logs' end || '/d' || doc_id ||
         case lang when 'de' then '.log' when 'es' then '.sqlite' else '.rs' end from documents),
c as (select repo, path, case
  when regexp_matches(path, '(^|/)(__pycache__|dist|build|\\.venv|venv|node_modules|\\.next|\\.nuxt|target|out)(/|$)')
    or regexp_matches(path, '(\\.pyc|\\.pyo|\\.egg-info)(/|$)') then 'build_artifacts'
  else coalesce(case lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1))
    when '.log' then 'logs' when '.sqlite' then 'data' when '.rs' then 'source_code' when '.html' then 'other'
    when '.md' then 'docs' when '.txt' then 'docs' when '.pdf' then 'docs' when '.json' then 'data' when '.php' then 'source_code' end, 'other')
  end as category from f)
"""


@query("stray_file_counts", "D34 A23", _STRAY_SQL + "select repo, category, count(*) as files from c group by all")
def stray_file_counts(spark, sf):
    return ov.stray_counts(ov.classify_stray(_stray(spark, sf)))


@query(
    "ignore_suggestions",
    "D34",
    _STRAY_SQL + """select distinct repo, pattern from (
      select repo, unnest(case category when 'build_artifacts' then ['dist/'] when 'logs' then ['*.log'] else ['*.db', '*.sqlite'] end) as pattern
      from c where category in ('build_artifacts', 'logs', 'data'))""",
)
def ignore_suggestions(spark, sf):
    return ov.ignore_suggestions(ov.classify_stray(_stray(spark, sf)))
