"""Queries over source lines: rules, pairing, claims, line counts by language."""

from __future__ import annotations

from pyspark.sql import functions as F

from codefacts.operators import matching as mt
from codefacts.plans import adapters as ad
from codefacts.plans import sql_text as st
from codefacts.plans.registry import query

_FILES = f"with f as (select source as repo, {ad.DOC_PATH_SQL} as path, text as content, lang from documents), "
_LINES = _FILES + f"""l as (select repo, path, lang, content, unnest(ls) as line, generate_subscripts(ls, 1) as line_no from (select *, {st.split_lines('content')} as ls from f))
"""


@query("source_lines", "F9", _LINES + "select repo, path, line_no, line from l")
def source_lines(spark, sf):
    return mt.lines(ad.document_files(spark, sf))


#: rules whose words occur in the documents
PROSE_RULES = (
    mt.LineRule("MAIL", "security", "major", "address", r"[a-z0-9._]+@[a-z0-9.]+\.[a-z]+", per_match=True),
    mt.LineRule("KEY", "security", "blocking", "key", r"(?i)(api[_-]?key|secret|token|password)", unless=r"(?i)example"),
    mt.LineRule("LIC", "quality", "minor", "license", r"(?i)(license|copyright|warranty)", guards=("wht", "zzz")),
    mt.LineRule("LONG", "quality", "info", "long word", r"[a-z]{25,}", guards=("@",)),
)


@query(
    "line_rule_hits",
    "E17 U3 R16 R17 R18 R19",
    _LINES + f"""select repo, path, line_no, rule_id, severity, snippet from (
      select *, {st.strip('line')} as snippet, {st.strip('line')} like '#%' as com from l) x, lateral (
      select 'MAIL' as rule_id, 'major' as severity, len(regexp_extract_all(line, '[a-z0-9._]+@[a-z0-9.]+\\.[a-z]+')) as n
      union all select 'KEY', 'blocking', case when regexp_matches(line, '(?i)(api[_-]?key|secret|token|password)') and not regexp_matches(line, '(?i)example') then 1 else 0 end
      union all select 'LIC', 'minor', case when regexp_matches(line, '(?i)(license|copyright|warranty)') and not contains(content, 'wht') and not contains(content, 'zzz') then 1 else 0 end
      union all select 'LONG', 'info', case when regexp_matches(line, '[a-z]{{25,}}') and not contains(content, '@') then 1 else 0 end) r, lateral (select unnest(range(n)) as copy) where not com""",
)
def line_rule_hits(spark, sf):
    rows = mt.line_rule_hits(ad.document_files(spark, sf), PROSE_RULES)
    return rows.select("repo", "path", "line_no", "rule_id", "severity", "snippet")


@query(
    "repo_rule_hits",
    "E17 A9",
    _LINES + f""", r as (select distinct source as repo, 'R-' || lang as rule_id, case lang when 'en' then 'tion' when 'fr' then 'eau[xs]' when 'de' then 'ungen' else 'ción' end as pattern,
      case lang when 'en' then 'qqq' else 'zzzz' end as guard from documents)
    select l.repo, path, line_no, rule_id, {st.strip('line')} as snippet from l join r using (repo)
    where regexp_matches(line, pattern) and not contains(content, guard) and {st.strip('line')} not like '#%'""",
)
def repo_rule_hits(spark, sf):
    """Every repository also has a rule that does not compile, one without a pattern and one that nothing matches; the others go on."""
    return mt.repo_rule_hits(ad.document_files(spark, sf), _prose_repo_rules(spark, sf)).select("repo", "path", "line_no", "rule_id", "snippet")


def _prose_repo_rules(spark, sf):
    docs = ad.table(spark, sf, "documents").select(F.col("source").alias("repo"), "lang").distinct()
    pattern = F.when(F.col("lang") == "en", "tion").when(F.col("lang") == "fr", "eau[xs]").when(F.col("lang") == "de", "ungen").otherwise("ción")
    guard = F.when(F.col("lang") == "en", "qqq").otherwise("zzzz")

    def rule(rule_id, pattern):
        return F.struct(rule_id.alias("rule_id"), pattern.cast("string").alias("pattern"))

    each = F.array(
        rule(F.concat(F.lit("R-"), "lang"), pattern), rule(F.concat(F.lit("BAD-"), "lang"), F.concat(F.lit("("), pattern)),
        rule(F.lit("NONE"), F.lit(None)), rule(F.lit("NEVER"), F.lit("q{3}x|qqqq#")),
    )
    return docs.select("repo", guard.alias("guard"), F.posexplode(each).alias("seq", "r")).select(
        "repo", "seq", "r.rule_id", F.lit("quality").alias("dimension"), F.lit("info").alias("severity"), F.lit("word").alias("title"),
        F.lit(None).cast("string").alias("confidence"), F.lit("regex_line").alias("matcher"), "r.pattern", F.array("guard").alias("guards"),
    )


@query(
    "repo_rule_rejects",
    "A9",
    """with d as (select distinct source as repo, lang from documents)
    select repo, 'BAD-' || lang as rule_id, 'the pattern does not compile' as reason from d union all select repo, 'NONE', 'no pattern' from d""",
)
def repo_rule_rejects(spark, sf):
    return mt.rejected_rules(_prose_repo_rules(spark, sf)).select("repo", "rule_id", "reason")


#: the first word of a line stands for a variable, its next occurrence for a use, "der" or "the" for an escape
PROSE_PAIR = mt.PairRule(
    "repeated_word", assign=r"^(\w+) ", use=r"(^|[^A-Za-z0-9_]){var}([^A-Za-z0-9_]|$)", escape=r" (der|of) [a-z]+ (die|the) ", window=6
)


@query(
    "pairing_hits",
    "E18 F5 R41",
    _LINES + f""", a as (select repo, path, line_no, regexp_extract(line, '^(\\w+) ', 1) as var from l where regexp_matches(line, '^(\\w+) ')),
    ev as (select a.repo, a.path, a.line_no as a_no, l.line_no, {st.strip('line')} as body, var,
      case when {st.strip('line')} = '' then 0 when regexp_matches({st.strip('line')}, ' (der|of) [a-z]+ (die|the) ') then 2
           when regexp_matches({st.strip('line')}, '(^|[^A-Za-z0-9_])' || var || '([^A-Za-z0-9_]|$)') then 3 else 0 end as e
      from a join l on a.repo = l.repo and a.path = l.path and l.line_no between a.line_no + 1 and a.line_no + 5),
    first as (select repo, path, a_no, min(line_no) as line_no from ev where e > 0 group by all)
    select repo, path, 'repeated_word' as rule, line_no, body as snippet from ev join first using (repo, path, a_no, line_no) where e = 3""",
)
def pairing_hits(spark, sf):
    return mt.pair_rule_hits(ad.document_files(spark, sf), (PROSE_PAIR,))


@query(
    "anchor_claims",
    "E16 A11",
    _FILES + f"""c as (select source as repo, 'c' || doc_id as id, case when quality = 1 then {ad.DOC_PATH_SQL} else 'gone/' || doc_id end as path,
      case when toxic = 1 then 'the ' else 'qqqq' end as needle, case when doc_id % 3 = 0 then 2 end as line, doc_id from labels join documents using (doc_id)),
    j as (select c.*, f.path is not null as there, {st.split_lines('f.content')} as ls from c left join f on c.repo = f.repo and c.path = f.path),
    k as (select *, coalesce(contains(ls[line], needle), false) as on_line, list_position(list_transform(ls, lambda x: contains(x, needle)), true) as first_line from j)
    select repo, id, path, line, case when there and case when line is not null then on_line else coalesce(first_line, 0) > 0 end then 'PASS' else 'FAIL' end as status,
      case when not there then 'no such file' when line is not null and on_line then 'text is on the line' when line is not null then 'text is not on the line'
        when coalesce(first_line, 0) > 0 then 'found on line ' || first_line else 'text not found' end as reason from k""",
)
def anchor_claims(spark, sf):
    docs = ad.table(spark, sf, "documents").join(ad.table(spark, sf, "labels"), "doc_id")
    gone = F.concat(F.lit("gone/"), F.col("doc_id").cast("string"))
    claims = docs.select(
        F.col("source").alias("repo"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("id"),
        F.when(F.col("quality") == 1, ad.doc_path()).otherwise(gone).alias("path"),
        F.when(F.col("toxic") == 1, "the ").otherwise("qqqq").alias("must_contain"),
        F.when(F.col("doc_id") % 3 == 0, 2).alias("line"),
    )
    return mt.check_claims(claims, ad.document_files(spark, sf))


_HTML = f"""with f as (select regexp_extract(url, '^https?://([^/]+)', 1) as repo, 'p' || page_id || '.html' as path, replace(html, '><', '>' || chr(10) || '<') as content from pages),
l as (select repo, path, unnest(ls) as line, generate_subscripts(ls, 1) as i from (select *, {st.split_lines('content')} as ls from f)),
s as (select *, {st.strip('line')} as s from l),
st as (with recursive w as (
    select repo, path, i, s, false as was, s like '<!--%' and not contains(substr(s, 5), '-->') as inside from s where i = 1
    union all select s.repo, s.path, s.i, s.s, w.inside, case when w.inside then not contains(s.s, '-->') else s.s like '<!--%' and not contains(substr(s.s, 5), '-->') end
    from w join s on s.repo = w.repo and s.path = w.path and s.i = w.i + 1) select * from w),
k as (select repo, path, case when was then 'comment' when s = '' then 'blank' when s like '<!--%' then 'comment' else 'code' end as kind from st),
c as (select repo, path, count(*) filter (kind = 'code') as code, count(*) filter (kind = 'comment') as comment, count(*) filter (kind = 'blank') as blank from k group by all)
"""


def _html_files(spark, sf):
    pages = ad.table(spark, sf, "pages", spread=True)
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    path = F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html"))
    return pages.select(host.alias("repo"), path.alias("path"), F.replace("html", F.lit("><"), F.lit(">\n<")).alias("content"))


@query("sloc_html", "C12 F6", _HTML + "select repo, path, 'HTML' as language, code, comment, blank from c")
def sloc_html(spark, sf):
    return mt.sloc(_html_files(spark, sf))


@query(
    "sloc_by_language",
    "D35 C12",
    _HTML + "select repo, 'HTML' as language, count(*) as files, sum(code)::bigint as code, sum(comment)::bigint as comment, sum(blank)::bigint as blank from c group by repo",
)
def sloc_by_language(spark, sf):
    return mt.sloc_by_language(mt.sloc(_html_files(spark, sf)))


@query(
    "sloc_by_module",
    "D35",
    _LINES + f""", k as (select repo, lang, path, {st.strip('line')} as s from l where lang in ('en', 'fr', 'de')),
    c as (select repo, lang as module, path, count(*) filter (s <> '' and not (lang = 'en' and s like '#%') and not (lang = 'fr' and s like '//%')) as code from k group by all)
    select repo, module, count(*) as files, sum(code)::bigint as code from c group by all""",
)
def sloc_by_module(spark, sf):
    return mt.sloc_by_module(mt.sloc(ad.document_files(spark, sf)))


@query(
    "pair_rules_from_json",
    "A10",
    """select 'n' || s_suppkey as name, 'x' || s_nationkey as use, '' as escape, case when s_acctbal < 0 then 40 else 7 end as window_lines, case when s_acctbal < 0 then 'n' || s_suppkey else 'd' end as about from supplier""",
)
def pair_rules_from_json(spark, sf):
    from codefacts.sources.manifests import read_pair_rules

    more = F.when(F.col("s_acctbal") < 0, "").otherwise(', "window": 7, "desc": "d"')
    text = F.format_string('[{"name": "n%s", "assign": "a", "use": "x%s"%s}]', F.col("s_suppkey"), F.col("s_nationkey"), more)
    rows = read_pair_rules(ad.table(spark, sf, "supplier").select(text.alias("content")))
    return rows.select("name", "use", "escape", F.col("window").alias("window_lines"), F.col("desc").alias("about"))


@query(
    "decoded_texts",
    "A2",
    "select doc_id, md5(case when lang = 'de' then text || chr(65533) else text end) as digest, length(text) + case when lang = 'de' then 1 else 0 end as chars from documents",
)
def decoded_texts(spark, sf):
    """English texts get a byte-order mark, German ones a byte that no decoder accepts."""
    from codefacts.functions.text import decode_text

    raw = F.encode("text", "UTF-8")
    marked = F.when(F.col("lang") == "en", F.concat(F.lit(b"\xef\xbb\xbf"), raw)).when(F.col("lang") == "de", F.concat(raw, F.lit(b"\xff"))).otherwise(raw)
    rows = ad.table(spark, sf, "documents", spread=True).select("doc_id", decode_text(marked).alias("t"))
    return rows.select("doc_id", F.md5(F.encode("t", "UTF-8")).alias("digest"), F.length("t").alias("chars"))
