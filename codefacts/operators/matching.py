"""Text rules over source lines: line table, regex rules, pairing rules, anchor claims.

All of it runs inside the row of a file: guards, line splitting and matching are expressions over ``content``, so the scan
is one narrow stage and nothing is shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codefacts.functions import paths, text
from codefacts.functions.skew import salted_join
from codefacts.profile import CODE_EXTS
from codefacts.session import materialize


def lines(files: DataFrame) -> DataFrame:
    """the line table ``(repo, path, line_no, line)``, numbered from one."""
    rows = files.select("repo", "path", F.posexplode(text.split_lines("content")).alias("pos", "line"))
    return rows.select("repo", "path", (F.col("pos") + 1).alias("line_no"), "line")


# ------------------------------------------------------------------ line rules
@dataclass(frozen=True)
class LineRule:
    """A data-driven rule: a line that matches ``pattern`` is a hit.

    ``guards``: a file that contains one of these words is exempt. ``unless``: a line that matches it is exempt.
    ``per_match``: one hit for every match in the line instead of one per line.
    """

    rule_id: str
    dimension: str
    severity: str
    title: str
    pattern: str
    guards: tuple[str, ...] = ()
    unless: str = ""
    per_match: bool = False
    skip_comments: bool = True
    confidence: str = "medium"


# ---------------------------------------------------------------- fixed values
# (?U) gives Java the Unicode word classes these patterns were written for
SECRET_LINE = r"(?Ui)\b(password|passwd|pwd|secret|token|api_?key|access_?key|access_?token)\b\s*=\s*(['\"])([^'\"]{8,})\2"
SECRET_PLACEHOLDER = r"(?i)(os\.environ|getenv|<.*>|xxx+|\*{3,}|placeholder|example|dummy|changeme)"
SQL_INJECTION = r"\.execute\(\s*f['\"]|\.execute\([^)]*%[^)]*\)|\.execute\([^)]*\+"
OUTBOUND_REQUEST = r"(?U)\b(requests\.(get|post|put|delete|request)|urlopen)\("
FAIL_OPEN = r"(?U)\bif\s+\w*(secret|token|expected|key)\w*\s+and\b"
REQUEST_GUARDS = ("_assert_public_host", "validate_url", "url_guard", "is_safe_url")

BUILTIN_LINE_RULES = (
    LineRule("SEC001", "security", "major", "plain credential in source", SECRET_LINE, unless=SECRET_PLACEHOLDER, per_match=True),
    LineRule("SEC005", "security", "blocking", "SQL built by string operations in execute()", SQL_INJECTION),
    LineRule("SEC002", "security", "major", "request to a variable URL without a host check", OUTBOUND_REQUEST, guards=REQUEST_GUARDS),
    LineRule("SEC003", "security", "major", "check that passes when the secret is empty", FAIL_OPEN),
)
# ----------------------------------------------------------- end of fixed values


def _hit_count(rule: LineRule, line: Column) -> Column:
    if rule.per_match:
        n = F.regexp_count(line, F.lit(rule.pattern))
    else:
        n = F.rlike(line, F.lit(rule.pattern)).cast("int")
    if rule.unless:
        n = F.when(F.rlike(line, F.lit(rule.unless)), 0).otherwise(n)
    if rule.skip_comments:
        n = F.when(text.strip(line).startswith("#"), 0).otherwise(n)
    return n


def line_rule_hits(files: DataFrame, rules: tuple[LineRule, ...] = BUILTIN_LINE_RULES) -> DataFrame:
    """Hits ``(repo, path, line_no, rule..., snippet)`` of a rule set over whole files.

    The rules are part of the plan: every pattern is a compiled constant. Guards are tested once per file. A line leaves
    the scan only when a rule hits it.
    """
    content = F.col("content")
    flags = []
    for i, rule in enumerate(rules):
        guarded = F.lit(False)
        for word in rule.guards:
            guarded = guarded | content.contains(word)
        flags.append((~guarded).alias(f"on_{i}"))
    rows = files.select("repo", "path", *flags, F.posexplode(text.split_lines(content)).alias("pos", "line"))
    line = F.col("line")
    per_rule = [
        F.when(F.col(f"on_{i}"), F.array_repeat(F.lit(i), _hit_count(rule, line))).otherwise(F.array().cast("array<int>"))
        for i, rule in enumerate(rules)
    ]
    hits = rows.select("repo", "path", (F.col("pos") + 1).alias("line_no"), "line", F.explode(F.concat(*per_rule)).alias("i"))

    def pick(attr: str) -> Column:
        return F.get(F.array(*[F.lit(getattr(r, attr)) for r in rules]), F.col("i"))

    attrs = ("rule_id", "dimension", "severity", "title", "confidence")
    return hits.select("repo", "path", "line_no", *[pick(a).alias(a) for a in attrs], text.strip("line").alias("snippet"))


def required_literal(pattern: Column) -> Column:
    """The longest text that every match of a regular expression contains, or the empty text if that is not sure.

    Alternatives, groups that may be left out, flags and escapes with a name or number make it unsure. What is left is cut at
    everything that is not a plain character; a character that may be left out is not kept.
    """
    unsure = F.rlike(pattern, F.lit(r"\||\(\?|\\[xucpPNkQEhHvVR0-9]|\)[?*{]|\[[^\]]*\["))
    plain = F.regexp_replace(pattern, r"\\.", "\u0001")
    plain = F.regexp_replace(plain, r"\[\^?\]?[^\]]*\](?:[?*+]|\{[^}]*\})?", "\u0001")
    plain = F.regexp_replace(plain, r"(?s:.)(?:[?*]|\{[^}]*\})", "\u0001")
    plain = F.regexp_replace(plain, r"[+?.^$(){}*\[\]]", "\u0001")
    parts = F.array_sort(F.split(plain, "\u0001"), lambda x, y: F.char_length(y) - F.char_length(x))
    return F.when(unsure, F.lit("")).otherwise(F.get(parts, F.lit(0)))


def _judged(repo_rules: DataFrame) -> DataFrame:
    """Line rules with ``reason``, null for those whose pattern compiles; every distinct pattern is compiled once."""
    rules = repo_rules.where("matcher = 'regex_line'")
    patterns = rules.select("pattern").where("pattern is not null").distinct()
    # the compiled form is asked for its text; a pattern that does not compile gives null
    compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col("pattern")).isNotNull()
    good = materialize(patterns.select("pattern", compiled.alias("compiles"), required_literal(F.col("pattern")).alias("literal")))
    reason = F.when(F.col("pattern").isNull(), "no pattern").when(~F.col("compiles"), "the pattern does not compile")
    return rules.join(good, "pattern", "left").withColumn("reason", reason)


def rejected_rules(repo_rules: DataFrame) -> DataFrame:
    """Line rules of repositories that cannot be tested: repo, seq, rule_id, pattern and reason."""
    return _judged(repo_rules).where("reason is not null").select("repo", "seq", "rule_id", "pattern", "reason")


#: rules of a repository that travel together, and bytes of all rules up to which they are sent to every task
RULE_CHUNK, RULE_BYTES = 64, 32 << 20


def repo_rule_hits(files: DataFrame, repo_rules: DataFrame) -> DataFrame:
    """The same for rules that come with each repository (``sources.manifests.read_rules``).

    Rules are judged first: what does not compile is in ``rejected_rules`` and the rest go on. They are indexed by the literal
    that a match must contain, in chunks of bounded size: a file meets a rule only if it holds the literal, and a line only
    if the line does. Up to ``RULE_BYTES`` the rules are sent to the files and no file is moved; beyond, files and chunks
    meet in a salted join, so that a repository with a third of all files is spread.
    """
    good = materialize(_judged(repo_rules).where("reason is null"))
    whole = [F.octet_length(F.coalesce(c, F.lit(""))) for c in ("repo", "pattern", "rule_id", "title")]
    size = good.agg(F.sum(sum(whole, F.lit(128)))).first()[0] or 0
    # rules of one literal side by side, cut into chunks by their running number
    number = F.row_number().over(Window.partitionBy("repo").orderBy("literal", "seq"))
    rule = F.struct("literal", "seq", "rule_id", "dimension", "severity", "title", "confidence", "pattern", "guards")
    chunks = good.withColumn("chunk", F.floor((number - 1) / RULE_CHUNK)).groupBy("repo", "chunk").agg(F.array_sort(F.collect_list(rule)).alias("rules")).drop("chunk")
    own = files.select("repo", "path", "content")
    met = own.join(F.broadcast(chunks), "repo") if size <= RULE_BYTES else salted_join(own, chunks, ["repo"], ["path"])
    content = F.col("content")
    active = F.filter("rules", lambda r: content.contains(r["literal"]) & ~F.exists(r["guards"], lambda g: content.contains(g)))
    met = met.select("repo", "path", "content", active.alias("rules")).where(F.size("rules") > 0)
    numbered = F.transform(text.split_lines("content"), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line")))
    tested = F.filter(numbered, lambda x: ~text.strip(x["line"]).startswith("#"))

    def hits_of(ls: Column) -> Column:
        # a rule outside, its lines inside: the pattern is compiled once for a file
        def of_rule(r: Column) -> Column:
            mine = F.filter(ls, lambda x: x["line"].contains(r["literal"]) & F.rlike(x["line"], r["pattern"]))
            return F.transform(mine, lambda x: F.struct(x["line_no"].alias("line_no"), x["line"].alias("line"), r.alias("r")))

        return F.flatten(F.transform("rules", of_rule))

    # the outer array holds the lines once, so that they are not split again for every rule
    rows = met.select("repo", "path", F.explode(F.flatten(F.transform(F.array(tested), hits_of))).alias("h"))
    return rows.select(
        "repo", "path", "h.line_no", *[F.col(f"h.r.{c}").alias(c) for c in ("rule_id", "dimension", "severity", "title")],
        F.coalesce("h.r.confidence", F.lit("medium")).alias("confidence"), text.strip("h.line").alias("snippet"),
    )


# ------------------------------------------------------------------ pairing
@dataclass(frozen=True)
class PairRule:
    """An assignment whose variable is used within ``window`` lines with no ``escape`` in between.

    ``assign`` must capture the variable in group 1; ``{var}`` in ``use`` stands for it.
    """

    name: str
    assign: str
    use: str
    escape: str = ""
    window: int = 40
    desc: str = ""


# ---------------------------------------------------------------- fixed values
RAW_CONNECTION = PairRule(
    name="raw_db_conn_execute",
    assign=r"^\s*(\w+)\s*=\s*(?:[\w.]+\.)?(?:get_raw_connection|_base_raw_connection)\(\)",
    use=r"\b{var}\.execute\(",
    escape=r"PgConnection\(|MiniAppConnection\(|WrappedConnection|\.cursor\(\)",
    desc="raw database connection used without its wrapper",
)
CONTINUING_BLOCKS = ("try:", "if ", "except", "for ", "with ", "else", "elif", "while", "finally")
# ----------------------------------------------------------- end of fixed values


def pair_rule_hits(files: DataFrame, rules: tuple[PairRule, ...] = (RAW_CONNECTION,)) -> DataFrame:
    """The first event after each assignment decides: scope left, escape, or use; a use is a hit.

    An assignment begins at the start of its line; a use or an escape stands anywhere in its own. All rules are tested in one
    scan. The forward frame is a slice of the file's own line array, taken only for lines that assign.
    """
    def names(rule: PairRule):
        return lambda x: F.regexp_extract(x, f"^(?:{rule.assign})", 1)

    rows = files.select("repo", "path", text.split_lines("content").alias("raw"))
    rows = rows.select("repo", "path", "raw", *[F.transform("raw", names(r)).alias(f"vars_{k}") for k, r in enumerate(rules)])
    # a variable that no line of its window holds has no use; most are left out by that
    rows = rows.select("repo", "path", "raw", *[_used_ahead(r, F.col(f"vars_{k}")).alias(f"vars_{k}") for k, r in enumerate(rules)])
    # only a file with such an assignment pays for the line facts; a filter here would be pushed below the split and repeat it
    facts = [F.when(F.exists(f"vars_{k}", lambda v: v != ""), F.zip_with("raw", F.transform("raw", text.strip), _pair_line(r))).alias(f"lines_{k}") for k, r in enumerate(rules)]
    rows = rows.select("repo", "path", *[f"vars_{k}" for k in range(len(rules))], *facts)
    hits = F.concat(*[_pair_outcomes(r, F.col(f"vars_{k}"), F.col(f"lines_{k}")) for k, r in enumerate(rules)])
    used = rows.select("repo", "path", F.explode(hits).alias("h"))
    return used.select("repo", "path", "h.rule", "h.line_no", F.col("h.body").alias("snippet"))


def _used_ahead(rule: PairRule, variables: Column) -> Column:
    """The variables of all lines, empty where no line of the window holds the variable and a use would have to."""
    if not _always_holds_variable(rule.use):
        return variables

    def kept(var: Column, i: Column) -> Column:
        ahead = F.slice("raw", i + 2, F.lit(rule.window - 1))
        return F.when((var != "") & F.exists(ahead, lambda x: x.contains(var)), var).otherwise("")

    return F.transform(variables, kept)


def _pair_line(rule: PairRule):
    """What depends on a line alone is worked out once per line, not once per assignment above it; so is its stripped text."""
    def facts(raw: Column, body: Column) -> Column:
        goes_on = F.lit(False)
        for word in CONTINUING_BLOCKS:
            goes_on = goes_on | body.startswith(word)
        escapes = F.rlike(body, F.lit(rule.escape)) if rule.escape else F.lit(False)
        return F.struct(body.alias("body"), text.indent_width(raw).alias("indent"), goes_on.alias("goes_on"), escapes.alias("escapes"))

    return facts


def _always_holds_variable(use: str) -> bool:
    """Every match of ``use`` contains the variable itself, so a line without it need not be tested; False if unsure."""
    plain = re.sub(r"\\.|\[\^?\]?[^\]]*\]", "_", use)
    if "(?" in plain:
        return False
    depth, found = 0, False
    for at, c in enumerate(plain):
        depth += (c == "(") - (c == ")")
        if depth == 0 and c == "|":
            return False
        if depth == 0 and plain.startswith("{var}", at) and plain[at + 5 : at + 6] not in ("?", "*", "{"):
            found = True
    return found


def _pair_outcomes(rule: PairRule, variables: Column, ls: Column) -> Column:
    """The uses that decide: an array of (rule, line_no, body)."""
    quick = _always_holds_variable(rule.use)

    def outcome(var: Column, i: Column) -> Column:
        """The first line after line ``i`` that decides, with its number; the file's lines are never copied per assignment."""
        indent = F.get(ls, i)["indent"]
        use = F.replace(F.lit(rule.use), F.lit("{var}"), F.concat(F.lit("\\Q"), var, F.lit("\\E")))

        def event(x: Column, j: Column) -> Column:
            used = F.rlike(x["body"], use)
            kind = (
                F.when(x["body"] == "", 0)
                .when((x["indent"] < indent) & ~x["goes_on"], 1)
                .when(x["escapes"], 2)
                .when(x["body"].contains(var) & used if quick else used, 3)
                .otherwise(0)
            )
            return F.named_struct(F.lit("kind"), kind, F.lit("line_no"), (i + j + 2).cast("int"), F.lit("body"), x["body"], F.lit("rule"), F.lit(rule.name))

        ahead = F.slice(ls, i + 2, F.lit(rule.window - 1))
        return F.when(var != "", F.get(F.filter(F.transform(ahead, event), lambda e: e["kind"] > 0), F.lit(0)))

    found = F.filter(F.transform(variables, outcome), lambda h: h.isNotNull() & (h["kind"] == 3))
    return F.coalesce(found, F.array().cast("array<struct<kind:int,line_no:int,body:string,rule:string>>"))


# ------------------------------------------------------------------ claims
def check_claims(claims: DataFrame, files: DataFrame) -> DataFrame:
    """Does each claimed file hold the claimed text, on the claimed line or anywhere; first hit line when anywhere.

    Only files some claim names take part; which side is sent around is left to the size statistics.
    """
    key = ["repo", "path", "must_contain", "pin"]
    pinned_claims = claims.withColumn("pin", F.coalesce("line", F.lit(0)))
    ls = text.split_lines("content")
    hits = files.join(pinned_claims.select(*key).distinct(), ["repo", "path"]).select(
        *key,
        F.coalesce(F.get(ls, F.col("pin") - 1).contains(F.col("must_contain")), F.lit(False)).alias("on_line"),
        F.array_position(F.transform(ls, lambda x: x.contains(F.col("must_contain"))), True).alias("first_line"),
    )
    both = pinned_claims.join(hits, key, "left")
    there, pinned = F.col("first_line").isNotNull(), F.col("line").isNotNull()
    ok = there & F.when(pinned, F.col("on_line")).otherwise(F.col("first_line") > 0)
    reason = (
        F.when(~there, "no such file")
        .when(pinned & F.col("on_line"), "text is on the line")
        .when(pinned, "text is not on the line")
        .when(F.col("first_line") > 0, F.concat(F.lit("found on line "), F.col("first_line").cast("string")))
        .otherwise("text not found")
    )
    status = F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL")
    return both.select("repo", "id", "path", "line", status.alias("status"), reason.alias("reason"))


# ------------------------------------------------------------------ code / comment / blank
# ---------------------------------------------------------------- fixed values
LINE_LANGUAGES = {
    ".py": "Python", ".js": "JavaScript", ".jsx": "JSX", ".mjs": "JavaScript", ".cjs": "JavaScript", ".ts": "TypeScript",
    ".tsx": "TSX", ".vue": "Vue", ".html": "HTML", ".htm": "HTML", ".css": "CSS", ".scss": "SCSS", ".json": "JSON",
    ".yaml": "YAML", ".yml": "YAML", ".md": "Markdown", ".txt": "Text", ".sql": "SQL", ".sh": "Shell", ".bat": "Batch",
    ".ps1": "PowerShell", ".xml": "XML", ".svg": "SVG", ".ini": "INI", ".cfg": "Config",
}
HASH, SLASH = ("#",), ("//",)
#: language -> (line comment prefixes, block start, block end)
COMMENT_STYLE = {
    "Python": (HASH, "", ""), "Shell": (HASH, "", ""), "YAML": (HASH, "", ""), "PowerShell": (HASH, "", ""),
    "INI": ((";", "#"), "", ""), "Config": ((";", "#"), "", ""), "Batch": (("@echo off", "::", "rem "), "", ""),
    "JavaScript": (SLASH, "/*", "*/"), "TypeScript": (SLASH, "/*", "*/"), "JSX": (SLASH, "/*", "*/"), "TSX": (SLASH, "/*", "*/"),
    "Vue": (SLASH, "/*", "*/"), "SCSS": (SLASH, "/*", "*/"), "CSS": ((), "/*", "*/"), "SQL": (("--",), "/*", "*/"),
    "HTML": ((), "<!--", "-->"), "XML": ((), "<!--", "-->"), "SVG": ((), "<!--", "-->"),
    "Text": ((), "", ""), "JSON": ((), "", ""), "Markdown": ((), "", ""),
}
MODULE_LANGUAGES = ("Python", "JavaScript", "JSX", "TypeScript", "TSX", "Vue", "HTML", "CSS", "SCSS", "SQL", "Shell")
# ----------------------------------------------------------- end of fixed values


def _fold(line_array: Column, style: tuple[tuple[str, ...], str, str]) -> Column:
    """one fold over the lines carries the in-block state and the three counters."""
    prefixes, start, end = style
    zero = F.struct(F.lit(False).alias("inside"), *[F.lit(0).cast("long").alias(c) for c in ("code", "comment", "blank")])

    def step(acc: Column, raw: Column) -> Column:
        s = text.strip(raw)
        opens = s.startswith(start) if start else F.lit(False)
        closes_here = F.substr(s, F.lit(len(start) + 1)).contains(end) if start else F.lit(True)
        comment = F.lit(False)
        for p in prefixes:
            comment = comment | s.startswith(p)
        kind = F.when(acc["inside"], "comment").when(s == "", "blank").when(opens | comment, "comment").otherwise("code")
        inside = F.when(acc["inside"], ~s.contains(end) if end else F.lit(False)).otherwise(opens & ~closes_here)
        counts = [(acc[c] + (kind == c).cast("long")).alias(c) for c in ("code", "comment", "blank")]
        return F.struct(inside.alias("inside"), *counts)

    return F.aggregate(line_array, zero, step)


def sloc(files: DataFrame) -> DataFrame:
    """Code, comment and blank lines per file with the comment style of its language."""
    ext = paths.extension("path")
    lookup = F.create_map(*[F.lit(x) for kv in LINE_LANGUAGES.items() for x in kv])
    rows = files.select("repo", "path", F.try_element_at(lookup, ext).alias("language"), text.split_lines("content").alias("ls")).where("language is not null")
    by_style: dict[tuple, list[str]] = {}
    for language, style in COMMENT_STYLE.items():
        by_style.setdefault(style, []).append(language)
    counts = None
    for style, languages in by_style.items():
        cond, value = F.col("language").isin(*languages), _fold(F.col("ls"), style)
        counts = F.when(cond, value) if counts is None else counts.when(cond, value)
    return rows.select("repo", "path", "language", counts.alias("n")).select("repo", "path", "language", "n.code", "n.comment", "n.blank")


def sloc_by_language(rows: DataFrame) -> DataFrame:
    """Sums per language."""
    return rows.groupBy("repo", "language").agg(F.count("*").alias("files"), *[F.sum(c).alias(c) for c in ("code", "comment", "blank")])


def sloc_by_module(rows: DataFrame) -> DataFrame:
    """Code lines of source languages per top directory."""
    source = rows.where(F.col("language").isin(*MODULE_LANGUAGES))
    return source.groupBy("repo", paths.top_dir("path").alias("module")).agg(F.count("*").alias("files"), F.sum("code").alias("code"))


def code_files(files: DataFrame) -> DataFrame:
    return files.where(paths.extension("path").isin(*CODE_EXTS))
