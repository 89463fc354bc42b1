"""The facts job and its tables (C1-C10, B15, B16, E19, R20-R23 inputs).

``extract_facts`` is the only stage with per-file Python: one pass over the files that flattens each syntax tree into
records. Everything a consumer asks for - functions, routes, calls, imports - is a Spark expression over that table,
so reading one kind of fact only reads its column. C-family files are parsed by regex expressions in ``cxx``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from codefacts.functions import paths, syntax, text
from codefacts.profile import APP_LIKE_OWNERS, HTTP_METHODS, PY_EXTS
from codefacts.schemas import PY_SYNTAX

MODULE_SCOPE = "@module"


#: files whose records are Python objects at the same time, whatever the size of a batch
PARSED_AT_ONCE = 200


def _parser():
    """Arrow batches of whole texts in, syntax records out; null texts (other languages) pass through as empty.

    Not deterministic to the optimizer, which else parses once to find rows with records and again to read them.
    """
    kind = T._parse_datatype_string(PY_SYNTAX)
    records = to_arrow_type(kind)

    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            starts = range(0, len(batch), PARSED_AT_ONCE)
            parts = [pa.array([syntax.flatten(t or "") for t in batch.slice(k, PARSED_AT_ONCE).to_pylist()], records) for k in starts]
            yield pa.concat_arrays(parts) if parts else pa.array([], records)

    return F.arrow_udf(parse, kind).asNondeterministic()


def is_parsed(path: Column | str) -> Column:
    """Files that have facts of their own."""
    return paths.extension(path).isin(*PY_EXTS)


def extract_facts(files: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per Python file with its flat records; the caller filters to the files that need parsing.

    Rows stay in the partition that read them: no shuffle. ``code_hash`` is the content address E19 compares. Columns in
    ``keep`` are passed on.
    """
    parse = _parser()
    sources = files.where(is_parsed("path"))
    return sources.select(
        "repo",
        "path",
        *keep,
        text.total_lines("content").alias("loc_total"),
        text.code_lines("content").alias("loc_code"),
        content_key("content").alias("code_hash"),
        parse("content").alias("s"),
    ).select("repo", "path", *keep, "loc_total", "loc_code", "code_hash", "s.*")


def content_key(content: Column | str) -> Column:
    """Content address of a file: the first 12 hex digits of its SHA-1."""
    return F.substring(F.sha1(paths._c(content)), 1, 12)


def failures(facts: DataFrame) -> DataFrame:
    """Files that did not parse, with the reason."""
    return facts.where(~F.col("ok")).select("repo", "path", "error")


def _records(facts: DataFrame, column: str) -> DataFrame:
    rows = facts.select("repo", "path", F.posexplode(column).alias("seq", "r"))
    return rows.select("repo", "path", "seq", "r.*")


def _is_abstract(decorators: Column) -> Column:
    leaf = F.transform(decorators, lambda d: F.element_at(F.split(d, r"\."), -1))
    return F.arrays_overlap(leaf, F.array(F.lit("abstractmethod"), F.lit("abstractproperty")))


def functions(facts: DataFrame) -> DataFrame:
    """C4: functions defined directly in a module."""
    rows = _records(facts, "defs").where("kind = 'def' and container = ''")
    return rows.select(
        "repo", "path", "name", F.concat(F.lit("def "), "name", "signature").alias("signature"),
        text.first_line("doc").alias("docstring"), "decorators", (~F.col("name").startswith("_")).alias("public"), "lineno",
    )


def classes(facts: DataFrame, base_class: str = "BasePlugin") -> DataFrame:
    """C4: classes defined directly in a module."""
    rows = _records(facts, "defs").where("kind = 'class' and container = ''")
    based = F.exists("bases", lambda b: b.endswith(base_class))
    return rows.select(
        "repo", "path", "name", "bases", text.first_line("doc").alias("docstring"), based.alias("inherits_base"), "lineno"
    )


def methods(facts: DataFrame) -> DataFrame:
    """C4: methods written directly in the body of such a class."""
    rows = _records(facts, "defs").where("kind = 'def' and container <> ''")
    return rows.select(
        "repo", "path", F.col("container").alias("class_name"), F.col("container_line").alias("class_line"), "seq",
        "name", F.concat("name", "signature").alias("signature"), text.first_line("doc").alias("docstring"),
        _is_abstract(F.col("decorators")).alias("abstract"), "decorators", "lineno",
    )


def function_spans(facts: DataFrame) -> DataFrame:
    """First and last line of every function, nested ones too."""
    return _records(facts, "defs").where("kind = 'def'").select("repo", "path", "name", "lineno", "end_lineno")


def imports(facts: DataFrame) -> DataFrame:
    """Distinct dotted module names a file imports."""
    rows = facts.select("repo", "path", F.explode(F.array_distinct("imports.module")).alias("module"))
    return rows.where("module is not null and module <> ''")


def import_facts(facts: DataFrame) -> DataFrame:
    """Distinct import statements with level, name and alias."""
    bare = F.array_distinct(
        F.transform("imports", lambda i: F.struct(*[i[c].alias(c) for c in ("kind", "module", "level", "name", "alias")]))
    )
    return facts.select("repo", "path", F.explode(bare).alias("i")).select("repo", "path", "i.*")


def call_records(facts: DataFrame) -> DataFrame:
    return _records(facts, "calls")


def _target(chain: Column) -> Column:
    return F.array_join(chain, ".")


def calls(facts: DataFrame) -> DataFrame:
    """Distinct (caller, target) pairs; a target has all its name parts."""
    pair = F.transform(
        F.filter("calls", lambda c: c["chain"][0] != "<other>"),
        lambda c: F.struct(
            F.when(c["scope"] == "", MODULE_SCOPE).otherwise(c["scope"]).alias("caller"), _target(c["chain"]).alias("target")
        ),
    )
    return facts.select("repo", "path", F.explode(F.array_distinct(pair)).alias("c")).select("repo", "path", "c.*")


def single_name_calls(facts: DataFrame) -> DataFrame:
    """Distinct ``f(x)`` calls whose only argument is a plain name. All of them: there is no per-file cap."""
    one_name = F.filter(
        "calls",
        lambda c: (F.size(c["args"]) == 1)
        & c["args"][0]["kw"].isNull()
        & (c["args"][0]["kind"] == "Name")
        & ~c["chain"][0].startswith("<"),
    )
    pair = F.transform(one_name, lambda c: F.struct(_target(c["chain"]).alias("f"), c["args"][0]["ident"].alias("a")))
    return facts.select("repo", "path", F.explode(F.array_distinct(pair)).alias("c")).select("repo", "path", "c.*")


def rule_calls(facts: DataFrame) -> DataFrame:
    """Every call as ``owner.attr`` (or the bare last name) with its keyword arguments as a map of source text.

    Python's parser lets a keyword be given twice; the last one counts.
    """
    chain = F.col("chain")
    plain_owner = (F.size(chain) == 2) & ~chain[0].startswith("<")
    name = F.when((F.size(chain) == 1) | plain_owner, F.array_join(chain, ".")).otherwise(F.element_at(chain, -1))
    keywords = F.filter("args", lambda a: a["kw"].isNotNull() & (a["kw"] != "**"))
    names = F.array_distinct(F.transform(keywords, lambda a: a["kw"]))
    last = F.transform(names, lambda n: F.element_at(F.filter("args", lambda a: a["kw"] == n), -1)["text"])
    return call_records(facts).select("repo", "path", name.alias("name"), "lineno", F.map_from_arrays(names, last).alias("kwargs"))


def _keyword(args: Column, name: str) -> Column:
    return F.get(F.filter(args, lambda a: a["kw"] == name), F.lit(0))


def _positional(args: Column, index: int) -> Column:
    return F.get(F.filter(args, lambda a: a["kw"].isNull()), F.lit(index))


def _is_blueprint(chain: Column, assigned_to: Column) -> Column:
    return (F.element_at(chain, -1) == "Blueprint") & (F.size(chain) <= 2) & assigned_to.isNotNull()


def blueprints(facts: DataFrame) -> DataFrame:
    """``x = Blueprint(name, ..., url_prefix=...)`` assignments.

    ``prefix`` is the literal value, null when ``url_prefix`` is given but is not a string literal.
    """
    rows = call_records(facts).where(_is_blueprint(F.col("chain"), F.col("assigned_to")))
    prefix = _keyword(F.col("args"), "url_prefix")
    return rows.select(
        "repo", "path", "seq", F.col("assigned_to").alias("var"),
        F.coalesce(_positional(F.col("args"), 0)["value"], F.lit("")).alias("name"),
        F.when(prefix.isNull(), "").otherwise(prefix["text"]).alias("url_prefix"),
        (prefix.isNull() | prefix["value"].isNotNull()).alias("prefix_literal"),
        F.when(prefix.isNull(), "").otherwise(prefix["value"]).alias("prefix"),
    )


def routes(facts: DataFrame) -> DataFrame:
    """Route declarations in their three forms, with the blueprint prefix of the same file.

    ``rule`` is the source text, ``rule_value`` its literal value (null when it is computed).
    """
    # the blueprints of a file travel along with its calls, so no join is needed
    own_bps = F.transform(
        F.filter("calls", lambda c: _is_blueprint(c["chain"], c["assigned_to"])),
        lambda c: F.named_struct(
            F.lit("var"), c["assigned_to"], F.lit("prefix"), F.coalesce(_keyword(c["args"], "url_prefix")["text"], F.lit(""))
        ),
    )
    rows = facts.select("repo", "path", own_bps.alias("bps"), F.posexplode("calls").alias("seq", "r")).select("repo", "path", "bps", "seq", "r.*")
    chain, args = F.col("chain"), F.col("args")
    owner, attr = chain[0], F.element_at(chain, -1)
    pairs = rows.where((F.size("chain") == 2) & ~owner.startswith("<"))
    pairs = pairs.withColumn("bp", owner).withColumn("attr", attr)
    prefix = F.get(F.filter("bps", lambda b: b["var"] == F.col("bp")), F.lit(0))["prefix"]
    pairs = pairs.withColumn("url_prefix", prefix).drop("bps")
    decorated = pairs.where(F.col("decorates").isNotNull() & F.col("attr").isin("route", *HTTP_METHODS))
    added = pairs.where(F.col("attr") == "add_url_rule")
    kw_methods = F.transform(_keyword(args, "methods")["strs"], F.upper)

    first = _positional(args, 0)
    form = F.when(F.col("attr") == "route", "route").otherwise("shorthand")
    default = F.when(F.col("attr") == "route", F.array(F.lit("GET"))).otherwise(F.array(F.upper("attr")))
    own_methods = F.when(F.size(kw_methods) > 0, kw_methods).otherwise(default)
    dec = decorated.select(
        "repo", "path", "seq", "bp", "url_prefix", form.alias("via"),
        F.when(first.isNull(), "").otherwise(first["text"]).alias("rule"), first["value"].alias("rule_value"),
        F.sort_array(F.array_distinct(own_methods)).alias("methods"),
        F.col("decorates").alias("endpoint"), F.col("decorates_line").alias("lineno"),
        text.first_line("decorates_doc").alias("purpose"), F.col("owner_param_of").isNotNull().alias("owner_is_param"),
        F.col("owner_param_of").alias("registrar"),
    )
    rule_kw, name_kw, view = _keyword(args, "rule"), _keyword(args, "endpoint"), _keyword(args, "view_func")
    second, third = _positional(args, 1), _positional(args, 2)
    literal = F.when(rule_kw["value"].isNotNull(), rule_kw).when(first["value"].isNotNull(), first)
    given = F.coalesce(name_kw["value"], second["value"], view["ident"])
    listed = F.coalesce(
        F.when(F.size(kw_methods) > 0, kw_methods),
        F.when(F.size(third["strs"]) > 0, F.transform(third["strs"], F.upper)),
        F.array(F.lit("GET")),
    )
    rule_text = F.coalesce(literal["text"], F.lit(""))
    placeholder = F.concat(F.lit("<"), F.regexp_replace(rule_text, "^'+|'+$", ""), F.lit(">"))
    via_add = added.select(
        "repo", "path", "seq", "bp", "url_prefix", F.lit("add_url_rule").alias("via"), rule_text.alias("rule"),
        literal["value"].alias("rule_value"), F.sort_array(F.array_distinct(listed)).alias("methods"),
        F.when(given != "", given).otherwise(placeholder).alias("endpoint"), "lineno",
        F.lit(None).cast("string").alias("purpose"), F.col("bp").endswith("bp").alias("owner_is_param"),
        F.lit(None).cast("string").alias("registrar"),
    )
    joined = dec.unionByName(via_add)
    known = F.col("url_prefix").isNotNull()
    kept = joined.where((F.col("via") != "shorthand") | known | F.col("bp").isin(*APP_LIKE_OWNERS))
    param = F.when(F.col("via") == "add_url_rule", ~known & F.col("owner_is_param")).otherwise(F.col("owner_is_param"))
    return kept.withColumn("owner_is_param", param).withColumn("url_prefix", F.coalesce("url_prefix", F.lit("")))


def route_symbol(rule: Column | str) -> Column:
    """Rule text without its paired quotes, so that a URL is a searchable name."""
    return F.regexp_replace(text.strip(rule), "^(['\"])(.*)\\1$", "$2")


def handlers(facts: DataFrame) -> DataFrame:
    """Exception handlers, for the swallowed-error checks: what they return, and whether they look at the error."""
    rows = _records(facts, "handlers")
    literal = F.exists("returns", lambda kind: kind.isin("Constant", "List", "Dict", "Tuple"))
    return rows.withColumn("const_return", literal).withColumn("uses_error", F.col("caught").isNotNull() & F.array_contains("names", F.col("caught")))


def exported(listed: Column | str) -> Column:
    """Names that a file lists in its first ``__all__``."""
    own = F.get(F.filter(listed, lambda x: F.array_contains(x["targets"], "__all__")), F.lit(0))
    return F.coalesce(own["strs"], F.array().cast("array<string>"))


def split_by_cache(files: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(reusable, to_parse)`` by comparing the current files with the facts of the previous run.

    A file is reusable when its (mtime, size) signature is unchanged, else when its content hash is. ``reason`` is
    ``sig``, ``hash``, ``changed`` or ``new``. ``known`` has ``repo, path, mtime, size, code_hash``. ``sources.factstore``
    keeps facts from run to run with it.
    """
    rows = judge_files(files, known)
    hit = F.col("reason").isin("sig", "hash")
    return rows.where(hit), rows.where(~hit)


def judge_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Repo, path, mtime, size, code_hash and ``reason`` of each file; contents are hashed where they lie and not moved."""
    old = known.select(
        "repo", "path", F.col("mtime").alias("old_mtime"), F.col("size").alias("old_size"), F.col("code_hash").alias("old_hash")
    )
    now = files.select("repo", "path", "mtime", "size", content_key("content").alias("code_hash"))
    joined = now.join(old, ["repo", "path"], "left")
    same_sig = (F.col("mtime") == F.col("old_mtime")) & (F.col("size") == F.col("old_size"))
    reason = (
        F.when(F.col("old_hash").isNull(), "new")
        .when(same_sig, "sig")
        .when(F.col("code_hash") == F.col("old_hash"), "hash")
        .otherwise("changed")
    )
    return joined.select("repo", "path", "mtime", "size", "code_hash", reason.alias("reason"))
