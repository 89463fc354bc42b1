"""C-family facts as regex expressions over the text (C9, F8): includes, defines, classes, functions.

Patterns are multi-line; a match is located by inserting a mark before it and splitting there, so the line of a match is
one plus the line breaks before it. All of this stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.functions import paths, text
from codefacts.functions.arrays import once, sums_before
from codefacts.profile import CXX_EXTS

# ---------------------------------------------------------------- fixed values
INCLUDE = r'(?m)^\s*#\s*include\s*([<"])([^">]+)[">]'
DEFINE = r"(?m)^\s*#\s*define\s+\w+"
CLASS = (
    r"(?m)^\s*(?:template\s*<[^>]*>\s*)?(class|struct)\s+([A-Za-z_]\w*)"
    r"(?:\s*:\s*([^{;]+))?\s*[{;]?"
)
FUNCTION = (
    r"(?m)^(?!\s*[A-Za-z_~]\w*\s*::\s*\w*\s*\()([A-Za-z_][\w:<>,\s\*&]*?)\b"
    r"([A-Za-z_~]\w*(?:::[A-Za-z_~]\w*)*)\s*\(([^;{)]*)\)\s*(?:const\s*)?(?:override\s*)?\{"
)
COMMENT = r"(?s)/\*.*?\*/"
NOT_FUNCTIONS = ("if", "for", "while", "switch", "return", "catch")
# ----------------------------------------------------------- end of fixed values



def blank_comments(col: Column | str) -> Column:
    """Comments replaced by blanks, line breaks kept; a comment without an end stays as it is."""
    body = paths._c(col)
    around = F.split(body, COMMENT)
    blanked = F.transform(F.regexp_extract_all(body, F.lit(COMMENT), F.lit(0)), lambda c: F.regexp_replace(c, r"[^\n]", " "))
    pieces = F.zip_with(around, blanked, lambda text_, comment: F.concat(text_, F.coalesce(comment, F.lit(""))))
    return F.regexp_replace(F.array_join(pieces, ""), r"//[^\n]*", "")


def _located(body: str, pattern: str) -> Column:
    """An array of (piece, lineno): the text from each match to the next one, and the line of the match.

    Lines are counted inside the row of the file; the text is neither marked nor moved.
    """
    group = "(?m)" + pattern.removeprefix("(?m)")
    cut = F.struct(F.regexp_extract_all(body, F.lit(group), F.lit(0)).alias("found"), F.split(body, group, -1).alias("between"))

    def pieces(c: Column) -> Column:
        after = F.slice(c["between"], F.lit(2), F.size(c["found"]))
        return F.struct(F.zip_with(c["found"], after, lambda m, rest: F.concat(m, rest)).alias("pieces"), text.count_breaks(F.get(c["between"], F.lit(0))).cast("long").alias("first"))

    def numbered(c: Column) -> Column:
        above = sums_before(F.transform(c["pieces"], lambda p: text.count_breaks(p).cast("long")))
        return F.zip_with(c["pieces"], above, lambda p, n: F.struct(p.alias("piece"), (c["first"] + n + 1).cast("int").alias("lineno")))

    return once(once(cut, pieces), numbered)


def sources(files: DataFrame) -> DataFrame:
    return files.where(paths.extension("path").isin(*CXX_EXTS)).select("repo", "path", "content")


def _last_part(name: Column) -> Column:
    return F.element_at(F.split(name, "::"), -1)


def _class_of(m: Column) -> Column:
    piece, lineno = m["piece"], m["lineno"]
    bases = F.transform(
        F.split(F.regexp_extract(piece, CLASS, 3), ","),
        lambda b: _last_part(F.split(text.strip(F.regexp_replace(b, r"\b(?:public|protected|private|virtual)\b", "")), "<")[0]),
    )

    def method(f: Column) -> Column:
        name = _last_part(F.regexp_extract(f, FUNCTION, 2))
        signature = F.concat(name, F.lit("("), text.strip(F.regexp_extract(f, FUNCTION, 3)), F.lit(")"))
        return F.struct(name.alias("name"), signature.alias("signature"), f.contains("= 0").alias("abstract"), (lineno + text.count_breaks(f)).cast("int").alias("lineno"))

    return F.struct(
        F.regexp_extract(piece, CLASS, 2).alias("name"), F.regexp_extract(piece, CLASS, 1).alias("kind"),
        F.filter(F.transform(bases, text.strip), lambda b: b != "").alias("bases"), lineno.alias("lineno"),
        F.transform(F.regexp_extract_all(piece, F.lit(FUNCTION), F.lit(0)), method).alias("methods"),
    )


def _function_of(m: Column) -> Column:
    name = _last_part(F.regexp_extract(m["piece"], FUNCTION, 2))
    head = F.split(F.regexp_extract(m["piece"], FUNCTION, 0), r"\{")[0]
    return F.struct(name.alias("name"), text.strip(head).alias("signature"), m["lineno"].alias("lineno"), (~name.startswith("_")).alias("public"))


def extract(files: DataFrame) -> DataFrame:
    """One row per C-family file with all its facts, from one reading of its text; nothing is moved.

    ``includes``, ``classes`` (their ``methods`` in them; the body of a class ends where the next one starts) and ``functions``
    are arrays; a consumer that wants one of them reads no other.
    """
    content = F.col("content")
    block = F.regexp_extract(content, r"(?s)\A\s*/\*\*?(.*?)\*/", 1)
    lines = F.filter(
        F.transform(F.split(block, r"\n"), lambda x: F.regexp_replace(x, r"^[ *\t\r]+|[ *\t\r]+$", "")), lambda x: x != ""
    )
    slash = text.strip(F.regexp_extract(content, r"(?m)^\s*//\s*(.+)$", 1))
    has_block = F.rlike(content, F.lit(r"(?s)\A\s*/\*\*?.*?\*/"))
    doc = F.when(has_block, F.get(lines, F.lit(0))).when(slash != "", slash)
    included = F.transform(
        F.regexp_extract_all("content", F.lit(INCLUDE), F.lit(0)),
        lambda m: F.struct(text.strip(F.regexp_extract(m, INCLUDE, 2)).alias("target"), (F.regexp_extract(m, INCLUDE, 1) == "<").alias("system")),
    )
    clean = sources(files).withColumn("clean", blank_comments("content"))
    functions_ = F.filter(F.transform(_located("clean", FUNCTION), _function_of), lambda f: ~f["name"].isin(*NOT_FUNCTIONS))
    return clean.select(
        "repo", "path", text.total_lines(content).alias("loc_total"), text.code_lines(content).alias("loc_code"),
        F.regexp_count(content, F.lit(DEFINE)).alias("defines"), doc.alias("docstring"), included.alias("includes"),
        F.transform(_located("clean", CLASS), _class_of).alias("classes"), functions_.alias("functions"),
    )


def _facts(df: DataFrame) -> DataFrame:
    """``df`` is either files with their content or what ``extract`` made of them."""
    return extract(df) if "content" in df.columns else df


def file_facts(df: DataFrame) -> DataFrame:
    """Per file, line counts, number of defines and the first line of the leading comment."""
    return _facts(df).select("repo", "path", "loc_total", "loc_code", "defines", "docstring")


def includes(df: DataFrame) -> DataFrame:
    """Include directives in order; ``system`` for the angle-bracket form."""
    return _facts(df).select("repo", "path", F.posexplode("includes").alias("seq", "m")).select("repo", "path", "seq", "m.target", "m.system")


def include_modules(incs: DataFrame) -> DataFrame:
    """Local includes as module names (no directory, no header suffix), for import rollups."""
    name = F.regexp_replace(paths.basename(paths.posix("target")), r"(?i)\.(?:h|hpp|hh|hxx|inl)$", "")
    return incs.where(~F.col("system")).select("repo", "path", name.alias("module")).where("module <> ''")


def classes(df: DataFrame) -> DataFrame:
    """Classes and structs."""
    return _facts(df).select("repo", "path", F.explode("classes").alias("c")).select("repo", "path", "c.name", "c.kind", "c.bases", "c.lineno")


def methods(df: DataFrame) -> DataFrame:
    """Function definitions inside a class body; ``abstract`` as they say ``= 0``."""
    rows = _facts(df).select("repo", "path", F.explode("classes").alias("c"))
    listed = rows.select("repo", "path", F.col("c.name").alias("class_name"), F.col("c.lineno").alias("class_line"), F.posexplode("c.methods").alias("seq", "m"))
    return listed.select("repo", "path", "class_name", "class_line", "seq", "m.name", "m.signature", "m.abstract", "m.lineno")


def functions(df: DataFrame) -> DataFrame:
    """Function definitions that start at the left margin."""
    return _facts(df).select("repo", "path", F.explode("functions").alias("f")).select("repo", "path", "f.name", "f.signature", "f.lineno", "f.public")
