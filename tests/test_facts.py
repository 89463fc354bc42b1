"""The facts job on single snippets: definitions, routes, imports, calls, failures."""

import random

import pytest
from conftest import rows

from codefacts.operators import audit as au
from codefacts.operators import cxx
from codefacts.operators import facts as fx
from codefacts.sources import factstore as fs


@pytest.fixture
def parse(make_files):
    def run(text, path="m.py"):
        return fx.extract_facts(make_files({path: text})).cache()

    return run


def test_empty_comments_and_failures(make_files):
    files = make_files({"a.py": "", "b.py": "# only\n", "c.py": "def (", "d.py": "x = 1\x00", "e.py": "(" * 5000 + ")" * 5000, "n.txt": "def ("})
    got = {r.path: r.ok for r in fx.extract_facts(files).collect()}
    assert got == {"a.py": True, "b.py": True, "c.py": False, "d.py": False, "e.py": False}
    bad = {r.path: r.error for r in fx.failures(fx.extract_facts(files)).collect()}
    assert bad["c.py"].startswith("SyntaxError: ")


def test_signatures(parse):
    f = parse("async def f(a, /, b: int = 1, *args, c, d=2, **kw) -> dict[str, int]:\n    'One.\\n\\n    Two.'\ndef g(*, x): pass\ndef _h(): pass\n")
    assert rows(fx.functions(f), "name", "signature", "docstring", "public") == [
        ("_h", "def _h()", None, False), ("f", "def f(a, /, b: int=1, *args, c, d=2, **kw) -> dict[str, int]", "One.", True), ("g", "def g(*, x)", None, True)]


def test_only_direct_definitions_count(parse):
    f = parse("if True:\n    def hidden(): pass\nclass A:\n    def m(self):\n        def inner(): pass\n    class B:\n        def n(self): pass\n    if 1:\n        def o(self): pass\n")
    assert rows(fx.functions(f)) == []
    assert rows(fx.classes(f), "name") == [("A",)]
    assert rows(fx.methods(f), "class_name", "name") == [("A", "m")]
    assert sorted(r.name for r in fx.function_spans(f).collect()) == ["hidden", "inner", "m", "n", "o"]


def test_abstract_and_base(parse):
    f = parse("import abc\nclass A(x.y.MyBasePlugin):\n    @abc.abstractmethod\n    def a(self): pass\n    @abstractproperty\n    def b(self): pass\n    @other.thing()\n    def c(self): pass\n")
    assert rows(fx.methods(f), "name", "abstract") == [("a", True), ("b", True), ("c", False)]
    assert fx.classes(f).first().inherits_base and fx.classes(f).first().bases == ["MyBasePlugin"]


def test_routes_of_all_forms(parse):
    f = parse(
        "from flask import Blueprint\nbp = Blueprint('b', __name__, url_prefix='/x')\n"
        "@bp.get('/g')\ndef g():\n    'Purpose.'\n@bp.post('/p')\ndef p(): pass\n@other.get('/no')\ndef no(): pass\n@app.put('/app')\ndef a(): pass\n"
        "bp.add_url_rule('/u', 'ep_u', methods=['GET', 'post'])\nbp.add_url_rule('/v', view_func=V.view)\nnbp.add_url_rule('/w')\n"
        "def register_routes(view):\n    @view.route('/inner' + s)\n    def inner(): pass\nregister_routes(bp)\n"
    )
    got = {r.endpoint: r for r in fx.routes(f).collect()}
    assert set(got) == {"g", "p", "a", "ep_u", "view", "</w>", "inner"}
    assert got["g"].via == "shorthand" and got["g"].methods == ["GET"] and got["g"].purpose == "Purpose." and got["g"].url_prefix == "'/x'"
    assert got["ep_u"].methods == ["GET", "POST"] and got["ep_u"].via == "add_url_rule"
    assert got["inner"].owner_is_param and got["inner"].registrar == "register_routes" and got["inner"].rule_value is None
    assert got["</w>"].owner_is_param and not got["ep_u"].owner_is_param
    assert ("register_routes", "bp") in rows(fx.single_name_calls(f), "f", "a")


def test_prefix_that_is_not_a_literal(parse):
    b = fx.blueprints(parse("bp = flask.Blueprint('b', n, url_prefix=PREFIX)\nc = Blueprint('c', n)\n")).orderBy("var").collect()
    assert (b[0].prefix_literal, b[0].prefix, b[0].url_prefix) == (False, None, "PREFIX")
    assert (b[1].prefix_literal, b[1].prefix) == (True, "")


def test_imports(parse):
    f = parse("import a.b, c as d\nfrom . import e\nfrom ..f import g as h\nfrom i import *\ntry:\n    import a.b\nexcept E: pass\n")
    assert rows(fx.imports(f), "module") == [("a.b",), ("c",), ("f",), ("i",)]
    assert len(rows(fx.import_facts(f))) == 5


def test_call_sites(parse):
    f = parse("x()\nclass C:\n    y = z.w.v.u()\n    def m(self): a()(b).c(); [1][0](2); self.n()\n@deco(k)\ndef f(q=dflt()): return lambda: inner()\n")
    assert rows(fx.calls(f), "caller", "target") == sorted([
        ("@module", "x"), ("C", "z.w.v.u"), ("C.m", "a"), ("C.m", "<expr>.c"), ("C.m", "self.n"), ("f", "deco"), ("f", "dflt"), ("f", "inner")], key=repr)


def test_syntax_checks(parse):
    f = parse(
        "from __future__ import annotations\nimport os, sys as system, json.decoder\nfrom a import b, c\nfrom a import b\nfrom z import *\n__all__ = ['c']\nprint(json)\n"
        "def f():\n    try: pass\n    except E: pass\n    try: pass\n    except E as e: return None\n    try: pass\n    except E as e:\n        log(e); return []\n"
        "    try: pass\n    except E:\n        raise\n        return 1\n    try: pass\n    except E: return x\n"
    )
    assert [r.lineno for r in au.bare_except(f).collect()] == [10]
    assert [r.lineno for r in au.except_return_fallback(f).collect()] == [12]
    assert rows(au.unused_imports(f), "snippet", "lineno") == [("unused import b", 4), ("unused import os", 2), ("unused import system", 2)]
    assert au.long_function(f, 10).count() == 1 and au.long_function(f).count() == 0


def test_cache_judgement(make_files):
    files = make_files({"same.py": "a", "touched.py": "b", "edited.py": "c", "new.py": "d"})
    from pyspark.sql import functions as F

    old = fx.extract_facts(make_files({"same.py": "a", "touched.py": "b", "edited.py": "old", "gone.py": "x"}))
    known = old.select("repo", "path", F.when(F.col("path") == "same.py", 0).otherwise(9).alias("mtime"), F.lit(1).alias("size"), "code_hash")
    reused, todo = fx.split_by_cache(files, known)
    assert {(r.path, r.reason) for r in reused.collect()} == {("same.py", "sig"), ("touched.py", "hash")}
    assert {(r.path, r.reason) for r in todo.collect()} == {("edited.py", "changed"), ("new.py", "new")}


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_fact_store(spark, make_files, tmp_path, monkeypatch, sent):
    """Kept, touched, edited, new and deleted files over four runs; nothing that holds a text is moved."""
    from pyspark.sql import functions as F

    def run(texts, mtimes):
        changed = F.lit(0)
        for path, mtime in mtimes.items():
            changed = F.when(F.col("path") == path, mtime).otherwise(changed)
        return make_files(texts).withColumn("mtime", changed.cast("long"))

    folder, parsed = str(tmp_path / "store"), []
    real = fx.extract_facts
    monkeypatch.setattr(fs.fx, "extract_facts", lambda files, keep=(): parsed.append(files) or real(files, keep))
    first = {"same.py": "a", "touched.py": "b", "edited.py": "old", "gone.py": "x", "note.md": "no"}
    second = {"same.py": "a", "touched.py": "b", "edited.py": "c", "new.py": "d"}
    fs.refresh(run(first, {}), folder, 4, sent)
    fs.refresh(run(second, {"touched.py": 7, "edited.py": 8}), folder, 4, sent)
    if sent:
        assert [r.path for r in parsed[-1].orderBy("path").collect()] == ["edited.py", "new.py"]
    plan = parsed[-1]._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "content" in x] and "SortMergeJoin" not in plan
    got = fs.load(spark, folder)
    assert rows(got, "path", "mtime", "size", "code_hash") == sorted((p, {"touched.py": 7, "edited.py": 8}.get(p, 0), 1, h) for p, h in rows(real(make_files(second)), "path", "code_hash"))
    for name in [t.name for t in spark.catalog.listTables() if t.name.startswith("codefacts_facts_")]:
        spark.sql(f"DROP TABLE {name}")  # another session knows the folder only
    again = fs.load(spark, folder)
    assert rows(again, "path") == rows(got, "path")
    keyed = again.select("repo", "path", "code_hash").join(make_files(second).select("repo", "path"), ["repo", "path"]).hint("merge")
    plan = again.select("repo", "path", "code_hash").hint("merge").join(make_files(second).select("repo", "path"), ["repo", "path"])._jdf.queryExecution().executedPlan().toString()
    assert keyed.count() == 4 and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    fs.refresh(run({}, {}), folder, 4, sent)
    assert fs.load(spark, folder).count() == 0
    fs.refresh(run(first, {}), folder, 4, sent)
    assert fs.load(spark, folder).count() == 4


# ------------------------------------------------------------------ C family
C_TEXT = '''/** Driver header
 * more */
#include "a/b.h"
#include <stdio.h>
  #  include "../c.hpp"
#define X 1
/* #include "dead.h" in a comment still counts as a directive only at line start
*/
template <class T>
class Foo : public Bar<int>, private virtual ns::Baz {
 public:
};
struct Qux { };
// class NotThis
static int go(int a,
              int b) {
  if (a) { return b; }
}
int Foo::bar(int x) const {
  return x;
}
'''


def test_c_family(make_files):
    files = make_files({"x.cpp": C_TEXT, "y.py": "class A: pass"})
    meta = cxx.file_facts(files).collect()
    assert [(m.path, m.docstring, m.defines) for m in meta] == [("x.cpp", "Driver header", 1)]
    assert [(r.target, r.system) for r in cxx.includes(files).orderBy("seq").collect()] == [("a/b.h", False), ("stdio.h", True), ("../c.hpp", False)]
    assert rows(cxx.include_modules(cxx.includes(files)), "module") == [("b",), ("c",)]
    assert [(r.name, r.kind, r.bases) for r in cxx.classes(files).orderBy("lineno").collect()] == [("Foo", "class", ["Bar", "Baz"]), ("Qux", "struct", [])]
    assert rows(cxx.functions(files), "name", "lineno") == [("bar", 19), ("go", 15)]
    facts = cxx.extract(files)
    assert rows(cxx.functions(facts)) == rows(cxx.functions(files)) and rows(cxx.classes(facts)) == rows(cxx.classes(files)) and rows(cxx.includes(facts)) == rows(cxx.includes(files))
    plan = cxx.includes(facts)._jdf.queryExecution().optimizedPlan().toString()
    assert "template" not in plan  # who asks for includes does not pay for classes


def test_methods_of_c_classes_are_definitions(make_files, spark):
    """Methods with what they say about themselves; they are definitions that a graph has as nodes."""
    from codefacts.operators import graph as gr
    from codefacts.operators import structure as st

    body = "class A : public B {\nint one(int x = 0) {\n    return x;\n  }\nvoid two() {\n  }\n};\nstruct C {\nint three() const {\n  }\n};\n"
    files = make_files({"lib/a.hpp": body, "lib/e.h": "", "m.py": "from lib import one\ndef f():\n    one()\n"})
    got = rows(cxx.methods(files), "class_name", "name", "signature", "abstract", "class_line", "lineno")
    assert [r[:5] for r in got] == [("A", "one", "one(int x = 0)", True, 1), ("A", "two", "two()", False, 1), ("C", "three", "three()", False, 8)]
    t = st.fact_tables(files, fx.extract_facts(files))
    assert rows(t.methods, "class_name", "name") == [("A", "one"), ("A", "two"), ("C", "three")]
    defs = gr.definitions(t.classes, t.methods, t.functions)
    assert {("A", "class"), ("A.one", "method"), ("C.three", "method"), ("f", "function")} <= {(r.symbol, r.kind) for r in defs.collect()}


def test_comment_blanking_keeps_lines(spark):
    import re

    rng = random.Random(5)
    texts = ["".join(rng.choice(["/*", "*/", "//", "\n", "a", " ", "*", "/"]) for _ in range(30)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")

    def want(t):
        t = re.sub(r"/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m.group(0)), t, flags=re.S)
        return re.sub(r"//[^\n]*", "", t)

    for r in df.select("i", cxx.blank_comments("t").alias("c")).collect():
        assert r.c == want(texts[r.i]), repr(texts[r.i])


def test_one_odd_file_does_not_stop_the_rest(parse):
    """Half characters, keywords given twice and long texts pass; nothing is shortened."""
    long = "/" + "x" * 150
    f = parse(
        f"x = '\\ud800'\nbp = Blueprint('b', __name__)\n@bp.route('{long}')\ndef v():\n    f(a=1, a=2)\n    a.b.c.d.e(x)\n    g('\\udfff', k='\\ud83d')\n"
    )
    assert fx.failures(f).count() == 0
    assert rows(fx.routes(f), "rule_value", "rule") == [(long, f"'{long}'")]
    assert ("v", "a.b.c.d.e") in rows(fx.calls(f), "caller", "target")
    assert [r.kwargs for r in fx.rule_calls(f).where("name = 'f'").collect()] == [{"a": "2"}]


def test_exports_are_read_from_the_first_list(parse):
    f = parse("__all__ = ['a', 'b']\nif x:\n    __all__ = ['c']\nother = ['d']\n")
    assert rows(f.select(fx.exported("listed").alias("e"))) == [(["a", "b"],)]


def test_files_are_parsed_once(make_files):
    facts = fx.extract_facts(make_files({"a.py": "def f(): pass\n"}))
    for made in (fx.functions(facts), fx.rule_calls(facts), fx.failures(facts)):
        assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_source_as_the_standard_library_prints_it():
    import ast

    from codefacts.functions.syntax import _source

    for code in ("x", "'it\\'s'", '"a\\n"', "u'k'", "1", "True", "None", "1e999", "2j", "b'x'", "...", "f(x)", "-1", "f'{x}'"):
        node = ast.parse(code, mode="eval").body
        assert _source(node) == ast.unparse(node)


def test_kinds_of_files_are_dealt_out(spark, tmp_path):
    """Each kind comes from a scan of its own; a reader that parses one kind must not find it in a few files."""
    from collections import defaultdict

    from pyspark.sql import functions as F

    from codefacts.plans import adapters as ad

    n = spark.range(1, 201)
    tables = {
        "nation": "0 as n_nationkey, 'PERU' as n_name", "supplier": "id as s_suppkey, 0 as s_nationkey, 's' as s_name, 1.0 as s_acctbal",
        "customer": "id as c_custkey, 0 as c_nationkey, 'c' as c_name, 1.0 as c_acctbal", "part": "id as p_partkey, 'p' as p_name, 'Brand#1' as p_brand, 2 as p_size",
    }
    for name, columns in tables.items():
        (n.limit(1) if name == "nation" else n).selectExpr(*columns.split(", ")).write.parquet(f"{tmp_path}/{name}.parquet")
    seen = defaultdict(set)
    stored = ad.stored_corpus(spark, str(tmp_path))
    for r in stored.select(F.input_file_name().alias("f"), F.element_at(F.split("path", "[.]"), -1).alias("kind")).distinct().collect():
        seen[r.f].add(r.kind)
    full = [kinds for kinds in seen.values() if {"py", "h"} <= kinds]
    assert len(seen) > 1 and len(full) == len(seen)


def test_signatures_are_those_of_the_unparser():
    import ast

    from codefacts.functions import syntax

    written = ["a, b=2", "", "a, b=x, c='y'", "a: int, *r, k=1, **o", "a, /, b=-1", "a=(1, 2)", "s=u'x', e=..., n=None, f=1.5, y=b'z'"]
    for text in written:
        args = ast.parse(f"def f({text}): pass").body[0].args
        assert syntax._signature(args) == ast.unparse(args)
