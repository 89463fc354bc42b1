"""Views of the driver's tables in the roles the operators expect (files, commits, numstat, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codefacts.session import materialize
from codefacts.sources.corpus import spread_rows, spread_scan

#: language of a document -> extension of the file it stands for
DOC_EXT = {"en": ".py", "fr": ".js", "de": ".css", "es": ".md"}


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """One driver table. ``spread`` is for stages that spend their time on the CPU, see ``spread_scan``."""
    scan = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread_scan(scan) if spread else scan


def doc_path() -> Column:
    ext = F.lit(".txt")
    for lang, e in DOC_EXT.items():
        ext = F.when(F.col("lang") == lang, e).otherwise(ext)
    return F.concat("lang", F.lit("/doc_"), F.col("doc_id").cast("string"), ext)


DOC_PATH_SQL = (
    "lang || '/doc_' || doc_id || case lang when 'en' then '.py' when 'fr' then '.js' "
    "when 'de' then '.css' when 'es' then '.md' else '.txt' end"
)


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as source files: repository = source, path = language and id, content = the whole text."""
    return table(spark, sf_dir, "documents", spread=True).select(
        F.col("source").alias("repo"),
        doc_path().alias("path"),
        F.col("text").alias("content"),
        F.octet_length("text").cast("long").alias("size"),
        F.col("n_chars").alias("mtime"),
    )


def line_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as numstat rows: commit = order, file = part, added = quantity, deleted = line number."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("repo"),
        F.col("l_orderkey").cast("string").alias("sha"),
        F.concat(F.lit("src/p"), F.col("l_partkey").cast("string"), F.lit(".py")).alias("path"),
        F.col("l_quantity").cast("int").alias("added"),
        F.col("l_linenumber").alias("deleted"),
        F.col("l_shipdate").alias("ts"),
    )


def part_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as the current size of each file; brand is the component it belongs to."""
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"),
        F.col("p_size").alias("loc"),
        F.col("p_brand").alias("brand"),
    )


def order_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as commits: repository = priority, author = customer."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("repo"),
        F.col("o_orderkey").cast("string").alias("sha"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("author_name"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@example.org")).alias("author_email"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderstatus").alias("message"),
    )


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` below ``order_commits``: the repository comes from the order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("repo"))
    lines = table(spark, sf_dir, "lineitem")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return joined.select(
        "repo",
        F.col("l_orderkey").cast("string").alias("sha"),
        F.concat(F.lit("src/p"), F.col("l_partkey").cast("string"), F.lit(".py")).alias("path"),
        F.col("l_quantity").cast("int").alias("added"),
        F.col("l_linenumber").alias("deleted"),
    )


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stream-shaped change log: repository = event type, file = user."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("repo"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".py")).alias("path"),
        F.col("event_id").cast("string").alias("sha"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.floor("value").cast("int").alias("added"),
        F.lit(0).alias("deleted"),
    )


# ------------------------------------------------------------------ a code corpus derived from the tables
# Each nation is a repository: its suppliers are components, its customers are core modules. Parts are C headers of
# one more repository. The texts are built by Spark from the rows, so the corpus grows with the tables.

COMPONENT_INIT = '''"""Component of %1$s."""
from shared.base import BasePlugin, helper as h
from plugins.s%3$s import S%3$s
import os.path


class S%2$s(BasePlugin):
    """Acts for %1$s."""

    def run(self, n: int = 1, *rest):
        """Run it."""
        return h(n)

    def _hidden(self):
        return os.path.join(S%3$s, S%3$s(self))
'''

COMPONENT_ROUTES = '''from flask import Blueprint
from . import S%2$s
bp = Blueprint('s%2$s', __name__, url_prefix='/%4$s/s%2$s')


@bp.route('/n%3$s', methods=['GET', 'post'])
def view_%2$s(req):
    """View of %1$s."""
    try:
        return eval(req)
    except ValueError:
        pass


def register(app2):
    @app2.get('/x')
    def lost():
        return S%2$s


@bp.post('/p%2$s')
def save_%2$s(req):
    try:
        subprocess.run(req, shell=True)
    except Exception:
        return None
'''

MODULE_FILE = '''import os
import json as js
from shared.base import pooled as p
%3$s

TOKEN = os.environ


def load_%2$s(x, y=2):
    """Load %1$s."""
    return p(x)


def run_%2$s():
    return load_%2$s(1) + js.dumps(x)
'''

SHARED_BASE = '''"""Shared helpers."""
from abc import ABC, abstractmethod


class BasePlugin(ABC):
    """Base of all components."""

    @abstractmethod
    def run(self, n):
        """Do the work."""


def pooled(x):
    return helper(x)


def helper(x):
    return x
'''

HEADER_FILE = '''/* Part %1$s
 * of %2$s */
#include "p%3$s.h"
#include <vector>
#define P%1$s_SIZE %4$s
struct P%1$s : public Base<int>, ns::Part {
  int size;
};
// free function
int size_of_p%1$s(int a,
  int b) {
  return a;
}
'''


def repo_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.lower(F.translate("n_name", " ", "_")).alias("repo"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with their repository and the component each one imports.

    Components form rings: the next supplier of the nation among each hundred keys, the last one imports the first.
    """
    rows = table(spark, sf_dir, "supplier").join(
        repo_names(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey")
    )
    ring = Window.partitionBy("repo", "ring")
    rows = rows.withColumn("ring", F.floor(F.col("s_suppkey") / 100))
    following = F.lead("s_suppkey").over(ring.orderBy("s_suppkey"))
    return rows.withColumn("next_key", F.coalesce(following, F.min("s_suppkey").over(ring))).drop("ring")


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: files of all derived repositories."""
    sup = spread_rows(suppliers(spark, sf_dir))
    key = F.col("s_suppkey").cast("string")
    here = F.concat(F.lit("plugins/s"), key)
    admin = F.when(F.col("s_acctbal") < 0, "open").otherwise("admin")
    init = F.format_string(COMPONENT_INIT, "s_name", "s_suppkey", "next_key")
    route_text = F.format_string(COMPONENT_ROUTES, F.col("s_name"), F.col("s_suppkey"), F.col("s_nationkey"), admin)
    version = F.when(F.col("s_acctbal") < 0, "1.0").otherwise("1.0.0")
    manifest = F.to_json(F.struct(
        F.concat(F.lit("s"), key).alias("identifier"), F.col("s_name").alias("name"), version.alias("version"),
        F.lit("made of rows").alias("description"), F.lit("t").alias("author"), F.lit("0.1.0").alias("min_app_version"),
        F.when(F.col("s_acctbal") > 9000, "chief").otherwise("business").alias("agent_role"),
        F.when(F.col("s_acctbal") > 5000, F.array(F.lit("sell"))).otherwise(F.array().cast("array<string>")).alias("capabilities"),
        F.create_map(F.concat(F.lit("s"), F.col("next_key").cast("string")), F.lit(">=1.0.0")).alias("depends_on"),
    ))
    parts = F.array(
        F.struct(F.concat(here, F.lit("/__init__.py")).alias("path"), init.alias("content")),
        F.struct(F.concat(here, F.lit("/routes.py")).alias("path"), route_text.alias("content")),
        F.struct(F.concat(here, F.lit("/plugin.json")).alias("path"), manifest.alias("content")),
        F.struct(F.concat(here, F.lit("/README.md")).alias("path"), F.concat(F.lit("# "), "s_name").alias("content")),
    )
    component_files = sup.select("repo", F.explode(parts).alias("f")).select("repo", "f.*")

    names = repo_names(spark, sf_dir)
    cust = table(spark, sf_dir, "customer", spread=True).join(names, F.col("c_nationkey") == F.col("n_nationkey"))
    # a customer in debt breaks the layering, one with a large balance does not parse
    extra = F.when(F.col("c_acctbal") < 0, "from plugins.s1 import S1").when(F.col("c_acctbal") > 9500, "def broken(:").otherwise("")
    module = F.format_string(MODULE_FILE, F.col("c_name"), F.col("c_custkey"), extra)
    core_path = F.concat(F.lit("core/c"), F.col("c_custkey").cast("string"), F.lit(".py"))
    core_files = cust.select("repo", core_path.alias("path"), module.alias("content"))
    shared = names.select("repo", F.lit("shared/base.py").alias("path"), F.lit(SHARED_BASE).alias("content"))

    part = table(spark, sf_dir, "part", spread=True)
    partner = F.col("p_partkey") + F.when(F.col("p_partkey") % 2 == 0, 1).otherwise(-1)
    header = F.format_string(HEADER_FILE, F.col("p_partkey"), F.col("p_name"), partner, F.col("p_size"))
    header_path = F.concat(F.lit("lib/"), F.lower(F.translate("p_brand", "#", "")), F.lit("/p"), F.col("p_partkey").cast("string"), F.lit(".h"))
    headers = part.select(F.lit("parts").alias("repo"), header_path.alias("path"), header.alias("content"))

    files = component_files.unionByName(core_files).unionByName(shared).unionByName(headers)
    return files.withColumn("size", F.octet_length("content").cast("long")).withColumn("mtime", F.lit(0).cast("long"))


def stored_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files, written once for several readers.

    Every kind of file comes from a scan of its own; they are dealt out before they are written, else a reader that parses one
    kind finds it in a few splits, which grow with the tables.
    """
    return materialize(spread_rows(code_corpus(spark, sf_dir)))


WORKFLOW_FILE = '''name: ci %1$s
on: push
jobs:
  build:
    %2$s
    steps:
      - uses: actions/checkout@%3$s
      - uses: org/tool@v%1$s
        shell: bash
      - run: %4$s
    env:
      # password: hidden
      TOKEN: x
      %5$s: abcdefghijklmnop%1$s
'''


def workflow_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One workflow file per supplier; nations with an odd key use the second platform."""
    sup = table(spark, sf_dir, "supplier", spread=True).join(repo_names(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
    limit = F.when(F.col("s_acctbal") > 5000, "timeout-minutes: 30").otherwise("runs-on: linux")
    pin = F.when(F.col("s_acctbal") > 2000, F.sha1("s_name")).otherwise("v4")
    run = F.when(F.col("s_acctbal") < 0, "echo ::set-output name=a::b").when(F.col("s_acctbal") > 8000, "set -e").otherwise("npm --registry registry.npmjs.org")
    name = F.when(F.col("s_acctbal") < 1000, "password").otherwise("api_key")
    folder = F.when(F.col("s_nationkey") % 2 == 1, ".gitee").otherwise(".github")
    return sup.select(
        "repo", F.concat(folder, F.lit("/workflows/w"), F.col("s_suppkey").cast("string"), F.lit(".yml")).alias("path"),
        F.format_string(WORKFLOW_FILE, F.col("s_suppkey"), limit, pin, run, name).alias("content"),
    )


BASE_FILE = '''class BasePlugin:
    """Base of %1$s."""

    @abstractmethod
    def run_%2$s(self): pass

    def stop(self, hard=False): pass

    def _inner(self): pass
'''

ENTRY_FILE = '''"""Entry of %1$s."""


@app.route('/health')
def health():
    return 1
'''


def framework_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One repository per supplier with a component framework, one undocumented component and an entry script."""
    sup = table(spark, sf_dir, "supplier", spread=True)

    def file(path: str, *text) -> Column:
        body = F.lit(text[0]) if len(text) == 1 else F.format_string(*text)
        return F.struct(F.lit(path).alias("path"), body.alias("content"))

    hooks = F.concat(F.lit("class Hook"), F.col("s_nationkey").cast("string"), F.lit(": pass\ndef emit(): pass\ndef _no(): pass\n"))
    manifest = F.concat(F.lit('{"identifier": "c", "version": "'), F.col("s_nationkey").cast("string"), F.lit('.0.0", "capabilities": ["x"]}'))
    files = F.array(
        file("plugin_manager/base.py", BASE_FILE, "s_name", "s_suppkey"),
        file("plugin_manager/manager.py", "class First: pass\nclass My%1$sManager:\n    def list_all(self): pass\n", "s_suppkey"),
        file("plugin_manager/discovery.py", '"""Rules.\n\n1. init %1$s\n"""', "s_suppkey"),
        F.struct(F.lit("plugin_manager/hooks.py").alias("path"), hooks.alias("content")),
        file("plugins/_base/db.py", '"""Pool."""\n'),
        file("plugins/_templates/basic/plugin.json", '{"name": "T%1$s", "version": "9"}', "s_suppkey"),
        file("plugins/c/__init__.py", ""),
        F.struct(F.lit("plugins/c/plugin.json").alias("path"), manifest.alias("content")),
        file("main.py", ENTRY_FILE, "s_name"),
    )
    rows = sup.select(F.concat(F.lit("w"), F.col("s_suppkey").cast("string")).alias("repo"), F.explode(files).alias("f")).select("repo", "f.*")
    return rows.withColumn("size", F.octet_length("content").cast("long")).withColumn("mtime", F.lit(0).cast("long"))
