"""Queries over source files that break rules: secrets, built SQL, raw connections, long functions, large files, mounted routes.

Each customer of the tables is a component with one service file; what its lines do follows from the customer's key, nation and
balance. Each supplier is a repository whose routes are mounted in every way that is known.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codefacts.operators import audit as au
from codefacts.operators import census as ce
from codefacts.operators import facts as fx
from codefacts.operators import gates as gt
from codefacts.operators import matching as mt
from codefacts.operators import overview as ov
from codefacts.operators import rules as ru
from codefacts.plans import adapters as ad
from codefacts.plans.catalog_facts import endpoints_of
from codefacts.plans.registry import query
from codefacts.profile import Profile
from codefacts.session import materialize
from codefacts.sources import manifests as mf

SERVICE_FILE = """import psycopg2
password = '%2$s'
cur.execute(%3$s)
requests.get(url)
%4$s(url)
if %5$s:
    raise ValueError
conn = %6$s
%7$s
done = [conn.execute(q)]
db = %8$s(dsn)
def long_%1$s():
%9$s"""

ROUTE_FILE = """from flask import Blueprint
bp = Blueprint('a%1$s', __name__, url_prefix='%2$s')


@bp.route('/x')
def x(): ...
"""

#: the same choices in SQL
_PRACTICE = """with a as (select lower(replace(n_name, ' ', '_')) as repo, c_custkey as k, n_nationkey as nk, c_acctbal as bal, 'plugins/a' || c_custkey || '/svc.py' as path,
  case when c_custkey % 7 = 0 then '{<vault' || c_custkey || '>}' when c_acctbal > 0 then 'Secretvalue' || c_custkey else 'changeme-' || c_custkey end as secret,
  case when c_custkey % 100 = 0 then 2100 when c_custkey % 5 = 0 then 85 else 3 end as n
  from customer join nation on c_nationkey = n_nationkey)
"""


def practice_files(spark, sf):
    rows = ad.table(spark, sf, "customer", spread=True).join(ad.repo_names(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    key = k.cast("string")
    secret = F.when(k % 7 == 0, F.concat(F.lit("{<vault"), key, F.lit(">}"))).when(F.col("c_acctbal") > 0, F.concat(F.lit("Secretvalue"), key)).otherwise(F.concat(F.lit("changeme-"), key))
    n = F.when(k % 100 == 0, 2100).when(k % 5 == 0, 85).otherwise(3)
    service = F.format_string(
        SERVICE_FILE, k, secret,
        F.when(F.col("n_nationkey") % 2 == 0, "f'select {x}'").otherwise("'select 1', (x,)"), F.when(F.col("c_acctbal") > 5000, "url_guard").otherwise("fetch"),
        F.when(k % 2 == 0, "secret and got != secret").otherwise("not got"), F.when(k % 3 == 0, "pool.get_raw_connection()").otherwise("PgConnection(raw)"),
        F.when(k % 6 == 0, "cur = conn.cursor()").otherwise("row = conn.execute(q)"), F.when(k % 4 == 0, "psycopg2.connect").otherwise("connect"), F.repeat(F.lit("    x = 1\n"), n),
    )
    prefix = F.concat(F.when(k % 2 == 0, "/admin/a").otherwise("/admin/other"), key)
    folder = F.concat(F.lit("plugins/a"), key)
    files = F.array(
        F.struct(F.concat(folder, F.lit("/svc.py")).alias("path"), service.alias("content")),
        F.struct(F.concat(folder, F.lit("/routes.py")).alias("path"), F.format_string(ROUTE_FILE, k, prefix).alias("content")),
        F.struct(F.concat(folder, F.lit("/plugin.json")).alias("path"), F.format_string('{"identifier": "a%s", "name": "n"}', k).alias("content")),
    )
    out = rows.select("repo", F.explode(files).alias("f")).select("repo", "f.*")
    return out.withColumn("size", F.octet_length("content").cast("long")).withColumn("mtime", F.lit(0).cast("long"))


@query(
    "builtin_line_rules",
    "E17 U3 R16 R17 R18 R19",
    _PRACTICE + """select repo, path, 2 as line_no, 'SEC001' as rule_id from a where bal > 0 and k % 7 <> 0 union all select repo, path, 3, 'SEC005' from a where nk % 2 = 0
    union all select repo, path, 4, 'SEC002' from a where bal <= 5000 union all select repo, path, 6, 'SEC003' from a where k % 2 = 0""",
)
def builtin_line_rules(spark, sf):
    return mt.line_rule_hits(practice_files(spark, sf)).select("repo", "path", "line_no", "rule_id")


@query(
    "raw_connection_hits",
    "R41 E18 F5",
    _PRACTICE + "select repo, path, 'raw_db_conn_execute' as rule, 9 as line_no, 'row = conn.execute(q)' as snippet from a where k % 3 = 0 and k % 6 <> 0",
)
def raw_connection_hits(spark, sf):
    """The built-in pairing rule: a use behind an assignment or in brackets counts, one behind an escape does not."""
    return mt.pair_rule_hits(practice_files(spark, sf))


@query(
    "builtin_syntax_rules",
    "R21 R22 U2",
    _PRACTICE + """select repo, path, 12 as lineno, 'QLT003' as rule_id, 'def long_' || k || '() has ' || n || ' lines' as snippet from a where n >= 80
    union all select repo, path, 1, 'QLT004', 'unused import psycopg2' from a where k % 4 <> 0""",
)
def builtin_syntax_rules(spark, sf):
    hits = au.builtin_ast_hits(au.measures(fx.extract_facts(practice_files(spark, sf))))
    return hits.select("repo", "path", F.col("lineno").cast("int").alias("lineno"), "rule_id", "snippet")


def _rule_input(spark, sf, facts=True):
    files = materialize(practice_files(spark, sf))
    py = fx.extract_facts(files if facts else files.limit(0))
    py = materialize(py) if facts else py
    comps = mf.manifest_columns(mf.read_manifests(files), mf.read_manifest_contract(files)).select("repo", "dir", "identifier")
    nothing = spark.createDataFrame([], "repo string, src string, dst string")
    violations = spark.createDataFrame([], "repo string, module string, imports string, file string")
    return ru.RuleInput(files, py, comps, fx.routes(py), nothing, violations, ov.file_sizes(files))


@query(
    "secrets_and_sql_in_components",
    "R6 R7",
    _PRACTICE + """select repo, 'SEC001' as rule_id, path as target, 'password = ''' || secret || '''' as evidence from a where k % 7 <> 0
    union all select repo, 'SEC004', path, 'f''select {x}''' from a where nk % 2 = 0""",
)
def secrets_and_sql_in_components(spark, sf):
    """Values that open with a brace are placeholders."""
    return ru.security_rules(_rule_input(spark, sf, facts=False)).select("repo", "rule_id", "target", "evidence")


@query(
    "private_connections_and_prefixes",
    "R12 R13",
    _PRACTICE + """select repo, 'ARCH003' as rule_id, path as target, null as file, 11 as line from a where k % 4 = 0
    union all select repo, 'ARCH004', 'a' || k, 'plugins/a' || k || '/routes.py', null from a where k % 2 <> 0""",
)
def private_connections_and_prefixes(spark, sf):
    return ru.architecture_rules(_rule_input(spark, sf)).select("repo", "rule_id", "target", "file", "line")


@query(
    "large_file_gate",
    "R39 D28",
    _PRACTICE + "select repo, 'file-too-large' as gate, path as file, (12 + n) || ' code lines > 2000' as detail from a where n > 2000",
)
def large_file_gate(spark, sf):
    x = _rule_input(spark, sf, facts=False)
    none = spark.createDataFrame([], "repo string, rule_id string, severity string, target string, file string, message string")
    g = gt.GateInput(x.components, x.routes, x.violations, x.component_edges, x.component_edges, x.sizes, none, x.profile)
    return gt.gate_hits(g, ["file-too-large"]).select("repo", "gate", "file", "detail")


@query(
    "registered_scripts",
    "E20 C13",
    """select lower(replace(n_name, ' ', '_')) as repo, 'tools/t' || s_suppkey || '.py' as path, s_acctbal > 0 as in_registry from supplier join nation on s_nationkey = n_nationkey""",
)
def registered_scripts(spark, sf):
    """Scripts whose names are ids of a registry, for suppliers with a balance."""
    rows = ad.table(spark, sf, "supplier", spread=True).join(ad.repo_names(spark, sf), F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey").cast("string")
    text = F.format_string('"""Tool %s."""\nimport sys\n\n\ndef main():\n    print(sys.argv)\n', "s_suppkey")
    files = rows.select("repo", F.concat(F.lit("tools/t"), key, F.lit(".py")).alias("path"), text.alias("content"))
    files = files.withColumn("size", F.octet_length("content").cast("long")).withColumn("mtime", F.lit(0).cast("long"))
    registry = rows.where("s_acctbal > 0").select(F.concat(F.lit("t"), key).alias("id"))
    return ce.script_census(files, fx.extract_facts(files), registry).select("repo", "path", "in_registry")


# ------------------------------------------------------------------ every way to mount a route
def _blueprint(var: str, prefix: str | None) -> str:
    extra = "" if prefix is None else f", url_prefix={prefix}"
    return f"import flask\n{var} = flask.Blueprint('{var}%1$s', __name__{extra})\n"


def _route(owner: str, rule: str = "'/r'", name: str = "view") -> str:
    return f"@{owner}.route({rule})\ndef {name}(): ...\n"


def _registrar(name: str) -> str:
    return f"def {name}(target):\n    @target.route('/r')\n    def inside(): ...\n"


WIRED = {
    "own.py": _blueprint("b", "'/own%1$s/'") + _route("b", "'/a%1$s'", "a") + _route("b", "''", "empty") + _route("b", "'c'", "c"),
    "bare.py": _blueprint("b", None) + _route("b", "'/b%1$s'"),
    "named.py": _blueprint("b", "PREFIX") + _route("b"),
    "computed.py": _blueprint("b", "'/k%1$s'") + _route("b", "'/x' + y"),
    # imports: relative with a new name, absolute from another folder, a package that passes the name on, a chain of nine
    "shop/bp.py": _blueprint("cart", "'/cart%1$s'"),
    "shop/items.py": "from .bp import cart as here\n" + _route("here"),
    "office/far.py": "from shop.bp import cart\n" + _route("cart"),
    "pkg/__init__.py": "from .inner.deep import leaf\n",
    "pkg/inner/deep.py": _blueprint("leaf", "'/leaf%1$s'"),
    "user.py": "from pkg import leaf\n" + _route("leaf"),
    "hop0.py": _blueprint("far", "'/far%1$s'"),
    **{f"hop{i}.py": f"from hop{i - 1} import far\n" for i in range(1, 9)},
    "nine.py": "from hop8 import far\n" + _route("far"),
    # two files could be meant: the module before the package
    "twin.py": _blueprint("t", "'/module%1$s'"), "twin/__init__.py": _blueprint("t", "'/package%1$s'"), "twins.py": "from twin import t\n" + _route("t"),
    "ring1.py": "from ring2 import z\n" + _route("z"), "ring2.py": "from ring1 import z\n",
    # registrars: called beside the blueprint, through a package, inside a function, and never
    "reg/local.py": _blueprint("mine", "'/mine%1$s'") + _registrar("attach") + "attach(mine)\n",
    "reg/api.py": _registrar("mount"), "reg/__init__.py": "from .api import mount\n",
    "wire_b.py": "from reg import mount\n" + _blueprint("second", "'/second'") + "mount(second)\n",
    "wire_a.py": "from reg import mount\n" + _blueprint("first", "'/first%1$s'") + "def setup():\n    mount(nothing_known)\n    mount(first)\n",
    "reg/lonely.py": _registrar("unused"),
    "web.py": _route("app", "'/up%1$s'") + _route("stranger", "'/s'", "s"),
    "plugins/gift/routes.py": _blueprint("b", None) + _route("b", "'/list%1$s'"),
}

_MOUNTED = """select 'w' || s_suppkey as repo, x.path as path, x.how as resolution, case when x.goes <> '' then replace(x.goes, '#', s_suppkey::varchar) end as endpoint_path from supplier, (select unnest([
  {path: 'own.py', how: 'blueprint', goes: '/own#/a#'}, {path: 'own.py', how: 'blueprint', goes: '/own#'}, {path: 'own.py', how: 'blueprint', goes: '/own#/c'}, {path: 'bare.py', how: 'noprefix', goes: '/b#'},
  {path: 'named.py', how: 'nonliteral', goes: ''}, {path: 'computed.py', how: 'blueprint', goes: ''}, {path: 'shop/items.py', how: 'imported', goes: '/cart#/r'}, {path: 'office/far.py', how: 'imported', goes: '/cart#/r'},
  {path: 'user.py', how: 'imported', goes: '/leaf#/r'}, {path: 'nine.py', how: 'imported', goes: '/far#/r'}, {path: 'twins.py', how: 'imported', goes: '/module#/r'}, {path: 'ring1.py', how: 'unresolved', goes: ''},
  {path: 'reg/local.py', how: 'registrar', goes: '/mine#/r'}, {path: 'reg/api.py', how: 'registrar', goes: '/first#/r'}, {path: 'reg/lonely.py', how: 'unresolved', goes: ''}, {path: 'web.py', how: 'app', goes: '/up#'},
  {path: 'web.py', how: 'unresolved', goes: ''}, {path: 'plugins/gift/routes.py', how: 'default', goes: '/c/gift/list#'}]) as x)"""


def _wired_facts(spark, sf):
    sup = ad.table(spark, sf, "supplier", spread=True)
    files = F.array(*[F.struct(F.lit(path).alias("path"), F.format_string(text, "s_suppkey").alias("content")) for path, text in WIRED.items()])
    rows = sup.select(F.concat(F.lit("w"), F.col("s_suppkey").cast("string")).alias("repo"), F.explode(files).alias("f")).select("repo", "f.*")
    return materialize(fx.extract_facts(rows))


@query("mounted_routes", "E5 E6 E7 E8 F2", _MOUNTED)
def mounted_routes(spark, sf):
    """All eight resolutions, over imports of every kind."""
    rows = endpoints_of(_wired_facts(spark, sf), Profile(default_component_prefix="/c/{identifier}"))
    return rows.select("repo", "path", "resolution", "endpoint_path")


# ------------------------------------------------------------------ a contract of the repository's own
@query(
    "own_manifest_contract",
    "A6 E21 V2",
    """with a as (select lower(replace(n_name, ' ', '_')) as repo, n_nationkey as nk, s_suppkey as k, s_acctbal as bal from supplier join nation on s_nationkey = n_nationkey)
    select repo, 's' || k as dir, case when nk % 2 = 0 then case when bal > 0 then '' else 'missing field: license;' end || case when bal > 5000 then 'missing field: owner;' else '' end
      else 'missing field: description;missing field: author;missing field: min_app_version;missing field: agent_role;missing field: capabilities;' end as errors from a""",
)
def own_manifest_contract(spark, sf):
    """Every second repository brings the list of fields it requires; the others are held to the usual one."""
    rows = ad.table(spark, sf, "supplier", spread=True).join(ad.repo_names(spark, sf), F.col("s_nationkey") == F.col("n_nationkey"))
    license_ = F.when(F.col("s_acctbal") > 0, "MIT").otherwise("")
    owner = F.when(F.col("s_acctbal") <= 5000, "o")
    manifest = F.to_json(F.struct(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("identifier"), F.lit("n").alias("name"), F.lit("1.0.0").alias("version"), license_.alias("license"), owner.alias("owner")))
    files = rows.select("repo", F.concat(F.lit("plugins/s"), F.col("s_suppkey").cast("string"), F.lit("/plugin.json")).alias("path"), manifest.alias("content"))
    schema = '{"required": ["identifier", "license", "owner", null], "properties": {"license": {"enum": ["MIT", ""]}}}'
    own = rows.where("n_nationkey % 2 = 0").select("repo", F.lit("docs/plugin-manifest.schema.json").alias("path"), F.lit(schema).alias("content")).distinct()
    every = files.unionByName(own)
    judged = mf.manifest_columns(mf.read_manifests(every), mf.read_manifest_contract(every))
    return judged.select("repo", "dir", F.array_join(F.transform("manifest_errors", lambda e: F.concat(e, F.lit(";"))), "").alias("errors"))


@query(
    "claims_from_json",
    "A11 E16",
    _PRACTICE + """select repo, 'c' || k as id, path, case when k % 2 = 0 then case when k % 4 = 0 then 'PASS' else 'FAIL' end else case when k % 3 = 0 then 'PASS' else 'FAIL' end end as status,
    case when k % 2 = 0 then case when k % 4 = 0 then 'text is on the line' else 'text is not on the line' end else case when k % 3 = 0 then 'found on line 8' else 'text not found' end end as reason from a""",
)
def claims_from_json(spark, sf):
    """A claim on each service file, as JSON text of its repository; both spellings of the text's name."""
    files = practice_files(spark, sf).where("path like '%/svc.py'")
    key = F.regexp_extract("path", r"a(\d+)/", 1)
    even = F.format_string('[{"id": "c%s", "file": "%s", "must_contain": "psycopg2.connect", "line": 11}]', key, "path")
    odd = F.format_string('[{"id": "c%s", "file": "%s", "contains": "get_raw_connection"}]', key, "path")
    claims = mf.read_claims(files.select("repo", F.when(key.cast("long") % 2 == 0, even).otherwise(odd).alias("content")))
    return mt.check_claims(claims, files).select("repo", "id", "path", "status", "reason")
