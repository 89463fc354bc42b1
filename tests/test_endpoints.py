"""Endpoint prefixes over import chains: one corpus, one expected table."""

from dataclasses import replace

import pytest

from codefacts.operators import endpoints as ep
from codefacts.operators import facts as fx
from codefacts.profile import Profile


def blueprint(var, prefix=None):
    extra = "" if prefix is None else f", url_prefix={prefix}"
    return f"import flask\n{var} = flask.Blueprint('{var}_name', __name__{extra})\n"


def route(owner, rule="'/r'", name="view"):
    return f"@{owner}.route({rule})\ndef {name}(): ...\n"


def registrar(name, rule="'/r'"):
    return f"def {name}(target):\n    @target.route({rule})\n    def inside(): ...\n"


CHAIN = {"hop0.py": blueprint("far", "'/far'"), **{f"hop{i}.py": f"from hop{i - 1} import far\n" for i in range(1, 8)}}

FILES = {
    # the blueprint of the same file: slashes are joined once
    "own.py": blueprint("b", "'/own/'") + route("b", "'/a'", "a") + route("b", "''", "empty") + route("b", "'c'", "c"),
    "bare.py": blueprint("b") + route("b"),
    "named.py": blueprint("b", "PREFIX") + route("b"),
    "computed.py": blueprint("b", "'/k'") + route("b", "'/x' + y"),
    # imports: relative with a new name, absolute from another directory, a package that passes the name on
    "shop/bp.py": blueprint("cart", "'/cart'"),
    "shop/items.py": "from .bp import cart as here\n" + route("here"),
    "office/far.py": "from shop.bp import cart\n" + route("cart"),
    "pkg/__init__.py": "from .inner.deep import leaf\n",
    "pkg/inner/deep.py": blueprint("leaf", "'/leaf'"),
    "user.py": "from pkg import leaf\n" + route("leaf"),
    # re-exports are followed however many there are; a ring of re-exports leads nowhere
    **CHAIN,
    "six.py": "from hop5 import far\n" + route("far"),
    "seven.py": "from hop6 import far\n" + route("far"),
    "ring1.py": "from ring2 import z\n" + route("z"), "ring2.py": "from ring1 import z\n",
    # registrars: called next to the blueprint, through a package, inside a function, twice, and never
    "reg/local.py": blueprint("mine", "'/mine'") + registrar("attach") + "attach(mine)\n",
    "reg/api.py": registrar("mount"),
    "reg/__init__.py": "from .api import mount\n",
    "wire_b.py": "from reg import mount\n" + blueprint("second", "'/second'") + "mount(second)\n",
    "wire_a.py": "from reg import mount\n" + blueprint("first", "'/first'") + "def setup():\n    mount(nothing_known)\n    mount(first)\n",
    "reg/lonely.py": registrar("unused"),
    # application objects and names nobody knows
    "web.py": route("app", "'/up'") + "@router.get('/g')\ndef g(): ...\n" + route("stranger", "'/s'", "s"),
    "plugins/gift/routes.py": blueprint("b") + route("b", "'/list'"),
}

WANT = {
    "own.py": [("blueprint", "/own/a"), ("blueprint", "/own"), ("blueprint", "/own/c")],
    "bare.py": [("noprefix", "/r")], "named.py": [("nonliteral", None)], "computed.py": [("blueprint", None)],
    "shop/items.py": [("imported", "/cart/r")], "office/far.py": [("imported", "/cart/r")], "user.py": [("imported", "/leaf/r")],
    "six.py": [("imported", "/far/r")], "seven.py": [("imported", "/far/r")], "ring1.py": [("unresolved", None)],
    "reg/local.py": [("registrar", "/mine/r")], "reg/api.py": [("registrar", "/first/r")], "reg/lonely.py": [("unresolved", None)],
    "web.py": [("app", "/up"), ("app", "/g"), ("unresolved", None)],
    "plugins/gift/routes.py": [("noprefix", "/list")],
}


@pytest.fixture(scope="module")
def resolve(make_files):
    f = fx.extract_facts(make_files(FILES)).cache()

    def run(profile):
        got = ep.resolve_endpoints(fx.routes(f), fx.blueprints(f), fx.single_name_calls(f), fx.import_facts(f), f.select("repo", "path"), profile)
        table: dict = {}
        for r in sorted(got.collect(), key=lambda r: (r.path, r.lineno)):
            table.setdefault(r.path, []).append((r.resolution, r.endpoint_path))
        return table, got

    return run


def test_every_form(resolve):
    table, got = resolve(Profile())
    assert table == WANT
    stats = {r.resolution: r.routes for r in ep.resolution_stats(got).collect()}
    assert stats == {"blueprint": 4, "noprefix": 2, "nonliteral": 1, "imported": 5, "unresolved": 3, "registrar": 2, "app": 2}


def test_default_prefix_of_components(resolve):
    table, _ = resolve(replace(Profile(), default_component_prefix="/c/{identifier}"))
    assert table == {**WANT, "plugins/gift/routes.py": [("default", "/c/gift/list")]}


def test_no_side_is_sent_through_the_driver(spark, make_files):
    """Facts pack far below the size of their rows; a side that grows with the files would be sent whole."""
    facts = fx.extract_facts(make_files(FILES))
    rows = ep.resolve_endpoints(fx.routes(facts), fx.blueprints(facts), fx.single_name_calls(facts), fx.import_facts(facts), facts.select("repo", "path"))
    for df in (rows, ep.import_edges(fx.import_facts(facts), facts.select("repo", "path"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
