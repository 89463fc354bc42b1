"""The registered queries: contract, coverage of the operator inventory, and the shape of their plans."""

import re

import pytest

import __spark_entry__ as entry_points
from codefacts.plans.catalog import REGISTRY

SF = "/root/testdata/sf0.001"


def inventory() -> set[str]:
    spans = {"A": [(1, 16), (20, 28)], "B": [(1, 18)], "C": [(1, 19)], "D": [(1, 41)], "E": [(1, 25)], "F": [(1, 11)], "G": [(1, 9)], "H": [(1, 7)],
             "I": [(1, 5)], "R": [(1, 41)], "V": [(1, 2)], "K": [(1, 6)], "U": [(1, 6)]}
    return {f"{letter}{i}" for letter, ranges in spans.items() for lo, hi in ranges for i in range(lo, hi + 1)}


def test_every_operator_is_covered():
    covered = {c for q in REGISTRY.values() for c in q.covers}
    missing = inventory() - covered
    assert not missing, sorted(missing)


def test_contract():
    queries, oracles = entry_points.queries(), entry_points.oracle_sql()
    assert set(oracles) <= set(queries)
    without = {n for n in REGISTRY if n not in oracles}
    assert all(REGISTRY[n].why_no_oracle for n in without) and len(without) <= 3


def test_only_missing_parts_are_left_out(monkeypatch):
    """Without the subpackage everything else is registered; a package that the subpackage lacks is an error."""
    import builtins
    import importlib

    real = builtins.__import__

    def without(name):
        def load(module, *args, **kwargs):
            if module.startswith("codefacts.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)
            return real(module, *args, **kwargs)

        return load

    try:
        monkeypatch.setattr(builtins, "__import__", without("codefacts.llm"))
        assert set(importlib.reload(entry_points).queries()) == set(REGISTRY)
        monkeypatch.setattr(builtins, "__import__", without("regex"))
        with pytest.raises(ModuleNotFoundError):
            importlib.reload(entry_points)
    finally:
        monkeypatch.undo()
        importlib.reload(entry_points)


def test_entry_point(spark):
    df = entry_points.entry(spark)
    assert df.columns and df.count() > 0


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


#: queries that need no job of their own before they return a plan
PLAIN = [n for n, q in REGISTRY.items() if not re.search(r"stream|cycles|reachable|branch|pending|call_graph|graph|degrees|endpoint|route_pref|symbol|component|target|global|core_mod|deep|boundary|rule_find|rule_summ|long_func|gate|audit|kpi|project|diagram|overlay|mirror|script|commit_log", n)]


@pytest.mark.parametrize("name", PLAIN)
def test_no_cross_joins_and_no_row_python(spark, name):
    text = plan(entry_points.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


def test_top_k_is_cut_before_the_shuffle(spark):
    text = plan(entry_points.queries()["hotspot_files"](spark, SF))
    assert text.count("WindowGroupLimit") >= 2


def test_scans_are_pruned(spark):
    text = plan(entry_points.queries()["commit_authors"](spark, SF))
    assert "ReadSchema: struct<o_custkey:bigint,o_orderpriority:string>" in text
    text = plan(entry_points.queries()["churn_per_file"](spark, SF))
    assert "l_extendedprice" not in text
