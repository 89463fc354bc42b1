"""The registry behind ``__spark_entry__``: one function and, where SQL can say it, one oracle per query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: QueryFn
    oracle: str | None
    why_no_oracle: str = ""


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, oracle: str | None = None, why_no_oracle: str = "") -> Callable[[QueryFn], QueryFn]:
    """Register a query. ``covers`` names the operator ids; without an oracle, say why."""

    def add(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        if oracle is None and not why_no_oracle:
            raise ValueError(f"query {name} needs an oracle or a reason for none")
        REGISTRY[name] = Query(name, tuple(covers.replace(",", " ").split()), fn, oracle, why_no_oracle)
        return fn

    return add
