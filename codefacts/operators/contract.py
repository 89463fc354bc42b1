"""Data contracts: a table of JSON documents against a schema subset (V1).

The schema is compiled once into one Column expression over VARIANT: types and type unions, ``required``, ``properties``,
``items``, ``enum`` and local ``$ref``. Unknown members are ignored; below a wrong type nothing more is reported.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ERRORS = "array<struct<path:string,error:string>>"
#: JSON type -> what ``schema_of_variant`` starts with; a boolean is not an integer
_TYPE_PATTERN = {
    "object": r"^OBJECT", "array": r"^ARRAY", "string": r"^STRING", "boolean": r"^BOOLEAN", "null": r"^VOID",
    "integer": r"^BIGINT|^DECIMAL\(\d+,0\)", "number": r"^BIGINT|^DOUBLE|^FLOAT|^DECIMAL",
}


def _resolve(node: object, root: dict) -> dict:
    seen = set()
    while isinstance(node, dict) and isinstance(node.get("$ref"), str) and node["$ref"].startswith("#/"):
        if node["$ref"] in seen:
            raise ValueError(f"circular reference {node['$ref']}")
        seen.add(node["$ref"])
        target: object = root
        for part in node["$ref"][2:].split("/"):
            target = target.get(part) if isinstance(target, dict) else None
        if not isinstance(target, dict):
            return {}
        node = target
    return node if isinstance(node, dict) else {}


def _one(cond: Column, path: Column, message: str) -> Column:
    hit = F.array(F.struct(path.alias("path"), F.lit(message).alias("error")))
    return F.when(F.coalesce(cond, F.lit(False)), hit).otherwise(F.array().cast(_ERRORS))


def _check(value: Column, node: object, root: dict, path: Column, depth: int) -> Column:
    if depth > 24:
        raise ValueError("the schema refers to itself; give it a fixed depth")
    spec = _resolve(node, root)
    parts = []
    if "enum" in spec:
        allowed = [json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in spec["enum"]]
        parts.append(_one(~F.to_json(value).isin(*allowed), path, "value is not in the enumeration"))
    kind = F.schema_of_variant(value)
    deeper = []
    for key in spec.get("required") or []:
        absent = kind.startswith("OBJECT") & _member(value, key).isNull()
        deeper.append(_one(absent, path, f"missing required field {key}"))
    for key, sub in (spec.get("properties") or {}).items():
        child = _member(value, key)
        inner = _check(child, sub, root, F.concat(path, F.lit(f".{key}")), depth + 1)
        deeper.append(F.when(child.isNotNull(), inner).otherwise(F.array().cast(_ERRORS)))
    if isinstance(spec.get("items"), dict):
        items = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))
        found = F.transform(
            items, lambda x, i: _check(x, spec["items"], root, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), depth + 1)
        )
        deeper.append(F.flatten(found))
    below = F.concat(*deeper) if deeper else F.array().cast(_ERRORS)
    if "type" in spec:
        names = spec["type"] if isinstance(spec["type"], list) else [spec["type"]]
        pattern = "|".join(_TYPE_PATTERN[n] for n in names if n in _TYPE_PATTERN)
        right = kind.rlike(pattern) if pattern else F.lit(False)
        parts.append(F.when(right, below).otherwise(_one(F.lit(True), path, f"expected {' or '.join(names)}")))
    else:
        parts.append(below)
    return F.concat(*parts)


def _member(value: Column, key: str) -> Column:
    quoted = key.replace('"', "").replace("\\", "")
    return F.try_variant_get(value, f'$["{quoted}"]', "variant")


def validate(docs: DataFrame, schema: dict, json_col: str = "payload", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """V1: rows ``(keys..., path, error)``; text that is no JSON at all is one error at the root."""
    parsed = docs.select(*keys, F.try_parse_json(json_col).alias("v"))
    root = F.lit("$")
    errors = F.when(F.col("v").isNull(), _one(F.lit(True), root, "not valid JSON")).otherwise(_check(F.col("v"), schema, schema, root, 0))
    return parsed.select(*keys, F.explode(errors).alias("e")).select(*keys, "e.path", "e.error")
