"""JSON-shaped sources: component manifests and their contract, package files, rule packs, claims, external findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.functions import paths
from codefacts.functions.ranking import first_per_group
from codefacts.profile import IDENTIFIER_PATTERN, SEMVER_PATTERN, Profile



def _strings() -> Column:
    return F.array().cast("array<string>")


def json_object(content: Column | str) -> tuple[Column, Column]:
    """(members as a map of variants, error text): the error is null for a JSON object."""
    parsed = F.try_parse_json(paths._c(content))
    members = F.try_variant_get(parsed, "$", "map<string,variant>")
    error = F.when(parsed.isNull(), "not valid JSON").when(members.isNull(), "top level is not a JSON object")
    return members, error


def _member(members: Column, key: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.try_element_at(members, F.lit(key)), "$", kind)


def _text(members: Column, key: str, default: str = "") -> Column:
    return F.coalesce(_member(members, key), F.lit(default))


def _name_list(members: Column, key: str) -> Column:
    """Keys of an object member, or the strings of an array member."""
    keys = F.map_keys(_member(members, key, "map<string,variant>"))
    return F.coalesce(keys, F.array_compact(_member(members, key, "array<string>")), _strings())


def read_manifests(files: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """A5: the manifest of every component directory as members plus parse error."""
    pattern = f"^\\Q{profile.component_dir}/\\E[^/]+/\\Q{profile.manifest_name}\\E$"
    members, error = json_object("content")
    rows = files.where(F.col("path").rlike(pattern))
    return rows.select("repo", F.get(paths.segments("path"), F.lit(1)).alias("dir"), "path", members.alias("m"), error.alias("parse_error"))


def read_manifest_contract(files: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """Required fields and enumerations from the contract file of each repository."""
    members, _ = json_object("content")
    rows = files.where(F.col("path") == profile.manifest_schema_path).select("repo", members.alias("m")).where("m is not null")
    required = F.filter(F.coalesce(_member(F.col("m"), "required", "array<string>"), _strings()), lambda x: x.isNotNull())
    props = _member(F.col("m"), "properties", "map<string,variant>")
    enums = F.transform_values(props, lambda k, v: F.try_variant_get(v, "$.enum", "array<string>"))
    return rows.select(
        "repo",
        F.when(F.size(required) > 0, required).otherwise(F.array(*[F.lit(x) for x in profile.manifest_required])).alias("required"),
        F.map_filter(enums, lambda k, v: v.isNotNull()).alias("enums"),
    )


def _missing(value: Column) -> Column:
    return value.isNull() | F.is_variant_null(value) | F.to_json(value).isin('""', "[]")


def manifest_errors(members: Column, required: Column) -> Column:
    """Required members that are absent or empty, and identifier and versions that break their pattern."""
    absent = F.filter(required, lambda f: _missing(F.try_element_at(members, f)))
    gaps = F.transform(absent, lambda f: F.concat(F.lit("missing field: "), f))

    def bad(key: str, pattern: str, what: str) -> Column:
        value = _text(members, key)
        return F.when((value != "") & ~value.rlike(pattern), F.concat(F.lit(f"{key} is not {what}: "), value))

    shape = F.array_compact(F.array(
        bad("identifier", IDENTIFIER_PATTERN, "[a-z0-9_]+"),
        bad("version", SEMVER_PATTERN, "X.Y.Z"),
        bad("min_app_version", SEMVER_PATTERN, "X.Y.Z"),
    ))
    return F.concat(gaps, shape)


def manifest_columns(manifests: DataFrame, contract: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """Typed manifest columns per component directory, with all validation errors."""
    fallback = F.array(*[F.lit(x) for x in profile.manifest_required])
    joined = manifests.join(contract.select("repo", "required"), "repo", "left")
    required = F.coalesce("required", fallback)
    m = F.col("m")
    errors = F.when(F.col("parse_error").isNotNull(), F.array("parse_error")).otherwise(manifest_errors(m, required))
    depends = F.transform_values(
        F.map_from_arrays(F.array_distinct(_name_list(m, "depends_on")), F.array_distinct(_name_list(m, "depends_on"))),
        lambda k, v: F.coalesce(F.try_variant_get(F.try_element_at(_member(m, "depends_on", "map<string,variant>"), k), "$", "string"), F.lit("")),
    )
    return joined.select(
        "repo", "dir",
        F.coalesce(_member(m, "identifier"), F.col("dir")).alias("identifier"),
        _text(m, "name").alias("name"), _text(m, "version").alias("version"), _text(m, "category").alias("category"),
        _text(m, "agent_role").alias("agent_role"),
        F.coalesce(F.array_compact(_member(m, "capabilities", "array<string>")), _strings()).alias("capabilities"),
        _text(m, "description").alias("description"), _text(m, "author").alias("author"),
        _text(m, "min_app_version").alias("min_app_version"), _text(m, "price_type", "free").alias("price_type"),
        F.coalesce(F.array_compact(_member(m, "permissions", "array<string>")), _strings()).alias("permissions"),
        depends.alias("depends_on"), _name_list(m, "dependencies").alias("dependencies"),
        F.array_sort(_name_list(m, "hooks")).alias("hooks_keys"),
        errors.alias("manifest_errors"), (F.size(errors) == 0).alias("manifest_valid"),
    )


def read_package_json(files: DataFrame) -> DataFrame:
    """The root package file of each repository; bad JSON counts as an empty object."""
    members, _ = json_object("content")
    rows = files.where("path = 'package.json'").select("repo", members.alias("m"))
    m = F.col("m")

    def table(key: str) -> Column:
        empty = F.create_map().cast("map<string,string>")
        return F.coalesce(F.transform_values(_member(m, key, "map<string,variant>"), lambda k, v: F.try_variant_get(v, "$", "string")), empty)

    return rows.select(
        "repo", F.coalesce(_member(m, "name"), F.col("repo")).alias("name"), _text(m, "version").alias("version"),
        _text(m, "description").alias("description"), _text(m, "main").alias("main"),
        table("dependencies").alias("deps"), table("devDependencies").alias("dev_deps"), table("scripts").alias("scripts"),
    )


def read_rules(files: DataFrame, names: tuple[str, ...] = ("audit_rules.json", ".audit/audit_rules.json")) -> DataFrame:
    """Rules a repository brings along, from the first of the file names that exists; rows without an id are dropped."""
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("path"))
    present = first_per_group(files.where(F.col("path").isin(*names)), ["repo"], [order])
    parsed = F.try_parse_json("content")
    items = F.coalesce(F.try_variant_get(parsed, "$.rules", "array<variant>"), F.try_variant_get(parsed, "$", "array<variant>"))
    rows = present.select("repo", F.posexplode(items).alias("seq", "r"))

    def field(path: str, kind: str = "string") -> Column:
        return F.try_variant_get("r", f"$.{path}", kind)

    guards = F.coalesce(F.array_compact(field("matcher.guard_anywhere", "array<string>")), _strings())
    return rows.select(
        "repo", "seq", field("rule_id").alias("rule_id"), field("dimension").alias("dimension"), field("severity").alias("severity"),
        field("title").alias("title"), field("confidence").alias("confidence"), field("matcher.type").alias("matcher"),
        field("matcher.pattern").alias("pattern"), field("matcher.check").alias("check"),
        field("matcher.threshold", "int").alias("threshold"), guards.alias("guards"),
    ).where("coalesce(rule_id, '') <> ''")


def _listed(docs: DataFrame, *keep: str) -> DataFrame:
    """The members of a JSON array in ``content``, numbered."""
    items = F.try_variant_get(F.try_parse_json("content"), "$", "array<variant>")
    return docs.select(*keep, F.posexplode(items).alias("seq", "v"))


def _field(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", f"$.{path}", kind)


def _lacking(what: str, *needed: tuple[str, Column]) -> Column:
    """The first needed value that is null, named; null if all are there."""
    out = F.lit(None).cast("string")
    for name, value in reversed(needed):
        out = F.when(value.isNull(), F.lit(f"{what} lacks {name}")).otherwise(out)
    return out


def _pair_rule_reason() -> Column:
    return _lacking("pairing rule", *[(k, _field(k)) for k in ("name", "assign", "use")])


def read_pair_rules(docs: DataFrame) -> DataFrame:
    """A10: pairing rules from JSON text in ``content``; those without name, assign or use are in ``rejected_pair_rules``."""
    rows = _listed(docs).where(_pair_rule_reason().isNull())
    return rows.select(
        "seq", _field("name").alias("name"), _field("assign").alias("assign"), _field("use").alias("use"),
        F.coalesce(_field("escape"), F.lit("")).alias("escape"), F.coalesce(_field("desc"), _field("name")).alias("desc"),
        F.coalesce(_field("window", "int"), F.lit(40)).alias("window"),
    )


def rejected_pair_rules(docs: DataFrame) -> DataFrame:
    """A10: members that are no pairing rule: seq, reason and their text; one bad rule does not stop the others."""
    return _listed(docs).withColumn("reason", _pair_rule_reason()).where("reason is not null").select("seq", "reason", F.to_json("v").alias("text"))


def _needle() -> Column:
    return F.coalesce(_field("must_contain"), _field("contains"))


def read_claims(docs: DataFrame) -> DataFrame:
    """Anchor claims from JSON text; ``contains`` is an accepted spelling of ``must_contain``.

    Claims without either are in ``rejected_claims``.
    """
    return _listed(docs, "repo").where(_needle().isNotNull()).select(
        "repo", "seq", F.coalesce(_field("id"), F.lit("?")).alias("id"), _field("file").alias("path"), _needle().alias("must_contain"),
        _field("line", "int").alias("line"), F.coalesce(_field("note"), F.lit("")).alias("note"),
    )


def rejected_claims(docs: DataFrame) -> DataFrame:
    """Members that claim nothing: repo, seq, reason and their text."""
    return _listed(docs, "repo").where(_needle().isNull()).select("repo", "seq", F.lit("claim lacks must_contain").alias("reason"), F.to_json("v").alias("text"))
