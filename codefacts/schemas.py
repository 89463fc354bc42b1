"""Struct types of the tables the operators exchange."""

from __future__ import annotations

#: M1: one row per file of a snapshot
FILES = "repo string, path string, content string, size long, mtime long"

#: M9: commits and their per-file line counts
COMMITS = "repo string, sha string, author_name string, author_email string, ts timestamp, message string"
NUMSTAT = "repo string, sha string, path string, added int, deleted int, ts timestamp"

#: what the Python front end reports for a file: flat records, no interpretation
ARG = "kw: string, text: string, kind: string, value: string, ident: string, strs: array<string>"
PY_SYNTAX = (
    "struct<ok: boolean, error: string, doc: string,"
    " defs: array<struct<kind: string, name: string, scope: string, container: string, container_line: int,"
    " lineno: int, end_lineno: int, doc: string, signature: string, bases: array<string>, decorators: array<string>>>,"
    " calls: array<struct<scope: string, chain: array<string>, lineno: int, args: array<struct<" + ARG + ">>,"
    " assigned_to: string, decorates: string, decorates_line: int, decorates_doc: string, owner_param_of: string>>,"
    " imports: array<struct<kind: string, module: string, level: int, name: string, alias: string, lineno: int, top: boolean>>,"
    " handlers: array<struct<lineno: int, body: array<string>, caught: string, names: array<string>, returns: array<string>>>,"
    " used: array<string>, listed: array<struct<targets: array<string>, strs: array<string>>>>"
)

#: A rule finding; M13: an audit finding
FINDINGS = (
    "repo string, rule_id string, severity string, category string, target string, file string, line int,"
    " message string, evidence string"
)
AUDIT_FINDINGS = (
    "repo string, rule_id string, dimension string, severity string, title string, provider string, coverage string,"
    " file string, line int, snippet string, confidence string"
)

#: One scalar per component, module or frontend of a snapshot
SNAPSHOTS = (
    "repo string, snapshot string, entity_kind string, entity string, version string, loc_code long, routes long,"
    " manifest_valid boolean, manifest_errors array<string>, depends_on array<string>"
)

SCHEMA_VERSION = "1.0"
