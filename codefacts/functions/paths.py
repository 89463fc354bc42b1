"""Path expressions: top directory, extension, owner, module name, group keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT = "<root>"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def posix(path: Column | str) -> Column:
    """Forward slashes, and no leading ``./`` (a leading dot of a hidden name is kept)."""
    return F.regexp_replace(F.translate(_c(path), "\\", "/"), r"^(\./)+", "")


def segments(path: Column | str) -> Column:
    return F.split(_c(path), "/")


def basename(path: Column | str) -> Column:
    return F.element_at(segments(path), -1)


def top_dir(path: Column | str) -> Column:
    p = _c(path)
    return F.when(F.instr(p, "/") > 0, F.substring_index(p, "/", 1)).otherwise(F.lit(ROOT))


def extension(path: Column | str) -> Column:
    """Lower-cased last suffix with its dot; empty for dot-files and names without one."""
    return F.lower(F.regexp_extract(_c(path), r"[^/](\.[^./]+)$", 1))


def stem(path: Column | str) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def owner(path: Column | str, component_dir: str = "plugins") -> Column:
    """The component id below the component directory, else the top directory."""
    p = _c(path)
    if not component_dir:
        return top_dir(p)
    return F.when(p.startswith(component_dir + "/"), F.get(segments(p), F.lit(1))).otherwise(top_dir(p))


def hotspot_group(path: Column | str, component_dir: str = "plugins") -> Column:
    """``<component_dir>/<id>`` for files at least three levels deep there, else the top directory."""
    p = _c(path)
    if not component_dir:
        return top_dir(p)
    deep = p.startswith(component_dir + "/") & (F.size(segments(p)) >= 3)
    return F.when(deep, F.substring_index(p, "/", 2)).otherwise(top_dir(p))


def churn_group(path: Column | str, by: str = "dir", component_dir: str = "plugins") -> Column:
    """Group key of the growth report: ``dir``, ``component`` or ``file``."""
    p = _c(path)
    if by == "file":
        return p
    if by == "component":
        inside = p.startswith(component_dir + "/")
        return F.when(inside, F.substring_index(p, "/", 2)).otherwise(top_dir(p))
    if by == "dir":
        return top_dir(p)
    raise ValueError(f"unknown group key {by!r}: use dir, component or file")


def module_name(path: Column | str) -> Column:
    """Dotted import name of a source file; a package's ``__init__`` is the package itself."""
    no_ext = F.regexp_replace(_c(path), r"\.py$", "")
    return F.translate(F.regexp_replace(no_ext, r"(^|/)__init__$", ""), "/", ".")


def package_parts(path: Column | str) -> Column:
    """Directory segments of a file: the package its relative imports start from."""
    segs = segments(path)
    return F.slice(segs, F.lit(1), F.size(segs) - 1)


def language_label(path: Column | str, labels: dict[str, str]) -> Column:
    """Label of the extension, else the bare extension, else ``unknown``."""
    ext = extension(path)
    expr = None
    for key, value in labels.items():
        expr = F.when(ext == key, value) if expr is None else expr.when(ext == key, value)
    bare = F.substr(ext, F.lit(2))
    return expr.otherwise(F.when(bare == "", "unknown").otherwise(bare))


def path_suffixes(path: Column | str) -> Column:
    """Every suffix of a path that starts at a segment: ``a/b/c`` -> ``[a/b/c, b/c, c]``."""
    segs = segments(path)
    return F.transform(
        F.sequence(F.lit(1), F.size(segs)),
        lambda i: F.array_join(F.slice(segs, i, F.size(segs)), "/"),
    )


def dotted_prefixes(name: Column | str) -> Column:
    """Prefixes of a dotted name, longest first."""
    parts = F.split(_c(name), r"\.")
    n = F.size(parts)
    return F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
