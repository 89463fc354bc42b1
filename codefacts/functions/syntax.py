"""Per-file helper of the facts job: flattens a Python syntax tree into records; Spark gives them meaning.

Records hold names, numbers and source text as written. Nothing is judged, joined or shortened here.
"""

from __future__ import annotations

import ast
import re
import warnings
from dataclasses import dataclass, replace

#: an escape that may stand for half of a character; only then strings need a look before they leave
_HALF_CHARACTER = re.compile(r"\\[uU]0*[dD][89a-fA-F]")
#: positional arguments whose source text a consumer may ask for; keywords always have theirs
_TEXT_POSITIONS = 3
_EMPTY: dict = {"ok": False, "error": None, "doc": None, "defs": [], "calls": [], "imports": [], "handlers": [], "used": [], "listed": []}


@dataclass(slots=True)
class _Place:
    """Where a node stands: enclosing names, parameters in reach, and what it belongs to directly."""

    scope: str = ""
    params: tuple[tuple[str, str], ...] = ()
    owner: str | None = None
    owner_line: int = 0
    target: str | None = None
    decorates: ast.AST | None = None

    def inside(self) -> _Place:
        if self.owner is None and self.target is None and self.decorates is None and not self.owner_line:
            return self  # most nodes stand deep inside already
        return _Place(self.scope, self.params)


def _names_of(func: ast.AST) -> list[str]:
    """``a.b.c`` as ``[a, b, c]``; a root that is a call becomes ``<expr>``, any other root without a name ``<other>``."""
    if isinstance(func, ast.Attribute):
        root = _names_of(func.value) if isinstance(func.value, (ast.Attribute, ast.Name)) else ["<expr>" if isinstance(func.value, ast.Call) else "<other>"]
        return [*root, func.attr]
    return [func.id] if isinstance(func, ast.Name) else []


def _string_items(node: ast.AST) -> list[str] | None:
    if isinstance(node, (ast.List, ast.Tuple)):
        return [x.value for x in node.elts if isinstance(x, ast.Constant) and isinstance(x.value, str)]
    return None


def _source(node: ast.AST) -> str:
    """Source text as ``ast.unparse`` prints it; plain names and literals, which most arguments are, without its help."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Constant) and node.kind is None and type(node.value) in (str, int, bool):
        return repr(node.value)
    return ast.unparse(node)


def _signature(args: ast.arguments) -> str:
    """Parameters as ``ast.unparse`` prints them; plain names with plain defaults, which most are, without its help."""
    plain = args.args
    if args.posonlyargs or args.kwonlyargs or args.vararg or args.kwarg or any(x.annotation for x in plain):
        return ast.unparse(args)
    if not all(isinstance(x, (ast.Name, ast.Constant)) for x in args.defaults):
        return ast.unparse(args)
    first = len(plain) - len(args.defaults)
    return ", ".join(x.arg if k < first else f"{x.arg}={_source(args.defaults[k - first])}" for k, x in enumerate(plain))


def _argument(node: ast.AST, keyword: str | None, with_text: bool) -> dict:
    return {
        "kw": keyword,
        "text": _source(node) if with_text else None,
        "kind": type(node).__name__,
        "value": node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None,
        "ident": getattr(node, "id", None) or getattr(node, "attr", None),
        "strs": _string_items(node),
    }


class _Records:
    """Collects records of one tree, node by node; each kind of node has its own method."""

    def __init__(self) -> None:
        self.tables: dict[str, list[dict]] = {"defs": [], "calls": [], "imports": [], "handlers": [], "listed": []}
        self.used: set[str] = set()

    def take(self, node: ast.AST, place: _Place) -> None:
        kind = type(node)
        if kind in _LEAVES:
            return
        known = _TAKES.get(kind)
        if known is not None:
            known(self, node, place)
        else:
            self.below(node, place.inside())

    def below(self, node: ast.AST, place: _Place) -> None:
        for field in node._fields:
            child = getattr(node, field, None)
            if isinstance(child, ast.AST):
                self.take(child, place)
            elif isinstance(child, list):
                for x in child:
                    if isinstance(x, ast.AST):
                        self.take(x, place)

    def take_Name(self, node: ast.Name, place: _Place) -> None:
        self.used.add(node.id)

    def take_Assign(self, node: ast.Assign, place: _Place) -> None:
        items = _string_items(node.value)
        if items is not None and place.owner == "" and not place.scope:
            self.tables["listed"].append({"targets": [t.id for t in node.targets if isinstance(t, ast.Name)], "strs": items})
        target = node.targets[0].id if len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) else None
        for part in node.targets:
            self.take(part, place.inside())
        self.take(node.value, replace(place.inside(), target=target if isinstance(node.value, ast.Call) else None))

    def take_Call(self, node: ast.Call, place: _Place) -> None:
        chain = _names_of(node.func)
        if chain:
            marked = place.decorates
            positional = [_argument(x, None, k < _TEXT_POSITIONS) for k, x in enumerate(node.args)]
            self.tables["calls"].append({
                "scope": place.scope, "chain": chain, "lineno": node.lineno,
                "args": positional + [_argument(k.value, k.arg or "**", True) for k in node.keywords], "assigned_to": place.target,
                "decorates": getattr(marked, "name", None), "decorates_line": getattr(marked, "lineno", None),
                "decorates_doc": ast.get_docstring(marked) if marked is not None else None,
                "owner_param_of": dict(reversed(place.params)).get(chain[0]),
            })
        self.below(node, place.inside())

    def _import(self, node, place: _Place, module_of, level: int) -> None:
        for alias in node.names:
            module, name = module_of(alias)
            self.tables["imports"].append({
                "kind": "import" if name is None else "from", "module": module, "level": level, "name": name, "alias": alias.asname,
                "lineno": node.lineno, "top": place.owner == "" and not place.scope,
            })

    def take_Import(self, node: ast.Import, place: _Place) -> None:
        self._import(node, place, lambda alias: (alias.name, None), 0)

    def take_ImportFrom(self, node: ast.ImportFrom, place: _Place) -> None:
        self._import(node, place, lambda alias: (node.module, alias.name), node.level or 0)

    def take_ExceptHandler(self, node: ast.ExceptHandler, place: _Place) -> None:
        self.tables["handlers"].append({
            "lineno": node.lineno, "body": [type(x).__name__ for x in node.body], "caught": node.name,
            "names": sorted({x.id for x in ast.walk(node) if isinstance(x, ast.Name)}),
            "returns": [type(x.value).__name__ for x in node.body if isinstance(x, ast.Return)],
        })
        self.below(node, place.inside())

    def _definition(self, node, place: _Place, kind: str, signature: str, bases: list[str]) -> _Place:
        self.tables["defs"].append({
            "kind": kind, "name": node.name, "scope": place.scope, "container": place.owner, "container_line": place.owner_line,
            "lineno": node.lineno, "end_lineno": node.end_lineno or node.lineno, "doc": ast.get_docstring(node), "signature": signature,
            "bases": bases, "decorators": [_source(x) for x in node.decorator_list],
        })
        return replace(place.inside(), scope=f"{place.scope}.{node.name}" if place.scope else node.name)

    def _parts(self, node, inner: _Place, body: _Place) -> None:
        for x in node.decorator_list:
            self.take(x, replace(inner, decorates=node))
        for field, value in ast.iter_fields(node):
            if field not in ("decorator_list", "body"):
                for x in value if isinstance(value, list) else [value]:
                    if isinstance(x, ast.AST):
                        self.take(x, inner)
        for x in node.body:
            self.take(x, body)

    def take_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef, place: _Place) -> None:
        written = f"({_signature(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")
        inner = self._definition(node, place, "def", written, [])
        own = [(x.arg, node.name) for x in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs)]
        # of the same name in several functions around, the outermost counts, so outer ones stay in front
        inner = replace(inner, params=(*place.params, *own))
        self._parts(node, inner, inner)

    take_AsyncFunctionDef = take_FunctionDef

    def take_ClassDef(self, node: ast.ClassDef, place: _Place) -> None:
        inner = self._definition(node, place, "class", "", [_source(b).rsplit(".", 1)[-1] for b in node.bases])
        top = place.owner == "" and not place.scope
        self._parts(node, inner, replace(inner, owner=node.name, owner_line=node.lineno) if top else inner)


#: the method for each kind of node that has one, and kinds that hold no other nodes
_TAKES = {getattr(ast, name.removeprefix("take_")): method for name, method in vars(_Records).items() if name.startswith("take_")}
_LEAVES = frozenset({ast.Constant, ast.Load, ast.Store, ast.Del, ast.Pass})


def _storable(value):
    """The same records with halves of characters written as escapes, so that every string is a text."""
    if isinstance(value, str):
        return value.encode("utf-8", "backslashreplace").decode("utf-8")
    if isinstance(value, dict):
        return {k: _storable(v) for k, v in value.items()}
    return [_storable(v) for v in value] if isinstance(value, list) else value


def flatten(text: str) -> dict:
    """Records of one Python file; a file that cannot be read gives ``ok=False`` and the reason, whatever the reason is."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", SyntaxWarning)
            tree = ast.parse(text)
        found = _Records()
        for statement in tree.body:
            found.take(statement, _Place(owner=""))
        records = {**_EMPTY, **found.tables, "ok": True, "doc": ast.get_docstring(tree), "used": sorted(found.used)}
        return _storable(records) if _HALF_CHARACTER.search(text) else records
    except SyntaxError as e:
        return _storable({**_EMPTY, "error": f"SyntaxError: {e.msg} (line {e.lineno})"})
    except Exception as e:  # one file must not stop the corpus; its row says why it has no facts
        return _storable({**_EMPTY, "error": f"{type(e).__name__}: {e}"})
