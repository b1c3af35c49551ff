"""Syntax facts of one Python file.

The helper only turns a syntax tree into flat rows. Which entities and relationships follow from
them is decided by column expressions in ``operators.extract``.
"""

from __future__ import annotations

import ast
import json
import sys
from collections.abc import Iterator

FACT_SCHEMA = (
    "path string, kind string, pre int, depth int, sub int, name string, owner_names array<string>, "
    "owner_kinds string, owner_pres array<int>, line int, end_line int, is_method boolean, type_hint string, "
    "annotation string, bases array<string>, module string, original_name string, properties string"
)
# What a fact adds to its place in the file, in schema order.
DETAILS = ("end_line", "is_method", "type_hint", "annotation", "bases", "module", "original_name", "properties")
#: Python frames allowed while a file is read.
DEEPEST = 50_000
# Nodes that neither are facts nor contain any.
BARREN = (ast.Name, ast.Constant, ast.expr_context, ast.operator, ast.unaryop, ast.cmpop, ast.boolop, ast.alias)
DEFINITIONS = {ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef}
STATED = {ast.Assign, ast.AnnAssign, ast.Import, ast.ImportFrom, ast.Call}
NODES = [sort for sort in vars(ast).values() if isinstance(sort, type) and issubclass(sort, ast.AST)]
#: Classes of values that are no child to visit, and per node class the fields that may hold one.
PLAIN = {sort for sort in NODES if issubclass(sort, BARREN)} | {type(None), str, int}
VALUES = {"ctx", "op", "ops", "id", "attr", "arg", "names", "module", "level", "kind", "type_comment", "simple", "is_async", "conversion"}
NODE_FIELDS = {sort: tuple(f for f in sort._fields if f not in VALUES) for sort in NODES}


def fact_arrow_schema():
    """The Arrow form of ``FACT_SCHEMA``; imported on executors only."""
    import pyarrow as pa

    text, number = pa.string(), pa.int32()
    return pa.schema([
        ("path", text), ("kind", text), ("pre", number), ("depth", number), ("sub", number), ("name", text),
        ("owner_names", pa.list_(text)), ("owner_kinds", text), ("owner_pres", pa.list_(number)), ("line", number),
        ("end_line", number), ("is_method", pa.bool_()), ("type_hint", text), ("annotation", text),
        ("bases", pa.list_(text)), ("module", text), ("original_name", text), ("properties", text),
    ])


def file_facts(path: str, content) -> list[tuple]:
    """All facts of a file in source order; one ``error`` fact with the reason if there are none."""
    if content is None:
        return [error_fact(path, "the file cannot be read")]
    depth = sys.getrecursionlimit()
    try:
        text = content if isinstance(content, str) else bytes(content).decode("utf-8")
        # Texts of long chains (a.b().c()…) are written recursively, one frame or more per link.
        sys.setrecursionlimit(max(depth, min(len(text) + 1000, DEEPEST)))
        return list(_facts(path, ast.parse(text)))
    except (SyntaxError, ValueError, RecursionError) as error:
        return [error_fact(path, f"{type(error).__name__}: {error}")]
    except MemoryError as error:
        # The parser reports nesting beyond its own stack this way; real shortage has no text.
        if not error.args:
            raise
        return [error_fact(path, f"MemoryError: {error}")]
    finally:
        sys.setrecursionlimit(depth)


def error_fact(path: str, reason: str) -> tuple:
    return (path, "error", 0, 0, 0, reason, [], "", [], 0, *[None] * len(DETAILS))


def _facts(path: str, tree: ast.Module) -> Iterator[tuple]:
    """Pre-order walk with an explicit stack; (depth, pre) gives breadth-first order too.

    ``pre`` moves on by the number of facts a node gives, so ``pre + sub`` is unique in a file.
    Owners are the enclosing definitions, outermost first.
    """

    def row(kind, pre, depth, sub, owners, line, name, details):
        return (path, kind, pre, depth, sub, name, *owners, line, *map(details.get, DETAILS))

    outside = ([], "", [])
    description = ast.get_docstring(tree) or "No module docstring"
    yield row("module", 0, 0, 0, outside, 0, None, {"properties": _json({"description": description})})
    stack = [(child, 1, outside) for child in reversed(_children(tree))]
    pre = 1
    while stack:
        node, depth, owners = stack.pop()
        inner, step = owners, 1
        sort = type(node)
        if sort in DEFINITIONS:
            kind, details = _definition(node)
            yield row(kind, pre, depth, 0, owners, node.lineno, node.name, details)
            names, kinds, pres = owners
            inner = (names + [node.name], kinds + ("c" if kind == "class" else "f"), pres + [pre])
        elif sort in STATED:
            facts = list(_leaf_facts(node))
            step = max(1, len(facts))
            for sub, (kind, name, details) in enumerate(facts):
                yield row(kind, pre, depth, sub, owners, node.lineno, name, details)
        pre += step
        depth += 1
        stack.extend([(child, depth, inner) for child in reversed(_children(node))])


def _children(node) -> list:
    """Child nodes in field order, without the barren ones."""
    found = []
    sort = type(node)
    for field in NODE_FIELDS.get(sort, sort._fields):
        value = getattr(node, field, None)
        if type(value) is list:
            found.extend([v for v in value if type(v) not in PLAIN and isinstance(v, ast.AST)])
        elif type(value) not in PLAIN and isinstance(value, ast.AST):
            found.append(value)
    return found


def _definition(node) -> tuple[str, dict]:
    properties = {
        "description": ast.get_docstring(node) or "No docstring",
        "decorators": [_decorator(d) for d in node.decorator_list] or None,
    }
    details = {"end_line": node.end_lineno}
    if isinstance(node, ast.ClassDef):
        kind = "class"
        properties["bases"] = [_text(b) for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))] or None
        bare = map(_without_subscript, node.bases)
        details["bases"] = [_text(b) for b in bare if isinstance(b, (ast.Name, ast.Attribute))]
    else:
        kind = "async" if isinstance(node, ast.AsyncFunctionDef) else "function"
        properties["args"] = _arguments(node.args) or None
        properties["return_type"] = _text(node.returns) if node.returns else None
    return kind, details | {"properties": _json(properties)}


def _leaf_facts(node) -> Iterator[tuple[str, str, dict]]:
    """(kind, name, details) of statements and calls."""
    match node:
        case ast.Call(func=func):
            yield "call", _text(func), {"is_method": isinstance(func, ast.Attribute)}
        case ast.Assign(targets=targets, value=value):
            hint = _instantiated(value) if len(targets) == 1 else None
            for target in targets:
                if isinstance(target, ast.Name):
                    yield "variable", target.id, {"type_hint": hint}
        case ast.AnnAssign(target=ast.Name(id=name), annotation=annotation):
            hint = annotation.id if isinstance(annotation, ast.Name) else None
            yield "variable", name, {"type_hint": hint, "annotation": _text(annotation)}
        case ast.Import(names=names):
            for alias in names:
                yield "import", alias.asname or alias.name, {"original_name": alias.name}
        case ast.ImportFrom(names=names, module=module):
            for alias in names:
                yield "import", alias.asname or alias.name, {"module": module or "", "original_name": alias.name}


def _instantiated(value) -> str | None:
    """Class text of ``C(...)`` or ``m.C(...)``."""
    match value:
        case ast.Call(func=ast.Name(id=name)) | ast.Call(func=ast.Attribute(attr=name)):
            return name if name[:1].isupper() else None
    return None


def _without_subscript(base):
    while isinstance(base, ast.Subscript):
        base = base.value
    return base


def _decorator(node) -> str:
    while isinstance(node, ast.Call):
        node = node.func
    return _text(node)


def _arguments(args: ast.arguments) -> list[dict]:
    groups = [
        ("positional-or-keyword", args.args),
        ("positional-only", args.posonlyargs),
        ("vararg", [args.vararg] if args.vararg else []),
        ("keyword-only", args.kwonlyargs),
        ("kwarg", [args.kwarg] if args.kwarg else []),
    ]
    return [
        {"name": a.arg, "kind": kind} | ({"type": _text(a.annotation)} if a.annotation else {})
        for kind, group in groups
        for a in group
    ]


def _text(node) -> str:
    """Source text of an expression; plain names and one-dot names skip the unparser."""
    match node:
        case ast.Name(id=name):
            return name
        case ast.Attribute(value=ast.Name(id=owner), attr=attr):
            return f"{owner}.{attr}"
    return ast.unparse(node)


ENCODER = json.JSONEncoder(sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def _json(value) -> str:
    return ENCODER.encode(value)


def canonical_json(text: str | None) -> str:
    """JSON with sorted keys and no spaces; equal values get equal text."""
    return "{}" if not text else _json(json.loads(text))
