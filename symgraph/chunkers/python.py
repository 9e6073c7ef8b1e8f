"""Python chunks by the standard library's parser; call sites and returns for edges."""

from __future__ import annotations

import ast

FALLBACK_NAME = 80


def _offsets(source: bytes) -> list[int]:
    out = [0]
    for k, b in enumerate(source):
        if b == 10:
            out.append(k + 1)
    return out


def parsed(source: bytes) -> ast.Module | None:
    """The tree, or None where the source isn't Python this interpreter reads."""
    try:
        return ast.parse(source)
    except (SyntaxError, ValueError):
        return None


def _span(node: ast.AST, starts: list[int]) -> tuple[int, int]:
    return starts[node.lineno - 1] + node.col_offset, starts[node.end_lineno - 1] + node.end_col_offset


def chunks(source: bytes) -> list[tuple[str, str, int, int]]:
    """(kind, name, start, end) of classes, functions and imports. A decorated one has two spans, with and
    without its decorators, both of its own kind and name."""
    tree, starts, out = parsed(source), _offsets(source), []
    for node in ast.walk(tree) if tree else ():
        kind = {"ClassDef": "class_definition", "FunctionDef": "function_definition", "AsyncFunctionDef": "function_definition", "Import": "import_statement", "ImportFrom": "import_from_statement"}.get(type(node).__name__)
        if kind is None:
            continue
        start, end = _span(node, starts)
        if kind.startswith("import"):
            name = source[start:end].decode("utf-8", "replace").strip().split("\n", 1)[0]
            out.append((kind, name.encode()[:FALLBACK_NAME].decode("utf-8", "ignore"), start, end))
            continue
        out.append((kind, node.name, start, end))
        if node.decorator_list:
            first = min(_span(d, starts)[0] for d in node.decorator_list)
            out.append((kind, node.name, source.rindex(b"@", 0, first + 1) if b"@" in source[: first + 1] else first, end))
    return out


def sites(source: bytes) -> list[tuple[str, int, int, int, int]]:
    """(what, start_line, start_col, end_line, end_col) of callees, decorators and return statements, lines from 0."""
    tree, out = parsed(source), []
    place = lambda n: (n.lineno - 1, n.col_offset, n.end_lineno - 1, n.end_col_offset)
    for node in ast.walk(tree) if tree else ():
        if isinstance(node, ast.Call):
            out.append(("call", *place(node.func)))
        elif isinstance(node, ast.Return):
            out.append(("return", *place(node)))
        elif isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            out += [("decorator", *place(d.func if isinstance(d, ast.Call) else d)) for d in node.decorator_list]
    return sorted(set(out), key=lambda s: s[1:])
