"""Extraction from Python with the ``ast`` module.

A file with a syntax error keeps what parses: the source is cut into blocks of
its outermost indentation, each parsed by itself, and within a block that
fails the header and the body's blocks are tried alone.
"""

from __future__ import annotations

import ast
import re
import textwrap

_CONTINUES = re.compile(r"(?:else|elif|except|finally|case)\b|[)\]}]")


def _signature(lines: list[str], node) -> str | None:
    body = node.body[0]
    text = "\n".join(lines[node.lineno - 1 : body.lineno])
    head = text.split(":\n")[0] if body.lineno > node.lineno else ast.unparse(node).split("\n")[-1 if node.body else 0]
    head = head.strip()
    return head[:300] or None


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def _chunks(lines: list[str], first: int, last: int) -> list[tuple[int, int]]:
    """The blocks of lines first to last that begin at their outermost indentation."""
    full = [i for i in range(first, last) if lines[i].strip() and not lines[i].lstrip().startswith("#")]
    if not full:
        return []
    base = min(_indent(lines[i]) for i in full)
    starts: list[int] = []
    decorated = False
    for i in full:
        text = lines[i].lstrip()
        if _indent(lines[i]) == base and not decorated and not (starts and _CONTINUES.match(text)):
            starts.append(i)
        if _indent(lines[i]) == base:
            decorated = text.startswith("@")
    if not starts or starts[0] != full[0]:
        starts.insert(0, full[0])
    return list(zip(starts, [*starts[1:], last], strict=True))


class _Extractor:
    def __init__(self, source: str):
        self.lines = source.split("\n")
        self.out: dict = {"symbols": [], "imports": [], "call_sites": [], "errors": []}

    def visit(self, node, cls: str | None, function: str | None, top: bool) -> None:
        for child in ast.iter_child_nodes(node):
            c, f, t = cls, function, top
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                kind = "class" if is_class else "method" if cls else "function"
                self.out["symbols"].append({"name": child.name, "kind": kind, "start_line": child.lineno, "end_line": child.end_lineno, "exported": top, "signature": _signature(self.lines, child), "parent_name": cls})
                c, f, t = (child.name if is_class else cls), (function if is_class else child.name), False
            elif isinstance(child, ast.Import):
                self.out["imports"] += [{"specifier": a.name, "kind": "static", "line": child.lineno} for a in child.names]
            elif isinstance(child, ast.ImportFrom):
                base = "." * child.level + (child.module or "")
                for a in child.names:
                    whole = base if a.name == "*" else base + a.name if base.endswith(".") else f"{base}.{a.name}"
                    self.out["imports"].append({"specifier": whole, "kind": "static", "line": child.lineno})
            elif isinstance(child, ast.Call):
                name = child.func.id if isinstance(child.func, ast.Name) else child.func.attr if isinstance(child.func, ast.Attribute) else None
                if name and name not in ("require", "import"):
                    self.out["call_sites"].append({"name": name, "line": child.lineno, "enclosing_symbol": function, "kind": "calls"})
            self.visit(child, c, f, t)

    def parsed(self, first: int, last: int, more: str = ""):
        """The tree of some lines, with the file's line numbers."""
        tree = ast.parse(textwrap.dedent("\n".join(self.lines[first:last])) + more)
        ast.increment_lineno(tree, first)
        return tree

    def block(self, first: int, last: int, cls: str | None, function: str | None, top: bool) -> None:
        try:
            tree = self.parsed(first, last)
        except (SyntaxError, ValueError, RecursionError) as e:
            chunks = _chunks(self.lines, first, last)
            if len(chunks) > 1:
                for a, b in chunks:
                    self.block(a, b, cls, function, top)
            elif chunks:
                self.broken(*chunks[0], e, cls, function, top)
            return
        self.visit(tree, cls, function, top)

    def broken(self, first: int, last: int, error: Exception, cls: str | None, function: str | None, top: bool) -> None:
        """One block that does not parse: its header, if that does, and its body."""
        base = _indent(self.lines[first])
        body = next((i for i in range(first + 1, last) if self.lines[i].strip() and _indent(self.lines[i]) > base and self.lines[i - 1].split("#")[0].rstrip().endswith(":")), None)
        if body is None:
            line = (getattr(error, "lineno", None) or 1) + first
            self.out["errors"].append({"line": min(line, last), "message": str(error)[:200]})
            return
        try:
            header = self.parsed(first, body, "\n" + " " * (_indent(self.lines[body]) - base) + "pass")
        except (SyntaxError, ValueError) as e:
            self.out["errors"].append({"line": (getattr(e, "lineno", None) or 1) + first, "message": str(e)[:200]})
        else:
            end = max(i for i in range(first, last) if self.lines[i].strip()) + 1
            node = header.body[0]
            node.end_lineno = end
            self.visit(header, cls, function, top)
            if isinstance(node, ast.ClassDef):
                cls, top = node.name, False
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                function, top = node.name, False
        self.block(body, last, cls, function, top)


def extract(source: str) -> dict:
    found = _Extractor(source)
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as e:
        found.block(0, len(found.lines), None, None, True)
        if not found.out["errors"]:
            found.out["errors"].append({"line": getattr(e, "lineno", None) or 1, "message": str(e)[:200]})
        for rows, key in (("symbols", "start_line"), ("imports", "line"), ("call_sites", "line"), ("errors", "line")):
            found.out[rows].sort(key=lambda r: r[key])
    else:
        found.visit(tree, None, None, True)
    return found.out
