"""Python by the standard library's syntax trees."""

from __future__ import annotations

import ast
import warnings

from lodeweave.sources.extract import Call, Extract, Symbol

_SELF = ("self", "cls")


def _text(source: str, node: ast.AST) -> str:
    return (ast.get_source_segment(source, node) or "").strip()


def _calls(source: str, body: list[ast.stmt]) -> list[Call]:
    found: list[tuple[int, int, Call]] = []
    for top in body:
        for node in ast.walk(top):
            if isinstance(node, ast.Call):
                target = node.func
                if isinstance(target, ast.Name):
                    name, qualifier = target.id, ""
                elif isinstance(target, ast.Attribute):
                    name, qualifier = target.attr, _text(source, target.value)
                else:
                    continue
                receiver = qualifier if qualifier in _SELF else ""
                found.append((node.lineno, node.col_offset, Call(name, qualifier, receiver, len(node.args) + len(node.keywords), node.lineno, _text(source, target))))
    return [call for _, _, call in sorted(found, key=lambda x: x[:2])]


def _doc(node: ast.AST) -> str:
    text = ast.get_docstring(node, clean=False) or ""
    return next((line.strip() for line in text.splitlines() if line.strip()), "")


def _signature(source: str, node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    segment = _text(source, node)
    first = node.body[0]
    lines = segment.split("\n")
    depth, out = 0, []
    for ch in "\n".join(lines[: max(1, first.lineno - node.lineno + 1)]):
        if ch in "([{":
            depth += 1
        elif ch in ")]}":
            depth -= 1
        elif ch == ":" and depth == 0:
            break
        out.append(ch)
    return " ".join("".join(out).split())


def _visit(source: str, body: list[ast.stmt], in_class: bool, out: Extract) -> None:
    for node in body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):  # what is defined inside isn't looked at
            out.symbols.append(Symbol(node.name, "method" if in_class else "func", _signature(source, node), node.lineno, _doc(node), _calls(source, node.body)))
        elif isinstance(node, ast.ClassDef):
            bases = ", ".join(_text(source, b) for b in [*node.bases, *[k.value for k in node.keywords]])
            out.symbols.append(Symbol(node.name, "class", f"class {node.name}" + (f"({bases})" if bases else ""), node.lineno, _doc(node)))
            _visit(source, node.body, True, out)
        elif isinstance(node, ast.Import):
            for name in node.names:
                out.imports.append(name.name)
                out.aliases[name.asname or name.name.rpartition(".")[2]] = name.name
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            out.imports.append(module)
            last = module.rpartition(".")[2]
            if last:
                out.aliases[last] = module
            for name in node.names:
                if name.name != "*":
                    out.aliases[name.asname or name.name] = f"{module}#{name.name}"
        else:
            for part in ("body", "orelse", "finalbody"):
                inner = getattr(node, part, None)
                if isinstance(inner, list):
                    _visit(source, [x for x in inner if isinstance(x, ast.stmt)], in_class, out)
            for handler in getattr(node, "handlers", []):
                _visit(source, handler.body, in_class, out)


def extract(path: str, content: bytes) -> Extract:
    """Extract a module: functions and classes that aren't inside functions, calls in functions, and imports.

    A file with a syntax error gives an issue and what a scan by lines finds.
    """
    source = content.decode("utf-8", "replace")
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as error:
        from lodeweave.sources.extract.scanned import python_lines

        out = python_lines(source)
        out.issue = f"{path}: {error}"
        return out
    out = Extract()
    _visit(source, tree.body, False, out)
    out.imports = list(dict.fromkeys(out.imports))
    return out
