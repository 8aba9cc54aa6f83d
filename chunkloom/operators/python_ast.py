"""What one Python file says by itself: its chunks, and the facts from which the code graph is joined together.

A fact never needs another file. Names are resolved later, for all files at once, by joins over the facts.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

MOST_CHARS = 20_000
MARKER = "\n... [truncated]"
CHUNK_COLUMNS = ["repo_id", "file_path", "chunk_type", "parent_symbol", "symbol_name", "signature", "start_line", "end_line", "imports", "content"]
CHUNK_SCHEMA = "repo_id string, file_path string, chunk_type string, parent_symbol string, symbol_name string, signature string, start_line int, end_line int, imports array<string>, content string"
FACT_COLUMNS = ["repo_id", "file_path", "module", "fact", "scope", "owner", "form", "a", "b", "c", "candidates", "line", "ordinal"]
FACT_SCHEMA = "repo_id string, file_path string, module string, fact string, scope string, owner string, form string, a string, b string, c string, candidates array<string>, line int, ordinal int"
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def parse(source: str) -> ast.Module | None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            return ast.parse(source)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return None


def module_of(path: str) -> str:
    name = path.rsplit(".", 1)[0].replace("/", ".")
    return name.removesuffix(".__init__") if name != "__init__" else name


def described(node: ast.Import | ast.ImportFrom) -> list[str]:
    names = [a.name + (f" as {a.asname}" if a.asname else "") for a in node.names]
    return [f"import {n}" for n in names] if isinstance(node, ast.Import) else [f"from {'.' * node.level}{node.module or ''} import {n}" for n in names]


def signature(node: ast.stmt) -> str:
    if isinstance(node, ast.ClassDef):
        inner = [ast.unparse(b) for b in node.bases] + [f"**{ast.unparse(k.value)}" if k.arg is None else f"{k.arg}={ast.unparse(k.value)}" for k in node.keywords]
        return f"class {node.name}" + (f"({', '.join(inner)})" if inner else "")
    start = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
    return f"{start} {node.name}({ast.unparse(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns is not None else "")


def members(tree: ast.Module) -> Iterator[tuple[str, ast.stmt, ast.ClassDef | None]]:
    """(kind, node, class) of the top-level functions and classes and the methods directly in these."""
    for node in tree.body:
        if isinstance(node, FUNCTIONS):
            yield "function", node, None
        elif isinstance(node, ast.ClassDef):
            yield "class", node, None
            yield from (("method", m, node) for m in node.body if isinstance(m, FUNCTIONS))


def file_chunks(repo_id: str, path: str, source: str, most_chars: int = MOST_CHARS) -> list[tuple]:
    tree = parse(source)
    if tree is None or not tree.body:
        return []
    lines = source.splitlines()
    top = list(dict.fromkeys(x for n in tree.body if isinstance(n, ast.Import | ast.ImportFrom) for x in described(n)))

    def row(kind: str, parent: str | None, name: str, sign: str | None, node: ast.stmt, imports: list[str]) -> tuple:
        text = "\n".join(lines[node.lineno - 1 : node.end_lineno])
        if 0 < most_chars < len(text):
            text = text[: max(0, most_chars - len(MARKER))] + MARKER
        return (repo_id, path, kind, parent, name, sign, node.lineno, node.end_lineno, imports, text)

    out = []
    first = tree.body[0]
    if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
        out.append(row("module_doc", None, "__module_doc__", None, first, top))
    for kind, node, parent in members(tree):
        inner = [x for n in ast.walk(node) if isinstance(n, ast.Import | ast.ImportFrom) for x in described(n)]
        out.append(row(kind, parent.name if parent else None, node.name, signature(node), node, list(dict.fromkeys(top + inner))))
    return out


def form_of(func: ast.expr) -> tuple[str, str | None, str | None, str | None]:
    """How a callee or base is written: name a, attr a.b, deep a.b.c, or other."""
    if isinstance(func, ast.Name):
        return "name", func.id, None, None
    if isinstance(func, ast.Attribute) and isinstance(func.value, ast.Name):
        return "attr", func.value.id, func.attr, None
    if isinstance(func, ast.Attribute) and isinstance(func.value, ast.Attribute) and isinstance(func.value.value, ast.Name):
        return "deep", func.value.value.id, func.value.attr, func.attr
    return "other", None, None, None


def file_facts(repo_id: str, path: str, source: str) -> list[tuple]:
    tree = parse(source)
    if tree is None:
        return []
    module = module_of(path)
    out: list[tuple] = []

    def add(fact: str, line: int, scope: str | None = None, owner: str | None = None, form: str | None = None, a: str | None = None, b: str | None = None, c: str | None = None, candidates: list[str] | None = None) -> None:
        out.append((repo_id, path, module, fact, scope, owner, form, a, b, c, candidates, line, len(out)))

    add("symbol", 1, scope=module, form="module")
    for node in tree.body:
        if isinstance(node, ast.Import):
            for x in node.names:
                add("import", node.lineno, candidates=[x.name])
                add("alias", node.lineno, form="import", a=x.asname or x.name.split(".")[0], c=x.name)
        elif isinstance(node, ast.ImportFrom):
            base = node.module or ""
            if node.level:
                package = module.split(".")[:-1]
                package = package[: len(package) - (node.level - 1)] if node.level > 1 else package
                base = ".".join([*package, *([node.module] if node.module else [])])
            for x in node.names:
                add("import", node.lineno, candidates=[f"{base}.{x.name}", base] if base else [x.name])
                if x.name != "*":
                    add("alias", node.lineno, form="from", a=x.asname or x.name, b=base or None, c=x.name)
    for kind, node, parent in members(tree):
        name = f"{module}.{parent.name}.{node.name}" if parent else f"{module}.{node.name}"
        owner = f"{module}.{parent.name}" if parent else None
        add("symbol", node.lineno, scope=name, owner=owner, form=kind, a=node.name, b=parent.name if parent else None)
        if kind == "class":
            for base in node.bases:
                form, a, b, c = form_of(base)
                add("base", node.lineno, scope=name, form=form, a=a, b=b, c=c)
            continue
        called = {id(n.func) for n in ast.walk(node) if isinstance(n, ast.Call)}
        for n in ast.walk(node):
            if isinstance(n, ast.Call):
                form, a, b, c = form_of(n.func)
                add("call", n.lineno, scope=name, owner=owner, form="self" if form == "attr" and a == "self" and owner else form, a=a, b=b, c=c)
            elif isinstance(n, ast.Assign) and isinstance(n.value, ast.Call):
                form, a, b, _ = form_of(n.value.func)
                for t in n.targets:
                    if isinstance(t, ast.Name):
                        add("assign", n.lineno, scope=name, form=form, a=a, b=b, c=t.id)
            elif isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load) and id(n) not in called:
                add("load", n.lineno, scope=name, a=n.id)
    return out


def _per_file(files: DataFrame, make, columns: list[str], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for f in b.itertuples() for r in make(f.repo_id, f.file_path, f.source)], columns=columns)

    return files.select("repo_id", "file_path", "source").filter("source is not null").mapInPandas(run, schema)


def chunks(files: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """The chunks of Python files (repo_id, file_path, source); files that do not parse give none."""
    return _per_file(files, lambda r, p, s: file_chunks(r, p, s, most_chars), CHUNK_COLUMNS, CHUNK_SCHEMA)


def facts(files: DataFrame) -> DataFrame:
    """The facts of Python files (repo_id, file_path, source); files that do not parse give none."""
    return _per_file(files, file_facts, FACT_COLUMNS, FACT_SCHEMA)


def warnings_of(files: DataFrame) -> DataFrame:
    """(repo_id, file_path, warning) of the files that do not parse."""

    def bad(r: str, p: str, s: str) -> list[tuple]:
        return [] if parse(s) is not None else [(r, p, "syntax error")]

    return _per_file(files, bad, ["repo_id", "file_path", "warning"], "repo_id string, file_path string, warning string")
