"""Sources and sinks: file trees, manifests, diagram text, workspace export (family S)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlens.functions.enrichers import generated, language_of
from arborlens.functions.naming import path_score
from arborlens.operators.resolve import ignored

#: Folders never scanned.
BUILD_FOLDERS = [".git", "build", "dist", "node_modules", "target", "vendor"]
MAX_BYTES = 100 << 20


def scan(spark: SparkSession, root: str, patterns: list[str] = (), only: list[str] | None = None) -> DataFrame:
    """path, language, size_bytes, mtime, content, hash of source files below a folder; files above 100 MB are skipped."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= MAX_BYTES)
    base = re.sub(r"^[a-z]+:/+", "/", root).rstrip("/")
    f = f.withColumn("path", F.regexp_replace("path", rf"^[a-z]+:/*{re.escape(base)}/", ""))
    f = ignored(f, BUILD_FOLDERS, list(patterns)).where("not ignored").withColumn("language", language_of(F.col("path"))["language"]).where("language is not null")
    f = f.where(~generated(F.decode(F.substring(F.col("content"), 1, 8192), "UTF-8")))
    if only is not None:
        f = f.where(F.col("path").isin(sorted({p.removeprefix("./") for p in only if not p.startswith("/") and ".." not in p.split("/")})))
    return f.select("path", "language", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("hash"))


def planned(files: DataFrame, strategy: str = "auto", limit: int = 2000, most: int = 20000) -> DataFrame:
    """The files to read. full: all; limited: the `limit` that tell most by their names, ties by path; abort: an error beyond `most`; auto: all up to `most`, else limited."""
    if strategy not in ("auto", "full", "limited", "abort"):
        raise ValueError(f"unknown strategy {strategy}")
    many = strategy in ("auto", "abort") and files.limit(most + 1).count() > most
    if many and strategy == "abort":
        raise ValueError(f"more than {most} files")
    return files.orderBy(path_score(F.col("path")).desc(), "path").limit(limit) if many or strategy == "limited" else files


def changed(files: DataFrame, known: DataFrame, version: str | None = None) -> DataFrame:
    """Files whose (path, hash) was not read before without an error, and by this version of the enrichers where known has a column enriched."""
    good = known.where("status <> 'error'")
    if version is not None and "enriched" in known.columns:
        good = good.where(F.col("enriched") == version)
    return files.join(good.select("path", "hash"), ["path", "hash"], "left_anti")


#: How languages other than Python open a symbol, and what it is.
OPENERS = {
    "go": r"^func\s+(?:\([^)]*\)\s*)?(?P<function>\w+)|^type\s+(?P<type>\w+)",
    "java": r"^\s*(?:(?:public|protected|private|static|final|abstract)\s+)*(?:class|interface|enum|record)\s+(?P<type>\w+)|^\s+(?:(?:public|protected|private|static|final|abstract|synchronized)\s+)+[\w<>\[\], .?]+\s+(?P<function>\w+)\s*\([^;]*$",
    "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(?P<function>\w+)|^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(?P<type>\w+)",
    "typescript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<function>\w+)|^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface)\s+(?P<type>\w+)|^\s*(?:export\s+)?const\s+(?P<arrow>\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]+)?=>",
    "cpp": r"^\s*(?:class|struct)\s+(?P<type>\w+)\s*[:{]|^(?:[\w:<>*&~]+\s+)+(?P<function>[\w:~]+)\s*\([^;]*\)\s*(?:const\s*)?\{",
}
OPENERS["javascript"], OPENERS["c"] = OPENERS["typescript"], OPENERS["cpp"]


def brace_symbols(files: DataFrame) -> DataFrame:
    """Symbols of languages with braces, and the calls inside them: path, name, kind, line, end_line, parent, calls.

    A line-based reading: a symbol opens where its language's form begins a line, and ends where its braces close. calls are names
    before a parenthesis, in order, without the language's own words.
    """
    def parse(batches):
        openers = {k: re.compile(v) for k, v in OPENERS.items()}
        words = {"if", "for", "while", "switch", "catch", "return", "func", "function", "fn", "sizeof", "match", "new", "super", "defer", "go", "else"}
        for pdf in batches:
            out = []
            for path, language, content in zip(pdf["path"], pdf["language"], pdf["content"]):
                if language not in openers or content is None:
                    continue
                plain = re.sub(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'', '""', re.sub(r"/\*.*?\*/", lambda m: "\n" * m[0].count("\n"), content, flags=re.S))
                depth, stack = 0, []
                for number, line in enumerate(re.sub(r"//[^\n]*", "", plain).splitlines(), 1):
                    m = openers[language].match(line)
                    if m:
                        kind, name = next((k, v) for k, v in m.groupdict().items() if v)
                        row = [path, name, "function" if kind == "arrow" else kind, number, number, stack[-1][0][1] if stack else None, []]
                        out.append(row)
                        stack.append((row, depth, "{" in line))
                    if stack:
                        found = [c for c in re.findall(r"\b(\w+)\s*\(", line[m.end() :] if m else line) if c not in words]
                        stack[-1][0][6].extend(found)
                    depth += line.count("{") - line.count("}")
                    while stack:
                        row, at, opened = stack[-1]
                        opened = opened or "{" in line
                        stack[-1] = (row, at, opened)
                        row[4] = number
                        if (opened and depth <= at) or (not opened and line.rstrip().endswith(";")):
                            stack.pop()
                        else:
                            break
            yield pd.DataFrame(out, columns=["path", "name", "kind", "line", "end_line", "parent", "calls"])

    return files.select("path", "language", "content").mapInPandas(parse, "path string, name string, kind string, line long, end_line long, parent string, calls array<string>")


def python_references(files: DataFrame) -> DataFrame:
    """Calls and imports of Python files: path, name, kind, line, column."""
    import ast

    def parse(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    tree = ast.parse(content)
                except (SyntaxError, ValueError):
                    continue
                for node in ast.walk(tree):
                    if isinstance(node, ast.Call) and isinstance(node.func, (ast.Name, ast.Attribute)):
                        out.append((path, node.func.id if isinstance(node.func, ast.Name) else node.func.attr, "call", node.lineno, node.col_offset))
                    elif isinstance(node, ast.Import):
                        out += [(path, a.name, "import", node.lineno, node.col_offset) for a in node.names]
                    elif isinstance(node, ast.ImportFrom):
                        out.append((path, "." * node.level + (node.module or ""), "import", node.lineno, node.col_offset))
            yield pd.DataFrame(sorted(out), columns=["path", "name", "kind", "line", "column"])

    return files.where("language = 'python'").select("path", "content").mapInPandas(parse, "path string, name string, kind string, line long, column long")


def python_symbols(files: DataFrame) -> DataFrame:
    """Symbols of Python files: path, name, kind, line, end_line, parent. A file that does not parse has none."""
    import ast

    def parse(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    tree = ast.parse(content)
                except (SyntaxError, ValueError):
                    continue
                stack = [(tree, None)]
                while stack:
                    node, parent = stack.pop()
                    for child in ast.iter_child_nodes(node):
                        kind = {"FunctionDef": "function", "AsyncFunctionDef": "function", "ClassDef": "class"}.get(type(child).__name__)
                        if kind:
                            out.append((path, child.name, kind, child.lineno, child.end_lineno, parent))
                        stack.append((child, child.name if kind else parent))
            yield pd.DataFrame(out, columns=["path", "name", "kind", "line", "end_line", "parent"])

    return files.where("language = 'python'").select("path", "content").mapInPandas(parse, "path string, name string, kind string, line long, end_line long, parent string")


_EDGE = re.compile(r"^\s*(\w+)(?:[\[({]+\"?([^\])}\"]*)\"?[\])}]+)?\s*(<?[-=.]+>?)\s*(?:\|([^|]*)\|)?\s*(\w+)(?:[\[({]+\"?([^\])}\"]*)\"?[\])}]+)?\s*;?\s*$")
_NODE = re.compile(r"^\s*(\w+)[\[({]+\"?([^\])}\"]*)\"?[\])}]+\s*;?\s*$")


def mermaid(text: str) -> tuple[list[tuple], list[tuple]]:
    """Flowchart text -> elements (ref, name) and connectors (source, target, label, direction)."""
    names: dict[str, str] = {}
    edges = []
    for line in text.splitlines():
        if re.match(r"\s*(%%|flowchart|graph|subgraph|end\b|classDef|class\b|style)", line):
            continue
        if m := _EDGE.match(line):
            a, an, arrow, label, b, bn = m.groups()
            for ref, name in ((a, an), (b, bn)):
                if name or ref not in names:
                    names[ref] = name or names.get(ref, ref)
            kind = "both" if arrow[0] == "<" and arrow[-1] == ">" else "forward" if arrow[-1] == ">" else "none"
            edges.append((a, b, (label or "").strip() or None, kind))
        elif m := _NODE.match(line):
            names[m[1]] = m[2]
    return sorted(names.items()), edges
