"""Source files to symbols, calls, imports and literals.

Python is parsed by its own grammar; other languages by patterns for definitions and calls, which miss what
a real parser would see (nested generics, macros). The parser is pluggable.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# File endings and interpreters by language.
EXTENSIONS = {"rs": "rust", "py": "python", "pyi": "python", "go": "go", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "java": "java", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala", "lua": "lua", "sh": "bash", "bash": "bash", "m": "objc", "ex": "elixir", "zig": "zig", "hs": "haskell"}
SHEBANGS = {"python": "python", "bash": "bash", "sh": "bash", "node": "javascript", "ruby": "ruby", "php": "php", "lua": "lua"}
#: Sources that one task parses.
TASK_SOURCES = 10_000
ROWS = "path string, row string, name string, kind string, owner string, line_start int, line_end int, detail string"


def language_of(path: Column, content: Column) -> Column:
    """Language by file ending, else by shebang; a .h file with C++ or Objective-C words is that language."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    bang = F.create_map(*[F.lit(x) for pair in SHEBANGS.items() for x in pair])
    head = F.when(content.rlike(r"(?m)^\s*(class\s+\w+|namespace\s+\w+|template\s*<)"), "cpp").when(content.rlike(r"(?m)^@(interface|protocol|class)\b"), "objc").otherwise("c")
    return F.when(ext == "h", head).otherwise(F.coalesce(table[ext], bang[F.regexp_extract(content, r"^#!\s*\S*?(?:env\s+)?([a-z]+)[0-9.]*\s*(?:\n|$)", 1)]))


def module_path(language: Column, path: Column) -> Column:
    """Module of a file: ``crate::a::b`` for Rust, dotted for Python, the folder for Go."""
    bare = F.regexp_replace(F.regexp_replace(path, r"^src/", ""), r"\.[A-Za-z0-9]+$", "")
    return (
        F.when(language == "rust", F.concat(F.lit("crate::"), F.replace(F.regexp_replace(bare, r"/mod$|^lib$|^main$", ""), F.lit("/"), F.lit("::"))))
        .when(language == "python", F.replace(F.regexp_replace(bare, r"/__init__$", ""), F.lit("/"), F.lit(".")))
        .when(language == "go", F.regexp_extract(path, r"^(.*)/[^/]*$", 1))
    )


def _dotted(node: ast.AST) -> str:
    """The source of an expression; names and their attributes, as most receivers are, need no unparser."""
    parts: list[str] = []
    x = node
    while isinstance(x, ast.Attribute):
        parts.append(x.attr)
        x = x.value
    return ".".join([x.id, *reversed(parts)]) if isinstance(x, ast.Name) else ast.unparse(node)


def parse_python(source: str) -> list[tuple]:
    out: list[tuple] = []
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return [("error", "", "", None, None, None, "syntax")]

    def walk(node: ast.AST, owner: str | None, caller: str | None) -> None:
        for x in ast.iter_child_nodes(node):
            inner, who = owner, caller
            if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef):
                out.append(("symbol", x.name, "method" if owner else "function", owner, x.lineno, x.end_lineno, ast.get_docstring(x) or ""))
                who = x.name
            elif isinstance(x, ast.ClassDef):
                out.append(("symbol", x.name, "class", owner, x.lineno, x.end_lineno, ast.get_docstring(x) or ""))
                inner = x.name
            elif isinstance(x, ast.Import):
                out.extend(("import", a.name, "module", None, x.lineno, x.lineno, a.asname or "") for a in x.names)
            elif isinstance(x, ast.ImportFrom):
                out.extend(("import", f"{x.module or ''}.{a.name}", "name", None, x.lineno, x.lineno, a.asname or "") for a in x.names)
            elif isinstance(x, ast.Call):
                f = x.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""
                if name:
                    out.append(("call", name, "Calls", caller, x.lineno, x.end_lineno, _dotted(f.value) if isinstance(f, ast.Attribute) else ""))
            elif isinstance(x, ast.Constant) and isinstance(x.value, str):
                out.append(("literal", x.value[:200], "string", caller, x.lineno, x.end_lineno, ""))
            walk(x, inner, who)

    walk(tree, None, None)
    return out


_DEF = re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+|export\s+|public\s+|private\s+|static\s+|async\s+|unsafe\s+)*(fn|func|function|struct|enum|trait|class|interface|impl|type|def|module)\s+([A-Za-z_]\w*)")
_CALL = re.compile(r"\b([A-Za-z_]\w*)\s*\(")
_USE = re.compile(r"^\s*(?:use|import|#include|require)\s+[<\"']?([\w:./]+)")
_STRING = re.compile(r"\"((?:[^\"\\]|\\.)*)\"")
_KEYWORDS = frozenset("if for while match switch return fn func function catch sizeof".split())


def parse_pattern(source: str) -> list[tuple]:
    out: list[tuple] = []
    current = None
    for n, line in enumerate(source.split("\n"), 1):
        if m := _DEF.match(line):
            kind = {"fn": "function", "func": "function", "def": "function"}.get(m[1], m[1])
            out.append(("symbol", m[2], kind, None, n, n, ""))
            current = m[2] if kind == "function" else current
        if m := _USE.match(line):
            out.append(("import", m[1], "module", None, n, n, ""))
        out.extend(("call", c, "Calls", current, n, n, "") for c in _CALL.findall(line) if c not in _KEYWORDS and c != current)
        out.extend(("literal", s[:200], "string", current, n, n, "") for s in _STRING.findall(line))
    return out


def parse_sources(files: DataFrame, parser: Callable[[str, str], list[tuple]] | None = None) -> DataFrame:
    """``files(path, source)`` to typed rows (symbol, call, import, literal, error).

    Sources are dealt by number, for parsing is work that their bytes, or the bytes of what they are made of, don't show.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, source in zip(pdf["path"], pdf["source"], strict=True):
                parse = parser or (lambda p, s: parse_python(s) if p.endswith((".py", ".pyi")) else parse_pattern(s))
                rows.extend((path, *r) for r in parse(path, source or ""))
            yield pd.DataFrame(rows, columns=["path", "row", "name", "kind", "owner", "line_start", "line_end", "detail"]).astype({"line_start": "Int32", "line_end": "Int32"})

    tasks = max(files.sparkSession.sparkContext.defaultParallelism, ceil(files.count() / TASK_SOURCES))
    return files.select("path", "source").repartition(tasks).mapInPandas(run, ROWS)


def scan(spark, root: str, ignore: str | None = None, most_bytes: int = 1 << 20) -> DataFrame:
    """``(path, source, hash, tokens)`` of the text files under ``root``: at most 1 MiB, valid UTF-8, not matching the regex ``ignore``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if ignore:
        files = files.where(~F.col("path").rlike(ignore))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.where(F.col("length") <= most_bytes).select("path", text.alias("source"), F.sha2("content", 256).alias("hash"), F.ceil(F.col("length") / 4).alias("tokens")).where("source is not null")
