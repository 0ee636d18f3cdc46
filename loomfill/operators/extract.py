"""Syntax nodes of source files, as table functions over whole files.

Python is parsed by the standard library. Rust is read by a lexical scanner:
it knows strings, raw strings, characters, lifetimes, nested comments and
brackets, and recognises items by their leading keywords. It accepts any file
whose brackets and literals are well formed, so it is more lenient than a
parser, and does not look into macros.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

#: The Python nodes that are recorded.
PYTHON_NODES = [
    "FunctionDef", "AsyncFunctionDef", "ClassDef", "Import", "ImportFrom", "Assign", "If",
    "For", "AsyncFor", "While", "With", "AsyncWith", "Try", "Match",
]
USE_CHARS = 100

NODE = T.StructType(
    [
        T.StructField("node_type", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("span", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("params", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType())]))),
        T.StructField("return_type", T.StringType()),
    ]
)
_ARROW_NODES = pa.list_(
    pa.struct(
        [(n, pa.string()) for n in ("node_type", "name", "span", "body")]
        + [("params", pa.list_(pa.struct([("name", pa.string()), ("type", pa.string())]))), ("return_type", pa.string())]
    )
)
Node = tuple[str, str | None, str, str | None, list[tuple[str, str]] | None, str | None]


def python_nodes(code: str) -> list[Node] | None:
    """Recorded nodes in the order of a depth-first walk; None if the file does not parse."""
    try:
        stack: list[ast.AST] = [ast.parse(code)]
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    out: list[Node] = []
    while stack:
        node = stack.pop()
        kind = type(node).__name__
        if kind in PYTHON_NODES and getattr(node, "lineno", None) and getattr(node, "end_lineno", None):
            out.append((kind, None, f"{node.lineno}:{node.end_lineno}", None, None, None))
        stack.extend(reversed(list(ast.iter_child_nodes(node))))
    return out


class RustSyntaxError(ValueError):
    pass


@dataclass(slots=True)
class _Token:
    kind: str  # word, literal, lifetime, punct, doc
    text: str
    line: int
    end_line: int


_WORD = re.compile(r"(?:r#)?[A-Za-z_\u0080-\U0010ffff][\w]*")
_NUMBER = re.compile(r"\d[\w]*(?:\.\d[\w]*)?(?:(?<=[eE])[+-]\d+)?")
_RAW = re.compile(r'(?:b|c)?r(#*)"')
_CHAR = re.compile(r"b?'(?:\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.)|[^\\'\n])'", re.S)
_STRING = re.compile(r'(?:b|c)?"(?:[^"\\]|\\.)*"', re.S)
_LIFETIME = re.compile(r"'[A-Za-z_]\w*")
_PUNCT = ["<<=", ">>=", "...", "..=", "::", "->", "=>", "==", "!=", "<=", ">=", "&&", "||", "+=", "-=", "*=", "/=", "%=", "^=", "&=", "|=", "<<", ".."]
_CLOSE = {"(": ")", "[": "]", "{": "}"}


def _comment_end(code: str, at: int) -> int:
    depth, i = 0, at
    for m in re.compile(r"/\*|\*/").finditer(code, at):
        depth += 1 if m[0] == "/*" else -1
        i = m.end()
        if not depth:
            return i
    raise RustSyntaxError("unterminated comment")


def rust_tokens(code: str) -> list[_Token]:
    """Tokens without plain comments; outer documentation comments stay, as they belong to items."""
    out, i, line, n = [], 0, 1, len(code)

    def add(kind: str, end: int) -> None:
        nonlocal i, line
        text = code[i:end]
        lines = text.count("\n")
        out.append(_Token(kind, text, line, line + lines))
        line += lines
        i = end

    while i < n:
        c = code[i]
        if c == "\n":
            line += 1
            i += 1
        elif c.isspace() or c == "﻿":
            i += 1
        elif code.startswith("//", i):
            end = code.find("\n", i)
            end = n if end < 0 else end
            if code.startswith("///", i) and not code.startswith("////", i):
                add("doc", end)
            i = end
        elif code.startswith("/*", i):
            end = _comment_end(code, i)
            if code.startswith("/**", i) and not code.startswith(("/***", "/**/"), i):
                add("doc", end)
            else:
                line += code.count("\n", i, end)
                i = end
        elif m := _RAW.match(code, i):
            end = code.find('"' + m[1], m.end())
            if end < 0:
                raise RustSyntaxError("unterminated raw string")
            add("literal", end + 1 + len(m[1]))
        elif m := _STRING.match(code, i) or _CHAR.match(code, i):
            add("literal", m.end())
        elif m := _LIFETIME.match(code, i):
            add("lifetime", m.end())
        elif c in "\"'":
            raise RustSyntaxError("unterminated literal")
        elif m := _WORD.match(code, i):
            add("word", m.end())
        elif m := _NUMBER.match(code, i):
            add("literal", m.end())
        else:
            add("punct", i + next((len(p) for p in _PUNCT if code.startswith(p, i)), 1))
    return out


class _Items:
    """Walks a token list and records items."""

    def __init__(self, tokens: list[_Token]):
        self.tokens = tokens
        self.match: dict[int, int] = {}
        self.out: list[Node] = []
        stack: list[int] = []
        for k, t in enumerate(tokens):
            if t.kind == "punct" and t.text in _CLOSE:
                stack.append(k)
            elif t.kind == "punct" and t.text in _CLOSE.values():
                if not stack or _CLOSE[tokens[stack[-1]].text] != t.text:
                    raise RustSyntaxError("unbalanced brackets")
                self.match[stack.pop()] = k
        if stack:
            raise RustSyntaxError("unbalanced brackets")

    def text(self, low: int, high: int) -> str:
        return " ".join(t.text for t in self.tokens[low:high] if t.kind != "doc")

    def is_(self, k: int, *texts: str) -> bool:
        return k < len(self.tokens) and self.tokens[k].kind in ("word", "punct") and self.tokens[k].text in texts

    def seek(self, k: int, high: int, *texts: str) -> int:
        """First of the texts from k on, outside brackets; ``high`` if there is none."""
        while k < high:
            if self.is_(k, *texts):
                return k
            k = self.match.get(k, k) + 1
        return high

    def skip_generics(self, k: int) -> int:
        if not self.is_(k, "<"):
            return k
        depth = 0
        while k < len(self.tokens):
            t = self.tokens[k]
            if t.kind == "punct":
                depth += {"<": 1, "<<": 2, ">": -1, ">>": -2}.get(t.text, 0)
                if depth <= 0:
                    return k + 1
            k = self.match.get(k, k) + 1
        raise RustSyntaxError("unterminated generics")

    def body_at(self, k: int, high: int) -> int:
        """Where an item's braces or its semicolon stand; braces inside generics don't count."""
        while k < high:
            if self.is_(k, "<"):
                k = self.skip_generics(k)
            elif self.is_(k, "{", ";"):
                return k
            else:
                k = self.match.get(k, k) + 1
        return high

    def add(self, kind: str, name: str, low: int, high: int) -> None:
        self.out.append((kind, name, f"{self.tokens[low].line}:{self.tokens[high].end_line}", None, None, None))

    def walk(self, low: int, high: int) -> None:
        """Items among tokens low to high, at any depth: an item starts where a statement could."""
        k = low
        while k < high:
            starts = k == low or self.is_(k - 1, "{", "}", ";") or self.tokens[k].kind == "doc" or self.is_(k, "#")
            done = self.item(k, high) if starts else None
            k = done if done is not None else k + 1

    def item(self, start: int, high: int, inside_impl: bool = False) -> int | None:
        """Record the item that starts here and those within it; the place after it, or None."""
        k = start
        while k < high and (self.tokens[k].kind == "doc" or self.is_(k, "#")):
            if self.is_(k, "#") and self.is_(k + 1, "!"):
                return self.match.get(k + 2, k + 2) + 1 if not self.is_(start, "#") or start == k else None
            k = k + 1 if self.tokens[k].kind == "doc" else self.match.get(k + 1, k) + 1
        if self.is_(k, "pub"):
            k += 1
            if self.is_(k, "("):
                k = self.match[k] + 1
        key = k
        while self.is_(key, "default", "const", "async", "unsafe", "extern") or (
            key > k and self.is_(key - 1, "extern") and key < high and self.tokens[key].kind == "literal"
        ):
            key += 1
        if self.is_(key, "fn"):
            return self.function(key, high)
        if self.is_(k, "unsafe") and self.is_(k + 1, "impl", "trait"):
            k += 1
        word = self.tokens[k].text if k < high and self.tokens[k].kind == "word" else ""
        if word == "macro_rules" and self.is_(k + 1, "!"):
            return self.match.get(self.seek(k, high, "{", "(", "["), high) + 1
        named = k + 1 < high and self.tokens[k + 1].kind == "word"
        if word in ("mod", "struct", "enum", "trait", "type") and named:
            at = self.body_at(k + 2, high) if word != "type" else self.seek(k, high, ";")
            if at >= high:
                return None
            end = self.match.get(at, at)
            if word == "struct" and self.is_(end + 1, ";") and self.is_(at, "("):
                end += 1
            kind = {"type": "Other"}.get(word, word.capitalize())
            self.add(kind, self.tokens[k + 1].text, start, end)
            if at in self.match and word == "mod":
                self.walk(at + 1, end)
            elif at in self.match and word == "trait":  # items within its methods, not the methods
                self.out += self.members(at + 1, end)[1]
            return end + 1
        if word in ("const", "static") and not self.is_(k + 1, "{", "|", "||", "move"):
            at = self.seek(k, high, ";")
            name = k + 2 if self.is_(k + 1, "mut") else k + 1
            if at >= high or not self.is_(name + 1, ":") or inside_impl:
                return None if not inside_impl else min(at, high - 1) + 1
            self.add("Const", self.tokens[name].text, start, at)
            self.walk(name, at)
            return at + 1
        if word == "use":
            at = self.seek(k, high, ";")
            if at >= high:
                return None
            self.add("Use", self.text(start, at + 1)[:USE_CHARS], start, at)
            return at + 1
        if word == "impl":
            return self.implementation(start, k, high)
        return None

    def implementation(self, start: int, k: int, high: int) -> int | None:
        first = self.skip_generics(k + 1)
        at = self.body_at(first, high)
        if at >= high or not self.is_(at, "{"):
            return None
        end = self.match[at]
        stop = self.seek(first, at, "where")
        over = self.seek(first, stop, "for")
        self.add("Impl", self.text(over + 1 if over < stop else first, stop), start, end)
        methods, nested = self.members(at + 1, end)
        self.out += methods + nested
        return end + 1

    def members(self, k: int, end: int) -> tuple[list[Node], list[Node]]:
        """Methods among the members of an implementation or trait, and the items within their bodies."""
        methods: list[Node] = []
        nested: list[Node] = []
        before = len(self.out)
        while k < end:
            done = self.item(k, end, inside_impl=True)
            if done is not None:
                made = self.out[before:]
                del self.out[before:]
                if made and made[0][0] == "Function":
                    methods += made[:1]
                    nested += made[1:]
                k = done
            else:
                k = self.match.get(k, k) + 1
        return methods, nested

    def function(self, k: int, high: int) -> int | None:
        name = self.tokens[k + 1].text if k + 1 < high else ""
        at = self.skip_generics(k + 2)
        if not self.is_(at, "("):
            return None
        close = self.match[at]
        body = self.body_at(close + 1, high)
        if body >= high:
            return None
        if self.is_(body, ";"):  # a signature, as in traits
            return body + 1
        end = self.match[body]
        stop = self.seek(close + 1, body, "where")
        returns = self.text(close + 2, stop) if self.is_(close + 1, "->") else "()"
        inner = self.text(body + 1, end)
        span = f"{self.tokens[k].line}:{self.tokens[end].end_line}"
        self.out.append(("Function", name, span, f"{{ {inner} }}", self.parameters(at + 1, close), returns))
        self.walk(body + 1, end)
        return end + 1

    def parameters(self, low: int, high: int) -> list[tuple[str, str]]:
        parts, start, k = [], low, low
        while k <= high:
            if k == high or self.is_(k, ","):
                if k > start:
                    parts.append((start, k))
                start = k + 1
                k += 1
            elif self.is_(k, "<"):
                k = self.skip_generics(k)
            else:
                k = self.match.get(k, k) + 1
        out = []
        for a, b in parts:
            while self.is_(a, "#"):
                a = self.match.get(a + 1, a) + 1
            colon = self.seek(a, b, ":")
            if self.is_(a, "self") or any(self.is_(x, "self") for x in range(a, min(colon, b))) and colon == b:
                out.append(("self", self.text(a, b)))
            else:
                out.append((self.text(a, colon), self.text(colon + 1, b)))
        return out


def rust_nodes(code: str) -> list[Node] | None:
    """Items in visiting order; None if brackets or literals are malformed."""
    try:
        items = _Items(rust_tokens(code))
        items.walk(0, len(items.tokens))
    except (RustSyntaxError, RecursionError):
        return None
    return items.out


PARSERS = {"python": python_nodes, "rust": rust_nodes}


def extract_nodes(files: DataFrame, language: str, alias_functions: bool = False) -> DataFrame:
    """``path, code, nodes`` of the files that parse and have at least one node.

    ``alias_functions`` names Python functions ``Function``, as Rust's are;
    they have no body, so they still give no body blocks.
    """
    parse = PARSERS[language]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(code) if code is not None else None for code in batch.column(1).to_pylist()]
            if alias_functions:
                found = [f and [("Function", *x[1:]) if x[0] == "FunctionDef" else x for x in f] for f in found]
            rows = [[dict(zip(NODE.names, x)) | {"params": x[4] and [{"name": a, "type": b} for a, b in x[4]]} for x in f] for f in found if f]
            kept = batch.filter(pa.array([bool(f) for f in found], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(rows, _ARROW_NODES)], ["path", "code", "nodes"])

    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("code", T.StringType()), T.StructField("nodes", T.ArrayType(NODE))])
    return files.select("path", "code").mapInArrow(run, schema)


def explode_nodes(parsed: DataFrame) -> DataFrame:
    """``path, ord, node_type, name, span, body, params, return_type``."""
    return parsed.select("path", F.posexplode("nodes").alias("ord", "node")).select("path", "ord", "node.*")


def register_udtfs(spark: SparkSession) -> None:
    """SQL table functions ``python_ast_nodes(code)`` and ``rust_items(code)``."""

    class PythonNodes:
        def eval(self, code: str):
            for x in python_nodes(code or "") or ():
                yield x[0], x[2]

    class RustItems:
        def eval(self, code: str):
            for x in rust_nodes(code or "") or ():
                yield x[0], x[1], x[2], x[3], x[5]

    spark.udtf.register("python_ast_nodes", udtf(PythonNodes, returnType="node_type: string, span: string"))
    spark.udtf.register("rust_items", udtf(RustItems, returnType="node_type: string, name: string, span: string, body: string, return_type: string"))
