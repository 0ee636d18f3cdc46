"""Data source ``repo_files``: the source files below a folder that executors can read.

Spark's own file sources skip names that start with ``_`` or ``.``, which drops
``__init__.py`` and private packages; this one lists folders itself.

Options: ``path``; ``extensions`` (comma-separated, ``.py`` by default);
``rules`` - ``all`` (every matching file, hidden ones too) or ``ignore``
(skips hidden names and what ``.gitignore`` and ``.ignore`` files exclude, follows links);
``newlines`` - ``fold`` (CRLF and CR become LF) or ``keep``;
``filesPerPartition``. Files that can't be read or are not UTF-8 are left out.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def ignore_pattern(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """(pattern for paths relative to the file's folder, negated, folders only) of a line of an ignore file."""
    line = line.rstrip("\n\r")
    if not line.endswith("\\ "):
        line = line.rstrip(" ")
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated or line.startswith("\\") else line
    folder = line.endswith("/")
    line = line.rstrip("/")
    rooted = "/" in line
    out, i = "", 0
    line = line.lstrip("/")
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out, i = out + "/.+", i + 3
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and (end := line.find("]", i + 2)) > 0:
            inner = line[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        else:
            out, i = out + re.escape(line[i]), i + 1
    return re.compile(("" if rooted else "(?:.*/)?") + out), negated, folder


def list_files(root: str, extensions: list[str], rules: str = "all") -> list[str]:
    """Matching files below ``root``, sorted; one entry for each extension that a name ends with."""
    found: list[str] = []
    seen: set[str] = set()

    def ignored(path: str, is_dir: bool, active: list) -> bool:
        verdict = False
        for base, pattern, negated, folder in active:
            if (is_dir or not folder) and pattern.fullmatch(os.path.relpath(path, base).replace(os.sep, "/")):
                verdict = not negated
        return verdict

    def walk(folder: str, active: list) -> None:
        if rules == "ignore":
            real = os.path.realpath(folder)
            if real in seen:
                return
            seen.add(real)
            for name in (".gitignore", ".ignore"):
                try:
                    with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                        active = active + [(folder, *p) for p in map(ignore_pattern, f) if p]
                except OSError:
                    pass
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            is_dir = e.is_dir(follow_symlinks=rules == "ignore")
            if rules == "ignore" and (e.name.startswith(".") or ignored(e.path, is_dir, active)):
                continue
            if is_dir:
                walk(e.path, active)
            elif e.is_file():
                found.extend([e.path] * sum(e.name.endswith(x) for x in extensions))

    walk(root, [])
    return found


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.extensions = [x.strip() for x in options.get("extensions", ".py").split(",")]
        self.rules = options.get("rules", "all")
        self.fold = options.get("newlines", "fold") == "fold"
        self.each = int(options.get("filespartition", options.get("filesperpartition", "200")))
        if self.rules not in ("all", "ignore"):
            raise ValueError(f"unknown rules: {self.rules}")

    def partitions(self) -> list[_Files]:
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)
        paths = list_files(self.root, self.extensions, self.rules)
        return [_Files(paths[i : i + self.each]) for i in range(0, len(paths), self.each)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple[str, str]]:
        for path in partition.paths:
            try:
                with open(path, "rb") as f:
                    code = f.read().decode("utf-8")
            except (OSError, UnicodeDecodeError):
                continue
            yield os.path.relpath(path, self.root), code.replace("\r\n", "\n").replace("\r", "\n") if self.fold else code


class RepoFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repo_files"

    def schema(self) -> str:
        return "path string, code string"

    def reader(self, schema) -> _Reader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RepoFiles)
