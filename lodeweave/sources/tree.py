"""Source trees: a walk on the driver, reading and parsing on executors.

Spark's file sources skip names that begin with a dot or an underscore, so paths
are listed here and files are opened by the tasks that parse them. The driver
holds paths and sizes, never contents.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions.paths import EXTENSIONS
from lodeweave.sources import ignore
from lodeweave.storage import spread

#: Bytes of source that one task reads, about.
TASK_BYTES = 16 << 20
CALL = "struct<name: string, qualifier: string, receiver: string, arity: int, line: int, raw: string>"
SYMBOL = f"struct<name: string, kind: string, signature: string, line: int, doc: string, calls: array<{CALL}>>"
FILES = f"path string, language string, hash string, content string, imports array<string>, import_aliases map<string, string>, symbols array<{SYMBOL}>, issue string"


def language_for(path: str, languages: list[str] | None = None) -> str | None:
    """Return the language of a path, if it's one of the wanted ones."""
    ext = os.path.splitext(path)[1]
    found = EXTENSIONS.get(ext.lower())
    if found in ("typescript", "javascript"):
        found = "javascript" if ext in (".js", ".jsx", ".mjs", ".cjs") else "typescript"
    return found if languages is None or found in languages else None


def listed(root: str, rules: tuple[ignore.Rule, ...] | None = None, languages: list[str] | None = None, strict: bool = False) -> tuple[list[tuple[str, str, int]], list[str]]:
    """Return ``(path, language, size)`` of the files that a walk finds, sorted, and what couldn't be listed (an error if ``strict``)."""
    rules = ignore.parse(ignore.read(os.path.join(root, ".lodeweaveignore"))) if rules is None else rules
    found: list[tuple[str, str, int]] = []
    issues: list[str] = []

    def failed(error: OSError) -> None:
        if strict:
            raise error
        issues.append(str(error))

    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    for folder, subfolders, names in os.walk(root, onerror=failed):
        at = os.path.relpath(folder, root).replace(os.sep, "/")
        rel = lambda name, at=at: name if at == "." else f"{at}/{name}"
        subfolders[:] = [d for d in subfolders if not ignore.leaves_out(rules, rel(d), True)]
        for name in names:
            path = rel(name)
            language = language_for(path, languages)
            if language and not ignore.leaves_out(rules, path, False):
                try:
                    found.append((path, language, os.path.getsize(os.path.join(folder, name))))
                except OSError as error:
                    failed(error)
    return sorted(found), issues


def _spread(spark: SparkSession, found: list[tuple[str, str, int]]) -> DataFrame:
    slots = max(1, min(len(found), 1 + sum(size for _, _, size in found) // TASK_BYTES))
    rows = spark.createDataFrame([(p, lang) for p, lang, _ in found], "path string, language string")
    return rows.repartition(slots, "path")


def digest(path: str) -> str:
    """Return the first 16 hex digits of the SHA-256 of a file."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()[:16]


def hashes(spark: SparkSession, root: str, found: list[tuple[str, str, int]]) -> DataFrame:
    """Return ``(path, hash)``: contents are read by tasks and only hashed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "hash": [digest(os.path.join(root, path)) for path in frame["path"]]})

    return _spread(spark, found).mapInPandas(run, "path string, hash string")


_COLUMNS = ["path", "language", "hash", "content", "imports", "import_aliases", "symbols", "issue"]


def _parsed_row(path: str, language: str, content: bytes) -> tuple:
    from lodeweave.sources.extract import extract

    got = extract(language, path, content)
    return (path, language, hashlib.sha256(content).hexdigest()[:16], content.decode("utf-8", "replace"), got.imports, got.aliases, [vars(x) | {"calls": [vars(c) for c in x.calls]} for x in got.symbols], got.issue)


def parsed(spark: SparkSession, root: str, found: list[tuple[str, str, int]]) -> DataFrame:
    """Return a row of ``FILES`` for each file: what it holds, or the issue."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, language in zip(frame["path"], frame["language"], strict=True):
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        rows.append(_parsed_row(path, language, f.read()))
                except OSError as error:
                    rows.append((path, language, None, None, [], {}, [], str(error)))
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return _spread(spark, found).mapInPandas(run, FILES)


def parsed_table(sources: DataFrame) -> DataFrame:
    """Return a row of ``FILES`` for each row of ``sources(path, content)`` with a language: for source files that lie in a table.

    Parsing takes far longer than reading, and a small file may hold very many
    rows, so these are spread first, over as many tasks as Spark shuffles to
    (by their bytes it would take few). A null content is empty.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([_parsed_row(p, lang, bytes(c)) for p, lang, c in zip(frame["path"], frame["language"], frame["content"], strict=True)], columns=_COLUMNS)

    from lodeweave.functions.paths import language_of

    rows = sources.select("path", language_of(F.col("path")).alias("language"), F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content")).where("language is not null")
    return spread(rows, "path").mapInPandas(run, FILES)


def normalized(files: DataFrame) -> DataFrame:
    """Return parsed files with imports and aliases in order."""
    from lodeweave.functions.text import alias_map, string_set

    return files.withColumns({"imports": string_set(F.col("imports")), "import_aliases": alias_map(F.col("import_aliases"))})


def symbol_table(files: DataFrame) -> DataFrame:
    """Return ``symbols(id, file, module, name, kind, line, signature, doc, pos, calls)``; of symbols with one id the last in its file stays."""
    from lodeweave.functions.ids import symbol_id
    from lodeweave.functions.paths import module_of
    from lodeweave.operators.normalize import call_list

    spread = files.select(F.col("path").alias("file"), F.posexplode("symbols").alias("pos", "s"))
    sid = symbol_id(F.col("file"), F.col("s.line"), F.col("s.kind"), F.col("s.name"), F.col("s.signature"))
    flat = spread.select(sid.alias("id"), "file", module_of(F.col("file")).alias("module"), "s.name", "s.kind", "s.line", "s.signature", "s.doc", "pos", call_list(F.col("s.calls")).alias("calls"))
    return flat.groupBy("id").agg(F.max_by(F.struct(*flat.columns[1:]), "pos").alias("r")).select("id", "r.*")


def call_table(symbols: DataFrame) -> DataFrame:
    """Return the calls of symbols as :mod:`lodeweave.operators.resolve` wants them, with their places."""
    spread = symbols.select(F.col("id").alias("src_id"), F.col("file").alias("src_file"), F.col("module").alias("src_module"), F.col("kind").alias("src_kind"), F.col("pos").alias("sym_pos"), F.posexplode("calls").alias("call_pos", "c"))
    return spread.select("src_id", "src_file", "src_module", "src_kind", "sym_pos", "call_pos", "c.*")
