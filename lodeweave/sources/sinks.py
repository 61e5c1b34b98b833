"""Artifacts of a graph as text and JSON lines, published only where they changed."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.functions import paths
from lodeweave.operators.graph import rendered

TEXT = ("index.txt", "graph.txt", "modules")
JSONL = ("symbols.jsonl", "edges.jsonl", "manifest.json")
#: Written with either format.
INDEXES = ("nav-index.json", "search-index.json")
FORMATS = ("text", "jsonl")


def file_sections(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Return ``(file, section)``: the text of each file with symbols, in order of line and id."""
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("src")), ", ").alias("called_by"))
    joined = symbols.join(rendered(edges).withColumnRenamed("src", "id"), "id", "left").join(into, "id", "left")
    part = lambda head, c, tail="\n": F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(F.concat(F.lit(head), c, F.lit(tail)))
    entry = F.concat(
        F.lit("\n### "), F.col("name"), F.lit(" ["), F.col("kind"), F.lit("]\nsig: "), F.coalesce("signature", F.lit("")), F.lit("\n"),
        part("doc: ", F.col("doc")), part("calls: [", F.col("targets"), "]\n"), part("called_by: [", F.col("called_by"), "]\n"),
    )
    grouped = joined.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("line", "id", entry.alias("text")))).alias("entries"))
    listed = files.select(F.col("path").alias("file"), part("imports: [", F.array_join(F.sort_array("imports"), ", "), "]\n").alias("head"))
    body = F.array_join(F.transform("entries", lambda e: e["text"]), "")
    return grouped.join(listed, "file", "left").select("file", F.concat(F.lit("## "), "file", F.lit("\n"), F.coalesce("head", F.lit("")), body, F.lit("\n")).alias("section"))


def module_texts(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Return ``(module, text)``: the sections of each top directory's files, by path."""
    sections = file_sections(files, symbols, edges).withColumn("module", paths.module_of(F.col("file")))
    ordered = F.sort_array(F.collect_list(F.struct("file", "section")))
    return sections.groupBy("module").agg(ordered.alias("s")).select("module", F.concat(F.lit("# Module: "), "module", F.lit("\n\n"), F.array_join(F.transform("s", lambda x: x["section"]), "")).alias("text"))


def graph_lines(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Return ``(file, line, id, text)``: the edges of each symbol that has some."""
    return rendered(edges).withColumnRenamed("src", "id").join(symbols.select("id", "file", "line"), "id").select("file", "line", "id", F.format_string("%s -> [%s]", "id", "targets").alias("text"))


def index_lines(symbols: DataFrame, ranks: DataFrame, most: int = 20) -> DataFrame:
    """Return ``(part, order, text)`` of the overview: the most important symbols, then files with their numbers of symbols."""
    from lodeweave.operators.graph import top_nodes

    best = top_nodes(ranks, most).join(symbols, "id").select(F.lit(0).alias("part"), F.struct((-F.col("rank")).alias("a"), F.col("id").alias("b")).alias("order"), F.concat(F.lit("- "), "id", F.lit(" ["), "kind", F.lit("] "), F.coalesce("signature", F.lit(""))).alias("text"))
    files = symbols.groupBy("file").agg(F.count(F.lit(1)).alias("n")).select(F.lit(1).alias("part"), F.struct(F.lit(0.0).alias("a"), F.col("file").alias("b")).alias("order"), F.format_string("- %s (%d symbols)", "file", "n").alias("text"))
    return best.unionByName(files)


def symbol_json(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Return ``(file, line, id, json)``; empty signatures and docs have no field."""
    known = files.select(F.col("path").alias("file"), "language")
    some = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    return symbols.join(known, "file", "left").select("file", "line", "id", F.to_json(F.struct("id", "name", "kind", some("signature"), "file", F.coalesce("language", F.lit("")).alias("language"), "line", some("doc"))).alias("json"))


def edge_json(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Return ``(file, line, id, dst, json)`` for each edge."""
    confidence = F.coalesce(F.nullif("confidence", F.lit("")), F.lit("heuristic"))
    return edges.join(symbols.select(F.col("id").alias("src"), "file", "line"), "src").select("file", "line", F.col("src").alias("id"), "dst", F.to_json(F.struct(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), confidence.alias("confidence"))).alias("json"))


def navigation_json(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Return ``(id, json)``: each symbol with its edges out and in, and the confidences of those out."""
    confidence = F.coalesce(F.nullif("confidence", F.lit("")), F.lit("heuristic"))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("dst").alias("target_id"), confidence.alias("confidence")))).alias("o"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("src")).alias("i"))
    joined = symbols.join(out, "id", "left").join(into, "id", "left")
    targets = F.coalesce("o", F.array().cast("array<struct<target_id: string, confidence: string>>"))
    fields = F.struct("id", "name", "kind", "signature", "file", "line", F.transform(targets, lambda x: x["target_id"]).alias("out_edges"), F.coalesce("i", F.array().cast("array<string>")).alias("in_edges"), targets.alias("out_confidence"))
    return joined.select("id", F.to_json(fields).alias("json"))


def search_json(symbols: DataFrame, postings: DataFrame) -> DataFrame:
    """Return ``(id, json)``: each indexed symbol with its length and the weights of its terms."""
    some = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    terms = postings.groupBy("id", "length").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "tf")))).alias("terms"))
    return symbols.join(terms, "id").select("id", F.to_json(F.struct("id", "name", "kind", some("signature"), "file", "line", some("doc"), "length", "terms")).alias("json"))


def write_indexes(folder: str, symbols: DataFrame, edges: DataFrame, postings: DataFrame, terms: DataFrame, stats: DataFrame) -> dict[str, bool]:
    """Write the navigation and the search index as JSON documents, an entry a line, in order of id; return for each whether it changed."""

    def items(df: DataFrame, mark: bytes = b"[]") -> Iterator[bytes]:
        yield mark[:1]
        for k, row in enumerate(df.toLocalIterator()):
            yield (",\n" if k else "\n").encode() + row[0].encode()
        yield b"\n" + mark[1:]

    def navigation() -> Iterator[bytes]:
        yield b'{"version":"nav-index-v1","nodes":'
        yield from items(navigation_json(symbols, edges).orderBy("id").select("json"))
        yield b"}\n"

    def search() -> Iterator[bytes]:
        n, mean = stats.select("n", F.coalesce("avgdl", F.lit(0.0))).first()
        yield f'{{"version":"search-index-v1","document_count":{n},"avg_doc_length":{json.dumps(mean)},"doc_freq":'.encode()
        yield from items(terms.orderBy("term").select(F.concat(F.lit('"'), "term", F.lit('":'), "df")), b"{}")
        yield b',"documents":'
        yield from items(search_json(symbols, postings).orderBy("id").select("json"))
        yield b"}\n"

    return {name: publish(f"{folder}/{name}", rows()) for name, rows in zip(INDEXES, (navigation, search), strict=True)}


def short_hash(data: bytes) -> str:
    """Return the first 16 hex digits of the SHA-256."""
    return hashlib.sha256(data).hexdigest()[:16]


def publish(path: str, data: bytes | Iterable[bytes]) -> bool:
    """Write a file if its bytes changed, whole or not at all; tell whether they did. Pieces are written as they come, none is kept."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    digest = hashlib.sha256()
    with open(path + ".new", "wb") as f:
        for piece in (data,) if isinstance(data, bytes) else data:
            digest.update(piece)
            f.write(piece)
    if os.path.exists(path):
        with open(path, "rb") as f:
            if hashlib.file_digest(f, "sha256").digest() == digest.digest():
                os.remove(path + ".new")
                return False
    os.replace(path + ".new", path)
    return True


def _lines(df: DataFrame, column: str) -> Iterator[bytes]:
    """Yield lines, a partition at a time."""
    for row in df.select(column).toLocalIterator():
        yield (row[0] + "\n").encode()


def write_text(folder: str, files: DataFrame, symbols: DataFrame, edges: DataFrame, ranks: Callable[[], DataFrame], pool: ThreadPoolExecutor) -> dict[str, bool]:
    """Write index, adjacency and a file for each module, side by side; return for each artifact whether it changed. Files of modules that are gone go."""

    def index() -> Iterator[bytes]:
        yield b"# Code index\n\n## Key symbols (by importance)\n\n"
        files = False
        for r in index_lines(symbols, ranks()).orderBy("part", "order").toLocalIterator():
            if r.part and not files:
                files = True
                yield b"\n## Files\n\n"
            yield (r.text + "\n").encode()
        if not files:
            yield b"\n## Files\n\n"

    def adjacency() -> Iterator[bytes]:
        yield b"# Call graph: source -> [targets]\n\n"
        yield from _lines(graph_lines(symbols, edges).orderBy("file", "line", "id"), "text")

    def modules() -> dict[str, bool]:
        out = {}
        for r in module_texts(files, symbols, edges).toLocalIterator():
            name = r.module.replace("/", "_") + ".txt"
            out[f"modules/{name}"] = publish(f"{folder}/modules/{name}", r.text.encode())
        return out

    parts = {name: pool.submit(publish, f"{folder}/{name}", rows()) for name, rows in (("graph.txt", adjacency), ("index.txt", index))}
    out = modules() | {name: part.result() for name, part in parts.items()}
    if os.path.isdir(f"{folder}/modules"):
        for name in os.listdir(f"{folder}/modules"):
            if name.endswith(".txt") and f"modules/{name}" not in out:
                os.remove(f"{folder}/modules/{name}")
    _drop(folder, JSONL)
    return out


def write_jsonl(folder: str, files: DataFrame, symbols: DataFrame, edges: DataFrame, pool: ThreadPoolExecutor) -> dict[str, bool]:
    """Write symbols and edges as JSON lines and a manifest with counts and hashes; return for each artifact whether it changed."""
    rows = {"symbols.jsonl": symbol_json(symbols, files).orderBy("file", "line", "id"), "edges.jsonl": edge_json(symbols, edges).orderBy("file", "line", "id", "dst")}
    number = pool.submit(lambda: symbols.select("file").distinct().count())
    parts = {name: pool.submit(publish, f"{folder}/{name}", _lines(df, "json")) for name, df in rows.items()}
    out = {name: part.result() for name, part in parts.items()}
    counts, artifacts = {"files": number.result()}, []
    for name in rows:
        with open(f"{folder}/{name}", "rb") as f:
            counts[name.partition(".")[0]] = sum(1 for _ in f)
        with open(f"{folder}/{name}", "rb") as f:
            artifacts.append({"path": name, "hash": hashlib.file_digest(f, "sha256").hexdigest()[:16]})
    manifest = {"schema_version": "jsonl-v1", "format": "jsonl", "counts": counts, "artifacts": artifacts}
    out["manifest.json"] = publish(f"{folder}/manifest.json", (json.dumps(manifest, indent=2) + "\n").encode())
    _drop(folder, TEXT)
    return out


def _drop(folder: str, names: tuple[str, ...]) -> None:
    import shutil

    for name in names:
        path = f"{folder}/{name}"
        if os.path.isdir(path):
            shutil.rmtree(path)
        elif os.path.exists(path):
            os.remove(path)


def present_format(folder: str) -> str:
    """Tell which artifacts exist: text, jsonl, mixed or none."""
    text, lines = (any(os.path.exists(f"{folder}/{n}") for n in names) for names in (TEXT, JSONL))
    return "mixed" if text and lines else "text" if text else "jsonl" if lines else "none"


def checked_format(name: str | None) -> str:
    """Return a format's name; none means text, others are an error."""
    name = (name or "text").strip().lower()
    if name not in FORMATS:
        raise ValueError(f"unknown format: {name}")
    return name
