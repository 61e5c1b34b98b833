"""The engine as users see it: build and refresh a code graph, and ask it.

Tables live as Parquet in versioned folders under ``<root>/.lodeweave/state``; a
pointer file names the current one and is swapped last, so readers never see a
half-written state. Text and JSON artifacts go to ``<root>/.lodeweave/context``.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions import ids, paths, text
from lodeweave.operators import annotations, graph, imports, locate, resolve, search, snapshots
from lodeweave.sources import ignore, servers, sinks, tree

#: Versions of the extractors and of what is written; another one than a state's asks for a full build.
VERSIONS = {"state": "2", "extract": "1", "output": "1"}
#: Files and bytes up to which a tree is hashed on the driver to see whether anything changed.
SMALL_FILES, SMALL_BYTES = 10_000, 64 << 20
RECORD = ("id", "name", "kind", "signature", "file", "line")


class NotFound(LookupError):
    """No symbol is meant."""


class Ambiguous(LookupError):
    """Several symbols are meant."""


def exact(symbols: DataFrame, query: str) -> DataFrame:
    """Return the symbol with an id, or else all with a name."""
    by_id = symbols.where(F.col("id") == query)
    by_name = symbols.where(F.col("name") == query)
    return by_id.unionByName(by_name.join(by_id.select(F.lit(1).alias("__one")).limit(1), F.lit(True), "left_anti"))


@dataclass
class Summary:
    """Counts of a run, and why files were affected."""

    scanned: int = 0
    parsed: int = 0
    reused: int = 0
    rewritten: int = 0
    changed: list[str] = field(default_factory=list)
    deleted: list[str] = field(default_factory=list)
    reasons: dict[str, list[str]] = field(default_factory=dict)
    issues: list[str] = field(default_factory=list)


def shown(names: list[str], most: int = 8, total: int | None = None) -> str:
    """Return names in a line, cut after some with the number of the others, of ``total`` if names are only the first ones."""
    rest = (len(names) if total is None else total) - most
    return ", ".join(sorted(names)[:most]) + (f", ... (+{rest} more)" if rest > 0 else "")


class Engine:
    """A code graph of one source tree.

    ``runner(server, action, file, line)`` may give a language server's output
    lines; without one only what was parsed answers.
    """

    def __init__(self, spark: SparkSession, root: str, runner: Callable[[str, str, str, int], list[str]] | None = None):
        self.spark, self.root, self.runner = spark, os.path.abspath(root), runner
        self.home = os.path.join(self.root, ".lodeweave")
        self.context = os.path.join(self.home, "context")

    # --- State

    def _pointer(self) -> dict | None:
        try:
            with open(f"{self.home}/state/current.json", encoding="utf-8") as f:
                found = json.load(f)
            if not isinstance(found, dict) or "folder" not in found:
                raise ValueError("no state in the pointer")
            if found.get("versions", {}).get("state", "1") in ("", "1"):
                found["versions"] = VERSIONS | {k: v for k, v in found.get("versions", {}).items() if v and k != "state"}
            return found
        except FileNotFoundError:
            return None

    def table(self, name: str, session: SparkSession | None = None) -> DataFrame:
        """Return a table of the current state: files, symbols, edges, ranks, aliases, dependencies."""
        pointer = self._pointer()
        if pointer is None:
            raise FileNotFoundError(f"{self.root} has no graph yet")
        return (session or self.spark).read.parquet(f"file://{self.home}/state/{pointer['folder']}/{name}")

    def _session(self, found: list[tuple[str, str, int]]) -> tuple[SparkSession, bool]:
        """Return the session in which to build from some files, and whether they are few.

        Sources that one task would read anyway are built by one task a table:
        with a single partition the same plans need no exchange.
        """
        if sum(size for _, _, size in found) > tree.TASK_BYTES or len(found) > SMALL_FILES:
            return self.spark, False
        one = self.spark.newSession()
        for key, value in {"shuffle.partitions": "1", "adaptive.enabled": "false", "autoBroadcastJoinThreshold": "-1"}.items():
            one.conf.set(f"spark.sql.{key}", value)
        return one, True

    def _publish(self, files: DataFrame, form: str, few: bool) -> dict[str, str]:
        """Write the state of parsed files and the artifacts; return the artifacts' hashes."""
        session, joined = files.sparkSession, (lambda df: df.coalesce(1)) if few else (lambda df: df)
        folder = uuid.uuid4().hex[:12]
        where = f"file://{self.home}/state/{folder}"

        def save(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{where}/{name}")
            return joined(session.read.schema(df.schema).parquet(f"{where}/{name}"))

        with ThreadPoolExecutor(12) as pool:  # jobs that don't need each other run side by side
            files = save(tree.normalized(joined(files)), "files")
            later = pool.submit(lambda: save(imports.aliases(files), "aliases"))
            known = pool.submit(self._remember, files, folder)
            symbols = save(tree.symbol_table(files), "symbols")
            index = search.build(symbols)
            jobs, stats = [pool.submit(save, index.names, "names")], pool.submit(save, index.stats, "stats")
            postings = pool.submit(save, index.postings, "postings")
            terms = pool.submit(lambda: save(search.term_table(postings.result()), "terms"))
            edges = save(resolve.resolve(symbols, tree.call_table(symbols), later.result()), "edges")
            jobs.append(pool.submit(save, graph.file_dependencies(edges, symbols), "dependencies"))
            ranks = pool.submit(lambda: save(graph.pagerank(symbols, edges), "ranks"))
            plain = symbols.drop("calls", "pos")
            jobs.append(pool.submit(lambda: sinks.write_indexes(self.context, plain, edges, postings.result(), terms.result(), stats.result())))
            if form == "text":
                sinks.write_text(self.context, files, plain, edges, ranks.result, pool)
            else:
                sinks.write_jsonl(self.context, files, plain, edges, pool)
            for job in (*jobs, ranks, known):
                job.result()
        hashes = {}
        for at, _, names in os.walk(self.context):
            for name in names:
                with open(os.path.join(at, name), "rb") as f:
                    hashes[os.path.relpath(os.path.join(at, name), self.context)] = sinks.short_hash(f.read())
        old = self._folder()
        pointer = {"folder": folder, "versions": VERSIONS, "format": form, "outputs": hashes}
        sinks.publish(f"{self.home}/state/current.json", json.dumps(pointer, indent=2, sort_keys=True).encode())
        if old:
            shutil.rmtree(f"{self.home}/state/{old}", ignore_errors=True)
        return hashes

    def _remember(self, files: DataFrame, folder: str) -> None:
        """Note the hashes of a small tree's files beside the state, so that a later update needs no job to see that nothing changed."""
        stale = (F.coalesce("language", F.lit("")) == "") & (F.size("symbols") == 0)
        rows = files.select("path", F.when(stale, F.lit("")).otherwise(F.col("hash")).alias("hash")).limit(SMALL_FILES + 1).collect()
        if len(rows) <= SMALL_FILES:
            sinks.publish(f"{self.home}/state/{folder}/hashes.json", json.dumps({r.path: r.hash for r in rows}).encode())

    def _folder(self) -> str | None:
        try:
            pointer = self._pointer()
        except ValueError:
            return None
        return pointer["folder"] if pointer else None

    def _rules(self) -> tuple[ignore.Rule, ...]:
        return ignore.parse(ignore.read(os.path.join(self.root, ".lodeweaveignore")))

    @staticmethod
    def _rewritten(before: dict[str, str], after: dict[str, str]) -> int:
        return sum(before.get(k, "") != after.get(k, "") for k in before.keys() | after.keys())

    # --- Building

    def generate(self, languages: list[str] | None = None, form: str | None = None) -> Summary:
        """Parse the whole tree and write the graph. Files that can't be read are reported, not fatal."""
        form = sinks.checked_format(form)
        found, issues = tree.listed(self.root, self._rules(), paths.language_set(languages))
        session, few = self._session(found)
        files = tree.parsed(session, self.root, found)
        try:
            before = (self._pointer() or {}).get("outputs", {})
        except ValueError:
            before = {}
        after = self._publish(files.where("hash is not null"), form, few)
        read, said = self.table("files", session).agg(F.count(F.lit(1)), F.sort_array(F.collect_list(F.nullif("issue", F.lit(""))))).first()
        return Summary(scanned=len(found), parsed=read, rewritten=self._rewritten(before, after), issues=issues + said)

    def _difference(self) -> tuple[list[str], list[str], list]:
        """Return the paths that changed and those that are gone, and the files found.

        A small tree is hashed here and held against the hashes noted with the
        state; a greater one is hashed by tasks and compared by a join.
        """
        found, _ = tree.listed(self.root, self._rules(), strict=True)
        path = f"{self.home}/state/{self._folder()}/hashes.json"
        if len(found) <= SMALL_FILES and sum(size for _, _, size in found) <= SMALL_BYTES and os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                old = json.load(f)
            now = {p: tree.digest(os.path.join(self.root, p)) for p, _, _ in found}
            return sorted(p for p, h in now.items() if old.get(p) != h), sorted(old.keys() - now.keys()), found
        now = tree.hashes(self.spark, self.root, found) if found else self.spark.createDataFrame([], "path string, hash string")
        stale = (F.coalesce("language", F.lit("")) == "") & (F.size("symbols") == 0)
        rows = snapshots.difference(self.table("files"), now, stale).collect()  # of what changed, which the summary lists
        return *(sorted(r.path for r in rows if (r.change == "deleted") == gone) for gone in (False, True)), found

    def _snapshot(self, files: DataFrame) -> DataFrame:
        own = self.table("dependencies", files.sparkSession).groupBy(F.col("src_file").alias("path")).agg(F.sort_array(F.collect_set("dst_file")).alias("deps"))
        return files.select("path", "hash").join(own, "path", "left").withColumn("deps", F.coalesce("deps", F.array().cast("array<string>")))

    def _impact(self, symbols: DataFrame, dependencies_of: DataFrame, changed: DataFrame, deleted: DataFrame) -> dict[str, list[str]]:
        calls = tree.call_table(symbols).select(F.col("src_file").alias("path"), "sym_pos", "call_pos", "name")
        names = symbols.select(F.col("file").alias("path"), "name")
        return {r.path: list(r.reasons) for r in snapshots.impact(self._snapshot(dependencies_of), names, calls, changed, deleted).collect()}

    def status(self) -> Summary:
        """Tell what an update would do, from what was known before the changes."""
        try:
            self._pointer()
        except ValueError:
            found, _ = tree.listed(self.root, self._rules())
            names = [p for p, _, _ in found]
            return Summary(scanned=len(found), parsed=len(found), changed=names, reasons={n: ["changed"] for n in names})
        old = self.table("files")
        changed, deleted, found = self._difference()
        frame = lambda names: self.spark.createDataFrame([(n,) for n in names], "path string")
        reasons = self._impact(self.table("symbols"), old, frame(changed), frame(deleted)) if changed or deleted else {}
        return Summary(len(found), len(changed), max(len(found) - len(changed), 0), 0, changed, deleted, reasons)

    def update(self, form: str | None = None) -> Summary:
        """Parse what changed, merge it, and write the graph anew; if nothing did, only artifacts that are missing."""
        try:
            pointer = self._pointer()
        except ValueError:
            return self.generate(form=form)
        if pointer is None or pointer.get("versions") != VERSIONS:
            return self.generate(form=form)
        form = sinks.checked_format(form or pointer.get("format"))
        changed, deleted, found = self._difference()
        before = pointer.get("outputs", {})
        if not changed and not deleted:
            missing = form != pointer.get("format") or not before or any(not os.path.exists(os.path.join(self.context, n)) for n in before)
            session, few = self._session(found)
            after = self._publish(self.table("files", session), form, few) if missing else before
            return Summary(len(found), 0, len(found), self._rewritten(before, after))
        session, few = self._session(found)
        old = self.table("files", session)
        wanted = set(changed)
        fresh = tree.parsed(session, self.root, [x for x in found if x[0] in wanted]).persist()
        bad = fresh.where("hash is null").select("issue").first()
        if bad is not None:
            raise OSError(bad.issue)
        gone = session.createDataFrame([(n,) for n in deleted], "path string")
        merged = snapshots.merge(old.withColumn("deps", F.array().cast("array<string>")), fresh, gone).drop("deps")
        symbols = tree.symbol_table(tree.normalized(merged))
        reasons = self._impact(symbols, merged.join(fresh.select("path"), "path", "left_anti").unionByName(fresh.limit(0)), fresh.select("path"), gone)
        after = self._publish(merged, form, few)
        fresh.unpersist()
        return Summary(len(found), len(changed), max(len(found) - len(changed), 0), self._rewritten(before, after), changed, deleted, reasons)

    def doctor(self) -> dict:
        """Tell whether the graph is there, whole and fresh, and what to do if not."""
        missing, suggestions = [], []
        if not os.path.isdir(self.home):
            missing.append(".lodeweave")
        form = sinks.present_format(self.context)
        try:
            pointer = self._pointer()
        except ValueError:
            pointer = None
            missing.append("state (unreadable)")
        if pointer is None:
            missing.append("state")
            suggestions.append("run generate")
        clean, suspicious = False, []
        if pointer is not None:
            missing += [n for n in pointer.get("outputs", {}) if not os.path.exists(os.path.join(self.context, n))]
            summary = self.status()
            clean = not summary.changed and not summary.deleted
            suspicious = sorted(r.path for r in self.table("files").where(paths.suspicious(F.col("path"))).select("path").collect())
            if not clean:
                suggestions.append("run update")
            if suspicious:
                suggestions.append("ignore " + shown(suspicious))
        present = servers.presence(p for p, _, _ in tree.listed(self.root, self._rules())[0])
        return {"servers": servers.capabilities(present), "format": form, "clean": clean, "missing": missing, "suspicious": len(suspicious), "suspicious_paths": suspicious[:8], "suggestions": suggestions, "healthy": clean and form != "none" and not missing}

    def has_sources(self) -> bool:
        """Tell whether there is a file to parse."""
        return bool(tree.listed(self.root, self._rules())[0])

    # --- Asking

    def _symbols(self) -> DataFrame:
        return self.table("symbols")

    def resolve_one(self, query: str) -> dict:
        """Return the record of the one symbol that a query means."""
        return self._only(exact(self._symbols().select(*RECORD), query), ["id"], query, lambda r: r.id).asDict()

    @staticmethod
    def _only(found: DataFrame, order: list[str], query: str, name: Callable[[Row], str], most: int = 5) -> Row:
        """Return the one row found; where there are more, some are named and all are counted."""
        rows = found.orderBy(*order).limit(most + 1).collect()
        if not rows:
            raise NotFound(query)
        if len(rows) > 1:
            raise Ambiguous(f"{query} matched {shown([name(r) for r in rows[:most]], most, len(rows) if len(rows) <= most else found.count())}")
        return rows[0]

    def symbol(self, query: str, fuzzy: bool = False, limit: int = search.LIMIT) -> DataFrame:
        """Return symbols by id or name, and, if ``fuzzy`` and there is none, by search."""
        limit = limit if limit > 0 else search.LIMIT
        hits = exact(self._symbols().select(*RECORD), query)
        if not fuzzy or not hits.isEmpty():
            return hits.orderBy("id").limit(limit)
        index = search.Index(*(self.table(n) for n in ("postings", "terms", "stats", "names")))
        asked = self.spark.createDataFrame([(0, query)], "query_id int, text string")
        found = search.search(index, asked, limit)
        return found.join(self._symbols().select(*RECORD), "id").orderBy("place").select(*RECORD, "score")

    def _near(self, query: str, incoming: bool) -> DataFrame:
        one = self.resolve_one(query)
        wanted = self.spark.createDataFrame([(one["id"],)], "id string")
        side = "src" if incoming else "dst"
        near = graph.neighbours(self.table("edges"), wanted, self._symbols().select(*RECORD), incoming)
        return near.select(F.col(side).alias("id"), *RECORD[1:], "confidence", F.lit("parser" if self.runner else "").alias("source")).orderBy("id")

    def callers(self, query: str) -> DataFrame:
        """Return what calls a symbol."""
        return self._near(query, True)

    def callees(self, query: str) -> DataFrame:
        """Return what a symbol calls."""
        return self._near(query, False)

    def trace(self, query: str, depth: int = 2) -> DataFrame:
        """Return calls up to ``depth`` steps from a symbol, by depth and ids."""
        start = self.spark.createDataFrame([(self.resolve_one(query)["id"],)], "id string")
        return graph.trace(self.table("edges"), start, depth).orderBy("depth", "src", "dst")

    def path(self, start: str, goal: str) -> DataFrame:
        """Return the edges of a shortest chain of calls."""
        edges = self.table("edges")
        found = graph.shortest_path(edges, self.resolve_one(start)["id"], self.resolve_one(goal)["id"])
        if found is None:
            raise NotFound(f"no path from {start} to {goal}")
        return graph.path_edges(edges, found).orderBy("pos")

    def definition(self, query: str, server: str | None = None) -> dict:
        """Return the symbol that a name, id or ``file:line`` means; a server may know better."""
        try:
            one = self.resolve_one(query)
        except NotFound:
            asked = self.spark.createDataFrame([(0, query)], "pos int, q string").select("pos", text.location(F.col("q")).alias("at")).where("at is not null").select("pos", F.regexp_replace("at.file", r"^\./", "").alias("file"), "at.line")
            row = locate.definition(asked, self._symbols()).first()
            if row is None:
                raise
            one = self.resolve_one(row.id)
        if self.runner and server:
            row = locate.definition(self._locations(self.runner(server, "definition", one["file"], one["line"])), self._symbols()).first()
            if row is not None:
                return self.resolve_one(row.id)
        return one

    def server_of(self, query: str) -> dict:
        """Tell which language server could be asked about a symbol, and whether it's there, or why not."""
        return servers.status(self.definition(query)["file"])

    def references(self, query: str, server: str | None = None) -> DataFrame:
        """Return the symbols that refer to one, by parsed edges or by what a server says."""
        one = self.definition(query)
        if not (self.runner and server):
            return self.callers(one["id"])
        places = self._locations(self.runner(server, "references", one["file"], one["line"]))
        found = locate.references(places, self._symbols(), one["id"], self.table("edges"))
        return found.join(self._symbols().select(*RECORD), "id").withColumn("source", F.lit("lsp")).orderBy("id")

    def _locations(self, lines: list[str]) -> DataFrame:
        rows = self.spark.createDataFrame(list(enumerate(lines)), "pos int, line string")
        at = rows.select("pos", text.tool_location(F.col("line")).alias("at")).where("at is not null").select("pos", "at.*")
        inside = at.withColumn("file", F.when(F.startswith("file", F.lit(self.root + "/")), F.substring("file", len(self.root) + 2, 1 << 20)).otherwise(F.col("file")))
        one = inside.where("line > 0").withColumn("column", F.greatest("column", F.lit(1)))
        return one.groupBy("file", "line", "column").agg(F.min("pos").alias("pos")).orderBy("file", "line", "column")

    # --- Annotations

    CACHE = "symbol_id string, profile string, model string, prompt_version string, cache_key string, file_hash string, generated_at string, updated_at string, summary string, purpose string, effects string, confidence string"

    def annotation_table(self) -> DataFrame:
        """Return the annotations; lines of the file that can't be read are skipped."""
        path = f"{self.home}/annotations.jsonl"
        if not os.path.exists(path):
            return self.spark.createDataFrame([], self.CACHE)
        lines = self.spark.read.text(f"file://{path}").withColumn("line", F.monotonically_increasing_id())
        read = lines.select(F.from_json("value", self.CACHE, {"mode": "PERMISSIVE"}).alias("r"), "line").select("r.*", "line").where("symbol_id is not null")
        default = {"profile": "default", "model": "", "prompt_version": "", "updated_at": ""}
        filled = read.fillna(default)
        key = ids.cache_key(F.col("symbol_id"), F.col("file_hash"), F.col("prompt_version"), F.col("profile"), F.col("model"))
        return annotations.loaded(filled.withColumn("cache_key", F.coalesce(F.nullif("cache_key", F.lit("")), key))).drop("line")

    def enrich(self, selector: str, summary: str, now: str, purpose: str = "agent", effects: str = "none", confidence: str = "medium", profile: str = "default", model: str = "", prompt: str = "") -> dict:
        """Annotate the one symbol that a selector means; ``now`` is the time to note."""
        if not self.spark.range(1).select(annotations.valid(*[F.lit(x) for x in (summary, purpose, effects, confidence)])).first()[0]:
            raise ValueError("an annotation needs three texts and a confidence of low, medium or high")
        known = self._symbols()
        chosen = known.where(annotations.matches(F.lit(selector), F.col("file"), F.col("id"), F.col("name"), F.col("line")))
        meant = chosen.join(self.table("files").select(F.col("path").alias("file"), "hash"), "file").select("id", "file", "line", "name", "hash")
        row = self._only(meant, ["file", "line"], selector, lambda r: f"{r.file}:{r.line}:{r.name}")
        one = self.spark.createDataFrame([(row.id, profile, model, prompt, "", row.hash, now, now, summary, purpose, effects, confidence)], self.CACHE)
        one = one.withColumn("cache_key", ids.cache_key(F.col("symbol_id"), F.col("file_hash"), F.col("prompt_version"), F.col("profile"), F.col("model")))
        merged = annotations.upsert(self.annotation_table(), one).orderBy("symbol_id", "profile", "cache_key")
        lines = merged.select(F.to_json(F.struct("*")).alias("json")).toLocalIterator()
        sinks.publish(f"{self.home}/annotations.jsonl", "".join(r.json + "\n" for r in lines).encode())
        return self.annotation_table().where(F.col("symbol_id") == row.id).where(F.col("profile") == profile).first().asDict()


def work_items(engine: Engine, files: list[str]) -> DataFrame:
    """Return ``(place, symbol_id, ...)``: the records to annotate of some files, in the files' order, then by line and id; unknown files have none."""
    wanted = engine.spark.createDataFrame(list(enumerate(files)), "place int, file string").groupBy("file").agg(F.min("place").alias("place"))
    chosen = engine.table("symbols").join(wanted, "file")
    made = annotations.records(chosen.drop("place"), engine.table("files"), engine.table("edges"))
    return made.join(chosen.select(F.col("id").alias("symbol_id"), "place"), "symbol_id").orderBy("place", "input.symbol.line", "symbol_id")


def present_languages(files: DataFrame) -> DataFrame:
    """Return one row that tells for each language whether a path has it."""
    language: Column = paths.served_language(F.col("path"))
    return files.agg(*[F.coalesce(F.bool_or(language == name), F.lit(False)).alias(name) for name in ("go", "python", "ruby", "typescript", "javascript")])
