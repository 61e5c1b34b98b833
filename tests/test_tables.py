"""Snapshots, annotations, runs, call sites, ignore rules, streams."""

import re

import pytest
from pyspark.sql import functions as F

from lodeweave.operators import abruns, annotations, normalize, snapshots
from lodeweave.sources import ignore
from lodeweave.streaming import changes


def snapshot(spark, *rows):
    return spark.createDataFrame([(p, h, list(d)) for p, h, d in rows], "path string, hash string, deps array<string>")


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def test_difference_and_merge(spark):
    old = snapshot(spark, ("a", "a1", "x"), ("b", "b1", "x"), ("c", "c1", "x"))
    new = snapshot(spark, ("a", "a1", ""), ("b", "b2", ""), ("d", "d1", ""))
    assert {r.path: r.change for r in snapshots.difference(old, new).collect()} == {"b": "changed", "d": "added", "c": "deleted"}
    assert {r.path for r in snapshots.difference(old, old, F.col("path") == "a").collect()} == {"a"}
    merged = snapshots.merge(old, new.where("path in ('b', 'd')"), paths(spark, "c"))
    assert {r.path: (r.hash, r.deps) for r in merged.collect()} == {"a": ("a1", ["x"]), "b": ("b2", []), "d": ("d1", [])}
    deps = spark.createDataFrame([("b", "z"), ("b", "y"), ("a", "q")], "src_file string, dst_file string")
    assert {r.path: r.deps for r in snapshots.refreshed(merged, deps, paths(spark, "b", "d")).collect()} == {"a": ["x"], "b": ["y", "z"], "d": []}
    assert snapshots.rewritten(old, new).first()[0] == 3


def test_closure(spark):
    state = snapshot(spark, ("a", "", ["b"]), ("c", "", ["a"]), ("d", "", ["x"]), ("b", "", ["c"]))
    assert {r.path for r in snapshots.closure(state, paths(spark, "b")).collect()} == {"a", "b", "c"}


def test_impact(spark):
    state = snapshot(spark, ("a", "", ["b"]), ("b", "", []), ("c", "", ["a"]), ("e", "", []), ("f", "", ["e"]), ("g", "", ["gone"]))
    symbols = spark.createDataFrame([("b", "two"), ("b", "one"), ("a", "three")], "path string, name string")
    calls = spark.createDataFrame([("e", 0, 1, "two"), ("e", 0, 0, "one"), ("f", 0, 0, "three"), ("c", 0, 0, "one")], "path string, sym_pos int, call_pos int, name string")
    got = {r.path: r.reasons for r in snapshots.impact(state, symbols, calls, paths(spark, "b"), paths(spark, "gone")).collect()}
    assert got == {"b": ["changed"], "gone": ["deleted"], "a": ["depends on b"], "c": ["depends on a"], "g": ["depends on gone"], "e": ["calls changed symbol one"]}


def test_latest_and_upsert(spark):
    columns = "symbol_id string, profile string, cache_key string, generated_at string, updated_at string, line long"
    rows = [("s", "p", "k1", "1", "", 1), ("s", "p", "k1", "1", "3", 2), ("s", "p", "k1", "3", "", 3), ("s", "q", "k2", "1", None, 4), ("t", "p", "k3", "5", "", 5)]
    cache = annotations.loaded(spark.createDataFrame(rows, columns))
    assert {r.cache_key: r.line for r in cache.collect()} == {"k1": 3, "k2": 4, "k3": 5}
    fresh = spark.createDataFrame([("s", "p", "k9", "7", "7", 6), ("t", "p", "k3", "8", "8", 7)], columns)
    got = {r.cache_key: (r.generated_at, r.line) for r in annotations.upsert(cache, fresh).collect()}
    assert got == {"k9": ("7", 6), "k2": ("1", 4), "k3": ("5", 7)}


def test_selectors_and_validation(spark):
    row = spark.createDataFrame([("src/Demo.go", "src/Demo.go|3|func|Run", "Run", 3)], "file string, id string, name string, line int")
    hit = lambda s: row.select(annotations.matches(F.lit(s), F.col("file"), F.col("id"), F.col("name"), F.col("line"))).first()[0]
    assert all(hit(s) for s in ("./SRC/demo.go", "run", "src/demo.go:run", "src/demo.go:3", "src/demo.go:3:RUN", "src", "demo.go", "ru", "", "src\\demo.go"))
    assert not any(hit(s) for s in ("demo", "src/demo.go:4", "walk"))
    valid = lambda *v: row.select(annotations.valid(*[F.lit(x) for x in v])).first()[0]
    assert valid("a", "b", "c", "high") and not valid("a", " ", "c", "high") and not valid("a", "b", "c", "sure") and not valid("a", "b", None, None)


RUN = "run_id int, task_id string, arm string, repeat int, success boolean, duration_seconds double, total_cost_usd double, input_tokens double, output_tokens double, cache_read_tokens double, cache_write_tokens double, step_count double, tool_call_count double, acceptance_cmd_count double, agent_exit_code double, acceptance_exit_code double"


def run(number, task, arm, repeat, success, seconds, cost, agent=0.0, check=0.0):
    return (number, task, arm, repeat, success, seconds, cost, 1.0, None, 2.0, 3.0, None, 4.0, 5.0, agent, check)


def test_runs(spark):
    a, b = abruns.ARMS
    rows = [run(1, "t", a, 1, True, 2.0, 1.0), run(2, "t", a, 2, True, 4.0, None), run(3, "t", b, 1, False, 10.0, 2.0), run(4, "t", b, 2, None, 20.0, 2.0), run(5, "t", b, 1, True, 1.0, 1.0), run(6, "u", a, 1, True, 1.0, 1.0, 86.0), run(7, "v", b, 1, True, 1.0, 1.0, 1.0, 99.0)]
    table = spark.createDataFrame(rows, RUN)
    assert tuple(abruns.totals(table).first()) == (7, 5, 2, 3)
    arms = {r.arm: r for r in abruns.arm_summary(table).collect()}
    assert (arms[a].runs, arms[a].successes, arms[a].success_rate, arms[a].avg_cost_usd, arms[a].median_duration_seconds, arms[a].solved_per_dollar) == (2, 2, 1.0, 0.5, 3.0, 2.0)
    assert arms[b].median_duration_seconds == 10.0 and arms[b].median_total_tokens == 6.0
    paired = abruns.paired_summary(table).first()
    assert (paired.paired_runs, paired.mean_pass_delta, paired.mean_duration_seconds_delta, paired.median_cost_usd_delta) == (2, 1.0, -12.0, -1.5)
    assert abruns.decision(abruns.arm_summary(table)).first()[0] == f"prefer {a}"
    assert abruns.decision(abruns.arm_summary(table.where(F.col("arm") == a))).first()[0] == "insufficient data"
    assert abruns.paired_summary(table.limit(0)).first().paired_runs == 0


def test_run_sources(spark):
    raw = spark.createDataFrame([("1", "", " 2.5 ", "x")], "run_id string, input_tokens string, output_tokens string, step_count string")
    assert tuple(abruns.normalized(raw).first())[1:] == (None, 2.5, None)
    lines = spark.createDataFrame([("r", "Total Cost   $1,234.5"), ("r", "│Input Tokens: 7 │"), ("r", "nothing here")], "run_id string, line string")
    assert {(r.label, r.value) for r in abruns.scraped(lines).collect()} == {("total_cost", 1234.5), ("input_tokens", 7.0)}
    events = spark.createDataFrame([("r", '{"type":"step_start"}'), ("r", '{"type":"tool_use","part":{"tool":"bash","state":{"input":{"command":"x doctor"}}}}'), ("r", "broken")], "run_id string, json string")
    row = abruns.event_counts(events).first()
    assert (row.step_count, row.tool_call_count, row.doctor_count, row.update_count) == (1, 1, 1, 0)


def test_sessions_come_before_statistics(spark):
    sessions = spark.createDataFrame([("r", '{"messages":[{"cost":1.5,"tokens":{"input":2,"cache":{"read":7}}},{"cost":0.5}]}'), ("r", '{"cost":1}'), ("q", "broken")], "run_id string, json string")
    sums = abruns.session_sums(sessions)
    assert {(r.label, r.value) for r in sums.collect()} == {("total_cost_usd", 3.0), ("input_tokens", 2.0), ("cache_read_tokens", 7.0)}
    statistics = spark.createDataFrame([("r", "input_tokens", 99.0), ("q", "input_tokens", 5.0)], "run_id string, label string, value double")
    got = {(r.run_id, r.label): r.value for r in abruns.preferred(sums, statistics).collect()}
    assert got[("r", "input_tokens")] == 2.0 and got[("q", "input_tokens")] == 5.0


def test_records(spark):
    symbols = spark.createDataFrame([("i1", "a.go", "A", "func", "func A()", 2), ("i2", "a.go", "B", "func", "", 3)], "id string, file string, name string, kind string, signature string, line int")
    files = spark.createDataFrame([("a.go", "go", "h", ["fmt"], "x\n  func A() {}\n")], "path string, language string, hash string, imports array<string>, content string")
    edges = spark.createDataFrame([("i1", "i2", "resolved")], "src string, dst string, confidence string")
    got = {r.symbol_id: r for r in annotations.records(symbols, files, edges).collect()}
    one = got["i1"].input
    assert (one.source.body, one.calls, one.called_by, one.imports, one.symbol.language, got["i1"].status) == ("func A() {}", ["i2"], [], ["fmt"], "go", "pending")
    assert (got["i2"].input.source.body, got["i2"].input.called_by) == ("", ["i1"])


def test_call_sites(spark):
    calls = [(" b ", None, "", 1, 2, "first"), ("b", "", "", 1, 2, "second"), ("a", "q", "", 0, 2, "x"), (" ", "", "", 0, 1, "no"), ("z", "", "", 0, 1, "z")]
    table = spark.createDataFrame([("k", i, *c) for i, c in enumerate(calls)], "k string, pos int, name string, qualifier string, receiver string, arity int, line int, raw string")
    want = [("z", ""), ("b", ""), ("a", "q")]
    rows = normalize.call_sites(table, ["k"]).orderBy("place").collect()
    assert [(r.name, r.qualifier) for r in rows] == want and rows[1].raw == "first"
    listed = spark.createDataFrame([(calls,)], f"calls array<{normalize.CALL}>").select(normalize.call_list(F.col("calls"))).first()[0]
    assert [(r.name, r.qualifier) for r in listed] == want and listed[1].raw == "first"
    old = spark.createDataFrame([('["a", "b"]',), ('[{"name": "c", "line": 3}]',), ("",), (None,)], "j string").select(normalize.decoded_calls(F.col("j")).alias("c")).collect()
    assert [[(c.name, c.line) for c in r.c] for r in old] == [[("a", 0), ("b", 0)], [("c", 3)], [], []]


RULES = ("vendor/**", "!vendor/keep/file.go", "*.tmp")
CASES = {".git/config": True, ".context/index.txt": True, "node_modules/pkg/index.js": True, "vendor/lib/a.go": True, "vendor/keep/file.go": False, "nested/cache.tmp": True, "src/main.go": False}


def both(spark, rules, names, folder=False):
    parsed = ignore.parse(rules)
    table = spark.createDataFrame([(n,) for n in names], "p string")
    got = {r.p: r.x for r in table.select("p", ignore.ignored(parsed, F.col("p"), F.lit(folder)).alias("x")).collect()}
    assert got == {n: ignore.leaves_out(parsed, n, folder) for n in names}
    return got


def test_ignore_rules(spark):
    assert both(spark, RULES, CASES) == CASES
    assert both(spark, ("build/", "!build/include/"), ("build/out/file.go", "build/include/file.go")) == {"build/out/file.go": True, "build/include/file.go": False}
    assert both(spark, ("/a.go", "x?z", "docs/*.md"), ("a.go", "b/a.go", "xyz/q", "x/z", "docs/a.md", "s/docs/b.md", "docs/d/c.md")) == {"a.go": True, "b/a.go": False, "xyz/q": True, "x/z": False, "docs/a.md": True, "s/docs/b.md": True, "docs/d/c.md": False}
    assert both(spark, ("a+b[1].go",), ("a+b[1].go", "aab1.go")) == {"a+b[1].go": True, "aab1.go": False}
    assert both(spark, (), ("src/vendor", "vendor"), True) == {"src/vendor": True, "vendor": True}
    assert both(spark, (), ("src/vendor/a.go",)) == {"src/vendor/a.go": False}  # only a walk leaves it out


def test_ignore_walk(spark):
    table = spark.createDataFrame([("src/vendor/a.go",), ("skip/a.mock",), ("skip/include.mock",), ("keep.mock",), ("vendor/keep/file.go",)], "p string")
    kept = lambda *rules: {r.p for r in table.where(ignore.kept(ignore.parse(rules), F.col("p"))).collect()}
    assert kept("skip/*", "!skip/include.mock") == {"skip/include.mock", "keep.mock"}
    assert "vendor/keep/file.go" not in kept("!vendor/keep/file.go")  # below a folder that is left out


@pytest.mark.parametrize("pattern", ["*.go", "a/**", "?x", "**/y", "(z)$^"])
def test_globs_are_valid(pattern):
    re.compile(ignore.glob_regex(pattern))


def test_time_and_number_are_of_one_event(spark):
    """A later event isn't held off by a number that an earlier one of its batch had."""
    one = lambda *rows: spark.createDataFrame(list(rows), "path string, hash string, t int, seq long").select("path", "hash", F.timestamp_seconds("t").alias("ts"), "seq")
    rows = [("a", "h1", 2, 1), ("a", "h2", 1, 5), ("a", "h3", 2, 3)]
    nothing = one(rows[0]).limit(0)
    for cut in range(4):
        state = nothing
        for batch in (rows[:cut], rows[cut:]):
            state = changes.apply_changes(state, one(*batch)) if batch else state
        assert [(r.hash, r.seq) for r in state.collect()] == [("h3", 3)]


def test_change_counts(spark, tmp_path):
    rows = [("a", "x", 0, 1), ("a", "y", 30, 2), ("b", "z", 61, 3)]
    spark.createDataFrame(rows, "path string, hash string, t int, seq long").select("path", "hash", F.timestamp_seconds("t").alias("ts"), "seq").coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(changes.EVENT).parquet(str(tmp_path / "in"))
    changes.change_counts(events).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r.start.minute, r.changes, r.files) for r in spark.table("counts").collect()) == [(0, 2, 1), (1, 1, 1)]


def test_no_folder_of_one_machine_on_a_cluster(spark):
    """Without a shared folder, only a session on one machine gets a temporary one."""
    from types import SimpleNamespace

    from lodeweave import storage

    fake = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master=master, applicationId="app"))
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1000]", "k8s://h"):
        with pytest.raises(RuntimeError):
            storage.shared_dir(fake(master), "x")
    a, b = (storage.shared_dir(fake("local[4]"), "x") for _ in range(2))
    assert a.startswith("file://") and a != b and a.rpartition("/")[0] == b.rpartition("/")[0]
    path = storage.shared_dir(spark, "kept")
    spark.range(3).write.parquet(path)
    storage.discard(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path).count()


def test_stream(spark, tmp_path):
    source = str(tmp_path / "events")
    (tmp_path / "events").mkdir()
    stamp = lambda n: f"2024-01-01 00:00:{n:02d}"
    rows = [[("a", "a1", 1, 1), ("b", "b1", 2, 2)], [("a", "a2", 5, 3), ("a", "a3", 6, 4), ("b", None, 7, 5)], [("a", "late", 0, 0), ("c", "c1", 8, 6)]]
    events = spark.readStream.schema(changes.EVENT).option("maxFilesPerTrigger", 1).parquet(source)
    for batch in rows:
        spark.createDataFrame([(p, h, stamp(t), s) for p, h, t, s in batch], "path string, hash string, ts string, seq long").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(source)
        changes.follow(spark, events, str(tmp_path / "state"), str(tmp_path / "marks")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "state" / "v2"))
    assert {r.path: r.hash for r in got.collect()} == {"a": "a3", "b": None, "c": "c1"}
