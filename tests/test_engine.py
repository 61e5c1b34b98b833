"""The engine on a small tree, from a first build to changes."""

import json
import os

import pytest

from lodeweave.plans.engine import Ambiguous, Engine, NotFound, present_languages
from lodeweave.sources import sinks, tree

DEMO = "package demo\n\nfunc Start() { Mid() }\nfunc Mid() { End() }\nfunc End() {}\n"


def put(root, path, text):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text)


@pytest.fixture(scope="module")
def demo(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("demo")
    put(root, "demo.go", DEMO)
    put(root, "pkg/__init__.py", "def helper():\n    '''Help.'''\n\ndef run():\n    helper()\n")
    put(root, "pkg/a.rb", "def helper\nend\ndef run\n  helper()\nend\n")
    put(root, "web/_b.ts", "function helper() {}\nfunction run() { helper() }\n")
    put(root, "web/c.js", "function helper() {}\nfunction run() { helper() }\n")
    put(root, "node_modules/x/skip.js", "function no() {}\n")
    put(root, "notes.txt", "nothing")
    engine = Engine(spark, str(root))
    return root, engine, engine.generate()


def test_generate(demo):
    root, engine, summary = demo
    assert (summary.scanned, summary.parsed, summary.issues) == (5, 5, [])
    assert {r.path for r in engine.table("files").collect()} == {"demo.go", "pkg/__init__.py", "pkg/a.rb", "web/_b.ts", "web/c.js"}
    index = (root / ".lodeweave/context/index.txt").read_text()
    assert all(name in index for name in ("demo.go (3 symbols)", "pkg/__init__.py", "pkg/a.rb", "web/_b.ts", "web/c.js"))
    assert "{resolved}" in (root / ".lodeweave/context/graph.txt").read_text()
    assert "doc: Help." in (root / ".lodeweave/context/modules/pkg.txt").read_text()
    assert engine.table("edges").count() == 6


def test_navigation(demo):
    _, engine, _ = demo
    assert [r.name for r in engine.callers("Mid").collect()] == ["Start"] and [r.name for r in engine.callees("Mid").collect()] == ["End"]
    assert [(r.depth, r.confidence) for r in engine.trace("Start", 2).collect()] == [(1, "resolved"), (2, "resolved")]
    assert engine.path("Start", "End").count() == 2
    with pytest.raises(NotFound):
        engine.path("End", "Start")
    with pytest.raises(NotFound):
        engine.callers("nobody")
    with pytest.raises(Ambiguous):
        engine.callers("helper")
    assert engine.definition("demo.go:4")["name"] == "Mid" and engine.definition("demo.go:99")["name"] == "End"
    assert [r.name for r in engine.references("demo.go:4").collect()] == ["Start"]
    assert [r.name for r in engine.symbol("Strat", fuzzy=True).collect()] == ["Start"] and engine.symbol("Strat").count() == 0
    assert engine.symbol("helper", limit=2).count() == 2


def test_server_answers(demo, spark):
    root, _, _ = demo
    said = {"references": [f"{root}/demo.go:3:16-19", "demo.go:3:16", "junk", "demo.go:4:1"], "definition": ["junk", "demo.go:5:6: End"]}
    engine = Engine(spark, str(root), runner=lambda server, action, file, line: said[action])
    assert engine.definition("Mid", server="gopls")["name"] == "End"
    assert [(r.name, r.confidence, r.source) for r in engine.references("Mid", server="gopls").collect()] == [("Start", "resolved", "lsp")]
    assert engine.callers("Mid").first().source == "parser"


def test_enrich(demo):
    _, engine, _ = demo
    first = engine.enrich("demo.go:Mid", "does a thing", "2024-01-01T00:00:00Z")
    assert first["confidence"] == "medium" and first["cache_key"].startswith("cache-v1-")
    again = engine.enrich("demo.go:Mid", "does more", "2024-02-01T00:00:00Z")
    assert (again["generated_at"], again["summary"]) == ("2024-01-01T00:00:00Z", "does more") and engine.annotation_table().count() == 1
    with pytest.raises(Ambiguous, match="matched"):
        engine.enrich("demo.go", "x", "now")
    with pytest.raises(ValueError):
        engine.enrich("demo.go:Mid", " ", "now")
    with open(f"{engine.home}/annotations.jsonl", "a") as f:
        f.write("{broken\n")
    assert engine.annotation_table().count() == 1


def test_jsonl_is_the_same_each_time(spark, tmp_path):
    put(tmp_path, "demo.go", DEMO)
    engine = Engine(spark, str(tmp_path))
    summary = engine.generate(form="jsonl")
    assert summary.rewritten == 5  # with both indexes
    data = {n: (tmp_path / ".lodeweave/context" / n).read_bytes() for n in sinks.JSONL}
    nav, found = (json.loads((tmp_path / ".lodeweave/context" / n).read_text()) for n in sinks.INDEXES)
    assert nav["version"] and [(n["name"], len(n["out_edges"]), len(n["in_edges"])) for n in nav["nodes"]] == [("Start", 1, 0), ("Mid", 1, 1), ("End", 0, 1)]
    assert nav["nodes"][0]["out_confidence"][0]["confidence"] == "resolved"
    assert found["document_count"] == 3 and found["doc_freq"]["demo"] == 3 and [d["terms"]["demo"] for d in found["documents"]] == [2, 2, 2]
    assert found["avg_doc_length"] == sum(d["length"] for d in found["documents"]) / 3
    assert engine.generate(form="jsonl").rewritten == 0
    assert data == {n: (tmp_path / ".lodeweave/context" / n).read_bytes() for n in sinks.JSONL}
    manifest = json.loads(data["manifest.json"])
    assert manifest["counts"] == {"files": 1, "symbols": 3, "edges": 2} and manifest["artifacts"][0]["hash"] == sinks.short_hash(data["symbols.jsonl"])
    assert json.loads(data["edges.jsonl"].splitlines()[0])["confidence"] == "resolved"
    engine.generate(form="text")
    assert sinks.present_format(engine.context) == "text"


def test_update(spark, tmp_path):
    put(tmp_path, "lib/a.go", "package lib\n\nfunc A() { B() }\n")
    put(tmp_path, "lib/b.go", "package lib\n\nfunc B() {}\n")
    put(tmp_path, "lib/c.go", "package lib\n\nfunc C() {}\n")
    engine = Engine(spark, str(tmp_path))
    assert engine.update().parsed == 3  # nothing yet: a full build
    same = engine.update()
    assert (same.scanned, same.parsed, same.reused, same.rewritten) == (3, 0, 3, 0)
    assert engine.doctor()["healthy"]
    put(tmp_path, "lib/b.go", "package lib\n\nfunc B() { C() }\n")
    os.remove(tmp_path / "lib/c.go")
    put(tmp_path, "lib/d.go", "package lib\n\nfunc C() {}\n")
    want = {"lib/a.go": ["depends on lib/b.go"], "lib/b.go": ["changed"], "lib/c.go": ["deleted"], "lib/d.go": ["changed"]}
    told = engine.status()
    assert (told.changed, told.deleted, told.reasons) == (["lib/b.go", "lib/d.go"], ["lib/c.go"], want)
    assert not engine.doctor()["healthy"]
    done = engine.update()
    assert (done.parsed, done.reused, done.changed, done.deleted, done.reasons) == (2, 1, ["lib/b.go", "lib/d.go"], ["lib/c.go"], want)
    assert [r.name for r in engine.callees("B").collect()] == ["C"] and not engine.status().changed
    os.remove(tmp_path / ".lodeweave/context/graph.txt")
    assert engine.doctor()["missing"] == ["graph.txt"]
    engine.update()
    assert (tmp_path / ".lodeweave/context/graph.txt").exists()
    (tmp_path / ".lodeweave/state/current.json").write_text("{broken")
    assert engine.status().parsed == 3 and engine.update().parsed == 3


def test_languages_and_empty_tree(spark, tmp_path):
    put(tmp_path, "a.go", DEMO)
    put(tmp_path, "b.py", "def f(): pass\n")
    put(tmp_path, ".lodeweaveignore", "# rules\nskip/\n")
    put(tmp_path, "skip/c.py", "def g(): pass\n")
    engine = Engine(spark, str(tmp_path))
    assert engine.generate(languages=["py"]).scanned == 1
    with pytest.raises(ValueError):
        engine.generate(languages=["cobol"])
    with pytest.raises(ValueError):
        engine.generate(form="xml")
    assert tuple(present_languages(engine.table("files")).first()) == (False, True, False, False, False)
    empty = tmp_path / "empty"
    empty.mkdir()
    engine = Engine(spark, str(empty))
    assert engine.generate().parsed == 0 and engine.symbol("x", fuzzy=True).count() == 0
    with pytest.raises(FileNotFoundError):
        tree.listed(str(tmp_path / "none"))


def test_many_symbols_of_one_name(spark, tmp_path):
    """An ambiguous name tells some of the ids and the number of all others."""
    for i in range(60):
        put(tmp_path, f"p{i:02}/a.go", "package p\n\nfunc same() {}\n")
    engine = Engine(spark, str(tmp_path))
    engine.generate()
    with pytest.raises(Ambiguous, match=r"\(\+55 more\)"):
        engine.callers("same")
    with pytest.raises(Ambiguous, match=r"\(\+55 more\)"):
        engine.enrich("same", "x", "now")


def test_work_items(demo):
    from lodeweave.plans.engine import work_items

    _, engine, _ = demo
    rows = work_items(engine, ["pkg/a.rb", "no.go", "demo.go"]).collect()
    assert [(r.input.symbol.path, r.input.symbol.name) for r in rows] == [("pkg/a.rb", "helper"), ("pkg/a.rb", "run"), ("demo.go", "Start"), ("demo.go", "Mid"), ("demo.go", "End")]
    assert rows[2].input.calls and not rows[2].input.called_by


def test_small_and_large_trees_tell_the_same(spark, tmp_path, monkeypatch):
    """What changed is found by hashes noted with the state, or, beyond a size, by a join."""
    from lodeweave.plans import engine as module

    for i in range(5):
        put(tmp_path, f"f{i}.go", f"package p\n\nfunc F{i}() {{}}\n")
    engine = Engine(spark, str(tmp_path))
    engine.generate()
    put(tmp_path, "f1.go", "package p\n\nfunc Other() {}\n")
    put(tmp_path, "g.go", "package p\n")
    os.remove(tmp_path / "f4.go")
    small = engine.status()
    monkeypatch.setattr(module, "SMALL_FILES", 0)
    assert vars(engine.status()) == vars(small) and (small.changed, small.deleted) == (["f1.go", "g.go"], ["f4.go"])


def test_throughput_tree(spark, tmp_path):
    for i in range(60):
        put(tmp_path, f"pkg{i % 10}/file_{i:03}.go", f"package p\n\nfunc Func_{i}() {{ helper_{i}() }}\n\nfunc helper_{i}() {{}}\n")
    engine = Engine(spark, str(tmp_path))
    engine.generate()
    assert engine.table("symbols").count() == 120 and engine.table("edges").count() == 60
