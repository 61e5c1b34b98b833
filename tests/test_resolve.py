"""Resolution of calls on small sources."""

import pytest
from pyspark.sql import functions as F

from lodeweave.operators import graph, imports, resolve
from lodeweave.sources import tree

SYMBOL = "struct<name: string, kind: string, signature: string, line: int, doc: string, calls: array<struct<name: string, qualifier: string, receiver: string, arity: int, line: int, raw: string>>>"
FILES = f"path string, language string, hash string, imports array<string>, import_aliases map<string, string>, symbols array<{SYMBOL}>"


def call(name, qualifier="", receiver=""):
    return (name, qualifier, receiver, 0, 1, name)


def symbol(name, line, *calls, kind="func"):
    return (name, kind, "", line, "", list(calls))


def file(path, *symbols, imports=(), aliases=None):
    return (path, "python", "h", list(imports), aliases or {}, list(symbols))


@pytest.fixture
def edges(spark):
    def run(*files):
        table = spark.createDataFrame(files, FILES)
        known = tree.symbol_table(table).cache()
        got = resolve.resolve(known, tree.call_table(known), imports.aliases(table))
        short = lambda c: F.concat_ws(".", F.split_part(c, F.lit("|"), F.lit(1)), F.split_part(c, F.lit("|"), F.lit(4)))
        return {(r.a, r.b): r.confidence for r in got.select(short(F.col("src")).alias("a"), short(F.col("dst")).alias("b"), "confidence").collect()}

    return run


def test_scoped_and_ambiguous(edges):
    got = edges(file("a.py", symbol("helper", 1), symbol("run", 10, call("helper"), call("onlyB"), call("dup"))), file("b.py", symbol("helper", 2), symbol("onlyB", 3), symbol("dup", 4)), file("c.py", symbol("dup", 5)))
    assert got == {("a.py.run", "a.py.helper"): "resolved", ("a.py.run", "b.py.onlyB"): "heuristic"}


def test_alias_before_global(edges):
    got = edges(file("api/main.ts", symbol("run", 1, call("helper", "util")), aliases={"util": "./util"}), file("api/util.ts", symbol("helper", 1)), file("other/util.ts", symbol("helper", 1)))
    assert got == {("api/main.ts.run", "api/util.ts.helper"): "heuristic"}


def test_alias_of_symbol(edges):
    got = edges(file("app/main.py", symbol("run", 1, call("myfoo")), imports=["util"], aliases={"myfoo": "util#foo"}), file("app/util.py", symbol("foo", 1)))
    assert got == {("app/main.py.run", "app/util.py.foo"): "heuristic"}


def test_qualified_falls_back(edges):
    got = edges(file("svc/main.go", symbol("run", 1, call("Handle", "svc", "svc"))), file("svc/handler.go", symbol("Handle", 3, kind="method")))
    assert got == {("svc/main.go.run", "svc/handler.go.Handle"): "heuristic"}


def test_receiver_asks_methods_first(edges):
    got = edges(file("a/x.py", symbol("go", 1, call("step", "self", "self"), kind="method"), symbol("step", 2, kind="method"), symbol("step", 9), symbol("other", 12, call("step"))))
    assert got == {("a/x.py.go", "a/x.py.step"): "resolved"}


def test_recursion_does_not_fall_through(edges):
    assert edges(file("a/x.py", symbol("f", 1, call("f"))), file("b/y.py", symbol("f", 1))) == {}


def test_ambiguous_tier_ends_the_search(edges):
    assert edges(file("m/a.py", symbol("run", 1, call("f"))), file("m/b.py", symbol("f", 1)), file("m/c.py", symbol("f", 1))) == {}


def test_best_confidence_of_an_edge_wins(edges):
    got = edges(file("m/a.py", symbol("run", 1, call("f"), call("f", "x.y"))), file("m/b.py", symbol("f", 1)))
    assert got == {("m/a.py.run", "m/b.py.f"): "heuristic"}


def test_import_forms(spark):
    files = spark.createDataFrame([("a/b/c.py",), ("a/b/d.py",), ("top.py",), ("x/top.py",)], "path string")
    asked = [("a/b/c.py", "./d"), ("a/b/c.py", "../b"), ("a/b/c.py", "'top'"), ("top.py", "pkg/a/b/d"), ("top.py", "/a/b"), ("top.py", "nothing"), ("top.py", " "), ("top.py", "./x/top")]
    got = imports.match_imports(spark.createDataFrame(asked, "file string, import_path string"), files)
    found = {}
    for r in got.collect():
        found.setdefault(r.import_path, set()).add(r.target_file)
    assert found == {"./d": {"a/b/d.py"}, "../b": {"a/b/c.py", "a/b/d.py"}, "'top'": {"top.py", "x/top.py"}, "pkg/a/b/d": {"a/b/d.py"}, "/a/b": {"a/b/c.py", "a/b/d.py"}, "./x/top": {"x/top.py"}}


def test_precision_and_recall(spark):
    edges = lambda *pairs: spark.createDataFrame(list(pairs), "src string, dst string")
    row = graph.quality(edges(("a", "b"), ("a", "c")), edges(("a", "b"), ("x", "y"), ("y", "z"))).first()
    assert (row.true_positives, row.precision, row.recall) == (1, 0.5, 1 / 3)
    row = graph.quality(edges(("a", "b")).limit(0), edges(("a", "b")).limit(0)).first()
    assert (row.precision, row.recall) == (0.0, 0.0)
