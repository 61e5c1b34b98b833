"""Search, locations, paths and text."""

import math

from pyspark.sql import functions as F

from lodeweave.functions import ids, paths, text
from lodeweave.operators import locate, search


def index(spark, *rows):
    return search.build(spark.createDataFrame(list(rows), "id string, name string, signature string, file string, doc string"))


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")


def test_names_and_signatures_count(spark):
    made = index(spark, ("p", "ParseDirectory", "ParseDirectory(root string)", "internal/parser/parser.go", "parse a directory"), ("r", "ResolveImports", "ResolveImports(path string)", "internal/parser/parser.go", ""))
    rows = search.search(made, asked(spark, "parse directory")).orderBy("place").collect()
    assert rows[0].id == "p"
    n, tf, length, other = 2, 1, 4 + 2 * 3 + 2 * 4 + 3, 4 + 2 * 3 + 2 * 4
    idf = math.log(1 + (n - 1 + 0.5) / (1 + 0.5))
    one = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / ((length + other) / 2)))
    assert abs(rows[0].score - 2 * one) < 1e-9


def test_typo(spark):
    made = index(spark, ("p", "ParseDirectory", "", "", ""))
    rows = search.search(made, asked(spark, "ParzeDirectory", "", "entirely different")).collect()
    assert [(r.query_id, r.id, r.score) for r in rows] == [(0, "p", 0.5)]


def test_ties_and_limits(spark):
    made = index(spark, ("b", "alpha", "", "", ""), ("a", "alpha", "", "", ""), ("empty", "", "", "", None))
    assert [r.id for r in search.search(made, asked(spark, "Alpha alpha"), 0).orderBy("place").collect()] == ["a", "b"]
    assert search.search(made, asked(spark, "alpha"), 1).count() == 1
    assert made.stats.first().n == 2


def test_every_length_that_can_match_is_tried(spark):
    names = ["x" * n for n in range(1, 30)]
    made = index(spark, *((n, n, "", "", "") for n in names))
    for query in names[::4]:
        near = {n for n in names if abs(len(n) - len(query)) <= max(2, len(n) // 3)}
        assert {r.id for r in search.typos(made, asked(spark, query), 100).collect()} == near


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_typos_brute(spark):
    """All names within reach are found, though only those that share a piece are compared."""
    import random

    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abc_") for _ in range(n))
    names = sorted({word(rng.randint(1, 14)) for _ in range(150)} | {w[:3] + w[4:] for w in (word(12) for _ in range(20))})
    queries = [rng.choice(names)[::-1] for _ in range(6)] + [word(n) for n in (1, 2, 3, 5, 8, 11, 16)] + [names[5] + "x", "x" + names[-3][1:], names[20][:-1]]
    made = index(spark, *((n, n, "", "", "") for n in names))
    got = {(r.query_id, r.id): r.score for r in search.typos(made, asked(spark, *queries), 1000).collect()}
    want = {(i, n): 1 / (1 + edits(q, n)) for i, q in enumerate(queries) for n in names if q and edits(q, n) <= max(2, len(n) // 3)}
    assert got == want and len(got) > 90


def test_typos_of_hot_names_are_not_multiplied(spark):
    """Many symbols of one name and many queries for it: ids of each are cut before they meet, and a query's rows are the first of all."""
    made = index(spark, *((f"{i:04d}", ("alpha" if i % 2 else "alphb"), "", "", "") for i in range(600)))
    queries = spark.createDataFrame([(i, "Alpha") for i in range(300)] + [(300, "alphb"), (300, "alphc")], "query_id int, text string")
    found = search.typos(made, queries, 10)
    rows = {}
    for r in found.collect():
        rows.setdefault(r.query_id, []).append((r.place, r.id, r.score))
    odd, even = [f"{i:04d}" for i in range(1, 20, 2)], [f"{i:04d}" for i in range(0, 20, 2)]
    assert all(sorted(rows[q]) == [(k, i, 1.0) for k, i in enumerate(odd, 1)] for q in range(300))
    assert sorted(rows[300]) == [(k, i, 1.0) for k, i in enumerate(even, 1)]
    joined = []

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            return walk(node.plan())
        if node.nodeName().endswith("Join"):
            joined.append(node.metrics().get("numOutputRows").get().value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    plan = found._jdf.queryExecution().executedPlan()
    found._jdf.collectToPython()
    walk(plan)
    assert joined and max(joined) <= 302 * 10


def test_scores_are_summed_where_postings_lie(spark):
    """Few queries: terms go to the postings, and no more than a query's best leave a partition."""
    made = index(spark, *((f"d{i}", f"name{i % 7}", "", "", "some words") for i in range(50)))
    found = search.bm25(made, asked(spark, "name3 words"), 3)
    assert found.count() == 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "WindowGroupLimit" in plan
    assert "hashpartitioning(query_id" in plan and "hashpartitioning(query_id#" in plan and ", id#" not in "".join(x for x in plan.split("\n") if "Exchange hashpartitioning(query_id" in x)


def test_scan_finds_what_the_index_does(spark, monkeypatch):
    """Without an index, a few documents at a time, and of equal scores the first ids."""
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(f"d{i:03d}", text(rng.randint(0, 3)), "", "A.b", text(rng.randint(0, 30))) for i in range(200)] + [(f"c{i:03d}", "same", "Same", "", None) for i in range(40)] + [("none", "", "", "", "")]
    docs = spark.createDataFrame(rows, "id string, name string, signature string, file string, doc string").repartition(3)
    queries = spark.createDataFrame([(i, text(6)) for i in range(25)] + [(25, "SAME"), (26, "gone w1"), (27, " "), (28, "b same"), (28, "same")], "query_id int, text string")
    monkeypatch.setattr(search, "CELLS", 3000)
    shown = lambda found: sorted((r.query_id, r.place, r.id, round(r.score, 9)) for r in found.collect())
    got = search.scan(docs, queries, 7)
    assert shown(got) == shown(search.bm25(search.build(docs), queries, 7)) == shown(search.scan(docs, queries, 7, most=5))
    assert [r.id for r in got.where("query_id = 25").orderBy("place").collect()] == [f"c{i:03d}" for i in range(7)]
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Generate" not in plan and "MapInArrow" in plan and plan.count("Exchange hashpartitioning(query_id") == 1


def test_as_of(spark):
    symbols = spark.createDataFrame([("f", 2, "s2"), ("f", 5, "s5b"), ("f", 5, "s5a"), ("g", 1, "t"), ("f", None, "none")], "file string, line int, id string")
    queries = spark.createDataFrame([(i, f, n) for i, (f, n) in enumerate([("f", 1), ("f", 2), ("f", 4), ("f", 5), ("f", 9), ("h", 3), ("f", None), (None, 3)])], "q int, file string, line int")
    got = {r.q: (r.found, r.found_at) for r in locate.as_of(queries, symbols).collect()}
    assert got == {0: (None, None), 1: ("s2", 2), 2: ("s2", 2), 3: ("s5a", 5), 4: ("s5a", 5), 5: (None, None), 6: (None, None), 7: (None, None)}


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_paths(spark):
    rows = spark.createDataFrame([("a/b.py",), ("A.JS",), ("x.tsx",), ("m.cjs",), ("Makefile",), (".hidden/y.go",), ("a.b/c",)], "p string")
    got = [tuple(r) for r in rows.select("p", paths.language_of(F.col("p")), paths.module_of(F.col("p")), paths.directory(F.col("p")), paths.without_extension(F.col("p")), paths.served_language(F.col("p"))).collect()]
    assert got == [
        ("a/b.py", "python", "a", "a", "a/b", "python"), ("A.JS", "typescript", "root", ".", "A", "javascript"), ("x.tsx", "typescript", "root", ".", "x", "typescript"), ("m.cjs", "javascript", "root", ".", "m", "javascript"),
        ("Makefile", None, "root", ".", "Makefile", None), (".hidden/y.go", "go", ".hidden", ".hidden", ".hidden/y", "go"), ("a.b/c", None, "a.b", "a.b", "a.b/c", None),
    ]
    row = one(spark, a=paths.cleaned(F.lit("a/./b/../../c//d")), b=paths.cleaned(F.lit("a/..")), c=paths.cleaned(F.lit("../x/../../y")))
    assert tuple(row) == ("c/d", ".", "../../y")
    assert paths.language_set(["py", " Go "]) == ["go", "python"] and paths.language_set([]) is None


def test_text(spark):
    row = one(
        spark, loc=text.location(F.lit("a:b.go: 4")), bad=text.location(F.lit("a.go:0")), none=text.location(F.lit(":3")), tool=text.tool_location(F.lit("/r/a.go:3:7-9: x")), junk=text.tool_location(F.lit("no place")),
        words=text.word_count(F.lit(" a  b\nc ")), set=text.string_set(F.array(F.lit(" b"), F.lit("a"), F.lit(""), F.lit("b"))), line=text.source_line(F.lit("x\n  y \nz"), F.lit(2)), past=text.source_line(F.lit("x"), F.lit(5)),
        short=text.shortened(F.array(F.lit("c"), F.lit("a"), F.lit("b")), 2), all=text.shortened(F.array(F.lit("a")), 2), alias=text.alias_map(F.create_map(F.lit(" k "), F.lit(" v"), F.lit(" "), F.lit("w"), F.lit("e"), F.lit(" "))),
    )
    assert (tuple(row["loc"]), row.bad, row.none, tuple(row.tool), row.junk) == (("a:b.go", 4), None, None, ("/r/a.go", 3, 7), None)
    assert (row.words, row["set"], row.line, row.past, row.short, row["all"], row.alias) == (3, ["a", "b"], "y", "", "a, b, ... (+1 more)", "a", {"k": "v"})


def test_ids(spark):
    sid = ids.symbol_id(F.lit("f.go"), F.lit(3), F.lit("func"), F.lit("A"), F.lit("func A()"))
    plain = ids.symbol_id(F.lit("f.go"), F.lit(3), F.lit("func"), F.lit("A"), F.lit(""))
    row = one(spark, sid=sid, plain=plain, file=ids.id_file(sid), name=ids.id_name(plain), bad=ids.id_file(F.lit("a|b")), kind=ids.kind_text(F.lit(3)), other=ids.kind_text(F.lit(99)), key=ids.cache_key(F.lit(" s"), F.lit("h"), F.lit(None), F.lit("p"), F.lit("m")))
    import hashlib

    assert row.sid == "f.go|3|func|A|" + hashlib.sha1(b"func A()").hexdigest()[:8] and row.plain == "f.go|3|func|A"
    assert (row.file, row["name"], row.bad, row.kind, row.other) == ("f.go", "A", None, "struct", "unknown")
    assert row.key == "cache-v1-" + hashlib.sha256(b"s|h||p|m").hexdigest()[:16]
