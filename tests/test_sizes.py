"""Tables that are copies of themselves with shifted keys, and plans that must bear many of these."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from lodeweave.operators import resolve
from lodeweave.plans import registry
from lodeweave.sources import tree

FOLDER = "/root/testdata/sf0.001"
KEYS = {"part": {"p_partkey": 20000}, "supplier": {"s_suppkey": 1000}, "lineitem": {"l_orderkey": 150000, "l_partkey": 20000, "l_suppkey": 1000}}


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """A folder with three copies of each table, and views of them."""
    folder, con = tmp_path_factory.mktemp("copies"), duckdb.connect()
    for table, keys in KEYS.items():
        shifted = ", ".join(f"{k} + i * {n} AS {k}" for k, n in keys.items())
        con.execute(f"COPY (SELECT * REPLACE ({shifted}) FROM '{FOLDER}/{table}.parquet', range(3) r(i)) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return str(folder), con


def both(spark, copies, name):
    """Rows of a query and of its SQL, in order; what is no number compares as text."""
    folder, con = copies
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    got, want = registry.QUERIES[name](spark, folder), con.execute(registry.ORACLES[name])
    names = sorted(got.columns)
    at = [[d[0] for d in want.description].index(n) for n in names]
    return sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=repr), sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_precision_of_nothing_is_as_in_sql(spark, copies):
    """Every name is there three times, so no edge is found: SQL's share of nothing isn't a number."""
    got, want = both(spark, copies, "precision_recall")
    assert got == want and got[0][1:3] == (0, "nan")


def test_outcomes_of_copies(spark, copies):
    got, want = both(spark, copies, "resolve_outcomes")
    assert got == want and all(ambiguous for ambiguous, _, _ in got)


def test_resolution_sorts_spread_symbols_and_shares_calls(spark, copies):
    """Least and greatest texts are found by sorting: never of a scan as it is, which may be one task."""
    plan = registry.QUERIES["resolve_outcomes"](spark, copies[0])._jdf.queryExecution().executedPlan().toString().split("\n")
    sorts = [i for i, line in enumerate(plan) if "partial_min" in line or "partial_max(CASE" in line]
    assert sorts
    for i in sorts:
        below = next(line for line in plan[i + 1 :] if "Exchange" in line or "FileScan" in line)
        assert "Exchange" in below, plan[i]
    made = registry.QUERIES["resolve_outcomes"](spark, copies[0])
    made._jdf.collectToPython()
    final = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet [l_orderkey") == 1


def test_calls_from_nowhere_keep_their_nulls(spark):
    symbols = spark.createDataFrame([("a", "f", "m", "one", "func"), ("b", "g", "m", "two", "func"), ("c", "h", "m", "two", "func")], "id string, file string, module string, name string, kind string")
    calls = spark.createDataFrame([("x", None, None, "func", n, None, None) for n in ("one", "one", "two", "gone")] + [("y", "f", None, "func", "one", "q.z", "self")], "src_id string, src_file string, src_module string, src_kind string, name string, qualifier string, receiver string")
    aliases = spark.createDataFrame([("f", "q", "g", None), ("f", "q", "h", "two")], "file string, alias string, target_file string, target_name string")
    got = {(r.src_id, r.src_file, r.src_module, r["name"], r.tier, r.dst, r.primary) for r in resolve.outcomes(symbols, calls, aliases).collect()}
    assert got == {("x", None, None, "one", "global", "a", ""), ("x", None, None, "two", "global", None, ""), ("x", None, None, "gone", None, None, ""), ("y", "f", None, "one", "file", "a", "q")}
    more = calls.limit(0).union(spark.createDataFrame([("y", "f", "n", "func", "two", "q", "")], calls.schema))
    assert [(r.tier, r.dst) for r in resolve.outcomes(symbols, more, aliases).withColumn("x", F.lit(0)).collect()] == [("import", None)]


def test_sources_of_one_partition_are_parsed_by_many_tasks(spark):
    noise = F.concat_ws("", *(F.sha2(F.concat_ws("/", "id", F.lit(k)).cast("binary"), 256) for k in range(40)))
    sources = spark.range(2000, numPartitions=1).select(F.concat(F.lit("p/f"), "id", F.lit(".py")).alias("path"), F.concat(F.lit("# "), noise, F.lit("\ndef f():\n    g()\n")).alias("content"))
    parsed = tree.parsed_table(sources)
    assert parsed.select("symbols.name").where("name = array('f')").count() == 2000
    assert parsed.select(F.spark_partition_id().alias("part")).distinct().count() >= 3


def test_selectors_are_compared_with_texts_made_once(spark, copies):
    got, want = both(spark, copies, "selector_match")
    assert got == want and len(got) > 100
    plan = registry.QUERIES["selector_match"](spark, copies[0])._jdf.queryExecution().executedPlan().toString().split("\n")
    join = next(i for i, line in enumerate(plan) if "BroadcastNestedLoopJoin" in line)
    assert "regexp_replace" not in plan[join] and any("REPARTITION_BY_NUM" in line for line in plan[join:])
