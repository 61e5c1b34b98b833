"""The driver's tables as model tables, in Spark and, for comparison, in DuckDB SQL.

Parts are symbols: the brand is the file, the type the module. Within an order
each line's part calls, by name, the part of the next line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.functions.ids import cache_key
from lodeweave.storage import read


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return parts as symbols."""
    size = F.col("p_size").cast("string")
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("file"), F.col("p_type").alias("module"), F.concat_ws("_", "p_name", size).alias("name"),
        F.when(F.col("p_size") > 25, "method").otherwise("func").alias("kind"), F.col("p_partkey").cast("int").alias("line"),
        F.concat(F.col("p_name"), F.lit("("), F.col("p_type"), F.lit(")")).alias("signature"), F.concat_ws(" ", "p_name", "p_type").alias("doc"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return what parts call."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus")
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("src_id"), F.lead("l_partkey").over(order).cast("string").alias("next"), "l_returnflag", "l_linestatus").where("next is not null")
    known = symbols(spark, sf_dir)
    src = known.select(F.col("id").alias("src_id"), F.col("file").alias("src_file"), F.col("module").alias("src_module"), F.col("kind").alias("src_kind"))
    to = known.select(F.col("id").alias("next"), "name", F.col("module").alias("next_module"))
    return lines.join(to, "next").join(src, "src_id").select(  # repeats are left out when calls are asked
        "src_id", "src_file", "src_module", "src_kind", "name",
        F.when(F.col("l_linestatus") == "F", F.concat("next_module", F.lit(".x"))).otherwise("").alias("qualifier"),
        F.when(F.col("l_returnflag") == "R", "self").otherwise("").alias("receiver"),
    )


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return types as import aliases of brands: of other brands' files, half of them of a symbol in it."""
    known = symbols(spark, sf_dir)
    files = known.repartition("id").groupBy("file").agg(F.min("name").alias("least")).withColumn("i", F.row_number().over(Window.orderBy("file")))  # a row for each brand
    modules = known.select("module").distinct().withColumn("j", F.row_number().over(Window.orderBy("module")))  # a row for each type
    count = files.agg(F.max("i").alias("files"))
    pairs = files.crossJoin(modules).crossJoin(count).where("(i + j) % 3 = 0").select("file", F.col("module").alias("alias"), F.expr("(i + j) % files + 1").alias("i"), F.expr("j % 2 = 0").alias("named"))
    targets = files.select("i", F.col("file").alias("target_file"), "least")
    return pairs.join(targets, "i").select("file", "alias", "target_file", F.when(F.col("named"), F.col("least")).alias("target_name"))


SYMBOLS_SQL = """symbols AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand AS file, p_type AS module, p_name || '_' || CAST(p_size AS VARCHAR) AS name,
  CASE WHEN p_size > 25 THEN 'method' ELSE 'func' END AS kind, CAST(p_partkey AS INTEGER) AS line, p_name || '(' || p_type || ')' AS signature, p_name || ' ' || p_type AS doc FROM part)"""

_ASKED = "src_id, src_file, src_module, src_kind, name, scoped, prim"
OUTCOMES_SQL = f"""{SYMBOLS_SQL},
lines AS (SELECT CAST(l_partkey AS VARCHAR) AS src, CAST(lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_linestatus) AS VARCHAR) AS nxt, l_returnflag, l_linestatus FROM lineitem),
calls AS (SELECT DISTINCT s.id AS src_id, s.file AS src_file, s.module AS src_module, s.kind AS src_kind, d.name, CASE WHEN l_linestatus = 'F' THEN d.module || '.x' ELSE '' END AS qualifier, CASE WHEN l_returnflag = 'R' THEN 'self' ELSE '' END AS receiver
  FROM lines JOIN symbols s ON s.id = src JOIN symbols d ON d.id = nxt),
f AS (SELECT file, min(name) AS least, row_number() OVER (ORDER BY file) AS i FROM symbols GROUP BY file),
m AS (SELECT module, row_number() OVER (ORDER BY module) AS j FROM (SELECT DISTINCT module FROM symbols)),
aliases AS (SELECT f.file, m.module AS alias, t.file AS target_file, CASE WHEN m.j % 2 = 0 THEN t.least END AS target_name FROM f, m, f t WHERE (f.i + m.j) % 3 = 0 AND t.i = (f.i + m.j) % (SELECT count(*) FROM f) + 1),
asked AS (SELECT DISTINCT src_id, src_file, src_module, src_kind, name, receiver IN ('self', 'this', 'cls') OR qualifier IN ('self', 'this', 'cls') AS scoped, split_part(qualifier, '.', 1) AS prim FROM calls),
t1 AS (SELECT file, name, count(DISTINCT id) AS n, min(id) AS id FROM symbols WHERE kind = 'method' GROUP BY ALL),
t2 AS (SELECT file, name, count(DISTINCT id) AS n, min(id) AS id FROM symbols GROUP BY ALL),
t3 AS (SELECT a.src_file, a.name, a.prim, count(DISTINCT s.id) AS n, min(s.id) AS id FROM (SELECT DISTINCT src_file, name, prim FROM asked) a JOIN aliases x ON x.file = a.src_file AND x.alias = CASE WHEN a.prim = '' THEN a.name ELSE a.prim END
  JOIN symbols s ON s.file = x.target_file AND s.name = coalesce(x.target_name, a.name) GROUP BY ALL),
t4 AS (SELECT module, name, count(DISTINCT id) AS n, min(id) AS id FROM symbols GROUP BY ALL),
t5 AS (SELECT name, count(DISTINCT id) AS n, min(id) AS id FROM symbols GROUP BY ALL),
tiers AS (SELECT a.*, CASE WHEN scoped AND t1.n > 0 THEN 'method' WHEN t2.n > 0 THEN 'file' WHEN t3.n > 0 THEN 'import' WHEN t4.n > 0 THEN 'module' WHEN t5.n > 0 THEN 'global' END AS tier,
  t1.n AS n1, t1.id AS id1, t2.n AS n2, t2.id AS id2, t3.n AS n3, t3.id AS id3, t4.n AS n4, t4.id AS id4, t5.n AS n5, t5.id AS id5
  FROM asked a LEFT JOIN t1 ON t1.file = a.src_file AND t1.name = a.name LEFT JOIN t2 ON t2.file = a.src_file AND t2.name = a.name LEFT JOIN t3 ON t3.src_file = a.src_file AND t3.name = a.name AND t3.prim = a.prim
  LEFT JOIN t4 ON t4.module = a.src_module AND t4.name = a.name LEFT JOIN t5 ON t5.name = a.name),
outcomes AS (SELECT {_ASKED}, tier, CASE tier WHEN 'method' THEN CASE WHEN n1 = 1 THEN id1 END WHEN 'file' THEN CASE WHEN n2 = 1 THEN id2 END WHEN 'import' THEN CASE WHEN n3 = 1 THEN id3 END
  WHEN 'module' THEN CASE WHEN n4 = 1 THEN id4 END WHEN 'global' THEN CASE WHEN n5 = 1 THEN id5 END END AS dst FROM tiers)"""

EDGES_SQL = f"""{OUTCOMES_SQL},
edges AS MATERIALIZED (SELECT src_id AS src, dst, CASE WHEN bool_or(tier IN ('method', 'file')) THEN 'resolved' ELSE 'heuristic' END AS confidence FROM outcomes WHERE dst IS NOT NULL AND dst <> src_id GROUP BY ALL)"""


def plain_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return orders and the parts in them as nodes."""
    lines = read(spark, sf_dir, "lineitem")
    return lines.select(F.explode(F.array(F.concat(F.lit("o"), "l_orderkey"), F.concat(F.lit("p"), "l_partkey"))).alias("id")).distinct()


def plain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return edges from orders to the parts in them; parts have none out."""
    return read(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return customers and suppliers, nations and regions as files of a snapshot: each depends on what it lies in."""
    named = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"))
    nothing = F.array().cast("array<string>")
    parts = [
        ("customer", named("c", "c_custkey"), F.array(named("n", "c_nationkey")), F.col("c_name")),
        ("supplier", named("s", "s_suppkey"), F.array(named("n", "s_nationkey")), F.col("s_name")),
        ("nation", named("n", "n_nationkey"), F.array(named("r", "n_regionkey")), F.col("n_name")),
        ("region", named("r", "r_regionkey"), nothing, F.col("r_name")),
    ]
    out = None
    for table, path, deps, name in parts:
        one = read(spark, sf_dir, table).select(path.alias("path"), F.substring(F.sha2(name.cast("binary"), 256), 1, 16).alias("hash"), deps.alias("deps"))
        out = one if out is None else out.unionByName(one)
    return out


GEOGRAPHY_SQL = """snap AS (SELECT 'c' || c_custkey AS path, substr(sha256(c_name), 1, 16) AS hash, ['n' || c_nationkey] AS deps FROM customer UNION ALL SELECT 's' || s_suppkey, substr(sha256(s_name), 1, 16), ['n' || s_nationkey] FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, substr(sha256(n_name), 1, 16), ['r' || n_regionkey] FROM nation UNION ALL SELECT 'r' || r_regionkey, substr(sha256(r_name), 1, 16), CAST([] AS VARCHAR[]) FROM region),
deps AS (SELECT path, unnest(deps) AS dep FROM snap)"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Return orders as two snapshots: those up to 1999, and those since 1996, of which the ones of 1998 are another version."""
    year, nothing = F.year("o_orderdate"), F.array().cast("array<string>")
    orders = read(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("path"), F.concat_ws("|", "o_orderstatus", "o_orderpriority").alias("body"), year.alias("year"))
    digest = lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 16).alias("hash")
    old = orders.where("year <= 1999").select("path", digest(F.col("body")), F.array(F.col("year").cast("string")).alias("deps"))
    new = orders.where("year >= 1996").select("path", digest(F.when(F.col("year") == 1998, F.concat("body", F.lit("|again"))).otherwise(F.col("body"))), nothing.alias("deps"))
    return old, new


SNAPSHOTS_SQL = """o AS (SELECT 'o' || o_orderkey AS path, o_orderstatus || '|' || o_orderpriority AS body, year(o_orderdate) AS y FROM orders),
old AS (SELECT path, substr(sha256(body), 1, 16) AS hash, [CAST(y AS VARCHAR)] AS deps FROM o WHERE y <= 1999),
cur AS (SELECT path, substr(sha256(CASE WHEN y = 1998 THEN body || '|again' ELSE body END), 1, 16) AS hash, CAST([] AS VARCHAR[]) AS deps FROM o WHERE y >= 1996),
diff AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'deleted' WHEN a.path IS NULL THEN 'added' WHEN a.hash <> b.hash THEN 'changed' END AS change FROM old a FULL JOIN cur b ON a.path = b.path)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return orders as runs of two arms: the customer's parity is the arm, the priority the task."""
    orders = read(spark, sf_dir, "orders")
    arm = F.when(F.col("o_custkey") % 2 == 0, "with_context").otherwise("without_context")
    repeat = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    return orders.select(
        key.alias("run_id"), F.concat_ws("/", "o_orderpriority", (F.floor(F.col("o_custkey") / 2)).cast("string")).alias("task_id"), arm.alias("arm"), repeat.cast("int").alias("repeat"), (F.col("o_orderstatus") == "F").alias("success"),
        (key % 97).cast("double").alias("duration_seconds"), F.when(F.col("o_orderstatus") != "P", F.floor(price / 100)).cast("double").alias("total_cost_usd"),
        (key % 1000).cast("double").alias("input_tokens"), F.nullif(key % 10, F.lit(3)).cast("double").alias("output_tokens"), F.nullif(key % 7, F.lit(0)).cast("double").alias("cache_read_tokens"), (key % 5).cast("double").alias("cache_write_tokens"),
        (key % 11).cast("double").alias("step_count"), (key % 13).cast("double").alias("tool_call_count"), F.lit(None).cast("double").alias("acceptance_cmd_count"),
        F.when(F.col("o_orderpriority") == "5-LOW", key % 87).cast("double").alias("agent_exit_code"), F.when(price > 300000, 99).otherwise(0).cast("double").alias("acceptance_exit_code"),
    )


RUNS_SQL = """runs AS (SELECT o_orderkey AS run_id, o_orderpriority || '/' || CAST(o_custkey // 2 AS VARCHAR) AS task_id, CASE WHEN o_custkey % 2 = 0 THEN 'with_context' ELSE 'without_context' END AS arm,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS repeat, o_orderstatus = 'F' AS success, CAST(o_orderkey % 97 AS DOUBLE) AS duration_seconds, coalesce(CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice / 100) END, 0) AS cost_usd,
  (o_orderkey % 1000) + coalesce(nullif(o_orderkey % 10, 3), 0) AS non_cache_tokens, CAST(o_orderkey % 7 AS DOUBLE) AS cache_read_tokens, CAST(o_orderkey % 5 AS DOUBLE) AS cache_write_tokens,
  CAST(o_orderkey % 11 AS DOUBLE) AS step_count, CAST(o_orderkey % 13 AS DOUBLE) AS tool_call_count, CAST(0 AS DOUBLE) AS acceptance_cmd_count,
  coalesce(CASE WHEN o_orderpriority = '5-LOW' THEN o_orderkey % 87 END, 0) AS agent_code, CASE WHEN o_totalprice > 300000 THEN 99 ELSE 0 END AS check_code FROM orders),
good AS (SELECT *, CAST(non_cache_tokens AS DOUBLE) + cache_read_tokens + cache_write_tokens AS total_tokens, CASE WHEN success THEN 1 ELSE 0 END AS pass FROM runs WHERE NOT (agent_code = 86 OR (agent_code <> 0 AND check_code = 99)))"""


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return events as annotation records, with a line number; times are event ids, of which every third is in ``updated_at``."""
    events = read(spark, sf_dir, "events").withColumn("time", F.lpad(F.col("event_id").cast("string"), 12, "0"))
    user, value = F.col("user_id").cast("string"), F.floor("value").cast("string")
    return events.select(
        user.alias("symbol_id"), F.col("event_type").alias("profile"), cache_key(user, value, F.lit("p1"), F.col("event_type"), F.lit(" m ")).alias("cache_key"),
        F.col("time").alias("generated_at"), F.when(F.col("event_id") % 3 == 0, F.col("time")).otherwise("").alias("updated_at"), F.col("event_id").alias("line"),
    )


ANNOTATIONS_SQL = """ann AS (SELECT CAST(user_id AS VARCHAR) AS symbol_id, event_type AS profile,
  'cache-v1-' || substr(sha256(CAST(user_id AS VARCHAR) || '|' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '|p1|' || event_type || '|m'), 1, 16) AS cache_key,
  lpad(CAST(event_id AS VARCHAR), 12, '0') AS generated_at, CASE WHEN event_id % 3 = 0 THEN lpad(CAST(event_id AS VARCHAR), 12, '0') ELSE '' END AS updated_at, event_id AS line FROM events),
loaded AS (SELECT * EXCLUDE place FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY CASE WHEN updated_at = '' THEN generated_at ELSE updated_at END DESC, line DESC) AS place FROM ann) WHERE place = 1)"""
