"""Graph operators over ``nodes(id, ...)`` and ``edges(src, dst, confidence)``.

Loops run on the driver, a round a job; each round's table is written to the
shared folder and read again, so plans don't grow and a lost executor costs one
round. What the driver sees of a round is a count or a sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.storage import Rounds

DAMPING, ITERATIONS = 0.85, 20
#: Nodes and edges that one task may hold.
SMALL = 1_000_000


def neighbours(edges: DataFrame, wanted: DataFrame, symbols: DataFrame, incoming: bool) -> DataFrame:
    """Return the callers (``incoming``) or callees of each ``wanted(id)`` that are known symbols, with the edge's confidence."""
    mine, other = ("dst", "src") if incoming else ("src", "dst")
    near = edges.join(wanted.select(F.col("id").alias(mine)).distinct(), mine, "left_semi")
    return near.join(symbols.withColumnRenamed("id", other), other).withColumn("confidence", F.coalesce("confidence", F.lit("")))


def adjacency(edges: DataFrame) -> DataFrame:
    """Return ``(id, out_edges, in_edges)`` with sorted lists. Edges are read once: each becomes a row for either end."""
    none = F.lit(None).cast("string")
    ends = F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("o"), none.alias("i")), F.struct(F.col("dst").alias("id"), none.alias("o"), F.col("src").alias("i")))
    both = edges.select(F.explode(ends).alias("e")).select("e.*")
    return both.groupBy("id").agg(F.sort_array(F.collect_set("o")).alias("out_edges"), F.sort_array(F.collect_set("i")).alias("in_edges"))


def rendered(edges: DataFrame) -> DataFrame:
    """Return ``(src, targets)``: each source's edges as text, with confidences, sorted."""
    one = F.concat(F.col("dst"), F.lit("{"), F.coalesce(F.nullif("confidence", F.lit("")), F.lit("heuristic")), F.lit("}"))
    return edges.groupBy("src").agg(F.array_join(F.sort_array(F.collect_list(one)), ", ").alias("targets"))


def file_dependencies(edges: DataFrame, symbols: DataFrame, least: int = 1) -> DataFrame:
    """Return ``(src_file, dst_file, n)``: pairs of other files with ``least`` edges or more."""
    files = symbols.select("id", "file")
    a, b = files.select(F.col("id").alias("src"), F.col("file").alias("src_file")), files.select(F.col("id").alias("dst"), F.col("file").alias("dst_file"))
    return edges.join(a, "src").join(b, "dst").where("src_file <> dst_file").groupBy("src_file", "dst_file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _ranked_here(rows: DataFrame, iterations: int, damping: float) -> DataFrame:
    """Return ranks of a graph of bounded size, made by one task: the same rounds, on arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None:
            return
        src, dst = (c.combine_chunks() for c in table.columns)
        nodes = pc.unique(src.filter(pc.is_null(dst)))
        every = pc.unique(pa.concat_arrays([nodes, src, dst.drop_null()]))  # nodes come first
        n, size, real = len(nodes), len(every), pc.is_valid(dst)
        pairs = np.unique(pc.index_in(src.filter(real), every).to_numpy().astype(np.int64) * size + pc.index_in(dst.drop_null(), every).to_numpy())
        a, b = np.divmod(pairs, size)
        degree = np.bincount(a, minlength=size)[a]
        base, rank = 1 / n, np.full(size, 1 / n)
        for _ in range(iterations):
            flow = np.bincount(b, rank[a] / degree, size)
            base = (1 - damping) / n + damping * (1 - flow.sum()) / n
            rank = base + damping * flow
        yield pa.RecordBatch.from_arrays([nodes, pa.array(rank[:n])], names=["id", "rank"])

    return rows.coalesce(1).mapInArrow(run, "id string, rank double")


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING, small: int = SMALL) -> DataFrame:
    """Return ``(id, rank)`` after a fixed number of synchronous rounds.

    What a round gathers is the sum that flows into each node; its total tells
    the mass of nodes without edges out, which is what's missing from one. So a
    rank is a constant plus a multiple of the flow, ranks themselves are never
    stored, and a round joins the flow to the edges, which stay partitioned by
    source, and sums by target: of the edges nothing but partial sums moves.
    Edges from nodes that no edge leads to are summed once, for all rounds.

    Nodes and edges are written once and counted. Up to ``small`` rows of both
    (some hundred bytes each) one task makes the same rounds by itself, which
    saves a job a round; a greater graph is never gathered.
    """
    spark = nodes.sparkSession
    rounds = Rounds(spark, "pagerank")
    rows = rounds.settle(nodes.select(F.col("id").cast("string").alias("src"), F.lit(None).cast("string").alias("dst")).unionByName(edges.select("src", "dst").where("src is not null and dst is not null")))
    n, total = rows.agg(F.count_if(F.col("dst").isNull()), F.count(F.lit(1))).first()
    if total <= small or n == 0:
        return _ranked_here(rows if n else rows.limit(0), iterations, damping)
    ids = rounds.settle(rows.where("dst is null").select(F.col("src").alias("id")).distinct())
    n = ids.count()
    fixed, fed = split_links(rows.where("dst is not null").distinct(), rounds)
    fed = fed.repartition("src").persist(StorageLevel.MEMORY_AND_DISK)
    base, flow = 1 / n, None
    for k in range(iterations):
        share = fixed.select("dst", (F.lit(base) * F.col("weight")).alias("x"))
        if flow is None:
            moved = fed.select("dst", (F.lit(base) / F.col("degree")).alias("x"))
        else:
            rank = F.lit(base) + damping * F.col("flow")
            moved = fed.join(flow.withColumnRenamed("id", "src"), "src").select("dst", (rank / F.col("degree")).alias("x"))
        flow = rounds.settle(share.unionByName(moved).groupBy(F.col("dst").alias("id")).agg(F.sum("x").alias("flow")))
        base = (1 - damping) / n + damping * (1 - (flow.agg(F.sum("flow")).first()[0] or 0.0)) / n
        if k:
            rounds.forget(1)
    fed.unpersist()
    if flow is None:
        return ids.withColumn("rank", F.lit(1 / n))
    return ids.join(flow, "id", "left").select("id", (F.lit(base) + damping * F.coalesce("flow", F.lit(0.0))).alias("rank"))


def split_links(known: DataFrame, rounds: Rounds) -> tuple[DataFrame, DataFrame]:
    """Part distinct ``known(src, dst)`` by whether an edge leads to their source.

    Nodes without edges in all have the same rank in every round, so what flows
    from them into a node is that rank times a sum of inverse degrees, which is
    made once: ``(dst, weight)``. Edges from other nodes are ``(src, dst, degree)``.
    """
    degree = known.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    reached = known.select(F.col("dst").alias("src")).distinct().withColumn("reached", F.lit(True))
    links = rounds.settle(known.join(degree.join(reached, "src", "left"), "src").select("src", "dst", "degree", F.coalesce("reached", F.lit(False)).alias("reached")))
    fixed = rounds.settle(links.where("not reached").groupBy("dst").agg(F.sum(1 / F.col("degree")).alias("weight")))
    return fixed, links.where("reached").drop("reached")


def top_nodes(ranks: DataFrame, n: int = 20) -> DataFrame:
    """Return the ``n`` nodes of greatest rank; ties go to the smaller id."""
    return ranks.orderBy(F.desc("rank"), "id").limit(n)


def depths(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """Return ``(id, depth)``: every node that ``starts(id)`` reach, and by how many edges at least; up to depth ``most``."""
    rounds = Rounds(edges.sparkSession, "depths")
    links = edges.select("src", "dst").distinct()
    frontier = rounds.settle(starts.select("id").distinct().withColumn("depth", F.lit(0)))
    schema, depth = frontier.schema, 0
    while (most is None or depth < most) and not frontier.isEmpty():
        depth += 1
        seen = rounds.all(schema)
        reached = links.join(frontier.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = rounds.settle(reached.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
    return rounds.all(schema)


def trace(edges: DataFrame, starts: DataFrame, depth: int = 1) -> DataFrame:
    """Return ``(src, dst, confidence, depth)``: all edges out of nodes nearer than ``depth``, also those that lead back."""
    depth = max(1, depth)
    near = depths(edges, starts, depth - 1)
    return edges.join(near.select(F.col("id").alias("src"), (F.col("depth") + 1).alias("depth")), "src").select("src", "dst", "confidence", "depth")


def shortest_path(edges: DataFrame, start: str, goal: str) -> list[str] | None:
    """Return the ids of a shortest path, of several the least; none if there is none.

    A round keeps the least path to each node that is new. Of a node's paths of
    least length, the one that breadth-first search over sorted edges finds is
    the least, so both find the same.
    """
    if start == goal:
        return [start]
    spark = edges.sparkSession
    rounds = Rounds(spark, "paths")
    links = edges.select("src", "dst").distinct()
    frontier = rounds.settle(spark.range(1).select(F.lit(start).alias("id"), F.array(F.lit(start)).alias("path")))
    schema = frontier.schema
    while True:
        seen = rounds.all(schema)
        steps = links.join(frontier.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), F.array_append("path", F.col("dst")).alias("path"))
        fresh = steps.groupBy("id").agg(F.min("path").alias("path"))
        frontier = rounds.settle(fresh.join(seen.select("id"), "id", "left_anti").select("id", "path"))
        found = frontier.where(F.col("id") == goal).first()
        if found is not None:
            return list(found["path"])
        if frontier.isEmpty():
            return None


def path_edges(edges: DataFrame, path: list[str]) -> DataFrame:
    """Return ``(pos, src, dst, confidence)`` for consecutive nodes of a path."""
    pairs = [(i, a, b) for i, (a, b) in enumerate(zip(path, path[1:], strict=False), 1)]
    steps = edges.sparkSession.createDataFrame(pairs, "pos int, src string, dst string")
    found = edges.select("src", "dst", "confidence").join(steps, ["src", "dst"], "right")
    return found.select("pos", "src", "dst", F.coalesce("confidence", F.lit("")).alias("confidence"))


def quality(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Return ``(true_positives, found, expected, precision, recall)`` of distinct ``(src, dst)`` pairs; shares of nothing are 0."""
    a, b = found.select("src", "dst").distinct().withColumn("f", F.lit(1)), expected.select("src", "dst").distinct().withColumn("e", F.lit(1))
    counts = a.join(b, ["src", "dst"], "full").agg(F.count(F.col("f") + F.col("e")).alias("true_positives"), F.count("f").alias("found"), F.count("e").alias("expected"))
    share = lambda d: F.when(F.col(d) == 0, 0.0).otherwise(F.col("true_positives") / F.col(d))
    return counts.withColumns({"precision": share("found"), "recall": share("expected")})
