"""Scoped call resolution: which symbol does a call mean?

Tables: ``symbols(id, file, module, name, kind)`` with one row for each id,
``calls(src_id, src_file, src_module, src_kind, name, qualifier, receiver)`` and
``aliases(file, alias, target_file, target_name)``; a null ``target_name`` stands
for the name of the call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SELF = ("self", "this", "cls")
#: Scopes in the order in which they're asked; the first that knows the name decides.
TIERS = ("method", "file", "import", "module", "global")
CONFIDENCE = {"method": "resolved", "file": "resolved", "import": "heuristic", "module": "heuristic", "global": "heuristic"}
#: Ranks of confidences when the same edge comes from several calls.
RANKS = {"ambiguous": 1, "heuristic": 2, "resolved": 3}

_CALL = ["src_id", "src_file", "src_module", "src_kind", "name", "scoped", "primary"]
#: What an answer depends on, and a hash of it, which sorts faster.
_ASKED = ["src_file", "src_module", "name", "scoped", "primary"]
_QUESTION = ["hash", *_ASKED]
#: Stands for a null in keys; no path or module has it.
_NONE = "\0"


def _clean(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column), F.lit("")))


def _bounds(prefix: str, condition: Column | None = None) -> list[Column]:
    """Return the least and greatest id of a scope: it has one symbol just if these are equal, so no set of ids is held."""
    ids = F.col("id") if condition is None else F.when(condition, F.col("id"))
    return [F.min(ids).alias(f"{prefix}_lo"), F.max(ids).alias(f"{prefix}_hi")]


def normalized_calls(calls: DataFrame) -> DataFrame:
    """Return the distinct questions that calls ask, partitioned by what their answers depend on; blank names ask none.

    Calls are partitioned before repeats are left out, so both tables that are
    made of this, and the join of the two, need no other exchange of calls.
    """
    qualifier = _clean("qualifier")
    key = lambda c: F.coalesce(F.col(c), F.lit(_NONE)).alias(c)
    asked = calls.select(
        "src_id", key("src_file"), key("src_module"), "src_kind", _clean("name").alias("name"),
        (_clean("receiver").isin(*SELF) | qualifier.isin(*SELF)).alias("scoped"),
        F.coalesce(F.trim(F.split_part(qualifier, F.lit("."), F.lit(1))), F.lit("")).alias("primary"),  # never null, as Spark must know: else it filters one of both tables first
    ).where("name <> ''")
    return asked.withColumn("hash", F.xxhash64(*_ASKED)).repartition(*_QUESTION).distinct()


def _tiers(symbols: DataFrame, questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Return questions with the bounds of what each tier knows.

    Least and greatest texts are found by sorting, so symbols are spread first:
    a small file of very many symbols would be sorted by one task.
    """
    known = symbols.select("id", "file", "module", "name", "kind").repartition("id")
    per_file = known.groupBy("file", "name").agg(*_bounds("method", F.col("kind") == "method"), *_bounds("file"))
    per_module = known.groupBy("module", "name").agg(*_bounds("module"))
    overall = known.groupBy("name").agg(*_bounds("global"))
    own = ["method_lo", "method_hi", "file_lo", "file_hi"]
    key = F.when(F.col("primary") == "", F.col("name")).otherwise(F.col("primary"))
    targets = aliases.select(F.col("file").alias("src_file"), "alias", "target_file", "target_name")
    target = F.coalesce(F.nullif(F.trim("target_name"), F.lit("")), F.col("name"))
    there = per_file.select(F.col("file").alias("target_file"), F.col("name").alias("target"), F.col("file_lo").alias("there_lo"), F.col("file_hi").alias("there_hi"))
    return (
        questions.join(per_file.withColumnRenamed("file", "src_file"), ["src_file", "name"], "left").withColumn("alias", key)
        .join(targets, ["src_file", "alias"], "left").withColumn("target", target)
        .join(there, ["target_file", "target"], "left")
        .groupBy(*_QUESTION, *own).agg(F.min("there_lo").alias("import_lo"), F.max("there_hi").alias("import_hi"))
        .join(per_module.withColumnRenamed("module", "src_module"), ["src_module", "name"], "left")
        .join(overall, "name", "left")
    )


def outcomes(symbols: DataFrame, calls: DataFrame, aliases: DataFrame) -> DataFrame:
    """Return each distinct call with ``tier`` (null if nobody knows the name), ``dst`` (null unless the tier has just one symbol) and ``confidence``.

    A tier that knows the name decides, whether or not it has a single symbol.
    Candidates of a scope are two ids, so tables to join have one row for each
    name in it. Calls from the same file and module with the same name and
    qualifier have the same answer, so scopes are joined to one row for each of
    these, and calls once to the answers. A receiver like ``self`` asks the
    methods of the file first.
    """
    asked = normalized_calls(calls)
    questions = asked.groupBy(*_QUESTION).agg(F.count(F.lit(1)).alias("calls")).where("calls > 0")  # a count keeps the plan below that of the calls, so it runs once
    joined = _tiers(symbols, questions, aliases)
    known = {t: F.col(f"{t}_lo").isNotNull() for t in TIERS}
    known["method"] = F.col("scoped") & known["method"]

    def choose(value) -> Column:
        out = F.when(known[TIERS[0]], value(TIERS[0]))
        for tier in TIERS[1:]:
            out = out.when(known[tier], value(tier))
        return out

    answers = joined.select(
        *_QUESTION,
        choose(F.lit).alias("tier"),
        choose(lambda t: F.when(F.col(f"{t}_lo") == F.col(f"{t}_hi"), F.col(f"{t}_lo"))).alias("dst"),
    )
    found = asked.join(answers, _QUESTION, "left").select(*_CALL, "tier", "dst")
    return found.withColumns({c: F.nullif(c, F.lit(_NONE)) for c in ("src_file", "src_module")}).withColumn("confidence", F.when(F.col("dst").isNotNull(), F.when(F.col("tier").isin("method", "file"), "resolved").otherwise("heuristic")))


def edges_of(resolved: DataFrame) -> DataFrame:
    """Return ``(src, dst, confidence)``: one edge for each pair, with the greatest confidence; calls of oneself give none."""
    rank = F.when(F.col("confidence") == "resolved", 3).when(F.col("confidence") == "heuristic", 2).otherwise(1)
    pairs = resolved.where("dst is not null and dst <> src_id").groupBy(F.col("src_id").alias("src"), "dst").agg(F.max(rank).alias("rank"))
    return pairs.select("src", "dst", F.when(F.col("rank") == 3, "resolved").when(F.col("rank") == 2, "heuristic").otherwise("ambiguous").alias("confidence"))


def resolve(symbols: DataFrame, calls: DataFrame, aliases: DataFrame) -> DataFrame:
    """Return the edges of the call graph."""
    return edges_of(outcomes(symbols, calls, aliases))
