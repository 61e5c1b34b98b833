"""Analysis of paired runs of two arms.

A run is a row with ``run_id, task_id, arm, repeat, success, duration_seconds``,
exit codes and nullable measures; a missing measure counts as 0. Medians are
exact: of each group Spark holds the distinct values, which for run records (one
row a run) is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARMS = ("with_context", "without_context")
NUMBERS = (
    "duration_seconds", "total_cost_usd", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens",
    "step_count", "tool_call_count", "acceptance_cmd_count", "agent_exit_code", "acceptance_exit_code",
)
#: Names of measures as in results, and the columns that they add up.
MEASURES = {
    "cost_usd": ("total_cost_usd",),
    "duration_seconds": ("duration_seconds",),
    "non_cache_tokens": ("input_tokens", "output_tokens"),
    "cache_read_tokens": ("cache_read_tokens",),
    "cache_write_tokens": ("cache_write_tokens",),
    "total_tokens": ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"),
    "step_count": ("step_count",),
    "tool_call_count": ("tool_call_count",),
    "acceptance_cmd_count": ("acceptance_cmd_count",),
}


def _value(name: str) -> Column:
    return sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in MEASURES[name]), F.lit(0.0))


def _won() -> Column:
    return F.when(F.coalesce(F.col("success"), F.lit(False)), 1).otherwise(0)


def normalized(raw: DataFrame) -> DataFrame:
    """Return runs of which measures given as text are numbers; empty and unreadable ones are null."""
    texts = dict(raw.dtypes)
    return raw.withColumns({c: F.nullif(F.trim(c), F.lit("")).try_cast("double") for c in NUMBERS if texts.get(c) == "string"})


def broken() -> Column:
    """Tell whether the machinery failed rather than the run."""
    agent, check = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("agent_exit_code", "acceptance_exit_code"))
    return (agent == 86) | ((agent != 0) & (check == 99))


def totals(runs: DataFrame) -> DataFrame:
    """Return one row of counts: of all runs, of those that count, and of tasks."""
    return runs.agg(
        F.count(F.lit(1)).alias("run_count"), F.count_if(~broken()).alias("effective_run_count"),
        F.count_if(broken()).alias("excluded_infra_failures"), F.count_distinct("task_id").alias("task_count"),
    )


def arm_summary(runs: DataFrame) -> DataFrame:
    """Return a row for each arm: runs, successes, costs, and medians; runs that broke down don't count."""
    aggregated = runs.where(~broken()).groupBy("arm").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum(_won()).alias("successes"),
        F.sum(_value("cost_usd")).alias("total_cost_usd"),
        *[F.median(_value(m)).alias(f"median_{m}") for m in MEASURES],
    )
    return aggregated.withColumns({
        "success_rate": F.try_divide("successes", "runs"),
        "avg_cost_usd": F.try_divide("total_cost_usd", "runs"),
        "solved_per_dollar": F.try_divide("successes", "total_cost_usd"),
    })


def pairs(runs: DataFrame, order: str = "run_id", arms: tuple[str, str] = ARMS) -> DataFrame:
    """Return ``(task_id, repeat, d_<measure>...)``: differences of the arms' first runs, of each task and repeat that both have."""
    values = F.struct(_won().alias("pass"), *[_value(m).alias(m) for m in MEASURES])
    first = [F.min_by(F.when(F.col("arm") == a, values), F.when(F.col("arm") == a, F.col(order))).alias(f"arm{i}") for i, a in enumerate(arms)]
    both = runs.where(~broken()).groupBy("task_id", "repeat").agg(*first).where("arm0 is not null and arm1 is not null")
    return both.select("task_id", "repeat", *[(F.col(f"arm0.{m}") - F.col(f"arm1.{m}")).cast("double").alias(f"d_{m}") for m in ("pass", *MEASURES)])


def paired_summary(runs: DataFrame, order: str = "run_id", arms: tuple[str, str] = ARMS) -> DataFrame:
    """Return one row: the number of pairs, and mean and median of each difference."""
    measures = ("pass", *MEASURES)
    return pairs(runs, order, arms).agg(
        F.count(F.lit(1)).alias("paired_runs"),
        *[F.avg(f"d_{m}").alias(f"mean_{m}_delta") for m in measures],
        *[F.median(f"d_{m}").alias(f"median_{m}_delta") for m in measures],
    )


def decision(summary: DataFrame, arms: tuple[str, str] = ARMS) -> DataFrame:
    """Return one row ``(decision)`` from the arms' summaries: an arm that succeeds more often at no greater cost is preferred."""
    pick = [F.max(F.when(F.col("arm") == a, F.struct("success_rate", "avg_cost_usd"))).alias(f"a{i}") for i, a in enumerate(arms)]
    cost = [F.coalesce(f"a{i}.avg_cost_usd", F.lit(0.0)) for i in (0, 1)]
    rate = [F.col(f"a{i}.success_rate") for i in (0, 1)]
    said = (
        F.when(rate[0].isNull() | rate[1].isNull(), "insufficient data")
        .when((rate[0] > rate[1]) & (cost[0] <= cost[1]), f"prefer {arms[0]}")
        .when((rate[0] < rate[1]) & (cost[0] >= cost[1]), f"prefer {arms[1]}")
        .otherwise("mixed results - inspect paired deltas")
    )
    return summary.agg(*pick).select(said.alias("decision"))


def scraped(lines: DataFrame) -> DataFrame:
    """Return ``(run_id, label, value)`` of statistics lines ``(run_id, line)`` like ``Total Cost  $1,234.5``; others are left out."""
    pattern = r"^[^\w]*([A-Za-z][A-Za-z ]*?)\s*[:│|]?\s+\$?([0-9][0-9,]*(?:\.[0-9]+)?)[^\w]*$"
    label = F.lower(F.regexp_replace(F.trim(F.regexp_extract("line", pattern, 1)), r"\s+", "_"))
    value = F.regexp_replace(F.regexp_extract("line", pattern, 2), ",", "").try_cast("double")
    return lines.select("run_id", label.alias("label"), value.alias("value")).where("value is not null")


def event_counts(events: DataFrame) -> DataFrame:
    """Return ``(run_id, <counts>)`` from ``events(run_id, json)``: steps, tool calls, task tools, and commands by kind."""
    kind, tool, command = (F.coalesce(F.get_json_object("json", p), F.lit("")) for p in ("$.type", "$.part.tool", "$.part.state.input.command"))
    call = kind == "tool_use"
    return events.groupBy("run_id").agg(
        F.count_if(kind == "step_start").alias("step_count"), F.count_if(call).alias("tool_call_count"), F.count_if(call & (tool == "task")).alias("task_tool_call_count"),
        F.count_if(call & command.rlike(r"\bdoctor\b")).alias("doctor_count"), F.count_if(call & command.rlike(r"\bupdate\b")).alias("update_count"), F.count_if(call & command.rlike(r"\bsymbol\b")).alias("symbol_count"),
    )


def session_sums(sessions: DataFrame) -> DataFrame:
    """Return ``(run_id, label, value)`` of costs and tokens summed over the messages ``(run_id, json)`` of a run's sessions."""
    fields = {
        "total_cost_usd": "$.cost", "input_tokens": "$.tokens.input", "output_tokens": "$.tokens.output",
        "cache_read_tokens": "$.tokens.cache.read", "cache_write_tokens": "$.tokens.cache.write",
    }
    message = F.explode(F.coalesce(F.from_json(F.get_json_object("json", "$.messages"), "array<string>"), F.array(F.col("json")))).alias("m")
    spread = sessions.select("run_id", message)
    pairs = F.array(*[F.struct(F.lit(label).alias("label"), F.get_json_object("m", path).try_cast("double").alias("value")) for label, path in fields.items()])
    return spread.select("run_id", F.explode(pairs).alias("p")).where("p.value is not null").groupBy("run_id", F.col("p.label").alias("label")).agg(F.sum("p.value").alias("value"))


def preferred(sessions: DataFrame, statistics: DataFrame) -> DataFrame:
    """Return ``(run_id, label, value)``: what sessions add up to, and what statistics lines say only where sessions say nothing."""
    a, b = sessions.withColumnRenamed("value", "a"), statistics.groupBy("run_id", "label").agg(F.max("value").alias("b"))
    return a.join(b, ["run_id", "label"], "full").select("run_id", "label", F.coalesce("a", "b").alias("value"))
