"""Expert routing: gate statistics, rankings, pivots, and ordered log analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gate_means(gates: DataFrame, expert: str, layer: str, mode: str, value: str) -> DataFrame:
    """Event-weighted means by expert, by layer and expert, and by mode and expert, in one pass."""
    sets = [[F.col(expert)], [F.col(layer), F.col(expert)], [F.col(mode), F.col(expert)]]
    return gates.groupingSets(sets, layer, mode, expert).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def dominant(means: DataFrame, group: list[str], expert: str, value: str, collapse: float = 0.8) -> DataFrame:
    """The expert with the largest mean of each group (the first by name of equals), and whether it holds all."""
    first = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(value), expert))
    return means.withColumn("_r", first).filter("_r = 1").drop("_r").withColumn("collapsed", F.col(value) >= collapse)


def ranking(gates: DataFrame, expert: str, value: str) -> DataFrame:
    means = gates.groupBy(expert).agg(F.avg(value).alias("mean"))
    return means.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean"), expert)))  # a row per expert


def scoped_summary(rows: DataFrame, group: list[str], in_response: str, experts: list[str]) -> DataFrame:
    """Means and top expert (first of equals) over all tokens and over the response; empty scopes give no row."""
    scopes = F.when(F.col(in_response), F.array(F.lit("full"), F.lit("response"))).otherwise(F.array(F.lit("full")))
    means = rows.withColumn("scope", F.explode(scopes)).groupBy(*group, "scope").agg(F.count("*").alias("num_tokens"), *(F.avg(e).alias(f"{e}_mean") for e in experts))
    top = F.greatest(*(F.col(f"{e}_mean") for e in experts))
    name = F.coalesce(*(F.when(F.col(f"{e}_mean") == top, e) for e in experts))
    return means.withColumn("top_expert", name).withColumn("top_mean", top)


def pivoted(rows: DataFrame, group: str, column: str, values: list[str], measure: Column) -> DataFrame:
    """Measure by group and the given column values; 0 where there is none."""
    return rows.groupBy(group).pivot(column, values).agg(measure).na.fill(0.0)


def carried_gap(events: DataFrame, group: str, order: str, kind: str, train: str, evaluation: str, value: str) -> DataFrame:
    """At each row the last known training and evaluation value of the group, and their gap once both are known."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    a = F.last(F.when(F.col(kind) == train, F.col(value)), ignorenulls=True).over(w)
    b = F.last(F.when(F.col(kind) == evaluation, F.col(value)), ignorenulls=True).over(w)
    return events.withColumn("train", a).withColumn("eval", b).filter("train IS NOT NULL AND eval IS NOT NULL").withColumn("gap", F.col("eval") - F.col("train"))


def span_flags(rows: DataFrame, group: str, order: str, opens: Column, closes: Column) -> DataFrame:
    """Adds in_span: after the first opening row of the group and before the first closing row behind it."""
    by = Window.partitionBy(group)
    start = F.min(F.when(opens, F.col(order))).over(by)
    marked = rows.withColumn("_start", start)
    stop = F.min(F.when(closes & (F.col(order) > F.col("_start")), F.col(order))).over(by)
    inside = (F.col(order) > F.col("_start")) & (F.col("_stop").isNull() | (F.col(order) < F.col("_stop")))
    return marked.withColumn("_stop", stop).withColumn("in_span", F.coalesce(inside, F.lit(False))).drop("_start", "_stop")


def early_stop(rows: DataFrame, group: str, order: str, loss: str, patience: int) -> DataFrame:
    """Rows up to and with the one where the best loss has not improved ``patience`` times in a row."""
    w = Window.partitionBy(group).orderBy(order)
    best_before = F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = rows.withColumn("improved", best_before.isNull() | (F.col(loss) < best_before))
    run = F.sum(F.col("improved").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    stale = F.row_number().over(Window.partitionBy(group, "_run").orderBy(order)) - 1
    counted = better.withColumn("_run", run).withColumn("stale", stale)
    stop = F.min(F.when(F.col("stale") >= patience, F.col(order))).over(Window.partitionBy(group))
    return counted.withColumn("_stop", stop).filter((F.col("_stop").isNull()) | (F.col(order) <= F.col("_stop"))).drop("_run", "_stop")


def layer_picks(rows: DataFrame, name: str, mode: str) -> DataFrame:
    """The deepest layer in token mode and the shallowest in sequence mode; a name without a number is layer -1."""
    index = F.regexp_extract(name, r"(\d+)", 1)
    numbered = rows.withColumn("layer", F.when(index == "", -1).otherwise(index.cast("int")))
    return numbered.groupBy(mode).agg(F.max("layer").alias("deepest"), F.min("layer").alias("shallowest"))


def parse_trace(lines: DataFrame, line_no: str, text: str, trace: str | None = None) -> DataFrame:
    """Routing rows of a printed trace: case, layer, mode, row, token, and the gates as an array.

    Headers carry forward over lines; a mode line begins a new case. The last three fields of a row, split at
    "|" from the right, are numbers; a line that has none is no row. With ``trace``, the name of the file that a
    line is from, files are parsed side by side and each row keeps its name; without, the lines are one file.
    """
    file = [trace] if trace else []
    w = Window.partitionBy(*file).orderBy(line_no).rowsBetween(Window.unboundedPreceding, 0)
    mode = F.nullif(F.regexp_extract(text, r"(?i)^\s*mode\s*[:=]\s*(\S+)", 1), F.lit(""))
    case = F.nullif(F.regexp_extract(text, r"(?i)^\s*case\s*[:=]\s*(.+?)\s*$", 1), F.lit(""))
    layer = F.nullif(F.regexp_extract(text, r"Showing Probabilities for Layer:\s*(\S+)", 1), F.lit(""))
    pattern = r"^(.*)\|([^|]*)\|([^|]*)\|([^|]*)$"
    marked = lines.withColumn("mode", F.last(mode, ignorenulls=True).over(w)).withColumn("layer", F.last(layer, ignorenulls=True).over(w)).withColumn("_modes", F.count(mode).over(w))
    within = Window.partitionBy(*file, "_modes").orderBy(line_no).rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("case", F.coalesce(F.last(case, ignorenulls=True).over(within), F.lit("French")))
    gates = F.array(*(F.expr(f"try_cast(trim(regexp_extract({text}, '{pattern}', {k})) AS double)".replace("\\", "\\\\")) for k in (2, 3, 4)))
    rows = marked.withColumn("token", F.trim(F.regexp_extract(text, pattern, 1))).withColumn("gates", gates)
    rows = rows.filter(F.col("layer").isNotNull() & F.col(text).rlike(pattern) & ~F.exists("gates", lambda g: g.isNull()))
    place = F.row_number().over(Window.partitionBy(*file, "mode", "case", "layer").orderBy(line_no)) - 1
    return rows.withColumn("row", place).select(*file, "mode", "case", "layer", "row", "token", "gates")
