"""Step views: which label each step has, which steps count, and whether runs are collapsed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import nullish

#: view: (label column, which steps: all, known or action, collapse runs)
VIEWS = {
    "wrapper_tool_all": ("tool_wrapper", "all", False),
    "semantic_tool_all": ("semantic_tool_clean", "all", False),
    "semantic_tool_no_unknown": ("semantic_tool_clean", "known", False),
    "semantic_tool_tool_action_only": ("semantic_tool_clean", "action", False),
    "collapsed_semantic_tool_tool_action_only": ("semantic_tool_clean", "action", True),
    "phase_all": ("phase_clean", "all", False),
    "phase_clean_tool_action_only": ("phase_clean", "action", False),
    "collapsed_phase_clean_tool_action_only": ("phase_clean", "action", True),
}


def view_steps(steps: DataFrame, views: list[str] | None = None) -> DataFrame:
    """(view, trace_id, step_id, label) of several views in one scan: each step makes its rows, runs are collapsed after.

    Null labels are unknown. An unknown view is an error.
    """
    names = list(VIEWS) if views is None else views
    if bad := [v for v in names if v not in VIEWS]:
        raise ValueError(f"unknown views: {bad}")
    action = F.col("is_tool_action") & ~F.col("command_artifact_flag") & ~F.col("is_no_tool_step")

    def one(name: str):
        column, which, _ = VIEWS[name]
        label = F.coalesce(column, F.lit("unknown"))
        keep = {"all": F.lit(True), "known": ~nullish(label), "action": action & ~nullish(label)}[which]
        return F.when(keep, F.struct(F.lit(name).alias("view"), label.alias("label")))

    rows = steps.select("trace_id", "step_id", F.explode(F.array_compact(F.array(*[one(n) for n in names]))).alias("v")).select("v.view", "trace_id", "step_id", "v.label")
    before = F.lag("label").over(Window.partitionBy("view", "trace_id").orderBy("step_id"))
    collapsed = [n for n in names if VIEWS[n][2]]
    if not collapsed:
        return rows
    return rows.withColumn("b", before).where(~F.col("view").isin(collapsed) | F.col("b").isNull() | (F.col("b") != F.col("label"))).drop("b")
