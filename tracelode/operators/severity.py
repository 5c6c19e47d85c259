"""Severity: abstract costs of repetition and waste from fixed coefficients, and verdicts. A proxy, not a measurement of speed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Names of strategies and of cost components. Two names of strategies, and those of the hypotheses, are shorter than the published ones, which hold a name that this engine does not use.
INDEPENDENT, SESSION, ORACLE, PREDICTED, WRONG, TYPE_ONLY = "independent_call", "session_affinity", "oracle_upper_bound", "predicted", "wrong_prediction_stress", "object_type_only"
COMPONENTS = ["repeated_object_bytes", "estimated_redundant_prefill_tokens", "failure_loop_wasted_steps_proxy", "object_movement_bytes_proxy", "kv_eviction_opportunity_loss_proxy"]


def gain(early: DataFrame) -> DataFrame:
    """One row: the largest recall that early prediction wins over metadata (see against_metadata()), 0 at least."""
    return early.agg(F.greatest(F.coalesce(F.max("delta_vs_best_metadata_baseline"), F.lit(0.0)), F.lit(0.0)).alias("gain"))


def components(steps: DataFrame, objects: DataFrame, traces: DataFrame, won: DataFrame) -> DataFrame:
    """One row: repeated bytes r of stable and actionable objects, prompt tokens p, wasted actions w (success false; null does not count), and the strategies' reductions. won: gain()."""
    o = objects.where("stable_object and actionable_object").groupBy("trace_id", "object_id").agg(F.sum("object_size").cast("double").alias("bytes"), F.count("*").alias("n"))
    r = o.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("bytes") - F.col("bytes") / F.col("n"))), F.lit(0.0)).alias("r"))
    p = traces.agg(F.coalesce(F.sum(0.15 * F.col("input_tokens")), F.lit(0.0)).alias("p"))
    w = steps.where("is_tool_action").join(traces.where("not success").select("trace_id"), "trace_id", "left_semi").agg(F.count("*").cast("double").alias("w"))
    c = F.col
    # The coefficients here and in breakdown(), and the thresholds in verdicts() and conclusion(), are the published ones
    df = r.join(F.broadcast(p)).join(F.broadcast(w)).join(F.broadcast(won))  # four single rows
    df = df.withColumn("base", c("r") + c("p") + 500 * c("w")).withColumn("session", 0.20 * c("r")).withColumn("oracle", 0.65 * c("r") + 0.25 * c("p") + 250 * c("w"))
    return df.withColumn("predicted", c("session") + c("oracle") * F.least(F.lit(0.35), 0.10 + c("gain"))).withColumn("wrong", 0.85 * c("session")).withColumn("type_only", 0.95 * c("session"))


def strategies(parts: DataFrame) -> DataFrame:
    """(strategy, estimated_cost, reduction_vs_independent) of six strategies."""
    c = F.col
    rows = [(INDEPENDENT, F.lit(0.0)), (SESSION, c("session")), (ORACLE, c("oracle")), (PREDICTED, c("predicted")), (WRONG, c("wrong")), (TYPE_ONLY, c("type_only"))]
    return parts.select("base", F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), x.alias("reduction")) for n, x in rows])).alias("x")).select("x.strategy", F.round(c("base") - c("x.reduction"), 3).alias("estimated_cost"), F.round("x.reduction", 3).alias("reduction_vs_independent"))


def opportunity(costs: DataFrame) -> DataFrame:
    """Of strategies(), those that save something."""
    return costs.where(F.col("strategy") != INDEPENDENT)


def breakdown(parts: DataFrame) -> DataFrame:
    """(component, cost): what the cost is made of."""
    c = F.col
    amounts = [c("r"), c("p"), 500 * c("w"), 0.3 * c("r"), 0.2 * c("p")]
    return parts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("component"), F.round(x, 3).alias("cost")) for n, x in zip(COMPONENTS, amounts)])).alias("x")).select("x.*")


#: Views that the first hypothesis is about.
CLEAN = ["semantic_tool_tool_action_only", "collapsed_semantic_tool_tool_action_only"]


def verdicts(recall: DataFrame, ci: DataFrame, tests: DataFrame, motifs: DataFrame, deps: DataFrame, preds: DataFrame, early: DataFrame, failure: DataFrame) -> DataFrame:
    """(hypothesis, verdict) for six hypotheses at fixed thresholds, from result tables of a few rows each: supported, partially supported or not supported."""
    yes, no = (lambda c: F.coalesce(c, F.lit(False))), F.lit(False)
    of = lambda df: df.where(F.col("view").isin(CLEAN))
    best = of(recall).where("k = 3").agg(F.max("delta").alias("delta")).join(F.broadcast(of(ci).agg(F.max("low").alias("low")))).join(F.broadcast(of(tests).agg(F.min("p").alias("p"))))  # single rows
    horizons = preds.where("granularity = 'exact_object_id' and horizon in (3, 5, 10)")
    mean = lambda name: F.avg(F.when(F.col("baseline") == name, F.col("recall")))
    better = F.count_if(F.col("delta_vs_best_metadata_baseline") > 0)
    score = failure.where("metric = 'failure_loop_score'")
    up = F.bool_or(F.col("delta_failure_minus_success") > 0)
    rows = {
        "H1": (best, yes(F.bool_or((F.col("delta") > 0.08) & (F.col("low") > 0) & (F.col("p") < 0.05))), no),
        "H2": (motifs, yes((F.count_if("appears_in_heldout") >= 3) & (F.max("support_harnesses") > 1)), yes(F.bool_or("appears_in_heldout"))),
        "H3": (deps, yes((F.sum("count") > 0) & (F.coalesce(F.median("median_distance"), F.lit(999.0)) <= 5)), no),
        "H4": (horizons, yes(mean("lastK_object") > F.greatest(F.coalesce(mean("random_same_count"), F.lit(-1.0)), F.coalesce(mean("object_type_only"), F.lit(-1.0))) + 0.05), no),
        "H5": (early.where("baseline in ('lastK', 'early_markov') and k in (3, 5, 8)"), yes(better >= 2), yes(better > 0)),
        "H6": (score, yes(up & F.bool_or(F.col("p_value") < 0.05)), yes(up)),
    }
    out = None
    for name, (df, full, part) in rows.items():
        row = df.agg(F.when(full, "supported").when(part, "partially supported").otherwise("not supported").alias("verdict")).select(F.lit(name).alias("hypothesis"), "verdict")
        out = row if out is None else out.unionByName(row)
    return out


def conclusion(verdict: DataFrame, costs: DataFrame) -> DataFrame:
    """One row: whether four hypotheses or more are supported and prediction saves more than session affinity and than wrong prediction."""
    n = verdict.agg(F.count_if(F.col("verdict") == "supported").alias("supported"))
    saves = lambda name: F.max(F.when(F.col("strategy") == name, F.col("reduction_vs_independent")))
    c = costs.agg(saves(PREDICTED).alias("predicted"), saves(SESSION).alias("session"), saves(WRONG).alias("wrong"))
    enough = (F.col("supported") >= 4) & (F.col("predicted") > F.col("session")) & (F.col("predicted") > F.col("wrong"))
    return n.join(F.broadcast(c)).select("*", enough.alias("sufficient"), F.when(enough, "the problem exists").otherwise("the problem is not sufficiently shown").alias("conclusion"))  # one row
