"""The driver's events as canonical tables. A stand-in: events are no agent traces, and the mapping is our own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").cast("string").alias("trace_id"), order.cast("long").alias("step_id"), "event_id", "event_type", "k")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, kind = _raw(spark, sf_dir), F.col("event_type")
    phase = F.when(kind.isin("view", "click"), "explore/read").when(kind == "signup", "edit/write").when(kind == "purchase", "execute/test").otherwise("unknown")
    return e.select("trace_id", "step_id", F.when(F.col("event_id") % 7 == 0, "unknown").otherwise("bash").alias("tool_wrapper"), kind.alias("semantic_tool_clean"), phase.alias("phase_clean"), (kind != "error").alias("is_tool_action"), (F.col("event_id") % 11 == 0).alias("is_no_tool_step"), (F.col("event_id") % 13 == 0).alias("command_artifact_flag"), (kind == "error").alias("error_flag"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event accesses one file; an error also has a signature, a view of k below 10 a test case."""
    e, kind, k = _raw(spark, sf_dir), F.col("event_type"), F.col("k")
    file = F.struct(F.concat(F.lit("file:k"), k).alias("object_id"), F.lit("file").alias("object_type"), F.concat(F.lit("p"), F.floor(k / 10)).alias("object_prefix"))
    error = F.when(kind == "error", F.struct(F.concat(F.lit("error:e"), k % 5).alias("object_id"), F.lit("error_signature").alias("object_type"), F.lit(None).cast("string").alias("object_prefix")))
    test = F.when((kind == "view") & (k < 10), F.struct(F.concat(F.lit("test:t"), k % 3).alias("object_id"), F.lit("test_case").alias("object_type"), F.concat(F.lit("t"), k % 3).alias("object_prefix")))
    o = e.select("trace_id", "step_id", "event_type", F.explode(F.array_compact(F.array(file, error, test))).alias("o"))
    tool = kind.isin("signup", "purchase") & (F.col("o.object_type") == "file")
    return o.select("trace_id", "step_id", "o.*", F.char_length("o.object_id").alias("object_size"), F.lit(True).alias("stable_object"), F.lit(True).alias("actionable_object"), tool.alias("derived_from_tool"), (~kind.isin("signup", "purchase")).alias("derived_from_observation"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    return u.select(F.col("user_id").cast("string").alias("trace_id"), (F.col("user_id") % 5).cast("string").alias("task_id"), (F.col("user_id") % 3).cast("string").alias("harness"), (F.col("user_id") % 2 == 0).alias("success"), (F.col("user_id") * 10).cast("double").alias("input_tokens"))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw traces with JSON steps whose commands follow from the event, so that labels are known without parsing."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    k, kind, path = F.col("k"), F.col("event_type"), F.concat(F.lit("src/pkg"), F.col("k") % 7, F.lit("/f"), F.col("k"), F.lit(".py"))
    command = F.when(F.col("event_id") % 11 == 0, F.lit(None)).when(F.col("event_id") % 13 == 0, "{artifact}").when(kind == "view", F.concat(F.lit("cat "), path)).when(kind == "click", F.concat(F.lit("X=1 grep -R 'foo bar' "), path)).when(kind == "signup", F.concat(F.lit("sudo -n sed -i 's/a/b/' "), path)).when(kind == "purchase", F.concat(F.lit("bash -c \"python3 -m pytest tests/test_m"), k % 5, F.lit(".py\""))).otherwise("echo done")
    obs = F.when(kind == "error", F.concat(F.lit('Traceback\n  File "/app/Mod'), k % 5, F.lit('.py", line '), k, F.lit("\nValueError: bad"))).when(kind == "click", F.concat(path, F.lit(": foo")))
    step = F.to_json(F.struct(F.lit("agent").alias("src"), F.when(command.isNotNull(), F.array(F.struct(F.lit("Bash").alias("fn"), command.alias("cmd")))).alias("tools"), obs.alias("obs")))
    listed = e.select("user_id", F.struct("ts", "event_id", step.alias("j")).alias("s")).groupBy("user_id").agg(F.array_sort(F.collect_list("s")).alias("l"))
    return listed.select(F.col("user_id").cast("string").alias("trial_id"), F.lit(None).cast("string").alias("trial_name"), F.lit("t").alias("task_name"), F.lit("h").alias("agent"), F.lit("m").alias("model"), F.lit(1.0).alias("reward"), F.lit("1.5").alias("duration_seconds"), F.lit("").alias("input_tokens"), F.lit("x").alias("output_tokens"), F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["j"]), ","), F.lit("]")).alias("steps"))


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw traces out of web pages, each fetched by its address (the observation is the page and its address), and out of documents, each read or written as a file."""
    call = lambda command, obs: F.to_json(F.array(F.struct(F.lit("agent").alias("role"), F.create_map(F.lit("name"), F.lit("Bash"), F.lit("command"), command).alias("tool_call"), obs.alias("output"))))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("page"), "page_id").alias("trial_id"), call(F.concat(F.lit("curl -s "), "url"), F.concat("html", F.lit("\n"), "url", F.lit("."))).alias("steps"))
    path = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("./data/"), "source", F.lit("/"), "lang", F.lit("/doc"), "doc_id", F.lit(".md"))).otherwise(F.concat(F.lit("doc"), "doc_id", F.lit(".json")))
    command = F.concat(F.when(F.col("doc_id") % 2 == 0, "head -5 ").otherwise("touch "), path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("doc"), "doc_id").alias("trial_id"), call(command, F.lit("done")).alias("steps"))
    null = F.lit(None).cast("string")
    return pages.unionByName(docs).select("trial_id", null.alias("trial_name"), F.lit("t").alias("task_name"), F.lit("h").alias("agent"), F.lit("m").alias("model"), F.lit(1.0).alias("reward"), null.alias("duration_seconds"), null.alias("input_tokens"), null.alias("output_tokens"), "steps")
