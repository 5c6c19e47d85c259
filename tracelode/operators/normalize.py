"""Raw traces to the canonical tables: traces, steps, object accesses, data dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse

#: Object types that stay the same from one access to the next, the type and id of a large observation, the data set's name.
STABLE = ["file", "url", "test_case", "error_signature"]
LARGE = "large_observation_bucket"
DATASET = "terminalbench"
#: How an object's id begins, by type.
BEGINS = {"file": "file:", "url": "url:", "test_case": "test:", "error_signature": "error:"}


def named(raw: DataFrame) -> DataFrame:
    """Raw rows with trace_id, the trial's id or name, else a hash of the row and, of equal ones, a number; and row_hash, which tells rows of one id apart."""
    own = raw.withColumn("trace_id", F.coalesce(F.nullif("trial_id", F.lit("")), F.nullif("trial_name", F.lit("")))).withColumn("row_hash", F.xxhash64("steps", "task_name", "agent", "model", "reward", "duration_seconds", "input_tokens", "output_tokens"))
    rest = own.where("trace_id is null").withColumn("h", F.xxhash64("steps", "task_name", "agent", "model", "reward"))
    nth = F.row_number().over(Window.partitionBy("h").orderBy("h"))
    rest = rest.withColumn("trace_id", F.concat_ws(":", F.lit(DATASET), F.col("h").cast("string"), nth.cast("string"))).drop("h")
    return own.where("trace_id is not null").unionByName(rest)


def step_elements(raw: DataFrame) -> DataFrame:
    """One row for each step of a raw trace, as VARIANT, with its place; rows without steps, or with steps that are no list, have none."""
    return named(raw).select("trace_id", "row_hash", F.posexplode(parse.step_list(F.col("steps"))).alias("step_id", "element"))


def steps(raw: DataFrame) -> DataFrame:
    """Canonical steps, with the command's file flag (writes), the row they come from (row_hash) and texts that objects() needs. An element that is no object is a message."""
    e = F.col("element")
    calls = [F.col(f"call{i}") for i in range(len(parse.CALLS))]
    df = step_elements(raw).withColumns({f"call{i}": parse.call_of(e, c) for i, c in enumerate(parse.CALLS)})
    other = F.when(~F.schema_of_variant(e).startswith("OBJECT"), F.try_variant_get(e, "$", "string"))
    df = df.withColumn("msg", F.coalesce(*parse.pick(e, parse.MESSAGES), other))
    df = df.select("trace_id", "row_hash", "step_id", "msg", F.coalesce(*parse.pick(e, parse.ROLES)).alias("role"), F.coalesce(*parse.pick(e, parse.OUTPUTS)).alias("obs"), parse.wrapper(e, calls).alias("tool_wrapper"), parse.command_string(e, calls, F.col("msg")).alias("command_string"), F.coalesce(*parse.pick(e, parse.TIMES)).alias("timestamp"))
    df = df.withColumn("s", parse.shell("command_string", "tool_wrapper")).withColumn("semantic_tool", F.col("s.tool")).withColumn("semantic_tool_clean", parse.tool_group(F.col("semantic_tool")))
    group, command, wrap = F.col("semantic_tool_clean"), F.col("command_string"), F.col("tool_wrapper")
    return df.select(
        "trace_id", "step_id", "role", wrap.alias("raw_tool_name"), "tool_wrapper", "semantic_tool", "semantic_tool_clean", "command_string",
        parse.phase(group).alias("phase"), parse.phase(group).alias("phase_clean"), F.when(parse.nullish(group), "unknown").otherwise("semantic_tool").alias("phase_source"),
        parse.tool_action(wrap, command, group).alias("is_tool_action"), parse.no_tool_step(wrap, command, group).alias("is_no_tool_step"), parse.artifact_flag(command, group).alias("command_artifact_flag"),
        F.coalesce(F.char_length("obs"), F.lit(0)).alias("observation_len_chars"), F.coalesce(F.char_length("msg"), F.lit(0)).alias("message_len_chars"), parse.error_flag(F.col("obs")).alias("error_flag"), "timestamp", F.col("s.writes").alias("writes"), "obs", "row_hash",
    )


def objects(steps: DataFrame) -> DataFrame:
    """Object accesses of all kinds from one scan of the steps: each step makes one array, exploded once."""
    command, obs = F.coalesce("command_string", F.lit("")), F.coalesce("obs", F.lit(""))
    kind = "array<struct<id:string,type:string,source:string,size:int,access:string,path:string,signature:string,tool:boolean,observed:boolean>>"

    def made(values: Column, type_: str, source: str, access: Column, path: bool, tool, observed) -> Column:
        return F.transform(values, lambda x: F.struct(F.concat(F.lit(BEGINS[type_]), x).alias("id"), F.lit(type_).alias("type"), F.lit(source).alias("source"), F.char_length(x).alias("size"), access.alias("access"), (x if path else F.lit(None).cast("string")).alias("path"), (x if type_ == "error_signature" else F.lit(None).cast("string")).alias("signature"), tool(x).alias("tool"), observed(x).alias("observed"))).cast(kind)

    yes, no = (lambda x: F.lit(True)), (lambda x: F.lit(False))
    used, mention = parse.access_type(F.col("semantic_tool_clean"), F.col("writes"), F.lit(False)), F.lit("mention")
    urls = F.array_distinct(F.concat(parse.urls(command, 8), parse.urls(obs, 8)))
    tests = F.array_distinct(F.concat(parse.test_ids(obs, 8), parse.test_ids(command, 4)))
    signature = parse.error_signature(F.col("obs"))
    large = F.when(F.char_length(obs) > 4000, F.array(F.struct(F.lit(LARGE).alias("id"), F.lit(LARGE).alias("type"), F.lit("observation").alias("source"), F.char_length(obs).alias("size"), mention.alias("access"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("signature"), F.lit(False).alias("tool"), F.lit(True).alias("observed"))).cast(kind))
    every = F.concat(
        made(parse.paths(command, 16), "file", "command", used, True, yes, no), made(parse.paths(obs, 32), "file", "observation", mention, True, no, yes),
        made(urls, "url", "mixed", F.lit("retrieve"), True, lambda x: command.contains(x), lambda x: obs.contains(x)), made(tests, "test_case", "mixed", F.lit("execute"), True, no, lambda x: obs.contains(x)),
        F.when(signature.isNotNull(), made(F.array(signature), "error_signature", "observation", F.lit("error"), False, no, yes)).otherwise(F.array().cast(kind)), F.coalesce(large, F.array().cast(kind)),
    )
    o = steps.select("trace_id", "step_id", F.explode(every).alias("o")).select("trace_id", "step_id", "o.*")
    stable = F.col("type").isin(STABLE)
    return o.select(
        "trace_id", "step_id", F.col("id").alias("object_id"), F.col("type").alias("object_type"), F.col("source").alias("object_source"), F.lit(None).cast("string").alias("object_version"), F.col("size").alias("object_size"), F.col("access").alias("access_type"), stable.alias("stable_object"), stable.alias("actionable_object"),
        F.col("path").alias("object_path"), F.when(F.col("path").isNotNull(), parse.object_dir(F.col("path"))).alias("object_dir"), F.when(F.col("path").isNotNull(), parse.object_prefix(F.col("path"))).alias("object_prefix"), parse.object_extension(F.col("path")).alias("object_extension"), F.lit(None).cast("string").alias("content_hash"), F.col("signature").alias("error_signature"), F.col("tool").alias("derived_from_tool"), F.col("observed").alias("derived_from_observation"),
    )


def traces(raw: DataFrame, steps: DataFrame) -> DataFrame:
    """Headers with step counts, each row its own even if another has the same id; traces without steps are left out."""
    counts = steps.groupBy("trace_id", "row_hash").agg(F.count("*").alias("total_steps"), F.count_if("is_tool_action").alias("tool_action_steps"))
    number = lambda c: F.expr(f"try_cast({c} as double)")
    head = named(raw).select("trace_id", "row_hash", F.lit(DATASET).alias("dataset"), F.col("task_name").alias("task_id"), F.col("agent").alias("harness"), F.col("agent").alias("agent_scaffold"), "model", (F.col("reward") != 0).alias("success"), "reward", (F.col("reward") != 0).alias("resolved"), number("duration_seconds").alias("duration"), number("input_tokens").alias("input_tokens"), number("output_tokens").alias("output_tokens"))
    copies = named(raw).groupBy("trace_id", "row_hash").agg(F.count("*").alias("copies"))  # equal rows have equal counts, so each has its share of all
    each = counts.join(copies, ["trace_id", "row_hash"]).select("trace_id", "row_hash", *[F.expr(f"{c} div copies").alias(c) for c in ("total_steps", "tool_action_steps")])
    return head.join(each, ["trace_id", "row_hash"]).drop("row_hash")


def dependencies(steps: DataFrame, objects: DataFrame, horizon: int = 10) -> DataFrame:
    """What an observation shows and a later command, at most `horizon` steps on, uses: an equi join on trace and object with a range.

    Both sides are distinct before they meet, so a hot object in one trace costs its steps, not its accesses squared.
    """
    stable = objects.where("stable_object").select("trace_id", "step_id", "object_id", "object_type", "derived_from_tool", "derived_from_observation")
    tools = steps.select("trace_id", "step_id", F.col("semantic_tool_clean").alias("tool"))
    side = lambda flag, n: stable.where(flag).select("trace_id", "object_id", "object_type", "step_id").distinct().join(tools, ["trace_id", "step_id"]).withColumnsRenamed({"step_id": f"{n}_step_id", "tool": f"{n}_tool", "object_type": f"{n}_type"})
    a, b = side("derived_from_observation", "src"), side("derived_from_tool", "dst")
    df = a.join(b, (a.trace_id == b.trace_id) & (a.object_id == b.object_id) & (b.dst_step_id > a.src_step_id) & (b.dst_step_id <= a.src_step_id + horizon)).select(a.trace_id, "src_step_id", "dst_step_id", "src_tool", "dst_tool", a.object_id, a.src_type)
    kind = F.when((F.col("src_type") == "file") & (F.col("src_tool") == "test"), "error_file_to_read_or_edit").when(F.col("src_type") == "file", "file_path_from_output_to_next_arg").when(F.col("src_type") == "url", "url_from_search_to_open").when(F.col("src_type") == "test_case", "test_case_to_rerun").otherwise("object_reused")
    near = F.when(F.col("dst_step_id") - F.col("src_step_id") == 1, "high").otherwise("medium")
    return df.select("trace_id", "src_step_id", "dst_step_id", kind.alias("dependency_type"), "src_tool", "dst_tool", "object_id", F.col("src_type").alias("value_type"), near.alias("confidence")).distinct()


def quality_row(raw: DataFrame, steps: DataFrame, objects: DataFrame, source: str = "", strict_real: bool = True, used_mock: bool = False, profile_mode: str = "") -> DataFrame:
    """One row: counts and rates of the steps, raw rows that have none, and how the run was asked for. With sources.write_tables(..., "json") it is the run's metadata."""
    rate = lambda c: F.round(F.coalesce(F.avg(c.cast("double")), F.lit(0.0)), 6)
    n = steps.agg(
        F.count_distinct("trace_id").alias("num_traces"), F.count("*").alias("num_steps"), F.count_if("is_tool_action").alias("num_tool_action_steps"),
        rate(F.col("semantic_tool_clean") == "unknown").alias("unknown_rate"), rate(F.col("command_artifact_flag")).alias("artifact_rate"), rate(F.col("command_string").isNotNull()).alias("command_parse_success_rate"),
    )
    rows, o = raw.agg(F.count("*").alias("rows")), objects.agg(F.count("*").alias("num_object_accesses"))
    flags = [F.lit(x).alias(k) for k, x in (("dataset", DATASET), ("source", source), ("strict_real", strict_real), ("used_mock", used_mock), ("profile_mode", profile_mode))]
    return n.join(F.broadcast(o)).join(F.broadcast(rows)).withColumn("skipped_rows", F.col("rows") - F.col("num_traces")).drop("rows").select("*", *flags)  # single rows


def normalize(raw: DataFrame) -> dict[str, DataFrame]:
    s = steps(raw)
    o = objects(s)
    return {"traces": traces(raw, s), "steps": s.drop("writes", "obs", "row_hash"), "object_accesses": o, "data_dependencies": dependencies(s, o)}
