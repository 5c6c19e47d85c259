"""Raw traces: JSONL and paged HTTP sources, and sinks for tables and reports."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterator
from urllib.parse import urlencode
from urllib.request import urlopen

import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from .shared import arrow_fs, qualified

RAW = "trial_id string, trial_name string, task_name string, agent string, model string, reward double, duration_seconds string, input_tokens string, output_tokens string, steps string"


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Raw traces from JSON lines; blank lines are skipped, nested steps are kept as text. Bad lines fail the read."""
    return spark.read.schema(RAW).option("mode", "FAILFAST").json(path)


def read_cached(rows: DataFrame, most: int) -> DataFrame:
    """The first rows of a cache by id."""
    return rows.orderBy("trial_id", "trial_name").limit(most)


class _Page(InputPartition):
    def __init__(self, offset: int, length: int):
        self.offset, self.length = offset, length


class _Pages(DataSourceReader):
    def __init__(self, options):
        self.url, self.rows = options["url"], int(options.get("rows", 100))
        self.page, self.retries = int(options.get("page", 10)), int(options.get("retries", 6))
        self.query = {k: options[k] for k in ("dataset", "config", "split") if k in options}

    def between(self, start: int, end: int) -> list[_Page]:
        return [_Page(i, min(self.page, end - i)) for i in range(start, end, self.page)]

    def partitions(self):
        return self.between(0, self.rows)

    def read(self, partition: _Page) -> Iterator[tuple]:
        query = urlencode(self.query | {"offset": partition.offset, "length": partition.length})
        for attempt in range(self.retries):
            try:
                with urlopen(f"{self.url}?{query}", timeout=120) as answer:
                    found = json.load(answer)["rows"]
                break
            except (OSError, ValueError, KeyError) as e:
                if attempt + 1 == self.retries:
                    raise RuntimeError(f"strict-real: page at {partition.offset} could not be read: {e}") from e
                time.sleep(min(30, 2**attempt))
        for item in found:
            row = item.get("row", item)
            steps = row.get("steps")
            if steps in (None, "", "null", []):
                continue
            text = lambda k: None if row.get(k) is None else str(row[k])
            reward = row.get("reward")
            yield (*(text(k) for k in ("trial_id", "trial_name", "task_name", "agent", "model")), None if reward is None else float(reward), *(text(k) for k in ("duration_seconds", "input_tokens", "output_tokens")), steps if isinstance(steps, str) else json.dumps(steps))


class _PageStream(DataSourceStreamReader):
    """Pages as a stream. The offset is the number of rows that were asked for, whether they were kept or not, so going on after a stop neither repeats nor skips rows."""

    def __init__(self, options):
        self.pages, self.step = _Pages(options), int(options.get("batch", 10))
        self.at = 0

    def initialOffset(self) -> dict:
        return {"scanned": 0}

    def latestOffset(self) -> dict:
        self.at = min(self.pages.rows, self.at + self.step * self.pages.page)
        return {"scanned": self.at}

    def partitions(self, start: dict, end: dict) -> list[_Page]:
        self.at = max(self.at, end["scanned"])  # after a restart the last batch of the log is planned or committed first
        return self.pages.between(start["scanned"], end["scanned"])

    def commit(self, end: dict) -> None:
        self.at = max(self.at, end["scanned"])

    def read(self, partition: _Page) -> Iterator[tuple]:
        return self.pages.read(partition)


class PagedTraces(DataSource):
    """spark.read or spark.readStream.format("paged_traces").option("url", ...): one partition for each page, so a page's failure is retried alone. A page that stays unreadable fails the query; nothing is made up."""

    @classmethod
    def name(cls):
        return "paged_traces"

    def schema(self):
        return RAW

    def reader(self, schema):
        return _Pages(self.options)

    def streamReader(self, schema):
        return _PageStream(self.options)


def load_traces(spark: SparkSession, url: str, sample: int, cache: str, partial: bool = False, **options: int | str) -> tuple[DataFrame, dict[str, str]]:
    """Raw traces of a paged source, kept in a cache folder, and what there is to say of the load.

    A cache with `sample` rows or more is read as it is. Else pages are added to it, `batch` of them at a time, up to `rows` rows of the
    source; each batch is written with its offset, so a load that was stopped goes on where it ended. A load that fails raises "strict-real";
    with `partial` it returns the rows that are cached, if there are any, and the failure as partial_load_error.
    """
    rows, log = f"{cache}/rows", f"{cache}/offsets"
    most = int(options.get("rows", 100))

    def kept() -> DataFrame | None:
        try:
            found = spark.read.schema(RAW).parquet(rows)
        except AnalysisException:  # no batch is written yet
            return None
        return found if not found.isEmpty() else None

    def enough() -> bool:
        found = kept()
        return found is not None and found.count() >= sample

    if enough():
        return read_cached(kept(), sample), {}
    spark.dataSource.register(PagedTraces)
    stream = spark.readStream.format("paged_traces").option("url", url).options(**options).load()
    query = stream.writeStream.format("parquet").option("path", rows).option("checkpointLocation", log).trigger(processingTime="0 seconds").start()
    try:
        seen = -1
        while query.isActive:
            last = query.lastProgress
            if last and last["batchId"] != seen:
                seen = last["batchId"]
                scanned = int(re.search(r"\d+", str(last["sources"][0]["endOffset"]))[0])  # the offset has one number
                if scanned >= most or enough():
                    break
            time.sleep(0.05)
        query.stop()
        if query.exception():
            raise query.exception()
    except StreamingQueryException as e:
        if partial and kept() is not None:
            return read_cached(kept(), sample), {"partial_load_error": str(e).splitlines()[0]}
        raise RuntimeError(f"strict-real: {e}") from e
    found = kept()
    return (read_cached(found, sample) if found is not None else spark.createDataFrame([], RAW)), {}


class _Written(WriterCommitMessage):
    def __init__(self, files: dict[str, int]):
        self.files = files


class _SetWriter(DataSourceArrowWriter):
    """Tasks write files under names of their own and report them; the files of reporting tasks make the table, those of a failed write go."""

    def __init__(self, options, schema):
        self.folder, self.table, self.schema = f"{options['folder']}/runs/{options['run']}", options["table"], schema.json()

    def write(self, iterator) -> _Written:
        fs, folder = arrow_fs(f"{self.folder}/{self.table}")
        fs.create_dir(folder, recursive=True)
        name, writer, n = f"part-{uuid.uuid4().hex}.parquet", None, 0
        for batch in iterator:
            if batch.num_rows:
                writer = writer or pq.ParquetWriter(f"{folder}/{name}", batch.schema, filesystem=fs)
                writer.write_batch(batch)
                n += batch.num_rows
        if writer:
            writer.close()
        return _Written({name: n} if n else {})

    def commit(self, messages) -> None:
        fs, folder = arrow_fs(self.folder)
        fs.create_dir(folder, recursive=True)
        files = {k: n for m in messages if m for k, n in m.files.items()}
        with fs.open_output_stream(f"{folder}/{self.table}.json") as out:
            out.write(json.dumps({"files": files, "schema": self.schema}).encode())

    def abort(self, messages) -> None:
        fs, folder = arrow_fs(self.folder)
        for name in (k for m in messages if m for k in m.files):
            fs.delete_file(f"{folder}/{self.table}/{name}")


class TableSets(DataSource):
    """df.write.format("table_set"): one table of a set; see write_set()."""

    @classmethod
    def name(cls):
        return "table_set"

    def writer(self, schema, overwrite):
        return _SetWriter(self.options, schema)


def _current(folder: str) -> dict:
    fs, path = arrow_fs(folder)
    if fs.get_file_info(f"{path}/current.json").type == pafs.FileType.NotFound:
        return {}
    with fs.open_input_stream(f"{path}/current.json") as file:
        return json.loads(file.read())


def write_set(tables: dict[str, DataFrame], folder: str) -> None:
    """Tables that appear together or not at all: each is written beside the old ones, and when all are there, one small file that names them is moved into place. A failure leaves the old set."""
    spark = next(iter(tables.values())).sparkSession
    folder = qualified(spark, folder)
    spark.dataSource.register(TableSets)
    run, old = uuid.uuid4().hex[:12], _current(folder)
    fs, path = arrow_fs(folder)
    try:
        for name, df in tables.items():
            df.write.format("table_set").mode("append").option("folder", folder).option("run", run).option("table", name).save()
        with fs.open_output_stream(f"{path}/runs/{run}/current.json") as out:
            out.write(json.dumps({"run": run, "tables": sorted(tables)}).encode())
        fs.move(f"{path}/runs/{run}/current.json", f"{path}/current.json")
    except Exception:
        if fs.get_file_info(f"{path}/runs/{run}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{path}/runs/{run}")
        raise
    if old:
        fs.delete_dir(f"{path}/runs/{old['run']}")


def read_set(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of the set that was written last."""
    folder = qualified(spark, folder)
    now = _current(folder)
    if table not in now.get("tables", []):
        raise ValueError(f"no table {table} in {folder}")
    fs, path = arrow_fs(folder)
    with fs.open_input_stream(f"{path}/runs/{now['run']}/{table}.json") as file:
        manifest = json.loads(file.read())
    schema = T.StructType.fromJson(json.loads(manifest["schema"]))
    files = [f"{folder}/runs/{now['run']}/{table}/{f}" for f in manifest["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def write_tables(tables: dict[str, DataFrame], folder: str, form: str = "parquet") -> None:
    """Each table in a folder of its own, replaced whole; form: parquet, csv or json."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite").format(form)
        (writer.option("header", True) if form == "csv" else writer).save(f"{folder}/{name}")


def _table(df: DataFrame, most: int = 20) -> list[str]:
    """Markdown of the first rows of a small result table."""
    rows = [f"| {' | '.join('' if x is None else str(x) for x in r)} |" for r in df.limit(most).collect()]
    return ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *rows]


def report(title: str, tables: dict[str, DataFrame], most: int = 20) -> str:
    """Markdown of the first rows of small result tables."""
    return "\n".join([f"# {title}", *(line for name, df in tables.items() for line in ("", f"## {name}", "", *_table(df, most)))]) + "\n"


#: What a run does not show, whatever its figures are.
NOT_SHOWN = ["a speed-up of real hardware", "reuse of objects or caches in a running service", "that other kinds of agents behave alike", "that acting ahead of a prediction is safe", "that tasks succeed as often as before"]
LIMITS = [
    "Observations of the source are cut at 5,000 characters, so dependencies are lower bounds.",
    "A load that failed half-way has fewer rows than were asked for; the metadata has the number.",
    "Intervals come from drawing traces again, not from a model of tasks and harnesses.",
    "Costs are sums with fixed coefficients: they show where work repeats, not how fast anything runs.",
    "Stable prompts are inferred from tokens that repeat; no cache was watched.",
]


def run_reports(quality: DataFrame, recall: DataFrame, interval: DataFrame, deps: DataFrame, failure: DataFrame, verdicts: DataFrame, costs: DataFrame, conclusion: DataFrame, command: str = "") -> dict[str, str]:
    """Three Markdown texts by name, from result tables of a few rows each: problem_existence_report, problem_existence_audit and limitations.

    The figures: of clean tool actions the gain in top-3 recall with its interval, the number and the median distance of dependencies, the
    p-value of the failure-loop score, and the strategies' savings. A figure whose table has no row is `none`.
    """
    view, score = "view = 'semantic_tool_tool_action_only'", "metric = 'failure_loop_score'"

    def figure(df: DataFrame, column: str, where: str = "true") -> str:
        row = df.where(where).select(column).first()
        return "none" if row is None or row[0] is None else f"{row[0]:.4g}" if isinstance(row[0], float) else str(row[0])

    def saved(name: str) -> str:
        return figure(costs, "reduction_vs_independent", f"strategy = '{name}'")

    flags = quality.select("strict_real", "used_mock").first()
    strict, mock = (str(x).lower() for x in flags) if flags else ("none", "none")
    total = deps.selectExpr("coalesce(sum(count), 0) as n", "median(median_distance) as m")
    main = ["# Does the problem exist?", "", "## Question", "", "Do runs of agents share a structure of steps and objects that is known before they end? Nothing found earlier is taken for granted.", "", "## Data", "", *_table(quality), "", f"Strict: {strict}. Mock rows: {mock}.", "", "## Hypotheses", "", *_table(verdicts), ""]
    main += [
        f"- H1: top-3 recall of the next tool, known the one before, less that of the commonest tools: {figure(recall, 'delta', view + ' and k = 3')}, interval [{figure(interval, 'low', view)}, {figure(interval, 'high', view)}]. Controls: labels dealt anew within traces, and over all traces.",
        "- H2: motifs of training traces that held-out traces have too, and the harnesses that have them.",
        f"- H3: {figure(total, 'n')} dependencies, median of their types' median distances {figure(total, 'm')}; an object that is only mentioned makes none.",
        "- H4: objects used next, by identifier and by path prefix; the last objects against chance and against the bare type.",
        "- H5: labels of a trace from its first 1, 2, 3, 5 or 8 steps, against the best guess from what is known beforehand.",
        f"- H6: failure-loop score of failures against successes, p = {figure(failure, "p_value", score)}.",
        "", "## Costs", "", *_table(costs), "", f"Prediction saves {saved('predicted')}, session affinity {saved('session_affinity')}, wrong predictions {saved('wrong_prediction_stress')}.",
        "", "## Shown", "", "What the table of hypotheses calls supported, for these traces.", "", "## Not shown", "", *[f"- {x}" for x in NOT_SHOWN], "", "## Next", "", figure(conclusion, "conclusion"),
    ]
    audit = ["# Audit", "", f"- Strict run: {strict}; mock rows: {mock}.", "- Steps without a tool, with an unknown one, or whose command is no command are left out of tool actions.", "- Objects are counted by identifier and by path prefix.", "- Controls are in the table of permutation tests and in the strategies with wrong predictions.", f"- Command: `{command}`"]
    texts = {"problem_existence_report": main, "problem_existence_audit": audit, "limitations": ["# Limitations", "", *[f"- {x}" for x in LIMITS]]}
    return {name: "\n".join(lines) + "\n" for name, lines in texts.items()}
