"""Every query that has SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    def cell(x):
        return "" if x is None or x != x else f"{x:.6g}" if isinstance(x, float) else str(x)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = entry.queries()[name](spark, sf_dir).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["k7_verdicts", "k8_conclusion"])
def test_verdicts_read_stored_results(spark, sf_dir, name):
    """Each result is planned, run and stored by itself: the driver never holds the plans of all in one."""
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() == 8


def test_stream(spark, sf_dir, tmp_path):
    from tracelode.streaming import steps as stream

    src = spark.read.parquet(f"{sf_dir}/events.parquet")
    src.write.parquet(str(tmp_path / "in"))  # a stream reads a folder
    files = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    for name, f in (("label_counts", stream.label_counts), ("sessions", stream.sessions)):
        q = f(files).writeStream.format("memory").queryName(name).outputMode("complete" if name == "label_counts" else "append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
    assert spark.sql("SELECT sum(n) AS n FROM label_counts").first().n == src.count()
