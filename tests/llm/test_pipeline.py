import random
import re
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tracelode.llm.substring_dedup import WORDS

from .test_dedup import brute_components, set5
from .test_scores import brute_quality


@pytest.fixture(scope="module")
def source(docs):
    return docs.drop("n_lines").selectExpr("doc_id", "text", "lang", "'s' as source", "0L as n_chars").cache()


def test_stages(spark, source, tmp_path_factory):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "substring_dedup", "packing"]
    docs, out = source, {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, docs, "").write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = {r.doc_id: r.text or "" for r in docs.collect()} if name != "packing" else docs.collect()
        if name != "packing":
            assert docs.columns == source.columns
    before = {r.doc_id: r.text or "" for r in source.collect()}
    for i, t in before.items():
        n, _, _, _, repeat = brute_quality(t)
        if n < 10 or 100 * repeat > 20 * n:
            assert i not in out["quality_rules"]
        elif i in out["quality_rules"]:
            assert out["quality_rules"][i] == t
    assert out["line_dedup"].keys() == out["quality_rules"].keys()
    key = lambda x: re.sub("[A-Z]+", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = Counter(k for t in out["line_dedup"].values() for k in {key(x) for x in t.split("\n")} if len(k) >= 10)
    assert max(holders.values()) == 1
    sets = {i: set5(t) for i, t in out["line_dedup"].items()}
    comp = brute_components(sorted(sets), [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    assert out["simhash_near_dedup"].keys() == set(comp.values())
    assert out["substring_dedup"].keys() == out["simhash_near_dedup"].keys()
    n = 2 * WORDS - 1
    runs = Counter()
    for t in out["substring_dedup"].values():
        w = key(t).split()
        runs.update({" ".join(w[k : k + n]) for k in range(len(w) - n + 1)})
    assert max(runs.values(), default=1) == 1
    assert {r.doc_id for r in out["packing"]} == out["substring_dedup"].keys()


def stages(spark, docs, tmp):
    """Every stage over what the one before wrote."""
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").write.parquet(str(tmp / name))
        docs = spark.read.parquet(str(tmp / name))
        out[name] = docs
    return out


def test_nulls_repeats_and_an_empty_corpus(spark, empty, tmp_path):
    """Rows without a doc_id go through all stages, repeated rows stay repeated, and a corpus of which nothing is kept gives no rows."""
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice(["river", "stone", "light", "walks", "never", "quiet", "tower", "grain"]) + rng.choice("abcdefgh") for _ in range(60))
    one, two = text(), text()
    rows = [(None, one, None, None, None), (5, two, "en", "s", 1), (5, two, "en", "s", 1), (6, None, None, None, None), (7, "", "en", "s", 0)]
    out = stages(spark, spark.createDataFrame(rows, empty.schema), tmp_path / "a")
    near = sorted(((r.doc_id, r.text) for r in out["simhash_near_dedup"].collect()), key=str)
    assert near == sorted([(None, one), (5, two), (5, two)], key=str)
    assert sorted({str(r.doc_id) for r in out["packing"].collect()}) == ["5", "None"]
    for i, nothing in enumerate((empty, spark.createDataFrame(rows[3:], empty.schema))):
        assert all(df.count() == 0 for df in stages(spark, nothing, tmp_path / f"b{i}").values())


def test_registered(spark):
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names
