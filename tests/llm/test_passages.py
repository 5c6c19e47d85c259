import random

import numpy as np
import pyarrow as pa
import pytest

from tracelode.llm import substring_dedup as module
from tracelode.llm.substring_dedup import PARAGRAPH, band_keys, grow, ordered, repeated_passages, substring_dedup


def spread(rng, n):
    return [f"w{rng.randrange(10**7)}" for _ in range(n)]


def inside(rng, words):
    """A text of these words between others, and where they begin."""
    before = spread(rng, rng.randrange(60))
    return " ".join([*before, *words, *spread(rng, rng.randrange(60))]), len(before)


def covered(found, i, at, n):
    words = np.zeros(at + n + 1000, bool)
    for r in found:
        if r.doc_id == i and r.removed:
            words[r.word_start : r.word_start + r.n_words] = True
    return words[at : at + n]


def test_exact_passages_are_covered_to_their_ends(spark):
    """Each copy inside another document loses every word, whatever its length."""
    rng, texts, where = random.Random(1), [], {}
    for k in range(60):
        words = spread(rng, rng.choice([25, 30, 51, 60, 100]))
        for copy in range(2 + k % 2):
            text, at = inside(rng, words)
            if copy:
                where[len(texts)] = at, len(words)
            texts.append((len(texts), text))
    found = repeated_passages(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()
    for i, (at, n) in where.items():
        assert covered(found, i, at, n).all()
    split = {i: t.split() for i, t in texts}
    for r in found:
        assert texts[r.doc_id][1].encode()[r.byte_start : r.byte_end].decode().split() == split[r.doc_id][r.word_start : r.word_start + r.n_words]
        assert r.removed == (r.doc_id != r.keep_doc_id) and r.keep_doc_id <= r.doc_id
    assert {r.cluster_id for r in found} == {r.cluster_id for r in found if not r.removed}
    cut = {r.doc_id: r.text.split() for r in substring_dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, (at, n) in where.items():
        assert not set(split[i][at : at + n]) & set(cut[i])


def test_near_passages_are_found(spark):
    """Passages with isolated changed words (5-word Jaccard 0.8 or more) are covered, the changed words too."""
    rng, texts, where = random.Random(2), [], {}
    for k in range(120):
        n, changes = [(60, [rng.randrange(20, 40)]), (100, [33, 66]), (200, [40, 80, 120, 160])][k % 3]
        words = spread(rng, n)
        other = [x if i not in changes else "changed" for i, x in enumerate(words)]
        for copy, x in enumerate((words, other)):
            text, at = inside(rng, x)
            if copy:
                where[len(texts)] = at, n, changes
            texts.append((len(texts), text))
    found = repeated_passages(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()
    for size in (60, 100, 200):
        each = [(covered(found, i, at, n), changes) for i, (at, n, changes) in where.items() if n == size]
        print(size, "found", np.mean([x.any() for x, _ in each]), "words", np.mean([x.mean() for x, _ in each]), "changed", np.mean([x[c].mean() for x, c in each]))
        assert all(x.any() for x, _ in each)
        assert np.mean([x.mean() for x, _ in each]) > 0.95
        assert np.mean([x[c].mean() for x, c in each]) > 0.9


def edited(rng, words, changes, kind):
    out = list(words)
    for c in sorted(changes, reverse=True):
        if kind == "put in":
            out.insert(c, f"new{rng.randrange(10**6)}")
        elif kind == "left out":
            del out[c]
        else:
            out[c] = f"other{rng.randrange(10**6)}"
    return out


def similarity(a, b):
    x, y = (set(zip(*(w[i:] for i in range(5)))) for w in (a, b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("kind", ["changed", "put in", "left out"])
def test_recall_of_near_passages_against_brute_force(spark, kind):
    """Passages of 50 to 200 words with one to three edits in random places: all those whose Jaccard similarity is 0.8 or more (worked out from the words) are found, with 0.95 of their words; texts without a passage are left alone."""
    rng, texts, where = random.Random(kind), [], {}
    for k in range(150):
        words = spread(rng, rng.choice([50, 60, 80, 100, 100, 150, 200]))
        other = edited(rng, words, rng.sample(range(len(words)), 1 + k % 3), kind)
        for copy, x in enumerate((words, other)):
            text, at = inside(rng, x)
            if copy and similarity(words, other) >= 0.8:
                where[len(texts)] = at, len(x)
            texts.append((len(texts), text))
    clean = range(len(texts), len(texts) + 100)
    texts += [(i, " ".join(spread(rng, 200))) for i in clean]
    found = repeated_passages(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()
    each = [covered(found, i, at, n) for i, (at, n) in where.items()]
    print(kind, len(each), "found", np.mean([x.any() for x in each]), "words", np.mean([x.mean() for x in each]))
    assert len(each) > 60 and all(x.any() for x in each)
    assert np.mean([x.mean() for x in each]) > 0.95
    assert not {r.doc_id for r in found} & set(clean)


def test_a_passage_in_very_many_documents(spark, monkeypatch):
    """One passage in every document, flushed and dealt in small parts: all but the smallest lose it, whatever the parts."""
    monkeypatch.setattr(module, "HOT", 7)
    rng = random.Random(9)
    words = spread(rng, 60)
    where, texts = {}, []
    for i in range(120):
        text, at = inside(rng, words)
        where[i] = at
        texts.append((i, text))
    found = repeated_passages(spark.createDataFrame(texts, "doc_id long, text string").repartition(5)).collect()
    assert all(covered(found, i, at, 60).all() for i, at in where.items() if i)
    assert not any(r.removed for r in found if r.doc_id == 0)


def test_exact_passages_with_earlier_decoys(spark):
    """Passages of 25, 28 and 32 words, each in two late documents, and all its parts of 24 words in earlier ones: every second copy is found, and the rows are the same however documents are dealt."""
    rng, texts, where = random.Random(11), [], {}
    late = []
    for k in range(150):
        words = spread(rng, (25, 28, 32)[k % 3])
        for i in range(len(words) - PARAGRAPH + 1):
            texts.append((len(texts), inside(rng, words[i : i + PARAGRAPH])[0]))
        late += [words, words]
    for words in late:
        text, at = inside(rng, words)
        where[len(texts)] = at, len(words)
        texts.append((len(texts), text))
    rng.shuffle(texts)
    rows = []
    for n in (1, 8, 64):
        found = repeated_passages(spark.createDataFrame(texts, "doc_id long, text string").repartition(n)).collect()
        rows.append(sorted(map(tuple, found)))
        second = [i for j, i in enumerate(sorted(where)) if j % 2]
        assert all(covered(found, i, *where[i]).all() for i in second)
    assert rows[0] == rows[1] == rows[2]


def test_near_passages_with_earlier_decoys(spark):
    """Near passages (Jaccard 0.8 or more) in two late documents, with parts of 24 words of the first in earlier ones: found as without decoys."""
    rng, texts, where = random.Random(12), [], {}
    pairs = []
    while len(pairs) < 150:
        words = spread(rng, rng.choice([60, 80, 100, 150]))
        other = edited(rng, words, rng.sample(range(len(words)), 1 + len(pairs) % 3), ("changed", "put in", "left out")[len(pairs) % 3])
        if similarity(words, other) < 0.8:
            continue
        for i in range(0, len(words) - PARAGRAPH + 1, 3):
            texts.append((len(texts), inside(rng, words[i : i + PARAGRAPH])[0]))
        pairs.append((words, other))
    for words, other in pairs:
        texts.append((len(texts), inside(rng, words)[0]))
        text, at = inside(rng, other)
        where[len(texts)] = at, len(other)
        texts.append((len(texts), text))
    found = repeated_passages(spark.createDataFrame(texts, "doc_id long, text string").repartition(5)).collect()
    each = [covered(found, i, at, n) for i, (at, n) in where.items()]
    print("decoys", len(each), "found", np.mean([x.any() for x in each]), "words", np.mean([x.mean() for x in each]))
    assert np.mean([x.any() for x in each]) >= 0.99 and np.mean([x.mean() for x in each]) > 0.95


def test_bands_of_equal_paragraphs_are_equal():
    rng = random.Random(4)
    words = spread(rng, PARAGRAPH)
    keys = [set(band_keys(pa.array([" ".join([*spread(rng, 5), *words, *spread(rng, 5)])]))[0].tolist()) for _ in range(20)]
    assert set.intersection(*keys)
    key, text, word, begin, last = band_keys(pa.array(["a " * 23, None and "", "x y", "w " * 500]).fill_null(""))
    assert set(text.tolist()) == {3} and len(key) == 2 * 24 and (begin <= word).all() and (word < last + PARAGRAPH).all()  # a text that repeats itself gives its keys again now and then


def test_runs_are_put_in_order_and_grow_while_they_are_similar():
    assert ordered([(0, 0, 50), (60, 10, 20), (55, 55, 30)]) == [(0, 0, 50), (55, 55, 30)]
    assert grow([(0, 0, 30), (31, 31, 30)]) == [(0, 1)]  # 52 of 57 shingles of each: 0.84
    assert grow([(0, 0, 20), (21, 21, 20)]) == [(0, 0), (1, 1)]  # 32 of 37 of each: 0.76
    assert grow([(0, 0, 100), (300, 300, 100), (401, 401, 100)]) == [(0, 0), (1, 2)]


def test_rows_that_share_an_id_and_clashing_columns(spark):
    """Two rows of document 2 with different texts: each loses what it shares with document 1; columns named as ours stay."""
    rng = random.Random(6)
    one, two = spread(rng, 60), spread(rng, 60)
    tail = [spread(rng, 30), spread(rng, 30)]
    rows = [(1, " ".join([*one, *two]), "a", 1), (2, " ".join([*tail[0], *one]), "b", 2), (2, " ".join([*two, *tail[1]]), "c", 3), (None, " ".join(one), "d", 4), (3, None, "e", 5)]
    out = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string, gone string, word_start int"))
    assert out.columns == ["doc_id", "text", "gone", "word_start"]
    got = {r.gone: r.text.split() for r in out.collect()}
    assert got == {"a": [*one, *two], "b": tail[0], "c": tail[1], "d": one, "e": []}
