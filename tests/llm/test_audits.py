import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tracelode.llm import license_scan as ls
from tracelode.llm import vector_codes as vc
from tracelode.llm.filter_audit import FILTERS, filter_audit

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """Straight from the definition, with Python's whole numbers. rows: (vec_id, vector, label) with unique ids."""
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(r[1], p) for r in kept[:entries]] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for _, v, _ in kept:
                own[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(o) for c in zip(*o)] if o else e for o, e in zip(own, books[p])]
    out = {}
    for i, v, lab in kept:
        got = [near(cut(v, p), books[p]) for p in range(parts)]
        out[i] = ("".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got), lab)
    by = Counter()
    for _, e, lab in out.values():
        by[lab] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return {i: (code, e, by[lab], digest) for i, (code, e, lab) in out.items()}


VECTORS = "vec_id long, embedding array<float>, label int, dims int, code string"


def test_codes(spark):
    """Against brute force: ties, copies, nulls and non-finite components, null labels, large values, extra columns of clashing names."""
    rng = random.Random(3)
    rows = [(3 * i, [float(np.float32(rng.choice([rng.gauss(0, 0.3), 0.25, -0.5]))) for _ in range(16)], rng.choice([None, 1, 1, 1, 2])) for i in range(70)]
    rows += [(1000 + i, rows[5][1], 1) for i in range(30)]
    rows += [(1, None, 1), (2, [0.1] * 15 + [None], 1), (4, [float("nan")] + [0.0] * 15, 2), (5, [float("inf")] * 16, 2), (7, [900_000.0] * 16, 2), (-5, [-1.5] * 16, None)]
    want = brute_codes(rows)
    for n in (1, 7):
        df = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS).repartition(n)
        got = vc.vector_codes(df).collect()
        assert {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in got} == want
        assert len(got) == len(want)


def test_codes_edges(spark):
    """No rows, only rows that go, fewer rows than entries, rows without ids, repeated rows, errors."""
    make = lambda rows: spark.createDataFrame([(*r, 0, None) for r in rows], VECTORS)
    assert vc.vector_codes(make([])).collect() == []
    assert vc.vector_codes(make([(1, None, 1)])).collect() == []
    few = vc.vector_codes(make([(1, [0.5] * 8, None), (1, [0.5] * 8, None), (None, [1.0] * 8, 3)])).collect()
    assert sorted((r.vec_id or 0, r.code, r.error, r.label_error) for r in few) == [(0, "02" * 8, 0, 0), (1, "00" * 8, 0, 0), (1, "00" * 8, 0, 0)]
    assert [(r.code, r.error) for r in vc.vector_codes(make([(1, [], 1)])).collect()] == [("00" * 8, 0)]
    for bad in ([(1, [0.5] * 8, 1), (2, [0.5] * 16, 1)], [(1, [0.5] * 9, 1)], [(1, [1e30] * 8, 1)]):
        with pytest.raises(Exception, match="components|length|large"):
            vc.vector_codes(make(bad)).collect()


def test_partial_distances():
    """Equal to complete distances, whatever the scale; ties go to the lower entry."""
    rng = np.random.default_rng(1)
    for scale in (2, 1000, 1 << 40):
        x, book = rng.integers(-scale, scale, (500, 8)), rng.integers(-scale, scale, (16, 8))
        book[7] = book[3]
        whole = ((x[:, None].astype(object) - book[None].astype(object)) ** 2).sum(2)
        entry, dist = vc.nearest_entries(x, book, vc.dimension_order(book))
        assert entry.tolist() == [min(range(16), key=lambda k, r=r: (r[k], k)) for r in whole.tolist()]
        assert [int(d) for d in dist] == [min(r) for r in whole.tolist()]
    assert vc.dimension_order(np.array([[0, 5, 1], [9, 5, 2]])) == [0, 2, 1]


def brute_audit(docs, labels):
    low, words = {}, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    for i, t, _ in docs:
        if i is not None:
            low[t or ""] = min(low.get(t or "", i), i)
    good, bad = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None}
    marks = []
    for i, t, s in docs:
        t = t or ""
        w = words(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and low[t] < i}
        marks.append((s or "", {f for f, x in fails.items() if x}, i in good, i in bad))
    out, total = {}, Counter()
    for part in {m[0] for m in marks}:
        for order in map("".join, itertools.permutations(FILTERS)):
            left = [m for m in marks if m[0] == part]
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                all_f = [m for m in marks if m[0] == part and f in m[1]]
                out[part, order, step] = [len(left), len(gone), len(all_f) - len(gone), sum(m[1] == {f} for m in all_f), sum(m[2] for m in gone), sum(m[3] for m in gone)]
                total[part, f] += len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit(spark, texts):
    rng = random.Random(4)
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(i, t, rng.choice(["a", "b", "", None])) for i, t in enumerate(texts)]
    rows += [(200 + i, x, "a") for i, x in enumerate([long, long, long + " $", long.upper(), "B " * 70, "B " * 70, None, "", "a\u0085b  ", long + " \u0085"])]
    rows += [(None, long, "a"), (None, None, None), (200, long, "a")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 220, 2)] + [(200, 1, 0), (200, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, True, "n", 1) for r in rows], "doc_id long, text string, source string, A boolean, part string, good int").repartition(3)
    got = filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got} == brute_audit(rows, labels)
    assert len(got) == 3 * 600


def test_audit_empty(spark, empty):
    assert filter_audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def brute_scan(text, templates=ls.TEMPLATES):
    """Base columns, and the method's labels by every way of laying a template beside the text."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(UPPER))
    w = split(text or "")
    places = [(i, name) for p, name in ls.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    labels, share = set(), 0.0
    for name, t in templates:
        t = split(t)
        grams = {tuple(t[i : i + ls.GRAM]) for i in range(len(t) - ls.GRAM + 1)}
        hits = [(i - j, i, j) for i in range(len(w) - ls.GRAM + 1) if tuple(w[i : i + ls.GRAM]) in grams for j in range(len(t) - ls.GRAM + 1) if w[i : i + ls.GRAM] == t[j : j + ls.GRAM]]
        islands, last = {}, None
        for i in sorted({h[1] for h in hits}):
            start = i if last is None or i - last[0] > ls.GAP + ls.GRAM else last[1]
            islands[i], last = start, (i, start)
        for start in set(islands.values()):
            votes = {}
            for d, i, j in hits:
                if islands[i] == start:
                    votes.setdefault(d, []).append(j)
            for chain in ls.merged([(d, min(v), max(v)) for d, v in votes.items()]):
                same, own, other = ls.verified(w, t, chain)
                if same >= ls.LEAST * max(own, other) and same >= min(ls.LEAST * len(t), ls.LONG):
                    labels.add(name)
                    share = max(share, same / len(t))
    base = sorted({n for _, n in places})
    at = [i for i, _ in places]
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted({*base, *labels})), max(share, 0.5 if at else 0.0))


def license_texts(texts):
    mit, gpl = ls.TEMPLATES[2][1], dict(ls.TEMPLATES)["gpl"]
    broken = mit.replace("free of charge", "without charge").replace("merge, publish", "merge and publish").replace("Software", "Work", 1)
    half = " ".join(mit.split()[20:60])
    notices = [f"{texts[i]}\n{t}." for i, (_, t) in enumerate(ls.TEMPLATES)]
    odd = ["MIT", "the mit-license and the MIT  license", "GNU General Public Licenses", "cc by", "CC BY-NC 4.0 Licensed under", "Apache license apache LICENSE", "xmit license", "mit licenseé", "Licensed under the Apache Licence, Version 2.0", "public license general gnu"]
    return [*texts, *notices, *odd, mit.upper(), broken, half, gpl + " " + mit, mit + "\n" + mit, "Licensed under CC BY-NC 4.0. " * 300]


def test_scan(spark, texts):
    all_texts = license_texts(texts)
    rows = [(i, t, "x", 1) for i, t in enumerate(all_texts)]
    for n, most in ((1, ls.MOST_GRAMS), (5, 0)):
        docs = spark.createDataFrame(rows, "doc_id long, text string, labels string, gram int").repartition(n)
        got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in ls.license_scan(docs, broadcast_up_to=most).collect()}
        want = {i: brute_scan(t) for i, t in enumerate(all_texts)}
        assert got == want
    by = dict(zip(all_texts, range(len(all_texts))))
    assert all(name in got[len(texts) + i][5].split(",") for i, (name, _) in enumerate(ls.TEMPLATES))
    assert "mit" in got[by[ls.TEMPLATES[2][1].upper()]][5]
    assert not any(got[i][5] for i in range(len(texts)))  # clean texts are left alone


def test_scan_changed_words(spark):
    """Words changed, added and left out in a long wording: still found; a third of its words changed: not."""
    rng, text = random.Random(8), ls.TEMPLATES[2][1].split()
    near, far = [], []
    for _ in range(20):
        w = list(text)
        for i in rng.sample(range(3, len(w) - 3), 4):
            w[i] = rng.choice(["other", "", w[i] + " and"])
        near.append("before it all " + " ".join(w))
        far.append(" ".join("no" if i % 3 == 0 else x for i, x in enumerate(text)))
    docs = spark.createDataFrame(list(enumerate(near + far)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in ls.license_scan(docs).collect()}
    assert [got[i] for i in range(20)] == ["mit"] * 20 and [got[i] for i in range(20, 40)] == [""] * 20


def test_scan_edges(spark, empty, nulls):
    assert ls.license_scan(empty).collect() == []
    got = sorted((r.doc_id or 0, r.n_words, r.n_base, r.labels, r.score) for r in ls.license_scan(nulls).collect())
    assert got == [(0, 0, 0, "", 0.0), (0, 4, 0, "", 0.0), (5, 0, 0, "", 0.0), (7, 3, 0, "", 0.0), (7, 3, 0, "", 0.0)]
    twice = spark.createDataFrame([(1, "MIT License")] * 3 + [(None, "MIT License")] * 2, "doc_id long, text string")
    assert [(r.n_base, r.labels, r.score) for r in ls.license_scan(twice).collect()] == [(1, "mit", 0.5)] * 5
