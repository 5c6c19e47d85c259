import hashlib
import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash

from tracelode.llm import line_dedup as line_dedup_module
from tracelode.llm import shared, simhash
from tracelode.llm.components import connected_components, roots
from tracelode.llm import exact_dedup as exact_dedup_module
from tracelode.llm.exact_dedup import exact_dedup
from tracelode.llm.line_dedup import line_dedup
from tracelode.llm.substring_dedup import WORDS, repeated_passages, substring_dedup

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_exact_dedup(docs, by_id):
    groups = defaultdict(list)
    for i, t in by_id.items():
        groups[t.translate(UPPER)].append(i)
    for keep, best in (("largest", max), ("smallest", min)):
        want = {i: (best(g), len(g), i == best(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for i in g}
        for fan_in in (2, 8):
            assert {r[0]: tuple(r)[1:] for r in exact_dedup(docs, keep=keep, fan_in=fan_in).collect()} == want


def test_digests_that_begin_alike_stay_apart():
    """Entries equal in their first eight bytes, or in digest but not in length, are others; equal ones of many runs become one."""
    rows = np.zeros(6, exact_dedup_module._ROW)
    rows["digest"] = [[1, 2, 3, 4], [1, 2, 3, 5], [1, 2, 3, 4], [1, 2, 3, 4], [0, 9, 9, 9], [1, 2, 3, 5]]
    rows["n_bytes"], rows["keep_id"], rows["group_size"] = [7, 7, 7, 8, 7, 7], [5, 6, 9, 1, 2, 3], 1
    for largest, want in ((True, [(0, 2, 1), (1, 9, 2), (1, 1, 1), (1, 6, 2)]), (False, [(0, 2, 1), (1, 5, 2), (1, 1, 1), (1, 3, 2)])):
        runs = [exact_dedup_module.merged([rows[i : i + 1]], largest) for i in range(6)]
        both = exact_dedup_module.merged([exact_dedup_module.merged(runs[:3], largest), exact_dedup_module.merged(runs[3:], largest)], largest)
        assert [(int(x["digest"][0]), int(x["keep_id"]), int(x["group_size"])) for x in both] == want


def test_exact_dedup_edges(empty, nulls):
    assert exact_dedup(empty).count() == 0
    got = rows(exact_dedup(nulls).select("doc_id", "keep_id", "group_size", "kept"))
    assert got == sorted([(None, None, 1, True), (None, 5, 2, False), (5, 5, 2, True), (7, 7, 2, True), (7, 7, 2, True)], key=str)


def test_line_dedup(docs, by_id):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    held = defaultdict(set)
    for i, t in by_id.items():
        for x in t.split("\n"):
            held[key(x)].add(i)
    want = {}
    for i, t in by_id.items():
        lines = t.split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == i]
        want[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    out = line_dedup(docs)
    assert out.columns[:2] == ["doc_id", "lang"]
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in out.collect()} == want


def test_line_dedup_small_filter_is_exact(docs):
    """A filter so small that every key is suspected gives the same result."""
    assert rows(line_dedup(docs, filter_bits=16).select("doc_id", "text")) == rows(line_dedup(docs).select("doc_id", "text"))


def test_line_dedup_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "the same long line\nanother line here", "a", "b"), (2, "the same long line", "c", "d"), (2, None, None, None)], "doc_id long, text string, drop string, keys string")
    out = line_dedup(df)
    assert out.columns == ["doc_id", "drop", "keys", "text", "n_lines", "n_dropped"]
    assert rows(out) == sorted([(1, "a", "b", "the same long line\nanother line here", 2, 0), (2, "c", "d", "", 1, 1), (2, None, None, "", 1, 0)], key=str)


def test_line_dedup_lets_go_of_the_filter(monkeypatch):
    """Texts are built again in workers that asked the filter before."""
    monkeypatch.setattr(shared, "_resident", {("line-filter", "somewhere"): np.zeros(8)})
    assert list(line_dedup_module._rebuild(10, "drop")(iter([]))) == [] and not shared._resident


def test_line_dedup_asks_the_filter_in_small_portions(tmp_path, monkeypatch):
    """Keys of two partitions are all suspected, others hardly, and memory does not grow with the keys of a task."""
    size = segments = 1 << 10
    keys = np.random.Generator(np.random.PCG64(3)).integers(0, 1 << 64, (600_000, 2), np.uint64)

    def parts(at, step):
        for a in range(0, len(at), step):
            own = [x.tobytes() for x in at[a : a + step].reshape(-1, 20)]
            yield pa.record_batch({"doc_id": pa.array(range(a, a + len(own)), pa.int64()), "keys": pa.array(own, pa.binary())})

    twice = keys[:300]
    local = [x for at in (twice, keys[:600]) for x in line_dedup_module._local(segments, size)(parts(at, 100))]
    merged = sorted(local, key=lambda x: x.column("segment")[0].as_py())
    list(line_dedup_module._merged(str(tmp_path), size)(iter(merged)))
    monkeypatch.setattr(shared, "_resident", {})
    tracemalloc.start()
    got = set()
    for x in line_dedup_module._suspects(str(tmp_path), segments, size)(parts(keys, 20_000)):
        got.update(x.column("key").to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {x.tobytes() for x in twice} <= got and len(got) < 400
    assert peak < 60 << 20


def test_line_dedup_edges(empty, nulls):
    assert line_dedup(empty).count() == 0
    assert rows(line_dedup(nulls).select("doc_id", "text", "n_dropped")) == sorted([(None, "", 0), (None, "one two three four", 0), (5, "", 0), (7, "Abc def ghi", 0), (7, "Abc def ghi", 0)], key=str)


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(UPPER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, by_id):
    prints = {i: brute_fingerprint(t) for i, t in by_id.items()}
    ids = sorted(prints)
    comp = brute_components(ids, [(a, b) for a in ids for b in ids if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3])
    assert len(set(comp.values())) < len(ids)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs).collect()} == {i: (f"{prints[i]:016x}", comp[i]) for i in ids}


def test_simhash_edges(empty, nulls):
    assert simhash.simhash_groups(empty).count() == 0
    assert rows(simhash.simhash_groups(nulls).select("doc_id", "component_id"))[:2] == [(5, 5), (7, 7)]


def families(seed=11, n=40):
    """Texts of 60 to 300 words with copies that differ in some words, and texts of their own."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    out = []
    for _ in range(n):
        one = [word() for _ in range(rng.randrange(60, 300))]
        out.append(" ".join(one))
        for _ in range(rng.randrange(4)):
            other = list(one)
            for _ in range(rng.randrange(1, max(2, len(one) // 30))):
                at = rng.randrange(len(other))
                other[at : at + rng.randrange(2)] = [word()]
            out.append(" ".join(other))
    return out


def set5(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(UPPER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else {()})


def check_near(spark, texts, **more):
    got = {r.doc_id: r.component_id for r in simhash.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), **more).collect()}
    sets = [set5(t or "") for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return got, brute_components(range(len(texts)), pairs), pairs


def test_near_groups(spark, texts):
    """Groups by five-word Jaccard of 0.8 or more, against all pairs."""
    for own in (families(), texts):
        got, want, pairs = check_near(spark, own)
        joined = sum(got[a] == got[b] for a, b in pairs)
        print("pairs", len(pairs), "joined", joined)
        assert len(pairs) > 10 and joined >= 0.98 * len(pairs)
        assert all(want[i] == want[c] for i, c in got.items())  # nothing else is joined
        assert all(c <= i for i, c in got.items())


def test_near_groups_in_hot_buckets(spark, monkeypatch):
    """One family of many near copies with buckets cut again above a low limit."""
    monkeypatch.setattr(simhash, "HOT", 20)
    rng = random.Random(3)
    one = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    own = [" ".join(x if rng.random() > 0.01 else "other" for x in one) for _ in range(90)] + families(5, 10)
    got, want, pairs = check_near(spark, own)
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.98 * len(pairs) and all(want[i] == want[c] for i, c in got.items())


def changed(rng, words, places):
    out = list(words)
    for i in places:
        out[i] = f"new{rng.randrange(10**7)}"
    return " ".join(out)


def test_links_behind_many_nearer_texts(spark):
    """A text that is similar enough to one member of a family only, which has eight nearer ones: the link holds, whatever number of texts is asked for first."""
    rng, texts, wanted = random.Random(21), [], []
    for _ in range(60):
        x = [f"w{rng.randrange(10**7)}" for _ in range(400)]
        far = rng.sample(range(0, 400, 6), 8)
        near = [changed(rng, x, rng.sample(range(0, 400, 6), 2)) for _ in range(8)]
        texts += [*near, " ".join(x), changed(rng, x, far)]
        wanted.append((len(texts) - 2, len(texts) - 1))
    order = list(range(len(texts)))
    rng.shuffle(order)
    own = [texts[i] for i in order]
    at = {i: n for n, i in enumerate(order)}
    groups = []
    for most in (1, 4, 400):
        got, want, pairs = check_near(spark, own, most=most)
        assert all(got[at[a]] == got[at[b]] for a, b in wanted) and all(want[i] == want[c] for i, c in got.items())
        groups.append(got)
    assert groups[0] == groups[1] == groups[2] and any(got != i for i, got in groups[0].items())


def test_hot_keys_do_not_change_groups(spark, monkeypatch):
    """Pairs of a similarity not far over 0.8, and a large family, with nearly every key hot: the same groups."""
    rng, own = random.Random(22), []
    for _ in range(100):
        x = [f"w{rng.randrange(10**7)}" for _ in range(300)]
        own += [" ".join(x), changed(rng, x, rng.sample(range(0, 300, 6), 5))]
    one = [f"w{rng.randrange(10**7)}" for _ in range(200)]
    own += [changed(rng, one, rng.sample(range(200), 2)) for _ in range(60)]
    groups = []
    for hot in (4096, 4):
        monkeypatch.setattr(simhash, "HOT", hot)
        got, want, pairs = check_near(spark, own)
        joined = sum(got[a] == got[b] for a, b in pairs)
        print("hot", hot, "pairs", len(pairs), "joined", joined)
        assert joined >= 0.99 * len(pairs) and all(want[i] == want[c] for i, c in got.items())
        groups.append(got)
    assert groups[0] == groups[1]


def test_near_groups_edges(empty, nulls):
    assert simhash.near_groups(empty).count() == 0
    assert rows(simhash.near_groups(nulls)) == sorted([(None, 5), (None, None), (5, 5), (7, 7), (7, 7)], key=str)


def test_nearest_against_all_distances():
    rng = np.random.Generator(np.random.PCG64(12))
    base = rng.integers(0, 2**63, (3, 4), dtype=np.uint64)
    fp = np.concatenate([base[rng.integers(0, 3, 300)] ^ (rng.integers(0, 2**63, (300, 4), dtype=np.uint64) & rng.integers(0, 2**63, (300, 4), dtype=np.uint64) & rng.integers(0, 2**63, (300, 4), dtype=np.uint64))])
    bucket = np.sort(rng.integers(0, 6, 300)) * (np.arange(300) < 150) + 9 * (np.arange(300) >= 150)
    i, j, more = simhash.nearest(fp, bucket, 60)
    got = dict.fromkeys(zip(i.tolist(), j.tolist()))
    d = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2).astype(int)
    want, over = [], []
    for a in range(300):
        near = [(a, b) for _, b in sorted((d[a, b], b) for b in range(a) if bucket[a] == bucket[b] and d[a, b] <= 60)]
        want += near[:4]
        over += [a] * (len(near) > 4)
    assert list(got) == want and want and more.tolist() == over and over
    i, j, more = simhash.nearest(fp, bucket, 60, 1000, lambda x, y: (x + y) % 3 == 0)
    assert not len(more) and set(zip(i.tolist(), j.tolist())) == {(a, b) for a in range(300) for b in range(a) if bucket[a] == bucket[b] and d[a, b] <= 60 and (a + b) % 3 == 0}


def test_near_links_in_hot_buckets(spark, monkeypatch):
    """Many fingerprints that differ in a few bits only, with buckets cut again above a low limit."""
    rng = np.random.Generator(np.random.PCG64(1))
    one = rng.integers(0, 2**63, dtype=np.uint64)
    near = [one ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k, dtype=np.uint64)) for k in (1, 2, 3, 4, 5, 6, 8) for _ in range(60)]
    far = rng.integers(0, 2**63, 300, dtype=np.uint64)
    fps = np.unique(np.concatenate([near, far]))
    ids = list(range(len(fps)))
    values = [int(x) for x in fps]
    want = brute_components(ids, [(a, b) for a in ids for b in ids if a < b and (values[a] ^ values[b]).bit_count() <= 3])
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)), i) for i, v in zip(ids, values)], "fp long, id long")
    for hot in (50, 3):  # with 3, buckets are large even after the second cut
        monkeypatch.setattr(simhash, "HOT", hot)
        got = {r.node: r.component for r in connected_components(simhash.near_links(df)).collect()}
        assert {i: got.get(i, i) for i in ids} == want


def test_sliced_distances():
    rng = np.random.Generator(np.random.PCG64(2))
    x = np.concatenate([np.zeros(3, np.uint64), np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64) | np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64), rng.integers(0, 2**63, 500, dtype=np.uint64)])
    for radius in (1, 2, 3):
        assert simhash.pairs_within(x, radius).tolist() == [i for i, v in enumerate(x.tolist()) if v.bit_count() <= radius]


def test_components(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(500, 600)] + [(700, x) for x in range(650, 720)]
    nodes = sorted({x for e in edges for x in e})
    want = brute_components(nodes, edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    assert {n: got.get(n, n) for n in nodes} == want
    u, v = roots(*np.array(edges).T)
    assert {n: dict(zip(u.tolist(), v.tolist())).get(n, n) for n in nodes} == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_substring_dedup_finds_every_passage(docs, by_id):
    """Each run of WORDS words that two documents share is covered by a removed row in all but the first, and by a row there."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t.translate(UPPER)) for i, t in by_id.items()}
    n = WORDS
    where = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - n + 1):
            where[" ".join(w[k : k + n])].add((i, k))
    shared = {x: s for x, s in where.items() if len({i for i, _ in s}) > 1}
    gone, found = (defaultdict(lambda: np.zeros(6000, bool)) for _ in range(2))
    for r in repeated_passages(docs).collect():
        found[r.doc_id][r.word_start : r.word_start + r.n_words] = True
        if r.removed:
            gone[r.doc_id][r.word_start : r.word_start + r.n_words] = True
    assert shared
    for places in shared.values():
        least = min(i for i, _ in places)
        assert all(gone[i][k : k + n].all() for i, k in places if i != least)
        assert any(found[i][k : k + n].all() for i, k in places if i == least)


def test_substring_dedup_pairs_are_similar(docs, by_id):
    sets = defaultdict(list)
    for r in repeated_passages(docs).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", by_id[r.doc_id].translate(UPPER))[r.word_start : r.word_start + r.n_words]
        assert len(w) >= WORDS and w == re.findall(r"[^\x20\x09-\x0D]+", by_id[r.doc_id].encode()[r.byte_start : r.byte_end].decode().translate(UPPER))
        sets[r.cluster_id].append((r.doc_id, r.keep_doc_id, r.removed, {tuple(w[i : i + 5]) for i in range(len(w) - 4)}))
    for members in sets.values():
        assert {m[1] for m in members} == {min(m[0] for m in members)} and len({m[0] for m in members}) > 1
        assert all(m[2] == (m[0] != m[1]) for m in members)
        for m in members:
            assert any(o is not m and len(m[3] & o[3]) >= 0.8 * len(m[3] | o[3]) for o in members)


def test_substring_dedup_texts(docs, by_id):
    gone = defaultdict(list)
    for r in repeated_passages(docs).where("removed").collect():
        gone[r.doc_id].append((r.byte_start, r.byte_end))
    for r in substring_dedup(docs).collect():
        raw = bytearray(by_id[r.doc_id].encode())
        keep = np.ones(len(raw), bool)
        for a, b in gone[r.doc_id]:
            keep[a:b] = False
        assert r.text.encode() == np.frombuffer(bytes(raw), np.uint8)[keep].tobytes()
        if not gone[r.doc_id]:
            assert r.text == by_id[r.doc_id]


def test_substring_dedup_edges(empty, nulls):
    assert repeated_passages(empty).count() == 0 and substring_dedup(empty).count() == 0
    assert repeated_passages(nulls).count() == 0 and substring_dedup(nulls).count() == 5
