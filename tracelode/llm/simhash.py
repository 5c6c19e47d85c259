"""SimHash near-dedup with bit-sliced comparison of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, roots
from .shared import release, stored
from .textops import LOWER, SPACE, batches, flat, mix, owners, rolling, span_hash, spans

HOT = 4096  # rows of a bucket that are compared in one place; beyond, the bucket is cut by further bits


def fingerprint(raw: bytes, k: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of lower-cased UTF-8: bit set if set in over half of the k-word shingles' XXH64, repeats included."""
    norm = b" ".join(raw.split())
    if not norm:
        return 0
    apart = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32).tolist()
    digest = xxhash.xxh64_digest
    if len(apart) < k:
        hashes = digest(norm, seed)
    else:
        hashes = b"".join([digest(norm[a:b], seed) for a, b in zip([0, *[x + 1 for x in apart]], [*apart[k - 1 :], len(norm)])])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    count = np.zeros(64, np.int64)
    for a in range(0, len(rows), 1 << 14):
        count += np.unpackbits(rows[a : a + (1 << 14)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(rows)).tobytes(), "big")


def _fingerprints(k: int):
    def fingerprints(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in batches(parts):
            data, at = flat(part.column("text"))
            raw = data.tobytes().lower()
            out = np.array([fingerprint(raw[a:b], k) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], np.uint64)
            yield pa.record_batch({"doc_id": part.column("doc_id"), "fp": pa.array(out.view(np.int64), pa.int64())})

    return fingerprints


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes: row i holds bit i of all values, 64 values to a word; padded with zeros."""
    n = -(-len(values) // 64) * 64
    bits = np.unpackbits(np.concatenate([values, np.zeros(n - len(values), np.uint64)]).astype(">u8").view(np.uint8).reshape(n, 8), axis=1)
    return np.packbits(np.ascontiguousarray(bits.T), axis=1).view(np.uint64)


def near(differ, words: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Where at most `radius` (1 to 3) of 64 planes are set. differ(i, blocks) gives plane i at these blocks of words.

    Carry-save counters hold all distances as three bit vectors: ones, twos, and over (4 or more). After every
    eight planes, blocks in which every distance is over the radius are abandoned.
    Returns the blocks left and, for each, the word of distances within the radius.
    """
    left = np.arange(words)
    ones = twos = over = np.zeros(words, np.uint64)
    for i in range(64):
        x = differ(i, left)
        carry = ones & x
        ones = ones ^ x
        over = over | (twos & carry)
        twos = twos ^ carry
        if i % 8 == 7:
            beyond = over if radius == 3 else over | (twos & ones) if radius == 2 else over | twos
            going = beyond != np.uint64(0xFFFFFFFFFFFFFFFF)
            if not going.all():
                left, ones, twos, over = left[going], ones[going], twos[going], over[going]
                if not len(left):
                    return left, left.astype(np.uint64)
    return left, ~(over if radius == 3 else over | (twos & ones) if radius == 2 else over | twos)


def _set(blocks: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
    """Positions of the set bits that near() returned."""
    bits = np.unpackbits(np.ascontiguousarray(found).view(np.uint8).reshape(-1, 8), axis=1)
    at, bit = np.nonzero(bits)
    out = blocks[at] * 64 + bit
    return out[out < n]


def pairs_within(x: np.ndarray, radius: int) -> np.ndarray:
    """Indices of the differences x (XOR of two fingerprints) with at most `radius` bits."""
    sliced = planes(x)
    return _set(*near(lambda i, left: sliced[i, left], sliced.shape[1], radius), len(x))


def links(fp: np.ndarray, ids: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest that joins, within each bucket (rows sorted by it), all fingerprints within the radius."""
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    size = np.diff(np.append(first, len(fp)))
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal a, b
        a, b = roots(np.concatenate([a, x]), np.concatenate([b, y]))

    small = np.repeat(np.where(size <= 64, size, 0), size)  # small buckets: all of them at once, by distance in the order
    rank = np.arange(len(fp)) - np.repeat(first, size)
    for lag in range(1, int(small.max(initial=0))):
        i = np.flatnonzero(rank + lag < small)
        for part in np.array_split(i, -(-len(i) // (1 << 18)) or 1):
            hit = part[pairs_within(fp[part] ^ fp[part + lag], radius)]
            if len(hit):
                add(ids[hit], ids[hit + lag])
    for s, n in zip(first[size > 64].tolist(), size[size > 64].tolist()):
        own, whose = fp[s : s + n], ids[s : s + n]
        for col in range(0, n, 1 << 15):  # bit planes of many rows, reused for every query
            held = own[col : col + (1 << 15)]
            sliced, words = planes(held), -(-len(held) // 64)
            for row in range(0, min(n, col + len(held)), 64):
                ask = own[row : row + 64]
                flip = np.where((ask[:, None] >> np.arange(63, -1, -1, dtype=np.uint64)) & np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
                got = _set(*near(lambda i, left: sliced[i, left % words] ^ flip[left // words, i], len(ask) * words, radius), len(ask) * words * 64)
                q, r = got // (words * 64), got % (words * 64)
                ok = (r < len(held)) & (row + q < col + r)
                if ok.any():
                    add(whose[row + q[ok]], whose[col + r[ok]])
    return a, b


def _block_masks(bits: list[int], radius: int) -> list[int]:
    """Masks that keep two of radius + 2 blocks of these bits: values within the radius agree in one mask at least."""
    cut = [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits), radius + 2)]
    return [x | y for x, y in combinations(cut, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bucketed(radius: int, masks: list[int] | None):
    """Compare rows (t, key, fp, id) that come sorted by t and key. masks: hand rows of larger buckets on."""

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda kind, x, y: pa.record_batch({"kind": pa.array(np.full(len(x), kind), pa.int32()), "x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})
        held: list[np.ndarray] = []
        hot = None

        def work(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                bucket = np.cumsum(np.concatenate([[0], (rows[1:, :2] != rows[:-1, :2]).any(1)]))
                x, y = links(rows[:, 2].view(np.uint64), rows[:, 3], bucket, radius)
                if len(x):
                    yield out(0, x, y)

        def hand_on(rows: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch({"kind": pa.array(rows[:, 0] + 1, pa.int32()), "x": pa.array(rows[:, 2], pa.int64()), "y": pa.array(rows[:, 3], pa.int64())})

        for part in parts:
            rows = np.stack([c.to_numpy().astype(np.int64) for c in part.columns], 1)
            if hot is not None:  # a larger bucket goes on
                same = (rows[:, 0] == hot[0]) & (rows[:, 1] == hot[1])
                if same.any():
                    yield hand_on(rows[same])
                    rows = rows[~same]
            if not len(rows):
                continue
            hot = None
            rows = np.concatenate([*held, rows])
            held = []
            last = (rows[:, 0] == rows[-1, 0]) & (rows[:, 1] == rows[-1, 1])
            yield from work(rows[~last]) if masks is None else _split(rows[~last], work, hand_on)
            tail = rows[last]
            if masks is not None and len(tail) > HOT:
                yield hand_on(tail)
                hot = tail[0, :2].copy()
            else:
                held = [tail]
        if held:
            yield from work(held[0])

    return compare


def _split(rows: np.ndarray, work, hand_on) -> Iterator[pa.RecordBatch]:
    """Larger buckets within one batch are handed on, the others compared."""
    if not len(rows):
        return
    first = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)]))
    size = np.diff(np.append(first, len(rows)))
    large = np.repeat(size > HOT, size)
    if large.any():
        yield hand_on(rows[large])
    yield from work(rows[~large])


def near_links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(fp long, id long), fp distinct -> (u, v): edges that join the ids of all fingerprints within the radius.

    Of radius + 2 blocks of bits two are equal if at most `radius` bits differ, so each pair of blocks gives a
    table of buckets. Rows of buckets above HOT rows are cut again in the same way by their other bits. A bucket that is above HOT
    rows even then is cut into parts at random, and each two parts are compared in a task of their own.
    """
    masks = _block_masks(list(range(64)), radius)

    def table(rows: DataFrame, cuts: list[tuple[int, int, int]], more) -> DataFrame:
        """cuts: (table that a row comes from, number, mask)."""
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for f, t, m in cuts]))
        at = rows.select("fp", "id", "t0", each.alias("c")).where("c.f = t0").select("c.t", "c.key", "fp", "id")
        return at.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(_bucketed(radius, more), "kind int, x long, y long")

    first = stored(table(prints.withColumn("t0", F.lit(0)), [(0, t, m) for t, m in enumerate(masks)], masks), "near-links")
    rest = first.where("kind > 0")
    edges = first.where("kind = 0").select(F.col("x").alias("u"), F.col("y").alias("v"))
    if rest.isEmpty():
        return edges
    finer = []
    for t, m in enumerate(masks):
        free = [b for b in range(64) if not m >> b & 1]
        finer += [(t + 1, len(finer) + i, m | x) for i, x in enumerate(_block_masks(free, radius))]
    second = stored(table(rest.select(F.col("x").alias("fp"), F.col("y").alias("id"), F.col("kind").alias("t0")), finer, [m for *_, m in finer]), "near-links")
    edges = edges.unionByName(second.where("kind = 0").select(F.col("x").alias("u"), F.col("y").alias("v")))
    last = second.where("kind > 0")
    if last.isEmpty():
        return edges
    mask = F.element_at(F.array(*[F.lit(_signed(m)) for *_, m in finer]), F.col("kind"))
    rows = last.select("kind", F.col("x").bitwiseAND(mask).alias("key"), F.col("x").alias("fp"), F.col("y").alias("id"))
    size = stored(rows.groupBy("kind", "key").agg(F.ceil(F.count("*") / HOT).cast("int").alias("parts")), "near-parts")
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    pairs = rows.join(size, ["kind", "key"]).select("kind", "key", "fp", "id", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = pairs.select(F.col("kind").alias("t"), F.xxhash64("kind", "key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp", "id")
    third = dealt.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(_bucketed(radius, None), "kind int, x long, y long")
    return edges.unionByName(third.select(F.col("x").alias("u"), F.col("y").alias("v")))


def simhash_groups(docs: DataFrame, radius: int = 3, k: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links).

    Texts are lower-cased (A-Z) and cut into words at white space. Null and empty texts have fingerprint zero and
    are linked like others. Equal fingerprints meet once, under their smallest doc_id, before any comparison.
    Rows without doc_id have no say in a component's id; if no row of a fingerprint has one, component_id is null.
    Repeated rows stay repeated. No rows: no rows. Other columns are ignored.
    """
    prints = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints(k), "doc_id long, fp long"), "fingerprints")
    each = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("id")).where("id is not null"), "distinct-fingerprints")
    parts = connected_components(near_links(each, radius))
    named = each.join(parts, each.id == parts.node, "left").select(F.col("fp").alias("fp1"), F.coalesce("component", "id").alias("component_id"))
    named = stored(named, "simhash-groups")  # so that the join below is between two plain shuffles, and hot fingerprints are split
    return prints.join(named, prints.fp == named.fp1, "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


WIDE = 4  # words of 64 bits in the fingerprints of near_groups()
BANDS, ROWS = 6, 2
_RNG = np.random.Generator(np.random.PCG64(99))
_PRINT = _RNG.integers(0, 2**63, WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(text: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles of k words (A-Z lower-cased; fewer words: all of them), sorted, and each text's first."""
    data, at = flat(text)
    starts, ends, first = spans(SPACE[data], at)
    words, n = span_hash(LOWER[data], starts, ends), np.diff(first)
    whose = owners(first, len(words))
    whole = rolling(words, k)
    begin = np.flatnonzero(first[1:][whose] - np.arange(len(words)) >= k)
    short = np.flatnonzero((n > 0) & (n < k))
    few = [mix(words[first[i] : first[i + 1]].sum(dtype=np.uint64, keepdims=True) + np.uint64(n[i]))[0] if n[i] == 1 else mix(rolling(words[first[i] : first[i + 1]], int(n[i])))[0] for i in short.tolist()]
    doc, h = np.concatenate([whose[begin], short]), np.concatenate([whole[begin], np.array(few, np.uint64)])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])[: len(doc)]
    return h[keep], np.searchsorted(doc[keep], np.arange(len(text) + 1))


def _sum(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums (along the first axis) of each text's rows; 0 where it has none."""
    out = np.zeros((len(first) - 1, *x.shape[1:]), np.int64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = np.add.reduceat(x, first[some], 0, dtype=np.int64)
    return out


_SIGNS = "doc_id long, a long, b long, n long, " + ", ".join([f"f{i} long" for i in range(WIDE)] + [f"k{i} long" for i in range(BANDS)]) + ", shingles binary"


def _signs(k: int):
    def signs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row's set of shingles, two hashes of it (a, b), its fingerprint and its band keys."""
        release()
        for part in batches(parts, most=1 << 20):
            h, first = shingle_sets(part.column("text"), k)
            n = np.diff(first)
            some = np.flatnonzero(n)
            out = {"doc_id": part.column("doc_id")}
            for name, f in (("a", _STEP), ("b", _PRINT[0])):
                out[name] = pa.array(mix(_sum(mix(h * f).view(np.int64), first).view(np.uint64) + n.astype(np.uint64)).view(np.int64))
            out["n"] = pa.array(n)
            for i, f in enumerate(_PRINT):
                bits = _sum(np.unpackbits(mix(h * f).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1), first)
                out[f"f{i}"] = pa.array(np.packbits(2 * bits > n[:, None], axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64))
            for i in range(BANDS):
                key = np.full(len(n), i + 1, np.uint64)
                for f in _FACTORS[i * ROWS : (i + 1) * ROWS]:
                    low = np.zeros(len(n), np.uint64)
                    if len(some):
                        low[some] = np.minimum.reduceat(mix(h * f), first[some])
                    key = key * _STEP + low
                out[f"k{i}"] = pa.array(mix(key).view(np.int64))
            cut = (4 * first).tolist()
            raw = (h >> np.uint64(32)).astype("<u4").tobytes()
            out["shingles"] = pa.array([raw[x:y] for x, y in zip(cut, cut[1:])], pa.binary())
            yield pa.record_batch(out)

    return signs


def near_wide(differ, words: int, planes_: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """near() for any number of planes and any radius: distances are bit-sliced counters; blocks in which all exceed the radius are abandoned after every sixteen planes."""
    left, size = np.arange(words), (radius + 1).bit_length() + 1
    count = [np.zeros(words, np.uint64) for _ in range(size)]  # the last bit stays set: too many
    every = np.uint64(0xFFFFFFFFFFFFFFFF)
    beyond = np.zeros(words, np.uint64)
    for i in range(planes_):
        carry = differ(i, left)
        for b in range(size - 1):
            count[b], carry = count[b] ^ carry, count[b] & carry
        count[-1] = count[-1] | carry
        if i % 16 == 15 or i + 1 == planes_:
            # is the count over the radius? from its highest bit down
            beyond, same = count[-1], ~count[-1]
            for b in range(size - 2, -1, -1):
                if radius >> b & 1:
                    same = same & count[b]
                else:
                    beyond = beyond | (same & count[b])
                    same = same & ~count[b]
            going = beyond != every
            if not going.all():
                left, beyond, count = left[going], beyond[going], [c[going] for c in count]
                if not len(left):
                    break
    return left, ~beyond


def wide_planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of rows of WIDE words, plane by plane of each word."""
    return np.concatenate([planes(values[:, i]) for i in range(values.shape[1])])


def _within(ask: np.ndarray, sliced: np.ndarray, words: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(asking row, held row) of all within the radius; sliced: the planes of the held rows, in `words` words."""
    bits = np.concatenate([(ask[:, [w]] >> np.arange(63, -1, -1, dtype=np.uint64)) & np.uint64(1) for w in range(ask.shape[1])], 1)
    flip = np.where(bits == 1, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    got = _set(*near_wide(lambda p, left: sliced[p, left % words] ^ flip[left // words, p], len(ask) * words, len(sliced), radius), len(ask) * words * 64)
    return got // (words * 64), got % (words * 64)


class _Found:
    """Rows (i, distance, j): the `most` least of each i, and one more; the others go whenever a million have come together."""

    def __init__(self, fp: np.ndarray, most: int, allowed=None, beyond=None):
        self.fp, self.most, self.allowed, self.beyond = fp, most, allowed, beyond
        self.rows, self.size = [np.zeros((3, 0), np.int64)], 0

    def take(self, i: np.ndarray, j: np.ndarray) -> None:
        if self.allowed is not None:
            some = self.allowed(i, j)
            i, j = i[some], j[some]
        distance = np.bitwise_count(self.fp[i] ^ self.fp[j]).sum(1, dtype=np.int64)
        if self.beyond is not None:
            some = self.beyond(i, j, distance)
            i, j, distance = i[some], j[some], distance[some]
        self.rows.append(np.stack([i, distance, j]))
        self.size += len(i)
        if self.size > 1 << 20:
            self.rows = [self.least()]
            self.size = self.rows[0].shape[1] // 2  # what stays counts less, or nothing would ever come together

    def least(self) -> np.ndarray:
        rows = np.concatenate(self.rows, 1)
        rows = rows[:, np.lexsort((rows[2], rows[1], rows[0]))]
        begin = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1]])[: rows.shape[1]])
        return rows[:, np.arange(rows.shape[1]) - np.repeat(begin, np.diff(np.append(begin, rows.shape[1]))) <= self.most]

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j) of the least, and each i that has more."""
        rows, more = self.split()
        return rows[0], rows[2], more[0]

    def split(self) -> tuple[np.ndarray, np.ndarray]:
        """The least rows of each i, and the first row beyond them of each i that has more."""
        rows = self.least()
        begin = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1]])[: rows.shape[1]])
        over = np.arange(rows.shape[1]) - np.repeat(begin, np.diff(np.append(begin, rows.shape[1]))) == self.most
        return rows[:, ~over], rows[:, over]


def nearest(fp: np.ndarray, bucket: np.ndarray, radius: int, most: int = 4, allowed=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the `most` nearest earlier ones of its bucket within the radius, of those that allowed(rows, earlier rows) lets through: (row, earlier row), and the rows that have more. Rows are sorted by bucket."""
    return _earlier(fp, bucket, radius, _Found(fp, most, allowed)).all()


def _earlier(fp: np.ndarray, bucket: np.ndarray, radius: int, found: _Found) -> _Found:
    """Each row held against the earlier ones of its bucket."""
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    size = np.diff(np.append(first, len(fp)))
    take = found.take
    small = np.repeat(np.where(size <= 64, size, 0), size)
    rank = np.arange(len(fp)) - np.repeat(first, size)
    for lag in range(1, int(small.max(initial=0))):
        i = np.flatnonzero((rank >= lag) & (small > 0))
        for part in np.array_split(i, -(-len(i) // (1 << 16)) or 1):
            sliced = wide_planes(fp[part] ^ fp[part - lag])
            hit = part[_set(*near_wide(lambda p, left, s=sliced: s[p, left], sliced.shape[1], len(sliced), radius), len(part))]
            take(hit, hit - lag)
    for s, n in zip(first[size > 64].tolist(), size[size > 64].tolist()):
        for col in range(0, n, 1 << 14):
            held = fp[s + col : s + min(n, col + (1 << 14))]
            sliced, words = wide_planes(held), -(-len(held) // 64)
            for row in range(col, n, 64):
                q, r = _within(fp[s + row : s + min(n, row + 64)], sliced, words, radius)
                ok = (r < len(held)) & (col + r < row + q)
                if ok.any():
                    take(s + row + q[ok], s + col + r[ok])
    return found


def _others(asks: np.ndarray, fp: np.ndarray, radius: int, found: _Found) -> _Found:
    """Some rows of one bucket held against all others and not only the earlier ones."""
    for col in range(0, len(fp), 1 << 14):
        held = fp[col : col + (1 << 14)]
        sliced, words = wide_planes(held), -(-len(held) // 64)
        for row in range(0, len(asks), 64):
            own = asks[row : row + 64]
            q, r = _within(fp[own], sliced, words, radius)
            ok = (r < len(held)) & (own[q] != col + r)
            if ok.any():
                found.take(own[q[ok]], col + r[ok])
    return found


def _candidates(radius: int, most: int):
    def candidates(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, id, f0..., component, ask, distance, upto, others) come sorted by key and id. Returns pairs (u, v), and for rows u of a bucket that have more where they go on.

        A row has asked its bucket for all that come before (distance, upto) in the order of distance and id: of all
        others, or else of those with smaller ids. Those with larger ids ask for it themselves, unless they are in the
        bucket's largest group; once a group is that large it stays so.
        """
        release()
        held: list[pa.Table] = []

        def work(table: pa.Table) -> pa.RecordBatch:
            key, ids = table.column("key").to_numpy(), table.column("id").to_numpy()
            fp = np.stack([table.column(f"f{w}").to_numpy() for w in range(WIDE)], 1).view(np.uint64)
            component, ask, others = (table.column(c).to_numpy(zero_copy_only=False) if c != "component" else table.column(c).to_numpy() for c in ("component", "ask", "others"))
            since, upto = table.column("distance").to_numpy(), table.column("upto").to_numpy()

            def found(rows: np.ndarray) -> _Found:
                def allowed(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                    i, j = rows[i], rows[j]
                    return ask[i] & (component[i] != component[j])

                def beyond(i: np.ndarray, j: np.ndarray, distance: np.ndarray) -> np.ndarray:
                    i, j = rows[i], rows[j]
                    return (distance > since[i]) | ((distance == since[i]) & (ids[j] >= upto[i])) | (~others[i] & (ids[j] > ids[i]))

                return _Found(fp[rows], most, allowed, beyond)

            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(first, len(key)))
            whole, got = np.ones(len(key), bool), []

            def keep(rows: np.ndarray, of: _Found, all_others: bool) -> None:
                pairs, more = of.split()
                one = lambda x, more: (rows[x[0]], rows[x[2]], x[1], np.full(x.shape[1], more), np.full(x.shape[1], all_others))
                got.extend([one(pairs, False), one(more, True)])

            for a, n in zip(first[size > 64].tolist(), size[size > 64].tolist()):
                own = slice(a, a + n)
                names, counts = np.unique(component[own], return_counts=True)
                if counts.max() > n // 2:  # two texts that are not linked yet: one of them at least is outside the largest group
                    whole[own] = False
                    asks = np.flatnonzero(ask[own] & (component[own] != names[counts.argmax()])) if ask[own].all() else np.flatnonzero(ask[own])
                    rows = np.arange(a, a + n)
                    keep(rows, _others(asks, fp[own], radius, found(rows)), True)
            rest = np.flatnonzero(whole)
            keep(rest, _earlier(fp[rest], key[rest], radius, found(rest)), False)
            i, j, distance, more, all_others = (np.concatenate(x) for x in zip(*got))
            return pa.record_batch({"key": pa.array(key[i]), "u": pa.array(ids[i]), "v": pa.array(ids[j]), "more": pa.array(more), "distance": pa.array(distance), "others": pa.array(all_others)})

        for part in parts:
            if part.num_rows:
                key = part.column("key").to_numpy()
                cut = int(np.argmax(key == key[-1]))
                table = pa.Table.from_batches([part])
                if held and (cut or key[0] != held[-1].column("key")[-1].as_py()):
                    whole = pa.concat_tables([*held, table.slice(0, cut)])
                    held = []
                    yield work(whole)
                elif cut:
                    yield work(table.slice(0, cut))
                held.append(table.slice(cut))
        if held:
            yield work(pa.concat_tables(held))

    return candidates


def _similar(least: float):
    def similar(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows (u, v, x, y), those whose sets x and y have a Jaccard similarity of `least` or more."""
        for part in parts:
            ok = []
            for x, y in zip(part.column("x").to_pylist(), part.column("y").to_pylist()):
                both = len(np.intersect1d(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")))
                ok.append(both >= least * ((len(x) + len(y)) // 4 - both) - 1e-9)
            yield part.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return similar


#: Keys of rows whose keys are hot, level by level: how many keys, of how many minima each, out of POOL minima. At a similarity of 0.8 pairs meet in 0.9998 and 0.999 of all cases.
FINER, POOL = ((16, 4), (64, 8)), 128
_POOL = _RNG.integers(0, 2**63, POOL, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PICKS = [np.arange(64).reshape(16, 4), np.stack([_RNG.choice(POOL, 8, replace=False) for _ in range(64)])]


def _finer(level: int):
    def finer(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys of each set of shingles, each of several minima."""
        release()
        picks = _PICKS[level]
        some = np.unique(picks)
        for part in parts:
            out = []
            for raw in part.column("shingles").to_pylist():
                h = np.frombuffer(raw, "<u4").astype(np.uint64)
                low = np.zeros(POOL, np.uint64)
                for i in some.tolist():
                    low[i] = mix((h + np.uint64(1)) * _POOL[i]).min(initial=0xFFFFFFFFFFFFFFFF)
                key = np.arange(len(picks), dtype=np.uint64) + np.uint64((level + 1) << 32)
                for i in range(picks.shape[1]):
                    key = key * _STEP + low[picks[:, i]]
                out.append(mix(key).view(np.int64))
            yield part.drop_columns(["shingles"]).append_column("keys", pa.array(out, pa.list_(pa.int64())))

    return finer


def _sets(rows: DataFrame, texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles) of some texts."""
    own = rows.where("doc_id is not null").select(F.col("doc_id").alias("id"), "a", "b", "n", "shingles").join(ids, "id", "left_semi")
    return own.join(texts.select("id", "a", "b", "n"), ["id", "a", "b", "n"], "left_semi").dropDuplicates(["id"]).select("id", "shingles")


def _buckets(rows: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(key, id, fingerprint): texts that share a key are compared. Rows of a key above HOT rows get the finer keys of FINER instead. Keys above HOT rows at the last level are cut into parts, and each two parts are a bucket: the second table, for when most of these
    texts are linked already. To that end each of them is in two buckets of the first table, with its part and the next of one of its keys."""
    prints = [f"f{i}" for i in range(WIDE)]
    dealt = texts.select("id", *prints, F.explode(F.array(*[F.xxhash64(F.lit(i), F.col(f"k{i}")) for i in range(BANDS)])).alias("key"))
    ready = None
    for level in range(len(FINER) + 1):
        dealt = stored(dealt, "near-keys")
        hot = stored(dealt.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > HOT), "near-hot")
        both = dealt.join(hot, "key", "left")
        part = both.where("m is null").select("key", "id", *prints)
        ready = part if ready is None else ready.unionByName(part)
        if hot.isEmpty():
            return ready, None
        waiting = both.where("m is not null")
        if level < len(FINER):
            ids = stored(waiting.select("id", *prints).dropDuplicates(["id"]), "near-waiting")
            keys = ids.join(_sets(rows, texts, ids.select("id")), "id").mapInArrow(_finer(level), ", ".join(["id long", *[f"{c} long" for c in prints], "keys array<long>"]))
            dealt = keys.select("id", *prints, F.explode("keys").alias("key"))
    size = F.ceil(F.col("m") / HOT).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit("part")), size).cast("int")
    waiting = waiting.select("key", "id", *prints, own.alias("own"), size.alias("size"))
    pairs = waiting.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    blocks = pairs.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"), F.lit("parts")).alias("key"), "id", *prints)
    one = waiting.join(waiting.groupBy("id").agg(F.min("key").alias("key")), ["id", "key"])
    seeds = one.select(F.explode(F.array(F.col("own"), (F.col("own") + 1) % F.col("size"))).alias("other"), "key", "id", *prints).select(F.xxhash64("key", "other", F.lit("seeds")).alias("key"), "id", *prints)
    return ready.unionByName(seeds.distinct()), blocks


def near_groups(docs: DataFrame, least: float = 0.8, k: int = 5, radius: int = 56, most: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, component_id: the smallest doc_id reachable by links between texts whose k-word shingles have a Jaccard similarity of `least` or more.

    Texts with the same set of shingles are one, under their smallest doc_id. The others meet in buckets of two minima of
    their shingles (BANDS of them: at 0.8, 99.8 % of pairs meet), where bit-sliced SimHashes of 64 * WIDE bits are compared, and each text asks
    for the `most` nearest of those with smaller ids (two sets at 0.8 differ in 39 of 256 bits on average, with a deviation of 6; the radius is three
    deviations more). What it finds is linked if the sets themselves are similar enough. Texts of a bucket that have more within
    the radius ask again, for four times as many, of those that are not in their component yet, from where they stopped in that bucket on, until none is
    left: `most` decides about work, never about links. Rows of buckets above HOT rows go by finer keys (see _buckets).

    Null and empty texts are alike. Texts with fewer than k words are one shingle. Rows without a doc_id have no say in a
    component's id; if no row of a text has one, component_id is null. Repeated rows stay repeated. No rows: no rows. Other columns are ignored.
    """
    prints = [f"f{i}" for i in range(WIDE)]
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_signs(k), _SIGNS), "near-signs")
    texts = stored(rows.where("doc_id is not null").groupBy("a", "b", "n").agg(F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in [*prints, *[f"k{i}" for i in range(BANDS)]]]), "near-texts")
    buckets, blocks = _buckets(rows, texts)
    work = buckets.select("key", "id", *prints, F.col("id").alias("component"), F.lit(True).alias("ask"), F.lit(-1).cast("long").alias("distance"), F.lit(0).cast("long").alias("upto"), F.lit(False).alias("others"))
    parts = None
    while True:
        met = stored(work.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_candidates(radius, most), "key long, u long, v long, more boolean, distance long, others boolean"), "near-pairs")
        pairs = met.where("not more").select("u", "v").distinct()
        ids = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct()
        sets = stored(_sets(rows, texts, ids), "near-sets")  # so that the joins below are between plain shuffles, and texts with very many links are split
        both = pairs.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("x")), "u").join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("y")), "v").select("u", "v", "x", "y")
        new = stored(both.mapInArrow(_similar(least), "u long, v long"), "near-links")
        # earlier links are as good as the components they made
        parts = connected_components(new if parts is None else parts.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(new))
        more = stored(met.where("more").select("key", F.col("u").alias("id"), "distance", F.col("v").alias("upto"), "others"), "near-more")
        if blocks is None and more.isEmpty():
            break
        work = buckets.join(more.select("key").distinct(), "key", "left_semi").join(more.withColumn("ask", F.lit(True)), ["key", "id"], "left")
        if blocks is not None:  # buckets of parts, now that most of their texts are linked
            work, buckets, blocks = work.unionByName(blocks.withColumn("ask", F.lit(True)), allowMissingColumns=True), buckets.unionByName(blocks), None
        work = work.join(parts.withColumnRenamed("node", "id"), "id", "left")
        work = work.select("key", "id", *prints, F.coalesce("component", "id").alias("component"), F.coalesce("ask", F.lit(False)).alias("ask"), F.coalesce("distance", F.lit(-1)).alias("distance"), F.coalesce("upto", F.lit(0)).alias("upto"), F.coalesce("others", F.lit(False)).alias("others"))
        most *= 4
    named = stored(texts.join(parts, texts.id == parts.node, "left").select("a", "b", "n", F.coalesce("component", "id").alias("component_id")), "near-named")
    return rows.select("doc_id", "a", "b", "n").join(named, ["a", "b", "n"], "left").select("doc_id", "component_id")
