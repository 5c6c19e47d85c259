"""Substring dedup: MinHash bands of every short paragraph, passages grown about collisions, exact Jaccard, components."""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import free_name, release, stored
from .textops import LOWER, SPACE, batches, flat, mix, owners, rolling, span_hash, spans

WORDS = 25  # the least passage
PARAGRAPH = 24  # words of the paragraphs that are banded: all places of a text begin one
SHINGLE = 5
BANDS, ROWS = 2, 2
MARGIN = 64  # words on both sides of what collides that a passage can grow to
SHIFTS = (0, 1, -1, 2, -2, 3, -3)  # words put in or left out inside a passage
HOT = 20_000  # places asked of one document in one task
_RNG = np.random.Generator(np.random.PCG64(7))
_FACTORS = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 28) - 1)


def band_keys(text: pa.Array) -> tuple[np.ndarray, ...]:
    """(key, text, word, first, last) of each band of all paragraphs of PARAGRAPH words; paragraphs in a row with the same key give one row, and begin at words `first` to `last`.

    A key is made of ROWS minima of the shingles of a paragraph; word is where the first of these shingles begins. If a
    key stays the same for long (texts that repeat themselves), it is given again once for each paragraph's length.
    """
    data, at = flat(text)
    starts, ends, first = spans(SPACE[data], at)
    n, width = len(starts), PARAGRAPH - SHINGLE + 1
    if n < PARAGRAPH:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4
    whose = owners(first, n)
    begin = np.flatnonzero(first[1:][whose] - np.arange(n) >= PARAGRAPH)
    shingle = rolling(span_hash(LOWER[data], starts, ends), SHINGLE)
    least = []
    for f in _FACTORS:
        low = (mix(shingle * f) & ~_PLACE) | np.arange(len(shingle), dtype=np.uint64)
        size = 1
        while 2 * size <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
        least.append((low[begin] & _PLACE).astype(np.int64))
    keys, places, firsts, lasts = [], [], [], []
    doc = whose[begin]
    for band in range(BANDS):
        key = np.full(len(begin), band + 1, np.uint64)
        for low in least[band * ROWS : (band + 1) * ROWS]:
            key = key * _STEP + shingle[low]
        key = mix(key)
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])[: len(key)])
        since = np.arange(len(key)) - np.repeat(new, np.diff(np.append(new, len(key))))
        some = np.flatnonzero(since % width == 0)
        keys.append(key[some])
        places.append(least[band * ROWS][some])
        firsts.append(begin[some])
        lasts.append(begin[np.append(some, len(key))[1:] - 1])
    place = np.concatenate(places)
    at = first[whose[place]]
    return np.concatenate(keys), whose[place], place - at, np.concatenate(firsts) - at, np.concatenate(lasts) - at


def _places(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every band key of every document, where it stands, and its paragraphs (how far before the place they begin, and how many more there are)."""
    release()
    for part in batches(parts, most=1 << 20):
        key, row, place, begin, last = band_keys(part.column("text"))
        yield pa.record_batch({"key": pa.array(key.view(np.int64)), "doc": pa.array(part.column("doc_id").to_numpy()[row]), "place": pa.array(place.astype(np.int32)), "ahead": pa.array((place - begin).astype(np.int8)), "further": pa.array((last - begin).astype(np.int8))})


def stars(places: DataFrame, *also: str) -> DataFrame:
    """Of places (key, doc, place), those whose key stands in an earlier document too, with the first place of the first document that holds it (to_doc, to_place, and to_ for other columns), and whether other places hold it (more).

    Keys are counted before anything is joined, and joins are between plain shuffles, so the places of a hot key are split; which place is first does not depend on how rows are dealt.
    """
    first = places.groupBy("key").agg(F.min("doc").alias("to_doc"), F.max("doc").alias("last"), F.count("*").alias("n")).where("to_doc != last")
    first = stored(first.select("key", "to_doc", (F.col("n") > 2).alias("more")), "passage-keys")
    some = stored(places.join(first.hint("shuffle_hash"), "key"), "passage-places")  # of all places, which are not sorted for it; a partition's part of the keys is held
    root = stored(some.where("doc = to_doc").groupBy("key").agg(F.min("place").alias("to_place"), *[F.min(c).alias(f"to_{c}") for c in also]), "passage-roots")
    return some.where("doc != to_doc").join(root, "key")


_SLICE = "d long, r long, diagonal int, side int, more boolean, begin int, last int, at int, upto int, word int, byte long, slice binary"


def _slices(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by document, its texts before what is asked of them (collisions at words `at` to `upto`; MARGIN words more on both sides go out). Texts that nothing is asked of are not looked at."""
    now, texts = None, []  # texts: bytes, or (bytes, starts, ends)
    names = [x.split()[0] for x in _SLICE.split(", ")]
    rows: list[tuple] = []
    size = 0

    def out() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), *[pa.int32()] * 5, pa.int64(), pa.binary()]
        made = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        rows.clear()
        return made

    for part in parts:
        text = part.column("text")
        for i, (doc, side, d, r, diagonal, more, begin, last, at, upto) in enumerate(zip(*(part.column(k).to_pylist() for k in ("doc", "side", "d", "r", "diagonal", "more", "begin", "last", "at", "upto")))):
            if doc != now:
                now, texts = doc, []
            if side is None:
                texts.append(text[i].as_buffer())
                continue
            for j, t in enumerate(texts):
                if not isinstance(t, tuple):
                    raw = t.to_pybytes() if t is not None else b""
                    data = np.frombuffer(raw, np.uint8)
                    texts[j] = t = (raw, *spans(SPACE[data], np.array([0, len(data)]))[:2])
                raw, starts, ends = t
                a, b = max(at - MARGIN, 0), min(upto + PARAGRAPH + MARGIN, len(starts))
                if a < b:
                    rows.append((d, r, diagonal, side, more, begin, last, at, upto, a, int(starts[a]), raw[starts[a] : ends[b - 1]]))
                    size += len(rows[-1][-1])
                    if size > 1 << 20:
                        yield out()
                        size = 0
    if rows:
        yield out()


def _runs(h: tuple[np.ndarray, np.ndarray], first: tuple[np.ndarray, np.ndarray], offset: np.ndarray) -> tuple[np.ndarray, ...]:
    """(pair, begin in d, begin in r, length) of equal words in a row, SHINGLE or more, where word i of r stands beside word i + offset of d."""
    nd, nr = np.diff(first[0]), np.diff(first[1])
    lo = np.maximum(0, -offset)
    n = np.maximum(0, np.minimum(nr, nd - offset) - lo)
    pair, at = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    i = np.arange(len(pair)) - np.repeat(at - lo, n)  # word of r
    same = h[0][first[0][:-1][pair] + i + offset[pair]] == h[1][first[1][:-1][pair] + i]
    edge = np.zeros(len(pair) + 1, bool)
    edge[at] = True
    before, after = np.append(False, same[:-1]) & ~edge[:-1], np.append(same[1:], False) & ~edge[1:]
    a, b = np.flatnonzero(same & ~before), np.flatnonzero(same & ~after) + 1
    long = b - a >= SHINGLE
    a, b = a[long], b[long]
    return pair[a], i[a] + offset[pair[a]], i[a], b - a


def ordered(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of runs (begin in d, begin in r, length), the longer ones first, those that keep one order in both texts; what overlaps is cut off."""
    out: list[tuple[int, int, int]] = []
    for d, r, n in sorted(runs, key=lambda x: (-x[2], x)):
        at = bisect_left(out, (d, r, n))
        if at:
            a, b, m = out[at - 1]
            cut = max(a + m - d, b + m - r, 0)
            d, r, n = d + cut, r + cut, n - cut
        if at < len(out):
            n = min(n, out[at][0] - d, out[at][1] - r)
        if n >= SHINGLE:
            out.insert(bisect_left(out, (d, r, n)), (d, r, n))
    return out


def grow(runs: list[tuple[int, int, int]], tenths: int = 8) -> list[tuple[int, int]]:
    """Longest stretches of runs, first and last, whose shared shingles are `tenths` tenths or more of all: one after the other, until each run is in one.

    With m shared shingles of n in d and k in r, Jaccard is m / (n + k - m), so m (10 + tenths) - tenths (n + k) >= 0 is asked: a sum over
    runs and the gaps between them.
    """
    gain = [(10 - tenths) * (x[2] - SHINGLE + 1) for x in runs]
    loss = [tenths * sum(runs[i + 1][side] - runs[i][side] - runs[i][2] + SHINGLE - 1 for side in (0, 1)) for i in range(len(runs) - 1)]
    out, todo = [], [(0, len(runs))]
    while todo:
        a, b = todo.pop()
        if a >= b:
            continue
        begin, end, total = [], [], 0
        for i in range(a, b):
            begin.append(total)
            total += gain[i]
            end.append(total)
            total -= loss[i] if i + 1 < b else 0
        low: list[int] = []
        for i, x in enumerate(begin):
            if not low or x < begin[low[-1]]:
                low.append(i)
        best = (0, 0, 0)
        for j in range(b - a - 1, -1, -1):
            while low and begin[low[-1]] <= end[j]:
                i = low.pop()
                if i <= j:
                    best = max(best, (j - i + 1, a + i, a + j))
        _, i, j = best
        out.append((i, j))
        todo += [(a, i), (j + 1, b)]
    return sorted(out)


def jaccard(a: list[bytes], b: list[bytes]) -> float:
    x, y = (set(zip(*(w[i:] for i in range(SHINGLE)))) for w in (a, b))
    return len(x & y) / len(x | y)


_PASSAGE = [f"{side}_{name} long" for side in "dr" for name in ("doc", "word", "words", "lo", "hi", "crc")]
#: A passage of two documents (_PASSAGE), or the slice of a document (d_doc) with finer keys of places outside passages, and those places; word, byte and size tell where the slice begins, and its length.
_FOUND = ", ".join([*_PASSAGE, "word int", "size int", "byte long", "slice binary", "keys array<long>", "places array<int>"])
_CONTEXT = 24  # words on each side of a collision that finer keys of near passages look at
_SEEDS = _RNG.integers(0, 2**63, 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def finer_keys(whole: np.ndarray, shingle: np.ndarray, begin: int, last: int, at: int, upto: int, covered: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(key, word): keys of a slice (hashes of its WORDS words in a row, and of its shingles) about the collision at words `at` to `upto`, for another round. The paragraphs that collide begin at words `begin` to `last`.

    Of a collision that is not wholly inside one passage, WORDS words in a row that hold such a paragraph, but for those inside passages: two texts with an equal one share
    a passage, whatever third text they met before. Then minima of the shingles before and after the collision, each
    with the shingle at it: these bring texts together whose surroundings are alike. Of a collision inside a
    passage, the WORDS words that go one word beyond it at either end: another text can share more.
    """
    around = [(a, b) for a, b in covered if a <= at and upto + SHINGLE <= b]
    start = np.array([x for a, b in around for x in (a - 1, b - WORDS + 1)], np.int64) if around else np.arange(begin - 1, last + 1)
    start = start[(start >= 0) & (start < len(whole))]
    for a, b in () if around else covered:
        start = start[(start < a) | (start + WORDS > b)]
    keys, places = [mix(whole[start] + np.uint64(0x5851F42D4C957F2D))], [start]
    for anchor in () if around else {at, upto}:
        if 0 <= anchor < len(shingle) and not any(a <= anchor and anchor + SHINGLE <= b for a, b in covered):
            for side, part in enumerate((shingle[max(0, anchor - _CONTEXT) : anchor], shingle[anchor + 1 : anchor + 1 + _CONTEXT])):
                if len(part):
                    low = mix(part[:, None] * _SEEDS).min(0)
                    keys.append(mix(low * _STEP + shingle[anchor] + np.arange(len(_SEEDS), dtype=np.uint64) + np.uint64(side << 8)))
                    places.append(np.full(len(_SEEDS), anchor))
    return np.concatenate(keys), np.concatenate(places)


def _grown(least: float, again: bool):
    """again: places without a passage get finer keys."""

    def passages(pairs: list[tuple]) -> pa.RecordBatch:
        """pairs: (d, r, diagonal, (word, byte, slice, more, begin, last, at, upto) of d, of r)."""
        sides, starts, ends, first = [], [], [], []
        for k in (3, 4):
            data, at = flat(pa.array([x[k][2] for x in pairs], pa.binary()))
            s, e, f = spans(SPACE[data], at)
            sides.append(span_hash(LOWER[data], s, e))
            own = at[owners(f, len(s))]
            starts.append(s - own)
            ends.append(e - own)
            first.append(f)
        offset = np.array([x[2] - x[3][0] + x[4][0] for x in pairs], np.int64)
        got = [_runs((sides[0], sides[1]), (first[0], first[1]), offset + shift) for shift in SHIFTS]
        pair, d, r, n = (np.concatenate(x) for x in zip(*got))
        order = np.argsort(pair, kind="stable")
        pair, runs = pair[order], np.stack([d[order], r[order], n[order]], 1)
        out: list[tuple] = []
        none = (None,) * 6
        covered: dict[int, list[tuple]] = {}
        cuts = [0, *(np.flatnonzero(np.diff(pair)) + 1).tolist(), len(pair)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b or (b - a == 1 and runs[a, 2] < WORDS):
                continue
            i = int(pair[a])
            own = [tuple(x) for x in runs[a:b].tolist()]
            own = ordered(own) if len(own) > 1 else own
            text = [pairs[i][3][2], pairs[i][4][2]]

            def row(x: int, y: int, i: int = i, own: list = own, text: list = text) -> tuple | None:
                """Runs x to y as a passage, if its texts say so too."""
                made, words, where = [], [], []
                for side in (0, 1):
                    begin, end = own[x][side], own[y][side] + own[y][2]
                    lo, hi = int(starts[side][first[side][i] + begin]), int(ends[side][first[side][i] + end - 1])
                    raw = text[side][lo:hi]
                    words.append(raw.lower().split())
                    where.append((begin, end))
                    word, byte = pairs[i][3 + side][:2]
                    made += [pairs[i][side], word + begin, end - begin, byte + lo, byte + hi, zlib.crc32(raw)]
                same = words[0] == words[1] if x == y else jaccard(*words) >= least - 1e-9
                if same:
                    covered.setdefault(i, []).append(where)
                return tuple(made) if same else None

            for x, y in grow(own):
                if own[y][0] + own[y][2] - own[x][0] < WORDS:
                    continue
                found = [row(x, y)]
                if x < y and found[0] is None:
                    found = [row(k, k) for k in range(x, y + 1) if own[k][2] >= WORDS]
                out += [(*f, *none) for f in found if f]
        if again:  # the first document of a key has met all others already
            whole, shingle = rolling(sides[0], WORDS), rolling(sides[0], SHINGLE)
            for i, x in enumerate(pairs):
                word, byte, raw, more, begin, last, at, upto = x[3]
                if more:
                    lo, hi = int(first[0][i]), int(first[0][i + 1])
                    key, place = finer_keys(whole[lo : max(lo, hi - WORDS + 1)], shingle[lo : max(lo, hi - SHINGLE + 1)], begin - word, last - word, at - word, upto - word, [c[0] for c in covered.get(i, [])])
                    if len(key):
                        out.append((x[0], *[None] * (len(_PASSAGE) - 1), word, len(raw), byte, raw, key.view(np.int64), (place + word).astype(np.int32)))
        kinds = [*[pa.int64()] * len(_PASSAGE), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * len(kinds), kinds)], names=[x.split()[0] for x in _FOUND.split(", ")])

    def grown(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of _SLICE come sorted by pair and side; each slice of d is held against each of r."""
        release()
        now, own, pairs, size = None, [], [], 0
        for part in parts:
            for d, r, diagonal, side, more, begin, last, at, upto, word, byte, raw in zip(*(c.to_pylist() for c in part.columns)):
                if (d, r, diagonal) != now:
                    now, own = (d, r, diagonal), []
                one = (word, byte, raw, more, begin, last, at, upto)
                if side == 0:
                    if one not in own:
                        own.append(one)
                    continue
                for x in own:
                    pairs.append((*now, x, one))
                    size += len(x[2]) + len(raw)
                    if size > 2 << 20:
                        yield passages(pairs)
                        pairs, size = [], 0
        if pairs:
            yield passages(pairs)

    return grown


def linked_passages(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """Passages that a document shares with one of a smaller doc_id: (doc, word, words, lo, hi, crc) of both, d_ and r_. See repeated_passages()."""
    plain = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    met = stars(plain.mapInArrow(_places, "key long, doc long, place int, ahead byte, further byte"))
    chains = met.groupBy(F.col("doc").alias("d"), F.col("to_doc").alias("r"), (F.col("place") - F.col("to_place")).alias("diagonal")).agg(F.min("place").alias("lo"), F.max("place").alias("hi"), F.min(F.col("place") - F.col("ahead")).alias("begin"), F.max(F.col("place") - F.col("ahead") + F.col("further")).alias("last"), F.bool_or("more").alias("more"))
    chains = stored(chains, "passage-chains")
    back = F.when(F.col("side") == 0, 0).otherwise(F.col("diagonal"))
    asks = chains.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).select(F.when(F.col("side") == 0, F.col("d")).otherwise(F.col("r")).alias("doc"), "side", "d", "r", "diagonal", "more", "begin", "last", (F.col("lo") - back).alias("at"), (F.col("hi") - back).alias("upto"))
    # documents of which very much is asked are dealt to several tasks; the table has one row for each, a HOT-th of all rows at most
    hot = stored(asks.groupBy("doc").agg(F.ceil(F.count("*") / HOT).cast("int").alias("cuts")).where("cuts > 1"), "passage-hot")
    asks = asks.join(hot, "doc", "left").withColumn("cut", F.pmod(F.xxhash64("d", "r", "diagonal"), F.coalesce("cuts", F.lit(1))).cast("int")).drop("cuts").withColumn("text", F.lit(None).cast("binary"))
    null = lambda name, kind: F.lit(None).cast(kind).alias(name)
    texts = plain.join(hot, plain.doc_id == hot.doc, "left").select(F.col("doc_id").alias("doc"), null("side", "int"), null("d", "long"), null("r", "long"), null("diagonal", "int"), null("more", "boolean"), null("begin", "int"), null("last", "int"), null("at", "int"), null("upto", "int"), F.explode(F.sequence(F.lit(0), F.coalesce("cuts", F.lit(1)) - 1)).alias("cut"), F.col("text").cast("binary").alias("text"))
    both = texts.unionByName(asks).repartition("doc", "cut").sortWithinPartitions("doc", "cut", F.asc_nulls_first("side"))
    pairs = both.mapInArrow(_slices, _SLICE)
    found = stored(_verified(pairs, least, again=True), "passages-first")
    # another round for places outside passages: other texts can share more there
    slice_id = F.xxhash64("d_doc", "word", "size")
    pair = F.explode(F.arrays_zip("keys", "places")).alias("x")
    finer = found.where("slice is not null").select(F.col("d_doc").alias("doc"), slice_id.alias("slice_id"), pair).groupBy(F.col("x.keys").alias("key"), "doc", F.col("x.places").alias("place")).agg(F.min("slice_id").alias("slice_id"))
    met = stars(finer, "slice_id").groupBy(F.col("doc").alias("d"), F.col("to_doc").alias("r"), (F.col("place") - F.col("to_place")).alias("diagonal")).agg(F.min(F.struct("place", "to_place", "slice_id", "to_slice_id")).alias("x"))
    side = lambda i, to: F.struct(F.lit(i).alias("side"), F.col(f"x.{to}place").alias("at"), F.col(f"x.{to}slice_id").alias("slice_id"))
    asks = met.select("d", "r", "diagonal", F.explode(F.array(side(0, ""), side(1, "to_"))).alias("y")).select("d", "r", "diagonal", "y.*")
    slices = stored(found.where("slice is not null").groupBy(slice_id.alias("slice_id")).agg(F.first("word").alias("word"), F.first("byte").alias("byte"), F.first("slice").alias("slice")), "passage-slices")
    pairs = asks.join(slices, "slice_id").select("d", "r", "diagonal", "side", F.lit(False).alias("more"), F.col("at").alias("begin"), F.col("at").alias("last"), "at", F.col("at").alias("upto"), "word", "byte", "slice")
    names = [x.split()[0] for x in _PASSAGE]
    return found.where("slice is null").select(*names).unionByName(_verified(pairs, least, again=False).select(*names)).distinct()


def _verified(pairs: DataFrame, least: float, again: bool) -> DataFrame:
    return pairs.repartition("d", "r", "diagonal").sortWithinPartitions("d", "r", "diagonal", "side", "word").mapInArrow(_grown(least, again), _FOUND)


def repeated_passages(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """Passages that stand in two documents or more, exactly or nearly: doc_id, word_start, n_words, byte_start, byte_end, crc32, cluster_id, keep_doc_id, removed.

    Every PARAGRAPH words in a row are a paragraph (A-Z lower-cased, any white space between), whatever line they stand
    in. Paragraphs meet by MinHash bands (BANDS of ROWS minima of 5-word shingles); equal ones always do. All places of a
    key meet the first document that holds it, and those outside the passages found there meet again by finer keys (see finer_keys()).

    About each link the two texts are laid beside each other, up to MARGIN words beyond the outermost collision, and
    the longest stretches of WORDS words or more that begin and end with a shared shingle and whose 5-word shingles have a
    Jaccard similarity of `least` or more are passages; words put in or left out shift the texts by up to three words.
    Similarity is worked out from the words themselves, not their hashes. A passage of 49 words or more with isolated
    changes cannot be that similar without an unchanged paragraph, so bands lose none of these.

    Passages that are linked, or cover nearly the same place of a document, make a cluster (components; those of a document are
    joined before, as they stand in order). The passage stays in
    the smallest document of its cluster (keep_doc_id) and is removed in all others. Rows of one document can overlap.

    Null and empty texts and those below WORDS words have none. Rows without a doc_id are ignored. Rows with the same
    doc_id count as one document; what repeats within a document only is left alone. No rows: no rows.
    """
    links = stored(linked_passages(docs, least), "passage-links")
    side = lambda s: links.select(F.col(f"{s}_doc").alias("doc_id"), F.col(f"{s}_word").alias("word_start"), F.col(f"{s}_words").alias("n_words"), F.col(f"{s}_lo").alias("byte_start"), F.col(f"{s}_hi").alias("byte_end"), F.col(f"{s}_crc").alias("crc32"))
    name = lambda s: F.xxhash64(*[f"{s}_{x}" for x in ("doc", "word", "words", "crc")])
    nodes = side("d").unionByName(side("r")).distinct().withColumn("node", F.xxhash64("doc_id", "word_start", "n_words", "crc32"))
    # rows of a document, in order, that cover nearly the same place as the one before are one island; windows run over the distinct places of one document
    order = Window.partitionBy("doc_id").orderBy("word_start", "end", "node")
    before = F.lag(F.struct("word_start", "end")).over(order)
    shared = F.least("end", "before.end") - F.col("word_start")
    new = F.coalesce(10 * shared < 8 * (F.greatest("end", "before.end") - F.col("before.word_start")), F.lit(True))
    nodes = nodes.withColumn("end", F.col("word_start") + F.col("n_words")).withColumn("before", before).withColumn("new", new).withColumn("island", F.sum(F.col("new").cast("long")).over(order))
    nodes = stored(nodes.withColumn("whole", F.min("node").over(Window.partitionBy("doc_id", "island"))).drop("end", "before", "new", "island"), "passage-nodes")
    of = lambda n: nodes.select(F.col("node").alias(n), F.col("whole").alias(f"{n}_whole"))
    edges = links.select(name("d").alias("u"), name("r").alias("v")).join(of("u"), "u").join(of("v"), "v").select(F.col("u_whole").alias("u"), F.col("v_whole").alias("v")).distinct()
    parts = connected_components(edges)
    member = stored(nodes.join(parts, nodes.whole == parts.node, "left").withColumn("cluster_id", F.coalesce("component", "whole")).drop(nodes.node).drop(parts.node).drop("whole", "component"), "passage-members")
    keep = stored(member.groupBy("cluster_id").agg(F.min("doc_id").alias("keep_doc_id")), "passage-clusters")  # so that the join below is between two plain shuffles, and hot clusters are split
    return member.join(keep, "cluster_id").select("doc_id", "word_start", "n_words", "byte_start", "byte_end", "crc32", "cluster_id", "keep_doc_id", (F.col("doc_id") != F.col("keep_doc_id")).alias("removed"))


def _cut(text_at: str, gone_at: str):
    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts, text_at, most=8 << 20):
            out = []
            for text, gone in zip(part.column(text_at).to_pylist(), part.column(gone_at).to_pylist()):
                if gone:
                    raw, at, kept = text.encode(), 0, []
                    for x in sorted(gone, key=lambda x: (x["lo"], x["hi"])):
                        if zlib.crc32(raw[x["lo"] : x["hi"]]) != x["crc"]:  # another row of the same doc_id
                            continue
                        if x["lo"] > at:
                            kept.append(raw[at : x["lo"]])
                        at = max(at, x["hi"])
                    text = b"".join([*kept, raw[at:]]).decode()
                out.append(text)
            part = part.drop_columns([gone_at])
            yield part.set_column(part.schema.get_field_index(text_at), text_at, pa.array(out, pa.string()))

    return cut


def substring_dedup(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """docs with every removed passage of repeated_passages() cut out of its text; white space around stays.

    Documents stay as rows even if nothing of their text is left. A null text becomes empty. Rows without a doc_id are
    left as they are. Rows that share a doc_id lose the places that hold the removed text. Other columns pass through, whatever their names.
    """
    found = repeated_passages(docs, least)
    gone = found.where("removed").groupBy("doc_id").agg(F.collect_set(F.struct(F.col("byte_start").alias("lo"), F.col("byte_end").alias("hi"), F.col("crc32").alias("crc"))).alias("gone"))
    gone_at = free_name("gone", docs.columns)
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string")).join(gone.withColumnRenamed("gone", gone_at), "doc_id", "left").select(*docs.columns, gone_at)
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in docs.columns)
    return rows.mapInArrow(_cut("text", gone_at), schema)
