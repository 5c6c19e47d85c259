"""LM scoring: prediction by partial matching over a byte-context trie, and a word unigram base."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import get, put, release, run_dir, stored
from .textops import LOWER, SPACE, batches, flat, span_hash, spans

ORDER = 5  # bytes of context
END = 255  # no byte of UTF-8: stands before a text and ends it
SYMBOLS = 256
UNIT = float(1 << 26)  # probabilities travel as whole numbers of 1 / UNIT in log10: a gram's is right to 1e-8
END_WORD = -7046029254386353131  # key of the end token, apart from any word


def grams(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's (context, symbol) keys: ORDER bytes before and the byte itself, for its words joined by one space and the end; and how many."""
    data, at = flat(text)
    raw, before, end = data.tobytes().lower(), bytes([END] * ORDER), bytes([END])
    rows = [before + b" ".join(raw[a:b].split()) + end for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    sizes = np.array([len(x) for x in rows], np.int64)
    whole = np.frombuffer(b"".join(rows), np.uint8).astype(np.int64)
    if not len(whole):
        return whole, sizes
    key = np.zeros(len(whole), np.int64)
    for i in range(ORDER + 1):
        key[ORDER:] |= whole[i : len(whole) - ORDER + i] << (8 * (ORDER - i))
    inside = np.ones(len(whole), bool)
    inside[(np.cumsum(sizes) - sizes)[:, None] + np.arange(ORDER)] = False
    return key[inside], sizes - ORDER


def word_keys(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased), and each text's first word."""
    data, at = flat(text)
    starts, ends, first = spans(SPACE[data], at)
    return span_hash(LOWER[data], starts, ends), first


def _chunks(most: int):
    def chunks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with the number of their chunk: so many bytes of text in a row, or one longer text."""
        release()
        seq, size = TaskContext.get().partitionId() << 32, 0
        for part in batches(parts, most=1 << 20):
            n = part.column("text").nbytes
            if size and size + n > most:
                seq, size = seq + 1, 0
            size += n
            yield part.append_column("chunk", pa.array(np.full(part.num_rows, seq), pa.int64()))

    return chunks


def _of_chunks(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(chunk, batch of a MB or so of it)."""
    for part in batches(parts, most=1 << 20):
        own = part.column("chunk").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                yield int(own[a]), part.slice(a, b - a)


def _keys(ask: bool):
    """ask: (what, key, chunk) of each distinct gram (what 1) and word (what 3) of a chunk. Else (what, key, n): how often the training rows of a chunk hold a gram (what 0) or word (what 2)."""

    def keys(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _distinct(parts, ask)

    return keys


def _distinct(parts: Iterator[pa.RecordBatch], ask: bool) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {0: [], 1: []}

    def merge(kind: int) -> None:
        keys = np.concatenate([x[0] for x in held[kind]])
        order = np.argsort(keys)
        keys, n = keys[order], np.concatenate([x[1] for x in held[kind]])[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
        held[kind] = [(keys[first], np.add.reduceat(n, first))]

    def rows(chunk: int) -> Iterator[pa.RecordBatch]:
        for kind in (0, 1):
            merge(kind)
            keys, n = held[kind].pop()
            if not ask:
                keys, n = keys[n > 0], n[n > 0]
            for a in range(0, len(keys), 50_000):
                some = keys[a : a + 50_000]
                x = np.full(len(some), chunk) if ask else n[a : a + 50_000]
                yield pa.record_batch({"what": pa.array(np.full(len(some), 2 * kind + ask), pa.int32()), "key": pa.array(some, pa.int64()), "x": pa.array(x, pa.int64())})

    now = None
    for chunk, part in _of_chunks(parts):
        if now is not None and chunk != now:
            yield from rows(now)
        now = chunk
        if not ask:
            part = part.filter(pc.invert(part.column("held_out")))
        text = part.column("text")
        for kind, keys in ((0, grams(text)[0]), (1, word_keys(text)[0].view(np.int64))):
            held[kind].append(np.unique(keys, return_counts=True))
            if len(held[kind]) > 8:
                merge(kind)
        held[1].append((np.array([END_WORD]), np.array([len(text)])))
    if now is not None:
        yield from rows(now)


class Lower:
    """What all tasks know: counts of symbols without context and after one byte (65,536 numbers, whatever the corpus)."""

    def __init__(self, pairs: np.ndarray):
        self.pairs = pairs  # [byte << 8 | symbol]: how many bytes stand before the pair
        table = pairs.reshape(256, 256)
        self.zero = (table > 0).sum(0)
        ids = np.flatnonzero(pairs)
        ctx = ids >> 8
        first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])[: len(ctx)])
        self.nodes = {"k1": ids, "n1": pairs[ids], "c1": ctx[first]}
        if len(ids):
            t, d = np.add.reduceat(pairs[ids], first), np.diff(np.append(first, len(ids)))
            self.nodes |= {"t1": t, "d1": d, "et1": self.zero.sum() - np.add.reduceat(self.zero[ids & 255], first), "ed1": (self.zero > 0).sum() - d}


def trie_nodes(key: np.ndarray, n: np.ndarray, lower: Lower) -> dict[str, np.ndarray]:
    """Nodes of all contexts that end in the same two bytes as these grams (sorted, with the counts of the deepest order).

    Counts are updated with exclusion: below the deepest order, a gram counts once for each longer gram that ends in it.
    For each order: known grams and counts, known contexts with total t and distinct symbols d, and what a context's
    parent has left when the context's own symbols are excluded: et and ed.
    """
    out = dict(lower.nodes)
    if not len(key):
        return out
    low, count = np.arange(65536), lower.pairs
    for order in range(2, ORDER + 1):
        longer = np.unique(key & ((1 << (8 * (order + 2))) - 1))  # at the deepest order, the keys themselves
        ids, at = np.unique(longer & ((1 << (8 * (order + 1))) - 1), return_inverse=True)
        own = np.bincount(at, n if order == ORDER else None, len(ids)).astype(np.int64)
        ctx = ids >> 8
        first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
        mine = count[np.searchsorted(low, ids & ((1 << (8 * order)) - 1))]
        c = ctx[first]
        t, d = np.add.reduceat(own, first), np.diff(np.append(first, len(ids)))
        up = np.searchsorted(out[f"c{order - 1}"], c & ((1 << (8 * (order - 1))) - 1))
        pt, pd = out[f"t{order - 1}"][up], out[f"d{order - 1}"][up]
        out |= {f"k{order}": ids, f"n{order}": own, f"c{order}": c, f"t{order}": t, f"d{order}": d, f"et{order}": pt - np.add.reduceat(mine, first), f"ed{order}": pd - d}
        low, count = ids, own
    return out


def log_probs(key: np.ndarray, trie: dict[str, np.ndarray], zero: np.ndarray) -> np.ndarray:
    """log10 probability of distinct grams: from the longest known context down, escapes and symbol exclusion (estimates n - 1/2, escape d/2 of t)."""
    out, live = np.zeros(len(key)), np.arange(len(key))
    t = np.full(len(key), -1.0)  # -1: nothing is excluded yet
    d = np.zeros(len(key))

    def step(found: np.ndarray, n: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> None:
        nonlocal live
        n, total = n.astype(float), total.astype(float)
        with np.errstate(divide="ignore"):
            out[live[found]] += np.log10((2 * n[found] - 1) / (2 * total[found]))
            some = ~found & (total > 0)
            out[live[some]] += np.log10(kinds[some] / (2 * total[some]))

    for order in range(ORDER, 0, -1):
        if not len(trie.get(f"c{order}", ())):
            continue
        k = key[live] & ((1 << (8 * (order + 1))) - 1)
        ctx = k >> 8
        at = np.minimum(np.searchsorted(trie[f"c{order}"], ctx), len(trie[f"c{order}"]) - 1)
        known = trie[f"c{order}"][at] == ctx
        spot = np.minimum(np.searchsorted(trie[f"k{order}"], k), len(trie[f"k{order}"]) - 1)
        found = trie[f"k{order}"][spot] == k
        fresh = t[live] < 0
        total = np.where(known, np.where(fresh, trie[f"t{order}"][at], t[live]), 0)
        kinds = np.where(fresh, trie[f"d{order}"][at], d[live])
        step(found, trie[f"n{order}"][spot], total, kinds)
        t[live] = np.where(known, trie[f"et{order}"][at], t[live])
        d[live] = np.where(known, trie[f"ed{order}"][at], d[live])
        live = live[~found]
    sym = key[live] & 255
    fresh = t[live] < 0
    step(zero[sym] > 0, zero[sym], np.where(fresh, zero.sum(), t[live]), np.where(fresh, (zero > 0).sum(), d[live]))
    live = live[zero[sym] == 0]
    out[live] -= np.log10(SYMBOLS - (zero > 0).sum())
    return out


def _part(key: np.ndarray, kind: int) -> np.ndarray:
    """Which part of the trie or of the word table knows a key; as part() says in SQL."""
    return key >> 8 & 65535 if kind == 0 else key & 65535


def _answers(lower: Lower, most: int):
    def answers(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (what, key, x) come sorted by kind and part, of each part first the corpus' counts, then what chunks ask. Gives (to, key, value): to is twice the chunk and the kind; value a word's count or a gram's -log10 probability in units of 1 / UNIT."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        open_: tuple[tuple[int, int], tuple[np.ndarray, np.ndarray]] | None = None  # the kind and part that go on, and their counts
        held: list[np.ndarray] = []

        def work(kind: int, rows: np.ndarray, whole: bool) -> Iterator[pa.RecordBatch]:
            """Answer what these rows of one kind ask. If the last part goes on (not whole), its counts are kept."""
            nonlocal open_
            part, asks = _part(rows[1], kind), rows[0] & 1 == 1
            before = open_[1] if open_ is not None and open_[0] == (kind, part[0]) else none
            known = tuple(np.concatenate(x) for x in zip(before, rows[1:, ~asks]))
            order = np.argsort(known[0])
            key, n = known[0][order], known[1][order]
            asked = rows[1, asks]  # in the order of parts and keys: equal ones stand together
            new = np.concatenate([[True], asked[1:] != asked[:-1]])[: len(asked)]
            uniq, at = asked[new], np.cumsum(new) - 1
            if len(uniq) and kind == 0:
                value = np.rint(-UNIT * log_probs(uniq, trie_nodes(key, n, lower), lower.zero)).astype(np.int64)
            elif len(uniq):
                spot = np.minimum(np.searchsorted(key, uniq), max(len(key) - 1, 0))
                value = np.where(key[spot] == uniq, n[spot], 0) if len(key) else np.zeros(len(uniq), np.int64)
            if len(uniq):
                to = 2 * rows[2, asks] + kind
                for a in range(0, len(at), 50_000):
                    b = slice(a, a + 50_000)
                    yield pa.record_batch({"to": pa.array(to[b]), "key": pa.array(asked[b]), "value": pa.array(value[at[b]])})
            if part[-1] != part[0]:
                before = none
            last = ~asks & (part == part[-1])
            open_ = None if whole else ((kind, part[-1]), tuple(np.concatenate(x) for x in zip(before, rows[1:, last])))

        def some(end: bool) -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held, 1)
            held.clear()
            for kind in (0, 1):
                one = rows[:, rows[0] >> 1 == kind]
                if not one.shape[1]:
                    continue
                goes_on = not end and rows[0, -1] >> 1 == kind
                if goes_on and one[0, -1] & 1 == 0:  # counts of the last part are still coming: it waits
                    part = _part(one[1], kind)
                    cut = int(np.argmax(part == part[-1]))
                    held.append(one[:, cut:])
                    one, goes_on = one[:, :cut], False
                if one.shape[1]:
                    yield from work(kind, one, not goes_on)

        for part in parts:
            if part.num_rows:
                held.append(np.stack([c.to_numpy().astype(np.int64) for c in part.columns]))
                if sum(x.shape[1] for x in held) > most:
                    yield from some(False)
        if held:
            yield from some(True)

    return answers


def _file(key: np.ndarray, value: np.ndarray) -> bytes:
    """A sorted table of keys and values."""
    return len(key).to_bytes(8, "little") + zstandard.compress(np.diff(key, prepend=0).astype("<i8").tobytes() + value.astype("<i8").tobytes(), 1)


def _table(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, data = int.from_bytes(raw[:8], "little"), zstandard.decompress(raw[8:])
    return np.cumsum(np.frombuffer(data, "<i8", n)), np.frombuffer(data, "<i8", n, 8 * n)


def _deliver(folder: str):
    def deliver(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (to, key, value) come sorted by `to`: a file for each."""
        now, held = None, []

        def out() -> pa.RecordBatch:
            key, value = (np.concatenate(x) for x in zip(*held))
            held.clear()
            uniq, at = np.unique(key, return_index=True)
            put(folder, f"{now}.bin", _file(uniq, value[at]))
            return pa.record_batch({"n": pa.array([len(key)], pa.int64())})

        for part in parts:
            to, key, value = (c.to_numpy() for c in part.columns)
            cuts = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    if now is not None and to[a] != now:
                        yield out()
                    now = int(to[a])
                    held.append((key[a:b], value[a:b]))
        if held:
            yield out()

    return deliver


def _scorer(folder: str, total: int, kinds: int):
    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tables = None, []
        for chunk, part in _of_chunks(parts):
            if chunk != now:
                now, tables = chunk, [_table(get(folder, f"{2 * chunk + k}.bin")) for k in (0, 1)]

            def value(kind: int, keys: np.ndarray, tables: list = tables) -> np.ndarray:
                own, values = tables[kind]
                at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                if not np.array_equal(own[at], keys):
                    raise ValueError("a chunk holds what it did not ask for")
                return values[at]

            text = part.column("text")
            key, sizes = grams(text)
            uniq, at = np.unique(key, return_inverse=True)
            sums = np.add.reduceat(value(0, uniq)[at], np.cumsum(sizes) - sizes) / -UNIT
            own, first = word_keys(text)
            uniq, at = np.unique(np.append(own.view(np.int64), END_WORD), return_inverse=True)
            c = value(1, uniq)[at]
            base = np.log10((c + 0.1) / (total + 0.1 * (kinds + 1)))
            add = lambda x: np.diff(np.append(0, np.cumsum(x[:-1]))[first]) + x[-1]
            yield pa.record_batch({
                "doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "n_tokens": pa.array(np.diff(first) + 1, pa.int64()), "n_known": pa.array(add((c > 0).astype(np.int64)), pa.int64()),
                "train_tokens": pa.array(np.full(len(text), total), pa.int64()), "base_score": pa.array(add(base)), "score": pa.array(sums),
            })

    return score


def ppm_scores(docs: DataFrame, folds: int = 10, chunk: int = 16 << 20, most: int = 400_000) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Rows with crc32(doc_id as text) mod `folds` = 0 are held out; all others are counted. base_score is a unigram
    model of words and the text's end. score is the code length of the words (A-Z lower-cased), joined by one space,
    and the end under a byte trie of ORDER bytes of context: the longest known context gives the estimate; otherwise
    its escape, and the next shorter one without the symbols already excluded.

    Texts are dealt to chunks of `chunk` bytes, and a chunk's distinct grams and words with their counts are all that is
    shuffled: first to be summed, then each to the part of the trie (contexts that end in the same two bytes) or of the
    word table that knows it, and the answers back to a file for the chunk, which its texts are scored by. No table is looked up
    across tasks: a part's counts are met once by what asks it, `most` rows at a time, and a chunk's file is read with the
    chunk. Only the 65,536 counts below two bytes of context go to all tasks.

    Null texts count as empty (only the end is scored). A null doc_id counts as held out. Without training rows
    every symbol has the same probability. Repeated rows count as often as they stand. No rows: no rows.
    """
    spark = docs.sparkSession
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds, F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (fold == 0).alias("held_out"))
    rows = stored(rows.mapInArrow(_chunks(chunk), "doc_id long, text string, held_out boolean, chunk long"), "lm-texts", "zstd")
    texts = rows.select("text", "held_out", "chunk")
    counts = stored(texts.mapInArrow(_keys(False), "what int, key long, x long").groupBy("what", "key").agg(F.sum("x").alias("x")), "lm-counts", "zstd")
    total, kinds = counts.where("what = 2").agg(F.coalesce(F.sum("x"), F.lit(0)), F.count("*")).first()
    pairs = np.zeros(65536, np.int64)
    triple = counts.where("what = 0").select((F.col("key") % (1 << 24)).alias("t")).distinct()
    for r in triple.groupBy((F.col("t") % 65536).alias("pair")).agg(F.count("*").alias("n")).collect():  # at most 65,536 rows
        pairs[r.pair] = r.n
    kind = F.shiftright("what", 1)
    part = F.when(kind == 0, F.shiftright("key", 8)).otherwise(F.col("key")).bitwiseAND(F.lit(65535))
    both = counts.unionByName(texts.mapInArrow(_keys(True), "what int, key long, x long"))
    sort = both.repartition(kind, part).sortWithinPartitions(kind, part, "what", "key")
    answers = sort.mapInArrow(_answers(Lower(pairs), most), "to long, key long, value long")
    folder = run_dir(spark, "lm-answers")
    answers.repartition("to").sortWithinPartitions("to").mapInArrow(_deliver(folder), "n long").agg({"n": "sum"}).collect()
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.mapInArrow(_scorer(folder, total, kinds), schema)
