"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .textops import LOWER, SPACE, batches, flat, owners, span_hash, spans

#: Insults in four languages, one voter each.
INSULTS = """
idiot moron stupid scum trash loser pathetic worthless disgusting clown dumb imbecile vermin filth freak cretin fool jerk creep garbage
crétin connard salaud ordure abruti débile minable dégoûtant
dummkopf trottel abschaum arschloch widerlich wertlos schwachkopf drecksack
estúpido imbécil escoria basura asqueroso patético inútil payaso
""".split()
PREFIXES = (4, 5, 6, 7, 8)  # bytes at a word's beginning that are features too
SAMPLE = 12_000  # labelled rows that are used at most, and as many without a label: those of smallest hash
VOTERS, FEATURES, SURE = 400, 4000, 0.75
#: Shares of words that are known as toxic, from each of which on a text has a feature and a vote.
RATES = [i / 500 for i in range(1, 16)]
#: Looks of a text that vote too, on either side as the label model finds; the order of patterns().
PATTERNS = ["shouts", "exclaims", "symbols", "repeats", "digits", "addresses", "short", "long", "few known words"]

#: Bytes outside words: all but letters.
APART = np.array([not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])
#: A feature counts again if it stands in a text this often; the level is in a key's two lowest bits.
LEVELS = (1, 2, 4)
_BASE = np.uint64(0xFFFFFFFFFFFFFFFC)
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of U+00C0 to U+00DE in lower case."""
    low = LOWER[data]
    wide = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    low[wide] += 0x20
    return low


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, feature key of level 0) of all words of letters, lower-cased, and of their beginnings, as often as they stand; and each text's first word."""
    data, at = flat(text)
    low = lowered(data)
    starts, ends, first = spans(APART[data], at)
    word = np.arange(len(starts))
    keys, which = [span_hash(low, starts, ends)], [word]
    for n in PREFIXES:
        long = ends - starts > n
        keys.append(span_hash(low, starts[long], starts[long] + n) + np.uint64(n))
        which.append(word[long])
    which = np.concatenate(which)
    return owners(first, len(starts))[which], which, np.concatenate(keys) & _BASE, first


def _levels(whose: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, key with level) of each feature that stands often enough for the level, once a text."""
    order = np.lexsort((keys, whose))
    whose, keys = whose[order], keys[order]
    first = np.flatnonzero(np.concatenate([[True], (whose[1:] != whose[:-1]) | (keys[1:] != keys[:-1])])[: len(keys)])
    count = np.diff(np.append(first, len(keys)))
    often = [first[count >= n] for n in LEVELS]
    return np.concatenate([whose[x] for x in often]), np.concatenate([keys[x] | np.uint64(i) for i, x in enumerate(often)])


def patterns(text: pa.Array, known: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which text has which of PATTERNS, one row a text. known: how many of its words are known as toxic."""
    data, at = flat(text)
    add = lambda x: np.diff(np.append(0, np.cumsum(x, dtype=np.int64))[at])
    upper, letters, words = add((data >= 65) & (data <= 90)), add(~APART[data]), np.diff(first)
    starts, ends, begin = spans(SPACE[data], at)
    h, own = span_hash(data, starts, ends), owners(begin, len(starts))
    again = np.bincount(own[1:][(h[1:] == h[:-1]) & (own[1:] == own[:-1])], minlength=len(text))
    size = np.diff(at)
    colon = np.zeros(len(data), bool)
    colon[:-2] = (data[:-2] == 58) & (data[1:-1] == 47) & (data[2:] == 47)
    return np.column_stack([
        (upper > 0.6 * letters) & (letters > 20), add(data == 33) >= 5, add(_SYMBOLS[data]) >= 10, again >= 10, add((data >= 48) & (data <= 57)) > 0.1 * size,
        add(colon) > 0, words < 10, words > 1000, (known > 0) & (known < 0.008 * words),
    ])


def document_counts(rows: DataFrame, least: int) -> DataFrame:
    """(key, n, pos): in how many labelled rows (text, toxic), and in how many toxic ones, a feature stands."""

    def split(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts):
            whose, _, keys, _ = features(part.column("text"))
            whose, keys = _levels(whose, keys)
            uniq, where = np.unique(keys.view(np.int64), return_inverse=True)
            toxic = part.column("toxic").to_numpy()[whose]
            yield pa.record_batch({"key": pa.array(uniq), "n": pa.array(np.bincount(where, minlength=len(uniq)), pa.int64()), "pos": pa.array(np.bincount(where, toxic, len(uniq)).astype(np.int64))})

    return rows.mapInArrow(split, "key long, n long, pos long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).where(F.col("n") >= least)


def label_model(votes: np.ndarray, gold: np.ndarray, open_: int = 0, rounds: int = 50) -> np.ndarray:
    """Posterior that each row is toxic, under a generative model of its voters. votes: 1 where a voter fires, 0 where it abstains; gold: 1, 0, or -1 where a row has no label.
    The last `open_` voters may stand for either side: a prior holds both their rates at one value; the others' prior leans to toxic.

    A voter fires with one rate on toxic rows and another on clean ones; the given label is a voter too, right with a rate on each side,
    that abstains on rows without one. Correlations between voters within a class are a matrix of
    the model: voters are weighed as in a discriminant with that matrix (its inverse times their separation), so many that fire
    together count about as one. Rates, correlations and the prior come from expectation maximisation over all rows; the labels
    only say where it begins.
    """
    known = gold >= 0
    q = np.where(known, np.clip(gold, 0.05, 0.95), np.clip(gold[known].mean() if known.any() else 0.5, 0.02, 0.98)).astype(float)
    either = np.arange(votes.shape[1]) >= votes.shape[1] - open_
    rate = (votes.sum(0) + 0.5) / (len(votes) + 1)
    more, most = np.where(either, 20 * rate, [[0.5], [0.05]]), np.where(either, 20, 1)
    for _ in range(rounds):
        pos, neg = q.sum() + 1e-9, (1 - q).sum() + 1e-9
        hit, false = (q @ votes + more[0]) / (pos + most), ((1 - q) @ votes + more[1]) / (neg + most)
        right = (q[known] @ gold[known] + 19) / (q[known].sum() + 20), ((1 - q[known]) @ (1 - gold[known]) + 19) / ((1 - q[known]).sum() + 20)
        rest = votes - (q[:, None] * hit + (1 - q)[:, None] * false)
        sd = np.sqrt((rest**2).mean(0)) + 1e-6
        corr = 0.8 * (rest.T @ rest) / len(rest) / sd[:, None] / sd[None, :]
        corr[np.diag_indices(len(corr))] = 1.0
        apart = (hit - false) / sd
        weight = np.clip(np.linalg.solve(corr, apart) / np.where(np.abs(apart) > 1e-9, apart, 1.0), 0.0, 1.0)
        fire, quiet = np.log(hit / false) * weight, np.log((1 - hit) / (1 - false)) * weight
        score = votes @ (fire - quiet) + quiet.sum() + np.log(pos / neg)
        score[known] += np.where(gold[known] > 0, np.log(right[0] / (1 - right[1])), np.log((1 - right[0]) / right[1]))
        new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        done = np.abs(new - q).max() < 1e-4
        q = new
        if done:
            break
    return q


def linear(rows: list[np.ndarray], n: int, target: np.ndarray, rounds: int = 500, rate: float = 0.05, shrink: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression of a probability on binary features (Adam, all rows at a time)."""
    size = np.array([len(x) for x in rows])
    who, col = np.repeat(np.arange(len(rows)), size), np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    w[n] = np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))
    for i in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(who, w[col], len(rows)) + w[n], -30, 30)))
        e = (p - target) / len(rows)
        g = np.append(np.bincount(col, e[who], n), e.sum()) + shrink * np.append(w[:n], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    # shrinking leaves scores too near the prior: one more fit of scale and shift, without it
    x = np.bincount(who, w[col], len(rows)) + w[n]
    scale, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(scale * x + shift, -30, 30)))
        e, h = p - target, p * (1 - p) + 1e-6
        grad = np.array([e @ x, e.sum()])
        hess = np.array([[h @ (x * x), h @ x], [h @ x, h.sum()]]) + 1e-3 * np.eye(2)
        move = np.linalg.solve(hess, grad)
        scale, shift = scale - np.clip(move[0], -0.5, 0.5), shift - np.clip(move[1], -1, 1)
    scale = max(scale, 0.1)
    return scale * w[:n], float(scale * w[n] + shift)


class Model:
    """Known features, their columns and weights. Columns: `keys` (with level), then RATES, then PATTERNS."""

    def __init__(self, keys: np.ndarray, toxic: np.ndarray):
        """toxic: which keys (with level) are signs of toxic words."""
        self.base, at = np.unique(keys & _BASE, return_inverse=True)
        self.column = np.full((len(self.base), len(LEVELS)), -1)
        self.column[at, (keys & ~_BASE).astype(np.int64)] = np.arange(len(keys))
        self.toxic = np.zeros(len(self.base), bool)
        self.toxic[at[toxic]] = True
        self.n = len(keys) + len(RATES) + len(PATTERNS)
        self.weights, self.bias = np.zeros(self.n), 0.0

    def columns(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, column) of all that a text has."""
        whose, word, keys, first = features(text)
        known = np.zeros(len(text), np.int64)
        doc, col = [], []
        if len(self.base):
            at = np.minimum(np.searchsorted(self.base, keys), len(self.base) - 1)
            hit = np.flatnonzero(self.base[at] == keys)
            sure = hit[self.toxic[at[hit]]]
            known = np.bincount(owners(first, first[-1])[np.unique(word[sure])], minlength=len(text))
            pair, count = np.unique(whose[hit] * len(self.base) + at[hit], return_counts=True)
            own, feature = pair // len(self.base), pair % len(self.base)
            for i, n in enumerate(LEVELS):
                some = (count >= n) & (self.column[feature, i] >= 0)
                doc.append(own[some])
                col.append(self.column[feature[some], i])
        words = np.maximum(np.diff(first), 1)
        more = np.column_stack([*[(known > 0) & (known >= r * words) for r in RATES], patterns(text, known, first)])
        a, b = np.nonzero(more)
        return np.concatenate([*doc, a]), np.concatenate([*col, b + self.n - more.shape[1]])

    def scores(self, text: pa.Array) -> np.ndarray:
        doc, col = self.columns(text)
        return 1 / (1 + np.exp(-np.clip(np.bincount(doc, self.weights[col], len(text)) + self.bias, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = SAMPLE) -> Model:
    """Learn from rows with crc32(doc_id as text) mod `folds` not 0: at most `sample` labelled ones and as many without a label (those of smallest hash).

    Features that stand in toxic examples more often than chance allows become voters, beside the lexicon, the shares of
    toxic words and the patterns. Only counts of features, the columns of at most twice `sample` rows and the model reach the driver.
    """
    spark = docs.sparkSession
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != 0
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null").where(learn)
    gold = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    least = [F.xxhash64("doc_id"), "doc_id"]
    some = gold.orderBy(*least).limit(sample).unionByName(texts.select("doc_id").join(labels.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_anti").distinct().orderBy(*least).limit(sample).withColumn("toxic", F.lit(-1)))
    rows = stored(texts.join(F.broadcast(some), "doc_id").select("text", "toxic"), "toxic-examples")  # twice `sample` ids at most
    labelled = rows.where("toxic >= 0")
    n, positive = labelled.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not positive or positive == n:
        model = Model(np.zeros(0, np.uint64), np.zeros(0, bool))
        model.bias = float(np.log((positive + 0.5) / (n - positive + 0.5)))
        return model
    prior = positive / n
    mean, sd = F.col("n") * prior, F.sqrt(F.col("n") * (prior * (1 - prior)))
    ranked = document_counts(labelled, 3).withColumn("z", (F.col("pos") - mean) / sd).withColumn("rate", (F.col("pos") + 1) / (F.col("n") + 2))
    best = ranked.where(F.col("z") > 3).orderBy(F.desc("z"), "key").limit(FEATURES).collect()
    insults = span_hash(*_joined(INSULTS)) & _BASE
    sure = np.array([r.key for r in best if r.rate > SURE][:VOTERS], np.int64).view(np.uint64)
    keys = np.unique(np.concatenate([np.array([r.key for r in best], np.int64).view(np.uint64), insults]))
    toxic = np.isin(keys, np.concatenate([sure, insults]))
    model = Model(keys, toxic)
    names = spark.sparkContext.broadcast(model)

    def chosen(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts):
            doc, col = names.value.columns(part.column("text"))
            order = np.argsort(doc, kind="stable")
            cut = np.searchsorted(doc[order], np.arange(part.num_rows + 1))
            col = col[order].astype(np.int32)
            yield pa.record_batch({"toxic": part.column("toxic"), "cols": pa.array([col[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())})

    got = rows.select("text", "toxic").mapInArrow(chosen, "toxic int, cols binary").toArrow()
    cols = [np.frombuffer(x, np.int32) for x in got["cols"].to_pylist()]
    voters = np.concatenate([np.flatnonzero(toxic), np.arange(len(keys), model.n)])
    column = np.full(model.n, -1)
    column[voters] = np.arange(len(voters))
    votes = np.zeros((len(cols), len(voters)), np.float32)
    for i, x in enumerate(cols):
        at = column[x]
        votes[i, at[at >= 0]] = 1
    model.weights, model.bias = linear(cols, model.n, label_model(votes, got["toxic"].to_numpy(), len(PATTERNS)))
    return model


def _joined(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(x) for x in raw])
    return np.frombuffer(b"".join(raw), np.uint8), ends - [len(x) for x in raw], ends


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted.

    fit() gives a linear classifier on words, word beginnings, shares of toxic words and patterns; its weights (at most FEATURES,
    the lexicon and some twenty more) go to all tasks. Nothing but the text enters a score.

    Null texts count as empty: the classifier's bias and that they are short. A null doc_id counts as held out. Labels without a document, or
    null, are ignored; of several for a document the largest counts. Without both kinds of label all scores are
    the prior. Repeated rows stay repeated. No rows: no rows. Other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, folds, sample))

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts):
            x = model.value.scores(part.column("text"))
            yield pa.record_batch({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": pa.array(x), "predicted": pa.array((x >= 0.5).astype(np.int32))})

    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds, F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (fold == 0).alias("held_out"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
