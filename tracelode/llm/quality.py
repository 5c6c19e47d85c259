"""Quality rules: word statistics, and the fertility of a public tokenizer's vocabulary."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import resident
from .textops import LEAD, LOWER, SPACE, batches, flat, mix, owners, rolling, span_hash, spans

#: The symbols that are counted.
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

#: Scripts by code point ranges (first, last) of letters; the script with most letters of a text decides its bands.
SCRIPTS = {"latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)], "greek": [(0x370, 0x3FF)], "cyrillic": [(0x400, 0x52F)], "hebrew_arabic": [(0x590, 0x6FF)], "indic": [(0x900, 0xDFF)], "cjk": [(0x2E80, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF)], "other": []}
#: Rejection bands by script: least and most characters per token, most byte-fallback share, least token entropy (bits) of a text with 64 tokens or more, most tokens per word.
BANDS = {
    "latin": (1.15, 9.0, 0.20, 3.0, 3.5),
    "greek": (0.5, 9.0, 0.60, 2.5, 14.0),
    "cyrillic": (0.8, 9.0, 0.40, 2.5, 8.0),
    "hebrew_arabic": (0.4, 9.0, 0.70, 2.5, 14.0),
    "indic": (0.25, 9.0, 0.90, 2.0, 40.0),
    "cjk": (0.25, 4.0, 0.90, 2.0, 1e9),
    "other": (0.2, 12.0, 1.00, 1.5, 1e9),
}
ENTROPY_FROM = 64
#: Most share that one word may have of all words of a text with ENTROPY_FROM tokens or more (texts broken by separators), by script; scripts without documents to set it from have none.
COMMONEST = {"latin": 0.25}


class Pieces:
    """Piece ids of distinct words under a sentencepiece vocabulary, by word hash; bounded by forgetting all."""

    def __init__(self, path: str, most: int = 400_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.fallback = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.known: dict[int, bytes] = {}
        self.most = most

    def of(self, keys: np.ndarray, words) -> tuple[np.ndarray, np.ndarray]:
        """(all ids end to end, how many each) of words with these hashes; words(i) gives word i as text."""
        listed = keys.tolist()
        new = [i for i, k in enumerate(listed) if k not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = range(len(listed))
        for i, ids in zip(new, self.model.encode([words(i) for i in new], num_threads=1)):
            self.known[listed[i]] = array("i", ids).tobytes()
        rows = [self.known[k] for k in listed]
        return np.frombuffer(b"".join(rows), np.int32), np.array([len(x) // 4 for x in rows], np.int64)


def pieces(path: str) -> Pieces:
    """One for each Python worker and file."""
    return resident("pieces", path, Pieces)


def _add(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of x between consecutive offsets."""
    return np.diff(np.append(0, np.cumsum(x, dtype=np.int64))[at])


def base_counts(text: pa.Array) -> dict[str, np.ndarray]:
    """The word rules' counts of each text."""
    data, at = flat(text)
    n = len(at) - 1
    space = SPACE[data]
    starts, ends, first = spans(space, at)
    n_words = np.diff(first)
    hashes, whose = span_hash(data, starts, ends), owners(first, len(starts))
    lines = np.zeros(n, np.int64)
    a, b, line_first = spans(data == 10, at)
    if len(a):
        filled = np.append(0, np.cumsum(~space))
        real = filled[b] > filled[a]
        owner = owners(line_first, len(a))[real]
        key = mix(span_hash(data, a[real], b[real]) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        lines = np.bincount(owner, minlength=n) - np.bincount(owner[np.unique(key, return_index=True)[1]], minlength=n)
    repeat = np.zeros(n, np.int64)
    if len(starts) >= 5:
        inside = np.flatnonzero(whose[4:] == whose[:-4])
        key = mix(rolling(hashes, 5)[inside] + whose[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        edge = np.zeros(len(starts) + 6, np.int64)
        np.add.at(edge, inside[twice], 1)
        np.add.at(edge, inside[twice] + 5, -1)
        repeat = _add(np.cumsum(edge)[: len(starts)] > 0, first)
    return {"n_words": n_words, "word_chars": _add(~space & LEAD[data], at), "n_symbols": _add(SYMBOL[data], at), "n_dup_lines": lines, "n_repeat_words": repeat}


def fertility(text: pa.Array, table: Pieces) -> dict[str, np.ndarray]:
    """n_tokens, byte fallback tokens, token entropy and the commonest word's count of each text, its words encoded one by one."""
    data, at = flat(text)
    n = len(at) - 1
    starts, ends, first = spans(SPACE[data], at)
    uniq, where, inverse = np.unique(span_hash(data, starts, ends), return_index=True, return_inverse=True)
    raw = data.tobytes()
    lo, hi = starts[where].tolist(), ends[where].tolist()
    ids, count = table.of(uniq, lambda i: raw[lo[i] : hi[i]].decode())
    begin = np.cumsum(count) - count
    byte = np.add.reduceat(np.append(table.fallback[ids], False), begin) * (count > 0) if len(uniq) else count
    each = count[inverse]
    n_tokens, n_bytes = _add(each, first), _add(byte[inverse], first)
    doc = np.repeat(owners(first, len(starts)), each)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(begin[inverse], each)
    pair, c = np.unique(doc << 20 | ids[place], return_counts=True)
    sums = np.bincount(pair >> 20, c * np.log2(c), n)
    commonest = np.zeros(n, np.int64)
    word, times = np.unique(owners(first, len(starts)) * max(len(uniq), 1) + inverse, return_counts=True)
    np.maximum.at(commonest, word // max(len(uniq), 1), times)
    entropy = np.where(n_tokens > 0, np.log2(np.maximum(n_tokens, 1)) - sums / np.maximum(n_tokens, 1), 0.0)
    return {"n_tokens": n_tokens, "byte_tokens": n_bytes, "entropy": np.maximum(entropy, 0), "commonest": commonest}


def script_of(text: pa.Array) -> np.ndarray:
    """Number of each text's script in SCRIPTS: the one with most code points of two bytes or more and ASCII letters."""
    data, at = flat(text)
    ascii_letters = _add((LOWER[data] >= 97) & (LOWER[data] <= 122), at)
    wide = _add(data >= 0xC0, at)
    last = len(SCRIPTS) - 1
    out = np.where(ascii_letters + wide > 0, 0, last)
    for i in np.flatnonzero((wide > 0) & (wide >= ascii_letters // 2)).tolist():
        code = np.frombuffer(data[at[i] : at[i + 1]].tobytes().decode().encode("utf-32-le"), "<u4")
        votes = [sum(int(((code >= a) & (code <= b)).sum()) for a, b in ranges) for ranges in SCRIPTS.values()]
        votes[0] = int((((code | 32) >= 97) & ((code | 32) <= 122) | ((code >= 0xC0) & (code <= 0x24F)) | ((code >= 0x1E00) & (code <= 0x1EFF))).sum())
        out[i] = int(np.argmax(votes)) if max(votes) else last
    return out


def _rules(path: str, bands: dict[str, tuple[float, float, float, float, float]]):
    def rules(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, limits, commonest = pieces(path), np.array([bands[k] for k in SCRIPTS]), np.array([COMMONEST.get(k, 1.0) for k in SCRIPTS])
        for part in batches(parts, most=1 << 20):
            text = part.column("text")
            base, cost, script = base_counts(text), fertility(text, table), script_of(text)
            low, high, most, least, longest = limits[script].T
            tokens = np.maximum(cost["n_tokens"], 1)
            chars, share = base["word_chars"] / tokens, cost["byte_tokens"] / tokens
            failed = (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])
            outside = (chars < low) | (chars > high) | (share > most) | ((cost["n_tokens"] >= ENTROPY_FROM) & ((cost["entropy"] < least) | (cost["commonest"] > commonest[script] * base["n_words"]))) | (cost["n_tokens"] > longest * base["n_words"])
            out = part.drop_columns([c for c in ("text",)])
            for name, x in {**{k: v.astype(np.int64) for k, v in base.items()}, "base_failed": failed, "kept": ~failed & ~outside, "chars_per_token": chars, "fallback_share": share, "token_entropy": cost["entropy"]}.items():
                out = out.append_column(name, pa.array(x))
            yield out.append_column("script", pa.array(np.array(list(SCRIPTS))[script].tolist(), pa.string())).append_column("text", text)

    return rules


ADDED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, chars_per_token double, fallback_share double, token_entropy double, script string"


def quality_rules(docs: DataFrame, path: str, bands: dict[str, tuple[float, float, float, float, float]] = BANDS) -> DataFrame:
    """docs with counts, base_failed, kept and the tokenizer measures of each text (see ADDED).

    A text is rejected if it has fewer than 10 words, if over 20 % of its words stand in five-word windows found twice,
    or if its characters per token, tokens per word, byte-fallback share, token entropy or commonest word's share leave the bands of its script. Everything
    is worked out in one pass over whole texts, without a shuffle.

    Null texts count as empty: no words, so rejected. Rows stand for themselves even if they repeat. No rows: no rows.
    Other columns pass through, but for those of docs that carry a name in ADDED, which are replaced.
    """
    names = [x.split()[0] for x in ADDED.split(", ")]
    rows = docs.drop(*names).withColumn("text", F.col("text").cast("string"))
    rest = [c for c in rows.columns if c != "text"]
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest] + [ADDED, "text string"])
    return rows.select(*[f"`{c}`" for c in rest], "text").mapInArrow(_rules(path, bands), schema)
