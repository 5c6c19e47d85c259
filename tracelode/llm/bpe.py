"""BPE by speculation: greedy longest matches, a vectorised check of all adjacent pairs, exact merging of what fails."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import resident
from .textops import batches
from .wordbpe import WORD, SIMPLE

#: Characters outside white space whose byte character is another one.
CONTROL = re.compile("[\x00-\x08\x0e-\x1b\x7f]")


def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte: itself if printable, else the next free one from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Bpe:
    """Ids of pre-tokens of a byte-level vocabulary with a word-end suffix, computed here."""

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)  # its normaliser and splitter, for texts outside SIMPLE
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        self.plain = [self.text.get(i, "") for i in range(max(self.text) + 1)]
        self.number = [str(i) for i in range(len(self.plain))]
        self.merge = {}
        n = max(self.vocab.values()) + 1
        self.left, self.right, self.made = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            a, b, c = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merge[a, b] = rank, c
            if self.made[c] < 0:
                self.left[c], self.right[c], self.made[c] = a, b, rank
        keys = np.array([a << 32 | b for a, b in self.merge], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array([r for r, _ in self.merge.values()])[order]
        self.chars = byte_chars()
        self.longest = max(map(len, self.vocab))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        self.most, self.failed, self.seen = most, 0, 0
        # a token that merging does not give back from its own text is never proposed
        self.real = {s: i for s, i in self.vocab.items() if self.exact(self.symbols(s)) == [i]}

    def symbols(self, token: str) -> list[int]:
        body = token[: -len(self.suffix)] if self.suffix and token.endswith(self.suffix) else token
        parts = list(body)
        if body != token and parts:
            parts[-1] += self.suffix
        return [self.vocab[p] for p in parts] if parts and all(p in self.vocab for p in parts) else []

    def exact(self, ids: list[int]) -> list[int]:
        """All merges in the order of their ranks, leftmost first."""
        ids, after = list(ids), list(range(1, len(ids) + 1))
        before = [i - 1 for i in range(len(ids))]
        heap = [(self.merge[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merge]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= len(ids) or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = self.merge[pair][1], -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(ids) and (p := (ids[a], ids[b])) in self.merge:
                    heapq.heappush(heap, (self.merge[p][0], a, p))
        return [x for x in ids if x >= 0]

    def greedy(self, word: str) -> list[int]:
        """Longest known token first; [] if some place has none."""
        out, at, n, known = [], 0, len(word), self.real
        whole = word + self.suffix
        while at < n:
            if (got := known.get(whole[at:])) is not None:
                return [*out, got]
            for end in range(min(n - (self.suffix != ""), at + self.longest), at, -1):
                if (got := known.get(word[at:end])) is not None:
                    out.append(got)
                    at = end
                    break
            else:
                return []
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of tokens a and b together leaves them apart.

        Take back the latest merge on either side of the border, one at a time. Before it, the two tokens at the border
        stood side by side; had they a merge of a lower rank than the one taken back, it would have come first. Of
        merges of one rank the left comes first, so against the right token's merge an equal rank counts too.
        """
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        x, y = a.copy(), b.copy()
        until = np.full(len(a), len(self.ranks) + 1)  # a rank below this comes first
        while len(live):
            key = x << 32 | y
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            bad = (self.keys[at] == key) & (self.ranks[at] < until)
            ok[live[bad]] = False
            going = ~bad & ((self.made[x] >= 0) | (self.made[y] >= 0))
            x, y, live = x[going], y[going], live[going]
            first = self.made[x] > self.made[y]
            until = np.where(first, self.made[x], self.made[y] + 1)
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return ok

    def learn(self, words: set[str]) -> None:
        """Ids of new words (in the vocabulary's byte characters)."""
        new = list(words - self.words.keys())
        if len(self.words) + len(new) > self.most:
            self.words.clear()
            new = list(words)
        proposed = [self.greedy(w) for w in new]
        ask = list({p for ids in proposed for p in zip(ids, ids[1:])} - self.pairs.keys())
        if ask:
            both = np.array(ask, np.int64)
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
                ask = list({p for ids in proposed for p in zip(ids, ids[1:])})
                both = np.array(ask, np.int64)
            self.pairs.update(zip(ask, self.compatible(both[:, 0], both[:, 1]).tolist()))
        for word, ids in zip(new, proposed):
            self.seen += 1
            if not ids or not all(map(self.pairs.__getitem__, zip(ids, ids[1:]))):
                self.failed += 1
                ids = self.exact(self.symbols(word + self.suffix))
                if word and not ids:
                    raise ValueError(f"the vocabulary has no symbols for {word!r}")
            self.words[word] = np.array(ids, "<u4").tobytes()

    def split(self, text: str) -> list[str | int]:
        """Pre-tokens in byte characters; ids for special tokens that stand in the text."""
        at = min(((i, s) for s in self.special if (i := text.find(s)) >= 0), default=None)
        if at is not None:
            i, s = at
            return [*self.split(text[:i]), self.special[s], *self.split(text[i + len(s) :])]
        return [w for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(text))] if text else []

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of each text."""
        chars = self.chars
        parts = []
        for text in texts:
            if SIMPLE.fullmatch(text) and not any(s in text for s in self.special):
                low = text.lower()
                if low.isascii() and not CONTROL.search(low):
                    parts.append(WORD.findall(low))
                else:  # a word of printable ASCII is its own byte characters
                    parts.append([w if w.isascii() and w.isprintable() else "".join([chars[b] for b in w.encode()]) for w in WORD.findall(low)])
            else:
                parts.append(self.split(text))
        self.learn({w for p in parts for w in set(p) if isinstance(w, str)})
        known = self.words.__getitem__
        return [b"".join(map(known, p)) if all(type(w) is str for w in p) else b"".join([known(w) if isinstance(w, str) else w.to_bytes(4, "little") for w in p]) for p in parts]

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the vocabulary's file, tokens are joined by a space."""
        return " ".join(map(self.plain.__getitem__, ids))


def bpe(path: str) -> Bpe:
    """One for each Python worker and file."""
    return resident("bpe", path, Bpe)


def bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids_text (decimal ids joined by one space), n_tokens and decoded (the text that the ids give) of each row.

    Distinct words of a batch are encoded once: greedy longest match, one vectorised check of all new adjacent pairs of
    tokens, and exact merging only for words with an incompatible pair or without a match. A sequence whose adjacent
    pairs are all compatible is the one that merging gives.

    Null texts count as empty (no ids). Special tokens that stand in a text become their ids. Rows stand for
    themselves; doc_id may be null. No rows: no rows. Other columns are ignored.
    """

    def both(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bpe(path)
        for part in batches(parts):
            ids = [np.frombuffer(x, "<u4").tolist() for x in table.encode(part.column("text").to_pylist())]
            yield pa.record_batch({
                "doc_id": part.column("doc_id"), "n_tokens": pa.array(map(len, ids), pa.int64()),
                "ids_text": pa.array([" ".join(map(table.number.__getitem__, x)) for x in ids], pa.string()), "decoded": pa.array([table.decode(x) for x in ids], pa.string()),
            })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(both, "doc_id long, n_tokens long, ids_text string, decoded string")
