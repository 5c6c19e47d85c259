"""Splitting texts into the pre-tokens of two public tokenizers, and ids of whole pre-tokens from the tokenizers library."""

from __future__ import annotations

import json
import os
import re

from .shared import resident

#: Texts of these characters only are split by Python's re; all others go through the library whole.
SIMPLE = re.compile("[\x00-\x1b\x20-\x7fÀ-įı-ɏ‐-‧€]*")
#: The letters among them, and those that lower-casing gives (up to ʯ, ⱥ and ⱦ).
LETTER = "A-Za-zÀ-ÖØ-öø-ʯⱥⱦ"
#: The patterns of the two tokenizer files, written for these characters.
WORD = re.compile(rf"[{LETTER}]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^\s0-9{LETTER}]+")
BYTE = re.compile(rf" ?[{LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s0-9{LETTER}]+|\s+(?!\S)|\s+")


class Words(dict):
    """Ids (little-endian unsigned 32-bit) of pre-tokens, as the tokenizers library gives them; bounded by forgetting all."""

    def __init__(self, path: str, most: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import numpy as np
        from tokenizers import Tokenizer

        self.np, self.tok, self.most = np, Tokenizer.from_file(path), most
        self.new: dict[str, bytearray] = {}
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.lower = self.tok.normalizer is not None
        self.split = (WORD if self.lower else BYTE).findall
        vocab, suffix = self.tok.get_vocab(), json.loads(self.tok.to_str())["model"]["end_of_word_suffix"]
        self.between = " " if suffix else "\n"
        edge = [i for x, i in vocab.items() if x.endswith(suffix)] if suffix else self.tok.encode("\n", add_special_tokens=False).ids
        self.edge, self.last = np.zeros(max(vocab.values()) + 1, bool), bool(suffix)
        self.edge[edge] = True

    def ids(self, text: str) -> bytes:
        return self.np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytearray:
        """A place for the ids of a word that is not known yet; learn() fills it."""
        self[word] = self.new[word] = bytearray()
        return self.new[word]

    def learn(self) -> None:
        """Encode the words that were asked for and not known, a thousand in one text: the library takes less time for that."""
        for word in [x for x in self.new if x.isspace()]:
            self.fill([word], [self.ids(word)])
        new = list(self.new)
        for i in range(0, len(new), 1000):
            some = new[i : i + 1000]
            ids = self.np.array(self.tok.encode_batch_fast([self.between.join(some)], add_special_tokens=False)[0].ids, "<u4")
            raw, at = ids.tobytes(), 4 * self.np.flatnonzero(self.edge[ids])
            starts, ends = [0, *(at + 4).tolist()], at.tolist()  # a separator of its own stands between two words
            if self.last:  # the last token of each word ends it
                starts, ends = starts[:-1], starts[1:]
            else:
                ends.append(len(raw))
            self.fill(some, [raw[a:b] for a, b in zip(starts, ends)] if len(ends) == len(some) else [self.ids(x) for x in some])

    def fill(self, words: list[str], ids: list[bytes]) -> None:
        for word, own in zip(words, ids):
            self.new.pop(word)[:] = own
            self[word] = own

    def simple(self, text: str) -> bool:
        return SIMPLE.fullmatch(text) is not None and not any(x in text for x in self.special)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, equal to the library's: pre-tokens do not reach over their ends, so each is encoded once.

        Each pre-token is looked up once; the table as a whole is never gone through.
        """
        if len(self) > self.most:
            self.clear()
        try:
            parts = [list(map(self.__getitem__, self.split(x.lower() if self.lower else x))) if self.simple(x) else None for x in texts]
            self.learn()
        except BaseException:  # places that were not filled
            self.clear()
            self.new.clear()
            raise
        return [self.ids(text) if part is None else b"".join(part) for text, part in zip(texts, parts)]


def words(path: str) -> Words:
    """One for each Python worker and file."""
    return resident("words", path, Words)
