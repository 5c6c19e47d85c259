import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracelode.llm import bpe, packing, token_binary
from tracelode.llm.shared import get
from tracelode.llm.wordbpe import SIMPLE, Words

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def brute(path, text):
    return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def word_ids(by_id):
    tok = Tokenizer.from_file(WORD)
    return {i: tok.encode(t, add_special_tokens=False).ids for i, t in by_id.items()}


def test_token_files(docs, word_ids):
    files, folder = token_binary.write_tokens(docs, WORD, end_id=2, most=3000)
    assert files.count() > 3
    got, start = {r.doc_id: r for r in token_binary.read_tokens(files, folder).collect()}, 0
    for i in sorted(word_ids):
        ids = [*word_ids[i], 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    for r in files.collect():
        shard = token_binary.TokenShard(get(folder, r.file))
        for k in range(0, r.n_docs, 5):
            assert shard.ids(k).tolist() == [*word_ids[shard.doc_ids(k, k + 1)[0]], 2]


def test_token_files_edges(empty, nulls):
    assert token_binary.read_tokens(*token_binary.write_tokens(empty, WORD, 2)).count() == 0
    got = token_binary.read_tokens(*token_binary.write_tokens(nulls, WORD, 2)).collect()
    tok, end = Tokenizer.from_file(WORD), [2]
    crc = lambda t: zlib.crc32(np.array([*tok.encode(t, add_special_tokens=False).ids, *end], "<u4").tobytes())
    assert sorted(((r.doc_id, r.ids_crc32) for r in got), key=str) == sorted([(None, crc("")), (None, crc("one two three four")), (5, crc("")), (7, crc("Abc def ghi")), (7, crc("Abc def ghi"))], key=str)


@pytest.mark.parametrize("values", [[], [0], [1], [0, 0, 0], [5, 5, 9, 1000, 1000, 10**9], list(range(0, 5000, 3)), [7] * 700 + [10**6] * 700])
def test_elias_fano(values):
    ef = token_binary.EliasFano.of(np.array(values, np.int64))
    assert ef.select(np.arange(len(values))).tolist() == values
    assert [int(ef.select([i])[0]) for i in range(len(values))] == values


def test_token_file_with_null_repeated_and_far_ids():
    """Ids that rise over all 64 bits, nulls first, more than one note's worth of documents."""
    docs = [None, None, -(1 << 63), -5, -5, 0, 7, (1 << 63) - 1]
    shard = token_binary.TokenShard(token_binary.shard_bytes(docs, np.arange(1, 9), bytes(range(16)), 2))
    assert shard.doc_ids(0, 8) == docs and [shard.doc_ids(i, i + 1) for i in range(8)] == [[x] for x in docs]
    ends = np.cumsum(np.arange(1000) % 5)
    shard = token_binary.TokenShard(token_binary.shard_bytes([None] * 300 + [3 * i for i in range(700)], ends, b"\0\0" * int(ends[-1]), 2))
    assert shard.bounds(0, 1000).tolist() == [0, *ends] and shard.bounds(511, 514).tolist() == ends[510:514].tolist()
    assert shard.doc_ids(290, 310) == [None] * 10 + [3 * i for i in range(10)]
    with pytest.raises(ValueError):
        token_binary.TokenShard(b"something else")


def test_elias_fano_is_small():
    ends = np.cumsum(np.full(10_000, 700))
    ef = token_binary.EliasFano.of(ends)
    assert ef.low.nbytes + ef.high.nbytes + ef.notes.nbytes < 10_000 * 13 / 8


def test_bpe(docs, by_id, word_ids):
    tok = Tokenizer.from_file(WORD)
    for r in bpe.bpe_round_trip(docs, WORD).collect():
        assert r.ids_text == " ".join(map(str, word_ids[r.doc_id])) and r.n_tokens == len(word_ids[r.doc_id])
        assert r.decoded == tok.decode(word_ids[r.doc_id], skip_special_tokens=False)


def test_bpe_on_every_code_point_up_to_2ff():
    """Each character alone, inside a word, beside digits, twice; and random texts of these characters."""
    table, tok = bpe.Bpe(WORD), Tokenizer.from_file(WORD)
    rng = np.random.Generator(np.random.PCG64(8))
    texts = [t for c in map(chr, range(0x300)) for t in (c, f"a{c}b", f"{c}{c}", f"Ab {c} 1{c}2 {c}'s")]
    texts += ["".join(map(chr, rng.integers(0, top, 40))) for top in (0x20, 0x80, 0x100, 0x300) for _ in range(300)]
    texts += ["a\x01b", "\x00\x01", "\x1b", "\x7f", "\x08"]
    for text, raw in zip(texts, table.encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)
    with pytest.raises(ValueError):
        table.learn({" "})


def test_bpe_edges(empty, nulls):
    assert bpe.bpe_round_trip(empty, WORD).count() == 0
    assert sorted((str(r.doc_id), r.n_tokens) for r in bpe.bpe_round_trip(nulls, WORD).collect())[0] == ("5", 0)


def test_compatible_pairs_are_those_that_merging_keeps():
    table = bpe.Bpe(WORD)
    rng = np.random.Generator(np.random.PCG64(4))
    left = [i for s, i in table.real.items() if not s.endswith("</w>")]
    every = list(table.real.values())
    a, b = rng.choice(left, 4000), rng.choice(every, 4000)
    a[:200] = b[:200] = rng.choice(left, 200)
    want = [table.exact(table.symbols(table.plain[x]) + table.symbols(table.plain[y])) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert table.compatible(a.astype(np.int64), b.astype(np.int64)).tolist() == want
    assert 0 < sum(want) < len(want)


def test_packing(docs, by_id):
    tok = Tokenizer.from_file(BYTE)
    ids = {i: [*tok.encode(t, add_special_tokens=False).ids, 0] for i, t in by_id.items()}
    got = packing.pack_documents(docs, BYTE, 0, 128, 16).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert r.doc_tokens == len(ids[r.doc_id]) and np.frombuffer(r.ids, "<u4").tolist() == ids[r.doc_id][r.start : r.start + r.length]
    for i, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0
            at += r.length
        assert at == len(ids[i])
    assert pieces.keys() == ids.keys()
    sizes = []
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        sizes.append(at)
    assert max(sizes) <= 128 and sum(sizes) > 0.9 * 128 * len(sizes)  # groups of 16 documents and small windows: most is the last group's


def test_packing_edges(empty, nulls):
    assert packing.pack_documents(empty, BYTE).count() == 0
    assert sum(r.length for r in packing.pack_documents(nulls, BYTE).collect() if r.doc_id == 5) == 1


def test_differencing():
    rng = np.random.Generator(np.random.PCG64(5))
    sizes = rng.integers(1, 1000, 300).tolist()
    for k in (1, 2, 7, 60):
        dealt = packing.differencing(sizes, k)
        assert Counter(x for w in dealt for x in w) == Counter(range(300)) and len(dealt) == k
        sums = [sum(sizes[i] for i in w) for w in dealt]
        assert max(sums) - min(sums) < 0.1 * sum(sums) / k
    assert sorted(map(len, packing.differencing([5, 3], 4))) == [0, 0, 1, 1]


def test_windows_are_nearly_equal_and_one_more_when_one_is_over():
    rng = np.random.Generator(np.random.PCG64(7))
    pieces = [(i, a, b) for i, n in enumerate(rng.integers(1, 1024, 512).tolist()) for a, b in packing.cuts(0, n, 1024, i % packing.FINE == 0)]
    got = packing.windows(pieces, 1024)
    sums = [sum(p[2] for p in w) for w in got]
    assert max(sums) <= 1024 and max(sums) - min(sums) < 30 and sum(sums) > 0.99 * 1024 * len(sums)
    held = {(i, k) for w in got for i, a, n in w for k in range(a, a + n)}
    assert len(held) == sum(sums) == sum(p[2] for p in pieces)
    assert sorted(map(len, packing.windows([(i, 0, 600) for i in range(3)], 1024))) == [1, 1, 1]  # two windows would do for 1800 ids
    assert packing.windows([], 1024) == []
    for n in range(1, 1025):
        assert [x for a, b in packing.cuts(5, 5 + n, 512, True) for x in range(a, a + b)] == list(range(5, 5 + n))


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_each_simple_character_is_split_as_the_library_does(path):
    table = Words(path)
    chars = [chr(c) for c in range(0x2100) if SIMPLE.fullmatch(chr(c))]
    texts = [f"a{c}b {c} 1{c}\n\n {c}{c}'s" for c in chars]
    assert table.encode(texts) == [table.ids(x) for x in texts]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_words_are_looked_up_one_by_one(path, texts):
    """No batch goes through all words that are known; new words, repeats and forgetting give the library's ids."""

    class Table(Words):
        def keys(self):
            raise AssertionError("the whole table was gone through")

        __iter__ = items = values = keys

    tok, table = Tokenizer.from_file(path), Table(path, most=100)
    texts = [t or "" for t in texts]
    want = [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for size in (1, 7, len(texts)):
        assert [x for i in range(0, len(texts), size) for x in table.encode(texts[i : i + size])] == want
    assert table.new == {} and len(table) < 100 + len({w for t in texts for w in table.split(t.lower() if table.lower else t)})
    assert len(table) > 0 and {type(x) for x in dict.values(table)} == {bytes}


def test_words_forget_what_a_failed_batch_asked():
    table = Words(BYTE)
    with pytest.raises(TypeError):
        table.encode(["one two", None])
    assert len(table) == 0 and table.new == {} and table.encode(["one two"]) == [table.ids("one two")]


def test_pieces_of_a_rest_that_fits_one():
    assert packing.cuts(3, 3 + 512, 512, False) == [(3, 512)] and packing.cuts(3, 4, 512, True) == [(3, 1)]
    assert packing.cuts(0, 513, 512, False) == [(0, 256), (256, 257)]
