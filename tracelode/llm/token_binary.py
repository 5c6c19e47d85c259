"""Token-id files: one concatenated id array and Elias-Fano coded document ends."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import get, put, run_dir, stored
from .textops import batches
from .wordbpe import words

MAGIC = b"IDSEF002"
SAMPLE = 256  # every SAMPLE-th set bit of the upper part is noted for select


class EliasFano:
    """A rising sequence of n numbers up to u in about 2 + log2(u / n) bits each."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, notes: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.notes = n, low_bits, low, high, notes

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(((top >> low_bits) + n + 8) // 8, np.uint8)
        np.bitwise_or.at(high, at >> 3, (1 << (at & 7)).astype(np.uint8))
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        return cls(n, low_bits, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"), high, at[::SAMPLE].astype(np.uint64))

    def select(self, i: np.ndarray) -> np.ndarray:
        """Numbers i: from the nearest note, set bits of the upper part are counted up to the next note; then the low bits."""
        i = np.asarray(i, np.int64)
        place, block = np.zeros(len(i), np.int64), i // SAMPLE
        for b in np.unique(block).tolist():
            begin, end = int(self.notes[b]), int(self.notes[b + 1]) if b + 1 < len(self.notes) else 8 * len(self.high)
            ones = np.flatnonzero(np.unpackbits(self.high[begin >> 3 : (end + 7) >> 3], bitorder="little"))
            ones = ones[ones >= (begin & 7)] + (begin & ~7)
            some = block == b
            place[some] = ones[i[some] - b * SAMPLE]
        at = i[:, None] * self.low_bits + np.arange(self.low_bits)
        bits = (self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        low = (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return (place - i).astype(np.uint64) << np.uint64(self.low_bits) | low

    def parts(self, name: str) -> dict[str, bytes]:
        return {f"{name}_low": self.low.tobytes(), f"{name}_high": self.high.tobytes(), f"{name}_notes": self.notes.astype("<u8").tobytes()}

    @classmethod
    def read(cls, name: str, n: int, low_bits: int, part: dict[str, bytes]) -> EliasFano:
        return cls(n, low_bits, np.frombuffer(part[f"{name}_low"], np.uint8), np.frombuffer(part[f"{name}_high"], np.uint8), np.frombuffer(part[f"{name}_notes"], "<u8"))


def shard_bytes(doc_ids: list[int | None], ends: np.ndarray, ids: bytes, width: int) -> bytes:
    """A file: magic, header length and header, then the parts that the header lists, end to end. doc_ids rise, those that are null first; ids and ends are both Elias-Fano coded."""
    nulls = doc_ids.count(None)
    base = doc_ids[nulls] if nulls < len(doc_ids) else 0
    of, ef = EliasFano.of(np.array([x - base for x in doc_ids[nulls:]], np.uint64)), EliasFano.of(ends)
    parts = {**of.parts("doc"), **ef.parts("end"), "ids": ids}
    head = json.dumps({"n": len(ends), "nulls": nulls, "base": base, "low_bits": ef.low_bits, "doc_low_bits": of.low_bits, "width": width, "parts": {k: len(v) for k, v in parts.items()}}).encode()
    return MAGIC + len(head).to_bytes(4, "little") + head + b"".join(parts.values())


class TokenShard:
    """One file, read: all offsets and doc_ids are asked of the coded sequences by select; no table of them is made."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a token-id file")
        size = int.from_bytes(raw[8:12], "little")
        head, at, part = json.loads(raw[12 : 12 + size]), 12 + size, {}
        for k, n in head["parts"].items():
            part[k] = raw[at : at + n]
            at += n
        self.n, self.nulls, self.base = head["n"], head["nulls"], head["base"]
        self.tokens = np.frombuffer(part["ids"], f"<u{head['width']}")
        self.docs = EliasFano.read("doc", self.n - self.nulls, head["doc_low_bits"], part)
        self.ends = EliasFano.read("end", self.n, head["low_bits"], part)

    def bounds(self, a: int, b: int) -> np.ndarray:
        """Where documents a to b begin, and where the last of them ends."""
        ends = self.ends.select(np.arange(max(a - 1, 0), b)).astype(np.int64)
        return ends if a else np.concatenate([[0], ends])

    def doc_ids(self, a: int, b: int) -> list[int | None]:
        known = self.docs.select(np.arange(max(a, self.nulls), max(b, self.nulls)) - self.nulls)
        return [None] * (min(b, self.nulls) - min(a, self.nulls)) + [self.base + x for x in known.tolist()]

    def ids(self, i: int) -> np.ndarray:
        a, b = self.bounds(i, i + 1).tolist()
        return self.tokens[a:b]


def _writer(folder: str, path: str, end_id: int, most: int):
    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        docs: list[int | None] = []
        size = 0
        table, end = words(path), end_id.to_bytes(4, "little")
        width = 2 if max(table.tok.get_vocab_size(), end_id + 1) <= 1 << 16 else 4

        def out() -> pa.RecordBatch:
            nonlocal seq, size
            ids = b"".join(held)
            ends = np.cumsum([len(x) // 4 for x in held])
            name = f"part-{part:06d}-{seq:04d}.bin"
            put(folder, name, shard_bytes(docs, ends, np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes(), width))
            row = pa.record_batch({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "file": [name], "n_docs": pa.array([len(docs)], pa.int64()), "n_tokens": pa.array([int(ends[-1])], pa.int64())})
            held.clear()
            docs.clear()
            seq, size = seq + 1, 0
            return row

        for batch in batches(parts):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), table.encode(batch.column("text").to_pylist())):
                held.append(ids + end)
                docs.append(doc)
                size += len(ids) // 4 + 1
                if size >= most:
                    yield out()
        if held:
            yield out()

    return write


def write_tokens(docs: DataFrame, path: str, end_id: int, folder: str | None = None, most: int = 4_000_000) -> tuple[DataFrame, str]:
    """Encode texts, append end_id to each and write files of about `most` ids, in ascending doc_id order.

    Returns the manifest (part, seq, file, n_docs, n_tokens, start: ids in all files before) and the folder. Files are
    named by range and number and moved into place whole, so a repeated task rewrites the same file. Only one number
    for each range goes to the driver.

    Null texts count as empty. Rows without a doc_id come first. Rows that share a doc_id stand by text. No rows: no
    files. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or run_dir(spark, "token-ids")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranges = max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "text")
    files = stored(ordered.mapInArrow(_writer(folder, path, end_id, most), "part int, seq int, file string, n_docs long, n_tokens long"), "token-manifest")
    sums = sorted(files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    base = spark.createDataFrame([(r.part, int(b)) for r, b in zip(sums, np.cumsum([0, *(r.n for r in sums)]))], "part int, base long")
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return files.join(base, "part").withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).drop("base"), folder


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of a manifest, from the files, by select on both coded sequences, SAMPLE documents at a time."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for name, start in zip(part.column("file").to_pylist(), part.column("start").to_pylist()):
                shard = TokenShard(get(folder, name))
                for a in range(0, shard.n, SAMPLE):
                    b = min(a + SAMPLE, shard.n)
                    at = shard.bounds(a, b)
                    raw, cuts = shard.tokens[at[0] : at[-1]].astype("<u4").tobytes(), (4 * (at - at[0])).tolist()
                    crc = [zlib.crc32(raw[x:y]) for x, y in zip(cuts, cuts[1:])]
                    yield pa.record_batch({"doc_id": pa.array(shard.doc_ids(a, b), pa.int64()), "start": pa.array(start + at[:-1]), "n_tokens": pa.array(np.diff(at)), "ids_crc32": pa.array(crc, pa.int64())})

    return files.select("file", "start").repartition("file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
