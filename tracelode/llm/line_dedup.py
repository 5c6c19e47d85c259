"""Line dedup with two Bloom filters, for hashes seen once and seen twice."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, get, names, put, release, resident, run_dir, stored
from .textops import batches, flat

_WHITE = b" \t\n\v\f\r"
SEGMENT = 1 << 21  # bits of a part of a filter
PROBES = 4
ASKED = 1 << 18  # keys that a worker holds against the filter at a time, beside the filter's 64 MB


def line_key(line: bytes, least: int) -> bytes | None:
    """Digest of a line's key, None if the key has fewer than `least` code points."""
    key = line.strip(_WHITE).lower()
    if len(key) < least or (len(key) < 4 * least and len(key.decode()) < least):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _lines(least: int):
    def lines(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in batches(parts, most=8 << 20):
            data, at = flat(part.column("text"))
            raw, keys, counts = data.tobytes(), [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                found = dict.fromkeys(line_key(x, least) for x in raw[a:b].split(b"\n"))
                found.pop(None, None)
                keys.append(b"".join(found))
                counts.append(len(found))
            yield pa.record_batch({"doc_id": part.column("doc_id"), "keys": pa.array(keys, pa.binary()), "n_keys": pa.array(counts, pa.int64())})

    return lines


def _keys(parts: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(digests as two uint64 columns, their documents), about `most` at a time."""
    held, n = [], 0
    for part in parts:
        raw, at = flat(part.column("keys"))
        both = raw.tobytes()
        rows = np.frombuffer(both, np.uint64).reshape(-1, 2)
        held.append((rows, np.repeat(part.column("doc_id").to_numpy(), np.diff(at) // 16)))
        n += len(rows)
        if n > most:
            yield np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            held, n = [], 0
    if n:
        yield np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])


def _places(rows: np.ndarray, segments: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each digest's segment, and its bits there."""
    step, bits = rows[:, 1] | np.uint64(1), np.empty((len(rows), PROBES), np.int32)
    for i in range(PROBES):
        bits[:, i] = ((rows[:, 0] + np.uint64(i) * step) >> np.uint64(7)) & np.uint64(size - 1)
    return ((rows[:, 1] >> np.uint64(32)) % np.uint64(segments)).astype(np.int64), bits


def _filter(bits: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size // 8, np.uint8)
    bits = np.unique(bits)
    if len(bits):
        byte = bits >> 3
        first = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
        out[byte[first]] = np.bitwise_or.reduceat((128 >> (bits & 7)).astype(np.uint8), first)
    return out


def _local(segments: int, size: int):
    def local(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's two filters, a segment at a time."""
        for rows, _ in _keys(parts):
            rows, counts = np.unique(rows, axis=0, return_counts=True)
            segment, bits = _places(rows, segments, size)
            order = np.argsort(segment, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(segment[order])) + 1):
                once, twice = _filter(bits[part], size), _filter(bits[part[counts[part] > 1]], size)
                yield pa.record_batch({"segment": pa.array([segment[part[0]]], pa.int32()), "once": pa.array([zlib.compress(once, 1)], pa.binary()), "twice": pa.array([zlib.compress(twice, 1)], pa.binary())})

    return local


def _merged(folder: str, size: int):
    def merged(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partial filters come sorted by segment; a bit set once in two of them is set twice."""
        at, once, twice = None, None, None
        for part in parts:
            for segment, a, b in zip(*(part.column(k).to_pylist() for k in ("segment", "once", "twice"))):
                a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
                if segment != at:
                    if at is not None:
                        put(folder, f"{at}.bin", zlib.compress(twice, 1))
                        yield pa.record_batch({"segment": pa.array([at], pa.int32())})
                    at, once, twice = segment, np.zeros(size // 8, np.uint8), np.zeros(size // 8, np.uint8)
                twice |= b | (once & a)
                once |= a
        if at is not None:
            put(folder, f"{at}.bin", zlib.compress(twice, 1))
            yield pa.record_batch({"segment": pa.array([at], pa.int32())})

    return merged


def _suspects(folder: str, segments: int, size: int):
    def load(folder: str) -> np.ndarray:
        out = np.zeros(segments * (size // 8), np.uint8)
        for name in names(folder):
            at = int(name.removesuffix(".bin")) * (size // 8)
            out[at : at + size // 8] = np.frombuffer(zlib.decompress(get(folder, name)), np.uint8)
        return out

    def suspects(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = resident("line-filter", folder, load)
        for rows, docs in _keys(parts, ASKED):
            segment, bits = _places(rows, segments, size)
            hit = np.ones(len(rows), bool)
            for i in range(PROBES):
                where = segment * size + bits[:, i]
                hit &= (twice[where >> 3] >> (7 - (where & 7)).astype(np.uint8)) & 1 == 1
            raw = np.ascontiguousarray(rows[hit]).tobytes()
            yield pa.record_batch({"key": pa.Array.from_buffers(pa.binary(16), hit.sum(), [None, pa.py_buffer(raw)]).cast(pa.binary()), "doc_id": pa.array(docs[hit], pa.int64())})

    return suspects


def _rebuild(least: int, drop_at: str):
    def rebuild(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in batches(parts, most=8 << 20):
            data, at = flat(part.column("text"))
            raw, rows = data.tobytes(), []
            for a, b, drop in zip(at[:-1].tolist(), at[1:].tolist(), part.column(drop_at).to_pylist()):
                lines = raw[a:b].split(b"\n")
                if drop:
                    gone = set(drop)
                    kept = [x for x in lines if line_key(x, least) not in gone]
                    rows.append((len(lines), len(lines) - len(kept), b"\n".join(kept).decode()))
                else:
                    rows.append((len(lines), 0, raw[a:b].decode()))
            n, dropped, text = zip(*rows) if rows else ((), (), ())
            out = part.drop_columns(["text", drop_at])
            for name, values, kind in (("text", text, pa.string()), ("n_lines", n, pa.int64()), ("n_dropped", dropped, pa.int64())):
                out = out.append_column(name, pa.array(values, kind))
            yield out

    return rebuild


def line_dedup(docs: DataFrame, least: int = 10, filter_bits: int = 1 << 29) -> DataFrame:
    """Drop lines whose key stands in two documents or more, except in the one with the smallest doc_id.

    Returns docs with the new text and n_lines (before), n_dropped. A line's key is the line without white space at
    both ends, A-Z lower-cased; keys below `least` code points never count. Lines that repeat within one document
    only are kept.

    Each partition fills two Bloom filters with its keys (all; those of two documents). Merged, the second also gets
    every bit that two partitions set, so it holds each key of two documents or more. Only keys found in it are
    shuffled, confirmed by digest and given their smallest document. The filters have `filter_bits` bits each (64 MB)
    whatever the input (a power of two), in segments that are made in tasks of their own; a Python worker reads the second one once
    and lets go of it before texts are built again. Results
    never depend on that size: beyond some hundred million keys more and more of those that stand once are
    suspected too, and shuffled as 24 bytes each.

    Null texts count as empty (one empty line). Rows without a doc_id are left as they are. Rows with the same doc_id
    count as one document. No rows: no rows. Other columns pass through, but for n_lines and n_dropped of docs, which
    are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped").withColumn("doc_id", F.col("doc_id").cast("long"))
    keys = stored(docs.where("doc_id is not null").select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_lines(least), "doc_id long, keys binary, n_keys long"), "line-keys")
    size = min(SEGMENT, filter_bits)
    segments = filter_bits // size
    folder = run_dir(spark, "line-filter")
    partial = keys.mapInArrow(_local(segments, size), "segment int, once binary, twice binary")
    partial.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merged(folder, size), "segment int").agg(F.count("*")).collect()
    suspects = stored(keys.mapInArrow(_suspects(folder, segments, size), "key binary, doc_id long"), "line-suspects")
    confirmed = suspects.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first != last").select("key", "first")
    confirmed = stored(confirmed, "line-repeats")  # so that the join below is between two plain shuffles, and hot keys are split
    drop_at = free_name("drop", docs.columns)
    drop = suspects.join(confirmed, "key").where("doc_id != first").groupBy("doc_id").agg(F.collect_set("key").alias(drop_at))
    rows = docs.withColumn("text", F.col("text").cast("string")).join(drop, "doc_id", "left")
    rest = [c for c in rows.columns if c not in ("text", drop_at)]
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest] + ["text string", "n_lines long", "n_dropped long"])
    return rows.select(*[f"`{c}`" for c in rest], "text", drop_at).mapInArrow(_rebuild(least, drop_at), schema)
