"""Exact dedup by a tree merge of sorted digest runs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .textops import batches, flat

_LEAST = np.iinfo(np.int64).min


def _digests(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = TaskContext.get().partitionId()
    for part in batches(parts, most=8 << 20):
        data, at = flat(part.column("text"))
        raw = data.tobytes().lower()  # bytes.lower() changes A-Z only
        out = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.record_batch({"doc_id": part.column("doc_id").cast(pa.int64()), "digest": pa.array(out, pa.binary()), "n_bytes": pa.array(np.diff(at), pa.int64()), "run": pa.array(np.full(len(out), run), pa.int32())})


_ROW = np.dtype([("digest", "<u8", 4), ("n_bytes", "<i8"), ("keep_id", "<i8"), ("group_size", "<i8")])
_RUN = "bucket int, run int, entries binary"


def merged(runs: list[np.ndarray], largest: bool) -> np.ndarray:
    """One sorted run of several: entries equal in digest and length become one, with the best id and all their rows.

    A stable sort by the digests' first eight bytes: over runs that are sorted already it merges them.
    """
    rows = np.concatenate(runs)
    if not len(rows):
        return rows
    rows = rows[np.argsort(rows["digest"][:, 0], kind="stable")]
    same = lambda x: np.concatenate([[False], (x["digest"][1:] == x["digest"][:-1]).all(1) & (x["n_bytes"][1:] == x["n_bytes"][:-1])])
    first = rows["digest"][:, 0]
    if (np.concatenate([[False], first[1:] == first[:-1]]) & ~same(rows)).any():  # different digests begin alike
        rows = rows[np.lexsort((rows["n_bytes"], *(rows["digest"][:, i] for i in (3, 2, 1, 0))))]
    begin = np.flatnonzero(~same(rows))
    out = rows[begin].copy()
    out["keep_id"] = (np.maximum if largest else np.minimum).reduceat(rows["keep_id"], begin)
    out["group_size"] = np.add.reduceat(rows["group_size"], begin)
    return out


def _runs(bits: int, worst: int, largest: bool):
    def runs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted runs of a partition's digests, cut by the digest's first bits: one row each."""
        for part in parts:
            rows = np.zeros(part.num_rows, _ROW)
            rows["digest"] = np.frombuffer(flat(part.column("digest"))[0].tobytes(), ">u8").reshape(-1, 4)
            rows["n_bytes"], rows["keep_id"], rows["group_size"] = part.column("n_bytes").to_numpy(), pc.fill_null(part.column("doc_id"), worst).to_numpy(), 1
            run = part.column("run").to_numpy()
            for r in np.unique(run).tolist():
                own = merged([rows[run == r]], largest)
                bucket = (own["digest"][:, 0] >> np.uint64(64 - bits)).astype(np.int64)
                cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(own)]
                yield pa.record_batch({"bucket": pa.array(bucket[cuts[:-1]], pa.int32()), "run": pa.array(np.full(len(cuts) - 1, r), pa.int32()), "entries": pa.array([own[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())})

    return runs


def _merger(largest: bool):
    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs come sorted by bucket and number: those with the same are merged into one."""
        now, held = None, []

        def out() -> pa.RecordBatch:
            both = merged([np.frombuffer(x, _ROW) for x in held], largest)
            held.clear()
            return pa.record_batch([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([both.tobytes()], pa.binary())], names=["bucket", "run", "entries"])

        for part in parts:
            for bucket, run, raw in zip(*(c.to_pylist() for c in part.columns)):
                if held and (bucket, run) != now:
                    yield out()
                now = bucket, run
                held.append(raw)
        if held:
            yield out()

    return merge


def _groups(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of more than one row."""
    for part in parts:
        for raw in part.column("entries").to_pylist():
            rows = np.frombuffer(raw, _ROW)
            rows = rows[rows["group_size"] > 1]
            for a in range(0, len(rows), 20_000):
                x = rows[a : a + 20_000]
                digest = x["digest"].astype(">u8").tobytes()
                yield pa.record_batch({"d": pa.array([digest[i : i + 32] for i in range(0, len(digest), 32)], pa.binary()), "b": pa.array(x["n_bytes"].astype(np.int64)), "keep_id": pa.array(x["keep_id"].astype(np.int64)), "group_size": pa.array(x["group_size"].astype(np.int64))})


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", fan_in: int = 8) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. Texts are equal if identical after lower-casing A-Z.

    Each partition makes sorted runs of entries (digest, length, best id, count), cut by digest into buckets, as many as there are
    runs. In each round the runs of a bucket whose numbers div fan_in are equal meet and are merged into one sorted run, so a digest
    has one entry in each run however often it occurs. Entries become one only if SHA-256 and length both agree, at every level.

    Null texts count as empty. A null id counts as the worst id. Rows that repeat an id share its decision, so a
    group can keep several rows only if they carry the same id. No rows: no rows. Other columns are ignored.
    """
    ids = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_digests, "doc_id long, digest binary, n_bytes long, run int"), "digests")
    last, n = ids.agg(F.max("run"), F.count("*")).first()
    runs, largest = (last or 0) + 1, keep == "largest"
    bits = max(4, (max(runs, n // 200_000) - 1).bit_length())
    worst = _LEAST if largest else np.iinfo(np.int64).max
    merge, tree, first = _merger(largest), ids.mapInArrow(_runs(bits, worst, largest), _RUN), True
    while runs > 1 or first:  # the first round also joins the runs that one partition made of its batches
        runs, first = -(-runs // fan_in), False
        tree = tree.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).repartition("bucket", "run").sortWithinPartitions("bucket", "run").mapInArrow(merge, _RUN)
    groups = tree.mapInArrow(_groups, "d binary, b long, keep_id long, group_size long")
    out = ids.join(groups, (ids.digest == groups.d) & (ids.n_bytes == groups.b), "left")
    best = F.when(F.col("keep_id").isNull() | (F.col("keep_id") == worst), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", best.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(best).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
