"""Packing documents into sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import batches
from .wordbpe import words

FINE = 4  # of so many documents one is cut finely


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Deal items to k windows of nearly equal sums (largest differencing method).

    A partial partition has k sums in falling order. The two with the largest spread are merged, the larger sums of
    one with the smaller of the other, and the least sum is taken off all, until one is left.
    """
    if k == 1:
        return [list(range(len(sizes)))]
    sums = np.zeros((len(sizes), k), np.int64)
    sums[:, 0] = sizes
    node = np.full((len(sizes), k), -1, np.int64)
    node[:, 0] = np.arange(len(sizes))
    both: list[tuple[int, int]] = []  # inner nodes of the trees of items; numbered from len(sizes)
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i = heapq.heappop(heap)
        _, j = heapq.heappop(heap)
        total, x, y = sums[i] + sums[j, ::-1], node[i], node[j, ::-1]
        new = np.maximum(x, y)  # one of them is -1, but where both hold items
        if len(join := (np.minimum(x, y) >= 0).nonzero()[0]):
            new[join] = np.arange(len(sizes) + len(both), len(sizes) + len(both) + len(join))
            both += zip(x[join].tolist(), y[join].tolist())
        order = (-total).argsort(kind="stable")
        sums[i], node[i] = total[order] - total[order[-1]], new[order]
        heapq.heappush(heap, (-int(sums[i, 0]), i))
    out = []
    for top in node[heap[0][1]].tolist():
        items, stack = [], [top] if top >= 0 else []
        while stack:
            x = stack.pop()
            if x < len(sizes):
                items.append(x)
            else:
                stack += both[x - len(sizes)]
        out.append(items)
    return out


def windows(pieces: list[tuple[int, int, int]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows of nearly equal sums that hold all pieces (item, begin, length), none over the capacity.

    As few windows as the sum asks for are tried first; while one of them is over the capacity there are more: one, or as many as lower the mean by what it is over.
    Pieces of an item that follow each other and meet in a window are one piece again.
    """
    total = sum(p[2] for p in pieces)
    k = -(-total // capacity)
    while k:
        dealt = differencing([p[2] for p in pieces], k)
        over = max(sum(pieces[i][2] for i in items) for items in dealt) - capacity
        if over <= 0:
            break
        k = max(k + 1, -(-total // max(capacity - over, 1))) if over < capacity // 16 else k + 1
    out = []
    for items in dealt if k else []:
        own: list[tuple[int, int, int]] = []
        for item, begin, length in sorted(pieces[i] for i in items):
            if own and own[-1][0] == item and own[-1][1] + own[-1][2] == begin:
                own[-1] = (item, own[-1][1], own[-1][2] + length)
            else:
                own.append((item, begin, length))
        if own:
            out.append(own)
    return out


def cuts(begin: int, end: int, most: int, fine: bool) -> list[tuple[int, int]]:
    """(begin, length) of the pieces of a rest: equal ones of `most` ids or fewer; fine: the last one in halves down to two ids, so that differencing has something to level windows with."""
    at = np.linspace(begin, end, -(-(end - begin) // most) + 1).astype(int).tolist() if end - begin > most else [begin, end]
    out = [(a, b - a) for a, b in zip(at, at[1:])]
    if fine:
        at, length = out.pop()
        while length > 2:
            half = length - length // 2
            out.append((at, half))
            at, length = at + half, length - half
        out.append((at, length))
    return out


def _packer(path: str, end_id: int, capacity: int, group: int, piece: int):
    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, end = words(path), end_id.to_bytes(4, "little")
        sequence = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []
        docs: list[tuple[int | None, bytes]] = []
        pool: list[tuple[int, int, int]] = []

        def put(pieces: list[tuple[int, int, int]]) -> None:
            nonlocal sequence
            offset = 0
            for item, begin, length in pieces:
                doc, ids = docs[item]
                rows.append((doc, begin, length, ids[4 * begin : 4 * (begin + length)], len(ids) // 4, sequence, offset))
                offset += length
            sequence += 1

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows)) or [()] * 7
            rows.clear()
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        def close() -> None:
            for pieces in windows(pool, capacity):
                put(pieces)
            docs.clear()
            pool.clear()

        for batch in batches(parts):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), table.encode(batch.column("text").to_pylist())):
                ids += end
                docs.append((doc, ids))
                n = len(ids) // 4
                for begin in range(0, n - capacity + 1, capacity):
                    put([(len(docs) - 1, begin, capacity)])
                if rest := n % capacity:
                    pool += [(len(docs) - 1, a, b) for a, b in cuts(n - rest, n, piece, len(docs) % FINE == 0)]
                if len(docs) >= group:
                    close()
                if len(rows) >= 2000:
                    yield out()
        close()
        yield out()

    return pack


def pack_documents(docs: DataFrame, path: str, end_id: int = 0, capacity: int = 1024, group: int = 512, piece: int = 1024) -> DataFrame:
    """Pieces of documents in sequences of `capacity` ids: doc_id, start, length, ids (unsigned 32-bit, little-endian), doc_tokens, sequence_id, offset.

    Texts are encoded and end_id appended. Windows that one document fills are cut off it; its rest is cut into equal pieces
    of `piece` ids or fewer, that of every FINE-th document in ever smaller halves, and the pieces of `group` documents at a time are dealt by differencing to windows of nearly equal
    sums, one more whenever one would be over the capacity. Each window is padded by the few ids it lacks. Nothing is
    shuffled, and memory holds one group. sequence_id has the partition in its upper bits, so it is the same if a task runs again.

    Null texts count as empty (one id, the end). Rows stand for themselves even if they repeat; doc_id may be null.
    No rows: no rows. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_packer(path, end_id, capacity, group, piece), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
