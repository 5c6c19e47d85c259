"""Product codes of vectors: integer codebooks trained over all rows, nearest entries by partial-distance search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import release, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LARGEST = 1 << 62  # of a scaled component; beyond, an error is raised


def _whole(scale: int):
    def whole(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scaled vectors as integers of 32 bits, or of 64 where a component needs them. Rows with a null or non-finite component go."""
        release()
        for part in parts:
            vector = part.column("vector")
            n = len(vector)
            offsets = np.append(0, np.cumsum(np.array(vector.value_lengths().fill_null(0))))
            flat = vector.flatten().cast(pa.float64())
            x = flat.to_numpy(zero_copy_only=False)  # nulls are NaN
            bad = np.append(0, np.cumsum(~np.isfinite(x)))[offsets]
            keep = np.flatnonzero((bad[1:] == bad[:-1]) & vector.is_valid().to_numpy(zero_copy_only=False))
            with np.errstate(invalid="ignore", over="ignore"):
                low = np.floor(x * scale)
            out = []
            for i in keep.tolist():
                own = low[offsets[i] : offsets[i + 1]]
                most = np.abs(own).max(initial=0)
                if most >= LARGEST:
                    raise ValueError(f"a component is too large: {most} of {LARGEST} after scaling")
                out.append(own.astype("<i4" if most < 1 << 31 else "<i8").tobytes())
            kept = part.select(["vec_id", "label"]).take(pa.array(keep, pa.int64())) if len(keep) < n else part.select(["vec_id", "label"])
            wide = [int(offsets[i + 1] - offsets[i]) for i in keep.tolist()]
            yield kept.append_column("dims", pa.array(wide, pa.int32())).append_column("ints", pa.array(out, pa.binary()))

    return whole


def integers(raw: list[bytes], dims: int) -> np.ndarray:
    """Rows of integers out of what _whole() made."""
    if any(len(x) != 4 * dims for x in raw):
        if any(len(x) not in (4 * dims, 8 * dims) for x in raw):
            raise ValueError(f"vectors of another length than {dims}")
        raw = [x if len(x) == 8 * dims else np.frombuffer(x, "<i4").astype("<i8").tobytes() for x in raw]
        return np.frombuffer(b"".join(raw), "<i8").reshape(len(raw), dims)
    return np.frombuffer(b"".join(raw), "<i4").reshape(len(raw), dims).astype(np.int64)


def dimension_order(book: np.ndarray) -> list[int]:
    """Dimensions of a codebook in descending variance of its entries, ties in their own order."""
    k = len(book)
    spread = [k * sum(v * v for v in c) - sum(c) ** 2 for c in book.T.tolist()]
    return sorted(range(len(spread)), key=lambda d: (-spread[d], d))


def nearest_entries(x: np.ndarray, book: np.ndarray, order: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row (ties to the lower one) and its squared distance, by partial-distance search.

    Distances grow dimension by dimension. Each row has the best complete distance so far: at first that of the entry
    nearest in the first dimension, later also that of the entry nearest so far. After each dimension a mask drops all
    (row, entry) whose distance so far is strictly over it.
    """
    n, k = len(x), len(book)
    if not n or not order:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if (2 * most) ** 2 * len(order) * k >= 1 << 62:  # whole numbers of any size
        x, book = x.astype(object), book.astype(object)

    def complete(row: np.ndarray, entry: np.ndarray) -> np.ndarray:
        return ((x[row] - book[entry]) ** 2).sum(1)

    first = (x[:, order[:1]] - book[:, order[0]]) ** 2
    best = complete(np.arange(n), first.argmin(1))
    row, entry = np.nonzero(first <= best[:, None])
    so_far = first[row, entry]
    for i, d in enumerate(order[1:], 2):
        so_far = so_far + (x[row, d] - book[entry, d]) ** 2
        if i == len(order) // 2:
            begin = np.searchsorted(row, np.arange(n))  # no row is ever without an entry
            best = np.minimum(best, complete(np.arange(n), (np.minimum.reduceat(so_far * k + entry, begin) % k).astype(np.int64)))
        going = so_far <= best[row]
        row, entry, so_far = row[going], entry[going], so_far[going]
    least = np.minimum.reduceat(so_far * k + entry, np.searchsorted(row, np.arange(n)))
    return (least % k).astype(np.int64), least // k


def _sums(books: list[np.ndarray]):
    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each part and entry of a partition: number and componentwise sums of the rows that it is nearest to."""
        width = books[0].shape[1]
        orders = [dimension_order(b) for b in books]
        count = np.zeros((len(books), len(books[0])), np.int64)
        total = np.zeros((len(books), len(books[0]), width), object)
        for part in parts:
            x = integers(part.column("ints").to_pylist(), width * len(books))
            exact = x.astype(object) if int(np.abs(x).max(initial=0)) * len(x) >= LARGEST else x
            for p, (book, order) in enumerate(zip(books, orders)):
                own = slice(p * width, (p + 1) * width)
                entry, _ = nearest_entries(x[:, own], book, order)
                by = np.argsort(entry, kind="stable")
                some, first = np.unique(entry[by], return_index=True)
                count[p] += np.bincount(entry, minlength=len(book))
                if width and len(some):
                    total[p, some] += np.add.reduceat(exact[by, own], first).astype(object)
        p, e = np.nonzero(count)
        out = {"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(count[p, e])}
        yield pa.record_batch(out | {f"s{i}": pa.array([Decimal(v) for v in total[p, e, i].tolist()], pa.decimal128(38, 0)) for i in range(width)})

    return sums


def _codes(books: list[np.ndarray]):
    def codes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = books[0].shape[1]
        orders = [dimension_order(b) for b in books]
        for part in parts:
            x = integers(part.column("ints").to_pylist(), width * len(books))
            found = [nearest_entries(x[:, p * width : (p + 1) * width], b, o) for p, (b, o) in enumerate(zip(books, orders))]
            code = np.stack([f[0] for f in found], 1).astype(np.uint8)
            error = [sum(v) for v in zip(*[f[1].tolist() for f in found])]
            yield part.select(["vec_id", "label"]).append_column("code", pa.array([r.tobytes().hex() for r in code], pa.string())).append_column("error", pa.array(error, pa.int64()))

    return codes


def train(ints: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks, one for each part. The driver sees `entries` rows once and parts * entries sums a round."""
    if dims % parts:
        raise ValueError(f"vectors of {dims} components can't be cut into {parts} equal parts")
    start = ints.orderBy(F.asc_nulls_last("vec_id"), "ints").limit(entries).select("ints").collect()
    books = np.split(integers([bytes(r.ints) for r in start], dims), parts, axis=1)
    width = dims // parts
    names = [f"s{i}" for i in range(width)]
    schema = ", ".join(["part int, entry int, n long", *[f"{s} decimal(38,0)" for s in names]])
    for _ in range(rounds):
        found = ints.select("ints").mapInArrow(_sums(books), schema).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ["n", *names]]).collect()
        books = [b.copy() for b in books]
        for r in found:
            books[r.part][r.entry] = [int(r[s]) // r.n for s in names]
    return books


def vector_codes(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row for each kept row of vectors: vec_id, code, error, label_error, codebooks_sha256 (and label).

    Components become floor(scale * x); codebooks of `entries` entries for each of `parts` equal parts are trained by
    `rounds` rounds of nearest entries and means (floored) over all rows, starting with the rows of the smallest vec_ids. All
    sums are of integers, so the result is the same however rows are dealt. A round sends one row for each part and entry
    of a partition; errors are summed by label before labels are joined, so a hot label is no hot task.

    Rows whose vector is null or holds null or non-finite components are dropped. Rows without a vec_id are coded
    like others, but stand last among the smallest ids. Repeated rows stay repeated, and count each time (also among
    the first; ties of vec_id go by their contents). With fewer than `entries` rows codebooks are that short. No kept rows: no rows.
    Vectors of no component get the first entry and no error; vectors of unequal length, or one that can't be cut into
    parts, raise an error, as do components of 2**62 or more after scaling and errors beyond 64 bits. Other columns are ignored.
    """
    label = vectors.schema["label"].dataType.simpleString()
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col(vector).alias("vector"))
    ints = stored(plain.where("vector is not null").mapInArrow(_whole(scale), f"vec_id long, label {label}, dims int, ints binary"), "vector-integers")
    sizes = ints.agg(F.min("dims"), F.max("dims")).first()
    if sizes[0] is None:
        return ints.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"), "label")
    if sizes[0] != sizes[1]:
        raise ValueError(f"vectors of {sizes[0]} to {sizes[1]} components")
    books = train(ints, sizes[0], parts, entries, rounds)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    coded = stored(ints.mapInArrow(_codes(books), f"vec_id long, label {label}, code string, error long"), "vector-codes")
    by_label = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "label1"), "label-errors")
    both = coded.join(by_label, F.col("label").eqNullSafe(F.col("label1")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"), "label")
