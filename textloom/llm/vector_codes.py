"""Product codes of vectors: codebooks per part, trained on all vectors, with bounds that spare most distances.

A state per vector and part holds its entry, a lower bound of the distance to any other entry, and the round in which that
bound was measured. The codebooks of all rounds are kept, so a bound of round t is lowered by the true displacement between the
entries of round t and now (the norm of the sum of their moves), which is never more than the sum of the norms of the moves. Where
the entry is still nearer than the bound, no other distance is needed; all other parts are scanned again exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.llm.common import hot_join, stored

#: Largest component, so that sums of squares stay exact in 64-bit floats and integers.
LARGEST = 1 << 22
#: Vectors that a task compares at a time.
BLOCK = 1_024
#: Bounds are held a little lower than computed, so rounding never decides.
SLACK = 1e-6


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (the lowest of equals), its squared distance and the least of the others, for points of one part."""
    gaps = np.zeros((len(points), len(entries)))
    for j in range(points.shape[1]):
        gaps += np.square(points[:, j, None] - entries[None, :, j])
    best = gaps.argmin(axis=1)
    rows = np.arange(len(points))
    least = gaps[rows, best]
    gaps[rows, best] = np.inf
    return best, least, gaps.min(axis=1) if len(entries) > 1 else np.full(len(points), np.inf)


def furthest_others(now: np.ndarray, then: np.ndarray) -> np.ndarray:
    """For each entry the largest net displacement of all other entries of its part: (parts, entries)."""
    moved = np.sqrt(np.square(now - then).sum(axis=2))
    if moved.shape[1] < 2:
        return np.zeros(moved.shape)
    order = np.argsort(-moved, axis=1, kind="stable")
    rows = np.arange(len(moved))
    most = np.repeat(moved[rows, order[:, 0]][:, None], moved.shape[1], axis=1)
    most[rows, order[:, 0]] = moved[rows, order[:, 1]]
    return most


def assign(points: np.ndarray, history: list[np.ndarray], codes: np.ndarray, bounds: np.ndarray, stamps: np.ndarray):
    """Codes, squared distances, bounds, stamps and the number of scanned parts under the last codebooks of ``history``.

    ``points`` is (vectors, parts, width); without a state (``codes`` None) all parts are scanned. Results are those
    of a full scan: a part is spared only if its entry is strictly nearer than the bound of all others.
    """
    now, number = history[-1], len(history) - 1
    n, parts, _ = points.shape
    if codes is None:
        codes, stamps = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.uint8)
        bounds = np.full((n, parts), -1.0, np.float32)
        squares, scan = np.zeros((n, parts)), np.ones((n, parts), bool)
    else:
        codes, bounds, stamps = codes.copy(), bounds.copy(), stamps.copy()
        entries = now[np.arange(parts)[None, :], codes]
        squares = np.square(points - entries).sum(axis=2)
        lowered = bounds.astype(np.float64)
        for then in range(number):
            moved = furthest_others(now, history[then])
            lowered -= np.where(stamps == then, moved[np.arange(parts)[None, :], codes], 0)
        scan = ~(np.sqrt(squares) * (1 + SLACK) + SLACK < lowered)
    for part in range(parts):
        rows = np.flatnonzero(scan[:, part])
        if len(rows):
            best, least, others = nearest(points[rows, part], now[part])
            codes[rows, part], squares[rows, part] = best, least
            bounds[rows, part] = np.maximum(np.sqrt(others) * (1 - SLACK) - SLACK, 0)
            stamps[rows, part] = number
    return codes, squares, bounds, stamps, int(scan.sum())


def _sums(points: np.ndarray, codes: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Component sums (parts, entries, width) and counts (parts, entries) of the points of each entry."""
    n, parts, width = points.shape
    sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
    for part in range(parts):
        counts[part] = np.bincount(codes[:, part], minlength=entries)
        for j in range(width):
            # Whole numbers below 2 ** 53 are exact here: a block has few rows.
            sums[part, :, j] = np.bincount(codes[:, part], weights=points[:, part, j], minlength=entries).astype(np.int64)
    return sums, counts


def _points(column: pa.Array, parts: int) -> np.ndarray:
    """Whole vectors from the binary column, as (vectors, parts, width) of floats that hold integers."""
    flat = np.frombuffer(b"".join(column.to_pylist()), np.int32).astype(np.float64)
    return flat.reshape(len(column), parts, -1)


def _whole(parts: int, scale: int):
    """Vectors as whole numbers: ``floor(scale * x)``, 32 bits each."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            listed = table.column("vector")
            sizes = np.diff(listed.offsets.to_numpy())
            if len(sizes) and ((sizes != sizes[0]).any() or sizes[0] == 0 or sizes[0] % parts):
                raise ValueError(f"vectors must have one length, a multiple of {parts}")
            values = np.floor(listed.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            if len(values) and np.abs(values).max() > LARGEST:
                raise ValueError("a component is too large for exact sums")
            data, width = values.astype(np.int32).tobytes(), 4 * int(sizes[0]) if len(sizes) else 0
            cells = pa.array([data[k * width : (k + 1) * width] for k in range(len(sizes))], pa.binary())
            yield pa.RecordBatch.from_arrays([table.column("id"), table.column("label"), cells], names=["id", "label", "vector"])

    return run


def _round(shared, parts: int, schema: pa.Schema):
    """State rows, and one row of sums per batch."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        history = shared.value
        entries, width = history[-1].shape[1:]
        total, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for whole in tables:
            for start in range(0, whole.num_rows, BLOCK):
                table = whole.slice(start, BLOCK)
                points = _points(table.column("vector"), parts)
                state = (None, None, None)
                if "codes" in table.schema.names:
                    state = tuple(
                        np.frombuffer(b"".join(table.column(c).to_pylist()), kind).reshape(len(points), parts)
                        for c, kind in (("codes", np.uint8), ("bounds", np.float32), ("stamps", np.uint8))
                    )
                codes, squares, bounds, stamps, _ = assign(points, history, *state)
                one, some = _sums(points, codes, entries)
                total, counts = total + one, counts + some
                cells = [[row.tobytes() for row in x] for x in (codes, bounds, stamps)]
                error = pa.array(squares.sum(axis=1).astype(np.int64), pa.int64())
                none = pa.nulls(len(points), pa.binary())
                columns = [table.column(c) for c in ("id", "label", "vector")] + [pa.array(c, pa.binary()) for c in cells]
                yield pa.RecordBatch.from_arrays([*columns, error, none, none], schema=schema)
        if counts.any():
            empty = [pa.nulls(1, f.type) for f in list(schema)[:-2]]
            sums = [pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in (total, counts)]
            yield pa.RecordBatch.from_arrays([*empty, *sums], schema=schema)

    return run


def _added(cells: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a partition's batches, as one row."""
    total: list = []
    for table in cells:
        for row in zip(*(table.column(c).to_pylist() for c in ("sums", "counts"))):
            arrays = [np.frombuffer(x, np.int64) for x in row]
            total = [a + b for a, b in zip(total, arrays)] if total else arrays
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in total], names=["sums", "counts"])


def first_codebooks(whole: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The parts of the vectors with the least ids, as (parts, entries, width)."""
    rows = whole.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    points = np.stack([np.frombuffer(bytes(r["vector"]), np.int32) for r in rows]).astype(np.float64)
    return np.ascontiguousarray(points.reshape(len(rows), parts, -1).transpose(1, 0, 2))


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
) -> tuple[DataFrame, np.ndarray]:
    """Rows (id, label, ``code`` in hex, ``error``), one per kept input row, and the codebooks (parts, entries, width).

    Rows whose vector is null or holds a null or a number that is not finite are left out. Components become
    ``floor(scale * x)``. All vectors must have one length, a multiple of ``parts``, and components of LARGEST at most; else the
    job ends with an error. The first codebooks are the vectors of the least ids (null ids last; of equal ids the first in
    order of their bytes); with fewer than ``entries`` vectors there are as many entries. Each round assigns all parts and
    replaces entries by floor(sum / count); entries without parts stay. Equal distances go to the lower index. Repeated
    rows each count and stay. No vectors give no rows.

    A round is one pass over the vectors with their states, written once with the sums of its tasks, so nothing is shuffled.
    The driver holds the codebooks and a sum of each partition, added up in stages.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in (id_col, label_col)}
    session = vectors.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    sound = F.col(vector_col).isNotNull() & F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)
    )
    rows = vectors.where(sound).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), vector.alias("vector"))
    kept = rows.mapInArrow(_whole(parts, scale), f"id {kinds[id_col]}, label {kinds[label_col]}, vector binary")
    lengths = kept.agg(F.min(F.octet_length("vector")).alias("a"), F.max(F.octet_length("vector")).alias("b")).first()
    if lengths["a"] != lengths["b"]:
        raise ValueError("vectors of several lengths")
    if lengths["a"] is None:
        columns = F.lit("").alias("code"), F.lit(0).cast("long").alias("error")
        return kept.select(F.col("id").alias(id_col), F.col("label").alias(label_col), *columns), np.zeros((parts, 0, 0))
    history = [first_codebooks(kept, parts, entries)]
    shape = history[0].shape
    names = f"id {kinds[id_col]}, label {kinds[label_col]}, vector binary, codes binary, bounds binary, stamps binary, "
    names += "error bigint, sums binary, counts binary"
    state = kept
    for number in range(rounds + 1):
        schema = _arrow(session, names)
        made = state.mapInArrow(_round(session.sparkContext.broadcast(list(history)), parts, schema), names)
        if number == rounds:
            made = made.drop("vector", "bounds", "stamps")
        made = stored(made)
        state = made.where("sums is null")
        if number < rounds:
            sums, counts = _total(made.where("sums is not null").select("sums", "counts"))
            sums, counts = sums.reshape(shape), counts.reshape(shape[:2])
            means = np.floor_divide(sums, np.maximum(counts, 1)[:, :, None]).astype(np.float64)
            history.append(np.where(counts[:, :, None] > 0, means, history[-1]))
            state = state.drop("error", "sums", "counts")
    code = F.lower(F.hex("codes")).alias("code")
    return state.select(F.col("id").alias(id_col), F.col("label").alias(label_col), code, "error"), history[-1]


def _arrow(session, names: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(names))


def _total(cells: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts over all tasks, added up in partitions first: the driver gets a row of each of them."""
    width = cells.rdd.getNumPartitions()
    while width > 64:
        width = max(1, width // 16)
        cells = cells.coalesce(width).mapInArrow(_added, "sums binary, counts binary")
    rows = cells.mapInArrow(_added, "sums binary, counts binary").collect()
    total = [np.frombuffer(bytes(x), np.int64) for x in rows[0]]
    for row in rows[1:]:
        total = [a + np.frombuffer(bytes(x), np.int64) for a, x in zip(total, row)]
    return total[0], total[1]


def codebooks_digest(codebooks: np.ndarray) -> str:
    """SHA-256 (hex) of all entries' components by part, entry and position, as decimal integers between commas."""
    return hashlib.sha256(",".join(map(str, codebooks.astype(np.int64).ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """Adds ``label_error``: the error summed over equal labels, nulls together. Labels are summed in each task first."""
    key = F.coalesce(F.concat(F.lit("="), F.col(label_col).cast("string")), F.lit("")).alias("_label")
    keyed = coded.select("*", key)
    sums = stored(keyed.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")))
    return hot_join(keyed, sums, ["_label"], "_n", ["label_error"]).drop("_label")
