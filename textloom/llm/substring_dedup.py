"""Removal of word windows that earlier documents have, behind a count-min prefilter.

1. Documents are dealt into blocks. Every task sketches the windows of its blocks: for each row of the
   count-min sketch the counters it touched, sorted and compressed, cut into shards.
2. One group per row and shard adds the sketches up and tells each block which of its counters reached two. A counter
   holds at least the number of its windows, so no repeated window is lost.
3. Blocks name the windows whose counters all reached two, by 96 bits, with the smallest id they have.
   One group per shard finds the smallest id of all and tells the blocks that have a larger one.
4. Blocks remove the words those windows cover.

The texts move once; all other traffic is bytes per window, not rows. Nothing grows in one place: shards
and blocks follow ``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from textloom.llm.common import text_of

WINDOW = 13
ROWS = 2
#: Windows that a task holds before it writes its sketches.
HELD = 2_000_000
BYTES_AT_ONCE = 2_000_000

BLOBS = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("block", pa.int32()), ("data", pa.binary())])
CLEANED = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
KIND = "kind int, shard int, block int, data binary"


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words between ASCII blanks, and the byte where each starts."""
    raw = np.frombuffer(data + bytes(8), np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    blank[len(data) :] = True
    edges = np.nonzero(blank[1:] != blank[:-1])[0] + 1
    if not blank[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[::2], edges[1::2]
    # Eight bytes at a time, as far as the longest word goes; each round has the words that are longer still.
    eights = np.lib.stride_tricks.as_strided(raw, (len(data) + 1, 8), (1, 1), writeable=False)
    hashes, left = (ends - starts).astype(np.uint64), ends - starts
    rows, at = np.arange(len(starts)), starts
    while len(rows):
        part = eights[at].reshape(-1).view(np.uint64)
        part = part & TAILS[np.minimum(left, 8)]
        hashes[rows] = _mix((hashes[rows] ^ part) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    return hashes, starts


#: Masks of the first bytes of a little-endian word.
TAILS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def pack(*arrays: np.ndarray) -> bytes:
    """Compressed arrays: sorted unsigned ones as differences, ids in as few bytes as they need."""
    parts = []
    for array in arrays:
        if array.dtype == np.uint64:
            steps = np.diff(array, prepend=np.uint64(0))
            size = _bytes(int(steps.max(initial=0)))
            parts.append(bytes([size]) + steps.astype(f"u{size}").tobytes())
        elif array.dtype == np.int64 and len(array) and array.min() >= 0:
            size = _bytes(int(array.max()))
            parts.append(bytes([PLAIN + size]) + array.astype(f"u{size}").tobytes())
        else:
            parts.append(b"\0" + array.tobytes())
    lengths = np.array([len(p) for p in parts], np.uint32).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(lengths + b"".join(parts))


PLAIN = 16


def _bytes(largest: int) -> int:
    return next(k for k in (1, 2, 4, 8) if largest < 1 << 8 * k)


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    lengths, at, arrays = np.frombuffer(raw, np.uint32, len(kinds)), 4 * len(kinds), []
    for length, kind in zip(lengths.tolist(), kinds):
        size, body = raw[at], raw[at + 1 : at + length]
        if size > PLAIN:
            arrays.append(np.frombuffer(body, f"u{size - PLAIN}").astype(np.int64))
        elif size:
            arrays.append(np.cumsum(np.frombuffer(body, f"u{size}").astype(np.uint64)))
        else:
            arrays.append(np.frombuffer(body, kind))
        at += length
    return arrays


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


def window_hashes(words: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each run of ``size`` word hashes."""
    n, out = max(0, len(words) - size + 1), []
    for factor in (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)):
        total = np.zeros(n, np.uint64)
        for i in range(size):
            total = total * factor + words[i : i + n]
        out.append(_mix(total))
    return out[0], out[1]


def _half(second: np.ndarray) -> np.ndarray:
    """The part of the second hash that names a window, beside the whole first one."""
    return (second >> np.uint64(32)).astype(np.uint32)


def counters(first: np.ndarray, second: np.ndarray, bits: int) -> list[np.ndarray]:
    """The counter of each window in each row of the sketch."""
    return [first >> np.uint64(64 - bits), _mix(first + second) >> np.uint64(64 - bits)][:ROWS]


def _texts(table):
    """Groups of whole documents: row numbers, texts, word hashes, first word of each document."""
    rows, texts, size = [], [], 0

    def held():
        hashes, places = word_hashes(b" ".join(texts))
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        return rows, texts, hashes, np.searchsorted(places, begins)

    for i, text in enumerate(table.column("text").cast(pa.binary())):
        rows.append(i)
        texts.append(text.as_py())
        size += len(texts[-1])
        if size >= BYTES_AT_ONCE:
            yield held()
            rows, texts, size = [], [], 0
    if rows:
        yield held()


def _windows(flat: np.ndarray, starts: np.ndarray, size: int):
    """Hashes of the windows inside documents, with the document and the place of each."""
    first, second = window_hashes(flat, size)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    inside = owner[: len(first)] == owner[size - 1 :] if len(first) else np.zeros(0, bool)
    return first[inside], second[inside], owner[: len(first)][inside], np.nonzero(inside)[0]


def _cut(values: np.ndarray, shards: int, bits: int) -> list[tuple[int, slice]]:
    """Stretches of sorted values of ``bits`` bits, by shard."""
    edges = [(s << bits) // shards for s in range(1, shards)]
    places = [0, *np.searchsorted(values, np.array(edges, np.uint64)).tolist(), len(values)]
    return [(s, slice(a, b)) for s, (a, b) in enumerate(zip(places, places[1:])) if b > a]


def _sketch(bits: int, shards: int, size: int):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = {}, 0

        def flush():
            for block, parts in held.items():
                first, second = (np.concatenate(x) for x in zip(*parts))
                for kind, cells in enumerate(counters(first, second, bits)):
                    cells, times = np.unique(cells, return_counts=True)
                    for shard, part in _cut(cells, shards, bits):
                        data = pack(cells[part], np.packbits(times[part] > 1))
                        yield pa.RecordBatch.from_pylist(
                            [{"kind": kind, "shard": shard, "block": block, "data": data}], BLOBS
                        )
            held.clear()

        for table in tables:
            blocks = table.column("block").to_numpy()
            for rows, _, flat, starts in _texts(table):
                first, second, owner, _ = _windows(flat, starts, size)
                of = blocks[np.array(rows)[owner]] if len(owner) else np.zeros(0, np.int32)
                for block in np.unique(of).tolist():
                    mine = of == block
                    held.setdefault(block, []).append((first[mine], second[mine]))
                total += len(first)
                if total >= HELD:
                    yield from flush()
                    total = 0
        yield from flush()

    return run


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, BLOBS)


def _add(table: pa.Table) -> pa.Table:
    """Sum the sketches of a row and shard; answer each block with its counters that reached two."""
    parts = [unpack(data.as_py(), "u8", "u1") for data in table.column("data")]
    cells = np.sort(np.concatenate([found for found, _ in parts]))
    many = [found[np.unpackbits(flags, count=len(found)) > 0] for found, flags in parts]
    repeated = np.unique(np.concatenate([cells[1:][cells[1:] == cells[:-1]], *many]))
    is_in = membership(repeated)
    answers: dict[int, list] = {}
    for block, (found, _) in zip(table.column("block").to_pylist(), parts):
        answers.setdefault(block, []).append(found[is_in(found)])
    kind, shard = table.column("kind")[0].as_py(), table.column("shard")[0].as_py()
    rows = []
    for block, found in answers.items():
        told = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        if len(told):
            rows.append({"kind": kind, "shard": shard, "block": block, "data": pack(told)})
    return _table(rows)


def membership(listed: np.ndarray):
    """A test for values in a sorted list; a table of the values' mixed bits spares most searches."""
    bits = min(24, max(10, 3 + len(listed).bit_length()))
    table = np.zeros(1 << bits, bool)
    down = np.uint64(64 - bits)
    table[(listed * SCATTER) >> down] = True

    def test(values: np.ndarray) -> np.ndarray:
        found = table[(values * SCATTER) >> down]
        some = np.nonzero(found)[0]
        if len(some):
            sought = values[some]
            at = np.minimum(np.searchsorted(listed, sought), len(listed) - 1)
            found[some] = listed[at] == sought
        return found

    return test


SCATTER = np.uint64(0x9E3779B97F4A7C15)


def _smallest(first, second, ids):
    """Distinct windows in order with their smallest id, and whether they have a larger one too."""
    order = np.lexsort((ids, second, first))
    first, second, ids = first[order], second[order], ids[order]
    new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
    start = np.nonzero(new)[0]
    last = np.append(start[1:], len(first)) - 1
    return order, new, first[start], second[start], ids[start], ids[last] > ids[start]


def _name(bits: int, shards: int, size: int):
    def run(docs: pa.Table, repeated: pa.Table) -> pa.Table:
        listed: list = [[] for _ in range(ROWS)]
        for kind, data in zip(repeated.column("kind").to_pylist(), repeated.column("data")):
            listed[kind].append(unpack(data.as_py(), "u8")[0])
        tests = [membership(np.sort(np.concatenate(x)) if x else np.zeros(0, np.uint64)) for x in listed]
        found = []
        ids = docs.column("id").to_pylist()
        for rows, _, flat, starts in _texts(docs):
            first, second, owner, _ = _windows(flat, starts, size)
            keep = np.array([ids[i] is not None for i in rows], bool)[owner] if len(owner) else np.zeros(0, bool)
            for cells, is_in in zip(counters(first, second, bits), tests):
                keep &= is_in(cells)
            own = np.array([ids[i] or 0 for i in rows], np.int64)
            found.append((first[keep], _half(second[keep]), own[owner[keep]]))
        if not sum(len(x[0]) for x in found):
            return _table([])
        _, _, first, second, least, more = _smallest(*(np.concatenate(x) for x in zip(*found)))
        block = docs.column("block")[0].as_py()
        return _table(
            [
                {"kind": 0, "shard": s, "block": block, "data": pack(first[p], second[p], least[p], more[p])}
                for s, p in _cut(first, shards, 64)
            ]
        )

    return run


def _settle(table: pa.Table) -> pa.Table:
    """Smallest id of each window; answer each block with the windows for which it has a larger one."""
    parts = [unpack(d.as_py(), "u8", "u4", "i8", "?") for d in table.column("data")]
    owner = np.repeat(np.array(table.column("block").to_pylist(), np.int32), [len(p[0]) for p in parts])
    first, second, ids, more = (np.concatenate(x) for x in zip(*parts))
    order, new, _, _, least, _ = _smallest(first, second, ids)
    least = least[np.cumsum(new) - 1]
    first, second, ids, more, owner = (x[order] for x in (first, second, ids, more, owner))
    tell = (least < ids) | more
    first, second, least, owner = first[tell], second[tell], least[tell], owner[tell]
    order = np.argsort(owner, kind="stable")
    first, second, least, owner = first[order], second[order], least[order], owner[order]
    shard, rows = table.column("shard")[0].as_py(), []
    for block in np.unique(owner).tolist():
        a, b = np.searchsorted(owner, [block, block + 1])
        rows.append({"kind": 0, "shard": shard, "block": block, "data": pack(first[a:b], second[a:b], least[a:b])})
    return _table(rows)


def _clean(size: int):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        parts = [unpack(d.as_py(), "u8", "u4", "i8") for d in told.column("data")]
        known = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, t) for t in ("u8", "u4", "i8")]
        order = np.lexsort((known[1], known[0]))
        key, check, least = (x[order] for x in known)
        is_in = membership(key)
        ids, rows_out = docs.column("id").to_pylist(), []
        for rows, texts, flat, starts in _texts(docs):
            first, second, owner, place = _windows(flat, starts, size)
            own = np.array([np.iinfo(np.int64).min if ids[i] is None else ids[i] for i in rows], np.int64)
            gone = np.zeros(len(flat) + 1, np.int64)
            waits = np.nonzero(is_in(first))[0]
            at = np.searchsorted(key, first[waits])
            while len(waits):
                right = check[at] == _half(second[waits])
                hit = place[waits[right & (least[at] < own[owner[waits]])]]
                gone[hit] += 1
                gone[hit + size] -= 1
                # Windows that agree in the first hash alone stand side by side.
                waits, at = waits[~right], at[~right] + 1
                same = at < len(key)
                waits, at = waits[same], at[same]
                same = key[at] == first[waits]
                waits, at = waits[same], at[same]
            covered = np.cumsum(gone)[:-1] > 0
            for i, text, a, b in zip(rows, texts, starts.tolist(), starts[1:].tolist()):
                lost, left = int(covered[a:b].sum()), text.split()
                if lost:
                    left = [w for w, c in zip(left, covered[a:b].tolist()) if not c]
                rows_out.append({"id": ids[i], "n_words": b - a, "n_removed": lost, "kept": b" ".join(left).decode()})
        return pa.Table.from_pylist(rows_out, CLEANED)

    return run


def sketch_bits(documents: int) -> int:
    """Bits of a counter's number: several counters for each window of a corpus of usual documents."""
    return min(48, max(24, math.ceil(math.log2(max(1, documents) * 2048)) + 1))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, bits: int | None = None
) -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_removed``, ``kept`` (the words that stay, joined by one blank).

    A word goes if a window of ``size`` words covers it that also starts in a document with a smaller id.
    Windows are judged on the input. Two windows are the same if 96 bits of hashes agree. ``bits`` is the
    width of the sketch (by default from the number of documents); it changes the speed, not the result.

    Null texts have no words. A document without id loses nothing and takes nothing from others; rows with the
    same id do not take from each other.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards, blocks = partitions, partitions
    bits = bits or sketch_bits(docs.count())
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    block = F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")
    dealt = texts.withColumn("block", block).repartition(partitions, "block")
    sketches = dealt.mapInArrow(_sketch(bits, shards, size), KIND)
    repeated = sketches.groupBy("kind", "shard").applyInArrow(_add, KIND)
    named = dealt.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(_name(bits, shards, size), KIND)
    settled = named.groupBy("shard").applyInArrow(_settle, KIND)
    kinds = "id bigint, n_words bigint, n_removed bigint, kept string"
    cleaned = dealt.groupBy("block").cogroup(settled.groupBy("block")).applyInArrow(_clean(size), kinds)
    return cleaned.withColumnRenamed("id", id_col)
