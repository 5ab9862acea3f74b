"""SentencePiece BPE, encoding and decoding, by vectorised merge rounds on flat numpy arrays.

A text is cut into words at its blanks, since no piece has a blank after another sign. The distinct words of a batch lie
behind each other in one array of symbols. In a round every word finds its least pair rank, and all words merge their
leftmost pairs of that rank at once; then the array is compacted. A word is done when no two neighbours make a piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from textloom.llm.common import text_of

BLANK = "▁"
NEVER = np.int32(np.iinfo(np.int32).max)
#: Characters of a text that are cut into words at a time.
STRETCH = 1 << 20
#: Words that a worker remembers, and characters of the longest one. Others are encoded again; the result is the same.
HELD_WORDS, HELD_LENGTH = 300_000, 64
#: From this many symbols on a word merges, beside its least pairs, all pairs that nothing around them can forestall.
LONG = 32
#: Words that are merged together: their arrays fit the caches of a core.
TOGETHER = 1 << 12
WORD = re.compile(" +[^ ]*")


class _Table:
    """Exact lookup of 64-bit keys: one slot for each by its hash, and a sorted array for keys whose slot is taken."""

    def __init__(self, values: dict[int, int], missing: int):
        self.bits = max(4, 2 + len(values).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, missing, np.int32)
        self.missing = np.int32(missing)
        self.crowded = np.zeros(1 << self.bits, bool)
        keys = np.array(sorted(values), np.int64)
        over = []
        for key, slot in zip(keys.tolist(), self._slot(keys).tolist()):
            if self.slots[slot] < 0:
                self.slots[slot], self.values[slot] = key, values[key]
            else:
                self.crowded[slot] = True
                over.append(key)
        self.over = np.array(over, np.int64)
        self.over_values = np.array([values[k] for k in over], np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        slot = self._slot(wanted)
        hit = self.slots[slot] == wanted
        found = np.where(hit, self.values[slot], self.missing)
        again = np.flatnonzero(self.crowded[slot] & ~hit)
        if len(again):
            at = np.minimum(np.searchsorted(self.over, wanted[again]), len(self.over) - 1)
            found[again] = np.where(self.over[at] == wanted[again], self.over_values[at], self.missing)
        return found


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``starts[i], starts[i] + 1, ...`` of ``lengths[i]`` items each, behind each other."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) if total else starts[:0]
    return np.arange(total, dtype=np.int64) + shift


class Codec:
    """A BPE model with byte fallback, identity normalizer and a blank put before each text; others are refused."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.size = size = model.vocab_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(size)]
        plain = {p: i for i, p in enumerate(pieces) if not special[i]}
        self.bytes = np.full(256, -1, np.int64)
        for i in range(size):
            if model.is_byte(i):
                self.bytes[int(pieces[i][1:-1], 16)] = i
        self.end, self.unknown = model.eos_id(), model.unk_id()
        probe = " a  b\t\né́Ａ ﬁ"
        if (self.bytes < 0).any() or any(map(model.is_unused, range(size))):
            raise ValueError("the model has no byte fallback, or unused pieces")
        if model.normalize(probe) != BLANK + probe.replace(" ", BLANK) or any(BLANK in p.lstrip(BLANK) for p in plain):
            raise ValueError("the model changes its texts, or has pieces of several words")

        # Symbols are ids of pieces, or ``size`` + code point for signs without a piece.
        self.symbol_of = np.arange(0x110000, dtype=np.int64) + size
        for p, i in plain.items():
            if len(p) == 1:
                self.symbol_of[ord(p)] = i
        order = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in plain.values()}, reverse=True))}
        self.rank = np.full(size, NEVER, np.int32)
        made: dict[int, int] = {}
        inside: dict[int, int] = {}
        before: dict[int, int] = {}
        after: dict[int, int] = {}
        self.risky = np.zeros(size, bool)
        self.first, self.last = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for p, i in plain.items():
            self.rank[i] = order[model.get_score(i)]
            self.first[i], self.last[i] = ord(p[0]), ord(p[-1])

        def symbol(part: str) -> int | None:
            return int(self.symbol_of[ord(part)]) if len(part) == 1 else plain.get(part)

        for p, i in plain.items():
            rank = int(self.rank[i])
            for k in range(1, len(p)):
                inside[self._key(ord(p[k - 1]), ord(p[k]))] = 1
                left, right = symbol(p[:k]), symbol(p[k:])
                if left is None or right is None:
                    continue
                made[self._key(left, right)] = i
                key = self._key(left, ord(p[k]))
                after[key] = min(rank, after.get(key, rank))
                key = self._key(right, ord(p[k - 1]))
                before[key] = min(rank, before.get(key, rank))
                # A piece from which a pair of the same or a better rank comes.
                for half in (left, right):
                    if half < size and rank <= self.rank[half]:
                        self.risky[half] = True
        self.made, self.inside = _Table(made, -1), _Table(inside, 0)
        self.before, self.after = _Table(before, int(NEVER)), _Table(after, int(NEVER))
        # Blanks: where they share the worst rank and it is theirs alone, a long run falls into longest pieces from its left.
        longest = max((len(p) for p in plain if p == BLANK * len(p)), default=1)
        worst = {p == BLANK * len(p) for p, i in plain.items() if self.rank[i] == len(order) - 1}
        ranks = {int(self.rank[i]) for p, i in plain.items() if len(p) > 1 and p == BLANK * len(p)}
        self.run = 0
        if worst == {True} and ranks == {len(order) - 1}:
            found = self.merge([BLANK * longest, BLANK * (3 * longest)])[0]
            self.run = longest if set(found.tolist()) == {plain[BLANK * longest]} else 0

        spelled = [p.replace(BLANK, " ").encode() for p in pieces]
        for i in range(size):
            if model.is_byte(i):
                spelled[i] = bytes([int(pieces[i][1:-1], 16)])
            elif model.is_control(i):
                spelled[i] = b""
            elif model.is_unknown(i):
                spelled[i] = " ⁇ ".encode()
        self.is_byte = np.array([model.is_byte(i) for i in range(size)])
        self.is_control = np.array([model.is_control(i) for i in range(size)])
        self.starts_blank = np.array([p.startswith(BLANK) for p in pieces]) & ~self.is_byte & ~self.is_control
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_size = np.array([len(s) for s in spelled], np.int64)
        self.spelled_start = np.cumsum(self.spelled_size) - self.spelled_size
        self.known: dict[str, int] = {}
        self._forget()

    @staticmethod
    def _key(left, right):
        return left * (1 << 22) + right

    def _forget(self) -> None:
        self.known.clear()
        self.ids, self.starts, self.lengths = [], [], []
        self.filled = 0

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece that two neighbours make and its rank."""
        piece = self.made(self._key(left, right))
        return piece, np.where(piece >= 0, self.rank[piece], NEVER)

    def _ends(self, symbols: np.ndarray, table: np.ndarray) -> np.ndarray:
        """First or last code points of symbols."""
        plain = symbols < self.size
        return np.where(plain, table[np.where(plain, symbols, 0)], symbols - self.size)

    def _picked(self, sym, piece, rank, least, starts, lengths, word) -> np.ndarray:
        """The pairs that are merged in this round, by position of their left symbol."""
        at = np.flatnonzero((rank == least[word]) & (rank < NEVER))
        # Of pairs that overlap the left one counts: every other one of a chain.
        begins = np.concatenate(([True], np.diff(at) != 1))
        number = np.arange(len(at))
        at = at[(number - np.maximum.accumulate(np.where(begins, number, 0))) % 2 == 0]
        risky = np.flatnonzero(self.risky[piece[at]])
        if len(risky):
            # A new pair of the same or a better rank comes before the pairs to its right: those wait.
            p = at[risky]
            new = piece[p].astype(np.int64)
            end = (starts + lengths)[word[p]]
            right = np.where(p + 2 < end, sym[np.minimum(p + 2, len(sym) - 1)], -1)
            merged_before = (risky > 0) & (at[risky - 1] == p - 2) & (p - 2 >= starts[word[p]])
            left = np.where(p > starts[word[p]], sym[p - 1], -1)
            left = np.where(merged_before, piece[p - 2], left)
            better = np.minimum(
                np.where(right >= 0, self._pairs(new, right)[1], NEVER), np.where(left >= 0, self._pairs(left, new)[1], NEVER)
            )
            stops = p[better <= self.rank[new]]
            last = np.full(len(starts), len(sym), np.int64)
            np.minimum.at(last, word[stops], stops)
            at = at[at <= last[word[at]]]
        many = lengths >= LONG
        if many.any():
            # Sure pairs: whatever ends before them or starts behind them, no piece over their border has their rank or a
            # better one, and none that they become part of. Two of them never overlap, nor does a least pair.
            may = np.flatnonzero(many[word] & (rank < NEVER) & (rank > least[word]))
            may = may[~self.risky[piece[may]]]
            w = word[may]
            inner = may > starts[w]
            left = self.before(self._key(sym[may], self._ends(sym[may - 1], self.last)))
            over = may + 2 < (starts + lengths)[w]
            right = self.after(self._key(sym[may + 1], self._ends(sym[np.minimum(may + 2, len(sym) - 1)], self.first)))
            free = (~inner | (left > rank[may])) & (~over | (right > rank[may]))
            at = np.union1d(at, may[free])
        return at

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (a blank is U+2581 here), behind each other, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        final = np.full(len(points), -1, np.int64)
        sym, pos = self.symbol_of[points], np.arange(len(points))
        # A word also falls apart between two signs that no piece holds beside each other.
        cut = np.ones(len(points), bool)
        cut[1:] = (np.diff(owner) != 0) | (self.inside(self._key(points[:-1], points[1:])) == 0)
        starts = np.flatnonzero(cut)
        lengths = np.diff(np.append(starts, len(sym)))
        word = np.repeat(np.arange(len(starts)), lengths)
        piece, rank = np.full(len(sym), -1, np.int32), np.full(len(sym), NEVER, np.int32)
        fresh = np.flatnonzero(~cut[1:])
        piece[fresh], rank[fresh] = self._pairs(sym[fresh], sym[fresh + 1])
        while len(sym):
            least = np.minimum.reduceat(rank, starts)
            done = least == NEVER
            finished = int(lengths[done].sum())
            if finished == len(sym):
                final[pos] = sym
                break
            if finished * 3 > len(sym):
                over = done[word]
                final[pos[over]] = sym[over]
                rest = np.flatnonzero(~over)
                sym, pos, piece, rank = sym[rest], pos[rest], piece[rest], rank[rest]
                lengths, least = lengths[~done], least[~done]
                starts = np.cumsum(lengths) - lengths
                word = np.repeat(np.arange(len(lengths)), lengths)
            at = self._picked(sym, piece, rank, least, starts, lengths, word)
            sym[at] = piece[at]
            gone = np.zeros(len(sym), bool)
            gone[at + 1] = True
            touched = np.zeros(len(sym), bool)
            touched[at] = True
            touched[at[at > 0] - 1] = True
            before = at[(at > 1)]
            touched[before[gone[before - 1]] - 2] = True
            keep = np.flatnonzero(~gone)
            lengths = lengths - np.bincount(word[at], minlength=len(lengths))
            sym, pos, piece, rank, word, touched = sym[keep], pos[keep], piece[keep], rank[keep], word[keep], touched[keep]
            starts = np.cumsum(lengths) - lengths
            fresh = np.flatnonzero(touched)
            inner = fresh + 1 < (starts + lengths)[word[fresh]]
            piece[fresh[~inner]], rank[fresh[~inner]] = -1, NEVER
            fresh = fresh[inner]
            piece[fresh], rank[fresh] = self._pairs(sym[fresh], sym[fresh + 1])
        left = np.flatnonzero(final >= 0)
        ids, owner = final[left], owner[left]
        unknown = np.flatnonzero(ids >= self.size)
        if len(unknown):
            spelled = [chr(c).encode() for c in (ids[unknown] - self.size).tolist()]
            times = np.ones(len(ids), np.int64)
            times[unknown] = [len(s) for s in spelled]
            known = ids < self.size
            ids, owner = np.repeat(ids, times), np.repeat(owner, times)
            ids[np.repeat(~known, times)] = self.bytes[np.frombuffer(b"".join(spelled), np.uint8)]
        return ids.astype(np.int32), np.bincount(owner, minlength=len(words))

    def _cut(self, text: str) -> Iterator[list[str]]:
        """Words of a text, by stretches."""
        if not text:
            return
        text = " " + text.replace(BLANK, " ")
        start = 0
        while start < len(text):
            stop = text.find(" ", start + STRETCH)
            # A stretch ends before the blanks of a word, so a run of blanks stays with what follows.
            while stop > 0 and text[stop - 1] == " ":
                stop -= 1
            if stop <= start:
                stop = len(text)
            words = WORD.findall(text, start, stop)
            yield [part for w in words for part in self._runs(w)] if self.run and " " * (2 * self.run) in text else words
            start = stop

    def _runs(self, word: str) -> Iterator[str]:
        """A word without all but the last of its leading runs of blanks, and these runs."""
        blanks = len(word) - len(word.lstrip(" "))
        alone = max(0, blanks - self.run - 1) // self.run
        for _ in range(alone):
            yield " " * self.run
        yield word[alone * self.run :]

    def _learn(self, words: list[str]) -> None:
        if not words:
            return
        parts = [self.merge([w.replace(" ", BLANK) for w in words[k : k + TOGETHER]]) for k in range(0, len(words), TOGETHER)]
        ids, lengths = (np.concatenate(x) for x in zip(*parts))
        begin = np.cumsum(lengths) - lengths + self.filled
        self.ids.append(ids)
        self.lengths.append(lengths)
        self.starts.append(begin)
        first = len(self.starts[0]) if len(self.starts) > 1 else 0
        self.known.update(zip(words, range(first, first + len(words))))
        self.filled += len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts behind each other, with an end id after each, and how many each text has."""
        parts, sizes = [], np.zeros(len(texts), np.int64)
        waiting: list[str] = []
        owners: list[tuple[int, int]] = []

        def flush():
            if not owners:
                return
            if len(self.starts) and len(self.starts[0]) > HELD_WORDS:
                self._forget()
            new = set(waiting).difference(self.known)
            self._learn(list(new))
            ids, starts, lengths = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.ids, self.starts, self.lengths))
            self.ids, self.starts, self.lengths = [ids], [starts], [lengths]
            number = np.fromiter(map(self.known.__getitem__, waiting), np.int64, len(waiting))
            taken = lengths[number]
            flat = ids[_ragged(starts[number], taken)] if len(number) else np.zeros(0, np.int32)
            ends = np.concatenate(([0], np.cumsum(taken)))
            at = 0
            for text, n in owners:
                if n < 0:
                    parts.append(np.array([self.end], np.int32))
                    sizes[text] += 1
                    continue
                part = flat[ends[at] : ends[at + n]]
                parts.append(part)
                sizes[text] += len(part)
                at += n
            for w in new:
                if len(w) > HELD_LENGTH:
                    del self.known[w]
            if len(ids) > 8 * HELD_WORDS:
                self._forget()
            waiting.clear()
            owners.clear()

        for k, text in enumerate(texts):
            for words in self._cut(text):
                waiting.extend(words)
                owners.append((k, len(words)))
                if len(waiting) >= STRETCH // 4:
                    flush()
            owners.append((k, -1))
        flush()
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), sizes

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """Texts of ids that lie behind each other; special ids say nothing, bytes that are no text give U+FFFD."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id that the model does not have")
        taken = self.spelled_size[ids]
        flat = self.spelled[_ragged(self.spelled_start[ids], taken)].tobytes()
        ends = np.concatenate(([0], np.cumsum(taken)))
        texts, at = [], 0
        for n in sizes.tolist():
            mine, data = ids[at : at + n], flat[ends[at] : ends[at + n]]
            said = np.flatnonzero(~self.is_control[mine])
            if len(said) and self.starts_blank[mine[said[0]]]:
                data = data[1:]
            parted = len(said) and said[-1] + 1 != said[0] + len(said) and self.is_byte[mine].any()
            try:
                texts.append(self._mend(mine, len(data)) if parted else data.decode())
            except UnicodeDecodeError:
                texts.append(self._mend(mine, len(data)))
            at += n
        return texts

    def _mend(self, ids: np.ndarray, length: int) -> str:
        """Text of ids with bytes between others: every byte of a run that starts no sign is U+FFFD."""
        out, run = [], bytearray()
        blank = length < int(self.spelled_size[ids].sum())

        def flush():
            start = 0
            while start < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[start : start + n]).decode())
                        start += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    start += 1
            run.clear()

        for i in ids.tolist():
            spelled = self.spelled[self.spelled_start[i] : self.spelled_start[i] + self.spelled_size[i]].tobytes()
            if self.is_byte[i]:
                run += spelled
            else:
                flush()
                out.append(spelled.decode())
        flush()
        return "".join(out)[int(blank) :]


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """The model of a path, once per worker."""
    return Codec(path)


def _in_parts(values: pa.Array, weight: np.ndarray) -> Iterator[slice]:
    """Slices of about STRETCH characters or ids."""
    if len(values):
        turn = np.cumsum(weight) // STRETCH
        edges = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(values)]
        yield from (slice(a, b) for a, b in zip(edges, edges[1:]))


def _encoded(path: str):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)
        for table in tables:
            texts = table.column("text")
            for part in _in_parts(texts, pc.binary_length(texts).to_numpy(zero_copy_only=False)):
                rows = table.slice(part.start, part.stop - part.start)
                ids, sizes = model.encode(rows.column("text").to_pylist())
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
                listed = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([rows.column("id"), listed], names=["id", "ids"])

    return run


def _decoded(path: str):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)
        for table in tables:
            listed = table.column("ids")
            sizes = np.diff(listed.offsets.to_numpy()) if len(listed) else np.zeros(0, np.int64)
            for part in _in_parts(listed, sizes):
                rows = table.slice(part.start, part.stop - part.start)
                mine = rows.column("ids")
                texts = model.decode(mine.flatten().to_numpy(), sizes[part])
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id"), mine, pa.array(texts, pa.string())], names=["id", "ids", "decoded"]
                )

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and ``ids array<int>``, those of the sentencepiece library with an end id.

    ``path`` must name the model on every executor. Null and empty texts have the end id alone. Repeated rows stay, null ids
    stay, and ids keep their type. A text may be of any length; its words are cut and merged by stretches.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(_encoded(path), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: the id, ``ids`` and ``decoded``, the text of the ids as the library has it.

    Null ``ids`` count as none and give the empty text; special ids say nothing; an id that the model does not have, or
    a null among the ids, ends the job.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    whole = F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>"))
    holes = F.exists(whole, lambda i: i.isNull())
    whole = F.when(holes, F.raise_error(F.lit("a null among the ids")).cast("array<int>")).otherwise(whole)
    plain = rows.select(F.col(id_col).alias("id"), whole.alias("ids"))
    made = plain.mapInArrow(_decoded(path), f"id {kind}, ids array<int>, decoded string")
    return made.withColumnRenamed("id", id_col)
