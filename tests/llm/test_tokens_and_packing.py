import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from textloom.llm import packing, token_counts

from .conftest import rows

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
SPLITTER, WORD_IDS = token_counts.Splitter(BYTES), packing.WordIds(WORDS)


@pytest.mark.parametrize("common", [token_counts.COMMON, 20, 0])
def test_counts_equal_the_library(docs, texts, common):
    tokenizer = Tokenizer.from_file(BYTES)
    want = []
    for i, t in texts:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert rows(token_counts.token_counts(docs, BYTES, common=common)) == sorted(want, key=repr)


def test_pre_tokens_are_counted_once(docs):
    pieces = token_counts.piece_table(docs, BYTES).collect()
    assert len({r.piece for r in pieces}) == len(pieces)


ODD = st.lists(
    st.sampled_from([*"aBé1'.<|>\n\t\r\x0b\x0c\x1c\x85\u00a0\u2028\u3000\u0301漢", "<|endoftext|>", " ", " ", "  ", "'ll", " w.", "\nx", "ab"]),
    max_size=20,
).map("".join)


@settings(deadline=None, max_examples=150)
@given(ODD)
def test_chunks_and_words_cut_where_tokens_end(text):
    tokenizer, splitter = Tokenizer.from_file(BYTES), SPLITTER
    special, chunks, pieces = splitter.chunks(text)
    n = special + sum(splitter.size(p) for p in [*pieces, *(p for c in chunks for p in splitter.pieces(c))])
    assert n == len(tokenizer.encode(text, add_special_tokens=False).ids)
    data = b"".join(map(WORD_IDS.__getitem__, text.encode().split()))
    assert np.frombuffer(data, "<u4").tolist() == WORD_IDS.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("limit", [2048, 7])
def test_packing(docs, texts, limit):
    tokenizer = Tokenizer.from_file(WORDS)
    want = []
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), limit)):
            part = ids[at : at + limit]
            want.append((i, k, at, len(part), zlib.crc32(part.tobytes())))
    found = packing.pack(docs, WORDS, limit=limit).collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == sorted(want, key=repr)
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit


def test_empty(no_docs):
    assert token_counts.token_counts(no_docs, BYTES).count() == 0
    assert packing.pack(no_docs, WORDS).count() == 0


def best_fit_decreasing(lengths, limit):
    rooms, n = [0] * (limit + 1), 0
    for length in sorted(lengths, reverse=True):
        room = next((r for r in range(length, limit + 1) if rooms[r]), None)
        if room is None:
            n, room = n + 1, limit
        else:
            rooms[room] -= 1
        rooms[room - length] += 1
    return n


def lengths_of(kinds):
    total = Counter()
    for kind, n in kinds.items():
        for length in kind:
            total[length] += n
    return total


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=300))
def test_plan_places_every_length(lengths):
    kinds = packing.plan_bins(dict(Counter(lengths)), 64)
    assert lengths_of(kinds) == Counter(lengths)
    assert all(sum(kind) <= 64 for kind in kinds)


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_as_good_as_best_fit_decreasing(seed):
    r = np.random.default_rng(seed)
    shapes = [r.lognormal(6, 1, 20_000), r.uniform(1, 2048, 9_000), r.uniform(500, 1100, 9_000), r.uniform(700, 2048, 9_000)]
    lengths = np.clip(shapes[seed], 1, 2048).astype(int).tolist()
    kinds = packing.plan_bins(dict(Counter(lengths)))
    assert sum(kinds.values()) <= best_fit_decreasing(lengths, 2048)


def test_rounded_groups_have_equal_cardinality():
    counts = {x: 10 for x in range(100, 200)}
    groups = packing._groups(counts, list(counts), 10)
    assert len(groups) == 10 and all(len(g) == 10 and max(g) == top for top, g in groups.items())


def test_lengths_are_rounded_to_few_sizes(monkeypatch):
    seen, whole = [], packing._optimised
    monkeypatch.setattr(packing, "_optimised", lambda demand, limit: seen.append(demand) or whole(demand, limit))
    counts = dict(Counter(np.random.default_rng(7).integers(400, 1400, 20_000).tolist()))
    kinds = packing.plan_bins(counts)
    assert lengths_of(kinds) == Counter(counts) and len(counts) > 900
    assert seen and all(len(demand) <= packing.GROUPS for demand in seen)
    large = {x: n for x, n in counts.items() if x * packing.LARGE[0] > packing.LIMIT}
    assert sum(seen[0].values()) == sum(large.values()) and set(seen[0]) <= set(large) and len(large) > 800
    assert sum(kinds.values()) <= 1.005 * sum(x * n for x, n in counts.items()) / 2048


@settings(deadline=None, max_examples=60)
@given(st.dictionaries(st.integers(5, 64), st.integers(1, 200), max_size=12))
def test_configurations_are_optimised(demand):
    """All demand and no more is placed, in no more sequences than one size after another, and near the least that can do."""
    found = packing._optimised(demand, 64)
    assert lengths_of({tuple(sizes) + (0,) * k: n for k, (sizes, n) in enumerate(found)}) - Counter({0: 10**9}) == Counter(demand)
    assert all(sum(sizes) <= 64 and n > 0 for sizes, n in found)
    bound = -(-sum(s * n for s, n in demand.items()) // 64)
    alone = sum(-(-n // (64 // s)) for s, n in demand.items())
    assert bound <= sum(n for _, n in found) <= alone + 1


def test_optimised_beats_one_after_another():
    """Sizes of which the fullest sequence of the largest first wastes what others need."""
    demand = {45: 97, 36: 610, 31: 395, 14: 211}
    greedy = sum(n for _, n in packing._configurations(demand, 100))
    assert sum(n for _, n in packing._optimised(demand, 100)) <= min(greedy, 454)


def test_most_worth_by_brute_force():
    r = np.random.default_rng(3)
    for _ in range(50):
        sizes = sorted({int(x) for x in r.integers(3, 20, 4)}, reverse=True)
        worth = r.uniform(-0.1, 1, len(sizes))
        value, taken = packing._most_worth(sizes, worth, 40)

        def best(k, room):
            if k == len(sizes):
                return 0.0
            return max(n * worth[k] + best(k + 1, room - n * sizes[k]) for n in range(room // sizes[k] + 1))

        assert value == pytest.approx(best(0, 40)) and sum(t * s for t, s in zip(taken, sizes)) <= 40
