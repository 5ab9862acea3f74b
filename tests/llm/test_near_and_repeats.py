import hashlib
import itertools
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from textloom.llm import golay, simhash, substring_dedup
from textloom.llm.graph import components

from .conftest import rows, sentence


def test_every_word_has_one_centre_within_three():
    words = np.arange(1 << golay.LENGTH, dtype=np.uint32)
    high, error, _ = golay._tables()
    rest = high[words >> np.uint32(11)] ^ (words & np.uint32(2047))
    assert np.bitwise_count(error).max() == 3
    centre = words ^ error[rest]
    again = high[centre >> np.uint32(11)] ^ (centre & np.uint32(2047))
    assert not again.any() and len(np.unique(centre)) == 4096


def test_words_one_bit_apart_meet():
    words = np.random.default_rng(0).integers(0, 1 << 23, 20_000).astype(np.uint32)
    centre = golay.near_codewords(words)[0][:, 0]
    for bit in [0, *(1 << i for i in range(23))]:
        near, there = golay.near_codewords(words ^ np.uint32(bit))
        assert ((near == centre[:, None]) & there).any(axis=1).all()


@settings(deadline=None, max_examples=300)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3))
def test_three_errors_always_share_a_key(value, flips):
    other = value
    for bit in flips:
        other ^= 1 << bit
    cut = [golay.cut64(np.array([x], np.uint64)) for x in (value, other)]
    left, right = (set(golay.keys(c, golay.three_errors(), s)[1].tolist()) for c, s in zip(cut, ("left", "right")))
    assert left & right


def fingerprint(text, size=3):
    found = [0] * 64
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for k in range(64):
            found[k] += h >> k & 1
    return sum(1 << k for k in range(64) if found[k] * 2 > len(shingles))


def smallest_reachable(nodes, linked):
    parent = list(range(len(nodes)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(range(len(nodes)), 2):
        if linked(a, b):
            parent[find(a)] = find(b)
    groups = defaultdict(list)
    for a in range(len(nodes)):
        groups[find(a)].append(nodes[a])
    return [min((x for x in groups[find(a)] if x is not None), default=None) for a in range(len(nodes))]


def test_fingerprint_groups(docs, texts):
    fps = [fingerprint(t) for _, t in texts]
    comps = smallest_reachable([i for i, _ in texts], lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    want = sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(texts, fps, comps)), key=repr)
    assert rows(simhash.fingerprint_groups(docs)) == want


def test_links_between_many_values(spark):
    """Clusters of values a few bits from a centre, and chains of them: no link is lost."""
    r = random.Random(5)
    values = set()
    for _ in range(40):
        centre = r.getrandbits(64)
        for _ in range(15):
            x = centre
            for bit in r.sample(range(64), r.randint(0, 4)):
                x ^= 1 << bit
            values.add(x)
        for step in range(12):
            centre ^= 7 << (3 * step)
            values.add(centre)
    signed = [x - (1 << 64) if x >> 63 else x for x in values]
    got = {tuple(r) for r in simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = {
        (min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 3
    }
    assert got == want


def test_components(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)]
    links += [(2000 + r.randint(0, 30), 2000 + r.randint(0, 30)) for _ in range(20)] + [(5, 4), (7, 7)]
    r.shuffle(links)
    nodes = sorted({x for a, b in links if a != b for x in (a, b)})
    linked = {frozenset(x) for x in links}
    want = smallest_reachable(nodes, lambda a, b: frozenset((nodes[a], nodes[b])) in linked)
    assert dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect())) == dict(zip(nodes, want))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def kept_of(spark, made):
    return {r.doc_id for r in simhash.keep_one(spark.createDataFrame(made, "doc_id long, text string")).collect()}


def test_near_copies_leave_one(docs, texts):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    fps = [fingerprint(t) for _, t in texts]
    comps = smallest_reachable([i for i, _ in texts], lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    want = sorted((i for (i, _), c in zip(texts, comps) if i is None or i == c), key=repr)
    assert sorted((r.doc_id for r in kept.select("doc_id").collect()), key=repr) == want


def test_one_id_of_several_texts(spark):
    """A row goes by its id and its text: another text under the same id stays."""
    base = sentence(41, 60)
    made = [(1, base), (2, base), (2, sentence(42, 60)), (3, base), (3, base)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert rows(simhash.keep_one(df)) == [(1, base), (2, sentence(42, 60))]


def test_string_ids(spark):
    base = sentence(43, 60)
    df = spark.createDataFrame([("b", base), ("a", base), ("c", sentence(44, 50))], "doc_id string, text string")
    assert [r[0] for r in rows(simhash.keep_one(df))] == ["a", "c"]
    assert {(r.doc_id, r.component_id) for r in simhash.fingerprint_groups(df).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}


def test_long_texts_with_a_few_edits(spark):
    """2,000 words, some of them changed: the pairs within three bits, and no other, leave one."""
    r, made = random.Random(9), []
    for i in range(60):
        words = sentence(10_000 + i, 2_000).split()
        made.append((2 * i, " ".join(words)))
        for place in r.sample(range(2_000), i % 6):
            words[place] = "edited"
        made.append((2 * i + 1, " ".join(words)))
    fps = {i: fingerprint(t) for i, t in made}
    near = {i for i in fps if i % 2 and (fps[i] ^ fps[i - 1]).bit_count() <= 3}
    assert len(near) > 20 and kept_of(spark, made) == set(fps) - near


def test_large_group_of_near_copies(spark):
    words = sentence(77, 3_000).split()
    made = [(i, " ".join(words[: i % 290] + [f"w{i}"] + words[i % 290 + 1 :])) for i in range(400)]
    assert kept_of(spark, made) == {0}


def removed(texts, size=13):
    out, windows = [], defaultdict(set)
    split = [(i, (t or "").encode().split()) for i, t in texts]
    for i, words in split:
        for k in range(len(words) - size + 1):
            if i is not None:
                windows[tuple(words[k : k + size])].add(i)
    for i, words in split:
        gone = [False] * len(words)
        for k in range(len(words) - size + 1):
            if i is not None and min(windows[tuple(words[k : k + size])]) < i:
                gone[k : k + size] = [True] * size
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size,bits", [(13, None), (3, 8), (1, 30)])
def test_repeats(docs, texts, size, bits):
    found = substring_dedup.remove_repeats(docs, size=size, bits=bits)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in found.collect()), key=repr)
    assert got == removed(texts, size)


def test_sketches_in_small_parts(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HELD", 50)
    monkeypatch.setattr(substring_dedup, "BYTES_AT_ONCE", 100)
    got = [(r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect()]
    assert sorted(got, key=repr) == sorted(((i, n) for i, _, n, _ in removed(texts)), key=repr)


def test_negative_ids(spark):
    a, b = sentence(1, 20), sentence(2, 20)
    made = spark.createDataFrame([(-5, a), (-7, a + " " + b), (0, b)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(made).collect()}
    assert got == {-7: 0, -5: 20, 0: 20}


def test_windows_that_agree_in_one_hash(monkeypatch):
    """Both hashes decide, also where many windows share the first."""
    real = substring_dedup.window_hashes
    monkeypatch.setattr(substring_dedup, "window_hashes", lambda w, n: (real(w, n)[0] & np.uint64(3), real(w, n)[1]))
    all_listed = [pa.table({"kind": pa.array([k], pa.int32()), "data": [substring_dedup.pack(cells)]}) for k, cells in enumerate(
        (np.arange(4, dtype=np.uint64), np.arange(1 << 16, dtype=np.uint64)))]
    texts = [sentence(1, 200), sentence(2, 200), sentence(1, 200)]
    docs = pa.table({"id": [1, 2, 3], "text": texts, "block": pa.array([0] * 3, pa.int32())})
    monkeypatch.setattr(
        substring_dedup, "counters", lambda a, b, bits: [a & np.uint64(3), substring_dedup._mix(b) >> np.uint64(48)]
    )
    named = substring_dedup._name(16, 1, 13)(docs, pa.concat_tables(all_listed))
    told = substring_dedup._settle(named)
    got = {r["id"]: r["n_removed"] for r in substring_dedup._clean(13)(docs, told).to_pylist()}
    assert got == {1: 0, 2: 0, 3: 200}


@settings(deadline=None, max_examples=200)
@given(st.lists(st.text(st.sampled_from("ab \t\n\r\x0b\x0cé漢\u00a0\x1c"), max_size=30)))
def test_words_are_those_between_ascii_blanks(texts):
    table = pa.table({"text": pa.array(texts, pa.string())})
    known = {}
    for _, _, hashes, starts in substring_dedup._texts(table):
        split = [t.encode().split() for t in texts]
        assert np.diff(starts).tolist() == [len(w) for w in split]
        for word, digest in zip(itertools.chain(*split), hashes.tolist()):
            assert known.setdefault(word, digest) == digest
    assert len(set(known.values())) == len(known)


def test_empty(no_docs):
    assert simhash.fingerprint_groups(no_docs).count() == 0
    assert simhash.keep_one(no_docs).count() == 0
    assert substring_dedup.remove_repeats(no_docs).count() == 0


def test_packed_arrays():
    for values in ([], [0], [5, 6, 2**40, 2**64 - 1], list(range(1000))):
        array, flags = np.array(values, np.uint64), np.array([True] * len(values))
        back = substring_dedup.unpack(substring_dedup.pack(array, flags), "u8", "?")
        assert back[0].tolist() == values and back[1].tolist() == flags.tolist()
