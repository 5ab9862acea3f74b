import numpy as np
import pytest

from textloom.llm import vector_codes

from .conftest import rows

SCHEMA = "vec_id long, embedding array<float>, label int, code string, vector string, error int, id int"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, label, "c", "v", 1, 2) for i, v, label in vectors], SCHEMA).repartition(3)


def brute(vectors, parts, entries, rounds=2):
    """Codes, errors and codebooks by full scans in whole numbers."""
    kept = [(i, v, label) for i, v, label in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    points = [[int(np.floor(256 * float(np.float32(x)))) for x in v] for _, v, _ in kept]
    width = len(points[0]) // parts
    cells = np.array(points, object).reshape(len(kept), parts, width)
    books = [[list(c) for c in cells[:entries, p]] for p in range(parts)]
    for r in range(rounds + 1):
        gaps = [[[sum((a - b) ** 2 for a, b in zip(x[p], e)) for e in books[p]] for p in range(parts)] for x in cells]
        codes = [[g.index(min(g)) for g in row] for row in gaps]
        if r < rounds:
            for p in range(parts):
                for k in range(len(books[p])):
                    mine = [x[p] for x, c in zip(cells, codes) if c[p] == k]
                    if mine:
                        books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    errors = [sum(min(g) for g in row) for row in gaps]
    out = sorted(((i, "".join(f"{c:02x}" for c in row), e) for (i, _, _), row, e in zip(kept, codes, errors)), key=repr)
    return out, np.array(books, float)


def drawn(n, size, seed=0, spread=1.0):
    r = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in r.normal(0, spread, size)], int(i) % 3 or None) for i in r.permutation(n)]


@pytest.mark.parametrize("n, size, parts, entries", [(150, 8, 4, 6), (40, 6, 3, 64), (5, 4, 4, 64), (90, 4, 1, 1), (300, 4, 2, 16)])
def test_codes_are_those_of_full_scans(spark, n, size, parts, entries):
    vectors = drawn(n, size)
    coded, books = vector_codes.compress(table(spark, vectors), parts=parts, entries=entries)
    want, want_books = brute(vectors, parts, entries)
    assert rows(coded.select("vec_id", "code", "error")) == want and np.array_equal(books, want_books)


def test_more_rounds_ties_and_unused_entries(spark):
    vectors = [(k, [float(k % 3), 0.0, float(k % 2), 1.0], 1) for k in range(60)]
    for rounds in (0, 1, 5):
        coded, books = vector_codes.compress(table(spark, vectors), parts=2, entries=8, rounds=rounds)
        want, want_books = brute(vectors, 2, 8, rounds)
        assert rows(coded.select("vec_id", "code", "error")) == want and np.array_equal(books, want_books)


def test_odd_vectors(spark):
    odd = [
        (100, None, 1), (101, [None, 1.0, 1.0, 1.0], 1), (102, [float("nan"), 1.0, 1.0, 1.0], 2), (103, [float("inf")] * 4, 2),
        (104, [float("-inf"), 0.0, 0.0, 0.0], None), (None, [0.5, -0.5, 0.25, -0.001], None), (3, [0.0] * 4, 7), (3, [0.0] * 4, 7),
    ]
    vectors = drawn(30, 4) + odd
    coded, books = vector_codes.compress(table(spark, vectors), parts=2, entries=8)
    want, _ = brute([v for v in vectors], 2, 8)
    assert [r[0] for r in rows(coded)] == [w[0] for w in want]
    labelled = vector_codes.with_label_error(coded).collect()
    sums = {}
    for r in labelled:
        sums[r.label] = sums.get(r.label, 0) + r.error
    assert len(labelled) == 33 and all(r.label_error == sums[r.label] for r in labelled)


def test_no_vectors(spark):
    for vectors in ([], [(1, None, 1)]):
        coded, books = vector_codes.compress(table(spark, vectors))
        assert vector_codes.with_label_error(coded).collect() == [] and books.size == 0


def test_refused(spark):
    for vectors in ([(1, [1.0] * 16, 1), (2, [1.0] * 32, 1)], [(1, [1.0] * 15, 1)], [(1, [1e30] * 16, 1)], [(1, [], 1)]):
        with pytest.raises(Exception, match="length|too large"):
            vector_codes.compress(table(spark, vectors))[0].collect()
    with pytest.raises(ValueError, match="one byte"):
        vector_codes.compress(table(spark, []), entries=300)


def test_bounds_spare_scans_and_never_change_a_code():
    """Clustered points: after the first rounds most parts keep their entry without a scan."""
    r = np.random.default_rng(2)
    centres = r.integers(-2_000, 2_000, (4, 16, 3)).astype(float)
    points = np.floor(np.stack([centres[np.arange(4), r.integers(0, 16, 4)] for _ in range(800)]) + r.normal(0, 20, (800, 4, 3)))
    history, state, scanned = [np.ascontiguousarray(points[:16].transpose(1, 0, 2))], (None, None, None), []
    for _ in range(6):
        codes, squares, bounds, stamps, n = vector_codes.assign(points, history, *state)
        full = vector_codes.assign(points, history[-1:], None, None, None)
        assert np.array_equal(codes, full[0]) and np.array_equal(squares, full[1])
        state, scanned = (codes, bounds, stamps), [*scanned, n]
        sums, counts = vector_codes._sums(points, codes, 16)
        means = np.floor_divide(sums, np.maximum(counts, 1)[:, :, None]).astype(float)
        history.append(np.where(counts[:, :, None] > 0, means, history[-1]))
    assert scanned[0] == 3_200 and scanned[-1] < 800


def test_net_displacement_is_tighter_than_drifts():
    there, back = np.zeros((1, 3, 2)), np.zeros((1, 3, 2))
    away = there + np.array([[[9.0, 0], [0, 9.0], [1.0, 0]]])
    assert vector_codes.furthest_others(back, there).max() == 0
    assert vector_codes.furthest_others(away, there).tolist() == [[9, 9, 9]]
