import math

import numpy as np
import pytest

from placebook.llm import vectorcodes as vc


def plain(rows, rounds=4):
    """Codes and errors of (vec_id, vector) rows by all distances, in Python's own integers."""
    rows = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(1024 * x) for x in r[1]] for r in rows]
    width = len(whole[0]) // 4 if whole else 0
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for v in whole[:256]] for p in range(4)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            members = {}
            for v in whole:
                members.setdefault(nearest(part(v, p), books[p])[1], []).append(part(v, p))
            books[p] = [[sum(c) // len(members[e]) for c in zip(*members[e])] if e in members else c for e, c in enumerate(books[p])]
    found = [[nearest(part(v, p), books[p]) for p in range(4)] for v in whole]
    return [(r[0], "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for r, f in zip(rows, found)], books


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


SCHEMA = "vec_id long, embedding array<float>, label int, code string, _label int"


@pytest.mark.parametrize("n, width, scale", [(700, 8, 1.0), (300, 4, 0.004), (40, 12, 3000.0), (1, 4, 1.0)])
def test_codes_equal_plain_ones(spark, n, width, scale):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(9, width)) * scale
    rows = [(int(i * 7 % n), (centres[i % 9] + rng.normal(size=width) * scale * 0.2).astype(np.float32).tolist()) for i in range(n)]
    rows += rows[:30]  # repeated rows
    rows += [(5, None), (6, []), (7, [None] * width), (8, [math.nan] * width), (9, [math.inf] + [0.0] * (width - 1)), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, None if i is None else i % 3, "mine", 1) for i, v in rows], SCHEMA).repartition(3)
    coded, books = vc.compress(df)
    expected, plain_books = plain(rows)
    assert order((r.vec_id, r.code, r.error) for r in coded.collect()) == order(expected)
    assert [book.tolist() for book in books] == plain_books


def test_large_components_are_exact(spark):
    """Beyond the range in which floats are exact the kernels use integers."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-150_000, 150_000, 4) + 0.5).tolist()) for i in range(300)]
    df = spark.createDataFrame([(*r, None) for r in rows], "vec_id long, embedding array<double>, label int")
    coded, _ = vc.compress(df)
    assert order((r.vec_id, r.code, r.error) for r in coded.collect()) == order(plain(rows)[0])
    assert vc.kernel_type(16, 4096) is np.float64 and vc.kernel_type(16, 1 << 25) is np.int64
    with pytest.raises(ValueError):
        vc.kernel_type(16, 1 << 30)


def test_empty_and_uneven_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    coded, books = vc.compress(empty)
    assert vc.with_label_errors(coded).collect() == [] and all(book.size == 0 for book in books)
    none = spark.createDataFrame([(1, None, 1), (2, [], 1)], "vec_id long, embedding array<float>, label int")
    assert vc.compress(none)[0].collect() == []
    with pytest.raises(ValueError):
        vc.compress(spark.createDataFrame([(1, [1.0] * 6, 1)], "vec_id long, embedding array<float>, label int"))
    with pytest.raises(Exception, match="vectors of 4 components and of 8"):
        rows = [(i, [1.0] * 4, 1) for i in range(300)] + [(999, [1.0] * 8, 1)]
        vc.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))


def test_errors_of_labels(spark):
    df = spark.createDataFrame([(1, 5, "00", 3), (2, 5, "00", 4), (3, None, "00", 10), (4, None, "01", 1), (5, 0, "00", 7)], "vec_id long, label int, code string, error long")
    assert {r.vec_id: r.label_error for r in vc.with_label_errors(df).collect()} == {1: 7, 2: 7, 3: 11, 4: 11, 5: 7}
    assert vc.with_label_errors(df).columns == ["vec_id", "label", "code", "error", "label_error"]


def test_a_hilbert_curve_goes_to_neighbours():
    for d, side in ((2, 16), (3, 8), (4, 4)):
        grid = np.stack(np.meshgrid(*[np.arange(side)] * d, indexing="ij"), -1).reshape(-1, d)
        # Eight bits a dimension: whole cells of the coarser grid stay together.
        path = grid[vc.hilbert_order(grid * (256 // side))]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).mean() > 0.99
    same = np.zeros((10, 16), np.int64)
    assert vc.hilbert_order(same).tolist() == list(range(10))
    wide = np.random.default_rng(0).integers(-9, 9, (50, 384))
    assert sorted(vc.hilbert_order(wide)) == list(range(50))


def test_short_lists_lose_no_nearest_entry_and_are_short():
    rng = np.random.default_rng(1)
    points = (rng.normal(size=(4000, 16)) * 40 + rng.integers(0, 5, (4000, 1)) * 300).astype(np.int64)
    blocks = vc.Blocks.of(points)
    book = vc.Codebook(points[:256], int(np.abs(points).max()))
    distances = ((blocks.points[:, None, :] - points[None, :256, :]) ** 2).sum(axis=2)
    lists, start = list(book.short_lists(blocks)), 0
    for able, n in zip(lists, blocks.counts.tolist()):
        assert set(distances[start : start + n].argmin(axis=1)) <= set(able.tolist())
        start += n
    assert np.mean([len(able) for able in lists]) < 128
    codes, sums, errors, counts, _ = book.assign(blocks, errors=True)
    assert (codes == distances.argmin(axis=1)).all() and (errors == distances.min(axis=1)).all()
    assert counts.tolist() == np.bincount(codes, minlength=256).tolist() and sums.sum() == points.sum()
