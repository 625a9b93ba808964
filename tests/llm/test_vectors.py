"""Neighbours, codes and centroids of vectors against full searches in plain Python."""

import hashlib
import math
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from leakloom.llm import centroids, codes, lattice, neighbours

DATA = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, label int, embedding array<double>, state int, sums int, cluster int, n int, key int"
LONG = 2**63 - 1


def table(spark, rows, parts=3):
    """Rows (vec_id, label, vector) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], SCHEMA).repartition(parts)


def odd_rows(rng, n, dim):
    """Vectors near a grid, which make ties, among them null, broken, repeated and oversized ones."""
    rows = [(i, i % 3 if i % 7 else None, [float(v) / 64 for v in rng.integers(-2, 3, dim)]) for i in range(n)]
    rows += [(n, 1, None), (n + 1, 1, []), (n + 2, 1, [None] * dim), (n + 3, 1, [math.nan] * dim), (n + 4, 2, [math.inf] + [0.0] * (dim - 1)), (n + 5, 2, [0.5] * (dim - 8))]
    rows += [(3, 0, [-0.01] * dim), (3, 0, [-0.02] * dim), (None, None, [0.02] * dim)] + [(n + 10 + i, 2, [0.25] * dim) for i in range(n // 2)]
    return rows


def usable(rows, dim):
    return [(i, label, v) for i, label, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]


def whole(v, scale):
    return [int(x) * scale if abs(x) > 2**53 else math.floor(x * scale) for x in v]


def nearest(v, book):
    return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(book))


def lloyd(vectors, book, rounds):
    for _ in range(rounds):
        own = defaultdict(list)
        for v in vectors:
            own[nearest(v, book)[1]].append(v)
        book = [[sum(x) // len(own[k]) for x in zip(*own[k])] if k in own else c for k, c in enumerate(book)]
    return book


def plain_clusters(rows):
    rows = [(i, v, whole(v, 64)) for i, _, v in usable(rows, 64)]
    order = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    book = lloyd([w for *_, w in rows], [w for *_, w in order[:16]], 3)
    found = [(i, *nearest(w, book)) for i, _, w in rows]
    inertia = defaultdict(int)
    for _, d, k in found:
        inertia[k] += min(d, LONG)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in book]
    return sorted((-1 if i is None else i, k, min(d, LONG), min(inertia[k], LONG), min(sum(inertia.values()), LONG), names[k]) for i, d, k in found)


def plain_codes(rows, dim):
    rows = sorted([(i, label, v, whole(v, 4096)) for i, label, v in usable(rows, dim)], key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    wide = dim // 8
    books = [lloyd([w[p * wide : (p + 1) * wide] for *_, w in rows], [w[p * wide : (p + 1) * wide] for *_, w in rows[:16]], 6) for p in range(8)]
    found, errors = [], defaultdict(int)
    for i, label, _, w in rows:
        near = [nearest(w[p * wide : (p + 1) * wide], books[p]) for p in range(8)]
        found.append((-1 if i is None else i, "".join(f"{k:02x}" for _, k in near), min(sum(d for d, _ in near), LONG), label))
        errors[label] += found[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((i, code, e, min(errors[label], LONG), digest) for i, code, e, label in found)


def clusters_of(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def codes_of(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def test_clusters_of_odd_rows(spark):
    rows = odd_rows(np.random.default_rng(1), 120, 64)
    assert clusters_of(centroids.cluster(table(spark, rows))) == plain_clusters(rows)


def test_clusters_of_huge_and_few_vectors(spark):
    rows = [(i, 0, [float(i * 10**k) for k in range(-10, 54)]) for i in range(5)] + [(9, 0, [1e308] * 64), (10, 0, [-1e308] * 64)]
    assert clusters_of(centroids.cluster(table(spark, rows))) == plain_clusters(rows)


def test_codes_of_odd_rows(spark):
    rows = odd_rows(np.random.default_rng(2), 120, 16)
    assert codes_of(codes.compress(table(spark, rows))) == plain_codes(rows, 16)


def test_codes_of_huge_and_few_vectors(spark):
    rows = [(i, 0, [float(i * 10**k) for k in range(-8, 8)]) for i in range(5)] + [(9, None, [1e308] * 16), (10, 0, [-1e308] * 16)]
    assert codes_of(codes.compress(table(spark, rows))) == plain_codes(rows, 16)


def test_whole_tables(spark):
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r.vec_id, r.label, r.embedding) for r in vectors.collect()]
    assert clusters_of(centroids.cluster(vectors)) == plain_clusters(rows)
    assert codes_of(codes.compress(vectors)) == plain_codes(rows, 64)


def test_empty_tables(spark):
    empty = table(spark, [(1, 1, None)])
    for df in (centroids.cluster(empty), codes.compress(empty), neighbours.search(empty)):
        assert df.collect() == []


def test_partial_distances_equal_full_ones_and_stop_early():
    rng = np.random.default_rng(3)
    book = rng.integers(-900, 900, (16, 64))
    x = book[rng.integers(0, 16, 500)] + rng.integers(-40, 40, (500, 64))
    order = np.argsort(-x.var(0), kind="stable")
    own, d, looked = centroids.nearest(x, book, order)
    full = ((x[:, None] - book[None]) ** 2).sum(2)
    assert (own == full.argmin(1)).all() and (d == full.min(1)).all()
    assert looked < 0.3 * x.size * 16


def test_bounds_spare_distances_and_never_decide_ties():
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, (3000, 8)) + 40 * rng.integers(0, 2, (3000, 1))
    book = lattice.array_of(x[:16].tolist())
    groups, entry, low, computed = codes.grouped(book), np.zeros(len(x), int), np.full((len(x), codes.GROUPS), -np.inf), []
    low = low[:, : len(groups)]
    for _ in range(6):
        entry, d, low, n = codes.reassign(x, book, groups, entry, low)
        full = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (entry == full.argmin(1)).all() and (d == full.min(1)).all()
        computed.append(n)
        new = np.array([x[entry == k].sum(0) // (entry == k).sum() if (entry == k).any() else book[k] for k in range(16)])
        low = low - codes.drifts(book, new, groups)
        book = new
    assert computed[-1] < 0.7 * computed[0]


def test_digits():
    for values in ([0, -1, 5], [2**39, -(2**39) - 1], [10**60, -(10**61), 7]):
        back = [0] * len(values)
        for place, own in lattice.digits(values):
            assert all(abs(v) < 1 << lattice.DIGIT for v in own)
            back = [a + (b << lattice.DIGIT * place) for a, b in zip(back, own)]
        assert back == values


def plain_neighbours(rows, every=50):
    rows = [(i, v) for i, _, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = [np.array(v) / max(map(abs, v)) for _, v in rows]
    out = []
    for q, (i, _) in enumerate(rows):
        if i is not None and i % every == 0:
            own = sorted((-float(unit[q] @ u / np.sqrt(u @ u) / np.sqrt(unit[q] @ unit[q])), math.inf if j is None else j) for k, ((j, _), u) in enumerate(zip(rows, unit)) if k != q and len(u) == len(unit[q]))
            out.append((i, own[:5]))
    return out


def neighbours_of(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.query_id].append((r["rank"], r.vec_id, r.score))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_whole_tables(spark, folder):
    vectors = spark.read.parquet(f"{Path(DATA).parent}/{folder}/embeddings.parquet")
    truth = plain_neighbours([(r.vec_id, r.label, r.embedding) for r in vectors.collect()])
    got = neighbours_of(neighbours.search(vectors))
    assert set(got) == {i for i, _ in truth}
    hits = 0
    for i, own in truth:
        assert [k for k, *_ in got[i]] == [1, 2, 3, 4, 5]
        assert all(a >= b - 1e-15 for (*_, a), (*_, b) in zip(got[i], got[i][1:]))
        score = {j: -s for s, j in own}
        for _, j, s in got[i]:
            hits += j in score
            assert j not in score or abs(s - score[j]) < 1e-12
    assert hits >= 0.93 * 5 * len(truth)


def test_neighbours_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 0, rng.standard_normal(12).tolist()) for i in range(1, 90)]
    rows += [(100 + i, 0, [1.0, 2.0, 3.0] + [0.0] * 9) for i in range(60)] + [(None, 0, [1.0, 2.0, 3.0] + [0.0] * 9)]
    rows += [(200, 0, None), (250, 0, []), (300, 0, [0.0] * 12), (350, 0, [math.nan] * 12), (400, 0, [None] * 12), (450, 0, [1e300] * 12), (451, 0, [1e-300] * 12), (500, 0, [3.0, 4.0]), (501, 0, [4.0, 3.0]), (550, 0, [5.0])]
    got = neighbours_of(neighbours.search(table(spark, rows)))
    # 50 has other vectors only; 100 and 150 are among equal ones, which come by id without themselves.
    assert [j for _, j, _ in got[100]] == [101, 102, 103, 104, 105]
    assert [j for _, j, _ in got[150]] == [100, 101, 102, 103, 104]
    assert got[450][0][1] == 451 and abs(got[450][0][2] - 1) < 1e-12
    assert [(j, round(s, 6)) for _, j, s in got[500]] == [(501, 0.96)]
    assert set(got) == {50, 100, 150, 450, 500}
    assert len(got[50]) == 5


def test_a_repeated_query_is_a_row_of_its_own(spark):
    rows = [(50, 0, [1.0, 0.0]), (50, 0, [1.0, 0.0]), (None, 0, [1.0, 0.0]), (7, 0, [1.0, 1.0])]
    got = neighbours_of(neighbours.search(table(spark, rows)))[50]
    assert [(k, j) for k, j, _ in got] == [(1, 50), (1, 50), (2, None), (2, None), (3, 7), (3, 7)]


def test_chunks_of_a_crowded_bucket(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK", 16)
    rng = np.random.default_rng(6)
    rows = [(i, 0, (np.eye(8)[0] + 0.001 * rng.standard_normal(8)).tolist()) for i in range(200)]
    got = neighbours_of(neighbours.search(table(spark, rows)))
    for i, own in plain_neighbours(rows):
        assert len({j for _, j in own} & {j for _, j, _ in got[i]}) >= 4


def test_probes_come_in_order_and_hold_the_own_bucket():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((40, 20))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for axes in ((4,), (32, 8)):
        own = neighbours.probes(x, 1, axes, 50)
        assert (own[:, 0] == neighbours.buckets(x, 1, axes)).all()
        near = [neighbours.turned(x, 1, k, a) for k, a in enumerate(axes)]
        sums = near[0] if len(near) == 1 else (near[0][:, :, None] + near[1][:, None]).reshape(40, -1)
        assert np.allclose(np.take_along_axis(sums, own, 1), -np.sort(-sums, 1)[:, :50])


def test_pseudo_rotations_keep_angles():
    x = np.random.default_rng(8).standard_normal((5, 64))
    y = neighbours.turned(x, 0, 0, 64)[:, :64]
    assert np.allclose(x @ x.T, y @ y.T)
