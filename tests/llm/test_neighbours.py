import numpy as np
import pytest

from roadlens.llm.neighbours import CrossPolytopes, calibrated, hadamard, nearest_neighbours, ranked, units

SCHEMA = "vec_id long, embedding array<float>, key string, v int, q string"


def run(spark, rows, **options):
    df = nearest_neighbours(spark.createDataFrame([(i, v, "k", 3, "q") for i, v in rows], SCHEMA).repartition(4), **options)
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def brute(rows, k=10, every=100):
    good = [(i, np.float32(v).astype(float)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = {}
    for i, v in good:
        if i % every == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in good if j != i and len(w) == len(v))[:k]
            if near:
                out[i] = [(j, s) for s, j in near]
    return out


def share(got, want):
    assert set(got) == set(want)
    hit = total = 0
    for q, near in want.items():
        own = dict(got[q])
        assert len(own) == len(got[q]) == len(near)
        assert [(s, i) for i, s in got[q]] == sorted((s, i) for i, s in got[q])
        for i, s in near:
            if i in own:
                assert own[i] == pytest.approx(s, abs=1e-12)
        hit, total = hit + sum(i in own for i, _ in near), total + len(near)
    return hit / total


def rows_of(x):
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize("kind", ["unit", "clusters", "lengths", "copies"])
def test_recall(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((4000, 48))
    if kind == "unit":
        x = units(x)
    elif kind == "clusters":
        x = rng.standard_normal((80, 48))[np.arange(4000) % 80] + 0.2 * x
    elif kind == "lengths":
        x = x * rng.lognormal(0, 1, (4000, 1))
    else:
        x[1000:2400] = x[0] + 0.01 * x[1000:2400]
        x[2400:3000] = x[100]
    rows = rows_of(x)
    got, want = run(spark, rows, every=40, sample=32), brute(rows, every=40)
    assert len(want) == 100 and share(got, want) >= 0.9
    if kind == "copies":  # equal vectors: ties to the smaller id
        assert got[2400] == want[2400] and [s for _, s in got[2400]] == [0.0] * 10


def test_several_levels_blocks_and_salted_join(spark):
    rng = np.random.default_rng(9)
    rows = rows_of(rng.standard_normal((60, 16))[np.arange(3000) % 60] + 0.15 * rng.standard_normal((3000, 16)))
    hashes = CrossPolytopes.of(16, 4, 3000 / 4, 13)
    assert len(hashes.axes) == 2 and hashes.buckets >= 750
    want = brute(rows)
    assert share(run(spark, rows, bucket_rows=4), want) >= 0.9
    assert share(run(spark, rows, bucket_rows=4, broadcast_rows=0), want) >= 0.9
    assert share(run(spark, rows, tables=1, recall=1.0, sample=1000), want) == 1.0


def test_few_probes_still_give_all_candidates(spark):
    rows = rows_of(np.random.default_rng(2).standard_normal((300, 8)))
    got = run(spark, rows, recall=0.05, tables=1, bucket_rows=1, every=50)
    assert all(len(x) == 10 for x in got.values()) and len(got) == 6


def test_calibration_takes_fewer_probes_where_they_suffice(spark):
    rng = np.random.default_rng(4)
    tight = rng.standard_normal((100, 32))[np.arange(2000) % 100] + 0.05 * rng.standard_normal((2000, 32))
    each = {}
    for name, x in (("tight", tight), ("loose", rng.standard_normal((2000, 32)))):
        df = spark.createDataFrame([(i, v) for i, v in rows_of(x)], "vec_id long, v array<double>")
        hashes = CrossPolytopes.of(32, 4, 1, 13)
        _, each[name], found = calibrated(df, df.limit(50).toPandas(), hashes, k=10, recall=0.95, most=1024)
        assert found >= 0.95
    assert each["tight"] <= 3 < each["loose"]


def test_probes_start_at_the_own_bucket_and_reach_all():
    x = units(np.random.default_rng(1).standard_normal((50, 11)))
    for buckets in (1, 200, 3000):
        h = CrossPolytopes.of(11, 3, buckets, 1)
        order = h.probes(x, 10**6)
        assert (order[:, :, 0] == h.codes(x)).all() and order.shape[2] == h.buckets
        assert (np.sort(order, axis=2) == np.arange(h.buckets)).all()
    z = hadamard(np.eye(16))
    assert np.allclose(z @ z.T, np.eye(16)) and np.allclose(np.abs(z), 0.25)


def test_exact_ranking_of_close_large_and_small_vectors():
    rng = np.random.default_rng(3)
    base = rng.standard_normal(20) * 1e6
    y = base + 1e-6 * rng.standard_normal((500, 20))
    y[7] = y[3]
    for scale in (1.0, 1e200, 1e-200):
        i, j, far = ranked(np.array([-1]), y[:1] * scale, np.arange(500), y * scale, 10)
        want = sorted((float(d), n) for n, d in enumerate(np.sqrt((((y[:1] * scale - y * scale) / scale) ** 2).sum(axis=1))))[:10]
        assert list(j) == [n for _, n in want] and np.allclose(far / scale, [d for d, _ in want], rtol=1e-6)


def test_odd_rows(spark):
    assert run(spark, []) == {} and run(spark, [(0, [1.0, 2.0])]) == {} and run(spark, [(1, [1.0]), (2, [2.0])]) == {}
    rng = np.random.default_rng(8)
    rows = rows_of(rng.standard_normal((30, 6))) + [(100, [1.0, 1.0]), (101, [2.0, 2.0]), (200, [3.0])]
    rows += [(300, None), (400, [0.0] * 6), (500, [float("nan")] + [1.0] * 5), (600, [None] + [1.0] * 5), (700, []), (None, [1.0] * 6), (102, [float("inf"), 1.0])]
    want = brute(rows)
    assert set(want) == {0, 100} and share(run(spark, rows), want) == 1.0
    again = run(spark, rows + rows[:5])
    assert again[0] == run(spark, rows)[0]
