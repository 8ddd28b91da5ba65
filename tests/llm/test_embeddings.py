import numpy as np

from roadlens.llm.embeddings import embedding_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int, c long, v string"


def brute(rows, threshold=0.98):
    def ok(r):
        v = r[1]
        return r[2] is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n, links = len(rows), {}
    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if ok(a) and ok(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.float32(a[1]).astype(float), np.float32(b[1]).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links.setdefault(i, set()).add(j)
                    links.setdefault(j, set()).add(i)
    return links


def planted(seed, groups, each, noise, d=64):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = rng.standard_normal(d)
        for _ in range(each):
            rows.append((len(rows), [float(x) for x in np.float32(base + noise * rng.standard_normal(d))], g % 3))
    return rows


def test_recall_and_precision(spark):
    rows = planted(3, 150, 3, 0.08) + [(10_000 + i, [float(x) for x in np.random.default_rng(i).standard_normal(64)], 1) for i in range(200)]
    got = {r["vec_id"]: r for r in embedding_duplicates(spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA), block=64).collect()}
    want = brute(rows)
    assert all(got[rows[i][0]]["n_links"] <= len(want.get(i, ())) for i in range(len(rows)))
    total = sum(len(x) for x in want.values())
    assert total > 500 and sum(r["n_links"] for r in got.values()) >= 0.97 * total
    assert len(got) == len(rows)


def test_recall_near_the_threshold(spark):
    """Partners at exact cosines from the threshold on, in pairs and in crowds about one vector, among vectors of their own."""
    rng, rows, d = np.random.default_rng(8), [], 64
    unit = lambda x: x / np.linalg.norm(x)
    add = lambda x: rows.append((len(rows), [float(a) for a in np.float32(x)], 1))
    for _ in range(600):
        add(unit(rng.standard_normal(d)))
    starts = {}
    for cosine, each, groups in ((0.9802, 1, 400), (0.985, 1, 300), (0.985, 12, 25)):
        starts[cosine, each] = len(rows)
        for _ in range(groups):
            x = unit(rng.standard_normal(d))
            add(x)
            for _ in range(each):
                side = rng.standard_normal(d)
                add(cosine * x + np.sqrt(1 - cosine**2) * unit(side - (side @ x) * x))
    got = {r["vec_id"]: r["n_links"] for r in embedding_duplicates(spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA)).collect()}
    v = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = (v @ v.T >= 0.98).sum(axis=1) - 1
    edges = [*starts.values(), len(rows)]
    for (cosine, each), a, z in zip(starts, edges, edges[1:]):
        total = want[a:z].sum()
        found = sum(got[i] for i in range(a, z))
        assert total >= 600 and all(got[i] <= want[i] for i in range(a, z)) and found >= 0.98 * total, (cosine, each, found, total)
    assert all(got[i] == 0 for i in range(600))


def test_hot_group_in_blocks_and_odd_rows(spark):
    rows = planted(5, 1, 300, 0.01)
    rows += [(500, rows[0][1], 0), (501, None, 0), (502, [0.0] * 64, 0), (503, [float("nan")] + [1.0] * 63, 0), (504, [None] + [1.0] * 63, 0)]
    rows += [(505, rows[0][1], None), (506, [], 0), (507, rows[0][1][:10], 0), (508, [2 * x for x in rows[0][1]], 0), (509, rows[0][1], 7)]
    want = brute(rows)
    for most in (1_000_000, 0):
        found = embedding_duplicates(spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA), block=32, broadcast_rows=most).collect()
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found}
        for i, r in enumerate(rows):
            n = len(want.get(i, ()))
            assert got[r[0]] == (n, 0 if n else r[0], not n or r[0] == 0), r[0]


def test_empty_table(spark):
    assert embedding_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
