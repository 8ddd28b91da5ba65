import random
import re

import numpy as np
import xxhash

from roadlens.llm.common import roots_of
from roadlens.llm.simhash import deduplicated, gray_links, near_duplicates, nearest_forest, parity_bits, prefix_pairs, shingle_set, similar_fingerprints, simhash


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    ids, prints = [r[0] for r in rows], [brute_print(r[1]) for r in rows]
    comp = list(range(len(rows)))
    for _ in rows:
        new = [min(comp[j] for j in range(len(rows)) if bin(prints[i] ^ prints[j]).count("1") <= 2) for i in range(len(rows))]
        if new == comp:
            break
        comp = new
    least = {}
    for i, c in enumerate(comp):
        if ids[i] is not None:
            least[c] = min(least.get(c, ids[i]), ids[i])
    return sorted(((i, f"{p:016x}", least.get(c)) for i, p, c in zip(ids, prints, comp)), key=repr)


def test_gray_links_finds_each_close_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = [b ^ (np.uint64(1) << np.uint64(rng.integers(64))) ^ (np.uint64(1) << np.uint64(rng.integers(64))) for b in base for _ in range(9)]
    x = np.unique(np.r_[base, np.array(flips, dtype=np.uint64)])
    a, b = gray_links(x, 2)
    want = {frozenset((int(p), int(q))) for i, p in enumerate(x) for q in x[i + 1 :] if int(p ^ q).bit_count() <= 2}
    assert len(a) == len(want) and set(map(frozenset, zip(a.tolist(), b.tolist()))) == want


def test_ranges_of_the_gray_order(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 1500, dtype=np.uint64)
    flips = [b ^ (np.uint64(1) << np.uint64(rng.integers(64))) ^ (np.uint64(1) << np.uint64(rng.integers(64))) for b in base for _ in range(3)]
    x = np.unique(np.r_[base, np.array(flips, dtype=np.uint64), np.uint64(0), ~np.uint64(0)])
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    want = roots_of(len(x), *(np.searchsorted(x, v) for v in gray_links(x, 2)))
    for members, ranges in ((65_536, 1), (300, 1), (65_536, 64)):
        got = [(r["a"], r["b"]) for r in similar_fingerprints(df, 2, members, ranges, 50).collect()]
        ends = np.array(got, dtype=np.int64).view(np.uint64)
        assert (roots_of(len(x), np.searchsorted(x, ends[:, 0]), np.searchsorted(x, ends[:, 1])) == want).all()


def test_near_duplicates_like_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(300)] + ["Über", "É", "A"]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 2, 3, 40, 200])))) for i in range(60)]
    for i in range(60, 160):
        w = rng.choice(rows)[1].split(" ")
        w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, rows[5][1]), (5, rows[5][1]), (None, rows[5][1]), (None, "only here " * 30), (204, "x " * 30000)]
    df = spark.createDataFrame([(a, b, 0, "z") for a, b in rows], "doc_id long, text string, fp long, node string")
    got = sorted((tuple(r) for r in near_duplicates(df).collect()), key=repr)
    assert got == brute(rows)
    assert simhash("x " * 30000) == brute_print("x " * 30000)


def test_forest_without_a_list_of_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, (6, 4), dtype=np.uint64)
    words = np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, (80, 4), dtype=np.uint64)) for b in base])
    group = np.repeat(np.arange(240), 2)
    a, b = nearest_forest(words, group, 10, cells=5000)
    d = np.bitwise_count(words[:, None] ^ words).sum(axis=2)
    i, j = np.nonzero(d <= 10)
    want = roots_of(len(words), np.r_[i, np.arange(0, 480, 2)], np.r_[j, np.arange(1, 480, 2)])
    assert (roots_of(len(words), np.r_[a, np.arange(0, 480, 2)], np.r_[b, np.arange(1, 480, 2)]) == want).all() and (d[a, b] <= 10).all() and len(a) < 2 * 240


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(3000)]
    base, rows = rng.choices(vocab, k=150), []
    for i in range(600):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(150)] = rng.choice(vocab)
        rows.append((i, " ".join(w), 1, 2))
    rows += [(1000 + i, " ".join(rng.choices(vocab, k=120)), 1, 2) for i in range(200)]
    got = deduplicated(spark.createDataFrame(rows, "doc_id long, text string, _d int, _t int"))
    assert got.columns == ["doc_id", "text", "_d", "_t"] and {r["doc_id"] for r in got.collect()} == {0} | set(range(1000, 1200))


def test_all_links_at_the_threshold(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(5000)]
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    alike = lambda v, w: len(sets(v) & sets(w)) / len(sets(v) | sets(w))
    rows, near = [], set()
    while len(near) < 1500:
        w = rng.choices(vocab, k=rng.randint(20, 120))
        e = list(w)
        for _ in range(rng.randint(1, 3)):
            e[rng.randrange(len(e))] = rng.choice(vocab)
        cut = rng.randint(0, 20)
        e = e[: len(e) - cut]
        if len(e) > 5 and 0.8 <= alike(w, e) < 0.83:
            i = len(near)
            near.add(10_000 + i)
            rows += [(i, " ".join(w)), (10_000 + i, " ".join(e))]
    got = {r["doc_id"] for r in deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set(range(1500))


def test_links_by_first_shingles(spark):
    rng = random.Random(9)
    vocab, common = [f"w{i}" for i in range(400)], " ".join(f"c{i}" for i in range(60))
    texts = [" ".join(rng.choices(vocab, k=rng.randint(1, 40))) for _ in range(80)] + [f"{common} {rng.choice(vocab)}" + f" {rng.choice(vocab)}" * rng.randint(1, 14) for _ in range(120)]
    for t in rng.choices(texts, k=150):
        w = t.split(" ")
        w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w[: len(w) - rng.randint(0, 3)]))
    sets = {t: shingle_set(t) for t in texts}
    keys = {t: int(np.int64(i + 1)) * 7_919 - 1_000_000 for i, t in enumerate(sets)}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(sets)], "doc_id long, text string")
    group = {t: keys[t] for t in sets} | {t: -5 for t in list(sets)[90:100]}
    rows = [(keys[t], group[t], i, len(s), bytearray(parity_bits(s)), t) for i, (t, s) in enumerate(sets.items())]
    grouped = spark.createDataFrame(rows, "sh long, g long, i long, n long, bits binary, t string").selectExpr("sh", "g", "n", "bits", "named_struct('doc_id', i, 'th', xxhash64(t)) as least")
    similar = lambda s, t: len(np.intersect1d(s, t)) >= 0.8 * len(np.union1d(s, t)) - 1e-9
    want = {tuple(sorted((keys[s], keys[t]))) for s in sets for t in sets if keys[s] < keys[t] and group[s] != group[t] and similar(sets[s], sets[t])}
    assert len(want) > 150
    for members, least in ((2048, 8), (16, 1)):  # with one unit for a shingle, with blocks of it
        got = [(r["a"], r["b"]) for r in prefix_pairs(grouped, docs, "doc_id", "text", 5, 0.8, members=members, sampled=1, least=least).collect()]
        assert len(got) == len(set(got)) and set(got) >= want and all(a < b for a, b in got)


def test_near_copies_below_the_threshold_make_few_pairs(spark):
    rng = random.Random(10)
    vocab = [f"w{i}" for i in range(5000)]
    base, texts = rng.choices(vocab, k=150), []
    for i in range(300):
        w = list(base)
        for at in rng.sample(range(5, 145), 4 if i < 280 else 1):
            w[at] = rng.choice(vocab)
        texts.append(" ".join(w))
    sets = [shingle_set(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [(i, len(s), bytearray(8), t) for i, (s, t) in enumerate(zip(sets, texts))]  # bits that rule nothing out
    grouped = spark.createDataFrame(rows, "i long, n long, bits binary, t string").selectExpr("i + 1 as sh", "i + 1 as g", "n", "bits", "named_struct('doc_id', i, 'th', xxhash64(t)) as least")
    want = {(i + 1, j + 1) for i in range(300) for j in range(i + 1, 300) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9}
    for members, least in ((2048, 8), (16, 1)):
        got = {(r["a"], r["b"]) for r in prefix_pairs(grouped, docs, "doc_id", "text", 5, 0.8, members=members, sampled=1, least=least).collect()}
        assert want and got >= want and len(got) < 2 * len(want) + 1000, (len(got), len(want))


def test_empty_table(spark):
    assert deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
