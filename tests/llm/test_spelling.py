import random
import re
import zlib
from collections import Counter

from roadlens.llm.spelling import neighbours, spelling_variants

SCHEMA = "doc_id long, text string, word string, n long, root string"


def brute(rows, every=199, length=6, count=5):
    seen = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    words = {w: n for w, n in seen.items() if len(w) >= length and n >= count}

    def edit(a, b):
        if a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, forms = {}, {}
    for w, n in words.items():
        near = [x for x in words if edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 5 * n else None
        out[w] = len(near)
    result = set()
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        result.add((w, forms[w], root, n, out[w], words.get(forms[w])))
    return result


def found(spark, rows, **options):
    df = spelling_variants(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA), **options)
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def corpus(seed, n=400):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 8))) for _ in range(60)] + ["aaaaaaa", "aaaaaa", "aaaaaaaa", "hÉllowo", "héllowo", "×÷×÷×÷"]
    for w in rng.choices(base, k=120):
        i = rng.randrange(len(w))
        base.append(w[:i] + rng.choice(["", "a", "É", w[i] + "a"]) + w[i + 1 :])
    weights = [rng.choice([1, 2, 8, 40, 250]) for _ in base]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(base, weights)[0] if rng.random() < 0.9 else "AbaBabA" for _ in range(30))
        rows.append((i, text.replace(" ", rng.choice([" ", "\n", "1", "_", "’", "Ā"]))))
    return rows


def test_as_brute_force(spark):
    for seed in range(3):
        rows = corpus(seed)
        want = brute(rows)
        assert len(want) > 60 and any(r[1] for r in want) and any(r[4] > 1 for r in want)
        assert found(spark, rows) == want


def test_many_typos_and_no_typos(spark):
    rows = corpus(7, 200)
    assert found(spark, rows, typo_every=3) == brute(rows, every=3)
    assert found(spark, rows, typo_every=0) == brute(rows, every=10**12)


def test_chain_of_forms(spark):
    words = {"abcdefgh": 5, "abcdefg": 25, "abcdef": 125, "abcdex": 625, "zbcdex": 3125}
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(words.items())]
    got = {r[0]: r for r in found(spark, rows, typo_every=0)}
    assert {r[2] for r in got.values()} == {"zbcdex"} and got["abcdefgh"][1] == "abcdefg" and got["zbcdex"][1] is None


def test_neighbours_counts_a_pair_once(spark):
    got = {r["word"]: (r["n_near"], tuple(r["best"])) for r in neighbours(spark.createDataFrame([("aabb", 3), ("abb", 3), ("aab", 9), ("aacb", 1), ("zzzz", 5)], "word string, n long")).collect()}
    assert got == {"aabb": (3, (9, "aab")), "abb": (2, (9, "aab")), "aab": (3, (3, "aabb")), "aacb": (2, (9, "aab"))}


def test_odd_rows(spark):
    assert found(spark, []) == set()
    rows = [(1, None), (2, ""), (None, "wordword " * 6), (3, "wördword " * 4), (3, "wördword " * 4), (4, "x" * 200_000), (5, "À" * 6 + " \U0001f600 abc")]
    assert found(spark, rows) == brute(rows)
    assert {r[0] for r in found(spark, rows)} == {"wordword", "wördword"}
