import hashlib
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from roadlens.llm.mixing import mixed, rake, rates
from roadlens.llm.substrings import removed_units, without_repeats


def brute(rows, least=8):
    seen, spans_of, several = {}, [], set()
    tie = lambda t: hashlib.md5((t or "").encode()).hexdigest()[:15]
    for row, (i, t) in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, tie(r[1])))):
        t2, at, parts = re.sub(r"([^.!?\s][.!?]) ", "\\1\n", t or ""), 0, []
        for u in t2.split("\n"):
            form = " ".join("".join(c.lower() if c < "\x80" else c for c in x) for x in re.findall(r"[^\x20\x09-\x0D]+", u))
            if form:
                parts.append((at, at + len(u), len(form.split(" ")), form))
            at += len(u) + 1
        spans = set()
        if parts and sum(p[2] for p in parts) < least:
            spans.add((parts[0][0], parts[-1][1], sum(p[2] for p in parts), " ".join(p[3] for p in parts)))
            if len(parts) > 1:
                several.add((row, parts[0][0], parts[-1][1]))
        for a in range(len(parts)):
            for b in range(a, len(parts)):
                n = sum(p[2] for p in parts[a : b + 1])
                if n >= least:
                    inner, outer = n - parts[b][2], n - parts[a][2]  # less the last, less the first
                    if a == b or (parts[a][2] < least and inner < least) or (parts[b][2] < least and outer < least):
                        spans.add((parts[a][0], parts[b][1], n, " ".join(p[3] for p in parts[a : b + 1])))
                        if a < b:
                            several.add((row, parts[a][0], parts[b][1]))
                    if n > 3 * least + 40:
                        break
        for s, e, n, form in sorted(spans):
            seen.setdefault(form, (i, s, e, row))
            spans_of.append((row, i, s, e, n, form))
    # a unit is a run somewhere if its words are those of several lines or sentences in one of its places
    units, first = {}, {}
    for row, i, s, e, n, form in spans_of:
        units.setdefault(form, []).append((row, i, s, e, n))
        first.setdefault(form, (row, s, e))
    meet = lambda one, other: one[0] == other[0] and one[1] < other[2] and other[1] < one[2]
    places = {f: [(x[0], x[2], x[3]) for x in u] for f, u in units.items() if len(u) > 1}
    runs = {f for f, u in places.items() if any(x in several for x in u)}
    by_row = {}
    for f, u in places.items():
        for x in u[1:] if f not in runs else ():
            by_row.setdefault(x[0], []).append(x)
    stay = {f: first[f] for f in places if f not in runs or not any(meet(first[f], g) for g in by_row.get(first[f][0], ()))}
    kept_in = {}
    for x in stay.values():
        kept_in.setdefault(x[0], []).append(x)
    out = []
    for f, k in stay.items():
        for row, i, s, e, n in units[f][1:]:
            if f not in runs or not any(meet((row, s, e), x) for x in kept_in.get(row, ())):
                out.append((i, s, e, n, *seen[f][:3]))
    return sorted(out, key=repr)


def test_removed_units_like_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(50)] + ["É", "straße"]
    sentence = lambda: " ".join(rng.choices(vocab, k=rng.randint(1, 14))) + rng.choice([".", "!", "?", "!!", ""])
    shared = [" ".join(sentence() for _ in range(8)) for _ in range(3)]
    rows = []
    for i in range(80):
        parts = [sentence() for _ in range(6)] + ([rng.choice(shared).upper() if i % 2 else rng.choice(shared)] if i % 3 else [])
        rng.shuffle(parts)
        rows.append((i, "".join(p + rng.choice([" ", "\n", "  ", "\n\n"]) for p in parts)))
    rows += [(200, None), (201, ""), (202, " \n "), (203, rows[1][1]), (None, rows[1][1]), (None, rows[1][1]), (204, (shared[0] + " ") * 300)]
    rows += [(1, rows[1][1]), (2, rows[4][1]), (None, rows[2][1] + " a text of its own at the end of it.")]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, start int, digest int")
    want = brute(rows)
    assert len(want) > 500 and sum(r[0] is None for r in want) > 10
    assert sorted((tuple(r) for r in removed_units(df).collect()), key=repr) == want
    assert sorted((tuple(r) for r in removed_units(df, frequent=5).collect()), key=repr) == want
    named = removed_units(df.selectExpr("concat('d', doc_id) AS doc_id", "text")).collect()  # ids sort as text here
    assert sorted((tuple(r) for r in named), key=repr) == brute([(None if i is None else f"d{i}", t) for i, t in rows])
    unique = df.where("doc_id is not null").dropDuplicates(["doc_id"]).withColumn("removed", F.lit(1)).withColumn("cuts", F.lit(2))
    less = without_repeats(unique)
    texts = {r["doc_id"]: r["text"] for r in less.collect()}
    assert less.columns == ["doc_id", "text", "start", "digest", "cuts", "removed"] and texts[200] is None and texts[0] == rows[0][1] and len(texts[204]) < 200
    assert not removed_units(df.limit(0)).count() and not without_repeats(df.limit(0)).count()


def kept_places_stand(spark, rows):
    """Takes the repeats out of ``rows`` (of unlike ids) and asserts that all that was to be kept is there; returns the texts."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in without_repeats(df).collect()}
    before = dict(rows)
    for r in removed_units(df).collect():
        assert before[r["kept_doc_id"]][r["kept_start"] : r["kept_end"]] in texts[r["kept_doc_id"]]
    return texts


def test_what_is_kept_is_never_cut(spark):
    rng = random.Random(12)
    lines = ["yes", "la la", "da da", "oh no", "one two three", "so it goes on and on"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 60)))) for i in range(60)]
    rows += [(i + 60, t + "\nand more") for i, t in rows[::3]]
    got = kept_places_stand(spark, rows)
    assert sum(len(t) for t in got.values()) < sum(len(t) for _, t in rows)
    twelve, song, long = "\n".join(["yes"] * 12), "\n".join(["la la", "da da"] * 8), "\n".join(["no"] * 40)
    got = kept_places_stand(spark, [(1, twelve), (2, song), (3, long)])
    assert got[1] == twelve and got[2].startswith("la la\nda da\nla la\nda da\nla la\n") and got[3].split() == ["no"] * 8


def test_rows_that_share_an_id_are_cut_by_their_own_offsets(spark):
    a = "one two three four five six seven eight nine ten."
    got = without_repeats(spark.createDataFrame([(1, a), (1, "zero. " + a), (None, a), (None, None), (None, "zero. " + a)], "doc_id long, text string")).collect()
    texts = sorted((r["text"] for r in got if r["text"] is not None), key=len)
    assert len(got) == 5 and sum("nine ten." in t for t in texts) == 1 and sum(len(t) for t in texts) <= len("zero. " + a) + 2 * len("zero. ")


def test_short_texts_are_units_as_a_whole(spark):
    rows = [(1, "A short text, said twice."), (2, "a short  text, said TWICE.\n"), (3, "A short text."), (4, "Said twice."), (5, "  "), (6, "A short text, said twice. And more words follow it here now.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(r["doc_id"], r["kept_doc_id"], r["n_words"]) for r in removed_units(df).collect()] == [(2, 1, 5)]
    assert without_repeats(df).where("doc_id = 2").first()["text"] == ""


def test_passages_of_short_lines_are_found(spark):
    passage = "One two.\nThree.\nFour five six.\nSeven eight nine.\nTen.\nEleven twelve.\nThirteen."
    rows = [(1, f"First words of one text here. {passage} Then something else of its own follows."), (2, f"Other words stand before it in this. {passage} And others come after it."), (3, "Yes. No.")]
    got = without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {1: rows[0][1], 2: "Other words stand before it in this. And others come after it.", 3: "Yes. No."}


def test_rake_meets_marginals():
    rng = np.random.default_rng(1)
    cells = pd.DataFrame([(a, b, rng.integers(1, 1000)) for a in "xyz" for b in "pq"], columns=["a", "b", "tokens"])
    targets = {"a": {"x": 0.2, "y": 0.3, "z": 0.5}, "b": {"p": 0.9, "q": 0.1}}
    w = rake(cells, targets)
    for c, shares in targets.items():
        assert np.allclose(pd.Series(w).groupby(cells[c]).sum().to_dict()[next(iter(shares))], next(iter(shares.values())))
    tokens = cells["tokens"].to_numpy(dtype=float)
    r = rates(tokens, w, 0.4 * tokens.sum())
    assert np.isclose((r * tokens).sum(), 0.4 * tokens.sum()) and r.max() <= 1


def test_mixed(spark):
    rng = random.Random(3)
    rows = [(i, "word " * rng.randint(1, 40), rng.choice(["a", "a", "a", "b", None]), rng.choice(["en", "de"])) for i in range(3000)]
    rows += [(9000, None, "a", "en"), (9001, "", "b", "de"), (None, "x y", "b", "de"), (5, rows[5][1], rows[5][2], rows[5][3])]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, lang string, per_token int")
    got = mixed(df, targets={"lang": {"en": 0.8, "de": 0.2}}).collect()
    assert len(got) == len(rows) and not any(r["kept"] for r in got if not (r["text"] or "").strip())
    assert abs(sum(r["weight"] for r in got) - 1) < 1e-6
    assert abs(sum(r["weight"] for r in got if r["lang"] == "en") - 0.8) < 1e-4
    total, kept = (sum(r["n_tokens"] for r in got if k or r["kept"]) for k in (True, False))
    assert abs(kept / total - 0.5) < 0.04
    by_join = mixed(df, targets={"lang": {"en": 0.8, "de": 0.2}}, collect_rows=0, rounds=12).collect()
    assert np.allclose(sorted(r["probability"] for r in got), sorted(r["probability"] for r in by_join), atol=1e-4)
    assert mixed(df.limit(0)).count() == 0


def test_mixed_on_sparse_cells_by_both_paths(spark):
    rng = random.Random(9)
    langs = ["en", "de", "fr", "es"]
    rows = [(i, "word " * rng.randint(20, 60), f"s{i % 12}", langs[i % 12 % 4] if rng.random() < 0.985 else rng.choice(langs)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    ask = dict(rounds=12, keys={"source": F.col("source"), "lang": F.col("lang")}, targets={"lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}})
    one, other = ({r["doc_id"]: (r["weight"], r["probability"]) for r in mixed(df, collect_rows=n, **ask).collect()} for n in (100_000, 0))
    assert all(np.allclose(one[i], other[i], rtol=1e-5, atol=1e-9) for i in one) and abs(sum(w for w, _ in other.values()) - 1) < 1e-6


def test_values_without_a_target_keep_their_smoothed_share(spark):
    langs = ["en"] * 5 + ["de"] * 3 + ["it", None]
    df = spark.createDataFrame([(i, "word " * 10, "s", langs[i % 10]) for i in range(1000)], "doc_id long, text string, source string, lang string")
    own = {k: (langs.count(k) / 10) ** 0.7 for k in set(langs)}
    rest = {k: own[k] / sum(own.values()) for k in ("it", None)}
    want = rest | {"en": 0.8 * (1 - sum(rest.values())), "de": 0.2 * (1 - sum(rest.values()))}
    for limit in (100_000, 0):
        got = mixed(df, targets={"lang": {"en": 0.8, "de": 0.2}}, collect_rows=limit).collect()
        for k, share in want.items():
            assert abs(sum(r["weight"] for r in got if r["lang"] == k) - share) < 1e-6 and any(r["kept"] for r in got if r["lang"] == k)


def test_mixed_like_brute_force(spark):
    rng = random.Random(12)
    rows = [(i, "word " * rng.randint(0, 30) + rng.choice(["", "under a license", "x = {1};"]), rng.choice(["a", "a", "b", None]), rng.choice(["en", "en", "de", "it"])) for i in range(400)]
    rows += [(None, "x y", "b", "de"), (7, rows[7][1], rows[7][2], rows[7][3])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = sorted(((r["doc_id"], r["n_tokens"], r["weight"], r["probability"], r["kept"]) for r in mixed(df, targets={"lang": {"en": 0.7, "de": 0.3}}).collect()), key=repr)
    kind = lambda t: "licence" if "license" in t else "technical" if "{" in t else "prose"
    cells = [(s, g, kind(t)) for _, t, s, g in rows]
    n = [len(t.split()) for _, t, _, _ in rows]
    total, mass = sum(n), {}
    for c, k in zip(cells, n):
        mass[c] = mass.get(c, 0) + k
    mass = {c: v for c, v in mass.items() if v}
    goals = []
    for axis in range(3):
        own = {}
        for c, v in mass.items():
            own[c[axis]] = own.get(c[axis], 0) + v / total
        own = {x: v**0.7 for x, v in own.items()}
        own = {x: v / sum(own.values()) for x, v in own.items()}
        if axis == 1:
            own = {"it": own["it"], "en": 0.7 * (1 - own["it"]), "de": 0.3 * (1 - own["it"])}
        goals.append(own)
    w = {c: v / total for c, v in mass.items()}
    for _ in range(200):
        for axis, goal in enumerate(goals):
            have = {x: sum(v for c, v in w.items() if c[axis] == x) for x in goal}
            w = {c: v * goal[c[axis]] / have[c[axis]] for c, v in w.items()}
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(mass[c], w[c] * mid) for c in mass) < total / 2 else (low, mid)
    want = []
    for (i, t, _, _), c, k in zip(rows, cells, n):
        p = min(1.0, w[c] * low / mass[c]) if k else 0.0
        draw = int(hashlib.md5(f"mix:{t if i is None else i}".encode()).hexdigest()[:8], 16) / 2**32
        want.append((i, k, k * w[c] / mass[c] if k else 0.0, p, draw < p))
    for x, y in zip(got, sorted(want, key=repr)):
        assert x[:2] == y[:2] and np.allclose(x[2:4], y[2:4], rtol=1e-5, atol=1e-9) and x[4] == y[4]
