import random
import re

import corpus_pipeline
from roadlens.llm.decontaminate import contamination, decontaminated
from roadlens.llm.pii import mask_text
from roadlens.llm.simhash import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORDS = "the of and to in is that for it was on are with as his they at be this from have or by one had not but what all were we when".split()


def brute_contamination(docs, items, span=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            n = min(span, len(v))
            for s in range(len(v) - n + 1 if v else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit.update(range(p, p + n))
                        found.add(str(item))
        out.append((i, len(w), len(hit), len(found), ",".join(sorted(found))))
    return sorted(out, key=repr)


def test_contamination_like_brute_force(spark):
    rng = random.Random(1)
    say = lambda n: " ".join(rng.choices(WORDS + ["É", "naïve", "x1"], k=n))
    items = [(i, say(rng.choice([1, 4, 9, 10, 11, 40]))) for i in range(20)] + [(30, None), (31, " -- "), (2, say(15))]
    items = [x for x in items if len((x[1] or "").split()) != 1]
    docs = []
    for i in range(60):
        parts = [say(rng.randint(0, 60))] + [rng.choice(items)[1] or "" for _ in range(rng.randint(0, 2))] + [say(rng.randint(0, 9))]
        docs.append((i, rng.choice([" ", "-", "\n", ", "]).join(parts).upper() if i % 7 == 0 else " ".join(parts)))
    docs += [(90, None), (91, ""), (92, docs[3][1]), (3, docs[3][1]), (3, "other text"), (None, items[0][1]), (93, "the " * 3000)]
    d = spark.createDataFrame([(*r, 0, "") for r in docs], "doc_id long, text string, th int, window string")
    b = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, size int")
    want = brute_contamination(docs, items)
    assert sum(x[2] > 0 for x in want) > 20
    for limit in (64_000_000, 0):
        got = contamination(d, b, broadcast_bytes=limit).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], ",".join(r["items"])) for r in got), key=repr) == want
        assert all(r["contaminated"] == (r["n_hit"] > 0) for r in got)
    clashing = d.withColumnsRenamed({"th": "d", "window": "row"})
    for limit in (64_000_000, 0):
        left = decontaminated(clashing, b, broadcast_bytes=limit)
        assert left.columns == clashing.columns and left.count() == sum(not x[2] for x in want)
    assert contamination(d.limit(0), b).count() == 0 and contamination(d, b.limit(0)).where("contaminated").count() == 0


def test_stages(spark, tmp_path):
    rng = random.Random(2)
    vocab = [f"{a}{b}" for a in WORDS for b in ("", "ing", "ed", "ly")]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    docs = [(i, say(80) + (" mail me@home.org" if i % 10 == 0 else "")) for i in range(200)]
    toxic = {i for i in range(200) if i % 8 == 1}
    docs = [(i, t + " vileword nastything crudeterm " * 3 if i in toxic else t) for i, t in docs]
    docs += [(300, docs[4][1]), (301, docs[4][1] + " end"), (4, docs[4][1]), (302, None), (303, ""), (304, say(30) + " " + "benchmark passage of more than ten words that a test set holds for itself")]
    rows = [(i, t, ["en", "de"][(i or 0) % 2], f"s{(i or 0) % 3}", len(t or "")) for i, t in docs]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i in toxic)) for i in range(200)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "Benchmark passage of more than ten words that a test set holds")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    d = spark.read.parquet(f"{sf}/documents.parquet")
    tox, dedup, decon, pii, mix = (f for _, f in corpus_pipeline.STAGES)

    kept = tox(spark, d, sf)
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == COLUMNS and not ids & toxic and len(ids) > 0.97 * (205 - len(toxic))

    one = dedup(spark, d, sf)
    components = {r["component_id"] for r in near_duplicates(d).collect()}
    assert one.columns == COLUMNS and sorted(r["doc_id"] for r in one.collect()) == sorted(components)

    clean = decon(spark, d, sf)
    assert clean.columns == COLUMNS and sorted(r["doc_id"] for r in d.collect() if r["doc_id"] != 304) == sorted(r["doc_id"] for r in clean.collect())

    safe = pii(spark, d, sf)
    assert safe.columns == COLUMNS and sorted(map(repr, ((r["doc_id"], r["text"]) for r in safe.collect()))) == sorted(repr((i, mask_text(t))) for i, t in docs)

    mixture = mix(spark, d, sf)
    assert mixture.columns == [*COLUMNS, "n_tokens", "weight", "probability"] and 0 < mixture.count() < 206
    assert 0 < corpus_pipeline.run(spark, sf).count() < 180


def test_edited_copies_leave(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(2000)]
    sets = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    alike = lambda s, t: len(sets(s) & sets(t)) / len(sets(s) | sets(t))
    docs, near, far = [], set(), set()
    for i in range(150):
        w = rng.choices(vocab, k=rng.randint(60, 300))
        e = list(w)
        for _ in range(rng.randint(1, 2 + len(w) // 30)):
            at = rng.randrange(len(e))
            e[at : at + rng.randint(0, 1)] = [rng.choice(vocab)]
        docs += [(i, " ".join(w)), (1000 + i, " ".join(e))]
        (near if alike(docs[-2][1], docs[-1][1]) >= 0.8 else far).add(1000 + i)
    assert len(near) > 60 and len(far) > 15
    base = rng.choices(vocab, k=150)
    for i in range(100):  # a chain: each differs by a word from the one before
        base[rng.randrange(150)] = rng.choice(vocab)
        docs.append((2000 + i, " ".join(base)))
    df = spark.createDataFrame([(*r, "en", "s", 0) for r in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, df, "").collect()}
    assert got >= set(range(150)) | far and len(got & near) <= 0.02 * len(near) and {i for i in got if i >= 2000} == {2000}


def test_stages_on_empty_tables_and_odd_rows(spark, tmp_path):
    sf = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(None, None, None, None, None), (None, "", "en", None, 0), (1, "one two three", None, "s", 13), (1, "one two three", None, "s", 13), (2, " \n ", "en", "s", 3), (3, "x" * 5000 + " y" * 3000, "en", "s", 11000)]
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    kept = {"toxicity": 6, "simhash near-dedup": 3, "benchmark decontamination": 6, "pii": 6}
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, sf)
            assert got.columns == COLUMNS and got.count() == (kept[name] if rows else 0), name
        last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
        assert last.columns == [*COLUMNS, "n_tokens", "weight", "probability"] and {r["doc_id"] for r in last.collect()} <= {1, 3}
