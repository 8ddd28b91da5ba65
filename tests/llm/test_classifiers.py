import random
import zlib

import numpy as np

from roadlens.llm.langid import identify_languages
from roadlens.llm.recurrent import bidirectional, bidirectional_back, init_cell
from roadlens.llm.toxicity import WINDOW, split_windows, toxicity

EN = "the of and to in is that for it was on are with as his they at be this from have or by one had not but what all were".split()
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie".split()


def text(rng, words, n=60):
    return " ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(n))


def test_gradients_like_differences():
    for kind in ("gru", "lstm"):
        rng = np.random.default_rng(0)
        w = {k: v.astype(np.float64) for k, v in (init_cell(rng, kind, 3, 2, "f") | init_cell(rng, kind, 3, 2, "r")).items()}
        x, mask, weight = rng.standard_normal((4, 5, 3)), np.ones((4, 5)), rng.standard_normal((4, 5, 4))
        mask[1, 3:] = 0
        kept = {}
        bidirectional(kind, w, x, mask, kept)
        g, dx = bidirectional_back(kind, w, weight.astype(np.float32), x, mask, kept)
        for name, value in w.items():
            at = tuple(rng.integers(s) for s in value.shape)
            up, down = (bidirectional(kind, w | {name: value + e * (np.indices(value.shape) == np.array(at).reshape(-1, *[1] * value.ndim)).all(axis=0)}, x, mask) for e in (1e-2, -1e-2))
            assert abs(((up - down) * weight).sum() / 2e-2 - g[name][at]) < 0.02 * (1 + abs(g[name][at])), (kind, name)
        up, down = (bidirectional(kind, w, x + e * (np.arange(x.size).reshape(x.shape) == 17), mask) for e in (1e-2, -1e-2))
        assert abs(((up - down) * weight).sum() / 2e-2 - dx.ravel()[17]) < 0.02 * (1 + abs(dx.ravel()[17]))


def test_windows_cover_every_word():
    for n in (0, 1, WINDOW, WINDOW + 1, 500):
        w = split_windows(np.arange(1, n + 1))
        assert set(w.ravel()) - {0} == set(range(1, n + 1)) and w.shape[1] == WINDOW


def test_languages(spark):
    rng = random.Random(4)
    rows = [(i, text(rng, EN if i % 2 else DE), "en" if i % 2 else "de") for i in range(300)]
    rows += [(900, None, "en"), (901, "", "de"), (902, "123 *** 4!", "en"), (903, text(rng, DE, 20_000), None), (None, text(rng, EN), None), (0, rows[0][1], "de")]
    got = identify_languages(spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert all(by[900 + i]["lang_pred"] == "und" for i in range(3)) and by[903]["lang_pred"] == "de" and by[None]["lang_pred"] == "en"
    held = [r for r in got if r["held_out"] and r["doc_id"] < 300]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in held)
    assert np.mean([r["lang_pred"] == ("en" if r["doc_id"] % 2 else "de") for r in held]) > 0.97
    none = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert identify_languages(none).first()["lang_pred"] == "und" and identify_languages(none.limit(0)).count() == 0


def test_toxicity(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(500):
        bad = i % 5 == 0
        words = text(rng, EN, 150).split(" ")
        for _ in range(5 * bad):
            words[rng.randrange(len(words))] = rng.choice(["vileword", "nastything", "crudeterm"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows += [(900, None), (901, ""), (902, text(rng, EN, 5000) + " vileword nastything crudeterm vileword" * 3), (None, "x"), (0, rows[0][1])]
    labels += [(5, 0), (None, 1), (7, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, toxic int")
    got = toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 500]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    assert np.mean([r["predicted"] == (r["doc_id"] % 5 == 0) for r in held]) > 0.97
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r["predicted"] == 0 for r in toxicity(docs.limit(3), empty).collect()) and toxicity(docs.limit(0), empty).count() == 0
