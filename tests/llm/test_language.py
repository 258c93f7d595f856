import numpy as np
from tallylens.llm import language as L

from .conftest import ODD_ROWS


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixed_text_has_both_languages(spark):
    en, fr = "the house of the old man and his wife ", "la maison de la vieille dame et son mari "
    docs = spark.createDataFrame([(k, t * 30, lang) for k, (t, lang) in enumerate([(en, "en"), (fr, "fr")] * 20)], "doc_id long, text string, lang string")
    langs, table = L.fit(L.training_counts(docs))
    got = {r.doc_id: r for r in L.predict(spark.createDataFrame([(1, en * 20 + fr * 12), (2, en * 9), (3, "?! 12"), (4, None)], "doc_id long, text string"), langs, table).collect()}
    assert (got[1].lang_pred, got[1].langs) == ("en", "en,fr") and 0.5 < got[1].score < 0.8
    assert (got[2].lang_pred, got[2].langs, got[2].score) == ("en", "en", 1.0)
    assert got[3].lang_pred == got[4].lang_pred == "und" and got[3].score == got[4].score == 0


def test_infer_equals_plain_em():
    rng = np.random.default_rng(4)
    words = np.log(rng.random((50, 3)) + 1e-3)
    mix, size, best = L.infer(words, np.zeros(50, np.int64), 1)
    w = np.full(3, 1 / 3)
    for _ in range(L.ROUNDS):
        r = np.exp(words) * w
        w = (r / r.sum(1, keepdims=True)).mean(0)
    assert best[0] == w.argmax()
    assert abs(mix.sum() - 1) < 1e-9 and (mix[0] > 0).sum() == size[0]


def test_odd(spark, odd, empty):
    rows = L.identify(odd).collect()
    assert len(rows) == len(ODD_ROWS)
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2)} == {"und"}
    assert L.identify(empty).count() == 0
    assert {r.lang_pred for r in L.identify(odd.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_all_labels_are_learned_and_large_sets_are_found(spark):
    model = L.fit(spark.createDataFrame([(f"l{k:03d}", k, 9) for k in range(300)], "lang string, cell int, n long"))
    assert len(model[0]) == len(model[1]) == 300
    like = np.full((600, 6), -12.0)
    like[np.arange(600), np.arange(600) % 6] = 0.0
    mix, size, _ = L.infer(like, np.zeros(600, np.int64), 1)
    assert size[0] == 6 and np.allclose(mix, 1 / 6)


def test_sets_of_every_size_are_compared():
    """As a plain search over all sizes without any stop, also where a size gains nothing but a larger one does."""
    rng = np.random.default_rng(8)
    words, rows, jumps = [], [], 0
    for doc in range(120):
        k, m = rng.integers(1, 8), rng.integers(1, 90)
        x = rng.normal(-4, 1.5, (m, 7))
        x[np.arange(m), rng.integers(0, k, m)] += rng.choice([1.5, 3, 9])
        words.append(x)
        rows += [doc] * m
    mix, size, best = L.infer(np.concatenate(words), np.array(rows), 121)
    assert size[120] == 1
    for doc, x in enumerate(words):
        like = np.exp(x - x.max(1, keepdims=True))

        def em(w, steps):
            for _ in range(steps):
                share = like * w
                w = (share / share.sum(1, keepdims=True)).mean(0)
            return w

        w = em(np.full(7, 1 / 7), L.ROUNDS)
        order, values, sets = np.argsort(-w, kind="stable"), [], []
        for s in range(1, 8):
            own = np.zeros(7)
            own[order[:s]] = w[order[:s]]
            sets.append(em(own / own.sum(), 3 if s > 1 else 0))
            values.append(np.log((like * sets[-1]).sum(1)).sum() - L.PENALTY * (s - 1) * np.log(max(len(x), 2)))
        want = int(np.argmax(values))
        jumps += want >= 4 or any(b <= a for a, b in zip(values[:want], values[1 : want + 1]))
        assert size[doc] == want + 1 and np.allclose(mix[doc], sets[want])
    assert jumps
