import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from kpishift.llm.language import languages, ngrams
from kpishift.llm.quality import N_FEATURES, isotonic, quality_scores, statistics
from kpishift.llm.toxicity import Machine, toxicity_scores, train

from .conftest import CLASHING


def held_out(i, modulus, kept_out):
    return i is not None and zlib.crc32(str(i).encode()) % modulus == kept_out


def labels_of(spark, rows, name):
    return spark.createDataFrame(rows, f"doc_id long, {name} int").withColumn("text", F.lit("x"))


def test_machine_learns_a_pair_of_terms():
    r = np.random.default_rng(0)
    x = (r.random((4000, 6)) < 0.4).astype(np.uint8)
    y = (x[:, 0] & x[:, 1]).astype(float)  # toxic only together: no linear weight can say so
    rows, terms = np.nonzero(x)
    model = train(rows, terms, y, np.zeros(8), epochs=60)
    p = model.score(rows, terms, len(x))
    assert ((p >= 0.5) == (y == 1)).mean() > 0.99
    alone = model.score(np.array([0, 1]), np.array([0, 1]), 2)
    both = model.score(np.array([0, 0]), np.array([0, 1]), 1)
    assert alone.max() < 0.5 < both[0]


def test_toxicity(spark, docs_of, prose):
    r = random.Random(1)
    texts, rows = [], []
    for i in range(900):
        t = prose(i, r.randrange(5, 60))
        bad = i % 9 == 0
        if bad:
            t = t.replace(" ", f" {r.choice(['Scum', 'LOSER', 'verdreckt'])} ", 1)
        texts.append(t)
        rows.append((i, int(bad)))
    texts += [None, "", "word " * 20_000, "you scum " * 3]
    docs = docs_of(texts, extra=CLASHING)
    got = {x.doc_id: x for x in toxicity_scores(docs, labels_of(spark, [*rows, (None, 1), (5, None), (7, 0)], "toxic")).collect()}
    assert len(got) == len(texts) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got.values())
    assert all(x.held_out == held_out(i, 4, 2) for i, x in got.items())
    out = [(got[i].predicted, y) for i, y in rows if got[i].held_out]
    assert sum(p == y for p, y in out) >= 0.97 * len(out) and any(y for _, y in out)
    assert got[len(texts) - 1].predicted == 1 and got[len(texts) - 2].predicted == 0
    assert abs(got[len(texts) - 4].score - got[len(texts) - 3].score) < 1e-9
    # labels of the held-out fold change nothing
    other = [(i, 1 - y if held_out(i, 4, 2) else y) for i, y in rows]
    again = {x.doc_id: x.score for x in toxicity_scores(docs, labels_of(spark, other, "toxic")).collect()}
    assert all(abs(again[i] - x.score) < 1e-9 for i, x in got.items())


def test_toxicity_of_exactly_one_of_two_terms(spark, docs_of, prose):
    """Each term alone says nothing of the label."""
    texts = [" ".join([*prose(i, 8).split(" "), *["alpha"] * (i % 2), *["beta"] * (i // 2 % 2)]) for i in range(1600)]
    rows = [(i, i % 2 ^ i // 2 % 2) for i in range(1600)]
    got = {x.doc_id: x for x in toxicity_scores(docs_of(texts), labels_of(spark, rows, "toxic")).collect()}
    out = [(got[i].predicted, y) for i, y in rows if got[i].held_out]
    assert sum(p == y for p, y in out) >= 0.97 * len(out)


def test_machine_scores_are_sums_over_pairs():
    r = np.random.default_rng(4)
    pairs = np.array([1, 3, 4])
    m = Machine(-0.3, r.normal(size=6), pairs, r.normal(size=(3, 2)))
    sets = [[], [0], [1, 3], [0, 1, 3, 4, 5], [2, 4]]
    rows = np.repeat(np.arange(5), [len(x) for x in sets])
    v = {int(p): m.v[i] for i, p in enumerate(pairs)}
    for got, x in zip(m.score(rows, np.array([t for x in sets for t in x], int), 5), sets, strict=True):
        s = m.base + sum(m.w[t] for t in x) + sum(v[a] @ v[b] for a in x for b in x if a < b and a in v and b in v)
        assert abs(got - 1 / (1 + np.exp(-s))) < 1e-12


def test_toxicity_without_labels_or_rows(spark, docs_of):
    docs = docs_of(["a b", None], [1, None])
    assert [x.score for x in toxicity_scores(docs, labels_of(spark, [], "toxic")).collect()] == [0.0, 0.0]
    assert [x.score for x in toxicity_scores(docs, labels_of(spark, [(1, 1)], "toxic")).collect()] in ([1.0, 1.0], [0.0, 0.0])
    assert toxicity_scores(docs_of([]), labels_of(spark, [(1, 1)], "toxic")).count() == 0


def test_quality(spark, docs_of, prose):
    r = random.Random(2)
    texts, rows = [], []
    for i in range(700):
        t = prose(i, r.randrange(20, 120)).capitalize()
        bad = i % 5 == 0
        if bad:
            t = r.choice([t.upper().replace(" ", "!! "), t.replace(" ", " | "), "buy now " * 40])
        texts.append(t)
        rows.append((i, int(not bad)))
    texts += [None, "", "é" * 60_000]
    docs = docs_of(texts, extra=CLASHING)
    got = {x.doc_id: x for x in quality_scores(docs, labels_of(spark, rows, "quality")).collect()}
    assert len(got) == len(texts) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got.values())
    assert all(x.held_out == held_out(i, 3, 1) for i, x in got.items())
    out = [(got[i].predicted, y) for i, y in rows if got[i].held_out]
    assert sum(p == y for p, y in out) >= 0.97 * len(out)
    assert abs(got[700].score - got[701].score) < 1e-9


def test_quality_without_labels_or_rows(spark, docs_of):
    docs = docs_of(["a b", None], [1, None])
    assert [x.score for x in quality_scores(docs, labels_of(spark, [], "quality")).collect()] == [0.5, 0.5]
    assert quality_scores(docs_of([]), labels_of(spark, [], "quality")).count() == 0


def test_statistics_do_not_depend_on_neighbours(prose):
    texts = [prose(k, 3 + 9 * k) + "\n" * (k % 3) + "\nA|b!" * (k % 4) for k in range(9)] + ["", "\n", "x"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    together = statistics(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert together.shape == (len(texts), N_FEATURES) and np.isfinite(together).all()
    for k, t in enumerate(raw):
        alone = statistics(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert np.allclose(alone[0], together[k])


def test_isotonic_against_brute_force():
    r = np.random.default_rng(4)
    for _ in range(30):
        n = int(r.integers(1, 9))
        counts = r.integers(1, 6, n).astype(float)
        positives = np.minimum(counts, r.integers(0, 6, n)).astype(float)
        x, y = isotonic(np.arange(n, dtype=float), positives, counts)
        got = np.interp(np.arange(n), x, y)
        want = [max(min(positives[a:b + 1].sum() / counts[a:b + 1].sum() for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(got, want)


def test_language(docs_of):
    r = random.Random(3)
    syllables = {"aa": ["ka", "mo", "ti", "ru"], "bb": ["sch", "ein", "ung", "ö"], "cc": ["ción", "ado", "ñ", "qu"]}
    texts, lang = [], []
    for i in range(400):
        name = r.choice(list(syllables))
        texts.append(" ".join("".join(r.choice(syllables[name]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(3, 40))))
        lang.append(name if i % 10 else None)
    truth = lang[:]
    texts += [None, "", "12 34 !?", "UNGSCHEIN UNGEIN", "kamotiru " * 9000]
    lang += ["aa", None, "aa", None, None]
    got = {x.doc_id: x for x in languages(docs_of(texts, lang=lang, extra=CLASHING)).collect()}
    assert all(got[i].lang_pred == x for i, x in enumerate(truth) if x)
    assert [got[400 + k].lang_pred for k in range(5)] == ["und", "und", "und", "bb", "aa"]
    assert all(0 <= x.score <= 1 and x.held_out == held_out(i, 4, 2) for i, x in got.items())
    assert got[400].score == 0


def test_language_without_learning_rows(docs_of):
    assert [(x.lang_pred, x.score) for x in languages(docs_of(["abc", None], [1, None], lang=[None, None])).collect()] == [("und", 0.0)] * 2
    assert languages(docs_of([])).count() == 0


def test_ngrams_stay_within_texts():
    both, rows, _ = ngrams(["ab c", "dé"])
    one, _, _ = ngrams(["ab c"])
    two, _, _ = ngrams(["dé"])
    assert sorted(both[rows == 0]) == sorted(one) and sorted(both[rows == 1]) == sorted(two)
