import itertools
import random
import re

from kpishift.llm.decontaminate import contaminated, short_masks

from .conftest import CLASHING


def words(t):
    return [w for w in re.split(r"[\s!-/:-@\[-`{-~]+", (t or "").lower()) if w]


def best_run(doc, item, diagonal):
    best = (0, 0, 0)
    total = equal = begin = 0
    for k, w in enumerate(item):
        at = diagonal + k
        same = 0 <= at < len(doc) and doc[at] == w
        if total <= 0:
            total = equal = 0
            begin = at
        total += 1 if same else -3
        equal += same
        if total > best[0]:
            best = (total, equal, begin)
    return best[1], best[2]


def brute(docs, items, min_words=10):
    """Every diagonal of every pair, without seeds."""
    out = {}
    for i, it in items:
        item = words(it)
        for d, dt in docs if len(item) >= 4 else []:
            doc = words(dt)
            for diagonal in range(-len(item), len(doc)):
                equal, begin = best_run(doc, item, diagonal)
                good = equal >= min_words
                if len(item) < 15:
                    same = [diagonal + k for k, w in enumerate(item) if 0 <= diagonal + k < len(doc) and doc[diagonal + k] == w]
                    good = good or 5 * len(same) >= 4 * len(item)
                    equal, begin = len(same), min(same, default=0)
                if good:
                    out[(d, i)] = max(out.get((d, i), (0, 0)), (equal, -begin))
    return {k: (e, -b) for k, (e, b) in out.items()}


def test_short_masks_miss_no_exchanged_words():
    for n in range(4, 15):
        for bad in itertools.combinations(range(n), n // 5):
            assert any(all(m[k] == "0" for k in bad) for m in short_masks(n))
        assert all(m.count("1") >= min(n, 3) for m in short_masks(n))


def test_each_exchanged_word_of_short_items(spark, docs_of, prose):
    items = [(n, prose(700 + n, n)) for n in range(4, 15)]
    docs = []
    for n, text in items:
        w = text.split(" ")
        for bad in itertools.combinations(range(n), 2):
            for kept_out in (bad[:1], bad):
                docs.append((len(docs), " ".join(["before", *("other" if k in kept_out else x for k, x in enumerate(w)), "after"])))
        docs += [(len(docs), " ".join(w[1:])), (len(docs) + 1, " ".join(w[:-1])), (len(docs) + 2, text)]
    got = {(x.doc_id, x.item_id): (x.n_equal, x.start_word) for x in contaminated(
        docs_of([t for _, t in docs], [d for d, _ in docs]), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(docs, items)
    assert got == want and len(want) > 300


def test_against_brute_force(spark, docs_of, prose):
    r = random.Random(1)
    items = [(k, prose(500 + k, r.choice([3, 5, 8, 12, 20, 35]))) for k in range(14)]
    items += [(20, None), (21, ""), (22, items[0][1]), (3, items[3][1])]
    docs = []
    for d in range(120):
        w = prose(d, r.randrange(5, 80)).split(" ")
        if d % 2:
            passage = words(r.choice(items)[1])
            cut = passage[r.randrange(3):] if d % 3 == 0 else passage
            for _ in range(r.choice([0, 1, 2, 4])):
                if cut:
                    cut[r.randrange(len(cut))] = "other"
            at = r.randrange(len(w) + 1)
            w[at:at] = [x.upper() if d % 5 == 0 else x for x in cut]
        docs.append((d, r.choice([" ", "\n", ", "]).join(w)))
    docs += [(200, None), (201, ""), (202, items[5][1] + " " + items[5][1])]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", __import__("pyspark").sql.functions.lit("x"))
    frame = docs_of([t for _, t in docs], [d for d, _ in docs], extra=(*CLASHING, "item", "item_id", "diagonal", "seed"))
    want = brute(docs, items)
    assert len(want) > 15
    for most in (1_000_000, 0):  # broadcast and shuffled seeds
        got = {(x.doc_id, x.item_id): (x.n_equal, x.start_word) for x in contaminated(frame, table, max_broadcast=most).collect()}
        assert got == want


def test_only_dataframe_operations(spark, docs_of, prose):
    plan = contaminated(docs_of([prose(1, 30)]), spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", text)


def test_null_and_repeated_ids_and_no_rows(spark, docs_of, prose):
    p = prose(2, 25)
    items = spark.createDataFrame([(1, p)], "item_id long, text string")
    rows = contaminated(docs_of([p, p, "x " + p, "clean text"], [None, 4, 4, 5]), items).collect()
    assert sorted((x.doc_id or -1, x.n_equal, x.start_word) for x in rows) == [(-1, 25, 0), (4, 25, 0)]
    assert contaminated(docs_of([]), items).count() == 0
    assert contaminated(docs_of([p]), items.limit(0)).count() == 0
