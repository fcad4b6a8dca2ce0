import random

from kpishift.llm.components import components
from kpishift.llm.minhash import near_duplicates, shingle_set

from .conftest import CLASHING


def brute(ids, texts, percent=75):
    sets = [shingle_set(t or "") for t in texts]
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, d in enumerate(ids)}


def altered(r, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
    return " ".join(w)


def test_against_brute_force(docs_of, prose):
    r = random.Random(1)
    texts = []
    for k in range(12):
        base = prose(k, 60 + 20 * k)
        texts.append(base)
        texts += [altered(r, base, r.randrange(1, 6)) for _ in range(6)]
    hub = prose(99, 150)  # many near copies of one text, most of them not near to each other
    texts += [altered(r, hub, 3) for _ in range(90)] + [hub.upper(), hub, hub.replace(" ", "\n")]
    texts += ["", None, "  \n ", "a b c", "A  B\tc", "a b c d", "a b c d e", "a b c d e", "é b c d e", "É b c d e", "z " * 9000]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    want = brute(ids, texts)
    got = {x.doc_id: x for x in near_duplicates(docs_of(texts, ids, extra=CLASHING)).collect()}
    assert {d: (x.n_shingles, x.component_id) for d, x in got.items()} == want
    assert all(x.kept == (d == x.component_id) for d, x in got.items())
    assert len({c for _, c in want.values()}) < len(texts) - 120  # there is something to find


def test_hot_keys_are_compared_in_blocks(docs_of, prose, monkeypatch):
    import kpishift.llm.minhash as m

    r = random.Random(5)
    hub = prose(7, 120)
    texts = [altered(r, hub, 4) for _ in range(120)]
    inner = m.linked
    monkeypatch.setattr(m, "linked", lambda docs, mapped, percent: inner(docs, mapped, percent, block=16, nearest=1))
    got = {x.doc_id: x.component_id for x in near_duplicates(docs_of(texts)).collect()}
    assert got == {d: c for d, (_, c) in brute(list(range(120)), texts).items()}


def test_all_pairs_follow_an_empty_round_of_nearest(docs_of, prose, monkeypatch):
    import kpishift.llm.minhash as m

    r = random.Random(5)
    hub = prose(7, 120)
    texts = [altered(r, hub, 4) for _ in range(60)]
    inner, rounds = m._cross, []

    def cross(shared, sigs, forest, screen, block, most, percent):
        rounds.append(most)
        pairs = inner(shared, sigs, forest, screen, block, most, percent)
        return pairs.limit(0) if most else pairs

    monkeypatch.setattr(m, "_cross", cross)
    got = {x.doc_id: x.component_id for x in near_duplicates(docs_of(texts)).collect()}
    assert got == {d: c for d, (_, c) in brute(list(range(60)), texts).items()}
    assert rounds == [8, None]


def test_null_and_repeated_ids_and_no_rows(docs_of, prose):
    t = prose(3, 80)
    rows = near_duplicates(docs_of([t, t, t, prose(4, 50), None], [5, 5, None, None, 8])).collect()
    assert sorted((x.doc_id or -1, x.n_shingles, x.component_id or -1, x.kept) for x in rows) == sorted([
        (5, len(shingle_set(t)), 5, True), (5, len(shingle_set(t)), 5, True), (-1, len(shingle_set(t)), 5, True),
        (-1, 46, -1, True), (8, 0, 8, True)])
    assert near_duplicates(docs_of([])).count() == 0


def test_one_id_with_two_texts(docs_of, prose):
    r = random.Random(8)
    a, b, c = prose(31, 120), prose(32, 120), prose(33, 120)
    texts = [a, b, altered(r, a, 2), altered(r, b, 2), c, altered(r, c, 2), c, c]
    rows = near_duplicates(docs_of(texts, [1, 1, 5, 6, 9, 7, 9, 1])).collect()
    assert sorted((x.doc_id, x.component_id, x.kept) for x in rows) == [
        (1, 1, True), (1, 1, True), (1, 1, True), (5, 1, False), (6, 1, False), (7, 1, False), (9, 1, False), (9, 1, False)]
    rows = near_duplicates(docs_of(texts[:-1], [3, 3, 2, 6, 9, 7, 9])).collect()
    assert sorted((x.doc_id, x.component_id) for x in rows) == [(2, 2), (3, 2), (3, 3), (6, 3), (7, 7), (9, 7), (9, 7)]


def test_only_texts_of_candidate_ends_are_shuffled(spark, docs_of, prose, monkeypatch):
    import kpishift.llm.minhash as m

    r = random.Random(13)
    texts = [prose(k, 40) for k in range(600)]
    texts += [altered(r, texts[k], 1) for k in range(12)]
    ids = list(range(len(texts)))
    inner, shuffled = m.saved, []

    def watched(df, name):
        if name == "minhash-texts":
            df.collect()
            plan = df._jdf.queryExecution().executedPlan().executedPlan()
            leaves = (plan.plan() if plan.nodeName() == "ResultQueryStage" else plan).collectLeaves()
            stages = [x for x in (leaves.apply(i) for i in range(leaves.size())) if "ShuffleQueryStage" in x.nodeName()]
            shuffled.append(max((int(str(x.getRuntimeStatistics().rowCount().get())) for x in stages), default=0))
        return inner(df, name)

    monkeypatch.setattr(m, "saved", watched)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with more ends than a broadcast holds
    try:
        for kind in ("long", "int"):
            docs = docs_of(texts, ids)
            got = {x.doc_id: x.component_id for x in near_duplicates(docs.withColumn("doc_id", docs.doc_id.cast(kind))).collect()}
            assert got == {d: c for d, (_, c) in brute(ids, texts).items()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(d != c for d, c in got.items()) == 12
    assert shuffled and 12 <= max(shuffled) <= 60  # of 612 texts


def test_components(spark):
    r = random.Random(2)
    n = 300
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + r.randrange(1, 90)) for _ in range(80)]
    edges += [(r.randrange(200, n), r.randrange(200, n)) for _ in range(45)] + [(7, 7)]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    r.shuffle(edges)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
