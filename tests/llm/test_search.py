import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from kpishift.llm.search import bm25_search, build_index

from .conftest import CLASHING


def words(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))


def brute(docs, queries, k, k1=1.2, b=0.75):
    bags = [(d, Counter(words(t)), len(words(t))) for d, t in docs]
    n, mean = len(docs), sum(x[2] for x in bags) / len(docs)
    df = Counter(w for _, bag, _ in bags for w in bag)
    out = {}
    for q, t in queries:
        asked = Counter(words(t))
        rows = []
        for d, bag, size in bags:
            s = sum(c * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * bag[w] * (k1 + 1) / (bag[w] + k1 * (1 - b + b * size / mean))
                    for w, c in asked.items() if w in bag)
            if s > 0:
                rows.append((-round(s, 6), d is not None, d or 0))
        out[q] = [(d if known else None, -s) for s, known, d in sorted(rows)[:k]]
    return {q: rows for q, rows in out.items() if rows}


def test_against_brute_force(docs_of, prose):
    r = random.Random(1)
    texts = [prose(d, r.randrange(1, 120), vocabulary=400) for d in range(400)]
    texts += [texts[5]] * 15 + [None, "", "!!", "É rare", "w1 " * 5000, texts[9].upper()]
    ids = [*range(len(texts) - 1), None]
    docs = docs_of(texts, ids, extra=CLASHING).repartition(5)
    queries = [(q, texts[q]) for q in range(0, 400, 25)] + [(900, "nowhere"), (901, ""), (902, None), (903, "é Rare w1"), (904, "w1 w1 w2")]
    frame = docs_of([t for _, t in queries], [q for q, _ in queries]).select(F.col("doc_id").alias("query_id"), "text")
    want = brute(list(zip(ids, texts, strict=True)), queries, 10)
    for shard, terms in ((4096, 2_000_000), (50, 300)):  # small shards and blocks of queries give the same
        got = {}
        for x in bm25_search(build_index(docs, max_docs=shard), frame, block_terms=terms).orderBy("query_id", "rank").collect():
            got.setdefault(x.query_id, []).append((x.doc_id, x.score))
        assert set(got) == set(want)
        for q, rows in want.items():
            assert [d for d, _ in got[q]] == [d for d, _ in rows], q
            assert all(abs(s - t) < 2e-6 for (_, s), (_, t) in zip(got[q], rows, strict=True))


def test_blocks_are_skipped(prose, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from kpishift.llm import search

    def raw(texts):
        b = [t.encode() for t in texts]
        return np.frombuffer(b"".join(b), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in b])])

    # two "languages" without common words: a query of one needs no block of the other
    texts = ["the " * 9 + prose(d, 60, 50) for d in range(500)] + ["der " * 9 + prose(d, 60, 50).replace("w", "v") for d in range(500)]
    shard = search._Shard()
    shard.add(list(range(1000)), *search.term_counts(*raw(texts)), 0)
    row = shard.batch(0).to_pylist()[0]
    kinds = {"lengths": np.int32, "terms": np.uint64, "first": np.int32, "docs": np.uint16, "counts": np.uint32}
    data = {"n": 1000, "doc_ids": np.array(row["doc_ids"])} | {k: np.frombuffer(row[k], v) for k, v in kinds.items()}
    q, t, c, _ = search.term_counts(*raw([texts[3][36:]]))
    queries = search.Queries(pa.table({"query_id": q, "term": t.view(np.int64), "weight": c.astype(float)}))
    best = search.Best(1, 10)
    scored = []
    monkeypatch.setattr(search.np, "flatnonzero", lambda x, f=np.flatnonzero: scored.append(np.asarray(x)) or f(x))
    search.search_shard(data, queries, best, 1.2, 0.75, 60.0, block=50)
    assert any(x.shape == (20,) and 0 < x.sum() <= 12 for x in scored)
    assert 3 in best.doc[0]


def test_no_rows(docs_of):
    q = docs_of(["a b"]).select(F.col("doc_id").alias("query_id"), "text")
    assert bm25_search(build_index(docs_of([])), q).count() == 0
    assert bm25_search(build_index(docs_of(["", None])), q).count() == 0
    assert bm25_search(build_index(docs_of(["a"])), q.limit(0)).count() == 0
