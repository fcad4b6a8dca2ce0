import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpishift.llm.compress import compress, nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    """Every part against every entry, in Python integers."""
    kept = [(i, [int(np.floor(256 * x)) for x in v], label) for i, v, label in rows
            if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = [[r[1][p * w:(p + 1) * w] for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        out = []
        for c in cut:
            out.append([min((sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)])
        return out

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [c[p] for c, g in zip(cut, got, strict=True) if g[p][1] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    got = assign()
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in g) for g in got]
    labels = {}
    for r, e in zip(kept, errors, strict=True):
        labels[r[2]] = labels.get(r[2], 0) + e
    return sorted((str(r[0]), "".join(f"{k:02x}" for _, k in g), e, labels[r[2]], sha) for r, g, e in zip(kept, got, errors, strict=True))


def rows_of(df):
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


def test_search_finds_the_nearest_entry_and_the_lowest_of_ties():
    r = np.random.default_rng(1)
    for width in (1, 2, 4, 7):
        for spread in (2, 50, 5000):
            x, book = r.integers(-spread, spread, (300, width)), r.integers(-spread, spread, (40, width))
            book[7], book[31] = book[3], book[2]
            all_pairs = ((x[:, None] - book[None]) ** 2).sum(axis=2)
            entry, distance = nearest(x, book)
            assert (entry == all_pairs.argmin(axis=1)).all() and (distance == all_pairs.min(axis=1)).all()
    x = np.array([[1 << 28, -(1 << 28)]])  # the greatest components that are allowed
    assert nearest(x, -x)[1][0] == 2 * (1 << 29) ** 2


def test_against_brute_force(spark):
    r = random.Random(3)
    rows = [(i, [r.choice([r.gauss(0, 0.3), r.choice([0.0, 0.5, -0.25])]) for _ in range(32)], r.choice([1, 2, None])) for i in range(150)]
    rows += [(5, rows[9][1], 7), (5, rows[9][1], 7), (None, rows[4][1], None), (900, None, 1), (901, [None] * 32, 1),
             (902, [float("nan")] * 32, 1), (903, [float("inf")] + [0.0] * 31, 2), (904, [0.0] * 48, 2), (905, [], 2), (906, [0.1] * 33, 2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in ("code", "error", "part", "entry", "n", "s0", "of_label"):
        df = df.withColumn(name, F.lit("x"))
    want = [x for x in rows if x[1] and len(x[1]) == 32]
    assert rows_of(compress(df)) == brute(want)
    assert rows_of(compress(df.where("vec_id < 20"), rounds=3)) == brute([x for x in want if x[0] is not None and x[0] < 20], rounds=3)


def test_no_vectors_and_too_large_components(spark):
    empty = compress(spark.createDataFrame([(1, None, 2)], SCHEMA))
    assert empty.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"] and empty.count() == 0
    with pytest.raises(Exception, match="would not be exact"):
        compress(spark.createDataFrame([(1, [1e30] * 16, 2)], SCHEMA)).collect()
