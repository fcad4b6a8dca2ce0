import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(spark, texts, ids=None, lang=None, extra=()):
    ids = ids if ids is not None else list(range(len(texts)))
    rows = [(i, t, lang[k] if lang else "en", "s", None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    for name in extra:  # columns whose names the operators use themselves
        df = df.withColumn(name, F.lit(None).cast("string") if name.startswith("n") else F.lit("x"))
    return df


@pytest.fixture(scope="session")
def prose():
    """A maker of pseudo prose over a small vocabulary of one's own."""
    def make(seed, n, vocabulary=3000):
        r = random.Random(seed)
        out = []
        for k in range(n):
            w = r.randrange(vocabulary) if r.random() < 0.6 else r.randrange(30)
            out.append(f"w{w:x}" + ("." if k % 11 == 10 else ""))
        return " ".join(out)
    return make


@pytest.fixture
def docs_of(spark):
    from kpishift.llm.common import ship

    ship(spark)
    return lambda *a, **b: make_docs(spark, *a, **b)


CLASHING = ("score", "held_out", "label", "key", "node", "text_hash", "number", "ids", "part", "drop_id", "words", "rank")
