import os
import random

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from kpishift.llm.common import saved
from kpishift.llm.queries import ORACLES, QUERIES

from .test_decontaminate import words
from .test_lines import brute as line_heads
from .test_minhash import altered
from .test_minhash import brute as near_brute
from .test_tokens import plain  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, prose, tmp_path_factory):
    """A small corpus with junk, repeated lines, near copies and test passages, as tables in a folder."""
    r = random.Random(8)
    rows, labels = [], []
    items = [(k, prose(900 + k, 24)) for k in range(6)]
    line = "This very line stands in many of the documents here."
    for i in range(240):
        t = "\n".join(prose(10_000 + 5 * i + k, 30).capitalize() for k in range(3))
        kind = i % 12
        if kind == 0:
            t = t.upper().replace(" ", "!! ")
        elif kind == 1:
            t = f"{t}\n{line if i % 24 == 1 else line.replace('very', 'ver')}"
        elif kind == 2:
            t = f"{t} {items[i % 6][1]}"
        elif kind == 3 and rows:
            t = altered(r, rows[i - 2][1].split("\n")[0] + " " + rows[i - 2][1].split("\n")[1], 2)
        rows.append((i, t, "en", "s", len(t)))
        labels.append((i, int(kind != 0), 0))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, "One short text.", "en", "s", 15)]
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, items


def test_stages_take_effect(spark, corpus, plain):  # noqa: F811
    folder, rows, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, after = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, folder), "test-stage")
        assert docs.columns == columns
        after.append({x.doc_id: x.text for x in docs.collect()})
    first, deduped, single, clean = after
    texts = {x[0]: x[1] for x in rows}
    junk = {i for i in range(240) if i % 12 == 0}
    assert all(t == texts[d] for d, t in first.items()) and not junk & set(first)
    assert set(range(240)) - junk <= set(first)
    heads = line_heads(sorted(first.items()), 1, 20)
    assert set(deduped) == set(first)
    for d, t in first.items():
        assert deduped[d] == (t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if heads.get((d, k), (d, k)) == (d, k)))
    near = near_brute(list(deduped), list(deduped.values()))
    assert set(single) == {d for d, (_, c) in near.items() if c == d}
    held = {d for d, t in single.items() if any(" ".join(words(x)) in " ".join(words(t)) for _, x in items)}
    assert held and set(clean) == set(single) - held
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).orderBy("sequence_id", "offset").collect()
    got = {}
    for p in pieces:
        got.setdefault(p.doc_id, []).extend(np.frombuffer(bytes(p.ids), "<u4").tolist())
    assert got == {d: [*plain(t), 1] for d, t in clean.items()}
    assert [p.sequence_id * 2048 + p.offset for p in pieces] == np.cumsum([0, *(p.length for p in pieces[:-1])]).tolist()
    assert sorted(tuple(p) for p in corpus_pipeline.run(spark, folder).select("doc_id", "doc_tokens").distinct().collect()) == sorted(
        (d, len(t)) for d, t in got.items())


def test_pipeline_of_nothing(spark, corpus, tmp_path):
    folder, *_ = corpus
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    names = {n.partition("_")[0] for n in QUERIES}
    assert names == {f"op{k}" for k in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not os.path.exists(SF), reason="test data missing")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(cur.fetchall(), key=repr)


@pytest.mark.skipif(not os.path.exists(SF), reason="test data missing")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_cover_every_document(spark, name):
    df = QUERIES[name](spark, SF)
    if name != "op5_decontaminate":  # its rows are overlaps, not documents
        assert df.select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    else:
        assert df.count() > 0
