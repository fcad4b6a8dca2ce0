import pytest

from kpishift.sources.sinks import report_pages, write_report

from .helpers import run


def frame(spark, n, keys=("p", "q", None)):
    return spark.createDataFrame([("2025-01-09", keys[i % len(keys)], f"g{i:04d}", float(i * 7 % 101)) for i in range(n)],
                                 "d string, `report.key` string, `dim.x` string, x double")


def entries(pages, keys):
    out = {}
    for r in pages.collect():
        out.setdefault(tuple(r[k] for k in keys), {})[r.page] = r
    return out


@pytest.mark.parametrize("keys", [[], ["report.key"]])
@pytest.mark.parametrize("n,size", [(47, 10), (60, 10), (3, 10), (9, 1)])
def test_pages_put_together_are_the_ranking(spark, keys, n, size):
    tables = run(spark, frame(spark, n), ["dim.x"], ["x"], ["x"], top_n=None, report_key=keys)
    ranking = {}
    for r in tables.insights.collect():
        ranking.setdefault(tuple(r[k] for k in keys), []).append(r)
    got = entries(report_pages(tables, size), keys)
    assert set(got) == set(ranking)
    for key, rows in ranking.items():
        rows.sort(key=lambda r: r["rank"])
        number, seen = 1, []
        while number is not None:  # as a reader goes through them
            page = got[key].pop(number)
            assert page.first_rank == len(seen) + 1 and page.page_count == len(page.insights) <= size
            seen += page.insights
            number = page.next_page
        assert not got[key] and len(seen) == len(rows)
        for s, r in zip(seen, rows):
            assert (s.dimensions["dim.x"], s.metric, s.impact_score) == (r["dim.x"], r.metric, r.impact_score)


def test_no_rows_no_pages_and_refusals(spark):
    tables = run(spark, frame(spark, 5).limit(0), ["dim.x"], ["x"], ["x"], top_n=None)
    assert report_pages(tables).collect() == []
    with pytest.raises(ValueError, match="row"):
        report_pages(tables, 0)


def test_written_with_a_report(spark, tmp_path):
    tables = run(spark, frame(spark, 30), ["dim.x"], ["x"], ["x"], top_n=None)
    paths = write_report(tables, str(tmp_path), extra=("pages",))
    (page,) = spark.read.parquet(paths["pages"]).collect()
    assert page.page == 1 and page.next_page is None and len(page.insights) == 30
