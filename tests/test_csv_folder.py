import csv
import os
import random

import pytest
from pyspark.sql import types as T

from kpishift import config_from_dict, run_report
from kpishift.sources import csv_folder
from kpishift.sources.csv_folder import read_csv_folder

SCHEMA = "id BIGINT, name STRING, amount DOUBLE, day DATE"


def put(folder, name, text, encoding="utf-8"):
    os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding=encoding, newline="") as f:
        f.write(text)


def folder_of_layouts(folder):
    put(folder, "a.csv", "id,name,amount,day\n1,one,1.5,2025-01-01\n2,\"t,wo\",,2025-01-02\n3,x,oops,2025-01-03\n4,few\n5,many,1,2025-01-01,9\n")
    put(folder, "b.csv", "﻿day; Amount ;id\r\n2025-02-01;7;10\r\n2025-02-02;-0.5;11\r\n\r\nday; Amount ;id\r\nnever;1;12\r\n")
    put(folder, "deep/c.csv", "name\textra\tid\nn1\tz\t20\n\"a\"\"b\"\tz\t21\n\"open\tz\t22\n")
    put(folder, "empty.csv", "")
    put(folder, "blank.csv", "\n\n  \n")
    put(folder, "header.csv", "id,name\n")
    put(folder, "one.csv", "id\n30\n\"\"\n")


def test_every_file_by_its_own_header(spark, tmp_path):
    folder_of_layouts(str(tmp_path))
    got = read_csv_folder(spark, str(tmp_path), SCHEMA)
    assert [(f.name, f.dataType.simpleString()) for f in got.rows.schema] == [("id", "bigint"), ("name", "string"), ("amount", "double"), ("day", "date")]
    rows = sorted(((r.id, r.name, r.amount, str(r.day) if r.day else None) for r in got.rows.collect()), key=lambda r: (r[0] is None, r[0]))
    assert rows == [(1, "one", 1.5, "2025-01-01"), (2, "t,wo", None, "2025-01-02"), (10, None, 7.0, "2025-02-01"), (11, None, -0.5, "2025-02-02"),
                    (20, "n1", None, None), (21, 'a"b', None, None), (30, None, None, None), (None, None, None, None)]
    bad = {(os.path.basename(r.file), r.record, r.reason) for r in got.malformed.collect()}
    assert bad == {("a.csv", "3,x,oops,2025-01-03", "values"), ("a.csv", "4,few", "columns"), ("a.csv", "5,many,1,2025-01-01,9", "columns"),
                   ("b.csv", "never;1;12", "values"), ("c.csv", '"open\tz\t22', "columns")}
    files = {os.path.basename(r.file): (r.delimiter, r.columns) for r in got.files.collect()}
    assert files["b.csv"] == (";", ["day", "amount", "id"]) and files["c.csv"] == ("\t", ["name", "extra", "id"]) and "empty.csv" not in files


def test_headers_joined_by_a_shuffle_give_the_same(spark, tmp_path, monkeypatch):
    folder_of_layouts(str(tmp_path))
    want = read_csv_folder(spark, str(tmp_path), SCHEMA)
    monkeypatch.setattr(csv_folder, "BROADCAST_FILES", 0)
    got = read_csv_folder(spark, str(tmp_path), SCHEMA)
    assert sorted(map(str, got.rows.collect())) == sorted(map(str, want.rows.collect()))
    assert sorted(map(str, got.malformed.collect())) == sorted(map(str, want.malformed.collect()))


def test_types_inferred_from_all_files(spark, tmp_path):
    put(tmp_path, "a.csv", "id,x,flag,t,none\n1,2,true,5,\n2,,false,6,\n")
    put(tmp_path, "b.csv", "t;x;ID\nabc;2.5;3\n")
    got = read_csv_folder(spark, str(tmp_path))
    assert {f.name: f.dataType for f in got.rows.schema} == {
        "id": T.LongType(), "x": T.DoubleType(), "flag": T.BooleanType(), "t": T.StringType(), "none": T.StringType()}
    assert {(r.id, r.x, r.flag, r.t) for r in got.rows.collect()} == {(1, 2.0, True, "5"), (2, None, False, "6"), (3, 2.5, None, "abc")}
    assert got.malformed.count() == 0


def test_against_the_csv_module(spark, tmp_path):
    r = random.Random(3)
    want = []
    for i in range(12):
        names = ["id", "name", "amount"]
        r.shuffle(names)
        names = names[:r.choice([2, 3, 3])]
        with open(tmp_path / f"f{i}.csv", "w", newline="") as f:
            out = csv.DictWriter(f, names, delimiter=r.choice(",;\t"), extrasaction="ignore", quoting=csv.QUOTE_MINIMAL)
            out.writeheader()
            for j in range(40):
                row = {"id": 100 * i + j, "name": r.choice(["a", "b c", "d,e", "f;g", "h\ti", " pad "]), "amount": r.choice([1.25, -3.0, 1e9])}
                out.writerow(row)
                want.append(tuple(row[c] if c in names else None for c in ("id", "name", "amount")))
    got = read_csv_folder(spark, str(tmp_path), "id BIGINT, name STRING, amount DOUBLE")
    assert got.malformed.count() == 0
    assert sorted(map(str, map(tuple, got.rows.collect()))) == sorted(map(str, want))


def test_refusals_and_folders_without_rows(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_csv_folder(spark, str(tmp_path / "absent"), SCHEMA)
    put(tmp_path, "none/empty.csv", "")
    got = read_csv_folder(spark, str(tmp_path / "none"), SCHEMA)
    assert got.rows.collect() == [] and got.malformed.collect() == [] and got.files.collect() == []
    put(tmp_path, "twice/a.csv", "id,ID\n1,2\n")
    with pytest.raises(ValueError, match="two columns"):
        read_csv_folder(spark, str(tmp_path / "twice"), SCHEMA)


def test_as_a_source_of_a_report(spark, tmp_path):
    put(tmp_path, "in/a.csv", "d,k,x\n2025-01-08,a,5\n2025-01-01,a,2\n")
    put(tmp_path, "in/b.csv", "x;k;d\n7;b;2025-01-09\nbad;b;2025-01-09\n")
    cfg = config_from_dict({
        "dataset": {"primary_source": "f", "sources": {"f": {"type": "csv", "path": "in", "date_col": "d", "own_headers": True, "metrics": ["x"]}}},
        "report": {"primary_date_col": "d", "primary_dims": ["k"], "kpi_priority": ["x"],
                   "comparison": {"current_start": "2025-01-08", "current_end": "2025-01-14", "previous_start": "2025-01-01", "previous_end": "2025-01-07"}}})
    assert cfg.dataset.sources["f"].own_headers
    put(tmp_path, "in/b.csv", "x;k;d\n7;b;2025-01-09\n")
    got = {r.k: (r.current_value, r.previous_value) for r in run_report(spark, cfg, base_path=str(tmp_path)).insights.collect()}
    assert got == {"a": (5.0, 2.0), "b": (7.0, 0.0)}
