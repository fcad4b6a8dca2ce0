import pytest
from pyspark.sql import types as T

from kpishift.config import SourceConfig, ConnectionConfig
from kpishift.sources.files import read_csv, sniff_delimiter
from kpishift.sources.jdbc import sql_source_options, table_source_options


@pytest.mark.parametrize("line,sep", [("a,b,c", ","), ("a;b;c", ";"), ("a\tb\tc", "\t"), ("a;b,c", ","),
                                      ("a;b;c,d", ";"), ("abc", ",")])
def test_sniff(line, sep):
    assert sniff_delimiter(line) == sep


@pytest.mark.parametrize("sep", [";", "\t", ","])
def test_read_csv_sniffed(spark, tmp_path, sep):
    p = tmp_path / "x.csv"
    p.write_text(sep.join(["date", "k", "m"]) + "\n" + sep.join(["2025-01-02", "a", "1.5"]) + "\n")
    df = read_csv(spark, str(p))
    assert df.columns == ["date", "k", "m"]
    assert isinstance(df.schema["date"].dataType, T.DateType)
    assert df.first().m == 1.5


def test_missing_csv(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_csv(spark, str(tmp_path / "nope.csv"))


def test_jdbc_options_query_and_partitions():
    cfg = SourceConfig(date_col="d", type="sql", connection_string="postgresql://u:p@h/db", query="select 1 as a")
    assert sql_source_options(cfg)["query"] == "select 1 as a"
    part = SourceConfig(date_col="d", type="sql", connection_string="postgresql://h/db", query="select * from t",
                        partition_column="id", lower_bound=0, upper_bound=1000, num_partitions=8)
    o = sql_source_options(part)
    assert o["dbtable"].startswith("(select * from t)") and o["numPartitions"] == "8"
    tab = SourceConfig(date_col="d", type="database", table="sales",
                       connection=ConnectionConfig(driver="postgresql", database="db"),
                       dimensions=("k",), metrics=("m",), join_key=("k", "d"))
    assert table_source_options(tab)["dbtable"] == "sales"
    assert tab.scan_columns() == ["k", "m", "d"]
