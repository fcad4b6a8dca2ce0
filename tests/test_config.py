import pytest

from kpishift.config import (ConfigError, ConnectionConfig, config_from_dict, connection_string_options,
                             load_config_from_string, resolve_env)

BASE = """
dataset:
  primary_source: s
  sources:
    s: {path: x.csv, date_col: d, metrics: [m]}
report:
  primary_date_col: d
  comparison: {current_start: "2025-01-08", current_end: "2025-01-14", previous_start: "2025-01-01",
               previous_end: "2025-01-07"}
  primary_dims: [k]
  kpi_priority: [m]
"""


def test_parse_yaml_defaults():
    cfg = load_config_from_string(BASE)
    src = cfg.dataset.primary
    assert src.type == "csv" and src.metrics == ("m",) and cfg.report.top_n == 20
    assert cfg.report.comparison.current_period == "2025-01-08 to 2025-01-14"
    assert cfg.dataset.join_type == "left"


def test_empty_and_missing_fields():
    with pytest.raises(ConfigError):
        load_config_from_string("")
    with pytest.raises(ConfigError):
        load_config_from_string(BASE.replace("path: x.csv, ", ""))  # csv needs a path
    with pytest.raises(ConfigError):
        load_config_from_string(BASE.replace("primary_source: s", "primary_source: t"))


def test_bounds_must_be_iso():
    with pytest.raises(ConfigError):
        load_config_from_string(BASE.replace('"2025-01-08"', '"01/08/2025"'))


@pytest.mark.parametrize("typ,extra,missing", [
    ("sql", {"connection_string": "sqlite:///a.db"}, "query"),
    ("sql", {"query": "select 1"}, "connection_string"),
    ("database", {"table": "t"}, "connection"),
    ("database", {"connection": {"driver": "postgresql", "database": "db"}}, "table"),
])
def test_source_type_requirements(typ, extra, missing):
    raw = load_config_from_string(BASE)
    src = {"type": typ, "date_col": "d", **extra}
    with pytest.raises(ConfigError, match=missing):
        config_from_dict({"dataset": {"primary_source": "s", "sources": {"s": src}},
                          "report": {"primary_date_col": "d", "comparison": vars(raw.report.comparison)}})


def test_env_resolution(monkeypatch):
    monkeypatch.setenv("KS_USER", "ana")
    monkeypatch.delenv("KS_MISSING", raising=False)
    assert resolve_env("${KS_USER}-${KS_MISSING}") == "ana-"


def test_jdbc_urls(monkeypatch):
    monkeypatch.setenv("DB_PW", "s3cret")
    pg = ConnectionConfig(driver="postgresql", database="sales", host="db", username="u", password="${DB_PW}")
    opts = pg.jdbc_options()
    assert opts["url"] == "jdbc:postgresql://db:5432/sales"
    assert opts["user"] == "u" and opts["password"] == "s3cret"
    assert "s3cret" not in opts["url"]
    assert ConnectionConfig(driver="mysql", database="x").jdbc_url() == "jdbc:mysql://localhost:3306/x"
    assert ConnectionConfig(driver="mssql", database="x", host="h").jdbc_url() == \
        "jdbc:sqlserver://h:1433;databaseName=x"
    assert ConnectionConfig(driver="sqlite", database="/tmp/a.db").jdbc_url() == "jdbc:sqlite:/tmp/a.db"


def test_connection_strings():
    o = connection_string_options("postgresql://u:p@h:6543/db")
    assert o["url"] == "jdbc:postgresql://h:6543/db" and o["user"] == "u" and o["password"] == "p"
    assert connection_string_options("sqlite:///data/x.db")["url"] == "jdbc:sqlite:data/x.db"
    assert connection_string_options("mysql+mysqlconnector://h/db")["url"] == "jdbc:mysql://h:3306/db"
    assert connection_string_options("jdbc:derby:memory:x")["url"] == "jdbc:derby:memory:x"


def test_apply_recommended_keeps_existing(spark):
    from kpishift.session import apply_recommended
    before = spark.conf.get("spark.sql.adaptive.enabled")
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(key)
    spark.conf.unset(key)
    applied = apply_recommended(spark, {"spark.sql.adaptive.enabled": "false"})
    try:
        assert "spark.sql.adaptive.enabled" not in applied          # already set by the session
        assert spark.conf.get("spark.sql.adaptive.enabled") == before
        assert applied.get(key) == "256m"
    finally:
        for k in applied:                                           # leave the shared session as it was
            spark.conf.unset(k)
        spark.conf.set(key, old)


def test_url_parameters_and_escapes():
    o = connection_string_options("postgresql://u%40x:p%40ss%2F@h:5432/my%20db?sslmode=require&application_name=a%20b")
    assert o["url"] == "jdbc:postgresql://h:5432/my db?sslmode=require&application_name=a+b"
    assert (o["user"], o["password"]) == ("u@x", "p@ss/")
    o = connection_string_options("sqlserver://u:p@h/db?encrypt=true")
    assert o["url"] == "jdbc:sqlserver://h:1433;databaseName=db;encrypt=true"
    with pytest.raises(ConfigError):
        connection_string_options("no url at all")
    with pytest.raises(ConfigError):
        connection_string_options("mysql://h:port/db")


def test_formulas_are_read_with_the_definition():
    with pytest.raises(ValueError, match="bad"):
        load_config_from_string(BASE + "derived_metrics: {bad: 'a + b + c'}\n")
