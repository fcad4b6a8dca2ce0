"""Display text of chosen values, written out."""

import pytest
from pyspark.sql import functions as F

from kpishift.functions.text import (bullet_text_sql, change_text, impact_bar, segment_text_sql, trend_text,
                                     value_str, value_str_sql, value_text)

# value, card text
VALUES = [
    (0.0, "0"), (1.0, "1"), (12.5, "12"), (13.5, "14"), (999.4, "999"), (999.6, "1000"), (1000.0, "1.0K"),
    (1049.95, "1.0K"), (1250.0, "1.2K"), (1350.0, "1.4K"), (999999.0, "1000.0K"), (1000000.0, "1.0M"),
    (123456789.123, "123.5M"), (1e12, "1000000.0M"), (-5.55, "-6"), (-2500.0, "-2500"), (0.04, "0"),
]
# direction, change in percent, trend text, change text
CHANGES = [
    ("up", 12.35, "↑ +12.3%", "↑ +12.3%"), ("up", 8.25, "↑ +8.2%", "↑ +8.2%"), ("up", 100.0, "↑ +100.0%", "↑ +100.0%"),
    ("down", -5.55, "↓ -5.5%", "↓ -5.5%"), ("down", -0.04, "↓ -0.0%", "↓ -0.0%"), ("down", -100.0, "↓ -100.0%", "↓ -100.0%"),
    ("flat", 0.0, "→ 0.0%", "→ +0.0%"), ("flat", 2.675, "→ 2.7%", "→ +2.7%"),
]
# impact, bar
BARS = [
    (0.0, " 0.00"), (0.19, " 0.19"), (0.2, "█ 0.20"), (0.999, "████ 1.00"), (1.0, "█████ 1.00"),
    (2.0, "██████████ 2.00"), (1234.565, "██████████ 1234.57"), (2.675, "██████████ 2.67"),
]
# current, previous, change in percent, bullet
BULLETS = [
    (1234567.891, 0.5, 12.35, "CTR for geo=US: 1,234,567.89 → 0.50 (+12.3%)"),
    (-1234.5, 1000.0, -5.55, "CTR for geo=US: -1,234.50 → 1,000.00 (-5.5%)"),
    (2.675, 0.0, 100.0, "CTR for geo=US: 2.67 → 0.00 (+100.0%)"),
]


@pytest.mark.parametrize("rows,schema,expression", [
    (VALUES, "v double, want string", lambda: value_text("v")),
    ([(d, p, t) for d, p, t, _ in CHANGES], "dir string, v double, want string", lambda: trend_text("dir", "v")),
    ([(d, p, c) for d, p, _, c in CHANGES], "dir string, v double, want string", lambda: change_text("dir", "v")),
    (BARS, "v double, want string", lambda: impact_bar("v")),
    (BULLETS, "c double, p double, d double, want string", lambda: F.expr(bullet_text_sql(
        "'ctr'", segment_text_sql([("geo", value_str_sql("'US'"))], "="), "c", "p", "d"))),
])
def test_text(spark, rows, schema, expression):
    for r in spark.createDataFrame(rows, schema).withColumn("got", expression()).collect():
        assert r.got == r.want, r


def test_segment_and_none(spark):
    df = spark.createDataFrame([("a", None, True)], "x string, y string, z boolean")
    row = df.select(
        F.expr(segment_text_sql([("x", value_str_sql("x")), ("y", value_str_sql("y"))], ": ")).alias("s"),
        F.expr(segment_text_sql([], ": ")).alias("o"),
        value_str("z", df.schema["z"].dataType).alias("b"),
    ).first()
    assert (row.s, row.o, row.b) == ("x: a, y: None", "Overall", "True")
