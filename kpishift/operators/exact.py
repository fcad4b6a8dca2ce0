"""Exact sums of doubles: added up as integers by exponent, rounded once at the end.

A finite double is a whole multiple of 2^-1074. Its bits are cut at fixed
places into digits of ``DIGIT`` bits: a value has at most four of them, and they
are added up as longs per place, in any order and in any tasks, without
rounding. At the end the carries are passed on, and the four leading digits
(with one bit for whatever lies below) become the nearest double. So a
sum is the correctly rounded sum of its values, as that of Python's
``math.fsum``, whatever their order and size. A place holds 2^43 values of one
group; the longs' overflow check would stop the query beyond.

NaN and infinities, if there are any, decide a sum as they do in a sum of doubles.
Sums beyond the largest double are infinite.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import col, qi

DIGIT = 20                 # bits of a digit
BASE = 1 << DIGIT
LOWEST = 1074              # the least double is 2^-LOWEST
PARTS = 4                  # digits that one value can have: 53 bits at any place
PLACES = 105               # places of digits that doubles reach
ODD = -1                   # stands for the place of NaN and infinities

_INDEX, _VALUE, _PLACE, _SIZE = "__kpi_index", "__kpi_value", "__kpi_place", "__kpi_size"
_ODD_SQL = f"(isnan({_VALUE}) OR abs({_VALUE}) = double('infinity'))"


def _power(exponent: str) -> str:
    return f"pow(2.0D, {exponent})"


def with_digits(df: DataFrame) -> DataFrame:
    """Add the place of the leading digit of ``__kpi_value`` and its digits ``__kpi_digit_0`` (leading) to 3, signed."""
    weight = _power(f"{DIGIT} * {{p}} - {LOWEST}")
    guess = f"CAST(floor((floor(log2({_SIZE})) + {LOWEST}) / {DIGIT}) AS INT)"
    # the logarithm may be off next to a power of two: the quotient shows it
    sized = df.selectExpr("*", f"abs({_VALUE}) AS {_SIZE}").selectExpr(
        "*", f"CASE WHEN {_ODD_SQL} THEN {ODD} WHEN {_SIZE} > 0 THEN greatest({guess}, 0) END AS __kpi_guess")
    quotient = f"{_SIZE} / {weight.format(p='__kpi_guess')}"
    placed = sized.selectExpr(
        "*", f"CASE WHEN __kpi_guess < 0 THEN {ODD} WHEN {quotient} >= {BASE} THEN __kpi_guess + 1 "
             f"WHEN {quotient} < 1 THEN greatest(__kpi_guess - 1, 0) ELSE __kpi_guess END AS {_PLACE}")
    rest = placed.selectExpr("*", f"CASE WHEN {_PLACE} >= 0 THEN {_SIZE} / {weight.format(p=_PLACE)} END AS __kpi_rest_0")
    for k in range(PARTS):
        rest = rest.selectExpr(
            "*", f"CAST(signum({_VALUE}) * floor(__kpi_rest_{k}) AS BIGINT) AS __kpi_digit_{k}",
            *([f"(__kpi_rest_{k} - floor(__kpi_rest_{k})) * {BASE} AS __kpi_rest_{k + 1}"] if k + 1 < PARTS else []))
    return rest


def _carried(sums: str) -> str:
    """SQL: digits of 0 to BASE - 1 (least first) and what is carried out at the end (-1 for a negative sum)."""
    return (f"aggregate({sums}, named_struct('carry', 0L, 'out', array_repeat(0L, 0)), (a, x) -> named_struct("
            f"'carry', shiftright(a.carry + x, {DIGIT}), 'out', array_append(a.out, (a.carry + x) & {BASE - 1}L)))")


def rounded(df: DataFrame, names: list[str]) -> DataFrame:
    """Replace each column of (place, d0, d1, d2, d3) structs by the double nearest to the sum it holds (null without structs).

    Stage by stage: sums per place, carries, the sign, the index below the
    four leading digits, whether anything is left below them, the double.
    """
    def stage(df, *expressions):
        return df.selectExpr("*", *[e.format(n=n) for n in names for e in expressions])

    digits = " + ".join(f"CASE WHEN e.place = p + {k} THEN e.d{k} ELSE 0L END" for k in range(PARTS))
    places = "transform({n}, e -> e.place)"
    df = stage(df, f"greatest(array_min({places}) - {PARTS - 1}, 0) AS {{n}}_from")  # nothing lies below the least double
    # three more places take up the carries of 43 bits
    df = stage(df, f"CASE WHEN size({{n}}) > 0 THEN transform(sequence({{n}}_from, array_max({places}) + 3), "
                   f"p -> aggregate({{n}}, 0L, (a, e) -> a + {digits})) END AS {{n}}_sums")
    df = stage(df, f"{_carried('{n}_sums')} AS {{n}}_up")
    df = stage(df, f"CASE WHEN {{n}}_up.carry < 0 THEN {_carried('transform({n}_sums, x -> -x)')}.out ELSE {{n}}_up.out END AS {{n}}_digits")
    df = stage(df, f"greatest(array_max(transform({{n}}_digits, (x, i) -> CASE WHEN x <> 0 THEN i ELSE 0 END)) - {PARTS - 1}, 0) AS {{n}}_low")
    df = stage(df, "CASE WHEN exists(slice({n}_digits, 1, {n}_low), x -> x <> 0) THEN 1L ELSE 0L END AS {n}_more")
    terms = [f"CAST(coalesce(get({{n}}_digits, {{n}}_low + {k}), 0L){' | {n}_more' if k == 0 else ''} AS DECIMAL(20,0)) * {1 << DIGIT * k}BD"
             for k in range(PARTS)]
    total = " + ".join(f"CAST({t} AS DECIMAL(38,0))" for t in terms)
    value = (f"CASE WHEN {{n}}_up.carry < 0 THEN -1.0D ELSE 1.0D END * CAST({total} AS DOUBLE) "
             f"* {_power(f'{DIGIT} * ({{n}}_low + {{n}}_from) - {LOWEST}')} AS {{n}}_value")
    df = stage(df, value)
    helpers = [f"{n}{tail}" for n in names for tail in ("", "_from", "_sums", "_up", "_digits", "_low", "_more")]
    return df.drop(*helpers).withColumnsRenamed({f"{n}_value": n for n in names})


def exact_period_sums(df: DataFrame, dims: list[str], floats: list[str], others: dict[str, str], in_current: str,
                      in_previous: str) -> DataFrame:
    """``m_current`` / ``m_previous`` of double metrics, exact; ``others``: further aggregates (name -> SQL sum) of the same pass.

    One scan: rows are laid out per metric, added up by group, metric and
    place (a few rows a group), then brought together by group.
    """
    pairs = ", ".join(f"{i}, CAST({qi(m)} AS DOUBLE)" for i, m in enumerate(floats))
    wide = {name: f"__kpi_other_{i}" for i, name in enumerate(others)}
    rows = df.selectExpr(*[qi(d) for d in dims], f"({in_current}) AS __kpi_c", f"({in_previous}) AS __kpi_p",
                         *[f"{value} AS {wide[name]}" for name, value in others.items()], f"stack({len(floats)}, {pairs}) AS ({_INDEX}, {_VALUE})")
    rows = with_digits(rows)
    first = []
    for flag in ("c", "p"):
        for k in range(PARTS):
            first.append(F.expr(f"sum(CASE WHEN __kpi_{flag} THEN __kpi_digit_{k} END)").alias(f"{flag}{k}"))
        first.append(F.expr(f"sum(CASE WHEN __kpi_{flag} AND {_PLACE} = {ODD} THEN {_VALUE} END)").alias(f"{flag}_odd"))
    first += [F.expr(f"sum(CASE WHEN {_INDEX} = 0 THEN {c} END)").alias(c) for c in wide.values()]
    by = [col(d) for d in dims]
    parts = rows.groupBy(*by, _INDEX, _PLACE).agg(*first)
    second, out, names = [], [], []
    for i, m in enumerate(floats):
        for flag, suffix in (("c", "current"), ("p", "previous")):
            entry = ", ".join(f"'d{k}', {flag}{k}" for k in range(PARTS))
            name = f"__kpi_{flag}_{i}"
            names.append(name)
            second.append(F.expr(f"collect_list(CASE WHEN {_INDEX} = {i} AND {_PLACE} >= 0 AND {flag}0 IS NOT NULL "  # at most PLACES
                                 f"THEN named_struct('place', {_PLACE}, {entry}) END)").alias(name))
            second.append(F.expr(f"sum(CASE WHEN {_INDEX} = {i} THEN {flag}_odd END)").alias(f"{name}_odd"))
            out.append(f"coalesce({name}_odd, {name}, 0.0D) AS {qi(f'{m}_{suffix}')}")
    second += [F.sum(c).alias(c) for c in wide.values()]
    out += [f"coalesce({c}, 0) AS {qi(name)}" for name, c in wide.items()]
    together = parts.groupBy(*by).agg(*second) if dims else parts.agg(*second)
    return rounded(together, names).selectExpr(*[qi(d) for d in dims], *out)
