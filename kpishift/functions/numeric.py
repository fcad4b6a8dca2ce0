"""Decimal rounding with the exact semantics of Python's ``round(x, d)``.

Python rounds the *exact* binary value of a double to ``d`` decimals, ties
to even. ``round(x * 10^d) / 10^d`` does not: the product is itself rounded
first, so ``-5.55`` (binary ``-5.5499999...``) becomes ``-5.6`` instead of
``-5.5``. Spark's ``round(x, d)`` rounds the shortest decimal string half
up, which differs again. Here the product ``x * 10^d`` is split into its
rounded value ``p`` and its exact error ``err`` (Dekker's error-free product
with a Veltkamp split; ``10^d`` needs no split for d <= 8), so the position
of the exact product against the midpoint ``floor(p) + 0.5`` is known
exactly. It is plain IEEE double arithmetic, so every engine that evaluates
the same expression gets the same bits (the DuckDB statements use it too).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Veltkamp splitter 2^27 + 1, and 2^52 (from there on a double has no fraction).
SPLITTER = 134217729.0
TWO_52 = 4503599627370496.0


def qi(name: str) -> str:
    """Quote a column name for a SQL expression."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its exact name (dots and spaces are part of the name)."""
    return F.col(qi(name))


def _lit(v: float) -> str:
    return f"{v!r}D"


def _step_sql(p: str, f: str, err: str) -> str:
    """0 or 1 to add to ``f = floor(p)``: compares the exact product
    ``p + err`` with the midpoint ``f + 0.5`` (ties to even)."""
    zero, half, one, two = (_lit(v) for v in (0.0, 0.5, 1.0, 2.0))
    diff = f"(({p} - {f}) - {half})"                     # exact while |p| < 2^52
    side = f"(CASE WHEN {diff} <> {zero} THEN {diff} ELSE {err} END)"
    even = f"(({f} - {two} * CAST(floor({f} / {two}) AS DOUBLE)) = {zero})"
    return (f"(CASE WHEN {side} > {zero} THEN {one} WHEN {side} < {zero} THEN {zero} "
            f"WHEN {even} THEN {zero} ELSE {one} END)")


def _fraction_sql(x: str, s: str) -> str:
    """``x``, or its part above ``floor(x)`` where ``x * s`` leaves no room for a fraction."""
    wide = f"abs({x} * {s}) >= {_lit(TWO_52)} AND abs({x}) < {_lit(TWO_52)}"
    return f"(CASE WHEN {wide} THEN {x} - CAST(floor({x}) AS DOUBLE) ELSE {x} END)"


def _finish_sql(x: str, y: str, n: str, s: str) -> str:
    """The rounded value from ``n``, the rounded ``y * s`` of the part ``y`` of ``x``."""
    zero = _lit(0.0)
    return (f"(CASE WHEN isnan({x}) OR abs({x}) >= {_lit(TWO_52)} THEN {x} "
            f"WHEN {y} <> {x} THEN ({x} - {y}) + {n} / {s} "
            f"WHEN {n} = {zero} THEN {x} * {zero} ELSE {n} / {s} END)")


def _steps(y: str, s: str) -> tuple[str, str, str]:
    """Product ``y * s``, high part of ``y``, floor of the product."""
    k = _lit(SPLITTER)
    return f"({y} * {s})", f"(({k} * {y}) - (({k} * {y}) - {y}))", f"CAST(floor({y} * {s}) AS DOUBLE)"


def _number_sql(y: str, s: str, p: str, h: str, f: str) -> str:
    """The integer nearest to the exact ``y * s`` (ties to even), as a double."""
    err = f"(({h} * {s} - {p}) + ({y} - {h}) * {s})"   # y * s == p + err, exactly
    return f"({f} + {_step_sql(p, f, err)})"


def exact_round_sql(expr: str, digits: int) -> str:
    """SQL text rounding ``expr`` like Python's ``round(expr, digits)``.

    One self-contained expression whose intermediate values are lambda
    variables, so the text stays short wherever it is nested. For a few rows
    (display text, totals); :func:`round_columns` is the form for bulk data.
    """
    if not 0 <= digits <= 8:
        raise ValueError("digits must be between 0 and 8")
    s = _lit(float(10 ** digits))
    result = _finish_sql("__x", "__y", _number_sql("__y", s, *_steps("__y", s)), s)
    inner = f"transform(array({_fraction_sql('__x', s)}), __y -> {result})[0]"
    return f"transform(array(CAST({expr} AS DOUBLE)), __x -> {inner})[0]"


def round_sql(expr: str, digits: int) -> str:
    """Spark SQL text of :func:`round_to`."""
    return exact_round_sql(expr, digits)


def chain(df: DataFrame, stages: list[list[str]]) -> DataFrame:
    """Apply projection stages (lists of SQL select items) as nested
    subqueries in one ``spark.sql`` call: the same plan as a chain of
    ``selectExpr`` calls, parsed and analysed once."""
    sql = None
    for cols in stages:
        source = "{df}" if sql is None else f"({sql})"
        sql = f"SELECT {', '.join(cols)} FROM {source}"
    return df if sql is None else df.sparkSession.sql(sql, df=df)


def round_stages(specs: list[tuple[str, int, str]], keep: list[str]) -> list[list[str]]:
    """Projection stages adding ``out = round(src, digits)`` for every spec.

    Narrow stages (part to round; product, split and floor; integer; result),
    so every expression reads plain columns: the arithmetic of
    :func:`exact_round_sql` without repeated subexpressions, which keeps
    optimizer work and generated code small. The last stage keeps ``keep`` plus
    the outputs.
    """
    a, b, c, outs = ["*"], ["*"], ["*"], [qi(name) for name in keep]
    for j, (src, digits, out) in enumerate(specs):
        s = _lit(float(10 ** digits))
        x = f"CAST({qi(src)} AS DOUBLE)"
        y, n, *steps = (f"__round_{name}{j}" for name in "ynphf")
        a.append(f"{_fraction_sql(x, s)} AS {y}")
        b += [f"{text} AS {name}" for text, name in zip(_steps(y, s), steps, strict=True)]
        c.append(f"{_number_sql(y, s, *steps)} AS {n}")
        outs.append(f"{_finish_sql(x, y, n, s)} AS {qi(out)}")
    return [a, b, c, outs]


def round_columns(df: DataFrame, specs: list[tuple[str, int, str]], keep: list[str]) -> DataFrame:
    """Add ``out = round(src, digits)`` (Python semantics) for every spec;
    returns ``keep`` plus the outputs (see :func:`round_stages`)."""
    return chain(df, round_stages(specs, keep))


def round_to(col: Column, digits: int) -> Column:
    """Round a double column to ``digits`` decimals exactly as Python does
    (exact binary value, ties to even; a zero result keeps the sign of x).
    For a few values per row; see :func:`round_columns` for bulk use."""
    if not 0 <= digits <= 8:
        raise ValueError("digits must be between 0 and 8")
    s = F.lit(float(10 ** digits))
    x = col.cast("double")
    y = F.when((F.abs(x * s) >= F.lit(TWO_52)) & (F.abs(x) < F.lit(TWO_52)), x - F.floor(x).cast("double")).otherwise(x)
    p = y * s
    c = F.lit(SPLITTER) * y
    yh = c - (c - y)
    err = (yh * s - p) + (y - yh) * s
    f = F.floor(p).cast("double")
    diff = (p - f) - F.lit(0.5)
    side = F.when(diff != 0, diff).otherwise(err)
    even = (f - F.lit(2.0) * F.floor(f / F.lit(2.0)).cast("double")) == F.lit(0.0)
    n = f + F.when(side > 0, F.lit(1.0)).when(side < 0, F.lit(0.0)).when(even, F.lit(0.0)).otherwise(F.lit(1.0))
    return (F.when(F.isnan(x) | (F.abs(x) >= F.lit(TWO_52)), x)
            .when(y != x, (x - y) + n / s)
            .when(n == 0.0, x * F.lit(0.0)).otherwise(n / s))
