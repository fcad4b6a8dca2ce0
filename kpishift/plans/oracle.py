"""Plain-SQL (DuckDB dialect) statements of the same reports, for cross-checks.

The scoring formulas are written out in SQL here independently of the
DataFrame code; the catalogue pairs each Spark query with one of these.
Rounding is DuckDB's own ``printf``, which prints the exact binary value
rounded to even, so nothing of the Spark side is used here.
"""

from __future__ import annotations


def rnd(expr: str, digits: int) -> str:
    """Rounding to ``digits`` decimals through the printed number."""
    return f"CAST(printf('%.{digits}f', CAST({expr} AS DOUBLE)) AS DOUBLE)"


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def period_sql(expr: str, start: str, end: str) -> str:
    return f"({expr} BETWEEN DATE '{start}' AND DATE '{end}')"


def safe_div_sql(a: str, b: str) -> str:
    return f"CASE WHEN CAST({b} AS DOUBLE) <> 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) ELSE 0.0::DOUBLE END"


def aggregate_sql(fact: str, date_expr: str, group: list[str], metrics: dict[str, str], cur: tuple, prev: tuple,
                  metric_casts: dict[str, str] | None = None, decimal: bool = False) -> str:
    """Wide per-period sums ``m_current`` / ``m_previous`` (0 when none)."""
    metric_casts = metric_casts or {}
    base_cols = [q(g) for g in group] + [f"{e} AS {q(m)}" for m, e in metrics.items()] + [f"{date_expr} AS __d"]
    in_c, in_p = period_sql("__d", *cur), period_sql("__d", *prev)
    sums = []
    for m in metrics:
        cast = metric_casts.get(m)
        for flag, suf in ((in_c, "current"), (in_p, "previous")):
            picked = f"CASE WHEN {flag} THEN {q(m)} END"
            s = f"coalesce(sum({picked}), 0)"
            if decimal:  # numbers as exact decimals; NaN and infinities by their double sum
                odd = f"isnan({picked}) OR isinf({picked})"
                s = (f"coalesce(sum({picked}) FILTER (WHERE {odd}), "
                     f"CAST(sum(CAST(CASE WHEN NOT ({odd}) THEN {picked} END AS DECIMAL(38, 10))) AS DOUBLE), 0)")
            sums.append(f"{('CAST(' + s + ' AS ' + cast + ')') if cast else s} AS {q(m + '_' + suf)}")
    group_by = f" GROUP BY {', '.join(q(g) for g in group)}" if group else ""
    sel = ", ".join([q(g) for g in group] + sums)
    return (f"SELECT {sel} FROM (SELECT {', '.join(base_cols)} FROM ({fact}) f) b "
            f"WHERE {in_c} OR {in_p}{group_by}")


def insights_sql(fact: str, date_expr: str, dims: list[str], metrics: dict[str, str], kpis: list[str],
                 cur: tuple, prev: tuple, top_n: int | None = 20, min_impact: float = 0.0,
                 keys: list[str] = (), decimal: bool = False) -> str:
    keys = list(keys)
    group = keys + list(dims)
    agg = aggregate_sql(fact, date_expr, group, metrics, cur, prev, decimal=decimal)
    n = len(kpis)
    present = [(i, k) for i, k in enumerate(kpis) if k in metrics]
    gcols = "".join(q(g) + ", " for g in group)
    long = " UNION ALL ".join(
        f"SELECT {gcols}'{k}' AS metric, {i} AS kpi_index, CAST({q(k + '_current')} AS DOUBLE) AS c, "
        f"CAST({q(k + '_previous')} AS DOUBLE) AS p FROM agg" for i, k in present)
    sc = ("SELECT *, c - p AS dl, CASE WHEN p = 0 THEN CASE WHEN c = 0 THEN 0.0::DOUBLE "
          "WHEN c > 0 AND NOT isnan(c) THEN 100.0::DOUBLE ELSE -100.0::DOUBLE END "
          "ELSE (c - p) / abs(p) * 100.0::DOUBLE END AS dp FROM long")
    raw_impact = (f"abs(dl) * (1.0::DOUBLE + least(abs(dp), 200.0::DOUBLE) / 200.0::DOUBLE) * "
                  f"(1.0::DOUBLE + ({n}.0::DOUBLE - kpi_index) / {n}.0::DOUBLE)")
    fin = (f"SELECT {gcols}metric, kpi_index, {rnd('c', 4)} AS current_value, {rnd('p', 4)} AS previous_value, "
           f"{rnd('dl', 4)} AS delta, {rnd('dp', 2)} AS delta_pct, "
           f"{rnd(raw_impact, 4)} AS impact_score, "
           f"CASE WHEN dl > 0 AND NOT isnan(dl) THEN 'up' WHEN dl < 0 THEN 'down' ELSE 'flat' END AS direction "
           f"FROM sc")
    part = f"PARTITION BY {', '.join(q(k) for k in keys)} " if keys else ""
    order = ", ".join(["impact_score DESC", "kpi_index"] + [f"{q(d)} ASC NULLS FIRST" for d in dims])
    number = "INTEGER" if top_n else "BIGINT"
    rk = (f"SELECT *, CAST(row_number() OVER ({part}ORDER BY {order}) AS {number}) AS rank FROM fin "
          f"WHERE impact_score >= {float(min_impact)!r} AND NOT isnan(impact_score)")
    limit = f" WHERE rank <= {int(top_n)}" if top_n else ""
    return (f"WITH agg AS ({agg}), long AS ({long}), sc AS ({sc}), fin AS ({fin}), rk AS ({rk}) "
            f"SELECT * FROM rk{limit}")


def fmt_sql(expr: str, digits: int, sign: bool = False) -> str:
    return f"printf('%{'+' if sign else ''}.{digits}f', {rnd(expr, digits)})"


def thousands_sql(expr: str) -> str:
    return f"format('{{:,.2f}}', {rnd(expr, 2)})"
