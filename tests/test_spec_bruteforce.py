"""Whole reports on random small data against a plain-Python statement of the rules."""

import random
from collections import defaultdict
from datetime import date

import pytest

from .helpers import run

CUR = (date(2025, 1, 8), date(2025, 1, 14))
PREV = (date(2025, 1, 1), date(2025, 1, 9))   # overlaps the current period on 8 and 9


def spec_report(rows, kpis, top_n, min_impact):
    """rows: (day, k, a, b). Derived r = a / b (0 when b is 0 or null)."""
    sums = defaultdict(lambda: defaultdict(float))
    seen = set()
    for day, k, a, b in rows:
        r = (a / b if a is not None else None) if (b is not None and b != 0) else 0.0
        vals = {"a": a, "b": b, "r": r}
        for period, (lo, hi) in (("c", CUR), ("p", PREV)):
            if day is not None and lo <= day <= hi:
                seen.add(k)
                for m, v in vals.items():
                    if v is not None:
                        sums[(k, period)][m] += v
    out = []
    n = len(kpis)
    for k in seen:
        for i, m in enumerate(kpis):
            c = float(sums[(k, "c")][m] or 0)
            p = float(sums[(k, "p")][m] or 0)
            d = c - p
            pct = (0.0 if c == 0 else (100.0 if c > 0 else -100.0)) if p == 0 else (c - p) / abs(p) * 100
            imp = round(abs(d) * (1 + min(abs(pct), 200) / 200) * (1 + (n - i) / n), 4)
            direction = "up" if d > 0 else "down" if d < 0 else "flat"
            out.append((k, m, i, round(c, 4), round(p, 4), round(d, 4), round(pct, 2), imp, direction))
    out = [o for o in out if o[7] >= min_impact]
    out.sort(key=lambda o: (-o[7], o[2], o[0]))
    return out[:top_n] if top_n else out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_report_matches_spec(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for _ in range(300):
        day = date(2025, 1, rnd.randint(1, 16)) if rnd.random() > 0.05 else None
        k = f"k{rnd.randint(0, 11)}"
        a = float(rnd.randint(-20, 60)) if rnd.random() > 0.05 else None
        b = float(rnd.choice([0, 0, 1, 2, 4, 8, 16])) if rnd.random() > 0.05 else None
        rows.append((day.isoformat() if day else None, k, a, b))
    df = spark.createDataFrame(rows, "d string, k string, a double, b double")
    kpis = ["r", "a", "b"]
    top_n = rnd.choice([None, 7, 20])
    min_impact = rnd.choice([0.0, 5.0])
    got = run(spark, df, ["k"], kpis, ["a", "b"], {"r": "a / b"}, cur=tuple(x.isoformat() for x in CUR),
              prev=tuple(x.isoformat() for x in PREV), top_n=top_n, min_impact=min_impact)
    got_rows = [(r.k, r.metric, r.kpi_index, r.current_value, r.previous_value, r.delta, r.delta_pct,
                 r.impact_score, r.direction) for r in got.insights.orderBy("rank").collect()]
    typed = [(r[0] and date.fromisoformat(r[0]),) + r[1:] for r in rows]
    want = spec_report(typed, kpis, top_n, min_impact)
    assert [g[:3] for g in got_rows] == [w[:3] for w in want]
    for g, w in zip(got_rows, want):
        assert g[3:] == w[3:]
