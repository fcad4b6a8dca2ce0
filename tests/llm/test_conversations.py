import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from kpishift.llm.conversations import damage, repair

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def text_of(x):
    return " " if x is None else str(x)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = text_of(role), text_of(text)
        kind = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def edits(rows, bad, truncated):
    """All audits of at most two insertions in a row, by enumeration: (cost, audit, repaired rows)."""
    best = None
    options = []
    for (_, _, role, text), b, t in zip(rows, bad, truncated, strict=True):
        here = [("D", 4, [])]
        if not b:
            here += [("K", 3 * t, [(role, text)])] + [("R", 3 + 3 * t, [(r, text)]) for r in ("user", "assistant")]
        options.append(here)
    inserts = [("", 0, [])] + [("I" * n, 3 * n, [(r, "") for r in rs]) for n in (1, 2) for rs in itertools.product(("user", "assistant"), repeat=n)]
    for choice in itertools.product(*itertools.chain.from_iterable((inserts, o) for o in options), inserts):
        audit, cost = "".join(c[0] for c in choice), sum(c[1] for c in choice)
        if best is not None and (cost, audit) >= best[:2]:
            continue
        kept = [x for c in choice for x in c[2]]
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in kept)):
            best = cost, audit, kept
    return best


def audit_by_strings(rows, bad, truncated):
    """The same by carrying every state's least (cost, audit, repaired rows) from the front: no ranks, no pointers."""
    def least(a, b):
        return min((x for x in (a, b) if x is not None), key=lambda x: x[:2], default=None)

    moves = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    now = {"": (0, "", ())}

    def insert(states):
        for _ in range(3):
            for q, (c, a, k) in list(states.items()):
                r = "assistant" if q == "u" else "user"
                states[r[0]] = least(states.get(r[0]), (c + 3, a + "I", (*k, (r, ""))))
        return states

    now = insert(now)
    for (_, _, role, text), b, t in zip(rows, bad, truncated, strict=True):
        after = {}
        for q, (c, a, k) in now.items():
            after[q] = least(after.get(q), (c + 4, a + "D", k))
            if not b:
                for r, w, letter in ((role, 0, "K"), ("assistant" if q == "u" else "user", 3, "R")):
                    s = moves.get((q, r[:1]))
                    if s:
                        after[s] = least(after.get(s), (c + w + 3 * t, a + letter, (*k, (r, text))))
        now = insert(after)
    return min((now[q] for q in ("", "a") if q in now), key=lambda x: x[:2])


def brute(rows, find=audit_by_strings):
    out = []
    hurt = damaged(rows)
    for conv in dict.fromkeys(r[0] for r in rows):
        mine = sorted((r for r in hurt if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, blank, duplicate, truncated = set(), [], [], []
        for _, _, role, text in mine:
            ink = re.findall(r"[^\x20\x09-\x0D]", text)
            blank.append(not ink)
            duplicate.append(bool(ink) and (role, text) in seen)
            truncated.append(not blank[-1] and not duplicate[-1] and ink[-1] not in ".!?")
            seen.add((role, text))
        illegal = sum((a[2][:1], b[2][:1]) not in (("s", "u"), ("u", "a"), ("a", "u")) for a, b in itertools.pairwise(mine))
        cost, audit, kept = find(mine, [a or b for a, b in zip(blank, duplicate, strict=True)], truncated)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv, gaps, sum(blank), sum(duplicate), sum(truncated), illegal, cost, audit, sha))
    return sorted(out, key=str)


def random_rows(seed, convs, longest):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        turn = r.randrange(5)
        for _ in range(r.randrange(1, longest + 1)):
            turn += r.choice([0, 1, 1, 1, 1, 4])
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool", "unknown", "", None])
            text = r.choice(["Yes.", "No!", "Why?\n", "cut off", " \t", "", None, "Ende. é", "é!", f"t{r.randrange(3)}."])
            rows.append((c if c % 17 else None, r.choice([turn] * 9 + [None]), role, text))
    return rows


def result(df, block=4096):
    return sorted((tuple(r[c] for c in COLUMNS) for r in repair(damage(df), block).collect()), key=str)


def test_enumeration_of_all_edits_agrees():
    rows = [r for r in random_rows(1, 60, 2) if r[0] is not None]
    many = {c for c in range(60) if sum(r[0] == c for r in damaged(rows)) > 3}
    rows = [r for r in rows if r[0] not in many]
    assert brute(rows) == brute(rows, edits)


@pytest.mark.parametrize("block", [4096, 1, 3])
def test_against_brute_force(spark, block):
    rows = random_rows(7, 160, 14)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for name in ("kind", "gone", "part", "no", "h", "pos", "audit"):
        df = df.withColumn(name, F.lit("x"))
    assert result(df, block) == brute(rows)


@pytest.mark.parametrize("block", [4096, 16])
def test_one_conversation_holds_most_rows(spark, block):
    r = random.Random(9)
    rows = random_rows(8, 20, 6) + [(500, t, r.choice(["user", "assistant"]), r.choice(["Same.", f"No {t}.", "open end"])) for t in range(700)]
    rows += [(501, None, "user", "x")] * 40  # the same row again and again, without a turn
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(6), block) == brute(rows)


def test_dropped_conversations_long_texts_and_empty_table(spark):
    gone = [c for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    rows = [(c, 0, "user", "Hello.") for c in gone] + [(7000, 1, "user", "w " * 200_000 + "."), (7000, 2, "assistant", "é" * 300_000 + "!")]
    rows += [(7001, -(1 << 63), "user", "A."), (7001, (1 << 63) - 1, "assistant", "B.")]
    want = brute(rows)
    want = [(*w[:1], min(w[1], (1 << 63) - 1), *w[2:]) for w in want]
    assert result(spark.createDataFrame(rows, SCHEMA)) == want
    assert sum(w[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for w in want) >= 3
    assert result(spark.createDataFrame([], SCHEMA)) == []
