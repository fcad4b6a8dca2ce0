import random
import re

import numpy as np
from pyspark.sql import functions as F

from kpishift.llm.repetition import neighbour_prefixes, repeated_spans, repetition_rules, suffix_array

from .conftest import CLASHING


def brute(text, min_words=5, window=8, longest=100, share=20):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(ws)

    def covered(size):
        seen, out = {}, set()
        for i in range(n - size + 1):
            seen.setdefault(tuple(ws[i:i + size]), []).append(i)
        for places in seen.values():
            if len(places) > 1:
                out.update(p + k for p in places for k in range(size))
        return out

    def stands_twice(size):
        all_of = [tuple(ws[i:i + size]) for i in range(n - size + 1)]
        return len(set(all_of)) < len(all_of)

    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeated = len(covered(window))
    chars = sum(map(len, ws))
    inside = sum(len(ws[i]) for i in covered(min_words))
    failed = n < 20 or 100 * repeated > 30 * n
    least = max(longest + 1, share * n // 100 + 1)  # a longer repeat holds one of this length
    too_long = least <= n and stands_twice(least)
    return (n, chars, sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeated, inside, failed,
            not failed and 100 * inside <= 30 * chars and not too_long)


def test_suffix_array_and_prefixes():
    r = random.Random(5)
    for _ in range(200):
        x = [r.randrange(r.choice([1, 2, 6])) for _ in range(r.randrange(50))]
        x = x * r.choice([1, 1, 2, 3])
        order = suffix_array(np.array(x, np.int64))
        assert order.tolist() == sorted(range(len(x)), key=lambda i: x[i:])

        def common(i, j):
            k = 0
            while max(i, j) + k < len(x) and x[i + k] == x[j + k]:
                k += 1
            return k

        want = [max((common(i, j) for j in range(len(x)) if i != j), default=0) for i in range(len(x))]
        assert neighbour_prefixes(np.array(x, np.int64), order).tolist() == want


def texts_of(prose):
    r = random.Random(2)
    p = [prose(i, r.randrange(0, 300), 200) for i in range(60)]
    p += [x.replace(" ", "\n", 3) + "\n" + x[:len(x) // 2] for x in p[:10]]  # a part stands twice
    p += [prose(90, 700) + " " + prose(91, 150) + " " + prose(92, 700) + " " + prose(91, 150)]  # 150 of 1700 words twice: short enough
    p += [prose(93, 250) + " " + prose(94, 110) + " " + prose(95, 30) + " " + prose(94, 110)]  # over 100 words, over a fifth
    p += ["a " * 400, "one line\none line\n \n \n\tone line", "", None, " \n\t\x0b", "é ü #*$%&|<> ß\x1c\x85 x " * 3, "x" * 100_000, "ab cd " * 20_000]
    return p


def test_against_brute_force(spark, docs_of, prose):
    texts = texts_of(prose)
    small = [t for t in texts if t is None or len(t) < 50_000]
    ids = [None if i % 9 == 4 else i // 2 for i in range(len(small))]
    got = repetition_rules(docs_of(small, ids=ids, extra=CLASHING).repartition(3)).drop("longest_repeat").collect()
    want = [(i, *brute(t)) for i, t in zip(ids, small, strict=True)]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    kept = [brute(t)[-1] for t in small]
    assert any(kept) and not all(kept)
    assert brute(texts[70])[-1] and not brute(texts[71])[-1]


def test_very_long_repetitive_text_and_empty_table(docs_of):
    rows = repetition_rules(docs_of(["ab cd " * 100_000, "x" * 3_000_000, "a b"])).orderBy("doc_id").collect()
    assert (rows[0]["n_words"], rows[0]["n_repeat_words"], rows[0]["longest_repeat"]) == (200_000, 200_000, 199_998)
    assert rows[1]["word_chars"] == 3_000_000 and not any(r["kept"] for r in rows)
    assert repetition_rules(docs_of(["a"]).where("false")).count() == 0
    assert repeated_spans(docs_of(["a"]).where("false")).count() == 0


def test_spans(docs_of):
    a, b = "v w x y z", "1 2 3 4 5 6"
    rows = repeated_spans(docs_of([f"{a} p {b} q {a} {b}", f"{a}", f"{a} {b} {a}"])).orderBy("doc_id", "first_word").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 5), (0, 6, 6), (0, 13, 11), (2, 0, 5), (2, 11, 5)]
    # the words of a text never match another text's
    assert repeated_spans(docs_of([a, a]).withColumn("n", F.lit(1))).count() == 0
