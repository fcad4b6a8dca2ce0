import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kpishift.llm.common import prefix_hash
from kpishift.llm.editdist import sequences_within, within
from kpishift.llm.lines import dedup_lines, line_classes, segment_keys

from .conftest import CLASHING


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(p[j + 1] + 1, q[-1] + 1, p[j] + (x != y)))
        p = q
    return p[-1]


def packed(strings):
    data = np.frombuffer(b"".join(strings) or b"\x00", np.uint8)
    end = np.cumsum([len(s) for s in strings])
    return data, end - [len(s) for s in strings], end


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=12), st.binary(max_size=12)), min_size=1, max_size=20), st.integers(1, 4))
def test_banded_distance(pairs, limit):
    pairs = [(bytes(x & 3 for x in a), bytes(x & 3 for x in b)) for a, b in pairs]
    data, start, end = packed([s for p in pairs for s in p])
    got = within(data, (start[::2], end[::2]), (start[1::2], end[1::2]), limit)
    assert got.tolist() == [distance(a, b) <= limit for a, b in pairs]


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=6, max_size=40), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 39), st.integers(0, 255)), max_size=3), st.integers(1, 3))
def test_linked_lines_meet_under_a_key(a, edits, limit):
    b = bytearray(a)
    for kind, at, value in edits[:limit]:
        at %= len(b) + 1
        if kind == 0:
            b.insert(at, value)
        elif at < len(b) and len(b) > limit + 1:
            if kind == 1:
                del b[at]
            else:
                b[at] = value
    data, start, end = packed([a, bytes(b)])
    key, line, role = segment_keys(prefix_hash(data), start, end, limit)
    rows = list(zip(key.tolist(), line.tolist(), role.tolist(), strict=True))
    assert any(k == q and x != y and 0 in (r, s) for k, x, r in rows for q, y, s in rows)


def brute(rows, max_edits, min_bytes):
    """Class heads by place for (id, text) rows with distinct ids."""
    lines = []
    for d, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            x = x.encode().strip(b" \t\r\x0b\x0c")
            if len(x) >= min_bytes:
                lines.append(((d, k), x))
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            a, b = lines[i][1], lines[j][1]
            if a == b or (abs(len(a) - len(b)) <= max_edits and distance(a, b) <= max_edits):
                root[find(i)] = find(j)
    head = {}
    for i, (place, _) in enumerate(lines):
        head[find(i)] = min(head.get(find(i), place), place)
    return {lines[i][0]: head[find(i)] for i in range(len(lines))}


def corpus(seed=0, n=60):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdé ") for _ in range(r.randrange(18, 40))).strip() + "xyzuvwxyzuvw" for _ in range(25)]
    rows = []
    for d in range(n):
        lines = []
        for _ in range(r.randrange(0, 7)):
            x = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                k = r.randrange(3)
                if k == 0:
                    x.insert(r.randrange(len(x)), r.choice("abq"))
                elif k == 1:
                    del x[r.randrange(len(x))]
                else:
                    x[r.randrange(len(x))] = r.choice("abq")
            lines.append(r.choice(["", " ", "\t"]) + "".join(x) + r.choice(["", "  "]))
        lines += r.choice([[], [""], ["short"], ["short", ""]])
        rows.append((d, "\n".join(lines)))
    return rows


def check(docs_of, rows, max_edits):
    want = brute(rows, max_edits, 20)
    docs = docs_of([t for _, t in rows], [d for d, _ in rows], extra=CLASHING)
    got = {(x.doc_id, x.number): (x.class_doc, x.class_number, x.is_first) for x in line_classes(docs, max_edits).collect()}
    for place, head in want.items():
        if place in got:
            assert got[place] == (*head, place == head)
        else:
            assert place == head and list(want.values()).count(head) == 1
    assert set(got) <= set(want)
    out = {x.doc_id: x.text for x in dedup_lines(docs, max_edits).collect()}
    for d, t in rows:
        assert out[d] == (None if t is None else "\n".join(
            x for k, x in enumerate(t.split("\n")) if want.get((d, k), (d, k)) == (d, k)))
    assert dedup_lines(docs, max_edits).columns == docs.columns


def test_one_edit_against_brute_force(docs_of):
    check(docs_of, [*corpus(), (1000, None), (1001, ""), (1002, "\n\n"), (1003, "q" * 1500), (1004, "q" * 1499)], 1)


def test_two_edits_against_brute_force(docs_of):
    check(docs_of, corpus(4, 40), 2)


def test_hot_segments_in_blocks(docs_of, monkeypatch):
    import kpishift.llm.lines as m

    inner = m.line_links
    monkeypatch.setattr(m, "line_links", lambda docs, e, b: inner(docs, e, b, block=8))
    r = random.Random(9)
    head = "the very same beginning of many lines "
    check(docs_of, [(d, head + "".join(r.choice("ab") for _ in range(7))) for d in range(90)], 1)


def test_verified_in_slices_of_keys(docs_of, monkeypatch):
    import kpishift.llm.lines as m

    names, inner, saved = [], m.line_links, m.saved
    monkeypatch.setattr(m, "SLICE_BYTES", 1)
    monkeypatch.setattr(m, "saved", lambda df, name: names.append(name) or saved(df, name))
    monkeypatch.setattr(m, "line_links", lambda docs, e, b: inner(docs, e, b, block=8))
    r = random.Random(5)
    head = "the very same beginning of many lines "
    rows = [(d, head + "".join(r.choice("ab") for _ in range(6))) for d in range(24)]
    want = brute(rows, 1, 20)
    out = {x.doc_id: x.text for x in dedup_lines(docs_of([t for _, t in rows])).collect()}
    assert out == {d: t if want[d, 0] == (d, 0) else "" for d, t in rows}
    assert names.count("lines-slice") > 2


def test_shuffle_files_of_a_written_table_go(spark):
    import time

    from kpishift.llm.common import saved

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in (files.apply(k).getName() for k in range(files.size())) if f.startswith("shuffle_")}

    before = shuffled()
    table = saved(spark.range(1000).repartition(3, "id"), "test-shuffled")
    for _ in range(20):  # they are removed in the background
        left = {f for f in shuffled() - before if f.endswith(".data")}
        if not left:
            break
        time.sleep(0.25)
    assert not left
    assert table.count() == 1000


def test_repeated_rows_null_ids_and_no_rows(docs_of):
    line = "a line of more than twenty bytes"
    docs = docs_of([f"{line}\nx", f"{line}\nx", line, line], [3, 3, None, 9])
    assert sorted((x.doc_id or -1, x.text) for x in dedup_lines(docs).collect()) == [(-1, line), (3, "x"), (3, "x"), (9, "")]
    docs = docs_of([f"{line}\nx", f"{line}\nx"], [3, 3])
    assert [x.text for x in dedup_lines(docs).collect()] == [f"{line}\nx"] * 2  # one place, not a repeat
    assert dedup_lines(docs_of([])).count() == 0


def test_exact_repeats_of_short_lines_go(spark, docs_of):
    import corpus_pipeline

    texts = ["Les.\nfirst", "Les.\n\nLes\n ", " Les. \nx\nx", None, "é"]
    out = {x.doc_id: x.text for x in corpus_pipeline.without_repeated_lines(spark, docs_of(texts), "").collect()}
    assert out == {0: "Les.\nfirst", 1: "\nLes\n ", 2: "x", 3: None, 4: "é"}
    assert {x.doc_id: x.text for x in dedup_lines(docs_of(texts)).collect()} == dict(enumerate(texts))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 9))
def test_distance_of_sequences(a, b, limit):
    assert sequences_within(a, b, limit) == (distance(a, b) <= limit)


def grown(a, b):
    """Whether lines a and b are linked with ``grow``."""
    n = min(len(a), len(b))
    edits = n // 10 if n < 80 else 1
    if a == b or (abs(len(a) - len(b)) <= edits and distance(a, b) <= edits):
        return True
    a, b = a.split(), b.split()
    t = min(len(a), len(b)) // 10
    return t > 0 and abs(len(a) - len(b)) <= t and distance(a, b) <= t


def test_threshold_grows_with_the_line(docs_of):
    r = random.Random(12)
    rows = []
    for size in (3, 4, 5, 6, 7, 8, 9, 10, 11, 15, 19, 20, 21, 25, 31, 40, 70):
        for _ in range(2):
            base = ["".join(r.choice("abcdefg") for _ in range(r.randrange(2, 9))) for _ in range(size)]
            for _ in range(7):
                w = list(base)
                for _ in range(r.randrange(0, size // 8 + 2)):
                    k = r.randrange(5)
                    at = r.randrange(len(w))
                    if k == 0:
                        w.insert(at, "new" + r.choice("xyz"))
                    elif k == 1 and len(w) > 1:
                        del w[at]
                    elif k == 2:
                        w[at] = r.choice("rstuv") * 6
                    else:
                        w[at] = w[at][:1] + r.choice(["é", "7", ""]) + w[at][2:]
                rows.append((len(rows), "  ".join(w)))
    texts = [t.encode() for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (texts[i] == texts[j] or min(len(texts[i]), len(texts[j])) >= 20) and find(i) != find(j) and grown(texts[i], texts[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    docs = docs_of([t for _, t in rows], [d for d, _ in rows], extra=CLASHING)
    out = {x.doc_id: x.text for x in dedup_lines(docs, 1, 20, 1, grow=True).collect()}
    assert out == {d: t if find(d) == d else "" for d, t in rows}
    few = {x.doc_id for x in line_classes(docs).where("not is_first").collect()}
    assert len([d for d in out if find(d) != d]) > len(few) + 40


def test_lines_a_tenth_of_their_words_apart_share_a_key():
    from kpishift.llm.common import prefix_hash
    from kpishift.llm.lines import word_keys

    r = random.Random(11)
    for n in [*range(10, 130), 400]:
        for _ in range(4):
            a = [f"w{r.randrange(10 ** 6)}" for _ in range(n)]
            b = list(a)
            t = n // 10
            step = (n + 1) / (t + 1)  # the worst: edits at even distances
            places = [min(len(a) - 1, int(step * (k + 1)) - 1) for k in range(t)] if r.random() < 0.5 else r.sample(range(n), t)
            for p in sorted(places, reverse=True):
                kind = r.choice(["swap", "add"])  # a is the shorter line
                if kind == "swap":
                    b[p] = "x"
                else:
                    b.insert(p, "y")
            texts = [" ".join(a).encode(), " ".join(b).encode()]
            data = np.frombuffer(b"\n".join(texts), np.uint8)
            offsets = np.array([0, len(texts[0]) + 1, len(data)])
            start, end = np.array([0, len(texts[0]) + 1]), np.array([len(texts[0]), len(data)])
            key, line = word_keys(data, offsets, prefix_hash(data), start, end)
            assert set(key[line == 0]) & set(key[line == 1]), (n, places)
