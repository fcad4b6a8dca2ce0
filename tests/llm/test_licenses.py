import random

import pytest

from kpishift.llm.licenses import NOTICES, PHRASES, TEMPLATES, Index, digest, scan_licenses, split_words

from .conftest import CLASHING


def stands(p, w):
    return [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]


def brute(text, threshold=0.8):
    w = split_words(text or "")
    places, base = [], set()
    for phrase, label in PHRASES.items():
        at = stands(split_words(phrase), w)
        places += at
        base |= {label} if at else set()
    labels = base | {label for p, label in NOTICES.items() if stands(split_words(p), w)}
    score = 1.0 if labels else 0.0
    for label, mark, t in TEMPLATES:
        s, span = set(split_words(t)), len(split_words(t))
        for i in range(0, max(1, len(w)), span):
            block = w[i:i + 2 * span]
            share = len(s.intersection(block)) / len(s)
            if share >= threshold - 1e-9 and stands(split_words(mark), block):
                labels.add(label)
                score = max(score, share)
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)


@pytest.mark.parametrize(("text", "labels"), [
    *((t, {label}) for label, _, t in TEMPLATES),
    ("Licensed under CC BY 4.0", {"cc-by"}),
    ("CC BY-SA 4.0", {"cc-by-sa"}),
    ("Released under the BSD license", {"bsd"}),
    ("Released under the MIT license", {"mit"}),
    ("licensed under the Mozilla Public License, version 2.0", {"mpl-2"}),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public "
     "License as published by the Free Software Foundation; either version 2 of the License, or any later version", {"lgpl"}),
    ("Das Haus mit dem Garten. Released under the Apache License, Version 2.0, mit allen Rechten", {"apache-2"}),
    ("Released mit Dank under the license of the house", set()),
    ("all the rights were reserved", set()),
    ("This work is licensed under a Creative Commons Attribution NonCommercial ShareAlike 4.0 International License", set()),
])
def test_neighbouring_licences(text, labels):
    assert set(filter(None, brute(text)[5].split(","))) == labels


def corpus(prose):
    r = random.Random(2)
    texts = []
    for d in range(150):
        w = prose(d, r.randrange(3, 160)).split(" ")
        for _ in range(r.randrange(0, 3)):
            t = r.choice([*(x for *_, x in TEMPLATES), *PHRASES, *PHRASES, *NOTICES]).split(" ")
            for _ in range(r.randrange(0, 4)):
                k = r.randrange(3)
                if k == 0:
                    t[r.randrange(len(t))] = "other"
                elif k == 1 and len(t) > 1:
                    del t[r.randrange(len(t))]
                else:
                    t.insert(r.randrange(len(t)), "the")
            at = r.randrange(len(w) + 1)
            w[at:at] = [x.upper() if d % 4 == 0 else x for x in t]
        texts.append(r.choice([" ", "\n", " - "]).join(w))
    return texts + [None, "", "!!", "under the MIT license under the mit license", "cc-by_nc CC, BY\x00NC", "the " * 30_000 + "cc by nc", "ÉCC BY NC"]


def test_against_brute_force(docs_of, prose):
    texts = corpus(prose) + [t for *_, t in TEMPLATES]
    got = {x.doc_id: tuple(x)[1:] for x in digest(scan_licenses(docs_of(texts, extra=CLASHING))).collect()}
    assert got == {d: brute(t) for d, t in enumerate(texts)}
    assert {label for x in got.values() for label in x[5].split(",")} >= {label for label, *_ in TEMPLATES}
    assert sum(bool(x[5]) for x in got.values()) > 30 and any(0 < x[6] < 1 for x in got.values())


def test_order_of_words_changes_no_match(prose):
    import numpy as np

    from kpishift.llm.common import word_hashes

    words = sorted({w for row in TEMPLATES for t in row for w in split_words(t)})
    for seed in range(5):
        r = random.Random(seed)
        index = Index(TEMPLATES, PHRASES, NOTICES, {w: r.randrange(100) for w in words}, 0.8)
        for t in corpus(prose)[:60]:
            raw = np.frombuffer(t.encode(), np.uint8)
            _, _, labels, score = index.scan(index.number(word_hashes(raw, np.array([0, len(raw)]))[0]))
            assert (",".join(sorted(labels)), score) == brute(t)[5:]


def test_null_and_repeated_ids_and_no_rows(docs_of):
    rows = digest(scan_licenses(docs_of(["cc by nc", "cc by nc", None], [None, 4, 4]))).collect()
    assert sorted((x.doc_id or -1, x.n_base, x.base_labels, x.score) for x in rows) == [(-1, 1, "cc-by-nc", 1.0), (4, 0, "", 0.0), (4, 1, "cc-by-nc", 1.0)]
    assert scan_licenses(docs_of([])).count() == 0
