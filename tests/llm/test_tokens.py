import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpishift.llm.packing import pack, sequences
from kpishift.llm.queries import tokenizer_path
from kpishift.llm.records import frame, read_at, read_records, unframe, with_starts, write_records
from kpishift.llm.tokens import Encoder

from .conftest import CLASHING


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def awkward():
    r = random.Random(3)
    alphabet = [*"abcé ,.\n\t'", "  ", "\n\n", " \n", "'s", "<|endoftext|>", " ", "漢", "\x1c", "3.5", ", "]
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(25))) for _ in range(400)] + [None, "", " ", "\n", "a b " * 3000]


def test_pieces_give_the_ids_of_whole_texts(plain):
    texts = awkward()
    for most in (1_000_000, 40):  # 40: pieces are forgotten again and again
        enc = Encoder(tokenizer_path(), max_pieces=most)
        for at in range(0, len(texts), 50):
            for text, ids in zip(texts[at:at + 50], enc.encode(texts[at:at + 50]), strict=True):
                assert ids.tolist() == plain(text), text


def test_pack_against_brute_force(docs_of, plain):
    texts = [*awkward()[-60:], "x y" * 900]
    ids = [*range(len(texts) - 2), None, 0]
    docs = docs_of(texts, ids, extra=CLASHING).repartition(3)
    size = 64
    got = pack(docs, tokenizer_path(), size=size, end_id=1).collect()
    whole = sorted((i is not None, i or 0, tuple([*plain(t), 1])) for i, t in zip(ids, texts, strict=True))
    by_place = sorted(got, key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for r in by_place:  # gapless windows, cut at their boundaries only
        assert r.sequence_id * size + r.offset == at and r.offset + r.length <= size
        at += r.length
    assert at == sum(len(w[2]) for w in whole)
    rebuilt, rest = [], {}
    for r in by_place:
        part = np.frombuffer(bytes(r.ids), "<u4").tolist()
        key = r.doc_id
        rest.setdefault(key, [])
        assert r.start == len(rest[key]) and len(part) == r.length
        rest[key] += part
        if len(rest[key]) == r.doc_tokens:
            rebuilt.append((key is not None, key or 0, tuple(rest.pop(key))))
    assert sorted(rebuilt) == whole and not rest
    windows = sequences(pack(docs, tokenizer_path(), size=size, end_id=1), size, pad_id=7).collect()
    assert all(len(bytes(w.ids)) == 4 * size and len(w.boundaries) == len(w.doc_ids) for w in windows)
    assert sorted(w.sequence_id for w in windows) == list(range(-(-at // size)))
    last = max(windows, key=lambda w: w.sequence_id)
    assert np.frombuffer(bytes(last.ids), "<u4")[last.length:].tolist() == [7] * (size - last.length)


def test_pack_of_nothing(docs_of):
    assert pack(docs_of([]), tokenizer_path()).count() == 0


def test_records_round_trip(spark, docs_of, plain, tmp_path):
    texts = awkward()[-80:]
    ids = [*range(100, 100 + len(texts) - 3), 100, 100, None]
    index = write_records(docs_of(texts, ids, extra=CLASHING).repartition(4), str(tmp_path / "out"), tokenizer_path(), end_id=0)
    got = with_starts(read_records(spark, str(tmp_path / "out")), index).withColumn("crc", F.crc32("ids")).collect()
    want = sorted(((i is not None, i or 0, t is not None, t or "", i, [*plain(t), 0]) for i, t in zip(ids, texts, strict=True)), key=lambda x: x[:4])
    start, expected = 0, []
    for *_, i, tokens in want:
        expected.append((i, start, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes())))
        start += len(tokens)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.crc) for r in got), key=lambda x: x[1]) == expected
    for r in index.limit(20).collect():  # single records, out of order
        doc_id, tokens = read_at(r.file, r.offset)
        assert doc_id == r.doc_id and len(tokens) == r.n_tokens


def test_records_of_nothing(spark, docs_of, tmp_path):
    index = write_records(docs_of([]), str(tmp_path / "none"), tokenizer_path())
    assert index.count() == 0 and with_starts(read_records(spark, str(tmp_path / "none")), index).count() == 0


def test_damage_is_found():
    import io

    good = frame(b"some payload")
    assert unframe(io.BytesIO(good)) == b"some payload" and unframe(io.BytesIO(b"")) is None
    for k in range(len(good)):
        bad = bytearray(good)
        bad[k] ^= 4
        with pytest.raises(ValueError):
            unframe(io.BytesIO(bytes(bad)))
    with pytest.raises(ValueError):
        unframe(io.BytesIO(good[:-1]))
