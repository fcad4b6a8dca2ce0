"""Token ids of whole texts with a public byte-level BPE tokenizer, inside tasks.

The tokenizer never joins a blank or a line end with what stands before it, so
a text whose white space is single blanks and line ends can be encoded piece by
piece: one piece from each of them to the next. All pieces of a batch of texts
are looked up at once in a table of ids, which has one slot per hash and holds
a piece's bytes (up to 24, compared in full) and ids; a comma or full stop after
an ASCII letter is a token of its own and left out of the key. Pieces that the table does
not hold are encoded together, as one text, and parted at the tokens that begin
with the blank or line end. A new piece takes its slot if the piece there was
not met again since the last one that wanted the slot. Any other text, and one that holds
a string listed as an added token, goes to the tokenizer whole. All ways give the ids of encoding the text at once.
"""

from __future__ import annotations

import os
import re

import numpy as np

_OTHER_SPACE = re.compile(r"[^\S \n]")
#: Bytes of a piece and ids of a piece that a slot of the table has room for.
KEY_BYTES, WIDTH = 24, 8
_PLAIN, _PART, _SPACE, _LEAD = range(4)
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 10]] = _PART
_KIND[[9, 11, 12, 13, 28, 29, 30, 31]] = _SPACE
_KIND[[0xC2, 0xE1, 0xE2, 0xE3]] = _LEAD  # first bytes of the white space beyond ASCII
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    def __init__(self, path: str, max_pieces: int = 1 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        # strings that the file lists as tokens of their own: a text with one goes to the tokenizer whole
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self.vocabulary_size = self._tokenizer.get_vocab_size()
        self._begins = np.zeros(self.vocabulary_size, bool)
        for token, number in self._tokenizer.get_vocab().items():
            self._begins[number] = token[0] in "ĠĊ"
        self._mark = np.full(256, -1, np.int64)
        for mark in ",.":
            ids = self._raw([mark])[0]
            if len(ids) == 1:
                self._mark[ord(mark)] = ids[0]
        self._bits = max(1, (max_pieces - 1).bit_length())
        self._keys = np.zeros((1 << self._bits, KEY_BYTES // 8 + 1), np.uint64)  # bytes of the piece, number of its ids
        self._ids = np.zeros((1 << self._bits, WIDTH), np.uint32)
        self._met = np.zeros(1 << self._bits, bool)

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after the other, and their numbers."""
        flat, counts = [], []
        for at in range(0, len(pieces), 2_000):
            part = pieces[at:at + 2_000]
            ids = self._raw([b"".join(part).decode()])[0] if min(map(len, part)) > 1 else np.zeros(0, np.uint32)
            cut = np.flatnonzero(self._begins[ids])
            if len(cut) == len(part):
                flat.append(ids)
                counts.append(np.diff(np.append(cut, len(ids))))
            else:  # a blank or line end alone
                each = self._raw([p.decode() for p in part])
                flat += each
                counts.append(np.fromiter(map(len, each), np.int64, len(each)))
        return np.concatenate(flat), np.concatenate(counts)

    def _store(self, slot: np.ndarray, keys: np.ndarray, ids: np.ndarray):
        slot, first = np.unique(slot, return_index=True)
        free = ~self._met[slot]
        self._met[slot] = False
        self._keys[slot[free]] = keys[first[free]]
        self._ids[slot[free]] = ids[first[free]]

    def _whole(self, texts: list[str | None], kind: np.ndarray, offsets: np.ndarray, part: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Texts with other white space than single blanks and line ends, or with an added token."""
        whole = np.fromiter((bool(t) and any(a in t for a in self._added) for t in texts), bool, len(texts))
        twice = np.flatnonzero(np.diff(part) == 1)
        whole[row[twice[row[twice] == row[twice + 1]]]] = True
        whole[np.searchsorted(offsets, np.flatnonzero(kind == _SPACE), "right") - 1] = True
        for i in np.unique(np.searchsorted(offsets, np.flatnonzero(kind == _LEAD), "right") - 1).tolist():
            whole[i] = whole[i] or bool(_OTHER_SPACE.search(texts[i]))
        return whole

    def _piece_ids(self, blob: bytes, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces (byte spans) one after the other, and where each one's begin (one more than pieces)."""
        mark = np.where((end - start > 2) & _LETTER[data[end - 2]], self._mark[data[end - 1]], -1)
        marked = np.flatnonzero(mark >= 0)
        stop = end - (mark >= 0)
        size = stop - start
        view = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        keys = np.empty((len(start), self._keys.shape[1]), np.uint64)
        slot = np.zeros(len(start), np.uint64)
        for k in range(KEY_BYTES // 8):
            keys[:, k] = view[start + 8 * k] & _LOW_BYTES[np.clip(size - 8 * k, 0, 8)]
            slot = (slot ^ keys[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            slot ^= slot >> np.uint64(32)
        slot = ((slot * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - self._bits)).astype(np.int64)
        there = self._keys[slot]
        known = (there[:, :-1] == keys[:, :-1]).all(axis=1) & (size <= KEY_BYTES)
        counts = np.where(known, there[:, -1].astype(np.int64), 0)
        new = np.flatnonzero(~known)
        spans = [blob[a:b] for a, b in zip(start[new].tolist(), stop[new].tolist(), strict=True)]
        number = {p: i for i, p in enumerate(dict.fromkeys(spans))}
        if number:
            fresh, lengths = self._fresh(list(number))
            begin = np.cumsum(lengths) - lengths
            which = np.fromiter(map(number.__getitem__, spans), np.int64, len(spans))
            counts[new] = lengths[which]
        at = np.zeros(len(start) + 1, np.int64)
        np.cumsum(counts + (mark >= 0), out=at[1:])
        out = np.empty(at[-1], np.uint32)
        some = np.flatnonzero(known)
        self._met[slot[some]] = True
        for k in range(WIDTH):
            some = some[counts[some] > k]
            out[at[some] + k] = self._ids[slot[some], k]
        if number:
            n = counts[new]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(at[new], n) + step] = fresh[np.repeat(begin[which], n) + step]
            one = np.empty(len(number), np.int64)
            one[which] = new  # a place of each new piece
            fits = np.flatnonzero((size[one] <= KEY_BYTES) & (lengths <= WIDTH))
            keys[one, -1] = lengths
            ids = np.zeros((len(fits), WIDTH), np.uint32)
            for k in range(WIDTH):
                longer = np.flatnonzero(lengths[fits] > k)
                ids[longer, k] = fresh[begin[fits[longer]] + k]
            self._store(slot[one[fits]], keys[one[fits]], ids)
        out[at[marked + 1] - 1] = mark[marked]
        return out, at

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """uint32 ids of each text (a null is an empty text)."""
        raw = [t.encode() if t else b"" for t in texts]
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)), out=offsets[1:])
        blob = b"".join([*raw, bytes(KEY_BYTES)])  # keys are read past the last piece
        data = np.frombuffer(blob, np.uint8)
        kind = _KIND[data[:offsets[-1]]]
        part = np.flatnonzero(kind == _PART)
        row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(part, offsets)))
        whole = self._whole(texts, kind, offsets, part, row)
        end = np.minimum(np.append(part[1:], offsets[-1]), offsets[row + 1]) if len(part) else part
        keep = ~whole[row]
        start, end, row = part[keep], end[keep], row[keep]
        flat, at = self._piece_ids(blob, data, start, end)
        first = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
        # a text's head: what stands before its first piece, and the texts taken whole
        heads = [t or "" if w else r[:start[a] - o if a < b else len(r)].decode()
                 for t, w, r, o, a, b in zip(texts, whole.tolist(), raw, offsets.tolist(), first[:-1], first[1:], strict=False)]
        return [np.concatenate([head, flat[at[a]:at[b]]]) if a < b else head
                for head, a, b in zip(self._raw(heads), first[:-1], first[1:], strict=True)]


def encoder(path: str) -> Encoder:
    """One encoder per file and process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
