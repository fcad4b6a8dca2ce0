"""Line dedup: an edit-distance join by segments, then one line of each class stays.

A line is what stands between line ends, without white space around it; lines
of at least ``min_bytes`` take part. Two lines are linked if at most
``max_edits`` edits (of UTF-8 bytes) part them; classes are connected components.
With ``grow`` the threshold grows with the shorter line: under 80 bytes, a tenth
of its bytes; from 10 words on, a tenth of its words, exchanged, added or left
out (words between white space, of any length, lines of any length).

Join: a line of n bytes is cut into max_edits + 1 segments. Of two linked lines,
one holds a segment of the other unchanged, at a place that differs by few
bytes. Every line is indexed under (length, segment number, segment), and probes
the lengths it can be linked with at the places where the segment can stand
(multi-match-aware selection). Where several edits are allowed, a bit table of the indexed
keys, of fixed size, drops most probes that no line is indexed under before
they are shuffled (with some 10^8 keys it has filled up and drops few). Lines meeting under a key are verified by banded
bit-parallel edit distance. Keys held by one line end before any text is
moved, and lines without a shared key are left out before the shuffle by a bit
table of fixed size (some others pass it; the join drops them). Keys with many
lines are verified in pairs of blocks, in tasks of bounded size, and give at
most a spanning set of links. Each line is written once with all its keys; the
keys are verified in slices, of which only one is shuffled with its texts at a time.

Of each class the first line stays: least document id (null first), then the
hash of the text, then the line's number. Rows with the same id and text are one
place: neither repeats the other. Null texts stay null; lines of less than
``min_bytes`` stay, unless ``exact_bytes`` lets their exact repeats go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NON_SPACE_BYTES, discard, mix, passing_shuffles, prefix_hash, saved, scratch_block, span_hash, text_chunks, words
from .components import components
from .editdist import sequences_within, within
from .groups import whole_runs

_NOT_END = np.ones(256, bool)
_NOT_END[10] = False
_SEED = np.uint64(0x5851F42D4C957F2D)


def line_spans(data: np.ndarray, offsets: np.ndarray):
    """(row, number, start, end) of all lines that are not blank, white space around them left out."""
    inside = NON_SPACE_BYTES[data]
    lead = np.cumsum(np.concatenate([[0], data == 10]))
    start, end, first = words(data, offsets, _NOT_END)
    row = np.searchsorted(first, np.arange(len(start)), "right") - 1
    number = lead[start] - lead[offsets[row]]
    ink = np.flatnonzero(inside)
    a, b = np.searchsorted(ink, start), np.searchsorted(ink, end)
    some = b > a
    return row[some], number[some], ink[a[some]], ink[b[some] - 1] + 1


def _hashes(prefix, start, end):
    h = span_hash(prefix, start, end)
    return h, mix(h ^ _SEED) ^ span_hash(prefix, start, start + (end - start) // 2)


#: With ``grow``: a tenth of the bytes of lines under LONG bytes, a tenth of the words from WORDY words on.
TENTH, LONG, WORDY = 10, 80, 10
GRAM = 4  # words of a gram
#: (up to so many words, grams in a window): see :func:`word_keys`.
WINDOWS = ((20, 2), (42, 3), (97, 5), (np.iinfo(np.int64).max, 6))


def edit_bands(max_edits: int, min_bytes: int, grow: bool) -> list[tuple[int, int, int]]:
    """(from, to, edits): how many edits of bytes may part lines of which the shorter has from <= bytes < to."""
    top = np.iinfo(np.int64).max // 2
    if not grow or min_bytes >= LONG:
        return [(min_bytes, top, max_edits)]
    return [*((max(n, min_bytes), n + TENTH, max(max_edits, n // TENTH)) for n in range(min_bytes // TENTH * TENTH, LONG, TENTH)),
            (LONG, top, max_edits)]


def word_keys(data: np.ndarray, offsets: np.ndarray, prefix: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(key, line number): the least gram of every window of grams, for lines of at least WORDY words.

    Of two lines at most t, a tenth of the shorter one's w words, apart, w - t of these are unchanged, in at most t + 1 runs.
    So one run has (w - t) / (t + 1) words, rounded up: 5 at least, 6 from w = 20 on, 8 from 40 and 9 from 90 on, or a window
    of 2, 3, 5 and 6 grams. The least gram of a window is also that of a narrower one in it, so both lines have a key in
    common if neither takes a wider window than the shorter line's run has: 20 words may face 19, 42 face 39, 97 face 89.
    """
    begin, stop, _ = words(data, offsets, NON_SPACE_BYTES)
    first, last = np.searchsorted(begin, start), np.searchsorted(begin, end)
    lines = np.flatnonzero(last - first >= WORDY)
    h = span_hash(prefix, begin, stop)
    gram = h[:max(0, len(h) - GRAM + 1)].copy()
    for k in range(1, GRAM):
        gram = gram * np.uint64(0x100000001B3) + h[k:k + len(gram)]
    gram = mix(gram)
    n = (last - first)[lines]
    width = np.array([w for _, w in WINDOWS])[np.searchsorted([most for most, _ in WINDOWS], n)]
    count = n - GRAM + 1 - (width - 1)
    which = np.repeat(np.arange(len(lines)), count)
    at = first[lines][which] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    least = gram[at]
    for k in range(1, WINDOWS[-1][1]):
        wide = np.flatnonzero(width[which] > k)
        least[wide] = np.minimum(least[wide], gram[at[wide] + k])
    fresh = np.ones(len(least), bool)
    fresh[1:] = (least[1:] != least[:-1]) | (which[1:] != which[:-1])
    return mix(least[fresh] ^ _SEED), lines[which[fresh]]


def segment_keys(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, max_edits: int, shortest: int = 0,
                 below: int = np.iinfo(np.int64).max, own_only: bool = False):
    """(key, line number, role): role 0 where the key is of the line's own segments, 1 where it is a probe.

    Lines of ``shortest`` <= bytes < ``below`` are indexed. ``own_only``: no probes.
    """
    length, t = end - start, max_edits
    keys, lines, roles = [], [], []

    def add(which, n, i, at, size, role):
        h = span_hash(prefix, at[which], at[which] + size[which])
        keys.append(mix(h + (n[which] * (t + 1) + i).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        lines.append(which)
        roles.append(np.full(len(which), role, np.int8))

    every = np.arange(len(start))
    for less in range(1 if own_only else t + 1):  # lengths of the indexed line: own length minus less
        n = length - less
        short, longer = n // (t + 1), n % (t + 1)
        for i in range(t + 1):
            size = short + (i >= t + 1 - longer)
            place = i * short + np.maximum(0, i - (t + 1 - longer))
            low = np.maximum.reduce([place - i, place + less - (t - i), np.zeros_like(place)])
            high = np.minimum.reduce([place + i, place + less + (t - i), length - size])
            for shift in range(0, 1) if own_only else range(-i, i + 1):
                at = place + shift
                which = every[(at >= low) & (at <= high) & (short >= 1) & (n >= shortest) & (n < below)]
                own = less == 0 and shift == 0
                add(which, n, i, start + at, size, 0 if own else 1)
    return np.concatenate(keys), np.concatenate(lines), np.concatenate(roles)


def _occurrence_batches(min_bytes: int):
    def run(batches):
        for batch, offsets, data in text_chunks(batches):
            row, number, start, end = line_spans(data, offsets)
            some = end - start >= min_bytes
            row, number, start, end = row[some], number[some], start[some], end[some]
            h1, h2 = _hashes(prefix_hash(data), start, end)
            ids = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()).take(ids), batch.column("text_hash").take(ids), pa.array(number.astype(np.int32)),
                 pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=["doc_id", "text_hash", "number", "h1", "h2"])

    return run


def _distinct_lines(data, offsets, min_bytes):
    row, number, start, end = line_spans(data, offsets)
    some = end - start >= min_bytes
    start, end = start[some], end[some]
    prefix = prefix_hash(data)
    h1, _ = _hashes(prefix, start, end)
    h1, at = np.unique(h1, return_index=True)
    return prefix, h1, start[at], end[at]


def _index_batches(min_bytes: int, max_edits: int, grow: bool):
    """Keys under which lines of bands with several edits are indexed."""
    bands = [b for b in edit_bands(max_edits, min_bytes, grow) if b[2] > 1]

    def run(batches):
        for _, offsets, data in text_chunks(batches):
            prefix, _, start, end = _distinct_lines(data, offsets, min_bytes)
            for low, high, edits in bands:
                some = np.flatnonzero((end - start >= low) & (end - start < high))
                if len(some):
                    key, _, _ = segment_keys(prefix, start[some], end[some], edits, low, high, own_only=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])

    return run


def _key_batches(min_bytes: int, max_edits: int, grow: bool, indexed=None):
    """Key rows of all lines; in bands with several edits, probes of keys under which no line is indexed are left out."""
    bands = edit_bands(max_edits, min_bytes, grow)

    def run(batches):
        table = indexed.value if indexed is not None else None
        for _, offsets, data in text_chunks(batches):
            prefix, h1, start, end = _distinct_lines(data, offsets, min_bytes)
            if not len(h1):
                continue
            for low, high, edits in bands:
                some = np.flatnonzero((end - start >= low) & (end - start < high + edits))
                key, line, role = segment_keys(prefix, start[some], end[some], edits, low, high)
                if edits > 1:
                    hit = (role == 0) | _in_table(table, key)
                    key, line, role = key[hit], line[hit], role[hit]
                yield _key_rows(key, role, h1[some[line]])
            if grow:
                key, line = word_keys(data, offsets, prefix, start, end)
                yield _key_rows(key, np.zeros(len(key), np.int8), h1[line])

    return run


def _key_rows(key, role, line) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(role), pa.array(line.view(np.int64))],
                                      names=["key", "role", "line"])


FILTER_BITS = 25  # a table of 4 MB, whatever the number of lines
INDEX_BITS = 28  # one of 32 MB


def bit_table(ids: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Bytes of a table with bit (id mod 2^bits) set for every id of the one column."""
    place = F.pmod(F.col(ids.columns[0]), F.lit(1 << bits)) + 1
    with passing_shuffles(ids.sparkSession):
        rows = ids.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()  # at most 2^(bits - 15) of 4 KB
    table = np.zeros(((1 << bits) >> 15, 4096), np.uint8)
    for r in rows:
        table[r["bucket"] - 1] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return table.reshape(-1)


def _in_table(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    low = (ids & np.uint64(8 * len(table) - 1)).astype(np.int64)
    return (table[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1


def _line_batches(min_bytes: int, shared):
    def run(batches):
        table = shared.value
        for _, offsets, data in text_chunks(batches):
            _, h1, start, end = _distinct_lines(data, offsets, min_bytes)
            some = _in_table(table, h1)
            h1, start, end = h1[some], start[some], end[some]
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)),
                                              pa.array([raw[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)], pa.binary())],
                                             names=["id", "bytes"])

    return run


def _shared_batches(block: int):
    """Of rows sorted by key, role, line: those whose key holds two lines, one of them indexed; ``blk`` counts blocks of a key."""
    def run(batches):
        # state of the key that the last row of the batch before belongs to
        key_before = line_before = None
        first_role = distinct = 0
        pending: pa.RecordBatch | None = None  # the one row of a key that has no second line yet
        for batch in batches:
            if not len(batch):
                continue
            key, role, line = (batch.column(c).to_numpy() for c in ("key", "role", "line"))
            same_key = np.concatenate([[key[0] == key_before], key[1:] == key[:-1]])
            same_line = same_key & np.concatenate([[line[0] == line_before], line[1:] == line[:-1]])
            keep = ~same_line
            # running number of distinct lines within the key, continued over batches
            run_id = np.cumsum(~same_key)
            fresh = np.cumsum(keep)
            starts = np.flatnonzero(~same_key)
            base = np.zeros(run_id[-1] + 1, np.int64)
            base[0] = -distinct
            base[run_id[starts]] = fresh[starts] - 1
            rank = fresh - base[run_id]
            lead = np.zeros(run_id[-1] + 1, np.int64)
            lead[0] = first_role
            lead[run_id[starts]] = role[starts]
            total = np.zeros(run_id[-1] + 1, np.int64)
            np.maximum.at(total, run_id, rank)
            good = (total >= 2) & (lead == 0)
            out = keep & good[run_id]
            if pending is not None:
                if run_id[0] == 0 and good[0]:
                    yield pending
                if len(starts) or total[0] >= 2:
                    pending = None
            if out.any():
                yield _placed(batch.filter(pa.array(out)), (rank[out] - 1) // block)
            last = run_id[-1]
            if total[last] == 1 and lead[last] == 0 and (len(starts) or pending is None) and keep[run_id == last].any():
                row = int(np.flatnonzero((run_id == last) & keep)[0])
                pending = _placed(batch.slice(row, 1), np.zeros(1, np.int64))
            key_before, line_before = key[-1], line[-1]
            first_role, distinct = int(lead[last]), int(total[last])

    return run


def _placed(batch: pa.RecordBatch, blk: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(blk.astype(np.int32))], names=["key", "role", "line", "blk"])


class _Parts:
    """Items joined so far; of further links, those that join two parts not joined before."""

    def __init__(self, n: int):
        self._root = list(range(n))

    def _find(self, x: int) -> int:
        root = self._root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def joins(self, a: np.ndarray, b: np.ndarray, linked=None, limits=None) -> np.ndarray:
        """Which of the links are needed; with ``linked``, they are only tried (item, item, limit) where they would be."""
        keep = np.zeros(len(a), bool)
        for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            x, y = self._find(i), self._find(j)
            if x != y and (linked is None or linked(i, j, int(limits[k]))):
                self._root[max(x, y)] = min(x, y)
                keep[k] = True
        return keep


def _link_batches(max_edits: int, min_bytes: int, grow: bool, most: int = 400_000):
    bands = edit_bands(max_edits, min_bytes, grow)
    floors, limits = np.array([low for low, _, _ in bands]), np.array([edits for _, _, edits in bands])

    def run(batches):
        for table in whole_runs(batches, ["key", "bi", "bj"]):
            table = table.combine_chunks()
            key, bi, bj, blk, role, line = (table.column(c).to_numpy() for c in ("key", "bi", "bj", "blk", "role", "line"))
            names, at, text = np.unique(line, return_index=True, return_inverse=True)  # a line may stand under many keys
            column = table.column("bytes").combine_chunks().take(pa.array(at)).cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
            data = np.frombuffer(column.buffers()[2], np.uint8)
            start, end = offsets[:-1], offsets[1:]
            length = end - start
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])
            begins = np.flatnonzero(new)
            run_end = np.append(begins[1:], len(key))[np.cumsum(new) - 1]
            later = run_end - np.arange(len(key)) - 1
            counts = np.zeros((len(names), 32), np.int32)
            np.add.at(counts, (np.repeat(np.arange(len(names)), length), data[offsets[0]:offsets[-1]] & 31), 1)
            if grow:
                n_words, word_counts = _word_counts(data[offsets[0]:offsets[-1]], offsets - offsets[0])
            joined = _Parts(len(names))
            row = 0
            while row < len(key):  # pairs of some rows with all later rows of their run, a bounded number at a time
                upto = max(row + 1, int(np.searchsorted(np.cumsum(later[row:]), most, "right")) + row)
                left = np.repeat(np.arange(row, upto), later[row:upto])
                right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(later[row:upto]) - later[row:upto], later[row:upto])
                ok = ((role[left] == 0) | (role[right] == 0)) & (text[left] != text[right])
                ok &= (bi[left] == bj[left]) | (blk[left] != blk[right])
                left, right = text[left[ok]], text[right[ok]]
                edits = limits[np.searchsorted(floors, np.minimum(length[left], length[right]), "right") - 1]
                near = abs(length[left] - length[right]) <= edits
                a, b = [], []
                x, y, edits = left[near], right[near], edits[near]
                for part in np.array_split(np.arange(len(x)), len(x) // 100_000 + 1):
                    part = part[abs(counts[x[part]] - counts[y[part]]).sum(axis=1) <= 2 * edits[part]]
                    for limit in np.unique(edits[part]):
                        p = part[edits[part] == limit]
                        p = p[within(data, (start[x[p]], end[x[p]]), (start[y[p]], end[y[p]]), int(limit))]
                        keep = joined.joins(x[p], y[p])
                        a.append(names[x[p][keep]])
                        b.append(names[y[p][keep]])
                if grow:
                    edits = np.minimum(n_words[left], n_words[right]) // TENTH
                    near = (edits > 0) & (abs(n_words[left] - n_words[right]) <= edits)
                    x, y, edits = left[near], right[near], edits[near]
                    for part in np.array_split(np.arange(len(x)), len(x) // 100_000 + 1):
                        part = part[abs(word_counts[x[part]] - word_counts[y[part]]).sum(axis=1) <= 2 * edits[part]]
                        keep = joined.joins(x[part], y[part], lambda i, j, t: sequences_within(
                            data[start[i]:end[i]].tobytes().split(), data[start[j]:end[j]].tobytes().split(), t), edits[part])
                        a.append(names[x[part][keep]])
                        b.append(names[y[part][keep]])
                a, b = (np.concatenate([*z, np.zeros(0, np.int64)]) for z in (a, b))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
                row = upto

    return run


def _word_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of each line, and how many of them fall into each of 64 parts."""
    begin, stop, first = words(data, offsets, NON_SPACE_BYTES)
    value = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix(data.astype(np.uint64) + _SEED), out=value[1:])
    part = (mix(value[stop] - value[begin]) & np.uint64(63)).astype(np.int64)
    counts = np.zeros((len(offsets) - 1, 64), np.int32)
    np.add.at(counts, (np.repeat(np.arange(len(offsets) - 1), np.diff(first)), part), 1)
    return np.diff(first), counts


def line_links(docs: DataFrame, max_edits: int = 1, min_bytes: int = 20, block: int = 2048, grow: bool = False) -> DataFrame:
    """Links (a, b) between hashes of different lines: enough to give the classes of all links."""
    texts = docs.select("text").where("text is not null")
    indexed = None
    if any(edits > 1 for _, _, edits in edit_bands(max_edits, min_bytes, grow)):
        keys = texts.mapInArrow(_index_batches(min_bytes, max_edits, grow), "key long")
        indexed = docs.sparkSession.sparkContext.broadcast(bit_table(keys, INDEX_BITS))
    rows = texts.mapInArrow(_key_batches(min_bytes, max_edits, grow, indexed), "key long, role byte, line long")
    shared = saved(rows.repartition("key").sortWithinPartitions("key", "role", "line")
                   .mapInArrow(_shared_batches(block), "key long, role byte, line long, blk int"), "lines-keys")
    if grow:  # of keys with the same lines in the same roles, one gives all the pairs
        sets = (shared.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("line", "role")).alias("x"),
                                          F.bit_xor(F.xxhash64("role", "line")).alias("y"))
                .groupBy("n", "x", "y").agg(F.min("key").alias("one")))
        every, shared = shared, saved(shared.join(sets.select("one"), F.col("key") == F.col("one"), "left_semi"), "lines-sets")
        discard(every)
    wanted = shared.select("line").distinct()
    table = docs.sparkSession.sparkContext.broadcast(bit_table(wanted))
    hot = saved(shared.groupBy(F.col("key").alias("hot_key")).agg((F.max("blk") + 1).alias("parts")).where("parts > 1"), "lines-hot")
    parts = F.coalesce("parts", F.lit(1))
    placed = (shared.join(hot, F.col("key") == F.col("hot_key"), "left")
              .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
              .select("line", F.struct("key", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), "blk", "role").alias("p"))
              .groupBy("line").agg(F.collect_list("p").alias("places")))
    lines = saved(texts.mapInArrow(_line_batches(min_bytes, table), "id long, bytes binary")
                  .join(placed, F.col("id") == F.col("line")).dropDuplicates(["id"]).select("line", "bytes", "places"), "lines-texts")
    discard(shared)
    slices = _slices(lines)
    links = None
    for s in range(slices):  # each is shuffled, verified and gone before the next
        mine = F.filter("places", lambda p: F.pmod(F.xxhash64(p["key"], p["bi"], p["bj"]), F.lit(slices)) == s)  # noqa: B023
        part = saved(lines.select("line", "bytes", F.explode(mine).alias("p")).select("p.key", "p.bi", "p.bj", "p.blk", "p.role", "line", "bytes")
                     .repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
                     .mapInArrow(_link_batches(max_edits, min_bytes, grow), "a long, b long").distinct(), "lines-slice")
        links = part if links is None else links.union(part)
    discard(lines)
    return links.distinct()


SLICE_BYTES = 128 << 20
_ROW = 48  # bytes of a shuffled row besides its text


def _slices(lines: DataFrame) -> int:
    """In how many slices of keys to verify lines under all their keys, so that one moves, on average, no more bytes than all lines have."""
    held, moved = lines.agg(F.sum(F.length("bytes").cast("long")), F.sum((F.length("bytes").cast("long") + _ROW) * F.size("places"))).first()
    return max(1, -(-(moved or 0) // max(SLICE_BYTES, held or 0)))


def line_classes(docs: DataFrame, max_edits: int = 1, min_bytes: int = 20, exact_bytes: int | None = None,
                 grow: bool = False) -> DataFrame:
    """Every line that takes part: doc_id, text_hash, number, its class (named by the first line's place), is_first.

    With ``exact_bytes``, shorter lines down to that length take part too, in exact repeats only.

    Lines that neither occur elsewhere nor have a link are left out: they are their own class and stay.
    """
    more = {"grow": True} if grow else {}
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").where("text is not null")
    places = saved(keyed.mapInArrow(_occurrence_batches(min_bytes if exact_bytes is None else exact_bytes), "doc_id long, text_hash long, number int, h1 long, h2 long"),
                   "lines-places")
    place = F.struct("doc_id", "text_hash", "number")
    with scratch_block(docs.sparkSession) as keep:
        comps = components(saved(line_links(docs, max_edits, min_bytes, **more), "lines-links")).select(F.col("node").alias("linked"), "component")
        distinct = (places.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
                    .join(comps, F.col("h1") == F.col("linked"), "left")
                    .where("component is not null or first <> last")
                    .select("h1", "h2", "first", F.coalesce("component", "h1").alias("class"),
                            F.when(F.col("component").isNull(), F.col("h2")).alias("side")))
        distinct = saved(distinct, "lines-distinct")
        keep(distinct)
    heads = distinct.groupBy("class", "side").agg(F.min("first").alias("head"))
    known = (distinct.alias("d").join(heads.alias("e"), (F.col("d.class") == F.col("e.class")) & F.col("d.side").eqNullSafe(F.col("e.side")))
             .select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("d.class").alias("class"), "head"))
    return (places.join(known, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
            .select("doc_id", "text_hash", "number", F.col("head.doc_id").alias("class_doc"), F.col("head.number").alias("class_number"),
                    F.struct("doc_id", "text_hash", "number").eqNullSafe(F.col("head")).alias("is_first")))


def dedup_lines(docs: DataFrame, max_edits: int = 1, min_bytes: int = 20, exact_bytes: int | None = None,
                 grow: bool = False) -> DataFrame:
    """``docs`` with every line that repeats an earlier one taken out of ``text``; all rows and columns stay."""
    drop = (line_classes(docs, max_edits, min_bytes, exact_bytes, grow).where("not is_first")
            .groupBy(F.col("doc_id").alias("drop_id"), F.col("text_hash").alias("drop_hash"))
            .agg(F.collect_set("number").alias("drop_lines")))  # at most the lines of one text
    names = ["kpishift_drop_id", "kpishift_drop_hash", "kpishift_drop_lines"]
    drop = drop.toDF(*names)
    text = F.col("kpishift_text")
    kept = F.array_join(F.transform(F.filter(
        F.transform(F.split(text, "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
        lambda s: ~F.array_contains(F.col(names[2]), s["i"])), lambda s: s["x"]), "\n")
    quoted = ["`" + c.replace("`", "``") + "`" for c in docs.columns]
    base = docs.withColumn("kpishift_text", F.col("text"))
    joined = base.join(drop, base["doc_id"].eqNullSafe(drop[names[0]]) & (F.xxhash64("kpishift_text") == drop[names[1]]), "left")
    return joined.select(*[(F.when(F.col(names[2]).isNull(), text).otherwise(kept).alias("text") if c == "text" else F.col(q))
                           for c, q in zip(docs.columns, quoted, strict=True)])
