"""Conversation structure repair: cheapest edits by a cost DP, the least audit by prefix-doubling ranks.

A conversation's rows, by turn (null turns first, equal turns by role and text),
should read system?, then user and assistant in turn, judged by the first letter of the roles
(``(s?(ua)+)?``). Edits: Keep (0; a truncated row 3), Rerole to user or assistant (3
more), Delete (4), Insert an empty row (3). Blank and repeated rows must go.

DP: nodes are (row, state), the state being nothing yet, s, u or a; costs to
the end are computed from the last row on, for all conversations of a batch at
once. Path ranking: arcs that keep the least cost are optimal. The grammar is
deterministic, so a node's optimal arcs differ in their letters, and audits of
one letter already tell its arcs apart; they rank the nodes. Ranks of audits
of 2, 4, 8 ... letters come from pairs of ranks, a node's and that of the node
its doubled pointer leads to. The path takes at every node the arc of least
(letter, rank of the rest); it is read off through the doubled pointers.

Order: rows are range-partitioned by conversation, turn, role and text, and
packed into segments of at most ``block`` rows and ``SEGMENT_BYTES`` of text. So a
conversation with a great share of all rows lies in many segments and tasks. A segment that
is surely a whole conversation is done where it stands. Of the others, repeats
are found by a minimum per (conversation, role, text); a 4 x 4 matrix of least
costs per segment gives the costs behind every segment; each segment then finds its least
audit from each state, in parallel; and a last stream in segment order picks them and feeds
the hash, which by its definition reads a conversation from front to back (one segment
in memory at a time, and the audit, which is the result).

Defined results: a null role or text is one blank; null turns count for no gap;
null ids are one conversation; gaps beyond 64 bits are the largest long; a conversation
whose rows are all ``gone`` has zeros, an empty audit and the hash of nothing; an empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import NON_SPACE_BYTES, mix, prefix_hash, rows_of, saved, ship, span_hash, utf8

SEGMENT_BYTES = 4 << 20
#: Rows worked on at once.
BATCH_ROWS = 20_000

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after s, after u, after a. The role that Rerole and Insert give in each state.
NEXT = np.array([2, 2, 3, 2])
ROLE = {2: "user", 3: "assistant"}
#: Kept initials (s, u, a, other) from each state; -1: not allowed.
KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: Letters in ASCII order; 0 ends an audit.
LETTERS = np.frombuffer(b"\0DIKR", np.uint8)
FAR = 1 << 50
MOST = (1 << 63) - 1
#: Costs of ending in each state: complete after nothing or a, else by insertions.
END = np.array([0, 2 * INSERT, INSERT, 0])

_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32 of ``conv_id:turn`` mod 20; dropped rows stay as ``gone``, so that no conversation is lost."""
    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    return (rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .select("conv_id", "turn",
                    F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                    F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", ""))
                    .otherwise(F.col("text")).alias("text"), (F.col("kind") == 0).alias("gone")))


# --- segments ----------------------------------------------------------------

def _new_ids(ids: pa.Array) -> np.ndarray:
    """Whether each row's id differs from the row before (nulls are equal)."""
    out = np.ones(len(ids), bool)
    if len(ids) > 1:
        a, b = ids.slice(1), ids.slice(0, len(ids) - 1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        out[1:] = ~same.to_numpy(zero_copy_only=False)
    return out


def _segments(table: pa.Table, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows where segments begin, whether a conversation begins there)."""
    n = len(table)
    new = _new_ids(table.column("conv_id").combine_chunks())
    begins = np.flatnonzero(new)
    within = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
    size = pc.fill_null(pc.binary_length(table.column("text")), 0).to_numpy().astype(np.int64)
    before = np.cumsum(size) - size
    bucket = (before - np.repeat(before[begins], np.diff(np.append(begins, n)))) // SEGMENT_BYTES
    cut = new | (within % block == 0)
    cut[1:] |= bucket[1:] != bucket[:-1]
    at = np.flatnonzero(cut)
    return at, new[at]


def _pack_batches(block: int):
    """Sorted rows to segments; the last segment waits for what follows it."""
    def packed(table: pa.Table, at: np.ndarray, part: int, first: int, whole: np.ndarray) -> pa.RecordBatch:
        stays = ~pc.fill_null(table.column("gone"), False).to_numpy(zero_copy_only=False)
        count = np.concatenate([[0], np.cumsum(stays)])
        offsets = pa.array(count[np.append(at, len(table))].astype(np.int32))
        kept = table.filter(pa.array(stays)).combine_chunks()

        def lists(c):
            column = kept.column(c)
            return pa.ListArray.from_arrays(offsets, column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)

        ids = table.column("conv_id").combine_chunks().take(pa.array(at))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(np.full(len(at), part, np.int32)), pa.array(first + np.arange(len(at))), pa.array(whole),
             lists("turn"), lists("role"), lists("text")], names=["conv_id", "part", "no", "whole", "turns", "roles", "texts"])

    def run(batches):
        part, no, held, held_new, first_id = TaskContext.get().partitionId(), 0, None, True, True
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table]).combine_chunks()
            at, new = _segments(table, block)
            new[0] = held_new
            last = at[-1]
            if len(at) > 1:
                whole = new[:-1] & new[1:]
                if first_id:  # the partition's first conversation may begin in the one before
                    whole[:np.flatnonzero(np.append(new[1:], True))[0] + 1] = False
                    first_id = not new[1:].any()
                yield packed(table.slice(0, last), at[:-1], part, no, whole)
                no += len(at) - 1
            held, held_new = table.slice(last), bool(new[-1])
        if held is not None:
            yield packed(held, np.zeros(1, np.int64), part, no, np.zeros(1, bool))

    return run


class _Rows:
    """Rows of some segments, with what is judged of each row by itself."""

    def __init__(self, batch: pa.RecordBatch):
        texts, roles, turns = (batch.column(c) for c in ("texts", "roles", "turns"))
        self.first = np.asarray(texts.offsets.to_numpy(), np.int64)
        self.first = self.first - self.first[0]
        self.n = np.diff(self.first)
        self.segment = rows_of(self.n)
        self.text, self.role, self.turn = texts.flatten(), roles.flatten(), turns.flatten()
        at, data = utf8(self.text)
        inside = NON_SPACE_BYTES[data]
        ink = np.concatenate([[0], np.cumsum(inside)])
        self.blank = ink[at[1:]] == ink[at[:-1]]
        last = np.zeros(len(self.text), np.uint8)
        places = np.flatnonzero(inside)
        some = np.flatnonzero(~self.blank)
        last[some] = data[places[ink[at[1:][some]] - 1]]
        self.stops = np.isin(last, np.frombuffer(b".!?", np.uint8))
        role_at, role_data = utf8(self.role)
        begins = np.zeros(len(self.role), np.uint8)
        named = np.flatnonzero(np.diff(role_at))
        begins[named] = role_data[role_at[named]]
        self.initial = np.full(len(begins), 3)
        for k, letter in enumerate(b"sua"):
            self.initial[begins == letter] = k
        self.key = mix(span_hash(prefix_hash(role_data), role_at[:-1], role_at[1:]) * np.uint64(0x9E3779B97F4A7C15)
                       ^ span_hash(prefix_hash(data), at[:-1], at[1:]))

    def repeats(self) -> np.ndarray:
        """Rows equal to an earlier row of their segment."""
        order = np.lexsort((np.arange(len(self.key)), self.key, self.segment))
        k, s = self.key[order], self.segment[order]
        out = np.zeros(len(order), bool)
        out[order[1:]] = (k[1:] == k[:-1]) & (s[1:] == s[:-1])
        return out

    def judge(self, repeated: np.ndarray):
        self.duplicate = repeated & ~self.blank
        self.bad = self.blank | repeated
        self.truncated = ~self.bad & ~self.stops

    def per_segment(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.first[1:]] - total[self.first[:-1]]

    def illegal(self) -> np.ndarray:
        """Per segment: neighbours whose initials are not su, ua or au."""
        wrong = np.zeros(len(self.initial), bool)
        a, b = self.initial[:-1], self.initial[1:]
        wrong[1:] = ~(((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))) & (self.segment[1:] == self.segment[:-1])
        return self.per_segment(wrong)


def _costs(rows: _Rows, after: np.ndarray, final: np.ndarray) -> np.ndarray:
    """Least costs to the end from every node: (rows + segments) x 4; ``after``: costs behind each segment's last row."""
    n, s = len(rows.bad), len(rows.n)
    cost = np.full((n + s, 4), FAR, np.int64)
    ends = rows.first[1:] + np.arange(s)  # node behind the last row of each segment
    cost[ends] = np.where(final[:, None], END, after)
    order = np.argsort(-rows.n, kind="stable")
    length = rows.n[order]
    extra = np.where(rows.truncated, TRUNCATED, 0)
    for t in range(int(length[0]) if s else 0):
        some = order[:np.searchsorted(-length, -t)]  # segments of more than t rows
        row = rows.first[1:][some] - 1 - t
        node = ends[some] - 1 - t
        below = cost[node + 1]
        here = below + DELETE
        good = np.flatnonzero(~rows.bad[row])
        if len(good):
            r, b = row[good], below[good]
            target = KEPT[:, rows.initial[r]].T
            keep = np.where(target >= 0, np.take_along_axis(b, np.maximum(target, 0), 1) + KEEP, FAR)
            best = np.minimum(keep, b[:, NEXT] + REROLE) + extra[r][:, None]
            here[good] = np.minimum(here[good], best)
        u, a = np.minimum(here[:, 2], here[:, 3] + INSERT), np.minimum(here[:, 3], here[:, 2] + INSERT)
        cost[node] = np.stack([np.minimum(here[:, 0], u + INSERT), np.minimum(here[:, 1], u + INSERT), u, a], axis=1)
    return cost


def _paths(rows: _Rows, cost: np.ndarray, final: np.ndarray, entries: np.ndarray):
    """Least audits from nodes ``entries`` (4 x node + state): (offsets, nodes, letters) of their arcs, and where they end."""
    s = len(rows.n)
    ends = rows.first[1:] + np.arange(s)
    nodes = len(cost)
    row = np.full(nodes, -1)
    row[np.arange(len(rows.bad)) + rows.segment] = np.arange(len(rows.bad))
    state = np.broadcast_to(np.arange(4), (nodes, 4))
    here = np.arange(nodes)[:, None]
    inner = np.flatnonzero(row >= 0)
    r = row[inner]
    below = cost[inner + 1]
    # arcs in letter order D, I, K, R: which are optimal, and where they lead
    optimal = np.zeros((4, nodes, 4), bool)
    target = np.zeros((4, nodes, 4), np.int64)
    target[0], target[1] = (here + 1) * 4 + state, here * 4 + NEXT
    optimal[0][inner] = below + DELETE == cost[inner]
    inserts = row >= 0
    inserts[ends[final]] = True
    optimal[1][inserts] = cost[inserts][:, NEXT] + INSERT == cost[inserts]
    extra = np.where(rows.truncated, TRUNCATED, 0)[r][:, None]
    kept = KEPT[:, rows.initial[r]].T
    allowed = ~rows.bad[r][:, None]
    optimal[2][inner] = allowed & (kept >= 0) & (np.take_along_axis(below, np.maximum(kept, 0), 1) + KEEP + extra == cost[inner])
    target[2][inner] = (inner[:, None] + 1) * 4 + np.maximum(kept, 0)
    optimal[3][inner] = allowed & (below[:, NEXT] + REROLE + extra == cost[inner])
    target[3] = (here + 1) * 4 + NEXT
    optimal, target = optimal.reshape(4, -1), target.reshape(4, -1)

    letter = np.where(optimal.any(axis=0), optimal.argmax(axis=0) + 1, 0)
    itself = np.arange(nodes * 4)
    pointer = [np.where(letter > 0, np.take_along_axis(target, np.maximum(letter - 1, 0)[None], 0)[0], itself)]
    rank, most = letter, int(rows.n.max(initial=0)) * 3 + 3  # at most two insertions before each row and at the end
    while (1 << len(pointer)) <= most and (pointer[-1] != itself).any():
        jump = pointer[-1]
        _, rank = np.unique(rank * (nodes * 4 + 5) + rank[jump], return_inverse=True)
        pointer.append(jump[jump])
    # every arc's (letter, rank of the rest): the least one is the path's
    weight = np.where(optimal, (np.arange(4)[:, None] + 1) * (nodes * 4 + 5) + rank[target % (nodes * 4)], np.iinfo(np.int64).max)
    pointer[0] = np.where(letter > 0, np.take_along_axis(target, weight.argmin(axis=0)[None], 0)[0], itself)

    size, at = np.zeros(len(entries), np.int64), entries.copy()
    for k in range(len(pointer) - 1, -1, -1):
        further = pointer[k][at]
        go = letter[further] > 0
        at[go] = further[go]
        size[go] += 1 << k
    some = letter[at] > 0
    stop = np.where(some, pointer[0][at], at)
    size += some
    offsets = np.concatenate([[0], np.cumsum(size)])
    step = np.arange(offsets[-1]) - np.repeat(offsets[:-1], size)
    node = np.repeat(entries, size)
    for k in range(len(pointer)):
        bit = (step >> k) & 1 == 1
        node[bit] = pointer[k][node[bit]]
    return offsets, node, letter[node], stop, row


def _repaired(rows: _Rows, node: np.ndarray, letter: np.ndarray, row: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """``role:text`` of the arcs that leave a row, and which arcs these are."""
    out = np.flatnonzero(letter != 1)
    kinds, at, state = letter[out].tolist(), row[node[out] // 4], NEXT[node[out] % 4].tolist()
    wanted = pa.array(at, mask=letter[out] == 2)  # an inserted row has no text
    texts, roles = rows.text.take(wanted).to_pylist(), rows.role.take(wanted).to_pylist()
    return [(f"{role}:{text}" if kind == 3 else f"{ROLE[s]}:{text if kind == 4 else ''}").encode()
            for kind, s, role, text in zip(kinds, state, roles, texts, strict=True)], out


def _audits(offsets: np.ndarray, letter: np.ndarray) -> list[str]:
    text = LETTERS[letter].tobytes().decode()
    return [text[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _turns(rows: _Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least, greatest and number of distinct turns per segment, nulls left out (they stand first; 0, 0, 0 without turns)."""
    known = ~rows.turn.is_null().to_numpy(zero_copy_only=False)
    value = rows.turn.fill_null(0).to_numpy()
    fresh = known.copy()
    fresh[1:] &= (value[1:] != value[:-1]) | ~known[:-1] | (rows.segment[1:] != rows.segment[:-1])
    count, some = rows.per_segment(fresh), rows.per_segment(known)
    low, high = np.zeros(len(count), np.int64), np.zeros(len(count), np.int64)
    has = some > 0
    high[has] = value[rows.first[1:][has] - 1]
    low[has] = value[rows.first[1:][has] - some[has]]
    return low, high, count


def _gaps(low: np.ndarray, high: np.ndarray, count: np.ndarray) -> np.ndarray:
    wide = high - low
    return np.where(count == 0, 0, np.where(wide < 0, MOST, wide) + 1 - count)  # negative: beyond 64 bits


def _sliced(batches):
    """Sub-batches of a bounded number of rows of conversations."""
    for batch in batches:
        count = np.diff(np.asarray(batch.column("texts").offsets.to_numpy(), np.int64))
        a = 0
        while a < len(batch):
            b = max(a + 1, a + int(np.searchsorted(np.cumsum(count[a:]), BATCH_ROWS, "right")))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(a, b - a)]) for c in batch.columns], names=batch.schema.names)
            a = b


def _whole_batches(batches):
    """Results of segments that are whole conversations."""
    for batch in _sliced(batches):
        rows = _Rows(batch)
        rows.judge(rows.repeats())
        s = len(rows.n)
        final = np.ones(s, bool)
        cost = _costs(rows, np.zeros((s, 4), np.int64), final)
        starts = (rows.first[:-1] + np.arange(s)) * 4
        offsets, node, letter, _, row = _paths(rows, cost, final, starts)
        lines, out = _repaired(rows, node, letter, row)
        cut = np.searchsorted(out, offsets).tolist()
        hashes = [hashlib.sha256(b"\n".join(lines[a:b])).hexdigest() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        gaps = _gaps(*_turns(rows))
        counts = [rows.per_segment(x) for x in (rows.blank, rows.duplicate, rows.truncated)] + [rows.illegal()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(gaps, pa.int64()), *(pa.array(c, pa.int64()) for c in counts),
             pa.array(cost.reshape(-1)[starts]), pa.array(_audits(offsets, letter)), pa.array(hashes)],
            names=["conv_id", *_COUNTS, "cost", "audit", "repaired_sha256"])


# --- conversations of several segments ------------------------------------------

def _key_batches(batches):
    for batch in _sliced(batches):
        rows = _Rows(batch)
        ids = pa.array(rows.segment)
        pos = np.arange(len(rows.key)) - rows.first[rows.segment]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id").take(ids), pa.array(rows.key.view(np.int64)), batch.column("part").take(ids),
                                          batch.column("no").take(ids), pa.array(pos.astype(np.int32))], names=["conv_id", "h", "part", "no", "pos"])


def _judged(batch: pa.RecordBatch) -> _Rows:
    """Rows of segments whose ``firsts`` tell which rows are the first of their role and text in the conversation."""
    rows = _Rows(batch)
    firsts = batch.column("firsts")
    repeated = np.ones(len(rows.key), bool)
    at = firsts.flatten().to_numpy(zero_copy_only=False)
    owner = rows_of(np.diff(np.asarray(firsts.offsets.to_numpy(), np.int64)))
    repeated[rows.first[owner] + at] = False
    rows.judge(repeated)
    return rows


def _matrix_batches(batches):
    """Least costs from each state before a segment to each state behind it."""
    for batch in _sliced(batches):
        rows = _judged(batch)
        s = len(rows.n)
        starts = rows.first[:-1] + np.arange(s)
        out = np.zeros((s, 4, 4), np.int64)
        for q in range(4):
            after = np.full((s, 4), FAR, np.int64)
            after[:, q] = 0
            out[:, :, q] = _costs(rows, after, np.zeros(s, bool))[starts]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), batch.column("no"),
                                          pa.array(list(out.reshape(s, 16)), pa.list_(pa.int64()))], names=["conv_id", "part", "no", "m"])


def _after_batches(batches):
    """Segments sorted from the last to the first: costs behind each."""
    known, cost = object(), None
    for batch in batches:
        after, last = [], []
        for conv, m in zip(batch.column("conv_id").to_pylist(), batch.column("m").to_pylist(), strict=True):
            last.append(conv != known)
            if last[-1]:
                known, cost = conv, END
            after.append(cost.tolist())
            cost = np.minimum((np.array(m).reshape(4, 4) + cost).min(axis=1), FAR)
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("no"), pa.array(after, pa.list_(pa.int64())), pa.array(last, pa.bool_())],
                                         names=["after_part", "after_no", "after", "last"])


def _piece_batches(batches):
    """Each segment's counts and, from each state, its audit, its cost to the very end and the state behind it."""
    for batch in _sliced(batches):
        rows = _judged(batch)
        s = len(rows.n)
        final = batch.column("last").to_numpy(zero_copy_only=False)
        after = batch.column("after").flatten().to_numpy().reshape(s, 4)
        cost = _costs(rows, after, final)
        entries = ((rows.first[:-1] + np.arange(s))[:, None] * 4 + np.arange(4)).reshape(-1)
        offsets, _, letter, stop, _ = _paths(rows, cost, final, entries)
        audits = pa.ListArray.from_arrays(pa.array(np.arange(s + 1, dtype=np.int32) * 4), pa.array(_audits(offsets, letter), pa.string()))
        low, high, turns = _turns(rows)
        some = rows.n > 0
        ends = np.full((s, 2), -1)
        ends[some] = np.stack([rows.initial[rows.first[:-1][some]], rows.initial[rows.first[1:][some] - 1]], axis=1)
        counts = [rows.per_segment(x) for x in (rows.blank, rows.duplicate, rows.truncated)] + [rows.illegal()]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("conv_id", "part", "no", "roles", "texts")), audits,
             pa.array(list((stop % 4).reshape(s, 4)), pa.list_(pa.int64())), pa.array(cost.reshape(-1)[entries[::4]]),
             pa.array(low), pa.array(high), pa.array(turns),
             pa.array(ends[:, 0]), pa.array(ends[:, 1]), *(pa.array(c, pa.int64()) for c in counts)],
            names=["conv_id", "part", "no", "roles", "texts", "audits", "stops", "cost", "low", "high", "turns", "opens", "closes", *_COUNTS[1:]])


class _Conversation:
    """What the segments of one conversation add up to, in order."""

    def __init__(self, segment: dict):
        self.id, self.cost, self.state, self.audit = segment["conv_id"], segment["cost"], 0, []
        self.hash, self.lines = hashlib.sha256(), 0
        self.counts = dict.fromkeys(_COUNTS[1:], 0)
        self.low = self.high = None
        self.turns, self.close = 0, -1

    def add(self, segment: dict):
        for c in self.counts:
            self.counts[c] += segment[c]
        if segment["opens"] >= 0:
            self.counts["illegal"] += self.close >= 0 and (self.close, segment["opens"]) not in ((0, 1), (1, 2), (2, 1))
            self.close = segment["closes"]
        if segment["turns"]:
            self.turns += segment["turns"] - (self.high == segment["low"])
            self.low = segment["low"] if self.low is None else self.low
            self.high = segment["high"]
        audit, state, row = segment["audits"][self.state], self.state, 0
        self.audit.append(audit)
        for letter in audit:
            if letter == "K":
                state, role, text = int(KEPT[state, "sua".find(segment["roles"][row][:1]) if segment["roles"][row] else 3]), segment["roles"][row], segment["texts"][row]
            elif letter != "D":
                state = int(NEXT[state])
                role, text = ROLE[state], segment["texts"][row] if letter == "R" else ""
            row += letter != "I"
            if letter != "D":
                self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
                self.lines += 1
        self.state = segment["stops"][self.state]

    def result(self) -> tuple:
        gaps = 0 if self.low is None else min(MOST, self.high - self.low + 1 - self.turns)
        return self.id, gaps, *self.counts.values(), self.cost, "".join(self.audit), self.hash.hexdigest()


def _stream_batches(names: list[str], types: list[pa.DataType]):
    def run(batches):
        now, done = None, []
        for batch in batches:
            for k in range(len(batch)):
                segment = batch.slice(k, 1).to_pylist()[0]
                if now is None or now.id != segment["conv_id"]:
                    if now is not None:
                        done.append(now.result())
                    now = _Conversation(segment)
                now.add(segment)
            if done:
                yield _result(done, names, types)
                done = []
        if now is not None:
            yield _result([now.result()], names, types)

    return run


def _result(rows: list[tuple], names, types) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def repair(rows: DataFrame, block: int = 4096) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows``: conv_id, turn, role, text, gone (rows that only name their conversation).
    """
    spark = rows.sparkSession
    ship(spark)
    id_type = rows.schema["conv_id"].dataType.simpleString()
    base = rows.select("conv_id", F.col("turn").cast("long").alias("turn"),
                       *(F.when(~F.col("gone"), F.coalesce(c, F.lit(" "))).alias(c) for c in ("role", "text")), "gone")
    order = ["conv_id", "turn", "role", "text"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    segment = f"conv_id {id_type}, part int, no long, whole boolean, turns array<long>, roles array<string>, texts array<string>"
    segments = saved(base.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_pack_batches(block), segment),
                     "conversations-segments")
    result = f"conv_id {id_type}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", cost long, audit string, repaired_sha256 string"
    whole = segments.where("whole").mapInArrow(_whole_batches, result)

    rest = segments.where("not whole")
    firsts = (rest.mapInArrow(_key_batches, f"conv_id {id_type}, h long, part int, no long, pos int")
              .groupBy("conv_id", "h").agg(F.min(F.struct("part", "no", "pos")).alias("f"))
              .groupBy(F.col("f.part").alias("f_part"), F.col("f.no").alias("f_no")).agg(F.collect_list("f.pos").alias("firsts")))  # at most one segment's rows
    placed = (rest.join(firsts, (F.col("part") == F.col("f_part")) & (F.col("no") == F.col("f_no")), "left")
              .select("conv_id", "part", "no", "turns", "roles", "texts", F.coalesce("firsts", F.array().cast("array<int>")).alias("firsts")))
    placed = saved(placed, "conversations-placed")
    costs = (placed.mapInArrow(_matrix_batches, f"conv_id {id_type}, part int, no long, m array<long>")
             .repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("no"))
             .mapInArrow(_after_batches, "after_part int, after_no long, after array<long>, last boolean"))
    pieces = (placed.join(costs, (F.col("part") == F.col("after_part")) & (F.col("no") == F.col("after_no")))
              .mapInArrow(_piece_batches, f"conv_id {id_type}, part int, no long, roles array<string>, texts array<string>, audits array<string>, "
                          "stops array<long>, cost long, low long, high long, turns long, opens long, closes long, "
                          + ", ".join(f"{c} long" for c in _COUNTS[1:])))
    names = ["conv_id", *_COUNTS, "cost", "audit", "repaired_sha256"]
    types = [to_arrow_type(rows.schema["conv_id"].dataType), *[pa.int64()] * 6, pa.string(), pa.string()]
    streamed = (pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")
                .mapInArrow(_stream_batches(names, types), result))
    return whole.unionByName(streamed)
