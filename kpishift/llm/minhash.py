"""MinHash near-duplicate detection with verified links and connected components.

1. One pass over the texts: 5-word shingle sets, a fingerprint of the set, 256
   universal hash minima, 32 band keys of 4 minima, one byte of each minimum.
2. Equal sets meet by fingerprint; one node, numbered for itself, stands for them
   (its texts are those of the least row), so an id with two texts is two nodes.
3. Nodes sharing a band key are candidates. Each key's nodes are first
   compared with one node of the key only, chosen by a hash (a star, linear in
   the key's size); the most similar one by signature is verified on the full
   sets. Components of these links follow.
4. Keys that still hold several components are compared between different
   components, on signatures, in tasks of bounded blocks. First the few most
   similar pairs of each node are verified, and the components joined; then all
   pairs left whose signatures reach ``screen`` and whose bitmaps allow a link.
   (A bitmap has a bit for every shingle's hash; bits set in one of two bitmaps
   only are a lower bound of the sets' difference, so this drops no link.) After
   this no pair of nodes with a common key and such signatures is unverified,
   except within a component, and few pairs of a large group had to be verified.

A link of similarity 0.75 is missed by all 32 bands with probability 5e-6 and
by the signature screen (0.64 of 256 minima) with probability 3e-5.

Defined results: a null, empty or blank text has no shingles and is linked with
nothing; fewer than five words are one shingle; rows sharing an id each take
the component of their own text, which is named by its smallest id; a row with a null id stays, with a null
component (if its text is a copy of another row's, that one's component).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpishift.operators.hotjoin import maybe_partnered

from .common import NON_SPACE_BYTES, mix, rows_of, saved, text_chunks, word_hashes
from .components import components
from .groups import changes, whole_runs

SHINGLE, BANDS, WIDTH, MINIMA, BITMAP = 5, 32, 4, 256, 12  # 2^12 bits
_SIGNATURES = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.binary()),
                         ("bands", pa.list_(pa.int64())), ("sig", pa.binary()),
                          ("bits", pa.binary())])


def shingle_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's 5-word shingles (with repeats), and ``first`` per text."""
    h, first = word_hashes(data, offsets, NON_SPACE_BYTES)
    n = np.diff(first)
    row = rows_of(n)
    whole = h.copy()
    for k in range(1, SHINGLE):
        whole[:-k] = whole[:-k] * np.uint64(0x100000001B3) + h[k:]
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(n.dtype))
    keep = np.arange(len(h)) - first[row] < count[row]
    out = mix(whole)[keep]
    starts = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=starts[1:])
    for i in np.flatnonzero((n > 0) & (n < SHINGLE)):  # the whole short sequence is one shingle
        x = np.uint64(n[i])
        for j in range(first[i], first[i + 1]):
            x = mix(np.array([x], np.uint64) + h[j])[0]
        out[starts[i]] = x
    return out, starts


def minima(shingles: np.ndarray, starts: np.ndarray, count: int = MINIMA, seed: int = 7) -> np.ndarray:
    """count x texts: the least value of each universal hash over a text's shingles (texts without any excluded)."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, count, dtype=np.uint64)
    out = np.empty((count, len(starts)), np.uint64)
    work = np.empty_like(shingles)
    for k in range(count):
        np.multiply(shingles, a[k], out=work)
        work += b[k]
        out[k] = np.minimum.reduceat(work, starts)
    return out


def _signature_batches(batches):
    for batch, offsets, data in text_chunks(batches):
        shingles, starts = shingle_hashes(data, offsets)
        n = len(batch)
        some = np.flatnonzero(np.diff(starts) > 0)
        sizes, prints, bits = np.zeros(n, np.int64), [None] * n, [None] * n
        for i in some:
            distinct = np.unique(shingles[starts[i]:starts[i + 1]])
            sizes[i] = len(distinct)
            prints[i] = hashlib.blake2b(distinct.tobytes(), digest_size=16).digest()
            flags = np.zeros(1 << BITMAP, bool)
            flags[distinct >> np.uint64(64 - BITMAP)] = True
            bits[i] = np.packbits(flags).tobytes()
        sigs, places, keys = [None] * n, np.zeros(n + 1, np.int64), np.zeros(0, np.int64)
        if len(some):
            low = minima(shingles, starts[some])
            band = np.zeros((BANDS, len(some)), np.uint64)
            for k in range(WIDTH):
                band = mix(band * np.uint64(31) + low[k:BANDS * WIDTH:WIDTH] + np.arange(BANDS, dtype=np.uint64)[:, None])
            byte = (mix(low) & np.uint64(255)).astype(np.uint8).T
            for j, i in enumerate(some):
                sigs[i] = byte[j].tobytes()
            has = np.zeros(n, np.int64)
            has[some] = BANDS
            np.cumsum(has, out=places[1:])
            keys = np.ascontiguousarray(band.T).reshape(-1).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("text_hash"), pa.array(sizes), pa.array(prints, pa.binary()),
             pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(keys)), pa.array(sigs, pa.binary()),
             pa.array(bits, pa.binary())],
            schema=_SIGNATURES)


def signatures(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        _signature_batches, "doc_id long, text_hash long, n_shingles long, fp binary, bands array<long>, sig binary, bits binary")


def shingle_set(text: str) -> set:
    """The full set of a text, as tuples of words."""
    w = text.encode(errors="replace").lower().split()
    if len(w) < SHINGLE:
        return {tuple(w)} if w else set()
    return set(zip(w, w[1:], w[2:], w[3:], w[4:], strict=False))


def _verified_batches(percent: int):
    def run(batches):
        last, set_a = None, set()
        for batch in batches:
            a, b, keep = batch.column("a"), batch.column("b"), []
            for x, y in zip(batch.column("text_a"), batch.column("text_b"), strict=True):
                x = x.as_py()
                if x != last:
                    last, set_a = x, shingle_set(x)
                set_b = shingle_set(y.as_py())
                common = len(set_a & set_b)
                keep.append(common > 0 and 100 * common >= percent * (len(set_a) + len(set_b) - common))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(edges: DataFrame, docs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose nodes' full sets reach the threshold; ``reps`` (node, doc_id, text_hash) names their texts."""
    ends = edges.select(F.col("a").alias("end")).union(edges.select(F.col("b").alias("end"))).distinct()
    # written, so that its size is known when the join with the texts is planned
    wanted = saved(reps.join(ends, F.col("node") == F.col("end"), "left_semi").distinct()
                   .select("node", F.col("doc_id").alias("rep_id"), F.col("text_hash").alias("rep_hash")), "minhash-ends")
    # longs as in ``reps``, for the filter's hashes; it drops most texts that are no end before the join shuffles any
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("rep_id"),
                                                 F.xxhash64("text").alias("rep_hash"), "text")
    texts = saved(maybe_partnered(rows, wanted, ["rep_id", "rep_hash"]).join(wanted, ["rep_id", "rep_hash"])
                  .select("node", "text"), "minhash-texts")
    of = {s: texts.select(F.col("node").alias(f"id_{s}"), F.col("text").alias(f"text_{s}")) for s in "ab"}
    both = (edges.join(of["b"], F.col("b") == F.col("id_b")).join(of["a"], F.col("a") == F.col("id_a"))
            .select("a", "b", "text_a", "text_b"))
    return both.mapInArrow(_verified_batches(percent), "a long, b long").distinct()


def _agreement_batches(batches):
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(batch), -1) for c in ("sig_a", "sig_b"))
        same = (x == y).mean(axis=1) if len(batch) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(same, pa.float64())],
                                         names=["a", "b", "same"])


def _cross_batches(screen: float, most: int | None, percent: int):
    """Pairs of a block group in different components that agree in at least ``screen`` of their minima.

    ``y`` is the end outside the group's largest component. With ``most``, only its most similar pairs; else all that
    their bitmaps leave possible.
    """
    def run(batches):
        for table in whole_runs(batches, ["key", "bi", "bj"]):
            table = table.combine_chunks()
            nodes, comps, blocks, bi, bj = (table.column(c).to_numpy() for c in ("node", "comp", "blk", "bi", "bj"))
            sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(nodes), -1)
            if not most:
                maps = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(nodes), -1)
                counts = table.column("n_shingles").to_numpy()
            starts = changes(table.to_batches()[0], ["key", "bi", "bj"])
            a, b, y, same = [], [], [], []
            for s, e in zip(starts, np.append(starts[1:], len(nodes)), strict=True):
                comp = comps[s:e]
                if (comp == comp[0]).all():
                    continue
                _, inverse, sizes = np.unique(comp, return_inverse=True, return_counts=True)
                order = s + np.argsort(inverse == np.argmax(sizes), kind="stable")  # the largest component last
                node, comp, blk, sig = nodes[order], comps[order], blocks[order], sigs[order]
                for i in range(len(node) - int(sizes.max())):
                    other = comp[i + 1:] != comp[i]
                    if bi[s] != bj[s]:
                        other &= blk[i + 1:] != blk[i]
                    at = i + 1 + np.flatnonzero(other)
                    if not len(at):
                        continue
                    like = (sig[at] == sig[i]).mean(axis=1)
                    good = like >= screen
                    at, like = at[good], like[good]
                    if not most:
                        apart = np.bitwise_count(maps[order[at]] ^ maps[order[i]]).sum(axis=1, dtype=np.int64)
                        good = apart * (100 + percent) <= (100 - percent) * (counts[order[at]] + counts[order[i]])
                        at, like = at[good], like[good]
                    if most and len(at) > most:
                        top = np.argpartition(-like, most)[:most]
                        at, like = at[top], like[top]
                    a.append(np.minimum(node[at], node[i]))
                    b.append(np.maximum(node[at], node[i]))
                    y.append(np.full(len(at), node[i]))
                    same.append(like)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, y, same)], names=["a", "b", "y", "same"])

    return run


def _cross(shared: DataFrame, sigs: DataFrame, forest: DataFrame, screen: float, block: int, most: int | None,
           percent: int) -> DataFrame:
    """Pairs (a, b) with a common key, in different trees of ``forest`` (node, component)."""
    comps = forest.select(F.col("node").alias("comp_node"), "component")
    placed = (shared.join(comps, F.col("node") == F.col("comp_node"), "left")
              .select("key", "node", "size", F.coalesce("component", "node").alias("comp")))
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    parts = F.ceil(F.col("size") / F.lit(block)).cast("int")
    blocked = (placed.join(open_keys, "key").withColumn("parts", parts)
               .withColumn("blk", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
               .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
               .select("key", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), "blk", "node", "comp"))
    shown = ["sig"] if most else ["sig", "bits", "n_shingles"]
    pairs = (blocked.join(sigs.select("node", *shown), "node").select("key", "bi", "bj", "blk", "node", "comp", *shown)
             .repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
             .mapInArrow(_cross_batches(screen, most, percent), "a long, b long, y long, same double").distinct())
    if most:
        nearest = Window.partitionBy("y").orderBy(F.desc("same"), "a", "b")
        pairs = pairs.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= most)
    return pairs.select("a", "b").distinct()


def linked(docs: DataFrame, mapped: DataFrame, percent: int = 75, screen: float = 0.64, block: int = 4096,
           nearest: int = 8) -> DataFrame:
    """(node, component) of all nodes with a link; a component is its smallest node."""
    reps = mapped.where("bands is not null")
    named = reps.select("node", "doc_id", "text_hash")
    bands = reps.select("node", F.explode("bands").alias("key"))
    keys = (bands.groupBy("key").agg(F.count("*").alias("size"), F.min_by("node", F.xxhash64("node", "key")).alias("leader"))
            .where("size > 1"))
    shared = saved(bands.join(keys, "key").select("key", "node", "size", "leader"), "minhash-keys")
    sigs = reps.select("node", "sig", "bits", "n_shingles").dropDuplicates(["node"])
    of = {s: sigs.select(F.col("node").alias(f"id_{s}"), F.col("sig").alias(f"sig_{s}")) for s in "ab"}
    star = shared.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    near = (star.join(of["a"], F.col("a") == F.col("id_a")).join(of["b"], F.col("b") == F.col("id_b"))
            .select("a", "b", "sig_a", "sig_b").mapInArrow(_agreement_batches, "a long, b long, same double")
            .where(F.col("same") >= screen))
    tested = saved(near.groupBy("b").agg(F.max_by("a", F.struct("same", "a")).alias("a"))
                   .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "minhash-best")
    forest = components(saved(verified(tested, docs, named, percent), "minhash-links"))
    for most in (nearest, None):
        edges = saved(_cross(shared, sigs, forest, screen, block, most, percent).join(tested, ["a", "b"], "left_anti"), "minhash-cross")
        if edges.isEmpty():
            continue  # a node's nearest may all be tested, and a pair behind them not
        new = saved(verified(edges, docs, named, percent), "minhash-links")
        if not new.isEmpty():
            forest = components(new.union(forest.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        tested = tested.union(edges)
    return forest


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept for every row of ``docs``."""
    sigs = saved(signatures(docs), "minhash-signatures")
    nodes = saved(sigs.where("fp is not null and doc_id is not null").groupBy(F.col("fp").alias("node_fp"))
                  .agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"))
                  .select("node_fp", "rep", F.monotonically_increasing_id().alias("node")), "minhash-sets")
    is_rep = F.struct("doc_id", "text_hash") == F.col("rep")  # rows that repeat it are equal
    mapped = saved(sigs.join(nodes, F.col("fp") == F.col("node_fp"), "left")
                   .select("doc_id", "text_hash", "n_shingles", "node", F.col("rep.doc_id").alias("least_id"),
                           *[F.when(is_rep, F.col(c)).alias(c) for c in ("bands", "sig", "bits")]), "minhash-nodes")
    comps = linked(docs, mapped, percent)
    least = (comps.join(nodes.select("node", F.col("rep.doc_id").alias("least_id")), "node")
             .groupBy("component").agg(F.min("least_id").alias("component_id")))
    named = comps.join(least, "component").select(F.col("node").alias("comp_node"), "component_id")
    return (mapped.join(named, F.col("node") == F.col("comp_node"), "left")
            .select("doc_id", "text_hash", "n_shingles", F.coalesce("component_id", "least_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` (all columns) without the rows that near_duplicates does not keep."""
    gone = (near_duplicates(docs, percent).where("not kept")
            .select(F.col("doc_id").alias("kpishift_id"), F.col("text_hash").alias("kpishift_hash")).distinct())
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["kpishift_id"]) & (F.xxhash64(docs["text"]) == gone["kpishift_hash"]), "left_anti")
