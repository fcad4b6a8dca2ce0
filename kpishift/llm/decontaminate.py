"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed is a mask over consecutive words that ignores some of them, so a hit
survives words exchanged at the ignored places. Seeds of every position of the
test items are joined with seeds of every position of the documents. Each hit
names a diagonal (document position minus item position); on it the item's words
are compared with the document's, and the run with the highest total of +1 for
an equal and -3 for an exchanged word is the overlap (so at least three
quarters of it are equal). It counts from ``min_words`` equal words on. An item
of fewer than 15 words also counts if four fifths of its words stand at their
places on the diagonal; its overlap is all of these.

Words are lower-cased runs between ASCII white space and punctuation. Items of
fewer than 15 words have masks of their own length besides: with e words that may be exchanged
(a fifth), the item is cut into e + 2 blocks, and every choice of e blocks is
ignored once, so one mask misses all exchanged words wherever they are. Items of fewer than
four words are no passage and match nothing.

The seeds of the test items are broadcast if they number at most
``max_broadcast`` (counted first); beyond that the join shuffles. Hits are made
distinct per document, item and diagonal before the shuffle.

Defined results: null or empty texts match nothing; rows that share an id are
reported under it together (null ids too); repeated items are reported once.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

MASKS = ("1101010011", "11100101001")
LEAST_WORDS, SHORT = 4, 15


def words_of(text: Column) -> Column:
    """Hashes of a text's words, in order."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{Punct}]+")
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seed_at(words: Column, number: int, mask: str):
    kept = [i for i, bit in enumerate(mask) if bit == "1"]
    return lambda at: F.struct(F.xxhash64(F.lit(number), *[F.get(words, at + k) for k in kept]).alias("seed"), at.alias("at"))


def short_masks(n: int) -> list[str]:
    """Masks of n words, one of which ignores all of any n // 5 words."""
    e = n // 5
    block = [k * (e + 2) // n for k in range(n)]
    return ["".join("01"[block[k] not in gone] for k in range(n)) for gone in combinations(range(e + 2), e)]


def seeds_of(words: Column, masks: list[str], short: list[str], item: bool) -> Column:
    """Array of (seed, at): a seed of every mask at every place.

    The ``short`` masks are for items of their own length: an item has one place, a document also
    those where words that may be exchanged lie beyond its ends.
    """
    parts = []
    for number, mask in enumerate([*masks, *short]):
        last = F.size(words) - len(mask)
        beyond = len(mask) // 5 if number >= len(masks) and not item else 0
        fits = last == 0 if number >= len(masks) and item else last + beyond >= 0
        places = F.sequence(F.lit(-beyond), F.greatest(last + beyond, F.lit(0)))
        parts.append(F.when(fits, F.transform(places, _seed_at(words, number, mask))))
    empty = F.array().cast("array<struct<seed:bigint,at:int>>")
    return F.concat(*[F.coalesce(p, empty) for p in parts])


def _overlap(doc: Column, item: Column, diagonal: Column) -> Column:
    """On a diagonal: equal words and begin of the best run, all equal words and the first; begins count words of the document."""
    zero = F.struct(*[F.lit(0).alias(n) for n in ("total", "equal", "begin", "best", "best_equal", "best_begin", "k", "every")],
                    F.lit(None).cast("int").alias("first"))

    def step(s: Column, word: Column) -> Column:
        at = diagonal + s["k"]
        same = F.coalesce((at >= 0) & (F.get(doc, at) == word), F.lit(False))
        fresh = s["total"] <= 0
        total = F.when(fresh, 0).otherwise(s["total"]) + F.when(same, 1).otherwise(-3)
        equal = F.when(fresh, 0).otherwise(s["equal"]) + F.when(same, 1).otherwise(0)
        begin = F.when(fresh, at).otherwise(s["begin"])
        better = total > s["best"]
        return F.struct(total.alias("total"), equal.alias("equal"), begin.alias("begin"),
                        F.when(better, total).otherwise(s["best"]).alias("best"),
                        F.when(better, equal).otherwise(s["best_equal"]).alias("best_equal"),
                        F.when(better, begin).otherwise(s["best_begin"]).alias("best_begin"), (s["k"] + 1).alias("k"),
                        (s["every"] + F.when(same, 1).otherwise(0)).alias("every"), F.coalesce(s["first"], F.when(same, at)).alias("first"))

    return F.aggregate(item, zero, step, lambda s: F.struct(s["best_equal"].alias("equal"), s["best_begin"].alias("begin"),
                                                            s["every"].alias("every"), s["first"].alias("first")))


def contaminated(docs: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS, min_words: int = 10,
                 max_broadcast: int = 1_000_000) -> DataFrame:
    """doc_id, item_id, n_equal, start_word, item_words: the best overlap of each document with each item it holds.

    ``docs`` has doc_id and text, ``items`` item_id and text.
    """
    tests = saved(items.select("item_id", words_of(F.col("text")).alias("item")).where(F.size("item") >= LEAST_WORDS)
                  .distinct(), "decontaminate-items")
    short = [r["n"] for r in tests.where(F.size("item") < SHORT).select(F.size("item").alias("n")).distinct().collect()]
    own = [mask for n in sorted(short) for mask in short_masks(n)]  # of at most 11 lengths
    test_seeds = saved(tests.select("item_id", F.explode(seeds_of(F.col("item"), list(masks), own, True)).alias("s"))
                       .select(F.col("s.seed").alias("item_seed"), "item_id", F.col("s.at").alias("item_at")).distinct(),
                       "decontaminate-seeds")
    small = test_seeds.count() <= max_broadcast
    hashed = docs.select("doc_id", words_of(F.col("text")).alias("words")).where(F.size("words") >= LEAST_WORDS)
    doc_seeds = hashed.select("doc_id", F.explode(seeds_of(F.col("words"), list(masks), own, False)).alias("s")).select("doc_id", "s.seed", "s.at")
    hits = saved(doc_seeds.join(F.broadcast(test_seeds) if small else test_seeds, F.col("seed") == F.col("item_seed"))
                 .select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct(), "decontaminate-hits")
    wanted = hits.select(F.col("doc_id").alias("hit_id"), F.col("item_id").alias("hit_item"), "diagonal")
    compared = (docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("hit_id")))
                .select("doc_id", words_of(F.col("text")).alias("words"), "hit_item", "diagonal")
                .join(F.broadcast(tests) if small else tests, F.col("hit_item") == F.col("item_id"))
                .select("doc_id", "item_id", F.size("item").alias("item_words"),
                        _overlap(F.col("words"), F.col("item"), F.col("diagonal")).alias("run")))
    short_item, run = F.col("item_words") < SHORT, F.col("run")
    most = short_item & (run["every"] >= F.col("item_words") - F.floor(F.col("item_words") / 5))
    best = (compared.where((run["equal"] >= min_words) | most).groupBy("doc_id", "item_id")
            .agg(F.max(F.struct(F.when(short_item, run["every"]).otherwise(run["equal"]).alias("equal"),
                                (-F.when(short_item, run["first"]).otherwise(run["begin"])).alias("back"), "item_words")).alias("best")))
    return best.select("doc_id", "item_id", F.col("best.equal").cast("long").alias("n_equal"),
                       (-F.col("best.back")).cast("long").alias("start_word"), F.col("best.item_words").cast("long").alias("item_words"))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` (all columns) without documents that hold an item; rows sharing such a document's id go with it."""
    gone = contaminated(docs, items).select(F.col("doc_id").alias("kpishift_id")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["kpishift_id"]), "left_anti")
