"""Equi-joins of a table whose join keys are far from equally frequent.

One key with a third of all rows makes one task of a shuffled join do a third
of the work. :func:`join_hot_keys` finds such keys by a mergeable frequency
sketch over the key columns, deals the rows of each over several salts in
proportion to its share, and repeats the right rows of these keys once per
salt; all other keys are joined as they are. For joins that drop left
rows without a partner, a Bloom filter of the right keys drops most of them
before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import col
from ..session import cut_lineage

HOWS = ("left", "inner", "right", "outer")
MAX_PARTS = 16384        # a key is never called hot below this share (one in MAX_PARTS) of the rows
SLOTS_PER_PART = 16      # sketch slots per part: counts are off by at most 3.5 / 16 of a part
BLOOM_WORDS = 1 << 18    # 64-bit words of the Bloom filter: the most rows its table can have
BLOOM_BITS = 4           # bits set per key, all in one word

# Reserved column names.
_HASH, _COPIES, _SALT, _WORD, _BITS = ("__kpi_key_hash", "__kpi_copies", "__kpi_salt", "__kpi_word", "__kpi_bits")


def _parts(df: DataFrame, parts: int | None) -> int:
    if parts is None:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(parts, MAX_PARTS))


def _hash(keys: list[str]):
    """One number per key, nulls included (null keys are as good as any at filling one task)."""
    return F.xxhash64(*[col(k) for k in keys])


def hot_keys(df: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """``(key hash, copies)`` of every key with more rows than one of ``parts`` equal parts of ``df``.

    One aggregate over the key columns: every task keeps a frequent-items
    sketch of fixed size, and the sketches are merged. A key with its share is
    never missed; counts may be too high by a fifth of a part, so
    fewer than two keys a part come out, however many rows there are. ``copies`` is twice
    the number of parts the key would fill.
    """
    parts = _parts(df, parts)
    found = df.select(_hash(keys).alias(_HASH)).agg(
        F.expr(f"approx_top_k({_HASH}, {2 * parts}, {SLOTS_PER_PART * parts})").alias("top"),
        F.count(F.lit(1)).alias("n"))
    return (found.select("n", F.inline("top").alias("item", "rows")).where(F.col("rows") * parts > F.col("n"))
            .select(F.col("item").alias(_HASH), F.ceil(F.col("rows") * (2 * parts) / F.col("n")).cast("int").alias(_COPIES)))


def _bloom_columns(keys: list[str]) -> tuple:
    """(word, mask) of a key: a word by one hash, bits in it by another."""
    h = _hash(keys)
    mask = None
    for i in range(BLOOM_BITS):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
        mask = bit if mask is None else mask.bitwiseOR(bit)
    return F.pmod(F.xxhash64(*[col(k) for k in keys], F.lit(BLOOM_WORDS)), F.lit(BLOOM_WORDS)).cast("int"), mask


def maybe_partnered(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``left`` whose key may be in ``right``: none with a partner is lost, most others are.

    The filter is a table of at most ``BLOOM_WORDS`` rows at any size of ``right``
    (with several million keys on the right it lets most rows through).
    """
    word, mask = _bloom_columns(keys)
    table = right.select(word.alias(_WORD), mask.alias(_BITS)).groupBy(_WORD).agg(F.bit_or(_BITS).alias(_BITS))
    probe = left.select(*[col(c) for c in left.columns], word.alias(_WORD))
    return (probe.join(F.broadcast(table), _WORD).where(F.col(_BITS).bitwiseAND(mask) == mask)
            .select(*[col(c) for c in left.columns]))


def _not_null(df: DataFrame, keys: list[str]) -> DataFrame:
    for k in keys:
        df = df.where(col(k).isNotNull())
    return df


def join_hot_keys(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", parts: int | None = None) -> DataFrame:
    """``left.join(right, on, how)``: the same rows and columns, hot keys of ``left`` spread over tasks.

    ``parts``: a key with more than one part in ``parts`` of the rows is hot (default:
    the number of shuffle partitions). Costs one more pass over the key columns
    of ``left``, run when this is called (its small result is checkpointed); for ``right`` and ``outer`` a second one, as right rows
    without a partner are taken by an anti-join with the distinct left keys
    (each of their copies would otherwise come out alone).

    The salt of a row is a hash of all its values and of the number of its
    input partition: a task that is run again deals its rows the same way,
    and rows that are equal throughout are spread as far as they lie in several
    partitions. Keys must have the same type on both sides, other columns different names.
    """
    how = {"full": "outer", "full_outer": "outer", "left_outer": "left", "right_outer": "right"}.get(how, how)
    if how not in HOWS:
        raise ValueError(f"how is one of {', '.join(HOWS)}; got {how!r}")
    keys = list(on)
    if not same_key_types(left, right, keys):
        raise ValueError(f"the keys {keys} differ in type between the two sides: cast them first")
    clash = [c for c in right.columns if c in left.columns and c not in keys]
    if clash:
        raise ValueError(f"both sides have columns {clash}")
    extra = [c for c in right.columns if c not in keys]
    rest = [c for c in left.columns if c not in keys]
    # Written once: sketches merged in another order may count otherwise, and both sides must agree on the copies.
    # Fewer than two rows a part, MAX_PARTS parts at most.
    hot = F.broadcast(cut_lineage(hot_keys(left, keys, parts)))
    facts = maybe_partnered(left, right, keys) if how in ("inner", "right") else left
    spread = F.pmod(F.xxhash64(*[col(c) for c in left.columns], F.spark_partition_id()), F.col(_COPIES)).cast("int")
    salted = (facts.withColumn(_HASH, _hash(keys)).join(hot, _HASH, "left")
              .select(*[col(c) for c in left.columns], F.coalesce(spread, F.lit(0)).alias(_SALT)))
    repeated = (_not_null(right, keys).withColumn(_HASH, _hash(keys)).join(hot, _HASH, "left")
                .select(*[col(c) for c in keys + extra],
                        F.explode(F.sequence(F.lit(0), F.coalesce(F.col(_COPIES), F.lit(1)) - 1)).alias(_SALT)))
    matched = salted.join(repeated, [*keys, _SALT], "inner" if how in ("inner", "right") else "left")
    out = [col(c) for c in keys + rest + extra]
    matched = matched.select(*out)
    if how in ("left", "inner"):
        return matched
    present = left.select(*[col(k) for k in keys]).distinct()  # summed up in the map tasks: a hot key is one row each
    alone = right.join(present, keys, "left_anti")
    types = {f.name: f.dataType for f in left.schema.fields}
    return matched.unionByName(alone.select(
        *[col(k) for k in keys], *[F.lit(None).cast(types[c]).alias(c) for c in rest], *[col(c) for c in extra]))


def same_key_types(left: DataFrame, right: DataFrame, keys: list[str]) -> bool:
    return all(left.schema[k].dataType == right.schema[k].dataType for k in keys)
