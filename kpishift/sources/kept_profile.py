"""A column profile that is kept: every input file is sketched once, and again only when it has changed.

Per file and column the store holds row and null counts, how many values each
date format parses, a HyperLogLog sketch of the distinct values and, for numbers,
a KLL sketch of the quantiles. All of them can be merged, so the
profile of all files is an aggregate over one small row per file and column;
the files are not read again. See :class:`~kpishift.sources.kept.KeptFiles` for the ledger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import col
from ..operators.profile import NUMERIC, column_flags, date_counts, with_roles
from .kept import FILE, KeptFiles, _same_form

LOG_REGISTERS = 14  # HyperLogLog: 2^14 registers, relative standard deviation 0.8 %
KLL_SIZE = 400      # KLL: a quantile's rank is off by less than 0.7 % of the rows (99 % of the time)
PROBABILITIES = (0.0, 0.25, 0.5, 0.75, 1.0)


def _distinct_input(c, dtype: T.DataType):
    """A value that the distinct sketch takes: integers and text as they are, others by their text or hash."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("long")
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return F.concat(F.lit(b"\x01"), c.cast("binary"))  # the sketch leaves out empty values, so none is empty
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return (c + F.lit(0.0)).cast("string")  # -0.0 and 0.0 are one value
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        return F.lit(None).cast("long") if isinstance(dtype, (T.MapType, T.VariantType)) else F.when(c.isNotNull(), F.xxhash64(c))
    return c.cast("string")


class KeptProfile(KeptFiles):
    """Kept profile of the files of a folder, whose columns are ``schema``.

    ``read`` turns a list of files into rows (default: Parquet of that schema;
    a column that a file lacks is null there). Nulls count as nulls, NaN is left
    out of the quantiles, maps and variants have no distinct estimate (0).
    Without any row the profile is empty.
    """

    TABLE = "columns"

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, read: Callable[[list[str]], DataFrame] | None = None):
        super().__init__(spark, root)
        self.schema = schema
        self.read = read or (lambda files: spark.read.schema(schema).parquet(*files))

    def rows_of(self, files: list[str]) -> DataFrame:
        """One row per file and column, from one aggregate with a partial one in every task."""
        rows = self.read(files).withColumn(FILE, _same_form(F.col("_metadata.file_path")))
        aggs, args = [F.count(F.lit(1)).alias("__kpi_rows")], [F.lit(len(self.schema.fields))]
        for i, f in enumerate(self.schema.fields):
            c = col(f.name)
            value = _distinct_input(c, f.dataType)
            number = c.cast("double") if isinstance(f.dataType, NUMERIC) else F.lit(None).cast("double")
            aggs += [F.count(c).alias(f"__kpi_n{i}"), F.array(*[x.cast("long") for x in date_counts(c, f.dataType)]).alias(f"__kpi_d{i}"),
                     F.hll_sketch_agg(value, F.lit(LOG_REGISTERS)).alias(f"__kpi_u{i}"),
                     F.kll_sketch_agg_double(number, F.lit(KLL_SIZE)).alias(f"__kpi_q{i}")]
            args += [F.lit(f.name), F.lit(i), *[F.col(f"__kpi_{x}{i}") for x in "nduq"]]
        return rows.groupBy(FILE).agg(*aggs).select(
            FILE, F.col("__kpi_rows").alias("rows"),
            F.stack(*args).alias("column_name", "ordinal", "non_null", "dates", "distinct_sketch", "quantile_sketch"))

    def profile(self, version: int | None = None) -> DataFrame:
        """The rows of ``column_profile`` over all files, and ``quantiles`` (of ``PROBABILITIES``; null without numbers)."""
        fields = self.schema.fields
        formats = max([len(date_counts(col(f.name), f.dataType)) for f in fields], default=1)
        merged = self.store.read(self.TABLE, version).groupBy("column_name", "ordinal").agg(
            F.sum("rows").alias("row_count"), F.sum("non_null").alias("non_null_count"),
            F.greatest(F.lit(0), *[F.coalesce(F.sum(F.get("dates", F.lit(i))), F.lit(0)) for i in range(formats)]).alias("date_like_count"),
            F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct_estimate"),
            F.kll_merge_agg_double("quantile_sketch").alias("sketch"))
        for flag, values in column_flags(fields).items():
            merged = merged.withColumn(flag, F.col("ordinal").isin([i for i, v in enumerate(values) if v]))
        types = F.array(*[F.lit(f.dataType.simpleString()) for f in fields])
        numbers = F.kll_sketch_get_n_double("sketch") > 0
        quantiles = F.when(numbers, F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(p) for p in PROBABILITIES])))
        merged = merged.withColumn("data_type", F.get(types, F.col("ordinal")))
        return with_roles(merged, extra={"quantiles": quantiles})
