"""A folder of CSV files that differ in delimiter, column order and columns.

:func:`read_csv` takes the first file's first line for all files. Here every
file's own header line decides: its delimiter (by the same rule), which column
stands where, and which are missing. Rows that do not fit their file's header go
to a table of their own. The plan does not grow with the number of files or
layouts: lines are read as text, joined with their file's header, split by
``from_csv`` and picked by name.

A record is a line (no line breaks within quotes); a quote within quotes is doubled. A line that equals its file's header
is a header wherever it stands, so concatenated files are read too. Column
names are compared without regard to case and outer blanks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import col
from ..operators.hotjoin import join_hot_keys
from ..session import cut_lineage
from .files import _missing

DELIMITERS = (",", ";", "\t")
END = "\x01"               # put behind every line as a last value: its place is the number of values before it
BROADCAST_FILES = 100_000  # headers of more files than this are joined by a shuffle

# Reserved column names.
_FILE, _LINE, _HEADER, _SEP, _NAMES, _VALUES = ("__kpi_file", "__kpi_line", "__kpi_header", "__kpi_sep", "__kpi_names", "__kpi_values")


@dataclass(frozen=True)
class CsvFolder:
    """``rows`` (columns of the schema), ``malformed`` (file, record, reason), ``files`` (file, delimiter, column names)."""

    rows: DataFrame
    malformed: DataFrame
    files: DataFrame


def _delimiter(line):
    """The rule of ``sniff_delimiter`` as a column."""
    n = {d: F.length(line) - F.length(F.replace(line, F.lit(d), F.lit(""))) for d in DELIMITERS}
    return (F.when((n[";"] > n[","]) & (n[";"] > n["\t"]), ";").when((n["\t"] > n[","]) & (n["\t"] > n[";"]), "\t").otherwise(","))


def _with_values(df: DataFrame, line, width: int) -> DataFrame:
    """Adds the line's values as an array ending with ``END``; without ``END`` if there are more than ``width`` or a quote stays open."""
    schema = ", ".join(f"v{i} STRING" for i in range(width + 1))
    parse = lambda d: F.from_csv(F.concat(line, F.lit(d + END)), schema, {"sep": d, "escape": '"'})
    parsed = F.when(F.col(_SEP) == ";", parse(";")).when(F.col(_SEP) == "\t", parse("\t")).otherwise(parse(","))
    once = df.select("*", F.explode(F.array(parsed)).alias("__kpi_parsed"))  # a generator: parsed once, whatever reads it
    return once.withColumn(_VALUES, F.array(*[F.col("__kpi_parsed").getField(f"v{i}") for i in range(width + 1)])).drop("__kpi_parsed")


def _count(values):
    return F.coalesce(F.array_position(values, END), F.lit(0)) - 1


def _headers(lines: DataFrame) -> tuple[DataFrame, int]:
    """(file, header line, delimiter, names in lower case) of every file with a line that is not blank, cut from the scan;
    and the most columns a file can have."""
    first = lines.where("__kpi_start = 0").withColumn("n", F.monotonically_increasing_id())  # counts up within a file's first part
    first = cut_lineage(first.groupBy(_FILE).agg(F.min_by(_LINE, "n").alias(_HEADER)))
    plain = F.regexp_replace(_HEADER, "^\ufeff", "")
    width = first.agg(F.max(F.size(F.split(plain, "[,;\t]")))).first()[0] or 1
    first = first.withColumn(_SEP, _delimiter(plain))
    first = _with_values(first, plain, width)
    names = F.slice(_VALUES, 1, F.greatest(_count(F.col(_VALUES)), F.lit(0)).cast("int"))
    names = F.transform(names, lambda x, i: F.coalesce(F.lower(F.trim(x)), F.concat(F.lit("_c"), i.cast("string"))))
    return first.select(_FILE, _HEADER, _SEP, names.alias(_NAMES)), width


def _lines(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    try:
        text = reader.text(path)
    except AnalysisException as exc:
        if _missing(exc):
            raise FileNotFoundError(f"there is no CSV folder at {path}") from exc
        raise
    return (text.select(F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias("__kpi_start"),
                        F.col("value").alias(_LINE)).where(F.trim(_LINE) != ""))


def _typed(value, dtype: T.DataType):
    """The value as ``dtype``; null for nothing and for what cannot be read."""
    if isinstance(dtype, T.StringType):
        return value
    return F.when(F.trim(value) != "", value.try_cast(dtype))


def _inferred(split: DataFrame) -> T.StructType:
    """One type per name that fits all values of all files: bigint, double, boolean, else text (dates stay text:
    the report finds their format). One more pass; one row per column name comes back."""
    pairs = split.where(F.col("__kpi_fits")).select(F.explode(F.arrays_zip(F.col(_NAMES).alias("name"), F.col(_VALUES).alias("v"))).alias("p"))
    value = F.col("p.v")
    seen = pairs.where(F.col("p.name").isNotNull()).groupBy(F.col("p.name").alias("name")).agg(
        F.count(F.when(F.trim(value) != "", value)).alias("n"),
        *[F.count(_typed(value, t)).alias(k) for k, t in (("long", T.LongType()), ("double", T.DoubleType()), ("bool", T.BooleanType()))]).collect()
    kinds = (("long", T.LongType()), ("double", T.DoubleType()), ("bool", T.BooleanType()))
    return T.StructType([T.StructField(r.name, next((t for k, t in kinds if r.n and r[k] == r.n), T.StringType()))
                         for r in sorted(seen, key=lambda r: r.name)])


def read_csv_folder(spark: SparkSession, path: str, schema: str | T.StructType | None = None, glob: str | None = None) -> CsvFolder:
    """Read every CSV file under ``path`` by its own header.

    ``schema`` (DDL or type) names the columns wanted and their types; a column that a file
    lacks is null in its rows, other columns of the file are left out. Without a schema
    all names found in any header are taken, in alphabetical order and lower case, their types
    inferred from all values (a pass more). Headers are found in one pass over the
    files' first parts. A row is malformed (``reason``) if it has more or fewer values than its
    header has names (``columns``; an open quote counts as such) or a value that cannot be read as its
    column's type (``values``). An empty value is null, except that quoted nothing is an empty text.
    Two columns of one name in one file raise ``ValueError``.
    """
    lines = _lines(spark, path, glob)
    heads, width = _headers(lines)
    counted = heads.agg(F.count(F.lit(1)).alias("n"), F.min(F.when(
        F.size(F.array_distinct(_NAMES)) < F.size(_NAMES), F.col(_FILE))).alias("twice")).first()
    if counted.twice is not None:
        raise ValueError(f"{counted.twice} has two columns of one name")
    lines = lines.drop("__kpi_start")
    if counted.n <= BROADCAST_FILES:
        headed = lines.join(F.broadcast(heads), _FILE)
    else:
        headed = join_hot_keys(lines, heads, [_FILE], "inner")  # one file may hold most lines
    split = (_with_values(headed.where(F.col(_LINE) != F.col(_HEADER)), F.col(_LINE), width)
             .withColumn("__kpi_fits", _count(F.col(_VALUES)) == F.size(_NAMES)))
    if schema is None:
        fields = _inferred(split).fields
    else:
        fields = (schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)).fields
    picked = [F.get(_VALUES, (F.array_position(_NAMES, f.name.strip().lower()) - 1).cast("int")) for f in fields]
    bad = F.lit(False)
    for value, f in zip(picked, fields):
        bad = bad | (F.coalesce(F.trim(value), F.lit("")) != "") & _typed(value, f.dataType).isNull()
    reason = F.when(~F.col("__kpi_fits"), "columns").when(bad, "values")
    good = split.where(reason.isNull()).select(*[_typed(v, f.dataType).alias(f.name) for v, f in zip(picked, fields)])
    malformed = split.where(reason.isNotNull()).select(F.col(_FILE).alias("file"), F.col(_LINE).alias("record"), reason.alias("reason"))
    files = heads.select(F.col(_FILE).alias("file"), F.col(_SEP).alias("delimiter"), F.col(_NAMES).alias("columns"))
    return CsvFolder(good, malformed, files)
