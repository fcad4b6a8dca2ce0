"""Daily sums that are kept: every input file is added up once, and again only when it has changed.

The sums of each file (per group and day, see ``operators/ranges.py``) lie in a
:class:`~kpishift.sources.store.ReportStore` whose "reports" are the files, with a
ledger of each file's length and time. ``refresh`` lists the folder, compares
the listing with the ledger, and reads new and changed files only; sums of
files that are gone go. All of it becomes visible with one commit, and
two refreshes at once cannot count a file twice: a file's rows are those of the last
run that covered it. ``days`` adds up the files' sums, which is the daily table that
ranges are taken from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import col
from ..operators.periods import parse_date_column
from ..operators.ranges import daily_sums, merge_daily
from .store import ReportStore

FILE = "__kpi_file"  # reserved


def _same_form(path):
    """Both ways in which Spark writes a file's address (file:/a, file:///a) as one."""
    return F.regexp_replace(path, "^([A-Za-z0-9+.-]+):/+", "$1:/")


class KeptFiles:
    """Something computed per input file, kept in a store with a ledger of the files; see :class:`KeptDays`.

    A subclass names its ``TABLE`` and computes it, with the column ``FILE``, in ``rows_of(files)``.
    """

    TABLE = ""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, ReportStore(spark, root, [FILE])

    def rows_of(self, files: list[str]) -> DataFrame:
        raise NotImplementedError

    def listing(self, folder: str, glob: str = "*.parquet") -> DataFrame:
        """The folder's files (and those of folders in it): path, length, time. Contents are not read."""
        files = (self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder))
        plain = F.regexp_replace("path", r"([\[\]{}*?\\])", r"\\$1")  # readers take these characters for patterns
        return files.select(_same_form(F.col("_metadata.file_path")).alias(FILE), plain.alias("path"), "length",
                            F.col("modificationTime").alias("modified"))

    def refresh(self, folder: str, glob: str = "*.parquet") -> dict[str, int]:
        """Take in what has changed in ``folder``; the numbers of files that are new, changed and gone."""
        now = self.listing(folder, glob)
        fresh = self.store.version() == 0
        if fresh:
            changes = now.withColumn("kind", F.lit("new"))
        else:
            known = self.store.read("ledger").select(F.col(FILE).alias("was"), F.col("length").alias("was_length"), F.col("modified").alias("was_modified"))
            changes = (now.join(known, F.col(FILE) == F.col("was"), "full_outer")
                       .withColumn("kind", F.when(F.col("was").isNull(), "new").when(F.col(FILE).isNull(), "gone")
                                   .when((F.col("length") != F.col("was_length")) | (F.col("modified") != F.col("was_modified")), "changed"))
                       .where("kind IS NOT NULL").withColumn(FILE, F.coalesce(FILE, "was")))
        rows = changes.select(FILE, "path", "length", "modified", "kind").collect()  # names of changed files, as Spark's own listing has them
        counts = {k: sum(r.kind == k for r in rows) for k in ("new", "changed", "gone")}
        if not rows:
            return counts
        ledger = self.spark.createDataFrame([(r[FILE], r.path, r.length, r.modified, r.kind) for r in rows],
                                            f"{FILE} string, path string, length long, modified timestamp, kind string")
        files = [r.path for r in rows if r.kind != "gone"]
        kept = self.rows_of(files) if files else self.store.read(self.TABLE).limit(0)
        self.store.publish({self.TABLE: kept, "ledger": ledger.where("kind <> 'gone'").drop("kind")}, ledger.select(FILE))
        return counts


class KeptDays(KeptFiles):
    """Kept daily sums of ``metrics`` (name -> type of the sum) by ``dims`` under ``root``.

    ``read`` turns a list of files into rows (with its own schema and options);
    ``prepare``, if given, works on these rows (derived metrics, say).
    """

    TABLE = "days"

    def __init__(self, spark: SparkSession, root: str, read: Callable[[list[str]], DataFrame], date_col: str, dims: list[str],
                 metrics: dict[str, T.DataType], prepare: Callable[[DataFrame], DataFrame] | None = None, date_format: str | None = None):
        super().__init__(spark, root)
        self.read, self.prepare = read, prepare
        self.date_col, self.date_format = date_col, date_format
        self.dims, self.metrics = list(dims), dict(metrics)

    def rows_of(self, files: list[str]) -> DataFrame:
        return self.sums(files)

    def sums(self, files: list[str]) -> DataFrame:
        """Daily sums of each of ``files``."""
        rows = self.read(files)
        rows = rows.withColumn(FILE, _same_form(F.col("_metadata.file_path")))
        rows = self.prepare(rows) if self.prepare else rows
        return daily_sums(parse_date_column(rows, self.date_col, self.date_format), self.date_col, self.dims, list(self.metrics), (FILE,))

    def days(self, version: int | None = None) -> DataFrame:
        """Daily sums over all files."""
        return merge_daily(self.store.read("days", version).select(*[col(d) for d in self.dims], *self._columns()), self.dims, list(self.metrics))

    def _columns(self) -> list:
        from ..operators.ranges import DAY, ROWS, sum_columns

        return [DAY, ROWS, *[col(c) for c in sum_columns(list(self.metrics))]]

    def daily(self) -> tuple[DataFrame, dict]:
        """What ``run_range_report(daily=...)`` takes."""
        return self.days(), self.metrics
