"""A folder of reports that stay: each run replaces the reports it covers and no others.

Layout under the store's root::

    data/<run>/<table>    rows written by one run, never rewritten
    data/<run>/keys       the reports the run covers
    manifests/<name>      for every report: the run that holds its current rows
    commits/<version>     a small file naming the manifest of that version

A run writes its folder, joins its reports into the newest manifest and commits by
creating ``commits/<n>``, which fails if another run has made it in the meantime;
then the newer manifest is read and the step repeated (the data stay written). So a reader, which takes
one version when it starts, sees all of a run or nothing of it, and a failed
run leaves files that nobody reads. The root's file system must refuse to create a file that exists
(as HDFS does).

``vacuum`` removes all but the last versions, and the runs that none of them
names. A run that began before the oldest version left must be repeated.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import col
from .sinks import report_frames

RUN = "__kpi_run"  # reserved: the run that wrote a row


class ReportStore:
    """Reports named by the values of ``keys`` (the report keys, or one column that names a report)."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str]):
        if not keys:
            raise ValueError("a report store needs at least one key column that names a report")
        self.spark, self.root, self.keys = spark, root.rstrip("/"), list(keys)

    # --- small files, through Spark's file system -------------------------------

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _delete(self, *parts: str) -> None:
        self._fs().delete(self._path(*parts), True)

    def _read_commit(self, version: int) -> dict | None:
        stream = self._fs().open(self._path("commits", f"{version:010d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            return None  # being written this moment: not committed yet
        finally:
            stream.close()

    def _create_commit(self, version: int, content: dict) -> bool:
        path = self._path("commits", f"{version:010d}")
        try:
            out = self._fs().create(path, False)
        except Exception:  # noqa: BLE001 - whatever the file system throws for a file that exists
            if self._fs().exists(path):
                return False
            raise
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        return True

    # --- versions ---------------------------------------------------------------

    def versions(self) -> list[int]:
        """Committed versions that are still there, oldest first."""
        found = [int(n) for n in self._names("commits") if n.isdigit()]
        return [v for v in found if v != max(found) or self._read_commit(v) is not None]

    def version(self) -> int:
        """The newest version; 0 for a store without one."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """One row per report: its keys and the run that holds its rows."""
        version = self.version() if version is None else version
        if version not in self.versions():
            raise ValueError(f"the store has no version {version}")
        return self.spark.read.parquet(f"{self.root}/manifests/{self._read_commit(version)['manifest']}")

    # --- writing ----------------------------------------------------------------

    def publish(self, tables: dict[str, DataFrame], covers: DataFrame | None = None) -> int:
        """Replace the reports that ``covers`` names (default: those with a row in a table); returns the version.

        A covered report without rows is empty from then on.
        """
        base = self.version()
        run = f"{base:010d}-{uuid.uuid4().hex}"
        by = [col(k) for k in self.keys]
        for name, df in tables.items():
            missing = [k for k in self.keys if k not in df.columns]
            if missing:
                raise ValueError(f"table {name!r} lacks the key columns {missing}")
            # rows of a report lie together, so that reading one report skips the other row groups
            rows = df.hint("rebalance", *by).sortWithinPartitions(*by)
            rows.withColumn(RUN, F.lit(run)).write.parquet(f"{self.root}/data/{run}/{name}")
        if covers is None:
            covers = None
            for name in tables:
                keys = self.spark.read.parquet(f"{self.root}/data/{run}/{name}").select(*by)
                covers = keys if covers is None else covers.unionByName(keys)
        keys_path = f"{self.root}/data/{run}/keys"
        covers.select(*by).distinct().withColumn(RUN, F.lit(run)).write.parquet(keys_path)
        covered = self.spark.read.parquet(keys_path)
        while True:
            versions = self.versions()
            if base and versions and versions[0] > base:
                raise RuntimeError("the store was cleaned while this run was writing; run it again")
            now = max(versions, default=0)
            new = covered
            if now:
                new = self._joined(self.manifest(now), covered, "left_anti").unionByName(covered)
            name = f"{now + 1:010d}-{uuid.uuid4().hex}"
            new.write.parquet(f"{self.root}/manifests/{name}")
            if self._create_commit(now + 1, {"manifest": name, "tables": sorted(tables), "run": run}):
                return now + 1
            self._delete("manifests", name)  # another run was first

    def publish_report(self, tables, extra: tuple = (), name: str | None = None, covers: DataFrame | None = None) -> int:
        """Publish a :class:`ReportTables`; a report without keys is named ``name`` in the store's one key column.

        The run's metadata are stored with every report it covers.
        """
        tables = tables.materialize()
        frames = dict(report_frames(tables, extra))
        meta = frames.pop("meta")
        if not tables.keys:
            if name is None or len(self.keys) != 1:
                raise ValueError("a report without report_key needs a name and a store with one key column")
            frames = {n: df.withColumn(self.keys[0], F.lit(name)) for n, df in frames.items()}
            covers = self.spark.range(1).select(F.lit(name).alias(self.keys[0]))
        elif covers is None:
            covers = tables.periods.select(*[col(k) for k in self.keys]).distinct()  # also reports without an insight
        constants = meta.first()
        frames["meta"] = covers.select(*[col(k) for k in self.keys]).distinct().select(
            "*", *[(F.array(*map(F.lit, constants[c])).cast("array<string>") if isinstance(constants[c], list) else F.lit(constants[c])).alias(c)
                   for c in meta.columns])
        return self.publish(frames, covers)

    def _joined(self, left: DataFrame, right: DataFrame, how: str, run: bool = False) -> DataFrame:
        keys = [*self.keys, *([RUN] if run else [])]
        right = right.select(*[col(k).alias(f"__kpi_right_{i}") for i, k in enumerate(keys)])
        on = None
        for i, k in enumerate(keys):
            same = left[f"`{k.replace('`', '``')}`"].eqNullSafe(right[f"__kpi_right_{i}"])
            on = same if on is None else on & same
        return left.join(right, on, how)

    # --- reading ----------------------------------------------------------------

    def read(self, table: str, version: int | None = None, key: dict | None = None) -> DataFrame:
        """Current rows of ``table`` of all reports (or of the one report ``key``) in one version.

        Only the folders of runs that the version names are read. Columns that
        a run did not write (reports may differ in their dimensions) are null.
        """
        manifest = self.manifest(version)
        if key is not None:
            if set(key) != set(self.keys):
                raise ValueError(f"a report is named by {self.keys}")
            for k, value in key.items():
                manifest = manifest.where(col(k).eqNullSafe(F.lit(value)))
        runs = [r[0] for r in manifest.select(RUN).distinct().collect()]  # one small row per run still in use
        paths = [p for p in (f"{self.root}/data/{r}/{table}" for r in sorted(runs)) if self._fs().exists(self.spark._jvm.org.apache.hadoop.fs.Path(p))]
        if not paths:
            raise ValueError(f"no report of this version has a table {table!r}")
        rows = self.spark.read.option("mergeSchema", True).parquet(*paths)
        if key is not None:
            for k, value in key.items():
                rows = rows.where(col(k).eqNullSafe(F.lit(value)))  # reaches the scan
            return rows.drop(RUN)
        return self._joined(rows, manifest, "left_semi", run=True).drop(RUN)

    # --- retention --------------------------------------------------------------

    def vacuum(self, keep: int = 2) -> dict[str, int]:
        """Remove all but the last ``keep`` versions and the runs none of them names; how many of each went."""
        if keep < 1:
            raise ValueError("at least one version stays")
        versions = self.versions()
        old, kept = versions[:-keep], versions[-keep:]
        if not old:
            return {"versions": 0, "runs": 0}
        used = {r[0] for v in kept for r in self.manifest(v).select(RUN).distinct().collect()}
        names = {self._read_commit(v)["manifest"] for v in kept}
        for v in old:  # first what readers start from, last what they read
            self._delete("commits", f"{v:010d}")
        for name in self._names("manifests"):
            if name not in names and int(name.split("-")[0]) <= kept[0]:
                self._delete("manifests", name)
        # a run that began at a version still there may be about to commit
        gone = [r for r in self._names("data") if r not in used and int(r.split("-")[0]) < kept[0]]
        for run in gone:
            self._delete("data", run)
        return {"versions": len(old), "runs": len(gone)}
