"""A fact table stored by month, replaced atomically: data folders and a manifest that is swapped last.

``<path>/data/<id>/month=YYYY-MM`` holds rows that never change once written. ``<path>/manifests/<version>`` lists, for every
month, the folder that holds it. A write puts the months it replaces into a new folder and then renames a finished manifest
into place; until that moment readers see the version before, whatever failed in between. A reader is bound to the version
it opened, as no folder of it is altered. Two writers cannot both publish a version: the second rename finds it taken.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from returnlens.operators.upsert import upsert


class Conflict(RuntimeError):
    """Another writer has published the version that this write was to become."""


class SnapshotStore:
    def __init__(self, spark: SparkSession, path: str, day: str = "event_date", by: str = "security_id"):
        self.spark, self.path, self.day, self.by = spark, path.rstrip("/"), day, by
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._hadoop.Path("/".join([self.path, *[p for p in parts if p]]))

    def versions(self) -> list[int]:
        """Published versions, oldest first."""
        folder = self._at("manifests")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit())

    def manifest(self, version: int | None = None) -> dict[str, str]:
        """Month to data folder of a version, the newest by default; one entry a month of the calendar."""
        known = self.versions()
        if not known:
            return {}
        stream = self._fs.open(self._at("manifests", f"{known[-1] if version is None else version:012d}"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return dict(line.split("\t") for line in text.splitlines())

    def read(self, version: int | None = None, months: list[str] | None = None) -> DataFrame | None:
        """Rows of a version, or of some of its months; None where there are none."""
        held = self.manifest(version)
        folders = [f"{self.path}/data/{folder}/month={month}" for month, folder in sorted(held.items()) if months is None or month in months]
        return self.spark.read.parquet(*folders) if folders else None

    def write(self, df: DataFrame) -> int:
        """Replace the months that ``df`` has rows of; the new version's number."""
        return self.publish(*self.stage(df))

    def stage(self, df: DataFrame) -> tuple[int, dict[str, str]]:
        """Write the months of ``df`` where no reader looks: the version they are based on and the folder of each month."""
        known = self.versions()
        folder = uuid.uuid4().hex
        month = F.date_format(self.day, "yyyy-MM")
        df.withColumn("month", month).repartition("month", F.col(self.by)).write.partitionBy("month").parquet(f"{self.path}/data/{folder}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("data", folder))]
        return (known[-1] if known else 0), {n.removeprefix("month="): folder for n in names if n.startswith("month=")}

    def publish(self, base: int, replaced: dict[str, str]) -> int:
        """Make staged months the next version after ``base``: the one step that readers can see."""
        entries = (self.manifest(base) if base else {}) | replaced
        draft, final = self._at("drafts", uuid.uuid4().hex), self._at("manifests", f"{base + 1:012d}")
        stream = self._fs.create(draft)
        try:
            stream.write(bytearray("".join(f"{m}\t{f}\n" for m, f in sorted(entries.items())).encode()))
        finally:
            stream.close()
        self._fs.mkdirs(final.getParent())
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise Conflict(f"version {base + 1} of {self.path} exists already")
        return base + 1

    def merge(self, incoming: DataFrame, key: list[str], newest: list[Column]) -> int:
        """Write ``incoming`` over the stored rows on ``key``; only months it has rows of are read and replaced.

        Months are part of the key's day, so a key never moves between them.
        """
        months = [r["month"] for r in incoming.select(F.date_format(self.day, "yyyy-MM").alias("month")).distinct().collect()]
        stored = self.read(months=months)
        if stored is None:
            stored = incoming.where("false")
        return self.write(upsert(stored.select(*incoming.columns), incoming, key, newest))

    def vacuum(self, keep: int = 2) -> None:
        """Remove the data of versions older than the newest ``keep``; readers of those must have finished."""
        kept = self.versions()[-keep:]
        used = {folder for v in kept for folder in self.manifest(v).values()}
        for version in self.versions():
            if version not in kept:
                self._fs.delete(self._at("manifests", f"{version:012d}"), False)
        for status in self._fs.listStatus(self._at("data")):
            if status.getPath().getName() not in used:
                self._fs.delete(status.getPath(), True)
