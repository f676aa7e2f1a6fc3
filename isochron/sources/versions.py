"""Tables that are changed version by version, each only if its rules hold.

Files have no constraints and no triggers, so a change is written aside, checked, and made the current version by one new
manifest; readers see the version before it until then, and for good if it is refused. A manifest names the folder of
each part of the table. A change rewrites the parts that it touches and takes over the folders of all others.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isochron.operators import integrity, temporal

_PART = "of_part"


class Refused(ValueError):
    """A change that breaks rules: how many rows break each is in ``broken``. Nothing has changed."""

    def __init__(self, broken: dict[str, int]):
        super().__init__(", ".join(f"{k}: {n}" for k, n in sorted(broken.items())))
        self.broken = broken


class Outdated(RuntimeError):
    """Somebody else made the next version first. Nothing of this change is seen; read anew and try again."""


@dataclass
class Rules:
    """What has to hold of every version. ``key`` names a row for good; the others may be left out.

    ``rows`` makes the rules of single rows, once a session is there. ``disjoint`` is (keys, start, end): live rows of
    equal keys must not meet in time. With ``stamp`` rows are only added, and only that column changes, once, from null.
    All rows of a key, and all of equal keys of ``disjoint``, lie in one part.
    """

    key: str
    rows: Callable[[], dict[str, Column]] = dict
    disjoint: tuple[list[str], str, str] | None = None
    stamp: str | None = None


@dataclass
class Version:
    """A manifest: its number and the folder of each part."""

    number: int
    parts: dict[str, str] = field(default_factory=dict)


class VersionedTable:
    """A table under ``path`` whose rows are dealt to parts by ``part``, a column of few values such as a chapter."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, part: Callable[[], Column], rules: Rules):
        self.spark, self.path, self.schema, self.part, self.rules = spark, path.rstrip("/"), schema, part, rules

    # Files, through the file system that the path names.

    def _at(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        fs, at = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _numbers(self) -> list[int]:
        return sorted(int(m[1]) for n in self._names("manifests") if (m := re.fullmatch(r"(\d{10})\.json", n)))

    def _manifest(self, number: int) -> Version | None:
        """The manifest of a number; None where a writer died before it was whole."""
        fs, at = self._at(f"manifests/{number:010d}.json")
        stream = fs.open(at)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return Version(number, json.loads(text))
        except ValueError:
            return None

    def current(self) -> Version:
        """The newest whole version; number 0 without parts before the first."""
        for number in reversed(self._numbers()):
            found = self._manifest(number)
            if found is not None:
                return found
        return Version(0)

    def read(self, version: Version | int | None = None, parts: list[str] | None = None) -> DataFrame:
        """The rows of a version, the newest unless told otherwise, of all parts or some; only their folders are opened."""
        if isinstance(version, int):
            version = self._manifest(version)
        version = version or self.current()
        folders = [f"{self.path}/data/{folder}/{_PART}={p}" for p, folder in version.parts.items() if parts is None or p in parts]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(*folders)

    # Changes.

    def _parts_of(self, rows: DataFrame) -> list[str]:
        return sorted(r[0] for r in rows.select(self.part().cast("string").alias("p")).distinct().collect())

    def broken(self, old: DataFrame, new: DataFrame) -> dict[str, int]:
        """How many rows of ``new`` break each rule, those that none breaks left out."""
        rules, row_rules, found = self.rules, self.rules.rows(), {}
        checks = [integrity.violations(new, row_rules).groupBy("rule").count()] if row_rules else []
        checks.append(integrity.duplicates(new, [rules.key]).agg(F.lit("unique_key").alias("rule"), F.count(F.lit(1)).alias("count")))
        if rules.disjoint:
            keys, start, end = rules.disjoint
            live = new.where(F.col(rules.stamp).isNull()) if rules.stamp else new
            checks.append(temporal.overlap_flags(live, keys, start, end, [rules.key]).agg(F.lit("overlap").alias("rule"), F.count(F.lit(1)).alias("count")))
        if rules.stamp:
            checks.append(integrity.append_only_diff(old, new, rules.key, rules.stamp).groupBy(F.col("violation").alias("rule")).count())
        for check in checks:
            found |= {r["rule"]: r["count"] for r in check.collect() if r["count"]}
        return found

    def commit(self, rows: DataFrame, touched: list[str], base: Version) -> Version:
        """Make ``rows`` the content of the ``touched`` parts in the version after ``base``, if the rules hold.

        The rows are written aside first and checked as they were written. ``Refused`` leaves the table as it is.
        ``Outdated`` says that ``base`` is no longer the newest: the new manifest is created without overwriting, so of
        two writers at most one makes a version; that is as safe as the file system's exclusive creation.
        """
        folder = uuid.uuid4().hex
        rows.select(*self.schema.names, self.part().cast("string").alias(_PART)).write.partitionBy(_PART).parquet(f"{self.path}/data/{folder}")
        held = [n.partition("=")[2] for n in self._names(f"data/{folder}") if n.startswith(f"{_PART}=")]
        staged = Version(0, dict.fromkeys(held, folder))
        broken = self.broken(self.read(base, touched), self.read(staged))
        if stray := set(held) - set(touched):
            broken["part"] = len(stray)
        if broken:
            self._delete(f"data/{folder}")
            raise Refused(broken)
        parts = {p: f for p, f in base.parts.items() if p not in touched} | staged.parts
        if self.current().number != base.number:
            self._delete(f"data/{folder}")
            raise Outdated(f"version {base.number} is no longer the newest")
        # Behind manifests that a writer left unfinished, which count as none.
        number = max([base.number, *self._numbers()]) + 1
        fs, at = self._at(f"manifests/{number:010d}.json")
        try:
            stream = fs.create(at, False)
        except Exception as e:
            self._delete(f"data/{folder}")
            raise Outdated(f"version {number} is there already") from e
        stream.write(bytearray(json.dumps(parts, sort_keys=True).encode()))
        stream.close()
        return Version(number, parts)

    def _delete(self, name: str) -> None:
        fs, at = self._at(name)
        fs.delete(at, True)

    def append(self, rows: DataFrame, base: Version | None = None) -> Version:
        """Add rows to their parts."""
        base = base or self.current()
        touched = self._parts_of(rows)
        return self.commit(self.read(base, touched).unionByName(rows.select(*self.schema.names)), touched, base)

    def supersede(self, gone: DataFrame, when: Column | None = None, base: Version | None = None) -> Version:
        """Stamp live rows named in ``gone`` (key), with the time of the write unless told otherwise."""
        base = base or self.current()
        named = self.read(base).join(gone.select(self.rules.key).distinct(), self.rules.key, "left_semi")
        touched = self._parts_of(named)
        stamp = when if when is not None else F.current_timestamp().cast(self.schema[self.rules.stamp].dataType)
        return self.commit(temporal.supersede(self.read(base, touched), gone, self.rules.key, stamp, self.rules.stamp), touched, base)

    def replace(self, rows: DataFrame, base: Version | None = None) -> Version:
        """Make ``rows`` the content of the parts that they lie in; what else lay there goes, if the rules let it."""
        return self.commit(rows, self._parts_of(rows), base or self.current())

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete folders that none of the newest ``keep`` versions names; tells them. No writer may be at work."""
        newest = [m for n in reversed(self._numbers()) if (m := self._manifest(n))][:keep]
        needed = {f for m in newest for f in m.parts.values()}
        unused = [n for n in self._names("data") if n not in needed]
        for n in unused:
            self._delete(f"data/{n}")
        return unused
