"""A registry of identifiers that grows: people keep the id they got in an earlier run, new ones get the next numbers.

Layout below the registry's folder: ``keys/<part>/`` holds Parquet parts with ``key, id, number, version``, each written by one run and
never changed, and ``commits/<version>.json`` lists the parts of a version. A version exists once its commit file does; that file is renamed
into place and never replaced, so a failed run changes nothing, and of two runs that start from one version only the first can commit.

A run reads its own distinct keys once, looks them up (whichever side is small is broadcast), and numbers the unseen ones by first
appearance. What it writes grows with the new keys, not with the registry.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.text import trim_ws
from veilframe.operators.ids import KeyColumn, first_seen, format_id
from veilframe.operators.lookup import Table
from veilframe.operators.ordered import _PART, global_number, in_global_order
from veilframe.session import file_system, materialize, move_new
from veilframe.sources.sheets import POSITION

SCHEMA = "key string, id string, number long, version long"


class RegistryConflict(RuntimeError):
    """Another run has committed since this one read the registry. Run again: its numbers may be taken."""


@dataclass(frozen=True)
class Version:
    """What a commit file says. ``next_number`` is the first number that no id of the registry has."""

    version: int = 0
    parts: tuple[str, ...] = ()
    rows: int = 0
    key_bytes: int = 0
    next_number: int = 1


@dataclass(frozen=True)
class Growth(Table):
    """The ids of all keys of one run, new ones included, as a lookup table. New ids are only lent until ``commit``."""

    registry: Registry | None = None
    base: Version = Version()
    part: str | None = None
    new_rows: int = 0
    new_bytes: int = 0

    def commit(self) -> int:
        """Make the new ids permanent and return the registry's version. Calling it again changes nothing."""
        newest = self.registry.newest()
        if self.part is None or self.part in newest.parts:
            return newest.version
        if newest.version != self.base.version:
            raise RegistryConflict(f"the registry is at version {newest.version}, this run read version {self.base.version}")
        return self.registry._commit(
            Version(
                self.base.version + 1,
                (*self.base.parts, self.part),
                self.base.rows + self.new_rows,
                self.base.key_bytes + self.new_bytes,
                self.base.next_number + self.new_rows,
            )
        )

    def discard(self) -> None:
        """Remove the lent ids, unless they have been committed."""
        if self.part is not None and self.part not in self.registry.newest().parts:
            self.registry._delete(self.part)


class Registry:
    """The registry in a folder that every executor reaches. A new folder is an empty registry."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self, *names: str):
        return file_system(self.spark, "/".join([self.path, *names]))

    def versions(self) -> list[int]:
        """All committed versions, oldest first."""
        folder, files = self._hadoop("commits")
        if not files.exists(folder):
            return []
        names = [status.getPath().getName() for status in files.listStatus(folder)]
        return sorted(int(name[:-5]) for name in names if re.fullmatch(r"\d+\.json", name))

    def version(self, number: int) -> Version:
        path, files = self._hadoop("commits", f"{number:012d}.json")
        stream = files.open(path)
        try:
            told = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(**{**told, "parts": tuple(told["parts"])})

    def newest(self) -> Version:
        versions = self.versions()
        return self.version(versions[-1]) if versions else Version()

    def read(self, version: Version | None = None) -> DataFrame:
        """``key, id, number, version`` of every key; the version is that of the run that met it first."""
        parts = (version or self.newest()).parts
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/keys/{p}" for p in parts])

    def _write(self, rows: DataFrame) -> str:
        part = uuid.uuid4().hex
        rows.select("key", "id", "number", "version").write.parquet(f"{self.path}/keys/{part}")
        return part

    def _delete(self, part: str) -> None:
        path, files = self._hadoop("keys", part)
        files.delete(path, True)

    def _commit(self, version: Version) -> int:
        name, staged = (f"{self.path}/commits/{n}" for n in (f"{version.version:012d}.json", f".{uuid.uuid4().hex}"))
        path, files = file_system(self.spark, staged)
        stream = files.create(path, False)
        stream.write(json.dumps(version.__dict__).encode())
        stream.close()
        if not move_new(self.spark, staged, name):
            files.delete(path, False)
            raise RegistryConflict(f"version {version.version} of the registry has been committed by another run")
        return version.version

    def seed(self, rows: DataFrame) -> int:
        """Start an empty registry with a caller's ``key, id`` pairs. Keys are trimmed; both must be unique and not blank.

        Numbers go on behind the largest ``ID-<number>`` among them; ids of other forms can't collide with new ones.
        """
        if self.versions():
            raise ValueError("only an empty registry takes a seed")
        pairs = rows.select(trim_ws(F.col("key").cast("string")).alias("key"), F.col("id").cast("string").alias("id"))
        number = F.regexp_extract("id", "^ID-([0-9]+)$", 1).try_cast("long")
        held = materialize(pairs.withColumn("number", number).withColumn("version", F.lit(1).cast("long")), "seed")
        blank = F.coalesce(F.col("key") == "", F.lit(True)) | F.coalesce(F.col("id") == "", F.lit(True))
        rows_, bytes_, top, blanks = held.agg(
            F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("key")), F.lit(0)), F.coalesce(F.max("number"), F.lit(0)), F.count_if(blank)
        ).first()
        if blanks:
            raise ValueError(f"{blanks} pairs of the seed lack a key or an id")
        for name in ("key", "id"):
            if not held.groupBy(name).count().where("count > 1").isEmpty():
                raise ValueError(f"the seed repeats a value of {name}")
        return self._commit(Version(1, (self._write(held),), rows_, bytes_, top + 1))

    def grow(self, columns: list[KeyColumn]) -> Growth:
        """Look up the keys of some columns and lend the unseen ones the next numbers, in order of first appearance."""
        base = self.newest()
        if not columns:
            empty = self.spark.createDataFrame([], "key string, id string")
            return Growth(empty, ("key",), "id", rows=0, key_bytes=0, registry=self, base=base)
        place = ["sheet_idx", POSITION, "col_idx"]
        seen = materialize(first_seen(columns), "seen")
        known = self.read(base).select("key", "id")
        rows, key_bytes, uses = seen.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("key")), F.lit(0)), F.sum("uses")).first()
        if Table(known, ("key",), "id", rows=base.rows, key_bytes=base.key_bytes).fits_broadcast():
            known = F.broadcast(known)
        elif Table(seen, ("key",), "id", rows=rows, key_bytes=key_bytes).fits_broadcast():
            # A small run against a large registry: only the run's keys travel. Of the registry no more than those comes back.
            known = F.broadcast(known.join(F.broadcast(seen.select("key")), "key"))
        found = materialize(seen.join(known, "key", "left"), "found")
        new = in_global_order(found.where("id IS NULL").drop("id"), place, "new")
        parts = new.groupBy(_PART).agg(F.count(F.lit(1)), F.sum(F.octet_length("key"))).collect()
        count, added = sum(r[1] for r in parts), sum(r[2] for r in parts)
        number = global_number({r[0]: r[1] for r in parts}) + F.lit(base.next_number - 1)
        numbered = new.withColumn("number", number.cast("long")).withColumn("id", format_id(F.col("number")))
        part = self._write(numbered.withColumn("version", F.lit(base.version + 1).cast("long"))) if count else None
        ids = found.where("id IS NOT NULL").select("key", "id", "uses").unionByName(numbered.select("key", "id", "uses"))
        return Growth(
            ids, ("key",), "id", rows=rows, key_bytes=key_bytes, uses="uses", total_uses=uses or 0,
            registry=self, base=base, part=part, new_rows=count, new_bytes=added,
        )

    def compact(self) -> int:
        """Write all parts of the newest version as one and commit it; many small runs leave many small parts."""
        base = self.newest()
        if len(base.parts) < 2:
            return base.version
        part = self._write(self.read(base).repartitionByRange("number"))
        return self._commit(Version(base.version + 1, (part,), base.rows, base.key_bytes, base.next_number))
