"""Size-tiered compaction of immutable shards under a versioned manifest.

Arrivals are appended as runs of small Parquet files.  Runs of similar size
share a tier; when a tier has fan_in runs they are merged into one run of
target-sized files.  What a version of the store holds is the list of files in
its manifest, and a commit is the appearance of the next manifest, so readers
see whole versions only.  Files are DataFrame writes; the driver handles names
and sizes alone.
"""

from __future__ import annotations

import json
import math
import random
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import hadoop_fs, remove


class CommitConflict(RuntimeError):
    """Another writer has committed, or is committing, the next version."""


class ShardStore:
    """A store in a folder.  Rows are kept as they are: nulls, empty and long
    texts, repeated rows and all columns, whatever their names; an arrival
    without rows is a version without a new run.

    keep_versions and keep_seconds: how many versions stay, and how long files
    that no kept version names stay for readers that have begun.  A claim on a
    version is void after claim_seconds; a commit that meets another writer's
    is tried again, `tries` times.
    """

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 128 << 20, fan_in: int = 4, small_bytes: int = 1 << 20, keep_versions: int = 2, keep_seconds: float = 3600, claim_seconds: float = 600, tries: int = 8):
        self.spark, self.path = spark, path.rstrip("/")
        self.target, self.fan_in, self.small = target_bytes, fan_in, small_bytes
        self.keep, self.keep_seconds, self.claim_seconds, self.tries = max(1, keep_versions), keep_seconds, claim_seconds, tries
        self.fs, _ = hadoop_fs(spark, self.path)
        self.fs.mkdirs(self._p("_manifest"))
        self._writing: set[str] = set()  # this writer's folders, never orphans

    def _p(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    # -- manifests

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self.fs.listStatus(self._p("_manifest"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        version = version if version is not None else known[-1] if known else 0
        if version == 0:
            return {"version": 0, "schema": None, "runs": []}
        stream = self.fs.open(self._p(f"_manifest/{version:020d}.json"))
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def commit(self, base: dict, runs: list[dict], schema: str) -> dict:
        """Publish base.version + 1.  The version is claimed by a file that only
        one writer can create; the manifest is written aside and renamed.

        A claim that is older than claim_seconds and has no manifest is void:
        the next writer claims the version under the next number, so a claim
        that others rely on is never deleted, and its holder gives up if it
        took too long or a later claim is there.
        """
        version, started = base["version"] + 1, time.monotonic()
        final = self._p(f"_manifest/{version:020d}.json")
        number = self._claims(version)
        if number and time.time() - self.fs.getFileStatus(self._claim(version, number)).getModificationTime() / 1000 <= self.claim_seconds:
            raise CommitConflict(f"version {version} is claimed")
        if self.fs.exists(final) or not self._create(self._claim(version, number + 1), ""):
            raise CommitConflict(f"version {version} is taken")
        aside = self._p(f"_manifest/.{uuid.uuid4().hex}")
        new = {"version": version, "schema": schema, "runs": runs}
        self._create(aside, json.dumps(new))
        late = time.monotonic() - started > self.claim_seconds / 2 or self._claims(version) > number + 1
        if late or self.fs.exists(final) or not self.fs.rename(aside, final):
            self.fs.delete(aside, False)
            raise CommitConflict(f"version {version} could not be published")
        return new

    def _claim(self, version: int, number: int):
        return self._p(f"_manifest/{version:020d}.claim{number:04d}")

    def _claims(self, version: int) -> int:
        """The number of the latest claim on a version, 0 without one."""
        number = 0
        while self.fs.exists(self._claim(version, number + 1)):
            number += 1
        return number

    def _create(self, path, text: str) -> bool:
        if self.fs.exists(path):
            return False
        from py4j.protocol import Py4JJavaError

        try:
            out = self.fs.create(path, False)
        except Py4JJavaError:  # somebody was faster
            return False
        out.write(bytearray(text.encode()))
        out.close()
        return True

    # -- runs

    def _run(self, folder: str) -> dict:
        files, listing = [], self.fs.listFiles(self._p(folder), True)
        while listing.hasNext():
            s = listing.next()
            if s.getPath().getName().startswith("part-"):
                files.append([s.getPath().toString(), s.getLen()])
        files.sort()
        return {"folder": folder, "files": [f for f, _ in files], "bytes": sum(n for _, n in files)}

    def _write(self, df: DataFrame, folder: str, by: list[str] | None = None) -> None:
        self._writing.add(folder)
        out = df.write.option("compression", "zstd")
        (out.partitionBy(*by) if by else out).parquet(f"{self.path}/{folder}")

    def append(self, df: DataFrame) -> dict:
        """One arrival: a run of its own, then a commit."""
        folder = f"runs/{uuid.uuid4().hex}"
        self._write(df, folder)
        return self._add([self._run(folder)], df)[-1]

    def append_batches(self, df: DataFrame, batch: Column, n: int, compact: bool = True) -> list[dict]:
        """n arrivals, numbered 0 to n-1 by a column, written in one pass over
        df and committed one after the other, each followed by compaction."""
        folder = f"runs/{uuid.uuid4().hex}"
        mark = "__arrival_" + uuid.uuid4().hex[:8]
        self._write(df.withColumn(mark, batch), folder, [mark])
        parts = [f"{folder}/{mark}={k}" for k in range(n)]
        runs = [self._run(p) for p in parts if self.fs.exists(self._p(p))]
        return self._add(runs, df, compact)

    def _add(self, runs: list[dict], df: DataFrame, compact: bool = False) -> list[dict]:
        schema, out = df.schema.json(), []
        for run in runs or [None]:
            for left in range(self.tries - 1, -1, -1):
                base = self.manifest()
                if base["schema"] not in (None, schema):
                    raise ValueError("rows of another schema than the store's")
                try:
                    out.append(self.commit(base, base["runs"] + ([run] if run and run["files"] else []), schema))
                    break
                except CommitConflict:  # arrivals commute: add to the version that won
                    if not left:
                        raise
                    time.sleep(random.uniform(0, 0.2 * (self.tries - left)))
            if compact:
                self.compact()
        return out

    # -- compaction

    def tier(self, run: dict) -> int:
        """0 up to small_bytes, then one more for each factor of fan_in."""
        return max(0, math.ceil(math.log(max(1.0, run["bytes"] / self.small), self.fan_in)))

    def done(self, run: dict) -> bool:
        """Its files have the target size, so merging it gains nothing."""
        return run["bytes"] >= len(run["files"]) * self.target / 2

    def candidates(self, runs: list[dict]) -> list[dict]:
        """The oldest fan_in runs of the lowest tier that has so many."""
        tiers: dict[int, list[dict]] = {}
        for run in runs:
            if not self.done(run):
                tiers.setdefault(self.tier(run), []).append(run)
        full = sorted(t for t, members in tiers.items() if len(members) >= self.fan_in)
        return tiers[full[0]][: self.fan_in] if full else []

    def compact(self) -> int:
        """Merge until no tier is full; how many merges were committed."""
        merges = 0
        while True:
            base = self.manifest()
            old = self.candidates(base["runs"])
            if not old:
                return merges
            folder = f"runs/{uuid.uuid4().hex}"
            files = max(1, round(sum(r["bytes"] for r in old) / self.target))
            rows = self._read([f for r in old for f in r["files"]], base["schema"])
            self._write(rows.coalesce(files), folder)
            gone = {r["folder"] for r in old}
            try:  # a merge that meets another writer is given up, not tried again
                self.commit(base, [r for r in base["runs"] if r["folder"] not in gone] + [self._run(folder)], base["schema"])
            except CommitConflict:
                remove(self.spark, f"{self.path}/{folder}")
                raise
            merges += 1
            self.vacuum()

    def vacuum(self) -> None:
        """Delete old manifests with their claims, and runs that no kept one
        names: those of versions that were replaced keep_seconds ago, and what
        a writer that failed has left as long ago."""
        known = self.versions()
        old, kept = known[: -self.keep], known[-self.keep :]
        now = time.time()
        aged = lambda path: now - self.fs.getFileStatus(path).getModificationTime() / 1000 >= self.keep_seconds
        # a version was replaced when the next one appeared
        old = [v for v, after in zip(old, known[1:]) if aged(self._p(f"_manifest/{after:020d}.json"))]
        used = {r["folder"] for v in known if v not in old for r in self.manifest(v)["runs"]}
        for v in old:
            for run in self.manifest(v)["runs"]:
                if run["folder"] not in used:
                    remove(self.spark, f"{self.path}/{run['folder']}")
        for s in self.fs.listStatus(self._p("_manifest")) if old else ():
            name = s.getPath().getName()
            if name.split(".")[0].isdigit() and int(name.split(".")[0]) in old:
                self.fs.delete(s.getPath(), False)
        if kept and self.fs.exists(self._p("runs")):
            tops = {"/".join(f.split("/")[:2]) for f in used}
            for s in self.fs.listStatus(self._p("runs")):
                name = f"runs/{s.getPath().getName()}"
                if name not in tops and name not in self._writing and now - s.getModificationTime() / 1000 >= max(self.keep_seconds, 60 * self.claim_seconds):
                    remove(self.spark, f"{self.path}/{name}")

    # -- reading

    def _read(self, files: list[str], schema: str) -> DataFrame:
        from pyspark.sql.types import StructType

        kind = StructType.fromJson(json.loads(schema))
        if not files:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*files)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest by default."""
        m = self.manifest(version)
        if m["schema"] is None:
            raise ValueError("the store is empty")
        return self._read([f for r in m["runs"] for f in r["files"]], m["schema"])


def shard(docs: DataFrame, path: str, arrivals: int = 8, **knobs) -> ShardStore:
    """Append docs in arrivals, by a hash of doc_id, and compact.

    Every row is stored as it is: nulls, empty and long texts, repeated rows
    and extra columns included.  An empty table commits a version without
    files.  The store is new and has no readers yet, so that merged runs are
    deleted at once.
    """
    store = ShardStore(docs.sparkSession, path, **{"keep_versions": 1, "keep_seconds": 0, **knobs})
    store.append_batches(docs, F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)), arrivals)
    return store


def digest(rows: DataFrame) -> DataFrame:
    """What the query shows of the rows read back, whole texts as MD5."""
    return rows.select("doc_id", "lang", "source", "n_chars", F.length("text").cast("long").alias("text_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


ORACLE = "SELECT doc_id, lang, source, n_chars, length(text)::BIGINT AS text_chars, md5(text) AS text_md5 FROM documents"
