"""Versioned publication: content-addressed snapshots, quality gates, retention, and one pointer that readers follow."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Gate:
    """What a candidate must meet; changes are shares of the previous snapshot's counts."""

    least_source: int = 1
    least_match_rate: float = 0.0
    most_source_change: float = 1.0
    most_blocked_change: float = 1.0

    def failures(self, metrics: dict, previous: dict | None = None) -> list[str]:
        points = metrics["points"]
        rate = metrics["matched"] / points if points else 1.0
        change = lambda k: 0.0 if previous is None else (abs(metrics[k] - previous[k]) / previous[k] if previous[k] else float(metrics[k] != 0))
        checks = {
            "too few source records": metrics["source"] < self.least_source,
            "match rate too low": rate < self.least_match_rate,
            "source count changed too much": change("source") > self.most_source_change,
            "blocked edges changed too much": change("blocked") > self.most_blocked_change,
        }
        return [k for k, bad in checks.items() if bad]


class LeaseLost(RuntimeError):
    """Another writer holds the store, or has taken it over since."""


@dataclass(frozen=True)
class Lease:
    """The right to publish until a time; fences rise with every writer, so an older one can be told."""

    fence: int
    owner: str
    until: float


def version_of(inputs: dict[str, str]) -> str:
    """SHA-256 of the sorted input versions."""
    return hashlib.sha256("|".join(f"{k}={inputs[k]}" for k in sorted(inputs)).encode()).hexdigest()


class SnapshotStore:
    """A folder of snapshots named by their content, on any file system that Spark reads.

    Tables are written under _staging and renamed as a whole; the pointer CURRENT is replaced by one rename only then, so a failed build
    leaves the previous snapshot in service and a reader that has resolved a version keeps reading it.

    One writer at a time: publish() takes a lease, a numbered file under _leases that only one writer can create. A writer that
    dies leaves it to run out, after which the next number may be taken; each step of a publication that others see first checks
    that its own number is still the last and its time not over, so a writer that was held up changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _put(self, name: str, text: str) -> None:
        fresh = self._path(f"{name}.new")
        out = self.fs.create(fresh, True)
        out.write(bytearray(text.encode()))
        out.close()
        # one rename that replaces: a crash leaves either the old text or the new
        fs = self.jvm.org.apache.hadoop.fs
        how = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        how[0] = fs.Options.Rename.OVERWRITE
        context = fs.FileContext.getFileContext(self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(self.fs.makeQualified(fresh), self.fs.makeQualified(self._path(name)), how)

    def _get(self, name: str) -> str | None:
        if not self.fs.exists(self._path(name)):
            return None
        source = self.fs.open(self._path(name))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def current(self) -> str | None:
        return self._get("CURRENT")

    def manifest(self, version: str) -> dict:
        return json.loads(self._get(f"{version}/manifest.json") or "{}")

    def _leases(self) -> list[int]:
        at = self._path("_leases")
        if not self.fs.exists(at):
            return []
        return sorted(int(n) for n in (x.getPath().getName() for x in self.fs.listStatus(at)) if n.isdigit())

    def acquire(self, owner: str = "", seconds: float = 3600.0, now: float | None = None) -> Lease | None:
        """Takes the store's lease; None if another writer has it. A lease that was released or has run out can be taken over."""
        now = time.time() if now is None else now
        known = self._leases()
        if known:
            last = self._get(f"_leases/{known[-1]}")
            # a holder that died before it wrote its time counts from when its file was made
            until = json.loads(last)["until"] if last else self.fs.getFileStatus(self._path(f"_leases/{known[-1]}")).getModificationTime() / 1000 + seconds
            if until > now and not self.fs.exists(self._path(f"_leases/{known[-1]}.done")):
                return None
        lease = Lease(known[-1] + 1 if known else 1, owner or uuid.uuid4().hex, now + seconds)
        try:
            out = self.fs.create(self._path(f"_leases/{lease.fence}"), False)
        except Exception:  # the file system refuses what exists: another was quicker
            return None
        out.write(bytearray(json.dumps({"owner": lease.owner, "until": lease.until}).encode()))
        out.close()
        for old in known[:-1]:
            self.fs.delete(self._path(f"_leases/{old}"), False)
            self.fs.delete(self._path(f"_leases/{old}.done"), False)
        return lease

    def release(self, lease: Lease) -> None:
        self.fs.create(self._path(f"_leases/{lease.fence}.done"), True).close()

    def check(self, lease: Lease, now: float | None = None) -> None:
        """Raises LeaseLost unless the lease is the last one and still runs."""
        if self._leases()[-1:] != [lease.fence] or (time.time() if now is None else now) >= lease.until:
            raise LeaseLost(f"lease {lease.fence} of {lease.owner} is over")

    @contextmanager
    def leased(self, lease: Lease | None = None, seconds: float = 3600.0) -> Iterator[Lease | None]:
        """The given lease, or one of its own for the time of a block; None if another writer has the store."""
        own = lease or self.acquire(seconds=seconds)
        try:
            yield own
        finally:
            if own and not lease:
                self.release(own)

    def publish(self, inputs: dict[str, str], tables: dict[str, DataFrame], metrics: dict, gate: Gate | None = None, source: str | None = None, lease: Lease | None = None) -> tuple[str, str]:
        """(version, outcome): BUSY if another writer has the store, NO_CHANGE if the version is in service, REJECTED with its reasons
        kept under _quarantine, else PUBLISHED.

        source: a file that is kept under _backup before the version goes into service. Raises LeaseLost, with nothing seen by
        readers, if the writer's time ran out meanwhile; what it staged goes with the next publication of that version."""
        version = version_of(inputs)
        with self.leased(lease) as own:
            if own is None:
                return version, "BUSY"
            before = self.current()
            if version == before:
                return version, "NO_CHANGE"
            previous = self.manifest(before)["metrics"] if before else None
            if failed := (gate or Gate()).failures(metrics, previous):
                self.quarantine(version, {"inputs": inputs, "metrics": metrics, "failures": failed})
                return version, "REJECTED"
            if not self.fs.exists(self._path(version)):
                staging = f"_staging/{version}-{own.fence}"
                for name, df in tables.items():
                    df.write.mode("overwrite").parquet(f"{self.root}/{staging}/{name}")
                self._put(f"{staging}/manifest.json", json.dumps({"inputs": inputs, "metrics": metrics, "tables": sorted(tables), "fence": own.fence}))
                self.check(own)
                self.fs.rename(self._path(staging), self._path(version))
            if source:
                self.backup(source)
            self.check(own)
            self._put("CURRENT", version)
            return version, "PUBLISHED"

    def quarantine(self, name: str, what: dict) -> None:
        """Keeps what was refused, or failed, with its reasons."""
        self.fs.mkdirs(self._path("_quarantine"))
        self._put(f"_quarantine/{name}.json", json.dumps(what))

    def by_batch(self, stream: str, work: Callable[[DataFrame, int], object]) -> Callable[[DataFrame, int], None]:
        """work as a foreachBatch function that runs once for each batch, whatever is repeated.

        A batch's number is noted after its work is done; a batch that comes again after a crash between both finds its version in
        service already, one that was noted is left out. A batch whose work raises is kept under _quarantine with the error, and
        raises on, so that the stream stops and the snapshot in service stays.
        """

        def run(batch: DataFrame, number: int) -> None:
            note = f"_batches/{stream}"
            if int(self._get(note) or -1) >= number:
                return
            try:
                work(batch, number)
            except Exception as e:
                self.quarantine(f"{stream}-{number}", {"stream": stream, "batch": number, "error": str(e)[:2000]})
                raise
            self.fs.mkdirs(self._path("_batches"))
            self._put(note, str(number))

        return run

    def backup(self, path: str) -> str:
        """Copies a file under _backup, named by its content; a copy that is there is only touched. Returns the hash."""
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        row = self.spark.read.format("binaryFile").load(path).selectExpr("sha2(content, 256) as hash").first()
        to = self._path(f"_backup/{row['hash']}")
        if self.fs.exists(to):
            self.fs.setTimes(to, int(time.time() * 1000), -1)
        else:
            conf = self.spark.sparkContext._jsc.hadoopConfiguration()
            self.jvm.org.apache.hadoop.fs.FileUtil.copy(at.getFileSystem(conf), at, self.fs, to, False, conf)
        return row["hash"]

    def read(self, table: str, version: str | None = None) -> DataFrame:
        version = version or self.current()
        if version is None:
            raise LookupError("no snapshot has been published")
        return self.spark.read.parquet(f"{self.root}/{version}/{table}")

    def prune(self, keep: int) -> list[str]:
        """Deletes all but the newest `keep` snapshots; the one in service always stays."""
        found = [s for s in self.fs.listStatus(self._path("")) if s.isDirectory() and len(s.getPath().getName()) == 64]
        found.sort(key=lambda s: (-s.getModificationTime(), s.getPath().getName()))
        gone = [s.getPath().getName() for s in found[keep:] if s.getPath().getName() != self.current()]
        for name in gone:
            self.fs.delete(self._path(name), True)
        return gone

    def ready(self, **expected: str) -> bool:
        """Whether a snapshot is in service whose inputs have the expected versions."""
        version = self.current()
        inputs = self.manifest(version).get("inputs", {}) if version else {}
        return version is not None and all(inputs.get(k) == v for k, v in expected.items())
