"""Exclusive claims on a table by claim files (K3, K6).

A claim is a file that is created only if it is not there, which a file system
grants to one of several writers. Claims of a table are numbered; the highest one
holds. It ends when its holder adds a release file, or when its lease runs out
without renewal, so a writer that died keeps nobody out for longer than a lease.
A holder asks before each step whether its claim is still the highest: one that
was taken for dead finds out before it writes.
"""
from __future__ import annotations

import time
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

LEASE_SECONDS = 600.0


class ClaimLost(RuntimeError):
    """Another writer has taken over the claim."""


def claims_path(table: str) -> str:
    return table.rstrip("/") + "_claims"


class Claim:
    """A claim on a table; :meth:`take` tells whether it was granted."""

    def __init__(self, spark: SparkSession, table: str, seconds: float = LEASE_SECONDS):
        self.jvm = spark.sparkContext._jvm
        self.folder = self.jvm.org.apache.hadoop.fs.Path(claims_path(table))
        self.fs = self.folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.seconds, self.owner, self.number = seconds, uuid.uuid4().hex, None

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.folder, name)

    def _create(self, name: str, text: str) -> bool:
        """Create a file if it is not there; whether this call did."""
        from py4j.protocol import Py4JJavaError
        try:
            out = self.fs.create(self._at(name), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()) or "already exists" in str(e.java_exception.getMessage()):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _numbers(self) -> dict[int, set[str]]:
        """Claims by number, with the kinds of their files: claim, renewed, released."""
        out: dict[int, set[str]] = {}
        if self.fs.exists(self.folder):
            for status in self.fs.listStatus(self.folder):
                number, _, kind = status.getPath().getName().partition(".")
                if number.isdigit():
                    out.setdefault(int(number), set()).add(kind)
        return out

    def _ended(self, number: int, kinds: set[str]) -> bool:
        if "released" in kinds:
            return True
        last = max(self.fs.getFileStatus(self._at(f"{number}.{k}")).getModificationTime() for k in kinds)
        return time.time() - last / 1000 >= self._lease_of(number)

    def _lease_of(self, number: int) -> float:
        stream = self.fs.open(self._at(f"{number}.claim"))
        try:
            text = bytes(b & 0xFF for b in iter(stream.read, -1)).decode()
        finally:
            stream.close()
        return float(text.split()[1]) if len(text.split()) > 1 else self.seconds

    def take(self) -> bool:
        numbers = self._numbers()
        last = max(numbers, default=0)
        if last and not self._ended(last, numbers[last]):
            return False
        if not self._create(f"{last + 1}.claim", f"{self.owner} {self.seconds}"):
            return False
        self.number = last + 1
        for old in numbers:      # ended claims below the last one say nothing any more
            if old < last:
                for kind in numbers[old]:
                    self.fs.delete(self._at(f"{old}.{kind}"), False)
        return True

    def check(self) -> None:
        """Renew the lease; raises :class:`ClaimLost` if another writer has taken over."""
        if self.number is None or max(self._numbers(), default=0) != self.number:
            raise ClaimLost(f"claim {self.number} on {self.folder} is held by another writer")
        self.fs.create(self._at(f"{self.number}.renewed"), True).close()

    def release(self) -> None:
        if self.number is not None:
            self._create(f"{self.number}.released", self.owner)


@contextmanager
def claimed(spark: SparkSession, table: str, seconds: float = LEASE_SECONDS, wait: float = LEASE_SECONDS):
    """Hold a table; waits up to ``wait`` seconds for another holder to end, then raises TimeoutError."""
    claim, until = Claim(spark, table, seconds), time.time() + wait
    while not claim.take():
        if time.time() >= until:
            raise TimeoutError(f"{table} is held by another writer")
        time.sleep(0.2)
    try:
        yield claim
    finally:
        claim.release()
