"""A small value kept in versions, each a file that is made once: two writers can't both make the next one."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.sql import SparkSession

from tracewell.operators.ledger import Policy


class Versions:
    """Values of a folder that driver and others share, as JSON; numbers from 1.

    A version is written beside its place and then named, which fails where the name is taken: by a rename, atomic where the file
    system's are (as Spark's own stream checkpoints need it), on a local disk by a link.
    """

    def __init__(self, spark: SparkSession, place: str) -> None:
        self.spark, self.place = spark, place.rstrip("/")
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, name: str):
        return self.hadoop.Path(f"{self.place}/{name}")

    def current(self) -> tuple[int, dict | None]:
        """The last version's number and value; 0 and None before the first."""
        files = self.path("x").getFileSystem(self.conf)
        if not files.exists(self.hadoop.Path(self.place)):
            return 0, None
        names = [f.getPath().getName() for f in files.listStatus(self.hadoop.Path(self.place))]
        last = max((n for n in names if n.startswith("v") and n.endswith(".json")), default=None)
        if last is None:
            return 0, None
        return int(last[1:-5]), json.loads(self.spark.read.text(f"{self.place}/{last}", wholetext=True).first()["value"])

    def commit(self, seen: int, value: dict) -> bool:
        """Makes version ``seen`` + 1, unless someone has; ``seen`` is the version that the caller has read."""
        files = self.path("x").getFileSystem(self.conf)
        made, place = self.path(f".{uuid.uuid4().hex}"), self.path(f"v{seen + 1:012d}.json")
        out = files.create(made)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        try:
            self._put(files, made, place)
            return True
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            files.delete(made, False)

    def _put(self, files, made, place) -> None:
        """Gives what is made its name, if nothing has it; renames of a local disk don't look, links do."""
        if files.getScheme() == "file":
            jvm = self.spark.sparkContext._jvm
            old, new = (jvm.java.io.File(p.toUri().getPath()).toPath() for p in (made, place))
            jvm.java.nio.file.Files.createLink(new, old)
            return
        context = self.hadoop.FileContext.getFileContext(place.toUri(), self.conf)
        context.rename(made, place, self.spark.sparkContext._gateway.new_array(self.hadoop.Options.Rename, 0))


def opened(spark: SparkSession, place: str, policy: Policy) -> Policy:
    """The policy that a ledger is opened with: kept with its first opening, and the same at each later one.

    Another policy is refused with a ValueError: a ledger's counts mean nothing under other limits. ``migrated`` changes it on purpose.
    """
    versions, wanted = Versions(spark, place), asdict(policy)
    seen, held = versions.current()
    if held is None and not versions.commit(0, wanted):
        seen, held = versions.current()
    if held is not None and held != wanted:
        raise ValueError(f"policy differs from version {seen}: {sorted(k for k in {*held, *wanted} if held.get(k) != wanted.get(k))}")
    return policy


def migrated(spark: SparkSession, place: str, old: Policy, new: Policy) -> int:
    """Puts ``new`` in the place of ``old`` and returns its version; a ValueError where ``old`` isn't the current one, or another writer was first."""
    versions = Versions(spark, place)
    seen, held = versions.current()
    if held != asdict(old) or not versions.commit(seen, asdict(new)):
        raise ValueError("another policy than the old one is current")
    return seen + 1
