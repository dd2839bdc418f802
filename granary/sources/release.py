"""Releases in two phases: staged, verified, then published at once.

A release is a folder of tables below ``<root>/releases``.  Tables are staged there first, read
back and digested by tasks; a release whose tables differ from what was asked for is taken away
again.  ``READY``, which holds the digest of all receipts, is written only then, and the name in
``<root>/CURRENT`` is changed last, by one small write.  Readers follow that name, so they see
the old release, whole, until the new one is there, whatever fails in between.

Paths may be on any file system that Spark reads.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from granary.operators.audit import content_digest


class Folder:
    """A few file operations on Spark's own file systems."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self._path, self.root = jvm.org.apache.hadoop.fs.Path, root.rstrip("/")
        self.store = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self._path(f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self.store.exists(self.path(name))

    def delete(self, name: str) -> None:
        self.store.delete(self.path(name), True)

    def names(self, name: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self.store.listStatus(self.path(name))) if self.exists(name) else []

    def size(self, name: str) -> int:
        return int(self.store.getContentSummary(self.path(name)).getLength())

    def write(self, name: str, text: str) -> None:
        """Writes a small file under another name and renames it, so that it is there whole or not at all."""
        hidden = self.path(f"_{uuid.uuid4().hex}")
        out = self.store.create(hidden, True)
        out.write(bytearray(text.encode()))
        out.close()
        if self.exists(name) and not self._replace(hidden, name):
            raise OSError(f"cannot replace {self.root}/{name}")
        if self.store.exists(hidden) and not self.store.rename(hidden, self.path(name)):
            raise OSError(f"cannot write {self.root}/{name}")

    def _replace(self, hidden, name: str) -> bool:
        """Swaps a file for another: the old one keeps a second name until the new one is there."""
        old = self.path(f"{name}.before")
        self.store.delete(old, False)
        return self.store.rename(self.path(name), old) and self.store.rename(hidden, self.path(name)) and (self.store.delete(old, False) or True)

    def read(self, name: str) -> str:
        stream = self.store.open(self.path(name))
        data = bytes(stream.readAllBytes())
        stream.close()
        return data.decode()


def _digest(receipts: list[dict]) -> str:
    lines = "".join(f"{r['table']}\t{r['rows']}\t{r['digest']}\n" for r in sorted(receipts, key=lambda r: r["table"]))
    return hashlib.sha256(lines.encode()).hexdigest()


def publish(tables: dict[str, DataFrame], root: str, version: str) -> str:
    """Publishes ``tables`` as release ``version`` and returns its folder's name; on any failure nothing of it is left."""
    spark = next(iter(tables.values())).sparkSession
    folder, name = Folder(spark, root), f"{version}-{uuid.uuid4().hex[:12]}"
    place = f"releases/{name}"
    try:
        receipts = []
        for table, df in sorted(tables.items()):
            df.write.mode("errorifexists").parquet(f"{root}/{place}/{table}")
            asked, staged = (content_digest(x).first() for x in (df, spark.read.schema(df.schema).parquet(f"{root}/{place}/{table}")))
            if asked != staged:
                raise ValueError(f"table {table} was staged with {staged['rows']} rows and digest {staged['digest']}, not {asked['rows']} and {asked['digest']}")
            receipts.append({"table": table, "rows": staged["rows"], "digest": staged["digest"], "bytes": folder.size(f"{place}/{table}")})
        folder.write(f"{place}/RECEIPTS", json.dumps(receipts, sort_keys=True))
        folder.write(f"{place}/READY", _digest(receipts))
    except BaseException:
        folder.delete(place)
        raise
    folder.write("CURRENT", name)
    return name


def current(spark: SparkSession, root: str) -> str | None:
    """The name of the release that is published; one whose READY does not match its receipts is an error."""
    folder = Folder(spark, root)
    at = next((n for n in ("CURRENT", "CURRENT.before") if folder.exists(n)), None)
    if at is None:
        return None
    name = folder.read(at)
    if not folder.exists(f"releases/{name}/READY") or folder.read(f"releases/{name}/READY") != _digest(receipts(spark, root, name)):
        raise ValueError(f"release {name} is not ready")
    return name


def receipts(spark: SparkSession, root: str, name: str) -> list[dict]:
    """What was verified of each table of a release."""
    return json.loads(Folder(spark, root).read(f"releases/{name}/RECEIPTS"))


def open_table(spark: SparkSession, root: str, table: str, verify: bool = False) -> DataFrame:
    """A table of the published release; with ``verify``, digested again first."""
    name = current(spark, root)
    if name is None:
        raise FileNotFoundError(f"no release at {root}")
    df = spark.read.parquet(f"{root}/releases/{name}/{table}")
    if verify:
        told = next(r for r in receipts(spark, root, name) if r["table"] == table)
        found = content_digest(df).first()
        if (found["rows"], found["digest"]) != (told["rows"], told["digest"]):
            raise ValueError(f"table {table} of {name} is not what was released")
    return df


def prune(spark: SparkSession, root: str, keep: set[str] = frozenset(), apply: bool = False) -> list[dict]:
    """Releases that are neither published nor in ``keep``, with their bytes; with ``apply`` they are deleted.

    The receipt of what was deleted is written to ``<root>/PRUNED`` before anything is.
    """
    folder, published = Folder(spark, root), current(spark, root)
    gone = [{"release": n, "bytes": folder.size(f"releases/{n}")} for n in folder.names("releases") if n != published and n not in keep]
    if apply and gone:
        folder.write("PRUNED", json.dumps({"kept": sorted({published, *keep} - {None}), "deleted": gone}, sort_keys=True))
        for g in gone:
            folder.delete(f"releases/{g['release']}")
    return gone
