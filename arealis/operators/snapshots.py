"""Published tables that readers never see half replaced, and a ledger kept as a stream.

A write goes to a folder of its own; then a small pointer file with the next version's number is put in place by a
rename that fails if somebody else was first. Readers take the snapshot of the highest pointer. A write that fails
leaves the last version as it was, and of two writers that began from one version the second is refused. The rename is as
exclusive as the store's: on a distributed file system it is one operation of its name server.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .ledger import rounded, upsert


class Conflict(RuntimeError):
    """Another writer has published since the version that this one began from."""


class Published:
    """A table at ``path``: snapshots and the pointers to them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _fs(self):
        return self._at().getFileSystem(self._conf)

    def _pointers(self) -> dict[int, str]:
        folder, fs = self._at("_pointers"), self._fs()
        if not fs.exists(folder):
            return {}
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return {int(n): n for n in names if n.isdigit()}

    def version(self) -> int:
        """Number of the last published version; 0 where there is none."""
        return max(self._pointers(), default=0)

    def entry(self, version: int | None = None) -> dict:
        """What a version's pointer says: its snapshot, format and notes."""
        pointers = self._pointers()
        version = max(pointers, default=0) if version is None else version
        if version not in pointers:
            raise FileNotFoundError(f"{self.path} has no version {version}")
        stream = self._fs().open(self._at("_pointers", pointers[version]))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """A version's rows, the last one's by default."""
        entry = self.entry(version)
        reader = self.spark.read.option("header", True) if entry["format"] == "csv" else self.spark.read
        return reader.schema(entry["schema"]).format(entry["format"]).load(f"{self.path}/{entry['snapshot']}")

    def write(self, df: DataFrame, began_from: int | None = None, fmt: str = "parquet",
              digits: int | dict[str, int] | None = None, partition_by: list[str] = (), notes: dict | None = None) -> int:
        """Publish ``df`` as the next version and return its number.

        ``began_from`` is the version that the writer read; by default the last one when the write begins. Columns that
        are partitioned by come last when the table is read.
        """
        began_from = self.version() if began_from is None else began_from
        out = df if digits is None else rounded(df, digits)
        snapshot = f"snapshot-{uuid.uuid4().hex}"
        writer = out.write.partitionBy(*partition_by) if partition_by else out.write
        (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(f"{self.path}/{snapshot}")
        order = [c for c in out.columns if c not in partition_by] + list(partition_by)
        schema = ", ".join(f"`{c}` {out.schema[c].dataType.simpleString()}" for c in order)
        self._point(began_from + 1, {"snapshot": snapshot, "format": fmt, "schema": schema, "notes": notes or {}})
        return began_from + 1

    def _point(self, version: int, entry: dict) -> None:
        fs, draft = self._fs(), self._at("_pointers", f"draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(entry).encode()))
        finally:
            stream.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        try:
            context.rename(draft, self._at("_pointers", f"{version:012d}"), options)
        except Exception as error:
            fs.delete(draft, False)
            if version in self._pointers():
                raise Conflict(f"{self.path}: version {version} was published meanwhile") from error
            raise

    def prune(self, keep: int = 2) -> None:
        """Delete all but the last ``keep`` versions, and snapshots that no pointer names.

        Not while somebody writes: a snapshot has no pointer until it is whole.
        """
        fs, pointers = self._fs(), self._pointers()
        for version in sorted(pointers)[:-keep]:
            fs.delete(self._at("_pointers", pointers[version]), False)
        named = {self.entry(v)["snapshot"] for v in self._pointers()}
        for status in fs.listStatus(self._at()):
            name = status.getPath().getName()
            if name.startswith("snapshot-") and name not in named:
                fs.delete(status.getPath(), True)


def upsert_batch(ledger: Published, batch: DataFrame, batch_id: int, stream: str, key: str = "source_key",
                 order: str | None = None) -> bool:
    """Replace the rows of a batch's keys in the published ledger; False where this batch is in it already.

    The batch's number is published with the rows, so a repeated batch changes nothing. With ``order``, of several rows
    of a key in a batch the one with the largest value stands.
    """
    version = ledger.version()
    seen = ledger.entry()["notes"].get("batches", {}) if version else {}
    if batch_id <= seen.get(stream, -1):
        return False
    if order is not None:
        batch = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.col(order)).alias("r")).select("r.*")
    rows = upsert(ledger.read(), batch, key) if version else batch
    ledger.write(rows, version, notes={"batches": {**seen, stream: batch_id}})
    return True


def follow(arrivals: DataFrame, ledger: Published, checkpoint: str, stream: str = "sidecars", key: str = "source_key",
           order: str | None = None) -> StreamingQuery:
    """A stream of arriving records into the ledger, each batch once; started with what is available now."""
    def take(batch: DataFrame, batch_id: int) -> None:
        upsert_batch(ledger, batch, batch_id, stream, key, order)

    return arrivals.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
