"""Packs: a framed byte stream of objects, as a Spark data source in both directions.

Layout: magic and version (11 bytes), then per object a header (32 bytes id, 1 byte entry kind,
8 bytes size, big-endian) and the content, then 41 zero bytes. Reading makes one pass over the
headers, seeking past the content, and shares the objects out by ranges; every range is checked
against the ids while it is read. Writing has each task write its part; the commit joins the parts
in partition order, so a sorted frame becomes a sorted stream.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tarn.functions.hashing import HEADERS, blake3_many
from tarn.functions.ids import ENTRY_BYTES
from tarn.operators.shared import stored

MAGIC, HEADER, FOOTER = b"store-pack\x01", 41, bytes(41)
SCHEMA = "id string, kind string, is_executable boolean, size long, content binary"
#: Content bytes of a range that one task reads; ids are checked in batches of this many bytes.
RANGE_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
_KINDS = {n: k for k, n in ENTRY_BYTES.items()}


class PackError(ValueError):
    """A stream that is no pack, is cut short, is damaged or goes on behind its end."""


def header(id_: str, kind: str, executable: bool, size: int) -> bytes:
    return bytes.fromhex(id_) + struct.pack(">BQ", ENTRY_BYTES["exec" if executable else kind], size)


def parse_header(raw: bytes) -> tuple[str, str, bool, int]:
    """id, kind, executable, size of 41 bytes."""
    if len(raw) != HEADER:
        raise PackError("a header is cut short")
    byte, size = struct.unpack(">BQ", raw[32:])
    if byte not in _KINDS:
        raise PackError(f"an unknown kind byte: {byte}")
    if size >= 1 << 63:
        raise PackError(f"a size that cannot be: {size}")
    name = _KINDS[byte]
    return raw[:32].hex(), "blob" if name == "exec" else name, name == "exec", size


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def scan(path: str) -> Iterator[tuple[int, str, str, bool, int]]:
    """(content offset, id, kind, executable, size) of every object, from the headers alone."""
    fs, name = _open(path)
    with fs.open_input_file(name) as f:
        end = f.size()
        if f.read(len(MAGIC)) != MAGIC:
            raise PackError("not a pack, or one of another version")
        at = len(MAGIC)
        while True:
            f.seek(at)
            raw = f.read(HEADER)
            if raw == FOOTER:
                if at + HEADER != end:
                    raise PackError("data behind the end of a pack")
                return
            id_, kind, executable, size = parse_header(raw)
            at += HEADER
            if at + size > end:
                raise PackError("an object is cut short")
            yield at, id_, kind, executable, size
            at += size


class _Range(InputPartition):
    def __init__(self, objects: list[tuple]):
        self.objects = objects


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.algorithm = options.get("algorithm", "blake3")
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[_Range]:
        out, now, size = [], [], 0
        for found in scan(self.path):
            now.append(found)
            size += found[4]
            if size >= self.range_bytes:
                out.append(_Range(now))
                now, size = [], 0
        return [*out, _Range(now)] if now or not out else out

    def read(self, partition: _Range) -> Iterator[tuple]:
        fs, name = _open(self.path)
        batch, held = [], 0
        with fs.open_input_file(name) as f:
            for at, id_, kind, executable, size in partition.objects:
                f.seek(at)
                content = f.read(size)
                if len(content) != size:
                    raise PackError("an object is cut short")
                batch.append((id_, kind, executable, size, content))
                held += size
                if held >= BATCH_BYTES:
                    yield from self.checked(batch)
                    batch, held = [], 0
        yield from self.checked(batch)

    def checked(self, batch: list[tuple]) -> list[tuple]:
        whole = [HEADERS["exec" if x[2] else x[1]].encode() + x[4] for x in batch]
        if self.algorithm == "sha256":
            import hashlib

            found = [hashlib.sha256(x).hexdigest() for x in whole]
        else:
            found = blake3_many(whole)
        for x, y in zip(batch, found, strict=True):
            if x[0] != y:
                raise PackError(f"the content of {x[0]} hashes to {y}")
        return batch


class _Part(WriterCommitMessage):
    def __init__(self, number: int, path: str):
        self.number, self.path = number, path


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, rows: Iterator) -> _Part:
        from pyspark import TaskContext

        fs, name = _open(self.path)
        part = f"{name}.{uuid.uuid4().hex}.part"
        with fs.open_output_stream(part) as f:
            for r in rows:
                f.write(header(r["id"], r["kind"], bool(r["is_executable"]), len(r["content"])))
                f.write(bytes(r["content"]))
        return _Part(TaskContext.get().partitionId(), part)

    def commit(self, messages: list[_Part | None]) -> None:
        fs, name = _open(self.path)
        whole = f"{name}.{uuid.uuid4().hex}.whole"
        with fs.open_output_stream(whole) as out:
            out.write(MAGIC)
            for m in sorted((m for m in messages if m), key=lambda m: m.number):
                with fs.open_input_stream(m.path) as f:
                    while piece := f.read(1 << 20):
                        out.write(piece)
            out.write(FOOTER)
        fs.move(whole, name)
        self._drop(fs, messages)

    def abort(self, messages: list[_Part | None]) -> None:
        self._drop(_open(self.path)[0], messages)

    @staticmethod
    def _drop(fs: pafs.FileSystem, messages: list[_Part | None]) -> None:
        for m in messages:
            if m:
                fs.delete_file(m.path)


class PackSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "storepack"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PackSource)


def read_pack(spark: SparkSession, path: str, algorithm: str = "blake3") -> DataFrame:
    register(spark)
    return spark.read.format("storepack").option("algorithm", algorithm).load(path)


def write_pack(objects: DataFrame, path: str, order: list | None = None) -> None:
    """Writes objects in the order of the given columns (or as they come) as one pack."""
    register(objects.sparkSession)
    rows = objects.orderBy(*order) if order else objects
    rows.select("id", "kind", "is_executable", "size", "content").write.format("storepack").mode("append").save(path)


def layout(objects: DataFrame, order: list, salt: str | None = None) -> DataFrame:
    """objects with entry_offset, the place of each header in the pack.

    A running sum over a total order ends in one task, so sizes are first added up over runs of the
    order when salt names a column that the order begins with; the sum then runs over the runs alone.
    """
    step = F.col("size") + HEADER
    if salt is None:
        before = F.sum(step).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
        return objects.withColumn("entry_offset", F.lit(len(MAGIC)) + F.coalesce(before, F.lit(0)))
    runs = objects.groupBy(salt).agg(F.sum(step).alias("_run"))
    begun = F.coalesce(F.sum("_run").over(Window.orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(salt, begun.alias("_begun"))
    own = F.coalesce(F.sum(step).over(Window.partitionBy(salt).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return objects.withColumn("_own", own).join(runs, salt).withColumn("entry_offset", F.col("_own") + F.col("_begun") + len(MAGIC)).drop("_own", "_begun")


def numbered(objects: DataFrame, order: list[str]) -> DataFrame:
    """objects with position: 0, 1, .. in the order of the columns.

    Rows are sorted across ranges; each range's count is added up before the next, so no task sees more than its range.
    """
    rows = stored(objects.orderBy(*order).withColumn("_range", F.spark_partition_id()), "numbered")
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    begun = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    counts = counts.select("_range", begun.alias("_begun"))
    return rows.withColumn("_own", own).join(F.broadcast(counts), "_range").withColumn("position", F.col("_own") + F.col("_begun")).drop("_range", "_own", "_begun")  # a row a range


def header_column(id_, kind, executable, size):
    """The 41 header bytes as a column."""
    byte = F.when(executable & (kind == "blob"), F.lit(ENTRY_BYTES["exec"]))
    for k in ("blob", "tree", "pkg", "spec"):
        byte = byte.when(kind == k, F.lit(ENTRY_BYTES[k]))
    return F.concat(F.unhex(id_), F.unhex(F.lpad(F.hex(byte), 2, "0")), F.unhex(F.lpad(F.hex(size), 16, "0")))


def progress(objects: DataFrame, position: str) -> DataFrame:
    """The events of sending objects (position, id, kind, size): begin and read for each, and finished.

    (seq, event, id, kind, size, bytes, num_objects); bytes of a read are the object's content.
    """
    seq = F.col(position) * 2
    both = F.array(
        F.struct(seq.alias("seq"), F.lit("begin").alias("event"), F.lit(None).cast("long").alias("bytes")),
        F.struct((seq + 1).alias("seq"), F.lit("read").alias("event"), F.col("size").alias("bytes")),
    )
    each = objects.withColumn("e", F.explode(both)).select(
        "e.seq", "e.event", "id", F.when(F.col("e.event") == "begin", F.col("kind")).alias("kind"), F.when(F.col("e.event") == "begin", F.col("size")).alias("size"), "e.bytes", F.lit(None).cast("long").alias("num_objects")
    )
    none = lambda kind: F.lit(None).cast(kind)
    total = objects.agg(
        (F.coalesce(F.max(position) * 2 + 2, F.lit(0))).alias("seq"), F.lit("finished").alias("event"), none("string").alias("id"), none("string").alias("kind"), none("long").alias("size"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("num_objects"),
    )
    return each.unionByName(total)
