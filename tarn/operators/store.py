"""A store: a directory with a Parquet table of objects; the packages among them are what is installed.

Inserting is idempotent: rows that are already there (by id and kind) are dropped by an anti-join of ids alone,
equal rows of one batch count once, and all is one append, so no package can be stored and not be installed. Content
is read only by who asks for it: graph queries touch ids, kinds
and sizes alone. The table is partitioned by kind, so a kind in a query prunes the scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tarn.functions.canonical import decode
from tarn.functions.hashing import HEADERS, blob_id, digest, with_header
from tarn.functions.ids import kind_rank
from tarn.operators.graph import Closure, Delta, MissingObjects, closure, delta, object_edges, yield_order
from tarn.operators.shared import stored
from tarn.sources import pack


class DamagedObjects(ValueError):
    """Objects whose content does not have their id."""


def fields(kind: str):
    """The fields of an object of that kind; an error where they are not valid. Guarded: the optimizer may move parsing before a filter by kind."""
    return decode(kind, F.when(F.col("kind") == kind, F.decode("content", "utf-8")))


OBJECTS = "id string, is_executable boolean, size long, content binary, kind string"


def blobs(content: DataFrame, column: str = "content", executable=False, algorithm: str = "blake3") -> DataFrame:
    """(id, kind, is_executable, size, content) of a binary column."""
    flag = F.lit(executable) if isinstance(executable, bool) else executable
    data = F.col(column)
    return content.select(blob_id(data, flag, algorithm).alias("id"), F.lit("blob").alias("kind"), flag.alias("is_executable"), F.octet_length(data).cast("long").alias("size"), data.alias("content"))


def metas(rows: DataFrame, kind: str, json: str = "json", algorithm: str = "blake3") -> DataFrame:
    """(id, kind, is_executable, size, content) of canonical JSON."""
    data = F.encode(F.col(json), "utf-8")
    return rows.select(digest(with_header(HEADERS[kind], data), algorithm).alias("id"), F.lit(kind).alias("kind"), F.lit(False).alias("is_executable"), F.octet_length(data).cast("long").alias("size"), data.alias("content"))


def contains(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of wanted (id, and kind if it has one) that are in nodes (id, kind)."""
    on = ["id", "kind"] if "kind" in wanted.columns else ["id"]
    return wanted.join(nodes.select(on), on, "left_semi").select(wanted.columns)


def lookup(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, kind, size): for each id of wanted the first kind in order; ids that are not in nodes have null."""
    ids = wanted.select("id").distinct()
    first = contains(ids, nodes.select("id", "kind", "size").withColumnRenamed("kind", "_kind")).groupBy("id")
    first = first.agg(F.min_by(F.struct(F.col("_kind").alias("kind"), "size"), kind_rank(F.col("_kind"))).alias("o"))
    return ids.join(first, "id", "left").select("id", "o.kind", "o.size")


def sizes(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, kind, size) of wanted (id, kind); an error for what is not in nodes."""
    found = wanted.select("id", "kind").join(nodes.select("id", "kind", "size"), ["id", "kind"], "left")
    lost = F.raise_error(F.concat(F.lit("no such object: "), F.col("id"))).cast("long")
    return found.withColumn("size", F.when(F.col("size").isNull(), lost).otherwise(F.col("size")))


class Store:
    """Objects below one path; a source and a destination of packs."""

    def __init__(self, spark: SparkSession, path: str, algorithm: str = "blake3"):
        self.spark, self.path, self.algorithm = spark, path.rstrip("/"), algorithm

    # opening

    def _file(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._file("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self._fs().exists(self._file("objects"))

    @classmethod
    def open(cls, spark: SparkSession, path: str, algorithm: str = "blake3") -> Store:
        store = cls(spark, path, algorithm)
        if not store.exists():
            raise FileNotFoundError(f"no store at {path}")
        return store

    @classmethod
    def init(cls, spark: SparkSession, path: str, algorithm: str = "blake3") -> Store:
        """Opens the store, or makes one where there is none (an empty directory will do)."""
        store = cls(spark, path, algorithm)
        return store if store.exists() else cls.init_bare(spark, path, algorithm)

    @classmethod
    def init_bare(cls, spark: SparkSession, path: str, algorithm: str = "blake3") -> Store:
        """Makes a store; the directory must be empty or absent."""
        store = cls(spark, path, algorithm)
        where, fs = store.spark._jvm.org.apache.hadoop.fs.Path(store.path), store._fs()
        if fs.exists(where) and len(fs.listStatus(where)):
            raise FileExistsError(f"{path} is not empty")
        fs.mkdirs(store._file("objects"))
        return store

    # reading

    def objects(self) -> DataFrame:
        return self.spark.read.schema(OBJECTS).parquet(f"{self.path}/objects")

    def installed(self) -> DataFrame:
        """(id, name, path) of the packages."""
        rows = self.metas("pkg")
        return rows.select("id", "name", F.concat_ws("-", "name", "id").alias("path"))

    def nodes(self) -> DataFrame:
        return self.objects().select("id", "kind", "size")

    def get(self, id_: str, kind: str | None = None) -> DataFrame:
        """The object, as a row: the first of its kinds in order when no kind is given."""
        rows = self.objects().where(F.col("id") == id_)
        rows = rows if kind is None else rows.where(F.col("kind") == kind)
        found = rows.orderBy(kind_rank(F.col("kind"))).limit(1)
        if found.select("id").isEmpty():
            raise MissingObjects(f"no such object: {id_}" + (f" ({kind})" if kind else ""))
        return found

    def get_blob(self, id_: str) -> DataFrame:
        return self.get(id_, "blob").select("id", "is_executable", "size", "content")

    def get_meta(self, id_: str, kind: str) -> DataFrame:
        """A tree, package or spec with its fields."""
        return self.get(id_, kind).select("id", "size", fields(kind).alias("f")).select("id", "size", "f.*")

    def metas(self, kind: str) -> DataFrame:
        rows = self.objects().where(F.col("kind") == kind)
        return rows.select("id", fields(kind).alias("f")).select("id", "f.*")

    def contains(self, wanted: DataFrame) -> DataFrame:
        """The rows of wanted (id, and kind if it has one) that are there."""
        return contains(self.nodes(), wanted)

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """(id, kind, size): for each id the first kind in order; ids that are not there have null."""
        return lookup(self.nodes(), wanted)

    def sizes(self, wanted: DataFrame) -> DataFrame:
        """(id, kind, size) of wanted (id, kind); an error for what is not there."""
        return sizes(self.nodes(), wanted)

    def read_range(self, id_: str, begin: int, length: int) -> bytes:
        """Up to `length` bytes of a blob from `begin` on; only they reach the driver."""
        part = F.substring("content", begin + 1, length).alias("part")
        return bytes(self.get_blob(id_).select(part).first()["part"])

    def edges(self) -> DataFrame:
        return object_edges(self.metas("tree"), self.metas("pkg"), self.metas("spec"))

    def closure(self, roots: DataFrame, enter=None):
        return closure(roots, self.nodes(), self.edges(), enter)

    def verify(self) -> DataFrame:
        """(id, kind, found): objects whose content no longer has their id."""
        return mismatches(self.objects(), self.algorithm)

    # writing

    def insert(self, rows: DataFrame, check_references: bool = True, verify: bool = False) -> DataFrame:
        """Adds objects that are not there; returns the (id, kind) of all rows.

        Packages need their references installed. verify: an error for content that does not have its id, before
        anything is written.
        """
        rows = rows.select("id", "is_executable", "size", "content", "kind")
        named = stored(rows.select("id", "kind", kind_rank(F.col("kind")).alias("rank")).distinct(), "named").select("id", "kind")  # an unknown kind is an error
        if verify:
            bad = [r["id"] for r in mismatches(rows, self.algorithm).select("id").distinct().orderBy("id").limit(5).collect()]
            if bad:
                raise DamagedObjects(f"content does not have its id: {', '.join(bad)}")
        if check_references:
            self._check_packages(rows)
        # ids decide first, so that only content that is new moves
        lacking = stored(named.join(self.nodes().select("id", "kind"), ["id", "kind"], "left_anti"), "lacking")
        new = rows.join(lacking, ["id", "kind"], "left_semi").dropDuplicates(["id", "kind"])
        new.select("id", "is_executable", "size", "content", "kind").write.mode("append").partitionBy("kind").parquet(f"{self.path}/objects")
        return named

    def _check_packages(self, rows: DataFrame) -> None:
        packages = rows.where("kind = 'pkg'").select("id", fields("pkg").alias("f")).select("id", "f.*")
        have = self.nodes().where("kind = 'pkg'").select("id").unionByName(packages.select("id"))
        lost = [r[0] for r in missing_references(packages, have).select("reference").distinct().orderBy("reference").limit(5).collect()]
        if lost:
            raise MissingObjects(f"references that are not installed: {', '.join(lost)}")

    # copying

    def find_missing(self, other: Store, roots: DataFrame) -> Delta:
        """What the other store lacks of the closure of roots (id)."""
        return delta(roots, self.nodes(), self.edges(), other.nodes())

    def send_pack(self, found: Closure, path: str) -> None:
        """Writes the objects of a closure as one pack, in the order of sending."""
        lost = found.nodes.select("id", "kind").join(self.nodes().select("id", "kind"), ["id", "kind"], "left_anti").limit(1).collect()
        if lost:
            raise MissingObjects(f"no such object: {lost[0]['id']} ({lost[0]['kind']})")
        sent = yield_order(found.nodes, found.edges).select("id", "kind", "group_rank", "level")
        pack.write_pack(self.objects().join(sent, ["id", "kind"]), path, ["group_rank", "level", "id"])

    def recv_pack(self, path: str) -> DataFrame:
        """Inserts the objects of a pack, each checked against its id; returns their (id, kind)."""
        return self.insert(pack.read_pack(self.spark, path, self.algorithm))

    def copy_to(self, other: Store, roots: DataFrame, progress: Callable[[Row], None] | None = None) -> Delta:
        """Copies the closure of roots, as far as the other store lacks it; returns the delta.

        Objects go straight from table to table, checked against their ids. progress: is called for each event of
        sending them (see pack.progress), in order, once all have arrived.
        """
        found = self.find_missing(other, roots)
        lacking = self.objects().join(found.missing.nodes.select("id", "kind"), ["id", "kind"], "left_semi")
        other.insert(lacking, verify=True)
        if progress is not None:
            for event in copy_events(found.missing).orderBy("seq").toLocalIterator():
                progress(event)
        return found


def copy_events(found: Closure) -> DataFrame:
    """The events of sending a closure in order: begin and read for each object, and finished."""
    sent = yield_order(found.nodes, found.edges).select("id", "kind", "size", "group_rank", "level")
    return pack.progress(pack.numbered(sent, ["group_rank", "level", "id"]), "position")


def missing_references(packages: DataFrame, have: DataFrame) -> DataFrame:
    """(id, reference) of packages (id, references) for references that are not in have (id)."""
    each = packages.select("id", F.explode("references").alias("reference"))
    return each.join(have.select(F.col("id").alias("reference")).distinct(), "reference", "left_anti").select("id", "reference")


def mismatches(objects: DataFrame, algorithm: str = "blake3") -> DataFrame:
    """(id, kind, found) of objects whose content hashes to something else than their id."""
    header = F.when((F.col("kind") == "blob") & F.col("is_executable"), HEADERS["exec"])
    for kind in ("blob", "tree", "pkg", "spec"):
        header = header.when(F.col("kind") == kind, HEADERS[kind])
    found = digest(with_header(header, F.col("content")), algorithm)
    return objects.select("id", "kind", found.alias("found")).where("found <> id")


def dedup_report(rows: DataFrame) -> DataFrame:
    """One row: objects, distinct_objects, bytes, distinct_bytes, of rows (id, size)."""
    per = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("objects"),
        F.count(F.lit(1)).alias("distinct_objects"),
        F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("distinct_bytes"),
    )
