"""Object ids as text: parsing, order, paths, kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.functions.hashing import KINDS

ID = "^[0-9a-fA-F]{64}$"
#: The byte of each entry kind in a pack; both kinds of blob are blobs.
ENTRY_BYTES = {"blob": 0, "exec": 1, "tree": 2, "pkg": 3, "spec": 4}


def is_id(text: Column) -> Column:
    return F.coalesce(text.rlike(ID), F.lit(False))


def parse_id(text: Column) -> Column:
    """64 hex digits of either case, lower-cased; an error for anything else, null for null."""
    bad = F.raise_error(F.concat(F.lit("not an object id: "), text)).cast("string")
    return F.when(text.isNull(), None).when(text.rlike(ID), F.lower(text)).otherwise(bad)


def from_bytes(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def to_bytes(id_: Column) -> Column:
    return F.unhex(id_)


def object_path(id_: Column, kind: Column | None = None) -> Column:
    """aa/bbbb.., with the kind as its suffix if given."""
    path = F.concat_ws("/", F.substring(id_, 1, 2), F.substring(id_, 3, 62))
    return path if kind is None else F.concat_ws(".", path, kind)


def debug(id_: Column) -> Column:
    return F.concat(F.lit("ObjectId("), id_, F.lit(")"))


def kind_rank(kind: Column) -> Column:
    """0 to 3 in the order in which kinds are probed and sorted; an error for an unknown kind."""
    out = F.raise_error(F.concat(F.lit("unknown object kind: "), F.coalesce(kind, F.lit("null")))).cast("int")
    for rank, name in reversed(list(enumerate(KINDS))):
        out = F.when(kind == name, F.lit(rank)).otherwise(out)
    return out


def kinds(spark):
    """All kinds in order: kind, kind_rank."""
    return spark.createDataFrame([(k, i) for i, k in enumerate(KINDS)], "kind string, kind_rank int")
