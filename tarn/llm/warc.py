"""WARC records in ZIP-packaged archives, written and range-read in parallel.

An archive is a ZIP whose members are stored (not deflated): `archive/data.warc.gz` (each record a
gzip member of its own), `indexes/index.cdxj` (a line per record: offset, length and what it is)
and `datapackage.json`. The reader parses the end record, the ZIP64 locator and record and the
central directory, finds where a member's bytes begin, reads the index, and fetches each record by
its byte range: nothing is extracted, and an archive of any size is shared out by ranges.

Equal payloads of at least LEAST_REVISIT bytes are written once: the record with the largest
page_id is the response, the others are revisits that refer to it. A revisit has no payload of its
own; reading resolves it through the response it refers to.

Files are written under a new name by each attempt of a task; the manifest, written by Spark's own
committer, names the files that count, so a lost executor or a repeated task leaves no doubt.

Defined cases: null html has an empty payload; a null url has no target header; a null page_id is
kept and orders below all ids; rows repeated with the largest page_id are all responses; an empty
table makes no archive and an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import partitions, shared_path, stored

#: Fixed values of the contract: payloads of fewer bytes are never revisited.
LEAST_REVISIT = 1000
#: An archive is closed when its records reach this size; ranges of this size are read together.
ARCHIVE_BYTES, RANGE_BYTES = 16 << 20, 4 << 20
DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


# ---- records


def _field(text: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record_bytes(record_id: str, kind: str, url: str | None, payload: bytes, digest: str, refers_to: str | None = None, size: int | None = None) -> bytes:
    """One WARC record. size: the payload's bytes, which a revisit states without carrying them."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if size is None else size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_field(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The named fields (lower case) and the payload (empty for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError("a WARC record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    for line in http.decode("latin-1").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[f"http:{k.strip().lower()}"] = v.strip()
    return fields, payload


def _id_of(field: str | None) -> int | None:
    text = (field or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text not in ("", "null") else None


# ---- archives


def build_archive(data: bytes, index: list[dict], zip64: bool = False) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        package = {"profile": "data-package", "resources": [{"path": DATA, "bytes": len(data), "records": len(index)}]}
        lines = "".join(json.dumps(x, separators=(",", ":")) + "\n" for x in index).encode()
        for name, body in ((DATA, data), (INDEX, lines), (PACKAGE, json.dumps(package).encode())):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=zip64) as f:
                f.write(body)
    return out.getvalue()


class ZipDirectory:
    """The central directory of a ZIP behind a file that can seek; members: name -> (method, size, header offset)."""

    def __init__(self, file):
        self.file = file
        file.seek(0, 2)
        size = file.tell()
        tail_at = max(0, size - 65_557)
        tail = self.read(tail_at, size - tail_at)
        end = len(tail)
        while (end := tail.rfind(b"PK\x05\x06", 0, end)) >= 0:
            # the record that the file ends with: its comment, which may hold the signature as well, fills the rest
            if end + 22 <= len(tail) and end + 22 + struct.unpack("<H", tail[end + 20 : end + 22])[0] == len(tail):
                break
        if end < 0:
            raise ValueError("no end of central directory")
        count, length, offset = struct.unpack("<HII", tail[end + 10 : end + 20])
        ends_at = tail_at + end
        locator = ends_at - 20
        if locator >= 0 and (found := self.read(locator, 20)).startswith(b"PK\x06\x07"):
            stated = struct.unpack("<Q", found[8:16])[0]
            for ends_at in (stated, locator - 56):  # the second where bytes stand in front of the archive
                if ends_at >= 0 and (end64 := self.read(ends_at, 56)).startswith(b"PK\x06\x06"):
                    break
            else:
                raise ValueError("the ZIP64 locator points nowhere")
            count, length, offset = struct.unpack("<QQQ", end64[32:56])
        before = ends_at - length - offset  # bytes in front of the archive, which offsets do not count
        if before < 0:
            raise ValueError("a broken central directory")
        offset += before
        self.members: dict[str, tuple[int, int, int]] = {}
        raw, at = self.read(offset, length), 0
        for _ in range(count):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("a broken central directory")
            flags, method = struct.unpack("<HH", raw[at + 8 : at + 12])
            packed, full, n, extra, comment = struct.unpack("<IIHHH", raw[at + 20 : at + 34])
            header = struct.unpack("<I", raw[at + 42 : at + 46])[0]
            name = raw[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            more = raw[at + 46 + n : at + 46 + n + extra]
            while len(more) >= 4:
                kind, k = struct.unpack("<HH", more[:4])
                if kind == 1:  # ZIP64: only what did not fit, in this order
                    wide = iter(struct.unpack(f"<{k // 8}Q", more[4 : 4 + k // 8 * 8]))
                    full = next(wide) if full == 0xFFFFFFFF else full
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    header = next(wide) if header == 0xFFFFFFFF else header
                more = more[4 + k :]
            self.members[name] = (method, packed, header + before)
            at += 46 + n + extra + comment

    def read(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def stored(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin, and how many there are."""
        method, size, header = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is not stored")
        local = self.read(header, 30)
        if not local.startswith(b"PK\x03\x04"):
            raise ValueError(f"{name} has no local header")
        n, extra = struct.unpack("<HH", local[26:30])
        return header + 30 + n + extra, size


# ---- writing


def with_kinds(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, kind, refers_to."""
    spark = pages.sparkSession
    payload = F.coalesce(F.encode(F.col("html"), "utf-8"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= LEAST_REVISIT)
    # written first, so that its size is known when the join is planned
    same = stored(large.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "warc-same")
    joined = rows.join(same.withColumnRenamed("digest", "same"), F.col("digest") == F.col("same"), "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.select(
        "page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("keeper")).alias("refers_to")
    )


MANIFEST = "path string, records long, bytes long"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each row of pages; returns the manifest: path, records, bytes of each archive."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        data, index = bytearray(), []

        def close() -> pd.DataFrame:
            name = f"part-{uuid.uuid4().hex}.wacz"
            body = build_archive(bytes(data), index)
            with fs.open_output_stream(f"{root}/{name}") as f:
                f.write(body)
            row = pd.DataFrame({"path": [f"{folder}/{name}"], "records": [len(index)], "bytes": [len(body)]})
            data.clear()
            index.clear()
            return row

        for batch in batches:
            for page_id, url, payload, digest, kind, refers_to in batch.itertuples(index=False):
                own, other = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                raw = record_bytes("null" if own is None else str(own), kind, None if pd.isna(url) else url, payload, digest, None if other is None else str(other), len(payload))
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = pack.compress(raw) + pack.flush()
                index.append({"id": own, "offset": len(data), "length": len(member), "type": kind})
                data += member
                if len(data) >= ARCHIVE_BYTES:
                    yield close()
        if index:
            yield close()

    return with_kinds(pages).mapInPandas(write, MANIFEST)


# ---- reading

ENTRY = "path string, at long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def index_entries(manifest: DataFrame) -> DataFrame:
    """path, at, length of every record: from each archive's directories and index alone."""

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                fs, name = open_fs(path)
                with fs.open_input_file(name) as f:
                    z = ZipDirectory(f)
                    begin, _ = z.stored(DATA)
                    lines = [json.loads(x) for x in z.read(*z.stored(INDEX)).splitlines()]
                yield pd.DataFrame({"path": path, "at": [begin + x["offset"] for x in lines], "length": [x["length"] for x in lines]})

    return manifest.select("path").mapInPandas(entries, ENTRY)


def read_records(entries: DataFrame, with_payload: bool = True) -> DataFrame:
    """Range-reads each record, checks its digest and gives RECORD; a revisit's payload stays null here."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, mine in batch.sort_values(["path", "at"]).groupby("path", sort=False):
                fs, name = open_fs(path)
                with fs.open_input_file(name) as f:
                    for at, length in zip(mine["at"], mine["length"], strict=True):
                        f.seek(int(at))
                        fields, payload = parse_record(zlib.decompress(f.read(int(length)), 31))
                        kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{path}: the record at {at} is damaged")
                        own = kind == "response"
                        out.append((_id_of(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, _id_of(fields.get("warc-refers-to")), digest, len(payload) if own else None, payload if own and with_payload else None))
            frame = pd.DataFrame(out, columns=[x.split()[0] for x in RECORD.split(", ")])
            yield frame.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

    dealt = entries.repartition(partitions(entries.sparkSession), "path", F.floor(F.col("at") / RANGE_BYTES))
    return dealt.mapInPandas(fetch, RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """Each revisit with the payload (bytes, digest) of the response that it refers to."""
    heads = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("head"), F.col("payload_digest").alias("head_digest")).agg(F.first("payload_bytes").alias("head_bytes"))
    on = (F.col("refers_to") == F.col("head")) & (F.col("payload_digest") == F.col("head_digest"))
    joined = records.join(heads.hint("merge"), on, "left")  # what Python returns has no known size: never broadcast it
    return joined.withColumn("payload_bytes", F.coalesce("payload_bytes", "head_bytes")).drop("head", "head_digest", "head_bytes")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    manifest = stored(write_archives(pages, shared_path(spark, "warc")), "warc-manifest")
    records = read_records(index_entries(manifest), with_payload=False).drop("payload", "url")
    return resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM p
), k AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS keeper FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM k
"""
