"""GIF media columns: decode LZW code streams, apply palettes, disposal and transparency, keep timed frames.

`decode` reads any GIF87a/89a (global and local palettes, interlacing, all disposal methods,
transparency, timing) into composited RGBA frames; `frame_rows` is the operator on a binary column:
a row per frame with its time, delay, size and colour histogram. `encode` writes byte payloads as
frames of SIDE x SIDE 8-bit samples under a palette that gives each byte value a colour of its own,
so the payload comes back from the composited colours.

Within a run between clear codes, the width of the k-th code depends on k alone, so the codes of a
run are cut out of the bit stream with array operations. `lzw_encode` and `lzw_decode` grow the string table
of one stream code by code. Streams of many small frames are worked on side by side: `lzw_encode_many` grows
all their tables one sample at a time, and `lzw_decode_many` needs no table, as the string that the
k-th code adds is the piece of the output that begins where that code's string begins: the lengths of
all strings follow code by code for all streams at once, and every sample is then looked up where it was copied from.

Defined cases: null text is an empty payload (one frame of fill bytes); a null or damaged GIF raises
in `decode` and gives no frames in `frame_rows` when null; texts of any length become as many
frames as they need; repeated rows give equal values; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Samples in a row and rows in a frame; the payload is filled up to whole frames with FILL.
SIDE, FILL, DELAY_CS, HIST_BITS = 24, 255, 4, 2
MOST_CODES = 4096

_V = np.arange(256, dtype=np.uint8)
#: Colour of each byte value: 3 bits of red, 3 of green, 2 of blue.
PALETTE = np.stack([_V & 0xE0, (_V & 0x1C) << 3, (_V & 0x03) << 6], axis=1).astype(np.uint8)


# ---- LZW


@cache
def _widths(least: int) -> np.ndarray:
    """The width of the k-th code after a clear code, for root codes of `least` bits."""
    first = (1 << least) + 2
    known = np.maximum(first + np.arange(MOST_CODES + 2) - 1, first)  # codes that are known when the k-th is read
    return np.clip(np.floor(np.log2(known)).astype(int) + 1, least + 1, 12)


@cache
def _runs(least: int) -> list[tuple[int, int]]:
    """(width, how many codes have it), up to the widest, which has no end."""
    w = _widths(least)
    return [(int(x), int((w == x).sum())) for x in range(least + 1, 12)] + [(12, 1 << 62)]


_POWERS = (1 << np.arange(12)).astype(np.int32)


def lzw_codes(stream: bytes, least: int) -> Iterator[np.ndarray]:
    """The codes of each run between clear codes, up to the end code."""
    clear, end = 1 << least, (1 << least) + 1
    bits = np.unpackbits(np.frombuffer(stream, np.uint8), bitorder="little")
    at = 0
    while at + least + 1 <= len(bits):
        parts, here, stop = [], at, None
        for width, count in _runs(least):
            n = min(count, (len(bits) - here) // width)
            if n <= 0:
                break
            chunk = bits[here : here + n * width].reshape(n, width) @ _POWERS[:width]
            marks = (chunk & ~1) == clear  # the clear code or, one above, the end code
            first = int(marks.argmax())
            if marks[first]:
                parts.append(chunk[:first])
                here += (first + 1) * width
                stop = int(chunk[first])
                break
            parts.append(chunk)
            here += n * width
        codes = parts[0] if len(parts) == 1 else np.concatenate(parts)
        if len(codes):
            yield codes
        if stop is None or stop == end:
            return
        at = here


@cache
def _roots(least: int) -> list[bytes]:
    return [bytes([i]) for i in range(1 << least)] + [b"", b""]


def lzw_decode(stream: bytes, least: int) -> bytes:
    clear = 1 << least
    out: list[bytes] = []
    put = out.append
    for run in lzw_codes(stream, least):
        if run.max() < clear:  # every code stands for itself
            put(run.astype(np.uint8).tobytes())
            continue
        codes = run.tolist()
        table = _roots(least).copy()
        add = table.append
        last = table[codes[0]]
        put(last)
        for code in codes[1:]:
            try:
                here = table[code]
            except IndexError:
                if code != len(table):
                    raise ValueError("an LZW code that is not known yet") from None
                here = last + last[:1]
            put(here)
            if len(table) < MOST_CODES:
                add(last + here[:1])
            last = here
    return b"".join(out)


def lzw_encode(data: bytes, least: int = 8) -> bytes:
    """The code stream of data; a clear code wherever the table is full."""
    clear, end = 1 << least, (1 << least) + 1
    pieces: list[np.ndarray] = []

    def put(codes: list[int], closing: int) -> None:
        """A run's codes behind the clear code before it, and the code that closes it."""
        codes.append(closing)
        values, done = np.array(codes, np.int32), 0
        for width, count in _runs(least):
            part = values[done : done + count]
            pieces.append(((part[:, None] >> np.arange(width)) & 1).astype(np.uint8).ravel())
            done += len(part)
            if done >= len(values):
                break

    pieces.append(((clear >> np.arange(least + 1)) & 1).astype(np.uint8))
    table: dict[int, int] = {}
    codes: list[int] = []
    free, known, put_code = end + 1, table.get, codes.append
    prefix = -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        code = known(key)
        if code is not None:
            prefix = code
            continue
        put_code(prefix)
        prefix = byte
        if free < MOST_CODES - 1:
            table[key] = free
            free += 1
        else:
            put(codes, clear)
            table.clear()
            codes.clear()
            free = end + 1
    if prefix >= 0:
        codes.append(prefix)
    put(codes, end)
    return np.packbits(np.concatenate(pieces), bitorder="little").tobytes()


@cache
def _offsets(least: int) -> np.ndarray:
    """Where the k-th code behind a clear code begins, in bits from the clear code on."""
    return (least + 1 + np.concatenate([[0], np.cumsum(_widths(least))])).astype(np.int64)


#: Streams that are worked on side by side, and entries of all their string tables, at most.
LANES, ENTRIES = 512, 1 << 25


def lzw_encode_many(rows: np.ndarray) -> list[bytes]:
    """lzw_encode() of each row of 8-bit samples, with root codes of 8 bits."""
    n = rows.shape[1]
    if n > MOST_CODES - 258:  # a table could be full
        return [lzw_encode(r.tobytes()) for r in rows]
    names = np.flatnonzero(np.bincount(rows.ravel(), minlength=256))
    rank = np.zeros(256, np.int64)
    rank[names] = np.arange(len(names))  # a table is as wide as there are different samples
    room = (258 + n) * len(names)
    lanes = int(np.clip(ENTRIES // room, 1, min(LANES, len(rows))))
    table = np.zeros(lanes * room, np.int16)
    out: list[bytes] = []
    for at in range(0, len(rows), lanes):
        codes, counts = _grown(rows[at : at + lanes], rank, len(names), table, room)
        out += _written(codes, counts)
    return out


def _grown(rows: np.ndarray, rank: np.ndarray, width: int, table: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes of each row (a column each), and how many. table is empty before and after."""
    lanes, n = rows.shape
    samples = np.ascontiguousarray(rows.T).astype(np.int64)
    place = rank[samples] + np.arange(lanes) * room
    codes, counts = np.zeros((n + 1) * lanes, np.int64), np.zeros(lanes, np.int64)
    prefix, used = samples[0], []
    for k in range(1, n):
        here = prefix * width + place[k]
        code = table[here].astype(np.int64)
        new = np.flatnonzero(code == 0)
        entry, many = here[new], counts[new]
        codes[many * lanes + new] = prefix[new]
        table[entry] = many + 258
        counts[new] = many + 1
        used.append(entry)
        prefix = np.where(code == 0, samples[k], code)
    codes[counts * lanes + np.arange(lanes)] = prefix
    for entry in used:
        table[entry] = 0
    return codes.reshape(n + 1, lanes), counts + 1


def _written(codes: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The stream of each column: the clear code, its codes, the end code."""
    lanes, most = codes.shape[1], int(counts.max())
    offsets = _offsets(8)
    codes = np.concatenate([codes, np.zeros((1, lanes), np.int64)])[: most + 1]
    codes[np.arange(most + 1)[:, None] >= counts] = 0
    codes[counts, np.arange(lanes)] = 257
    size = int(offsets[most + 1] + 7) // 8
    stream = np.zeros((size + 2, lanes), np.int64)
    stream[1] = 1  # the clear code, 256
    for k in range(most + 1):
        byte, shift = divmod(int(offsets[k]), 8)
        value = codes[k] << shift
        stream[byte] |= value & 255
        stream[byte + 1] |= value >> 8 & 255
        stream[byte + 2] |= value >> 16
    flat = np.ascontiguousarray(stream.T.astype(np.uint8))
    return [flat[i, :m].tobytes() for i, m in enumerate(((offsets[counts + 1] + 7) // 8).tolist())]


def lzw_decode_many(streams: list[bytes]) -> list[bytes]:
    """lzw_decode() of each stream, with root codes of 8 bits."""
    out: list[bytes] = []
    for at in range(0, len(streams), LANES):
        out += _copied(streams[at : at + LANES])
    return out


def _copied(streams: list[bytes]) -> list[bytes]:
    offsets, widths = _offsets(8), _widths(8)
    longest = max(map(len, streams))
    codes_there = max(1, min(int(np.searchsorted(offsets, 8 * longest, "right")) - 1, MOST_CODES - 258))
    raw = np.frombuffer(b"".join(s.ljust(longest + 3, b"\0") for s in streams), np.uint8).reshape(len(streams), -1)
    at = offsets[:codes_there]
    byte = np.minimum(at >> 3, longest)
    wide = raw[:, byte].astype(np.int32) | raw[:, byte + 1].astype(np.int32) << 8 | raw[:, byte + 2].astype(np.int32) << 16
    codes = (wide >> (at & 7)) & ((1 << widths[:codes_there]) - 1)
    ended = codes == 257
    counts = np.where(ended.any(axis=1), ended.argmax(axis=1), codes_there)
    inside = np.arange(codes_there) < counts[:, None]
    lens = np.array([len(s) for s in streams])
    # one clear code, at the front, and an end code: anything else is read code by code
    plain = ended.any(axis=1) & (lens >= 2) & (raw[:, 0] == 0) & (raw[:, 1] & 1 == 1) & ~((codes == 256) & inside).any(axis=1)
    plain &= (offsets[counts] + widths[counts] <= 8 * lens) & (counts > 0)
    inside &= plain[:, None]
    literal = codes < 256
    entry = np.where(literal | ~inside, 0, codes - 258)
    if (inside & ~literal & (entry >= np.arange(codes_there))).any():
        raise ValueError("an LZW code that is not known yet")
    lengths = np.zeros((codes_there, len(streams)), np.int64)
    from_, root, lane = np.ascontiguousarray(entry.T), np.ascontiguousarray((literal | ~inside).T), np.arange(len(streams))
    for k in range(int(counts.max())):
        lengths[k] = np.where(root[k], 1, lengths[from_[k], lane] + 1)
    lengths = np.where(inside, lengths.T, 0)
    ends = np.cumsum(lengths).reshape(lengths.shape)
    starts = ends - lengths
    copied_from = np.where(literal, starts, np.take_along_axis(starts, entry, 1))
    sizes = lengths.ravel()
    source = np.arange(int(sizes.sum())) + np.repeat((copied_from - starts).ravel(), sizes)
    value = np.zeros(len(source), np.uint8)
    roots = literal & inside
    value[starts[roots]] = codes[roots]
    while True:  # each step doubles how far back a sample has been followed
        further = source[source]
        if np.array_equal(further, source):
            break
        source = further
    whole = value[source].tobytes()
    bounds = [0, *ends[:, -1].tolist()]
    return [whole[bounds[i] : bounds[i + 1]] if plain[i] else lzw_decode(s, 8) for i, s in enumerate(streams)]


# ---- files


@dataclass
class Frame:
    at_ms: int
    delay_ms: int
    rgba: np.ndarray  # height x width x 4, composited


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """The joined sub-blocks at `at`, and where they end."""
    out = []
    while n := data[at]:
        out.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(out), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 2 << (flags & 7)
    if len(data) < at + 3 * n:
        raise ValueError("a palette is cut short")
    full = np.zeros((256, 3), np.uint8)
    full[:n] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
    return full, at + 3 * n


@dataclass
class Picture:
    """A frame as it is stored."""

    box: tuple[int, int, int, int]
    interlaced: bool
    colours: np.ndarray
    least: int
    stream: bytes
    disposal: int
    delay: int
    clear: int | None


def _pictures(data: bytes) -> tuple[int, int, list[Picture]]:
    """Width, height and all stored frames."""
    width, height, flags = struct.unpack("<HHB", data[6:11])
    shared, at = _palette(data, 13, flags)
    found: list[Picture] = []
    disposal, delay, clear = 0, 0, None
    while (kind := data[at]) != 0x3B:
        if kind == 0x21:
            label = data[at + 1]
            body, end = _blocks(data, at + 2)
            if label == 0xF9:
                bits, delay, index = struct.unpack("<BHB", body[:4])
                disposal, clear = bits >> 2 & 7, index if bits & 1 else None
            at = end
            continue
        if kind != 0x2C:
            raise ValueError("an unknown block")
        *box, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        own, at = _palette(data, at + 10, flags)
        colours = own if own is not None else shared
        if colours is None:
            raise ValueError("a frame without a palette")
        least = data[at]
        stream, at = _blocks(data, at + 1)
        found.append(Picture(tuple(box), bool(flags & 0x40), colours, least, stream, disposal, delay, clear))
        disposal, delay, clear = 0, 0, None
    return width, height, found


def _shown(width: int, height: int, pictures: list[Picture], pixels: Iterable[bytes]) -> Iterator[Frame]:
    """The frames as they appear on the screen, one after the other."""
    canvas = np.zeros((height, width, 4), np.uint8)
    now = 0
    for picture, own in zip(pictures, pixels, strict=True):
        x, y, w, h = picture.box
        if len(own) < w * h:
            raise ValueError("a frame is cut short")
        index = np.frombuffer(own, np.uint8, w * h).reshape(h, w)
        if picture.interlaced:  # rows 0, 8.. then 4, 12.. then 2, 6.. then 1, 3..
            rows = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            index = index[np.argsort(rows)]
        kept = canvas.copy() if picture.disposal == 3 else None
        area = canvas[y : y + h, x : x + w]
        index = index[: area.shape[0], : area.shape[1]]
        if picture.clear is None:
            area[..., :3] = picture.colours[index]
            area[..., 3] = 255
        else:
            seen = index != picture.clear
            area[seen, :3] = picture.colours[index[seen]]
            area[seen, 3] = 255
        yield Frame(now, picture.delay * 10, canvas.copy())
        now += picture.delay * 10
        if picture.disposal == 2:
            area[...] = 0
        elif kept is not None:
            canvas = kept


def _parsed(data: bytes) -> tuple[int, int, list[Picture]]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    try:
        return _pictures(data)
    except (IndexError, struct.error) as e:
        raise ValueError("a GIF is cut short") from e


def decode_many(files: list[bytes]) -> Iterator[Iterator[Frame]]:
    """The frames of each file, as they appear on the screen; the streams of all files are decoded side by side."""
    parsed = [_parsed(data) for data in files]
    wide = [p.stream for _, _, pictures in parsed for p in pictures if p.least == 8]
    known = iter(lzw_decode_many(wide) if wide else ())
    for width, height, pictures in parsed:
        yield _shown(width, height, pictures, [next(known) if p.least == 8 else lzw_decode(p.stream, p.least) for p in pictures])


def decode(data: bytes) -> list[Frame]:
    """All frames as they appear on the screen."""
    return [frame for frames in decode_many([data]) for frame in frames]


def encode_many(payloads: list[bytes], side: int = SIDE, delay_cs: int = DELAY_CS) -> list[bytes]:
    """Each payload (a positive multiple of side * side bytes) as a GIF of full frames."""
    unit = side * side
    if any(not p or len(p) % unit for p in payloads):
        raise ValueError("a payload must fill whole frames")
    head = b"GIF89a" + struct.pack("<HHBBB", side, side, 0xF7, 0, 0) + PALETTE.tobytes()
    frame_head = b"\x21\xf9\x04\x04" + struct.pack("<H", delay_cs) + b"\x00\x00" + b"\x2c" + struct.pack("<HHHHB", 0, 0, side, side, 0) + b"\x08"
    streams = iter(lzw_encode_many(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, unit)) if payloads else ())
    files = []
    for payload in payloads:
        out = [head]
        for _ in range(len(payload) // unit):
            stream = next(streams)
            out.append(frame_head)
            for k in range(0, len(stream), 255):
                part = stream[k : k + 255]
                out += (bytes([len(part)]), part)
            out.append(b"\x00")
        out.append(b"\x3b")
        files.append(b"".join(out))
    return files


def encode(payload: bytes, side: int = SIDE, delay_cs: int = DELAY_CS) -> bytes:
    """A payload as a GIF of full frames."""
    return encode_many([payload], side, delay_cs)[0]


def histogram(rgba: np.ndarray) -> np.ndarray:
    """Pixels by colour, HIST_BITS of each channel; pixels that nothing was drawn on do not count."""
    c = (rgba[..., :3] >> (8 - HIST_BITS)).astype(np.int32)
    index = (c[..., 0] << 2 * HIST_BITS) | (c[..., 1] << HIST_BITS) | c[..., 2]
    return np.bincount(index[rgba[..., 3] > 0], minlength=1 << 3 * HIST_BITS)


def samples(frames: Iterable[Frame]) -> bytes:
    """The payload behind frames that encode() made: each colour's byte value."""
    rgb = np.concatenate([f.rgba.reshape(-1, 4) for f in frames])
    return (rgb[:, 0] | rgb[:, 1] >> 3 | rgb[:, 2] >> 6).tobytes()


FRAME = "frame int, at_ms long, delay_ms long, width int, height int, histogram array<long>"


def frame_rows(media: DataFrame, column: str, key: str) -> DataFrame:
    """The key and a row of FRAME for each frame of the GIF in a binary column."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, data in zip(batch[key], batch[column], strict=True):
                for i, f in enumerate(decode(bytes(data)) if data is not None else ()):
                    out.append((k, i, f.at_ms, f.delay_ms, f.rgba.shape[1], f.rgba.shape[0], histogram(f.rgba).tolist()))
            yield pd.DataFrame(out, columns=[key, *(x.split()[0] for x in FRAME.split(", "))])

    kind = media.schema[key].dataType.simpleString()
    return media.select(key, column).mapInPandas(rows, f"`{key}` {kind}, {FRAME}")


RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def measured(texts: list[str | None]) -> list[tuple]:
    """Each text stored as a GIF, read back, and described: RESULT without doc_id."""
    unit = SIDE * SIDE
    own = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    media = encode_many([x + bytes([FILL]) * ((-len(x)) % unit or (0 if x else unit)) for x in own])
    rows = []
    for x, data, frames in zip(own, media, decode_many(media), strict=True):
        digest, tail, n, count, ends = hashlib.sha256(), b"", 0, 0, 0
        total = np.zeros(1 << 3 * HIST_BITS, np.int64)
        for some in batched(frames, 256):  # of a long text, not all frames at once
            back = samples(some)
            digest.update(back)
            tail, n, count, ends = back[-32:], n + len(back), count + len(some), some[-1].at_ms + some[-1].delay_ms
            total += histogram(np.concatenate([f.rgba for f in some]))
        feature = f"{count}x{SIDE}x{SIDE}/{ends}ms:" + ",".join(map(str, total.tolist()))
        rows.append((len(x), n, digest.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), feature))
    return rows


#: Texts are stored and read back together up to this many characters.
TOGETHER = 1 << 20


def _together(texts: list[str | None]) -> Iterator[slice]:
    begin = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t or "") > TOGETHER:
            yield slice(begin, k)
            begin, size = k, 0
        size += len(t or "")
    if begin < len(texts):
        yield slice(begin, len(texts))


def op8_gif(spark, sf_dir: str) -> DataFrame:
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RESULT.split(", ")]
        for batch in batches:
            ids, texts = batch["doc_id"].tolist(), batch["text"].tolist()
            for part in _together(texts):
                rows = [(i, *row) for i, row in zip(ids[part], measured(texts[part]), strict=True)]
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").mapInPandas(measure, RESULT)
