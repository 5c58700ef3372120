"""Best-fit packing of tokenised documents, improved by a swap-based local search.

A document is its token ids and an end id; one that is longer than a sequence is cut from its end,
so only its first piece may be shorter. What a piece holds does not matter to the packing, only its
length, and there are no more lengths than a sequence has tokens: the pieces are counted by length,
and the driver packs that histogram, whatever the number of documents, as bins of equal content
with a count. Best fit in decreasing order comes first. Then, as long as fewer bins are possible, pieces of
underfull bins (the emptiest first) go to fuller ones: moves of a piece, exchanges of one for one, one for
two and two for one, each of which raises the sum of squared fills and is applied to as many equal bins as there are, until the
fewest possible bins are reached or no two bins have an exchange left. The plan names, for each length, which
ranks go to which bins; each piece gets its rank within its length from counts by (length, salt),
so equal lengths are never gathered in one task.

Defined cases: null text is empty, and its piece is the end id alone; texts of any length are cut;
rows with the same id are packed one by one; a null id is kept; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict, deque
from collections.abc import Iterator, Sequence
from functools import cache, lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import stored, table

CAPACITY, END_ID = 2048, 0
#: Pieces that share a salt, on average.
PER_SALT = 20_000


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ---- tokens


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it can be seen, else one from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Token ids of texts as little-endian 32-bit numbers, for a byte-level vocabulary file of `tokenizers`.

    Whole texts are merged by tiktoken under the file's own vocabulary and pattern, which gives the
    ids that `tokenizers` gives at a fraction of its time; every worker checks that on the first
    texts it sees, and falls back to `tokenizers` for a vocabulary of another kind.
    """

    CHECKED = 3

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text here
        self.fast = self._merger(path)
        self.checks = self.CHECKED if self.fast else 0

    def _merger(self, path: str):
        import public_tokenizers
        import tiktoken

        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        letters = byte_alphabet()
        special = {x["id"] for x in spec.get("added_tokens", ())}
        try:
            ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if i not in special}
        except KeyError:  # not a byte-level vocabulary
            return None
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

    def slow(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.checks:
            own = texts[: self.checks]
            self.checks -= len(own)
            if [self.fast(t).tolist() for t in own] != self.slow(own):
                self.fast, self.checks = None, 0
        found = map(self.fast, texts) if self.fast else self.slow(texts)
        return [np.asarray(ids, "<u4").tobytes() for ids in found]


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process, from task to task."""
    return Encoder(path)


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """PIECE for every piece of docs (doc_id, text)."""
    path = path or vocabulary()
    end = END_ID.to_bytes(4, "little")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, names = encoder(path), [x.split()[0] for x in PIECE.split(", ")]
        for batch in batches:
            for at in range(0, len(batch), 200):
                part, out = batch.iloc[at : at + 200], []
                for doc_id, ids in zip(part["doc_id"], own.encode([t or "" for t in part["text"]]), strict=True):
                    ids = memoryview(ids + end)
                    n = len(ids) // 4
                    start, k = 0, 0
                    while start < n:
                        length = (n - start) % capacity or capacity if k == 0 else capacity
                        out.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                        start, k = start + length, k + 1
                yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(cut, PIECE)


# ---- the plan


class Bins:
    """Bins by what is left in them: left -> {content: count}; content is ((length, times), ..), longest first."""

    def __init__(self):
        self.by_left: dict[int, dict[tuple, int]] = defaultdict(dict)
        self.lefts: list[int] = []
        self.n = 0

    def add(self, left: int, content: tuple, count: int) -> None:
        if count <= 0:
            return
        if not self.by_left[left]:
            insort(self.lefts, left)
        self.by_left[left][content] = self.by_left[left].get(content, 0) + count
        self.n += count

    def take(self, left: int, content: tuple, count: int) -> None:
        have = self.by_left[left]
        have[content] -= count
        self.n -= count
        if have[content] <= 0:
            del have[content]
        if not have:
            del self.lefts[bisect_left(self.lefts, left)]

    def has(self, left: int, content: tuple) -> int:
        return self.by_left[left].get(content, 0) if left in self.by_left else 0

    def tightest(self, length: int) -> int | None:
        at = bisect_left(self.lefts, length)
        return self.lefts[at] if at < len(self.lefts) else None

    def count(self) -> int:
        return self.n


def with_(content: tuple, length: int, times: int) -> tuple:
    have = Counter(dict(content))
    have[length] += times
    return tuple(sorted(((k, v) for k, v in have.items() if v), reverse=True))


def best_fit(histogram: dict[int, int], capacity: int, order: Sequence[int] | None = None) -> Bins:
    """Best fit of the lengths in the order given (decreasing unless told), equal bins together."""
    bins = Bins()
    for length in order or sorted(histogram, reverse=True):
        rest = histogram[length]
        while rest:
            left = bins.tightest(length)
            if left is None:
                content, have, left = (), rest, capacity
            else:
                content, have = next(iter(bins.by_left[left].items()))
                bins.take(left, content, have)
            each = left // length
            full = min(have, rest // each)
            bins.add(left - each * length, with_(content, length, each), full)
            rest -= full * each
            used = full
            if rest and full < have and rest < each:
                bins.add(left - rest * length, with_(content, length, rest), 1)
                used, rest = full + 1, 0
            if content:
                bins.add(left, content, have - used)
    return bins


@lru_cache(100_000)
def _sums(content: tuple) -> tuple[list[int], dict, list[int]]:
    """The lengths of a content, the pairs of its pieces by their sum, and those sums."""
    own = sorted({k for k, _ in content})
    times = dict(content)
    two = dict(sorted({a + b: (a, b) for i, a in enumerate(own) for b in own[i:] if a != b or times[a] > 1}.items()))
    return own, two, list(two)


def _exchange(giver: tuple, taker: tuple, left: int) -> tuple[int, tuple, tuple] | None:
    """The exchange that fills a taker with `left` room most: (gain, what comes, what goes); None if none fits."""
    best = None
    lengths, pairs, _ = _sums(giver)
    own, two, sums = _sums(taker)

    def offer(gain: int, comes: tuple, goes: tuple) -> None:
        nonlocal best
        if 0 < gain <= left and (best is None or gain > best[0]):
            best = (gain, comes, goes)

    at = bisect_right(lengths, left)
    if at:
        offer(lengths[at - 1], (lengths[at - 1],), ())
    for b in lengths:
        for one in own[bisect_left(own, b - left) : bisect_left(own, b)][:1]:
            offer(b - one, (b,), (one,))
        for s in sums[bisect_left(sums, b - left) : bisect_left(sums, b)][:1]:
            offer(b - s, (b,), two[s])
    for s, (a, b) in pairs.items():
        for one in own[bisect_left(own, s - left) : bisect_left(own, s)][:1]:
            offer(s - one, (a, b), (one,))
    return best


def _changed(content: tuple, comes: tuple, goes: tuple) -> tuple:
    for x in comes:
        content = with_(content, x, 1)
    for x in goes:
        content = with_(content, x, -1)
    return content


def improve(bins: Bins, capacity: int, total: int) -> int:
    """Exchanges between underfull bins until no fewer bins are possible or none is left; how many there were, equal bins counted once.

    The emptiest bins give to fuller ones, those with the most room first. Each exchange raises the sum of squared
    fills, so they end. Whether two contents have an exchange does not change, so a giver that found none looks only at
    what was made since. What an exchange leaves of the giver goes on with the takers at hand, and then looks at the others.
    """
    bound = -(-total // capacity)
    made: list[tuple[int, tuple]] = []
    seen: dict[tuple, int] = {}  # content -> how much of made it has been held against
    exchanges = 0
    while bins.n > bound:
        giver = next(((x, c) for x in reversed(bins.lefts) if x for c in sorted(bins.by_left[x]) if seen.get(c, -1) < len(made)), None)
        if giver is None:
            break
        if giver[1] in seen:
            takers = deque(dict.fromkeys(made[seen[giver[1]] :]))
        else:
            takers = deque((x, c) for x in reversed(bins.lefts) if x for c in sorted(bins.by_left[x]))
        failed, changed = 0, False
        while bins.n > bound:
            if failed >= len(takers):
                if not changed:
                    seen[giver[1]] = len(made)
                    break
                held = set(takers)  # nothing among them for what the giver has become
                takers = deque(t for x in reversed(bins.lefts) if x for c in sorted(bins.by_left[x]) if (t := (x, c)) not in held)
                failed, changed = 0, False
                continue
            left, content = giver
            room, taker = takers.popleft()
            givers = bins.has(left, content)
            count = givers // 2 if taker == content else min(givers, bins.has(room, taker))
            found = _exchange(content, taker, room) if count and room else None
            if found is None or left - room + found[0] <= 0:  # the fuller bin must become fuller than the other was
                if count and room:
                    takers.append((room, taker))
                    failed += 1
                continue
            gain, comes, goes = found
            bins.take(room, taker, count)
            bins.take(left, content, count)
            exchanges += 1
            failed = 0
            fuller, emptier = (room - gain, _changed(taker, comes, goes)), (left + gain, _changed(content, goes, comes))
            bins.add(*fuller, count)
            made.append(fuller)
            if fuller[0]:
                takers.append(fuller)
            if bins.has(room, taker):
                takers.append((room, taker))
            if not emptier[1]:
                break
            bins.add(*emptier, count)
            made.append(emptier)
            giver, changed = emptier, True
    return exchanges


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first bin, pieces in a bin, offset of the first), in order of rank."""
    bins = best_fit(histogram, capacity)
    improve(bins, capacity, sum(k * v for k, v in histogram.items()))
    ranks: Counter = Counter()
    out: dict[int, list] = defaultdict(list)
    bin_ = 0
    for left in sorted(bins.by_left):
        for content, count in sorted(bins.by_left[left].items()):
            offset = 0
            for length, times in content:
                out[length].append((ranks[length], bin_, times, offset))
                ranks[length] += count * times
                offset += length * times
            bin_ += count
    if ranks != Counter(histogram):
        raise AssertionError("the plan does not hold every piece once")
    return {k: np.array(v, np.int64) for k, v in out.items()}


def ranked(found: DataFrame, rows: int) -> DataFrame:
    """found with rank: 0, 1, .. within each length."""
    salts = max(1, rows // PER_SALT)
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("length").alias("_length"), F.col("salt").alias("_salt"), F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    joined = salted.withColumn("own", own).join(counts.hint("merge"), (F.col("length") == F.col("_length")) & (F.col("salt") == F.col("_salt")))
    return joined.select(*found.columns, (F.col("own") + F.col("before")).alias("rank"))


PACKED = f"{PIECE}, sequence_id long, offset long"


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """PACKED for every piece of docs (doc_id, text)."""
    found = stored(pieces(docs, path, capacity), "pieces")
    histogram = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # at most `capacity` rows
    own = docs.sparkSession.sparkContext.broadcast(plan(histogram, capacity))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths, ranks = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for length in np.unique(lengths):
                rows, here = own.value[int(length)], np.flatnonzero(lengths == length)
                at = rows[np.searchsorted(rows[:, 0], ranks[here], "right") - 1]
                into, within = np.divmod(ranks[here] - at[:, 0], at[:, 2])
                sequence[here], offset[here] = at[:, 1] + into, at[:, 3] + within * length
            yield batch.drop(columns="rank").assign(sequence_id=sequence, offset=offset).astype({"doc_id": "Int64"})

    return ranked(found, sum(histogram.values())).mapInPandas(place, PACKED)


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


