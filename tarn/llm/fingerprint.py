"""Document fingerprints from prefix polynomial hashes.

`Prefix` holds the running sums of code * base**position modulo two primes. Any span's hash follows
from two entries, so spans of any texts are compared without reading them again, and the longest
common extension of two positions is found by binary search over span lengths.

A fingerprint keeps the prefix hashes at a text's anchors: positions whose preceding window of WINDOW code points has a
lower hash (of the same prefix sums) than any window within REACH on either side, about one in 33 code points at any length. Anchors
move with the text around them, so blocks between them are found again behind an insertion. The likeness of two fingerprints is
the share of the longer text that lies in longest common extensions, each begun at the nearest pair of equal blocks ahead.

Defined cases: null text is empty; two empty texts are alike (1), an empty and another one are not
(0); a text without anchors (shorter than some 40 code points, or repeating itself) is one block; texts of any length are read in pieces;
equal texts have equal fingerprints; rows with the same id stand side by side in order of
their texts, rows without an id behind all others; the only document of a table is its own
successor; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.order import cuts, with_successors

#: The two primes and their bases.
PRIMES, BASES = (2147483647, 2147483629), (911382323, 972663749)
INVERSES = tuple(pow(b, -1, p) for b, p in zip(BASES, PRIMES, strict=True))
#: Code points in the window whose hash makes an anchor, and how far on either side no other window's may be as low.
WINDOW, REACH = 8, 16
#: Code points of a text that are worked on at once.
PIECE = 1 << 18

_powers = {b: np.ones(1, np.int64) for b in (*BASES, *INVERSES)}


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo the prime; what was computed before is kept."""
    have = _powers[base]
    while len(have) < n:
        have = np.concatenate([have, have * pow(base, len(have), prime) % prime])
        _powers[base] = have
    return have[:n]


def codes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _running(points: np.ndarray, k: int) -> np.ndarray:
    """The running sums of (code + 1) * base**position, with the empty one in front; not reduced."""
    return np.concatenate([[0], np.cumsum((points + 1) * powers(BASES[k], PRIMES[k], len(points)) % PRIMES[k])])


class Prefix:
    """Prefix hashes of a text at some of its positions: at[0] = 0, .., at[-1] = its length; everywhere unless told."""

    def __init__(self, points: np.ndarray, at: np.ndarray | None = None):
        self.at = np.arange(len(points) + 1) if at is None else at
        self.sums = np.zeros((2, len(self.at)), np.int64)
        for k, (base, prime) in enumerate(zip(BASES, PRIMES, strict=True)):
            before = 0
            for begin in range(0, len(points), PIECE):
                own = _running(points[begin : begin + PIECE], k) % prime
                low, high = np.searchsorted(self.at, [begin + 1, begin + len(own)])
                shift = pow(base, begin, prime)
                self.sums[k, low:high] = (before + shift * own[self.at[low:high] - begin]) % prime
                before = (before + shift * int(own[-1])) % prime

    @property
    def n(self) -> int:
        return int(self.at[-1])

    def _inverse(self, i: int) -> list[int]:
        return [pow(b, int(self.at[i]), p) for b, p in zip(INVERSES, PRIMES, strict=True)]

    def span(self, i: int, j: int, inverse: list[int] | None = None) -> tuple[int, int]:
        """The hash of the text between the i-th and the j-th position, the same wherever the same text stands."""
        inverse = inverse or self._inverse(i)
        return tuple((int(s[j]) - int(s[i])) * b % p for s, b, p in zip(self.sums, inverse, PRIMES, strict=True))

    def spans(self) -> np.ndarray:
        """The hashes between neighbouring positions, two 31-bit parts in one number."""
        parts = []
        for k, (base, prime) in enumerate(zip(INVERSES, PRIMES, strict=True)):
            parts.append(np.diff(self.sums[k]) % prime * _raised(base, self.at[:-1], prime) % prime)
        return parts[0] << 31 | parts[1]

    def common(self, i: int, other: Prefix, j: int) -> int:
        """The longest common extension from the i-th position here and the j-th there, in positions, by binary search."""
        mine, theirs = self._inverse(i), other._inverse(j)
        low, high = 0, min(len(self.at) - i, len(other.at) - j) - 1
        while low < high:
            mid = (low + high + 1) // 2
            if self.at[i + mid] - self.at[i] == other.at[j + mid] - other.at[j] and self.span(i, i + mid, mine) == other.span(j, j + mid, theirs):
                low = mid
            else:
                high = mid - 1
        return low


def _raised(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    """base**exponent modulo the prime; exponents ascend."""
    turns, within = np.divmod(exponents, PIECE)
    out = powers(base, prime, int(within.max()) + 1)[within]
    if turns[-1]:
        high = np.array([pow(base, PIECE * t, prime) for t in range(int(turns[-1]) + 1)], np.int64)
        out = out * high[turns] % prime
    return out


def _lowest(x: np.ndarray, reach: int) -> np.ndarray:
    """The least of the `reach` values that begin at each place (of those there are, at the end)."""
    out, have = x, 1
    while have < reach:
        step = min(have, reach - have)
        out = np.minimum(out, np.concatenate([out[step:], np.repeat(out[-1:], min(step, len(out)))]))
        have += step
    return out


def anchors(points: np.ndarray) -> np.ndarray:
    """The positions, in order, at which the window before has a lower hash than all within REACH on either side.

    They depend on the text around them alone, so they move with it; there are more than REACH code points between two.
    """
    found, margin = [], WINDOW + REACH
    prime, inverse = PRIMES[0], INVERSES[0]
    for begin in range(0, len(points), PIECE):
        first = max(0, begin - margin)
        piece = points[first : begin + PIECE + margin]
        if len(piece) < WINDOW + 2 * REACH + 1:
            continue
        sums = _running(piece, 0)
        hashes = (sums[WINDOW:] - sums[:-WINDOW]) % prime * powers(inverse, prime, len(piece))[: len(sums) - WINDOW] % prime
        low = _lowest(hashes, REACH)
        # places with REACH windows on either side, all higher
        inner = hashes[REACH:-REACH]
        own = np.flatnonzero((inner < low[: len(inner)]) & (inner < low[REACH + 1 : REACH + 1 + len(inner)])) + first + REACH + WINDOW
        found.append(own[(own >= begin) & (own < begin + PIECE)])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


class Fingerprint(Prefix):
    """A text's prefix hashes at its anchors, its begin and its end."""

    def __init__(self, points: np.ndarray):
        super().__init__(points, np.unique(np.concatenate([[0], anchors(points), [len(points)]])))

    def __str__(self) -> str:
        at, both = self.at[1:], (self.sums[0] << 31 | self.sums[1])[1:]
        return f"{self.n}:" + base64.b64encode(at.astype(">u4").tobytes() + both.astype(">i8").tobytes()).decode()

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        raw = base64.b64decode(text.partition(":")[2])
        n = len(raw) // 12
        at, both = np.frombuffer(raw, ">u4", n).astype(np.int64), np.frombuffer(raw, ">i8", n, 4 * n).astype(np.int64)
        out = cls.__new__(cls)
        out.at = np.concatenate([[0], at])
        out.sums = np.stack([np.concatenate([[0], x]) for x in (both >> 31, both & 0x7FFFFFFF)])
        return out

    @cached_property
    def blocks(self) -> np.ndarray:
        return self.spans()

    def likeness(self, other: Fingerprint) -> float:
        """The share of the longer text that lies in common extensions.

        From the two begins on, the longest common extension is taken; behind it, the nearest pair of equal
        blocks ahead (fewest blocks skipped in both, then fewest here) begins the next one, and so on.
        """
        if not self.n or not other.n:
            return float(self.n == other.n)
        there: dict[int, list[int]] = {}
        for k, h in enumerate(other.blocks.tolist()):
            there.setdefault(h, []).append(k)
        mine = self.blocks.tolist()
        ahead = [k for k, h in enumerate(mine) if h in there]
        i = j = at = alike = 0
        while at < len(ahead):
            best = None
            for k in ahead[at:]:
                if best and k - i >= best[0]:
                    break
                places = there[mine[k]]
                if (p := bisect_left(places, j)) < len(places) and (best is None or (k - i) + (places[p] - j) < best[0]):
                    best = ((k - i) + (places[p] - j), k, places[p])
            if best is None:
                break
            _, i, j = best
            n = self.common(i, other, j)
            alike += int(self.at[i + n] - self.at[i])
            i, j = i + max(n, 1), j + max(n, 1)
            at = bisect_left(ahead, i)
        return alike / max(self.n, other.n)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc_id, own: np.ndarray, print_: Fingerprint, after: np.ndarray, after_print: Fingerprint) -> tuple:
    half = len(own) // 2
    edited = np.concatenate([own[: len(own) - half], after[:half]])
    text = edited.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    edited_print = Fingerprint(edited)
    return (doc_id, len(own), hashlib.sha256(text).hexdigest(), str(print_), str(edited_print), print_.likeness(edited_print), print_.likeness(after_print))


def fingerprints(docs: DataFrame) -> DataFrame:
    """RESULT for every row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    least = docs.agg(F.min("doc_id")).first()[0]
    ordered = with_successors(docs, "doc_id", least, cuts(docs, "doc_id"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RESULT.split(", ")]
        out: list[tuple] = []
        begin = waiting = None  # the range's first row; the row whose successor has not come yet; each (id, points, fingerprint)
        range_ = None
        frame = lambda: pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})
        for batch in batches:
            for here, after, doc_id, text in zip(batch["_range"], batch["_after"], batch["doc_id"], batch["text"], strict=True):
                if here != range_:
                    if waiting is not None:  # no row begins the next range: a table without ids
                        out.append(_row(*waiting, *begin[1:]))
                    range_, waiting, begin = here, None, None
                if after and waiting is None:
                    continue
                points = codes(text)
                now = (None if pd.isna(doc_id) else int(doc_id), points, Fingerprint(points))
                if waiting is not None:
                    out.append(_row(*waiting, *now[1:]))
                waiting = None if after else now
                begin = begin or now
                if len(out) >= 1000:
                    yield frame()
                    out.clear()
        if waiting is not None:
            out.append(_row(*waiting, *begin[1:]))
        if out:
            yield frame()

    return ordered.mapInPandas(walk, RESULT)


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
