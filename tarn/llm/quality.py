"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse dot products.

A text is cut into words and runs of marks, lower-cased; each has a hash and the hash of its shape
(capitals, digits, marks, or a repeat of the token before it). Features are the hashed 1- and
2-grams of tokens and 1- to 3-grams of shapes, with log counts scaled to length 1. Training reads a
bounded sample (MOST documents of each class, features computed on the executors) and updates the
weights example by example (FTRL-proximal); scoring is one sparse dot product per document.

Defined cases: null and empty texts have no features and get the score of the bias alone; without
labelled rows of both classes every score is 0.5; labels other than 0 and 1 are ignored; a text may have any length;
repeated rows get equal scores; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import labelled
from tarn.llm.common import held_out, table

#: The most documents of each class that are learned from, and passes over them.
MOST, EPOCHS = 2500, 2
BITS = 18
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.02
THRESHOLD = 0.3
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Tokens whose hashes a worker keeps; at that number it starts anew.
KEPT_TOKENS = 120_000


class _Known(dict):
    """token -> its number; a token that is not known yet is hashed and gets the next one."""

    def __init__(self):
        self.hashes = np.zeros(KEPT_TOKENS + 1, np.uint64)
        self.shapes = np.zeros(KEPT_TOKENS + 1, np.uint64)

    def __missing__(self, token: str) -> int:
        n = len(self)
        if n > KEPT_TOKENS:  # one text alone may have more
            self.hashes, self.shapes = (np.append(x, np.zeros_like(x)) for x in (self.hashes, self.shapes)) if n >= len(self.hashes) else (self.hashes, self.shapes)
        self[token] = n
        self.hashes[n] = xxhash.xxh64_intdigest(token.lower())
        if token[0].isalnum() or token[0] == "_":
            shape = "9" if token.isdigit() else "AA" if token.isupper() and len(token) > 1 else "Aa" if token[0].isupper() else "aa"
        else:
            shape = f"{token[:3]}{len(token)}"
        self.shapes[n] = xxhash.xxh64_intdigest(shape, seed=1)
        return n


class Hasher:
    """Sparse features of texts."""

    def __init__(self, bits: int = BITS):
        self.mask = np.uint64((1 << bits) - 1)
        self.known = _Known()

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and values; none for a text without tokens."""
        tokens = TOKEN.findall(text or "")
        if not tokens:
            return np.zeros(0, np.int32), np.zeros(0, np.float32)
        if len(self.known) > KEPT_TOKENS:
            self.known = _Known()
        ids = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        h, s = self.known.hashes[ids], self.known.shapes[ids]
        s[1:][ids[1:] == ids[:-1]] = np.uint64(0x9E3779B97F4A7C15)
        prime = np.uint64(0x100000001B3)
        grams = [h, h[:-1] * prime ^ h[1:], s, s[:-1] * prime ^ s[1:] + np.uint64(7)]
        grams.append((s[:-2] * prime ^ s[1:-1]) * prime ^ s[2:])
        mixed = np.concatenate(grams)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        places, counts = np.unique(((mixed >> np.uint64(32)) & self.mask).astype(np.int32), return_counts=True)
        values = np.log1p(counts).astype(np.float32)
        return places, values / np.sqrt((values * values).sum())


@cache
def hasher() -> Hasher:
    """One for each worker process, which keeps what it has learned from task to task."""
    return Hasher()


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS) -> np.ndarray:
    """The weights; the last is the bias. Examples are taken in the order given."""
    z = np.zeros((1 << bits) + 1)
    n = np.zeros_like(z)

    def weights(at):
        zi, ni = z[at], n[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    bias = np.array([1 << bits])
    for _ in range(EPOCHS):
        for places, values, y in examples:
            at, x = np.concatenate([places, bias]), np.append(values, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(slice(None)).astype(np.float32)


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    own = hasher()
    for batch in batches:
        found = [own.features(t) for t in batch["text"]]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "places": [a.astype("<i4").tobytes() for a, _ in found], "values": [b.astype("<f4").tobytes() for _, b in found]})


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """The weights; zero without labelled documents of both classes."""
    rows = labelled.sample(docs, labels, "quality", MOST).mapInPandas(_features, "doc_id long, y int, places binary, values binary")
    found = rows.toArrow()  # 2 * MOST rows at most, packed; the examples are views of it
    ids, y = (found.column(c).to_pylist() for c in ("doc_id", "y"))
    if len(set(y)) < 2:
        return np.zeros((1 << BITS) + 1, np.float32)
    places, values = ([np.frombuffer(x.as_buffer(), kind) for x in found.column(c)] for c, kind in (("places", "<i4"), ("values", "<f4")))
    order = sorted(range(len(ids)), key=lambda k: xxhash.xxh64_intdigest(str(ids[k])))
    return train([(places[k], values[k], y[k]) for k in order])


def scores(texts: list, own: Hasher, weights: np.ndarray) -> np.ndarray:
    margins = np.full(len(texts), float(weights[-1]))
    for i, text in enumerate(texts):
        places, values = own.features(text)
        margins[i] += float(weights[places] @ values)
    return 1 / (1 + np.exp(-np.clip(margins, -30, 30)))


def _score(batches: Iterator[pd.DataFrame], weights=None) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.drop(columns="text").assign(score=scores(batch["text"].tolist(), hasher(), weights.value))


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # a fixed size, by BITS
    return docs.select("doc_id", "text").mapInPandas(partial(_score, weights=shared), "doc_id long, score double")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose score reaches THRESHOLD."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return labelled.filtered(docs, lambda texts: scores(texts, hasher(), shared.value) >= THRESHOLD)


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
