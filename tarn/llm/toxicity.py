"""Toxicity: a support vector machine over a subsequence string kernel, with Nystrom landmarks.

The kernel of two words adds up, over their common subsequences of three letters, the decay
DECAY**span of both occurrences, where an occurrence may have gaps but spans at most WINDOW
letters; a mark for the word's start counts as a letter. It is divided by what words of these
lengths can reach. Marks inside a word are skipped and gaps are allowed, so inserted and dropped
characters leave much of the kernel in place.

Learning, from a bounded sample (MOST documents of each class): labels are those of whole texts, so
each toxic text is stood for by its most telling word, chosen first by how much more often toxic
texts use it and then by the machine itself, and texts that are not toxic by words that score high.
Landmarks are telling and common words; Nystrom features are kernels with the landmarks times the
inverse root of the landmarks' own kernel matrix. As the decision is linear in the kernel, landmarks,
inverse root and weights multiply out to one weight per three-letter subsequence; a text is scored
by that table, word by word, and its highest word decides, through a fitted logistic curve.

Defined cases: null and empty texts have no words and the lowest word score (0 before the curve);
without labels of both classes, or a word that tells them apart, every score is 0; labels other than 0 and 1 are ignored; texts may
have any length; repeated rows get equal scores; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import labelled
from tarn.llm.common import held_out, table

#: The most documents of each class that are learned from; landmarks; words in a machine's training set.
MOST, LANDMARKS, WORDS = 2000, 256, 6000
DECAY, WINDOW, ROUNDS = 0.6, 7, 3
#: What a clean word on the wrong side costs, against 1 for each toxic text that a word stands for (20 at most).
CLEAN_COST = 4.0
THRESHOLD = 0.5
#: Letters are numbered below this; 0 is the mark before a word.
LETTERS = 64
#: Fixed values: (second, third) place of a subsequence after its first.
GAPS = tuple((j, k) for k in range(2, WINDOW) for j in range(1, k))
#: Texts are taken together up to this many characters; words whose feature vectors are held at once.
CHUNK, BLOCK = 1 << 18, 256

_SKIP, _SPACE = 255, 254


def _alphabet() -> np.ndarray:
    """The class of each code point below 0x3000: letters and digits share LETTERS - 1 numbers."""
    out = np.full(0x3000, _SKIP, np.uint8)
    common = "abcdefghijklmnopqrstuvwxyz0123456789àáâãäåæçèéêëìíîïñòóôõöùúûü"
    for c in range(0x3000):
        if chr(c).isspace():
            out[c] = _SPACE
        elif chr(c).isalnum():
            low = chr(c).lower()[0]
            at = common.find(low)
            out[c] = 1 + (at if at >= 0 else ord(low)) % (LETTERS - 1)
    return out


ALPHABET = _alphabet()


def letters(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's letter numbers, with a 0 before each word, and the word number of each."""
    points = np.frombuffer(f" {text}".encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = ALPHABET[np.minimum(points, 0x2FFF)]
    kinds[points >= 0x3000] = 1 + points[points >= 0x3000] % (LETTERS - 1)
    kinds = kinds[kinds != _SKIP]
    kinds[kinds == _SPACE] = 0
    return kinds, np.cumsum(kinds == 0) - 1


def _norms(longest: int) -> np.ndarray:
    """By the length of a word with its mark: the kernel's root for a word without repeated subsequences."""
    lengths = np.arange(longest + 1)
    return np.sqrt(sum(np.maximum(lengths - k, 0) * DECAY ** (2 * (k + 1)) for _, k in GAPS))


def _occurrences(kinds: np.ndarray, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(subsequence, word, decay) of every occurrence, a gap pattern at a time."""
    wide = kinds.astype(np.int32)
    for j, k in GAPS:
        if len(wide) <= k:
            continue
        inside = words[:-k] == words[k:]
        codes = (wide[:-k] * LETTERS + wide[j : len(wide) - k + j]) * LETTERS + wide[k:]
        yield codes[inside], words[:-k][inside], DECAY ** (k + 1)


def word_scores(text: str, weights: np.ndarray) -> np.ndarray:
    """The decision value of each word of a text."""
    kinds, words = letters(text)
    sums = np.zeros(int(words[-1]) + 1)
    for codes, at, decay in _occurrences(kinds, words):
        sums += np.bincount(at, weights[codes] * decay, len(sums))
    lengths = np.bincount(words, minlength=len(sums))
    return sums / np.maximum(_norms(int(lengths.max()))[lengths], 1e-9)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, value) of the normalised kernel's feature vectors."""
    kinds, at = letters(" ".join(words))
    norms = _norms(int(np.bincount(at).max()))[np.bincount(at)]
    parts = [(w, c, np.full(len(w), d)) for c, w, d in _occurrences(kinds, at)]
    w, c, v = (np.concatenate(x) for x in zip(*parts, strict=True))
    return w, c, v / np.maximum(norms[w], 1e-9)


def dense(words: list[str], columns: np.ndarray) -> np.ndarray:
    """Feature vectors over the given subsequences (a table of column numbers, -1: none)."""
    out = np.zeros((len(words), int(columns.max()) + 1), np.float32)
    w, c, v = features(words)
    at = columns[c]
    ok = at >= 0
    np.add.at(out, (w[ok], at[ok]), v[ok])
    return out


def kernels(words: list[str], columns: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernels of words with landmarks (rows of feature vectors), BLOCK words at a time, so that no matrix of all words' features is held."""
    blocks = [dense(words[at : at + BLOCK], columns).astype(np.float64) @ landmarks.T for at in range(0, len(words), BLOCK)]
    return np.concatenate(blocks) if blocks else np.zeros((0, len(landmarks)))


@dataclass
class Model:
    weights: np.ndarray  # per subsequence
    slope: float
    offset: float


NOTHING = Model(np.zeros(LETTERS**3, np.float32), 0.0, -30.0)


def _words(text: str | None) -> list[str]:
    """The distinct words of a text, in order, without marks and lower-cased, of three letters or more."""
    clean = "".join(c if c.isalnum() else " " if c.isspace() else "" for c in (text or "").lower())
    return list(dict.fromkeys(w for w in clean.split() if len(w) >= 3))


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, passes: int = 12) -> np.ndarray:
    """A linear support vector machine (squared hinge) by dual coordinate descent; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    diag = (x * x).sum(1) + 1 / (2 * cost)
    order = np.random.default_rng(7)
    for _ in range(passes):
        for i in order.permutation(len(x)):
            g = y[i] * (w @ x[i]) - 1 + alpha[i] / (2 * cost[i])
            new = max(alpha[i] - g / diag[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def _curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by gradient steps on standardised margins, mildly held back."""
    mean, spread = margins.mean(), margins.std() + 1e-9
    x = (margins - mean) / spread
    a, b = 1.0, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r, h = p - y, np.maximum(p * (1 - p), 1e-6)
        g = np.array([(r * x).sum() + 1e-2 * a, r.sum()])
        hess = np.array([[(h * x * x).sum() + 1e-2, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        a, b = max(a - step[0], 1e-3), b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return a / spread, b - a * mean / spread


def learn(examples: list[tuple[str | None, int]]) -> Model:
    """examples: (text, y). The same examples in the same order give the same model."""
    pool: dict[str, str] = {}  # each word is held once
    last: dict[tuple[int, int], tuple[str | None, list[str]]] = {}  # copies count once
    for t, v in examples:
        words = [pool.setdefault(w, w) for w in _words(t)]
        last[xxhash.xxh3_128_intdigest(" ".join(sorted(words))), v] = (t, words)
    y = np.array([v for _, v in last])
    examples, texts = ([x[k] for x in last.values()] for k in (0, 1))
    if not texts or not 0 < y.sum() < len(y):
        return NOTHING
    toxic, clean = Counter(), Counter()
    for words, label in zip(texts, y, strict=True):
        (toxic if label else clean).update(words)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    seed = lambda w: xxhash.xxh64_intdigest(w)
    telling = {w: np.log((k + 0.1) / n1) - np.log((clean[w] + 0.5) / n0) for w, k in toxic.items()}
    witness = [max(words, key=lambda w: (telling[w], seed(w)), default=None) for words, label in zip(texts, y, strict=True) if label]
    if not any(witness):
        return NOTHING
    common = sorted(clean, key=lambda w: (-clean[w], seed(w)))
    negatives = dict.fromkeys(common[: WORDS // 4] + sorted(clean, key=seed)[: WORDS // 4])
    # words that many toxic texts use and no clean one does stand for their texts as well
    sure = Counter({w: k for w, k in toxic.items() if k >= max(5, n1 // 50) and not clean[w]})
    for _ in range(ROUNDS):
        positives = Counter(w for w in witness if w) | sure
        if not positives:
            break
        best = sorted(positives, key=lambda w: (-positives[w], seed(w)))[: WORDS // 4]
        near = list(reversed(negatives))[: LANDMARKS // 4]  # the hardest of the last round
        landmarks = list(dict.fromkeys(best[: LANDMARKS // 2] + near + common[: LANDMARKS // 8] + sorted(negatives, key=seed)[: LANDMARKS // 8]))
        _, used, _ = features(landmarks)
        columns = np.full(LETTERS**3, -1, np.int64)
        used = np.unique(used)
        columns[used] = np.arange(len(used))
        z = dense(landmarks, columns).astype(np.float64)
        values, vectors = np.linalg.eigh(z @ z.T)
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])  # the inverse root of the landmarks' kernel matrix
        others = [w for w in negatives if w not in positives]
        train = best + others
        x = kernels(train, columns, z) @ root
        cost = np.array([min(positives[w], 20.0) for w in best] + [CLEAN_COST] * len(others))
        sign = np.array([1.0] * len(best) + [-1.0] * len(others))
        machine = _machine(x, sign, cost)
        weights = np.zeros(LETTERS**3)
        weights[used] = z.T @ (root @ machine[:-1])
        tops = [word_scores(" ".join(words), weights) if words else np.zeros(1) for words in texts]
        witness = [words[int(t.argmax())] if words else None for words, t, label in zip(texts, tops, y, strict=True) if label]
        hard = {words[int(t.argmax())]: float(t.max()) for words, t, label in zip(texts, tops, y, strict=True) if not label and words}
        for w in sorted(hard, key=lambda w: (-hard[w], seed(w)))[: WORDS // 4][::-1]:
            negatives.pop(w, None)
            negatives[w] = None  # the hardest last
    weights = weights.astype(np.float32)
    margins = margins_of(examples, weights)
    slope, offset = _curve(margins, y)
    return Model(weights, float(slope), float(offset))


def margins_of(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    """The highest word's decision value of each text (0 at least)."""
    out = np.zeros(len(texts))
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= CHUNK):
            size += len(texts[end] or "")
            end += 1
        part = [texts[i] or "" for i in range(at, end)]
        found = word_scores(" ".join(part), weights)
        # each text began a word of its own: count the words (spaces) before it
        begins = np.cumsum([0] + [_spaces(t) + 1 for t in part[:-1]])
        out[at:end] = np.maximum.reduceat(np.maximum(found, 0), begins)
        at = end
    return out


def _spaces(text: str) -> int:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return int((ALPHABET[np.minimum(points, 0x2FFF)] == _SPACE).sum()) - int(((points >= 0x3000) & (ALPHABET[0x2FFF] == _SPACE)).sum())


def scores(texts: list[str | None], model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.slope * margins_of(texts, model.weights) + model.offset, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows = labelled.sample(docs, labels, "toxic", MOST).collect()
    rows.sort(key=lambda r: xxhash.xxh64_intdigest(str(r["doc_id"])))
    return learn([(r["text"], r["y"]) for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: LETTERS**3 weights

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns="text").assign(score=scores(batch["text"].tolist(), shared.value))

    return docs.select("doc_id", "text").mapInPandas(scored, "doc_id long, score double")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose score stays below THRESHOLD."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return labelled.filtered(docs, lambda texts: scores(texts, shared.value) < THRESHOLD)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
