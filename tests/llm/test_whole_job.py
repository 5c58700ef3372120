"""Cases in which an operator once did less than the whole job."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from tarn.llm import near_dedup, packing


def _rows(rows):
    """OPEN rows from (tree, key, rep, component, n_shingles, sig, keys)."""
    names = near_dedup._names(near_dedup.OPEN)
    columns = list(zip(*[(t, k, rep, rep, c, n, sig, keys) for t, k, rep, c, n, sig, keys in rows], strict=True))
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    return pa.table({name: pa.array(c, kind) for name, c, kind in zip(names, columns, kinds, strict=True)})


def test_signatures_nominate_pairs_at_the_threshold():
    p, n = near_dedup.PERCENT / 100, near_dedup.HASHES
    least = near_dedup.least_equal()
    assert sum(math.comb(n, x) * p**x * (1 - p) ** (n - x) for x in range(least)) <= 1e-6
    a = np.arange(n, dtype=np.uint8)
    b = np.where(np.arange(n) < least, a, a + 100).astype(np.uint8)
    c = np.where(np.arange(n) < least - 1, a, a + 100).astype(np.uint8)
    pair = lambda x, y, *keys: near_dedup.likely(_rows([(1, 5, 1, 1, 100, x.tobytes(), keys[0]), (1, 5, 2, 2, 100, y.tobytes(), keys[1])]), 0)
    assert [x.tolist() for x in pair(a, b, [0, 5], [0, 5])] == [[0], [1]]
    assert [x.tolist() for x in pair(a, c, [0, 5], [0, 5])] == [[], []]
    assert [x.tolist() for x in pair(a, b, [7, 5], [7, 5])] == [[], []]  # together in an earlier tree
    assert [x.tolist() for x in pair(a, b, [7, 5], [8, 5])] == [[0], [1]]


def test_likely_pairs_by_brute_force():
    r = np.random.default_rng(3)
    base = r.integers(0, 256, near_dedup.HASHES)
    rows = []
    for key, n in ((1, 1), (2, 2), (3, 30), (4, 200), (5, 3)):
        own = []
        for k in range(n):
            sig = np.where(r.random(near_dedup.HASHES) < 0.2, r.integers(0, 256, near_dedup.HASHES), base).astype(np.uint8)
            own.append((0, key, 1000 * key + k, int(r.integers(0, 3 if n > 3 else 9)), int(r.integers(80, 120)), sig.tobytes(), [key]))
        rows += sorted(own, key=lambda x: x[4])
    got = set(zip(*[x.tolist() for x in near_dedup.likely(_rows(rows), 0)], strict=True))
    want = set()
    for i, j in itertools.combinations(range(len(rows)), 2):
        (_, k, _, c, n, s, _), (_, l, _, d, m, t, _) = rows[i], rows[j]
        same = sum(x == y for x, y in zip(s, t, strict=True))
        if k == l and c != d and 100 * min(n, m) >= near_dedup.PERCENT * max(n, m) and same >= near_dedup.least_equal():
            want.add((i, j))
    assert got == want and len(want) > 100


def test_large_leaves_are_compared_whole(spark, monkeypatch):
    for name, value in (("BLOCK", 20), ("DEPTH", 3), ("SMALL", 100)):
        monkeypatch.setattr(near_dedup, name, value)
    n = 900  # equal signatures: one node at any depth; a core, a middling component and single ones
    component = [0 if k < 500 else 500 if k < 515 else k for k in range(n)]
    sig, roots = bytes(near_dedup.HASHES), bytes(4 * near_dedup.FIRST)
    classes = spark.createDataFrame([(k, k, 50, roots, sig) for k in range(n)], "rep long, f1 long, n_shingles long, roots binary, sig binary")
    joined = spark.createDataFrame([x for x in enumerate(component) if component.count(x[1]) > 1], "rep long, component long")
    scratch: list[str] = []
    nodes, leaves, depths = near_dedup.small_nodes(classes, joined, range(1), scratch)
    assert nodes.count() == 0 and leaves.count() == n and {r["depth"] for r in depths.collect()} == {3}
    blocks = defaultdict(list)
    for r in near_dedup.with_pivot(leaves).collect():
        blocks[r["key"]].append(r["rep"])
    assert len(blocks) == 45 and all(0 in reps and len(reps) < 60 for reps in blocks.values())
    met, cells = set(), defaultdict(list)
    for r in near_dedup.block_pairs(leaves, scratch).collect():
        cells[r["tree"], r["key"]].append(r["rep"])
    for reps in cells.values():
        assert len(set(reps)) == len(reps) < 150
        met |= set(itertools.combinations(sorted(reps), 2))
    assert all((a, b) in met for a, b in itertools.combinations(range(n), 2) if component[a] != component[b])


def _crowd(n):
    r = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    base = [r.choice(words) for _ in range(150)]
    texts = []
    for _ in range(n):
        t = base[:]
        for _ in range(r.randrange(2, 14)):
            t[r.randrange(len(t))] = r.choice(words)
        texts.append(" ".join(t))
    return texts


def _components(texts):
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for t in texts)]
    top = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        common = len(sets[i] & sets[j])
        if top[i] != top[j] and 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
            a, b = sorted((top[i], top[j]))
            top = [a if x == b else x for x in top]
    return top


def test_batches_go_on_until_the_target_recall_and_no_link(spark, monkeypatch):
    """A crowd whose nodes are deep everywhere: more trees follow until every class has the target recall; then it equals brute force."""
    batches = []

    def nodes(classes, joined, trees, scratch, small_nodes=near_dedup.small_nodes):
        found = small_nodes(classes, joined, trees, scratch)
        batches.append((trees, classes.count()))
        return found

    monkeypatch.setattr(near_dedup, "SMALL", 24)
    monkeypatch.setattr(near_dedup, "small_nodes", nodes)
    texts = _crowd(260)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert [got[k] for k in range(len(texts))] == _components(texts)
    assert len(batches) > 1 and batches[0] == (range(near_dedup.FIRST), 260) and batches[1][0] == range(near_dedup.FIRST, near_dedup.FIRST + near_dedup.MORE)


def test_large_leaves_by_brute_force(spark, monkeypatch):
    for name, value in (("SMALL", 4), ("BLOCK", 16), ("DEPTH", 3)):
        monkeypatch.setattr(near_dedup, name, value)
    texts = _crowd(120)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert [got[k] for k in range(len(texts))] == _components(texts)


def test_near_duplicates_of_five_words_and_80_percent(spark):
    words = [f"w{k}" for k in range(104)]  # 100 shingles of five words
    copy = [*words[:93], *(f"x{k}" for k in range(11))]  # one passage differs: 89 of 111 are shared, 0.802; of three words 0.805
    other = [*words[:90], *(f"y{k}" for k in range(14))]  # 86 of 114, 0.754
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate((words, copy, other))], "doc_id long, text string")
    assert [r["kept"] for r in near_dedup.near_duplicates(docs, 5, 80).orderBy("doc_id").collect()] == [True, False, True]
    assert [r["kept"] for r in near_dedup.near_duplicates(docs).orderBy("doc_id").collect()] == [True, True, True]


def test_local_search_grows_with_the_table():
    for k in (1, 10, 100_000):
        histogram = {1026: 6 * k, 516: 6 * k, 514: 6 * k, 508: 12 * k}
        bins = packing.best_fit(histogram, 2048)
        assert bins.count() == 11 * k
        packing.improve(bins, 2048, sum(n * v for n, v in histogram.items()))
        assert bins.count() == 9 * k
        have = Counter()
        for some in bins.by_left.values():
            for content, n in some.items():
                have.update({length: times * n for length, times in content})
        assert have == histogram


def test_local_search_leaves_no_exchange_between_equal_bins():
    for k in range(2, 40):
        histogram = {1026: 6 * k, 516: 6 * k, 514: 6 * k, 508: 12 * k}
        bins = packing.best_fit(histogram, 2048)
        packing.improve(bins, 2048, sum(n * v for n, v in histogram.items()))
        assert bins.count() == 9 * k
