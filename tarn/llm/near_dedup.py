"""MinHash near-duplicates by a chosen-path set similarity join.

A document's set is its distinct shingles of SHINGLE words (A-Z lower-cased; callers may give another length and threshold).
Equal sets are one class. Each class has HASHES minwise values, of which a byte each is kept, and whole values to begin the first trees with.
In each of several independent trees a node is branched by the minwise value that the tree and the node's depth select, until it has at
most SMALL classes with at most WEIGHT shingles; small nodes are compared exhaustively: bytes of the values first, which lose a pair at
the threshold with probability MISS at most, then the full sets, which alone decide. A pair is compared in the first tree that
brings it together, and where several nodes are opened only if its classes are not joined already, as only connectivity is asked for.

Recall: a pair at the threshold is still together at depth d of a tree with probability threshold**d. FIRST trees leave out a pair
whose nodes are small at depth 1 with probability (1 - threshold)**FIRST, 1 in 88,000 at 85 percent. Where documents crowd, nodes are deeper:
each class's own depths give its probability, and classes above 1 - RECALL go through MORE trees at a time until
none is left and a batch finds no link. A node that is still large at DEPTH is compared whole: in blocks with a
pivot first, which joins its dense part, then every pair of blocks that may hold two components is a cell of its own.

What moves: ids and node keys; bytes of classes in nodes that hold more than one; full sets of classes that have a likely partner.
Those are computed anew from the texts, which a bitmap (16 bits for each id that is wanted, BITMAP at most; more false hits as it fills, never
a miss) sorts out where they are read, so texts are not shuffled. Nothing but counts and that bitmap reaches the driver.

Defined cases: null, empty and blank texts have an empty set and are linked with nothing; fewer than
SHINGLE words are one shingle of all words; rows with the same id are one document; a null id is
kept by itself unless its set is that of a document with an id; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial
from math import comb, log

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import drop_all, partitions, stored, table
from tarn.llm.components import components

SHINGLE, PERCENT = 3, 85
HASHES, SMALL, WEIGHT, DEPTH = 96, 2048, 1 << 22, 24
#: How often bytes of signatures may lose a pair at the threshold, by the exact binomial.
MISS = 1e-6
#: Trees of the first and of each further batch; classes whose pairs at the threshold met with a lower probability than RECALL get more.
FIRST, MORE, RECALL = 6, 8, 0.999
#: Partners of a row up to which pairs are looked at one by one.
FEW = 32
#: Classes in a block of a node that stays large.
BLOCK = 1024
#: The most bits of the bitmap of wanted ids (8 MB).
BITMAP = 1 << 26
KEPT_WORDS = 120_000

_MULTIPLY = np.random.default_rng(11).integers(0, 1 << 31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = np.random.default_rng(12).integers(0, 1 << 32, HASHES, np.uint32)


# ---- sets


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


@cache
def _words() -> _Words:
    """One for each worker process."""
    return _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    # bytes.lower() changes A-Z alone, and bytes.split() cuts at exactly space, \t, \n, \v, \f and \r
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = _words()
    if len(known) > KEPT_WORDS:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    out = np.full(n, min(len(h), k), np.uint64)
    for i in range(min(len(h), k)):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def minwise(found: np.ndarray) -> np.ndarray:
    """HASHES minwise values of a set, 32 bits each."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    x = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 4096):
        low = np.minimum(low, (x[at : at + 4096, None] * _MULTIPLY + _ADD).min(axis=0))
    return low


def signature(low: np.ndarray) -> bytes:
    """A byte of each minwise value."""
    return ((low ^ low >> np.uint32(15)) & np.uint32(255)).astype(np.uint8).tobytes()


def alike(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets reach the threshold."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


SET = "doc_id long, n_shingles long, f1 long, f2 long, roots binary, sig binary"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _total(found: np.ndarray) -> int:
    return int(found.sum(dtype=np.uint64).astype(np.int64))


def _signed(batches: Iterator[pd.DataFrame], shingle: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            s = shingles(text, shingle)
            low = minwise(s)
            values = (low[:FIRST].tobytes(), signature(low)) if len(s) else (None, None)
            rows.append((doc_id, len(s), _total(s), _total(_mix(s ^ np.uint64(0x5851F42D4C957F2D))), *values))
        yield pd.DataFrame(rows, columns=_names(SET)).astype({"doc_id": "Int64"})


# ---- trees

NODE = "tree int, key long, rep long, f1 long, component long, n_shingles long"
COLUMNS = _names(NODE)


@cache
def _selected(tree: int) -> list[int]:
    """Which minwise values a tree branches by, depth by depth; the first trees begin with whole values of their own."""
    order = np.random.default_rng((101, tree)).permutation(HASHES).tolist()
    return [tree, *(x for x in order if x != tree)] if tree < FIRST else order


def _roots(classes: DataFrame, joined: DataFrame | None, trees: range) -> DataFrame:
    """NODE rows at depth 1, each class in each tree."""
    value = lambda t: F.substring("roots", 4 * t + 1, 4) if t < FIRST else F.substring("sig", _selected(t)[0] + 1, 1)
    keys = F.array(*[F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), value(t)).alias("key")) for t in trees])
    rows = classes.select("rep", "f1", "n_shingles", keys.alias("keys"))
    rows = _labelled(rows, joined).withColumn("k", F.explode("keys"))
    return rows.select("k.tree", "k.key", *COLUMNS[2:])


def _labelled(rows: DataFrame, joined: DataFrame | None) -> DataFrame:
    """rows (rep, ..) with the component of each, its own id where it is joined with nothing."""
    if joined is None:
        return rows.withColumn("component", F.col("rep"))
    return rows.join(joined.hint("merge"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _opened(rows: DataFrame) -> DataFrame:
    """rows with n and weight of their node, and whether it holds several components."""
    nodes = rows.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight"), (F.min("component") < F.max("component")).alias("several"))
    return rows.join(nodes.hint("merge"), ["tree", "key"])


def _deeper(rows: DataFrame, trees: range, depth: int) -> DataFrame:
    """rows (tree, key, .., sig) with the keys they have at a depth above 1."""
    places = F.array(*[F.lit(_selected(t)[depth - 1] + 1) for t in trees])
    value = F.substr("sig", F.get(places, F.col("tree") - trees.start), F.lit(1))
    return rows.withColumn("key", F.xxhash64("key", value))


def small_nodes(classes: DataFrame, joined: DataFrame | None, trees: range, scratch: list[str]) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """NODE rows of all small nodes with several components; the rows of nodes that are still large at DEPTH (or None);
    (rep, f1, depth) of every class and tree that went below depth 1 (or None).

    joined: (rep, component), None for none.
    """
    small = ((F.col("n") <= SMALL) & (F.col("weight") <= WEIGHT)) | (F.col("n") <= 2)
    rows = stored(_opened(_roots(classes, joined, trees)).where("several").drop("several"), "nodes", scratch)
    found = rows.where(small).select(COLUMNS)
    rows = rows.where(~small).select(COLUMNS)
    if rows.isEmpty():
        return found, None, None
    rows = rows.join(classes.select("rep", "f1", "sig").hint("merge"), ["rep", "f1"])
    depths = None
    for depth in range(2, DEPTH + 1):
        rows = stored(_opened(_deeper(rows, trees, depth).select(*COLUMNS, "sig")), "nodes", scratch)
        found = found.unionByName(rows.where("several").where(small).select(COLUMNS))
        ended = rows.where(small | ~F.col("several") | F.lit(depth == DEPTH)).select("rep", "f1", F.lit(depth).alias("depth"))
        depths = ended if depths is None else depths.unionByName(ended)
        rows = rows.where("several").where(~small)
        if rows.isEmpty():
            return found, None, depths
        rows = rows if depth == DEPTH else rows.select(*COLUMNS, "sig")
    return found, rows.select(*COLUMNS, "n", "weight"), depths


def _blocks() -> F.Column:
    """How many blocks a large node of n classes has."""
    return F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("weight") / WEIGHT)).cast("long")


def with_pivot(leaves: DataFrame) -> DataFrame:
    """The rows of large leaves in blocks, each with its leaf's least class among them."""
    rows = leaves.withColumn("block", F.pmod(F.xxhash64("rep", "f1"), _blocks()))
    pivots = leaves.groupBy("tree", "key").agg(F.min(F.struct(*COLUMNS[2:])).alias("p"))
    blocks = rows.select("tree", "key", "block").distinct()
    pivots = blocks.join(pivots.hint("merge"), ["tree", "key"]).select("tree", "key", "p.*", "block")
    rows = rows.select(*COLUMNS, "block").unionByName(pivots)
    return rows.withColumn("key", F.xxhash64("key", "block")).select(COLUMNS)


def block_pairs(leaves: DataFrame, scratch: list[str]) -> DataFrame:
    """The rows of large leaves as cells in which any two rows of a leaf with different components meet."""
    counts = leaves.groupBy("tree", "key", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n_shingles").alias("w"))
    rows = leaves.join(counts.hint("merge"), ["tree", "key", "component"])
    own = F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("w") / WEIGHT)).cast("long")
    within = F.xxhash64("component", F.pmod(F.xxhash64("rep"), own))
    mixed = F.pmod(F.xxhash64("component"), _blocks())
    rows = stored(rows.select(*COLUMNS, F.when(own > 1, within).otherwise(mixed).alias("block"), F.when(own > 1, F.col("component")).alias("one")), "blocks", scratch)
    blocks = rows.select("tree", "key", "block", "one").distinct()
    a, b = (blocks.select("tree", "key", F.col("block").alias(f"block{x}"), F.col("one").alias(f"one{x}")) for x in "ab")
    pairs = a.join(b.hint("merge"), ["tree", "key"]).where("blocka <= blockb AND NOT coalesce(onea = oneb, false)")
    cells = pairs.select("tree", "key", F.explode(F.array_distinct(F.array("blocka", "blockb"))).alias("block"), F.xxhash64("key", "blocka", "blockb").alias("cell"))
    return rows.join(cells.hint("merge"), ["tree", "key", "block"]).withColumn("key", F.col("cell")).select(COLUMNS)


# ---- nodes

#: NODE, then the bytes, and the keys of all nodes of the class in this batch, by tree (0: none).
OPEN = f"{NODE}, sig binary, keys array<long>"


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a partition that is sorted by (tree, key), nodes whole."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        tree, key = batch.column("tree").to_numpy(), batch.column("key").to_numpy()
        cuts = np.flatnonzero((tree[1:] != tree[:-1]) | (key[1:] != key[:-1])) + 1
        if rest and (rest[-1].column("tree")[-1].as_py(), rest[-1].column("key")[-1].as_py()) != (tree[0], key[0]):
            cuts = np.append(cuts, 0)
        if len(cuts):
            end = int(cuts.max())
            if whole := [x for x in [*rest, batch.slice(0, end)] if len(x)]:
                yield pa.Table.from_batches(whole)
            rest = [batch.slice(end)]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)


@cache
def least_equal(percent: int = PERCENT) -> int:
    """The most equal values that may be asked for, so that a pair at the threshold has fewer with probability MISS at most."""
    p = percent / 100
    agreeing = [comb(HASHES, x) * p**x * (1 - p) ** (HASHES - x) for x in range(HASHES + 1)]
    return int(np.searchsorted(np.cumsum(agreeing), MISS, "right"))


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes are equal, row by row."""
    lanes = np.ascontiguousarray(a == b).view(np.uint64).sum(axis=1, dtype=np.uint64)
    return (lanes * np.uint64(0x0101010101010101) >> np.uint64(56)).astype(np.int64)


def likely(rows: pa.Table, start: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, in order, of pairs in one node whose bytes agree enough, and which are neither of one component nor together in an earlier tree.

    rows: OPEN, nodes whole and sorted by n_shingles; start: the batch's first tree.
    """
    n, least = len(rows), least_equal(percent)
    tree, key, sizes, comps = (rows.column(c).to_numpy() for c in ("tree", "key", "n_shingles", "component"))
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(n, HASHES)
    keys = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(n, -1)
    first = np.flatnonzero(np.append(True, (tree[1:] != tree[:-1]) | (key[1:] != key[:-1])))
    ends = np.append(first[1:], n)
    # partners stand behind a row, up to the size that could still reach the threshold
    limit = np.arange(1, n + 1)
    for begin, end in zip(first.tolist(), ends.tolist(), strict=True):
        if end - begin > 1:
            limit[begin:end] = begin + np.searchsorted(sizes[begin:end] * percent, sizes[begin:end] * 100, "right")
    partners = limit - np.arange(1, n + 1)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        for good in (lambda: comps[i] != comps[j], lambda: _agree(sig[i], sig[j]) >= least, lambda: ~_met(i, j)):
            ok = good()
            i, j = i[ok], j[ok]
        found.append((i, j))

    def _met(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        earlier = np.arange(keys.shape[1]) < (tree[i] - start)[:, None]
        return ((keys[i] == keys[j]) & (keys[i] != 0) & earlier).any(axis=1)

    few = partners <= FEW
    for lag in range(1, FEW + 1):
        i = np.flatnonzero(few & (partners >= lag))
        if not len(i):
            break
        keep(i, i + lag)
    for a in np.flatnonzero(~few).tolist():
        j = np.arange(a + 1, limit[a])
        j = j[_agree(sig[a], sig[a + 1 : limit[a]]) >= least]
        keep(np.full(len(j), a), j)
    i, j = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    order = np.lexsort((j, i))
    return i[order], j[order]


def _candidates(batches: Iterator[pa.RecordBatch], start: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The rows of each node that have a likely partner there."""
    for rows in _whole(batches):
        i, j = likely(rows, start, percent)
        if len(i):
            yield from rows.take(np.unique(np.concatenate([i, j]))).combine_chunks().to_batches()


class _Overlaps:
    """How many shingles a row's set shares with other sets of the same rows, all counted at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        names, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(names), bool)

    def own(self, a: int) -> np.ndarray:
        return self.ids[self.starts[a] : self.ends[a]]

    def of(self, a: int, others: np.ndarray) -> np.ndarray:
        self.mark[self.own(a)] = True
        if 4 * len(others) > len(self.sizes):
            shared = np.add.reduceat(self.mark[self.ids], self.starts, dtype=np.int64)[others]
        else:
            sizes = self.sizes[others]
            shared = np.add.reduceat(self.mark[np.concatenate([self.own(b) for b in others])], np.cumsum(sizes) - sizes, dtype=np.int64)
        self.mark[self.own(a)] = False
        return shared


def _links(batches: Iterator[pa.RecordBatch], start: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links between components, each confirmed on full sets."""
    u, v = [], []
    for rows in _whole(batches):
        i, j = likely(rows, start, percent)
        if not len(i):
            continue
        tree, key = rows.column("tree").to_numpy(), rows.column("key").to_numpy()
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in rows.column("hashes")]
        label = rows.column("component").to_numpy().copy()
        node = np.cumsum(np.append(False, (tree[1:] != tree[:-1]) | (key[1:] != key[:-1])))
        overlaps, within, begin = None, -1, 0
        begins = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        for a, partners in zip(i[begins].tolist(), np.split(j, begins[1:]), strict=True):
            partners = partners[label[partners] != label[a]]
            if len(partners) > FEW:
                if within != node[a]:  # the sets of one node at a time
                    within, (begin, end) = node[a], np.searchsorted(node, [node[a], node[a] + 1])
                    overlaps = _Overlaps(sets[begin:end])
                shared = overlaps.of(a - begin, partners - begin)
                both = len(sets[a]) + overlaps.sizes[partners - begin] - shared
                linked = partners[100 * shared >= percent * both]
            else:
                linked = (b for b in partners.tolist() if label[b] != label[a] and alike(sets[a], sets[b], percent))
            for b in linked:
                if label[a] != label[b]:
                    u.append(label[a])
                    v.append(label[b])
                    label[label == label[b]] = label[a]
    yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "tree", "key").sortWithinPartitions("tree", "key", "n_shingles", "rep", "f1")


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A bit for each id's hash: at most BITMAP / 64 rows reach the driver, whatever the number of ids."""
    bits = 1 << 16
    wanted = ids.count()
    while bits < min(16 * wanted, BITMAP):
        bits *= 2
    place = F.pmod(F.xxhash64("rep"), F.lit(bits))
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(rep), {bits}) % 64 as int))")
    words = ids.groupBy((place / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


SETS = "id long, sf1 long, hashes binary"


def full_sets(docs: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """SETS of the documents whose id may be in wanted (rep): all that are, and a few more."""
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted))
    places = 64 * len(bits.value)

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()  # repeated rows give one set
        for batch in batches:
            place = batch["place"].to_numpy(np.int64) % places
            hit = (bits.value[place // 64] >> (place % 64)) & 1
            batch = batch[hit == 1]
            for at in range(0, len(batch), 500):
                rows = []
                for doc_id, text in zip(batch["id"].iloc[at : at + 500], batch["text"].iloc[at : at + 500], strict=True):
                    s = shingles(text, shingle)
                    name = (doc_id, _total(s))
                    if len(s) and name not in seen:
                        seen.add(name)
                        rows.append((*name, s.tobytes()))
                yield pd.DataFrame(rows, columns=_names(SETS))

    place = F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP)).alias("place")
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), "text", place).mapInPandas(sets, SETS)


def _compare(nodes: DataFrame, classes: DataFrame, docs: DataFrame, trees: range, shingle: int, percent: int, scratch: list[str]) -> DataFrame:
    """Links (u, v) between the components of the classes in nodes (NODE)."""
    keys = [F.coalesce(F.max(F.when(F.col("tree") == t, F.col("key"))), F.lit(0).cast("long")).alias(f"k{t}") for t in trees]
    own = nodes.groupBy("rep", "f1").agg(*keys)
    own = classes.select("rep", "f1", "sig").join(own.hint("merge"), ["rep", "f1"]).select("rep", "f1", "sig", F.array(*[f"k{t}" for t in trees]).alias("keys"))
    opened = nodes.join(own.hint("merge"), ["rep", "f1"]).select(_names(OPEN))
    near = stored(_dealt(opened).mapInArrow(partial(_candidates, start=trees.start, percent=percent), OPEN), "likely", scratch)
    sets = full_sets(docs, near.select("rep").distinct(), shingle)
    with_sets = near.join(sets.hint("merge"), (near["rep"] == sets["id"]) & (near["f1"] == sets["sf1"])).select(*_names(OPEN), "hashes")
    return stored(_dealt(with_sets).mapInArrow(partial(_links, start=trees.start, percent=percent), "u long, v long"), "links", scratch)


def _joined(joined: DataFrame | None, links: DataFrame, scratch: list[str], kept: list[str]) -> DataFrame:
    """(rep, component) of all that is joined once links between components count as well; kept: gets its path."""
    found = components(links, scratch)
    if joined is None:
        now = found.select(F.col("vertex").alias("rep"), "component")
    else:
        found = stored(found, "found", scratch)
        old = joined.join(found.withColumnRenamed("component", "now").hint("merge"), joined["component"] == F.col("vertex"), "left")
        new = found.join(joined.hint("merge"), found["vertex"] == joined["rep"], "left_anti")
        now = old.select("rep", F.coalesce("now", "component").alias("component")).unionByName(new.select(F.col("vertex").alias("rep"), "component"))
    return stored(now, "joined", kept)


def linked(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, scratch: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The fingerprints of docs (doc_id, n_shingles, f1, f2); all classes (rep, n_shingles, f1, f2, ..), rep the least id; and (rep, component) of those that are joined.

    scratch: gets the paths of what these read.
    """
    scratch = [] if scratch is None else scratch
    docs = docs.select("doc_id", "text")
    signed = stored(docs.mapInPandas(partial(_signed, shingle=shingle), SET), "sets", scratch)
    some = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # rows with one id and several texts are one vertex: each of their sets is compared
    classes = some.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("roots").alias("roots"), F.first("sig").alias("sig"))
    classes = stored(classes, "classes", scratch)
    p = percent / 100
    joined, trees, everyone = None, range(FIRST), classes
    deep, old = None, []  # the depths below 1 of all batches; the paths of joined
    while True:
        own: list[str] = []
        nodes, leaves, depths = small_nodes(everyone, joined, trees, own)
        if leaves is not None:
            leaves = stored(leaves, "leaves", own)
            nodes = nodes.unionByName(with_pivot(leaves))
        any_links = False
        for step in range(1 if leaves is None else 2):
            if step:  # what large leaves still hold apart
                again = _labelled(leaves.drop("component"), joined).select(*COLUMNS)
                nodes = block_pairs(_opened(again).where("several").drop("several"), own)
            links = _compare(nodes, classes, docs, trees, shingle, percent, own)
            if not links.isEmpty():
                any_links = True
                before, old = old, []
                joined = _joined(joined, links, own, old)
                own += before
        if depths is not None:
            excess = F.log(F.lit(1.0) - F.pow(F.lit(p), F.col("depth"))) - log(1 - p)
            sums = depths.groupBy("rep", "f1").agg(F.sum(excess).alias("excess"))
            deep = stored(sums if deep is None else deep.unionByName(sums).groupBy("rep", "f1").agg(F.sum("excess").alias("excess")), "depths", scratch)
        drop_all(docs.sparkSession, own)
        if deep is None:
            break
        # classes whose pairs at the threshold may have been missed more often than 1 - RECALL; all that were open, while links are found
        missed = F.col("excess") + trees.stop * log(1 - p) > log(1 - RECALL)
        open_ = deep.where(missed) if not trees.start or not any_links else deep.join(everyone.select("rep", "f1"), ["rep", "f1"], "left_semi")
        everyone = stored(classes.join(open_.select("rep", "f1").hint("merge"), ["rep", "f1"]).select(classes.columns), "open", scratch)
        if everyone.isEmpty():
            break
        trees = range(trees.stop, trees.stop + MORE)
    scratch += old
    return signed, classes, joined


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    signed, classes, joined = linked(docs, shingle, percent)
    found = _labelled(classes.select("n_shingles", "f1", "f2", "rep"), joined).select("n_shingles", "f1", "f2", F.col("component").alias("component_id"))
    rows = signed.select("doc_id", "n_shingles", "f1", "f2").join(found.hint("merge"), ["n_shingles", "f1", "f2"], "left")
    component = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS shingle
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
), sides AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN sides e ON r.other = e.a
), c AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""
