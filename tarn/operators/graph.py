"""The reference graph: edges, closure, delta, order, cycles and DOT text.

nodes: (id, kind, size); edges: (parent_id, child_id). A closure is found breadth first: each
round joins the frontier with the edges, drops what was met before, and writes the new frontier to
the shared folder. Rounds are as many as the graph is deep; a diamond costs nothing extra, which is
why this is not a recursive query (that would follow every path).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.hashing import KINDS
from tarn.functions.ids import kind_rank
from tarn.operators.shared import stored

#: Rank of each kind when objects are sent: specs, then content, then packages.
YIELD_RANK = {"spec": 0, "blob": 1, "tree": 1, "pkg": 2}


class MissingObjects(ValueError):
    """Edges or roots name objects that are not there."""


class CycleFound(ValueError):
    """An object refers to itself, directly or through others."""


@dataclass
class Closure:
    nodes: DataFrame  # id, kind, size
    edges: DataFrame  # parent_id, child_id, both in nodes

    def num_objects(self) -> int:
        return self.nodes.count()

    def unpacked_size(self) -> int:
        return self.nodes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]

    def ordered(self) -> DataFrame:
        """Nodes by id, kind and size."""
        return self.nodes.orderBy("id", kind_rank(F.col("kind")), "size")


@dataclass
class Delta:
    num_present: int
    present: DataFrame  # id, kind, size: met, and already at the destination
    missing: Closure


def object_edges(trees: DataFrame | None = None, packages: DataFrame | None = None, specs: DataFrame | None = None, dependency_kind: str = "pkg") -> DataFrame:
    """(parent_id, parent_kind, child_id, child_kind) of trees (id, entries), packages and specs.

    Links of a tree are no edges. dependency_kind says what a spec's dependencies are.
    """
    parts = []
    if trees is not None:
        one = trees.select(F.col("id").alias("parent_id"), F.explode(F.map_values("entries")).alias("e")).where("e.type <> 'Symlink'")
        parts.append(one.select("parent_id", F.lit("tree").alias("parent_kind"), F.col("e.id").alias("child_id"), F.lower("e.type").alias("child_kind")))
    if packages is not None:
        of = packages.select(F.col("id").alias("parent_id"), F.lit("pkg").alias("parent_kind"), F.explode(F.concat(
            F.transform("references", lambda r: F.struct(r.alias("id"), F.lit("pkg").alias("kind"))),
            F.array(F.struct(F.col("tree").alias("id"), F.lit("tree").alias("kind"))),
        )).alias("c"))
        parts.append(of.select("parent_id", "parent_kind", F.col("c.id").alias("child_id"), F.col("c.kind").alias("child_kind")))
    if specs is not None:
        of = specs.select(F.col("id").alias("parent_id"), F.explode(F.array_union("dependencies", "build_dependencies")).alias("child_id"))
        parts.append(of.select("parent_id", F.lit("spec").alias("parent_kind"), "child_id", F.lit(dependency_kind).alias("child_kind")))
    return reduce(DataFrame.unionByName, parts)


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _walk(roots: DataFrame, nodes: DataFrame, edges: DataFrame, enter: Column | Callable[[DataFrame], DataFrame] | None) -> tuple[list[DataFrame], list[DataFrame]]:
    """Rounds of entered and of refused nodes. Every id that is met must be in nodes."""
    nodes, edges = nodes.select("id", "kind", "size"), edges.select("parent_id", "child_id")
    entered: list[DataFrame] = []
    refused: list[DataFrame] = []
    ids = roots.select("id").distinct()
    while True:
        met = stored(ids.join(nodes, "id", "left"), "frontier")
        count, known = met.agg(F.count(F.lit(1)), F.count("kind")).first()
        if known < count:
            lost = [r["id"] for r in met.where("kind IS NULL").select("id").orderBy("id").limit(5).collect()]
            raise MissingObjects(f"no such objects: {', '.join(map(str, lost))}")
        if enter is None:
            now = met
        else:
            now = stored(enter(met) if callable(enter) else met.where(enter), "entered")
            refused.append(met.join(now.select("id"), "id", "left_anti"))
            count = now.count()
        if not count:
            return entered, refused
        entered.append(now)
        seen = _all([x.select("id") for x in [*entered, *refused]])
        ids = edges.join(now.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select(F.col("child_id").alias("id")).distinct().join(seen, "id", "left_anti")


def closure(roots: DataFrame, nodes: DataFrame, edges: DataFrame, enter=None) -> Closure:
    """Everything that roots (id) reach. enter: a condition, or a function from rows to rows, over (id, kind, size).

    A node that is refused is left out and not followed; what lies behind it can still be reached
    another way. Each node is asked about once.
    """
    entered, _ = _walk(roots, nodes, edges, enter)
    found = _all(entered) if entered else nodes.select("id", "kind", "size").limit(0)
    ids = found.select("id")
    inside = edges.select("parent_id", "child_id")
    for side in ("parent_id", "child_id"):
        inside = inside.join(ids.withColumnRenamed("id", side), side, "left_semi")
    return Closure(found, inside.select("parent_id", "child_id").distinct())


def delta(roots: DataFrame, nodes: DataFrame, edges: DataFrame, there: DataFrame, deep: bool = False) -> Delta:
    """What a destination that has `there` (id, kind) lacks of the closure of roots.

    An object that is there is taken to have all it refers to there as well, so it is not followed;
    with deep it is.
    """
    have = there.select("id", "kind").distinct()
    if deep:
        whole = closure(roots, nodes, edges)
        present = whole.nodes.join(have, ["id", "kind"], "left_semi")
        lacking = whole.nodes.join(have, ["id", "kind"], "left_anti")
    else:
        entered, refused = _walk(roots, nodes, edges, lambda met: met.join(have, ["id", "kind"], "left_anti").select(met.columns))
        empty = nodes.select("id", "kind", "size").limit(0)
        lacking, present = _all(entered) if entered else empty, _all(refused) if refused else empty
    lacking = stored(lacking, "lacking")
    inside = edges.select("parent_id", "child_id")
    for side in ("parent_id", "child_id"):
        inside = inside.join(lacking.select(F.col("id").alias(side)), side, "left_semi")
    return Delta(present.count(), present, Closure(lacking, inside.select("parent_id", "child_id").distinct()))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, level: 0 without children, else one more than the highest child's. Raises CycleFound.

    Round k holds the nodes with a path of k edges below them: the parents of the round before. A node's level is
    the last round it is in. A round that equals the one before holds nothing but what lies on cycles or above them.
    """
    edges = edges.select("parent_id", "child_id").where("parent_id IS NOT NULL")
    everyone = nodes.select("id").distinct()
    rounds = [everyone.withColumn("level", F.lit(0))]
    up, before = edges, None
    while True:
        now = up.select(F.col("parent_id").alias("id")).distinct().join(everyone, "id", "left_semi").withColumn("level", F.lit(len(rounds)))
        now = stored(now, "round")
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("id") % (1 << 40))).first()
        if not sign[0]:
            return _all(rounds).groupBy("id").agg(F.max("level").alias("level"))
        if sign == before and (found := on_cycle(edges.join(now.select(F.col("id").alias("parent_id")), "parent_id", "left_semi"))) is not None:
            raise CycleFound(f"a cycle goes through {found}")
        before = sign
        rounds.append(now)
        up = edges.join(now.select(F.col("id").alias("child_id")), "child_id", "left_semi")


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """The ids that lie on cycles or between them: ends of paths are trimmed in both directions until none is left."""
    left = stored(edges.select("parent_id", "child_id").distinct(), "cycle")
    n = left.count()
    while True:
        inner = left.join(left.select(F.col("parent_id").alias("child_id")).distinct(), "child_id", "left_semi")
        inner = inner.join(left.select(F.col("child_id").alias("parent_id")).distinct(), "parent_id", "left_semi")
        left = stored(inner.select("parent_id", "child_id"), "cycle")
        if (m := left.count()) == n:
            return left.select(F.col("parent_id").alias("id")).distinct()
        n = m


def on_cycle(edges: DataFrame) -> str:
    """The least id that lies on a cycle or between cycles."""
    return cycle_nodes(edges).agg(F.min("id")).first()[0]


def topological(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with their level, what is referred to before what refers to it."""
    return nodes.join(levels(nodes, edges), "id").orderBy("level", "id", kind_rank(F.col("kind")))


def yield_rank(kind: Column) -> Column:
    return reduce(lambda rest, k: F.when(kind == k, F.lit(YIELD_RANK[k])).otherwise(rest), KINDS, F.lit(None).cast("int"))


def yield_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes in the order in which they are sent: specs, then blobs and trees, then packages, each in topological order."""
    ranked = nodes.join(levels(nodes, edges), "id").withColumn("group_rank", yield_rank(F.col("kind")))
    return ranked.orderBy("group_rank", "level", "id", kind_rank(F.col("kind")))


def dot_lines(nodes: DataFrame, edges: DataFrame, show_content: bool = False) -> DataFrame:
    """id, seq, line: the body of a DOT graph. Arrows point from what is referred to to what refers to it."""
    shown = nodes.select("id", "kind")
    if not show_content:
        shown = shown.where(~F.col("kind").isin("blob", "tree"))
    boxes = shown.select("id", F.lit("").alias("seq"), F.format_string('  "%s" [shape = box]', "id").alias("line"))
    arrows = edges.where("parent_id <> child_id").select("parent_id", "child_id").distinct()
    for side in ("parent_id", "child_id"):
        arrows = arrows.join(shown.select(F.col("id").alias(side)), side, "left_semi")
    arrows = arrows.select(F.col("parent_id").alias("id"), F.col("child_id").alias("seq"), F.format_string('  "%s" -> "%s"', "child_id", "parent_id").alias("line"))
    return boxes.unionByName(arrows)


def render_dot(found: Closure, show_content: bool = False) -> str:
    """The DOT text of a closure. It is one string, so it is for graphs that a reader can look at."""
    lines = dot_lines(found.nodes, found.edges, show_content).orderBy("id", "seq")
    return "\n".join(["digraph G {", *(r["line"] for r in lines.toLocalIterator()), "}"])
