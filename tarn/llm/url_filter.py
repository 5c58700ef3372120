"""URL filters: explicit rules first, then gradient-boosted trees on lexical features.

Everything on the main path is a DataFrame or SQL function. A URL that a rule fits gets the rule's
verdict and is also a labelled example; all others get the verdict of boosted trees that are
trained from the labelled ones. Features: length, host length, labels of the host, depth, digit
ratio, character entropy, number of parameters, and two suffix statistics (smoothed log-odds of
`block` for the URL's last host label and for its last two).

Training: every labelled URL takes part. Features are binned (BINS values each), equal feature
rows are added up to one weighted row before anything is shuffled, and each level of each tree is
one aggregation of gradients by (node, feature, bin); the driver sees only those sums, at most
2**DEPTH * features * BINS rows, and turns the chosen splits into CASE expressions.

Defined cases: a null url, or one without `://`, has an empty host and path, fits no rule and goes
to the trees; without labelled URLs the method allows everything; repeated rows are judged alike;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import drop_path, shared_path

#: Fixed values: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
FEATURES = ("f_length", "f_host", "f_labels", "f_depth", "f_digits", "f_entropy", "f_params", "f_suffix1", "f_suffix2")
BINS, DEPTH, ROUNDS, SHRINK, LAMBDA, LEAST_GAIN = 16, 3, 6, 0.4, 1.0, 1e-6


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path and what follows the path."""
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(after, r"(?s)^[^/?#]*[^?#]*(.*)$", 1)
    return tuple(F.coalesce(x, F.lit("")) for x in (host, path, rest))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null: none) and its verdict."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # a later, longer one replaces
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _bin(x: Column) -> Column:
    return F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(BINS - 1)).cast("int")


def lexical(df: DataFrame) -> DataFrame:
    """Adds the binned lexical features of url, host, path and rest, and the suffixes s1 and s2."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    chars = F.array_distinct(F.split(F.regexp_replace(url, r"[^\x21-\x7e]", "~"), ""))
    count = lambda c: F.length(url) - F.length(F.replace(url, c, F.lit("")))
    share = lambda c: F.greatest(count(c), F.lit(1)) / n
    entropy = F.aggregate(F.transform(F.filter(chars, lambda c: c != ""), lambda c: -share(c) * F.log2(share(c))), F.lit(0.0), lambda a, b: a + b)
    return df.withColumns(
        {
            "f_length": _bin(F.length(url) / 8),
            "f_host": _bin(F.length("host") / 3),
            "f_labels": _bin(F.size(F.split("host", r"\."))),
            "f_depth": _bin(F.size(F.filter(F.split("path", "/"), lambda x: x != ""))),
            "f_digits": _bin((F.length(url) - F.length(F.regexp_replace(url, "[0-9]", ""))) / n * 32),
            "f_entropy": _bin((entropy - 2) * 5),
            "f_params": _bin(F.when(F.col("rest") == "", 0).otherwise(F.size(F.split("rest", "[?&#]")) - 1 + F.size(F.split("rest", "=")) - 1)),
            "s1": F.substring_index("host", ".", -1),
            "s2": F.substring_index("host", ".", -2),
        }
    )


def suffix_statistics(labelled: DataFrame, suffix: str) -> DataFrame:
    """(suffix, its bin): the binned log-odds of block, smoothed by one of each."""
    counts = labelled.groupBy(suffix).agg(F.sum("blocked").alias("b"), F.count(F.lit(1)).alias("n"))
    return counts.select(F.col(suffix), _bin(F.log((F.col("b") + 1) / (F.col("n") - F.col("b") + 1)) + BINS // 2).alias(f"f_suffix{suffix[1:]}"))


def with_suffixes(df: DataFrame, s1: DataFrame, s2: DataFrame) -> DataFrame:
    """Joined on the suffix; Spark broadcasts the statistics only where their size allows it."""
    out = df.join(s1, "s1", "left").join(s2, "s2", "left")
    unknown = F.lit(BINS // 2)
    return out.withColumns({f: F.coalesce(F.col(f), unknown).cast("int") for f in ("f_suffix1", "f_suffix2")})


def _tree_sql(tree: dict, node: int = 1) -> str:
    """The nested CASE expression of a tree: node -> (feature, bin) for splits, float for leaves."""
    here = tree[node]
    if isinstance(here, float):
        return f"{here!r}D"
    return f"CASE WHEN {here[0]} <= {here[1]} THEN {_tree_sql(tree, 2 * node)} ELSE {_tree_sql(tree, 2 * node + 1)} END"


def _node_sql(tree: dict, node: int = 1) -> str:
    """The expression that gives the number of the node a row has reached."""
    here = tree.get(node)
    if here is None or isinstance(here, float):
        return str(node)
    return f"CASE WHEN {here[0]} <= {here[1]} THEN {_node_sql(tree, 2 * node)} ELSE {_node_sql(tree, 2 * node + 1)} END"


def _split(rows: list, node: int) -> tuple:
    """The best split of a node from its (feature, bin, g, h) sums, or the leaf's value."""
    mine = [r for r in rows if r["node"] == node]
    g_all, h_all = (sum(r[k] for r in mine if r["feature"] == FEATURES[0]) for k in "gh")
    score = lambda g, h: g * g / (h + LAMBDA)
    best = (LEAST_GAIN, None)
    for f in FEATURES:
        g = h = 0.0
        for r in sorted((r for r in mine if r["feature"] == f), key=lambda r: r["bin"])[:-1]:
            g, h = g + r["g"], h + r["h"]
            gain = score(g, h) + score(g_all - g, h_all - h) - score(g_all, h_all)
            if gain > best[0] + 1e-9:
                best = (gain, (f, int(r["bin"])))
    return best[1], float(SHRINK * g_all / (h_all + LAMBDA))


def boost(examples: DataFrame) -> str:
    """The margin of `block` as a SQL expression over FEATURES. examples: FEATURES, n, blocked (sums per row)."""
    stack = ", ".join(f"'{f}', {f}" for f in FEATURES)
    margin = "0D"
    for _ in range(ROUNDS):
        tree: dict = {}
        open_nodes = [1]
        for depth in range(DEPTH + 1):
            p = f"(1D / (1D + exp(-({margin}))))"
            sums = (
                examples.select(*FEATURES, F.expr(f"{_node_sql(tree)}").alias("node"), F.expr(f"blocked - n * {p}").alias("g"), F.expr(f"n * {p} * (1D - {p})").alias("h"))
                .where(F.col("node").isin(open_nodes))
                .selectExpr("node", "g", "h", f"stack({len(FEATURES)}, {stack}) AS (feature, bin)")
                .groupBy("node", "feature", "bin")
                .agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
                .collect()
            )
            nodes, open_nodes = open_nodes, []
            for node in nodes:
                split, leaf = _split(sums, node)
                if split is None or depth == DEPTH:
                    tree[node] = round(leaf, 9)
                else:
                    tree[node] = split
                    open_nodes += [2 * node, 2 * node + 1]
            if not open_nodes:
                break
        margin = f"{margin} + {_tree_sql(tree)}"
        if set(tree) == {1}:
            break
    return margin


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages (page_id, url) -> page_id, url, host, path, rule, verdict, margin (null where a rule decides)."""
    spark = pages.sparkSession
    base = pages.select("page_id", "url")
    host, path, rest = parts(F.col("url"))
    base = base.withColumns({"host": host, "path": path, "rest": rest})
    rule, by_rule = fitting_rule(F.col("host"), F.col("path"), rules)
    base = lexical(base.withColumns({"rule": rule, "by_rule": by_rule}))
    labelled = base.where(F.col("by_rule").isNotNull()).withColumn("blocked", (F.col("by_rule") == "block").cast("long"))
    paths = [shared_path(spark, f"url-{k}") for k in ("s1", "s2", "examples")]
    for suffix, at in zip(("s1", "s2"), paths, strict=False):
        suffix_statistics(labelled, suffix).write.parquet(at)
    s1, s2 = (spark.read.parquet(at) for at in paths[:2])
    examples = with_suffixes(labelled, s1, s2).groupBy(*FEATURES).agg(F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("blocked"))
    examples.write.parquet(paths[2])
    margin = boost(spark.read.parquet(paths[2]))
    drop_path(spark, paths[2])
    judged = with_suffixes(base, s1, s2).withColumn("margin", F.when(F.col("by_rule").isNull(), F.expr(margin)))
    verdict = F.coalesce(F.col("by_rule"), F.when(F.col("margin") > 0, "block").otherwise("allow"))
    return judged.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"), "margin")


def op4_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")

