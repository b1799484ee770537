"""Mixing sources to target weights by hierarchical budgets.

A token budget goes down a tree (domain, language, source). At each node it is
shared among the children by weight; what a child cannot use, at so many epochs
at most, goes to its siblings, and only what they cannot use either is missing
above. Each leaf takes whole epochs of its documents and, of one more epoch in
seeded order, the prefix of tokens that fills its budget.

DataFrame operations only. All amounts are integers, so that any engine gets the
same result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

LEVELS = ("domain", "lang", "source")
#: Leaves up to which their table is broadcast; beyond, Spark joins by shuffle.
BROADCAST_LEAVES = 100_000
#: Hex digits of an order's hash that number the buckets of a leaf, and the parts of its
#: cut bucket, and so on: LEVELS_DOWN times.
BUCKET_DIGITS = 3
LEVELS_DOWN = 3


@dataclass(frozen=True)
class Mix:
    """weights: for each level the names' integer weights; others weigh 1 and those of
    weight 0 give nothing. The budget is share[0]/share[1] of all tokens."""

    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    share: tuple[int, int] = (1, 2)
    max_epochs: int = 4
    seed: int = 42

    def __post_init__(self):
        if any(w < 0 for names in self.weights.values() for w in names.values()):
            raise ValueError("a weight is a whole number of at least 0")


def word_count(text: Column) -> Column:
    """Words parted by ASCII white space; 0 for null."""
    spaced = F.translate(text, "\t\n\x0b\x0c\r", " " * 5)
    return F.coalesce(F.size(F.array_remove(F.split(spaced, " "), "")).cast("long"), F.lit(0).cast("long"))


def weight(level: str, mix: Mix) -> Column:
    out = F.lit(1).cast("long")
    for name, w in sorted(mix.weights.get(level, {}).items()):
        out = F.when(F.col(level) == name, F.lit(w).cast("long")).otherwise(out)
    return out


def share_out(nodes: DataFrame, parent: list[str], level: str, mix: Mix) -> DataFrame:
    """nodes (path, available) with `budget` of their parent: adds `got`, the node's
    share. Water-filling: in order of capacity per weight, a child is full if its
    capacity is no more than its share of what those before it left; the rest
    divide the remainder by weight, rounded along the names so that it adds up."""
    of = [F.lit(0), *parent]
    by = Window.partitionBy(*of).orderBy(F.col("capacity") / F.col("weight"), level)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rest = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = (
        nodes.withColumn("weight", weight(level, mix)).withColumn("capacity", F.col("available") * mix.max_epochs)
        .withColumn("c_before", F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("w_rest", F.sum("weight").over(rest))
        .withColumn("full", F.col("capacity") * F.col("w_rest") <= (F.col("budget") - F.col("c_before")) * F.col("weight"))
    )
    group = Window.partitionBy(*of)
    names = group.orderBy(level).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_weight = F.when(F.col("full"), 0).otherwise(F.col("weight"))
    return (
        filled.withColumn("left", F.col("budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(group))
        .withColumn("w_open", F.sum(open_weight).over(group)).withColumn("w_to", F.sum(open_weight).over(names))
        .withColumn("got", F.when(F.col("full"), F.col("capacity")).otherwise(F.expr("(left * w_to) div greatest(w_open, 1) - (left * (w_to - weight)) div greatest(w_open, 1)")))
        .select(*nodes.columns, "got")
    )


def budgets(docs: DataFrame, mix: Mix, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """The leaves: levels, available tokens and budget. docs has levels and n_tokens."""
    leaves = docs.groupBy(*levels).agg(F.sum("n_tokens").alias("available"))
    out_of_mix = F.lit(False)
    for level in levels:
        out_of_mix = out_of_mix | (weight(level, mix) == 0)
    tree = leaves.where(~out_of_mix)  # a node's capacity is what its weights let it give
    root = leaves.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("all"))
    held = root.select((F.expr(f"all * {mix.share[0]} div {mix.share[1]}")).alias("budget"))
    for depth, level in enumerate(levels):
        path = list(levels[: depth + 1])
        nodes = tree.groupBy(*path).agg(F.sum("available").alias("available"))
        nodes = nodes.crossJoin(F.broadcast(held)) if depth == 0 else nodes.join(held, path[:-1])
        held = share_out(nodes, path[:-1], level, mix).select(*path, "available", F.col("got").alias("budget"))
        if depth + 1 < len(levels):
            held = held.drop("available")
    return held


def mix_sources(docs: DataFrame, mix: Mix, domain: Column, tokens: Column | None = None, id_col: str = "doc_id", lang: str = "lang", source: str = "source", text_col: str = "text", digits: int = BUCKET_DIGITS) -> DataFrame:
    """The chosen documents: doc_id, domain, lang, source, n_tokens, epochs (whole
    passes), last_tokens (of the document in the last, partial pass) and
    taken_tokens. Documents that give no token have no row.

    tokens: a document's size; by default its words. Null domains, languages and
    sources are leaves called "". Null and empty texts have no tokens. Equal
    sort hashes go by id; a null id sorts as "". Repeated rows count each. If the
    budget is more than max_epochs of everything, all of that is taken.

    The one large aggregation is by leaf with partial sums. A leaf's order is cut by
    hash buckets, the bucket that holds the cut by finer ones and so on, so that one task
    sorts a part of a leaf in 16^(digits * LEVELS_DOWN).
    """
    size = word_count(F.col(text_col).cast("string")) if tokens is None else tokens.cast("long")
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    slim = written(docs.select(F.col(id_col).alias("doc_id"), name(domain).alias("domain"), name(F.col(lang)).alias("lang"), name(F.col(source)).alias("source"), size.alias("n_tokens")))
    leaves = written(budgets(slim, mix).withColumns({"epochs": F.expr("if(available = 0, 0, budget div greatest(available, 1))"), "remainder": F.expr("if(available = 0, 0, budget % greatest(available, 1))")}))
    small = leaves.count() <= BROADCAST_LEAVES
    held = lambda d: F.broadcast(d) if small else d
    path = list(LEVELS)
    order = F.md5(F.concat_ws(":", F.lit(str(mix.seed)), *path, F.col("epochs").cast("string"), name(F.col("doc_id"))))
    placed = slim.where(F.col("n_tokens") > 0).join(held(leaves.select(*path, "epochs", "remainder")), path).withColumn("order", order)
    partial = placed.where(F.col("remainder") > 0)
    cut = leaves.where(F.col("remainder") > 0).select(*path, "remainder", F.lit("").alias("cut"), F.lit(0).cast("long").alias("before"))
    for depth in range(1, LEVELS_DOWN + 1):
        bucket = F.substring("order", 1, digits * depth)
        upto = Window.partitionBy(*path).orderBy("bucket")
        inside = partial.join(held(cut.drop("remainder")), path).where(F.substring("order", 1, digits * (depth - 1)) == F.col("cut"))
        sums = inside.groupBy(*path, "remainder", "before", bucket.alias("bucket")).agg(F.sum("n_tokens").alias("in_bucket"))
        cut = written(
            sums.withColumn("before", F.col("before") + F.sum("in_bucket").over(upto) - F.col("in_bucket"))
            .where((F.col("before") < F.col("remainder")) & (F.col("before") + F.col("in_bucket") >= F.col("remainder")))
            .select(*path, "remainder", F.col("bucket").alias("cut"), "before")
        )
    known = placed.join(held(cut.drop("remainder")), path, "left").withColumn("bucket", bucket)
    inside = F.col("bucket") == F.col("cut")
    within = Window.partitionBy(*path).orderBy("order", name(F.col("doc_id")), "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = known.where(inside).withColumn("upto", F.sum("n_tokens").over(within))
    edge = edge.withColumn("last_tokens", F.greatest(F.lit(0).cast("long"), F.least(F.col("n_tokens"), F.col("remainder") - F.col("before") - (F.col("upto") - F.col("n_tokens")))))
    rest = known.where(~F.coalesce(inside, F.lit(False))).withColumn("last_tokens", F.when(F.col("bucket") < F.col("cut"), F.col("n_tokens")).otherwise(F.lit(0).cast("long")))
    out = ["doc_id", *path, "n_tokens", "epochs", "last_tokens"]
    taken = F.col("epochs") * F.col("n_tokens") + F.col("last_tokens")
    return edge.select(*out).unionByName(rest.select(*out)).withColumn("taken_tokens", taken).where(F.col("taken_tokens") > 0)
