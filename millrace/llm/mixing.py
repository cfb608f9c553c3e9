"""Mixing sources to target weights, in DataFrame and SQL functions only.

Documents hang on a tree: domain, language, source. A budget of tokens is given to the root and handed down by the weights of the
nodes. A node that cannot use its share (its documents times the allowed epochs hold fewer tokens) keeps what it can use, and what is
left goes to its siblings by their weights; only what all siblings together cannot use is missing at the node above, where the same
rule holds. As a node's share never exceeds what its subtree holds, shortages are made up among sources of a language first, then among
languages of a domain, then among domains.

Shares among siblings are a water level: with siblings in order of capacity / weight, prefix sums of capacities and suffix sums of
weights give the level at which the budget is used up, in one window over the children of a node. Nodes are aggregates of the leaves, not
of documents.

A leaf's documents are taken in the order of a seeded hash, anew in every epoch: all of them in the epochs that its budget fills, then the
prefix whose tokens come to the rest, before the first document that does not fit. Later, shorter ones are not tried and what is left of
the budget is not dealt to siblings: a leaf stays below its budget by less than that document, or empty if its first does not fit. The cut is found in three steps, none of which needs a leaf's documents in one task: tokens by
leaf and bucket of the hash, the bucket that the cut falls in, and the document within that bucket. Selecting is then a comparison of each
document's hash with its leaf's cut.

Tokens are words. Null sources, languages and texts count as empty. A document without words costs nothing and is taken with those around
it. Rows with equal ids have equal places, so they are taken or left together; null ids come first. Where all texts of a leaf are empty,
it has no budget and none is taken. Without documents the result is empty. Other columns stay in mix_row, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Up to this many leaves, some MB, go to every task; more are joined by shuffle. They are counted first.
BROADCAST_LEAVES = 50_000
#: A third of all documents in one leaf leave some ten thousand to a bucket at 10**8 documents.
BUCKET_DIGITS = 3


def default_domain(source: Column) -> Column:
    """The domain of a source: bulk for src0, sites for src1 to src9, tail for all others."""
    return F.when(source == "src0", "bulk").when(source.rlike("^src[1-9]$"), "sites").otherwise("tail")


def default_weight(level: str) -> Column:
    """Relative weights of the nodes of a level, by their name in the column of that level; whole numbers."""
    if level == "domain":
        return F.when(F.col("domain") == "bulk", 3).when(F.col("domain") == "sites", 4).otherwise(3)
    if level == "lang":
        return F.when(F.col("lang") == "en", 4).otherwise(2)
    return F.lit(1)


def word_count(text: Column) -> Column:
    """Words of a text: places where white space or the start is followed by another character."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def share_out(nodes: DataFrame, parent: list[str], budget: str, weight: Column) -> DataFrame:
    """nodes with share: the budget of their parent, dealt by weight and limited by capacity. One window for each parent."""
    ratio = F.col("capacity") / F.col("weight")
    w = Window.partitionBy(*parent).orderBy("ratio", *[c for c in ("domain", "lang", "source") if c in nodes.columns])
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    onward = w.rowsBetween(0, Window.unboundedFollowing)
    levelled = nodes.withColumn("weight", weight.cast("double")).withColumn("ratio", F.when(F.col("weight") > 0, ratio).otherwise(F.lit(float("inf"))))
    levelled = levelled.withColumns({"used": F.coalesce(F.sum("capacity").over(before), F.lit(0)), "open": F.sum("weight").over(onward)})
    # the level that would hold if this and all later siblings took part; the siblings below it are full
    levelled = levelled.withColumn("level", F.when(F.col("open") > 0, (F.col(budget) - F.col("used")) / F.col("open")).otherwise(F.lit(0.0)))
    own = F.when(F.col("weight") <= 0, F.lit(0.0)).when(F.col("ratio") <= F.col("level"), F.col("capacity").cast("double"))
    levelled = levelled.withColumn("full", own)
    level = F.min(F.when(F.col("full").isNull(), F.struct(F.col("ratio"), F.col("level")))).over(Window.partitionBy(*parent))
    return levelled.withColumn("share", F.coalesce("full", level["level"] * F.col("weight"))).drop("weight", "ratio", "used", "open", "level", "full")


def leaf_budgets(leaves: DataFrame, tokens: Column, epochs: int, weight=default_weight) -> DataFrame:
    """leaves (domain, lang, source, tokens) with budget, whole tokens; tokens: the budget of the root, by the column total."""
    total = Window.partitionBy()
    nodes = leaves.withColumn("capacity", F.col("tokens") * epochs)
    domains = nodes.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
    domains = domains.withColumn("total", F.sum("tokens").over(total)).withColumn("budget", tokens)
    domains = share_out(domains, [], "budget", weight("domain")).select("domain", F.col("share").alias("domain_share"))
    langs = nodes.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).join(domains, "domain")
    langs = share_out(langs, ["domain"], "domain_share", weight("lang")).select("domain", "lang", F.col("share").alias("lang_share"))
    sources = share_out(nodes.join(langs, ["domain", "lang"]), ["domain", "lang"], "lang_share", weight("source"))
    return sources.select("domain", "lang", "source", "tokens", F.floor(F.col("share") + 1e-6).cast("long").alias("budget"))


def _place(doc_id: Column, seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def mix_sources(docs: DataFrame, share: float = 0.5, epochs: int = 2, seed: int = 17, weight=default_weight, domain=default_domain) -> DataFrame:
    """(mix_row, mix): the selected rows of docs whole, some of them several times, and (domain, lang, source, epoch, budget).

    share: tokens to select, as a share of all tokens. epochs: how often a document may be taken.
    """
    leaf = ["domain", "lang", "source"]
    source, lang = F.coalesce(F.col("source"), F.lit("")), F.coalesce(F.col("lang"), F.lit(""))
    slim = docs.select(domain(source).alias("domain"), lang.alias("lang"), source.alias("source"), "doc_id", word_count(F.col("text")).alias("tokens"))
    leaves = slim.groupBy(*leaf).agg(F.sum("tokens").alias("tokens"))
    budgets = leaf_budgets(leaves, F.floor(F.col("total") * share), epochs, weight).where("tokens > 0 and budget > 0")
    budgets = budgets.withColumns({"full_epochs": F.floor(F.col("budget") / F.col("tokens")).cast("int"), "rest": F.col("budget") % F.col("tokens")})
    budgets = materialize(budgets.drop("tokens"), "budgets")
    small = F.broadcast if budgets.count() <= BROADCAST_LEAVES else lambda df: df
    # 1. tokens by bucket of the hash, for the epoch that is cut
    placed = slim.join(small(budgets.where("rest > 0")), leaf).withColumn("place", _place(F.col("doc_id"), seed, F.col("full_epochs")))
    placed = placed.withColumn("bucket", F.substring("place", 1, BUCKET_DIGITS))
    buckets = placed.groupBy(*leaf, "bucket", "rest").agg(F.sum("tokens").alias("tokens"))
    # 2. the bucket in which the prefix ends
    running = Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    buckets = buckets.withColumn("upto", F.sum("tokens").over(running)).where("upto > rest")
    cut = buckets.groupBy(*leaf).agg(F.min_by(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("room")), "bucket").alias("cut"))
    # 3. the last document that still fits, within that bucket; equal ids have equal places and count as one step
    inner = placed.join(small(cut), leaf).where("bucket = cut.bucket").groupBy(*leaf, "place", "cut").agg(F.sum("tokens").alias("tokens"))
    within = Window.partitionBy(*leaf).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    fits = inner.withColumn("upto", F.sum("tokens").over(within)).where("upto <= cut.room").groupBy(*leaf).agg(F.max("place").alias("last_in_bucket"))
    last = cut.join(fits, leaf, "left").select(*leaf, F.coalesce("last_in_bucket", "cut.bucket").alias("last_place"))
    limits = materialize(budgets.join(last, leaf, "left"), "limits")
    # a comparison for each document; in the cut bucket's absence its bare prefix stands before all its places
    named = limits.select(F.struct(*leaf).alias("mix_leaf"), F.struct("full_epochs", "budget", "rest", "last_place").alias("mix_cut"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_row")
    joined = docs.select(row, F.struct(domain(source).alias("domain"), lang.alias("lang"), source.alias("source")).alias("mix_leaf")).join(small(named), "mix_leaf")
    taken = joined.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("mix_cut.full_epochs"))))
    whole = F.col("mix_epoch") < F.col("mix_cut.full_epochs")
    part = (F.col("mix_cut.rest") > 0) & (_place(F.col("mix_row.doc_id"), seed, F.col("mix_epoch")) <= F.col("mix_cut.last_place"))
    info = F.struct("mix_leaf.domain", "mix_leaf.lang", "mix_leaf.source", F.col("mix_epoch").alias("epoch"), F.col("mix_cut.budget").alias("budget"))
    return taken.where(whole | part).select("mix_row", info.alias("mix"))
