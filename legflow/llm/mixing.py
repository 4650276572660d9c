"""Mixing sources to target weights under a token budget.

Leaves are (domain, language, source).  The budget flows down the tree by
integer weights: at each node it is shared among the children in proportion
to their weights, and a child that cannot use its share (its capacity is its
leaves' tokens times ``epochs``) hands the rest to its siblings, in
proportion again, until they are full.  Since a node's capacity is the sum
of its leaves', a shortage leaves a node only when all below it is full:
siblings are served before ancestors' siblings.

The levels are solved in closed form, without rounds: children are sorted by
capacity per weight; going up in that order, a child is full if its capacity
is at most its share of what the fuller ones before it left.  All in
integers; what division leaves over (fewer tokens than children) is not
spent.

A leaf's budget is read off its seeded epochs: every document once per full
epoch, then a prefix of the last epoch's order (md5 of seed, epoch and id).
The document at the cut gives its first words only, so a leaf's words are its
budget exactly.  The order is cut by range of the md5: words are summed per
leaf and range, and only the range that holds the cut is put in order, so no
task orders a whole leaf.

With ``texts`` the result carries what is taken: ``text``, once per full epoch, and ``part_text``, the text up to the end
of word ``part_words``.  Texts are written once and only rows of the range that holds a cut are shuffled.

Nulls: a null text has no words; null lang or source is a leaf of its own
(named ``null``); a null id is ordered as empty text.  Documents without
words are never taken, nor what a weight of 0 names.  Repeated rows count as often as they occur.  Rows
with equal md5 are ordered by their words.  Without documents the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legflow.llm.shared import cut, written

LEVELS = ["domain", "lang", "source"]
RANGES = 12  # bits of the md5 that name a range


def n_words(text: str = "text") -> Column:
    """Words of a text: runs of anything but space, tab, and line ends."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def weight_of(name: Column, weights: dict[str, int], other: int) -> Column:
    if not weights:
        return F.lit(other).cast("bigint")
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(table[name], F.lit(other)).cast("bigint")


def shared_out(children: DataFrame, parent: list[str]) -> DataFrame:
    """``children`` (parent keys, w, cap, budget of the parent) with ``grant``, the child's budget."""
    by = [F.col(c) for c in parent] or [F.lit(0)]
    # capacity per weight to 10**-9, in two numbers that both fit a bigint: whole words per weight, then the rest's billionths
    order = Window.partitionBy(*by).orderBy(F.expr("cap div w"), F.expr("(cap % w) * 1000000000 div w"), "cap", "child")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = (children.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
            .withColumn("w_rest", F.sum("w").over(Window.partitionBy(*by)) - F.coalesce(F.sum("w").over(before), F.lit(0)))
            .withColumn("left", F.expr("cast(budget - cap_before as decimal(38, 0))"))
            .withColumn("full", F.expr("left > 0 and cast(cap as decimal(38, 0)) * w_rest <= left * w"))
            .withColumn("nth", F.row_number().over(order)))
    # full children are a prefix of the order; the first that is not fixes the level for the rest
    rows = rows.withColumn("stop", F.min(F.when(~F.col("full"), F.col("nth"))).over(Window.partitionBy(*by)))
    level = Window.partitionBy(*by)
    rows = (rows.withColumn("left_at", F.max(F.when(F.expr("nth = stop"), F.col("left"))).over(level))
            .withColumn("w_at", F.max(F.when(F.expr("nth = stop"), F.col("w_rest"))).over(level)))
    return rows.withColumn("grant", F.expr(
        "case when stop is null or nth < stop then cap else cast(greatest(left_at, 0) * w div w_at as bigint) end"))


def plan(leaves: DataFrame, budget: Column, epochs: int, weights: dict[str, dict[str, int]], other: int = 1) -> DataFrame:
    """Grants for a leaf table (domain, lang, source, words).

    Returns the leaves with ``grant``, ``full_epochs`` (whole passes) and
    ``rest`` (words of the last pass).  The leaf table has a row for each
    leaf, whatever the number of documents.
    """
    leaves = leaves.filter("words > 0")
    for name in LEVELS:
        leaves = leaves.filter(weight_of(F.col(name), weights.get(name, {}), other) > 0)
    leaves = leaves.withColumn("cap", F.col("words") * F.lit(epochs))
    total = leaves.agg(F.sum("cap").alias("cap"), budget.alias("want")).select(F.least("cap", "want")).head()[0] or 0
    level, keys = None, []
    for name in LEVELS:
        here = [*keys, name]
        children = leaves.groupBy(*here).agg(F.sum("cap").alias("cap"))
        children = children.withColumn("budget", F.lit(total).cast("bigint")) if level is None else children.join(level, keys)
        children = children.withColumn("child", F.col(name)).withColumn("w", weight_of(F.col(name), weights.get(name, {}), other))
        level = shared_out(children, keys).select(*here, F.col("grant").alias("budget"))
        keys = here
    return (leaves.join(level.withColumnRenamed("budget", "grant"), LEVELS)
            .withColumn("full_epochs", F.expr("grant div words")).withColumn("rest", F.expr("grant % words"))
            .select(*LEVELS, "words", "cap", "grant", "full_epochs", "rest"))


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def prefix(text: str, words: str) -> Column:
    """``text`` up to the end of its word number ``words``, spacing kept."""
    pieces = F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), F.col(words).cast("int")), "")


def mix(docs: DataFrame, domain: Column, budget: Column, weights: dict[str, dict[str, int]], epochs: int = 4,
        seed: int = 17, other: int = 1, texts: bool = False) -> DataFrame:
    """(doc_id, domain, lang, source, n_words, full_epochs, part_words, taken_words) of every document that is taken.

    ``domain`` is a column expression over ``docs``; ``budget`` an aggregate
    over the leaf table (columns words, cap).  ``part_words`` are the words
    taken in the last, partial epoch.  ``texts`` adds ``text`` (null without
    a full epoch) and ``part_text`` (null without such words).
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(c)
    rows = docs.select("doc_id", F.coalesce(domain, F.lit("null")).alias("domain"), name("lang"), name("source"),
                       n_words().alias("n_words"), *(["text"] if texts else [])).filter("n_words > 0")
    # with texts as columns, so that the passes over words and keys leave the texts unread
    rows = written(rows, "mixture") if texts else cut(rows)
    leaves = cut(rows.groupBy(*LEVELS).agg(F.sum("n_words").alias("words")))
    leaves = cut(plan(leaves, budget, epochs, weights, other))
    keyed = (rows.join(leaves.select(*LEVELS, "full_epochs", "rest"), LEVELS)
             .withColumn("key", order_key(seed, F.col("full_epochs"), F.col("doc_id")))
             .withColumn("range", F.conv(F.substring("key", 1, RANGES // 4), 16, 10).cast("int")))
    keyed = keyed if texts else cut(keyed)
    sums = keyed.filter("rest > 0").groupBy(*LEVELS, "range", "rest").agg(F.sum("n_words").alias("words"))
    upto = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # at most 2**RANGES rows a leaf; the range of the cut is the last that begins below the rest
    ranges = sums.withColumn("begin", F.coalesce(F.sum("words").over(upto), F.lit(0))).filter("begin < rest")
    edge = cut(ranges.groupBy(*LEVELS).agg(F.max("range").alias("edge"), F.max("begin").alias("begin")))
    keyed = keyed.join(edge, LEVELS, "left")
    inside = Window.partitionBy(*LEVELS).orderBy("key", "n_words").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = (keyed.filter("range = edge").withColumn("start", F.col("begin") + F.coalesce(F.sum("n_words").over(inside), F.lit(0)))
               .withColumn("part_words", F.greatest(F.lit(0), F.least("n_words", F.col("rest") - F.col("start")))))
    clear = keyed.filter("edge is null or range <> edge").withColumn(
        "part_words", F.when(F.expr("range < edge"), F.col("n_words")).otherwise(F.lit(0)))
    cols = ["doc_id", *LEVELS, "n_words", "full_epochs", "part_words", *(["text"] if texts else [])]
    taken = (at_edge.select(cols).unionByName(clear.select(cols)).withColumn("part_words", F.col("part_words").cast("bigint"))
            .withColumn("taken_words", F.expr("n_words * full_epochs + part_words")).filter("taken_words > 0"))
    if not texts:
        return taken
    part = F.when(F.expr("part_words = n_words"), F.col("text")).when(F.expr("part_words > 0"), prefix("text", "part_words"))
    return taken.withColumn("part_text", part).withColumn("text", F.when(F.expr("full_epochs > 0"), F.col("text")))
