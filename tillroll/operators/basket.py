"""Market basket analysis: frequent itemsets (up to three items) and
association rules with every antecedent / consequent split.

Plan, all in the long form ``(order_id, item)`` (no order x item matrix):

1. presence: ``groupBy(order, item).sum(quantity) > 0``; hashing on both
   columns spreads a huge order over many tasks, and the partial aggregate
   removes repeated lines before the shuffle;
2. item counts; rare items (floor ``max(1, floor(0.005 N))``) and
   infrequent ones are removed with a left-semi join;
3. vertical bitmaps: orders are dealt to groups by hash and numbered densely
   in them, and an item is a row of ``WORDS`` 64-bit words per bucket of those
   numbers; an order of any length is a bit in each of its items, never a list
   of combinations;
4. the support of a pair is the number of bits of an AND, summed over the
   buckets.  For triples each frequent pair's AND is taken once per bucket and
   combined with the third items that keep all three pairs frequent.  Joins
   are by bucket, on which the bitmaps are shuffled already, and sums are
   partial: what is shuffled on is a number per pair or triple and task.
   A bucket costs f**2 / 2 ANDs of ``WORDS`` words for f frequent items, and f
   is at most the mean number of items of an order divided by the support;
5. rules: each itemset explodes into its ``2^k - 2`` splits by bitmask;
   antecedent and consequent supports come from the itemset table by an
   equi-join on the sorted item array.

No side is forced into a broadcast: the candidate and itemset tables are
aggregates, so AQE sees their real size and broadcasts them only when they
are small; otherwise they stay shuffle joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import first_words, percent
from ..session import ensure_checkpoint_dir, kept
from ..sources.schema import order_key

# fixed values: defaults and the rare-item floor
DEFAULT_MIN_SUPPORT = 0.02
DEFAULT_MIN_LIFT = 1.2
RARE_ITEM_SHARE = 0.005
MAX_LEN = 3
#: Mean number of orders that are numbered together.
BUCKET_ORDERS = 1 << 14
#: Words of a bitmap, so a bucket has 64 times as many orders; each is a term of one compiled expression.
WORDS = 32


def _grouped(df: DataFrame, key: str, item: str) -> DataFrame:
    return (df.filter(F.col(key).isNotNull() & F.col(item).isNotNull())
            .groupBy(F.col(key).cast("string").alias("order_id"), F.col(item).cast("string").alias("item"))
            .agg(F.sum("quantity").alias("_q")))


def presence(df: DataFrame, order_col: str | None = None, item: str = "product_name") -> DataFrame:
    """Distinct ``(order_id, item)`` pairs where the summed quantity is > 0."""
    key = order_col or order_key(df.columns)
    return _grouped(df, key, item).filter(F.col("_q") > 0).drop("_q")


def order_count(df: DataFrame, order_col: str | None = None, item: str = "product_name") -> int:
    """N: orders with at least one named item line (all of them count)."""
    key = order_col or order_key(df.columns)
    return (df.filter(F.col(key).isNotNull() & F.col(item).isNotNull())
            .agg(F.count_distinct(key).alias("n")).first()["n"])


def item_counts(pairs: DataFrame, n_orders: int, min_support: float) -> DataFrame:
    """Orders per item, with the rare-item floor and the support flag."""
    floor_ = max(1, int(n_orders * RARE_ITEM_SHARE))
    return (pairs.groupBy("item").agg(F.count(F.lit(1)).alias("cnt"))
            .withColumn("kept", F.col("cnt") >= floor_)
            .withColumn("support", F.col("cnt") / F.lit(float(n_orders)))
            .withColumn("frequent", F.col("kept") & (F.col("support") >= F.lit(min_support))))


class BasketResult:
    """Itemsets and rules of one mining run (lazy DataFrames over persisted
    intermediates; call :meth:`unpersist` when done)."""

    def __init__(self, itemsets: DataFrame, rules: DataFrame, n_orders: int, items: DataFrame,
                 cached=()):
        self.itemsets = itemsets
        self.rules = rules
        self.n_orders = n_orders
        self.items = items
        self._cached = list(cached)

    def unpersist(self) -> None:
        for df in self._cached:
            df.unpersist()


def _support(cnt, n):
    return cnt / F.lit(float(n))


def item_bitmaps(pairs: DataFrame, n_orders: int) -> DataFrame:
    """One row per (bucket of orders, item): ``words``, the bucket's orders
    that hold the item as bits of ``WORDS`` 64-bit words.

    Orders are dealt to groups of about ``BUCKET_ORDERS`` by hash and numbered
    densely within their group, in the order of their keys; a bucket is a
    stretch of 64 * ``WORDS`` numbers, so every bitmap has the same few words,
    whatever the orders.  After the shuffle by group only bitmaps are shuffled.
    """
    groups = max(1, -(-n_orders // BUCKET_ORDERS))
    group = F.pmod(F.xxhash64("order_id"), F.lit(groups)).cast("int")
    number = (F.dense_rank().over(Window.partitionBy("group").orderBy("order_id")) - 1).cast("int")
    placed = pairs.select(group.alias("group"), "order_id", "item").select("group", "item", number.alias("at"))
    words = (placed.groupBy("group", "item", F.expr("at div 64").alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, at % 64)")).alias("bits"))
             .groupBy("group", "item", F.expr(f"word div {WORDS}").alias("piece"))
             .agg(*[F.max(F.when(F.col("word") % WORDS == k, F.col("bits"))).alias(f"w{k}") for k in range(WORDS)]))
    return words.select(F.expr("shiftleft(cast(group as long), 32) + piece").alias("bucket"), "item",
                        F.array(*[F.coalesce(f"w{k}", F.lit(0).cast("long")) for k in range(WORDS)]).alias("words")).repartition("bucket")


def _both(a: str, b: str):
    """The orders of two bitmaps, a column per word (null beyond their ends)."""
    return [F.get(a, F.lit(k)).bitwiseAND(F.get(b, F.lit(k))) for k in range(WORDS)]


def _bits(words):
    return sum(F.coalesce(F.bit_count(w), F.lit(0)) for w in words).cast("long")


def _pair_counts(bitmaps: DataFrame) -> DataFrame:
    """Orders that hold both of two items, per pair that stands in a bucket together."""
    x, y = (bitmaps.select("bucket", F.col("item").alias(c), F.col("words").alias(f"w{c}")) for c in "xy")
    both = x.join(y, "bucket").where("x < y").select("x", "y", _bits(_both("wx", "wy")).alias("n"))
    return both.groupBy("x", "y").agg(F.sum("n").alias("cnt")).where("cnt > 0")


def _triple_counts(bitmaps: DataFrame, frequent: DataFrame) -> DataFrame:
    """Orders that hold three items whose three pairs are all frequent: per
    bucket and frequent pair one AND, then one with each third item."""
    ends = frequent.groupBy(F.col("x").alias("item")).agg(F.collect_list("y").alias("ys"))   # frequent partners of an item
    # the partners travel with an item's bitmap, so that pairs of bitmaps never leave their bucket
    linked = bitmaps.join(ends, "item")
    x, y = (linked.select("bucket", F.col("item").alias(c), F.col("words").alias(f"w{c}"), F.col("ys").alias(f"s{c}")) for c in "xy")
    z = bitmaps.select("bucket", F.col("item").alias("z"), F.col("words").alias("wz"))
    two = (x.join(y, "bucket").where(F.array_contains("sx", F.col("y")))
           .select("bucket", "x", "y", F.array_intersect("sx", "sy").alias("zs"), F.array(*_both("wx", "wy")).alias("wxy"))
           .where(F.size("zs") > 0))
    three = two.join(z, "bucket").where(F.array_contains("zs", F.col("z"))).select("x", "y", "z", _bits(_both("wxy", "wz")).alias("n"))
    return three.groupBy("x", "y", "z").agg(F.sum("n").alias("cnt")).where("cnt > 0")


def frequent_itemsets(pairs: DataFrame, n_orders: int, min_support: float = DEFAULT_MIN_SUPPORT,
                      max_len: int = MAX_LEN, items: DataFrame | None = None,
                      cached: list | None = None) -> DataFrame:
    """``items array<string>`` (sorted), ``n_items``, ``cnt``, ``support``;
    every subset of a counted triple is frequent (Apriori)."""
    if not 1 <= max_len <= MAX_LEN:
        raise ValueError(f"max_len must be 1..{MAX_LEN}")
    spark = pairs.sparkSession
    empty = spark.createDataFrame([], "items array<string>, n_items int, cnt bigint, support double")
    if n_orders == 0:
        return empty
    ic = items if items is not None else item_counts(pairs, n_orders, min_support)
    if ic.filter("kept").limit(2).count() < 2:          # fewer than two products: nothing to mine
        return empty
    freq1 = ic.filter("frequent").select("item", "cnt")
    l1 = freq1.select(F.array("item").alias("items"), F.lit(1).alias("n_items"), "cnt")
    levels = [l1]
    keep = (lambda c: F.col(c) / F.lit(float(n_orders)) >= F.lit(min_support))
    if max_len >= 2:
        tf = pairs.join(freq1.select("item"), "item", "left_semi")   # occurrences of frequent items
        bitmaps = item_bitmaps(tf, n_orders)
        if cached is not None:          # both levels read it
            bitmaps = bitmaps.persist()
            cached.append(bitmaps)
        l2c = _pair_counts(bitmaps).filter(keep("cnt"))
        if cached is not None:
            l2c = l2c.persist()
            cached.append(l2c)
        levels.append(l2c.select(F.array("x", "y").alias("items"), F.lit(2).alias("n_items"), "cnt"))
        if max_len >= 3:
            l3 = _triple_counts(bitmaps, l2c).filter(keep("cnt"))
            levels.append(l3.select(F.array("x", "y", "z").alias("items"), F.lit(3).alias("n_items"), "cnt"))
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    return out.withColumn("support", _support(F.col("cnt"), n_orders))


def association_rules(itemsets: DataFrame, min_lift: float = DEFAULT_MIN_LIFT) -> DataFrame:
    """Every split of every itemset of two or more items into antecedent ->
    consequent, with support, confidence, lift, leverage and conviction;
    rules with ``lift >= min_lift`` are kept."""
    multi = itemsets.filter(F.col("n_items") >= 2)
    masks = F.expr("sequence(1, (1 << n_items) - 2)")
    splits = multi.select("items", F.col("support").alias("support"),
                          F.explode(masks).alias("mask"))
    ante = F.expr("filter(items, (x, i) -> ((mask >> i) & 1) = 1)")
    cons = F.expr("filter(items, (x, i) -> ((mask >> i) & 1) = 0)")
    splits = splits.select(ante.alias("antecedents"), cons.alias("consequents"), "support")
    sup = itemsets.select("items", "support")
    sa = sup.select(F.col("items").alias("antecedents"), F.col("support").alias("antecedent_support"))
    sc = sup.select(F.col("items").alias("consequents"), F.col("support").alias("consequent_support"))
    r = splits.join(sa, "antecedents").join(sc, "consequents")
    conf = F.col("support") / F.col("antecedent_support")
    r = (r.withColumn("confidence", conf)
         .withColumn("lift", F.col("confidence") / F.col("consequent_support"))
         .withColumn("leverage", F.col("support") - F.col("antecedent_support") * F.col("consequent_support"))
         .withColumn("conviction", F.try_divide(1 - F.col("consequent_support"), 1 - F.col("confidence"))))
    return (r.filter(F.col("lift") >= F.lit(min_lift))
            .select("antecedents", "consequents", "antecedent_support", "consequent_support",
                    "support", "confidence", "lift", "leverage", "conviction"))


def rule_order():
    """Total rule order: lift desc, then support desc, then the item lists."""
    return [F.col("lift").desc(), F.col("support").desc(),
            F.array_join("antecedents", ", ").asc(), F.array_join("consequents", ", ").asc()]


def mine(df: DataFrame, order_col: str | None = None, item: str = "product_name",
         min_support: float = DEFAULT_MIN_SUPPORT, min_lift: float = DEFAULT_MIN_LIFT,
         max_len: int = MAX_LEN) -> BasketResult:
    """Itemsets and rules for a clean sales table.

    The grouped ``(order, item)`` table is persisted while mining (memory
    and disk; rebuilt from lineage if an executor is lost) because the
    order count, the item counts and both levels read it.  The resulting
    itemsets are checkpointed (see below) and the intermediates released.
    """
    key = order_col or order_key(df.columns)
    grouped = _grouped(df, key, item).persist()
    n = grouped.agg(F.count_distinct("order_id").alias("n")).first()["n"]
    pairs = grouped.filter(F.col("_q") > 0).drop("_q")
    ic = item_counts(pairs, n, min_support).persist() if n else None
    work = [grouped]
    sets = frequent_itemsets(pairs, n, min_support, max_len, items=ic, cached=work)
    # The itemset table is small (frequent sets only).  A reliable checkpoint
    # in the shared checkpoint folder cuts the lineage: rules, graph and
    # reports start from a shallow plan, and a lost executor does not send
    # the mining back to the fact table.  The mining intermediates are then
    # released at once.
    ensure_checkpoint_dir(df.sparkSession)
    computed = sets.persist()              # computed once, then written by the checkpoint
    sets = computed.checkpoint(eager=True)
    for w in work + [computed]:
        w.unpersist()
    return BasketResult(sets, association_rules(sets, min_lift), n, ic, [ic] if ic is not None else [])


def summary(rules: DataFrame) -> DataFrame:
    """Number of rules, strongest lift, highest confidence, with display text."""
    return (rules.agg(F.count(F.lit(1)).alias("n_rules"), F.max("lift").alias("max_lift"),
                      F.max("confidence").alias("max_confidence"))
            .withColumn("lift_text", F.concat(F.format_number("max_lift", 1), F.lit("x")))
            .withColumn("confidence_text", percent("max_confidence", 0, 100)))


def top_rules(rules: DataFrame, n: int) -> DataFrame:
    """First ``n`` rules in rule order with a 1-based rank (top-k)."""
    top = rules.orderBy(*rule_order()).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*rule_order())))   # n rows


def cross_sell(rules: DataFrame, n: int = 5) -> DataFrame:
    """Top ``n`` suggestions: 'if antecedents then consequents'."""
    t = top_rules(rules, n)
    return t.select("rank", F.array_join("antecedents", ", ").alias("antecedents"),
                    F.array_join("consequents", ", ").alias("consequents"), "lift", "confidence",
                    F.format_number("lift", 1).alias("lift_text"),
                    F.concat(F.format_number(F.col("confidence") * 100, 0), F.lit("%")).alias("confidence_text"))


def rule_table(rules: DataFrame, max_rules: int = 15) -> DataFrame:
    """The rule table: first ``max_rules`` rules with formatted numbers."""
    if max_rules < 1:
        raise ValueError("max_rules must be positive")
    t = top_rules(rules, max_rules)
    return t.select("rank", F.array_join("antecedents", ", ").alias("antecedent"),
                    F.array_join("consequents", ", ").alias("consequent"),
                    "support", "confidence", "lift",
                    F.format_number("support", 3).alias("support_text"),
                    F.concat(F.format_number(F.col("confidence") * 100, 1), F.lit("%")).alias("confidence_text"),
                    F.format_number("lift", 2).alias("lift_text"))


def graph(rules: DataFrame, max_rules: int = 15) -> tuple[DataFrame, DataFrame]:
    """Undirected rule graph of the first ``max_rules`` rules.

    Edge: first (smallest) antecedent item -- first consequent item, names
    cut to three words; a later (weaker) rule overwrites the weight, so an
    edge keeps the lowest lift.  Nodes: short name, the full name last
    seen for it, and degree (a self-loop counts twice).
    """
    t = top_rules(rules, max_rules)
    ends = t.select("rank", F.array_min("antecedents").alias("a_full"),
                    F.array_min("consequents").alias("c_full"), "lift")
    ends = kept(ends.withColumn("a", first_words("a_full")).withColumn("c", first_words("c_full")))   # <= max_rules rows
    edges = (ends.groupBy(F.least("a", "c").alias("src"), F.greatest("a", "c").alias("dst"))
             .agg(F.max_by("lift", "rank").alias("weight")))
    seen = (ends.select("a", "a_full", (F.col("rank") * 2).alias("k"))
            .unionByName(ends.select(F.col("c").alias("a"), F.col("c_full").alias("a_full"),
                                     (F.col("rank") * 2 + 1).alias("k"))))
    names = seen.groupBy(F.col("a").alias("node")).agg(F.max_by("a_full", "k").alias("full_name"))
    deg = (edges.select(F.col("src").alias("node")).unionAll(edges.select(F.col("dst").alias("node")))
           .groupBy("node").agg(F.count(F.lit(1)).alias("degree")))
    nodes = names.join(deg, "node")
    return edges, nodes


def report_rules(rules: DataFrame, n: int = 10) -> DataFrame:
    """Report table: top ``n`` rules, item lists cut at 30 characters."""
    t = top_rules(rules, n)
    return t.select("rank", F.substring(F.array_join("antecedents", ", "), 1, 30).alias("antecedent"),
                    F.substring(F.array_join("consequents", ", "), 1, 30).alias("consequent"),
                    "lift", F.concat(F.format_number("lift", 1), F.lit("x")).alias("lift_text"))
