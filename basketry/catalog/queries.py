"""Every operator as a query over the test tables.

Text and number columns only come out, so that another engine's rows compare
equal: itemsets are joined to text, confidences rounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry import runs
from basketry.catalog import fixtures as fx
from basketry.functions.itemsets import itemset_text
from basketry.operators import baskets as bk
from basketry.operators import bitmaps, clustering, lookup, recommend, ruleindex, sparse_clustering, support, usecases
from basketry.operators.redundancy import drop_redundant
from basketry.operators.ruleindex import RuleIndex
from basketry.operators.rules import generate_rules
from basketry.plans import mining
from basketry.plans.border import IncrementalMiner
from basketry.plans.scratch import materialize, scratch_path
from basketry.sources import items as source_items
from basketry.sources import rejects, sinks, text
from basketry.streaming import items as streams
from basketry.streaming import users as user_streams

RUN = ("run-1", 1700000000000)  # run id and time used where a query needs one


def items_text(column: str = "items") -> Column:
    return itemset_text(F.col(column).cast("array<string>"))


def show_rules(rules: DataFrame, *more: str | Column) -> DataFrame:
    return rules.select(
        items_text("antecedent").alias("antecedent"),
        items_text("consequent").alias("consequent"),
        "support",
        "antecedent_support",
        "total",
        F.round("confidence", 10).alias("confidence"),
        *more,
    )


def brand_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The rule table the look-up queries start from; every query mines its own."""
    return mining.top_k_rules(fx.brand_rows(spark, sf), 100, 0.1)


# ------------------------------------------------------ sources and baskets


def read_items(spark: SparkSession, sf: str) -> DataFrame:
    items = source_items.read_items(
        spark,
        "parquet",
        {
            "site": "l_linestatus",
            "user": ("l_suppkey", "string"),
            "group": ("l_orderkey", "string"),
            "item": "l_partkey",
            "timestamp": ("l_shipdate", "timestamp_ntz"),
        },
        path=f"{sf}/lineitem.parquet",
    )
    return items.select("site", "user", "group", "item", F.to_date("timestamp").cast("string").alias("day"))


def map_fields(spark: SparkSession, sf: str) -> DataFrame:
    items = source_items.map_fields(fx.purchases(spark, sf), fx.PURCHASE_SPEC)
    return items.select("site", "user", "group", "item", F.to_date("timestamp").cast("string").alias("day"))


def _part_baskets(spark: SparkSession, sf: str) -> DataFrame:
    return bk.to_baskets(fx.part_rows(spark, sf), "tid")


def parse_spmf(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "lines")
    sinks.write_lines(sinks.basket_lines(_part_baskets(spark, sf)), path)
    return text.read_spmf(spark, path).select("tid", items_text().alias("items"), F.size("items").alias("n"))


def index_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "lines")
    sinks.write_lines(sinks.basket_lines(_part_baskets(spark, sf).orderBy("tid"), None), path)
    return text.index_lines(spark, path)


def to_baskets(spark: SparkSession, sf: str) -> DataFrame:
    return _part_baskets(spark, sf).select("tid", items_text().alias("items"), F.size("items").alias("n"))


def assign_tids(spark: SparkSession, sf: str) -> DataFrame:
    baskets = bk.to_baskets(fx.part_rows(spark, sf).withColumnRenamed("tid", "l_orderkey"), "l_orderkey")
    return bk.assign_tids(baskets, "l_orderkey").select("tid", "l_orderkey", items_text().alias("items"))


def sort_items(spark: SparkSession, sf: str) -> DataFrame:
    return bk.sort_items(_part_baskets(spark, sf)).select("tid", items_text().alias("items"))


def explode_baskets(spark: SparkSession, sf: str) -> DataFrame:
    return bk.explode_baskets(_part_baskets(spark, sf))


def basket_profile(spark: SparkSession, sf: str) -> DataFrame:
    return bk.basket_profile(fx.part_rows(spark, sf))


# ---------------------------------------------------------------- supports


def vertical_index(spark: SparkSession, sf: str) -> DataFrame:
    index = support.vertical_index(fx.part_rows(spark, sf), block=1 << 12)
    return index.select("item", "block", items_text("tids").alias("tids"), "n")


def item_support(spark: SparkSession, sf: str) -> DataFrame:
    return support.item_support(fx.brand_rows(spark, sf))


def item_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    return support.item_occurrences(fx.part_rows(spark, sf))


def pair_support(spark: SparkSession, sf: str) -> DataFrame:
    return mining.pair_support(fx.brand_rows(spark, sf), 60)


def pair_support_parts(spark: SparkSession, sf: str) -> DataFrame:
    return mining.pair_support(fx.part_rows(spark, sf), 2)


def itemset_support(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.brand_rows(spark, sf)
    wanted = mining.pair_support(rows, 60).select(F.array("a", "b").alias("items"))
    return support.itemset_support(rows, wanted).select(items_text().alias("items"), "support")


def frequent_itemsets(spark: SparkSession, sf: str) -> DataFrame:
    sets = mining.frequent_itemsets(fx.brand_rows(spark, sf), 60)
    return sets.select(items_text().alias("items"), "size", "support")


# ------------------------------------------------------------------- rules


def generate(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.brand_rows(spark, sf)
    sets = mining.frequent_itemsets(rows, 60)
    total = rows.groupBy("tid").agg(F.lit(1)).count()
    return show_rules(generate_rules(sets, total, 0.1))


def top_k_rules_brand(spark: SparkSession, sf: str) -> DataFrame:
    return show_rules(mining.top_k_rules(fx.brand_rows(spark, sf), 20, 0.1))


def top_k_rules_multi(spark: SparkSession, sf: str) -> DataFrame:
    return show_rules(mining.top_k_rules(fx.brand_rows(spark, sf), 20, 0.2))


def top_k_rules_parts(spark: SparkSession, sf: str) -> DataFrame:
    return show_rules(mining.top_k_rules(fx.part_rows(spark, sf), 20, 0.1))


def top_k_rules_ties(spark: SparkSession, sf: str) -> DataFrame:
    return show_rules(mining.top_k_rules(fx.brand_rows(spark, sf), 10, 0.1, ties="all"))


def attribute_rules(spark: SparkSession, sf: str) -> DataFrame:
    return show_rules(mining.mine(fx.order_profile(spark, sf), "TOPK", k=20, minconf=0.2))


def top_k_nr_rules(spark: SparkSession, sf: str) -> DataFrame:
    return show_rules(mining.top_k_nr_rules(fx.order_attributes(spark, sf), 100, 0.3))


def top_k_nr_buffer(spark: SparkSession, sf: str) -> DataFrame:
    return show_rules(mining.top_k_nr_rules(fx.order_attributes(spark, sf), 100, 0.3, delta=20, exact=False))


def _all_attribute_rules(spark: SparkSession, sf: str) -> DataFrame:
    baskets = fx.order_attributes(spark, sf)
    return generate_rules(mining.frequent_itemsets(baskets, 1), baskets.count(), 0.3)


def drop_redundant_rules(spark: SparkSession, sf: str) -> DataFrame:
    return show_rules(drop_redundant(materialize(_all_attribute_rules(spark, sf), "rules")))


def rule_relative_support(spark: SparkSession, sf: str) -> DataFrame:
    rules = lookup.with_relative_support(brand_rules(spark, sf))
    return show_rules(rules, F.round("relative_support", 10).alias("relative_support"))


# ------------------------------------------------------------------ look-up


def rules_by_antecedent(spark: SparkSession, sf: str) -> DataFrame:
    found = lookup.rules_by_antecedent(brand_rules(spark, sf), ["Brand#25", "Brand#4"], 0.5)
    return show_rules(found, F.round("weight", 10).alias("weight"))


def rules_by_consequent(spark: SparkSession, sf: str) -> DataFrame:
    found = lookup.rules_by_consequent(brand_rules(spark, sf), "Brand#25,Brand#4", 0.5)
    return show_rules(found, F.round("weight", 10).alias("weight"))


def classifier_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = lookup.classifier_rules(_all_attribute_rules(spark, sf))
    return rules.select(
        items_text("antecedent").alias("antecedent"), "consequent", "support",
        F.round("confidence", 10).alias("confidence"), F.round("weight", 10).alias("weight"),
    )


def get_rules(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "store")
    rules = brand_rules(spark, sf)
    runs.store_rules(rules, root, "s1", "other")
    runs.store_rules(rules.where("size(antecedent) = 2"), root, "s1", RUN[0])
    runs.store_rules(rules, root, "s1", RUN[0])  # a second run replaces the first
    return show_rules(runs.get_rules(spark, root, "s1", RUN[0]))


def rules_json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return show_rules(lookup.rules_from_json(lookup.rules_to_json(brand_rules(spark, sf))))


def rules_parquet_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_path(spark, "versions")
    rules = brand_rules(spark, sf)
    sinks.write_rules(rules.limit(0), "PARQUET", base=base)
    sinks.write_rules(rules, "PARQUET", base=base)
    return show_rules(sinks.read_rules_parquet(spark, base))


def rules_norm_items(spark: SparkSession, sf: str) -> DataFrame:
    head, antecedent, consequent = sinks.normalize_rules(brand_rules(spark, sf), *RUN)
    sides = antecedent.select("rid", F.lit("antecedent").alias("side"), "item").unionByName(
        consequent.select("rid", F.lit("consequent").alias("side"), "item")
    )
    joined = head.join(sides, "rid")
    return joined.groupBy("uid", "timestamp", "side", "item", "support", "total").agg(F.count("*").alias("rules"))


def rules_as_documents(spark: SparkSession, sf: str) -> DataFrame:
    documents = sinks.rules_as_documents(brand_rules(spark, sf), *RUN)
    return documents.select(
        "uid", "timestamp", items_text("antecedent").alias("antecedent"), items_text("consequent").alias("consequent"),
        "support", F.round("confidence", 10).alias("confidence"), "total",
    )


# -------------------------------------------------------------------- users


def _last(spark: SparkSession, sf: str) -> DataFrame:
    return recommend.last_transaction(source_items.map_fields(fx.purchases(spark, sf), fx.PURCHASE_SPEC))


def last_transaction(spark: SparkSession, sf: str) -> DataFrame:
    return _last(spark, sf)


def _user_rules(spark: SparkSession, sf: str, min_weight: float = 1.0) -> DataFrame:
    return recommend.user_rules(_last(spark, sf), brand_rules(spark, sf), min_weight)


def user_rules(spark: SparkSession, sf: str) -> DataFrame:
    return _user_rules(spark, sf).select(
        "site", "user", items_text("antecedent").alias("antecedent"), items_text("consequent").alias("consequent"),
        "support", F.round("confidence", 10).alias("confidence"), F.round("weight", 10).alias("weight"),
    )


def user_rules_partial(spark: SparkSession, sf: str) -> DataFrame:
    last = _last(spark, sf)
    rules = mining.top_k_rules(fx.brand_rows(spark, sf), 20, 0.2)
    found = recommend.user_rules(last, rules, 0.5)
    return found.select(
        "site", "user", items_text("antecedent").alias("antecedent"), items_text("consequent").alias("consequent"),
        "support", F.round("confidence", 10).alias("confidence"), F.round("weight", 10).alias("weight"),
    )


def _listed(nested: DataFrame) -> DataFrame:
    listed = F.transform(
        "items",
        lambda r: F.concat_ws(">", F.concat_ws(",", r["antecedent"]), F.concat_ws(",", r["consequent"])),
    )
    return nested.select("site", "user", F.size("items").alias("n"), F.array_join(listed, ";").alias("rules"))


def nest_user_rules(spark: SparkSession, sf: str) -> DataFrame:
    return _listed(recommend.nest_user_rules(_user_rules(spark, sf)))


def user_rules_json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    texts = recommend.user_rules_to_json(recommend.nest_user_rules(_user_rules(spark, sf)))
    return _listed(recommend.user_rules_from_json(texts, user_type="BIGINT"))


def recommend_items(spark: SparkSession, sf: str) -> DataFrame:
    last = materialize(_last(spark, sf), "last")
    matched = recommend.user_rules(last, brand_rules(spark, sf))
    best = recommend.recommend(matched, last, 3)
    return best.select("site", "user", "item", F.round("confidence", 10).alias("confidence"), "support", "rank")


def matched_consequents(spark: SparkSession, sf: str) -> DataFrame:
    """Rules whose consequent each customer's last order holds, in part at least."""
    found = recommend.match_rules(_last(spark, sf), brand_rules(spark, sf), 0.5, side="consequent")
    return found.select(
        "site", "user", items_text("antecedent").alias("antecedent"), items_text("consequent").alias("consequent"),
        "support", F.round("confidence", 10).alias("confidence"), F.round("weight", 10).alias("weight"),
    )


# ---------------------------------------------------------------- use cases


def _expanded(spark: SparkSession, sf: str, **options) -> DataFrame:
    terms = materialize(fx.query_terms(spark, sf), "terms")
    keyed = terms.select(F.struct("conv_id", "turn").alias("tid"), "item")
    rules = mining.top_k_rules(keyed, 200, 0.3, **options)
    return usecases.expand_queries(terms, rules, ["conv_id", "turn"])


def expand_queries(spark: SparkSession, sf: str) -> DataFrame:
    """By rules of one word each, as its SQL twin lists these only."""
    return _expanded(spark, sf, max_len=2)


def expand_queries_all(spark: SparkSession, sf: str) -> DataFrame:
    """By rules of any number of words."""
    return _expanded(spark, sf)


def discount_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    sales = fx.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("item"), F.col("l_discount").alias("discount")
    )
    found = usecases.discount_conflicts(sales, mining.pair_support(fx.part_rows(spark, sf), 2), 0.05)
    return found.select(
        "a", "b", "support", F.round("discount_a", 10).alias("discount_a"), F.round("discount_b", 10).alias("discount_b")
    )


def best_partner(spark: SparkSession, sf: str) -> DataFrame:
    rules = generate_rules(mining.frequent_itemsets(fx.part_rows(spark, sf), 2, 2), 0, 0.0)
    best = usecases.best_partner(rules, 1)
    return best.select("item", "partner", "support", F.round("confidence", 10).alias("confidence"), "rank")


def bundles(spark: SparkSession, sf: str) -> DataFrame:
    best = usecases.bundles(mining.frequent_itemsets(fx.part_rows(spark, sf), 2), 1)
    return best.select("item", items_text().alias("items"), "support", "rank")


# --------------------------------------------------------------- clustering


def basket_item_counts(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.basket_item_counts(fx.part_rows(spark, sf))


def _named(clusters: DataFrame) -> DataFrame:
    """Clusters named by their smallest id, as K-means numbers them at random."""
    names = clusters.groupBy("cluster").agg(F.min("tid").alias("name"))
    return clusters.join(names, "cluster").select("tid", F.col("name").alias("cluster"))


def cluster_baskets(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by their status: three different baskets, so three clusters."""
    rows = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("tid"), F.col("o_orderstatus").alias("item"))
    return _named(clustering.cluster_baskets(rows, 3, 10))


def cluster_brand_baskets(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by all brands they hold."""
    return _named(clustering.cluster_baskets(fx.brand_rows(spark, sf), 3, 5))


def cluster_part_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of all parts of an order, with their cluster."""
    path = scratch_path(spark, "lines")
    sinks.write_lines(sinks.basket_lines(_part_baskets(spark, sf).orderBy("tid"), None), path)
    lines = text.index_lines(spark, path).select(F.col("no").alias("tid"), "line")
    rows = lines.select("tid", F.explode(F.split("line", " ").cast("array<bigint>")).alias("item"))
    return clustering.cluster_lines(_named(clustering.cluster_baskets(rows, 3, 5)), lines)


def cluster_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of one number each, the priority of an order: five clusters."""
    path = scratch_path(spark, "lines")
    orders = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("tid"), F.array(F.substring("o_orderpriority", 1, 1).cast("bigint")).alias("items")
    )
    sinks.write_lines(sinks.basket_lines(orders.orderBy("tid"), None), path)
    numbered = text.index_lines(spark, path).select(F.col("no").alias("tid"), "line")
    read = text.read_basket_lines(spark, path).distinct()
    rows = numbered.join(read, "line").select("tid", F.explode("items").alias("item"))
    clusters = _named(clustering.cluster_baskets(rows, 5, 10))
    return clustering.cluster_lines(clusters, numbered).groupBy("value").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- streaming


def _streamed_baskets(spark: SparkSession, sf: str) -> DataFrame:
    return streams.stream_baskets(fx.event_stream(spark, sf), event_id="event_id")


def _wait(query) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def _day(column: str = "start") -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def user_day_baskets(spark: SparkSession, sf: str) -> DataFrame:
    baskets = streams.stream_baskets(fx.events(spark, sf), event_id="event_id")
    return baskets.select("user", _day().alias("day"), items_text().alias("items"))


def user_session_baskets(spark: SparkSession, sf: str) -> DataFrame:
    baskets = streams.stream_baskets(fx.events(spark, sf), session="30 minutes", event_id="event_id")
    return baskets.select("user", F.unix_micros("start").alias("start_us"), items_text().alias("items"))


def stream_track(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "tracked")
    stream = fx.event_stream(spark, sf).withColumn("site", F.lit("web")).withColumn("day", F.to_date("timestamp"))
    spec = {
        "user": ("user", "bigint"), "group": ("day", "string"), "item": ("item", "string"),
        "timestamp": ("timestamp", "timestamp"),
    }
    _wait(streams.track_items(stream, path, scratch_path(spark, "ckpt"), spec))
    tracked = spark.read.parquet(path)
    return tracked.select("site", "user", "group", "item", F.unix_micros("timestamp").alias("ts_us"))


def stream_baskets(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "closed")
    _wait(streams.store_baskets(_streamed_baskets(spark, sf), path, scratch_path(spark, "ckpt")))
    return spark.read.parquet(path).select("user", _day().alias("day"), items_text().alias("items"))


def stream_pair_support(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "pairs")
    _wait(streams.stream_pair_support(_streamed_baskets(spark, sf), path, scratch_path(spark, "ckpt")))
    return streams.running_pair_support(spark, path)


def stream_mine(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "mined")
    _wait(
        streams.stream_mine(
            _streamed_baskets(spark, sf), f"{root}/baskets", f"{root}/rules", f"{root}/ckpt", k=20, minconf=0.3
        )
    )
    return show_rules(streams.latest_rules(spark, f"{root}/rules"))


def stream_recommend(spark: SparkSession, sf: str) -> DataFrame:
    baskets = streams.stream_baskets(fx.events(spark, sf), event_id="event_id")
    rules = mining.top_k_rules(baskets, 20, 0.3, tid=("user", "start"))
    path = scratch_path(spark, "offers")
    _wait(streams.stream_recommend(_streamed_baskets(spark, sf), rules, path, scratch_path(spark, "ckpt")))
    offers = spark.read.parquet(path)
    return offers.select(
        "user", _day().alias("day"), "item", F.round("confidence", 10).alias("confidence"), "support", "rank"
    )


def stream_recommend_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Offers from rules that change while the stream stands between its first and second half of events."""
    first, second, path = fx.event_halves(spark, sf)
    root = scratch_path(spark, "offers")
    every = materialize(streams.stream_baskets(fx.events(spark, sf), event_id="event_id"), "every")  # mined twice
    for half, minconf in ((first, 0.3), (second, 0.5)):
        half.write.mode("append").parquet(path)  # the stream takes all new files at once
        sinks.write_rules_parquet(mining.top_k_rules(every, 20, minconf, tid=("user", "start")), f"{root}/rules")
        baskets = streams.stream_baskets(fx.as_events(spark.readStream.schema(half.schema).parquet(path)), event_id="event_id")
        _wait(streams.stream_recommend(baskets, f"{root}/rules", f"{root}/offers", f"{root}/ckpt"))
    offers = spark.read.parquet(f"{root}/offers")
    return offers.select(
        "user", _day().alias("day"), "item", F.round("confidence", 10).alias("confidence"), "support", "rank", "rules_version"
    )


def _show_user_rules(found: DataFrame) -> DataFrame:
    return found.select(
        "site", "user", items_text("antecedent").alias("antecedent"), items_text("consequent").alias("consequent"),
        "support", F.round("confidence", 10).alias("confidence"), F.round("weight", 10).alias("weight"),
    )


def _brand_index(spark: SparkSession, sf: str) -> RuleIndex:
    path = scratch_path(spark, "rule-index")
    name = f"rules_{path.rsplit('-', 1)[1]}"
    return ruleindex.write_rule_index(brand_rules(spark, sf), path, name, buckets=8)


def indexed_user_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules that apply to each user's last transaction, from the stored index."""
    return _show_user_rules(ruleindex.match_index(_last(spark, sf), _brand_index(spark, sf)))


def indexed_consequents(spark: SparkSession, sf: str) -> DataFrame:
    """Rules half of whose consequent is in each user's last transaction, from the stored index."""
    matched = ruleindex.match_index(_last(spark, sf), _brand_index(spark, sf), 0.5, side="consequent")
    return _show_user_rules(matched)


def cluster_brand_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by how often they hold each brand: three clusters after five rounds, centres as a table."""
    clusters, _ = sparse_clustering.cluster_sparse(fx.brand_rows(spark, sf), 3, 5)
    return clusters.select("tid", "cluster", F.round("distance", 6).alias("distance"))


def joined_attribute_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules between attributes of customers, the quarters of their balance, and what their orders are like."""
    return show_rules(mining.top_k_rules(fx.customer_bags(spark, sf), 100, 0.3))


def checked_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Good baskets of dirty lines, and the bad lines with the reason."""
    path = scratch_path(spark, "dirty")
    fx.dirty_lines(spark, sf).write.text(path)
    checked = rejects.check_spmf(spark.read.text(path))
    none = F.lit(None).cast("string")
    good = checked.good.select("tid", items_text().alias("items"), none.alias("record"), none.alias("reasons"))
    bad = checked.rejected.select(
        F.lit(None).cast("bigint").alias("tid"), none.alias("items"), "record", F.array_join("reasons", ";").alias("reasons")
    )
    return good.unionByName(bad)


def checked_items(spark: SparkSession, sf: str) -> DataFrame:
    """Item records of events whose kind should be a number: how many fail, and why."""
    rows = fx.table(spark, sf, "events").withColumn("shop", F.lit("s1"))
    kind = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).when(F.col("event_id") % 3 == 1, F.col("event_id").cast("string"))
    rows = rows.withColumn("kind", kind).withColumn("ts", F.col("ts").cast("timestamp"))
    spec = {"site": "shop", "user": "user_id", "group": ("event_id", "string"), "item": "kind", "timestamp": ("ts", "timestamp")}
    checked = rejects.check_fields(rows, spec)
    good = checked.good.agg(F.lit("good").alias("reason"), F.count("*").alias("n"), F.sum("item").alias("items"))
    return good.unionByName(checked.by_reason().withColumn("items", F.lit(None).cast("bigint")))


def stream_last_transaction(spark: SparkSession, sf: str) -> DataFrame:
    """The last day of each user and its items, from events that come in four batches, some late and some twice."""
    path = scratch_path(spark, "last")
    stream = fx.event_batches(spark, sf).withColumn("group", F.date_format("timestamp", "yyyy-MM-dd"))
    _wait(user_streams.stream_last_transactions(stream, path, scratch_path(spark, "ckpt")))
    last = user_streams.read_last_transactions(spark, path)
    return last.select("user", F.col("group").alias("day"), F.unix_micros("timestamp").alias("ts_us"), items_text().alias("items"))


def vertical_bitmap(spark: SparkSession, sf: str) -> DataFrame:
    """Parts to orders as bits; their number and a digest of the bits of each block."""
    index = bitmaps.vertical_bitmap(fx.part_rows(spark, sf))
    return index.select("item", F.col("block").cast("bigint").alias("block"), "n", F.sha2("bits", 256).alias("bits_sha256"))


def itemset_support_bitmap(spark: SparkSession, sf: str) -> DataFrame:
    """Supports of all pairs and triples of brands that 60 orders hold, from bits."""
    rows = fx.brand_rows(spark, sf)
    sets = mining.frequent_itemsets(rows, 60, 3).where("size > 1")
    found = bitmaps.itemset_support_bitmap(bitmaps.store_bitmap(rows), sets.select("items"))
    return found.select(items_text().alias("items"), "support")


def stream_pair_support_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Pair counts of events that come in six batches, some late and some twice; tables merged by twos."""
    path = scratch_path(spark, "pairs")
    baskets = streams.stream_baskets(fx.event_batches(spark, sf, 6), event_id="event_id")
    _wait(streams.stream_pair_support(baskets, path, scratch_path(spark, "ckpt"), fan=2))
    return streams.running_pair_support(spark, path)


def stream_mine_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Rules kept up to date over four batches of events, some late and some twice."""
    root = scratch_path(spark, "mined")
    baskets = streams.stream_baskets(fx.event_batches(spark, sf), event_id="event_id")
    _wait(streams.stream_mine(baskets, f"{root}/baskets", f"{root}/rules", f"{root}/ckpt", k=20, minconf=0.3))
    return show_rules(streams.latest_rules(spark, f"{root}/rules"))


def incremental_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules over brand baskets that come in four batches by customer."""
    orders = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("tid"), "o_custkey")
    rows = bk.to_baskets(fx.brand_rows(spark, sf), "tid").join(orders, "tid")
    rows = materialize(rows.withColumn("part", F.pmod("o_custkey", F.lit(4))), "dealt")
    miner = IncrementalMiner(spark, scratch_path(spark, "kept"), 20, 0.1)
    for part in range(4):
        rules = miner.add(part, rows.where(F.col("part") == part).select("tid", "items"))
    return show_rules(rules)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        read_items, map_fields, parse_spmf, index_lines, to_baskets, assign_tids, sort_items, explode_baskets,
        basket_profile, vertical_index, item_support, item_occurrences, pair_support, pair_support_parts,
        itemset_support, frequent_itemsets, top_k_rules_brand, top_k_rules_multi, top_k_rules_parts,
        top_k_rules_ties, attribute_rules, top_k_nr_rules, top_k_nr_buffer, rule_relative_support,
        rules_by_antecedent, rules_by_consequent, classifier_rules, get_rules, rules_json_roundtrip,
        rules_parquet_roundtrip, rules_norm_items, rules_as_documents, last_transaction, user_rules,
        user_rules_partial, nest_user_rules, user_rules_json_roundtrip, recommend_items, matched_consequents, expand_queries, expand_queries_all, discount_conflicts, best_partner,
        bundles, basket_item_counts, cluster_baskets, cluster_brand_baskets, cluster_lines, cluster_part_lines, user_day_baskets, user_session_baskets, stream_track,
        stream_baskets, stream_pair_support, stream_mine, stream_recommend, stream_pair_support_batches,
        stream_mine_batches, incremental_rules, stream_last_transaction, stream_recommend_versions, indexed_user_rules, indexed_consequents, joined_attribute_rules, cluster_brand_counts, checked_lines, checked_items, vertical_bitmap, itemset_support_bitmap,
    )
}
QUERIES["generate_rules"] = generate
QUERIES["drop_redundant"] = drop_redundant_rules
