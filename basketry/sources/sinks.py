"""Writing rules and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.itemsets import itemset_text
from basketry.plans import files

SINKS = ("ELASTIC", "JDBC", "PARQUET")


def rule_versions(spark: SparkSession, base: str) -> list[int]:
    """Versions below ``base`` that are complete, oldest first."""
    base = base.rstrip("/")
    found = [int(name) for name in files.names(spark, base) if name.isdigit()]
    return sorted(n for n in found if files.exists(spark, f"{base}/{n}/_SUCCESS"))


def write_rules_parquet(rules: DataFrame, base: str) -> int:
    """Write the rules below ``base`` as the next numbered version; return it.

    A number is claimed before it is written, so of several writers each gets its own.
    """
    spark, base = rules.sparkSession, base.rstrip("/")
    taken = [int(name) for name in files.names(spark, base) + files.names(spark, f"{base}/_claims") if name.isdigit()]
    version = max(taken, default=-1) + 1
    while not files.create(spark, f"{base}/_claims/{version}", ""):
        version += 1
    rules.write.mode("errorifexists").parquet(f"{base}/{version}")
    return version


def read_rules_parquet(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """Rules of a version, by default the latest complete one."""
    if version is None:
        version = max(rule_versions(spark, base), default=None)
        if version is None:
            raise LookupError(f"no rules below {base}")
    return spark.read.parquet(f"{base.rstrip('/')}/{version}")


def _with_rid(rules: DataFrame, uid: str) -> DataFrame:
    sides = F.to_json(F.struct(F.lit(uid).alias("uid"), "antecedent", "consequent"))
    return rules.withColumn("rid", F.sha2(sides, 256))


def normalize_rules(rules: DataFrame, uid: str, timestamp: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rules as three tables: rules, antecedent items, consequent items.

    The rule id is a hash of run and rule, so writing again gives the same ids.
    """
    keyed = _with_rid(rules, uid)
    head = keyed.select(
        "rid", F.lit(uid).alias("uid"), F.lit(timestamp).cast("bigint").alias("timestamp"),
        "support", "total", "confidence",
    )

    def side(name: str, key: str) -> DataFrame:
        rows = keyed.select("rid", F.posexplode(name).alias("pos", "item"))
        return rows.select(F.concat_ws("-", "rid", F.col("pos").cast("string")).alias(key), "rid", "item")

    return head, side("antecedent", "aid"), side("consequent", "cid")


def write_rules_jdbc(rules: DataFrame, url: str, uid: str, timestamp: int, properties: dict | None = None) -> None:
    """Append the three tables of ``normalize_rules`` to a database."""
    for name, table in zip(("rules", "antecedent", "consequent"), normalize_rules(rules, uid, timestamp)):
        table.write.jdbc(url, name, mode="append", properties=properties or {})


def rules_as_documents(rules: DataFrame, uid: str, timestamp: int) -> DataFrame:
    """Rules as documents for a search index, one nested row per rule."""
    return _with_rid(rules, uid).select(
        "rid", F.lit(uid).alias("uid"), F.lit(timestamp).cast("bigint").alias("timestamp"),
        "antecedent", "consequent", "support", "confidence", "total",
    )


def write_rules(rules: DataFrame, sink: str | None, **options):
    """Write the rules to the sink of the given name; None writes nothing."""
    if sink is None:
        return None
    if sink not in SINKS:
        raise ValueError(f"unknown sink {sink!r}, expected one of {', '.join(SINKS)}")
    if sink == "PARQUET":
        return write_rules_parquet(rules, options["base"])
    if sink == "JDBC":
        return write_rules_jdbc(rules, **options)
    uid, timestamp, resource = (options.pop(name) for name in ("uid", "timestamp", "resource"))
    documents = rules_as_documents(rules, uid, timestamp)
    options.setdefault("es.mapping.id", "rid")
    return documents.write.format("org.elasticsearch.spark.sql").mode("append").options(**options).save(resource)


def write_lines(df: DataFrame, path: str, column: str = "value") -> None:
    """Write one text column as a folder of text files."""
    df.select(F.col(column).alias("value")).write.text(path)


def basket_lines(baskets: DataFrame, tid: str | None = "tid") -> DataFrame:
    """Baskets as lines ``tid,item item item``, or without the tid if None."""
    text = itemset_text(F.col("items").cast("array<string>"), " ")
    return baskets.select((F.concat_ws(",", F.col(tid).cast("string"), text) if tid else text).alias("value"))
