"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.ordering import ranked, with_sums_before
from basketry.plans.scratch import materialize

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str = "text") -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """Per source: ``source_size``, ``first`` (rank of its first row), ``n`` rows, and ``target``.

    ``sizes`` has (source, size, rank).  Sources in code point order, null last,
    weigh ``weights``, repeating.  Targets share ``share`` times all sizes by
    weight; none is above ``cap`` times its source's size, and what the cap
    leaves goes to the others by weight.  In the order of cap per weight the
    capped sources come first, so two running sums find the level at which the
    rest is shared, however many sources there are.
    """
    sources = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.min("rank").alias("first"), F.count("*").alias("n")
    )
    number = ranked(sources, [F.asc_nulls_last("source")], "mix-sources", "_number")
    picked = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("_number") - 1) % len(weights) + 1).cast("int"))
    sources = number.withColumn("weight", picked.cast("bigint")).drop("_number")
    level = with_sums_before(
        sources.withColumn("_ratio", F.col("source_size") / F.col("weight")),
        ["_ratio", F.asc_nulls_last("source")],
        {"_size_before": "source_size", "_weight_before": "weight"},
        "mix-level",
    )
    level = materialize(level, "mix-levels")
    total = level.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    if total["weight"] is None:
        return sources.withColumn("target", F.lit(0.0)).drop("weight")
    words = share * total["size"]
    rest = (F.lit(words) - cap * F.col("_size_before")) / (F.lit(total["weight"]) - F.col("_weight_before"))
    free = level.withColumn("_level", rest).where(F.col("_level") * F.col("weight") <= cap * F.col("source_size"))
    at = free.agg(F.min("rank").alias("rank"), F.min_by("_level", "rank").alias("level")).first()
    target = F.lit(float(cap)) * F.col("source_size")
    if at["rank"] is not None:
        target = F.when(F.col("rank") < at["rank"], target).otherwise(F.lit(at["level"]) * F.col("weight"))
    return level.select("source", "source_size", "first", "n", target.alias("target"))


def offset(source: Column, seed: str) -> Column:
    """One offset of a source between 0 and 1, in steps of 2^-16, so sums with row counts stay exact."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("null"))))
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("double") / 65536


def mix_sources(
    df: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    cap: int = 2,
    seed: str = "mix",
    keep: Sequence[str] = (),
) -> DataFrame:
    """How often the mix takes each row: (key, source, size, source_size, target, copies, row), a row per row of ``df``.

    Every row of a source is expected target / source_size times, at most
    ``cap``.  Within a source, rows stand in the order of (size, key); with one
    random offset a source, a row is taken once per integer that its running
    sum of expected copies crosses.  As neighbours are of like size, what is
    taken of a source is off its target by about one large document at most,
    whatever the spread of sizes.  Running sums are row numbers times a
    constant, so they need no order of floating-point additions and reruns
    agree.  Columns of ``keep`` are carried along in the struct ``row``.

    A null text has size 0; a null source is a source, its place the last; null
    keys come last in a source.  Repeated rows are rows of their own, each with
    its own copies.  An empty table gives no rows; a source without words has
    the target 0 and no copies.  Other columns are not read.
    """
    row = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None)
    sizes = df.select(
        F.col(key).alias("key"), F.col(source).alias("source"), n_words(text).alias("size"), row.alias("row")
    )
    order = [F.asc_nulls_last("source"), F.asc("size"), F.asc_nulls_last("key")]
    rows = ranked(sizes if keep else sizes.drop("row"), order, "mix-rows")
    targets = materialize(source_targets(rows.select("source", "size", "rank"), weights, share, cap), "mix-targets")
    targets = targets.withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place, start = F.col("rank") - F.col("first"), offset(F.col("source"), seed)
    crossed = F.floor((place + 1) * rate + start) - F.floor(place * rate + start)
    return rows.join(targets, F.col("source").eqNullSafe(F.col("_source"))).select(
        "key",
        "source",
        "size",
        "source_size",
        "target",
        F.least(crossed, F.lit(cap)).cast("bigint").alias("copies"),  # against rounding at a rate of ``cap``
        *(["row"] if keep else []),
    )


def take_mix(df: DataFrame, **options) -> DataFrame:
    """Rows of ``df`` as often as ``mix_sources`` takes them, columns unchanged."""
    mixed = mix_sources(df, keep=df.columns, **options)
    times = F.explode(F.expr("sequence(1L, copies)"))
    return mixed.where("copies > 0").select("row", times.alias("copy")).select("row.*")
