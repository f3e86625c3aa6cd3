"""Connected components of links, given as a table or to be found in inverted lists."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.plans.scratch import materialize, materialize_with

#: members of a block, and changes counted at a time, when members are held against each other
BLOCK, COLUMNS = 256, 4096
#: lists up to this length are compared pair by pair, longer ones with a hub
SHORT_LIST = 16
#: a value is split that holds more than one of so many rows, and more than PART rows; so at most HOT values are
HOT, PART = 10_000, 256


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the lowest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
    low = _lowest(both).withColumn("m", F.least("u", "m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its lower neighbours to the lowest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _lowest(down)
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v")))


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) of all nodes in ``links``, a table of two columns; a component is its lowest node.

    Each round hangs nodes to the lowest node two steps away, so the number of
    rounds grows with the logarithm of the longest chain.  Links of a node with
    many neighbours are joined, never gathered.  Every round is written to the
    shared folder, which cuts the lineage.
    """
    u, v = links.columns
    edges = links.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct()
    edges, before = materialize(edges, "links"), None
    for _ in range(rounds):
        step = _small_star(_large_star(edges)).distinct()
        edges, now = materialize_with(
            step, "stars", F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("code")
        )
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select("v", "v").distinct()
    )


def in_parts(rows: DataFrame, value: str = "value", spread: str = "code", least: int = 2) -> DataFrame:
    """Rows whose ``value`` has ``least`` rows or more, with its number of rows ``length``, ``parts``, and the row's own ``part``.

    A value of very many rows is dealt over parts by ``spread``, so that no join
    by (value, part) has a hot key.  The split values are sent to all tasks:
    they are at most HOT, as each holds more than one of HOT rows.  ``rows`` is
    read three times.  Null values are left out.
    """
    counted = rows.groupBy(value).agg(F.count("*").alias("length")).where(F.col("length") >= least).where(F.col(value).isNotNull())
    lengths, seen = materialize_with(counted, "lengths", F.coalesce(F.sum("length"), F.lit(0)).alias("rows"))
    most = max(seen["rows"] // HOT, PART)
    lengths = lengths.withColumn("parts", F.ceil(F.col("length") / most))
    split = F.broadcast(lengths.where("parts > 1").select(F.col(value).alias("_value"), F.col("parts").alias("_parts")))
    dealt = rows.join(split, rows[value] == split["_value"], "left")
    part = F.coalesce(F.pmod(F.xxhash64(spread), "_parts"), F.lit(0).cast("bigint"))
    return dealt.withColumn("part", part).drop("_value", "_parts").join(for_parts(lengths), [value, "part"])


def for_parts(singles: DataFrame) -> DataFrame:
    """Each row once for every one of its ``parts``, numbered as ``part``."""
    return singles.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))


def shared_lists(lists: DataFrame) -> DataFrame:
    """Rows of (value, code, n) whose value has several, as ``in_parts`` deals them; stored."""
    return materialize(in_parts(materialize(lists, "lists")), "shared-lists")


def _pairs(rows: DataFrame, others: DataFrame, percent: int, apart: str, by: list[str]) -> DataFrame:
    """Distinct (a, b), a < b, of two list tables that agree ``by`` columns and are of like size, where ``apart`` holds."""
    like = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
    met = rows.alias("x").join(others.alias("y"), by).where(apart).where(like)
    return met.select(F.least("x.code", "y.code").alias("a"), F.greatest("x.code", "y.code").alias("b")).where("a <> b").distinct()


def groups_of_lists(
    lists: DataFrame,
    confirm: Callable[[DataFrame], DataFrame],
    percent: int,
    sets: DataFrame | None = None,
) -> DataFrame:
    """(node, component) of the links among members of one list that ``confirm`` finds true.

    ``lists`` is a table (value, code, n) dealt by ``in_parts``; sizes n of linked
    members differ by ``percent`` at most.  Short lists are compared pair by pair.  A
    long list is compared with one hub, the member that stands in most long
    lists, so a group of n alike members costs n comparisons.  What lists with
    several groups still need is found by ``_around_hubs`` if ``sets``, a table
    (code, shingles), is given and a link is a Jaccard similarity of ``percent``;
    else their groups are compared in full.  No link that joins two groups is
    left out.
    """
    short = lists.where(f"length <= {SHORT_LIST}").select("value", "code", "n")
    long = lists.where(f"length > {SHORT_LIST}").select("value", "code", "n", "parts", "part")
    stands = long.groupBy("code").agg(F.count("*").alias("lists"))
    best = F.max_by(F.struct("code", "n"), F.struct("lists", F.xxhash64("code")))
    chosen = long.join(stands, "code").groupBy("value").agg(best.alias("hub"), F.first("parts").alias("parts"))
    hubs = materialize(chosen.select("value", "hub.*", "parts"), "hubs")
    near_hub = _pairs(for_parts(hubs), long, percent, "x.code <> y.code", ["value", "part"])
    pairs = _pairs(short, short, percent, "x.code < y.code", ["value"]).union(near_hub).distinct()
    links = materialize(confirm(pairs), "list-links")
    groups = components(links)
    rest = _open_lists(long, groups)
    if rest.isEmpty():
        return groups
    if sets is None:
        pairs = _pairs(rest, rest, percent, "x.label < y.label", ["value"])
    else:
        pairs = _around_hubs(rest, hubs, sets, percent)
    return components(materialize(links.union(confirm(pairs)), "list-links"))


def _around_hubs(lists: DataFrame, hubs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) that are linked among members of one list, in different groups.

    With D = a member's symmetric difference to the hub h of its list, the
    difference of two members x and y is that of Dx and Dy.  A link allows it to
    be r (|x| + |y|), with r = (100 - percent) / (100 + percent).  Of two members
    in different groups one, x, is not linked to the hub: these are held against
    all members.  The members are dealt into blocks of about BLOCK, those not
    linked to the hub into blocks of their own, and a task gets one block of
    either side; it counts shared changes as a matrix product, so no pair is a
    row unless it is a link.  A member is copied once for each block of the
    others: with few of them a hub of any number of members stays about as
    large as it is.
    """
    hub = for_parts(hubs.select("value", F.col("code").alias("hub"), F.col("n").alias("n_hub"), "parts")).drop("parts")
    family = lists.join(hub, ["value", "part"]).select("hub", "n_hub", "code", "n", "label").distinct()
    family = in_parts(materialize(family, "families"), "hub")
    whole = family.groupBy("hub").agg(F.first("parts").alias("parts"))
    whole = whole.join(sets.select(F.col("code").alias("hub"), F.col("shingles").alias("of_hub")), "hub")
    both = family.join(sets.select("code", "shingles"), "code").join(for_parts(whole).drop("parts"), ["hub", "part"])
    change = F.concat(F.array_except("shingles", "of_hub"), F.array_except("of_hub", "shingles"))
    loose = F.col("size") * (100 + percent) > (100 - percent) * (F.col("n") + F.col("n_hub"))
    columns = ["hub", "part", "parts", "length", "code", "n", "n_hub", "label"]
    changed = both.select(*columns, F.sort_array(change).alias("change"))
    changed = changed.withColumn("size", F.size("change")).withColumn("loose", loose)
    changed = materialize(changed, "changes")
    others = changed.where("loose").groupBy("hub").agg(F.first("parts").alias("parts"), F.count("*").alias("others"))
    left, right = _dealt(changed.join(for_parts(others).drop("parts"), ["hub", "part"]))
    ratio = (100 - percent, 100 + percent)
    met = left.groupBy(*_TASK).cogroup(right.groupBy(*_TASK)).applyInPandas(
        lambda x, y: _linked(x, y, *ratio), "a bigint, b bigint"
    )
    return met.distinct()


_TASK = ["hub", "left", "right"]


def _dealt(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All members, and the ``loose`` ones, each in a block of its side and once for every block of the other."""
    blocks = {"left": F.ceil(F.col("length") / BLOCK), "right": F.ceil(F.col("others") / BLOCK)}
    columns = [F.col(c).alias(c) for c in ("hub", "code", "n", "label", "change")]  # attributes of each side's own
    sides = []
    for rows, own, other in ((members, "left", "right"), (members.where("loose"), "right", "left")):
        block = F.pmod(F.xxhash64(F.lit(own), "code"), blocks[own]).alias(own)
        sides.append(rows.select(*columns, block, F.explode(F.sequence(F.lit(0).cast("bigint"), blocks[other] - 1)).alias(other)))
    return sides[0], sides[1]


def _linked(left: pd.DataFrame, right: pd.DataFrame, more: int, less: int) -> pd.DataFrame:
    """Pairs of two blocks in different groups whose changes differ little enough."""
    none = pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
    if not len(left) or not len(right):
        return none
    sides = []
    for block in (left, right):
        size = block["change"].map(len).to_numpy()
        flat = np.concatenate([np.asarray(c, np.int64) for c in block["change"]]) if size.sum() else np.empty(0, np.int64)
        sides.append((size, np.repeat(np.arange(len(block)), size), flat))
    common = np.intersect1d(sides[0][2], sides[1][2])
    shared = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, len(common), COLUMNS):
        part, tables = common[low : low + COLUMNS], []
        for (_, row, flat), block in zip(sides, (left, right)):
            place = np.minimum(np.searchsorted(part, flat), len(part) - 1)
            hit = part[place] == flat
            table = np.zeros((len(block), len(part)), np.float32)
            table[row[hit], place[hit]] = 1
            tables.append(table)
        shared += tables[0] @ tables[1].T
    apart = sides[0][0][:, None] + sides[1][0] - 2 * shared.astype(np.int64)
    total = left["n"].to_numpy()[:, None] + right["n"].to_numpy()
    near = (apart * less <= more * total) & (left["label"].to_numpy()[:, None] != right["label"].to_numpy())
    x, y = np.nonzero(near)
    a, b = left["code"].to_numpy()[x], right["code"].to_numpy()[y]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}) if len(a) else none


def _open_lists(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """Lists that hold several groups, with each member's group as ``label``."""
    label = F.coalesce("component", "code").alias("label")
    labelled = lists.join(groups, lists["code"] == groups["node"], "left").select("value", "code", "n", "parts", "part", label)
    several = labelled.groupBy("value").agg((F.min("label") < F.max("label")).alias("open"), F.first("parts").alias("parts"))
    several = for_parts(several.where("open")).select("value", "part")
    return materialize(labelled.join(several, ["value", "part"]), "open-lists")
