"""Frequent itemsets and the k best rules.

Itemsets are counted level by level (pairs, triples, ...) with grouped
aggregates, which combine before the exchange and spill.  The miner needs no
minimum support: for any threshold t, mining at support >= t finds every valid
rule with support >= t, so if k of them turn up the first k are the answer.  A
start value comes from the most frequent items; it rises as rules are found and
is lowered, with a new pass, if fewer than k exist above it.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.itemsets import rule_order
from basketry.operators.redundancy import drop_redundant
from basketry.operators.rules import generate_rules
from basketry.operators.support import itemset_support
from basketry.plans.scratch import materialize, materialize_with
from basketry.plans.store import WIDTH, BasketStore, prepare, prune, restrict_to_head

log = logging.getLogger("basketry")

# Seeding: number of most frequent items whose combinations of 2, 3, 4 items are
# all counted.  Each gives at most about 20,000 itemsets.
HEADS = {2: 200, 3: 50, 4: 27}


# ---------------------------------------------------------------- one level


def _first(narrow: DataFrame) -> DataFrame:
    """Each item of each basket with the items after it."""
    return narrow.select("items", F.posexplode("items").alias("i", "x")).select(
        F.array("x").alias("items"),
        F.slice("items", F.col("i") + 2, F.size("items")).alias("rest"),
    )


def _extend(state: DataFrame) -> DataFrame:
    """Each itemset of each basket, longer by one of the items after it."""
    return state.select("items", "rest", F.posexplode("rest").alias("i", "x")).select(
        F.concat("items", F.array("x")).alias("items"),
        F.slice("rest", F.col("i") + 2, F.size("rest")).alias("rest"),
    )


def _count(state: DataFrame) -> DataFrame:
    return state.groupBy("items").agg(F.count("*").alias("support"))


def _frequent(
    state: DataFrame, wide: DataFrame | None, n_wide: int, tau: int, supports: DataFrame
) -> tuple[DataFrame, int]:
    """Itemsets of ``state`` with support >= tau, wide baskets included, and their number."""
    counts = _count(state)
    size = F.count("*").alias("n")
    if wide is None:
        level, seen = materialize_with(counts.where(F.col("support") >= tau), "level", size)
        return level, seen["n"]
    # at most half of tau baskets are wide, so tau - n_wide narrow ones hold the itemset
    candidates = materialize(counts.where(F.col("support") >= tau - n_wide), "candidates")
    extra = itemset_support(wide, candidates, supports=supports, width=0).withColumnRenamed("support", "extra")
    total = candidates.join(extra, "items").select("items", (F.col("support") + F.col("extra")).alias("support"))
    level, seen = materialize_with(total.where(F.col("support") >= tau), "level", size)
    return level, seen["n"]


class _Threshold:
    """Support threshold of a running search; it only rises."""

    def __init__(self, value: int):
        self.value = value

    def raise_to(self, value: int) -> None:
        self.value = max(self.value, value)


def _levels(
    store: BasketStore,
    tau: _Threshold,
    max_len: int | None,
    known: dict[int, tuple[int, DataFrame]] | None = None,
    spare: int | None = None,
) -> Iterator[tuple[int, DataFrame]]:
    """Yield (n, itemsets of n items with support >= tau) for n = 2, 3, ...

    The caller may raise ``tau`` between levels.  ``known`` holds tables counted
    earlier: (b, table) for n means every n-itemset with support > b is in it.
    With ``spare`` pairs are kept down to that support and entered in ``known``,
    so that a later pass at a lower threshold need not count them again.
    """
    known = {} if known is None else known
    done: dict[int, DataFrame] = {}
    baskets, state, n = None, None, 1
    while max_len is None or n < max_len:
        n += 1
        if n in known and tau.value > known[n][0]:
            level = known[n][1].where(F.col("support") >= tau.value)
            size = level.count()
        else:
            least = min(spare or tau.value, tau.value) if n == 2 else tau.value
            if baskets is None:
                baskets = prune(store, least)
                state = _first(baskets[0])
                for length in range(2, n):
                    state = _keep(_extend(state), done[length])
            longer = _extend(state)
            level, size = _frequent(longer, baskets[1], baskets[2], least, store.supports)
            if least < tau.value:
                known[2] = (least - 1, level)
                level = level.where(F.col("support") >= tau.value)
                size = level.count()
        if not size:
            return
        yield n, level
        level = level.where(F.col("support") >= tau.value)
        if n == max_len or level.count() <= n:  # an (n + 1)-itemset has n + 1 subsets in the level
            return
        done[n] = level
        if baskets is not None:
            state = _keep(longer, level)
            if n > 2:
                state = materialize(state, "state")


def _keep(state: DataFrame, level: DataFrame) -> DataFrame:
    """Rows that are frequent and still have items to add."""
    return state.where(F.size("rest") > 0).join(level.select("items"), "items", "left_semi")


def _singles(store: BasketStore, tau: int) -> DataFrame:
    return store.supports.where(F.col("support") >= tau).select(F.array("item").alias("items"), "support")


def _union(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


# ----------------------------------------------------------- fixed threshold


def frequent_itemsets(
    baskets: DataFrame,
    min_count: int,
    max_len: int | None = None,
    tid: str | Sequence[str] = "tid",
    width: int = WIDTH,
) -> DataFrame:
    """All itemsets held by at least ``min_count`` baskets: (items, size, support)."""
    if min_count < 1:
        raise ValueError("min_count must be at least 1")
    store = prepare(baskets, tid, width)
    levels = [_singles(store, min_count)]
    if max_len is None or max_len > 1:
        levels += [level for _, level in _levels(store, _Threshold(min_count), max_len)]
    return _union(levels).select("items", F.size("items").alias("size"), "support")


def pair_support(
    baskets: DataFrame, min_count: int, tid: str | Sequence[str] = "tid", width: int = WIDTH
) -> DataFrame:
    """Item pairs a < b held together by at least ``min_count`` baskets."""
    pairs = frequent_itemsets(baskets, min_count, 2, tid, width).where("size = 2")
    return pairs.select(F.col("items")[0].alias("a"), F.col("items")[1].alias("b"), "support")


# ------------------------------------------------------------- best k rules


def _support_at(df: DataFrame, rank: int) -> int:
    """Support of the ``rank``-th best row, 0 if there are fewer."""
    row = (
        df.select("support").orderBy(F.desc("support")).limit(rank)
        .agg(F.count("*").alias("n"), F.min("support").alias("s")).first()
    )
    return row["s"] if row["n"] == rank else 0


def _best(rules: DataFrame, k: int, ties: bool) -> tuple[DataFrame, int, int, float]:
    """The k best rules as a table, their number, lowest support, its confidence.

    With ``ties`` all rules as good in support as the k-th are kept.
    """
    metrics = (F.count("*").alias("n"), F.min(F.struct("support", "confidence")).alias("last"))
    if not ties:
        best, seen = materialize_with(rules.orderBy(*rule_order()).limit(k), "best", *metrics)
    else:
        rules = materialize(rules, "rules")
        best = rules.where(F.col("support") >= _support_at(rules, k))
        seen = best.agg(*metrics).first().asDict()
    if seen["n"] < k:
        return best, seen["n"], 0, 0.0
    return best, seen["n"], seen["last"]["support"], seen["last"]["confidence"]


# --------------------------------------------------------------------- seeds


@dataclass
class _Seed:
    """What the most frequent items tell: start value, level tables, best rules.

    ``known[n] = (b, table)``: every n-itemset with support > b is in the table.
    ``pool`` holds the k best rules of up to ``upto`` items, if these are known.
    """

    start: int
    known: dict[int, tuple[int, DataFrame]]
    pool: DataFrame | None = None
    last: tuple[int, float] = (0, 0.0)
    upto: int = 1


def _seed(store: BasketStore, k: int, minconf: float, max_len: int | None, ties: bool, heads: Mapping[int, int]) -> _Seed:
    seed = _Seed(1, {})
    tables = []
    for n, size in heads.items():
        if max_len is not None and n > max_len:
            break
        ranked = store.supports.orderBy(F.desc("support"), "item")
        head = ranked.limit(size)
        outside = 0 if store.n_items <= size else _support_at(store.supports, size + 1)
        state = _extend(_first(restrict_to_head(store, head, size)))
        for _ in range(2, n):
            state = _extend(state)
        counts, seen = materialize_with(_count(state), "seed", F.max("support").alias("best"))
        seed.known[n] = (outside, counts)
        if not tables:
            tables = [head.select(F.array("item").alias("items"), "support")]
            seed.start = seen["best"] or 1
        rules = generate_rules(_union([*tables[1:], counts]), store.total, minconf, _union(tables), n)
        tables.append(counts)
        pool, found, support, confidence = _best(rules, k, ties)
        if support:
            seed.start = support
            if all(support > bound for bound, _ in seed.known.values()):
                seed.pool, seed.last, seed.upto = pool, (support, confidence), n
            return seed
        if outside or not seen["best"]:
            break  # longer itemsets of a few items say little about a large catalogue
    return seed


def _search(
    store: BasketStore,
    k: int,
    minconf: float,
    start: int,
    max_len: int | None,
    ties: bool,
    non_redundant: bool,
    seed: _Seed,
    spare: int | None,
) -> tuple[DataFrame | None, int]:
    """One pass at a start threshold: best rules found and how many.

    Non-redundant rules are X -> Z without X for closed Z (no larger itemset has
    the same support) and minimal X (no smaller one has the same support): a
    rule that makes another redundant has the same two supports, so it can only
    differ by a smaller X or a larger Z.  Both are seen between neighbouring
    levels, hence no rule is compared with another.
    """
    tau = _Threshold(start)
    singles = _singles(store, start)
    levels, pool, found = [singles], None, 0

    def rise(support: int, confidence: float) -> None:
        # a perfect last rule can only be beaten by more support
        tau.raise_to(support + 1 if confidence == 1.0 and not ties else support)

    def offer(rules: DataFrame) -> None:
        nonlocal pool, found
        pool = rules if pool is None else pool.unionByName(rules)
        pool, found, support, confidence = _best(pool, k, ties)
        if support:
            rise(support, confidence)

    minimal = [singles]
    for n, level in _levels(store, tau, max_len, seed.known, spare):
        if not non_redundant:
            if seed.pool is None or n > seed.upto:
                offer(generate_rules(level, store.total, minconf, _union(levels), n))
            elif n == seed.upto:
                pool, found = seed.pool, k
                rise(*seed.last)
            levels.append(level)
            continue
        # neighbours with equal support: the smaller is not closed, the larger not minimal
        smaller = level.select("items", "support", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("at")).select(
            "items", "support", F.expr("filter(items, (x, i) -> i <> at)").alias("inner")
        )
        equal = materialize(
            smaller.join(levels[-1].select(F.col("items").alias("inner"), "support"), ["inner", "support"]), "equal"
        )
        if n > 2:
            closed = levels[-1].join(equal.select(F.col("inner").alias("items")), "items", "left_anti")
            offer(generate_rules(closed, store.total, minconf, _union(minimal), n - 1))
            minimal.append(last_minimal)
        last_minimal = level.join(equal, "items", "left_anti").select("items", "support")
        levels.append(level)
    if non_redundant and len(levels) > 1:
        offer(generate_rules(levels[-1], store.total, minconf, _union(minimal), len(levels)))
    return pool, found


def _mine(
    baskets: DataFrame,
    k: int,
    minconf: float,
    max_len: int | None,
    tid: str | Sequence[str],
    width: int,
    min_count: int,
    start: int | None,
    ties: bool,
    non_redundant: bool,
    heads: Mapping[int, int],
) -> DataFrame:
    _check(k, minconf)
    _check_search(min_count, start, width, max_len)
    store = prepare(baskets, tid, width)
    seed = _seed(store, k, minconf, max_len, ties, heads)
    if start is not None:
        seed.pool = None
    tau = max(start or seed.start, min_count)
    if tau > seed.start:
        seed.pool = None
    shrink = 0.8 if non_redundant else 0.5
    while True:
        lower = max(min_count, int(tau * shrink))
        # itemsets of support 1 are too many to keep for a pass that may not come
        spare = lower if seed.pool is None and lower > 1 else None
        rules, found = _search(store, k, minconf, tau, max_len, ties, non_redundant, seed, spare)
        log.info("threshold %d: %d of %d rules", tau, found, k)
        if found >= k or tau <= min_count:
            break
        tau, shrink = lower, max(0.25, shrink * 0.75)
    if rules is None:
        rules = generate_rules(_singles(store, 1), store.total, minconf, longest=1)
    return rules


def top_k_rules(
    baskets: DataFrame,
    k: int,
    minconf: float,
    ties: str = "exact",
    max_len: int | None = None,
    tid: str | Sequence[str] = "tid",
    min_count: int = 1,
    start: int | None = None,
    width: int = WIDTH,
    heads: Mapping[int, int] = HEADS,
) -> DataFrame:
    """The k rules of highest support with confidence >= ``minconf``.

    ``baskets`` holds item rows (tid, item) or baskets (tid, items).  Rules of
    equal rank are ordered by ``rule_order``; ``ties='all'`` returns every rule
    with the support of the k-th as well.  ``max_len`` limits the items of a
    rule, ``min_count`` its support.

    ``start`` overrides the first threshold; ``heads`` says for 2, 3, 4 items of
    how many most frequent items all combinations are counted to find one;
    ``width`` is the number of items above which a basket is looked up instead
    of listed.  The result depends on none of the three.
    """
    if ties not in ("exact", "all"):
        raise ValueError("ties must be 'exact' or 'all'")
    return _mine(baskets, k, minconf, max_len, tid, width, min_count, start, ties == "all", False, heads)


def top_k_nr_rules(
    baskets: DataFrame,
    k: int,
    minconf: float,
    delta: int = 0,
    exact: bool = True,
    max_len: int | None = None,
    tid: str | Sequence[str] = "tid",
    min_count: int = 1,
    start: int | None = None,
    width: int = WIDTH,
    heads: Mapping[int, int] = HEADS,
) -> DataFrame:
    """The k best rules that no other valid rule makes redundant.

    ``exact=False`` looks for redundancy only among the first k + delta valid
    rules, as a bounded buffer does.  If fewer than k rules are left, the buffer
    is doubled, until k are or all valid rules are in it; ``delta`` is its first
    room and without meaning if ``exact``.
    """
    if delta < 0:
        raise ValueError("delta must not be negative")
    if not exact:
        _check(k, minconf)
        room = k + delta
        while True:
            pool = top_k_rules(baskets, room, minconf, "exact", max_len, tid, min_count, start, width, heads)
            pool, seen = materialize_with(pool, "buffer", F.count("*").alias("n"))
            best, left = materialize_with(drop_redundant(pool), "kept", F.count("*").alias("n"))
            if left["n"] >= k or seen["n"] < room:
                return best.orderBy(*rule_order()).limit(k)
            room *= 2
    return _mine(baskets, k, minconf, max_len, tid, width, min_count, start, False, True, heads)


def _check_search(min_count: int, start: int | None, width: int, max_len: int | None) -> None:
    for name, value, least in (("min_count", min_count, 1), ("start", start, 1), ("width", width, 1), ("max_len", max_len, 2)):
        if value is not None and value < least:
            raise ValueError(f"{name} must be at least {least}")


def _check(k: int, minconf: float) -> None:
    if not isinstance(k, int) or isinstance(k, bool) or k < 1:
        raise ValueError("k must be an integer of at least 1")
    if not 0 <= minconf <= 1:
        raise ValueError("minconf must lie between 0 and 1")


ALGORITHMS = {"TOPK": ("k", "minconf"), "TOPKNR": ("k", "minconf", "delta")}


def check_parameters(algorithm: str, params: Mapping) -> None:
    """Refuse an unknown algorithm name, or one without all it needs."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}, expected one of {sorted(ALGORITHMS)}")
    missing = [name for name in ALGORITHMS[algorithm] if params.get(name) is None]
    if missing:
        raise ValueError(f"missing parameters for {algorithm}: {', '.join(missing)}")


def mine(baskets: DataFrame, algorithm: str, **params) -> DataFrame:
    """Mine with the algorithm of the given name, ``TOPK`` or ``TOPKNR``."""
    check_parameters(algorithm, params)
    if algorithm == "TOPK":
        params.pop("delta", None)
        return top_k_rules(baskets, **params)
    return top_k_nr_rules(baskets, **params)
