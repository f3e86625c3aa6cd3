"""The same results as SQL over the test tables.

Itemsets are counted by listing all subsets of all baskets, rules by listing all
splits of all itemsets: no threshold, no level, nothing shared with the library.
"""

from __future__ import annotations

BRANDS = "b AS (SELECT DISTINCT l_orderkey AS tid, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"
PARTS = "b AS (SELECT DISTINCT l_orderkey AS tid, l_partkey AS item FROM lineitem)"
ATTRIBUTES = """o AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
b AS (SELECT o_orderkey AS tid, 'nation=' || c_nationkey AS item FROM o
  UNION ALL SELECT o_orderkey, 'region=' || n_regionkey FROM o
  UNION ALL SELECT o_orderkey, 'seg=' || c_mktsegment FROM o
  UNION ALL SELECT o_orderkey, 'status=' || o_orderstatus FROM o)"""
PROFILE = """o AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey),
b AS (SELECT o_orderkey AS tid, 'prio=' || o_orderpriority AS item FROM o
  UNION ALL SELECT o_orderkey, 'status=' || o_orderstatus FROM o
  UNION ALL SELECT o_orderkey, 'seg=' || c_mktsegment FROM o
  UNION ALL SELECT o_orderkey, 'nation=' || c_nationkey FROM o)"""
USER_DAYS = """e AS (SELECT user_id, event_type, ts, date_trunc('day', ts) AS d FROM events),
b AS (SELECT DISTINCT user_id || '|' || d AS tid, event_type AS item FROM e)"""
# a day is closed once the newest event is an hour past its end
CLOSED_DAYS = """e AS (SELECT user_id, event_type, ts, date_trunc('day', ts) AS d FROM events
  WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)),
b AS (SELECT DISTINCT user_id || '|' || d AS tid, event_type AS item FROM e)"""

LISTS = "lists AS (SELECT tid, list(item ORDER BY item) AS l FROM b GROUP BY tid)"
PAIRS = """pairs AS (SELECT x.item AS a, y.item AS b, count(*) AS support
  FROM b x JOIN b y ON x.tid = y.tid AND x.item < y.item GROUP BY 1, 2)"""


def _sets(max_len: int | None = None) -> str:
    cap = "" if max_len is None else f" WHERE bit_count(m) <= {max_len}"
    return f"""{LISTS},
sets AS (SELECT items, count(*) AS support
  FROM (SELECT list_filter(l, lambda x, i: (m >> (i - 1)) & 1 = 1) AS items
    FROM (SELECT l, unnest(range(1, 1 << len(l))) AS m FROM lists){cap}) GROUP BY items)"""


def _rules(minconf: float, max_len: int | None = None, min_count: int = 1) -> str:
    return f"""{_sets(max_len)},
total AS (SELECT count(DISTINCT tid) AS total FROM b),
splits AS (SELECT items, support, list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 1) AS antecedent,
    list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 0) AS consequent
  FROM (SELECT items, support, unnest(range(1, (1 << len(items)) - 1)) AS m FROM sets
    WHERE len(items) > 1 AND support >= {min_count})),
rules AS (SELECT s.antecedent, s.consequent, s.support, a.support AS antecedent_support, total,
    s.support / a.support AS confidence
  FROM splits s JOIN sets a ON a.items = s.antecedent, total WHERE s.support / a.support >= {minconf})"""


def _pair_rules(minconf: float) -> str:
    return f"""{PAIRS},
one AS (SELECT item, count(*) AS n FROM b GROUP BY item),
both_ways AS (SELECT a AS x, b AS y, support FROM pairs UNION ALL SELECT b, a, support FROM pairs),
rules AS (SELECT [x] AS antecedent, [y] AS consequent, support, n AS antecedent_support,
    (SELECT count(DISTINCT tid) FROM b) AS total, support / n AS confidence
  FROM both_ways JOIN one ON item = x WHERE support / n >= {minconf})"""


RANK = "support DESC, confidence DESC, len(antecedent) + len(consequent), antecedent, consequent"


def _top(k: int, source: str = "rules", name: str = "best") -> str:
    return f"{name} AS (SELECT * FROM {source} ORDER BY {RANK} LIMIT {k})"


def _text(column: str) -> str:
    return f"array_to_string({column}, ',')"


RULE_COLUMNS = f"""{_text('antecedent')} AS antecedent, {_text('consequent')} AS consequent, support,
  antecedent_support, total, round(confidence, 10) AS confidence"""


def _redundant(table: str, more: str = "") -> str:
    return f"""EXISTS (SELECT 1 FROM {table} o WHERE {more}o.support = r.support
    AND o.antecedent_support = r.antecedent_support
    AND list_has_all(r.antecedent, o.antecedent) AND list_has_all(o.consequent, r.consequent)
    AND NOT (o.antecedent = r.antecedent AND o.consequent = r.consequent))"""


def _match(rules: str, min_weight: float, side: str = "antecedent") -> str:
    """Rules that match the last transaction of each customer."""
    return f"""matched AS (SELECT 's1' AS site, u.o_custkey AS "user", r.*,
    len(list_intersect(u.held, r.{side})) / len(r.{side}) AS weight
  FROM users u, {rules} r WHERE len(list_intersect(u.held, r.{side})) > 0
    AND len(list_intersect(u.held, r.{side})) / len(r.{side}) >= {min_weight})"""


BEST_BRANDS = f"{BRANDS}, {_rules(0.1)}, {_top(100)}"
LAST = """bought AS (SELECT o_custkey, o_orderkey, o_orderdate, p_brand FROM lineitem
  JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
latest AS (SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM bought) WHERE rn = 1),
last AS (SELECT DISTINCT o_custkey, o_orderkey, p_brand FROM bought JOIN latest USING (o_custkey, o_orderkey)),
users AS (SELECT o_custkey, list(p_brand) AS held FROM last GROUP BY o_custkey)"""
USER_RULE_COLUMNS = f"""site, "user", {_text('antecedent')} AS antecedent, {_text('consequent')} AS consequent,
  support, round(confidence, 10) AS confidence, round(weight, 10) AS weight"""


def _weighted(side: str) -> str:
    share = f"len(list_intersect({side}, ['Brand#25', 'Brand#4'])) / len({side})"
    return f"WITH {BEST_BRANDS} SELECT {RULE_COLUMNS}, round({share}, 10) AS weight FROM best WHERE {share} >= 0.5"


def _norm(side: str) -> str:
    return f"SELECT '{side}' AS side, unnest({side}) AS item, support, total FROM best"


ORACLES: dict[str, str] = {
    "read_items": """SELECT l_linestatus AS site, CAST(l_suppkey AS VARCHAR) AS "user",
  CAST(l_orderkey AS VARCHAR) AS "group", CAST(l_partkey AS INTEGER) AS item,
  strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem""",
    "map_fields": """SELECT 's1' AS site, o_custkey AS "user", o_orderkey AS "group", p_brand AS item,
  strftime(o_orderdate, '%Y-%m-%d') AS day
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""",
    "parse_spmf": f"WITH {PARTS}, {LISTS} SELECT tid, {_text('l')} AS items, CAST(len(l) AS INTEGER) AS n FROM lists",
    "index_lines": f"""WITH {PARTS}, {LISTS},
numbered AS (SELECT row_number() OVER (ORDER BY tid) - 1 AS no, array_to_string(l, ' ') AS line FROM lists)
SELECT no, line, no || ',' || line AS value FROM numbered""",
    "to_baskets": f"WITH {PARTS}, {LISTS} SELECT tid, {_text('l')} AS items, CAST(len(l) AS INTEGER) AS n FROM lists",
    "assign_tids": f"""WITH {PARTS}, {LISTS} SELECT row_number() OVER (ORDER BY tid) - 1 AS tid, tid AS l_orderkey,
  {_text('l')} AS items FROM lists""",
    "sort_items": f"WITH {PARTS}, {LISTS} SELECT tid, {_text('list_reverse(l)')} AS items FROM lists",
    "explode_baskets": f"WITH {PARTS} SELECT tid, item FROM b",
    "basket_profile": f"""WITH {PARTS} SELECT count(DISTINCT tid) AS n_baskets, count(DISTINCT item) AS n_items,
  count(*) AS n_pairs, min(item) AS min_item, max(item) AS max_item, max(item) - min(item) + 1 AS item_range FROM b""",
    "vertical_index": f"""WITH {PARTS} SELECT item, tid // 4096 AS block,
  {_text('list(tid ORDER BY tid)')} AS tids, count(*) AS n FROM b GROUP BY 1, 2""",
    "item_support": f"WITH {BRANDS} SELECT item, count(*) AS support FROM b GROUP BY item",
    "item_occurrences": "SELECT l_partkey AS item, count(*) AS occurrences FROM lineitem GROUP BY 1",
    "pair_support": f"WITH {BRANDS}, {PAIRS} SELECT a, b, support FROM pairs WHERE support >= 60",
    "pair_support_parts": f"WITH {PARTS}, {PAIRS} SELECT a, b, support FROM pairs WHERE support >= 2",
    "itemset_support": f"WITH {BRANDS}, {PAIRS} SELECT a || ',' || b AS items, support FROM pairs WHERE support >= 60",
    "frequent_itemsets": f"""WITH {BRANDS}, {_sets()} SELECT {_text('items')} AS items,
  CAST(len(items) AS INTEGER) AS size, support FROM sets WHERE support >= 60""",
    "generate_rules": f"WITH {BRANDS}, {_rules(0.1, None, 60)} SELECT {RULE_COLUMNS} FROM rules",
    "top_k_rules_brand": f"WITH {BRANDS}, {_rules(0.1)}, {_top(20)} SELECT {RULE_COLUMNS} FROM best",
    "top_k_rules_multi": f"WITH {BRANDS}, {_rules(0.2)}, {_top(20)} SELECT {RULE_COLUMNS} FROM best",
    "top_k_rules_parts": f"WITH {PARTS}, {_rules(0.1)}, {_top(20)} SELECT {RULE_COLUMNS} FROM best",
    "top_k_rules_ties": f"""WITH {BRANDS}, {_rules(0.1)} SELECT {RULE_COLUMNS} FROM rules
QUALIFY rank() OVER (ORDER BY support DESC) <= 10""",
    "attribute_rules": f"WITH {PROFILE}, {_rules(0.2)}, {_top(20)} SELECT {RULE_COLUMNS} FROM best",
    "top_k_nr_rules": f"""WITH {ATTRIBUTES}, {_rules(0.3)},
kept AS (SELECT * FROM rules r WHERE NOT {_redundant('rules')}), {_top(100, 'kept')} SELECT {RULE_COLUMNS} FROM best""",
    # the buffer doubles until 100 rules are left in it
    "top_k_nr_buffer": f"""WITH {ATTRIBUTES}, {_rules(0.3)},
ranked AS (SELECT *, row_number() OVER (ORDER BY {RANK}) AS place FROM rules),
rooms AS (SELECT unnest([120, 240, 480, 960]) AS room),
buffer AS (SELECT * FROM rooms JOIN ranked ON place <= room),
kept AS (SELECT * FROM buffer r WHERE NOT {_redundant('buffer', 'o.room = r.room AND ')}),
enough AS (SELECT min(room) AS room FROM (SELECT room FROM kept GROUP BY room HAVING count(*) >= 100)),
fitting AS (SELECT kept.* FROM kept JOIN enough USING (room)), {_top(100, 'fitting')} SELECT {RULE_COLUMNS} FROM best""",
    "drop_redundant": f"""WITH {ATTRIBUTES}, {_rules(0.3)}
SELECT {RULE_COLUMNS} FROM rules r WHERE NOT {_redundant('rules')}""",
    "rule_relative_support": f"""WITH {BEST_BRANDS}
SELECT {RULE_COLUMNS}, round(support / total, 10) AS relative_support FROM best""",
    "rules_by_antecedent": _weighted("antecedent"),
    "rules_by_consequent": _weighted("consequent"),
    "classifier_rules": f"""WITH {ATTRIBUTES}, {_rules(0.3)} SELECT {_text('antecedent')} AS antecedent,
  unnest(consequent) AS consequent, support, round(confidence, 10) AS confidence,
  round(1.0 / len(consequent), 10) AS weight FROM rules""",
    "get_rules": f"WITH {BEST_BRANDS} SELECT {RULE_COLUMNS} FROM best",
    "rules_json_roundtrip": f"WITH {BEST_BRANDS} SELECT {RULE_COLUMNS} FROM best",
    "rules_parquet_roundtrip": f"WITH {BEST_BRANDS} SELECT {RULE_COLUMNS} FROM best",
    "rules_norm_items": f"""WITH {BEST_BRANDS},
parts AS ({_norm('antecedent')} UNION ALL {_norm('consequent')})
SELECT 'run-1' AS uid, 1700000000000 AS timestamp, side, item, support, total, count(*) AS rules
FROM parts GROUP BY side, item, support, total""",
    "rules_as_documents": f"""WITH {BEST_BRANDS} SELECT 'run-1' AS uid, 1700000000000 AS timestamp,
  {_text('antecedent')} AS antecedent, {_text('consequent')} AS consequent, support,
  round(confidence, 10) AS confidence, total FROM best""",
    "last_transaction": f"""WITH {LAST} SELECT 's1' AS site, o_custkey AS "user", o_orderkey AS "group",
  p_brand AS item FROM last""",
    "user_rules": f"WITH {BEST_BRANDS}, {LAST}, {_match('best', 1.0)} SELECT {USER_RULE_COLUMNS} FROM matched",
    "user_rules_partial": f"""WITH {BRANDS}, {_rules(0.2)}, {_top(20)}, {LAST}, {_match('best', 0.5)}
SELECT {USER_RULE_COLUMNS} FROM matched""",
    "matched_consequents": f"""WITH {BEST_BRANDS}, {LAST}, {_match('best', 0.5, 'consequent')}
SELECT {USER_RULE_COLUMNS} FROM matched""",
    "nest_user_rules": f"""WITH {BEST_BRANDS}, {LAST}, {_match('best', 1.0)}
SELECT site, "user", CAST(count(*) AS INTEGER) AS n, string_agg({_text('antecedent')} || '>' || {_text('consequent')}, ';'
  ORDER BY weight DESC, confidence DESC, support DESC, antecedent, consequent) AS rules
FROM matched GROUP BY site, "user\"""",
    "recommend_items": f"""WITH {BEST_BRANDS}, {LAST}, {_match('best', 1.0)},
offers AS (SELECT site, "user", unnest(consequent) AS item, weight, confidence, support FROM matched),
fresh AS (SELECT * FROM offers o WHERE NOT EXISTS
  (SELECT 1 FROM last l WHERE l.o_custkey = o."user" AND l.p_brand = o.item)),
one AS (SELECT *, row_number() OVER (PARTITION BY "user", item ORDER BY weight DESC, confidence DESC, support DESC) AS rn
  FROM fresh),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY "user"
  ORDER BY weight DESC, confidence DESC, support DESC, item) AS INTEGER) AS rank FROM one WHERE rn = 1)
SELECT site, "user", item, round(confidence, 10) AS confidence, support, rank FROM ranked WHERE rank <= 3""",
    "expand_queries": f"""WITH words AS (SELECT DISTINCT conv_id, turn, item FROM
  (SELECT conv_id, turn, unnest(string_split(lower(text), ' ')) AS item FROM conversations WHERE role = 'user')
  WHERE len(item) > 0),
b AS (SELECT conv_id || '|' || turn AS tid, item FROM words), {_pair_rules(0.3)}, {_top(200)},
extra AS (SELECT DISTINCT conv_id, turn, consequent[1] AS item FROM words JOIN best ON item = antecedent[1])
SELECT conv_id, turn, item AS term, false AS added FROM words
UNION ALL SELECT conv_id, turn, item, true FROM extra e WHERE NOT EXISTS
  (SELECT 1 FROM words w WHERE w.conv_id = e.conv_id AND w.turn = e.turn AND w.item = e.item)""",
    "discount_conflicts": f"""WITH {PARTS}, {PAIRS},
sums AS (SELECT l_partkey AS item, sum(CAST(l_discount AS DECIMAL(18,6))) AS s, count(*) AS n FROM lineitem GROUP BY 1),
means AS (SELECT item, CAST(s AS DOUBLE) / n AS d FROM sums WHERE s >= CAST(0.05 AS DECIMAL(18,6)) * n)
SELECT a, b, support, round(x.d, 10) AS discount_a, round(y.d, 10) AS discount_b
FROM pairs JOIN means x ON x.item = a JOIN means y ON y.item = b WHERE support >= 2""",
    "best_partner": f"""WITH {PARTS}, {_pair_rules(0.0)},
ranked AS (SELECT antecedent[1] AS item, consequent[1] AS partner, support, confidence, CAST(row_number() OVER
  (PARTITION BY antecedent ORDER BY confidence DESC, support DESC, consequent) AS INTEGER) AS rank
  FROM rules WHERE support >= 2)
SELECT item, partner, support, round(confidence, 10) AS confidence, rank FROM ranked WHERE rank = 1""",
    "bundles": f"""WITH {PARTS}, {_sets()},
members AS (SELECT unnest(items) AS item, items, support FROM sets WHERE len(items) > 1 AND support >= 2),
ranked AS (SELECT *, CAST(row_number() OVER
  (PARTITION BY item ORDER BY support DESC, len(items), items) AS INTEGER) AS rank FROM members)
SELECT item, {_text('items')} AS items, support, rank FROM ranked WHERE rank = 1""",
    "basket_item_counts": """SELECT l_orderkey AS tid, l_partkey AS item, count(*) AS n,
  l_partkey - (SELECT min(l_partkey) FROM lineitem) AS position FROM lineitem GROUP BY 1, 2""",
    "cluster_baskets": "SELECT o_orderkey AS tid, min(o_orderkey) OVER (PARTITION BY o_orderstatus) AS cluster FROM orders",
    "cluster_lines": """WITH lines AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS no, o_orderpriority[1] AS line FROM orders)
SELECT min(no) || '|' || line AS value, count(*) AS n FROM lines GROUP BY line""",
    "user_day_baskets": f"""WITH {USER_DAYS} SELECT user_id AS "user", strftime(d, '%Y-%m-%d') AS day,
  {_text('list(DISTINCT event_type ORDER BY event_type)')} AS items FROM e GROUP BY user_id, d""",
    "user_session_baskets": f"""WITH gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE
  THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS s FROM gaps)
SELECT user_id AS "user", epoch_us(min(ts)) AS start_us,
  {_text('list(DISTINCT event_type ORDER BY event_type)')} AS items FROM numbered GROUP BY user_id, s""",
    "stream_track": """SELECT 'web' AS site, user_id AS "user", strftime(ts, '%Y-%m-%d') AS "group",
  event_type AS item, epoch_us(ts) AS ts_us FROM events""",
    "stream_baskets": f"""WITH {CLOSED_DAYS} SELECT user_id AS "user", strftime(d, '%Y-%m-%d') AS day,
  {_text('list(DISTINCT event_type ORDER BY event_type)')} AS items FROM e GROUP BY user_id, d""",
    "stream_pair_support": f"WITH {CLOSED_DAYS}, {PAIRS} SELECT a, b, CAST(support AS BIGINT) AS support FROM pairs",
    "stream_mine": f"WITH {CLOSED_DAYS}, {_rules(0.3)}, {_top(20)} SELECT {RULE_COLUMNS} FROM best",
    "stream_recommend": f"""WITH {USER_DAYS}, {_rules(0.3)}, {_top(20)},
closed AS (SELECT user_id, d, list(DISTINCT event_type) AS held FROM e
  WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY user_id, d),
offers AS (SELECT user_id, d, held, unnest(consequent) AS item, confidence, support
  FROM closed, best WHERE list_has_all(held, antecedent)),
one AS (SELECT *, row_number() OVER (PARTITION BY user_id, d, item ORDER BY confidence DESC, support DESC) AS rn
  FROM offers WHERE NOT list_contains(held, item)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, d
  ORDER BY confidence DESC, support DESC, item) AS INTEGER) AS rank FROM one WHERE rn = 1)
SELECT user_id AS "user", strftime(d, '%Y-%m-%d') AS day, item, round(confidence, 10) AS confidence, support, rank
FROM ranked WHERE rank <= 3""",
}
ORACLES["user_rules_json_roundtrip"] = ORACLES["nest_user_rules"]
# how the events were dealt to batches does not show in the result
ORACLES["stream_pair_support_batches"] = ORACLES["stream_pair_support"]
ORACLES["stream_mine_batches"] = ORACLES["stream_mine"]
ORACLES["incremental_rules"] = ORACLES["top_k_rules_brand"]
# id t > 0 is bit (t - 1) % 32768 of block 1 + (t - 1) // 32768, the lowest bit of a byte first
ORACLES["vertical_bitmap"] = f"""WITH {PARTS}, spots AS (
  SELECT item, CASE WHEN tid > 0 THEN 1 + (tid - 1) // 32768 ELSE -(-tid // 32768) END AS block,
    CASE WHEN tid > 0 THEN (tid - 1) % 32768 ELSE -tid % 32768 END AS spot FROM b
), bits AS (
  SELECT item, block, spot // 8 AS byte, sum(1 << (spot % 8))::INT AS value, count(*) AS n FROM spots GROUP BY ALL
), cells AS (
  SELECT item, block, sum(n)::BIGINT AS n, list(byte ORDER BY byte) AS places, list(format('{{:02x}}', value) ORDER BY byte) AS hex FROM bits GROUP BY ALL
)
SELECT item, block, n, sha256(unhex(array_to_string(list_transform(range(len(places)),
  lambda i: repeat('00', places[i + 1] - CASE WHEN i = 0 THEN 0 ELSE places[i] + 1 END) || hex[i + 1]), '') || repeat('00', 4095 - places[-1]))) AS bits_sha256
FROM cells"""
ORACLES["itemset_support_bitmap"] = f"""WITH {BRANDS}, {_sets(3)} SELECT {_text('items')} AS items, support
FROM sets WHERE len(items) > 1 AND support >= 60"""
# the subsets are counted once and rare ones dropped before they are split
ORACLES["generate_rules"] = ORACLES["generate_rules"].replace(
    "sets AS (SELECT items", "sets AS MATERIALIZED (SELECT items", 1
).replace("FROM lists)) GROUP BY items)", "FROM lists)) GROUP BY items HAVING count(*) >= 60)", 1)
ORACLES["stream_last_transaction"] = f"""WITH days AS (
  SELECT user_id, date_trunc('day', ts) AS d, max(ts) AS ts, {_text('list(DISTINCT event_type ORDER BY event_type)')} AS items FROM events GROUP BY ALL
)
SELECT user_id AS "user", strftime(d, '%Y-%m-%d') AS day, epoch_us(ts) AS ts_us, items FROM days
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1"""
ORACLES["indexed_user_rules"] = ORACLES["user_rules"]
ORACLES["indexed_consequents"] = ORACLES["matched_consequents"]
# the first half of the events closes days while version 0 is the latest, the second half the others with version 1
ORACLES["stream_recommend_versions"] = f"""WITH {USER_DAYS}, {_rules(0.3)}, {_top(20, name='best_0')},
{_top(20, '(SELECT * FROM rules WHERE confidence >= 0.5)', 'best_1')},
best AS (SELECT *, 0 AS rules_version FROM best_0 UNION ALL SELECT *, 1 FROM best_1),
half AS (SELECT max(ts) AS upto FROM events WHERE epoch_us(ts) < (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 FROM events)),
closed AS (SELECT user_id, d, list(DISTINCT event_type) AS held,
    CASE WHEN d + INTERVAL 1 DAY <= (SELECT upto - INTERVAL 1 HOUR FROM half) THEN 0 ELSE 1 END AS rules_version FROM e
  WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY user_id, d),
offers AS (SELECT user_id, d, held, unnest(consequent) AS item, confidence, support, rules_version
  FROM closed JOIN best USING (rules_version) WHERE list_has_all(held, antecedent)),
one AS (SELECT *, row_number() OVER (PARTITION BY user_id, d, item ORDER BY confidence DESC, support DESC) AS rn
  FROM offers WHERE NOT list_contains(held, item)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, d
  ORDER BY confidence DESC, support DESC, item) AS INTEGER) AS rank FROM one WHERE rn = 1)
SELECT user_id AS "user", strftime(d, '%Y-%m-%d') AS day, item, round(confidence, 10) AS confidence, support, rank, rules_version
FROM ranked WHERE rank <= 3"""
ORACLES["joined_attribute_rules"] = f"""WITH cuts AS (SELECT quantile_disc(c_acctbal, [0.25, 0.5, 0.75]) AS q FROM customer),
b AS (SELECT c_custkey AS tid, 'seg=' || c_mktsegment AS item FROM customer
  UNION SELECT c_custkey, 'balance~' || len(list_filter(q, lambda x: x < c_acctbal)) FROM customer, cuts
  UNION SELECT o_custkey, 'status=' || o_orderstatus FROM orders
  UNION SELECT o_custkey, 'prio=' || o_orderpriority FROM orders),
{_rules(0.3)}, {_top(100)} SELECT {RULE_COLUMNS} FROM best"""
ORACLES["checked_lines"] = f"""WITH {PARTS}, {LISTS}, lines AS (
  SELECT tid, l, tid % 10 AS c, array_to_string(l, ' ') AS rest FROM lists)
SELECT CASE WHEN c NOT IN (3, 5, 7, 9) THEN tid END AS tid, CASE WHEN c NOT IN (3, 5, 7, 9) THEN {_text('l')} END AS items,
  CASE c WHEN 3 THEN tid || ';' || rest WHEN 5 THEN tid || ',p ' || rest WHEN 7 THEN '99999999999999999999' || tid || ',' || rest
    WHEN 9 THEN ' ,' || rest END AS record,
  CASE c WHEN 3 THEN 'no comma;cast: tid' WHEN 5 THEN 'cast: item' WHEN 7 THEN 'cast: tid' WHEN 9 THEN 'null: tid' END AS reasons
FROM lines"""
ORACLES["checked_items"] = """SELECT 'good' AS reason, count(*) AS n, sum(event_id)::BIGINT AS items FROM events WHERE event_id % 3 = 1
UNION ALL SELECT CASE WHEN event_id % 3 = 0 THEN 'cast: item' ELSE 'null: item' END, count(*), NULL FROM events WHERE event_id % 3 <> 1 GROUP BY 1"""


def _lloyd(rounds: int, k: int) -> str:
    """Rounds of nearest centre and mean over (tid, item, n); a centre is its baskets' summed counts and their number."""
    steps = [f"""points AS MATERIALIZED (SELECT l_orderkey AS tid, p_brand AS item, count(*) AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
starts AS (SELECT tid, row_number() OVER (ORDER BY md5('start:' || tid), tid) - 1 AS cluster FROM (SELECT DISTINCT tid FROM points)),
centre0 AS (SELECT cluster, item, n AS s, 1 AS m FROM points JOIN starts USING (tid) WHERE cluster < {k})"""]
    for n in range(rounds + 1):
        steps.append(f"""near{n} AS MATERIALIZED (SELECT tid, cluster, away FROM (
  SELECT tid, cluster, ss / (m::DOUBLE * m) - 2 * coalesce(xs, 0)::DOUBLE / m AS away
  FROM (SELECT DISTINCT tid FROM points) CROSS JOIN (SELECT cluster, m, sum(s * s)::DOUBLE AS ss FROM centre{n} GROUP BY ALL)
    LEFT JOIN (SELECT tid, cluster, sum(n * s) AS xs FROM points JOIN centre{n} USING (item) GROUP BY ALL) USING (tid, cluster))
  QUALIFY row_number() OVER (PARTITION BY tid ORDER BY away, cluster) = 1)""")
        steps.append(f"""centre{n + 1} AS MATERIALIZED (SELECT cluster, item, sum(n) AS s, m FROM points JOIN near{n} USING (tid)
    JOIN (SELECT cluster, count(*) AS m FROM near{n} GROUP BY cluster) USING (cluster) GROUP BY ALL
  UNION ALL SELECT * FROM centre{n} WHERE cluster NOT IN (SELECT cluster FROM near{n}))""")
    return ",\n".join(steps[:-1])


ORACLES["cluster_brand_counts"] = f"""WITH {_lloyd(5, 3)}
SELECT tid, cluster::INT AS cluster, round(greatest(xx::DOUBLE + away, 0), 6) AS distance
FROM near5 JOIN (SELECT tid, sum(n * n) AS xx FROM points GROUP BY tid) USING (tid)"""
