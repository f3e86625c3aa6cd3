"""The same queries as SQL, where SQL can express them."""

from __future__ import annotations

from basketry.llm.queries import URL_RULES
from basketry.llm.urls import SOFT, STRICT

MIX = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sizes GROUP BY source
), level AS (
  SELECT *, row_number() OVER o AS place,
    coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS size_before,
    coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before
  FROM sources WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)
), rates AS (
  SELECT *, (1.5 * (SELECT sum(source_size) FROM sources)::DOUBLE - 2 * size_before::DOUBLE)
    / ((SELECT sum(weight) FROM sources)::DOUBLE - weight_before::DOUBLE) AS rate
  FROM level
), cut AS (
  SELECT min(place) AS place, min_by(rate, place) AS rate FROM rates WHERE rate * weight <= 2 * source_size
), targets AS (
  SELECT source, source_size, CASE WHEN level.place < cut.place THEN 2.0::DOUBLE * source_size ELSE cut.rate * weight END AS target,
    (('0x' || substr(md5('mix:' || coalesce(source, 'null')), 1, 4))::BIGINT)::DOUBLE / 65536 AS start
  FROM level, cut
), places AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS LAST) - 1 AS place FROM sizes
)
SELECT doc_id, size, source_size, target,
  (least(floor((place + 1) * (target / source_size) + start) - floor(place * (target / source_size) + start), 2))::BIGINT * size AS taken
FROM places JOIN targets ON places.source IS NOT DISTINCT FROM targets.source
"""


def _url_sql() -> str:
    # terms are letters only, so an occurrence with free borders is a whole run of letters and digits
    runs = "string_split_regex(lower(url), '[^a-z0-9]+')"
    strict = f"len(list_filter({runs}, lambda x: x IN ({', '.join(repr(t) for t in STRICT)})))"
    soft = f"len(list_distinct(list_filter({runs}, lambda x: x IN ({', '.join(repr(t) for t in SOFT)}))))"
    rules = ", ".join(
        f"('{name}', '{name.partition('/')[0]}', '/{name.partition('/')[2]}', '{verdict}')" for name, verdict in URL_RULES.items()
    )
    return rf"""
WITH rules(rule, rule_host, rule_path, decision) AS (VALUES {rules}),
parts AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), best AS (
  SELECT page_id, host, path, max_by(rule, length(rule) * 1000 + length(rule_host)) AS rule,
    max_by(decision, length(rule) * 1000 + length(rule_host)) AS decision
  FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY ALL
), counts AS (
  SELECT page_id, host, path, coalesce({strict}, 0)::BIGINT AS n_strict, coalesce({soft}, 0)::BIGINT AS n_soft FROM split
)
SELECT counts.page_id, counts.host, counts.path, rule, n_strict, n_soft,
  coalesce(decision, CASE WHEN n_strict >= 1 OR n_soft >= 2 THEN 'block' ELSE 'allow' END) AS verdict
FROM counts LEFT JOIN best USING (page_id)
"""


NEAR = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, least(len(w), 1)))) AS i FROM words)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)
"""


REPEATS = """
WITH texts AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), starts AS (
  SELECT doc_id, unnest(range(0, length(h) // 2 - 99)) AS i,
    unnest(list_transform(range(0, length(h) // 2 - 99), lambda i: hash(substr(h, 2 * i + 1, 200)))) AS s
  FROM texts WHERE length(h) >= 200
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM starts) WHERE n > 1
), steps AS (
  SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true) AS fresh FROM later
), runs AS (
  SELECT doc_id, min(i) AS low, max(i) + 100 AS high
  FROM (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM steps) GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, low, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS since, high,
    lead(low) OVER (PARTITION BY doc_id ORDER BY low) IS NULL AS last FROM runs
), kept AS (
  SELECT doc_id, sum(high - low)::BIGINT AS n_removed, count(*) AS n_spans,
    string_agg(substr(h, 2 * since + 1, 2 * (low - since)) || CASE WHEN last THEN substr(h, 2 * high + 1) ELSE '' END, '' ORDER BY low) AS k
  FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""


LEAKS = r"""
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS s
  FROM (SELECT *, unnest(generate_series(1, len(w) - size + 1)) AS i FROM (SELECT *, least(len(w), 10) AS size FROM items WHERE len(w) > 0))
), runs AS (
  SELECT row, i, size, array_to_string(w[i:i + size - 1], ' ') AS s
  FROM (SELECT row, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM texts, (SELECT DISTINCT size FROM windows))
), hits AS (
  SELECT row, i, size, item_id FROM runs JOIN windows USING (size, s)
), covered AS (
  SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(generate_series(i, i + size - 1)) AS place FROM hits) GROUP BY row
), held AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT row, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN covered USING (row) LEFT JOIN held USING (row)
"""

KEPT_VECTORS = """kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)"""


def _nearest_sql(points: str, entries: str, keys: str) -> str:
    """The lowest squared distance of each point, times 1024, plus its entry: whole numbers that DOUBLE holds exactly."""
    using = f"USING ({keys})" if keys else "ON true"
    by = f"row, {keys}" if keys else "row"
    apart = "list_inner_product(a.x, a.x) - 2 * list_inner_product(a.x, b.x) + list_inner_product(b.x, b.x)"
    return f"SELECT {by}, min(({apart})::BIGINT * 1024 + entry) AS best FROM {points} a JOIN {entries} b {using} GROUP BY ALL"


def _means_sql(points: str, nearest: str, entries: str, keys: str) -> str:
    """Entries at the floor of the mean of their points, or where they were."""
    by, both = (f"{keys}, entry", f"row, {keys}") if keys else ("entry", "row")
    return f"""
  SELECT {by}, coalesce(m.x, e.x) AS x FROM {entries} e LEFT JOIN (
    SELECT {by}, list(mean ORDER BY i) AS x FROM (
      SELECT {by}, i, floor(sum(c) / count(*)) AS mean
      FROM (SELECT {by}, unnest(x) AS c, unnest(range(len(x))) AS i FROM (SELECT {by}, x FROM {points} JOIN (SELECT *, best % 1024 AS entry FROM {nearest}) USING ({both})))
      GROUP BY ALL) GROUP BY ALL) m USING ({by})"""


def _rounds_sql(rounds: int, keys: str) -> str:
    steps = []
    for n in range(rounds):
        steps.append(f"near{n} AS MATERIALIZED ({_nearest_sql('points', f'book{n}', keys)})")
        steps.append(f"book{n + 1} AS MATERIALIZED ({_means_sql('points', f'near{n}', f'book{n}', keys)})")
    steps.append(f"last AS MATERIALIZED ({_nearest_sql('points', f'book{rounds}', keys)})")
    return ",\n".join(steps)


CODES = f"""
WITH {KEPT_VECTORS}, points AS MATERIALIZED (
  SELECT row, part, v[part * (len(v) // 4) + 1:(part + 1) * (len(v) // 4)] AS x FROM kept, (SELECT unnest(range(4)) AS part)
), book0 AS MATERIALIZED (
  SELECT part, entry, x FROM points JOIN (SELECT row, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept) USING (row) WHERE entry < 256
), {_rounds_sql(4, "part")}, coded AS (
  SELECT row, string_agg(lower(format('{{:02x}}', best % 1024)), '' ORDER BY part) AS code, sum(best // 1024)::BIGINT AS error FROM last GROUP BY row
), digest AS (
  SELECT sha256(string_agg(array_to_string(list_transform(x, lambda c: c::BIGINT::VARCHAR), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book4
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (row), digest
"""

CENTROIDS = f"""
WITH {KEPT_VECTORS}, points AS MATERIALIZED (
  SELECT row, v AS x FROM kept WHERE len(v) = 64
), book0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR)) - 1 AS entry, x FROM points JOIN kept USING (row) ORDER BY entry LIMIT 8
), {_rounds_sql(10, "")}
SELECT vec_id, (best % 1024)::INT AS cluster, (best // 1024)::BIGINT AS distance,
  (sum(best // 1024) OVER (PARTITION BY best % 1024))::BIGINT AS cluster_inertia, (sum(best // 1024) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(book10.x, lambda c: c::BIGINT::VARCHAR), ',')) AS centroid_sha256
FROM last JOIN kept USING (row) JOIN book10 ON entry = best % 1024
"""

ORACLES = {
    "op7_suffix_dedup": REPEATS,
    "op1_minhash_dedup": NEAR,
    "op9_mix_sources": MIX,
    "op10_url_filter": _url_sql(),
    "op11_decontamination": LEAKS,
    "op12_vector_codes": CODES,
    "op13_centroids": CENTROIDS,
}
