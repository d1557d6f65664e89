"""DuckDB SQL that gives the rows of each registered query."""

from __future__ import annotations

from kinweave.functions.scalars import URL_HOST_PATTERN

ORACLES: dict[str, str] = {}

# The R1 token rule: leading empty token kept, trailing ones dropped.
_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_TOKENS = rf"""CASE WHEN text = '' THEN ['']
         WHEN rtrim(text, {_SPACES}) = '' THEN []::VARCHAR[]
         ELSE regexp_split_to_array(rtrim(text, {_SPACES}), '[ \t\n\x0B\f\r]+') END"""


def _java_hash(text: str) -> str:
    return f"""list_reduce(
        list_prepend(0::BIGINT, list_transform(string_split({text}, ''), lambda c: unicode(c)::BIGINT)),
        lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)"""


ORACLES["word_count"] = f"""
SELECT word, count(*) AS n
FROM (SELECT unnest({_TOKENS}) AS word FROM documents)
GROUP BY word
"""
ORACLES["word_count_text"] = rf"""
SELECT word, count(*) AS n
FROM (SELECT unnest({_TOKENS}) AS word
      FROM (SELECT unnest(regexp_split_to_array(text, '\r\n|\n|\r')) AS text FROM documents))
GROUP BY word
"""
ORACLES["checkpoint_reload"] = ORACLES["word_count"]

ORACLES["sum_by_key"] = """
SELECT c_mktsegment AS role, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_mktsegment
"""

ORACLES["conjunctive_filter"] = """
SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_linenumber < 4 AND l_linenumber < 3
"""

ORACLES["union_logs"] = """
SELECT event_id, user_id, event_type, 'app' AS source FROM events WHERE event_type IN ('click', 'view')
UNION ALL
SELECT event_id, user_id, event_type, 'web' FROM events WHERE event_type IN ('purchase', 'error')
UNION ALL
SELECT event_id, user_id, event_type, 'mini' FROM events WHERE event_type IN ('signup', 'view')
"""

ORACLES["url_domain"] = f"""
SELECT page_id, CASE WHEN host = '' THEN 'none' ELSE host END AS host
FROM (SELECT page_id, regexp_extract(url, '{URL_HOST_PATTERN}', 1) AS host FROM pages)
"""

ORACLES["array_contains_literal"] = rf"""
SELECT doc_id,
       list_contains(words, '')::INT AS has_empty,
       list_contains(words, '\s+')::INT AS has_pattern_text,
       list_contains(words, 'the')::INT AS has_the
FROM (SELECT doc_id, {_TOKENS} AS words FROM documents)
"""

ORACLES["range_compare"] = """
SELECT event_id, CASE WHEN value < 5.0 THEN -1 WHEN value > 20.0 THEN 1 ELSE 0 END AS side
FROM events
"""

ORACLES["broadcast_lookup_join"] = """
SELECT c_custkey, c_name, c_nationkey AS n_nationkey, coalesce(n.n_name, 'null') AS n_name
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON c_nationkey = n.n_nationkey
"""

ORACLES["lookup_text_lines"] = """
SELECT c_nationkey || ',' || c_name || ',' || c_mktsegment || ',' || coalesce(n.n_name, 'null') AS value
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON c_nationkey = n.n_nationkey
"""

ORACLES["side_table_lookup"] = """
SELECT c_custkey, c_nationkey AS id, coalesce(n.n_name, 'null') AS name
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON c_nationkey = n.n_nationkey
"""

ORACLES["range_lookup_mixed_types"] = """
SELECT e.event_id, e.value AS x, b.n_name AS band, coalesce(b.position, -1) AS position, way
FROM events e
CROSS JOIN (VALUES ('between'), ('search'), ('merged')) ways(way)
LEFT JOIN (SELECT n_name, n_nationkey * 4 AS s, n_nationkey * 4 + 2 AS t,
                  row_number() OVER (ORDER BY n_nationkey) - 1 AS position FROM nation) b
  ON e.value BETWEEN b.s AND b.t
"""

_CENTS = "SELECT event_id, round(value * 100)::BIGINT AS cents FROM events"

ORACLES["range_lookup"] = f"""
SELECT e.event_id, e.cents, b.n_name AS band, coalesce(b.position, -1) AS position
FROM ({_CENTS}) e
LEFT JOIN (SELECT n_name, n_nationkey * 400 AS s, n_nationkey * 400 + 250 AS t,
                  row_number() OVER (ORDER BY n_nationkey) - 1 AS position FROM nation) b
  ON e.cents BETWEEN b.s AND b.t
"""

ORACLES["range_lookup_asof"] = f"""
SELECT e.event_id, e.cents, b.p_name AS band, coalesce(b.position, -1) AS position
FROM ({_CENTS}) e
LEFT JOIN (SELECT p_name, p_partkey * 3 AS s, p_partkey * 3 + 1 AS t,
                  row_number() OVER (ORDER BY p_partkey) - 1 AS position FROM part) b
  ON e.cents BETWEEN b.s AND b.t
"""

ORACLES["range_lookup_merged"] = ORACLES["range_lookup_asof"]

ORACLES["position_lookup"] = """
SELECT p.p_partkey, p.p_size, coalesce(d.position, -1) AS position
FROM part p
LEFT JOIN (SELECT p_size, row_number() OVER (ORDER BY p_size) - 1 AS position
           FROM (SELECT DISTINCT p_size FROM part WHERE p_brand = 'Brand#1')) d
  ON p.p_size = d.p_size
"""

ORACLES["login_streaks"] = """
WITH days AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events),
     islands AS (SELECT user_id, day,
                        day - row_number() OVER (PARTITION BY user_id ORDER BY day)::INT AS island
                 FROM days)
SELECT user_id, count(*) AS days,
       strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day
FROM islands GROUP BY user_id, island
"""

ORACLES["running_total"] = """
SELECT event_id, user_id,
       sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id
                           ROWS UNBOUNDED PRECEDING)::BIGINT AS running_total
FROM events
"""

ORACLES["running_total_global"] = """
SELECT o_orderkey, o_custkey,
       sum(o_custkey) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS running_total
FROM orders
"""

_FLAGGED = """
SELECT event_id, user_id, ts AS s, ts + to_seconds(floor(value)) AS e,
       round(value * 100)::BIGINT AS cents,
       coalesce(ts - lag(ts + to_seconds(floor(value))) OVER w <= INTERVAL 6 HOUR, false)::INT AS close
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
"""

ORACLES["within_gap"] = f"SELECT event_id, user_id, close AS within_gap FROM ({_FLAGGED})"

ORACLES["gap_sessions"] = f"""
SELECT user_id, session_no,
       strftime(min(s), '%Y-%m-%d %H:%M:%S') AS session_start,
       strftime(max(e), '%Y-%m-%d %H:%M:%S') AS session_end,
       count(*) AS n_rows, sum(cents)::BIGINT AS cents
FROM (SELECT *, sum(1 - close) OVER (PARTITION BY user_id ORDER BY s, event_id
                                     ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no
      FROM ({_FLAGGED}))
GROUP BY user_id, session_no
"""

ORACLES["bitmap_distinct"] = """
SELECT n_name, count(DISTINCT o_custkey) AS n
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name
"""

ORACLES["bitmap_rollup"] = """
SELECT r_name, count(DISTINCT o_custkey) AS n
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name
"""

ORACLES["bitmap_distinct_strings"] = """
SELECT c_mktsegment, count(DISTINCT c_name) AS n FROM customer GROUP BY c_mktsegment
"""

ORACLES["bitmap_distinct_exact"] = f"""
SELECT lang, count(DISTINCT word) AS n FROM (SELECT lang, unnest({_TOKENS}) AS word FROM documents)
GROUP BY lang
"""

ORACLES["container_rollup"] = """
SELECT 'l_orderkey' AS what, l_linestatus, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_linestatus
UNION ALL
SELECT 'l_suppkey', l_linestatus, count(DISTINCT l_suppkey) FROM lineitem GROUP BY l_linestatus
"""

ORACLES["login_streaks_merged"] = ORACLES["login_streaks"]
ORACLES["longest_streaks_merged"] = f"""
SELECT user_id, sum(days)::BIGINT AS n_days, max(days) AS longest
FROM ({ORACLES["login_streaks"]}) GROUP BY user_id
"""
ORACLES["running_total_resumed"] = ORACLES["running_total"]
ORACLES["gap_sessions_resumed"] = ORACLES["gap_sessions"]

ORACLES["write_sized_files"] = ORACLES["word_count"]
ORACLES["write_single_file"] = f"""
SELECT word, count(*) AS n, 1 AS n_files
FROM (SELECT unnest({_TOKENS}) AS word FROM (SELECT source AS text FROM documents)) GROUP BY word
"""
ORACLES["sequence_lookup"] = """
SELECT k::INT AS c_nationkey, count(c_custkey) AS n
FROM range(30) t(k) LEFT JOIN customer ON c_nationkey = k GROUP BY k
"""

ORACLES["pruned_lookup"] = """
SELECT l_orderkey, l_linenumber, l_partkey, c_custkey
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE c_mktsegment = 'BUILDING'
"""

_ORDER_LINES = """
SELECT l_orderkey AS o_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, o_custkey, o_orderdate
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

ORACLES["extract_ids"] = f"""
SELECT o_orderkey, l_linenumber,
       'c' || o_custkey || '|s' || l_suppkey
       || CASE WHEN l_linenumber = 3 THEN '' ELSE '|p' || l_partkey END AS ids
FROM ({_ORDER_LINES})
"""

_IDS = f"""
SELECT {_java_hash("'c' || o_custkey")} AS c, {_java_hash("'s' || l_suppkey")} AS s,
       {_java_hash("'p' || l_partkey")} AS p,
       'c' || o_custkey AS c_text, 's' || l_suppkey AS s_text, 'p' || l_partkey AS p_text,
       l_linenumber, l_returnflag, o_orderdate
FROM ({_ORDER_LINES})
"""

ORACLES["id_vertices"] = f"""
WITH ids AS ({_IDS})
SELECT id, value, count(*) AS n
FROM (SELECT c AS id, c_text AS value FROM ids UNION ALL SELECT s, s_text FROM ids
      UNION ALL SELECT p, p_text FROM ids)
GROUP BY id, value
"""

ORACLES["id_edges"] = f"""
WITH ids AS ({_IDS})
SELECT src, dst, count(*) AS n
FROM (SELECT c AS src, s AS dst FROM ids UNION ALL SELECT c, p FROM ids UNION ALL SELECT s, p FROM ids)
GROUP BY src, dst HAVING count(*) > 2
"""

ORACLES["chain_edges"] = f"""
WITH ids AS ({_IDS})
SELECT src, dst, count(*) AS n
FROM (SELECT c AS src, s AS dst FROM ids WHERE l_linenumber > 1
      UNION ALL SELECT s, p FROM ids WHERE l_linenumber > 1
      UNION ALL SELECT c, p FROM ids WHERE l_linenumber <= 1)
GROUP BY src, dst
"""

ORACLES["connected_components"] = f"""
WITH RECURSIVE edges AS (
  SELECT o_custkey * 2 AS src, l_suppkey * 2 + 1 AS dst FROM ({_ORDER_LINES})
  GROUP BY ALL HAVING count(*) > 2),
links AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
reach AS (
  SELECT DISTINCT a AS id, a AS label FROM links
  UNION
  SELECT b, label FROM reach JOIN links ON id = a WHERE label < b)
SELECT id, min(label) AS component FROM reach GROUP BY id
"""

_REACH = """
links AS MATERIALIZED (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
reach AS (
  SELECT DISTINCT a AS id, a AS label FROM links
  UNION
  SELECT b, label FROM reach JOIN links ON id = a WHERE label < b)
"""

# The smallest vertex of a component has no smaller neighbour, so only such labels are spread.
ORACLES["connected_components_all"] = f"""
WITH RECURSIVE edges AS (
  SELECT DISTINCT o_custkey * 2 AS src, l_suppkey * 2 + 1 AS dst FROM ({_ORDER_LINES})),
links AS MATERIALIZED (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
roots AS (SELECT a FROM links GROUP BY a HAVING min(b) > a),
reach AS (
  SELECT a AS id, a AS label FROM roots
  UNION
  SELECT b, label FROM reach JOIN links ON id = a)
SELECT id, min(label) AS component FROM reach GROUP BY id
"""

ORACLES["connected_components_deep"] = f"""
WITH RECURSIVE edges AS (
  SELECT o_orderkey AS src, o_orderkey - 1 AS dst FROM orders WHERE o_orderkey % 64 <> 0
  UNION ALL SELECT o_orderkey, -1 FROM orders WHERE o_orderkey % 448 = 0),
{_REACH}
SELECT id, min(label) AS component FROM reach GROUP BY id
UNION ALL
SELECT -o_orderkey - 1, -o_orderkey - 1 FROM orders WHERE o_orderkey % 1000 = 1
"""


def _day(name: str, where: str) -> str:
    """Vertices and supported edges of one day's logs as common table expressions."""
    return f"""
{name}_ids AS MATERIALIZED (SELECT c, s, CASE WHEN l_linenumber <> 3 THEN p END AS p FROM ids WHERE {where}),
{name}_vertices AS (SELECT c AS id FROM {name}_ids UNION SELECT s FROM {name}_ids
                    UNION SELECT p FROM {name}_ids WHERE p IS NOT NULL),
{name}_edges AS (
  SELECT src, dst FROM (SELECT c AS src, s AS dst FROM {name}_ids
                        UNION ALL SELECT c, p FROM {name}_ids WHERE p IS NOT NULL
                        UNION ALL SELECT s, p FROM {name}_ids WHERE p IS NOT NULL)
  GROUP BY src, dst HAVING count(*) > 2)"""


def _labels(name: str, vertices: str, edges: str) -> str:
    """Smallest reachable id per vertex."""
    return f"""
{name}_links AS MATERIALIZED (SELECT src AS a, dst AS b FROM {edges} UNION SELECT dst, src FROM {edges}),
{name}_reach AS (
  SELECT id, id AS label FROM {vertices}
  UNION
  SELECT b, label FROM {name}_reach JOIN {name}_links ON id = a WHERE label < b),
{name}_labels AS (SELECT id, min(label) AS label FROM {name}_reach GROUP BY id)"""


ORACLES["id_mapping"] = f"""
WITH RECURSIVE ids AS MATERIALIZED ({_IDS}), {_day("d", "true")}, {_labels("d", "d_vertices", "d_edges")}
SELECT id AS biaoshi_hashcode, label AS guid FROM d_labels
"""

ORACLES["id_mapping_exact"] = f"""
WITH RECURSIVE texts AS MATERIALIZED ({_IDS}),
ids AS MATERIALIZED (SELECT c_text AS c, s_text AS s, p_text AS p, l_linenumber FROM texts),
{_day("d", "true")}, {_labels("d", "d_vertices", "d_edges")}
SELECT id AS biaoshi_hashcode, label AS guid FROM d_labels
"""

ORACLES["id_mapping_rolling"] = f"""
WITH RECURSIVE ids AS MATERIALIZED ({_IDS}),
{_day("a", "o_orderdate < TIMESTAMP '1998-04-25'")}, {_labels("a", "a_vertices", "a_edges")},
{_day("b", "o_orderdate >= TIMESTAMP '1998-04-25'")},
all_vertices AS (SELECT id FROM b_vertices UNION SELECT id FROM a_labels UNION SELECT label FROM a_labels),
all_edges AS (SELECT src, dst FROM b_edges UNION SELECT id, label FROM a_labels WHERE id <> label),
{_labels("t", "all_vertices", "all_edges")}
SELECT t.id AS biaoshi_hashcode,
       coalesce(min(a.label) OVER (PARTITION BY t.label), t.label) AS guid
FROM t_labels t LEFT JOIN a_labels a ON t.id = a.id
"""

_ROLLED = """
{n}_all_vertices AS (SELECT id FROM {n}_vertices UNION SELECT id FROM {before} UNION SELECT label FROM {before}),
{n}_all_edges AS (SELECT src, dst FROM {n}_edges UNION SELECT id, label FROM {before} WHERE id <> label),"""


def _rolled(name: str, before: str) -> str:
    """A day's dictionary on top of the one before, as the table ``<name>_rolled``."""
    return f"""
{_ROLLED.format(n=name, before=before)}
{_labels(f"{name}_t", f"{name}_all_vertices", f"{name}_all_edges")},
{name}_rolled AS (
  SELECT t.id, coalesce(min(o.label) OVER (PARTITION BY t.label), t.label) AS label
  FROM {name}_t_labels t LEFT JOIN {before} o ON t.id = o.id)"""


ORACLES["id_mapping_incremental"] = f"""
WITH RECURSIVE ids AS MATERIALIZED ({_IDS}),
{_day("a", "o_orderdate < TIMESTAMP '1998-04-25'")}, {_labels("a", "a_vertices", "a_edges")},
{_day("b", "o_orderdate >= TIMESTAMP '1998-04-25' AND o_orderdate < TIMESTAMP '1998-06-10'")},
{_day("c", "o_orderdate >= TIMESTAMP '1998-06-10'")},
{_rolled("b", "a_labels")}, {_rolled("c", "b_rolled")}
SELECT id AS biaoshi_hashcode, label AS guid FROM c_rolled
"""

ORACLES["id_mapping_log_files"] = f"""
WITH RECURSIVE texts AS MATERIALIZED ({_IDS}),
ids AS MATERIALIZED (SELECT c_text AS c, s_text AS s, p_text AS p, l_linenumber FROM texts),
{_day("d", "true")}, {_labels("d", "d_vertices", "d_edges")}
SELECT label AS first_id, count(*) AS n_ids FROM d_labels GROUP BY label
"""

_LOG_LINE = """'{"user":{"uid":"c' || o_custkey || '","phone":{"imei":"s' || l_suppkey || '"'"""

ORACLES["log_intake"] = f"""
SELECT kind, text, count(*) AS n FROM (
  SELECT 'ids' AS kind, 'c' || o_custkey || '|s' || l_suppkey
         || CASE WHEN l_linenumber = 3 THEN '' ELSE '|p' || l_partkey END AS text
  FROM ({_ORDER_LINES}) WHERE o_orderkey % 50 <> 0
  UNION ALL
  SELECT 'line', substr({_LOG_LINE}, 1, 25) FROM ({_ORDER_LINES}) WHERE o_orderkey % 50 = 0)
GROUP BY kind, text
"""

ORACLES["bucketed_dictionary"] = f"""
WITH RECURSIVE ids AS MATERIALIZED ({_IDS}),
{_day("a", "o_orderdate < TIMESTAMP '1998-04-25'")}, {_labels("a", "a_vertices", "a_edges")},
today AS (
  SELECT c AS id, c_text AS value FROM ids WHERE o_orderdate >= TIMESTAMP '1998-04-25'
  UNION SELECT s, s_text FROM ids WHERE o_orderdate >= TIMESTAMP '1998-04-25'
  UNION SELECT p, p_text FROM ids WHERE l_linenumber <> 3 AND o_orderdate >= TIMESTAMP '1998-04-25')
SELECT today.id AS biaoshi_hashcode, value, label AS guid FROM today LEFT JOIN a_labels ON today.id = a_labels.id
"""

_RARE_IDS = f"""
SELECT ['c' || o_custkey, 's' || l_suppkey, 'p' || l_partkey, 'o' || o_orderkey,
        'm' || o_orderkey || '-' || l_linenumber,
        'i' || l_partkey || '-' || l_suppkey || '-' || o_custkey,
        'u' || o_custkey || '-' || l_partkey] AS ids
FROM ({_ORDER_LINES})
"""

ORACLES["id_edges_pruned"] = f"""
SELECT ids[i] AS src, ids[j] AS dst, count(*) AS n
FROM ({_RARE_IDS}), range(1, 8) a(i), range(1, 8) b(j) WHERE i < j
GROUP BY ids[i], ids[j] HAVING count(*) > 2
"""

_PLACES = f"""
SELECT *, {_java_hash("place")} AS place_id,
       CASE WHEN name <> '' THEN {_java_hash("CASE WHEN name = '' THEN 'x' ELSE name END")} END AS name_id
FROM (
  SELECT CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS name,
         'group-' || c_nationkey || '-' || c_mktsegment AS place, c_custkey AS amount
  FROM customer
  UNION ALL
  SELECT s_name, 'group-' || s_nationkey || '-BUILDING', s_suppkey FROM supplier)
"""

ORACLES["tag_rows_with_guid"] = f"""
WITH RECURSIVE places AS MATERIALIZED ({_PLACES}),
vertices AS (SELECT place_id AS id FROM places UNION SELECT name_id FROM places WHERE name_id IS NOT NULL),
edges AS (SELECT name_id AS src, place_id AS dst FROM places WHERE name_id IS NOT NULL),
{_labels("t", "vertices", "edges")}
SELECT label || ',' || name || ',' || place || ',' || amount AS value
FROM places JOIN t_labels ON id = coalesce(name_id, place_id)
"""
