"""DuckDB SQL of the source queries: what the folders hold, told from the tables alone."""

from __future__ import annotations

from covlattice.plans.sql import _STRATA

_SAMPLES = """WITH s AS (
  SELECT c_custkey AS k, c_custkey::VARCHAR AS sample_id, c_mktsegment AS test_id, c_nationkey AS nation, 'm' || c_nationkey AS module_name,
         CASE WHEN c_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, c_custkey % 3 <> 0 AS has_asm FROM customer
)"""

#: Codes of the cell, node and edge types that the written graphs use, by supplier key.
_CODES = """u AS (
  SELECT s_nationkey AS nation, [32, 8, 0, 3, 73][s_suppkey % 5 + 1] AS cell, [7, 4, 0, 6, 11][s_suppkey % 5 + 1] AS node_type,
         s_suppkey % 4 + 1 AS width, [0, 3, 6, 0][s_suppkey % 4 + 1] AS edge_type FROM supplier
)"""


def _epoch(seed: int) -> str:
    chosen = _STRATA.replace("'0|'", f"'{seed}|'") + " SELECT module, sample_a, sample_b, anchor, stratum FROM chosen"
    return f"SELECT {seed} AS epoch, * FROM ({chosen})"


ORACLES = {
    "dataset_samples": _SAMPLES + """ SELECT dataset, sample_id, test_id, module_name, has_asm,
      CASE WHEN k % 5 <> 0 THEN 4 ELSE 0 END AS n_labels, (k % 101)::DOUBLE AS line FROM s""",
    "streamed_samples": _SAMPLES + " SELECT sample_id, test_id, module_name FROM s",
    "rtl_graph_tables": "WITH " + _CODES + """, used AS (SELECT DISTINCT c_nationkey AS nation FROM customer WHERE c_nationkey <> 7)
      SELECT 'm' || used.nation AS module, count(u.nation) AS n_nodes, coalesce(sum(cell), 0)::BIGINT AS cells, coalesce(sum(node_type), 0)::BIGINT AS node_types,
             coalesce(sum(width), 0)::BIGINT AS widths, count(u.nation) AS n_edges, greatest(count(u.nation) - 1, 0) AS n_valid, coalesce(sum(edge_type), 0)::BIGINT AS edge_types
      FROM used LEFT JOIN u ON u.nation = used.nation GROUP BY used.nation""",
    "broken_graphs": "SELECT DISTINCT c_nationkey::INT AS module FROM customer WHERE c_nationkey = 7",
    "asm_graph_tables": """WITH n AS (
        SELECT n_regionkey AS region, n_nationkey AS k, lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS next FROM nation)
      SELECT region::INT AS region, 'b' || k AS node, [3, 5, 18][k % 3 + 1] AS node_type,
             CASE WHEN k % 2 = 0 THEN 'add x1, x' || k || chr(10) || 'add x1, x' || k ELSE 'nop' END AS text,
             (next IS NOT NULL)::BIGINT AS n_out, CASE WHEN next IS NOT NULL THEN 3 END AS edge_type FROM n
      UNION ALL SELECT 9, '', 0, 'nop', 0, NULL""",
    "sample_graphs": _SAMPLES + " SELECT dataset, sample_id, has_asm, 16 AS key_length FROM s WHERE nation <> 7",
    "sample_table": _SAMPLES + """, v AS (SELECT s_nationkey AS nation, count(*) - 1 AS n FROM supplier GROUP BY 1),
      t AS (SELECT s.*, coalesce(v.n, 0) AS n FROM s LEFT JOIN v USING (nation) WHERE nation <> 7 AND test_id NOT IN ('BUILDING', 'MACHINERY'))
      SELECT sample_id, test_id, module_name, n AS n_edges, CASE WHEN k % 2 = 0 THEN 0 ELSE -1 END AS default_label,
             CASE WHEN k % 5 = 0 OR n = 0 THEN '' ELSE concat_ws(',', CASE WHEN k % 4 = 0 THEN '0:1' ELSE '0:0' END, CASE WHEN n > 1 THEN '1:0' END,
               CASE WHEN k % 4 > 1 AND n > k % 4 THEN (k % 4) || ':1' END) END AS labels,
             round(k % 101 / 100, 6) AS line, 0.5::DOUBLE AS fsm, NULL::DOUBLE AS toggle FROM t""",
    "cached_encodings": """SELECT substr(sha256(text || chr(0) || 'lengths|512|mean'), 1, 32) AS content_key, length(text)::DOUBLE AS length,
      (CASE WHEN bool_or(turn % 2 = 0) THEN 1 ELSE 2 END)::DOUBLE AS round FROM conversations WHERE text IS NOT NULL GROUP BY text""",
    "healed_encodings": """WITH t AS (SELECT substr(sha256(text || chr(0) || 'lengths|512|mean'), 1, 32) AS content_key, length(text) AS n, bool_or(turn % 2 = 0) AS early
        FROM conversations WHERE text IS NOT NULL GROUP BY text)
      SELECT content_key, n::DOUBLE AS length, (CASE WHEN early AND n % 7 NOT IN (1, 2, 3) THEN 1 ELSE 2 END)::DOUBLE AS round,
             CASE WHEN early THEN CASE n % 7 WHEN 1 THEN 'another length' WHEN 2 THEN 'not finite' WHEN 3 THEN 'another checksum' END END AS reason FROM t""",
    "stored_samples": """SELECT c_custkey, c_nationkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey
      WHERE c_mktsegment = 'BUILDING' GROUP BY ALL""",
    "streamed_runs": """WITH o AS (
        SELECT o_orderpriority AS run, (o_orderkey % 20)::INT AS epoch, o_totalprice / 100000 AS t,
               o_totalprice / 100000 * (1 + (o_custkey % 7 - 3) / (10 + o_orderkey % 20)) - o_totalprice / 100000 AS e FROM orders),
      m AS (SELECT run, epoch, count(*) AS n, avg(e * e) AS mse, avg(abs(e)) AS mae, 1 - sum(e * e) / (sum(t * t) - sum(t) * sum(t) / count(*)) AS r2 FROM o GROUP BY ALL),
      b AS (SELECT *, row_number() OVER w AS rn, coalesce(mse < min(mse) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS better
            FROM m WINDOW w AS (PARTITION BY run ORDER BY epoch)),
      c AS (SELECT *, (rn - max(CASE WHEN better THEN rn END) OVER w)::INT AS bad, min(mse) OVER w AS best FROM b WINDOW w AS (PARTITION BY run ORDER BY epoch))
      SELECT run, epoch, n, round(mse, 6) AS mse, round(mae, 6) AS mae, round(r2, 6) AS r2, round(best, 6) AS best, bad,
             min(CASE WHEN bad >= 2 THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS stop_epoch
      FROM c QUALIFY epoch < max(epoch) OVER (PARTITION BY run)""",
    "metric_history": """WITH c AS (SELECT c_mktsegment AS name, count(*) AS n FROM customer GROUP BY 1)
      SELECT epoch, step, 'val' AS stage, name, (n * scale)::DOUBLE AS value FROM c, (VALUES (0, 10, 1), (1, 30, 4)) AS e(epoch, step, scale)""",
    "epoch_pairs": _epoch(0) + " UNION ALL " + _epoch(1),
}
