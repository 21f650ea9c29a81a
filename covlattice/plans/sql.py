"""DuckDB SQL of the registered queries: an independent statement of each result."""

from __future__ import annotations

import math

_BASE = """
base AS (
  SELECT c_nationkey AS module, c_custkey AS sample, CAST(substr(p_brand, 7) AS INT) - 1 AS line,
         CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS condition,
         list_position(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'], p_type)::INT - 1 AS toggle,
         list_position(['A', 'N', 'R'], l_returnflag)::INT - 1 AS fsm, p_size - 1 AS branch
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
), types(k, ctype, n) AS (VALUES (0, 'line', 25), (1, 'condition', 5), (2, 'toggle', 6), (3, 'fsm', 3), (4, 'branch', 50)),
cov AS (
  SELECT DISTINCT module, sample, k, ctype, n,
         CASE ctype WHEN 'line' THEN line WHEN 'condition' THEN condition WHEN 'toggle' THEN toggle WHEN 'fsm' THEN fsm ELSE branch END AS e
  FROM base, types
), cnt AS (SELECT module, sample, k, ctype, n, count(*) AS c FROM cov GROUP BY ALL)"""

_RING = """
ring AS (
  SELECT module, sample, row_number() OVER (PARTITION BY module ORDER BY md5('0|' || module || '|' || sample), sample) - 1 AS place,
         count(*) OVER (PARTITION BY module) AS members
  FROM (SELECT DISTINCT module, sample FROM {source})
), dir AS (
  SELECT a.module, a.sample AS anchor, b.sample AS candidate FROM ring a JOIN ring b ON a.module = b.module AND a.sample <> b.sample
  WHERE (b.place - a.place + a.members) % a.members BETWEEN 1 AND least({pool}, a.members - 1)
)"""

#: All unordered pairs of a module.
_ALL = """
und AS (
  SELECT a.module, a.sample AS sample_a, b.sample AS sample_b
  FROM (SELECT DISTINCT module, sample FROM cov) a JOIN (SELECT DISTINCT module, sample FROM cov) b ON a.module = b.module AND a.sample < b.sample
)"""

#: Candidates of other signatures, if the module has any: the first 256 of the ring.
_INFORMATIVE = """
sig AS (SELECT module, sample, string_agg(k || ':' || e, ',' ORDER BY k, e) AS sig FROM cov GROUP BY ALL),
ring AS (
  SELECT module, sample, sig, row_number() OVER (PARTITION BY module ORDER BY md5('0|' || module || '|' || sample), sample) - 1 AS place,
         count(*) OVER (PARTITION BY module) AS members
  FROM sig
), met_ AS (
  SELECT a.module, a.sample AS anchor, b.sample AS candidate, (b.place - a.place + a.members) % a.members AS step, a.sig = b.sig AS same,
         bool_or(a.sig <> b.sig) OVER (PARTITION BY a.module, a.sample) AS others
  FROM ring a JOIN ring b ON a.module = b.module AND a.sample <> b.sample
), dir AS (
  SELECT module, anchor, candidate FROM met_ WHERE NOT same OR NOT others QUALIFY row_number() OVER (PARTITION BY module, anchor ORDER BY step) <= 256
), und AS (SELECT DISTINCT module, least(anchor, candidate) AS sample_a, greatest(anchor, candidate) AS sample_b FROM dir)"""

_JACCARD = """
met AS (
  SELECT sample_a, sample_b, x.ctype, count(*) AS i FROM und JOIN cov x ON x.sample = sample_a
  JOIN cov y ON y.sample = sample_b AND y.ctype = x.ctype AND y.e = x.e GROUP BY ALL
), jac AS (
  SELECT und.module, und.sample_a, und.sample_b, t.ctype, t.n, a.c AS ca, b.c AS cb, coalesce(i, 0) AS inter,
         coalesce(i, 0) / (a.c + b.c - coalesce(i, 0)) AS jaccard
  FROM und JOIN cnt a ON a.sample = und.sample_a JOIN cnt b ON b.sample = und.sample_b AND b.ctype = a.ctype
  JOIN types t ON t.ctype = a.ctype
  LEFT JOIN met ON met.sample_a = und.sample_a AND met.sample_b = und.sample_b AND met.ctype = a.ctype
), sim AS (SELECT module, sample_a, sample_b, avg(jaccard) AS similarity FROM jac GROUP BY ALL)"""

_COV = "WITH " + _BASE
_PAIRS = _COV + "," + _ALL + "," + _JACCARD
_STRATA = (
    _COV
    + ","
    + _INFORMATIVE
    + ","
    + _JACCARD
    + """, both_ AS (
  SELECT module, anchor, candidate, similarity FROM dir JOIN sim USING (module) WHERE sample_a = least(anchor, candidate) AND sample_b = greatest(anchor, candidate)
), ranked AS (
  SELECT module, anchor, candidate, similarity,
         row_number() OVER (PARTITION BY module, anchor ORDER BY round(similarity, 9), md5('0|' || anchor || '|' || candidate)) AS rank,
         count(*) OVER (PARTITION BY module, anchor) AS pool_size
  FROM both_
), strata AS (
  SELECT *, CASE WHEN rank <= greatest(1, ceil(pool_size / 4)) THEN 'low'
                 WHEN rank > greatest(greatest(1, ceil(pool_size / 4)), floor(pool_size * 3 / 4)) THEN 'high' ELSE 'mid' END AS stratum
  FROM ranked
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY module, anchor, stratum ORDER BY md5('0|' || stratum || '|' || anchor || '|' || candidate)) AS place,
         CASE stratum WHEN 'low' THEN 2 ELSE 1 END AS quota
  FROM strata
), owned AS (
  SELECT *, least(anchor, candidate) AS sample_a, greatest(anchor, candidate) AS sample_b FROM placed
  QUALIFY row_number() OVER (PARTITION BY module, least(anchor, candidate), greatest(anchor, candidate) ORDER BY place, anchor) = 1
), chosen AS (
  SELECT * FROM owned QUALIFY row_number() OVER (PARTITION BY module, anchor, stratum ORDER BY place) <= quota
), deg AS (
  SELECT module, sample, count(*) AS degree FROM (SELECT module, unnest([sample_a, sample_b]) AS sample FROM chosen) GROUP BY ALL
)"""
)
_ORDER = (
    _PAIRS
    + """, pos AS (
  SELECT module, sample_a, sample_b, row_number() OVER (ORDER BY round(similarity, 6), md5('0|' || sample_a || '|' || sample_b)) - 1 AS position,
         count(*) OVER () AS total
  FROM sim
)"""
)
_EDGES = """WITH edges AS (
  SELECT l_suppkey % 8 AS graph, 's' || l_suppkey AS src, 'p' || l_partkey AS dst,
         2 * (list_position(['A', 'N', 'R'], l_returnflag)::INT - 1) + (l_linestatus = 'O')::INT AS edge_type, l_linenumber - 1 AS target_port,
         l_orderkey * 8 + l_linenumber AS position, l_orderkey AS order_key, l_extendedprice / 7919 AS m, l_discount * 10 AS score
  FROM lineitem
), nodes AS (
  SELECT graph, node, p_size % 12 AS node_type
  FROM (SELECT DISTINCT graph, dst AS node FROM edges) JOIN part ON node = 'p' || p_partkey WHERE p_size <= 45
  UNION ALL SELECT s_suppkey % 8, 's' || s_suppkey, 0 FROM supplier
), valid AS (
  SELECT e.* FROM edges e JOIN nodes a ON a.graph = e.graph AND a.node = e.src JOIN nodes b ON b.graph = e.graph AND b.node = e.dst
)"""
_PRED = """WITH pred AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 'line' WHEN 'N' THEN 'condition' ELSE 'toggle' END AS ctype, l_quantity * p_retailprice / 100000 AS pred,
         CASE WHEN l_linenumber <> 7 THEN l_extendedprice / 100000 END AS target, 1 + l_discount AS weight
  FROM lineitem JOIN part ON l_partkey = p_partkey
), valid AS (SELECT *, pred - target AS e, avg(target) OVER (PARTITION BY ctype) AS t0, avg(pred) OVER (PARTITION BY ctype) AS p0
             FROM pred WHERE target IS NOT NULL)"""
_REG = (
    _PRED
    + """, reg AS (
  SELECT ctype, count(*) AS n, avg(e * e) AS mse, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse,
         100 * avg(2 * abs(e) / (abs(pred) + abs(target) + 1e-8)) AS smape, quantile_disc(abs(e), 0.5) AS median_ae,
         100 * avg(abs(e) / abs(target)) FILTER (abs(target) > 1e-8) AS mape, 1 - sum(e * e) / sum((target - t0) ** 2) AS r2,
         sum((pred - p0) * (target - t0)) / (sqrt(sum((pred - p0) ** 2) * sum((target - t0) ** 2)) + 1e-8) AS pearson_r
  FROM valid GROUP BY ctype
)"""
)
_SMOOTH = "(CASE WHEN abs({0}) < 1 THEN 0.5 * ({0}) * ({0}) ELSE abs({0}) - 0.5 END)"
_BOXES = """WITH types(k, ctype) AS (VALUES (0, 'line'), (1, 'condition'), (2, 'toggle'), (3, 'fsm'), (4, 'branch')),
logits AS (
  SELECT label AS module, vec_id AS sample, k, ctype, dim, 1 / (1 + exp(-4 * embedding[k * 5 + dim]::DOUBLE)) AS c,
         1 / (1 + exp(-4 * embedding[k * 5 + 25 + dim]::DOUBLE)) AS r, least(1.0, abs(embedding[k + 51]::DOUBLE) * 2) AS truth
  FROM embeddings, types, (SELECT unnest(range(1, 6)) AS dim)
), mid AS (SELECT *, 0.0005 + c * 0.999 AS x FROM logits),
half AS (SELECT *, 0.0005 + r * greatest(least(x, 1 - x) - 0.0005, 0.0) AS h FROM mid),
boxes AS (SELECT module, sample, k, ctype, dim, x - h AS lo, x + h AS hi, truth FROM half),
vol AS (SELECT module, sample, ctype, any_value(truth) AS truth, sum(ln(greatest(greatest(hi - lo, 0), 1e-12))) AS lv FROM boxes GROUP BY ALL)"""


def _box_pairs(width: str, log_if: str) -> str:
    return (
        _BOXES
        + f""", dir AS (
  SELECT a.label AS module, a.vec_id AS anchor, b.vec_id AS candidate FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id
), axis AS (
  SELECT d.module, anchor AS sample_a, candidate AS sample_b, a.ctype, least(a.hi, b.hi) - greatest(a.lo, b.lo) AS delta,
         least(a.hi - a.lo, b.hi - b.lo) AS room, (a.lo < 0.01)::INT + (b.lo < 0.01)::INT AS low, (a.hi > 0.99)::INT + (b.hi > 0.99)::INT AS high
  FROM dir d JOIN boxes a ON a.sample = anchor JOIN boxes b ON b.sample = candidate AND b.ctype = a.ctype AND b.dim = a.dim
), inter AS (
  SELECT module, sample_a, sample_b, ctype, sum(ln(greatest({width}, 1e-12))) AS vi, bool_and(delta > 0) AS meet, sum(low) AS low, sum(high) AS high
  FROM axis GROUP BY ALL
), u AS (
  SELECT i.*, a.lv AS va, b.lv AS vb, a.truth AS ta, b.truth AS tb, greatest(a.lv, b.lv) AS top
  FROM inter i JOIN vol a ON a.sample = sample_a AND a.ctype = i.ctype JOIN vol b ON b.sample = sample_b AND b.ctype = i.ctype
), l AS (SELECT *, vi - (top + ln(greatest(exp(va - top) + exp(vb - top) - exp(vi - top), 1e-12))) AS li FROM u),
g AS (
  SELECT module, sample_a, sample_b, ctype, va, vb, ta, tb, low, high, meet, CASE WHEN {log_if} THEN exp(vi) ELSE 0.0 END AS intersection,
         CASE WHEN {log_if} THEN least(1.0, greatest(0.0, exp(li))) ELSE 0.0 END AS iou, CASE WHEN {log_if} THEN li END AS log_iou,
         sample_a % 7 <> 0 AS size_mask, CASE WHEN (sample_a + sample_b) % 3 = 0 THEN 0.0 ELSE abs(ta - tb) END AS jaccard, sample_b % 5 <> 0 AS iou_mask
  FROM l
)"""
    )


_HARD = _box_pairs("greatest(delta, 0)", "meet")
_SOFT = _box_pairs("least((greatest(delta * 20, 0) + ln(1 + exp(-abs(delta * 20)))) / 20, room)", "TRUE")
_GRAPH_LOSS = f"""(SELECT avg(m) AS loss, count(*) AS n_types, sum(n)::BIGINT AS n_targets FROM (
  SELECT ctype, sum(({_SMOOTH.format('e')} + 0.1 * {_SMOOTH.format('(e / greatest(abs(target), 0.1))')}) * weight) / count(*) AS m, count(*) AS n
  FROM valid GROUP BY ctype))"""
_CALIBRATION = f"""(SELECT avg(m) AS loss, count(*) AS n_types FROM (
  SELECT ctype, avg(CASE WHEN jaccard > 0 THEN {_SMOOTH.format('(ln(greatest(iou, 1e-12)) - ln(greatest(jaccard, 1e-12)))')} ELSE iou * iou END) AS m
  FROM g WHERE iou_mask GROUP BY ctype))"""
_SPLIT = """WITH samples AS (SELECT l_orderkey AS test_id, s_nationkey AS module FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
grp AS (SELECT test_id, md5('42|' || test_id) AS h, count(*) AS n FROM samples GROUP BY test_id),
reserved AS (SELECT DISTINCT arg_max(test_id, h) AS test_id FROM samples JOIN grp USING (test_id) GROUP BY module),
marked AS (SELECT test_id, h, test_id IN (SELECT test_id FROM reserved) AS kept, n FROM grp),
run AS (SELECT test_id, kept, coalesce(sum(CASE WHEN kept THEN 0 ELSE n END) OVER (ORDER BY h, test_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM marked),
split AS (SELECT test_id, NOT kept AND before < (SELECT greatest(1, floor(count(*) * 0.1)) FROM samples) AS is_val FROM run)"""

ORACLES = {
    "coverage_density": _COV + " SELECT module, sample, ctype, n AS n_elements, c::INT AS covered, round(c / n, 6) AS density FROM cnt",
    "coverage_signature_counts": _COV + " SELECT module, ctype, count(*) AS n_samples, sum(c)::BIGINT AS covered, max(c)::INT AS most FROM cnt GROUP BY ALL",
    "coverage_global_ids": _COV + """, g AS (
      SELECT module, sample, e + CASE ctype WHEN 'line' THEN 0 WHEN 'condition' THEN 25 WHEN 'toggle' THEN 30 WHEN 'fsm' THEN 36 ELSE 39 END AS i FROM cov)
      SELECT module, sample, count(*) AS n, min(i)::BIGINT AS first, max(i)::BIGINT AS last, sum(i)::BIGINT AS total FROM g GROUP BY ALL""",
    "pair_jaccard": _PAIRS + """ SELECT module, sample_a, sample_b, ctype, round(ca / n, 6) AS density_a, round(cb / n, 6) AS density_b, n > 0 AS size_mask,
      round(jaccard, 6) AS jaccard, ca + cb - inter > 0 AS iou_mask FROM jac""",
    "coverage_similarity": _PAIRS + " SELECT module, sample_a, sample_b, round(similarity, 6) AS similarity FROM sim",
    "most_similar_pairs": _PAIRS + """ SELECT module, sample_a, sample_b, round(similarity, 6) AS similarity FROM sim
      ORDER BY round(similarity, 6) DESC, sample_a, sample_b LIMIT 20""",
    "similar_signatures": _PAIRS + """, sig AS (SELECT module, sample, string_agg(k || ':' || e, ',' ORDER BY k, e) AS sig FROM cov GROUP BY ALL),
      cls AS (SELECT module, sample, min(sample) OVER (PARTITION BY module, sig) AS class FROM sig)
      SELECT s.module, least(a.class, b.class) AS class_a, greatest(a.class, b.class) AS class_b, round(any_value(similarity), 6) AS similarity,
             count(*) AS n_pairs FROM sim s JOIN cls a ON a.module = s.module AND a.sample = sample_a JOIN cls b ON b.module = s.module AND b.sample = sample_b
      WHERE round(similarity, 9) >= 0.8 GROUP BY 1, 2, 3""",
    "candidate_pool": _COV + "," + _RING.format(source="cov", pool=256) + " SELECT module, anchor, candidate FROM dir",
    "relative_strata": _STRATA + " SELECT module, anchor, candidate, rank, pool_size, stratum, round(similarity, 6) AS similarity FROM strata",
    "quota_candidates": _STRATA + " SELECT module, anchor, candidate, stratum, place FROM placed WHERE place <= quota",
    "pair_selection": _STRATA + " SELECT module, sample_a, sample_b, anchor, stratum, round(similarity, 6) AS similarity FROM chosen",
    "greedy_pairs": _STRATA.replace("WITH ", "WITH RECURSIVE ", 1) + """, l AS (
        SELECT module, anchor, row_number() OVER (PARTITION BY module ORDER BY md5('0|' || module || '|' || anchor), anchor) AS rn,
               list(candidate ORDER BY place) FILTER (stratum = 'low') AS low, list(candidate ORDER BY place) FILTER (stratum = 'mid') AS mid,
               list(candidate ORDER BY place) FILTER (stratum = 'high') AS high FROM placed GROUP BY module, anchor),
      f AS (
        SELECT module, 0::BIGINT AS rn, []::VARCHAR[] AS taken, NULL::BIGINT AS anchor, []::BIGINT[] AS a, []::BIGINT[] AS b, []::BIGINT[] AS c
        FROM (SELECT DISTINCT module FROM l)
        UNION ALL
        SELECT module, rn, list_concat(taken, list_transform(list_concat(a, b, c), lambda x: least(anchor, x) || '-' || greatest(anchor, x))), anchor, a, b, c
        FROM (SELECT f.module, l.rn, taken, l.anchor,
                     list_filter(coalesce(low, []), lambda x: NOT list_contains(taken, least(l.anchor, x) || '-' || greatest(l.anchor, x)))[1:2] AS a,
                     list_filter(coalesce(mid, []), lambda x: NOT list_contains(taken, least(l.anchor, x) || '-' || greatest(l.anchor, x)))[1:1] AS b,
                     list_filter(coalesce(high, []), lambda x: NOT list_contains(taken, least(l.anchor, x) || '-' || greatest(l.anchor, x)))[1:1] AS c
              FROM f JOIN l ON l.module = f.module AND l.rn = f.rn + 1)),
      g AS (SELECT module, anchor, unnest(a) AS candidate FROM f UNION ALL SELECT module, anchor, unnest(b) FROM f UNION ALL SELECT module, anchor, unnest(c) FROM f)
      SELECT module, least(anchor, candidate) AS sample_a, greatest(anchor, candidate) AS sample_b, anchor, stratum, round(similarity, 6) AS similarity
      FROM g JOIN placed USING (module, anchor, candidate)""",
    "endpoint_weights": _STRATA + " SELECT module, sample, degree, round((SELECT avg(degree) FROM deg) / degree, 6) AS weight FROM deg",
    "pair_diagnostics": _STRATA + """, pools AS (
      SELECT module, anchor, count(*) AS pool, least(2, count(*) FILTER (stratum = 'low')) AS low, least(1, count(*) FILTER (stratum = 'mid')) AS mid,
             least(1, count(*) FILTER (stratum = 'high')) AS high FROM strata GROUP BY ALL)
      SELECT a.*, b.*, c.* FROM
      (SELECT count(*) AS n_anchors, min(pool) AS pool_min, round(avg(pool), 6) AS pool_mean, max(pool) AS pool_max, 2 * count(*) AS requested_low,
              count(*) AS requested_mid, count(*) AS requested_high, sum(low)::BIGINT AS available_low, sum(mid)::BIGINT AS available_mid,
              sum(high)::BIGINT AS available_high, count(*) - (SELECT count(*) FROM deg) AS degree_zero,
              (SELECT count(*) - count(DISTINCT (module, least(anchor, candidate), greatest(anchor, candidate))) FROM placed WHERE place <= quota) AS conflicts,
              (SELECT coalesce(sum(n * (n - 1)), 0)::BIGINT FROM (SELECT count(*) AS n FROM ring GROUP BY module, sig)) AS equal_candidates,
              (SELECT fingerprint FROM (__PRINT__)) AS fingerprint FROM pools) a,
      (SELECT count(*) AS n_endpoints, min(degree) AS degree_min, round(avg(degree), 6) AS degree_mean, max(degree) AS degree_max FROM deg) b,
      (SELECT count(*) AS n_pairs, round(min(similarity), 6) AS similarity_min, round(avg(similarity), 6) AS similarity_mean,
              round(max(similarity), 6) AS similarity_max, count(*) FILTER (stratum = 'low') AS fulfilled_low,
              count(*) FILTER (stratum = 'mid') AS fulfilled_mid, count(*) FILTER (stratum = 'high') AS fulfilled_high FROM chosen) c""",
    "pair_fingerprint": _STRATA + """, h AS (SELECT sha256(sample_a || '|' || sample_b || '|' || stratum) AS h FROM chosen),
      grp AS (SELECT substr(h, 1, 2) AS g, count(*) AS n, sum(CAST('0x' || substr(h, 3, 12) AS UBIGINT))::VARCHAR AS s FROM h GROUP BY 1)
      SELECT sum(n)::BIGINT AS n_pairs, substr(sha256(string_agg(g || ':' || n || ':' || s, chr(10) ORDER BY g)), 1, 16) AS fingerprint FROM grp""",
    "ranking_batches_snake": _ORDER + """, b AS (SELECT *, position // 2 AS rp, ceil(ceil(total / 2) / 64)::BIGINT AS nb FROM pos)
      SELECT sample_a, sample_b, position, position % 2 AS rank_id, (CASE WHEN (rp // nb) % 2 = 0 THEN rp % nb ELSE nb - 1 - rp % nb END)::INT AS batch FROM b""",
    "eval_shards": _ORDER + """, b AS (SELECT *, (position % 4)::INT AS rank_id, position // 4 AS rp FROM pos)
      SELECT sample_a, sample_b, rank_id, (rp % ceil(((total - rank_id + 3) // 4) / 32)::BIGINT)::INT AS batch FROM b""",
    "bucket_batches": """WITH RECURSIVE sizes AS (
        SELECT o_custkey AS sample, count(*) AS size, md5(o_custkey::VARCHAR) AS h FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
      dealt AS (SELECT sample, size, h, (size >= 16)::INT + (size >= 32)::INT + (size >= 64)::INT AS bucket,
                       (CAST('0x' || substr(h, 1, 7) AS UBIGINT) % greatest(1, (SELECT ceil(count(*) / 100)::BIGINT FROM sizes)))::INT AS run FROM sizes),
      ordered AS (SELECT *, row_number() OVER (PARTITION BY bucket, run ORDER BY h, sample) AS rn FROM dealt),
      f AS (
        SELECT bucket, run, rn, sample, size, 0 AS batch, size AS filled FROM ordered WHERE rn = 1
        UNION ALL
        SELECT o.bucket, o.run, o.rn, o.sample, o.size, f.batch + (filled + o.size > 256)::INT, CASE WHEN filled + o.size > 256 THEN o.size ELSE filled + o.size END
        FROM f JOIN ordered o ON o.bucket = f.bucket AND o.run = f.run AND o.rn = f.rn + 1)
      SELECT sample, size, bucket, run, batch FROM f""",
    "grouped_split": _SPLIT + " SELECT test_id, is_val FROM split",
    "sequential_split": """WITH RECURSIVE samples AS (
        SELECT l_orderkey AS test_id, s_nationkey AS module FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
        WHERE s_nationkey % 2 = 0 OR (s_nationkey * 37 + l_orderkey) % 997 < 2),
      mods AS (SELECT module, row_number() OVER (ORDER BY module) AS m, count(*) AS n FROM samples GROUP BY module),
      k AS (SELECT count(*) AS k FROM mods), goal AS (SELECT greatest(1, floor(count(*) * 0.3))::BIGINT AS goal FROM samples),
      per AS (SELECT test_id, m, count(*) AS n FROM samples JOIN mods USING (module) GROUP BY ALL),
      grp AS (SELECT test_id, row_number() OVER (ORDER BY md5('42|' || test_id), test_id) AS rn, sum(n)::BIGINT AS n, map_from_entries(list((m, n))) AS by_m
              FROM per GROUP BY test_id),
      f AS (
        SELECT 0::BIGINT AS rn, NULL::BIGINT AS test_id, FALSE AS ok, 0::BIGINT AS filled, (SELECT list(n ORDER BY m) FROM mods) AS rest
        UNION ALL
        SELECT rn, test_id, ok, filled + CASE WHEN ok THEN n ELSE 0 END,
               CASE WHEN ok THEN list_transform(rest, lambda x, i: x - coalesce(by_m[i], 0)) ELSE rest END
        FROM (SELECT g.rn, g.test_id, g.n, g.by_m, f.filled, f.rest,
                     len(list_filter(map_keys(g.by_m), lambda i: f.rest[i] - g.by_m[i] <= 0)) = 0 AS ok
              FROM f JOIN grp g ON g.rn = f.rn + 1 WHERE f.filled < (SELECT goal FROM goal)))
      SELECT test_id, coalesce(f.ok, FALSE) AS is_val FROM grp LEFT JOIN f USING (test_id)""",
    "split_diagnostics": _SPLIT + """, s AS (SELECT * FROM samples JOIN split USING (test_id)),
      m AS (SELECT module, bool_or(is_val) AS v, bool_or(NOT is_val) AS t FROM s GROUP BY module)
      SELECT a.*, b.* FROM
      (SELECT count(*) FILTER (NOT is_val) AS train_rows, count(*) FILTER (is_val) AS val_rows, count(DISTINCT test_id) FILTER (NOT is_val) AS train_stimuli,
              count(DISTINCT test_id) FILTER (is_val) AS val_stimuli, 0::BIGINT AS shared_stimuli FROM s) a,
      (SELECT count(*) FILTER (t) AS train_modules, count(*) FILTER (v) AS val_modules, count(*) FILTER (v AND NOT t) AS val_only_modules FROM m) b""",
    "regression_metrics": _REG + """ SELECT ctype, n, round(mse, 6) AS mse, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(smape, 6) AS smape,
      round(median_ae, 6) AS median_ae, round(mape, 6) AS mape, round(r2, 6) AS r2, round(pearson_r, 6) AS pearson_r FROM reg""",
    "metric_rows": _REG + """ SELECT 'val' AS stage, name || '_' || ctype AS name, round(value, 6) AS value
      FROM (UNPIVOT (SELECT * EXCLUDE (n) FROM reg) ON mse, mae, rmse, smape, median_ae, mape, r2, pearson_r INTO NAME name VALUE value)""",
    "spearman": _PRED + """, v AS (SELECT ctype, pred AS p, target AS t FROM valid),
      r AS (SELECT ctype, rank() OVER (PARTITION BY ctype ORDER BY p) + (count(*) OVER (PARTITION BY ctype, p) - 1) / 2 AS x,
                   rank() OVER (PARTITION BY ctype ORDER BY t) + (count(*) OVER (PARTITION BY ctype, t) - 1) / 2 AS y FROM v)
      SELECT ctype, count(*) AS n, round(corr(x, y), 6) AS spearman FROM r GROUP BY ctype""",
    "weighted_graph_loss": _PRED + f" SELECT round(loss, 6) AS loss, n_types, n_targets FROM {_GRAPH_LOSS}",
    "box_volume": _BOXES + " SELECT module, sample, ctype, round(lv, 6) AS log_volume, round(exp(lv), 6) AS volume FROM vol",
    "box_iou": _HARD + " SELECT module, sample_a, sample_b, ctype, round(intersection, 6) AS intersection, round(iou, 6) AS iou, meet FROM g",
    "box_iou_smooth": _SOFT + """ SELECT module, sample_a, sample_b, ctype, round(intersection, 6) AS intersection, round(iou, 6) AS iou,
      round(log_iou, 6) AS log_iou FROM g""",
    "geometry_metrics": _HARD + """ SELECT
      round(avg((abs(exp(va) - ta) + abs(exp(vb) - tb)) / 2) FILTER (size_mask), 6) AS volume_mae,
      round(avg((iou - jaccard) ** 2) FILTER (iou_mask), 6) AS iou_mse, round(avg(abs(iou - jaccard)) FILTER (iou_mask), 6) AS iou_mae,
      round(avg((exp(va) + exp(vb)) / 2) FILTER (size_mask), 6) AS predicted_volume_mean, round(avg((ta + tb) / 2) FILTER (size_mask), 6) AS target_density_mean,
      round(avg(iou) FILTER (iou_mask), 6) AS predicted_iou_mean, round(avg(jaccard) FILTER (iou_mask), 6) AS target_jaccard_mean,
      round(avg((NOT meet)::INT) FILTER (iou_mask AND jaccard > 0), 6) AS positive_pair_zero_intersection_ratio,
      round(sum(low) / (10 * count(*)), 6) AS min_boundary_saturation, round(sum(high) / (10 * count(*)), 6) AS max_boundary_saturation FROM g""",
    "volume_loss": _HARD + f""", e AS (
      SELECT ctype, size_mask, unnest([va, vb]) AS lv, unnest([ta, tb]) AS t, unnest([sample_a % 3 + 1, sample_b % 3 + 1]) AS w FROM g)
      SELECT round(avg(m), 6) AS loss, count(*) AS n_types FROM (
        SELECT ctype, sum({_SMOOTH.format('(lv - ln(greatest(1e-15, least(1.0, t))))')} * w) / count(*) AS m FROM e WHERE size_mask GROUP BY ctype)""",
    "iou_calibration": _HARD + f" SELECT round(loss, 6) AS loss, n_types FROM {_CALIBRATION}",
    "iou_rank_loss": _HARD + """, q AS (SELECT module, sample_a, sample_b, sample_b // 16 AS run, ctype, iou, round(jaccard, 6) AS jaccard FROM g WHERE iou_mask),
      p AS (SELECT a.ctype, greatest(0.05 - sign(a.jaccard - b.jaccard) * (a.iou - b.iou), 0) AS x FROM q a JOIN q b
            ON a.module = b.module AND a.sample_a = b.sample_a AND a.run = b.run AND a.ctype = b.ctype AND a.sample_b < b.sample_b
            WHERE abs(a.jaccard - b.jaccard) > 0 AND abs(a.jaccard - b.jaccard) >= 0.1)
      SELECT round(avg(m), 6) AS loss, sum(n)::BIGINT AS n_pairs, count(*) AS n_types FROM (SELECT ctype, avg(x) AS m, count(*) AS n FROM p GROUP BY ctype)""",
    "joint_loss": _SOFT + f""", guess AS (SELECT vec_id AS sample, ctype, 1 / (1 + exp(-4 * embedding[k + 56]::DOUBLE)) AS pred FROM embeddings, types),
      s AS (SELECT g.ctype, unnest(['a', 'b']) AS side, unnest([a.pred - ta, b.pred - tb]) AS e, unnest([ta, tb]) AS target, unnest([sample_a % 3 + 1, sample_b % 3 + 1]) AS weight
            FROM g JOIN guess a ON a.sample = sample_a AND a.ctype = g.ctype JOIN guess b ON b.sample = sample_b AND b.ctype = g.ctype),
      sup AS (SELECT avg(m) AS loss FROM (
        SELECT side, ctype, sum(({_SMOOTH.format('e')} + 0.1 * {_SMOOTH.format('(e / greatest(abs(target), 0.1))')}) * weight) / count(*) AS m FROM s GROUP BY ALL)),
      vol_e AS (SELECT ctype, size_mask, unnest([va, vb]) AS lv, unnest([ta, tb]) AS t, unnest([sample_a % 3 + 1, sample_b % 3 + 1]) AS w FROM g),
      volume AS (SELECT avg(m) AS loss FROM (
        SELECT ctype, sum({_SMOOTH.format('(lv - ln(greatest(1e-15, least(1.0, t))))')} * w) / count(*) AS m FROM vol_e WHERE size_mask GROUP BY ctype)),
      cal AS (SELECT avg(m) AS loss FROM (
        SELECT ctype, avg(CASE WHEN jaccard > 0 THEN {_SMOOTH.format('(log_iou - ln(greatest(jaccard, 1e-12)))')} ELSE iou * iou END) AS m FROM g WHERE iou_mask GROUP BY ctype)),
      q AS (SELECT module, sample_a, sample_b, sample_b // 16 AS run, ctype, iou, round(jaccard, 6) AS jaccard FROM g WHERE iou_mask),
      p AS (SELECT a.ctype, greatest(0.05 - sign(a.jaccard - b.jaccard) * (a.iou - b.iou), 0) AS x FROM q a JOIN q b
            ON a.module = b.module AND a.sample_a = b.sample_a AND a.run = b.run AND a.ctype = b.ctype AND a.sample_b < b.sample_b
            WHERE abs(a.jaccard - b.jaccard) > 0 AND abs(a.jaccard - b.jaccard) >= 0.1),
      rank_ AS (SELECT avg(m) AS loss FROM (SELECT ctype, avg(x) AS m FROM p GROUP BY ctype))
      SELECT epoch, round(coalesce(sup.loss, 0) + 0.5 * (coalesce(cal.loss, 0) + 0.5 * coalesce(rank_.loss, 0)) + 0.25 * least(1.0, epoch / 4) * coalesce(volume.loss, 0), 6) AS loss
      FROM (SELECT unnest(range(1, 6)) AS epoch), sup, cal, rank_, volume""",
    "prediction_records": _BOXES + """ SELECT sample::VARCHAR AS sample_id, count(*) AS n_types, round(avg(exp(lv)), 6) AS mean_volume,
      round(max(truth) FILTER (ctype = 'line'), 6) AS line, round(max(exp(lv)) FILTER (ctype = 'branch'), 6) AS branch_volume FROM vol GROUP BY sample""",
    "matched_predictions": _BOXES + """ SELECT sample::VARCHAR AS sample_id, module, round(avg(exp(lv)), 6) AS mean_volume FROM vol GROUP BY sample, module""",
    "valid_edges": _EDGES + " SELECT graph, edge_type, count(*) AS n, round(sum(m), 6) AS total FROM valid GROUP BY ALL",
    "dense_edge_labels": _EDGES + """, given AS (
        SELECT graph, position, CASE WHEN bool_or(edge_type = 3) THEN 0 WHEN bool_or(edge_type = 0) THEN 1 END AS label FROM edges GROUP BY ALL),
      s AS (SELECT i AS sample, i % 8 AS graph, CASE WHEN i < 8 THEN 0 ELSE -1 END AS d FROM (SELECT unnest(range(16)) AS i)),
      x AS (SELECT sample, s.graph, coalesce(CASE WHEN sample < 8 THEN label END, d)::INT AS label
            FROM s JOIN valid v ON v.graph = s.graph LEFT JOIN given g ON g.graph = v.graph AND g.position = v.position)
      SELECT sample, graph, label, count(*) AS n FROM x GROUP BY ALL""",
    "segment_sum_by_type": _EDGES + " SELECT graph, dst, " + ", ".join(
        f"round(coalesce(sum(m) FILTER (edge_type = {k}), 0), 6) AS sum_{n}" for k, n in enumerate("data data_true data_false control clock reset enable".split())
    ) + " FROM edges GROUP BY ALL",
    "segment_mean_max": _EDGES + """ SELECT graph, dst, round(sum(m), 6) AS all_sum, round(avg(m), 6) AS all_mean, round(greatest(0.0, max(m)), 6) AS all_max,
      count(*) AS degree FROM edges GROUP BY ALL""",
    "port_sums": _EDGES + """ SELECT graph, dst, round(coalesce(sum(m) FILTER (target_port = 0), 0), 6) AS port_a,
      round(coalesce(sum(m) FILTER (target_port = 1), 0), 6) AS port_b,
      round(coalesce(sum(m * target_port / 4) FILTER (edge_type IN (0, 6)), 0), 6) AS mem FROM edges GROUP BY ALL""",
    "attention_softmax": _EDGES + """, a AS (SELECT graph, dst, m, exp(score - max(score) OVER (PARTITION BY graph, dst)) AS e FROM edges),
      b AS (SELECT graph, dst, m, e / sum(e) OVER (PARTITION BY graph, dst) AS w FROM a)
      SELECT graph, dst, round(max(w), 6) AS most, round(sum(w * m), 6) AS mixed FROM b GROUP BY ALL""",
    "routed_aggregate": _EDGES + """, a AS (SELECT *, exp(score - max(score) OVER (PARTITION BY graph, dst)) AS x FROM edges),
      b AS (SELECT *, x / sum(x) OVER (PARTITION BY graph, dst) AS w FROM a),
      s AS (SELECT graph, dst, """ + ", ".join(
        f"coalesce(sum(m) FILTER (edge_type = {k}), 0) AS {n}" for k, n in enumerate("t0 t1 t2 t3 t4 t5 t6".split())
    ) + """, bool_or(edge_type = 3) AS ctl, coalesce(sum(m) FILTER (target_port = 0), 0) AS pa, coalesce(sum(m) FILTER (target_port = 1), 0) AS pb,
             sum(m * w) AS att, avg(m) AS mean_, greatest(0, max(m)) AS max_ FROM b GROUP BY ALL),
      q AS (SELECT *, 1 / (1 + exp(-t3)) AS at_, 1 / (1 + exp(-t5)) AS gr, 1 / (1 + exp(-t6)) AS ge FROM s)
      SELECT n.graph, node, node_type, round(coalesce(CASE WHEN ctl THEN at_ * t1 + (1 - at_) * t2 + t0 + t4 + t5 + t6
        WHEN node_type = 4 THEN gr * t5 + (1 - gr) * (ge * t0 + (1 - ge) * t4) WHEN node_type = 5 THEN t0 + t6
        WHEN node_type IN (7, 9, 10) THEN pa - pb ELSE (att + mean_ + max_) / 3 END, 0), 6) AS out
      FROM nodes n LEFT JOIN q ON q.graph = n.graph AND q.dst = n.node""",
    "cross_read": """WITH x AS (SELECT label AS graph, vec_id, k AS dim, embedding[k + 1]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(8)) AS k)),
      q AS (SELECT l AS latent, k AS dim, (k + l) % 3 - 1 AS q FROM (SELECT unnest(range(3)) AS l), (SELECT unnest(range(8)) AS k)),
      s AS (SELECT graph, vec_id, latent, sum(v * q) / sqrt(8) AS s FROM x JOIN q USING (dim) WHERE vec_id % 2 = 1 AND graph <> 3 GROUP BY ALL),
      a AS (SELECT graph, vec_id, latent, exp(s - max(s) OVER (PARTITION BY graph, latent)) AS e FROM s),
      w AS (SELECT graph, vec_id, latent, e / sum(e) OVER (PARTITION BY graph, latent) AS w FROM a),
      z AS (SELECT graph, latent, dim, sum(w * v) AS z FROM w JOIN x USING (graph, vec_id) GROUP BY ALL),
      t AS (SELECT graph, vec_id, latent, sum(v * z) / sqrt(8) AS s FROM x JOIN z USING (graph, dim) WHERE vec_id % 2 = 0 GROUP BY ALL),
      b AS (SELECT graph, vec_id, latent, exp(s - max(s) OVER (PARTITION BY graph, vec_id)) AS e FROM t),
      u AS (SELECT graph, vec_id, latent, e / sum(e) OVER (PARTITION BY graph, vec_id) AS w FROM b),
      r AS (SELECT graph, vec_id, dim, sum(w * z) AS r FROM u JOIN z USING (graph, latent) GROUP BY ALL)
      SELECT graph, vec_id AS node, x.dim::INT AS dim, round(v + 0.5 * coalesce(r, 0), 6) AS v FROM x LEFT JOIN r USING (graph, vec_id, dim) WHERE vec_id % 2 = 0""",
    "gcn_norm": _EDGES + """, f AS (SELECT graph, src, dst FROM valid UNION ALL SELECT graph, node, node FROM nodes),
      d AS (SELECT graph, dst AS node, count(*) AS d FROM f GROUP BY ALL)
      SELECT f.graph, f.dst, count(*) AS n, round(sum(1 / sqrt(a.d * b.d)), 6) AS total
      FROM f JOIN d a ON a.graph = f.graph AND a.node = f.src JOIN d b ON b.graph = f.graph AND b.node = f.dst GROUP BY f.graph, f.dst""",
    "mean_pool": """WITH x AS (SELECT label AS graph, unnest(range(len(embedding)))::INT AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings)
      SELECT graph, dim, round(avg(v), 6) AS v FROM x GROUP BY ALL""",
    "cross_pool": """WITH x AS (SELECT label AS graph, vec_id, k AS dim, embedding[k + 1]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(64)) AS k)),
      q AS (SELECT l AS latent, k AS dim, (k + l) % 3 - 1 AS q FROM (SELECT unnest(range(3)) AS l), (SELECT unnest(range(64)) AS k)),
      s AS (SELECT graph, vec_id, latent, sum(v * q) / sqrt(64) AS s FROM x JOIN q USING (dim) GROUP BY ALL),
      a AS (SELECT graph, vec_id, latent, exp(s - max(s) OVER (PARTITION BY graph, latent)) AS e FROM s),
      w AS (SELECT graph, vec_id, latent, e / sum(e) OVER (PARTITION BY graph, latent) AS w FROM a)
      SELECT graph, latent::INT AS latent, dim::INT AS dim, round(sum(w * v), 6) AS v FROM w JOIN x USING (graph, vec_id) GROUP BY ALL""",
    "dataset_overview": _EDGES + """ SELECT a.*, b.*, c.* FROM (SELECT count(*) AS n_samples, count(DISTINCT l_orderkey) AS n_tests, count(DISTINCT s_nationkey) AS n_modules
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) a, (SELECT count(*) AS n_nodes FROM nodes) b, (SELECT count(*) AS n_edges FROM edges) c""",
    "module_profile": _EDGES + """ SELECT graph, n_nodes, n_edges, round(n_edges / (n_nodes * (n_nodes - 1)), 6) AS density, round(2 * n_edges / n_nodes, 6) AS avg_degree
      FROM (SELECT graph, count(*) AS n_nodes FROM nodes GROUP BY 1) JOIN (SELECT graph, count(*) AS n_edges FROM edges GROUP BY 1) USING (graph)""",
    "label_distribution": _EDGES + """, l AS (SELECT graph AS module, order_key % 3 - 1 AS label FROM edges)
      SELECT coalesce(module::VARCHAR, 'all') AS module, count(*) AS n, count(*) FILTER (label = -1) AS unlabelled, count(*) FILTER (label = 0) AS uncovered, count(*) FILTER (label = 1) AS covered,
             round(count(*) FILTER (label = 1) / count(*) FILTER (label = 0), 6) AS ratio, round(count(*) FILTER (label = -1) / count(*), 6) AS unlabelled_share
      FROM l GROUP BY ROLLUP (module)""",
    "label_crosstab": _EDGES + """ SELECT edge_type, count(*) FILTER (order_key % 3 = 0) AS unlabelled, count(*) FILTER (order_key % 3 = 1) AS uncovered,
      count(*) FILTER (order_key % 3 = 2) AS covered FROM edges GROUP BY 1""",
    "type_shares": _EDGES + " SELECT node_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM nodes GROUP BY 1",
    "cell_type_topk": """WITH c AS (SELECT p_type AS module, p_brand, count(*) AS n FROM part GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY n DESC, p_brand) AS place FROM c)
      SELECT module, string_agg(p_brand, ',' ORDER BY place) AS names FROM r WHERE place <= 4 GROUP BY 1""",
    "size_summary": """WITH s AS (SELECT conv_id, sum(length(text))::DOUBLE AS size FROM conversations GROUP BY 1)
      SELECT count(*) AS n, min(size) AS min, max(size) AS max, round(avg(size), 6) AS mean, quantile_disc(size, 0.5) AS median, round(stddev_pop(size), 6) AS std FROM s""",
    "coverage_histogram": _COV + """ SELECT least(7, floor((c / n) / 0.125))::INT AS bucket, count(*) AS n FROM cnt WHERE ctype = 'branch' GROUP BY 1""",
    "size_correlation": _PRED + " SELECT count(*) AS n, round(corr(weight, target), 6) AS r FROM valid",
    "lr_schedule": """SELECT step, n, round(CASE WHEN step < 100 THEN step / 100 ELSE 0.5 * (1 + cos(pi() * (step - 100) / 900)) END, 6) AS cosine,
      round(CASE WHEN step < 100 THEN step / 100 ELSE greatest(0.0, 1 - (step - 100) / 900) END, 6) AS linear,
      round(CASE WHEN step < 100 THEN step / 100 ELSE 1.0 END, 6) AS "constant" FROM (SELECT o_orderkey % 1000 AS step, count(*) AS n FROM orders GROUP BY 1)""",
    "format_blocks": """WITH w AS (SELECT conv_id, turn, role, string_split(text, ' ') AS ws FROM conversations),
      i AS (SELECT conv_id, turn, role, CASE WHEN len(ws) > 3 THEN ws[1] || ' ' || ws[2] || ', ' || ws[3] ELSE ws[1] END AS line FROM w)
      SELECT conv_id AS file, turn AS position, CASE WHEN role = 'user' THEN line || chr(10) || line ELSE 'nop' END AS block FROM i""",
    "stable_seeds": """SELECT n_nationkey, substr(sha256('42|' || n_name), 1, 16) AS prefix, md5('42|' || n_name) AS shuffle,
      CAST('0x' || substr(sha256('42' || chr(0) || n_name), 1, 16) AS UBIGINT)::VARCHAR AS seed FROM nation""",
}

#: Expected codes, written out: cell types in the order of their codes, the node type of each, and the group of each node type.
_CELLS = """['INPUT', 'OUTPUT', 'CONSTANT', '$mux', '$pmux', '$bmux', '$demux', '$tribuf',
  '$dff', '$dffe', '$adff', '$adffe', '$asdff', '$asdffe', '$sdff', '$sdffe',
  '$sdffce', '$dlatch', '$adlatch', '$dlatchsr', '$sr', '$ff', '$aldff', '$aldffe',
  '$mem', '$mem_v2', '$memrd', '$memrd_v2', '$memwr', '$memwr_v2', '$meminit', '$meminit_v2',
  '$add', '$sub', '$mul', '$div', '$mod', '$divfloor', '$modfloor', '$pow',
  '$neg', '$pos', '$eq', '$ne', '$lt', '$le', '$gt', '$ge',
  '$eqx', '$nex', '$and', '$or', '$xor', '$xnor', '$not', '$reduce_and',
  '$reduce_or', '$reduce_xor', '$reduce_xnor', '$reduce_bool', '$logic_and', '$logic_or', '$logic_not', '$shl',
  '$shr', '$sshl', '$sshr', '$shift', '$shiftx', '$concat', '$slice', '$lut',
  '$sop', 'UNKNOWN']"""
_NODE_TYPES = "[0, 1, 2, 6, 6, 6, 6, 3, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 5, 5, 5, 5, 5, 5, 5, 5, 7, 7, 7, 7, 7, 7, 7, 7, 7, 7, 9, 9, 9, 9, 9, 9, 9, 9, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 10, 10, 10, 10, 10, 10, 3, 3, 3, 3, 11]"
_GROUPS = "[0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9]"
_HISTORY = """WITH RECURSIVE h AS (
  SELECT (o_orderkey % 100)::INT AS epoch, round(avg(o_totalprice) / 100000, 6) AS value FROM orders GROUP BY 1
), o AS (SELECT *, row_number() OVER (ORDER BY epoch) AS rn FROM h)"""

#: The diagnostics hold the fingerprint that has a query of its own.
ORACLES["pair_diagnostics"] = ORACLES["pair_diagnostics"].replace("__PRINT__", ORACLES["pair_fingerprint"])
ORACLES["combined_geometry_loss"] = f"""SELECT v.loss AS volume, v.n_types AS volume_types, c.loss AS iou, c.n_types AS iou_types, r.loss AS rank,
  r.n_types AS rank_types, r.n_pairs, round(0.25 * v.loss + 0.5 * c.loss + 0.125 * r.loss, 6) AS loss
  FROM ({ORACLES["volume_loss"]}) v, ({ORACLES["iou_calibration"]}) c, ({ORACLES["iou_rank_loss"]}) r"""

ORACLES |= {
    "type_codes": f"""WITH c AS (SELECT ({_CELLS} || ['INPUT', 'OUTPUT', '$other'])[p_partkey % (len({_CELLS}) + 3) + 1] AS cell, p_size FROM part),
      k AS (SELECT coalesce(list_position({_CELLS}, cell), len({_CELLS}))::INT - 1 AS cell, [0, 3, 6, 0][p_size % 4 + 1] AS edge_type FROM c),
      t AS (SELECT cell, edge_type, ({_NODE_TYPES})[cell + 1] AS node_type FROM k)
      SELECT cell, node_type, ({_GROUPS})[node_type + 1] AS agg_group, edge_type, count(*) AS n FROM t GROUP BY ALL""",
    "graph_targets": """SELECT p_partkey AS sample, ctype, CASE WHEN p_partkey % 5 <> 0 THEN CASE ctype WHEN 'line' THEN round(p_size / 100, 6)
        WHEN 'toggle' THEN round(p_retailprice / 10000, 6) END END AS y
      FROM part, (SELECT unnest(['branch', 'line', 'fsm', 'toggle', 'condition']) AS ctype)""",
    "covered_items": """SELECT l_orderkey AS sample, 'line' AS ctype, 1 AS place, count(*) FILTER (l_returnflag <> 'N') AS covered, count(*) AS n_items
      FROM lineitem GROUP BY 1""",
    "token_pool": """WITH t AS (SELECT label AS text_id, vec_id, k::INT AS dim, embedding[k + 1]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(64)) AS k))
      SELECT text_id, dim, round(avg(v) FILTER (vec_id % 3 <> 0), 6) AS mean, round(arg_min(v, vec_id), 6) AS first FROM t GROUP BY ALL""",
    "gcn_propagate": _EDGES + """, f AS (SELECT graph, src, dst FROM valid UNION ALL SELECT graph, node, node FROM nodes),
      d AS (SELECT graph, dst AS node, count(*) AS d FROM f GROUP BY ALL)
      SELECT f.graph, f.dst AS node, round(sum(1 / sqrt(a.d * b.d)), 6) AS x0, round(sum(n.node_type / sqrt(a.d * b.d)), 6) AS x1
      FROM f JOIN d a ON a.graph = f.graph AND a.node = f.src JOIN d b ON b.graph = f.graph AND b.node = f.dst
      JOIN nodes n ON n.graph = f.graph AND n.node = f.src GROUP BY f.graph, f.dst""",
    "cell_features": _EDGES + """, w AS (SELECT graph, node, node_type AS c, log2(node_type * 3 + graph + 1) AS w FROM nodes),
      x AS (SELECT graph, node, c / 4 + 0.5 * w AS a, c % 3 - 1.0 - 0.25 * w AS b, 0.5 + w AS c FROM w),
      m AS (SELECT *, (a + b + c) / 3 AS m FROM x), v AS (SELECT *, sqrt(((a - m) ** 2 + (b - m) ** 2 + (c - m) ** 2) / 3 + 1e-5) AS s FROM m)
      SELECT graph, node, round((a - m) / s, 6) AS x0, round((b - m) / s, 6) AS x1, round((c - m) / s, 6) AS x2 FROM v""",
    "combined_graphs": """SELECT label AS graph, k::INT AS dim, round(avg(embedding[k + 1]::DOUBLE) + avg(embedding[k + 33]::DOUBLE), 6) AS v
      FROM embeddings, (SELECT unnest(range(32)) AS k) GROUP BY ALL""",
    "aggregation_mix": _EDGES + """, g AS (SELECT greatest(0, node_type - 2)::INT AS g, count(*) AS n FROM nodes GROUP BY 1),
      e AS (SELECT g, n, exp(g / 10) AS a, exp(0.5) AS b, exp(1 - g / 5) AS c FROM g)
      SELECT g AS agg_group, n, round(a / (a + b + c), 6) AS sum, round(b / (a + b + c), 6) AS mean, round(c / (a + b + c), 6) AS max FROM e""",
    "pair_records": _STRATA + """, s AS (SELECT module, sample, sum(c)::INT AS covered FROM cnt GROUP BY ALL)
      SELECT c.module, sample_a, sample_b, stratum, a.covered AS covered_a, b.covered AS covered_b
      FROM chosen c JOIN s a ON a.sample = sample_a JOIN s b ON b.sample = sample_b""",
    "pair_targets": _STRATA + """, w AS (SELECT module, sample, degree, (SELECT avg(degree) FROM deg) / degree AS weight FROM deg)
      SELECT c.module, c.sample_a, c.sample_b, stratum, ctype, round(ca / n, 6) AS density_a, round(cb / n, 6) AS density_b, n > 0 AS size_mask,
             round(jaccard, 6) AS jaccard, ca + cb - inter > 0 AS iou_mask, a.degree AS degree_a, b.degree AS degree_b, round(a.weight, 6) AS weight_a,
             round(b.weight, 6) AS weight_b
      FROM chosen c JOIN jac USING (module, sample_a, sample_b) JOIN w a ON a.sample = c.sample_a JOIN w b ON b.sample = c.sample_b""",
    "geometry_spearman": _HARD + """, v AS (SELECT round(iou, 6) AS p, round(jaccard, 6) AS t FROM g WHERE iou_mask),
      r AS (SELECT rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS x, rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2 AS y FROM v)
      SELECT 'iou' AS ctype, count(*) AS n, round(corr(x, y), 6) AS spearman FROM r""",
    "module_coverage": _COV + """ SELECT module, ctype, count(*) AS n_samples, round(avg(c / n), 6) AS mean, round(stddev_pop(c / n), 6) AS std FROM cnt GROUP BY ALL""",
    "shard_scale": """SELECT o_custkey % 7 AS rank_id, count(*) AS n, round(count(*) OVER () * count(*) / sum(count(*)) OVER (), 6) AS scale FROM orders GROUP BY 1""",
    "best_epochs": _HISTORY + " SELECT epoch, value FROM h ORDER BY value, epoch LIMIT 5",
    "early_stop": _HISTORY + """, b AS (SELECT *, coalesce(value < min(value) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS better FROM o),
      c AS (SELECT *, rn - max(CASE WHEN better THEN rn END) OVER (ORDER BY rn) AS bad FROM b)
      SELECT min(epoch) FILTER (bad >= 8) AS stop_epoch FROM c""",
    "plateau_rates": _HISTORY + """, f AS (
        SELECT rn, epoch, value AS best, 0 AS bad, 1.0::DOUBLE AS rate FROM o WHERE rn = 1
        UNION ALL
        SELECT o.rn, o.epoch, least(best, value), CASE WHEN value < best OR bad = 3 THEN 0 ELSE bad + 1 END,
               CASE WHEN value >= best AND bad = 3 THEN rate / 2 ELSE rate END
        FROM f JOIN o ON o.rn = f.rn + 1)
      SELECT epoch, round(rate, 6) AS rate FROM f""",
    "drop_path_rates": "SELECT p_partkey % 4 AS layer, count(*) AS n, round(0.1 * (p_partkey % 4), 6)::DOUBLE AS rate FROM part GROUP BY ALL",
    "scalar_maths": f"""WITH r AS (SELECT c_custkey, c_acctbal / 1000 AS x FROM customer)
      SELECT c_custkey, round({_SMOOTH.format('x')}, 6) AS smooth_l1, round(1 / greatest(abs(x - 1), 0.1), 6) AS relative_error, round(1 / (1 + exp(-x)), 6) AS sigmoid,
             round((greatest(2 * x, 0) + ln(1 + exp(-abs(2 * x)))) / 2, 6) AS softplus, round(greatest(x, 0), 6) AS relu, round(log2(abs(x) + 1), 6) AS width_code FROM r""",
}


# --- the gated layer over vectors of two places, stage by stage ------------------------------------

#: ln of the odd factorials 1, 3, 15, 105, ... that the series of the error function is divided by.
_ODD = [0.0]
for _n in range(1, 200):
    _ODD.append(_ODD[-1] + math.log(2 * _n + 1))
_ODD_SQL = "[" + ", ".join(f"{x:.15g}" for x in _ODD) + "]"


def _weighted(inputs: list[str], outputs: int, k: int) -> list[str]:
    """A linear layer over columns: weights and bias of the rule of the given weights."""
    made = []
    for i in range(outputs):
        terms = [f"({(3 * i + 5 * j + k) % 7 - 3} / 5.0) * {x}" for j, x in enumerate(inputs)]
        made.append(f"({' + '.join(terms)} + {(i + k) % 3 - 1} / 5.0)")
    return made


def _named(prefix: str, columns: list[str]) -> str:
    return ", ".join(f"{c} AS {prefix}{k}" for k, c in enumerate(columns))


def _gelu(c: str) -> str:
    series = f"list_sum(list_transform({_ODD_SQL}, lambda t, n: exp((n - 1) * ln({c} * {c}) - t)))"
    erf = f"CASE WHEN abs({c}) > 8 THEN sign({c}) WHEN abs({c}) < 1e-12 THEN 0 ELSE 2 / sqrt(pi()) * exp(-{c} * {c} / 2) * ({c} / sqrt(2)) * {series} END"
    return f"(0.5 * {c} * (1 + {erf}))"


def _columns(prefix: str, n: int) -> list[str]:
    return [f"{prefix}{k}" for k in range(n)]


def _gelus(prefix: str, n: int) -> str:
    return _named(f"g{prefix}", [_gelu(c) for c in _columns(prefix, n)])


_SIGMOID = "1 / (1 + exp(-{}))"
_FUSED = ["x0", "x1", "e0", "e1"]
_TYPES = "d t f c k r n".split()
_SUMS = ", ".join(f"coalesce(sum(m{v}) FILTER (edge_type = {k}), 0) AS {name}{v}" for k, name in enumerate(_TYPES) for v in range(2))
_PORTS = ", ".join(f"coalesce(sum(m{v}) FILTER (target_port = {p}), 0) AS p{2 * p + v}" for p in range(2) for v in range(2))
_SCALES = [f"({[((3 * p + 5 * v + 14) % 7 - 3) for p in range(8)]})[target_port + 1]" for v in range(2)]
_MEMORY = ", ".join(f"coalesce(sum(m{v} * (1 + {_SCALES[v]} / 5.0)) FILTER (edge_type IN (0, 6)), 0) AS y{v}" for v in range(2))
_MIX = [f"({[((3 * g + 5 * j + 8) % 7 - 3) for g in range(10)]})[greatest(0, node_type - 2) + 1] / 5.0" for j in range(3)]
_PAIR_TYPE = [f"({[((3 * t + 5 * v + 11) % 7 - 3) for t in range(3)]})[list_position([7, 9, 10], node_type)] / 5.0" for v in range(2)]
_GATED = _EDGES + f""", x AS (SELECT graph, node, node_type, node_type / 12.0 AS x0, (graph + 1) / 8.0 AS x1 FROM nodes),
a0 AS (SELECT e.graph, e.src, e.dst, e.edge_type, e.target_port, x0, x1, e.m / 10 AS e0, e.score / 10 AS e1
       FROM edges e JOIN x ON x.graph = e.graph AND x.node = e.src),
a1 AS (SELECT *, {_named("h", _weighted(_FUSED, 4, 1))}, {_named("q", _weighted(_FUSED, 4, 3))}, {_weighted(_FUSED, 1, 5)[0]} AS score FROM a0),
a2 AS (SELECT *, {_gelus("h", 4)}, {_gelus("q", 4)} FROM a1),
a3 AS (SELECT graph, dst, edge_type, target_port, score, """ + ", ".join(
    f"CASE WHEN edge_type = 3 THEN {c} ELSE {d} END AS m{v}" for v, (c, d) in enumerate(zip(_weighted(_columns("gq", 4), 2, 4), _weighted(_columns("gh", 4), 2, 2)))
) + f""" FROM a2),
a4 AS (SELECT *, exp(score - max(score) OVER (PARTITION BY graph, dst)) AS w FROM a3),
s0 AS (SELECT graph, dst, {_SUMS}, {_PORTS}, {_MEMORY}, bool_or(edge_type = 3) AS ctl, sum(w * m0) / sum(w) AS at0, sum(w * m1) / sum(w) AS at1,
              avg(m0) AS mean0, avg(m1) AS mean1, greatest(0, max(m0)) AS max0, greatest(0, max(m1)) AS max1 FROM a4 GROUP BY graph, dst),
s1 AS (SELECT x.graph, x.node, x.node_type, x.x0, x.x1, coalesce(ctl, FALSE) AS ctl, """ + ", ".join(
    f"coalesce({c}, 0) AS {c}" for c in [f"{n}{v}" for n in _TYPES for v in range(2)] + _columns("p", 4) + _columns("y", 2) + _columns("at", 2) + _columns("mean", 2) + _columns("max", 2)
) + f""" FROM x LEFT JOIN s0 ON s0.graph = x.graph AND s0.dst = x.node),
s2 AS (SELECT *, {_named("z", _weighted(["c0", "c1"], 1, 6))}, {_named("u", _weighted(_columns("p", 4) + _PAIR_TYPE, 4, 12))},
              {_named("sr", [_SIGMOID.format(c) for c in _weighted(["r0", "r1"], 2, 9)])}, {_named("se", [_SIGMOID.format(c) for c in _weighted(["n0", "n1"], 2, 10)])},
              {_named("mx", [f"exp({c})" for c in _MIX])} FROM s1),
s3 AS (SELECT *, {_gelus("z", 1)}, {_gelus("u", 4)} FROM s2),
s4 AS (SELECT *, {_named("lg", _weighted(["gz0"], 2, 0))}, {_named("pair", _weighted(_columns("gu", 4), 2, 13))} FROM s3),
s5 AS (SELECT graph, node, node_type, x0, x1, """ + ", ".join(
    f"""CASE WHEN ctl THEN exp(lg0) / (exp(lg0) + exp(lg1)) * t{v} + exp(lg1) / (exp(lg0) + exp(lg1)) * f{v} + d{v} + k{v} + r{v} + n{v}
      WHEN node_type = 4 THEN sr{v} * r{v} + (1 - sr{v}) * (se{v} * d{v} + (1 - se{v}) * k{v}) WHEN node_type = 5 THEN y{v} WHEN node_type IN (7, 9, 10) THEN pair{v}
      ELSE (mx0 * at{v} + mx1 * mean{v} + mx2 * max{v}) / (mx0 + mx1 + mx2) END AS o{v}""" for v in range(2)
) + f""" FROM s4),
n1 AS (SELECT *, {_named("h", _weighted(["x0", "x1", "o0", "o1"], 4, 15))} FROM s5),
n2 AS (SELECT *, {_gelus("h", 4)} FROM n1),
n3 AS (SELECT graph, node, node_type, x0 + {_weighted(_columns("gh", 4), 2, 16)[0]} AS v0, x1 + {_weighted(_columns("gh", 4), 2, 16)[1]} AS v1 FROM n2),
n4 AS (SELECT graph, node, node_type, (v0 - v1) / 2 / sqrt(((v0 - v1) / 2) ** 2 + 1e-5) AS x0, (v1 - v0) / 2 / sqrt(((v0 - v1) / 2) ** 2 + 1e-5) AS x1 FROM n3)"""
ORACLES["gated_layer"] = _GATED + " SELECT graph, node, node_type, round(x0, 6) AS x0, round(x1, 6) AS x1 FROM n4"
ORACLES["gated_edges"] = _GATED + f""", b0 AS (SELECT a0.graph, edge_type, n4.x0, n4.x1, e0, e1 FROM a0 JOIN n4 ON n4.graph = a0.graph AND n4.node = a0.src),
b1 AS (SELECT *, {_named("h", _weighted(_FUSED, 4, 17))} FROM b0),
b2 AS (SELECT *, {_gelus("h", 4)} FROM b1),
b3 AS (SELECT graph, edge_type, e0 + {_weighted(_columns("gh", 4), 2, 18)[0]} AS v0, e1 + {_weighted(_columns("gh", 4), 2, 18)[1]} AS v1 FROM b2),
b4 AS (SELECT graph, edge_type, (v0 - v1) / 2 / sqrt(((v0 - v1) / 2) ** 2 + 1e-5) AS e FROM b3)
SELECT graph, edge_type, count(*) AS n, round(avg(e), 6) AS e0, round(avg(-e), 6) AS e1 FROM b4 GROUP BY ALL"""
ORACLES["gcn_layer"] = _EDGES + f""", f AS (SELECT graph, src, dst FROM valid UNION ALL SELECT graph, node, node FROM nodes),
deg AS (SELECT graph, dst AS node, count(*) AS d FROM f GROUP BY ALL),
x AS (SELECT graph, node, node_type / 12.0 AS x0, (graph + 1) / 8.0 AS x1 FROM nodes),
p AS (SELECT f.graph, f.dst AS node, sum(s.x0 / sqrt(a.d * b.d)) AS a0, sum(s.x1 / sqrt(a.d * b.d)) AS a1
      FROM f JOIN deg a ON a.graph = f.graph AND a.node = f.src JOIN deg b ON b.graph = f.graph AND b.node = f.dst
      JOIN x s ON s.graph = f.graph AND s.node = f.src GROUP BY f.graph, f.dst),
h AS (SELECT graph, node, x0, x1, {_named("h", _weighted(["a0", "a1"], 2, 20))} FROM p JOIN x USING (graph, node)),
v AS (SELECT graph, node, x0 + {_gelu("h0")} AS v0, x1 + {_gelu("h1")} AS v1 FROM h)
SELECT graph, node, round((v0 - v1) / 2 / sqrt(((v0 - v1) / 2) ** 2 + 1e-5), 6) AS x0, round((v1 - v0) / 2 / sqrt(((v0 - v1) / 2) ** 2 + 1e-5), 6) AS x1 FROM v"""
