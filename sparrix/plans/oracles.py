"""SQL for comparison with the registered queries, for any engine that reads the same tables."""

from __future__ import annotations

_SALES = "cells AS (SELECT l_partkey AS obs_id, l_suppkey AS samp_id, SUM(l_quantity) AS value FROM lineitem{where} GROUP BY l_partkey, l_suppkey)"
CELLS = "WITH " + _SALES.format(where="") + " "
SENT = "WITH once AS (SELECT DISTINCT cell_id, obs_id, samp_id, value FROM cells) "
_DENSE = (
    "SELECT * FROM (SELECT p_type AS obs_id, s_suppkey AS samp_id, ROUND(CAST({f} AS DOUBLE), 6) AS value FROM part CROSS JOIN supplier "
    "LEFT JOIN cells ON obs_id = p_partkey AND samp_id = s_suppkey GROUP BY 1, 2) x WHERE value <> 0"
)
_SOLD = "SELECT DISTINCT {id} FROM lineitem WHERE l_returnflag {of} 'R'"


def _rank(expression: str) -> str:
    return CELLS + f"SELECT obs_id, samp_id, CAST({expression} AS DOUBLE) AS value FROM cells"


def _bins(value: str) -> str:
    return CELLS + (
        ", b AS (SELECT p_partkey, string_split(p_name, ' ') AS bins FROM part) "
        f"SELECT bin AS obs_id, samp_id, {value} AS value FROM "
        "(SELECT unnest(bins) AS bin, samp_id, value, len(bins) AS n FROM cells JOIN b ON p_partkey = obs_id) x GROUP BY bin, samp_id"
    )


_OVER = "OVER (PARTITION BY samp_id ORDER BY value)"
_TIES = "COUNT(*) OVER (PARTITION BY samp_id, value)"
_STATS = (
    "SELECT MIN(n) AS mn, MAX(n) AS mx, CAST(MEDIAN(n) AS DOUBLE) AS med, ROUND(AVG(n), 6) AS mean, ROUND(STDDEV_POP(n), 6) AS sd, SUM(n) AS total FROM t"
)

ORACLES: dict[str, str] = {
    "cells_from_triples": CELLS + "SELECT obs_id, samp_id, value FROM cells",
    "cells_from_events": "SELECT user_id AS obs_id, event_type AS samp_id, CAST(COUNT(*) AS DOUBLE) AS value FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2",
    "cells_sent_once": SENT + "SELECT obs_id, samp_id, ROUND(SUM(value), 6) AS value FROM once GROUP BY obs_id, samp_id HAVING SUM(value) <> 0",
    "sum_sample": CELLS + "SELECT s_suppkey AS samp_id, COALESCE(SUM(value), 0.0) AS total FROM supplier LEFT JOIN cells ON samp_id = s_suppkey GROUP BY s_suppkey",
    "sum_observation": CELLS + "SELECT p_partkey AS obs_id, COALESCE(SUM(value), 0.0) AS total FROM part LEFT JOIN cells ON obs_id = p_partkey GROUP BY p_partkey",
    "sum_whole": "SELECT SUM(l_quantity) AS total FROM lineitem",
    "sum_sample_with_empty": SENT + "SELECT s.id AS samp_id, ROUND(COALESCE(SUM(value), 0.0), 6) AS total FROM (SELECT DISTINCT id FROM samp) s LEFT JOIN once ON samp_id = s.id GROUP BY s.id",
    "min_max_nnz_sample": CELLS + "SELECT s_suppkey AS samp_id, MIN(value) AS mn, MAX(value) AS mx, COUNT(value) AS nnz FROM supplier LEFT JOIN cells ON samp_id = s_suppkey GROUP BY s_suppkey",
    "min_observation": CELLS + "SELECT p_partkey AS id, MIN(value) AS least FROM part LEFT JOIN cells ON obs_id = p_partkey GROUP BY p_partkey",
    "max_observation": CELLS + "SELECT p_partkey AS id, MAX(value) AS most FROM part LEFT JOIN cells ON obs_id = p_partkey GROUP BY p_partkey",
    "nonzero_counts_observation": CELLS + "SELECT p_partkey AS id, CAST(COUNT(value) AS DOUBLE) AS n FROM part LEFT JOIN cells ON obs_id = p_partkey GROUP BY p_partkey",
    "density": CELLS + "SELECT (SELECT COUNT(*) FROM cells) / CAST((SELECT COUNT(*) FROM part) * (SELECT COUNT(*) FROM supplier) AS DOUBLE) AS density",
    "norm_sample": CELLS + "SELECT obs_id, samp_id, value / SUM(value) OVER (PARTITION BY samp_id) AS value FROM cells",
    "norm_observation": CELLS + "SELECT obs_id, samp_id, value / SUM(value) OVER (PARTITION BY obs_id) AS value FROM cells",
    "norm_gathered": CELLS + "SELECT obs_id, samp_id, value / SUM(value) OVER (PARTITION BY samp_id) AS value FROM cells",
    "rankdata_average": _rank(f"RANK() {_OVER} + ({_TIES} - 1) / 2.0"),
    "rankdata_min": _rank(f"RANK() {_OVER}"),
    "rankdata_max": _rank(f"RANK() {_OVER} + {_TIES} - 1"),
    "rankdata_dense": _rank(f"DENSE_RANK() {_OVER}"),
    "rankdata_ordinal": _rank("ROW_NUMBER() OVER (PARTITION BY samp_id ORDER BY value, obs_id)"),
    "presence_absence": CELLS + "SELECT obs_id, samp_id, CAST(1 AS DOUBLE) AS value FROM cells",
    "transform_mod3": CELLS + "SELECT obs_id, samp_id, value FROM cells WHERE value % 3 = 0",
    "transform_callable": CELLS + "SELECT obs_id, samp_id, value * 2 AS value FROM cells",
    "filter_ids": CELLS + "SELECT obs_id, samp_id, value FROM cells WHERE samp_id IN (1, 3, 5, 7)",
    "filter_ids_invert": CELLS + "SELECT obs_id, samp_id, value FROM cells WHERE samp_id NOT IN (1, 3, 5, 7)",
    "filter_total_gt": CELLS + "SELECT obs_id, samp_id, value FROM cells WHERE obs_id IN (SELECT obs_id FROM cells GROUP BY obs_id HAVING SUM(value) > 800)",
    "filter_metadata": CELLS + "SELECT obs_id, samp_id, value FROM cells JOIN part ON p_partkey = obs_id WHERE p_size > 25",
    "filter_callable": CELLS
    + "SELECT s_suppkey AS id FROM supplier LEFT JOIN cells ON samp_id = s_suppkey WHERE s_nationkey < 12 GROUP BY s_suppkey HAVING (SELECT COUNT(*) FROM part) - COUNT(value) > 3",
    "remove_empty": CELLS
    + ", t AS (SELECT obs_id, samp_id, value - 27 AS value FROM cells WHERE value <> 27), s AS (SELECT t.* FROM t WHERE samp_id IN (SELECT samp_id FROM t GROUP BY samp_id HAVING SUM(value) > 0)) "
    "SELECT obs_id, samp_id, value FROM s WHERE obs_id IN (SELECT obs_id FROM s GROUP BY obs_id HAVING SUM(value) > 0)",
    "head_5x5": CELLS + "SELECT obs_id, samp_id, value FROM cells WHERE obs_id IN (SELECT p_partkey FROM part ORDER BY 1 LIMIT 5) AND samp_id IN (SELECT s_suppkey FROM supplier ORDER BY 1 LIMIT 5)",
    "vector_dense": CELLS + "SELECT p_partkey AS id, COALESCE(value, 0.0) AS value FROM part LEFT JOIN cells ON obs_id = p_partkey AND samp_id = 7",
    "value_by_ids": CELLS + ", k AS (SELECT l_partkey AS obs_id, l_suppkey AS samp_id FROM lineitem UNION SELECT l_partkey, l_suppkey + 1 FROM lineitem) "
    "SELECT k.obs_id, k.samp_id, CASE WHEN s_suppkey IS NOT NULL AND p_partkey IS NOT NULL THEN COALESCE(value, 0.0) END AS value FROM k "
    "LEFT JOIN cells c ON c.obs_id = k.obs_id AND c.samp_id = k.samp_id LEFT JOIN supplier ON s_suppkey = k.samp_id LEFT JOIN part ON p_partkey = k.obs_id",
    "nonzero": CELLS + "SELECT obs_id, samp_id FROM cells",
    "transpose": CELLS + "SELECT samp_id AS obs_id, obs_id AS samp_id, value FROM cells",
    "update_ids": CELLS + "SELECT obs_id, 'sup-' || CAST(samp_id AS VARCHAR) AS samp_id, value FROM cells",
    "metadata_added": "SELECT s_suppkey AS id, s_nationkey AS nation, n_name AS nation_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey",
    "metadata_dropped": "SELECT p_partkey AS id, p_brand AS brand, p_size AS size FROM part",
    "merge_union": CELLS + "SELECT obs_id, samp_id, value FROM cells",
    "merge_intersection": "SELECT l_partkey AS obs_id, l_suppkey AS samp_id, SUM(l_quantity) AS value FROM lineitem WHERE TRUE"
    + "".join(f" AND {i} IN ({_SOLD.format(id=i, of=of)})" for i in ("l_partkey", "l_suppkey") for of in ("=", "<>"))
    + " GROUP BY 1, 2",
    "merge_metadata": "SELECT p_partkey AS id, ROW_NUMBER() OVER (ORDER BY s.a = 0, p_partkey) - 1 AS ord, p_brand AS brand FROM part "
    "JOIN (SELECT l_partkey, MAX(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS a FROM lineitem GROUP BY 1) s ON l_partkey = p_partkey",
    "merge_sorted": "SELECT l_partkey AS id, ROW_NUMBER() OVER (ORDER BY l_partkey) - 1 AS ord FROM (SELECT DISTINCT l_partkey FROM lineitem) s",
    "concat_samples": CELLS
    + ", o AS (SELECT s_suppkey, ROW_NUMBER() OVER (ORDER BY s_suppkey <= 40, s_suppkey) - 1 AS ord FROM supplier) "
    "SELECT obs_id, samp_id, value, ord FROM cells JOIN o ON s_suppkey = samp_id",
    "align_to": "SELECT s_suppkey AS id, ROW_NUMBER() OVER (ORDER BY s_suppkey DESC) - 1 AS pos FROM supplier",
    "sort_order": CELLS + ", o(samp_id, ord) AS (VALUES (9, CAST(0 AS BIGINT)), (2, 1), (5, 2)) SELECT obs_id, cells.samp_id, value, ord FROM cells JOIN o ON o.samp_id = cells.samp_id",
    "natural_sort": "SELECT 's' || CAST(s_suppkey AS VARCHAR) || 'x' AS id, ROW_NUMBER() OVER (ORDER BY s_suppkey) - 1 AS ord FROM supplier",
    "collapse_sum": CELLS + "SELECT p_brand AS obs_id, samp_id, SUM(value) AS value FROM cells JOIN part ON p_partkey = obs_id GROUP BY 1, 2",
    "collapse_norm": CELLS
    + ", k AS (SELECT p_brand, COUNT(*) AS n FROM part GROUP BY p_brand) SELECT p.p_brand AS obs_id, samp_id, SUM(value) / CAST(MAX(n) AS DOUBLE) AS value "
    "FROM cells JOIN part p ON p_partkey = obs_id JOIN k ON k.p_brand = p.p_brand GROUP BY 1, 2",
    "collapse_samples": CELLS
    + ", k AS (SELECT s_nationkey, COUNT(*) AS n FROM supplier GROUP BY 1) SELECT obs_id, CAST(s.s_nationkey AS VARCHAR) AS samp_id, SUM(value) / CAST(MAX(n) AS DOUBLE) AS value "
    "FROM cells JOIN supplier s ON s_suppkey = samp_id JOIN k ON k.s_nationkey = s.s_nationkey GROUP BY 1, 2",
    "collapse_min_group_size": CELLS
    + "SELECT p_brand AS obs_id, samp_id, SUM(value) AS value FROM cells JOIN part ON p_partkey = obs_id WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 HAVING COUNT(*) >= 80) GROUP BY 1, 2",
    "collapse_median": CELLS + _DENSE.format(f="MEDIAN(COALESCE(value, 0.0))"),
    "collapse_percentile": CELLS + _DENSE.format(f="QUANTILE_CONT(COALESCE(value, 0.0), 0.99)"),
    "collapse_max": CELLS + _DENSE.format(f="MAX(COALESCE(value, 0.0))"),
    "collapse_min": CELLS + _DENSE.format(f="MIN(COALESCE(value, 0.0))"),
    "collapse_mean": CELLS + _DENSE.format(f="AVG(COALESCE(value, 0.0))"),
    "collapse_count": CELLS + _DENSE.format(f="COUNT(value)"),
    "collapse_callable": CELLS + _DENSE.format(f="MAX(COALESCE(value, 0.0)) - AVG(COALESCE(value, 0.0))"),
    "collapse_nonzero_median": CELLS + "SELECT p_type AS obs_id, samp_id, ROUND(CAST(MEDIAN(value) AS DOUBLE), 6) AS value FROM cells JOIN part ON p_partkey = obs_id GROUP BY 1, 2",
    "collapse_one_to_many_add": _bins("SUM(value)"),
    "collapse_one_to_many_divide": _bins("ROUND(SUM(value / n), 6)"),
    "collapse_levels": CELLS
    + "SELECT CAST(1 AS INTEGER) AS level, p_type AS path, samp_id, SUM(value) AS value FROM cells JOIN part ON p_partkey = obs_id GROUP BY 2, 3 "
    "UNION ALL SELECT CAST(2 AS INTEGER), p_type || '; ' || p_brand, samp_id, SUM(value) FROM cells JOIN part ON p_partkey = obs_id GROUP BY 2, 3",
    "collapsed_ids": "SELECT CAST(s_nationkey AS VARCHAR) AS id, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) AS ids FROM supplier GROUP BY 1",
    "partition_sizes": CELLS
    + ", p AS (SELECT p_partkey, CASE WHEN p_size < 40 THEN p_type END AS label FROM part), v AS (SELECT obs_id, COUNT(*) AS c, SUM(value) AS s FROM cells GROUP BY 1) "
    "SELECT label, COUNT(*) AS members, CAST(COALESCE(SUM(c), 0) AS BIGINT) AS cells, COALESCE(SUM(s), 0.0) AS total FROM p LEFT JOIN v ON obs_id = p_partkey GROUP BY label",
    "pairwise_ids": "SELECT a.s_suppkey AS i, b.s_suppkey AS j FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey",
    "pairwise_dot": CELLS + "SELECT a.samp_id AS i, b.samp_id AS j, SUM(a.value * b.value) AS dot, COUNT(*) AS shared FROM cells a JOIN cells b ON a.obs_id = b.obs_id AND a.samp_id < b.samp_id GROUP BY 1, 2",
    "reduce_fold": CELLS + "SELECT s_suppkey AS id, COALESCE(MAX(value), 0.0) AS value FROM supplier LEFT JOIN cells ON samp_id = s_suppkey GROUP BY 1",
    "summary_stats": CELLS + ", t AS (SELECT COALESCE(SUM(value), 0.0) AS n FROM supplier LEFT JOIN cells ON samp_id = s_suppkey GROUP BY s_suppkey) " + _STATS,
    "summary_stats_binary": CELLS + ", t AS (SELECT CAST(COUNT(value) AS DOUBLE) AS n FROM part LEFT JOIN cells ON obs_id = p_partkey GROUP BY p_partkey) " + _STATS,
    "positions": "SELECT p_partkey AS id, ROW_NUMBER() OVER (ORDER BY p_partkey) - 1 AS pos FROM part",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
