"""SQL for comparison, where SQL can express the operator."""

from __future__ import annotations

from sparrix.llm.canon import LAST, tables

PRESENT = "v AS (SELECT DISTINCT cell_id, samp_id, obs_id, value FROM cells WHERE value IS NOT NULL AND value <> 0 AND samp_id IS NOT NULL AND obs_id IS NOT NULL)"
COUNTED = (
    f"WITH {PRESENT}, w AS (SELECT DISTINCT samp_id, obs_id FROM v), total AS (SELECT COUNT(DISTINCT samp_id) AS n FROM w), "
    "c AS (SELECT obs_id, COUNT(*) AS c FROM w GROUP BY 1), kept AS (SELECT w.samp_id, w.obs_id FROM w JOIN c ON c.obs_id = w.obs_id WHERE c.c >= 12), "
    "p AS (SELECT a.obs_id AS item_a, b.obs_id AS item_b, COUNT(*) AS n_ab FROM kept a JOIN kept b ON a.samp_id = b.samp_id AND a.obs_id < b.obs_id GROUP BY 1, 2 HAVING COUNT(*) >= 12), "
    "q AS (SELECT item_a, item_b, n_ab, ca.c AS n_a, cb.c AS n_b, n FROM p JOIN c ca ON ca.obs_id = item_a JOIN c cb ON cb.obs_id = item_b, total) "
)


def _part(k: str, row: str, column: str) -> str:
    return f"CASE WHEN {k} > 0 THEN ({k}) * LN(CAST({k} AS DOUBLE) * n / (CAST({row} AS DOUBLE) * ({column}))) ELSE 0 END"


LLR = f"2 * ({_part('n_ab', 'n_a', 'n_b')} + {_part('n_a - n_ab', 'n_a', 'n - n_b')} + {_part('n_b - n_ab', 'n - n_a', 'n_b')} + {_part('n - n_a - n_b + n_ab', 'n - n_a', 'n - n_b')})"


SAMP_RATE = "CASE WHEN stratum = 'gut' THEN 0.05 WHEN stratum = 'silt' THEN 0.2 ELSE 0.1 END"
OBS_RATE = "CASE WHEN stratum IS NULL OR stratum IN ('unassigned', 'unclassified') THEN 0.05 ELSE 0.1 END"
STRATA = (
    "WITH r AS (SELECT 'samp' AS axis, id, LOWER(TRIM(REGEXP_REPLACE(body_site, '^[A-Za-z]+:', ''))) AS stratum, load_no FROM samp UNION ALL "
    "SELECT 'obs', id, LOWER(REGEXP_EXTRACT(taxonomy, '^[^A-Za-z]*(?:[Rr]oot[^A-Za-z]+)?(?:[A-Za-z]_[_0-9]*)?([A-Za-z]*)', 1)), load_no FROM obs), "
    "k AS (SELECT axis, id, stratum, MIN(COALESCE(CAST(load_no AS BIGINT), -1)) AS load_no FROM r WHERE id IS NOT NULL GROUP BY 1, 2, 3), "
    f"t AS (SELECT *, CAST('0x' || SUBSTR(MD5('sparrix|' || id), 1, 13) AS BIGINT) / 4503599627370496.0 AS u, CAST(CASE WHEN axis = 'samp' THEN {SAMP_RATE} ELSE {OBS_RATE} END AS DOUBLE) AS threshold FROM k) "
)


def _looks() -> str:
    """``k`` (doc_id, raw, same): the common form by way of single characters and the engine's own composition."""
    t = tables()
    changed = [cp for cp in range(LAST) if t["length"][cp] != 1 or t["flat"][t["start"][cp]] != cp]
    rows = []
    for cp in changed:
        at = int(t["start"][cp])
        text = "".join(map(chr, t["flat"][at : at + int(t["length"][cp])])).replace("'", "''")
        rows.append(f"({cp}, '{text}')")
    return (
        f"WITH m(cp, x) AS (VALUES {', '.join(rows)}), d AS (SELECT DISTINCT doc_id, text AS raw FROM documents), "
        "c AS (SELECT doc_id, raw, REGEXP_EXTRACT_ALL(REPLACE(raw, CHR(13) || CHR(10), CHR(10)), '(?s).') AS l FROM d WHERE raw IS NOT NULL), "
        "e AS (SELECT doc_id, raw, i, l[i] AS c FROM (SELECT *, UNNEST(range(1, len(l) + 1)) AS i FROM c) u), "
        "j AS (SELECT doc_id, raw, STRING_AGG(COALESCE(m.x, e.c), '' ORDER BY i) AS y FROM e LEFT JOIN m ON m.cp = UNICODE(e.c) GROUP BY 1, 2), "
        "k AS (SELECT d.doc_id, d.raw, CASE WHEN d.raw IS NULL THEN NULL ELSE NFC_NORMALIZE(COALESCE(j.y, '')) END AS same FROM d LEFT JOIN j ON j.doc_id = d.doc_id AND j.raw = d.raw) "
    )


def _look_alikes() -> dict[str, str]:
    looks = _looks()
    classes = (
        "SELECT k.doc_id, class_id, size, forms FROM (SELECT DISTINCT doc_id, same FROM k WHERE raw <> '' AND doc_id IS NOT NULL) k JOIN (SELECT same, MIN(doc_id) AS class_id, COUNT(*) AS size, "
        "COUNT(DISTINCT raw) AS forms FROM k WHERE raw <> '' AND doc_id IS NOT NULL GROUP BY same) s ON s.same = k.same"
    )
    return {
        "p9_found": looks + "SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM k a JOIN k b ON a.same = b.same AND a.doc_id < b.doc_id AND a.raw <> b.raw WHERE a.raw <> '' AND b.raw <> ''",
        "p9_classes": looks + classes,
        "p9_canonical": looks + "SELECT DISTINCT doc_id, same AS text FROM k",
    }


def oracle_sql() -> dict[str, str]:
    return _look_alikes() | {
        "p1_checks": f"WITH {PRESENT}, t AS (SELECT samp_id, obs_id, SUM(value) AS value FROM v GROUP BY 1, 2), s AS (SELECT samp_id FROM t GROUP BY 1 HAVING MIN(value) > 0) "
        "SELECT COUNT(*) AS members, COUNT(*) AS records, 0 AS unlike, 0 AS without_pivot FROM s",
        "p7_checks": "SELECT container_kind, (SELECT COUNT(DISTINCT doc_id) FROM documents WHERE text IS NOT NULL AND text <> '') AS texts, 0 AS miscounted, 0 AS split_needlessly, 0 AS too_full FROM containers WHERE capacity_tokens > 0",
        "p8_checks": "SELECT DISTINCT source, 0 AS placed_twice, 0 AS above_cap, 0 AS share_off FROM mix_targets WHERE source IS NOT NULL",
        "p6_sample": STRATA + "SELECT axis, id, MIN(load_no) AS load_no FROM t WHERE u < threshold GROUP BY axis, id",
        "p6_thresholds": STRATA + "SELECT axis, stratum, MAX(threshold) AS threshold, COUNT(*) AS keys, COUNT(*) FILTER (WHERE u < threshold) AS chosen FROM t GROUP BY axis, stratum",
        "p6_lost": "SELECT 'samp' AS axis, id, CAST(load_no AS BIGINT) AS load_no FROM samp WHERE FALSE",
        "p1_found": f"WITH RECURSIVE {PRESENT}, t AS (SELECT samp_id, obs_id, SUM(value) AS value FROM v GROUP BY 1, 2), "
        "s AS (SELECT samp_id, obs_id, value / SUM(value) OVER (PARTITION BY samp_id) AS p FROM t), "
        "e AS (SELECT a.samp_id AS a, b.samp_id AS b FROM s a JOIN s b ON a.obs_id = b.obs_id AND a.samp_id <> b.samp_id GROUP BY 1, 2 HAVING SUM(LEAST(a.p, b.p)) >= 0.55 - 1e-9), "
        "reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a) SELECT a AS samp_a, b AS samp_b FROM reach WHERE a < b",
        "p5_found": COUNTED + "SELECT item_a AS obs_a, item_b AS obs_b FROM q WHERE n_ab * n >= 8 * n_a * n_b",
        "p5_pairs": COUNTED
        + f"SELECT item_a, item_b, n_ab, n_a, n_b, n, ROUND(CAST(n_ab * n AS DOUBLE) / (CAST(n_a AS DOUBLE) * n_b), 6) AS lift, ROUND({LLR}, 4) AS llr FROM q WHERE n_ab * n >= 2 * n_a * n_b AND {LLR} >= 10.83",
        "p5_all_pairs": COUNTED.replace(">= 12", ">= 1")
        + f"SELECT item_a, item_b, n_ab, n_a, n_b, n, ROUND(CAST(n_ab * n AS DOUBLE) / (CAST(n_a AS DOUBLE) * n_b), 6) AS lift, ROUND({LLR}, 4) AS llr FROM q",
    }
