"""SQL for comparison with the queries on raw records: JSON tables, headers and packed fields."""

from __future__ import annotations

# -- JSON tables


def _as_list(x: str) -> str:
    """The elements of a list; a bare element is a list of one."""
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN from_json({x}, '[\"JSON\"]') ELSE CASE WHEN {x} IS NULL OR json_type({x}) = 'NULL' THEN [] ELSE [{x}] END END"


def _each(source: str, keys: str, x: str) -> str:
    """``keys``, ``pos``, ``x``: the elements with their places; null elements give no row."""
    lists = f"SELECT {keys}, {_as_list(x)} AS l FROM {source}"
    return f"SELECT {keys}, i - 1 AS pos, l[i] AS x FROM (SELECT *, UNNEST(range(1, len(l) + 1)) AS i FROM ({lists}) a) b WHERE l[i] IS NOT NULL AND json_type(l[i]) <> 'NULL'"


_MD = "CASE WHEN json_type(x, '$.metadata') = 'VARCHAR' THEN TRY_CAST(json_extract_string(x, '$.metadata') AS JSON) ELSE json_extract(x, '$.metadata') END"
_TEXT = "CASE json_type({0}) WHEN 'VARCHAR' THEN json_extract_string({0}, '$') ELSE CAST({0} AS VARCHAR) END"


def _text(x: str) -> str:
    return _TEXT.format(x)


TABLES = f"""WITH f AS (SELECT DISTINCT file_id, CAST(body AS JSON) AS b FROM table_files WHERE body IS NOT NULL AND json_valid(body)),
rw AS ({_each("f", "file_id, b", "json_extract(b, '$.rows')")}),
cl AS ({_each("f", "file_id, b", "json_extract(b, '$.columns')")}),
rm AS (SELECT file_id, pos AS p, {_MD} AS m FROM rw), cm AS (SELECT file_id, pos AS p, {_MD} AS m FROM cl),
tx AS ({_each("rm", "file_id, p", "json_extract(m, '$.taxonomy')")}),
pw AS ({_each("rm", "file_id, p", "json_extract(m, '$.pathways')")}),
pn AS ({_each("(SELECT file_id, p, pos AS q, x AS y FROM pw) z", "file_id, p, q", "y")}),
mb AS (SELECT file_id, p, UNNEST(json_keys(m)) AS k FROM rm WHERE json_type(m) = 'OBJECT'),
rn AS ({_each("cm", "file_id, p", "json_extract(m, '$.runs')")}),
ln AS ({_each("(SELECT file_id, p, pos AS q, json_extract(x, '$.lanes') AS y FROM rn) z", "file_id, p, q", "y")}),
dt AS (SELECT file_id, b, LOWER(TRIM(COALESCE(json_extract_string(b, '$.matrix_type'), ''))) AS layout, i - 1 AS pos, l[i] AS x
  FROM (SELECT *, UNNEST(range(1, len(l) + 1)) AS i FROM (SELECT file_id, b, {_as_list("json_extract(b, '$.data')")} AS l FROM f) a) c WHERE json_type(l[i]) = 'ARRAY'),
sp AS (SELECT file_id, TRY_CAST(json_extract_string(x, '$[0]') AS BIGINT) AS r, TRY_CAST(json_extract_string(x, '$[1]') AS BIGINT) AS c, TRY_CAST(json_extract_string(x, '$[2]') AS DOUBLE) AS v
  FROM dt WHERE layout = 'sparse' AND json_array_length(x) = 3),
de AS (SELECT file_id, pos AS r, j - 1 AS c, TRY_CAST(l[j] AS DOUBLE) AS v FROM (SELECT *, UNNEST(range(1, len(l) + 1)) AS j FROM (SELECT file_id, pos, from_json(x, '["JSON"]') AS l FROM dt WHERE layout = 'dense') a) b),
ce AS (SELECT * FROM sp UNION ALL SELECT * FROM de)
"""

PARTS = {
    "row": f"SELECT DISTINCT file_id, pos AS row_pos, {_text("json_extract(x, '$.id')")} AS id FROM rw WHERE json_type(x, '$.id') <> 'NULL'",
    "column": f"SELECT DISTINCT file_id, pos AS column_pos, {_text("json_extract(x, '$.id')")} AS id FROM cl WHERE json_type(x, '$.id') <> 'NULL'",
    "taxon": f"SELECT DISTINCT file_id, p AS row_pos, pos AS place, {_text('x')} AS taxon FROM tx",
    "pathway": f"SELECT DISTINCT file_id, p AS row_pos, q AS path_pos, pos AS place, {_text('x')} AS name FROM pn",
    "member": "SELECT DISTINCT file_id, p AS row_pos, k AS member FROM mb WHERE k NOT IN ('taxonomy', 'pathways', 'confidence')",
    "run": f"SELECT DISTINCT file_id, p AS column_pos, pos AS run_pos, {_text("json_extract(x, '$.run')")} AS run FROM rn WHERE json_type(x, '$.run') <> 'NULL'",
    "lane": f"SELECT DISTINCT file_id, p AS column_pos, q AS run_pos, pos AS lane_pos, {_text("json_extract(x, '$.lane')")} AS lane FROM ln WHERE json_type(x, '$.lane') <> 'NULL'",
    "cell": "SELECT DISTINCT file_id, r AS row_pos, c AS column_pos FROM ce WHERE v IS NOT NULL AND v <> 0 AND (file_id, r) IN (SELECT file_id, pos FROM rw) AND (file_id, c) IN (SELECT file_id, pos FROM cl)",
}
PLACES = {
    "row": ("row_pos", "id"), "column": ("column_pos", "id"), "taxon": ("row_pos, place", "taxon"), "pathway": ("row_pos, path_pos, place", "name"), "member": ("row_pos", "member"),
    "run": ("column_pos, run_pos", "run"), "lane": ("column_pos, run_pos, lane_pos", "lane"), "cell": ("row_pos, column_pos", "''"),
}


def _found() -> str:
    out = []
    for name, (places, item) in PLACES.items():
        at = [*places.split(", "), "-1", "-1"][:3]
        out.append(f"SELECT file_id, '{name}' AS relation, " + ", ".join(f"CAST({x} AS BIGINT) AS pos{i + 1}" for i, x in enumerate(at)) + f", {item} AS item FROM ({PARTS[name]}) {name}_")
    return TABLES + " UNION ALL ".join(out)


UNREAD = (
    "SELECT DISTINCT file_id, CASE WHEN body IS NULL THEN 'null' WHEN NOT json_valid(body) THEN 'no JSON' ELSE 'no object' END AS reason FROM table_files "
    "WHERE body IS NULL OR NOT json_valid(body) OR json_type(CASE WHEN json_valid(body) THEN body END) <> 'OBJECT'"
)

_KNOWN = {
    "type": "'otu table', 'pathway table', 'function table', 'ortholog table', 'gene table', 'metabolite table', 'taxon table'", "matrix_type": "'sparse', 'dense'",
    "matrix_element_type": "'int', 'float', 'unicode', 'str'",
}


def _string(field: str, b: str = "b") -> str:
    return f"CASE json_type({b}, '$.{field}') WHEN 'VARCHAR' THEN json_extract_string({b}, '$.{field}') END"


def _blank(x: str) -> str:
    return f"CAST({x} AS VARCHAR) IN ('null', '\"\"', '[]', '{{}}', '0', '0.0', 'false')"


def _simple(field: str, fault: str) -> str:
    return f"SELECT file_id, '{field}' AS rule, CASE WHEN json_type(b, '$.{field}') IS NULL THEN 'missing' ELSE {fault} END AS message FROM f"


_SIDES = "CASE WHEN json_array_length(b, '$.shape') = 2 AND json_type(b, '$.shape[0]') = 'UBIGINT' AND json_type(b, '$.shape[1]') = 'UBIGINT' THEN [CAST(json_extract(b, '$.shape[0]') AS BIGINT), CAST(json_extract(b, '$.shape[1]') AS BIGINT)] END"
_WHOLE = ("BIGINT", "UBIGINT")
_GOOD = f"CASE {_string('matrix_element_type')} WHEN 'int' THEN {{t}} IN {_WHOLE} WHEN 'float' THEN {{t}} = 'DOUBLE' ELSE {{t}} = 'VARCHAR' END"


def _entries(field: str) -> str:
    lists = f"SELECT file_id, b, {_SIDES} AS sides, CASE json_type(b, '$.{field}') WHEN 'ARRAY' THEN from_json(json_extract(b, '$.{field}'), '[\"JSON\"]') END AS l FROM f"
    return f"SELECT *, i - 1 AS place, l[i] AS x FROM (SELECT *, UNNEST(range(1, len(l) + 1)) AS i FROM ({lists}) a) b_"


def _listed(field: str, judge: str, rest: str) -> str:
    """The first fault of a list's entries, or what is wrong with the list."""
    faults = f"SELECT file_id, MIN_BY(fault || ' at place ' || place, place) AS m FROM (SELECT file_id, place, {judge} AS fault FROM ({_entries(field)}) e) g WHERE fault IS NOT NULL GROUP BY 1"
    return f"SELECT f.file_id, '{field}' AS rule, CASE WHEN json_type(b, '$.{field}') IS NULL THEN 'missing' {rest} END AS message FROM f LEFT JOIN ({faults}) m ON m.file_id = f.file_id"


_ENTRY = (
    f"CASE WHEN COALESCE(json_type(x), 'NULL') <> 'OBJECT' THEN 'no object' WHEN json_type(x, '$.id') IS NULL THEN 'no id' WHEN json_type(x, '$.metadata') IS NULL THEN 'no metadata' "
    f"WHEN {_blank("json_extract(x, '$.id')")} THEN 'empty id' WHEN json_type(x, '$.metadata') NOT IN ('NULL', 'OBJECT') THEN 'metadata of another kind' END"
)
_TYPE = "json_type(x, '$[{0}]')"
_COORD = "TRY_CAST(json_extract_string(x, '$[{0}]') AS BIGINT)"
_TRIPLE = (
    f"CASE WHEN COALESCE(json_type(x), 'NULL') <> 'ARRAY' OR json_array_length(x) <> 3 THEN 'no triple' WHEN {_TYPE.format(0)} NOT IN {_WHOLE} OR {_TYPE.format(1)} NOT IN {_WHOLE} THEN 'no whole coordinate' "
    f"WHEN NOT {_GOOD.format(t=_TYPE.format(2))} THEN 'value of another kind' WHEN {_COORD.format(0)} < 0 OR {_COORD.format(0)} >= sides[1] THEN 'row out of bounds' "
    f"WHEN {_COORD.format(1)} < 0 OR {_COORD.format(1)} >= sides[2] THEN 'column out of bounds' END"
)
_VECTOR = (
    "CASE WHEN COALESCE(json_type(x), 'NULL') <> 'ARRAY' THEN 'no list' WHEN json_array_length(x) <> sides[2] THEN 'row of another length' "
    f"WHEN len(list_filter(from_json(x, '[\"JSON\"]'), lambda v: NOT COALESCE({_GOOD.format(t='json_type(v)')}, FALSE))) > 0 THEN 'value of another kind' END"
)
_SIDE = "WHEN json_type(b, '$.{0}') <> 'ARRAY' THEN 'no list' WHEN m IS NOT NULL THEN m WHEN json_array_length(b, '$.{0}') <> ({1})[{2}] THEN json_array_length(b, '$.{0}') || ' entries where shape has ' || ({1})[{2}]"
_JUDGED = f"({_SIDES}) IS NOT NULL AND COALESCE({_string('matrix_type')} IN ({_KNOWN['matrix_type']}), FALSE) AND COALESCE({_string('matrix_element_type')} IN ({_KNOWN['matrix_element_type']}), FALSE)"
VALIDATED = (
    "WITH f AS (SELECT DISTINCT file_id, CAST(body AS JSON) AS b FROM table_files WHERE json_valid(body) AND json_type(CASE WHEN json_valid(body) THEN body END) = 'OBJECT'), r AS ("
    + " UNION ALL ".join([
        _simple("id", "NULL"), _simple("format", f"CASE WHEN NOT COALESCE(REGEXP_MATCHES({_string('format')}, '^([A-Za-z][A-Za-z ]* )?1[.]0[.]0$'), FALSE) THEN 'not version 1.0.0' END"),
        *[_simple(x, f"CASE WHEN {_blank(f"json_extract(b, '$.{x}')")} THEN 'has no content' END") for x in ("format_url", "generated_by")],
        _simple("type", f"CASE WHEN {_blank("json_extract(b, '$.type')")} THEN 'has no content' WHEN NOT COALESCE(LOWER({_string('type')}) IN ({_KNOWN['type']}), FALSE) THEN 'not one of the known ones' END"),
        _simple("date", rf"CASE WHEN NOT COALESCE(REGEXP_MATCHES({_string('date')}, '^\d{{4}}-\d{{1,2}}-\d{{1,2}}(T\d{{1,2}}:\d{{1,2}}(:\d{{1,2}}(\.\d{{1,6}})?)?)?$') AND TRY_CAST(REGEXP_EXTRACT({_string('date')}, '^[0-9-]+') AS DATE) IS NOT NULL, FALSE) THEN 'no ISO date' END"),
        *[_simple(x, f"CASE WHEN NOT COALESCE({_string(x)} IN ({_KNOWN[x]}), FALSE) THEN 'not one of the known ones' END") for x in ("matrix_type", "matrix_element_type")],
        _simple("shape", f"CASE WHEN ({_SIDES}) IS NULL THEN 'not two whole numbers' END"),
        _listed("rows", _ENTRY, _SIDE.format("rows", _SIDES, 1)), _listed("columns", _ENTRY, _SIDE.format("columns", _SIDES, 2)),
        _listed("data", f"CASE {_string('matrix_type')} WHEN 'sparse' THEN {_TRIPLE} ELSE {_VECTOR} END", f"WHEN NOT ({_JUDGED}) THEN 'cannot be judged' WHEN json_type(b, '$.data') <> 'ARRAY' THEN 'no list' WHEN m IS NOT NULL THEN m WHEN {_string('matrix_type')} = 'dense' AND json_array_length(b, '$.data') <> ({_SIDES})[1] THEN 'another number of rows'"),
    ])
    + ") SELECT DISTINCT file_id, rule, message FROM r WHERE message IS NOT NULL UNION ALL "
    "SELECT DISTINCT file_id, 'json', 'no JSON object' FROM table_files WHERE NOT COALESCE(json_valid(body) AND json_type(CASE WHEN json_valid(body) THEN body END) = 'OBJECT', FALSE)"
)

# -- headers

KIND = "CASE type WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' ELSE 'number' END"
CHANGES = f"""WITH h AS (SELECT DISTINCT producer, file_no, table_id, body FROM table_headers WHERE body IS NOT NULL AND json_valid(body) AND table_id IS NOT NULL),
t AS (SELECT h.producer, h.file_no, h.table_id, n.* FROM h, json_tree(h.body) n WHERE json_type(h.body) = 'OBJECT'),
l AS (SELECT DISTINCT producer, file_no, table_id, SUBSTR(REPLACE(fullkey, '"', ''), 3) AS field, {KIND} AS kind,
  CASE type WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN json_extract_string(value, '$') WHEN 'ARRAY' THEN CAST(value AS VARCHAR) WHEN 'BOOLEAN' THEN CAST(value AS VARCHAR) ELSE CAST(CAST(value AS DOUBLE) AS VARCHAR) END AS v
  FROM t WHERE type <> 'OBJECT' AND path NOT LIKE '%[%' AND fullkey NOT LIKE '%[%'),
c AS (SELECT producer, file_no, field, COALESCE(LIST_SORT(LIST(DISTINCT kind) FILTER (WHERE kind IS NOT NULL)), []) AS kinds FROM l GROUP BY 1, 2, 3),
fl AS (SELECT DISTINCT producer, file_no FROM c),
bo AS (SELECT a.producer, a.file_no FROM fl a JOIN fl b ON a.producer = b.producer AND a.file_no = b.file_no + 1),
p AS (SELECT bo.producer, bo.file_no, f.field, o.kinds AS old_kinds, n.kinds AS new_kinds FROM bo JOIN (SELECT DISTINCT producer, field FROM c) f ON f.producer = bo.producer
  LEFT JOIN c o ON o.producer = bo.producer AND o.file_no = bo.file_no - 1 AND o.field = f.field LEFT JOIN c n ON n.producer = bo.producer AND n.file_no = bo.file_no AND n.field = f.field),
gone AS (SELECT * FROM p WHERE old_kinds IS NOT NULL AND new_kinds IS NULL), fresh AS (SELECT * FROM p WHERE old_kinds IS NULL AND new_kinds IS NOT NULL),
rn AS (SELECT g.producer, g.file_no, g.field, f.field AS new_field FROM gone g JOIN fresh f ON f.producer = g.producer AND f.file_no = g.file_no
  JOIN l a ON a.producer = g.producer AND a.file_no = g.file_no - 1 AND a.field = g.field AND a.kind IS NOT NULL
  JOIN l b ON b.producer = g.producer AND b.file_no = g.file_no AND b.field = f.field AND b.kind IS NOT NULL AND b.table_id = a.table_id
  GROUP BY 1, 2, 3, 4 HAVING BOOL_AND(a.kind = b.kind AND a.v = b.v))
SELECT producer, file_no, 'renamed' AS change, field, new_field FROM rn
UNION ALL SELECT producer, file_no, 'removed', field, '' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM rn WHERE rn.producer = g.producer AND rn.file_no = g.file_no AND rn.field = g.field)
UNION ALL SELECT producer, file_no, 'added', field, '' FROM fresh g WHERE NOT EXISTS (SELECT 1 FROM rn WHERE rn.producer = g.producer AND rn.file_no = g.file_no AND rn.new_field = g.field)
UNION ALL SELECT producer, file_no, 'retyped', field, '' FROM p WHERE old_kinds <> new_kinds AND len(old_kinds) > 0 AND len(new_kinds) > 0"""

# -- packed fields

_D = r";|,\t>"
_B = r" \x{a0}\x{2007}\x{202f}\x{3000}\r\n\x{0b}\x{0c}"
_END = r"\x{01}"


def _quoted(q: str) -> str:
    """A quoted run up to its closing quote: pairs and backslashed quotes stand for the quote."""
    return rf'{q}((?:\\+{q}|{q}{q}|\\+[^{q}\\]|[^{q}\\])*){q}'


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _trim(x: str) -> str:
    return f"REGEXP_REPLACE({x}, {_sql(f'^[{_B}\\t]+|[{_B}\\t]+$')}, '', 'g')"


_LISTED = r"^\[((?:[^\[\]]|\[(?:[^\[\]]|\[[^\[\]]*\])*\])*)\]$"
_VALUE = rf"(?:\\[{_D}\"'\\\[\]]|[^{_D}{_END}])*"
_FIELD = rf"[{_B}]*(?:{_quoted(chr(34)).replace('((', '(?:(')}|{_quoted(chr(39)).replace('((', '(?:(')})?{_VALUE}[{_D}{_END}]"


def _unwrapped(x: str) -> str:
    double, single = ("^" + _quoted(q) + "$" for q in "\"'")
    inner = lambda q, p: rf"REGEXP_REPLACE(REGEXP_EXTRACT({x}, {_sql(p)}, 1), {_sql(rf'\\{q}|{q}{q}')}, {_sql(q)}, 'g')"
    return _trim(
        f"CASE WHEN REGEXP_MATCHES({x}, {_sql(_LISTED)}) THEN REGEXP_EXTRACT({x}, {_sql(_LISTED)}, 1) "
        f"WHEN REGEXP_MATCHES({x}, {_sql(double)}) THEN {inner(chr(34), double)} WHEN REGEXP_MATCHES({x}, {_sql(single)}) THEN {inner(chr(39), single)} ELSE {x} END"
    )


def _value(f: str) -> str:
    """The value of one field, without its delimiter."""
    plain = lambda x: rf"REGEXP_REPLACE({x}, {_sql(rf'\\([{_D}\"' + chr(39) + r'\\\[\]])')}, '\1', 'g')"
    out = plain(f)
    for q in "\"'":
        p = rf"^[{_B}]*{_quoted(q)}"
        inner = rf"REGEXP_REPLACE(REGEXP_EXTRACT({f}, {_sql(p)}, 1), {_sql(rf'\\{q}|{q}{q}')}, {_sql(q)}, 'g')"
        out = f"CASE WHEN REGEXP_MATCHES({f}, {_sql(p)}) THEN {inner} || {plain(f'REGEXP_REPLACE({f}, {_sql(p)}, {_sql(str())})')} ELSE {out} END"
    return _trim(out)


PACKED = (
    f"WITH o AS (SELECT DISTINCT id, {_trim('taxonomy')} AS t FROM obs WHERE taxonomy IS NOT NULL), "
    + "".join(f"u{i} AS (SELECT id, {_unwrapped('t')} AS t FROM {'o' if i == 1 else f'u{i - 1}'}), " for i in (1, 2, 3))
    + f"e AS (SELECT id, REGEXP_EXTRACT_ALL(t || CHR(1), {_sql(_FIELD)}) AS l FROM u3), "
    "n AS (SELECT id, i - 1 AS pos, l[i][1:-2] AS f FROM (SELECT *, UNNEST(range(1, len(l) + 1)) AS i FROM e) x) "
    f"SELECT DISTINCT id AS obs_id, pos, {_value('f')} AS taxon FROM n WHERE {_value('f')} <> ''"
)


def oracle_sql() -> dict[str, str]:
    return {"table_files_validated": VALIDATED, "p2_found": _found(), "p2_unread": UNREAD, "p3_found": CHANGES, "p4_found": PACKED} | {f"p2_{name}": TABLES + sql for name, sql in PARTS.items()}
