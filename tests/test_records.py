"""Operators on raw records, against plain versions of their rules."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparrix.operators.drift import assign, header_fields, name_similarity, schema_changes, unify
from sparrix.operators import drift, nested, packed
from sparrix.operators.nested import TABLE_SHAPE, Shape, Walker, as_text, node_table, node_tables, parse, table_relations, unread_records
from sparrix.operators.packed import BLANKS, DELIMITERS, MASK, resolve, split_packed
from sparrix.plans import records
from sparrix.runtime import materialize

# -- packed fields

SPACE = BLANKS + "\t"
SPECIAL = DELIMITERS + "\"'\\[]" + SPACE


def plain_unwrap(s):
    while True:
        s = s.strip(SPACE)
        if len(s) < 2:
            return s
        if s[0] in "\"'":
            q, i, out = s[0], 1, ""
            while i < len(s):
                if s[i] in (q, "\\") and s[i + 1 : i + 2] == q:
                    out, i = out + q, i + 2
                    continue
                if s[i] == q:
                    break
                out, i = out + s[i], i + 1
            if i != len(s) - 1:
                return s
            s = out
        elif s[0] == "[" and s[-1] == "]":
            depth = 0
            for k, c in enumerate(s):
                depth += (c == "[") - (c == "]")
                if not depth:
                    break
            if k != len(s) - 1 or depth:
                return s
            s = s[1:-1]
        else:
            return s


def plain_split(s):
    """Values by place, sign by sign."""
    s, values, i = plain_unwrap(s), [], 0
    while True:
        value = ""
        while i < len(s) and s[i] in SPACE and s[i] not in DELIMITERS:
            i += 1
        if i < len(s) and s[i] in "\"'":
            q, j, inner, closed = s[i], i + 1, "", False
            while j < len(s):
                if s[j] in (q, "\\") and s[j + 1 : j + 2] == q:
                    inner, j = inner + q, j + 2
                    continue
                if s[j] == q:
                    closed = True
                    break
                inner, j = inner + s[j], j + 1
            if closed:
                value, i = inner, j + 1
        while i < len(s) and s[i] not in DELIMITERS:
            if s[i] == "\\" and i + 1 < len(s) and s[i + 1] in DELIMITERS + "\"'\\[]":
                value, i = value + s[i + 1], i + 2
            else:
                value, i = value + s[i], i + 1
        values.append(value.strip(SPACE))
        if i >= len(s):
            return [(p, v) for p, v in enumerate(values) if v]
        i += 1


def by_skeleton(s):
    """The operator's way, for one text: mask, resolve, pick by position."""
    segments, skeleton = [], ""
    for c in s:
        if c in SPECIAL:
            segments.append(c)
            skeleton += c
        elif skeleton.endswith(MASK):
            segments[-1] += c
        else:
            segments.append(c)
            skeleton += MASK
    return [(p, "".join(segments[i] for i in at)) for p, at in resolve(skeleton)]


CASES = {
    "k__A; p__B;c__C": [(0, "k__A"), (1, "p__B"), (2, "c__C")],
    "a|b,c\td>e": [(0, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e")],
    '"a; b"; c': [(0, "a; b"), (1, "c")],
    '"a; b; c"': [(0, "a"), (1, "b"), (2, "c")],
    '"a; ""b; c"""': [(0, "a"), (1, "b; c")],
    '["a", "b;c"]': [(0, "a"), (1, "b;c")],
    "['a', 'b']": [(0, "a"), (1, "b")],
    "[a]; [b]": [(0, "[a]"), (1, "[b]")],
    'x; "a ""wide"""': [(0, "x"), (1, 'a "wide"')],
    'x; "a \\"wide\\""': [(0, "x"), (1, 'a "wide"')],
    "Vav'a; b": [(0, "Vav'a"), (1, "b")],
    "a \\> b; c": [(0, "a > b"), (1, "c")],
    "a;;b;": [(0, "a"), (2, "b")],
    'a; ""; b': [(0, "a"), (2, "b")],
    "g__; s__": [(0, "g__"), (1, "s__")],
    '"never closed; b': [(0, '"never closed'), (1, "b")],
    "": [], "  ": [], '""': [], "[]": [], "\\": [(0, "\\")],
}


@pytest.mark.parametrize("text", CASES)
def test_packed_cases(text):
    assert plain_split(text) == CASES[text] == by_skeleton(text)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab;|,\t>\"'\\[]  ", max_size=24))
def test_packed_against_plain(text):
    assert by_skeleton(text) == plain_split(text)


def test_packed_frame(spark):
    rows = [(i, t, "x") for i, t in enumerate(CASES)] + [(0, next(iter(CASES)), "x"), (None, "a;b", "x"), (99, None, "x"), (100, "z" * 100_000 + ";y", "x")]
    df = spark.createDataFrame(rows, "skeleton int, packed string, pos string")  # names as used within
    got = {(r["skeleton"], r["pos"], r["value"]) for r in split_packed(df, "packed", ["skeleton"]).collect()}
    assert got == {(i, p, v) for i, t, _ in rows if t is not None for p, v in plain_split(t)}
    assert split_packed(df.limit(0), "packed", ["skeleton"]).count() == 0


def test_packed_rules_shuffled(spark, data, monkeypatch):
    expected = {tuple(r) for r in records.p4_found(spark, data).collect()}
    monkeypatch.setattr(packed, "BROADCAST_CHARS", 0)
    assert {tuple(r) for r in records.p4_found(spark, data).collect()} == expected


def test_lineages(spark, data):
    obs = spark.read.parquet(f"{data}/obs.parquet")
    expected = {(r["id"], p, v) for r in obs.where("taxonomy is not null").collect() for p, v in plain_split(r["taxonomy"])}
    got = records.p4_found(spark, data).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


# -- nested records


def as_list(v):
    return v if isinstance(v, list) else [] if v is None else [v]


def plain_relations(key, doc):
    out = set()

    def md(x):
        m = x.get("metadata")
        return (json.loads(m) if isinstance(m, str) else m) or {}

    rows, columns = as_list(doc.get("rows")), as_list(doc.get("columns"))
    for i, r in enumerate(rows):
        if r is None:
            continue
        if r.get("id") is not None:
            out.add((key, "row", i, -1, -1, r["id"]))
        m = md(r)
        out |= {(key, "taxon", i, k, -1, x) for k, x in enumerate(as_list(m.get("taxonomy"))) if x is not None}
        out |= {(key, "pathway", i, k, n, y) for k, x in enumerate(as_list(m.get("pathways"))) for n, y in enumerate(as_list(x)) if y is not None}
        out |= {(key, "member", i, -1, -1, k) for k in m if k not in ("taxonomy", "pathways", "confidence")}
    for i, c in enumerate(columns):
        if c is None:
            continue
        if c.get("id") is not None:
            out.add((key, "column", i, -1, -1, c["id"]))
        for k, x in enumerate(as_list(md(c).get("runs"))):
            if x is None:
                continue
            if x.get("run") is not None:
                out.add((key, "run", i, k, -1, x["run"]))
            out |= {(key, "lane", i, k, n, y["lane"]) for n, y in enumerate(as_list(x.get("lanes"))) if y is not None and y.get("lane") is not None}
    cells = doc.get("data") or []
    if doc.get("matrix_type") == "dense":
        cells = [(a, b, v) for a, x in enumerate(cells) for b, v in enumerate(x or [])]
    for a, b, v in cells:
        if v and 0 <= a < len(rows) and 0 <= b < len(columns) and rows[a] is not None and columns[b] is not None:
            out.add((key, "cell", a, b, -1, ""))
    return out


ODD = {
    "rows": {"id": "only", "metadata": '{"taxonomy": "bare", "pathways": [["a", null, "b"], null, "c"], "M1": null, "M2": {"taxonomy": ["in"]}}'},
    "columns": [None, {"id": "c1", "metadata": {"runs": {"run": "R", "lanes": [None, {"lane": "L1"}, {"reads": 2}]}}}, {"id": None}],
    "matrix_type": "sparse", "data": [[0, 1, 2], [0, 1, 3], [0, 0, 5], [0, 9, 5], [0, 2, 0], [0, 2, None]],
}


def test_relations(spark, data):
    files = spark.read.parquet(f"{data}/table_files.parquet")
    expected = set()
    for r in files.collect():
        expected |= plain_relations(r["file_id"], json.loads(r["body"]))
    got = records.p2_found(spark, data).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_odd_records(spark):
    bodies = [json.dumps(ODD), json.dumps(ODD, indent=2), None, "", "{bad", "[1]", "null", "{}", '{"rows": [], "data": null}', '{"rows": [{"id": "\\ud800"}]}', "[" * 100_000 + "]" * 100_000, json.dumps({"rows": [{"id": "x" * 200_000}]})]
    df = spark.createDataFrame([(i, b, "z") for i, b in enumerate(bodies)] + [(0, bodies[0], "z")], "file_id int, body string, item string")
    got = {tuple(r) for r in table_relations(df).where("file_id <= 8").collect()}
    assert got == plain_relations(0, ODD) | plain_relations(1, ODD)
    assert table_relations(df).where("file_id in (9, 11)").count() == 2 and table_relations(df.limit(0)).count() == 0


def cell_places(data, layout, rows=None, columns=None):
    two = [{"id": 1}, {"id": 2}]
    walker = Walker(TABLE_SHAPE)
    walker.walk(0, {"columns": columns or two, "data": data, "matrix_type": layout, "rows": rows or two})
    _, docs, places, _ = nested._matrix_rows(walker, nested._Columns(walker.take()), nested.TABLE_MATRIX)
    return {(int(a), int(b)) for a, b in zip(*places[:2], strict=True)}


def test_cells_from_nodes():
    assert cell_places([1, 0, 5], "sparse") == {(1, 0)}
    assert cell_places([[1, 0], [0, "x"]], "DENSE ") == {(0, 0), (1, 1)}
    assert cell_places([[1, 0], None, [0, 2]], "dense", rows=[{"id": 1}] * 3) == {(0, 0), (2, 1)}
    assert cell_places([[1, None], [None, 2]], "dense") == {(0, 0), (1, 1)}
    assert cell_places([[1, 0], [0, 2]], None) == {(0, 0), (1, 1)}
    assert cell_places([[0, 1, 2.5]], None) == {(0, 1)} and cell_places([[0, 1, "2"], [1, 1, True]], None) == {(0, 1), (1, 1)}
    assert cell_places([[0, 1, 5], [1, 1, [3]], {"a": 1}], "sparse") == {(0, 1), (1, 1)}
    assert cell_places([[0, 1, 5], [0, 0, 5]], "sparse", columns=[None, {"id": 2}]) == {(0, 1)}
    for data in (None, 3, [], {}, [[0.5, 0, 1]], [[True, 0, 1]], [[0, 0, "0"]], [[0, 0]], [None], [[None, 0, 1]], [[0, None, 1]], [[0, 0, 1, None]], [["0", 0, 1]], [[1e300, 0, 1]], [[0, 0, None]]):
        assert cell_places(data, "sparse") == set(), data


def test_labels_of_vectors():
    """Vectors labelled at once have the numbers of a walk over all of their entries."""
    rng = np.random.default_rng(0)
    for _ in range(20):
        data = [None if rng.random() < 0.2 else [None if rng.random() < 0.2 else float(rng.integers(9)) for _ in range(rng.integers(0, 5))] for _ in range(rng.integers(0, 7))]
        data.append([1.5])
        rows = []
        for shape in (TABLE_SHAPE, Shape()):
            walker = Walker(shape)
            walker.walk(0, {"a": 1, "data": data, "z": [2]})
            c = nested._Columns(walker.take())
            rows.append(sorted(zip(c.pre.tolist(), c.post.tolist(), c.parent.tolist(), [walker.kinds[k].path for k in c.kind], c.place.tolist(), c.size.tolist(), strict=True)))
        assert rows[0] == rows[1]


DEEP = 100_000


def test_records_of_any_depth(spark):
    deep = '{"rows": [{"id": "r", "metadata": {"taxonomy": ["t"], "x": ' + '{"a":[' * DEEP + "1" + "]}" * DEEP + "}}]}"
    broken = deep[:-3]
    df = spark.createDataFrame([(1, deep), (2, broken), (3, None), (4, "[1]"), (5, "{}"), (6, "{bad")], "file_id int, body string")
    got = {tuple(r)[1:] for r in table_relations(df).collect()}
    assert got == {("row", 0, -1, -1, "r"), ("taxon", 0, 0, -1, "t"), ("member", 0, -1, -1, "x")}
    assert {(r["file_id"], r["reason"]) for r in unread_records(df, ["file_id"], "body").collect()} == {(2, "no JSON"), (3, "null"), (4, "no object"), (6, "no JSON")}
    nodes = node_table(df.where("file_id = 1"), ["file_id"], "body")
    assert nodes.count() == 2 * DEEP + 8
    last = nodes.where("kind = 'number'").first()
    assert last["value"] == "1" and last["post"] == 3 and len(last["type"]) < 1000
    whole = node_table(df.where("file_id = 1"), ["file_id"], "body", Shape(whole=True)).where("kind = 'array'").first()
    assert whole["value"].endswith("1" + "]}" * DEEP + "}}]")


@pytest.mark.parametrize("text", ['{"a": [1, -2.5e3, "x\\"]}", {"b": null}], "c": {}}', "[]", " [ [ ] , { } ] ", '"x"', "3", "true", '{"a": {"b": [true, false, null]}, "a": 2}', '{"é": "\\u00e9"}'])
def test_parser_without_recursion(text):
    assert nested._parse_deep(text) == json.loads(text)
    if isinstance(json.loads(text), list | dict):
        assert nested._deep_text(json.loads(text)) == as_text(json.loads(text))


@pytest.mark.parametrize("text", ["", " ", "{", "[1,]", "[,1]", '{"a"}', '{"a":}', '{"a":1,}', "[1 2]", "1 2", "]", "{]", "[}", '{1: 2}', '["a]', "[1]]", "nul", ",", '{"a" 1}'])
def test_parser_without_recursion_refuses(text):
    with pytest.raises(ValueError):
        parse(text)
    with pytest.raises(ValueError):
        nested._parse_deep(text)


def test_one_table_for_each_type(spark, data):
    nodes = node_table(spark.read.parquet(f"{data}/table_files.parquet"), ["file_id"], "body", TABLE_SHAPE)
    tables = node_tables(nodes)
    assert {"$", "$.rows[]", "$.data[]", "$.data[][]"} <= set(tables) and "type" not in tables["$"].columns
    assert tables["$.rows[]"].count() == nodes.where("type = '$.rows[]'").count() > 0
    assert list(node_tables(nodes, ["$.rows"])) == ["$.rows"]


def test_interval_labels(spark):
    doc = {"a": [{"b": 1}, {"b": [2, None, 3]}], "c": {"d": None}}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, json.dumps(doc)), (3, None)], "k int, body string")
    rows = node_table(df, ["k"], "body").where("k = 2").orderBy("pre").collect()
    assert [r["pre"] for r in rows] == list(range(len(rows))) and sorted(r["post"] for r in rows) == list(range(len(rows)))
    by_pre = {r["pre"]: r for r in rows}
    for r in rows:  # the parent is the innermost node that contains the interval
        above = [x for x in rows if x["pre"] < r["pre"] and x["post"] > r["post"]]
        assert (max(x["pre"] for x in above) if above else -1) == r["parent"]
        if r["parent"] >= 0:
            assert r["type"].startswith(by_pre[r["parent"]]["type"])
    assert [(r["type"], r["place"], r["value"]) for r in rows if r["kind"] == "number"] == [("$.a[].b", -1, "1"), ("$.a[].b[]", 0, "2"), ("$.a[].b[]", 2, "3")]
    whole = node_table(df, ["k"], "body", Shape(whole=True)).where("k = 1 and kind = 'array'").collect()
    assert [r["value"] for r in whole] == ['[{"b":1},{"b":[2,null,3]}]']
    assert node_table(df, ["k"], "body", TABLE_SHAPE).count() > 0


# -- drifting schemas


def kind(v):
    return "array" if isinstance(v, list) else "boolean" if isinstance(v, bool) else "number" if isinstance(v, int | float) else "string" if isinstance(v, str) else None


def leaves(o, prefix=""):
    for k, v in o.items():
        if isinstance(v, dict):
            yield from leaves(v, f"{prefix}{k}.")
        else:
            yield prefix + k, v


def plain_changes(rows):
    files, out = {}, set()
    for producer, file_no, table_id, body in rows:
        fields = files.setdefault((producer, file_no), {})
        for name, v in leaves(json.loads(body)):
            fields.setdefault(name, {})[table_id] = v
    for (p, f), new in files.items():
        old = files.get((p, f - 1))
        if old is None:
            continue
        gone, fresh, moved = [x for x in old if x not in new], [x for x in new if x not in old], set()
        for a in gone:
            for b in fresh:
                both = [(v, new[b][t]) for t, v in old[a].items() if v is not None and new[b].get(t) is not None]
                if both and all(kind(x) == kind(y) and x == y for x, y in both):
                    out.add((p, f, "renamed", a, b))
                    moved |= {(0, a), (1, b)}
        out |= {(p, f, "removed", a, "") for a in gone if (0, a) not in moved} | {(p, f, "added", b, "") for b in fresh if (1, b) not in moved}
        for x in set(old) & set(new):
            kinds = [{kind(v) for v in t[x].values()} - {None} for t in (old, new)]
            if all(kinds) and kinds[0] != kinds[1]:
                out.add((p, f, "retyped", x, ""))
    return out


def test_changes(spark, data):
    rows = [(r["producer"], r["file_no"], r["table_id"], r["body"]) for r in spark.read.parquet(f"{data}/table_headers.parquet").dropDuplicates(["rec_id"]).collect()]
    got = records.p3_found(spark, data).collect()
    assert {tuple(r) for r in got} == plain_changes(rows) and len(got) == len({tuple(r) for r in got})


def headers(spark, rows):
    return spark.createDataFrame([(i, p, f, t, b, "x") for i, (p, f, t, b) in enumerate(rows)], "rec_id long, producer string, file_no int, table_id string, body string, field string")


@pytest.mark.parametrize("size", [1, 3])
def test_changes_by_sketches_cut_off(spark, data, monkeypatch, size):
    """Where sketches do not hold all values, the pairs they do not refute are compared in full."""
    monkeypatch.setattr(drift, "SKETCH", size)
    rows = spark.read.parquet(f"{data}/table_headers.parquet").select("producer", "file_no", "table_id", "body").collect()
    assert {tuple(r) for r in records.p3_found(spark, data).collect()} == plain_changes([tuple(r) for r in rows])


def test_contained():
    few, many = set(range(0, 4000, 400)), set(range(0, 4000))
    cut = set(sorted(many)[: drift.SKETCH])
    assert drift.contained(few, cut) == 1.0 and drift.contained(few, many | {9999}) == 1.0
    assert drift.contained({5, 7}, {5}) == 1.0 and drift.contained(set(), {1}) == 0.0 and drift.contained({10**9}, cut) == 0.0


def test_change_cases(spark):
    rows = [
        ("p", 1, "t1", '{"a": 1, "b": "x", "n": {"m": [1]}, "gone": 3, "nul": null}'),
        ("p", 1, "t2", '{"a": null, "b": "y"}'),
        ("p", 2, "t1", '{"A": 1.0, "b": 5, "n.m": [1], "new": 4, "nul2": null}'),
        ("p", 2, "t2", '{"A": 7, "b": null}'),
        ("p", 4, "t1", '{"z": 1}'),  # no file 3: compared with none
        ("q", 1, "t1", '{"a": 1}'), ("q", 2, "t9", '{"c": 1}'),  # no record in both
        ("q", 1, "t2", None), ("q", 1, "t3", "[]"), ("q", 1, "t4", "{}"),
    ]
    fields = materialize(header_fields(headers(spark, rows + rows[:2])), "fields")
    got = {tuple(r) for r in schema_changes(fields).collect()}
    assert got == {
        ("p", 2, "renamed", "a", "A"), ("p", 2, "retyped", "b", ""), ("p", 2, "removed", "gone", ""), ("p", 2, "removed", "nul", ""), ("p", 2, "added", "new", ""), ("p", 2, "added", "nul2", ""),
        ("q", 2, "removed", "a", ""), ("q", 2, "added", "c", ""),
    }
    empty = header_fields(headers(spark, rows).limit(0))
    assert schema_changes(empty).count() == 0


def test_contested_renames(spark):
    rows = [("p", 1, f"t{i}", json.dumps({"type": "x", "style": "x" if i else None})) for i in range(3)] + [("p", 2, f"t{i}", json.dumps({"styles": "x", "table_type": "x"})) for i in range(3)]
    got = {tuple(r)[2:] for r in schema_changes(materialize(header_fields(headers(spark, rows)), "fields")).collect()}
    assert got == {("renamed", "type", "table_type"), ("renamed", "style", "styles")}


def test_unify(spark):
    rows = [("p", f, f"t{t}", json.dumps({name: f"v{t}", "matrixType": "sparse"})) for f, name in ((1, "format"), (2, "fmt"), (3, "file_format")) for t in range(4)]
    rows += [("q", 1, f"t{t}", json.dumps({"format": f"v{t}", "matrix_type": "sparse"})) for t in range(4)]
    fields = materialize(header_fields(headers(spark, rows)), "fields")
    out = unify(fields, schema_changes(fields), ["format", "matrix_type"]).collect()
    assert len(out) == 16 and {(r["table_id"], r["format"], r["matrix_type"]) for r in out} == {(f"t{t}", f"v{t}", "sparse") for t in range(4)}


def test_unify_keeps_what_no_target_takes(spark):
    """One more column for each meaning; names beside each other are two meanings, in any spelling."""
    rows = [("p", 1, f"t{t}", json.dumps({"format": f"v{t}", "labName": f"bench {t}", "type": "x", "Type": f"y{t}"})) for t in range(4)]
    rows += [("q", 1, f"t{t}", json.dumps({"format": f"v{t}", "lab_name": f"bench {t}", "new.count": t})) for t in range(4)]
    fields = materialize(header_fields(headers(spark, rows)), "fields")
    out = unify(fields, schema_changes(fields), ["format"])
    assert out.columns[:5] == ["producer", "file_no", "rec_id", "table_id", "format"]
    kept = [sorted(v for v in r[4:] if v is not None) for r in out.orderBy("producer", "table_id").collect()]
    assert kept == [sorted([f"v{t}", f"bench {t}", "x", f"y{t}"]) for t in range(4)] + [sorted([f"v{t}", f"bench {t}", str(t)]) for t in range(4)]
    lab = next(c for c in out.columns if c.lower().startswith("lab"))
    assert [r[0] for r in out.orderBy("producer", "table_id").select(lab).collect()] == [f"bench {t}" for t in range(4)] * 2
    assert len({c.lower() for c in out.columns}) == len(out.columns) == 9


def test_unify_renames_without_proof(spark):
    """Other tables in the next file, a file missing, a name that comes back: all values reach their target."""
    names = {1: "type", 2: "tableType", 4: "table.type", 5: "type"}  # no table is in two files
    rows = [("p", f, f"t{f}{t}", json.dumps({name: f"{'OTU' if t % 2 else 'Gene'} table", "kind": f"k{f}{t}"})) for f, name in names.items() for t in range(4)]
    rows += [("q", 1, f"t{t}", json.dumps({"type": f"{'OTU' if t % 2 else 'Gene'} table"})) for t in range(4)]
    fields = materialize(header_fields(headers(spark, rows)), "fields")
    out = unify(fields, schema_changes(fields), ["type", "format"]).collect()
    assert len(out) == 20 and all(r["type"] == f"{'OTU' if int(r['table_id'][-1]) % 2 else 'Gene'} table" and r["format"] is None for r in out)
    assert {r["kind"] for r in out if r["producer"] == "p"} == {f"k{f}{t}" for f in names for t in range(4)}


def test_unify_with_a_name_that_comes_back(spark):
    """The old name comes back while its column goes on under another name: two columns."""
    bodies = {1: {"a": "u"}, 2: {"b": "u"}, 3: {"b": "u", "a": "w"}}
    rows = [("p", f, f"t{t}", json.dumps({k: v + str(t) for k, v in body.items()})) for f, body in bodies.items() for t in range(3)]
    fields = materialize(header_fields(headers(spark, rows)), "fields")
    out = unify(fields, schema_changes(fields), ["a"]).where("file_no = 3").collect()
    assert [sorted(v for v in r[4:] if v is not None) for r in sorted(out, key=lambda r: r["table_id"])] == [[f"u{t}", f"w{t}"] for t in range(3)]


def test_unify_takes_a_known_meaning_before_a_target(spark):
    """A flag whose values some target has too is no value of the target, even where the target is absent."""
    rows = [("p", 1, f"t{t}", json.dumps({"layout": bool(t % 2), "curated": bool(t % 3)})) for t in range(4)]
    rows += [("q", 1, f"t{t}", json.dumps({"curated": bool(t % 2)})) for t in range(4)]
    rows += [("r", 1, f"t{t}", json.dumps({"matrix_type": bool(t % 2), "curated": bool(t % 2)})) for t in range(4)]
    fields = materialize(header_fields(headers(spark, rows)), "fields")
    out = unify(fields, schema_changes(fields), ["matrix_type"]).where("producer = 'q'").collect()
    assert all(r["matrix_type"] is None and r["curated"] is not None for r in out) and len(out) == 4


def test_assignment():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (2, 3), (4, 2), (5, 5)):
        for _ in range(20):
            w = rng.integers(0, 6, (n, m)).astype(float)
            got = assign(w)
            assert len({i for i, _ in got}) == len(got) == len({j for _, j in got})
            best = max(sum(w[i, j] for i, j in zip(range(n), p, strict=False) if j < m) for p in __import__("itertools").permutations(range(max(n, m))))
            assert sum(w[i, j] for i, j in got) == best
    assert assign(np.zeros((2, 2))) == []


def test_name_similarity():
    assert name_similarity("matrix_type", "matrixType") == name_similarity("MATRIX-TYPE", "matrix.type") == 1
    assert name_similarity("format", "file_format") > name_similarity("format", "type")
