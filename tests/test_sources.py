import gzip
import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrix.core import MatrixTable, example_table
from sparrix import spec
from sparrix.errors import ParseError, SparrixError, TableError
from sparrix.functions.scalar import float_or_text, int_or_text, join_list, join_nested, split_list, split_nested, strip_brackets
from sparrix.sources import hdf5, read_matrix, write_matrix
from sparrix.sources import files as sources_files
from sparrix.sources import sniff as sniffing
from sparrix.sources.frames import to_anndata, to_pandas
from sparrix.sources import json_parts
from sparrix.sources.json_table import field, read_json, subset, to_json
from sparrix.sources.long import mapping_frame, read_adjacency, read_fasta_names, read_mapping, read_uc
from sparrix.sources.parquet import read_parquet, write_parquet
from sparrix.sources.tsv import first_bad_value, read_tsv, to_tsv, write_tsv_parts
from sparrix.spec import validate_hdf5, validate_text
from tests.helpers import dense, ids, make

WIDE = """# a comment
#OTU ID\tFing\tKey\tNA\tConsensus Lineage
0\t19111\t44536\t42 \tBacteria; Actinobacteria
1\t1216\t3500\t6\tBacteria; Firmicutes
# within the data
2\t1803\t0\t2.5\tBacteria; Firmicutes; Alicyclobacillaceae

"""


@pytest.fixture(scope="module")
def table(spark):
    return make(spark, [[0, 1, 2.5], [3, 0, 5], [0, 0, 0]], ["b", "a", "c"], ["S2", "S1", "S3"], [{"tax": ["x", "y"], "n": 1}, {"tax": ["z"], "n": None}, {"tax": None, "n": 3}], type="OTU table")


def test_wide_text(spark, tmp_path):
    t = read_tsv(spark, WIDE.split("\n"))
    assert ids(t) == ["Fing", "Key", "NA"] and ids(t, "observation") == ["0", "1", "2"]
    assert dense(t) == [[19111, 44536, 42], [1216, 3500, 6], [1803, 0, 2.5]]
    assert t.obs.orderBy("ord").first()["md"]["Consensus Lineage"] == "Bacteria; Actinobacteria"
    split = read_tsv(spark, WIDE.split("\n"), process=split_list, md_name="taxonomy")
    assert split.obs.orderBy("ord").first()["md"]["taxonomy"] == ["Bacteria", "Actinobacteria"]
    plain = read_tsv(spark, ["OTU ID\ta\tb", "#x", "o1\t1\t0", "o2\t0\t2"])
    assert not plain.has_metadata("observation") and dense(plain) == [[1, 0], [0, 2]]
    path = tmp_path / "wide.tsv"
    path.write_text(WIDE)
    assert read_tsv(spark, str(path)).equals(t)
    with pytest.raises(Exception, match="not a number"):
        read_tsv(spark, ["#id\ta\tb", "o\tx\t1"]).cells.collect()
    with pytest.raises(ParseError):
        read_tsv(spark, ["# only", ""])
    md = spark.createDataFrame([("o1", "q")], "id string, k string")
    with pytest.raises(KeyError):
        read_tsv(spark, ["#id\ta\tb", "o1\t1\t1", "o2\t1\t1"], obs_mapping=md)
    assert first_bad_value(spark, ["1", "2.5", "x", "y"]) == ("x", 2) and first_bad_value(spark, ["1"]) is None


def test_wide_text_round_trip(spark, table, tmp_path):
    text = to_tsv(table, "tax", "Lineage")
    lines = text.split("\n")
    assert lines[1] == "#OTU ID\tS2\tS1\tS3\tLineage" and lines[2] == "b\t0.0\t1.0\t2.5\tx; y" and lines[4] == "c\t0.0\t0.0\t0.0\tNone"
    back = read_tsv(spark, to_tsv(table).split("\n"))
    assert dense(back) == dense(table) and ids(back, "observation") == ["b", "a", "c"]
    write_tsv_parts(table, str(tmp_path / "parts"))
    assert spark.read.text(str(tmp_path / "parts")).count() == 3
    with pytest.raises(TableError):
        to_tsv(MatrixTable.from_data(spark, [], [], []))


def test_adjacency(spark):
    t = read_adjacency(spark, ["#OTU ID\tSampleID\tvalue", "O2\tS1\t1", "O1\tS2\t2.5", "O2\tS1\t3", ""])
    assert ids(t, "observation") == ["O1", "O2"] and dense(t) == [[0, 2.5], [4, 0]]
    with pytest.raises(Exception, match="adjacency"):
        read_adjacency(spark, ["a\tb"]).cells.collect()


UC = [
    "# a comment",
    "S\t0\t133\t*\t*\t*\t*\t*\tf2_1539\t*",
    "H\t0\t133\t100\t+\t0\t0\t133M\tf2_1540\tf2_1539",
    "H\t0\t133\t100\t+\t0\t0\t133M\tf_3_15 extra\tf2_1539",
    "L\t1\t133\t*\t*\t*\t*\t*\t295053\t*",
    "C\t0\t3\t*\t*\t*\t*\t*\tf2_1539\t*",
    "H\t1\t133\t97\t+\t0\t0\t133M\tp1_1\t295053",
]


def test_cluster_file(spark):
    t = read_uc(spark, UC)
    assert ids(t, "observation") == ["f2_1539", "295053"] and ids(t) == ["f2", "f_3", "p1"]
    assert dense(t) == [[2, 1, 0], [0, 0, 1]]
    names = read_fasta_names(spark, [">otu1 f2_1539", "ACGT", ">otu2 295053 x", "AC"])
    assert ids(read_uc(spark, UC, names), "observation") == ["otu1", "otu2"]
    with pytest.raises(Exception, match="underscore"):
        read_uc(spark, ["S\t0\t1\t*\t*\t*\t*\t*\tnone\t*"]).cells.collect()
    assert read_uc(spark, UC[:1]).shape == (0, 0)


def test_mapping_file(spark):
    lines = ['#sample\ta\tb', '#comment line to skip', '"x "\t" y "\t z ', 's2\tonly', '']
    rows = {r["id"]: (r["a"], r["b"]) for r in read_mapping(spark, lines).collect()}
    assert rows == {"x": ("y", "z"), "s2": ("only", "")}
    kept = {r["id"]: r["a"] for r in read_mapping(spark, lines, strip_quotes=False).collect()}
    assert kept['"x "'] == '" y "'
    raw = {r["id"]: r["b"] for r in read_mapping(spark, lines, strip_spaces=False).collect()}
    assert raw["x "] == " z "
    typed = read_mapping(spark, ["#id\tn\tt", "x\t3\ta;b"], process={"n": int_or_text, "t": split_list}).first()
    assert typed["n"] == "3" and typed["t"] == ["a", "b"]
    assert read_mapping(spark, ["x\t3"], header=["id", "n"]).first()["n"] == "3"
    for bad in (["x\t1"], ["#id\tn"], ["#id\tn", "x\t1", "x\t2"]):
        with pytest.raises(ParseError):
            read_mapping(spark, bad)


def test_json_round_trip(spark, table, tmp_path):
    text = to_json(table, "tests")
    doc = json.loads(text)
    assert doc["shape"] == [3, 3] and doc["matrix_type"] == "sparse" and [0, 1, 1.0] in doc["data"] and doc["rows"][1]["metadata"]["n"] is None
    back = read_json(spark, text)
    assert back.equals(table._new(type="OTU table")) and back.props.generated_by == "tests"
    path = str(tmp_path / "t.json")
    write_matrix(table, path, "json")
    scanned = read_matrix(spark, path)
    assert dense(scanned) == dense(table) and scanned.obs.orderBy("ord").first()["md"]["tax"] == ["x", "y"]
    assert field(spark, path, "type") == "OTU table" and sniffing.sniff(path) == "json"
    part = subset(read_json(spark, text), ["S3"], "sample")
    assert ids(part) == ["S3"] and part.length("observation") == 3
    with pytest.raises(KeyError):
        subset(back, ["zz"], "sample")
    smaller = read_matrix(spark, path, ids=["S2"])
    assert ids(smaller) == ["S2"] and ids(smaller, "observation") == ["a"]


def test_json_dense_and_bare(spark, tmp_path):
    doc = {"id": None, "format": "1.0.0", "format_url": "u", "type": "OTU table", "generated_by": "g", "date": "2020-01-01T00:00:00", "matrix_type": "dense", "matrix_element_type": "int",
           "shape": [2, 2], "rows": [{"id": "r1", "metadata": None}, {"id": "r2", "metadata": None}], "columns": [{"id": "c1", "metadata": None}, {"id": "c2", "metadata": None}], "data": [[1, 0], [0, 2]]}
    path = tmp_path / "d.json"
    path.write_text(json.dumps(doc, indent=1))
    for t in (read_json(spark, str(path)), read_json(spark, doc)):
        assert dense(t) == [[1, 0], [0, 2]] and not t.has_metadata("sample") and t.props.create_date.year == 2020


def test_parquet(spark, table, tmp_path):
    path = str(tmp_path / "t")
    full = table.add_group_metadata({"tree": ("newick", "(S1);")})
    write_parquet(full, path, both=True)
    back = read_matrix(spark, path)
    assert back.equals(full) and back.group_metadata() == {"tree": ("newick", "(S1);")}
    part = read_parquet(spark, path, ["S2"], "sample")
    assert ids(part) == ["S2"] and ids(part, "observation") == ["a"]
    assert "EqualTo(samp_id,S2)" in part.cells._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        read_parquet(spark, path, ["zz"])


def test_sniffing(spark, tmp_path):
    path = tmp_path / "data.txt"
    path.write_bytes(gzip.compress(WIDE.encode()))
    assert sniffing.is_gzip(str(path)) and not sniffing.is_hdf5(str(path)) and sniffing.sniff(str(path)) == "tsv"
    assert read_matrix(spark, str(path)).shape == (3, 3)
    empty = tmp_path / "empty"
    empty.write_text("")
    with pytest.raises(ValueError):
        sniffing.sniff(str(empty))
    (tmp_path / "h").write_bytes(b"\x89HDF\r\n\x1a\n rest")
    assert sniffing.sniff(str(tmp_path / "h")) == "hdf5"
    with pytest.raises(ParseError):
        read_matrix(spark, str(path), format="other")
    with pytest.raises(ValueError):
        write_matrix(None, "x", format="other")
    assert sniffing.file_md5(str(empty)) == "d41d8cd98f00b204e9800998ecf8427e" == sniffing.file_md5([])
    assert sniffing.files_md5(spark, str(tmp_path / "h")).first()["md5"] == sniffing.file_md5(str(tmp_path / "h"))


def test_frames(table):
    pdf = to_pandas(table, dense=True)
    assert list(pdf.columns) == ["S2", "S1", "S3"] and list(pdf.index) == ["b", "a", "c"] and np.allclose(pdf.to_numpy(), dense(table))
    assert to_pandas(table).sparse.density == pytest.approx(4 / 9)
    try:
        import anndata  # noqa: F401
    except ImportError:
        with pytest.raises(SparrixError):
            to_anndata(table)


def test_optional_hdf5(spark, table, tmp_path):
    h5py = pytest.importorskip("h5py")
    path = str(tmp_path / "t.hdf5")
    write_matrix(table, path, "hdf5")
    assert dense(read_matrix(spark, path)) == dense(table) and h5py.File(path)["sample/ids"].shape == (3,)


def test_hdf5_without_its_library(spark, table, tmp_path):
    try:
        import h5py  # noqa: F401
    except ImportError:
        with pytest.raises(SparrixError, match="h5py"):
            write_matrix(table, str(tmp_path / "t.hdf5"), "hdf5")


def test_text_functions(spark):
    df = spark.createDataFrame([("a; b;c", "a;b|c", " 7 ", "x1", "[ 1, 2 ]\n")], "l string, n string, i string, t string, s string")
    row = df.select(split_list(F.col("l")), split_nested(F.col("n")), int_or_text(F.col("i")), int_or_text(F.col("t")), float_or_text(F.col("i")), strip_brackets(F.col("s"))).first()
    assert list(row) == [["a", "b", "c"], [["a", "b"], ["c"]], "7", "x1", "7.0", "1, 2"]
    row = spark.range(1).select(join_list(F.array(F.lit("a;b"), F.lit("c"))), join_nested(F.array(F.array(F.lit("a"), F.lit("b|x")), F.array(F.lit("c"))))).first()
    assert list(row) == ["a:b; c", "a; b:x|c"]


@pytest.fixture
def stand_in(spark, monkeypatch):
    """The HDF5 library, or calls like its own where it is not installed."""
    try:
        import h5py  # noqa: F401
    except ImportError:
        folder = Path(__file__).parent / "stand_ins"
        spark.sparkContext.addPyFile(str(folder / "h5py.py"))
        monkeypatch.syspath_prepend(str(folder))


def test_hdf5(spark, table, tmp_path, stand_in, monkeypatch):
    path = str(tmp_path / "t.hdf5")
    table = table._new(type="OTU table", table_id="x").add_group_metadata({"tree": ("newick", "(a,b);")}, "observation")
    monkeypatch.setattr(hdf5, "VALUES_AT_ONCE", 2)
    write_matrix(table, path, "hdf5", formats={"n": lambda v: f"<{v}>"})
    back = read_matrix(spark, path)
    assert dense(back) == dense(table) and ids(back) == ids(table) and ids(back, "observation") == ids(table, "observation")
    assert back.props.type == "OTU table" and back.props.table_id == "x" and back.group_metadata("observation") == {"tree": ("newick", "(a,b);")}
    md = {r["id"]: r["md"] for r in back.obs.collect()}
    assert md["b"]["tax"] == ["x", "y"] and md["c"]["tax"] is None and md["b"]["n"] == "<1>"
    parsed = hdf5.read_hdf5(spark, path, parse={"n": lambda v: hdf5.text(v).strip("<>") or None})
    assert {r["id"]: r["md"]["n"] for r in parsed.obs.collect()} == {"a": None, "b": "1", "c": "3"}
    part = read_matrix(spark, path, ids=["S1"], axis="sample")
    assert ids(part) == ["S1"] and ids(part, "observation") == ["b"]
    rows = read_matrix(spark, path, ids=["a"], axis="observation")
    assert ids(rows, "observation") == ["a"] and dense(rows) == [[3, 5]]
    assert not hdf5.read_hdf5(spark, path, metadata=False).has_metadata("observation")
    with pytest.raises(ValueError):
        read_matrix(spark, path, ids=["zz"])
    assert validate_hdf5(path) == []


def test_hdf5_rules(spark, table, tmp_path, stand_in):
    import h5py

    path = str(tmp_path / "bad.hdf5")
    write_matrix(table, path, "hdf5")
    with h5py.File(path, "r") as f:
        f.mode = "w"
        del f["sample"].members["group-metadata"]
        f["observation"]["metadata"].create_dataset("short", data=["one"], dtype=h5py.string_dtype())
        f.attrs.update({"creation-date": "yesterday", "nnz": 9, "shape": (3, 4)})
        del f.attrs["id"]
    found = {rule for rule, _ in validate_hdf5(path)}
    assert found == {"id", "sample/group-metadata", "observation/metadata/short", "creation-date", "nnz", "sample/ids"}


def test_text_and_json_into_each_other(spark):
    text = "#OTU ID\ta\tb\no1\t1.0\t0.0\no2\t0.0\t2.5"
    doc = sniffing.text_to_json(spark, text.split("\n"))
    assert json.loads(doc)["data"] == [[0, 0, 1.0], [1, 1, 2.5]] and validate_text(spark, doc.replace('"type": null', '"type": "OTU table"').replace('"id": null', '"id": "x"')) == []
    assert sniffing.json_to_text(spark, doc).split("\n")[1:] == text.split("\n")


def test_a_table_as_text(spark, table):
    assert str(table).split("\n")[2] == "b\t0.0\t1.0\t2.5"
    small = example_table(spark)
    assert small.shape == (2, 3) and ids(small.filter(F.col("md.site") == "gut")) == ["S1", "S3"]


def test_mapping_of_a_dict(spark):
    rows = {r["id"]: (r["a"], r["b"]) for r in mapping_frame(spark, {"x": {"a": "1"}, "y": {"a": "2", "b": "3"}}).collect()}
    assert rows == {"x": ("1", ""), "y": ("2", "3")}


#: Quotes, escapes, brackets and commas within texts; lists within metadata.
_ODD = ['a,b', 'q"[', 'back\\', '\\"', '{,}', 'ü,é', ']]', 'plain', '"rows": [']


def _document(dense, indent):
    n = 40
    rows = [{"id": f"{i}{_ODD[i % 9]}", "metadata": {"tags": [_ODD[(i + k) % 9] for k in range(3)], "n": i}} for i in range(n)]
    columns = [{"id": f"c{i}", "metadata": None} for i in range(7)]
    cells = [[r, c, r + c / 4 + 1] for r in range(n) for c in range(7) if (r + c) % 3]
    data = [[next((v for a, b, v in cells if (a, b) == (r, c)), 0) for c in range(7)] for r in range(n)] if dense else cells
    doc = {"id": "x, [y]", "format": "1.0.0", "format_url": "u", "type": "OTU table", "generated_by": 'me, "you"', "date": "2024-01-02", "notes": {"a": [1, 2, {"data": [3, 4]}], "b": "]"},
           "columns": columns, "data": data, "shape": [n, 7], "more": [], "rows": rows, "matrix_type": "dense" if dense else "sparse", "matrix_element_type": "float"}
    return json.dumps(doc, indent=indent, ensure_ascii=False)


@pytest.fixture
def blocks_of(spark, monkeypatch):
    """Documents are read in parts, from blocks of so many bytes."""

    def use(n, local=True):
        monkeypatch.setattr(json_parts, "ONE_TASK_BYTES", 0)
        monkeypatch.setattr(json_parts, "BLOCK_BYTES", n)
        if not local:
            monkeypatch.setattr(json_parts, "local_path", lambda path: None)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize(("dense", "indent", "block", "local"), [(False, None, 997, True), (False, 1, 1500, False), (True, None, 601, False), (True, 2, 3000, True)])
def test_json_in_parts(spark, tmp_path, blocks_of, dense, indent, block, local):
    path, text = str(tmp_path / "t.json"), _document(dense, indent)
    Path(path).write_text(text, encoding="utf-8")
    whole = read_json(spark, path)
    expected = [sorted(map(str, f.collect())) for f in (whole.cells, whole.obs, whole.samp)]
    blocks_of(block, local)
    parts = json_parts.read_parts(spark, path)
    assert parts.sizes == {k: len(v) for k, v in json.loads(text).items() if k in json_parts.LISTS}
    assert json.loads(parts.text) == {k: [] if k in json_parts.LISTS else v for k, v in json.loads(text).items()}
    for name in json_parts.LISTS:
        assert [json.loads(r["text"]) for r in parts.entries(name).orderBy("ord").collect()] == json.loads(text)[name]
    back = read_json(spark, path)
    assert [sorted(map(str, f.collect())) for f in (back.cells, back.obs, back.samp)] == expected and back.props == whole.props


def test_json_in_parts_that_cannot_be_read(spark, tmp_path, blocks_of):
    blocks_of(500)
    path = tmp_path / "t.json"
    path.write_text(_document(False, None)[:-1])
    with pytest.raises(ParseError):
        read_json(spark, str(path))
    path.write_text(_document(False, None).replace("[4, 0, 5.0]", "[4, 0, x]"))
    with pytest.raises(Exception, match="an entry cannot be read"):
        read_json(spark, str(path)).cells.collect()
    path.write_text('{"rows": [], "data": [ ], "columns": []}')
    assert json_parts.read_parts(spark, str(path)).sizes == dict.fromkeys(("rows", "data", "columns"), 0)


@pytest.mark.parametrize(("dense", "block", "local"), [(False, 3000, True), (True, 1800, False)])
def test_validation_in_parts(spark, tmp_path, blocks_of, monkeypatch, dense, block, local):
    """A large document is judged like a small one, but no row holds it."""
    doc = json.loads(_document(dense, None)) | {"notes": None, "data": None}
    doc["data"] = [[float(c % 3) for c in range(7)] for r in range(len(doc["rows"]))] if dense else [[r, c, r / 4] for r in range(len(doc["rows"])) for c in range(7)]
    n, data = len(doc["rows"]), doc["data"]
    put = lambda at, x: [*data[:at], x, *data[at + 1 :]]
    plain = [{"id": f"r{i}", "metadata": None} for i in range(n)]
    texts = [json.dumps(doc | x, ensure_ascii=False) for x in ({}, {"rows": [*plain[:-1], {"id": "", "metadata": None}], "type": "x"}, {"shape": [n, 8], "data": put(n // 2, [0])})]
    if not dense:
        texts += [json.dumps(doc | {"rows": plain[1:], "data": put(n // 2, [n, 0, 1.0])}), json.dumps(doc | {"data": put(n // 2, [0, 0, 1])}), json.dumps(doc | {"matrix_type": "x", "columns": 3})]
        texts += [texts[0].replace('"rows":', '"lines":'), json.dumps(doc | {"data": put(n // 2, "@")}).replace('"@"', "[0,0,1.0] [0,1,1.0]"), json.dumps(doc | {"data": put(n // 2, "@")}).replace('"@"', "")]
    wanted = [validate_text(spark, text) for text in texts]
    assert wanted[0] == [] and all(wanted[1:]) and len(wanted[1]) == 2
    blocks_of(block, local)
    monkeypatch.setattr(spec, "validate_documents", None)
    path = tmp_path / "t.json"
    for text, found in zip(texts, wanted, strict=True):
        path.write_text(text, encoding="utf-8")
        assert spec.validate_file(spark, str(path)) == found, text


@pytest.mark.parametrize("local", [True, False])
def test_changed_copy(spark, tmp_path, monkeypatch, local):
    text = ("é" * 30 + "aab") * 9 + "aa"
    (tmp_path / "a").write_text(text, encoding="utf-8")
    monkeypatch.setattr(sources_files, "BLOCK", 7)
    if not local:
        monkeypatch.setattr(sources_files, "local_path", lambda path: None)
    sources_files.copy_changed(str(tmp_path / "a"), str(tmp_path / "b"), "éaab", "aé")
    assert (tmp_path / "b").read_text(encoding="utf-8") == text.replace("éaab", "aé")
