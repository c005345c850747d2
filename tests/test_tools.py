import copy
import json

import pytest
from pyspark.sql import functions as F

from sparrix import cli
from sparrix.config import load_settings, parse_settings
from sparrix.errors import ErrorProfile, TableError, errcheck, errstate, geterr, seterr
from sparrix.sources import read_matrix, write_matrix
from sparrix.spec import validate_documents, validate_text
from sparrix.streaming.ingest import append_batches, appended_cells, first_sent, running_cells, windowed_totals
from tests.helpers import dense, ids, make

DOC = {
    "id": None, "format": "1.0.0", "format_url": "http://format.example", "type": "OTU table", "generated_by": "tests", "date": "2011-12-19T19:00:00",
    "matrix_type": "sparse", "matrix_element_type": "int", "shape": [2, 3],
    "rows": [{"id": "r1", "metadata": None}, {"id": "r2", "metadata": {}}], "columns": [{"id": f"c{i}", "metadata": None} for i in range(3)], "data": [[0, 0, 1], [1, 2, 5]],
}


@pytest.mark.parametrize(
    ("change", "rule"),
    [
        ({}, None), ({"format": "Some Table Format 1.0.0"}, None), ({"format": "0.9"}, "format"), ({"format_url": ""}, "format_url"), ({"type": "other"}, "type"), ({"type": None}, "type"),
        ({"generated_by": ""}, "generated_by"), ({"date": "yesterday"}, "date"), ({"date": "2011-12-19"}, None), ({"matrix_type": "x"}, "matrix_type"), ({"matrix_element_type": "x"}, "matrix_element_type"),
        ({"shape": [2, "3"]}, "shape"), ({"shape": [3, 3]}, "rows"), ({"rows": [{"id": "r1"}, {"id": "r2", "metadata": None}]}, "rows"), ({"columns": [{"id": "", "metadata": None}] * 3}, "columns"),
        ({"data": [[0, 0]]}, "data"), ({"data": [[0, 3, 1]]}, "data"), ({"data": [[-1, 0, 1]]}, "data"), ({"data": [[0.5, 0, 1]]}, "data"), ({"data": [[0, 0, 1.5]]}, "data"), ({"data": 3}, "data"),
        ({"matrix_type": "dense", "data": [[1, 0, 0], [0, 0, 5]]}, None), ({"matrix_type": "dense", "data": [[1, 0], [0, 0]]}, "data"), ({"matrix_type": "dense", "data": [[1, 0, 0]]}, "data"),
    ],
)
def test_rules(spark, change, rule):
    found = [r for r, _ in validate_text(spark, json.dumps(copy.deepcopy(DOC) | change))]
    assert (rule in found) if rule else not found


def test_missing_fields_and_bad_text(spark):
    for key in DOC:
        assert (key, "missing") in validate_text(spark, json.dumps({k: v for k, v in DOC.items() if k != key}))
    for text in ("{", "[]", "", None, "3"):
        assert validate_text(spark, text) == [("json", "no JSON object")]
    df = spark.createDataFrame([(1, json.dumps(DOC), 3), (2, "x", 3), (3, None, 3)], "k int, body string, rule int")
    assert {(r["k"], r["rule"]) for r in validate_documents(df, "k", "body").collect()} == {(2, "json"), (3, "json")}
    assert validate_documents(df.limit(0), "k", "body").count() == 0


def test_first_fault_and_its_place(spark):
    def found(**change):
        return validate_text(spark, json.dumps(DOC | change))

    assert found(data=[[0, 0, 1], [0, 1], [9, 9, 9]]) == [("data", "no triple at place 1")]
    assert found(rows=[{"id": "r1", "metadata": None}, None]) == [("rows", "no object at place 1")]
    assert found(rows=[{"id": "r1", "metadata": []}, {"id": "r2", "metadata": None}]) == [("rows", "metadata of another kind at place 0")]
    assert found(columns=DOC["columns"][:2]) == [("columns", "2 entries where shape has 3")]
    assert found(date="2011-02-30") == [("date", "no ISO date")] and found(date="2011-12-19T25:00:00") == [("date", "no ISO date")]
    assert found(matrix_element_type="float", data=[[0, 0, 1.5]]) == [] and found(matrix_element_type="str", data=[[0, 0, "a"]]) == []
    assert found(matrix_element_type="float", data=[[0, 0, 1]]) == [("data", "value of another kind at place 0")]


def test_error_profile(capsys):
    seen = []
    p = ErrorProfile()
    p.register("b", "b failed", "raise", lambda x: x > 1, callback=seen.append)
    p.register("a", "a failed", "warn", lambda x: x > 2)
    assert "a" in p and p.state == {"b": "raise", "a": "warn"}
    assert isinstance(p.test(2), TableError)
    with pytest.warns(UserWarning):
        assert p.test(3) is None  # the first by name is handled, and only that
    p.state = {"b": "call"}
    p.test(2, "b")
    assert seen == [2] and p.getcall("b") == seen.append
    p.setcall("b", print)
    p.state = {"all": "print"}
    p.test(5)
    assert "a failed" in capsys.readouterr().out
    p.unregister("a")
    for call in (lambda: p.register("b", "", "raise", bool), lambda: p.register("c", "", "odd", bool), lambda: p.unregister("a"), lambda: p.test(1, "zz"), lambda: setattr(p, "state", {"zz": "warn"})):
        with pytest.raises(KeyError):
            call()


def test_error_states(spark):
    empty = make(spark, [], [], [])
    errcheck(empty)
    with errstate(empty="raise"), pytest.raises(TableError):
        errcheck(empty)
    assert geterr()["empty"] == "ignore"
    with pytest.raises(ZeroDivisionError), errstate(empty="raise"):
        raise ZeroDivisionError
    assert geterr()["empty"] == "ignore"
    assert seterr(empty="warn")["empty"] == "ignore" and seterr(empty="ignore")["empty"] == "warn"


@pytest.fixture
def files(spark, tmp_path):
    t = make(spark, [[0, 1, 2], [3, 4, 5]], ["O1", "O2"], ["S1", "S2", "S3"], type="OTU table")
    write_matrix(t, str(tmp_path / "t.json"), "json")
    (tmp_path / "sam.txt").write_text("#SampleID\tfoo\tbar\ttax\nS1\t1\t2.5\ta;b\nS9\t3\tx\tc\nS2\tno\t1\td\n")
    (tmp_path / "ids.txt").write_text("# ids\nS1\tmore\nS3\n")
    return tmp_path


def test_commands(spark, files, capsys):
    j = str(files / "t.json")
    out = lambda name: str(files / name)
    cli.summarize_table(spark, j, out("s.txt"))
    assert "Num samples: 3" in (files / "s.txt").read_text()
    cli.add_metadata(spark, j, out("md.json"), sample_metadata_fp=out("sam.txt"), sc_separated="tax", int_fields="foo", float_fields="bar")
    with_md = read_matrix(spark, out("md.json"))
    first = with_md.samp.orderBy("ord").first()["md"]
    assert first["tax"] == ["a", "b"] and str(first["foo"]) == "1"
    cli.export_metadata(spark, out("md.json"), out("exported.tsv"))
    assert (files / "exported.tsv").read_text().splitlines()[1].startswith("S1\t")
    cli.convert(spark, j, out("t.tsv"), to_tsv=True)
    assert dense(read_matrix(spark, out("t.tsv"))) == [[0, 1, 2], [3, 4, 5]]
    cli.convert(spark, out("t.tsv"), out("folder"), to_parquet=True, table_type="Gene table")
    assert read_matrix(spark, out("folder")).props.type == "Gene table"
    cli.subset_table(spark, "sample", out("ids.txt"), out("sub.json"), input_json_fp=j)
    assert ids(read_matrix(spark, out("sub.json"))) == ["S1", "S3"]
    cli.normalize_table(spark, j, out("n.json"), relative_abund=True)
    assert dense(read_matrix(spark, out("n.json")))[0][1] == 0.2
    cli.normalize_table(spark, j, out("p.json"), presence_absence=True)
    assert dense(read_matrix(spark, out("p.json"))) == [[0, 1, 1], [1, 1, 1]]
    capsys.readouterr()
    cli.head(spark, j, n_obs=1, n_samp=2)
    assert "O1\t0.0\t1.0" in capsys.readouterr().out
    cli.table_ids(spark, j, observations=True)
    assert capsys.readouterr().out == "O1\nO2\n"
    (files / "clusters.uc").write_text("S\t0\t1\t*\t*\t*\t*\t*\ts1_1\t*\nH\t0\t1\t*\t*\t*\t*\t*\ts2_2\ts1_1\n")
    (files / "rep.fna").write_text(">otu s1_1\nACGT\n")
    cli.from_uc(spark, out("clusters.uc"), out("uc.json"), out("rep.fna"))
    assert ids(read_matrix(spark, out("uc.json")), "observation") == ["otu"]
    assert "pyspark" in cli.show_install_info()
    (files / "doc.json").write_text(json.dumps(DOC))
    assert cli.validate_table(spark, out("doc.json")) == 0
    (files / "bad.json").write_text(json.dumps(DOC | {"shape": [9, 9]}))
    assert cli.validate_table(spark, out("bad.json")) == 1


def test_command_errors(spark, files):
    j = str(files / "t.json")
    for call in (
        lambda: cli.add_metadata(spark, j, "x"), lambda: cli.convert(spark, j, "x"), lambda: cli.convert(spark, j, "x", to_json=True, to_tsv=True),
        lambda: cli.normalize_table(spark, j, "x"), lambda: cli.normalize_table(spark, j, "x", True, True), lambda: cli.head(spark, j, n_obs=0), lambda: cli.subset_table(spark, "sample", "i", "x"),
    ):
        with pytest.raises(ValueError):
            call()
    assert cli.main(["show-install-info"]) == 0
    assert set(cli._arguments()._subparsers._group_actions[0].choices) == {
        "summarize-table", "add-metadata", "export-metadata", "convert", "show-install-info", "subset-table", "normalize-table", "head", "table-ids", "validate-table", "from-uc",
    }


def test_streaming(spark, tmp_path):
    schema = "cell_id long, obs_id string, samp_id string, value double, loaded_at timestamp"
    rows = spark.sql(
        "SELECT * FROM VALUES (1L,'o','s',2D,timestamp'2024-01-01'), (2L,'o','s',3D,timestamp'2024-01-02'), (1L,'o','s',2D,timestamp'2024-01-03'), (3L,'p','s',1D,timestamp'2024-01-03') AS t(cell_id,obs_id,samp_id,value,loaded_at)"
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    assert {r["obs_id"]: r["value"] for r in run(running_cells(stream()), "complete", "running").collect()} == {"o": 7.0, "p": 1.0}
    assert run(first_sent(stream(), "cell_id", "loaded_at"), "append", "once").count() == 3
    assert run(windowed_totals(stream(), "loaded_at"), "update", "windows").where("total is not null").agg(F.sum("n")).first()[0] == 4
    for _ in range(2):  # a second run finds nothing new
        append_batches(stream(), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert {r["obs_id"]: r["value"] for r in appended_cells(spark, str(tmp_path / "out")).collect()} == {"o": 7.0, "p": 1.0}


def test_settings(tmp_path, monkeypatch):
    first, second = tmp_path / "a", tmp_path / "b"
    first.write_text("# comment\n  one  1\n\ntwo some \t words \nalone\n  # more\nthree 3")
    second.write_text("one 2\n")
    assert parse_settings(first.read_text()) == {"one": "1", "two": "some words", "alone": None, "three": "3"}
    assert load_settings([first, tmp_path / "none", second])["one"] == "2" and load_settings([]) == {}
    monkeypatch.setenv("SPARRIX_CONFIG", str(second))
    monkeypatch.setenv("HOME", str(tmp_path))
    (tmp_path / ".sparrix_config").write_text("home yes")
    assert load_settings() == {"one": "2", "home": "yes"}
