"""Command line: ``python -m sparrix.cli COMMAND``. Paths are local files, or Parquet folders."""

from __future__ import annotations

import argparse
import json
import platform
import sys
from collections.abc import Sequence
from importlib import metadata as packages

from pyspark.sql import functions as F

from sparrix import __version__
from sparrix.core import TABLE_TYPES
from sparrix.functions.scalar import float_or_text, int_or_text, join_list, split_list, split_nested
from sparrix.runtime import local_session
from sparrix.sources import read_matrix, write_matrix
from sparrix.sources.files import blocks, text_file
from sparrix.sources.long import read_fasta_names, read_mapping, read_uc
from sparrix.sources.tsv import to_tsv

PROCESS = {"naive": lambda c: c, "sc_separated": split_list, "taxonomy": split_list}
FORMATTERS = {"naive": lambda c: c.cast("string"), "sc_separated": lambda c: join_list(c)}


def _emit(text: str, path: str | None) -> None:
    if path:
        with text_file(path) as out:
            out.text(text + "\n")
    else:
        print(text)


def summarize_table(spark, input_fp: str, output_fp: str | None = None, qualitative: bool = False, observations: bool = False) -> None:
    table = read_matrix(spark, input_fp)
    _emit(table.summary_text(qualitative, "observation" if observations else "sample"), output_fp)


def add_metadata(
    spark, input_fp: str, output_fp: str, sample_metadata_fp: str | None = None, observation_metadata_fp: str | None = None, sc_separated: str | None = None, sc_pipe_separated: str | None = None,
    int_fields: str | None = None, float_fields: str | None = None, sample_header: str | None = None, observation_header: str | None = None, output_as_json: bool = False,
) -> None:
    if not sample_metadata_fp and not observation_metadata_fp:
        raise ValueError("sample and/or observation metadata must be given")
    kinds = ((sc_separated, split_list), (sc_pipe_separated, split_nested), (int_fields, int_or_text), (float_fields, float_or_text))
    process = {name: f for names, f in kinds for name in (names.split(",") if names else [])}
    table = read_matrix(spark, input_fp)
    for path, axis, header in ((sample_metadata_fp, "sample", sample_header), (observation_metadata_fp, "observation", observation_header)):
        if path:
            table = table.add_metadata(read_mapping(spark, path, header=header.split(",") if header else None, process=process), axis)
    write_matrix(table, output_fp, "json" if output_as_json else _format_of(output_fp))


def _format_of(path: str) -> str:
    return {"json": "json", "tsv": "tsv", "txt": "tsv", "hdf5": "hdf5", "h5": "hdf5"}.get(path.rsplit(".", 1)[-1], "parquet")


def export_metadata(spark, input_fp: str, sample_metadata_fp: str | None = None, observation_metadata_fp: str | None = None) -> None:
    table = read_matrix(spark, input_fp)
    for path, axis in ((sample_metadata_fp, "sample"), (observation_metadata_fp, "observation")):
        if path:
            columns = table.metadata_columns(axis)
            texts = [F.coalesce(F.to_json(F.col(f"`{f.name}`")) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f"`{f.name}`").cast("string"), F.lit("")) for f in columns.schema]
            order = table._axis(axis)[0].select("id", "ord")
            with text_file(path) as out:
                out.text("\t".join(["", *columns.columns[1:]]) + "\n")
                out.rows(columns.select("id", F.concat_ws("\t", *texts).alias("line")).join(order, "id"), ["ord"], "line")


def convert(
    spark, input_fp: str, output_fp: str, sample_metadata_fp: str | None = None, observation_metadata_fp: str | None = None, to_json: bool = False, to_hdf5: bool = False, to_tsv: bool = False,
    to_parquet: bool = False, collapsed_samples: bool = False, collapsed_observations: bool = False, header_key: str | None = None, output_metadata_id: str | None = None,
    table_type: str | None = None, process_obs_metadata: str | None = None, tsv_metadata_formatter: str = "naive",
) -> None:
    targets = [name for name, on in (("json", to_json), ("hdf5", to_hdf5), ("tsv", to_tsv), ("parquet", to_parquet)) if on]
    if len(targets) != 1:
        raise ValueError("exactly one output format must be given")
    table = read_matrix(spark, input_fp)
    for path, axis in ((sample_metadata_fp, "sample"), (observation_metadata_fp, "observation")):
        if path:
            table = table.add_metadata(read_mapping(spark, path), axis)
    for on, axis in ((collapsed_samples, "sample"), (collapsed_observations, "observation")):
        if on:  # metadata keyed by the original ids becomes the list of these ids
            frame, _ = table._axis(axis)
            names = F.map_keys(F.from_json(F.to_json("md"), "map<string,string>"))
            table = table._with_axis(axis, frame.withColumn("md", F.struct(names.alias("collapsed_ids"))))
    if process_obs_metadata and process_obs_metadata != "naive" and table.has_metadata("observation"):
        fields = [PROCESS[process_obs_metadata](F.col("md")[f.name]).alias(f.name) if f.dataType.typeName() == "string" else F.col("md")[f.name].alias(f.name) for f in table.obs.schema["md"].dataType]
        table = table._with_axis("observation", table.obs.withColumn("md", F.struct(*fields)))
    if table_type:
        table = table._new(type=table_type)
    options = {}
    if targets == ["tsv"]:
        options = {"header_key": header_key, "header_value": output_metadata_id}
        if header_key:
            options["formatter"] = FORMATTERS[tsv_metadata_formatter]
    write_matrix(table, output_fp, targets[0], **options)


def show_install_info(spark=None) -> str:
    lines = ["System information", "==================", f"         Platform: {sys.platform}", f"   Python version: {platform.python_version()}", "", "Dependencies", "============"]
    for name in ("pyspark", "pyarrow", "numpy", "pandas", "h5py", "anndata"):
        try:
            lines.append(f"{name:>17}: {packages.version(name)}")
        except packages.PackageNotFoundError:
            lines.append(f"{name:>17}: not installed")
    text = "\n".join([*lines, "", f"          sparrix: {__version__}"])
    print(text)
    return text


def _ids_of(path: str) -> list[str]:
    """The first field of each line; ``#`` lines are skipped."""
    text = b"".join(blocks(path)).decode("utf-8")  # a list of the caller's
    return [line.split("\t")[0] for line in text.splitlines() if line.strip() and not line.startswith("#")]


def subset_table(spark, axis: str, ids: str, output_fp: str, input_hdf5_fp: str | None = None, input_json_fp: str | None = None, input_fp: str | None = None) -> None:
    given = [(p, k) for p, k in ((input_hdf5_fp, "hdf5"), (input_json_fp, "json"), (input_fp, None)) if p]
    if len(given) != 1:
        raise ValueError("exactly one input table must be given")
    path, kind = given[0]
    if kind == "json":  # keeps the other axis whole
        from sparrix.sources.json_table import read_json, subset

        table = subset(read_json(spark, path), _ids_of(ids), axis)
    else:
        table = read_matrix(spark, path, kind, _ids_of(ids), axis)
    write_matrix(table, output_fp, kind or _format_of(output_fp))


def normalize_table(spark, input_fp: str, output_fp: str, relative_abund: bool = False, presence_absence: bool = False, axis: str = "sample") -> None:
    if relative_abund == presence_absence:
        raise ValueError("exactly one of relative abundance and presence/absence must be chosen")
    table = read_matrix(spark, input_fp)
    write_matrix(table.norm(axis) if relative_abund else table.pa(), output_fp, _format_of(output_fp))


def head(spark, input_fp: str, output_fp: str | None = None, n_obs: int = 5, n_samp: int = 5) -> None:
    if n_obs <= 0 or n_samp <= 0:
        raise ValueError("numbers must be positive")
    _emit(to_tsv(read_matrix(spark, input_fp).head(n_obs, n_samp)), output_fp)


def table_ids(spark, input_fp: str, observations: bool = False) -> None:
    for row in read_matrix(spark, input_fp).ids("observation" if observations else "sample").toLocalIterator():
        print(row["id"])


def validate_table(spark, input_fp: str, format_version: str | None = None) -> int:
    from sparrix.sources.sniff import sniff
    from sparrix.spec import validate_file, validate_hdf5

    if sniff(input_fp) == "hdf5":
        problems = validate_hdf5(input_fp)
    else:
        problems = validate_file(spark, input_fp, format_version or "1.0.0")
    for rule, message in problems:
        print(f"{rule}: {message}")
    print("The input file is a valid table." if not problems else "The input file is not a valid table.")
    return int(bool(problems))


def from_uc(spark, input_fp: str, output_fp: str, rep_set_fp: str | None = None) -> None:
    write_matrix(read_uc(spark, input_fp, read_fasta_names(spark, rep_set_fp) if rep_set_fp else None), output_fp, _format_of(output_fp))


def _arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sparrix")
    top.add_argument("--version", action="version", version=__version__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, f, *options: str) -> None:
        """Options end in ``!`` if required, in ``?`` if they are flags, in ``#`` if numbers."""
        p = commands.add_parser(name, help=(f.__doc__ or "").strip() or None)
        p.set_defaults(run=f)
        for o in options:
            short, _, long = o.rstrip("!?#").rpartition("/")
            flags = [f"-{short}"] * bool(short) + [f"--{long}"]
            if o[-1] == "?":
                p.add_argument(*flags, action="store_true")
            else:
                p.add_argument(*flags, required=o[-1] == "!", default=argparse.SUPPRESS, type=int if o[-1] == "#" else str)

    command("summarize-table", summarize_table, "i/input-fp!", "o/output-fp", "qualitative?", "observations?")
    command("add-metadata", add_metadata, "i/input-fp!", "o/output-fp!", "m/sample-metadata-fp", "observation-metadata-fp", "sc-separated", "sc-pipe-separated", "int-fields", "float-fields", "sample-header", "observation-header", "output-as-json?")
    command("export-metadata", export_metadata, "i/input-fp!", "m/sample-metadata-fp", "observation-metadata-fp")
    command("convert", convert, "i/input-fp!", "o/output-fp!", "m/sample-metadata-fp", "observation-metadata-fp", "to-json?", "to-hdf5?", "to-tsv?", "to-parquet?", "collapsed-samples?", "collapsed-observations?", "header-key", "output-metadata-id", "table-type", "process-obs-metadata", "tsv-metadata-formatter")
    command("show-install-info", show_install_info)
    command("subset-table", subset_table, "i/input-hdf5-fp", "j/input-json-fp", "input-fp", "a/axis!", "s/ids!", "o/output-fp!")
    command("normalize-table", normalize_table, "i/input-fp!", "o/output-fp!", "r/relative-abund?", "p/presence-absence?", "a/axis")
    command("head", head, "i/input-fp!", "o/output-fp", "n/n-obs#", "m/n-samp#")
    command("table-ids", table_ids, "i/input-fp!", "observations?")
    command("validate-table", validate_table, "i/input-fp!", "f/format-version")
    command("from-uc", from_uc, "i/input-fp!", "o/output-fp!", "rep-set-fp")
    return top


def main(argv: Sequence[str] | None = None) -> int:
    options = vars(_arguments().parse_args(argv))
    run, name = options.pop("run"), options.pop("command")
    if options.get("table_type") not in (None, *TABLE_TYPES):
        raise ValueError(f"unknown table type; one of {json.dumps(TABLE_TYPES)}")
    spark = None if name == "show-install-info" else local_session()
    try:
        result = run(spark, **options)
    except BrokenPipeError:
        return 0
    return result if isinstance(result, int) else 0



if __name__ == "__main__":
    sys.exit(main())
