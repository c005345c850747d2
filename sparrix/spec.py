"""Conformance of JSON tables with the format 1.0.

A document is parsed to a variant; each rule is a column over it, null where the document
keeps the rule and else a short text of what is wrong. Entries of lists are judged by
array functions, and the first fault of a list is reported with its place. All of it runs
within the JVM, in one pass and without a shuffle. The entries of a large document's lists
are rows instead, judged by many tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrix.sources.json_parts import Parts, is_large, read_parts

# The vocabulary of the format.
TABLE_TYPES = {"otu table", "pathway table", "function table", "ortholog table", "gene table", "metabolite table", "taxon table"}
MATRIX_TYPES = {"sparse", "dense"}
ELEMENT_KINDS = {"int": "BIGINT", "float": "DECIMAL|DOUBLE|FLOAT", "unicode": "STRING", "str": "STRING"}
DATE_FORMS = r"\d{4}-\d{1,2}-\d{1,2}(T\d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,6})?)?)?"

#: The column that holds the parsed document, and what the entries of its lists are judged by. These are columns of their
#: own, as each look at the document copies all of it.
DOC, SIDES, LAYOUT, WANTED = "__doc", "__sides", "__layout", "__wanted"


def _part(path: str, v: Column | None = None) -> Column:
    """What stands at a path: null if there is nothing, a null variant if there is null."""
    return F.try_variant_get(F.col(DOC) if v is None else v, path, "variant")


def _kind(v: Column) -> Column:
    """The kind of a value without the kinds within it; null for an absent one."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _text(v: Column) -> Column:
    """The value of a text; null for anything else."""
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _number(v: Column) -> Column:
    return F.when(_kind(v) == "BIGINT", F.try_variant_get(v, "$", "bigint"))


def _list(v: Column) -> Column:
    """The elements of a list; null for anything else."""
    return F.when(_kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>"))


def _is_blank(v: Column) -> Column:
    """Null, an empty text, list or object, zero or false."""
    kind = _kind(v)
    empty = F.to_json(v).isin('""', "[]", "{}", "0", "0.0", "false")
    return (kind == "VOID") | F.when(kind == "OBJECT", F.schema_of_variant(v) == "OBJECT<>").otherwise(empty)


def _first(faults: Column) -> Column:
    """The first fault of a list of (place, fault), as text."""
    bad = F.slice(F.filter(faults, lambda x: x["fault"].isNotNull()), 1, 1)
    return F.get(F.transform(bad, lambda x: F.concat(x["fault"], F.lit(" at place "), x["place"])), F.lit(0))


def _faults(entries: Column, judge: Callable[[Column], Column]) -> Column:
    return F.transform(entries, lambda e, i: F.struct(i.alias("place"), judge(e).alias("fault")))


def _among(known: set[str] | dict[str, str]) -> Callable[[Column], Column]:
    return lambda v: F.when(~F.coalesce(_text(v).isin(*sorted(known)), F.lit(False)), F.lit("not one of the known ones"))


def _filled(v: Column) -> Column:
    return F.when(_is_blank(v), F.lit("has no content"))


def _known_type(v: Column) -> Column:
    return F.when(_is_blank(v), F.lit("has no content")).when(~F.coalesce(F.lower(_text(v)).isin(*sorted(TABLE_TYPES)), F.lit(False)), F.lit("not one of the known ones"))


def _dated(v: Column) -> Column:
    text = _text(v)
    day = F.regexp_extract(text, r"^(\d+-\d+-\d+)", 1)
    clock = F.transform(F.split(F.regexp_extract(text, r"T([\d:]+)", 1), ":"), lambda x: F.try_variant_get(F.try_parse_json(F.regexp_replace(x, "^0+(?=.)", "")), "$", "int"))
    late = F.coalesce((F.get(clock, F.lit(0)) > 23) | (F.coalesce(F.get(clock, F.lit(1)), F.lit(0)) > 59) | (F.coalesce(F.get(clock, F.lit(2)), F.lit(0)) > 61), F.lit(False))
    good = F.coalesce(text.rlike(f"^{DATE_FORMS}$"), F.lit(False)) & F.try_to_date(day, "y-M-d").isNotNull() & ~late
    return F.when(~good, F.lit("no ISO date"))


def _sides(v: Column) -> Column:
    """The numbers of rows and columns; null if it is not two whole numbers from 0."""
    both = F.transform(_list(v), _number)
    return F.when((F.size(both) == 2) & F.forall(both, lambda n: F.coalesce(n >= 0, F.lit(False))), both)


def _shape(v: Column) -> Column:
    return F.when(_sides(v).isNull(), F.lit("not two whole numbers"))


def _id_fault(entry: Column) -> Column:
    """What is wrong with an entry of an axis."""
    id_, md = _part("$.id", entry), _part("$.metadata", entry)
    return (
        F.when(_kind(entry) != "OBJECT", F.lit("no object"))
        .when(id_.isNull(), F.lit("no id"))
        .when(md.isNull(), F.lit("no metadata"))
        .when(_is_blank(id_), F.lit("empty id"))
        .when(~_kind(md).isin("VOID", "OBJECT"), F.lit("metadata of another kind"))
    )


def _axis(side: int) -> Callable[[Column], Column]:
    def rule(v: Column) -> Column:
        wanted = F.get(SIDES, F.lit(side))
        other = F.size(_list(v)) != wanted
        return F.when(_list(v).isNull(), F.lit("no list")).otherwise(
            F.coalesce(_first(_faults(_list(v), _id_fault)), F.when(other, F.concat(F.size(_list(v)).cast("string"), F.lit(" entries where shape has "), wanted)))
        )

    return rule


def _cell_fault(sides: Column, layout: Column, wanted: Column) -> Callable[[Column], Column]:
    """What is wrong with an entry of the data of a document that names these."""
    good = lambda x: F.coalesce(F.concat(F.lit("|"), F.element_at(kinds, wanted), F.lit("|")).contains(F.concat(F.lit("|"), _kind(x), F.lit("|"))), F.lit(False))
    kinds = F.create_map(*[F.lit(x) for pair in ELEMENT_KINDS.items() for x in pair])
    rows, columns = F.get(sides, F.lit(0)), F.get(sides, F.lit(1))

    def triple(entry: Column) -> Column:
        e = _list(entry)
        r, c = _number(F.get(e, F.lit(0))), _number(F.get(e, F.lit(1)))
        return (
            F.when(e.isNull() | (F.size(e) != 3), F.lit("no triple"))
            .when(r.isNull() | c.isNull(), F.lit("no whole coordinate"))
            .when(~good(F.get(e, F.lit(2))), F.lit("value of another kind"))
            .when((r < 0) | (r >= rows), F.lit("row out of bounds"))
            .when((c < 0) | (c >= columns), F.lit("column out of bounds"))
        )

    def vector(entry: Column) -> Column:
        e = _list(entry)
        return F.when(e.isNull(), F.lit("no list")).when(F.size(e) != columns, F.lit("row of another length")).when(~F.forall(e, good), F.lit("value of another kind"))

    return lambda entry: F.when(layout == "sparse", triple(entry)).otherwise(vector(entry))


def _data(v: Column) -> Column:
    """Cells in the layout, kind and bounds that the document names."""
    sides, layout, wanted = F.col(SIDES), F.col(LAYOUT), F.col(WANTED)
    whole = F.when((layout != "sparse") & (F.size(_list(v)) != F.get(sides, F.lit(0))), F.lit("another number of rows"))
    known = sides.isNotNull() & layout.isin(*sorted(MATRIX_TYPES)) & wanted.isin(*sorted(ELEMENT_KINDS))
    judged = F.coalesce(_first(_faults(_list(v), _cell_fault(sides, layout, wanted))), whole)
    return F.when(~F.coalesce(known, F.lit(False)), F.lit("cannot be judged")).when(_list(v).isNull(), F.lit("no list")).otherwise(judged)


def _version(version: str) -> Callable[[Column], Column]:
    escaped = version.replace(".", "[.]")
    return lambda v: F.when(~F.coalesce(_text(v).rlike(f"^([A-Za-z][A-Za-z ]* )?{escaped}$"), F.lit(False)), F.lit(f"not version {version}"))


@dataclass(frozen=True)
class Rule:
    """A required field and what is wrong with its value, null if nothing is."""

    field: str
    fault: Callable[[Column], Column]


def rules(version: str = "1.0.0") -> list[Rule]:
    anything = lambda v: F.lit(None).cast("string")
    return [
        Rule("id", anything), Rule("format", _version(version)), Rule("format_url", _filled), Rule("type", _known_type), Rule("generated_by", _filled), Rule("date", _dated),
        Rule("matrix_type", _among(MATRIX_TYPES)), Rule("matrix_element_type", _among(ELEMENT_KINDS)), Rule("shape", _shape),
        Rule("rows", _axis(0)), Rule("columns", _axis(1)), Rule("data", _data),
    ]


def _documents(df: DataFrame, key: str, body: str) -> DataFrame:
    """The documents, parsed."""
    docs = df.select(F.col(key).alias("__key"), F.try_parse_json(body).alias(DOC))
    return docs.select("__key", DOC, _sides(_part("$.shape")).alias(SIDES), _text(_part("$.matrix_type")).alias(LAYOUT), _text(_part("$.matrix_element_type")).alias(WANTED))


def _broken(version: str) -> Column:
    """The rules that a document breaks, with their messages."""
    found = []
    for rule in rules(version):
        v = _part(f"$.{rule.field}")
        found.append(F.struct(F.lit(rule.field).alias("rule"), F.when(v.isNull(), F.lit("missing")).otherwise(rule.fault(v)).alias("message")))
    unread = F.array(F.struct(F.lit("json").alias("rule"), F.lit(NO_JSON).alias("message")))
    return F.when(F.coalesce(_kind(F.col(DOC)), F.lit("")) != "OBJECT", unread).otherwise(F.filter(F.array(*found), lambda x: x["message"].isNotNull()))


#: What is said of a text that is no document.
NO_JSON = "no JSON object"


def validate_documents(df: DataFrame, key: str, body: str, version: str = "1.0.0") -> DataFrame:
    """``key``, ``rule``, ``message``: what is wrong with each document; no row for a valid one.

    A null text, one that is no JSON and JSON that is no object break the rule ``json``.
    """
    docs = _documents(df, key, body)
    return docs.select("__key", F.explode(_broken(version)).alias("x")).select(F.col("__key").alias(key), "x.rule", "x.message")


def validate_text(spark: SparkSession, text: str | None, version: str = "1.0.0") -> list[tuple[str, str]]:
    """``(rule, message)`` of each rule that one document breaks."""
    one = spark.createDataFrame([(0, text)], "k int, body string")
    return [(r["rule"], r["message"]) for r in validate_documents(one, "k", "body", version).collect()]


def validate_file(spark: SparkSession, path: str, version: str = "1.0.0") -> list[tuple[str, str]]:
    """The same of a file; the lists of a large document are read in parts."""
    if is_large(path) and (parts := read_parts(spark, path, every=True)):
        return _validate_parts(spark, parts, version)
    one = spark.read.text(path, wholetext=True).select(F.lit(0).alias("k"), F.col("value").alias("body"))
    return [(r["rule"], r["message"]) for r in validate_documents(one, "k", "body", version).collect()]


#: Numbers of a kind that are read without a parser, and ids without metadata.
PLAIN = {"int": r"-?(?:0|[1-9]\d{0,17})", "float": r"-?(?:0|[1-9]\d{0,17})\.\d{1,15}"}
PLAIN_ID = r"""^\s*\{\s*"id"\s*:\s*"[^"\\\x00-\x1f]+"\s*,\s*"metadata"\s*:\s*null\s*\}\s*\z""".replace(r"\s", r"[ \t\r\n]")


def _is_plain(sides: list[int | None], layout: str | None, wanted: str | None) -> Column:
    """Whether an entry, by its text, is one of the many that no rule finds fault with; the others are parsed."""
    plain = F.col("list").isin("rows", "columns") & F.col("text").rlike(PLAIN_ID)
    if layout == "sparse" and wanted in PLAIN and None not in sides:
        place = r"(0|[1-9]\d{0,8})"
        triple = rf"^\s*\[\s*{place}\s*,\s*{place}\s*,\s*{PLAIN[wanted]}\s*\]\s*\z".replace(r"\s", r"[ \t\r\n]")
        within = [F.coalesce(F.regexp_extract("text", triple, i + 1).try_cast("bigint") < n, F.lit(False)) for i, n in enumerate(sides)]
        plain = plain | (F.col("list") == "data") & within[0] & within[1]
    return plain


def _validate_parts(spark: SparkSession, parts: Parts, version: str) -> list[tuple[str, str]]:
    """The document without the entries of its lists is judged as any other, the entries each by itself."""
    docs = _documents(spark.createDataFrame([(0, parts.text)], "k int, body string"), "k", "body")
    head = docs.select(SIDES, LAYOUT, WANTED, _broken(version).alias("broken")).first()
    found = {x["rule"]: x["message"] for x in head["broken"]}
    if "json" in found:
        return [("json", NO_JSON)]
    sides, layout, wanted = head[SIDES] or [None, None], head[LAYOUT], head[WANTED]
    cell = _cell_fault(F.array(*[F.lit(n).cast("bigint") for n in sides]), F.lit(layout).cast("string"), F.lit(wanted).cast("string"))
    judge = lambda e: F.when(F.col("list").isin("rows", "columns"), _id_fault(e)).when(F.col("list") == "data", cell(e))
    entries = parts.entries(*parts.sizes).where(~_is_plain(sides, layout, wanted))
    # brackets around an entry, as a parser does not look behind the end of a value
    judged = F.transform(_list(F.try_parse_json(F.concat(F.lit("["), "text", F.lit("]")))), lambda e: F.struct(judge(e).alias("fault")))
    judged = entries.select("list", "ord", F.get(judged, F.lit(0)).alias("x")).select("list", "ord", F.when(F.col("x").isNull(), F.lit(NO_JSON)).otherwise(F.col("x.fault")).alias("fault"))
    first = judged.groupBy("list").agg(F.min(F.when(F.col("fault").isNotNull(), F.struct("ord", "fault"))).alias("x"), F.coalesce(F.max(F.col("fault") == NO_JSON), F.lit(False)).alias("unread")).collect()
    if any(r["unread"] for r in first):
        return [("json", NO_JSON)]
    places = {r["list"]: f"{r['x']['fault']} at place {r['x']['ord']}" for r in first if r["x"]}
    for name, size in parts.sizes.items():
        if name not in ("rows", "columns", "data") or found.get(name) in ("missing", "no list", "cannot be judged"):
            continue
        side = sides[name == "columns"]
        if name == "data":
            other = "another number of rows" if layout != "sparse" and size != side else None
        else:
            other = f"{size} entries where shape has {side}" if side is not None and size != side else None
        found[name] = places.get(name, other)
    return [(rule.field, found[rule.field]) for rule in rules(version) if found.get(rule.field)]


#: What an HDF5 table must hold: attributes of the file; groups and data sets of an axis.
ATTRIBUTES = ("id", "type", "format-url", "format-version", "generated-by", "creation-date", "shape", "nnz")
MEMBERS = ("ids", "metadata", "group-metadata", "matrix", "matrix/data", "matrix/indices", "matrix/indptr")
VERSIONS = {(2, 0), (2, 1)}


def validate_hdf5(path: str) -> list[tuple[str, str]]:
    """``(rule, message)`` of what an HDF5 table lacks or holds wrongly.

    Version 2.0 has no group metadata, and its metadata may be one data set of an axis;
    from 2.1 on, metadata is a group with a data set of one row for each id.
    """
    from sparrix.sources.hdf5 import _h5py, text

    with _h5py().File(path, "r") as f:
        version = tuple(int(x) for x in f.attrs.get("format-version", ()))
        out = [(name, "missing") for name in ATTRIBUTES if name not in f.attrs]
        if version not in VERSIONS:
            return [*out, ("format-version", "not one of the known ones")]
        sizes = dict(zip(("observation", "sample"), f.attrs.get("shape", ()), strict=False))
        for axis in ("observation", "sample"):
            group = f.get(axis, {})
            out += [(f"{axis}/{m}", "missing") for m in MEMBERS if m not in group and not (version == (2, 0) and m == "group-metadata")]
            ids = len(group["ids"]) if "ids" in group else 0
            if "ids" in group and axis in sizes and ids != sizes[axis]:
                out.append((f"{axis}/ids", f"{ids} entries where shape has {sizes[axis]}"))
            metadata = group.get("metadata", {})
            for name in metadata if version != (2, 0) and hasattr(metadata, "keys") else ():
                if len(metadata[name]) != ids:
                    out.append((f"{axis}/metadata/{name}", f"{len(metadata[name])} entries for {ids} ids"))
            if "nnz" in f.attrs and "matrix/data" in group and not 0 <= int(f.attrs["nnz"]) == len(group["matrix/data"]):
                out.append(("nnz", f"not the number of values of {axis}/matrix"))
        if "creation-date" in f.attrs and not _is_iso(text(f.attrs["creation-date"])):
            out.append(("creation-date", "no ISO date"))
        return out


def _is_iso(value: str) -> bool:
    from datetime import datetime

    try:
        datetime.fromisoformat(value)
        return True
    except ValueError:
        return False
