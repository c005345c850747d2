"""Schemas that drift between files: changes from file to file, and one common table.

Each file of a producer is profiled by column: its kinds, and for columns gone or new a
sketch of their values, the least hashes of (table, value). Between a file and the next of
the same producer, columns gone are matched with columns new as a bipartite assignment
over the sketches: a pair may be matched only if its values agree in all tables that both
have; the weight is the number that agree, name similarity decides between equal weights.
A sketch that holds all values of its column decides by itself; where one is cut off, the
pairs it does not refute are compared in all values before they are matched. All other
columns gone or new are removed or added.

To bring all files into one table, each column is followed back through the renames to its
name in the producer's first file that has it; these names are matched, again as an
assignment, with the target columns by name similarity and value sketch. Names that no
target takes are matched with each other over all producers, and each meaning so found
gets a column of its own. Values are sketched once, by file and field; all other sketches
are merged from these.

Edge cases: a record without a table id or with a body that is no JSON object has no
fields; records sent again count once; a file whose predecessor is missing is compared
with none; a field that is null throughout has no kind and is never renamed or retyped;
lists are leaves, empty objects have none; files of a producer may arrive in any order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrix.operators.nested import leaf_table
from sparrix.runtime import materialize

#: Hashes kept of a column's values.
SKETCH = 64
#: Kinds of values, as bits.
KINDS = {"string": 1, "number": 2, "boolean": 4, "array": 8}
#: Stands between an origin's name and the file it starts in, where the name alone is taken.
MARK = "\0"
#: Least weight at which a producer's column is taken for a target column.
LEAST_WEIGHT = 0.3


def header_fields(headers: DataFrame, body: str = "body") -> DataFrame:
    """``producer``, ``file_no``, ``rec_id``, ``table_id``, ``field``, ``kind``, ``value``: the leaves of all headers.

    Records sent again repeat their leaves, which changes no result.
    """
    return leaf_table(headers, ["producer", "file_no", "rec_id", "table_id"], body)


def kind_bits(kind: Column) -> Column:
    out = F.lit(0)
    for name, bit in KINDS.items():
        out = F.when(kind == name, F.lit(bit)).otherwise(out)
    return out


def profiles(fields: DataFrame) -> DataFrame:
    """``producer``, ``file_no``, ``field``, ``kinds``: one row for each column of each file."""
    return fields.groupBy("producer", "file_no", "field").agg(F.bit_or(kind_bits(F.col("kind"))).alias("kinds"))


def _least(rows: DataFrame, by: list[str], n: int, *order: str) -> DataFrame:
    """The first ``n`` rows of each group; tasks drop what is beyond before they shuffle."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.select("*", nth.alias("nth")).where(F.col("nth") <= n).drop("nth")


def value_sketches(fields: DataFrame, by: list[str]) -> DataFrame:
    """``by``, ``sketch``: the least ``SKETCH`` hashes of a column's distinct values."""
    h = F.xxhash64("kind", F.lower(F.regexp_replace("value", "[^A-Za-z0-9.]", ""))).alias("h")
    hashes = fields.where(F.col("kind") != "null").select(*by, h).distinct()
    return _least(hashes, by, SKETCH, "h").groupBy(*by).agg(F.collect_set("h").alias("sketch"))


def merged_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of unions: the least hashes of the sketches of their parts."""
    hashes = sketches.select(*by, F.explode("sketch").alias("h")).distinct()
    return _least(hashes, by, SKETCH, "h").groupBy(*by).agg(F.collect_set("h").alias("sketch"))


@lru_cache(1 << 14)
def name_tokens(name: str) -> set[str]:
    """The words of a field name, in any of the usual spellings."""
    return {x.lower() for x in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)}


@lru_cache(1 << 16)
def name_similarity(a: str, b: str) -> float:
    """Mean of the overlap of words and of letter pairs; 1 for names that differ in spelling only."""

    def overlap(x: set[str], y: set[str]) -> float:
        return len(x & y) / len(x | y) if x | y else 0.0

    plain = ["".join(sorted(name_tokens(x))) for x in (a, b)]
    if plain[0] == plain[1]:
        return 1.0
    joined = [re.sub(r"[^a-z0-9]", "", x.lower()) for x in (a, b)]
    return (overlap(name_tokens(a), name_tokens(b)) + overlap(*({x[i : i + 2] for i in range(len(x) - 1)} for x in joined))) / 2


def assign(weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns with the largest sum of weights; pairs of no weight are left out.

    The assignment problem by shortest augmenting paths over a square matrix; where no two
    rows have their largest weight in one column, these are the best there can be.
    """
    rows, columns = weights.shape
    best = weights.argmax(axis=1) if weights.size else np.zeros(0, int)
    found = [(i, int(j)) for i, j in enumerate(best) if weights[i, j] > 0]
    if len({j for _, j in found}) == len(found):
        return found
    n = max(rows, columns)
    cost = np.zeros((n + 1, n + 1))
    cost[1 : rows + 1, 1 : columns + 1] = -weights
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    match, way = np.zeros(n + 1, int), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            now = cost[i0] - u[i0] - v
            better = ~used & (now < least)
            better[0] = False
            least[better], way[better] = now[better], j0
            free = np.where(used, np.inf, least)
            free[0] = np.inf
            j1 = int(np.argmin(free))
            delta = free[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return [(match[j] - 1, j - 1) for j in range(1, columns + 1) if 1 <= match[j] <= rows and weights[match[j] - 1, j - 1] > 0]


def compared(old: dict[int, set[int]], new: dict[int, set[int]], upto: int | None) -> tuple[int, bool]:
    """How many tables of two sketches agree, and whether none differs; hashes beyond ``upto`` are in one of them only."""
    agree = 0
    for h in old.keys() & new.keys():
        if upto is not None and h > upto:
            continue
        if len(old[h]) > 1 or old[h] != new[h]:
            return 0, False
        agree += 1
    return agree, True


def _edges(size: int):
    """From the sketches of columns gone and new, sorted by file, to the pairs that they do not refute."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _files(batches):
            columns: dict[bool, dict[str, tuple[dict[int, set[int]], int | None]]] = {False: {}, True: {}}
            for is_new, name, hashes, values in zip(*(group[c] for c in ("is_new", "field", "hashes", "values")), strict=True):
                tables: dict[int, set[int]] = {}
                for h, v in zip(hashes, values, strict=True):
                    tables.setdefault(h, set()).add(v)
                # one more than a sketch holds was kept to know that it is cut off
                columns[is_new][name] = (tables, sorted(hashes)[size - 1] - 1 if len(hashes) > size else None)
            out = []
            for a, (old, old_end) in sorted(columns[False].items()):
                for b, (new, new_end) in sorted(columns[True].items()):
                    ends = [x for x in (old_end, new_end) if x is not None]
                    agree, same = compared(old, new, min(ends, default=None))
                    if same and (agree or ends):
                        out.append((a, b, agree, not ends))
            if out:
                n = len(out)
                named = [pa.array([group[c][0]] * n, t) for c, t in (("producer", pa.string()), ("file_no", pa.int64()))]
                yield pa.record_batch([*named, *[pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int64(), pa.bool_()), strict=True)]], names=EDGE_NAMES)

    return run


EDGE_NAMES = ["producer", "file_no", "field", "new_field", "agree", "sure"]
EDGE_SCHEMA = "producer string, file_no long, field string, new_field string, agree long, sure boolean"


def _assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the edges, sorted by file, to one assignment for each pair of files."""
    for group in _files(batches):
        old, new = sorted(set(group["field"])), sorted(set(group["new_field"]))
        w = np.zeros((len(old), len(new)))
        for a, b, n in zip(group["field"], group["new_field"], group["agree"], strict=True):
            w[old.index(a), new.index(b)] = n + name_similarity(a, b) / 2
        found = [(0, 0)] if w.shape == (1, 1) else assign(w)
        n = len(found)
        named = [pa.array([group[c][0]] * n, t) for c, t in (("producer", pa.string()), ("file_no", pa.int64()))]
        yield pa.record_batch([*named, pa.array([old[i] for i, _ in found], pa.string()), pa.array([new[j] for _, j in found], pa.string())], names=EDGE_NAMES[:4])


def _files(batches: Iterator[pa.RecordBatch], by: tuple[str, ...] = ("producer", "file_no")) -> Iterator[dict[str, list]]:
    """The rows of each group, as lists by column; they come one behind the other."""
    held: dict[str, list] = {}
    for batch in batches:
        rows = batch.to_pydict()
        keys = list(zip(*(rows[c] for c in by), strict=True))
        lo = 0
        for hi in range(1, len(keys) + 1):
            if hi < len(keys) and keys[hi] == keys[lo]:
                continue
            part = {c: x[lo:hi] for c, x in rows.items()}
            if held and tuple(held[c][0] for c in by) == keys[lo]:
                held = {c: held[c] + part[c] for c in part}
            else:
                if held:
                    yield held
                held = part
            lo = hi
    if held:
        yield held


def schema_changes(fields: DataFrame) -> DataFrame:
    """``producer``, ``file_no``, ``change``, ``field``, ``new_field``: each file against the one before."""
    key = ["producer", "file_no"]
    number = fields.schema["file_no"].dataType
    columns = materialize(profiles(fields), "profiles")
    after = (F.col("file_no") + 1).cast(number).alias("file_no")
    # each column once as new in its file and once as old in the next
    none = F.lit(None).cast("int")
    sides = columns.select(*key, "field", F.col("kinds").alias("new"), none.alias("old")).unionByName(columns.select("producer", after, "field", none.alias("new"), F.col("kinds").alias("old")))
    pairs = sides.groupBy(*key, "field").agg(F.max("old").alias("old"), F.max("new").alias("new")).where("old is null or new is null or old <> new")
    files = columns.select(*key).distinct()
    pairs = materialize(pairs.join(files, key, "left_semi").join(files.select("producer", after), key, "left_semi"), "columns")
    gone = pairs.where("new is null").select(*key, "field")
    new = pairs.where("old is null").select(*key, "field")
    # sketches are needed where a file has both
    matched = gone.select(*key).distinct().join(new.select(*key).distinct(), key)
    wanted = gone.select(*key, "field", F.lit(False).alias("is_new")).unionByName(new.select(*key, "field", F.lit(True).alias("is_new"))).join(matched, key, "left_semi")
    wanted = materialize(wanted.select("*", (F.col("file_no") - F.when(F.col("is_new"), 0).otherwise(1)).cast(number).alias("of")), "wanted")
    values = fields.where("kind <> 'null' and table_id is not null").select("producer", F.col("file_no").alias("of"), "field", "table_id", "kind", "value")
    values = values.join(wanted, ["producer", "of", "field"]).select(*key, "is_new", "field", "table_id", "kind", "value")
    column = [*key, "is_new", "field"]
    hashes = values.select(*column, F.xxhash64("table_id").alias("h"), F.xxhash64("kind", "value").alias("v")).distinct()
    sketches = _least(hashes, column, SKETCH + 1, "h", "v").groupBy(*column).agg(F.collect_list(F.struct("h", "v")).alias("x"))
    sketches = sketches.select("producer", F.col("file_no").cast("long").alias("file_no"), "is_new", "field", F.col("x.h").alias("hashes"), F.col("x.v").alias("values"))
    edges = sketches.repartition(*key).sortWithinPartitions(*key).mapInArrow(_edges(SKETCH), EDGE_SCHEMA)
    edges = materialize(edges.withColumn("file_no", F.col("file_no").cast(number)), "edges")
    unsure = edges.where("not sure").select(*key, "field", "new_field")
    if not unsure.isEmpty():
        edges = edges.where("sure").select(*EDGE_NAMES[:5]).unionByName(_agreeing(values, unsure, key))
    renamed = edges.select("producer", F.col("file_no").cast("long").alias("file_no"), "field", "new_field", "agree").repartition(*key).sortWithinPartitions(*key)
    renamed = renamed.mapInArrow(_assigned, "producer string, file_no long, field string, new_field string").withColumn("file_no", F.col("file_no").cast(number))
    renamed = materialize(renamed, "renamed")
    empty = F.lit("").alias("new_field")
    parts = [
        renamed.select(*key, F.lit("renamed").alias("change"), "field", "new_field"),
        gone.join(renamed, [*key, "field"], "left_anti").select(*key, F.lit("removed").alias("change"), "field", empty),
        new.join(renamed.select(*key, F.col("new_field").alias("field")), [*key, "field"], "left_anti").select(*key, F.lit("added").alias("change"), "field", empty),
        pairs.where("old > 0 and new > 0").select(*key, F.lit("retyped").alias("change"), "field", empty),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _agreeing(values: DataFrame, pairs: DataFrame, key: list[str]) -> DataFrame:
    """Those of the pairs whose values agree in all tables both have, with the number of these, from all values."""
    values = values.select("*", F.struct("kind", "value").alias("v")).drop("kind", "value").distinct()
    old = values.where("not is_new").join(pairs, [*key, "field"]).select(*key, "field", "new_field", "table_id", "v")
    new = values.where("is_new").select(*key, F.col("field").alias("new_field"), "table_id", F.col("v").alias("w"))
    seen = old.join(new, [*key, "new_field", "table_id"])
    agree = seen.groupBy(*key, "field", "new_field").agg(F.sum(F.when(F.col("v") == F.col("w"), 1).otherwise(0)).alias("agree"), F.count("*").alias("n"))
    return agree.where("agree = n").select(*key, "field", "new_field", "agree")


def _origins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each producer, whose rows come in the order of their files, the origin of each field of each file; ``old`` is the name before a rename.

    No two fields of a file have the same origin: a name that comes back while its column
    goes on under another name starts an origin of its own, marked by the file.
    """
    for group in _files(batches, ("producer",)):
        now: dict[str, str] = {}
        origins: list[str] = []
        names, olds, numbers = group["field"], group["old"], group["file_no"]
        lo = 0
        for hi in range(1, len(numbers) + 1):
            if hi < len(numbers) and numbers[hi] == numbers[lo]:
                continue
            came = {f: old for f, old in zip(names[lo:hi], olds[lo:hi], strict=True) if old is not None}
            held = {f: now.get(old, old) for f, old in came.items()}
            for old in came.values():
                now.pop(old, None)
            held |= {f: now[f] for f in names[lo:hi] if f not in came and f in now}
            of: dict[str, str] = {}
            used: set[str] = set()
            for f in [*held, *(f for f in names[lo:hi] if f not in held)]:
                origin = held.get(f, f)
                if origin in used:
                    origin = f"{f}{MARK}{numbers[lo]}"
                used.add(origin)
                now[f] = of[f] = origin
            origins += [of[f] for f in names[lo:hi]]
            lo = hi
        yield pa.record_batch([pa.array(group["producer"], pa.string()), pa.array(numbers, pa.int64()), pa.array(names, pa.string()), pa.array(origins, pa.string())], names=["producer", "file_no", "field", "origin"])


def contained(s: set[int], m: set[int]) -> float:
    """The part of the smaller column's values that the other has, over the hashes that both sketches hold in full."""
    ends = [max(x) for x in (s, m) if len(x) >= SKETCH]
    if ends:
        s, m = ({h for h in x if h <= min(ends)} for x in (s, m))
    return len(s & m) / min(len(s), len(m)) if s and m else 0.0


def _weight(a: str, s: set[int], b: str, m: set[int]) -> float:
    """How alike two columns are by name and sketch; 0 if too little to be one."""
    a, b = a.split(MARK)[0], b.split(MARK)[0]
    weight = (name_similarity(a, b) + contained(s, m)) / 2
    return weight if weight >= LEAST_WEIGHT else 0.0


def other_meanings(sketches: dict[str, set[int]], beside: set[tuple[str, str]]) -> dict[str, str]:
    """For each name, the name of its meaning; ``sketches`` lists the most frequent first.

    A name goes to the meaning it is most alike, but to none that has a name it stands
    ``beside`` in some file.
    """
    members: dict[str, list[str]] = {}
    for name, sketch in sketches.items():
        weights = {
            m: max(_weight(name, sketch, x, sketches[x]) for x in names)
            for m, names in members.items() if not any((name, x) in beside for x in names)
        }
        best = max(weights, key=weights.get, default=name)
        members.setdefault(best if weights.get(best, 0) > 0 else name, []).append(name)
    return {x: m for m, names in members.items() for x in names}


def _column_names(meanings: list[str], taken: list[str]) -> dict[str, str]:
    """A column name for each meaning; Spark tells names apart without case."""
    used = {x.lower() for x in taken}
    out = {}
    for m in meanings:
        base = re.sub(r"\W+", "_", m.split(MARK)[0])
        name, n = base, 1
        while name.lower() in used:
            n += 1
            name = f"{base}_{n}"
        used.add(name.lower())
        out[m] = name
    return out


def _lanes(weights: np.ndarray, files: list[set[int]]) -> list[list[int]]:
    """Origins of one producer that may share a target: most alike to the same one and never in one file."""
    best = weights.argmax(axis=1) if weights.size else []
    lanes: list[tuple[int, list[int], set[int]]] = []
    for i in sorted(range(len(weights)), key=lambda i: -weights[i].max()):
        for target, members, seen in lanes:
            if weights[i].max() > 0 and target == best[i] and not seen & files[i]:
                members.append(i)
                seen |= files[i]
                break
        else:
            lanes.append((best[i] if weights[i].max() > 0 else -1, [i], set(files[i])))
    return [members for _, members, _ in lanes]


def unify(fields: DataFrame, changes: DataFrame, targets: list[str]) -> DataFrame:
    """``producer``, ``file_no``, ``rec_id``, ``table_id`` and one text column for each meaning, the targets first.

    A producer's columns are matched with the targets as an assignment; at equal weight
    the name that comes first is taken. Columns that are never in one file do not compete
    for a target, as they may be one whose rename cannot be proved. Every value is in a column: those that no target
    takes are in one of their own meaning, named by its most frequent name.
    """
    key = ["producer", "file_no", "field"]
    number = fields.schema["file_no"].dataType
    renamed = changes.where("change = 'renamed'").select("producer", "file_no", F.col("new_field").alias("field"), F.col("field").alias("old"))
    named = fields.select(*key).distinct().join(renamed, key, "left").select("producer", F.col("file_no").cast("long").alias("file_no"), "field", "old")
    origin = named.repartition("producer").sortWithinPartitions(*key).mapInArrow(_origins, "producer string, file_no long, field string, origin string")
    origin = materialize(origin.withColumn("file_no", F.col("file_no").cast(number)), "origin")
    base = materialize(value_sketches(fields, key), "sketches")
    named = materialize(origin.join(base, key, "left").select(*key, "origin", F.coalesce("sketch", F.array().cast("array<long>")).alias("sketch")), "named")
    mine = merged_sketches(named, ["producer", "origin"])
    mine = mine.join(origin.groupBy("producer", "origin").agg(F.collect_set("file_no").alias("files")), ["producer", "origin"])
    mine = materialize(mine, "mine")

    def matched_with(targets: list[str]) -> tuple[DataFrame, list[str]]:
        """``producer``, ``origin``, ``target``, and the meanings of the names that no target takes, which are targets too, marked."""
        # a target's sketch comes from the columns that bear its name everywhere
        names = [t.split(MARK)[0] for t in targets]
        model = merged_sketches(named.where(F.col("field").isin(names)).withColumn("target", F.col("field")), ["target"])
        model = {r["target"]: set(r["sketch"]) for r in model.collect()}  # as many as targets, each of SKETCH hashes

        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in _files(batches, ("producer",)):
                origins, files = group["origin"], list(map(set, group["files"]))
                sketches = list(map(set, group["sketch"]))
                w = np.array([[_weight(a, sketch, b, model.get(b, set())) for b in names] for a, sketch in zip(origins, sketches, strict=True)])
                lanes = _lanes(w, files)
                found = [(origins[i], targets[j]) for k, j in assign(np.array([w[lane].max(axis=0) for lane in lanes])) for i in lanes[k]]
                columns = [[group["producer"][0]] * len(found), [o for o, _ in found], [t for _, t in found]]
                yield pa.record_batch([pa.array(x, pa.string()) for x in columns], names=["producer", "origin", "target"])

        grouped = mine.repartition("producer").sortWithinPartitions("producer", "origin")
        matched = materialize(grouped.mapInArrow(match, "producer string, origin string, target string"), "matched")
        left = mine.select("producer", "origin").join(matched, ["producer", "origin"], "left_anti")
        files = materialize(origin.join(left, ["producer", "origin"]).select("producer", "file_no", "origin").distinct(), "left")
        # one row for each name and each pair of names: as many as there are columns to make
        pairs = files.join(files.withColumnRenamed("origin", "other"), ["producer", "file_no"]).where("origin <> other").select("origin", "other").distinct()
        beside = {(r["origin"], r["other"]) for r in pairs.collect()}
        sketches = merged_sketches(named.join(left, ["producer", "origin"], "left_semi"), ["origin"])
        sketches = sketches.join(files.groupBy("origin").count(), "origin").orderBy(F.desc("count"), "origin").collect()
        meanings = other_meanings({r["origin"]: set(r["sketch"]) for r in sketches}, beside)
        if not meanings:
            return matched, []
        known = fields.sparkSession.createDataFrame([(x, m + MARK) for x, m in meanings.items()], "origin string, target string")
        return matched.unionByName(left.join(known, "origin")), list(dict.fromkeys(meanings.values()))

    # a name with a meaning of its own elsewhere is matched with it too, not only with the targets
    matched, more = matched_with(targets)
    if more:
        matched, _ = matched_with([*targets, *more])
    found = matched.groupBy("target").count().orderBy(F.desc("count"), "target").collect()
    names = _column_names([r["target"] for r in found if r["target"] not in targets], ["producer", "file_no", "rec_id", "table_id", *targets])
    meaning = origin.join(matched, ["producer", "origin"]).select(*key, "target")
    rows = fields.join(meaning, key, "left")
    value = [F.max(F.when(F.col("target") == t, F.col("value"))).alias(c) for t, c in [*((t, t) for t in targets), *names.items()]]
    return rows.groupBy("producer", "file_no", "rec_id", "table_id").agg(*value)
