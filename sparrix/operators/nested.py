"""Deeply nested records as flat tables with parent-child links.

Every record is walked depth first. A node gets a pre-order number on the way in and a
post-order number on the way out, so that one node lies within another exactly if its
pre-order number is higher and its post-order number lower. Nodes are told apart by type,
their path with ``[]`` for a list level and ``*`` for keys that are data; each relation is
the table of one type, linked to the types above it by interval containment. The vectors
of a matrix and their entries are nodes like all others, but labelled all at once.

All of a record is labelled and linked by the task that read it, in columns for many
records at once, so nothing is shuffled.

Edge cases: a null body and one that is not JSON give no node, and a row of
``unread_records``; records may be nested to any depth; null elements give no node but
keep their place; where a list is expected, a bare element stands for a list of one; text
that holds JSON is taken as that JSON where the shape says so; of a repeated key the last
counts; repeated records repeat their rows. The type of a node under more than
``LONG_PATH`` steps is named by the first of them and a digest.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Nodes that are kept in memory before they are linked and handed on.
NODES_AT_ONCE = 200_000
#: Steps of a path that are spelled out.
LONG_PATH = 200


@dataclass(frozen=True)
class Shape:
    """What is known about the records beforehand.

    lists: types that are lists even where a bare element stands. nested: types whose
    elements are lists in turn. embedded: types whose text may hold JSON. named: types
    whose keys are fields; keys other than these are data and come under ``*``.
    vectors: types of lists of vectors of numbers; a bare vector stands for a list of one.
    whole: all lists are leaves.
    """

    lists: frozenset[str] = frozenset()
    embedded: frozenset[str] = frozenset()
    named: dict[str, frozenset[str]] = field(default_factory=dict)
    vectors: frozenset[str] = frozenset()
    whole: bool = False


# -- values


KINDS = {type(None): "null", bool: "boolean", int: "number", float: "number", str: "string", list: "array", dict: "object"}


def kind_of(value: object) -> str:
    return KINDS[type(value)]


def as_text(value: object) -> str | None:
    """Text as it is; anything else as JSON with sorted keys and whole numbers alike."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, int | float):
        return _scalar_text(value)
    try:
        return json.dumps(_plain(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    except RecursionError:
        return _deep_text(value)


def _scalar_text(value: object) -> str:
    return json.dumps(int(value) if isinstance(value, float) and value.is_integer() else value, ensure_ascii=False)


def _plain(value: object) -> object:
    if isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(value, list):
        return [_plain(x) for x in value]
    return {k: _plain(x) for k, x in value.items()} if isinstance(value, dict) else value


def _deep_text(value: object) -> str:
    """``as_text`` of lists and objects of any depth."""
    out: list[str] = []
    stack: list[tuple[bool, object]] = [(False, value)]
    while stack:
        done, x = stack.pop()
        if done:
            out.append(x)
        elif isinstance(x, list):
            out.append("[")
            parts = [(False, y) for y in x]
            stack += [(True, "]"), *_between(parts)[::-1]]
        elif isinstance(x, dict):
            out.append("{")
            parts = [((True, f"{json.dumps(k, ensure_ascii=False)}:"), (False, x[k])) for k in sorted(x)]
            stack += [(True, "}"), *[p for pair in _between(parts)[::-1] for p in (pair[::-1] if isinstance(pair[0], tuple) else [pair])]]
        else:
            out.append(_scalar_text(x))
    return "".join(out)


def _between(parts: list) -> list:
    return [y for i, x in enumerate(parts) for y in ([(True, ","), x] if i else [x])]


TOKEN = re.compile(r'[ \t\r\n]*([{}\[\],:]|"(?:[^"\\]|\\.)*"|[^ \t\r\n{}\[\],:"]+)', re.DOTALL)


def parse(text: str) -> object:
    """The value of a JSON text of any depth; ValueError if it is none."""
    try:
        return json.loads(text)
    except RecursionError:
        return _parse_deep(text)


def _parse_deep(text: str) -> object:
    """Without recursion: a stack of the containers that are open."""
    stack: list[tuple[list | dict, str | None]] = []  # containers, with the key a value is awaited for
    result: list[object] = []
    key: str | None = None
    now: list | dict = result
    wanted = "value"  # value, first (a value or the end), key, first key, colon, or comma
    at, end = 0, len(text.rstrip(" \t\r\n"))
    while at < end:
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no JSON at {at}")
        token, at = m.group(1), m.end()
        if wanted == "comma" and token == "," and stack:
            wanted = "key" if isinstance(now, dict) else "value"
        elif token in ("]", "}") and wanted in ("comma", "first key" if token == "}" else "first") and isinstance(now, dict if token == "}" else list) and stack:
            now, key = stack.pop()
            wanted = "comma"
        elif wanted in ("key", "first key") and token[0] == '"':
            key, wanted = json.loads(token), "colon"
        elif wanted == "colon" and token == ":":
            wanted = "value"
        elif wanted in ("value", "first") and token not in ("]", "}", ",", ":"):
            if now is result and result:
                raise ValueError("more than one value")
            value = [] if token == "[" else {} if token == "{" else json.loads(token)
            if isinstance(now, dict):
                now[key] = value
            else:
                now.append(value)
            if isinstance(value, list | dict):
                stack.append((now, key))
                now, wanted = value, "first" if isinstance(value, list) else "first key"
            else:
                wanted = "comma"
        else:
            raise ValueError(f"no JSON at {at}")
    if stack or not result:
        raise ValueError("the text ends early")
    return result[0]


def _loads(text: str | None) -> object:
    try:
        return None if text is None else parse(text)
    except ValueError:
        return None


# -- labels


class Kind:
    """A type of node, with what the shape says about it."""

    __slots__ = ("children", "embedded", "id", "inner", "is_list", "leaf", "named", "path", "steps", "vector")

    def __init__(self, path: str, steps: int, id_: int, shape: Shape):
        self.path, self.steps, self.id, self.children, self.inner = path, steps, id_, {}, None
        self.embedded, self.vector, self.named = path in shape.embedded, path in shape.vectors, shape.named.get(path)
        self.is_list, self.leaf = path in shape.lists or self.vector, shape.whole


def _longer(path: str, steps: int, step: str) -> str:
    if steps < LONG_PATH:
        return path + step
    head, _, digest = path.partition("...")
    return f"{head}...{hashlib.md5((digest + step).encode()).hexdigest()}"


@dataclass
class Nodes:
    """Node columns of some records; ``size`` is the length of a list with its null elements."""

    doc: list[int] = field(default_factory=list)
    pre: list[int] = field(default_factory=list)
    post: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    kind: list[int] = field(default_factory=list)
    place: list[int] = field(default_factory=list)
    size: list[int] = field(default_factory=list)
    name: list[str | None] = field(default_factory=list)
    value: list[object] = field(default_factory=list)
    #: Of each list of vectors: record, numbers before it, parent, types, and how many there are; then their lengths and entries.
    vectors: list[tuple[int, ...]] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    entries: list[float] = field(default_factory=list)

    @property
    def count(self) -> int:
        return len(self.pre) + len(self.lengths) + len(self.entries)


class Walker:
    """Labels records; ``kinds`` lists the types met so far."""

    def __init__(self, shape: Shape):
        self.shape = shape
        self.kinds: list[Kind] = []
        self.by_path: dict[str, Kind] = {}
        self.root = self._kind("$", 0)
        self.nodes = Nodes()

    def _kind(self, path: str, steps: int) -> Kind:
        if path not in self.by_path:
            self.by_path[path] = Kind(path, steps, len(self.kinds), self.shape)
            self.kinds.append(self.by_path[path])
        return self.by_path[path]

    def id_of(self, path: str) -> int:
        return self.by_path[path].id if path in self.by_path else -1

    def _child(self, kind: Kind, key: str) -> Kind:
        step = f".{key}" if kind.named is None or key in kind.named else ".*"
        child = kind.children[key] = self._kind(_longer(kind.path, kind.steps, step), kind.steps + 1)
        return child

    def _inner(self, kind: Kind) -> Kind:
        kind.inner = self._kind(_longer(kind.path, kind.steps, "[]"), kind.steps + 1)
        return kind.inner

    def take(self) -> Nodes:
        nodes, self.nodes = self.nodes, Nodes()
        return nodes

    def walk(self, doc: int, root: object) -> None:
        n = self.nodes
        pre = post = 0
        # value, type, place, name, row of the parent; or the row to be closed
        stack: list = [(root, self.root, -1, None, -1)]
        while stack:
            top = stack.pop()
            if top.__class__ is int:
                n.post[top] = post
                post += 1
                continue
            value, kind, place, name, parent = top
            if kind.embedded and isinstance(value, str) and isinstance(inside := _loads(value), dict | list):
                value = inside
            if kind.is_list and value is not None and not isinstance(value, list):
                value = [value] if not kind.vector else value
            if kind.vector and isinstance(value, list) and value and not any(isinstance(x, list) for x in value):
                value = [value]
            row = len(n.pre)
            n.doc.append(doc)
            n.pre.append(pre)
            n.post.append(post)
            n.parent.append(n.pre[parent] if parent >= 0 else -1)
            n.kind.append(kind.id)
            n.place.append(place)
            n.size.append(len(value) if value.__class__ is list else -1)
            n.name.append(name)
            n.value.append(value)
            pre += 1
            if isinstance(value, dict):
                children = kind.children
                below = [(x, children.get(k) or self._child(kind, k), -1, k, row) for k, x in value.items()]
            elif isinstance(value, list) and not kind.leaf:
                inner = kind.inner or self._inner(kind)
                if kind.vector and (taken := self._vectors(doc, value, inner, n.pre[row], pre, post)):
                    pre, post = pre + taken, post + taken
                    n.post[row] = post
                    post += 1
                    continue
                below = [(x, inner, i, None, row) for i, x in enumerate(value) if x is not None]
            else:
                post += 1
                continue
            stack.append(row)
            below.reverse()
            stack.extend(below)

    def _vectors(self, doc: int, value: list, kind: Kind, parent: int, pre: int, post: int) -> int:
        """Keeps vectors of numbers to be labelled at once; the number of their nodes, or 0 if there are other things in it."""
        if set(map(type, value)) != {list}:
            return 0
        flat = [x for v in value for x in v]
        if not set(map(type, flat)) <= {int, float}:
            return 0
        n = self.nodes
        n.vectors.append((doc, pre, post, parent, kind.id, (kind.inner or self._inner(kind)).id, len(value)))
        n.lengths.extend(map(len, value))
        n.entries.extend(flat)
        return len(value) + len(flat)


def _floats(numbers: list[float]) -> np.ndarray:
    try:
        return np.array(numbers, np.float64)
    except OverflowError:  # a whole number beyond all floats
        return np.array([float(x) if abs(x) < 1e308 else float("inf") for x in numbers])


class _Columns:
    """The nodes as arrays, those of vectors behind the others; ``number`` is NaN but for their entries."""

    def __init__(self, nodes: Nodes):
        self.plain = len(nodes.pre)
        self.name, self.value, self.entries = nodes.name, nodes.value, nodes.entries
        plain = {c: np.array(getattr(nodes, c), np.int64) for c in ("doc", "pre", "post", "parent", "kind", "place", "size")}
        doc, pre, post, parent, kind, inner, count = np.array(nodes.vectors, np.int64).reshape(-1, 7).T
        length = np.array(nodes.lengths, np.int64)
        of = np.repeat(np.arange(len(doc)), count)  # the list of each vector
        ends = np.cumsum(1 + length)
        first = np.cumsum(count) - count
        base = (ends - 1 - length)[np.minimum(first, max(len(length) - 1, 0))] if len(length) else np.zeros(len(doc), np.int64)
        at = ends - 1 - length - base[of]  # place of a vector among the nodes of its list
        vector = np.repeat(np.arange(len(length)), length)  # the vector of each entry
        nth = np.arange(len(vector)) - np.repeat(np.cumsum(length) - length, length)
        entry_at = at[vector] + 1 + nth
        of_entry = of[vector]
        more = {
            "doc": (doc[of], doc[of_entry]), "pre": (pre[of] + at, pre[of_entry] + entry_at), "post": (post[of] + at + length, post[of_entry] + entry_at - 1),
            "parent": (parent[of], pre[of_entry] + at[vector]), "kind": (kind[of], inner[of_entry]), "place": (np.arange(len(length)) - first[of], nth),
            "size": (length, np.full(len(nth), -1)),
        }
        for c, x in plain.items():
            setattr(self, c, np.concatenate((x, *more[c])))
        self.number = np.concatenate((np.full(self.plain + len(length), np.nan), _floats(nodes.entries)))

    def of_kind(self, kind: int) -> np.ndarray:
        """Rows of a type, in the order of records and pre-order."""
        rows = np.flatnonzero(self.kind == kind)
        if len(rows) and rows[-1] >= self.plain > rows[0]:
            rows = rows[np.lexsort((self.pre[rows], self.doc[rows]))]
        return rows


def _within(nodes: _Columns, leaf: np.ndarray, above: np.ndarray) -> np.ndarray:
    """For each leaf row the row among ``above`` that contains it, or -1.

    Rows of one type never contain each other, so only the last one that begins before
    the leaf can contain it.
    """
    if not len(above):
        return np.full(len(leaf), -1)
    span = np.int64(max(nodes.pre[leaf].max(initial=0), nodes.pre[above].max()) + 1)
    at = np.searchsorted(nodes.doc[above] * span + nodes.pre[above], nodes.doc[leaf] * span + nodes.pre[leaf], side="right") - 1
    row = above[np.maximum(at, 0)]
    inside = (at >= 0) & (nodes.doc[row] == nodes.doc[leaf]) & (nodes.pre[row] <= nodes.pre[leaf]) & (nodes.post[row] >= nodes.post[leaf])
    return np.where(inside, row, -1)


# -- relations


@dataclass(frozen=True)
class Relation:
    """One flat table: its list levels from the outside in, and the type it is made of.

    The item is the node's own text or, with ``by_name``, its key.
    """

    name: str
    levels: tuple[str, ...]
    leaf: str
    by_name: bool = False


LEVELS = 3
Rows = tuple[str, np.ndarray, list[np.ndarray], list[str | None]]


def _relation_rows(walker: Walker, c: _Columns, relations: list[Relation]) -> Iterator[Rows]:
    of: dict[str, np.ndarray] = {}

    def rows(path: str) -> np.ndarray:
        if path not in of:
            of[path] = c.of_kind(walker.id_of(path))
        return of[path]

    for r in relations:
        leaf = rows(r.leaf)
        if not r.by_name:
            leaf = leaf[[c.value[i] is not None for i in leaf]] if len(leaf) else leaf
        if not len(leaf):
            continue
        places, ok = [], np.ones(len(leaf), bool)
        for level in r.levels:
            at = _within(c, leaf, rows(level))
            ok &= at >= 0
            places.append(c.place[np.maximum(at, 0)])
        leaf = leaf[ok]
        places = [p[ok] for p in places] + [np.full(len(leaf), -1, np.int64)] * (LEVELS - len(places))
        yield r.name, c.doc[leaf], places, [c.name[i] if r.by_name else as_text(c.value[i]) for i in leaf]


@dataclass(frozen=True)
class Matrix:
    """A relation of matrix cells: the types of the data, both axes and the layout's name.

    A cell is an entry of a vector. In the sparse layout (row, column, value) a vector of
    three entries names the cell of the last; in the dense one the places of the vector
    and of its entry do. Where the layout says neither, it is dense if there are as many
    vectors as rows, all as long as the columns and of another length than three.
    """

    name: str
    data: str
    rows: str
    columns: str
    layout: str


def _number(x: object) -> float:
    """A cell value; null is zero, what is not a number is not zero."""
    if isinstance(x, str):
        try:
            return float(x)
        except ValueError:
            return float("nan")
    return float(x) if isinstance(x, int | float) else float("nan")


def _matrix_rows(walker: Walker, c: _Columns, m: Matrix) -> Rows:
    data, vectors, entries = (c.of_kind(walker.id_of(m.data + level)) for level in ("", "[]", "[][]"))
    vectors = vectors[c.size[vectors] >= 0]
    number, place = c.number[entries], c.place[entries].copy()
    whole = number.copy()  # the entry as a coordinate
    for i in np.flatnonzero(entries < c.plain):  # of vectors that hold other things than numbers
        x = c.value[entries[i]]
        number[i] = _number(x)
        whole[i] = x if isinstance(x, int | float) and not isinstance(x, bool) and abs(x) < 2**53 else np.nan
    at = _within(c, entries, vectors)
    entries, number, place, whole, at = (x[at >= 0] for x in (entries, number, place, whole, at))
    docs = int(c.doc.max(initial=-1)) + 1

    def sizes(path: str) -> np.ndarray:
        rows, out = c.of_kind(walker.id_of(path)), np.full(docs, -1, np.int64)
        out[c.doc[rows]] = c.size[rows]
        return out

    n_rows, n_columns, n_data = sizes(m.rows), sizes(m.columns), sizes(m.data)
    dense = n_data == n_rows
    other = vectors[(c.size[vectors] != n_columns[c.doc[vectors]]) | (c.size[vectors] == 3)]
    dense[c.doc[other]] = False
    for i in c.of_kind(walker.id_of(m.layout)):
        name = c.value[i].strip().lower() if isinstance(c.value[i], str) else ""
        if name in ("sparse", "dense"):
            dense[c.doc[i]] = name == "dense"
    doc, is_dense = c.doc[entries], dense[c.doc[entries]]
    # sparse: the three entries of a vector side by side; a null entry is missing, so the places are compared
    triple = ~is_dense & (c.size[at] == 3)
    first = np.flatnonzero(triple & (place == 0))
    first = first[first + 2 < len(at)]
    first = first[(at[first] == at[first + 2]) & (place[first + 2] == 2)]
    r, k = whole[first], whole[first + 1]
    good = (r >= 0) & (k >= 0) & (r < 2**53) & (k < 2**53) & (np.floor(r) == r) & (np.floor(k) == k)
    first = first[good]
    by_place = np.flatnonzero(is_dense)
    row = np.concatenate((whole[first].astype(np.int64), c.place[at[by_place]]))
    column = np.concatenate((whole[first + 1].astype(np.int64), place[by_place]))
    value = np.concatenate((number[first + 2], number[by_place]))
    doc = np.concatenate((doc[first], doc[by_place]))
    keep = value != 0
    for path, p, n in ((m.rows, row, n_rows), (m.columns, column, n_columns)):
        there = c.of_kind(walker.id_of(path + "[]"))  # null elements are no node
        known = np.sort(c.doc[there] << 32 | c.place[there])
        keep &= (p < n[doc]) & _among(doc << 32 | np.minimum(p, 2**32 - 1), known)
    doc, row, column = doc[keep], row[keep], column[keep]
    return m.name, doc, [row, column, np.full(len(doc), -1, np.int64)], [""] * len(doc)


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _clean(texts: list[str | None]) -> pa.Array:
    try:
        return pa.array(texts, pa.string())
    except UnicodeEncodeError:  # half a surrogate pair
        return pa.array([t and t.encode("utf-8", "replace").decode() for t in texts], pa.string())


def flat_relations(df: DataFrame, key: str, body: str, shape: Shape, relations: list[Relation], matrix: Matrix | None = None) -> DataFrame:
    """``key``, ``relation``, ``pos1`` to ``pos3``, ``item``: the flat tables of all records.

    Places are 0-based and -1 where a relation has fewer levels. A cell that a record
    names twice has two rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            walker, keys, first = Walker(shape), batch[key], 0
            for i, text in enumerate(batch[body]):
                root = _loads(text.as_py())
                if isinstance(root, dict):
                    walker.walk(i, root)
                if walker.nodes.count >= NODES_AT_ONCE:
                    yield from out(walker, keys)
                    first = i + 1
            if first < batch.num_rows:
                yield from out(walker, keys)

    def out(walker: Walker, keys: pa.Array) -> Iterator[pa.RecordBatch]:
        c = _Columns(walker.take())
        tables = [*_relation_rows(walker, c, relations), *([_matrix_rows(walker, c, matrix)] if matrix else [])]
        for name, docs, places, items in tables:
            for lo in range(0, len(docs), NODES_AT_ONCE):
                part = slice(lo, lo + NODES_AT_ONCE)
                n = len(docs[part])
                columns = [keys.take(pa.array(docs[part])), pa.array([name] * n, pa.string()), *[pa.array(p[part]) for p in places], _clean(items[part])]
                yield pa.record_batch(columns, names=[key, "relation", "pos1", "pos2", "pos3", "item"])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("relation", T.StringType())])
    for i in range(LEVELS):
        schema.add(f"pos{i + 1}", T.LongType())
    schema.add("item", T.StringType())
    return df.where(df[body].isNotNull()).select(key, body).mapInArrow(run, schema)


def node_table(df: DataFrame, keys: list[str], body: str, shape: Shape | None = None) -> DataFrame:
    """``keys``, ``pre``, ``post``, ``parent``, ``type``, ``name``, ``place``, ``kind``, ``value``: all nodes.

    ``parent`` is the pre-order number of the parent, -1 for the record itself; ``value``
    is the text of a leaf, null for objects and lists that are not leaves.
    """
    shape = shape or Shape()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            walker = Walker(shape)
            for i, text in enumerate(batch[body]):
                root = _loads(text.as_py())
                if root is not None:
                    walker.walk(i, root)
                if walker.nodes.count >= NODES_AT_ONCE:
                    yield from out(walker, batch)
            yield from out(walker, batch)

    def out(walker: Walker, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = walker.take()
        c = _Columns(n)
        paths = pa.array([k.path for k in walker.kinds], pa.string())
        more = len(c.pre) - c.plain
        names = n.name + [None] * more
        kinds = [kind_of(v) for v in n.value] + ["array"] * len(n.lengths) + ["number"] * len(n.entries)
        values = [None if isinstance(v, dict) or isinstance(v, list) and not shape.whole else as_text(v) for v in n.value]
        values += [None] * len(n.lengths) + [_scalar_text(x) for x in n.entries]
        for lo in range(0, len(c.pre), NODES_AT_ONCE):
            part = slice(lo, lo + NODES_AT_ONCE)
            docs = pa.array(c.doc[part])
            columns = [
                *[batch[k].take(docs) for k in keys], pa.array(c.pre[part]), pa.array(c.post[part]), pa.array(c.parent[part]), paths.take(pa.array(c.kind[part])),
                _clean(names[part]), pa.array(c.place[part]), pa.array(kinds[part], pa.string()), _clean(values[part]),
            ]
            yield pa.record_batch(columns, names=[*keys, "pre", "post", "parent", "type", "name", "place", "kind", "value"])

    schema = T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys])
    for name, kind in (("pre", "l"), ("post", "l"), ("parent", "l"), ("type", "s"), ("name", "s"), ("place", "l"), ("kind", "s"), ("value", "s")):
        schema.add(name, T.LongType() if kind == "l" else T.StringType())
    return df.where(df[body].isNotNull()).select(*keys, body).mapInArrow(run, schema)


def node_tables(nodes: DataFrame, types: list[str] | None = None) -> dict[str, DataFrame]:
    """One table for each type of node, without the column ``type``.

    Without ``types`` they are read from the nodes; there are as many as the records have
    paths. To store them all in one pass, write the node table partitioned by type.
    """
    if types is None:
        types = [r["type"] for r in nodes.select("type").distinct().orderBy("type").collect()]
    return {t: nodes.where(F.col("type") == t).drop("type") for t in types}


def unread_records(df: DataFrame, keys: list[str], body: str) -> DataFrame:
    """``keys``, ``reason``: the records that give no rows, as their body is null, no JSON or no object."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reasons = [_unread(text.as_py()) for text in batch[body]]
            at = pa.array([i for i, r in enumerate(reasons) if r], pa.int64())
            yield pa.record_batch([*[batch[k].take(at) for k in keys], pa.array([r for r in reasons if r], pa.string())], names=[*keys, "reason"])

    schema = T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys]).add("reason", T.StringType())
    return df.select(*keys, body).mapInArrow(run, schema)


def _unread(text: str | None) -> str | None:
    if text is None:
        return "null"
    try:
        return None if isinstance(parse(text), dict) else "no object"
    except ValueError:
        return "no JSON"


def leaf_table(df: DataFrame, keys: list[str], body: str) -> DataFrame:
    """``keys``, ``field``, ``kind``, ``value``: the leaves of objects, lists being leaves.

    Names of nested objects are joined by dots. A body that is no object has no leaves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, fields, kinds, values = [], [], [], []
            for i, text in enumerate(batch[body]):
                root = _loads(text.as_py())
                stack = [("", root)] if isinstance(root, dict) else []
                while stack:
                    prefix, value = stack.pop()
                    for k, x in value.items():
                        if isinstance(x, dict):
                            stack.append((f"{prefix}{k}.", x))
                        else:
                            at.append(i)
                            fields.append(prefix + k)
                            kinds.append(KINDS[type(x)])
                            values.append(x if x.__class__ is str else as_text(x))
            places = pa.array(at, pa.int64())
            yield pa.record_batch([*[batch[k].take(places) for k in keys], _clean(fields), pa.array(kinds, pa.string()), _clean(values)], names=[*keys, "field", "kind", "value"])

    schema = T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys])
    for name in ("field", "kind", "value"):
        schema.add(name, T.StringType())
    return df.where(df[body].isNotNull()).select(*keys, body).mapInArrow(run, schema)


#: The JSON table format 1.0.
TABLE_SHAPE = Shape(
    lists=frozenset({
        "$.rows", "$.columns", "$.rows[].metadata.taxonomy", "$.rows[].metadata.pathways", "$.rows[].metadata.pathways[]",
        "$.columns[].metadata.runs", "$.columns[].metadata.runs[].lanes",
    }),
    embedded=frozenset({"$.rows[].metadata", "$.columns[].metadata"}),
    named={"$.rows[].metadata": frozenset({"taxonomy", "pathways", "confidence"})},
    vectors=frozenset({"$.data"}),
)
TABLE_RELATIONS = [
    Relation("row", ("$.rows[]",), "$.rows[].id"),
    Relation("column", ("$.columns[]",), "$.columns[].id"),
    Relation("taxon", ("$.rows[]", "$.rows[].metadata.taxonomy[]"), "$.rows[].metadata.taxonomy[]"),
    Relation("pathway", ("$.rows[]", "$.rows[].metadata.pathways[]", "$.rows[].metadata.pathways[][]"), "$.rows[].metadata.pathways[][]"),
    Relation("member", ("$.rows[]",), "$.rows[].metadata.*", by_name=True),
    Relation("run", ("$.columns[]", "$.columns[].metadata.runs[]"), "$.columns[].metadata.runs[].run"),
    Relation("lane", ("$.columns[]", "$.columns[].metadata.runs[]", "$.columns[].metadata.runs[].lanes[]"), "$.columns[].metadata.runs[].lanes[].lane"),
]
TABLE_MATRIX = Matrix("cell", "$.data", "$.rows", "$.columns", "$.matrix_type")


def table_relations(files: DataFrame, key: str = "file_id", body: str = "body") -> DataFrame:
    """The flat relations of JSON tables, each row once."""
    return flat_relations(files, key, body, TABLE_SHAPE, TABLE_RELATIONS, TABLE_MATRIX).distinct()


#: The flat tables by name: their positions, and the name of their item.
TABLES = {
    "row": (["row_pos"], "id"), "column": (["column_pos"], "id"), "taxon": (["row_pos", "place"], "taxon"), "pathway": (["row_pos", "path_pos", "place"], "name"), "member": (["row_pos"], "member"),
    "run": (["column_pos", "run_pos"], "run"), "lane": (["column_pos", "run_pos", "lane_pos"], "lane"), "cell": (["row_pos", "column_pos"], ""),
}


def relation_table(files: DataFrame, name: str, key: str = "file_id", body: str = "body") -> DataFrame:
    """One flat table by itself, with its positions as columns; each row links to its parents by them."""
    places, item = TABLES[name]
    rows = flat_relations(files, key, body, TABLE_SHAPE, [r for r in TABLE_RELATIONS if r.name == name], TABLE_MATRIX if name == TABLE_MATRIX.name else None)
    return rows.select(key, *[F.col(f"pos{i + 1}").alias(p) for i, p in enumerate(places)], *([F.col("item").alias(item)] if item else [])).distinct()
