"""A large JSON document in parts: its long lists become rows, one for each entry, read by many tasks.

The text is divided at its commas, so that no task and no row holds the document. Of a
local file the tasks read their blocks, from other file systems Spark reads them. A first
pass finds how each block of the file changes the state of quotes and brackets, a second
one what stands around the long lists and the entries cut by the end of a block, and a
third one gives the entries. The driver holds a few facts for each block, the document
without its long lists, and the entries that were cut.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrix.sources.files import exists, is_folder, local_path, size_of

#: Documents of more bytes than this are read in parts.
ONE_TASK_BYTES = 8 << 20
#: Bytes of a local file that a task reads, and those of a file that all cores are to share.
BLOCK_BYTES, LEAST_BYTES = 16 << 20, 1 << 20
#: The lists that may be long, and the one that stays in the text where all others may be.
LISTS, SHORT = ("rows", "columns", "data"), "shape"
#: Bytes that are looked at at once; bytes of any other value that may be cut by the end of a block.
AT_ONCE, OTHER = 1 << 20, 1 << 16

QUOTE, ESCAPE, COMMA, LIST = (ord(x) for x in '"\\,[')
_MARK = np.zeros(256, bool)
_MARK[[ord(x) for x in '"[]{},']] = True
_STEP = np.zeros(256, np.int64)
_STEP[[ord(x) for x in "[{"]], _STEP[[ord(x) for x in "]}"]] = 1, -1
_KEY = re.compile(rb'("(?:[^"\\]|\\.)*")\s*:\s*\[$')

Texts = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, bytes]]]
#: Of a pass: whether each block begins within a text, and how deep.
State = dict[int, tuple[int, int]]


def is_large(path: str) -> bool:
    return not path.endswith((".gz", ".bz2")) and exists(path) and not is_folder(path) and size_of(path) > ONE_TASK_BYTES


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    """Block and text, some of it at a time; each text ends in a comma."""
    at, held, size = None, [], 0
    for batch in batches:
        b, values = batch["b"].to_numpy(), batch["value"]
        cuts = [0, *(np.flatnonzero(np.diff(b)) + 1).tolist(), len(b)] if len(b) else []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and (b[lo] != at or size >= AT_ONCE):
                yield at, b"".join(held)
                held, size = [], 0
            at, part = int(b[lo]), values.slice(lo, hi - lo)
            held += [pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), pa.scalar(b",", part.type))[0].as_py(), b","]
            size += len(held[-2]) + 1
    if held:
        yield at, b"".join(held)


def _local_texts(path: str, size: int, step: int) -> Texts:
    """The same of a local file's blocks, each from behind a comma to behind the first comma beyond it."""

    def bound(f: BinaryIO, at: int) -> int:
        f.seek(at := at - 1)
        while more := f.read(OTHER):
            if (k := more.find(b",")) >= 0:
                return at + k + 1
            at += len(more)
        return size

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        for b in (int(x) * step for batch in batches for x in batch["id"].to_numpy()):
            with open(path, "rb") as f:
                lo, hi, held = bound(f, b) if b else 0, bound(f, b + step) if b + step < size else size, b""
                f.seek(lo)
                while lo < hi:
                    more = f.read(min(AT_ONCE, hi - lo))
                    if not more:
                        raise OSError(f"{path} became shorter")
                    lo += len(more)
                    cut = len(more) if lo == hi else more.rfind(b",") + 1
                    held, more = held + more[:cut], more[cut:]
                    if cut:
                        yield b, held if lo < size or held.endswith(b",") else held + b","
                        held = b""
                    held += more

    return texts


def _marks(text: bytes, inside: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and kinds of brackets and commas outside texts, and whether the end is within one."""
    u = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(_MARK[u])
    quote = u[at] == QUOTE
    if ESCAPE in text:
        place = np.arange(len(u))
        plain = np.maximum.accumulate(np.where(u == ESCAPE, -1, place))
        before = np.maximum(at - 1, 0)
        kept = ~(quote & (at > 0) & ((before - plain[before]) % 2 == 1))
        at, quote = at[kept], quote[kept]
    within = (np.cumsum(quote) + inside) % 2
    last = int(within[-1]) if len(within) else inside
    kept = ~quote & (within == 0)
    return at[kept], u[at[kept]], last


def _changes(texts: Texts):
    """Of each block: whether it has an odd number of quotes, its change of depth if it begins outside a text or within one, its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[int]] = {}
        for b, text in texts(batches):
            odd, out, within, size = found.get(b, (0, 0, 0, 0))
            steps, ends = [], []
            for inside in (0, 1):
                _, kinds, end = _marks(text, inside)
                steps.append(int(_STEP[kinds].sum()))
                ends.append(end)
            out, within = out + steps[odd], within + steps[1 - odd]
            found[b] = [odd ^ ends[0], out, within, size + len(text)]
        yield pa.record_batch([pa.array(list(found), pa.int64()), *(pa.array([x[i] for x in found.values()], pa.int64()) for i in range(4))], names=["b", "odd", "out", "within", "bytes"])

    return run


def _walk(found: Iterator[tuple[int, bytes]], states: State, every: bool) -> Iterator[tuple[int, str, Any]]:
    """Block, kind and what there is: ``flat`` a text outside of lists and objects of the top level, ``in`` one within
    with the places of its commas; ``open`` the name of such a list, empty for anything else; ``close``."""
    block = None
    for b, text in found:
        if b != block:
            block, (inside, depth) = b, states[b]
        at, kinds, inside = _marks(text, inside)
        after = depth + np.cumsum(_STEP[kinds])
        before = after - _STEP[kinds]
        commas = at[(kinds == COMMA) & (after == 2)]
        turns = np.flatnonzero(((before == 1) & (after == 2)) | ((before == 2) & (after == 1)))
        lo, deep = 0, depth >= 2
        for place, opens in [*zip(at[turns].tolist(), (after[turns] == 2).tolist(), strict=True), (len(text), None)]:
            hi = place + 1 if opens else place
            if deep:
                yield b, "in", (text, lo, hi, commas[np.searchsorted(commas, lo) : np.searchsorted(commas, hi)])
                if opens is not None:
                    yield b, "close", None
            else:
                yield b, "flat", text[lo:hi]
                if opens:
                    key = _KEY.search(text[max(lo, hi - OTHER) : hi])
                    name = json.loads(key[1].decode("utf-8", "replace"), strict=False) if key else ""
                    yield b, "open", name if (name != SHORT if every else name in LISTS) else ""
            lo, deep = hi, bool(opens) if opens is not None else deep
        depth = int(after[-1]) if len(after) else depth


def _around(texts: Texts, states: State, every: bool):
    """Of each block, in order: texts outside the long lists, and of a list the ends of its part in the block and the number of its commas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        piece = None
        for b, kind, x in _walk(texts(batches), states, every):
            if kind == "flat":
                rows.append({"b": b, "nth": len(rows), "flat": x})
            elif kind == "open":
                piece = {"b": b, "nth": len(rows), "opened": True, "name": x, "head": b"", "tail": b"", "whole": None if x else b"", "commas": 0, "closed": False}
                rows.append(piece)
            elif kind == "in":
                text, lo, hi, commas = x
                if piece is None or piece["b"] != b:
                    piece = {"b": b, "nth": len(rows), "opened": False, "name": "", "head": b"", "tail": b"", "whole": b"", "commas": 0, "closed": False}
                    rows.append(piece)
                if piece["whole"] is not None:
                    piece["whole"] = piece["whole"] + text[lo:hi] if piece["opened"] or len(piece["whole"]) + hi - lo <= OTHER else None
                first, last = (int(commas[0]), int(commas[-1]) + 1) if len(commas) else (hi, lo)
                if not piece["commas"]:
                    piece["head"] += text[lo:first]
                if len(commas):
                    piece["tail"] = b""
                if piece["commas"] or len(commas):
                    piece["tail"] += text[last:hi]
                piece["commas"] += len(commas)
            else:
                piece["closed"], piece = True, None
        yield pa.RecordBatch.from_pylist(rows, schema=_AROUND)

    return run


_AROUND = pa.schema([("b", pa.int64()), ("nth", pa.int64()), ("flat", pa.binary()), ("opened", pa.bool_()), ("name", pa.string()), ("head", pa.binary()), ("tail", pa.binary()), ("whole", pa.binary()), ("commas", pa.int64()), ("closed", pa.bool_())])


def _entries(texts: Texts, states: State, begun: dict[int, tuple[str, int]], wanted: tuple[str, ...], every: bool):
    """The entries of the wanted lists that are within one block. begun: the list in which a block begins, and the place of the entry that is cut there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, name, nth, pending, cut = None, "", 0, b"", False

        def batch(found: pa.Array) -> pa.RecordBatch:
            return pa.record_batch([pa.repeat(pa.scalar(name), len(found)), pa.array(np.arange(nth, nth + len(found)), pa.int64()), found], names=["list", "ord", "text"])

        for b, kind, x in _walk(texts(batches), states, every):
            if b != block:
                block, pending = b, b""
                (name, nth), cut = begun.get(b, ("", 0)), True
            if kind == "open":
                name, nth, pending, cut = x, 0, b"", False
            elif kind == "close":
                if name in wanted and not cut and (nth or pending.strip()):
                    yield batch(pa.array([pending], pa.binary()))
                name = ""
            elif kind == "in" and name in wanted:
                text, lo, hi, commas = x
                if not len(commas):
                    pending += text[lo:hi]
                    continue
                if not cut:
                    yield batch(pa.array([pending + text[lo : commas[0]]], pa.binary()))
                nth, cut = nth + 1, False
                if len(commas) > 1:  # each with the comma behind it
                    bounds = pa.py_buffer((commas + 1).astype(np.int32).tobytes())
                    whole = pa.Array.from_buffers(pa.binary(), len(commas) - 1, [None, bounds, pa.py_buffer(text)])
                    yield batch(pc.binary_slice(whole, 0, -1))
                    nth += len(commas) - 1
                pending = text[commas[-1] + 1 : hi]

    return run


@dataclass
class Parts:
    """A document: the text without its long lists' entries, the numbers of these, and what finds them."""

    blocks: DataFrame
    texts: Texts
    states: State
    text: str
    sizes: dict[str, int]
    begun: dict[int, tuple[str, int]] = field(default_factory=dict)
    cut: list[tuple[str, int, bytes]] = field(default_factory=list)
    every: bool = False

    def entries(self, *names: str) -> DataFrame:
        """``(list, ord, text)`` of each entry of these lists."""
        whole = self.blocks.mapInArrow(_entries(self.texts, self.states, self.begun, names, self.every), "list string, ord long, text binary")
        cut = self.blocks.sparkSession.createDataFrame([x for x in self.cut if x[0] in names], "list string, ord long, text binary")
        return whole.unionByName(cut).select("list", "ord", F.col("text").cast("string").alias("text"))


def read_parts(spark: SparkSession, path: str, every: bool = False) -> Parts | None:
    """With ``every``, all lists of the document but ``SHORT`` may be long. None where a document cannot be read so: a list twice, or another long value cut by the end of a block."""
    if local := local_path(path):
        step = min(BLOCK_BYTES, max(LEAST_BYTES, -(-size_of(path) // spark.sparkContext.defaultParallelism)))
        n = -(-size_of(path) // step)
        blocks, texts = spark.range(0, n, 1, n), _local_texts(local, size_of(path), step)
    else:
        blocks, texts = spark.read.option("lineSep", ",").text(path).select(F.col("_metadata.file_block_start").alias("b"), F.col("value").cast("binary").alias("value")), _texts
    states, inside, depth, size = {}, 0, 0, 0
    for r in sorted(blocks.mapInArrow(_changes(texts), "b long, odd long, out long, within long, bytes long").collect()):
        states[r["b"]] = (inside, depth)
        depth += r["within"] if inside else r["out"]
        inside, size = inside ^ r["odd"], size + r["bytes"]
    schema = "b long, nth long, flat binary, opened boolean, name string, head binary, tail binary, whole binary, commas long, closed boolean"
    pieces = sorted(blocks.mapInArrow(_around(texts, states, every), schema).collect(), key=lambda r: (r["b"], r["nth"]))
    parts = Parts(blocks, texts, states, "", {}, every=every)
    flat: list[bytes] = []
    name, nth, held = "", 0, []
    for p in pieces:
        if p["flat"] is not None:
            flat.append(bytes(p["flat"]))
            continue
        head, tail = bytes(p["head"]), bytes(p["tail"])
        if p["opened"]:
            name, nth, held = p["name"], 0, []
            if name in parts.sizes:
                return None
            if name:
                parts.sizes[name] = 0
        else:
            parts.begun[p["b"]] = (name, nth)
        if not name:
            if p["whole"] is None:
                return None
            flat.append(bytes(p["whole"]))
            continue
        held.append(head)
        ended = p["commas"] or p["closed"]
        single = p["closed"] and not nth and not p["commas"] and not b"".join(held).strip()
        if ended and not p["opened"] and not single:
            parts.cut.append((name, nth, b"".join(held)))
        nth += p["commas"]
        held = [tail] if p["commas"] else held
        if p["closed"]:
            parts.sizes[name] = 0 if single else nth + 1
    text = b"".join(flat)  # a comma too many at its end, unless the file ends in one
    parts.text = (text[:-1] if size != size_of(path) else text).decode("utf-8", "replace")
    return parts
