"""Merging, concatenating and aligning tables."""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrix.errors import DisjointIDError, TableError
from sparrix.functions.scalar import prefer_first

if TYPE_CHECKING:
    from sparrix.core import MatrixTable


def union_order(frames: Sequence[DataFrame]) -> DataFrame:
    """``(id, ord, md?)``: ids of all frames, those of the first first, each once."""
    from sparrix.core import renumbered

    kinds = {f.schema["md"].dataType.simpleString() for f in frames if "md" in f.columns}
    md = len(kinds) == 1
    kind = next(iter(kinds), "")
    parts = []
    for i, f in enumerate(frames):
        value = [F.col("md") if "md" in f.columns else F.lit(None).cast(kind).alias("md")] if md else []
        parts.append(f.select("id", F.struct(F.lit(i).alias("t"), "ord").alias("o"), *value))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    first = [F.min_by("md", F.when(F.col("md").isNotNull(), F.col("o"))).alias("md")] if md else []
    merged = every.groupBy("id").agg(F.min("o").alias("o"), *first)
    return renumbered(merged, "o").select("id", "ord", *(["md"] if md else []))


class CombineOps:
    def merge(self, other: MatrixTable | Sequence[MatrixTable], sample: str = "union", observation: str = "union", order: str = "self", metadata=prefer_first) -> MatrixTable:
        """Adds tables cell by cell, on the union or intersection of each axis.

        order: ``self`` keeps the order of this table, with new ids behind it; ``sorted``
        sorts both axes. metadata: a function of two struct columns, or None for no
        metadata. Metadata of another shape than this table's is dropped. The result has
        no type or id.
        """
        others = list(other) if isinstance(other, list | tuple | set) else [other]
        for how in (sample, observation):
            if how not in ("union", "intersection"):
                raise ValueError(f"unknown way to merge {how!r}")
        tables = [self, *others]
        frames = {axis: self._merged_axis([t._axis(axis)[0] for t in tables], how, order, metadata) for axis, how in (("observation", observation), ("sample", sample))}
        cells = self.cells
        for t in others:
            cells = cells.unionByName(t.cells)
        for axis, how, key in (("observation", observation, "obs_id"), ("sample", sample, "samp_id")):
            if how == "intersection":  # before the sum, so that what is not wanted is not shuffled
                cells = cells.join(frames[axis].select(F.col("id").alias(key)), key, "left_semi")
        cells = cells.groupBy("obs_id", "samp_id").agg(F.sum("value").alias("value")).where("value <> 0")
        return self._new(cells, frames["observation"], frames["sample"], type=None, table_id=None)

    @staticmethod
    def _merged_axis(frames: list[DataFrame], how: str, order: str, metadata) -> DataFrame:
        from sparrix.core import renumbered

        if metadata is None:
            frames = [f.drop("md") for f in frames]
        if how == "union":
            if metadata not in (None, prefer_first) and all("md" in f.columns for f in frames):
                both = frames[0].select("id", "ord", F.col("md").alias("m0"))
                for i, f in enumerate(frames[1:], 1):
                    both = both.join(f.select("id", F.col("md").alias(f"m{i}"), F.col("ord").alias(f"o{i}")), "id", "full")
                merged: Column = F.col("m0")
                for i in range(1, len(frames)):
                    merged = metadata(merged, F.col(f"m{i}"))
                out = renumbered(both.select("id", F.struct(F.coalesce("ord", F.lit(1 << 62)), *[f"o{i}" for i in range(1, len(frames))]).alias("o"), merged.alias("md")), "o").select("id", "ord", "md")
            else:
                out = union_order(frames)
        else:
            out = frames[0]
            for f in frames[1:]:
                side = f.select("id", F.col("md").alias("theirs")) if "md" in f.columns and "md" in out.columns and f.schema["md"] == out.schema["md"] else f.select("id")
                out = out.join(side, "id")
                if "theirs" in out.columns:
                    out = out.withColumn("md", (metadata or prefer_first)(F.col("md"), F.col("theirs"))).drop("theirs")
            if out.isEmpty():
                raise TableError("the tables have no ids in common")
        return renumbered(out.drop("ord"), "id").select(*out.columns) if order == "sorted" else out

    def concat(self, others: MatrixTable | Sequence[MatrixTable], axis: str = "sample") -> MatrixTable:
        """Puts tables side by side along an axis on which they share no ids.

        The other axis is the sorted union; metadata is that of the first table that has
        the id. As the axis is disjoint, cells are not aggregated.
        """
        from sparrix.core import renumbered

        others = [others] if not isinstance(others, list | tuple) else list(others)
        tables = [self, *others]
        frames = [t._axis(axis)[0] for t in tables]
        ids = frames[0].select("id")
        for f in frames[1:]:
            ids = ids.unionByName(f.select("id"))
        if not ids.groupBy("id").count().where("count > 1").isEmpty():
            raise DisjointIDError(f"the tables share {axis} ids")
        cells = self.cells
        for t in others:
            cells = cells.unionByName(t.cells)
        inverse = self._other(axis)
        merged = union_order([t._axis(inverse)[0] for t in tables])
        merged = renumbered(merged.drop("ord"), "id").select(*merged.columns)
        table = self._with_axis(axis, union_order(frames), cells)
        return table._with_axis(inverse, merged, table_id=None)

    def align_to(self, other: MatrixTable, axis: str = "detect") -> MatrixTable:
        """Puts axes in the order of another table, which must have the same ids there.

        ``detect`` takes the axes whose ids agree; ``both`` wants both.
        """
        axes = {"detect": ("sample", "observation"), "both": ("sample", "observation")}.get(axis, (axis,))
        table, aligned = self, 0
        for one in axes:
            mine, theirs = self._axis(one)[0].select("id"), other._axis(one)[0].select("id")
            if mine.join(theirs, "id", "left_anti").isEmpty() and theirs.join(mine, "id", "left_anti").isEmpty():
                table, aligned = table.sort_order(other._axis(one)[0].select("id", "ord"), one), aligned + 1
            elif axis != "detect":
                raise DisjointIDError(f"the {one} ids differ")
        if not aligned:
            raise TableError("no axis can be aligned")
        return table

    def align_to_frame(self, metadata: DataFrame, axis: str = "sample", id_column: str = "id") -> tuple[MatrixTable, DataFrame]:
        """Table and metadata frame with the ids both have and cells left, in the table's order."""
        ids = metadata.select(F.col(id_column).alias("id")).distinct()
        table = self._semi(axis, ids, False).remove_empty()
        if table._axis(axis)[0].isEmpty():
            raise TableError("no ids in common")
        order = table._axis(axis)[0].select(F.col("id").alias(id_column), F.col("ord").alias("__ord"))
        return table, metadata.join(order, id_column).orderBy("__ord").drop("__ord")

    def align_tree(self, tree: str, axis: str = "observation") -> tuple[MatrixTable, list[str]]:
        """Table and tips (of a newick tree) with the ids both have, in the order of the tips."""
        tips = newick_tips(tree)
        frame, _ = self._axis(axis)
        order = frame.sparkSession.createDataFrame(list(enumerate(tips)), "ord long, id string")
        shared = order.join(frame.select("id"), "id", "left_semi")
        if shared.isEmpty():
            raise TableError("no ids in common")
        return self.sort_order(shared, axis), [r["id"] for r in shared.orderBy("ord").collect()]


def newick_tips(tree: str) -> list[str]:
    """Names of the tips of a newick tree, from left to right."""
    tips: list[str] = []
    name, quoted, inner, comment, skip = "", False, False, False, False
    for c in tree:
        if comment:
            comment = c != "]"
        elif quoted:
            if c == "'":
                quoted = False
            else:
                name += c
        elif c == "'":
            quoted = True
        elif c == "[":
            comment = True
        elif c in "(),;":
            if c != "(" and not inner and name.strip():
                tips.append(name.strip())
            name, skip, inner = "", False, c == ")"
        elif c == ":":
            skip = True
        elif not skip:
            name += c
    return tips


def concat(tables: Sequence[MatrixTable], axis: str = "sample") -> MatrixTable:
    """All tables side by side."""
    return tables[0].concat(list(tables[1:]), axis) if len(tables) > 1 else tables[0]


