"""Pairs of vectors of an axis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids that share a vector of the other axis and are paired by one task.
PART = 2000


class PairwiseOps:
    def pairwise_ids(self, axis: str = "sample", tri: bool = True, diag: bool = False) -> DataFrame:
        """``(i, j)``: pairs of ids; with ``tri`` each pair once, with ``diag`` ids with themselves.

        The result is quadratic in the axis, as asked for.
        """
        frame, _ = self._axis(axis)
        a, b = frame.select(F.col("id").alias("i"), F.col("ord").alias("oi")), frame.select(F.col("id").alias("j"), F.col("ord").alias("oj"))
        test = {(True, False): "oi < oj", (True, True): "oi <= oj", (False, False): "oi <> oj", (False, True): "true"}[tri, diag]
        return a.join(b, F.expr(test)).select("i", "j")

    def iter_pairwise(self, axis: str = "sample", tri: bool = True, diag: bool = False, dense: bool = True) -> DataFrame:
        """``(i, j, values_i, values_j)``: the pairs with their vectors."""
        v = self.vectors(axis, dense).select("id", "values")
        pairs = self.pairwise_ids(axis, tri, diag)
        return pairs.join(v.toDF("i", "values_i"), "i").join(v.toDF("j", "values_j"), "j").select("i", "j", "values_i", "values_j")

    def pairwise_dot(self, axis: str = "sample") -> DataFrame:
        """``(i, j, dot, shared)``: products of the pairs that share a non-zero, by joining on the other axis.

        Pairs without a common non-zero have a product of 0 and no row. A vector of the
        other axis that many ids share gives their square; its ids are split into parts,
        each joined with all of them, so that no task makes more than a part of the square.
        """
        frame, key = self._axis(axis)
        _, other = self._axis(self._other(axis))
        order = frame.select(F.col("id").alias(key), "ord")
        parts = self.cells.groupBy(other).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
        c = self.cells.join(order, key).join(parts, other)
        a = c.select(other, F.pmod(F.xxhash64(key), F.col("parts")).cast("int").alias("part"), F.col(key).alias("i"), F.col("ord").alias("oi"), F.col("value").alias("vi"))
        b = c.select(other, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col(key).alias("j"), F.col("ord").alias("oj"), F.col("value").alias("vj"))
        return a.join(b, [other, "part"]).where("oi < oj").groupBy("i", "j").agg(F.sum(F.col("vi") * F.col("vj")).alias("dot"), F.count("*").alias("shared"))
