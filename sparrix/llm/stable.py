"""A sample that reruns and partitionings do not change and that only grows with the data.

Each key has a salted hash between 0 and 1 and is chosen if it is below the threshold of
its stratum. A threshold is the fixed rate of its stratum, which is a parameter and does
not depend on the data; so neither late rows nor rows sent again move it. It is raised by
the thresholds stored by an earlier run, if they are passed in, and never lowered.

A key may come with several strata, as rows are sent again with other values. Each of them
stays with the key for good, and the key is chosen if any of them chooses it: what an
earlier stratum chose, a later one does not take back.

Edge cases: a null key is never chosen; a null stratum is a stratum of its own; repeated
rows count once; a null delivery counts as the first one there is; an empty table gives an
empty sample.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stored thresholds up to this number are broadcast to the keys, more are shuffled.
BROADCAST_STRATA = 50_000
#: A stratum may hold any part of all keys, so it is joined in so many parts.
PARTS = 64


def unit_hash(key: Column, salt: str) -> Column:
    """The key's place between 0 and 1; equal for equal keys everywhere, in any system that has MD5."""
    digest = F.substring(F.md5(F.concat(F.lit(f"{salt}|"), key.cast("string"))), 1, 13)
    return F.conv(digest, 16, 10).cast("double") / F.lit(float(1 << 52))


def fixed_rate(stratum: Column, rate: float, rates: Mapping[str | None, float]) -> Column:
    """The rate of a stratum by its name, ``rate`` for those that are not named."""
    out = F.lit(float(rate))
    for name, own in rates.items():
        out = F.when(stratum.eqNullSafe(F.lit(name)), F.lit(float(own))).otherwise(out)
    return out


class StableSample:
    """Parameters: the key, stratum and delivery columns, the rate, or one for each stratum
    by name (None for the null stratum) with ``rate`` for all others, a salt, and optionally
    the thresholds (stratum, threshold) stored by an earlier run."""

    def __init__(
        self, df: DataFrame, key: str, stratum: Column, delivery: str, rate: float = 0.1, rates: Mapping[str | None, float] | None = None,
        salt: str = "sparrix", earlier: DataFrame | None = None,
    ):
        rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), stratum.cast("string").alias("stratum"), F.coalesce(F.col(delivery).cast("long"), F.lit(-1)).alias("delivery"))
        rows = rows.groupBy("key", "stratum").agg(F.min("delivery").alias("delivery"))
        rows = rows.select("*", unit_hash(F.col("key"), salt).alias("u"), fixed_rate(F.col("stratum"), rate, rates or {}).alias("threshold"))
        self.keys = rows if earlier is None else self._raised(rows, earlier)

    @staticmethod
    def _raised(rows: DataFrame, earlier: DataFrame) -> DataFrame:
        named = [F.coalesce("stratum", F.lit("")).alias("s"), F.col("stratum").isNull().alias("none")]
        stored = earlier.groupBy("stratum").agg(F.max("threshold").alias("stored")).select(*named, "stored")
        on = ["s", "none"]
        rows = rows.select("*", *named)
        if stored.count() <= BROADCAST_STRATA:
            stored = F.broadcast(stored)
        else:
            stored = stored.select("*", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
            rows, on = rows.select("*", F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int").alias("part")), [*on, "part"]
        raised = rows.join(stored, on, "left").withColumn("threshold", F.greatest("threshold", F.coalesce("stored", F.lit(0.0))))
        return raised.select("key", "stratum", "delivery", "u", "threshold")

    def thresholds(self) -> DataFrame:
        """``(stratum, threshold, keys, chosen)``, to be stored and passed to a later run."""
        return self.keys.groupBy("stratum").agg(F.max("threshold").alias("threshold"), F.count("*").alias("keys"), F.count(F.when(F.col("u") < F.col("threshold"), 1)).alias("chosen"))

    def sample(self) -> DataFrame:
        """``(key, delivery)`` of the chosen keys, each once, with the first delivery that chose it."""
        return self.keys.where("u < threshold").groupBy("key").agg(F.min("delivery").alias("delivery"))


def lost_keys(df: DataFrame, deliveries: list[int], delivery: str, sample) -> DataFrame:
    """``(key, delivery)``: keys that ``sample`` chooses from the rows up to a delivery and not from those up to the next.

    ``sample`` makes a ``StableSample`` of a frame. The result is empty.
    """
    upto = [sample(df.where(F.coalesce(F.col(delivery), F.lit(-1)) <= d)).sample().select("key") for d in deliveries]
    out = None
    for d, old, new in zip(deliveries[1:], upto[:-1], upto[1:], strict=True):
        part = old.join(new, "key", "left_anti").select("key", F.lit(d).cast("long").alias("delivery"))
        out = part if out is None else out.unionByName(part)
    return out
