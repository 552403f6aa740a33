"""Running totals and key lookups that do not depend on how rows are spread over keys."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.session import checkpointed

SLICE = "_slice"
MAX_HOT_KEYS = 1000


def sliced(df: DataFrame, groups: list[str], order: list[Column], slices: int | None = None) -> DataFrame:
    """Cut rows, ordered by group and ``order``, into range slices of about equal row counts.

    A group of any size spans as many slices as it needs.  Callers pass narrow rows (keys and numbers, no text).  The
    result is checkpointed, so both passes of ``running`` see the same slices even when executors are lost.
    """
    keys = [F.col(g) for g in groups] + order
    ranged = df.repartitionByRange(*([slices] if slices else []), *keys)
    return checkpointed(ranged.withColumn(SLICE, F.spark_partition_id()))


def running(df: DataFrame, groups: list[str], order: list[Column], totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add running aggregates per group (current row included) to ``sliced`` rows.

    ``totals`` maps an output name to ("sum" or "max", value).  Pass one aggregates each slice, and the few slice rows
    per group are accumulated; pass two is a window inside (group, slice) plus the carried value of earlier slices.
    ``order`` must be the strict order given to ``sliced``.
    """
    inside = Window.partitionBy(*groups, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*groups).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    functions = {"sum": F.sum, "max": F.max}
    per_slice = df.groupBy(*groups, SLICE).agg(
        *[functions[kind](value).alias(f"_t_{name}") for name, (kind, value) in totals.items()])
    carried = per_slice.select(*groups, SLICE, *[
        functions[kind](f"_t_{name}").over(earlier).alias(f"_c_{name}") for name, (kind, _) in totals.items()])
    local = df.select("*", *[functions[kind](value).over(inside).alias(name) for name, (kind, value) in totals.items()])
    joined = local.join(carried, groups + [SLICE])
    for name, (kind, _) in totals.items():
        carry = F.col(f"_c_{name}")
        total = F.coalesce(carry + F.col(name), F.col(name), carry) if kind == "sum" else F.greatest(name, carry)
        joined = joined.withColumn(name, total)
    return joined.drop(*[f"_c_{name}" for name in totals])


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], identity: list[str], how: str = "left",
           hot_rows: int = 100_000, salts: int = 64) -> DataFrame:
    """Join ``rows`` to a ``table`` that has one row per key, splitting keys that very many rows share.

    At most MAX_HOT_KEYS keys are split: the most frequent ones with at least ``hot_rows`` rows.  That list is bounded
    whatever the data, so it may be broadcast; any other key holds less than 1/MAX_HOT_KEYS of the rows.
    """
    hot = (rows.groupBy(*keys).count().filter(F.col("count") >= hot_rows)
           .orderBy(F.desc("count"), *keys).limit(MAX_HOT_KEYS).select(*keys, F.lit(True).alias("_hot")))
    salted = (rows.join(F.broadcast(hot), keys, "left")
              .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*identity), F.lit(salts)).cast("int"))
                          .otherwise(0)).drop("_hot"))
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copies = table.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return salted.join(copies, keys + ["_salt"], how).drop("_salt")
