"""Foreign-key draws, junction pairs and uniqueness, without a sequential pass over rows."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seedplane.functions.generators import Cell

TRIES = 64


def draw_index(c: Cell, fk: str, parents: int) -> str:
    """Place of the drawn parent, 0 .. parents - 1; arithmetic, so no join where a parent's key follows its place."""
    return c.other(f"fk:{fk}").below(parents)


def draw_self(c: Cell, fk: str, percent_null: int = 20) -> str:
    """Place of an earlier row of the same table; NULL for the first row and for about a fifth."""
    own = c.other(f"fk:{fk}")
    return f"(case when {c.row} = 0 or {own.below(100, 1)} < {percent_null} then null else {own.draw()} % greatest({c.row}, 1) end)"


def draw_deferred(c: Cell, fk: str, parents: int) -> str:
    return c.other(f"deferred:{fk}").below(parents)


def affine(seed: int, n: int) -> tuple[int, int]:
    """(a, b) of a permutation row -> (a * row + b) mod n."""
    a = (seed * 2_654_435_761 + 40_503) % max(1, n) or 1
    while math.gcd(a, n) != 1:
        a += 1
    return a, (seed * 97 + 13) % max(1, n)


def junction_indices(row: str, counts: list[int], seed: int) -> list[str]:
    """Places of the parents of row, all combinations distinct for row < product of counts.

    The product is formed in decimals, as it may leave 64 bits.
    """
    n = math.prod(counts)
    a, b = affine(seed, n)
    k = f"cast((cast({row} as decimal(19, 0)) * {a} + {b}) % {n} as bigint)"
    out, below = [], 1
    for c in counts:
        out.append(f"cast(floor({k} / {below}) as bigint) % {c}" if below > 1 else f"{k} % {c}")
        below *= c
    return out


def pooled(parent: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Distinct NULL-free keys of a table with dense places 0.. in order: (pool_ix, columns).

    Places come from counts per partition of a range sort, so no task sees all rows.
    """
    spark = parent.sparkSession
    keys = parent.filter(" and ".join(f"{c} is not null" for c in columns)).select(*columns, F.col(order).alias("__order"))
    path = scratch(spark, "pool")
    keys.repartitionByRange("__order", *columns).sortWithinPartitions("__order", *columns).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    kept = spark.read.parquet(path)
    sizes = kept.groupBy("__part").count()
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.__part") < F.col("a.__part"), "left").groupBy(F.col("a.__part").alias("__part")).agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy("__order", *columns))
    return kept.withColumn("__rank", rank).join(before, "__part").select((F.col("__before") + F.col("__rank") - 1).alias("pool_ix"), *columns)


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder the cluster names in spark.checkpoint.dir, or a local one where it names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="seedplane-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def unique_rounds(rows: DataFrame, made: Callable[[DataFrame], DataFrame], groups: list[list[str]], tries: int = TRIES) -> DataFrame:
    """(__row, __attempt) of the rows that hold values no other row holds, group by group; NULL never conflicts.

    Each round, the rows left make their values anew with the next attempt; of equal values the smallest row
    keeps them, and only a row that wins in all groups is taken. Rows that never win are left out.
    """
    spark = rows.sparkSession
    accepted: DataFrame | None = None
    left = rows.select("__row")
    columns = sorted({c for g in groups for c in g})
    for attempt in range(tries):
        wishes = made(left.withColumn("__attempt", F.lit(attempt))).select("__row", "__attempt", *columns)
        for group in groups:
            known = " and ".join(f"{c} is not null" for c in group)
            if accepted is not None:
                wishes = wishes.join(accepted.select(*group), group, "left_anti")
            # NULL keys are dealt by row: they conflict with nothing and mustn't meet in one task
            spread = F.when(F.expr(known), F.lit(-1)).otherwise(F.col("__row"))
            place = F.row_number().over(Window.partitionBy(*group, spread).orderBy("__row"))
            wishes = wishes.withColumn("__place", place).filter("__place = 1").drop("__place")
        path = scratch(spark, "round")
        wishes.write.parquet(path)
        won = spark.read.parquet(path)
        accepted = won if accepted is None else accepted.unionByName(won)
        path = scratch(spark, "left")
        left.join(won.select("__row"), "__row", "left_anti").write.parquet(path)
        left = spark.read.parquet(path)
        if left.isEmpty():
            break
    return accepted.select("__row", "__attempt")
