"""Reproducible global shuffle and sharding: a Feistel permutation of row numbers with cycle walking.

Row numbers 0..n-1 are permuted by a Feistel network over the grid a x b, where a = ceil(sqrt n)
and b = ceil(n / a). Fewer than a cells of the grid lie beyond n. A row that falls on one is walked
on, that is permuted again, until it is below n; the cells beyond n are few, so the longest walk is
measured on them alone and the main expression is unrolled to just that length. The permuted number
p gives shard p mod shards and slot p div shards, so shard sizes differ by at most one (law `rows`).

Everything is a DataFrame expression. Results for edge cases: an empty table gives an empty result;
null doc_ids come first; repeated rows get places of their own; extra columns are carried along, and
one with the name of a result gives way to it.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import aside, beside, let, numbered, stored

PRIME = (1 << 31) - 1


def round_keys(seed: int, rounds: int) -> list[tuple[int, int]]:
    """Multiplier and increment of each round, both below the prime."""
    out = []
    for i in range(rounds):
        d = hashlib.sha256(f"{seed}:{i}".encode()).digest()
        out.append((1 + int.from_bytes(d[:8], "big") % (PRIME - 1), int.from_bytes(d[8:16], "big") % PRIME))
    return out


def grid(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def scrambled(x: str, m: int, c: int) -> str:
    """SQL of the round function: two modular steps with a square between, all below 2^62."""
    y = f"((({x}) % {PRIME}) * {m} + {c}) % {PRIME}"
    return f"((({y}) * ({y})) % {PRIME} * {m} + ({x}) % 65521 + {c}) % {PRIME}"


def network_sql(p: str, n: int, keys: list[tuple[int, int]]) -> list[tuple[str, str]]:
    """Rounds as (side, SQL) over columns l and r. Portable: DuckDB reads the same text."""
    a, b = grid(n)
    out = []
    for i, (m, c) in enumerate(keys):
        out.append(("l", f"(l + {scrambled('r', m, c)}) % {a}") if i % 2 == 0 else ("r", f"(r + {scrambled('l', m, c)}) % {b}"))
    return out


def whole(x: Column, by: int) -> Column:
    """Integer quotient; the plain operator would go through doubles."""
    return F.call_function("div", x.cast("long"), F.lit(by).cast("long"))


def permute(p: Column, n: int, keys: list[tuple[int, int]]) -> Column:
    """One pass of the network; a lambda binds each half, so that rounds don't copy expressions."""
    a, b = grid(n)

    def f(x: Column, m: int, c: int) -> Column:
        y = ((x % PRIME) * m + c) % PRIME
        return ((y * y) % PRIME * m + x % 65521 + c) % PRIME

    def step(s: Column, k: Column) -> Column:
        left, right = s["l"], s["r"]
        return F.when(
            k["left"], F.struct(((left + f(right, k["m"], k["c"])) % a).alias("l"), right.alias("r"))
        ).otherwise(F.struct(left.alias("l"), ((right + f(left, k["m"], k["c"])) % b).alias("r")))

    rounds = F.array(*[F.struct(F.lit(i % 2 == 0).alias("left"), F.lit(m).cast("long").alias("m"), F.lit(c).cast("long").alias("c")) for i, (m, c) in enumerate(keys)])
    start = F.struct(whole(p, b).alias("l"), (p % b).cast("long").alias("r"))
    return F.aggregate(rounds, start, step, lambda s: s["l"] * b + s["r"])


def walks(spark: SparkSession, n: int, keys: list[tuple[int, int]]) -> int:
    """How often the network must run so that every row is below n: measured on the cells beyond n."""
    a, b = grid(n)
    passes, cells = 1, spark.range(n, a * b)
    while not cells.isEmpty():
        passes += 1
        cells = cells.select(permute(F.col("id"), n, keys).alias("id")).where(F.col("id") >= n)
    return passes


def shuffled(df: DataFrame, *order: Column | str, seed: int = 7, rounds: int = 6, name: str = "place", keep=stored) -> DataFrame:
    """Adds the place of each row in a reproducible shuffle of the rows as ordered by `order`, names or expressions."""
    own = aside(df, **{f"k{i}": c for i, c in enumerate(order) if not isinstance(c, str)})
    rows = numbered(own, *[F.col("_row")[c] if isinstance(c, str) else F.col(f"k{i}") for i, c in enumerate(order)], name="row", keep=keep)
    n = rows.count()
    if n == 0:
        return beside(rows, **{name: "row"})
    keys = round_keys(seed, rounds)
    place = permute(F.col("row"), n, keys)
    for _ in range(walks(df.sparkSession, n, keys) - 1):
        place = let(place, lambda p: F.when(p < n, p).otherwise(permute(p, n, keys)))
    return beside(rows.withColumn("place", place), **{name: "place"})


def sharded(df: DataFrame, *order: Column | str, shards: int = 16, seed: int = 7, rounds: int = 6, keep=stored) -> DataFrame:
    """Adds `shard` and `slot`. Slots of a shard run from 0 without gaps; shard sizes differ by one at most."""
    placed = aside(df, **{f"k{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)})
    placed = shuffled(placed, *[f"k{i}" for i in range(len(order))], seed=seed, rounds=rounds, keep=keep)
    return beside(placed.withColumns({"shard": (F.col("place") % shards).cast("int"), "slot": whole(F.col("place"), shards)}), "shard", "slot")
