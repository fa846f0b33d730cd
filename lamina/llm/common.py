"""What several operators share: the shared folder, row keys, hashing and global order."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Word of the corpus contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Identity that stands for a null doc_id wherever ids are ordered: nulls come last.
NULL_ID = (1 << 63) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set a temporary one serves a local master, whose
    tasks all see it; on a cluster that is an error."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found:
        return found
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="lamina-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """`df` behind a reliable checkpoint: its lineage is cut and a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Parquet tables in the shared folder. They are more compact than checkpoints and are dropped by name."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lamina-{uuid.uuid4().hex}"

    def table(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads, and let go of shuffle files of plans that have ended."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        jvm.System.gc()


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """With the doc_id, identifies a row by content; repeated rows share it, and share their result."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def aside(df: DataFrame, **needed: Column) -> DataFrame:
    """The caller's columns put away in one struct `_row`, beside columns of the operator's own naming,
    so that no name of the caller's can clash with one of these."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[c.alias(name) for name, c in needed.items()])


def beside(df: DataFrame, *results: str, **renamed: str) -> DataFrame:
    """The caller's columns again, then the results (name=column for a column of another name). A column
    of the caller's with the name of a result, in any case, gives way to it."""
    names = {**{r: r for r in results}, **renamed}
    taken = {n.lower() for n in names}
    own = [F.col("_row")[c].alias(c) for c in df.schema["_row"].dataType.names if c.lower() not in taken]
    return df.select(*own, *[F.col(c).alias(n) for n, c in names.items()])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_keys(docs: DataFrame, keys: DataFrame, how: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose (id, key) is among `keys`, or with how="left_anti" is not; columns as they are."""
    rows = aside(docs, id=F.col(id_col), key=row_key(id_col, text_col))
    asked = keys.select(F.col("id").alias("asked_id"), F.col("key").alias("asked_key"))
    return beside(rows.join(asked, (F.col("key") == F.col("asked_key")) & F.col("id").eqNullSafe(F.col("asked_id")), how))


def hashable(kind: T.DataType) -> bool:
    """Whether Spark can hash values of a type: maps and what holds them can't be."""
    if isinstance(kind, T.StructType):
        return all(hashable(f.dataType) for f in kind.fields)
    return hashable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def content_key(df: DataFrame) -> Column:
    """A hash of all columns and fields that can be hashed: equal for equal rows."""

    def of(column: Column, kind: T.DataType) -> list[Column]:
        if hashable(kind):
            return [column]
        return [x for f in kind.fields for x in of(column[f.name], f.dataType)] if isinstance(kind, T.StructType) else []

    return F.xxhash64(F.lit(0), *[x for f in df.schema.fields for x in of(F.col(f"`{f.name}`"), f.dataType)])


def globally_ordered(df: DataFrame, *order: Column | str, keep=stored) -> DataFrame:
    """Adds `_part` and `_at`: rows sorted by `_part`, then `_at`, are in the given order.

    A range exchange sorts the rows and each task numbers its own, so no task sees them all. Rows that
    are equal in the order are sorted by a hash of all their columns, so a task that runs again after a
    lost executor sends the same rows to the same place; wholly equal rows are spread by a running
    number, and it doesn't matter which of them is which.
    The outcome is checkpointed because range bounds come from samples: a second evaluation
    could draw others. For rows with texts `keep` can write a table instead, which is compressed.
    """
    n = partitions(df.sparkSession)
    ties = ["_same", "_tie"]
    ranged = df.withColumns({"_same": content_key(df), "_tie": F.monotonically_increasing_id()})
    ranged = ranged.repartitionByRange(n, *order, *ties).sortWithinPartitions(*order, *ties)
    at = F.monotonically_increasing_id()
    return keep(
        ranged.withColumn("_mid", at)
        .withColumn("_part", F.shiftright("_mid", 33))
        .withColumn("_at", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_mid", *ties)
    )


def before_each_part(ordered: DataFrame, *sums: tuple[str, Column]) -> DataFrame:
    """One row per `_part` with what all earlier parts add up to. As many rows as partitions."""
    from pyspark.sql import Window

    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ordered.groupBy("_part").agg(*[F.sum(c).alias(name) for name, c in sums])
    return totals.select("_part", *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(name) for name, _ in sums])


def let(value: Column, use) -> Column:
    """use(value) with the value evaluated once, however often `use` mentions it."""
    return F.transform(F.array(value), use)[0]


def numbered(df: DataFrame, *order: Column | str, name: str = "row", keep=stored) -> DataFrame:
    """Adds the global row number in the given order, from 0 and without gaps; equal rows are interchangeable."""
    rows = globally_ordered(df, *order, keep=keep)
    starts = before_each_part(rows, ("_start", F.lit(1).cast("long")))
    # one row per partition of the exchange above: the bound of this broadcast
    return rows.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


# --- numpy hashing in Arrow workers -----------------------------------------------------------

#: Odd multipliers of the two polynomial hashes, and their inverses modulo 2^64.
M1, M2 = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
I1, I2 = pow(M1, -1, 1 << 64), pow(M2, -1, 1 << 64)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^n modulo 2^64; a worker keeps the longest made so far."""
    if base not in _POWERS or len(_POWERS[base]) <= n:
        out = np.full(1 << max(16, n.bit_length()), base, dtype=np.uint64)
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Rolling:
    """Hashes of any range of a sequence from prefix sums: sum x[i] M^i, brought to a common exponent."""

    def __init__(self, digits: np.ndarray, base: int, inverse: int):
        n = len(digits)
        self.inverse = powers(inverse, n)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(digits * powers(base, n)[:n], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start])


class PrimeRolling:
    """Hashes of ranges like Rolling's, modulo two primes below 2^32: strings on which a modulus of 2^64
    fails, whatever its base, are told apart here. With `digits`, a digit per byte value, data are bytes."""

    PRIMES = (((1 << 31) - 1, 1_103_515_245), (4_294_967_291, 2_891_336_453))

    def __init__(self, data: np.ndarray, digits: np.ndarray | None = None):
        n = len(data)
        self.sides = []
        for prime, base in self.PRIMES:
            p = np.uint64(prime)
            terms = data % p if digits is None else (digits % p)[data]
            terms *= prime_powers(prime, base, n)[:n]
            terms %= p
            # below 2^32 each, so up to 2^32 of them add up without overflow
            prefix = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(terms, out=prefix[1:])
            self.sides.append((p, prefix, prime_powers(prime, pow(base, -1, prime), n)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        a, b = ((prefix[end] - prefix[start]) % p * inverse[start] % p for p, prefix, inverse in self.sides)
        return mix(a << np.uint64(32) | b)


def prime_powers(prime: int, base: int, n: int) -> np.ndarray:
    """base^0 .. base^n modulo a prime below 2^32, by doubling; a worker keeps the longest made so far."""
    key = -base * (1 << 32) - prime
    if key not in _POWERS or len(_POWERS[key]) <= n:
        size, p = 1 << max(16, n.bit_length()), np.uint64(prime)
        out = np.ones(size, dtype=np.uint64)
        done = 1
        while done < size:
            out[done : 2 * done] = out[:done] * np.uint64(pow(base, done, prime)) % p
            done *= 2
        _POWERS[key] = out
    return _POWERS[key][: n + 1]


def sliding_argmin(values: np.ndarray, width: int, bits: int = 32) -> np.ndarray:
    """For each window of `width` values the position of its smallest one, the leftmost among equals.

    Values keep their upper 64 - `bits` bits; there may be at most 2^bits of them.
    """
    n = len(values)
    if n < width:
        return np.zeros(0, dtype=np.int64)
    low = np.uint64((1 << bits) - 1)
    packed = (values & ~low) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = packed
    square = padded.reshape(blocks, width)
    left = np.minimum.accumulate(square, axis=1).ravel()
    right = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return (np.minimum(right[:m], left[width - 1 : width - 1 + m]) & low).astype(np.int64)


def chunks(texts: list[bytes], limit: int = 2_000_000):
    """Ranges of `texts` of about `limit` bytes; a longer text is a range of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def as_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]
