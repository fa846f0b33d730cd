"""Codecs, checksums and transforms as column functions, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import codecs
from ..errors import LimitExceeded, MalformedData, Unsupported
from . import hashes, transforms

RESULT = "data binary, input_bytes long, output_bytes long, error string"


def _binary(c: Column) -> Column:
    return c.cast("binary")


def compress(data: Column, codec: str, **options) -> Column:
    codecs.require(codec)

    @F.pandas_udf("binary")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else codecs.encode(codec, bytes(x), **options))

    return f(_binary(data))


def compress_frames(parts: Column, codec: str, **options) -> Column:
    """An array of binaries as one stream of frames, one for each."""
    if not codecs.require(codec).framed:
        raise Unsupported(f"{codec} has no frames")

    @F.pandas_udf("binary")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else b"".join(codecs.encode(codec, bytes(p), **options) for p in x))

    return f(parts)


def decompress(data: Column, codec: str, max_output: int = codecs.DEFAULT_OUTPUT, **options) -> Column:
    """Whole data; malformed data or too much of it fails the query."""
    codecs.require(codec)

    @F.pandas_udf("binary")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else codecs.decode(codec, bytes(x), max_output=max_output, **options))

    return f(_binary(data))


def decompress_sized(data: Column, size: Column, codec: str, max_output: int = codecs.DEFAULT_OUTPUT, **options) -> Column:
    """For codecs whose streams don't tell where they end: the decoded size of each row is given."""
    codecs.require(codec)

    @F.pandas_udf("binary")
    def f(s: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or pd.isna(k) else codecs.decode(codec, bytes(x), max_output=max_output, decoded_size=int(k), **options) for x, k in zip(s, n)], dtype="object")

    return f(_binary(data), size)


def _result(x, one) -> dict:
    try:
        out, n = one(bytes(x))
        return {"data": out, "input_bytes": n, "output_bytes": len(out), "error": None}
    except (MalformedData, Unsupported, LimitExceeded) as e:
        return {"data": None, "input_bytes": None, "output_bytes": None, "error": f"{type(e).__name__}: {e}"}


def try_decompress(data: Column, codec: str, max_output: int = codecs.DEFAULT_OUTPUT, frame: bool = False, **options) -> Column:
    """struct<data, input_bytes, output_bytes, error>; frame stops after the first frame."""
    found = codecs.require(codec)
    single = {"single": True} if frame and found.framed else {}

    @F.pandas_udf(RESULT)
    def f(s: pd.Series) -> pd.DataFrame:
        one = lambda x: found.decode(x, max_output=max_output, **single, **options)
        empty = {"data": None, "input_bytes": None, "output_bytes": None, "error": None}
        return pd.DataFrame([empty if x is None else _result(x, one) for x in s], columns=list(empty))

    return f(_binary(data))


def compress_with(data: Column, dictionary: Column, codec: str, **options) -> Column:
    """Compression with a dictionary per row, as joined by its id."""

    @F.pandas_udf("binary")
    def f(s: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else codecs.encode(codec, bytes(x), dictionary=None if y is None else bytes(y), **options) for x, y in zip(s, d)], dtype="object")

    return f(_binary(data), dictionary)


def decompress_with(data: Column, dictionary: Column, codec: str, max_output: int = codecs.DEFAULT_OUTPUT) -> Column:
    @F.pandas_udf("binary")
    def f(s: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else codecs.decode(codec, bytes(x), max_output=max_output, dictionary=None if y is None else bytes(y)) for x, y in zip(s, d)], dtype="object")

    return f(_binary(data), dictionary)


def zstd_dictionary_id(data: Column) -> Column:
    """The dictionary id that the first frame states, 0 for none: dictionaries are joined by it. Native."""
    byte = lambda at: F.conv(F.hex(F.substring(data, at, 1)), 16, 10).cast("long")
    flags = byte(5)
    at = 6 + F.when(flags.bitwiseAND(F.lit(0x20)) == 0, 1).otherwise(0)
    low = lambda n: sum(F.conv(F.hex(F.substring(data, at + i, F.lit(1))), 16, 10).cast("long") * (1 << 8 * i) for i in range(n))
    kind = flags.bitwiseAND(F.lit(3))
    return F.when(F.hex(F.substring(data, 1, 4)) == "28B52FFD", F.when(kind == 0, F.lit(0).cast("long")).when(kind == 1, low(1)).when(kind == 2, low(2)).otherwise(low(4)))


def zstd_frame_info(data: Column) -> Column:
    """array<struct<offset, size, skippable, decoded_size, window, dictionary_id, checksum>>."""

    @F.pandas_udf("array<struct<offset:long,size:long,skippable:boolean,decoded_size:long,window:long,dictionary_id:long,checksum:boolean>>")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else codecs.native.zstd_frame_info(bytes(x)))

    return f(_binary(data))


def zstd_frames(data: Column) -> Column:
    """array<struct<offset, size, skippable, decoded_size>>."""

    @F.pandas_udf("array<struct<offset:long,size:long,skippable:boolean,decoded_size:long>>")
    def f(s: pd.Series) -> pd.Series:
        names = ("offset", "size", "skippable", "decoded_size")
        return s.map(lambda x: None if x is None else [dict(zip(names, r)) for r in codecs.native.zstd_frames(bytes(x))])

    return f(_binary(data))


def zstd_seek_table(data: Column) -> Column:
    """array<struct<offset, size, decoded_offset, decoded_size>>, null without a table."""

    @F.pandas_udf("array<struct<offset:long,size:long,decoded_offset:long,decoded_size:long>>")
    def f(s: pd.Series) -> pd.Series:
        names = ("offset", "size", "decoded_offset", "decoded_size")

        def one(x):
            table = None if x is None else codecs.native.zstd_seek_table(bytes(x))
            return None if table is None else [dict(zip(names, r)) for r in table]

        return s.map(one)

    return f(_binary(data))


def zstd_range(data: Column, offset: Column, size: Column) -> Column:
    @F.pandas_udf("binary")
    def f(s: pd.Series, o: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else codecs.native.zstd_read_range(bytes(x), int(a), int(b)) for x, a, b in zip(s, o, n)])

    return f(_binary(data), offset, size)


_WIDE = {"xxh64", "crc64-xz"}


def checksum_range(data: Column, offset: Column | int, size: Column | int, algorithm: str, seed: int = 0) -> Column:
    """Checksum of some bytes from an offset (from 0) on; null where they reach beyond the value."""
    at, n = (x if isinstance(x, Column) else F.lit(x) for x in (offset, size))
    inside = (at >= 0) & (n >= 0) & (at + n <= F.octet_length(_binary(data)))
    return F.when(inside, checksum(F.substring(_binary(data), at + 1, n), algorithm, seed))


def checksum(data: Column, algorithm: str, seed: int = 0) -> Column:
    """crc32, sha256 and XXH64 of seed 42 are native; others run in Arrow batches.

    64-bit values are signed longs with the same bits; blake2sp and sha256 are hexadecimal.
    """
    name = algorithm.lower()
    if name == "crc32":
        return F.crc32(_binary(data))
    if name == "sha256":
        return F.sha2(_binary(data), 256)
    if name == "xxh64" and seed == 42:
        return F.when(data.isNotNull(), F.xxhash64(_binary(data)))
    functions = {"adler32": lambda b: __import__("zlib").adler32(b), "crc32c": hashes.crc32c, "crc64-xz": hashes.crc64_xz, "crc32-bzip2": hashes.crc32_bzip2, "xxh32": lambda b: hashes.xxh32(b, seed), "xxh64": lambda b: hashes.xxh64(b, seed), "blake2sp": lambda b: hashes.blake2sp(b).hex()}
    one = functions[name]
    signed = (lambda v: v - (1 << 64) if v >> 63 else v) if name in _WIDE else (lambda v: v)

    @F.pandas_udf("string" if name == "blake2sp" else "long")
    def f(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else signed(one(bytes(x))) for x in s], dtype="object" if name == "blake2sp" else "Int64")

    return f(_binary(data))


def transform(data: Column, name: str, encode: bool = True, distance: int = 1) -> Column:
    """Delta or a branch filter; the size stays."""

    @F.pandas_udf("binary")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else transforms.apply(name, bytes(x), encode, distance))

    return f(_binary(data))


def trained_dictionaries(df: DataFrame, key: str, data: str, size: int = 16_384, fan: int = 32) -> DataFrame:
    """(key, d): a zstandard dictionary per key from all of its texts.

    Each Arrow batch trains one per key; of up to `fan` of these another is trained on their contents, and
    so on until a key has one. No task holds more than a batch, or `fan` dictionaries, of a key.
    """
    piece = 512

    def trained(samples: list[bytes]) -> bytes:
        """Few or short samples train nothing: then they are the dictionary's content themselves."""
        try:
            return codecs.native.zstd_train(samples, size)
        except Unsupported:
            return b"".join(samples)[-size:]

    def first(batches):
        import pyarrow as pa

        for batch in batches:
            groups: dict = {}
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if x:
                    groups.setdefault(k, []).append(x)
            found = [(k, trained(v)) for k, v in groups.items()]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], batch.schema.field(0).type), pa.array([d for _, d in found], pa.binary())], ["key", "d"])

    def joined(part: pd.DataFrame) -> pd.DataFrame:
        whole = sorted(bytes(d) for d in part["d"])
        if len(whole) > 1:
            whole = [trained([d[i : i + piece] for d in whole for i in range(0, len(d), piece)])]
        return pd.DataFrame({"key": part["key"].iloc[:1], "d": whole})

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), _binary(F.col(data)).alias("data")).mapInArrow(first, f"key {kind}, d binary").checkpoint()
    while (most := out.groupBy("key").count().agg(F.max("count")).first()[0] or 0) > 1:
        groups = -(-most // fan)
        out = out.groupBy("key", F.pmod(F.xxhash64("d"), F.lit(groups)).alias("part")).applyInPandas(joined, f"key {kind}, d binary").checkpoint()
    return out.withColumnRenamed("key", key)


def chunked_checksum(df, key: str, order: str, data: str, algorithm: str, seed: int = 0):
    """Checksum per key over chunks in order: rows (key, checksum as hexadecimal, bytes).

    Chunks stream through in sorted order; only the state of the key at hand is held.
    """

    def run(batches):
        import pyarrow as pa

        current, state, size, started = None, None, 0, False
        out: list[tuple] = []
        for batch in batches:
            for k, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not started or k != current:
                    if started:
                        out.append((current, state.finish().hex(), size))
                    current, state, size, started = k, hashes.Accumulator(algorithm, seed), 0, True
                if d is not None:
                    state.update(d)
                    size += len(d)
        if started:
            out.append((current, state.finish().hex(), size))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["key", "checksum", "n_bytes"])

    keyed = df.select(F.col(key).cast("string").alias("key"), F.col(data).cast("binary").alias("data"), F.col(order).alias("order"))
    return keyed.repartition("key").sortWithinPartitions("key", "order").select("key", "data").mapInArrow(run, "key string, checksum string, n_bytes long")


def zip_preamble(data: Column) -> Column:
    """Bytes before a ZIP archive, such as a self-extracting stub."""

    @F.pandas_udf("binary")
    def f(s: pd.Series) -> pd.Series:
        import io

        from ..formats import zip_

        return s.map(lambda x: None if x is None else bytes(x)[: zip_.directory(io.BytesIO(bytes(x)))[3]])

    return f(_binary(data))
