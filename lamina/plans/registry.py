"""Queries of the archive engine and their SQL.

The tables hold no archives, so queries make them from texts and read them back: SQL then states what
must come out from the plain columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns, detect, native
from ..operators import mutate
from ..sources import archive
from . import catalog, rar_samples

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name or another, with DuckDB SQL for the same rows."""

    def add(f):
        _QUERIES[name or f.__name__] = f
        if sql is not None:
            _SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.col("text").cast("binary").alias("body"))


def as_entries(docs: DataFrame) -> DataFrame:
    """Documents as files of one archive per source."""
    return docs.select(F.col("source").alias("archive"), F.concat(F.lit("docs/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.lit(0o640).alias("mode"), (F.lit(1_600_000_000) + F.col("doc_id")).cast("timestamp").alias("mtime"), "body")


DIGEST = "SELECT source AS archive, 'docs/' || lang || '/' || doc_id || '.txt' AS path, octet_length(encode(text)) AS size, sha256(text) AS sha256 FROM documents"


def digest(entries: DataFrame) -> DataFrame:
    return entries.select("archive", "path", "size", F.sha2("body", 256).alias("sha256"))


def roundtrip(fmt: str, read: dict | None = None, **how):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        packed = archive.packed(as_entries(documents(spark, sf_dir)), fmt, **how)
        return digest(archive.entries_of(packed, archive="archive", includeBody=True, **(read or {})))

    return run


for _name, _fmt, _read, _how in [
    ("scan_tar", "tar", {}, {}),
    ("scan_ar", "ar", {}, {}),
    *[(f"scan_cpio_{d}", "cpio", {}, {"dialect": d}) for d in ("newc", "crc", "odc", "binary")],
    ("scan_cpio_binary_big", "cpio", {}, {"dialect": "binary", "byte_order": "big"}),
    *[(f"scan_zip_{m}", "zip", {}, {"method": m}) for m in ("stored", "deflated", "bzip2", "lzma", "zstd", "xz")],
    ("scan_zip_stream", "zip", {"mode": "stream"}, {}),
    ("scan_zip_descriptor", "zip", {}, {"descriptor": True}),
    ("scan_zip_preamble", "zip", {"format": "zip"}, {"preamble": b"#!/bin/sh\nstub\n"}),
    *[(f"scan_7z_{m}", "7z", {}, {"method": m}) for m in ("copy", "lzma", "lzma2", "bzip2", "deflate", "zstd")],
    ("scan_7z_delta", "7z", {}, {"filters": (("delta", 4),)}),
    ("scan_7z_solid", "7z", {}, {"solid": 1000}),
    *[(f"scan_tar_{c}", "tar", {}, {"compression": c}) for c in ("gzip", "bzip2", "xz", "zstd", "lzip")],
    ("scan_named_format", "tar", {"format": "TAR"}, {}),
]:
    query(DIGEST, _name)(roundtrip(_fmt, _read, **_how))


@query(DIGEST)
def scan_7z_ppmd(spark, sf_dir):
    """PPMd is dear by the byte: solid blocks are coded and decoded apart."""
    packed = archive.packed_by_block(as_entries(documents(spark, sf_dir)), method="ppmd")
    return digest(archive.entries_by_block(packed, archive="archive", includeBody=True))


for _f, _n in (("zip", 20_000), ("7z", 10_000), ("tar", 15_000)):

    @query(DIGEST, f"scan_{_f}_volumes")
    def scan_volumes(spark, sf_dir, fmt=_f, size=_n):
        """Archives in volumes, joined again."""
        parts = archive.packed_volumes(as_entries(documents(spark, sf_dir)), fmt, size)
        return digest(archive.entries_of_volumes(parts, includeBody=True))


@query(DIGEST)
def scan_tar_seekable(spark, sf_dir):
    """TAR in zstandard frames with a seek table: headers and bodies are read through the table."""
    packed = archive.packed(as_entries(documents(spark, sf_dir)), "tar")
    framed = packed.select("archive", columns.compress(F.col("content"), "zstd", frame_size=1 << 16).alias("content"))
    return digest(archive.entries_of(framed, archive="archive", includeBody=True))


for _v in (4, 5):
    for _p in (False, True):

        @query(DIGEST, f"scan_rar{_v}" + "_packed" * _p)
        def scan_rar(spark, sf_dir, version=_v, packed=_p):
            content = rar_samples.archived(as_entries(documents(spark, sf_dir)), version, packed)
            return digest(archive.entries_of(content, archive="archive", includeBody=True))


@query("SELECT source AS archive, lang, count(*) AS files, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY ALL")
def archive_statistics(spark, sf_dir):
    """Sizes by directory from metadata alone: no body is decoded."""
    packed = archive.packed(as_entries(documents(spark, sf_dir)), "zip")
    entries = archive.entries_of(packed, archive="archive")
    return entries.groupBy("archive", F.split("entry_key", "/")[1].alias("lang")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query("SELECT source AS archive, 'docs/' || lang || '/' || doc_id || '.txt' AS path, 1600000000 + doc_id AS seconds, 'rw-r-----' AS permissions, 'file' AS type, 'zip' AS format FROM documents")
def archive_metadata(spark, sf_dir):
    packed = archive.packed(as_entries(documents(spark, sf_dir)), "zip", method="stored")
    e = archive.entries_of(packed, archive="archive")
    return e.select("archive", "path", F.unix_timestamp("mtime").alias("seconds"), native.permissions(F.col("mode")).alias("permissions"), "type", "format")


@query("SELECT source AS archive, 'gzip,zstd' AS outer_codecs, count(*) AS files FROM documents GROUP BY source")
def outer_layers(spark, sf_dir):
    packed = archive.packed(as_entries(documents(spark, sf_dir)), "tar", compression="zstd")
    wrapped = packed.select("archive", columns.compress(F.col("content"), "gzip").alias("content"))
    e = archive.entries_of(wrapped, archive="archive")
    return e.groupBy("archive", F.array_join("outer_codecs", ",").alias("outer_codecs")).agg(F.count("*").alias("files"))


@query("SELECT source AS archive, 'LimitExceeded' AS error FROM documents GROUP BY source HAVING count(*) > 20")
def limit_entry_count(spark, sf_dir):
    packed = archive.packed(as_entries(documents(spark, sf_dir)), "tar")
    e = archive.entries_of(packed, archive="archive", maxEntryCount=20, onError="permissive")
    return e.where("_error is not null").select("archive", F.split("_error", ":")[0].alias("error"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE source = 'src1' AND lang = 'en'")
def glob_filter(spark, sf_dir):
    # what decides about whole archives is applied before any is made or read
    packed = archive.packed(as_entries(documents(spark, sf_dir)).where("archive = 'src1'"), "tar")
    e = archive.entries_of(packed, archive="archive", includeBody=True).where(native.path_matches(F.col("path"), "glob:docs/{en,xx}/*.txt"))
    return e.select(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long").alias("doc_id"), F.sha2("body", 256).alias("sha256"))


for _e in ("traditional", "aes-128", "aes-192", "aes-256"):

    @query(DIGEST, f"zip_{_e.replace('-', '')}")
    def zip_encrypted(spark, sf_dir, scheme=_e):
        packed = archive.packed(as_entries(documents(spark, sf_dir)), "zip", encrypt=scheme, password="open sesame")
        return digest(archive.entries_of(packed, archive="archive", includeBody=True, password="open sesame"))


@query(DIGEST)
def sevenz_encrypted(spark, sf_dir):
    packed = archive.packed(as_entries(documents(spark, sf_dir)), "7z", method="lzma", password="open sesame", encrypt_headers=True)
    return digest(archive.entries_of(packed, archive="archive", includeBody=True, password="open sesame"))


# --- codecs ---------------------------------------------------------------------------------------

TEXTS = "SELECT doc_id, octet_length(encode(text)) AS n_bytes, sha256(text) AS sha256 FROM documents"


def codec_roundtrip(codec: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = documents(spark, sf_dir)
        packed = docs.select("doc_id", columns.compress(F.col("body"), codec).alias("c"))
        plain = packed.select("doc_id", columns.decompress(F.col("c"), codec).alias("p"))
        return plain.select("doc_id", F.octet_length("p").cast("long").alias("n_bytes"), F.sha2("p", 256).alias("sha256"))

    return run


for _c in ("bzip2", "compress", "deflate", "deflate64", "gzip", "lz4", "lz4-block", "lzip", "lzma", "lzma-raw", "lzma2", "xz", "zlib", "zstd"):
    query(TEXTS, f"codec_{_c.replace('-', '_')}")(codec_roundtrip(_c))


@query(TEXTS)
def codec_ppmd(spark, sf_dir):
    """The stream has no end of its own: sizes are kept beside it."""
    packed = documents(spark, sf_dir).select("doc_id", F.octet_length("body").alias("n"), columns.compress(F.col("body"), "ppmd").alias("c"))
    plain = packed.select("doc_id", columns.decompress_sized(F.col("c"), F.col("n"), "ppmd").alias("p"))
    return plain.select("doc_id", F.octet_length("p").cast("long").alias("n_bytes"), F.sha2("p", 256).alias("sha256"))


@query("SELECT c AS codec, doc_id, c AS detected FROM documents, (VALUES ('bzip2'), ('compress'), ('gzip'), ('lz4'), ('lzip'), ('xz'), ('zlib'), ('zstd')) v(c)")
def detect_codecs(spark, sf_dir):
    docs = documents(spark, sf_dir)
    kinds = ("bzip2", "compress", "gzip", "lz4", "lzip", "xz", "zlib", "zstd")
    packed = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("codec"), columns.compress(F.col("body"), k).alias("c")) for k in kinds])).alias("x"))
    return packed.select("x.codec", "doc_id", detect.detected(F.col("x.c")).alias("detected"))


@query("SELECT source AS archive, f AS format, f AS detected FROM (SELECT DISTINCT source FROM documents), (VALUES ('7z'), ('ar'), ('cpio'), ('rar'), ('tar'), ('zip')) v(f)")
def detect_archives(spark, sf_dir):
    """One shuffle of the documents; each group's rows are packed in turn."""
    entries = as_entries(documents(spark, sf_dir))
    found = [archive.packed_all(entries, ("7z", "ar", "cpio", "tar", "zip")).drop("volume")]
    found.append(rar_samples.archived(entries, 5, False).select("archive", F.lit("rar").alias("format"), "content"))
    return found[0].unionByName(found[1]).select("archive", "format", detect.detected(F.col("content")).alias("detected"))


@query("SELECT doc_id, octet_length(encode(text)) > 2000 AS over_limit FROM documents")
def limit_output(spark, sf_dir):
    docs = documents(spark, sf_dir)
    r = docs.select("doc_id", columns.try_decompress(columns.compress(F.col("body"), "zstd"), "zstd", max_output=2000).alias("r"))
    return r.select("doc_id", F.coalesce(F.col("r.error").startswith("LimitExceeded"), F.lit(False)).alias("over_limit"))


@query("SELECT doc_id, octet_length(encode(text)) AS first_bytes, 2 * octet_length(encode(text)) AS all_bytes FROM documents")
def codec_frames(spark, sf_dir):
    """The first of two gzip members, and both."""
    two = documents(spark, sf_dir).select("doc_id", columns.compress(F.col("body"), "gzip").alias("c")).select("doc_id", F.concat("c", "c").alias("c"))
    return two.select("doc_id", columns.try_decompress(F.col("c"), "gzip", frame=True).alias("f"), columns.try_decompress(F.col("c"), "gzip").alias("a")).select("doc_id", F.col("f.output_bytes").alias("first_bytes"), F.col("a.output_bytes").alias("all_bytes"))


@query("SELECT doc_id, greatest(1, ceil(octet_length(encode(text)) / 1000.0))::BIGINT AS frames, substr(hex(encode(text)), 3001, 200) AS part FROM documents")
def zstd_seekable(spark, sf_dir):
    packed = documents(spark, sf_dir).select("doc_id", columns.compress(F.col("body"), "zstd", frame_size=1000).alias("c"))
    return packed.select("doc_id", F.size(columns.zstd_seek_table(F.col("c"))).cast("long").alias("frames"), F.hex(columns.zstd_range(F.col("c"), F.lit(1500), F.lit(100))).alias("part"))


@query("SELECT lang, count(*) AS documents, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY lang")
def zstd_dictionaries(spark, sf_dir):
    """One dictionary per language, then each text with its language's dictionary."""
    docs = documents(spark, sf_dir)
    trained = columns.trained_dictionaries(docs, "lang", "body", 8192)
    # one dictionary of at most 8 KiB per language
    met = docs.join(F.broadcast(trained), "lang")
    there = met.select("lang", "d", columns.compress_with(F.col("body"), F.col("d"), "zstd").alias("c"))
    return there.select("lang", F.octet_length(columns.decompress_with(F.col("c"), F.col("d"), "zstd")).alias("n")).groupBy("lang").agg(F.count("*").alias("documents"), F.sum("n").alias("bytes"))


for _t in ("delta", "x86", "ppc", "ia64", "arm", "thumb", "sparc", "arm64", "riscv"):

    @query(TEXTS, f"transform_{_t}")
    def transform_roundtrip(spark, sf_dir, name=_t):
        docs = documents(spark, sf_dir)
        there = docs.select("doc_id", columns.transform(F.col("body"), name, True, 3).alias("t"))
        back = there.select("doc_id", columns.transform(F.col("t"), name, False, 3).alias("p"))
        return back.select("doc_id", F.octet_length("p").cast("long").alias("n_bytes"), F.sha2("p", 256).alias("sha256"))


@query("SELECT * FROM (VALUES ('arm', 'fdffffeb', 'ffffffeb'), ('ppc', '48000005', '48000005'), ('riscv', '97523412e7808267', '17710e2812345678'), ('x86', 'e80100000090', 'e80600000090')) t(name, plain, encoded)")
def transform_vectors(spark, sf_dir):
    """Branches whose converted form follows from the instruction sets: the first of each stands at place 0."""
    cases = [("x86", "e80100000090"), ("arm", "fdffffeb"), ("ppc", "48000005"), ("riscv", "97523412e7808267")]
    out = None
    for name, plain in cases:
        one = spark.range(1).select(F.lit(name).alias("name"), F.lit(plain).alias("plain"), F.lower(F.hex(columns.transform(F.unhex(F.lit(plain)), name, True))).alias("encoded"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT * FROM (VALUES ('lz4', 'abc'), ('compress', 'abcabcabc'), ('deflate64', 'abc'), ('lz4-block', 'aaaaaaaaaaaaaaaaaaaaa'), ('zlib', 'a')) t(codec, plain)")
def codec_vectors(spark, sf_dir):
    """Streams spelled out by hand from the formats, decoded by the codecs written here."""
    #: An LZ4 frame with one stored block, nine-bit codes 97 98 99 257 259 258, a stored deflate block, a literal with a match of one byte back.
    cases = [("lz4", "04224d186440a70300008061626300000000ff53d132"), ("compress", "1f9d90" + _nine_bits([97, 98, 99, 257, 259, 258])), ("deflate64", "010300fcff616263"), ("lz4-block", "1b610100506161616161"), ("zlib", "789c4b040000620062")]
    out = None
    for codec, data in cases:
        one = spark.range(1).select(F.lit(codec).alias("codec"), columns.decompress(F.unhex(F.lit(data)), codec).cast("string").alias("plain"))
        out = one if out is None else out.unionByName(one)
    return out


def _nine_bits(codes: list[int]) -> str:
    """LZW codes of nine bits, the lowest bits first."""
    return sum(c << 9 * i for i, c in enumerate(codes)).to_bytes(-(-9 * len(codes) // 8), "little").hex()


@query("SELECT * FROM (VALUES ('adler32', '123456789', '091e01de'), ('blake2sp', '', 'dd0e891776933f43c7d032b08a917e25741f8aa9a12c12e1cac8801500f2ca4f'), ('crc32', '123456789', 'cbf43926'), ('crc32-bzip2', '123456789', 'fc891918'), ('crc32c', '123456789', 'e3069283'), ('crc64-xz', '123456789', '995dc9bbdf1939fa'), ('xxh32', '', '02cc5d05'), ('xxh32', 'abc', '32d153ff'), ('xxh64', '', 'ef46db3751d8e999'), ('xxh64', 'abc', '44bc2cf5ad770999')) t(name, plain, checksum)")
def checksum_vectors(spark, sf_dir):
    """The published check values of the algorithms."""
    out = None
    for name, plain in (("adler32", "123456789"), ("blake2sp", ""), ("crc32", "123456789"), ("crc32-bzip2", "123456789"), ("crc32c", "123456789"), ("crc64-xz", "123456789"), ("xxh32", ""), ("xxh32", "abc"), ("xxh64", ""), ("xxh64", "abc")):
        found = columns.checksum(F.lit(plain).cast("binary"), name)
        text = found if name == "blake2sp" else F.lower(F.lpad(F.hex(found), 16 if "64" in name else 8, "0"))
        one = spark.range(1).select(F.lit(name).alias("name"), F.lit(plain).alias("plain"), text.alias("checksum"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT doc_id, 1 AS frames, octet_length(encode(text)) AS decoded_size, true AS checksum, 0 AS dictionary_id, sha256(substr(text, 1, 0)) AS empty_part FROM documents")
def zstd_information(spark, sf_dir):
    c = documents(spark, sf_dir).select("doc_id", columns.compress(F.col("body"), "zstd", checksum=True).alias("c"))
    i = c.select("doc_id", columns.zstd_frame_info(F.col("c")).alias("i"), columns.zstd_dictionary_id(F.col("c")).alias("dictionary_id"), columns.checksum_range(F.col("c"), 0, 0, "sha256").alias("empty_part"))
    return i.select("doc_id", F.size("i").alias("frames"), F.col("i")[0]["decoded_size"].alias("decoded_size"), F.col("i")[0]["checksum"].alias("checksum"), "dictionary_id", "empty_part")


# --- checksums ------------------------------------------------------------------------------------

_BYTES = "list_transform(range(octet_length(encode(text))), lambda i: ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::INTEGER)"


@query(TEXTS)
def checksum_sha256(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", F.octet_length("body").cast("long").alias("n_bytes"), columns.checksum(F.col("body"), "sha256").alias("sha256"))


@query(f"SELECT conv_id, turn, (((octet_length(encode(text)) + coalesce(list_sum(list_transform(range(len(b)), lambda i: (len(b) - i) * b[i + 1])), 0)) % 65521) * 65536 + (1 + coalesce(list_sum(b), 0)) % 65521)::BIGINT AS adler32, coalesce(list_sum(b), 0)::BIGINT AS byte_sum FROM (SELECT conv_id, turn, text, {_BYTES} AS b FROM conversations)")
def checksum_native_sums(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("body", F.col("text").cast("binary"))
    return turns.select("conv_id", "turn", native.adler32(F.col("body")).alias("adler32"), native.byte_sum(F.col("body")).alias("byte_sum"))


def _crc_sql(polynomial: int) -> str:
    """CRC over the bytes of a text, four bits at a time, the low ones first."""
    rest = []
    for i in range(16):
        for _ in range(4):
            i = i >> 1 ^ (polynomial if i & 1 else 0)
        rest.append(i)
    table = "CASE xor(a, b) & 15 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(rest)) + " END"
    halves = "list_transform(range(2 * octet_length(encode(text))), lambda i: ('0x' || substr(hex(encode(text)), (i + 2 - 2 * (i % 2))::INTEGER, 1))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {halves}), lambda a, b: xor(a >> 4, ({table})::BIGINT)), 4294967295)"


@query(f"SELECT conv_id, turn, {_crc_sql(0xEDB88320)} AS crc32, {_crc_sql(0x82F63B78)} AS crc32c FROM conversations")
def checksum_crc(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("body", F.col("text").cast("binary"))
    return turns.select("conv_id", "turn", columns.checksum(F.col("body"), "crc32").alias("crc32"), columns.checksum(F.col("body"), "crc32c").alias("crc32c"))


@query()
def checksum_others(spark, sf_dir):
    """Held against known answers and the libraries in the tests: SQL has none of these."""
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", *[columns.checksum(F.col("body"), a).alias(a.replace("-", "_")) for a in ("adler32", "crc64-xz", "crc32-bzip2", "xxh32", "xxh64", "blake2sp")], columns.checksum(F.col("body"), "xxh64", 42).alias("xxh64_42"))


# --- paths, modes, times --------------------------------------------------------------------------

_PATHS = "(VALUES ('a/b'), ('a//./b'), ('a\\b'), ('/a'), ('C:x'), ('../a'), ('a/..'), ('.'), (''), ('ü/é.txt'))"


@query(f"SELECT o_orderkey, p AS path, v AS valid, CASE WHEN v THEN array_to_string(list_filter(regexp_split_to_array(p, '[/\\\\]'), lambda x: x NOT IN ('', '.')), '/') END AS entry_key FROM (SELECT o_orderkey, s || '/' || o_orderstatus AS p, NOT regexp_matches(s || '/' || o_orderstatus, '^[/\\\\]|^.:|(^|[/\\\\])\\.\\.([/\\\\]|$)') AS v FROM orders, {_PATHS} t(s))")
def entry_paths(spark, sf_dir):
    shapes = ["a/b", "a//./b", "a\\b", "/a", "C:x", "../a", "a/..", ".", "", "ü/é.txt"]
    p = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array(*[F.lit(s) for s in shapes])).alias("s"), "o_orderstatus").select("o_orderkey", F.concat("s", F.lit("/"), "o_orderstatus").alias("path"))
    return p.select("o_orderkey", "path", native.path_valid(F.col("path")).alias("valid"), native.entry_key(F.col("path")).alias("entry_key"))


@query("SELECT o_orderkey, m AS mode, " + " || ".join(f"CASE WHEN m & {1 << 8 - i} != 0 THEN '{'rwx'[i % 3]}' ELSE '-' END" for i in range(9)) + " AS permissions, CASE (m >> 12) WHEN 8 THEN 'file' WHEN 0 THEN 'file' WHEN 4 THEN 'directory' WHEN 10 THEN 'symlink' ELSE 'other' END AS type, m & 511 AS again FROM (SELECT o_orderkey, (o_orderkey * 7919 % 65536)::INTEGER AS m FROM orders)")
def posix_modes(spark, sf_dir):
    m = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 7919 % 65536).cast("int").alias("mode"))
    return m.withColumn("permissions", native.permissions(F.col("mode"))).withColumn("type", native.mode_type(F.col("mode"))).withColumn("again", native.mode_of_permissions(F.col("permissions")))


@query("SELECT o_orderkey, epoch(o_orderdate)::BIGINT // 2 * 2 AS dos_seconds, epoch(o_orderdate)::BIGINT AS windows_seconds FROM orders")
def archive_times(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("t"))
    date = (F.year("t") - 1980) * 512 + F.month("t") * 32 + F.dayofmonth("t")
    time = F.hour("t") * 2048 + F.minute("t") * 32 + F.call_function("div", F.second("t"), F.lit(2))
    ticks = (F.unix_timestamp("t") + 11_644_473_600) * 10_000_000
    return o.select("o_orderkey", F.unix_timestamp(native.dos_time(date.cast("int"), time.cast("int"))).alias("dos_seconds"), F.unix_timestamp(native.windows_time(ticks)).alias("windows_seconds"))


# --- updates --------------------------------------------------------------------------------------


def stored_entries(spark, sf_dir, includeBody: bool = True) -> DataFrame:
    packed = archive.packed(as_entries(documents(spark, sf_dir)), "tar")
    return archive.entries_of(packed, archive="archive", includeBody=includeBody)


@query("SELECT source AS archive, 'docs/' || lang || '/' || doc_id || '.txt' AS entry_key, CASE WHEN doc_id % 10 = 3 THEN sha256('new') ELSE sha256(text) END AS sha256 FROM documents WHERE doc_id % 10 != 5 UNION ALL SELECT DISTINCT source, 'added.txt', sha256('more') FROM documents")
def update_put_delete(spark, sf_dir):
    e = stored_entries(spark, sf_dir).select("archive", "path", "entry_key", "type", "size", "link_target", "body")
    number = F.regexp_extract("entry_key", r"(\d+)\.txt$", 1).cast("int")
    fresh = e.where(number % 10 == 3).withColumn("body", F.lit(b"new"))
    added = e.select("archive").distinct().select("archive", F.lit("added.txt").alias("path"), F.lit("added.txt").alias("entry_key"), F.lit("file").alias("type"), F.lit(b"more").alias("body"))
    out = mutate.put(mutate.put(mutate.delete(e, F.coalesce(number % 10 == 5, F.lit(False))), fresh), added)
    again = archive.entries_of(archive.packed(out, "zip", order="entry_key"), archive="archive", includeBody=True)
    return again.select("archive", "entry_key", F.sha2("body", 256).alias("sha256"))


@query("SELECT source AS archive, 'docs/' || lang || '/' || doc_id || '.txt' AS entry_key, CASE WHEN doc_id % 10 = 3 THEN sha256('new') ELSE sha256(text) END AS sha256, doc_id % 10 != 3 AS copied FROM documents")
def update_zip_verbatim(spark, sf_dir):
    """Entries that an update leaves alone are copied as they are stored, without being unpacked."""
    first = archive.packed(as_entries(documents(spark, sf_dir)), "zip", method="bzip2")
    e = archive.entries_of(first, archive="archive", includeRaw=True).select("archive", "path", "entry_key", "type", "size", "mode", "mtime", "zip")
    fresh = F.regexp_extract("entry_key", r"(\d+)\.txt$", 1).cast("int") % 10 == 3
    out = e.withColumns({"body": F.when(fresh, F.lit(b"new")), "zip": F.when(~fresh, F.col("zip"))})
    again = archive.entries_of(archive.packed(out, "zip", order="entry_key", method="deflated"), archive="archive", includeBody=True)
    return again.select("archive", "entry_key", F.sha2("body", 256).alias("sha256"), (F.col("zip.method") == "bzip2").alias("copied"))


@query("SELECT source AS archive, k AS entry_key, t AS type, l AS link_target FROM (SELECT DISTINCT source FROM documents), (VALUES ('new', 'directory', NULL), ('new/link', 'symlink', '../docs')) v(k, t, l)")
def update_create(spark, sf_dir):
    e = stored_entries(spark, sf_dir, False).select("archive", "entry_key", "path", "type", "link_target")
    keys = e.select("archive").distinct()
    out = mutate.create_directories(e, keys.withColumn("entry_key", F.lit("new")))
    out = mutate.create_directories(out, keys.withColumn("entry_key", F.lit("new")))  # is there already
    out = mutate.create_symlinks(out, keys.withColumn("entry_key", F.lit("new/link")), F.lit("../docs"))
    return out.where(F.col("entry_key").startswith("new")).select("archive", "entry_key", "type", "link_target")


@query("SELECT source AS archive, CASE WHEN lang = 'en' THEN 'english/' || doc_id || '.txt' ELSE 'docs/' || lang || '/' || doc_id || '.txt' END AS entry_key, CASE WHEN doc_id % 2 = 0 THEN 384 ELSE 416 END AS mode FROM documents")
def update_move_attributes(spark, sf_dir):
    e = stored_entries(spark, sf_dir)
    even = F.regexp_extract("entry_key", r"(\d+)\.txt$", 1).cast("int") % 2 == 0
    return mutate.set_attributes(mutate.move(e, "docs/en", "english"), even, mode=F.lit(0o600)).select("archive", "entry_key", "mode")


@query("SELECT source AS archive, 'link/' || doc_id AS entry_key, 'file' AS type, sha256(text) AS sha256 FROM documents")
def update_delete_hard_links(spark, sf_dir):
    """Links to deleted files become files."""
    e = as_entries(documents(spark, sf_dir)).select("archive", "path", "body", F.lit("file").alias("type"), F.lit(None).cast("string").alias("link_target"))
    links = e.select("archive", F.concat(F.lit("link/"), F.regexp_extract("path", r"(\d+)\.txt$", 1)).alias("path"), F.lit(None).cast("binary").alias("body"), F.lit("hardlink").alias("type"), F.col("path").alias("link_target"))
    packed = archive.packed(e.unionByName(links), "tar")
    stored = archive.entries_of(packed, archive="archive", includeBody=True)
    return mutate.delete(stored, F.col("entry_key").startswith("docs/")).select("archive", "entry_key", "type", F.sha2("body", 256).alias("sha256"))


@query("SELECT source AS archive, parent, count(*) AS children FROM (SELECT source, 'docs/' || lang AS parent FROM documents UNION ALL SELECT DISTINCT source, 'docs' || substr(lang, 1, 0) FROM (SELECT DISTINCT source, lang FROM documents) WHERE false UNION ALL SELECT source, 'docs' FROM (SELECT DISTINCT source, lang FROM documents) UNION ALL SELECT DISTINCT source, '' FROM documents) GROUP BY ALL")
def directory_listing(spark, sf_dir):
    return mutate.listing(stored_entries(spark, sf_dir, False)).groupBy("archive", "parent").agg(F.count("*").alias("children"))


@query("SELECT source AS archive, lang AS entry_key, count(*) AS times FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.col("source").alias("archive"), F.col("lang").alias("path"), "body")
    return mutate.duplicates(archive.entries_of(archive.packed(d, "tar"), archive="archive"))


@query("SELECT source AS key, sha256(string_agg(text, '' ORDER BY doc_id)) AS checksum, sum(octet_length(encode(text)))::BIGINT AS n_bytes FROM documents GROUP BY source")
def checksum_chunks(spark, sf_dir):
    """Texts of a source as the chunks of one stream."""
    return columns.chunked_checksum(table(spark, sf_dir, "documents"), "source", "doc_id", "text", "SHA-256")


@query("SELECT source AS archive, '7374756220' AS preamble FROM documents GROUP BY source")
def archive_preamble(spark, sf_dir):
    packed = archive.packed(as_entries(documents(spark, sf_dir)), "zip", preamble=b"stub ")
    return packed.select("archive", F.hex(columns.zip_preamble(F.col("content"))).alias("preamble"))


@query("SELECT * FROM (VALUES ('archive', '7z', true), ('archive', 'ar', true), ('archive', 'cpio', true), ('archive', 'rar', false), ('archive', 'tar', true), ('archive', 'zip', true), ('codec', 'bzip2', true), ('codec', 'compress', true), ('codec', 'deflate', true), ('codec', 'deflate64', true), ('codec', 'gzip', true), ('codec', 'lz4', true), ('codec', 'lz4-block', true), ('codec', 'lzip', true), ('codec', 'lzma', true), ('codec', 'lzma-raw', true), ('codec', 'lzma2', true), ('codec', 'ppmd', true), ('codec', 'xz', true), ('codec', 'zlib', true), ('codec', 'zstd', true)) t(kind, name, writable)")
def format_catalog(spark, sf_dir):
    return catalog.catalog(spark).select("kind", "name", "writable")


@query("SELECT o_orderkey, 'a/' || o_orderstatus AS normalized, 'x/./a//b/../' || o_orderstatus AS resolved, '../' || o_orderstatus AS relative, o_orderstatus AS name, o_orderstatus = 'F' AS below FROM orders")
def path_algebra(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.concat(F.lit("./a//b/../"), "o_orderstatus").alias("p"))
    n = native.path_normalized(F.col("p"))
    return o.select("o_orderkey", n.alias("normalized"), native.path_resolved(F.lit("x"), F.col("p")).alias("resolved"), native.path_relative(F.lit("a/q"), n).alias("relative"), native.file_name(F.col("p")).alias("name"), native.path_starts_with(n, F.lit("a/F")).alias("below"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One TAR per source, read back: path, size, checksums."""
    packed = archive.packed(as_entries(documents(spark, sf_dir)), "tar")
    e = archive.entries_of(packed, archive="archive", includeBody=True)
    return e.select("archive", "path", "size", F.crc32("body").alias("crc32"), F.sha2("body", 256).alias("sha256"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
