"""The archive engine on Spark: sources, sinks, columns, updates, and queries against DuckDB."""

from __future__ import annotations

import datetime
import io
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lamina import codecs
from lamina.formats import Entry, ar, tar, zip_
from lamina.functions import columns, detect, hashes, native
from lamina.operators import mutate
from lamina.plans import registry
from lamina.schema import attributes
from lamina.sources import archive, index, volumes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return con


CHECKED = ["scan_tar", "scan_cpio_crc", "scan_zip_deflated", "scan_zip_stream", "scan_7z_lzma2", "scan_tar_xz", "archive_statistics", "archive_metadata", "outer_layers", "limit_entry_count", "glob_filter", "zip_aes256", "sevenz_encrypted", "codec_zstd", "codec_ppmd", "scan_7z_ppmd", "scan_rar4_packed", "scan_rar5_packed", "scan_rar5", "detect_archives", "scan_zip_volumes", "scan_7z_volumes", "scan_tar_seekable", "transform_vectors", "codec_vectors", "checksum_vectors", "zstd_information", "update_zip_verbatim", "update_create", "codec_compress", "codec_frames", "detect_codecs", "limit_output", "zstd_seekable", "zstd_dictionaries", "transform_x86", "checksum_native_sums", "checksum_crc", "entry_paths", "posix_modes", "archive_times", "update_put_delete", "update_move_attributes", "update_delete_hard_links", "directory_listing", "duplicate_keys", "checksum_chunks", "archive_preamble", "format_catalog", "path_algebra"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    expected = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    order = [expected.columns.index(c) for c in sorted(df.columns)]
    assert sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect()) == sorted(str(tuple(r[i] for i in order)) for r in expected.fetchall())


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() == 200
    assert set(registry.oracle_sql()) <= set(registry.queries())


def sample(spark):
    rows = [("one.tar", "a.txt", "file", b"first", 0o600), ("one.tar", "dir/b.txt", "file", b"second" * 50, 0o644), ("two.tar", "c", "file", b"", None)]
    t = datetime.datetime(2024, 1, 2, 3, 4, 5)
    return spark.createDataFrame([(*r, t) for r in rows], "archive string, path string, type string, body binary, mode int, mtime timestamp")


def test_sink_and_source(spark, tmp_path):
    archive.register(spark)
    df = sample(spark)
    df.repartition("archive").write.format("archive").option("format", "tar").mode("append").save(str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["one.tar", "two.tar"]
    got = spark.read.format("archive").option("includeBody", "true").load(str(tmp_path / "out"))
    assert {(os.path.basename(r.archive), r.path, bytes(r.body), r.mode) for r in got.collect()} == {("one.tar", "a.txt", b"first", 0o600), ("one.tar", "dir/b.txt", b"second" * 50, 0o644), ("two.tar", "c", b"", 0o644)}
    assert got.where("path = 'a.txt'").count() == 1 and got.where("mtime = timestamp'2024-01-02 03:04:05'").count() == 3
    assert spark.read.format("archive").load(str(tmp_path / "out")).where("body is not null").count() == 0
    assert archive.read_archives(spark, str(tmp_path / "out")).count() == 3
    with pytest.raises(Exception):
        df.repartition("archive").write.format("archive").option("format", "tar").mode("append").save(str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["one.tar", "two.tar"]


def test_zip_by_entry_ranges_and_volumes(spark, tmp_path):
    archive.register(spark)
    rows = spark.range(25).select(F.lit("big.zip").alias("archive"), F.format_string("f%02d", "id").alias("path"), F.col("id").cast("string").cast("binary").alias("body"))
    data = bytes(archive.packed(rows, "zip").first().content)
    (tmp_path / "big.zip").write_bytes(data)
    df = spark.read.format("archive").option("entriesPerPartition", 10).option("includeBody", "true").load(str(tmp_path / "big.zip"))
    assert df.rdd.getNumPartitions() == 3 and sorted(int(bytes(r.body)) for r in df.collect()) == list(range(25))
    os.makedirs(tmp_path / "split")
    seven = bytes(archive.packed(rows, "7z").first().content)
    for i, part in enumerate(volumes.split(seven, 100), 1):
        (tmp_path / "split" / f"big.7z.{i:03d}").write_bytes(part)
    assert spark.read.format("archive").load(str(tmp_path / "split")).count() == 25


def test_volume_names():
    assert volumes.grouped(["x.part1.rar", "x.part2.rar", "y.rar"]) == [["x.part1.rar", "x.part2.rar"], ["y.rar"]]
    assert volumes.grouped(["x.rar", "x.r00", "x.r01"]) == [["x.rar", "x.r00", "x.r01"]]
    assert volumes.grouped(["x.z01", "x.zip", "x.z02"]) == [["x.z01", "x.z02", "x.zip"]]
    assert volumes.grouped(["x.7z.001", "x.7z.003"]) == [["x.7z.001"], ["x.7z.003"]]


def test_streaming_reads_each_archive_once(spark, tmp_path):
    archive.register(spark)
    source, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    os.makedirs(source)
    packed = {r.archive: bytes(r.content) for r in archive.packed(sample(spark), "tar").collect()}

    def drain():
        q = spark.readStream.format("archive").load(str(source)).select("archive", "path").writeStream.format("parquet").option("checkpointLocation", marks).trigger(availableNow=True).start(out)
        q.awaitTermination()
        return spark.read.parquet(out).count()

    (source / "one.tar").write_bytes(packed["one.tar"])
    assert drain() == 2
    (source / "two.tar").write_bytes(packed["two.tar"])
    assert drain() == 3


def test_arrivals_by_the_file_stream(spark, tmp_path):
    from lamina.streaming.arrivals import arriving

    source, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    os.makedirs(source)
    packed = {r.archive: bytes(r.content) for r in archive.packed(sample(spark), "zip").collect()}
    for i, name in enumerate(("one.tar", "two.tar")):
        (source / f"{i}.zip").write_bytes(packed[name])
        arriving(spark, str(source), includeBody=True).select("path", "body").writeStream.format("parquet").option("checkpointLocation", marks).trigger(availableNow=True).start(out).awaitTermination()
    assert {(r.path, bytes(r.body)) for r in spark.read.parquet(out).collect()} == {("a.txt", b"first"), ("dir/b.txt", b"second" * 50), ("c", b"")}


def test_errors_can_be_rows(spark):
    df = spark.createDataFrame([("bad", b"not an archive"), ("none", None)], "path string, content binary")
    got = archive.entries_of(df, onError="permissive").collect()
    assert len(got) == 1 and got[0].archive == "bad" and "MalformedData" in got[0]._error
    with pytest.raises(Exception, match="neither an archive"):
        archive.entries_of(df).collect()


def test_layers_are_bounded(spark):
    tar = archive.packed(sample(spark).where("archive = 'two.tar'"), "tar").first().content
    data = bytes(tar)
    for _ in range(5):
        data = codecs.encode("gzip", data)
    df = spark.createDataFrame([("x", data)], "path string, content binary")
    assert "outer_layers" in archive.entries_of(df, onError="permissive").first()._error
    assert archive.entries_of(df, maxOuterLayers=5).count() == 1


def test_blocks_of_one_archive_are_shared_out(spark, tmp_path):
    """All texts in one source: its archive is not one task's work."""
    spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.lit("all")).write.parquet(str(tmp_path / "documents.parquet"))
    rows = registry.queries()["scan_7z_ppmd"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    assert len(rows) == 200 and len({r.task for r in rows}) > 1
    docs = registry.as_entries(registry.documents(spark, str(tmp_path)))
    sizes = archive.entries_of(archive.packed_by_block(docs, method="copy"), archive="archive").select("sevenz.*").collect()
    assert len({r.data_offset for r in sizes}) > -(-200 // 64) - 1 and max(r.substream_count for r in sizes) <= 64


def test_blocks_equal_whole_archives(spark):
    rows = [(k, f"{i:03}", t, (b"%d" % i) * (i % 7) if t == "file" else None, "000" if t == "symlink" else None) for k in ("x", "y", None) for i, t in enumerate(["file"] * 60 + ["directory", "symlink"] * 5)]
    df = spark.createDataFrame([*rows, ("empty", "only", "file", b"", None)], "archive string, path string, type string, body binary, link_target string")
    whole, blocks = archive.packed(df, "7z", solid=4, method="lzma"), archive.packed_by_block(df, solid=4, method="lzma")
    key = ["archive", "path", "type", "size", "mode", "link_target", "body", "ordinal"]
    ordered = lambda got, cols: sorted(map(str, got.select(*cols).collect()))
    expected = ordered(archive.entries_of(whole, archive="archive", includeBody=True), key)
    assert len(expected) == 211
    assert ordered(archive.entries_of(blocks, archive="archive", includeBody=True), key) == expected
    for made in (whole, blocks):
        plain = archive.entries_of(made, archive="archive", includeBody=True)
        assert ordered(archive.entries_by_block(made, archive="archive", includeBody=True), plain.columns) == ordered(plain, plain.columns)
    broken = whole.where("archive = 'x'").select("archive", F.expr("overlay(content placing x'ffff' from 34)").alias("content"))
    read = lambda f: f(broken, archive="archive", includeBody=True, onError="permissive")
    assert ordered(read(archive.entries_by_block), key) == ordered(read(archive.entries_of), key)
    with pytest.raises(Exception, match="MalformedData"):
        archive.entries_by_block(broken, archive="archive", includeBody=True).collect()
    with pytest.raises(Exception, match="LimitExceeded"):
        archive.entries_by_block(whole, archive="archive", includeBody=True, maxTotalEntrySize=100).collect()


def test_detection_expression(spark):
    cases = [(b"Rar!\x1a\x07\x00", "rar"), (b"Rar!\x1a\x07\x01\x00", "rar"), (b"PK\x03\x04", "zip"), (b"PK\x01\x02", None), (b"\x50\x2a\x4d\x18", "lz4"), (bytes(1024), "tar"), (bytes(512), None), (b"", None), (b"\x1f", None), (b"\x1f\x9d", "compress"), (b"BZh0", None), (b"BZh9", "bzip2"), (b"\x78\x9c", "zlib"), (b"\x78\x9d", None), (b"\xc7\x71" + bytes(24), None), (b"\xc7\x71", "cpio"), (None, None)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, b binary")
    assert [r.d for r in df.select("i", detect.detected(F.col("b")).alias("d")).orderBy("i").collect()] == [c[1] for c in cases]


def test_columns(spark):
    df = spark.createDataFrame([(1, b"123456789"), (2, b""), (3, None)], "i int, b binary")
    r = {x.i: x for x in df.select("i", *[columns.checksum(F.col("b"), a).alias(a.replace("-", "_")) for a in ("crc32", "crc32c", "adler32", "xxh64", "blake2sp")], native.adler32(F.col("b")).alias("native"), native.delta_encode(F.col("b"), 2).alias("delta")).collect()}
    assert (r[1].crc32, r[1].crc32c, r[1].adler32, r[1].native) == (0xCBF43926, 0xE3069283, 0x091E01DE, 0x091E01DE)
    assert r[2].xxh64 % (1 << 64) == hashes.xxh64(b"") and r[3].crc32c is None and r[3].blake2sp is None
    assert bytes(r[1].delta) == bytes([49, 50, 2, 2, 2, 2, 2, 2, 2]) and bytes(r[2].delta) == b""
    bad = df.select("i", columns.try_decompress(F.col("b"), "gzip").alias("r")).collect()
    assert bad[0].r.error.startswith("MalformedData") and bad[2].r.error is None


def test_globs(spark):
    df = spark.createDataFrame([("a/b.txt",), ("a/c/b.txt",), ("x.md",)], "p string")
    hit = lambda g: {r.p for r in df.where(native.path_matches(F.col("p"), g)).collect()}
    assert hit("glob:a/*.txt") == {"a/b.txt"} and hit("**.txt") == {"a/b.txt", "a/c/b.txt"} and hit("*.{md,rst}") == {"x.md"} and hit("regex:x\\..*") == {"x.md"} and hit("[!a]*.md") == {"x.md"}


def test_updates_on_rows(spark):
    rows = [("z", "a", "a", "file", None, b"1"), ("z", "d/b", "d/b", "file", None, b"2"), ("z", "l", "l", "hardlink", "a", None)]
    e = spark.createDataFrame(rows, "archive string, path string, entry_key string, type string, link_target string, body binary").withColumn("size", F.octet_length("body").cast("long"))
    left = {r.entry_key: r for r in mutate.delete(e, F.col("entry_key") == "a").collect()}
    assert set(left) == {"d/b", "l"} and left["l"].type == "file" and bytes(left["l"].body) == b"1"
    assert {r.entry_key for r in mutate.move(e, "d", "e").collect()} == {"a", "e/b", "l"}
    assert mutate.duplicates(e.unionByName(e.limit(1))).count() == 1


def test_paths(spark):
    df = spark.createDataFrame([("/a/../../b/",), ("../a/./b",), ("a/../..",), ("",)], "p string")
    assert [r.n for r in df.select(native.path_normalized(F.col("p")).alias("n")).collect()] == ["/b", "../a/b", "..", ""]
    pairs = spark.createDataFrame([("a/b", "a/c/d"), ("", "x"), ("/a", "/a"), ("/a", "b")], "a string, b string")
    assert [r.n for r in pairs.select(native.path_relative(F.col("a"), F.col("b")).alias("n")).collect()] == ["../c/d", "x", "", None]


def test_catalog_names():
    from lamina.plans import catalog

    assert catalog.find("SevenZip") == ("archive", "7z") and catalog.find(".jar") == ("archive", "zip") and catalog.find("unix-compress") == ("codec", "compress") and catalog.find("zst") == ("codec", "zstd") and catalog.find("nothing") is None


def test_updates_refuse_what_is_there(spark):
    e = spark.createDataFrame([("a", "x", "x", "file", None), ("a", "d/y", "d/y", "file", None), ("b", "d/y", "d/y", "file", None)], "archive string, path string, entry_key string, type string, link_target string")
    keys = spark.createDataFrame([("a", "x")], "archive string, entry_key string")
    for f in (lambda: mutate.create_symlinks(e, keys, F.lit("y")), lambda: mutate.move(e, "d", "x"), lambda: mutate.create_links(e, keys, "nothing")):
        with pytest.raises(Exception, match="there already|no file to link to"):
            f().collect()
    assert sorted((r.archive, r.entry_key) for r in mutate.move(e, "d", "x", replace=True).collect()) == [("a", "x/y"), ("b", "x/y")]
    linked = mutate.create_links(e, spark.createDataFrame([("a", "z")], "archive string, entry_key string"), "x")
    assert linked.where("type = 'hardlink'").first().link_target == "x"
    with pytest.raises(ValueError):
        mutate.move(e, "d", "d/e")


def test_volumes_of_the_sink(spark, tmp_path):
    """ZIP volumes with disk numbers, and cut 7z files, written and read as files."""
    archive.register(spark)
    bodies = {f"f{i}.bin": os.urandom(3000) for i in range(9)}
    for fmt in ("zip", "7z"):
        rows = [(f"x.{fmt}", k, v) for k, v in bodies.items()]
        df = spark.createDataFrame(rows, "archive string, path string, body binary").coalesce(1)
        df.write.format("archive").mode("append").option("format", fmt).option("method", "copy" if fmt == "7z" else "stored").option("volumeSize", 4096).save(str(tmp_path / fmt))
        assert len(os.listdir(tmp_path / fmt)) > 6
        got = spark.read.format("archive").option("includeBody", "true").load(str(tmp_path / fmt)).collect()
        assert {r.path: bytes(r.body) for r in got} == bodies


def test_bodies_by_ranges(spark, tmp_path):
    """An index of headers, and bodies read through it by several tasks."""
    bodies = {f"d/f{i}.bin": os.urandom(i * 37) for i in range(60)}
    for fmt, write in (("tar", tar.write), ("ar", ar.write)):
        with open(tmp_path / f"x.{fmt}", "wb") as f:
            write([Entry(k.replace("d/", ""), body=v) for k, v in bodies.items()], f)
    found = index.indexed(spark, str(tmp_path))
    assert found.where("data_offset is not null").count() == 120
    some = index.bodies(found.where("size % 2 = 0"), per_task=7)
    assert some.rdd.getNumPartitions() > 5
    got = {(os.path.basename(r.archive), "d/" + r.path): bytes(r.body) for r in some.collect()}
    assert got == {(f"x.{fmt}", k): v for fmt in ("tar", "ar") for k, v in bodies.items() if len(v) % 2 == 0}


def test_frames_of_parts(spark):
    df = spark.createDataFrame([([b"one", b"", b"two"],)], "p array<binary>")
    for codec in ("gzip", "zstd", "xz", "bzip2"):
        c = columns.compress_frames(F.col("p"), codec)
        row = df.select(columns.decompress(c, codec).alias("all"), columns.try_decompress(c, codec, frame=True).alias("first")).first()
        assert bytes(row["all"]) == b"onetwo" and bytes(row["first"]["data"]) == b"one"


def test_names_in_other_charsets(spark):
    """A name, several of which the first that fits counts, and a detector; decoding is strict."""
    content = io.BytesIO()
    zip_.write([Entry("plain.txt", body=b"x")], content)
    raw = content.getvalue().replace(b"plain.txt", "grün.tx".encode("cp1252") + b"\x81\x8d")
    # without the flag for UTF-8
    raw = raw.replace(b"PK\x03\x04\x14\x00\x00\x08", b"PK\x03\x04\x14\x00\x00\x00").replace(b"PK\x01\x02?\x03\x14\x00\x00\x08", b"PK\x01\x02?\x03\x14\x00\x00\x00")
    df = spark.createDataFrame([("a", raw)], "path string, content binary")
    read = lambda **how: archive.entries_of(df, **how).first().path
    assert read(metadataCharset="latin-1").startswith("grün.tx") and read().startswith("gr\u207fn.tx")
    assert read(metadataCharset="utf-8, latin-1").startswith("grün.tx")
    assert read(metadataCharset=lambda b: "latin-1" if b"\xfc" in b else None).startswith("grün.tx")
    for bad in ("utf-8", "no-such-charset"):
        with pytest.raises(Exception, match="MalformedData|Unsupported"):
            read(metadataCharset=bad)


def test_passwords_by_entry(spark):
    """A provider gives a password for each path."""
    items = spark.createDataFrame([("a", "one", b"1" * 99), ("a", "two", b"2" * 99)], "archive string, path string, body binary")
    packed = archive.packed(items, "zip", encrypt="aes-256", password="secret")
    got = archive.entries_of(packed, archive="archive", includeBody=True, password=lambda path: "secret" if path in ("one", "two") else None)
    assert {r.path: bytes(r.body)[:1] for r in got.collect()} == {"one": b"1", "two": b"2"}


def test_views():
    assert attributes("size,mtime") == ["size", "mtime"]
    assert attributes("zip:crc32,size") == ["zip.crc32", "size"] and attributes("7z:solid") == ["sevenz.solid"]
    assert attributes("ar:*")[-1] == "ar.data_offset" and "path" in attributes("*")
    for bad in ("zip:nothing", "none:size"):
        with pytest.raises(ValueError):
            attributes(bad)


@pytest.mark.parametrize("kept", ["", "corpus_pipeline.py"])
def test_entry_without_the_training_data_operators(tmp_path, kept):
    """Their subpackage, their tests and the pipeline can go; the pipeline alone may be left behind."""
    root = Path(__file__).parent.parent
    for name in ("__spark_entry__.py", "lamina", *filter(None, [kept])):
        if (root / name).is_dir():
            shutil.copytree(root / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif (root / name).exists():
            shutil.copy(root / name, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and set(e.oracle_sql()) <= set(q) and 'pipeline' not in q; print('fine')"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, timeout=120)
    assert done.stdout.strip() == "fine", done.stderr
