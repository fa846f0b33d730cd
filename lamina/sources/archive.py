"""Archives as DataFrames: a reader over binary columns and files, a Python data source, and sinks.

`read_archives` goes through Spark's own file reader, so it opens whatever Spark opens; each archive
is a row of at most 2 GiB. The data source `archive` opens local or mounted paths itself, reads larger
archives, splits indexed ZIP files by entries and joins split volumes.
"""

from __future__ import annotations

import io
import itertools
import os
import pickle
import tempfile
from collections.abc import Iterator
from dataclasses import fields

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from .. import codecs, formats
from ..errors import LimitExceeded, MalformedData, Unsupported
from ..formats.entry import Entry, Limits, entry_key
from ..functions.detect import PREFIX, detect_archive, detect_codec
from ..schema import COLUMN, ENTRY, FORMATS
from . import volumes

ERRORS = (MalformedData, Unsupported, LimitExceeded, UnicodeDecodeError)


def limits_of(options: dict) -> Limits:
    """Limits from options in camel case, such as maxEntryCount."""
    names = {"".join([p if i == 0 else p.capitalize() for i, p in enumerate(f.name.split("_"))]).lower(): f.name for f in fields(Limits)}
    return Limits(**{names[k.lower()]: int(v) for k, v in options.items() if k.lower() in names and v is not None})


def option(options: dict, name: str, default=None):
    return next((v for k, v in options.items() if k.lower() == name.lower()), default)


def peel(f, limits: Limits, named: str | None = None) -> tuple[str, object, list[str]]:
    """(format, file, outer codecs): archives are probed before codecs, layer by layer."""
    outer: list[str] = []
    if named:
        found = formats.find(named)
        if found is None:
            raise Unsupported(f"no archive format named {named}")
        return found, f, outer
    while True:
        f.seek(0)
        head = f.read(PREFIX)
        if (found := detect_archive(head)) is not None:
            return found, f, outer
        codec = detect_codec(head)
        if codec is None:
            f.seek(0)
            raise MalformedData("neither an archive nor a known compression")
        if len(outer) >= limits.max_outer_layers:
            raise LimitExceeded("outer_layers", limits.max_outer_layers, len(outer) + 1)
        outer.append(codec)
        if codec == "zstd" and (seekable := codecs.native.seekable_zstd(f)) is not None:
            # frames are decoded as they are asked for
            most = limits.max_decoded_archive_size
            if most is not None and seekable.total > most:
                raise LimitExceeded("decoded_archive_size", most, seekable.total)
            f = seekable
            continue
        f.seek(0)
        # decoded layers of some size go to the worker's own disk
        spool = tempfile.SpooledTemporaryFile(max_size=64 << 20)  # noqa: SIM115
        most = limits.max_decoded_archive_size if limits.max_decoded_archive_size is not None else 1 << 32
        try:
            spool.write(codecs.decode(codec, f.read(), max_output=most))
        except LimitExceeded as e:
            raise LimitExceeded("decoded_archive_size", e.maximum, e.actual) from None
        f = spool


def entries(f, options: dict) -> Iterator[tuple[str, list[str], Entry]]:
    limits = limits_of(options)
    fmt, f, outer = peel(f, limits, option(options, "format"))
    how = {k: v for k, v in (("charset", option(options, "metadataCharset")), ("password", option(options, "password")), ("mode", option(options, "mode"))) if v is not None}
    if fmt == "zip" and str(option(options, "includeRaw", "false")).lower() == "true":
        how["raw"] = True
    for e in formats.CATALOG[fmt][3](f, limits=limits, **how):
        yield fmt, outer, e


def row_of(archive: str, fmt: str, outer: list[str], ordinal: int, e: Entry, body: bytes | None) -> dict:
    name = COLUMN.get(fmt, fmt)
    micros = lambda ns: None if ns is None else ns // 1000
    own = {k: e.fields.get(k) for k in FORMATS[name].names}
    return {"archive": archive, "format": fmt, "ordinal": ordinal, "path": e.path, "entry_key": entry_key(e.path), "type": e.type, "size": e.size, "mode": e.mode, "mtime": micros(e.mtime), "mtime_nanos": None if e.mtime is None else e.mtime % 1000, "atime": micros(e.atime), "ctime": micros(e.ctime), "link_target": e.link_target, "outer_codecs": outer, "body": body, name: own, "_error": None}


def rows(archive: str, f, options: dict, wanted=lambda e: True, first: int = 0, last: int | None = None) -> Iterator[dict]:
    """Rows of one archive. In mode permissive a failure ends the archive with a row that names it."""
    permissive = str(option(options, "onError", "failfast")).lower() == "permissive"
    with_body = str(option(options, "includeBody", "false")).lower() == "true"
    try:
        for i, (fmt, outer, e) in enumerate(entries(f, options)):
            if last is not None and i >= last:
                return
            if i < first or not wanted(e):
                continue
            yield row_of(archive, fmt, outer, i, e, e.read() if with_body and e.type == "file" else None)
    except ERRORS as error:
        if not permissive:
            raise
        yield {"archive": archive, "_error": f"{type(error).__name__}: {error}"}


def batches(found: Iterator[dict], size: int = 1024, weight: int = 32 << 20):
    """Arrow batches of entry rows, by number and by bytes of bodies."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(ENTRY)
    held, heavy = [], 0
    for row in found:
        held.append(row)
        heavy += len(row.get("body") or b"")
        if len(held) >= size or heavy >= weight:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, heavy = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def entries_of(df: DataFrame, content: str = "content", archive: str = "path", **options) -> DataFrame:
    """Entries of the archives in a binary column."""

    def run(parts):
        def found():
            for batch in parts:
                for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if data is not None:
                        yield from rows(str(name), io.BytesIO(data), options)

        yield from batches(found())

    return df.select(F.col(archive).cast("string").alias("a"), F.col(content).alias("c")).mapInArrow(run, ENTRY)


def entries_by_block(df: DataFrame, content: str = "content", archive: str = "path", **options) -> DataFrame:
    """The same for 7z, with bodies that are decoded block by block in as many tasks as shuffles have.

    One task reads an archive's header and cuts its packed blocks out. Where nothing is decoded, and in mode
    permissive, where a failure ends the archive, it does everything.
    """
    if str(option(options, "includeBody", "false")).lower() != "true" or str(option(options, "onError", "failfast")).lower() == "permissive":
        return entries_of(df, content, archive, **options)
    secret = option(options, "password")

    def cut(found):
        import pyarrow as pa

        out = pa.schema([("archive", pa.string()), ("number", pa.int32()), ("outer", pa.list_(pa.string())), ("part", pa.binary())])
        for batch in found:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if data is None:
                    continue
                limits = limits_of(options)
                fmt, f, outer = peel(io.BytesIO(data), limits, option(options, "format"))
                if fmt != "7z":
                    raise Unsupported(f"{fmt} block by block")
                for i, part in enumerate(formats.sevenz.parts(f, limits, secret)):
                    yield pa.RecordBatch.from_pylist([{"archive": str(name), "number": i, "outer": outer, "part": pickle.dumps(part)}], schema=out)

    def decode(found):
        def entry_rows():
            for batch in found:
                for row in zip(*(batch.column(c) for c in ("archive", "outer", "part"))):
                    name, outer, part = (x.as_py() for x in row)
                    for i, e in pickle.loads(part).read(limits_of(options), secret):
                        yield row_of(name, "7z", outer, i, e, e.read() if e.type == "file" else None)

        yield from batches(entry_rows())

    cuts = df.select(F.col(archive).cast("string").alias("a"), F.col(content).alias("c")).mapInArrow(cut, "archive string, number int, outer array<string>, part binary")
    return cuts.repartition(_tasks(df), "archive", "number").mapInArrow(decode, ENTRY)


def _tasks(df: DataFrame) -> int:
    """Tasks of a shuffle whose rows are dear by what is done with them, not by their bytes."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def entries_of_volumes(df: DataFrame, content: str = "content", archive: str = "archive", volume: str = "volume", **options) -> DataFrame:
    """Entries of archives in volumes, given as binary values that are numbered; an archive's volumes meet in one task."""

    def run(parts):
        def found():
            held: list[bytes] = []
            current = None
            for batch in parts:
                for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if held and name != current:
                        yield from rows(str(current), volumes.JoinedParts(held), options)
                        held = []
                    current = name
                    held.append(data or b"")
            if held:
                yield from rows(str(current), volumes.JoinedParts(held), options)

        yield from batches(found())

    keyed = df.select(F.col(archive).cast("string").alias("a"), F.col(content).alias("c"), F.col(volume).alias("v"))
    return keyed.repartition("a").sortWithinPartitions("a", "v").select("a", "c").mapInArrow(run, ENTRY)


def read_archives(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """Entries of archive files under a path that Spark can read."""
    return entries_of(spark.read.format("binaryFile").load(path), **options)


def entry_from(row: dict) -> Entry:
    """What a writer needs, from a row of entry columns; missing ones are unknown."""
    get = row.get
    nanos = lambda t, extra=0: None if t is None else (int(t.timestamp() * 1_000_000) if hasattr(t, "timestamp") else int(t)) * 1000 + (extra or 0)
    known = {k: v for name in FORMATS for k, v in (get(name) or {}).items() if v is not None}
    known |= {k: get(k) for k in ("uid", "gid", "uname", "gname", "comment", "method") if get(k) is not None}
    body = get("body")
    return Entry(get("path"), get("type") or "file", get("size") if known.get("raw") is not None else None, get("mode"), nanos(get("mtime"), get("mtime_nanos")), None, None, get("link_target"), known, bytes(body) if body is not None else b"")


def written(found: list[Entry], fmt: str, options: dict) -> list[bytes]:
    """The archive, or its volumes where volumeSize is given."""
    writer = formats.CATALOG[formats.find(fmt) or "?"][4] if formats.find(fmt) else None
    if writer is None:
        raise Unsupported(f"{fmt} can't be written")
    outer, size = options.pop("compression", None), options.pop("volumeSize", None)
    if size is not None:
        if outer:
            raise Unsupported("compressed archives in volumes")
        return volumes.written(lambda out: writer(found, out, **options), formats.find(fmt), int(size))
    out = io.BytesIO()
    writer(found, out, **options)
    return [codecs.encode(outer, out.getvalue()) if outer else out.getvalue()]


def packed(df: DataFrame, fmt: str, archive: str = "archive", order: str = "path", **options) -> DataFrame:
    """One archive per value of a column, entries in the given order: rows (archive, content).

    An archive is one binary value, so its rows meet in one task by nature; bodies are sorted there by
    Spark, which spills, and leave as one value of at most 2 GiB.
    """
    return packed_all(df, (fmt,), archive, order, **options).drop("format", "volume")


def packed_volumes(df: DataFrame, fmt: str, size: int, archive: str = "archive", order: str = "path", **options) -> DataFrame:
    """The same in volumes of a size: rows (archive, volume, content), volumes from 0."""
    return packed_all(df, (fmt,), archive, order, volumeSize=size, **options).drop("format")


def packed_all(df: DataFrame, fmts: tuple[str, ...], archive: str = "archive", order: str = "path", **options) -> DataFrame:
    """The same in several formats after one shuffle: rows (archive, format, volume, content)."""
    names = [c for c in df.columns if c != archive]

    def run(parts):
        import pyarrow as pa

        out = pa.schema([("archive", pa.string()), ("format", pa.string()), ("volume", pa.int32()), ("content", pa.binary())])
        current, held = None, []

        def done():
            for fmt in fmts:
                for i, content in enumerate(written(held, fmt, dict(options))):
                    yield pa.RecordBatch.from_pylist([{"archive": current, "format": fmt, "volume": i, "content": content}], schema=out)

        for batch in parts:
            keys = batch.column("_key").to_pylist()
            cols = {c: batch.column(c).to_pylist() for c in names}
            for i, k in enumerate(keys):
                if k != current and held:
                    yield from done()
                    held = []
                current = k
                held.append(entry_from({c: v[i] for c, v in cols.items()}))
        if held:
            yield from done()

    keyed = df.withColumn("_key", F.col(archive).cast("string")).drop(archive)
    return keyed.repartition("_key").sortWithinPartitions("_key", order).mapInArrow(run, "archive string, format string, volume int, content binary")


def packed_by_block(df: DataFrame, archive: str = "archive", order: str = "path", **options) -> DataFrame:
    """7z archives like those of `packed`, with blocks that are coded in as many tasks as shuffles have.

    Tasks take ranges of all entries in order, so a block ends where a range does, too. Coded blocks meet in one
    task for each archive, which only adds the header.
    """
    if {"compression", "volumeSize"} & options.keys():
        raise Unsupported("blocks of compressed archives or of volumes")
    names = [c for c in df.columns if c != archive]

    def code(found):
        import pyarrow as pa

        out = pa.schema([("archive", pa.string()), ("task", pa.int32()), ("number", pa.int32()), ("block", pa.binary())])
        task = TaskContext.get().partitionId()

        def keyed_entries():
            for batch in found:
                cols = {c: batch.column(c) for c in names}
                for i, k in enumerate(batch.column("_key").to_pylist()):
                    yield k, entry_from({c: v[i].as_py() for c, v in cols.items()})

        for key, some in itertools.groupby(keyed_entries(), key=lambda x: x[0]):
            for i, block in enumerate(formats.sevenz.coded((e for _, e in some), **options)):
                yield pa.RecordBatch.from_pylist([{"archive": key, "task": task, "number": i, "block": pickle.dumps(block)}], schema=out)

    def join(found):
        import pyarrow as pa

        out = pa.schema([("archive", pa.string()), ("content", pa.binary())])
        blocks = ((k.as_py(), b) for batch in found for k, b in zip(batch.column("archive"), batch.column("block")))
        for key, some in itertools.groupby(blocks, key=lambda x: x[0]):
            content = io.BytesIO()
            formats.sevenz.joined((pickle.loads(b.as_py()) for _, b in some), content, **options)
            yield pa.RecordBatch.from_pylist([{"archive": key, "content": content.getvalue()}], schema=out)

    keyed = df.withColumn("_key", F.col(archive).cast("string")).drop(archive)
    ranges = keyed.repartitionByRange(_tasks(df), "_key", order).sortWithinPartitions("_key", order)
    blocks = ranges.mapInArrow(code, "archive string, task int, number int, block binary")
    return blocks.repartition("archive").sortWithinPartitions("archive", "task", "number").mapInArrow(join, "archive string, content binary")


# --- data source ----------------------------------------------------------------------------------


class Part(InputPartition):
    def __init__(self, name: str, paths: list[str], first: int = 0, last: int | None = None):
        super().__init__(name)
        self.name, self.paths, self.first, self.last = name, paths, first, last


def listed(path: str) -> list[str]:
    import glob

    if os.path.isdir(path):
        return sorted(os.path.join(d, x) for d, _, names in os.walk(path) for x in names if not x.startswith((".", "_")))
    return sorted(glob.glob(path)) or ([path] if os.path.exists(path) else [])


class Reader(DataSourceReader):
    """Filters on path, entry_key and type are applied before bodies are read."""

    def __init__(self, options: dict):
        self.options, self.filters = dict(options), []

    def pushFilters(self, filters):
        for f in filters:
            column = getattr(f, "attribute", ())
            if isinstance(f, (EqualTo, In, StringStartsWith)) and column in (("path",), ("entry_key",), ("type",)):
                self.filters.append((type(f).__name__, column[0], f.value))
            yield f  # Spark applies it again

    def wanted(self, e: Entry) -> bool:
        for kind, column, value in self.filters:
            have = {"path": e.path, "entry_key": entry_key(e.path), "type": e.type}[column]
            if not (have == value if kind == "EqualTo" else have in value if kind == "In" else have.startswith(value)):
                return False
        return True

    def partitions(self):
        path = option(self.options, "path")
        per = int(option(self.options, "entriesPerPartition", 0))
        for group in volumes.grouped(listed(path)):
            if per and len(group) == 1 and (n := self._zip_entries(group[0])):
                for i in range(0, n, per):
                    yield Part(group[0], group, i, i + per)
            else:
                yield Part(group[-1] if len(group) > 1 and group[-1].endswith(".zip") else group[0], group)

    @staticmethod
    def _zip_entries(path: str) -> int:
        with open(path, "rb") as f:
            if f.read(2) != b"PK":
                return 0
            return formats.zip_.directory(f)[2]

    def partitions_list(self):
        return list(self.partitions())

    def read(self, part):
        with volumes.opened(part.paths) as f:
            yield from batches(rows(part.name, f, self.options, self.wanted, part.first, part.last))


class _Reader(Reader):
    def partitions(self):
        return list(super().partitions())


class StreamReader(DataSourceStreamReader):
    """Each archive of a folder once, as it arrives; the offset is the set of names seen, by count and order."""

    def __init__(self, options: dict):
        self.reader = _Reader(options)

    def initialOffset(self):
        return {"seen": "[]"}

    def latestOffset(self):
        import json

        return {"seen": json.dumps(sorted(listed(option(self.reader.options, "path"))))}

    def partitions(self, start, end):
        import json

        old = set(json.loads(start["seen"]))
        return [Part(g[0], g) for g in volumes.grouped([p for p in json.loads(end["seen"]) if p not in old])]

    def read(self, part):
        return self.reader.read(part)


class Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class Writer(DataSourceWriter):
    """Writes each archive under a temporary name; commit renames, abort deletes. Rows of an archive must share a task."""

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.options, self.names, self.overwrite = dict(options), schema.names, overwrite

    def write(self, iterator):
        import uuid

        fmt, out = option(self.options, "format", "tar"), option(self.options, "path")
        how = {k: option(self.options, k) for k in ("compression", "method", "password", "encrypt", "dialect", "volumeSize") if option(self.options, k) is not None}
        os.makedirs(out, exist_ok=True)
        groups: dict[str, list[Entry]] = {}
        for row in iterator:
            r = row.asDict(recursive=True)
            groups.setdefault(r["archive"], []).append(entry_from(r))
        files = []
        for name, found in groups.items():
            parts = written(found, fmt, dict(how))
            for final, content in zip(volumes.names(os.path.join(out, os.path.basename(name)), formats.find(fmt), len(parts)), parts):
                temporary = f"{final}.{uuid.uuid4().hex}.part"
                with open(temporary, "wb") as f:
                    f.write(content)
                files.append((temporary, final))
        return Written(files)

    def commit(self, messages):
        files = [x for m in messages if m for x in m.files]
        finals = [f for _, f in files]
        if len(set(finals)) != len(finals) or (not self.overwrite and any(map(os.path.exists, finals))):
            self.abort(messages)
            raise ValueError("an archive was written by two tasks, or is there already")
        for temporary, final in files:
            os.replace(temporary, final)

    def abort(self, messages):
        for m in messages:
            for temporary, _ in m.files if m else ():
                if os.path.exists(temporary):
                    os.remove(temporary)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls):
        return "archive"

    def schema(self):
        return ENTRY

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return StreamReader(self.options)

    def writer(self, schema, overwrite):
        return Writer(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
