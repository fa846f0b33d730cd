"""Schemas of archive entries. Sentinels of formats are null here; times keep their nanoseconds apart."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {"s": T.StringType(), "l": T.LongType(), "i": T.IntegerType(), "b": T.BinaryType(), "z": T.BooleanType(), "as": T.ArrayType(T.StringType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in spec.split())])


FORMATS = {
    "zip": _struct("raw_path:b comment:s raw_comment:b compressed_size:l crc32:l gp_flags:i version_made_by:i version_needed:i internal_attrs:i external_attrs:l uid:l gid:l method_id:i method:s encryption:s local_extra:b central_extra:b raw:b"),
    "tar": _struct("type_flag:s uid:l gid:l uname:s gname:s is_hard_link:z link_name:s btime:l data_offset:l"),
    "ar": _struct("identifier:s uid:l gid:l mode:l data_offset:l"),
    "cpio": _struct("dialect:s byte_order:s inode:l uid:l gid:l nlink:l mode:l dev:l rdev:l dev_major:l dev_minor:l rdev_major:l rdev_minor:l checksum:l"),
    "sevenz": _struct("coder_graph:as solid:z substream_index:l substream_count:l data_offset:l decoded_offset:l packed_size:l crc32:l windows_attributes:l unix_mode:l"),
    "rar": _struct("host_os:s file_attributes:l method:l packed_size:l unpacked_size:l crc32:l blake2sp:b encrypted:z continues_prev:z continues_next:z link_name:s redirection_type:l redirection_flags:l redirection_target:s redirection_target_dir:z uname:s gname:s uid:l gid:l"),
}
#: Columns that every format fills, by their names in view strings.
BASIC = ("archive", "format", "ordinal", "path", "entry_key", "type", "size", "mode", "mtime", "atime", "ctime", "link_target")
#: Columns by which format structs are named.
COLUMN = {"7z": "sevenz"}

ENTRY = T.StructType(
    [
        T.StructField("archive", T.StringType(), False),
        T.StructField("format", T.StringType()),
        T.StructField("ordinal", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("entry_key", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mode", T.IntegerType()),
        T.StructField("mtime", T.TimestampType()),
        T.StructField("mtime_nanos", T.IntegerType()),
        T.StructField("atime", T.TimestampType()),
        T.StructField("ctime", T.TimestampType()),
        T.StructField("link_target", T.StringType()),
        T.StructField("outer_codecs", T.ArrayType(T.StringType())),
        T.StructField("body", T.BinaryType()),
        *[T.StructField(k, v) for k, v in FORMATS.items()],
        T.StructField("_error", T.StringType()),
    ]
)


def attributes(view: str) -> list[str]:
    """Columns of a view string: "size,mtime" are basic ones, "zip:crc32,method" those of a format, "zip:*" all of a
    format with the basic ones, "*" all basic ones."""
    name, _, wanted = view.rpartition(":")
    name = COLUMN.get(name, name)
    if name and name != "basic" and name not in FORMATS:
        raise ValueError(f"no view named {name}")
    own = FORMATS[name].names if name in FORMATS else []
    out: list[str] = []
    for w in (x.strip() for x in wanted.split(",")):
        if w == "*":
            out += [*BASIC, *(f"{name}.{k}" for k in own)]
        elif w in own:
            out.append(f"{name}.{w}")
        elif w in BASIC:
            out.append(w)
        else:
            raise ValueError(f"no attribute {w} in {view}")
    return list(dict.fromkeys(out))
