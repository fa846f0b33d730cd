"""Native column functions: paths, modes, times, and checksums that array functions can express."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_valid(path: Column) -> Column:
    """Stays inside the archive and names something."""
    return ~path.rlike(r"^[/\\]|^.:|(^|[/\\])\.\.([/\\]|$)") & (F.size(_parts(path)) > 0)


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, r"[/\\]"), lambda p: ~p.isin("", "."))


def entry_key(path: Column) -> Column:
    """Normalized key; null where the path isn't valid."""
    return F.when(path_valid(path), F.array_join(_parts(path), "/"))


def parent(key: Column) -> Column:
    """Key of the directory above; the empty string at the top."""
    return F.when(key.contains("/"), F.regexp_replace(key, "/[^/]*$", "")).otherwise(F.lit(""))


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a glob: ?, *, **, [..], {a,b} and escapes; * stays in a directory."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 1
        elif c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out += "[" + ("^/" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += re.escape(c)
        i += 1
    if depth:
        raise ValueError("open group in glob")
    return f"^{out}$"


def path_matches(path: Column, pattern: str) -> Column:
    """pattern is glob:... or regex:..., glob if neither."""
    kind, sep, rest = pattern.partition(":")
    if sep and kind == "regex":
        return path.rlike(f"^(?:{rest})$")
    return path.rlike(glob_regex(rest if sep and kind == "glob" else pattern))


def permissions(mode: Column) -> Column:
    """rwxr-x--- of the lower nine bits."""
    bits = [F.when(mode.bitwiseAND(1 << 8 - i) != 0, "rwx"[i % 3]).otherwise("-") for i in range(9)]
    return F.concat(*bits)


def mode_of_permissions(text: Column) -> Column:
    out = F.lit(0)
    for i in range(9):
        out = out + F.when(F.substring(text, i + 1, 1) != "-", 1 << 8 - i).otherwise(0)
    return out


def mode_type(mode: Column) -> Column:
    """Entry type of the POSIX type bits."""
    kind = mode.bitwiseAND(0o170000)
    return F.when(kind.isin(0, 0o100000), "file").when(kind == 0o040000, "directory").when(kind == 0o120000, "symlink").otherwise("other")


def dos_time(date: Column, time: Column) -> Column:
    """Timestamp of a DOS date and time, taken as UTC; an impossible date is 1970."""
    part = lambda c, shift, mask: F.shiftright(c, shift).bitwiseAND(mask)
    made = F.try_make_timestamp(part(date, 9, 127) + 1980, part(date, 5, 15), part(date, 0, 31), part(time, 11, 31), part(time, 5, 63), part(time, 0, 31) * 2, F.lit("UTC"))
    return F.coalesce(made, F.timestamp_seconds(F.lit(0)))


def windows_time(ticks: Column) -> Column:
    """Timestamp of 100 ns ticks since 1601."""
    return F.timestamp_micros(F.floor((ticks - 116444736000000000) / 10).cast("long"))


def byte_values(data: Column) -> Column:
    digits = F.hex(data)
    return F.transform(F.filter(F.sequence(F.lit(0), F.octet_length(data)), lambda i: i < F.octet_length(data)), lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))


def adler32(data: Column) -> Column:
    start = F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    step = lambda s, x: F.struct(((s["a"] + x) % 65521).alias("a"), ((s["b"] + s["a"] + x) % 65521).alias("b"))
    return F.aggregate(byte_values(data), start, step, lambda s: s["b"] * 65536 + s["a"])


def byte_sum(data: Column) -> Column:
    """Sum of all bytes modulo 2^32, as CPIO has it."""
    return F.aggregate(byte_values(data), F.lit(0).cast("long"), lambda a, x: (a + x) % (1 << 32))


def delta_encode(data: Column, distance: int = 1) -> Column:
    """The delta filter as an expression; hexadecimal digits carry the bytes."""
    v = byte_values(data)
    return F.unhex(F.array_join(F.transform(v, lambda x, i: F.lpad(F.hex(F.pmod(x - F.when(i >= distance, F.get(v, i - distance)).otherwise(0), F.lit(256))), 2, "0")), ""))


# --- path algebra ---------------------------------------------------------------------------------


def path_normalized(path: Column) -> Column:
    """Without empty and `.` parts, `..` taken with the part before it; the root stays."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    up = lambda done: F.slice(done, 1, F.size(done) - 1)
    step = lambda done, p: F.when((p == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != ".."), up(done)).when((p == "..") & path.startswith("/"), done).otherwise(F.concat(done, F.array(p)))
    text = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), text)).otherwise(text)


def path_resolved(base: Column, other: Column) -> Column:
    """`other` as seen from `base`: itself if absolute, `base` if empty."""
    return F.when(other.startswith("/"), other).when(other == "", base).when((base == "") | base.endswith("/"), F.concat(base, other)).otherwise(F.concat_ws("/", base, other))


def path_relative(base: Column, other: Column) -> Column:
    """The way from `base` to `other`, both normalized and of one kind; null if only one is absolute."""
    a = F.filter(F.split(base, "/"), lambda p: p != "")
    b = F.filter(F.split(other, "/"), lambda p: p != "")
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    n = F.when(F.array_position(same, False) == 0, F.size(same)).otherwise(F.array_position(same, False).cast("int") - 1)
    way = F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(a) - n), F.slice(b, n + 1, F.size(b))), "/")
    return F.when(base.startswith("/") == other.startswith("/"), way)


def path_starts_with(path: Column, prefix: Column) -> Column:
    """By whole parts."""
    return (path == prefix) | path.startswith(F.concat(F.regexp_replace(prefix, "/$", ""), F.lit("/")))


def file_name(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, "/+$", ""), "[^/]*$", 0)
