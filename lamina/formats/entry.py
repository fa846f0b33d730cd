"""Entries, limits, and what parsers share."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from ..errors import LimitExceeded, MalformedData, Unsupported

FILE, DIRECTORY, SYMLINK, HARDLINK, OTHER = "file", "directory", "symlink", "hardlink", "other"


@dataclass
class Entry:
    """One entry as stored; times are nanoseconds since 1970, unknown values None."""

    path: str
    type: str = FILE
    size: int | None = None
    mode: int | None = None
    mtime: int | None = None
    atime: int | None = None
    ctime: int | None = None
    link_target: str | None = None
    fields: dict = field(default_factory=dict)
    body: Callable[[], bytes] | bytes | None = None

    def read(self) -> bytes:
        if self.body is None:
            return b""
        return self.body if isinstance(self.body, bytes) else self.body()


@dataclass(frozen=True)
class Limits:
    """None is unlimited. Layers are outer compressions around an archive."""

    max_entry_count: int | None = None
    max_entry_size: int | None = None
    max_total_entry_size: int | None = None
    max_metadata_size: int | None = None
    max_decoded_archive_size: int | None = None
    max_outer_layers: int = 4
    max_window: int | None = None
    max_decoder_memory: int | None = None

    def output(self) -> int:
        """What one decoder may produce; always finite."""
        known = [x for x in (self.max_entry_size, self.max_total_entry_size) if x is not None]
        return min([*known, 1 << 31])


class Tracker:
    """Counts one archive against its limits, from the moment an entry's metadata is accepted.

    The first failure stays: later calls raise it again.
    """

    def __init__(self, limits: Limits):
        self.limits, self.count, self.total, self.metadata, self.failed = limits, 0, 0, 0, None

    def _check(self, kind: str, maximum: int | None, actual: int, path: str | None) -> None:
        if self.failed is not None:
            raise self.failed
        if maximum is not None and actual > maximum:
            self.failed = LimitExceeded(kind, maximum, actual, path)
            raise self.failed

    def entry(self, e: Entry) -> None:
        self.count += 1
        self._check("entry_count", self.limits.max_entry_count, self.count, e.path)
        if e.size is not None:
            self.body(e.path, e.size)

    def body(self, path: str, size: int) -> None:
        self._check("entry_size", self.limits.max_entry_size, size, path)
        self.total += size
        self._check("total_entry_size", self.limits.max_total_entry_size, self.total, path)

    def header(self, size: int) -> None:
        self.metadata += size
        self._check("metadata_size", self.limits.max_metadata_size, self.metadata, None)


_BAD = re.compile(r"^[/\\]|^.:|(^|[/\\])\.\.([/\\]|$)")


def safe_path(path: str) -> str:
    """The path, or an error where it leads outside or names nothing."""
    if _BAD.search(path) or not [p for p in re.split(r"[/\\]", path) if p not in ("", ".")]:
        raise MalformedData(f"unsafe entry path {path!r}")
    return path


def entry_key(path: str) -> str:
    return "/".join(p for p in re.split(r"[/\\]", path) if p not in ("", "."))


#: File type bits of POSIX modes.
_KINDS = {0o100000: FILE, 0o040000: DIRECTORY, 0o120000: SYMLINK}


def type_of_mode(mode: int) -> str:
    return _KINDS.get(mode & 0o170000, OTHER) if mode & 0o170000 else FILE


def mode_of_type(kind: str) -> int:
    return {v: k for k, v in _KINDS.items()}.get(kind, 0o100000)


def text_of(raw: bytes, charset, default: str = "utf-8") -> str:
    """Metadata as text, decoded strictly.

    charset is a name, names separated by commas of which the first that fits counts, or a detector: a
    function of the bytes that names one, or none for the default.
    """
    if callable(charset):
        charset = charset(raw) or default
    names = (charset or default).split(",")
    for i, name in enumerate(names):
        try:
            return raw.decode(name.strip())
        except LookupError:
            raise Unsupported(f"charset {name}") from None
        except UnicodeDecodeError as e:
            if i == len(names) - 1:
                raise MalformedData(str(e)) from None
    raise AssertionError


def secret_of(password, path: str | None):
    """A password as it was given, or what a provider, a function of the entry's path, gives."""
    return password(path) if callable(password) else password


def exactly(f, n: int) -> bytes:
    data = f.read(n)
    if len(data) != n:
        raise MalformedData("truncated archive")
    return data


def slice_of(f, offset: int, size: int) -> Callable[[], bytes]:
    def body() -> bytes:
        f.seek(offset)
        return exactly(f, size)

    return body


def dos_time(date: int, time: int) -> int | None:
    """Nanoseconds of a DOS date and time taken as UTC; an impossible date is 1970."""
    import datetime

    try:
        t = datetime.datetime(1980 + (date >> 9), date >> 5 & 15, date & 31, time >> 11, time >> 5 & 63, (time & 31) * 2, tzinfo=datetime.UTC)
    except ValueError:
        return 0
    return int(t.timestamp()) * 10**9


def to_dos(ns: int | None) -> tuple[int, int]:
    import datetime

    t = datetime.datetime.fromtimestamp((ns or 0) // 10**9, datetime.UTC)
    if t.year < 1980:
        return 0x21, 0
    return (t.year - 1980) << 9 | t.month << 5 | t.day, t.hour << 11 | t.minute << 5 | t.second // 2


WINDOWS_EPOCH = 11_644_473_600


def windows_time(ticks: int) -> int:
    return ticks * 100 - WINDOWS_EPOCH * 10**9
