"""Archive formats as pure parsers and writers on seekable binary files; no Spark here."""

from __future__ import annotations

from . import ar, cpio, rar, sevenz, tar, zip_
from .entry import Entry, Limits, Tracker

#: In catalog order: name, other names, extensions, bytes that detection looks at, reader, writer.
CATALOG = {
    "7z": (("sevenzip",), ("7z",), 6, sevenz.read, sevenz.write),
    "ar": ((), ("a", "ar", "deb"), 8, ar.read, ar.write),
    "cpio": ((), ("cpio",), 26, cpio.read, cpio.write),
    "rar": ((), ("rar",), 8, rar.read, None),
    "tar": ((), ("tar", "tgz", "taz", "tlz", "txz"), 1024, tar.read, tar.write),
    "zip": ((), ("zip", "jar"), 4, zip_.read, zip_.write),
}


def find(name: str) -> str | None:
    """Catalog name of a format by its name or another; letters' case doesn't count."""
    low = name.lower()
    return next((k for k, v in CATALOG.items() if low == k or low in v[0]), None)


__all__ = ["CATALOG", "Entry", "Limits", "Tracker", "find"]
