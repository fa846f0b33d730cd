"""CPIO: new ASCII with and without checksum, old ASCII, old binary of both byte orders."""

from __future__ import annotations

import struct

from ..errors import MalformedData
from .entry import SYMLINK, Entry, Limits, Tracker, entry_key, exactly, mode_of_type, slice_of, type_of_mode, text_of

TRAILER = "TRAILER!!!"
_NEW = ("inode", "mode", "uid", "gid", "nlink", "mtime", "size", "dev_major", "dev_minor", "rdev_major", "rdev_minor", "namesize", "checksum")
_OLD = (("dev", 6), ("inode", 6), ("mode", 6), ("uid", 6), ("gid", 6), ("nlink", 6), ("rdev", 6), ("mtime", 11), ("namesize", 6), ("size", 11))
_BINARY = ("dev", "inode", "mode", "uid", "gid", "nlink", "rdev", "mtime_hi", "mtime_lo", "namesize", "size_hi", "size_lo")


def _ascii(raw: bytes, base: int) -> int:
    try:
        return int(raw, base)
    except ValueError:
        raise MalformedData("number field") from None


def _header(f) -> tuple[str, str | None, dict, int]:
    """(dialect, byte order, fields, alignment) at the file's place."""
    magic = exactly(f, 2)
    if magic in (b"\xc7\x71", b"\x71\xc7"):
        order = "<" if magic == b"\xc7\x71" else ">"
        h = dict(zip(_BINARY, struct.unpack(order + "12H", exactly(f, 24))))
        h["mtime"] = h.pop("mtime_hi") << 16 | h.pop("mtime_lo")
        h["size"] = h.pop("size_hi") << 16 | h.pop("size_lo")
        return "binary", "little" if order == "<" else "big", h, 2
    magic += exactly(f, 4)
    if magic in (b"070701", b"070702"):
        raw = exactly(f, 104)
        return "crc" if magic == b"070702" else "newc", None, {k: _ascii(raw[i * 8 : i * 8 + 8], 16) for i, k in enumerate(_NEW)}, 4
    if magic == b"070707":
        h = {}
        for k, n in _OLD:
            h[k] = _ascii(exactly(f, n), 8)
        return "odc", None, h, 1
    raise MalformedData("not a CPIO header")


def read(f, limits: Limits = Limits(), charset=None, **_):
    tracker = Tracker(limits)
    at = 0
    while True:
        f.seek(at)
        dialect, order, h, align = _header(f)
        tracker.header(f.tell() - at + h["namesize"])
        name = exactly(f, h["namesize"])
        if name[-1:] != b"\0" or b"\0" in name[:-1]:
            raise MalformedData("name")
        start = at + -(-(f.tell() - at) // align) * align
        size = h["size"]
        at = start + -(-size // align) * align
        path = text_of(name[:-1], charset)
        if path == TRAILER:
            return
        key = path.replace("\\", "/")
        if key.startswith("/") or key[1:2] == ":" or ".." in key.split("/"):
            raise MalformedData(f"unsafe entry path {path!r}")
        body = slice_of(f, start, size)
        if dialect == "crc" and sum(body()) & 0xFFFFFFFF != h["checksum"]:
            raise MalformedData("body checksum")
        f.seek(start + size)
        if len(f.read(at - start - size)) != at - start - size or _size(f) < start + size:
            raise MalformedData("truncated archive")
        if not (key := entry_key(key)):
            continue
        kind = type_of_mode(h["mode"])
        fields = {k: v for k, v in h.items() if k not in ("namesize", "size", "mtime")} | {"dialect": dialect, "byte_order": order}
        if dialect != "crc":
            fields.pop("checksum", None)
        e = Entry(key, kind, size, h["mode"] & 0o7777, h["mtime"] * 10**9, link_target=text_of(body(), charset) if kind == SYMLINK else None, fields=fields, body=body)
        tracker.entry(e)
        yield e


def _size(f) -> int:
    at = f.tell()
    f.seek(0, 2)
    n = f.tell()
    f.seek(at)
    return n


def write(entries, out, dialect: str = "newc", byte_order: str = "little", block_size: int = 512, **_) -> None:
    total = 0

    def put(name: str, mode: int, body: bytes, mtime: int, inode: int, nlink: int, e: Entry | None) -> None:
        nonlocal total
        raw = name.encode() + b"\0"
        get = (e.fields if e else {}).get
        uid, gid = get("uid") or 0, get("gid") or 0
        if dialect in ("newc", "crc"):
            values = (inode, mode, uid, gid, nlink, mtime, len(body), get("dev_major") or 0, get("dev_minor") or 0, get("rdev_major") or 0, get("rdev_minor") or 0, len(raw), sum(body) & 0xFFFFFFFF if dialect == "crc" else 0)
            if any(not 0 <= v < 1 << 32 for v in values):
                raise ValueError("a value is out of range")
            head, align = (b"070702" if dialect == "crc" else b"070701") + b"".join(b"%08X" % v for v in values), 4
        elif dialect == "odc":
            values = dict(dev=get("dev") or 0, inode=inode, mode=mode, uid=uid, gid=gid, nlink=nlink, rdev=get("rdev") or 0, mtime=mtime, namesize=len(raw), size=len(body))
            if any(not 0 <= values[k] < 8**n for k, n in _OLD):
                raise ValueError("a value is out of range")
            head, align = b"070707" + b"".join(b"%0*o" % (n, values[k]) for k, n in _OLD), 1
        else:
            order = "<" if byte_order == "little" else ">"
            head, align = struct.pack(order + "13H", 0o070707, get("dev") or 0, inode, mode, uid, gid, nlink, get("rdev") or 0, mtime >> 16 & 0xFFFF, mtime & 0xFFFF, len(raw), len(body) >> 16, len(body) & 0xFFFF), 2
        part = head + raw
        part += b"\0" * (-len(part) % align) + body + b"\0" * (-len(body) % align)
        out.write(part)
        total += len(part)

    for i, e in enumerate(entries, 1):
        body = (e.link_target or "").encode() if e.type == SYMLINK else e.read()
        put(e.path, (e.mode if e.mode is not None else 0o644) | mode_of_type(e.type), body, (e.mtime or 0) // 10**9, i, 1, e)
    put(TRAILER, 0, b"", 0, 0, 1, None)
    out.write(b"\0" * (-total % block_size))
