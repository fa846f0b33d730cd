"""AR: 60-byte headers; GNU name table, BSD inline names, symbol tables skipped."""

from __future__ import annotations

from ..errors import MalformedData
from .entry import DIRECTORY, Entry, Limits, Tracker, exactly, mode_of_type, safe_path, slice_of, type_of_mode, text_of

MAGIC = b"!<arch>\n"


def _number(raw: bytes, base: int = 10) -> int:
    text = raw.strip()
    try:
        return int(text, base) if text else 0
    except ValueError:
        raise MalformedData("number field") from None


def read(f, limits: Limits = Limits(), charset=None, **_):
    tracker = Tracker(limits)
    f.seek(0)
    if f.read(8) != MAGIC:
        raise MalformedData("not an AR archive")
    names = b""
    at = 8
    while True:
        f.seek(at)
        head = f.read(60)
        if not head:
            return
        if len(head) != 60 or head[58:] != b"`\n":
            raise MalformedData("member header")
        tracker.header(60)
        size, start = _number(head[48:58]), at + 60
        at = start + size + size % 2
        ident = head[:16].rstrip(b" ")
        if ident in (b"/", b"/SYM64/") or ident.startswith(b"__.SYMDEF"):
            continue
        if ident == b"//":
            tracker.header(size)
            names = exactly(f, size)
            continue
        name = ident
        if ident.startswith(b"#1/"):
            n = _number(ident[3:])
            if n > size:
                raise MalformedData("name longer than the member")
            tracker.header(n)
            name = exactly(f, n).rstrip(b"\0")
            start, size = start + n, size - n
            if name.startswith(b"__.SYMDEF"):
                continue
        elif ident[:1] == b"/" and ident[1:].isdigit():
            k = int(ident[1:])
            end = names.find(b"\n", k)
            if k >= len(names) or end < 0:
                raise MalformedData("name table")
            name = names[k:end].rstrip(b"/")
        elif ident.endswith(b"/"):
            name = ident[:-1]
        mode = _number(head[40:48], 8)
        e = Entry(safe_path(text_of(name, charset)), type_of_mode(mode), size, mode & 0o7777, _number(head[16:28]) * 10**9, fields={"identifier": ident.decode("latin-1"), "uid": _number(head[28:34]), "gid": _number(head[34:40]), "mode": mode, "data_offset": start}, body=slice_of(f, start, size))
        tracker.entry(e)
        yield e


def write(entries, out, **_) -> None:
    out.write(MAGIC)
    for e in entries:
        if e.type not in ("file", DIRECTORY):
            raise ValueError("AR holds files")
        body, name = e.read(), e.path.encode()
        seconds = (e.mtime or 0) // 10**9
        if seconds < 0:
            raise ValueError("negative time")
        short = e.path.isascii() and len(name) <= 15 and b" " not in name and b"/" not in name
        ident, lead = (name + b"/", b"") if short else (b"#1/%d" % len(name), name)
        mode = (e.mode if e.mode is not None else 0o644) | mode_of_type(e.type)
        fields = [(ident, 16), (b"%d" % seconds, 12), (b"%d" % (e.fields.get("uid") or 0), 6), (b"%d" % (e.fields.get("gid") or 0), 6), (b"%o" % mode, 8), (b"%d" % (len(lead) + len(body)), 10)]
        if any(len(v) > n for v, n in fields):
            raise ValueError("a value is too wide for its field")
        out.write(b"".join(v.ljust(n) for v, n in fields) + b"`\n" + lead + body + b"\n" * ((len(lead) + len(body)) % 2))
