"""TAR: V7, ustar, xstar, GNU and PAX, with GNU and PAX sparse files."""

from __future__ import annotations

import re

from ..errors import MalformedData
from .entry import DIRECTORY, FILE, HARDLINK, OTHER, SYMLINK, Entry, Limits, Tracker, exactly, safe_path, slice_of, text_of

BLOCK = 512


def _number(raw: bytes) -> int:
    if raw and raw[0] & 0x80:
        value = int.from_bytes(raw, "big") & ((1 << (8 * len(raw) - 1)) - 1)
        return value - (1 << (8 * len(raw) - 1)) if raw[0] & 0x40 else value
    text = raw.strip(b" \0")
    if not text:
        return 0
    if not re.fullmatch(rb"[0-7]+", text):
        raise MalformedData("number field")
    return int(text, 8)


def _text(raw: bytes) -> bytes:
    return raw.split(b"\0", 1)[0]


def checksum_fits(block: bytes) -> bool:
    """The header's sum, of unsigned or of signed bytes, with its own field as spaces."""
    try:
        stored = _number(block[148:156])
    except MalformedData:
        return False
    rest = block[:148] + b" " * 8 + block[156:]
    unsigned = sum(rest)
    return stored in (unsigned, unsigned - 256 * sum(b > 127 for b in rest))


def _records(data: bytes) -> dict[str, str | bytes]:
    out, at = {}, 0
    while at < len(data):
        m = re.compile(rb"(\d{1,10}) ").match(data, at)
        if not m or not (n := int(m[1])) or at + n > len(data) or data[at + n - 1 : at + n] != b"\n":
            raise MalformedData("PAX record")
        key, eq, value = data[m.end() : at + n - 1].partition(b"=")
        if not eq:
            raise MalformedData("PAX record")
        out.setdefault("_order", []).append((key.decode(), value))
        out[key.decode()] = value
        at += n
    return out


def _nanos(text: bytes) -> int:
    m = re.fullmatch(rb"(-?)(\d+)(?:\.(\d*))?", text)
    if not m:
        raise MalformedData("PAX time")
    ns = int(m[2]) * 10**9 + int((m[3] or b"").ljust(9, b"0")[:9] or 0)
    return -ns if m[1] else ns


def _old_sparse(f, head: bytes) -> tuple[list[tuple[int, int]], int, int]:
    """(segments, real size, extra header bytes) of an old GNU sparse header."""
    out, extra = [], 0

    def take(raw: bytes, n: int) -> None:
        for i in range(n):
            part = raw[i * 24 : i * 24 + 24]
            if not part[:12].strip(b"\0 "):
                return
            out.append((_number(part[:12]), _number(part[12:24])))

    take(head[386:482], 4)
    more = head[482]
    while more:
        block = exactly(f, BLOCK)
        extra += BLOCK
        take(block, 21)
        more = block[504]
    return out, _number(head[483:495]), extra


def _sparse_body(stored, segments: list[tuple[int, int]], size: int, path: str):
    end = 0
    for offset, n in segments:
        if offset < end or n < 0 or offset + n > size:
            raise MalformedData(f"sparse map of {path}")
        end = offset + n

    def body() -> bytes:
        data, out, at = stored(), bytearray(size), 0
        if sum(n for _, n in segments) != len(data):
            raise MalformedData(f"sparse map of {path} doesn't fit its data")
        for offset, n in segments:
            out[offset : offset + n] = data[at : at + n]
            at += n
        return bytes(out)

    return body


def _pax_sparse(pax: dict, f, start: int, packed: int):
    """(segments, size, name, bytes of the map before the data), or None."""
    if "GNU.sparse.major" in pax and int(pax["GNU.sparse.major"]) == 1:
        f.seek(start)
        numbers: list[int] = []
        raw, count = b"", None
        while count is None or len(numbers) < 1 + 2 * count:
            raw += exactly(f, BLOCK)
            numbers = [int(x) for x in raw.split(b"\n")[:-1] if x.isdigit()]
            count = numbers[0] if numbers else None
            if len(raw) > packed:
                raise MalformedData("sparse map")
        pairs = numbers[1 : 1 + 2 * count]
        return list(zip(pairs[::2], pairs[1::2])), int(pax["GNU.sparse.realsize"]), pax.get("GNU.sparse.name"), len(raw)
    if "GNU.sparse.map" in pax:
        n = [int(x) for x in pax["GNU.sparse.map"].split(b",") if x]
        return list(zip(n[::2], n[1::2])), int(pax["GNU.sparse.size"]), pax.get("GNU.sparse.name"), 0
    if "GNU.sparse.numblocks" in pax:
        at = [int(v) for k, v in pax["_order"] if k == "GNU.sparse.offset"]
        n = [int(v) for k, v in pax["_order"] if k == "GNU.sparse.numbytes"]
        return list(zip(at, n)), int(pax["GNU.sparse.size"]), None, 0
    return None


def read(f, limits: Limits = Limits(), charset=None, **_):
    tracker = Tracker(limits)
    at, everywhere, local = 0, {}, {}
    long_name = long_link = None
    while True:
        f.seek(at)
        head = f.read(BLOCK)
        if not head:
            return
        if len(head) != BLOCK:
            raise MalformedData("truncated header")
        if not head.strip(b"\0"):
            return
        if not checksum_fits(head):
            raise MalformedData("header checksum")
        tracker.header(BLOCK)
        magic, flag = head[257:263], chr(head[156]) if head[156] else "0"
        size, start = _number(head[124:136]), at + BLOCK
        if flag in "xgLK":
            tracker.header(size)
            data = exactly(f, size)
            if flag == "x":
                local = _records(data)
            elif flag == "g":
                for k, v in _records(data).pop("_order", []):
                    everywhere.pop(k, None) if not v else everywhere.__setitem__(k, v)
            elif flag == "L":
                long_name = data.rstrip(b"\0")
            else:
                long_link = data.rstrip(b"\0")
            at = start + -(-size // BLOCK) * BLOCK
            continue
        pax = everywhere | local
        name, link = _text(head[:100]), _text(head[157:257])
        if magic == b"ustar\0":
            xstar = head[508:512] == b"tar\0" or (head[345:508].count(b"\0") and head[475:476] == b"\0" and head[508:512] == b"tar\0")
            prefix = _text(head[345 : 345 + (131 if xstar else 155)])
            if prefix:
                name = prefix + b"/" + name
        name, link = long_name or name, long_link or link
        code = "latin-1" if pax.get("hdrcharset") == b"BINARY" else charset
        path = text_of(pax["path"], code if code == "latin-1" else "utf-8") if "path" in pax else text_of(name, code)
        target = text_of(pax["linkpath"], "utf-8") if "linkpath" in pax else text_of(link, code)
        size = int(pax["size"]) if "size" in pax else size
        packed = size
        segments = None
        if flag == "S":
            segments, real, extra = _old_sparse(f, head)
            start += extra
        elif found := _pax_sparse(pax, f, start, packed):
            segments, real, other, lead = found
            path = other.decode() if other else path
        at = start + -(-packed // BLOCK) * BLOCK
        kind = {"1": HARDLINK, "2": SYMLINK, "5": DIRECTORY}.get(flag, FILE if flag in "07S" else OTHER)
        if kind == FILE and magic[:5] != b"ustar" and path.endswith("/"):
            kind = DIRECTORY
        if kind != FILE:
            body, shown = b"", 0
        elif segments is not None:
            lead = lead if flag != "S" else 0
            body, shown = _sparse_body(slice_of(f, start + lead, packed - lead), segments, real, path), real
        else:
            body, shown = slice_of(f, start, packed), packed
        time = lambda k: _nanos(pax[k]) if k in pax else None
        ids = {k: int(pax[k]) if k in pax else _number(head[o : o + 8]) for k, o in (("uid", 108), ("gid", 116))}
        mode = _number(head[100:108])
        fields = {"type_flag": flag, **ids, "uname": pax["uname"].decode() if "uname" in pax else text_of(_text(head[265:297]), code), "gname": pax["gname"].decode() if "gname" in pax else text_of(_text(head[297:329]), code), "is_hard_link": kind == HARDLINK, "link_name": target or None, "btime": time("LIBARCHIVE.creationtime"), "data_offset": start if kind == FILE and segments is None else None}
        e = Entry(safe_path(path), kind, shown, mode & 0o7777, time("mtime") if "mtime" in pax else _number(head[136:148]) * 10**9, time("atime"), time("ctime"), target if kind in (SYMLINK, HARDLINK) else None, fields, body)
        tracker.entry(e)
        yield e
        local, long_name, long_link = {}, None, None


def _octal(value: int, width: int) -> bytes | None:
    text = b"%o" % value if value >= 0 else b"x" * width
    return text.rjust(width - 1, b"0") + b"\0" if len(text) < width else None


def _split(name: bytes) -> tuple[bytes, bytes] | None:
    """(prefix, name) that fit their fields."""
    if len(name) <= 100:
        return b"", name
    cut = name.rfind(b"/", 0, 156)
    return (name[:cut], name[cut + 1 :]) if cut > 0 and 0 < len(name) - cut - 1 <= 100 else None


def _header(name: bytes, prefix: bytes, mode: int, uid: int, gid: int, size: int, mtime: int, flag: bytes, link: bytes, uname: bytes, gname: bytes) -> bytes:
    parts = [name.ljust(100, b"\0"), _octal(mode, 8), _octal(uid, 8), _octal(gid, 8), _octal(size, 12), _octal(mtime, 12), b" " * 8, flag, link.ljust(100, b"\0"), b"ustar\0" b"00", uname.ljust(32, b"\0"), gname.ljust(32, b"\0"), b"0000000\0" * 2, prefix.ljust(155, b"\0")]
    head = b"".join(parts).ljust(BLOCK, b"\0")
    return head[:148] + b"%06o\0 " % sum(head) + head[156:]


def _record(key: str, value: bytes) -> bytes:
    body = b" " + key.encode() + b"=" + value + b"\n"
    n = len(body) + 1
    while len(str(n)) + len(body) != n:
        n = len(str(n)) + len(body)
    return str(n).encode() + body


def write(entries, out, **_) -> None:
    """What ustar fields can't hold goes to a PAX header before the entry."""
    for e in entries:
        body = e.read() if e.type == FILE else b""
        path = e.path.encode() + (b"/" if e.type == DIRECTORY and not e.path.endswith("/") else b"")
        link = (e.link_target or "").encode() if e.type in (SYMLINK, HARDLINK) else b""
        get = e.fields.get
        uname, gname = (get("uname") or "").encode(), (get("gname") or "").encode()
        uid, gid, mtime = get("uid") or 0, get("gid") or 0, e.mtime or 0
        pax: dict[str, bytes] = {}
        fit = _split(path)
        if fit is None or not path.isascii():
            pax["path"] = path
        if len(link) > 100 or not link.isascii():
            pax["linkpath"] = link
        for k, v in (("uname", uname), ("gname", gname)):
            if len(v) > 32 or not v.isascii():
                pax[k] = v
        for k, v in (("uid", uid), ("gid", gid)):
            if _octal(v, 8) is None:
                pax[k] = b"%d" % v
        if _octal(len(body), 12) is None:
            pax["size"] = b"%d" % len(body)
        if mtime % 10**9 or _octal(mtime // 10**9, 12) is None:
            pax["mtime"] = _decimal(mtime)
        for k, v in (("atime", e.atime), ("ctime", e.ctime), ("LIBARCHIVE.creationtime", get("btime"))):
            if v is not None:
                pax[k] = _decimal(v)
        prefix, name = fit or (b"", path[:100])
        if pax:
            data = b"".join(_record(k, v) for k, v in pax.items())
            out.write(_header(b"PaxHeaders/entry", b"", 0o644, 0, 0, len(data), 0, b"x", b"", b"", b"") + data + b"\0" * (-len(data) % BLOCK))
        flag = {FILE: b"0", HARDLINK: b"1", SYMLINK: b"2", DIRECTORY: b"5"}[e.type]
        fits = lambda v, n: v if _octal(v, n) is not None else 0
        mode = e.mode if e.mode is not None else (0o755 if e.type == DIRECTORY else 0o644)
        out.write(_header(name, prefix, mode, fits(uid, 8), fits(gid, 8), fits(len(body), 12), fits(mtime // 10**9, 12), flag, link[:100], uname[:32], gname[:32]) + body + b"\0" * (-len(body) % BLOCK))
    out.write(b"\0" * 2 * BLOCK)


def _decimal(ns: int) -> bytes:
    sign, ns = ("-", -ns) if ns < 0 else ("", ns)
    return f"{sign}{ns // 10**9}.{ns % 10**9:09d}".rstrip("0").rstrip(".").encode()
