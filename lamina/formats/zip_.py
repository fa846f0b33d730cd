"""ZIP: by central directory or front to back; ZIP64, descriptors, encryption, all common methods."""

from __future__ import annotations

import os
import re
import struct
import zlib

from .. import codecs
from ..errors import LimitExceeded, MalformedData, Unsupported
from ..functions import crypto
from .entry import DIRECTORY, FILE, SYMLINK, Entry, Limits, Tracker, dos_time, entry_key, exactly, mode_of_type, safe_path, secret_of, slice_of, text_of, to_dos, type_of_mode, windows_time

#: Method ids.
METHODS = {0: "stored", 8: "deflated", 9: "deflate64", 12: "bzip2", 14: "lzma", 20: "zstd-deprecated", 93: "zstd", 95: "xz"}
CODECS = {8: "deflate", 9: "deflate64", 12: "bzip2", 20: "zstd", 93: "zstd", 95: "xz"}
LOCAL, CENTRAL, END, DESCRIPTOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x07\x08"


def extras(raw: bytes) -> dict[int, bytes]:
    out, at = {}, 0
    while at + 4 <= len(raw):
        kind, n = struct.unpack_from("<HH", raw, at)
        if at + 4 + n > len(raw):
            break
        out.setdefault(kind, raw[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def _name(raw: bytes, flags: int, extra: dict[int, bytes], charset) -> str:
    """The Unicode path field if it fits the raw name, else UTF-8 by flag, else the charset that is given or detected, or CP437."""
    u = extra.get(0x7075)
    if u and len(u) >= 5 and u[0] == 1 and int.from_bytes(u[1:5], "little") == zlib.crc32(raw):
        return u[5:].decode("utf-8")
    return text_of(raw, "utf-8" if flags & 0x800 else charset, "cp437")


def _times(local: dict[int, bytes], central: dict[int, bytes], dos: int | None) -> tuple[int | None, int | None, int | None]:
    """mtime, atime, ctime: extended timestamps of the local header, then of the central one, NTFS, DOS."""
    stamps = local.get(0x5455) or central.get(0x5455)
    if stamps:
        at, found = 1, []
        for bit in range(3):
            if stamps[0] >> bit & 1 and at + 4 <= len(stamps):
                found.append(struct.unpack_from("<i", stamps, at)[0] * 10**9)
                at += 4
            else:
                found.append(None)
        if found[0] is not None:
            return found[0], found[1] if found[1] is not None else found[0], found[2] if found[2] is not None else found[0]
    ntfs = local.get(0x000A) or central.get(0x000A)
    if ntfs and len(ntfs) >= 32 and struct.unpack_from("<HH", ntfs, 4) == (1, 24):
        return tuple(windows_time(x) for x in struct.unpack_from("<QQQ", ntfs, 8))
    return dos, dos, dos


def _owner(local: dict[int, bytes]) -> tuple[int | None, int | None]:
    raw = local.get(0x7875)
    if not raw or len(raw) < 3 or raw[0] != 1:
        return None, None
    n = raw[1]
    m = raw[2 + n] if 2 + n < len(raw) else 0
    return int.from_bytes(raw[2 : 2 + n], "little"), int.from_bytes(raw[3 + n : 3 + n + m], "little")


def _wide(extra: dict[int, bytes], values: list[tuple[str, int, int]]) -> dict[str, int]:
    """Values of the ZIP64 field for those that are all ones, in order."""
    raw, at, out = extra.get(1, b""), 0, {}
    for key, value, width in values:
        if value == (1 << 8 * width) - 1:
            n = 4 if width == 2 else 8
            if at + n > len(raw):
                raise MalformedData("ZIP64 field")
            value = int.from_bytes(raw[at : at + n], "little")
            at += n
        out[key] = value
    return out


def encryption(flags: int, method: int, extra: dict[int, bytes]) -> tuple[str | None, int, int]:
    """(scheme, AES bits, real method)."""
    if not flags & 1:
        return None, 0, method
    if method == 99:
        raw = extra.get(0x9901)
        if not raw or len(raw) < 7 or raw[4] not in (1, 2, 3):
            raise MalformedData("AES field")
        return f"aes-{64 + 64 * raw[4]}", 64 + 64 * raw[4], int.from_bytes(raw[5:7], "little")
    return "traditional", 0, method


def expand(raw: bytes, method: int, size: int | None, limits: Limits, path: str) -> bytes:
    most = limits.output() if size is None else min(limits.output(), size)
    if size is not None and size > limits.output():
        raise LimitExceeded("entry_size", limits.output(), size, path)
    if method == 0:
        return raw
    if method == 14:
        if len(raw) < 9 or int.from_bytes(raw[2:4], "little") != 5:
            raise MalformedData("LZMA header")
        p = raw[4]
        try:
            return codecs.decode("lzma-raw", raw[9:], max_output=most, dict_size=int.from_bytes(raw[5:9], "little"), lc=p % 9, lp=p // 9 % 5, pb=p // 45, decoded_size=size)
        except ValueError as e:
            raise e if isinstance(e, (LimitExceeded, MalformedData)) else MalformedData(str(e)) from None
    if method not in CODECS:
        raise Unsupported(f"method {method}")
    return codecs.decode(CODECS[method], raw, max_output=most)


def _body(f, at: int, packed: int, method: int, scheme: str | None, bits: int, flags: int, crc: int | None, size: int | None, check: int, password: bytes | None, limits: Limits, path: str, aes_version: int):
    def body() -> bytes:
        f.seek(at)
        raw = exactly(f, packed)
        if scheme:
            secret = secret_of(password, path)
            if secret is None:
                raise Unsupported(f"password for {path}")
            secret = secret.encode() if isinstance(secret, str) else secret
            if bits:
                raw = crypto.winzip_decrypt(raw, secret, bits)
            else:
                raw = crypto.Traditional(secret).decrypt(raw)
                if len(raw) < 12 or raw[11] != check:
                    raise Unsupported("wrong password")
                raw = raw[12:]
        data = expand(raw, method, size, limits, path)
        if size is not None and len(data) != size:
            raise MalformedData(f"size of {path}")
        if crc is not None and not (bits and aes_version == 2) and zlib.crc32(data) != crc:
            raise MalformedData(f"checksum of {path}")
        return data

    return body


def _kind(path: str, made_by: int, external: int) -> tuple[str, int | None]:
    mode = external >> 16
    if path.endswith("/"):
        return DIRECTORY, mode & 0o7777 or None
    if made_by >> 8 in (3, 19) and mode:
        return type_of_mode(mode), mode & 0o7777
    return FILE, None


def starts_of(f) -> list[int]:
    """Where the volumes of a joined file start."""
    return getattr(getattr(f, "raw", f), "starts", [0])


def directory(f) -> tuple[int, int, int, int]:
    """(offset of the central directory, its size, entries, bytes before the archive)."""
    disks = starts_of(f)
    f.seek(0, 2)
    end = f.tell()
    f.seek(max(0, end - 65557))
    tail = f.read()
    at = len(tail)
    while True:
        at = tail.rfind(END, 0, at)
        if at < 0:
            raise MalformedData("no end of central directory")
        if at + 22 <= len(tail) and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") == len(tail):
            break
    place = end - len(tail) + at
    _, disk, _, count, size, offset = struct.unpack_from("<HHHHII", tail, at + 4)
    real_end = place
    if place >= 20:
        f.seek(place - 20)
        locator = f.read(20)
        if locator[:4] == b"PK\x06\x07":
            wide = int.from_bytes(locator[8:16], "little")
            for candidate in (wide, place - 76):
                if candidate < 0:
                    continue
                f.seek(candidate)
                record = f.read(56)
                if record[:4] == b"PK\x06\x06":
                    disk, = struct.unpack_from("<I", record, 20)
                    count, size, offset = struct.unpack_from("<QQQ", record, 32)
                    real_end = candidate
                    break
            else:
                raise MalformedData("ZIP64 end record")
    if len(disks) > 1 and 0 < disk < len(disks):
        # a directory in volumes: places count from their volume's start
        return disks[disk] + offset, size, count, 0
    before = real_end - size - offset
    if before < 0 or size > 1 << 31:
        raise MalformedData("central directory place")
    return offset + before, size, count, before


def read(f, limits: Limits = Limits(), charset=None, password=None, mode: str = "index", raw: bool = False, **_):
    """raw: entries carry their bytes as they are stored, so that a writer can copy them."""
    return _streamed(f, limits, charset, password) if mode == "stream" else _indexed(f, limits, charset, password, raw)


def _indexed(f, limits: Limits, charset, password, keep: bool = False):
    tracker = Tracker(limits)
    disks = starts_of(f)
    start, size, count, before = directory(f)
    tracker.header(size)
    f.seek(start)
    raw, at, keys = exactly(f, size), 0, {}
    for _ in range(count):
        if raw[at : at + 4] != CENTRAL or at + 46 > len(raw):
            raise MalformedData("central record")
        made, need, flags, method, time, date, crc, packed, real, n, m, k, disk, internal, external, offset = struct.unpack_from("<6H3I5H2I", raw, at + 4)
        name, extra_raw, comment = raw[at + 46 : at + 46 + n], raw[at + 46 + n : at + 46 + n + m], raw[at + 46 + n + m : at + 46 + n + m + k]
        at += 46 + n + m + k
        extra = extras(extra_raw)
        wide = _wide(extra, [("real", real, 4), ("packed", packed, 4), ("offset", offset, 4), ("disk", disk, 2)])
        real, packed, offset = wide["real"], wide["packed"], wide["offset"] + before
        if len(disks) > 1:
            if wide["disk"] >= len(disks):
                raise MalformedData("disk number")
            offset = wide["offset"] + disks[wide["disk"]]
        f.seek(offset)
        head = exactly(f, 30)
        if head[:4] != LOCAL:
            raise MalformedData("local header")
        local_n, local_m = struct.unpack_from("<HH", head, 26)
        if exactly(f, local_n) != name or struct.unpack_from("<H", head, 8)[0] != method:
            raise MalformedData("local and central header differ")
        local_raw = exactly(f, local_m)
        local = extras(local_raw)
        path = safe_path(_name(name, flags, extra, charset).replace("\\", "/"))
        scheme, bits, inner = encryption(flags, method, extra)
        kind, posix = _kind(path, made, external)
        key = entry_key(path)
        if key in keys and not (kind == DIRECTORY and keys[key] == "implied"):
            raise MalformedData(f"entry {key} twice")
        keys[key] = kind
        parents = key.split("/")[:-1]
        for i in range(1, len(parents) + 1):
            above = "/".join(parents[:i])
            if keys.setdefault(above, "implied") not in ("implied", DIRECTORY):
                raise MalformedData(f"{above} is a file and a directory")
        check = (time >> 8) if flags & 8 else crc >> 24
        version = int.from_bytes(extra.get(0x9901, b"\0\0")[:2], "little")
        body = _body(f, offset + 30 + local_n + local_m, packed, inner, scheme, bits, flags, crc, real, check, password, limits, path, version)
        mtime, atime, ctime = _times(local, extra, dos_time(date, time))
        uid, gid = _owner(local)
        fields = {"raw_path": name, "comment": _name(comment, flags, {}, charset) or None, "raw_comment": comment, "compressed_size": packed, "crc32": crc, "gp_flags": flags, "version_made_by": made, "version_needed": need, "internal_attrs": internal, "external_attrs": external, "uid": uid, "gid": gid, "method_id": inner, "method": METHODS.get(inner), "encryption": scheme, "local_extra": local_raw, "central_extra": extra_raw}
        e = Entry(path, kind, real, posix, mtime, atime, ctime, None, fields, body)
        if keep and kind == FILE:
            fields["raw"] = slice_of(f, offset + 30 + local_n + local_m, packed)()
        if kind == SYMLINK and not scheme:
            e.link_target = body().decode("utf-8", "replace")
        tracker.entry(e)
        yield e


#: Marks that can end a body: its descriptor, or the record after an unsigned one.
_AFTER_BODY = re.compile(b"PK(?:\x07\x08|\x03\x04|\x01\x02)")


def _find_end(f, start: int, window: int = 1 << 20) -> tuple[int, int, int, int]:
    """(packed, real, crc, bytes of the descriptor) of a body whose sizes follow it.

    The first place counts where a descriptor states the way from the body's start. The file is read in
    windows up to that place, each with the last bytes of the one before.
    """
    begin, held, margin = 0, b"", 32
    while True:
        f.seek(start + begin + len(held))
        more = f.read(window)
        held += more
        # marks near the window's end wait for the bytes behind them
        last = len(held) - (margin if more else 0)
        for m in _AFTER_BODY.finditer(held):
            if m.start() >= last:
                break
            at, signed = begin + m.start(), m.group() == DESCRIPTOR
            for width, form in ((4, "<III"), (8, "<IQQ")):
                size = 4 + 2 * width
                place = m.start() + 4 if signed else m.start() - size
                if place < 0 or place + size > len(held):
                    continue
                crc, packed, real = struct.unpack_from(form, held, place)
                if signed and packed == at and held[place + size :][:4] in (LOCAL, CENTRAL, b"PK\x06\x06", END):
                    return packed, real, crc, 4 + size
                if not signed and packed == at - size:
                    return packed, real, crc, size
        if not more:
            raise MalformedData("no data descriptor")
        cut = max(0, len(held) - 2 * margin)
        begin, held = begin + cut, held[cut:]


def _streamed(f, limits: Limits, charset, password):
    """Local headers in physical order, after anything before the first."""
    tracker = Tracker(limits)
    f.seek(0)
    at = f.read().find(LOCAL)
    if at < 0:
        f.seek(0)
        if END in f.read():
            return
        raise MalformedData("no ZIP entry")
    while True:
        f.seek(at)
        mark = f.read(4)
        if mark != LOCAL:
            if mark in (CENTRAL, END, b"PK\x06\x06", b"PK\x06\x08"):
                return
            raise MalformedData("local header")
        need, flags, method, time, date, crc, packed, real, n, m = struct.unpack("<5H3I2H", exactly(f, 26))
        name, raw = exactly(f, n), exactly(f, m)
        tracker.header(30 + n + m)
        extra, start = extras(raw), f.tell()
        after = 0
        shown = real
        if flags & 8:
            packed, real, crc, after = _find_end(f, start)
            shown = None
        else:
            wide = _wide(extra, [("real", real, 4), ("packed", packed, 4)])
            real, packed = wide["real"], wide["packed"]
            shown = real
        path = safe_path(_name(name, flags, extra, charset).replace("\\", "/"))
        scheme, bits, inner = encryption(flags, method, extra)
        check = (time >> 8) if flags & 8 else crc >> 24
        version = int.from_bytes(extra.get(0x9901, b"\0\0")[:2], "little")
        mtime, atime, ctime = _times(extra, {}, dos_time(date, time))
        uid, gid = _owner(extra)
        fields = {"raw_path": name, "compressed_size": None if flags & 8 else packed, "crc32": None if flags & 8 else crc, "gp_flags": flags, "version_needed": need, "uid": uid, "gid": gid, "method_id": inner, "method": METHODS.get(inner), "encryption": scheme, "local_extra": raw}
        e = Entry(path, DIRECTORY if path.endswith("/") else FILE, shown, None, mtime, atime, ctime, None, fields, _body(f, start, packed, inner, scheme, bits, flags, crc, real, check, password, limits, path, version))
        tracker.entry(e)
        if shown is None:
            tracker.body(path, real)
        yield e
        at = start + packed + after


def compress(data: bytes, method: int, level: int | None = None) -> bytes:
    if method == 0:
        return data
    if method == 14:
        return b"\x09\x14\x05\x00\x5d" + (1 << 20).to_bytes(4, "little") + codecs.encode("lzma-raw", data)
    how = {"level": level} if level is not None and method in (8, 12, 93) else {}
    return codecs.encode(CODECS[method], data, **how)


def write(entries, out, method: str = "deflated", level: int | None = None, encrypt: str | None = None, password: str | bytes | None = None, descriptor: bool = False, preamble: bytes = b"", comment: bytes = b"", **_) -> None:
    """encrypt is traditional, aes-128, aes-192 or aes-256; an entry's fields may name its own method.

    An entry that carries its stored bytes (`raw`) is copied as it is. `out` may deal out volumes: then it
    keeps records whole and says where it is.
    """
    place = getattr(out, "place", None)
    whole = getattr(out, "whole", lambda n: None)
    ids = {v: k for k, v in METHODS.items()}
    secret = password.encode() if isinstance(password, str) else password
    out.write(preamble)
    at, records = len(preamble), []
    for e in entries:
        body = (e.link_target or "").encode() if e.type == SYMLINK else b"" if e.type == DIRECTORY or e.fields.get("raw") is not None else e.read()
        path = e.path + ("/" if e.type == DIRECTORY and not e.path.endswith("/") else "")
        name = path.encode()
        copied = e.fields.get("raw") if e.type == FILE else None
        inner = 0 if e.type != FILE else e.fields["method_id"] if copied is not None else ids[e.fields.get("method") or method]
        data, crc = (bytes(copied), e.fields["crc32"]) if copied is not None else (compress(body, inner, level), zlib.crc32(body))
        n_body = e.size if copied is not None else len(body)
        flags = 0x800 | (8 if descriptor and e.type == FILE else 0)
        date, time = to_dos(e.mtime)
        extra, shown = b"", inner
        if e.mtime is not None and -(1 << 31) <= e.mtime // 10**9 < 1 << 31:
            extra += struct.pack("<HHBi", 0x5455, 5, 1, e.mtime // 10**9)
        if e.fields.get("uid") is not None and e.fields.get("gid") is not None:
            extra += struct.pack("<HHBBIBI", 0x7875, 11, 1, 4, e.fields["uid"], 4, e.fields["gid"])
        if copied is not None and e.fields.get("encryption"):
            flags |= 1
            if e.fields["encryption"] == "traditional":
                # its check byte is that of the old header: of the time if a descriptor followed
                flags |= e.fields["gp_flags"] & 8
            else:
                field = extras(e.fields["central_extra"])[0x9901]
                extra += struct.pack("<HH", 0x9901, len(field)) + field
                shown = 99
        elif encrypt and e.type == FILE and copied is None:
            if secret is None:
                raise ValueError("a password is needed")
            flags |= 1
            if encrypt == "traditional":
                check = time >> 8 if flags & 8 else crc >> 24
                data = crypto.Traditional(secret).encrypt(os.urandom(11) + bytes([check]) + data)
            else:
                bits = int(encrypt.removeprefix("aes-"))
                extra += struct.pack("<HHHHBH", 0x9901, 7, 2, 0x4541, bits // 64 - 1, inner)
                data, shown, crc = crypto.winzip_encrypt(data, secret, bits, os.urandom(bits // 16)), 99, 0
        big = len(data) >= 0xFFFFFFFF or n_body >= 0xFFFFFFFF
        wide = struct.pack("<HHQQ", 1, 16, n_body, len(data)) if big else b""
        sizes = (0xFFFFFFFF, 0xFFFFFFFF) if big else (len(data), n_body)
        need = 45 if big else 51 if shown == 99 else 63 if inner in (14, 93, 95) else 20
        head = struct.pack("<4s5H3I2H", LOCAL, need, flags, shown, time, date, *((0, 0, 0) if flags & 8 and not big else (crc, *sizes)), len(name), len(wide + extra))
        tail = (DESCRIPTOR + struct.pack("<IQQ" if big else "<III", crc, len(data), n_body)) if flags & 8 else b""
        whole(len(head) + len(name) + len(wide) + len(extra))
        disk, here = place() if place else (0, at)
        out.write(head + name + wide + extra)
        out.write(data)
        whole(len(tail))
        out.write(tail)
        mode = (e.mode if e.mode is not None else 0o755 if e.type == DIRECTORY else 0o644) | mode_of_type(e.type)
        far = here >= 0xFFFFFFFF
        central_wide = (struct.pack("<QQ", n_body, len(data)) if big else b"") + (struct.pack("<Q", here) if far else b"")
        central_extra = (struct.pack("<HH", 1, len(central_wide)) + central_wide if central_wide else b"") + extra
        note = (e.fields.get("comment") or "").encode()
        records.append(struct.pack("<4s6H3I5H2I", CENTRAL, 3 << 8 | 63, need, flags, shown, time, date, crc, *sizes, len(name), len(central_extra), len(note), disk, 0, mode << 16 | (16 if e.type == DIRECTORY else 0), 0xFFFFFFFF if far else here - len(preamble) if preamble else here) + name + central_extra + note)
        at += len(head) + len(name) + len(wide) + len(extra) + len(data) + len(tail)
    central = b"".join(records)
    if place:
        there = []
        for r in records:
            whole(len(r))
            there.append(place())
            out.write(r)
        whole(22 + len(comment))
        first, begin = (there or [place()])[0]
        if max(place()[0], len(records)) >= 0xFFFF or begin >= 0xFFFFFFFF:
            raise Unsupported("ZIP64 in volumes")
        last = sum(disk == place()[0] for disk, _ in there)
        out.write(struct.pack("<4s4H2IH", END, place()[0], first, last, len(records), len(central), begin, len(comment)) + comment)
        return
    out.write(central)
    n, start = len(records), at - len(preamble)
    if n >= 0xFFFF or start >= 0xFFFFFFFF:
        out.write(struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, len(central), start))
        out.write(struct.pack("<4sIQI", b"PK\x06\x07", 0, at + len(central), 1))
    out.write(struct.pack("<4s4H2IH", END, 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), len(central), min(start, 0xFFFFFFFF), len(comment)) + comment)
