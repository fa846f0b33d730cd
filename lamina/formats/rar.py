"""RAR 4 and 5, read only: headers, plain or encrypted, and bodies with their checks. Volumes are given joined:
what stands behind one is the next, and parts of a body are put together."""

from __future__ import annotations

import struct
import zlib

from ..errors import LimitExceeded, MalformedData, Unsupported
from ..functions import crypto
from ..functions.hashes import blake2sp
from . import rar_lz
from .entry import DIRECTORY, FILE, OTHER, SYMLINK, Entry, Limits, Tracker, dos_time, exactly, safe_path, secret_of, text_of, type_of_mode, windows_time

OLD, NEW = b"Rar!\x1a\x07\x00", b"Rar!\x1a\x07\x01\x00"


def read(f, limits: Limits = Limits(), charset=None, search: int = 1 << 20, password=None, **_):
    """The signature may come after a self-extracting stub."""
    secret = secret_of(password, None)
    secret = secret.decode() if isinstance(secret, bytes) else secret
    f.seek(0)
    head = f.read(search + 8)
    at = head.find(b"Rar!\x1a\x07")
    if at < 0:
        raise MalformedData("no RAR signature")
    if head[at : at + 8] == NEW:
        return _five(f, at + 8, limits, secret)
    if head[at : at + 7] == OLD:
        return _four(f, at + 7, limits, charset, secret)
    raise MalformedData("no RAR signature")


def _vint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(raw) or shift > 63:
            raise MalformedData("number")
        value |= (raw[at] & 0x7F) << shift
        at += 1
        if not raw[at - 1] & 0x80:
            return value, at
        shift += 7


def _refuse(what: str):
    def body() -> bytes:
        raise Unsupported(what)

    return body


class Parts:
    """A body that may be spread over volumes: where its pieces are, and what makes them plain."""

    def __init__(self, f, path: str):
        self.f, self.path = f, path
        self.pieces: list[tuple[int, int]] = []
        self.plain = None  # from packed and encrypted to packed

    def packed(self) -> bytes:
        out = []
        for at, size in self.pieces:
            self.f.seek(at)
            out.append(exactly(self.f, size))
        whole = b"".join(out)
        return self.plain(whole) if self.plain else whole

    def size(self) -> int:
        return sum(n for _, n in self.pieces)


def _body(parts: Parts, real: int | None, stored: bool, number: int | None, chain: rar_lz.Chain, crc: int | None, blake: bytes | None, key: bytes | None, limits: Limits):
    """Reads, unpacks and checks; `key` is that of checksums beside encrypted bodies."""

    def body() -> bytes:
        if real is not None and real > limits.output():
            raise LimitExceeded("entry_size", limits.output(), real)
        data = parts.packed() if stored else chain.body(number)
        if stored and real is not None:
            if len(data) < real or len(data) > real and not parts.plain:
                raise MalformedData("stored sizes differ")
            data = data[:real]
        found = zlib.crc32(data).to_bytes(4, "little")
        if crc is not None and (crypto.rar_sum(key, found) if key else found) != crc.to_bytes(4, "little"):
            raise MalformedData(f"checksum of {parts.path}")
        if blake is not None and (crypto.rar_sum(key, blake2sp(data)) if key else blake2sp(data)) != blake:
            raise MalformedData(f"hash of {parts.path}")
        return data

    return body


def _secret(password: str | None) -> str:
    if password is None:
        raise Unsupported("a password is needed")
    return password


def _extra_records(raw: bytes):
    at = 0
    while at < len(raw):
        n, at = _vint(raw, at)
        end = at + n
        if end > len(raw):
            raise MalformedData("extra record")
        kind, at = _vint(raw, at)
        yield kind, raw[at:end]
        at = end


def _five_times(raw: bytes) -> dict[str, int]:
    flags, at = _vint(raw, 0)
    out, wanted = {}, [k for bit, k in ((2, "mtime"), (4, "ctime"), (8, "atime")) if flags & bit]
    for k in wanted:
        if flags & 1:
            out[k] = int.from_bytes(raw[at : at + 4], "little") * 10**9
            at += 4
        else:
            out[k] = windows_time(int.from_bytes(raw[at : at + 8], "little"))
            at += 8
    if flags & 1 and flags & 16:
        for k in wanted:
            ns = int.from_bytes(raw[at : at + 4], "little") & 0x3FFFFFFF
            out[k] += ns if ns < 10**9 else 0
            at += 4
    return out


def _five_lock(raw: bytes, q: int, flags: int, password: str | None) -> tuple[bytes, bytes, bytes, int]:
    """(salt and what follows it, key, key of checksums, place behind the salt) of an encryption record."""
    power, salt = raw[q], raw[q + 1 : q + 17]
    key, sums, check = crypto.rar_five(_secret(password), salt, power)
    return salt, key, sums, q + 17


def _five_header(f, at: int, key: bytes | None) -> tuple[bytes, int, int] | None:
    """(header from its size on, place of its kind in it, place behind it), or None at the end of the file."""
    f.seek(at)
    if key is None:
        head = f.read(7)
        if not head:
            return None
        if len(head) < 6:
            raise MalformedData("truncated block")
        size, p = _vint(head, 4)
        f.seek(at + 4)
        raw = exactly(f, p - 4 + size)
        end = at + p + size
    else:
        iv = f.read(16)
        if not iv:
            return None
        first = exactly(f, 16)
        head = crypto.cbc_decrypt(key, iv, first)
        size, p = _vint(head, 4)
        whole = -(-(p + size) // 16) * 16
        raw = (head + crypto.cbc_decrypt(key, first, exactly(f, whole - 16)))[: p + size]
        head, raw, end = raw[:4], raw[4:], at + 16 + whole
    if zlib.crc32(raw) != int.from_bytes(head[:4], "little"):
        raise MalformedData("block checksum" if key is None else "block checksum, or another password")
    return raw, p - 4, end


def _five(f, at: int, limits: Limits, password: str | None):
    tracker, chain = Tracker(limits), rar_lz.Chain()
    key, waiting = None, None
    while (block := _five_header(f, at, key)) is not None:
        raw, p, start = block
        tracker.header(start - at)
        kind, q = _vint(raw, p)
        flags, q = _vint(raw, q)
        extra_size, q = _vint(raw, q) if flags & 1 else (0, q)
        data_size, q = _vint(raw, q) if flags & 2 else (0, q)
        at = start + data_size
        if kind == 4:
            version, q = _vint(raw, q)
            checked, q = _vint(raw, q)
            _, key, _, q = _five_lock(raw, q, checked, password)
            if checked & 1 and crypto.rar_five(password, raw[q - 16 : q], raw[q - 17])[2] != raw[q : q + 8]:
                raise MalformedData("another password")
            continue
        if kind == 5:
            f.seek(at)
            if f.read(8) == NEW:
                at, key = at + 8, None
                continue
            break
        if kind != 2:
            continue
        what, q = _vint(raw, q)
        real, q = _vint(raw, q)
        attributes, q = _vint(raw, q)
        mtime = crc = None
        if what & 2:
            mtime, q = int.from_bytes(raw[q : q + 4], "little") * 10**9, q + 4
        if what & 4:
            crc, q = int.from_bytes(raw[q : q + 4], "little"), q + 4
        how, q = _vint(raw, q)
        host, q = _vint(raw, q)
        n, q = _vint(raw, q)
        path = safe_path(raw[q : q + n].decode("utf-8"))
        extra = raw[len(raw) - extra_size :] if extra_size else b""
        times, blake, locked = {"mtime": mtime}, None, None
        redirect, owner = {}, {}
        for record, value in _extra_records(extra):
            if record == 1:
                locked = value
            elif record == 2:
                k, v = _vint(value, 0)
                if k == 0:
                    blake = value[v : v + 32]
            elif record == 3:
                times |= _five_times(value)
            elif record == 5:
                k, v = _vint(value, 0)
                g, v = _vint(value, v)
                m, v = _vint(value, v)
                redirect = {"redirection_type": k, "redirection_flags": g, "redirection_target": value[v : v + m].decode("utf-8"), "redirection_target_dir": bool(g & 1)}
            elif record == 6:
                g, v = _vint(value, 0)
                for bit, key in ((1, "uname"), (2, "gname")):
                    if g & bit:
                        m, v = _vint(value, v)
                        owner[key] = value[v : v + m].decode("utf-8")
                        v += m
                for bit, key in ((4, "uid"), (8, "gid")):
                    if g & bit:
                        owner[key], v = _vint(value, v)
        shape = DIRECTORY if what & 1 else FILE
        if redirect:
            shape = SYMLINK if redirect["redirection_type"] in (1, 2, 3) else FILE if redirect["redirection_type"] in (4, 5) else OTHER
        method = how >> 7 & 7
        split = bool(flags & 8), bool(flags & 16)
        size = None if what & 8 else real
        if split[0] and waiting is not None and waiting[0].path == path:
            parts, e, sums = waiting
            parts.pieces.append((start, data_size))
            e.fields.update(packed_size=parts.size(), crc32=crc, blake2sp=blake, continues_next=split[1])
        else:
            parts, sums = Parts(f, path), None
            parts.pieces.append((start, data_size))
            if locked is not None:
                parts.plain, sums = _five_plain(locked, password)
            fields = {"host_os": ["windows", "unix"][host] if host < 2 else str(host), "file_attributes": attributes, "method": method, "packed_size": data_size, "unpacked_size": size, "crc32": crc, "blake2sp": blake, "encrypted": locked is not None, "continues_prev": split[0], "continues_next": split[1], "link_name": redirect.get("redirection_target") if shape == SYMLINK else None, **redirect, **owner}
            e = Entry(path, shape, size, attributes & 0o7777 if host == 1 else None, times["mtime"], times.get("atime", times["mtime"]), times.get("ctime", times["mtime"]), fields["link_name"], fields, _refuse("part of a volume set"))
        waiting = (parts, e, sums) if split[1] else None
        if e.fields["continues_prev"] or split[1]:
            if not e.fields["continues_prev"]:
                continue
        else:
            number = None
            if method and shape == FILE and not redirect:
                if size is None:
                    e.body = _refuse("compressed body of unknown size")
                elif how & 63 > 1:
                    e.body = _refuse(f"compression version {how & 63}")
                else:
                    window, large = 1 << 17 + (how >> 10 & (31 if how & 63 else 15)), bool(how & 63)
                    if window > limits.output():
                        raise LimitExceeded("window", limits.output(), window)
                    number = chain.add(parts.packed, size, bool(how & 64), lambda w=window, x=large: rar_lz.Five(w, x))
            if not method or number is not None:
                e.body = _body(parts, size if not redirect else None, not method, number, chain, crc, blake, sums, limits)
        tracker.entry(e)
        yield e
    if waiting is not None:
        tracker.entry(waiting[1])
        yield waiting[1]


def _five_plain(locked: bytes, password: str | None):
    """(decryption, key of checksums) of a body's encryption record; a missing password shows when it is read."""
    _, q = _vint(locked, 0)
    flags, q = _vint(locked, q)
    iv = locked[q + 17 : q + 33]

    def plain(packed: bytes) -> bytes:
        key, _, check = crypto.rar_five(_secret(password), locked[q + 1 : q + 17], locked[q])
        if flags & 1 and check != locked[q + 33 : q + 41]:
            raise MalformedData("another password")
        if len(packed) % 16:
            raise MalformedData("encrypted body")
        return crypto.cbc_decrypt(key, iv, packed)

    sums = crypto.rar_five(password, locked[q + 1 : q + 17], locked[q])[1] if flags & 2 and password is not None else None
    return plain, sums


def _four_name(raw: bytes, unicode_flag: bool, charset) -> str:
    """The name; with the flag, a plain name, a zero and a packed list of differences to it."""
    if not unicode_flag:
        return text_of(raw, charset)
    plain, zero, packed = raw.partition(b"\0")
    if not zero:
        return raw.decode("utf-8", "replace")
    out, high, at, flags, n = [], packed[0] if packed else 0, 1, 0, 0
    while at < len(packed):
        if n == 0:
            flags, at, n = packed[at], at + 1, 8
        n -= 2
        op = flags >> n & 3
        if at >= len(packed):
            break
        if op == 0:
            out.append(packed[at])
            at += 1
        elif op == 1:
            out.append(packed[at] | high << 8)
            at += 1
        elif op == 2:
            out.append(int.from_bytes(packed[at : at + 2], "little"))
            at += 2
        else:
            size = packed[at]
            at += 1
            add = 0
            if size & 0x80:
                add, at = packed[at], at + 1
            for _ in range((size & 0x7F) + 2):
                i = len(out)
                base = plain[i] if i < len(plain) else 0
                out.append((base + add & 0xFF) | high << 8 if size & 0x80 else base)
    return b"".join(x.to_bytes(2, "little") for x in out).decode("utf-16-le", "replace")


def _four_header(f, at: int, password: str | None, hidden: bool) -> tuple[bytes, int] | None:
    """(header, place behind it), or None at the end of the file."""
    f.seek(at)
    salt = f.read(8) if hidden else b""
    if hidden and len(salt) < 8:
        return None
    if not hidden:
        head = f.read(7)
        if not head:
            return None
        if len(head) < 7:
            raise MalformedData("truncated block")
        size = int.from_bytes(head[5:7], "little")
        if size < 7:
            raise MalformedData("block size")
        return head + exactly(f, size - 7), at + size
    key, iv = crypto.rar_three(_secret(password), salt)
    first = exactly(f, 16)
    head = crypto.cbc_decrypt(key, iv, first)
    size = int.from_bytes(head[5:7], "little")
    if size < 7:
        raise MalformedData("block size, or another password")
    whole = -(-size // 16) * 16
    return (head + crypto.cbc_decrypt(key, first, exactly(f, whole - 16)))[:size], at + 8 + whole


def _four(f, at: int, limits: Limits, charset, password: str | None):
    tracker, chain = Tracker(limits), rar_lz.Chain()
    hidden, waiting = False, None
    while (block := _four_header(f, at, password, hidden)) is not None:
        raw, start = block
        crc16, kind, flags, size = struct.unpack_from("<HBHH", raw)
        if kind not in (0x73, 0x74, 0x7B) and not flags & 0x8000:
            at = start
            continue
        if zlib.crc32(raw[2:]) & 0xFFFF != crc16:
            raise MalformedData("block checksum" if not hidden else "block checksum, or another password")
        tracker.header(start - at)
        if kind == 0x7B:
            f.seek(start)
            if f.read(7) == OLD:
                at, hidden = start + 7, False
                continue
            break
        if kind == 0x73:
            hidden, archive_solid = bool(flags & 0x80), bool(flags & 8)
            at = start
            continue
        packed, real, host, crc, when, version, method, n, attributes = struct.unpack_from("<IIBIIBBHI", raw, 7)
        p = 32
        if flags & 0x100:
            packed |= int.from_bytes(raw[p : p + 4], "little") << 32
            real |= int.from_bytes(raw[p + 4 : p + 8], "little") << 32
            p += 8
        at = start + packed
        if kind != 0x74:
            continue
        path = safe_path(_four_name(raw[p : p + n], bool(flags & 0x200), charset).replace("\\", "/"))
        salt = raw[p + n : p + n + 8] if flags & 0x400 else b""
        unix = host == 3
        folder = flags & 0xE0 == 0xE0 or not unix and attributes & 16
        shape = DIRECTORY if folder else type_of_mode(attributes) if unix else FILE
        split = bool(flags & 1), bool(flags & 2)
        if split[0] and waiting is not None and waiting[0].path == path:
            parts, e = waiting
            parts.pieces.append((start, packed))
            e.fields.update(packed_size=parts.size(), crc32=crc, continues_next=split[1])
        else:
            parts = Parts(f, path)
            parts.pieces.append((start, packed))
            if flags & 4:
                parts.plain = _four_plain(version, salt, password)
            mtime = dos_time(when >> 16, when & 0xFFFF)
            fields = {"host_os": {0: "msdos", 1: "os2", 2: "windows", 3: "unix", 4: "macos", 5: "beos"}.get(host, str(host)), "file_attributes": attributes, "method": method - 0x30, "packed_size": packed, "unpacked_size": real, "crc32": crc, "encrypted": bool(flags & 4), "continues_prev": split[0], "continues_next": split[1], "link_name": None}
            e = Entry(path, shape, real, attributes & 0o7777 if unix else None, mtime, mtime, mtime, None, fields, _refuse("part of a volume set"))
        waiting = (parts, e) if split[1] else None
        if e.fields["continues_prev"] or split[1]:
            if not e.fields["continues_prev"]:
                continue
        else:
            number = None
            if method != 0x30 and shape != DIRECTORY:
                if version in (29, 36):
                    solid = bool(flags & 0x10) or archive_solid and version < 20
                    number = chain.add(parts.packed, real, solid, lambda: rar_lz.Four(1 << 22))
                else:
                    e.body = _refuse(f"compression of version {version}")
            if method == 0x30 or number is not None:
                e.body = _body(parts, real, method == 0x30, number, chain, crc, None, None, limits)
            if shape == SYMLINK and not flags & 4:
                e.link_target = e.fields["link_name"] = text_of(e.body(), charset)
        tracker.entry(e)
        yield e
    if waiting is not None:
        tracker.entry(waiting[1])
        yield waiting[1]


def _four_plain(version: int, salt: bytes, password: str | None):
    def plain(packed: bytes) -> bytes:
        if version < 29:
            raise Unsupported(f"encryption of version {version}")
        if len(packed) % 16:
            raise MalformedData("encrypted body")
        return crypto.cbc_decrypt(*crypto.rar_three(_secret(password), salt), packed)

    return plain
