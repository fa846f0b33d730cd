"""LZ4 blocks and frames."""

from __future__ import annotations

import struct

from ..errors import LimitExceeded, MalformedData, Unsupported

MAGIC, LEGACY = 0x184D2204, 0x184C2102
#: Maximum block sizes by code.
BLOCK_SIZES = {4: 1 << 16, 5: 1 << 18, 6: 1 << 20, 7: 1 << 22}


def _length(n: int) -> bytes:
    """What goes on after a nibble of 15."""
    return b"\xff" * (n // 255) + bytes([n % 255])


def block_encode(data: bytes, dictionary: bytes = b"") -> bytes:
    """Greedy matches by a table of four-byte strings; the last five bytes are literals."""
    src = dictionary[-65535:] + data
    base, n = len(src) - len(data), len(src)
    table: dict[bytes, int] = {}
    for i in range(0, max(0, base - 3)):
        table[src[i : i + 4]] = i
    out = bytearray()
    at = start = base
    limit = n - 12
    while at <= limit:
        key = src[at : at + 4]
        seen = table.get(key)
        table[key] = at
        if seen is None or at - seen > 65535:
            at += 1
            continue
        end, m = at + 4, seen + 4
        while end < n - 5 and src[end] == src[m]:
            end += 1
            m += 1
        _sequence(out, src[start:at], at - seen, end - at)
        at = start = end
    _sequence(out, src[start:n], 0, 0)
    return bytes(out)


def _sequence(out: bytearray, literals: bytes, distance: int, match: int) -> None:
    n, m = len(literals), match - 4 if match else 0
    out.append(min(n, 15) << 4 | (min(m, 15) if match else 0))
    if n >= 15:
        out += _length(n - 15)
    out += literals
    if match:
        out += distance.to_bytes(2, "little")
        if m >= 15:
            out += _length(m - 15)


def block_decode(data: bytes, max_output: int, dictionary: bytes = b"") -> tuple[bytes, int]:
    out = bytearray(dictionary[-65535:])
    base = len(out)
    at, n = 0, len(data)
    try:
        while at < n:
            token = data[at]
            at += 1
            count = token >> 4
            if count == 15:
                while True:
                    x = data[at]
                    at += 1
                    count += x
                    if x != 255:
                        break
            if at + count > n:
                raise MalformedData("literals beyond the block")
            out += data[at : at + count]
            at += count
            if len(out) - base > max_output:
                raise LimitExceeded("output", max_output, len(out) - base)
            if at == n:
                return bytes(out[base:]), n
            distance = data[at] | data[at + 1] << 8
            at += 2
            count = (token & 15) + 4
            if count == 19:
                while True:
                    x = data[at]
                    at += 1
                    count += x
                    if x != 255:
                        break
            if not 0 < distance <= len(out):
                raise MalformedData("match before the start")
            if len(out) - base + count > max_output:
                raise LimitExceeded("output", max_output, len(out) - base + count)
            start = len(out) - distance
            if distance >= count:
                out += out[start : start + count]
            else:
                unit = bytes(out[start:])
                out += (unit * (count // distance + 1))[:count]
    except IndexError:
        raise MalformedData("truncated block") from None
    if n == 0:
        raise MalformedData("empty block")
    raise MalformedData("the block ends with a match")


def _xxh32(data: bytes) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(data, 0)


def frame_encode(data: bytes, block_size: int = 7, independent: bool = True, block_checksum: bool = False, content_checksum: bool = True, content_size: bool = False, dictionary: bytes | None = None, dictionary_id: int | None = None) -> bytes:
    flags = 0x40 | independent << 5 | block_checksum << 4 | content_size << 3 | content_checksum << 2 | (dictionary_id is not None)
    head = bytes([flags, block_size << 4]) + (struct.pack("<Q", len(data)) if content_size else b"") + (struct.pack("<I", dictionary_id) if dictionary_id is not None else b"")
    out = [struct.pack("<I", MAGIC), head, bytes([_xxh32(head) >> 8 & 255])]
    history = dictionary or b""
    size = BLOCK_SIZES[block_size]
    for i in range(0, len(data), size):
        raw = data[i : i + size]
        packed = block_encode(raw, history)
        body, word = (packed, len(packed)) if len(packed) < len(raw) else (raw, len(raw) | 1 << 31)
        out += [struct.pack("<I", word), body] + ([struct.pack("<I", _xxh32(body))] if block_checksum else [])
        if not independent:
            history = (history + raw)[-65536:]
    out.append(b"\0\0\0\0")
    if content_checksum:
        out.append(struct.pack("<I", _xxh32(data)))
    return b"".join(out)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        part = self.data[self.at : self.at + n]
        if len(part) < n:
            raise MalformedData("truncated frame")
        self.at += n
        return part

    def u32(self) -> int:
        return int.from_bytes(self.take(4), "little")


def _legacy(r: _Reader, max_output: int) -> bytes:
    out, total = [], 0
    while r.at < len(r.data):
        n = r.u32()
        if n in (MAGIC, LEGACY) or n & 0xFFFFFFF0 == 0x184D2A50:
            r.at -= 4
            break
        part, _ = block_decode(r.take(n), min(1 << 23, max_output - total))
        out.append(part)
        total += len(part)
    return b"".join(out)


def _one(data: bytes, max_output: int, dictionary: bytes | None) -> tuple[bytes, int]:
    r = _Reader(data)
    magic = r.u32()
    if magic & 0xFFFFFFF0 == 0x184D2A50:
        r.take(r.u32())
        return b"", r.at
    if magic == LEGACY:
        return _legacy(r, max_output), r.at
    if magic != MAGIC:
        raise MalformedData("not an LZ4 frame")
    start = r.at
    flags, bd = r.take(2)
    if flags >> 6 != 1 or flags & 2 or bd & 0x8F or bd >> 4 not in BLOCK_SIZES:
        raise MalformedData("frame descriptor")
    size = int.from_bytes(r.take(8), "little") if flags & 8 else None
    if size is not None and size > max_output:
        raise LimitExceeded("output", max_output, size)
    wanted = r.u32() if flags & 1 else None
    if r.data[start : r.at] and r.take(1)[0] != _xxh32(data[start : r.at - 1]) >> 8 & 255:
        raise MalformedData("header checksum")
    if wanted is not None and dictionary is None:
        raise Unsupported(f"dictionary {wanted:08x} is needed")
    most, history = BLOCK_SIZES[bd >> 4], dictionary or b""
    out, total = [], 0
    while (word := r.u32()) != 0:
        n = word & 0x7FFFFFFF
        if n > most:
            raise MalformedData("block larger than declared")
        body = r.take(n)
        if flags & 16 and r.u32() != _xxh32(body):
            raise MalformedData("block checksum")
        part = body if word >> 31 else block_decode(body, min(most, max_output - total), history)[0]
        total += len(part)
        if total > max_output:
            raise LimitExceeded("output", max_output, total)
        out.append(part)
        if not flags & 32:
            history = (history + part)[-65536:]
    whole = b"".join(out)
    if flags & 4 and r.u32() != _xxh32(whole):
        raise MalformedData("content checksum")
    if size is not None and size != len(whole):
        raise MalformedData("content size differs")
    return whole, r.at


def frame_decode(data: bytes, max_output: int, single: bool = False, dictionary: bytes | None = None) -> tuple[bytes, int]:
    from .native import _frames

    return _frames(lambda d, m: _one(d, m, dictionary), data, max_output, single)
