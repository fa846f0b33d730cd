"""Deflate64: deflate with a window of 64 KiB, two more distance codes and long lengths."""

from __future__ import annotations

from ..errors import LimitExceeded, MalformedData

_ORDER = (16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15)


def _steps(first: int, groups: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(base, extra bits) of codes: each group has a number of codes with so many extra bits."""
    out = []
    for count, extra in groups:
        for _ in range(count):
            out.append((first, extra))
            first += 1 << extra
    return out


LENGTHS = _steps(3, [(8, 0), (4, 1), (4, 2), (4, 3), (4, 4), (4, 5)]) + [(3, 16)]
DISTANCES = _steps(1, [(4, 0)] + [(2, e) for e in range(1, 15)])


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.acc, self.n = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.n < n:
            if self.at >= len(self.data):
                raise MalformedData("truncated stream")
            self.acc |= self.data[self.at] << self.n
            self.at += 1
            self.n += 8

    def get(self, n: int) -> int:
        self.need(n)
        x = self.acc & ((1 << n) - 1)
        self.acc >>= n
        self.n -= n
        return x

    def align(self) -> None:
        drop = self.n % 8
        self.acc >>= drop
        self.n -= drop


class _Code:
    """Canonical code: symbols by (length, bits as they arrive)."""

    def __init__(self, lengths: list[int]):
        count = [0] * 16
        for n in lengths:
            count[n] += 1
        count[0] = 0
        code, first = 0, [0] * 16
        for n in range(1, 16):
            code = (code + count[n - 1]) << 1
            first[n] = code
            if code + count[n] > 1 << n:
                raise MalformedData("too many codes")
        self.table: dict[tuple[int, int], int] = {}
        for symbol, n in enumerate(lengths):
            if n:
                self.table[n, first[n]] = symbol
                first[n] += 1

    def read(self, bits: _Bits) -> int:
        code = 0
        for n in range(1, 16):
            code = code << 1 | bits.get(1)
            found = self.table.get((n, code))
            if found is not None:
                return found
        raise MalformedData("unknown code")


def _codes(bits: _Bits) -> tuple[_Code, _Code]:
    n_len, n_dist, n_pre = bits.get(5) + 257, bits.get(5) + 1, bits.get(4) + 4
    pre = [0] * 19
    for i in range(n_pre):
        pre[_ORDER[i]] = bits.get(3)
    code, lengths = _Code(pre), []
    while len(lengths) < n_len + n_dist:
        s = code.read(bits)
        if s < 16:
            lengths.append(s)
        elif s == 16:
            if not lengths:
                raise MalformedData("nothing to repeat")
            lengths += [lengths[-1]] * (3 + bits.get(2))
        else:
            lengths += [0] * (3 + bits.get(3) if s == 17 else 11 + bits.get(7))
    if len(lengths) > n_len + n_dist:
        raise MalformedData("code lengths run over")
    return _Code(lengths[:n_len]), _Code(lengths[n_len:])


def deflate64_decode(data: bytes, max_output: int) -> tuple[bytes, int]:
    bits, out = _Bits(data), bytearray()
    fixed = None
    last = False
    while not last:
        last, kind = bool(bits.get(1)), bits.get(2)
        if kind == 0:
            bits.align()
            n, check = bits.get(16), bits.get(16)
            if n ^ check != 0xFFFF:
                raise MalformedData("stored length")
            for _ in range(n):
                out.append(bits.get(8))
            if len(out) > max_output:
                raise LimitExceeded("output", max_output, len(out))
            continue
        if kind == 3:
            raise MalformedData("block kind")
        if kind == 1:
            fixed = fixed or (_Code([8] * 144 + [9] * 112 + [7] * 24 + [8] * 8), _Code([5] * 32))
            lit, dist = fixed
        else:
            lit, dist = _codes(bits)
        while (s := lit.read(bits)) != 256:
            if s < 256:
                out.append(s)
            else:
                if s - 257 >= len(LENGTHS):
                    raise MalformedData("length code")
                base, extra = LENGTHS[s - 257]
                n = base + bits.get(extra)
                d = dist.read(bits)
                if d >= len(DISTANCES):
                    raise MalformedData("distance code")
                base, extra = DISTANCES[d]
                back = base + bits.get(extra)
                if back > len(out):
                    raise MalformedData("match before the start")
                if len(out) + n > max_output:
                    raise LimitExceeded("output", max_output, len(out) + n)
                for _ in range(n):
                    out.append(out[-back])
            if len(out) > max_output:
                raise LimitExceeded("output", max_output, len(out))
    return bytes(out), bits.at - bits.n // 8


def deflate64_encode(data: bytes, level: int = 6) -> bytes:
    """Runs of one byte become long matches, the rest literals in the fixed code; level 0 stores."""
    if level == 0:
        parts = [data[i : i + 65535] for i in range(0, len(data), 65535)] or [b""]
        return b"".join(bytes([i == len(parts) - 1]) + len(p).to_bytes(2, "little") + (len(p) ^ 0xFFFF).to_bytes(2, "little") + p for i, p in enumerate(parts))
    acc, n = 0b011, 3
    out = bytearray()

    def put(value: int, bits: int) -> None:
        nonlocal acc, n
        acc |= value << n
        n += bits
        while n >= 8:
            out.append(acc & 255)
            acc >>= 8
            n -= 8

    def huffman(code: int, bits: int) -> None:
        put(int(f"{code:0{bits}b}"[::-1], 2), bits)

    def symbol(s: int) -> None:
        if s < 144:
            huffman(0x30 + s, 8)
        elif s < 256:
            huffman(0x190 + s - 144, 9)
        elif s < 280:
            huffman(s - 256, 7)
        else:
            huffman(0xC0 + s - 280, 8)

    table: dict[bytes, int] = {}
    at = 0
    while at < len(data):
        key = data[at : at + 3]
        seen = table.get(key) if len(key) == 3 else None
        table[key] = at
        if seen is None or at - seen > 65536:
            symbol(data[at])
            at += 1
            continue
        end, m = at + 3, seen + 3
        while end < len(data) and end - at < 65538 and data[end] == data[m]:
            end, m = end + 1, m + 1
        size, back = end - at, at - seen
        i = 28 if size > 257 else max(j for j, (b, _) in enumerate(LENGTHS[:28]) if b <= size)
        symbol(257 + i)
        put(size - LENGTHS[i][0], LENGTHS[i][1])
        j = max(j for j, (b, _) in enumerate(DISTANCES) if b <= back)
        huffman(j, 5)
        put(back - DISTANCES[j][0], DISTANCES[j][1])
        at = end
    symbol(256)
    if n:
        put(0, 8 - n)
    return bytes(out)
