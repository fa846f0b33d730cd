"""Bodies of RAR 2.9 to 5: LZ with Huffman codes or PPMd, the filters of both, and the state that solid archives carry on."""

from __future__ import annotations

import zlib

import numpy as np

from ..codecs import ppmd
from ..errors import MalformedData, Unsupported

LONGEST = 15
#: Bytes behind the data, so that looking ahead needs no check.
MARGIN = bytes(16)


class Bits:
    """Bits of some bytes, the highest first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.end = bytes(data) + MARGIN, 8 * at, 8 * len(data)

    def peek(self, n: int) -> int:
        """Up to 32 bits ahead."""
        byte, skip = self.at >> 3, self.at & 7
        return int.from_bytes(self.data[byte : byte + 5], "big") >> 40 - skip - n & (1 << n) - 1

    def take(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > self.end + 64:
            raise MalformedData("truncated body")
        return value

    def align(self) -> None:
        self.at = -(-self.at // 8) * 8


class Code:
    """A canonical Huffman code as a table over the next 15 bits: symbol and length in one number, 0 for none."""

    def __init__(self, lengths: list[int]):
        sizes = np.array(lengths, dtype=np.int64)
        order = np.lexsort((np.arange(len(sizes)), sizes))
        order = order[sizes[order] > 0]
        reach = 1 << LONGEST - sizes[order]
        if reach.sum() > 1 << LONGEST:
            raise MalformedData("code lengths")
        table = np.zeros(1 << LONGEST, dtype=np.int64)
        table[: reach.sum()] = np.repeat(order << 4 | sizes[order], reach)
        self.table = table.tolist()

    def next(self, bits: Bits) -> int:
        found = self.table[bits.peek(LONGEST)]
        if not found:
            raise MalformedData("code")
        bits.at += found & 15
        return found >> 4


def small_lengths(bits: Bits, n: int = 20) -> list[int]:
    """Lengths of the code for code lengths: four bits each, 15 with a count stands for zeros."""
    out: list[int] = []
    while len(out) < n:
        size = bits.take(4)
        if size == 15 and (zeros := bits.take(4)):
            out += [0] * (zeros + 2)
        else:
            out.append(size)
    return out[:n]


def lengths_of(bits: Bits, n: int, before: list[int] | None = None) -> list[int]:
    """Lengths of all codes of a block; with `before`, as differences to those of the last block."""
    code = Code(small_lengths(bits))
    out: list[int] = []
    while len(out) < n:
        sign = code.next(bits)
        if sign < 16:
            out.append(sign if before is None else before[len(out)] + sign & 15)
            continue
        many = (3 + bits.take(3)) if not sign & 1 else 11 + bits.take(7)
        if sign < 18 and not out:
            raise MalformedData("nothing to repeat")
        out += [out[-1] if sign < 18 else 0] * many
    return out[:n]


# --- filters --------------------------------------------------------------------------------------


def calls_relative(data: bytes, place: int, jumps: bool, wrap: bool) -> bytes:
    """Targets of x86 calls, and jumps, below 16 MiB as distances again; wrap: places count up to there."""
    out, at = bytearray(data), 0
    limit = 1 << 24
    signs = np.frombuffer(data, np.uint8)
    for i in np.flatnonzero((signs == 0xE8) | (jumps & (signs == 0xE9))).tolist():
        if i < at or i + 4 >= len(out):
            continue
        at = i + 5
        here = (i + 1 + place) % limit if wrap else i + 1 + place
        target = int.from_bytes(out[i + 1 : i + 5], "little", signed=True)
        if -here <= target < 0:
            target += limit
        elif 0 <= target < limit:
            target -= here
        out[i + 1 : i + 5] = (target & 0xFFFFFFFF).to_bytes(4, "little")
    return bytes(out)


def arm_relative(data: bytes, place: int) -> bytes:
    """Targets of ARM's BL as distances again."""
    n = len(data) // 4
    w = np.frombuffer(data, "<u4", n)
    at = (np.arange(n, dtype=np.uint32) * np.uint32(4) + np.uint32(place & 0xFFFFFFFF)) >> np.uint32(2)
    moved = w & np.uint32(0xFF000000) | (w - at) & np.uint32(0xFFFFFF)
    return np.where(w >> np.uint32(24) == 0xEB, moved, w).astype("<u4").tobytes() + data[4 * n :]


def channels_joined(data: bytes, channels: int) -> bytes:
    """Channels that stand one after the other as differences, woven again."""
    if channels < 1:
        raise MalformedData("channels")
    out, at = np.zeros(len(data), np.uint8), 0
    source = np.frombuffer(data, np.uint8)
    for c in range(min(channels, len(data))):
        n = len(range(c, len(data), channels))
        out[c::channels] = np.uint8(0) - np.cumsum(source[at : at + n], dtype=np.uint8)
        at += n
    return out.tobytes()


def picture_joined(data: bytes, width: int, red: int) -> bytes:
    """Bytes of 24-bit pixels from their differences to Paeth-like predictions; green was taken off the others."""
    if width < 1 or red < 0:
        raise MalformedData("picture filter")
    n, out, at = len(data), bytearray(len(data)), 0
    for channel in range(3):
        last = 0
        for i in range(channel, n, 3):
            guess = last
            if i >= width + 3:
                up, corner = out[i - width], out[i - width - 3]
                base = last + up - corner
                a, b, c = abs(base - last), abs(base - up), abs(base - corner)
                guess = last if a <= b and a <= c else up if b <= c else corner
            last = out[i] = guess - data[at] & 255
            at += 1
    for i in range(red, n - 2, 3):
        green = out[i + 1]
        out[i], out[i + 2] = out[i] + green & 255, out[i + 2] + green & 255
    return bytes(out)


def sound_joined(data: bytes, channels: int) -> bytes:
    """Samples from their differences to a linear prediction whose three weights adapt."""
    if channels < 1:
        raise MalformedData("channels")
    out, at = bytearray(len(data)), 0
    for channel in range(channels):
        last = change = 0
        weights, errors = [0, 0, 0], [0] * 7
        d1 = d2 = d3 = 0
        for count, i in enumerate(range(channel, len(data), channels)):
            d1, d2, d3 = change, change - d1, d2
            guess = 8 * last + weights[0] * d1 + weights[1] * d2 + weights[2] * d3 >> 3 & 255
            raw = data[at]
            at += 1
            value = guess - raw & 255
            out[i] = value
            change = (value - last + 128 & 255) - 128
            last = value
            signed = (raw + 128 & 255) - 128 << 3
            for k, d in enumerate((0, -d1, d1, -d2, d2, -d3, d3)):
                errors[k] += abs(signed + d) if k else abs(signed)
            if count & 31 == 0:
                best = errors.index(min(errors))
                errors = [0] * 7
                if best:
                    k, up = (best - 1) // 2, best % 2 == 0
                    if up and weights[k] < 16:
                        weights[k] += 1
                    elif not up and weights[k] >= -16:
                        weights[k] -= 1
    return bytes(out)


class Output:
    """What was decoded, with as much of earlier files as the window holds, and filters that wait for their bytes."""

    def __init__(self, window: int):
        self.window = window
        self.bytes = bytearray()
        self.begin = 0  # where this file starts in `bytes`
        self.filters: list[tuple[int, int, object]] = []

    def file(self) -> None:
        if len(self.bytes) > 2 * self.window:
            del self.bytes[: len(self.bytes) - self.window]
        self.begin, self.filters = len(self.bytes), []

    def copy(self, size: int, back: int) -> None:
        out = self.bytes
        start = len(out) - back
        if back < 1 or start < 0:
            raise MalformedData("distance beyond the data")
        if back >= size:
            out += out[start : start + size]
        else:
            piece = out[start:]
            out += (piece * (size // back + 1))[:size]

    def result(self, size: int) -> bytes:
        """The file's bytes with filters applied; the window keeps them as they were."""
        if len(self.bytes) - self.begin < size:
            raise MalformedData("truncated body")
        out = bytearray(self.bytes[self.begin : self.begin + size])
        del self.bytes[self.begin + size :]
        for start, n, change in self.filters:
            if start < 0 or start + n > size:
                raise MalformedData("filter beyond the file")
            out[start : start + n] = change(bytes(out[start : start + n]), start)
        return bytes(out)


# --- version 5 ------------------------------------------------------------------------------------


class Five:
    """Bodies of RAR 5."""

    def __init__(self, window: int, large: bool = False):
        self.out = Output(window)
        self.large = large  # distances of RAR 7
        self.codes: list[Code] | None = None
        self.back, self.size = [0, 0, 0, 0], 0

    def decode(self, data: bytes, size: int, solid: bool) -> bytes:
        if not solid:
            self.__init__(self.out.window, self.large)
        self.out.file()
        bits = Bits(data)
        want = self.out.begin + size
        while len(self.out.bytes) < want:
            last = self._block(bits, want)
            if last:
                break
        return self.out.result(size)

    def _block(self, bits: Bits, want: int) -> bool:
        bits.align()
        flags, check = bits.take(8), bits.take(8)
        n = (flags >> 3 & 3) + 1
        if n == 4:
            raise MalformedData("block header")
        raw = [bits.take(8) for _ in range(n)]
        sum_ = 0x5A ^ flags
        for b in raw:
            sum_ ^= b
        if sum_ != check:
            raise MalformedData("block header checksum")
        stop = bits.at + 8 * (int.from_bytes(bytes(raw), "little") - 1) + (flags & 7) + 1
        if stop > bits.end:
            raise MalformedData("truncated body")
        if flags & 0x80:
            distances = 80 if self.large else 64
            lengths, self.codes = lengths_of(bits, 306 + distances + 16 + 44), []
            for m in (306, distances, 16, 44):
                self.codes.append(Code(lengths[:m]))
                lengths = lengths[m:]
        if self.codes is None:
            raise MalformedData("block without codes")
        main, far, low, repeated = self.codes
        out, raw_out = self.out, self.out.bytes
        table, data = main.table, bits.data
        while bits.at < stop and len(raw_out) < want:
            at = bits.at
            found = table[int.from_bytes(data[at >> 3 : (at >> 3) + 3], "big") >> 9 - (at & 7) & 0x7FFF]
            if not found:
                raise MalformedData("code")
            bits.at = at + (found & 15)
            sign = found >> 4
            if sign < 256:
                raw_out.append(sign)
            elif sign >= 262:
                size = self._size(bits, sign - 262)
                slot = far.next(bits)
                if slot < 4:
                    back = slot + 1
                else:
                    n = (slot >> 1) - 1
                    back = 1 + ((2 | slot & 1) << n)
                    if n >= 4:
                        back += (bits.take(n - 4) << 4 if n > 4 else 0) + low.next(bits)
                    else:
                        back += bits.take(n)
                size += (back > 0x100) + (back > 0x2000) + (back > 0x40000)
                self.back = [back, *self.back[:3]]
                self.size = size
                out.copy(size, back)
            elif sign == 256:
                self._filter(bits)
            elif sign == 257:
                if self.size:
                    out.copy(self.size, self.back[0])
            else:
                back = self.back.pop(sign - 258)
                self.back.insert(0, back)
                self.size = self._size(bits, repeated.next(bits))
                out.copy(self.size, back)
        bits.at = max(bits.at, stop)
        return bool(flags & 0x40)

    @staticmethod
    def _size(bits: Bits, slot: int) -> int:
        if slot < 8:
            return 2 + slot
        n = (slot >> 2) - 1
        return 2 + ((4 | slot & 3) << n) + bits.take(n)

    def _filter(self, bits: Bits) -> None:
        def number() -> int:
            n = bits.take(2) + 1
            return int.from_bytes(bytes(bits.take(8) for _ in range(n)), "little")

        start = number() + len(self.out.bytes) - self.out.begin
        size = number()
        kind = bits.take(3)
        if kind == 0:
            channels = bits.take(5) + 1
            change = lambda d, _: channels_joined(d, channels)
        elif kind in (1, 2):
            change = lambda d, place: calls_relative(d, place, kind == 2, True)
        elif kind == 3:
            change = arm_relative
        else:
            raise Unsupported(f"filter {kind}")
        self.out.filters.append((start, size, change))


# --- version 2.9 ----------------------------------------------------------------------------------

#: Sizes of matches and distances by slot: (first value, further bits).
_SIZES = [(i, 0) for i in range(8)] + [(8 + 2 * i, 1) for i in range(4)] + [((4 + i % 4) << 1 + i // 4, 1 + i // 4) for i in range(4, 20)]


def _distances() -> list[tuple[int, int]]:
    """Four slots without further bits, two for each number of them, but fourteen of 16 and twelve of 18."""
    out, first = [], 0
    for n, many in enumerate((4, *[2] * 15, 14, 0, 12)):
        for _ in range(many):
            out.append((first, n))
            first += 1 << n
    return out


_DISTANCES = _distances()
_SHORT = ((0, 2), (4, 2), (8, 3), (16, 4), (32, 5), (64, 6), (128, 6), (192, 6))
#: Fixed values: (length, CRC-32) of the programs of the usual filters.
_PROGRAMS = {(53, 0xAD576887): "calls", (57, 0x3CD7E57E): "jumps", (29, 0x0E06077D): "channels", (149, 0x1C2C5DC8): "picture", (216, 0xBC85E701): "sound"}


class ModelDecoder:
    """Range decoder of PPMd blocks."""

    def __init__(self, read):
        self.read = read
        self.low, self.range, self.code = 0, 0xFFFFFFFF, 0
        for _ in range(4):
            self.code = self.code << 8 | read()

    def threshold(self, total: int) -> int:
        self.range //= total
        return (self.code - self.low & 0xFFFFFFFF) // self.range

    def narrow(self, below: int, size: int, total: int) -> None:
        self.low = self.low + below * self.range & 0xFFFFFFFF
        self.range = self.range * size & 0xFFFFFFFF
        while True:
            if (self.low ^ self.low + self.range) & 0xFFFFFFFF >= 1 << 24:
                if self.range >= 1 << 15:
                    return
                self.range = -self.low & 0x7FFF
            self.code = (self.code << 8 | self.read()) & 0xFFFFFFFF
            self.range = self.range << 8 & 0xFFFFFFFF
            self.low = self.low << 8 & 0xFFFFFFFF

    def bit(self, size: int, wanted: int | None = None) -> int:
        out = int(self.threshold(ppmd.BINARY) >= size)
        self.narrow(size if out else 0, ppmd.BINARY - size if out else size, ppmd.BINARY)
        return out


class Four:
    """Bodies of RAR 2.9 to 4."""

    def __init__(self, window: int):
        self.out = Output(window)
        self.lengths = [0] * 404
        self.codes: list[Code] = []
        self.model: ppmd.Model | None = None
        self.escape = 2
        self.back, self.size = [0, 0, 0, 0], 0
        self.low, self.low_again = 0, 0
        self.tables = False
        self._no_programs()

    def _no_programs(self) -> None:
        self.programs: list[str] = []
        self.program_sizes: list[int] = []
        self.program = 0

    def decode(self, data: bytes, size: int, solid: bool) -> bytes:
        if not solid:
            self.__init__(self.out.window)
        self.out.file()
        self.bits = Bits(data)
        self.want = self.out.begin + size
        if size and not (solid and self.tables):
            self._read_tables()
        while len(self.out.bytes) < self.want:
            if not (self._model() if self.model_block else self._codes()):
                break
        else:
            self._after()
        return self.out.result(size)

    model_block = False

    def _after(self) -> None:
        """What stands behind the last byte: an end mark, which says whether new tables follow, or filters."""
        if self.model_block:
            return
        while self.bits.at < self.bits.end - 7:
            if not self._codes(behind=True):
                return

    def _byte(self) -> int:
        return self.bits.take(8)

    def _read_tables(self) -> None:
        bits = self.bits
        bits.align()
        self.tables = True
        self.model_block = bool(bits.peek(1))
        if self.model_block:
            flags = bits.take(8)
            memory = bits.take(8) + 1 << 20 if flags & 0x20 else 0
            if flags & 0x40:
                self.escape = bits.take(8)
            self.coder = ModelDecoder(self._byte)
            if flags & 0x20:
                order = (flags & 31) + 1
                order = order if order <= 16 else 16 + (order - 16) * 3
                if order < 2:
                    raise MalformedData("model order")
                self.model = ppmd.Model(order, memory)
            if self.model is None:
                raise MalformedData("block without model")
            return
        self.low, self.low_again = 0, 0
        bits.take(1)
        if not bits.take(1):
            self.lengths = [0] * 404
        self.lengths = lengths_of(bits, 404, self.lengths)
        rest, self.codes = self.lengths, []
        for n in (299, 60, 17, 28):
            self.codes.append(Code(rest[:n]))
            rest = rest[n:]

    def _codes(self, behind: bool = False) -> bool:
        """Up to the wanted size or a change of tables; False at the end mark. Behind the last byte only marks are read."""
        bits, out = self.bits, self.out
        main, far, low, repeated = self.codes
        data, table, raw = bits.data, main.table, out.bytes
        while behind or len(raw) < self.want:
            if bits.at > bits.end:
                raise MalformedData("truncated body")
            at = bits.at
            found = table[int.from_bytes(data[at >> 3 : (at >> 3) + 3], "big") >> 9 - (at & 7) & 0x7FFF]
            if not found:
                if behind:
                    return False
                raise MalformedData("code")
            sign = found >> 4
            if behind and sign not in (256, 257):
                return False
            bits.at = at + (found & 15)
            if sign < 256:
                raw.append(sign)
            elif sign >= 271:
                first, n = _SIZES[sign - 271]
                size = first + 3 + (bits.take(n) if n else 0)
                slot = far.next(bits)
                if slot >= len(_DISTANCES):
                    raise MalformedData("distance")
                back, n = _DISTANCES[slot]
                if slot > 9:
                    back += bits.take(n - 4) << 4 if n > 4 else 0
                    if self.low_again:
                        self.low_again -= 1
                    elif (x := low.next(bits)) == 16:
                        self.low_again = 15
                    else:
                        self.low = x
                    back += self.low
                elif n:
                    back += bits.take(n)
                back += 1
                self._match(size + (back >= 0x2000) + (back >= 0x40000), back)
            elif sign == 256:
                if bits.take(1):
                    self._read_tables()
                    return not behind
                self.tables = not bits.take(1)
                return False
            elif sign == 257:
                self._program(self._byte(), self._byte)
            elif sign == 258:
                if self.size:
                    out.copy(self.size, self.back[0])
            elif sign < 263:
                back = self.back.pop(sign - 259)
                first, n = _SIZES[repeated.next(bits)]
                self.back.insert(0, back)
                self.size = first + 2 + (bits.take(n) if n else 0)
                out.copy(self.size, back)
            else:
                first, n = _SHORT[sign - 263]
                self._match(2, first + 1 + bits.take(n))
        return True

    def _match(self, size: int, back: int) -> None:
        self.back = [back, *self.back[:3]]
        self.size = size
        self.out.copy(size, back)

    def _model(self) -> bool:
        model, out = self.model, self.out

        def step() -> int:
            byte = model.step(self.coder)
            if byte is None:
                raise MalformedData("end of the model")
            return byte

        while len(out.bytes) < self.want:
            byte = step()
            if byte != self.escape:
                out.bytes.append(byte)
                continue
            kind = step()
            if kind == 0:
                self._read_tables()
                return True
            if kind == 2:
                return False
            if kind == 3:
                self._program(step(), step)
            elif kind == 4:
                back = int.from_bytes(bytes(step() for _ in range(3)), "big")
                out.copy(step() + 32, back + 2)
            elif kind == 5:
                out.copy(step() + 4, 1)
            else:
                out.bytes.append(byte)
        return True

    def _program(self, first: int, read) -> None:
        """A filter: which program, over which bytes, with which registers."""
        n = (first & 7) + 1
        if n == 7:
            n = read() + 7
        elif n == 8:
            n = read() << 8 | read()
        bits = Bits(bytes(read() for _ in range(n)))

        def number() -> int:
            kind = bits.take(2)
            if kind == 0:
                return bits.take(4)
            if kind == 1:
                if bits.peek(4):
                    return bits.take(8)
                bits.take(4)
                return 0xFFFFFF00 | bits.take(8)
            return bits.take(16) if kind == 2 else bits.take(16) << 16 | bits.take(16)

        at = self.program
        if first & 0x80:
            at = number()
            if at == 0:
                self._no_programs()
            else:
                at -= 1
        if at > len(self.programs):
            raise MalformedData("filter program")
        self.program = at
        fresh = at == len(self.programs)
        start = number() + (258 if first & 0x40 else 0)
        size = number() if first & 0x20 else self.program_sizes[at] if not fresh else 0
        registers = [0] * 7
        if first & 0x10:
            mask = bits.take(7)
            registers = [number() if mask >> i & 1 else 0 for i in range(7)]
        if fresh:
            code = bytes(bits.take(8) for _ in range(number()))
            self.programs.append(_PROGRAMS.get((len(code), zlib.crc32(code)), ""))
            self.program_sizes.append(0)
        self.program_sizes[at] = size
        name = self.programs[at]
        changes = {
            "calls": lambda d, place: calls_relative(d, place, False, False),
            "jumps": lambda d, place: calls_relative(d, place, True, False),
            "channels": lambda d, _: channels_joined(d, registers[0]),
            "picture": lambda d, _: picture_joined(d, registers[0] - 3, registers[1]),
            "sound": lambda d, _: sound_joined(d, registers[0]),
        }
        if name not in changes:
            raise Unsupported("filter program of its own")
        self.out.filters.append((start + len(self.out.bytes) - self.out.begin, size, changes[name]))


class Chain:
    """The bodies of an archive in order: a solid one needs all since the last that isn't."""

    def __init__(self):
        self.items: list[tuple] = []  # (packed bytes, size, solid, decoder)
        self.at, self.state = 0, None

    def add(self, packed, size: int, solid: bool, make) -> int:
        self.items.append((packed, size, solid, make))
        return len(self.items) - 1

    def body(self, i: int) -> bytes:
        if i < self.at or self.state is None:
            self.at, self.state = self._start(i), None
        else:
            self.at = max(self.at, self._start(i))
        out = b""
        while self.at <= i:
            packed, size, solid, make = self.items[self.at]
            if self.state is None or not solid:
                self.state = make()
            try:
                out = self.state.decode(packed(), size, solid and self.at > 0)
            except Exception:
                self.state = None
                raise
            self.at += 1
        return out

    def _start(self, i: int) -> int:
        while i and self.items[i][2]:
            i -= 1
        return i
