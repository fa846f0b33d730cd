"""Size-preserving filters: delta and branch converters (BCJ), and BCJ2's merge and split."""

from __future__ import annotations

import lzma

import numpy as np

from ..errors import MalformedData


def delta_encode(data: bytes, distance: int = 1) -> bytes:
    a = np.frombuffer(data, np.uint8)
    out = a.copy()
    out[distance:] -= a[:-distance]
    return out.tobytes()


def delta_decode(data: bytes, distance: int = 1) -> bytes:
    n = len(data)
    rows = -(-n // distance)
    padded = np.zeros(rows * distance, np.uint8)
    padded[:n] = np.frombuffer(data, np.uint8)
    return np.cumsum(padded.reshape(rows, distance), axis=0, dtype=np.uint8).tobytes()[:n]


#: The cheapest settings of the coder behind which the library's filters stand: it only carries bytes here.
_CARRIER = {"id": lzma.FILTER_LZMA2, "dict_size": 4096, "mode": lzma.MODE_FAST, "mf": lzma.MF_HC3, "depth": 1, "nice_len": 3, "lc": 0, "lp": 0, "pb": 0}


def _library(kind: int):
    """A filter of liblzma: bytes go through it on one side of the carrier and come out plain on the other."""

    def run(data: bytes, encode: bool, start: int = 0) -> bytes:
        chain = [{"id": kind, "start_offset": start}, _CARRIER]
        there, back = (chain, [_CARRIER]) if encode else ([_CARRIER], chain)
        return lzma.decompress(lzma.compress(data, lzma.FORMAT_RAW, filters=there), lzma.FORMAT_RAW, filters=back)

    return run


def arm64(data: bytes, encode: bool, start: int = 0) -> bytes:
    """BL by words and, within 512 MiB of zero, ADRP by pages; whole words only."""
    whole = len(data) // 4 * 4
    w = np.frombuffer(data, "<u4", whole // 4).copy()
    at = (np.uint64(start) + np.arange(len(w), dtype=np.uint64) * np.uint64(4)).astype(np.uint32)
    by = lambda shift: at >> np.uint32(shift) if encode else np.uint32(0) - (at >> np.uint32(shift))
    call = w >> np.uint32(26) == 0x25
    calls = np.uint32(0x94000000) | (w + by(2)) & np.uint32(0x03FFFFFF)
    # the page is 21 bits in two fields, low ones first; it is signed, and only small ones are moved
    page = w >> np.uint32(29) & np.uint32(3) | (w >> np.uint32(5) & np.uint32(0x7FFFF)) << np.uint32(2)
    small = (page + np.uint32(0x20000)) & np.uint32(0x1FFFFF) < 0x40000
    moved = page + by(12) & np.uint32(0x3FFFF)
    moved |= np.where(moved & np.uint32(0x20000), np.uint32(0x1C0000), np.uint32(0))
    pages = w & np.uint32(0x9000001F) | (moved & np.uint32(3)) << np.uint32(29) | moved >> np.uint32(2) << np.uint32(5)
    address = (w & np.uint32(0x9F000000) == 0x90000000) & small
    return np.where(call, calls, np.where(address, pages, w)).astype("<u4").tobytes() + data[whole:]


#: Places of a RISC-V jump's offset: (bit in the instruction, bit in the offset, how many).
_JAL = ((31, 20, 1), (21, 1, 10), (20, 11, 1), (12, 12, 8))
#: The same for a converted jump: three bytes, the highest bits first.
_JAL_PLAIN = ((12, 17, 4), (16, 9, 8), (24, 1, 8))


def _gathered(word: int, places) -> int:
    return sum((word >> there & (1 << n) - 1) << here for there, here, n in places)


def _scattered(value: int, places) -> int:
    return sum((value >> here & (1 << n) - 1) << there for there, here, n in places)


def _riscv_pair(one: int, two: int, place: int, encode: bool) -> tuple[int, tuple[int, int, str] | None]:
    """What becomes of AUIPC and the instruction behind it: bytes to go on by, and the new pair with the order of the second's bytes.

    A pair that uses one register becomes AUIPC to x2, whose upper bits hold the second instruction's lower
    ones, and the absolute target. What looks like that already, being AUIPC to x0 or x2, is changed into a
    pair that isn't, so that decoding tells them apart.
    """
    register, upper = one >> 7 & 31, one & 0xFFFFF000
    if register not in (0, 2):
        if two & 3 != 3 or two >> 15 & 31 != register:
            return 6, None
        packed = 0x17 | 2 << 7 | two << 12 & 0xFFFFF000
        if not encode:
            return 8, (packed, upper + (two >> 20), "little")
        signed = (two >> 20) - (two >> 31 << 12)
        return 8, (packed, upper + signed + place & 0xFFFFFFFF, "big")
    register, low = one >> 27, one >> 12 & 0xFFFFF
    if one & 0xF80 != 2 << 7 or low & 3 != 3 or register in (0, 2):
        return 4, None
    if encode:
        return 8, (0x17 | register << 7 | two & 0xFFFFF000, low | two << 20 & 0xFFF00000, "little")
    target = int.from_bytes(two.to_bytes(4, "little"), "big") - place
    return 8, (0x17 | register << 7 | target + 0x800 & 0xFFFFF000, low | target << 20 & 0xFFF00000, "little")


def riscv(data: bytes, encode: bool, start: int = 0) -> bytes:
    """JAL to x1 and x5, and AUIPC with the instruction that uses its result, with absolute targets."""
    out, go_on = bytearray(data), 0
    first = np.frombuffer(data, np.uint8)[: max(0, len(data) - 7) : 2]
    for i in (2 * np.flatnonzero((first == 0xEF) | (first & 0x7F == 0x17))).tolist():
        if i < go_on:
            continue
        one = int.from_bytes(out[i : i + 4], "little")
        if one & 0xFF == 0xEF:
            if one & 0xD00:
                continue
            go_on = i + 4
            places = (_JAL, _JAL_PLAIN) if encode else (_JAL_PLAIN, _JAL)
            target = _gathered(one, places[0]) + (start + i if encode else -start - i)
            out[i : i + 4] = (one & 0xFFF | _scattered(target, places[1])).to_bytes(4, "little")
        else:
            n, pair = _riscv_pair(one, int.from_bytes(out[i + 4 : i + 8], "little"), start + i, encode)
            go_on = i + n
            if pair:
                out[i : i + 8] = pair[0].to_bytes(4, "little") + (pair[1] & 0xFFFFFFFF).to_bytes(4, pair[2])
    return bytes(out)


BRANCHES = {"x86": _library(lzma.FILTER_X86), "ppc": _library(lzma.FILTER_POWERPC), "ia64": _library(lzma.FILTER_IA64), "arm": _library(lzma.FILTER_ARM), "thumb": _library(lzma.FILTER_ARMTHUMB), "sparc": _library(lzma.FILTER_SPARC), "arm64": arm64, "riscv": riscv}


def apply(name: str, data: bytes, encode: bool, distance: int = 1) -> bytes:
    if name == "delta":
        if not 1 <= distance <= 256:
            raise ValueError("distance")
        return (delta_encode if encode else delta_decode)(data, distance)
    if name not in BRANCHES:
        raise ValueError(f"no transform named {name}")
    return BRANCHES[name](data, encode)


# --- BCJ2 -----------------------------------------------------------------------------------------


def _model(previous: int, byte: int) -> int | None:
    """Context of a branch byte: its own kind, calls also by the byte before."""
    if byte == 0xE8:
        return 2 + previous
    if byte == 0xE9:
        return 1
    if previous == 0x0F and byte & 0xF0 == 0x80:
        return 0
    return None


def bcj2_merge(main: bytes, calls: bytes, jumps: bytes, coded: bytes, size: int) -> bytes:
    """Put absolute targets of calls and jumps back as relative operands."""
    if len(coded) < 5:
        raise MalformedData("range coder")
    value, span, at = int.from_bytes(coded[1:5], "big"), 0xFFFFFFFF, 5
    probs = [1024] * 258
    out = bytearray()
    m = c = j = 0
    previous = 0
    while len(out) < size:
        if m >= len(main):
            raise MalformedData("main stream")
        b = main[m]
        m += 1
        out.append(b)
        k = _model(previous, b)
        previous = b
        if k is None or len(out) == size:
            continue
        bound = (span >> 11) * probs[k]
        taken = value >= bound
        if taken:
            value, span = value - bound, span - bound
            probs[k] -= probs[k] >> 5
        else:
            span = bound
            probs[k] += 2048 - probs[k] >> 5
        if span < 1 << 24:
            value = (value << 8 | (coded[at] if at < len(coded) else 0)) & 0xFFFFFFFF
            span, at = span << 8 & 0xFFFFFFFF, at + 1
        if taken:
            if b == 0xE8:
                raw, c = calls[c : c + 4], c + 4
            else:
                raw, j = jumps[j : j + 4], j + 4
            if len(raw) < 4:
                raise MalformedData("operand stream")
            out += ((int.from_bytes(raw, "big") - (len(out) + 4)) & 0xFFFFFFFF).to_bytes(4, "little")
            previous = out[-1]
    return bytes(out[:size])


def bcj2_split(data: bytes) -> tuple[bytes, bytes, bytes, bytes]:
    """Streams main, calls, jumps and the coded choices; operands with targets inside the data move out."""
    main, calls, jumps = bytearray(), bytearray(), bytearray()
    probs = [1024] * 258
    low, span, cache, pending, out = 0, 0xFFFFFFFF, 0, 1, bytearray()

    def shift() -> None:
        nonlocal low, cache, pending
        if low < 0xFF000000 or low >> 32:
            carry = low >> 32
            while pending:
                out.append((cache + carry) & 255)
                cache, pending = 255, pending - 1
            cache = low >> 24 & 255
        pending += 1
        low = (low & 0xFFFFFF) << 8

    previous, i = 0, 0
    while i < len(data):
        b = data[i]
        main.append(b)
        i += 1
        k = _model(previous, b)
        previous = b
        if k is None or i == len(data):
            continue
        target = (int.from_bytes(data[i : i + 4], "little") + i + 4) & 0xFFFFFFFF
        taken = i + 4 <= len(data) and target < len(data)
        bound = (span >> 11) * probs[k]
        if taken:
            low, span = low + bound, span - bound
            probs[k] -= probs[k] >> 5
        else:
            span = bound
            probs[k] += 2048 - probs[k] >> 5
        if span < 1 << 24:
            span = span << 8 & 0xFFFFFFFF
            shift()
        if taken:
            (calls if b == 0xE8 else jumps).extend(target.to_bytes(4, "big"))
            previous = data[i + 3]
            i += 4
    for _ in range(5):
        shift()
    return bytes(main), bytes(calls), bytes(jumps), bytes(out)
