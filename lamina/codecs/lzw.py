"""Unix compress: LZW with codes that grow from 9 bits to a maximum of 9 to 16."""

from __future__ import annotations

from ..errors import LimitExceeded, MalformedData

CLEAR, FIRST = 256, 257


def encode(data: bytes, max_bits: int = 16, block_mode: bool = True) -> bytes:
    """Codes leave in groups of eight; a group is filled up when the width changes."""
    out = bytearray([0x1F, 0x9D, max_bits | (0x80 if block_mode else 0)])
    if not data:
        return bytes(out)
    table = {bytes([i]): i for i in range(256)}
    free, width = (FIRST if block_mode else 256), 9
    acc = bits = in_group = 0

    def put(code: int) -> None:
        nonlocal acc, bits, in_group
        acc |= code << bits
        bits += width
        in_group = (in_group + 1) % 8
        while bits >= 8:
            out.append(acc & 255)
            acc >>= 8
            bits -= 8

    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        if free < 1 << max_bits:
            # the decoder adds an entry one code later, and widens when its table is full
            if free >= 1 << width:
                while in_group:
                    put(0)
                width += 1
            table[longer] = free
            free += 1
        word = data[i : i + 1]
    put(table[word])
    if bits:
        out.append(acc & 255)
    return bytes(out)


def decode(data: bytes, max_output: int) -> tuple[bytes, int]:
    if len(data) < 3 or data[:2] != b"\x1f\x9d":
        raise MalformedData("not a .Z stream")
    max_bits, block_mode = data[2] & 0x1F, bool(data[2] & 0x80)
    if data[2] & 0x60 or not 9 <= max_bits <= 16:
        raise MalformedData("reserved flags or code width")
    table: list[bytes] = [bytes([i]) for i in range(256)] + ([b""] if block_mode else [])
    out: list[bytes] = []
    total, width, at, in_group = 0, 9, 24, 0
    end = len(data) * 8
    whole = int.from_bytes
    previous: bytes | None = None
    while at + width <= end:
        byte = at >> 3
        code = (whole(data[byte : byte + 4], "little") >> (at & 7)) & ((1 << width) - 1)
        at += width
        in_group = (in_group + 1) % 8
        if block_mode and code == CLEAR:
            del table[FIRST:]
            at += (-in_group % 8) * width
            width, in_group, previous = 9, 0, None
            continue
        if previous is None:
            if code > 255:
                raise MalformedData("the first code must be a byte")
            word = table[code]
        else:
            if code < len(table):
                word = table[code]
            elif code == len(table) and len(table) < 1 << max_bits:
                word = previous + previous[:1]
            else:
                raise MalformedData("code beyond the table")
            if len(table) < 1 << max_bits:
                table.append(previous + word[:1])
        total += len(word)
        if total > max_output:
            raise LimitExceeded("output", max_output, total)
        out.append(word)
        previous = word
        if len(table) >= 1 << width and width < max_bits:
            at += (-in_group % 8) * width
            width, in_group = width + 1, 0
    return b"".join(out), len(data)
