"""Codecs on the C libraries of the standard library and zstandard."""

from __future__ import annotations

import bisect
import bz2
import io
import lzma
import struct
import zlib

from ..errors import LimitExceeded, MalformedData, Unsupported


def _bounded(size: int, maximum: int) -> None:
    if size > maximum:
        raise LimitExceeded("output", maximum, size)


#: Bytes that a decoder is given at once: what it doesn't use comes back as a copy, so it stays small.
FEED = 1 << 16


def _inflate(data: bytes, wbits: int, max_output: int, zdict: bytes | None = None) -> tuple[bytes, int]:
    """One deflate stream with the wrapper that wbits names, and the bytes it took."""
    d = zlib.decompressobj(wbits, zdict=zdict) if zdict else zlib.decompressobj(wbits)
    out, total, at = [], 0, 0
    try:
        while not d.eof and at < len(data):
            out.append(d.decompress(data[at : at + FEED], max_output + 1 - total))
            total += len(out[-1])
            at += FEED
            # input is left waiting only where the limit was passed
            _bounded(total, max_output)
    except zlib.error as e:
        raise MalformedData(str(e)) from None
    if not d.eof:
        raise MalformedData("truncated stream")
    return b"".join(out), min(at, len(data)) - len(d.unused_data)


def _streamed(d, data: bytes, max_output: int) -> tuple[bytes, int]:
    """The same for decoders that say when they need input."""
    out, total, at = [], 0, 0
    while not d.eof:
        piece = b""
        if d.needs_input:
            piece, at = data[at : at + FEED], at + FEED
            if not piece:
                raise MalformedData("truncated stream")
        out.append(d.decompress(piece, max_output + 1 - total))
        total += len(out[-1])
        _bounded(total, max_output)
    return b"".join(out), min(at, len(data)) - len(d.unused_data)


def _deflate(data: bytes, wbits: int, level: int, zdict: bytes | None = None, strategy: int = zlib.Z_DEFAULT_STRATEGY) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, wbits, 9, strategy, zdict) if zdict else zlib.compressobj(level, zlib.DEFLATED, wbits, 9, strategy)
    return c.compress(data) + c.flush()


def deflate_encode(data, level=6, dictionary=None):
    return _deflate(data, -15, level, dictionary)


def deflate_decode(data, max_output, dictionary=None):
    return _inflate(data, -15, max_output, dictionary)


def zlib_encode(data, level=6, dictionary=None):
    return _deflate(data, 15, level, dictionary)


def zlib_decode(data, max_output, dictionary=None):
    if len(data) >= 6 and data[1] & 0x20 and dictionary is None:
        raise Unsupported(f"dictionary {int.from_bytes(data[2:6], 'big'):08x} is needed")
    return _inflate(data, 15, max_output, dictionary)


def gzip_encode(data, level=6):
    return _deflate(data, 31, level)


def _frames(one, data: bytes, max_output: int, single: bool, padding=None) -> tuple[bytes, int]:
    """Frames up to the end of the data, or the first."""
    out, at = [], 0
    total = 0
    data = memoryview(data)
    while at < len(data) or not out:
        part, n = one(data[at:], max_output - total)
        out.append(part)
        total += len(part)
        at += n
        if single:
            break
        if padding:
            at = padding(data, at)
    return b"".join(out), at


def gzip_decode(data, max_output, single=False):
    return _frames(lambda d, m: _inflate(d, 31, m), data, max_output, single)


def bzip2_encode(data, level=9):
    return bz2.compress(data, level)


def _bzip2_one(data, max_output):
    try:
        return _streamed(bz2.BZ2Decompressor(), data, max_output)
    except (OSError, ValueError) as e:
        if isinstance(e, (LimitExceeded, MalformedData)):
            raise
        raise MalformedData(str(e)) from None


def bzip2_decode(data, max_output, single=False):
    return _frames(_bzip2_one, data, max_output, single)


def _unlzma(data: bytes, max_output: int, **how) -> tuple[bytes, int]:
    try:
        return _streamed(lzma.LZMADecompressor(**how), data, max_output)
    except (lzma.LZMAError, EOFError, ValueError) as e:
        if isinstance(e, (LimitExceeded, MalformedData)):
            raise
        raise MalformedData(str(e)) from None


def _memory(max_memory):
    return {} if max_memory is None else {"memlimit": max_memory}


def xz_encode(data, level=6, check="crc64", filters=None):
    kinds = {"none": lzma.CHECK_NONE, "crc32": lzma.CHECK_CRC32, "crc64": lzma.CHECK_CRC64, "sha256": lzma.CHECK_SHA256}
    if filters is None and len(data) < 1 << 18:
        # tables are set up for the dictionary, which needn't be larger than the data
        filters = [{"id": lzma.FILTER_LZMA2, "preset": level, "dict_size": _dictionary(data)}]
    return lzma.compress(data, lzma.FORMAT_XZ, kinds[check], None if filters else level, filters)


def _dictionary(data: bytes, most: int = 1 << 26) -> int:
    """The smallest power of two that holds the data, from 4096 to `most`."""
    return min(most, 1 << max(12, (len(data) - 1).bit_length()))


def _xz_padding(data: bytes, at: int) -> int:
    end = at
    while end < len(data) and not data[end]:
        end += 1
    if (end - at) % 4:
        raise MalformedData("stream padding isn't a multiple of four")
    return end


def xz_decode(data, max_output, single=False, max_memory=None):
    return _frames(lambda d, m: _unlzma(d, m, format=lzma.FORMAT_XZ, **_memory(max_memory)), data, max_output, single, _xz_padding)


def lzma_filter(dict_size=1 << 20, lc=3, lp=0, pb=2):
    return {"id": lzma.FILTER_LZMA1, "dict_size": max(4096, dict_size), "lc": lc, "lp": lp, "pb": pb}


def lzma_encode(data, dict_size=1 << 20, lc=3, lp=0, pb=2):
    return lzma.compress(data, lzma.FORMAT_ALONE, filters=[lzma_filter(_dictionary(data, dict_size), lc, lp, pb)])


def lzma_decode(data, max_output, max_memory=None):
    return _unlzma(data, max_output, format=lzma.FORMAT_ALONE, **_memory(max_memory))


def lzma_raw_encode(data, dict_size=1 << 20, lc=3, lp=0, pb=2):
    return lzma.compress(data, lzma.FORMAT_RAW, filters=[lzma_filter(_dictionary(data, dict_size), lc, lp, pb)])


def lzma_raw_decode(data, max_output, dict_size=1 << 20, lc=3, lp=0, pb=2, decoded_size=None):
    """With an end marker, or of a known size."""
    if decoded_size is None:
        return _unlzma(data, max_output, format=lzma.FORMAT_RAW, filters=[lzma_filter(dict_size, lc, lp, pb)])
    _bounded(decoded_size, max_output)
    # as a file with header: the size stands there, and a marker may follow
    head = struct.pack("<BIQ", (pb * 5 + lp) * 9 + lc, max(4096, dict_size), decoded_size)
    out, n = _unlzma(head + data, decoded_size, format=lzma.FORMAT_ALONE)
    if len(out) != decoded_size:
        raise MalformedData("decoded size differs")
    return out, n - len(head)


def lzma2_encode(data, dict_size=1 << 20):
    return lzma.compress(data, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": _dictionary(data, max(4096, dict_size))}])


def lzma2_decode(data, max_output, dict_size=1 << 26):
    return _unlzma(data, max_output, format=lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": max(4096, dict_size)}])


def lzip_encode(data, dict_size=1 << 23):
    dict_size = _dictionary(data, dict_size)
    body = lzma.compress(data, lzma.FORMAT_RAW, filters=[lzma_filter(dict_size)])
    head = b"LZIP\x01" + bytes([max(12, dict_size.bit_length() - 1)])
    return head + body + struct.pack("<IQQ", zlib.crc32(data), len(data), len(head) + len(body) + 20)


def _lzip_one(data, max_output):
    if len(data) < 6 or data[:4] != b"LZIP" or data[4] != 1:
        raise MalformedData("not an lzip member")
    code = data[5]
    size = 1 << (code & 31)
    size -= (size >> 4) * (code >> 5)
    if not 4096 <= size <= 1 << 29:
        raise MalformedData("dictionary size out of range")
    out, n = _unlzma(data[6:], max_output, format=lzma.FORMAT_RAW, filters=[lzma_filter(size)])
    end = 6 + n
    if len(data) < end + 20:
        raise MalformedData("truncated trailer")
    if struct.unpack_from("<IQQ", data, end) != (zlib.crc32(out), len(out), end + 20):
        raise MalformedData("trailer doesn't fit the data")
    return out, end + 20


def lzip_decode(data, max_output, single=False):
    return _frames(_lzip_one, data, max_output, single)


# --- zstandard ------------------------------------------------------------------------------------

SKIPPABLE, ZSTD_MAGIC = 0x184D2A50, 0xFD2FB528
#: Fixed values of the seekable format.
SEEK_TABLE_MAGIC, SEEK_FRAME_MAGIC = 0x8F92EAB1, 0x184D2A5E


def zstd_encode(data, level=3, dictionary=None, checksum=False, frame_size=None, magicless=False, **advanced):
    """One frame; or frames of frame_size bytes with a seek table. magicless leaves the first four bytes out;
    advanced are compression parameters by the library's names, such as window_log or strategy."""
    import zstandard as z

    given = z.ZstdCompressionDict(dictionary) if dictionary else None
    if magicless or advanced:
        form = z.FORMAT_ZSTD1_MAGICLESS if magicless else z.FORMAT_ZSTD1
        c = z.ZstdCompressor(compression_params=z.ZstdCompressionParameters.from_level(level, format=form, write_checksum=checksum, **advanced), dict_data=given)
    else:
        c = z.ZstdCompressor(level=level, write_checksum=checksum, dict_data=given)
    if frame_size is None:
        return c.compress(data)
    parts, table = [], []
    for i in range(0, len(data), frame_size) or [0]:
        raw = data[i : i + frame_size]
        part = c.compress(raw)
        parts.append(part)
        table.append(struct.pack("<II", len(part), len(raw)))
    body = b"".join(table) + struct.pack("<IBI", len(table), 0, SEEK_TABLE_MAGIC)
    return b"".join(parts) + struct.pack("<II", SEEK_FRAME_MAGIC, len(body)) + body


def _zstd_one(data, max_output, dictionary, max_window):
    import zstandard as z

    if len(data) < 4:
        raise MalformedData("truncated frame")
    magic = int.from_bytes(data[:4], "little")
    if magic & 0xFFFFFFF0 == SKIPPABLE:
        if len(data) < 8 or len(data) < (end := 8 + int.from_bytes(data[4:8], "little")):
            raise MalformedData("truncated skippable frame")
        return b"", end
    if magic != ZSTD_MAGIC:
        raise MalformedData("not a zstd frame")
    try:
        if max_window is not None and (w := z.get_frame_parameters(bytes(data[:32])).window_size) > max_window:
            raise LimitExceeded("window", max_window, w)
        d = z.ZstdDecompressor(dict_data=z.ZstdCompressionDict(dictionary) if dictionary else None, max_window_size=max_window or 0).decompressobj()
        size = z.frame_content_size(bytes(data[:32]))
        if size > max_output:
            raise LimitExceeded("output", max_output, size)
        out = []
        total = at = 0
        while not d.eof and at < len(data):
            part = d.decompress(data[at : at + (1 << 16)])
            at += 1 << 16
            total += len(part)
            _bounded(total, max_output)
            out.append(part)
    except z.ZstdError as e:
        raise MalformedData(str(e)) from None
    if not d.eof:
        raise MalformedData("truncated frame")
    return b"".join(out), min(at, len(data)) - len(d.unused_data)


def zstd_decode(data, max_output, single=False, dictionary=None, max_window=None, magicless=False):
    if magicless:  # one frame: without the mark the next one can't be told
        out, n = _zstd_one(ZSTD_MAGIC.to_bytes(4, "little") + bytes(data), max_output, dictionary, max_window)
        return out, n - 4
    return _frames(lambda d, m: _zstd_one(d, m, dictionary, max_window), data, max_output, single)


def zstd_frames(data: bytes) -> list[tuple[int, int, bool, int | None]]:
    """(offset, size, skippable, decoded size if stated) of each frame."""
    import zstandard as z

    out, at = [], 0
    data = memoryview(data)
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        _, n = _zstd_one(data[at:], 1 << 40, None, None)
        stated = None if magic & 0xFFFFFFF0 == SKIPPABLE else z.frame_content_size(bytes(data[at : at + 32]))
        out.append((at, n, magic & 0xFFFFFFF0 == SKIPPABLE, stated if stated is not None and stated >= 0 else None))
        at += n
    return out


def zstd_seek_table(data: bytes, before: int = 0) -> list[tuple[int, int, int, int]] | None:
    """(offset, size, decoded offset, decoded size) of each frame from the seek table; None without one.

    `before` bytes of the file may be missing in front of the data."""
    if len(data) < 17 or int.from_bytes(data[-4:], "little") != SEEK_TABLE_MAGIC:
        return None
    count, flags = struct.unpack("<IB", data[-9:-4])
    if flags & 0x7C or count > 1 << 27:
        raise MalformedData("seek table descriptor")
    each = 12 if flags & 0x80 else 8
    size = count * each + 9
    start = len(data) - size - 8
    if start < 0 or struct.unpack_from("<II", data, start) != (SEEK_FRAME_MAGIC, size):
        raise MalformedData("seek table frame")
    out, at, decoded = [], 0, 0
    for i in range(count):
        c, d = struct.unpack_from("<II", data, start + 8 + i * each)
        if d > 1 << 30:
            raise MalformedData("frame too large")
        out.append((at, c, decoded, d))
        at, decoded = at + c, decoded + d
    if at != start + before:
        raise MalformedData("seek table doesn't cover the frames")
    return out


def zstd_read_range(data: bytes, offset: int, size: int, max_output: int = 1 << 30) -> bytes:
    """Decoded bytes from the frames that hold them."""
    table = zstd_seek_table(data)
    if table is None:
        raise Unsupported("no seek table")
    _bounded(size, max_output)
    out, first = [], None
    for at, n, decoded, d in table:
        if decoded + d > offset and decoded < offset + size:
            first = decoded if first is None else first
            out.append(_zstd_one(data[at : at + n], d, None, None)[0])
    return b"".join(out)[offset - first :][:size] if out else b""


class SeekableZstd(io.RawIOBase):
    """The decoded bytes of frames with a seek table as a file: a frame is decoded when it is asked for, a few are kept."""

    KEPT = 4

    def __init__(self, f, table: list[tuple[int, int, int, int]]):
        self.f, self.table, self.at = f, table, 0
        self.starts_at = [t[2] for t in table]
        self.total = table[-1][2] + table[-1][3] if table else 0
        self.held: dict[int, bytes] = {}

    def readable(self):
        return True

    def seekable(self):
        return True

    def seek(self, offset, whence=0):
        self.at = max(0, offset + (0, self.at, self.total)[whence])
        return self.at

    def tell(self):
        return self.at

    def _frame(self, i: int) -> bytes:
        if i not in self.held:
            if len(self.held) >= self.KEPT:
                del self.held[next(iter(self.held))]
            offset, size, _, decoded = self.table[i]
            self.f.seek(offset)
            raw = self.f.read(size)
            self.held[i] = _zstd_one(raw, decoded, None, None)[0]
            if len(self.held[i]) != decoded:
                raise MalformedData("frame size")
        return self.held[i]

    def readinto(self, buffer):
        if self.at >= self.total:
            return 0
        i = bisect.bisect_right(self.starts_at, self.at) - 1
        while self.table[i][3] == 0:
            i += 1
        part = self._frame(i)[self.at - self.table[i][2] :][: len(buffer)]
        buffer[: len(part)] = part
        self.at += len(part)
        return len(part)


def seekable_zstd(f) -> io.BufferedReader | None:
    """A seekable file over another one that ends with a seek table, or None."""
    f.seek(0, 2)
    end = f.tell()
    if end < 17:
        return None
    f.seek(end - 9)
    tail = f.read(9)
    if int.from_bytes(tail[5:], "little") != SEEK_TABLE_MAGIC:
        return None
    size = min(end, int.from_bytes(tail[:4], "little") * (12 if tail[4] & 0x80 else 8) + 17)
    f.seek(end - size)
    table = zstd_seek_table(f.read(size), end - size)
    out = io.BufferedReader(SeekableZstd(f, table), 1 << 16)
    out.total = out.raw.total
    return out


def zstd_frame_info(data: bytes) -> list[dict]:
    """Of each frame: offset, size, skippable, decoded size if stated, window, dictionary id (0: none), checksum."""
    import zstandard as z

    out = []
    for at, n, skip, stated in zstd_frames(data):
        p = None if skip else z.get_frame_parameters(bytes(data[at : at + 32]))
        out.append({"offset": at, "size": n, "skippable": skip, "decoded_size": stated, "window": p and p.window_size, "dictionary_id": p and p.dict_id, "checksum": p and bool(p.has_checksum)})
    return out


def zstd_train(samples: list[bytes], size: int = 16_384) -> bytes:
    import zstandard as z

    try:
        return z.train_dictionary(size, samples).as_bytes()
    except z.ZstdError as e:
        raise Unsupported(f"training: {e}") from None
