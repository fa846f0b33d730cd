"""Format detection from prefix bytes, as one native expression and as a function on bytes.

Of all formats that match, the one that looks at most bytes wins; ties go to catalog order. Archives
are tried before codecs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..formats import tar

PREFIX = 1024
#: Signatures in hexadecimal, in catalog order, archives by the bytes they look at.
SEVENZ, AR, RAR4, RAR5 = "377ABCAF271C", "213C617263683E0A", "526172211A0700", "526172211A070100"
ZIP = ("504B0304", "504B0506", "504B0708", "504B3030504B")
CPIO_ASCII = ("303730373031", "303730373032", "303730373037")
XZ, BZIP2, LZIP, GZIP, COMPRESS = "FD377A585A00", "425A68", "4C5A4950", "1F8B", "1F9D"
LZ4, ZSTD = ("04224D18", "02214C18"), "28B52FFD"


def _is_tar(block: Column) -> Column:
    """A header whose sum fits, of unsigned or signed bytes, or two zero blocks."""
    raw = F.substring(block, 1, 512)
    # two hexadecimal digits a byte; the checksum field counts as spaces
    digits = F.hex(F.concat(F.substring(raw, 1, 148), F.lit(b" " * 8), F.substring(raw, 157, 356)))
    values = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    unsigned = F.aggregate(values, F.lit(0), lambda a, x: a + x)
    signed = F.aggregate(values, F.lit(0), lambda a, x: a + F.when(x > 127, x - 256).otherwise(x))
    field = F.trim(F.regexp_replace(F.decode(F.substring(raw, 149, 8), "ISO-8859-1"), "\\x00", " "))
    stored = F.when(field.rlike("^[0-7]+$"), F.conv(field, 8, 10).cast("int"))
    zeros = F.hex(F.substring(block, 1, 1024)) == F.lit("00" * 1024)
    return (F.octet_length(block) >= 512) & (F.coalesce((stored == unsigned) | (stored == signed), F.lit(False)) | zeros)


def detected(content: Column) -> Column:
    """Name of the format of a binary column, or null."""
    head = F.substring(content, 1, PREFIX)
    h = F.hex(F.substring(content, 1, 26))
    starts = lambda *s: F.lit(False) if not s else _any([h.startswith(x) for x in s])
    name_size = lambda lo, hi: F.conv(F.concat(F.substring(h, hi * 2 + 1, 2), F.substring(h, lo * 2 + 1, 2)), 16, 10).cast("int")
    n = F.octet_length(content)
    cpio = starts(*CPIO_ASCII) | (starts("C771") & ((n < 26) | (name_size(20, 21) >= 2))) | (starts("71C7") & ((n < 26) | (name_size(21, 20) >= 2)))
    first = F.conv(F.substring(h, 1, 4), 16, 10).cast("int")
    zlib = (n >= 2) & (F.substring(h, 2, 1) == "8") & (F.substring(h, 1, 1) <= "7") & (first % 31 == 0)
    bzip2 = h.rlike("^" + BZIP2 + "3[1-9]")
    skippable = h.rlike("^5[0-9A-F]2A4D18")
    archive = F.when(_is_tar(head), "tar").when(cpio, "cpio").when(starts(AR), "ar").when(starts(RAR4, RAR5), "rar").when(starts(SEVENZ), "7z").when(starts(*ZIP), "zip")
    codec = F.when(starts(XZ), "xz").when(bzip2, "bzip2").when(starts(*LZ4) | skippable, "lz4").when(starts(LZIP), "lzip").when(starts(ZSTD), "zstd").when(starts(COMPRESS), "compress").when(starts(GZIP), "gzip").when(zlib, "zlib")
    return F.coalesce(archive, codec)


def _any(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def detect_archive(head: bytes) -> str | None:
    """The same on bytes, archives only."""
    h = head[:26].hex().upper()
    if len(head) >= 512 and (head[:512].strip(b"\0") and tar.checksum_fits(head[:512]) or len(head) >= 1024 and not head[:1024].strip(b"\0")):
        return "tar"
    if h.startswith(CPIO_ASCII) or h.startswith("C771") and (len(head) < 26 or int.from_bytes(head[20:22], "little") >= 2) or h.startswith("71C7") and (len(head) < 26 or int.from_bytes(head[20:22], "big") >= 2):
        return "cpio"
    return next((k for k, s in (("ar", (AR,)), ("rar", (RAR4, RAR5)), ("7z", (SEVENZ,)), ("zip", ZIP)) if h.startswith(s)), None)


def detect_codec(head: bytes) -> str | None:
    """The same on bytes, codecs only."""
    h = head[:8].hex().upper()
    if h.startswith(XZ):
        return "xz"
    if h.startswith(BZIP2) and head[3:4] in [b"%d" % i for i in range(1, 10)]:
        return "bzip2"
    if h.startswith(LZ4) or (len(head) >= 4 and int.from_bytes(head[:4], "little") & 0xFFFFFFF0 == 0x184D2A50):
        return "lz4"
    for name, s in (("lzip", LZIP), ("zstd", ZSTD), ("compress", COMPRESS), ("gzip", GZIP)):
        if h.startswith(s):
            return name
    if len(head) >= 2 and head[0] & 15 == 8 and head[0] >> 4 <= 7 and (head[0] << 8 | head[1]) % 31 == 0:
        return "zlib"
    return None
