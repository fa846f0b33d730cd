"""Split archives: which files belong together, and one file view over them."""

from __future__ import annotations

import io
import os
import re


def _key(path: str) -> tuple[str, str, int] | None:
    """(kind, common name, number from 0) of a volume's name."""
    if m := re.fullmatch(r"(.*)\.part(\d+)\.rar", path, re.I):
        return "rar-part", m[1], int(m[2]) - 1
    if m := re.fullmatch(r"(.*)\.(\d{3,})", path):
        return "7z", m[1], int(m[2]) - 1
    if m := re.fullmatch(r"(.*)\.z(\d{2,})", path, re.I):
        return "zip", m[1], int(m[2]) - 1
    if m := re.fullmatch(r"(.*)\.r(\d{2})", path, re.I):
        return "rar-old", m[1], int(m[2]) + 1
    return None


def grouped(paths: list[str]) -> list[list[str]]:
    """Volumes in order, every other file by itself. A set needs its numbers without gaps and two files."""
    sets: dict[tuple[str, str], dict[int, str]] = {}
    for p in paths:
        if k := _key(p):
            sets.setdefault(k[:2], {})[k[2]] = p
    taken, out = set(), []
    for (kind, base), found in sets.items():
        if kind == "zip" and (last := next((p for p in paths if p.lower() == f"{base}.zip".lower()), None)):
            found[len(found)] = last
        if kind == "rar-old" and (head := next((p for p in paths if p.lower() == f"{base}.rar".lower()), None)):
            found[0] = head
        if len(found) >= 2 and sorted(found) == list(range(len(found))):
            out.append([found[i] for i in sorted(found)])
            taken.update(found.values())
    out += [[p] for p in paths if p not in taken]
    return sorted(out)


class Joined(io.RawIOBase):
    """Files as one, read only and seekable."""

    def __init__(self, paths: list[str]):
        self.files = [open(p, "rb") for p in paths]  # noqa: SIM115
        self.sizes = [os.path.getsize(p) for p in paths]
        self.starts = [sum(self.sizes[:i]) for i in range(len(paths))]
        self.at, self.total = 0, sum(self.sizes)

    def readable(self):
        return True

    def seekable(self):
        return True

    def seek(self, offset, whence=0):
        self.at = offset + (0, self.at, self.total)[whence]
        return self.at

    def tell(self):
        return self.at

    def readinto(self, buffer):
        for f, start, size in zip(self.files, self.starts, self.sizes):
            if start <= self.at < start + size:
                f.seek(self.at - start)
                n = f.readinto(memoryview(buffer)[: start + size - self.at])
                self.at += n
                return n
        return 0

    def close(self):
        for f in self.files:
            f.close()
        super().close()


def opened(paths: list[str]):
    return open(paths[0], "rb") if len(paths) == 1 else io.BufferedReader(Joined(paths))


def split(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)] or [b""]


class JoinedParts(io.BytesIO):
    """The same over values."""

    def __init__(self, parts: list[bytes]):
        super().__init__(b"".join(parts))
        self.starts = [sum(map(len, parts[:i])) for i in range(len(parts))]


#: The mark before a ZIP archive in volumes, and that of one that would have had some.
SPANNED, SINGLE = b"PK\x07\x08", b"PK00"


class Target:
    """Deals what is written out to volumes of a size. Records asked to stay whole open the next volume."""

    def __init__(self, size: int, lead: bytes = b""):
        if size < 1024:
            raise ValueError("volumes have 1024 bytes at least")
        self.size, self.parts = size, [bytearray(lead)]

    def write(self, data: bytes) -> int:
        at = 0
        while at < len(data):
            if len(self.parts[-1]) >= self.size:
                self.parts.append(bytearray())
            n = self.size - len(self.parts[-1])
            self.parts[-1] += data[at : at + n]
            at += n
        return len(data)

    def whole(self, n: int) -> None:
        if n > self.size:
            raise ValueError("a record is larger than a volume")
        if len(self.parts[-1]) + n > self.size:
            self.parts.append(bytearray())

    def place(self) -> tuple[int, int]:
        return len(self.parts) - 1, len(self.parts[-1])


def names(base: str, fmt: str, count: int) -> list[str]:
    """Names of an archive's volumes: .z01 up to the last, which is .zip, or .001 and so on."""
    if count == 1:
        return [base]
    if fmt == "zip":
        stem = base[:-4] if base.lower().endswith(".zip") else base
        return [*(f"{stem}.z{i:02d}" for i in range(1, count)), f"{stem}.zip"]
    return [f"{base}.{i:03d}" for i in range(1, count + 1)]


def written(write, fmt: str, size: int) -> list[bytes]:
    """Volumes of an archive: write(out) makes it. ZIP numbers its disks, other formats are cut anywhere."""
    if fmt != "zip":
        out = io.BytesIO()
        write(out)
        return split(out.getvalue(), size)
    target = Target(size, SPANNED)
    write(target)
    if len(target.parts) == 1:
        target.parts[0][: len(SINGLE)] = SINGLE
    return [bytes(p) for p in target.parts]
