"""PPMd in a JVM beside the process: Ppmd.java, compiled by the Janino that Spark brings along.

One JVM serves one process, call by call through its pipes, and ends with it. It is started once the process
has coded START bytes by itself. Without Java or Spark's jars, for models of more than MEMORY bytes and where the
JVM fails, functions give None, and the caller does the work.
"""

from __future__ import annotations

import atexit
import contextlib
import glob
import importlib.resources
import os
import shutil
import struct
import subprocess
import threading
import warnings
from collections.abc import Iterator

START = 1 << 15
MEMORY = 1 << 26
#: What any pipe takes at once, with the head before it.
DIRECT = 4000
HEAD = struct.Struct(">ciiqq")


def _java() -> str | None:
    """The Java of the environment, or the one that runs a process above, as executors do."""
    home = os.environ.get("JAVA_HOME")
    if home and os.access(found := os.path.join(home, "bin", "java"), os.X_OK):
        return found
    if found := shutil.which("java"):
        return found
    pid = os.getppid()
    with contextlib.suppress(OSError, ValueError):
        while pid > 1:
            if os.path.basename(found := os.readlink(f"/proc/{pid}/exe")) == "java":
                return found
            with open(f"/proc/{pid}/stat") as f:
                pid = int(f.read().rpartition(")")[2].split()[1])
    return None


def _jars() -> list[str] | None:
    """Janino and its interfaces among Spark's jars; pyspark itself may be in an archive below them."""
    import pyspark

    at, places = os.path.dirname(os.path.abspath(pyspark.__file__)), []
    if home := os.environ.get("SPARK_HOME"):
        places.append(home)
    while at != os.path.dirname(at):
        places.append(at)
        at = os.path.dirname(at)
    for place in places:
        found = [glob.glob(os.path.join(place, "jars", f"{name}-[0-9]*.jar")) for name in ("janino", "commons-compiler")]
        if all(found):
            return [f[0] for f in found]
    return None


class Coder:
    def __init__(self, memory: int):
        java, jars = _java(), _jars()
        if java is None or jars is None:
            raise FileNotFoundError("Java or Janino")
        self.memory, self.pid = memory, os.getpid()
        self.files = contextlib.ExitStack()
        source = self.files.enter_context(importlib.resources.as_file(importlib.resources.files(__package__) / "Ppmd.java"))
        heap = memory * 5 // 2 + (32 << 20)
        options = ["-XX:+UseSerialGC", "-XX:-UsePerfData", "-XX:ActiveProcessorCount=1", f"-Xmx{heap}"]
        self.process = subprocess.Popen([java, *options, "-cp", os.pathsep.join(jars), "org.codehaus.janino.SimpleCompiler", str(source), "Ppmd"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)

    def close(self) -> None:
        self.process.kill()
        self.process.wait()
        self.process.stdin.raw.close()
        self.process.stdout.close()
        self.files.close()

    def _send(self, *parts: bytes) -> None:
        # a JVM that is gone shows where its answer is read
        with contextlib.suppress(OSError, ValueError):
            for p in parts:
                self.process.stdin.write(p)
            self.process.stdin.flush()

    def _take(self, n: int) -> bytes:
        got = self.process.stdout.read(n)
        if len(got) < n:
            raise EOFError("the JVM ended")
        return got

    def _pieces(self) -> Iterator[bytes]:
        while (n := struct.unpack(">i", self._take(4))[0]) > 0:
            yield self._take(n)
        self.said = n

    def call(self, what: bytes, data: bytes, wanted: int, order: int, memory: int) -> bytes:
        head = HEAD.pack(what, order, memory, len(data), wanted)
        if len(data) <= DIRECT:
            self._send(head + data)
            return b"".join(self._pieces())
        # results come while data is still sent
        sender = threading.Thread(target=self._send, args=(head, data), daemon=True)
        sender.start()
        out = b"".join(self._pieces())
        sender.join()
        return out


_lock = threading.Lock()
_coder: Coder | None = None
_coded, _usable = 0, True


def _call(f, size: int, memory: int):
    """f of the coder, or None where there is none."""
    global _coder, _coded, _usable
    with _lock:
        if not _usable or memory > MEMORY:
            return None
        if _coder is not None and _coder.pid != os.getpid():
            _coder = None  # the one of the process that this one was forked from
        if _coder is None and _coded < START:
            _coded += size
            if _coded < START:
                return None
        try:
            if _coder is not None and _coder.memory < memory:
                _coder.close()
                _coder = None
            if _coder is None:
                _coder = Coder(max(memory, 1 << 24))
            return f(_coder)
        except (OSError, EOFError) as e:
            _usable = False
            if _coder is not None:
                _coder.close()
                _coder = None
            warnings.warn(f"PPMd without a JVM, some 200 times slower: {e}", stacklevel=2)
            return None


@atexit.register
def _end() -> None:
    if _coder is not None and _coder.pid == os.getpid():
        _coder.close()


def ppmd_encode(data: bytes, order: int, memory: int) -> bytes | None:
    return _call(lambda c: c.call(b"e", data, 0, order, memory), len(data), memory)


def ppmd_decode(data: bytes, size: int, order: int, memory: int) -> tuple[bytes, int, int] | None:
    """(output, 0 or what is wrong, bytes taken) of data that begins with a zero."""

    def one(c: Coder):
        out = c.call(b"d", data, size, order, memory)
        return out, c.said, struct.unpack(">q", c._take(8))[0]

    return _call(one, size, memory)
