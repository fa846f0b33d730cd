"""PPMd variant H: a context model that is shared by encoder and decoder, with exchangeable range coders.

The model is a tree of contexts as objects; the text that unfinished branches point into is one byte array.
What the format prescribes about memory, when it runs out and the model starts anew, is followed by an
arena that only keeps addresses and free blocks, not the data itself.

encode and decode have a JVM do the same where there is one (jvm.py), with equal results.
"""

from __future__ import annotations

from ..errors import LimitExceeded, MalformedData
from . import jvm

ORDER, MEMORY = 6, 1 << 24
UNIT = 12
MAX_FREQUENCY, BINARY, PERIOD = 124, 1 << 14, 7
#: First escape estimates of binary contexts, and what follows from a binary escape.
FIRST_ESCAPES = (0x3CDD, 0x1F3F, 0x59BF, 0x48F3, 0x64A1, 0x5ABC, 0x6632, 0x6051)
ESCAPE_BY_ESTIMATE = (25, 14, 9, 7, 5, 5, 4, 4, 4, 3, 3, 3, 2, 2, 2, 2)

#: Block sizes in units: four each in steps of 1, 2 and 3, then in steps of 4 up to 128.
SIZES = [*range(1, 5), *range(6, 13, 2), *range(15, 25, 3), *range(28, 129, 4)]
#: Index of the smallest block that holds so many units.
FITTING = [next(i for i, s in enumerate(SIZES) if s >= n) for n in range(129)]


def _escape_classes() -> list[int]:
    """Class of a number of symbols for estimates of escapes: classes become wider one by one."""
    out, name, left = [0, 1, 2], 3, 1
    while len(out) < 256:
        out.append(name)
        left -= 1
        if not left:
            name += 1
            left = name - 2
    return out


ESCAPE_CLASS = _escape_classes()


class Arena:
    """Addresses of blocks in a memory of some bytes: text from below, contexts from above, symbol tables between."""

    def __init__(self, size: int):
        self.size = size
        self.reset()

    def reset(self) -> None:
        self.free: list[list[int]] = [[] for _ in SIZES]
        self.high = self.size
        self.low = self.start = self.size - self.size // 8 // UNIT * 7 * UNIT
        self.patience = 0  # searches without merging free blocks

    def context(self, text: int) -> int | None:
        """A unit for a context."""
        if self.high != self.low:
            self.high -= UNIT
            return self.high
        return self.free[0].pop() if self.free[0] else self._rare(0, text)

    def block(self, kind: int, text: int) -> int | None:
        if self.free[kind]:
            return self.free[kind].pop()
        size = SIZES[kind] * UNIT
        if size <= self.high - self.low:
            self.low += size
            return self.low - size
        return self._rare(kind, text)

    def release(self, at: int, units: int) -> None:
        self.free[FITTING[units]].append(at)

    def _put(self, at: int, units: int) -> None:
        """Free units as one block, or as two where no block has just this size."""
        kind = FITTING[units]
        if SIZES[kind] != units:
            kind -= 1
            rest = units - SIZES[kind]
            self.free[rest - 1].append(at + SIZES[kind] * UNIT)
        self.free[kind].append(at)

    def shrunk(self, at: int, old: int, new: int) -> int:
        """Where a table of `old` units is when it needs only `new`."""
        before, after = FITTING[old], FITTING[new]
        if before == after:
            return at
        if self.free[after]:
            place = self.free[after].pop()
            self.free[before].append(at)
            return place
        self._put(at + SIZES[after] * UNIT, SIZES[before] - SIZES[after])
        return at

    def _rare(self, kind: int, text: int) -> int | None:
        if not self.patience:
            self._merge()
            if self.free[kind]:
                return self.free[kind].pop()
        for larger in range(kind + 1, len(SIZES)):
            if self.free[larger]:
                at = self.free[larger].pop()
                self._put(at + SIZES[kind] * UNIT, SIZES[larger] - SIZES[kind])
                return at
        size = SIZES[kind] * UNIT
        self.patience -= 1
        if self.start - text > size:
            self.start -= size
            return self.start
        return None

    def _merge(self) -> None:
        """Join free neighbours and deal them out again, the last freed of the largest blocks first."""
        self.patience = 255
        order = [(at, SIZES[kind]) for kind, blocks in enumerate(self.free) for at in reversed(blocks)][::-1]
        there = dict(order)
        self.free = [[] for _ in SIZES]
        for at, _ in order:
            if at not in there:
                continue
            units = there[at]
            while (after := there.get(at + units * UNIT)) is not None and units + after < 0x10000:
                del there[at + units * UNIT]
                units += after
            there[at] = units
        for at, _ in order:
            if at in there:
                units = there[at]
                while units > 128:
                    self.free[-1].append(at)
                    at, units = at + 128 * UNIT, units - 128
                self._put(at, units)


class Symbol:
    """A symbol of a context. then: the context after it, a place in the text, or 0."""

    __slots__ = ("byte", "count", "then")

    def __init__(self, byte: int, count: int, then):
        self.byte, self.count, self.then = byte, count, then


class Context:
    __slots__ = ("symbols", "total", "shorter", "table")

    def __init__(self, symbols: list[Symbol], total: int, shorter, table=None):
        self.symbols, self.total, self.shorter, self.table = symbols, total, shorter, table


class Estimate:
    """How often symbols not seen yet come, by the kind of context."""

    __slots__ = ("sum", "shift", "left")

    def __init__(self, value: int, shift: int = PERIOD - 4, left: int = 4):
        self.sum, self.shift, self.left = value << shift if left == 4 else value, shift, left

    def take(self) -> int:
        mean = self.sum >> self.shift
        self.sum = self.sum - mean & 0xFFFF
        return mean or 1

    def confirm(self) -> None:
        if self.shift < PERIOD:
            self.left -= 1
            if not self.left:
                self.sum = self.sum << 1 & 0xFFFF
                self.left = 3 << self.shift & 255
                self.shift += 1


class Model:
    def __init__(self, order: int = ORDER, memory: int = MEMORY):
        self.order, self.arena = order, Arena(memory)
        self.text = bytearray()
        self.escape = 0
        self.high_bits = 0
        self.restart()

    def restart(self) -> None:
        self.arena.reset()
        self.text.clear()
        self.fall = self.order
        self.run = self.first_run = -min(self.order, 12) - 1
        self.success = 0
        root = Context([Symbol(b, 1, 0) for b in range(256)], 257, None)
        self.arena.context(0)
        root.table = self.arena.block(FITTING[128], 0)
        self.now = self.longest = root
        self.found = root.symbols[0]
        self.binary = [[BINARY - FIRST_ESCAPES[k & 7] // (i + 2) for k in range(64)] for i in range(128)]
        self.estimates = [[Estimate(5 * i + 10) for _ in range(16)] for i in range(25)]

    # --- coding ---------------------------------------------------------------------------------

    def step(self, coder, byte: int | None = None) -> int | None:
        """Code one byte with an encoder, or read one with a decoder; None at an end mark."""
        symbols = self.now.symbols
        if len(symbols) > 1:
            total = self.now.total
            goal = coder.threshold(total) if byte is None else -1
            below = 0
            for i, s in enumerate(symbols):
                if s.byte == byte or goal >= 0 and goal < below + s.count:
                    coder.narrow(below, s.count, total)
                    self.found = s
                    self._counted(i)
                    return s.byte
                below += s.count
            if goal >= total:
                raise MalformedData("range coder")
            self.success = 0
            self.high_bits = self.found.byte >= 0x40
            coder.narrow(below, total - below, total)
        else:
            s = symbols[0]
            shorter = len(self.now.shorter.symbols)
            self.high_bits = self.found.byte >= 0x40
            row = self.binary[s.count - 1]
            at = self.success + (0 if shorter == 1 else 2 if shorter == 2 else 4 if shorter < 12 else 6) + 8 * self.high_bits + 16 * (s.byte >= 0x40) + (32 if self.run < 0 else 0)
            p = row[at]
            mean = p + 32 >> PERIOD
            if not coder.bit(p, None if byte is None else int(byte != s.byte)):
                row[at] = p + 128 - mean
                self.found = s
                s.count += s.count < 128
                self.success = 1
                self.run += 1
                self._go_on()
                return s.byte
            row[at] = p - mean
            self.escape = ESCAPE_BY_ESTIMATE[row[at] >> 10]
            self.success = 0
        masked = {s.byte for s in symbols}
        while True:
            seen = len(self.now.symbols)
            while True:
                self.fall += 1
                if self.now.shorter is None:
                    return None
                self.now = self.now.shorter
                if len(self.now.symbols) != seen:
                    break
            left = [s for s in self.now.symbols if s.byte not in masked]
            estimate, escapes = self._escapes(seen)
            known = sum(s.count for s in left)
            total = known + escapes
            goal = coder.threshold(total) if byte is None else -1
            below = 0
            for s in left:
                if s.byte == byte or goal >= 0 and goal < below + s.count:
                    coder.narrow(below, s.count, total)
                    estimate.confirm()
                    self.found = s
                    self.now.total += 4
                    s.count += 4
                    if s.count > MAX_FREQUENCY:
                        self._halve()
                    self.run = self.first_run
                    self._learn()
                    return s.byte
                below += s.count
            if goal >= total:
                raise MalformedData("range coder")
            coder.narrow(known, escapes, total)
            estimate.sum = estimate.sum + total & 0xFFFF
            masked |= {s.byte for s in left}

    def _escapes(self, seen: int) -> tuple[Estimate, int]:
        now = self.now
        n = len(now.symbols)
        if n == 256:
            return Estimate(0, PERIOD, 64), 1
        unseen = n - seen
        row = self.estimates[ESCAPE_CLASS[unseen - 1]]
        found = row[(unseen < len(now.shorter.symbols) - n) + 2 * (now.total < 11 * n) + 4 * (seen > unseen) + 8 * self.high_bits]
        return found, found.take()

    def _counted(self, i: int) -> None:
        """The i-th symbol of a context with several came."""
        now, s = self.now, self.found
        if i == 0:
            self.success = int(2 * s.count > now.total)
            self.run += self.success
        else:
            self.success = 0
        now.total += 4
        s.count += 4
        if i and s.count > now.symbols[i - 1].count:
            now.symbols[i - 1 : i + 1] = s, now.symbols[i - 1]
            if s.count > MAX_FREQUENCY:
                self._halve()
        elif i == 0 and s.count > MAX_FREQUENCY:
            self._halve()
        self._go_on()

    def _go_on(self) -> None:
        if not self.fall and isinstance(self.found.then, Context):
            self.now = self.longest = self.found.then
        else:
            self._learn()

    def _halve(self) -> None:
        """Halve all counts; symbols that came to none leave, the one found comes first."""
        now, s = self.now, self.found
        symbols = now.symbols
        n = len(symbols)
        symbols.remove(s)
        add = int(self.fall != 0)
        escapes = now.total - s.count - sum(x.count for x in symbols)
        s.count += 4
        symbols.insert(0, s)
        for x in symbols:
            x.count = x.count + add >> 1
        # stable, but never before the first one by an equal count
        symbols.sort(key=lambda x: -x.count)
        total = sum(x.count for x in symbols)
        gone = sum(not x.count for x in symbols)
        if gone:
            escapes += gone
            del symbols[n - gone :]
            if len(symbols) == 1:
                only = symbols[0]
                while True:
                    only.count -= only.count >> 1
                    escapes >>= 1
                    if escapes <= 1:
                        break
                self.arena.release(now.table, n + 1 >> 1)
                now.table = None
                self.found = only
                return
            old, new = n + 1 >> 1, len(symbols) + 1 >> 1
            if old != new:
                now.table = self.arena.shrunk(now.table, old, new)
        now.total = total + escapes - (escapes >> 1)
        self.found = symbols[0]

    # --- the tree -------------------------------------------------------------------------------

    def _branch(self, skip: bool) -> Context | None:
        """Contexts for the found symbol in all orders that end in the same place of the text."""
        context, found = self.now, self.found
        place = found.then
        waiting = [] if skip else [found]
        while context.shorter is not None:
            context = context.shorter
            s = next(x for x in context.symbols if x.byte == found.byte)
            if s.then != place:
                context = s.then
                if not waiting:
                    return context
                break
            waiting.append(s)
        byte = self.text[place]
        if len(context.symbols) == 1:
            count = context.symbols[0].count
        else:
            s = next(x for x in context.symbols if x.byte == byte)
            own = s.count - 1
            others = context.total - len(context.symbols) - own
            count = 1 + (int(5 * own > others) if 2 * own <= others else (2 * own + 3 * others - 1) // (2 * others))
        for s in reversed(waiting):
            if self.arena.context(len(self.text)) is None:
                return None
            context = Context([Symbol(byte, count & 255, place + 1)], 0, context)
            s.then = context
        return context

    def _learn(self) -> None:
        if not self._learned():
            self.restart()

    def _learned(self) -> bool:
        """Add the found symbol to the contexts that lacked it; False where memory has run out."""
        found, now, arena = self.found, self.now, self.arena
        after = found.then
        if found.count < MAX_FREQUENCY // 4 and now.shorter is not None:
            context = now.shorter
            if len(context.symbols) == 1:
                s = context.symbols[0]
                s.count += s.count < 32
            else:
                i = next(i for i, x in enumerate(context.symbols) if x.byte == found.byte)
                s = context.symbols[i]
                if i and s.count >= context.symbols[i - 1].count:
                    context.symbols[i - 1 : i + 1] = s, context.symbols[i - 1]
                if s.count < MAX_FREQUENCY - 9:
                    s.count += 2
                    context.total += 2
        if not self.fall:
            branch = self._branch(True)
            if branch is None:
                return False
            self.now = self.longest = found.then = branch
            return True
        self.text.append(found.byte)
        successor = len(self.text)
        if successor >= arena.start:
            return False
        keep = True
        if after:
            if not isinstance(after, Context):
                after = self._branch(False)
                if after is None:
                    return False
            self.fall -= 1
            if not self.fall:
                successor = after
                keep = self.longest is now
        else:
            found.then = successor
            after = now
        n = len(now.symbols)
        others = now.total - n - (found.count - 1)
        context = self.longest
        while context is not now:
            symbols = context.symbols
            m = len(symbols)
            if m > 1:
                if not m & 1 and FITTING[m >> 1] != FITTING[(m >> 1) + 1]:
                    table = arena.block(FITTING[m >> 1] + 1, len(self.text))
                    if table is None:
                        return False
                    arena.release(context.table, m >> 1)
                    context.table = table
                context.total += (2 * m < n) + 2 * (4 * m <= n and context.total <= 8 * m)
            else:
                context.table = arena.block(0, len(self.text))
                if context.table is None:
                    return False
                s = symbols[0]
                s.count = 2 * s.count if s.count < MAX_FREQUENCY // 4 - 1 else MAX_FREQUENCY - 4
                context.total = s.count + self.escape + (n > 3)
            weight = 2 * found.count * (context.total + 6)
            scale = others + context.total
            if weight < 6 * scale:
                count = 1 + (weight > scale) + (weight >= 4 * scale)
                context.total += 3
            else:
                count = 4 + (weight >= 9 * scale) + (weight >= 12 * scale) + (weight >= 15 * scale)
                context.total += count
            symbols.append(Symbol(found.byte, count, successor))
            context = context.shorter
        if not keep:
            self.text.pop()
        self.now = self.longest = after
        return True


# --- range coders ---------------------------------------------------------------------------------


class Decoder:
    """Carryless decoder of 7z and of the raw codec."""

    def __init__(self, data: bytes, at: int = 0):
        if len(data) < at + 5 or data[at]:
            raise MalformedData("range coder")
        self.data, self.at = data, at + 5
        self.range, self.code = 0xFFFFFFFF, int.from_bytes(data[at + 1 : at + 5], "big")

    def _fill(self) -> None:
        while self.range < 1 << 24:
            if self.at >= len(self.data) + 8:
                raise MalformedData("truncated stream")
            self.code = (self.code << 8 | (self.data[self.at] if self.at < len(self.data) else 0)) & 0xFFFFFFFF
            self.range = self.range << 8 & 0xFFFFFFFF
            self.at += 1

    def threshold(self, total: int) -> int:
        self.range //= total
        return self.code // self.range

    def narrow(self, below: int, size: int, total: int) -> None:
        self.code -= below * self.range
        self.range *= size
        self._fill()

    def bit(self, size: int, wanted: int | None = None) -> int:
        bound = (self.range >> 14) * size
        if self.code < bound:
            self.range, out = bound, 0
        else:
            self.code, self.range, out = self.code - bound, self.range - bound, 1
        self._fill()
        return out


class Encoder:
    def __init__(self):
        self.low, self.range, self.cache, self.pending = 0, 0xFFFFFFFF, 0, 1
        self.out = bytearray()

    def _shift(self) -> None:
        carry = self.low >> 32
        if carry or self.low < 0xFF000000:
            self.out.append(self.cache + carry & 255)
            self.out += bytes([0xFF + carry & 255]) * (self.pending - 1)
            self.pending, self.cache = 0, self.low >> 24 & 255
        self.pending += 1
        self.low = (self.low & 0xFFFFFF) << 8

    def _fill(self) -> None:
        while self.range < 1 << 24:
            self.range <<= 8
            self._shift()

    def narrow(self, below: int, size: int, total: int) -> None:
        self.range //= total
        self.low += below * self.range
        self.range *= size
        self._fill()

    def bit(self, size: int, wanted: int) -> int:
        bound = (self.range >> 14) * size
        if wanted:
            self.low, self.range = self.low + bound, self.range - bound
        else:
            self.range = bound
        self._fill()
        return wanted

    def finish(self) -> bytes:
        for _ in range(5):
            self._shift()
        return bytes(self.out)


def _checked(order: int, memory: int) -> None:
    if not 2 <= order <= 64 or not 1 << 11 <= memory <= 0xFFFFFFFF - 12 * 3:
        raise ValueError("PPMd order or memory")


def encode(data, order: int = ORDER, memory: int = MEMORY) -> bytes:
    _checked(order, memory)
    data = bytes(data)
    if (packed := jvm.ppmd_encode(data, order, memory)) is not None:
        return packed
    model, coder = Model(order, memory), Encoder()
    for byte in data:
        model.step(coder, byte)
    return coder.finish()


#: What a JVM says that could not go on.
WRONG = {-1: "end mark before the end", -2: "range coder", -3: "truncated stream"}


def decode(data, max_output: int, decoded_size: int | None = None, order: int = ORDER, memory: int = MEMORY, max_memory: int | None = None) -> tuple[bytes, int]:
    """The stream doesn't tell where it ends: the decoded size must be known."""
    if decoded_size is None:
        raise ValueError("PPMd needs decoded_size")
    _checked(order, memory)
    if decoded_size > max_output:
        raise LimitExceeded("output", max_output, decoded_size)
    if max_memory is not None and memory > max_memory:
        raise LimitExceeded("memory", max_memory, memory)
    data = bytes(data)
    coder, out = Decoder(data), bytearray()
    if (found := jvm.ppmd_decode(data, decoded_size, order, memory)) is not None:
        plain, said, taken = found
        if said:
            raise MalformedData(WRONG[said])
        return plain, taken
    model = Model(order, memory)
    while len(out) < decoded_size:
        byte = model.step(coder)
        if byte is None:
            raise MalformedData("end mark before the end")
        out.append(byte)
    return bytes(out), min(coder.at, len(data))
