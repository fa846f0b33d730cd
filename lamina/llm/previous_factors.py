"""Substring dedup over bytes by longest previous factors.

The factor of a position is the longest string that starts there and also at an earlier position; it is
found in suffix order, where the nearest neighbour to either side that stands at a smaller position
shares it. Suffixes are put in order bucket by bucket: a bucket holds the suffixes whose first FLOOR
bytes have one anchor, the smallest hash of 32 bytes among them. Suffixes that agree on FLOOR bytes or
more have the same anchor at the same offset, so all that factors of that length need is in one bucket.
Inside it suffixes are sorted by their bytes; common prefixes of neighbours are measured on the bytes
themselves, and the previous and next smaller positions follow by pointer jumping.
Factors shorter than FLOOR are none, and they are measured up to SIZE bytes, as longer ones cover the
same bytes from their later positions.

Three results come from one order. `n_removed` and the digests are those of the contract: each byte
covered by a SIZE-byte string that also starts anywhere else, first copies included; a suffix has one
just where a neighbour to either side shares SIZE bytes. `n_later` counts the bytes that previous
factors cover, the later copies, so the first copy is kept; `n_earlier_docs` counts those among them
that come from another document, of smaller doc_id.

Neighbouring suffixes with one anchor form a run, a row of its bytes' hashes. Equal runs are counted as
one before anything meets, only buckets with several different runs are cut out of the texts, and a
bucket of more than `crowd` runs is not sorted in one worker: its windows are counted by aggregation.

Null texts are empty; matches stay inside a text; positions are ordered by doc_id (a null one last),
then by a hash of the row, then by place. Repeated rows are copies like any others to `n_removed`; they
stand at the same position, so none of them is later than another. Extra columns are ignored. Removal
can cut a character, so kept texts are bytes.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import I1, M1, NULL_ID, PrimeRolling, Rolling, Scratch, as_bytes, chunks, sliding_argmin
from .repeats import BYTE, byte_units, covered, prepared

#: Bytes of the contract's strings, of the shortest factor, and of the pieces that anchors are chosen from.
SIZE, FLOOR, GRAM = 400, 256, 32
RUN = "key long, h1 long, h2 long, doc long, rk long, start int, n int, size int"
CONTENT = "key long, h1 long, h2 long, doc long, rk long, start int, n int, crowd long, content binary"
FLAG = "key long, h1 long, h2 long, anywhere array<int>, later array<int>, earlier array<int>"
#: Strings compared byte by byte at once.
BLOCK = 1 << 14


@dataclass(frozen=True)
class Lengths:
    """size: of the contract's strings; floor: of the shortest factor; gram: of anchors' pieces."""

    size: int = SIZE
    floor: int = FLOOR
    gram: int = GRAM
    segment: int = 1 << 21  # positions worked on at once


def run_rows(how: Lengths, texts: list[bytes]) -> tuple[np.ndarray, ...] | None:
    """Runs of some texts: (text, name, h1, h2, start in its text, suffixes, bytes). Long texts go in segments."""
    data, ends = byte_units(texts)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    parts = []
    for a in range(0, max(0, len(data) - how.floor + 1), how.segment):
        b = min(len(data), a + how.segment + how.size - 1)
        if (found := _segment_runs(how, data[a:b], np.clip(ends - a, 0, b - a))) is not None:
            t, name, h1, h2, begin, n, size = found
            parts.append((t, name, h1, h2, begin + a - starts[t], n, size))
    return tuple(np.concatenate(c) for c in zip(*parts)) if parts else None


def _segment_runs(how: Lengths, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...] | None:
    digits = BYTE[data]
    rolling = Rolling(digits, M1, I1)
    at = np.arange(max(0, len(data) - how.gram + 1))
    names = rolling.of(at, at + how.gram)
    anchor = sliding_argmin(names, how.floor - how.gram + 1)[: how.segment]
    of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    suffixes = np.arange(len(anchor))
    suffixes = suffixes[of[suffixes] == of[suffixes + how.floor - 1]]
    if not len(suffixes):
        return None
    a, t = anchor[suffixes], of[suffixes]
    first = np.ones(len(suffixes), dtype=bool)
    first[1:] = (a[1:] != a[:-1]) | (t[1:] != t[:-1])
    head = np.flatnonzero(first)
    n = np.diff(np.append(head, len(suffixes)))
    begin, t = suffixes[head], t[head]
    end = np.minimum(begin + n + how.size - 1, ends[t])
    return t, names[a[head]], rolling.of(begin, end), PrimeRolling(data, BYTE).of(begin, end), begin, n, end - begin


def runs(how: Lengths, docs: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            doc, rk = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts = as_bytes(batch.column(2))
            for lo, hi in chunks(texts):
                if (found := run_rows(how, texts[lo:hi])) is not None:
                    t, name, h1, h2, *places = found
                    cols = [name.view(np.int64), h1.view(np.int64), h2.view(np.int64), doc[lo + t], rk[lo + t], *(x.astype(np.int32) for x in places)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [f.split()[0] for f in RUN.split(", ")])

    return docs.mapInArrow(run, RUN)


def contents(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """Cut the first run of each wanted content out of its text."""
    per = wanted.groupBy("doc", "rk").agg(F.collect_list(F.struct("key", "h1", "h2", "start", "n", "crowd", "size")).alias("w"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, asked = as_bytes(batch.column(2)), batch.column(3)
            offsets = asked.offsets.to_numpy()
            key, h1, h2, start, n, many, size = (x.to_numpy(zero_copy_only=False) for x in asked.values.flatten())
            of = np.repeat(np.arange(len(texts)), np.diff(offsets))
            doc, rk = (batch.column(i).to_numpy(zero_copy_only=False)[of] for i in (0, 1))
            for lo, hi in chunks(texts):
                r = slice(offsets[lo], offsets[hi])
                cut = [texts[i][p : p + m] for i, p, m in zip(of[r].tolist(), start[r].tolist(), size[r].tolist())]
                yield pa.RecordBatch.from_arrays([*(pa.array(x[r]) for x in (key, h1, h2, doc, rk, start, n, many)), pa.array(cut, pa.binary())], [f.split()[0] for f in CONTENT.split(", ")])

    # a row that comes repeatedly is cut more than once: the later steps don't mind
    return docs.join(per, ["doc", "rk"]).select("doc", "rk", "text", "w").mapInArrow(run, CONTENT)


# --- suffix order ---------------------------------------------------------------------------------


class Minima:
    """Smallest value of any range, from those of ranges of 2^k values."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while (step := 1 << (len(self.levels) - 1)) < len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last, np.append(last[step:], last[-step:] if step < len(last) else last)))
        self.table = np.stack(self.levels)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of values start .. end - 1, at least one each."""
        level = np.frexp((end - start).astype(np.float64))[1] - 1
        return np.minimum(self.table[level, start], self.table[level, end - (1 << level)])


def shared_prefixes(parts: list[bytes], most: int) -> np.ndarray:
    """Bytes that each string shares with the one before it, `most` at most; 0 for the first."""
    out = np.zeros(len(parts), dtype=np.int64)
    sizes = np.array([min(len(p), most) for p in parts], dtype=np.int64)
    for s in range(1, len(parts), BLOCK):
        e = min(len(parts), s + BLOCK)
        width = int(sizes[s - 1 : e].max())
        rows = np.frombuffer(b"".join(p[:width].ljust(width, b"\0") for p in parts[s - 1 : e]), dtype=np.uint8).reshape(e - s + 1, width)
        differ = rows[:-1] != rows[1:]
        first = differ.argmax(axis=1) if width else np.zeros(e - s, dtype=np.int64)
        if width:
            first[~differ[np.arange(e - s), first]] = width
        out[s:e] = np.minimum(first, np.minimum(sizes[s - 1 : e - 1], sizes[s:e]))
    return out


class Suffixes:
    """The suffixes of some buckets' contents that have a partner, in suffix order.

    Suffixes that agree on their first bytes stand equally far before their bucket's anchor, and agree up
    to it. So behind the anchor, where they can differ, one order of the contents' right parts is the
    order of all these classes at once: right parts are sorted, and each class takes its suffixes in that
    order. Common prefixes of two suffixes are the common prefix of their right parts, a minimum over that
    order, and the way to the anchor, if their left parts agree so far: a minimum over the order of the
    left parts read backwards. Both are counted on the bytes.

    which, x: content and place in it. common: bytes shared with the suffix before in the order, up to
    SIZE; 0 below the floor and at the start of a class.
    """

    def __init__(self, how: Lengths, content: list[bytes], key: np.ndarray, n: np.ndarray):
        self.how = how
        sizes = np.array([len(c) for c in content], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(content), dtype=np.uint8)
        rolling = Rolling(BYTE[data], M1, I1)
        anchor = self._anchors(rolling, starts, key)
        which = np.repeat(np.arange(len(content)), n)
        x = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        at = starts[which] + x
        name = rolling.of(at, at + how.floor)
        order = np.argsort(name)
        sorted_name = name[order]
        same = sorted_name[1:] == sorted_name[:-1]
        partnered = np.append(same, False) | np.append(False, same)
        group = np.cumsum(np.append(True, ~same)[partnered]) if len(name) else np.zeros(0, np.int64)
        which, x = which[order[partnered]], x[order[partnered]]
        # right parts from the anchor on, left parts from it back, both inside their bucket
        right = [(int(k), c[a:]) for k, c, a in zip(key, content, anchor)]
        left = [(int(k), c[:a][::-1]) for k, c, a in zip(key, content, anchor)]
        rank, right_common = self._ordered(right)
        back, left_common = self._ordered(left)
        order = np.argsort(group << 32 | rank[which])
        self.which, self.x, group = which[order], x[order], group[order]
        self.common = np.zeros(len(group), dtype=np.int64)
        if len(group):
            i = 1 + np.flatnonzero(group[1:] == group[:-1])
            a, b = self.which[i - 1], self.which[i]
            far = anchor[b] - self.x[i]
            behind = right_common.of(rank[a] + 1, rank[b] + 1)
            p, q = np.minimum(back[a], back[b]), np.maximum(back[a], back[b])
            # one name for different bytes: no partners
            agree = (anchor[a] - self.x[i - 1] == far) & (left_common.of(p + 1, q + 1) >= far)
            common = np.where(agree, np.minimum(far + behind, how.size), 0)
            self.common[i] = np.where(common >= how.floor, common, 0)

    def _anchors(self, rolling: Rolling, starts: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Where the anchor of each content's run is: the first piece with the bucket's name."""
        pieces = np.arange(self.how.floor - self.how.gram + 1)
        out = np.zeros(len(starts), dtype=np.int64)
        for s in range(0, len(starts), 1 << 12):
            at = starts[s : s + (1 << 12), None] + pieces
            out[s : s + (1 << 12)] = (rolling.of(at, at + self.how.gram) == key[s : s + (1 << 12), None].view(np.uint64)).argmax(axis=1)
        return out

    def _ordered(self, parts: list[tuple[int, bytes]]) -> tuple[np.ndarray, Minima]:
        """Each part's place in the order of (bucket, bytes), and the minima of what neighbours share."""
        order = sorted(range(len(parts)), key=parts.__getitem__)
        rank = np.empty(len(parts), dtype=np.int64)
        rank[order] = np.arange(len(parts))
        shared = shared_prefixes([parts[i][1] for i in order], self.how.size)
        for i in range(1, len(order)):
            if parts[order[i]][0] != parts[order[i - 1]][0]:
                shared[i] = 0
        return rank, Minima(shared)


def smaller_before(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Bytes that each suffix shares with the nearest one before it in the order that stands at a smaller position.

    Between a suffix and the one it has reached there are only larger positions, so it may go on from
    that one by as far as that one has come: ways double each round. A way that shares nothing any more ends.
    """
    n = len(position)
    if not n:
        return np.zeros(0, dtype=np.int64)
    to, shared = np.arange(n) - 1, common.copy()
    shared[0] = 0
    todo = np.flatnonzero(shared > 0)
    while len(todo := todo[(shared[todo] > 0) & (position[to[todo]] >= position[todo])]):
        over = to[todo]
        # both sides from before the round
        next_to, next_shared = to[over], np.minimum(shared[todo], shared[over])
        to[todo], shared[todo] = next_to, next_shared
    return shared


def previous_factors(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The longest factor with an earlier position, from the previous and the next smaller one in the order."""
    back = np.append(common[1:], 0)[::-1]
    return np.maximum(smaller_before(position, common), smaller_before(position[::-1], back)[::-1])


def flagged(how: Lengths, content: list[bytes], key: np.ndarray, doc: np.ndarray, rk: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[list[list[int]], ...]:
    """Per content, as flat pairs (first, last): suffixes that share SIZE bytes with another, those with a
    previous factor, and those with one in a document of smaller doc_id."""
    s = Suffixes(how, content, key, n)
    # positions as numbers: texts in order of (doc, rk), each with as many as its runs reach to
    order = np.lexsort((rk, doc))
    new_doc = np.append(0, doc[order][1:] != doc[order][:-1])
    text = np.cumsum(new_doc | np.append(0, rk[order][1:] != rk[order][:-1]))
    reach = np.zeros(len(content) + 1, dtype=np.int64)
    np.maximum.at(reach, text + 1, (start + n)[order])
    first, document = np.empty(len(content), dtype=np.int64), np.empty(len(content), dtype=np.int64)
    first[order] = np.cumsum(reach)[text]
    first += start
    document[order] = np.cumsum(new_doc)
    anywhere = np.maximum(s.common, np.append(s.common[1:], 0)[: len(s.common)]) >= how.size
    later = previous_factors(first[s.which] + s.x, s.common) >= how.floor
    earlier = previous_factors(document[s.which], s.common) >= how.floor
    offsets = np.cumsum(n) - n
    out = []
    for flag in (anywhere, later, earlier):
        marks = np.zeros(int(n.sum()), dtype=bool)
        marks[(offsets[s.which] + s.x)[flag]] = True
        at = np.flatnonzero(marks)
        which = np.searchsorted(offsets, at, side="right") - 1
        out.append(_runs_of(which, at - offsets[which], len(content)))
    return tuple(out)


def _runs_of(which: np.ndarray, x: np.ndarray, count: int) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(count)]
    if len(x):
        cut = np.flatnonzero((np.diff(x) != 1) | (np.diff(which) != 0))
        for s, e in zip(np.append(0, cut + 1).tolist(), np.append(cut, len(x) - 1).tolist()):
            out[which[s]] += [int(x[s]), int(x[e])]
    return out


def compared(how: Lengths, cut: DataFrame, crowd: int, held_bytes: int = 2_000_000) -> DataFrame:
    """Flags of the buckets that one worker can sort: whole buckets, some megabytes at a time."""

    def flags(rows: list[tuple]):
        import pyarrow as pa

        numbers = [np.array([r[i] for r in rows], dtype=np.int64) for i in range(7)]
        found = flagged(how, [r[7] for r in rows], numbers[0], *numbers[3:])
        some = [i for i in range(len(rows)) if any(f[i] for f in found)]
        return pa.RecordBatch.from_arrays([*(pa.array(c[some]) for c in numbers[:3]), *(pa.array([f[i] for i in some], pa.list_(pa.int32())) for f in found)], [f.split()[0] for f in FLAG.split(", ")])

    def run(batches):
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "h1", "h2", "doc", "rk", "start", "n", "content"))):
                if row[0] != last and size > held_bytes:
                    yield flags(held)
                    held, size = [], 0
                if held and row[:3] == held[-1][:3]:
                    continue  # cut twice
                held.append(row)
                size += len(row[7])
                last = row[0]
        if held:
            yield flags(held)

    few = cut.where(f"crowd <= {crowd}").drop("crowd").repartition("key").sortWithinPartitions("key", "h1", "h2")
    return few.mapInArrow(run, FLAG)


def crowded(how: Lengths, cut: DataFrame, crowd: int) -> DataFrame:
    """The same flags for larger buckets: suffixes become rows, and the classes of those that agree on
    FLOOR and on SIZE bytes (by 128 bits of hashes) are aggregated, so no worker holds a bucket."""

    def run(batches):
        import pyarrow as pa

        names = ["key", "h1", "h2", "doc", "rk", "p", "x", "a1", "a2", "b1", "b2"]
        for batch in batches:
            content = batch.column("content").to_pylist()
            for lo, hi in chunks(content, 500_000):
                data, ends = byte_units(content[lo:hi])
                sizes = np.diff(ends, prepend=0)
                n = batch.column("n").to_numpy(zero_copy_only=False)[lo:hi].astype(np.int64)
                which = np.repeat(np.arange(hi - lo), n)
                x = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                at = (ends - sizes)[which] + x
                full = np.minimum(at + how.size, ends[which])
                known = full - at == how.size
                own = [batch.column(c).to_numpy(zero_copy_only=False)[lo:hi][which] for c in ("key", "h1", "h2", "doc", "rk", "start")]
                own[5] = own[5].astype(np.int64) + x
                digits = BYTE[data]
                sides = [h.view(np.int64) for rolling in (Rolling(digits, M1, I1), PrimeRolling(data, BYTE)) for h in (rolling.of(at, at + how.floor), rolling.of(at, full))]
                cols = [*(pa.array(c) for c in own), pa.array(x.astype(np.int32)), pa.array(sides[0]), pa.array(sides[2]), pa.array(sides[1], mask=~known), pa.array(sides[3], mask=~known)]
                yield pa.RecordBatch.from_arrays(cols, names)

    rows = cut.where(f"crowd > {crowd}").drop("crowd").dropDuplicates(["key", "h1", "h2"])
    rows = rows.mapInArrow(run, "key long, h1 long, h2 long, doc long, rk long, p long, x int, a1 long, a2 long, b1 long, b2 long")
    first = rows.groupBy("key", "a1", "a2").agg(F.min(F.struct("doc", "rk", "p")).alias("first"))
    whole = rows.where("b1 is not null").groupBy("key", "b1", "b2").agg(F.count("*").alias("of"))
    met = rows.join(first, ["key", "a1", "a2"]).join(whole, ["key", "b1", "b2"], "left")
    marks = met.select("key", "h1", "h2", "x", (F.coalesce("of", F.lit(0)) > 1).alias("anywhere"), (F.struct("doc", "rk", "p") > F.col("first")).alias("later"), (F.col("doc") > F.col("first.doc")).alias("earlier"))
    pairs = lambda c: F.flatten(F.transform(F.array_sort(F.collect_set(F.when(F.col(c), F.col("x")))), lambda x: F.array(x, x))).alias(c)
    return marks.where("anywhere or later").groupBy("key", "h1", "h2").agg(pairs("anywhere"), pairs("later"), pairs("earlier"))


def factor_spans(how: Lengths, docs: DataFrame, scratch: Scratch, crowd: int) -> DataFrame:
    """Per (doc, rk) flat pairs (start, end) of bytes: anywhere, later, earlier."""
    found = scratch.table("runs", runs(how, docs))
    every = scratch.table("every", found.groupBy("key", "h1", "h2").agg(F.count("*").alias("times"), F.min(F.struct("doc", "rk", "start", "n", "size")).alias("rep")))
    names = scratch.table("names", every.groupBy("key").agg(F.sum("times").alias("of"), F.count("*").alias("crowd")).where("of > 1").drop("of"))
    classes = scratch.table("classes", every.join(names, "key"))
    scratch.drop("every", "names")
    cut = scratch.table("contents", contents(classes.where("crowd > 1").select("key", "h1", "h2", "crowd", "rep.*"), docs))
    flags = compared(how, cut, crowd)
    if not cut.where(f"crowd > {crowd}").isEmpty():
        flags = flags.unionByName(crowded(how, cut, crowd))
    # a run without partners has no row here
    known = scratch.table("known", classes.select("key", "h1", "h2", "times", "rep").join(scratch.table("flags", flags), ["key", "h1", "h2"], "left").where("anywhere is not null or times > 1"))
    scratch.drop("contents", "classes", "flags")
    start, end = F.col("start"), F.col("start") + F.col("size")
    # a run that isn't the first of its content is later in all its suffixes
    again = F.struct("doc", "rk", "start") > F.struct("rep.doc", "rep.rk", "rep.start")
    elsewhere = F.col("doc") > F.col("rep.doc")
    parts = lambda c, n: F.transform(F.coalesce(F.col(c), F.array().cast("array<int>")), lambda x, i: start + x + F.when(i % 2 == 1, n).otherwise(0))
    near = F.array(start, start + F.col("n") + (how.floor - 1))
    spans = found.join(known, ["key", "h1", "h2"]).select(
        "doc",
        "rk",
        F.when((F.col("times") > 1) & (F.col("size") >= how.size), F.array(start, end)).otherwise(parts("anywhere", how.size)).alias("anywhere"),
        F.when(again, near).otherwise(parts("later", how.floor)).alias("later"),
        F.when(elsewhere, near).otherwise(parts("earlier", how.floor)).alias("earlier"),
    )
    kinds = ("anywhere", "later", "earlier")
    merged = spans.groupBy("doc", "rk").agg(*[F.flatten(F.collect_set(F.when(F.size(c) > 0, F.col(c)))).alias(c) for c in kinds])
    spans = scratch.table("spans", merged)
    scratch.drop("runs", "known")
    return spans


OUT = "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_later long, n_earlier_docs long, first_kept_sha256 string"


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: str = "all", crowd: int = 20_000, how: Lengths = Lengths()) -> DataFrame:
    """Per document row the columns of OUT.

    kept is what is left of the text: with remove="all" without every byte of a repeated string, with
    remove="later" without the bytes of previous factors, so that the first copy stays. The contract's
    columns n_removed, n_spans and kept_sha256 are of the former, first_kept_sha256 is of the latter.
    """
    scratch = Scratch(docs.sparkSession)
    rows = prepared(docs, id_col, text_col)
    spans = factor_spans(how, rows, scratch, crowd)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for text, *marks in zip(as_bytes(batch.column("text")), *(batch.column(c).to_pylist() for c in ("anywhere", "later", "earlier"))):
                if not any(marks):
                    digest = hashlib.sha256(text).hexdigest()
                    out.append((text, len(text), 0, 0, digest, 0, 0, digest))
                    continue
                raw = np.frombuffer(text, dtype=np.uint8)
                gone, later, earlier = (covered(m, len(text)) for m in marks)
                left, first = raw[~gone].tobytes(), raw[~later].tobytes()
                n_spans = int(gone[:1].sum()) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                out.append((left if remove == "all" else first, len(text), int(gone.sum()), n_spans, hashlib.sha256(left).hexdigest(), int(later.sum()), int(earlier.sum()), hashlib.sha256(first).hexdigest()))
            types = [pa.binary(), *[pa.int64()] * 3, pa.string(), *[pa.int64()] * 2, pa.string()]
            cols = list(zip(*out)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array(c, t) for c, t in zip(cols, types))], [f.split()[0] for f in OUT.split(", ")])

    out = rows.join(spans, ["doc", "rk"], "left").select("doc", "text", "anywhere", "later", "earlier").mapInArrow(run, OUT)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID)))
