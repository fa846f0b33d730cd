"""Substring dedup over words by recompression.

A text starts as the sequence of its words' names. Each round first names runs of one symbol, then
pairs of a left and a right symbol, sides being a bit of the name. What is merged depends on the
symbols alone, so equal stretches of words are cut alike except near their ends; every symbol carries
the stretch of words that decides it. A name is a 64-bit hash of what it stands for, so all tasks name
alike without a dictionary: naming by a shuffled dictionary would move every symbol in every round.
Symbols are kept short (`caps`), which bounds how far a cut depends on its surroundings.

The anchor of a window is the highest symbol decided inside it, the smallest name among several.
Anchors that documents share reveal candidates; their contents are then compared (see repeats).

A word is removed if a window of 50 words that also starts in a document of smaller doc_id covers it.
Null and empty texts have no words and are returned as they are; a null doc_id counts as larger than
any other; rows of one doc_id don't remove from each other; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import I2, M2, NULL_ID, Rolling, Scratch, as_bytes, mix, sliding_argmin
from .repeats import Kind, covered, earlier_judge, prepared, repeated_spans, with_spans

SIZE = 50
#: Words that a symbol of each round may have at most.
CAPS = (2, 4, 6)
#: Words that may decide an anchor.
DECIDED = 14
#: Beyond any place.
FAR = 1 << 40

_RUN, _PAIR, _SIDE = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def _side(level: int) -> np.uint64:
    return np.uint64(int(_SIDE) * level % (1 << 64))


def _named(a: np.ndarray, b: np.ndarray, salt: np.uint64) -> np.ndarray:
    return mix(mix(a + salt) ^ (b * np.uint64(0x9E3779B97F4A7C15) + salt))


class Symbols:
    """One level: names, the words [s, e) each covers, and the words [cl, cr) that decide it."""

    def __init__(self, name, s, e, cl, cr, text):
        self.name, self.s, self.e, self.cl, self.cr, self.text = name, s, e, cl, cr, text

    def joined(self, head: np.ndarray, name: np.ndarray) -> Symbols:
        """Groups of neighbours from each head on, under new names."""
        last = np.append(head[1:], len(self.name)) - 1
        return Symbols(name, self.s[head], self.e[last], np.minimum.reduceat(self.cl, head), np.maximum.reduceat(self.cr, head), self.text[head])


def run_step(x: Symbols, words: np.ndarray, cap: int) -> Symbols:
    """Name each run of one symbol of up to `cap` words; longer runs stay as they are."""
    n = len(x.name)
    same = np.zeros(n + 1, dtype=bool)  # equal to the one before, in the same text
    same[1:n] = (x.name[1:] == x.name[:-1]) & (x.text[1:] == x.text[:-1])
    head = np.flatnonzero(~same[:n])
    size = np.diff(np.append(head, n))
    run = np.repeat(np.arange(len(head)), size)
    rs, re = x.s[head], x.e[head + size - 1]
    long = (size > 1) & (re - rs > cap)
    cl, cr = x.cl.copy(), x.cr.copy()
    tail = head + size - 1
    # that a run ends here is seen from the next word if it differs from the one that would go on,
    # else from all that decides the neighbour
    h, t = np.maximum(head - 1, 0), np.minimum(tail + 1, n - 1)
    l_like = (head > 0) & (x.text[h] == x.text[head]) & (words[np.maximum(x.s[head] - 1, 0)] == words[x.e[head] - 1])
    r_like = (tail < n - 1) & (x.text[t] == x.text[tail]) & (words[np.minimum(x.e[tail], len(words) - 1)] == words[x.s[tail]])
    cl[head] = np.minimum(cl[head], np.where(l_like, np.minimum(x.cl[h], x.s[head] - 1), x.s[head] - 1))
    cr[head] = np.maximum(cr[head], np.where(l_like, x.cr[h], 0))
    cr[tail] = np.maximum(cr[tail], np.where(r_like, np.maximum(x.cr[t], x.e[tail] + 1), x.e[tail] + 1))
    cl[tail] = np.minimum(cl[tail], np.where(r_like, x.cl[t], FAR))
    # how much of a long run must be seen isn't traced: nothing in it is decided from here on
    lm = long[run]
    cl[lm], cr[lm] = -FAR, FAR
    y = Symbols(x.name, x.s, x.e, cl, cr, x.text)
    keep = ~same[:n] | lm
    head = np.flatnonzero(keep)
    m = np.diff(np.append(head, n)).astype(np.uint64)
    return y.joined(head, np.where(m > 1, _named(x.name[head], m, _RUN), x.name[head]))


def pair_step(x: Symbols, cap: int, level: int) -> Symbols:
    """Name each pair of a left and a right symbol of up to `cap` words together."""
    n = len(x.name)
    left = (mix(x.name + _side(level + 1)) >> np.uint64(40)) & np.uint64(1) == 1
    near = np.zeros(n + 1, dtype=bool)  # has a neighbour before, in the same text
    near[1:n] = x.text[1:] == x.text[:-1]
    pair = np.zeros(n + 1, dtype=bool)  # is the second of a pair
    pair[1:n] = near[1:n] & left[:-1] & ~left[1:] & (x.e[1:] - x.s[:-1] <= cap)
    first = np.append(pair[1:n], False)
    alone = ~pair[:n] & ~first
    cl, cr = x.cl.copy(), x.cr.copy()
    # why a symbol stayed alone is known from the neighbour that it could have joined
    go_l, go_r = alone & ~left, alone & left
    l, r = np.flatnonzero(go_l & near[:n]), np.flatnonzero(go_r & near[1:])
    cl[go_l & ~near[:n]] -= FAR  # a text's ends decide nothing: an equal window elsewhere goes on there
    cr[go_r & ~near[1:]] += FAR
    cl[l], cr[l] = np.minimum(cl[l], x.cl[l - 1]), np.maximum(cr[l], x.cr[l - 1])
    cl[r], cr[r] = np.minimum(cl[r], x.cl[r + 1]), np.maximum(cr[r], x.cr[r + 1])
    y = Symbols(x.name, x.s, x.e, cl, cr, x.text)
    head = np.flatnonzero(~pair[:n])
    second = np.minimum(head + 1, n - 1)
    return y.joined(head, np.where(first[head], _named(x.name[head], x.name[second], _PAIR + np.uint64(level)), x.name[head]))


def levels(words: np.ndarray, ends: np.ndarray, caps: tuple[int, ...] = CAPS) -> list[Symbols]:
    n = len(words)
    at = np.arange(n, dtype=np.int64)
    text = np.searchsorted(ends, at, side="right")
    out = [Symbols(words, at, at + 1, at, at + 1, text)]
    for i, cap in enumerate(caps):
        out.append(pair_step(run_step(out[-1], words, cap), cap, i))
    return out


def anchors(words: np.ndarray, ends: np.ndarray, size: int, caps: tuple[int, ...] = CAPS, decided: int = DECIDED) -> tuple[np.ndarray, np.ndarray]:
    """For each window start the word where its anchor's decision begins, and names by such words.

    A name stands for the anchor's symbol and for the `decided` words from there on, which lie in the
    window too: symbols of a few words alone would often be shared by chance.
    """
    n = len(words)
    most = np.iinfo(np.uint64).max
    best, names = np.full(n, most, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
    at = np.arange(n)
    stretch = Rolling(words, M2, I2).of(at, np.minimum(at + decided, n))
    found = levels(words, ends, caps)
    for rank, x in enumerate(reversed(found)):
        level = len(found) - 1 - rank
        ok = np.flatnonzero((x.cr - x.cl <= decided) & (x.cl >= 0))
        ok = ok[x.cr[ok] <= n]
        at = x.cl[ok]
        name = mix(x.name[ok] + _side(level))
        value = (np.uint64(rank) << np.uint64(61)) | (name >> np.uint64(3))
        # several symbols may be decided by words from the same one on: the smallest counts
        order = np.lexsort((value, at))
        at, value, name = at[order], value[order], name[order]
        one = np.ones(len(at), dtype=bool)
        one[1:] = at[1:] != at[:-1]
        at, value, name = at[one], value[one], name[one]
        better = value < best[at]
        best[at[better]], names[at[better]] = value[better], name[better]
    return sliding_argmin(best, size - decided + 1)[: max(0, n - size + 1)], mix(names ^ stretch)


WORDS = Kind(SIZE, anchors)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: Kind = WORDS, crowd: int = 20_000) -> DataFrame:
    """Per document row: doc_id, text (the words kept, joined by a space), n_words, n_removed, kept_sha256."""
    scratch = Scratch(docs.sparkSession)
    rows = prepared(docs, id_col, text_col)
    spans = repeated_spans(kind, rows, scratch, earlier_judge, crowd)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, marks = as_bytes(batch.column("text")), batch.column("spans").to_pylist()
            kept, n, gone = [], [], []
            for t, m in zip(texts, marks):
                words = t.split()  # bytes.split() parts at exactly \x20 and \x09-\x0D
                n.append(len(words))
                if m:
                    out = covered(m, len(words))
                    words = [w for w, g in zip(words, out.tolist()) if not g]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array([k.decode() for k in kept], pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                ["doc_id", "text", "n_words", "n_removed", "kept_sha256"],
            )

    out = with_spans(rows, spans).mapInArrow(run, "doc_id long, text string, n_words long, n_removed long, kept_sha256 string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID)))
