"""Token counts by a map-side lookup in two tiers.

A pre-token is a run of spaces with the characters up to the next space; no piece of the vocabulary
reaches over such a border, which `Counter` verifies when it loads the model, so tokens of a text are
the sum over its pre-tokens. First tier: lengths of the most frequent pre-tokens of all texts, in one
broadcast table of at most `table_size` entries. Second tier: each worker encodes what the table lacks
and remembers it in a bounded cache. Counting shuffles no pre-token; to find the frequent ones, each task
hands on the top of its tally. Tables only save work: results don't depend on them.

Null and empty texts have no tokens. Special strings in texts are plain text. Extra columns are
carried along, but for one with the name of the result; repeated rows are counted each.
"""

from __future__ import annotations

import re
from collections import Counter as Tally

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

SPACE = "▁"
PRE_TOKEN = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
LIMIT = 4096


def model_path(name: str) -> str:
    """A name of public_tokenizers is looked up where the code runs; a path stays as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Counter:
    """Counts tokens of whole texts; `known` is the first tier, `cached` the size of the second."""

    def __init__(self, model: str, known: dict[str, int] | None = None, cached: int = 500_000, longest: int = 64):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path(model))
        self.whole = any(SPACE in self.model.id_to_piece(i).lstrip(SPACE) for i in range(self.model.get_piece_size()))
        self.known, self.cached, self.longest = known or {}, cached, longest
        outer = self

        class Lookup(dict):
            def __missing__(self, key):
                n = outer.encoded(key)
                if len(key) <= outer.longest:
                    if len(self) - len(outer.known) >= outer.cached:
                        self.clear()
                        self.update(outer.known)
                    self[key] = n
                return n

        self.lookup = Lookup(self.known)

    def encoded(self, key: str) -> int:
        """Tokens of the pre-token with one more space before it; the encoder adds that space itself."""
        return len(self.model.encode(key, num_threads=1)) if key else 1

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if self.whole:
            return len(self.model.encode(text, num_threads=1))
        return sum(map(self.lookup.__getitem__, pre_tokens(text)))


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens without the first of their spaces."""
    if SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [x[1:] for x in PRE_TOKEN.findall(SPACE + text.replace(" ", SPACE))]


def frequent(docs: DataFrame, text: str, per_task: int, table_size: int) -> list[str]:
    """The most frequent pre-tokens of all texts, at most `table_size`.

    Each task tallies its texts, forgets the rarest where its tally grows too long, and hands on its
    `per_task` most frequent; these are added up. A histogram of the sums by powers of two tells from
    which one on they fit the table, so nothing is sorted and only the table comes to the driver.
    """

    def tally(batches):
        import pyarrow as pa

        seen: Tally = Tally()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    seen.update(pre_tokens(t))
                if len(seen) > 64 * per_task:
                    seen = Tally(dict(seen.most_common(16 * per_task)))
        top = [(k, n) for k, n in seen.most_common(per_task) if len(k) <= 64]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    counts = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(tally, "piece string, n long")
    counts = stored(counts.groupBy("piece").agg(F.sum("n").alias("n")))
    power = F.floor(F.log2("n"))
    sizes = dict(counts.groupBy(power.alias("power")).count().collect())  # 64 rows at most
    least, total = None, 0
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > table_size:
            break
        least = k
    some = counts.limit(0) if not sizes else counts.where(power >= least) if least is not None else counts.where(power == max(sizes)).limit(table_size)
    return [r["piece"] for r in some.select("piece").collect()]


def counted(docs: DataFrame, text: str = "text", model: str = "piece_bpe_32k.model", per_task: int = 8_192, table_size: int = 32_768, name: str = "n_tokens") -> DataFrame:
    """Adds the number of tokens; a column of that name gives way to it."""
    spark = docs.sparkSession
    own = [c for c in docs.columns if c.lower() != name.lower()]
    # a text column of that name is read under another, and goes
    hidden = "_" + name if text not in own else None
    docs = docs.select(*[F.col(f"`{c}`") for c in own], *([F.col(f"`{text}`").alias(hidden)] if hidden else []))
    text = hidden or text
    driver = Counter(model)
    table = {} if driver.whole else {k: driver.encoded(k) for k in frequent(docs, text, per_task, table_size)}
    known = spark.sparkContext.broadcast(table)
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields[: len(own)], T.StructField(name, T.LongType())])

    def run(batches):
        import pyarrow as pa

        count = Counter(model, known.value)
        for batch in batches:
            n = pa.array([count(t) for t in batch.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], n], schema.names)

    # by place: mapInArrow looks columns up by names, and those with dots aren't found
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).mapInArrow(run, schema)
