"""Filling fixed-capacity containers by bounded-space online best-fit.

Items come one by one; a fixed number of bins is open. An item goes to the open bin with the least free space that still
takes it; the open bins stand in a bitset keyed by free space, so that bin is the lowest set bit from the item's size
on. Where none takes it a new bin opens, and if too many are open the fullest closes first. Items above the capacity are
cut into full bins and a rest, which is packed like any other item.
"""

from __future__ import annotations

import base64

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.session import spread

CAPACITY = 2048
OPEN_BINS = 64
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
ITEMS_PER_TASK = 50_000

# Fixed value: the split pattern of the public byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODING: dict = {}


def encoding(path: str):
    """The tokenizer of a rank file, kept for the life of the worker."""
    if path not in _ENCODING:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODING[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODING[path]


class BestFit:
    """The bins of one stream of items."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.bits, self.by_free, self.count, self.next = 0, {}, 0, 0

    def _take(self, free: int) -> int:
        ids = self.by_free[free]
        b = ids.pop()
        if not ids:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.count -= 1
        return b

    def _leave(self, b: int, free: int) -> None:
        if free:
            self.by_free.setdefault(free, []).append(b)
            self.bits |= 1 << free
            self.count += 1

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset inside it) of an item of 0 < size <= capacity."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = self._take(free)
            self._leave(b, free - size)
            return b, self.capacity - free
        if self.count >= self.most:
            self._take((self.bits & -self.bits).bit_length() - 1)
        b, self.next = self.next, self.next + 1
        self._leave(b, self.capacity - size)
        return b, 0


def cut(size: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of an item: one, unless it exceeds the capacity."""
    return [(s, min(capacity, size - s)) for s in range(0, size, capacity)]


def _count_tokens(path: str):
    def run(batches):
        e = encoding(path)
        for pdf in batches:
            yield pd.DataFrame({"item": pdf["item"], "size": [len(e.encode_ordinary(t)) for t in pdf["t"]]})

    return run


def _pack(capacity: int, open_bins: int):
    def run(batches):
        task = TaskContext.get().partitionId()
        fit = BestFit(capacity, open_bins)
        for pdf in batches:
            rows = []
            for item, size in zip(pdf["item"], pdf["size"]):
                for part, (start, n) in enumerate(cut(int(size), capacity)):
                    b, at = fit.place(n)
                    rows.append((item, part, start, n, (task << 40) + b, at))
            yield pd.DataFrame(rows, columns=["item", "part", "start_token", "n_tokens", "bin_id", "bin_offset"])

    return run


def token_sizes(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(item, size) in tokens; null and empty texts have no row, since they fill nothing."""
    some = spread(df.where(F.length(text) > 0).select(F.col(key).alias("item"), F.col(text).alias("t")))
    return some.mapInPandas(_count_tokens(tokenizer), f"item {dict(df.dtypes)[key]}, size bigint")


def pack(sizes: DataFrame, tasks: int, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """(item, part, start_token, n_tokens, bin_id, bin_offset): where each item, or piece of one, goes.

    ``tasks`` streams are packed apart; only ids and sizes are shuffled, by a hash of id and size, so no stream is hot.
    Each stream leaves at most ``open_bins`` bins partly empty at its end. Streams are sorted, so a task that runs
    again gives the same bins. Repeated items are packed as often as they come.
    """
    streams = sizes.where("size > 0").repartition(max(1, tasks), F.xxhash64("item", "size")).sortWithinPartitions("item", "size")
    kind = dict(sizes.dtypes)["item"]
    return streams.mapInPandas(_pack(capacity, open_bins), f"item {kind}, part int, start_token bigint, n_tokens bigint, bin_id bigint, bin_offset bigint")


def pack_texts(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, tokenizer: str = TOKENIZER) -> DataFrame:
    """Token sizes and packing in one; a stream holds about ``ITEMS_PER_TASK`` items."""
    return pack(token_sizes(df, key, text, tokenizer), -(-df.count() // ITEMS_PER_TASK), capacity, open_bins)


def p6_packed(spark, sf_dir: str) -> DataFrame:
    """(doc_id, part, start_token, n_tokens, bin_id, bin_offset) for all documents."""
    return pack_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text").withColumnRenamed("item", "doc_id")


def p6_fill(spark, sf_dir: str) -> DataFrame:
    """(bins, tokens, fill): bins used and the share of them that holds tokens."""
    bins = p6_packed(spark, sf_dir).groupBy("bin_id").agg(F.sum("n_tokens").alias("n"))
    return bins.agg(F.count("*").alias("bins"), F.sum("n").alias("tokens"), (F.sum("n") / (F.count("*") * CAPACITY)).alias("fill"))
