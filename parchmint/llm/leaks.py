"""Evaluation texts inside a corpus, by Wu-Manber multi-pattern search over words.

The patterns are all runs of ``m`` words of the test items. A table of blocks (``BLOCK`` neighbouring words) tells how far the
search window may move: a block that no pattern has lets it skip ``m - BLOCK + 1`` words. Blocks that end a pattern have
shift 0; there a bucket of the patterns with that suffix is filtered by their first block and compared directly.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.functions.text import normalize
from parchmint.session import spread

BLOCK = 3
MOST_WORDS = 500_000
PART_WORDS = 50_000


def _tables(items: list[tuple[int, list[str]]], m: int) -> tuple[dict, dict]:
    """(shift by block, {suffix block: {first block: {pattern: items}}})."""
    shift: dict[tuple, int] = {}
    bucket: dict[tuple, dict] = {}
    for item, words in items:
        blocks = list(zip(*(words[i:] for i in range(BLOCK))))
        for start in range(len(words) - m + 1):
            last = m - BLOCK
            for j in range(last + 1):
                b = blocks[start + j]
                if shift.get(b, m) > last - j:
                    shift[b] = last - j
            found = bucket.setdefault(blocks[start + last], {}).setdefault(blocks[start], {})
            found.setdefault(tuple(words[start : start + m]), set()).add(item)
    return shift, bucket


def search(words: list[str], shift: dict, bucket: dict, m: int) -> set:
    """Items of which the words hold a pattern."""
    hits: set = set()
    at, n, far = m - 1, len(words), m - BLOCK + 1
    get = shift.get
    while at < n:
        s = get((words[at - 2], words[at - 1], words[at]), far)
        if s:
            at += s
            continue
        start = at - m + 1
        same = bucket[(words[at - 2], words[at - 1], words[at])].get(tuple(words[start : start + BLOCK]))
        if same:
            items = same.get(tuple(words[start : at + 1]))
            if items:
                hits |= items
        at += 1
    return hits


_BUILT: dict[str, list] = {}


def _parts(rows) -> list[list[tuple]]:
    """The items' pieces in parts of about ``PART_WORDS`` words."""
    parts, size = [[]], 0
    for r in rows:
        if size + len(r.w) > PART_WORDS and parts[-1]:
            parts.append([])
            size = 0
        parts[-1].append((r.i, list(r.w)))
        size += len(r.w)
    return parts


def _scan(parts: list, m: int, name: str):
    def run(batches):
        if name not in _BUILT:  # one set of tables for all tasks of a worker
            _BUILT.clear()
            _BUILT[name] = [_tables(p, m) for p in parts]
        tables = _BUILT[name]
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc"], pdf["t"]):
                words = text.split(" ")
                if len(words) >= m:
                    found: set = set()
                    for shift, bucket in tables:
                        found |= search(words, shift, bucket, m)
                    rows += [(doc, i) for i in found]
            yield pd.DataFrame(rows, columns=["doc", "item"])

    return run


def leaked_items(corpus: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, m: int = 10, most_words: int = MOST_WORDS) -> DataFrame:
    """(key, item_key): the texts that contain ``m`` consecutive words of an item, words in normal form.

    One row per text and item, exact in both directions. Items with fewer words match nothing, null and empty texts
    neither; repeated texts and items each count by their own key. The items are the smaller side: about ``most_words``
    of their words are sent with the tasks of one pass over the corpus, and as many passes are made as they need. A
    worker builds the tables once, in parts of ``PART_WORDS`` words, and searches each text with every part while it is at
    hand. No shuffle of the corpus; with several passes, one of the finds.
    """
    rows = items.where(F.col(item_key).isNotNull()).select(F.col(item_key).alias("i"), F.split(normalize(F.col(item_text)), " ").alias("w")).where(F.size("w") >= m).distinct()
    total = rows.agg(F.sum(F.size("w").cast("bigint"))).first()[0] or 0
    schema = f"doc {dict(corpus.dtypes)[key]}, item {dict(items.dtypes)[item_key]}"
    some = spread(corpus.where(F.length(text) >= 2 * m - 1).select(F.col(key).alias("doc"), F.col(text).alias("t")))
    some = some.select("doc", normalize(F.col("t")).alias("t"))
    passes = max(1, -(-total // most_words))
    # long items go in pieces that overlap by all but one word of a pattern
    cuts = F.sequence(F.lit(0), F.greatest(F.size("w") - m, F.lit(0)), F.lit(PART_WORDS))
    pieces = rows.select("i", F.explode(F.transform(cuts, lambda k: F.slice("w", k + 1, PART_WORDS + m - 1))).alias("w"))
    found = None
    for k in range(passes):
        own = pieces if passes == 1 else pieces.where(F.pmod(F.xxhash64("i", "w"), F.lit(passes)) == k)
        hits = some.mapInPandas(_scan(_parts(own.toLocalIterator()), m, uuid.uuid4().hex), schema)
        found = hits if found is None else found.union(hits)
    found = found if passes == 1 else found.distinct()
    return found.select(F.col("doc").alias(key), F.col("item").alias(item_key))


def p7_found(spark, sf_dir: str) -> DataFrame:
    """(doc_id, item_id): documents that contain ten consecutive words of a test item."""
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/eval_items.parquet")
    return leaked_items(docs, "doc_id", "text", items, "item_id", "text").distinct()


def p7_items(spark, sf_dir: str) -> DataFrame:
    """(item_id, documents): how many documents leak each item."""
    return p7_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"))


# The same by definition, for the SQL engine: windows of ten words of both sides, joined.
_WORDS = "string_split(trim(regexp_replace(replace(replace(replace(lower(strip_accents(text)),'œ','oe'),'æ','ae'),'ß','ss'),'[^\\p{L}\\p{N}]+',' ','g')),' ')"
P7_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT doc_id, array_to_string(w[k:k+9], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS k FROM d WHERE len(w) >= 10)),
iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k+9], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS k FROM i WHERE len(w) >= 10))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (s)
"""
