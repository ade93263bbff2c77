"""Ranked full-text search: AND over terms, prefix and one-typo matches, phrases, weights by field, excerpts.

Two physical forms of one meaning: ``search`` scans documents and never shuffles (a top-k is all that reaches the driver side),
``build_postings`` and ``search_postings`` use a stored inverted index, where edit distance runs once per distinct token.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.functions.text import date_tokens, normalize, normalize_py, tokenize

# Weight of each field, phrase scores, factors of exact, prefix and fuzzy matches.
WEIGHTS = {"title": 6.0, "tags": 5.0, "folder": 3.0, "notes": 2.0, "type": 2.0, "date": 1.5, "content": 1.0}
PHRASE_TITLE, PHRASE_TEXT = 8.0, 4.0
EXACT, PREFIX, FUZZY = 1.0, 0.7, 0.45
YEAR_SECONDS = 365 * 86400


def parse_query(query: str) -> tuple[list[str], list[str]]:
    """(terms, phrases): quoted parts are phrases, the rest words in normal form; a lone quote is ignored."""
    phrases = [p for p in (normalize_py(m) for m in re.findall(r'"([^"]+)"', query)) if p]
    return normalize_py(re.sub(r'"[^"]+"', " ", query)).split(), phrases


def fields(df: DataFrame) -> dict[str, Column]:
    """Token arrays of the searchable fields of id, title, folder_path, tags, notes, content, type, created_at, updated_at."""
    dates = F.concat_ws(" ", date_tokens(F.col("created_at")), date_tokens(F.col("updated_at")))
    text = {"title": F.col("title"), "tags": F.concat_ws(" ", F.col("tags")), "folder": F.col("folder_path"), "notes": F.col("notes"), "type": F.col("type"), "date": dates, "content": F.col("content")}
    return {k: F.array_distinct(tokenize(v)) for k, v in text.items()}


def _token_match(token: Column, term: str, last: bool) -> Column:
    """How far a token stands for a term. Cheap tests come first; null where it doesn't."""
    m = F.when(token == term, EXACT)
    if last and len(term) >= 2:
        m = m.when(token.startswith(term), PREFIX)
    if len(term) >= 5:
        close = (F.abs(F.length(token) - len(term)) <= 1) & (F.substring(token, 1, 1) == term[0])
        m = m.when(close & (F.levenshtein(token, F.lit(term), 1) >= 0), FUZZY)
    return m


def _best(tokens: Column, term: str, last: bool) -> Column:
    """Best match of a term in an array of tokens: 1, 0.7, 0.45 or 0; the costly tests run only where the cheap ones fail."""
    m = F.when(F.array_contains(tokens, term), EXACT)
    if last and len(term) >= 2:
        m = m.when(F.exists(tokens, lambda t: t.startswith(term)), PREFIX)
    if len(term) >= 5:
        m = m.when(F.exists(tokens, lambda t: (F.abs(F.length(t) - len(term)) <= 1) & (F.substring(t, 1, 1) == term[0]) & (F.levenshtein(t, F.lit(term), 1) >= 0)), FUZZY)
    return m.otherwise(0.0)


def _boost(as_of: str) -> Column:
    age = (F.lit(as_of).cast("timestamp").cast("double") - F.col("updated_at").cast("double")) / YEAR_SECONDS
    return F.greatest(F.lit(0.0), F.coalesce(0.5 - age, F.lit(0.0)))


def search(df: DataFrame, query: str, as_of: str, type: str | None = None, since: str | None = None, until: str | None = None, limit: int | None = 100) -> DataFrame:
    """(id, score, fields): the documents that match every term and phrase, best first, ties by id.

    An empty query scores 1. ``type`` wants all its words among the type's; the bounds on ``created_at`` are inclusive.
    ``as_of`` stands for the clock in the boost of recent documents. Null fields hold no tokens.
    """
    terms, phrases = parse_query(query)
    if type:
        want = normalize_py(type).split()
        df = df.where(F.forall(F.array(*[F.lit(w) for w in want]), lambda w: F.array_contains(tokenize(F.col("type")), w)) if want else F.lit(True))
    if since:
        df = df.where(F.col("created_at") >= F.lit(since).cast("timestamp"))
    if until:
        df = df.where(F.col("created_at") <= F.lit(until).cast("timestamp"))
    toks = df.select("id", "title", "notes", "content", "updated_at", *[v.alias(f"t_{k}") for k, v in fields(df).items()])
    for i, term in enumerate(terms):
        toks = toks.withColumns({f"m{i}_{k}": _best(F.col(f"t_{k}"), term, i == len(terms) - 1) for k in WEIGHTS})
        toks = toks.where(reduce(lambda a, b: a | b, [F.col(f"m{i}_{k}") > 0 for k in WEIGHTS]))
    text = {k: F.coalesce(normalize(F.col(k)), F.lit("")) for k in ("title", "notes", "content")}
    for p in phrases:
        toks = toks.where(reduce(lambda a, b: a | b, [F.contains(v, F.lit(p)) for v in text.values()]))
    per_term = [F.greatest(*[F.col(f"m{i}_{k}") * w for k, w in WEIGHTS.items()]) for i in range(len(terms))]
    per_phrase = [F.when(F.contains(text["title"], F.lit(p)), PHRASE_TITLE).otherwise(PHRASE_TEXT) for p in phrases]
    score = reduce(lambda a, b: a + b, per_term + per_phrase, F.lit(0.0 if terms or phrases else 1.0)) + _boost(as_of)
    hit = [F.when(reduce(lambda a, b: a | b, [F.col(f"m{i}_{k}") > 0 for i in range(len(terms))]), F.lit(k)) for k in WEIGHTS] if terms else []
    hit += [F.when(F.contains(text["title"], F.lit(p)), F.lit("title")).otherwise(F.lit("content")) for p in phrases]
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(*hit)))) if hit else F.array().cast("array<string>")
    out = toks.select("id", score.alias("score"), found.alias("fields"))
    return out.orderBy(F.desc("score"), "id").limit(limit) if limit else out


def build_postings(df: DataFrame) -> DataFrame:
    """(id, field, token), distinct: the inverted index. Written by token, it serves any number of queries."""
    each = [F.struct(F.lit(k).alias("field"), v.alias("tokens")) for k, v in fields(df).items()]
    rows = df.select("id", F.explode(F.array(*each)).alias("f"))
    return rows.select("id", "f.field", F.explode("f.tokens").alias("token"))


def search_postings(postings: DataFrame, query: str) -> DataFrame:
    """(id, score, fields) of documents that match every term, by the index; terms only, without boost.

    Terms are a few literals, so matching is a narrow filter that reaches the scan; the matches of one document meet in one
    aggregation. A term given twice counts twice, and only the last one may match as a prefix.
    """
    terms, _ = parse_query(query)
    if not terms:
        raise ValueError("a search in the index needs a term")
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[F.col("field")]
    each = F.array(*[F.struct(F.lit(i).alias("term"), _token_match(F.col("token"), t, i == len(terms) - 1).alias("m")) for i, t in enumerate(terms)])
    rows = postings.select("id", "field", F.explode(F.filter(each, lambda x: x["m"].isNotNull())).alias("x"), weight.alias("w"))
    best = rows.groupBy("id", "x.term").agg(F.max(F.col("x.m") * F.col("w")).alias("best"), F.collect_set("field").alias("fs"))
    return best.groupBy("id").agg(F.count("*").alias("n"), F.sum("best").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("fs")))).alias("fields")).where(F.col("n") == len(terms)).drop("n")


def make_snippet(content: str, needles: list[str], radius: int = 70) -> tuple[str, list[tuple[int, int]]]:
    """(excerpt, highlighted ranges) around the first needle; every character that is neither letter nor digit counts as one space."""
    if not content:
        return "", []
    folded, origin = [], []
    for i, c in enumerate(content):
        for x in normalize_py(c) or " ":
            folded.append(x)
            origin.append(i)
    text = "".join(folded)
    places = [(p, len(n)) for n in needles if n and (p := text.find(n)) >= 0]
    at, size = min(places, key=lambda x: x[0], default=(-1, 0))
    middle = origin[at] if at >= 0 else 0
    start, end = max(0, middle - radius), min(len(content), middle + size + radius)
    shown = ("… " if start else "") + re.sub(r"\s+", " ", content[start:end]).strip() + (" …" if end < len(content) else "")
    plain = "".join((normalize_py(c) or " ")[0] for c in shown)
    marks = []
    for n in filter(None, needles):
        i = plain.find(n)
        while i >= 0:
            marks.append((i, i + len(n)))
            i = plain.find(n, i + len(n))
    return shown, sorted(marks, key=lambda m: m[0])


def with_snippets(hits: DataFrame, docs: DataFrame, query: str) -> DataFrame:
    """Hits with ``snippet`` and ``highlights``; made after the limit, since excerpts don't change the order."""
    terms, phrases = parse_query(query)

    @F.pandas_udf("struct<snippet string, highlights array<array<int>>>")
    def cut(content: pd.Series) -> pd.DataFrame:
        out = [make_snippet(c or "", terms + phrases) for c in content]
        return pd.DataFrame({"snippet": [s for s, _ in out], "highlights": [[list(m) for m in h] for _, h in out]})

    joined = hits.join(docs.select("id", "content"), "id")
    return joined.withColumn("_s", cut(F.col("content"))).select(*hits.columns, "_s.snippet", "_s.highlights")


def without_overlaps(ranges: Column) -> Column:
    """Sorted highlight ranges (start, end) without those that begin inside one kept before."""
    empty = F.array().cast("array<array<int>>")
    return F.aggregate(F.array_sort(ranges), empty, lambda acc, r: F.when((F.size(acc) == 0) | (r[0] >= F.try_element_at(acc, F.lit(-1))[1]), F.concat(acc, F.array(r))).otherwise(acc))
