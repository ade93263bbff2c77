"""Groups of near-duplicate records by a Chosen-Path set similarity join.

Every record is a set of word sequences, embedded as ``COORDINATES`` minwise values. A tree starts with all records in one
node; a node picks each coordinate with probability 1 / (threshold x coordinates) and hands each of its records to
one child per picked coordinate, named by the record's minwise value there. Nodes of at most ``LEAF`` records are
compared exhaustively on sketches, larger ones branch again; independent trees repeat this until the wanted recall
is reached. Pairs that pass the sketches are verified on the full sets. Which coordinates a node picks depends on
its name alone, so a record finds its children without seeing the rest of the node, and a level is one count per node.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.functions.text import tokenize
from parchmint.operators.components import connected_components
from parchmint.operators.current import current_rows
from parchmint.session import cut_lineage

COORDINATES = 64
LEAF = 96
FIRST_DEPTH = 2
MOST_DEPTH = 9
PIVOTS = 8
BLOCK = 256
RECALL = 0.97

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: Column, n: int = 5) -> Column:
    """Distinct hashes (64 bits) of the sequences of ``n`` words; fewer words give an empty array."""
    count = F.size(words) - n
    at = F.when(count >= 0, F.sequence(F.lit(0), F.greatest(count, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)])))


def _signatures(batches):
    """Minwise values: for each coordinate the upper 32 bits of the least mixed hash of the set."""
    seeds = _mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * _MIX)
    with np.errstate(over="ignore"):
        for pdf in batches:
            out = []
            for arr in pdf["sh"]:
                h = np.asarray(arr, dtype=np.int64).view(np.uint64)
                low = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
                for i in range(0, len(h), 4096):
                    part = (h[i : i + 4096, None] ^ seeds[None, :]) * _MIX
                    part ^= part >> np.uint64(29)
                    low = np.minimum(low, (part * np.uint64(0xBF58476D1CE4E5B9)).min(axis=0))
                out.append((low >> np.uint64(32)).astype(np.uint32).tobytes())
            yield pd.DataFrame({"cls": pdf["cls"], "sig": out})


def _children(nodes: np.ndarray, rows: np.ndarray, sig: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) for all coordinates that the nodes pick."""
    bound = np.uint64(int(2**64 / (threshold * COORDINATES)))
    at_node, at_child = [], []
    with np.errstate(over="ignore"):
        for i in range(COORDINATES):
            picked = _mix(nodes ^ (np.uint64(i + 1) * _MIX))
            hit = np.flatnonzero(picked < bound)
            if len(hit):
                at_node.append(rows[hit])
                at_child.append(_mix(picked[hit] + (sig[rows[hit], i].astype(np.uint64) + np.uint64(1)) * _MIX))
    if not at_node:
        return rows[:0], nodes[:0]
    return np.concatenate(at_node), np.concatenate(at_child)


def _matrix(sigs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), dtype=np.uint32).reshape(len(sigs), COORDINATES)


def recall_at(threshold: float, depth: int, trees: int) -> float:
    """The chance that a pair with similarity ``threshold`` passes the sketches and shares a node at ``depth`` in some tree.

    Of the k coordinates in which a pair agrees, each node picks every one alike: a branching process for each k.
    """
    pick, least, total = min(1.0, 1 / (threshold * COORDINATES)), max(0, _agreement(threshold)), 0.0
    for k in range(least, COORDINATES + 1):
        lost = 0.0
        for _ in range(depth):
            lost = (1 - pick + pick * lost) ** k
        total += comb(COORDINATES, k) * threshold**k * (1 - threshold) ** (COORDINATES - k) * (1 - lost**trees)
    return total


def trees_for(threshold: float, depth: int) -> int:
    """The least number of trees with a recall of ``RECALL`` at ``depth``, or near what any number has at very low thresholds."""
    aim, trees = min(RECALL, 0.99 * recall_at(threshold, depth, 10_000)), 1
    while recall_at(threshold, depth, trees) < aim:
        trees += 1
    return trees


def _plant(threshold: float, first: int, trees: int, depth: int):
    """The nodes of the trees from number ``first`` on to ``trees`` at ``depth``."""

    def run(batches):
        roots = _mix(np.arange(first + 1, trees + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        for pdf in batches:
            sig = _matrix(pdf["sig"])
            sketch = sig.astype(np.uint8)
            rows = np.repeat(np.arange(len(pdf)), trees - first)
            nodes = np.tile(roots, len(pdf))
            for _ in range(depth):
                rows, nodes = _children(nodes, rows, sig, threshold)
            yield pd.DataFrame({"node": nodes.view(np.int64), "cls": pdf["cls"].to_numpy()[rows], "sk": [sketch[r].tobytes() for r in rows]})

    return run


def _grow(threshold: float):
    def run(batches):
        for pdf in batches:
            sig = _matrix(pdf["sig"])
            rows, nodes = _children(pdf["node"].to_numpy().view(np.uint64), np.arange(len(pdf)), sig, threshold)
            sketch = sig.astype(np.uint8)
            yield pd.DataFrame({"node": nodes.view(np.int64), "cls": pdf["cls"].to_numpy()[rows], "sk": [sketch[r].tobytes() for r in rows]})

    return run


def _agreement(threshold: float) -> int:
    """Equal sketch bytes that a pair at the threshold misses with a chance of about 1 in 1000 (3.1 deviations)."""
    return int(np.floor(COORDINATES * threshold - 3.1 * np.sqrt(COORDINATES * threshold * (1 - threshold))))


def _compare_leaves(least: int):
    """All pairs inside each node of rows sorted by node: row i against row i+1, i+2, ... while the node is the same."""

    def pairs(node, cls, sk):
        for step in range(1, len(node)):
            at = np.flatnonzero(node[:-step] == node[step:])
            if not len(at):
                return
            good = at[(sk[at] == sk[at + step]).sum(axis=1) >= least]
            if len(good):
                a, b = cls[good], cls[good + step]
                keep = a != b
                if keep.any():
                    yield pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep]}).drop_duplicates()

    def run(batches):
        rest = None
        for pdf in batches:
            if rest is not None:
                pdf = pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            node = pdf["node"].to_numpy()
            cut = int(np.searchsorted(node, node[-1]))  # the last node may go on in the next batch
            rest, pdf = pdf.iloc[cut:], pdf.iloc[:cut]
            if len(pdf):
                yield from pairs(node[:cut], pdf["cls"].to_numpy(), np.frombuffer(b"".join(pdf["sk"]), dtype=np.uint8).reshape(-1, COORDINATES))
        if rest is not None and len(rest):
            yield from pairs(rest["node"].to_numpy(), rest["cls"].to_numpy(), np.frombuffer(b"".join(rest["sk"]), dtype=np.uint8).reshape(-1, COORDINATES))

    return run


def _compare_sides(least: int):
    def run(batches):
        for pdf in batches:
            x = np.frombuffer(b"".join(pdf["sk"]), dtype=np.uint8).reshape(-1, COORDINATES)
            y = np.frombuffer(b"".join(pdf["sk2"]), dtype=np.uint8).reshape(-1, COORDINATES)
            ok = ((x == y).sum(axis=1) >= least) & (pdf["cls"] != pdf["cls2"]).to_numpy()
            a, b = pdf["cls"].to_numpy()[ok], pdf["cls2"].to_numpy()[ok]
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    return run


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sets really have that similarity."""
    pairs = pairs.distinct()
    x, y = sets.select(F.col("cls").alias("a"), F.col("sh").alias("sa")), sets.select(F.col("cls").alias("b"), F.col("sh").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(x, "a").join(y, "b").where(both >= threshold * (F.size("sa") + F.size("sb") - both) - 1e-9).select("a", "b")


def _inside(rows: DataFrame, links: DataFrame, least: int) -> DataFrame:
    """All pairs of ``rows`` inside each component of ``links`` that pass the sketches, by pairs of blocks.

    A component's records are dealt to blocks of about ``BLOCK``; two blocks at a time meet, so no task holds more.
    """
    some = rows.select("cls", "sk").distinct().join(connected_components(links, "a", "b").select(F.col("vertex").alias("cls"), "component"), "cls")
    sizes = some.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = some.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks").cast("bigint")).cast("int"))
    dealt = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    node = F.xxhash64("component", F.least("own", "k"), F.greatest("own", "k")).alias("node")
    return dealt.select(node, "cls", "sk").repartition("node").sortWithinPartitions("node").mapInPandas(_compare_leaves(least), "a bigint, b bigint")


def _hot_nodes(rows: DataFrame, sets: DataFrame, links: DataFrame, threshold: float, least: int, every: bool) -> DataFrame:
    """Links inside nodes that stay large at the last level: many records alike each other.

    All records are compared with a few pivots of their node; what these links and the earlier ones leave outside the
    node's largest component is then compared with every record of the node, in blocks. Pairs inside one component can't
    change it, so the components are whole by then; with ``every``, they are compared too, so that all links are found.
    """
    rank = F.xxhash64("cls", "node")
    pivots = rows.groupBy("node", F.pmod(rank, F.lit(PIVOTS)).alias("slot")).agg(F.min(F.struct(rank.alias("r"), "cls", "sk")).alias("p"))
    pivots = pivots.select("node", F.col("p.cls").alias("cls2"), F.col("p.sk").alias("sk2"))
    near = _verified(rows.join(pivots, "node").select("cls", "sk", "cls2", "sk2").mapInPandas(_compare_sides(least), "a bigint, b bigint"), sets, threshold)
    known = cut_lineage(links.union(near).distinct())
    label = connected_components(known, "a", "b")
    named = rows.join(label, rows["cls"] == label["vertex"], "left").select("node", "cls", "sk", F.coalesce("component", "cls").alias("comp"))
    named = cut_lineage(named)
    main = named.groupBy("node", "comp").count().groupBy("node").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
    rest = named.join(main, "node").where("comp <> main")
    blocks = named.groupBy("node").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    grid = rest.join(blocks, "node").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    other = named.join(blocks, "node").withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("blocks").cast("bigint")).cast("int")).select("node", "salt", F.col("cls").alias("cls2"), F.col("sk").alias("sk2"), F.col("comp").alias("comp2"))
    met = grid.join(other, ["node", "salt"]).where("comp <> comp2").select("cls", "sk", "cls2", "sk2")
    known = known.union(_verified(met.mapInPandas(_compare_sides(least), "a bigint, b bigint"), sets, threshold))
    if not every:
        return known
    known = cut_lineage(known.distinct())
    return known.union(_verified(_inside(rows, known, least), sets, threshold))


def chosen_path_links(sets: DataFrame, threshold: float = 0.8, trees: int = 12, every: bool = True) -> DataFrame:
    """Links (a, b), a < b, between records (``cls`` bigint, ``sh`` array of hashes) with at least that Jaccard similarity.

    No link is reported that isn't one. Each level loses some pairs, so trees are added to the first ``trees`` until the
    deepest level that nodes reach has a recall of ``RECALL`` for single pairs at the threshold itself (``trees_for``).
    Empty sets have no links. Without ``every``, links are left out that join records which other links join already.
    """
    least = _agreement(threshold)
    sigs = cut_lineage(sets.where(F.size("sh") > 0).mapInPandas(_signatures, "cls bigint, sig binary"))
    found, hot, planted = None, None, 0
    while planted < trees:
        met, big, depth = _walk(sigs, threshold, least, planted, trees)
        found = met if found is None else cut_lineage(found.union(met).distinct())
        if big is not None:
            hot = big if hot is None else hot.union(big)
        planted, trees = trees, max(trees, trees_for(threshold, depth))
    links = cut_lineage(_verified(found, sets, threshold))
    return links if hot is None else _hot_nodes(hot.distinct(), sets, links, threshold, least, every).distinct()


def _walk(sigs: DataFrame, threshold: float, least: int, first: int, trees: int) -> tuple[DataFrame, DataFrame | None, int]:
    """(pairs that meet in leaves of the trees from ``first`` on to ``trees``, rows of nodes that stay large, depth reached)."""
    schema = "node bigint, cls bigint, sk binary"
    rows = sigs.mapInPandas(_plant(threshold, first, trees, FIRST_DEPTH), schema)
    found = None
    for depth in range(FIRST_DEPTH, MOST_DEPTH + 1):
        sizes = rows.groupBy("node").count().where("count > 1")
        sized = cut_lineage(rows.join(sizes, "node"))
        leaves = sized.where(F.col("count") <= LEAF).select("node", "cls", "sk").repartition("node").sortWithinPartitions("node")
        met = leaves.mapInPandas(_compare_leaves(least), "a bigint, b bigint").distinct()
        found = cut_lineage(met if found is None else found.union(met))
        big = sized.where(F.col("count") > LEAF).select("node", "cls", "sk")
        if big.isEmpty():
            return found, None, depth
        if depth < MOST_DEPTH:
            rows = big.select("node", "cls").join(sigs, "cls").mapInPandas(_grow(threshold), schema)
    return found, big, MOST_DEPTH


def class_id(sets: Column) -> Column:
    """The name of a set; ``_apart`` renames the few sets that share one with another."""
    return F.xxhash64(sets)


def _apart(sets: DataFrame) -> DataFrame:
    """``sets`` with another ``cls`` for different sets of the same one, told by their second hash ``proof``.

    Among 10 billion sets two or three pairs are to be expected, so the list of such names is short.
    """
    shared = sets.groupBy("cls").agg(F.min("proof").alias("first"), F.max("proof").alias("last")).where("first <> last").select("cls", "first")
    if shared.isEmpty():
        return sets
    renamed = F.when(F.col("first").isNotNull() & (F.col("proof") != F.col("first")), F.xxhash64(F.lit(2), "cls", "proof")).otherwise(F.col("cls"))
    return cut_lineage(sets.join(shared, "cls", "left").withColumn("cls", renamed).drop("first"))


def near_duplicate_groups(df: DataFrame, key: str, words: Column, n: int = 5, threshold: float = 0.8, least_words: int = 20, trees: int = 12, degrees: bool = True) -> DataFrame:
    """(key, group_key, copies, links): one row per record that is alike another one.

    Records with fewer than ``least_words`` words, or without a key, are alike none. Records with equal sets are one class,
    joined once and named back at the end, so many copies cost no comparisons. ``group_key`` is the smallest key of the
    group in byte order, ``copies`` counts the class, ``links`` the other classes it is alike (left out without ``degrees``,
    which spares the comparisons inside groups of many records). Empty input gives no rows.
    """
    w = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), words.alias("w")).where(F.size("w") >= max(least_words, n))
    sets = w.select("key", F.array_sort(shingles(F.col("w"), n)).alias("sh")).withColumn("cls", class_id(F.col("sh"))).withColumn("proof", F.xxhash64(F.lit(1), "sh"))
    sets = _apart(cut_lineage(sets))
    members = sets.select("key", "cls")
    once = sets.groupBy("cls").agg(F.first("sh").alias("sh"))
    links = cut_lineage(chosen_path_links(once, threshold, trees, degrees))
    label = connected_components(links, "a", "b")
    degree = links.select(F.col("a").alias("cls")).union(links.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("links"))
    copies = members.groupBy("cls").agg(F.count("*").alias("copies"))
    named = (
        members.join(copies, "cls")
        .join(label.select(F.col("vertex").alias("cls"), F.col("component").alias("comp")), "cls", "left")
        .join(degree, "cls", "left")
        .where("comp is not null or copies > 1")
        .select("key", F.coalesce("comp", "cls").alias("comp"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    )
    first = named.groupBy("comp").agg(F.min("key").alias("group_key"))
    return named.join(first, "comp").select(F.col("key").alias(key), "group_key", "copies", *(["links"] if degrees else []))


def search_record_groups(search_docs: DataFrame, degrees: bool = True) -> DataFrame:
    """Groups of the current search records: three-word sequences, 60 % in common, at least 20 words."""
    now = current_rows(search_docs, "id", "updated_at", ["title", "content"])
    words = tokenize(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))))
    return near_duplicate_groups(now, "id", words, n=3, threshold=0.6, degrees=degrees)


def p1_found(spark, sf_dir: str) -> DataFrame:
    """(id_a, id_b): all pairs of one group, smaller id first, as the stated result demands."""
    g = search_record_groups(spark.read.parquet(f"{sf_dir}/search_docs.parquet"), degrees=False).select("id", "group_key")
    a, b = g.select(F.col("id").alias("id_a"), "group_key"), g.select(F.col("id").alias("id_b"), "group_key")
    return a.join(b, "group_key").where("id_a < id_b").select("id_a", "id_b")


def p1_groups(spark, sf_dir: str) -> DataFrame:
    """One row per grouped record with its group, number of copies and links."""
    return search_record_groups(spark.read.parquet(f"{sf_dir}/search_docs.parquet"))


# The same by definition, for the SQL engine: all pairs that share a sequence are counted, links closed recursively.
_WORDS = "string_split(trim(regexp_replace(replace(replace(replace(lower(strip_accents(coalesce(title,'') || ' ' || coalesce(content,''))),'œ','oe'),'æ','ae'),'ß','ss'),'[^\\p{L}\\p{N}]+',' ','g')),' ')"
P1_SQL = f"""
WITH RECURSIVE cur AS (SELECT * FROM (SELECT DISTINCT id, title, content, updated_at FROM search_docs) QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, title DESC NULLS LAST, content DESC NULLS LAST) = 1),
w AS (SELECT id, {_WORDS} AS w FROM cur),
sh AS (SELECT DISTINCT id, array_to_string(w[k:k+2], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS k FROM w WHERE len(w) >= 20)),
n AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
shared AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c >= 0.6 * (x.n + y.n - c) - 1e-9),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM ways UNION SELECT r.a, l.b FROM reach r JOIN ways l ON l.a = r.b)
SELECT a AS id_a, b AS id_b FROM reach WHERE a < b
"""
