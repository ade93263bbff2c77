"""Near-equal 64-bit hashes by bands that differ in one bit at most, and groups around anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.session import cut_lineage


def difference_hash(values: Column) -> Column:
    """One bit for each neighbouring pair of an array of at most 65 numbers: is the left one greater? The first pair is the lowest bit."""
    n = F.size(values)
    return F.aggregate(F.sequence(F.lit(0), n - 2), F.lit(0).cast("bigint"), lambda h, i: h.bitwiseOR(F.when(F.get(values, i) > F.get(values, i + 1), F.call_function("shiftleft", F.lit(1).cast("bigint"), i.cast("int"))).otherwise(F.lit(0).cast("bigint"))))


def hex_to_hash(text: Column) -> Column:
    """The bits of 16 hexadecimal digits."""
    return F.conv(text, 16, -10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_hashes(df: DataFrame, id: str, hash: str, most: int = 5) -> DataFrame:
    """(id_a, id_b, distance) of different ids whose hashes differ in at most ``most`` of 64 bits.

    Of 1 + most // 2 bands one must differ in a single bit at most, so the bands of one side meet those of the other
    with each bit turned once. Equal hashes are joined once as a class and their ids named afterwards, so a band never
    holds more than the distinct hashes. Null hashes have no pairs.
    """
    rows = df.where(F.col(hash).isNotNull() & F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(hash).alias("h"))
    near = near_classes(rows.select("h").distinct(), most)
    both = near.union(near.select(F.col("hb").alias("ha"), F.col("ha").alias("hb"), "distance")).union(rows.select(F.col("h").alias("ha"), F.col("h").alias("hb"), F.lit(0).alias("distance")).distinct())
    a, b = rows.select(F.col("id").alias("id_a"), F.col("h").alias("ha")), rows.select(F.col("id").alias("id_b"), F.col("h").alias("hb"))
    return a.join(both, "ha").join(b, "hb").where("id_a < id_b").select("id_a", "id_b", "distance")


def near_classes(hashes: DataFrame, most: int) -> DataFrame:
    """(ha, hb, distance) of the distinct hashes ``h``, ha < hb."""
    bands = 1 + most // 2
    cuts = [round(64 * k / bands) for k in range(bands + 1)]
    band = [(k, F.call_function("shiftrightunsigned", F.col("h"), F.lit(a)).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1)), b - a) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    own = F.array(*[F.struct(F.lit(k).alias("band"), bits.alias("bits")) for k, bits, _ in band])
    turned = F.array(*[F.struct(F.lit(k).alias("band"), bits.bitwiseXOR(F.lit((1 << i) if i < 63 else -(1 << 63)) if i >= 0 else F.lit(0)).alias("bits")) for k, bits, n in band for i in range(-1, n)])
    keyed = lambda keys, name: hashes.select(F.col("h").alias(name), F.explode(keys).alias("k")).select(name, "k.band", "k.bits")
    met = keyed(own, "ha").join(keyed(turned, "hb"), ["band", "bits"]).where(F.col("ha") < F.col("hb")).select("ha", "hb").distinct()
    return met.withColumn("distance", hamming(F.col("ha"), F.col("hb"))).where(F.col("distance") <= most)


def anchor_groups(pages: DataFrame, order: str, most: int = 5) -> DataFrame:
    """(page_id, anchor): greedy groups in the given order; a page joins the first anchor that is near and whose text begins alike.

    Not transitive, so the order decides. Texts begin alike if the first 200 characters are equal or one has none. Pages
    that are blank or have no hash are left out; ties of the order go by page_id. Pages of equal hash and beginning are
    one class, which stands where its first page stands. Classes are settled in rounds: one with no undecided earlier
    neighbour is an anchor or belongs to its earliest anchor. As many rounds as the longest chain of decisions has steps.
    """
    head = F.substring(F.trim(F.coalesce("text", F.lit(""))), 1, 200)
    some = pages.where(F.col("h").isNotNull() & ~F.coalesce(F.col("blank"), F.lit(False))).select("page_id", F.col("h").cast("bigint").alias("h"), head.alias("head"), F.col(order).alias("o"))
    some = cut_lineage(some)
    classes = some.groupBy("h", "head").agg(F.min(F.struct("o", "page_id")).alias("at"))
    near = near_classes(some.select("h").distinct(), most).select("ha", "hb")
    near = near.union(near.select(F.col("hb").alias("ha"), F.col("ha").alias("hb"))).union(some.select(F.col("h").alias("ha"), F.col("h").alias("hb")).distinct())
    mine = classes.select(F.col("h").alias("ha"), "head", F.col("at").alias("a"))
    other = classes.select(F.col("h").alias("hb"), F.col("head").alias("head_b"), F.col("at").alias("b"))
    # equal beginnings meet by key; a class without text meets all classes of its near hashes
    reach = mine.join(near, "ha")
    alike = reach.join(other.withColumn("head", F.col("head_b")), ["hb", "head"]).select("a", "b")
    bare = reach.where("head <> ''").join(other.where("head_b = ''"), "hb").select("a", "b")
    edges = alike.union(bare).union(bare.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("b < a")
    edges = cut_lineage(edges)  # from each class to the earlier ones near it
    state = cut_lineage(classes.select("at", F.lit(None).cast("string").alias("anchor")))
    while not state.where("anchor is null").isEmpty():
        open_ = state.where("anchor is null").select(F.col("at").alias("a"))
        before = edges.join(open_, "a", "left_semi").join(state.select(F.col("at").alias("b"), "anchor"), "b")
        # the earliest neighbour that is an anchor holds once all neighbours before it are settled
        first = before.groupBy("a").agg(F.min(F.when(F.col("anchor") == F.col("b.page_id"), F.col("b"))).alias("won"), F.min(F.when(F.col("anchor").isNull(), F.col("b"))).alias("wait"))
        told = state.join(first, state["at"] == first["a"], "left")
        mine_now = F.when(F.col("won").isNotNull() & (F.col("wait").isNull() | (F.col("won") < F.col("wait"))), F.col("won.page_id")).when(F.col("won").isNull() & F.col("wait").isNull(), F.col("at.page_id"))
        state = cut_lineage(told.select("at", F.coalesce("anchor", mine_now).alias("anchor")))
    named = classes.join(state, "at").select("h", "head", "anchor")
    return some.join(named, ["h", "head"]).select("page_id", "anchor")
