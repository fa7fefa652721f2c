"""Overlap sizes between many large sets, by coordinated identifier sampling.

All sets sample by one hash of the identifier, so a shared identifier is kept
by all of its sets or by none. A set keeps the identifiers whose hash lies
below its threshold 2 ** -level, where the level grows with the set's size.
Rows are cut by the level of their own set while they are read, before any
shuffle; of the other rows, those of an identifier that a smaller set keeps come
back by a semi-join, so a small set is compared in full with a large one. The
overlap of a pair is the number of kept common identifiers below the greater
threshold of the two, scaled by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, small

#: Identifiers that a set keeps at least, once it is larger; up to twice as many are kept whole.
SAMPLE = 256
#: Standard deviations of the confidence interval.
Z = 1.96
#: Sets of one identifier that are paired together; the sets of an identifier with more are paired block by block.
FAN = 64


def hash_level(identifier: Column) -> Column:
    """k if the identifier's hash lies in [2 ** -(k + 1), 2 ** -k) of its range; each level holds half as many."""
    unit = (F.shiftrightunsigned(F.xxhash64(identifier), 11).cast("double") + 0.5) * 2.0**-53
    return F.floor(-F.log2(unit)).cast("int")


def members(rows: DataFrame, name: str, identifier: str) -> DataFrame:
    """(name, id) of a table: names trimmed and in lower case; null names, null and 0 identifiers left out. Narrow; rows may repeat."""
    return rows.select(F.lower(F.trim(name)).alias("name"), F.col(identifier).alias("id")).filter(
        F.col("name").isNotNull() & F.col("id").isNotNull() & (F.col("id") != 0)
    )


def set_levels(sets: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """name, level of every set, from a sketch of its distinct identifiers that is merged per set before it is shuffled."""
    size = sets.groupBy("name").agg(F.approx_count_distinct("id", 0.05).alias("n"))
    return size.select("name", F.greatest(F.lit(0), F.floor(F.log2(F.col("n") / F.lit(float(sample))))).cast("int").alias("level"))


def kept_members(sets: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Distinct (name, id, level, own) that the samples hold: ``own`` below the set's own threshold, else below a smaller set's."""
    rows = sets.join(small(materialize(set_levels(sets, sample), "set-levels")), "name")
    within = hash_level(F.col("id")) >= F.col("level")
    own = materialize(rows.filter(within).select("name", "id", "level").distinct(), "own-members")
    ids = materialize(own.select("id").distinct(), "kept-ids")
    more = rows.filter(~within).join(small(ids), "id", "left_semi").select("name", "id", "level").distinct()
    return own.withColumn("own", F.lit(True)).unionByName(more.withColumn("own", F.lit(False)))


def overlaps(sets: DataFrame, sample: int = SAMPLE, z: float = Z, fan: int = FAN) -> DataFrame:
    """Every pair of sets that share a kept identifier, with the estimate and its confidence interval.

    ``sets`` holds (name, id); repeated rows count once. Columns: name_a <
    name_b, size_a, size_b (exact for sets kept whole, else estimated from the
    sample), kept (common identifiers kept), rate, shared (estimate), low, high.
    A pair with an identifier in common may be missing only where none was
    kept, and then shares far fewer than ``sample`` identifiers. No sets, or
    sets without common identifiers: no rows.

    The shuffles carry some ``sample`` identifiers per set, however large the
    sets are. The sets of an identifier are paired in blocks of ``fan``, so no
    task holds all sets of an identifier that very many have; equal
    memberships are counted together before they are paired.
    """
    kept = materialize(kept_members(sets, sample), "kept-members")
    sizes = materialize(kept.filter("own").groupBy("name").agg((F.count("*") * F.pow(F.lit(2.0), F.first("level"))).cast("bigint").alias("size")), "set-sizes")
    many = materialize(kept.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") > fan), "wide-ids")
    # Block x of the blocks of an identifier meets each block y: as (x, y), or as (x, x) itself.
    blocks = F.coalesce(F.ceil(F.col("n") / fan), F.lit(1)).cast("int")
    rows = kept.join(small(many), "id", "left").withColumn("_n", blocks).withColumn("x", F.pmod(F.xxhash64("name"), F.col("_n")).cast("int"))
    rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    first, last = F.least("x", "y"), F.greatest("x", "y")
    side = (F.col("x") == last) & (first != last)
    memberships = (
        rows.groupBy("id", first.alias("i"), last.alias("j"))
        .agg(F.sort_array(F.collect_list(F.struct("name", "level", side.alias("side")))).alias("of"), F.max("level").alias("top"))
        .filter(F.size("of") > 1)
        # Beyond the greatest level of its sets a hash level makes no difference.
        .select("of", (F.col("i") == F.col("j")).alias("one"), F.least(hash_level(F.col("id")), "top").alias("at"))
        .groupBy("of", "one", "at")
        .agg(F.count("*").alias("n"))
    )
    pair = (
        memberships.select("of", "one", "at", "n", F.posexplode("of").alias("i", "a"))
        .select("one", "at", "n", "a", F.explode(F.slice("of", F.col("i") + 2, F.size("of"))).alias("b"))
        .filter(F.col("one") | (F.col("a.side") != F.col("b.side")))
        .withColumn("level", F.least("a.level", "b.level"))
        .filter(F.col("at") >= F.col("level"))
        .groupBy(F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b"), "level")
        .agg(F.sum("n").alias("kept"))
    )
    rate = F.pow(F.lit(2.0), -F.col("level"))
    spread = z * F.sqrt(F.col("kept") * (1 - F.col("rate"))) / F.col("rate")
    size_of = lambda s: small(sizes.select(F.col("name").alias(f"name_{s}"), F.col("size").alias(f"size_{s}")))
    return (
        pair.withColumn("rate", rate)
        .withColumn("shared", F.col("kept") / F.col("rate"))
        .withColumn("low", F.greatest(F.col("kept").cast("double"), F.col("shared") - spread))
        .withColumn("high", F.col("shared") + spread)
        .join(size_of("a"), "name_a")
        .join(size_of("b"), "name_b")
        .select("name_a", "name_b", "size_a", "size_b", "kept", "rate", "shared", "low", "high")
    )


def heavy_pairs(sets: DataFrame, share: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """Pairs (name_a, name_b) that share at least ``share`` of the smaller set, by estimate.

    Both sides of the comparison come from the same sample, so the error is
    that of a proportion among ``sample`` identifiers or more: 3 % at one half.
    """
    return overlaps(sets, sample).filter(F.col("shared") >= share * F.least("size_a", "size_b")).select("name_a", "name_b")
