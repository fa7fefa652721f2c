"""Consolidating pairwise matches into groups by hash-to-min.

Every vertex holds a cluster set, at first its neighbours and itself. In each
round it sends the set to the set's least member, and that member to all
others; it goes on with the union of what it received. In the end the least
vertex of each group holds the group, every other vertex only the least one.

"Least" is by a mixed identifier, not by the identifier itself: on a chain that
is in order, sets would double until every vertex holds half of the chain, while
on an order like a random one all sets together stay within a small multiple of
the pairs (measured: 7 times for chains, 8 for stars, 14 for random pairs). The
mix is a bijection, undone at the end, where each group gets its least identifier.

The sets are kept as rows (v, u), never as one array per vertex, so a group
that holds a third of all records is spread over many tasks. A round is one
aggregation by v, pre-aggregated, a join by v with its written result, and a
distinct. As no aggregate stands between the shuffle and the join, adaptive
execution sees a hot vertex there and splits it.

The rounds run on two levels: first on the pairs of each partition alone, as a
combiner before anything is shuffled by vertex, then on what the partitions
leave. Identifiers that lie close together are mostly linked closely, so the
pairs are range-partitioned, and few, short chains are left for the second.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Materialized, materialize, small

#: Rounds after which the loop gives up; hash-to-min needs about twice the logarithm of the longest chain.
MAX_ROUNDS = 100
#: Rounds after which groups that are done are taken out again.
SETTLE_EVERY = 4
#: Pairs that the first level takes together; its sets hold some 14 times as many rows.
CHUNK_PAIRS = 1 << 17

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_HALF = np.uint64(32)


def mixed(ids: np.ndarray) -> np.ndarray:
    """Identifiers in an order like a random one; different ones stay different."""
    x = ids.astype(np.int64).view(np.uint64) * _ODD
    x = (x ^ (x >> _HALF)) * _ODD
    return (x ^ (x >> _HALF)).view(np.int64)


def unmixed(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64)
    x = (x ^ (x >> _HALF)) * _ODD_INVERSE
    return ((x ^ (x >> _HALF)) * _ODD_INVERSE).view(np.int64)


def local_rounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash-to-min on the pairs (a, b) alone, until stable: each vertex but the least of its group, and the least."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    n = len(ids)
    a, b = at[: len(a)], at[len(a) :]
    rows = np.unique(np.concatenate([a * n + b, b * n + a]))  # v * n + u, sorted by v and u
    while True:
        v, u = np.divmod(rows, n)
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        own = v[first]
        least = np.minimum(own, u[first])
        to = np.repeat(least, np.diff(np.append(first, len(v))))
        sent, led = u != to, own != least
        to, u, least, own = to[sent], u[sent], least[led], own[led]
        then = np.unique(np.concatenate([to * n + u, u * n + to, least * n + own, own * n + least]))
        if np.array_equal(then, rows):
            v, u = np.divmod(rows, n)
            return ids[v[u < v]], ids[u[u < v]]
        rows = then


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mix the identifiers and run the rounds of each chunk of pairs."""
    held: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        v, u = local_rounds(*(mixed(pa.chunked_array([b.column(i) for b in held]).to_numpy()) for i in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(v), pa.array(u)], names=["v", "u"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK_PAIRS:
            yield out()
            held = []
    if held:
        yield out()


def _unmix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id of every member beside the mixed leader of its group."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(unmixed(batch.column(0).to_numpy())), batch.column(1)], names=["id", "lead"])


def _state(rows: DataFrame) -> tuple[int, int]:
    """Number and additive hash of the rows: equal states are equal sets."""
    r = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return r["n"], int(r["h"])


def settled_leaders(rows: DataFrame) -> DataFrame:
    """The least vertices of the groups that are done: id.

    A group is done if its rows are exactly those between its least vertex and
    each other member, in both directions, and no other row names a member.
    Then no later round changes it, and it needs no part in them. Sets are
    compared by their size and an additive hash.
    """
    sides = F.explode(
        F.array(F.struct(F.col("v").alias("id"), F.col("u").alias("o"), F.lit(1).alias("out")), F.struct(F.col("u").alias("id"), F.col("v").alias("o"), F.lit(0).alias("out")))
    ).alias("s")
    hashed = F.xxhash64("o").cast("decimal(38,0)")
    per_id = rows.select(sides).select("s.*").groupBy("id").agg(
        F.sum("out").alias("n_out"), F.sum(1 - F.col("out")).alias("n_in"), F.min("o").alias("least"), F.sum(hashed * (2 * F.col("out") - 1)).alias("differ")
    )
    even = per_id.filter("n_out = n_in and differ = 0")
    leaves = even.filter("n_out = 1 and least < id").groupBy(F.col("least").alias("id")).agg(F.count("*").alias("n_leaves"))
    return even.filter("least > id").join(leaves, "id").filter("n_out = n_leaves").select("id")


def messages(sets: DataFrame, least: DataFrame) -> DataFrame:
    """What the vertices send in a round: (v, u) for every u that v receives, repeats included."""
    pair = lambda v, u: F.struct(F.col(v).alias("v"), F.col(u).alias("u"))
    # The set goes to its least member, the least member to all others; the sender is a member of its set, too.
    sent = sets.join(least, "v").select(F.explode(F.array(pair("m", "u"), pair("u", "m"))).alias("s"))
    own = least.select(F.explode(F.array(pair("m", "v"), pair("v", "m"))).alias("s"))
    return sent.unionByName(own).select("s.*").filter("v <> u")


def hash_to_min(pairs: DataFrame, a: str = "lo", b: str = "hi", max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(id, group_id) of every identifier that is linked with another; group_id is the least of its group.

    Pairs may come in either order and repeatedly; pairs with a null end or
    equal ends link nothing. No pairs: no rows.
    """
    ends = pairs.select(F.col(a).cast("bigint").alias("v"), F.col(b).cast("bigint").alias("u")).filter("v <> u")
    ends = ends.repartitionByRange("v", "u").mapInArrow(_combine, "v bigint, u bigint")
    # A vertex always belongs to its own cluster; the row (v, v) is left implicit.
    both = F.explode(F.array(F.struct("v", "u"), F.struct(F.col("u").alias("v"), F.col("v").alias("u")))).alias("s")
    now = Materialized(ends.select(both).select("s.*").distinct(), "clusters")
    done, state = [], None
    for turn in range(max_rounds):
        if turn % SETTLE_EVERY == 0:
            leaders = Materialized(settled_leaders(now.df), "leaders")
            lead = F.least("v", "u") == F.col("id")
            done.append(materialize(now.df.filter("u < v").join(leaders.df, F.col("u") == F.col("id")).select("v", "u"), "groups"))
            rest = Materialized(now.df.join(leaders.df, lead, "left_anti"), "clusters")
            now.drop()
            leaders.drop()
            now, state = rest, None
        before, state = state, _state(now.df)
        if state == before or state[0] == 0:
            break
        led = Materialized(now.df.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m")), "least")
        then = Materialized(messages(now.df, led.df).distinct(), "clusters")
        now.drop()
        led.drop()
        now = then
    else:
        raise RuntimeError(f"not stable after {max_rounds} rounds")
    done.append(now.df.filter("u < v"))
    # Every vertex with the leader of its group, the leaders with themselves; then the least identifier of each group.
    led = reduce(DataFrame.unionByName, done)
    led = led.select("v", "u").unionByName(led.select(F.col("u").alias("v"), "u").distinct())
    member = materialize(led.mapInArrow(_unmix, "id bigint, lead bigint"), "members")
    least = materialize(member.groupBy("lead").agg(F.min("id").alias("group_id")), "group-ids")
    return member.join(small(least), "lead").select("id", "group_id")


def valid_pairs(pairs: DataFrame, staged: DataFrame, a: str = "lo", b: str = "hi", identifier: str = "labels") -> DataFrame:
    """The distinct pairs of different ends that both occur among the identifiers (neither null nor 0), as (lo, hi)."""
    known = staged.select(F.col(identifier).alias("id")).filter("id is not null and id <> 0").distinct()
    ends = pairs.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    ends = ends.filter("_a is not null and _b is not null and lo <> hi").select("lo", "hi").distinct()
    return ends.join(known.select(F.col("id").alias("lo")), "lo", "left_semi").join(known.select(F.col("id").alias("hi")), "hi", "left_semi")


def groups(pairs: DataFrame, staged: DataFrame) -> DataFrame:
    """labels, group_id of every identifier linked directly or through others."""
    return hash_to_min(valid_pairs(pairs, staged)).select(F.col("id").alias("labels"), "group_id")
