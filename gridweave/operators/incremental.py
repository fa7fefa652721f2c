"""Processing only new or changed records.

A log is cut into partitions by its keys. A run fingerprints every partition of
the rows that it may see (count and additive row hash, one scan with partial
aggregation) and compares with the fingerprints that the run before it stored;
only partitions that differ are read again. Their states (the greatest row of
each key by the given order) are compared with the stored ones of the same
partitions, the differences are the changes of the run, and the stored states of
these partitions are replaced through dynamic partition overwrite.

A run leaves numbered files: its plan, a mark once its changes are written, its
commit. Each is put in place by one rename and never replaced, so a run that
breaks off anywhere is taken up again where it stood.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import exists, list_names, materialize, put_text, read_text, remove


def watermark(jobs: DataFrame, status: str = "succeeded") -> str | None:
    """The greatest ``read_until`` of the jobs that ended well, as text; None if there is none.

    Status is compared trimmed and in lower case; jobs with a null status or a
    null ``read_until`` do not count.
    """
    ok = jobs.filter(F.lower(F.trim("status")) == status)
    return ok.agg(F.max("read_until").cast("string").alias("w")).first()["w"]


def seen(rows: DataFrame, arrived: str, until: str | None) -> Column:
    """Whether a row arrived up to ``until``; a row without an arrival time was never seen."""
    if until is None:
        return F.lit(False)
    kind = rows.schema[arrived].dataType
    return F.coalesce(F.col(arrived) <= F.lit(until).cast(kind), F.lit(False))


@dataclass(frozen=True)
class Log:
    """How a log is read: its keys, the order of the rows of one key, what its state holds.

    ``spread`` names the keys, all of them whole numbers, that place a row in a
    partition, each with the width of a block of neighbours: rows that lie close
    together change together, and a key with very many rows is still spread by
    the next one. The first key may be the only one.
    """

    name: str
    keys: tuple[str, ...]
    order: tuple[str, ...]
    payload: tuple[str, ...]
    spread: tuple[tuple[str, int], ...]
    arrived: str = "arrived_at"

    def part(self, partitions: int) -> Column:
        blocks = [F.expr(f"`{k}` div {width}") for k, width in self.spread]
        return F.pmod(F.xxhash64(*blocks), F.lit(partitions)).cast("int")

    def rows(self, log: DataFrame, partitions: int) -> DataFrame:
        """The columns that count, and ``part``; rows with a null key name no item and are left out."""
        used = list(dict.fromkeys([*self.keys, *self.order, *self.payload, self.arrived]))
        return log.select(*used).dropna(subset=list(self.keys)).withColumn("part", self.part(partitions))

    def states(self, rows: DataFrame) -> DataFrame:
        """part, the keys, ``state`` and ``seen``: structs of the payload of the greatest row of each key, of all rows and of the seen ones (null without one).

        Nulls are least; on a tie of the order the greatest payload wins, so
        repeated rows change nothing. Partial aggregation first: a hot key
        costs one row per input task.
        """
        value, by = F.struct(*self.payload), F.struct(*self.order, *self.payload)
        found = rows.groupBy("part", *self.keys).agg(F.max_by(value, by).alias("state"), F.max_by(value, F.when(F.col("_seen"), by)).alias("seen"), F.max("_seen").alias("_any"))
        return found.withColumn("seen", F.when(F.col("_any"), F.col("seen"))).drop("_any")


COUNTS = Log("counts", ("run_id", "tile_id"), ("updated_at", "arrived_at"), ("n", "batch"), (("run_id", 16), ("tile_id", 4096)))
TILES = Log("tiles", ("run_id",), ("written_at", "arrived_at"), ("batches",), (("run_id", 16),))


def fingerprints(rows: DataFrame, columns: Sequence[str], seen: str) -> DataFrame:
    """part, n, h: count and additive hash of the seen rows of each partition; untimed: its other rows.

    Nulls enter the hash with their position. Repeated rows count twice, so a
    redelivery marks its partition as changed; the states then decide.
    """
    row = F.xxhash64(*(F.xxhash64(F.lit(i), c) for i, c in enumerate(columns))).cast("decimal(38,0)")
    total = F.coalesce(F.sum(F.when(F.col("_s"), F.col("_h"))), F.lit(0)).cast("decimal(38,0)")
    return rows.select("part", F.col(seen).alias("_s"), row.alias("_h")).groupBy("part").agg(F.count_if("_s").alias("n"), total.alias("h"), F.count_if(~F.col("_s")).alias("untimed"))


def changed_keys(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys, ``old`` and ``new`` state of every key that is new or has another state; an equal state is no change."""
    old = before.select("part", *keys, F.col("state").alias("old"), F.lit(True).alias("_had"))
    rows = after.withColumnRenamed("state", "new").join(old, ["part", *keys], "left")
    return rows.filter(F.col("_had").isNull() | ~F.col("old").eqNullSafe(F.col("new"))).drop("_had")


def changed_positions(changed: DataFrame) -> DataFrame:
    """run_id, item_no: the positions of changed batch lists that hold another set of tiles than before, or are new."""
    as_set = lambda c: F.array_sort(F.array_distinct(c))
    rows = changed.select("run_id", F.col("old.batches").alias("was"), F.posexplode("new.batches").alias("pos", "tiles"))
    other = F.col("was").isNull() | (F.size("was") <= F.col("pos")) | ~as_set(F.get("was", F.col("pos"))).eqNullSafe(as_set(F.col("tiles")))
    return rows.filter(other).select("run_id", F.col("pos").cast("bigint").alias("item_no"))


def changed_items(changes: dict[str, DataFrame]) -> DataFrame:
    """item_kind, run_id, item_no of the changes of both logs."""
    counts = changes["counts"].select(F.lit("counts").alias("item_kind"), "run_id", F.col("tile_id").alias("item_no"))
    return counts.unionByName(changed_positions(changes["tiles"]).select(F.lit("tiles").alias("item_kind"), "run_id", "item_no"))


class IncrementalRun:
    """Resumable runs over logs; states, fingerprints and changes are kept in ``base``.

    One rule for rows without an arrival time: they are new in every run, and
    no run has seen them, so they are neither stored nor skipped. Rows with an
    arrival time come out once, in the run that first sees them.
    """

    STEPS = ("plan", "changes", "marked", "state", "prints", "committing")

    def __init__(self, spark: SparkSession, base: str, partitions: int = 64):
        self.spark, self.base, self.partitions = spark, base.rstrip("/"), partitions

    def _numbered(self, kind: str) -> dict | None:
        """The newest document of a kind that is whole."""
        folder = f"{self.base}/{kind}"
        names = [n for n in list_names(self.spark, folder) if n.endswith(".json")] if exists(self.spark, folder) else []
        return json.loads(read_text(self.spark, f"{folder}/{max(names)}")) if names else None

    def _put(self, kind: str, doc: dict) -> None:
        put_text(self.spark, f"{self.base}/{kind}/{doc['run']:012d}.json", json.dumps(doc))

    def run(self, logs: dict[str, tuple[Log, DataFrame]], read_until: str | None, fail_after: str | None = None) -> dict[str, DataFrame]:
        """Process the rows of the logs that arrived up to ``read_until`` (None: all); returns the changes of each log: keys, old, new.

        A run found without its commit is taken up with its own ``read_until``,
        whatever this call says; its changes, once written, stay as they are.
        ``fail_after`` breaks the run off after one of ``STEPS``, for tests.
        """
        last = self._numbered("commits") or {"run": 0}
        plan = self._numbered("plans")
        if not plan or plan["run"] <= last["run"]:
            plan = {"run": last["run"] + 1, "read_until": read_until}
            self._put("plans", plan)
        self._step("plan", fail_after)
        no = plan["run"]
        out = {name: f"{self.base}/{name}/changes/run={no}" for name in logs}
        work = {}
        marked = self._numbered("marks")
        if not marked or marked["run"] < no:
            for name, (log, df) in logs.items():
                work[name] = self._changed(log, df, plan, last["run"])
                after, _, parts = work[name]
                before, after = self._state(name, parts), after.drop("seen")
                found = changed_keys(before, after, log.keys) if before is not None else after.withColumnRenamed("state", "new").withColumn("old", F.lit(None).cast(after.schema["state"].dataType))
                found.select(*log.keys, "old", "new").write.mode("overwrite").parquet(out[name])
            self._step("changes", fail_after)
            self._put("marks", {"run": no})
        self._step("marked", fail_after)
        # From here on nothing depends on the old states: they may be replaced, in part and again.
        for name, (log, df) in logs.items():
            states, prints, _ = work.get(name) or self._changed(log, df, plan, last["run"])
            stored = states.filter(F.col("seen").isNotNull()).select("part", *log.keys, F.col("seen").alias("state"))
            (
                stored.hint("rebalance", "part")
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("part")
                .parquet(f"{self.base}/{name}/state")
            )
            self._step("state", fail_after)
            prints.write.mode("overwrite").parquet(f"{self.base}/{name}/prints/run={no}")
        self._step("prints", fail_after)
        if fail_after == "committing":  # half a commit: the file is there under another name
            put_text(self.spark, f"{self.base}/commits/{no:012d}.json", json.dumps(plan), rename=False)
        self._step("committing", fail_after)
        self._put("commits", plan)
        return {name: self.spark.read.parquet(path) for name, path in out.items()}

    def _changed(self, log: Log, df: DataFrame, plan: dict, last: int) -> tuple[DataFrame, DataFrame, list[int]]:
        """The states of the changed partitions, written; the fingerprints of all seen rows; and the changed partitions.

        The log is scanned twice: for the fingerprints, and for the states of
        the partitions whose fingerprint differs.

        A partition with rows that have no arrival time always counts as
        changed. The driver sees partition numbers alone, ``partitions`` at most.
        """
        rows = log.rows(df, self.partitions)
        until = plan["read_until"]
        mine = F.col(log.arrived).isNotNull() if until is None else seen(rows, log.arrived, until)
        rows = rows.withColumn("_seen", mine).filter(F.col("_seen") | F.col(log.arrived).isNull())
        columns = [c for c in rows.columns if c not in ("part", "_seen")]
        prints = materialize(fingerprints(rows, columns, "_seen"), "prints")
        differ = prints.select("part", "n", "h", "untimed")
        path = f"{self.base}/{log.name}/prints/run={last}"
        if last and exists(self.spark, path):
            old = self.spark.read.parquet(path).select("part", F.col("n").alias("_n"), F.col("h").alias("_h"))
            differ = differ.join(old, "part", "left").filter("untimed > 0 or not (n <=> _n and h <=> _h)")
        parts = sorted(r["part"] for r in differ.select("part").collect())
        return materialize(log.states(rows.filter(F.col("part").isin(parts))), "states"), prints, parts

    def _state(self, name: str, parts: list[int]) -> DataFrame | None:
        """The stored states of some partitions; only their folders are read."""
        path = f"{self.base}/{name}/state"
        return self.spark.read.parquet(path).filter(F.col("part").isin(parts)) if exists(self.spark, path) else None

    @staticmethod
    def _step(name: str, fail_after: str | None) -> None:
        if name == fail_after:
            raise RuntimeError(f"broken off after {name}")

    def state(self, log: Log) -> DataFrame:
        """The stored states: part, the keys and the payload."""
        return self.spark.read.parquet(f"{self.base}/{log.name}/state").select("part", *log.keys, "state.*")

    def reset(self) -> None:
        remove(self.spark, self.base)
