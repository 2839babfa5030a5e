"""Human decisions: append-only rows, validated by snapshots, never in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.values import values_equal


def snapshot(columns: list[str]) -> Column:
    """A digest of a row's columns; two rows are the same version exactly when it is equal."""
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def reconcile(decisions: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Every decision with ``state``: current, or stale if its row is gone or has another snapshot."""
    now = rows.select(key, F.col("snapshot").alias("_now"))
    joined = decisions.join(now, key, "left")
    return joined.withColumn("state", F.when(F.col("_now") == F.col("snapshot"), "current").otherwise("stale")).drop("_now")


def latest(decisions: DataFrame) -> DataFrame:
    """The decision in force for each candidate: the last one whose transaction is not undone."""
    undone = decisions.filter("action = 'undo'").select(F.col("target_transaction").alias("transaction_id"))
    live = decisions.filter("action <> 'undo'").join(undone, "transaction_id", "left_anti")
    ranked = live.withColumn("_n", F.row_number().over(Window.partitionBy("candidate_id").orderBy(F.col("decided_at").desc(), F.col("transaction_id").desc())))
    return ranked.filter("_n = 1").drop("_n")


def apply(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates with their status: confirmed, rejected, skipped, stale or pending."""
    state = reconcile(latest(decisions), candidates, "candidate_id")
    status = F.when(F.col("state") == "stale", "stale").otherwise(F.col("action"))
    named = F.create_map(*[F.lit(x) for p in {"confirm": "confirmed", "reject": "rejected", "skip": "pending", "stale": "stale"}.items() for x in p])
    chosen = state.select("candidate_id", named[status].alias("_status"), "reason")
    kept = candidates.drop("status")
    return kept.join(chosen, "candidate_id", "left").withColumn("status", F.coalesce("_status", F.lit("pending"))).drop("_status")


def resolve_conflict(candidates: DataFrame, group: list[str], choice: DataFrame, transaction: str, reject_others: bool) -> DataFrame:
    """Decisions that confirm the chosen candidate of each group and, on request, reject members with other values."""
    picked = candidates.join(choice.select("candidate_id"), "candidate_id", "left_semi").select(*group, F.col("value").alias("_picked"), F.col("candidate_id").alias("_picked_id"))
    peers = candidates.join(picked, group)
    same = F.col("candidate_id") == F.col("_picked_id")
    action = F.when(same, "confirm").when(F.lit(reject_others) & ~values_equal(F.col("_picked"), F.col("value")), "reject")
    out = peers.withColumn("action", action).filter("action is not null")
    return out.select("candidate_id", "action", "snapshot", F.lit(transaction).alias("transaction_id"), F.lit(None).cast("string").alias("target_transaction"),
                      F.current_timestamp().alias("decided_at"), F.lit("conflict resolved").alias("reason"))


def corrections(candidates: DataFrame, edits: DataFrame) -> DataFrame:
    """Edited values as candidates of their own, while the row they correct is unchanged; originals stay."""
    held = edits.join(candidates.select("candidate_id", "snapshot"), ["candidate_id", "snapshot"], "left_semi")
    parent = candidates.select(*[c for c in candidates.columns if c not in ("raw", "snapshot")])
    made = held.select("candidate_id", F.col("new_raw").alias("raw")).join(parent, "candidate_id")
    made = made.withColumn("extraction_method", F.lit("human_correction"))
    return made.withColumn("candidate_id", F.substring(F.sha2(F.concat_ws("\x1f", "candidate_id", "raw", F.lit("human_correction")), 256), 1, 20))


def changed_files(before: DataFrame, now: DataFrame, key: str, digest: str) -> DataFrame:
    """added, removed and changed files between two inventories."""
    a, b = before.select(key, F.col(digest).alias("_a")), now.select(key, F.col(digest).alias("_b"))
    joined = a.join(b, key, "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return joined.withColumn("change", change).filter("change is not null").select(key, "change")


def keep_last(rows: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The last n rows of each key (history, jobs)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def usable(facts: DataFrame, grants: DataFrame) -> DataFrame:
    """Facts that an active grant names, with grant_state stale if the fact has changed since."""
    live = grants.filter("revoked = false").select("grant_id", "group_id", F.col("snapshot").alias("_granted"))
    joined = live.join(facts, "group_id", "left")
    return joined.withColumn("grant_state", F.when(F.col("snapshot") == F.col("_granted"), "active").otherwise("stale")).drop("_granted")
