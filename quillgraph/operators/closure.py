"""Snapshot closure, outbox and transfer accounting as DataFrame operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reconcile_rows(batches: DataFrame, declared: DataFrame) -> DataFrame:
    """Tables whose batches do not add up: (name, declared, found) from (name, rows) twice."""
    found = batches.groupBy("name").agg(F.sum("rows").alias("found"))
    both = declared.select("name", F.col("rows").alias("declared")).join(found, "name", "full")
    return both.select("name", "declared", F.coalesce("found", F.lit(0)).alias("found")).where(~F.col("declared").eqNullSafe(F.col("found")))


def referenced(*tables: DataFrame, key: str = "cid") -> DataFrame:
    """Every referenced block once, in order."""
    return reduce(DataFrame.union, [t.select(key) for t in tables]).distinct().orderBy(key)


def missing_blocks(wanted: DataFrame, held: DataFrame, key: str = "cid") -> DataFrame:
    return wanted.join(held.select(key), key, "left_anti")


def corrupt_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks (cid, digest, length, bytes) whose bytes have another digest or length."""
    return blocks.where((F.sha2("bytes", 256) != F.col("digest")) | (F.octet_length("bytes") != F.col("length"))).select("cid")


def pending(records: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` pending records by root; the limit is the batch size of a replay."""
    return records.where("state = 'pending'").orderBy("root").limit(limit)


def collectable(records: DataFrame, now) -> DataFrame:
    """Blocks only of records that are synced and past protection: no other record keeps them."""
    done = (F.col("state") == "synced") & (F.col("protected_until") <= F.lit(now))
    blocks = records.select(done.alias("done"), F.explode("blocks").alias("cid"))
    kept = blocks.where(~F.col("done")).select("cid").distinct()
    return blocks.where("done").select("cid").distinct().join(kept, "cid", "left_anti")


def capacity(held: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row: bytes held, bytes that incoming blocks add, both of distinct blocks (cid, length)."""
    both = held.select("cid", "length", F.lit(1).alias("k")).union(incoming.select("cid", "length", F.lit(0).alias("k")))
    blocks = both.groupBy("cid").agg(F.max("length").alias("length"), F.max("k").alias("k"))
    part = lambda k: F.coalesce(F.sum(F.when(F.col("k") == k, F.col("length"))), F.lit(0))
    return blocks.agg(part(1).alias("held_bytes"), part(0).alias("new_bytes"))


def ledger(operations: DataFrame, budget: int, session: str = "session") -> DataFrame:
    """What each operation (session, seq, reserved, actual; null when it failed) is charged, and the running total.

    A success is charged what it moved, a failure what it had reserved; ``admitted`` says whether the
    reservation fitted the budget at that point.
    """
    charge = F.coalesce("actual", "reserved")
    run = Window.partitionBy(session).orderBy("seq")
    before = F.coalesce(F.sum(charge).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return operations.select(session, "seq", charge.alias("charged"), (before + charge).alias("total"), (before + F.col("reserved") <= budget).alias("admitted"))
