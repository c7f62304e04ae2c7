"""Relational steps of a conversion: DataFrame in, DataFrame out, nothing collected."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from maillake.functions.files import known_ext_col, suffix_col
from maillake.functions.headers import skips


def first_n(messages: DataFrame, n: int | None) -> DataFrame:
    """The first n read, by ordinal; all if n is None or 0."""
    return messages.where(F.col("ordinal") <= n) if n else messages


def without_labels(messages: DataFrame, skip: frozenset[str]) -> DataFrame:
    return messages.where(~skips(F.col("labels"), skip))


def in_range(local_day: Column, since: date | None, until: date | None) -> Column:
    """Inclusive day range; without a day only if there is no range."""
    if not (since or until):
        return F.lit(True)
    low = local_day >= F.lit(since) if since else F.lit(True)
    high = local_day <= F.lit(until) if until else F.lit(True)
    return F.coalesce(low & high & local_day.isNotNull(), F.lit(False))


def local_time(utc: Column, offset_s: Column, tz: str) -> Column:
    """The clock reading of a moment: the sender's, UTC's or a named zone's."""
    if tz == "sender":
        return F.timestamp_seconds(F.unix_timestamp(utc) + F.coalesce(offset_s, F.lit(0)))
    return utc if tz == "utc" else F.from_utc_timestamp(utc, tz)


def not_known(messages: DataFrame, known: DataFrame, key: str = "key") -> DataFrame:
    return messages.join(known.select(key), key, "left_anti")


def known_only(messages: DataFrame, known: DataFrame, key: str = "key") -> DataFrame:
    return messages.join(known.select(key), key, "left_semi")


def ranked(messages: DataFrame, key: str = "key", order: str = "ordinal", last: bool = False) -> DataFrame:
    """With `copy`: 1 for the first of each key in order, or for the last."""
    o = F.col(order).desc() if last else F.col(order)
    return messages.withColumn("copy", F.row_number().over(Window.partitionBy(key).orderBy(o)))


def first_wins(messages: DataFrame, key: str = "key", order: str = "ordinal") -> DataFrame:
    return ranked(messages, key, order).where("copy = 1").drop("copy")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    return ranked(rows, key, order, last=True).where("copy = 1").drop("copy")


def label_union(copies: DataFrame) -> DataFrame:
    """(key, run_labels): the labels of copies in order of first appearance."""
    log = F.array_sort(F.collect_list(F.struct("ordinal", "labels")))
    flat = F.flatten(F.transform(log, lambda x: x["labels"]))
    return copies.groupBy("key").agg(F.array_distinct(flat).alias("run_labels"))


def merged_labels(own: Column, more: Column) -> Column:
    """own with what more has beyond it, in order; own stays as it is."""
    return F.concat(own, F.array_except(F.coalesce(more, F.array().cast("array<string>")), own))


def attachment_index(refs: DataFrame) -> DataFrame:
    """(hash, path, size, names, messages, refs) of refs (hash, path, name, size, message_path, seq).

    path is the canonical one; names counts names; messages lists referring messages in order of seq.
    """
    best = canonical_paths(refs)
    names = refs.groupBy("hash", "name").agg(F.count("*").alias("n")).groupBy("hash").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("names")
    )
    by = refs.groupBy("hash").agg(
        F.max("size").alias("size"),
        F.count("*").alias("refs"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "message_path"))), lambda x: x["message_path"]).alias("messages"),
    )
    return by.join(best, "hash").join(names, "hash").select("hash", "path", "size", "names", "messages", "refs")


def canonical_paths(refs: DataFrame) -> DataFrame:
    """(hash, path): a known extension first, then the most used, then the alphabet's first."""
    used = refs.groupBy("hash", "path").agg(F.count("*").alias("n"))
    rank = F.struct((~known_ext_col(suffix_col(F.col("path")))).alias("odd"), (-F.col("n")).alias("less"), F.col("path"))
    return used.groupBy("hash").agg(F.min(rank)["path"].alias("path"))


def consolidated(refs: DataFrame) -> DataFrame:
    """refs with every path replaced by its hash's canonical one."""
    return refs.drop("path").join(canonical_paths(refs), "hash")


def stored_bytes(refs: DataFrame) -> DataFrame:
    """One row: unique_attachments, references, bytes_stored, bytes_referenced."""
    per = refs.groupBy("hash").agg(F.max("size").alias("size"), F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    return per.agg(
        F.count("*").alias("unique_attachments"),
        F.coalesce(F.sum("n"), zero).alias("attachment_refs"),
        F.coalesce(F.sum("size"), zero).alias("bytes_stored"),
        F.coalesce(F.sum(F.col("size") * F.col("n")), zero).alias("bytes_referenced"),
    )


def stale(old: DataFrame, current: DataFrame) -> DataFrame:
    return old.select("path").distinct().join(current.select("path").distinct(), "path", "left_anti")


def next_ledger(old: DataFrame, current: DataFrame, incremental: bool = False, prune: bool = False) -> DataFrame:
    """Paths to record: what was there as well, unless it was pruned."""
    now = current.select("path")
    return (now if prune and not incremental else old.select("path").union(now)).distinct()


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(100 * part / whole)
