"""Logs of playlist edits, applied to all sessions at once.

An edit adds a track at the end (rejected if the track is there), removes one, sets a new order, or clears the list. Only the last edit that
concerns a track says whether it is there, and the edit that put it there says where; so logs need no loop: windows over each track's
edits since the last new order or clearing are enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from segue.operators.sequences import validate_sequence

OPS = ("add", "remove", "reorder", "clear")


def _steps(crates: DataFrame, edits: DataFrame) -> DataFrame:
    """``session_id, seq, op, trackid, order``: the edits, after a first one that sets what each session holds."""
    held = crates.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "trackid"))), lambda x: x["trackid"]).alias("order"))
    first = held.select("session_id", F.lit(None).cast("long").alias("seq"), F.lit("reorder").alias("op"), F.lit(None).cast("long").alias("trackid"), "order")
    return first.unionByName(edits.where(F.col("op").isin(*OPS)).select("session_id", F.col("seq").cast("long").alias("seq"), "op", F.col("trackid").cast("long").alias("trackid"), F.col("order").cast("array<bigint>").alias("order")))


def _placed(crates: DataFrame, edits: DataFrame) -> DataFrame:
    """A row for each track that an edit concerns: ``session_id, seq, op, trackid, idx, epoch, accepted``; the epoch counts new orders and clearings."""
    at: list[Column] = [F.col("seq").asc_nulls_first(), F.col("op"), F.col("trackid")]
    resets = F.sum(F.when(F.col("op").isin("reorder", "clear"), 1).otherwise(0)).over(Window.partitionBy("session_id").orderBy(*at).rowsBetween(Window.unboundedPreceding, 0))
    steps = _steps(crates, edits).withColumn("epoch", resets)
    concerned = F.when(F.col("op") == "reorder", F.transform(F.array_distinct("order"), lambda t, i: F.struct(t.alias("trackid"), i.alias("idx")))).when(F.col("op") != "clear", F.array(F.struct(F.col("trackid"), F.lit(0).alias("idx"))))
    rows = steps.select("session_id", "seq", "op", "epoch", F.inline_outer(concerned))
    before = F.lag("op").over(Window.partitionBy("session_id", "epoch", "trackid").orderBy(F.col("seq").asc_nulls_first(), "op"))
    return rows.withColumn("accepted", F.when(F.col("op") == "add", F.coalesce(before == "remove", F.lit(True)) & F.col("trackid").isNotNull()).otherwise(True))


def edit_log(crates: DataFrame, edits: DataFrame) -> DataFrame:
    """``session_id, seq, op, trackid, accepted`` of the edits ``session_id, seq, op, trackid, order``; an edit's ``seq`` is its own in its session.

    An add is rejected if the track is in the session then, or null; other edits are accepted, and unknown kinds of edits are left out.
    """
    told = _placed(crates, edits).where("seq is not null")
    one = told.where("op in ('reorder', 'clear')").select("session_id", "seq", "op", F.lit(None).cast("long").alias("trackid"), "accepted").distinct()
    return told.where("op in ('add', 'remove')").select("session_id", "seq", "op", "trackid", "accepted").unionByName(one)


def edited(crates: DataFrame, edits: DataFrame) -> DataFrame:
    """``session_id, position, trackid``: the sessions after their edits; one without tracks has no row."""
    rows = _placed(crates, edits)
    last = rows.withColumn("newest", F.max("epoch").over(Window.partitionBy("session_id"))).where("epoch = newest and trackid is not null")
    of = Window.partitionBy("session_id", "trackid").orderBy(F.col("seq").desc_nulls_last(), F.desc("op"))
    ended = last.withColumns({"n": F.row_number().over(of), "end": F.first("op").over(of)}).where("end != 'remove' and op != 'remove' and accepted")
    placing = ended.groupBy("session_id", "trackid").agg(F.max(F.struct(F.coalesce("seq", F.lit(-(2**63)).cast("long")).alias("seq"), "idx")).alias("at"))
    order = Window.partitionBy("session_id").orderBy("at.seq", "at.idx")
    return placing.select("session_id", (F.row_number().over(order) - 1).alias("position"), "trackid")


def revalidated(crates: DataFrame, edits: DataFrame, tracks: DataFrame) -> DataFrame:
    """``validate_sequence`` of the edited sessions that hold two tracks or more; others have no report."""
    return validate_sequence(edited(crates, edits), tracks).where("n > 1")
