"""Ingest, edits and upkeep as micro-batches: resolving rows to items, receipts, overlays, flushing, merging, compaction.

Each operation is a DataFrame function; ``run_ingest`` puts them into foreachBatch. Visibility follows the order of flushes:
there are no watermarks, as there is no late data.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import access
from ..plans.durable import numbered, settled

#: Why a row is refused, in the order in which reasons are given; a label that the writer does not hold comes before all.
REASONS = ("label_not_held", "unknown_id", "names_two_items", "names_no_item", "value_held", "one_item_twice", "one_value_twice")


def _claims(rows: DataFrame) -> DataFrame:
    """Rows (row, item, value) that stand when decided in order of row: none names an item or sets a value of an earlier one that stands.

    A row stands once it is the first among the undecided ones for all that it claims; those that meet it then fall. So rows are
    settled for all items at once, and only chains of rows that meet each other in turn take more rounds.
    """
    left = rows.select("row", F.array_compact(F.array(F.concat(F.lit("i"), F.col("item").cast("string")), F.concat(F.lit("v"), "value"))).alias("claims"))
    stands = None
    while True:
        one = left.select("row", F.explode("claims").alias("claim"))
        first = one.groupBy("claim").agg(F.min("row").alias("first"))
        held_up = one.join(first, "claim").where("row > first").select("row").distinct().withColumn("waits", F.lit(True))
        told = settled(left.join(held_up, "row", "left").withColumn("waits", F.coalesce("waits", F.lit(False))))
        now, left = told.where("not waits").drop("waits"), told.where("waits").drop("waits")
        stands = now.select("row") if stands is None else stands.unionByName(now.select("row"))
        taken = now.select(F.explode("claims").alias("claim"))
        fallen = left.select("row", F.explode("claims").alias("claim")).join(taken, "claim", "left_semi").select("row").distinct()
        left = left.join(fallen, "row", "left_anti")
        if left.isEmpty():
            return stands


def resolve_rows(batch: DataFrame, held: DataFrame, scope: DataFrame | None = None, viewer: access.Viewer | None = None) -> DataFrame:
    """batch (row, id, key, x, y, [labels], ...) with verdict (create, edit, refuse), entity and reason.

    A row names an item by its id and by its unique key. What names nothing creates an item where the row has a position. Rows
    are decided in order of row against what was held before and the rows that stand so far; a refused row claims nothing.

    held: entity, key and, where items have moved, number (the id they are named by). scope: entities that the writer may
    name; any other is as absent, but its key stays taken. viewer: the writer, where rows carry labels that it must hold.
    """
    every = held.select("entity", "key", F.col("number" if "number" in held.columns else "entity").alias("number"))
    own = every if scope is None else every.join(scope.select("entity"), "entity", "left_semi")
    by_id = own.select(F.col("number").alias("id"), F.col("entity").alias("by_id"), F.col("key").alias("stored"))
    by_key = own.where("key is not null").select("key", F.col("entity").alias("by_key"))
    taken = every.where("key is not null").select("key", F.lit(True).alias("taken"))
    x = batch.join(by_id, "id", "left").join(by_key, "key", "left").join(taken, "key", "left")
    open_ = F.lit(True)
    if viewer is not None and "labels" in batch.columns:
        x = access.with_keys(x)
        open_ = F.col("labels").isNull() | F.exists("keys", lambda k: access.satisfied(k, viewer) | F.lit(viewer.read_all))
    item = F.coalesce("by_id", "by_key")
    nowhere = F.col("x").isNull() | F.col("y").isNull()
    reason = (
        F.when(~open_, "label_not_held")
        .when(F.col("id").isNotNull() & F.col("by_id").isNull(), "unknown_id")
        .when(F.col("by_id") != F.col("by_key"), "names_two_items")
        .when(item.isNull() & nowhere, "names_no_item")
        .when(F.col("by_key").isNull() & F.col("taken"), "value_held")
    )
    sets = F.when(F.col("key").isNotNull() & F.col("by_key").isNull(), F.col("key"))
    x = settled(x.select(*batch.columns, item.alias("entity"), sets.alias("sets_"), reason.alias("reason")))
    fine = x.where("reason is null")
    stands = _claims(fine.where("entity is not null or sets_ is not null").select("row", F.col("entity").alias("item"), F.col("sets_").alias("value")))
    stood = fine.join(stands, "row", "left_semi")
    items = stood.where("entity is not null").select("entity", F.col("row").alias("item_row"))
    values = stood.where("sets_ is not null").select("sets_", F.col("row").alias("value_row"))
    x = x.join(items, "entity", "left").join(values, "sets_", "left")
    twice = F.when(F.col("item_row") < F.col("row"), "one_item_twice").when(F.col("value_row") < F.col("row"), "one_value_twice")
    x = x.withColumn("reason", F.coalesce("reason", twice))
    verdict = F.when(F.col("reason").isNotNull(), "refuse").when(F.col("entity").isNotNull(), "edit").otherwise("create")
    return x.withColumn("verdict", verdict).select(*batch.columns, "verdict", F.when(F.col("reason").isNull(), F.col("entity")).alias("entity"), "reason")


def next_entities(created: DataFrame, last: int) -> DataFrame:
    """created rows with new entity numbers from last + 1 on, in order of row.

    Numbers are given by partition offsets of a ranged sort, so no single task numbers the batch.
    """
    return numbered(created.repartitionByRange("row").sortWithinPartitions("row"), "entity", last + 1)


def apply_edits(items: DataFrame, edits: DataFrame, fields: list[str]) -> DataFrame:
    """items after edits: a field that the edit does not name keeps its value, a named null clears it.

    edits: entity, fields, seq and ``present``, the names of the fields it carries. The last edit of an entity counts for each field.
    """
    # an aggregate with a map-side combine: an item with very many edits is no hot task
    marks = [F.max_by(F.struct(F.col(f).alias("v")), F.when(F.array_contains("present", f), F.col("seq"))).alias(f"new_{f}") for f in fields]
    x = items.join(edits.groupBy("entity").agg(*marks), "entity", "left")
    return x.select(*[F.when(F.col(f"new_{c}").isNotNull(), F.col(f"new_{c}.v")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in items.columns])


def overlay_state(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(deleted, suppressed) after a sequence of changes (entity, op, seq): deletion is for good, suppression can be lifted."""
    deleted = changes.where("op = 'delete'").select("entity").distinct()
    last = changes.where("op in ('suppress', 'unsuppress')").groupBy("entity").agg(F.max_by("op", "seq").alias("op"))
    return deleted, last.where("op = 'suppress'").select("entity")


def unique_conflicts(items: DataFrame, key: str) -> DataFrame:
    """key, holders: unique values that several items hold; null is free."""
    return items.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")


def mint_codes(vocabulary: DataFrame, values: DataFrame, open_: bool) -> tuple[DataFrame, DataFrame]:
    """(vocabulary with new codes, values refused). values: key. An open vocabulary mints the next codes in order of key."""
    new = values.select("key").where("key is not null").distinct().join(vocabulary.select("key"), "key", "left_anti")
    if not open_:
        return vocabulary, new
    top = vocabulary.agg(F.max("code")).first()[0] or 0
    minted = new.withColumn("code", (F.row_number().over(Window.orderBy("key")) + top).cast("int")).select("code", "key")
    return vocabulary.select("code", "key").unionByName(minted), new.limit(0)


def compact(items: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items without deleted ones, deletions still needed): the fold drops dead rows and retires their deletions."""
    return items.join(deleted, "entity", "left_anti"), deleted.join(items.select("entity"), "entity", "left_anti")


def due(rows: int, dead: int, segments: int, since_s: float, share: float = 0.2, most_segments: int = 32, every_s: float = 86_400) -> str | None:
    """Why a compaction is due, or None."""
    if rows and dead / rows >= share:
        return "dead_rows"
    if segments > most_segments:
        return "segments"
    return "schedule" if dead and since_s >= every_s else None


def merge_plan(sizes: list[int], width: int = 4, ratio: float = 4.0) -> tuple[int, int] | None:
    """The first run of ``width`` neighbouring segments of one size tier: (first, last + 1)."""
    for i in range(len(sizes) - width + 1):
        run = sizes[i : i + width]
        if max(run) <= ratio * max(1, min(run)):
            return i, i + width
    return None


def drop_view(positions: DataFrame, view: str) -> tuple[DataFrame, DataFrame]:
    """(positions left, entities that are in no view any more and go with it)."""
    left = positions.where(F.col("view") != view)
    gone = positions.where(F.col("view") == view).select("entity").distinct().join(left.select("entity"), "entity", "left_anti")
    return left, gone


def grow_members(members: DataFrame, added: DataFrame, artifacts: DataFrame, open_: bool) -> tuple[DataFrame, DataFrame]:
    """(members with the added ones, artifacts that an open layer mints for them). A closed layer refuses unknown artifacts' rows."""
    new = added.select("artifact").distinct().join(artifacts.select("artifact"), "artifact", "left_anti")
    kept = added if open_ else added.join(artifacts.select("artifact"), "artifact", "left_semi")
    return members.unionByName(kept.select("artifact", "entity")).distinct(), new if open_ else new.limit(0)


def batch_digest(rows: DataFrame) -> str:
    """A digest of a batch's rows that does not depend on their order or partitions."""
    h = rows.select(F.xxhash64(F.to_json(F.struct(*sorted(rows.columns)))).alias("h")).agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x"), F.count(F.lit(1)).alias("n")).first()
    return hashlib.sha256(json.dumps([str(h["s"]), h["x"], h["n"]]).encode()).hexdigest()


class Conflict(ValueError):
    """A batch id that came again with other rows."""


def receipt(receipts: DataFrame, principal: str, batch: str, digest: str) -> dict | None:
    """The receipt of a batch that was taken before, None for a new one; other rows under the same id are a conflict."""
    got = receipts.where((F.col("principal") == principal) & (F.col("batch") == batch)).limit(1).collect()
    if not got:
        return None
    if got[0]["digest"] != digest:
        raise Conflict(f"batch {batch!r} came again with other rows")
    return got[0].asDict()


def run_ingest(stream: DataFrame, store, principal: str, checkpoint: str, trigger: dict | None = None, writer: access.Viewer | None = None) -> StreamingQuery:
    """Ingest a stream of rows (row, id, key, x, y, ...) into a store, a segment per micro-batch.

    writer: whose items may be named and whose labels may be set; None writes everything. A micro-batch that is run again
    after a failure finds its receipt and changes nothing.
    """

    def take(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            store.take(rows, principal, f"stream-{number}", writer)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
