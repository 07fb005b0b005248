"""Bulk reads: items and artifacts by page, and one record with why it is visible."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spatial
from . import access

PAGE_ROWS, PAGE_BYTES = 100_000, 64 << 20
ORDERS = ("map", "stored")


class CursorError(ValueError):
    """A cursor of another request, viewer or making."""


def seal(payload: dict, binding: str, secret: bytes) -> str:
    """An opaque cursor that only the same request of the same viewer can use."""
    body = json.dumps(payload, sort_keys=True).encode()
    return base64.urlsafe_b64encode(hmac.new(secret, binding.encode() + b"\0" + body, hashlib.sha256).digest()[:16] + body).decode()


def unseal(cursor: str, binding: str, secret: bytes) -> dict:
    try:
        raw = base64.urlsafe_b64decode(cursor.encode())
        mark, body = raw[:16], raw[16:]
        good = hmac.compare_digest(mark, hmac.new(secret, binding.encode() + b"\0" + body, hashlib.sha256).digest()[:16])
    except ValueError as e:
        raise CursorError("no cursor") from e
    if not good:
        raise CursorError("a cursor of another request")
    return json.loads(body)


def read_items(visible: DataFrame, fields: list[str], order: str = "map", after: tuple | None = None, limit: int = PAGE_ROWS, matched: str | None = None, keep_unmatched: bool = False, frame: spatial.Frame | None = None, most_bytes: int = PAGE_BYTES) -> DataFrame:
    """A page of items: id, fields, position and labels, in map order (cell, then rank) or stored order (entity).

    A page ends at ``limit`` rows or before the row that takes its values past most_bytes, but holds one row at least.

    matched names a boolean column; unmatched rows are left out, or kept with the column ``matched``. after is the last row's
    order values: (cell, rank) or (entity,). The page resumes by value, so rewrites of the files do not move it.
    """
    if order not in ORDERS:
        raise ValueError(f"unknown order {order!r}")
    x = visible if matched is None or keep_unmatched else visible.where(matched)
    x = x.withColumn("cell", F.shiftrightunsigned("code", 32))
    keys = ["cell", "rank"] if order == "map" else ["entity"]
    if after is not None:
        if order == "map":
            x = x.where((F.col("cell") > after[0]) | ((F.col("cell") == after[0]) & (F.col("rank") > after[1])))
        else:
            x = x.where(F.col("entity") > after[0])
    cols = [F.col("entity").alias("id"), *map(F.col, fields)]
    if frame is not None:
        cols += [spatial.unfixed32(F.col("qx"), frame.min_x, frame.max_x).alias("position_x"), spatial.unfixed32(F.col("qy"), frame.min_y, frame.max_y).alias("position_y")]
    if keep_unmatched and matched:
        cols.append(F.col(matched).alias("matched"))
    # a top-k per partition, then of those: no full sort for a page
    page = x.orderBy(*keys).limit(limit).select(*cols, *[F.col(k).alias(f"order_{k}") for k in keys])
    sized = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c, kind in page.dtypes if kind in ("string", "binary") or "<" in kind]
    fixed = 8 * (len(page.columns) - len(sized))
    if not sized and limit * fixed <= most_bytes:
        return page
    # at most ``limit`` rows meet in one task
    upto = F.sum(reduce(add, sized, F.lit(fixed))).over(Window.orderBy(*[f"order_{k}" for k in keys]).rowsBetween(Window.unboundedPreceding, 0))
    place = F.row_number().over(Window.orderBy(*[f"order_{k}" for k in keys]))
    return page.withColumn("upto_", upto).withColumn("place_", place).where((F.col("upto_") <= most_bytes) | (F.col("place_") == 1)).drop("upto_", "place_")


def head_counts(rows: DataFrame, matched: str) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("visible"), F.count_if(matched).alias("matched"))


def item_card(items: DataFrame, viewer: access.Viewer, entity: int, views: list[tuple[str, str | None]] = (), deleted: DataFrame | None = None, suppressed: DataFrame | None = None) -> DataFrame:
    """One record with the views it can be reached in and why it is visible; a hidden one gives no row, as an absent one."""
    one = access.visible(items.where(F.col("entity") == entity), viewer, deleted, suppressed)
    open_ = [name for name, label in views if viewer.held(label)]
    return access.why_visible(one, viewer).withColumn("views", F.array(*map(F.lit, open_)) if open_ else F.array().cast("array<string>"))


def read_artifacts(passing: DataFrame, level: int | None = None, parent=None, q: str | None = None, ids: list | None = None, after=None, limit: int = PAGE_ROWS) -> DataFrame:
    """A page of served artifacts by id."""
    x = passing
    if level is not None:
        x = x.where(F.col("level") == level)
    if parent is not None:
        x = x.where(F.col("parent") == parent)
    if q is not None:
        x = x.where(F.lower(F.coalesce("title", F.col("artifact").cast("string"))).contains(q.lower()))
    if ids is not None:
        x = x.where(F.col("artifact").isin(*ids) if ids else F.lit(False))
    if after is not None:
        x = x.where(F.col("artifact") > after)
    return x.orderBy("artifact").limit(limit)
