"""A store of Parquet segments under a manifest: immutable generations, published by writing the next manifest.

A reader takes one manifest and sees nothing of later ones. Segments are in map order, so code ranges prune files. Items keep
the keys of their labels, worked out when they are written, and the number that they are named by: an edit moves an item to
a new entity, its number stays.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spatial
from ..operators import access
from ..streaming import ingest

ITEMS = "entity bigint, number bigint, key string, x double, y double, labels array<string>, keys array<string>, qx bigint, qy bigint, code bigint, rank bigint"
DERIVED = ("entity", "number", "keys", "qx", "qy", "code", "rank")
KINDS = ("attribute", "vocabulary", "view", "group", "layer")
RECEIPT = "principal string, batch string, digest string, generation int"


class Store:
    """Items of one view. All state is in files below root that Spark reads and writes."""

    def __init__(self, spark: SparkSession, root: str, frame: spatial.Frame, fields: str = ""):
        self.spark, self.root, self.frame = spark, root.rstrip("/"), frame
        self.schema = ITEMS + (", " + fields if fields else "")

    def manifest(self) -> dict:
        """The newest complete manifest; manifests are one-line text files in folders named by generation."""
        newest = self._generations()[-1:]
        if not newest:
            return {"generation": 0, "segments": [], "sizes": [], "deletes": [], "suppresses": [], "last_entity": 0, "receipts": [], "declared": {}}
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{newest[0]}").first()[0])

    def _generations(self) -> list[str]:
        """Names of complete generations, in order."""
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifests")
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = sc._jvm.org.apache.hadoop.fs.Path
        return sorted(f.getPath().getName() for f in fs.listStatus(path) if fs.exists(done(f.getPath(), "_SUCCESS")))

    def publish(self, m: dict) -> None:
        """Write the next manifest. Of two writers that publish the same generation one fails, as the folder exists."""
        m = m | {"generation": m["generation"] + 1}
        text = self.spark.createDataFrame([(json.dumps(m),)], "value string").coalesce(1)
        text.write.mode("errorifexists").text(f"{self.root}/manifests/{m['generation']:09d}")

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, kind: str) -> str:
        path = f"{self.root}/{kind}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def fields(self, m: dict | None = None) -> str:
        """The schema of items: the store's own columns and what was declared since."""
        declared = [f"{n} {d['spec']}" for (kind, n), d in self.declarations(m).items() if kind == "attribute"]
        return ", ".join([self.schema, *declared])

    def declarations(self, m: dict | None = None) -> dict[tuple[str, str], dict]:
        got = (m or self.manifest()).get("declared", {})
        return {tuple(k.split(":", 1)): v for k, v in got.items()}

    def declare(self, kind: str, name: str, spec: str) -> None:
        """Declare an attribute (spec: its type), vocabulary, view, group or layer at run time; rows so far hold nothing under it.

        The same declaration again changes nothing; another one under the name is refused.
        """
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}")
        m = self.manifest()
        known = self.declarations(m).get((kind, name))
        own = [c.strip().split()[0] for c in self.schema.split(", ")]
        if known and known["spec"] == spec:
            return
        if known or (kind == "attribute" and name in own):
            raise ValueError(f"{kind} {name!r} is declared already")
        self.publish(m | {"declared": m.get("declared", {}) | {f"{kind}:{name}": {"spec": spec}}})

    def items(self, m: dict | None = None) -> DataFrame:
        m = m or self.manifest()
        out = self._read(m["segments"], self.fields(m))
        return out.join(self.deleted(m), "entity", "left_anti") if m["deletes"] else out

    def deleted(self, m: dict | None = None) -> DataFrame:
        return self._read((m or self.manifest())["deletes"], "entity bigint").distinct()

    def suppressed(self, m: dict | None = None) -> DataFrame:
        return ingest.overlay_state(self._read((m or self.manifest())["suppresses"], "entity bigint, op string, seq bigint"))[1]

    def held(self) -> DataFrame:
        return self.items().select("entity", "key", "number")

    def last_entity(self) -> int:
        return self.manifest()["last_entity"]

    def receipts(self) -> DataFrame:
        return self._read(self.manifest()["receipts"], RECEIPT)

    def take(self, rows: DataFrame, principal: str, batch: str, writer: access.Viewer | None = None) -> DataFrame | None:
        """Take a batch of rows (row, id, key, x, y, ...) once; the refused rows, or None for a batch that was taken before.

        Columns that the batch lacks keep what items store, and so does a row without position; a null in any other column
        clears it. writer: only items that it may see can be named, and only labels that it holds be set.
        """
        bad = rows.where(F.col("x").isNull() != F.col("y").isNull()).unionByName(rows.where(F.isnan("x") | F.isnan("y") | (F.abs("x") == float("inf")) | (F.abs("y") == float("inf"))))
        digest = ingest.batch_digest(rows)
        if ingest.receipt(self.receipts(), principal, batch, digest):
            return None
        first = bad.select("row").first()
        if first:
            raise ValueError(f"row {first[0]}: a position is two finite coordinates or none")
        scope = None if writer is None else access.authorised(self.items(), writer).select("entity")
        got = ingest.resolve_rows(rows, self.held(), scope, writer)
        self.flush(got.where("verdict = 'create'").drop("entity"), got.where("verdict = 'edit'"), {"principal": principal, "batch": batch, "digest": digest})
        return got.where("verdict = 'refuse'").select("row", "reason")

    def _placed(self, rows: DataFrame, schema: str) -> DataFrame:
        from ..operators.viewport import hashed_rank

        x = rows if "labels" in rows.columns else rows.withColumn("labels", F.lit(None).cast("array<string>"))
        x = access.with_keys(x.drop(*(c for c in DERIVED if c not in ("entity", "number") and c in x.columns)))
        x = spatial.place(x.withColumn("rank", hashed_rank(F.col("entity"))), self.frame)
        kinds = [c.strip().split(" ", 1) for c in schema.split(", ")]
        return spatial.map_order(x.select(*[(F.col(c) if c in x.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds]))

    def _edited(self, edits: DataFrame, m: dict, schema: str) -> DataFrame:
        """The new rows of edited items: the old row, with what the edit names."""
        names = [c.strip().split()[0] for c in schema.split(", ")]
        own = [c for c in names if c in edits.columns and c not in (*DERIVED, "x", "y")]
        place = F.when(F.col("x").isNotNull(), F.array(F.lit("x"), F.lit("y"))).otherwise(F.array().cast("array<string>"))
        named = edits.withColumn("seq", F.lit(1)).withColumn("present", F.concat(F.array(*map(F.lit, own)).cast("array<string>"), place))
        old = self.items(m).join(edits.select("entity", "row"), "entity")
        return ingest.apply_edits(old, named.drop("row"), [*own, "x", "y"])

    def flush(self, created: DataFrame, edited: DataFrame | None, taken: dict) -> None:
        """Write created rows as a segment; an edit is the item's old row deleted and its new row under a new entity."""
        m = self.manifest()
        schema = self.fields(m)
        rows = ingest.next_entities(created, m["last_entity"]).withColumn("number", F.col("entity"))
        if edited is not None and not edited.isEmpty():
            made = self._edited(edited, m, schema).withColumnRenamed("entity", "was")
            moved = ingest.next_entities(made, m["last_entity"] + created.count())
            moved = self._read([self._write(moved, "moved")], ", ".join(f"{n} {k}" for n, k in moved.dtypes))
            rows = rows.unionByName(moved.drop("was"), allowMissingColumns=True)
            gone = self._write(moved.select(F.col("was").alias("entity")), "deletes")
            hidden = self.suppressed(m).withColumnRenamed("entity", "was").join(moved.select("was", "entity"), "was")
            kept = self._write(hidden.select("entity", F.lit("suppress").alias("op"), F.lit(m["generation"] + 1).cast("long").alias("seq")), "suppresses")
            m = m | {"deletes": [*m["deletes"], gone], "suppresses": [*m["suppresses"], kept]}
        path = self._write(self._placed(rows, schema), "segments")
        got = self._read([path], schema).agg(F.max("entity").alias("last"), F.count(F.lit(1)).alias("n")).first()
        note = self._write(self.spark.createDataFrame([(taken["principal"], taken["batch"], taken["digest"], m["generation"] + 1)], RECEIPT), "receipts")
        self.publish(m | {"segments": [*m["segments"], path], "sizes": [*m["sizes"], got["n"]], "last_entity": max(m["last_entity"], got["last"] or 0), "receipts": [*m["receipts"], note]})

    def change(self, entities: DataFrame, op: str) -> None:
        """delete, suppress or unsuppress entities."""
        m = self.manifest()
        if op == "delete":
            self.publish(m | {"deletes": [*m["deletes"], self._write(entities.select("entity"), "deletes")]})
        elif op in ("suppress", "unsuppress"):
            rows = entities.select("entity", F.lit(op).alias("op"), F.lit(m["generation"] + 1).cast("long").alias("seq"))
            self.publish(m | {"suppresses": [*m["suppresses"], self._write(rows, "suppresses")]})
        else:
            raise ValueError(f"unknown change {op!r}")

    def merge(self) -> bool:
        """Rewrite the first run of neighbouring segments of one size tier as one."""
        m = self.manifest()
        run = ingest.merge_plan(m["sizes"])
        if not run:
            return False
        a, b = run
        path = self._write(spatial.map_order(self._read(m["segments"][a:b], self.fields(m))), "segments")
        self.publish(m | {"segments": [*m["segments"][:a], path, *m["segments"][b:]], "sizes": [*m["sizes"][:a], sum(m["sizes"][a:b]), *m["sizes"][b:]]})
        return True

    def compact(self) -> None:
        """Rewrite all segments without deleted items, whose deletions are then not needed."""
        m = self.manifest()
        path = self._write(spatial.map_order(self.items(m)), "segments")
        n = self._read([path], self.fields(m)).count()
        self.publish(m | {"segments": [path], "sizes": [n], "deletes": []})


def check_declaration(declared: dict[str, str], df: DataFrame) -> list[str]:
    """Findings of a source's schema against its declaration (column to Spark type); no row is read."""
    have = dict(df.dtypes)
    out = [f"missing column {c}" for c in declared if c not in have]
    out += [f"column {c} is {have[c]}, declared {t}" for c, t in declared.items() if c in have and have[c] != t]
    return out + [f"undeclared column {c}" for c in have if c not in declared]


def add_field(df: DataFrame, name: str, kind: str) -> DataFrame:
    """A field declared at run time: absent in every row so far."""
    if name in df.columns:
        raise ValueError(f"{name} is declared already")
    return df.withColumn(name, F.lit(None).cast(kind))
