"""Toxicity by a small convolutional text classifier: hashed word embeddings, filters over one, two and three words, max
pooling, trained in numpy.

A word is the sum of the embeddings of its hash and of the hashes of its first 4, 5 and 6 bytes, so inflected forms meet.
Embeddings are kept for features of at least MIN_DOCS training documents, in a hash table of fixed size with tags; other
words count as zero. The first dimension starts as the feature's smoothed log odds in the training rows, the rest small;
filters, embeddings and output are then trained by Adam. Gradients flow through the places that win the pooling only.

Training reads at most TRAIN_ROWS labelled documents, those of smallest hash, and of these whole texts up to TRAIN_CHARS
characters together, none longer than a 64th of that (documented bounds of the sample; scoring reads every whole text). Rows that
repeat a doc_id are one. Language, source and id are no inputs of the score. Thresholds per language come from one labelled row
in CALIBRATE, scored by a second model that has not seen them; they are used by ``reject``, not by the score.

Defined results: null and empty texts, and texts without words, get the score of no evidence; null labels are no labels;
without labels of both kinds every score is 0; repeated rows each give their row; an empty table gives no rows; ``reject`` keeps all
columns.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TRAIN_ROWS, TRAIN_CHARS, MIN_DOCS, CALIBRATE, PULL = 6000, 1 << 28, 3, 5, 20.0
DIM, FILTERS, WIDTHS = 8, 6, (1, 2, 3)
BITS = 21
PREFIXES = (4, 5, 6)

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def features(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of each word: hashes of the word and its prefixes, first word of each text). Texts are lower case already."""
    sums, start, end, firsts = common.split_words(parts, _WORD)
    out = np.empty((len(start), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = common.span_hash(sums, start, end)
    for k, n in enumerate(PREFIXES):
        salt = np.uint64(0x5851F42D4C957F2D * (k + 1) & (1 << 64) - 1)
        h = common.mix(common.span_hash(sums, start, np.minimum(start + n, end)) ^ salt)
        out[:, k + 1] = np.where(end - start >= n, h, np.uint64(0))
    return out, firsts


class Model:
    """Embedding rows (row 0 is zero), the hash table to them, filters and output weights."""

    def __init__(self, keys: np.ndarray, emb: np.ndarray, filters: list[np.ndarray], bias: np.ndarray, out: np.ndarray, out_bias: float):
        self.keys, self.emb, self.filters, self.bias, self.out, self.out_bias = keys, emb, filters, bias, out, out_bias
        self._table = None

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def rows(self, feats: np.ndarray) -> np.ndarray:
        """Embedding rows of features; 0 for unknown ones."""
        if self._table is None:
            slot = (self.keys & np.uint64((1 << BITS) - 1)).astype(np.int64)
            row, tag = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.uint32)
            order = np.arange(len(self.keys))[::-1]  # of two features in a slot the more frequent one stays
            row[slot[order]] = order + 1
            tag[slot[order]] = (self.keys[order] >> np.uint64(32)).astype(np.uint32)
            self._table = row, tag
        row, tag = self._table
        at = (feats & np.uint64((1 << BITS) - 1)).astype(np.int64)
        return np.where(tag[at] == (feats >> np.uint64(32)).astype(np.uint32), row[at], 0)

    def project(self) -> np.ndarray:
        """What each embedding row adds at each place of each filter: (rows, places, FILTERS)."""
        return np.concatenate([np.einsum("rd,odf->rof", self.emb, w) for w in self.filters], axis=1).astype(np.float32)

    def score(self, parts: list[bytes]) -> np.ndarray:
        feats, firsts = features(parts)
        if self._table is None or not hasattr(self, "_proj"):
            self._proj = self.project().reshape(len(self.emb), -1)
        rows = self.rows(feats)
        n = len(feats)
        hot = rows.any(axis=1)  # most words are unknown: their row is zero
        pooled = np.zeros((len(parts), len(WIDTHS) * FILTERS), np.float32)
        doc = np.repeat(np.arange(len(parts)), np.diff(firsts))
        at = np.flatnonzero(hot)
        val = self._proj[rows[at, 0]]
        for k in range(1, rows.shape[1]):
            val = val + self._proj[rows[at, k]]
        col = 0
        for k, w in enumerate(WIDTHS):
            z = np.zeros((n + w, FILTERS), np.float32)
            for o in range(w):
                # the filter that begins at place p reads word p + o; places stay inside the text
                p = at - o
                ok = (p >= 0) & (doc[np.maximum(p, 0)] == doc[at])
                z[p[ok]] += val[ok, (col + o) * FILTERS : (col + o + 1) * FILTERS]
            cells = np.maximum(z[:n] + self.bias[k], 0)
            if n:
                some = np.flatnonzero(np.diff(firsts) > 0)
                pooled[some, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(cells, firsts[:-1][some], axis=0)
            col += w
        logit = np.clip(pooled @ self.out + self.out_bias, -30, 30)
        return 1 / (1 + np.exp(-logit.astype(np.float64)))


def train(texts: list[str], labels: np.ndarray, seed: int = 11, epochs: int = 30) -> Model | None:
    """Fit the classifier; None unless there are rows of both labels."""
    y = np.asarray(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    docs: list[np.ndarray] = []
    for _, parts in common.blocks([(t or "").lower() for t in texts]):
        f, firsts = features(parts)
        docs += [d.copy() for d in np.split(f, firsts[1:-1])]
    seen = [np.unique(d) for d in docs]
    lab = np.repeat(y > 0, [len(s) for s in seen])
    every = np.concatenate(seen)
    del seen
    keys, inv, df = np.unique(every, return_inverse=True, return_counts=True)
    pos = np.bincount(inv[lab], minlength=len(keys)).astype(np.float64)
    del every, inv, lab
    keep = (df >= MIN_DOCS) & (keys != 0)
    keys, df, pos = keys[keep], df[keep], pos[keep]
    n1, n0 = y.sum(), len(y) - y.sum()
    odds = np.log((pos + 0.05) / (n1 + 0.1)) - np.log((df - pos + 0.5) / (n0 + 1.0))
    odds = odds * df / (df + 4.0)
    use = np.abs(odds) > 0.7  # the others say nothing: they stay at zero
    order = np.argsort(-df[use], kind="stable")
    keys, odds = keys[use][order], odds[use][order]
    emb = np.concatenate([np.zeros((1, DIM)), np.column_stack([np.clip(odds, -2, 4) / 4, rng.normal(0, 0.05, (len(keys), DIM - 1))])])
    filters = [rng.normal(0, 0.15, (w, DIM, FILTERS)) for w in WIDTHS]
    for f in filters:
        f[:, 0, : FILTERS // 2] += 1.0 / len(f)
    bias = [np.full(FILTERS, -0.05) for _ in WIDTHS]
    out, out_b = np.full(len(WIDTHS) * FILTERS, 0.5), np.zeros(1)
    model = Model(keys, emb, filters, np.array(bias), out, 0.0)
    alive: list[np.ndarray] = []  # unknown words are zero everywhere: training skips them
    for i, d in enumerate(docs):
        r = model.rows(d)
        alive.append(r[r.any(axis=1)].astype(np.int32))
        docs[i] = d[:0]  # the features go as their rows come
    params = {"emb": emb, "out": out, "out_b": out_b} | {f"f{k}": f for k, f in enumerate(filters)} | {f"b{k}": b for k, b in enumerate(bias)}
    m1 = {k: np.zeros_like(v) for k, v in params.items()}
    m2 = {k: np.zeros_like(v) for k, v in params.items()}
    weight = np.where(y > 0, min(4.0, n0 / n1), 1.0)
    step = 0
    pad = max(WIDTHS) - 1
    for epoch in range(epochs):
        for batch in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            step += 1
            size = np.array([len(alive[i]) + pad for i in batch])
            begin = np.concatenate([[0], np.cumsum(size)])[:-1]
            flat = np.zeros((size.sum(), 1 + len(PREFIXES)), np.int64)
            for b, i in zip(begin, batch, strict=True):
                flat[b : b + len(alive[i])] = alive[i]
            x = emb[flat].sum(axis=1)
            pooled, where = [], []
            for k, w in enumerate(WIDTHS):
                z = sum(np.concatenate([x[o:], np.zeros((o, DIM))]) @ filters[k][o] for o in range(w)) + bias[k]
                top = np.maximum.reduceat(z, begin, axis=0)
                hit = z == np.repeat(top, size, axis=0)
                first = np.array([np.argmax(hit[b : b + s], axis=0) for b, s in zip(begin, size, strict=True)]) + begin[:, None]
                pooled.append(np.maximum(top, 0))
                where.append(first)
            p = np.concatenate(pooled, axis=1)
            logit = np.clip(p @ out + out_b[0], -30, 30)
            err = (1 / (1 + np.exp(-logit)) - y[batch]) * weight[batch] / len(batch)
            grad = {k: np.zeros_like(v) for k, v in params.items()}
            grad["out"], grad["out_b"] = p.T @ err + 1e-4 * out, np.array([err.sum()])
            gx = np.zeros_like(x)
            for k, w in enumerate(WIDTHS):
                g = (err[:, None] * out[k * FILTERS : (k + 1) * FILTERS]) * (pooled[k] > 0)
                grad[f"b{k}"] = g.sum(axis=0)
                for o in range(w):
                    at = np.minimum(where[k] + o, len(x) - 1)
                    live = g * (where[k] + o < len(x))
                    grad[f"f{k}"][o] = np.einsum("bfd,bf->df", x[at], live)
                    np.add.at(gx, at.ravel(), (live[:, :, None] * filters[k][o].T[None]).reshape(-1, DIM))
            used = np.flatnonzero(np.abs(gx).sum(axis=1))
            np.add.at(grad["emb"], flat[used].ravel(), np.repeat(gx[used], flat.shape[1], axis=0))
            grad["emb"][0] = 0
            rate = 0.02 * (1 - epoch / epochs) + 0.002
            for k, v in params.items():
                m1[k] += 0.1 * (grad[k] - m1[k])
                m2[k] += 0.01 * (grad[k] ** 2 - m2[k])
                v -= (0.2 if k == "emb" else 1.0) * rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    return Model(keys, emb.astype(np.float32), [f.astype(np.float32) for f in filters], np.array(bias, np.float32), out.astype(np.float32), float(out_b[0]))


def held_out(doc_id):
    """Rows that training never reads: crc32 of the id as text is divisible by 5. Rows without an id are never read either."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, calibrate: bool = True) -> tuple[Model | None, dict[str, float]]:
    """The model, from labelled documents that are not held out, and thresholds by language (none where not calibrate)."""
    lab = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    chosen = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = common.materialise(chosen, "toxic-labels")
    common.prepare(docs.sparkSession)

    def run(batches):
        got = sorted((r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "lang", "toxic")), strict=True)), key=lambda r: (r[0], r[1] or ""))
        if got:
            made = train([r[1] or "" for r in got], np.array([r[3] for r in got])), thresholds_of(got) if calibrate else {}
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], ["fitted"])

    # most rows and TRAIN_CHARS characters at most, in one task: the driver gets what is fitted alone
    own = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id").where(F.coalesce(F.length("text"), F.lit(0)) <= TRAIN_CHARS // 64)
    own = own.groupBy("doc_id").agg(F.min(F.struct("text", "lang", "toxic")).alias("r")).select("doc_id", "r.*")
    own = common.materialise(own, "toxic-rows")
    upto = F.sum(F.coalesce(F.length("text"), F.lit(0))).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    rows = own.join(F.broadcast(own.select("doc_id", upto.alias("upto")).where(F.col("upto") <= TRAIN_CHARS).select("doc_id")), "doc_id", "left_semi")
    made = rows.select("doc_id", "text", "lang", "toxic").repartition(1).mapInArrow(run, "fitted binary").first()
    return pickle.loads(bytes(made["fitted"])) if made else (None, {})


def thresholds_of(rows: list[tuple]) -> dict[str, float]:
    """Thresholds by language, from sorted rows of doc_id, text, lang and label.

    A language's threshold is that of fewest errors among rows that a model of the other rows scores; each PULL-th of the way from
    0.5 must spare an error, so few rows move it little, at any size of the sample.
    """
    apart = [r for i, r in enumerate(rows) if i % CALIBRATE == CALIBRATE - 1]
    used = [r for i, r in enumerate(rows) if i % CALIBRATE != CALIBRATE - 1]
    model = train([r[1] or "" for r in used], np.array([r[3] for r in used]))
    thresholds: dict[str, float] = {}
    if model and apart:
        score = np.concatenate([model.score(p) for _, p in common.blocks([(r[1] or "").lower() for r in apart])])
        cuts = np.linspace(0.3, 0.9, 61)
        for lang in {r[2] for r in apart if r[2] is not None}:
            own = np.array([r[2] == lang for r in apart])
            s, y = score[own], np.array([r[3] for r in apart])[own]
            errors = np.array([((s >= c) != (y > 0)).sum() for c in cuts]) + PULL * np.abs(cuts - 0.5)
            thresholds[lang] = float(cuts[errors.argmin()])
    return thresholds


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs and a column tox_score of every whole text."""
    spark = docs.sparkSession
    common.prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in common.portions(batches):
            m = shared.value
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            got = [m.score(p) for _, p in common.blocks([(x or "").lower() for x in texts])] if m else [np.zeros(len(texts))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64())], [*b.schema.names, "tox_score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("tox_score", DoubleType())]))


def reject(docs: DataFrame, model: Model | None, thresholds: dict[str, float], default: float = 0.5) -> DataFrame:
    """The rows of docs whose score is below the threshold of their language."""
    cut = F.lit(default)
    for lang, t in sorted(thresholds.items()):
        cut = F.when(F.col("lang") == lang, F.lit(t)).otherwise(cut)
    return score_documents(docs, model).where(F.col("tox_score") < F.coalesce(cut, F.lit(default))).drop("tox_score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole document."""
    docs = common.table(spark, sf_dir, "documents")
    model, _ = fit(docs, common.table(spark, sf_dir, "labels"), calibrate=False)
    got = score_documents(docs.select("doc_id", "text"), model)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"))
