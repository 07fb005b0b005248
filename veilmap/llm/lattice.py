"""SentencePiece encoding and decoding by a relational lattice.

Words become edges: their substrings of bounded length are exploded and equi-joined to the piece table, edges are grouped
by word, and a Viterbi fold over places keeps, at each place, the one last piece that the model's merges allow after the
best piece before it. For this BPE model the best path is the path whose adjacent pairs all hold (see bpe), so ids equal
the library's; a sum of scores would not give them.

``encode_words_native`` says this in Spark alone (explode, broadcast join to the piece table, groupBy, aggregate).
``Encoder`` is the same plan over the distinct words of an Arrow batch, in columns: words are parted where no piece holds the
two characters side by side (no merge goes over such a place), substrings grow by offset arrays and leave when no piece
begins with them, the join is a probe of a hashed table of pieces and their beginnings, the grouping sorts edges by place,
and the fold takes all words at once, place by place. The queries use the second; the README has the figures of both.

Kept words and parts are bounded by common.KEPT_BYTES, so texts without spaces do not fill the memory.

Defined results: null text is empty and has no ids; decoding gives the text back but for characters that the model itself
changes (its space sign); equal texts and repeated rows each give their row; an empty table gives no rows; columns but doc_id and text
are left out.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common

MODEL = "piece_bpe_32k.model"
_RUNS = re.compile(r" *[^ ]+| +")
_Q = np.uint64(0xD6E8FEB86659FD93)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PairTable:
    """Which pairs of pieces hold, by open addressing; grows by what is met."""

    def __init__(self, bits: int = 21):
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.value = np.zeros(1 << bits, bool)
        self.size = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (common.mix(keys.astype(np.uint64)) & self.mask).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, holds)"""
        slot, out, known = self._slot(keys), np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        left = np.arange(len(keys))
        while len(left):
            at = self.keys[slot[left]]
            hit = at == keys[left]
            known[left[hit]] = True
            out[left[hit]] = self.value[slot[left[hit]]]
            left = left[~hit & (at != -1)]
            slot[left] = (slot[left] + 1) & np.int64(self.mask)
        return known, out

    def put(self, keys: list[int], values: list[bool]) -> None:
        if 2 * (self.size + len(keys)) > len(self.keys):
            self.keys[:] = -1
            self.size = 0
        m = int(self.mask)
        for k, v, s in zip(keys, values, self._slot(np.array(keys, np.int64)).tolist(), strict=True):
            while self.keys[s] not in (-1, k):
                s = (s + 1) & m
            self.keys[s], self.value[s] = k, v
        self.size += len(keys)


class PieceTable:
    """Hashes of pieces and of their beginnings, by open addressing: the piece's number, -1 for a beginning only."""

    def __init__(self, found: dict[int, int]):
        bits = (4 * len(found)).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.piece = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -2, np.int32)
        for h, piece in found.items():
            at = h >> (64 - bits)
            while self.piece[at] != -2:
                at = (at + 1) & int(self.mask)
            self.keys[at], self.piece[at] = h, piece

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece's number, -1 where only longer pieces begin so, -2 where none does."""
        at = (h >> self.shift).astype(np.int64)
        out = np.where(self.keys[at] == h, self.piece[at], -2)
        left = np.flatnonzero((out == -2) & (self.piece[at] != -2))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            hit = self.keys[at] == h[left]
            out[left[hit]] = self.piece[at[hit]]
            more = ~hit & (self.piece[at] != -2)
            left, at = left[more], at[more]
        return out


class Encoder:
    def __init__(self, path: str):
        p = self.pieces = bpe.load(path)
        self.path = path
        self.list = sorted(p.parts)
        begins = {x[:n] for x in self.list for n in range(1, len(x) + 1)}
        number = {x: i for i, x in enumerate(self.list)}
        found = dict(zip(common.mix(np.array([self._rolled(x) for x in begins], np.uint64)).tolist(), (number.get(x, -1) for x in begins), strict=True))
        if len(found) != len(begins):
            raise ValueError("two pieces share a hash")
        self.table_of = PieceTable(found)
        chars = sorted({c for x in self.list for c in x})
        self.kind = np.zeros(0x110000, np.uint16)
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        side = {(ord(a), ord(b)) for x in self.list for a, b in zip(x, x[1:], strict=False)}
        self.meets = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        self.meets[self.kind[[a for a, _ in side]], self.kind[[b for _, b in side]]] = True
        self.ids = np.array([p.id[x] for x in self.list], np.int32)
        self.bytes = np.array(p.byte, np.int32)
        self.table = PairTable()
        self.words, self.parts = common.Kept(), common.Kept()
        self.text_bytes = [t.replace(bpe.SPACE, " ").encode() for t in p.text]
        for b, i in enumerate(p.byte):
            if i >= 0:
                self.text_bytes[i] = bytes([b])

    @staticmethod
    def _rolled(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h + ord(c) + 1) * int(_Q) & 0xFFFFFFFFFFFFFFFF
        return h

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The lattice: (start, end, piece or -1 for a character that is none) in places of the joined words, and where each word begins."""
        code = _codes("".join(words)).astype(np.uint64) + np.uint64(1)
        size = np.array([len(w) for w in words], np.int64)
        begin = np.concatenate([[0], np.cumsum(size)])
        left = np.repeat(begin[1:], size) - np.arange(len(code))  # characters to the word's end
        start, h, out = np.arange(len(code)), np.zeros(len(code), np.uint64), []
        for n in range(1, self.pieces.longest + 1):  # explode: substrings of n characters that some piece begins with
            h = (h + code[start + n - 1]) * _Q
            piece = self.table_of.find(common.mix(h))  # the equi-join
            hit = piece >= 0
            out.append((start[hit], start[hit] + n, piece[hit]))
            if n == 1:
                other = start[piece == -2]
                out.append((other, other + 1, np.full(len(other), -1)))
            more = (piece > -2) & (left[start] > n)
            start, h = start[more], h[more]
            if not len(start):
                break
        s, e, p = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3))
        return s, e, p.astype(np.int64), begin

    def _holds(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        keys = u.astype(np.int64) << 20 | v
        known, out = self.table.get(keys)
        if not known.all():
            new = np.unique(keys[~known])
            value = [self.pieces.holds(self.list[k >> 20], self.list[k & 0xFFFFF]) for k in new.tolist()]
            self.table.put(new.tolist(), value)
            out[~known] = np.array(value)[np.searchsorted(new, keys[~known])]
        return out

    def word_ids(self, words: list[str]) -> list[np.ndarray]:
        """ids of each word (the model's space sign stands for a space)."""
        if not words:
            return []
        s, e, p, begin = self.edges(words)
        n = int(begin[-1])
        word = np.repeat(np.arange(len(words)), np.diff(begin))
        place = e - begin[word[e - 1]]  # group by word, fold place by place
        order = np.argsort(place, kind="stable")
        s, e, p = s[order], e[order], p[order]
        cuts = np.searchsorted(place[order], np.arange(1, int(place.max()) + 2))
        last = np.full(n + 1, -2, np.int64)  # the piece that ends here; places are 1 + index of the character
        back = np.zeros(n + 1, np.int64)
        first = np.zeros(n + 1, bool)
        first[begin[:-1]] = True
        for a, b in zip(cuts, cuts[1:], strict=False):
            ss, ee, pp = s[a:b], e[a:b], p[a:b]
            before = np.where(first[ss], -1, last[ss])
            free = (before < 0) | (pp < 0)
            ok = free.copy()
            if not free.all():
                ok[~free] = self._holds(before[~free], pp[~free])
            last_at = ee[ok]
            last[last_at], back[last_at] = pp[ok], ss[ok]
        out_at, out_id = [], []
        at = begin[1:].copy()
        w = np.arange(len(words))
        rounds = 0
        while len(at):
            out_at.append((w, np.full(len(w), -rounds), at - 1))
            out_id.append(last[at])
            at = back[at]
            more = at > begin[w]
            at, w = at[more], w[more]
            rounds += 1
        W, R, C = (np.concatenate([x[i] for x in out_at]) for i in range(3))
        P = np.concatenate(out_id)
        order = np.lexsort((R, W))
        W, C, P = W[order], C[order], P[order]
        if (P >= 0).all():
            ids, cnt = self.ids[P], np.bincount(W, minlength=len(words))
            return np.split(ids, np.cumsum(cnt)[:-1])
        text = "".join(words)
        lists: list[list[int]] = [[] for _ in words]
        for x, c, q in zip(W.tolist(), C.tolist(), P.tolist(), strict=True):
            lists[x].extend([int(self.ids[q])] if q >= 0 else self.bytes[list(text[c].encode("utf-8", "surrogatepass"))].tolist())
        return [np.array(x, np.int32) for x in lists]

    def learn(self, words: set[str]) -> None:
        """Encode words (without their space) and keep their ids."""
        new = [w for w in words if w not in self.words.of]
        if self.words.make_room(sum(map(len, new)) * 8 + 160 * len(new)):
            new = list(words)
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            for w, ids in zip(part, self.part_by_part([bpe.SPACE + w for w in part]), strict=True):
                self.words.put(w, ids)

    def part_by_part(self, words: list[str]) -> list[bytes]:
        """ids of each word; parts that no piece joins are encoded once and kept."""
        text = "".join(words)
        kind = self.kind[_codes(text)]
        ends = np.cumsum([len(w) for w in words])
        cut = ~self.meets[kind[:-1], kind[1:]]
        cut[ends[:-1] - 1] = True
        at = np.concatenate([np.flatnonzero(cut) + 1, [len(text)]])
        marks = at.tolist()
        parts = [text[a:b] for a, b in zip([0, *marks], marks, strict=False)]
        kept = self.parts.of
        if new := [x for x in set(parts) if x not in kept]:
            if self.parts.make_room(sum(map(len, new)) * 8 + 160 * len(new)):
                new = list(set(parts))
            for x, ids in zip(new, self.word_ids(new), strict=True):
                self.parts.put(x, ids.tobytes())
        found = list(map(kept.__getitem__, parts))
        upto = (np.searchsorted(at, ends) + 1).tolist()
        return [b"".join(found[a:b]) if b - a > 1 else found[a] for a, b in zip([0, *upto], upto, strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids of whole texts, as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        at, size = 0, 0
        for i, t in enumerate(texts):  # a few MB at a time
            size += len(t)
            if size > 1 << 21 or i + 1 == len(texts):
                out[at : i + 1] = self._encode(texts[at : i + 1])
                at, size = i + 1, 0
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        texts = [t.replace(bpe.SPACE, " ") for t in texts]  # to the model both are one sign
        split = [t.split(" ") if t else [] for t in texts]
        words = {w for s in split for w in s}
        words.discard("")
        self.learn(words)
        get, out = self.words.of.__getitem__, []
        for t, s in zip(texts, split, strict=True):
            out.append(b"".join(map(get, s)) if "" not in s else self._spaced(" " + t))
        return out

    def _spaced(self, text: str) -> bytes:
        """A text in which spaces stand together."""
        out, bare = [], self.pieces.id[bpe.SPACE]
        runs = lambda n: np.array(bpe.run_ids(self.path, n), np.int32).tobytes()
        for m in _RUNS.findall(text):
            rest = m.lstrip(" ")
            n = len(m) - len(rest)
            if not rest:
                out.append(runs(n))
                continue
            ids = self.words.of.get(rest)
            if ids is None:
                self.learn({rest})
                ids = self.words.of[rest]
            if n > 1 and int.from_bytes(ids[:4], "little") == bare:
                out.append(runs(n) + ids[4:])
            else:
                out.append(runs(n - 1) + ids)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the space that encoding puts in front."""
        b = b"".join(map(self.text_bytes.__getitem__, ids.tolist()))
        return b[1:].decode("utf-8", "replace") if b[:1] == b" " else b.decode("utf-8", "replace")


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """The piece table: piece, id, rank, and both spines as arrays of (n, own, taken). Its size is the model's."""
    p = bpe.load(path)
    spine = "array<struct<n:int,own:bigint,taken:bigint>>"
    return spark.createDataFrame([(x, p.id[x], p.rank[x], p.left[x], p.right[x]) for x in p.parts], f"piece string, id int, rank bigint, lspine {spine}, rspine {spine}")


def encode_words_native(words: DataFrame, path: str) -> DataFrame:
    """(word, ids) of the distinct values of words.word, in DataFrame operations alone; the word's space is added here.

    Characters that are no piece get id -1 (callers put their bytes).
    """
    spark = words.sparkSession
    longest = bpe.load(path).longest
    w = words.select("word").where("word is not null").distinct().withColumn("sign", F.concat(F.lit(bpe.SPACE), "word")).withColumn("n", F.length("sign"))
    subs = w.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("len", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("n") - F.col("start"))))).withColumn("piece", F.substring(F.col("sign"), F.col("start") + 1, F.col("len")))
    edge = F.struct((F.col("start") + F.col("len")).alias("e"), F.col("start").alias("s"), F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("rank", F.lit(bpe.INF)).alias("rank"), "lspine", "rspine")
    joined = subs.join(F.broadcast(piece_table(spark, path)), "piece", "left").where("id is not null or len = 1")
    grouped = joined.groupBy("word", "n").agg(F.collect_list(edge).alias("edges"))
    kind = "struct<e:int,s:int,id:int,rank:bigint,lspine:array<struct<n:int,own:bigint,taken:bigint>>,rspine:array<struct<n:int,own:bigint,taken:bigint>>>"
    grouped = grouped.withColumn("best", F.expr(f"""
        aggregate(sequence(1, n), array(cast(null as {kind})), (st, i) -> concat(st, slice(filter(edges, v -> v.e = i and (v.s = 0 or v.id < 0 or get(st, v.s).id < 0 or not exists(edges, x ->
            x.s < v.s and x.e > v.s and exists(get(st, v.s).rspine, a -> a.n = v.s - x.s and x.rank < a.taken and exists(v.lspine, b ->
              b.n = x.e - v.s and x.rank <= b.taken and greatest(a.own, b.own) <= least(a.taken, b.taken)))))), 1, 1)))"""))
    return grouped.select("word", F.expr("reverse(aggregate(sequence(1, n), struct(n as at, cast(array() as array<int>) as ids), (acc, i) -> if(acc.at = 0, acc, struct(get(best, acc.at).s as at, concat(acc.ids, array(get(best, acc.at).id)) as ids))).ids)").alias("ids"))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) and text decoded back, for every whole text; null text is empty."""
    common.prepare(docs.sparkSession)

    def run(batches):
        enc = encoder(path)
        for b in common.portions(batches):
            got = enc.encode([x or "" for x in b.column("text").to_pylist()])
            ids = [np.frombuffer(x, np.int32) for x in got]
            off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.frombuffer(b"".join(got), np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(off), pa.array(flat)), pa.array([enc.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of ids as little-endian 32-bit integers), n_chars and whether decoding gives the text."""
    common.prepare(docs.sparkSession)

    def run(batches):
        enc = encoder(path)
        for b in common.portions(batches):
            texts = [x or "" for x in b.column("text").to_pylist()]
            got = enc.encode(texts)
            same = [enc.decode(np.frombuffer(x, np.int32)) == t for x, t in zip(got, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) // 4 for x in got], pa.int64()), pa.array([zlib.crc32(x) for x in got], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_crc32", "n_chars", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens bigint, ids_crc32 bigint, n_chars bigint, round_trip boolean")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole document, decode it again, and return digests of both."""
    return digest_documents(common.table(spark, sf_dir, "documents"), common.tokenizer_path(MODEL))
