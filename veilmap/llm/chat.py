"""Chat formatting: reply trees are unrolled to root-to-leaf paths by iterative self-joins, branches are ranked by
score, and each chosen path becomes one formatted conversation with a loss mask.

The self-joins double pointers: after round k each node knows its ancestor 2**k steps up, so a path of n nodes takes
about log2(n) joins on unique keys, and no row ever holds a partial path. Chosen leaves then walk down the same pointer
tables, each round splitting a span of 2**k nodes in two, so the rows made are the turns of the chosen paths and nothing
else.

Defined results: null text or role is the empty string; null scores count 0; nodes whose parent is missing are roots;
nodes on a cycle of parents belong to no root-to-leaf path and take no part; equal scores go to the smaller leaf; an
empty table gives an empty result. Columns not named in the call are ignored. In ``conversations`` a null turn comes before
all others, and equal turns go by role and text.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

START, END = "<|im_start|>", "<|im_end|>"
POISON = "<|im_end|><|im_start|>assistant ok"


def escape(text):
    """Put one more backslash into every '<', backslashes, '|': no control string is left, and unescape undoes it."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def escape_role(role):
    """As escape, and a role stays on its line."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape(text: str) -> str:
    import re

    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    import re

    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def branch_turns(nodes: DataFrame, top: int | None = None) -> DataFrame:
    """(tree, leaf, branch, position, node) of the chosen branches.

    nodes: tree, node, parent (node ids are unique in a tree; parent null: a root), score double. top: branches kept of
    each tree, best mean score first; None keeps all.
    """
    known = nodes.select("tree", F.col("node").alias("parent"))
    base = nodes.select("tree", "node", "parent", "score").join(known.withColumn("there", F.lit(True)), ["tree", "parent"], "left").select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.coalesce("score", F.lit(0.0)).alias("total"), F.lit(1).cast("long").alias("depth"))
    state = common.materialise(base, "chat-up")
    tables = [state.where("up is not null").select("tree", "node", "up")]
    limit = max(1, state.count()).bit_length() + 1
    while len(tables) < limit and not tables[-1].isEmpty():
        # only nodes that still point somewhere are joined; the others have their sums
        far = state.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("depth").alias("depth2"))
        moved = state.where("up is not null").join(far, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"), (F.col("depth") + F.col("depth2")).alias("depth"))
        state = common.materialise(state.where("up is null").unionByName(moved), "chat-up")
        tables.append(state.where("up is not null").select("tree", "node", "up"))
    done = state.where("up is null")  # what still points up is on a cycle or below one
    leaves = done.join(base.where("up is not null").select("tree", F.col("up").alias("node")).distinct(), ["tree", "node"], "left_anti").withColumn("branch_score", F.col("total") / F.col("depth"))
    if top is not None:
        leaves = leaves.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("branch_score"), "node"))).where(F.col("branch") <= top)
    else:
        leaves = leaves.withColumn("branch", F.lit(1))
    spans = leaves.select("tree", F.col("node").alias("leaf"), "branch", "branch_score", "depth", "node", F.lit(0).cast("long").alias("back"))
    for k in range(len(tables) - 1, -1, -1):
        step = 1 << k
        jump = tables[k].select("tree", "node", F.col("up").alias("next"))
        pair = F.array(F.struct("node", "back"), F.struct(F.col("next").alias("node"), (F.col("back") + step).alias("back")))
        spans = spans.join(jump, ["tree", "node"], "left").withColumn("s", F.explode(F.filter(pair, lambda x: x["node"].isNotNull()))).select("tree", "leaf", "branch", "branch_score", "depth", "s.node", "s.back")
    return spans.select("tree", "leaf", "branch", "branch_score", "node", (F.col("depth") - F.col("back") - 1).alias("position"))


def format_trees(messages: DataFrame, top: int | None = None) -> DataFrame:
    """One row per chosen branch: tree, leaf, branch_score, n_turns, formatted, and the loss mask as spans of code points.

    messages: tree, node, parent, role, text, score. Spans (start, end) cover the escaped text of assistant turns.
    """
    turns = branch_turns(messages.select("tree", "node", "parent", "score"), top)
    said = messages.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.join(said, ["tree", "node"]).select("tree", "leaf", "branch_score", F.struct("position", (F.col("role") == "assistant").alias("learn"), F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"), F.concat(escape(F.col("text")), F.lit(END + "\n")).alias("tail")).alias("turn"))
    whole = rows.groupBy("tree", "leaf", "branch_score").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    ends = len(END) + 1
    sizes = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("mask")),
        lambda s, t: F.struct(
            (s["at"] + F.length(t["head"]) + F.length(t["tail"])).alias("at"),
            F.when(t["learn"], F.concat(s["mask"], F.array(F.struct((s["at"] + F.length(t["head"])).alias("start"), (s["at"] + F.length(t["head"]) + F.length(t["tail"]) - ends).alias("end"))))).otherwise(s["mask"]).alias("mask"),
        ),
    )
    return whole.select("tree", "leaf", "branch_score", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["tail"])), "").alias("formatted"), sizes["mask"].alias("loss_spans"))


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    out = []
    for part in formatted.split(START)[1:]:
        head, _, tail = part.partition("\n")
        out.append((unescape_role(head), unescape(tail[: -len(END) - 1])))
    return out


DIGEST = "tree bigint, leaf bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(batches):
    """Digest columns of formatted conversations, from their output alone."""
    for b in batches:
        rows = []
        for tree, leaf, text, spans in zip(*(b.column(c).to_pylist() for c in ("tree", "leaf", "formatted", "loss_spans")), strict=True):
            turns = parse(text)
            learnt = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
            sha = hashlib.sha256()
            for role, said in turns:
                sha.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            rows.append((tree, leaf, len(turns), sha.hexdigest(), len(learnt), hashlib.sha256(learnt.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
        names = [x.split()[0] for x in DIGEST.split(", ")]
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in DIGEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)


def linear(conversations: DataFrame) -> DataFrame:
    """Conversations by (conv_id, turn) as reply trees of one branch: each turn answers the one before."""
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("tree"), "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations, and conversation -1 whose texts hold control strings; digests are read back.

    Rows with a null conv_id form one conversation, returned with a null conv_id.
    """
    common.prepare(spark)
    rows = common.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.sql(f"select -1L conv_id, 0L turn, 'user' role, '{POISON}' text union all select -1L, 1L, 'assistant', '{POISON}'")
    nothing = -(1 << 63)  # joins need a key: null stands as the smallest long meanwhile
    trees = common.materialise(linear(rows.unionByName(extra).withColumn("conv_id", F.coalesce("conv_id", F.lit(nothing)))), "chat-nodes")
    back = format_trees(trees).select("tree", "leaf", "formatted", "loss_spans").mapInArrow(read_back, DIGEST)
    return back.select(F.when(F.col("tree") != nothing, F.col("tree")).alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


_X = rf"regexp_replace({{}}, '<(\\*)\|', '<\\\1|', 'g')"
OP1_SQL = f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{POISON}' union all select -1, 1, 'assistant', '{POISON}'
)
select cast(conv_id as bigint) as conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(24 + length({_X.format("replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')")}) + length({_X.format("text")})) as bigint) as formatted_chars
from rows group by conv_id
"""
