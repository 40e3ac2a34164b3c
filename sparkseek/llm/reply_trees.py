"""Chat formatting from reply trees. DataFrame code only.

Iterative self-joins double the reach of every message's ancestor pointer, so a tree of depth d takes log2(d)
rounds: they sum each path's score, rank the branches of a conversation, and enumerate the root-to-leaf path of each
chosen leaf. Only keys and scores go through the rounds; texts join once, at the end. Each path becomes one string.

Template: a turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. In roles and texts ``\\`` becomes ``\\b`` and ``<|``
becomes ``<\\p``, in roles a newline becomes ``\\n``; so no control string survives inside a turn, and undoing the three
in the order n, p, b restores the text exactly.

Defined cases: null role and text are empty; each row with a null conversation key is a conversation of its own; a message whose
parent is null or missing is a root; repeated (conversation, id) rows count once, the least (role, text) first; messages
on a cycle of parents have no root and so are on no path; equal branch scores prefer the deeper leaf, then the smaller
id. A conversation is one string, so its turns do meet in one row. Columns not named are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkseek.llm._common import cut, drop

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\p"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\n"), F.lit("\n")) if role else text
    return F.replace(F.replace(out, F.lit("<\\p"), F.lit("<|")), F.lit("\\b"), F.lit("\\"))


def branches(nodes: DataFrame, top: int = 1) -> DataFrame:
    """``nodes(conv, id, parent, score)`` -> ``(conv, leaf, id, pos)``: the paths of the ``top`` best branches of each conversation.

    ``conv`` is a non-null string, ``(conv, id)`` unique. A branch's score is the mean score of its messages.
    """
    nodes = cut(nodes)
    most = nodes.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    rounds = math.ceil(math.log2(most + 1)) if most else 0
    parents = nodes.select("conv", F.col("id").alias("parent"), F.lit(True).alias("_is"))
    reach = nodes.join(parents, ["conv", "parent"], "left").select(
        "conv", "id", F.when(F.col("_is"), F.col("parent")).alias("up"),
        F.coalesce("_is", F.lit(False)).cast("long").alias("d"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("s"),
    )
    reach, jumps = cut(reach), []
    for _ in range(rounds):
        jumps.append(reach)
        up = reach.select("conv", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("d").alias("d2"), F.col("s").alias("s2"))
        reach = reach.join(up, ["conv", "up"], "left").select(
            "conv", "id", F.col("up2").alias("up"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"), (F.col("s") + F.coalesce("s2", F.lit(0.0))).alias("s")
        )
        reach = cut(reach)
    inner = nodes.filter("parent is not null").select("conv", F.col("parent").alias("id")).distinct()
    leaves = reach.filter("up is null").join(inner, ["conv", "id"], "left_anti")
    best = Window.partitionBy("conv").orderBy((F.col("s") / (F.col("d") + 1)).desc(), F.col("d").desc(), "id")
    leaves = cut(leaves.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= top))
    path = leaves.select("conv", F.col("id").alias("leaf"), "id", F.col("d").alias("pos"))
    for k, jump in enumerate(jumps):
        far = path.join(jump.filter("up is not null").select("conv", "id", "up"), ["conv", "id"])
        longer = cut(path.union(far.select("conv", "leaf", F.col("up").alias("id"), F.col("pos") - 2**k)))
        drop(path)
        path = longer
    return path


def format_paths(messages: DataFrame, paths: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``messages(conv, id, role, text, carry...)`` and :func:`branches` -> one row per path.

    Columns: conv, leaf, carry, ``formatted`` and ``loss_spans``, an array of (lo, hi) code point offsets of the
    escaped assistant texts in ``formatted``.
    """
    carry = carry or []
    role, text = escape(F.coalesce("role", F.lit("")), True), escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    rows = paths.join(messages, ["conv", "id"]).select("conv", "leaf", "pos", *carry, F.concat(head, text, F.lit(END + "\n")).alias("piece"), F.length(head).alias("h"), F.length(text).alias("t"), (F.col("role") == "assistant").alias("loss"))
    before = Window.partitionBy("conv", "leaf").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("lo", F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)) + F.col("h"))
    turn = F.struct("pos", "piece", "lo", (F.col("lo") + F.col("t")).alias("hi"), "loss")
    whole = rows.groupBy("conv", "leaf").agg(F.sort_array(F.collect_list(turn)).alias("_t"), *[F.first(c, True).alias(c) for c in carry])
    spans = F.transform(F.filter("_t", lambda x: x.loss), lambda x: F.struct(x.lo.alias("lo"), x.hi.alias("hi")))
    return whole.select("conv", "leaf", *carry, F.array_join(F.transform("_t", lambda x: x.piece), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """Array of (role, text) parsed from a formatted conversation."""
    body = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda x: x != "")
    role = lambda x: F.substring_index(x, "\n", 1)
    return F.transform(body, lambda x: F.struct(unescape(F.substr(role(x), F.lit(len(START) + 1)), True).alias("role"), unescape(F.substr(x, F.length(role(x)) + 2)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s.lo.cast("int") + 1, (s.hi - s.lo).cast("int")))), "")


def conversation_key(col: Column, *row: Column) -> Column:
    """A string that is never null; without a conversation, the row's own values make one."""
    own = F.sha2(F.to_json(F.struct(*[c.alias(f"c{k}") for k, c in enumerate(row)])), 256)
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.concat(F.lit("null"), own))


def format_trees(messages: DataFrame, conv: str = "conv_id", id: str = "msg_id", parent: str = "parent_id", score: str | None = None, top: int = 1) -> DataFrame:
    """Format the ``top`` best branches of each reply tree: the conversation key, ``leaf``, ``formatted``, ``loss_spans``."""
    rows = messages.select(conversation_key(F.col(conv), F.col(id), F.col("role"), F.col("text")).alias("conv"), F.col(conv).alias("_key"), F.col(id).alias("id"), F.col(parent).alias("parent"), (F.col(score) if score else F.lit(0.0)).alias("score"), "role", "text")
    least = F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "parent", "score", "_key")).alias("m")
    rows = cut(rows.filter("id is not null").groupBy("conv", "id").agg(least).select("conv", "id", "m.*"))
    paths = branches(rows.select("conv", "id", "parent", "score"), top)
    return format_paths(rows.drop("parent", "score"), paths, ["_key"]).select(F.col("_key").alias(conv), "leaf", "formatted", "loss_spans")


def as_tree(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Linear conversations as trees: each row replies to the row before it, by turn, then role, then text."""
    order = Window.partitionBy(conversation_key(F.col(conv), F.col(turn), F.col("role"), F.col("text"))).orderBy(turn, "role", "text")
    rows = turns.withColumn("msg_id", F.row_number().over(order).cast("long"))
    return rows.withColumn("parent_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1))
