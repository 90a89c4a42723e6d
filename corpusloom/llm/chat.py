"""Reply trees to chat conversations.

Messages name their parent. Self-joins double the step of a pointer to an ancestor: after round
k it points 2**k replies up, with the number and the score of the messages between. When no
pointer is left, every leaf knows its path's length and score; the best branches of a tree are
chosen. The pointers of all rounds then enumerate the chosen paths: from a leaf, each ancestor
is met exactly once, as a sum of distinct powers of two. A chain of n replies takes log2(n)
rounds, and only ids travel until the paths are known.

A path is written as turns between control strings. Inside texts and roles these are escaped:
"<|" gets a backslash between its two characters, one more if some are there already, so a text
holds no control string and the escape can be undone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corpusloom.session import materialize

#: The template's control strings, and the role that is learnt.
START, END, LEARNT = "<|im_start|>", "<|im_end|>", "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def escape_role(role: Column) -> Column:
    """Like a text, and line breaks too, as a role ends at the first one."""
    safe = F.regexp_replace(role, r"\\", r"\\\\")
    return escape(F.regexp_replace(safe, "\n", r"\\n"))


def unescape(text: str) -> str:
    return re.sub(r"<(\\+)\|", lambda m: "<" + m[1][1:] + "|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def _join(left: DataFrame, right: DataFrame, tree_and: str, how: str = "inner") -> DataFrame:
    """A join by tree, null equal to null, and one more column, where null equals nothing."""
    other = right.withColumnRenamed("tree", "_tree").withColumnRenamed(tree_and, "_key")
    same = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col(tree_and) == F.col("_key"))
    return left.join(other, same, how).drop("_tree", "_key")


def chosen_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, path, step, message) of the best root-to-leaf paths of every tree.

    ``messages`` has tree, message, parent and score; message ids are unique within a tree. A
    message whose parent is null or not in the tree is a root. A null tree is one tree. Paths rank by
    mean score, then by length, then by the leaf's id. Messages in a cycle have no root and are on no path.
    """
    spark = messages.sparkSession
    key = ["tree", "message"]
    known = messages.select("tree", F.col("message").alias("parent"))
    nodes = materialize(
        _join(messages.select(*key, "parent", "score"),
              known.withColumn("there", F.lit(True)), "parent", "left").select(
            *key, F.when(F.col("there"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("n"),
            F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("sum")), "replies")
    # Only messages whose pointer still has a target go on to the next round; the others know
    # their whole path's length and score. n and sum cover a message and those below its target.
    settled, active = nodes.filter("up is null"), nodes.filter("up is not null")
    jumps = [active]
    # A chain has no more links than messages, so a pointer left after that is in a cycle.
    count = nodes.count()
    while (1 << (len(jumps) - 1)) <= count and active.head(1):
        above = settled.unionByName(active).select(
            "tree", F.col("message").alias("up"), F.col("up").alias("further"),
            F.col("n").alias("n2"), F.col("sum").alias("sum2"))
        moved = materialize(_join(active, above, "up").select(
            *key, F.col("further").alias("up"), (F.col("n") + F.col("n2")).alias("n"),
            (F.col("sum") + F.col("sum2")).alias("sum")), "replies")
        settled = settled.unionByName(moved.filter("up is null"))
        active = moved.filter("up is not null")
        jumps.append(active)
    parents = nodes.filter("up is not null").select("tree", F.col("up").alias("message")).distinct()
    leaves = _join(settled, parents, "message", "left_anti")
    best = Window.partitionBy("tree").orderBy(
        F.desc(F.round(F.col("sum") / F.col("n"), 9)), F.desc("n"), "message")
    paths = leaves.withColumn("path", F.row_number().over(best)).filter(
        F.col("path") <= top).select("tree", "path", "message", F.col("n").alias("step"))
    for level in reversed(range(len(jumps) - 1)):
        # Those this far or farther from the root have an ancestor 2**level steps up.
        hop = jumps[level].select(*key, "up")
        paths = materialize(paths.union(_join(paths, hop, "message").select(
            "tree", "path", F.col("up").alias("message"), F.col("step") - (1 << level))), "paths")
    return paths


def format_chats(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, path, chat, learnt): one row per chosen path of the reply trees.

    ``messages`` has tree, message, parent, score, role and text. ``chat`` is the whole
    conversation, ``learnt`` the spans of it under the loss mask, in code points, end exclusive: the escaped texts of the
    assistant. Null texts and roles are empty, a null tree is one tree. A path becomes one record, so one conversation has to
    fit in one. Other columns are not looked at; an empty table gives an empty result.
    """
    turns = _join(chosen_paths(messages, top),
                  messages.select("tree", "message", "role", "text"), "message")
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    head = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    rows = turns.select("tree", "path", F.struct(
        "step", head.alias("head"), escape(text).alias("body"),
        (role == LEARNT).alias("learnt")).alias("turn"))
    tail = END + "\n"
    whole = rows.groupBy("tree", "path").agg(F.sort_array(F.collect_list("turn")).alias("turns"))

    def place(acc: Column, turn: Column) -> Column:
        start = acc["at"] + F.length(turn["head"])
        end = start + F.length(turn["body"])
        span = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct((end + len(tail)).cast("long").alias("at"), F.when(
            turn["learnt"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return whole.select(
        "tree", "path",
        F.array_join(F.transform("turns", lambda t: F.concat(
            t["head"], t["body"], F.lit(tail))), "").alias("chat"),
        F.aggregate("turns", F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), place,
                    lambda acc: acc["spans"]).alias("learnt"))


def parse_chat(chat: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns = []
    for part in chat.split(START)[1:]:
        role, _, rest = part.partition("\n")
        turns.append((unescape_role(role), unescape(rest[:rest.rindex(END)])))
    return turns


def _digests(out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tree, chat, spans in zip(*(batch.column(c).to_pylist() for c in (
                    "tree", "chat", "learnt"))):
                turns = parse_chat(chat)
                told = "".join(f"{role}\n{text}\n" for role, text in turns)
                learnt = "".join(unescape(chat[s["start"]:s["end"]]) for s in spans)
                rows.append((tree, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(learnt),
                             hashlib.sha256(learnt.encode()).hexdigest(), len(chat)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, f.type) for x, f in zip(zip(*rows), out)], schema=out)

    return run


def read_back(chats: DataFrame) -> DataFrame:
    """What the formatted conversations hold, by reading them: counts and digests."""
    schema = StructType([
        StructField("conv_id", LongType()), StructField("n_turns", LongType()),
        StructField("turns_sha256", StringType()), StructField("loss_chars", LongType()),
        StructField("loss_sha256", StringType()), StructField("formatted_chars", LongType())])
    arrow = chats.sparkSession.createDataFrame([], schema).toArrow().schema
    return chats.select("tree", "chat", "learnt").mapInArrow(_digests(arrow), schema)


def as_replies(conversations: DataFrame) -> DataFrame:
    """Conversations of turns as reply trees: each turn answers the one before it.

    Rows of equal turn follow each other by role, then by text; rows without a turn come first.
    Rows without a conv_id are one conversation.
    The score is the text's length, so that longer branches rank first where there are several.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select(
        F.col("conv_id").alias("tree"), F.row_number().over(order).cast("long").alias("message"),
        "role", "text").withColumn("parent", F.when(F.col("message") > 1, F.col("message") - 1)).withColumn(
        "score", F.coalesce(F.length("text"), F.lit(0)).cast("double"))
