"""Chat formatting of reply trees, with DataFrame functions only.

Turns form trees: a turn may have several replies. ``paths`` enumerates root-to-leaf paths
by iterative self-joins that double the distance: round k knows each turn's ancestor 2^k
steps up, so a path of n turns takes about log2(n) rounds, each written to the shared
folder. ``best`` ranks a tree's branches by score (the mean of their turns' scores), then
by length, then by leaf, and keeps the first ones. ``formatted`` writes each kept path as
one conversation, with the spans (in code points) of what a model should learn: the
assistant's texts.

A turn reads ``<|im_start|>role<|im_sep|>text<|im_end|>``. In roles and texts a backslash
becomes two, and a control string gets a backslash after its first character, so that no
control string is left inside and removing one backslash of each restores the text.

Null texts and roles count as empty. Turns are ordered by turn, then role, then text;
repeated rows are turns of their own. Null turns come first. A null conv_id is a
conversation like any other. Very long texts are escaped and read back whole. An empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of this template and of others that are escaped too.
_CONTROL = r"<(?=\|im_(?:start|sep|end)\|>|/?s>|\|endoftext\|>)|\[(?=/?INST\])"
_SQL_CONTROL = r"<\|im_(?:start|sep|end)\|>|</?s>|\[/?INST\]|<\|endoftext\|>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\"), _CONTROL, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def paths(nodes: DataFrame) -> DataFrame:
    """leaf, node and height (0 at the leaf) for every turn of every root-to-leaf path.

    nodes(node, parent): node is unique, parent null at a root or naming an existing node.
    """
    links = nodes.select("node", "parent")
    parents = links.where("parent is not null")
    leaves = links.join(parents.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")
    found = leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("height"))
    up = staged(parents.select("node", F.col("parent").alias("above")), "up")
    step = 1
    while not up.isEmpty():
        higher = found.join(up, "node").select("leaf", F.col("above").alias("node"), (F.col("height") + step).alias("height"))
        found = staged(found.unionByName(higher), "paths")
        further = up.withColumnRenamed("above", "middle").join(up.withColumnRenamed("node", "middle"), "middle")
        up = staged(further.select("node", "above"), "up")
        step *= 2
    return found


def best(found: DataFrame, nodes: DataFrame, branches: int = 1) -> DataFrame:
    """The rows of paths(nodes) that belong to a tree's first branches. nodes(node, tree, score)."""
    scored = found.join(nodes.select("node", "tree", "score"), "node")
    ranked = scored.groupBy("tree", "leaf").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("turns"))
    place = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("turns"), "leaf"))
    chosen = ranked.withColumn("rank", place).where(F.col("rank") <= branches).select("leaf", "rank")
    return found.join(chosen, "leaf")


def formatted(chosen: DataFrame, nodes: DataFrame) -> DataFrame:
    """tree, rank, formatted and learn (start and end of what is learnt) of each chosen path.

    chosen(leaf, rank, node, height); nodes(node, tree, role, text).
    """
    rows = chosen.join(nodes.select("node", "tree", "role", "text"), "node")
    role, text = escaped(F.col("role")), escaped(F.col("text"))
    rows = rows.select("tree", "leaf", "rank", "height", "role", F.concat(F.lit(START), role, F.lit(SEP)).alias("head"), F.concat(text, F.lit(END)).alias("tail"))
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("height")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("head") + F.length("tail")).over(before), F.lit(0)))
    start = F.col("at") + F.length("head")
    learn = F.when(F.col("role") == "assistant", F.struct(start.alias("start"), (start + F.length("tail") - len(END)).alias("end")))
    rows = rows.select("tree", "leaf", "rank", "at", F.concat("head", "tail").alias("piece"), learn.alias("learn"))
    whole = rows.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("pieces"), F.sort_array(F.collect_list("learn")).alias("learn"))
    return whole.select("tree", "rank", F.array_join(F.col("pieces.piece"), "").alias("formatted"), "learn")


def read_back(done: DataFrame) -> DataFrame:
    """done with turns (role, text) and learnt (the text under the mask), both unescaped."""
    pieces = F.split("formatted", r"<\|im_start\|>", -1)
    turns = F.transform(
        F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: F.struct(
            unescaped(F.substring_index(p, SEP, 1)).alias("role"),
            unescaped(F.substring_index(F.substring_index(p, SEP, -1), END, 1)).alias("text"),
        ),
    )
    learnt = F.transform("learn", lambda s: unescaped(F.substr(F.col("formatted"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))))
    return done.withColumn("turns", turns).withColumn("learnt", F.array_join(learnt, ""))


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """Rows by turn as trees without branches: node, parent, tree, score, role, text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.withColumn("place", F.row_number().over(order).cast("long"))
    node = F.struct("conv_id", "place")
    above = F.when(F.col("place") > 1, F.struct("conv_id", (F.col("place") - 1).alias("place")))
    # A node's name is text, so that a null conv_id joins like any other.
    return rows.select(F.to_json(node).alias("node"), F.to_json(above).alias("parent"), F.col("conv_id").alias("tree"), F.lit(0.0).alias("score"), "role", "text")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    nodes = staged(conversation_nodes(rows.unionByName(extra)), "nodes")
    done = read_back(formatted(best(paths(nodes), nodes), nodes))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP10_SQL = rf"""
WITH rows AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM rows
), sized AS (
  SELECT *, length(role) + length(text) + {len(START) + len(SEP) + len(END)}
    + length(role || text) - length(replace(role || text, chr(92), ''))
    + len(regexp_extract_all(role, '{_SQL_CONTROL}')) + len(regexp_extract_all(text, '{_SQL_CONTROL}')) AS size
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
