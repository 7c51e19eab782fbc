"""Chat formatting of reply trees, in DataFrame operations only.

Messages point to the message that they answer. Jump tables (each message's ancestor at distance 1, 2, 4, ...), made by
iterative self-joins, give every root-to-leaf path in as many rounds as the depth has binary digits. Branches of a tree
are ranked by the mean score of their messages, and each chosen path is formatted as one conversation.

The template: an assistant's turn is ``<s>text</s>``, any other is ``[INST]role``, a line feed, and ``text[/INST]``. In
texts a backslash is doubled and each control string gets one behind its first character, so texts can't end a turn and
are read back exactly. Roles are percent-encoded. The loss mask covers the assistants' texts.

Defined results: a null text or role is empty; a null score is zero. Rows of a conversation stand in the order of (turn,
role, text), a null turn first, so repeated rows are turns of their own. Rows with a null conv_id are one conversation.
A message whose parent is missing is a root; messages on a cycle are on no path, nor are those that answer one. Extra columns are ignored. An empty
table gives an empty result. A conversation is one row of the result, as a document is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertow.llm.common import read_table, written

#: The template's control strings.
OPEN, CLOSE, BEGIN, END = "[INST]", "[/INST]", "<s>", "</s>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    text = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(F.regexp_replace(text, r"<(?=/?s>)", r"<\\"), r"\[(?=/?INST\])", r"[\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def paths(messages: DataFrame) -> DataFrame:
    """From tree, node, parent: every root-to-leaf path as rows (tree, leaf, node, up), up counted from the leaf.

    Each round joins only the rows that still have an ancestor at the round's distance; the others are settled.
    """
    parents = messages.select("tree", "node").withColumnRenamed("node", "parent")
    known = messages.select("tree", "node", "parent").join(parents, ["tree", "parent"], "left_semi")
    jump = written(known.select("tree", "node", F.col("parent").alias("to")), "jumps")
    leaves = messages.join(jump.select("tree", F.col("to").alias("node")), ["tree", "node"], "left_anti")
    active, distance = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), 1
    settled, names = [], ["tree", "leaf", "node", "up"]
    # Each round doubles the distance; a distance beyond the number of messages means a cycle.
    most = messages.count()
    while distance <= most and not jump.isEmpty():
        met = written(active.join(jump, ["tree", "node"], "left").select(*names, "to"), "paths")
        settled.append(met.where("to is null").select(*names))
        both = F.array(F.struct("node", "up"), F.struct(F.col("to").alias("node"), (F.col("up") + distance).alias("up")))
        active = met.where("to is not null").select("tree", "leaf", F.explode(both).alias("x")).select("tree", "leaf", "x.*")
        next_ = jump.select(
            "tree", F.col("node").alias("from"), F.col("to").alias("node")
        ).join(jump, ["tree", "node"]).select("tree", F.col("from").alias("node"), "to")
        jump, distance = written(next_, "jumps"), 2 * distance
    rows = reduce(DataFrame.union, [*settled, active])
    # What still has an ancestor beyond all messages goes round a cycle.
    return rows if distance <= most else rows.join(
        active.join(jump, ["tree", "node"]).select("tree", "leaf").distinct(), ["tree", "leaf"], "left_anti"
    )


def formatted_trees(messages: DataFrame, keep: int | None = None) -> DataFrame:
    """From tree, node, parent, role, text, score: per chosen path tree, leaf, rank, score, formatted, and loss_spans
    (array of begin and length, in code points). keep: how many branches of a tree, all if None."""
    clean = messages.select(
        "tree",
        "node",
        "parent",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    rows = paths(clean)
    steps = rows.join(clean.select("tree", "node", "score"), ["tree", "node"])
    branches = steps.groupBy("tree", "leaf").agg(F.avg("score").alias("branch_score"), F.max("up").alias("depth"))
    branches = branches.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf")))
    if keep is not None:
        branches = branches.where(F.col("rank") <= keep)
    spoken = F.col("role") == ASSISTANT
    body = escape(F.col("text"))
    head = F.when(spoken, F.lit(BEGIN)).otherwise(F.concat(F.lit(OPEN), F.url_encode("role"), F.lit("\n")))
    turns = rows.join(branches, ["tree", "leaf"]).join(clean.select("tree", "node", "role", "text"), ["tree", "node"])
    turns = turns.select(
        "tree",
        "leaf",
        "rank",
        "branch_score",
        (F.col("depth") - F.col("up")).alias("at"),
        spoken.alias("spoken"),
        head.alias("head"),
        body.alias("body"),
    )
    turns = turns.withColumn(
        "turn", F.concat("head", "body", F.when(F.col("spoken"), F.lit(END)).otherwise(F.lit(CLOSE)))
    ).withColumn("size", F.length("turn"))
    before = F.sum("size").over(Window.partitionBy("tree", "leaf").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    turns = turns.withColumn(
        "span",
        F.when(
            F.col("spoken"), F.struct((F.coalesce(before, F.lit(0)) + F.length("head")).alias("begin"), F.length("body").cast("long").alias("length"))
        ),
    )
    grouped = turns.groupBy("tree", "leaf").agg(
        F.first("rank").alias("rank"),
        F.first("branch_score").alias("score"),
        F.sort_array(F.collect_list(F.struct("at", "turn", "span"))).alias("turns"),
    )
    return grouped.select(
        "tree",
        "leaf",
        "rank",
        "score",
        F.array_join(F.col("turns.turn"), "").alias("formatted"),
        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted conversation, read back: array of role and text."""
    found = F.regexp_extract_all(formatted, F.lit(r"(?s)\[INST\].*?\[/INST\]|<s>.*?</s>"), F.lit(0))

    def read(turn: Column) -> Column:
        inner = F.substring(turn, F.lit(len(OPEN) + 1), F.length(turn) - len(OPEN) - len(CLOSE))
        role = F.substring_index(inner, "\n", 1)
        said = F.substring(turn, F.lit(len(BEGIN) + 1), F.length(turn) - len(BEGIN) - len(END))
        asked = F.substring(inner, F.length(role) + 2, F.length(inner))
        spoken = turn.startswith(BEGIN)
        return F.struct(
            F.when(spoken, F.lit(ASSISTANT)).otherwise(F.url_decode(role)).alias("role"),
            unescape(F.when(spoken, said).otherwise(asked)).alias("text"),
        )

    return F.transform(found, read)


def chains(conversations: DataFrame) -> DataFrame:
    """Conversations by turn as reply trees: each row answers the one before it."""
    tree = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null"))
    node = F.row_number().over(
        Window.partitionBy("tree").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    ).cast("long")
    rows = conversations.select(tree.alias("tree"), "turn", "role", "text").withColumn("node", node)
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted chains: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    text = F.col("formatted")
    back = formatted.select(
        F.when(F.col("tree").startswith("c"), F.substring("tree", 2, 30).cast("long")).alias("conv_id"),
        "formatted",
        turns_of(text).alias("turns"),
        F.transform("loss_spans", lambda s: unescape(F.substring(text, (s["begin"] + 1).cast("int"), s["length"].cast("int")))).alias("losses"),
    )
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("losses", "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha(whole).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        sha(loss).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    real = read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    said = "</s>[INST] ok [/INST]"
    control = spark.sql(f"select -1L as conv_id, turn, role, '{said}' as text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)")
    return digests(formatted_trees(chains(real.unionByName(control))))


ORACLE = {
    "op8_chat_format": r"""
        with t as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all values (-1::bigint, 0::bigint, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        e as (
            select *, replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') as body
            from t)
        select conv_id, count(*) as n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
               coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
               sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
               sum(length(body) + case when role = 'assistant' then 7 else 14 + length(url_encode(role)) end)::bigint as formatted_chars
        from e group by conv_id"""
}
