"""Chat formatting: reply trees, their root-to-leaf paths by doubling self-joins, ranked branches, one text per chosen path."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.llm.common import stage


@dataclass(frozen=True)
class Template:
    """How turns are marked. ``escape`` writes ``amp`` first and then breaks up every ``lead``, so no mark can occur in a text and
    undoing the two replacements in turn gives the text back."""

    turn: str = "<|turn|>"
    text: str = "<|text|>"
    end: str = "<|end|>"
    lead: str = "<|"
    amp: str = "&"
    learned: str = "assistant"

    def escape(self, c: Column) -> Column:
        return F.replace(F.replace(c, F.lit(self.amp), F.lit("&amp;")), F.lit(self.lead), F.lit("&lt;|"))

    def unescape(self, c: Column) -> Column:
        return F.replace(F.replace(c, F.lit("&lt;|"), F.lit(self.lead)), F.lit("&amp;"), F.lit(self.amp))

    def render(self, role: Column, text: Column) -> Column:
        return F.concat(F.lit(self.turn), self.escape(role), F.lit(self.text), self.escape(text), F.lit(self.end))


TEMPLATE = Template()


def replies(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A linear table as reply trees: ``tree, node, parent, role, text, score``. Each row answers the one before it by turn; ties
    go by role, then text. Null roles and texts become empty; a null conversation id is a conversation of its own."""
    w = Window.partitionBy(conv).orderBy(F.col(turn).asc_nulls_first(), F.col(role).asc_nulls_first(), F.col(text).asc_nulls_first())
    name = F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("null"))
    at = F.row_number().over(w)
    numbered = rows.select(F.col(conv).alias("tree"), name.alias("name"), at.alias("at"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    return numbered.select("tree", F.concat_ws("/", "name", "at").alias("node"), F.when(F.col("at") > 1, F.concat_ws("/", "name", F.col("at") - 1)).alias("parent"),
                           "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame) -> DataFrame:
    """``leaf, node, up`` for every root-to-leaf path: its messages and how many replies above the leaf each is.

    Round k joins the table of 2**k-th ancestors with itself and extends every path by as many messages at once, so a thread of
    400 turns takes 9 rounds. Texts stay out. A parent that isn't in the table makes its reply a root. Messages that lead back to
    themselves have no root: neither they nor the replies below them are on a path. Repeated node names are one node.
    """
    nodes = stage(messages.select("node", "parent", "score").dropDuplicates(["node"]), "nodes")
    known = nodes.select(F.col("node").alias("parent"))
    jump = stage(nodes.where("parent is not null").join(known, "parent").select("node", F.col("parent").alias("to")), "jump")
    leaf = nodes.select("node").join(jump.select(F.col("to").alias("node")), "node", "left_anti")
    path = stage(leaf.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("up")), "path")
    rooted = nodes.select("node").join(jump.select("node"), "node", "left_anti")
    span, most = 1, nodes.count()
    while span <= most and not jump.isEmpty():
        further = path.join(jump, "node").select("leaf", F.col("to").alias("node"), (F.col("up") + span).alias("up"))
        path = stage(path.unionByName(further), "path")
        jump = stage(jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("top")), "to").select("node", F.col("top").alias("to")), "jump")
        span *= 2
    if jump.isEmpty():
        return path
    return path.join(path.join(rooted, "node").select("leaf").distinct(), "leaf", "left_semi")


def best_paths(messages: DataFrame, keep: int = 1) -> DataFrame:
    """``tree, leaf, rank, node, up`` of the ``keep`` best branches of each tree: by mean score of their messages, then by length
    (longer first), then by leaf."""
    own = stage(messages.select("tree", "node", F.coalesce("score", F.lit(0.0)).alias("score")).dropDuplicates(["node"]), "scores")
    found = stage(paths(messages), "paths")
    value = found.join(own, "node").groupBy("leaf").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("up") == 0, F.struct("tree"))).alias("t"))
    order = Window.partitionBy("t.tree").orderBy(F.desc("mean"), F.desc("n"), "leaf")
    chosen = value.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    return found.join(chosen.select("leaf", F.col("t.tree").alias("tree"), "rank"), "leaf")


def format_trees(messages: DataFrame, keep: int = 1, template: Template = TEMPLATE) -> DataFrame:
    """``tree, leaf, rank, formatted, loss``: one conversation per chosen path and where its learned texts lie in it.

    ``loss`` is an array of (start, end) in code points of ``formatted``, ends exclusive, one per text of the learned role, in
    order. A conversation is one row of the result, so its turns are gathered in one row; trees are not. An empty table gives an
    empty result.
    """
    said = messages.select("node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["node"])
    piece = template.render(F.col("role"), F.col("text"))
    head = F.length(F.concat(F.lit(template.turn), template.escape(F.col("role")), F.lit(template.text)))
    turns = best_paths(messages, keep).join(said, "node").select(
        "tree", "leaf", "rank", "up", piece.alias("piece"), head.alias("head"), F.length(template.escape(F.col("text"))).alias("size"),
        (F.col("role") == template.learned).alias("learned"))
    rows = turns.groupBy("leaf").agg(
        F.first("tree").alias("tree"), F.first("rank").alias("rank"),
        F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "piece", "head", "size", "learned"))).alias("turns"))
    spot = F.aggregate(
        "turns", F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("loss")),
        lambda s, t: F.struct(
            (s["at"] + F.length(t["piece"])).alias("at"),
            F.when(t["learned"], F.array_append(s["loss"], F.struct((s["at"] + t["head"]).alias("start"), (s["at"] + t["head"] + t["size"]).alias("end"))))
            .otherwise(s["loss"]).alias("loss")),
        lambda s: s["loss"])
    return rows.select("tree", "leaf", "rank", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spot.alias("loss"))


def read_back(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """``formatted`` rows with ``turns`` (array of role, text) and ``loss_text`` recovered from the formatted text and its mask alone."""
    pieces = F.filter(F.split("formatted", r"\Q" + template.end + r"\E", -1), lambda p: p != "")
    parts = F.transform(pieces, lambda p: F.split(F.substring(p, len(template.turn) + 1, 2**31 - 1), r"\Q" + template.text + r"\E", 2))
    turns = F.transform(parts, lambda p: F.struct(template.unescape(p[0]).alias("role"), template.unescape(p[1]).alias("text")))
    learned = F.transform("loss", lambda s: template.unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumns({"turns": turns, "loss_text": F.array_join(learned, "")})


def conversation_digests(rows: DataFrame) -> DataFrame:
    """Formats every conversation and returns what is read back from the output, as digests.

    Null ids are one conversation, null roles and texts are empty, equal turns go by role, then text; repeated rows are turns of
    their own. Other columns are not read. An empty table gives an empty result.
    """
    back = read_back(format_trees(replies(rows)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(F.col("tree").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.length("formatted").cast("bigint").alias("formatted_chars"))


CHAT_SQL = r"""
with extra as (select -7 :: bigint as conv_id, unnest([0, 1]) :: bigint as turn, unnest(['user', 'assistant']) as role, '\### Assistant: </turn> ok' as text),
rows as (select conv_id, turn, role, text from conversations union all select * from extra),
said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from rows),
marked as (
  select *, length('<|turn|><|text|><|end|>') + length(replace(replace(role, '&', '&amp;'), '<|', '&lt;|')) + length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) as size
  from said)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end) :: bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(size) :: bigint as formatted_chars
from marked group by conv_id
"""
