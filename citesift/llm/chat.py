"""Chat formatting: conversations as one marked text each, with a loss mask, by SQL functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import once, running_starts


@dataclass(frozen=True)
class Template:
    """The marks of a format. A block of turns of one role is start, the role, body, the turns with part between them, end.

    Marks and foreign control strings can't occur in what is formatted: a backslash goes behind the first character of each,
    and one more where backslashes are there already, so taking one away restores every text. Only the texts of the roles in
    learn are under the loss mask."""

    start: str = "<|turn|>"
    body: str = "<|text|>"
    part: str = "<|and|>"
    end: str = "<|end|>"
    # Control strings of public chat formats, which stay harmless too. "<|" begins every mark above.
    guarded: tuple[str, ...] = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<SYS>>", "</SYS>>")
    learn: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        firsts = {g[0] for g in self.guarded}
        if any(len(g) < 2 or firsts & set(g[1:]) or g[1] == "\\" for g in self.guarded):
            raise ValueError("a guarded string needs two characters or more, and none that begins a guarded string may follow in it")
        marks = (self.start, self.body, self.part, self.end)
        if any(not m.startswith(self.guarded) for m in marks) or any(a != b and (a in b) for a in marks for b in marks) or len(set(marks)) < 4:
            raise ValueError("every mark begins with a guarded string, and none holds another")

    def _pattern(self, held: str) -> str:
        firsts = "".join(sorted({re.escape(g[0]) for g in self.guarded}))
        rests = "|".join(sorted({re.escape(g[1:]) for g in self.guarded}))
        return rf"([{firsts}]){held}(?={rests})"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._pattern(r"(\\*)"), r"$1\\$2")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._pattern(r"\\(\\*)"), "$1$2")


TEMPLATE = Template()


def _blocks(turns: Column, t: Template) -> Column:
    """Sorted turns, with adjacent ones of one role merged: an array of (role, learn, parts), all escaped."""
    learn = lambda role: F.coalesce(role.isin(*t.learn), F.lit(False)) if t.learn else F.lit(False)

    def merged(turns: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | ~F.get(turns, i)["role"].eqNullSafe(F.get(turns, i - 1)["role"]))

        def block(start: Column, after: Column) -> Column:
            role = F.get(turns, start)["role"]
            parts = F.transform(F.slice(turns, start + 1, after - start), lambda x: t.escape(x["text"]))
            return F.struct(t.escape(F.coalesce(role, F.lit(""))).alias("role"), learn(role).alias("learn"), parts.alias("parts"))

        return once(starts, lambda s: F.transform(s, lambda at, k: block(at, F.coalesce(F.get(s, k + 1), F.size(turns)))))

    return once(turns, merged)


def _written(blocks: Column, t: Template) -> Column:
    """(formatted, loss): the text, and the place of every part to learn in it, from 0: start and length in code points,
    byte_start and byte_length in UTF-8."""
    def head(b: Column) -> Column:
        return F.concat(F.lit(t.start), b["role"], F.lit(t.body))

    # One piece for each part: what stands before it, its own length, what stands behind it.
    def pieces(b: Column) -> Column:
        last = F.size(b["parts"]) - 1
        return F.transform(b["parts"], lambda p, i: F.struct(
            F.when(i == 0, head(b)).otherwise("").alias("before"), p.alias("text"), F.when(i == last, t.end).otherwise(t.part).alias("after"), b["learn"].alias("learn"),
        ))

    def spans(ps: Column) -> Column:
        starts = lambda size: running_starts(F.transform(ps, lambda p: size(p["before"]) + size(p["text"]) + size(p["after"])))

        def placed(s: Column) -> Column:
            places = F.transform(ps, lambda p, i: F.struct(
                p["learn"].alias("learn"), (F.get(s["chars"], i) + F.length(p["before"])).alias("start"), F.length(p["text"]).cast("long").alias("length"),
                (F.get(s["bytes"], i) + F.octet_length(p["before"])).alias("byte_start"), F.octet_length(p["text"]).cast("long").alias("byte_length"),
            ))
            return F.transform(F.filter(places, lambda p: p["learn"]), lambda p: F.struct(*(p[k].alias(k) for k in ("start", "length", "byte_start", "byte_length"))))

        return once(F.struct(starts(F.length).alias("chars"), starts(F.octet_length).alias("bytes")), placed)

    text = F.array_join(F.transform(blocks, lambda b: F.concat(head(b), F.array_join(b["parts"], t.part), F.lit(t.end))), "")
    return F.struct(text.alias("formatted"), once(F.flatten(F.transform(blocks, pieces)), spans).alias("loss"))


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: Template = TEMPLATE) -> DataFrame:
    """(id, formatted, loss): each conversation as one text, and the spans of it to learn from (loss: start and length in code points, byte_start and byte_length in UTF-8).

    The turns of a conversation are collected as structs and sorted by turn (null first), then role, then text, so ties and
    repeated rows have one order and are all kept; adjacent turns of one role are merged into one block that still tells them apart.
    A null text counts as empty, a null role as an empty role that isn't learnt from and merges with null roles only, and a null id is one
    conversation. Texts are taken whole. An empty table gives no rows. Only the four columns are read, so others may have any name. A conversation is one
    row of the result, so it is gathered whole and must fit a row (2 GB), however its turns were spread."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    gathered = turns.groupBy(F.col(id_col).alias(id_col)).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    out = once(_blocks(F.col("turns"), template), lambda b: _written(b, template))
    return gathered.select(id_col, out.alias("out")).select(id_col, "out.formatted", "out.loss")


def parse_turns(formatted: Column, template: Template = TEMPLATE) -> Column:
    """The turns (role, text) that a formatted text was made of, in order. Null for null."""
    t = template
    cut = lambda text, mark: F.split(text, re.escape(mark))

    def turns(block: Column) -> Column:
        halves = cut(F.substring(block, F.lit(1), F.length(block) - len(t.end)), t.body)
        role = t.unescape(F.get(halves, 0))
        return F.transform(cut(F.get(halves, 1), t.part), lambda p: F.struct(role.alias("role"), t.unescape(p).alias("text")))

    return once(cut(formatted, t.start), lambda blocks: F.flatten(F.transform(F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0))), turns)))


def learnt_texts(formatted: Column, loss: Column, template: Template = TEMPLATE) -> Column:
    """The texts under the loss mask, as they were before they were escaped. They are cut out by bytes, so a long text isn't counted through for each."""
    cut = lambda b: F.transform(loss, lambda s: F.substring(b, (s["byte_start"] + 1).cast("int"), s["byte_length"].cast("int")).cast("string"))
    return F.transform(once(formatted.cast("binary"), cut), template.unescape)


def digests(chats: DataFrame, id_col: str = "conv_id", template: Template = TEMPLATE) -> DataFrame:
    """(id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read back from formatted conversations."""
    turns, learnt = parse_turns(F.col("formatted"), template), learnt_texts(F.col("formatted"), F.col("loss"), template)
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    back = chats.select(id_col, F.length("formatted").cast("long").alias("formatted_chars"), turns.alias("turns"), F.array_join(learnt, "").alias("learnt"))
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        id_col, F.size("turns").cast("long").alias("n_turns"), sha(lines).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), sha(F.col("learnt")).alias("loss_sha256"), "formatted_chars",
    )
