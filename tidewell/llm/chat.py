"""Chat formatting in Spark expressions only: conversations become one training text each, with a loss mask.

Rows of a conversation are collected as structs, sorted, and merged where neighbours have the same role; each block is
written with the template's marks.  A control string inside a role or a text gets one backslash behind its first character
(and one more where it has some already), so that marks can be told from texts and ``read_back`` restores every row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements that are folded at once; a longer array is folded in slices of as many.
SLICE = 256


@dataclass(frozen=True)
class Template:
    """Marks around a conversation, its blocks (``turn`` role ``text`` texts ``close``) and the texts of one block.

    ``guarded`` are further strings that a tokenizer would read as control tokens.  Every control string starts with a
    character that none of them holds at another place, has no backslash, and is not the beginning of another one.
    """

    begin: str = "<s>"
    turn: str = "<|turn|>"
    text: str = "<|text|>"
    more: str = "<|more|>"
    close: str = "<|close|>"
    finish: str = "</s>"
    guarded: tuple[str, ...] = ("[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<unk>", "<pad>")
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        controls = tuple(sorted({self.begin, self.turn, self.text, self.more, self.close, self.finish, *self.guarded} - {""}))
        heads = {c[0] for c in controls}
        if len({self.turn, self.text, self.more, self.close} - {""}) < 4:
            raise ValueError("turn, text, more and close must differ and not be empty")
        if any(len(c) < 2 or "\\" in c or heads & {*c[1:]} for c in controls):
            raise ValueError("a control string needs two characters or more, no backslash, and its first character nowhere else")
        if any(a != b and b.startswith(a) for a in controls for b in controls):
            raise ValueError("no control string may be the beginning of another")
        object.__setattr__(self, "controls", controls)

    def _heads(self) -> dict[str, str]:
        """By first character: a pattern of backslashes and the rest of a control string that starts so."""
        return {h: rf"(?=\\*(?:{'|'.join(quoted(c[1:]) for c in self.controls if c[0] == h)}))" for h in sorted({c[0] for c in self.controls})}

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, "|".join(quoted(h) + tails for h, tails in self._heads().items()), r"$0\\")

    def unescape(self, text: Column) -> Column:
        heads = self._heads()
        return F.regexp_replace(text, "|".join(rf"({quoted(h)})\\{tails}" for h, tails in heads.items()), "".join(f"${i}" for i in range(1, len(heads) + 1)))


def quoted(text: str) -> str:
    """A pattern of ``text`` itself, alike in Java and in RE2."""
    return re.sub(r"([^\w\s])", r"\\\1", text)


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` computed once, however often ``fn`` and its lambdas use it."""
    return F.transform(F.array(value), fn)[0]


def slices(values: Column) -> Column:
    """The array in slices of SLICE elements, one empty slice if it is empty."""
    last = ((F.greatest(F.size(values), F.lit(1)) - 1) / SLICE).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(values, i * SLICE + 1, SLICE))


def _fold(values: Column) -> Column:
    """Sums up to and with each element."""
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("sums"))
    return F.aggregate(values, zero, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["sums"], F.array(a["sum"] + x)).alias("sums")), lambda a: a["sums"])


def running_sums(values: Column) -> Column:
    """Sums up to and with each element of an array of numbers, folded by slices, so that long arrays cost little more."""

    def joined(parts: Column) -> Column:
        ends = _fold(F.transform(parts, lambda p: F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit(0).cast("long"))))
        return let(ends, lambda e: F.flatten(F.transform(parts, lambda p, i: F.transform(p, lambda x: x + F.when(i > 0, F.get(e, i - 1)).otherwise(F.lit(0).cast("long"))))))

    return let(F.transform(slices(values), _fold), joined)


def format_chats(chats: DataFrame, template: Template = Template(), loss_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (code points [start, stop) of texts in the loss), n_blocks.

    ``chats`` has conv_id, turn, role and text; other columns are left out, whatever their names.  Rows come by turn, null
    first, and in a tie by role and text; rows that repeat stay.  A null role or text is empty.  Rows with a null conv_id
    form one conversation with a null id.  An empty text keeps its place and has no span.  An empty table gives no rows.
    Texts are used whole; a conversation is one value, so it must fit in one (2 GB).
    """
    size = lambda s: F.lit(len(s)).cast("long")
    turns = chats.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    opens = lambda ts, i: (i == 0) | (F.get(ts, i)["role"] != F.get(ts, i - 1)["role"])

    def written(ts: Column) -> Column:
        escaped = F.transform(ts, lambda t, i: F.struct(t["role"].isin(*loss_roles).alias("loss"), opens(ts, i).alias("opens"), template.escape(t["role"]).alias("role"), template.escape(t["text"]).alias("text")))
        return let(escaped, laid)

    def laid(es: Column) -> Column:
        before = F.transform(
            es,
            lambda e, i: F.length(e["text"]).cast("long")
            + F.when(~e["opens"], size(template.more)).otherwise(size(template.turn) + F.length(e["role"]) + size(template.text) + F.when(i > 0, size(template.close)).otherwise(size(template.begin))),
        )
        spans = let(running_sums(before), lambda stops: F.transform(es, lambda e, i: F.struct((F.get(stops, i) - F.length(e["text"])).cast("int").alias("start"), F.get(stops, i).cast("int").alias("stop"), e["loss"].alias("loss"))))
        kept = F.transform(F.filter(spans, lambda s: s["loss"] & (s["start"] < s["stop"])), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))
        starts = F.filter(F.sequence(F.lit(0), F.size(es) - 1), lambda i: F.get(es, i)["opens"])
        blocks = let(starts, lambda at: F.transform(at, lambda s, k: F.slice(es, s + 1, F.coalesce(F.get(at, k + 1), F.size(es)) - s)))
        block = lambda b: F.concat(F.lit(template.turn), b[0]["role"], F.lit(template.text), F.array_join(b["text"], template.more), F.lit(template.close))
        text = lambda bs: F.concat(F.lit(template.begin), F.array_join(F.transform(bs, block), ""), F.lit(template.finish))
        return let(blocks, lambda bs: F.struct(text(bs).alias("formatted"), kept.alias("loss_spans"), F.size(bs).alias("n_blocks")))

    return turns.select("conv_id", let(F.col("turns"), written).alias("made")).select("conv_id", "made.formatted", "made.loss_spans", "made.n_blocks")


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """From conv_id, formatted and loss_spans alone: turns (role, text of every row, in order) and loss_texts, unescaped."""
    def block(piece: Column) -> Column:
        halves = F.split(F.get(F.split(piece, quoted(template.close)), F.lit(0)), quoted(template.text))
        return let(halves, lambda h: F.transform(F.split(h[1], quoted(template.more)), lambda t: F.struct(template.unescape(h[0]).alias("role"), template.unescape(t).alias("text"))))

    pieces = let(F.split("formatted", quoted(template.turn)), lambda p: F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))))

    def cut(spans: Column) -> Column:
        """The texts of a slice of spans, from the stretch of text that holds them."""
        first, last = spans[0]["start"], F.element_at(spans, -1)["stop"]
        inside = lambda part: F.transform(spans, lambda s: template.unescape(part.substr(s["start"] - first + 1, s["stop"] - s["start"])))
        return let(F.col("formatted").substr(first + 1, last - first), inside)

    texts = F.flatten(F.transform(F.filter(slices(F.col("loss_spans")), lambda s: F.size(s) > 0), cut))
    return formatted.select("conv_id", "formatted", "loss_spans", F.flatten(F.transform(pieces, block)).alias("turns"), texts.alias("loss_texts"))


def chat_report(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, all read back from the formatted texts."""
    found = read_back(format_chats(chats, template), template)
    loss = F.array_join("loss_texts", "")
    return found.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
