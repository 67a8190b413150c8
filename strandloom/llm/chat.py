"""Chat formatting: a conversation's turns as one text with marks, a mask of what to learn, and the way back. Spark expressions only."""

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around blocks of turns. Each begins with < or [ and has neither later on.

    A block is the turns of one role that follow each other; NEXT parts them. Roles without marks of their own get general
    ones, with their name. Texts and names are escaped: each mark in them, with or without backslashes after its first
    character, gets one more there. So no text holds a mark, and taking one backslash away gives it back.
    """

    begin: str = "<s>"
    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")})
    other: tuple[str, str, str] = ("[ROLE]", "[AS]", "[/ROLE]")
    next: str = "[NEXT]"
    learn: str = "assistant"

    @property
    def controls(self) -> list[str]:
        return sorted({self.begin, self.next, *self.other, *(m for pair in self.marks.values() for m in pair)})

    @property
    def _rests(self) -> str:
        return "|".join(re.sub(r"([^\w/])", r"\\\1", c[1:]) for c in self.controls)

    def escape(self, c: Column) -> Column:
        return F.regexp_replace(c, rf"([<\[])(\\*)({self._rests})", r"$1$2\\$3")

    def unescape(self, c: Column) -> Column:
        return F.regexp_replace(c, rf"([<\[])\\(\\*)({self._rests})", "$1$2$3")

    def opening(self, role: Column) -> Column:
        out = F.concat(F.lit(self.other[0]), self.escape(role), F.lit(self.other[1]))
        for name, (mark, _) in self.marks.items():
            out = F.when(role == name, F.lit(mark)).otherwise(out)
        return out

    def closing(self, role: Column) -> Column:
        out = F.lit(self.other[2])
        for name, (_, mark) in self.marks.items():
            out = F.when(role == name, F.lit(mark)).otherwise(out)
        return out


_TURN = "struct<turn: bigint, role: string, text: string>"
_STATE = "struct<role: string, at: bigint, byte: bigint, parts: array<string>, loss: array<struct<start: bigint, end: bigint, first_byte: bigint, end_byte: bigint>>>"


def format_conversations(turns: DataFrame, template: Template = Template(), id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """conv_id, formatted and loss of each conversation: loss has a span for each text to learn, from and up to but not
    including so many code points, and bytes of UTF-8, of formatted.

    Turns come by number, null first; of equal numbers by role, then text. Repeated rows are turns each. A null role or text
    is empty. Rows without a conversation's id belong together with nothing: each is a conversation. An empty table gives
    none. A conversation becomes one string, and so is one task's and under 2 GB, as strings are; time grows with its text
    and, by 16 bytes a pair, with the square of its turns. Other columns aren't read.
    """
    named = turns.select(F.col(f"`{id_column}`").alias("conv_id"), F.struct(F.col(f"`{turn_column}`").alias("turn"), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((role_column, "role"), (text_column, "text"))]).cast(_TURN).alias("t"))
    gathered = named.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    gathered = gathered.unionByName(named.where("conv_id IS NULL").select("conv_id", F.array("t").alias("turns")))
    t = template
    ready = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), t.escape(x["text"]).alias("text")))
    gathered = gathered.select("conv_id", F.transform(ready, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"), F.length(x["text"]).alias("chars"), F.octet_length(x["text"]).alias("bytes"), t.opening(x["role"]).alias("opening"))).alias("turns"))
    empty = F.struct(F.lit(None).cast("string").alias("role"), F.lit(len(t.begin)).alias("at"), F.lit(len(t.begin.encode())).alias("byte"), F.array(F.lit(t.begin)).alias("parts"), F.array().alias("loss")).cast(_STATE)

    def step(s: Column, x: Column) -> Column:
        before = F.when(s["role"].isNull(), x["opening"]).when(s["role"] == x["role"], F.lit(t.next)).otherwise(F.concat(t.closing(s["role"]), x["opening"]))
        start, first = s["at"] + F.length(before), s["byte"] + F.octet_length(before)
        end, end_byte = start + x["chars"], first + x["bytes"]
        span = F.struct(start.alias("start"), end.alias("end"), first.alias("first_byte"), end_byte.alias("end_byte"))
        loss = F.when(x["role"] == t.learn, F.concat(s["loss"], F.array(span))).otherwise(s["loss"])
        return F.struct(x["role"].alias("role"), end.alias("at"), end_byte.alias("byte"), F.concat(s["parts"], F.array(before, x["text"])).alias("parts"), loss.alias("loss")).cast(_STATE)

    done = gathered.select("conv_id", F.aggregate("turns", empty, step).alias("s"))
    return done.select("conv_id", F.concat(F.array_join("s.parts", ""), t.closing(F.col("s.role"))).alias("formatted"), F.col("s.loss").alias("loss"))


def turns_of(formatted: Column, template: Template = Template()) -> Column:
    """The turns of a formatted conversation, as they were: an array of (role, text)."""
    t = template
    escaped = lambda marks: "|".join(re.sub(r"([^\w/])", r"\\\1", m) for m in marks)
    closings = escaped([t.other[2], *(m for _, m in t.marks.values())])
    # what comes after the last block's closing mark is empty
    blocks = F.split(F.substring(formatted, F.lit(len(t.begin) + 1), F.length(formatted)), closings)
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def block(b: Column) -> Column:
        mark = len(t.other[0]) + 1
        role, body = t.unescape(F.substring_index(F.substring(b, F.lit(mark), F.length(b)), t.other[1], 1)), F.substring(b, F.locate(t.other[1], b) + len(t.other[1]), F.length(b))
        for name, (opening, _) in t.marks.items():
            here = b.startswith(opening)
            role, body = F.when(here, F.lit(name)).otherwise(role), F.when(here, F.substring(b, F.lit(len(opening) + 1), F.length(b))).otherwise(body)
        return F.struct(role.alias("role"), F.split(body, escaped([t.next])).alias("texts"))

    return F.flatten(F.transform(F.transform(blocks, block), lambda b: F.transform(b["texts"], lambda x: F.struct(b["role"].alias("role"), t.unescape(x).alias("text")))))


def learned(formatted: Column, loss: Column, template: Template = Template()) -> Column:
    """The texts under the mask, as they were before they were escaped."""
    both = F.array(F.struct(formatted.cast("binary").alias("raw"), loss.alias("loss")))  # bytes are made once, not once a span
    cut = lambda x: F.transform(x["loss"], lambda s: template.unescape(F.substring(x["raw"], (s["first_byte"] + 1).cast("int"), (s["end_byte"] - s["first_byte"]).cast("int")).cast("string")))
    return F.flatten(F.transform(both, cut))


def digest(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, all read back from formatted and loss."""
    read = formatted.select("conv_id", turns_of(F.col("formatted"), template).alias("turns"), F.array_join(learned(F.col("formatted"), F.col("loss"), template), "").alias("learned"), F.length("formatted").cast("bigint").alias("formatted_chars"))
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")
