"""Chat formatting: conversations as marked texts with a loss mask, and their turns read back, by DataFrame expressions only."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around the turns of each role: (opening, between merged turns, closing).

    A role without marks of its own goes by `other`, whose opening and between are followed by the role's name and `name_end`.
    Marks start with < or [ and end with > or ], hold neither of these inside and no white space, and differ from each other: no
    mark then arises where a text and a mark meet, and a text's own marks are told apart by a backslash after their first
    character. Every backslash that already stands there gets one more, so that escaping is reversible.
    """

    begin: str = "<s>"
    roles: dict[str, tuple[str, str, str]] = field(default_factory=lambda: {"system": ("[SYS]", "[+SYS]", "[/SYS]"), "user": ("[INST]", "[+INST]", "[/INST]"), "assistant": ("[OUT]", "[+OUT]", "</s>")})
    other: tuple[str, str, str] = ("[ROLE]", "[+ROLE]", "[/ROLE]")
    name_end: str = "[:ROLE]"

    def __post_init__(self) -> None:
        bad = [m for m in self.marks if not re.fullmatch(r"[<\[][^<>\[\]\s\\]+[>\]]", m)]
        if bad or len(set(self.marks)) < len(self.marks):
            raise ValueError(f"marks must differ and be of the form <...> or [...]: {bad or self.marks}")

    @property
    def marks(self) -> list[str]:
        return [self.begin, *(m for own in self.roles.values() for m in own), *self.other, self.name_end]

    @property
    def _tails(self) -> str:
        return "|".join(re.escape(m[1:]) for m in sorted(self.marks, key=len, reverse=True))

    @property
    def pattern(self) -> str:
        return rf"[<\[](?:{self._tails})"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(rf"([<\[])(\\*)({self._tails})"), F.lit(r"$1\\$2$3"))

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(rf"([<\[])\\(\\*)({self._tails})"), F.lit(r"$1$2$3"))

    def mark(self, role: Column, k: int) -> Column:
        """The k-th mark of a role, with the name where the role has no marks of its own."""
        named = F.lit(self.other[k]) if k == 2 else F.concat(F.lit(f"{self.other[k]} "), self.escape(role), F.lit(f" {self.name_end}"))
        out = named
        for name, own in self.roles.items():
            out = F.when(role == name, F.lit(own[k])).otherwise(out)
        return out


def _let(value: Column, use) -> Column:
    """use(value), with value computed once a row however often use refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _blocks(items: Column, use) -> Column:
    """use() of stretches of about a square root of the array's length, as an array; keeps folds over long arrays short."""
    n = F.size(items)
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(n))).cast("int")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), width), lambda i: i < n)
    return F.transform(starts, lambda i: use(F.slice(items, i + 1, width)))


def _sums_before(sizes: Column) -> Column:
    """For each of an array of numbers the sum of those before it."""

    def fold(part: Column) -> Column:
        zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.array().cast("array<bigint>").alias("at"))
        return F.aggregate(part, zero, lambda a, x: F.struct((a["n"] + x).alias("n"), F.concat(a["at"], F.array(a["n"])).alias("at")))

    def shifted(parts: Column) -> Column:
        base = fold(F.transform(parts, lambda p: p["n"]))["at"]
        return F.flatten(F.zip_with(parts, base, lambda p, b: F.transform(p["at"], lambda x: x + b)))

    return _let(sizes, lambda x: _let(_blocks(x, fold), shifted))


def format_chats(turns: DataFrame, template: Template | None = None, loss_role: str = "assistant", id_col: str = "conv_id") -> DataFrame:
    """(id_col, formatted, loss_spans array<struct<start, stop>>) of every conversation of turns (id_col, turn, role, text).

    Texts are escaped row by row before they are gathered. A conversation's turns are collected as structs and sorted by turn
    (null first), then role and text, so that equal turn numbers have one order; repeated rows stay repeated. Adjacent turns of
    one role are merged into a block, in which a mark of its own keeps their border. loss_spans are code-point ranges of
    `formatted` that cover the (escaped) texts of loss_role and no mark. Null text and null role count as empty, null ids are
    one conversation; other columns aren't read, whatever their names; an empty table gives an empty result. A formatted
    conversation is one value, so the longest one, not the corpus, sets the memory of a task.
    """
    t = template or Template()
    text = t.escape(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = turns.select(F.col(id_col).alias("id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("body"))
    rows = rows.groupBy("id").agg(F.collect_list(F.struct("turn", "role", "body")).alias("turns"))

    def blocks(turns: Column) -> Column:
        """Runs of turns of one role: (role, bodies)."""
        n = F.size(turns)
        first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (turns[i]["role"] != turns[F.greatest(i - 1, F.lit(0))]["role"]))
        return _let(first, lambda at: F.transform(at, lambda i, k: F.struct(turns[i]["role"].alias("role"), F.transform(F.slice(turns, i + 1, F.coalesce(F.get(at, k + 1), n) - i), lambda x: x["body"]).alias("bodies"))))

    def parts(block: Column) -> Column:
        """A block's texts, each with what stands before and after it."""
        n = F.size(block["bodies"])
        role = block["role"]
        head = lambda i: F.concat(F.when(i == 0, t.mark(role, 0)).otherwise(t.mark(role, 1)), F.lit(" "))
        tail = lambda i: F.when(i == n - 1, F.concat(F.lit(" "), t.mark(role, 2))).otherwise(F.lit(" "))
        return F.transform(block["bodies"], lambda x, i: F.struct(head(i).alias("head"), x.alias("body"), tail(i).alias("tail"), (role == loss_role).alias("loss")))

    size = lambda x: F.length(x["head"]) + F.length(x["body"]) + F.length(x["tail"])
    whole = lambda p: F.concat(F.lit(t.begin), F.array_join(F.transform(p, lambda x: F.concat(x["head"], x["body"], x["tail"])), ""))

    def spans(p: Column) -> Column:
        at = _sums_before(F.transform(p, lambda x: size(x).cast("bigint")))
        begun = F.zip_with(p, at, lambda x, a: F.struct((a + len(t.begin) + F.length(x["head"])).alias("start"), (a + len(t.begin) + F.length(x["head"]) + F.length(x["body"])).alias("stop"), x["loss"].alias("loss")))
        return F.transform(F.filter(begun, lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))

    made = _let(F.array_sort("turns"), lambda x: _let(F.flatten(F.transform(blocks(x), parts)), lambda p: F.struct(whole(p).alias("formatted"), spans(p).alias("loss_spans"))))
    return rows.select(F.col("id").alias(id_col), made.alias("m")).select(id_col, "m.formatted", "m.loss_spans")


def chat_turns(formatted: Column, template: Template | None = None) -> Column:
    """The turns of a formatted conversation, array<struct<role, text>>, from its marks alone."""
    t = template or Template()
    opened = {own[k]: role for role, own in t.roles.items() for k in (0, 1)}
    marked = lambda x, i: F.struct(x.alias("x"), i.alias("i"), F.regexp_extract(x, f"^{t.pattern}", 0).alias("mark"))
    body = lambda s: t.unescape(F.substring(s["x"], F.length(s["mark"]) + 2, F.length(s["x"]) - F.length(s["mark"]) - 2))

    def turn(pieces: Column, own: Column) -> Column:
        role = body(pieces[F.greatest(own["i"] - 1, F.lit(0))])  # the name that stands before name_end
        for m, name in opened.items():
            role = F.when(own["mark"] == m, F.lit(name)).otherwise(role)
        return F.struct(role.alias("role"), body(own).alias("text"))

    pieces = F.transform(F.split(formatted, f"(?={t.pattern})"), marked)
    return _let(pieces, lambda p: F.transform(F.filter(p, lambda s: s["mark"].isin([*opened, t.name_end])), lambda s: turn(p, s)))


def loss_text(formatted: Column, spans: Column, template: Template | None = None) -> Column:
    """All that the spans cover, unescaped, with nothing between. Spans are cut in stretches, each from a part of the text of its own,
    so that long conversations aren't walked from their start for every span."""
    t = template or Template()

    def stretch(own: Column) -> Column:
        base = own[0]["start"]
        part = F.substring(formatted, (base + 1).cast("int"), (F.element_at(own, -1)["stop"] - base).cast("int"))
        return _let(part, lambda x: F.array_join(F.transform(own, lambda s: t.unescape(F.substring(x, (s["start"] - base + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), ""))

    return F.array_join(_blocks(spans, stretch), "")


def chat_digest(chats: DataFrame, template: Template | None = None, id_col: str = "conv_id") -> DataFrame:
    """(id_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from formatted texts and spans alone."""
    turns, loss = chat_turns(F.col("formatted"), template), loss_text(F.col("formatted"), F.col("loss_spans"), template)
    said = lambda x: F.array_join(F.transform(x, lambda y: F.concat(y["role"], F.lit("\n"), y["text"], F.lit("\n"))), "")
    read = _let(turns, lambda x: F.struct(F.size(x).cast("bigint").alias("n_turns"), F.sha2(said(x), 256).alias("turns_sha256")))
    under = _let(loss, lambda x: F.struct(F.length(x).cast("bigint").alias("loss_chars"), F.sha2(x, 256).alias("loss_sha256")))
    return chats.select(id_col, read.alias("r"), under.alias("u"), F.length("formatted").cast("bigint").alias("formatted_chars")).select(id_col, "r.*", "u.*", "formatted_chars")
