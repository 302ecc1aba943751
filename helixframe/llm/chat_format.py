"""Chat formatting by a finite-state machine over roles; DataFrame functions only.

A declarative template gives each role its opening and closing text and its
loss flag. The machine folds over a conversation's turns in order: it follows
the transition table (``error`` is absorbing) and emits text segments, each with
its loss flag. Control strings inside texts and roles are escaped reversibly,
so the formatted text can be split into turns again.

Null texts are empty; a null role is the empty role, which no transition
allows; null turns sort first; rows that tie on the turn are ordered by role
and text. Conversations that break the turn order are formatted all the same
and flagged in ``valid``. Extra columns are ignored, an empty table gives an
empty result. A null conversation id is a conversation of its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks and loss flags; each escape's code must be a different character."""

    head: str = "### "
    after_role: str = ": "
    close: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    transitions: dict[str, str] = field(
        default_factory=lambda: {
            "start>system": "system", "start>user": "user", "system>user": "user", "user>assistant": "assistant", "assistant>user": "user",
        }
    )
    accepting: tuple[str, ...] = ("assistant",)
    #: What may not appear inside a text, and its escape; the backslash comes first.
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\0"), ("###", "\\1"), ("</turn>", "\\2"), (": ", "\\3"))


DEFAULT = Template()


def escape(text: Column, template: Template, marks: int | None = None) -> Column:
    for plain, code in template.escapes[:marks]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, template: Template) -> Column:
    for plain, code in reversed(template.escapes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_conversations(df: DataFrame, template: Template = DEFAULT, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, formatted (string), segments (array of text and loss flag), state, valid."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    turns = df.groupBy(F.col(conv)).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    table = F.create_map(*[F.lit(x) for pair in template.transitions.items() for x in pair])
    step = lambda state, t: F.coalesce(F.try_element_at(table, F.concat(state, F.lit(">"), t["role"])), F.lit("error"))
    state = F.aggregate("turns", F.lit("start"), step)

    def emit(t: Column) -> Column:
        head = F.concat(F.lit(template.head), escape(t["role"], template), F.lit(template.after_role))
        segment = lambda x, loss: F.struct(x.alias("text"), loss.alias("loss"))
        return F.array(segment(head, F.lit(False)), segment(escape(t["text"], template, 3), t["role"].isin(*template.loss_roles)), segment(F.lit(template.close), F.lit(False)))

    out = turns.select(conv, state.alias("state"), F.flatten(F.transform("turns", emit)).alias("segments"))
    return out.select(conv, F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "state", F.col("state").isin(*template.accepting).alias("valid"))


def parse(formatted: Column, template: Template = DEFAULT) -> Column:
    """Turns (role, text) read back from formatted text."""
    pieces = F.filter(F.split(formatted, _literal(template.close)), lambda p: p != "")
    start = len(template.head) + 1

    def read(piece: Column) -> Column:
        body = F.substring(piece, start, 1 << 30)
        cut = F.instr(body, template.after_role)
        return F.struct(unescape(F.substring(body, F.lit(1), cut - 1), template).alias("role"), unescape(F.substring(body, cut + len(template.after_role), F.lit(1 << 30)), template).alias("text"))

    return F.transform(pieces, read)


def _literal(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in text)


def loss_text(segments: Column, template: Template = DEFAULT) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")


def read_back(formatted: DataFrame, template: Template = DEFAULT, conv: str = "conv_id") -> DataFrame:
    """Digests of what the formatted output says."""
    out = formatted.select(conv, "formatted", "state", "valid", parse(F.col("formatted"), template).alias("turns"), loss_text(F.col("segments"), template).alias("loss"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        conv,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "state",
        "valid",
    )
