"""Conversations as training texts, by DataFrame functions alone.

A declarative template names the roles, the turns that may follow each other, the strings around a turn and the roles
whose texts carry loss. They make a finite-state machine: a state for each role that the template names, one for any
other role, and the start. It folds over the roles in turn order, emits the state that each turn enters and tells the
first turn out of order; after one the machine goes on from the state of the turn's role, so such conversations are
formatted and marked, not dropped. Blocks of turns are folded one by one, so time is in proportion to the turns. Segments and their loss flags are read off the states. A conversation comes out as
segments of text with a loss flag, and as their concatenation.

Control strings inside texts are escaped reversibly: between the two signs that begin one, `<` and `|` in the usual
template, a backslash is put after any that are there already, and taken out on reading. Roles are escaped further,
as the sign that ends a role in the template must not stand in one. A template whose strings leave that ambiguous is
refused.

Defined results: null texts and null roles are empty; rows are ordered by turn (null first), ties by role and text, so
equal rows are turns of their own; columns other than the four are never read; a null conv_id is a conversation; an
empty table gives no rows; long texts are formatted whole. The rows of one conversation meet in one row, as its
result is one text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Turns that are folded at once.
BLOCK = 256


@dataclass(frozen=True)
class Template:
    """Strings around a turn, loss by role, and the finite-state machine of roles."""

    begin: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "^"
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"^": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )

    def __post_init__(self):
        if min(len(self.begin), len(self.end)) < 2 or not self.after_role:
            raise ValueError("a turn's strings are too short")
        first, second = {self.begin[0], self.end[0]}, {self.begin[1], self.end[1]}
        if first & second or "\\" in first | second or self.end[0] in second or self.after_role[0] in second | {"%", "\\"}:
            raise ValueError("a text could end in the beginning of a control string")
        if {self.begin[-1], self.after_role[-1], self.end[-1]} & first or self.after_role[0].isalnum():
            raise ValueError("a control string could begin before a text")

    def states(self) -> list[str]:
        """The roles that have a state, in order; state 0 is the start, that of any other role comes last."""
        return list(dict.fromkeys([r for k, v in self.follows.items() for r in (k, *v) if r != self.start] + list(self.loss_roles)))


CHATML = Template()


def _signs(template: Template) -> list[tuple[str, str]]:
    return sorted({(s[0], s[1]) for s in (template.begin, template.end)})


def escape(text: Column, template: Template = CHATML) -> Column:
    for a, b in _signs(template):
        text = F.regexp_replace(text, f"{_quoted(a)}(\\\\*){_quoted(b)}", _literal(a) + r"$1\\" + _literal(b))
    return text


def unescape(text: Column, template: Template = CHATML) -> Column:
    for a, b in reversed(_signs(template)):
        text = F.regexp_replace(text, f"{_quoted(a)}(\\\\*)\\\\{_quoted(b)}", _literal(a) + "$1" + _literal(b))
    return text


def _literal(sign: str) -> str:
    return "\\" + sign if sign in "\\$" else sign


def _quoted(sign: str) -> str:
    """One character as a pattern."""
    return sign if sign.isalnum() or sign in " _" else f"\\{sign}"


def _ends_role(template: Template) -> tuple[Column, Column]:
    """The sign that ends a role, and what stands for it inside one."""
    sign = template.after_role[0]
    return F.lit(sign), F.lit("".join(f"%{b:02X}" for b in sign.encode()))


def escape_role(role: Column, template: Template = CHATML) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), *_ends_role(template)), template)


def unescape_role(role: Column, template: Template = CHATML) -> Column:
    sign, code = _ends_role(template)
    return F.replace(F.replace(unescape(role, template), code, sign), F.lit("%25"), F.lit("%"))


def _machine(template: Template, turns: Column) -> Column:
    """Fold over the turns, BLOCK of them at a time: an array of (state, at, wrong, entered) for each block.

    ``entered`` is the state of each turn, ``wrong`` the index of the block's first turn that the machine doesn't allow
    after the one before it. The state that a block begins in is that of the last role before it.
    """
    states = template.states()
    other = len(states) + 1
    number = {template.start: 0} | {r: at for at, r in enumerate(states, 1)}
    numbers = F.create_map(*[x for r, at in number.items() if at for x in (F.lit(r), F.lit(at))])
    allowed = [[number[r] for r in template.follows.get(k, ())] for k in (template.start, *states)]
    after = F.array(*[F.array(*map(F.lit, to)).cast("array<int>") for to in [*allowed, []]])
    of_role = lambda role: F.coalesce(F.try_element_at(numbers, role), F.lit(other))

    def step(state: Column, turn: Column) -> Column:
        to = of_role(turn["role"])
        right = F.array_contains(F.element_at(after, state["state"] + 1), to)
        return F.struct(
            to.alias("state"),
            (state["at"] + 1).alias("at"),
            F.coalesce(state["wrong"], F.when(~right, state["at"])).alias("wrong"),
            F.concat(state["entered"], F.array(to)).alias("entered"),
        )

    def block(at: Column) -> Column:
        state = F.when(at == 0, 0).otherwise(of_role(F.get(turns, at - 1)["role"]))
        begin = F.struct(state.alias("state"), at.alias("at"), F.lit(None).cast("int").alias("wrong"), F.array().cast("array<int>").alias("entered"))
        return F.aggregate(F.slice(turns, at + 1, BLOCK), begin, step)

    return F.transform(F.sequence(F.lit(0), F.size(turns) - 1, F.lit(BLOCK)), block)


def format_conversations(conversations: DataFrame, template: Template = CHATML) -> DataFrame:
    """(conv_id, n_turns, valid, first_wrong, segments, formatted) for each conversation.

    ``segments`` is an array of (text, loss); ``first_wrong`` is the index of the first turn out of order, or null.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select("conv_id", F.struct(F.col("turn"), empty("role").alias("role"), empty("text").alias("text")).alias("row"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("turns"))
    ran = turns.select("conv_id", "turns", _machine(template, F.col("turns")).alias("ran"))
    ran = ran.select("conv_id", "turns", F.array_min("ran.wrong").alias("first_wrong"), F.flatten("ran.entered").alias("states"))
    with_loss = [at for at, role in enumerate(template.states(), 1) if role in template.loss_roles]
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.zip_with(
            "turns",
            "states",
            lambda t, s: F.array(
                segment(F.concat(F.lit(template.begin), escape_role(t["role"], template), F.lit(template.after_role)), F.lit(False)),
                segment(escape(t["text"], template), s.isin(*with_loss) if with_loss else F.lit(False)),
                segment(F.lit(template.end), F.lit(False)),
            ),
        )
    )
    return ran.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "first_wrong", segments.alias("segments")).select(
        "conv_id",
        "n_turns",
        F.col("first_wrong").isNull().alias("valid"),
        "first_wrong",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_back(formatted: Column, template: Template = CHATML) -> Column:
    """The turns, an array of (role, text), that a formatted conversation holds."""
    parts = F.split(formatted, "".join(map(_quoted, template.begin)), -1)

    def turn(part: Column) -> Column:
        at = F.instr(part, template.after_role)
        body = F.substring(part, at + len(template.after_role), F.length(part) - at - len(template.after_role) + 1 - len(template.end))
        return F.struct(unescape_role(F.substring(part, F.lit(1), at - 1), template).alias("role"), unescape(body, template).alias("text"))

    return F.transform(F.slice(parts, F.lit(2), F.size(parts)), turn)


def digests(conversations: DataFrame, template: Template = CHATML) -> DataFrame:
    """Format, read back, and give each conversation's digests; the loss flags are the machine's."""
    line = F.lit("\n")
    joined = lambda column, of: F.array_join(F.transform(column, of), "")
    loss = joined(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template))
    return (
        format_conversations(conversations, template)
        .select("*", read_back(F.col("formatted"), template).alias("read"), loss.alias("loss"))
        .select(
            "conv_id",
            F.size("read").cast("long").alias("n_turns"),
            F.sha2(joined("read", lambda t: F.concat(t["role"], line, t["text"], line)).cast("binary"), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )
