"""Chat formatting by a declarative template and a finite-state machine over roles, on built-in expressions only.

Each turn becomes three segments: opening marker, text, closing marker, each with a loss flag. Inside a text the escape
character is doubled and control strings are broken up by it, so that every marker in the output is a real one and the
texts can be read back.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Turn:
    """Markers of one role and whether its text is trained on."""

    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """``roles`` by name, ``other`` for any further role, whose name is written into the marker in place of ``{role}``.

    ``moves`` holds the machine's arrows as state -> roles that may come next; the state is the last role, and
    ``start`` before the first. ``control`` lists the strings that must not occur inside a text; each has at least two
    characters and begins with ``<`` or ``[``.
    """

    roles: Mapping[str, Turn]
    other: Turn
    moves: Mapping[str, tuple[str, ...]]
    final: tuple[str, ...]
    control: tuple[str, ...] = field(default=())


INSTRUCTION = Template(
    roles={
        "system": Turn("<<SYS>>", "<</SYS>>"),
        "user": Turn("<s>[INST] ", " [/INST]"),
        "assistant": Turn("[OUT]", "</s>", loss=True),
    },
    other=Turn("[ROLE]{role}[/ROLE]", "[/TURN]"),
    moves={"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    final=("assistant", "user"),
    control=(
        "<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[/ROLE]", "[/TURN]",
    ),
)


def escape(text: Column, template: Template = INSTRUCTION) -> Column:
    """``text`` without control strings; reversed by ``unescape``."""
    doubled = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    tails = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in template.control)
    return F.regexp_replace(doubled, tails, ESCAPE * 2)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turn_order(roles: Column, template: Template = INSTRUCTION) -> Column:
    """True if the machine accepts the list of roles: every arrow exists and the last state is a final one."""
    arrows = [f"{state}>{role}" for state, nexts in template.moves.items() for role in nexts]
    steps = F.zip_with(
        F.concat(F.array(F.lit("start")), F.slice(roles, 1, F.greatest(F.size(roles) - 1, F.lit(0)))),
        roles,
        lambda state, role: F.concat(state, F.lit(">"), role),
    )
    known = F.forall(steps, lambda step: F.coalesce(step.isin(arrows), F.lit(False)))
    return known & F.coalesce(F.element_at(roles, -1).isin(list(template.final)), F.lit(False))


def _segments(role: Column, text: Column, template: Template) -> Column:
    """Opening, text and closing of one turn as structs of text and loss flag."""
    before, after = template.other.opening.split("{role}")
    opening = F.concat(F.lit(before), escape(role, template), F.lit(after))
    closing, loss = F.lit(template.other.closing), F.lit(template.other.loss)
    for name, turn in template.roles.items():
        opening = F.when(role == name, F.lit(turn.opening)).otherwise(opening)
        closing = F.when(role == name, F.lit(turn.closing)).otherwise(closing)
        loss = F.when(role == name, F.lit(turn.loss)).otherwise(loss)
    silent = F.lit(False)
    return F.array(
        F.struct(opening.alias("text"), silent.alias("loss")),
        F.struct(escape(text, template).alias("text"), loss.alias("loss")),
        F.struct(closing.alias("text"), silent.alias("loss")),
    )


def format_chats(
    turns: DataFrame,
    template: Template = INSTRUCTION,
    id_column: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per conversation: ``formatted``, its ``segments`` with loss flags, ``n_turns`` and ``valid_order``.

    Turns go by ``turn``, equal ones by role and text; null turns come first. A null text or role is empty. Repeated
    rows are repeated turns, and rows of a null id form one conversation. Other columns are ignored. A conversation the
    machine does not accept is formatted all the same and marked ``valid_order`` = false. A conversation is one output
    row, so it has to fit in one; nothing else is gathered.
    """
    clean = turns.select(
        F.col(id_column).alias(id_column),
        F.col(turn).alias("_turn"),
        F.coalesce(F.col(role), F.lit("")).alias("_role"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    )
    grouped = clean.groupBy(id_column).agg(
        F.sort_array(F.collect_list(F.struct("_turn", "_role", "_text"))).alias("_turns")
    )
    roles = F.transform("_turns", lambda t: t["_role"])
    parts = F.flatten(F.transform("_turns", lambda t: _segments(t["_role"], t["_text"], template)))
    return grouped.select(
        id_column,
        F.size("_turns").cast("long").alias("n_turns"),
        turn_order(roles, template).alias("valid_order"),
        parts.alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_chats(formatted: Column, template: Template = INSTRUCTION) -> Column:
    """The turns in a formatted text as an array of structs of ``role`` and ``text``, by its markers alone."""
    before, after = (re.escape(x) for x in template.other.opening.split("{role}"))
    openings = [f"(?:{re.escape(t.opening)})" for t in template.roles.values()] + [f"(?:{before}.*?{after})"]
    closings = "|".join(re.escape(t.closing) for t in [*template.roles.values(), template.other])
    pattern = F.lit(f"(?s)({'|'.join(openings)})(.*?)(?:{closings})")
    opening = F.regexp_extract_all(formatted, pattern, F.lit(1))
    texts = F.regexp_extract_all(formatted, pattern, F.lit(2))

    def role_of(marker: Column) -> Column:
        named = F.regexp_extract(marker, f"(?s)^{before}(.*?){after}$", 1)
        name = unescape(named)
        for role, turn in template.roles.items():
            name = F.when(marker == turn.opening, F.lit(role)).otherwise(name)
        return name

    return F.zip_with(
        opening, texts, lambda marker, body: F.struct(role_of(marker).alias("role"), unescape(body).alias("text"))
    )
