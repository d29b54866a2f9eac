"""Chat formatting: a finite-state machine over roles and a declarative template.

Only DataFrame functions. A conversation becomes one string with marked turns, the
same string as segments with a loss flag each, and what the machine said about the
order of its turns.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INVALID = "invalid"


@dataclass(frozen=True)
class Template:
    """How turns are marked, which strings may not occur in a text, and which order is valid.

    A turn is ``role_mark role text_mark text end_mark``. ``controls`` are all strings
    with a meaning to a model; the marks are among them. ``moves`` maps a state and a
    role to the next state; a move that is not there leads to ``invalid`` for good.
    """

    role_mark: str = "<|role|>"
    text_mark: str = "<|text|>"
    end_mark: str = "<|end|>"
    controls: tuple[str, ...] = (
        "<|role|>", "<|text|>", "<|end|>", "<s>", "</s>",
        "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    )
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    final: tuple[str, ...] = ("answered",)
    moves: Mapping[str, Mapping[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked", "tool": "asked"},
        }
    )

    def __post_init__(self):
        if not {self.role_mark, self.text_mark, self.end_mark} <= set(self.controls):
            raise ValueError("the marks must be control strings")
        for c in self.controls:
            if len(c) < 2 or c[1] == "\\" or any(x in c[1:] for x in self.controls):
                raise ValueError(f"control string {c!r} can't be escaped reversibly")

    def _rests(self) -> dict[str, str]:
        """By first character, a pattern of what follows it in a control string."""
        by_first: dict[str, list[str]] = {}
        for c in self.controls:
            by_first.setdefault(c[0], []).append(re.escape(c[1:]))
        return {first: "|".join(rests) for first, rests in by_first.items()}

    def escape(self, text: Column) -> Column:
        """Put one more backslash after the first character of a control string.

        Strings that already hold backslashes there get one more too, so that
        ``unescape`` gives back every text.
        """
        found = "|".join(rf"{re.escape(f)}(?=\\*+(?:{r}))" for f, r in self._rests().items())
        return F.regexp_replace(text, found, r"$0\\")

    def unescape(self, text: Column) -> Column:
        found = "|".join(rf"(?<={re.escape(f)})\\(?=\\*+(?:{r}))" for f, r in self._rests().items())
        return F.regexp_replace(text, found, "")


DEFAULT = Template()


def _judged(turns: Column, template: Template) -> Column:
    """The machine's last state and the number of the first turn it refused."""
    moves = F.create_map(
        *[
            F.lit(x)
            for state, by_role in template.moves.items()
            for role, after in by_role.items()
            for x in (f"{state}|{role}", after)
        ]
    )
    begin = F.struct(
        F.lit(template.start).alias("state"),
        F.lit(0).alias("n"),
        F.lit(None).cast("int").alias("bad_turn"),
    )

    def step(s: Column, t: Column) -> Column:
        after = F.coalesce(
            F.try_element_at(moves, F.concat(s["state"], F.lit("|"), t["role"])), F.lit(INVALID)
        )
        bad = F.when(after == INVALID, F.coalesce(s["bad_turn"], s["n"])).otherwise(s["bad_turn"])
        return F.struct(
            after.alias("state"), (s["n"] + 1).alias("n"), bad.cast("int").alias("bad_turn")
        )

    return F.aggregate(turns, begin, step)


def format_chats(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row per conversation, from rows of (conv_id, turn, role, text).

    Returns conv_id, ``segments`` (text and loss flag; marks carry no loss),
    ``formatted`` (all segments joined), ``valid`` and ``bad_turn`` (place of the first
    turn out of order, counted from 0; null if none was).

    A null text or role counts as empty; rows with a null ``turn`` come first; rows with
    the same turn go by role and text, repeated rows all stay; rows with a null conv_id
    are one conversation. Columns beyond the four are not looked at. An empty table
    gives no rows. A conversation is one string by nature, so its turns meet in one
    row; no other rows do.
    """
    rows = conversations.select(
        "conv_id",
        F.struct(
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segments(t: Column) -> Column:
        def segment(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        no = F.lit(False)
        opening = F.concat(
            F.lit(template.role_mark), template.escape(t["role"]), F.lit(template.text_mark)
        )
        return F.array(
            segment(opening, no),
            segment(template.escape(t["text"]), t["role"].isin(*template.loss_roles)),
            segment(F.lit(template.end_mark), no),
        )

    judged = turns.select(
        "conv_id",
        F.flatten(F.transform("turns", segments)).alias("segments"),
        _judged(F.col("turns"), template).alias("judged"),
    )
    return judged.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.col("judged.state").isin(*template.final).alias("valid"),
        F.col("judged.bad_turn").alias("bad_turn"),
    )


def read_back(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Turns and loss text from what ``format_chats`` returned.

    Adds ``turns`` (role and text, parsed from the formatted string) and ``loss_text``
    (what the loss mask covers, unescaped), to check a formatted corpus.
    """
    mark = {k: re.escape(getattr(template, k)) for k in ("role_mark", "text_mark", "end_mark")}
    found = F.regexp_extract_all(
        "formatted", F.lit("(?s){role_mark}(.*?){text_mark}.*?{end_mark}".format(**mark)), 1
    )
    texts = F.regexp_extract_all(
        "formatted", F.lit("(?s){role_mark}.*?{text_mark}(.*?){end_mark}".format(**mark)), 1
    )
    loss = F.filter("segments", lambda s: s["loss"])
    return formatted.withColumns(
        {
            "turns": F.zip_with(
                found,
                texts,
                lambda role, text: F.struct(
                    template.unescape(role).alias("role"), template.unescape(text).alias("text")
                ),
            ),
            "loss_text": F.array_join(
                F.transform(loss, lambda s: template.unescape(s["text"])), ""
            ),
        }
    )
