"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame operations.

A template says for each role what stands before and after a turn and whether its text is trained on.
Control strings inside texts are broken up by a backslash after their first character, and backslashes
are doubled, so the formatted text can be read back exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks of the known roles; ``other`` frames a turn of any other role, whose name stands before ``text``.

    Marks begin and end so that a space parts them from the text, and hold no other space.
    ``moves`` is the machine: from a state (the last role, "" at the start) to the roles that may follow.
    """

    roles: dict[str, Turn] = field(
        default_factory=lambda: {
            "system": Turn("[SYS] ", " [/SYS]\n"),
            "user": Turn("[INST] ", " [/INST]"),
            "assistant": Turn("<s> ", " </s>\n", True),
        }
    )
    other: Turn = Turn("[ROLE] ", " [/ROLE]\n")
    text: str = " [TEXT] "
    moves: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )

    def control(self) -> list[str]:
        marks = [m for t in (*self.roles.values(), self.other) for m in (t.before, t.after)]
        return sorted({m.strip() for m in (*marks, self.text)})

    def escape(self, text: Column) -> Column:
        out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        for c in self.control():
            out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
        return out

    @staticmethod
    def unescape(text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")

    def _of_role(self, role: Column, what: str) -> Column:
        values = F.lit(getattr(self.other, what))
        for name, turn in self.roles.items():
            values = F.when(role == name, F.lit(getattr(turn, what))).otherwise(values)
        return values

    def segments(self, role: Column, text: Column) -> Column:
        """The three segments (text, loss) of a turn: what stands before, the escaped text, what stands after."""
        name = F.when(role.isin(*self.roles), F.lit("")).otherwise(F.concat(self.escape(role), F.lit(self.text)))

        def segment(t: Column, loss: Column) -> Column:
            return F.struct(t.alias("text"), loss.alias("loss"))

        none = F.lit(False)
        return F.array(
            segment(F.concat(self._of_role(role, "before"), name), none),
            segment(self.escape(text), self._of_role(role, "loss")),
            segment(self._of_role(role, "after"), none),
        )

    def turns(self, formatted: Column) -> Column:
        """Array of (role, text) read back from a formatted text."""
        every = [*self.roles.values(), self.other]
        pattern = f"(?s)({'|'.join(re.escape(t.before) for t in every)})(.*?)({'|'.join(re.escape(t.after) for t in every)})"
        opened = F.regexp_extract_all(formatted, F.lit(pattern), F.lit(1))
        inside = F.regexp_extract_all(formatted, F.lit(pattern), F.lit(2))

        def turn(before: Column, body: Column) -> Column:
            role = F.substring_index(body, self.text, 1)
            text = F.substring(body, F.length(role) + len(self.text) + 1, F.length(body))
            named, own = F.lit(None).cast("string"), before == self.other.before
            for name, t in self.roles.items():
                named = F.when(before == t.before, F.lit(name)).otherwise(named)
            return F.struct(F.when(own, self.unescape(role)).otherwise(named).alias("role"), self.unescape(F.when(own, text).otherwise(body)).alias("text"))

        return F.zip_with(opened, inside, turn)


def format_conversations(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text and any other columns).

    Returns conv_id, segments (text, loss), formatted, the text of all segments, final_role, valid, whether the
    machine took every role, and first_error, the index of the first turn it did not take (null: none).
    Turns are taken in the order of turn, ties by role and text; null texts and roles are empty. A role
    without marks of its own keeps its name in the text and is never valid. Rows with a null conv_id form
    a conversation. A conversation is one value, so it has to fit into a task's memory. An empty table
    gives no rows.
    """
    template = template or Template()
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn"), blank("role").alias("role"), blank("text").alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    allowed = F.create_map(*[x for a, roles in template.moves.items() for r in roles for x in (F.lit(f"{a}>{r}"), F.lit(r))])
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("error"))

    def move(at: Column, t: Column) -> Column:
        state = F.when(at["error"].isNull(), F.try_element_at(allowed, F.concat(at["state"], F.lit(">"), t["role"])))
        return F.struct(
            F.coalesce(state, t["role"]).alias("state"),
            (at["n"] + 1).alias("n"),
            F.coalesce(at["error"], F.when(state.isNull(), at["n"])).alias("error"),
        )

    end = F.aggregate("turns", start, move)
    segments = F.flatten(F.transform("turns", lambda t: template.segments(t["role"], t["text"])))
    return (
        grouped.withColumn("_end", end)
        .withColumn("segments", segments)
        .select(
            "conv_id",
            "segments",
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
            F.col("_end.state").alias("final_role"),
            F.col("_end.error").isNull().alias("valid"),
            F.col("_end.error").alias("first_error"),
        )
    )


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Counts and digests of formatted conversations, read back from the formatted text and the mask."""
    template = template or Template()
    joined = lambda array, f: F.array_join(F.transform(array, f), "")
    read = formatted.withColumn("_turns", template.turns(F.col("formatted"))).withColumn(
        "_loss", joined(F.filter("segments", lambda s: s["loss"]), lambda s: template.unescape(s["text"]))
    )
    return read.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(joined("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
