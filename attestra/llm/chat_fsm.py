"""Chat formatting by a finite-state machine over roles and a declarative template, in DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are written, which roles are learned from, and which role may follow which.

    A turn is ``open``, the role, ``mid``, the text, ``close``. In roles and texts every character of
    ``escapes`` is replaced by its pair; the pairs start with the escape sign, which is itself the first
    to be replaced, so the change is reversible. A template whose ``mid`` or ``close`` might also be read
    where none was written is refused: both must hold signs that no escaped text has. ``moves`` maps a
    state and a role to the next state; ``final`` are the states in which a conversation may end.
    """

    open: str = "### "
    mid: str = ": "
    close: str = " </turn>\n"
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))
    learned: frozenset[str] = frozenset({"assistant"})
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user", ("assistant", "tool"): "tool", ("tool", "assistant"): "assistant"})
    final: frozenset[str] = frozenset({"assistant"})

    def __post_init__(self):
        raw, pairs = [a for a, _ in self.escapes], [b for _, b in self.escapes]
        if not raw or len({*raw}) < len(raw) or any(len(a) != 1 for a in raw) or any(len(b) != 2 or b[0] != raw[0] or b[1] in raw for b in pairs) or len({*pairs}) < len(pairs):
            raise ValueError("escapes must be of single signs, the escape sign first, to it and a letter that is no such sign")
        turn = [self.open, None, self.mid, None, self.close]
        if not self.mid or not self.close or self._misread(self.close, turn, 4) or self._misread(self.mid, turn[1:], 1):
            raise ValueError("mid and close must not be readable where none was written: each needs a sign that texts have escaped")

    def _misread(self, mark: str, parts: list[str | None], own: int) -> bool:
        """Whether ``mark`` may be read in ``parts`` (None: any escaped text) before its own place, the part ``own``."""
        signs = {a for a, _ in self.escapes[1:]}

        def steps(part: int, at: int, sign: str):
            """Places after ``sign`` was read at a place."""
            while part < len(parts):
                if parts[part] is None:
                    if sign not in signs:
                        yield part, 1
                    part, at = part + 1, 0
                elif at < len(parts[part]):
                    if parts[part][at] == sign:
                        yield part, at + 1
                    return
                else:
                    part, at = part + 1, 0

        now = {(p, i) for p in range(own) for i in range(len(parts[p] or "x"))}
        for k, sign in enumerate(mark):
            now = {x for p, i in now for x in steps(p, i, sign)}
            if not k:  # from here its own place is no start
                now = {x for x in now if x != (own, 1)}
        return bool(now)

    def escape(self, text: Column) -> Column:
        for raw, pair in self.escapes:
            text = F.replace(text, F.lit(raw), F.lit(pair))
        return text

    def unescape(self, text: Column) -> Column:
        for raw, pair in reversed(self.escapes):
            text = F.replace(text, F.lit(pair), F.lit(raw))
        return text


def final_state(roles: Column, template: Template) -> Column:
    """The state after the roles in order; `invalid` from the first move that the template does not name."""
    table = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\x00{role}", to)])
    return F.aggregate(roles, F.lit("start"), lambda state, role: F.coalesce(F.try_element_at(table, F.concat(state, F.lit("\x00"), role)), F.lit("invalid")))


def format_conversations(turns: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(<conv>, n_turns, segments array<struct<text, loss>>, formatted, state, valid)`` per conversation.

    Turns go in order of ``turn``, null first, ties by role and then text, so repeated rows stand next
    to each other and are all kept. A null role or text counts as empty; a null conversation id is an id
    of its own; an empty table gives an empty result, and other columns are not read. ``segments`` are
    the pieces of ``formatted`` in order; loss is true for the texts of learned roles only, not for
    marks. Invalid orders of roles are formatted too and have ``valid`` false. A conversation is one
    row, so its turns meet in one task; that is bounded by the longest conversation, not by the table,
    and the work is in proportion to its characters.
    """
    empty = F.lit("")
    rows = turns.select(F.col(conv).alias("conv_"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text")).alias("t"))
    whole = rows.groupBy("conv_").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    t = template

    def parts(x: Column) -> Column:
        head = F.concat(F.lit(t.open), t.escape(x["role"]), F.lit(t.mid))
        learn = x["role"].isin(*sorted(t.learned))
        return F.array(F.struct(head.alias("text"), F.lit(False).alias("loss")), F.struct(t.escape(x["text"]).alias("text"), learn.alias("loss")), F.struct(F.lit(t.close).alias("text"), F.lit(False).alias("loss")))

    segments = F.flatten(F.transform("turns", parts))
    out = whole.select("conv_", F.size("turns").cast("long").alias("n_turns"), segments.alias("segments"), final_state(F.transform("turns", lambda x: x["role"]), t).alias("state"))
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return out.select(F.col("conv_").alias(conv), "n_turns", "segments", formatted.alias("formatted"), "state", F.col("state").isin(*sorted(t.final)).alias("valid"))


def read_back(formatted: DataFrame, template: Template = Template(), conv: str = "conv_id") -> DataFrame:
    """``(<conv>, turns array<struct<role, text>>, learned_text, formatted_chars, loss_chars, n_turns, state, valid)`` from the written form.

    Turns are found by the marks alone. The learned text is what the loss flags cover, unescaped, with
    nothing between its pieces: each turn's text is one segment, between those of its marks, and the
    texts read at the places of segments with the flag are put together. One pass over the characters.
    """
    t = template
    quoted = re.sub(r"([^\w\s])", r"\\\1", t.close)
    # what follows the last mark is empty, as every turn ends with one
    pieces = F.split("formatted", quoted, -1)
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn_of(p: Column) -> Column:
        body = F.substring(p, len(t.open) + 1, 2147483647)
        head = F.substring_index(body, t.mid, 1)
        rest = F.substring(body, F.char_length(head) + len(t.mid) + 1, F.lit(2147483647))
        return F.struct(t.unescape(head).alias("role"), t.unescape(rest).alias("text"))

    flagged = F.transform("turns", lambda x, i: F.when(F.get("segments", 3 * i + 1)["loss"], x["text"]).otherwise(""))
    out = formatted.select(F.col(conv), F.transform(pieces, turn_of).alias("turns"), "segments", F.char_length("formatted").cast("long").alias("formatted_chars"), "state", "valid")
    out = out.withColumn("learned_text", F.array_join(flagged, "")).drop("segments")
    return out.withColumn("loss_chars", F.char_length("learned_text").cast("long")).withColumn("n_turns", F.size("turns").cast("long"))
