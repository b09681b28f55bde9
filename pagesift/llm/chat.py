"""Chat formatting in DataFrame expressions: a declarative template, a state machine over roles, loss flags.

A conversation becomes segments: text with a flag that says whether it counts in
the loss.  Markers open and close each turn; control strings inside texts get a
backslash behind their first character (one more, if they have some already), so
that no text can pass for a marker and every text can be restored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions.binding import computed
from pagesift.llm.common import column


@dataclass(frozen=True)
class Turn:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Markers per role and the turn order.

    ``moves`` maps (state, role) to the next state; a missing move is an error from
    which there is no way back.  A conversation is ``complete`` if it ends in one
    of ``final``.  A role without markers of its own is written between
    ``other_open`` and ``other_name``, its text up to ``other_close``.
    """

    turns: dict[str, Turn] = field(
        default_factory=lambda: {
            "system": Turn("<<SYS>>", "<</SYS>>"),
            "user": Turn("[INST]", "[/INST]"),
            "assistant": Turn("<s>", "</s>", loss=True),
        }
    )
    other_open: str = "<<ROLE>>"
    other_name: str = "<</ROLE>>"
    other_close: str = "<</TURN>>"
    first: str = "start"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "ready",
            ("start", "user"): "asked",
            ("ready", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    final: tuple[str, ...] = ("answered",)

    def __post_init__(self) -> None:
        markers = self.markers()
        if len(set(markers)) != len(markers):
            raise ValueError("markers have to differ")
        for a in markers:
            if len(a) < 2 or "\\" in a:
                raise ValueError("a marker has two characters at least and no backslash")
            for b in markers:
                # No marker may begin inside another one: places of markers would be ambiguous.
                if any(b.startswith(a[i:]) or a[i:].startswith(b) for i in range(1, len(a))):
                    raise ValueError(f"{b} can begin inside {a}")

    def markers(self) -> list[str]:
        own = [m for t in self.turns.values() for m in (t.open, t.close)]
        return [*own, self.other_open, self.other_name, self.other_close]

    def closers(self) -> str:
        return "|".join(re.escape(c) for c in [*[t.close for t in self.turns.values()], self.other_close])

    def by_first(self) -> dict[str, str]:
        """Pattern of what follows the first character of a marker, for each such character."""
        rest: dict[str, list[str]] = {}
        for m in self.markers():
            rest.setdefault(m[0], []).append(re.escape(m[1:]))
        return {first: "|".join(ends) for first, ends in rest.items()}


LLAMA_LIKE = Template()


def escaped(text: Column, template: Template) -> Column:
    for first, rest in template.by_first().items():
        text = F.regexp_replace(text, f"({re.escape(first)})(\\\\*(?:{rest}))", "$1\\\\$2")
    return text


def unescaped(text: Column, template: Template) -> Column:
    for first, rest in template.by_first().items():
        text = F.regexp_replace(text, f"({re.escape(first)})\\\\(\\\\*(?:{rest}))", "$1$2")
    return text


def segment(text: Column | str, loss: bool) -> Column:
    return F.struct((F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit(loss).alias("loss"))


def segments_of(role: Column, text: Column, template: Template) -> Column:
    """array<struct<text, loss>> of one turn."""
    safe = escaped(text, template)
    other = F.concat(F.lit(template.other_open), escaped(role, template), F.lit(template.other_name))
    out = F.array(segment(other, False), segment(safe, False), segment(template.other_close, False))
    for name, turn in template.turns.items():
        own = F.array(segment(turn.open, False), segment(safe, turn.loss), segment(turn.close, False))
        out = F.when(role == name, own).otherwise(out)
    return out


def last_state(turns: Column, template: Template) -> Column:
    """State after all turns; ``error`` once a role had no move."""
    key = lambda state, role: F.concat_ws("\n", state, role)
    table = F.create_map(*[F.lit(x) for (s, r), to in template.moves.items() for x in (f"{s}\n{r}", to)])
    move = lambda state, turn: F.coalesce(F.try_element_at(table, key(state, turn["role"])), F.lit("error"))
    return F.aggregate(turns, F.lit(template.first), move)


def format_conversations(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    template: Template = LLAMA_LIKE,
) -> DataFrame:
    """One row per conversation: ``conv_id, segments, formatted, valid, complete``.

    ``segments`` is array<struct<text, loss>>, ``formatted`` their texts in a row.
    Turns are ordered by number (nulls first), ties by role, then text; repeated
    rows are repeated turns.  Null roles and texts are empty ones; a role that the
    template does not name is kept with its name.  Conversations with a bad turn
    order are formatted like others and have ``valid`` false.  Rows without a
    conversation id form one conversation.  An empty table gives no rows; other
    columns are not looked at.  A conversation is one value, as a training sample
    is, and has to fit into a row.
    """
    turn = F.struct(
        column(turn_col).alias("turn"),
        F.coalesce(column(role_col), F.lit("")).alias("role"),
        F.coalesce(column(text_col), F.lit("")).alias("text"),
    )
    grouped = rows.groupBy(column(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    made = grouped.select(
        "conv_id",
        computed(
            F.flatten(F.transform("turns", lambda t: segments_of(t["role"], t["text"], template))).alias("segments"),
            last_state(F.col("turns"), template).alias("state"),
        ),
    )
    return made.select(
        "conv_id",
        "segments",
        F.array_join(F.col("segments.text"), "").alias("formatted"),
        (F.col("state") != "error").alias("valid"),
        F.col("state").isin(*template.final).alias("complete"),
    )


def parse_turns(formatted: Column, template: Template = LLAMA_LIKE) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    pieces = F.split(formatted, template.closers(), -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        # What none of the known roles opens stands behind the name of its role.
        name = F.substring_index(piece, template.other_name, 1)
        role = F.substr(name, F.lit(len(template.other_open) + 1), F.length(name))
        text = F.substr(piece, F.length(name) + F.lit(len(template.other_name) + 1), F.length(piece))
        for known, marks in template.turns.items():
            own = F.startswith(piece, F.lit(marks.open))
            role = F.when(own, F.lit(known)).otherwise(role)
            text = F.when(own, F.substr(piece, F.lit(len(marks.open) + 1), F.length(piece))).otherwise(text)
        return F.struct(unescaped(role, template).alias("role"), unescaped(text, template).alias("text"))

    return F.transform(pieces, turn)


def loss_text(segments: Column, template: Template = LLAMA_LIKE) -> Column:
    """All text under the loss mask, in order, as it was before escaping."""
    counted = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(counted, lambda s: unescaped(s["text"], template)), "")


def read_back(formatted: DataFrame, template: Template = LLAMA_LIKE) -> DataFrame:
    """``conv_id, turns, loss_text, formatted_chars, valid, complete`` from the output of ``format_conversations``."""
    return formatted.select(
        "conv_id",
        computed(
            parse_turns(F.col("formatted"), template).alias("turns"), loss_text(F.col("segments"), template).alias("loss_text")
        ),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "complete",
    )


def _oracle(template: Template) -> str:
    moves = " ".join(f"when s = '{state}' and r = '{role}' then '{to}'" for (state, role), to in template.moves.items())
    final = ", ".join(f"'{state}'" for state in template.final)
    return _SQL.replace("$MOVES", moves).replace("$FIRST", template.first).replace("$FINAL", final)


_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (
  select *, regexp_replace(regexp_replace(text, '(<)(\\*(?:/?s>|</?(?:SYS|ROLE|TURN)>>))', '\1\\\2', 'g'),
                           '(\[)(\\*/?INST\])', '\1\\\2', 'g') as safe,
         case role when 'system' then 15 when 'user' then 13 when 'assistant' then 7 else 26 + length(role) end as marks
  from c),
-- Roles fold to the state they end in; a role without a move is an error for good.
m as (
  select conv_id, list_reduce(list(role order by turn nulls first, role, text),
           lambda s, r: case $MOVES else 'error' end, '$FIRST') as state
  from c group by conv_id)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(length(safe) + marks) as bigint) as formatted_chars,
       any_value(state) <> 'error' as valid, any_value(state) in ($FINAL) as complete
from e join m using (conv_id) group by conv_id"""

ORACLE = _oracle(LLAMA_LIKE)
