"""Chat formatting (DataFrame functions only).

A template is data: markers around a turn, the roles whose text bears loss, and
the transitions of the machine that validates the order of the roles.  Texts and
roles are escaped so that no control string of the template can occur in them and
the original comes back exactly.

A conversation is the unit of the output: its formatted text is one value, so it
must fit one row.  Conversations themselves are spread by ``conv_id``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``open`` role ``head`` text ``close`` for every turn.

    ``escapes`` maps each character that starts or ends a control string, and the
    backslash first, to the letter written after a backslash in its place.  A template
    from which a text could not be read back is refused.
    """

    open: str = "<turn "
    head: str = ">\n"
    close: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    escapes: tuple[tuple[str, str], ...] = (("\\", "b"), ("<", "l"), (">", "g"))
    start: str = "start"
    accepting: tuple[str, ...] = ("assistant",)
    moves: tuple[tuple[str, str, str], ...] = field(default=(
        ("start", "system", "system"), ("start", "user", "user"), ("system", "user", "user"),
        ("user", "assistant", "assistant"), ("assistant", "user", "user")))

    def __post_init__(self):
        chars, letters = [c for c, _ in self.escapes], [x for _, x in self.escapes]
        if not chars or chars[0] != "\\" or any(len(x) != 1 for x in chars + letters):
            raise ValueError("escapes are pairs of single characters, the backslash first")
        if len(set(chars)) < len(chars) or len(set(letters)) < len(letters):
            raise ValueError("escaped characters and their letters must be distinct")
        if set(chars) & set(letters):
            raise ValueError("an escape letter must not be an escaped character")
        for name in ("head", "close"):
            marker = getattr(self, name)
            if not marker or marker[0] not in chars[1:]:
                raise ValueError(f"{name} must begin with an escaped character: {marker!r}")
        # a text never holds an escaped character as such, so only the markers before the
        # text could begin what looks like the end of a turn
        for name in ("open", "head"):
            marker = getattr(self, name)
            for k in range(len(marker)):
                rest = marker[k:]
                if rest.startswith(self.close) or self.close.startswith(rest):
                    raise ValueError(f"{name} {marker!r} can be taken for close {self.close!r}")


CHAT = Template()


def escape(text: Column, template: Template = CHAT) -> Column:
    """After this a text has no unescaped character of ``template.escapes``."""
    for char, letter in template.escapes:
        text = F.replace(text, F.lit(char), F.lit("\\" + letter))
    return text


def unescape(text: Column, template: Template = CHAT) -> Column:
    """Inverse of :func:`escape`: every backslash starts a code, so order only matters at the end."""
    for char, letter in reversed(template.escapes):
        text = F.replace(text, F.lit("\\" + letter), F.lit(char))
    return text


def _state(roles: Column, template: Template) -> Column:
    """State after all roles; ``error`` absorbs."""
    moves = F.create_map(*[F.lit(x) for a, role, b in template.moves
                           for x in (f"{a}\n{role}", b)])
    return F.aggregate(roles, F.lit(template.start), lambda s, r: F.coalesce(
        F.try_element_at(moves, F.concat(s, F.lit("\n"), r)), F.lit("error")))


def format_chats(rows: DataFrame, template: Template = CHAT) -> DataFrame:
    """``conv_id, n_turns, valid, segments, formatted``, one row per conversation.

    ``segments``: ``array<struct<text, loss>>`` whose texts concatenate to ``formatted``;
    ``valid``: the roles end in an accepting state.  Conversations in a wrong order are
    formatted too.  Rows are ordered by turn, then role and text (nulls first); equal
    rows all stay.  Null text or role: empty.  Null conv_id: one conversation of its
    own.  An empty table gives no rows; other columns are ignored.
    """
    empty = F.lit("")
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        F.col("turn"), F.coalesce(F.col("role").cast("string"), empty).alias("role"),
        F.coalesce(F.col("text").cast("string"), empty).alias("text")))).alias("turns"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def of_turn(t: Column) -> Column:
        no = F.lit(False)
        return F.array(
            segment(F.concat(F.lit(template.open), escape(t["role"], template),
                             F.lit(template.head)), no),
            segment(escape(t["text"], template), t["role"].isin(list(template.loss_roles))),
            segment(F.lit(template.close), no))

    segments = F.flatten(F.transform("turns", of_turn))
    return (turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        _state(F.transform("turns", lambda t: t["role"]), template)
        .isin(list(template.accepting)).alias("valid"), segments.alias("segments"))
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")))


def read_turns(formatted: Column, template: Template = CHAT) -> Column:
    """``array<struct<role, text>>`` parsed from a formatted text."""
    parts = F.split(formatted, "\\Q" + template.close + "\\E", -1)
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def parse(part: Column) -> Column:
        skip = len(template.open)
        at = F.locate(template.head, part, skip + 1)
        return F.struct(
            unescape(F.substring(part, F.lit(skip + 1), at - 1 - skip), template).alias("role"),
            unescape(F.substring(part, at + len(template.head), F.length(part)), template)
            .alias("text"))

    return F.transform(turns, parse)


def loss_text(segments: Column, template: Template = CHAT) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]),
                                    lambda s: unescape(s["text"], template)), "")


def chat_digest(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """What the formatted conversations read back to, as counts and digests."""
    read = formatted.withColumn("back", read_turns(F.col("formatted"), template)) \
        .withColumn("loss", loss_text(F.col("segments"), template))
    turns = F.array_join(F.transform("back", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid")
