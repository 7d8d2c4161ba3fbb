"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

Rows of one conversation go by turn, then role, then text.  A null text or
role counts as empty.  Roles that the template lacks are written out under
the template's `other` head and make the conversation invalid; so does a turn
that the machine does not allow.  Invalid conversations are formatted too and
say so (valid, first_bad): nothing is dropped.  Repeated rows are turns of
their own.  A null conversation id is a conversation like any other.

Escapes: inside texts a backslash is doubled, and control strings get a
backslash after their first character; `unescape` takes one backslash away in
front of every character, which is the exact inverse.  So the close mark never
occurs in an escaped text, and the formatted text can be read back.

Everything is native.  A conversation is sorted by one window, whose shuffle
also serves the grouping; offsets are running sums, so long conversations take
time in proportion to their length.  One conversation is sorted and put together
in one task, since its text needs all its turns in order: the only key here that
is not split.  An empty table gives no rows; only the four columns named are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    heads: dict[str, str] = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other: tuple[str, str] = ("### Role ", ": ")
    close: str = "</turn>\n"
    #: strings that texts must not contain as they are (each of two characters or more)
    controls: tuple[str, ...] = ("</turn>", "### ")
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> roles that may follow; a state is the last role, "" the start
    machine: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    accepts: tuple[str, ...] = ("assistant", "user")


CHAT = Template()


def escape(text: Column, t: Template = CHAT) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in t.controls:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _other_role(role: Column, t: Template) -> Column:
    # ":" ends the role's name, so it is escaped in it as well
    return F.replace(escape(role, t), F.lit(":"), F.lit("\\:"))


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: Template = CHAT) -> DataFrame:
    """One row per conversation.

    conv; n_turns; valid; first_bad (number of the first turn out of order, from 1, or null); formatted;
    segments array<struct<n,start,length,loss,role,text>>: texts between the marks as they stand in `formatted`.
    """
    t = template
    r, x = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(conv).alias("_c"), F.col(turn).alias("_t"), r.alias("_r"), x.alias("_x"))
    heads = F.create_map(*[F.lit(y) for kv in t.heads.items() for y in kv])
    head = F.coalesce(heads[F.col("_r")], F.concat(F.lit(t.other[0]), _other_role(F.col("_r"), t), F.lit(t.other[1])))
    rows = rows.withColumns({"_head": head, "_body": escape(F.col("_x"), t)})
    w = Window.partitionBy("_c").orderBy("_t", "_r", "_x")
    size = F.length("_head") + F.length("_body") + F.lit(len(t.close))
    moves = F.array(*[F.lit(f"{a}\x00{b}") for a, to in t.machine.items() for b in to])
    # the machine's state is the last role, so a row sees its state by lag
    ok = F.array_contains(moves, F.concat(F.lag("_r", 1, "").over(w), F.lit("\x00"), F.col("_r")))
    rows = rows.withColumns({
        "_n": F.row_number().over(w),
        "_end": F.sum(size.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_ok": ok,
        "_last": F.lead("_r").over(w).isNull() & F.col("_r").isin(*t.accepts),
    })
    seg = F.struct(
        F.col("_n").alias("n"), (F.col("_end") - size + F.length("_head")).alias("start"), F.length("_body").cast("long").alias("length"),
        F.col("_r").isin(*t.loss_roles).alias("loss"), F.col("_r").alias("role"), F.col("_head").alias("head"), F.col("_body").alias("text"),
    )
    out = rows.groupBy("_c").agg(
        F.array_sort(F.collect_list(seg)).alias("_s"),
        F.min(F.when(~F.col("_ok"), F.col("_n"))).alias("first_bad"),
        F.max("_last").alias("_accepted"),
    )
    return out.select(
        F.col("_c").alias(conv), F.size("_s").cast("long").alias("n_turns"),
        (F.col("first_bad").isNull() & F.col("_accepted")).alias("valid"), "first_bad",
        F.array_join(F.transform("_s", lambda s: F.concat(s["head"], s["text"], F.lit(t.close))), "").alias("formatted"),
        F.transform("_s", lambda s: s.dropFields("head")).alias("segments"),
    )


def read_turns(formatted: Column, template: Template = CHAT) -> Column:
    """array<struct<role,text>> of a formatted text: the marks are cut away and the escapes undone."""
    t = template
    pieces = F.filter(F.split(formatted, "\\Q" + t.close + "\\E"), lambda p: p != "")

    def turn(p: Column) -> Column:
        out = None
        for role, head in t.heads.items():
            cut = F.struct(F.lit(role).alias("role"), unescape(p.substr(F.lit(len(head) + 1), F.length(p))).alias("text"))
            out = F.when(p.startswith(F.lit(head)), cut) if out is None else out.when(p.startswith(F.lit(head)), cut)
        other = r"(?s)^\Q" + t.other[0] + r"\E((?:[^:\\]|\\.)*)\Q" + t.other[1] + r"\E(.*)$"
        return out.otherwise(F.struct(unescape(F.regexp_extract(p, other, 1)).alias("role"), unescape(F.regexp_extract(p, other, 2)).alias("text")))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, segments: Column) -> Column:
    """All text under the loss mask, cut from `formatted` by its offsets and unescaped, nothing between."""
    masked = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(masked, lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
