"""Chat formatting: a finite-state machine over roles plus a declarative template, all in DataFrame functions.

`format_chats` gives, for every conversation, the segments of its formatted text with a loss flag each;
`read_chats` parses such segments back into turns. Control strings inside texts are escaped reversibly: after the first
character of a control string one backslash is added, and `read_chats` takes one away, so no text can end a turn or
start another. Which strings those are follows from the template's own marks.

Defined results: null role or text count as empty; rows of a conversation are ordered by turn (null first), then
role, then text; repeated rows stay; an empty table gives an empty result; extra columns are ignored, whatever their
names; a null conversation id is a conversation of its own; a very long text is formatted whole. Conversations that
break the turn order are formatted too and carry `valid = false` with the position of the first wrong turn.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """What a turn looks like and which turns may follow each other.

    A turn is `open + role + close + text + end`. `transitions` maps a state to the roles that may come next, state
    `start` being before the first turn; a conversation may end in any state of `final`. Marks must be of two characters
    or more, without backslashes, and none may overlap another or itself, so that a text beside a mark cannot form one.
    """

    open: str = "[INST]"
    close: str = "[/INST]"
    end: str = "</s>"
    #: Strings that are no marks here but are escaped too.
    reserved: tuple[str, ...] = ("<s>",)
    loss_roles: tuple[str, ...] = ("assistant",)
    transitions: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user", "tool"),
            "tool": ("assistant",),
        }
    )
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        marks = self.controls
        for a in marks:
            if len(a) < 2 or "\\" in a:
                raise ValueError(f"{a!r} cannot be a mark: it needs two characters and no backslash")
            for b in marks:
                if a != b and a in b or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a != b))):
                    raise ValueError(f"marks {a!r} and {b!r} overlap")

    @property
    def controls(self) -> tuple[str, ...]:
        """The strings that no text may hold unescaped."""
        return tuple(dict.fromkeys((self.open, self.close, self.end, *self.reserved)))

    def _spots(self, taken: str) -> str:
        """Matches `taken` after the first character of a control string, if its rest follows, backslashes before it."""
        return "|".join(rf"(?<=\Q{m[0]}\E){taken}(?=\\*\Q{m[1:]}\E)" for m in self.controls)

    def escape(self, c: Column) -> Column:
        return F.regexp_replace(c, self._spots(""), r"\\")

    def unescape(self, c: Column) -> Column:
        return F.regexp_replace(c, self._spots(r"\\"), "")


DEFAULT_TEMPLATE = ChatTemplate()


def format_chats(
    rows: DataFrame,
    template: ChatTemplate = DEFAULT_TEMPLATE,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per conversation: its id, `n_turns`, `segments` (array of text and loss), `valid`, `bad_turn`.

    One shuffle on the conversation id; a conversation must fit in a row, since its formatted text is one value.
    """
    t = template
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = rows.groupBy(F.col(conv).alias(conv)).agg(
        F.array_sort(F.collect_list(F.struct(F.struct(F.col(turn).isNotNull().alias("known"), F.coalesce(F.col(turn), F.lit(0)).alias("n")).alias("at"), none(role).alias("role"), none(text).alias("text")))).alias("turns")
    )

    def segments(x: Column) -> Column:
        head = F.concat(F.lit(t.open), t.escape(x["role"]), F.lit(t.close))
        loss = x["role"].isin(*t.loss_roles)
        part = lambda s, on: F.struct(s.alias("text"), on.alias("loss"))
        return F.array(part(head, F.lit(False)), part(t.escape(x["text"]), loss), part(F.lit(t.end), F.lit(False)))

    allowed = F.array(*[F.lit(f"{a}\x00{b}") for a, bs in t.transitions.items() for b in bs])
    # The automaton's state: the last role, and the position of the first turn it refuses (-1: none so far).
    step = lambda s, x: F.struct(
        x["role"].alias("state"),
        (s["seen"] + 1).alias("seen"),
        F.when((s["bad"] < 0) & ~F.array_contains(allowed, F.concat(s["state"], F.lit("\x00"), x["role"])), s["seen"]).otherwise(s["bad"]).alias("bad"),
    )
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("seen"), F.lit(-1).alias("bad"))
    run = F.aggregate("turns", start, step)
    return turns.withColumn("fsm", run).select(
        conv,
        F.size("turns").cast("long").alias("n_turns"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
        ((F.col("fsm.bad") < 0) & F.col("fsm.state").isin(*t.final)).alias("valid"),
        F.when(F.col("fsm.bad") >= 0, F.col("fsm.bad")).alias("bad_turn"),
    )


def read_chats(formatted: DataFrame, template: ChatTemplate = DEFAULT_TEMPLATE) -> DataFrame:
    """Parse `format_chats` output back: adds `formatted`, `turns` (role and text) and `loss_texts`, all unescaped."""
    t = template
    quote = lambda s: r"\Q" + s + r"\E"
    whole = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    pieces = F.split("formatted", quote(t.end))
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)  # what follows the last end mark is empty
    pattern = rf"(?s)\A{quote(t.open)}(.*?){quote(t.close)}(.*)\z"
    part = lambda x, k: t.unescape(F.regexp_extract(x, pattern, k))
    return (
        formatted.withColumn("formatted", whole)
        .withColumn("turns", F.transform(pieces, lambda x: F.struct(part(x, 1).alias("role"), part(x, 2).alias("text"))))
        .withColumn("loss_texts", F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: t.unescape(s["text"])))
    )


def chat_digest(read: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The digest columns of what `read_chats` gives."""
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    lost = F.array_join("loss_texts", "")
    return read.select(
        conv,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"),
        F.sha2(lost, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
