"""Chat formatting with typed content parts.

A message's content is a list of typed parts: text, image, audio or document. A visitor flattens them, in
order, into the turn's text: an attachment becomes a placeholder and is recorded (message, number,
kind, reference) with the tokens it will expand to, by rules per kind. Then the template marks turns:

    <|turn:ROLE|>TEXT<|end|>\\n

Control strings inside texts are escaped reversibly: ``<``, any backslashes and ``|`` get one more backslash,
so the template's own marks are the only ``<|`` in the output; in roles ``\\``, ``|`` and ``<`` are escaped. Text may hold
anything, placeholders included: an escaped one isn't an attachment. The loss mask covers the content of
assistant turns (with its placeholders): a span (start, length, in code points of the formatted turn), without marks.

A row per turn is formatted where it is, by column expressions; a conversation's formatted text is its
turns' pieces in order. Nothing gathers a conversation for formatting, so one with millions of turns is no
problem; the reader, whose checksums run over a conversation in order, streams over sorted turns and keeps one
turn at a time.

Defined cases: NULL texts and roles are empty; NULL parts and part lists are empty; an unknown part type
raises; rows of the same turn come in the order of role and text; NULL turns come first; a NULL conversation
id is a conversation of its own; an empty table gives an empty result. Extra columns are not carried.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|turn:", "|>", "<|end|>\n"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENTS = ("image", "audio", "document")
ROLE_ESCAPES = (("\\", "\\\\"), ("|", "\\!"), ("<", "\\("))  # in this order


@dataclass(frozen=True)
class ChatOptions:
    patch: int = 14  # pixels of an image patch's side; a patch is a token
    merge: int = 2  # patches merged in each direction
    audio_rate: float = 25.0  # tokens a second
    page_tokens: int = 256  # of a document page
    loss_roles: tuple[str, ...] = field(default=("assistant",))


def escaped(text: Column) -> Column:
    """Content with its control strings escaped; ``unescaped`` gives it back."""
    # runs of backslashes between < and | grow by one: no "<|" is left, and every run can be told from the others
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<$1\\|")


def escaped_role(role: Column) -> Column:
    """A role without ``|`` and ``<``."""
    safe = F.coalesce(role, F.lit(""))
    for char, written in ROLE_ESCAPES:
        safe = F.replace(safe, F.lit(char), F.lit(written))
    return safe


def unescaped_role(role: str) -> str:
    back = {written: char for char, written in ROLE_ESCAPES}
    return re.sub(r"\\.", lambda m: back[m[0]], role, flags=re.DOTALL)


ESCAPED = re.compile(r"<(\\*)\\\|")


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


# --- parts ----------------------------------------------------------------------------------------


def expanded_tokens(part: Column, options: ChatOptions) -> Column:
    """Tokens an attachment stands for; 0 for text, whose tokens are counted by a tokenizer."""
    side = options.patch * options.merge
    patches = F.ceil(F.coalesce(part["width"], F.lit(0)) / side) * F.ceil(F.coalesce(part["height"], F.lit(0)) / side)
    return (
        F.when(part["kind"] == "image", patches)
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * options.audio_rate))
        .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(0)) * options.page_tokens)
        .otherwise(0)
        .cast("long")
    )


def visit(state: Column, part: Column) -> Column:
    """One step of the visitor: text is gathered, an attachment closes what was gathered and adds its placeholder."""
    unknown = F.raise_error(F.concat(F.lit("unknown content part: "), F.coalesce(part["kind"], F.lit("NULL"))))
    done = F.when(part["kind"] == "text", state["done"]).when(
        part["kind"].isin(*ATTACHMENTS),
        F.concat(state["done"], escaped(state["text"]), F.lit("<|"), part["kind"], F.lit("|>")),
    ).otherwise(unknown.cast("string"))
    text = F.when(part["kind"] == "text", F.concat(state["text"], F.coalesce(part["text"], F.lit("")))).otherwise("")
    return F.struct(done.alias("done"), text.alias("text"))


def flattened(messages: DataFrame, options: ChatOptions = ChatOptions()) -> DataFrame:
    """Messages (conv_id, turn, role, parts) to (conv_id, turn, role, content, attachments, expanded_tokens).

    ``content`` is escaped text with placeholders; ``attachments`` has, in order, number, kind, ref and tokens.
    """
    parts = F.filter(F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    nothing = F.struct(F.lit("").alias("done"), F.lit("").alias("text"))
    content = F.aggregate("_parts", nothing, visit, lambda s: F.concat(s["done"], escaped(s["text"])))
    attachments = F.transform(
        F.filter("_parts", lambda p: p["kind"] != "text"),
        lambda p, i: F.struct(
            i.alias("number"), p["kind"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p, options).alias("tokens")
        ),
    )
    flat = messages.select("conv_id", "turn", "role", parts.alias("_parts")).select(
        "conv_id", "turn", "role", content.alias("content"), attachments.alias("attachments")
    )
    total = F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    return flat.withColumn("expanded_tokens", total)


def text_parts(conversations: DataFrame) -> DataFrame:
    """Plain rows (conv_id, turn, role, text) as messages with one text part each."""
    part = F.struct(
        F.lit("text").alias("kind"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.lit(None).alias("ref"),
        F.lit(None).alias("width"), F.lit(None).alias("height"), F.lit(None).alias("seconds"), F.lit(None).alias("pages"),
    ).cast(PART)
    return conversations.select("conv_id", "turn", "role", F.array(part).alias("parts"))


# --- template -------------------------------------------------------------------------------------


def formatted(messages: DataFrame, options: ChatOptions = ChatOptions()) -> DataFrame:
    """A row per turn: conv_id, turn, piece, loss_start, loss_length (code points; 0: no loss), attachments, expanded_tokens.

    The pieces of a conversation in the order of turn, role and piece are its formatted text.
    """
    flat = flattened(messages, options)
    role = escaped_role(F.col("role"))
    opening = F.concat(F.lit(OPEN), role, F.lit(CLOSE))
    learned = F.coalesce(F.col("role"), F.lit("")).isin(*options.loss_roles)
    return flat.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.concat(opening, F.col("content"), F.lit(END)).alias("piece"),
        F.when(learned, F.length(opening)).otherwise(0).cast("long").alias("loss_start"),
        F.when(learned, F.length("content")).otherwise(0).cast("long").alias("loss_length"),
        "attachments",
        "expanded_tokens",
    )


TURN = re.compile(r"<\|turn:(.*?)\|>(.*?)<\|end\|>\n", re.DOTALL)


PLACEHOLDER = re.compile(r"<\|(" + "|".join(ATTACHMENTS) + r")\|>")


def parse_content(content: str) -> list[tuple[str, str]]:
    """The runs of a turn's content in order: ("text", its text) or (kind of attachment, "")."""
    pieces = PLACEHOLDER.split(content)
    return [
        ("text", unescaped(p)) if k % 2 == 0 else (p, "") for k, p in enumerate(pieces) if k % 2 or p
    ]


def parse_turn(piece: str) -> tuple[str, str]:
    """Role and text of a formatted turn; placeholders stay in the text."""
    found = TURN.fullmatch(piece)
    if not found:
        raise ValueError(f"no formatted turn: {piece[:80]!r}")
    return unescaped_role(found[1]), unescaped(found[2])


class _Conversation:
    """Running figures of one conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss, self.size = conv_id, 0, 0, 0
        self.turns_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, start: int, length: int) -> None:
        role, text = parse_turn(piece)
        self.turns += 1
        self.size += len(piece)
        self.turns_hash.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        learned = unescaped(piece[start : start + length])
        self.loss += len(learned)
        self.loss_hash.update(learned.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return (
            self.conv_id, self.turns, self.turns_hash.hexdigest(), self.loss, self.loss_hash.hexdigest(), self.size,
        )


FIGURES = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_conversations(turns: DataFrame) -> DataFrame:
    """Figures of each conversation, read back from its formatted pieces and loss spans."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(batches):
        now, done = None, []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_length"))
            for conv_id, piece, start, length in zip(*columns, strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Conversation(conv_id)
                now.add(piece, start, length)
            if len(done) > 10_000:
                yield batch_of(done)
                done = []
        if now is not None:
            yield batch_of([*done, now.row()])

    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "piece", "loss_start", "loss_length")
    # a conversation is read by one task, turn by turn: its checksums are sequential
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "piece")
    return ordered.mapInArrow(run, FIGURES)
