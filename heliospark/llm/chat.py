"""Chat formatting by prefix-target expansion.

Every assistant turn is an example of its own: all turns before it are its context and only the reply is under the loss.
``expanded`` explodes the turns: each gives its piece of the conversation's text, an assistant turn also an example, with the
length of its context (all text before the reply), the reply itself, and the span under the loss. All contexts of a
conversation are prefixes of one text, so that they are told by length and kept once, as pieces. ``example_texts`` writes
examples out with their contexts, which is quadratic in the turns.

Template: ``<s>`` opens the conversation; a user turn is ``[INST] text [/INST]``, an assistant turn `` text</s>``, any other
``[ROLE]role[/ROLE]text</s>``. A mark inside a text gets one more backslash after its first character and loses it on
reading, so every text is read back as it was.

Rows are ordered by turn, ties by role and text. Null text or role is empty. Repeated rows are turns of their own; a null
conv_id is one conversation, a null turn comes first. A conversation without assistant turns has no example. Extra
columns are ignored. A conversation is read row by row, so one of any number of turns needs no more memory than a turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliospark.llm.frames import field

MARKS = r"/?INST\]|/?ROLE\]|/?s>"
ESCAPE = rf"([\[<])(\\*)({MARKS})"
UNESCAPE = re.compile(rf"([\[<])(\\*)\\({MARKS})")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1$2\\$3")


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, place (0, 1, ...), piece, start and, for assistant turns, the span [loss_start, loss_end)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text")).repartition("conv_id")
    place = F.row_number().over(order) - 1
    body = (
        F.when(F.col("role") == "user", F.concat(F.lit("[INST] "), escaped(F.col("text")), F.lit(" [/INST]")))
        .when(F.col("role") == "assistant", F.concat(F.lit(" "), escaped(F.col("text")), F.lit("</s>")))
        .otherwise(F.concat(F.lit("[ROLE]"), escaped(F.col("role")), F.lit("[/ROLE]"), escaped(F.col("text")), F.lit("</s>")))
    )
    rows = rows.withColumn("place", place).withColumn("piece", F.concat(F.when(F.col("place") == 0, "<s>").otherwise(""), body))
    size = F.char_length("piece")
    start = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    rows = rows.withColumn("start", start)
    reply = F.col("role") == "assistant"
    head = F.when(F.col("place") == 0, 4).otherwise(1)
    return rows.select(
        "conv_id",
        "place",
        "piece",
        "start",
        F.when(reply, F.col("start") + head).alias("loss_start"),
        F.when(reply, F.col("start") + size - 4).alias("loss_end"),
    )


def expanded(pieces: DataFrame) -> DataFrame:
    """Each turn's piece and each assistant turn's example: conv_id, place, context_chars, target, loss_start, loss_end, text.

    ``text`` is the piece; it is null in an example, whose ``target`` is null in a piece. The loss span counts from the
    context's first character. Explodes row by row, so nothing is shuffled.
    """
    nothing, place = F.lit(None), F.col("place")
    piece = F.struct(
        place.alias("place"),
        F.col("start").alias("context_chars"),
        nothing.cast("string").alias("target"),
        nothing.cast("long").alias("loss_start"),
        nothing.cast("long").alias("loss_end"),
        F.col("piece").alias("text"),
    )
    example = F.struct(
        place.alias("place"),
        F.col("loss_start").alias("context_chars"),
        F.substring("piece", (F.col("loss_start") - F.col("start") + 1).cast("int"), F.char_length("piece")).alias("target"),
        F.col("loss_start").alias("loss_start"),
        F.col("loss_end").alias("loss_end"),
        nothing.cast("string").alias("text"),
    )
    both = F.when(F.col("loss_start").isNull(), F.array(piece)).otherwise(F.array(piece, example))
    return pieces.select("conv_id", F.explode(both).alias("row")).select("conv_id", "row.*")


def examples(pieces: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, place, context_chars, target, loss_start, loss_end."""
    return expanded(pieces).where("target is not null").drop("text")


def example_texts(pieces: DataFrame) -> DataFrame:
    """Each example written out: conv_id, place, text, loss_start, loss_end. Its size is quadratic in the turns."""
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = pieces.withColumn("text", F.array_join(F.collect_list("piece").over(before), ""))
    return whole.where("loss_start is not null").select("conv_id", "place", "text", "loss_start", "loss_end")


def unescaped(text: str) -> str:
    return UNESCAPE.sub(r"\1\2\3", text)


class Reader:
    """Reads one conversation back from its pieces and its examples, each example after the piece that holds its reply."""

    def __init__(self):
        self.left, self.opened, self.chars = "", False, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = 0

    def learn(self, target: str, context_chars: int, loss: tuple[int, int]) -> None:
        text = unescaped(target[loss[0] - context_chars : loss[1] - context_chars])
        self.loss.update(text.encode())
        self.loss_chars += len(text)

    def feed(self, piece: str) -> None:
        self.chars += len(piece)
        text = self.left + piece
        if not self.opened and text.startswith("<s>"):
            text, self.opened = text[3:], True
        while True:
            role = "user" if text.startswith("[INST] ") else "assistant"
            end, head = ("[/INST]", 7) if role == "user" else ("</s>", 1)
            if text.startswith("[ROLE]"):
                close = text.find("[/ROLE]")
                role, head = (unescaped(text[6:close]), close + 7) if close >= 0 else (None, 0)
            at = text.find(end, head) if role is not None else -1
            if at < 0:
                break
            said = unescaped(text[head : at - (role == "user" and end == "[/INST]")])
            self.turns.update(f"{role}\n{said}\n".encode())
            self.n_turns += 1
            text = text[at + len(end) :]
        self.left = text


def read_back(pieces: DataFrame) -> DataFrame:
    """Per conversation what its formatted text and the trained replies of its examples hold."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [None, T.LongType(), T.StringType(), T.LongType(), T.StringType(), T.LongType()]
    schema = T.StructType([field(pieces, "conv_id")] + [T.StructField(n, k) for n, k in zip(names[1:], kinds[1:])])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reader = None, None

        def closed() -> tuple:
            return key, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars

        for batch in batches:
            done = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "place", "text", "target", "context_chars", "loss_start", "loss_end"))
            for conv_id, place, text, target, context_chars, first, last in zip(*columns):
                if text is None:
                    reader.learn(target, context_chars, (first, last))
                    continue
                if place == 0:
                    if reader is not None:
                        done.append(closed())
                    key, reader = conv_id, Reader()
                reader.feed(text)
            yield rows(done, batch.schema.field("conv_id").type)
        if reader is not None:
            yield rows([closed()], batch.schema.field("conv_id").type)

    def rows(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = zip(*done) if done else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    rows_in_order = expanded(pieces).sortWithinPartitions("conv_id", "place", F.col("text").isNull())
    return rows_in_order.mapInArrow(read, schema)
