"""Chat formatting: every participant's view of a dialogue. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from voxlake.session import small_side, write_table

# Markers of the chat format, and roles that nobody speaks.
START, END = "<|im_start|>", "<|im_end|>"
CONTEXT_ROLES = ("system",)
UNNAMED = "unknown"
# Turns that one output row spans; dialogues of any length have as many rows.
TURNS_PER_PART = 128
# Messages of one part beyond which it is dealt to several rows.
MESSAGES_PER_ROW = 512


def speaker_name(role: Column) -> Column:
    """A role as a name: no white space or marker characters in it."""
    plain = F.regexp_replace(F.trim(F.coalesce(role, F.lit(""))), r"[\s<>|]+", "_")
    return F.when(plain == "", F.lit(UNNAMED)).otherwise(plain)


def _safe(text: Column) -> Column:
    """Markers inside a text cannot be taken for real ones."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate_perspectives(
    conversations: DataFrame, context_roles: Sequence[str] = CONTEXT_ROLES
) -> DataFrame:
    """One dialogue per participant of `conversations` (conv_id, turn, role, text).

    Returns (conv_id, speaker, part, piece, n_messages, text, spans). In `text` the
    speaker is the assistant, all others are users under their names, and messages
    of `context_roles` are context. `spans` are the stretches (from, to) that are
    trained on, counted in characters: the speaker's own messages with their end
    marker. Everyone but a context role is a participant; a missing or blank role is
    one called `unknown`.

    Rows follow `part` (turn divided by TURNS_PER_PART) and then `piece`, and join to
    the whole dialogue in that order, inside by (turn, name, text). No row gathers
    more than a part; a part with more messages than MESSAGES_PER_ROW, which has
    repeated turns, is dealt to pieces by a hash. A repeated row (same conv_id, turn,
    role and text) is one message. A null turn comes before all others, a null text
    is empty, a row with a null conv_id belongs to no dialogue and is left out. A
    dialogue without participants and an empty table give no rows.
    """
    name = speaker_name(F.col("role"))
    messages = (
        conversations.where("conv_id is not null")
        .select("conv_id", "turn", name.alias("name"), _safe(F.col("text")).alias("content"))
        .distinct()
        .withColumn("context", F.col("name").isin(*context_roles))
        .withColumn("part", F.coalesce(F.floor(F.col("turn") / TURNS_PER_PART), F.lit(-1)))
    )
    full = write_table(
        messages.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > MESSAGES_PER_ROW)
        .select("conv_id", "part", F.ceil(F.col("n") / MESSAGES_PER_ROW).alias("pieces")), "full",
    )
    parts = (
        messages.join(small_side(full), ["conv_id", "part"], "left")
        .withColumn("piece", F.when(F.col("pieces").isNull(), 0).otherwise(
            F.pmod(F.xxhash64("turn", "name", "content"), F.col("pieces"))).cast("long"))
        .groupBy("conv_id", "part", "piece")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "name", "content", "context"))).alias("said"))
    )
    speakers = write_table(
        conversations.where("conv_id is not null").select("conv_id", name.alias("speaker"))
        .where(~F.col("speaker").isin(*context_roles)).distinct(), "speakers",
    )
    views = write_table(parts, "parts").join(speakers, "conv_id")

    def own(m: Column) -> Column:
        return ~m["context"] & (m["name"] == F.col("speaker"))

    def opening(m: Column) -> Column:
        return (
            F.when(m["context"], F.concat(F.lit(START), m["name"], F.lit("\n")))
            .when(own(m), F.lit(f"{START}assistant\n"))
            .otherwise(F.concat(F.lit(f"{START}user name="), m["name"], F.lit("\n")))
        )

    rendered = F.transform("said", lambda m: F.struct(
        opening(m).alias("opening"), F.concat(m["content"], F.lit(END)).alias("body"),
        own(m).alias("own"),
    ))
    no_spans = F.lit(None).cast("array<struct<from:int,to:int>>")

    def further(so_far: Column, m: Column) -> Column:
        begin = so_far["at"] + F.length(m["opening"])
        end = begin + F.length(m["body"])
        span = F.array(F.struct(begin.alias("from"), end.alias("to")))
        return F.struct(
            (end + 1).alias("at"),
            F.when(m["own"], F.concat(F.coalesce(so_far["spans"], F.array().cast("array<struct<from:int,to:int>>")), span))
            .otherwise(so_far["spans"]).alias("spans"),
        )

    walked = F.aggregate("rendered", F.struct(F.lit(0).alias("at"), no_spans.alias("spans")), further)
    return views.withColumn("rendered", rendered).select(
        "conv_id", "speaker", "part", "piece", F.size("said").alias("n_messages"),
        F.concat(
            F.array_join(F.transform("rendered", lambda m: F.concat(m["opening"], m["body"])), "\n"),
            F.lit("\n"),
        ).alias("text"),
        F.coalesce(walked["spans"], F.array().cast("array<struct<from:int,to:int>>")).alias("spans"),
    )


def span_digest(spans: str = "spans") -> Column:
    """Spans as text: `from-to` joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws("-", s["from"].cast("string"), s["to"].cast("string"))), ","
    )
