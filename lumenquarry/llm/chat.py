"""Conversations from event logs, and their rendering.

A log has rows (conv_id, seq, kind, message, role, text). ``open`` starts a message, ``delta`` adds to the newest
version of its message, ``edit`` starts a new version with a text of its own, ``regenerate`` a new, empty one, and
``rewind`` drops all messages after the named one that were begun before it. Events are folded for each message; only
running maxima pass over a whole conversation, and digests are taken from a stream of sorted rows, so that a
conversation of any length needs little memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Characters in one streamed delta, and of a draft that is taken back, in the log that is made from a table of turns.
DELTA, DRAFT = 4096, 16


def events_of_turns(turns: DataFrame) -> DataFrame:
    """The log of a table of finished turns (conv_id, turn, role, text) as a service would have written it.

    An assistant's turn is opened, a draft is streamed, it is regenerated and streamed in full. Another turn is opened
    with a draft, edited, and what doesn't fit the edit is streamed. Turns go by number, then role, then text; a null number comes first.
    Every row is a message of its own, repeated ones too. Null texts and roles are empty. Messages' numbers are places in the order of
    all turns, dealt by ranges of (conv_id, turn), so that no conversation is sorted in one task.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text").withColumn("message", F.monotonically_increasing_id())
    part = lambda i: F.substring("text", i * DELTA + 1, F.lit(DELTA))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("text") - 1) / DELTA)).cast("int")), part)
    event = lambda n, kind, text: F.struct(n.alias("n"), kind.alias("kind"), text.alias("text"))
    assistant, draft = F.col("role") == "assistant", F.substring("text", 1, DRAFT)
    first = F.array(event(F.lit(0), F.lit("open"), F.when(assistant, "").otherwise(draft)), event(F.lit(1), F.lit("delta"), F.when(assistant, draft).otherwise("")))
    again = F.array(event(F.lit(2), F.when(assistant, "regenerate").otherwise("edit"), F.when(assistant, "").otherwise(part(F.lit(0)))))
    streamed = F.transform(parts, lambda t, i: event(i + 3, F.lit("delta"), F.when(assistant | (i > 0), t).otherwise("")))
    rows = rows.withColumn("event", F.explode(F.concat(first, again, streamed)))
    return rows.select("conv_id", F.struct("message", F.col("event.n").alias("n")).alias("seq"), F.col("event.kind").alias("kind"), "message", "role", F.col("event.text").alias("text"))


def folded(events: DataFrame, rewinds: bool = True) -> DataFrame:
    """(conv_id, message, role, text): final messages. seq may be of any orderable type; rows without message are left out.

    A message without open, edit or regenerate has no version and is left out, as are deltas before its first version. The role
    is that of the first version. Of repeated events each counts. A log that is known to hold no rewinds needn't be read for them.
    """
    begins = F.col("kind").isin("open", "edit", "regenerate")
    place = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"))
    rows = events.where("message is not null and kind <> 'rewind'").groupBy("conv_id", "message")
    rows = rows.agg(F.collect_list(place).alias("all"), F.max(F.when(begins, place)).alias("newest"), F.min_by("role", F.when(begins, place)).alias("role")).where("newest is not null")
    newest = F.sort_array(F.filter("all", lambda e: e >= F.col("newest")))
    messages = rows.select("conv_id", "message", "role", F.array_join(F.transform(newest, lambda e: e["text"]), "").alias("text"))
    if not rewinds:
        return messages
    # Only numbers of the conversations that were rewound pass through a window; texts don't.
    marks = events.where("kind = 'rewind' and message is not null").groupBy("conv_id", "message").agg(F.max("seq").alias("rewound"))
    few = marks.select(F.col("conv_id").alias("c")).distinct()
    begun = events.where(begins & F.col("message").isNotNull()).select("conv_id", "message", "seq").join(few, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    begun = begun.groupBy("conv_id", "message").agg(F.max("seq").alias("begun"))
    both = begun.withColumn("rewound", F.lit(None).cast(marks.schema["rewound"].dataType)).unionByName(marks.withColumn("begun", F.lit(None).cast(marks.schema["rewound"].dataType)))
    before = F.max("rewound").over(Window.partitionBy("conv_id").orderBy("message").rangeBetween(Window.unboundedPreceding, -1))
    gone = both.withColumn("before", before).where("begun <= before").select(F.col("conv_id").alias("c"), F.col("message").alias("m"))
    return messages.join(gone, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("message") == F.col("m")), "left_anti")


def escaped(text: Column) -> Column:
    """A backslash more between < and |, so that no control string is left; unescaped() takes it out again."""
    return F.regexp_replace(text, "<(\\\\*)\\|", "<$1\\\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, "<(\\\\*)\\\\\\|", "<$1|")


def rendered(messages: DataFrame) -> DataFrame:
    """(conv_id, message, segment, loss_from, loss_to): formatted segments, and which characters of each are under the loss mask."""
    # A role stands on one line: \\s is a backslash in it and \\n a line end.
    role = escaped(F.replace(F.replace(F.col("role"), F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))
    text = escaped(F.col("text"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    rows = messages.select("conv_id", "message", F.concat(head, text, F.lit(f"{END}\n")).alias("segment"), F.length(head).alias("a"), F.length(text).alias("n"), "role")
    assistant = F.col("role") == "assistant"
    return rows.select("conv_id", "message", "segment", F.when(assistant, F.col("a")).otherwise(0).alias("loss_from"), F.when(assistant, F.col("a") + F.col("n")).otherwise(0).alias("loss_to"))


def read_back(segments: DataFrame) -> DataFrame:
    """(conv_id, message, role, text, loss, formatted_chars) of formatted segments: escapes undone, the mask cut out."""
    body = F.expr(f"substring(segment, {len(START) + 1}, length(segment) - {len(START) + len(END) + 1})")
    rows = segments.withColumn("body", body).withColumn("at", F.locate("\n", F.col("body")))
    role = F.replace(F.replace(unescaped(F.expr("substring(body, 1, at - 1)")), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))
    loss = F.when(F.col("loss_to") > F.col("loss_from"), unescaped(F.expr("substring(segment, loss_from + 1, loss_to - loss_from)"))).otherwise(F.lit(""))
    return rows.select("conv_id", "message", role.alias("role"), unescaped(F.expr("substring(body, at + 1)")).alias("text"), loss.alias("loss"), F.length("segment").cast("bigint").alias("formatted_chars"))


_SUMMARY = pa.schema([("conv", pa.string()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns in, one row for each conversation out; only running digests are held."""
    now, state = None, None

    def row() -> dict:
        key, n, turns, chars, loss, formatted = state
        return dict(zip(_SUMMARY.names, (key, n, turns.hexdigest(), chars, loss.hexdigest(), formatted), strict=True))

    for batch in batches:
        out = []
        for key, turn, loss, chars, size in zip(*[batch.column(c).to_pylist() for c in ("conv", "turn", "loss", "chars", "formatted_chars")], strict=True):
            if state is None or key != now:
                if state is not None:
                    out.append(row())
                now, state = key, [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[1] += 1
            state[2].update(turn)
            state[3] += chars
            state[4].update(loss)
            state[5] += size
        if out:
            yield pa.RecordBatch.from_pylist(out, _SUMMARY)
    if state is not None:
        yield pa.RecordBatch.from_pylist([row()], _SUMMARY)


def summary(segments: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, read back from its segments.

    A null conv_id is a conversation like others. An empty table has no conversation.
    """
    kind = segments.schema["conv_id"].dataType.simpleString()
    rows = read_back(segments).withColumn("conv", F.col("conv_id").cast("string")).repartition("conv").sortWithinPartitions("conv", "message")
    turn = F.concat("role", F.lit("\n"), "text", F.lit("\n")).cast("binary")
    rows = rows.select("conv", turn.alias("turn"), F.col("loss").cast("binary").alias("loss"), F.length("loss").alias("chars"), "formatted_chars")
    found = rows.mapInArrow(_digested, "conv string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    return found.select(F.col("conv").cast(kind).alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
