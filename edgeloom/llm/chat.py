"""Chat formatting: conversations rebuilt from their event logs, then rendered with a reversible template."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeloom.cluster import ship

#: Kinds of events. message: a whole message. start: opens a message that deltas extend. delta: appends text. edit:
#: replaces the message's text. regenerate: discards the message's text so far. delete: removes the message.
KINDS = ("message", "start", "delta", "edit", "regenerate", "delete")
OPEN, CLOSE = "### ", "</turn>\n"


def escape(text: Column) -> Column:
    """text without "###" and "</turn>": backslashes are doubled, a third # in a row and the slash of "</turn>" get
    one. unescape drops the first of each pair again."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    text = F.regexp_replace(text, "(?<=##)#", r"\\#")
    return F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>"))


def escape_role(role: Column) -> Column:
    """As escape, for a turn's head, which ends at the first colon; line feeds are kept apart from a turn's end."""
    return F.replace(escape(role), F.lit(":"), F.lit("\\:"))


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    parts = text.split("\\\\")  # pairs first: what else has a backslash is an escape
    return "\\".join(p.replace("\\", "") for p in parts)


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): final messages from events (conv_id, message_id, seq, kind, role, text); see
    KINDS. turn counts a conversation's messages from 0 in the order of their first events; ties on seq go by
    message_id, then kind, role, text.

    Events are partitioned by conversation and sorted by sequence, once for all the windows. A message's text is what
    came since its last event that set or discarded it, so deltas are folded by order and never one by one. Null texts
    count as empty; the last role that isn't null holds; messages that end with delete, and events of unknown kinds or
    without kind, are left out. A message id without start is opened by its first event. Other columns are ignored; an
    empty log gives no rows.
    """
    e = events.where(F.col("kind").isin(*KINDS)).select("conv_id", "message_id", "seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    order = "order by seq, message_id, kind, role, text"
    e = e.selectExpr("*", f"row_number() over (partition by conv_id {order}) as at")
    e = e.selectExpr("*", "max(if(kind <> 'delta', at, null)) over (partition by conv_id, message_id) as reset", "min(at) over (partition by conv_id, message_id) as first")
    live = e.where("reset is null or at >= reset or role is not null")
    m = live.groupBy("conv_id", "message_id", "first").agg(
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("at"))).alias("role"),
        F.max(F.when(F.col("at") == F.col("reset"), F.col("kind"))).alias("last"),
        F.array_sort(F.collect_list(F.when(F.col("reset").isNull() | (F.col("at") >= F.col("reset")), F.struct("at", "kind", "text")))).alias("parts"),
    )
    m = m.where("last is null or last <> 'delete'")
    text = F.array_join(F.transform("parts", lambda x: F.when(x["kind"] == "regenerate", "").otherwise(x["text"])), "")
    return m.select("conv_id", (F.row_number().over(_by_first()) - 1).cast("long").alias("turn"), "role", text.alias("text"))


def _by_first():
    from pyspark.sql import Window

    return Window.partitionBy("conv_id").orderBy("first")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss array<struct<start, length>>): one text for each conversation of turns
    (conv_id, turn, role, text), with the stretches, in code points from 0, that the loss is taken on: the escaped
    texts of assistant turns, without their marks.

    A turn is "### role: text</turn>" and a line feed; see escape. Where a turn stands comes from a running sum beside
    the sort, so that a conversation costs as much as it is long. Null texts and roles count as empty; ties on turn go
    by role, then text; repeated rows are turns of their own. A conversation is one text, and so one row, however long.
    """
    t = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("raw")).selectExpr("*", "row_number() over (partition by conv_id order by turn, role, raw) as at")
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(": "))
    t = t.select("conv_id", "at", "role", head.alias("head"), escape(F.col("raw")).alias("body"))
    t = t.select("conv_id", "at", "role", "head", "body", F.concat("head", "body", F.lit(CLOSE)).alias("line"))
    t = t.selectExpr("*", "sum(length(line)) over (partition by conv_id order by at rows unbounded preceding) - length(line) + length(head) as start")
    span = F.when(F.col("role") == "assistant", F.struct("start", F.length("body").cast("long").alias("length")))
    c = t.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines"), F.array_sort(F.collect_list(span)).alias("loss"))
    return c.select("conv_id", "n_turns", F.array_join(F.col("lines.line"), "").alias("formatted"), "loss")


@dataclass
class Parsed:
    turns: list[tuple[str, str]]
    loss: str


def parse(formatted: str, loss: list[dict]) -> Parsed:
    """The turns (role, text) and the text under the loss mask, unescaped, read back from what render gives."""
    turns = []
    for line in formatted.split(CLOSE)[:-1]:
        at = len(OPEN)
        while True:  # the first colon that no escape stands for
            at = line.index(":", at)
            before = line[:at]
            if (len(before) - len(before.rstrip("\\"))) % 2 == 0:
                break
            at += 1
        turns.append((unescape(line[len(OPEN) : at]), unescape(line[at + 2 :])))
    return Parsed(turns, "".join(unescape(formatted[x["start"] : x["start"] + x["length"]]) for x in loss))


def digests(chats: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from render's output."""
    import hashlib

    ship(chats.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k in range(b.num_rows):
                text = b.column(1)[k].as_py()
                p = parse(text, b.column(2)[k].as_py())
                sha = hashlib.sha256()
                for role, said in p.turns:
                    sha.update(f"{role}\n{said}\n".encode())
                rows.append((len(p.turns), sha.hexdigest(), len(p.loss), hashlib.sha256(p.loss.encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    rows = chats.select("conv_id", "formatted", "loss")
    return rows.mapInArrow(run, T.StructType([rows.schema["conv_id"], *T.StructType.fromDDL("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").fields]))
