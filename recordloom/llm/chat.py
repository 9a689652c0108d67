"""Chat formatting from event logs: final messages by folding deltas, edits and regenerations, then rendering."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import need


def log_of_turns(conversations: DataFrame) -> DataFrame:
    """The event log (``conv_id, seq, kind, msg, role, text``) of a table of turns (``conv_id, turn, role, text``).

    Each turn is a ``start`` event, a draft that doesn't last, and one ``delta`` for each line of its text. An assistant's
    draft is followed by a message that another role begins on it, and then regenerated, which drops that message; other
    drafts are edited into the first line. So what the turns say is left, through all kinds of events. ``msg`` is the
    turn as text. A null text is a turn whose draft is emptied and has no deltas.
    """
    need(conversations, "conv_id", "turn", "role", "text")

    def event(kind: str, text: Column, aside: bool = False) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"), F.lit(aside).alias("aside"))

    lines, draft = F.coalesce(F.split("text", "\n"), F.array(F.lit(""))), F.lit("...")
    begun = F.array(event("start", F.lit("")), event("delta", draft))
    regenerated = F.array(event("start", F.lit(""), True), event("delta", draft, True), event("regenerate", F.get(lines, F.lit(0))))
    edited = F.array(event("edit", F.get(lines, F.lit(0))))
    deltas = F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda line: event("delta", F.concat(F.lit("\n"), line)))
    events = F.posexplode(F.concat(begun, F.when(F.col("role") == "assistant", regenerated).otherwise(edited), deltas))
    turn = F.col("turn").cast("long")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), "role", events.alias("step", "event"))
    msg = F.when(F.col("event.aside"), F.concat(F.coalesce(F.col("turn").cast("string"), F.lit("")), F.lit("+"))).otherwise(F.col("turn").cast("string"))
    role = F.when(F.col("event.aside"), F.lit("user")).otherwise(F.col("role"))
    return rows.select("conv_id", F.struct("turn", "step").alias("seq"), F.col("event.kind").alias("kind"), msg.alias("msg"), role.alias("role"), F.col("event.text").alias("text"))


class Fold:
    """The messages of one conversation, as its events come in.

    ``start`` opens message ``msg`` at the end (again: as ``regenerate``). ``delta`` adds text, ``edit`` replaces it.
    ``regenerate`` empties the message and drops all after it. ``delete`` drops the message. Other kinds, and events for
    messages that aren't there, change nothing.
    """

    def __init__(self) -> None:
        self.messages: dict[object, list] = {}

    def add(self, kind: str | None, msg: object, role: str | None, text: str | None) -> None:
        there = self.messages.get(msg)
        if kind == "start" and there is None:
            self.messages[msg] = [role, [text or ""]]
        elif there is None:
            return
        elif kind in ("regenerate", "start"):
            names = list(self.messages)
            for later in names[names.index(msg) + 1 :]:
                del self.messages[later]
            there[1] = [text or ""]
        elif kind == "delta":
            there[1].append(text or "")
        elif kind == "edit":
            there[1] = [text or ""]
        elif kind == "delete":
            del self.messages[msg]

    def render(self) -> tuple[int, str]:
        """The number of messages and the whole conversation."""
        parts = [f"<|{role or 'unknown'}|>\n{''.join(text)}\n<|end|>\n" for role, text in self.messages.values()]
        return len(parts), "".join(parts)


def render_log(log: DataFrame) -> DataFrame:
    """``conv_id``, ``n_messages`` and ``rendered`` for each conversation of an event log.

    The log is partitioned by conversation, sorted by ``seq`` and folded by :class:`Fold`. One task folds a conversation in
    its order, event by event, and holds its final messages only; as ``rendered`` is one value,
    they have 2 GB at most. Events of one ``seq`` (ties) are taken in the order of their other columns, so repeated rows
    count each. Events without ``conv_id`` are dropped; a null ``seq`` comes first; a null ``msg`` is a message like others;
    a null role is ``unknown``; null and empty texts add nothing; very long texts are kept whole. A conversation of which
    no message is left has 0 messages. An empty log gives no rows. Other columns don't matter, whatever their names.
    """
    need(log, "conv_id", "seq", "kind", "msg", "role", "text")
    log = log.where("conv_id IS NOT NULL").select("conv_id", "seq", "kind", "msg", "role", "text")
    ordered = log.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "kind", "msg", "role", "text").drop("seq")

    id_type = log.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, fold, started = None, Fold(), False
        for batch in batches:
            done: list[tuple] = []
            for conv, *event in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if not started or conv != current:
                    if started:
                        done.append((current, *fold.render()))
                    current, fold, started = conv, Fold(), True
                fold.add(*event)
            yield table(done)
        if started:
            yield table([(current, *fold.render())])

    def table(done: list[tuple]) -> pa.RecordBatch:
        conv, n, text = zip(*done, strict=True) if done else ((),) * 3
        return pa.RecordBatch.from_arrays([pa.array(conv, to_arrow_type(id_type)), pa.array(n, pa.int64()), pa.array(text, pa.string())], names=["conv_id", "n_messages", "rendered"])

    return ordered.mapInArrow(run, f"conv_id {id_type.simpleString()}, n_messages long, rendered string")


#: DuckDB SQL for the rendered table of turns.
SQL = """
SELECT conv_id, count(*) AS n_messages,
  string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY turn) AS rendered
FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
"""
