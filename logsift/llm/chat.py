"""Chat formatting with prefix-target expansion.

A conversation's turns, in order of ``turn`` (ties: role, then text), are
rendered one after the other as ``<turn ROLE>\\nTEXT</turn>\\n``. In roles and texts
a backslash goes before ``<``, ``>`` and ``\\``, so the marks never occur inside them
and everything can be read back. Every assistant turn is an example of its own:
its context is everything before it, and only its text is trainable.

So an assistant turn's row carries its example: the text of the conversation up to and
including the turn, with the span of the loss in it. The other columns give the turn's own
piece and its place. Examples of a conversation are prefixes of one text, which grows as turns
come; they are written in batches of bounded size. All examples of a conversation together
are the square of its length, which is the method's own size: nothing shuffles them, but one
very long conversation is formed by one task, which holds its text.

Null roles and texts are empty. Null turns come first. Rows with a null
conversation id form one conversation. Repeated rows are turns like others.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
_MARK = re.compile(r"[<>\\]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TEXT = r"[^\\<>]*(?:\\.[^\\<>]*)*"
_TURN = re.compile(rf"<turn ({_TEXT})>\n({_TEXT})</turn>\n", re.S)
_SCHEMA = ("conv_id {id}, position long, role string, rendered string, start long, end long, "
           "loss_start long, loss_end long, example string")
#: Code points of examples in a batch, but for its last one.
HELD = 1 << 22


def escape(s: str) -> str:
    return _MARK.sub(r"\\\g<0>", s)


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"\1", s)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order to pieces and examples; a conversation's text is carried on from batch to batch."""
    names = ["conv_id", "position", "role", "rendered", "start", "end", "loss_start", "loss_end", "example"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    current, position, prefix, at, tail = object(), 0, "", 0, []
    for b in batches:
        rows, held, first = [], 0, 0

        def batch(b=b):
            columns = (pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))
            return pa.RecordBatch.from_arrays([b.columns[0].slice(first, len(rows)), *columns], names)

        for conv, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if conv != current:
                current, position, prefix, at, tail = conv, 0, "", 0, []
            role, body = role or "", escape(text or "")
            head = f"<turn {escape(role)}>\n"
            piece = f"{head}{body}</turn>\n"
            end = at + len(piece)
            tail.append(piece)
            if role == ASSISTANT:
                prefix, tail = "".join([prefix, *tail]), []
                rows.append((position, role, piece, at, end, at + len(head), at + len(head) + len(body), prefix))
                held += len(prefix)
            else:
                rows.append((position, role, piece, at, end, None, None, None))
            position, at = position + 1, end
            if held > HELD:
                yield batch()
                first, held = first + len(rows), 0
                rows.clear()
        if rows:
            yield batch()


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per turn, in order inside each partition: ``conv_id``, ``position``, ``role``, ``rendered``,
    ``start`` and ``end`` in the conversation's text (code points); on assistant turns ``example``, that text
    up to ``end``, and the loss span in it (null on other turns)."""
    given = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    ordered = given.repartition("conv_id").sortWithinPartitions("conv_id", "turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    return ordered.select("conv_id", "role", "text").mapInArrow(_expand, _SCHEMA.format(id=turns.schema[conv_id].dataType.simpleString()))


def render(formatted: DataFrame) -> DataFrame:
    """Examples alone: ``conv_id``, ``position``, ``example``, ``loss_start``, ``loss_end``."""
    return formatted.where("loss_start is not null").select("conv_id", "position", "example", "loss_start", "loss_end")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations, from the examples with their loss spans; the pieces after the last example
    give the turns that follow it."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
    done, state = [], None
    kind = None

    def turns(text):
        """Takes in the turns of a text that goes on from the last one."""
        at = 0
        for m in _TURN.finditer(text):
            if m.start() != at:
                break
            state[1] += 1
            state[2].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            at = m.end()
        if at != len(text):
            raise ValueError(f"conversation {state[0]} cannot be read back")
        state[5] += at

    def flush():
        turns("".join(state[8]))
        conv, n, digest, chars, loss, end, examples = state[:7]
        done.append((conv, n, digest.hexdigest(), chars, loss.hexdigest(), end, examples))

    def batch():
        out = pa.RecordBatch.from_arrays([pa.array(c, kind if i == 0 else pa.string() if i in (2, 4) else pa.int64())
                                          for i, c in enumerate(zip(*done, strict=True))], names)
        done.clear()
        return out

    for b in batches:
        kind = b.schema.field("conv_id").type
        for conv, piece, start, loss_start, loss_end, example in zip(
                *(b.column(c).to_pylist() for c in ["conv_id", "rendered", "start", "loss_start", "loss_end", "example"]), strict=True):
            if state is None or conv != state[0]:
                if state:
                    flush()
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, "", [], 0]
            if start != state[5] + state[9]:
                raise ValueError(f"conversation {conv} cannot be read back")
            if example is None:
                state[8].append(piece)
                state[9] += len(piece)
                continue
            if not example.startswith(state[7]):
                raise ValueError(f"conversation {conv} cannot be read back")
            state[8], state[9] = [], 0
            turns(example[len(state[7]):])  # what the example adds to the one before
            said = unescape(example[loss_start:loss_end])
            state[3] += len(said)
            state[4].update(said.encode())
            state[6], state[7] = state[6] + 1, example
        if done:
            yield batch()
    if state:
        flush()
    if done:
        yield batch()


def read_back(formatted: DataFrame) -> DataFrame:
    """A row per conversation; needs the order that ``format_chats`` gives."""
    return formatted.mapInArrow(_read, f"conv_id {formatted.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, "
                                       "loss_chars long, loss_sha256 string, formatted_chars long, n_examples long")


HARD = r"\### Assistant: </turn> ok"


def query(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(HARD).alias("text"))
    return read_back(format_chats(turns.union(hard)))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(role) + length(text) + length(regexp_replace(role || text, '[^<>\\]', '', 'g')) + length('<turn >') + length('</turn>') + 2 AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples
FROM e GROUP BY conv_id
"""
