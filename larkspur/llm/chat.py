r"""Chat formatting with a grammar round trip.

Template, one frame per turn: `<s>[INST] role` newline `text [/INST]</s>`. A frame is parsed back by a
deterministic parser; where the recovered turn differs from the source, conflicting content (control
strings, backslashes, line ends in a role) is escaped with a backslash, and the frame is parsed again.
Frames are prefix-free, so the parse of a conversation is the concatenation of the parses of its frames.

Turns are rendered and checked in parallel before the one shuffle. What needs a conversation's order
(offsets, digests) then runs over sorted rows as a stream that holds one Arrow batch, so a conversation
of any length needs bounded memory; its digest is sequential by definition.

Edge cases: null text or role counts as empty; a very long turn is one frame, held whole by one task; turns are ordered by turn (null first), ties by role and
text; rows with a null conv_id form one conversation; repeated rows are repeated turns; an empty table
gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]"]
TOKEN = re.compile(r"\\(?s:.)|" + "|".join(map(re.escape, CONTROLS)))
ESCAPED = re.compile(r"\\(.)", re.S)
CONFLICT = re.compile(r"(\\|" + "|".join(map(re.escape, CONTROLS)) + ")")
BODY = re.compile(r"((?:\\.|[^\\\n])*)\n(.*)", re.S)
TURN = ["<s>", "[INST]", "[/INST]", "</s>"]
MASKED_ROLE = "assistant"


def unescape(s: str) -> str:
    return ESCAPED.sub(r"\1", s)


def parse(rendered: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start and end of the text as it stands in the output) for each turn; None if ill-formed."""
    marks = [m for m in TOKEN.finditer(rendered) if m[0][0] != "\\"]
    if len(marks) % 4 or [m[0] for m in marks] != TURN * (len(marks) // 4):
        return None
    turns, at = [], 0
    for i in range(0, len(marks), 4):
        a, b, c, d = marks[i : i + 4]
        body = BODY.fullmatch(rendered, b.end(), c.start())
        if a.start() != at or b.start() != a.end() or d.start() != c.end() or not body or body[1][:1] != " " or body[2][-1:] != " ":
            return None
        turns.append((unescape(body[1][1:]), unescape(body[2][:-1]), body.start(2), body.end(2) - 1))
        at = d.end()
    return turns if at == len(rendered) else None


def plain(role: str, text: str) -> str:
    return f"<s>[INST] {role}\n{text} [/INST]</s>"


def render(role: str, text: str) -> str:
    """The turn's frame, escaped if its plain form does not parse back to the same turn."""
    frame = plain(role, text)
    back = parse(frame)
    if back is not None and [x[:2] for x in back] == [(role, text)]:
        return frame
    role_out = CONFLICT.sub(r"\\\1", role).replace("\n", "\\\n")
    frame = f"<s>[INST] {role_out}\n" + CONFLICT.sub(r"\\\1", text) + " [/INST]</s>"
    back = parse(frame)
    if back is None or [x[:2] for x in back] != [(role, text)]:
        raise ValueError(f"no reversible form of a turn of {len(text)} characters")
    return frame


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns with their frames; null stands for the plain form, which role and text give."""
    for b in batches:
        pairs = list(zip(b.column("role").to_pylist(), b.column("text").to_pylist()))
        frames = [None if (frame := render(r, t)) == plain(r, t) else frame for r, t in pairs]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(frames, pa.string())], [*b.schema.names, "frame"])


def format_chat(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, frame: rows in conversation order within each partition; joined frames are the output.

    Escaping would change the order of ties, so they are sorted by role and text.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"))
    framed = turns.mapInArrow(_frames, "conv_id long, turn long, role string, text string, frame string")
    ordered = framed.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "turn", F.coalesce("frame", F.concat(F.lit("<s>[INST] "), "role", F.lit("\n"), "text", F.lit(" [/INST]</s>"))).alias("frame"))


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = object()
    conv, state = none, None
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    done: list[tuple] = []

    def end():
        if conv is not none:
            done.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    def batch():
        rows = list(zip(*done)) or [()] * 6
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], names)

    for b in batches:
        for c, frame in zip(b.column("conv_id").to_pylist(), b.column("frame").to_pylist()):
            if conv is none or c != conv:
                end()
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text, start, stop in parse(frame):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if role == MASKED_ROLE:
                    masked = unescape(frame[start:stop])
                    state[2] += len(masked)
                    state[3].update(masked.encode("utf-8", "surrogatepass"))
            state[4] += len(frame)
        yield batch()
    end()
    yield batch()


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted conversations and digest the recovered turns and the text under the loss mask."""
    return formatted.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op3_chat_format(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    clash = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", clash), (-1, 1, "assistant", clash)], "conv_id long, turn long, role string, text string")
    return read_back(format_chat(table.unionByName(extra)))


#: The same rows by ordered aggregates. A frame is escaped where a control string, a backslash or a line end in its role asks for it.
ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, n, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r)),
f AS (SELECT *, len(regexp_extract_all(role || text, '\\|<s>|</s>|\[INST\]|\[/INST\]')) + length(role) - length(replace(role, chr(10), '')) AS marks FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<s>[INST] ') + length(role) + 1 + length(text) + length(' [/INST]</s>') + marks) AS BIGINT) AS formatted_chars FROM f GROUP BY 1"""
