"""Chat formatting by grammar round trip.

Each turn is rendered between the control strings of its role; the rendered text is parsed again by a
deterministic parser, the recovered turns are compared with the source, and the texts that do not come
back are escaped, until what comes back is identical.

Grammar of a conversation (texts are bare or escaped):

    conversation = "<s>" turn*
    turn  = "[INST] " text " [/INST]"                     user
          | "<<SYS>>\\n" text "\\n<</SYS>>"                system
          | text "</s>"                                    assistant
          | "[ROLE " name "] " text " [/ROLE]"             any other role

A backslash takes the special meaning from the character after it. Bare text that holds no backslash and
no string which its turn would mistake for structure needs no escape and gets none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import renamed
from .tokens import released

BOS = "<s>"
#: Opening and closing control strings by role.
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>>\n", "\n<</SYS>>"), "assistant": ("", "</s>")}
ROLE_CLOSE = " [/ROLE]"
_ROLE_OPEN = re.compile(r"\[ROLE ((?:[^\\\]]|\\.)*)\] ", re.S)
_CONTROL = re.compile(r"\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[ROLE |\[/ROLE\]")
_STOP = {close: re.compile(r"\\.|(" + re.escape(close) + ")", re.S) for close in [ROLE_CLOSE, *(c for _, c in MARKS.values())]}


def escaped(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def marks(role: str) -> tuple[str, str]:
    return MARKS.get(role) or ("[ROLE " + re.sub(r"[\\\]]", r"\\\g<0>", role) + "] ", ROLE_CLOSE)


def parse(rendered: str, start: int = 0) -> list[tuple[str, str]] | None:
    """(role, text) of each turn, unescaped; None where the text is no sentence of the grammar."""
    turns, at = [], start
    while at < len(rendered):
        if rendered.startswith("[INST] ", at):
            role, (opened, close) = "user", MARKS["user"]
        elif rendered.startswith("<<SYS>>\n", at):
            role, (opened, close) = "system", MARKS["system"]
        elif m := _ROLE_OPEN.match(rendered, at):
            role, opened, close = unescaped(m[1]), m[0], ROLE_CLOSE
        else:
            role, (opened, close) = "assistant", MARKS["assistant"]
        body = at + len(opened)
        stop = next((m for m in _STOP[close].finditer(rendered, body) if m[1]), None)
        if stop is None:
            return None
        turns.append((role, unescaped(rendered[body : stop.start()])))
        at = stop.end()
    return turns


@dataclass
class Rendered:
    text: str
    spans: list[tuple[int, int]]  # of assistant texts, in code points of ``text``
    n_escaped: int


def render(turns: list[tuple[str, str]], first: bool = True) -> Rendered:
    """Turns as text that parses back to them."""
    bodies, plain = [t for _, t in turns], [True] * len(turns)

    def written() -> Rendered:
        out, spans, at = [BOS] if first else [], [], len(BOS) if first else 0
        for (role, _), body in zip(turns, bodies, strict=True):
            opened, close = marks(role)
            out += (opened, body, close)
            if role == "assistant":
                spans.append((at + len(opened), at + len(opened) + len(body)))
            at += len(opened) + len(body) + len(close)
        return Rendered("".join(out), spans, plain.count(False))

    start = len(BOS) if first else 0
    while parse((found := written()).text, start) != turns:
        # The turns that do not come back even when alone; if each does alone, all that are still bare.
        bad = [i for i, (role, text) in enumerate(turns) if plain[i] and parse(marks(role)[0] + text + marks(role)[1]) != [(role, text)]] or [i for i, p in enumerate(plain) if p]
        if not bad:
            raise ValueError("escaped turns do not parse back")
        for i in bad:
            bodies[i], plain[i] = escaped(turns[i][1]), False
    return found


PART_SCHEMA = "conv_id long, part int, text string, n_turns int, n_escaped int, loss_spans array<struct<start:int,end:int>>"


def _parts(part_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, part, turns, size = None, False, 0, [], 0
        out: list[dict] = []

        def close():
            nonlocal turns, size, part
            if turns:
                r = render(turns, first=part == 0)
                out.append({"conv_id": now, "part": part, "text": r.text, "n_turns": len(turns), "n_escaped": r.n_escaped, "loss_spans": [{"start": a, "end": b} for a, b in r.spans]})
                turns, size, part = [], 0, part + 1

        schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("text", pa.string()), ("n_turns", pa.int32()), ("n_escaped", pa.int32()), ("loss_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if not begun or conv != now:
                    close()
                    now, begun, part = conv, True, 0
                if size + len(text) > part_chars:
                    close()
                turns.append((role, text))
                size += len(text)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_chars: int = 1_000_000) -> DataFrame:
    """Rendered conversations: conv_id, part, text, n_turns, n_escaped, loss_spans.

    A conversation is one row, or, beyond ``part_chars`` code points of text, several rows (parts) that
    follow one another, each a whole number of turns: a task never holds more than a part. Rows of one
    conversation go by turn, then role, then text (repeated rows are repeated turns); a null turn comes
    first. Null text and null role are empty; a null conv_id is a conversation of its own. An empty table
    gives no rows. Other columns are ignored.
    """
    rows = renamed(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    rows = rows.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(released(_parts(part_chars)), PART_SCHEMA)


DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state, out = None, None, []
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def close():
        if state:
            n, turns, chars, loss, size = state
            out.append({"conv_id": now, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": size})

    for batch in batches:
        for conv, part, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "text", "loss_spans")), strict=True):
            if part == 0:
                close()
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in parse(text, len(BOS) if part == 0 else 0):
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
            for span in spans:
                said = unescaped(text[span["start"] : span["end"]])
                state[2] += len(said)
                state[3].update(said.encode())
            state[4] += len(text)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out.clear()
    close()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the rendered text says when it is parsed, and of what its loss mask covers."""
    return formatted.select("conv_id", "part", "text", "loss_spans").repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(released(_digests), DIGEST_SCHEMA)


PROBE = "</s>[INST] ok [/INST]"


def op1_chat_formatting(spark, sf_dir):
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(rows.unionByName(probe)))


OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (
  SELECT *, CASE role WHEN 'user' THEN '[INST] ' WHEN 'system' THEN '<<SYS>>' || chr(10) WHEN 'assistant' THEN '' ELSE '[ROLE ' || regexp_replace(role, '([\\\]])', '\\\1', 'g') || '] ' END AS opened,
         CASE role WHEN 'user' THEN ' [/INST]' WHEN 'system' THEN chr(10) || '<</SYS>>' WHEN 'assistant' THEN '</s>' ELSE ' [/ROLE]' END AS closed
  FROM c),
e AS (
  SELECT *, CASE WHEN contains(text, '\') OR contains(text, closed)
                   OR (role = 'assistant' AND (starts_with(text, '[INST] ') OR starts_with(text, '<<SYS>>' || chr(10)) OR regexp_matches(text, '^\[ROLE [^\]]*\] ')))
                 THEN regexp_replace(text, '(\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[ROLE |\[/ROLE\])', '\\\1', 'g') ELSE text END AS body
  FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(length(opened) + length(body) + length(closed)))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
