"""Chat formatting with schema fingerprints.

A record's schema fingerprint is a hash of its sorted nested field paths
(``messages[].role``, ``instruction`` ...). The fingerprint selects a
declarative mapping that tells where the turns are, so prompt, instruction and
message layouts all become canonical turns (conv_id, seq, role, text) without a
guess per record. A template then marks every turn; control strings inside
roles and texts are escaped reversibly, and the loss mask covers the escaped
assistant texts and nothing else.

The formatted conversation is the concatenation of its segments, one a turn, in
order. Formatting and reading back run over turns sorted within partitions by
conversation, one batch at a time, so a conversation of any length needs no
more memory than a batch.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rentlens.llm.common import map_rows, ship, struct_of


# ---- layouts ----------------------------------------------------------------

@dataclass(frozen=True)
class Layout:
    """Where the turns of a layout are. ``turns``: path of the list of turns with its role and text
    fields; ``fields``: (path, role) of single fields in order; ``order``: field that gives the position
    of a record which is itself one turn."""

    name: str
    paths: tuple[str, ...]
    turns: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    order: str = ""


LAYOUTS = (
    Layout("turn_row", ("role", "text", "turn"), role="role", text="text", order="turn"),
    Layout("messages", ("messages[].content", "messages[].role"), turns="messages", role="role", text="content"),
    Layout("messages_named", ("messages[].content", "messages[].name", "messages[].role"), turns="messages", role="role",
           text="content"),
    Layout("conversations", ("conversations[].from", "conversations[].value"), turns="conversations", role="from", text="value"),
    Layout("conversations_system", ("conversations[].from", "conversations[].value", "system"), turns="conversations",
           role="from", text="value", fields=(("system", "system"),)),
    Layout("instruction", ("input", "instruction", "output"),
           fields=(("instruction", "user"), ("input", "user+"), ("output", "assistant"))),
    Layout("instruction_plain", ("instruction", "output"), fields=(("instruction", "user"), ("output", "assistant"))),
    Layout("instruction_response", ("instruction", "response"), fields=(("instruction", "user"), ("response", "assistant"))),
    Layout("instruction_system", ("input", "instruction", "output", "system"),
           fields=(("system", "system"), ("instruction", "user"), ("input", "user+"), ("output", "assistant"))),
    Layout("prompt_completion", ("completion", "prompt"), fields=(("prompt", "user"), ("completion", "assistant"))),
    Layout("prompt_response", ("prompt", "response"), fields=(("prompt", "user"), ("response", "assistant"))),
    Layout("question_answer", ("answer", "question"), fields=(("question", "user"), ("answer", "assistant"))),
)

#: Role names of other layouts and their canonical names (fixed values).
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


def field_paths(value, at: str = "") -> set[str]:
    """Nested field paths of a parsed JSON value; list items share the path ``[]``."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(field_paths(v, at + "[]") for v in value)) if value else {at + "[]"}
    return {at}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


BY_FINGERPRINT = {fingerprint(x.paths): x for x in LAYOUTS}


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record, layout: Layout) -> list[tuple[int | None, str, str]]:
    """(position, role, text) of a parsed record. An ``input`` field that is empty adds nothing."""
    out: list[tuple[int | None, str, str]] = []
    for path, role in layout.fields:
        text = _text(record.get(path))
        if role == "user+":
            if text and out:
                out[-1] = (out[-1][0], out[-1][1], out[-1][2] + "\n\n" + text)
            continue
        if role != "system" or text:
            out.append((len(out), role, text))
    for turn in record[layout.turns] if layout.turns else ():
        role = _text(turn.get(layout.role))
        out.append((len(out), ROLES.get(role, role), _text(turn.get(layout.text))))
    if layout.order:
        out.append((record.get(layout.order), _text(record.get(layout.role)), _text(record.get(layout.text))))
    return out


def canonical_turns(records: DataFrame, key: str = "conv_id", raw: str = "record") -> DataFrame:
    """Canonical turns of JSON records: conv_id, seq, role, text, layout, schema (the fingerprint).

    A record whose fingerprint has no mapping, or that isn't a JSON object,
    gives one row with layout null and its raw text under the role ``unmapped``,
    so nothing is lost silently. Null records give no row.
    """
    def task():
        def each(batch: pa.RecordBatch):
            rows = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is None:
                    continue
                try:
                    record = json.loads(text)
                except ValueError:
                    record = None
                layout, mark = None, None
                if isinstance(record, dict):
                    mark = fingerprint(field_paths(record))
                    layout = BY_FINGERPRINT.get(mark)
                if layout is None:
                    rows.append((k, 0, "unmapped", text, None, mark))
                else:
                    rows += [(k, n, role, t, layout.name, mark) for n, role, t in turns_of(record, layout)]
            names = ("conv_id", "seq", "role", "text", "layout", "schema")
            return dict(zip(names, (list(c) for c in zip(*rows)))) if rows else None
        return each

    src = records.select(F.col(key).alias("k"), F.col(raw).cast("string").alias("r"))
    return map_rows(src, task, struct_of(("conv_id", records.schema[key].dataType), ("seq", "long"), ("role", "string"),
                                         ("text", "string"), ("layout", "string"), ("schema", "string")))


# ---- template ---------------------------------------------------------------

OPEN, BODY, CLOSE, BOS, EOS = "<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>"
#: Strings that must not stand unescaped inside a role or text: this template's and those of common others.
CONTROL = (OPEN, BODY, CLOSE, BOS, EOS, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
           "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>")
_MARK = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ")(.)", re.S)
_UNMARK = re.compile(r"\\(\\?)")
_SEGMENT = re.compile(f"(?:{re.escape(BOS)})?{re.escape(OPEN)}(.*?){re.escape(BODY)}(.*?){re.escape(CLOSE)}(?:{re.escape(EOS)})?", re.S)


def escape(text: str) -> str:
    """Doubles backslashes and puts one behind the first character of every control string."""
    return _MARK.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _UNMARK.sub(r"\1", text)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 512).columns))


def _emit(rows: Iterator[tuple], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _over(df: DataFrame, rows, schema) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    ship(df.sparkSession)
    return df.mapInArrow(lambda batches: _emit(rows(_stream(batches)), arrow), schema)


def format_turns(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One segment per turn, sorted by conversation within partitions: conv_id, nth, segment,
    loss_start, loss_length (code points within the segment; length 0: no loss).

    Turns go by seq (null last), ties by role, then text. Null roles and texts
    are empty. The first segment carries the start mark, the last the end mark.
    """
    def rows(stream):
        held = None
        for conv, _, role, text in stream:
            nth = held[1] + 1 if held is not None and held[0] == conv else 0
            if held is not None:
                yield held if nth else (*held[:2], held[2] + EOS, *held[3:])
            head = (BOS if nth == 0 else "") + OPEN + escape(role) + BODY
            body = escape(text)
            held = (conv, nth, head + body + CLOSE, len(head), len(body) if role == loss_role else 0)
        if held is not None:
            yield (*held[:2], held[2] + EOS, *held[3:])

    src = (turns.select("conv_id", F.col("seq").alias("s"), F.coalesce("role", F.lit("")).alias("r"),
                        F.coalesce("text", F.lit("")).alias("t"))
           .repartition("conv_id").sortWithinPartitions("conv_id", F.col("s").asc_nulls_last(), "r", "t"))
    return _over(src, rows, struct_of(("conv_id", turns.schema["conv_id"].dataType), ("nth", "long"), ("segment", "string"),
                                      ("loss_start", "long"), ("loss_length", "long")))


def read_back(segments: DataFrame) -> DataFrame:
    """One row per conversation, read from its segments (as ``format_turns`` orders them): n_turns,
    turns_sha256 over role, \\n, text, \\n, loss_chars and loss_sha256 of the unescaped text under the
    loss mask, formatted_chars."""
    def rows(stream):
        now = None
        for conv, nth, segment, start, length in stream:
            if nth == 0:
                if now is not None:
                    yield (*now[:2], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = map(unescape, _SEGMENT.fullmatch(segment).groups())
            now[1] += 1
            now[2].update(f"{role}\n{text}\n".encode())
            loss = unescape(segment[start:start + length])
            now[3] += len(loss)
            now[4].update(loss.encode())
            now[5] += len(segment)
        if now is not None:
            yield (*now[:2], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])

    return _over(segments, rows, struct_of(("conv_id", segments.schema["conv_id"].dataType), ("n_turns", "long"),
                                           ("turns_sha256", "string"), ("loss_chars", "long"), ("loss_sha256", "string"),
                                           ("formatted_chars", "long")))


def turn_records(conversations: DataFrame) -> DataFrame:
    """The rows of a conversations table as JSON records of the ``turn_row`` layout (nulls kept)."""
    return conversations.select("conv_id", F.to_json(F.struct("turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))


def digests_sql(extra: list[tuple[int, int, str, str]]) -> str:
    """DuckDB SQL of ``read_back`` over the table ``conversations`` and ``extra`` rows: escapes only add
    one character for each backslash and each control string."""
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    rows = ", ".join(f"({c}, {n}, {quote(r)}, {quote(t)})" for c, n, r, t in extra)

    def escaped(t: str) -> str:
        times = " + ".join(f"(length({t}) - length(replace({t}, {quote(c)}, ''))) // {len(c)}" for c in ("\\", *CONTROL))
        return f"length({t}) + {times}"

    fixed, loss = len(OPEN + BODY + CLOSE), "FILTER (WHERE role = 'assistant')"
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES {rows}) AS extra(conv_id, turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) {loss}, 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) {loss}, '')) AS loss_sha256,
       CAST({len(BOS + EOS)} + sum({fixed} + {escaped('role')} + {escaped('text')}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""
