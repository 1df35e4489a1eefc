r"""Chat formatting in budgeted windows (operator 2).

Prefix sums of the turns' tokens choose turn-aligned spans: a window starts with
the system turn (if the conversation opens with one) and up to ``history`` of the
turns before the span, as far as they fit ``history_tokens``, then takes new turns
while the prefix sums stay within ``budget``; at least one new turn, whole, however
long.  Repeated turns carry no loss; the texts of new assistant turns do.

A turn is written ``<|turn|>role<|text|>text<|end|>``.  Inside roles and texts a
backslash is doubled and one is put after the first character of each control
string, so none is left and ``unescape`` restores the input exactly.

Prefix sums are a window function; the windows are cut in one pass over the rows
of a partition in (conversation, turn) order, holding one window and the history,
so a conversation of any length needs the memory of one window.  Its turns are
read in order by one task: the running digest that the query asks for of each
conversation can't be split.

Defined results: a null text or role is empty; rows are ordered by turn (null
last), role, text, and repeated rows are turns of their own; rows with a null
conversation id form one conversation; an empty table gives no windows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlab.llm.registry import query, read

BUDGET, HISTORY, HISTORY_TOKENS = 1024, 4, 256
TURN_TOKENS = 4  # the marks of a turn
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# control strings of this and other common templates
_control = re.compile(r"([<\[])(?=\|(?:turn|text|end|system|user|assistant|im_start|im_end)\|>|/?s>|/?INST\]|/?SYS>)")
_turn = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)

WINDOWS = ("conv_id bigint, window bigint, formatted string, loss array<struct<start:bigint,end:bigint>>, "
           "turns array<bigint>, n_repeated bigint, tokens bigint")
_WINDOWS = pa.schema([
    ("conv_id", pa.int64()), ("window", pa.int64()), ("formatted", pa.string()),
    ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("turns", pa.list_(pa.int64())), ("n_repeated", pa.int64()), ("tokens", pa.int64())])


def escape(text: str) -> str:
    return _control.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted window, unescaped."""
    return [(unescape(r), unescape(t)) for r, t in _turn.findall(formatted)]


def cut_windows(turns: Iterator[tuple], budget: int, history: int, history_tokens: int) -> Iterator[dict]:
    """Windows of rows ``(conv_id, role, text, reach)``; ``reach`` is the running token sum with this turn."""
    conv, place, before = object(), 0, 0
    system, past, new = None, [], []  # turns as (place, role, text, tokens)

    def window() -> dict:
        repeated = ([system] if system and system[0] != new[0][0] else []) + carried
        parts, loss, at = [], [], 0
        for k, (_, role, text, _) in enumerate(repeated + new):
            head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
            if k >= len(repeated) and role == "assistant":
                loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
            parts += [head, body, END]
            at += len(head) + len(body) + len(END)
        return {"conv_id": conv, "window": number, "formatted": "".join(parts), "loss": loss,
                "turns": [t[0] for t in repeated + new], "n_repeated": len(repeated),
                "tokens": sum(t[3] for t in repeated + new)}

    carried, number, start, load = [], 0, 0, 0
    for conv_id, role, text, reach in turns:
        if conv_id != conv:
            if new:
                yield window()
            conv, place, before, system, past, new, carried, number, start, load = conv_id, 0, 0, None, [], [], [], 0, 0, 0
        turn = (place, role, text, reach - before)
        if place == 0 and role == "system":
            system = turn
        if new and load + reach - start > budget:  # prefix sums: the span would pass the budget
            yield window()
            past = [t for t in (past + new)[-history:] if not system or t[0] != 0] if history else []
            carried, room = [], history_tokens
            for t in reversed(past):
                if t[3] > room:
                    break
                room -= t[3]
                carried.insert(0, t)
            load = sum(t[3] for t in carried) + (system[3] if system else 0)
            number, new, start = number + 1, [], before
        new.append(turn)
        place, before = place + 1, reach
    if new:
        yield window()


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY,
                   history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """``(conv_id, turn, role, text)`` -> windows, those of a conversation side by side and in order."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    tokens = F.size(F.regexp_extract_all("text", F.lit(TOKEN), 0)) + TURN_TOKENS
    order = [F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]
    by = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("tokens", tokens).withColumn("reach", F.sum("tokens").over(by))
    summed = summed.sortWithinPartitions("conv_id", *order).select("conv_id", "role", "text", "reach")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        yield from _batches(cut_windows(turns, budget, history, history_tokens), _WINDOWS)
    return summed.mapInArrow(run, WINDOWS)


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


READ_BACK = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint"
_READ_BACK = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])


def digest_windows(windows: Iterator[dict]) -> Iterator[dict]:
    """What the formatted windows of each conversation hold, parsed back from them."""
    row = None
    for w in windows:
        if row is None or row["conv_id"] != w["conv_id"]:
            if row:
                yield row | {"turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()}
            row = dict(conv_id=w["conv_id"], n_turns=0, loss_chars=0, formatted_chars=0, n_windows=0)
            turns, loss = hashlib.sha256(), hashlib.sha256()
        for role, text in turns_of(w["formatted"])[w["n_repeated"]:]:
            turns.update(f"{role}\n{text}\n".encode())
            row["n_turns"] += 1
        for span in w["loss"]:
            text = unescape(w["formatted"][span["start"]:span["end"]])
            loss.update(text.encode())
            row["loss_chars"] += len(text)
        row["formatted_chars"] += len(w["formatted"])
        row["n_windows"] += 1
    if row:
        yield row | {"turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()}


def read_back(windows: DataFrame, ordered: bool = False) -> DataFrame:
    """One row of counts and digests a conversation; ``ordered`` if the rows come straight from ``format_windows``."""
    if not ordered:
        windows = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for k in range(0, b.num_rows, 256) for row in b.slice(k, 256).to_pylist())
        yield from _batches(digest_windows(rows), _READ_BACK)
    return windows.select("conv_id", "formatted", "loss", "n_repeated").mapInArrow(run, READ_BACK) if ordered else \
        windows.mapInArrow(run, READ_BACK)


# fixed values: the conversation that holds control strings of a template
EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@query("op2_chat_windows")
def op2_chat_windows(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.union(spark.createDataFrame(EXTRA, "conv_id bigint, turn bigint, role string, text string"))
    return read_back(format_windows(rows), ordered=True)
