"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, with control strings before the role, between role and text
and after the text. It is encoded once, with offsets; the tokens of each trained turn are found
by binary search of the turn's span among the sorted token spans.

Control strings begin with ``<|``. Inside roles and texts every ``<``, any number of
backslashes, ``|`` gets one more backslash, so that ``<|`` never occurs there; reading takes
that backslash away again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from surveyloom.llm.common import object_strings, shuffle_partitions, worker_store

TURN, SAID, END = "<|turn|>", "<|said|>", "<|done|>"
LEARNED = ("assistant",)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def render(turns: Iterable[tuple[str, str]], learned: tuple[str, ...] = LEARNED) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the texts to learn, in code points."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{SAID}", escape(text)
        if role in learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns = []
    for block in formatted.split(TURN)[1:]:
        role, _, text = block.removesuffix(END).partition(SAID)
        turns.append((unescape(role), unescape(text)))
    return turns


def align(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which tokens belong to the spans, and the characters of each span that its tokens cover."""
    mask = np.zeros(len(offsets), bool)
    covered = []
    starts, ends = (offsets[:, 0], offsets[:, 1]) if len(offsets) else (np.empty(0, int),) * 2
    for start, end in spans:
        if start == end:
            continue
        first, last = np.searchsorted(ends, start, "right"), np.searchsorted(starts, end, "left")
        if first < last:
            mask[first:last] = True
            # a token across the edge of a turn counts, but only its characters inside
            covered.append((max(start, int(starts[first])), min(end, int(ends[last - 1]))))
    return mask, covered


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    store = worker_store("chat")
    if ("chat", path) not in store:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        store["chat", path] = tokenizer
    return store["chat", path]


FORMATTED = (
    "n_turns long, formatted string, token_ids array<int>, loss_mask array<boolean>, "
    "loss_spans array<struct<start:long,end:long>>"
)


def format_chats(conversations: DataFrame, path: str, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """One row per ``conv_id``: the formatted text, its token ids and the loss mask over them.

    ``loss_spans`` are the characters under the mask, one span per trained text that isn't
    empty. Rows of a conversation go by turn (null first), equal turns by role and text; each
    row is a turn, repeated ones too. Null roles and texts count as empty, a null ``conv_id`` is
    a conversation, other columns are left out, and an empty table gives no rows.

    Rows are dealt by conversation and sorted on disk where needed; a task holds the one
    conversation that it renders.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select(
        F.col("conv_id"),
        F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("conv_id").cast("string"), F.lit("\x00")).alias("__conv"),
    )
    dealt = rows.repartition(shuffle_partitions(conversations.sparkSession), "__conv")
    ordered = dealt.sortWithinPartitions("__conv", "turn", "role", "text")

    def formatted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tokenizer = _tokenizer(path)
        names = ["conv_id", "n_turns", "formatted", "token_ids", "loss_mask", "loss_spans"]
        types = [None, pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_()),
                 pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]

        def row(conv_id, turns):
            text, spans = render(turns, learned)
            tokens = tokenizer.encode(text, add_special_tokens=False)
            mask, covered = align(np.array(tokens.offsets, np.int64).reshape(-1, 2), spans)
            return conv_id, len(turns), text, tokens.ids, mask.tolist(), [{"start": a, "end": b} for a, b in covered]

        def table(rows, id_type):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, t or id_type) for c, t in zip(cols, types)], names=names)

        held, conv_id, turns, out, size, id_type = None, None, [], [], 0, None
        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("__conv", "conv_id", "role", "text"))
            for conv, value, role, text in zip(*columns):
                if conv != held and turns:
                    out.append(row(conv_id, turns))
                    size += len(out[-1][2])
                    turns = []
                    if size > 1 << 22:
                        yield table(out, id_type)
                        out, size = [], 0
                held, conv_id = conv, value
                turns.append((role, text))
        if turns:
            out.append(row(conv_id, turns))
        if out:
            yield table(out, id_type)

    return ordered.mapInArrow(formatted, f"conv_id {kind}, {FORMATTED}")


def read_back(formatted: str | Column, loss_spans: str | Column) -> Column:
    """Digests of what a formatted conversation says, read from the formatted text alone."""

    @F.pandas_udf("turns_sha256 string, loss_chars long, loss_sha256 string")
    def digests(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, own in zip(texts, spans):
            turns = "".join(f"{role}\n{said}\n" for role, said in parse(text))
            # each span by itself, as an escape never reaches over the end of a text
            loss = "".join(unescape(text[s["start"] : s["end"]]) for s in own)
            out.append((hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
        return object_strings(pd.DataFrame(out, columns=["turns_sha256", "loss_chars", "loss_sha256"]))

    return digests(formatted, loss_spans)
