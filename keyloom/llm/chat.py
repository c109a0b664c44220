"""Chat formatting on token level.

A turn is mark, role, mark, text, mark. Roles and texts are encoded each for itself, and the marks are reserved ids spliced between
them, so no text can yield a mark. Printed, the marks are control strings; where content holds such a string, or the
escape sign, it is escaped and can be told from a mark and restored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, running_sum, store
from .ordering import TOKENIZER, encoding, token_ids

#: Printed marks before the role, before the text and after the text. Their ids follow the vocabulary and its end-of-document id.
MARKS = ("### ", ": ", "</turn>\n")
CONTROL = re.compile(r"\\|###|</turn>")
ESCAPED = re.compile(r"\\(\\|###|</turn>)")


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1], text)


def assemble(segments: list[list[int]], marks: list[int], learned: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of a turn. The mask is the running sum of +1 where learned text starts and -1 where it ends."""
    role, text = segments
    ids = np.concatenate([[marks[0]], role, [marks[1]], text, [marks[2]]]).astype(np.int32)
    steps = np.zeros(len(ids) + 1, dtype=np.int8)
    start = len(role) + 2
    if learned and len(text):
        steps[start] += 1
        steps[start + len(text)] -= 1
    return ids, np.cumsum(steps[:-1]).astype(np.int8)


def format_turns(turns: DataFrame, learn: tuple[str, ...] = ("assistant",), tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per turn: conv_id, turn, first_token (tokens of the conversation before it), ids, mask.

    ``mask`` is 1 on the tokens of the text if the role is in ``learn``. Turns follow each other by ``turn`` (null first; ties by the md5 of role, newline and text).
    Null roles and texts are empty; a null conv_id is a conversation too. Rows that repeat are turns of their own. Turns are
    encoded one by one and positions are running sums over ranges, so a conversation of any length is spread over tasks. An
    empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer)
        marks = [enc.n_vocab + 1 + i for i in range(len(MARKS))]
        for batch in in_slices(batches):
            ids, masks = [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                parts = [token_ids(enc, escape(role or "")), token_ids(enc, escape(text or ""))]
                own, mask = assemble(parts, marks, role in learn)
                ids.append(own), masks.append(mask.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.binary()),
                 pa.array([len(i) for i in ids], pa.int64()), batch.column(4)], ["conv_id", "turn", "ids", "mask", "__len", "__tie"])
    plain = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text",
                         F.md5(F.concat_ws("\n", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).cast("binary")).alias("__tie"))
    # encoded once and stored; only lengths are ordered and summed, and come back to their row by its number
    encoded = store(plain.mapInArrow(run, "conv_id long, turn long, ids array<int>, mask binary, __len long, __tie string").withColumn(
        "__row", F.monotonically_increasing_id()))
    summed = running_sum(encoded.select("__row", "conv_id", "turn", "__tie", "__len"), ["conv_id"], ["turn", "__tie"], {"__upto": F.col("__len")})
    return encoded.join(summed.select("__row", "__upto"), "__row").select(
        "conv_id", "turn", (F.col("__upto") - F.col("__len")).alias("first_token"), "ids", "mask")


def read_turn(ids: np.ndarray, mask: np.ndarray, enc) -> tuple[str, str, str, str]:
    """(printed form, role, text, text under the mask) of a turn's ids; the last three without escapes."""
    first = enc.n_vocab + 1
    at = np.flatnonzero(ids >= first)
    if [int(i) - first for i in ids[at]] != [0, 1, 2] or at[0] != 0 or at[2] != len(ids) - 1:
        raise ValueError("not a turn")
    role, text = (enc.decode(ids[a + 1:b].tolist()) for a, b in zip(at, at[1:]))
    return (MARKS[0] + role + MARKS[1] + text + MARKS[2], unescape(role), unescape(text), unescape(enc.decode(ids[mask == 1].tolist())))


def read_back(formatted: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(conv_id, first_token, printed, role, text, learned) of each turn, decoded from its ids and mask alone."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(tokenizer)
        for batch in batches:
            read = [read_turn(np.asarray(i), np.frombuffer(m, dtype=np.int8), enc) for i, m in zip(batch["ids"], batch["mask"])]
            yield pd.DataFrame(read, columns=["printed", "role", "text", "learned"]).assign(
                conv_id=batch["conv_id"].to_numpy(), first_token=batch["first_token"].to_numpy())[
                    ["conv_id", "first_token", "printed", "role", "text", "learned"]]
    return formatted.select("conv_id", "first_token", "ids", "mask").mapInPandas(
        run, "conv_id long, first_token long, printed string, role string, text string, learned string")
