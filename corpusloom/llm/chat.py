"""Chat formatting by token-level assembly.

A turn is rendered as ``### role: text</turn>`` and a newline.  The three marks have ids of their own above the vocabulary,
spliced between segments that are encoded separately, so a mark in the token stream is always the template's.  For the rendered
text to be as clear, a backslash is put before every backslash, ``###`` and ``</turn>`` that occurs inside a role or text; the
colon after a role is escaped too.  The loss mask is the prefix sum of +1 where an assistant's text begins and -1 where it ends.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.bpe import byte_codec, chunks, list_of_ids

#: Rendered marks; their ids are the vocabulary's size plus 0, 1, 2.
OPEN, ROLE_END, TURN_END = "### ", ": ", "</turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
#: Ids of one output row at most; longer conversations go on in the next row.
ROW_IDS = 65_536


def escape(text: str, role: bool = False) -> str:
    return (_ROLE_CONTROL if role else _CONTROL).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def format_conversations(df: DataFrame, tokenizer: str, learn_from: str = "assistant", conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Token rows of every conversation: ``conv_id``, ``part`` (from 0), ``token_start``, ``ids array<int>``, ``loss_mask array<tinyint>``.

    Rows are ordered by turn, ties by role and text, null turns first; null roles and texts are empty.  Repeated rows are turns of
    their own.  Conversations of over ROW_IDS tokens are carried on over several rows, so that no row grows without bound.  Texts are
    encoded before the shuffle, row by row, which splits the work on a hot conversation; only finished ids meet in its task, as a
    stream.  A null conversation id is one conversation.  An empty table gives no rows; other columns are ignored.
    """
    kind = df.schema[conv].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_codec(tokenizer, False)
        size = len(codec.bytes)
        marks = [np.array([size + k], dtype="<u4").tobytes() for k in range(3)]
        for batch in batches:
            for part, texts in chunks(batch, "t"):
                roles = [x or "" for x in part["r"].to_pylist()]
                bodies = codec.encode_many([escape(x) if x else "" for x in texts])
                heads = codec.encode_many([escape(x, True) for x in roles])
                ids = [marks[0] + h + marks[1] + b + marks[2] for h, b in zip(heads, bodies)]
                begin = [len(h) // 4 + 2 for h in heads]
                end = [a + len(b) // 4 if r == learn_from else a for a, b, r in zip(begin, bodies, roles)]
                yield pa.RecordBatch.from_arrays([part["c"], part["n"], part["r"], pa.array(ids, pa.binary()), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array([hashlib.md5((x or "").encode()).hexdigest() for x in texts])], ["c", "n", "r", "ids", "loss_begin", "loss_end", "tie"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, start, held, size = object(), 0, 0, [], 0
        for batch in batches:
            rows: list[tuple] = []

            def flush() -> None:
                nonlocal part, start, held, size
                if held:
                    ids = b"".join(x[0] for x in held)
                    delta = np.zeros(len(ids) // 4 + 1, dtype=np.int8)
                    at = 0
                    for raw, a, b in held:
                        if b > a:
                            delta[at + a] += 1
                            delta[at + b] -= 1
                        at += len(raw) // 4
                    rows.append((now, part, start, ids, np.cumsum(delta[:-1], dtype=np.int8)))
                    part, start, held, size = part + 1, start + len(ids) // 4, [], 0

            for c, raw, a, b in zip(batch["c"].to_pylist(), batch["ids"].to_pylist(), batch["loss_begin"].to_pylist(), batch["loss_end"].to_pylist()):
                if c != now:
                    flush()
                    now, part, start = c, 0, 0
                held.append((raw, a, b))
                size += len(raw) // 4
                if size >= ROW_IDS:
                    flush()
            carried = [held, size]
            kind_of = batch.schema.field("c").type
            if rows:
                yield _rows(rows, kind_of)
            held, size = carried
        if held:
            rows = []
            flush()
            yield _rows(rows, kind_of)

    def _rows(rows: list[tuple], kind_of: pa.DataType) -> pa.RecordBatch:
        masks = [r[4] for r in rows]
        offsets = np.concatenate([[0], np.cumsum([len(m) for m in masks])]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], kind_of), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), list_of_ids([r[3] for r in rows]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(masks)))],
            ["c", "part", "token_start", "ids", "loss_mask"],
        )

    rows = df.select(F.col(conv).alias("c"), F.col(turn).cast("long").alias("n"), F.col(role).cast("string").alias("r"), F.col(text).cast("string").alias("t"))
    encoded = rows.mapInArrow(encode, f"c {kind}, n long, r string, ids binary, loss_begin long, loss_end long, tie string")
    ordered = encoded.repartition("c").sortWithinPartitions("c", "n", "r", "tie")
    return ordered.mapInArrow(assemble, f"c {kind}, part int, token_start long, ids array<int>, loss_mask array<tinyint>").withColumnRenamed("c", conv)


def read_back(formatted: DataFrame, tokenizer: str, conv: str = "conv_id") -> DataFrame:
    """What the token rows of ``format_conversations`` say: ``conv_id``, ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``, ``formatted_chars``.

    Turns are found by the template's ids and unescaped; the loss text is what lies under the mask.  Hashes are updated turn by turn,
    so a conversation of any length takes the memory of one token row.  An empty table gives no rows; a null conversation id is one conversation; rows
    are read in order of ``part``, and repeated token rows count as often as they stand there; other columns are ignored.
    """
    kind = formatted.schema[conv].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_codec(tokenizer, False)
        size = len(codec.bytes)
        now, state, kind_of = object(), None, None

        def fresh() -> list:
            return [0, hashlib.sha256(), 0, hashlib.sha256(), 0]

        def digest() -> tuple:
            return (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [kind_of, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["c", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            rows: list[tuple] = []
            kind_of = batch.schema.field("c").type
            for k in range(batch.num_rows):
                c = batch["c"][k].as_py()
                if state is None or c != now:
                    if state is not None:
                        rows.append(digest())
                    now, state = c, fresh()
                ids = batch["ids"][k].values.to_numpy(zero_copy_only=False)
                mask = batch["loss_mask"][k].values.to_numpy(zero_copy_only=False)
                marks = np.flatnonzero(ids >= size)  # a row holds whole turns
                for opened, named, closed in marks.reshape(-1, 3).tolist():
                    who = codec.decode_bytes(ids[opened + 1 : named].tolist()).decode()
                    body = codec.decode_bytes(ids[named + 1 : closed].tolist()).decode()
                    state[0] += 1
                    state[1].update(f"{unescape(who)}\n{unescape(body)}\n".encode())
                    state[4] += len(OPEN) + len(who) + len(ROLE_END) + len(body) + len(TURN_END)
                    under = mask[opened : closed + 1].astype(bool)
                    if under.any():
                        learnt = unescape(codec.decode_bytes(ids[opened : closed + 1][under].tolist()).decode())
                        state[2] += len(learnt)
                        state[3].update(learnt.encode())
            if rows:
                yield out(rows)
        if state is not None:
            yield out([digest()])

    ordered = formatted.select(F.col(conv).alias("c"), "part", "ids", "loss_mask").repartition("c").sortWithinPartitions("c", "part")
    schema = f"c {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.mapInArrow(read, schema).withColumnRenamed("c", conv)


def rendered(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """``formatted`` with the text of each token row, for people to read: all columns stay, in as many rows; an empty table stays empty."""

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_codec(tokenizer, False)
        table = [*codec.bytes, OPEN.encode(), ROLE_END.encode(), TURN_END.encode()]
        for batch in batches:
            shown = [b"".join([table[i] for i in ids]).decode() for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shown, pa.string())], [*batch.schema.names, "formatted"])

    return formatted.mapInArrow(show, T.StructType([*formatted.schema.fields, T.StructField("formatted", T.StringType())]))
