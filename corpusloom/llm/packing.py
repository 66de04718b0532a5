"""Packing documents into token windows by order-preserving dynamic programming.

Documents stay in the order of ``doc_id``.  A cut between two windows may stand at a document's end (free), at a sentence's
end (a small penalty) or, where a sentence runs on for long, inside it (a larger one).  The cost of a window is its padding:
none at a full window or a power of two, else what is missing to the full size.  The best cuts minimise padding plus
penalties plus a small cost of each sequence; the transition over all starts within a window is a sliding minimum, kept in a monotone queue.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.bpe import ByteCodec, byte_codec, slices

#: Tokens that one run of the dynamic programme takes together; a block ends with a document.
BLOCK_TOKENS = 200_000
#: Penalties, in tokens of padding, of a cut at a sentence's end and inside a sentence.
SENTENCE_CUT, HARD_CUT = 1.0, 12.0
#: Cost of a sequence, in tokens of padding, so that short windows at a power of two don't come for nothing.
SEQUENCE_COST = 16.0
#: Inside sentences longer than this, every so many tokens may be cut.
HARD_STEP = 64


def best_cuts(places: np.ndarray, penalty: np.ndarray, window: int, each: float = SEQUENCE_COST) -> list[int]:
    """Indexes of the chosen places, the first and last included; neighbouring places are at most ``window`` apart.

    cost(i) = penalty(i) + each + min over j of cost(j) + padding(places[i] - places[j]).
    """
    n = len(places)
    where = np.full(int(places[-1]) + 1, -1, dtype=np.int64)
    where[places] = np.arange(n)
    powers = [1 << k for k in range(window.bit_length()) if 1 << k <= window]
    exact: list[list[int]] = [[] for _ in range(n)]
    for p in powers:
        back = places - p
        hit = np.flatnonzero(back >= 0)
        hit = hit[where[back[hit]] >= 0]
        for i, j in zip(hit.tolist(), where[back[hit]].tolist()):
            exact[i].append(j)
    at, extra = places.tolist(), penalty.tolist()
    cost, source = [0.0] * n, [0] * n
    queue: deque[int] = deque()  # starts in order of place, key cost + place increasing
    key = [0.0] * n
    key[0] = float(at[0])
    queue.append(0)
    for i in range(1, n):
        low = at[i] - window
        while at[queue[0]] < low:
            queue.popleft()
        j = queue[0]
        best = key[j] + window - at[i]
        for e in exact[i]:
            if cost[e] <= best:
                best, j = cost[e], e
        best += extra[i] + each
        cost[i], source[i] = best, j
        k = best + at[i]
        key[i] = k
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(i)
    out = [n - 1]
    while out[-1]:
        out.append(source[out[-1]])
    return out[::-1]


class _Ends:
    """Which tokens end a sentence, and which may begin the next one."""

    def __init__(self, codec: ByteCodec, end_id: int):
        size = max(len(codec.bytes), end_id + 1)
        self.stop, self.start = np.zeros(size, bool), np.zeros(size, bool)
        for i, b in enumerate(codec.bytes):
            self.stop[i] = b.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?", b"\n") if b else False
            self.start[i] = b[:1] in (b" ", b"\n", b"\t")


def plan(lengths: np.ndarray, ids: np.ndarray, ends: _Ends, window: int) -> np.ndarray:
    """Places of all cuts in one block, from 0 to its number of tokens."""
    total = len(ids)
    penalty = np.full(total + 1, np.inf)
    stops = np.flatnonzero(ends.stop[ids[:-1]] & ends.start[ids[1:]]) + 1
    penalty[stops] = SENTENCE_CUT
    penalty[np.concatenate([[0], np.cumsum(lengths)])] = 0
    soft = np.flatnonzero(np.isfinite(penalty))
    wide = np.flatnonzero(np.diff(soft) > min(2 * HARD_STEP, window))
    for k in wide.tolist():
        inner = np.arange(soft[k] + min(HARD_STEP, window), soft[k + 1], min(HARD_STEP, window))
        penalty[inner] = HARD_CUT
    places = np.flatnonzero(np.isfinite(penalty))
    return places[best_cuts(places, penalty[places], window)]


def pack_documents(df: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, text: str = "text", key: str = "doc_id", specials: bool = True) -> DataFrame:
    """Pieces of every document: key, ``start``, ``length``, ``token_bytes binary`` (little-endian 32-bit ids), ``doc_tokens``, ``sequence_id``, ``offset``.

    Each document's ids end with ``end_id``; each id lies in exactly one piece, the pieces of a sequence are gapless from offset
    0 and hold at most ``window`` tokens.  A null or empty text is the end id alone.  Repeated rows are packed one by one, ties in
    ``doc_id`` by text; a null key comes first.  Texts of any length are packed whole.  An empty table gives no pieces.  Other columns are ignored,
    whatever their names.

    Rows are range-partitioned by key, so that each task has neighbours; blocks of about BLOCK_TOKENS bound its memory.  A
    sequence never spans two tasks; its id holds the task's number in the upper half.
    """
    kind = df.schema[key].dataType.simpleString()
    if window < 1:
        raise ValueError("window must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_codec(tokenizer, specials)
        ends = _Ends(codec, end_id)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 32

        def solve(keys: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            nonlocal sequence
            cuts = plan(lengths, ids, ends, window)
            begins = np.concatenate([[0], np.cumsum(lengths)])
            edges = np.union1d(cuts, begins)
            lo, hi = edges[:-1], edges[1:]
            doc = np.searchsorted(begins, lo, side="right") - 1
            seq = np.searchsorted(cuts, lo, side="right") - 1
            tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lo), [None, pa.py_buffer(4 * edges), pa.py_buffer(ids)])
            out = pa.RecordBatch.from_arrays(
                [
                    keys.take(pa.array(doc)),
                    pa.array(lo - begins[doc], pa.int64()),
                    pa.array(hi - lo, pa.int64()),
                    tokens.cast(pa.binary()),
                    pa.array(lengths[doc], pa.int64()),
                    pa.array(sequence + seq, pa.int64()),
                    pa.array(lo - cuts[seq], pa.int64()),
                ],
                ["k", "start", "length", "token_bytes", "doc_tokens", "sequence_id", "offset"],
            )
            sequence += len(cuts) - 1
            return out

        held = None  # keys, lengths and ids of documents that don't fill a block yet
        for batch in batches:
            for part in slices(batch, "t"):
                got, counts = codec.encode_column(part["t"])
                keys, lengths = part["k"], counts + 1
                ids = np.full(len(got) + len(counts), end_id, "<u4")
                inner = np.ones(len(ids), bool)
                inner[np.cumsum(lengths) - 1] = False
                ids[inner] = got
                if held:
                    keys, lengths, ids = pa.concat_arrays([held[0], keys]), np.concatenate([held[1], lengths]), np.concatenate([held[2], ids])
                done, begin, to = 0, 0, np.cumsum(lengths)
                while (k := int(np.searchsorted(to, begin + BLOCK_TOKENS))) < len(to):
                    yield solve(keys[done : k + 1], lengths[done : k + 1], ids[begin : to[k]])
                    done, begin = k + 1, int(to[k])
                held = (keys[done:], lengths[done:], ids[begin:]) if done < len(to) else None
        if held:
            yield solve(*held)

    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).repartitionByRange(F.col("k").asc_nulls_first()).sortWithinPartitions("k", "t")
    schema = f"k {kind}, start long, length long, token_bytes binary, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)
