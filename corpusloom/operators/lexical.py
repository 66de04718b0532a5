"""Word alignment learnt from the pairs themselves: translation probabilities by expectation maximisation, then mutual best words.

Within a round, what a word of side ``b`` gives to the words of side ``a`` depends on no other word of side ``b`` but through the words' totals of the
rounds before.  So the words of side ``b`` are dealt over blocks, and a block finds all rounds' counts of its own words in memory; only totals,
and in the end chances, leave it.  Pairs of words that stand in one row are never rows of a table.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a side at most that are paired with each other in one row; longer rows are cut into pieces by place.
LONGEST = 200
#: Blocks of words at least, and words of side ``a`` for which there is one block more.
BLOCKS, BLOCK_WORDS = 12, 1_000_000
#: Pairs of words that a block looks at in one go; pairs from which a word of side ``b`` may be looked at by itself; words of a side that are dealt in one go.
AT_ONCE, ALONE, DEALT_AT_ONCE = 250_000, 8_000, 1_000_000


def _side(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, and for each distinct word of a piece its piece, its place among the words, how often it stands there); pieces are rows times 2^32 plus place."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    words, code = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    pieces, piece = np.unique((row << 32) + at // LONGEST, return_inverse=True)
    both, n = np.unique(piece * max(1, len(words)) + code, return_counts=True)
    return words, pieces[both // max(1, len(words))], (both % max(1, len(words))).astype(np.int32), n.astype(np.float64)


def _small(n: np.ndarray) -> np.ndarray:
    return n.astype(np.min_scalar_type(int(n.max(initial=0))))


def _plain(n: np.ndarray) -> np.ndarray | None:
    """Counts, or nothing if all are 1."""
    return None if (n == 1).all() else n


def _used(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    used, at = np.unique(at, return_inverse=True)
    return words[used], _small(at)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about DEALT_AT_ONCE words on either side, or of one longer row."""
    for batch in batches:
        words = np.cumsum(np.maximum(*(batch[n].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("a", "b"))))
        begin = 0
        while begin < len(words):
            end = max(begin + 1, int(np.searchsorted(words, DEALT_AT_ONCE + (words[begin - 1] if begin else 0), "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def _dealt(labels: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of word hashes to (block, what): for each block the block's words of side ``b`` and the words of side ``a`` of the same pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            (xs, x_piece, x, c), (ys, y_piece, y, d) = _side(batch["a"]), _side(batch["b"])
            of = np.mod(ys, len(labels))[y]
            shared = np.isin(y_piece, x_piece)
            for block, label in enumerate(labels):
                own = shared & (of == block)
                if not own.any():
                    continue
                units, unit = np.unique(y_piece[own], return_inverse=True)
                taken = np.isin(x_piece, units)
                sizes = np.searchsorted(x_piece[taken], units, "right") - np.searchsorted(x_piece[taken], units, "left")
                what = (*_used(xs, x[taken]), _plain(c[taken]), _small(sizes), *_used(ys, y[own]), _plain(d[own]), _small(np.bincount(unit)))
                yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([pickle.dumps(what, 5)], pa.binary())], ["block", "what"])

    return run


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Of (words, places among them): all words, and places among those."""
    words = np.unique(np.concatenate([w for w, _ in parts]))
    return words, np.concatenate([np.searchsorted(words, w).astype(np.int32)[k] for w, k in parts])


def _counts(parts: list[tuple], n: int, like: int) -> np.ndarray | None:
    return None if all(p[n] is None for p in parts) else np.concatenate([np.ones(len(p[like])) if p[n] is None else p[n] for p in parts])


def _learnt(parts: list[tuple], totals: Callable[[np.ndarray], list[np.ndarray]], rounds: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(words of side a, places among them, words of side b, counts) of the last round for a block's pairs of words, some words of side ``b`` at a time."""
    xs, x = _joined([(p[0], p[1]) for p in parts])
    ys, y = _joined([(p[4], p[5]) for p in parts])
    c, d = _counts(parts, 2, 1), _counts(parts, 6, 5)
    sizes = np.concatenate([p[3] for p in parts]).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    unit = np.repeat(np.arange(len(sizes), dtype=np.int32), np.concatenate([p[7] for p in parts]))
    parts.clear()
    order = np.argsort(y, kind="stable")
    y, unit, d = y[order], unit[order], None if d is None else d[order]
    del order
    whole = totals(xs)
    ends = np.cumsum(sizes[unit])  # pairs of words up to each place of a word of side b
    border = np.searchsorted(y, np.arange(len(ys) + 1))  # places of each word
    pairs_to = np.concatenate([[0], ends])[border]
    alone = np.append(np.flatnonzero(np.diff(pairs_to) > min(AT_ONCE, max(ALONE, len(xs) // 8))), len(ys))  # frequent words have a count for each word of side a
    first = 0
    while first < len(ys):

        def expanded(a: int, b: int):
            """Of places a to b: where each one's pairs begin, how many it has, places of their words of side a."""
            n = sizes[unit[a:b]]
            begin = np.cumsum(n) - n
            return begin, n, np.repeat(starts[unit[a:b]] - begin, n) + np.arange(int(n.sum()))

        upto = alone[np.searchsorted(alone, first)]
        last = first + 1 if upto == first else max(first + 1, min(upto, int(np.searchsorted(pairs_to, pairs_to[first] + AT_ONCE, "right")) - 1))
        lo, hi = border[first], border[last]
        cuts = np.unique([lo, *np.searchsorted(ends[:hi], np.arange(pairs_to[first] + AT_ONCE, pairs_to[last], AT_ONCE)), hi])
        once = expanded(lo, hi) if len(cuts) == 2 else None
        if upto == first:
            slot, of_slot, y_slot = x[once[2]] if once else None, np.arange(len(xs)), np.full(len(xs), first)
        else:
            found, slot = np.unique(np.repeat(y[lo:hi].astype(np.int64), once[1]) * len(xs) + x[once[2]], return_inverse=True)
            of_slot, y_slot = found % len(xs), found // len(xs)
        p = np.ones(len(of_slot))
        for k in range(rounds):
            e = np.zeros(len(of_slot))
            for a, b in zip(cuts[:-1], cuts[1:]):
                begin, n, at = once or expanded(a, b)
                slot = slot if once else x[at]
                w = p[slot] if c is None else p[slot] * c[at]
                e += np.bincount(slot, w * np.repeat((1.0 if d is None else d[a:b]) / np.add.reduceat(w, begin), n), len(e))
            if k + 1 < rounds:
                p = e / whole[k][of_slot]
        some = e > 0
        yield xs, of_slot[some], ys[y_slot[some]], e[some]
        first = last


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], list[tuple]]]:
    """Rows of (block, what), in order of blocks, to each block's totals and parts."""
    now, known, parts = None, [], []
    for batch in batches:
        for block, what in zip(batch["block"].to_pylist(), batch["what"]):
            if block != now:
                if parts:
                    yield known, parts
                now, known, parts = block, [], []
            what = pickle.loads(what.as_buffer())
            (known if len(what) == 2 else parts).append(what)
    batch = what = None  # as large as the block
    if parts:
        yield known, parts


def _counted(rounds: int, least: float | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(x, t) with a block's totals of the last round; with ``least`` (x, y, p) with chances, of which the totals must be known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for known, parts in _blocks(batches):

            def totals(xs: np.ndarray) -> list[np.ndarray]:
                if not known:
                    return []
                words = np.concatenate([w for w, _ in known])
                order = np.argsort(words)
                values = np.concatenate([v for _, v in known], axis=1)[:, order]
                known[:] = [(xs, values[:, np.searchsorted(words[order], xs)])]
                return list(known[0][1])

            mine = None
            for xs, x, y, e in _learnt(parts, totals, rounds):
                if least is None:
                    mine = np.zeros(len(xs)) if mine is None else mine
                    mine += np.bincount(x, e, len(xs))
                else:
                    p = e / known[0][1][rounds - 1][x]
                    some = p >= least * (1 - 1e-9)  # the caller compares rounded ones
                    yield pa.RecordBatch.from_arrays([pa.array(xs[x[some]]), pa.array(y[some]), pa.array(p[some])], ["x", "y", "p"])
            if mine is not None:
                yield pa.RecordBatch.from_arrays([pa.array(xs), pa.array(mine)], ["x", "t"])

    return run


def _first_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, t) after the first round: all words of a piece's side ``a`` share those of side ``b`` alike."""
    for batch in _slices(batches):
        (xs, x_piece, x, c), (_, y_piece, _, d) = _side(batch["a"]), _side(batch["b"])
        pieces, piece = np.unique(np.concatenate([x_piece, y_piece]), return_inverse=True)
        share = np.bincount(piece[len(x_piece) :], d, len(pieces)) / np.maximum(1, np.bincount(piece[: len(x_piece)], c, len(pieces)))
        t = np.bincount(x, c * share[piece[: len(x_piece)]], len(xs))
        yield pa.RecordBatch.from_arrays([pa.array(xs[t > 0]), pa.array(t[t > 0])], ["x", "t"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, *t = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((x, np.stack(t)), 5)], pa.binary())], ["what"])


def translation_table(df: DataFrame, key: str, a: str, b: str, table: Callable[[DataFrame], DataFrame], rounds: int = 4, least: float = 0.0) -> DataFrame:
    """``x``, ``y``, ``p``: the chance that a word of side ``a`` stands for one of side ``b`` (token arrays), after so many rounds from equal chances.

    Each round deals each word's count to the words that may have made it, by their chances so far, and divides by what a word gets.  Words of a row
    are paired within pieces of LONGEST places.  ``table`` writes an intermediate result to the shared folder and reads it again.  Chances below ``least``
    (but for rounding) are left out, after the last round.  Words go by 64-bit hashes.

    A task holds the words of side ``a`` of the rows that have a word of its block, four bytes each, and a round goes through the blocks once.
    """
    if rounds < 1:
        words = df.select(F.posexplode(a).alias("at", "x"), F.col(key).alias("k"), F.col(b).alias("b")).select("x", "at", F.posexplode("b").alias("at2", "y"))
        return words.where(F.floor(F.col("at") / LONGEST) == F.floor(F.col("at2") / LONGEST)).select("x", "y", F.lit(1.0).alias("p")).distinct()
    hashed = df.select(*[F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda w: F.xxhash64(w)).alias(n) for c, n in ((a, "a"), (b, "b"))])
    size = df.agg(F.sum(F.greatest(F.size(a), F.lit(0))).alias("n")).first()["n"] or 0
    blocks = max(BLOCKS, -(-size // BLOCK_WORDS))
    place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(blocks)).alias("place")  # of a number among as many partitions: each block has its own
    labels = sorted(r["label"] for r in df.sparkSession.range(40 * blocks).select("id", place).groupBy("place").agg(F.min("id").alias("label")).collect())
    dealt, known = hashed.mapInArrow(_dealt(labels), "block int, what binary"), None

    def of_blocks(run, schema: str) -> DataFrame:
        rows = dealt
        if known is not None:
            rows = rows.unionByName(known.mapInArrow(_packed, "what binary").select(F.explode(F.array(*[F.lit(k) for k in labels])).alias("block"), "what"))
        return rows.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(run, schema)

    for k in range(1, rounds + 1):
        each = hashed.mapInArrow(_first_totals, "x long, t double") if k == 1 else of_blocks(_counted(k, None), "x long, t double")
        got = each.groupBy("x").agg(F.sum("t").alias(f"t{k}"))
        known = table(got if known is None else known.join(got, "x"))
    chances = table(of_blocks(_counted(rounds, least), "x long, y long, p double"))
    named = lambda c, name: df.select(F.explode(c).alias(name)).distinct().select(F.xxhash64(name).alias(f"{name}_hash"), name)
    hashes = chances.withColumnsRenamed({"x": "x_hash", "y": "y_hash"})
    return hashes.join(named(a, "x"), "x_hash").join(named(b, "y"), "y_hash").select("x", "y", "p")


def _words(df: DataFrame, key: str, words: str, name: str) -> DataFrame:
    """(k, piece, word): the distinct words of each piece."""
    return df.select(F.col(key).alias("k"), F.posexplode(words).alias("at", name)).select("k", F.floor(F.col("at") / LONGEST).alias("piece"), name).distinct()


def mutual_links(df: DataFrame, key: str, a: str, b: str, chances: DataFrame, least: float = 0.1) -> DataFrame:
    """``key``, ``x``, ``y`` of word types of a row that are each other's most likely word, at ``least`` so likely; ties go to the word that sorts first.

    Chances are compared to twelve places, as the order of a sum's parts may change the last ones.
    """
    likely = _words(df, key, a, "x").join(chances.withColumn("p", F.round("p", 12)).where(F.col("p") >= least), "x")
    seen = likely.join(_words(df, key, b, "y"), ["k", "piece", "y"]).select("k", "x", "y", "p").distinct()
    best = lambda by, other: seen.groupBy("k", by).agg(F.min(F.struct((-F.col("p")).alias("q"), F.col(other))).alias("m")).select("k", by, F.col(f"m.{other}").alias(other))
    return best("x", "y").join(best("y", "x"), ["k", "x", "y"]).withColumnRenamed("k", key)
