"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is one matrix of log-probabilities (buckets x languages), broadcast to the executors.  A batch of texts is one run of
code points; the n-gram hashes of all of them are formed at once in numpy, the matrix rows gathered and summed between text borders.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of the n-gram hash, and the lengths of n-grams in characters.
BUCKETS, GRAMS = 1 << 16, (1, 2, 3)
#: The fit takes about so many documents a language, chosen by a hash of their ids, of at most so many characters each.
SAMPLE_DOCS, SAMPLE_CHARS = 400, 20_000
#: Texts of more characters are read in pieces of so many, as n-grams take about forty bytes a character while they are summed.
PIECE = 400_000
UNKNOWN = "und"
_BLANK = 32


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages, float32 log-probabilities


@lru_cache(1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def normal_letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one run, and where each begins and the last ends.

    Texts are in lower case, runs of anything but letters are one blank, and each text has a blank at either end.
    """
    raw = np.frombuffer("\0".join(["", *texts, ""]).lower().encode("utf-32-le", "replace"), dtype="<u4")  # no text ends in the middle of a sign
    letter = _letters()[raw]
    border = raw == 0
    if int(border.sum()) != len(texts) + 1:  # a text holds the sign that parts texts
        return normal_letters([t.replace("\0", " ") for t in texts])
    keep = letter | np.concatenate([[True], letter[:-1] | border[:-1]])  # a blank behind a letter or a border, borders, letters
    keep |= border
    # a border stands for the blanks around it: one that ends a text, one that begins the next
    out = np.where(letter, raw, _BLANK).astype(np.uint32)
    out, edge = out[keep], border[keep]
    blank = out == _BLANK
    double = blank & ~edge & (np.concatenate([[False], edge[:-1]]) | np.concatenate([edge[1:], [False]]))  # beside a border
    out, edge = out[~double], edge[~double]
    out = np.repeat(out, np.where(edge, 2, 1))  # a blank for each side
    at = np.flatnonzero(edge)
    starts = at + np.arange(len(at)) + 1  # behind a border's first blank
    return out[1:-1], starts - 1


def has_letter(text: str | None) -> bool:
    if not text:
        return False
    return any(map(str.isalpha, text[:200])) or any(map(str.isalpha, text[200:]))


def hashes(letters: np.ndarray) -> list[np.ndarray]:
    """Bucket of the n-gram that begins at each character, for each n-gram length; the last few positions have none."""
    x = letters.astype(np.uint32)
    out, h = [], x.copy()
    for n in range(1, max(GRAMS) + 1):
        if n > 1:
            h = h[:-1] * np.uint32(0x01000193) ^ x[n - 1 :]
        if n in GRAMS:
            mixed = (h ^ np.uint32(n * 0x9E37)) * np.uint32(0x9E3779B1)
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77)
            out.append((mixed >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32))
    return out


def long_total(text: str, weights: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """What ``totals`` gives for one text, piece by piece; the last letters of a piece go on to the next, so that n-grams across a cut are counted."""
    low = text.lower()  # as a whole: a sigma's form depends on what stands beside it
    total, carry, in_word = np.zeros(weights.shape[1]), np.zeros(0, dtype=np.uint32), True  # as after a letter: the text begins with a blank
    columns = np.ascontiguousarray(weights.T)
    for begin in range(0, len(low) + 1, piece):
        part = low[begin : begin + piece] if begin else " " + low[:piece]
        raw = np.frombuffer((part + " " * (begin + piece > len(low))).encode("utf-32-le", "replace"), dtype="<u4")
        letter = _letters()[raw]
        keep = letter | np.concatenate([[in_word], letter[:-1]])
        run = np.concatenate([carry, np.where(letter, raw, np.uint32(_BLANK))[keep]])
        for n, h in zip(GRAMS, hashes(run)):
            new = h[max(0, len(carry) - n + 1) :]  # those that end in this piece
            total += [column[new].sum(dtype=np.float64) for column in columns]
        carry, in_word = run[max(0, len(run) - max(GRAMS) + 1) :], bool(letter[-1])
    return total


def totals(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Sum of the weight rows of each text's n-grams.  N-grams across a border are left out."""
    if any(len(t) > PIECE for t in texts):
        return np.concatenate([long_total(t, weights)[None] if len(t) > PIECE else totals([t], weights) for t in texts])
    letters, edges = normal_letters(texts)
    total = np.zeros((len(texts), weights.shape[1]))
    columns = np.ascontiguousarray(weights.T)
    for n, h in zip(GRAMS, hashes(letters)):
        last = np.maximum(edges[1:] - n + 1, edges[:-1])
        full = np.flatnonzero(last > edges[:-1])
        if not len(full):
            continue
        pairs = np.stack([edges[:-1][full], last[full]], axis=1).ravel()
        pairs = pairs[:-1] if pairs[-1] >= len(h) else pairs
        for lang, column in enumerate(columns):
            total[full, lang] += np.add.reduceat(column[h], pairs, dtype=np.float64)[::2]
    return total


def fit(rows: list[tuple[str, str]]) -> LanguageModel:
    """From (text, language) pairs.  Languages count alike; add-one smoothing over buckets."""
    languages = sorted({lang for _, lang in rows})
    counts = np.ones((BUCKETS, len(languages)))
    for lang_at, lang in enumerate(languages):
        for text, other in rows:
            if other == lang:
                for h in hashes(normal_letters([text])[0]):
                    counts[:, lang_at] += np.bincount(h, minlength=BUCKETS)
    return LanguageModel(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def training_rows(df: DataFrame, held_out, key: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """About SAMPLE_DOCS documents of every language by a hash of their keys, not those that ``held_out`` (a Column) marks.

    Documents of up to SAMPLE_CHARS characters are taken; of a language without any, beginnings of longer ones.
    """
    known = df.select(F.col(key).alias("k"), F.col(lang).cast("string").alias("y"), F.col(text).cast("string").alias("t")).where(F.col("y").isNotNull() & (F.length("t") > 0) & ~held_out)
    short = F.length("t") <= SAMPLE_CHARS
    sizes = known.groupBy("y").agg(F.count_if(short).alias("n"), F.count("*").alias("every")).collect()
    if not sizes:
        return []
    shares = [(r["y"], r["n"] == 0, int(min(1.0, 1.25 * SAMPLE_DOCS / (r["n"] or r["every"])) * (1 << 20))) for r in sizes]
    wanted = F.broadcast(df.sparkSession.createDataFrame(shares, "wy string, long boolean, share long"))
    taken = (short | F.col("long")) & (F.pmod(F.xxhash64(F.col("k").cast("string")), F.lit(1 << 20)) < F.col("share"))
    sample = known.join(wanted, F.col("y") == F.col("wy")).where(taken).select("k", F.substring("t", 1, SAMPLE_CHARS).alias("t"), "y")
    place = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("k", "t")))  # rows that share a key are taken together
    got = sample.withColumn("place", place).where(F.col("place") <= 2 * SAMPLE_DOCS).select("k", "t", "y").collect()
    return [(r["t"], r["y"]) for r in sorted(got, key=lambda r: (str(r["k"]), r["t"], r["y"])) if has_letter(r["t"])]


def predict(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred string`` and ``score double`` (existing columns of these names are replaced).

    A text that is null or has no letter, or a model without languages, gives ``und`` and 0.  The score is the posterior of the predicted
    language with equal priors; ties go to the language that sorts first.  Whole texts are read, in batches of bounded size, long ones in pieces.  Repeated rows give
    repeated rows, an empty table an empty one; other columns are kept, whatever their names.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = [c for c in df.columns if c.lower() not in ("lang_pred", "score")]
    source = df.select(*[F.col(f"`{c}`") for c in names])
    schema = T.StructType([*source.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, texts in slices(batch, text):
                at = [k for k, x in enumerate(texts) if m.languages and has_letter(x)]
                pred, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
                if at:
                    total = totals([texts[k] for k in at], m.weights)
                    total -= total.max(axis=1, keepdims=True)
                    odds = np.exp(total)
                    best = odds.argmax(axis=1)
                    pred[at] = np.array(m.languages, dtype=object)[best]
                    score[at] = odds[np.arange(len(at)), best] / odds.sum(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred.tolist(), pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    return source.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, most: int = 400_000) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of a batch of at most about ``most`` bytes of text, a longer text being a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(pc.cast(batch[column], pa.string())), 0).to_pylist()
    begin, total = 0, 0
    for k, n in enumerate([*sizes, float("inf")]):
        if k > begin and total + n > most:
            part = batch.slice(begin, k - begin)
            yield part, part[column].to_pylist()
            begin, total = k, 0
        total += n


def fit_on(df: DataFrame, held_out, **names: str) -> LanguageModel:
    rows = training_rows(df, held_out, **names)
    return fit(rows) if rows else LanguageModel([], np.zeros((BUCKETS, 0), dtype=np.float32))


def third_held_out(key: str = "k"):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1


def language_model(spark: SparkSession, sf_dir: str) -> LanguageModel:
    """The model that the query and the pipeline use: learnt from the two thirds of documents that aren't held out."""
    return fit_on(spark.read.parquet(f"{sf_dir}/documents.parquet"), third_held_out())
