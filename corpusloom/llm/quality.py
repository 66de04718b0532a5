"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line has features of its own, hashed words and signs among them, and features of the lines before and after it.  Only documents
are labelled, and a bad one may hold good lines, so line labels are found with the model: lines of good documents are good; lines of
bad ones begin as bad, and those that a fit without transitions finds more likely good become so, but for each document's worst; then
weights and transitions are fitted by gradient ascent on the chains' likelihood, once more with the labels that this field finds.  A
document's score is the mean of its lines' marginals for ``good`` from the forward-backward algorithm, weighted by line length, mapped
to the chance of label 1 by a logistic curve that is fitted on the same documents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.langid import slices

#: Labelled documents that the fit takes at most, of each label, chosen by a hash of their ids, and their greatest length.
SAMPLE_DOCS, SAMPLE_CHARS = 600, 20_000
#: Share of the score from which a document counts as good.
THRESHOLD = 0.3
RATE, RIDGE = 0.08, 1e-3
#: Steps of the fit without transitions, and of each fit with them.
FIRST_STEPS, STEPS = 120, 120
#: Buckets that words and runs of signs are hashed into.
BUCKETS = 1024

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_KINDS = bytes(1 if 65 <= c <= 90 else 2 if 97 <= c <= 122 else 3 if c >= 128 else 4 if 48 <= c <= 57 else 5 if c in (9, 32) else 6 if c in b".,;:!?'\"()-" else 7 for c in range(256))
_N_OWN = 14
#: Own features of which there is also one that tells whether they pass 0.15: capitals, odd signs, repeated words.
_SHARP = (2, 3, 8)


@lru_cache(200_000)
def _bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % BUCKETS


def line_features(lines: list[str]) -> np.ndarray:
    """One row of numbers from 0 to about 1 for each line; nothing but the text goes in."""
    out = np.zeros((len(lines), _N_OWN), dtype=np.float32)
    seen: dict[str, int] = {}
    for line in lines:
        seen[line] = seen.get(line, 0) + 1
    for k, line in enumerate(lines):
        raw = line.encode("utf-8", "replace")
        n = len(raw)
        row = out[k]
        words = line.split()
        w = len(words)
        if not w:
            row[0] = 1
            continue
        kinds = np.bincount(np.frombuffer(raw.translate(_KINDS), dtype=np.uint8), minlength=8) / n
        row[1] = min(1.0, np.log1p(n) / 9)
        upper, lower, wide, digit, mark, odd = kinds[1], kinds[2], kinds[3], kinds[4], kinds[6], kinds[7]
        distinct = len(set(words))
        row[2] = upper / max(upper + lower + 0.5 * wide, 1e-6)
        row[3] = min(1.0, 4 * odd)
        row[4] = min(1.0, 4 * mark)
        row[5] = min(1.0, 4 * digit)
        row[6] = distinct / w
        row[7] = max(0.0, 1 - distinct / w - 0.5) * 2 if w > 20 else 0.0
        row[8] = sum(map(str.__eq__, words, words[1:])) / w
        row[9] = min(1.0, len(line) / w / 20)
        row[10] = float(line.rstrip()[-1:] in (".", "!", "?", '"'))
        row[11] = float(seen[line] > 1)
        row[12] = min(1.0, w / 50)
        row[13] = sum(1 for x in words if len(x) > 25) / w
    return out


@dataclass
class Lines:
    """Lines of some documents: dense features, buckets of their tokens one after the other, how many each line has, and lengths in characters."""

    dense: np.ndarray
    tokens: np.ndarray
    counts: np.ndarray
    lengths: np.ndarray
    sizes: np.ndarray  # lines of each document

    def scores(self, theta: np.ndarray) -> np.ndarray:
        """Of each line: its dense features' weights and the mean weight of its tokens."""
        at = np.concatenate([[0], np.cumsum(self.counts)])
        sums = np.concatenate([[0.0], np.cumsum(theta[N_DENSE:][self.tokens])])
        return self.dense @ theta[:N_DENSE] + (sums[at[1:]] - sums[at[:-1]]) / np.maximum(self.counts, 1)

    def gradient(self, residual: np.ndarray) -> np.ndarray:
        each = np.repeat(residual / np.maximum(self.counts, 1), self.counts)
        return np.concatenate([self.dense.T @ residual, np.bincount(self.tokens, weights=each, minlength=BUCKETS)])


N_DENSE = 1 + 3 * _N_OWN + len(_SHARP)
N_FEATURES = N_DENSE + BUCKETS


def features(texts: list) -> Lines:
    """The lines of each text; a null or empty text is one blank line."""
    dense, tokens, counts, lengths, sizes = [], [], [], [], []
    edge = np.zeros((1, _N_OWN), dtype=np.float32)
    for text in texts:
        lines = (text or "").split("\n")
        own = line_features(lines)
        before, after = np.concatenate([edge, own[:-1]]), np.concatenate([own[1:], edge])
        dense.append(np.concatenate([np.ones((len(lines), 1), dtype=np.float32), own, (own[:, _SHARP] > 0.15).astype(np.float32), before, after], axis=1))
        for line in lines:
            found = _TOKEN.findall(line.lower())
            tokens += map(_bucket, found)
            counts.append(len(found))
            lengths.append(max(1, len(line)))
        sizes.append(len(lines))
    return Lines(np.concatenate(dense) if dense else np.zeros((0, N_DENSE), dtype=np.float32), np.array(tokens, dtype=np.int32), np.array(counts, dtype=np.int64), np.array(lengths, dtype=np.float64), np.array(sizes, dtype=np.int64))


@dataclass
class LineField:
    weights: np.ndarray  # features, for good against bad
    chain: np.ndarray  # 2 x 2 log-potentials of neighbouring labels, bad and good
    curve: tuple[float, float] = (0.0, 6.0)  # chance of label 1: logistic of first + second * (share of good lines - 1/2)


def marginals(scores: list[np.ndarray], chain: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Chance of ``good`` of each line of each document, the expected transitions, and the sum of log-normalisers.

    All chains advance together, line by line, those that have ended being left out.
    """
    lengths = np.array([len(s) for s in scores])
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths.max()) if len(lengths) else 0
    alive = np.array([int((lengths > t).sum()) for t in range(longest)])
    flat = np.concatenate([np.zeros(0)] + [s for s in scores])
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1][order]
    a = np.zeros((len(flat), 2))
    potential = np.stack([np.zeros(len(flat)), flat], axis=1)
    for t in range(longest):
        at = starts[: alive[t]] + t
        if t:
            before = a[at - 1]
            a[at] = potential[at] + np.logaddexp(before[:, :1] + chain[0], before[:, 1:] + chain[1])
        else:
            a[at] = potential[at]
    b = np.zeros((len(flat), 2))
    expected = np.zeros((2, 2))
    ends = np.concatenate([[0], np.cumsum(lengths)])[1:] - 1
    z = np.logaddexp(a[ends, 0], a[ends, 1]) if len(flat) else np.zeros(0)
    z_sorted = z[order]
    for t in range(longest - 2, -1, -1):
        at = starts[: alive[t + 1]] + t
        after = b[at + 1] + potential[at + 1]
        b[at] = np.logaddexp(chain[:, 0] + after[:, :1], chain[:, 1] + after[:, 1:])
        joint = a[at][:, :, None] + chain[None] + after[:, None, :] - z_sorted[: alive[t + 1], None, None]
        expected += np.exp(joint).sum(axis=0)
    good = np.exp(a[:, 1] + b[:, 1] - np.repeat(z, lengths)) if len(flat) else np.zeros(0)
    return np.split(good, np.cumsum(lengths)[:-1]), expected, float(z.sum())


def _ascend(x: Lines, label: np.ndarray, doc_label: np.ndarray, theta: np.ndarray, steps: int, chained: bool) -> np.ndarray:
    """Weights and transitions by Adam on the likelihood of line labels; documents of either label weigh alike, each by its share of their lines."""
    share = np.where(doc_label == 1, 0.5 / max(1, (doc_label == 1).sum()), 0.5 / max(1, (doc_label == 0).sum()))
    line_share = np.repeat(share / x.sizes, x.sizes)
    edges = np.concatenate([[0], np.cumsum(x.sizes)])
    inner = np.ones(len(label), dtype=bool)
    inner[edges[1:] - 1] = False
    here = np.flatnonzero(inner)
    of = np.repeat(doc_label, x.sizes)
    observed = [np.zeros((2, 2)) for _ in range(2)]
    for y in (0, 1):
        at = here[of[here] == y]
        np.add.at(observed[y], (label[at], label[at + 1]), 1)
    groups = [np.flatnonzero(doc_label == y) for y in (0, 1)]
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    free = np.concatenate([[0], np.ones(len(theta) - 1)])  # the constant has no ridge
    for step in range(1, steps + 1):
        scores, chain = x.scores(theta[:N_FEATURES]), theta[N_FEATURES:].reshape(2, 2)
        towards = np.zeros((2, 2))
        if chained:
            good = np.zeros(len(label))
            parts = np.split(scores, edges[1:-1])
            for y, members in enumerate(groups):
                got, expected, _ = marginals([parts[m] for m in members], chain)
                for m, g in zip(members, got):
                    good[edges[m] : edges[m + 1]] = g
                towards += 0.5 * (observed[y] - expected) / max(1, x.sizes[members].sum())
        else:
            good = 1 / (1 + np.exp(-np.clip(scores, -50, 50)))
        gradient = np.concatenate([x.gradient((label - good) * line_share), towards.ravel() / x.sizes.mean()]) - RIDGE * theta * free
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        theta = theta + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return theta


def _line_labels(good: np.ndarray, sizes: np.ndarray, doc_label: np.ndarray) -> np.ndarray:
    """Lines of good documents are good; of a bad one those more likely good than not, but for the worst."""
    label = (good >= 0.5).astype(np.int64)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    for a, b, y in zip(edges[:-1], edges[1:], doc_label):
        if y:
            label[a:b] = 1
        else:
            label[a + int(good[a:b].argmin())] = 0
    return label


def _shares(x: Lines, good: np.ndarray) -> np.ndarray:
    """Mean of each document's line marginals, weighted by length."""
    at = np.concatenate([[0], np.cumsum(x.sizes)])[:-1]
    return np.clip(np.add.reduceat(good * x.lengths, at) / np.add.reduceat(x.lengths, at), 0, 1) if len(at) else np.zeros(0)


def fit(rows: list[tuple[str, int]], first_steps: int = FIRST_STEPS, steps: int = STEPS) -> LineField:
    """From (text, label 0 or 1) pairs.  With one label only, every document has it; without any, each scores one half."""
    theta = np.zeros(N_FEATURES + 4)
    if len({y for _, y in rows}) < 2:
        theta[0] = 4.0 if rows and rows[0][1] else -4.0 if rows else 0.0
        return LineField(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2))
    x, doc_label = features([t for t, _ in rows]), np.array([y for _, y in rows])
    theta = _ascend(x, np.repeat(doc_label, x.sizes), doc_label, theta, first_steps, False)
    good = 1 / (1 + np.exp(-np.clip(x.scores(theta[:N_FEATURES]), -50, 50)))
    for _ in range(2):
        theta = _ascend(x, _line_labels(good, x.sizes, doc_label), doc_label, theta, steps, True)
        good = np.concatenate(marginals(np.split(x.scores(theta[:N_FEATURES]), np.cumsum(x.sizes)[:-1]), theta[N_FEATURES:].reshape(2, 2))[0])
    return LineField(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2), _curve(_shares(x, good), doc_label))


def _curve(share: np.ndarray, label: np.ndarray, steps: int = 60, ridge: float = 1e-3) -> tuple[float, float]:
    """Logistic regression of labels on shares of good lines, both labels weighing alike, by Newton's method; it never falls."""
    w = np.where(label == 1, 0.5 / (label == 1).sum(), 0.5 / (label == 0).sum())
    x = np.stack([np.ones(len(share)), share - 0.5], axis=1)
    beta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ beta))
        hessian = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        beta = beta + np.linalg.solve(hessian, x.T @ (w * (label - p)) - ridge * beta)
    return float(beta[0]), float(max(beta[1], 0.0))


def score_texts(texts: list, field: LineField) -> np.ndarray:
    x = features(texts)
    if not len(x.sizes):
        return np.zeros(0)
    good, _, _ = marginals(np.split(x.scores(field.weights), np.cumsum(x.sizes)[:-1]), field.chain)
    return 1 / (1 + np.exp(-(field.curve[0] + field.curve[1] * (_shares(x, np.concatenate(good)) - 0.5))))


def training_rows(df: DataFrame, labels: DataFrame, held_out, key: str = "doc_id", text: str = "text", label: str = "quality") -> list[tuple[str, int]]:
    """A bounded sample of labelled documents: of each label the SAMPLE_DOCS smallest hashes of keys that ``held_out`` doesn't mark."""
    chosen = []
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(F.col("k").isNotNull() & F.col("y").isin(0, 1) & ~held_out)
    for y in (0, 1):
        chosen += [(r["k"], y) for r in known.where(F.col("y") == y).select("k").distinct().orderBy(F.xxhash64(F.col("k").cast("string")), "k").limit(SAMPLE_DOCS).collect()]
    if not chosen:
        return []
    wanted = F.broadcast(df.sparkSession.createDataFrame(chosen, f"wk {df.schema[key].dataType.simpleString()}, y int"))
    docs = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where(F.length("t") <= SAMPLE_CHARS)
    got = docs.join(wanted, docs["k"] == F.col("wk")).select("k", "t", "y").limit(4 * SAMPLE_DOCS).collect()
    return [(r["t"], r["y"]) for r in sorted(got, key=lambda r: (str(r["k"]), r["t"], r["y"]))]


def fifth_held_out(key: str = "k"):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0


def quality_model(spark: SparkSession, sf_dir: str) -> LineField:
    """The field that the query and the pipeline use: learnt from labels of the four fifths of documents that aren't held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return fit(training_rows(docs, labels, fifth_held_out()))


def score_quality(df: DataFrame, field: LineField, text: str = "text") -> DataFrame:
    """``df`` with ``score double`` (0 to 1) and ``predicted int`` (1 from THRESHOLD on); columns of these names are replaced.

    A null or empty text is one empty line and is scored as such.  Documents of any length are scored whole; a batch holds about
    400,000 bytes of text or one longer text.  A score of exactly THRESHOLD is good.  Repeated rows give repeated rows, an empty table an empty
    one; other columns are kept, whatever their names.
    """
    shared = df.sparkSession.sparkContext.broadcast(field)
    names = [c for c in df.columns if c.lower() not in ("score", "predicted")]
    source = df.select(*[F.col(f"`{c}`") for c in names])
    schema = T.StructType([*source.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part, texts in slices(batch, text):
                score = score_texts(texts, model)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], [*names, "score", "predicted"])

    return source.mapInArrow(run, schema)
