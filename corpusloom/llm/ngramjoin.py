"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct word shingles, as 64-bit hashes.  All shingles stand in one global order: rare before
frequent, by the counters of a fixed-size sketch that all documents add to, ties by hash.  A set's prefix is its shortest beginning
that a linked set cannot miss: with t = size - ceil(threshold * size) tokens that may be missing, rare tokens cover one miss
each, and the frequent ones, dealt into small classes by hash, cover one less than each class holds of them.  Rare tokens of the
prefix are indexed one by one, frequent ones as combinations of two of a class, and prefixes are extended until they cover t + 1.
Two linked sets then share an indexed token or combination; whatever shares one is verified on whole sets.

The first member of an index entry is its hub.  Members are compared with their hubs, and the verified links are made into
components.  Two linked sets share an entry, so both are members of that entry's hub; what is left to compare are members of one hub
whose components differ.  That is done in blocks, by products of token incidence matrices, and blocks are left out whose distances to
the hub differ by more than linked sets' may (Jaccard distance is a metric).  No pair is ever a row, and no link between
different components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.components import components
from corpusloom.llm.workspace import Workspace

WORDS, SIMILAR = 5, 75
#: Counters of the sketch: so many a document, between these powers of two; each task's part is a slice a row.
SKETCH_PER_DOC, SKETCH_BITS, SLICE_BITS = 64, (16, 24), 16
#: A token counts as frequent when its counter exceeds the mean of all by this much, and by this factor.
FREQUENT_ABOVE, FREQUENT_TIMES = 48, 3
#: Sets from which an entry counts as hot, and the parts that its members are dealt into.
HOT_FROM, HOT_PARTS = 8192, 64
#: Members of a hub that one task compares with it, and documents and shingles of one block.
VERIFY_GROUP, BLOCK_DOCS, BLOCK_SHINGLES = 512, 256, 500_000
#: Bands of distance to a hub that large hubs' blocks are cut by.
BANDS = 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE, _MIX1, _MIX2 = 0x9E3779B97F4A7C15 | 1, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


@lru_cache(1)
def _byte_codes() -> np.ndarray:
    return np.random.default_rng(20_240_229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


class _Powers:
    """base**i and base**-i modulo 2**64, as far as asked for."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = pow(_BASE, -1, 2**64)
            for name, base in (("up", _BASE), ("down", inverse)):
                full = np.full(size, base, dtype=np.uint64)
                full[0] = 1
                setattr(cls, name, np.multiply.accumulate(full))
        return cls.up[:n], cls.down[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX2)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes | None], n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each UTF-8 text: words are runs of other than blank and \\t to \\r, A-Z in lower case.

    A text with fewer than ``n`` words, but one, is the one shingle of all its words.  Hashes have 64 bits.
    """
    joined = b"\n".join([t or b"" for t in texts]).translate(_LOWER)
    raw = np.frombuffer(joined, dtype=np.uint8)
    if not len(raw):
        return [np.zeros(0, dtype=np.uint64) for _ in texts]
    space = _IS_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
    begin, end = edge[::2], edge[1::2]
    up, down = _Powers.to(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_byte_codes()[raw] * up[: len(raw)], dtype=np.uint64)])
        word = _mixed((sums[end] - sums[begin]) * down[begin])
        sizes = np.fromiter((len(t) + 1 if t else 1 for t in texts), dtype=np.int64, count=len(texts))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        first = np.searchsorted(begin, starts)  # of each text, its first word
        if len(word) >= n:
            whole = word[: len(word) - n + 1].copy()
            for k in range(1, n):
                whole = whole * np.uint64(_MIX1) + word[k : len(word) - n + 1 + k]
            whole = _mixed(whole)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= n:
                out.append(np.unique(whole[a : b - n + 1]))
            elif b > a:
                h = np.uint64(b - a)
                for w in word[a:b]:
                    h = h * np.uint64(_MIX2) + w
                out.append(_mixed(np.array([h], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out


def class_size(scheme: int, similar: int = SIMILAR) -> int:
    """Classes of frequent tokens in a scheme; sets of a scheme have at least (100/similar)**(scheme - 1) tokens, eight times as many as classes."""
    return max(1, int((100 / similar) ** (scheme - 1) / 8))


def scheme_of(size: int, similar: int = SIMILAR) -> int:
    """Sizes of linked sets are within the threshold, so their schemes are the same or neighbours; each set is indexed in its own and the next."""
    return int(np.floor(np.log(size) / np.log(100 / similar) + 1e-9))


def signatures(tokens: np.ndarray, counts: np.ndarray, frequent_from: int, similar: int = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """Index entries of a set, and how many sets at most have each: ``tokens`` are sorted hashes, ``counts`` their sketch counters.

    A set that links with equal sets only, by its size, has no entries.
    """
    n = len(tokens)
    missing = n - -(-similar * n // 100)
    if not n or (missing == 0 and 100 * n // similar == n):
        return tokens[:0], counts[:0]
    order = np.argsort(counts, kind="stable")  # tokens are sorted, so ties stand by hash
    ranked, ranked_counts = tokens[order], counts[order]
    rare = int(np.searchsorted(ranked_counts, frequent_from))
    if rare > missing:
        return ranked[: missing + 1], ranked_counts[: missing + 1]
    alone = n if n - missing == 1 else rare  # so small a set may link by one token, whatever its class
    found, held_by = [ranked[:alone]], [ranked_counts[:alone]]
    own = scheme_of(n, similar)
    for scheme in (own, own + 1):
        classes = class_size(scheme, similar)
        held: dict[int, list[tuple[int, int]]] = {}
        covered = rare
        for t, c in zip(ranked[rare:].tolist(), ranked_counts[rare:].tolist()):
            members = held.setdefault(t % classes, [])
            members.append((t, c))
            covered += len(members) > 1
            if covered > missing:
                break
        pairs = [(x, y, c) for m in held.values() for k, (x, _) in enumerate(m) for y, c in m[:k]]  # m rises in its counters
        if pairs:
            p = np.array([q[:2] for q in pairs], dtype=np.uint64)
            lo, hi = p.min(axis=1), p.max(axis=1)
            with np.errstate(over="ignore"):
                found.append(_mixed(_mixed(lo * np.uint64(_MIX2) + np.uint64(scheme + 1)) + hi * np.uint64(_MIX1)))
            held_by.append(np.array([q[2] for q in pairs], dtype=counts.dtype))
    return np.concatenate(found), np.concatenate(held_by)


def _byte_slices(batch: pa.RecordBatch, column: str, most: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list]]:
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_pylist()
    begin, total = 0, 0
    for k, n in enumerate([*sizes, float("inf")]):
        if k > begin and total + n > most:
            part = batch.slice(begin, k - begin)
            yield part, part[column].to_pylist()
            begin, total = k, 0
        total += n


def _packed(counters: np.ndarray) -> bytes:
    """Which counters are above nothing, as bits, and those counters, saturated at 65,535; compressed."""
    import zlib

    some = counters > 0
    small = np.minimum(counters[some], 65_535).astype("<u2")
    return zlib.compress(np.packbits(some).tobytes() + small.view(np.uint8).reshape(-1, 2).T.tobytes(), 1)


def _unpacked(raw: bytes, width: int) -> np.ndarray:
    import zlib

    data = np.frombuffer(zlib.decompress(raw), dtype=np.uint8)
    some = np.unpackbits(data[: width // 8]).astype(bool)
    out = np.zeros(width, dtype=np.uint32)
    out[some] = np.ascontiguousarray(data[width // 8 :].reshape(2, -1).T).view("<u2").ravel()
    return out


def _describe(docs: DataFrame, bits: int) -> DataFrame:
    """For each row its set's size and fingerprint; and each task's sketch, in slices."""
    slices = 1 << max(0, bits - SLICE_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        names = ["slice", "k", "n", "f", "counters"]
        sketch = np.zeros(1 << bits, dtype=np.uint32)
        for batch in batches:
            for part, texts in _byte_slices(batch, "t"):
                sets = shingle_sets(texts)
                for s in sets:
                    sketch[(s >> np.uint64(64 - bits)).astype(np.int64)] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(sets), pa.int32()), part["k"], pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.nulls(len(sets), pa.binary())], names
                )
        each = sketch.reshape(slices, -1)
        used = [k for k in range(slices) if each[k].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.binary()), pa.array([_packed(each[k]) for k in used], pa.binary())], names)

    return docs.mapInArrow(run, "slice int, k long, n long, f binary, counters binary")


def _sketch(parts: DataFrame, bits: int) -> np.ndarray:
    """The sum of all tasks' sketches, saturated at 65,535: a fixed number of counters, whatever the corpus."""

    width = 1 << min(bits, SLICE_BITS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch["slice"].to_pylist(), batch["counters"].to_pylist()):
                x = _unpacked(raw, width)
                total[k] = np.minimum(total[k] + x, 65_535) if k in total else x
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array([v.astype("<u2").tobytes() for v in total.values()], pa.binary())], ["slice", "counters"])

    out = np.zeros(1 << bits, dtype=np.uint16)
    for r in parts.select("slice", "counters").repartition("slice").mapInArrow(add, "slice int, counters binary").toLocalIterator():
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counters"], dtype="<u2")
    return out


def _postings(docs: DataFrame, sketch: np.ndarray, bits: int, similar: int) -> DataFrame:
    """(entry, salt, member, first member) of every index entry that has more than one member.

    What the sketch bounds an entry's members by tells hot entries beforehand: their members are dealt over HOT_PARTS tasks by a salt, each
    part with a first member of its own, and members that stand alone in a part are kept.  ``heads_of`` joins the parts.
    """
    mean = float(sketch.mean(dtype=np.float64))
    frequent_from = int(min(65_535, max(mean + FREQUENT_ABOVE, FREQUENT_TIMES * mean)))
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    hot_from = max(HOT_FROM, 4 * mean)  # counters that collisions fill tell nothing

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = shared.value
        for batch in batches:
            for part, texts in _byte_slices(batch, "t"):
                found = [signatures(s, counters[(s >> np.uint64(64 - bits)).astype(np.int64)], frequent_from, similar) for s in shingle_sets(texts)]
                sizes = np.array([len(f[0]) for f in found])
                keys = part["k"].to_numpy(zero_copy_only=False).astype(np.int64)
                salts = (1 + (_mixed(keys.view(np.uint64)) % np.uint64(HOT_PARTS))).astype(np.int32)
                hot = np.concatenate([f[1] for f in found]) >= hot_from
                salt = np.where(hot, np.repeat(salts, sizes), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[0] for f in found]).view(np.int64)), pa.array(salt), pa.array(np.repeat(keys, sizes))], ["sig", "salt", "k"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_k, first, several = None, None, None, False  # of the entry that the previous batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, salt, k = (batch[c].to_numpy(zero_copy_only=False) for c in ("sig", "salt", "k"))
            new = np.concatenate([[last != (sig[0], salt[0])], (sig[1:] != sig[:-1]) | (salt[1:] != salt[:-1])])
            starts = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            firsts = k[starts]
            if not new[0]:
                group, firsts = group + 1, np.concatenate([[first], firsts])
            same = np.bincount(group, minlength=len(firsts))
            rows = np.flatnonzero(~new | (same[group] > 1) | (salt > 0))
            s, t, m, f = sig[rows], salt[rows], k[rows], firsts[group[rows]]
            if not new[0] and not several:  # the entry's first member stood alone at the last batch's end
                s, t, m, f = (np.concatenate([[x], y]) for x, y in ((last[0], s), (last[1], t), (last_k, m), (first, f)))
            last, last_k, first = (sig[-1], salt[-1]), k[-1], firsts[-1]
            several = bool(salt[-1] > 0 or same[-1] > 1 or (len(firsts) == 1 and not new[0]))
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(t, pa.int32()), pa.array(m), pa.array(f)], ["sig", "salt", "k", "head"])

    entries = docs.mapInArrow(index, "sig long, salt int, k long").repartition("sig", "salt").sortWithinPartitions("sig", "salt", "k")
    return entries.mapInArrow(gather, "sig long, salt int, k long, head long")


def heads_of(postings: DataFrame) -> DataFrame:
    """(member, hub) of every entry: the least of the first members of an entry's parts is the hub of them all."""
    hot = postings.where("salt > 0")
    top = hot.groupBy("sig").agg(F.min("head").alias("top")).select(F.col("sig").alias("of"), "top")
    return postings.where("salt = 0").select("k", "head").unionByName(hot.join(top, F.col("sig") == F.col("of")).select("k", F.col("top").alias("head")))


def _linked(common: int, a: int, b: int, similar: int) -> bool:
    return common > 0 and 100 * common >= similar * (a + b - common)


def measured(docs: DataFrame, pairs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """``pairs`` (a, b) with ``distance`` (1 - Jaccard) and ``linked``, counted on whole texts of ``docs`` (k, t).

    b is the hub: its members are dealt into groups of about VERIFY_GROUP; its text goes once to each, theirs once a pair.  Of rows
    that share a key the nearest ones count.
    """
    degree = pairs.groupBy(F.col("b").alias("hub")).agg(F.count("*").alias("m")).select("hub", F.ceil(F.col("m") / F.lit(VERIFY_GROUP)).cast("int").alias("groups"))
    dealt = pairs.join(degree, F.col("b") == F.col("hub")).select("a", "b", F.pmod(F.xxhash64("a"), F.col("groups")).cast("int").alias("g"))
    wanted = dealt.select(F.col("a").alias("w"), "b", "g", F.lit(1).alias("role")).unionByName(degree.select(F.col("hub").alias("w"), F.col("hub").alias("b"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), F.lit(0).alias("role")))
    texts = docs.join(wanted, F.col("k") == F.col("w")).select("b", "g", "role", "k", "t").repartition("b", "g").sortWithinPartitions("b", "g", "role", "k")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_sets, fresh = None, [], False  # rows that share the hub's key have a set each
        for batch in batches:
            for part, raw in _byte_slices(batch, "t"):
                rows = []
                for to, role, k, s in zip(part["b"].to_pylist(), part["role"].to_pylist(), part["k"].to_pylist(), shingle_sets(raw)):
                    if role == 0:
                        hub_sets = [*(hub_sets if hub == to and fresh else []), s]
                        hub, fresh = to, True
                        continue
                    fresh = False
                    found = []
                    for against in hub_sets if hub == to else []:
                        common = len(np.intersect1d(s, against, assume_unique=True))
                        found.append((1 - common / max(1, len(s) + len(against) - common), _linked(common, len(s), len(against), similar)))
                    if found:
                        rows.append((k, to, min(f[0] for f in found), any(f[1] for f in found)))
                if rows:
                    a, b, d, linked = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.float64()), pa.array(linked, pa.bool_())], ["a", "b", "distance", "linked"])

    return texts.mapInArrow(compare, "a long, b long, distance double, linked boolean")


def overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, as products of their incidence matrices over the tokens that both lists have."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    a, b = (np.concatenate(x) if x else np.zeros(0, dtype=np.uint64) for x in (left, right))
    both = np.intersect1d(a, b)
    if not len(both):
        return out.astype(np.int64)
    sides = []
    for sets, tokens in ((left, a), (right, b)):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(both, tokens), len(both) - 1)
        keep = both[at] == tokens
        order = np.argsort(at[keep], kind="stable")
        sides.append((owner[keep][order], at[keep][order]))
    for low in range(0, len(both), columns):
        width = min(columns, len(both) - low)
        made = []
        for (owner, at), sets in zip(sides, (left, right)):
            i, j = np.searchsorted(at, [low, low + width])
            x = np.zeros((len(sets), width), dtype=np.float32)
            x[owner[i:j], at[i:j] - low] = 1
            made.append(x)
        out += made[0] @ made[1].T
    return out.astype(np.int64)


def across(docs: DataFrame, members: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """Links (a, b) between members of one hub that are in different components.

    members: hub ``h``, document ``x``, its ``distance`` to the hub, its component ``p``, the hub's component ``hp``, its set's size ``n``; the
    hub itself is one of them.  A hub with few members is one block.  Members of a larger one are cut by whether they are in the hub's
    component, by band of distance, and by hash; two blocks meet if their bands may hold a link and their components differ.
    """
    total = members.groupBy("h").agg(F.count("*").alias("m"), F.sum("n").alias("s"), F.min("p").alias("p0"), F.max("p").alias("p1"))
    total = total.where((F.col("m") > 2) & (F.col("p0") < F.col("p1"))).select(F.col("h").alias("th"), ((F.col("m") <= BLOCK_DOCS) & (F.col("s") <= BLOCK_SHINGLES)).alias("small"))
    rows = members.join(total, F.col("h") == F.col("th")).select("h", "x", "p", "n", F.when(F.col("small"), 0).otherwise(F.when(F.col("p") == F.col("hp"), 0).otherwise(BANDS + 1) + F.floor(F.col("distance") * BANDS)).cast("int").alias("cell"))
    parts = rows.groupBy("h", "cell").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_DOCS)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int").alias("parts"), F.min("p").alias("p0"), F.max("p").alias("p1"))
    blocks = parts.select("h", "cell", "p0", "p1", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    block = F.struct("cell", "part")
    left = blocks.select("h", block.alias("i"), F.col("p0").alias("i0"), F.col("p1").alias("i1"))
    right = blocks.select(F.col("h").alias("h2"), block.alias("j"), F.col("p0").alias("j0"), F.col("p1").alias("j1"))
    band = lambda c: F.pmod(c, F.lit(BANDS + 1))
    reach = int(np.ceil((100 - similar) / 100 * BANDS)) + 1
    same = (F.col("i0") == F.col("i1")) & (F.col("j0") == F.col("j1")) & (F.col("i0") == F.col("j0"))
    meet = left.join(right, (F.col("h") == F.col("h2")) & (F.col("i") <= F.col("j")) & (F.abs(band(F.col("i.cell")) - band(F.col("j.cell"))) <= reach) & ~same).select("h", "i", "j")
    seats = meet.select("h", F.col("i").alias("block"), "i", "j", F.lit(0).alias("role")).unionByName(meet.where("i <> j").select("h", F.col("j").alias("block"), "i", "j", F.lit(1).alias("role")))
    placed = rows.join(parts.select(F.col("h").alias("ph"), F.col("cell").alias("pc"), "parts"), (F.col("h") == F.col("ph")) & (F.col("cell") == F.col("pc")))
    placed = placed.select("h", "x", "p", F.struct("cell", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int").alias("part")).alias("block"))
    seated = placed.join(seats.withColumnRenamed("h", "sh").withColumnRenamed("block", "sb"), (F.col("h") == F.col("sh")) & (F.col("block") == F.col("sb"))).select("h", "i", "j", "role", "x", "p")
    texts = docs.join(seated, F.col("k") == F.col("x")).select("h", F.concat_ws("-", "i.cell", "i.part", "j.cell", "j.part").alias("g"), "role", "k", "p", "t")
    texts = texts.repartition("h", "g").sortWithinPartitions("h", "g", "role", "k")

    def solve(held: list[tuple]) -> list[tuple[int, int]]:
        sides = [[r for r in held if r[0] == role] for role in (0, 1)]
        one = not sides[1]
        if one:
            sides[1] = sides[0]
        common = overlaps(*[[r[3] for r in side] for side in sides])
        (pa_, na), (pb, nb) = ((np.array([r[2] for r in side]), np.array([len(r[3]) for r in side])) for side in sides)
        hit = (100 * common >= similar * (na[:, None] + nb[None] - common)) & (common > 0) & (pa_[:, None] != pb[None])
        return [(sides[0][i][1], sides[1][j][1]) for i, j in zip(*np.nonzero(hit)) if not one or i < j]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def links() -> pa.RecordBatch | None:
            found = solve(held) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"]) if found else None

        for batch in batches:
            for part, raw in _byte_slices(batch, "t"):
                for h, g, role, k, p, s in zip(*(part[c].to_pylist() for c in ("h", "g", "role", "k", "p")), shingle_sets(raw)):
                    if (h, g) != group:
                        if out := links():
                            yield out
                        group, held = (h, g), []
                    held.append((role, k, p, s))
        if out := links():
            yield out

    return texts.mapInArrow(compare, "a long, b long")


def near_duplicates(df: DataFrame, similar: int = SIMILAR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``n_shingles``, ``component_id`` of every row of ``df``: the smallest key that links lead to, its own included.

    Two documents link when 100 * intersection >= ``similar`` * union of their sets of 5-word shingles; ``similar`` is a whole number from 20 to 100.
    Null and empty texts, and texts of white space, have no shingles and no links; texts of any length are read whole.  Equal sets are one
    class, of which only the smallest key is compared.  Rows that share a key are one document with all their links.  A null key takes no
    part: its component is null.  An empty table gives no rows; other columns are ignored, whatever their names.  Keys are whole numbers.
    """
    if not 20 <= similar <= 100 or similar != int(similar):
        raise ValueError("similar is a whole number from 20 to 100")
    spark = df.sparkSession
    work = Workspace(spark, "ngramjoin", few_files=True)
    raw = df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").cast("binary").alias("t"))
    rows = raw.count()
    bits = min(SKETCH_BITS[1], max(SKETCH_BITS[0], int(SKETCH_PER_DOC * rows).bit_length()))
    described = work.table(_describe(raw, bits))
    info = described.where(F.col("slice").isNull()).select("k", "n", "f")
    sketch = _sketch(described.where(F.col("slice").isNotNull()), bits)

    with_key = raw.where(F.col("k").isNotNull() & (F.length("t") > 0))
    filled = info.where(F.col("k").isNotNull() & (F.col("n") > 0))
    classes = work.table(filled.groupBy("f").agg(F.min("k").alias("c"), F.first("n").alias("n")))  # a table, so that the join below can split a hot class
    members = work.table(filled.select("k", "f").join(classes, "f").select("k", "c", "n").distinct())

    rep = lambda k, c: members.select(F.col("k").alias(k), F.col("c").alias(c))
    postings = work.table(_postings(with_key, sketch, bits, similar))
    star = heads_of(postings).where("k != head").distinct()
    star = star.join(rep("k1", "a"), F.col("k") == F.col("k1")).join(rep("k2", "b"), F.col("head") == F.col("k2"))
    star = work.table(star.where("a != b").select("a", "b").distinct())
    work.drop(postings)
    near = work.table(measured(with_key, star, similar))
    several = members.groupBy("k").agg(F.min("c").alias("b"), F.count("*").alias("m")).where("m > 1").select(F.col("k").alias("k1"), "b")
    same_key = members.join(several, F.col("k") == F.col("k1")).select(F.col("c").alias("a"), "b")
    links = work.table(near.where("linked").select("a", "b").unionByName(members.select(F.col("k").alias("a"), F.col("c").alias("b"))).unionByName(same_key).where("a != b"))
    early = components(links, work)

    part = lambda node, name: early.select(F.col("node").alias(node), F.col("component").alias(name))
    size = members.where("k = c").groupBy("c").agg(F.max("n").alias("n"))
    hubs = near.select(F.col("b").alias("x")).distinct()
    around = near.select(F.col("b").alias("h"), F.col("a").alias("x"), "distance").unionByName(hubs.select(F.col("x").alias("h"), "x", F.lit(0.0).alias("distance")))
    around = around.join(part("n1", "p1"), F.col("x") == F.col("n1"), "left").join(part("n2", "p2"), F.col("h") == F.col("n2"), "left").join(size, F.col("x") == F.col("c"))
    around = work.table(around.select("h", "x", "distance", F.coalesce("p1", "x").alias("p"), F.coalesce("p2", "h").alias("hp"), "n"))
    more = work.table(across(with_key, around, similar))
    labels = early
    if more.limit(1).count():
        labels = components(links.unionByName(more).unionByName(early.select(F.col("node").alias("a"), F.col("component").alias("b"))), work)
    out = info.join(labels, F.col("k") == F.col("node"), "left").select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("k").isNotNull(), F.coalesce("component", "k")).alias("component_id"))
    made = work.table(out)
    work.drop(described, classes, star, near, links, around, more, members, early, labels)
    return made
