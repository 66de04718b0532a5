"""Each operator against a brute-force version, an exact round trip or held-out accuracy; and on odd tables."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe, chat, html, html_pages, langid, linededup, merkle, ngramjoin, packing, quality, topk
from corpusloom.llm.components import components
from corpusloom.llm.queries import tokenizer_file
from corpusloom.llm.workspace import Workspace

BYTE, WORD = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("word_bpe_49k.json")
ODD = [None, "", "  ", "\x1c a\x1db \x85 x\xa0y", "²³ ½ 1²", "İstanbul ΣΑΣ ẞ ſ Ǆ ǅ", "áë Å", "日本語 テスト 🙂👍🏽 it's we'LL", "<|endoftext|> a <|startoftext|>b<|endoftext|>", "x" * 3000, "é" * 500, "a\nb\n\n\tc. d! e?", "tab\t\n\r\x0b\x0c end  ", "!!!???...---" * 40]


def docs(spark, texts, extra=""):
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def noise(rng, n=200):
    kinds = [lambda: rng.randrange(32, 127), lambda: rng.randrange(0x250), lambda: rng.randrange(0x250, 0x3000), lambda: rng.randrange(0x1F300, 0x1F700)]
    return ["".join(chr(rng.choice(kinds)()) for _ in range(rng.randrange(60))) for _ in range(n)]


# ---- 8: BPE -----------------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    texts = ODD + noise(random.Random(1))
    lib = Tokenizer.from_file(WORD)
    got = {r.doc_id: r for r in bpe.encode_texts(docs(spark, texts), WORD).collect()}
    for k, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[k].ids == ids and got[k].decoded == lib.decode(ids, skip_special_tokens=False)


def test_byte_codec_equals_the_library():
    from tokenizers import Tokenizer

    texts = ODD + noise(random.Random(2))
    lib, codec = Tokenizer.from_file(BYTE), bpe.byte_codec(BYTE)
    for t, got in zip(texts, codec.encode_many(texts)):
        ids = np.frombuffer(got, dtype="<u4").tolist()
        assert ids == lib.encode(t or "", add_special_tokens=False).ids
        assert codec.decode_bytes(ids).decode() == (t or "")


def words_of_syllables(rng, n):
    syllables = ["ing", "tion", "the", "er", "ä", "ß", "que", "ment", "sch", "ó", "an", "wh", "eau", "ly"]
    return " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 6))) for _ in range(n))


def test_columns_of_texts_equal_the_library(monkeypatch):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    signs = ["'s", "'re", "'ll", "'l", "'ve", "'d", "'t", "'m", "'", "''", " ", "  ", "\n", "\t", "\xa0", "\x85", "\x1c", "a", "Zs", "é", "ĳ", "²", "12", "½", ".", "-", "ȿ", "ɀ", "ɐ", "’", "日", "<|"]
    mixed = ["".join(rng.choices(signs, k=rng.randrange(12))) for _ in range(5000)]
    texts = [*ODD, *noise(rng), *mixed, *(words_of_syllables(rng, 300) for _ in range(20))]
    lib, codec = Tokenizer.from_file(BYTE), bpe.ByteCodec(BYTE)
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    for size, memo in ((bpe.BATCH_CHARS, bpe.MEMO), (40, bpe.MEMO), (400, 50)):
        monkeypatch.setattr(bpe, "BATCH_CHARS", size)
        monkeypatch.setattr(bpe, "MEMO", memo)
        for column in (pa.array(["before", *texts, "behind"]).slice(1, len(texts)), pa.array(texts, pa.large_string())):
            ids, counts = codec.encode_column(column)
            assert counts.tolist() == [*map(len, want)]
            assert ids.tolist() == [i for w in want for i in w]
    assert [len(x) for x in codec.encode_column(pa.array([], pa.string()))] == [0, 0]


def test_plain_columns_are_not_encoded_word_by_word(monkeypatch):
    codec = bpe.ByteCodec(BYTE)
    texts = [words_of_syllables(random.Random(7), 2000), "it's a plain\ntext, of 1990", None]
    want = codec.encode_many(texts)
    monkeypatch.setattr(bpe, "Merger", None)
    monkeypatch.setattr(bpe.ByteCodec, "encode_many", None)
    ids, counts = (again := bpe.ByteCodec(BYTE)).encode_column(pa.array(texts))
    assert ids.tobytes() == b"".join(want) and counts.tolist() == [len(w) // 4 for w in want]
    assert again.known and not again.words


def test_no_merge_crosses_a_cut():
    codec = bpe.word_codec(WORD)
    assert any(len(codec.fragments(w)) > 1 for w in ("qzxqj", "zqx", "xqzwv"))
    for w in ("qzxqj", "thetion", "été"):
        assert "".join(codec.fragments(w))[:-1] == "".join(codec.symbols[b] for b in w.encode())[:-1]


# ---- 7: packing --------------------------------------------------------------------------------------------------------


def padding(n, window):
    return 0 if n & (n - 1) == 0 else window - n


def test_cuts_are_the_cheapest():
    rng = random.Random(0)
    for _ in range(200):
        window, n = rng.choice([4, 8, 16]), rng.randrange(1, 8)
        places = np.cumsum([0] + [rng.randrange(1, window + 1) for _ in range(n)])
        penalty = np.array([0.0] + [rng.choice([0, 1, 3, 6]) for _ in range(n)])
        each = rng.choice([0.0, 1.0, 2.5])
        cost = lambda cs: sum(padding(places[b] - places[a], window) + penalty[b] + each for a, b in zip(cs, cs[1:]))  # noqa: B023, E731
        every = ([0, *m, n] for r in range(n) for m in itertools.combinations(range(1, n), r))
        best = min(cost(c) for c in every if all(places[b] - places[a] <= window for a, b in zip(c, c[1:])))
        assert cost(packing.best_cuts(places, penalty, window, each)) == pytest.approx(best)


def test_pieces_hold_every_id_once(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTE)
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice(["the", "cat", "sat.", "On", "mat!\n"]) for _ in range(rng.randrange(900))) for _ in range(60)]
    rows = packing.pack_documents(docs(spark, texts), BYTE, window=128).collect()
    ids = {k: [*lib.encode(t or "", add_special_tokens=False).ids, 0] for k, t in enumerate(texts)}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for k, want in ids.items():
        parts = sorted(by_doc[k], key=lambda r: r.start)
        assert [i for p in parts for i in np.frombuffer(p.token_bytes, "<u4").tolist()] == want
        assert {p.doc_tokens for p in parts} == {len(want)}
    pad = total = 0
    for parts in by_seq.values():
        parts.sort(key=lambda r: r.offset)
        at = 0
        for p in parts:
            assert p.offset == at
            at += p.length
        assert at <= 128
        pad, total = pad + padding(at, 128), total + at
    assert pad < 0.05 * total


def test_blocks_end_with_the_document_that_fills_them(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 500)
    rng = random.Random(8)
    texts = [None, *(words_of_syllables(rng, rng.choice([1, 30, 700])) for _ in range(60)), "日本 end"]
    codec = bpe.byte_codec(BYTE)
    blocks, block = [], []
    for k, ids in enumerate(codec.encode_many(texts)):
        block.append((k, [*np.frombuffer(ids, "<u4").tolist(), 0]))
        if sum(len(x) for _, x in block) >= 500 or k == len(texts) - 1:
            blocks.append(block)
            block = []
    want, before = set(), 0
    for block in blocks:
        ids = np.array([i for _, x in block for i in x])
        cuts = packing.plan(np.array([len(x) for _, x in block]), ids, packing._Ends(codec, 0), 128).tolist()
        at = 0
        for k, x in block:
            edges = sorted({at, at + len(x), *(c for c in cuts if at < c < at + len(x))})
            for a, b in zip(edges, edges[1:]):
                s = max(i for i, c in enumerate(cuts) if c <= a)
                want.add((k, a - at, b - a, ids[a:b].astype("<u4").tobytes(), len(x), before + s, a - cuts[s]))
            at += len(x)
        before += len(cuts) - 1
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        rows = packing.pack_documents(docs(spark, texts), BYTE, window=128).select("doc_id", "start", "length", "token_bytes", "doc_tokens", "sequence_id", "offset").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert len(blocks) > 5 and len(rows) == len(want)
    assert {(*r[:3], bytes(r[3]), *r[4:]) for r in rows} == want


# ---- 3: chat -----------------------------------------------------------------------------------------------------------


def test_chat_reads_back_what_went_in(spark):
    said = r"\### Assistant: </turn> ok"
    rng = random.Random(4)
    pool = [*ODD, said, "### a: b</turn>", "\\\\###", "<|endoftext|>", *noise(rng, 30)]
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (5, 0, None, None), (6, 0, "assistant", "a"), (6, 0, "assistant", "a")]
    rows += [(c, t, rng.choice(["user", "assistant", "system", "we:ird\\"]), rng.choice(pool)) for c in range(10, 14) for t in range(rng.randrange(1, 30))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(df.repartition(3), BYTE)
    got = {r.conv_id: r for r in chat.read_back(made, BYTE).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        learnt = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        shown = sum(len(chat.OPEN + chat.escape(r[2] or "", True) + chat.ROLE_END + chat.escape(r[3] or "") + chat.TURN_END) for r in turns)
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert got[c].formatted_chars == shown
    texts = {r.conv_id: r.formatted for r in chat.rendered(made.where("conv_id = -7"), BYTE).collect()}
    assert texts[-7] == r"### user: \\\### Assistant: \</turn> ok</turn>" + "\n" + r"### assistant: \\\### Assistant: \</turn> ok</turn>" + "\n"


def test_long_conversations_go_on_in_another_row(spark, monkeypatch):
    rows = [(1, k, "assistant" if k % 2 else "user", f"word{k} " * 9000) for k in range(20)]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), BYTE)
    assert made.count() > 1
    learnt, whole = "".join(r[3] for r in rows if r[1] % 2), "".join(f"{r[2]}\n{r[3]}\n" for r in rows)
    got = chat.read_back(made, BYTE).first()
    assert (got.loss_chars, got.loss_sha256, got.turns_sha256, got.n_turns) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), hashlib.sha256(whole.encode()).hexdigest(), 20)


# ---- 10: n-gram join -----------------------------------------------------------------------------------------------------


def brute_components(rows, similar=75):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    found = []
    for k, t in rows:
        w = (t or "").encode().translate(lower).split()
        found.append((k, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    up = {k: k for k, _ in found}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, s), (b, t) in itertools.combinations(found, 2):
        if s and t and 100 * len(s & t) >= similar * len(s | t):
            p, q = top(a), top(b)
            up[max(p, q)] = min(p, q)
    return sorted((k, len(s), top(k)) for k, s in found)


@pytest.mark.parametrize("above, times, similar, hot", [(48, 3, 75, 8192), (-1000, 0.0, 75, 0), (0, 1.0, 75, 12), (-1000, 0.0, 50, 8192), (0, 1.0, 60, 0), (48, 3, 60, 8192), (0, 1.0, 90, 5), (-1000, 0.0, 20, 0), (48, 3, 100, 8192)])
def test_components_equal_brute_force(spark, monkeypatch, above, times, similar, hot):
    monkeypatch.setattr(ngramjoin, "FREQUENT_ABOVE", above)
    monkeypatch.setattr(ngramjoin, "FREQUENT_TIMES", times)
    monkeypatch.setattr(ngramjoin, "HOT_FROM", hot)
    rng = random.Random(5 + similar)
    vocab = [f"w{k}" for k in range(40)]
    base = [[rng.choice(vocab) for _ in range(rng.randrange(60))] for _ in range(20)]
    common = [rng.choice(vocab) for _ in range(30)]
    rows = []
    for i in range(220):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            if w:
                w[rng.randrange(len(w))] = rng.choice(vocab)
        if rng.random() < 0.5:
            w = common[: rng.randrange(30)] + w[: rng.randrange(1, 12)]
        rows.append((i if rng.random() < 0.97 else max(0, i - 1), " ".join(w).upper() if rng.random() < 0.3 else " ".join(w) if rng.random() < 0.97 else None))
    rows += [(300, "a b c d e f"), (301, "a b c d e f g"), (302, "a b c d e f g h"), (303, "a b c d e")]  # sets of two, three, four and one
    got = ngramjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), similar).collect()
    assert sorted(map(tuple, got)) == brute_components(rows, similar)


@pytest.mark.parametrize("similar", [0, 19, 101, 75.5])
def test_thresholds_that_the_join_does_not_take(spark, similar):
    with pytest.raises(ValueError, match="20 to 100"):
        ngramjoin.near_duplicates(docs(spark, ["a"]), similar)


def test_workspaces_keep_results_only(spark, tmp_path, monkeypatch):
    from corpusloom.llm import workspace

    monkeypatch.setattr(workspace, "shared_folder", lambda _: f"file://{tmp_path}")
    made = [ngramjoin.near_duplicates(docs(spark, ["a b c d e f g h"] * 3 + ["x"])), topk.top_k(spark.createDataFrame([(k, [1.0 * k]) for k in range(60)], "vec_id long, embedding array<double>"))]
    left = [d.name for folder in tmp_path.iterdir() for d in folder.iterdir()]
    assert len(left) == 2 and [m.count() for m in made] == [4, 10]


def test_a_cluster_names_the_shared_folder():
    from corpusloom.llm.workspace import shared_folder

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session)


def test_shingles_of_short_and_blank_texts():
    sizes = [len(s) for s in ngramjoin.shingle_sets([None, b"", b" \t\n", b"a", b"a b c d", b"a b c d e", b"a b c d e a b c d e"])]
    assert sizes == [0, 0, 0, 1, 1, 1, 5]
    one, two = ngramjoin.shingle_sets([b"A b\xc3\x84 c d e", b"a  b\xc3\x84\tc d E"])
    assert one.tolist() == two.tolist()
    assert ngramjoin.shingle_sets([b"a b"])[0].tolist() != ngramjoin.shingle_sets([b"ab"])[0].tolist()


def test_components_of_odd_links(spark):
    df = spark.createDataFrame([(1, 1, "x"), (None, 2, "y"), (3, None, "z")], "a long, b long, node string")
    assert components(df, Workspace(spark, "t")).count() == components(df.where("false"), Workspace(spark, "t")).count() == 0


def test_connected_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 130)]
    up = {}
    for a, b in links:
        up.setdefault(a, {a}).add(b), up.setdefault(b, {b}).add(a)
    seen, want = set(), {}
    for k in up:
        if k not in seen:
            todo, part = [k], set()
            while todo:
                x = todo.pop()
                if x not in part:
                    part.add(x)
                    todo += up[x]
            seen |= part
            want |= {x: min(part) for x in part if len(part) > 1}
    got = components(spark.createDataFrame(links, "a long, b long"), Workspace(spark, "t"))
    assert {r.node: r.component for r in got.collect()} == want


# ---- 6: top-k --------------------------------------------------------------------------------------------------------------


def brute_top(rows, step=50, k=5):
    """Best candidates by plain sums; rows of (key, integers), a query being the smallest vector of its key and length."""
    asked = {}
    for i, v in rows:
        if i % step == 0:
            asked[i, len(v)] = min(asked.get((i, len(v)), v), v)
    out = {}
    for (i, n), q in asked.items():
        out.setdefault(i, []).extend((-sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i and len(v) == n)
    return sorted((i, n, j, -s) for i, found in out.items() for n, (s, j) in enumerate(sorted(found)[:k], 1))


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 4)
    monkeypatch.setattr(topk, "RANGE", 3)
    monkeypatch.setattr(topk, "SUMMARY", 2)
    monkeypatch.setattr(topk, "QUERIES", 2)
    rng = random.Random(7)
    rows = [(k, [rng.choice([-1.0, 0.0, 0.5, rng.random()]) for _ in range(8)]) for k in range(200)]
    rows += [(50, [0.25] * 8), (3, [1.0] * 8), (3, [1.0] * 8), (3, [1.0] * 8), (7, [1.0] * 8), (100, [0.5, 1.0]), (101, [2.0, 2.0]), (102, [])]
    odd = [(300, None), (301, [float("nan")] * 8), (302, [None] * 8), (303, [1.0]), (None, [1.0] * 8), (304, [float("inf")] * 8)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("v", F.lit(1)).withColumn("dim", F.lit(2)).repartition(5)
    got = [tuple(r) for r in topk.top_k(df).collect()]
    ints = [(k, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for k, v in rows]
    assert sorted(got) == brute_top(ints)


def test_top_k_of_far_ids_and_large_numbers(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (2**60, [9.0, 9.0]), (-(2**62), [8.0, 8.0]), (2**63 - 1, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df).collect()]
    assert sorted(got) == brute_top([(k, [int(256 * x) for x in v]) for k, v in rows]) and (0, 1, 2**60, 256 * 256 * 9) in got
    for size in (2.0**20, 2.0**22, 2.0**24, 2.0**40):  # sums within 53 bits, within 63, beyond
        rows = [(k, [size * (1 + k % 7), -size * (k % 5), size + k]) for k in range(60)]
        want = [(q, r, v, min(max(s, -(2**63)), 2**63 - 1)) for q, r, v, s in brute_top([(k, [int(256 * x) for x in v]) for k, v in rows])]
        assert sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()) == want
    assert topk.top_k(spark.createDataFrame([(1, [1.0]), (3, [2.0])], "vec_id long, embedding array<double>")).count() == 0


@pytest.mark.parametrize("scale", [1, 1 << 24, 1 << 34])
def test_blocks_are_left_out_and_nothing_is_lost(scale):
    rng = np.random.default_rng(8)
    v = rng.integers(-50, 50, (700, 6)) * scale
    v[:20] *= 3  # what is large stands together
    q = rng.integers(-50, 50, (9, 6)) * scale
    for start in (None, [int(sorted((v @ q[k]).tolist())[-4]) if scale < 1 << 30 else -(1 << 90) for k in range(9)]):
        visits = []
        who, ids, score = topk.top_in_blocks(q, np.arange(-9, 0), v, np.arange(700), 4, block=10, start=start, visits=visits)
        for k in range(9):
            s = [sum(int(a) * int(b) for a, b in zip(x, q[k])) for x in v]
            want = sorted((-a, j) for j, a in enumerate(s))[:4]
            assert [(-a, int(b)) for w, a, b in zip(who, score, ids) if w == k] == want
        assert not visits or visits[0][0] < 0.7 * visits[0][1]


# ---- 4: fingerprints ---------------------------------------------------------------------------------------------------------


DENSE = ((0x4E00, 0x9FFF), (0x3040, 0x30FF), (0x0E00, 0x0EFF))


def runs_of(text):
    """All runs of three units of a text's lines, sign by sign."""
    white, out = " \t\x0b\f\r", set()
    single = lambda c: any(a <= ord(c) <= b for a, b in DENSE) or ord(c) < 33
    past = lambda p, j: j + len(p[j:]) - len(p[j:].lstrip(white))
    for p in text.split("\n"):
        units, i = [], 0
        while i < len(p):
            j = i
            while j < len(p) and p[j] not in white and not single(p[j]):
                j += 1
            if p[i] in white:
                end = j = past(p, i)
            elif 0 < j - i <= 64:
                end = j = past(p, j)
            else:
                end = j = past(p, i + 1)
                for _ in range(7):
                    end = past(p, end + 1) if end < len(p) else end
            units.append(p[i:end])
            i = j
        out |= {tuple(units[k : k + 3]) for k in range(len(units))}
    return out


def dice(a, b):
    x, y = runs_of(a), runs_of(b)
    return 1.0 if a == b else 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BUCKET_ROWS", 3)
    rng = random.Random(9)
    line = lambda: " ".join(rng.choice(["ab", "cde", "f", "ghij.", "x" * 70, "日本語", " "]) for _ in range(rng.randrange(12)))
    texts = ["\n".join(line() for _ in range(rng.randrange(1, 9))) for _ in range(30)] + ["", None, "é🙂" * 20]
    keys = [k * 37 - 100 for k in range(len(texts) - 2)] + [2**62, -(2**63)]
    df = spark.createDataFrame(list(zip(keys, texts)), "doc_id long, text string").withColumn("k", F.lit("x")).withColumn("t", F.lit(1)).withColumn("__b", F.lit(1)).repartition(4)
    got = {r.doc_id: r for r in merkle.compare_with_edits(df).collect()}
    order = sorted(zip(keys, texts), reverse=True)
    for (k, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + nxt[:m]
        assert (got[k].n_chars, got[k].edited) == (len(t), edited)
        assert (got[k].fingerprint == got[k].edited_fingerprint) == (t == edited) and len(got[k].fingerprint) <= 750
        if max(map(len, map(runs_of, (t, edited, nxt)))) < merkle.SKETCH:
            assert got[k].near_edited == pytest.approx(dice(t, edited), abs=1e-6) and got[k].near_next == pytest.approx(dice(t, nxt), abs=1e-6)
    same = {r.fingerprint for r in merkle.fingerprints(docs(spark, ["a\nb", "a\nb", "a\n b", "a\nb "])).collect()}
    assert len(same) == 3


@pytest.mark.parametrize("keys", ["far", "one", "some"])
def test_neighbours_of_skewed_keys(spark, monkeypatch, keys):
    monkeypatch.setattr(merkle, "BUCKET_ROWS", 10)
    rng = random.Random(2)
    ids = {"far": [*range(200), 2**61, -(2**61)], "one": [5] * 150 + [None] * 5 + [*range(30)], "some": [k // 60 for k in range(300)]}[keys]
    rows = [(k, f"t{j} {rng.random()}") for j, k in enumerate(ids)]
    df = spark.createDataFrame(rows, "k long, t string")
    dealt, _ = merkle.among_neighbours(df, "k", "t")
    sizes = [r["count"] for r in dealt.where("__late = 0").groupBy("__b").count().collect()]
    assert max(sizes) <= 45 and sum(sizes) == len(rows) and len(sizes) >= len(rows) / 45
    tie = {r.t: r.h for r in df.select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[1]], r[1]))
    got = {r.edited: r for r in merkle.compare_with_edits(df.withColumnsRenamed({"k": "doc_id", "t": "text"})).collect()}
    for (_, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        assert t[: len(t) - len(t) // 3] + nxt[: len(t) // 3] in got


def test_edits_are_located(spark):
    lines = [f"line {k} of the text" for k in range(41)]
    changes = [
        (lines, lines, []),
        (lines, [*lines[:20], "put in", *lines[20:]], [20]),
        (lines, ["first", *lines], [0]),
        (lines, [*lines, "last"], [41]),
        (lines, [*lines[:5], *lines[6:]], []),
        (lines, [*lines[:5], "other", *lines[6:]], [5]),
        (lines, [*lines[:5], "a", *lines[6:30], "b", "c", *lines[30:]], [5, 30, 31]),
        (lines, [*lines[:8], lines[7], *lines[8:]], [8]),
        ([""], ["a", "b"], [0, 1]),
        (["x"] * 9, ["x"] * 12, [9, 10, 11]),
    ]
    df = spark.createDataFrame([(k, "\n".join(a), "\n".join(b)) for k, (a, b, _) in enumerate(changes)], "k int, a string, b string")
    both = merkle.with_tree(merkle.with_tree(df, "a", "a_"), "b", "b_").orderBy("k")
    assert [r[0] for r in both.select(merkle.differing_paragraphs(F.col("a_sections"), F.col("b_sections"))).collect()] == [want for _, _, want in changes]
    of = lambda s: [n for x in s for n in x.paragraphs]
    for r, (a, b, _) in zip(both.collect(), changes):
        assert len(of(r.a_sections)) == len(a) and [x["first"] for x in r.b_sections][0] == 0 and (r.a_root == r.b_root) == (a == b)


def test_likeness_of_long_texts_is_near_the_exact_one(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(5000)}" for _ in range(4000)]
    texts = [" ".join(words)] + [" ".join(w if rng.random() > share else f"v{rng.randrange(5000)}" for w in words) for share in (0.01, 0.1, 0.3)] + [" ".join(words[:k]) for k in (3000, 100, 40)]
    df = spark.createDataFrame([(k, texts[0], t) for k, t in enumerate(texts)], "k int, a string, b string")
    both = merkle.with_tree(merkle.with_tree(df, "a", "a_"), "b", "b_").orderBy("k").select(merkle.likeness("a_", "b_").alias("n"), merkle.fingerprint_likeness(merkle.fingerprint("a_"), merkle.fingerprint("b_")).alias("m")).collect()
    for r, t in zip(both, texts):
        assert r.n == r.m and r.n == pytest.approx(dice(texts[0], t), abs=0.12)
    assert both[0].n == 1


def marked_alike(spark, pairs):
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k long, a string, b string")
    both = merkle.with_tree(merkle.with_tree(df, "a", "a_"), "b", "b_")
    return [r[0] for r in both.orderBy("k").select(merkle.likeness("a_", "b_")).collect()]


def test_likeness_does_not_depend_on_a_size(spark):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60))
    cuts = [(text[:n], text[: n * 3 // 4]) for n in range(228, 354, 6)]
    assert all(len(a) < 256 or len(b) < 256 for a, b in cuts[:3]) and any(len(a) >= 256 > len(b) for a, b in cuts)
    got = marked_alike(spark, cuts)
    assert min(got) > 0.75 and max(got) - min(got) < 0.1


def test_marks_realign_after_an_insertion(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    words = [word() for _ in range(200)]
    texts = [" ".join(words), " ".join(w + "$$$" for w in words), "\n".join(words), "".join(words), "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(400)), "。".join("".join(chr(rng.randrange(0x3041, 0x3090)) for _ in range(30)) for _ in range(12))]
    assert min(marked_alike(spark, [(t, "new " + t) for t in texts])) > 0.9
    assert min(marked_alike(spark, [(t, t[:1] + t[2:]) for t in texts])) > 0.9
    assert min(marked_alike(spark, [(t, t[: len(t) // 2] + "字 x" + t[len(t) // 2 :]) for t in texts])) > 0.9
    assert max(marked_alike(spark, [(a, b) for a, b in itertools.combinations(texts[:1] + texts[4:], 2)])) < 0.1


# ---- 5, 9: models -------------------------------------------------------------------------------------------------------------


def test_language_on_held_out_documents(spark, tables):
    from corpusloom.llm.queries import op5_language_id

    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "lang").collect()}
    got = op5_language_id(spark, tables).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97


def test_language_of_odd_texts(spark):
    model = langid.fit([("the cat and the dog", "en"), ("le chat et le chien", "fr")])
    texts = [None, "", "123 !!", "²", "le chat", "x" * 100_000, "the the"]
    df = docs(spark, texts).withColumn("Score", F.lit("old")).withColumn("lang_pred", F.lit("old")).withColumn("k", F.lit(0)).withColumn("t", F.lit(0))
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert [got[k].lang_pred for k in range(4)] == ["und"] * 4 and got[4].lang_pred == "fr" and got[6].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = langid.LanguageModel([], np.zeros((langid.BUCKETS, 0), dtype=np.float32))
    assert {r.lang_pred for r in langid.predict(df, nothing).collect()} == {"und"}


def test_every_language_is_learnt(spark):
    rows = [(k, "ab cd " * 5, f"l{k:03}") for k in range(230)] + [(300, "long words " * 3000, "long"), (301, "", "none"), (302, "short", "both"), (303, "x" * 30_000, "both")]
    got = langid.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(False))
    assert {y for _, y in got} == {y for _, _, y in rows} - {"none"}
    assert {y: len(t) for t, y in got if y in ("long", "both")} == {"long": langid.SAMPLE_CHARS, "both": 5}


def plain_letters(t):
    return " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "


def plain_bucket(gram):
    """The hash of an n-gram in whole numbers."""
    h = ord(gram[0])
    for c in gram[1:]:
        h = (h * 0x01000193 % 2**32) ^ ord(c)
    h = (h ^ (len(gram) * 0x9E37)) * 0x9E3779B1 % 2**32
    h = (h ^ (h >> 15)) * 0x85EBCA77 % 2**32
    return h >> 16


def test_bayes_equals_plain_counting(spark):
    """Naive Bayes again, with dictionaries and logarithms, one n-gram after the other."""
    from collections import Counter
    from math import exp, log

    learnt = [("the cat and the dog, THE END", "en"), ("le chat et le chien", "fr"), ("l'été à la plage", "fr"), ("кот и собака", "ru"), ("猫と犬がいます。", "ja"), ("the 1 other", "en")]
    grams = lambda t: [w[i : i + n] for w in (plain_letters(t),) for n in langid.GRAMS for i in range(len(w) - n + 1)]
    counts = {lang: Counter(plain_bucket(g) for t, y in learnt if y == lang for g in grams(t)) for lang in ("en", "fr", "ja", "ru")}
    texts = ["a", "le chat", "the dog and", "zz", "ÉTÉ!", "собаки", "犬", "İ\0x", "猫 the", "ẞ ſ 😀 q", "word " * 50]
    got = {r.doc_id: r for r in langid.predict(docs(spark, texts), langid.fit(learnt)).collect()}
    for k, t in enumerate(texts):
        sums = {lang: sum(log((c[plain_bucket(g)] + 1) / (c.total() + langid.BUCKETS)) for g in grams(t)) for lang, c in counts.items()}
        best = max(sums, key=sums.get)
        assert got[k].lang_pred == best and got[k].score == pytest.approx(1 / sum(exp(s - sums[best]) for s in sums.values()), abs=1e-3)


def test_batches_do_not_change_language_sums():
    model = langid.fit([("the cat and the dog", "en"), ("le chat et le chien", "fr")])
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é\0日.  \n1İ") for _ in range(rng.randrange(12))) for _ in range(60)]
    letters, edges = langid.normal_letters(texts)
    shown = ["".join(map(chr, letters[a:b])) for a, b in itertools.pairwise(edges.tolist())]
    assert [x.strip() for x in shown] == [plain_letters(t).strip() for t in texts] and all(x == plain_letters(t) for x, t in zip(shown, texts) if x.strip())
    assert np.allclose(langid.totals(texts, model.weights), np.concatenate([langid.totals([t], model.weights) for t in texts]), atol=1e-3)


def test_quality_on_held_out_documents(spark):
    from corpusloom.llm.queries import op9_quality

    tables = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{tables}/labels.parquet").collect()}
    got = op9_quality(spark, tables).collect()
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and np.mean([labels[r.doc_id] == r.predicted for r in held]) > 0.95
    assert all(r.predicted == int(r.score >= quality.THRESHOLD) for r in got)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(10)
    chain = rng.normal(size=(2, 2))
    scores = [rng.normal(size=n) for n in (1, 4, 3)]
    got, expected, z = quality.marginals(scores, chain)
    count, total = np.zeros((2, 2)), 0.0
    for s, g in zip(scores, got):
        paths = list(itertools.product((0, 1), repeat=len(s)))
        weight = np.exp([sum(s[i] * y for i, y in enumerate(p)) + sum(chain[a, b] for a, b in zip(p, p[1:])) for p in paths])
        total += np.log(weight.sum())
        chance = weight / weight.sum()
        assert np.allclose(g, [sum(c for c, p in zip(chance, paths) if p[i]) for i in range(len(s))])
        for c, p in zip(chance, paths):
            for a, b in zip(p, p[1:]):
                count[a, b] += c
    assert np.allclose(expected, count) and z == pytest.approx(total)


def test_document_scores_equal_enumeration():
    """Every labelling of every line, from features that are put together one by one."""
    import re
    from math import exp

    good, junk = "a good line of words, and so on.", "X!! YY!! ZZZ!!"
    rng = random.Random(1)
    said = lambda: " ".join(rng.choice("one two three four five six seven".split()) for _ in range(rng.randrange(3, 12))) + "."
    shout = lambda: " ".join(rng.choice(["X!!", "YY!!", "ZZZ!!"]) for _ in range(rng.randrange(3, 12)))
    learnt = [("\n".join([good, *(said() for _ in range(rng.randrange(4)))]), 1) for _ in range(20)] + [("\n".join([good, said(), *(shout() for _ in range(rng.randrange(1, 5)))]), 0) for _ in range(20)]
    field = quality.fit(learnt, 80, 60)
    sure = {}
    for text in ["", good, junk, f"{good}\n{junk}", f"{junk}\n\n{good}\n{good}", "$$$ new\nwords", f"{good}\n" * 4 + junk]:
        lines = text.split("\n")
        own = quality.line_features(lines).astype(float)
        rows = []
        for k, line in enumerate(lines):
            near = [own[j] if 0 <= j < len(lines) else np.zeros(own.shape[1]) for j in (k - 1, k + 1)]
            dense = [1.0, *own[k], *(float(own[k][j] > 0.15) for j in (2, 3, 8)), *near[0], *near[1]]
            tokens = [zlib.crc32(t.encode()) % quality.BUCKETS for t in re.findall(r"\w+|[^\w\s]+", line.lower())]
            rows.append(sum(a * b for a, b in zip(dense, field.weights)) + (sum(field.weights[quality.N_DENSE + t] for t in tokens) / len(tokens) if tokens else 0))
        weight = {p: exp(sum(r * y for r, y in zip(rows, p)) + sum(field.chain[a, b] for a, b in itertools.pairwise(p))) for p in itertools.product((0, 1), repeat=len(lines))}
        marginal = [sum(w for p, w in weight.items() if p[k]) / sum(weight.values()) for k in range(len(lines))]
        long = [max(1, len(x)) for x in lines]
        share = sum(m * n for m, n in zip(marginal, long)) / sum(long)
        want = 1 / (1 + exp(-(field.curve[0] + field.curve[1] * (share - 0.5))))
        assert quality.score_texts([text], field)[0] == pytest.approx(want, abs=1e-4)
        sure[text] = marginal
    mixed = sure[f"{good}\n" * 4 + junk]
    assert min(mixed[:3]) > 0.5 > mixed[4]  # lines of one document have labels of their own


def test_quality_of_odd_texts(spark):
    field = quality.fit([("a good line of words here.\nand one more.", 1), ("X!! Y!! Z!!", 0)] * 5, 20, 20)
    got = quality.score_quality(docs(spark, [*ODD, "w " * 60_000]), field).collect()
    assert len(got) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in got)
    assert quality.fit([], 1).weights.shape == (quality.N_FEATURES,)


# ---- 1: HTML -------------------------------------------------------------------------------------------------------------------


def test_messages_equal_enumeration():
    rng = np.random.default_rng(11)
    parent = np.array([-1, 0, 0, 1, 1, -1, 5])
    scores, pair = rng.normal(size=7), rng.normal(size=(2, 2))
    paths = np.array(list(itertools.product((0, 1), repeat=7)))
    weight = np.exp([sum(scores * p) + sum(pair[p[parent[k]], p[k]] for k in range(7) if parent[k] >= 0) for p in paths])
    weight /= weight.sum()
    got, expected = html.marginals(parent, scores, pair)
    assert np.allclose(got, weight @ paths)
    want = np.zeros((2, 2))
    for w, p in zip(weight, paths):
        for k in range(7):
            if parent[k] >= 0:
                want[p[parent[k]], p[k]] += w
    assert np.allclose(expected, want)


def test_pages_kept_from_the_fit():
    model = html.default_model()
    right = 0
    pages = html_pages.labelled_pages(60, 977)
    for page, y in pages:
        parent, x = html._node_features(page)
        chance, _ = html.marginals(parent, x @ model.weights, model.pair)
        spoken = {n for n, t, _ in page.run if n is not None and t.strip()}
        right += all((chance[n] >= 0.5) == (y[n] == 1) for n in spoken)
    assert right >= 0.9 * len(pages)


#: Written by hand, with frames and names that the templates don't have; (page, lines of the article).
PAGES_BY_HAND = [
    ("Only text, no markup.\nNot even a break, & so on.", ["Only text, no markup. Not even a break, & so on."]),
    ("<title>t</title><center><h2>On rivers</h2></center><p>Rivers run to the sea, as all know.<p>And the sea is not full.", ["On rivers", "Rivers run to the sea, as all know.", "And the sea is not full."]),
    ("<body bgcolor=white><table><tr><td><a href=1>Home</a> <a href=2>Mail</a></td></tr></table><h1>A walk</h1><p>We went up the hill, then down again.</p><p>It rained.</p><hr><address>Written by <a href=3>me</a></address></body>", ["A walk", "We went up the hill, then down again.", "It rained."]),
    ("<div id=wrapper><div id=navbar><a href=/>Start</a> | <a href=/a>All</a></div><div id=story><p>First comes the story, told in a sentence or two.</p><p>Then its end.</p></div><div id=colophon>All rights reserved.</div></div>", ["First comes the story, told in a sentence or two.", "Then its end."]),
    ("<main><h1>Soup</h1><ul><li>two onions</li><li>a litre of water</li></ul><ol><li>Cut them.</li><li>Boil, and wait.</li></ol></main><aside><h4>More soups</h4><a href=x>Leek</a></aside>", ["Soup", "two onions", "a litre of water", "Cut them.", "Boil, and wait."]),
    ("<article><header><h1>Title of it</h1></header><p>Text of it, with <em>stress</em> and <a href=y>a link</a>.</p><div class='sponsored'>Buy now!</div><blockquote>Said someone, once.</blockquote></article><section id='comments'><p>Great post, thanks for it!</p></section>", ["Title of it", "Text of it, with stress and a link.", "Said someone, once."]),
    ("<div class=cookie-banner>We use cookies. <button>OK</button></div><article><p>What happened was this: nothing, for a long time.</p></article><footer><ul><li><a href=i>Imprint</a><li><a href=p>Privacy</a></ul></footer>", ["What happened was this: nothing, for a long time."]),
    ("<p>A page that breaks off <a href=\"unclosed>here and</a> goes on.</p><p>Second <b one</b> is there too.</p>", ["A page that breaks off here and goes on.", "Second is there too."]),
    ("<article><p>Said <q>yes</q> &mdash; then&#8230; no&nbsp;more.<p>x &lt; y &amp;&amp; y &gt; z</article><script>var a = '<p>no</p>';</script>", ["Said yes — then… no more.", "x < y && y > z"]),
    ("<body>Straight into the body goes this text, which is fairly long, as such texts are.<br><br>And more of it, after a break.<div class=footer>Contact us</div></body>", ["Straight into the body goes this text, which is fairly long, as such texts are. And more of it, after a break."]),
    ("<div class=content><h1>Minutes</h1><p>Present: all.</p><table><tr><th>Item<th>Vote<tr><td>Roof<td>yes</table></div><form action=/s><input name=q><label>Find</label></form>", ["Minutes", "Present: all.", "Item", "Vote", "Roof", "yes"]),
    ("<!-- never closed <article><p>Kept, as it is said that nothing is lost.</p></article>", ["Kept, as it is said that nothing is lost."]),
]


def test_pages_written_by_hand():
    got = html.extract_texts([p for p, _ in PAGES_BY_HAND], html.default_model())
    wrong = [(g, w) for g, (_, w) in zip(got, PAGES_BY_HAND) if g != "\n".join(w)]
    assert len(wrong) <= 1, wrong


def test_parsing_takes_time_in_proportion():
    import time

    took = []
    for n in (20_000, 200_000):
        begin = time.perf_counter()
        for bad in ('<a href="', "<!-- x ", "<p ", "<b 'x", "</", "<div>", "<![CDATA[", "& < "):
            html.parse(bad * (n // len(bad)))
        took.append(time.perf_counter() - begin)
    assert took[1] < 40 * took[0] + 1


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<article><h1>A &amp; B</h1><p>one\n two<p>three <b>bold</b>&nbsp;x</article><footer>f</footer>", "A & B\none two\nthree bold x"),
        ("<nav><a href=/>menu</a></nav><article><p>Body text, with a comma.</p><div class=ad>buy</div><p>More.</p></article><div class=comments><p>nice</p></div>", "Body text, with a comma.\nMore."),
        ("<article><p>a &lt;b&gt; c &#233; &copy;</p><script>x</script><style>y</style><!-- z --></article>", "a <b> c é ©"),
        ("<article><p>cut off &am", "cut off &am"),
    ],
)
def test_small_pages(page, text):
    assert html.extract_texts([page], html.default_model()) == [text]


@pytest.mark.parametrize(
    "top",
    [
        "<html><head><title>t</title><meta charset=utf-8><script>x</script><body>",
        "<!doctype html><head><title>t</title><style>y</style>",
        "<head><noscript>n</noscript><link rel=x></head><body>",
        "<html><head><head><title>t</title><body class=x>",
    ],
)
def test_an_open_head_ends_where_the_page_begins(top):
    body = "<article><h1>A B</h1><p>Body text, with a comma.</p></article></body></html>"
    assert html.extract_texts([top + body], html.default_model()) == ["A B\nBody text, with a comma."]
    assert any("bare text" in t for n, t, _ in html.parse("<head><title>t</title> bare text").run if n is not None)


def test_html_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>a b c d e f g.</p></article>", "old", "m", "h"), (2, None, None, None, None, None), (2, None, None, None, None, None)], "page_id long, url string, html string, text string, markup string, __html string")
    got = {r.page_id: r for r in html.extract_main_text(df).collect()}
    assert got[1].text == "a b c d e f g." and (got[1].url, got[1].markup, got[1]["__html"]) == ("u", "m", "h") and got[2].text == ""


# ---- 2: lines -------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("most, least, whole", [(0.1, 4, True), (0.1, 2, False), (linededup.MAX_RATIO, linededup.MIN_PAGES, False), (0.5, 1, False)])
def test_lines_equal_brute_force(spark, most, least, whole):
    rng = random.Random(12)
    pool = ["boiler", " boiler ", "x", "", "  ", "\t"] + [f"l{k}" for k in range(60)]
    rows = [(k if rng.random() < 0.95 else rng.choice([0, None]), "\n".join(rng.choice(pool) for _ in range(rng.randrange(8))) if rng.random() < 0.95 else None, rng.choice(["a", "b", None])) for k in range(120)]
    rows += [(200, "only\nboiler", "small"), (201, "one\nof two", "two"), (202, "one", "two"), (203, "x", "three"), (204, "x", "three"), (204, "x", "three")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("N_Lines", F.lit("clash"))
    clashes = ("drop", "k", "a", "__drop", "__kept", "kept", "drop_key", "drop_host", "h", "t", "m")
    for c in clashes:
        df = df.withColumn(c, F.lit("mine"))
    made = linededup.dedup_lines(df, max_ratio=most, min_pages=least, keep_copied_pages=whole)
    assert made.columns == ["doc_id", "text", "source", *clashes, "n_lines", "n_dropped"] and made.where(" and ".join(f"`{c}` = 'mine'" for c in clashes)).count() == len(rows)
    got = sorted((str(r.doc_id), r.source or "", r.text is None, r.text or "", r.n_lines, r.n_dropped) for r in made.collect())
    pages, having = {}, {}
    for k, t, s in rows:
        if t is not None:
            pages.setdefault(s, set()).add(k)
            for x in t.split("\n"):
                if x.strip(" \t\r"):
                    having.setdefault((s, x.strip(" \t\r")), set()).add(k)
    bad = {key for key, ks in having.items() if len(ks) >= least and len(ks) > most * len(pages[key[0]])}
    want = []
    for k, t, s in rows:
        lines = [] if t is None else t.split("\n")
        hit = {x.strip(" \t\r") for kk, tt, ss in rows if kk == k and ss == s and tt is not None for x in tt.split("\n")}
        kept = [x for x in lines if (s, x.strip(" \t\r")) not in bad or x.strip(" \t\r") not in hit]
        kept = kept if not whole or any(x.strip(" \t\r") for x in kept) else lines
        want.append((str(k), s or "", t is None, "\n".join(kept), len(lines), len(lines) - len(kept)))
    assert got == sorted(want) and bad


# ---- all -----------------------------------------------------------------------------------------------------------------------


def test_clashing_columns(spark):
    df = docs(spark, ["One line. Two lines.\nthree", None, ""])
    for c in ("k", "t", "h", "g", "n", "f", "c", "b", "start", "length", "ids", "decoded", "fingerprint", "SCORE", "predicted", "component_id", "edited", "role", "__x"):
        df = df.withColumn(c, F.lit("clash"))
    field = quality.LineField(np.zeros(quality.N_FEATURES), np.zeros((2, 2)))
    assert quality.score_quality(df, field).select("score", "predicted", "k").count() == 3
    assert {r.component_id for r in ngramjoin.near_duplicates(df).collect()} == {0, 1, 2}
    assert merkle.compare_with_edits(df).count() == merkle.fingerprints(df).count() == bpe.encode_texts(df, WORD).count() == 3
    assert packing.pack_documents(df, BYTE).select("doc_id").distinct().count() == 3
    assert linededup.dedup_lines(df).count() == 3
    said = spark.createDataFrame([(1, 0, "user", "a"), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    pages = spark.createDataFrame([(1, "<p>a</p>")], "page_id long, html string")
    vectors = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    for c in ("c", "n", "r", "t", "ids", "part", "loss_mask", "tie", "q", "g", "b", "v", "dim", "qs", "score", "rank", "markup", "__html", "k", "fresh"):
        said, pages, vectors = (x.withColumn(c, F.lit("clash")) for x in (said, pages, vectors))
    assert chat.read_back(chat.format_conversations(said, BYTE), BYTE).count() == 2
    assert html.extract_main_text(pages).where("t = 'clash' AND markup = 'clash' AND text = 'a'").count() == 1
    assert [tuple(r) for r in topk.top_k(vectors).collect()] == [(0, 1, 1, 2 * 256 * 256)]


def test_empty_tables(spark):
    none = docs(spark, ["x"]).where("false")
    field, model = quality.LineField(np.zeros(quality.N_FEATURES), np.zeros((2, 2))), langid.fit([("a", "x")])
    for made in (
        bpe.encode_texts(none, WORD),
        packing.pack_documents(none, BYTE),
        merkle.compare_with_edits(none),
        merkle.fingerprints(none),
        langid.predict(none, model),
        quality.score_quality(none, field),
        linededup.dedup_lines(none),
        ngramjoin.near_duplicates(none),
        topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")),
        html.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")),
        chat.read_back(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), BYTE), BYTE),
    ):
        assert made.count() == 0


def test_long_texts_are_summed_in_pieces():
    import tracemalloc

    weights = np.random.default_rng(3).normal(size=(langid.BUCKETS, 2)).astype(np.float32)
    odd = " !Ab\0ΑΣ Σb.. İé漢字1 ß\n"
    for piece in (1, 2, 3, 5, len(odd) - 1, len(odd), 100):
        assert langid.long_total(odd, weights, piece) == pytest.approx(langid.totals([odd], weights)[0], abs=1e-4)
    text = "Some words, here. " * 200_000
    tracemalloc.start()
    got = langid.totals(["ab", text, "cd"], weights)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * len(text)
    assert got[1] / 200_000 == pytest.approx((langid.totals(["Some words, here. " * 2000], weights) / 2000)[0], rel=1e-2, abs=1e-2)
    assert got[2] == pytest.approx(langid.totals(["cd"], weights)[0])
