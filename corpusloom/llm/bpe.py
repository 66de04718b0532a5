"""BPE encoding and decoding by forced-boundary splitting, and the cached byte-level tokenizer that packing and chat use.

Two layers:

* ``WordCodec`` reads a tokenizer file with end-of-word marks, derives from its vocabulary every pair of adjacent byte
  symbols that some token contains, and cuts each word wherever a pair is in none of them: no merge can ever cross such a
  cut.  The fragments are encoded on their own and concatenated.
* ``ByteCodec`` splits a text into pre-tokens and asks the ``tokenizers`` library only for those that it has not met.  Whole columns
  of texts are split as arrays of bytes, equal words are found by Arrow, and new ones are merged many at a time.

Both keep a bounded memo per Python worker, so memory does not grow with the corpus.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries that a worker's memo holds at most; it is emptied when full.
MEMO = 500_000
#: Below this code point the character classes of every Unicode version agree, and the fast pattern is used.
SAFE = 0x250


def _patterns(top: int) -> tuple[re.Pattern, re.Pattern]:
    """Pre-token patterns of the byte-level and the word-end vocabulary for texts whose code points are all below ``top``."""
    kinds = [unicodedata.category(chr(c)) for c in range(top)]
    letter, number = ("".join(re.escape(chr(c)) for c in range(top) if kinds[c][0] == k) for k in "LN")
    space = "\\t-\\r \x85\xa0"
    other = f"[^{space}{letter}{number}]+"
    ends = "'s|'t|'re|'ve|'m|'ll|'d"
    return (
        re.compile(f" ?[{letter}]+|{ends}| ?[{number}]+| ?{other}|[{space}]+(?![^{space}])|[{space}]+"),
        re.compile(f"[{letter}]+|{ends}|[{number}]|{other}"),
    )


_BEYOND = re.compile(f"[^\\x00-{chr(SAFE - 1)}]")
_LATIN_PATTERNS, _SAFE_PATTERNS = _patterns(0x100), _patterns(SAFE)


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(1)
def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def _specials(spec: dict) -> tuple[re.Pattern | None, dict[str, int]]:
    ids = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    longest_first = sorted(ids, key=len, reverse=True)
    return (re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if ids else None), ids


def _parted(text: str, special: re.Pattern | None, begins: str) -> list[str]:
    """A text with its control strings at odd places; what all of them begin with is looked for first."""
    return special.split(text) if special and begins in text else [text]


class Merger:
    """BPE merges over strings of one-character symbols.  Many strings go through one call, joined by a symbol that is in no merge."""

    BORDER = chr(0xF8FF)

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        from tokenizers import Tokenizer, models

        self.border = 1 + max(vocab.values())
        self.model = Tokenizer(models.BPE(vocab=vocab | {self.BORDER: self.border}, merges=merges, cache_capacity=0))

    def __call__(self, strings: list[str], at_once: int = 512) -> Iterator[list[int]]:
        """The ids of each string, none of them empty."""
        for k in range(0, len(strings), at_once):
            part = strings[k : k + at_once]
            ids = self.model.encode(self.BORDER.join(part) + self.BORDER, add_special_tokens=False).ids
            begin = 0
            for _ in part:
                end = ids.index(self.border, begin)
                yield ids[begin:end]
                begin = end + 1


class ManyMerger:
    """The same merges over arrays: of the words that are still so many symbols wide, each takes its first merge, and all are one narrower.

    A word's first merge is the one of lowest rank, the leftmost of equal ones, as in the library.
    """

    NONE = np.int32(2**31 - 1)

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.start = np.array([vocab.get(s, -1) for s in byte_symbols()], np.int32)
        self.size = 1 + max(vocab.values())
        rank = {vocab[x] * self.size + vocab[y]: r for r, (x, y) in enumerate(merges)}
        keys, ranks = np.fromiter(rank, np.int64, len(rank)), np.fromiter(rank.values(), np.int32, len(rank))
        order = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[order], self.size**2), np.append(ranks[order], self.NONE)
        self.made = np.array([vocab[x + y] for x, y in merges], np.int32)
        self.first = self._rank(*np.meshgrid(self.start, self.start, indexing="ij"))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], self.NONE)

    def __call__(self, data: np.ndarray, begin: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words ``data[begin : begin + width]``, one word's after the other's, and how many each has; no word is empty."""
        widest = int(width.max(initial=0))
        order = np.argsort(width, kind="stable")
        edges = np.searchsorted(width[order], np.arange(widest + 2))
        words, ids, rank = np.zeros(0, np.int64), np.zeros((0, widest), np.int32), np.zeros((0, max(widest - 1, 0)), np.int32)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for w in range(widest, 0, -1):
            more = order[edges[w] : edges[w + 1]]
            if len(more):
                symbols = data[begin[more][:, None] + np.arange(w)]
                words, ids = np.concatenate([words, more]), np.concatenate([ids, self.start[symbols]])
                rank = np.concatenate([rank, self.first[symbols[:, :-1], symbols[:, 1:]]])
            if w == 1:
                done.append((words, ids))
                break
            at = rank.argmin(1)
            best = rank[np.arange(len(at)), at]
            on = best != self.NONE
            done.append((words[~on], ids[~on]))
            words, ids, rank, at, best = words[on], ids[on], rank[on], at[on], best[on]
            lines = np.arange(len(at))
            ids[lines, at] = self.made[best]
            keep = np.ones(ids.shape, bool)
            keep[lines, at + 1] = False
            ids = ids[keep].reshape(len(at), w - 1)
            keep = np.ones(rank.shape, bool)
            keep[lines, at] = False
            rank = rank[keep].reshape(len(at), w - 2)
            k = np.flatnonzero(at > 0)
            rank[k, at[k] - 1] = self._rank(ids[k, at[k] - 1], ids[k, at[k]])
            k = np.flatnonzero(at < w - 2)
            rank[k, at[k]] = self._rank(ids[k, at[k]], ids[k, at[k] + 1])
        counts = np.zeros(len(width), np.int64)
        for k, got in done:
            counts[k] = got.shape[1]
        first = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), "<u4")
        for k, got in done:
            out[first[k][:, None] + np.arange(got.shape[1])] = got
        return out, counts


class WordCodec:
    """Encodes as the vocabulary file says: NFC, white space to one blank, lower case, words with an end mark."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        self.path = path
        self.end = spec["model"]["end_of_word_suffix"]
        self.ids: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.tokens = {i: t for t, i in self.ids.items()}
        self.special, self.special_ids = _specials(spec)
        self.begins = os.path.commonprefix([*self.special_ids])
        self.tokens |= {i: t for t, i in self.special_ids.items()}
        self.symbols = byte_symbols()
        self.last = {s: chr(0xE000 + k) for k, s in enumerate(self.symbols)}
        self.inside = self._pairs()
        self.merger = self._one_character_model(merges)
        self.words: dict[str, bytes] = {}
        self.shown: dict[str, str] = {}

    @cached_property
    def library(self):
        """The library's own tokenizer; loaded for texts with letters beyond SAFE only."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _short(self, token: str) -> str:
        """A token with one character a symbol: a last symbol and its end mark become one private character."""
        if token.endswith(self.end) and len(token) > len(self.end):
            return token[: -len(self.end) - 1] + self.last[token[-len(self.end) - 1]]
        return token

    def _one_character_model(self, merges: list[tuple[str, str]]):
        """The file's merges over one-character symbols, so that a fragment from inside a word needs no end mark."""
        return Merger({self._short(t): i for t, i in self.ids.items()}, [(self._short(x), self._short(y)) for x, y in merges])

    def _pairs(self) -> set[str]:
        """Every pair of neighbouring byte symbols that some token of the vocabulary contains."""
        found: set[str] = set()
        for token in map(self._short, self.ids):
            found.update(map("".join, zip(token, token[1:])))
        return found

    def fragments(self, word: str) -> list[str]:
        """A word's byte symbols, the last with its end mark, cut at each pair that no token contains."""
        symbols = self.symbols
        body = word if word.isascii() and word.isalpha() else "".join([symbols[b] for b in word.encode()])
        body = body[:-1] + self.last[body[-1]]
        inside = self.inside
        cuts = [k for k in range(1, len(body)) if body[k - 1 : k + 1] not in inside]
        if not cuts:
            return [body]
        return [body[i:j] for i, j in zip([0, *cuts], [*cuts, len(body)])]

    def _learn(self, words: list[str]) -> None:
        """Puts new words into the memo; all their fragments are encoded in one call."""
        split = [self.fragments(w) for w in words]
        each = list(dict.fromkeys(f for parts in split for f in parts))
        ids = dict(zip(each, self.merger(each)))
        token = self.tokens.__getitem__
        for w, parts in zip(words, split):
            got = ids[parts[0]] if len(parts) == 1 else [i for f in parts for i in ids[f]]
            self.words[w] = array("I", got).tobytes()
            self.shown[w] = " ".join(map(token, got))

    def _words(self, text: str) -> list[str]:
        if _is_latin(text):
            return _LATIN_PATTERNS[1].findall(text.lower())
        if not _BEYOND.search(text):
            low = unicodedata.normalize("NFC", text).lower()
            if not _BEYOND.search(low):
                return _SAFE_PATTERNS[1].findall(low)
        back = {s: b for b, s in enumerate(self.symbols)}
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(back[c] for c in w).decode("utf-8", "surrogateescape") for w, _ in found]

    def encode_many(self, texts: list) -> list[tuple[bytes, str]]:
        """For each text its little-endian 32-bit ids and the decoded text: tokens joined by blanks, as a file without a decoder asks for."""
        if len(self.words) >= MEMO:
            self.words.clear()
            self.shown.clear()
        rows = [[p if k % 2 else self._words(p) for k, p in enumerate(_parted(t, self.special, self.begins))] if t else [] for t in texts]
        new = set().union(*(p for row in rows for p in row[::2])).difference(self.words)
        self._learn([*new])
        ids, shown, out = self.words.__getitem__, self.shown.__getitem__, []
        for row in rows:
            parts = [(array("I", [self.special_ids[p]]).tobytes(), p) if k % 2 else (b"".join(map(ids, p)), " ".join(map(shown, p))) for k, p in enumerate(row)]
            out.append(parts[0] if len(parts) == 1 else (b"".join(x[0] for x in parts), " ".join(x[1] for x in parts if x[0])))
        for w in [w for w in new if len(w) > 64]:
            del self.words[w], self.shown[w]
        return out

    def encode(self, text: str | None) -> tuple[bytes, str]:
        return self.encode_many([text])[0]

    def decode(self, ids) -> str:
        return " ".join(self.tokens[int(i)] for i in ids)


#: Kinds of the signs below U+0240, by code point: letters, numbers, white space, others.
_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
_KINDS = np.array([_SPACE if chr(c) in "\t\n\x0b\x0c\r \x85\xa0" else {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x240)], np.uint8)
#: First byte of the UTF-8 of U+0240; texts with such a byte or a higher one are left to the library.
_HIGH = 0xC9
#: Where a text may be cut without cutting a word.
_GAP = re.compile(rb"[0-9A-Za-z] ")


def word_starts(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where words begin in the UTF-8 of texts below U+0240 that stand one behind the other; ``rows``: where the texts that are not empty begin.

    The same words as the byte-level pattern's, found from changes of kind: the last blank before a word is part of it, the last of other
    white space stands alone, and the endings after an apostrophe are split off unless a blank or another sign is before it.
    """
    kind = _KINDS[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    kind[lead] = kind[lead + 1] = _KINDS[(data[lead].astype(np.int64) & 31) << 6 | data[lead + 1] & 63]
    text = np.zeros(len(data) + 3, bool)  # where texts begin; the places behind the data count as such
    text[rows] = text[len(data) :] = True
    begins = text.copy()
    begins[1 : len(data)] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    after = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    after = after[~text[after]]
    blank = data[after - 1] == 0x20
    begins[after[blank]] = False
    begins[after[blank] - 1] = True
    other = after[~blank] - 1
    begins[other - (data[other] >= 0x80)] = True
    quote = np.flatnonzero(data == 0x27)
    quote = quote[begins[quote] & ~text[quote + 1]]
    x, y = data[quote + 1], np.where(text[quote + 2], 0, data[np.minimum(quote + 2, len(data) - 1)])
    one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
    two = np.isin(x, np.frombuffer(b"rv", np.uint8)) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
    quote, width = quote[one | two], np.where(one, 2, 3)[one | two]
    begins[quote + 1] = False
    begins[quote + width] = True
    return np.flatnonzero(begins[: len(data)])


class ByteCodec:
    """Byte-level BPE with the library's own ids; words are looked up in a memo and encoded in one call when new."""

    def __init__(self, path: str, specials: bool = True):
        """specials: control strings of the vocabulary that occur in a text become their ids, as the library does unless told otherwise."""
        spec = json.loads(open(path, encoding="utf-8").read())
        self.path = path
        self.merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.stand_in = dict(enumerate(byte_symbols()))
        self.special, self.special_ids = _specials(spec)
        self.begins = os.path.commonprefix([*self.special_ids])
        if not specials:
            self.special = None
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.words: dict[str, bytes] = {}
        self.known: dict[bytes, bytes] = {}
        back = {s: b for b, s in enumerate(byte_symbols())}
        size = 1 + max([*self.vocab.values(), *self.special_ids.values()])
        self.bytes: list[bytes] = [b""] * size
        for t, i in self.vocab.items():
            self.bytes[i] = bytes(back[c] for c in t)
        for t, i in self.special_ids.items():
            self.bytes[i] = t.encode()

    @cached_property
    def merger(self) -> Merger:
        return Merger(self.vocab, self.merges)

    @cached_property
    def many(self) -> ManyMerger:
        return ManyMerger(self.vocab, self.merges)

    @cached_property
    def library(self):
        """The library's own tokenizer; loaded for texts with letters beyond SAFE only."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.no_truncation()
        out.no_padding()
        out.encode_special_tokens = True
        return out

    def _words(self, text: str) -> list[str] | bytes:
        """Pre-tokens, or the ids themselves where the fast pattern doesn't hold."""
        if _is_latin(text):
            return _LATIN_PATTERNS[0].findall(text)
        if _BEYOND.search(text):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return _SAFE_PATTERNS[0].findall(text)

    def _make_room(self) -> None:
        if len(self.words) + len(self.known) >= MEMO:
            self.words.clear()
            self.known.clear()

    def encode_many(self, texts: list) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        memo = self.words
        self._make_room()
        rows = [[p if k % 2 else self._words(p) for k, p in enumerate(_parted(t, self.special, self.begins))] if t else [] for t in texts]
        new = [*set().union(*(p for row in rows for p in row[::2] if not isinstance(p, bytes))).difference(memo)]
        for w, ids in zip(new, self.merger([w.encode().decode("latin-1").translate(self.stand_in) for w in new])):
            memo[w] = array("I", ids).tobytes()
        get = memo.__getitem__
        out = [b"".join([array("I", [self.special_ids[p]]).tobytes() if k % 2 else p if isinstance(p, bytes) else b"".join(map(get, p)) for k, p in enumerate(row)]) for row in rows]
        for w in new:
            if len(w) > 64:
                del memo[w]
        return out

    def _learn(self, words: list[bytes]) -> None:
        """Puts new words into the memo."""
        long = [w for w in words if len(w) > 64]
        for w, ids in zip(long, self.merger([w.decode("latin-1").translate(self.stand_in) for w in long]) if long else ()):
            self.known[w] = array("I", ids).tobytes()
        short = [w for w in words if len(w) <= 64]
        width = np.fromiter(map(len, short), np.int64, len(short))
        ids, counts = self.many(np.frombuffer(b"".join(short), np.uint8), np.cumsum(width) - width, width)
        whole, ends = ids.tobytes(), (4 * np.cumsum(counts)).tolist()
        self.known.update(zip(short, [whole[a:b] for a, b in zip([0, *ends], ends)]))

    def _encode_window(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the texts that begin at ``rows``; where each word begins, and how many ids are before it (and before the end)."""
        starts = word_starts(data, rows)
        offsets = np.append(starts, len(data)).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        whole, ends = found.dictionary.buffers()[2].to_pybytes(), np.frombuffer(found.dictionary.buffers()[1], np.int32, len(found.dictionary) + 1).tolist()
        words = [whole[a:b] for a, b in zip(ends, ends[1:])]
        self._make_room()
        got = [*map(self.known.get, words)]
        new = [k for k, ids in enumerate(got) if ids is None]
        if new:
            self._learn([words[k] for k in new])
            for k in new:
                got[k] = self.known[words[k]]
                if len(words[k]) > 64:
                    del self.known[words[k]]
        table = np.frombuffer(b"".join(got), "<u4")
        count = np.fromiter(map(len, got), np.int64, len(got)) // 4
        first = np.cumsum(count) - count
        index = found.indices.to_numpy(zero_copy_only=False)
        each = count[index]
        before = np.concatenate([[0], np.cumsum(each)])
        ids = table[np.repeat(first[index] - before[:-1], each) + np.arange(before[-1])]
        return ids, starts, before

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, one text's after the other's, and how many each has; a null text has none.

        Texts with signs from U+0240 on or with something like a control string go through ``encode_many``; the ids are the same.
        """
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        texts.validate(full=True)
        rows = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        if not rows[-1] - rows[0]:
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[rows[0] : rows[-1]]
        rows = rows - rows[0]
        apart = np.zeros(len(texts), bool)
        if self.special:
            apart |= pc.match_substring(texts, self.begins).to_numpy(zero_copy_only=False)
        apart[np.searchsorted(rows, np.flatnonzero(data >= _HIGH), side="right") - 1] = True
        if self.many.start.min() < 0:
            apart[:] = True
        if apart.any():
            other = self.encode_many(texts.filter(pa.array(apart)).to_pylist())
            counts = np.zeros(len(texts), np.int64)
            counts[apart] = [len(ids) // 4 for ids in other]
            ids, counts[~apart] = self.encode_column(texts.filter(pa.array(~apart)))
            out, where = np.empty(int(counts.sum()), "<u4"), np.repeat(apart, counts)
            out[where], out[~where] = np.frombuffer(b"".join(other), "<u4"), ids
            return out, counts
        parts, at = [], np.zeros(len(rows), np.int64)
        begin = 0
        while begin < len(data):
            gap = _GAP.search(data, begin + BATCH_CHARS) if len(data) - begin > 2 * BATCH_CHARS else None
            end = gap.start() + 1 if gap else len(data)
            inside = np.unique(np.append(rows[(rows > begin) & (rows < end)], begin)) - begin
            ids, starts, before = self._encode_window(data[begin:end], inside)
            at += before[np.searchsorted(starts, np.clip(rows, begin, end) - begin)]
            parts.append(ids)
            begin = end
        return np.concatenate(parts), np.diff(at)

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def decode_bytes(self, ids) -> bytes:
        table = self.bytes
        return b"".join([table[i] for i in ids])


@lru_cache(4)
def word_codec(path: str) -> WordCodec:
    return WordCodec(path)


@lru_cache(4)
def byte_codec(path: str, specials: bool = True) -> ByteCodec:
    return ByteCodec(path, specials)


def list_of_ids(parts: list[bytes]) -> pa.ListArray:
    """An Arrow list of 32-bit ids from little-endian bytes, one item a row."""
    sizes = np.fromiter((len(p) // 4 for p in parts), dtype=np.int64, count=len(parts))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), dtype="<i4")))


#: Characters of text that one output batch is made of at most (unless a single text is longer).
BATCH_CHARS = 2_000_000


def slices(batch: pa.RecordBatch, column: str, size: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text each."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if total and total + n > size:
            yield batch.slice(begin, k - begin)
            begin, total = k, 0
        total += n
    part = batch.slice(begin)
    if part.num_rows:
        yield part


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """The same slices, and their texts."""
    for part in slices(batch, column):
        yield part, part[column].to_pylist()


def encode_texts(df: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Key, ``ids array<int>`` and ``decoded string`` of every row of ``df``.

    tokenizer: path of a word-end BPE vocabulary file, readable on every executor.
    A null or empty text has no ids and an empty decoded text.  Repeated rows and ties give repeated rows; an empty table an empty one;
    other columns are ignored, whatever their names.  Control strings of the vocabulary become their ids.  Very long texts are encoded whole.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = word_codec(tokenizer)
        for batch in batches:
            for part, texts in chunks(batch, "t"):
                found = codec.encode_many(texts)
                yield pa.RecordBatch.from_arrays([part["k"], list_of_ids([f[0] for f in found]), pa.array([f[1] for f in found], pa.string())], ["k", "ids", "decoded"])

    out = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"k {kind}, ids array<int>, decoded string")
    return out.withColumnRenamed("k", key)
