"""Byte-level BPE encoding and decoding with a given table of ranks.

Texts are cut into pre-tokens without a regular expression: an array of code-point classes selects
a transition function for every character, an associative scan composes the functions, and the
state before each character tells whether a pre-token begins there. The slices are counted once
each and merged pair by pair, lowest rank first, with a cache; byte offsets of the tokens are kept.
Tasks see a megabyte of text at a time and nothing is shuffled.

Null texts count as empty and give no tokens; repeated rows are encoded each on their own; rows of
null ids stay. A long text is cut before white space that follows other characters, where no
pre-token can cross, so memory is bounded by the longest stretch without such a place. Only the id
and text columns are read, so other columns and their names do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import batches_of

#: Code points of a text that are worked on at once (see `pieces`), bounds of the cache of merged slices,
#: and bytes of slices that are merged by lists.
PIECE = 1 << 20
CACHE_SLICES, CACHE_BYTES, SHORT_SLICE = 1 << 19, 64, 48

# Classes of code points: letter, number, other, the space, other white space.
LETTER, NUMBER, OTHER, SPACE, WHITE = range(5)
# Symbols of the automaton: the classes above; an apostrophe that opens a contraction of two or three
# characters; white space that other characters follow; the end of a text.
SHORT, LONG, LAST_SPACE, LAST_WHITE, END = range(5, 10)
# States: what stands before a character.
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, IN_WHITE, ONE_MORE, TWO_MORE = range(8)
# What may follow an apostrophe, and the characters that count as white space.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a character, and whether a pre-token begins at it."""
    if symbol == END:
        return FREE, True
    if state in (ONE_MORE, TWO_MORE) and symbol == LETTER:
        return (FREE if state == ONE_MORE else ONE_MORE), False
    if symbol in (LETTER, NUMBER, OTHER):
        run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER}[symbol]
        return run, state not in (run, AFTER_SPACE)
    if symbol in (SHORT, LONG):
        if state in (IN_OTHER, AFTER_SPACE):
            return IN_OTHER, False
        return (ONE_MORE if symbol == SHORT else TWO_MORE), True
    if symbol in (SPACE, WHITE):  # more white space or the end of the text follows
        return IN_WHITE, state != IN_WHITE
    return (AFTER_SPACE if symbol == LAST_SPACE else FREE), True


@cache
def classes() -> np.ndarray:
    """Class of every code point."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[list(WHITE_SPACE)] = WHITE
    out[0x20] = SPACE
    return out


@cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All transition functions that compositions of symbols make: (function of each symbol,
    composition table, image of each state under each function, begins[state, symbol])."""
    single = [tuple(_step(s, a)[0] for s in range(8)) for a in range(10)]
    known = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(8)), *single]))}
    queue = list(known)
    for f in queue:  # grows while new functions are found
        for g in single:
            h = tuple(g[x] for x in f)
            if h not in known:
                known[h] = len(known)
                queue.append(h)
    then = np.array([[known[tuple(g[x] for x in f)] for g in known] for f in known], np.uint16)
    begins = np.array([[_step(s, a)[1] for a in range(10)] for s in range(8)])
    return np.array([known[f] for f in single], np.uint16), then, np.array(list(known), np.uint8), begins


def composed(functions: np.ndarray, then: np.ndarray, block: int = 64) -> np.ndarray:
    """Composition of each prefix of `functions`: blocks side by side, then the blocks' totals."""
    n = len(functions)
    if n <= block:
        out = functions.copy()
        for j in range(1, n):
            out[j] = then[out[j - 1], out[j]]
        return out
    rows = -(-n // block)
    padded = np.zeros(rows * block, functions.dtype)
    padded[:n] = functions
    lanes = np.ascontiguousarray(padded.reshape(rows, block).T)
    for j in range(1, block):
        lanes[j] = then[lanes[j - 1], lanes[j]]
    before = composed(lanes[-1].copy(), then, block)[:-1]
    lanes[:, 1:] = then[before[None, :], lanes[:, 1:]]
    return np.ascontiguousarray(lanes.T).ravel()[:n]


def symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The automaton's symbol of each code point; at `ends` stand the ends of texts."""
    out = classes()[points]
    out[ends] = END
    after = np.append(out[1:], END).astype(np.uint8)
    filled = after < SPACE
    out[(out == SPACE) & filled] = LAST_SPACE
    out[(out == WHITE) & filled] = LAST_WHITE
    quotes = np.flatnonzero(points == ord("'"))
    quotes = quotes[out[quotes] == OTHER]
    padded = np.append(points, [0, 0]).astype(np.uint32)
    for word in CONTRACTIONS:
        fits = quotes
        for k, letter in enumerate(word, 1):
            fits = fits[padded[fits + k] == ord(letter)]
        out[fits] = SHORT if len(word) == 1 else LONG
    return out


def pre_tokens(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(UTF-8 bytes of the texts, each with one more byte behind it; byte offsets of the slices and the
    end; for each slice whether it is such a byte behind a text)."""
    joined = "\0".join([*texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    single, then, image, begins = automaton()
    symbol = symbols(points, ends)
    state = np.append(np.uint8(FREE), image[composed(single[symbol], then), FREE][:-1]) if len(points) else np.zeros(0, np.uint8)
    first = np.flatnonzero(begins[state, symbol])
    size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at = np.concatenate([[0], np.cumsum(size)])
    return joined.encode("utf-8", "surrogatepass"), np.append(at[first], at[-1]), symbol[first] == END


def pieces(text: str) -> Iterator[str]:
    """`text` cut where white space follows another character, about every PIECE code points."""
    start = 0
    while len(text) - start > PIECE:
        cut = start + PIECE
        while cut < len(text) and (not text[cut].isspace() or ord(text[cut]) not in WHITE_SPACE or ord(text[cut - 1]) in WHITE_SPACE):
            cut += 1
        yield text[start:cut]
        start = cut
    yield text[start:]


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one slice: the adjacent pair of lowest rank is merged, the leftmost first."""
    if word in ranks:
        return [ranks[word]]
    return _merged_short(word, ranks) if len(word) <= SHORT_SLICE else _merged_long(word, ranks)


def _merged_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """By lists of parts and of the ranks of adjacent ones."""
    rank, none = ranks.get, 1 << 62
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [rank(word[i : i + 2], none) for i in range(len(word) - 1)]
    while pairs and (low := min(pairs)) != none:
        i = pairs.index(low)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = rank(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = rank(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merged_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """By a heap of pairs, so that a slice of n bytes takes n log n steps."""
    n = len(word)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or after[j] != end:
            continue  # one of the two parts has been merged since
        alive[j] = False
        after[i] = end
        if end < n:
            before[end] = i
            if (r := ranks.get(word[i : after[end]])) is not None:
                heapq.heappush(heap, (r, i, after[end]))
        if (k := before[i]) >= 0 and (r := ranks.get(word[k:end])) is not None:
            heapq.heappush(heap, (r, k, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    """The table of ranks in `path`: base64 bytes and a rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Codec:
    """Encoder and decoder of one table of ranks; merged slices are cached up to fixed bounds."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.known = ranks, {}
        words = [b""] * (max(ranks.values(), default=-1) + 1)
        for w, i in ranks.items():
            words[i] = w
        self.words = pa.array(words, pa.binary())
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))

    def _ids(self, word: bytes) -> list[int]:
        if (ids := self.known.get(word)) is None:
            ids = merged(word, self.ranks)
            if len(word) <= CACHE_BYTES:
                if len(self.known) >= CACHE_SLICES:
                    self.known.clear()
                self.known[word] = ids
        return ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        data, offsets, closing = pre_tokens(texts)
        kind = np.int32 if len(data) < 1 << 31 else np.int64
        slices = pa.Array.from_buffers(pa.binary() if kind is np.int32 else pa.large_binary(), len(closing), [None, pa.py_buffer(offsets.astype(kind)), pa.py_buffer(data)])
        coded = slices.filter(pa.array(~closing)).dictionary_encode()
        parts = [self._ids(w) for w in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.fromiter((i for p in parts for i in p), np.int32, int(size.sum()))
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        count = size[which]
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = flat[np.repeat((np.cumsum(size) - size)[which] - upto[:-1], count) + np.arange(upto[-1])]
        slices_upto = np.cumsum(~closing)[closing]  # slices before the end of each text
        return ids, np.diff(upto[slices_upto], prepend=0)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of `ids`."""
        found = self.words.take(pa.array(ids, pa.int32()))
        return found.buffers()[2].to_pybytes()[: int(self.sizes[ids].sum())] if len(ids) else b""

    def encoded(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, text) rows -> (doc_id, ids, ends) rows; `ends` are the byte offsets at which tokens end."""
        for batch in batches:
            keys, column = batch.column(0), batch.column(1)
            data = column.fill_null(b"").cast(pa.large_binary()).to_pylist()
            for rows in batches_of(data):
                texts = [list(pieces(t.decode(errors="replace"))) for t in data[rows]]
                parts, owner = [p for t in texts for p in t], np.repeat(np.arange(len(texts)), list(map(len, texts)))
                ids, count = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
                for some in batches_of(parts, PIECE):
                    mine, n = self.encode(parts[some])
                    ids.append(mine)
                    np.add.at(count, owner[some], n)
                flat, upto = np.concatenate(ids), np.concatenate([[0], np.cumsum(count)])
                ends = np.cumsum(self.sizes[flat])
                ends -= np.repeat(np.append(0, ends)[upto[:-1]], count)
                offsets = pa.array(upto, pa.int32())
                yield pa.RecordBatch.from_arrays([keys.slice(rows.start, len(texts)), pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.ListArray.from_arrays(offsets, pa.array(ends))], ["doc_id", "ids", "ends"])

    def decoded(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with (doc_id, ids, ends) -> the same rows with `data`, the decoded bytes; wrong offsets are an error."""
        for batch in batches:
            ids, ends = batch.column("ids"), batch.column("ends")
            flat, data = ids.flatten().to_numpy(zero_copy_only=False), []
            upto = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            last = ends.flatten().to_numpy(zero_copy_only=False)
            for a, b in zip(upto[:-1], upto[1:], strict=True):
                data.append(self.decode(flat[a:b]))
                if len(data[-1]) != (last[b - 1] if b > a else 0):
                    raise ValueError("ids and offsets of a document do not fit")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.large_binary())], [*batch.schema.names, "data"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("ids")
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        upto = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        hashed = [hashlib.sha256(flat[x:y].tobytes()).hexdigest() for x, y in zip(upto[:-1], upto[1:], strict=True)]
        whole = [hashlib.sha256(x).hexdigest() for x in b.column("data").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(upto)), pa.array(hashed), pa.array(whole)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


@lru_cache(maxsize=2)
def _codec(ranks: Broadcast) -> Codec:
    """A worker's codec, kept from task to task."""
    return Codec(ranks.value)


def _shared(docs: DataFrame, path: str) -> Broadcast:
    """The ranks, read once and broadcast: as large as the vocabulary, whatever the corpus."""
    return docs.sparkSession.sparkContext.broadcast(read_ranks(path))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every text by the ranks in `path` -> doc_id, ids, ends (byte offsets at which tokens end)."""
    ranks = _shared(docs, path)
    return _source(docs, id_col, text_col).mapInArrow(lambda batches: _codec(ranks).encoded(batches), "doc_id long, ids array<int>, ends array<long>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The bytes of rows that encode() made -> doc_id, data."""
    ranks = _shared(encoded, path)
    rows = encoded.select("doc_id", "ids", "ends")
    return rows.mapInArrow(lambda batches: (b.select(["doc_id", "data"]) for b in _codec(ranks).decoded(batches)), "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode(), then decode(), in one pass -> doc_id, n_tokens, SHA-256 of the ids (32 bits each) and of the decoded bytes."""
    ranks = _shared(docs, path)
    done = lambda batches: _digests(_codec(ranks).decoded(_codec(ranks).encoded(batches)))
    return _source(docs, id_col, text_col).mapInArrow(done, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
