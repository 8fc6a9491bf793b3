"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features, those of its two neighbours and the transition
between adjacent labels give a chain model; forward-backward marginals of the lines, weighted by
line length, are averaged to the document's score. The model is fitted here on a bounded sample
of labelled documents (their lines take the document's label); scoring is a map over batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .wordhash import batches_of

# Byte classes: a byte of a longer UTF-8 sequence counts as a letter.
_CLASS = np.full(256, 7, np.uint8)
_CLASS[[*range(97, 123)]] = 0
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(48, 58)]] = 2
_CLASS[[9, 11, 12, 13, 32]] = 3
_CLASS[[*b".,;:'\"?()-"]] = 4
_CLASS[[*b"!"]] = 5
_CLASS[[*b"|"]] = 6
_CLASS[[*range(128, 256)]] = 8
N_CLASSES = 9
N_FEATURES = N_CLASSES + 8


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of `texts` (rows), the number of lines of each text, the bytes of each line."""
    lines = [x for t in texts for x in t.split(b"\n")]
    counts = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    own, size = _features(lines, counts, [set() for _ in texts])
    return own, counts, size


def _features(lines: list[bytes], counts: np.ndarray, seen: list[set[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and sizes of `lines`, counts[k] of which follow the lines of text k that are in seen[k]."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    share = np.zeros((len(lines), N_CLASSES))
    full = np.flatnonzero(size)
    if len(full):
        classes = _CLASS[np.frombuffer(b"".join(lines), np.uint8)]
        begin = (np.cumsum(size) - size)[full]
        for c in range(N_CLASSES):
            share[full, c] = np.add.reduceat((classes == c).view(np.uint8), begin, dtype=np.int64)
        share[full] /= size[full, None]
    words = [x.split() for x in lines]
    n_words = np.fromiter(map(len, words), np.int64, len(words))
    varied = np.fromiter((len(set(w)) for w in words), np.int64, len(words))
    again, at = np.zeros(len(lines)), 0
    for n, before in zip(counts.tolist(), seen, strict=True):
        for i in range(at, at + n):
            again[i] = lines[i] in before
            before.add(lines[i])
        at += n
    rest = np.stack(
        [
            np.log1p(size) / 8,
            np.log1p(n_words) / 6,
            size / np.maximum(n_words, 1) / 10,
            np.where(n_words > 0, varied / np.maximum(n_words, 1), 1.0),
            np.minimum(n_words / np.maximum(varied, 1), 10) / 5,
            again,
            np.array([x[-1:] in (b".", b"!", b"?", b":") for x in lines], float),
            np.array([65 <= x[0] <= 90 or x[0] >= 192 if x else False for x in lines], float),
        ],
        axis=1,
    )
    return np.concatenate([share, rest], axis=1), size


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Own, previous and next line's features, with flags for a missing neighbour and a constant."""
    ends = np.cumsum(counts)
    first, last = ends - counts, ends - 1
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    flags = np.zeros((len(own), 3))
    flags[first, 0], flags[last, 1], flags[:, 2] = 1, 1, 1
    return np.concatenate([own, before, after, flags], axis=1)


def _times(rows: np.ndarray, m: np.ndarray) -> np.ndarray:
    """rows @ m for two columns, summed alike for any number of rows."""
    return rows[:, :1] * m[0] + rows[:, 1:] * m[1]


@dataclass
class LineCRF:
    """Two labels; `weights` scores label good over bad, `moves[a, b]` scores label b after a."""

    weights: np.ndarray
    moves: np.ndarray

    def marginals(self, emit: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(good) of each line, expected label pairs (2 x 2), sum of log partition functions.

        Chains advance together, longest first, so a step is a few operations on arrays.
        """
        order = np.argsort(-counts, kind="stable")
        begin = (np.cumsum(counts) - counts)[order]
        length = counts[order]
        m = np.exp(self.moves - self.moves.max())
        top = np.maximum(emit, 0)
        e = np.exp(np.stack([-top, emit - top], axis=1))
        ahead, back = np.empty_like(e), np.ones_like(e)
        scale = np.empty(len(e))
        live = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
        for t, n in enumerate(live):
            at = begin[:n] + t
            a = e[at] if t == 0 else _times(ahead[at - 1], m) * e[at]
            scale[at] = a[:, 0] + a[:, 1]
            ahead[at] = a / scale[at, None]
        pairs = np.zeros((2, 2))
        for t in range(len(live) - 1, 0, -1):
            at = begin[: live[t]] + t
            right = e[at] * back[at] / scale[at, None]
            pairs += m * (ahead[at - 1].T @ right)
            back[at - 1] = _times(right, m.T)
        both = ahead * back
        logz = np.log(scale).sum() + top.sum() + self.moves.max() * (counts - 1).sum()
        return both[:, 1] / (both[:, 0] + both[:, 1]), pairs, float(logz)


def fit(own: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 120, rate: float = 0.1, ridge: float = 1e-3) -> LineCRF:
    """Maximum conditional likelihood by Adam on whole chains; labels: 0 or 1 of each document.

    Documents count alike however many lines they have. No labelled document, or one label
    only, gives the model that the data supports: neutral, or leaning to that label.
    """
    x = with_neighbours(own, counts) if len(own) else np.zeros((0, 3 * N_FEATURES + 3))
    crf = LineCRF(np.zeros(3 * N_FEATURES + 3), np.zeros((2, 2)))
    if not len(counts):
        return crf
    y, weight = np.repeat(labels, counts).astype(float), np.repeat(1 / counts, counts)
    move, second, lr = [np.zeros_like(v) for v in (crf.weights, crf.moves)], [np.zeros_like(v) for v in (crf.weights, crf.moves)], rate
    steps = np.maximum(counts - 1, 0)
    gold = np.diag([float(steps[labels == 0].sum()), float(steps[labels == 1].sum())])
    for k in range(1, rounds + 1):
        p, pairs, _ = crf.marginals(x @ crf.weights, counts)
        grads = [x.T @ ((p - y) * weight) / len(counts) + ridge * crf.weights, (pairs - gold) / max(1, steps.sum()) + ridge * crf.moves]
        for i, (g, name) in enumerate(zip(grads, ("weights", "moves"), strict=True)):
            move[i] = 0.9 * move[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            step = lr * (move[i] / (1 - 0.9**k)) / (np.sqrt(second[i] / (1 - 0.99**k)) + 1e-8)
            setattr(crf, name, getattr(crf, name) - step)
    return crf


#: Lines whose features are held at once, and lines of a block of a chain.
PIECE_LINES, BLOCK = 8192, 64


def emissions(crf: LineCRF, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score of good over bad of every line, lines of each text, bytes of each line; features are made a piece at a time."""
    counts = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    parts, sizes = [np.zeros((0, 3))], [np.zeros(0, np.int64)]
    weights = crf.weights[: 3 * N_FEATURES].reshape(3, N_FEATURES)  # own line, line before, line after: what a line says of itself, of the next and of the one before
    for rows in batches_of(texts, most_bytes=1 << 20, most=512):
        lines = [x for t in texts[rows] for x in t.split(b"\n")]
        ends, seen = np.cumsum(counts[rows]), [set() for _ in texts[rows]]
        for a in range(0, len(lines), PIECE_LINES):
            b = min(len(lines), a + PIECE_LINES)
            first, last = np.searchsorted(ends, a, side="right"), np.searchsorted(ends, b - 1, side="right")
            mine = np.minimum(ends[first : last + 1], b) - np.maximum(np.append(0, ends)[first : last + 1], a)
            own, size = _features(lines[a:b], mine, seen[first : last + 1])
            parts.append((own[:, None, :] * weights).sum(axis=2))
            sizes.append(size)
    own, before, after = np.concatenate(parts).T
    first, last = np.cumsum(counts) - counts, np.cumsum(counts) - 1
    left, right = np.append(0.0, before)[: len(own)], np.append(after[1:], 0.0)
    left[first], right[last] = crf.weights[-3], crf.weights[-2]  # no neighbour there: its flag instead
    return own + left + right + crf.weights[-1], counts, np.concatenate(sizes)


def good_shares(crf: LineCRF, emit: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """P(good) of each line as LineCRF.marginals gives it, in blocks of BLOCK lines.

    A block's lines give one 2 x 2 matrix; the chain of blocks carries the forward and backward vectors, from which
    each block's own lines follow. Steps grow with a chain's blocks and the block, not with its lines, and do
    not depend on which chains are scored together.
    """
    blocks = -(-counts // BLOCK)
    owner = np.repeat(np.arange(len(counts)), blocks)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = (np.cumsum(counts) - counts)[owner] + number * BLOCK
    length = np.minimum(BLOCK, counts[owner] - number * BLOCK)
    m = np.exp(crf.moves - crf.moves.max())
    top = np.maximum(emit, 0)
    e = np.exp(np.stack([-top, emit - top], axis=1))

    def times(v: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        """Row vectors by matrices, summed alike for any number of rows."""
        out = v[..., :1] * matrix[..., 0, :] + v[..., 1:] * matrix[..., 1, :]
        return out / out.sum(axis=-1, keepdims=True)

    whole = np.broadcast_to(np.eye(2), (len(owner), 2, 2)).copy()
    for t in range(BLOCK):
        on = np.flatnonzero(length > t)
        start = (number[on] == 0) & (t == 0)  # nothing moves before the first line
        step = np.where(start[:, None, None], np.eye(2), m) * e[begin[on] + t][:, None, :]
        rows = whole[on]
        new = rows[:, :, :1] * step[:, :1, :] + rows[:, :, 1:] * step[:, 1:, :]
        whole[on] = new / new.max(axis=(1, 2), keepdims=True)
    ahead, back = np.full((len(owner), 2), 0.5), np.full((len(owner), 2), 0.5)  # vectors before and after each block
    order = np.argsort(-blocks, kind="stable")
    at, many = (np.cumsum(blocks) - blocks)[order], blocks[order]
    for k in range(1, int(many.max(initial=0))):
        live = np.searchsorted(-many, -(k + 1), side="right")
        now = at[:live] + k
        ahead[now] = times(ahead[now - 1], whole[now - 1])
    for k in range(int(many.max(initial=0)) - 1, 0, -1):
        live = np.searchsorted(-many, -(k + 1), side="right")
        now = at[:live] + k
        back[now - 1] = times(back[now], whole[now].transpose(0, 2, 1))
    good = np.empty(len(emit))
    held = np.empty((BLOCK, len(owner), 2))
    for t in range(BLOCK):
        on = np.flatnonzero(length > t)
        before = held[t - 1, on] if t else ahead[on]
        start = (number[on] == 0) & (t == 0)
        moved = np.where(start[:, None], before, before[:, :1] * m[0] + before[:, 1:] * m[1])
        v = moved * e[begin[on] + t]
        held[t, on] = v / v.sum(axis=1, keepdims=True)
    for t in range(BLOCK - 1, -1, -1):
        on = np.flatnonzero(length > t)
        both = held[t, on] * back[on]
        good[begin[on] + t] = both[:, 1] / (both[:, 0] + both[:, 1])
        right = e[begin[on] + t] * back[on]
        back[on] = right[:, :1] * m[:, 0] + right[:, 1:] * m[:, 1]
        back[on] /= back[on].sum(axis=1, keepdims=True)
    return good


def score_texts(crf: LineCRF, texts: list[bytes]) -> np.ndarray:
    """Length-weighted mean P(good) of the lines of each text (a line counts one more than its bytes).

    Sums run over one line or one text at a time, so a text's score does not depend on its batch. What is held for each line
    of a long text is a few numbers, not its features.
    """
    emit, counts, size = emissions(crf, texts)
    p = good_shares(crf, emit, counts)
    begin = np.cumsum(counts) - counts
    return np.add.reduceat(p * (size + 1), begin) / np.add.reduceat(size + 1, begin)


def _texts(column: pa.Array) -> list[bytes]:
    return [(x or "").encode() for x in column.to_pylist()]


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 1500, max_lines: int = 2000, max_bytes: int = 200_000) -> LineCRF:
    """Fit on at most `max_docs` labelled documents outside the held-out third.

    The sample is the documents of smallest id hash, of those with at most `max_lines` lines and
    `max_bytes` bytes: the same for any partitioning, and the only bound in this operator.
    Features of whole texts, not texts, travel to the driver.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    picked = usable.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).join(F.broadcast(picked), "doc_id")
    rows = rows.where((F.octet_length("text") <= max_bytes) & (F.octet_length("text") - F.octet_length(F.translate("text", "\n", "")) < max_lines))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own, counts, _ = line_features(_texts(b.column(1)))
                cuts = np.cumsum(counts)[:-1]
                packed = [x.astype(np.float32).tobytes() for x in np.split(own, cuts)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(b.column(2)), pa.array(packed, pa.binary())], names=["doc_id", "quality", "packed"])

    found = rows.select("doc_id", "text", "quality").mapInArrow(features, "doc_id long, quality int, packed binary")
    sample = found.orderBy(F.xxhash64("doc_id"), "doc_id", "packed").limit(max_docs).collect()  # ids may repeat
    sample.sort(key=lambda r: (r["doc_id"], r["packed"]))
    chains = [np.frombuffer(r["packed"], np.float32).reshape(-1, N_FEATURES).astype(float) for r in sample]
    counts = np.array([len(c) for c in chains], np.int64)
    return fit(np.concatenate(chains) if chains else np.zeros((0, N_FEATURES)), counts, np.array([r["quality"] for r in sample], np.int64))


def add_scores(docs: DataFrame, crf: LineCRF, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` and a column `score_col` (0 to 1) for every row, by position: clashing or repeated ids do not matter."""
    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _texts(b.column(at))
            scores = np.concatenate([*(score_texts(crf, texts[part]) for part in batches_of(texts, most=512)), np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores)], names=[*b.schema.names, score_col])

    return docs.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 1500) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per input row.

    A null text is an empty one: a single empty line, scored as such. A null id is not held out.
    Equal texts get equal scores, whatever rows share their batch; so ties and repeated rows do.
    A very long text is scored whole, alone in its batch. Without usable labels every score is
    0.5. An empty table gives no rows. Only the two named columns are read; labels, language,
    source and id are never inputs of a score.
    """
    crf = train(docs, labels, id_col, text_col, max_docs)
    rows = add_scores(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), crf)
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
