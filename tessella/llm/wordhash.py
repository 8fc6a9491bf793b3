"""Word and shingle hashes of many texts at once, and SimHash majorities."""

from __future__ import annotations

import numpy as np

from .common import SPACES

#: Bytes of a word: letters, digits and all of a longer UTF-8 sequence; or all but white space.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[list(SPACES)] = False
_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Bytes of words hashed at once, and runs of 255 hashes counted at once: bounds of the arrays made in between.
PIECE_BYTES, PIECE_RUNS = 1 << 18, 1 << 10


def batches_of(texts: list[bytes], most_bytes: int = 1 << 20, most: int = 1000) -> list[slice]:
    """Consecutive slices of `texts` of at most `most` texts and, but for a single longer text, `most_bytes` bytes."""
    out, start, held = [], 0, 0
    for i, t in enumerate(texts):
        if i > start and (i - start == most or held + len(t) > most_bytes):
            out.append(slice(start, i))
            start, held = i, 0
        held += len(t)
    return [*out, slice(start, len(texts))] if texts else []


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


class Words:
    """Words (runs of `word` bytes) of several texts, hashed together without a Python loop."""

    def __init__(self, texts: list[bytes], word: np.ndarray = ALNUM) -> None:
        self.buffer = b"\n".join([*texts, b""])
        x = np.frombuffer(self.buffer, np.uint8)
        inside = np.concatenate([[False], word[x], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.begin, self.end = edge[::2], edge[1::2]
        size = self.end - self.begin
        power = np.cumprod(np.full(int(size.max(initial=0)) + 1, _MUL))
        upto = np.concatenate([[0], np.cumsum(size)])
        parts, at = [np.zeros(0, np.uint64)], 0
        while at < len(size):
            to = max(at + 1, int(np.searchsorted(upto, upto[at] + PIECE_BYTES, side="right")) - 1)
            mine = size[at:to]
            begin = upto[at:to] - upto[at]
            off = np.arange(upto[to] - upto[at]) - np.repeat(begin, mine)
            here = x[self.begin[at] : self.end[to - 1]]
            parts.append(np.add.reduceat((here[word[here]].astype(np.uint64) + np.uint64(1)) * power[off], begin))
            at = to
        self.hash = _mix(np.concatenate(parts))
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.upto = np.searchsorted(self.begin, ends)  # words before the end of each text
        self.first = np.concatenate([[0], self.upto]).astype(np.int64)[:-1]

    def shingles(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; the last k - 1 run into the next text."""
        n = max(0, len(self.hash) - k + 1)
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h = _mix(h * _MUL + self.hash[j : j + n])
        return h

    def text(self, i: int, n: int) -> str:
        return " ".join(self.buffer[a:b].decode(errors="replace") for a, b in zip(self.begin[i : i + n].tolist(), self.end[i : i + n].tolist(), strict=True))


#: byte -> eight 8-bit lanes, one for each bit of the byte
_LANES = sum((((np.arange(256) >> i) & 1).astype(np.uint64) << np.uint64(8 * i)) for i in range(8))


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive runs of `sizes` hashes: a bit is 1 if set in over half of a run."""
    out = np.zeros(len(sizes), np.uint64)
    live = np.flatnonzero(sizes)
    if not len(live):
        return out
    sizes, begin = sizes[live], np.cumsum(sizes[live]) - sizes[live]
    per = -(-sizes // 255)  # lanes hold sums up to 255
    first = np.cumsum(per) - per
    cuts = np.repeat(begin, per) + 255 * (np.arange(per.sum()) - np.repeat(first, per))
    ends = np.append(cuts[1:], begin[-1] + sizes[-1])
    counts = np.zeros((len(sizes), 64), np.int64)
    owner = np.repeat(np.arange(len(sizes)), per)
    for a in range(0, len(cuts), PIECE_RUNS):
        b = min(len(cuts), a + PIECE_RUNS)
        lanes = np.add.reduceat(_LANES[hashes[cuts[a] : ends[b - 1]].view(np.uint8).reshape(-1, 8)], cuts[a:b] - cuts[a], axis=0)
        mine = owner[a:b]
        change = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        counts[mine[change]] += np.add.reduceat(lanes.view(np.uint8).reshape(-1, 64).astype(np.int64), change, axis=0)
    bits = (2 * counts > sizes[:, None]).astype(np.uint8)
    out[live] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out
