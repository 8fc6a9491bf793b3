"""Very long texts: memory stays near the size of the text, results equal those of the plain form."""

import time
import tracemalloc

import numpy as np
import pytest

from tessella.llm import decontaminate, pii
from tessella.llm import quality_crf as crf


def model(seed=0):
    rng = np.random.default_rng(seed)
    return crf.LineCRF(rng.normal(size=3 * crf.N_FEATURES + 3), rng.normal(size=(2, 2)) * 1.5)


def plain_scores(m, texts):
    own, counts, size = crf.line_features(texts)
    p, _, _ = m.marginals((crf.with_neighbours(own, counts) * m.weights).sum(axis=1), counts)
    begin = np.cumsum(counts) - counts
    return np.add.reduceat(p * (size + 1), begin) / np.add.reduceat(size + 1, begin)


@pytest.mark.parametrize("piece", [3, 100, 8192])
def test_blocks_of_a_chain_score_like_the_whole(monkeypatch, piece):
    monkeypatch.setattr(crf, "PIECE_LINES", piece)
    texts = [b"\n".join(b"Line %d of %d." % (i % 7, n) for i in range(n)) for n in (0, 1, 2, 63, 64, 65, 128, 129, 700)] + [b"", b"\n", b"a\n\nb"]
    for seed in range(3):
        assert crf.score_texts(model(seed), texts) == pytest.approx(plain_scores(model(seed), texts), abs=1e-12)
        assert [crf.score_texts(model(seed), [t])[0] for t in texts] == crf.score_texts(model(seed), texts).tolist()


def test_a_million_lines(monkeypatch):
    text = b"x\n" * 1_000_000
    began = time.time()
    score = crf.score_texts(model(), [text])[0]
    assert 0 < score < 1 and time.time() - began < 60
    tracemalloc.start()
    crf.score_texts(model(), [text[:400_000]])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000  # the features alone of 200,000 lines would be 86 MB, three times over


def test_one_disguise_in_twenty_megabytes():
    text = "some plain prose here " * 1_000_000 + "jane (at) example (dot) com​ now"
    tracemalloc.start()
    base, spans = pii.scan(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert base == [] and spans == [(22_000_000, 0, 22_000_027)]
    assert peak < 300_000_000


def test_origins_of_edits():
    text, origins = pii.fold("a​​b​с①")
    assert text == "abc1" and [origins.interval(i) for i in range(4)] == [(0, 1), (3, 4), (5, 6), (6, 7)]
    text, origins = pii.rewrite("x jane (at) example [dot] com, one two three four five six seven!")
    assert text == "x jane@example.com, 1234567!"
    source = "x jane (at) example [dot] com, one two three four five six seven!"
    assert ["".join(source[slice(*origins.interval(i))]) for i in (5, 6, 7, 14, 15)] == ["e", " (at) ", "e", " [dot] ", "c"]
    assert source[origins.interval(len(text) - 1)[0]] == "!"


@pytest.mark.parametrize("text", ["one two three four five six seven", "(eight dot eight dot eight dot eight)", "plus 49 one two three four five", "onetwothreefourfivesixseven", "aone two three four five six seven", "1 2 3 4 5 6 ſeven 8", "fünf fünf fünf fünf fünf fünf fünf", "_one 1 2 3 4 5 6 7", "é 1 two 3 4 5 6 7 8 9 ten one"])
def test_spelled_numbers_are_tried_at_every_place_where_they_can_begin(text):
    for pad in ("", "x", " ", "😀", "ß ", "prose " * 3):
        padded = pad + text
        assert [m.span() for m in pii.said(padded)] == [m.span() for m in pii._SAID.finditer(padded)]
        starts = list(pii.word_starts(padded, piece=5))
        assert starts == list(pii.word_starts(padded)) and set(m.start() for m in pii._SAID.finditer(padded)) <= set(starts)


def test_windows_of_a_repeated_word_leave_in_pieces(monkeypatch):
    items = decontaminate.Items([(1, "so " * 60), (2, "so " * 30 + "much " * 30)])
    monkeypatch.setattr(decontaminate, "PIECE_BYTES", 1 << 18)
    batch = decontaminate.pa.RecordBatch.from_pydict({"doc_id": [5], "text": ["so " * 20_000]})
    tracemalloc.start()
    sizes = [b.num_rows for b in decontaminate._windows(items, 0.8, 15)(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == 2 * (20_000 - 59) and max(sizes) < 2000  # each window, and its candidate beyond the radius
    assert peak < 60_000_000  # all windows at once have 1.1 million shingles and 4 MB of words
