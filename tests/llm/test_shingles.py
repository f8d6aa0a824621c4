import numpy as np
import pyarrow as pa
import pytest

from placebook.llm import shingles


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(blank, " ")
    return [word for word in lowered.split(" ") if word]


def plain(text):
    words = words_of(text)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


TEXTS = [None, "", "a", "A b c d", "a b c d e", "a  b\tc\nd e F g a b c d e f", " é x É ab ba ", "x" * 5000, "ab " * 400, "a b c d", "b a c d", "word", "a\x1cb c"]


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_equal_shingles_have_equal_hashes_and_others_not(monkeypatch, block):
    monkeypatch.setattr(shingles, "BLOCK", block)
    seen = {}
    for text, found in zip(TEXTS, shingles.shingle_sets(pa.array(TEXTS))):
        assert len(found) == len(plain(text)) and np.all(found[1:] > found[:-1])
        for other, others in seen.items():
            assert len(np.intersect1d(found, others)) == len(plain(text) & plain(other))
        seen[text] = found


def test_slices_hold_every_row(monkeypatch):
    monkeypatch.setattr(shingles, "SLICE", 50)
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS)], ["text"])
    assert [t for part in shingles.slices(batch, "text") for t in part["text"].to_pylist()] == TEXTS
    parts = [shingles.shingle_sets(part["text"]) for part in shingles.slices(batch, "text")]
    assert [s.tolist() for part in parts for s in part] == [s.tolist() for s in shingles.shingle_sets(pa.array(TEXTS))]


def test_sums_wrap_without_a_clash():
    words = [f"w{i}" for i in range(200_000)]
    data, offsets = shingles.buffer_of(pa.array([" ".join(words)]))
    hashes, starts = shingles.word_hashes(data, offsets)
    assert len(set(hashes.tolist())) == len(words) and starts.tolist() == [0, len(words)]
