"""Words of texts as columns, against the pattern of words applied text by text."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from gistmill.llm import pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
PARTS = ["a", "b", "Zé", " ", "  ", "▁", "\n", ".", ",", "!", "1", "中", "_", "ª", "𐐀", "\U00031350", "Ᲊ", "ͣ", "​", "-", "\t", "and", "the "]


def texts_of(rng):
    return [None if rng.random() < 0.05 else "".join(PARTS[k] for k in rng.integers(0, len(PARTS), rng.integers(0, 14))) for _ in range(rng.integers(0, 9))]


def words_of(m, text):
    return [w for c in m.chunks(text or "") for w in m.word.findall(pieces.SPACE + c)]


def test_op5_words_equal_the_pattern():
    m = pieces.Model.load(MODEL)
    rng = np.random.default_rng(11)
    for _ in range(1500):
        texts = texts_of(rng)
        want = [words_of(m, t) for t in texts]
        got = m.tally(pa.array(texts, pa.string()))
        assert dict(zip(*(c.to_pylist() for c in got.columns), strict=True)) == Counter(w for ws in want for w in ws)
        every = sorted({w for ws in want for w in ws})
        often = [w for w in every if rng.random() < 0.5]
        s = m.spelling(pa.array(texts, pa.large_string()), pa.array(often, pa.large_string()))
        rare = s.rare.to_pylist()
        names = often + rare
        assert [[names[k] for k in s.sequence[a:b]] for a, b in zip(s.ends, s.ends[1:], strict=False)] == want
        pairs = [(d, w) for d, ws in enumerate(want) for w in dict.fromkeys(ws) if w not in often]
        assert list(zip(s.text.tolist(), [rare[k] for k in s.word], strict=True)) == pairs


def test_op5_words_of_letters_need_no_call_each(monkeypatch):
    """Chunks of letters alone, or with a mark behind them, are cut and looked up as columns."""
    m = pieces.Model.load(MODEL)
    called = []
    words = pieces.Model.words
    monkeypatch.setattr(pieces.Model, "words", lambda self, chunk: called.append(chunk) or words(self, chunk))
    for run in m.tally, lambda t: m.spelling(t.cast(pa.large_string()), pa.array(["▁the", ","], pa.large_string())):
        called.clear()
        run(pa.array(["the élan, of the sea.", "x2 and, sea\nshore the"] * 50))
        assert sorted(called) == ["sea\nshore", "x2"]
