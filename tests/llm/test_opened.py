"""Groups of suffixes that boundaries cut: what op7 compares across them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from gistmill.llm import substrings

from tests.llm.test_llm import removed_bytes

NAMES = ["_did", "_sub", "s", "l", "ctx", "known"]


def test_op7_opens_few_strings_of_a_group_that_is_cut(monkeypatch):
    """A passage in many documents, whose group fills many parts: strings that only one document has stay closed."""
    monkeypatch.setattr(substrings, "PART", 64)
    rng = np.random.default_rng(3)
    own = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    passage = own(150)
    texts = [(i, own(90) + passage + own(90)) for i in range(400)]
    rows = []
    for did, text in texts:
        data = text.encode()
        for p in substrings.sampled(data)[0].tolist():
            rows.append((did, 0, p, min(p, substrings.BEFORE), data[max(0, p - substrings.BEFORE) : p + substrings.LENGTH]))
    rows.sort(key=lambda r: (r[4][r[3] : r[3] + substrings.LEAD], *r[:3]))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["_did", "_sub", "pos", "l", "ctx"])
    said = [r for b in substrings._buckets(iter([batch])) for r in b.to_pylist()]
    ranges = [(r["_did"], r["s"], r["e"]) for r in said if r["ctx"] is None]
    first: dict[tuple, dict] = {}
    for r in sorted((r for r in said if r["ctx"] is not None), key=lambda r: (r["_did"], r["s"])):
        if first.setdefault((r["l"], r["ctx"]), r) is not r and len(r["ctx"]) >= substrings.LENGTH:
            ranges.append((r["_did"], r["s"] - r["l"], r["s"] - r["l"] + len(r["ctx"])))
    met = sorted(first.values(), key=lambda r: (r["ctx"][r["l"] :], r["_did"], r["s"]))
    types = dict(zip(NAMES, [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()], strict=True))
    ahead = [r for b in substrings._ahead(pa.RecordBatch.from_arrays([pa.array([r[n] for r in met[k : k + 50]], t) for n, t in types.items()], NAMES) for k in range(0, len(met), 50)) for r in b.to_pylist()]
    assert len(ahead) == len(met) > 400
    ahead.sort(key=lambda r: (r["back"], r["_did"], r["s"]))
    types |= {"a": pa.int32(), "back": pa.binary()}
    opened = [r for b in substrings._opened(iter([pa.RecordBatch.from_arrays([pa.array([r[n] for r in ahead], t) for n, t in types.items()], list(types))])) for r in b.to_pylist()]
    assert len(opened) < 4 * len(met)
    seen: dict[tuple, tuple] = {}
    for r in sorted(opened, key=lambda r: (r["_did"], r["s"])):
        if seen.setdefault((r["w1"], r["w2"]), (r["_did"], r["s"])) != (r["_did"], r["s"]):
            ranges.append((r["_did"], r["s"], r["s"] + substrings.LENGTH))
    late = {(d, k) for d, s, e in ranges for k in range(s, e)}
    want = removed_bytes(texts)
    assert [sum((d, k) in late for k in range(len(t))) for d, t in texts] == [want[d][1] for d, _ in texts]
    assert all(b"".join(bytes([x]) for k, x in enumerate(t.encode()) if (d, k) not in late) == want[d][3] for d, t in texts)
