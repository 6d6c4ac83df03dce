"""Chosen positions at the ends of texts, and entries that are made a little text at a time."""

import numpy as np

from demandlake.llm import passages


def test_positions_lie_in_strings_of_their_text():
    rng = np.random.default_rng(1)
    for _ in range(200):
        sizes = rng.integers(0, 130, rng.integers(1, 8))
        sizes[rng.integers(len(sizes))] = 0  # an empty text, now and then the first
        texts = [rng.integers(97, 100, n).astype(np.uint8).tobytes() for n in sizes]
        found, _ = passages.anchors(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes))
        want, base = set(), 0
        for text in texts:
            place, _ = passages.anchors(np.frombuffer(text, np.uint8), np.array([len(text)]))
            want |= {base + p for p in place.tolist()}
            base += len(text)
        assert set(found.tolist()) == want


def test_repeats_are_found_whatever_is_made_at_once(spark, monkeypatch):
    from demandlake.llm.common import Workspace

    rng = np.random.default_rng(2)
    line = "".join(chr(c) for c in rng.integers(97, 123, 70))
    rows = [(0, "")] + [(i, ("" if i % 3 else f"{i} head ") + line + f" tail {i} " + line[:55]) for i in range(1, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    keys = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    want = sorted(map(tuple, passages.remove_repeats(Workspace(spark, "one"), docs).select(*keys).collect()))
    monkeypatch.setattr(passages, "SHIP_BYTES", 200)
    monkeypatch.setattr(passages, "TASK_BYTES", 4096)
    got = sorted(map(tuple, passages.remove_repeats(Workspace(spark, "two"), docs).select(*keys).collect()))
    assert got == want and sum(r[2] for r in got) > 58 * 120
