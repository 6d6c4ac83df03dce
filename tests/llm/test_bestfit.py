"""Vector best fit against the plain rule, and packed documents against their ids."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from demandlake.llm import bestfit, queries, tokens
from demandlake.llm.bestfit import Capacity
from demandlake.llm.common import Workspace, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SMALL = "/root/testdata/sf0.001"


def plain(lengths, capacity, measure):
    """The same choice with every open sequence looked at, and none closed."""
    need, most = bestfit.needs(lengths), capacity.vector()
    weight = bestfit.weights(need, capacity)
    order = sorted(range(len(lengths)), key=lambda i: (-(need[i] / most) @ weight, -lengths[i], i))
    rooms, where = [], {}
    for i in order:
        fits = [k for k, r in enumerate(rooms) if (r >= need[i]).all()]
        if fits:
            if measure == "norm":
                k = min(fits, key=lambda k: (np.square((rooms[k] - need[i]) / most) @ weight, k))
            else:
                k = min(fits, key=lambda k: (-(rooms[k] / most * (need[i] / most)) @ weight, k))
        else:
            k = len(rooms)
            rooms.append(most.copy())
        where[i] = (k, int(most[0] - rooms[k][0]))
        rooms[k] = rooms[k] - need[i]
    return [where[i] for i in range(len(lengths))]


CAPACITIES = [Capacity(100), Capacity(100, pieces=3), Capacity(100, attention=3600), Capacity(100, pieces=5, attention=4000)]


@pytest.mark.parametrize("capacity", CAPACITIES)
@pytest.mark.parametrize("measure", ["norm", "dot"])
def test_places_are_those_of_the_plain_rule(capacity, measure):
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 40, 700):
        lengths = np.minimum(rng.integers(1, rng.integers(2, 101, n) + 1, n), capacity.longest()) if n else np.empty(0, np.int64)
        sequence, offset = bestfit.place(lengths, capacity, measure)
        assert list(zip(sequence.tolist(), offset.tolist(), strict=True)) == plain(lengths, capacity, measure)
        use = np.zeros((n, 3))
        np.add.at(use, sequence, bestfit.needs(lengths))
        assert (use <= capacity.vector()).all()


def test_little_is_left_empty():
    rng = np.random.default_rng(5)
    lengths = np.clip(rng.lognormal(6, 1.1, 5000).astype(int), 1, 4096)
    for measure in ("norm", "dot"):
        sequence, _ = bestfit.place(lengths, Capacity(), measure)
        assert sequence.max() + 1 <= 1.01 * lengths.sum() / 4096 + 1
    sequence, _ = bestfit.place(np.full(50, 10), Capacity(4096, pieces=7), "norm")
    assert sequence.max() + 1 == 8  # 50 pieces, 7 a sequence


def test_weights_are_the_shares_asked_for():
    lengths = np.array([50, 30, 20])
    assert bestfit.weights(bestfit.needs(lengths), Capacity(100)).tolist() == [1, 0, 0]
    both = bestfit.weights(bestfit.needs(lengths), Capacity(100, pieces=2))
    assert np.allclose(both, [1 / 2.5, 1.5 / 2.5, 0])
    assert Capacity(4096, attention=2048**2 + 5).longest() == 2048


def whole(rows, length):
    """Checks offsets and room; gives documents' rows in order."""
    of, held = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return of, len(held)


def test_query_holds_each_id_once(spark):
    rows = queries.op13_best_fit(spark, SMALL).collect()
    of, n = whole(rows, 4096)
    docs = {r.doc_id: r.text or "" for r in table(spark, SMALL, "documents").collect()}
    plain_tokenizer = Tokenizer.from_file(TOKENIZER)
    assert set(of) == set(docs)
    for doc_id, text in docs.items():
        ids = np.array([*plain_tokenizer.encode(text, add_special_tokens=False).ids, 1], np.uint32)
        got = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in of[doc_id])
        cuts = [ids[a : a + 4096] for a in range(0, len(ids), 4096)]
        assert got == [(i, 4096 * i, len(c), zlib.crc32(c.tobytes())) for i, c in enumerate(cuts)]
    total = sum(r.length for r in rows)
    assert n <= -(-total // 4096) + 1


def test_odd_rows(spark):
    long = "palabra larga " * 100_000
    rows = [(1, None), (2, ""), (None, "uno"), (3, " \n\t"), (4, long), (4, long)] + [(5, "igual y corto")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"piece": F.lit("x"), "start": F.lit("y"), "_group": F.lit("z")})
    packed = bestfit.pack(Workspace(spark, "odd"), docs.repartition(3), TOKENIZER, Capacity(4096, pieces=50, attention=2000**2), group_pieces=64, with_ids=True)
    rows = packed.collect()
    of, _ = whole(rows, 4096)
    assert [r.length for i in (1, 2, 3) for r in of[i]] == [1, 1, 1] and len(of[5]) == 500 and len(of[None]) == 1
    assert all(r.start == 2000 * r.piece and len(r.ids) == 4 * r.length for r in rows)
    groups = {r.sequence_id >> 32 for r in of[5]}
    assert len(groups) > 4  # equal rows are spread
    per = defaultdict(list)
    for r in rows:
        per[r.sequence_id].append(r.length)
    assert max(map(len, per.values())) <= 50 and max(sum(n * n for n in v) for v in per.values()) <= 2000**2
    assert bestfit.pack(Workspace(spark, "empty"), docs.limit(0), TOKENIZER).count() == 0


def test_ids_stay_the_same_when_words_are_forgotten(monkeypatch, spark):
    texts = [r.text or "" for r in table(spark, SMALL, "documents").collect()] + ["Don't! “quoted” ﬁne <|endoftext|>x İß it's\ta  b" * 3, "x" * 5000]
    want = [e.ids for e in Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(tokens, "KNOWN", 300)
    monkeypatch.setattr(tokens, "PART_CHARS", 1000)
    encoder = tokens.Encoder(TOKENIZER)
    for at in range(0, len(texts), 7):
        assert [x.tolist() for x in encoder.encode(texts[at : at + 7])] == want[at : at + 7]
    assert [encoder.encode_text(t).tolist() for t in texts] == want
    assert encoder.encode_text("").tolist() == []
