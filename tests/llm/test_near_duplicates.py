"""The removal of near duplicates against all pairs, where few candidates a fingerprint lose some."""

import numpy as np

import corpus_pipeline
from demandlake.llm import simhash
from demandlake.llm.common import Workspace
from tests.llm.test_operators import groups_of


def check(work, spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets = [simhash.shingle_set(t.encode(), 5) for t in texts]
    near = [(a, b) for a in range(len(texts)) for b in range(a) if simhash.jaccard(sets[a], sets[b]) >= 0.8]
    kept = sorted(r.doc_id for r in simhash.drop_near_duplicates(work, frame).collect())
    assert kept == sorted(set(groups_of(len(texts), near)))
    return len(near)


def test_texts_of_one_fingerprint_are_all_compared(work, spark):
    texts = []
    for g in range(12):  # a repeated phrase is over half of the word pairs, so all have its fingerprint
        tail = [f"t{g}_{i}" for i in range(60)]
        texts += [" ".join(["a"] * 80 + tail), " ".join(["a"] * 80 + tail[:-1] + ["other"])]
    assert len({simhash.fingerprint(t.encode(), 2) for t in texts}) == 1
    assert check(work, spark, texts) == 12


def test_closer_fingerprints_that_are_not_similar_hide_no_pair(work, spark, monkeypatch):
    monkeypatch.setattr(simhash, "SETS_BLOCK", 8)  # so that large groups are compared in blocks
    rng = np.random.default_rng(8)
    blocks, texts = [[f"b{i}_{j}" for j in range(10)] for i in range(40)], []
    for g in range(60):  # the order of blocks changes one word pair in ten, but four shingles in ten
        words = [w for i in rng.permutation(40) for w in blocks[i]]
        texts += [" ".join(words), " ".join([*words[:360], *(f"x{g}_{i}" for i in range(40))])]
    assert check(work, spark, texts) == 60


def test_every_pair_at_the_limit_is_found(work, spark):
    texts = []
    for g in range(150):
        words = [f"w{g}_{i}" for i in range(60)]
        texts += [" ".join(words), " ".join([*words[:54], *(f"x{g}_{i}" for i in range(6))])]
    assert check(work, spark, texts) == 150


def test_the_pipeline_finds_copies_by_fingerprint_and_checks_them(work, spark, monkeypatch):
    texts = []
    for g in range(20):  # a word of 400 moves few bits of a fingerprint
        words = [f"w{g}_{i}" for i in range(400)]
        texts += [" ".join(words), " ".join([*words[:200], "other", *words[201:]]), " ".join([*words[:-1], "last"])]
    for g in range(5):  # one fingerprint, few shingles in common
        texts.append(" ".join(["a"] * 80 + [f"t{g}_{i}" for i in range(60)]))
    frame = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    codes = [simhash.fingerprint(t.encode(), 4) for t in texts]
    near = [(a, b) for a in range(len(texts)) for b in range(a) if (codes[a] ^ codes[b]).bit_count() <= 4]
    sets = [simhash.shingle_set(t.encode(), 5) for t in texts]
    alike = [(a, b) for a, b in near if simhash.jaccard(sets[a], sets[b]) >= 0.8]
    assert len(near) - len(alike) == 10 and len(alike) > 10
    whole = sorted(r.doc_id for r in corpus_pipeline.drop_copies(spark, frame, "").collect())
    assert whole == [*range(0, 60, 3), *range(60, 65)]
    none = spark.createDataFrame([], "centre long, member long")
    monkeypatch.setattr(simhash, "_meetings", lambda *_: none)  # fingerprints alone
    alone = sorted(r.doc_id for r in corpus_pipeline.drop_copies(spark, frame, "").collect())
    assert len(whole) <= len(alone) < len(texts) and set(range(60, 65)) <= set(alone)
    assert set(range(60)) - set(alone) <= {max(p) for p in alike} | {min(p) for p in alike}


class Counted(Workspace):
    """Counts the rows of what is written."""

    def write(self, df, name):
        out = super().write(df, name)
        self.rows = getattr(self, "rows", {}) | {name: out.count()}
        return out


def test_texts_with_rare_words_do_not_meet_by_frequent_ones(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(str(rng.choice(["of", "the", "and", "in", "to", "is"])) if rng.random() < 0.6 else f"r{g}_{i}" for i in range(200)) for g in range(400)]
    work = Counted(spark, "test")
    assert check(work, spark, texts) == 0
    assert work.rows["met"] == 0


def test_sets_that_meet_at_many_centres_are_compared_once(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SAMPLE_LEAST", 1000)  # no order but that of hashes
    words = [f"a{i}" for i in range(100)]
    texts = [" ".join(words), " ".join([*words[:90], *(f"b{i}" for i in range(10))])]
    for g in range(60):  # one shingle of the two texts, and words of its own
        own = [f"c{g}_{i}" for i in range(95)]
        texts.append(" ".join([*own[:40], *words[g : g + 5], *own[40:]]))
    work = Counted(spark, "test")
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = sorted(r.doc_id for r in simhash.drop_near_duplicates(work, frame, similarity=0.6).collect())
    assert kept == [0, *range(2, 62)]
    assert work.rows["known"] == 0 and work.rows["met"] > 10  # at several centres
    assert work.rows["possible"] == 2
