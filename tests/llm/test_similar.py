"""Near copies are decided by shingle sets, not by fingerprints alone."""

import numpy as np
import pytest

import corpus_pipeline
from panelspark.llm import simhash, similar


def _jaccard(a, b):
    a, b = set(a.tolist()), set(b.tolist())
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_dedup_checks_similarity(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 5000, 120)]
    texts = [" ".join(base)]
    for cuts in [1] * 20 + [2, 3, 4, 5, 6, 7, 8] * 5:  # few words changed: 0.92 to 0.5 of the five-word shingles stay
        w = list(base)
        for k in rng.choice(120, cuts, replace=False):
            w[k] = f"x{rng.integers(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(f"v{k}" for k in rng.integers(0, 5000, 60)) for _ in range(40)]
    sets, fps = [similar.shingle_set(t, 5) for t in texts], [simhash.fingerprint(t, 2, True) for t in texts]
    label = list(range(len(texts)))
    wrong = 0
    for i in range(len(texts)):
        for j in range(i):
            if _jaccard(sets[i], sets[j]) >= 0.8:
                assert bin(fps[i] ^ fps[j]).count("1") <= similar.FAR_BITS
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
            else:
                wrong += bin(fps[i] ^ fps[j]).count("1") <= 9
    assert wrong > 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (512, 8):
        monkeypatch.setattr(similar, "BLOCK", block)
        monkeypatch.setattr(similar, "PIVOTS", 2)
        got = {r.doc_id: r.first_id for r in similar.near_copies(docs, 9, 2).collect()}
        assert got == dict(enumerate(label))
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept == sorted(set(label))


@pytest.mark.parametrize("words", [15, 20, 30, 60, 120, 400, 1000])
def test_candidates_just_above_the_threshold(words):
    """Of pairs of a similarity of 0.80 to 0.85, by words appended, cut or replaced: how many the search looks at."""
    rng = np.random.default_rng(words)
    found = total = near = 0
    while total < 150:
        base = [f"w{k}" for k in rng.integers(0, 50_000, words)]
        other, kind = list(base), rng.integers(3)
        n = int(rng.integers(1, max(2, words // 5)))
        if kind == 0:
            other += [f"x{k}" for k in rng.integers(0, 50_000, n)]
        elif kind == 1:
            at = int(rng.integers(0, words - n))
            del other[at : at + n]
        else:
            for k in rng.choice(words, max(1, n // 4), replace=False):
                other[k] = f"x{rng.integers(10**6)}"
        texts = " ".join(base), " ".join(other)
        a, b = (similar.shingle_set(t, 5) for t in texts)
        if 0.8 <= _jaccard(a, b) < 0.85:
            total += 1
            bits = bin(simhash.fingerprint(texts[0], 2, True) ^ simhash.fingerprint(texts[1], 2, True)).count("1")
            near += bits <= similar.FAR_BITS
            found += bits <= corpus_pipeline.NEAR_BITS or bool(set(similar.bands(a)) & set(similar.bands(b)))
    assert found >= 0.95 * total and near >= 0.99 * total, (found, near, total)


def test_bands_of_empty_and_equal_sets():
    assert similar.bands(similar.shingle_set(None, 5)) == similar.bands(similar.shingle_set(" \n", 5)) == []
    long = similar.shingle_set(" ".join(map(str, range(10_000))), 5)
    assert similar.bands(long) == similar.bands(long[:]) and len(similar.bands(long)) == similar.BANDS
