"""The quality model learns from whole texts."""

import numpy as np
from pyspark.sql import functions as F

from panelspark.llm import quality


def test_learns_from_what_comes_late(spark):
    rng = np.random.default_rng(4)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    same = [" ".join(rng.choice(words, 1800)) for _ in range(120)]  # over 8,000 bytes
    good = [t + " " + " ".join(rng.choice(words, 1800)) for t in same[:60]]
    bad = [t + " " + " ".join(rng.choice(["$$$", "click!!", "WIN", "%%%"], 1800)) for t in same[60:]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert b"click!!" in model.bad and b"click!!" not in model.good
    held = quality.score(docs, model).where(quality.held_out(F.col("doc_id"))).collect()
    assert len(held) > 10 and all((r.score >= 0.5) == (r.doc_id < 60) for r in held)
    t = bytes(range(97, 123)) * 1000
    assert quality._pieces(t, 600).startswith(t[:150]) and quality._pieces(t, 600).endswith(t[-150:])
