"""SimHash, decontamination, substring dedup, quality and packing against brute force, edges included."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from panelspark.llm import components, decontaminate, packing, quality, simhash, substring
from panelspark.llm.common import scratch
from panelspark.llm.queries import tokenizer_path


def fixture_docs(spark, n=250):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(n)


def brute_components(fps, ids, distance):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= distance:
                x, y = find(ids[a]), find(ids[b])
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def brute_fingerprint(text, n=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize(("distance", "shingle"), [(2, 3), (9, 2)])
def test_simhash_components(spark, awkward, distance, shingle):
    docs = awkward.select("doc_id", "text").where("doc_id is not null").union(fixture_docs(spark).select(F.col("doc_id") + 100, "text"))
    rows = docs.collect()
    got = simhash.near_duplicates(docs, distance, shingle).collect()
    assert len(got) == len(rows)
    fps = {r.doc_id: brute_fingerprint(r.text, shingle) for r in rows}
    assert all(r.fp & (1 << 64) - 1 == fps[r.doc_id] for r in got)
    ids = sorted(fps)
    want = brute_components([fps[i] for i in ids], ids, distance)
    assert {r.doc_id: r.component_id for r in got} == want


def test_simhash_edges(spark, awkward):
    got = simhash.near_duplicates(awkward)
    assert got.columns == ["doc_id", "fp", "component_id"] and got.count() == awkward.count()
    assert {r.component_id for r in got.where("doc_id is null").collect()} == {1, 3}
    assert simhash.near_duplicates(awkward.limit(0)).count() == 0


def test_allocate_keeps_the_pigeonhole():
    for costs, d in (([[0, 1, 2, 3]] * 3, 2), ([[0, 5, 6, 7], [0, 1, 1, 1], [0, 9, 9, 9]], 2), ([[0, 1, 4, 9, 16, 25]] * 4, 7)):
        t = simhash.allocate([list(map(float, c)) for c in costs], d)
        assert sum(x + 1 for x in t) == d + 1
    groups = simhash.group_bits(4, np.full((64, 64), 2.0), 3)
    assert sorted(b for g in groups for b in g) == list(range(64))


def test_components_of_a_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 100), (7, 6), (None, 3)], "u long, v long")
    got = {r.node: r.component for r in components.connected_components(e).collect()}
    assert got == dict.fromkeys(range(1, 41), 1)


def brute_hits(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12)):
            if w:
                windows.setdefault(tuple(w[k : k + 13]), set()).update([] if i is None else [str(i)])
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[x]
        out.append((d, len(w), len(hit), tuple(sorted(found)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_decontamination(spark, awkward, monkeypatch):
    items = [(1, "Jumps OVER the lazy-dog while seven small birds sing in a very old tree"), (2, "quick brown"), (3, "word"), (4, None), (5, "--"), (6, "birds sing in a very old tree near the quiet river bank today"), (6, "word"), (None, "lazy dog"), (8, "été NAÏVE")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_words int")
    docs = awkward.union(awkward.sparkSession.createDataFrame(fixture_docs(spark).collect(), fixture_docs(spark).schema).select(*[F.col(c) if c in ("doc_id", "text", "lang", "source", "n_chars") else F.lit(None).cast(t).alias(c) for c, t in awkward.dtypes]))
    want = brute_hits([(r.doc_id, r.text) for r in docs.collect()], items)
    stored = docs.persist()
    for block in (100_000, 12):
        monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
        got = decontaminate.decontaminate(stored, bench)
        assert got.columns == ["doc_id", "n_words", "items", "n_hit", "contaminated"]
        assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got.collect()), key=repr) == want
    assert decontaminate.decontaminate(stored, bench.limit(0)).where("contaminated or n_hit > 0").count() == 0
    assert decontaminate.decontaminate(stored.limit(0), bench).count() == 0


def brute_cut(rows):
    seen, out = {}, []
    words = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - 12):
            if i is not None:
                x = tuple(w[k : k + 13])
                seen[x] = min(seen.get(x, i), i)
    for i, w in words:
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and seen[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=repr)


def test_substring_dedup(spark, awkward):
    docs = awkward.select("doc_id", "text").union(fixture_docs(spark).select(F.col("doc_id") + 100, "text"))
    want = brute_cut([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r[2] for r in want) > 100
    for batches in (1, 3):
        got = substring.dedup_substrings(docs, batches, buckets=8)
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()), key=repr) == want


def _cut_rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=repr)


def test_substring_word_hashes():
    """Equal words hash alike, different ones apart in both halves, whatever their length and place; words as by split()."""
    rnd = random.Random(5)
    texts = [" ".join("".join(rnd.choice("abé\t ") for _ in range(rnd.choice([1, 7, 8, 9, 16, 17, 256, 257, 600]))) for _ in range(40)) for _ in range(60)]
    texts += ["".join(f"a{chr(i)}b" for i in range(300)), None, "", "a", "b", " ", "c"]
    for skip in (0, 3, len(texts)):
        group = substring._Group(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}).slice(skip))
        group.hash()
        words = [w for d in group.words() for w in d]
        for half in (group.hashes, group.others):
            of = dict(zip(words, half.tolist(), strict=True))
            assert [of[w] for w in words] == half.tolist() and len(set(of.values())) == len(of)


def test_substring_hot_and_extra(spark, awkward, monkeypatch):
    rows = [(i, f"own{i} " * 3 + " ".join(f"common{k}" for k in range(30)) + f" tail{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert _cut_rows(substring.dedup_substrings(docs, 2, buckets=8)) == brute_cut(rows)
    monkeypatch.setattr(substring, "GROUP_BYTES", 500)  # many groups share a passage
    monkeypatch.setattr(substring, "FILE_BYTES", 4000)
    assert _cut_rows(substring.dedup_substrings(docs, 2, buckets=8)) == brute_cut(rows)
    keep = tuple(c for c in awkward.columns if c not in ("doc_id", "text"))
    out = substring.dedup_substrings(awkward.withColumn("kept_", F.lit(1)), 2, with_text=True, keep=(*keep, "kept_"), buckets=8)
    assert out.count() == awkward.count() and {"n_words", "n_words_", "kept_", "kept__", "text", "lang"} <= set(out.columns)
    assert substring.dedup_substrings(awkward.limit(0)).count() == 0
    assert substring.dedup_substrings(awkward.where("doc_id in (4, 6)")).where("n_removed > 0").count() == 0


def test_substring_index_is_kept(spark, awkward):
    """Later calls on one index give what one call over the union gives."""
    rows = [(r.doc_id, r.text) for r in awkward.where("doc_id is not null").select("doc_id", "text").union(fixture_docs(spark, 120).select(F.col("doc_id") + 100, "text")).collect()]
    want = brute_cut(rows)
    index, got = scratch(spark, "kept-index"), []
    for low, high in ((0, 8), (8, 150), (150, 10**6)):
        part = [r for r in rows if low <= r[0] < high]
        docs = spark.createDataFrame(part, "doc_id long, text string").coalesce(2)
        got += _cut_rows(substring.dedup_substrings(docs, 2, buckets=4, index=index))
    assert sorted(got, key=repr) == want and sum(r[2] for r in want) > 100
    again = spark.createDataFrame([(r[0], r[1]) for r in rows[:3]], "doc_id long, text string")  # the same ids once more
    left = [(r.doc_id, r.n_words, r.n_removed) for r in substring.dedup_substrings(again, index=index).collect() if r.n_words > 12 and r.n_removed < r.n_words]
    assert not left
    tree = substring.FingerprintIndex(spark, index, 1)
    assert tree.state.calls == 4
    plan = tree.probed(spark.createDataFrame([], substring.BLOBS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange" not in plan.split(":- ")[1].split("+- Sort")[0] and "Bucketed: true" in plan  # the batch alone is dealt
    assert "Exchange" not in tree._history(tree.state.runs).groupBy("bucket").applyInArrow(substring._compacted, substring.FOUND)._jdf.queryExecution().executedPlan().toString()
    tree.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("panelspark_run")]


def test_quality(spark, awkward):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, labels)
    ids = [r[0] for r in docs.select("doc_id").collect()]
    held = {r.doc_id: r.h for r in docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("h")).collect()}
    assert held == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in ids}
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(docs, flipped) == model  # held-out labels are never read
    s = quality.score(docs, model).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).toPandas()
    good, bad = s[s.quality == 1].score, s[s.quality == 0].score
    assert np.mean([[(g > b) + (g == b) / 2 for b in bad] for g in good]) > 0.9
    assert (good >= 0.3).mean() > 0.95
    out = quality.score(awkward, model)  # a column named score gives way
    assert out.count() == awkward.count() and out.where("score is null or score < 0 or score > 1").count() == 0 and out.columns.count("score") == 1
    none = quality.fit(docs, labels.limit(0))
    assert quality.score(docs.limit(5), none).where("score = 0.5").count() == 5
    assert quality.score(docs.limit(0), model).count() == 0


def brute_pieces(text, t):
    ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
    first = len(ids) % 2048 or 2048
    cuts = [0, *range(first, len(ids) + 1, 2048)]
    return [(a, z - a, zlib.crc32(ids[a:z].tobytes())) for a, z in zip(cuts, cuts[1:])]


def test_packing(spark, awkward):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    special = spark.createDataFrame([(50, "plain words <|endoftext|> and more")], "doc_id long, text string")
    docs = awkward.select("doc_id", "text").union(fixture_docs(spark).select(F.col("doc_id") + 100, "text")).union(special)
    assert 50256 in t.encode(special.first()["text"], add_special_tokens=False).ids
    got = packing.pack_documents(docs, tokenizer_path()).toPandas()
    want = sorted((p for r in docs.collect() for p in brute_pieces(r.text, t)))
    assert sorted(zip(got.start, got.length, got.ids_crc32)) == want
    used = 0
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048
        used += 1
    least = -(-got.length.sum() // 2048)
    assert used <= least * 1.02 + 1
    assert packing.pack_documents(docs.limit(0), tokenizer_path()).count() == 0
    with_ids = packing.pack_documents(docs.where("doc_id = 1"), tokenizer_path(), with_ids=True).first()
    assert zlib.crc32(np.array(with_ids["ids"], "<u4").tobytes()) == with_ids.ids_crc32


def test_runs_that_the_fast_coder_refuses():
    enc = packing.Encoder(tokenizer_path())
    for text in ("x" + " " * 1_100_000 + "y", "\n" * 1_000_000, "a" * 1_000_000):
        assert enc.encode(text) == np.array(enc.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_configurations_cover():
    rng = np.random.default_rng(1)
    natural = np.unique(np.clip(np.exp(rng.normal(5.8, 1.1, 20_000)), 1, 2048).astype(int), return_counts=True)
    for h in (
        {}, {2048: 5}, {1: 3}, {1025: 10, 1023: 9}, {int(k): int(rng.integers(1, 2000)) for k in rng.integers(1, 2049, 300)},
        dict(zip(map(int, natural[0]), map(int, natural[1]))), {980: 60_000, 600: 60_000, 400: 60_000}, {1100: 10**9, 950: 10**9, 2048: 10**12},
    ):
        plan = packing.configurations(h)
        got = {}
        for c, times in plan:
            assert sum(n * k for n, k in c.items()) <= 2048 and times > 0
            for n, k in c.items():
                got[n] = got.get(n, 0) + k * times
        assert got == h
        part = packing.solve(h)
        if part is not None:
            assert part.bound <= part.cost <= 1.02 * part.bound + 1
            assert part.bound - 1e-6 <= sum(t for _, t in plan) <= 1.02 * part.bound + 2


def test_bound_is_below_the_best_packing():
    for h, best in (({1200: 7, 800: 7, 900: 1}, 8), ({700: 6}, 3), ({1500: 3, 500: 3, 48: 3}, 3), ({1025: 4, 1024: 2}, 5)):
        part = packing.solve(h)
        assert part.bound <= best + 1e-6
        assert sum(t for _, t in packing.configurations(h)) == best


def test_winnowing_keeps_a_minimum_once(spark):
    df = spark.createDataFrame([([5, 5, 3, 3, 3, 9],), ([],), ([7],)], "_min array<bigint>")
    got = [[tuple(x) for x in r._won] for r in decontaminate.with_winnowed(df).collect()]
    assert got == [[(0, 1, 5), (2, 4, 3), (5, 5, 9)], [], [(0, 0, 7)]]


def test_quality_learns_from_the_labels_that_have_documents(spark):
    good, bad = "a calm and well formed sentence about rivers and trees in the north. ", "BUY!!! $$$ click click win 777 now now now "
    docs = spark.createDataFrame([(k, (good if k % 2 else bad) * (3 + k % 5)) for k in range(60)], "doc_id long, text string")
    many = spark.createDataFrame([(k, k % 2) for k in [*range(60), *range(10**6, 10**6 + 4000)]], "doc_id long, quality int")
    model = quality.fit(docs, many, rows_per_class=20)
    known = many.where(~quality.held_out(F.col("doc_id"))).select("doc_id", "quality")
    ids = {r["doc_id"] for r in known.collect()}
    for q, rows in quality._chosen(docs, known, 20).items():  # those of least hash that have a document
        order = [r["doc_id"] for r in docs.where(F.col("doc_id") % 2 == q).orderBy(F.xxhash64("doc_id")).collect() if r["doc_id"] in ids]
        assert [i for i, _ in rows] == order[:20]
    sizer, w = quality.Sizer(model.good, model.bad), np.array(model.weights)
    for r in quality.score(docs, model).collect():
        z = np.array(sizer.features(r["text"].encode())) @ w
        assert abs(r["score"] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-12 and (r["score"] > 0.5) == (r["doc_id"] % 2 == 1)
