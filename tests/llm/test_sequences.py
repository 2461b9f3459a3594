"""Periodic runs, token alignment and mixing against brute force, edges included."""

import itertools
import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest

from panelspark.llm import align, mixture, periodic
from panelspark.llm.packing import byte_values
from panelspark.llm.queries import QUERIES, piece_path, tokenizer_path

SF = "/root/testdata/sf0.001"


def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def brute_runs(w, least=6, times=4):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(least, times * q) and not any(all(w[t] == w[t + p] for t in range(i, i + n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_described(words):
    runs = brute_runs(words)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    left = " ".join(w for k, w in enumerate(words) if k not in gone)
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha256(listed.encode()).hexdigest(), sha256(left.encode()).hexdigest())


def row_of(r):
    return (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"], r["collapsed_sha256"])


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (6, 2), (10, 3), (1, 5)])
def test_runs_against_brute_force(least, times):
    rng = random.Random(least * 10 + times)
    for _ in range(300):
        n, k = rng.randint(0, 60), rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randint(1, max(1, n // 3))
            w = [w[i] if i < a else w[min(n - 1, a + (i - a) % p)] for i in range(n)]
        got = periodic.find_runs(np.array([*w, 99], np.int64), least, times)
        assert [tuple(r) for r in got.tolist()] == brute_runs(w, least, times), w


def test_runs_of_long_texts():
    for words in ([0] * 60_000, [k % 700 for k in range(60_000)]):
        assert periodic.find_runs(np.array([*words, -1])).tolist() == [[0, 60_000, max(words) + 1]]


def test_periodic_query_against_brute_force(spark):
    got = {r["doc_id"]: row_of(r) for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    docs = documents(spark)
    assert set(got) == set(docs)
    for i, d in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        if n < 600:
            assert got[i] == brute_described(words), i


def test_periodic_edges(spark, awkward):
    rows = periodic.periodic_runs(awkward, with_runs=True, with_text=True).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        if r["doc_id"] in (3, 4, 5):
            assert row_of(r) == (0, None, None, None, None, sha256(b"").hexdigest(), sha256(b"").hexdigest())
            assert r["runs"] == [] and r["collapsed"] == ""
        if r["doc_id"] == 11:
            assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["collapsed"]) == (1, 0, 400, 1, 400_000, "x")
    empty = spark.createDataFrame([], "doc_id long, text string, `n.runs` int")
    assert periodic.periodic_runs(empty).count() == 0 and periodic.with_planted_tails(empty).count() == 0
    with pytest.raises(ValueError, match="twice"):
        periodic.periodic_runs(awkward, min_exponent=1)


def brute_alignment(text, a_coder, b_coder):
    """(n_a, n_b, groups digest, links) by sets of ends."""
    if not text:
        return 0, 0, "", []
    raw, byte = (" " + text).encode(), byte_values()
    a = a_coder.encode(" " + text, add_special_tokens=False).ids
    b = b_coder.encode(text)
    bytes_a = [bytes(byte[c] for c in a_coder.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(x[3:5], 16)]) if b_coder.is_byte(i) else x.replace("▁", " ").encode() for i in b for x in [b_coder.id_to_piece(i)]]
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return 0, 0, "", []
    ends_a, ends_b = (list(itertools.accumulate(map(len, x))) for x in (bytes_a, bytes_b))
    at_a, at_b = ({e: k for k, e in enumerate(x)} for x in (ends_a, ends_b))
    groups, links, i, j = [], [], 0, 0
    for e in sorted(set(ends_a) & set(ends_b)):
        x, y = at_a[e] + 1, at_b[e] + 1
        groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
        links.append((a[x - 1], b[y - 1]))
        i, j = x, y
    return len(a), len(b), sha256(";".join(groups).encode()).hexdigest(), links


@pytest.fixture(scope="module")
def coders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=piece_path())


def brute_aligned(texts, coders):
    each = [brute_alignment(t, *coders) for t in texts]
    count, most = {}, {}
    for *_, links in each:
        for p in links:
            count[p] = count.get(p, 0) + 1
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return [(n_a, n_b, len(k), len(k), sum(count[p] == most[p[1]] for p in k), sum(count[p] for p in k), digest) for n_a, n_b, digest, k in each]


def test_alignment_query_against_brute_force(spark, coders):
    docs = documents(spark)
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op12_align"](spark, SF).collect()}
    assert got == dict(zip(docs, brute_aligned([d["text"] for d in docs.values()], coders), strict=True))


def test_alignment_of_awkward_texts(spark, awkward, coders):
    rng = random.Random(5)
    bits = [" ", "  ", "\n", "\t", "a", "the", " of", "<s>", "<|endoftext|>", "é", "日本", "語", "\U0001f642", "▁", "　", "23", ".", "'s", "ő", "\x00", "́", "\r\n", "==", "<0x41>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, " ", "x" * 3000, " " * 3001, "\n" * 3000, "=" * 3000 + "a", "日" * 2000]
    docs = spark.createDataFrame([(None, t) if k % 9 == 0 else (k % 50, t) for k, t in enumerate(texts)], "doc_id long, text string").union(awkward.select("doc_id", "text"))
    want = brute_aligned([r["text"] for r in docs.collect()], coders)
    got = align.align_tokens(docs.selectExpr("*", "1 as code", "2 as row", "3 as `n.links`"), tokenizer_path(), piece_path())
    assert sorted(tuple(r)[1:] for r in got.collect()) == sorted(want)
    assert align.align_tokens(docs.limit(0), tokenizer_path(), piece_path()).count() == 0


def test_cuts_of_intervals_without_any():
    a, b = np.cumsum(np.full(4000, 3)), np.cumsum(np.full(6000, 2))
    b = np.append(b[b % 6 != 0], a[-1])  # only the last ends together
    got = align.shared_cuts(a, np.unique(b), np.array([0]), np.array([len(a) - 1]))
    assert (got >= 0).sum() == 1


def test_subset_sums_against_brute_force():
    rng = random.Random(2)
    for _ in range(400):
        lengths = sorted(rng.sample(range(1, 40), rng.randint(0, 4)))
        counts, wanted = [rng.randint(1, 3) for _ in lengths], rng.randint(0, 120)
        sums = {sum(x * n for x, n in zip(t, lengths, strict=True)) for t in itertools.product(*[range(c + 1) for c in counts])}
        best = min(sums, key=lambda s: (abs(s - wanted), s))
        take = mixture.subset_sums(lengths, counts, wanted)
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True)) and sum(t * n for t, n in zip(take, lengths, strict=True)) == best
        if lengths:
            take = mixture.fit_budget(np.array(lengths), np.array(counts), wanted)
            assert int(take @ np.array(lengths)) == best and (take <= counts).all()


def brute_targets(sizes, weights=(5, 2, 1), share=1.5):
    """Targets of the sources in order, by giving the excess anew until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    capped, budget = set(), share * sum(sizes.values())
    while True:
        left, open_ = budget - sum(2 * sizes[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        target = {s: 2 * sizes[s] if s in capped else weight[s] * left / open_ for s in names}
        above = {s for s in names if s not in capped and target[s] > 2 * sizes[s]}
        if not above:
            return target
        capped |= above


def checked_mix(rows, texts_of):
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    targets, taken = brute_targets(sizes), {}
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - targets[r["source"]]) < 1e-6
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, n in taken.items():
        whole, sums = (min(2, int(targets[s] // sizes[s])) if sizes[s] else 0), 1
        for r in rows:
            if r["source"] == s:
                sums |= sums << r["size"]  # a bit for each sum that some of the documents have
        rest = targets[s] - whole * sizes[s]
        best = min(abs(k - rest) for k in range(sums.bit_length()) if sums >> k & 1) if whole < 2 else 0
        assert abs(n - targets[s]) <= best + 1
    if texts_of:
        assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts_of[r["doc_id"]]["text"] or "")) for r in rows)


def test_mix_meets_targets_and_reruns_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixture.mix(docs).collect()
    checked_mix(rows, documents(spark))
    again = mixture.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    q = QUERIES["op13_mixture"](spark, SF)
    assert q.columns == ["doc_id", "size", "source_size", "target", "taken"] and q.count() == len(rows)


def test_mix_edges(spark, awkward, monkeypatch):
    monkeypatch.setattr(mixture, "ORDERED", 5)  # several buckets of one source and size
    rows = mixture.mix(awkward).collect()
    assert len(rows) == awkward.count()
    checked_mix(rows, None)
    many = spark.createDataFrame([(k, "a b c", s) for k, s in enumerate(["x", "y", None, "", "z"] * 40)], "doc_id long, text string, source string")
    rows = mixture.mix(many.selectExpr("*", "1 as size", "2 as bucket", "3 as `a.b`")).collect()
    assert len(rows) == 200
    checked_mix(rows, None)
    assert {r["doc_id"]: r["taken"] for r in mixture.mix(many, seed=1).collect()} != {r["doc_id"]: r["taken"] for r in rows}
    assert mixture.mix(many.limit(0)).count() == 0
    null = spark.createDataFrame([(1, None, None), (1, None, None)], "doc_id long, text string, source string")
    assert [(r["size"], r["target"], r["taken"]) for r in mixture.mix(null).collect()] == [(0, 0.0, 0)] * 2
