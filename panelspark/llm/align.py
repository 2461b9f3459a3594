"""Alignment of two tokenizers' tokens by divide and conquer at the byte offsets where both end."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize
from .packing import Encoder, byte_values

#: Distinct id pairs that may be broadcast (a row of 24 bytes); more are joined by a shuffle.
PAIRS = 1_000_000
#: Characters of texts that one pass aligns together; a longer text is a pass of its own.
PASS_CHARS = 250_000
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<a:int,b:int,n:int>>"


class ByteLevel:
    """Tokenizer A: ids and byte lengths of byte-level BPE tokens; strings of special tokens are plain text."""

    def __init__(self, path: str) -> None:
        self.coder = Encoder(path, special_as_text=True)
        vocabulary, byte = self.coder.slow.get_vocab(), byte_values()
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int32)
        for token, i in vocabulary.items():
            self.lengths[i] = sum(c in byte for c in token)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(self.coder.encode(t), "<i4") for t in texts]


class Pieces:
    """Tokenizer B: ids, contents and byte lengths of sentencepiece tokens of texts, before which it sets a blank."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.coder = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.coder.id_to_piece(i) for i in range(self.coder.get_piece_size())]
        self.content = [bytes([int(x[3:5], 16)]) if self.coder.is_byte(i) else b"" if self.coder.is_control(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.lengths = np.array([len(c) for c in self.content], np.int32)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.coder.encode(texts, num_threads=1)


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """By place in ends_a, the place in ends_b of the same end, or -1; both ascend, and all of ends_a[last] are in ends_b.

    first and last bound intervals of ends_a. In each a common end near the middle is looked for, by bisection in ends_b:
    the middle first, then twice as far to both sides each time. The nearest one splits the interval, and both halves go
    on; an interval without one is a group. Intervals of all texts are halved together, so there are as many steps as the
    logarithm of the longest, and each end is tried a logarithm of times at most.
    """
    partner = np.full(len(ends_a), -1, np.int64)
    partner[last] = np.searchsorted(ends_b, ends_a[last])
    end, lo, hi = len(ends_b) - 1, first.astype(np.int64), last.astype(np.int64)
    some = hi > lo
    lo, hi = lo[some], hi[some]
    missed = [np.empty(0, np.int64)] * 3  # bounds of intervals without a hit so far, and how far from the middle was tried
    while len(lo) or len(missed[0]):
        middle = (lo + hi) >> 1
        at = np.searchsorted(ends_b, ends_a[middle])
        hit = ends_b[np.minimum(at, end)] == ends_a[middle]
        place, miss = middle[hit], ~hit
        partner[place] = at[hit]
        split = [lo[hit], place + 1, place, hi[hit]]
        l, h, tried = (np.concatenate(x) for x in zip((lo[miss], hi[miss], np.zeros(int(miss.sum()), np.int64)), missed, strict=True))
        some = h - l > 2 * tried + 1
        l, h, tried = l[some], h[some], tried[some]
        if len(l):
            middle, reach = (l + h) >> 1, 2 * tried + 1
            left, right = np.maximum(l, middle - reach), np.minimum(h, middle + reach + 1)
            n_left = np.maximum(middle - tried - left, 0)
            count = n_left + np.maximum(right - middle - tried - 1, 0)
            of = np.repeat(np.arange(len(l)), count)
            k = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            place = np.where(k < n_left[of], left[of] + k, middle[of] + tried[of] + 1 + k - n_left[of])
            at = np.searchsorted(ends_b, ends_a[place])
            hit = ends_b[np.minimum(at, end)] == ends_a[place]
            place, at, of = place[hit], at[hit], of[hit]
            by = np.lexsort([np.abs(place - middle[of]), of])
            place, at, of = place[by], at[by], of[by]
            nearest = np.ones(len(of), bool)
            nearest[1:] = of[1:] != of[:-1]
            place, at, of = place[nearest], at[nearest], of[nearest]
            partner[place] = at
            split = [np.concatenate(x) for x in zip(split, (l[of], place + 1, place, h[of]), strict=True)]
            rest = np.ones(len(l), bool)
            rest[of] = False
            missed = [l[rest], h[rest], reach[rest]]
        else:
            missed = [l, h, tried]
        lo, hi = np.concatenate(split[:2]), np.concatenate(split[2:])
        some = hi > lo
        lo, hi = lo[some], hi[some]
    return partner


def _ends(lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths, dtype=np.int64)
    return ends.astype(np.int32) if ends[-1] < 1 << 31 else ends


class Aligner:
    """Aligns texts, some at a time."""

    def __init__(self, byte_level: str, pieces: str) -> None:
        self.a, self.b = ByteLevel(byte_level), Pieces(pieces)
        # decimal ids with what follows them: a comma within a group, else the mark of its end
        self.named_a = np.array([f"{i}{c}" for i in range(len(self.a.lengths)) for c in ",|"], object)
        self.named_b = np.array([f"{i}{c}" for i in range(len(self.b.content)) for c in ",;"], object)

    def tokens(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place in texts, ids of blank and text by A, ids by B) of the texts that have tokens.

        A's bytes are those of any text, as their number shows; B has one character for two, so its bytes are compared.
        """
        at = [k for k, t in enumerate(texts) if t]
        spaced = [" " + texts[k] for k in at]
        for k, text, a, b in zip(at, spaced, self.a.ids(spaced), self.b.ids([texts[k] for k in at]), strict=True):
            raw = text.encode()
            if b"".join([self.b.content[i] for i in b]) == raw and self.a.lengths[a].sum() == len(raw):
                yield k, a, np.array(b, np.int32)

    def align(self, texts: list[str | None]) -> list[dict]:
        """For each text the columns of SCHEMA but for doc_id."""
        found = list(self.tokens(texts))
        none = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "pairs": (np.empty(0, np.int32),) * 3}
        out = [none] * len(texts)
        if not found:
            return out
        a, b = np.concatenate([x for _, x, _ in found]), np.concatenate([x for _, _, x in found])
        stop_a, stop_b = np.cumsum([len(x) for _, x, _ in found]), np.cumsum([len(x) for _, _, x in found])
        # texts follow each other without a gap, so their bounds are common ends
        partner = shared_cuts(_ends(self.a.lengths[a]), _ends(self.b.lengths[b]), np.concatenate([[0], stop_a[:-1]]), stop_a - 1)
        cut_a = np.flatnonzero(partner >= 0)
        cut_b = partner[cut_a]
        # tokens in the order of writing: of each group those of A, then those of B
        is_a, is_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        is_a[cut_a], is_b[cut_b] = 1, 1
        group_a, group_b = np.cumsum(is_a) - is_a, np.cumsum(is_b) - is_b
        before = np.concatenate([[0], cut_b + 1])
        order = np.empty(len(a) + len(b), object)
        order[np.arange(len(a)) + before[group_a]] = self.named_a[2 * a + is_a]
        order[np.arange(len(b)) + (cut_a + 1)[group_b]] = self.named_b[2 * b + is_b]
        code = a[cut_a].astype(np.int64) << 32 | b[cut_b]
        bounds = np.concatenate([[0], np.searchsorted(cut_a, stop_a)])
        at = np.concatenate([[0], stop_a + stop_b])
        for k, (row, ids_a, ids_b) in enumerate(found):
            written = "".join(order[at[k] : at[k + 1]].tolist())[:-1]
            pairs, n = np.unique(code[bounds[k] : bounds[k + 1]], return_counts=True)
            links = int(bounds[k + 1] - bounds[k])
            out[row] = {"n_a": len(ids_a), "n_b": len(ids_b), "n_groups": links, "n_links": links, "groups_sha256": sha256(written.encode()).hexdigest(), "pairs": (pairs >> 32, pairs & 0xFFFFFFFF, n)}
        return out


def aligned(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """SCHEMA for each row of docs (doc_id, text): numbers of tokens, groups and links, the groups' digest, and the id pairs
    that links hold, with how many links of the text hold them. The last tokens of a group link, and no others."""
    int32 = pa.int32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_level, pieces)
        for batch in batches:
            lo = 0
            while lo < len(batch):
                texts, n, hi = [], 0, lo
                while hi < len(batch) and (hi == lo or n < PASS_CHARS):
                    texts.append(batch.column(1)[hi].as_py())
                    n += len(texts[-1] or "")
                    hi += 1
                rows = aligner.align(texts)
                flat = [np.concatenate([r["pairs"][k] for r in rows]).astype(np.int32) for k in range(3)]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(r["pairs"][0]) for r in rows])]), int32)
                pairs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(x, int32) for x in flat], ["a", "b", "n"]))
                columns = [pa.array([r[c] for r in rows], pa.string() if c == "groups_sha256" else pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns, pairs], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])
                lo = hi

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(code, links, best) by id pair of aligned rows (code is A's id x 2^32 + B's): the links that hold it, all rows
    counted, and whether no other pair of its B id has more."""
    one = rows.select(F.explode("pairs").alias("p")).select(_code(F.col("p")).alias("code"), F.col("p.n").alias("n"))
    counts = one.groupBy("code").agg(F.sum("n").alias("links"))
    most = counts.groupBy(F.col("code").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("links").alias("most"))
    return counts.withColumn("b", F.col("code").bitwiseAND(0xFFFFFFFF)).join(most, "b").select("code", "links", (F.col("links") == F.col("most")).cast("int").alias("best"))


def _code(p: F.Column) -> F.Column:
    return F.shiftleft(p["a"].cast("long"), 32).bitwiseOR(p["b"].cast("long"))


def align_tokens(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs (doc_id, text).

    A (a byte-level BPE file of the tokenizers library) encodes a blank and the text, B (a sentencepiece file) the same,
    by setting the blank itself. Byte offsets where tokens of both end cut the text into groups; the last A token and the
    last B token of a group link. An id pair's count is the number of links that hold it in all rows; n_best counts the
    links whose pair is the most frequent of its B id (ties included), count_sum sums their pairs' counts.
    groups_sha256 digests "a1,a2|b1;a3|b2,b3", the ids in order. A null or empty text, or one whose tokens' bytes aren't
    blank and text (B reads U+2581 as a blank), has no tokens: zeros and ''. Repeated rows count as often as they are
    there; null ids are kept; other columns are left out.

    A task holds PASS_CHARS characters' worth of texts, or one longer text. The counts are of pairs, not of places: each
    text adds its pairs once, Spark sums them before the shuffle. They are broadcast if PAIRS at most, else joined.
    """
    rows = materialize(aligned(docs, byte_level, pieces).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = materialize(pair_counts(rows), "pair_counts")
    held = rows.select("row", F.explode("pairs").alias("p")).select("row", _code(F.col("p")).alias("code"), F.col("p.n").cast("long").alias("n"))
    sums = held.join(broadcast_if_small(counts, PAIRS), "code").groupBy("row").agg(F.sum(F.col("n") * F.col("best")).alias("n_best"), F.sum(F.col("n") * F.col("links")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.drop("pairs").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
