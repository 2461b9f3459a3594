"""Substring dedup: a log-structured index of window fingerprints, probed batch by batch, then verified window by window."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_path, exists, materialize, named, scratch

#: A window has WINDOW words; the index holds, for each window, the least hash of its GRAM-word grams.
WINDOW, GRAM = 13, 6
#: Text of a group of documents, which tasks handle whole; a longer document is a group of its own.
GROUP_BYTES = 2 << 20
#: Text for each bucket of the index: SMALL_BUCKET up to MANY_BUCKETS buckets, beyond that LARGE_BUCKET.
SMALL_BUCKET, LARGE_BUCKET, MANY_BUCKETS = 64 << 10, 64 << 20, 1024
#: Text for each file bucket of the documents, and the most such buckets.
FILE_BYTES, MOST_FILES = 16 << 20, 50_000
#: What stands before every doc_id: documents of earlier calls.
EARLIER = -(1 << 63)
#: ASCII white space among bytes; the lowest n bytes of a number; the longest word that is hashed by eights.
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
LONG = 256
BLOBS = "bucket int, g long, keys binary, checks binary, least binary, spread binary, gs binary"
BLOB_COLUMNS = [f.split()[0] for f in BLOBS.split(", ")]
FOUND = "kind int, g long, bucket int, keys binary, checks binary, least binary, gs binary"


def _constant(k: int) -> np.uint64:
    """The k-th odd number of a splitmix sequence."""
    z = (k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    return np.uint64((z ^ z >> 27) | 1)


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """A one-to-one mix of 64 bits."""
    h = (h ^ h >> np.uint64(32)) * _constant(salt)
    return h ^ h >> np.uint64(29)


def _roll(h: np.ndarray, n: int, salt: int) -> np.ndarray:
    """A 64-bit hash of every n consecutive words, from the words' hashes."""
    size = max(0, len(h) - n + 1)
    out = np.full(size, _constant(salt), np.uint64)
    for k in range(n):
        out += h[k : k + size] * _constant(100 * salt + k)
    return _mixed(out, salt + 7)


class _Group:
    """The words of some documents, one after the other, and the windows that lie in one document each."""

    def __init__(self, docs: pa.Table) -> None:
        ids = docs.column("doc_id")
        self.valid = ids.is_valid().to_numpy()
        self.ids = ids.fill_null(EARLIER).to_numpy()
        self.text = docs.column("text").combine_chunks()

    def words(self) -> list[list[bytes]]:
        return [t.encode().split() if t else [] for t in self.text.to_pylist()]

    def hash(self) -> None:
        """128 bits of each word, in two halves, eight bytes of all words at a time; words over LONG bytes by XXH3."""
        text = pc.fill_null(self.text, "").cast(pa.large_binary())
        at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        size = int(at[-1] - at[0])
        raw = np.zeros(size + 8, np.uint8)
        if size:
            raw[:size] = np.frombuffer(text.buffers()[2], np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        full = ~BLANK[raw[:size]]
        cut = np.zeros(size + 1, bool)  # before a document's first byte
        cut[at] = True
        first, last = full.copy(), full.copy()
        first[1:] &= ~full[:-1] | cut[1:-1]
        last[:-1] &= ~full[1:] | cut[1:-1]
        start = np.flatnonzero(first)
        length = np.flatnonzero(last) + 1 - start
        row = np.repeat(np.arange(len(text)), np.diff(np.searchsorted(start, at)))
        eight = np.ndarray((size + 1,), "<u8", raw.data, strides=(1,))
        halves = [_mixed(length.astype(np.uint64), salt) for salt in (11, 12)]
        live, k = np.flatnonzero(length <= LONG), 0
        while len(live):
            left = length[live] - k
            part = eight[start[live] + k] & MASKS[np.minimum(left, 8)]
            for salt, h in enumerate(halves):
                h[live] = _mixed(_mixed(h[live] ^ part, 13 + salt), 15 + salt)
            live, k = live[left > 8], k + 8
        for i in np.flatnonzero(length > LONG):
            both = xxhash.xxh3_128_intdigest(raw[start[i] : start[i] + length[i]])
            halves[0][i], halves[1][i] = both & (1 << 64) - 1, both >> 64
        self.hashes, self.others = halves
        n = len(row)
        self.starts = np.flatnonzero(row[: max(0, n - WINDOW + 1)] == row[WINDOW - 1 :])
        self.doc = row[self.starts]

    def low(self) -> np.ndarray:
        """The fingerprint of every window: the least hash of its grams, mixed, for least hashes are not spread evenly."""
        low = _roll(self.hashes, GRAM, 1)
        for gap in (1, 2, 4):  # WINDOW - GRAM + 1 = 8 grams
            low = np.minimum(low[:-gap], low[gap:]) if len(low) > gap else low[:0]
        return _mixed(low[self.starts], 5) if len(self.starts) else np.zeros(0, np.uint64)

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of the chosen windows' words: the key from one half of the words' bits, a check from the other."""
        starts = self.starts[at]
        return _roll(self.hashes, WINDOW, 2)[starts], _roll(self.others, WINDOW, 3)[starts]


def _pack(a: np.ndarray, step: bool = False) -> bytes:
    """Bytes of numbers, plane by plane, so that codecs find the zeros; step: of their differences (sorted numbers)."""
    a = a.view(np.uint64)
    if step and len(a):
        a = np.concatenate([a[:1], np.diff(a)])
    return a.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(b: bytes, step: bool = False) -> np.ndarray:
    a = np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(a, dtype=np.uint64) if step else a


def _edges(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new value begins, in sorted columns."""
    n = len(sorted_columns[0])
    new = np.zeros(max(0, n - 1), bool)
    for c in sorted_columns:
        new |= c[1:] != c[:-1]
    return np.flatnonzero(np.concatenate([np.ones(min(n, 1), bool), new]))


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


def _blobs(group: int, ids: np.ndarray, keys: np.ndarray, checks: np.ndarray | None, buckets: int) -> pa.Table:
    """A group's fingerprints by bucket, each once, with the least and the largest doc_id that has it: however many of the
    group's documents share one, it costs a row of the index once."""
    c = checks if checks is not None else np.zeros(len(keys), np.uint64)
    order = np.lexsort((ids, c, keys))
    ids, keys, c = ids[order], keys[order], c[order]
    first = _edges(keys, c)
    if not len(first):
        return _table([], BLOBS)
    least, most = ids[first], ids[np.append(first[1:], len(ids)) - 1]
    keys, c = keys[first], c[first]
    bucket = keys >> np.uint64(65 - int(buckets).bit_length()) if buckets > 1 else np.zeros(len(keys), np.uint64)
    cut = _edges(bucket)
    rows = [(int(bucket[a]), group, _pack(keys[a:z], True), _pack(c[a:z]) if checks is not None else None, _pack(least[a:z]), _pack(most[a:z] - least[a:z]), None) for a, z in zip(cut, [*cut[1:], len(keys)], strict=True)]
    return _table(rows, BLOBS)


def _merged(table: pa.Table, first_group: int) -> tuple[np.ndarray, ...]:
    """All fingerprints of a bucket, sorted by key and check: keys, checks, groups, least and largest doc_id, and whether from the batch.

    Groups below first_group are of earlier calls.
    """
    parts: list[list[np.ndarray]] = [[] for _ in range(6)]
    for g, keys, checks, least, spread, gs in zip(*(table.column(c).to_pylist() for c in ("g", "keys", "checks", "least", "spread", "gs")), strict=True):
        k, low = _unpack(keys, True), _unpack(least).view(np.int64)
        n = len(k)
        if gs is not None:
            low = np.where(_unpack(gs).view(np.int64) < first_group, EARLIER, low)
        most = low + _unpack(spread).view(np.int64) if spread is not None else low
        for p, v in zip(parts, (k, _unpack(checks) if checks is not None else np.zeros(n, np.uint64), np.full(n, g, np.int64) if gs is None else _unpack(gs).view(np.int64), low, most, np.full(n, gs is None)), strict=True):
            p.append(v)
    columns = [np.concatenate(p) for p in parts]
    keys, checks, least = columns[0], columns[1], columns[3]
    order = np.argsort(keys, kind="stable")  # every part is sorted by key: their runs are merged
    same = keys[order][1:] == keys[order][:-1]
    tied = np.flatnonzero(np.append(False, same) | np.append(same, False))
    if len(tied):
        at = order[tied]
        order[tied] = at[np.lexsort((least[at], checks[at], keys[at]))]
    return tuple(c[order] for c in columns)


def _by_group(g: np.ndarray, *columns: np.ndarray | None) -> list[tuple]:
    """(group, packed columns) for each group."""
    order = np.argsort(g, kind="stable")
    cut = _edges(g[order])
    return [(int(g[order[a]]), *(None if c is None else _pack(c[order[a:z]]) for c in columns)) for a, z in zip(cut, [*cut[1:], len(g)], strict=False)]


def _probe(table: pa.Table, first_group: int) -> pa.Table:
    """A bucket's runs merge-joined with a batch. Rows of FOUND: kind 0, a group's fingerprints that two documents share;
    kind 2, the bucket's part of a new run: the batch's fingerprints, for each group that has them."""
    bucket = table.column("bucket")[0].as_py()
    keys, checks, g, least, most, new = _merged(table, first_group)
    first = _edges(keys)
    size = np.diff(np.append(first, len(keys)))
    shared = np.repeat(np.logical_or.reduceat(new, first) & (least[first] != np.maximum.reduceat(most, first)), size)
    rows = [(0, group, None, k, None, None, None) for group, k in _by_group(g[shared], keys[shared])]
    rows.append((2, None, bucket, _pack(keys[new], True), None, _pack(least[new]), _pack(g[new])))
    return _table(rows, FOUND)


def _verify(table: pa.Table) -> pa.Table:
    """A bucket's windows that two documents have: kind 0, a group's windows and their least doc_id, where it is not its own only."""
    keys, checks, g, least, most, _ = _merged(table, 0)
    first = _edges(keys, checks)
    size = np.diff(np.append(first, len(keys)))
    source = np.repeat(least[first], size)
    told = most > source
    return _table([(0, group, None, k, c, low, None) for group, k, c, low in _by_group(g[told], keys[told], checks[told], source[told])], FOUND)


def _compacted(table: pa.Table) -> pa.Table:
    """A bucket's parts of several runs as one, sorted."""
    keys, _, g, least, _, _ = _merged(table, 0)
    return _table([(2, None, table.column("bucket")[0].as_py(), _pack(keys, True), None, _pack(least), _pack(g))], FOUND)


@dataclass
class Manifest:
    """A version of an index: runs as (level, path), each in so many files by bucket, the documents that they were made of,
    calls so far."""

    buckets: int
    files: int
    calls: int = 0
    runs: list[tuple[int, str]] = field(default_factory=list)
    docs: list[str] = field(default_factory=list)


class FingerprintIndex:
    """Sorted immutable runs of (fingerprint, group, its least doc_id), by bucket, below a folder that driver and executors share.

    A manifest lists the runs of a version and is renamed into place, so a later call, or another session, opens the newest
    one whole; files that no manifest lists are never read. add() merge-joins a batch with all runs and writes what is new
    as another run; when fanout runs have one level they are merged into one of the next, so each fingerprint is rewritten
    once a level. Documents of earlier calls stay beside the runs, for windows are verified against theirs.

    Each run's files are bucketed by bucket, all alike, and the runs are partitions of one table that the session knows
    while the index is open: a batch is dealt to the history's files, the history itself is never shuffled, nor is it to be
    compacted. The numbers of buckets and files are those of the first call.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int, files: int = 1, fanout: int = 2) -> None:
        self.spark, self.root, self.fanout = spark, root.rstrip("/"), fanout
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.version, self.state = 0, Manifest(buckets, files)
        folder = f"{self.root}/manifest"
        if exists(spark, folder):
            names = [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))]
            self.version = max((int(n) for n in names if n.isdigit()), default=0)
        if self.version:
            line = spark.read.text(f"{folder}/{self.version}").first()[0]
            self.state = Manifest(**json.loads(line))
            self.state.runs = [tuple(r) for r in self.state.runs]
        self.first_group = self.state.calls << 32
        self.table = f"panelspark_runs_{uuid.uuid4().hex[:12]}"
        spark.sql(f"create table {self.table} ({FOUND.removeprefix('kind int, ')}, run string) using parquet partitioned by (run) clustered by (bucket) sorted by (bucket) into {self.state.files} buckets location '{self.root}/runs'")
        for _, path in self.state.runs:
            self._known(path)

    def close(self) -> None:
        """The session forgets the runs' table; the files stay."""
        self.spark.sql(f"drop table if exists {self.table}")

    def commit(self) -> None:
        """Makes the state the next version; fails if another writer made it first."""
        final, staged = (self._path(f"{self.root}/manifest/{name}") for name in (self.version + 1, f"_{uuid.uuid4().hex}"))
        out = self._fs.create(staged, False)
        out.write(json.dumps(asdict(self.state)).encode())
        out.close()
        if self._fs.exists(final) or not self._fs.rename(staged, final):
            raise RuntimeError(f"version {self.version + 1} of {self.root} exists")
        self.version += 1

    def _known(self, path: str) -> None:
        self.spark.sql(f"alter table {self.table} add partition (run = '{path.split('/')[-2]}') location '{path}'")

    def _history(self, runs: list[tuple[int, str]]) -> DataFrame:
        none = F.lit(None).cast("binary")
        rows = self.spark.table(self.table).where(F.col("run").isin([p.split("/")[-2] for _, p in runs]))
        return rows.select("bucket", "g", "keys", none.alias("checks"), "least", none.alias("spread"), "gs")

    def _written(self, rows: DataFrame, name: str, level: int) -> str:
        """Writes rows (FOUND) by kind and bucket; those of kind 2, if any, are a run. Returns the path."""
        path, made = f"{self.root}/{name}-{uuid.uuid4().hex[:12]}", f"panelspark_run_{uuid.uuid4().hex[:12]}"
        out = rows.write.option("compression", "zstd").option("path", path).format("parquet")
        try:
            out.partitionBy("kind").bucketBy(self.state.files, "bucket").sortBy("bucket").saveAsTable(made)
        finally:
            self.spark.sql(f"drop table if exists {made}")
        if exists(self.spark, f"{path}/kind=2"):  # no document of the batch has a window: no run
            self.state.runs.append((level, f"{path}/kind=2"))
            self._known(f"{path}/kind=2")
        return path

    def probed(self, batch: DataFrame) -> DataFrame:
        """batch (BLOBS) merge-joined with all runs, bucket by bucket (FOUND)."""
        first = self.first_group
        if not self.state.runs:
            return batch.repartition(self.state.files, "bucket").groupBy("bucket").applyInArrow(lambda t: _probe(t, first), FOUND)

        def both(old: pa.Table, new: pa.Table) -> pa.Table:
            parts = [t.select(BLOB_COLUMNS) for t in (old, new) if len(t)]
            return _probe(pa.concat_tables(parts), first)

        return self._history(self.state.runs).groupBy("bucket").cogroup(batch.groupBy("bucket")).applyInArrow(both, FOUND)

    def add(self, batch: DataFrame) -> DataFrame:
        """(g, keys) rows of groups and the fingerprints that they share with another document; batch: BLOBS, of larger doc_ids
        than those added before in this call."""
        path = self._written(self.probed(batch), "run", 0)
        return self.spark.read.schema(FOUND).parquet(path).where("kind = 0").select("g", "keys")

    def compact(self) -> list[str]:
        """Merges runs of one level; returns the paths that the next version no longer needs."""
        level, gone = self.state.runs[-1][0] if self.state.runs else 0, []
        while len(same := [r for r in self.state.runs if r[0] == level]) >= self.fanout:
            self.state.runs = [r for r in self.state.runs if r not in same]
            self._written(self._history(same).groupBy("bucket").applyInArrow(_compacted, FOUND), "merged", level + 1)
            gone += [p for _, p in same]
            level += 1
        return gone


def _stored(docs: DataFrame, path: str, groups: int, first: int, files: int, cuts: list[int]) -> tuple[DataFrame, str]:
    """docs by group (_g, from first on) and batch, and the name of their table; in files bucketed by the group: later steps work group by group without a shuffle of texts."""
    g = F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)) + F.lit(first).cast("long")
    batch = F.lit(0)
    for c in cuts:
        batch = batch + F.coalesce((F.col("doc_id") > c).cast("int"), F.lit(0))
    name = f"panelspark_docs_{uuid.uuid4().hex[:12]}"
    dealt = docs.withColumns({"_g": g, "_batch": batch}).repartition(files, "_g")
    dealt.write.partitionBy("_batch").bucketBy(files, "_g").sortBy("_g").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    return docs.sparkSession.table(name), name


def _cut(docs: pa.Table, told: pa.Table, extra: list[str], with_text: bool) -> pa.Table:
    """A group's documents without the windows that it was told of, where those have a smaller doc_id."""
    c = _Group(docs)
    words = c.words()
    sizes = np.array([len(w) for w in words], np.int64)
    n = int(sizes.sum())
    covered = np.zeros(n, bool)
    if len(told) and n:
        c.hash()
        keys, checks, least = (np.concatenate([_unpack(b) for b in told.column(name).to_pylist()]) for name in ("keys", "checks", "least"))
        order = np.argsort(keys, kind="stable")
        keys, checks, least = keys[order], checks[order], least[order].view(np.int64)
        key, check = c.windows(np.arange(len(c.starts)))
        at = np.searchsorted(keys, key)
        own, gone = c.ids[c.doc], np.zeros(len(key), bool)
        for k in range(int(np.diff(np.append(_edges(keys), len(keys))).max())):  # keys that are equal while their checks aren't
            p = np.minimum(at + k, len(keys) - 1)
            gone |= (keys[p] == key) & (checks[p] == check) & (least[p] < own) & c.valid[c.doc]
        edge = np.zeros(n + WINDOW + 1, np.int64)
        np.add.at(edge, c.starts[gone], 1)
        np.add.at(edge, c.starts[gone] + WINDOW, -1)
        covered = np.cumsum(edge)[:n] > 0
    removed, digests, texts = [], [], []
    for w, z in zip(words, np.cumsum(sizes), strict=True):
        mask = covered[z - len(w) : z]
        m = int(mask.sum())
        kept = b" ".join(w if not m else [x for x, r in zip(w, mask.tolist(), strict=True) if not r])
        removed.append(m)
        digests.append(hashlib.sha256(kept).hexdigest())
        texts.append(kept.decode() if with_text and m else None)
    out = {"doc_id": docs.column("doc_id"), "n_words": pa.array(sizes), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "kept": pa.array(texts, pa.string())}
    return pa.table(out | {name: docs.column(name) for name in [*extra, *["text"] * with_text]})


def dedup_substrings(docs: DataFrame, batches: int = 3, with_text: bool = False, keep: tuple[str, ...] = (), buckets: int | None = None, index: str | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256, kept, and with_text also text; and the columns keep.

    Words are runs without ASCII white space. A word is removed if a window over it (WINDOW words) also starts in a
    document of smaller doc_id. kept is the rest, joined by spaces, where with_text is set and words were removed; else
    null. Null text has no words; a row with a null doc_id loses nothing and takes nothing from others; rows that share a
    doc_id don't count as each other's source; documents of fewer words than a window stay whole.

    The documents go through a FingerprintIndex in batches of rising doc_id. Equal windows have equal fingerprints, so
    only windows whose fingerprint two documents share are then verified, by 128 bits of their words' hashes. index: a
    folder in which the index stays; a later call with it takes every document of earlier calls as one of smaller doc_id,
    and gives rows for its own docs alone. Without it the index lies in the scratch folder.

    All exchange is by groups of GROUP_BYTES of text: a passage that very many documents share is a row for each group,
    not for each document, and no list of fingerprints leaves the tasks. The documents are written once in files
    bucketed by group, so texts are shuffled once.
    """
    spark = docs.sparkSession
    taken = {"doc_id", "text", "n_words", "n_removed", "kept_sha256", "kept", "_g", "_batch"}
    name_of: dict[str, str] = {}
    for c in keep:  # a column of a result's name comes back as name_
        name_of[c] = c
        while name_of[c] in taken or [*keep, *name_of.values()].count(name_of[c]) > 1 + (name_of[c] == c):
            name_of[c] += "_"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[named(c).alias(f"_k{k}") for k, c in enumerate(name_of)])
    size, cuts = docs.agg(F.sum(F.octet_length("text")), F.percentile_approx("doc_id", [k / batches for k in range(1, batches)] or [1.0])).first()
    size, cuts = size or 0, sorted(set(cuts or []))[: batches - 1]
    if buckets is None:
        buckets = 1 << min(MANY_BUCKETS.bit_length() - 1, (size // SMALL_BUCKET).bit_length())
        buckets = max(buckets, 1 << (size // LARGE_BUCKET).bit_length())
    files = max(1, min(size // FILE_BYTES + 1, MOST_FILES))
    tree = FingerprintIndex(spark, index or scratch(spark, "index"), buckets, files)
    state = tree.state
    path = f"{tree.root}/docs-{uuid.uuid4().hex[:12]}"
    held, held_name = _stored(docs, path, size // GROUP_BYTES + 1, tree.first_group, files, cuts)
    number, old = state.buckets, list(state.docs)
    found, gone = None, []
    for k in range(len(cuts) + 1):
        part = held.where(F.col("_batch") == k).where("doc_id is not null").select("_g", "doc_id", "text")

        def fingerprints(t: pa.Table) -> pa.Table:
            c = _Group(t)
            c.hash()
            return _blobs(t.column("_g")[0].as_py(), c.ids[c.doc], c.low(), None, number)

        more = tree.add(part.groupBy("_g").applyInArrow(fingerprints, BLOBS))
        found = more if found is None else found.unionByName(more)
        if k < len(cuts):
            gone += tree.compact()
    tree.close()

    def windows(t: pa.Table, told: pa.Table) -> pa.Table:
        if not len(t) or not len(told):
            return _table([], BLOBS)
        c = _Group(t)
        c.hash()
        wanted = np.unique(np.concatenate([_unpack(b) for b in told.column("keys").to_pylist()]))
        low = c.low()
        at = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, low), len(wanted) - 1)] == low)
        return _blobs(t.column("_g")[0].as_py(), c.ids[c.doc[at]], *c.windows(at), number)

    own = held.where("doc_id is not null").select("_g", "doc_id", "text")
    told = found.withColumnRenamed("g", "_g")
    shared = own.groupBy("_g").cogroup(told.groupBy("_g")).applyInArrow(windows, BLOBS)
    if old:
        before = spark.read.parquet(old[0]).select("_g", "text")
        for p in old[1:]:
            before = before.unionByName(spark.read.parquet(p).select("_g", "text"))
        before = before.select("_g", F.lit(EARLIER).cast("long").alias("doc_id"), "text")
        needed = told.where(F.col("_g") < tree.first_group)
        shared = shared.unionByName(before.join(needed.select("_g").distinct(), "_g", "left_semi").groupBy("_g").cogroup(needed.groupBy("_g")).applyInArrow(windows, BLOBS))
    verified = materialize(shared.groupBy("bucket").applyInArrow(_verify, FOUND).select(F.col("g").alias("_g"), "keys", "checks", "least"), "windows")
    if index:
        state.docs, state.calls = [*old, path], state.calls + 1
        tree.commit()
    for p in gone:
        drop_path(spark, p)

    extra = [f"_k{k}" for k in range(len(name_of))]  # plain names, for any that docs have
    kinds = {"n_words": T.LongType(), "n_removed": T.LongType(), "kept_sha256": T.StringType(), "kept": T.StringType()}
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", *extra, *["text"] * with_text]
    schema = T.StructType([T.StructField(c, kinds.get(c) or docs.schema[c].dataType) for c in names])
    out = held.drop("_batch").groupBy("_g").cogroup(verified.groupBy("_g")).applyInArrow(lambda t, told: _cut(t, told, extra, with_text), schema)
    out = out.toDF(*[dict(zip(extra, name_of.values(), strict=True)).get(c, c) for c in names])
    if index:
        return out
    out = materialize(out, "cut")  # then nothing of this call's own index is needed any more
    spark.sql(f"drop table {held_name}")
    drop_path(spark, tree.root)
    return out
