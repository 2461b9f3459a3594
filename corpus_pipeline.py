"""The corpus pipeline: quality, near copies, repeated passages, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir), works on all rows of docs, and returns the columns of docs but for the last,
which returns the packed pieces. Stages that tell rows apart know a row by its doc_id and text, so different texts of
one id are rows of their own; rows whose doc_id is null pass them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.llm import decontaminate, packing, quality, similar, substring
from panelspark.llm.common import broadcast_if_small, columns, materialize, named, table
from panelspark.llm.queries import tokenizer_path

#: Documents that score less are rejected.
MIN_QUALITY = 0.3
#: Two documents are near copies if their sets of five-word shingles share NEAR_PERCENT hundredths of their union or more.
#: Candidates are those whose fingerprints of sets of word pairs differ in so many bits at most, or whose sets share a band.
NEAR_BITS, NEAR_SHINGLE, NEAR_PERCENT = 9, 2, 80
#: Rows of id and hash that may be broadcast (16 bytes each); more are joined by a shuffle.
IDS = 500_000


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _without(docs: DataFrame, gone: DataFrame, h: str) -> DataFrame:
    """docs (with the hash h of the text) without the rows of gone (doc_id, h): rows are told apart by id and text."""
    return docs.join(broadcast_if_small(gone, IDS), ["doc_id", h], "left_anti").select(*columns(docs))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the compression classifier scores below MIN_QUALITY; it learns from labels of docs that aren't held out."""
    name = _free(docs, "_quality")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")), name)
    return scored.where(F.col(name) >= MIN_QUALITY).select(*columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the row of the smallest doc_id (of one id, that of the least hash of its text), once."""
    h = _free(docs, "_text_hash")
    rows = similar.near_copies(docs, NEAR_BITS, NEAR_SHINGLE, percent=NEAR_PERCENT).withColumnRenamed("h", h)
    groups = materialize(rows, "groups")
    first = (F.col("doc_id") == F.col("first_id")) & (F.col(h) == F.col("first_h"))
    gone = materialize(groups.where(~first).select("doc_id", h).distinct(), "gone")
    kept = _without(docs.withColumn(h, F.xxhash64("text")), gone, h)
    twice = materialize(groups.where(first).groupBy("doc_id", h).count().where("count > 1").select("doc_id", h), "twice")
    if twice.limit(1).count():  # rows of one id and text: one of them stays
        place, n = _free(docs, "_place"), Window.partitionBy("doc_id", h).orderBy(F.xxhash64(*[named(c) for c, t in docs.dtypes if "map" not in t]))
        one = kept.join(twice, ["doc_id", h], "left_semi").select(*columns(kept)).withColumn(place, F.row_number().over(n)).where(F.col(place) == 1).drop(place)
        kept = _without(kept, twice, h).unionByName(one)
    return kept.select(*columns(docs))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages that a document of smaller doc_id has; a document that loses all its words goes."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    slim = docs.select("doc_id", "text", *[F.struct(*map(named, rest)).alias("rest")] * bool(rest))
    whole = substring.dedup_substrings(slim, with_text=True, keep=("rest",) * bool(rest))
    left = whole.where("n_removed = 0 or n_removed < n_words")
    cut = F.col("n_removed") > 0
    out = left.select("doc_id", F.when(cut, F.col("kept")).otherwise(F.col("text")).alias("text"), cut.alias("cut"), *["rest"] * bool(rest))
    chars = F.length("text")
    made = {c: F.col("rest").getField(c) for c in rest} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in rest:
        made["n_chars"] = F.when(F.col("cut"), chars.cast(docs.schema["n_chars"].dataType)).otherwise(made["n_chars"])
    return out.select(*[made[c].alias(c) for c in docs.columns])


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of which a twentieth or more lies in benchmark passages."""
    h = _free(docs, "_text_hash")
    hashed = docs.withColumn(h, F.xxhash64("text"))
    judged = decontaminate.decontaminate(hashed, table(spark, sf_dir, "benchmark"), keep=("doc_id", h))
    gone = materialize(judged.where("contaminated and doc_id is not null").select("doc_id", h).distinct(), "contaminated")
    return _without(hashed, gone, h).select(*columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenizes the documents and packs them into sequences: rows of doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", benchmark_filter),
    ("packing", pack),
]
#: The stages' classifier, hashes and tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
