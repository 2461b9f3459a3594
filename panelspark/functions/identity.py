"""Fingerprints and identities of parameter sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fingerprint(**fields: Column) -> Column:
    """SHA-256 of compact JSON with sorted keys; null fields are left out."""
    return F.sha2(F.to_json(F.struct(*[v.alias(k) for k, v in sorted(fields.items())])), 256)


def portfolio_identity(universe: Column, selection: Column, strategy: Column, top_n: Column, trade_time: Column, allocation: str = "equal") -> Column:
    return F.struct(universe.alias("universe"), selection.alias("score_selection"), strategy.alias("strategy"), top_n.cast("long").alias("top_n"), F.lit(allocation).alias("allocation"), trade_time.alias("trade_time"))


def identity_key(identity: Column, without: tuple[str, ...] = ()) -> Column:
    """The fingerprint of an identity, for which the fields without don't count (an ensemble's seeds)."""
    names = [n for n in ("allocation", "score_selection", "strategy", "top_n", "trade_time", "universe") if n not in without]
    return fingerprint(**{n: identity[n] for n in names})
