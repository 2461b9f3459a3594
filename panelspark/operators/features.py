"""Bar, lag and rolling features of the dense panel.

Rolling features are built in two steps: what is summed or picked over frames by window functions, each named and computed
once, then arithmetic on the names. Every frame has one spec (symbol, market day), so Spark plans one exchange.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.stats import finite, is_finite, symbol_window

EPS = 1e-12
#: Widths of the rolling windows, in market days.
WIDTHS = (5, 10, 20, 30, 60)
#: Below this deviation a series counts as constant in correlations.
FLAT = 2e-5
#: Up to this width frames are window functions.
SHORT = 10
#: Changes of volume are summed as whole numbers of so many parts of a share (a power of two, so that scaling is exact).
VOLUME_UNIT = float(1 << 20)


def bar_features(panel: DataFrame) -> DataFrame:
    """Shape of the bar relative to its open, range and close."""
    o, h, low, c = (F.col(x) for x in ("_open", "_high", "_low", "_close"))
    top, bottom, span = F.greatest(o, c), F.least(o, c), h - low + EPS
    return panel.withColumns({
        "kmid": F.try_divide(c - o, o), "klen": F.try_divide(h - low, o), "kmid2": (c - o) / span,
        "kup": F.try_divide(h - top, o), "kup2": (h - top) / span, "klow": F.try_divide(bottom - low, o), "klow2": (bottom - low) / span,
        "ksft": F.try_divide(2 * c - h - low, o), "ksft2": (2 * c - h - low) / span,
        "open0": F.try_divide(o, c), "high0": F.try_divide(h, c), "low0": F.try_divide(low, c), "vwap0": F.try_divide(F.col("_vwap"), c),
    })


def lag_inputs(panel: DataFrame) -> DataFrame:
    """Yesterday's close and volume, their changes, the close ratio, and ln(volume ratio + 1) where yesterday had volume."""
    w = symbol_window()
    p = panel.withColumns({"_pc": F.lag("_close").over(w), "_pv": F.lag("_volume").over(w)})
    return p.withColumns({
        "_dp": F.col("_close") - F.col("_pc"), "_dv": F.col("_volume") - F.col("_pv"), "_cr": F.try_divide("_close", "_pc"),
        "_lv": F.ln(F.col("_volume") + 1), "_lvr": F.when(F.col("_pv") > 0, F.ln(F.col("_volume") / F.col("_pv") + 1)),
    }).withColumn("_move", F.abs(F.col("_cr") - 1) * F.col("_volume"))


def _close(x: Column) -> Column:
    return F.try_divide(x, F.col("_close"))


@dataclass
class Family:
    """What a family gives for a width: window functions by name; series and pairs of series of which it wants moments; values
    of which it wants sums; series of which it wants places; and its features, as arithmetic on those names."""

    features: dict[str, Column]
    windows: dict[str, Column] = field(default_factory=dict)
    moments: dict[str, tuple[Column, ...]] = field(default_factory=dict)
    sums: dict[str, Column] = field(default_factory=dict)
    places: dict[str, Column] = field(default_factory=dict)


def framed(panel: DataFrame, moments: dict[str, tuple[Column, ...]], sums: dict[str, Column], widths: tuple[int, ...], places: dict[str, Column] = {}) -> DataFrame:  # noqa: B006
    """Adds moments and sums of the last n rows of each symbol, for every width n, and _place, the row's number.

    moments, of a series x or of a pair (x, y), where all are finite: _{name}_n{n} rows, means _{name}_mx{n} (my), sums of
    squared deviations _{name}_xx{n} (yy), of products _{name}_xy{n}. sums: _{name}{n}, a missing value counts as 0. places, of
    long frames alone: linear 0.8 and 0.2 quantiles _{name}_u{n} and _{name}_d{n} of those that aren't null or NaN, and the
    current one's average rank among them as a share, _{name}_r{n}.

    A frame is made from its own rows alone, so what lies outside costs it no digits, however far it is: two closes that
    differ in the fourth place after others far from them keep their deviation, and a flat frame is exactly flat. Short
    frames are window functions, of which Spark plans only those that are wanted. Longer ones would update a dozen
    aggregates for each row of each frame, so a symbol's rows go through numpy together, all frames of a width at once.
    """
    masked = {}
    axes = {name: "xy"[: len(series)] for name, series in moments.items()}
    for name, series in moments.items():
        known = [is_finite(v.cast("double")) for v in series]
        both = known[0] & known[1] if len(known) > 1 else known[0]
        masked |= {f"_{name}_{a}": F.when(both, v.cast("double")) for a, v in zip(axes[name], series, strict=True)}
    masked |= {f"_{name}_v": F.coalesce(v, F.lit(0)) for name, v in sums.items()}
    masked |= {f"_{name}_s": F.coalesce(v.cast("double"), F.lit(float("nan"))) for name, v in places.items()}
    p = panel.withColumns(masked)
    if max(widths) > SHORT:
        return _by_symbol(p, axes, tuple(sums), tuple(places), widths)
    out = {"_place": F.row_number().over(symbol_window())}
    for n in widths:
        w = symbol_window(n)
        for name, letters in axes.items():
            x, y = F.col(f"_{name}_x"), F.col(f"_{name}_y")
            k = F.count(x).over(w)
            out[f"_{name}_n{n}"] = k
            for a in letters:
                c = F.col(f"_{name}_{a}")
                out |= {f"_{name}_m{a}{n}": F.avg(c).over(w), f"_{name}_{a}{a}{n}": F.var_pop(c).over(w) * k}
            if "y" in letters:
                out[f"_{name}_xy{n}"] = F.covar_pop(x, y).over(w) * k
        out |= {f"_{name}{n}": F.sum(f"_{name}_v").over(w) for name in sums}
    return p.withColumns(out)


def _by_symbol(p: DataFrame, axes: dict[str, str], sums: tuple[str, ...], places: tuple[str, ...], widths: tuple[int, ...]) -> DataFrame:
    """framed, for masked series _{name}_x (y) and _{name}_s and values _{name}_v: a symbol at a time, with a row a market day."""
    kinds = {n: "double" if t in ("double", "float") else "long" for n, t in p.dtypes if n in {f"_{s}_v" for s in sums}}
    names = [(f"_{m}_n{n}", "long") for n in widths for m in axes]
    names += [(f"_{m}_{c}{n}", "double") for n in widths for m, letters in axes.items() for c in [x for a in letters for x in (f"m{a}", f"{a}{a}")] + ["xy"] * (len(letters) > 1)]
    names += [(f"_{s}{n}", kinds[f"_{s}_v"]) for n in widths for s in sums] + [("_place", "long")]
    names += [(f"_{s}_{c}{n}", "double") for n in widths for s in places for c in "udr"]
    schema = p.schema
    for name, kind in names:
        schema = T.StructType([*schema.fields, T.StructField(name, T.LongType() if kind == "long" else T.DoubleType())])

    def frames(t: pa.Table) -> pa.Table:
        t = t.sort_by("_trade_index")
        out = {"_place": np.arange(1, len(t) + 1)}
        for n in widths:
            ends = lambda v, gap, n=n: np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(n - 1, gap, v.dtype), v]), n)
            for m, letters in axes.items():
                rest = {}
                for a in letters:
                    w = ends(t[f"_{m}_{a}"].to_numpy(), np.nan)
                    known = ~np.isnan(w)
                    k = known.sum(1)
                    low = np.where(known, w, np.inf).min(1)  # from the least on, so that equal values differ by exactly 0
                    low = np.where(k > 0, low, np.nan)
                    d = np.where(known, w - low[:, None], 0.0)
                    mean = d.sum(1) / np.maximum(k, 1)
                    rest[a] = np.where(known, d - mean[:, None], 0.0)
                    out |= {f"_{m}_n{n}": k, f"_{m}_m{a}{n}": low + mean, f"_{m}_{a}{a}{n}": np.where(k > 0, (rest[a] ** 2).sum(1), np.nan)}
                if len(letters) > 1:
                    out[f"_{m}_xy{n}"] = np.where(k > 0, (rest["x"] * rest["y"]).sum(1), np.nan)
            for s in places:
                c = t[f"_{s}_s"].to_numpy()
                w = np.sort(ends(c, np.nan), 1)  # what is missing comes last
                k, row = (~np.isnan(w)).sum(1), np.arange(len(w))
                for a, q in (("u", 0.8), ("d", 0.2)):
                    at = (k - 1) * q
                    below = np.floor(at).astype("i8")
                    low, high = w[row, np.maximum(below, 0)], w[row, np.maximum(np.minimum(below + 1, k - 1), 0)]
                    out[f"_{s}_{a}{n}"] = low + (high - low) * (at - below)
                first, last = (w < c[:, None]).sum(1) + 1, (w <= c[:, None]).sum(1)
                out[f"_{s}_r{n}"] = np.where(np.isnan(c), np.nan, (first + last) / 2.0 / np.maximum(k, 1))
            out |= {f"_{s}{n}": ends(t[f"_{s}_v"].to_numpy().astype("f8" if kinds[f"_{s}_v"] == "double" else "i8"), 0).sum(1) for s in sums}
        made = [pa.array(out[name], pa.int64() if kind == "long" else pa.float64(), from_pandas=True) for name, kind in names]
        return pa.table([*t.columns, *made], names=[*t.column_names, *[name for name, _ in names]])

    return p.groupBy("ts_code").applyInArrow(frames, schema)


def _deviation(name: str, n: int, axis: str = "x") -> Column:
    """The sample deviation of a series' frame; null for under two values."""
    k = F.col(f"_{name}_n{n}")
    return F.when(k > 1, F.sqrt(F.col(f"_{name}_{axis}{axis}{n}") / (k - 1)))


def _last(values: str, n: int) -> Column:
    """The last n of the values that the longest frame listed."""
    return F.slice(values, F.greatest(F.size(values) - (n - 1), F.lit(1)), n)


def price(n: int, longest: int) -> Family:
    """Lagged close, mean, deviation, highest high, lowest low and place between them."""
    w, c = symbol_window(n), F.col("_close")
    low, high = F.col(f"_low{n}"), F.col(f"_high{n}")
    return Family(
        windows={f"_lag{n}": F.lag(c, n).over(symbol_window()), f"_low{n}": F.min("_low").over(w), f"_high{n}": F.max("_high").over(w)}, moments={"c": (c,)},
        features={
            f"roc{n}": _close(F.col(f"_lag{n}")), f"ma{n}": _close(F.col(f"_c_mx{n}")), f"std{n}": _close(_deviation("c", n)),
            f"max{n}": _close(high), f"min{n}": _close(low), f"rsv{n}": (c - low) / (high - low + EPS),
        },
    )


def regression(n: int, longest: int) -> Family:
    """Slope on the market-day index, share of variance explained, and residual; days without a close don't count."""
    c, x = F.col("_close"), F.col("_trade_index").cast("double")
    xx, xy, yy = F.col(f"_reg_xx{n}"), F.col(f"_reg_xy{n}"), F.col(f"_reg_yy{n}")
    slope = F.try_divide(xy, xx)
    fit = F.col(f"_reg_my{n}") + slope * (x - F.col(f"_reg_mx{n}"))
    return Family(moments={"reg": (x, c)}, features={f"beta{n}": _close(slope), f"rsqr{n}": F.when(_deviation("reg", n, "y") > FLAT, F.try_divide(xy * xy, xx * yy)), f"resi{n}": _close(c - fit)})


def quantile_rank(n: int, longest: int) -> Family:
    """Linear 0.8 and 0.2 quantiles, and the current close's average rank as a share, of the sorted closes of the frame.

    Of short frames the longest is listed once, and the other widths are its last values; others go through numpy.
    """
    if longest > SHORT:
        return Family(places={"close": F.col("_close")}, features={f"qtlu{n}": _close(F.col(f"_close_u{n}")), f"qtld{n}": _close(F.col(f"_close_d{n}")), f"rank{n}": F.col(f"_close_r{n}")})
    listed = F.collect_list(F.coalesce("_close", F.lit(float("nan")))).over(symbol_window(longest))
    c, seen = F.col("_close"), F.col(f"_sorted{n}")
    k = F.size(seen)

    def quantile(q: float) -> Column:
        at = (k - 1) * F.lit(q)
        below = F.floor(at).cast("int")
        a, b = F.get(seen, below), F.get(seen, F.least(below + 1, k - 1))
        return F.when(k > 0, a + (b - a) * (at - below))

    first, last = F.array_position(seen, c), k - F.array_position(F.reverse(seen), c) + 1
    return Family(windows={"_closes": listed}, features={
        f"_sorted{n}": F.sort_array(F.filter(_last("_closes", n), lambda v: ~F.isnan(v))),
        f"qtlu{n}": _close(quantile(0.8)), f"qtld{n}": _close(quantile(0.2)), f"rank{n}": F.when(c.isNotNull(), (first + last) / 2.0 / k),
    })


def extrema(n: int, longest: int) -> Family:
    """Where in the window the highest high and the lowest low lie (the oldest of equals), and the distance between."""
    w, i, h, low = symbol_window(n), F.col("_trade_index"), F.col("_high"), F.col("_low")
    place = lambda at: (F.col(f"_rows{n}") - (i - at)) / F.lit(float(n))
    return Family(windows={
        f"_top{n}": F.max(F.when(h.isNotNull(), F.struct(h.alias("v"), (-i).alias("i")))).over(w), f"_bottom{n}": F.min(F.when(low.isNotNull(), F.struct(low.alias("v"), i.alias("i")))).over(w),
        f"_rows{n}": F.count(F.lit(1)).over(w),
    }, features={f"imax{n}": place(-F.col(f"_top{n}.i")), f"imin{n}": place(F.col(f"_bottom{n}.i")), f"imxd{n}": F.col(f"imax{n}") - F.col(f"imin{n}")})


def correlation(n: int, longest: int) -> Family:
    """Close against log volume, and their ratios against each other; null where either is flat."""
    out = {}
    for name in ("corr", "cord"):
        xx, yy = F.col(f"_{name}_xx{n}"), F.col(f"_{name}_yy{n}")
        r = F.col(f"_{name}_xy{n}") / F.sqrt(xx * yy)
        out[f"{name}{n}"] = F.when((_deviation(name, n) > FLAT) & (_deviation(name, n, "y") > FLAT), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))
    return Family(moments={"corr": (F.col("_close"), F.col("_lv")), "cord": (F.col("_cr"), F.col("_lvr"))}, features=out)


def count_sum(n: int, longest: int) -> Family:
    """Shares of rising and falling days (a missing change counts as neither), and of gains and losses."""
    d, rows = F.col("_dp"), F.least(F.col("_place"), F.lit(n))
    up, down, known = F.col(f"_up{n}") / rows, F.col(f"_down{n}") / rows, F.col(f"_moves{n}") > 0
    gain, loss = F.col(f"_gain{n}"), F.col(f"_loss{n}")
    share = lambda x: F.when(known, x / (gain + loss + EPS))
    return Family(
        sums={"up": (d > 0).cast("long"), "down": (d < 0).cast("long"), "moves": F.when(d.isNotNull(), 1), "gain": F.greatest(d, F.lit(0.0)), "loss": F.greatest(-d, F.lit(0.0))},
        features={f"cntp{n}": up, f"cntn{n}": down, f"cntd{n}": up - down, f"sump{n}": share(gain), f"sumn{n}": share(loss), f"sumd{n}": share(gain - loss)},
    )


def volume(n: int, longest: int) -> Family:
    """Mean and deviation of volume, variation of volume-weighted moves, and shares of volume gained and lost.

    Changes of volume are summed exactly, as whole numbers of VOLUME_UNIT-th shares.
    """
    v, d = F.col("_volume"), F.floor(F.col("_dv") * VOLUME_UNIT + 0.5).cast("long")
    gain, every, known = F.col(f"_vgain{n}"), F.col(f"_vall{n}"), F.col(f"_vmoves{n}") > 0
    share = lambda x: F.when(known, x / VOLUME_UNIT / (every / VOLUME_UNIT + EPS))
    return Family(
        moments={"v": (v,), "move": (F.col("_move"),)}, sums={"vall": F.abs(d), "vgain": F.greatest(d, F.lit(0).cast("long")), "vmoves": F.when(d.isNotNull(), 1)},
        features={
            f"vma{n}": F.col(f"_v_mx{n}") / (v + EPS), f"vstd{n}": _deviation("v", n) / (v + EPS), f"wvma{n}": _deviation("move", n) / (F.col(f"_move_mx{n}") + EPS),
            f"vsump{n}": share(gain), f"vsumn{n}": share(every - gain), f"vsumd{n}": share(gain - (every - gain)),
        },
    )


FAMILIES: dict[str, Callable[[int, int], Family]] = {"price": price, "regression": regression, "quantile_rank": quantile_rank, "extrema": extrema, "correlation": correlation, "count_sum": count_sum, "volume": volume}


def rolling(panel: DataFrame, families: tuple[str, ...] = tuple(FAMILIES), widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """Adds the families' columns at every width to a panel with lag_inputs; keeps all rows, for later windows.

    Windows come before frames that go through numpy, since Spark can't tell how the rows of these are dealt and would shuffle
    all their columns for a window after them; families of windows alone are done first, so that no list goes through numpy.
    """
    parts = [FAMILIES[f](n, max(widths)) for f in families for n in widths]
    names = [k for p in parts for k in p.features if not k.startswith("_")]
    wide, made = panel, []
    for with_frames in (False, True):
        some = [p for p in parts if bool(p.moments or p.sums or p.places) == with_frames]
        windows, moments, sums, places, steps = ({k: v for p in some for k, v in getattr(p, kind).items()} for kind in ("windows", "moments", "sums", "places", "features"))
        wide = wide.withColumns(windows) if windows else wide
        wide = framed(wide, moments, sums, widths, places) if moments or sums or places else wide
        for first in (True, False):  # sorted frames and places are read by other features
            named = {k: v for k, v in steps.items() if k.startswith(("_sorted", "imax", "imin")) == first}
            wide = wide.withColumns(named) if named else wide
        # of names, for each use of an expression would be code of its own
        own = [k for k in steps if not k.startswith("_")]
        wide = wide.withColumns({k: finite(F.col(k)) for k in own}) if own else wide
        made += own
        wide = wide.select(*panel.columns, *made)
    return wide.select(*panel.columns, *names)


def selected(df: DataFrame, groups: dict[str, list[str]], wanted: list[str]) -> list[str]:
    """The columns of the wanted groups, in order; unknown groups and missing columns are refused."""
    if unknown := [g for g in wanted if g not in groups]:
        raise ValueError(f"unknown groups: {unknown}")
    names = [c for g in wanted for c in groups[g]]
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return list(dict.fromkeys(names))
