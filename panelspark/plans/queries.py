"""Registered queries of the panel operators, each beside its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, identity
from ..functions.stats import rounded
from ..operators import analysis, checks, compare, context, features, labels, lineage, ml, panel, portfolio, report, signals, status
from ..sources import bars, files, masters
from ..functions.storage import new_path, stored
from ..streaming import journal, online, progress
from ..streaming import runs as runs_stream
from .oracle import W, fin, rolling, sql
from .tables import Tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None, weekly: bool = True, digits: int = 9) -> Callable:
    """Registers a function of Tables."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(Tables(spark, sf_dir, weekly)), digits=digits)
        if oracle:
            SQL[name] = oracle
        return f

    return register


def cols(*names: str, digits: int = 9) -> str:
    return ", ".join(fin(n, digits=digits) for n in names)


OHLC = ("open", "high", "low", "close", "vol", "amount")


# Bars, calendar, panel


@query("bars_daily", sql(f"select ts_code, trade_date, {cols(*OHLC)} from bars", False), False)
def bars_daily(t: Tables) -> DataFrame:
    return t.source


@query("bars_weekly", sql(f"select ts_code, trade_date, {cols(*OHLC)} from bars"))
def bars_weekly(t: Tables) -> DataFrame:
    return t.source


@query("lifecycle_bounds", sql("select ts_code, name, list_date, panel_end from bounds"))
def lifecycle_bounds(t: Tables) -> DataFrame:
    return t.bounds


ADJUSTED = ("_open", "_high", "_low", "_close", "_volume", "_vwap")


@query("panel_dense", sql(f"select ts_code, name, trade_date, _trade_index::bigint as _trade_index, _has_market_data, {cols(*ADJUSTED, digits=12)} from panel"), digits=12)
def panel_dense(t: Tables) -> DataFrame:
    return t.panel.select("ts_code", "name", "trade_date", "_trade_index", "_has_market_data", *ADJUSTED)


@query("calendar_aligned", sql("select trade_date, _trade_index::bigint as _trade_index from days", False), False)
def calendar_aligned(t: Tables) -> DataFrame:
    return panel.align_calendar(t.bars, t.days)


@query("key_violations", """select 'null_key' as rule, count(*) filter (user_id is null or ts is null)::bigint as violations from events union all select 'bad_date', 0::bigint
  union all select 'repeated_key', coalesce(sum(n - 1), 0)::bigint from (select count(*) as n from events group by user_id, strftime(ts, '%Y%m%d'))""")  # fmt: skip
def key_violations(t: Tables) -> DataFrame:
    e = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("ts_code"), F.date_format("ts", "yyyyMMdd").alias("trade_date"))
    return checks.key_violations(e)


@query("market_violations", sql("""select 'bad_' || c as rule, 0::bigint as violations from (values ('open'), ('high'), ('low'), ('close'), ('adj_factor'), ('vol'), ('amount')) v(c)
  union all select 'repeated_key', coalesce(sum(n - 1), 0)::bigint from (select count(*) as n from quotes group by ts_code, trade_date)"""))  # fmt: skip
def market_violations(t: Tables) -> DataFrame:
    return checks.market_violations(t.quotes)


@query("signal_violations", "select unnest(['score_not_finite', 'flag_null', 'several_times', 'rank_without_candidate', 'rank_gap']) as rule, 0::bigint as violations")
def signal_violations(t: Tables) -> DataFrame:
    return checks.signal_violations(t.ranked)


#: Faults planted by the sum of symbol and day: column, divisor, value.
MARKET_FAULTS = (("open", 11, "null"), ("high", 13, "double('nan')"), ("low", 17, "-1.0"), ("close", 19, "0.0"), ("adj_factor", 23, "double('inf')"), ("vol", 29, "-1.0"), ("amount", 31, "null"))
_KEY_SUM = "(cast(ts_code as bigint) + cast(trade_date as bigint))"


def _market_faults_sql() -> str:
    put = ", ".join(f"case when {_KEY_SUM} % {m} = 0 then {v.replace('double(', '(')}::double else {c} end as {c}" for c, m, v in MARKET_FAULTS)
    bad = lambda c: f"{c} is null or not isfinite({c}) or {c} {'<' if c in ('vol', 'amount') else '<='} 0"
    counts = " union all ".join(f"select 'bad_{c}' as rule, count(*) filter ({bad(c)})::bigint as violations from twice" for c, _, _ in MARKET_FAULTS)
    return sql(counts + " union all select 'repeated_key', (count(*) - count(distinct (ts_code, trade_date)))::bigint from twice", faulty=f"select ts_code, trade_date, {put} from quotes", twice=f"select * from faulty union all select * from faulty where {_KEY_SUM} % 7 = 0")


@query("market_violations_found", _market_faults_sql())
def market_violations_found(t: Tables) -> DataFrame:
    faulty = t.quotes.select("ts_code", "trade_date", *[F.expr(f"case when {_KEY_SUM} % {m} = 0 then {v} else {c} end as {c}") for c, m, v in MARKET_FAULTS])
    return checks.market_violations(faulty.unionByName(faulty.where(f"{_KEY_SUM} % 7 = 0")))


@query("signal_violations_found", sql("""select 'score_not_finite' as rule, count(*) filter (pred is null)::bigint as violations from seen
  union all select 'flag_null', count(*) filter (buyable is null)::bigint from seen
  union all select 'several_times', count(*) filter (times > 1)::bigint from seen
  union all select 'rank_without_candidate', count(*) filter (target_rank is not null and not coalesce(buyable, false))::bigint from seen
  union all select 'rank_gap', count(*) filter (target_rank is not null and target_rank <> place)::bigint from seen""",
  seen="select f.*, n.times, case when target_rank is not null then row_number() over (partition by trade_date, target_rank is null order by target_rank, ts_code) end as place from faults f join times_of n using (trade_date)",
  times_of="select trade_date, count(distinct trade_time) as times from faults group by 1",
  faults=f"""select trade_date, ts_code, case when {_KEY_SUM} % 11 <> 0 then pred end as pred, case when {_KEY_SUM} % 13 <> 0 then is_buyable_at_signal end as buyable,
    case when {_KEY_SUM} % 97 = 0 then '1400' else '1500' end as trade_time, target_rank + (trade_date::bigint % 9 = 0)::int as target_rank from ranked"""))  # fmt: skip
def signal_violations_found(t: Tables) -> DataFrame:
    put = {
        "pred": f"case when {_KEY_SUM} % 11 = 0 then double('nan') else pred end", "is_buyable_at_signal": f"case when {_KEY_SUM} % 13 <> 0 then is_buyable_at_signal end",
        "trade_time": f"case when {_KEY_SUM} % 97 = 0 then '1400' else '1500' end", "target_rank": "target_rank + case when cast(trade_date as bigint) % 9 = 0 then 1 else 0 end",
    }
    return checks.signal_violations(t.ranked.withColumns({c: F.expr(e) for c, e in put.items()}))


@query("anti_semi_keys", sql("select ts_code, (ts_code in (select ts_code from mst)) as in_master from (select distinct ts_code from bars)"))
def anti_semi_keys(t: Tables) -> DataFrame:
    all_ = t.bars.select("ts_code").distinct()
    known = all_.join(t.master.select("ts_code"), "ts_code", "left_semi").withColumn("in_master", F.lit(True))
    return known.unionByName(checks.missing_keys(all_, t.master, ["ts_code"]).withColumn("in_master", F.lit(False)))


@query("loaded_masters", sql("""select 'calendar' as kind, null::varchar as ts_code, trade_date as day, null::varchar as name from days where _trade_index % 7 <> 0
  union all select 'symbols', ts_code, case when ts_code::bigint % 2 = 1 then list_date end, name from mst
  union all select 'names', ts_code, known, known_name from nm"""))  # fmt: skip
def loaded_masters(t: Tables) -> DataFrame:
    """Each seventh day closed, days listed twice, even symbols with an empty last day, odd ones with their first: written, then loaded."""
    cal = t.days.select(F.col("trade_date").cast("int").alias("cal_date"), F.when(F.col("_trade_index") % 7 == 0, 0).otherwise(1).alias("is_open"))
    listed = t.master.withColumn("delist_date", F.when(F.col("ts_code").cast("long") % 2 == 0, "").otherwise(F.col("list_date")))
    raw = {"calendar": cal.unionByName(cal), "listed": listed, "names": bars.names(t.bars, t.days)}
    paths = {name: new_path(t.spark, name) for name in raw}
    for name, df in raw.items():
        files.write_parquet(df, paths[name])
    days, stocks, names = masters.load_masters(t.spark, **paths)
    none = F.lit(None).cast("string")
    out = days.select(F.lit("calendar").alias("kind"), none.alias("ts_code"), F.col("trade_date").alias("day"), none.alias("name"))
    out = out.unionByName(stocks.select(F.lit("symbols").alias("kind"), "ts_code", F.col("delist_date").alias("day"), "name"))
    return out.unionByName(names.select(F.lit("names").alias("kind"), "ts_code", F.col("_known_date").alias("day"), "name"))


# Bar and rolling features

BAR = {
    "kmid": "(_close - _open) / nullif(_open, 0)", "klen": "(_high - _low) / nullif(_open, 0)", "kmid2": "(_close - _open) / (_high - _low + 1e-12::double)", "kup": "(_high - greatest(_open, _close)) / nullif(_open, 0)",
    "kup2": "(_high - greatest(_open, _close)) / (_high - _low + 1e-12::double)", "klow": "(least(_open, _close) - _low) / nullif(_open, 0)", "klow2": "(least(_open, _close) - _low) / (_high - _low + 1e-12::double)",
    "ksft": "(2 * _close - _high - _low) / nullif(_open, 0)", "ksft2": "(2 * _close - _high - _low) / (_high - _low + 1e-12::double)",
    "open0": "_open / nullif(_close, 0)", "high0": "_high / nullif(_close, 0)", "low0": "_low / nullif(_close, 0)", "vwap0": "_vwap / nullif(_close, 0)",
}


@query("kbar_features", sql(f"select ts_code, trade_date, {', '.join(fin(e, n) for n, e in BAR.items())} from panel where _has_market_data"))
def kbar_features(t: Tables) -> DataFrame:
    return features.bar_features(t.panel).where("_has_market_data").select("ts_code", "trade_date", *BAR)


@query("final_dataset", sql(f"""select trade_date, ts_code, buyable, {fin('close', 'signal_price')}, {fin('adj_factor', 'signal_adjustment_factor')}, {', '.join(fin(e, n.upper()) for n, e in BAR.items())}
  from flagged where _has_market_data and trade_date between '19950101' and '19971231'"""))  # fmt: skip
def final_dataset(t: Tables) -> DataFrame:
    f = features.bar_features(stored(t.flagged, "flagged")).withColumns({"signal_price": F.col("close"), "signal_adjustment_factor": F.col("adj_factor")})
    return panel.finalize(f, {n: n.upper() for n in BAR}, ["buyable"], ["signal_price", "signal_adjustment_factor"], "19950101", "19971231")



LAGS = {"prev_close": "_pc", "prev_volume": "_pv", "close_change": "_dp", "volume_change": "_dv", "close_ratio": "_cr", "log_volume_ratio": "_lvr"}


@query("lag_inputs", sql(f"select ts_code, trade_date, {', '.join(fin(e, n, 12) for n, e in LAGS.items())} from lagged"), digits=12)
def lag_inputs(t: Tables) -> DataFrame:
    return t.lagged.select("ts_code", "trade_date", *[F.col(e).alias(n) for n, e in LAGS.items()])


def _corr(x: str, y: str) -> str:
    px, py = f"case when {y} is not null then {x} end", f"case when {x} is not null then {y} end"
    sx, sy = f"stddev_samp({px}) over w{{n}}", f"stddev_samp({py}) over w{{n}}"
    r = f"covar_samp({px}, {py}) over w{{n}} / nullif({sx} * {sy}, 0)"
    return f"case when {sx} > 2e-5::double and {sy} > 2e-5::double then greatest(least({r}, 1), -1) end"


_X = "case when _close is not null then _trade_index end"
_SLOPE = f"covar_pop(_close, ({_X})::double) over w{{n}} / nullif(var_pop(({_X})::double) over w{{n}}, 0)"


def _gain(d: str) -> tuple[str, str, str]:
    pos, neg = f"sum(case when {d} is not null then greatest({d}, 0) end) over w{{n}}", f"sum(case when {d} is not null then greatest(-{d}, 0) end) over w{{n}}"
    total = f"(sum(abs({d})) over w{{n}} + 1e-12::double)"
    return f"{pos} / {total}", f"{neg} / {total}", f"({pos} - {neg}) / {total}"


_UP, _DOWN = ("avg(coalesce((_dp {} 0)::int, 0)::double) over w{{n}}".format(s) for s in "><")
_P = _gain("_dp")
_DV = "floor(_dv * 1048576::double + 0.5::double)::bigint"  # whole parts of a share, summed exactly
_ALL, _VUP = f"(sum(abs({_DV})) over w{{n}})::double", f"(sum(case when _dv is not null then greatest({_DV}, 0) end) over w{{n}})::double"
_V = tuple(f"({x}) / 1048576::double / ({_ALL} / 1048576::double + 1e-12::double)" for x in (_VUP, f"{_ALL} - {_VUP}", f"{_VUP} - ({_ALL} - {_VUP})"))
_HIGH, _LOW = "max(case when _high is not null then row(_high, -_trade_index) end) over w{n}", "min(case when _low is not null then row(_low, _trade_index) end) over w{n}"
_AT = "(count(*) over w{{n}} - (_trade_index - {})) / {{n}}::double"
_IMAX, _IMIN = _AT.format(f"-struct_extract({_HIGH}, 2)"), _AT.format(f"struct_extract({_LOW}, 2)")
_RANK = "list_filter(list(_close) over w{n}, lambda v: v is not null)"
FAMILIES: dict[str, tuple[str, dict[str, str]]] = {
    "roll_price": ("price", {"roc": "lag(_close, {n}) over o / nullif(_close, 0)", "ma": "avg(_close) over w{n} / nullif(_close, 0)", "std": "stddev_samp(_close) over w{n} / nullif(_close, 0)", "max": "max(_high) over w{n} / nullif(_close, 0)", "min": "min(_low) over w{n} / nullif(_close, 0)", "rsv": "(_close - min(_low) over w{n}) / (max(_high) over w{n} - min(_low) over w{n} + 1e-12::double)"}),
    "roll_regression": ("regression", {
        "beta": f"{_SLOPE} / nullif(_close, 0)",
        "rsqr": f"case when stddev_samp(_close) over w{{n}} > 2e-5::double then pow(covar_samp(_close, ({_X})::double) over w{{n}} / nullif(stddev_samp(_close) over w{{n}} * stddev_samp(({_X})::double) over w{{n}}, 0), 2) end",
        "resi": f"(_close - (avg(_close) over w{{n}} + {_SLOPE} * (_trade_index - avg(({_X})::double) over w{{n}}))) / nullif(_close, 0)",
    }),
    "roll_quantile_rank": ("quantile_rank", {
        "qtlu": "quantile_cont(_close, 0.8) over w{n} / nullif(_close, 0)", "qtld": "quantile_cont(_close, 0.2) over w{n} / nullif(_close, 0)",
        "rank": f"case when _close is not null then (len(list_filter({_RANK}, lambda v: v < _close)) + (len(list_filter({_RANK}, lambda v: v = _close)) + 1) / 2.0::double) / len({_RANK}) end",
    }),
    "roll_extrema": ("extrema", {"imax": _IMAX, "imin": _IMIN, "imxd": f"{_IMAX} - {_IMIN}"}),
    "roll_corr": ("correlation", {"corr": _corr("_close", "_lv"), "cord": _corr("_cr", "_lvr")}),
    "roll_count_sum": ("count_sum", {"cntp": _UP, "cntn": _DOWN, "cntd": f"{_UP} - {_DOWN}", "sump": _P[0], "sumn": _P[1], "sumd": _P[2]}),
    "roll_volume": ("volume", {"vma": "avg(_volume) over w{n} / (_volume + 1e-12::double)", "vstd": "stddev_samp(_volume) over w{n} / (_volume + 1e-12::double)", "wvma": "stddev_samp(_move) over w{n} / (avg(_move) over w{n} + 1e-12::double)", "vsump": _V[0], "vsumn": _V[1], "vsumd": _V[2]}),
}


#: What the rolling families read.
ROLLED = ("ts_code", "trade_date", "_trade_index", "_has_market_data", "_close", "_high", "_low", "_volume", "_dp", "_dv", "_cr", "_lv", "_lvr", "_move")


def _family(family: str, names: list[str]) -> Callable[[Tables], DataFrame]:
    return lambda t: features.rolling(t.lagged.select(*ROLLED), (family,)).where("_has_market_data").select("ts_code", "trade_date", *[f"{c}{n}" for n in features.WIDTHS for c in names])


for _name, (_f, _e) in FAMILIES.items():
    query(_name, rolling(_f, _e))(_family(_f, list(_e)))


# Point-in-time state


@query("asof_strict", sql("select ts_code, trade_date, name from named"))
def asof_strict(t: Tables) -> DataFrame:
    return t.named.select("ts_code", "trade_date", "name")


WEIGHTS = {
    "wt": "select con_code, trade_date, 100.0::double / 30 as weight from (select distinct ts_code as con_code from bars order by 1 limit 30) c, (select trade_date from days where _trade_index % 20 = 0)",
    "snaps": "select d.trade_date, max(s.trade_date) as snap from days d left join (select distinct trade_date from wt) s on s.trade_date <= d.trade_date group by 1",
    "weighted": "select p.*, case when s.snap is not null then coalesce(w.weight / 100, 0) end as index_weight from panel p join snaps s using (trade_date) left join wt w on w.trade_date = s.snap and w.con_code = p.ts_code",
}


@query("asof_snapshot", sql(f"select ts_code, trade_date, {cols('index_weight')} from weighted", **WEIGHTS))
def asof_snapshot(t: Tables) -> DataFrame:
    return panel.index_weights(t.panel, bars.weights(t.bars, t.days)).select("ts_code", "trade_date", "index_weight")


@query("price_limits", sql(f"select ts_code, trade_date, {cols('up_limit_', 'down_limit_')}, fallback from limited"))
def price_limits(t: Tables) -> DataFrame:
    return t.limited.select("ts_code", "trade_date", "up_limit_", "down_limit_", "fallback")


FLAGS = ("is_st", "is_delisting", "at_up_limit", "at_down_limit", "history_short", "buyable", "can_buy", "can_sell", "market_status")


@query("market_flags", sql(f"select ts_code, trade_date, {', '.join(FLAGS)} from flagged"))
def market_flags(t: Tables) -> DataFrame:
    return t.flagged.select("ts_code", "trade_date", *FLAGS)


@query("status_merge", sql(f"select trade_date, ts_code, {cols('price', 'adjustment_factor')}, can_buy, can_sell, case when market_status = 'missing_data' then 'suspended' else market_status end as market_status from market"))
def status_merge(t: Tables) -> DataFrame:
    return status.missing_as_suspended(t.market)


@query("quality_counters", sql("""select count(*) filter (up_limit is null or down_limit is null)::bigint as missing_limit_rows, count(*) filter (fallback)::bigint as fallback_limit_rows,
  (select count(*) from (select distinct ts_code from limited) where ts_code not in (select ts_code from mst))::bigint as symbols_not_in_master from limited where _has_market_data"""))  # fmt: skip
def quality_counters(t: Tables) -> DataFrame:
    return status.quality_counters(t.limited, t.master)


@query("signals", sql(f"select trade_date, trade_time, ts_code, {cols('pred', 'signal_price', 'signal_adjustment_factor')}, is_model_candidate, is_buyable_at_signal from signals"))
def signals_(t: Tables) -> DataFrame:
    return t.signals


# Labels


@query("next_day_labels", sql(f"select trade_date, ts_code, label_target_date, {cols('label_return')}, label_valid, label_status from labels"))
def next_day_labels(t: Tables) -> DataFrame:
    return t.labels


def _training(t: Tables) -> DataFrame:
    return t.scored_labels.where("label_valid").select("trade_date", "ts_code", "pred", "label_target_date", "label_return")


@query("tail_trim", sql(f"select trade_date, ts_code, {cols('label_return')} from train join (select trade_date, quantile_cont(label_return, 0.1) as a, quantile_cont(label_return, 0.9) as b from train group by 1) using (trade_date) where label_return between a and b"))
def tail_trim(t: Tables) -> DataFrame:
    return labels.tail_trim(_training(t), "label_return", 0.1).select("trade_date", "ts_code", "label_return")


@query("label_transforms", sql(
    f"""select trade_date, ts_code, {fin('case when n > 1 then (k - 1) / (n - 1) else 0.5 end', 'label_return_rank')}, {fin('case when sd > 1e-12::double then (x - mu) / sd else 0 end', 'label_return_csz')} from lt2""",
    lt0="select trade_date, quantile_cont(label_return, 0.025) as a, quantile_cont(label_return, 0.975) as b from train group by 1",
    lt1="select *, count(*) over (partition by trade_date) as n, rank() over (partition by trade_date order by label_return) + (count(*) over (partition by trade_date, label_return) - 1) / 2.0::double as k, greatest(least(label_return, b), a) as x from train join lt0 using (trade_date)",
    lt2="select *, avg(x) over (partition by trade_date) as mu, stddev_pop(x) over (partition by trade_date) as sd from lt1",
))
def label_transforms(t: Tables) -> DataFrame:
    return labels.label_transforms(_training(t)).select("trade_date", "ts_code", "label_return_rank", "label_return_csz")


@query("purged_split", sql(
    "select part, count(*)::bigint as n, min(trade_date) as first_day, max(trade_date) as last_day from (select *, case when trade_date >= s then 'valid' when label_target_date < s then 'fit' else 'purged' end as part from train cross join sp1) group by 1",
    sp0="select trade_date, row_number() over (order by trade_date desc) as k, count(*) over () as n from (select distinct trade_date from train)", sp1="select min(trade_date) as s from sp0 where k <= greatest(1, least(n - 1, ceil(0.1 * n)))",
))
def purged_split(t: Tables) -> DataFrame:
    return labels.purged_split(_training(t), 0.1).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"))


@query("training_rows", sql(f"""select f.trade_date, f.ts_code, {fin('l.label_return', 'label_return')} from flagged f join labels l using (trade_date, ts_code)
  where f.buyable and f.trade_date >= '19930101' and f.trade_date < '19970101' and l.label_valid and l.label_target_date < '19970101'"""))  # fmt: skip
def training_rows(t: Tables) -> DataFrame:
    f = t.traded
    s = t.signals
    return labels.training_rows(f.select("trade_date", "ts_code", "buyable"), labels.next_day_labels(s, t.market, t.days), "19930101", "19970101").select("trade_date", "ts_code", "label_return")


# Factor diagnostics


def _factor_rows(t: Tables) -> DataFrame:
    f = features.rolling(t.traded, ("price",), (5,)).select("trade_date", "ts_code", "ma5")  # of the panel's rows and prices
    return _training(t).join(f, ["ts_code", "trade_date"])


def _pairs(t: Tables) -> DataFrame:
    return analysis.factor_pairs(_factor_rows(t), ["pred", "ma5"], "label_return")


_PROFILE = ", ".join(f"select '{c}' as factor, {c}::double as v from bars" if i == 0 else f"select '{c}', {c}::double from bars" for i, c in enumerate(OHLC)).replace(", select", " union all select")


@query("column_profile", sql(f"""select factor, count(*)::bigint as total, count(v)::bigint as non_null, count(*) filter (isnan(v))::bigint as nan, count(*) filter (isinf(v))::bigint as inf, count(*) filter (isfinite(v))::bigint as finite, count(*) filter (v = 0)::bigint as zero,
  {fin('count(*) filter (isfinite(v)) / count(*)', 'finite_rate')}, {fin('count(*) filter (v = 0) / count(*)', 'zero_rate')}, {fin('min(v)', 'min')}, {fin('quantile_cont(v, 0.03)', 'p03')}, {fin('quantile_cont(v, 0.5)', 'p50')}, {fin('quantile_cont(v, 0.97)', 'p97')}, {fin('max(v)', 'max')},
  {fin('avg(v)', 'mean')}, {fin('stddev_pop(v)', 'std')}, count(distinct v)::bigint as distinct from ({_PROFILE}) group by 1"""))  # fmt: skip
def column_profile(t: Tables) -> DataFrame:
    return analysis.column_profile(t.bars, list(OHLC))


@query("daily_ic", sql(f"select factor, trade_date, samples::bigint as samples, {cols('ic', 'rank_ic')} from ic"))
def daily_ic(t: Tables) -> DataFrame:
    return analysis.daily_ic(_pairs(t), 10)


_IR = "case when {0}_std > 0 then {0}_mean / {0}_std else 0 end"


@query("ic_summary", sql(f"""select factor, days::bigint as days, {cols('ic_mean', 'ic_std', 'ic_positive')}, {fin(_IR.format('ic'), 'icir')}, {fin('(' + _IR.format('ic') + ') * sqrt(n_ic)', 'ic_t')}, {cols('rankic_mean', 'rankic_std', 'rankic_positive')},
  {fin(_IR.format('rankic'), 'rankicir')}, {fin('(' + _IR.format('rankic') + ') * sqrt(n_rank)', 'rankic_t')}, {cols('rankic_p05', 'rankic_p50', 'rankic_p95')} from icsum"""))  # fmt: skip
def ic_summary(t: Tables) -> DataFrame:
    return analysis.ic_summary(analysis.daily_ic(_pairs(t), 10))


@query("quantile_returns", sql(f"select factor, quantile, {cols('mean_return', 'std_return')}, samples::bigint as samples, days::bigint as days from qb"))
def quantile_returns(t: Tables) -> DataFrame:
    return analysis.quantile_returns(_pairs(t), 5, 10)


@query("factor_spread", sql(
    f"select factor, {fin('max(mean_return) filter (quantile = 5) - max(mean_return) filter (quantile = 1)', 'spread')}, {fin('covar_samp(quantile, r) / nullif(stddev_samp(quantile) * stddev_samp(r), 0)', 'monotonicity')} from (select *, rank() over (partition by factor order by mean_return)::double as r from qb) group by 1"
))
def factor_spread(t: Tables) -> DataFrame:
    return analysis.spread_and_monotonicity(analysis.quantile_returns(_pairs(t), 5, 10), 5)


@query("factor_rank", sql(
    f"select factor, {fin('rankic_mean', 'rankic_mean')}, case when rankic_mean > 0 then 'positive' when rankic_mean < 0 then 'negative' else 'unknown' end as direction, {fin('(rank() over (order by abs(rankic_mean) desc) + rank() over (order by abs(' + _IR.format('rankic') + ') desc)) / 2', 'score_rank')} from icsum"
))
def factor_rank(t: Tables) -> DataFrame:
    return analysis.by_strength(analysis.factor_table(_factor_rows(t), ["pred", "ma5"], "label_return", 5, 10)).select("factor", "rankic_mean", "direction", "score_rank")


# Context

MOMENTS = [f"{n}{h}" for h in context.HORIZONS for n in ("mean", "var")]


@query("market_moments", sql(f"select trade_date, {', '.join(f'n{h}::bigint as n{h}' for h in context.HORIZONS)}, {cols(*MOMENTS)} from moments"))
def market_moments(t: Tables) -> DataFrame:
    return context.market_moments(context.horizon_returns(t.panel))


CONTEXT = ("beta", "momentum5", "momentum10", "momentum20", "residual_vol", "downside")


@query("context_features", sql(f"select trade_date, ts_code, {cols(*CONTEXT, digits=8)} from cx"), digits=8)
def context_features(t: Tables) -> DataFrame:
    return context.of_returns(t.returns).select("trade_date", "ts_code", *CONTEXT)


@query("prior_beta", sql(f"select ts_code, count(beta)::bigint as n, {fin('avg(beta)', 'mean_beta')}, {fin('max(beta)', 'max_beta')} from cx group by 1"))
def prior_beta(t: Tables) -> DataFrame:
    return context.of_returns(t.returns).groupBy("ts_code").agg(F.count("beta").alias("n"), F.avg("beta").alias("mean_beta"), F.max("beta").alias("max_beta"))


# Signals


@query("signal_rank", sql("select trade_date, ts_code, rank::bigint as rank, buyable_rank from ranked"))
def signal_rank(t: Tables) -> DataFrame:
    return signals.rank_signals(t.signals).select("trade_date", "ts_code", "rank", "buyable_rank")


@query("target_rank", sql("select trade_date, ts_code, target_rank::bigint as target_rank from ranked"))
def target_rank(t: Tables) -> DataFrame:
    return t.ranked.select("trade_date", "ts_code", "target_rank")


@query("topn_targets", sql(f"select trade_date, ts_code, target_rank::bigint as target_rank, {fin('0.2', 'weight')} from ranked where target_rank <= 5"))
def topn_targets(t: Tables) -> DataFrame:
    return signals.targets(t.top, 5).select("trade_date", "ts_code", "target_rank", "weight")


@query("restored_signals", sql(f"select trade_date, ts_code, {cols('pred')}, target_rank::bigint as target_rank, target_rank is not null as is_model_candidate from ranked"))
def restored_signals(t: Tables) -> DataFrame:
    r = t.ranked
    return signals.restore(t.signals, r.where("target_rank is not null")).select("trade_date", "ts_code", "pred", "target_rank", "is_model_candidate")


@query("universe_members", sql("select trade_date, count(*)::bigint as members from weighted where index_weight > 0 and _has_market_data group by 1", **WEIGHTS))
def universe_members(t: Tables) -> DataFrame:
    w = panel.index_weights(t.panel, bars.weights(t.bars, t.days)).where("_has_market_data")
    return signals.universe_of(w, "index").groupBy("trade_date").agg(F.count(F.lit(1)).alias("members"))


@query("prediction_stats", sql(f"select count(distinct trade_date)::bigint as days, count(distinct ts_code)::bigint as symbols, {fin('min(pred)', 'pred_min')}, {fin('avg(pred)', 'pred_mean')}, {fin('median(pred)', 'pred_median')}, {fin('max(pred)', 'pred_max')}, count(*) filter (is_buyable_at_signal)::bigint as buyable_rows, count(*)::bigint as candidate_rows from signals"))
def prediction_stats(t: Tables) -> DataFrame:
    return signals.prediction_statistics(t.signals)


_MW = "(values ('1992-01', '19920101', '19940101'), ('1994-01', '19940101', '19960101'), ('1996-01', '19960101', '19990101')) w(model, s, e)"


@query("model_window_route", sql(f"select d.trade_date, w.model from days d left join {_MW} on d.trade_date >= w.s and d.trade_date < w.e"))
def model_window_route(t: Tables) -> DataFrame:
    w = t.spark.createDataFrame([("1992-01", "19920101", "19940101"), ("1994-01", "19940101", "19960101"), ("1996-01", "19960101", "19990101")], "model string, start string, end string")
    return signals.in_model_window(t.days, w).select("trade_date", "model")


@query("prediction_compare", sql("""select case when b.ts_code is null then 'missing' when a.ts_code::bigint % 5 = 0 then 'protocol_mismatch' when a.ts_code::bigint % 2 = 0 then 'different' else 'consistent' end as outcome, count(*)::bigint as n
  from signals a left join (select * from signals where ts_code::bigint % 3 <> 0) b using (trade_date, ts_code) group by 1"""))  # fmt: skip
def prediction_compare(t: Tables) -> DataFrame:
    s = t.signals.select(*signals.KEYS, "pred")
    code = F.col("ts_code").cast("long")
    b = s.where(code % 3 != 0).select(*signals.KEYS, F.when(code % 2 == 0, F.col("pred") + 1).otherwise(F.col("pred")).alias("pred"), F.when(code % 5 == 0, "y").otherwise("x").alias("protocol"))
    return signals.compare_predictions(s.withColumn("protocol", F.lit("x")), b).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


# Accounting


def _orders(t: Tables, n: int) -> DataFrame:
    return portfolio.order_outcomes(signals.targets(t.top, n), t.top_market)


@query("order_outcomes", sql(f"select trade_date, ts_code, {cols('entry_price')}, reason, case when reason is null then 'filled' else 'unfilled' end as outcome from o5"))
def order_outcomes(t: Tables) -> DataFrame:
    return _orders(t, 5).select("trade_date", "ts_code", "entry_price", "reason", "outcome")


TRADE = ("entry_price", "exit_price", "principal", "realised_return", "fee")


def _trades(t: Tables, n: int, h: int) -> DataFrame:
    return portfolio.trade_log(_orders(t, n), t.top_market, t.days, h)


@query("trade_log", sql(f"select ts_code, entry_date, planned_exit, exit_date, {cols(*TRADE)}, delayed from t5"))
def trade_log(t: Tables) -> DataFrame:
    return _trades(t, 5, 2)


@query("delayed_exit", sql("select planned_exit, count(*)::bigint as trades, count(*) filter (delayed)::bigint as delayed, count(*) filter (exit_date is null)::bigint as open from t5 group by 1"))
def delayed_exit(t: Tables) -> DataFrame:
    return _trades(t, 5, 2).groupBy("planned_exit").agg(F.count(F.lit(1)).alias("trades"), F.count_if("delayed").alias("delayed"), F.count_if(F.col("exit_date").isNull()).alias("open"))


@query("position_panel", sql(f"select trade_date, ts_code, entry_date, {cols('mark', 'previous_mark')}, mark_carried from p3"))
def position_panel(t: Tables) -> DataFrame:
    return portfolio.positions(_trades(t, 3, 1), t.top_market, t.days).select("trade_date", "ts_code", "entry_date", "mark", "previous_mark", "mark_carried")


DAY = ("equity", "net_return", "gross_return", "cost", "turnover")
COUNTS = ("positions", "delayed", "unfilled")


def _daily(t: Tables, n: int, h: int) -> DataFrame:
    return portfolio.cohort_results(signals.targets(t.top, n), t.top_market, t.days, h)


@query("cohort_daily", sql(f"select trade_date, {cols(*DAY)}, {', '.join(f'{c}::bigint as {c}' for c in COUNTS)} from daily5"))
def cohort_daily(t: Tables) -> DataFrame:
    return _daily(t, 5, 2)


BAND = {
    "bd0": "select d.ts_code, d.trade_date, r.target_rank from (select distinct ts_code from signals) c join panel d using (ts_code) left join ranked r using (trade_date, ts_code)",
    "bd1": "select *, case when target_rank <= 10 then 1 when target_rank is null or target_rank > 15 then 0 end as ev from bd0",
    "bd": "select *, coalesce(last_value(ev ignore nulls) over (partition by ts_code order by trade_date rows unbounded preceding), 0) = 1 as member from bd1",
}


def _banded(t: Tables) -> DataFrame:
    grid = t.panel.select("ts_code", "trade_date").join(t.signals.select("ts_code").distinct(), "ts_code", "left_semi")
    return portfolio.rank_band(grid.join(t.ranked.select("trade_date", "ts_code", "target_rank"), ["trade_date", "ts_code"], "left"), 10, 1.5)


@query("rank_band", sql("select trade_date, ts_code from bd where member", **BAND))
def rank_band(t: Tables) -> DataFrame:
    return _banded(t).where("member").select("trade_date", "ts_code")


@query("replacements", sql(
    "select trade_date, count(*) filter (member and not was)::bigint as entries, count(*) filter (was and not member)::bigint as exits, 2::bigint as cap, count(*) filter (was and not member) > 2 as breach from bw group by 1",
    **BAND, bw="select *, coalesce(lag(member) over (partition by ts_code order by trade_date), false) as was from bd",
))
def replacements(t: Tables) -> DataFrame:
    return portfolio.replacements(_banded(t), 10)


@query("evaluation_status", sql("select case when (select coalesce(bool_or(mark_carried), false) from p5) or (select coalesce(bool_or(coalesce(reason = 'missing_data', false)), false) from o5) then 'incomplete_market_data' else 'done' end as status"))
def evaluation_status(t: Tables) -> DataFrame:
    return portfolio.evaluation_status(portfolio.positions(_trades(t, 5, 2), t.top_market, t.days), _orders(t, 5))


@query("portfolio_grid", sql("select universe, strategy, n::bigint as top_n from (select distinct ts_code as universe from bars) u, (values ('equal'), ('retain')) s(strategy), (values (5), (10), (20)) t(n)"))
def portfolio_grid(t: Tables) -> DataFrame:
    frame = t.spark.createDataFrame
    s, n = frame([("equal", "single"), ("retain", "single")], "strategy string, score_selection string"), frame([(5,), (10,), (20,), (5,)], "top_n long")
    return portfolio.grid(t.bars.select(F.col("ts_code").alias("universe")), s, n).select("universe", "strategy", "top_n")


# Reports


def _matured(t: Tables) -> DataFrame:
    labelled = labels.next_day_labels(t.signals, t.market, t.days, "trade_time", "pred", "is_model_candidate", "is_buyable_at_signal")
    return report.known(signals.target_ranks(labelled), "19980101")


MATURED = {
    "mt": "select r.trade_date, r.ts_code, r.pred, r.target_rank, l.label_return from ranked r join labels l using (trade_date, ts_code) where r.target_rank is not null and l.label_valid and l.label_target_date <= '19980101'",
    "mr": """select *, rank() over (partition by trade_date order by pred) + (count(*) over (partition by trade_date, pred) - 1) / 2.0::double as pr,
      rank() over (partition by trade_date order by label_return) + (count(*) over (partition by trade_date, label_return) - 1) / 2.0::double as yr, count(*) over (partition by trade_date) as n from mt""",
    "ng": "select *, row_number() over (partition by trade_date order by target_rank, ts_code) as pos, row_number() over (partition by trade_date order by yr desc, ts_code) as best, pow(2, yr / n) - 1 as g from mr",
}
_SAFE = "covar_samp({0}, {1}) / nullif(stddev_samp({0}) * stddev_samp({1}), 0)"


@query("daily_diagnostics", sql(f"select trade_date, count(*)::bigint as candidates, {fin(_SAFE.format('pred', 'label_return'), 'ic')}, {fin(_SAFE.format('pr', 'yr'), 'rank_ic')} from mr group by 1", **MATURED))
def daily_diagnostics(t: Tables) -> DataFrame:
    return report.daily_diagnostics(_matured(t))


@query("ndcg", sql(f"select trade_date, k::bigint as top_n, {fin('sum(g / log2(pos + 1)) filter (pos <= k) / nullif(sum(g / log2(best + 1)) filter (best <= k), 0)', 'ndcg')} from ng, (values (3), (10)) v(k) group by 1, 2", **MATURED))
def ndcg(t: Tables) -> DataFrame:
    return report.ndcg(_matured(t), (3, 10))


BENCH = {**WEIGHTS, "bm": "select l.label_target_date as trade_date, avg(l.label_return) as universe_return, case when sum(w.index_weight) >= 0.2 then sum(w.index_weight * l.label_return) / sum(w.index_weight) end as index_return from labels l left join weighted w using (trade_date, ts_code) where l.label_valid group by 1"}


def _bench(t: Tables) -> DataFrame:
    w = stored(bars.weights(t.bars, t.days), "weights")
    return report.weighted_returns(panel.index_weights(t.labels, w, calendar=t.days), 0.2)


@query("benchmarks", sql(f"select trade_date, {cols('universe_return', 'index_return')} from bm", **BENCH))
def benchmarks(t: Tables) -> DataFrame:
    return _bench(t)


@query("top_detail", sql(
    f"""select trade_date, n::bigint as candidate_count, target_rank::bigint as rank, ts_code as code, {fin('pred', 'prediction')}, {fin('label_return', 'daily_return')}, {fin('1.0 / least(n, 30)', 'weight')} from td where target_rank <= 30""",
    td="select r.trade_date, r.ts_code, r.target_rank, r.pred, l.label_return, count(*) over (partition by r.trade_date) as n from ranked r left join labels l using (trade_date, ts_code) where r.target_rank is not null",
))
def top_detail(t: Tables) -> DataFrame:
    return report.top_detail(t.ranked, t.labels).select("trade_date", "candidate_count", F.explode("holdings").alias("h")).select("trade_date", "candidate_count", "h.*")


def _long_daily(t: Tables) -> DataFrame:
    d = [_daily(t, n, h).withColumn("top_n", F.lit(n).cast("long")) for n, h in ((3, 1), (5, 2))]
    return report.attach_benchmarks(d[0].unionByName(d[1]), _bench(t))


PERIOD = {
    **BENCH,
    "ld": "select d.*, b.universe_return from (select *, 3::bigint as top_n from daily3 union all select *, 5::bigint from daily5) d left join bm b using (trade_date)",
    "pd0": """select *, gross_return - universe_return as act from (select ld.*, unnest(['overall', 'year', 'quarter', 'month']) as period_type, unnest(['all', trade_date[1:4], trade_date[1:4] || 'Q' || ceil(trade_date[5:6]::int / 3.0)::int, trade_date[1:4] || '-' || trade_date[5:6]]) as period from ld)""",
    "pd1": "select *, product(1 + net_return) over w as eq, coalesce(product(1 + act) over w, 1) as aq from pd0 window w as (partition by period_type, period, top_n order by trade_date rows unbounded preceding)",
    "pd": "select *, eq / greatest(1, max(eq) over w) - 1 as dd, aq / greatest(1, max(aq) over w) - 1 as rd from pd1 window w as (partition by period_type, period, top_n order by trade_date rows unbounded preceding)",
}


def _ir(x: str) -> str:
    return f"case when count({x}) > 1 and stddev_samp({x}) > 0 then avg({x}) / stddev_samp({x}) else 0 end"


_RF = 1.012 ** (1 / 252) - 1


@query("period_summary", sql(f"""select period_type, period, top_n, min(trade_date) as start, max(trade_date) as "end", count(net_return)::bigint as days, {fin('product(1 + net_return) - 1', 'net_total')}, {fin('product(1 + gross_return) - 1', 'gross_total')},
  {fin('case when product(1 + net_return) <= 0 then -1 else pow(product(1 + net_return), 252.0 / count(net_return)) - 1 end', 'net_annualised')}, {fin('stddev_samp(net_return) * sqrt(252)', 'net_volatility')}, {fin('min(dd)', 'max_drawdown')}, {fin('avg((net_return > 0)::int)', 'win_rate')},
  {fin('avg(turnover)', 'turnover')}, sum(delayed)::bigint as delayed, arg_max(positions, trade_date)::bigint as open_positions, {fin(f'({_ir(f"(gross_return - {_RF!r}::double)")}) * sqrt(252)', 'sharpe')}, {fin(_ir('net_return'), 'return_ir')},
  {fin(f'({_ir("act")}) * sqrt(252)', 'ir_universe_return')}, {fin('product(1 + act) - 1', 'active_total_universe_return')}, {fin('min(rd)', 'max_reldd_universe_return')} from pd group by 1, 2, 3""", **PERIOD))  # fmt: skip
def period_summary(t: Tables) -> DataFrame:
    return report.period_summary(_long_daily(t))


@query("drawdown", sql(f"select trade_date, top_n, {fin('eq', 'drawdown_equity')}, {fin('dd', 'drawdown')} from pd where period_type = 'overall'", **PERIOD))
def drawdown(t: Tables) -> DataFrame:
    p = report.by_period(_long_daily(t)).where("period_type = 'overall'")
    return report.with_drawdown(p, "net_return", "drawdown", "top_n").select("trade_date", "top_n", "drawdown_equity", "drawdown")


@query("wide_daily", sql(f"select a.trade_date, {fin('a.net_return', 'top3_net_return')}, {fin('b.net_return', 'top5_net_return')} from daily3 a join daily5 b using (trade_date)"))
def wide_daily(t: Tables) -> DataFrame:
    d = [_daily(t, n, h).withColumn("top_n", F.lit(n)) for n, h in ((3, 1), (5, 2))]
    return report.widened(d[0].unionByName(d[1]), (3, 5), ("net_return",))


# Comparison


def _two(t: Tables) -> DataFrame:
    return compare.paired_days(_daily(t, 3, 1), _daily(t, 5, 2))


CMP = {
    "cp0": "select a.trade_date, a.net_return as ra, b.net_return as rb, a.turnover as ta, b.turnover as tb, product(1 + a.net_return) over w as ea, product(1 + b.net_return) over w as eb from daily3 a join daily5 b using (trade_date) window w as (order by a.trade_date rows unbounded preceding)",
    "cp": "select *, ea / greatest(1, max(ea) over w) - 1 as da, eb / greatest(1, max(eb) over w) - 1 as db from cp0 window w as (order by trade_date rows unbounded preceding)",
}


def _side(s: str) -> str:
    return f"""{fin(f'product(1 + r{s}) - 1', f'total_{s}')}, {fin(f'case when product(1 + r{s}) <= 0 then -1 else pow(product(1 + r{s}), 252.0 / count(*)) - 1 end', f'annualised_{s}')}, {fin(f'stddev_samp(r{s}) * sqrt(252)', f'volatility_{s}')},
  {fin(f'min(d{s})', f'max_drawdown_{s}')}, {fin(f'avg((r{s} > 0)::int)', f'win_rate_{s}')}, {fin(f'avg(t{s})', f'turnover_{s}')}"""


@query("paired_stats", sql(f"select count(*)::bigint as days, {_side('a')}, {_side('b')}, {fin('case when stddev_samp(ra - rb) > 0 then avg(ra - rb) / stddev_samp(ra - rb) * sqrt(252) end', 'difference_ratio')} from cp", **CMP))
def paired_stats(t: Tables) -> DataFrame:
    return compare.strategy_stats(_two(t))


@query("period_comparison", sql(
    f"select period_type, period, {fin('product(1 + ra) - 1', 'a')}, {fin('product(1 + rb) - 1', 'b')}, {fin('product(1 + rb) - product(1 + ra)', 'difference')} from (select *, unnest(['year', 'quarter', 'month']) as period_type, unnest([trade_date[1:4], trade_date[1:4] || 'Q' || ceil(trade_date[5:6]::int / 3.0)::int, trade_date[1:4] || '-' || trade_date[5:6]]) as period from cp) group by 1, 2",
    **CMP,
))
def period_comparison(t: Tables) -> DataFrame:
    return compare.period_comparison(_two(t))


@query("paired_means", sql(f"select 'net_return' as metric, count(*)::bigint as days, {fin('avg(ra)', 'a')}, {fin('avg(rb)', 'b')} from cp union all select 'turnover', count(*)::bigint, {fin('avg(ta)', 'a')}, {fin('avg(tb)', 'b')} from cp", **CMP))
def paired_means(t: Tables) -> DataFrame:
    return compare.paired_means(_two(t), ["net_return", "turnover"])


@query("holding_overlap", sql(
    f"""select trade_date, len(list_intersect(x, y))::bigint as shared, (len(x) - len(list_intersect(x, y)))::bigint as only_a, (len(y) - len(list_intersect(x, y)))::bigint as only_b, {fin('len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y)))', 'jaccard')}
    from (select trade_date, list(ts_code) as x from ranked where target_rank <= 5 group by 1) join (select trade_date, list(ts_code) as y from ranked where buyable_rank between 3 and 8 group by 1) using (trade_date)"""
))
def holding_overlap(t: Tables) -> DataFrame:
    r = t.ranked
    return compare.holding_overlap(signals.targets(r, 5), r.where("buyable_rank between 3 and 8"))


@query("moving_average", sql(f"select trade_date, {fin('avg(ic) over w', 'ma_ic')}, {fin('avg(rank_ic) over w', 'ma_rank_ic')} from ic where factor = 'pred' window w as (order by trade_date rows between 19 preceding and current row)"))
def moving_average(t: Tables) -> DataFrame:
    d = analysis.daily_ic(analysis.factor_pairs(_training(t), ["pred"], "label_return"), 10)
    return compare.moving_average(d, ["ic", "rank_ic"]).select("trade_date", "ma_ic", "ma_rank_ic")


@query("cumulative_curves", sql(f"select 'start' as trade_date, 0::double as cumulative, 0::double as added union all select trade_date, {fin('product(1 + net_return) over w - 1', 'cumulative')}, {fin('sum(gross_return) over w', 'added')} from daily5 window w as (order by trade_date rows unbounded preceding)"))
def cumulative_curves(t: Tables) -> DataFrame:
    d = _daily(t, 5, 2)
    return compare.cumulative_curve(d).join(compare.cumulative_curve(d, "gross_return", additive=True).withColumnRenamed("cumulative", "added"), "trade_date")


# Files


@query("page_merge", sql(f"select ts_code, trade_date, {cols('close')}, {fin('vol')} from bars", False), False)
def page_merge(t: Tables) -> DataFrame:
    b = t.bars.select("ts_code", "trade_date", "close", "vol")
    k = F.pmod(F.col("ts_code").cast("long"), F.lit(10))
    return files.merge_pages(b.where(k < 4), b.where((k >= 3) & (k < 8)), b.where(k >= 7))


@query("latest_days", sql(f"""select ts_code, trade_date, {cols('close')} from bars join (select trade_date, sum(count(*)) over (order by trade_date desc) as total, row_number() over (order by trade_date desc) as k from bars group by 1) using (trade_date) where k = 1 or total <= 0.8 * 2000""", False), False)
def latest_days(t: Tables) -> DataFrame:
    return files.latest_days(t.bars, 2000).select("ts_code", "trade_date", "close")


@query("landed_partitions", sql("select 'bars' as dataset, trade_date as day, count(*)::bigint as rows from bars group by trade_date union all select 'factors', trade_date, count(*)::bigint from bars group by trade_date", False), False)
def landed_partitions(t: Tables) -> DataFrame:
    from ..functions.storage import new_path, stored

    out = {}
    for name, d in (("bars", t.bars), ("factors", bars.factors(t.bars, t.days))):
        path = new_path(t.spark, f"landed-{name}")
        files.land(d, path, [c for c in d.columns], snapshot=name == "factors")
        out[name] = t.spark.read.option("basePath", path).parquet(path)
    return files.landed_counts(out)


@query("month_windows", """with d as (select min(ts)::date as a, max(ts)::date as z from events) select k::bigint as "window", strftime(a + to_months(k::int), '%Y%m%d') as start, strftime(least(a + to_months(k::int + 1), z), '%Y%m%d') as "end" from d, range(0, 200) r(k) where a + to_months(k::int) < z""")
def month_windows(t: Tables) -> DataFrame:
    a, z = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").agg(F.date_format(F.min("ts"), "yyyyMMdd"), F.date_format(F.max("ts"), "yyyyMMdd")).first()
    return dates.month_windows(t.spark, a, z, 1)


@query("schema_report", "select unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) as \"column\", unnest([count(event_id), count(ts), count(user_id), count(event_type), count(value), count(props)])::bigint as non_null from events")
def schema_report(t: Tables) -> DataFrame:
    return files.schema_report(t.spark.read.parquet(f"{t.sf_dir}/events.parquet")).select("column", "non_null")


@query("fingerprints", "select user_id, event_type, sha256('{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}') as fingerprint from (select distinct user_id, event_type from events)")
def fingerprints(t: Tables) -> DataFrame:
    e = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").select("user_id", "event_type").distinct()
    return e.select("*", identity.fingerprint(user_id=F.col("user_id"), event_type=F.col("event_type")).alias("fingerprint"))


# Lineage

RUNS = {
    "runs": "select conv_id * 1000 + turn as run_id, case when turn > 0 then conv_id * 1000 + turn - 1 end as up, case when turn % 3 = 0 then 'failed' when turn % 7 = 6 then 'running' else 'succeeded' end as state, role as task_type, turn as created_at from (select distinct conv_id, turn, first(role order by role) as role from conversations group by conv_id, turn)",
    "ed": "select run_id, up as upstream_id from runs where up is not null",
}


def runs(t: Tables) -> DataFrame:
    """Runs of the conversations' turns, each upon the turn before."""
    c = t.spark.read.parquet(f"{t.sf_dir}/conversations.parquet").groupBy("conv_id", "turn").agg(F.min("role").alias("task_type"))
    ident = F.col("conv_id") * 1000 + F.col("turn")
    up = F.when(F.col("turn") > 0, F.array(ident - 1)).otherwise(F.array().cast("array<bigint>"))
    state = F.when(F.col("turn") % 3 == 0, "failed").when(F.col("turn") % 7 == 6, "running").otherwise("succeeded")
    return c.select(ident.alias("run_id"), up.alias("upstream_ids"), state.alias("state"), "task_type", F.col("turn").alias("created_at"))


@query("lineage_upstream", sql(
    "select run_id, count(*)::bigint as all_upstream from (with recursive r(run_id, a) as (select run_id, upstream_id from ed union select r.run_id, e.upstream_id from r join ed e on e.run_id = r.a) select * from r) group by 1", **RUNS
))
def lineage_upstream(t: Tables) -> DataFrame:
    return lineage.all_upstream(lineage.edges(runs(t))).groupBy("run_id").agg(F.count(F.lit(1)).alias("all_upstream"))


@query("lineage_nodes", sql("select run_id, state, false as missing, state <> 'succeeded' as provisional from runs union all select distinct upstream_id, 'missing', true, true from ed where upstream_id not in (select run_id from runs)", **RUNS))
def lineage_nodes(t: Tables) -> DataFrame:
    return lineage.nodes(runs(t))


@query("lineage_component", sql("""select run_id, run_id // 1000 * 1000 as component, root from runs join (
  select run_id // 1000 as c, first(run_id order by created_at, run_id) as root from runs where up is null group by 1) on c = run_id // 1000""", **RUNS))  # fmt: skip
def lineage_component(t: Tables) -> DataFrame:
    r = runs(t)
    e = lineage.edges(r)
    c = lineage.components(e, r)
    return c.join(r.select("run_id"), "run_id").join(lineage.component_roots(c, r, e), "component").select("run_id", "component", "root")


@query("lineage_downstream", sql("select upstream_id as run_id, count(distinct run_id)::bigint as n from ed group by 1", **RUNS))
def lineage_downstream(t: Tables) -> DataFrame:
    return lineage.direct_downstream(lineage.edges(runs(t))).select("run_id", F.size("downstream").cast("long").alias("n"))


@query("lineage_relations", sql(
    """select r.run_id, (r.up is not null)::bigint as direct_upstream, (r.run_id % 1000)::bigint as all_upstream, 0::bigint as missing_upstream,
    (select count(*) from runs x where x.run_id // 1000 = r.run_id // 1000 and x.run_id < r.run_id and x.state <> 'succeeded')::bigint as provisional_upstream, (select count(*) from ed e where e.upstream_id = r.run_id)::bigint as downstream from runs r""", **RUNS
))
def lineage_relations(t: Tables) -> DataFrame:
    return lineage.relations(runs(t))


@query("run_groups", sql("select task_type, count(*)::bigint as total, count(*) filter (state = 'running')::bigint as running, count(*) filter (state = 'succeeded')::bigint as succeeded, count(*) filter (state = 'failed')::bigint as failed, max(created_at) as newest, count(*) filter (state = 'running') > 0 as active from runs group by 1", **RUNS))
def run_groups(t: Tables) -> DataFrame:
    return lineage.group_counts(runs(t))


@query("run_search", sql("select run_id, state from runs where state = 'succeeded' and task_type = 'assistant' and contains(run_id::varchar, '1')", **RUNS))
def run_search(t: Tables) -> DataFrame:
    return lineage.filter_runs(runs(t), "assistant", "succeeded", "1").select("run_id", "state")


# Flagship


def flagship(spark: SparkSession, sf_dir: str, min_samples: int = 5) -> DataFrame:
    """Daily information coefficients of the five-day return on daily bars."""
    t = Tables(spark, sf_dir, False)
    p = features.rolling(t.panel, ("price",), (5,)).where("_has_market_data and roc5 is not null")
    s = p.select("trade_date", "ts_code", F.col("roc5"), F.col("close").alias("signal_price"), F.col("adj_factor").alias("signal_adjustment_factor"))
    m = t.panel.select("trade_date", "ts_code", F.col("close").alias("price"), F.col("adj_factor").alias("adjustment_factor"), F.when(F.col("_has_market_data"), "quoted").otherwise("missing_data").alias("market_status"))
    rows = s.join(labels.next_day_labels(s, m, t.days).where("label_valid"), ["trade_date", "ts_code"])
    return rounded(analysis.daily_ic(analysis.factor_pairs(rows, ["roc5"], "label_return"), min_samples))


QUERIES["daily_rank_ic"] = flagship
SQL["daily_rank_ic"] = sql(
    f"select 'roc5' as factor, trade_date, count(*)::bigint as samples, {fin(_SAFE.format('roc5', 'y'), 'ic')}, {fin(_SAFE.format('xr', 'yr'), 'rank_ic')} from f2 group by 2 having count(*) >= 5",
    False,
    f0=f"select *, lag(_close, 5) {W} / nullif(_close, 0) as roc5 from panel",
    f1="select a.trade_date, a.ts_code, a.roc5, b.close * b.adj_factor / (a.close * a.adj_factor) - 1 as y from f0 a join days d using (trade_date) join panel b on b.ts_code = a.ts_code and b._trade_index = d._trade_index + 1 where a._has_market_data and b._has_market_data and a.roc5 is not null",
    f2="select *, rank() over (partition by trade_date order by roc5) + (count(*) over (partition by trade_date, roc5) - 1) / 2.0::double as xr, rank() over (partition by trade_date order by y) + (count(*) over (partition by trade_date, y) - 1) / 2.0::double as yr from f1",
)


@query("ordered_output", sql("select count(*)::bigint as rows, 0::bigint as faults, min(trade_date) as first, max(trade_date) as last from bars"))
def ordered_output(t: Tables) -> DataFrame:
    """The bars written in order and read again: rows, and files that are out of it."""
    path = new_path(t.spark, "ordered")
    files.write_ordered(t.bars, path, "trade_date", "ts_code")
    whole = t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"), F.min("trade_date").alias("first"), F.max("trade_date").alias("last"))
    faults = files.order_faults(t.spark, path, "trade_date", "ts_code").agg(F.count(F.lit(1)).alias("faults"))
    return whole.crossJoin(F.broadcast(faults)).select("rows", "faults", "first", "last")  # one row each


# Streams: the stream is run to its end over a copy of the table; the SQL is of the batch it equals


def _run_events(t: Tables) -> DataFrame:
    e = t.spark.read.parquet(f"{t.sf_dir}/events.parquet")
    state = F.when(F.col("event_id") % 10 == 0, "succeeded").otherwise("running")
    return e.select("event_id", F.col("user_id").alias("run_id"), F.col("event_type").alias("step"), F.col("ts").cast("timestamp").alias("ts"), F.least("value", F.lit(100.0)).alias("percentage"), state.alias("state"))


def _as_stream(t: Tables, df: DataFrame, parts: int = 4, at: str = "ts") -> DataFrame:
    """A stream of df in files that arrive by the time in column at."""
    path, df = new_path(t.spark, "arrivals"), stored(df, "arriving")
    cuts = df.select(F.col(at).cast("double").alias("x")).approxQuantile("x", [k / parts for k in range(1, parts)], 0.01)
    part = sum(((F.col(at).cast("double") > c).cast("int") for c in cuts), F.lit(0))
    for k in range(parts):  # one after the other, for a source takes files by their age
        df.where(part == k).coalesce(1).write.mode("append").parquet(path)
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


_STATE = f"""select user_id as run_id, event_type as step, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last, {fin('last(least(value, 100) order by ts, event_id)', 'percentage')},
  last(case when event_id % 10 = 0 then 'succeeded' else 'running' end order by ts, event_id) as state, count(*)::bigint as events from events group by 1, 2"""  # fmt: skip


@query("latest_state", _STATE, False)
def latest_state(t: Tables) -> DataFrame:
    return runs_stream.latest_state(_run_events(t)).select("run_id", "step", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("last"), "percentage", "state", "events")


@query("stream_latest_state", _STATE, False)
def stream_latest_state(t: Tables) -> DataFrame:
    s = runs_stream.latest_state(_as_stream(t, _run_events(t)))
    return runs_stream.drain(s, "update", ["run_id", "step"]).select("run_id", "step", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("last"), "percentage", "state", "events")


@query("stream_terminal_records", "select user_id as run_id, 'succeeded' as state from events where event_id % 10 = 0 group by 1", False)
def stream_terminal_records(t: Tables) -> DataFrame:
    return runs_stream.drain(runs_stream.terminal_records(_as_stream(t, _run_events(t)), "60 days"), "append").select("run_id", "state")


@query("stream_window_counts", """select date_trunc('day', ts) as start, case when event_id % 10 = 0 then 'succeeded' else 'running' end as state, count(*)::bigint as events from events
  where date_trunc('day', ts) + interval 1 day <= (select max(ts) from events) - interval 2 day group by 1, 2""", False)  # fmt: skip
def stream_window_counts(t: Tables) -> DataFrame:
    return runs_stream.drain(runs_stream.window_counts(_as_stream(t, _run_events(t))), "append")


@query("change_feed", """select user_id as run_id, case when a is null then 'add' when b is null then 'remove' else 'change' end as change
  from (select user_id, max(event_id) filter (event_id % 2 = 0) as a, max(event_id) filter (event_id % 3 = 0) as b from events group by 1) where (a is not null or b is not null) and a is distinct from b""", False)  # fmt: skip
def change_feed(t: Tables) -> DataFrame:
    e = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").select(F.col("user_id").alias("run_id"), "event_id")
    snap = lambda k: e.where(F.col("event_id") % k == 0).groupBy("run_id").agg(F.max("event_id").alias("version"))
    return runs_stream.change_feed(snap(2), snap(3))


@query("unique_commits", "select strftime(ts, '%Y%m%d') as trade_date, strftime(ts, '%H') || '00' as trade_time, first(event_id order by ts, event_id) as commit_id, first(event_type order by ts, event_id) as strategy, case when count(distinct event_type) > 1 then 'several strategies' end as fault from events group by 1, 2", False)
def unique_commits(t: Tables) -> DataFrame:
    e = t.spark.read.parquet(f"{t.sf_dir}/events.parquet")
    return runs_stream.unique_commits(e.select(F.date_format("ts", "yyyyMMdd").alias("trade_date"), F.date_format("ts", "HH00").alias("trade_time"), F.col("event_id").alias("commit_id"), F.col("event_type").alias("strategy"), F.col("ts").alias("committed_at")))


@query("window_outcomes", """with w as (select distinct strftime(ts, '%Y%m%d') as d, date_trunc('day', ts) + interval 9 hour as a, date_trunc('day', ts) + interval 15 hour as z from events),
  x as (select strftime(ts, '%Y%m%d') as d, ts, ts + to_seconds((value * 60)::bigint) as e, case when event_id % 4 = 0 then 'failed' else 'done' end as s from events),
  l as (select w.d, last(x.s order by x.ts, x.s, x.e) as s, last(x.e order by x.ts, x.s, x.e) as e from w join x on x.d = w.d and x.ts between w.a and w.z group by 1)
  select w.d as window_id, case when l.d is null then 'skipped' when l.s = 'failed' then 'failed' when l.e > w.z then 'incomplete' else 'done' end as outcome from w left join l on l.d = w.d""", False)  # fmt: skip
def window_outcomes(t: Tables) -> DataFrame:
    return runs_stream.window_outcomes(*_windows(t))


def _windows(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A window a day, and the events as attempts."""
    e = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("window_id", F.date_format("ts", "yyyyMMdd"))
    day = F.date_trunc("day", "ts")
    w = e.select("window_id", (day + F.expr("interval 9 hours")).alias("start"), (day + F.expr("interval 15 hours")).alias("stop")).distinct()
    a = e.select("window_id", F.col("ts").alias("started_at"), (F.col("ts") + F.make_dt_interval(secs=F.round(F.col("value") * 60).cast("decimal(18,6)"))).alias("ended_at"), F.when(F.col("event_id") % 4 == 0, "failed").otherwise("done").alias("state"))
    return w, a


@query("stream_window_outcomes", SQL["window_outcomes"], False)
def stream_window_outcomes(t: Tables) -> DataFrame:
    """The windows and attempts of window_outcomes as two streams, which a last row of each, far ahead, brings to their end."""
    w, a = _windows(t)
    ahead = F.expr("timestamp '2200-01-01 00:00:00'")
    end = t.spark.range(1).select(F.lit("end").alias("window_id"), ahead.alias("start"), ahead.alias("stop"))
    last = t.spark.range(1).select(F.lit("end").alias("window_id"), ahead.alias("started_at"), F.lit(None).cast("timestamp").alias("ended_at"), F.lit("done").alias("state"), F.lit(None).cast("timestamp").alias("committed_at"))
    a = a.withColumn("committed_at", F.lit(None).cast("timestamp"))
    out = online.stream_outcomes(_as_stream(t, w.unionByName(end), at="start"), _as_stream(t, a.unionByName(last), at="started_at"), "1 day")
    return runs_stream.drain(out, "append").where("window_id <> 'end'").select("window_id", "outcome")


@query("stream_journal", _STATE, False)
def stream_journal(t: Tables) -> DataFrame:
    """The events as a journal of JSON lines, followed by byte offsets."""
    folder = new_path(t.spark, "journal")
    _run_events(t).select(F.to_json(F.struct("*"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("value")).repartition(3).write.text(folder)
    lines = journal.follow(t.spark, folder, "event_id long, run_id long, step string, ts timestamp, percentage double, state string", 1 << 16)
    out = runs_stream.drain(runs_stream.latest_state(lines.where("not malformed").select("event.*")), "update", ["run_id", "step"])
    return out.select("run_id", "step", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("last"), "percentage", "state", "events")


_GO = "e.st <> f.st or e.st = 'succeeded' or epoch_us(e.ts) - epoch_us(f.pub) >= 21600000000"


@query("stream_progress", f"""with recursive e as (select user_id, event_type, ts, least(value, 100) as pct, case when event_id % 10 = 0 then 'succeeded' else 'running' end as st, row_number() over (partition by user_id, event_type order by ts, event_id) as i from events),
  f as (select user_id, event_type, i, ts as pub, st, true as told from e where i = 1 union all
    select e.user_id, e.event_type, e.i, case when {_GO} then e.ts else f.pub end, e.st, {_GO} from f join e on e.user_id = f.user_id and e.event_type = f.event_type and e.i = f.i + 1)
  select user_id as run_id, event_type as step, strftime(ts, '%Y-%m-%d %H:%M:%S') as at, {fin('pct', 'percentage')}, e.st as state from e join f using (user_id, event_type, i) where told""", False)  # fmt: skip
def stream_progress(t: Tables) -> DataFrame:
    """One update of a step in six hours, unless its state changes or it ends."""
    rocks = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(rocks)
    t.spark.conf.set(rocks, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = runs_stream.drain(progress.throttled(_as_stream(t, _run_events(t)), 6 * 3600, "2 days"), "append")
    finally:
        t.spark.conf.set(rocks, before)
    return out.select("run_id", "step", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "percentage", "state")


@query("stream_commits", "select strftime(ts, '%Y%m%d') as trade_date, strftime(ts, '%H') || '00' as trade_time, first(event_id order by ts, event_id) as commit_id from events group by 1, 2", False)
def stream_commits(t: Tables) -> DataFrame:
    """The first commit of each day and hour through the sink, each batch of which is run twice."""
    e = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").select(F.date_format("ts", "yyyyMMdd").alias("trade_date"), F.date_format("ts", "HH00").alias("trade_time"), F.col("event_id").alias("commit_id"), F.lit("s").alias("strategy"), F.col("ts").cast("timestamp").alias("ts"))
    first = e.groupBy("trade_date", "trade_time").agg(F.min_by(F.struct("commit_id", "strategy", "ts"), F.struct("ts", "commit_id")).alias("c")).select("trade_date", "trade_time", "c.*")
    path = new_path(t.spark, "commits")
    sink = online.commit_sink(path)

    def twice(batch: DataFrame, epoch: int) -> None:
        sink(batch, epoch)
        sink(batch, epoch)

    stream = _as_stream(t, first)
    stream.writeStream.option("checkpointLocation", new_path(t.spark, "progress")).trigger(availableNow=True).foreachBatch(twice).start().awaitTermination()
    return t.spark.read.schema(first.schema).parquet(path).select("trade_date", "trade_time", "commit_id")


@query("stream_slices", sql(" union all ".join(f"select 'p{n}' as portfolio_key, trade_date, {fin('net_return')} from daily{n}" for n in (3, 5))))
def stream_slices(t: Tables) -> DataFrame:
    """Daily slices of two portfolios, published day by day from the wide results; each batch is run twice."""
    wide = wide_daily(t).withColumn("ts", F.to_timestamp("trade_date", "yyyyMMdd"))
    path = new_path(t.spark, "slices")
    sink = online.slice_sink(path, {"p3": 3, "p5": 5})

    def twice(batch: DataFrame, epoch: int) -> None:
        sink(batch.drop("ts"), epoch)
        sink(batch.drop("ts"), epoch)

    stream = _as_stream(t, wide, 3)
    stream.writeStream.option("checkpointLocation", new_path(t.spark, "progress")).trigger(availableNow=True).foreachBatch(twice).start().awaitTermination()
    return t.spark.read.schema("net_return double, trade_date string, portfolio_key string").parquet(path).select("portfolio_key", "trade_date", "net_return")


# Models, without SQL


#: Rows from here on are scored by a model of the earlier ones.
SCORED_FROM = "19980101"


def _model_labels(t: Tables) -> DataFrame:
    """Keys of rows with valid labels, what ranks them, and what they are for: late (scored), else label and valid (trained on)."""
    s = features.rolling(t.traded, ("price",), (5,)).where("_has_market_data and roc5 is not null")
    s = s.select("trade_date", "ts_code", F.lit("1500").alias("trade_time"), F.col("buyable").alias("is_buyable_at_signal"), F.col("close").alias("signal_price"), F.col("adj_factor").alias("signal_adjustment_factor"))
    y = stored(labels.next_day_labels(s, t.market, t.days, "trade_time", "is_buyable_at_signal").where("label_valid"), "model_labels")
    keep = ["ts_code", "trade_date", "trade_time", "is_buyable_at_signal"]
    early = ml.samples(y.where(F.col("trade_date") < SCORED_FROM)).select(*keep, "label", "valid", F.lit(False).alias("late"))
    late = labels.label_transforms(y.where(F.col("trade_date") >= SCORED_FROM)).select(*keep, F.col("label_return_rank").alias("label"), F.lit(None).cast("boolean").alias("valid"), F.lit(True).alias("late"))
    return t.dealt(early.unionByName(late), "model_labels")


def _model_rows(t: Tables) -> tuple[DataFrame, list[str]]:
    """Rows of _model_labels with all bar and rolling features, and the names of these. Labels come first, since they are
    narrow and the features of a day's rows are not: these stay where their symbol is."""
    p = t.panel.join(_model_labels(t), ["ts_code", "trade_date"], "left")
    f = features.rolling(features.bar_features(features.lag_inputs(p)))
    names = [c for c in f.columns if not c.startswith("_") and c not in p.columns]
    return f.where("late is not null").select("ts_code", "trade_date", "trade_time", "is_buyable_at_signal", "label", "valid", "late", *names), names


def _trained(t: Tables) -> tuple[DataFrame, ml.Trained, DataFrame]:
    """Later rows, and a model of the earlier ones with its curve: all features, the operator's own rounds and patience."""
    rows, names = _model_rows(t)
    rows.write.partitionBy("late").parquet(path := new_path(t.spark, "training"))  # training and scoring read their own rows
    rows = t.spark.read.schema(rows.schema).parquet(path)
    model, curve = ml.fitted(rows.where("not late"), names)
    return rows.where("late"), model, curve


@query("gbt_scores")
def gbt_scores(t: Tables) -> DataFrame:
    late, model, _ = _trained(t)
    return ml.score(late, model).select("trade_date", "ts_code", "pred", "rank", "buyable_rank")


@query("gbt_validation")
def gbt_validation(t: Tables) -> DataFrame:
    late, model, curve = _trained(t)
    scored = ml.score(late, model)
    told = curve.agg(F.count(F.lit(1)).alias("rounds"), F.min_by("round", "valid_l2").alias("best_round"), F.min("valid_l2").alias("least_valid_l2"), F.min("valid_l1").alias("least_valid_l1"))
    first = ml.importance(t.spark, model).where("place = 1").select(F.col("feature").alias("first_feature"), F.col("splits").alias("first_splits"))
    return ml.validation_metrics(scored, "label").crossJoin(F.broadcast(told)).crossJoin(F.broadcast(first))  # one row each
