"""The same chain as DuckDB common table expressions, for checking."""

from __future__ import annotations

import re

from ..operators import features

FEE = "0.0005::double", "0.0015::double"


def fin(expr: str, name: str | None = None, digits: int = 9) -> str:
    """A double rounded as the queries round it; null where it isn't finite."""
    x = f"({expr})::double"
    return f"case when isfinite({x}) then case when abs({x}) < 1e5::double then round({x}, 6) + 0.0::double else printf('%.{digits - 1}e', {x})::double end end as {name or expr}"


DAILY = """bars as (select user_id::varchar as ts_code, strftime(ts, '%Y%m%d') as trade_date, first(value order by ts, event_id) as open, max(value) as high, min(value) as low,
  last(value order by ts, event_id) as close, count(*)::double as vol, sum(value) as amount from events group by 1, 2)"""
_KEY = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax"
WEEKLY = f"""bars as (select l_suppkey::varchar as ts_code, strftime(date_trunc('week', l_shipdate), '%Y%m%d') as trade_date, first(p order by {_KEY}) as open, max(p) as high, min(p) as low,
  last(p order by {_KEY}) as close, sum(l_quantity) as vol, sum(l_extendedprice) as amount from (select *, l_extendedprice / l_quantity as p from lineitem) group by 1, 2)"""

W = "over (partition by ts_code order by _trade_index)"
PARTS = {
    "days": "select trade_date, row_number() over (order by trade_date) - 1 as _trade_index from (select distinct trade_date from bars)",
    "mst": "select ts_code, 'N' || ts_code as name, min(trade_date) as list_date, null::varchar as delist_date from bars where ts_code::bigint % 7 <> 0 group by ts_code",
    "quotes": "select b.*, (1.0::double + 0.1::double * floor(_trade_index / 100.0))::double as adj_factor from bars b join days using (trade_date)",
    "bounds": """select s.ts_code, coalesce(m.name, s.ts_code) as name, coalesce(m.list_date, s.f) as list_date, case when m.ts_code is null then s.l else m.delist_date end as panel_end
      from (select ts_code, min(trade_date) as f, max(trade_date) as l from quotes group by 1) s left join mst m using (ts_code)""",
    "panel": """select b.ts_code, b.name, d.trade_date, d._trade_index, q.open, q.high, q.low, q.close, q.vol, q.amount, q.adj_factor, q.ts_code is not null as _has_market_data,
      q.open * adj_factor as _open, q.high * adj_factor as _high, q.low * adj_factor as _low, q.close * adj_factor as _close, q.vol / adj_factor as _volume,
      case when q.vol > 0 then q.amount * 10 / q.vol * adj_factor else q.close * adj_factor end as _vwap
      from bounds b join days d on d.trade_date >= b.list_date and (b.panel_end is null or d.trade_date <= b.panel_end) left join quotes q on q.ts_code = b.ts_code and q.trade_date = d.trade_date""",
    "lag1": f"select *, lag(_close) {W} as _pc, lag(_volume) {W} as _pv from panel",
    "lag2": "select *, _close - _pc as _dp, _volume - _pv as _dv, _close / nullif(_pc, 0) as _cr, ln(_volume + 1) as _lv, case when _pv > 0 then ln(_volume / _pv + 1) end as _lvr from lag1",
    "lagged": "select *, abs(_cr - 1) * _volume as _move from lag2",
    "nm0": """select c.ts_code, (case when (c.ts_code::bigint + k) % 5 = 0 then 'ST' else 'N' end) || c.ts_code || 'v' || k::varchar as known_name, trade_date as start_date,
      greatest(_trade_index + case when c.ts_code::bigint % 2 = 0 then 1 else -1 end, 0) as a from (select distinct ts_code from bars) c, (select *, (_trade_index // 60)::bigint as k from days where _trade_index % 60 = 0)""",
    "nm": """select ts_code, known, last(known_name order by start_date, known_name) as known_name from (select n.*, greatest(n.start_date, d.trade_date) as known from nm0 n join days d on d._trade_index = n.a) group by 1, 2""",
    "named": "select p.* exclude (name), coalesce(n.known_name, p.name) as name from panel p asof left join nm n on p.ts_code = n.ts_code and p.trade_date > n.known",
    "lim0": f"select *, coalesce(lag(close) {W}, close) as pre_close, ts_code::bigint + _trade_index as k from named",
    "lim1": """select *, case when k % 11 <> 0 then case when k % 13 = 0 then d else u end end as up_limit, case when k % 11 <> 0 then case when k % 13 = 0 then u else d end end as down_limit
      from (select *, round(round(pre_close * 1.1::double * 100, 4)) / 100 as u, round(round(pre_close * 0.9::double * 100, 4)) / 100 as d from lim0)""",
    "lim2": """select *, coalesce(isfinite(up_limit) and isfinite(down_limit) and up_limit > down_limit, false) as official,
      case when contains(upper(name), 'ST') and trade_date < '20260706' then 0.05::double when ts_code like '300%' or ts_code like '301%' or ts_code like '688%' or ts_code like '689%' then 0.2::double else 0.1::double end as rate from lim1""",
    "limited": """select *, case when official then up_limit else round(round(pre_close * (1 + rate) * 100, 4)) / 100 end as up_limit_, case when official then down_limit else round(round(pre_close * (1 - rate) * 100, 4)) / 100 end as down_limit_, not official as fallback from lim2""",
    "fl0": f"""select *, sum(_has_market_data::int) over (partition by ts_code order by _trade_index rows between 59 preceding and current row) as q60, _trade_index - min(_trade_index) {W} + 1 as span from limited""",
    "fl1": r"""select *, coalesce(regexp_matches(upper(name), '^(S\*?ST|\*ST|ST)'), false) as is_st, coalesce(starts_with(upper(name), '退') or ends_with(upper(name), '退'), false) as is_delisting,
      coalesce(close >= up_limit_ - 1e-6::double, false) as at_up_limit, coalesce(close <= down_limit_ + 1e-6::double, false) as at_down_limit, span < 60 or q60 / 60.0::double < 0.8::double as history_short from fl0""",
    "flagged": """select *, _has_market_data and coalesce(isfinite(up_limit_) and isfinite(down_limit_), false) and not (is_st or is_delisting or at_up_limit or at_down_limit or history_short) as buyable,
      coalesce(not is_st and not is_delisting and close < up_limit_ - 1e-6::double, false) as can_buy, coalesce(close > down_limit_ + 1e-6::double, false) as can_sell, case when _has_market_data then 'quoted' else 'missing_data' end as market_status from fl1""",
    "told": "select trade_date, ts_code, case when (ts_code::bigint + _trade_index) % 17 = 0 then 'suspended' else 'missing_data' end as told from panel where (ts_code::bigint + _trade_index) % 17 = 0 or (ts_code::bigint + _trade_index) % 19 = 0",
    "market": """select f.trade_date, f.ts_code, f.close as price, f.adj_factor as adjustment_factor, f.can_buy and t.told is null as can_buy, f.can_sell and t.told is null as can_sell, coalesce(t.told, f.market_status) as market_status
      from flagged f left join told t using (trade_date, ts_code)""",
    "roc": f"select *, lag(_close, 5) {W} / nullif(_close, 0) as roc5 from flagged",
    "signals": """select r.trade_date, '1500' as trade_time, r.ts_code, -r.roc5 as pred, true as is_model_candidate, r.buyable and coalesce(m.can_buy, false) as is_buyable_at_signal, r.close as signal_price, r.adj_factor as signal_adjustment_factor
      from roc r left join market m using (trade_date, ts_code) where r._has_market_data and r.roc5 is not null""",
    "nxt": "select trade_date, lead(trade_date) over (order by trade_date) as label_target_date from days",
    "lab0": """select s.trade_date, s.ts_code, n.label_target_date, x.price * x.adjustment_factor / (s.signal_price * s.signal_adjustment_factor) - 1 as r, coalesce(e.market_status, 'missing_data') as es, coalesce(x.market_status, 'missing_data') as xs
      from signals s left join nxt n using (trade_date) left join market e on e.trade_date = s.trade_date and e.ts_code = s.ts_code left join market x on x.trade_date = n.label_target_date and x.ts_code = s.ts_code""",
    "lab1": "select *, case when es <> 'quoted' then es when label_target_date is null then 'pending' when xs <> 'quoted' then xs when coalesce(isfinite(r), false) then 'valid' else 'missing_data' end as label_status from lab0",
    "labels": "select trade_date, ts_code, label_target_date, case when label_status = 'valid' then r end as label_return, label_status = 'valid' as label_valid, label_status from lab1",
    "ranked": """select s.*, row_number() over (partition by trade_date order by pred desc, ts_code) as rank, case when is_buyable_at_signal then sum(is_buyable_at_signal::bigint) over (partition by trade_date order by pred desc, ts_code rows unbounded preceding) end::bigint as buyable_rank,
      case when is_buyable_at_signal then row_number() over (partition by trade_date, is_buyable_at_signal order by pred desc, ts_code) end as target_rank from signals s""",
    "train": "select s.trade_date, s.ts_code, s.pred, l.label_target_date, l.label_return from signals s join labels l using (trade_date, ts_code) where l.label_valid",
    "pairs": """select factor, trade_date, value, label, rank() over (partition by factor, trade_date order by value) + (count(*) over (partition by factor, trade_date, value) - 1) / 2.0::double as value_rank,
      rank() over (partition by factor, trade_date order by label) + (count(*) over (partition by factor, trade_date, label) - 1) / 2.0::double as label_rank
      from (select 'pred' as factor, trade_date, pred as value, label_return as label from train union all select 'ma5', t.trade_date, f.ma5, t.label_return from train t join maf f using (trade_date, ts_code)) where isfinite(value) and isfinite(label)""",
    "maf": f"select trade_date, ts_code, avg(_close) over (partition by ts_code order by _trade_index rows between 4 preceding and current row) / nullif(_close, 0) as ma5 from panel",
    "ic": """select factor, trade_date, count(*) as samples, covar_samp(value, label) / nullif(stddev_samp(value) * stddev_samp(label), 0) as ic, covar_samp(value_rank, label_rank) / nullif(stddev_samp(value_rank) * stddev_samp(label_rank), 0) as rank_ic
      from pairs group by 1, 2 having count(*) >= 10""",
    "qb": """select factor, quantile, avg(r) as mean_return, stddev_samp(r) as std_return, sum(k) as samples, count(*) as days from (
      select factor, trade_date, quantile, avg(label) as r, count(*) as k from (select *, least(greatest(floor((value_rank - 1) / n * 5), 0), 4)::bigint + 1 as quantile from (select *, count(*) over (partition by factor, trade_date) as n from pairs) where n >= 10) group by 1, 2, 3) group by 1, 2""",
    "icsum": """select factor, count(*) as days, avg(ic) as ic_mean, coalesce(stddev_samp(ic), 0) as ic_std, avg((ic > 0)::int::double) as ic_positive, avg(rank_ic) as rankic_mean, coalesce(stddev_samp(rank_ic), 0) as rankic_std, avg((rank_ic > 0)::int::double) as rankic_positive,
      quantile_cont(rank_ic, 0.05) as rankic_p05, quantile_cont(rank_ic, 0.5) as rankic_p50, quantile_cont(rank_ic, 0.95) as rankic_p95, count(ic) as n_ic, count(rank_ic) as n_rank from ic group by 1""",
    "rets": "select *, " + ", ".join(f"case when ok and lag(ok, {h}) {W} then _close / nullif(lag(_close, {h}) {W}, 0) - 1 end as r{h}" for h in (1, 3, 5, 10, 20)) + " from (select *, _has_market_data and coalesce(isfinite(_close) and _close > 0, false) as ok from panel)",
    "tails": "select trade_date, " + ", ".join(f"quantile_cont(r{h}, 0.02) as low{h}, quantile_cont(r{h}, 0.98) as high{h}" for h in (1, 3, 5, 10)) + " from rets group by 1",
    "moments": "select trade_date, " + ", ".join(f"count(r{h}) as n{h}, avg(case when r{h} is not null then greatest(least(r{h}, high{h}), low{h}) end) as mean{h}, var_samp(case when r{h} is not null then greatest(least(r{h}, high{h}), low{h}) end) as var{h}" for h in (1, 3, 5, 10)) + " from rets join tails using (trade_date) group by 1",
    "mcum": "select trade_date, mean1, " + ", ".join(f"case when count(mean1) over w{n} = {n} then exp(sum(ln(1 + mean1)) over w{n}) - 1 end as cum{n}" for n in (5, 10, 20)) + " from moments window " + ", ".join(f"w{n} as (order by trade_date rows between {n - 1} preceding and current row)" for n in (5, 10, 20)),
    "cx0": "select r.*, m.mean1 as m, m.cum5, m.cum10, m.cum20, case when r1 is not null and m.mean1 is not null then m.mean1 end as x, case when r1 is not null and m.mean1 is not null then r1 end as y from rets r left join mcum m using (trade_date)",
    "cx1": "select *, count(x) over b as nb, avg(x * x) over b - avg(x) over b * avg(x) over b as vb, avg(x * y) over b - avg(x) over b * avg(y) over b as cb from cx0 window b as (partition by ts_code order by _trade_index rows between 60 preceding and 1 preceding)",
    "cx2": "select *, case when nb >= 30 and vb > 1e-12::double then greatest(least(cb / vb, 3), -3) end as beta_ from cx1",
    "cx": """select trade_date, ts_code, ok, case when ok then beta_ end as beta, case when ok then r5 - beta_ * cum5 end as momentum5, case when ok then r10 - beta_ * cum10 end as momentum10, case when ok then r20 - beta_ * cum20 end as momentum20,
      case when ok and count(res) over w >= 16 then stddev_samp(res) over w end as residual_vol, case when ok and count(r1) over w >= 16 then sqrt(avg(case when r1 is not null then pow(least(r1, 0), 2) end) over w) end as downside
      from (select *, r1 - beta_ * m as res from cx2) window w as (partition by ts_code order by _trade_index rows between 19 preceding and current row)""",
}


def _accounting(n: int, h: int) -> dict[str, str]:
    """Orders, trades, positions and daily results of the n best, held h days."""
    return {
        f"o{n}": f"""select r.trade_date, r.ts_code, r.target_rank, 1.0::double / {n} as weight, m.price * m.adjustment_factor as entry_price,
          case when coalesce(m.market_status, 'missing_data') <> 'quoted' then coalesce(m.market_status, 'missing_data') when not coalesce(m.can_buy, false) then 'not_buyable' end as reason
          from ranked r left join market m using (trade_date, ts_code) where r.target_rank <= {n}""",
        f"x{n}": f"""select o.*, d._trade_index as i, p.trade_date as planned_exit, weight / {h} as principal from o{n} o join days d using (trade_date) left join days p on p._trade_index = d._trade_index + {h} where reason is null""",
        "sales": "select ts_code, trade_date, price * adjustment_factor as p from market where can_sell and market_status = 'quoted'",
        f"t{n}": f"""select x.ts_code, x.trade_date as entry_date, x.i, x.planned_exit, s.trade_date as exit_date, x.entry_price, s.p as exit_price, x.principal, s.p / x.entry_price - 1 as realised_return,
          x.principal * {FEE[0]} + coalesce(x.principal * s.p / x.entry_price * {FEE[1]}, 0) as fee, coalesce(s.trade_date > x.planned_exit, false) as delayed
          from x{n} x asof left join sales s on s.ts_code = x.ts_code and s.trade_date >= x.planned_exit""",
        f"h{n}": f"""select d.trade_date, d._trade_index, t.*, case when d.trade_date = t.entry_date then t.entry_price when d.trade_date = t.exit_date then t.exit_price else m.price * m.adjustment_factor end as m0, m.ts_code is null as mark_carried
          from t{n} t join days d on d._trade_index >= t.i and (t.exit_date is null or d.trade_date <= t.exit_date) left join market m on m.trade_date = d.trade_date and m.ts_code = t.ts_code and m.market_status = 'quoted'""",
        f"m{n}": f"select *, last_value(m0 ignore nulls) over (partition by ts_code, entry_date order by _trade_index rows unbounded preceding) as mark from h{n}",
        f"p{n}": f"select *, lag(mark) over (partition by ts_code, entry_date order by _trade_index) as previous_mark from m{n}",
        f"s{n}": f"""select trade_date, coalesce(sum(principal * (mark - previous_mark) / entry_price), 0) as g, coalesce(sum(case when trade_date = entry_date then principal end), 0) as b, coalesce(sum(case when trade_date = exit_date then principal * mark / entry_price end), 0) as s,
          count(*) filter (not coalesce(trade_date = exit_date, false)) as positions, count(*) filter (delayed and trade_date = exit_date) as delayed from p{n} group by 1""",
        f"e{n}": f"""select d.trade_date, coalesce(b, 0) * {FEE[0]} + coalesce(s, 0) * {FEE[1]} as c, coalesce(b, 0) + coalesce(s, 0) as v, 1 + sum(coalesce(g, 0) - (coalesce(b, 0) * {FEE[0]} + coalesce(s, 0) * {FEE[1]})) over (order by d.trade_date) as equity, coalesce(g, 0) - (coalesce(b, 0) * {FEE[0]} + coalesce(s, 0) * {FEE[1]}) as chg,
          coalesce(positions, 0) as positions, coalesce(delayed, 0) as delayed, coalesce(u, 0) as unfilled
          from days d left join s{n} using (trade_date) left join (select trade_date, count(*) filter (reason is not null) as u from o{n} group by 1) using (trade_date)""",
        f"daily{n}": f"""select trade_date, equity, chg / before as net_return, chg / before + c / before as gross_return, c / before as cost, v / before as turnover, positions, delayed, unfilled
          from (select *, coalesce(lag(equity) over (order by trade_date), 1) as before from e{n})""",
    }


for _n, _h in ((3, 1), (5, 2)):
    PARTS |= _accounting(_n, _h)


def sql(final: str, weekly: bool = True, **more: str) -> str:
    """final with the expressions that it needs, directly or not."""
    parts = {"bars": (WEEKLY if weekly else DAILY).partition(" as (")[2][:-1], **PARTS, **more}
    needed: dict[str, None] = {}
    seen: set[str] = set()

    def need(text: str) -> None:
        for name in parts:
            if name not in seen and re.search(rf"(?:from|join)\s+\(?{name}\b", text):
                seen.add(name)
                need(parts[name])
                needed[name] = None

    need(final)
    return "with " + ",\n".join(f"{n} as ({parts[n]})" for n in needed) + "\n" + final if needed else final


def rolling(family: str, exprs: dict[str, str], source: str = "lagged") -> str:
    """A family's columns at every width; {n} and w{n} stand for the width and its frame."""
    cols = ", ".join(fin(e.replace("{n}", str(n)), f"{c}{n}") for n in features.WIDTHS for c, e in exprs.items())
    frames = ", ".join(f"w{n} as (partition by ts_code order by _trade_index rows between {n - 1} preceding and current row)" for n in features.WIDTHS)
    return sql(f"select ts_code, trade_date, {', '.join(f'{c}{n}' for n in features.WIDTHS for c in exprs)} from (select ts_code, trade_date, _has_market_data, {cols} from {source} window {frames}, o as (partition by ts_code order by _trade_index)) where _has_market_data")
