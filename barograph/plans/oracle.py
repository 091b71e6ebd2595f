"""DuckDB SQL for the registered queries, written from the definitions and not from the DataFrame code."""

from __future__ import annotations

BARS = """
b0 as (select r.r_name as ticker, cast(l.l_shipdate as date) as session_date, sum(l.l_partkey) as sp, sum(l.l_suppkey * 31 + l.l_orderkey) as sk, cast(sum(l.l_quantity) as bigint) as vol
  from lineitem l join supplier s on l.l_suppkey = s.s_suppkey join nation n on s.s_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey group by all),
b1 as (select *, 20000 + sum((sp % 201) - 100) over (partition by ticker order by session_date) as close_c, (sk % 61) - 30 as gap_c from b0),
b2 as (select *, coalesce(lag(close_c) over (partition by ticker order by session_date), 20000) + gap_c as open_c from b1),
bars as (select ticker, session_date, row_number() over (partition by ticker order by session_date) - 1 as i, open_c / 100.0::double as o, (greatest(open_c, close_c) + sp % 47) / 100.0::double as h,
  (least(open_c, close_c) - sk % 43) / 100.0::double as l, close_c / 100.0::double as c, vol::double as v, timezone('UTC', timezone('America/New_York', session_date::timestamp)) as ts from b2)
"""
W = "w as (partition by ticker order by i)"


def last(k: int, name: str = "w") -> str:
    return f"({name} rows between {k - 1} preceding and current row)"


def prior(k: int, name: str = "w") -> str:
    return f"({name} rows between {k} preceding and 1 preceding)"


def full(f: str, of: str, k: int) -> str:
    """f (an aggregate) over the last k rows, null unless all k are there; needs a window named per use."""
    frame = f"over (partition by ticker order by i rows between {k - 1} preceding and current row)"
    return f"case when count({of}) {frame} = {k} then {f} {frame} end"


def before(f: str, of: str, k: int, least: int) -> str:
    frame = f"over (partition by ticker order by i rows between {k} preceding and 1 preceding)"
    return f"case when count({of}) {frame} >= {least} then {f} {frame} end"


LAG = lambda c, k=1: f"lag({c}, {k}) over (partition by ticker order by i)"
ATR = BARS + f""",
tr as (select *, greatest(abs(h - l), abs(h - {LAG('c')}), abs(l - {LAG('c')})) as tr from bars),
atr as (select *, {full('avg(tr)', 'tr', 14)} as atr, {full('avg(tr)', 'tr', 20)} as atr20 from tr)
"""
RET = BARS + f""",
ret as (select *, ln(c) - ln({LAG('c')}) as r from bars),
ret2 as (select *, {LAG('r')} as r1, {LAG('r', 5)} as r5 from ret)
"""


def autocorr(k: int) -> str:
    f = f"over (partition by ticker order by i rows between {19 - k} preceding and current row)"
    return f"case when count(r) over (partition by ticker order by i rows between 19 preceding and current row) = 20 then covar_pop(r, r{k}) {f} / nullif(stddev_pop(r) {f} * stddev_pop(r{k}) {f}, 0) end"


STD = full("stddev_samp(c)", "c", 20)
MEAN = full("avg(c)", "c", 20)
RV = f"sqrt({full('sum(r * r)', 'r', 20)})"
ACC = ATR + f""",
a1 as (select *, ln(c) - ln({LAG('c', 20)}) as cum from atr),
a2 as (select *, cum / 20 as slope from a1),
a3 as (select *, slope - {LAG('slope', 5)} as sc, c / {MEAN} - 1 as dist, (c - {MEAN}) / nullif({STD}, 0) as z, v / nullif({before('avg(v)', 'v', 20, 20)}, 0) as rv,
  atr / nullif({before('quantile_cont(atr, 0.5)', 'atr', 20, 20)}, 0) as ax, abs({LAG('slope')}) as sb, {before('quantile_cont(abs(cum), 0.5)', 'cum', 20, 20)} as usual from a2),
acc as (select *, case when slope > 0 and sc > 0 then 'accelerating_up' when slope < 0 and sc < 0 then 'accelerating_down' when slope > 0 and sc < 0 then 'decelerating_up' when slope < 0 and sc > 0 then 'decelerating_down' else 'neutral' end as state,
  (coalesce(abs(z) >= 2, false)::int + coalesce(rv >= 1.5, false)::int + coalesce(ax >= 1.25, false)::int + coalesce(abs(slope) < sb, false)::int) >= 3 and coalesce(abs(cum) > usual, false) as exhausted from a3)
"""
PARTS = {"relative_atr": "atr20 / c", "bollinger_bandwidth": f"4 * {STD} / {MEAN}", "compression_volatility": full("stddev_samp(lr)", "lr", 20), "mean_range": full("avg(rg)", "rg", 20)}
_quantiles = ", ".join(f"{before(f'quantile_cont({p}, {q})', p, 60, 30)} as {n}_{p}" for p in PARTS for n, q in (("lo", 0.2), ("hi", 0.8)))
_valid = "(" + " + ".join(f"(lo_{p} is not null)::int" for p in PARTS) + ") >= 3"
_votes = lambda n, op: "(" + " + ".join(f"coalesce({p} {op} {n}_{p}, false)::int" for p in PARTS) + ") >= 3"
COMP = ATR + f""",
c1 as (select *, ln(c) - ln({LAG('c')}) as lr, (h - l) / c as rg from atr),
c2 as (select *, {", ".join(f"{e} as {p}" for p, e in PARTS.items())} from c1),
c3 as (select *, {_quantiles} from c2),
c4 as (select *, {_valid} and {_votes('lo', '<=')} as vc, {_valid} and {_votes('hi', '>=')} as ve from c3),
comp as (select *, case when vc then i - coalesce(max(case when not vc then i end) over (partition by ticker order by i), -1) else 0 end as dur from c4)
"""
SWINGS = BARS + """,
s1 as (select *, lead(ts, 2) over w as conf, count(h) over (partition by ticker order by i rows between 3 preceding and 1 preceding) = 3 and count(h) over (partition by ticker order by i rows between 1 following and 2 following) = 2 as whole,
  max(h) over (partition by ticker order by i rows between 3 preceding and 1 preceding) as hb, max(h) over (partition by ticker order by i rows between 1 following and 2 following) as ha,
  min(l) over (partition by ticker order by i rows between 3 preceding and 1 preceding) as lb, min(l) over (partition by ticker order by i rows between 1 following and 2 following) as la from bars window w as (partition by ticker order by i)),
swings as (select ticker, 'swing_high' as type, i, i + 2 as ci, h as price, ts, conf from s1 where whole and h > hb and h > ha union all select ticker, 'swing_low', i, i + 2, l, ts, conf from s1 where whole and l < lb and l < la),
labels as (select *, lag(price) over t as prev, lag(i) over t as prev_i, case when lag(price) over t is null then null when abs(price - lag(price) over t) / lag(price) over t <= 0.005 then 'EQ'
  when type = 'swing_high' then case when price > lag(price) over t then 'HH' else 'LH' end else case when price > lag(price) over t then 'HL' else 'LL' end end as label from swings window t as (partition by ticker, type order by ci, i))
"""
STATE = "case when {h} is null or {l} is null then 'insufficient_swings' when {h} = 'HH' and {l} = 'HL' then 'uptrend' when {h} = 'LH' and {l} = 'LL' then 'downtrend' when {h} = 'EQ' or {l} = 'EQ' or ({h} = 'LH' and {l} = 'HL') then 'range' else 'transition' end"
_fill = lambda c: f"last_value({c} ignore nulls) over (partition by ticker order by i)"
ASOF = SWINGS + f""",
m as (select b.ticker, b.i, x.price as hp, x.i as hi, x.label as hl, x.prev_i as hpi, y.price as lp, y.i as li, y.label as ll, y.prev_i as lpi from bars b
  left join labels x on x.ticker = b.ticker and x.ci = b.i and x.type = 'swing_high' left join labels y on y.ticker = b.ticker and y.ci = b.i and y.type = 'swing_low'),
m2 as (select ticker, i, hp is not null as nh, lp is not null as nl, {_fill('hp')} as last_high, {_fill('lp')} as last_low, {_fill("case when hp is not null then coalesce(hpi, -1) end")} as ph, {_fill("case when lp is not null then coalesce(lpi, -1) end")} as pl,
  {_fill("case when hp is not null then coalesce(hl, '') end")} as hl, {_fill("case when lp is not null then coalesce(ll, '') end")} as ll from m),
m3 as (select * replace (nullif(ph, -1) as ph, nullif(pl, -1) as pl, nullif(hl, '') as hl, nullif(ll, '') as ll) from m2),
states as (select *, {STATE.format(h='hl', l='ll')} as state from m3)
"""
LEVELS = (
    SWINGS
    + f""",
tr as (select *, greatest(abs(h - l), abs(h - {LAG('c')}), abs(l - {LAG('c')})) as tr from bars),
lt as (select *, {full('avg(tr)', 'tr', 14)} as atr, quantile_cont(v, 0.5) over (partition by ticker order by i rows between unbounded preceding and current row) as base from tr),
known as (select b.ticker, b.i as aidx, s.price, s.type, s.ci, s.ts as st, s.conf, bv.v as pv, greatest(coalesce(b.atr, 0) * 0.5, b.c * 0.005) as tol, row_number() over (partition by b.ticker, b.i order by s.price, s.i, s.type) as n
  from lt b join swings s on s.ticker = b.ticker and s.ci <= b.i join bars bv on bv.ticker = s.ticker and bv.i = s.i {{where}}),
fold as (select ticker, aidx, n, price as total, 1 as cnt, 0 as g from known where n = 1
  union all select k.ticker, k.aidx, k.n, case when k.price - f.total / f.cnt <= k.tol then f.total + k.price else k.price end, case when k.price - f.total / f.cnt <= k.tol then f.cnt + 1 else 1 end,
    case when k.price - f.total / f.cnt <= k.tol then f.g else f.g + 1 end from fold f join known k on k.ticker = f.ticker and k.aidx = f.aidx and k.n = f.n + 1),
lev0 as (select k.ticker, k.aidx, f.g, round(avg(k.price), 9) as price, count(*) as touches, case when count(distinct k.type) > 1 then 'mixed' when max(k.type) = 'swing_high' then 'resistance' else 'support' end as type, max(k.ci) as lc, avg(k.pv) as mv
  from known k join fold f on f.ticker = k.ticker and f.aidx = k.aidx and f.n = k.n group by all having count(*) >= 2),
levels as (select v.*, v.price / b.c - 1 as dist, round(ln(1 + touches) * (1 / (1 + (v.aidx - lc) / 20)) * case when b.base > 0 then least(mv / b.base, 2) else 1 end, 4) as strength, b.c, b.atr from lev0 v join lt b on b.ticker = v.ticker and b.i = v.aidx)
"""
)
ALL_LEVELS = LEVELS.replace("{where}", "")


def scan(levels: str) -> str:
    """Breakout events from a table cand(ticker, i, level, level_type, touches) of candidate levels per bar."""
    return f""",
br as (select *, {LAG('c')} as pc, v / nullif({before('avg(v)', 'v', 20, 5)}, 0) as rv from lt0),
x0 as (select b.ticker, b.i, b.c, b.atr, b.rv, k.level, k.level_type, k.touches, case when b.pc <= k.level and k.level < b.c then 1 when b.pc >= k.level and k.level > b.c then -1 end as d from br b join ({levels}) k on k.ticker = b.ticker and k.i = b.i where b.atr > 0),
x1 as (select *, abs(c - level) / atr as dist, coalesce(rv >= 1, false) as ok from x0 where d is not null and abs(c - level) / atr >= 0.1),
x2 as (select x.ticker, x.i, x.level, x.c, x.dist, x.rv, x.ok, x.d, x.level_type, x.touches, min(case when x.d * (b.c - x.level) <= 0 then b.i - x.i end) as f,
  min(case when (x.d = 1 and b.l <= x.level) or (x.d = -1 and b.h >= x.level) then b.i - x.i end) as t, count(b.i) as n from x1 x left join bars b on b.ticker = x.ticker and b.i between x.i + 1 and x.i + 5 group by all),
events as (
  select ticker, i, i as origin, level, level_type, touches, d, 'breakout_candidate' as state, dist, rv, 1 as outside, false as retest, null::int as fb, round(least(1, 0.25 + 0.25 * least(dist, 1) + 0.25 * ok::int), 3) as conf from x2
  union all select ticker, i + 1, i, level, level_type, touches, d, 'breakout_confirmed', dist, rv, 2, coalesce(t <= 1, false), null, round(least(1, 0.5 + 0.25 * least(dist, 1) + 0.25 * coalesce(t <= 1, false)::int), 3) from x2 where ok and n >= 1 and (f is null or f > 1)
  union all select ticker, i + f, i, level, level_type, touches, d, case when d = 1 then 'fake_breakout_up' else 'fake_breakout_down' end, dist, rv, f, coalesce(t < f, false), f, round(least(1, 0.5 + 0.25 * least(dist, 1) + 0.25 * (f <= 2)::int), 3) from x2 where f <= 5)
"""


FIXED = ATR + ", lt0 as (select * from atr)" + scan("select b.ticker, b.i, f.p::double as level, null::varchar as level_type, null::int as touches from bars b cross join (select unnest(range(5, 501, 5)) as p) f where b.ts > timestamp '1994-01-01'")
EVENT = "ticker, i as bar_index, origin as origin_index, round(level, 9) as level, case when d = 1 then 'up' else 'down' end as direction, state, round(dist, 4) as distance_atr, outside::int as outside_bars, retest, fb::int as failure_bars, round(conf, 4) as confidence"
GAPS = ATR + f""",
g0 as (select *, {LAG('c')} as pc, {LAG('atr')} as pa from atr),
g as (select ticker, i, o - pc as size, pc, abs(o - pc) as size_abs, abs(o - pc) / pc as size_pct, abs(o - pc) / case when pa > 0 then pa end as size_atr, case when o > pc then 'gap_up' else 'gap_down' end as type from g0 where abs(o - pc) / pc >= 0.002),
fill as (select g.ticker, g.i, min(b.i) as fi from g join bars b on b.ticker = g.ticker and b.i >= g.i and ((g.size > 0 and b.l <= g.pc) or (g.size < 0 and b.h >= g.pc)) group by all),
gaps as (select ticker, i as seen, i as gap, type, size_abs, size_pct, size_atr, false as filled, null::int as wait, 'unfilled_gap' as state from g
  union all select g.ticker, f.fi, g.i, type, size_abs, size_pct, size_atr, true, (f.fi - g.i)::int, 'gap_fill' from g join fill f on f.ticker = g.ticker and f.i = g.i)
"""
NY = "timezone('America/New_York', timezone('UTC', {}))"
TO_UTC = "timezone('UTC', timezone('America/New_York', {}))"


def ticks(minutes: int) -> str:
    return f"""
tk as (select event_type as ticker, ts::timestamp as t, value::double as p, time_bucket(interval '{minutes} minutes', ts::timestamp) as s from events),
tb as (select ticker, s as ts, arg_min(p, t) as o, max(p) as h, min(p) as l, arg_max(p, t) as c, count(*)::double as v from tk group by ticker, s),
nb as (select *, {NY.format('ts')} as ny from tb)
"""


def blocks(session: str, hours: int) -> str:
    opening, closing, step = (570, 960, 15) if session == "regular" else (240, 1200, 60)
    return f"""with {ticks(step)},
f as (select *, ny::date as day, hour(ny) * 60 + minute(ny) - {opening} as off, min(ts) over (partition by ticker) as first from nb where hour(ny) * 60 + minute(ny) >= {opening} and hour(ny) * 60 + minute(ny) < {closing}),
f0 as (select * replace (min(ts) over (partition by ticker) as first) from f),
k as (select ticker, day, off // {hours * 60} as slot, arg_min(o, ts) as o, max(h) as h, min(l) as l, arg_max(c, ts) as c, sum(v) as v, min(ts) as first_ts, any_value(first) as first, count(*) as n, bool_and(off % {step} = 0) as grid from f0 group by all),
z as (select *, {TO_UTC.format(f"day::timestamp + to_minutes(({opening} + slot * {hours * 60})::int)")} as lft from k)
select ticker, strftime(case when lft < first then first_ts else lft end, '%Y-%m-%d %H:%M') as at, round(o, 4) as open, round(h, 4) as high, round(l, 4) as low, round(c, 4) as close, round(v, 4) as volume,
  (slot + 1) * {hours * 60} <= {closing - opening} and n = {hours * 60 // step} and grid as is_complete from z"""


WEEKLY = BARS + f""",
req as (select {TO_UTC.format("min(session_date)::timestamp")} as q0, {TO_UTC.format("max(session_date)::timestamp + interval 16 hours")} as q1 from bars),
wk0 as (select *, date_trunc('week', session_date)::date as week from bars, req where {TO_UTC.format("session_date::timestamp + interval 16 hours")} <= q1),
wk as (select ticker, week, min(ts) as ts, arg_min(o, i) as o, max(h) as h, min(l) as l, arg_max(c, i) as c, sum(v) as v, {TO_UTC.format("max(session_date)::timestamp + interval 16 hours")} as closed,
  any_value(q0) <= {TO_UTC.format("week::timestamp")} and any_value(q1) >= {TO_UTC.format("week::timestamp + interval 4 days + interval 16 hours")} as complete from wk0 group by ticker, week)
"""
CLOSE = f"cl as (select *, {TO_UTC.format('session_date::timestamp + interval 16 hours')} as ct from bars)"
VIX = f"""
v0 as (select o_orderdate::date as d, (10 + (sum(o_custkey) % 1000) / 50.0)::double as vix from orders group by 1),
vx as (select d, vix, vix - lag(vix) over (order by d) as c1, vix - lag(vix, 5) over (order by d) as c5,
  (vix - case when count(*) over y >= 126 then avg(vix) over y end) / nullif(case when count(*) over y >= 126 then stddev_samp(vix) over y end, 0) as z, {TO_UTC.format("d::timestamp + interval 20 hours")} as av from v0 window y as (order by d rows between 251 preceding and current row))
"""
MACRO = """
d0 as (select o_orderdate::date as d, count(*) as n, sum(o_custkey) as k, count(*) filter (o_orderpriority = '1-URGENT') as u from orders group by 1),
s0 as (select 'fed_assets' as series, d, (n * 100 + k % 97)::double as value from d0 where dayofweek(d) = 3 union all select 'tga', d, (u * 10)::double from d0 union all select 'rrp', d, ((k % 50) / 100.0)::double from d0),
mac as (select series, d, d::timestamp + interval 2 days as av, value from s0 union all select series, d, d::timestamp + interval 9 days, value + 1 from s0)
"""
NET = """
mv as (select series, d, arg_max(value, av) * case series when 'rrp' then 1000 else 1 end as m from {src} group by series, d),
mw as (select d, max(m) filter (series = 'fed_assets') as f, max(m) filter (series = 'tga') as t, max(m) filter (series = 'rrp') as q from mv group by d),
mn as (select d, f - t - q as net from mw where f is not null),
mh as (select d, net, net - lag(net) over (order by d) as c1, net - lag(net, 4) over (order by d) as c4, (net - case when count(net) over y >= 26 then avg(net) over y end) / nullif(case when count(net) over y >= 26 then stddev_samp(net) over y end, 0) as z from mn window y as (order by d rows between 51 preceding and current row))
"""
LIQ = "case when c4 > 0 then 'expanding' when c4 < 0 then 'contracting' when c4 = 0 then 'neutral' else 'unknown' end"
POS = "'beats','beat','growth','surge','surges','upgrade','upgrades','raises','raised','record','profit','profits','strong','gain','gains'"
NEG = "'misses','miss','decline','declines','downgrade','downgrades','cuts','cut','loss','losses','weak','lawsuit','falls','fall'"
NEWS = f"""
n0 as (select doc_id, (['AFRICA','AMERICA','ASIA','EUROPE','MIDDLE EAST'])[doc_id % 5 + 1] as ticker, timestamp '1995-01-01' + to_days((doc_id * 7 % 700)::int) + to_hours((doc_id % 24)::int) as pub,
  list_distinct(regexp_extract_all(lower(coalesce(text, '') || ([' beats record', ' falls', ' growth cuts', ''])[doc_id % 4 + 1]), '[a-z]+')) as w from documents),
n1 as (select *, len(list_intersect(w, [{POS}])) as p, len(list_intersect(w, [{NEG}])) as q from n0),
news as (select doc_id, ticker, pub, pub + interval 2 hours as av, case when p + q > 0 then (p - q) / (p + q)::double end as score from n1)
"""
BREADTH = f"""dense as (select d.session_date, t.ticker, b.c, b.h, b.l from (select distinct session_date from bars) d cross join (select distinct ticker from bars) t left join bars b using (session_date, ticker)),
bx as (select *, {', '.join(f"case when count(c) over (partition by ticker order by session_date rows between {k - 1} preceding and current row) = {k} then avg(c) over (partition by ticker order by session_date rows between {k - 1} preceding and current row) end as s{k}" for k in (20, 50, 200))}, lag(c) over (partition by ticker order by session_date) as pc,
 case when count(h) over y = 252 then max(h) over y end as top, case when count(l) over y = 252 then min(l) over y end as bot from dense window y as (partition by ticker order by session_date rows between 252 preceding and 1 preceding)),
bg0 as (select session_date, count(c) as n, {', '.join(f'count(*) filter (s{k} is not null and c is not null) as n{k}, count(*) filter (c > s{k}) as a{k}' for k in (20, 50, 200))}, count(*) filter (c > pc) as adv, count(*) filter (c < pc) as dec, count(top) as nt, count(bot) as nb, count(*) filter (c > top) as hi, count(*) filter (c < bot) as lo from bx group by session_date),
bg as (select *, {', '.join(f'case when n{k} >= 3 then a{k} / n{k} end as b{k}' for k in (20, 50, 200))}, {TO_UTC.format("session_date::timestamp + interval 16 hours + interval 30 minutes")} as av from bg0)
"""
#: Net liquidity as known at each close.
MACRO_BARS = """
cts as (select distinct ct from cl),
mk as (select ct, series, d, arg_max(value, av) * case series when 'rrp' then 1000 else 1 end as m from cts join mac on av <= ct group by ct, series, d),
mkw as (select ct, d, max(m) filter (series = 'fed_assets') - max(m) filter (series = 'tga') - max(m) filter (series = 'rrp') as net from mk group by ct, d having max(m) filter (series = 'fed_assets') is not null),
mkr as (select *, row_number() over (partition by ct order by d desc) as n from mkw),
mks as (select ct, max(net) filter (n = 1) - max(net) filter (n = 5) as c4 from mkr group by ct),
mb as (select cl.*, mks.ct is not null as has, mks.c4, case when mks.ct is null then null when c4 > 0 then 'expanding' when c4 < 0 then 'contracting' when c4 = 0 then 'neutral' else 'unknown' end as liq from cl left join mks using (ct))
"""
NEWS_BARS = """
nj as (select cl.ticker, cl.i, count(n.doc_id) as n7, count(n.score) as ns, avg(n.score) as s7 from cl left join news n on n.ticker = cl.ticker and n.pub <= cl.ct and n.av <= cl.ct and n.pub > cl.ct - interval 7 days group by all)
"""
#: One row per bar with all that is known outside of it.
OUTSIDE = f"""{BARS}, {CLOSE}, {VIX}, {BREADTH}, {MACRO}, {MACRO_BARS}, {NEWS}, {NEWS_BARS},
bc as (select *, b50 - lag(b50, 5) over (order by session_date) as b50c from bg),
o1 as (select mb.*, vx.vix, vx.z as vix_zscore, vx.c5 as vix_change_5d from mb asof left join vx on mb.ct >= vx.av),
o2 as (select o1.*, bc.b50, bc.b50c from o1 asof left join bc on o1.ct >= bc.av),
outside as (select o2.ticker, o2.i, o2.ct, vix, vix_zscore, vix_change_5d, b50, b50c, liq, c4, has, n7, ns, case when ns >= 3 then s7 end as s7, case when ns >= 3 then 'ok' else 'insufficient_coverage' end as nq from o2 join nj using (ticker, i))
"""
FORECASTS = RET + """,
fr as (select ticker, session_date, i, r, lag(r) over (partition by ticker order by i) as f1, lag(r, 2) over (partition by ticker order by i) as f2 from ret),
fc as (select ticker as asset, session_date as d, m.model, case m.model when 'zero' then 0.0::double when 'last' then f1 else 0.1 * f1 - 0.05 * f2 end as f, r as a, case when m.model = 'AutoReg' then i % 3 + 1 end as par
  from fr cross join (select unnest(['zero', 'last', 'AutoReg']) as model) m where f2 is not null and i >= 60)
"""
HAR = RET + f", rv as (select *, {RV} as rv from ret), har as (select *, {full('avg(rv)', 'rv', 5)} as w5, {full('avg(rv)', 'rv', 22)} as m22 from rv)"
VFC = HAR + f""",
vf0 as (select ticker, rv as a, {LAG('rv')} as d, {LAG('w5')} as k, {LAG('m22')} as m from har),
vf as (select ticker as asset, x.model, case x.model when 'last' then d else (d + k + m) / 3 end as f, a from vf0 cross join (select unnest(['last', 'HAR-RV']) as model) x where m is not null)
"""
SNAP = "timestamp '1996-07-01 21:00:00'"
SCORE = "count(*) as n, avg(abs(f - a)) as mae, sqrt(avg((f - a) * (f - a))) as rmse, stddev_samp(f - a) as sd"
EXTERNAL_ASOF = f"""with {BARS}, {CLOSE}, {VIX}"""


def bars_query(select: str, source: str = "bars", ctes: str = BARS, tail: str = "") -> str:
    return f"with {ctes} select {select} from {source} {tail}"


SQL = {
    "flagship": f"with {SWINGS}, p as (select ticker, arg_max(label, ci * 100000 + i) filter (type = 'swing_high' and label is not null) as h, arg_max(label, ci * 100000 + i) filter (type = 'swing_low' and label is not null) as l from labels group by ticker) select ticker, h as high_label, l as low_label, {STATE.format(h='h', l='l')} as structural_state from p",
    "walk_bars": bars_query("ticker, session_date::varchar as session_date, i as bar_index, o as open, h as high, l as low, c as close, v as volume"),
    "atr": bars_query("ticker, i as bar_index, round(atr, 6) as atr", "atr", ATR),
    "returns": bars_query(f"ticker, i as bar_index, round(c / {LAG('c')} - 1, 9) as simple_return, round(r, 9) as log_return, round(c / {LAG('c', 5)} - 1, 9) as momentum_5, round(c / {LAG('c', 20)} - 1, 9) as momentum_20, round(c / max(c) over (partition by ticker order by i) - 1, 9) as drawdown", "ret", RET),
    "rolling": bars_query(f"ticker, i as bar_index, round({MEAN}, 6) as rolling_mean_20, round({STD}, 6) as rolling_std_20, round((c - {MEAN}) / nullif({STD}, 0), 6) as zscore_20, round({RV}, 6) as realized_volatility_20, round({full('regr_slope(c, i::double)', 'c', 20)}, 6) as rolling_slope_20", "ret", RET),
    "moments": bars_query(f"ticker, i as bar_index, round({full('skewness(r)', 'r', 20)}, 6) as rolling_skew_20, round({full('kurtosis(r)', 'r', 20)}, 6) as rolling_kurtosis_20, round({autocorr(1)}, 6) as autocorr_lag1, round({autocorr(5)}, 6) as autocorr_lag5", "ret2", RET),
    "max_drawdown": f"with {BARS}, p as (select a.ticker, a.i, b.c, b.i as j, max(b.c) over (partition by a.ticker, a.i order by b.i) as peak from bars a join bars b on b.ticker = a.ticker and b.i between a.i - 59 and a.i), q as (select ticker, i, min(c / peak - 1) as d from p group by all) select ticker, i as bar_index, case when i >= 59 then round(d, 9) end as rolling_max_drawdown_60 from q",
    "diagnostics": f"with {RET}, d as (select ticker, i, r - avg(r) over (partition by ticker) as d from ret where r is not null), l as (select *, {', '.join(f'lag(d, {k}) over (partition by ticker order by i) as l{k}' for k in range(1, 11))} from d), g as (select ticker, count(*) as n, sum(d * d) as v, avg(d * d * d) / pow(avg(d * d), 1.5) as s, avg(d * d * d * d) / pow(avg(d * d), 2) - 3 as k, {', '.join(f'sum(d * l{k}) as c{k}' for k in range(1, 11))} from l group by ticker) select ticker, n as nobs, round(n / 6 * (s * s + k * k / 4), 4) as jarque_bera, round(n * (n + 2) * ({' + '.join(f'(c{k} / v) * (c{k} / v) / (n - {k})' for k in range(1, 11))}), 4) as ljung_box from g",
    "acceleration": bars_query("ticker, i as bar_index, round(slope, 6) as slope, round(sc, 6) as slope_change, round(sc / 5, 6) as acceleration, round(dist, 6) as distance_to_mean, round(z, 6) as price_zscore, round(cum, 6) as cumulative_log_return, round(rv, 6) as relative_volume, round(ax, 6) as atr_expansion", "acc", ACC),
    "acceleration_states": bars_query("ticker, i as bar_index, state as acceleration_state, exhausted as exhaustion_candidate", "acc", ACC),
    "compression": bars_query(f"ticker, i as bar_index, {', '.join(f'round({p}, 6) as {p}' for p in PARTS)}, vc as volatility_compression, ve as volatility_expansion, dur as compression_duration", "comp", COMP),
    "relative_strength": f"with {BARS}, j as (select b.*, a.c as bc, b.c / a.c as q from bars b left join (select session_date, c from bars where ticker = 'AMERICA') a using (session_date)) select ticker, i as bar_index, {', '.join(f'round((c / {LAG("c", k)} - 1) - (bc / {LAG("bc", k)} - 1), 6) as relative_return_{k}' for k in (5, 20, 60))}, round(q, 6) as price_benchmark_ratio, round((ln(q) - ln({LAG('q', 20)})) / 20, 6) as ratio_slope, round((q - {full('avg(q)', 'q', 20)}) / nullif({full('stddev_samp(q)', 'q', 20)}, 0), 6) as ratio_zscore, bc is not null as benchmark_available from j",
    "asset_liquidity": bars_query(f"ticker, i as bar_index, round(c * v, 6) as dollar_volume, round(v / nullif({before('avg(v)', 'v', 20, 20)}, 0), 6) as relative_volume, round(v / 1e6, 6) as turnover, round(abs(r) / nullif(v, 0), 6) as volatility_per_volume, round(o / {LAG('c')} - 1, 6) as overnight_gap", "ret", RET),
    "vix": f"with {VIX} select d::varchar as day, strftime(av, '%Y-%m-%d %H:%M') as available, round(vix, 6) as vix, round(c1, 6) as vix_change_1d, round(c5, 6) as vix_change_5d, round(z, 6) as vix_zscore_252d from vx",
    "breadth": f"""with {BARS}, {BREADTH}
select session_date::varchar as day, n as members_available, {', '.join(f'round(b{k}, 6) as breadth_sma{k}' for k in (20, 50, 200))}, case when n >= 3 then adv end as advances, case when n >= 3 then dec end as declines, case when n >= 3 then round(adv / nullif(dec, 0), 6) end as advance_decline_ratio, case when nt >= 3 then hi end as new_highs_252d, case when nb >= 3 then lo end as new_lows_252d from bg""",
    "rv_percentile": f"with {HAR}, p as (select a.ticker, a.i, a.rv, count(*) filter (b.rv < a.rv and b.i < a.i) as n, count(b.rv) as have from har a left join har b on b.ticker = a.ticker and b.i between a.i - 251 and a.i group by all) select ticker, i as bar_index, case when rv is not null and have >= 60 then round(n / least(i, 251), 6) end as rv20_percentile from p",
    "recent_flags": f"with {COMP}, {'ac1 as (select ticker, i, ln(c) - ln(' + LAG('c', 20) + ') as cum from bars), ac2 as (select *, cum / 20 as slope from ac1), ac3 as (select *, slope - ' + LAG('slope', 5) + ' as sc from ac2)'}, j as (select c.ticker, c.i, c.vc, slope > 0 and sc > 0 as up, slope < 0 and sc < 0 as dn from comp c join ac3 using (ticker, i)), f as (select ticker, i, max(coalesce(up, false)::int) over (partition by ticker order by i rows between 9 preceding and current row) as u, max(coalesce(dn, false)::int) over (partition by ticker order by i rows between 9 preceding and current row) as d, coalesce(max(vc::int) over (partition by ticker order by i rows between 20 preceding and 1 preceding), 0) as k from j) select ticker, i as bar_index, u = 1 as accel_up_recent, d = 1 as accel_down_recent, k = 1 as compression_recent from f",
    "har": bars_query("ticker, i as bar_index, round(rv, 9) as har_daily, round(w5, 9) as har_weekly, round(m22, 9) as har_monthly", "har", HAR),
    "swings": bars_query("ticker, type, i as bar_index, ci as confirmation_index, price as price_level", "swings", SWINGS),
    "swing_labels": bars_query("ticker, type, i as bar_index, label as structure_label", "labels", SWINGS),
    "structure_asof": bars_query(f"ticker, i as bar_index, state as structural_state, last_high, last_low, ph as prev_high_index, pl as prev_low_index, hl as last_high_label, ll as last_low_label, nh as new_swing_high, nl as new_swing_low, state <> {LAG('state', 10)} as structure_changed_recent", "states", ASOF),
    "levels_history": f"with recursive {ALL_LEVELS} select ticker, aidx as asof_index, price as price_level, type, touches as touch_count, round(dist, 4) as distance_from_current_price, strength as strength_score from levels",
    "levels_asof": f"with recursive {LEVELS.replace('{where}', 'where b.i = (select max(q.i) from bars q where q.ticker = b.ticker and q.ts <= ' + chr(39) + '1996-06-28 12:00:00' + chr(39) + '::timestamp)')} select ticker, aidx as asof_index, price as price_level, type, touches as touch_count from levels",
    "nearest_levels": f"""with recursive {ALL_LEVELS}, n as (select ticker, aidx, max(price) filter (type in ('support', 'mixed') and price < c) as s, arg_max(touches, price) filter (type in ('support', 'mixed') and price < c) as sn, min(price) filter (type in ('resistance', 'mixed') and price > c) as r, arg_min(touches, price) filter (type in ('resistance', 'mixed') and price > c) as rn from levels group by all)
select b.ticker, b.i as bar_index, round(s, 9) as nearest_support, round(r, 9) as nearest_resistance, sn as support_touches, rn as resistance_touches, round((b.c - s) / case when b.atr > 0 then b.atr end, 4) as support_dist_atr, round((r - b.c) / case when b.atr > 0 then b.atr end, 4) as resistance_dist_atr from lt b left join n on n.ticker = b.ticker and n.aidx = b.i""",
    "breakouts": f"with recursive {ALL_LEVELS}, lt0 as (select * from lt) {scan('select ticker, aidx + 1 as i, price as level, type as level_type, touches from levels')} select {EVENT}, level_type, touches as level_touch_count, round(rv, 4) as relative_volume from events",
    "breakouts_fixed": f"with {FIXED} select {EVENT} from events",
    "breakout_recency": f"""with {FIXED}, e as (select ticker, i, arg_max({{'s': state, 'd': d, 'i': i}}, (origin, level)) filter (state not like 'fake%') as b, arg_max({{'s': state, 'd': d, 'i': i}}, (origin, level)) filter (state like 'fake%') as f from events group by all),
j as (select b.ticker, b.i, last_value(e.b ignore nulls) over r as eb, last_value(e.f ignore nulls) over r as ef from bars b left join e using (ticker, i) window r as (partition by b.ticker order by b.i rows between 5 preceding and current row))
select ticker, i as bar_index, coalesce(eb.s, 'inactive') as breakout_state, case when eb.d = 1 then 'up' when eb.d = -1 then 'down' end as breakout_direction, i - eb.i as breakout_age, coalesce(ef.s, 'inactive') as fake_breakout_state, i - ef.i as fake_breakout_age from j""",
    "gaps": bars_query("ticker, seen as bar_index, gap as gap_index, type, round(size_abs, 6) as size_abs, round(size_pct, 6) as size_pct, round(size_atr, 6) as size_atr, filled, wait as time_to_fill_bars, state", "gaps", GAPS),
    "gap_filter": f"with {GAPS}, k as (select ticker, gap, type from gaps where state = 'unfilled_gap' and size_pct >= 0.005 and size_atr >= 0.5) select b.ticker, b.i as bar_index, exists (select 1 from k where k.ticker = b.ticker and type = 'gap_up' and gap between b.i - 2 and b.i) as gap_up_recent, exists (select 1 from k where k.ticker = b.ticker and type = 'gap_down' and gap between b.i - 2 and b.i) as gap_down_recent from bars b",
    "gap_counts": bars_query("ticker, count(*) as gaps_detected, count(*) filter (size_pct >= 0.005 and size_atr >= 0.5) as gaps_kept, count(*) - count(*) filter (size_pct >= 0.005 and size_atr >= 0.5) as gaps_discarded", "gaps", GAPS, "where state = 'unfilled_gap' group by ticker"),
    "check_bars": f"""with {BARS}, t as (select *, case when i % 83 = 5 then {LAG('ts')} when i % 79 = 9 then {LAG('ts')} - interval 2 days else ts end as t from bars),
x as (select *, {LAG('t')} as before, case when i % 97 = 13 then null when i % 101 = 7 then l - 1 else h end as hh from t), y as (select *, case when i % 103 = 11 then h + 1 else l end as ll, case when i % 89 = 3 then -1 else v end as vv from x)
select ticker, count(*) as bars, count(*) filter (o is null or hh is null or ll is null or c is null or vv is null or t is null) as null_rows, count(*) filter (t = before) as duplicate_timestamps, count(*) filter (t < before) as out_of_order, count(*) filter (hh < greatest(o, c, ll)) as high_too_low,
  count(*) filter (ll > least(o, c, hh)) as low_too_high, count(*) filter (vv < 0) as negative_volume from y group by ticker""",
    "check_feature_input": bars_query("ticker, count(*) filter (c is null or c <= 0) as bad_close, 0 as bad_timestamp", tail="group by ticker"),
    "range_filter": bars_query("ticker, i as bar_index, o as open, h as high, l as low, c as close, v as volume", tail="where ts >= timestamp '1995-01-01' and ts < timestamp '1996-01-01'"),
    "session_bars": f"with {ticks(15)} select ticker, strftime(ts, '%Y-%m-%d %H:%M') as at, round(o, 4) as open, round(h, 4) as high, round(l, 4) as low, round(c, 4) as close, round(v, 4) as volume from nb where hour(ny) * 60 + minute(ny) between 570 and 959",
    "tick_bars": f"with {ticks(60)} select ticker, strftime(ts, '%Y-%m-%d %H:%M') as at, round(o, 4) as open, round(h, 4) as high, round(l, 4) as low, round(c, 4) as close, round(v, 4) as volume from nb",
    "intraday_4h": blocks("regular", 4),
    "intraday_1h": blocks("regular", 1),
    "intraday_extended_4h": blocks("extended", 4),
    "weekly": bars_query("ticker, strftime(ts, '%Y-%m-%d %H:%M') as at, strftime(closed, '%Y-%m-%d %H:%M') as closed, round(o, 4) as open, round(h, 4) as high, round(l, 4) as low, round(c, 4) as close, round(v, 4) as volume, complete as is_complete", "wk", WEEKLY),
    "complete_weeks": bars_query("ticker, strftime(ts, '%Y-%m-%d %H:%M') as at, round(c, 4) as close", "wk", WEEKLY, "where complete"),
    "check_normalized": bars_query("ticker, count(*) filter (ts < timestamp '1992-01-01' or ts >= timestamp '1998-01-01') as outside_window, 0 as outside_session, 0 as bad_provenance, count(*) filter (closed > timestamp '1998-01-01') as unclosed_source, 0 as missing_flag", "wk", WEEKLY, "group by ticker"),
    "check_aggregates": f"with {WEEKLY}, a as (select distinct ticker, date_trunc('week', session_date)::date as week from bars), f as (select ticker, date_trunc('week', session_date)::date as week, arg_min(o, i) as o, max(h) as h, min(l) as l, arg_max(c, i) as c, sum(v) as v from bars group by all) select count(*) filter (f.ticker is null) as only_coarse, count(*) filter (wk.ticker is null) as only_fine, count(*) filter (abs(wk.o - f.o) > 1e-8 or abs(wk.h - f.h) > 1e-8 or abs(wk.l - f.l) > 1e-8 or abs(wk.c - f.c) > 1e-8 or abs(wk.v - f.v) > 1e-8) as different, count(*) filter (wk.ticker is not null and f.ticker is not null) as matched from wk full join f on wk.ticker = f.ticker and wk.week = f.week",
    "close_times": f"with {BARS}, {ticks(60).strip()} select ticker, '1Day' as kind, strftime(ts, '%Y-%m-%d %H:%M') as at, strftime({TO_UTC.format('session_date::timestamp + interval 16 hours')}, '%Y-%m-%d %H:%M') as closes from bars union all select ticker, '1Hour', strftime(ts, '%Y-%m-%d %H:%M'), strftime(least(ts + interval 1 hour, {TO_UTC.format('ny::date::timestamp + interval 16 hours')}), '%Y-%m-%d %H:%M') from nb",
    "truncate": f"with {BARS}, {CLOSE} select ticker, i as bar_index, c as close from cl where ct <= timestamp '1996-03-15 21:00:00'",
    "asof_timeframe": f"with {WEEKLY}, {CLOSE} select cl.ticker, cl.i as bar_index, wk.c as week_close from cl asof left join wk on cl.ticker = wk.ticker and cl.ct >= wk.closed",
    "asof_vix": f"with {BARS}, {CLOSE}, {VIX} select cl.ticker, cl.i as bar_index, round(vx.vix, 6) as vix, round(vx.c5, 6) as vix_change_5d from cl asof left join vx on cl.ct >= vx.av",
    "news": f"with {BARS}, {CLOSE}, {NEWS}, j as (select cl.ticker, cl.i, count(n.doc_id) filter (n.pub > cl.ct - interval 1 day) as n1, count(n.doc_id) as n7, count(n.score) as ns, avg(n.score) filter (n.pub > cl.ct - interval 1 day) as s1, avg(n.score) as s7 from cl left join news n on n.ticker = cl.ticker and n.pub <= cl.ct and n.av <= cl.ct and n.pub > cl.ct - interval 7 days group by all) select ticker, i as bar_index, n1 as news_count_1d, n7 as news_count_7d, ns as news_scored_7d, round(s1, 6) as news_sentiment_1d, round(s7, 6) as news_sentiment_7d, case when ns >= 3 then 'ok' else 'insufficient_coverage' end as news_quality from j",
    "macro_asof": f"with {MACRO}, k as (select series, d, arg_max(value, av) as v from mac where av <= timestamp '1996-07-01 12:00:00' group by all) select series, max(d)::varchar as day, arg_max(v, d) as value from k group by series",
    "macro_history": f"with {MACRO}, msrc as (select * from mac where av <= timestamp '1996-07-01 12:00:00'), {NET.format(src='msrc')} select d::varchar as day, round(net, 6) as net_liquidity, round(c1, 6) as net_liquidity_1w_change, round(c4, 6) as net_liquidity_4w_change, round(z, 6) as net_liquidity_zscore_52w, round(c4 / 4, 6) as net_liquidity_slope_4w, {LIQ} as liquidity_state from mh",
    "macro_by_bar": f"with {BARS}, {CLOSE}, {MACRO}, {MACRO_BARS} select ticker, i as bar_index, liq as macro_liquidity_state, round(c4, 6) as macro_net_liquidity_4w_change, case when has then 'asof_safe' else 'not_yet_available' end as macro_status from mb",
    "external_context": f"with {OUTSIDE} select ticker, i as bar_index, round(vix, 6) as vix, round(vix_zscore, 6) as vix_zscore, round(vix_change_5d, 6) as vix_change_5d, round(b50, 6) as breadth_sma50, round(b50c, 6) as breadth_sma50_change5, liq as macro_liquidity_state, round(c4, 6) as macro_net_liquidity_4w_change, case when has then 'asof_safe' else 'not_yet_available' end as macro_status, n7 as news_count_7d, ns as news_scored_7d, round(s7, 6) as news_sentiment_7d, nq as news_quality from outside",
    "context_snapshot": f"""with {BARS}, {VIX}, {BREADTH}, {MACRO}, msrc as (select * from mac where av <= {SNAP}), {NET.format(src='msrc')}, {NEWS},
v as (select * from vx where av <= {SNAP} order by av desc limit 1), g as (select * from bg where av <= {SNAP} order by av desc limit 1), k as (select series, arg_max(value, (d, av)) as value from msrc group by series),
a as (select i, c * v as dv from bars where ticker = 'ASIA' and {TO_UTC.format("session_date::timestamp + interval 16 hours + interval 30 minutes")} <= {SNAP} order by i desc limit 1), n as (select * from mh order by d desc limit 1),
w as (select * from news where ticker = 'ASIA' and pub <= {SNAP} and av <= {SNAP} and pub > {SNAP} - interval 7 days)
select v.d::varchar as vix_day, round(v.vix, 6) as vix, round(v.c1, 6) as vix_change_1d, round(v.c5, 6) as vix_change_5d, round(v.z, 6) as vix_zscore, g.session_date::varchar as breadth_day, g.n as members, round(g.b20, 6) as breadth_sma20, round(g.b50, 6) as breadth_sma50, round(g.b200, 6) as breadth_sma200, case when g.n >= 3 then g.adv end as advances, case when g.n >= 3 then g.dec end as declines,
  a.i as asset_bar, round(a.dv, 6) as dollar_volume, (select value from k where series = 'fed_assets') as fed_assets, (select value from k where series = 'tga') as tga, (select value from k where series = 'rrp') as rrp, null::double as treasury_2s10s,
  n.d::varchar as net_day, round(n.net, 6) as net_liquidity, round(n.c4, 6) as net_liquidity_4w_change, {LIQ.replace("c4", "n.c4")} as liquidity_state,
  (select count(*) from w where pub > {SNAP} - interval 1 day) as news_1d, (select count(*) from w) as news_7d, (select count(score) from w) as news_scored_7d, (select round(avg(score), 6) from w) as news_sentiment_7d from v, g, a, n""",
    "stability": f"""with {FORECASTS}, r as (select asset, model, sqrt(avg((f - a) * (f - a))) as rmse from fc group by all), rb as (select r.*, z.rmse as base from r left join (select * from r where model = 'zero') z using (asset)),
ba as (select model, avg((rmse < base)::int::double) as ac, avg(rmse) as m, avg(base) as bm from rb group by model), e as (select count(*) as n from (select distinct asset, d from fc)), cn as (select model, count(*) as n from fc group by model),
fe as (select model, asset, d, avg(f - a) as e from fc group by all), fo as (select x.model, avg((abs(x.e) < abs(z.e))::int::double) as fcons from fe x join fe z on z.model = 'zero' and z.asset = x.asset and z.d = x.d group by x.model),
ps as (select model, 1 / (1 + stddev_samp(par) / greatest(avg(par), 1)) as p from fc where model = 'AutoReg' group by model),
j as (select model, greatest(0, least(1, cn.n / e.n)) as cv, case when model = 'zero' then 1 else coalesce(p, 1) end as ps, case when model = 'zero' then 0.5 else coalesce(fcons, 0) end as fc, ac, case when model = 'zero' then 0.5 else ac end as ac2,
  case when model = 'zero' then 0.5 else greatest(0, least(1, (bm - m) / greatest(bm, 1e-12) * 10)) end as ad from cn cross join e join ba using (model) left join fo using (model) left join ps using (model))
select model as component, round((cv + ps + fc + ac2 + ad) / 5, 3) as stability_score, round(cv, 3) as convergence, round(ps, 3) as parameter_stability, round(fc, 3) as fold_consistency, round(ac2, 3) as asset_consistency, round(ad, 3) as advantage, model <> 'zero' and ac < 0.6 as benchmark_only from j""",
    "atr_reversal": f"""with recursive {ATR}, z as (select ticker, i, 0 as way, h as top, i as ti, l as bot, i as bi, null::double as ph, null::bigint as phi, null::double as pl, null::bigint as pli from atr where i = 0
union all select x.ticker, x.i, x.way3, case when x.lowf then x.h else x.top2 end, case when x.lowf then x.i else x.ti2 end, x.bot3, x.bi3, case when x.highf then x.top2 end, case when x.highf then x.ti2 end, case when x.lowf then x.bot3 end, case when x.lowf then x.bi3 end
  from (select *, way2 <= 0 and i > bi3 and h - bot3 >= coalesce(atr * 1.5, 'infinity'::double) as lowf, case when way2 <= 0 and i > bi3 and h - bot3 >= coalesce(atr * 1.5, 'infinity'::double) then 1 else way2 end as way3
  from (select *, case when way2 <= 0 and l < bot2 then l else bot2 end as bot3, case when way2 <= 0 and l < bot2 then i else bi2 end as bi3
  from (select *, case when highf then l else bot end as bot2, case when highf then i else bi end as bi2, case when highf then -1 else way end as way2
  from (select *, way >= 0 and i > ti2 and top2 - l >= coalesce(atr * 1.5, 'infinity'::double) as highf
  from (select a.ticker, a.i, a.h, a.l, a.atr, z.way, z.bot, z.bi, case when z.way >= 0 and a.h > z.top then a.h else z.top end as top2, case when z.way >= 0 and a.h > z.top then a.i else z.ti end as ti2 from z join atr a on a.ticker = z.ticker and a.i = z.i + 1))))) x)
select ticker, 'swing_high' as type, phi::int as bar_index, i::int as confirmation_index, ph as price_level, (i - phi)::int as confirmation_lag_bars from z where ph is not null
union all select ticker, 'swing_low', pli::int, i::int, pl, (i - pli)::int from z where pl is not null""",
    "latest_available": f"with {BARS}, a as (select *, {TO_UTC.format('session_date::timestamp + interval 16 hours + interval 30 minutes')} as av from bars) select ticker, max(i) as bar_index, round(arg_max(c * v, i), 4) as dollar_volume from a where av <= timestamp '1996-07-01 21:00:00' group by ticker",
    "headline_score": f"with {NEWS} select doc_id, round(score, 9) as score from news",
    "redaction": "select doc_id, regexp_replace(replace('https://x.example/?id=7&API_KEY=k' || doc_id || '&token=abc next hunter2 ' || text, 'hunter2', '[REDACTED]'), '(?i)((?:api_key|apikey|secret_key|token)=)[^&\\s''\"]+', '\\1[REDACTED]', 'g') as redacted from documents",
    "common_dates": f"with {BARS}, k as (select session_date from bars group by 1 having count(distinct ticker) = (select count(distinct ticker) from bars)) select ticker, i as bar_index, session_date::varchar as session_date from bars join k using (session_date)",
    "walk_forward": f"with {BARS}, n as (select ticker, count(*) as n from bars group by ticker), t as (select ticker, unnest(range(256, n, 21)) as p from n) select ticker, row_number() over (partition by ticker order by p) - 1 as fold, greatest(0, p - 4 - 504) as train_start, p - 4 as train_end, p as test_pos from t",
    "registry": "select * from (values ('level', 'validated', 'kalman_local_level'), ('level', 'allowed', 'kalman_local_level'), ('slope_description', 'allowed', 'kalman_local_linear_trend'), ('volatility_forecast', 'validated', 'garch'), ('volatility_forecast', 'validated', 'egarch'), ('volatility_forecast', 'allowed', 'garch'), ('volatility_forecast', 'allowed', 'egarch'), ('regime_description', 'validated', 'hmm2'), ('regime_description', 'validated', 'markov2'), ('regime_description', 'allowed', 'hmm2'), ('regime_description', 'allowed', 'markov2')) t(purpose, kind, name)",
    "score_returns": f"with {FORECASTS}, g as (select asset, model, {SCORE}, avg((sign(f) = sign(a))::int) filter (f <> 0) as da, case when count(distinct f) > 1 then covar_pop(f, a) / nullif(stddev_pop(f) * stddev_pop(a), 0) end as cr from fc group by all) select asset, model, n, round(mae, 9) as mae, round(rmse, 9) as rmse, round(sd, 9) as error_std, round(da, 9) as directional_accuracy, round(cr, 9) as correlation from g",
    "score_volatility": f"with {VFC} select asset, model, count(*) as n, round(avg(abs(f - a)), 7) as mae, round(sqrt(avg((f - a) * (f - a))), 7) as rmse, round(stddev_samp(f - a), 7) as error_std, round(avg(ln(greatest(f, 1e-8) * greatest(f, 1e-8)) + a * a / (greatest(f, 1e-8) * greatest(f, 1e-8))), 7) as qlike from vf group by all",
    "subperiods": f"with {FORECASTS}, k as (select asset, d, case when row_number() over (partition by asset order by d) - 1 < count(*) over (partition by asset) // 2 then 'early' else 'late' end as sp from (select distinct asset, d from fc)) select asset, model, sp as subperiod, count(*) as n, round(sqrt(avg((f - a) * (f - a))), 9) as rmse from fc join k using (asset, d) group by all",
    "metrics": f"with {FORECASTS}, {VFC[len(RET):].lstrip(', ' + chr(10))} select asset, model, count(*) as n, round(avg(abs(f - a)), 7) as mae, round(sqrt(avg((f - a) * (f - a))), 7) as rmse, round(avg((sign(f) = sign(a))::int), 7) as extra from fc group by all union all select asset, model || ' vol', count(*), round(avg(abs(f - a)), 7), round(sqrt(avg((f - a) * (f - a))), 7), round(avg(ln(greatest(f * f, 1e-12)) + a * a / greatest(f * f, 1e-12)), 7) from vf where f > 0 and a >= 0 group by all",
    "cross_asset": f"with {FORECASTS}, g as (select asset, model, sqrt(avg((f - a) * (f - a))) as rmse from fc group by all) select model, round(avg(g.rmse), 9) as mean, round(quantile_cont(g.rmse, 0.5), 9) as median, round(stddev_samp(g.rmse), 9) as std, count(*) filter (g.rmse < z.rmse) as wins, count(*) as assets from g left join (select asset, rmse from g where model = 'zero') z using (asset) group by model",
    "parameter_variation": f"with {BARS}, x as (select ticker, i, {STD} as s, {full('regr_slope(c, i::double)', 'c', 20)} as p from bars), y as (select ticker, i // 250 as fold, avg(s) as std, avg(p) as slope from x where i >= 60 group by all), u as (select ticker, 'std' as parameter, std as value from y union all select ticker, 'slope', slope from y) select ticker, parameter, round(stddev_samp(value) / greatest(abs(avg(value)), 1e-8), 6) as cv from u group by all",
    "garch_filter": f"with recursive {RET}, e as (select ticker, i, r * 100 - 0.01 as e from ret where r is not null), g as (select ticker, i, (0.05 + 0.08 * 1.0 + 0.9 * 1.0)::double as v, e from e where i = 1 union all select e.ticker, e.i, 0.05 + 0.08 * g.e * g.e + 0.9 * g.v, e.e from g join e on e.ticker = g.ticker and e.i = g.i + 1) select ticker, i as bar_index, round(sqrt(v), 6) as garch_vol_pct from g",
    "permutation_entropy": f"with {RET}, p as (select ticker, i, {LAG('r', 2)} as a, {LAG('r')} as b, r as c from ret), o as (select ticker, i, case when a is null then null when a <= b and b <= c then 0 when a <= c and c < b then 1 when b < a and a <= c then 2 when c < a and a <= b then 3 when b <= c and c < a then 4 else 5 end as k from p), n as (select x.ticker, x.i, y.k, count(*) as n from o x join o y on y.ticker = x.ticker and y.i between x.i - 97 and x.i and y.k is not null where x.i >= 100 group by all), e as (select ticker, i, -sum(n / 98 * ln(n / 98)) / ln(6) as pe from n group by all) select b.ticker, b.i as bar_index, round(pe, 6) as permutation_entropy from bars b left join e on e.ticker = b.ticker and e.i = b.i",
    "state_statistics": f"with {HAR}, x as (select ticker, case when rv > 0.02 then 1 else 0 end as state, r, rv, {full('regr_slope(c, i::double)', 'c', 20)} as sl from har), y as (select * from x where rv is not null), g as (select ticker, state, avg(r) as m, avg(rv) as v, avg(sl) as s, count(*) as n from y group by all), t as (select *, greatest(stddev_pop(m) over (partition by ticker) * 0.25, 1e-5) as tol, row_number() over (partition by ticker order by v, state) as rk, count(*) over (partition by ticker) as k from g) select ticker, state, round(m, 6) as mean_return, round(v, 6) as volatility, round(s, 6) as mean_slope, round(1 / (1 - 0.9::double), 6) as avg_duration, n as observations, case when m > tol then 'positive' when m < -tol then 'negative' else 'neutral' end as trend_description, case when rk = 1 then 'low' when rk = k then 'high' else 'middle' end as volatility_description from t",
    "regime_changes": f"with {HAR}, x as (select ticker, i, case when rv > 0.02 then 1 else 0 end as state from har where rv is not null), y as (select *, {LAG('state')} as p from x) select ticker, i as bar_index, state from y where p is not null and p <> state",
    "prefix_check": "select ''::varchar as ticker, 0 as bar_index, ''::varchar as pattern_name, ''::varchar as state, 0 as episode_id, 0.0::double as score, ''::varchar as side, 0 as cut where false",
}
_ohlcv = lambda name: f"""select '{name}' as kind, ticker, "at", open, high, low, close, volume from"""
_NORMALIZE = {
    "15Min regular": SQL["session_bars"], "1Hour regular": SQL["intraday_1h"], "4Hour regular": SQL["intraday_4h"],
    "1Hour extended": f"with {ticks(60)} select ticker, strftime(ts, '%Y-%m-%d %H:%M') as at, round(o, 4) as open, round(h, 4) as high, round(l, 4) as low, round(c, 4) as close, round(v, 4) as volume from nb where hour(ny) * 60 + minute(ny) between 240 and 1199",
    "4Hour extended": SQL["intraday_extended_4h"], "1Day regular": bars_query("ticker, strftime(ts, '%Y-%m-%d %H:%M') as at, o as open, h as high, l as low, c as close, v as volume"), "1Week regular": SQL["weekly"],
}
SQL |= {
    "normalize": " union all ".join(f"{_ohlcv(name)} ({sql})" for name, sql in _NORMALIZE.items()),
    "raw_bars": bars_query("ticker, session_date::varchar as day, o as open, h as high, l as low, c as close, v as volume", tail="where ticker = 'ASIA' and i % 3 = 0 and ts >= timestamp '1995-06-01' and ts < timestamp '1998-03-01 05:00:00'"),
    "macro_files": f"with {MACRO} select series, d::varchar as day, strftime(av, '%Y-%m-%d') as available, round(value, 6) as value, 'WALCL' as source, 'USD millions' as unit, true as asof_safe from mac where series = 'fed_assets' and value % 5 <> 0 union all select 'rrp', d::varchar, '2002-01-01', round(value, 6), 'RRPONTSYD', 'USD billions', false from mac where series = 'fed_assets' and value % 5 <> 0 and day(d) < 9",
    "vix_file": f"with {VIX} select d::varchar as day, round(vix, 6) as vix from vx",
    "news_file": f"with {NEWS} select ticker, strftime(pub, '%Y-%m-%d %H:%M') as published, strftime(case when doc_id % 3 > 0 then av else pub end, '%Y-%m-%d %H:%M') as available, round(score, 9) as score from news",
    "forecast_file": f"with {FORECASTS} select asset, model, count(*) as n, round(avg(abs(f - a)), 9) as mae, round(sqrt(avg((f - a) * (f - a))), 9) as rmse, round(stddev_samp(f - a), 9) as error_std from fc group by all",
}
