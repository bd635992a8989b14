"""The queries once more, as SQL for DuckDB."""

from __future__ import annotations

from tessera.constants import DIMS, MCC_RISK, Q, V

CLUSTERS, ROUNDS, BASE, MOST, CAP = 12, 2, 3, 6, 2500
BUDGETS = (1, 4, CLUSTERS)
PROBES = (1, 2, 4, MOST)
#: Levels of splits, budgets of visits, queries with a gold result, visits of a search that is refined, and the knobs of
#: searches that stop early, at values that bind on the smaller tables.
DEPTH, VISITS, GOLD, REFINED = 6, (500, 1000, 2000, 4000, 8000, 16000, 32000), 4000, 400
EARLY, EPSILON, SOFT, SPAN, STOP = 130_000_000, 0.6, 300, 900, 1500
#: The time of an event from which a failure counts as an error of a load test.
SLOW = 150.0

_RISK = " ".join(f"when {i} then {r}e0" for i, r in enumerate(MCC_RISK.values()))


def _clamp(x: str) -> str:
    return f"least(greatest({x}, 0.0e0), 1.0e0)"


TX = """
m as (select l_orderkey ok, min(l_suppkey) mid from lineitem group by l_orderkey),
b as (select o.o_orderkey ok, o.o_custkey ck, m.mid, cast(floor(o.o_totalprice*100+0.5) as bigint) cents,
  cast(epoch(o.o_orderdate) as bigint) + (o.o_orderkey*7919)%86400 ep from orders o join m on o.o_orderkey=m.ok),
c as (select *, sum(cents) over (partition by ck) sc, count(*) over (partition by ck) nc,
  row_number() over (partition by ck,mid order by ep,ok) seen, lag(ep) over (partition by ck order by ep,ok) lep from b),
f as (select ok, cents/4000.0e0 amount, 1+ok%12 inst, ep, sc/(nc*4000.0e0) cavg, ok%25 n24, seen=1 unk, mid, mid%12 mccx, (mid*631)%12000/1.0e0 mavg,
  (ck*37+mid*101)%1200/1.0e0 kmh, ok%3=0 onl, ok%2=0 cp, lep, (ok*53)%1300/1.0e0 kml,
  case when (ok*7919+13)%100<25 then 1 else 0 end fraud from c)"""

_V = [
    _clamp("amount/10000.0e0"),
    _clamp("inst/12.0e0"),
    "case when cavg=0 then case when amount>0 then 1.0e0 else 0.0e0 end else " + _clamp("(amount/cavg)/10.0e0") + " end",
    "cast((ep%86400)//3600 as double)/23.0e0",
    "cast(((ep//86400)+3)%7 as double)/6.0e0",
    "case when lep is null then -1.0e0 else " + _clamp("((ep-lep)//60)/1440.0e0") + " end",
    "case when lep is null then -1.0e0 else " + _clamp("kml/1000.0e0") + " end",
    _clamp("kmh/1000.0e0"),
    _clamp("n24/20.0e0"),
    "case when onl then 1.0e0 else 0.0e0 end",
    "case when cp then 1.0e0 else 0.0e0 end",
    "case when unk then 1.0e0 else 0.0e0 end",
    f"case mccx {_RISK} else 0.5e0 end",
    _clamp("mavg/10000.0e0"),
]


def _quantize(x: str) -> str:
    return f"cast(floor(least(greatest({x},-1.0e0),1.0e0)*10000+0.5) as int)"


VEC = TX + ",\nv as (select ok, fraud, " + ", ".join(f"{e} {n}" for e, n in zip(_V, V, strict=True)) + " from f)"
QUANT = VEC + ",\nq as (select ok, " + ", ".join(f"{_quantize(v)} {q}" for v, q in zip(V, Q, strict=True)) + ", fraud from v)"


def _d2(a: str, b: str, names: list[str]) -> str:
    return "(" + " + ".join(f"cast(({a}.{n}-{b}.{n}) as bigint)*({a}.{n}-{b}.{n})" for n in names) + ")"


def _knn(k: int, names: list[str] = Q, table: str = "q") -> str:
    return f"""nn as (select * from (select a.ok qid, r.ok ref_id, {_d2("a", "r", names)} d2, r.fraud,
  row_number() over (partition by a.ok order by {_d2("a", "r", names)}, r.ok) rank from {table} a join {table} r on a.ok%10=0 and r.ok%10<>0) where rank <= {k})"""


_VOTE = "select qid, cast(sum(fraud) as bigint) frauds, cast(sum(fraud) as double)/5 fraud_score, cast(sum(fraud) as double)/5 < 0.6e0 approved from nn group by qid"
KNN = QUANT + ",\n" + _knn(5)

EMB = "q as (select vec_id ok, " + ", ".join(_quantize(f"cast(embedding[{i + 1}] as double)") + f" e{i}" for i in range(64)) + ", case when label >= 5 then 1 else 0 end fraud from embeddings)"
_E = [f"e{i}" for i in range(64)]


def _ivf() -> str:
    """Seeds, rounds of means, and the assignment of all references."""
    sql = QUANT + f""",
r as (select * from q where ok%10<>0),
k0 as (select row_number() over (order by (ok*2654435761)%4294967296, ok) - 1 cluster_id, {", ".join(Q)} from r qualify cluster_id < {CLUSTERS})"""

    def assign(name: str, centroids: str) -> str:
        d = _d2("r", "c", Q)
        return f""",
{name} as (select * exclude (rn) from (select r.*, c.cluster_id, row_number() over (partition by r.ok order by {d}, c.cluster_id) rn from r cross join {centroids} c) where rn = 1)"""

    for i in range(ROUNDS):
        means = ", ".join(f"cast(floor(cast(sum({x}) as double)/count(*)+0.5) as int) {x}" for x in Q)
        sql += assign(f"a{i}", f"k{i}")
        sql += f""",
m{i} as (select cluster_id, {means} from a{i} group by cluster_id),
k{i + 1} as (select k.cluster_id, {", ".join(f"coalesce(m.{x}, k.{x}) {x}" for x in Q)} from k{i} k left join m{i} m using (cluster_id))"""
    return sql + assign("cl", f"k{ROUNDS}") + f""",
cen as (select * from k{ROUNDS}),
sz as (select c.cluster_id, count(cl.ok) n from cen c left join cl using (cluster_id) group by c.cluster_id)"""


def _short(n: int) -> str:
    d = _d2("a", "c", Q)
    return f""",
pr as (select * from (select a.ok qid, cast(row_number() over (partition by a.ok order by {d}, c.cluster_id) as int) probe, c.cluster_id, {d} cd2
  from q a cross join cen c where a.ok%10=0) where probe <= {n})"""


def _scan(name: str, probes: str) -> str:
    d = _d2("a", "r", Q)
    return f""",
{name} as (select * from (select a.ok qid, r.ok ref_id, {d} d2, r.fraud, row_number() over (partition by a.ok order by {d}, r.ok) rank
  from {probes} p join q a on a.ok = p.qid join cl r on r.cluster_id = p.cluster_id) where rank <= 5)"""


def _scan_cap() -> str:
    d = _d2("a", "r", Q)
    return f""",
po as (select ok, cluster_id, row_number() over (partition by cluster_id order by ok) pos from cl),
tk as (select p.*, coalesce(sum(s.n) over (partition by qid order by probe rows between unbounded preceding and 1 preceding), 0) before from pr p join sz s using (cluster_id)),
nn as (select * from (select a.ok qid, r.ok ref_id, {d} d2, r.fraud, row_number() over (partition by a.ok order by {d}, r.ok) rank
  from tk p join q a on a.ok = p.qid join cl r on r.cluster_id = p.cluster_id join po on po.ok = r.ok where po.pos <= {CAP} - p.before) where rank <= 5)"""


IVF = _ivf()
_FIXED = IVF + _short(BASE) + _scan("nn", "pr")
_ADAPTIVE = IVF + _short(MOST) + f",\nb1 as (select * from pr where probe <= {BASE})" + _scan("n1", "b1") + f""",
un as (select qid from n1 group by qid having sum(fraud) between 2 and 4),
b2 as (select * from pr where probe <= {BASE} or qid in (select qid from un))""" + _scan("nn", "b2")

_CONFUSION = """select {setting} count(*) filter (not e and not a) tp, count(*) filter (e and a) tn, count(*) filter (e and not a) fp, count(*) filter (not e and a) fn, count(*) total,
  cast(count(*) filter (e = a) as double)/count(*) accuracy, count(*) filter (e and not a) + 3*count(*) filter (not e and a) weighted_e, count(*) filter (e <> a) raw_errors"""


def _sweep() -> str:
    sql, parts = KNN + IVF.removeprefix(QUANT), []
    sql += ",\nex as (" + _VOTE.replace("< 0.6e0 approved", "< 0.6e0 e") + ")" + _short(MOST)
    for n in (1, 2, 4, CLUSTERS if CLUSTERS <= MOST else MOST):
        sql += f",\np{n} as (select * from pr where probe <= {n})" + _scan(f"s{n}", f"p{n}")
        sql += f",\nv{n} as (select qid, cast(sum(fraud) as double)/5 < 0.6e0 a from s{n} group by qid)"
        parts.append(_CONFUSION.format(setting=f"'nprobe={n}' setting,") + f" from v{n} join ex using (qid)")
    for n in (1, 2, 4):
        sql += f",\nw{n} as (select qid from s{n} group by qid having sum(fraud) between 2 and 4),\nt{n} as (select * from pr where probe <= {n} or qid in (select qid from w{n}))" + _scan(f"u{n}", f"t{n}")
        sql += f",\nx{n} as (select qid, cast(sum(fraud) as double)/5 < 0.6e0 a from u{n} group by qid)"
        parts.append(_CONFUSION.format(setting=f"'adaptive={n}-{MOST}' setting,") + f" from x{n} join ex using (qid)")
    return f"with {sql}\n" + "\nunion all\n".join(parts)


def _generated() -> str:
    """The same arithmetic as in the generator, and the features of it."""
    names = ("cents", "instalments", "second", "usual", "today", "merchant", "friend", "code", "shop", "flags", "home", "gap", "away")
    of = {x: f"(((n+1)*{7919 + 2 * i}+42)%2147483647*48271%2147483647*16807%2147483647)" for i, x in enumerate(names)}
    d = lambda what, most: f"({of[what]}%{most})"
    return f"""with g as (select event_id n from events),
a as (select n, 1767225600 + {d("second", 28 * 86400)} ep, {d("cents", 1200)} root, {d("merchant", 500)} shop from g),
f as (select 'made-' || n ok, (root*root+50)/100.0e0 amount, 1+{d("instalments", 18)} inst, ep, {d("usual", 250000)}/100.0e0 cavg, {d("today", 30)} n24,
  {d("friend", 3)} <> 0 unk, {d("code", 12)} mccx, {d("shop", 1500000)}/100.0e0 mavg, {d("home", 12000)}/8.0e0 kmh, {d("flags", 4)}%2=1 onl, {d("flags", 4)}>=2 cp,
  case when {d("gap", 5)} <> 0 then ep - 60*(1+{d("gap", 3000)}) end lep, {d("away", 9000)}/8.0e0 kml from a)
select ok id, """ + ", ".join(f"{e} {v}" for e, v in zip(_V, V, strict=True)) + " from f"


def _boxes() -> str:
    """Clusters as cells: their boxes, and for each query the bounds, their order and the references in the cells before."""
    edges = ", ".join(f"min({x}) lo_{x}, max({x}) hi_{x}" for x in Q)
    bound = " + ".join(f"cast(power(greatest(lo_{x}-{x}, {x}-hi_{x}, 0), 2) as bigint)" for x in Q)
    return f""",
bx as (select cluster_id, count(*) n, {edges} from cl group by cluster_id),
bd as (select a.ok qid, cluster_id, n, {bound} bound from q a cross join bx where a.ok%10=0),
rk as (select *, row_number() over w probe, cast(coalesce(sum(n) over (w rows between unbounded preceding and 1 preceding), 0) as bigint) before from bd window w as (partition by qid order by bound, cluster_id))"""


def _visits() -> str:
    return f"""with {IVF}{_boxes()},
f1 as (select qid, cluster_id from rk where before < 5){_scan("n1", "f1")},
t as (select qid, case when count(*) >= 5 then max(d2) else 1000000000000000 end tau from n1 group by qid),
vi as (select rk.qid, cast(sum(n) as bigint) candidates from rk join t using (qid) where before < 5 or bound <= tau group by rk.qid)
select count(*) n, quantile_disc(candidates, 0.5) p50, quantile_disc(candidates, 0.95) p95, quantile_disc(candidates, 0.99) p99, max(candidates) most from vi"""


def _budgets() -> str:
    sql, parts = KNN + IVF.removeprefix(QUANT) + _boxes() + ",\nex as (" + _VOTE.replace("< 0.6e0 approved", "< 0.6e0 e") + ")", []
    for b in BUDGETS:
        sql += f",\np{b} as (select qid, cluster_id from rk where probe <= {b})" + _scan(f"s{b}", f"p{b}")
        sql += f",\nv{b} as (select qid, cast(sum(fraud) as double)/5 < 0.6e0 a from s{b} group by qid)"
        parts.append(_CONFUSION.format(setting=f"'cells={b}' setting,") + f" from v{b} join ex using (qid)")
    return f"with {sql}\n" + "\nunion all\n".join(parts)


def _report() -> str:
    sql = KNN + IVF.removeprefix(QUANT) + ",\nex as (" + _VOTE.replace("< 0.6e0 approved", "< 0.6e0 e") + ")" + _short(MOST)
    runs = []
    for i, n in enumerate(PROBES):
        sql += f",\np{n} as (select * from pr where probe <= {n})" + _scan(f"s{n}", f"p{n}")
        sql += f",\nv{n} as (select qid, cast(sum(fraud) as double)/5 < 0.6e0 a from s{n} group by qid)"
        runs.append(f"select cast({i} as bigint) run, count(*) filter (e and not a) fp, count(*) filter (not e and a) fn, count(*) n from v{n} join ex using (qid)")
    return f"""with {sql},
dr as ({" union all ".join(runs)}),
ev as (select event_id % {len(PROBES)} run, count(*) filter (event_type = 'error' and value > {SLOW}) errors, quantile_disc(value, 0.99) p99 from events group by 1),
rr as (select run, fp, fn, errors, n, p99 from dr join ev using (run)),
sc as (select *, cast(fp+3*fn+5*errors as double) e, cast(fp+fn+errors as double)/n > 0.15 cut from rr),
tt as (select *, case when p99 <= 0 then 0.0e0 when p99 > 2000 then -3000.0e0 else 1000*log10(1000/greatest(p99, 1.0e0)) end ps,
 case when not cut then 1000*log10(1/greatest(e/n, 0.001e0)) end rp, case when not cut then -300*log10(1+e) + 0.0e0 end ap from sc)
select run, fp, fn, errors, n, p99, round(ps,2) p99_score, round(rp,2) rate_part, round(ap,2) absolute_part, round(case when cut then -3000.0e0 else rp+ap end,2) detection_score,
 round(ps + case when cut then -3000.0e0 else rp+ap end,2) final_score from tt"""


def _splits(rule: str = "median") -> str:
    """References in cells (cl, cluster_id), level by level: rows of a node in the order of the widest dimension and id."""
    wide = "[" + ", ".join(f"max({x})-min({x})" for x in Q) + "]"
    twice = "[" + ", ".join(f"max({x})+min({x})" for x in Q) + "]"
    side = "greatest(1, n//9)"
    first = "n//2" if rule == "median" else f"case when w > 0 and n > 2 then least(greatest(below, {side}), n-{side}) else n//2 end"
    sql = QUANT + ",\nt0 as (select ok, fraud, " + ", ".join(Q) + ", cast(1 as bigint) cell from q where ok%10<>0)"
    for i in range(DEPTH):
        sql += f""",
g{i} as (select *, list_position(rg, list_max(rg)) d from (select cell, count(*) n, {wide} rg, {twice} tw from t{i} where cell >= {1 << i} group by cell having count(*) > 5)),
o{i} as (select ok, cell, n, [{", ".join(Q)}][d] v, rg[d] w, tw[d] tw from t{i} join g{i} using (cell)),
u{i} as (select ok, n, w, row_number() over (partition by cell order by v, ok) - 1 rn, count(*) filter (2*v < tw) over (partition by cell) below from o{i}),
t{i + 1} as materialized (select t{i}.* exclude (cell), case when u{i}.ok is null then cell when rn < {first} then 2*cell else 2*cell+1 end cell from t{i} left join u{i} using (ok))"""
    return sql + f",\ncl as materialized (select * exclude (cell), cell cluster_id from t{DEPTH})"


def _seeded(boxes: str) -> str:
    """Bounds, the seeds' neighbours n0 and the distance of the last of them."""
    return f"""{boxes},
f1 as (select qid, cluster_id from rk where before < 5){_scan("n0", "f1")},
t as materialized (select qid, cast(case when count(*) >= 5 then max(d2) else 1000000000000000 end as double) tau from n0 group by qid)"""


def _counters() -> str:
    return f"""with {_descent().removeprefix("with ").replace(_PER_LEVEL, ",\nlv as (", 1)})
select (select count(*) from rk join t using (qid) where before < 5 or bound <= tau) pairs, (select cast(sum(n) as bigint) from rk join t using (qid) where before < 5 or bound <= tau) candidates,
 cast(sum(seen) as bigint) seen, cast(sum(pruned) as bigint) pruned from lv"""


#: Between the tables of a descent and what it reports.
_PER_LEVEL = "\n/* levels */\n"


def _descent() -> str:
    edges = ", ".join(f"min({x}) lo_{x}, max({x}) hi_{x}" for x in Q)
    bound = " + ".join(f"cast(power(greatest(lo_{x}-{x}, {x}-hi_{x}, 0), 2) as bigint)" for x in Q)
    sql, parts = f"with {_splits()}{_seeded(_boxes())}", []
    for i in range(DEPTH + 1):
        parent = f" join k{i - 1} on k{i - 1}.qid = a.ok and k{i - 1}.node = bb.node // 2" if i else ""
        sql += f""",
l{i} as materialized (select a.ok qid, bb.node, {bound} <= tau near from q a join t on t.qid = a.ok
  cross join (select cluster_id // {1 << (DEPTH - i)} node, {edges} from cl group by 1) bb{parent} where a.ok%10=0),
k{i} as (select qid, node from l{i} where near)"""
        parts.append(f"select {i} as level, count(*) seen, count(*) filter (not near) pruned from l{i}")
    return sql + _PER_LEVEL + "\nunion all\n".join(parts)


def _tuned(early: int | None = None, epsilon: float = 0.0, soft: int = 1500, span: int = 1500, most: int | None = None) -> str:
    """Rounds of 1, 2, 4, ... further cells of each query, under the bound that the round before has left."""
    sql = f"""with {_splits()}{_seeded(_boxes())},
w as materialized (select rk.qid, cluster_id, n, bound, row_number() over (partition by rk.qid order by bound, cluster_id) - 1 place from rk join t using (qid) where before >= 5 and bound <= tau),
z0 as materialized (select qid, tau, count(*) cells, cast(sum(n) as bigint) visits, 0 rounds, {f"tau <= {early}" if early else "false"} done from rk join t using (qid) where before < 5 group by qid, tau)"""
    for j in range(DEPTH + 1):
        scale = f"(1 - {epsilon}e0 * least(greatest((visits - {soft})/{span}.0e0, 0.0e0), 1.0e0))"
        sql += f""",
c{j} as materialized (select w.* from w join z{j} using (qid) where not done and {f"visits < {most}" if most else "true"} and place between {(1 << j) - 1} and {(1 << (j + 1)) - 2} and bound <= tau * {scale}){_scan(f"e{j}", f"c{j}")},
n{j + 1} as materialized (select qid, ref_id, d2, fraud, place rank from (select * exclude (rank), row_number() over (partition by qid order by d2, ref_id) place from (select * from n{j} union all select * from e{j})) where place <= 5),
r{j} as (select qid, count(*) nc, sum(n) nv from c{j} group by qid),
y{j} as (select qid, cast(case when count(*) >= 5 then max(d2) else 1000000000000000 end as double) tau from n{j + 1} group by qid),
z{j + 1} as materialized (select qid, y{j}.tau, cells + coalesce(nc, 0) cells, cast(visits + coalesce(nv, 0) as bigint) visits, rounds + case when nc > 0 then 1 else 0 end rounds, coalesce(nc, 0) < {1 << j} done
  from z{j} left join r{j} using (qid) join y{j} using (qid))"""
    last = DEPTH + 1
    return sql + f"""
select qid, cast(sum(fraud) as bigint) frauds, cast(sum(fraud) as double)/5 fraud_score, cast(sum(fraud) as double)/5 < 0.6e0 approved, any_value(rounds) rounds, any_value(cells) cells, any_value(visits) visits
from n{last} join z{last} using (qid) group by qid"""


def _visited() -> str:
    sql, parts = f"with {_splits()}{_boxes()},\n{_knn(5)},\ngold as (select qid, sum(fraud) g from nn group by qid order by qid)", []
    for b in VISITS:
        sql += f",\np{b} as (select qid, cluster_id, n from rk where before < {b})" + _scan(f"s{b}", f"p{b}")
        sql += f",\nv{b} as (select qid, sum(fraud) f from s{b} group by qid),\nx{b} as (select qid, cast(sum(n) as bigint) visits from p{b} group by qid)"
        parts.append(f"""select {b} setting, count(*) total, count(*) filter ((f < 3) <> (q.fraud = 0)) errors, count(*) filter (f <> g) mismatches,
  quantile_disc(visits, 0.5) p50, quantile_disc(visits, 0.95) p95, quantile_disc(visits, 0.99) p99, max(visits) most from v{b} join gold using (qid) join x{b} using (qid) join q on q.ok = qid""")
    return f"{sql}\n" + "\nunion all\n".join(parts)


_BAD = """case ok%13 when 1 then 'missing_id' when 2 then 'missing_requested_at' when 3 then 'missing_merchant' when 4 then 'bad_json' when 5 then 'bad_requested_at' when 6 then 'missing_transaction' end"""

ORACLE: dict[str, str] = {
    "vectorize": f"with {VEC} select ok, " + ", ".join(V) + " from v",
    "quantize": f"with {QUANT} select ok, " + ", ".join(Q) + ", fraud from q",
    "dequantize": f"with {QUANT} select ok, " + ", ".join(f"{q}/10000.0e0 {q}" for q in Q) + " from q",
    "mcc_lookup": f"with {TX} select mid % 12 code, count(*) n, min(case mccx {_RISK} else 0.5e0 end) risk from f group by 1",
    "parse_valid": f"with {TX} select ok, amount, cast(inst as int) installments, ep requested_at, cavg avg_amount, cast(n24 as int) tx_count_24h, case when unk then 0 else 1 end n_known, 'M' || mid merchant, mavg merchant_avg, onl is_online, cp card_present, kmh km_from_home, lep last_at, case when lep is not null then kml end last_km from f",
    "parse_reject_reason": f"with {TX} select ok, {_BAD} error from f where {_BAD} is not null",
    "route_status": "select event_id, case when event_type in ('view','click') then case when event_id%3=0 then 405 when event_id%5000 + 4000 > 8192 then 413 else 200 end else 404 end status from events",
    "squared_distance": f"with {QUANT} select a.ok qid, b.ok ref_id, {_d2('a', 'b', Q)} d2 from q a join q b on b.ok = a.ok + 1",
    "knn_brute": f"with {KNN} select qid, ref_id, d2, fraud, cast(rank as int) rank from nn",
    "knn_top1": f"with {QUANT},\n{_knn(1)} select qid, ref_id, d2 from nn",
    "knn_embeddings": f"with {EMB},\n{_knn(5, _E)} select qid, ref_id, d2, fraud, cast(rank as int) rank from nn",
    "score": f"with {KNN} {_VOTE}",
    "http_response": f"with {KNN} select qid, cast(sum(fraud) as int) http_frauds, '{{\"approved\":' || case when sum(fraud) < 3 then 'true' else 'false' end || ',\"fraud_score\":' || cast(sum(fraud) as double)/5 || '}}' http_body from nn group by qid",
    "ivf_assign": f"with {IVF} select ok, cluster_id from cl",
    "ivf_centroids": f"with {IVF} select cluster_id, " + ", ".join(Q) + " from cen",
    "ivf_cluster_sizes": f"with {IVF} select cluster_id, n from sz",
    "ivf_cluster_stats": f"with {IVF}, l as (select list_sort(list(n)) s, count(*) c, count(*) filter (n=0) empty from sz) select c clusters, s[1 + cast(floor(c*0.5) as int)] p50, s[1 + least(cast(floor(c*0.99) as int), c-1)] p99, s[c] most, empty from l",
    "ivf_shortlist": f"with {IVF}{_short(BASE)} select qid, probe, cluster_id, cd2 from pr",
    "ivf_fixed": f"with {_FIXED} select qid, ref_id, d2, fraud, cast(rank as int) rank from nn",
    "ivf_adaptive": f"with {_ADAPTIVE} select qid, ref_id, d2, fraud, cast(rank as int) rank from nn",
    "ivf_scancap": f"with {IVF}{_short(BASE)}{_scan_cap()} select qid, ref_id, d2, fraud, cast(rank as int) rank from nn",
    "ivf_full_probe": f"with {KNN} select qid, ref_id, d2, fraud, cast(rank as int) rank from nn",
    "cells_knn": f"with {KNN} select qid, ref_id, d2, fraud, cast(rank as int) rank from nn",
    "cells_visits": _visits(),
    "cells_budget": _budgets(),
    "cells_refined": f"with {KNN} select qid, ref_id, d2, fraud, cast(rank as int) rank from nn",
    "cells_levels": f"with {_splits()} select ok, cluster_id cell_id from cl",
    "cells_midpoint": f"with {_splits('midpoint')} select ok, cluster_id cell_id from cl",
    "boxes_knn": f"with {KNN} select qid, ref_id, d2, fraud, cast(rank as int) rank from nn",
    "boxes_descent": _descent(),
    "search_counters": _counters(),
    "boxes_early": _tuned(early=EARLY),
    "boxes_relaxed": _tuned(epsilon=EPSILON, soft=SOFT, span=SPAN),
    "boxes_stopped": _tuned(most=STOP),
    "boxes_rounds": _tuned(),
    "visits_sweep": _visited(),
    "stream_preloaded": f"with {KNN} {_VOTE}",
    "ivf_pruned": f"with {_ADAPTIVE} select qid, ref_id, d2, fraud, cast(rank as int) rank from nn",
    "binary_plain": f"with {QUANT} select {', '.join(Q)}, fraud, count(*) n from q where ok%10<>0 group by all",
    "binary_clustered": f"with {IVF} select cluster_id, count(*) n, cast(sum(fraud) as bigint) frauds, " + ", ".join(f"cast(sum({x}) as bigint) {x}" for x in Q) + ", case when cluster_id % 3 = 0 then count(*) end n_apart from cl group by cluster_id",
    "cells_bbox": f"with {IVF} select cluster_id cell_id, count(*) n, " + ", ".join(f"min({x}) lo_{x}, max({x}) hi_{x}" for x in Q) + " from cl group by cluster_id",
    "box_distance": f"with {IVF}, bx as (select cluster_id, " + ", ".join(f"min({x}) lo_{x}, max({x}) hi_{x}" for x in Q) + " from cl group by cluster_id) select a.ok qid, cluster_id, "
    + " + ".join(f"cast(power(greatest(lo_{x}-{x}, {x}-hi_{x}, 0), 2) as bigint)" for x in Q) + " bound from q a cross join bx where a.ok%10=0",
    "index_roundtrip": f"with {KNN} {_VOTE}",
    "stream_score": f"with {KNN} {_VOTE}",
    "confusion": f"with {KNN}, s as (select qid, sum(fraud) < 3 a, (qid*7919+13)%100 >= 25 e from nn group by qid) " + _CONFUSION.format(setting="") + " from s",
    "latency_percentiles": "select count(value) n, quantile_disc(value, 0.5) p50, quantile_disc(value, 0.9) p90, quantile_disc(value, 0.99) p99, quantile_disc(value, 0.999) p999, max(value) most from events",
    "load_report": _report(),
    "nprobe_sweep": _sweep(),
    "corpus_scan": f"with {TX} select ok, (ok*7919+13)%100 >= 25 expected_approved from f",
    "generated": _generated(),
    "baselines": f"with {TX} select b baseline, 'tx-' || ok id, cast(0 as bigint) frauds, 0.0e0 fraud_score, true approved, 'OK' status from f cross join (values ('stub'), ('vectorize')) t(b)",
    "score_repeats": f"with {KNN}, s as ({_VOTE}) select s.*, 'OK' status from s cross join range(2)".replace("s.*", "qid, frauds, fraud_score, approved"),
    "fail_safe": f"with {TX} select 'tx-' || ok id, 0.6e0 fraud_score, false approved, 'FAIL_SAFE' status from f",
    "references_read": f"with e as (select {', '.join(_quantize(f'cast(embedding[{i + 1}] as double)') + f' {q}' for i, q in enumerate(Q))}, case when label >= 5 then 1 else 0 end fraud from embeddings) select *, count(*) n from e group by all",
    "fallback": f"with {KNN}, s as ({_VOTE}) select x found, qid, frauds, fraud_score, approved from s cross join (values ('cells'), ('flat')) t(x) union all select 'stub', qid, cast(0 as bigint), 0.0e0, true from s",
    "ivf_build": f"with {_FIXED} select qid, ref_id, d2, fraud, cast(rank as int) rank from nn",
}
assert len(_V) == DIMS
