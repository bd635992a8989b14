"""SQL for DuckDB of those queries that SQL can express.

The others are tested against brute force, an exact round trip or held-out accuracy: line dedup (edit similarity of all
pairs), byte pairs and token counts (the libraries), language-model scores (a plain computation), toxicity (held-out
accuracy), MinHash (all pairs).
"""

from __future__ import annotations

from .secret_scan import RULES, Rule

_EMBEDDINGS = """
with recursive e as (select vec_id, label, cast(embedding as double[]) v from embeddings where label is not null and embedding is not null),
g as (select * from e where len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
l as (select a.vec_id a, b.vec_id b from g a join g b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.93),
r as (select vec_id id, vec_id low from embeddings union select r.id, l.b from r join l on l.a = r.low),
c as (select id, min(low) component_id from r group by id),
n as (select a id, count(*) n from l group by a)
select c.id vec_id, coalesce(n.n, 0) n_links, component_id, c.id = component_id kept from c left join n using (id)
"""


def _spans(k: int, rule: Rule) -> str:
    """Matches of one rule. Their places follow from the lengths of the matches and of what lies between them."""
    pattern = (("(?i)" if rule.fold else "") + rule.pattern).replace("'", "''")
    return f"""select rid, {k} k, '{rule.kind}' kind, {rule.least} least, regexp_split_to_array(t, '{pattern}') rest, regexp_extract_all(t, '{pattern}') m, regexp_extract_all(t, '{pattern}', {rule.measure}) g from d"""


def _secrets() -> str:
    rules = "\n union all ".join(_spans(k, r) for k, r in enumerate(RULES))
    base = [r.kind for r in RULES if r.base]
    counts = ", ".join(f"count(*) filter (kind = '{x}') n_{x}" for x in base)
    last = len(base) - 1
    return f"""with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
m as ({rules}),
i as (select rid, k, kind, least, rest, m, g, unnest(range(1, len(m) + 1)) i from m),
p as (select rid, k, kind, coalesce(list_sum(list_transform(rest[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))), 0) a, len(m[i]) n from i where len(g[i]) >= least),
s as (select rid, k, kind, cast(a as bigint) a, kind || ':' || cast(a as bigint) || ':' || cast(a + n as bigint) said from p),
o as (select rid, {counts}, string_agg(said, ',' order by a, k) filter (k <= {last}) base, string_agg(said, ',' order by a, k) spans from s group by rid)
select doc_id, {", ".join(f"coalesce(n_{x}, 0) n_{x}" for x in base)}, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from d left join o using (rid)"""


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_CONTAMINATION = f"""
with i as (select cast(item_id as varchar) item, {_WORDS} w from benchmark where item_id is not null),
n as (select item, w, least(len(w), 13) n from i where len(w) > 0),
x as (select distinct item, n, array_to_string(w[s:s + n - 1], ' ') k from (select item, w, n, unnest(range(1, len(w) - n + 2)) s from n)),
d as (select row_number() over () rid, doc_id, {_WORDS} w from documents),
y as (select rid, n, s, array_to_string(w[s:s + n - 1], ' ') k from (select rid, w, n, unnest(range(1, len(w) - n + 2)) s from d, (select distinct n from n) z where len(w) >= n)),
h as (select y.rid, y.s, y.n, x.item from y join x using (n, k)),
c as (select rid, count(distinct place) n_hit from (select rid, unnest(range(s, s + n)) place from h) group by rid),
t as (select rid, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct rid, item from h) group by rid)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256,
 coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated from d left join c using (rid) left join t using (rid)
"""

_ARCHIVE = """
with d as (select page_id, strlen(coalesce(html, '')) payload_bytes, sha256(coalesce(html, '')) payload_digest from pages),
f as (select payload_digest, min(page_id) response from d where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, payload_digest, case when response <> page_id then 'revisit' else 'response' end record_type,
 case when response <> page_id then response end refers_to from d left join f using (payload_digest)
"""

_URLS = """
with r(h, p, action) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u as (select row_number() over () rid, page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
d as (select rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from u),
m as (select rid, h || p rule, action, row_number() over (partition by rid order by len(h || p) desc, len(h) desc, action desc) n
  from d join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select page_id, host, path, rule, coalesce(action, 'allow') verdict from d left join m on m.rid = d.rid and n = 1
"""

_CRC32 = """xor(4294967295, list_reduce(list_transform(str_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint)),
  lambda r, b: xor(r >> 8, list_reduce([xor(r, b) & 255, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)), cast(4294967295 as bigint)))"""


def _merkle(levels: int = 20, over: int = 8) -> str:
    """Level by level: the nodes n of all languages' trees, m of the one over them, and the walk w of every row upwards."""
    leaf = lambda n: "sha256(" + " || ".join(f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in ("cast(doc_id as varchar)", "source", "lang", f"cast({n} as varchar)", "text")) + ")"
    sql = f"""with d as (select row_number() over () rid, doc_id, coalesce('=' || lang, '') g, {leaf("n_chars")} leaf, case when {_CRC32} % 7 = 0 then {leaf("n_chars + 1")} end claimed from documents),
p as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 i, count(*) over (partition by g) c from d),
n0 as materialized (select g, i, c, leaf h from p),
w0 as materialized (select rid, g, i, c, '' proof, coalesce(claimed, leaf) now from p)"""

    def above(name: str, k: int) -> str:
        return f""",
{name}{k + 1} as materialized (select g, i // 2 i, (max(c) + 1) // 2 c, case when max(c) > 1 then sha256(string_agg(h, '' order by i)) else max(h) end h from {name}{k} group by g, i // 2)"""

    def walk(k: int, nodes: str) -> str:
        side = "case when w.i % 2 = 0 then now || coalesce(h, '') else h || now end"
        return f""",
w{k + 1} as materialized (select rid, w.g, w.i // 2 i, (w.c + 1) // 2 c, proof || coalesce(h, '') proof, case when w.c > 1 then sha256({side}) else now end now
  from w{k} w left join {nodes} s on s.g = w.g and s.i = xor(w.i, 1) and w.c > 1)"""

    for k in range(levels):
        sql += above("n", k) + walk(k, f"n{k}")
    sql += f""",
t as (select g, row_number() over (order by g) - 1 i, count(*) over () c, h from n{levels}),
m0 as materialized (select '' g, i, c, h from t),
w{levels + 1} as materialized (select rid, '' g, t.i, t.c, proof, now from w{levels} join t using (g))"""
    for k in range(over):
        sql += above("m", k) + walk(levels + 1 + k, f"m{k}")
    return sql + f"""
select doc_id, leaf, t.h subroot, r.h root, sha256(proof) proof_sha256, now folded_root, now = r.h verified from p join t using (g) join w{levels + 1 + over} w using (rid) cross join m{over} r"""


ORACLE: dict[str, str] = {
    "op4_embedding_dedup": _EMBEDDINGS,
    "op8_secret_scan": _secrets(),
    "op9_decontaminate": _CONTAMINATION,
    "op10_warc": _ARCHIVE,
    "op11_url_filter": _URLS,
    "op12_merkle": _merkle(),
}
