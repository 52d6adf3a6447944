"""SQL of those llm queries that it can state over whole tables: set similarities and shared runs of words."""

from __future__ import annotations


def _grams(width: int) -> str:
    """All runs of ``width`` entries of the list w, as text."""
    run = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(width))
    return f"unnest(list_transform(range(1, len(w) - {width - 2}), lambda i: {run}))"


def _words(column: str) -> str:
    return f"list_transform(regexp_extract_all({column}, '[A-Za-z0-9]+'), lambda x: lower(x))"


def _pairs(kind: str, table: str, key: str, text: str) -> str:
    """Pairs of programs with similarity 0.6 or more over 4-token runs; a pair shares one of the rarest 0.4 n + 1 runs."""
    return f"""{kind}_g as (select distinct id, {_grams(4)} g from (select {key} id, regexp_extract_all({text}, '[A-Za-z0-9_]+|[^\\sA-Za-z0-9_]') w from {table} where {text} is not null) x where len(w) >= 50),
{kind}_n as (select id, count(*) n from {kind}_g group by 1), {kind}_f as (select g, count(*) f from {kind}_g group by 1),
{kind}_r as (select id, g, n, row_number() over (partition by id order by f, g) r from {kind}_g join {kind}_f using (g) join {kind}_n using (id)),
{kind}_c as (select distinct a.id a, b.id b from {kind}_r a join {kind}_r b on a.g = b.g and a.id < b.id and a.r <= a.n - ceil(0.6 * a.n - 1e-9) + 1 and b.r <= b.n - ceil(0.6 * b.n - 1e-9) + 1),
{kind}_s as (select c.a, c.b, count(*) s from {kind}_c c join {kind}_g x on x.id = c.a join {kind}_g y on y.id = c.b and y.g = x.g group by 1, 2),
{kind}_p as (select a key_lo, b key_hi from {kind}_s join {kind}_n x on x.id = a join {kind}_n y on y.id = b where s / (x.n + y.n - s) >= 0.6)"""


_HITS = f"""with d as (select distinct doc_id, {_grams(13)} g from (select doc_id, {_words("text")} w from documents where text is not null) x where len(w) >= 13),
i as (select distinct item_id, {_grams(13)} g from (select item_id, {_words("text")} w from heldout_items where text is not null) x where len(w) >= 13)"""

SQL = {
    "p2_limits": """with s as (select model, dataset, n, unnest([{'unit': 'characters', 'size': c}, {'unit': 'bytes', 'size': b}]) u from (select model, dataset, length(generated_solution) c, strlen(generated_solution) b, count(*) n from generations where generated_solution is not null group by all) x),
t as (select model, dataset, u.unit unit, u.size size, n, max(u.size) over (partition by model, dataset, u.unit) top from s),
h as (select model, dataset, unit, top, sum(case when size = top then n else 0 end) n_at, sum(case when size < top then n else 0 end) below from t where size >= top - 50 group by all)
select model, dataset, unit, cast(top as integer) "limit", cast(n_at as bigint) rows_at_limit from h where n_at >= 5 and n_at >= 5.0 * (below / 50.0 + 1)""",
    "p4_found": f"""with {_pairs("bigobench", "bigobench", "solution_no", "solution_code")}, {_pairs("generation", "generations", "generation_id", "generated_solution")}
select 'bigobench' record_kind, key_lo, key_hi from bigobench_p union all select 'generation', key_lo, key_hi from generation_p""",
    "p4_groups": f"""with recursive {_pairs("bigobench", "bigobench", "solution_no", "solution_code")}, {_pairs("generation", "generations", "generation_id", "generated_solution")},
g as (select 'bigobench' k, * from bigobench_g union all select 'generation', * from generation_g), p as (select 'bigobench' k, * from bigobench_p union all select 'generation', * from generation_p),
e as (select k, key_lo a, key_hi b from p union all select k, key_hi, key_lo from p), s as (select k, id, md5(string_agg(g, chr(10) order by g)) h from g group by 1, 2), c as (select k, id, h, min(id) over (partition by k, h) class from s),
near(k, id, other) as (select k, id, id from c union select near.k, near.id, e.b from near join e on e.k = near.k and e.a = near.other),
r as (select k, id, min(other) grp from near group by 1, 2), l as (select e.k, e.a id, count(distinct y.class) n from e join c x on x.k = e.k and x.id = e.a join c y on y.k = e.k and y.id = e.b and y.class <> x.class group by 1, 2)
select c.k record_kind, c.id "key", class class_key, grp group_key, coalesce(n, 0) n_links from c join r on r.k = c.k and r.id = c.id left join l on l.k = c.k and l.id = c.id""",
    "p5_found": f"""with g as (select distinct _idx, train, {_grams(3)} g from (select _idx, coalesce(_split = 'train', false) train, {_words("prompt")} w from effibench where prompt is not null) x where len(w) >= 3),
n as (select _idx, count(*) n from g group by 1), c as (select a._idx e, b._idx t, count(*) s from g a join g b on a.g = b.g and not a.train and b.train group by 1, 2)
select least(e, t) idx_lo, greatest(e, t) idx_hi from c join n x on x._idx = e join n y on y._idx = t where s / (x.n + y.n - s) >= 0.5""",
    "p5_report": f"""with r as (select _idx, coalesce(_split = 'train', false) train, {_words("prompt")} w from effibench where prompt is not null),
g as (select distinct _idx, train, {_grams(3)} g from r where len(w) >= 3),
n as (select _idx, count(*) n from g group by 1), c as (select a._idx e, b._idx t, count(*) s from g a join g b on a.g = b.g and not a.train and b.train group by 1, 2),
m as (select e, max(case when x.w = y.w then 1 else 0 end) same from c join n p on p._idx = e join n q on q._idx = t join r x on x._idx = e join r y on y._idx = t where s / (p.n + q.n - s) >= 0.5 group by 1)
select _split, _src_file, count(*) "rows", count(same) overlapping, cast(sum(case when same = 1 then 1 else 0 end) as bigint) equal from effibench left join m on m.e = _idx where _split is distinct from 'train' group by 1, 2""",
    "p5_classes": f"""with r as (select _idx, coalesce(_split = 'train', false) train, {_words("prompt")} w from effibench where prompt is not null), k as (select *, min(_idx) over (partition by w) class from r where len(w) >= 3),
g as (select distinct _idx, train, {_grams(3)} g from k), n as (select _idx, count(*) n from g group by 1), c as (select a._idx e, b._idx t, count(*) s from g a join g b on a.g = b.g and not a.train and b.train group by 1, 2),
p as (select e, t from c join n x on x._idx = e join n y on y._idx = t where s / (x.n + y.n - s) >= 0.5), l as (select e own, t other from p union all select t, e from p),
d as (select k.class, k.train, count(distinct o.class) n from l join k on k._idx = l.own join k o on o._idx = l.other group by 1, 2)
select _idx, k.class class_idx, coalesce(n, 0) n_links from k left join d on d.class = k.class and d.train = k.train""",
    "p9_found": f"{_HITS} select distinct doc_id, item_id from d join i using (g)",
}
