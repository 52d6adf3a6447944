"""Queries over test results and generations: metrics, comparison, failures, tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.functions import code as C
from evalweave.functions import text as T
from evalweave.operators import metrics as M
from evalweave.operators import tasks as K
from evalweave.session import materialize, spread, table

GROUP = ("model", "dataset", "condition")


def attempt() -> Column:
    return F.coalesce("completion_index", F.lit(0))


def runs(spark: SparkSession, d: str, policy: str = "last") -> DataFrame:
    """Results with their condition, one of each completion by ``policy``."""
    rows = table(spark, d, "unittest_results").where("row_index is not null").select("dataset", "model", "source_file", "row_index", "completion_index", "problem_id", "status", "pass", "error", "timeout", "received_at", "delivery_id")
    rows = rows.withColumn("condition", M.condition(F.col("source_file"))).withColumn("attempt", attempt())
    key = [F.col(c) for c in ("dataset", "model", "source_file", "row_index", "attempt")]
    return M.dedupe(rows, key, [F.col("received_at"), F.col("delivery_id")], policy)


_CONDITION = r"case when regexp_extract({0}, '\.(iso_[a-z_]+|iso|synonym_[0-9]+|deadcode)\.jsonl$', 1) <> '' then regexp_extract({0}, '\.(iso_[a-z_]+|iso|synonym_[0-9]+|deadcode)\.jsonl$', 1) else 'original' end"


def _runs_sql(policy: str = "last") -> str:
    way = {"last": "desc nulls last", "first": "asc nulls last"}.get(policy)
    rank = f"row_number() over (partition by dataset, model, source_file, row_index, coalesce(completion_index, 0) order by received_at {way}, delivery_id {way})" if way else "1"
    return f"""runs as (select * from (select dataset, model, source_file, row_index, coalesce(completion_index, 0) attempt, problem_id, status, pass, error, timeout, {_CONDITION.format('source_file')} condition,
  {rank} rn from unittest_results where row_index is not null) x where rn = 1)"""


_PROBLEMS_SQL = "problems as (select model, dataset, condition, row_index, cast(count(*) as integer) n, cast(sum(case when pass then 1 else 0 end) as integer) c from runs group by all)"
_PASS_K = "case when n - c < least(n, {k}) then 1.0 else 1 - list_aggregate(list_transform(range(0, least(n, {k})), lambda i: cast(n - c - i as double) / (n - i)), 'product') end"


def problems(spark: SparkSession, d: str) -> DataFrame:
    return M.per_problem(runs(spark, d), GROUP, "row_index", "pass")


def q01_pass_at_k(spark, d):
    return M.pass_rates(problems(spark, d), GROUP)


def _policy_counts(policy):
    def query(spark, d):
        return runs(spark, d, policy).groupBy("model", "dataset").agg(F.count("*").alias("rows"), F.count_if(F.coalesce("pass", F.lit(False))).alias("passed"))

    return query


def _policy_sql(policy):
    return f"with {_runs_sql(policy)} select model, dataset, count(*) \"rows\", sum(case when pass then 1 else 0 end) passed from runs group by 1, 2"


def q04_first_and_any(spark, d):
    return M.first_and_any(runs(spark, d), GROUP, "row_index", "attempt", "pass")


def with_generation(spark, d):
    """Results with the code and the error message of their generation (left join on the completion)."""
    gen = table(spark, d, "generations").where("row_index is not null").select("dataset", "model", "source_file", "row_index", attempt().alias("attempt"), "generated_solution", "error_message", "generation_id")
    gen = M.dedupe(gen, [F.col(c) for c in ("dataset", "model", "source_file", "row_index", "attempt")], [F.col("generation_id")], "first").drop("generation_id")
    return runs(spark, d).join(gen, ["dataset", "model", "source_file", "row_index", "attempt"], "left")


_GEN_SQL = """gen as (select * from (select dataset, model, source_file, row_index, coalesce(completion_index, 0) attempt, generated_solution, error_message,
  row_number() over (partition by dataset, model, source_file, row_index, coalesce(completion_index, 0) order by generation_id) gn from generations where row_index is not null) g where gn = 1),
joined as (select runs.*, gen.generated_solution, gen.error_message from runs left join gen using (dataset, model, source_file, row_index, attempt))"""


def q05_error_rates(spark, d):
    return M.error_rates(with_generation(spark, d), GROUP, "error_message", "generated_solution")


def scores(spark, d):
    return problems(spark, d).select(*GROUP, "row_index", (F.col("c") / F.col("n")).alias("score"))


def pairs(spark, d):
    return M.paired(scores(spark, d), ("model", "dataset"), "condition", "original", "row_index", "score")


def q06_bootstrap_ci(spark, d):
    return M.with_significance(M.bootstrap(pairs(spark, d), GROUP, ["row_index"]))


def q06_interval_grid(spark, d):
    """Rate of every model, data set and condition with the interval of its change, over the full grid."""
    means = scores(spark, d).groupBy(*GROUP).agg(F.avg("score").alias("rate"))
    return M.grid(M.bootstrap(pairs(spark, d), GROUP, ["row_index"]), ("dataset", "model"), "condition", means, "rate")


_LIMITS = " + ".join(f"case when u >= {x} then 1 else 0 end" for x in M.poisson_limits() if x < M.PRIME)
_PAIRS_SQL = f"""with {_runs_sql()}, {_PROBLEMS_SQL},
scores as (select model, dataset, condition, row_index, cast(c as double) / n score from problems),
pairs as (select a.model, a.dataset, a.condition, a.row_index, b.score bs, a.score cs from scores a join scores b on a.model = b.model and a.dataset = b.dataset and a.row_index = b.row_index and a.condition <> 'original' and b.condition = 'original')"""
_CI_SQL = f"""{_PAIRS_SQL},
lines as (select *, cast(('0x' || substr(h, 1, 8)) as bigint) % {M.PRIME - 1} + 1 step, cast(('0x' || substr(h, 9, 8)) as bigint) % {M.PRIME} start from (select *, md5('42|' || row_index) h from pairs) x),
weights as (select model, dataset, condition, b, bs, cs, {_LIMITS} w from (select *, (step * b + start) % {M.PRIME} u from lines cross join range(10000) t(b)) x),
diffs as (select model, dataset, condition, b, 100 * sum(w * cs) / sum(w) - 100 * sum(w * bs) / sum(w) diff from weights group by all having sum(w) > 0),
ci as (select model, dataset, condition, round(quantile_cont(diff, 0.025), 6) ci_lo, round(quantile_cont(diff, 0.975), 6) ci_hi from diffs group by all),
mean as (select model, dataset, condition, count(*) n_problems, round(100 * avg(bs), 6) orig, round(100 * avg(cs), 6) cond, round(100 * (avg(cs) - avg(bs)), 6) diff from pairs group by all)"""
_BOOT_SQL = f"""{_CI_SQL}
select model, dataset, condition, n_problems, orig, cond, diff, ci_lo, ci_hi, ci_lo > 0 or ci_hi < 0 significant, case when orig > 0 then round(100 * diff / orig, 6) else 0.0 end relative from mean join ci using (model, dataset, condition)"""
_GRID_SQL = f"""{_CI_SQL}, rates as (select model, dataset, condition, round(100 * avg(score), 6) rate from scores group by all)
select dataset, model, condition, rate, ci_lo, ci_hi, case when rate is null then '-' when ci_lo is null then printf('%.1f', round(rate, 1)) else printf('%.1f', round(rate, 1)) || ' [' || printf('%+.1f', round(ci_lo, 1)) || ', ' || printf('%+.1f', round(ci_hi, 1)) || ']' end shown
from (select distinct dataset from scores) a cross join (select distinct model from scores) b cross join (select distinct condition from scores) c left join rates using (dataset, model, condition) left join ci using (dataset, model, condition)"""


def buckets(spark, d):
    bucket = C.failure_bucket(F.col("status"), F.col("pass"), F.col("error"), F.col("timeout"), F.col("generated_solution"), F.col("error_message"))
    return with_generation(spark, d).withColumn("bucket", bucket)


def q07_failure_buckets(spark, d):
    return M.bucket_shares(buckets(spark, d), GROUP, "bucket")


def q08_bucket_deltas(spark, d):
    return M.bucket_deltas(q07_failure_buckets(spark, d), ("model", "dataset"), "condition", "original", "bucket")


def q08_diagnosis(spark, d):
    changes = M.rate_changes(q04_first_and_any(spark, d), ("model", "dataset"), "condition", "original", "pass_any")
    return M.diagnosis(q08_bucket_deltas(spark, d), GROUP, changes)


def _has(*parts):
    return "(" + " or ".join(f"contains(e, '{p}')" for p in parts) + ")"


_BUCKET_SQL = f"""with {_runs_sql()}, {_GEN_SQL}, b as (select model, dataset, condition, case when length(error_message) > 0 then 'API_ERROR'
 when generated_solution is null or regexp_full_match(generated_solution, '[ \\t\\n\\r\\f\\x0b]*') then 'EMPTY_CODE' when status = 'success' and pass then 'PASS'
 when coalesce(timeout, false) or {_has('timeout', 'timed out')} then 'TIMEOUT' when {_has('assert')} then 'ASSERTION_FAIL' when {_has(*C.PARSE_ERRORS)} then 'PARSE_ERROR'
 when {_has(*C.FORMAT_ERRORS)} then 'OUTPUT_FORMAT_ERROR' when {_has('error', 'exception')} then 'RUNTIME_ERROR' when e = '' then 'UNKNOWN_FAIL' else 'RUNTIME_ERROR' end bucket from (select *, lower(coalesce(error, '')) e from joined) j),
counted as (select model, dataset, condition, bucket, count(*) n from b group by all),
shares as (select model, dataset, condition, bucket, n, round(n / sum(n) over (partition by model, dataset, condition), 6) share from counted)"""
_DELTAS_SQL = f"""{_BUCKET_SQL}, names as (select distinct model, dataset, condition from shares where condition <> 'original'), kinds as (select distinct model, dataset, bucket from shares),
deltas as (select n.model, n.dataset, n.condition, k.bucket, coalesce(c.share, 0) cond_share, coalesce(o.share, 0) base_share from names n join kinds k on n.model = k.model and n.dataset = k.dataset
 left join shares c on c.model = n.model and c.dataset = n.dataset and c.condition = n.condition and c.bucket = k.bucket
 left join shares o on o.model = n.model and o.dataset = n.dataset and o.condition = 'original' and o.bucket = k.bucket),
d2 as (select *, round(cond_share - base_share, 6) delta from deltas where cond_share > 0 or base_share > 0)"""


def q25_pending_tasks(spark, d):
    """Completions 0 to 4 of effibench problems that no model has delivered without an error, by index."""
    problems_ = table(spark, d, "effibench").select(F.col("id").alias("problem_id"))
    gens = table(spark, d, "generations").where("dataset = 'effibench'").select("problem_id", attempt().alias("completion_index"), "error_message")
    done = K.done_keys(gens, ("problem_id", "completion_index"), F.col("error_message").isNotNull())
    return K.pending(K.fan_out(problems_, 5), done, ("problem_id", "completion_index")).groupBy("completion_index").agg(F.count("*").alias("pending"))


def q26_passed_generations(spark, d):
    gens = table(spark, d, "generations").select("generation_id", "dataset", "model", "source_file", "row_index", attempt().alias("attempt"))
    return K.passed_only(gens, runs(spark, d), ("dataset", "model", "source_file", "row_index", "attempt"), "pass").select("generation_id", "dataset", "model")


def q27_lookup(spark, d):
    """Generations of effibench with the length of their problem and its split, null where the problem is unknown."""
    from evalweave.operators.skew import salted_join

    problems_ = table(spark, d, "effibench").select(F.col("id").alias("problem_id"), "_split", F.length("prompt").alias("prompt_chars"))
    gens = table(spark, d, "generations").select("generation_id", "problem_id", "dataset")
    return salted_join(gens, problems_, "problem_id", "left").groupBy("dataset", "_split").agg(F.count("*").alias("generations"), F.sum("prompt_chars").alias("prompt_chars"))


def q29_rollup(spark, d):
    rows = table(spark, d, "generations")
    return rows.rollup("dataset", "model").agg(F.count("*").alias("rows"), F.count("error_message").alias("errors"), F.count_if(F.coalesce("iso_applied", F.lit(False))).alias("iso_applied"))


def q34_code_fence(spark, d):
    rows = table(spark, d, "generations")
    return rows.select("generation_id", C.extract_code(F.col("raw_llm_output")).alias("code"))


def q36_setops(spark, d):
    """Problems per data set: tested and generated, generated only, tested only, either."""
    gen = table(spark, d, "generations").where("problem_id is not null").select("dataset", "problem_id")
    ut = table(spark, d, "unittest_results").where("problem_id is not null").select("dataset", "problem_id")
    parts = [("both", gen.intersect(ut)), ("generated_only", gen.exceptAll(gen).union(gen).subtract(ut)), ("tested_only", ut.subtract(gen)), ("either", gen.union(ut).distinct())]
    out = None
    for name, df in parts:
        part = df.groupBy("dataset").agg(F.count("*").alias("problems")).withColumn("kind", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def q38_match_score(spark, d):
    rows = table(spark, d, "generations")
    return rows.select("generation_id", F.round(T.match_score(F.col("generated_solution"), F.col("generated_solution_clean")), 6).alias("score"))


_FIELDS = ("generated_solution", "generated_solution_clean", "code")


def q38_expected_match(spark, d):
    """How far each answer to a problem with a known solution runs along with it."""
    known = table(spark, d, "bigobench").select(F.col("solution_no").alias("row_index"), "solution_code")
    rows = table(spark, d, "generations").where("dataset = 'bigobench'").select("generation_id", "row_index", "generated_solution")
    return rows.join(known, "row_index", "left").select("generation_id", F.round(T.match_score(F.col("generated_solution"), F.col("solution_code")), 6).alias("score"))


def q39_code(spark, d):
    """The program of each answer: the first of three fields that holds one."""
    return table(spark, d, "generations").select("generation_id", F.md5(C.first_code(*map(F.col, _FIELDS))).alias("code_md5"))


def q39_opcode_divergence(spark, d):
    """Mean divergence of the operations of a problem's solutions, per problem and condition (two solutions at least)."""
    from evalweave.operators import divergence as V

    code = C.first_code(*map(F.col, _FIELDS)).alias("program")
    gens = spread(table(spark, d, "generations").select("generation_id", "problem_id", M.condition(F.col("source_file")).alias("condition"), code).where(F.length("program") > 0))
    ops = materialize(gens.select("generation_id", "problem_id", "condition", C.operations("program").alias("ops")))  # read twice below
    shares = V.histograms_from_maps(ops, ("problem_id", "condition"), "generation_id", "ops")
    centers = V.centroids(shares, ("problem_id", "condition"), "generation_id", 2)
    return V.mean_divergence(shares, centers, ("problem_id", "condition"), "generation_id")


def q40_ast_valid(spark, d):
    rows = spread(table(spark, d, "generations").select("dataset", C.first_code(*map(F.col, _FIELDS)).alias("program"))).select("dataset", C.syntax_error("program").alias("error"))
    return rows.groupBy("dataset", F.coalesce("error", F.lit("valid")).alias("outcome")).agg(F.count("*").alias("rows"))


def q47_only_rewritten(spark, d):
    """Answers to rewritten problems of which the rewriting was applied, per data set and family."""
    from evalweave.operators.rewriting import only_rewritten

    return only_rewritten(table(spark, d, "generations")).groupBy("dataset", "iso_family").agg(F.count("*").alias("rows"))


def q08_ordered_report(spark, d):
    """Failure shares in report order: groups by name, buckets in their fixed order, with their place."""
    from pyspark.sql import Window

    from evalweave.plans.pipelines import bucket_position

    rows = q07_failure_buckets(spark, d).withColumn("at", bucket_position(F.col("bucket")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*GROUP).orderBy("at"))).select(*GROUP, "place", "bucket", "share").orderBy(*GROUP, "place")


def q41_window_rates(spark, d):
    from evalweave.streaming.results import windowed_rates

    rows = table(spark, d, "unittest_results").where("received_at is not null")
    return windowed_rates(rows, "received_at", ("dataset",), "pass", "1 hour")


def q45_retryable(spark, d):
    rows = table(spark, d, "generations")
    return rows.groupBy("model").agg(F.count("error_message").alias("errors"), F.count_if(C.is_retryable(F.col("error_message"))).alias("retryable"))


def q48_variants(spark, d):
    rows = table(spark, d, "generations").withColumn("variant", M.variant(F.col("iso_applied"), F.col("iso_variant")))
    return rows.groupBy("dataset", "variant").agg(F.count("*").alias("rows"), F.count_if(F.col("iso_params")["a"].isNotNull()).alias("with_a"))


def q49_names(spark, d):
    rows = table(spark, d, "generations").select("generation_id", T.file_name(F.concat_ws("/", "model", "source_file")).alias("file"), T.display_name(F.concat(F.lit("openrouter:org/"), F.col("model"))).alias("display"))
    return rows.groupBy("file", "display").agg(F.count("*").alias("rows"))


_RETRY = " or ".join(f"contains(lower(error_message), '{p.lower()}')" for p in C.RETRYABLE)
_FENCES = [f.replace("(?is)", "(?is)") for f in C.FENCES]
_FENCE_SQL = "case " + " ".join(f"when len(regexp_extract_all(raw_llm_output, '{f}', 1)) > 0 then list_reduce(regexp_extract_all(raw_llm_output, '{f}', 1), lambda a, b: case when length(b) > length(a) then b else a end)" for f in _FENCES) + " else raw_llm_output end"
_STRIP = "regexp_replace({0}, '^[ \\t\\n\\r\\f\\x0b]+|[ \\t\\n\\r\\f\\x0b]+$', '', 'g')"

QUERIES = {
    "q01_pass_at_k": q01_pass_at_k,
    "q02_dedupe_last": _policy_counts("last"), "q03_dedupe_first": _policy_counts("first"), "q03_dedupe_none": _policy_counts("none"),
    "q04_first_and_any": q04_first_and_any, "q05_error_rates": q05_error_rates,
    "q06_bootstrap_ci": q06_bootstrap_ci, "q06_interval_grid": q06_interval_grid, "q08_ordered_report": q08_ordered_report, "q38_expected_match": q38_expected_match, "q39_code": q39_code, "q47_only_rewritten": q47_only_rewritten,
    "q07_failure_buckets": q07_failure_buckets, "q08_bucket_deltas": q08_bucket_deltas, "q08_diagnosis": q08_diagnosis,
    "q25_pending_tasks": q25_pending_tasks, "q26_passed_generations": q26_passed_generations, "q27_lookup": q27_lookup,
    "q29_rollup": q29_rollup, "q34_code_fence": q34_code_fence, "q36_setops": q36_setops, "q38_match_score": q38_match_score,
    "q39_opcode_divergence": q39_opcode_divergence, "q40_ast_valid": q40_ast_valid, "q41_window_rates": q41_window_rates,
    "q45_retryable": q45_retryable, "q48_variants": q48_variants, "q49_names": q49_names,
}

SQL = {
    "q01_pass_at_k": f"with {_runs_sql()}, {_PROBLEMS_SQL} select model, dataset, condition, count(*) num_problems, sum(n) total_samples, sum(c) total_passed, round(avg({_PASS_K.format(k=1)}), 6) pass_at_1, round(avg({_PASS_K.format(k=5)}), 6) pass_at_5, round(sum(c) / sum(n), 6) raw_pass_rate from problems group by 1, 2, 3",
    "q02_dedupe_last": _policy_sql("last"), "q03_dedupe_first": _policy_sql("first"), "q03_dedupe_none": _policy_sql("none"),
    "q04_first_and_any": f"""with {_runs_sql()}, e as (select model, dataset, condition, row_index, max(case when attempt = 0 then 1 else 0 end) h, max(case when attempt = 0 and pass then 1 else 0 end) f, max(case when pass then 1 else 0 end) a from runs group by all)
select model, dataset, condition, count(*) problems, round(coalesce(sum(f) / nullif(sum(h), 0), 0), 6) pass_first, round(avg(a), 6) pass_any from e group by 1, 2, 3""",
    "q05_error_rates": f"""with {_runs_sql()}, {_GEN_SQL} select model, dataset, condition, count(*) completions, round(avg(case when error_message is null then 0.0 else 1.0 end), 6) api_error_rate,
round(avg(case when error_message is null then case when generated_solution is null or regexp_full_match(generated_solution, '[ \\t\\n\\r\\f]*') then 1.0 else 0.0 end end), 6) empty_code_rate from joined group by 1, 2, 3""",
    "q06_bootstrap_ci": _BOOT_SQL,
    "q07_failure_buckets": f"{_BUCKET_SQL} select * from shares",
    "q08_bucket_deltas": f"{_DELTAS_SQL} select * from d2",
    "q06_interval_grid": _GRID_SQL,
    "q08_ordered_report": f"""{_BUCKET_SQL} select model, dataset, condition, cast(row_number() over (partition by model, dataset, condition order by list_position({list(C.BUCKETS)}, bucket)) as integer) place, bucket, share from shares order by 1, 2, 3, 4""",
    "q08_diagnosis": f"""{_DELTAS_SQL}, s as (select model, dataset, condition, sum(case when bucket in ('PARSE_ERROR', 'OUTPUT_FORMAT_ERROR') then delta else 0 end) i, sum(case when bucket = 'TIMEOUT' then delta else 0 end) t,
 sum(case when bucket = 'ASSERTION_FAIL' then delta else 0 end) a from d2 group by all),
e as (select model, dataset, condition, row_index, max(case when pass then 1 else 0 end) a from runs group by all), k as (select model, dataset, condition, round(avg(a), 6) r from e group by all),
ch as (select x.model, x.dataset, x.condition, round(x.r - y.r, 6) ch from k x join k y on x.model = y.model and x.dataset = y.dataset and y.condition = 'original' and x.condition <> 'original')
select model, dataset, condition, concat_ws('; ', case when i > 0.10 then 'interface' end, case when t > 0.05 then 'inefficiency' end, case when a > 0.10 then 'algorithm' end, case when abs(ch) < 0.05 then 'robust' end) diagnosis from s left join ch using (model, dataset, condition)""",
    "q38_expected_match": f"""with s as (select generation_id, lower({_STRIP.format("coalesce(generated_solution, '')")}) g, lower({_STRIP.format("coalesce(solution_code, '')")}) w from generations left join bigobench on solution_no = row_index where dataset = 'bigobench')
select generation_id, case when w = '' then 0.0 else round(coalesce(list_min(list_filter(range(1, least(length(g), length(w)) + 1), lambda i: substr(g, i, 1) <> substr(w, i, 1))) - 1, least(length(g), length(w))) / length(w), 6) end score from s""",
    "q39_code": "select generation_id, md5(coalesce(nullif(generated_solution, ''), nullif(generated_solution_clean, ''), code, '')) code_md5 from generations",
    "q47_only_rewritten": "select dataset, iso_family, count(*) \"rows\" from generations where iso_applied group by 1, 2",
    "q25_pending_tasks": """with t as (select id problem_id, cast(i as integer) completion_index from effibench cross join range(5) r(i)),
done as (select distinct problem_id, coalesce(completion_index, 0) completion_index from generations where dataset = 'effibench' and error_message is null)
select completion_index, count(*) pending from t where not exists (select 1 from done where done.problem_id = t.problem_id and done.completion_index = t.completion_index) group by 1""",
    "q26_passed_generations": f"""with {_runs_sql()} select generation_id, dataset, model from generations g where exists (select 1 from runs r where r.pass and r.dataset = g.dataset and r.model = g.model and r.source_file = g.source_file and r.row_index = g.row_index and r.attempt = coalesce(g.completion_index, 0))""",
    "q27_lookup": "select g.dataset, e._split, count(*) generations, sum(length(e.prompt)) prompt_chars from generations g left join effibench e on g.problem_id = e.id group by 1, 2",
    "q29_rollup": "select dataset, model, count(*) \"rows\", count(error_message) errors, sum(case when iso_applied then 1 else 0 end) iso_applied from generations group by rollup (dataset, model)",
    "q34_code_fence": f"select generation_id, coalesce({_STRIP.format(_FENCE_SQL)}, '') code from generations",
    "q36_setops": """with g as (select distinct dataset, problem_id from generations where problem_id is not null), u as (select distinct dataset, problem_id from unittest_results where problem_id is not null)
select dataset, count(*) problems, 'both' kind from (select * from g intersect select * from u) x group by 1 union all select dataset, count(*), 'generated_only' from (select * from g except select * from u) x group by 1
union all select dataset, count(*), 'tested_only' from (select * from u except select * from g) x group by 1 union all select dataset, count(*), 'either' from (select * from g union select * from u) x group by 1""",
    "q38_match_score": f"""with s as (select generation_id, lower({_STRIP.format("coalesce(generated_solution, '')")}) g, lower({_STRIP.format("coalesce(generated_solution_clean, '')")}) w from generations)
select generation_id, case when w = '' then 0.0 else round(coalesce(list_min(list_filter(range(1, least(length(g), length(w)) + 1), lambda i: substr(g, i, 1) <> substr(w, i, 1))) - 1, least(length(g), length(w))) / length(w), 6) end score from s""",
    "q41_window_rates": "select time_bucket(interval 1 hour, received_at) window_start, time_bucket(interval 1 hour, received_at) + interval 1 hour window_end, dataset, count(*) results, round(avg(case when pass then 1.0 else 0.0 end), 6) pass_rate from unittest_results where received_at is not null group by all",
    "q45_retryable": f"select model, count(error_message) errors, sum(case when {_RETRY} then 1 else 0 end) retryable from generations group by 1",
    "q48_variants": "select dataset, case when iso_applied then coalesce(iso_variant, 'iso') end variant, count(*) \"rows\", sum(case when iso_params['a'] is not null then 1 else 0 end) with_a from generations group by 1, 2",
    "q49_names": "select regexp_replace(concat_ws('/', model, source_file), '[^0-9A-Za-z_\\-.]', '_', 'g') file, model display, count(*) \"rows\" from generations group by 1, 2",
}
