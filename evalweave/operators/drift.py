"""Schemas that drift between files: one consistent table, and a list of all changes.

Lines are parsed to VARIANT in the JVM, once. What is aggregated is schema, not data: for each file the fields that any of its
lines holds (map-side combined). From there on everything goes by the fingerprint of a file's schema:

* ``schemas``: the fingerprint of each file; files of one schema share it, so there are far fewer schemas than files;
* ``changes``: what differs between the fingerprints of neighbouring files, worked out once for each pair of fingerprints and
  recorded for every file that makes this step;
* ``versions``: fingerprints numbered within their run;
* ``steps``: explicit migration steps from each fingerprint to the target schema: rename, cast, default, drop. Renamings seen
  anywhere are chained to one name, unless two of the names stand side by side in some file;
* ``unified``: every line routed through the steps of its file's fingerprint, as one table.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalweave.operators.skew import salted_join
from evalweave.session import materialize, table

#: Objects whose own fields count as fields, named with a dot.
NESTED = ("harness", "generation_metadata")
FILE = ("run_id", "record_kind", "file_no")


def fields(raw: DataFrame, text: str = "raw", file: tuple[str, ...] = FILE, nested: tuple[str, ...] = NESTED) -> DataFrame:
    """One row per field of a file: ``file``, field_name, parent, json_type (of the types seen, joined with |).

    A file has a field if any of its lines holds a non-null value of it. Lines that are null or no JSON object (broken
    ones, and those that name a key twice) are skipped.
    """
    parsed = raw.select(*file, F.try_parse_json(text).alias("v"))
    top = _explode(parsed.where(F.schema_of_variant("v").startswith("OBJECT")), "v", "key", "value").where("key is not null")
    opened = F.col("key").isin(*nested) & F.schema_of_variant("value").startswith("OBJECT")
    both = _explode(top.select(*file, "key", "value", F.when(opened, F.col("value")).alias("object")), "object", "inner_key", "inner_value")
    both = both.where(F.col("object").isNull() | F.col("inner_key").isNotNull())
    named = both.select(
        *file, F.when(F.col("object").isNotNull(), F.col("key")).otherwise("").alias("parent"), F.concat_ws(".", "key", "inner_key").alias("field_name"),
        json_type(F.when(F.col("object").isNull(), F.schema_of_variant("value")).otherwise(F.schema_of_variant("inner_value"))).alias("json_type"),
    ).where("json_type is not null")
    distinct = named.groupBy(*file, "parent", "field_name", "json_type").agg(F.count("*").alias("lines"))
    return distinct.groupBy(*file, "parent", "field_name").agg(F.array_join(F.sort_array(F.collect_set("json_type")), "|").alias("json_type"), F.sum("lines").alias("lines"))


def _explode(df: DataFrame, variant: str, key: str, value: str) -> DataFrame:
    """``df`` with a row for each field of a variant; one row with a null key where the variant is null or empty."""
    inner = df.sparkSession.tvf.variant_explode_outer(F.col(variant).outer()).select(F.col("key").alias(key), F.col("value").alias(value))
    return df.lateralJoin(inner)


def json_type(schema: Column) -> Column:
    """JSON type of a VARIANT schema string; null for JSON null."""
    head = F.regexp_extract(schema, "^[A-Z]+", 0)
    return (
        F.when(head == "VOID", None)
        .when(head.isin("STRING", "BOOLEAN", "OBJECT", "ARRAY"), F.lower(head))
        .otherwise("number")
    )


SCHEMA = "array<struct<field_name:string,parent:string,json_type:string>>"


def schemas(found: DataFrame, files: DataFrame, file: tuple[str, ...] = FILE) -> DataFrame:
    """``file``, fingerprint, schema for each file of ``files``, which has a row for each line or file, so that files without
    any field count too: they have the fingerprint of the empty schema."""
    entry = F.struct("field_name", "parent", "json_type").alias("entry")
    rows = found.select(*file, entry).unionByName(files.select(*file).distinct().withColumn("entry", F.lit(None).cast("struct<field_name:string,parent:string,json_type:string>")))
    held = rows.groupBy(*file).agg(F.sort_array(F.collect_list("entry")).alias("schema"))
    return held.select(*file, fingerprint(F.col("schema")).alias("fingerprint"), "schema")


def fingerprint(schema: Column) -> Column:
    """Hash of a sorted schema."""
    return F.sha2(F.to_json(schema), 256)


def registry(routed: DataFrame) -> DataFrame:
    """The distinct schemas by fingerprint."""
    return routed.groupBy("fingerprint").agg(F.any_value("schema").alias("schema"))


def differences(before: Column, after: Column) -> Column:
    """The changes between two schemas as an array of (change_kind, field_name, new_name).

    One field gone and one come with the same type and parent are a renaming; if there are more of either the pairing is
    open and they stay removed and added.
    """

    def names(schema: Column) -> Column:
        return F.transform(schema, lambda x: x["field_name"])

    def alike(schema: Column, x: Column) -> Column:
        return F.filter(schema, lambda y: (y["parent"] == x["parent"]) & (y["json_type"] == x["json_type"]))

    def entry(kind: str, old: Column, new: Column) -> Column:
        return F.struct(F.lit(kind).alias("change_kind"), old.alias("field_name"), new.alias("new_name"))

    gone = F.filter(before, lambda x: ~F.array_contains(names(after), x["field_name"]))
    come = F.filter(after, lambda x: ~F.array_contains(names(before), x["field_name"]))
    retyped = F.filter(after, lambda x: F.exists(before, lambda y: (y["field_name"] == x["field_name"]) & (y["json_type"] != x["json_type"])))

    def paired(x: Column) -> Column:
        return (F.size(alike(gone, x)) == 1) & (F.size(alike(come, x)) == 1)

    return F.concat(
        F.transform(retyped, lambda x: entry("type_changed", x["field_name"], x["field_name"])),
        F.transform(gone, lambda x: F.when(paired(x), entry("renamed", x["field_name"], alike(come, x)[0]["field_name"])).otherwise(entry("removed", x["field_name"], x["field_name"]))),
        F.transform(F.filter(come, lambda x: ~paired(x)), lambda x: entry("added", x["field_name"], x["field_name"])),
    )


def changes(routed: DataFrame, file: tuple[str, ...] = FILE) -> DataFrame:
    """Changes from each file to the next of its run: ``file``, change_kind, field_name, new_name.

    ``routed`` is the result of ``schemas``. Where file_no - 1 is no file there is nothing to compare. Null runs and kinds
    are values; a null file number has no place in the order and no changes. The changes between two fingerprints are worked
    out once, however many files make the step.
    """
    *run, number = file
    numbered = routed.where(F.col(number).isNotNull())
    now = numbered.select(F.struct(*run, F.col(number).cast("long").alias(number)).alias("at"), F.col("fingerprint").alias("after"))
    last = numbered.select(F.struct(*run, (F.col(number).cast("long") + 1).alias(number)).alias("at"), F.col("fingerprint").alias("before"))
    moves = materialize(now.join(last, "at").where("before <> after"))
    known = materialize(registry(routed))
    pairs = moves.select("before", "after").distinct()
    pairs = pairs.join(known.select(F.col("fingerprint").alias("before"), F.col("schema").alias("old")), "before").join(known.select(F.col("fingerprint").alias("after"), F.col("schema").alias("new")), "after")
    listed = pairs.select("before", "after", differences(F.col("old"), F.col("new")).alias("changes"))
    found = moves.join(listed, ["before", "after"]).select("at", F.inline("changes"))
    return found.select(*(F.col(f"at.{c}").alias(c) for c in run), F.col(f"at.{number}").cast("int").alias(number), "change_kind", "field_name", "new_name")


def versions(routed: DataFrame, file: tuple[str, ...] = FILE) -> DataFrame:
    """``file``, fingerprint, version, n_fields: the number of the schema within its run, rising with every file that differs.
    Files without fields have no version."""
    *run, number = file
    order = Window.partitionBy(*run).orderBy(number)
    prints = routed.where(F.size("schema") > 0)
    fresh = F.when(F.lag("fingerprint").over(order).eqNullSafe(F.col("fingerprint")), 0).otherwise(1)
    return prints.withColumn("fresh", fresh).select(*file, "fingerprint", F.sum("fresh").over(order).cast("int").alias("version"), F.size("schema").cast("long").alias("n_fields"))


@dataclass(frozen=True)
class Rule:
    """How a target field is read: its name, type, aliases in order of preference, and the value for lines without it."""

    name: str
    kind: str
    aliases: tuple[str, ...] = field(default=())
    default: object = None


def chained(change_list: DataFrame, found: DataFrame, targets: tuple[Rule, ...], file: tuple[str, ...] = FILE) -> tuple[Rule, ...]:
    """``targets`` with the aliases that the observed renamings lead to.

    Distinct renamings (old, new) are followed both ways. A renaming of two names that some file holds side by side is no
    evidence that they are one field and is left out, as is one that would join two target fields. Only renamings that lead
    to a target come to the driver: as many as the targets have aliases, found ring by ring from the targets.
    """
    edges = change_list.where("change_kind = 'renamed'").groupBy("field_name", "new_name").agg(F.count("*").alias("times"))
    left = found.select(*file, F.col("field_name"))
    right = found.select(*(F.col(c).alias(f"r_{c}") for c in file), F.col("field_name").alias("new_name"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in file])
    pairs = edges.select("field_name", "new_name")
    together = left.join(pairs, "field_name").join(right.withColumnRenamed("new_name", "other"), same & (F.col("new_name") == F.col("other"))).select("field_name", "new_name").distinct()
    usable = materialize(edges.join(together, ["field_name", "new_name"], "left_anti"))
    owner = {alias: rule.name for rule in targets for alias in (rule.name, *rule.aliases)}
    group = {r.name: [r.name, *r.aliases] for r in targets}
    fresh = set(owner)
    while fresh:
        near = usable.where(F.col("field_name").isin(*fresh) | F.col("new_name").isin(*fresh)).orderBy(F.desc("times"), F.desc("field_name"), F.desc("new_name")).collect()
        found_now = []
        for r in near:
            for known, other in ((r["field_name"], r["new_name"]), (r["new_name"], r["field_name"])):
                if known in fresh and other not in owner:
                    owner[other] = owner[known]
                    group[owner[known]].append(other)
                    found_now.append(other)
        fresh = set(found_now)
    return tuple(Rule(r.name, r.kind, tuple(group[r.name][1:]), r.default) for r in targets)


_JSON = {"string": "string", "boolean": "boolean"}


def sources(schema: Column, rules: tuple[Rule, ...]) -> Column:
    """For each rule the field that a schema has for it, its own name first, then its aliases in order; null if none."""
    names = F.transform(schema, lambda x: x["field_name"])

    def one(rule: Rule) -> Column:
        return F.get(F.filter(F.array(*map(F.lit, (rule.name, *rule.aliases))), lambda a: F.array_contains(names, a)), F.lit(0))

    return F.array(*(one(r) for r in rules))


def steps(known: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """fingerprint, sources, steps: what brings each schema of ``registry`` to the target schema, as (step, field_name, target).

    For each target field the first alias that the schema has is renamed (rename), and cast where its JSON type is another
    one (cast); a field that the schema lacks is set to its default (default, field_name null). Fields that lead to no target
    are dropped (drop, target null).
    """

    def step(kind: str, name: Column, target: Column) -> Column:
        return F.struct(F.lit(kind).alias("step"), name.alias("field_name"), target.alias("target"))

    def type_of(name: Column) -> Column:
        return F.get(F.transform(F.filter("schema", lambda x: x["field_name"] == name), lambda x: x["json_type"]), F.lit(0))

    parts = []
    for k, r in enumerate(rules):
        taken, target = F.col("sources")[k], F.lit(r.name)
        kind = type_of(taken)
        parts += [F.when(taken != target, step("rename", taken, target)), F.when(kind != _JSON.get(r.kind, "number"), step("cast", taken, target)), F.when(taken.isNull(), step("default", F.lit(None).cast("string"), target))]
    dropped = F.transform(F.filter("schema", lambda x: ~F.coalesce(F.array_contains(F.array_compact("sources"), x["field_name"]), F.lit(False))), lambda x: step("drop", x["field_name"], F.lit(None).cast("string")))
    return known.withColumn("sources", sources(F.col("schema"), rules)).select("fingerprint", "sources", F.concat(F.array_compact(F.array(*parts)), dropped).alias("steps"))


def migration(routed: DataFrame, rules: tuple[Rule, ...], file: tuple[str, ...] = FILE) -> DataFrame:
    """The steps of each file: ``file``, step, field_name, target. Files without fields have none."""
    known = registry(routed.where(F.size("schema") > 0))
    return routed.select(*file, "fingerprint").join(steps(known, rules), "fingerprint").select(*file, F.inline("steps"))


def read_field(variant: Column, rule: Rule, source: Column) -> Column:
    """One target field of a parsed line: read from ``source``, cast, and set to the default where there is no value."""

    def value(alias: str) -> Column:
        path = "$" + "".join(f"['{part}']" for part in (alias.split(".", 1) if alias.split(".")[0] in NESTED else [alias]))
        text = F.try_variant_get(variant, path, "string")
        kind = F.schema_of_variant(F.try_variant_get(variant, path, "variant"))
        lines = F.when(kind.startswith("ARRAY"), F.array_join(F.try_variant_get(variant, path, "array<string>"), "\n"))
        inside = F.when(kind.startswith("OBJECT"), F.element_at(F.map_values(F.try_variant_get(variant, path, "map<string,string>")), 1))
        return F.coalesce(inside, lines, text) if rule.kind == "string" else text

    text = F.lit(None).cast("string")
    for alias in reversed((rule.name, *rule.aliases)):
        text = F.when(source == alias, value(alias)).otherwise(text)
    if rule.kind == "boolean":
        out = F.when(F.lower(text).isin("true", "1"), True).when(F.lower(text).isin("false", "0"), False)
    else:
        out = text if rule.kind == "string" else text.try_cast(rule.kind)
    return (out if rule.default is None else F.coalesce(out, F.lit(rule.default).cast(rule.kind))).alias(rule.name.replace(".", "_"))


def unified(raw: DataFrame, routed: DataFrame, rules: tuple[Rule, ...], keep: tuple[str, ...], text: str = "raw", file: tuple[str, ...] = FILE) -> DataFrame:
    """Every line as a row of the target schema: ``keep``, parsed, the fields of ``rules``.

    A line takes the steps of its file's fingerprint: only the field that these name is read. Lines that are no JSON object
    stay, with parsed false and only defaults. Values that a cast cannot take are null. Large files are salted.
    """
    route = routed.select(F.struct(*file).alias("__file"), "fingerprint").join(steps(registry(routed), rules).select("fingerprint", "sources"), "fingerprint")
    columns = list(dict.fromkeys([*keep, *file, text]))
    rows = salted_join(raw.select(*columns).withColumn("__file", F.struct(*file)), materialize(route.select("__file", "sources")), "__file", "left", counted=raw.select(F.struct(*file).alias("__file")))
    rows = rows.select(*keep, F.try_parse_json(text).alias("v"), "sources")
    parsed = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    return rows.select(*keep, parsed.alias("parsed"), *(read_field(F.col("v"), r, F.col("sources")[k]) for k, r in enumerate(rules)))


#: The target schema of result files.
TARGETS = (
    Rule("dataset", "string"), Rule("model", "string"), Rule("problem_id", "string"), Rule("row_index", "bigint"), Rule("completion_index", "int", default=0),
    Rule("status", "string"), Rule("passed", "boolean", ("pass",)), Rule("error", "string"), Rule("time_s", "double"), Rule("timeout", "boolean"),
    Rule("code", "string", ("generated_solution",)), Rule("temperature", "double"), Rule("finish_reason", "string"), Rule("latency_s", "double"),
    Rule("prompt_hash", "string"), Rule("is_original", "boolean"), Rule("iso_family", "string"), Rule("iso_seed", "bigint"),
    Rule("harness.version", "string"), Rule("harness.workers", "bigint"), Rule("generation_metadata.tokens_out", "bigint"), Rule("generation_metadata.seed", "string"),
)


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_records")


def _routed(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    found = materialize(fields(raw))
    return found, materialize(schemas(found, raw))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All schema changes between consecutive files of a run and kind."""
    return changes(_routed(_raw(spark, sf_dir))[1])


def p7_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version of each file's schema within its run and kind, and the number of its fields."""
    return versions(_routed(_raw(spark, sf_dir))[1]).select(*FILE, "version", "n_fields")


def p7_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps that bring each file of results to the target schema."""
    found, routed = _routed(_raw(spark, sf_dir))
    return migration(routed, chained(changes(routed), found, TARGETS))


def p7_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of result files as one consistent table."""
    raw = _raw(spark, sf_dir)
    found, routed = _routed(raw)
    return unified(raw, routed, chained(changes(routed), found, TARGETS), ("raw_id", *FILE, "line_no"))


_FIELDS_SQL = """ok as (select run_id, record_kind, file_no, raw from raw_records where raw is not null and json_valid(raw) and json_type(raw) = 'OBJECT'),
top as (select run_id, record_kind, file_no, '' parent, k.key field_name, k.value v, k.type t from ok, json_each(ok.raw) k),
inn as (select top.run_id, top.record_kind, top.file_no, top.field_name parent, top.field_name || '.' || k.key field_name, k.type t from top, json_each(top.v) k where top.field_name in ('harness', 'generation_metadata') and top.t = 'OBJECT'),
typed as (select run_id, record_kind, file_no, parent, field_name, case t when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object' when 'ARRAY' then 'array' else 'number' end ty
  from (select run_id, record_kind, file_no, parent, field_name, t from top where not (field_name in ('harness', 'generation_metadata') and t = 'OBJECT') union all select * from inn) x where t <> 'NULL'),
found as (select run_id, record_kind, file_no, parent, field_name, string_agg(distinct ty, '|' order by ty) ty from typed group by all)"""

_CHANGES_SQL = f"""with {_FIELDS_SQL},
files as (select distinct run_id, record_kind, file_no from raw_records where file_no is not null),
steps as (select a.* from files a join files b on a.run_id is not distinct from b.run_id and a.record_kind is not distinct from b.record_kind and a.file_no = b.file_no + 1),
cur as (select found.* from found join steps s on found.run_id is not distinct from s.run_id and found.record_kind is not distinct from s.record_kind and found.file_no = s.file_no),
prev as (select found.run_id, found.record_kind, found.file_no + 1 file_no, parent, field_name, ty from found join steps s on found.run_id is not distinct from s.run_id and found.record_kind is not distinct from s.record_kind and found.file_no + 1 = s.file_no),
come as (select cur.* from cur anti join prev on cur.run_id is not distinct from prev.run_id and cur.record_kind is not distinct from prev.record_kind and cur.file_no = prev.file_no and cur.field_name = prev.field_name),
gone as (select prev.* from prev anti join cur on cur.run_id is not distinct from prev.run_id and cur.record_kind is not distinct from prev.record_kind and cur.file_no = prev.file_no and cur.field_name = prev.field_name),
c1 as (select *, count(*) over (partition by run_id, record_kind, file_no, parent, ty) n from come),
g1 as (select *, count(*) over (partition by run_id, record_kind, file_no, parent, ty) n from gone),
ren as (select g1.run_id, g1.record_kind, g1.file_no, g1.field_name, c1.field_name new_name from g1 join c1 on g1.run_id is not distinct from c1.run_id and g1.record_kind is not distinct from c1.record_kind and g1.file_no = c1.file_no and g1.parent = c1.parent and g1.ty = c1.ty and g1.n = 1 and c1.n = 1)
select run_id, record_kind, cast(file_no as integer) file_no, change_kind, field_name, new_name from (
select run_id, record_kind, file_no, 'renamed' change_kind, field_name, new_name from ren
union all select cur.run_id, cur.record_kind, cur.file_no, 'type_changed', cur.field_name, cur.field_name from cur join prev on cur.run_id is not distinct from prev.run_id and cur.record_kind is not distinct from prev.record_kind and cur.file_no = prev.file_no and cur.field_name = prev.field_name and cur.ty <> prev.ty
union all select c.run_id, c.record_kind, c.file_no, 'added', c.field_name, c.field_name from come c anti join ren r on c.run_id is not distinct from r.run_id and c.record_kind is not distinct from r.record_kind and c.file_no = r.file_no and c.field_name = r.new_name
union all select g.run_id, g.record_kind, g.file_no, 'removed', g.field_name, g.field_name from gone g anti join ren r on g.run_id is not distinct from r.run_id and g.record_kind is not distinct from r.record_kind and g.file_no = r.file_no and g.field_name = r.field_name) x"""

_VERSIONS_SQL = f"""with {_FIELDS_SQL},
prints as (select run_id, record_kind, file_no, count(*) n_fields, string_agg(field_name || ':' || ty, ',' order by field_name || ':' || ty) f from found group by 1, 2, 3),
marked as (select *, case when lag(f) over (partition by run_id, record_kind order by file_no) is not distinct from f then 0 else 1 end fresh from prints)
select run_id, record_kind, file_no, cast(sum(fresh) over (partition by run_id, record_kind order by file_no) as integer) "version", n_fields from marked"""


def _same(a: str, b: str) -> str:
    return f"{a}.run_id is not distinct from {b}.run_id and {a}.record_kind is not distinct from {b}.record_kind and {a}.file_no is not distinct from {b}.file_no"


_ALIAS_SQL = f"""with recursive {_FIELDS_SQL}, chg as ({_CHANGES_SQL}), rules(target, kind, preferred) as (values {", ".join(f"('{r.name}', '{_JSON.get(r.kind, 'number')}', [{', '.join(repr(a) for a in (r.name, *r.aliases))}])" for r in TARGETS)}),
ren as (select distinct field_name a, new_name b from chg where change_kind = 'renamed'),
apart as (select a, b from ren where not exists (select 1 from found x join found y on {_same("x", "y")} where x.field_name = ren.a and y.field_name = ren.b)),
edges as (select a, b from apart union select b, a from apart),
alias(target, field_name) as (select target, unnest(preferred) from rules union select alias.target, e.b from alias join edges e on e.a = alias.field_name where not exists (select 1 from rules r where list_contains(r.preferred, e.b))),
files as (select distinct run_id, record_kind, file_no from found),
held as (select f.*, a.target, r.kind, row_number() over (partition by f.run_id, f.record_kind, f.file_no, a.target order by coalesce(list_position(r.preferred, f.field_name), 99), f.field_name) k from found f left join alias a on a.field_name = f.field_name left join rules r on r.target = a.target),
taken as (select * from held where target is not null and k = 1)"""

_MIGRATION_SQL = f"""{_ALIAS_SQL}
select run_id, record_kind, file_no, 'rename' step, field_name, target from taken where field_name <> target union all select run_id, record_kind, file_no, 'cast', field_name, target from taken where ty <> kind
union all select run_id, record_kind, file_no, 'drop', field_name, null from held where target is null or k > 1
union all select f.run_id, f.record_kind, f.file_no, 'default', null, r.target from files f cross join rules r where not exists (select 1 from taken t where {_same("t", "f")} and t.target = r.target)"""


def _field_sql(rule: Rule) -> tuple[str, str]:
    name = f"max(case when target = '{rule.name}' then field_name end)"
    path = "'$.' || (case when {0} like 'harness.%' or {0} like 'generation_metadata.%' then {0} else '\"' || {0} || '\"' end)"
    return f"{name} as n_{rule.name.replace('.', '_')}", path.format(f"n_{rule.name.replace('.', '_')}")


def _value_sql(rule: Rule) -> str:
    column = rule.name.replace(".", "_")
    v = f"case when parsed then json_extract(raw, {_field_sql(rule)[1]}) end"
    text = f"case json_type({v}) when 'NULL' then null else json_extract_string({v}, '$') end"
    if rule.kind == "string":
        out = f"case json_type({v}) when 'OBJECT' then json_extract_string({v}, '$.' || json_keys({v})[1]) when 'ARRAY' then array_to_string(json_extract_string({v}, '$[*]'), chr(10)) else {text} end"
    elif rule.kind == "boolean":
        out = f"case when lower({text}) in ('true', '1') then true when lower({text}) in ('false', '0') then false end"
    else:
        out = f"try_cast({text} as {rule.kind})" if rule.kind == "double" else f"case when regexp_full_match({text}, '[+-]?[0-9]+') then try_cast({text} as {rule.kind}) end"
    return f"{out if rule.default is None else f'coalesce({out}, {rule.default})'} as \"{column}\""


_TABLE_SQL = f"""{_ALIAS_SQL}, route as (select run_id, record_kind, file_no, {", ".join(_field_sql(r)[0] for r in TARGETS)} from taken group by 1, 2, 3),
whole as (select raw_id, run_id, record_kind, file_no, line_no, case when json_valid(coalesce(raw, '')) then raw else '[]' end raw from raw_records),
lines as (select r.* replace (case when json_type(raw) = 'OBJECT' then raw else '{{}}' end as raw), t.* exclude (run_id, record_kind, file_no), json_type(raw) = 'OBJECT' parsed from whole r left join route t on {_same("t", "r")})
select raw_id, run_id, record_kind, file_no, line_no, coalesce(parsed, false) parsed, {", ".join(_value_sql(r) for r in TARGETS)} from lines"""

SQL = {"p7_found": _CHANGES_SQL, "p7_versions": _VERSIONS_SQL, "p7_migration": _MIGRATION_SQL, "p7_table": _TABLE_SQL}
QUERIES = {"p7_found": p7_found, "p7_versions": p7_versions, "p7_migration": p7_migration, "p7_table": p7_table}
