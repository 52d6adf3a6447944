"""Text functions as Column expressions: chunks, cleaning, heuristics, alignment, fuzzing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = "[ \\t\\n\\r\\f\\u000b]"


def strip(text: Column) -> Column:
    """A text without ASCII white space at its ends."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def normalise_space(text: Column) -> Column:
    """Runs of white space as one space, none at the ends; null as empty."""
    return F.regexp_replace(strip(F.coalesce(text, F.lit(""))), f"{BLANK}+", " ")


def strip_html(text: Column) -> Column:
    """A text with tags replaced by spaces and white space collapsed."""
    return normalise_space(F.regexp_replace(text, "<[^>]+>", " "))


def char_chunks(text: Column, size: int = 600, least: int = 300) -> Column:
    """Pieces of ``size`` characters, stripped; those left with fewer than ``least`` are dropped."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    return F.filter(F.transform(starts, lambda i: strip(F.substring(text, i + 1, F.lit(size)))), lambda c: F.length(c) >= least)


def word_chunks(text: Column, words: int = 100) -> Column:
    """Runs of ``words`` words joined by one space; a last run of fewer is dropped."""
    found = F.filter(F.split(text, f"{BLANK}+", -1), lambda w: w != "")
    full = F.floor(F.size(found) / words).cast("int")
    return F.when(full > 0, F.transform(F.sequence(F.lit(0), full - 1), lambda i: F.array_join(F.slice(found, i * words + 1, F.lit(words)), " "))).otherwise(F.array().cast("array<string>"))


#: Words and marks of prompt-like text.
PROMPT_WORDS = ("input", "output", "return", "given", "find", "write", "function", "array", "string")
SENTENCE_MARKS = (". ", "? ", "! ", "\n\n")


def _any(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def is_natural_language(text: Column, least: int = 100) -> Column:
    """Long enough, and with a sentence mark or two prompt words."""
    low = F.lower(text)
    marks = _any([F.contains(text, F.lit(m)) for m in SENTENCE_MARKS])
    count = sum((F.contains(low, F.lit(w)).cast("int") for w in PROMPT_WORDS), F.lit(0))
    return (F.length(text) >= least) & (marks | (count >= 2))


#: Parts of names of test fields.
TEST_WORDS = ("test", "input", "output", "case", "example", "sample")


def test_field_reasons(name: Column, value: Column) -> Column:
    """Why a field looks like test data, joined by semicolons; empty if it doesn't."""
    parsed = F.try_parse_json(value)
    in_list = F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, "$[0]", "variant")).rlike(r"^OBJECT<(.*, )?(input|output): "), F.lit(False))
    return F.concat_ws(
        "; ",
        F.when(F.lower(name).rlike("|".join(TEST_WORDS)), "key contains test-related word"),
        F.when(F.contains(value, F.lit("assert")), "contains 'assert'"),
        F.when(value.rlike(r'"input":\s*"|"output":\s*"'), "contains input/output JSON pattern"),
        F.when(in_list, "JSON list with input/output dicts"),
    )


def match_score(generated: Column, expected: Column) -> Column:
    """Length of the common prefix, case and outer space aside, as a share of what was expected."""
    got, want = F.lower(strip(F.coalesce(generated, F.lit("")))), F.lower(strip(F.coalesce(expected, F.lit(""))))
    shorter = F.least(F.length(got), F.length(want))
    same = F.zip_with(F.split(got, ""), F.split(want, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    common = F.least(F.when(first > 0, first - 1).otherwise(shorter), shorter)
    return F.when((F.length(want) == 0) | (F.length(got) == 0), 0.0).otherwise(common / F.length(want))


def _solid(text: Column) -> Column:
    return F.length(F.regexp_replace(text, BLANK, ""))


def suffix_start(tokens: Column, suffix: Column) -> Column:
    """The last place (from 0) from which the tokens, joined and normalised, end with the normalised suffix; else 0.

    Where the whole text ends so, a tail does as long as it holds as many characters other than blanks as the suffix: one pass.
    """
    whole, want = F.array_join(tokens, ""), normalise_space(suffix)
    least = _solid(whole) - _solid(want)
    start = F.struct(F.lit(0).alias("before"), F.lit(0).alias("place"), F.lit(0).alias("last"))
    found = F.aggregate(tokens, start, lambda a, t: F.struct((a["before"] + _solid(t)).alias("before"), (a["place"] + 1).alias("place"), F.when(a["before"] <= least, a["place"]).otherwise(a["last"]).alias("last")))
    return F.when((F.size(tokens) == 0) | (F.length(want) == 0) | ~normalise_space(whole).endswith(want), 0).otherwise(found["last"])


def char_suffix_start(tokens: Column, suffix: Column) -> Column:
    """The token that holds the first character of the last occurrence of ``suffix``, spaces left out; else 0. One pass."""
    bare = F.transform(tokens, lambda t: F.replace(t, F.lit(" "), F.lit("")))
    full, want = F.array_join(bare, ""), F.replace(strip(suffix), F.lit(" "), F.lit(""))
    at = F.length(full) - F.instr(F.reverse(full), F.reverse(want)) - F.length(want) + 1
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("before"))
    found = F.aggregate(bare, start, lambda a, t: F.struct((a["end"] + F.length(t)).alias("end"), (a["before"] + F.when(a["end"] + F.length(t) <= at, 1).otherwise(0)).alias("before")))
    return F.when((F.size(tokens) == 0) | ~F.contains(full, want) | (found["before"] == F.size(tokens)), 0).otherwise(found["before"])


def subsequence_start(tokens: Column, wanted: Column) -> Column:
    """One before the first place where ``wanted`` stands in ``tokens``, 0 at least; null if nowhere."""
    last = F.size(tokens) - F.size(wanted)
    hits = F.filter(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")), lambda i: F.slice(tokens, i + 1, F.size(wanted)) == wanted)
    return F.greatest(F.get(hits, F.lit(0)) - 1, F.lit(0)) * F.when(F.size(hits) > 0, 1)


def display_name(model: Column) -> Column:
    """The last part of a model path, without a provider prefix."""
    return F.element_at(F.split(F.regexp_replace(model, "^[a-z_]+:", ""), "/"), -1)


def file_name(text: Column) -> Column:
    """A text as a file name: letters, digits, underscores, hyphens and points, all else an underscore."""
    return F.regexp_replace(text, r"[^0-9A-Za-z_\-.]", "_")


def context_text(parts: Column, target: Column) -> Column:
    """Context texts and the target, a blank line between each."""
    return F.array_join(F.concat(F.transform(parts, strip), F.array(target)), "\n\n")


# ---- fuzzing

#: Marks that make a token code.
CODE_MARKS = ("`", "\\", "$", "@", "#", "_", "==", "!=", ">=", "<=", ">>", "<<", "&&", "||", "->", "::", "//")
#: English words that are never replaced.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
#: A small thesaurus for tests and demonstrations; pass your own table for real use.
THESAURUS = {"returns": ["yields", "gives back"], "largest": ["biggest", "greatest"], "oldest": ["eldest"], "keeps": ["holds", "retains"], "empty": ["vacant", "void"], "removes": ["deletes", "takes away"], "busy": ["occupied"], "early": ["premature"], "broken": ["damaged"], "closed": ["shut"], "grows": ["increases"], "missing": ["absent"]}


def is_code_token(token: Column) -> Column:
    """Whether a token looks like code: marks, number prefixes, camel case."""
    return _any([F.contains(token, F.lit(m)) for m in CODE_MARKS]) | token.rlike("^0[xb]") | token.rlike("^[A-Z][a-z]+[A-Z]") | token.rlike("^[a-z]+[A-Z]")


def is_eligible(token: Column) -> Column:
    """Whether a token may be replaced by a synonym."""
    return (F.length(token) > 2) & ~F.lower(token).isin(*STOP_WORDS) & token.rlike("^[A-Za-z]+$") & ~is_code_token(token)


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on ``parts`` only: the same on every engine and every run."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def detokenise(text: Column) -> Column:
    """Text from tokens joined by spaces: none before closing or after opening marks, runs collapsed."""
    out = F.regexp_replace(text, r"\s+([.,;:!?)\]}])", "$1")
    out = F.regexp_replace(out, r"([(\[{])\s+", "$1")
    out = F.regexp_replace(F.regexp_replace(out, "` +", "`"), " +`", "`")
    return strip(F.regexp_replace(out, r"\s{2,}", " "))


TOKEN = r"[A-Za-z0-9_']+|[^\sA-Za-z0-9_']"


#: Most words of a thesaurus that goes into the plan as a literal map; a larger one is joined.
MAP_WORDS = 1000


def _drawn(place: Column, row: Column, seed: int) -> Column:
    return uniform(F.lit(str(seed)), row.cast("string"), place.cast("string"))


def _replacement(token: Column, synonyms: Column, place: Column, row: Column, seed: int) -> Column:
    """The synonym drawn for a token at a place, with a capital where the token has one; null without synonyms."""
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), row.cast("string"), place.cast("string"), F.lit("s"))), 1, 6), 16, 10).cast("int")
    pick = F.get(synonyms, F.pmod(number, F.size(synonyms)))
    shown = F.when(token.rlike("^[A-Z]"), F.concat(F.upper(F.substring(pick, 1, 1)), F.substring(pick, F.lit(2), F.length(pick)))).otherwise(pick)
    return F.when(F.size(synonyms) > 0, shown)


def fuzz_synonyms(df: DataFrame, text: str, row_id: str, level: float, seed: int, thesaurus: DataFrame) -> DataFrame:
    """``df`` with ``fuzzed`` and ``n_replaced``: each eligible token is replaced with probability ``level``.

    ``thesaurus`` has the columns word (lower case) and synonyms (array). The choice hangs on seed, row and place. A thesaurus of
    up to ``MAP_WORDS`` words is a literal of the plan, and texts are rewritten where they are; with a larger one the drawn
    tokens are joined to it, frequent words salted, and go back to their text. Null texts stay null with no replacement.
    """
    known = thesaurus.select("word", "synonyms").limit(MAP_WORDS + 1).collect()
    row = F.col(row_id)
    tokens = F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0))
    if len(known) > MAP_WORDS:
        return _fuzz_by_join(df, text, row_id, level, seed, thesaurus, tokens)
    table = F.create_map(*(x for r in known for x in (F.lit(r["word"]), F.array(*map(F.lit, r["synonyms"])).cast("array<string>")))).cast("map<string,array<string>>")

    def one(token: Column, place: Column) -> Column:
        synonyms = F.when(F.lower(token).isin(*(r["word"] for r in known)) & is_eligible(token), F.try_element_at(table, F.lower(token)))
        new = F.when(synonyms.isNotNull(), F.when(_drawn(place, row, seed) < level, _replacement(token, synonyms, place, row, seed)))
        return F.struct(F.coalesce(new, token).alias("t"), new.isNotNull().cast("int").alias("n"))

    out = df.withColumn("__new", F.transform(tokens, one))
    fuzzed = F.when(F.col(text).isNotNull(), detokenise(F.array_join(F.transform("__new", lambda x: x["t"]), " ")))
    count = F.coalesce(F.aggregate("__new", F.lit(0), lambda a, x: a + x["n"]), F.lit(0))
    return out.withColumn("fuzzed", fuzzed).withColumn("n_replaced", count).drop("__new")


def _fuzz_by_join(df: DataFrame, text: str, row_id: str, level: float, seed: int, thesaurus: DataFrame, tokens: Column) -> DataFrame:
    from evalweave.operators.skew import salted_join

    rows = df.select(F.col(row_id).alias("__row"), F.posexplode(tokens).alias("__place", "__token"))
    drawn = is_eligible(F.col("__token")) & (_drawn(F.col("__place"), F.col("__row"), seed) < level)
    rows = rows.withColumn("__word", F.when(drawn, F.lower("__token")))
    joined = salted_join(rows, thesaurus.select(F.col("word").alias("__word"), F.col("synonyms").alias("__synonyms")), "__word", "left")
    joined = joined.withColumn("__new", _replacement(F.col("__token"), F.col("__synonyms"), F.col("__place"), F.col("__row"), seed))
    texts = joined.groupBy("__row").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__place", F.coalesce("__new", "__token").alias("t")))), lambda x: x["t"]), " ").alias("__text"), F.count("__new").cast("int").alias("n_replaced")
    )
    out = df.join(texts, F.col(row_id) == F.col("__row"), "left").drop("__row")
    return out.withColumn("fuzzed", F.when(F.col(text).isNotNull(), detokenise(F.coalesce("__text", F.lit(""))))).withColumn("n_replaced", F.coalesce("n_replaced", F.lit(0))).drop("__text")


def fuzz_totals(fuzzed: DataFrame, by: list[str] | tuple[str, ...]) -> DataFrame:
    """Per ``by``, and in total (null): rows, replacements, and replacements a row."""
    return fuzzed.rollup(*by).agg(F.count("*").alias("rows"), F.sum("n_replaced").alias("replacements"), F.round(F.avg("n_replaced"), 6).alias("mean_replacements"))


#: Blocks of dead code, and the line that introduces them.
DEAD_CODE = (
    "# [debug] temporary variable for edge-case logging\n_dbg_sentinel = None",
    'if False:\n    _unreachable = 42\n    print("this never runs")',
    'def _temp_helper_unused():\n    """Placeholder -- not called."""\n    return []',
    "_MAGIC_OFFSET = 0xDEAD  # legacy constant, safe to ignore",
    "for _i in range(0):\n    pass  # no-op loop",
    "# NOTE: retained for backward compatibility\ntry:\n    _ = None\nexcept Exception:\n    pass",
    "_chk = lambda *a, **k: None  # no-op checker stub",
    "# TODO(reviewer): verify this block is dead code\nclass _Unused:\n    pass",
    "import sys as _sys_unused  # unused import kept for compat",
    "_PADDING = [0] * 16  # pre-allocated buffer (unused)",
)
DEAD_CODE_BANNER = "\n\n# ----- [context: supporting code / utilities] -----\n# The following helper code may or may not be relevant.\n\n"


def insert_dead_code(text: Column, row_id: Column, blocks: int, seed: int) -> Column:
    """A text followed by ``blocks`` of the dead-code blocks, drawn without repetition by the hash of seed and row."""
    order = F.array_sort(F.array(*(F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), row_id.cast("string"), F.lit(str(k)))).alias("h"), F.lit(b).alias("b")) for k, b in enumerate(DEAD_CODE))))
    return F.concat(text, F.lit(DEAD_CODE_BANNER), F.array_join(F.transform(F.slice(order, 1, min(blocks, len(DEAD_CODE))), lambda x: x["b"]), "\n\n"))
