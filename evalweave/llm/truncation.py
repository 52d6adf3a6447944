"""Text cut off by field limits: length spikes per source, and endings that are no end.

1. Per source, histograms of the lengths in characters and in bytes (one aggregation, map-side combined). A source has a
   limit where the longest length is far more frequent than lengths just below it.
2. A value at a limit is cut off unless it ends like a complete answer (``ends_complete``): the text equivalent is terminal
   punctuation, for a program it is the last statement of its outermost function, or the call that starts it.
3. Values below any limit may have been cut in transfer. Such a text breaks off inside a token, a bracket or a statement:
   the derivative parser runs to its last line without a failing token, or the mark of a cut stands at the end, or a new
   name stands alone at the end of a body.
   A failing token further up is a fault of a text that may well be complete, so it is no evidence. If it stands before the
   code, in a leading sentence or fence, the code that follows is tested in its place.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm.derivative import parse
from evalweave.session import spread, table

#: A spike holds at least so many values, and so many times the mean of the lengths of the window below it (and one).
SPIKE_ROWS, SPIKE_RATIO, SPIKE_WINDOW = 5, 5.0, 50

#: What systems leave at the place of a cut.
MARK = re.compile(r"(?:…|\.\.\.|\[(?:truncated|cut|snip(?:ped)?)\]|<truncated>|�)+\s*$", re.IGNORECASE)
_CODE_LINE = re.compile(r"^\s*(?:async\s+def\s|def\s+\w+\s*\(|from\s+[\w.]+\s+import\b|import\s+\w|class\s+\w+\s*(?:\([^{]*\))?\s*:|@\w)", re.MULTILINE)
_FENCE = re.compile(r"^[ \t]*```[^\n`]*\n", re.MULTILINE)
_FIRST_DEF = re.compile(r"^([ \t]*)(?:async\s+)?def\s+(\w+)\s*\(([^)]*)", re.MULTILINE)
_CALL = re.compile(r"^([A-Za-z_]\w*)\(.*\)\s*;?$")
_TERMINAL = re.compile(r"^(?:return\b|yield\b|raise\b|print\b)")
_COMMENT = re.compile(r"\s+#[^'\"]*$")
#: A name that is a statement of its own: what is left of a longer statement, if the name is new.
_LONE_NAME = re.compile(r"^(?!(?:pass|break|continue|return)$)[A-Za-z_]\w*$")
_SENTENCE = re.compile(r"[.!?:][\"')\]]*$")
_QUOTED = re.compile(r"(['\"]).*?\1")
_WORDS = re.compile(r"[A-Za-z_]\w*")
_BUILTIN = frozenset(dir(__builtins__) if not isinstance(__builtins__, dict) else __builtins__) | {"return", "print", "yield", "raise", "if", "else", "for", "in", "and", "or", "not", "is", "lambda", "None", "True", "False", "self", "await"}


def is_code(text: str) -> bool:
    """Whether a text holds a line that only Python has."""
    return _CODE_LINE.search(text) is not None


def _last_statement(text: str) -> tuple[str, str, int]:
    """The last line that is neither blank, comment nor closing fence, without its end comment; the text before; its indent."""
    lines = text.rstrip().split("\n")
    while lines and (not lines[-1].strip() or lines[-1].lstrip().startswith("#") or lines[-1].strip() == "```"):
        lines.pop()
    if not lines:
        return "", "", 0
    line = lines.pop()
    body = line.strip()
    return _COMMENT.sub("", body), "\n".join(lines), len(line.expandtabs()) - len(line.expandtabs().lstrip())


def ends_complete(text: str) -> bool:
    """Whether a program ends with the statement that ends its outermost function, or with the call that starts it."""
    last, before, indent = _last_statement(text)
    if not last:
        return False
    call = _CALL.match(last)
    if call and indent == 0:
        return parse(last).valid and call[1] in before
    if not _TERMINAL.match(last) or parse(last).truncated:
        return False
    first = _FIRST_DEF.search(before)
    if first is None:
        return True
    base = len(first[1].expandtabs())
    started = first[3].strip() or last.startswith("return")  # a function without parameters has to be called
    if indent <= base or not started:
        return False
    body = re.search(r"\n([ \t]+)\S", before[first.end() :])
    if body and indent > len(body[1].expandtabs()):
        return False
    return _names_known(last, before)


def _names_known(last: str, before: str) -> bool:
    """Whether a returning statement names something, and only what stands in the text before: a cut name rarely does."""
    names = _WORDS.findall(_QUOTED.sub("", last))
    rest = {w for w in names if w not in _BUILTIN}
    value = bool(rest) or re.search(r"[0-9\"']|\b(?:None|True|False)\b|\(.*\)", last) is not None
    return value and rest <= set(_WORDS.findall(before))


def cut_evidence(text: str | None, at_limit: bool) -> str | None:
    """Why a text counts as cut off: ``spike`` (at a length spike, without an ending), ``mark`` (the mark of a cut stands at the
    end) or ``parse`` (the derivative parser runs to the last line, which breaks off); None for all others."""
    if not text or not text.strip():
        return None
    code = is_code(text)
    mark = MARK.search(text)
    if mark and (code or _WORDS.search(text[: mark.start()])):
        if code and parse(text).valid and ends_complete(text):
            return None
        return "spike" if at_limit else "mark"
    if not code:
        return "spike" if at_limit and not _SENTENCE.search(text.rstrip()) and text.rstrip()[-1] not in "`}]);0123456789" else None
    if at_limit:
        return "spike" if text[-1] in " \t" or not (ends_complete(text) or _prose_end(text)) else None
    out = parse(text)
    if not out.valid and not out.truncated and out.line <= (lead := _lead_lines(text)):
        text = "\n" * lead + text.split("\n", lead)[lead]
        out = parse(text)
    if out.valid:
        last, before, indent = _last_statement(text)
        return "parse" if indent > 0 and _LONE_NAME.match(last) is not None and last not in _WORDS.findall(before) else None
    bottom = text.rstrip().count("\n") + 1
    if not out.truncated and out.line < bottom:
        return None
    return None if _prose_end(text) or _statement_done(text) else "parse"


def is_cut_off(text: str | None, at_limit: bool) -> bool:
    """Whether a text lost its end."""
    return cut_evidence(text, at_limit) is not None


def _lead_lines(text: str) -> int:
    """How many lines stand before the code: up to an opening fence, else up to the first line that only Python has."""
    code = _CODE_LINE.search(text)
    before = text[: code.start()] if code else ""
    fence = _FENCE.search(before)
    return before[: fence.end()].count("\n") if fence else before.count("\n")


def _prose_end(text: str) -> bool:
    """Whether the last line is a sentence or a fence, as wordy answers have after the code."""
    last = text.rstrip().rsplit("\n", 1)[-1].strip()
    return last == "```" or bool(_SENTENCE.search(last) and re.match(r"^[A-Z][\w']* \w", last) and last[-1] != ":")


def _statement_done(text: str) -> bool:
    """Whether the last statement is one that ends a program and lacks nothing itself."""
    last, before, _ = _last_statement(text)
    call = _CALL.match(last)
    if call and call[1] in before and parse(last).valid and not text.rstrip().endswith(","):
        return call[1] not in _BUILTIN or text.rstrip().endswith(last)
    return bool(_TERMINAL.match(last)) and not parse(last).truncated and _names_known(last, before)


def length_limits(df: DataFrame, source: list[str], text: str) -> DataFrame:
    """Limits per source: ``source``, unit (characters or bytes), limit, rows_at_limit."""
    sized = df.where(F.col(text).isNotNull()).groupBy(*source, F.length(text).alias("c"), F.octet_length(text).alias("b")).agg(F.count("*").alias("n"))
    units = sized.select(*source, "n", F.inline(F.array(F.struct(F.lit("characters").alias("unit"), F.col("c").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("b").alias("size")))))
    tops = units.groupBy(*source, "unit").agg(F.max("size").alias("limit")).select(*(F.col(s).alias(f"__{s}") for s in source), F.col("unit").alias("__unit"), "limit")
    same = F.col("unit") == F.col("__unit")
    for s in source:
        same &= F.col(s).eqNullSafe(F.col(f"__{s}"))
    near = units.join(tops, same).where(F.col("size") >= F.col("limit") - SPIKE_WINDOW)
    found = near.groupBy(*source, "unit", "limit").agg(F.sum(F.when(F.col("size") == F.col("limit"), F.col("n")).otherwise(0)).alias("rows_at_limit"), F.sum(F.when(F.col("size") < F.col("limit"), F.col("n")).otherwise(0)).alias("below"))
    return found.where((F.col("rows_at_limit") >= SPIKE_ROWS) & (F.col("rows_at_limit") >= SPIKE_RATIO * (F.col("below") / SPIKE_WINDOW + 1))).drop("below")


def cut_off(df: DataFrame, source: list[str], text: str, keep: list[str]) -> DataFrame:
    """Every row of ``df``: ``keep``, ``source``, at_limit, truncated (boolean, never null), evidence (see ``cut_evidence``).

    Null and blank texts are not truncated; a source of null is a source; an empty table gives no rows; repeated rows stay.
    """
    wide = length_limits(df, source, text).groupBy(*source).agg(F.max(F.when(F.col("unit") == "characters", F.col("limit"))).alias("__chars"), F.max(F.when(F.col("unit") == "bytes", F.col("limit"))).alias("__bytes"))
    wide = wide.select(*(F.col(s).alias(f"__{s}") for s in source), "__chars", "__bytes")
    same = F.lit(True)
    for s in source:
        same &= F.col(s).eqNullSafe(F.col(f"__{s}"))
    columns = list(dict.fromkeys([*keep, *source]))
    rows = spread(df.select(*columns, F.col(text).alias("__text"))).join(wide, same, "left")
    at = F.coalesce(F.length("__text") == F.col("__chars"), F.lit(False)) | F.coalesce(F.octet_length("__text") == F.col("__bytes"), F.lit(False))
    rows = rows.select(*columns, "__text", at.alias("at_limit"))
    schema = rows.select(*columns, "at_limit").schema.add("truncated", "boolean").add("evidence", "string")

    def run(batches):
        for b in batches:
            found = pa.array([cut_evidence(t, a) for t, a in zip(b.column("__text").to_pylist(), b.column("at_limit").to_pylist())], pa.string())
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in [*columns, "at_limit"]} | {"truncated": found.is_valid(), "evidence": found})

    return rows.mapInArrow(run, schema)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generations whose solution lost its end."""
    return cut_off(table(spark, sf_dir, "generations"), ["model", "dataset"], "generated_solution", ["generation_id"]).where("truncated").select("generation_id")


def p2_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length spikes of each source, in characters and bytes."""
    return length_limits(table(spark, sf_dir, "generations"), ["model", "dataset"], "generated_solution")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source truncates, and by which evidence."""
    rows = cut_off(table(spark, sf_dir, "generations"), ["model", "dataset"], "generated_solution", [])
    return rows.groupBy("model", "dataset").agg(
        F.count("*").alias("rows"), F.count_if("at_limit").alias("rows_at_limit"), F.count_if("truncated").alias("truncated"),
        *(F.count_if(F.col("evidence") == e).alias(f"by_{e}") for e in ("spike", "mark", "parse")), F.round(F.avg(F.col("truncated").cast("double")), 6).alias("truncated_share")
    )
