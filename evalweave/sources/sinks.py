"""Sinks: JSON Lines, CSV with fixed formats, Markdown, LaTeX and JSON reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, append: bool = False, by: Sequence[str] = ()) -> None:
    """JSON Lines in UTF-8, overwritten or appended, in folders by ``by``. Appending adds whole files, so a run that was cut
    short leaves only finished rows, and ``resume_keys`` picks up after them."""
    writer = df.write.mode("append" if append else "overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)


def fixed(value: Column, digits: int = 2, sign: bool = False) -> Column:
    """A number with a fixed count of digits, empty for null."""
    return F.when(value.isNotNull(), F.format_string(f"%{'+' if sign else ''}.{digits}f", value.cast("double"))).otherwise("")


def with_fixed(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """``df`` with these columns as text of fixed digits."""
    return df.withColumns({c: fixed(F.col(c), d) for c, d in digits.items()})


def write_csv(df: DataFrame, path: str, digits: dict[str, int] | None = None) -> None:
    """CSV with header; numbers of ``digits`` in fixed format, nulls empty."""
    with_fixed(df, digits or {}).write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def write_lines(df: DataFrame, path: str, head: Sequence[str], line: Callable[[dict], str], tail: Sequence[str] = ()) -> None:
    """A text file with a line for each row, in the order of ``df``. Rows are streamed a partition at a time, so a report of
    any length is written whole."""
    with open(path, "w", encoding="utf-8") as f:
        for x in head:
            f.write(x + "\n")
        for r in df.toLocalIterator():
            f.write(line(r.asDict()) + "\n")
        for x in tail:
            f.write(x + "\n")


def _markdown_parts(columns: Sequence[str], title: str | None) -> tuple[list[str], Callable[[dict], str]]:
    head = [f"# {title}", ""] if title else []
    head += ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return head, lambda r: "| " + " | ".join("—" if r[c] is None else str(r[c]) for c in columns) + " |"


def markdown(df: DataFrame, title: str | None = None) -> str:
    """A Markdown table as a text, nulls as a dash; ``write_markdown`` is for long ones."""
    head, line = _markdown_parts(df.columns, title)
    return "\n".join([*head, *(line(r.asDict()) for r in df.toLocalIterator())]) + "\n"


def write_markdown(df: DataFrame, path: str, title: str | None = None) -> None:
    """A Markdown table as a file, of any length."""
    write_lines(df, path, *_markdown_parts(df.columns, title))


def latex_table(df: DataFrame, row: str, column: str, value: str, caption: str = "") -> str:
    """A LaTeX table with a line for each ``row`` and a column for each ``column``, ``value`` in the cells, ``--`` where there is
    none. Percent signs, ampersands and underscores are escaped; a table that can be typeset is small."""

    def plain(x: object) -> str:
        return "--" if x is None else "".join("\\" + c if c in "%&_#$" else c for c in str(x))

    wide = df.groupBy(row).pivot(column).agg(F.first(value)).orderBy(row)
    names = wide.columns[1:]
    lines = ["\\begin{tabular}{l" + "r" * len(names) + "}", "\\toprule", " & ".join(map(plain, [row, *names])) + " \\\\", "\\midrule"]
    lines += [" & ".join(plain(r[c]) for c in wide.columns) + " \\\\" for r in wide.toLocalIterator()]
    lines += ["\\bottomrule", "\\end{tabular}"]
    return "\n".join([*([f"% {caption}"] if caption else []), *lines]) + "\n"


def latex_interval(cond: Column, relative: Column, lo: Column, hi: Column) -> Column:
    """A table cell with a rate, its relative change and its interval."""
    return F.format_string("%.1f ({-}%.0f\\%%)  [%+.1f, %+.1f]", cond, F.abs(relative), lo, hi)


def json_report(df: DataFrame) -> DataFrame:
    """All rows as one JSON array, in a table of one row (for summaries)."""
    return df.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*df.columns)))).alias("report"))
