"""What results are written as: delimited tables, JSON lines, wrapped alignments, tables as text. Existing targets are refused unless told otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, sep: str = "\t", header: bool = True, order: list[str] | None = None, mode: str = "errorifexists", compression: str = "none") -> None:
    """Rows as delimited text, no separator behind the last field, in ``order`` (over all files, by their names) if given."""
    rows = df.orderBy(*order) if order else df
    rows.write.mode(mode).option("sep", sep).option("header", header).option("compression", compression).option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists", compression: str = "none") -> None:
    """One JSON object a row; nulls are left out."""
    df.write.mode(mode).option("compression", compression).json(path)


def by_similarity(df: DataFrame, similarity: str = "similarity") -> DataFrame:
    """Mapped places, the most similar first; ties by the other columns."""
    return df.orderBy(F.desc(similarity), *[c for c in df.columns if c != similarity])


def by_place(orfs: DataFrame) -> DataFrame:
    """Frames by record, start, end, strand and length."""
    return orfs.orderBy("id", "start", "end", "strand", "n")


def aligned_text(first: Column, second: Column, width: int = 60) -> Column:
    """Two aligned strings in blocks of ``width``: place and letters, the marks between (``|`` equal, ``.`` different, blank for a gap), place and letters."""
    mark = lambda x, y: F.when((x == "-") | (y == "-"), " ").when(x == y, "|").otherwise(".")
    marks = F.array_join(F.zip_with(F.split(first, ""), F.split(second, ""), mark), "")
    n = F.length(first)
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(width))).otherwise(F.array().cast("array<int>"))

    def block(i: Column) -> Column:
        at = F.lpad(i.cast("string"), 4, " ")
        cut = lambda s: F.substring(s, i, F.lit(width))
        return F.concat(at, F.lit(" "), cut(first), F.lit("\n     "), cut(marks), F.lit("\n"), at, F.lit(" "), cut(second), F.lit("\n"))

    return F.array_join(F.transform(starts, block), "\n")


def family_text(aligned: Column, width: int = 20) -> Column:
    """An array of aligned strings in blocks of ``width``, a line each."""
    longest = F.array_max(F.transform(aligned, F.length))
    starts = F.when(longest > 0, F.sequence(F.lit(1), F.greatest(longest, F.lit(1)), F.lit(width))).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(starts, lambda i: F.array_join(F.transform(aligned, lambda s: F.substring(s, i, F.lit(width))), "\n")), "\n\n")


def markdown_row(df: DataFrame, widths: dict[str, int]) -> Column:
    """A row as a line of a Markdown table: cells cut to their widths with dots and padded, ``|`` escaped, nulls empty."""
    from helixframe.functions.sequence import truncated

    cell = lambda c, w: F.rpad(truncated(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), w), w, " ")
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c, widths[c]) for c in df.columns]), F.lit(" |"))


def markdown_head(widths: dict[str, int]) -> str:
    """The two lines above the rows."""
    return "| " + " | ".join(c[:w].ljust(w) for c, w in widths.items()) + " |\n|" + "|".join("-" * (w + 2) for w in widths.values()) + "|"


def write_markdown(df: DataFrame, path: str, most: int = 50, mode: str = "errorifexists") -> None:
    """A Markdown table; columns are as wide as their longest value, ``most`` letters at most."""
    from helixframe.operators.stats import column_widths

    found = column_widths(df).first()
    widths = {c: min(most, max(len(c), found[c], 3)) for c in df.columns}
    rows = df.select(markdown_row(df, widths).alias("value"))
    head = df.sparkSession.createDataFrame([(line,) for line in markdown_head(widths).split("\n")], "value string").coalesce(1)
    head.union(rows).write.mode(mode).text(path)
