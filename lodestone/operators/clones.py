"""What may be a clone, how fragments are written alike, and what a class of clones would save."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Least tokens, least and most lines of a fragment, least characters of its normal form.
LEAST_TOKENS, LEAST_LINES, MOST_LINES, LEAST_LENGTH = 50, 5, 200, 20
# Bodies too plain to be clones.
TRIVIAL = ["return;", "throw new NotImplementedException();", "throw new NotSupportedException();", "return null;", "return false;", "return true;", "return 0;", "return string.Empty;", "return default;", "break;", "continue;"]


def trivial(source: Column, normalized: Column) -> Column:
    short = F.length(F.replace(normalized, F.lit(" "), F.lit(""))) < LEAST_LENGTH
    return short | F.lower(F.trim(source)).isin(*[t.lower() for t in TRIVIAL])


def candidates(fragments: DataFrame, excluded: list[str] = []) -> DataFrame:
    """Fragments (path, start_line, end_line, tokens, source, normalized) worth a comparison; ``*x`` excludes paths that end so, other patterns those that have it."""
    lines = F.col("end_line") - F.col("start_line") + 1
    keep = (F.size("tokens") >= LEAST_TOKENS) & lines.between(LEAST_LINES, MOST_LINES) & ~trivial(F.col("source"), F.col("normalized"))
    for p in excluded:
        low = F.lower("path")
        keep &= ~(low.endswith(p[1:].lower()) if p.startswith("*") else low.contains(p.lower()))
    return fragments.where(keep)


def overlapping(a: str, b: str) -> Column:
    """Whether two fragments, by the names of their tables, share lines of a file."""
    return (F.col(f"{a}.path") == F.col(f"{b}.path")) & (F.col(f"{a}.start_line") <= F.col(f"{b}.end_line")) & (F.col(f"{b}.start_line") <= F.col(f"{a}.end_line"))


def renamed(tokens: Column, kept: list[str]) -> Column:
    """Identifiers by the order in which they first occur, ``$1`` and on, strings as ``$S``, numbers over 10 as ``$N``; kept words and signs stay.

    Two fragments that differ in names and literals only are written alike.
    """
    name = tokens
    ident = lambda t: t.rlike("^[A-Za-z_]") & ~t.isin(*kept)
    order = F.array_distinct(F.filter(name, ident))
    return F.transform(name, lambda t: F.when(ident(t), F.concat(F.lit("$"), F.array_position(order, t))).when(t.startswith('"'), "$S").when(t.rlike("^[0-9]") & (F.coalesce(t.try_cast("double"), F.lit(11.0)) > 10), "$N").otherwise(t))


def exact_groups(fragments: DataFrame, by: str) -> DataFrame:
    """(group, n, lines, representative) of fragments (id, lines, and the column ``by``) that are alike, the most lines first; the shortest represents, of equals the least id."""
    g = fragments.groupBy(F.sha2(F.col(by), 256).alias("group")).agg(F.count(F.lit(1)).alias("n"), F.sum("lines").alias("lines"), F.min(F.struct("lines", "id")).alias("m")).where("n > 1")
    return g.select("group", "n", "lines", F.col("m.id").alias("representative"), (F.col("lines") - F.col("m.lines")).alias("saved"))
