"""Package versions: parts, comparison, ranges and how far one is behind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(version: Column, n: int = 3) -> Column:
    """The first ``n`` numbers; what follows ``-`` is cut, junk and missing parts are 0. Arrays compare part by part."""
    raw = F.split(F.element_at(F.split(version, "-"), 1), "\\.")
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.coalesce(F.get(raw, i - 1).try_cast("int"), F.lit(0)))


def behind(current: Column, latest: Column) -> Column:
    """Major versions behind; if none, minor; if none, patches."""
    a, b = parts(current), parts(latest)
    return F.struct(
        F.greatest(F.lit(0), b[0] - a[0]).alias("major"),
        F.when(b[0] == a[0], F.greatest(F.lit(0), b[1] - a[1])).otherwise(0).alias("minor"),
        F.when((b[0] == a[0]) & (b[1] == a[1]), F.greatest(F.lit(0), b[2] - a[2])).otherwise(0).alias("patch"),
    )


def urgency(vulnerable: Column, gap: Column) -> Column:
    return F.when(vulnerable, "Critical").when(gap["major"] >= 2, "High").when((gap["major"] >= 1) | (gap["minor"] >= 5), "Medium").otherwise("Low")


def affected(version: Column, range_: Column) -> Column:
    """Whether a range has a version: comma-separated parts are alternatives (an upper bound after a comma adds nothing), ``a - b`` is closed."""
    v = parts(version, 4)

    def one(part: Column) -> Column:
        p = F.trim(part)
        bare = F.regexp_replace(p, r"[<>=\[\]()\s]", "")
        closed = F.split(p, " - ")
        return (
            F.when(p.contains(" - "), (v >= parts(F.trim(closed[0]), 4)) & (v <= parts(F.trim(F.element_at(closed, -1)), 4)))
            .when(p.startswith("<="), v <= parts(bare, 4))
            .when(p.startswith("<"), v < parts(bare, 4))
            .when(p.startswith("["), v >= parts(bare, 4))
            .when(p.startswith("("), v > parts(bare, 4))
            .when(p.rlike(r"[\])]$"), F.lit(False))
            .otherwise((version == bare) | version.startswith(bare) | bare.startswith(version))
        )

    return F.exists(F.split(range_, ","), one)
