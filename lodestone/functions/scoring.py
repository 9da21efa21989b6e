"""Scores, bands and ratings as column expressions, so that they stay inside code generation and prune."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0, high: float = 100) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x.cast("double")))


def bands(x: Column, cuts: list[tuple[float, object]], other: object) -> Column:
    """The value of the first cut that ``x`` reaches, else ``other``."""
    out = F.lit(None)
    first, *rest = cuts
    out = F.when(x >= first[0], first[1])
    for cut, value in rest:
        out = out.when(x >= cut, value)
    return out.otherwise(other)


def below(x: Column, cuts: list[tuple[float, object]], other: object) -> Column:
    """The value of the first cut that ``x`` doesn't exceed, else ``other``."""
    first, *rest = cuts
    out = F.when(x <= first[0], first[1])
    for cut, value in rest:
        out = out.when(x <= cut, value)
    return out.otherwise(other)


def choose(x: Column, values: dict[str, object], other: object = None) -> Column:
    out = None
    for key, value in values.items():
        out = F.when(x == key, value) if out is None else out.when(x == key, value)
    return out.otherwise(other)


# --- issue summaries -------------------------------------------------------


def quality_score(errors: Column, warnings: Column, infos: Column) -> Column:
    return clamp(100 - 5 * errors - 2 * warnings - 0.5 * infos)


def security_score(findings: Column) -> Column:
    return F.greatest(F.lit(0.0), 100 - 10 * findings.cast("double"))


def health_score(critical: Column, high: Column, medium: Column, low: Column, avg_cc: Column, methods_over: Column, mi: Column) -> Column:
    """100 less weighted issues and complexity, plus or less 5 for maintainability, clamped."""
    cc = F.when(avg_cc > 15, 10).when(avg_cc > 10, 5).otherwise(0)
    return clamp(100 - 10 * critical - 5 * high - 2 * medium - low - cc - methods_over + F.when(mi > 80, 5).when(mi < 50, -5).otherwise(0))


def weighted_health(critical: Column, high: Column, medium: Column, low: Column) -> Column:
    """100 less 10, 5, 2 and 0.5 for an issue of each severity."""
    return clamp(100 - 10 * critical - 5 * high - 2 * medium - 0.5 * low)


def capped_health(critical: Column, high: Column, medium: Column, low: Column) -> Column:
    """100 less penalties that are capped at 30, 20, 15 and 10."""
    return clamp(100 - F.least(F.lit(30.0), critical * 10.0) - F.least(F.lit(20.0), high * 5.0) - F.least(F.lit(15.0), medium * 2.0) - F.least(F.lit(10.0), low * 0.5))


def documentation_score(coverage: Column, critical: Column, high: Column, medium: Column, low: Column, info: Column) -> Column:
    return clamp(100 - 0.3 * (100 - coverage) - 5 * critical - 2 * high - medium - 0.5 * low - 0.1 * info)


def api_score(critical: Column, high: Column, medium: Column, low: Column, breaking: Column) -> Column:
    """Rounded half to even at one place."""
    return F.greatest(F.lit(0.0), F.bround((100 - 10 * critical - 5 * high - 2 * medium - 0.5 * low - 5 * breaking).cast("double"), 1))


def logging_score(critical: Column, high: Column, medium: Column, low: Column) -> Column:
    return weighted_health(critical, high, medium, low)


def compatibility(uses: Column, packages: Column, blocking: Column) -> Column:
    return clamp(1 - uses - 0.05 * packages - 0.1 * blocking, 0, 1)


def dependency_risk(critical: Column, high: Column, medium: Column, low: Column) -> Column:
    return F.least(F.lit(100), 25 * critical + 15 * high + 8 * medium + 2 * low)


def risk_level(score: Column) -> Column:
    return bands(score, [(75, "Critical"), (50, "High"), (25, "Medium"), (1, "Low")], "None")


# --- technical debt --------------------------------------------------------


def debt_rating(critical: Column, high: Column, medium: Column, security: Column, avg_minutes: Column) -> Column:
    score = 20 * critical + 10 * high + 3 * medium + 5 * security + F.least(avg_minutes / 10, F.lit(30.0))
    return below(score, [(10, "A"), (30, "B"), (60, "C"), (100, "D")], "E")


def debt_score(mean_weight: Column, items: Column) -> Column:
    return F.least(F.lit(100.0), F.least(20 * mean_weight, F.lit(100.0)) + F.least(items / 50 * 20, F.lit(30.0)))


SEVERITY_WEIGHT = {"Critical": 10.0, "High": 5.0, "Medium": 2.0, "Low": 0.5}


def severity_weight(severity: Column) -> Column:
    return choose(severity, SEVERITY_WEIGHT, 1.0)


def payoff(impact: Column, frequency: Column, severity: Column, effort: Column, interest: Column) -> Column:
    factor = choose(severity, {"Critical": 3.0, "High": 2.0, "Medium": 1.0}, 0.5)
    return impact * frequency * factor / (effort + 1) * F.when(interest > 10, 1.2).when(interest > 5, 1.1).otherwise(1.0)


def effort(minutes: Column) -> Column:
    return F.least(minutes / 480 * 100, F.lit(100.0))


def impact_of(cc: Column, lines: Column) -> Column:
    return 0.7 * F.least(cc / 25, F.lit(1.0)) * 100 + 0.3 * F.least(lines / 100, F.lit(1.0)) * 100


def long_method_minutes(lines: Column, cc: Column) -> Column:
    return 30 + 10 * F.greatest(F.floor((lines - 30) / 10), F.lit(0)) + 5 * F.greatest(cc - 10, F.lit(0))


def god_class_minutes(methods: Column, fields: Column) -> Column:
    return F.greatest(F.lit(120), 120 + 5 * (methods - 15) + 3 * (fields - 10))


def priority(severity: Column, category: Column, impact: Column, effort: Column, payoff: Column, frequency: Column) -> Column:
    """Ordered rules; the first that holds names the bucket."""
    security = (category == "Security") & severity.isin("Critical", "High")
    quick = ((payoff >= 2) & (effort <= 35)) | ((frequency >= 5) & (effort <= 40))
    major = ((impact >= 60) & (effort >= 50)) | category.isin("GodClass", "CircularDependency")
    return F.when((severity == "Critical") | security, "Critical").when(quick, "QuickWin").when(major, "MajorProject").otherwise("LowPriority")


def simple_priority(severity: Column, impact: Column, effort: Column) -> Column:
    return F.when(severity == "Critical", "Critical").when((impact >= 50) & (effort <= 30), "QuickWin").when((impact >= 60) & (effort > 50), "MajorProject").otherwise("LowPriority")


PRIORITY_BOOST = {"Critical": 10000.0, "QuickWin": 1000.0, "MajorProject": 100.0}


# --- change impact ---------------------------------------------------------


def impact_risk(direct: Column, transitive: Column) -> Column:
    """Points for how many symbols a change reaches at once and in the end, 25 at most."""
    near = below(direct, [(0, 0), (5, 5), (10, 10), (20, 15)], 20)
    far = below(transitive, [(0, 0), (10, 1), (50, 3), (100, 4)], 5)
    return F.least(near + far, F.lit(25))


def api_risk(change: Column, public: Column) -> Column:
    return F.when(public, choose(change, {"Deletion": 25, "SignatureChange": 20, "Rename": 20, "TypeChange": 15, "AccessibilityChange": 15}, 5)).otherwise(0)


def critical_risk(own: Column, hit: Column) -> Column:
    return F.when(own, 15).otherwise(F.least(F.lit(25), 5 * hit))


def coverage_risk(coverage: Column) -> Column:
    """By mean known coverage; 12.5 if none is known."""
    return F.when(coverage.isNull(), 12.5).otherwise(bands(coverage, [(80, 0.0), (60, 5.0), (40, 10.0), (20, 18.0)], 25.0))


def combined_risk(highest: Column, changes: Column) -> Column:
    return F.least(F.lit(100.0), highest * (1 + 0.1 * (changes - 1)))


# --- complexity and maintainability ---------------------------------------


def maintainability(loc: Column, avg_cc: Column) -> Column:
    """Rescaled to 100, with the volume taken from lines."""
    volume = loc * F.log2(loc + 1)
    return F.greatest(F.lit(0.0), (171 - 5.2 * F.log(volume + 1) - 0.23 * avg_cc - 16.2 * F.log(loc + 1)) * 100 / 171)


def maintainability_raw(volume: Column, cc: Column, loc: Column) -> Column:
    """Not rescaled, clamped; volumes and lines below 1 count as 1."""
    return clamp(171 - 5.2 * F.log(F.greatest(volume, F.lit(1.0))) - 0.23 * cc - 16.2 * F.log(F.greatest(loc.cast("double"), F.lit(1.0))))


def halstead_volume(total: Column, distinct: Column) -> Column:
    return F.when(distinct > 0, total * F.log2(distinct.cast("double"))).otherwise(0.0)


def quality_rating(score: Column) -> Column:
    return bands(score, [(90, "Excellent"), (75, "Good"), (60, "Acceptable"), (40, "NeedsWork"), (20, "Poor")], "Critical")


def test_grade(coverage: Column) -> Column:
    return bands(coverage, [(90, "A"), (80, "B"), (70, "C"), (60, "D")], "F")


def transformation_gain(compiles: Column, preserved: Column, d_cc: Column, d_cog: Column, d_loc: Column, d_mi: Column) -> Column:
    return F.when(~compiles, -100.0).when(~preserved, -50.0).otherwise(clamp(50 - 2 * d_cc - 3 * d_cog - 0.5 * d_loc + 2 * d_mi, -100, 100))


def cohesion_score(mean_penalty: Column) -> Column:
    return 100 - 25 * F.greatest(mean_penalty - 1, F.lit(0))


# --- learned confidence ----------------------------------------------------


def modifier(applied: Column, reverted: Column, total: Column, least: int = 5) -> Column:
    """0.5 and the net success of a pattern once there are enough samples, else 1."""
    return F.when(total >= least, 0.5 + (applied - reverted) / total).otherwise(1.0)


def confidence(adjust: list[Column], learned: Column) -> Column:
    """0.5 and all adjustments, times the learned modifier where that is more than 0.1 from 1."""
    base = F.lit(0.5)
    for a in adjust:
        base = base + a
    return clamp(base * F.when(F.abs(learned - 1) > 0.1, learned).otherwise(1.0), 0, 1)


def trend(old: Column, new: Column, lower_is_better: bool) -> Column:
    """Stable within 5 % of the old value. From 0 to 0 is not stable: the band has no width there."""
    worse, better = ("Declining", "Improving") if lower_is_better else ("Improving", "Declining")
    return F.when(F.abs(new - old) < F.abs(old) * 0.05, "Stable").when(new - old > 0, worse).otherwise(better)
