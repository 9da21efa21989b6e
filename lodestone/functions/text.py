"""Names, source lines, sensitive values and normal forms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of sensitive data in values, in order of trial.
SENSITIVE_VALUES = {
    "CreditCard": r"\b(?:\d{4}[- ]?){3}\d{4}\b",
    "SSN": r"\b\d{3}[- ]?\d{2}[- ]?\d{4}\b",
    "Email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "Phone": r"\b(?:\+?1[- ]?)?\(?\d{3}\)?[- ]?\d{3}[- ]?\d{4}\b",
    "AwsKey": r"AKIA[0-9A-Z]{16}",
    "JWT": r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    "Bearer": r"(?i)Bearer\s+[A-Za-z0-9\-_.~+/]+=*",
}
# Words that mark a configuration key as sensitive.
SENSITIVE_WORDS = ["password", "secret", "key", "token", "credential", "connectionstring", "apikey"]
# Comment markers, in order.
MARKERS = ["TODO", "HACK", "FIXME", "WARNING", "TEMPORARY", "WORKAROUND", "DEPRECATED", "REFACTOR"]


def first_sensitive(value: Column) -> Column:
    """The kind of the first pattern that matches, or null."""
    out = None
    for kind, pattern in SENSITIVE_VALUES.items():
        out = F.when(value.rlike(pattern), kind) if out is None else out.when(value.rlike(pattern), kind)
    return out


def mask(value: Column) -> Column:
    """All of a short value; of a longer one all but the first and last four characters."""
    return F.when(F.length(value) <= 8, "****").otherwise(F.concat(F.substring(value, 1, 4), F.lit("****"), F.right(value, F.lit(4))))


def sensitive_key(key: Column) -> Column:
    return F.lower(key).rlike("|".join(SENSITIVE_WORDS))


def normal_key(key: Column) -> Column:
    """The environment form of a key in the form of a file: double underscores are colons."""
    return F.trim(F.replace(key, F.lit("__"), F.lit(":")))


def markers(comment: Column) -> Column:
    upper = F.upper(comment)
    return F.array_compact(F.array(*[F.when(F.contains(upper, F.lit(m)), m) for m in MARKERS]))


def words(name: Column) -> Column:
    """Lower-case words of an identifier: at underscores, humps and the end of acronyms; a leading underscore or interface I goes."""
    bare = F.regexp_replace(F.regexp_replace(name, "^_+", ""), "^I([A-Z][a-z])", "$1")
    parted = F.regexp_replace(F.regexp_replace(bare, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.array_remove(F.split(F.lower(F.regexp_replace(parted, "[_ ]+", " ")), " "), "")


# Naming conventions in the order of trial.
CONVENTIONS = {
    "InterfacePrefix": "^I[A-Z][a-zA-Z0-9]*$",
    "UnderscoreCamel": "^_[a-z][a-zA-Z0-9]*$",
    "UpperSnake": "^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$",
    "LowerSnake": "^[a-z][a-z0-9]*(_[a-z0-9]+)*$",
    "Pascal": "^[A-Z][a-zA-Z0-9]*$",
    "Camel": "^[a-z][a-zA-Z0-9]*$",
}


def convention(name: Column) -> Column:
    """The first naming convention that a name follows; a lone word is snake case, as the rules are in this order."""
    out = None
    for kind, pattern in CONVENTIONS.items():
        out = F.when(name.rlike(pattern), kind) if out is None else out.when(name.rlike(pattern), kind)
    return out.otherwise("Unknown")


def recase(name: Column, to: str) -> Column:
    w = words(name)
    pascal = F.array_join(F.transform(w, F.initcap), "")
    return {
        "Pascal": pascal,
        "Camel": F.concat(F.lower(F.substring(pascal, 1, 1)), F.substring(pascal, 2, 1_000_000)),
        "LowerSnake": F.array_join(w, "_"),
        "UpperSnake": F.upper(F.array_join(w, "_")),
        "UnderscoreCamel": F.concat(F.lit("_"), F.lower(F.substring(pascal, 1, 1)), F.substring(pascal, 2, 1_000_000)),
    }[to]


def plural(noun: Column) -> Column:
    return F.when(noun.rlike("[^aeiou]y$"), F.regexp_replace(noun, "y$", "ies")).when(noun.rlike("(s|x|ch|sh)$"), F.concat(noun, F.lit("es"))).otherwise(F.concat(noun, F.lit("s")))


def normal_code(text: Column) -> Column:
    """White space collapsed, then strings as one literal, then whole numbers as another."""
    x = F.regexp_replace(text, r"\s+", " ")
    x = F.regexp_replace(x, '"[^"]*"', '"STR"')
    return F.trim(F.regexp_replace(x, r"\b[0-9]+\b", "NUM"), F.lit(" "))


def short_hash(text: Column) -> Column:
    """The first 16 hexadecimal digits, upper case, of SHA-256."""
    return F.upper(F.substring(F.sha2(text, 256), 1, 16))


def fingerprint(*parts: Column) -> Column:
    return short_hash(F.concat_ws(":", *parts))


def truncated(text: Column, most: int) -> Column:
    one = F.trim(F.regexp_replace(text, r"[\r\n]+", " "))
    return F.when(F.length(one) > most, F.concat(F.substring(one, 1, most), F.lit("..."))).otherwise(one)


def snippet(text: Column) -> Column:
    """Cut at 97 and marked if over 100 characters; white space collapses after the cut."""
    cut = F.when(F.length(text) > 100, F.concat(F.substring(text, 1, 97), F.lit("..."))).otherwise(text)
    return F.trim(F.regexp_replace(cut, r"\s+", " "))


def wildcard(pattern: str) -> str:
    """The anchored, case-insensitive expression of a pattern in which * and ? stand for anything and one character."""
    out = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in "\\.^$|()[]{}+-#& ~" else c for c in pattern)
    return f"(?i)^{out}$"


def generated(path: Column) -> Column:
    low = F.lower(path)
    return low.endswith(".g.cs") | low.endswith(".designer.cs") | low.endswith(".generated.cs") | low.contains("obj/") | low.contains("bin/")


def url_like(text: Column) -> Column:
    return F.lower(text).rlike("^(https?|ftp)://")


def annotation(text: Column) -> Column:
    """Escaped for annotation lines, in this order."""
    for a, b in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), (":", "%3A"), (",", "%2C")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def file_size(size: Column) -> Column:
    return F.when(size >= 1 << 20, F.concat(F.floor(size / (1 << 20)), F.lit(" MB"))).when(size >= 1 << 10, F.concat(F.floor(size / (1 << 10)), F.lit(" KB"))).otherwise(F.concat(size, F.lit(" bytes")))


def line_kinds(text: Column) -> Column:
    """(total, code, comment, blank) lines; a comment line begins with //, /* or *."""
    lines = F.split(text, "\n")
    blank = F.size(F.filter(lines, lambda x: F.trim(x) == ""))
    comment = F.size(F.filter(lines, lambda x: F.trim(x).rlike(r"^(//|/\*|\*)")))
    return F.struct(F.size(lines).alias("total"), (F.size(lines) - blank - comment).alias("code"), comment.alias("comment"), blank.alias("blank"))
