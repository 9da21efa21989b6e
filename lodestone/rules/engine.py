"""A small rule language over node facts, compiled to column conditions.

A rule names a kind of node, a pattern and conditions; all of it becomes one
filter of a scan of ``nodes``, so kinds prune and names are compared where
the rows are. Node facts: path, kind, line, depth, text, name, full_name,
class, method, namespace, params, args (array), returns, in_kinds (array of
the kinds of ancestors).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import generated, snippet, wildcard

KINDS = {"method_invocation": "Invocation", "method_declaration": "Method", "type_usage": "Type", "numeric_literal": "Number", "string_literal": "String", "attribute": "Attribute"}


@dataclass
class Rule:
    name: str = "UnnamedRule"
    message: str = "Rule violation"
    severity: str = "Warning"
    enabled: bool = True
    type: str = "method_invocation"
    match: str | None = None
    regex: bool = False
    returns: str | None = None
    name_pattern: str | None = None
    min_value: float | None = None
    max_value: float | None = None
    min_parameters: int | None = None
    max_parameters: int | None = None
    required_arguments: list[str] = field(default_factory=list)
    in_: list[str] = field(default_factory=list)
    not_in: list[str] = field(default_factory=list)
    conditions: list[str] = field(default_factory=list)


NAMES = {"namePattern": "name_pattern", "minValue": "min_value", "maxValue": "max_value", "minParameters": "min_parameters", "maxParameters": "max_parameters", "requiredArguments": "required_arguments", "in": "in_", "notIn": "not_in", "useRegex": "regex"}


def parse(source: str | list) -> tuple[list[Rule], list[str]]:
    """Rules of a YAML text (or parsed rows) and errors; one bad rule doesn't stop the others, unknown properties are ignored."""
    if isinstance(source, str):
        import yaml

        try:
            loaded = yaml.safe_load(source) or []
        except yaml.YAMLError as e:
            return [], [str(e)]
        rows = loaded.get("rules", []) if isinstance(loaded, dict) else loaded
    else:
        rows = source
    rules, errors = [], []
    for i, row in enumerate(rows):
        try:
            flat = {**{k: v for k, v in row.items() if k != "pattern"}, **(row.get("pattern") or {})}
            flat = {NAMES.get(k, k): v for k, v in flat.items() if v is not None}
            rules.append(Rule(**{k: v for k, v in flat.items() if k in Rule.__dataclass_fields__}))
        except (AttributeError, TypeError) as e:
            errors.append(f"rule {i}: {e}")
    return rules, errors


def problems(rule: Rule) -> list[str]:
    """Why a rule is not valid: no name, no message, nothing to match."""
    out = []
    if not rule.name:
        out.append("a rule needs a name")
    if not rule.message:
        out.append("a rule needs a message")
    if rule.type not in KINDS:
        out.append(f"no pattern type {rule.type}")
    if rule.match is None and rule.name_pattern is None and rule.min_value is None and rule.max_value is None:
        out.append("a pattern needs match, namePattern, minValue or maxValue")
    return out


def comparison(value: Column, text: str) -> Column | None:
    """``>=3``, ``<3``, ``!=3`` or ``3``; null if the number can't be read, and then the rule never fires."""
    for sign in (">=", "<=", "==", "!=", ">", "<", "="):
        if text.startswith(sign):
            number = text[len(sign) :].strip()
            break
    else:
        sign, number = "==", text.strip()
    if not number.lstrip("-").isdigit():
        return None
    n = F.lit(int(number))
    return {">=": value >= n, "<=": value <= n, ">": value > n, "<": value < n, "==": value == n, "=": value == n, "!=": value != n}[sign]


def _inside(kind: str) -> Column:
    return F.exists("in_kinds", lambda k: k == kind)


def _matches(column: str) -> Callable[[str], Column]:
    return lambda a: F.col(column).rlike(wildcard(a))


def _listed(key: str) -> Column:
    """The entries of a list among a node's attributes, which are separated by semicolons."""
    return F.array_remove(F.split(F.coalesce(F.element_at("attrs", key), F.lit("")), ";"), "")


def _any(key: str) -> Callable[[str], Column]:
    return lambda a: F.exists(_listed(key), lambda x: x.rlike(wildcard(a)))


def _modifier(word: str) -> Callable[[], Column]:
    return lambda: F.array_contains(F.split(F.coalesce(F.element_at("attrs", "modifiers"), F.lit("")), " +"), word)


def _parameter(argument: str) -> Column:
    """A parameter of this name or, after a comma, of this type; parameters are written ``type name`` with modifiers before."""
    name, *kind = [x.strip().strip("\"'") for x in argument.split(",")]

    def one(p: Column) -> Column:
        parts = F.split(p, " ")
        out = F.element_at(parts, -1).rlike(wildcard(name))
        return out | F.try_element_at(parts, F.lit(-2)).rlike(wildcard(kind[0])) if kind else out

    return F.exists(_listed("parameters"), lambda p: F.coalesce(one(p), F.lit(False)))


def _attribute(argument: str) -> Column:
    low = argument.lower()
    return F.exists(_listed("attributes"), lambda a: F.lower(a).isin(low, low + "attribute"))


# Attributes that mark a test.
TESTS = ["test", "testmethod", "fact", "theory", "testcase"]

#: Conditions without and with an argument.
PLAIN: dict[str, Callable[[], Column]] = {
    "isInLoop": lambda: _inside("For") | _inside("While") | _inside("Foreach"),
    "isInTryBlock": lambda: _inside("Try"),
    "isInCatchBlock": lambda: _inside("Catch"),
    "isInFinallyBlock": lambda: _inside("Finally"),
    "isInLock": lambda: _inside("Lock"),
    "isInUsing": lambda: _inside("Using"),
    "isInLambda": lambda: _inside("Lambda"),
    "isInIf": lambda: _inside("If"),
    "isInSwitch": lambda: _inside("Switch"),
    "isInAsyncMethod": lambda: F.element_at("attrs", "async") == "true",
    "isInConstructor": lambda: F.col("method") == F.col("class"),
    "isInTestMethod": lambda: F.lower("path").contains("test"),
    "isAwaited": lambda: F.element_at("attrs", "awaited") == "true",
    "hasParameters": lambda: F.col("params") > 0,
    "hasNoParameters": lambda: F.col("params") == 0,
    "hasArguments": lambda: F.size("args") > 0,
    **{f"is{m.capitalize()}": _modifier(m) for m in ("public", "private", "protected", "internal", "static", "async", "virtual", "override", "abstract")},
    "inTryCatch": lambda: _inside("Try"),
    "inLoop": lambda: F.arrays_overlap("in_kinds", F.array(*map(F.lit, ("For", "Foreach", "While", "Do")))),
    "inConditional": lambda: F.arrays_overlap("in_kinds", F.array(*map(F.lit, ("If", "Switch", "Conditional")))),
    "isTestMethod": lambda: F.exists(_listed("attributes"), lambda a: F.lower(a).isin(*TESTS)),
    "isConstructor": lambda: F.col("kind") == "Constructor",
    "isProperty": lambda: F.col("kind") == "Property",
    "isField": lambda: F.col("kind") == "Field",
    "hasDocComment": lambda: F.element_at("attrs", "doc") == "true",
    "isGeneric": lambda: F.size(_listed("type_parameters")) > 0,
    "isExtensionMethod": lambda: F.startswith(F.coalesce(F.get(_listed("parameters"), F.lit(0)), F.lit("")), F.lit("this ")),
    "isDisposable": lambda: F.arrays_overlap(_listed("interfaces"), F.array(F.lit("IDisposable"), F.lit("IAsyncDisposable"))),
    "modifiesState": lambda: F.size(_listed("writes")) > 0,
}
WITH_ARGUMENT: dict[str, Callable[[str], Column | None]] = {
    "isInClass": _matches("class"),
    "isInMethod": _matches("method"),
    "isInNamespace": _matches("namespace"),
    "isInFile": _matches("path"),
    "returns": _matches("returns"),
    "nameMatches": _matches("name"),
    "hasAttribute": _attribute,
    "inNamespace": _matches("namespace"),
    "inheritsFrom": _any("bases"),
    "implements": _any("interfaces"),
    "hasParameter": _parameter,
    "returnType": _matches("returns"),
    "containsCall": _any("calls"),
    "usesType": _any("types"),
    "hasTypeParameter": _any("type_parameters"),
    "accessesField": _any("fields"),
    "contains": lambda a: F.contains("text", F.lit(a)),
    "startsWith": lambda a: F.startswith("text", F.lit(a)),
    "endsWith": lambda a: F.endswith("text", F.lit(a)),
    "argumentContains": lambda a: F.exists("args", lambda x: x.contains(a)),
    "parameterCount": lambda a: comparison(F.col("params"), a),
    "argumentCount": lambda a: comparison(F.size("args"), a),
    "nestingDepth": lambda a: comparison(F.col("depth"), a),
    "lineCount": lambda a: comparison(F.element_at("attrs", "lines").cast("int"), a),
    "complexity": lambda a: comparison(F.element_at("attrs", "complexity").cast("int"), a),
}


def condition(text: str) -> tuple[Column | None, bool]:
    """The condition and whether it is known. ``not`` negates only before an argument list; ``notX`` without one and unknown names are dropped.

    A function that needs an argument and has none never holds; what a node
    lacks (a null flag or list) doesn't hold either, and its negation does.
    """
    text = text.strip()
    name, argument, negated = text, "", False
    if "(" in text and text.endswith(")"):
        name, argument = text[: text.index("(")].strip(), text[text.index("(") + 1 : -1].strip()
        negated = name not in PLAIN and name not in WITH_ARGUMENT and name[:3].lower() == "not"
        name = next((n for n in [*PLAIN, *WITH_ARGUMENT] if n.lower() == name[3:].lower()), name) if negated else name
    if name in PLAIN:
        made = PLAIN[name]()
    elif name in WITH_ARGUMENT:
        argument = argument if name == "hasParameter" else argument.strip("\"'")
        made = WITH_ARGUMENT[name](argument) if argument else None
        if made is None:  # a comparison that can't be read never holds
            return F.lit(False), True
    else:
        return None, False
    made = F.coalesce(made, F.lit(False))
    return (~made if negated else made), True


def unknown_conditions(rules: list[Rule]) -> list[tuple[str, str]]:
    """(rule, condition) of all conditions that are dropped, for reports: such a rule fires as if it didn't have them."""
    return [(r.name, c) for r in rules for c in r.conditions if not condition(c)[1]]


def compiled(rule: Rule) -> tuple[Column, list[str]]:
    """One condition on a node for the whole rule, and the conditions that were dropped."""
    c = F.col("kind") == KINDS.get(rule.type, rule.type)
    if rule.match is not None:
        rx = rule.match if rule.regex and rule.type == "string_literal" else wildcard(rule.match)
        if rule.type == "method_invocation":
            c &= F.col("full_name").rlike(rx) | F.col("name").rlike(rx)
        elif rule.type == "attribute":
            c &= F.col("name").rlike(rx) | F.regexp_replace("name", "Attribute$", "").rlike(rx)
        elif rule.type in ("numeric_literal", "string_literal"):
            c &= F.col("text").rlike(rx)
        else:
            c &= F.col("name").rlike(rx)
    if rule.name_pattern is not None:
        c &= F.col("name").rlike(rule.name_pattern)
    if rule.returns is not None:
        c &= F.col("returns").rlike(wildcard(rule.returns))
    if rule.min_parameters is not None:
        c &= F.col("params") >= rule.min_parameters
    if rule.max_parameters is not None:
        c &= F.col("params") <= rule.max_parameters
    value = F.col("text").try_cast("double")
    if rule.min_value is not None:
        c &= value.isNull() | (value >= rule.min_value)
    if rule.max_value is not None:
        c &= value.isNull() | (value <= rule.max_value)
    for argument in rule.required_arguments:
        c &= F.exists("args", lambda a, argument=argument: a.contains(argument))

    def context(patterns: list[str]) -> Column:
        out = F.lit(False)
        for p in patterns:
            rx = wildcard(p)
            for column in (F.col("class"), F.col("method"), F.col("path"), F.element_at(F.split("path", "/"), -1)):
                out |= F.coalesce(column.rlike(rx), F.lit(False))
        return out

    if rule.in_:
        c &= context(rule.in_)
    if rule.not_in:
        c &= ~context(rule.not_in)
    dropped = []
    for text in rule.conditions:
        made, known = condition(text)
        if known:
            c &= made
        else:
            dropped.append(text)
    return F.coalesce(c, F.lit(False)), dropped


def message(rule: Rule) -> Column:
    """The rule's message with its places filled in."""
    out = F.lit(rule.message)
    for key, value in {"file": F.element_at(F.split("path", "/"), -1), "filePath": F.col("path"), "line": F.col("line").cast("string"), "class": F.col("class"), "method": F.col("method"), "name": F.col("name"), "fullName": F.col("full_name"), "value": F.col("text"), "node": F.substring("text", 1, 50)}.items():
        if "{" + key + "}" in rule.message:
            out = F.replace(out, F.lit("{" + key + "}"), F.coalesce(value, F.lit("")))
    return out


def violations(nodes: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, severity, path, line, message, snippet) of enabled rules, from one scan; generated files are passed over."""
    hits = [F.when(compiled(r)[0], F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), message(r).alias("message"))) for r in rules if r.enabled]
    if not hits:
        hits = [F.lit(None).cast("struct<rule:string,severity:string,message:string>")]
    found = nodes.where(~generated(F.col("path"))).select("path", "line", snippet(F.col("text")).alias("snippet"), F.explode(F.array_compact(F.array(*hits))).alias("v"))
    return found.select("v.rule", "v.severity", "path", "line", "v.message", "snippet")
