"""Queries over detectors of syntax facts and the named rule functions; order lines and parts stand for nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fact_detectors as D
from ..rules import engine as E
from ..session import table
from .catalog import query

# What a node may be and be called; a line picks by its keys.
KINDS = ["Invocation", "Invocation", "Invocation", "Creation", "Creation", "Assignment", "Assignment", "Method", "Method", "Class", "Field", "Lock", "Catch", "Throw", "Return", "Lambda", "Binary", "If", "MemberAccess", "Increment", "Event", "Await", "Constructor", "Cast", "Literal", "Parameter", "Property"]
CALLS = ["ExecuteReader", "Start", "SelectNodes", "LogInformation", "LogDebug", "ReadAllText", "Combine", "Create", "ComputeHash", "Deserialize", "GetType", "AllowAnyOrigin", "Redirect", "Wait", "GetResult", "LoadAsync", "Add", "Remove", "Run", "Sleep", "Where", "ToList", "First", "Count", "Contains", "IsMatch", "GetMethod", "Format", "Replace", "IsTrue", "NotNull", "ThrowIfNull", "WriteLine", "Result", "Now", "Key", "IV", "TypeNameHandling", "RequireDigit", "HttpOnly", "Secure", "SameSite", "ValidateLifetime", "RequireSignedTokens", "ServerCertificateValidationCallback", "UserController", "DeleteUser", "IsReady", "GetValue", "CreateItem", "userCache", "Clear"]
RECEIVERS = ["Process", "File", "Path", "MD5", "DES", "Type", "Regex", "string", "task.GetAwaiter", "db.Context", "items.Where", "items.OrderBy", "items.ToList", "s.Replace", "Thread", "Registry", "DateTime", "BinaryFormatter", "list"]
TYPES = ["SqlCommand", "DirectorySearcher", "MD5CryptoServiceProvider", "DESCryptoServiceProvider", "Random", "BinaryFormatter", "Deserializer", "Regex", "List<int>", "Dictionary<int,int>", "byte[]", "ArrayList", "string", "bool", "Exception", "InvalidOperationException", "ArgumentOutOfRangeException", "Mock<IFoo>"]
TEXTS = ["(this)", "typeof(X)", "(new X())", "x = false", "x = true", "SameSiteMode.None", "TypeNameHandling.All", "a.Count() > 0", "x.GetType() == typeof(Y)", "a.ToLower() == b", "if (x != null)", "if (x == null)", "return null", "password", "sid=1", "this.x", "await F()"]
ARGUMENTS = ["literal", "concatenation", "parameter", "creation", "variable"]
OPERATORS = ["==", "+=", "-=", ">"]
ATTRIBUTES = ["", "Authorize", "AllowAnonymous", "HttpPost", "HttpGet", "Obsolete", "DllImport", "ComImport", "Ignore"]
RETURNS = ["void", "bool", "Task<int>", "int"]
ANCESTORS = ["For", "Try", "Catch", "Finally", "Lock", "Lambda", "Constructor", "Using", "If", "Block"]


def _pick(rows: list[str], key: str):
    return F.element_at(F.array(*map(F.lit, rows)), (F.expr(key) % len(rows) + 1).cast("int"))


#: Lists and the keys that pick from them.
PICKS = {"kind": (KINDS, "l_orderkey"), "name": (CALLS, "l_partkey + l_linenumber * 7"), "receiver": (RECEIVERS, "l_suppkey * 3 + l_partkey"), "type": (TYPES, "l_partkey + l_orderkey * 5"), "text": (TEXTS, "l_suppkey + l_orderkey"), "argument_kind": (ARGUMENTS, "l_partkey + l_linenumber"), "operator": (OPERATORS, "l_suppkey + l_linenumber"), "attributes": (ATTRIBUTES, "l_partkey + l_suppkey"), "returns": (RETURNS, "l_orderkey + l_suppkey")}


def _flag(i: int) -> str:
    return f"(l_partkey * {i + 2} + l_orderkey + l_linenumber) % {i % 4 + 2} = 0"


def nodes(spark, sf):
    """Order lines as nodes: which kind, name, ancestors and attributes follows from their keys."""
    l = table(spark, sf, "lineitem")
    p = {k: _pick(*v) for k, v in PICKS.items()}
    flags = [x for i, f in enumerate(D.FLAGS) for x in (F.lit(f), F.when(F.expr(_flag(i)), "true").otherwise("false"))]
    return l.select(
        F.concat(F.lit("src/"), "l_suppkey").alias("path"), F.col("l_linenumber").alias("line"), p["kind"].alias("kind"), p["name"].alias("name"), F.concat(p["receiver"], F.lit("."), p["name"]).alias("full_name"),
        F.concat(F.lit("C"), F.col("l_partkey") % 50).alias("class"), F.concat(F.lit("M"), F.col("l_partkey") % 7).alias("method"), p["text"].alias("text"), p["returns"].alias("returns"), (F.col("l_linenumber") - 1).alias("depth"),
        F.when(F.col("l_linenumber") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.when(F.col("l_partkey") % 2 == 0, "true").otherwise("x"))).alias("args"),
        F.array_compact(F.array(*[F.when(F.expr(f"(l_suppkey + l_linenumber * {i + 1}) % {len(ANCESTORS)} < 3 AND (l_partkey + {i}) % 3 = 0"), a) for i, a in enumerate(ANCESTORS)])).alias("in_kinds"),
        F.create_map(*[x for k in ("type", "argument_kind", "operator", "attributes") for x in (F.lit(k), p[k])], *flags).alias("attrs"),
    )


def _list(rows: list[str]) -> str:
    return "[" + ", ".join("'" + r.replace("'", "''") + "'" for r in rows) + "]"


_ANCESTOR = {a: f"((l_suppkey + l_linenumber * {i + 1}) % {len(ANCESTORS)} < 3 AND (l_partkey + {i}) % 3 = 0)" for i, a in enumerate(ANCESTORS)}
NODES = (
    "n AS (SELECT 'src/' || l_suppkey AS path, l_linenumber AS line, "
    + ", ".join(f"{_list(v)}[(({k}) % {len(v)} + 1)::INT] AS {c}" for c, (v, k) in PICKS.items())
    + ", 'C' || (l_partkey % 50) AS class, 'M' || (l_partkey % 7) AS method, l_linenumber - 1 AS depth, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE 1 END AS n_args, CASE WHEN l_linenumber % 3 = 0 THEN '' WHEN l_partkey % 2 = 0 THEN 'true' ELSE 'x' END AS first, '' AS bases, "
    + ", ".join(f"{_flag(i)} AS is_{f}" for i, f in enumerate(D.FLAGS))
    + ", "
    + ", ".join("(" + (" OR ".join(_ANCESTOR[a] for a in v if a in _ANCESTOR) or "false") + f") AS {k}" for k, v in D.IN.items())
    + " FROM lineitem)"
)


@query("fact_detectors", f"WITH {NODES}, f AS (" + " UNION ALL ".join(f"SELECT '{i}' AS detector, '{f}' AS family, '{s}' AS severity, '{w}' AS cwe, count(*) AS n, count(DISTINCT path) AS files FROM n WHERE {c}" for i, f, s, w, c in D.DETECTORS) + ") SELECT detector, family, severity, cwe, n, files FROM f WHERE n > 0")
def fact_detectors(spark, sf):
    return D.findings(nodes(spark, sf)).groupBy("detector", "family", "severity", F.coalesce("cwe", F.lit("")).alias("cwe")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("files"))


@query("findings_by_family", f"WITH {NODES}, f AS (" + " UNION ALL ".join(f"SELECT path, '{f}' AS family FROM n WHERE {c}" for _, f, _, _, c in D.DETECTORS) + ") SELECT path, family, count(*) AS n FROM f GROUP BY ALL")
def findings_by_family(spark, sf):
    return D.findings(nodes(spark, sf)).groupBy("path", "family").agg(F.count(F.lit(1)).alias("n"))


@query("repeated_calls", f"WITH {NODES} SELECT path, class, method, text, count(*) AS n FROM n WHERE kind = 'Invocation' GROUP BY ALL HAVING count(*) >= 3")
def repeated_calls(spark, sf):
    return D.repeated_calls(nodes(spark, sf))


@query("unpaired_subscriptions", f"WITH {NODES} SELECT path, class, name, min(line) FILTER (operator = '+=') AS line FROM n WHERE kind = 'Event' GROUP BY ALL HAVING min(line) FILTER (operator = '+=') IS NOT NULL AND count(*) FILTER (operator = '-=') = 0")
def unpaired_subscriptions(spark, sf):
    return D.unpaired_subscriptions(nodes(spark, sf))


@query("growing_collections", f"WITH {NODES}, o AS (SELECT *, CASE WHEN kind = 'Invocation' THEN regexp_extract(receiver || '.' || name, '([^.]+)[.][^.]+$', 1) ELSE name END AS owner FROM (SELECT * REPLACE (CASE WHEN kind = 'Field' THEN 'list' ELSE name END AS name, 'C' AS class, 'src' AS path) FROM n) WHERE kind IN ('Field', 'Invocation')) SELECT path, class, owner AS name, count(*) FILTER (kind = 'Invocation' AND name IN ('Add', 'TryAdd', 'Enqueue', 'Push', 'AddRange')) AS adds FROM o GROUP BY ALL HAVING count(*) FILTER (kind = 'Field' AND is_static AND regexp_matches(type, '^(List|Dictionary|HashSet|Concurrent|Queue|Stack)')) > 0 AND adds > 0 AND count(*) FILTER (kind = 'Invocation' AND name IN ('Remove', 'TryRemove', 'Clear', 'Dequeue', 'Pop', 'RemoveAll', 'RemoveAt')) = 0")
def growing_collections(spark, sf):
    """All lines in one class with one field."""
    n = nodes(spark, sf)
    return D.growing_collections(n.withColumns({"name": F.when(F.col("kind") == "Field", "list").otherwise(F.col("name")), "class": F.lit("C"), "path": F.lit("src")}))


@query("ambiguous_overloads", f"WITH {NODES} SELECT class, name, n_args, count(DISTINCT first) AS overloads FROM n WHERE kind = 'Method' GROUP BY ALL HAVING count(DISTINCT first) > 1")
def ambiguous_overloads(spark, sf):
    return D.ambiguous_overloads(nodes(spark, sf))


@query("test_smells", f"""WITH {NODES}, g AS (SELECT path, class, method, count(*) FILTER (kind <> 'Method') AS inside, count(*) FILTER (kind = 'Invocation' AND name IN ('IsTrue', 'IsFalse', 'AreEqual', 'Equal', 'True', 'False', 'NotNull', 'IsNotNull', 'Contains', 'Throws')) AS asserts,
count(*) FILTER (kind = 'Creation' AND starts_with(type, 'Mock')) AS mocks, count(*) FILTER (kind = 'Invocation' AND name IN ('Verify', 'VerifyAll')) AS verified FROM n WHERE is_test GROUP BY ALL)
SELECT path, class, method, 'EmptyTest' AS smell FROM g WHERE inside = 0 UNION ALL SELECT path, class, method, 'NoAssertions' FROM g WHERE inside > 0 AND asserts = 0 AND verified = 0 UNION ALL SELECT path, class, method, 'OnlyMockVerification' FROM g WHERE asserts = 0 AND verified > 0
UNION ALL SELECT path, class, method, 'ExcessiveAssertions' FROM g WHERE asserts > 10 UNION ALL SELECT path, class, method, 'ExcessiveMocking' FROM g WHERE mocks > 5""")
def test_smells(spark, sf):
    return D.test_smells(nodes(spark, sf))


test_smells.__test__ = False


@query("coupled_classes", f"WITH {NODES} SELECT class, count(DISTINCT type) AS types FROM n WHERE type <> class GROUP BY class HAVING count(DISTINCT type) > 15")
def coupled_classes(spark, sf):
    return D.coupled_classes(nodes(spark, sf), 15)


# Rule functions: a condition and the same over parts.
RULE_FUNCTIONS = {
    "isPublic": "p_partkey % 4 = 0", "isPrivate": "p_partkey % 4 = 1", "isProtected": "p_partkey % 4 = 2", "isInternal": "p_partkey % 4 = 3",
    "isStatic": "p_size % 2 = 0", "isAsync": "p_size % 3 = 0", "isVirtual": "p_size % 5 = 0", "isOverride": "p_size % 7 = 0", "isAbstract": "p_size % 11 = 0",
    "hasAttribute(obsolete)": "p_partkey % 6 = 1", "inNamespace(Brand#1*)": "p_brand LIKE 'Brand#1%'", "inheritsFrom(promo)": "p_type LIKE '%PROMO%'", "implements(I*Foo)": "p_partkey % 10 = 0 AND p_partkey % 9 <> 0",
    "hasParameter(text)": "p_size > 25", "hasParameter(nothing, Int32)": "p_size > 10", "parameterCount(>=2)": "p_size > 25", "lineCount(>30)": "p_size > 30", "complexity(<5)": "p_size % 20 < 5",
    "inTryCatch": "p_size % 6 = 0", "inLoop": "p_size % 6 IN (1, 2)", "inConditional": "p_size % 6 = 3", "isTestMethod": "p_partkey % 6 = 0", "isConstructor": "p_partkey % 5 = 0", "isProperty": "p_partkey % 5 = 1", "isField": "p_partkey % 5 = 2",
    "hasDocComment": "p_partkey % 3 = 0", "returnType(Task*)": "p_size % 4 = 0", "containsCall(gr*)": "(p_name LIKE 'gr%' OR p_name LIKE '% gr%')", "usesType(*#2?)": "p_brand LIKE 'Brand#2_'", "isGeneric": "p_size % 13 = 0", "hasTypeParameter(T*)": "p_size % 13 = 0",
    "isExtensionMethod": "p_size > 25", "isDisposable": "(p_partkey % 9 = 0 OR p_partkey % 10 = 0)", "accessesField(*een)": "(p_name LIKE '%een' OR p_name LIKE '%een %')", "modifiesState": "p_size % 17 = 0", "notInLoop()": "p_size % 6 NOT IN (1, 2)", "notIsPublic()": "p_partkey % 4 <> 0",
}


@query("rule_functions", " UNION ALL ".join(f"SELECT '{f}' AS condition, count(*) AS n FROM part WHERE {c}" for f, c in RULE_FUNCTIONS.items()))
def rule_functions(spark, sf):
    """Every named condition over parts as members."""
    p = table(spark, sf, "part")
    when = lambda c, v: F.when(F.expr(c), v).otherwise("")
    modifiers = F.concat_ws(" ", _pick(["public", "private", "protected", "internal"], "p_partkey"), *[F.when(F.expr(f"p_size % {n} = 0"), m) for m, n in (("static", 2), ("async", 3), ("virtual", 5), ("override", 7), ("abstract", 11))])
    attrs = {
        "modifiers": modifiers, "attributes": F.when(F.expr("p_partkey % 6 = 0"), "Fact").otherwise(when("p_partkey % 6 = 1", "ObsoleteAttribute")), "bases": F.replace("p_type", F.lit(" "), F.lit(";")),
        "interfaces": F.when(F.expr("p_partkey % 9 = 0"), "IDisposable").otherwise(when("p_partkey % 10 = 0", "IAsyncDisposable;IFoo")), "parameters": F.when(F.expr("p_size > 25"), "this String text;Int32 count").otherwise(when("p_size > 10", "Int32 count")),
        "lines": F.col("p_size").cast("string"), "complexity": (F.col("p_size") % 20).cast("string"), "doc": F.expr("string(p_partkey % 3 = 0)"), "calls": F.replace("p_name", F.lit(" "), F.lit(";")), "types": F.col("p_brand"),
        "type_parameters": when("p_size % 13 = 0", "TItem"), "fields": F.replace("p_name", F.lit(" "), F.lit(";")), "writes": when("p_size % 17 = 0", "x"),
    }
    n = p.select(_pick(["Constructor", "Property", "Field", "Method", "Method"], "p_partkey").alias("kind"), F.col("p_brand").alias("namespace"), F.when(F.expr("p_size % 4 = 0"), "Task<int>").otherwise("int").alias("returns"), F.array(_pick(["Try", "For", "Do", "Switch", "Lock", "Block"], "p_size")).alias("in_kinds"), F.when(F.expr("p_size > 25"), 2).when(F.expr("p_size > 10"), 1).otherwise(0).alias("params"), F.create_map(*[x for k, v in attrs.items() for x in (F.lit(k), v)]).alias("attrs"))
    found = n.agg(*[F.count_if(E.condition(f)[0]).alias(str(i)) for i, f in enumerate(RULE_FUNCTIONS)])
    pairs = F.array(*[F.struct(F.lit(f).alias("condition"), F.col(str(i)).alias("n")) for i, f in enumerate(RULE_FUNCTIONS)])
    return found.select(F.explode(pairs).alias("x")).select("x.*")
