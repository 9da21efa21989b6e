"""Detectors over syntax facts: one condition each, all of them in one scan, and those that need a group or a partner.

A condition is plain SQL over the flat columns that :func:`flat` makes of
``nodes`` (path, line, kind, name, full_name, class, method, text, args, returns,
depth, in_kinds, attrs). A missing flag or list counts as absent, a null name or
text matches nothing, and repeated nodes are found as often as they occur; an
empty table gives no findings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOOPS = ["For", "While", "Foreach", "Do"]
FLAGS = ["async", "static", "public", "sealed", "virtual", "override", "abstract", "readonly", "const", "volatile", "awaited", "event_handler", "test", "disposable", "documented", "value_type"]
IN = {"in_loop": LOOPS, "in_try": ["Try"], "in_catch": ["Catch"], "in_finally": ["Finally"], "in_lock": ["Lock"], "in_lambda": ["Lambda"], "in_ctor": ["Constructor"], "in_using": ["Using"], "in_if": ["If"]}


def flat(nodes: DataFrame) -> DataFrame:
    """Nodes with ancestors and attributes as flags, the receiver, first argument and type names as text."""
    attr = lambda k: F.coalesce(F.element_at("attrs", k), F.lit(""))
    return nodes.select(
        "path", "line", "kind", "name", "class", "method", "text", "returns", "depth",
        F.when(F.instr("full_name", ".") > 0, F.regexp_extract("full_name", "^(.*)[.][^.]*$", 1)).otherwise("").alias("receiver"),
        F.coalesce(F.size("args"), F.lit(0)).alias("n_args"),
        F.coalesce(F.get("args", F.lit(0)), F.lit("")).alias("first"),
        attr("attributes").alias("attributes"), attr("type").alias("type"), attr("bases").alias("bases"), attr("operator").alias("operator"), attr("argument_kind").alias("argument_kind"),
        *[(attr(f) == "true").alias(f"is_{f}") for f in FLAGS],
        *[F.coalesce(F.arrays_overlap("in_kinds", F.array(*map(F.lit, v))), F.lit(False)).alias(k) for k, v in IN.items()],
    )


def call(*names: str) -> str:
    return f"kind = 'Invocation' AND name IN ({', '.join(repr(n) for n in names)})"


def made(*types: str) -> str:
    return f"kind = 'Creation' AND type IN ({', '.join(repr(t) for t in types)})"


def has(column: str, *parts: str) -> str:
    return "(" + " OR ".join(f"{column} LIKE '%{p}%'" for p in parts) + ")"


_OPEN = "argument_kind IN ('concatenation', 'interpolation', 'parameter')"  # not a constant
_CONST = "argument_kind = 'literal'"
_QUERY = ("Where", "Select", "OrderBy", "GroupBy", "Any", "All", "First", "FirstOrDefault", "ToList", "ToArray", "Count", "Sum", "Max", "Min", "Average")
_LOG = ("LogTrace", "LogDebug", "LogInformation", "LogWarning", "LogError", "LogCritical")
_ASSERTS = ("IsTrue", "IsFalse", "AreEqual", "Equal", "True", "False", "NotNull", "IsNotNull", "Contains", "Throws")

#: (identifier, family, severity, CWE or '', condition).
DETECTORS = [
    ("SqlInjection", "Security", "Critical", "CWE-89", f"{call('ExecuteReader', 'ExecuteNonQuery', 'ExecuteScalar', 'ExecuteSqlRaw', 'FromSqlRaw')} AND {_OPEN}"),
    ("SqlCommandText", "Security", "Critical", "CWE-89", f"{made('SqlCommand', 'OleDbCommand', 'OdbcCommand')} AND {_OPEN}"),
    ("CommandInjection", "Security", "Critical", "CWE-78", f"(kind = 'Invocation' AND name = 'Start' AND receiver LIKE '%Process' OR {made('ProcessStartInfo')}) AND {_OPEN}"),
    ("LdapInjection", "Security", "High", "CWE-90", f"{made('DirectorySearcher', 'SearchRequest')} AND {_OPEN}"),
    ("XPathInjection", "Security", "High", "CWE-643", f"{call('SelectNodes', 'SelectSingleNode', 'Evaluate', 'Compile')} AND {_OPEN}"),
    ("LogInjection", "Security", "Medium", "CWE-117", f"{call(*_LOG)} AND {_OPEN}"),
    ("PathTraversal", "Security", "High", "CWE-22", f"{call('ReadAllText', 'ReadAllBytes', 'WriteAllText', 'OpenRead', 'OpenWrite', 'Delete')} AND receiver IN ('File', 'Directory') AND argument_kind <> 'literal'"),
    ("UnsafePathCombination", "Security", "Medium", "CWE-22", f"{call('Combine')} AND receiver LIKE '%Path' AND argument_kind = 'parameter'"),
    ("WeakHash", "Security", "High", "CWE-328", f"({call('Create')} AND receiver IN ('MD5', 'SHA1') OR {made('MD5CryptoServiceProvider', 'SHA1Managed', 'SHA1CryptoServiceProvider')})"),
    ("WeakEncryption", "Security", "High", "CWE-327", f"({call('Create')} AND receiver IN ('DES', 'TripleDES', 'RC2') OR {made('DESCryptoServiceProvider', 'TripleDESCryptoServiceProvider', 'RC2CryptoServiceProvider')})"),
    ("HardcodedKey", "Security", "Critical", "CWE-321", f"kind = 'Assignment' AND {has('name', 'Key')} AND {_CONST}"),
    ("HardcodedIv", "Security", "High", "CWE-329", f"kind = 'Assignment' AND name = 'IV' AND {_CONST}"),
    ("StaticIvField", "Security", "High", "CWE-329", "kind = 'Field' AND is_static AND (name LIKE '%iv' OR name LIKE '%IV')"),
    ("InsecureRandom", "Security", "Medium", "CWE-338", f"{made('Random')} AND {has('method', 'Token', 'Password', 'Key', 'Salt', 'Secret')}"),
    ("PasswordHashWithoutSalt", "Security", "High", "CWE-916", f"{call('ComputeHash', 'HashData')} AND {has('text', 'password', 'Password')}"),
    ("UnsafeDeserialization", "Security", "Critical", "CWE-502", f"({made('BinaryFormatter', 'NetDataContractSerializer', 'SoapFormatter', 'LosFormatter', 'ObjectStateFormatter')} OR {call('Deserialize')} AND {has('receiver', 'BinaryFormatter', 'SoapFormatter')})"),
    ("UnsafeTypeNameHandling", "Security", "Critical", "CWE-502", f"kind = 'Assignment' AND name = 'TypeNameHandling' AND {has('text', 'All', 'Auto', 'Objects')}"),
    ("DynamicTypeDeserialization", "Security", "High", "CWE-502", f"{call('GetType')} AND receiver = 'Type' AND {_OPEN}"),
    ("YamlDeserialization", "Security", "Medium", "CWE-502", f"{made('Deserializer', 'DeserializerBuilder')}"),
    ("MissingAuthorization", "Security", "High", "CWE-862", f"kind = 'Class' AND {has('name', 'Controller')} AND NOT {has('attributes', 'Authorize')} AND NOT {has('attributes', 'AllowAnonymous')}"),
    ("SensitiveAllowAnonymous", "Security", "High", "CWE-862", f"kind = 'Method' AND {has('attributes', 'AllowAnonymous')} AND {has('name', 'Delete', 'Admin', 'Update', 'Remove')}"),
    ("MissingAntiforgery", "Security", "High", "CWE-352", f"kind = 'Method' AND {has('attributes', 'HttpPost', 'HttpPut', 'HttpDelete')} AND NOT {has('attributes', 'ValidateAntiForgeryToken')}"),
    ("HardcodedPassword", "Security", "Critical", "CWE-798", f"kind = 'Binary' AND operator = '==' AND {has('text', 'assword', 'pwd')} AND {_CONST}"),
    ("WeakPasswordPolicy", "Security", "Medium", "CWE-521", "kind = 'Assignment' AND name IN ('RequireDigit', 'RequireUppercase', 'RequireNonAlphanumeric', 'RequireLowercase') AND text LIKE '%false%'"),
    ("CookieWithoutHttpOnly", "Security", "Medium", "CWE-1004", "kind = 'Assignment' AND name = 'HttpOnly' AND text LIKE '%false%'"),
    ("CookieWithoutSecure", "Security", "Medium", "CWE-614", "kind = 'Assignment' AND name = 'Secure' AND text LIKE '%false%'"),
    ("CookieSameSiteNone", "Security", "Medium", "CWE-352", "kind = 'Assignment' AND name = 'SameSite' AND text LIKE '%None%'"),
    ("JwtLifetimeUnchecked", "Security", "High", "CWE-613", "kind = 'Assignment' AND name = 'ValidateLifetime' AND text LIKE '%false%'"),
    ("JwtSignatureUnchecked", "Security", "Critical", "CWE-347", "kind = 'Assignment' AND name IN ('ValidateIssuerSigningKey', 'RequireSignedTokens') AND text LIKE '%false%'"),
    ("CertificateUnchecked", "Security", "Critical", "CWE-295", "kind = 'Assignment' AND name IN ('ServerCertificateValidationCallback', 'ServerCertificateCustomValidationCallback') AND text LIKE '%true%'"),
    ("InsecureCors", "Security", "High", "CWE-346", f"{call('AllowAnyOrigin', 'SetIsOriginAllowed')}"),
    ("OpenRedirect", "Security", "Medium", "CWE-601", f"{call('Redirect', 'RedirectPermanent')} AND argument_kind = 'parameter'"),
    ("SessionIdInUrl", "Security", "High", "CWE-384", f"kind = 'Literal' AND {has('text', 'sessionid=', 'sid=')}"),
    ("AsyncVoid", "Concurrency", "High", "", "kind = 'Method' AND is_async AND returns = 'void' AND NOT is_event_handler"),
    ("AsyncVoidLambda", "Concurrency", "High", "", "kind = 'Lambda' AND is_async AND returns = 'void'"),
    ("AsyncVoidReentrancy", "Concurrency", "High", "CWE-362", "kind = 'Assignment' AND is_async AND returns = 'void' AND NOT in_lock"),
    ("TaskResult", "Concurrency", "High", "", "kind = 'MemberAccess' AND name = 'Result'"),
    ("TaskWait", "Concurrency", "High", "", call("Wait", "WaitAll", "WaitAny")),
    ("GetAwaiterGetResult", "Concurrency", "High", "", "kind = 'Invocation' AND name = 'GetResult' AND receiver LIKE '%GetAwaiter%'"),
    ("SyncOverAsync", "Concurrency", "High", "", f"{call('Wait', 'GetResult')} AND is_async"),
    ("FloatingTask", "Concurrency", "Medium", "", "kind = 'Invocation' AND name LIKE '%Async' AND NOT is_awaited"),
    ("MissingConfigureAwait", "Concurrency", "Low", "", "kind = 'Await' AND text NOT LIKE '%ConfigureAwait%'"),
    ("UnnecessaryAsync", "Concurrency", "Low", "", "kind = 'Method' AND is_async AND NOT is_awaited AND returns <> 'void'"),
    ("LockOnThis", "Concurrency", "High", "CWE-667", "kind = 'Lock' AND text LIKE '%(this)%'"),
    ("LockOnType", "Concurrency", "High", "CWE-667", "kind = 'Lock' AND text LIKE '%typeof%'"),
    ("LockOnString", "Concurrency", "High", "CWE-667", "kind = 'Lock' AND type = 'string'"),
    ("LockOnNewObject", "Concurrency", "Critical", "CWE-667", "kind = 'Lock' AND text LIKE '%(new %'"),
    ("LockOnValueType", "Concurrency", "Critical", "CWE-667", "kind = 'Lock' AND is_value_type"),
    ("NestedLocks", "Concurrency", "High", "CWE-667", "kind = 'Lock' AND in_lock"),
    ("NonAtomicIncrement", "Concurrency", "Medium", "CWE-366", "kind = 'Increment' AND is_static AND NOT in_lock"),
    ("NonAtomicCompound", "Concurrency", "Medium", "CWE-366", "kind = 'Assignment' AND operator IN ('+=', '-=', '*=', '/=') AND is_static AND NOT in_lock"),
    ("CheckThenAct", "Concurrency", "High", "CWE-362", f"{call('Add', 'Remove')} AND in_if AND is_static AND NOT in_lock"),
    ("DoubleCheckWithoutVolatile", "Concurrency", "High", "CWE-609", "kind = 'If' AND in_lock AND in_if AND NOT is_volatile"),
    ("MutableStaticField", "Concurrency", "Medium", "", "kind = 'Field' AND is_static AND NOT is_readonly AND NOT is_const"),
    ("TaskRunInConstructor", "Concurrency", "Medium", "", f"{call('Run', 'StartNew')} AND in_ctor"),
    ("ThreadSleep", "Concurrency", "Low", "", "kind = 'Invocation' AND name = 'Sleep' AND receiver LIKE '%Thread'"),
    ("EmptyCatch", "Exceptions", "High", "", "kind = 'Catch' AND depth = 0"),
    ("GenericCatch", "Exceptions", "Medium", "", "kind = 'Catch' AND type IN ('Exception', 'System.Exception', '')"),
    ("RethrowLosesStackTrace", "Exceptions", "High", "", "kind = 'Throw' AND in_catch AND argument_kind = 'variable'"),
    ("LostInnerException", "Exceptions", "Medium", "", "kind = 'Throw' AND in_catch AND argument_kind = 'creation' AND n_args < 2"),
    ("ThrowInFinally", "Exceptions", "High", "", "kind = 'Throw' AND in_finally"),
    ("CatchAndReturn", "Exceptions", "Medium", "", "kind = 'Return' AND in_catch"),
    ("LinqInLoop", "Performance", "Medium", "", f"{call(*_QUERY)} AND in_loop"),
    ("LinqMaterializationInLoop", "Performance", "Medium", "", f"{call('ToList', 'ToArray', 'ToDictionary')} AND in_loop"),
    ("LinqCountToAny", "Performance", "Low", "", "kind = 'Binary' AND operator IN ('>', '>=', '==', '!=') AND text LIKE '%.Count()%'"),
    ("LinqWhereFirst", "Performance", "Low", "", f"{call('First', 'FirstOrDefault', 'Single', 'SingleOrDefault', 'Any')} AND receiver LIKE '%.Where'"),
    ("LinqWhereCount", "Performance", "Low", "", f"{call('Count')} AND receiver LIKE '%.Where'"),
    ("LinqOrderByFirst", "Performance", "Low", "", f"{call('First', 'FirstOrDefault')} AND (receiver LIKE '%.OrderBy' OR receiver LIKE '%.OrderByDescending')"),
    ("ListContainsInLoop", "Performance", "Medium", "", f"{call('Contains')} AND in_loop AND type LIKE 'List%'"),
    ("StringConcatInLoop", "Performance", "Medium", "", "kind = 'Assignment' AND operator = '+=' AND type = 'string' AND in_loop"),
    ("CollectionWithoutCapacity", "Performance", "Info", "", "kind = 'Creation' AND (type LIKE 'Dictionary%' OR type LIKE 'List%') AND n_args = 0 AND in_loop"),
    ("RegexInLoop", "Performance", "Medium", "", f"{made('Regex')} AND in_loop"),
    ("StaticRegexCall", "Performance", "Low", "", f"{call('IsMatch', 'Match', 'Replace', 'Split')} AND receiver = 'Regex'"),
    ("ReflectionInLoop", "Performance", "Medium", "", f"{call('GetMethod', 'GetProperty', 'GetField', 'GetCustomAttributes')} AND in_loop"),
    ("ArrayAllocationInLoop", "Performance", "Medium", "", "kind = 'Creation' AND type LIKE '%[]' AND in_loop"),
    ("ClosureInLoop", "Performance", "Low", "", "kind = 'Lambda' AND in_loop"),
    ("BoxingInCollection", "Performance", "Low", "", f"{made('ArrayList', 'Hashtable', 'Queue', 'Stack')}"),
    ("StringFormat", "Modernize", "Info", "", "kind = 'Invocation' AND name = 'Format' AND receiver IN ('string', 'String')"),
    ("CaseInsensitiveComparison", "Modernize", "Low", "", f"kind = 'Binary' AND operator = '==' AND {has('text', '.ToLower()', '.ToUpper()')}"),
    ("ReplaceChain", "Modernize", "Info", "", f"{call('Replace')} AND receiver LIKE '%.Replace%'"),
    ("NullConditional", "Modernize", "Info", "", "kind = 'If' AND text LIKE '%!= null%'"),
    ("NullCoalescingAssignment", "Modernize", "Info", "", "kind = 'If' AND text LIKE '%== null%' AND depth <= 1"),
    ("PatternMatchingIs", "Modernize", "Info", "", "kind = 'Cast' AND in_if"),
    ("GetTypeEqualsTypeof", "Modernize", "Info", "", "kind = 'Binary' AND operator = '==' AND text LIKE '%GetType()%'"),
    ("HeavyStaticConstructor", "Modernize", "Low", "", "kind = 'Constructor' AND is_static AND depth > 3"),
    ("EagerInitialization", "Modernize", "Info", "", "kind = 'Field' AND is_static AND is_readonly AND argument_kind = 'creation'"),
    ("ClosureCaptureLeak", "Memory", "Medium", "CWE-401", "kind = 'Lambda' AND text LIKE '%this.%' AND is_event_handler"),
    ("LargeArrayInLoop", "Memory", "High", "CWE-401", "kind = 'Creation' AND type IN ('byte[]', 'char[]') AND in_loop AND argument_kind = 'literal'"),
    ("UnboundedCache", "Memory", "High", "CWE-401", f"kind = 'Field' AND {has('type', 'Dictionary')} AND {has('name', 'cache', 'Cache')} AND is_static"),
    ("DisposableNotDisposed", "Memory", "High", "", "kind = 'Creation' AND is_disposable AND NOT in_using"),
    ("NPlusOneQuery", "Data", "High", "", f"{call('First', 'FirstOrDefault', 'Find', 'FindAsync', 'ToList')} AND receiver LIKE '%ontext%' AND in_loop"),
    ("MissingAsNoTracking", "Data", "Low", "", f"{call('ToList', 'ToListAsync')} AND receiver LIKE '%ontext%' AND text NOT LIKE '%AsNoTracking%'"),
    ("ClientEvaluation", "Data", "Medium", "", f"{call('Where', 'Select')} AND (receiver LIKE '%.ToList' OR receiver LIKE '%.AsEnumerable')"),
    ("VerbMismatch", "Api", "Medium", "", "kind = 'Method' AND (attributes LIKE '%HttpGet%' AND (name LIKE 'Create%' OR name LIKE 'Delete%' OR name LIKE 'Update%') OR attributes LIKE '%HttpPost%' AND name LIKE 'Get%')"),
    ("MissingResponseType", "Api", "Low", "", f"kind = 'Method' AND {has('attributes', 'Http')} AND NOT {has('attributes', 'ProducesResponseType')}"),
    ("DeprecatedWithoutReplacement", "Api", "Medium", "", "kind IN ('Method', 'Class') AND attributes LIKE '%Obsolete%' AND n_args = 0"),
    ("MissingAsyncSuffix", "Naming", "Low", "", "kind = 'Method' AND is_async AND name NOT LIKE '%Async' AND NOT is_event_handler AND NOT is_test"),
    ("AsyncSuffixNotAsync", "Naming", "Low", "", "kind = 'Method' AND NOT is_async AND name LIKE '%Async' AND returns NOT LIKE 'Task%'"),
    ("BooleanPredicateReturnType", "Naming", "Low", "", "kind = 'Method' AND (name LIKE 'Is%' OR name LIKE 'Has%' OR name LIKE 'Can%') AND returns NOT IN ('bool', 'Task<bool>')"),
    ("GetterReturnsVoid", "Naming", "Low", "", "kind = 'Method' AND name LIKE 'Get%' AND returns = 'void'"),
    ("CreatorReturnsVoid", "Naming", "Low", "", "kind = 'Method' AND (name LIKE 'Create%' OR name LIKE 'Build%') AND returns = 'void'"),
    ("MissingPublicDoc", "Documentation", "Low", "", "kind IN ('Class', 'Method', 'Property', 'Event', 'Delegate') AND is_public AND NOT is_documented"),
    ("LogStringConcat", "Logging", "Low", "", f"{call(*_LOG)} AND argument_kind IN ('concatenation', 'interpolation')"),
    ("LogLevelInCatch", "Logging", "Medium", "", f"{call('LogTrace', 'LogDebug', 'LogInformation')} AND in_catch"),
    ("VerboseLogInLoop", "Logging", "Low", "", f"{call('LogTrace', 'LogDebug')} AND in_loop"),
    ("SensitiveDataLogged", "Logging", "High", "CWE-532", f"{call(*_LOG)} AND {has('text', 'assword', 'oken', 'ecret')}"),
    ("Registry", "Platform", "Medium", "", "kind = 'MemberAccess' AND receiver IN ('Registry', 'RegistryKey')"),
    ("PInvoke", "Platform", "Medium", "", "kind = 'Method' AND attributes LIKE '%DllImport%'"),
    ("ComInterop", "Platform", "Medium", "", f"kind IN ('Class', 'Interface') AND {has('attributes', 'ComImport', 'ComVisible')}"),
    ("TrueOnlyAssertion", "Testing", "Low", "", f"{call('IsTrue', 'True')} AND is_test AND first = 'true'"),
    ("WeakAssertion", "Testing", "Low", "", f"{call('NotNull', 'IsNotNull')} AND is_test"),
    ("SleepInTest", "Testing", "Medium", "", f"{call('Sleep', 'Delay')} AND is_test"),
    ("ClockInTest", "Testing", "Medium", "", "kind = 'MemberAccess' AND name IN ('Now', 'UtcNow') AND is_test"),
    ("IgnoredTest", "Testing", "Low", "", f"kind = 'Method' AND {has('attributes', 'Ignore', 'Skip')}"),
    ("StaticDependency", "Design", "Low", "", "kind = 'MemberAccess' AND receiver IN ('DateTime', 'File', 'Environment', 'ConfigurationManager') AND NOT is_test"),
    ("MutablePublicCollection", "Design", "Medium", "", "kind = 'Field' AND is_public AND NOT is_readonly AND (type LIKE 'List%' OR type LIKE 'Dictionary%' OR type LIKE '%[]')"),
    ("VirtualCallInConstructor", "Design", "High", "", "kind = 'Invocation' AND in_ctor AND is_virtual"),
    ("BooleanParameters", "Design", "Low", "", "kind = 'Parameter' AND type = 'bool' AND is_public"),
    ("NullReturn", "Safety", "Medium", "", "kind = 'Return' AND text LIKE '%null%' AND is_public"),
    ("CouldBeReadonly", "Safety", "Info", "", "kind = 'Field' AND NOT is_readonly AND NOT is_const AND in_ctor"),
    ("NullPrecondition", "Contracts", "Info", "", f"{call('ThrowIfNull', 'ThrowIfNullOrEmpty')} AND argument_kind = 'parameter'"),
    ("RangePrecondition", "Contracts", "Info", "", f"kind = 'Throw' AND in_if AND type = 'ArgumentOutOfRangeException'"),
    ("StatePrecondition", "Contracts", "Info", "", f"kind = 'Throw' AND in_if AND type IN ('InvalidOperationException', 'ObjectDisposedException')"),
    ("SideEffect", "Contracts", "Info", "", f"(kind = 'Assignment' AND is_static OR {call('WriteLine', 'WriteAllText', 'SaveChanges', 'SendAsync')})"),
]


def findings(nodes: DataFrame) -> DataFrame:
    """(path, line, detector, family, severity, cwe) of all conditions, from one scan."""
    hits = [F.when(F.expr(c), F.struct(F.lit(i).alias("detector"), F.lit(f).alias("family"), F.lit(s).alias("severity"), F.lit(w or None).cast("string").alias("cwe"))) for i, f, s, w, c in DETECTORS]
    return flat(nodes).select("path", "line", F.explode(F.array_compact(F.array(*hits))).alias("d")).select("path", "line", "d.*")


def repeated_calls(nodes: DataFrame, least: int = 3) -> DataFrame:
    """(path, class, method, text, n): calls that a method makes ``least`` times or more in the same words."""
    calls = nodes.where("kind = 'Invocation' AND text IS NOT NULL")
    return calls.groupBy("path", "class", "method", "text").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def unpaired_subscriptions(nodes: DataFrame) -> DataFrame:
    """(path, class, name, line): events that a class subscribes to (``+=``) and nowhere leaves (``-=``), by the first place."""
    act = F.element_at("attrs", "operator")
    seen = nodes.where("kind = 'Event'").groupBy("path", "class", "name").agg(F.min(F.when(act == "+=", F.col("line"))).alias("line"), F.count_if(act == "-=").alias("left"))
    return seen.where("line IS NOT NULL AND left = 0").select("path", "class", "name", "line")


def growing_collections(nodes: DataFrame) -> DataFrame:
    """(path, class, name): static collections that a class adds to and never removes from or clears."""
    field = (F.col("kind") == "Field") & (F.element_at("attrs", "static") == "true") & F.element_at("attrs", "type").rlike("^(List|Dictionary|HashSet|Concurrent|Queue|Stack)")
    owner = F.when(F.col("kind") == "Invocation", F.regexp_extract("full_name", "([^.]+)[.][^.]+$", 1)).otherwise(F.col("name"))
    acts = nodes.where("kind IN ('Field', 'Invocation')").withColumn("owner", owner)
    verb = lambda *v: (F.col("kind") == "Invocation") & F.col("name").isin(*v)
    g = acts.groupBy("path", "class", "owner").agg(F.count_if(field).alias("fields"), F.count_if(verb("Add", "TryAdd", "Enqueue", "Push", "AddRange")).alias("adds"), F.count_if(verb("Remove", "TryRemove", "Clear", "Dequeue", "Pop", "RemoveAll", "RemoveAt")).alias("removes"))
    return g.where("fields > 0 AND adds > 0 AND removes = 0").select("path", "class", F.col("owner").alias("name"), "adds")


def ambiguous_overloads(nodes: DataFrame) -> DataFrame:
    """(class, name, n_args, overloads): methods of a class that share name and number of arguments."""
    m = nodes.where("kind = 'Method'").select("class", "name", F.coalesce(F.size("args"), F.lit(0)).alias("n_args"), F.array_join("args", ",").alias("signature"))
    return m.groupBy("class", "name", "n_args").agg(F.count_distinct("signature").alias("overloads")).where("overloads > 1")


def test_smells(nodes: DataFrame, assertions: int = 10, mocks: int = 5) -> DataFrame:
    """(path, class, method, smell) of test methods by what they call: nothing, no assertion, too many, too many mocks."""
    own = nodes.where(F.element_at("attrs", "test") == "true")
    calls = F.col("kind") == "Invocation"
    g = own.groupBy("path", "class", "method").agg(F.count_if(F.col("kind") != "Method").alias("inside"), F.count_if(calls & F.col("name").isin(*_ASSERTS)).alias("asserts"), F.count_if((F.col("kind") == "Creation") & F.coalesce(F.element_at("attrs", "type"), F.lit("")).startswith("Mock")).alias("mocks"), F.count_if(calls & F.col("name").isin("Verify", "VerifyAll")).alias("verified"))
    smell = [F.when(F.expr(c), s) for s, c in (("EmptyTest", "inside = 0"), ("NoAssertions", "inside > 0 AND asserts = 0 AND verified = 0"), ("OnlyMockVerification", "asserts = 0 AND verified > 0"), ("ExcessiveAssertions", f"asserts > {assertions}"), ("ExcessiveMocking", f"mocks > {mocks}"))]
    return g.select("path", "class", "method", F.explode(F.array_compact(F.array(*smell))).alias("smell"))


test_smells.__test__ = False  # a function about tests, not one


def coupled_classes(nodes: DataFrame, most: int = 20) -> DataFrame:
    """(class, types): classes that use more than ``most`` other types."""
    t = nodes.select("class", F.element_at("attrs", "type").alias("type")).where("class IS NOT NULL AND type IS NOT NULL AND type != '' AND type != class")
    return t.groupBy("class").agg(F.count_distinct("type").alias("types")).where(F.col("types") > most)
