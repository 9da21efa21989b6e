"""Detectors: patterns over text, and thresholds over facts about methods and classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of hardcoded configuration values: (identifier, category, severity, pattern, lower-case words of which one must be there).
VALUES = [
    ("ConnectionString", "Configuration", "Critical", r"(?i)Server\s*=|Data Source\s*=|Initial Catalog\s*=|Database\s*=|Integrated Security\s*=|User Id\s*=|Password\s*=", ["="]),
    ("WindowsPath", "Configuration", "Medium", r"[A-Za-z]:\\", [":\\"]),
    ("UnixPath", "Configuration", "Medium", r"(?i)^/[a-z]+/", ["/"]),
    ("HardcodedIp", "Configuration", "Medium", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", ["."]),
    ("HardcodedPort", "Configuration", "Low", r":\d{4,5}\b", [":"]),
    ("Credential", "Security", "Critical", r"""(?i)(password|pwd|passwd|secret|apikey|api_key|token|auth|credential)\s*(=|:)\s*["'][^"']+["']""", ["password", "pwd", "passwd", "secret", "apikey", "api_key", "token", "auth", "credential"]),
    ("UserName", "Security", "High", r"""(?i)(username|user|userid|user_id|login)\s*(=|:)\s*["'][^"']+["']""", ["user", "login"]),
]
# Further detectors of one text each, in the same form. Patterns keep to what RE2 knows, too.
TEXT = [
    *VALUES,
    ("HardcodedUrl", "Configuration", "Medium", r"(?i)\b(https?|ftp)://\w", ["://"]),
    ("AwsKey", "Security", "Critical", r"\bA[KS]IA[A-Z0-9]{16}\b", ["akia", "asia"]),
    ("PrivateKey", "Security", "Critical", r"-----BEGIN [A-Z ]*PRIVATE KEY", ["private key"]),
    ("SignedToken", "Security", "High", r"\beyJ\w{5,}[.]\w+", ["eyj"]),
    ("LongHexSecret", "Security", "Low", r"\b[0-9a-f]{40,64}\b", None),
    ("SqlConcatenation", "Security", "High", r"""(?i)\b(select|insert|update|delete)\b[^;\n]*["'] *\+ *\w""", ["select", "insert", "update", "delete"]),
    ("WeakHash", "Security", "Medium", r"\b(MD5|SHA1)\b", ["md5", "sha1"]),
    ("MailAddress", "Logging", "Medium", r"\w@\w[\w-]*[.]\w", ["@"]),
    ("CardNumber", "Logging", "High", r"\b\d{4} \d{4} \d{4} \d{4}\b|\b\d{16}\b", None),
    ("SocialNumber", "Logging", "High", r"\b\d\d\d-\d\d-\d{4}\b", ["-"]),
    ("PhoneNumber", "Logging", "Low", r"\(\d{3}\) ?\d{3}-\d{4}", ["("]),
    ("ConsoleWrite", "Logging", "Low", r"\bConsole[.]Write", ["console.write"]),
    ("TodoComment", "Documentation", "Low", r"(?i)\b(todo|fixme|hack|xxx)\b", ["todo", "fixme", "hack", "xxx"]),
    ("LicenseLine", "Documentation", "Info", r"(?i)\blicen[sc]ed? under\b|\b(general public|apache|mit) licen[sc]e\b", ["licen"]),
    ("EmptyCatch", "Exceptions", "High", r"\bcatch\b[^{}]*\{\s*\}", ["catch"]),
    ("AsyncVoid", "Concurrency", "High", r"\basync\s+void\b", ["async"]),
    ("BlockingWait", "Concurrency", "High", r"[.]Result\b|[.]Wait\(", [".result", ".wait("]),
    ("ThreadSleep", "Concurrency", "Medium", r"\bThread[.]Sleep\b", ["thread.sleep"]),
    ("LockOnThis", "Concurrency", "High", r"\block *\( *(this|typeof)\b", ["lock"]),
    ("GotoStatement", "Style", "Low", r"\bgoto +\w+;", ["goto"]),
    ("ShoutedText", "Style", "Info", r"[A-Z]{4,}!!", ["!!"]),
    ("RepeatedMarks", "Style", "Info", r"&&&|%%%|\$\$\$|###|\*\*\*", ["&&&", "%%%", "$$$", "###", "***"]),
    ("TableRow", "Style", "Info", r"\w \| \w+ \| ", [" | "]),
    ("Markup", "Style", "Info", r"</?[a-z]+[ >]", ["<"]),
]


def in_text(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, detector, category, severity) of each detector that fires on a text, all of them in one scan.

    A text is searched with an expression only if it has one of its words, for
    which it is brought to lower case once. Null and empty texts fire none.
    """
    low = rows.select(key, F.col(text).alias("_text"), F.lower(F.col(text)).alias("_low"))
    hits = []
    for d, c, s, p, needs in TEXT:
        fires = F.col("_text").rlike(p)
        for_any = None
        for word in needs or []:
            one = F.contains("_low", F.lit(word))
            for_any = one if for_any is None else for_any | one
        hits.append(F.when(fires if for_any is None else for_any & fires, F.struct(F.lit(d).alias("detector"), F.lit(c).alias("category"), F.lit(s).alias("severity"))))
    return low.select(key, F.explode(F.array_compact(F.array(*hits))).alias("d")).select(key, "d.*")


def method_smells(methods: DataFrame) -> DataFrame:
    """(path, name, smell, severity) from (path, name, lines, complexity, nesting, parameters)."""
    lines, cc, deep, n = (F.col(c) for c in ("lines", "complexity", "nesting", "parameters"))
    smell = lambda when, name, severity: F.when(when, F.struct(F.lit(name).alias("smell"), severity.alias("severity")))
    hits = [
        smell(lines > 50, "LongMethod", F.when(lines > 100, "High").otherwise("Medium")),
        smell(cc > 10, "ComplexMethod", F.when(cc > 20, "High").otherwise("Medium")),
        smell(deep > 4, "DeepNesting", F.when(deep > 6, "High").otherwise("Medium")),
        smell(n > 5, "LongParameterList", F.when(n > 8, "High").otherwise("Medium")),
    ]
    return methods.select("path", "name", F.explode(F.array_compact(F.array(*hits))).alias("s")).select("path", "name", "s.*")


def class_smells(classes: DataFrame) -> DataFrame:
    """(name, smell) from (name, methods, fields, lines, lcom4, base_methods, overrides, depth)."""
    c = {x: F.col(x) for x in ("methods", "fields", "lines", "lcom4", "base_methods", "overrides", "depth")}
    smell: list[tuple[Column, str]] = [
        ((c["methods"] > 20) | (c["lines"] > 500), "GodClass"),
        ((c["methods"] <= 2) & (c["fields"] >= 3), "DataClass"),
        (c["lcom4"] > 1, "LowCohesion"),
        (c["depth"] >= 3, "DeepInheritance"),
        ((c["base_methods"] > 5) & (c["overrides"] <= 2), "PreferComposition"),
    ]
    return classes.select("name", F.explode(F.array_compact(F.array(*[F.when(w, s) for w, s in smell]))).alias("smell"))


# Which strategies mend which smell.
STRATEGIES = {"GodClass": ["ExtractClass", "ExtractInterface"], "LongMethod": ["ExtractMethod"], "ComplexMethod": ["SimplifyConditional", "ExtractMethod"], "DeepNesting": ["GuardClauses"], "LongParameterList": ["ParameterObject"], "DataClass": ["MoveMethod"], "LowCohesion": ["ExtractClass"]}


def opportunities(smells: DataFrame) -> DataFrame:
    """Each smell with the strategies that apply, in order."""
    table = F.create_map(*[x for k, v in STRATEGIES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return smells.select("*", F.posexplode(F.element_at(table, F.col("smell"))).alias("step", "strategy"))
