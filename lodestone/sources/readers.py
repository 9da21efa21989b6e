"""Readers of what code tools write: coverage, configuration, packages, version control, snapshots.

All use Spark's own readers, so files of a folder are read in parallel and
bad files or rows are skipped, not fatal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import generated, normal_key, sensitive_key

# Formats of coverage reports and what their text contains.
COVERAGE_FORMATS = {"OpenCover": "<CoverageSession", "DotCover": "<Root CoveredStatements", "Cobertura": "<coverage ", "Coverlet": '"Modules"'}


def files(spark: SparkSession, root: str, pattern: str = "*.cs") -> DataFrame:
    """(path, content, mtime, size) of a tree's files, without build folders and generated files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return raw.where(~F.lower("path").rlike("/(obj|bin)/") & ~generated(F.col("path"))).select("path", F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): each file as one row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def coverage_format(content: Column) -> Column:
    out = None
    for name, mark in COVERAGE_FORMATS.items():
        out = F.when(content.contains(mark), name) if out is None else out.when(content.contains(mark), name)
    return out.otherwise("Unknown")


def cobertura(spark: SparkSession, path: str) -> DataFrame:
    """(class, file, method, line, hits, branches, branches_covered) of Cobertura reports' methods."""
    schema = "_name string, _filename string, methods struct<method array<struct<_name string, lines struct<line array<struct<_number int, _hits int, `_condition-coverage` string>>>>>>"
    rows = spark.read.format("xml").option("rowTag", "class").schema(schema).load(path)
    m = rows.select(F.col("_name").alias("class"), F.col("_filename").alias("file"), F.explode("methods.method").alias("m"))
    x = m.select("class", "file", F.col("m._name").alias("method"), F.explode("m.lines.line").alias("x"))
    part = lambda i: F.coalesce(F.regexp_extract("x.`_condition-coverage`", r"\(([0-9]+)/([0-9]+)\)", i).try_cast("int"), F.lit(0))
    return x.select("class", "file", "method", F.col("x._number").alias("line"), F.col("x._hits").alias("hits"), part(2).alias("branches"), part(1).alias("branches_covered"))


def opencover(spark: SparkSession, path: str) -> DataFrame:
    """(module, class, method, line, hits) of OpenCover reports; skipped modules and compiler-made names go, the last hit of a line counts."""
    point = "array<struct<_sl int, _vc int>>"
    schema = f"_skippedDueTo string, ModuleName string, Classes struct<Class array<struct<FullName string, Methods struct<Method array<struct<Name string, SequencePoints struct<SequencePoint {point}>>>>>>>"
    rows = spark.read.format("xml").option("rowTag", "Module").schema(schema).load(path).where("_skippedDueTo is null")
    c = rows.select(F.col("ModuleName").alias("module"), F.explode("Classes.Class").alias("c")).where(~F.col("c.FullName").startswith("<"))
    m = c.select("module", F.col("c.FullName").alias("class"), F.explode("c.Methods.Method").alias("m"))
    x = m.select("module", "class", F.col("m.Name").alias("method"), F.posexplode("m.SequencePoints.SequencePoint").alias("at", "x"))
    return x.groupBy("module", "class", "method", F.col("x._sl").alias("line")).agg(F.max_by("x._vc", "at").alias("hits"))


def coverlet(spark: SparkSession, path: str) -> DataFrame:
    """(module, file, class, method, line, hits) of Coverlet's JSON: maps in maps."""
    schema = "map<string, map<string, map<string, map<string, struct<Lines map<string, int>, Branches array<struct<Line int, Hits int>>>>>>>"
    x = texts(spark, path).select(F.explode(F.from_json("content", schema)).alias("module", "files"))
    x = x.select("module", F.explode("files").alias("file", "classes")).select("module", "file", F.explode("classes").alias("class", "methods"))
    x = x.select("module", "file", "class", F.explode("methods").alias("method", "m"))
    return x.select("module", "file", "class", "method", F.explode("m.Lines").alias("line", "hits")).withColumn("line", F.col("line").cast("int"))


def coverage_summary(points: DataFrame, keys: list[str]) -> DataFrame:
    """Lines and covered lines of each key, with a percentage (0 without lines)."""
    g = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("hits") > 0).alias("covered"))
    return g.withColumn("percent", F.when(F.col("lines") > 0, F.col("covered") * 100.0 / F.col("lines")).otherwise(0.0))


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): the lines of one small file, also of a hidden one, which Spark's readers pass over; read by the driver from any store."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        text = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
    finally:
        stream.close()
    return spark.createDataFrame([(path, x) for x in text.splitlines()], "path string, value string")


def env_config(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, value, sensitive) of ``KEY=VALUE`` lines: at the first ``=``, without quotes, comments and blank lines."""
    x = lines_of(spark, path).select("path", F.trim("value").alias("x")).where("x != '' and not startswith(x, '#') and instr(x, '=') > 1")
    value = F.trim(F.expr("substring(x, instr(x, '=') + 1)"))
    key = normal_key(F.substring_index("x", "=", 1))
    return x.select("path", key.alias("key"), F.regexp_replace(value, "^([\"'])(.*)\\1$", "$2").alias("value"), sensitive_key(key).alias("sensitive"))


def json_config(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, value, sensitive) of JSON settings flattened to ``A:B:0``; null values go; levels are opened until none is left."""
    level = texts(spark, path).select("path", F.lit("").alias("key"), F.try_parse_json("content").alias("v")).where("v is not null")
    done = None
    while True:
        kind = F.schema_of_variant("v")
        leaf = level.where(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY") & (kind != "VOID")).select("path", "key", F.try_variant_get("v", "$", "string").alias("value"))
        done = leaf if done is None else done.unionByName(leaf)
        if not level.where(~leaf_kind(kind)).limit(1).count():
            break
        level = _opened(level)
    sens = sensitive_key(F.col("key")) & (F.length("value") > 3)
    return done.select("path", F.substring("key", 2, 100_000).alias("key"), "value", sens.alias("sensitive"))


def leaf_kind(kind: Column) -> Column:
    return ~kind.startswith("OBJECT<") & ~kind.startswith("ARRAY<")


def _opened(level: DataFrame) -> DataFrame:
    """One level of objects and arrays: a row for each member, its name or place added to the key."""
    level.createOrReplaceTempView("_json_level")
    return level.sparkSession.sql("SELECT l.path, concat(l.key, ':', coalesce(e.key, string(e.pos))) AS key, e.value AS v FROM _json_level l, LATERAL variant_explode(l.v) e WHERE schema_of_variant(l.v) LIKE 'OBJECT%' OR schema_of_variant(l.v) LIKE 'ARRAY%'")


def xml_config(spark: SparkSession, path: str) -> DataFrame:
    """(key, value, sensitive) of application settings and connection strings."""
    add = spark.read.format("xml").option("rowTag", "add").schema("_key string, _value string, _name string, _connectionString string").load(path)
    key = F.coalesce("_key", F.concat(F.lit("ConnectionStrings:"), "_name"))
    return add.select(key.alias("key"), F.coalesce("_value", "_connectionString").alias("value"), (sensitive_key(key) | F.col("_connectionString").isNotNull()).alias("sensitive")).where("key is not null")


def package_references(spark: SparkSession, path: str) -> DataFrame:
    """(package, version) of project files; the version as attribute, element or ``*``."""
    r = spark.read.format("xml").option("rowTag", "PackageReference").schema("_Include string, _Update string, _Version string, Version string").load(path)
    return r.select(F.coalesce("_Include", "_Update").alias("package"), F.coalesce("_Version", "Version", F.lit("*")).alias("version")).where("package is not null")


def packages_config(spark: SparkSession, path: str) -> DataFrame:
    r = spark.read.format("xml").option("rowTag", "package").schema("_id string, _version string").load(path)
    return r.where("_id is not null and _version is not null").select(F.col("_id").alias("package"), F.col("_version").alias("version"))


def solution_projects(spark: SparkSession, path: str) -> DataFrame:
    """(name, project) of a solution file's lines."""
    rx = r'^Project\("[^"]*"\)\s*=\s*"([^"]*)",\s*"([^"]*proj)"'
    return spark.read.text(path).where(F.col("value").rlike(rx)).select(F.regexp_extract("value", rx, 1).alias("name"), F.replace(F.regexp_extract("value", rx, 2), F.lit("\\"), F.lit("/")).alias("project"))


def lock_file(spark: SparkSession, path: str) -> DataFrame:
    """(package, resolved, direct, dependency) of lock files; of all frameworks a package's first one counts."""
    schema = "dependencies map<string, map<string, struct<type string, resolved string, dependencies map<string, string>>>>"
    x = texts(spark, path).select(F.from_json("content", schema).alias("j")).select(F.posexplode(F.map_entries("j.dependencies")).alias("at", "f"))
    x = x.select("at", F.explode("f.value").alias("package", "p"))
    one = x.groupBy("package").agg(F.min_by("p", "at").alias("p"))
    return one.select("package", F.col("p.resolved").alias("resolved"), (F.col("p.type") == "Direct").alias("direct"), F.explode_outer(F.map_keys("p.dependencies")).alias("dependency"))


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """(hash, subject, author, ts) of lines ``hash|subject|author|date``; fewer than four parts are no commit, further bars belong to the subject."""
    p = F.split("value", "\\|")
    n = F.size(p)
    x = spark.read.text(path).where(n >= 4)
    return x.select(p[0].alias("hash"), F.array_join(F.slice(p, 2, n - 3), "|").alias("subject"), F.element_at(p, -2).alias("author"), F.element_at(p, -1).try_cast("timestamp").alias("ts"))


def git_numstat(spark: SparkSession, path: str) -> DataFrame:
    """(path, added, deleted) of numstat lines; a binary file's ``-`` counts as 0."""
    p = F.split("value", "\t")
    x = spark.read.text(path).where(F.size(p) == 3)
    return x.select(p[2].alias("path"), F.coalesce(p[0].try_cast("long"), F.lit(0)).alias("added"), F.coalesce(p[1].try_cast("long"), F.lit(0)).alias("deleted"))


def git_stat(line: Column) -> Column:
    """(files, insertions, deletions) of a summary line."""
    n = lambda rx: F.coalesce(F.regexp_extract(line, rx, 1).try_cast("int"), F.lit(0))
    return F.struct(n(r"([0-9]+) files? changed").alias("files"), n(r"([0-9]+) insertion").alias("insertions"), n(r"([0-9]+) deletion").alias("deletions"))


def snapshots(spark: SparkSession, path: str, schema: str, since: str | None = None) -> DataFrame:
    """Metric snapshots newer than ``since`` in order of time; bad files are skipped."""
    s = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", "true").json(path).where("ts is not null")
    return (s.where(F.col("ts") >= F.lit(since).cast("timestamp")) if since else s).orderBy("ts")


def dotcover_xml(spark: SparkSession, path: str) -> DataFrame:
    """(assembly, namespace, type, method, covered, total) of the statements that a method's report counts."""
    method = "array<struct<_Name string, _CoveredStatements long, _TotalStatements long>>"
    schema = f"_Name string, Namespace array<struct<_Name string, Type array<struct<_Name string, Method {method}>>>>"
    a = spark.read.format("xml").option("rowTag", "Assembly").schema(schema).load(path)
    n = a.select(F.col("_Name").alias("assembly"), F.explode("Namespace").alias("n")).select("assembly", F.col("n._Name").alias("namespace"), F.explode("n.Type").alias("t"))
    return n.select("assembly", "namespace", F.col("t._Name").alias("type"), F.explode("t.Method").alias("m")).select("assembly", "namespace", "type", F.col("m._Name").alias("method"), F.col("m._CoveredStatements").alias("covered"), F.col("m._TotalStatements").alias("total"))


def dotcover_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, covered, total) of every node of the tree, ``path`` being its names from the root, joined by slashes."""
    level = texts(spark, path).select(F.lit("").alias("path"), F.try_parse_json("content").alias("v")).where("v is not null")
    out = None
    while True:
        get = lambda k, t: F.try_variant_get("v", f"$.{k}", t)
        level = level.select(F.concat_ws("/", F.nullif("path", F.lit("")), get("Name", "string")).alias("path"), "v")
        rows = level.select("path", get("Kind", "string").alias("kind"), get("CoveredStatements", "long").alias("covered"), get("TotalStatements", "long").alias("total"))
        out = rows if out is None else out.unionByName(rows)
        level = level.select("path", F.explode(F.try_variant_get("v", "$.Children", "array<variant>")).alias("v"))
        if not level.limit(1).count():
            return out


def assets_file(spark: SparkSession, path: str) -> DataFrame:
    """(package, version, dependency) of an assets file's first target framework."""
    x = texts(spark, path).select(F.from_json("content", "targets map<string, map<string, struct<type string, dependencies map<string, string>>>>").alias("j"))
    first = x.select(F.get(F.map_entries("j.targets"), F.lit(0))["value"].alias("p"))
    p = first.select(F.explode("p").alias("id", "p"))
    return p.select(F.substring_index("id", "/", 1).alias("package"), F.substring_index("id", "/", -1).alias("version"), F.explode_outer(F.map_keys("p.dependencies")).alias("dependency"))


def central_versions(spark: SparkSession, path: str) -> DataFrame:
    """(package, version) of a central version file."""
    r = spark.read.format("xml").option("rowTag", "PackageVersion").schema("_Include string, _Version string").load(path)
    return r.where("_Include is not null").select(F.col("_Include").alias("package"), F.col("_Version").alias("version"))


def with_central_versions(references: DataFrame, central: DataFrame) -> DataFrame:
    """References whose version is ``*`` take the central one, where there is one."""
    c = central.select("package", F.col("version").alias("central"))
    return references.join(c, "package", "left").select("package", F.when(F.col("version") == "*", F.coalesce("central", "version")).otherwise(F.col("version")).alias("version"))


def advisories(known: DataFrame, fetched: DataFrame) -> DataFrame:
    """Both tables' advisories (package, id, severity), an identifier once; the known one comes first."""
    both = known.withColumn("_from", F.lit(0)).unionByName(fetched.withColumn("_from", F.lit(1)))
    return both.groupBy("package", "id").agg(F.min_by("severity", "_from").alias("severity"))


def cached(spark: SparkSession, path: str, version: str) -> DataFrame:
    """(path, hash, result) of a result cache in Parquet; rows of another version count for nothing."""
    return spark.read.schema("version string, path string, hash string, result string").parquet(path).where(F.col("version") == version).drop("version")


def config_files(paths: DataFrame) -> DataFrame:
    """Of (path), the settings files: ``appsettings*.json`` and ``App.config``/``Web.config`` anywhere but under bin and obj, ``.env*`` anywhere."""
    name = F.lower(F.element_at(F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/"), -1))
    kind = F.when(name.rlike("^appsettings.*[.]json$"), "json").when(name.isin("app.config", "web.config"), "xml").when(name.startswith(".env"), "env")
    return paths.select("path", kind.alias("kind")).where("kind is not null").where(~F.lower("path").rlike("(^|[/\\\\])(bin|obj)[/\\\\]"))
