"""Queries over texts: copies, normal forms, lines, names, sensitive values, numbers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scoring as S
from ..functions import text as T
from ..operators import similarity as M
from ..session import table
from .catalog import query


@query("exact_dupes", "SELECT sha256(text) AS h, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dupes(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return d.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("n > 1")


NORMAL = r"""trim(regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '"[^"]*"', '"STR"', 'g'), '\b[0-9]+\b', 'NUM', 'g'), ' ')"""


@query("normalized_dupes", f"SELECT upper(substr(sha256({NORMAL}), 1, 16)) AS h, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def normalized_dupes(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.short_hash(T.normal_code(F.col("text"))).alias("h"))
    return d.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("content_hash", "SELECT doc_id, upper(sha256(text)) AS hash, upper(substr(sha256('R1:' || source || ':' || lang || ':' || doc_id), 1, 16)) AS fingerprint FROM documents")
def content_hash(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.upper(F.sha2("text", 256)).alias("hash"), T.fingerprint(F.lit("R1"), F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("fingerprint"))


@query("clone_links")
def clone_links(spark, sf):
    return M.clone_links(table(spark, sf, "documents"), "doc_id", "text")


@query("clone_classes")
def clone_classes(spark, sf):
    return M.clone_classes(M.clone_links(table(spark, sf, "documents"), "doc_id", "text"))


@query("clone_metrics")
def clone_metrics(spark, sf):
    d = table(spark, sf, "documents")
    return M.clone_metrics(M.clone_links(d, "doc_id", "text"), d.select(F.col("doc_id").alias("target"), F.size(F.split("text", "\n")).alias("lines")))


@query("near_copy_similarity")
def near_copy_similarity(spark, sf):
    """Each turn of a conversation against the one before: shared shingles, order of words, changed lines."""
    w = W.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumn("before", F.lag("text").over(w)).where("before is not null")
    a, b = M.tokens(F.col("text")), M.tokens(F.col("before"))
    c = c.select("conv_id", "turn", a.alias("a"), b.alias("b"), "text", "before")
    changed = F.size(F.filter("diff", lambda x: ~x.startswith("  ")))
    c = c.select("conv_id", "turn", "a", "b", M.unified_diff(F.col("before"), F.col("text")).alias("diff"), M.sequence_similarity(F.col("a"), F.col("b")).alias("order"))
    return c.select("conv_id", "turn", M.jaccard(M.shingles(F.col("a")), M.shingles(F.col("b"))).alias("jaccard"), "order", changed.alias("changed_lines"))


@query("line_metrics", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) SELECT doc_id, count(*) AS total, count_if(trim(x) = '')::BIGINT AS blank, count_if(regexp_matches(trim(x), '^(//|/\*|\*)'))::BIGINT AS comment, max(length(x))::BIGINT AS longest FROM l GROUP BY doc_id""")
def line_metrics(spark, sf):
    k = T.line_kinds(F.col("text"))
    d = table(spark, sf, "documents").select("doc_id", k.alias("k"), F.array_max(F.transform(F.split("text", "\n"), F.length)).cast("long").alias("longest"))
    return d.select("doc_id", F.col("k.total").cast("long").alias("total"), F.col("k.blank").cast("long").alias("blank"), F.col("k.comment").cast("long").alias("comment"), "longest")


MI = "greatest(0.0::DOUBLE, (171 - 5.2::DOUBLE * ln(loc * log2(loc + 1) + 1) - 0.23::DOUBLE * cc - 16.2::DOUBLE * ln(loc + 1)) * 100 / 171)"


@query("maintainability", f"WITH m AS (SELECT doc_id, len(string_split(text, chr(10)))::DOUBLE AS loc, (1 + n_chars // 1000)::DOUBLE AS cc FROM documents) SELECT doc_id, round({MI}, 6) AS index, CASE WHEN {MI} >= 90 THEN 'Excellent' WHEN {MI} >= 75 THEN 'Good' WHEN {MI} >= 60 THEN 'Acceptable' WHEN {MI} >= 40 THEN 'NeedsWork' WHEN {MI} >= 20 THEN 'Poor' ELSE 'Critical' END AS rating FROM m")
def maintainability(spark, sf):
    m = table(spark, sf, "documents").select("doc_id", F.size(F.split("text", "\n")).cast("double").alias("loc"), (1 + F.floor(F.col("n_chars") / 1000)).cast("double").alias("cc"))
    index = S.maintainability(F.col("loc"), F.col("cc"))
    return m.select("doc_id", F.round(index, 6).alias("index"), S.quality_rating(index).alias("rating"))


@query("halstead_volume", r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents), v AS (SELECT doc_id, count(*) AS n, count(DISTINCT w) AS d FROM t GROUP BY doc_id)
SELECT doc_id, n, d AS distinct_words, round(n * log2(d), 4) AS volume FROM v""")
def halstead_volume(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    v = t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("w").alias("distinct_words"))
    return v.withColumn("volume", F.round(S.halstead_volume(F.col("n"), F.col("distinct_words")), 4))


@query("sensitive_values", "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{k}'" for k, p in T.SENSITIVE_VALUES.items()) + " ELSE '' END AS kind FROM documents")
def sensitive_values(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.coalesce(T.first_sensitive(F.col("text")), F.lit("")).alias("kind"))


@query("mask_values", r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9a-f]{12,}')) AS v FROM documents) SELECT doc_id, v AS value, CASE WHEN length(v) <= 8 THEN '****' ELSE substr(v, 1, 4) || '****' || right(v, 4) END AS masked FROM t""")
def mask_values(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9a-f]{12,}"), F.lit(0))).alias("value"))
    return t.withColumn("masked", T.mask(F.col("value")))


@query("hardcoded_ips", r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b')) AS ip FROM documents) SELECT ip, count(*) AS n, count(DISTINCT doc_id) AS docs,
    CASE WHEN regexp_matches(ip, '^(10\.|192\.168\.|127\.)') THEN 'private' ELSE 'public' END AS scope FROM t WHERE ip NOT IN ('127.0.0.1', '0.0.0.0') GROUP BY ip""")
def hardcoded_ips(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"), F.lit(0))).alias("ip")).where("ip not in ('127.0.0.1', '0.0.0.0')")
    return t.groupBy("ip").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs")).withColumn("scope", F.when(F.col("ip").rlike(r"^(10\.|192\.168\.|127\.)"), "private").otherwise("public"))


@query("hardcoded_urls", r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, 'https?://[A-Za-z0-9./_-]+')) AS u FROM pages) SELECT page_id, count(*) AS n, count(DISTINCT u) AS urls, min(u) AS first FROM t GROUP BY page_id""")
def hardcoded_urls(spark, sf):
    t = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("https?://[A-Za-z0-9./_-]+"), F.lit(0))).alias("u"))
    return t.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("urls"), F.min("u").alias("first"))


@query("page_url_parts", r"""SELECT page_id, lower(regexp_extract(url, '^([a-z]+)://', 1)) AS scheme, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_matches(lower(url), '^(https?|ftp)://') AS absolute FROM pages""")
def page_url_parts(spark, sf):
    x = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, sf, "pages").select("page_id", F.lower(x("^([a-z]+)://")).alias("scheme"), x("^[a-z]+://([^/:?#]+)").alias("host"), x("^[a-z]+://[^/?#]+([^?#]*)").alias("path"), T.url_like(F.col("url")).alias("absolute"))


@query("marker_counts", " UNION ALL ".join(f"SELECT '{m}' AS marker, count_if(contains(upper(text), '{m}'))::BIGINT AS docs FROM documents" for m in T.MARKERS))
def marker_counts(spark, sf):
    d = table(spark, sf, "documents").agg(*[F.count_if(F.array_contains(T.markers(F.col("text")), F.lit(m))).alias(m) for m in T.MARKERS])
    return d.unpivot([], T.MARKERS, "marker", "docs")


@query("term_frequencies", r"""WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM documents) SELECT term, count(*) AS n FROM t GROUP BY term""")
def term_frequencies(spark, sf):
    return table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("abbreviations", r"""WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents), n AS (SELECT term, count(*) AS n FROM t GROUP BY term), a(abbr, long) AS (VALUES ('th', 'the'), ('er', 'err'), ('st', 'est'), ('nd', 'and'), ('ou', 'you'))
SELECT abbr, long AS expanded, x.n AS abbr_uses, y.n AS long_uses FROM a JOIN n x ON x.term = abbr JOIN n y ON y.term = long""")
def abbreviations(spark, sf):
    """Abbreviations in use whose long form is in use as well."""
    n = term_counts(spark, sf)
    a = spark.createDataFrame([("th", "the"), ("er", "err"), ("st", "est"), ("nd", "and"), ("ou", "you")], "abbr string, expanded string")
    x, y = n.select(F.col("term").alias("abbr"), F.col("n").alias("abbr_uses")), n.select(F.col("term").alias("expanded"), F.col("n").alias("long_uses"))
    return x.join(F.broadcast(a), "abbr").join(y, "expanded").select("abbr", "expanded", "abbr_uses", "long_uses")


def term_counts(spark, sf):
    return table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("name_words", r"""SELECT p_name AS name, len(string_split(p_name, ' ')) ::INT AS words, upper(replace(p_name, ' ', '_')) AS upper_snake, lower(replace(p_name, ' ', '_')) AS lower_snake FROM part""")
def name_words(spark, sf):
    n = F.col("p_name")
    joined = F.replace(n, F.lit(" "), F.lit("_"))
    return table(spark, sf, "part").select(n.alias("name"), F.size(F.split(n, " ")).alias("words"), F.upper(joined).alias("upper_snake"), F.lower(joined).alias("lower_snake"))


@query("naming_conventions", r"""WITH n AS (SELECT unnest([p_type, lower(p_type), replace(p_type, ' ', ''), replace(p_type, ' ', '_'), lower(replace(p_type, ' ', '_'))]) AS name FROM part)
SELECT name, count(*) AS n, CASE WHEN regexp_matches(name, '^I[A-Z][a-zA-Z0-9]*$') THEN 'InterfacePrefix' WHEN regexp_matches(name, '^_[a-z][a-zA-Z0-9]*$') THEN 'UnderscoreCamel' WHEN regexp_matches(name, '^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$') THEN 'UpperSnake' WHEN regexp_matches(name, '^[a-z][a-z0-9]*(_[a-z0-9]+)*$') THEN 'LowerSnake'
    WHEN regexp_matches(name, '^[A-Z][a-zA-Z0-9]*$') THEN 'Pascal' WHEN regexp_matches(name, '^[a-z][a-zA-Z0-9]*$') THEN 'Camel' ELSE 'Unknown' END AS convention FROM n GROUP BY name""")
def naming_conventions(spark, sf):
    t = F.col("p_type")
    under = F.replace(t, F.lit(" "), F.lit("_"))
    n = table(spark, sf, "part").select(F.explode(F.array(t, F.lower(t), F.replace(t, F.lit(" "), F.lit("")), under, F.lower(under))).alias("name"))
    return n.groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn("convention", T.convention(F.col("name")))


@query("snippets", r"""SELECT doc_id, trim(regexp_replace(CASE WHEN length(text) > 100 THEN substr(text, 1, 97) || '...' ELSE text END, '\s+', ' ', 'g')) AS snippet FROM documents""")
def snippets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query("file_sizes", """SELECT doc_id, CASE WHEN strlen(text) >= 1048576 THEN (strlen(text) // 1048576) || ' MB' WHEN strlen(text) >= 1024 THEN (strlen(text) // 1024) || ' KB' ELSE strlen(text) || ' bytes' END AS size FROM documents""")
def file_sizes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.file_size(F.octet_length("text")).alias("size"))


@query("sensitive_keys", """WITH k AS (SELECT event_id, 'app__' || event_type || CASE event_id % 4 WHEN 0 THEN '__ApiKey' WHEN 1 THEN '__password' ELSE '__name' END AS key FROM events) SELECT event_id, trim(replace(key, '__', ':')) AS key, regexp_matches(lower(key), 'password|secret|key|token|credential|connectionstring|apikey') AS sensitive FROM k""")
def sensitive_keys(spark, sf):
    m = F.col("event_id") % 4
    key = F.concat(F.lit("app__"), "event_type", F.when(m == 0, "__ApiKey").when(m == 1, "__password").otherwise("__name"))
    return table(spark, sf, "events").select("event_id", T.normal_key(key).alias("key"), T.sensitive_key(key).alias("sensitive"))
