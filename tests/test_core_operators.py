"""Graphs, taint, clones, rules, readers, reports and streams on small fixtures."""

import json
import random
import xml.etree.ElementTree as ET

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import detectors as D
from lodestone.operators import graph as G
from lodestone.operators import relations as R
from lodestone.operators import similarity as M
from lodestone.rules import engine as E
from lodestone.sinks import reports
from lodestone.sources import readers
from lodestone.streaming import events as V


def edges(spark, text):
    return spark.createDataFrame([tuple(e.split(">")) for e in text.split()], "source string, target string")


def test_graph(spark):
    e = edges(spark, "a>b b>c c>a c>d d>d x>y")
    got = {(r.root, r.node): r.depth for r in G.reach(e, spark.createDataFrame([("a",)], "root string")).collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 2, ("a", "d"): 3}
    assert [r.path for r in G.paths(e, "a", "d").collect()] == [["a", "b", "c", "d"]]
    assert G.shortest_path(e, "a", "d").first().path == ["a", "b", "c", "d"] and G.shortest_path(e, "d", "a").count() == 0
    assert [r.cycle for r in G.cycles(e).collect()] == ["a>b>c"]
    assert {r.node: r.component for r in G.components(e).collect()} == dict.fromkeys("abcd", "a") | {"x": "x", "y": "x"}
    assert {(r.node, r.role) for r in G.ends(e).collect()} == {("x", "entry"), ("y", "leaf"), ("d", "leaf")}
    assert {r.node: r.depth for r in G.depths(e).collect()} == {"x": 0, "y": 1} | dict.fromkeys("abcd", 2147483647)


def test_long_chain_is_one_component(spark):
    e = spark.range(1, 70).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    assert {r.component for r in G.components(e).collect()} == {1}


def test_taint_passes_expressions_not_bare_names(spark):
    a = spark.createDataFrame([("m", "b", ["a"], False), ("m", "c", ["b", "x"], False), ("m", "d", ["c"], True), ("n", "b", ["a"], False)], "method string, target string, rhs array<string>, bare boolean")
    s = spark.createDataFrame([("m", "a")], "method string, variable string")
    assert {(r.method, r.variable) for r in G.tainted(a, s).collect()} == {("m", "a"), ("m", "b"), ("m", "c")}


def test_cohesion(spark):
    m = spark.createDataFrame([("C", "f", False), ("C", "g", False), ("C", "x", False), ("C", "lone", False), ("C", "s", True)], "class string, member string, is_static boolean")
    a = spark.createDataFrame([("C", "f", "x"), ("C", "g", "s")], "class string, method string, accessed string")
    assert G.cohesion(m, a).first().lcom4 == 3


def test_relations(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "k string, d string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("e", "1")], "k string, d string")
    assert {r.k: r.status for r in R.changes(new, old.unionByName(spark.createDataFrame([("z", "1")], "k string, d string")), "k", "d").collect()} == {"a": "unchanged", "b": "changed", "c": "unchanged", "e": "new", "z": "deleted"}
    row = lambda *x: spark.createDataFrame(list(x), "k string, at long")
    got = R.between(row(("u", 1), ("u", 10)), row(("u", 5), ("u", 12)), row(("u", 7), ("u", 12)), "k", "at").collect()
    assert {(r.source_at, r.sink_at, r.sanitized) for r in got} == {(1, 7, True), (10, 12, False)}
    assert R.coupling(edges(spark, "a>b a>c b>c")).where("node = 'c'").first().instability == 0.0


tokens = st.lists(st.sampled_from("abcd"), max_size=25)


@settings(max_examples=60)
@given(tokens, tokens)
def test_sequences(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    cost = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
            cost[i][j] = min(cost[i - 1][j] + 1, cost[i][j - 1] + 1, cost[i - 1][j - 1] + (x != y))
    assert M.lcs_length(a, b) == table[-1][-1] == M.lcs_length(b, a)
    assert M.edit_distance(a, b) == cost[-1][-1] and M.edit_distance(a, b, 3) == min(cost[-1][-1], 4)
    diff = M.diff_lines("\n".join(a), "\n".join(b))
    assert [x[2:] for x in diff if x[0] != "+"] == "\n".join(a).split("\n") and [x[2:] for x in diff if x[0] != "-"] == "\n".join(b).split("\n")


def test_clones(spark):
    words = [f"w{i}" for i in range(80)]
    near = " ".join([*words[:40], "changed", *words[41:]])
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, near), (4, "  ".join(words)), (5, "something else"), (6, "")]
    links = M.clone_links(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    assert {(r.source, r.target, r.type) for r in links.collect()} == {(1, 2, "Type1"), (1, 4, "Type2"), (1, 3, "Type3")}
    assert {r.node: r.component for r in M.clone_classes(links).collect()} == dict.fromkeys([1, 2, 3, 4], 1)


@pytest.mark.parametrize("tile", [M.TILE, 2000])
def test_clone_links_are_all_pairs(spark, monkeypatch, tile):
    """Chains of versions, documents with a common passage, and copies whose strings differ, against every pair."""
    monkeypatch.setattr(M, "TILE", tile)
    rng = random.Random(7)
    texts, words = [], [f"w{i}" for i in range(120)]
    for i in range(150):  # each version has a few words changed
        for _ in range(rng.choice([1, 1, 2, 3])):
            words[rng.randrange(120)] = f"x{i}-{rng.random()}"
        texts.append(" ".join(words))
    passage = " ".join(f"p{i}" for i in range(90))
    texts += [f"{passage} " + " ".join(f"q{rng.randrange(4)}-{i // 3}-{k}" for k in range(rng.randrange(10, 60))) for i in range(150)]
    long = " ".join(f"z{i}" for i in range(60))
    texts += [f'{long} "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"', f'{long} "other words in here"', f"{long} other words in there", f"{long} OTHER words in there", "a b c d", "", None]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    forms = {r.id: r.form for r in docs.select("id", X.normal_code(F.col("text")).alias("form")).collect()}
    sets = {i: frozenset(zip(*[(t or "").lower().split()[k:] for k in range(5)])) for i, t in enumerate(texts)}
    first = {}
    for i, s in sets.items():
        first.setdefault(s, i)
    ones = [i for i, s in sets.items() if s and first[s] == i]
    want = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in ones for j in ones if i < j and forms[i] != forms[j]}
    want = {p: x for p, x in want.items() if x >= 0.75} | {(first[s], i): 1.0 for i, s in sets.items() if s and first[s] != i and forms[i] != forms[first[s]]}
    got = M.clone_links(docs, "id", "text").where("type = 'Type3'").collect()
    assert len(want) > 400 and len(got) == len(want) and {(r.source, r.target): r.score for r in got} == pytest.approx(want)


NODES = "path string, kind string, line int, depth int, text string, name string, full_name string, class string, method string, namespace string, params int, args array<string>, returns string, in_kinds array<string>, attrs map<string,string>"


def node(kind="Invocation", **x):
    base = dict(path="src/a.cs", kind=kind, line=1, depth=1, text="t", name="Wait", full_name="Task.Wait", method="M", namespace="N", params=0, args=[], returns="void", in_kinds=[], attrs={}) | {"class": "C"}
    base |= x
    return tuple(base[f.split()[0]] for f in NODES.split(", "))


YAML = """
rules:
  - name: no-wait
    message: "{fullName} in {method}, line {line} of {file}"
    severity: Error
    pattern: {type: method_invocation, match: "*.Wait", notIn: ["*Test*"], conditions: ["isInLoop", "notIsInTryBlock()", "notIsInLambda", "whatever"]}
  - pattern: {type: numeric_literal, match: "*", minValue: 10, maxValue: 20}
  - name: text
    pattern: {type: string_literal, match: "^a.c$", useRegex: true}
  - 17
"""


def test_rules(spark):
    rules, errors = E.parse(YAML)
    assert len(rules) == 3 and len(errors) == 1 and rules[1].name == "UnnamedRule" and rules[1].message == "Rule violation"
    assert E.compiled(rules[0])[1] == ["notIsInLambda", "whatever"]
    nodes = spark.createDataFrame([node(in_kinds=["For"]), node(in_kinds=["For", "Try"]), node(in_kinds=["For"], path="src/MyTests.cs"), node(in_kinds=["For"], path="src/a.g.cs"), node(), node("Number", text="15"), node("Number", text="25"), node("Number", text="0x1"), node("String", text="abc"), node("String", text="xabc")], NODES)
    got = E.violations(nodes, rules).collect()
    assert sorted((r.rule, r.severity, r.snippet) for r in got) == [("UnnamedRule", "Warning", "0x1"), ("UnnamedRule", "Warning", "15"), ("no-wait", "Error", "t"), ("text", "Warning", "abc")]
    assert next(r.message for r in got if r.rule == "no-wait") == "Task.Wait in M, line 1 of a.cs"
    assert E.problems(E.Rule(name="", message="", type="x")) and not E.problems(rules[0])


@pytest.mark.parametrize(("text", "want"), [(">=3", True), ("<3", False), ("!=3", False), ("3", True), ("=3", True), ("> 2", True)])
def test_comparison(spark, text, want):
    assert spark.range(1).select(E.comparison(F.lit(3), text).alias("x")).first().x is want
    assert E.comparison(F.lit(3), ">=x") is None


ISSUES = "id long, category string, rule_id string, severity string, sev_rank int, path string, line int, cwe string, message string"


def test_reports(spark):
    i = spark.createDataFrame([(1, "Security", "R1", "Error", 3, "a\\b.cs", 3, "CWE-1", "bad: <x>, 5%"), (2, "Style", "R2", "Note", 1, "c.cs", 1, None, "meh")], ISSUES)
    s = json.loads(reports.sarif(i))
    assert [r["level"] for r in s["runs"][0]["results"]] == ["error", "note"] and s["runs"][0]["artifacts"][0]["location"]["uri"] == "a/b.cs"
    suites = ET.fromstring(reports.junit(i, 5)).findall("testsuite")
    assert [(x.get("name"), x.get("failures")) for x in suites] == [("Security", "1"), ("Style", "0"), ("clean files", "0")] and "3 files" in suites[2][0].get("name")
    assert reports.annotation_lines(i).first().text == "::error file=a\\b.cs,line=3::bad%3A <x>%2C 5%25"
    assert "&lt;" not in reports.html_report(i) and "<td>c.cs</td>" in reports.html_report(i) and "| c.cs | 1 |" in reports.markdown_report(i)
    assert "##vso[task.logissue type=error" in reports.pipeline_lines(i, least=3).first().text and reports.text_dashboard(81, i).startswith("health 81 (good)")
    assert reports.dot_lines(edges(spark, "a>b a>b")).collect()[0].text == '"a" -> "b";'


def test_readers(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    c = put("c.xml", '<coverage><packages><package><classes><class name="C" filename="c.cs"><methods><method name="M"><lines><line number="1" hits="2"/><line number="2" hits="0" condition-coverage="50% (1/2)"/></lines></method></methods></class></classes></package></packages></coverage>')
    points = readers.cobertura(spark, c)
    assert [tuple(r) for r in points.orderBy("line").collect()] == [("C", "c.cs", "M", 1, 2, 0, 0), ("C", "c.cs", "M", 2, 0, 2, 1)]
    assert readers.coverage_summary(points, ["class"]).first().percent == 50.0
    o = put("o.xml", '<CoverageSession><Modules><Module><ModuleName>m</ModuleName><Classes><Class><FullName>A</FullName><Methods><Method><Name>f</Name><SequencePoints><SequencePoint sl="1" vc="0"/><SequencePoint sl="1" vc="3"/></SequencePoints></Method></Methods></Class></Classes></Module><Module skippedDueTo="x"><ModuleName>n</ModuleName></Module></Modules></CoverageSession>')
    assert [tuple(r) for r in readers.opencover(spark, o).collect()] == [("m", "A", "f", 1, 3)]
    j = put("cov.json", '{"m.dll": {"c.cs": {"C": {"f()": {"Lines": {"1": 1, "2": 0}, "Branches": []}}}}}')
    assert {(r.line, r.hits) for r in readers.coverlet(spark, j).collect()} == {(1, 1), (2, 0)}
    e = put(".env", "# note\nA__B='x=1'\n\nAPI_KEY=s3\nbroken\n=no\n")
    assert {(r.key, r.value, r.sensitive) for r in readers.env_config(spark, e).collect()} == {("A:B", "x=1", False), ("API_KEY", "s3", True)}
    a = put("appsettings.json", '{"A": {"B": [1, {"Password": "hunter2"}]}, "N": null, "T": true}')
    assert {(r.key, r.value, r.sensitive) for r in readers.json_config(spark, a).collect()} == {("A:B:0", "1", False), ("A:B:1:Password", "hunter2", True), ("T", "true", False)}
    w = put("web.config", '<configuration><appSettings><add key="K" value="v"/></appSettings><connectionStrings><add name="Db" connectionString="Server=x"/></connectionStrings></configuration>')
    assert {(r.key, r.value, r.sensitive) for r in readers.xml_config(spark, w).collect()} == {("K", "v", False), ("ConnectionStrings:Db", "Server=x", True)}
    p = put("a.csproj", '<Project><ItemGroup><PackageReference Include="P" Version="1.0"/><PackageReference Update="Q"><Version>2.0</Version></PackageReference><PackageReference Include="R"/></ItemGroup></Project>')
    assert {tuple(r) for r in readers.package_references(spark, p).collect()} == {("P", "1.0"), ("Q", "2.0"), ("R", "*")}
    s = put("s.sln", 'Project("{X}") = "App", "src\\App\\App.csproj", "{Y}"\nEndProject\n')
    assert tuple(readers.solution_projects(spark, s).first()) == ("App", "src/App/App.csproj")
    k = put("lock.json", '{"dependencies": {"net8": {"A": {"type": "Direct", "resolved": "1.0", "dependencies": {"B": "2.0"}}, "B": {"type": "Transitive", "resolved": "2.0"}}, "net9": {"A": {"type": "Direct", "resolved": "9.0"}}}}')
    assert {tuple(r) for r in readers.lock_file(spark, k).collect()} == {("A", "1.0", True, "B"), ("B", "2.0", False, None)}
    g = put("log.txt", "h1|fix a|b thing|ann|2024-01-02T03:04:05+00:00\njunk\n")
    assert [(r.hash, r.subject, r.author) for r in readers.git_log(spark, g).collect()] == [("h1", "fix a|b thing", "ann")]
    n = put("num.txt", "3\t1\ta.cs\n-\t-\tb.png\n")
    assert {tuple(r) for r in readers.git_numstat(spark, n).collect()} == {("a.cs", 3, 1), ("b.png", 0, 0)}
    assert tuple(spark.range(1).select(readers.git_stat(F.lit(" 2 files changed, 10 insertions(+), 3 deletions(-)")).alias("s")).first().s) == (2, 10, 3)
    assert readers.files(spark, str(tmp_path), "*.xml").count() == 2


def test_detectors(spark):
    rows = spark.createDataFrame([(1, 'password = "x"'), (2, "see https://a.example.com"), (3, "catch (Exception e) { }"), (4, None), (5, "plain")], "id int, text string")
    got = {(r.id, r.detector) for r in D.in_text(rows, "id", "text").collect()}
    assert {(1, "Credential"), (2, "HardcodedUrl"), (3, "EmptyCatch")} <= got and not any(i in (4, 5) for i, _ in got)
    m = spark.createDataFrame([("p", "f", 51, 10, 7, 0)], "path string, name string, lines int, complexity int, nesting int, parameters int")
    smells = D.method_smells(m)
    assert {(r.smell, r.severity) for r in smells.collect()} == {("LongMethod", "Medium"), ("DeepNesting", "High")}
    assert D.opportunities(smells).count() == 2


def test_recompute_analyses_changes_and_their_dependents_only(spark):
    current = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "k string, d string")
    cache = spark.createDataFrame([("a", "1", "old"), ("b", "x", "old"), ("c", "3", "old"), ("gone", "9", "old")], "k string, d string, r string")
    deps = spark.createDataFrame([("c", "b")], "k string, on string")
    out = V.recompute(current, cache, lambda x: x.withColumn("r", F.lit("new")), "k", "d", deps)
    assert {(r.k, r.r) for r in out.collect()} == {("a", "old"), ("b", "new"), ("c", "new"), ("d", "new")}


def test_planning():
    from lodestone.operators.planning import chains, ordered, valid

    after, rank = {"b": {"a"}, "c": {"b"}}, {"a": 3, "b": 2, "c": 1}
    assert ordered(["c", "b", "a"], after, rank) == ["a", "b", "c"]
    assert ordered(["a", "b"], {"a": {"b"}, "b": {"a"}}, rank) == ["b", "a"]
    assert not valid([], set(), {}) and not valid(["a", "a"], set(), {}) and not valid(["a", "b"], {("b", "a")}, {}) and not valid(["b", "a"], set(), after)
    assert chains(["a", "b", "c"], {("a", "b")}, after, rank, {"a": 1, "b": 5, "c": 2})[0] == ["b", "c"]


def test_unbounded_depths(spark, tmp_path):
    """Settings 20 levels deep, and a path of 60 edges."""
    import json as j

    value = "leaf"
    for k in reversed(range(20)):
        value = {f"k{k}": value}
    (tmp_path / "deep.json").write_text(j.dumps(value))
    rows = readers.json_config(spark, str(tmp_path / "deep.json")).collect()
    assert [(r.key, r.value) for r in rows] == [(":".join(f"k{k}" for k in range(20)), "leaf")]
    e = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)], "source string, target string")
    assert len(G.shortest_path(e, "n000", "n060").first().path) == 61
    assert {r.node: r.depth for r in G.depths(e.unionByName(spark.createDataFrame([("x", "y"), ("y", "x")], "source string, target string"))).collect()}["x"] == 2147483647


def test_clean_files_count_all_issues(spark):
    rows = [(i, "R", "c", "Error", 3, f"f{i}", 1, "m") for i in range(5)]
    df = spark.createDataFrame(rows, "id int, rule_id string, category string, severity string, sev_rank int, path string, line int, message string")
    assert "5 files without issues" in reports.junit(df, 10, most=2) and "[Error] f0:1 m" in reports.sections(df, "T", "category", 1)


def test_more_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"targets": {"net8": {"A/1.0": {"type": "package", "dependencies": {"B": "2.0"}}, "B/2.0": {"type": "package"}}, "net9": {"C/1.0": {}}}}')
    got = {(r.package, r.version, r.dependency) for r in readers.assets_file(spark, str(tmp_path / "a.json")).collect()}
    assert got == {("A", "1.0", "B"), ("B", "2.0", None)}
    (tmp_path / "d.json").write_text('{"Name": "Root", "Kind": "Root", "CoveredStatements": 1, "TotalStatements": 2, "Children": [{"Name": "M", "Kind": "Method", "CoveredStatements": 1, "TotalStatements": 2}]}')
    assert {(r.path, r.covered) for r in readers.dotcover_json(spark, str(tmp_path / "d.json")).collect()} == {("Root", 1), ("Root/M", 1)}
    (tmp_path / "d.xml").write_text('<Root><Assembly Name="A"><Namespace Name="N"><Type Name="T"><Method Name="M" CoveredStatements="3" TotalStatements="4"/></Type></Namespace></Assembly></Root>')
    assert [tuple(r) for r in readers.dotcover_xml(spark, str(tmp_path / "d.xml")).collect()] == [("A", "N", "T", "M", 3, 4)]
    (tmp_path / "v.xml").write_text('<P><PackageVersion Include="A" Version="7"/></P>')
    assert [tuple(r) for r in readers.central_versions(spark, str(tmp_path / "v.xml")).collect()] == [("A", "7")]
    paths = spark.createDataFrame([("x/appsettings.Dev.json",), ("bin/appsettings.json",), ("App.config",), (".env.local",), ("other.json",)], "path string")
    assert {(r.path, r.kind) for r in readers.config_files(paths).collect()} == {("x/appsettings.Dev.json", "json"), ("App.config", "xml"), (".env.local", "env")}


def test_renamed_fragments_are_alike(spark):
    from lodestone.operators import clones

    df = spark.createDataFrame([(1, "int a = b + 5 ; a ( 99 , b )".split()), (2, "int x = y + 5 ; x ( 77 , y )".split()), (3, "int x = x + 5 ; x ( 77 , x )".split()), (4, None)], "id int, tokens array<string>")
    got = {r.id: r.t for r in df.select("id", clones.renamed(df.tokens, ["int"]).alias("t")).collect()}
    assert got[1] == got[2] != got[3] and got[1][:4] == ["int", "$1", "=", "$2"] and got[4] is None
    f = spark.createDataFrame([("a", 1, 9, "b"), ("a", 9, 12, "c"), ("a", 10, 12, "d"), ("z", 1, 9, "e")], "path string, start_line int, end_line int, id string")
    x, y = f.alias("x"), f.alias("y")
    assert {(r[0], r[1]) for r in x.join(y, clones.overlapping("x", "y") & (F.col("x.id") < F.col("y.id"))).select("x.id", "y.id").collect()} == {("b", "c"), ("c", "d")}


def test_unknown_conditions_are_named():
    rules, _ = E.parse([{"name": "r", "message": "m", "pattern": {"match": "*", "conditions": ["inLoop", "noSuch(1)", "notInLoop"]}}])
    assert E.unknown_conditions(rules) == [("r", "noSuch(1)"), ("r", "notInLoop")]
