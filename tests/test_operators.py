import subprocess

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.functions import identity
from codeloom.functions import text as T
from codeloom.operators import analytics, chunking, evaluate, graph, incremental, joins, rank, resolve, sets, vector
from codeloom.plans import tools
from codeloom.sources import files
from codeloom.streaming import changes


def test_stable_id(spark):
    want = 262548046009500613
    row = spark.range(1).select(identity.stable_id(F.lit("tier1_surgical"), F.lit("src/core.py"), F.lit("src/core.py::embed"))).first()
    assert row[0] == want == identity.stable_id_of("tier1_surgical", "src/core.py", "src/core.py::embed")


def test_confidence(spark):
    rows = spark.createDataFrame([(False, None), (True, None), (True, 0.8)], "c boolean, x double")
    assert [r[0] for r in rows.select(graph.effective_confidence(F.col("c"), F.col("x"))).collect()] == [1.0, 0.25, 0.8]


def test_rank_fusion(spark):
    rows = spark.createDataFrame([("q", "a", 0), ("q", "a", 0), ("q", "a", 0)], "query_id string, item string, rank0 int")
    assert vector.rrf(rows, "item").first().score == pytest.approx(0.05)


def test_text_twins(spark):
    rows = spark.createDataFrame([("f", "t", 3, 0, 0.9, "x"), ("f", "t", 2, 4, 0.1, "y"), ("f", "", 2, 5, 0.1, "z"), ("f", "", 2, 6, 0.1, "w")], "path string, text string, tier int, pos int, score double, item string")
    out = {r.item: (r.tier, r.pos, r.score) for r in sets.dedupe_texts(rows).collect()}
    assert out == {"y": (2, 0, 0.9), "z": (2, 5, 0.1), "w": (2, 6, 0.1)}


def test_diff_and_guard(spark):
    disk = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content_hash string")
    stored = spark.createDataFrame([("b", "2"), ("c", "9"), ("d", "4")], "path string, content_hash string")
    assert {tuple(r) for r in joins.three_way_diff(disk, stored).collect()} == {("a", "new"), ("c", "modified"), ("d", "deleted")}
    many = spark.range(60).select(F.col("id").cast("string").alias("path"), F.lit("deleted").alias("status"))
    base = many.select("path")
    assert sets.deletion_guard(many, base).count() == 0 and sets.deletion_guard(many, base, confirmed=True).count() == 60
    assert sets.deletion_guard(many.limit(50), base).count() == 50


def test_call_cascade(spark):
    symbols = spark.createDataFrame([("a.py::main", "a.py", "main"), ("b.py::low", "b.py", "low"), ("a.py::two", "a.py", "two"), ("c.py::two", "c.py", "two"), ("c.py::T.run", "c.py", "run"), ("b.py::U.run", "b.py", "run")], "fqn string, path string, name string")
    e = lambda t, r=None, b=None, x=None: ("a.py::main", t, "CALLS", None, r, b, True, x)
    own = [("c.py::T", "c.py::T.run", "OWNS", None, None, None, None, None), ("b.py::U", "b.py::U.run", "OWNS", None, None, None, None, None)]
    edges = spark.createDataFrame([e("low"), e("two"), e("none"), e("run", "T"), e("low2", None, None, True), e("run2", "Z"), *own], "source_fqn string, target string, kind string, resolved_target string, receiver_type string, bound_module string, member_call boolean, external boolean")
    out = {r.target: (r.resolved_target, r.confidence, r.outcome) for r in resolve.resolve_calls(edges, symbols).collect()}
    assert out["low"] == ("b.py::low", 1.0, "unique") and out["two"] == ("a.py::two", 1.0, "same_file") and out["none"][2] == "unknown"
    assert out["run"] == ("c.py::T.run", 0.9, "receiver") and out["run2"][0] is None


def test_imports(spark):
    fs = spark.createDataFrame([("src/a/x.ts",), ("src/b/index.ts",), ("src/p/m.py",), ("src/p/__init__.py",)], "path string")
    ask = spark.createDataFrame([("src/a/x.ts", "../b"), ("src/a/x.ts", "@/a/x"), ("src/a/x.ts", "../../../z"), ("src/a/x.ts", "react")], "path string, specifier string")
    out = {r.specifier: r.resolved for r in resolve.resolve_script_imports(ask, fs, {"@/": "src/"}).collect()}
    assert out == {"../b": "src/b/index.ts", "@/a/x": "src/a/x.ts", "../../../z": None, "react": None}
    ask = spark.createDataFrame([("src/p/q.py", ".m"), ("src/p/q.py", "p.m"), ("src/p/q.py", "."), ("src/p/q.py", "zz")], "path string, specifier string")
    out = {r.specifier: r.resolved for r in resolve.resolve_python_imports(ask, fs).collect()}
    assert out == {".m": "src/p/m.py", "p.m": "src/p/m.py", ".": "src/p/__init__.py", "zz": None}
    text = spark.createDataFrame([("i.ts", "export { A as B, C } from './c'")], "path string, text string")
    assert {tuple(r) for r in resolve.barrel_exports(text).collect()} == {("i.ts", "B", "A", "./c"), ("i.ts", "C", "C", "./c")}


def test_best_first():
    near = {"a": ["b", "c"], "b": ["d"], "d": ["e"], "e": ["f"], "f": ["g"]}
    got = graph.best_first([("a", 1.0)], lambda n: near.get(n, []))
    assert [g[0] for g in got] == ["b", "c", "d", "e", "f"] and got[0][1] == pytest.approx(0.7)
    assert len(graph.best_first([("a", 1.0)], lambda n: [f"{n}{i}" for i in range(9)])) == 20


def test_louvain_and_betweenness(spark):
    links = [(a, b, 1.0) for g in ("abcd", "wxyz") for a in g for b in g if a < b] + [("d", "w", 0.1)]
    own = analytics.louvain_local(links, list("abcdwxyz"))
    assert len(set(own.values())) == 2 and own["a"] == own["d"] != own["w"] == own["z"]
    pairs = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    assert {r.node: r.betweenness for r in analytics.betweenness(pairs, nodes).collect()} == {"a": 0.0, "b": 0.5, "c": 0.0}
    assert analytics.refine_local([("a", "b", 1.0)], {"a": 0, "b": 0}) == {"a": 0, "b": 0}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab c", max_size=12), max_size=20), st.integers(2, 9), st.integers(0, 1))
def test_windows_cover_all_lines(lines, size, overlap):
    text = "\n".join(lines)
    got = chunking.token_windows(text, size, overlap)
    n = len(text.split("\n"))
    assert {i for a, b, _ in got for i in range(a, b + 1)} == set(range(1, n + 1))
    assert all(chunking.count_tokens(body) <= size for _, _, body in got)


def test_packing(spark):
    rows = spark.createDataFrame([("q", 1, 60), ("q", 2, 50), ("q", 3, 30)], "query_id string, pos int, n_tokens int")
    assert sorted(r.pos for r in rank.pack_skipping(rows, 100).collect()) == [1, 3]


def test_iterate():
    docs = [{"path": str(i), "text": str(i), "scope": f"s{i}", "score": 1.0 - i / 100} for i in range(8)]
    assert len(rank.iterate("q", lambda ask: docs[:5])) == 5
    asked = []
    rank.iterate("q", lambda ask: asked.append(ask) or [dict(docs[len(asked)], score=0.1)])
    assert len(asked) == 3 and "context: s1" in asked[1]


def test_redaction(spark):
    cases = {"k = ghp_" + "a" * 36: "k = [REDACTED:github-token]", "postgres://u:pw@h/d": "postgres://u:[REDACTED:url-credential]@h/d", "Password=abc;": "Password=[REDACTED:connection-string-password];", 'api_key = "12345678"': 'api_key = "[REDACTED:secret-assignment]"', '"private_key": "x\\ny"': '"private_key": "[REDACTED:private-key-field]"', "plain": "plain"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.redact(F.col("t")).alias("r"))
    assert {r.t: r.r for r in rows.collect()} == cases


def test_small_text_functions():
    assert T.window_seconds("7d") == 604800
    with pytest.raises(ValueError):
        T.window_seconds("x")
    assert T.signature("def f(a: int) -> str:\n  pass") == "def f(a: int) -> str" and T.signature("f(x) { y }") == "f(x)"
    assert T.nesting([(1, 9), (2, 5), (3, 4), (6, 8)]) == [0, 1, 2, 1]
    assert T.locate("b\nc", "a\nb\nc", 2) == (2, "same") and T.locate("b", "a\nc\nb", 1) == (3, "moved") and T.locate("z", "a", 1) == (1, "changed")
    lines = [f"line {i}" for i in range(40)]
    lines[30] = "needle"
    assert "needle" in T.snippet("\n".join(lines), "needle") and T.snippet("\n".join(lines), "needle").startswith("line 0")


def test_diff_parser(spark):
    text = "diff --git a/x.py b/x.py\n@@ -1,2 +3,4 @@\n@@ -9 +12,0 @@\ndiff --git a/y b/y\ndeleted file mode 1\n"
    got = tools.parse_diff(text)
    assert got == [{"path": "x.py", "status": "modified", "ranges": [{"a": 3, "b": 6}], "points": [12]}, {"path": "y", "status": "deleted", "ranges": [], "points": []}]
    hunks = spark.createDataFrame(got, "path string, status string, ranges array<struct<a:int,b:int>>, points array<int>")
    symbols = spark.createDataFrame([("C", "x.py", 1, 20), ("C.m", "x.py", 2, 8), ("C.n", "x.py", 12, 14)], "fqn string, path string, start_line int, end_line int")
    assert {r.fqn for r in joins.hunk_overlap(hunks, symbols).collect()} == {"C.m", "C", "C.n"}


def test_metrics(spark):
    ranking = spark.createDataFrame([("a", "x", 0, 1.0), ("a", "y", 1, 0.5), ("b", "z", 0, 1.0)], "query_id string, item_id string, rank int, score double")
    qrels = spark.createDataFrame([("a", "y", 1), ("c", "q", 1)], "query_id string, item_id string, gain int")
    out = {r.query_id: r for r in evaluate.query_scores(ranking, qrels).collect()}
    assert out["a"].mrr == 0.5 and out["b"].mrr == 0 and out["c"].ndcg == 0 and out["a"].recall_5 == 1
    one = spark.createDataFrame([(0.3,)], "x double")
    assert evaluate.mean_ci(one, "x").first().ci95 == 0.0
    lo, hi = evaluate.bootstrap_ci([0.0, 1.0] * 20, 200)
    assert lo < 0.5 < hi


def test_scan_policy_and_folder(spark, tmp_path):
    for p, t in {"a.py": "x\r\ny\r", "node_modules/b.py": "z", "src/c.min.js": "q", "src/d.ts": "w", "e.txt": "-"}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / p).write_bytes(t.encode())
    rows = {r.path: r for r in files.scan(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.py", "src/d.ts"} and rows["a.py"].text == "x\ny\n"
    (tmp_path / "a.py").write_bytes(b"x\ny\n")
    assert {r.path: r.content_hash for r in files.scan(spark, str(tmp_path)).collect()}["a.py"] == rows["a.py"].content_hash
    assert files.resolve_list(("a", "b"), {"extra_x": ["!a", "c"]}, "x") == ("b", "c") and files.resolve_list(("a",), {"x": []}, "x") == ()
    for bad in ({"x": ["q"], "extra_x": ["z"]}, {"extra_x": ["!zz"]}):
        with pytest.raises(ValueError):
            files.resolve_list(("a",), bad, "x")


def test_commit_scan(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.email=a@b", "-c", "user.name=n", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.py").write_text("one\r\n")
    (tmp_path / "l.py").symlink_to("a.py")
    git("add", "."), git("commit", "-qm", "x")
    assert [(r.path, r.text) for r in files.scan(spark, str(tmp_path), "git:HEAD").collect()] == [("a.py", "one\n")]
    assert changes.poll_ref(str(tmp_path), None) and changes.poll_ref(str(tmp_path), changes.poll_ref(str(tmp_path), None)) is None


def test_snapshots_and_stream(spark, tmp_path):
    snaps = files.Snapshots(spark, f"{tmp_path}/snap", kept=2)
    src = f"{tmp_path}/in"
    schema = "path string, v int, deleted boolean"
    spark.createDataFrame([("a", 1, False), ("b", 1, False)], schema).write.parquet(src)
    run = changes.upsert_batches(snaps, "files")
    changes.watch(spark, src, schema, run, f"{tmp_path}/cp", once=True).awaitTermination()
    spark.createDataFrame([("a", 2, False), ("b", 1, True)], schema).write.mode("append").parquet(src)
    changes.watch(spark, src, schema, run, f"{tmp_path}/cp", once=True).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(f"{snaps.current()}/files").select("path", "v").collect()] == [("a", 2)]
    with pytest.raises(ValueError):
        files.check_vectors(spark.createDataFrame([([1.0],)], "embedding array<double>"), 2)


def test_descriptors(spark):
    rows = spark.createDataFrame([("a.csproj", '<ProjectReference Include="..\\B\\B.csproj" /><PackageReference Include="X" Version="1.2" />'), ("s.sln", 'Project("{1}") = "A", "A\\A.csproj", "{2}"')], "path string, text string")
    assert {(r.source_fqn, r.target) for r in files.project_imports(rows).collect()} == {("a.csproj", "../B/B.csproj"), ("a.csproj", "X/1.2"), ("s.sln", "A/A.csproj")}


def test_stamps_and_batches(spark):
    now = F.lit("2024-01-02").cast("timestamp")
    diff = spark.createDataFrame([("n", "new"), ("d", "new"), ("m", "modified"), ("g", "deleted")], "path string, status string")
    stored = spark.createDataFrame([("m", None), ("k", None), ("g", None)], "path string, content_changed_at timestamp")
    git = spark.createDataFrame([("n", "2020-01-01", False), ("d", "2020-01-01", True)], "path string, c string, dirty boolean").select("path", F.col("c").cast("timestamp").alias("committed_at"), "dirty")
    out = {r.path: r.content_changed_at and r.content_changed_at.year for r in incremental.content_stamps(diff, stored, git, now).collect()}
    assert out == {"n": 2020, "d": 2024, "m": 2024, "k": None}
    assert incremental.token_batches([5, 9, 5, 1], 10) == [[1], [0, 2], [3]]


def test_tags(spark):
    from codeloom.functions import tags

    page = "'use server'\nimport { create } from 'zustand'\nconst s = create(() => 1)\n"
    rows = spark.createDataFrame([("/r/app/x/page.tsx", page), ("a.ts", "x\n" * 12 + "'use client'")], "p string, t string")
    assert [r[0] for r in rows.select(tags.script_file(F.col("p"), F.col("t"))).collect()] == [["[USE_SERVER]", "[NEXT_PAGE]", "[ZUSTAND_STORE]"], []]
    one = spark.createDataFrame([("a.tsx", "function", "useThing", "export function useThing() { admin.auth(); updateDoc(x); return <A.Provider value={1}/> }")], "p string, k string, n string, t string")
    got = one.select(tags.script_symbol(F.col("p"), F.col("k"), F.col("n"), F.col("t"), F.array(F.lit("[USE_SERVER]")))).first()[0]
    assert got[:6] == ["[REACT_COMPONENT]", "[ELEVATED_PRIVILEGE]", "[HOOK]", "[CONTEXT_PROVIDER]", "[FIRESTORE_MUTATION]", "[SERVER_ACTION]"]
    assert one.select(tags.csharp_symbol(F.lit("Go"), F.lit("[HttpPost, Authorize] void Go() {}"))).first()[0] == ["[CS_AUTHORIZE]", "[CS_HTTP_MUTATE]"]
    assert one.select(tags.cpp_symbol(F.lit("go"), F.lit("strcpy(a, b); system(c);"))).first()[0] == ["[CPP_UNSAFE_BUF]", "[CPP_EXEC_CMD]"]


# maintenance

def test_reindex_survives_a_crash(spark, tmp_path):
    """A run that dies before its commit leaves the version before it; the next run does the whole job."""
    from codeloom.operators.incremental import reindex
    from codeloom.sources.files import Snapshots

    store = Snapshots(spark, str(tmp_path / "index"))
    disk = lambda rows: spark.createDataFrame(rows, "path string, content_hash string, text string")
    build = lambda changed: changed.select("path", F.explode(F.split("text", " ")).alias("word"))
    read = lambda: sorted(tuple(r) for r in spark.read.parquet(f"{store.current()}/rows").collect())
    first = reindex(store, disk([("a", "1", "x y"), ("b", "1", "z")]), build)
    assert read() == [("a", "x"), ("a", "y"), ("b", "z")]
    assert reindex(store, disk([("a", "1", "x y"), ("b", "1", "z")]), build) == first  # nothing changed

    later = disk([("a", "2", "w"), ("c", "1", "v")])

    def breaks(changed):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        reindex(store, later, breaks)
    assert store.current() == first and len(read()) == 3
    reindex(store, later, build)
    assert read() == [("a", "w"), ("c", "v")]


def test_reindex_holds_mass_deletions(spark, tmp_path):
    from codeloom.operators.incremental import apply_run

    stored = spark.createDataFrame([(f"f{i}", "1") for i in range(100)], "path string, content_hash string")
    disk = stored.where("path = 'f1'")
    assert {r["action"]: r["count"] for r in apply_run(disk, stored).groupBy("action").count().collect()} == {"kept": 1, "held": 99}
    assert apply_run(disk, stored, confirmed=True).count() == 1


def test_containing_keeps_repeated_points(spark):
    from codeloom.operators.joins import containing

    points = spark.createDataFrame([("a", 3)] * 3 + [("a", 99)], "path string, line int")
    spans = spark.createDataFrame([("a", 1, 5, "f")], "path string, start_line int, end_line int, fqn string")
    assert sorted((r["line"], r["enclosing"] or "") for r in containing(points, spans).collect()) == [(3, "f")] * 3 + [(99, "")]


def test_long_hunk(spark):
    """A range of a million lines touches an outer symbol by its own lines only."""
    from codeloom.operators.joins import hunk_overlap

    symbols = spark.createDataFrame([("a", "outer", 1, 900_000), ("a", "inner", 10, 20), ("a", "late", 950_000, 950_010), ("b", "other", 1, 9)], "path string, fqn string, start_line int, end_line int")
    hunk = lambda a, b: spark.createDataFrame([("a", [(a, b)], [])], "path string, ranges array<struct<a:int,b:int>>, points array<int>")
    touched = lambda a, b: sorted(r["fqn"] for r in hunk_overlap(hunk(a, b), symbols).collect())
    assert touched(1, 1_000_000) == ["inner", "late", "outer"]
    assert touched(12, 15) == ["inner"] and touched(12, 21) == ["inner", "outer"] and touched(900_001, 900_002) == []


def test_analysis_report(spark):
    import json

    from codeloom.operators import analytics
    from codeloom.plans import tools

    edges = spark.createDataFrame([("p/a::f", "p/a::g", "CALLS"), ("p/a::g", "p/a::f", "CALLS"), ("q/b::h", "q/b::k", "CALLS"), ("p/a::C", "p/a::f", "OWNS")], "src string, dst string, kind string")
    owns = spark.createDataFrame([("p/a::C", "p/a::f")], "owner string, member string")
    report = json.loads(tools.community_report(analytics.analyze(edges, owns, path="p/", min_size=2, splits=True), "json"))
    assert [c["size"] for c in report["communities"]] == [3] and report["god_objects"] == [] and report["splits"] == []
    assert "## communities" in tools.community_report(analytics.analyze(edges, owns))
    assert sorted(r[0] for r in analytics.coupled_core(analytics.aggregate_edges(edges)).collect()) == ["p/a::f", "p/a::g", "q/b::h", "q/b::k"]


def test_scan_drops_bad_bytes(spark, tmp_path):
    from codeloom.sources.files import scan_folder

    (tmp_path / "a.py").write_bytes(b"x = 1\r\n\xff# \xc3\xa9")
    assert {r["path"]: r["text"] for r in scan_folder(spark, str(tmp_path)).collect()} == {"a.py": "x = 1\n# é"}


def test_embedder_and_manifest(tmp_path):
    from codeloom.sources.files import EmbedderConfig, read_manifest

    assert EmbedderConfig.load({"embeddings": {"dimension": "8"}}).dimension == 8 and EmbedderConfig.load({}) == EmbedderConfig()
    with pytest.raises(ValueError):
        EmbedderConfig.load({"embeddings": {"size": 1}})
    (tmp_path / "m.toml").write_text('[[repos]]\nname = "one"\n')
    (tmp_path / "own.toml").write_text('[[repos]]\nname = "two"\n')
    names = lambda *p: [r["name"] for r in read_manifest(*map(str, p))]
    assert names(tmp_path / "m.toml", tmp_path / "none.toml") == ["one"] and names(tmp_path / "m.toml", tmp_path / "own.toml") == ["one", "two"]


def test_vector_top_k_of_several_cells_and_ties(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 24)).astype(np.float32).astype(float)
    x[700:1300] = x[:600]  # equal vectors in other cells and places
    rows = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<double>, tier int")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else Spark puts a small table's cells in one partition
    try:
        one = vector.top_k(asked, rows, 10).collect()
        tiers = vector.top_k(asked, rows, 4, by="tier").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    score = {i: np.add.accumulate(x * x[i], axis=1)[:, -1] for i in range(0, 1500, 50)}
    best = lambda i, of, k: sorted(of, key=lambda j: (-score[i][j], j))[:k]
    assert sorted((r["query_id"], r["rank0"], r["vec_id"], r["score"]) for r in one) == [(i, n, j, score[i][j]) for i in score for n, j in enumerate(best(i, range(1500), 10))]
    assert sorted((r["query_id"], r["tier"], r["rank0"], r["vec_id"]) for r in tiers) == [(i, str(t), n, j) for i in score for t in range(3) for n, j in enumerate(best(i, range(t, 1500, 3), 4))]


def joined_rows(df):
    """Rows out of each join of a plan that is run here."""
    met, todo = [], [df._jdf.queryExecution().executedPlan()]
    df.collect()
    while todo:
        node = todo.pop()
        if "Join" in node.nodeName():
            met.append(node.metrics().apply("numOutputRows").value())
        todo += [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if node.nodeName().endswith("QueryStage") else [node.children().apply(i) for i in range(node.children().size())]
    return met


def test_containing_looks_each_place_up_once(spark):
    """Many equal points in many equal intervals: the join's rows are the places' spans, not the product."""
    points = spark.range(2000).select(F.lit("f").alias("path"), (F.col("id") % 4 + 10).cast("int").alias("line"), F.col("id").alias("at"))
    spans = spark.range(3000).select(F.lit("f").alias("path"), (F.col("id") % 2 + 1).cast("int").alias("start_line"), F.lit(90).alias("end_line"), F.concat(F.lit("s"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("fqn"))
    for innermost, want in ((False, "s0000"), (True, "s2999")):
        found = joins.containing(points, spans, innermost=innermost)
        assert {(r["enclosing"], r["n"]) for r in found.groupBy("enclosing").agg(F.count("*").alias("n")).collect()} == {(want, 2000)}
        met = joined_rows(found)
        assert met and max(met) <= 2000


def test_heritage_of_common_names(spark):
    """Edges meet a name's counts, not each type of that name; repeated rows and unknown sources count as they did."""
    symbols = [(f"T{i}", f"f{i % 7}", "class", "Common") for i in range(500)] + [(f"E{i}", f"g{i % 5}", "class", f"E{i}") for i in range(300)]
    symbols += [("N1", "f0", "class", "Near"), ("N2", "f1", "class", "Near"), ("O1", "f9", "class", "Only"), ("X", "f1", "class", "X"), ("X", "f1", "class", "X"), ("Y", "h", "class", "Y"), ("F", "f9", "function", "Only")]
    edges = [(f"E{i}", "Common", "EXTENDS", None) for i in range(300)] + [("X", "Near", "EXTENDS", None), ("Y", "Only", "EXTENDS", None), ("T1", "Near", "IMPLEMENTS", None), ("?", "Only", "EXTENDS", None), ("?", "Near", "EXTENDS", None)]
    edges += [("Y", "Only", "IMPLEMENTS", None)] * 2
    bound = joins.bind_heritage(spark.createDataFrame(edges, "source_fqn string, target string, kind string, resolved_target string"), spark.createDataFrame(symbols, "fqn string, path string, kind string, name string"))
    want = [("?", "O1", "EXTENDS"), ("T1", "N2", "IMPLEMENTS"), ("Y", "O1", "EXTENDS")]
    assert sorted((r["source_fqn"], r["target"], r["kind"]) for r in bound.collect()) == want
    assert max(joined_rows(bound)) <= 400
