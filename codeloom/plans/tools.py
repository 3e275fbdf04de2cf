"""The tool queries: composed plans over retrieval results and the code model.

``hits`` is a ranking: query_id, item, path, scope, text, score, pos, source. Results are rows with a
``bucket``; rendering them is left to the caller (``render``).
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, joins, lookup, rank, vector

#: Fixed values of the tools' thresholds.
HIGH, KEYWORD_BONUS, MISMATCH, ORIGIN = 0.72, 0.05, 0.2, 0.99
TEST_PATH = r"(?i)(^|/)(tests?|__tests__|spec)/|(^|/)test_[^/]*\.py$|_test\.\w+$|\.(test|spec)\.\w+$|Tests?\.cs$"


def semantic_code_search(queries: DataFrame, chunks: DataFrame, k: int = 15, budget: int = 4000) -> DataFrame:
    """Three-tier retrieval by reciprocal ranks, then greedy packing to a token budget. ``chunks`` has vec_id,
    embedding, tier, path, scope, text."""
    ranked = vector.rrf(vector.top_k(queries, chunks, 50, by="tier"), "vec_id", k=k)
    rows = ranked.join(chunks.select("vec_id", "path", "scope", "text"), "vec_id").withColumnRenamed("rank", "pos")
    rows = rows.withColumn("n_tokens", F.size(vector.tokens(F.col("text")))).withColumn("text", T.redact(F.col("text")))
    return rank.pack_skipping(rows, budget)


def find_similar_code(hits: DataFrame, snippet: str, symbol: str | None = None, weak: int = 4) -> DataFrame:
    """First hit of each file as origin, caller, high or weak (at most ``weak``)."""
    flat = re.sub(r"\s+", "", snippet)
    top = hits.groupBy(F.col("query_id").alias("__q")).agg(F.max("score").alias("__top"))  # one row a query
    body = F.regexp_replace("text", r"\s+", "")
    writes, reads = T.op_profile(F.col("text"))
    low = snippet.lower()
    w, r = any(v in low for v in T.WRITE_VERBS), any(v in low for v in T.READ_VERBS)
    mismatch = (reads & ~writes) if w and not r else (writes & ~reads) if r and not w else F.lit(False)
    mine = sorted({x for x in re.findall(r"[a-zA-Z_]\w{3,}", snippet) if x.lower() not in T.STOP_WORDS and (re.search("[A-Z]", x) or "_" in x)})
    words = T.domain_keywords(F.coalesce("text", F.lit("")))
    shared = F.size(F.array_intersect(words, F.array(*map(F.lit, mine)))) if mine else F.lit(0)
    # what reads texts comes before the shuffles, which then need no texts; blank texts are part of no snippet
    told = hits.withColumn("__same", F.coalesce(body.contains(flat) | ((body != "") & F.lit(flat).contains(body)), F.lit(False)))
    told = told.withColumn("__caller", F.col("text").contains(symbol) if symbol else F.lit(False)).withColumn("__shared", shared).withColumn("__mismatch", mismatch)
    rows = rank.first_per_file(told).join(F.broadcast(top), F.col("query_id").eqNullSafe(F.col("__q")))
    origin = F.col("__same") | (F.col("score") >= ORIGIN * F.col("__top"))
    rated = F.col("score") / F.col("__top") + KEYWORD_BONUS * F.col("__shared") - F.when(F.col("__mismatch"), MISMATCH).otherwise(0.0)
    bucket = F.when(origin, "origin").when(F.col("__caller"), "caller").when(rated >= HIGH, "high").otherwise("weak")
    return rank.bucket_cap(rows.withColumn("bucket", bucket).withColumn("rated", rated), "bucket", {"weak": weak}).drop("__q", "__top", "__same", "__caller", "__shared", "__mismatch")


def analyze_blast_radius(hits: DataFrame, edges: DataFrame, anchor: str, symbol: str, parallel: int = 10) -> DataFrame:
    """Files that a change of the anchor reaches: importers (also those that retrieval missed), callers by
    verified or candidate edge, primitives that the anchor imports, and files that look alike."""
    stem = T.module_stem(F.lit(anchor))
    imports = edges.where(F.col("kind") == "IMPORTS").select("source_fqn", F.coalesce("resolved_target", "target").alias("to"))
    importing = imports.where((F.col("to") == anchor) | (T.module_stem(F.col("to")) == stem)).select(F.col("source_fqn").alias("path")).distinct().withColumn("imports", F.lit(True))
    used = imports.where(F.col("source_fqn") == anchor).select(F.col("to").alias("path")).distinct().withColumn("used", F.lit(True))
    first = rank.first_per_file(hits).select("path", "score", "pos", F.col("text").contains(symbol).alias("names"))
    rows = first.join(importing, "path", "full").join(used, "path", "left")
    bucket = F.when(F.col("path") == anchor, "anchor").when(F.col("imports"), "dependents").when(F.col("used"), "primitives").when(F.coalesce("names", F.lit(False)), "dependents").otherwise("parallel")
    rows = rows.withColumn("query_id", F.lit(0)).withColumn("bucket", bucket).withColumn("pos", F.coalesce("pos", F.lit(1 << 30)))
    files = rank.bucket_cap(rows, "bucket", {"parallel": parallel}).select("path", "bucket")
    called = graph.neighbours(edges, symbol, "called_by")
    how = F.when(F.col("confidence") >= graph.CONFIDENCE_FLOOR, "edge_verified").otherwise("edge_candidate")
    return files.unionByName(called.select(F.col("fqn").alias("path"), how.alias("bucket")))


def detect_pattern_violations(hits: DataFrame, every: DataFrame, snippet: str, symbols: list[str], ignore: str | None = None) -> DataFrame:
    """compliant (uses a canonical symbol), violation, possible or exempt; files that retrieval missed but that
    share two strong words with the snippet are swept in at .45 of the top score."""
    strong = sorted({w for w in re.findall(r"[a-zA-Z_]\w{3,}", snippet) if w not in T.STOP_WORDS and (re.search("[A-Z]", w) or "_" in w)})
    top = hits.agg(F.max("score").alias("top"))
    shared = F.size(F.filter(F.array(*map(F.lit, strong)).cast("array<string>"), lambda w: F.col("text").contains(w)))
    first = rank.first_per_file(hits).select("path", "text", "score")
    swept = every.select("path", "text").where(shared >= 2).join(first, "path", "left_anti").join(F.broadcast(top)).select("path", "text", (F.col("top") * 0.45).alias("score"))  # one row
    rows = first.unionByName(swept).join(F.broadcast(top)).withColumn("shared", shared)
    uses = F.lit(False)
    for s in symbols:
        uses = uses | F.col("text").contains(s)
    exempt = F.col("path").rlike(TEST_PATH) | (F.col("text").rlike(ignore) if ignore else F.lit(False))
    writes, reads = T.op_profile(F.col("text"), gated=True)
    w, r = _profile(snippet)
    same = (writes if w else F.lit(False)) | (reads if r else F.lit(False)) | F.lit(not w and not r)
    relevant = (F.col("score") >= 0.65 * F.col("top")) | (F.col("shared") >= 2)
    bucket = F.when(exempt, "exempt").when(uses, "compliant").when(relevant & same & (F.col("shared") >= 2), "violation").when(relevant, "possible")
    return rows.withColumn("bucket", bucket).where("bucket is not null").select("path", "bucket", "score", "shared")


def _profile(snippet: str) -> tuple[bool, bool]:
    low = snippet.lower()
    return bool(re.search(T.STORE_WRITE, snippet)) or any(v in low for v in T.OTHER_WRITE_VERBS), any(v in low for v in T.READ_VERBS)


#: Definition and producer patterns by extension; ``{name}`` stands for the symbol.
FLOW_RULES = [
    (".py", "definition", r"\b(?:class|def)\s+{name}\b|^\s*{name}\s*[:=]"), (".py", "producer", r"\breturn\s+.*\b{name}\(|\byield\s+.*\b{name}\b"),
    (".ts", "definition", r"\b(?:interface|type|class|const|function)\s+{name}\b"), (".ts", "producer", r"\bnew\s+{name}\b|:\s*{name}\s*=\s*\{|\bas\s+{name}\b"),
    (".cs", "definition", r"\b(?:class|interface|record|struct|enum)\s+{name}\b"), (".cs", "producer", r"\bnew\s+{name}\b"),
    (".cpp", "definition", r"\b(?:class|struct|enum)\s+{name}\b"), (".cpp", "producer", r"\bmake_(?:unique|shared)<{name}>|\bnew\s+{name}\b"),
]


def trace_data_flow(hits: DataFrame, every: DataFrame, symbol: str) -> DataFrame:
    """DEFINITIONS, PRODUCERS, TRANSFORMERS (12), CONSUMERS (15) and the layer of each file, the first rule that holds."""
    rules = {}
    for ext, role, pattern in FLOW_RULES:
        rules.setdefault(role, []).append(F.col("path").endswith(ext) & F.col("text").rlike("(?m)" + pattern.replace("{name}", re.escape(symbol))))
    any_of = lambda role: _or(rules[role])
    names = F.col("text").contains(symbol)
    stores = names & F.col("text").contains("(") & F.col("text").rlike(T.STORE_WRITE)
    transforms = T._has(F.col("text"), ".filter(", ".map(", ".sort(", "useMemo(") & names
    bucket = F.when(any_of("definition"), "DEFINITIONS").when(any_of("producer") | stores, "PRODUCERS").when(transforms, "TRANSFORMERS").when(names, "CONSUMERS")
    # buckets and layers are told where the texts are read: the shuffles need no texts
    told = lambda rows: rows.withColumn("bucket", bucket).withColumn("layer", F.when(F.col("bucket").isNotNull(), T.trace_layer(F.col("path"), F.col("text"))))
    found = rank.first_per_file(told(hits)).select("path", "bucket", "layer", "pos")
    swept = told(every.select("path", "text").where(names & (any_of("definition") | any_of("producer")))).join(found, "path", "left_anti").select("path", "bucket", "layer", F.lit(1 << 30).alias("pos"))
    rows = found.unionByName(swept).where("bucket is not null").withColumn("query_id", F.lit(0))
    return rank.bucket_cap(rows, "bucket", {"TRANSFORMERS": 12, "CONSUMERS": 15}).select("path", "bucket", "layer", "pos")


def _or(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def apply_rules(docs: DataFrame, rules: list[dict], concept: str | None = None) -> DataFrame:
    """Risk rules (id, layer, pattern, require_concept, severity, message) over path, text, layer: the first hit of each rule and file.
    Rules are configuration, so they become one array of conditions; no join."""
    hits = []
    for r in rules:
        cond = F.col("text").rlike("(?i)" + r["pattern"])
        if r.get("layer"):
            cond = cond & (F.col("layer") == r["layer"])
        if r.get("require_concept"):
            cond = cond & (F.col("text").contains(concept) if concept else F.lit(False))
        hits.append(F.when(cond, F.struct(F.lit(r["id"]).alias("id"), F.lit(r.get("severity", "info")).alias("severity"), F.lit(r.get("message", "")).alias("message"))))
    found = docs.select("path", "layer", F.explode(F.array_compact(F.array(*hits))).alias("r"))
    return found.select("path", "layer", "r.*").dropDuplicates(["path", "id"])


def investigate_architecture(hits: DataFrame, concept: str, rules: list[dict] = ()) -> tuple[DataFrame, DataFrame]:
    """(role and layer of each hit, risks)."""
    rows = rank.first_per_file(hits).withColumn("layer", T.layer(F.col("path"), F.col("text")))
    rows = rows.withColumn("role", T.relationship(F.col("path"), F.col("text"), F.col("source"), concept))
    return rows.select("path", "role", "layer", "score"), apply_rules(rows, list(rules), concept) if rules else rows.select("path", "layer").limit(0)


def find_test_coverage(files: DataFrame, hits: DataFrame, source_file: str, symbol: str | None = None, semantic: int = 5) -> DataFrame:
    """Test files: direct (named after the source) in a related folder or elsewhere, and semantic ones."""
    tests = files.where(F.col("path").rlike(TEST_PATH)).select("path")
    stem = source_file.rsplit("/", 1)[-1].split(".")[0].lower()
    name = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    folder = source_file.rsplit("/", 1)[0] if "/" in source_file else ""
    top = folder.split("/")[0]
    related = F.col("path").startswith(folder + "/") | F.col("path").startswith(f"tests/{folder}/") | (F.col("path").startswith(top + "/") if top else F.lit(True))
    direct = tests.where(name.contains(stem)).select("path", F.when(related, "direct").otherwise("elsewhere").alias("bucket"))
    near = rank.first_per_file(hits).where(F.col("path").rlike(TEST_PATH))
    if symbol:
        near = near.where(F.col("text").contains(symbol) | F.col("score").isNotNull())
    near = near.join(direct, "path", "left_anti").orderBy("pos", "path").limit(semantic).select("path", F.lit("semantic").alias("bucket"))
    return direct.unionByName(near)


def index_status(files: DataFrame, chunks: DataFrame, vectors: DataFrame, since: Column | None = None, limit: int = 50) -> dict[str, DataFrame]:
    out = {"consistency": lookup.tier_consistency(chunks, vectors)}
    if since is not None:
        out["changed"] = lookup.changed_since(files, since, limit)
    return out


def find_dead_code(edges: DataFrame, every: DataFrame, symbol: str, anchor: str, fqn: str) -> DataFrame:
    """One row: REFERENCED if an edge is verified or another file names the symbol; INSUFFICIENT if there are
    only candidates; else DEAD."""
    callers = graph.neighbours(edges, fqn, "called_by").where(F.col("fqn") != fqn)
    calls = callers.agg(F.count_if(F.col("confidence") >= graph.CONFIDENCE_FLOOR).alias("verified"), F.count_if(F.col("confidence") < graph.CONFIDENCE_FLOOR).alias("candidates"))
    named = every.where((F.col("path") != anchor) & F.col("text").rlike(rf"(?<![\w$]){re.escape(symbol)}(?![\w$])")).agg(F.count("*").alias("consumers"))
    verdict = F.when((F.col("verified") > 0) | (F.col("consumers") > 0), "REFERENCED").when(F.col("candidates") > 0, "INSUFFICIENT").otherwise("DEAD")
    return calls.join(F.broadcast(named)).withColumn("verdict", verdict)  # one row each


def verify_candidate_edges(edges: DataFrame, symbols: DataFrame, fqn: str, most: int = 400) -> DataFrame:
    """Candidate callers with the first characters of their source."""
    callers = graph.neighbours(edges, fqn, "called_by").where(F.col("confidence") < graph.CONFIDENCE_FLOOR)
    return callers.join(symbols.select("fqn", "path", F.substring("text", 1, most).alias("source")), "fqn", "left")


def what_writes(edges: DataFrame, refs: DataFrame, tag: str, readers: bool = False) -> DataFrame:
    """Routines that write (and read) a tag or an alias of it, with the rungs."""
    names = edges.where((F.col("kind") == "ALIAS_OF") & (F.coalesce("resolved_target", "target") == tag)).select(F.col("source_fqn").alias("t"))
    names = names.unionByName(names.sparkSession.createDataFrame([(tag,)], "t string")).distinct()
    kinds = ["WRITES", "READS"] if readers else ["WRITES"]
    hit = edges.where(F.col("kind").isin(*kinds)).withColumn("t", F.coalesce("resolved_target", "target")).join(F.broadcast(names), "t")
    lines = refs.withColumn("kind", F.concat(F.col("ref_kind"), F.lit("S"))).groupBy(F.col("context_fqn").alias("source_fqn"), F.col("symbol_fqn").alias("t"), "kind").agg(F.array_sort(F.collect_set("line")).alias("rungs"))
    return hit.select("source_fqn", "t", "kind").distinct().join(lines, ["source_fqn", "t", "kind"], "left")


def find_unabstracted_reads(hits: DataFrame, texts: DataFrame, collection: str, canon: list[str]) -> DataFrame:
    """Files that read a collection: compliant by a canonical helper only, violation by the raw collection, partial
    by both, else ambiguous; files that only write are left out. ``texts``: path, text of whole files."""
    rows = rank.first_per_file(hits).select("path").join(texts, "path")
    raw = F.col("text").rlike(rf"collection\(\s*[^)]*['\"]{re.escape(collection)}['\"]|['\"]{re.escape(collection)}['\"]")
    helper = _or([F.col("text").contains(c) for c in canon])
    writes, reads = T.op_profile(F.col("text"), gated=True)
    bucket = F.when(raw & helper, "partial").when(helper, "compliant").when(raw & reads, "violation").when(F.col("text").contains(collection), "ambiguous")
    return rows.where(~(writes & ~reads)).withColumn("bucket", bucket).where("bucket is not null").select("path", "bucket")


def file_outline(symbols: DataFrame, path: str) -> DataFrame:
    """A file's symbols with depth (how many enclose each) and signature."""
    @F.pandas_udf("string")
    def sign(text: pd.Series) -> pd.Series:
        return text.fillna("").map(T.signature)

    own = symbols.where(F.col("path") == path)
    outer = own.select(F.col("fqn").alias("o"), F.col("start_line").alias("a"), F.col("end_line").alias("b"), F.col("path").alias("p"))
    inside = (own["path"] == outer["p"]) & (outer["a"] <= own["start_line"]) & (own["end_line"] <= outer["b"]) & (outer["o"] != own["fqn"])
    depth = own.join(outer, inside, "left").groupBy("fqn").agg(F.count("o").alias("depth"))
    return own.join(depth, "fqn").select("fqn", "kind", "start_line", "end_line", "depth", sign("text").alias("signature")).orderBy("start_line", F.desc("end_line"), "fqn")


def symbol_source(symbols: DataFrame, files: DataFrame, query: str, path: str | None = None, most: int = 400) -> DataFrame:
    """Today's source of a symbol: same, moved or changed since it was indexed; cut at 400 lines."""
    found = symbols.where(lookup.matches_symbol(F.col("fqn"), query) | (F.col("name") == query))
    if path:
        found = found.where(F.col("path") == path)

    @F.pandas_udf("start_line int, state string")
    def find(block: pd.Series, text: pd.Series, start: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([T.locate(b or "", t or "", int(s)) for b, t, s in zip(block, text, start)], columns=["start_line", "state"])

    rows = found.select("fqn", "path", "start_line", F.col("text").alias("block")).join(files.select("path", "text"), "path", "left")
    at = rows.withColumn("at", find("block", "text", "start_line"))
    return at.select("fqn", "path", "at.start_line", "at.state", F.array_join(F.slice(F.split("block", "\n"), 1, most), "\n").alias("source"))


def parse_diff(text: str) -> list[dict]:
    """``git diff -U0`` to path, status, ranges (lines of the new file) and points (where lines went)."""
    out: list[dict] = []
    for line in text.split("\n"):
        if line.startswith("diff --git "):
            out.append({"path": line.rsplit(" b/", 1)[-1], "status": "modified", "ranges": [], "points": []})
        elif line.startswith("new file") and out:
            out[-1]["status"] = "added"
        elif line.startswith("deleted file") and out:
            out[-1]["status"] = "deleted"
        elif line.startswith("rename to ") and out:
            out[-1]["path"] = line[10:]
        elif (m := re.match(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", line)) and out:
            start, n = int(m[1]), int(m[2] if m[2] is not None else 1)
            if n:
                out[-1]["ranges"].append({"a": start, "b": start + n - 1})
            else:
                out[-1]["points"].append(start)
    return out


def changed_symbols(hunks: DataFrame, symbols: DataFrame, edges: DataFrame | None = None, most: int = 25) -> tuple[DataFrame, DataFrame | None]:
    """(symbols that a diff touches, callers of the first of them)."""
    touched = joins.hunk_overlap(hunks, symbols)
    if edges is None:
        return touched, None
    first = touched.orderBy("path", "start_line", "fqn").limit(most).select("fqn")
    near = graph.adjacency(edges).where("direction = 'called_by'").join(first, F.col("node") == F.col("fqn"))
    return touched, near.select(F.col("node").alias("fqn"), F.col("next").alias("caller"), "confidence").distinct()


def render(rows: DataFrame, fmt: str = "markdown", most: int = 200) -> str:
    """The thin text layer: at most ``most`` rows as Markdown or JSON."""
    got = [r.asDict(recursive=True) for r in rows.limit(most).collect()]
    if fmt == "json":
        return json.dumps(got, default=str, ensure_ascii=False)
    head = rows.columns
    cell = lambda x: str(x).replace("|", r"\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(cell(r[c]) for c in head) + " |" for r in got)])


def community_report(analysis: dict[str, DataFrame], fmt: str = "markdown", most: int = 200) -> str:
    """The parts of an analysis as one text; communities by size, the others by score."""
    order = {"communities": [F.desc("size"), "community"], "god_objects": [F.desc("score"), "owner"], "splits": ["owner", "part"], "modularity": []}
    parts = {name: (rows.orderBy(*order[name]) if order[name] else rows) for name, rows in analysis.items()}
    if fmt == "json":
        return json.dumps({name: json.loads(render(rows, "json", most)) for name, rows in parts.items()}, ensure_ascii=False)
    return "\n\n".join(f"## {name}\n\n{render(rows, 'markdown', most)}" for name, rows in parts.items())


def dsm_html(cells: DataFrame, names: list[str], most: int = 200_000) -> str:
    """A self-contained page with the matrix's cells; the caller aggregates large graphs first."""
    data = json.dumps({"names": names, "cells": [[r[0], r[1], r[2]] for r in cells.select("row", "col", "weight").limit(most).collect()]}).replace("</", "<\\/")
    script = "const d=JSON.parse(document.getElementById('d').textContent),c=document.getElementById('m'),n=d.names.length,s=Math.max(1,Math.floor(900/n));c.width=c.height=n*s;const x=c.getContext('2d');for(const[r,k,w]of d.cells){x.fillStyle=`rgba(20,60,160,${Math.min(1,.25+w/5)})`;x.fillRect(k*s,r*s,s,s)}"
    return f"<!doctype html><meta charset=utf-8><title>Dependencies</title><canvas id=m></canvas><script type=application/json id=d>{data}</script><script>{script}</script>"
