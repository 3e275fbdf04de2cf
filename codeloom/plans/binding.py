"""The code model laid over the driver's tables, in SQL that Spark and DuckDB both run.

``{name}`` stands for a table or for another binding.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _s(x: str) -> str:
    return f"CAST({x} AS STRING)"


BINDINGS = {
    "files": f"SELECT concat('src/d', {_s('doc_id')}, CASE doc_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '.cs' END) AS path, doc_id, md5(text) AS content_hash, text, lang, source, n_chars FROM {{documents}}",
    "disk": "SELECT path, CASE WHEN doc_id % 7 = 0 THEN concat('x', content_hash) ELSE content_hash END AS content_hash FROM {files} WHERE doc_id % 11 <> 0",
    "stored": "SELECT path, content_hash FROM {files} WHERE doc_id % 13 <> 0",
    "chunks": f"SELECT doc_id, path, concat(path, '::s', {_s('doc_id % 5')}) AS scope, CAST(doc_id % 3 + 1 AS INT) AS tier, CAST(doc_id % 400 + 1 AS INT) AS start_line, CAST(doc_id % 400 + 20 AS INT) AS end_line, text FROM {{files}}",
    "symbols": f"""SELECT concat('C', {_s('c_custkey')}) AS fqn, concat('src/n', {_s('c_nationkey')}, '.py') AS path, 'class' AS kind, concat('K', {_s('c_custkey % 97')}) AS name, CAST(c_custkey % 900 + 1 AS INT) AS start_line, CAST(c_custkey % 900 + 40 AS INT) AS end_line FROM {{customer}}
        UNION ALL SELECT concat('P', {_s('p_partkey')}), concat('src/p', {_s('p_partkey % 50')}, '.ts'), 'function', concat('fn', {_s('p_partkey % 700')}), CAST(p_partkey % 600 + 1 AS INT), CAST(p_partkey % 600 + 12 AS INT) FROM {{part}}
        UNION ALL SELECT concat('S', {_s('s_suppkey')}), concat('src/n', {_s('s_nationkey')}, '.py'), 'class', concat('K', {_s('s_suppkey % 61')}), CAST(s_suppkey % 900 + 1 AS INT), CAST(s_suppkey % 900 + 25 AS INT) FROM {{supplier}}""",
    "calls": f"""SELECT concat('C', {_s('o_custkey')}) AS source_fqn, concat('P', {_s('l_partkey')}) AS target, 'CALLS' AS kind, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE concat('P', {_s('l_partkey')}) END AS resolved_target, min(l_discount) > 0.04 AS candidate, CASE WHEN max(l_tax) > 0.05 THEN NULL ELSE round(max(l_tax) * 10, 2) END AS confidence
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey WHERE l_linenumber <= 2 GROUP BY o_custkey, l_partkey
        UNION ALL SELECT concat('P', {_s('l_partkey')}), concat('S', {_s('l_suppkey')}), 'CALLS', concat('S', {_s('l_suppkey')}), min(l_discount) > 0.06, CAST(NULL AS DOUBLE) FROM {{lineitem}} WHERE l_linenumber = 3 GROUP BY l_partkey, l_suppkey""",
    "edges": f"""SELECT source_fqn, target, kind, resolved_target, candidate, confidence FROM {{calls}}
        UNION ALL SELECT concat('S', {_s('min(l_suppkey)')}), concat('P', {_s('l_partkey')}), 'OWNS', concat('P', {_s('l_partkey')}), false, CAST(NULL AS DOUBLE) FROM {{lineitem}} GROUP BY l_partkey
        UNION ALL SELECT concat('src/n', {_s('a.n_nationkey')}, '.py'), concat('src/n', {_s('b.n_nationkey')}, '.py'), 'IMPORTS', concat('src/n', {_s('b.n_nationkey')}, '.py'), false, CAST(NULL AS DOUBLE) FROM {{nation}} a JOIN {{nation}} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey
        UNION ALL SELECT concat('C', {_s('c_custkey')}), concat('K', {_s('c_custkey * 7 % 97')}), 'EXTENDS', CAST(NULL AS STRING), false, CAST(NULL AS DOUBLE) FROM {{customer}} WHERE c_custkey % 5 = 0""",
    "refs": f"SELECT concat('src/n', {_s('c_nationkey')}, '.py') AS path, concat('K', {_s('c_custkey % 97')}) AS symbol_name, concat('C', {_s('c_custkey')}) AS symbol_fqn, CAST(o_orderkey % 900 + 1 AS INT) AS line, CASE WHEN o_orderstatus = 'F' THEN 'CALL' ELSE 'READ' END AS ref_kind, concat('o', {_s('o_orderkey')}) AS context_fqn FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey",
    "docs_files": f"SELECT DISTINCT concat('src/n', {_s('n_nationkey')}, '.py') AS path FROM {{nation}}",
    "small": "SELECT source_fqn AS src, coalesce(resolved_target, target) AS dst, kind FROM {edges} WHERE kind IN ('CALLS', 'OWNS', 'IMPORTS')",
    "ranked": "SELECT e.vec_id % 20 AS query_id, e.vec_id AS item, e.label, row_number() OVER (PARTITION BY e.vec_id % 20 ORDER BY e.embedding[{first}] DESC, e.vec_id) - 1 AS rank0 FROM {embeddings} e",
}


@cache
def _names(sql: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def duck(sql: str) -> str:
    """The SQL for DuckDB: bindings become common table expressions."""
    need: list[str] = []

    def visit(text: str) -> None:
        for n in _names(text):
            if n in BINDINGS and n not in need:
                visit(BINDINGS[n])
                need.append(n)

    visit(sql)
    plain = lambda t: re.sub(r"\{(\w+)\}", lambda m: "1" if m[1] == "first" else m[1], t)  # noqa: E731  lists count from 1 there
    with_ = ", ".join(f"{n} AS ({plain(BINDINGS[n])})" for n in need)
    text = plain(sql)
    if with_ and text.startswith("WITH "):  # the query has common table expressions of its own
        return f"WITH {with_}, {text.removeprefix('WITH ')}"
    return (f"WITH {with_} " if with_ else "") + text


class Model:
    """The driver's tables and bindings of one folder as DataFrames, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                self._made[name] = self.sql(BINDINGS[name])
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        frames = {n: getattr(self, n) for n in _names(text) if n != "first"}
        return self.spark.sql(text.replace("{first}", "0"), **frames)
