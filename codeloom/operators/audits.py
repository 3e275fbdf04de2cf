"""Audits and surveys of controller exports, and the small evaluation tools around them."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..parsers import l5x

OPERANDS = "path string, program string, routine string, rung int, mnemonic string, arity int, place int, operand string, role string, look string"
RUNGS = "path string, program string, routine string, rung int, comment string, body string"


def look(text: str) -> str:
    """What an operand looks like: empty, number, string, expression, module, indexed, member or name."""
    if not text:
        return "empty"
    if re.fullmatch(r"[-+]?(\d+#)?[\d_.]+([eE][-+]?\d+)?", text):
        return "number"
    if text[0] in "'\"":
        return "string"
    if re.search(r"[-+*/<>=()]", re.sub(r"\[[^\]]*\]", "", text)):
        return "expression"
    return "module" if ":" in text else "indexed" if "[" in text else "member" if "." in text else "name"


def _rungs(path: str, text: str) -> list[tuple]:
    try:
        root = ET.fromstring(text.lstrip("﻿"))
    except ET.ParseError:
        return []
    out = []
    for program in root.iter("Program"):
        for routine in program.iter("Routine"):
            for rung in routine.iter("Rung"):
                number = rung.get("Number")
                out.append((path, program.get("Name"), routine.get("Name"), int(number) if number and number.isdigit() else None, l5x._text(rung.find("Comment")), l5x._text(rung.find("Text"))))
    return out


def rungs(files: DataFrame) -> DataFrame:
    """Every rung of every program of the exports (path, text)."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([r for p, t in zip(pdf.path, pdf.text.fillna("")) for r in _rungs(p, t)], columns=[c.split()[0] for c in RUNGS.split(", ")], dtype=object)

    return files.select("path", "text").mapInPandas(run, RUNGS)


def operands(rung_rows: DataFrame) -> DataFrame:
    """Every operand of every instruction, with its role by place and its look."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                for mnemonic, parts in l5x.instructions(r.body or ""):
                    out += [(r.path, r.program, r.routine, r.rung, mnemonic, len(parts), i, o, l5x.role(mnemonic, i, len(parts)), look(o)) for i, o in enumerate(parts)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OPERANDS.split(", ")], dtype=object)

    return rung_rows.mapInPandas(run, OPERANDS)


def role_audit(rows: DataFrame) -> DataFrame:
    """How operands look at each (mnemonic, arity, place), and where that contradicts their role."""
    n = rows.groupBy("mnemonic", "arity", "place", "role", "look").agg(F.count("*").alias("n"))
    wrong = (F.col("role") == "w") & F.col("look").isin("number", "string", "expression") | (F.col("role") == "r") & (F.col("look") == "string") | (F.col("role") == "l") & F.col("look").isin("member", "indexed") | (F.col("role") == "e") & (F.col("look") == "string") | (F.col("role") == "s") & (F.col("look") != "name")
    return n.withColumn("contradiction", wrong)


def resolution_audit(rows: DataFrame, tags: DataFrame) -> DataFrame:
    """Share of read and written operands whose base is a known tag (column name)."""
    base = F.regexp_extract("operand", r"^([A-Za-z_][\w:]*)", 1)
    asked = rows.where(F.col("role").isin("r", "w")).withColumn("name", base).where("name <> ''")
    known = tags.select("name").distinct().withColumn("known", F.lit(True))
    return asked.join(known, "name", "left").groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.col("known") | F.col("name").contains(":")).alias("resolved"))


def binding_check(rows: DataFrame, parameters: DataFrame) -> DataFrame:
    """Calls of add-on instructions whose operands aren't one more than the required parameters (name, n_required)."""
    calls = rows.where("place = 0").join(F.broadcast(parameters), rows["mnemonic"] == parameters["name"])
    return calls.select("path", "routine", "rung", "mnemonic", "arity", (F.col("n_required") + 1).alias("expected")).where("arity <> expected")


def controller_profile(rung_rows: DataFrame) -> DataFrame:
    """Per file: rungs, comments, and the mean, median and greatest number of rungs of a routine."""
    per = rung_rows.groupBy("path", "program", "routine").agg(F.count("*").alias("n"), F.count_if(F.col("comment") != "").alias("c"))
    return per.groupBy("path").agg(F.sum("n").alias("rungs"), F.sum("c").alias("comments"), F.avg("n").alias("mean"), F.percentile("n", 0.5).alias("median"), F.max("n").alias("most"), F.max_by("routine", F.struct("n", "routine")).alias("biggest"))


def survey(rows: DataFrame, column: str, n: int = 50) -> DataFrame:
    """Histogram of mnemonics, looks or operands."""
    return rows.groupBy(column).agg(F.count("*").alias("n"), F.count_distinct("path").alias("files")).orderBy(F.desc("n"), column).limit(n)


def scrub(rows: DataFrame, column: str, prefix: str = "Tag") -> DataFrame:
    """Replaces names by placeholders that are the same for the same name; the numbering is by name's hash order."""
    names = rows.select(F.col(column).alias("name")).where("name is not null").distinct()
    numbered = names.withColumn("no", F.dense_rank().over(Window.orderBy(F.md5("name"))))
    both = rows.join(numbered, rows[column] == numbered["name"], "left")
    return both.withColumn(column, F.when(F.col("no").isNotNull(), F.concat(F.lit(prefix), F.col("no").cast("string")))).drop("name", "no")


def allow(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Redaction by an allow-list of columns."""
    return rows.select(*(c for c in rows.columns if c in columns))


def asked_only(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries that have a judged item."""
    return queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi")


def symbol_dump(symbols: DataFrame, kinds: list[str] | None = None, pattern: str | None = None) -> DataFrame:
    out = symbols
    if kinds:
        out = out.where(F.col("kind").isin(*kinds))
    if pattern:
        out = out.where(F.col("fqn").rlike(pattern))
    return out.select("path", "kind", "fqn", "start_line").orderBy("path", "start_line", "fqn")


def tripwire(scores: DataFrame, column: str, floor: float) -> DataFrame:
    """The mean of a metric and whether it keeps to its floor."""
    mean: Column = F.coalesce(F.avg(column), F.lit(0.0))
    return scores.agg(mean.alias("mean"), (mean >= floor).alias("passed"))
