"""Source parsers: functions from (path, text) to records, and the table function that applies them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import braces, l5x, python

#: The registry: extension to a function (path, text) -> records. Add to it to support a language.
PARSERS: dict[str, Callable[[str, str], list[dict]]] = {
    ".py": python.parse,
    ".l5x": l5x.parse,
    **{e: braces.parse_script for e in (".ts", ".tsx", ".js", ".jsx", ".mjs", ".gs")},
    ".cs": braces.parse_csharp,
    **{e: braces.parse_cpp for e in (".cpp", ".cc", ".h", ".hpp")},
}
#: A record: what it is (symbol, edge, ref, type) and the fields that its kind uses.
RECORD = "record string, path string, fqn string, kind string, name string, class_context string, start_line int, end_line int, text string, shared boolean, target string, receiver_type string, bound_module string, member_call boolean, line int, return_type string, params array<struct<name:string,type:string>>, is_async boolean, is_generator boolean"
#: Test files by extension: suffixes and name patterns.
TEST_FILES = {".py": r"(^|/)(test_[^/]*|[^/]*_test)\.py$", ".ts": r"\.(test|spec)\.tsx?$", ".tsx": r"\.(test|spec)\.tsx?$", ".js": r"\.(test|spec)\.jsx?$", ".cs": r"Tests?\.cs$", ".cpp": r"(_test|_tests|Test)\.(cpp|cc)$"}


def parse_file(path: str, text: str) -> list[dict]:
    """Records of one file; a file that can't be parsed or has no parser gives none."""
    parser = PARSERS.get("." + path.rsplit(".", 1)[-1].lower() if "." in path else "")
    if parser is None:
        return []
    try:
        return parser(path, text)
    except (SyntaxError, ValueError, RecursionError):
        return []


def parse_files(files: DataFrame) -> DataFrame:
    """All records of all files (path, text), one row each, over Arrow batches; cut it by ``record``."""
    import pandas as pd
    from pyspark.sql.types import _parse_datatype_string

    names = [f.name for f in _parse_datatype_string(RECORD).fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for p, t in zip(pdf.path, pdf.text.fillna("")) for r in parse_file(p, t)]
            out = pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)
            yield out

    return files.select("path", "text").mapInPandas(run, RECORD)


def symbols(records: DataFrame) -> DataFrame:
    return records.where("record = 'symbol'").select("fqn", "path", "kind", "name", "class_context", "start_line", "end_line", "text", "shared")


def edges(records: DataFrame) -> DataFrame:
    return records.where("record = 'edge'").select(F.col("fqn").alias("source_fqn"), "target", "kind", "receiver_type", "bound_module", "member_call").dropDuplicates(["source_fqn", "target", "kind"])


def references(records: DataFrame) -> DataFrame:
    return records.where("record = 'ref'").select("path", F.col("name").alias("symbol_name"), F.col("target").alias("symbol_fqn"), "line", F.col("kind").alias("ref_kind"), F.col("fqn").alias("context_fqn"))


def types(records: DataFrame) -> DataFrame:
    return records.where("record = 'type'").select("fqn", "return_type", "params", "is_async", "is_generator")
