"""Resolution of call edges and imports."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_calls(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Precision-first cascade for every CALLS edge; columns source_fqn, target, resolved_target, confidence, outcome.

    In this order: a known receiver type decides alone (its only member of that name, confidence 0.9);
    an external binding resolves to nothing; an import binding to the only match in its file, else
    repo-wide if the file has none; the only match repo-wide; for Apps Script a member call is left
    ambiguous; the only match in the caller's file; for plain calls the only match in imported files.
    """
    calls = edges.where(F.col("kind") == "CALLS")
    home = symbols.select(F.col("fqn").alias("source_fqn"), F.col("path").alias("source_path"))
    calls = calls.join(home, "source_fqn", "left").withColumn("name", F.substring_index(F.substring_index("target", "::", -1), ".", -1))
    owners = edges.where(F.col("kind") == "OWNS").select(F.coalesce("resolved_target", "target").alias("fqn"), F.substring_index(F.substring_index("source_fqn", "::", -1), ".", -1).alias("owner"))
    members = symbols.select("fqn", "name", F.col("path").alias("to_path")).where("fqn IS NOT NULL")
    imports = edges.where((F.col("kind") == "IMPORTS") & F.col("resolved_target").isNotNull()).select(F.col("source_fqn").alias("source_path"), F.col("resolved_target").alias("to_path")).distinct()

    def told(rows, label, *by):
        """The least and greatest candidate of each key: one if they are the same, more if not, none if both lack."""
        return rows.groupBy(*by).agg(F.min("fqn").alias(f"{label}_least"), F.max("fqn").alias(label))

    # every call meets one row of each of these, however many symbols bear its name
    here = members.select(F.col("name"), F.col("to_path").alias("source_path"), "fqn")
    found = calls.select("source_fqn", "target", "source_path", "name", "receiver_type", "bound_module", "member_call", "external").distinct()
    found = (
        found.join(told(members, "repo", "name"), "name", "left")
        .join(told(members.join(owners, "fqn").withColumnRenamed("owner", "receiver_type"), "typed", "name", "receiver_type"), ["name", "receiver_type"], "left")
        .join(told(members.withColumnRenamed("to_path", "bound_module"), "bound", "name", "bound_module"), ["name", "bound_module"], "left")
        .join(told(here, "local", "name", "source_path"), ["name", "source_path"], "left")
        .join(told(imports.join(members, "to_path"), "imports", "name", "source_path"), ["name", "source_path"], "left")
    )
    script, python = F.coalesce(F.col("source_path").endswith(".gs"), F.lit(False)), F.coalesce(F.col("source_path").endswith(".py"), F.lit(False))
    plain = (F.col("member_call") == F.lit(False)) | (F.col("member_call").isNull() & ~python)
    one = lambda k: F.col(k).isNotNull() & (F.col(f"{k}_least") == F.col(k))
    out = lambda name, target, c=1.0: F.struct(F.lit(name).alias("outcome"), target.cast("string").alias("to"), F.lit(c).alias("confidence"))
    none = F.lit(None)
    typed = F.when(one("typed"), out("receiver", F.col("typed"), 0.9)).otherwise(out("ambiguous", none))
    bound = F.when(F.col("external"), out("external", none)).when(one("bound"), out("bound", F.col("bound"))).when(F.col("bound").isNull() & one("repo"), out("bound_repo", F.col("repo"))).otherwise(out("ambiguous", none))
    rest = (
        F.when(F.col("repo").isNull(), out("unknown", none))
        .when(one("repo"), out("unique", F.col("repo")))
        .when(script & ~F.coalesce(F.col("member_call"), F.lit(False)), out("ambiguous", none))
        .when(one("local"), out("same_file", F.col("local")))
        .when(plain & one("imports"), out("imported", F.col("imports")))
        .otherwise(out("ambiguous", none))
    )
    how = F.when(F.col("receiver_type").isNotNull(), typed).when(F.col("bound_module").isNotNull(), bound).otherwise(rest)
    return found.withColumn("how", how).select("source_fqn", "target", F.col("how.to").alias("resolved_target"), F.when(F.col("how.to").isNotNull(), F.col("how.confidence")).alias("confidence"), F.col("how.outcome").alias("outcome"))


#: What an import may leave out, in order of preference.
PROBES = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def normal_path(path):
    """Resolves ``.`` and ``..`` parts of a path column; null if it leaves the root."""
    parts = F.split(path, "/")
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(False).alias("out"))
    step = lambda a, p: (
        F.when((p == "") | (p == "."), a)
        .when((p == "..") & (F.size(a["at"]) == 0), F.struct(a["at"].alias("at"), F.lit(True).alias("out")))
        .when(p == "..", F.struct(F.slice(a["at"], 1, F.size(a["at"]) - 1).alias("at"), a["out"].alias("out")))
        .otherwise(F.struct(F.array_append(a["at"], p).alias("at"), a["out"].alias("out")))
    )
    done = F.aggregate(parts, start, step)
    return F.when(~done["out"], F.array_join(done["at"], "/"))


def resolve_script_imports(imports: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """TS/JS specifiers (columns path, specifier) to files: alias, relative, then repo-relative, each probed
    for extensions and index files; null target where nothing fits."""
    spec = F.col("specifier")
    bases = [F.when(spec.startswith("."), F.concat(F.regexp_extract("path", r"^(.*/)?", 0), spec))]
    for prefix, to in (aliases or {}).items():
        bases.insert(0, F.when(spec.startswith(prefix), F.concat(F.lit(to), F.substring(spec, len(prefix) + 1, 10_000))))
    bases.append(F.when(~spec.startswith("."), spec))
    tries = F.array(*(F.struct(F.lit(i * len(PROBES) + k).alias("rank"), F.concat(normal_path(b), F.lit(p)).alias("to")) for i, b in enumerate(bases) for k, p in enumerate(PROBES)))
    asked = imports.select("path", "specifier").distinct()
    wide = asked.select("path", "specifier", F.explode(tries).alias("t")).select("path", "specifier", "t.rank", F.col("t.to").alias("to")).where("to is not null")
    hit = wide.join(files.select(F.col("path").alias("to")), "to").groupBy("path", "specifier").agg(F.min_by("to", "rank").alias("resolved"))
    return asked.join(hit, ["path", "specifier"], "left")


def import_class(resolved, specifier):
    """package, in-repo or unknown."""
    return F.when(resolved.isNotNull(), "in-repo").when(specifier.startswith(".") | specifier.startswith("/"), "unknown").otherwise("package")


def barrel_exports(files: DataFrame) -> DataFrame:
    """``export {A as B} from 'x'`` lines: path, name (as seen outside), original, specifier."""
    pattern = r"export\s*\{([^}]*)\}\s*from\s*['\"]([^'\"]+)['\"]"
    found = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("names"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("spec"))
    rows = files.select("path", F.explode(found).alias("e")).select("path", F.explode(F.split("e.names", ",")).alias("one"), F.col("e.spec").alias("specifier"))
    one = F.trim("one")
    original = F.regexp_extract(one, r"^([\w$]+)", 1)
    seen = F.when(one.rlike(r"\sas\s"), F.regexp_extract(one, r"\sas\s+([\w$]+)", 1)).otherwise(original)
    return rows.where(one != "").select("path", seen.alias("name"), original.alias("original"), "specifier")


def python_modules(files: DataFrame) -> DataFrame:
    """Every dotted suffix under which a Python file can be imported: module, path, depth."""
    base = F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), r"/__init__$", "")
    rows = files.where(F.col("path").endswith(".py")).select("path", F.split(base, "/").alias("parts"))
    rows = rows.select("path", F.size("parts").alias("depth"), F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", -i, i), "."))).alias("module"))
    return rows.where("module <> ''")


def resolve_python_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Specifiers (columns path, specifier) to files: leading dots climb from the importing file; absolute
    names match any directory suffix, if unique, else the unique shallowest."""
    spec = F.col("specifier")
    dots = F.length(F.regexp_extract(spec, r"^\.+", 0))
    here = F.split(F.regexp_replace("path", r"/?[^/]*$", ""), "/")
    climbed = F.array_join(F.slice(here, 1, F.greatest(F.size(here) - dots + 1, F.lit(0))), "/")
    rest = F.regexp_replace(F.regexp_replace(spec, r"^\.+", ""), r"\.", "/")
    at = F.regexp_replace(F.concat_ws("/", F.when(climbed != "", climbed), F.when(rest != "", rest)), "^/", "")
    asked = imports.select("path", "specifier").distinct().withColumn("relative", spec.startswith("."))
    paths = files.where(F.col("path").endswith(".py")).select(F.col("path").alias("to"))
    near = asked.where("relative").withColumn("to", F.explode(F.array(F.concat(at, F.lit(".py")), F.concat(at, F.lit("/__init__.py"))))).join(paths, "to").groupBy("path", "specifier").agg(F.min("to").alias("resolved"))
    modules = python_modules(files).select("module", F.col("path").alias("to"), "depth")
    met = asked.where("not relative").join(modules, asked["specifier"] == modules["module"])
    least = met.groupBy("path", "specifier").agg(F.min("depth").alias("least"))
    far = met.join(least, ["path", "specifier"]).where("depth = least").groupBy("path", "specifier").agg(F.count("*").alias("n"), F.min("to").alias("resolved")).where("n = 1").drop("n")
    return asked.select("path", "specifier").join(near.unionByName(far), ["path", "specifier"], "left")


def external_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``external``: the top name is of the standard library or isn't in the repository."""
    standard = sorted(sys.stdlib_module_names)
    tops = files.select(F.explode(F.split(F.regexp_replace("path", r"\.py$", ""), "/")).alias("top")).distinct().withColumn("own", F.lit(True))
    rows = imports.withColumn("top", F.split("specifier", r"\.")[0])
    both = rows.join(tops, "top", "left")
    outside = F.col("top").isin(*standard) | F.col("own").isNull()
    return both.withColumn("external", ~F.col("specifier").startswith(".") & outside).drop("top", "own")
