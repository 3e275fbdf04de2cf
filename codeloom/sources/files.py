"""Folders, git commits, descriptors, evaluation files; snapshots and sinks."""

from __future__ import annotations

import fnmatch
import json
import os
import subprocess
import tomllib
import uuid
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.identity import content_hash, lf

#: Default policy: extensions that are read, folders that aren't.
EXTENSIONS = (".py", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".gs", ".cs", ".cshtml", ".razor", ".csproj", ".sln", ".cpp", ".cc", ".cxx", ".h", ".hpp", ".L5X")
SKIPPED_DIRS = (".git", "node_modules", "__pycache__", ".venv", "venv", "site-packages", ".tox", ".eggs", "dist", "build", ".next", "obj")
#: ``bin`` itself may hold scripts; what a build puts below it isn't read.
SKIPPED_PATHS = ("bin/Debug", "bin/Release", "bin/x64", "bin/x86")
#: Names of files that hold credentials; never read, whatever extensions are asked for, unless a policy takes one back.
CREDENTIALS = (
    ".env", ".env.*", "!.env.example", "!.env.sample", "!.env.template",
    "*credentials*.json", "client_secret*.json", "*service[-_]account*.json", "serviceaccount*.json", "*firebase-adminsdk*.json", "secrets.json",
    "*-" + "[0-9a-f]" * 12 + ".json", "*.pem", "*.key", "*.p12", "*.pfx", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519",
)


@dataclass
class ScanPolicy:
    """What is scanned: folders pruned at any depth, at the root only, or by path; file globs with ``!`` to
    take one back; extensions. All ignore case."""

    extensions: tuple[str, ...] = EXTENSIONS
    any_dirs: tuple[str, ...] = SKIPPED_DIRS
    root_dirs: tuple[str, ...] = ()
    dir_paths: tuple[str, ...] = SKIPPED_PATHS
    file_globs: tuple[str, ...] = ("*.min.js", "*.d.ts", *CREDENTIALS)

    def keeps(self, path: Column) -> Column:
        p = F.lower(path)
        folders = F.slice(F.split(p, "/"), 1, F.size(F.split(p, "/")) - 1)
        name = F.element_at(F.split(p, "/"), -1)
        ok = F.lit(False)
        for e in self.extensions:
            ok = ok | name.endswith(e.lower())
        if self.any_dirs:
            ok = ok & ~F.arrays_overlap(folders, F.array(*(F.lit(d.lower()) for d in self.any_dirs)))
        for d in self.root_dirs:
            ok = ok & ~p.startswith(d.lower() + "/")
        for d in self.dir_paths:
            ok = ok & ~F.concat(F.lit("/"), p).contains("/" + d.lower().strip("/") + "/")
        out = F.lit(False)
        for g in self.file_globs:
            back = g.startswith("!")
            hit = name.rlike(fnmatch.translate(g.lstrip("!").lower()).replace(r"\Z", "$").replace(r"\z", "$"))
            out = out & ~hit if back else out | hit
        return ok & ~out


def resolve_list(defaults: tuple[str, ...], table: dict, name: str, dotted: bool = False, flat: bool = False) -> tuple[str, ...]:
    """A bare key replaces the defaults (an empty list too), ``extra_`` extends them, ``!x`` takes one away."""
    bare, extra = table.get(name), table.get(f"extra_{name}")
    if bare is not None and extra is not None:
        raise ValueError(f"{name} and extra_{name} are both set")
    out = list(bare) if bare is not None else list(defaults)
    for x in extra or ():
        if x.startswith("!"):
            if x[1:] not in out:
                raise ValueError(f"{name} has no default {x[1:]!r}")
            out.remove(x[1:])
        elif x not in out:
            out.append(x)
    for x in out:
        if dotted and not x.startswith("."):
            raise ValueError(f"extension without a dot: {x!r}")
        if flat and "/" in x:
            raise ValueError(f"file pattern with a folder: {x!r}")
    return tuple(out)


def load_policy(table: dict) -> ScanPolicy:
    d = ScanPolicy()
    return ScanPolicy(resolve_list(d.extensions, table, "extensions", dotted=True), resolve_list(d.any_dirs, table, "any_dirs"), resolve_list(d.root_dirs, table, "root_dirs"), resolve_list(d.dir_paths, table, "dir_paths"), resolve_list(d.file_globs, table, "file_globs", flat=True))


def find_config(start: str, name: str = "indexer.toml") -> dict:
    """The TOML file nearest above ``start``; the search ends at the folder that holds ``.git``."""
    at = os.path.abspath(start)
    while True:
        path = os.path.join(at, name)
        if os.path.isfile(path):
            with open(path, encoding="utf-8-sig") as f:
                return tomllib.loads(f.read())
        if os.path.exists(os.path.join(at, ".git")) or os.path.dirname(at) == at:
            return {}
        at = os.path.dirname(at)


def _readable(content: Column) -> Column:
    """UTF-8 text; only where bytes are bad Python drops those, the rest stays in the JVM."""

    @F.pandas_udf("string")
    def lenient(bad: pd.Series) -> pd.Series:
        return bad.map(lambda b: bytes(b).decode("utf-8", "ignore"))

    whole = F.try_validate_utf8(content.cast("string"))
    return F.coalesce(whole, lenient(F.when(whole.isNull(), content).otherwise(F.lit(b""))))


@dataclass
class EmbedderConfig:
    """What an embedder is asked for: the ``embeddings`` table of the configuration."""

    model_id: str = "hashed"
    dimension: int = 64
    max_seq_length: int = 512
    dtype: str = "auto"
    query_instruct: str = ""

    @classmethod
    def load(cls, config: dict) -> EmbedderConfig:
        given = config.get("embeddings", {})
        unknown = set(given) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown embedding options: {sorted(unknown)}")
        return cls(**{k: int(v) if k in ("dimension", "max_seq_length") else str(v) for k, v in given.items()})


def read_manifest(path: str, private: str | None = None) -> list[dict]:
    """The ``repos`` of a TOML manifest, then those of a private one if that is there."""
    found: list[dict] = []
    for p in (path, private):
        if p and (p == path or os.path.exists(p)):
            with open(p, "rb") as f:
                found += tomllib.load(f).get("repos", [])
    return found


def scan_folder(spark: SparkSession, root: str, policy: ScanPolicy | None = None) -> DataFrame:
    """path (below the root), content_hash (line ends made alike), text (UTF-8, bad bytes left out). Spark lists no file without bytes."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file://")
    rows = rows.select(F.regexp_replace("path", "^[a-z0-9]+:/*" + base.lstrip("/").replace(".", r"\.") + "/", "").alias("path"), "content", "length", "modificationTime")
    rows = rows.where((policy or ScanPolicy()).keeps(F.col("path")))
    return rows.select("path", content_hash(F.col("content")).alias("content_hash"), lf(_readable(F.col("content"))).alias("text"), "length", F.col("modificationTime").alias("modified_at"))


def largest_file(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).agg(F.max_by("path", "length").alias("path"), F.max("length").alias("length"))


class _Part(InputPartition):
    def __init__(self, entries):
        self.entries = entries


class _CommitReader(DataSourceReader):
    def __init__(self, options):
        self.repo, self.ref, self.size = options["repo"], options.get("ref", "HEAD"), int(options.get("files_per_task", "500"))

    def partitions(self):
        raw = subprocess.run(["git", "-C", self.repo, "ls-tree", "-r", "-z", self.ref], check=True, capture_output=True).stdout
        entries = []
        for row in raw.split(b"\0"):
            if row:
                head, path = row.split(b"\t", 1)
                mode, _, sha = head.split(b" ")
                if mode in (b"100644", b"100755"):  # no links, no submodules
                    entries.append((path.decode("utf-8", "replace"), sha.decode()))
        return [_Part(entries[i : i + self.size]) for i in range(0, len(entries), self.size)] or [_Part([])]

    def read(self, partition):
        if not partition.entries:
            return
        git = subprocess.Popen(["git", "-C", self.repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        try:
            for path, sha in partition.entries:
                git.stdin.write(sha.encode() + b"\n")
                git.stdin.flush()
                size = int(git.stdout.readline().split()[2])
                body = git.stdout.read(size)
                git.stdout.read(1)
                pointer = body.startswith(b"version https://git-lfs.github.com/spec/")
                yield path, sha, "" if pointer else body.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")
        finally:
            git.stdin.close()
            git.wait()


class CommitSource(DataSource):
    """Files of a git commit: ``spark.read.format("git_commit").option("repo", ...).option("ref", ...)``."""

    @classmethod
    def name(cls):
        return "git_commit"

    def schema(self):
        return "path string, content_hash string, text string"

    def reader(self, schema):
        return _CommitReader(self.options)


def scan(spark: SparkSession, root: str, source: str = "worktree", policy: ScanPolicy | None = None) -> DataFrame:
    """Source factory: ``worktree``, or ``git:<ref>``."""
    if source == "worktree":
        return scan_folder(spark, root, policy)
    if not source.startswith("git:"):
        raise ValueError(f"unknown source {source!r}")
    spark.dataSource.register(CommitSource)
    rows = spark.read.format("git_commit").option("repo", root).option("ref", source[4:] or "HEAD").load()
    return rows.where((policy or ScanPolicy()).keeps(F.col("path")))


def index_location(root: str, source: str = "worktree") -> str:
    if source == "worktree":
        return os.path.join(root, ".code-index")
    out = subprocess.run(["git", "-C", root, "rev-parse", "--path-format=absolute", "--git-common-dir"], check=True, capture_output=True, text=True)
    return os.path.join(out.stdout.strip(), "code-index")


# descriptors

def project_imports(files: DataFrame) -> DataFrame:
    """Import edges of ``.csproj`` (project and package references) and ``.sln`` files: source_fqn, target, kind."""
    project = F.transform(F.regexp_extract_all("text", F.lit(r'<ProjectReference\s[^>]*Include="([^"]+)"'), F.lit(1)), lambda x: F.replace(x, F.lit("\\"), F.lit("/")))
    elements = F.regexp_extract_all("text", F.lit(r'<PackageReference\s[^>]*>'), F.lit(0))
    packages = F.transform(elements, lambda e: F.concat_ws("/", F.regexp_extract(e, r'Include="([^"]+)"', 1), F.nullif(F.regexp_extract(e, r'Version="([^"]+)"', 1), F.lit(""))))
    solution = F.transform(F.regexp_extract_all("text", F.lit(r'Project\("[^"]*"\)\s*=\s*"[^"]*",\s*"([^"]+\.\w+proj)"'), F.lit(1)), lambda x: F.replace(x, F.lit("\\"), F.lit("/")))
    found = F.when(F.lower("path").endswith(".sln"), solution).when(F.lower("path").endswith(".csproj"), F.concat(project, packages))
    return files.select(F.col("path").alias("source_fqn"), F.explode(found).alias("target"), F.lit("IMPORTS").alias("kind"))


def compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """Import edges from each translation unit to its -I and -isystem folders."""
    rows = spark.read.schema("directory string, file string, command string, arguments array<string>").json(path, multiLine=True)
    line = F.coalesce(F.col("command"), F.array_join("arguments", " "))
    dirs = F.regexp_extract_all(line, F.lit(r"(?:-I|-isystem)\s*(\S+)"), F.lit(1))
    return rows.select(F.col("file").alias("source_fqn"), F.explode(F.array_distinct(dirs)).alias("target"), F.lit("IMPORTS").alias("kind"))


# evaluation files

def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, sep="\t", header=True, schema="query_id string, item_id string, gain int")
    return rows.where("gain > 0")


def append_baseline(spark: SparkSession, path: str, rows: DataFrame, key: list[str]) -> str:
    """Baseline sink: the new rows replace those of the same key; the whole is sorted and written as a new version."""
    old = Snapshots(spark, path)
    if (at := old.current()) is not None:
        rows = spark.read.parquet(f"{at}/rows").join(rows, key, "left_anti").unionByName(rows, allowMissingColumns=True)
    return old.publish({"rows": rows.orderBy(*key)})


@dataclass
class Snapshots:
    """Versions of a set of tables below one folder: each is written whole to a new folder and then marked as
    committed. The newest committed one counts; readers pin the version that they found; a crash leaves the old one."""

    spark: SparkSession
    root: str
    kept: int = 3
    _fs: object = field(default=None, repr=False)

    def _hadoop(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def versions(self, committed: bool = True) -> list[str]:
        """Names in the order of their numbers; by default of those that were written to their end."""
        fs, at = self._hadoop(self.root)
        if not fs.exists(at):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().startswith("v"))
        return [n for n in names if not committed or fs.exists(self._hadoop(f"{self.root}/{n}/_COMMITTED")[1])]

    def current(self) -> str | None:
        found = self.versions()
        return f"{self.root}/{found[-1]}" if found else None

    def publish(self, tables: dict[str, DataFrame], meta: dict | None = None) -> str:
        every = self.versions(committed=False)
        number = int(every[-1][1:9]) + 1 if every else 1
        name = f"v{number:08d}-{uuid.uuid4().hex[:8]}"
        for t, df in tables.items():
            df.write.parquet(f"{self.root}/{name}/{t}")
        if meta:
            self.spark.createDataFrame([(k, json.dumps(v)) for k, v in meta.items()], "key string, value string").coalesce(1).write.parquet(f"{self.root}/{name}/meta")
        fs, mark = self._hadoop(f"{self.root}/{name}/_COMMITTED")
        fs.create(mark, True).close()
        # versions before the last kept ones go, and what a crash left before them
        oldest = self.versions()[-self.kept :][0]
        for old in self.versions(committed=False):
            if old < oldest:
                fs.delete(self._hadoop(f"{self.root}/{old}")[1], True)
        return f"{self.root}/{name}"


def check_vectors(vectors: DataFrame, dim: int) -> None:
    """The dimension guard of a vector table."""
    bad = vectors.where(F.size("embedding") != dim).limit(1).count()
    if bad:
        raise ValueError(f"vectors of another length than {dim}")
