"""Fuzzy line deduplication by MinHash, in DataFrame functions only.

Lines (split at line feeds, trimmed) are known by their 64-bit hash, so equal
lines are one. The signature of a line is the minimum, under many permutations,
of the hashes of its character shingles. Shingles of LONG characters are taken
from the places that follow a MARK, a character of a fixed class that stands all
over a text whatever its language; lines with fewer than FEW different ones (short
ones, ones that repeat a pattern) have a second signature of their SHORT shingles
from every place. Bands of some minima meet in buckets, where pairs go on if enough
of all their minima agree: every line is tried with the bucket's first, so that
groups of copies cost as much as they have lines, not pairs. Where that leaves lines
of several components in a bucket, a few more lines of each large bucket are tried
with all others, and then all its pairs of different components, whatever its size:
a bitmap of all shingles rules out most pairs and no alike one. What is left is
verified by the exact Jaccard similarity of all character shingles.
A distributed union-find joins the links, and of each
component only the first line (smallest key, then place) stays.

Defined results: blank lines always stay; a null text stays null; documents keep
their rows, with an empty text if all lines go; rows that repeat a key count as
one document, so they keep the same lines; null keys come last; ``n_chars``
follows the text where that column exists; other columns are untouched.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, stash, stash_alone
from .components import components

#: Minima of a signature; minima of a band, for long and short shingles; a sketch has two bits of SKETCH minima, of which so many must agree.
MINIMA, BAND, SKETCH, AGREE = 36, (3, 4), 32, (18, 23)
#: Shingle lengths: of the two signatures and of the exact test; fewer long shingles than FEW call for the short ones.
LONG, SHORT, EXACT, FEW = 7, 5, 5, 9
#: Characters after which a long shingle is taken: some letters and digits, and all beyond Latin.
MARK = "[bdfgjkpvwyzBDFGJKPVWYZ26[^\\x00-\\u024f]]"
#: Words of 64 bits of the bitmap that rules out pairs of unsettled lines, a power of two up to 256.
WORDS = 16
#: A bucket of more than MANY lines tries LEADERS of them with all others, in so many ROUNDS, before all pairs that are left; blocks of a large bucket have about BLOCK lines.
MANY, LEADERS, ROUNDS, BLOCK = 64, 16, 2, 1024
#: Candidate lines are sent to all tasks up to so many (24 bytes each); beyond, they are joined by a shuffle.
BROADCAST_LINES = 1_000_000


def _permutations(n: int) -> list[int]:
    rng = random.Random(4)
    return [rng.getrandbits(32) - (1 << 31) for _ in range(n)]


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row a line that isn't blank: key, place, line (trimmed), id (its hash)."""
    # "outer", here and below: else the optimizer puts a filter below that computes the array once more
    rows = docs.select(F.col(key).alias("key"), F.posexplode_outer(F.split(F.col(text), "\n")).alias("place", "line"))
    rows = rows.select("key", "place", F.trim(F.col("line")).alias("line")).where("line <> ''")
    return rows.withColumn("id", F.xxhash64("line"))


def _shingles(line: Column, size: int) -> Column:
    """64-bit hashes of the shingles from every place; a shorter line is one shingle.

    Cut out of four bytes a character: a regular expression takes thrice as long.
    """
    cut = lambda b: F.transform(F.sequence(F.lit(1), F.greatest(F.length(b) - (4 * size - 1), F.lit(1)), F.lit(4)), lambda i: F.xxhash64(F.substring(b, i, F.lit(4 * size))))
    return F.transform(F.array(F.encode(line, "UTF-32")), cut)[0]


def _marked(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(f"(?s){MARK}(?=(.{{{LONG}}}))"), F.lit(1))


def signatures(lines: DataFrame) -> DataFrame:
    """Columns id, sketch and buckets: a row for each signature of each different line, with its bands."""
    marked = lines.select("id", "line", _marked(F.col("line")).alias("marks"))
    # the first marks of most lines tell that there are enough
    few = (F.size(F.array_distinct(F.slice("marks", 1, 2 * FEW))) < FEW) & (F.size(F.array_distinct("marks")) < FEW)
    both = marked.select("id", "marks", F.size("marks").alias("long"), F.when(few, F.encode("line", "UTF-32")).alias("bytes"))
    places = F.when(F.col("bytes").isNull(), 0).otherwise(F.greatest(F.length("bytes") / 4 - (SHORT - 1), F.lit(1)).cast("int"))
    # a row for each shingle by its number, the long ones first (there is one at least): code on rows is compiled, functions over arrays aren't
    rows = both.select("*", (F.col("long") + places).alias("all")).select("*", F.explode_outer(F.sequence(F.lit(0), F.col("all") - 1)).alias("at"))
    short = F.xxhash64(F.substring("bytes", 4 * (F.col("at") - F.col("long")) + 1, F.lit(4 * SHORT)))
    is_long = F.col("at") < F.col("long")
    parts = rows.select("id", F.when(is_long, 0).otherwise(1).alias("kind"), F.when(is_long, F.hash(F.get("marks", "at"))).otherwise(F.hash(short)).alias("h"))
    minima = [F.min(F.col("h").bitwiseXOR(F.lit(c))).alias(f"m{k}") for k, c in enumerate(_permutations(MINIMA))]
    found = parts.groupBy("id", "kind").agg(*minima)
    sketch = F.lit(0).cast("long")
    for k in range(SKETCH):
        sketch = sketch.bitwiseOR(F.shiftleft(F.hash(f"m{k}").bitwiseAND(F.lit(3)).cast("long"), 2 * k))
    # a bucket's last bit is its kind
    of = lambda kind, n: F.array(*(F.xxhash64(F.lit(k), *(f"m{j}" for j in range(k, k + n))).bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(kind)) for k in range(0, MINIMA, n)))
    return found.select("id", sketch.alias("sketch"), F.when(F.col("kind") == 0, of(0, BAND[0])).otherwise(of(1, BAND[1])).alias("buckets"))


def _near(a: Column, b: Column, kind: Column) -> Column:
    """Whether enough of the two-bit values of two sketches agree."""
    x = a.bitwiseXOR(b)
    return SKETCH - F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))) >= F.when(kind == 0, AGREE[0]).otherwise(AGREE[1])


def meetings(signed: DataFrame) -> DataFrame:
    """Columns bucket, id, n (the bucket's lines), first (its smallest id) and near (whether the sketches of both are) of the lines that aren't alone in a bucket."""
    w = Window.partitionBy("bucket")
    rows = signed.select("id", "sketch", F.explode_outer("buckets").alias("bucket"))
    met = rows.select("*", F.min(F.struct("id", "sketch")).over(w).alias("least"), F.count("*").over(w).alias("n")).where("n > 1")
    near = _near(F.col("sketch"), F.col("least.sketch"), F.col("bucket").bitwiseAND(F.lit(1)))
    # few files, in which the rows of a line are together
    return met.select("bucket", "id", "n", F.col("least.id").alias("first"), near.alias("near")).repartition("id")


def candidates(met: DataFrame) -> DataFrame:
    """Pairs (u, v) of a line and the first line of a bucket that it is in, of near sketches."""
    return met.where((F.col("first") != F.col("id")) & F.col("near")).select(F.col("first").alias("u"), F.col("id").alias("v")).distinct()


def _open(rows: DataFrame) -> DataFrame:
    """The buckets with lines of several components."""
    return rows.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("bucket")


def unsettled(met: DataFrame, joined: DataFrame) -> DataFrame:
    """Columns bucket, n, id and component of the lines that share a bucket with a line of another component, neither being its first."""
    rest = met.where((F.col("n") > 2) & (F.col("first") != F.col("id"))).join(joined, "id", "left").select("bucket", "n", "id", F.coalesce("component", "id").alias("component"))
    w = Window.partitionBy("bucket")
    several = rest.select("*", F.min("component").over(w).alias("least"), F.max("component").over(w).alias("most")).where("least <> most")
    return several.select("bucket", "n", "id", "component")


def bitmaps(texts: DataFrame) -> DataFrame:
    """Columns id, size (its different shingles) and b0, b1, ... of each line: each shingle flips one of 64 * WORDS bits."""
    parts = texts.select("id", F.explode_outer(parts_of("line")).alias("part"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("part", 8).bitwiseAND(F.lit(63)).cast("int"))
    flips = [F.bit_xor(F.when(F.col("part").bitwiseAND(F.lit(WORDS - 1)) == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"b{k}") for k in range(WORDS)]
    return parts.groupBy("id").agg(F.count("*").cast("int").alias("size"), *flips)


def _may_be_alike(least: float) -> Column:
    """Whether the bitmaps of lines u and v leave room for a Jaccard similarity of ``least`` or more.

    A bit that differs stands for a shingle that only one of the lines has, at
    least, and of alike lines few shingles differ: so no alike pair is lost.
    """
    apart = sum((F.bit_count(F.col(f"b{k}_u").bitwiseXOR(F.col(f"b{k}_v"))) for k in range(WORDS)), F.lit(0))
    # a little more, so that no error of floating point loses a pair
    most = (F.col("size_u") + F.col("size_v")) * ((1 - least) / (1 + least)) + 1e-6
    return (F.least("size_u", "size_v") >= least * F.greatest("size_u", "size_v") - 1e-6) & (apart <= most)


def _sides(u: DataFrame, v: DataFrame, on: list[str], least: float, also: Column | None = None) -> DataFrame:
    """Pairs (u, v) of rows of two frames that agree in ``on``, of lines of different components that may be alike."""
    sides = (d.select(*on, *(F.col(c).alias(f"{c}_{x}") for c in d.columns if c not in on)) for d, x in ((u, "u"), (v, "v")))
    near = (F.col("component_u") != F.col("component_v")) & _may_be_alike(least)
    pairs = next(sides).join(next(sides), on).where(near if also is None else near & also)
    return pairs.select(F.least("id_u", "id_v").alias("u"), F.greatest("id_u", "id_v").alias("v")).distinct()


def leader_candidates(rows: DataFrame, turn: int, least: float) -> DataFrame:
    """Pairs (u, v) of LEADERS of each bucket, others in each turn, and its lines of other components that may be alike."""
    order = Window.partitionBy("bucket").orderBy(F.xxhash64("id", F.lit(turn)), "id")
    leaders = rows.select("bucket", "id", F.row_number().over(order).alias("at")).where(F.col("at") <= LEADERS).drop("at")
    rows = rows.drop("n")
    return _sides(leaders.join(rows, ["bucket", "id"]), rows, ["bucket"], least)


def relabelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with the components that ``links`` make of theirs, without the buckets that are in one component now."""
    own = rows.select("id", "component").distinct()
    at = lambda x: own.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
    joined = components(links.join(at("u"), "u").join(at("v"), "v").select(F.col("cu").alias("u"), F.col("cv").alias("v")))
    joined = joined.select(F.col("id").alias("component"), F.col("component").alias("root"))
    now = rows.join(joined, "component", "left").withColumn("component", F.coalesce("root", "component")).select(*rows.columns)
    return now.join(_open(now), "bucket", "left_semi").select(*rows.columns)


def rest_candidates(rows: DataFrame, least: float) -> DataFrame:
    """All pairs (u, v) of lines of different components that share a bucket and may be alike.

    Lines of a bucket are dealt to blocks, and those of each two blocks meet in
    a cell: no task has to try all pairs of a large bucket.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.withColumn("block", F.pmod(F.hash("id"), blocks))
    rows = rows.select("*", F.explode_outer(F.sequence(F.lit(0), blocks - 1)).alias("other")).drop("n")
    rows = rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other")
    # lines of one block meet in all its cells, and are tried in the one that it has alone
    once = (F.col("block_u") != F.col("block_v")) | (F.col("low") == F.col("high"))
    return _sides(rows, rows, ["bucket", "low", "high"], least, (F.col("id_u") < F.col("id_v")) & once)


def alike(a: Column, b: Column, least: float) -> Column:
    """Whether two arrays without repeats have a Jaccard similarity of ``least`` or more.

    The arrays are made into one value first, so each is computed once.
    """
    def both(p: Column) -> Column:
        n, m = F.size(p["a"]), F.size(p["b"])
        # the intersection is at most the smaller set
        return F.when(F.least(n, m) < least * F.greatest(n, m), False).otherwise(F.size(F.array_intersect(p["a"], p["b"])) * (1 + least) >= least * (n + m))

    return F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), both)[0]


def parts_of(line: str) -> Column:
    """The different shingles of the exact test."""
    return F.array_distinct(_shingles(F.col(line), EXACT))


def _only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of some ids (stashed); few ids are sent to all tasks, so that the other texts aren't shuffled."""
    return texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_LINES else ids, "id", "left_semi")


def texts_of_ids(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """Columns id and line of the different lines among ``ids``, stashed."""
    wanted = stash(ids, "line-ids")
    texts = stash(_only(lines.select("id", "line"), wanted).groupBy("id").agg(F.min("line").alias("line")), "line-texts")
    forget(wanted)
    return texts


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose lines have a Jaccard similarity of ``least`` or more, stashed."""
    pairs = stash(pairs, "line-pairs")
    ids = stash(pairs.select(F.explode_outer(F.array("u", "v")).alias("id")).distinct(), "line-ids")
    texts = _only(texts, ids)
    left, right = texts.select(F.col("id").alias("u"), F.col("line").alias("a")), texts.select(F.col("id").alias("v"), F.col("line").alias("b"))
    found = pairs.join(left, "u").join(right, "v").where(alike(parts_of("a"), parts_of("b"), least)).select("u", "v")
    out = stash(found, "line-links")
    forget(pairs)
    forget(ids)
    return out


def similar_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8) -> DataFrame:
    """Verified links (u, v) between ids of different lines."""
    lines = lines_of(docs, key, text)
    # signatures are stashed apart so that the shuffles of minima and of buckets needn't be on disk at once
    signed = stash_alone(signatures(lines), "line-signatures")
    met = stash_alone(meetings(signed), "line-buckets")
    forget(signed)
    texts = texts_of_ids(lines, met.select("id").distinct())
    links = verified(candidates(met), texts, least)
    rest = stash(unsettled(met, components(links)), "line-rest")
    forget(met)
    ids = stash(rest.select("id").distinct(), "line-ids")
    bits = stash(bitmaps(_only(texts, ids)), "line-bits")
    few = rest.where(F.col("n") <= MANY).join(bits, "id")
    many = stash(rest.where(F.col("n") > MANY).join(bits, "id"), "line-many")
    more = [links]
    for turn in range(0 if many.isEmpty() else ROUNDS):
        found = verified(leader_candidates(many, turn, least), texts, least)
        more.append(found)
        if found.isEmpty():
            break
        many, before = stash(relabelled(many, found), "line-many"), many
        forget(before)
    more.append(verified(rest_candidates(few.unionByName(many), least), texts, least))
    out = stash(reduce(DataFrame.unionByName, more), "line-links")
    for used in (texts, rest, ids, bits, many, *more):
        forget(used)
    return out


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8) -> DataFrame:
    """Columns key and place of each line that goes."""
    joined = components(similar_lines(docs, key, text, least))
    # texts are split and hashed once for both uses
    seen = stash(lines_of(docs, key, text).select("id", "key", "place"), "seen-lines")
    # null keys come last
    at = F.struct(F.col("key").isNull().alias("none"), "key", "place")
    groups = seen.groupBy("id").agg(F.count("*").alias("n"), F.min(at).alias("at")).join(joined, "id", "left")
    groups = groups.withColumn("component", F.coalesce("component", "id"))
    firsts = groups.groupBy("component").agg(F.sum("n").alias("n"), F.min("at").alias("at")).where("n > 1")
    stays = stash(groups.select("id", "component").join(firsts, "component").select("id", "at"), "line-firsts")
    here = seen.join(stays, "id")
    same = here["key"].eqNullSafe(here["at.key"]) & (here["place"] == here["at.place"])
    return here.where(~same).select("key", "place")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without the lines that repeat or nearly repeat; adds ``__lines`` and ``__removed`` counts."""
    gone = removed_lines(docs, key, text, least).groupBy("key").agg(F.collect_set("place").alias("__gone"))
    rows = docs.join(gone, docs[key].eqNullSafe(gone["key"]), "left").drop(gone["key"])
    parts = F.split(F.col(text), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__gone"))
    # lines and places are made into one value first, so that the text is split once
    both = F.array(F.struct(parts.alias("lines"), kept.alias("kept")))
    left = F.transform(both, lambda d: F.array_join(F.transform(d["kept"], lambda i: F.get(d["lines"], i)), "\n"))[0]
    new = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(left)
    rows = rows.withColumns({"__new": new, "__lines": F.when(F.col(text).isNull(), 0).otherwise(F.size(parts)), "__removed": F.coalesce(F.size("__gone"), F.lit(0))})
    out = [F.col("__new").alias(text) if c == text else F.when(F.col("__gone").isNotNull(), F.length("__new")).otherwise(F.col(c)).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return rows.select(*out, "__lines", "__removed")
