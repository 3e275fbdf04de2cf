"""The operators of ``codeloom.llm`` on small fixtures, against brute force where SQL can't express them."""

import hashlib
import math
import os
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.llm import bpe, components, langid, line_dedup, mixing, ogg, queries, simhash, suffix_dedup, token_files, topk, toxicity
from codeloom.llm.cache import Cache
from codeloom.llm.common import fold

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, key string, id string, size string"
SYLLABLES = "ba be di do fu ga ho ka le mi no pu ra su ti vo".split()
WORDS = [a + b + c for a in SYLLABLES for b in SYLLABLES[:2] for c in SYLLABLES[4:6]]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(spark, texts, **more):
    rows = [(i, t, "en" if i % 2 else "fr", None if i % 5 == 0 else f"s{i % 3}", len(t or ""), "x", "x", "x", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + list(more.get("rows", [])), SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and keys, clashing column names."""
    rng = random.Random(1)
    base = [None, "", " ", "\n\n", "a", "A b\nc", "日本語 テスト\n" * 3, prose(rng, 4000), "x" * 30000, prose(rng, 50), prose(rng, 50) + "\n" + "tail"]
    extra = [(None,) * 9, (None, "no id here", None, None, None, None, None, None, None), (3, prose(rng, 40), "en", "", 1, "x", "x", "x", "x"), (9, base[9], "en", "s0", 1, "x", "x", "x", "x"), (9, base[9], "en", "s0", 1, "x", "x", "x", "x")]
    return corpus(spark, base, rows=extra).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# 1

def test_toxicity(spark):
    rng = random.Random(2)
    bad = ["scoundrel", "rotter", "blighted"]
    texts = [prose(rng, rng.randint(20, 300)) + (f" {rng.choice(bad)} {rng.choice(bad)}{rng.choice('xyz')}" if i % 4 == 0 else "") for i in range(600)]
    docs, labels = corpus(spark, texts), spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    out = rows_of(toxicity.score_documents(docs, toxicity.learn(docs, labels)))
    held = [r for r in out if r["held_out"]]
    assert len(out) == 600 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) / len(held) > 0.95


def ratio_plainly(counts, word, order=5, discount=0.75):
    """The two class models' log-likelihood ratio of a word, from dictionaries of strings."""
    grams = [[{} for _ in range(3)] for _ in range(order)]
    for w in set(counts[0]) | set(counts[1]):
        marked = "\x01" * (order - 1) + "\x02" + w + "\x03"
        for i in range(order, len(marked)):
            for n in range(order):
                for k, c in enumerate((1, counts[0].get(w, 0), counts[1].get(w, 0))):
                    if c:
                        after = grams[n][k].setdefault(marked[i - n : i], {})
                        after[marked[i]] = after.get(marked[i], 0) + c

    def level(after, letter, lower):
        total = sum(after.values())
        return (max(after.get(letter, 0) - discount, 0) + discount * len(after) * lower) / total if total else lower

    marked, out = "\x01" * (order - 1) + "\x02" + word + "\x03", 0.0
    for i in range(order, len(marked)):
        lower, own = 1 / 256, [1 / 256, 1 / 256]
        for n in range(order):
            ctx, letter = marked[i - n : i], marked[i]
            lower = level(grams[n][0].get(ctx, {}), letter, lower)
            own = [lower, lower] if n < 2 else [level(grams[n][c + 1].get(ctx, {}), letter, 0.5 * own[c] + 0.5 * lower) for c in (0, 1)]
        out += math.log(own[1]) - math.log(own[0])
    return out / max(len(word) + 1, toxicity.SHORT)


def test_kneser_ney_is_the_plain_one():
    counts = ({"able": 3, "table": 2, "étable": 1, "b4d": 1}, {"bad": 4, "badly": 1, "table": 1})
    words = ["able", "bad", "bat", "tables", "b4d", "é", "日本"]
    assert np.allclose(toxicity.KneserNey.of(counts).ratios(words), [ratio_plainly(counts, w) for w in words], atol=1e-4)


def test_language_models_count_all_rows(spark):
    """Distributed sums are those of one count over all rows, whatever the sample and the tasks' bounds."""
    rng = random.Random(7)
    rows = [(prose(rng, 60), int(i % 3 == 0)) for i in range(300)] + [(None, 0), ("", 1)]
    counts = (Counter(), Counter())
    for text, label in rows:
        counts[label].update((text or "").split())
    plain, spread = toxicity.KneserNey.of(counts), toxicity.language_models(spark.createDataFrame(rows, "__text string, __label int").repartition(7))
    assert np.allclose(plain.ratios(WORDS), spread.ratios(WORDS), atol=1e-5)
    assert all(np.array_equal(a.keys, b.keys) and np.allclose(a.values, b.values) for a, b in zip(plain.grams, spread.grams))


def test_toxicity_odd(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(odd, none)
    out = rows_of(toxicity.score_documents(odd, model))
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    one = spark.createDataFrame([(i, 1) for i in range(9)] + [(None, 1), (2, None)], "doc_id long, toxic int")
    assert all(0 <= r["score"] <= 1 for r in rows_of(toxicity.score_documents(odd, toxicity.learn(odd, one))))
    assert toxicity.score_documents(empty, model).count() == 0


# 2

def fingerprint_plainly(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=80, deadline=None)
@given(st.text("aBé \t\n\x0b　", max_size=80))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == fingerprint_plainly(text)


def test_fingerprint_is_sparks_hash(spark):
    assert simhash.fingerprint(b"one Two three") == spark.sql("select xxhash64('one two three')").first()[0] % 2**64


def near_groups(prints):
    own = {d: d for d in prints}
    ids = sorted(prints)

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                own[max(root(a), root(b))] = min(root(a), root(b))
    return {d: root(d) for d in ids}


def test_links_lose_none(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = {i: base[i % 40] ^ sum(1 << b for b in set(rng.choices(range(64), k=rng.randint(0, 5)))) for i in range(400)}
    distinct = {}
    for i, p in sorted(prints.items()):
        distinct.setdefault(p, i)
    points = spark.createDataFrame([(i, p - 2**64 if p >> 63 else p) for p, i in distinct.items()], "id long, fp long")
    got = {tuple(sorted(r)) for r in simhash.links(points).collect()}
    want = {tuple(sorted((i, j))) for p, i in distinct.items() for q, j in distinct.items() if i < j and (p ^ q).bit_count() <= 3}
    assert got == want and len(want) > 100


def test_near_duplicates(spark):
    rng = random.Random(4)
    texts = [prose(rng, 300) for _ in range(40)]
    texts += [t + " end" for t in texts[:20]] + texts[:5] + [" ".join(t.split()[:-1]) for t in texts[:10]] + ["", None, " "]
    docs = corpus(spark, texts)
    out = rows_of(simhash.near_duplicates(docs))
    want = near_groups({i: fingerprint_plainly(t or "") for i, t in enumerate(texts)})
    assert {r["doc_id"]: r["component_id"] for r in out} == want and len(set(want.values())) < len(texts) - 20
    kept = simhash.keep_first(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == docs.columns


def test_near_duplicates_odd(odd, empty):
    assert simhash.near_duplicates(odd).count() == odd.count() and simhash.near_duplicates(empty).count() == 0
    kept = rows_of(simhash.keep_first(odd))
    assert sum(r["doc_id"] == 9 for r in kept) == 1 and simhash.keep_first(empty).count() == 0


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 7)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    own = {x: x for l in links for x in l}

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, b in links:
        own[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {x: root(x) for x in own if root(x) != x}


# 3

def test_top_k(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 32)).astype(np.float32)
    x[100:140] = x[100]
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)] + [(700, None, 1), (701, [None] * 32, 1), (750, [float("nan")] * 32, 1), (50, [1.0] * 32, 1), (None, [1.0] * 32, 1)]
    out = rows_of(topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")))
    ids = np.array([r[0] for r in rows if r[0] is not None and r[1] and None not in r[1] and r[1][0] == r[1][0]])
    q = np.floor(256 * np.array([r[1] for r in rows if r[0] is not None and r[1] and None not in r[1] and r[1][0] == r[1][0]], np.float64).astype(np.float32).astype(np.float64)).astype(np.int64)
    want = []
    for i, v in zip(ids, q):
        if i % 50 == 0:
            s = q @ v
            keep = [j for j in range(len(ids)) if not (ids[j] == i and (q[j] == v).all())]
            best = sorted(keep, key=lambda j: (-s[j], ids[j]))[:5]
            want += [(int(i), k + 1, int(ids[j]), int(s[j])) for k, j in enumerate(best)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out) == sorted(want)


def test_top_k_of_several_cells_and_partitions(spark):
    rng = np.random.default_rng(7)
    x = np.floor(256 * rng.normal(size=(1600, 8)).astype(np.float32).astype(float)).astype(np.int64)
    rows = [(i, [float(c) / 256 for c in v]) for i, v in enumerate(x)]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else Spark puts a small table's cells in one partition
    try:
        out = rows_of(topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    want = [(i, k + 1, j, int(x[i] @ x[j])) for i in range(0, 1600, 50) for k, j in enumerate(sorted((j for j in range(1600) if j != i), key=lambda j: (-int(x[i] @ x[j]), j))[:5])]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out) == want


def test_top_k_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [3.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r["vec_id"]) for r in rows_of(topk.search(few))] == [(1, 1)]
    assert topk.search(few.limit(0)).count() == 0
    big = spark.createDataFrame([(0, [1e12] * 4), (1, [1e12] * 4), (2, [-1e12] * 4)], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in rows_of(topk.search(big))] == [1, 2]


# 4

def near_lines(text):
    return {text[i : i + 5] for i in range(len(text) - 4)} or {text}


def test_line_dedup_recall(spark):
    rng = random.Random(7)
    lines = [prose(rng, rng.randint(3, 60)) for _ in range(150)]

    def edited(line):
        at = rng.randrange(len(line))
        return line[:at] + rng.choice("qz") + line[at + 1 :]

    pool = lines + [edited(x) for x in lines for _ in range(2)]
    rng.shuffle(pool)
    links = {tuple(sorted(r)) for r in line_dedup.similar_lines(corpus(spark, ["\n".join(pool[i : i + 9]) for i in range(0, len(pool), 9)])).collect()}
    distinct = list(dict.fromkeys(pool))
    hashes = dict(zip(distinct, (r[0] for r in spark.createDataFrame([(x,) for x in distinct], "t string").select(F.xxhash64("t")).collect())))
    sets = {x: near_lines(x) for x in distinct}
    want = [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    own = {h: h for h in hashes.values()}

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, b in links:
        own[max(root(a), root(b))] = min(root(a), root(b))
    joined = sum(root(hashes[a]) == root(hashes[b]) for a, b in want)
    wrong = [1 for a, b in links if (a, b) not in {tuple(sorted((hashes[x], hashes[y]))) for x, y in want}]
    assert joined >= 0.98 * len(want) > 50 and not wrong


def joined_pairs(spark, lines):
    """Of the pairs of lines with a similarity of 0.8 or more: how many are in one component, and how many there are."""
    lines = list(dict.fromkeys(lines))
    links = line_dedup.similar_lines(corpus(spark, ["\n".join(lines[i : i + 50]) for i in range(0, len(lines), 50)]))
    named = dict(components.components(links).collect())
    hashes = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "t string").select(F.xxhash64("t")).collect()]
    at = [named.get(h, h) for h in hashes]
    sets = [near_lines(x) for x in lines]
    want = [(i, j) for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return sum(at[i] == at[j] for i, j in want), len(want)


def test_line_dedup_template(spark):
    """Lines of one template share buckets without being alike; near copies among them are all found."""
    rng = random.Random(11)
    code = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    lines = []
    for _ in range(600):
        line = f"all rights to the work named {code(9)} are held by the owner {code(6)} and by no other person or firm in any place"
        lines += [line, line[:-5] + "place."] if rng.random() < 0.5 else [line, line.replace("person", "parson")]
    joined, n = joined_pairs(spark, lines)
    assert joined == n >= 600


def test_line_dedup_no_spaces(spark):
    """Long lines without white space are known by all their characters, not by the first ones."""
    rng = random.Random(12)
    code = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    urls = ["https://www.example.org/" + code(70) for _ in range(60)]
    other = [code(90) for _ in range(60)]
    joined, n = joined_pairs(spark, urls + [x[:-6] + "-" + x[-6:] for x in urls] + other + ["#" + x[1:] for x in other])
    assert joined >= 0.98 * n and n >= 120


def test_line_dedup_rules(spark):
    """Lines that repeat a pattern are alike whatever their lengths."""
    joined, n = joined_pairs(spark, ["-" * k for k in (20, 50, 90, 400)] + ["ha " * k + "ha" for k in (5, 20, 80)] + ["=-" * k for k in (10, 70)])
    assert joined == n == 10


def test_line_dedup_large_buckets(spark, monkeypatch):
    """In buckets of any size, all alike lines of different components meet once, in pairs that are few."""
    rng = random.Random(13)
    plan = [[rng.choice(WORDS) for _ in range(24)] for _ in range(40)]
    lines = [" ".join(rng.choice(WORDS) if rng.random() < share else w for w in words) for words in plan for share in (0, 0.02, 0.04, 0.06)]
    lines = list(dict.fromkeys(lines))
    texts = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    rows = texts.join(line_dedup.bitmaps(texts), "id").select(F.lit(1).alias("bucket"), F.lit(len(lines)).cast("long").alias("n"), "id", F.col("id").alias("component"), "size", *(f"b{k}" for k in range(line_dedup.WORDS))).cache()
    sets = [near_lines(x) for x in lines]
    want = {(i, j) for j in range(len(lines)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    for block in (1024, 16):
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        pairs = [tuple(r) for r in line_dedup.rest_candidates(rows, 0.8).collect()]
        assert want <= set(pairs) and len(pairs) <= 3 * len(want) and len(want) > 40
    found = {tuple(r) for r in line_dedup.leader_candidates(rows, 0, 0.8).collect()}
    assert found <= set(pairs)
    links = spark.createDataFrame(sorted(want), "u long, v long")
    left = line_dedup.relabelled(rows, links)
    assert line_dedup.rest_candidates(left, 0.8).join(links, ["u", "v"], "left_semi").isEmpty()


def test_line_dedup_leaves_no_files(spark):
    """What only the search for links needs is deleted when they are found."""
    from codeloom.llm.common import shared_dir

    there = lambda: {n for n in os.listdir(shared_dir(spark).removeprefix("file://")) if n.startswith("line-")}
    before = there()
    a = "the same line stands in many documents of this small corpus"
    links = line_dedup.similar_lines(corpus(spark, [a, a.replace("many", "meny"), a.replace("small", "smell")]))
    assert links.count() and len(there() - before) == 1


def test_line_dedup_shuffles_apart(spark, monkeypatch):
    """Lines are read once for both signatures; their shuffle is gone when the one of the buckets starts, which needs no plan of theirs."""
    block = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = block.getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    plans = []

    def met(signed, meet=line_dedup.meetings):
        plans.append(signed._jdf.queryExecution().executedPlan().toString())
        until = time.time() + 30
        while shuffles() - before and time.time() < until:
            time.sleep(0.2)
        plans.append(shuffles() - before)
        return meet(signed)

    monkeypatch.setattr(line_dedup, "meetings", met)
    a = "the same line stands in many documents of this small corpus"
    docs = corpus(spark, [a, a.replace("many", "meny"), "ha ha", "ha ha ha"])
    own = line_dedup.signatures(line_dedup.lines_of(docs, "doc_id", "text"))
    assert own._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert own.groupBy("id").count().select("count").distinct().count() == 2
    before = shuffles()
    assert line_dedup.similar_lines(docs).count()
    assert "Exchange" not in plans[0] and not plans[1]


def test_line_dedup(spark):
    a, b = "the same line stands in many documents of this small corpus", "another line that nobody else has at all in here"
    docs = corpus(spark, [f"{a}\n{b}", f"x\n\n{a}", f"{a.replace('many', 'meny')}\n\nend", a])
    out = {r["doc_id"]: r for r in rows_of(line_dedup.dedup_lines(docs))}
    assert [out[i]["text"] for i in range(4)] == [f"{a}\n{b}", "x\n", "\nend", ""] and out[1]["n_chars"] == 2 and out[1]["__removed"] == 1


def test_line_dedup_odd(odd, empty):
    out = line_dedup.dedup_lines(odd).select(*odd.columns)
    assert out.count() == odd.count() and out.columns == odd.columns and out.where("text is null").count() == odd.where("text is null").count()
    assert line_dedup.dedup_lines(empty).count() == 0


# 5

@pytest.fixture(scope="module")
def byte_bpe():
    return bpe.ByteBPE(bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN, (2000, 2000))


@pytest.fixture(scope="module")
def library(byte_bpe):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.sampled_from("ab é1²'s,.\n\n  \t\r\x1c\x0b　日<|>"), max_size=60) | st.text(max_size=40))
def test_bpe_is_the_librarys(byte_bpe, library, text):
    text = text.encode("utf-8", "ignore").decode()
    assert byte_bpe.encode(text) == library.encode_ordinary(text) and byte_bpe.decode(byte_bpe.encode(text)) == text.encode()


def test_perfect_hash():
    keys = [str(i).encode() for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slot_key.tolist()) == list(range(5000)) and h.key_index(keys).tolist() == list(range(5000))
    assert bpe.PerfectHash([b"a"]).key_index([b"a", b"b"]).tolist() == [0, 0]


def test_bpe_documents(spark, odd, empty, library):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = rows_of(bpe.encode_documents(odd, path, public_tokenizers.PATTERN))
    want = sorted((str(r.doc_id), hashlib.sha256(np.array(library.encode_ordinary(r.text or ""), "<u4").tobytes()).hexdigest()) for r in odd.collect())
    assert sorted((str(r["doc_id"]), r["ids_sha256"]) for r in out) == want
    assert bpe.encode_documents(empty, path, public_tokenizers.PATTERN).count() == 0


# 6

@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60) | st.lists(st.integers(1, 250), max_size=60))
def test_suffix_array(letters):
    s = np.array([*letters, 0], np.int16)
    sa = suffix_dedup.suffix_array(s, 258).tolist()
    plain = s.tolist()
    assert sa == sorted(range(len(plain)), key=lambda i: plain[i:])
    lcp = suffix_dedup.common_prefixes(s, np.array(sa), 20)
    for a, b in zip(sa, sa[1:]):
        k = 0
        while a + k < len(plain) and b + k < len(plain) and plain[a + k] == plain[b + k]:
            k += 1
        assert lcp[b] == min(k, 20)


def repeats_plainly(rows):
    seen, out = set(), []
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - 99):
            w = text[i : i + 100]
            if w in seen:
                gone[i : i + 100] = True
            seen.add(w)
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1))
        out.append((key, len(text), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def check_repeats(docs):
    got = sorted((tuple(r) for r in suffix_dedup.dedup(docs).collect()), key=repr)
    assert got == repeats_plainly([(r.doc_id, (r.text or "").encode()) for r in docs.collect()])
    return got


def test_suffix_dedup(spark):
    rng = random.Random(8)
    base = [prose(rng, rng.randint(5, 200)) for _ in range(30)]
    texts = list(base)
    for _ in range(40):
        a, b = rng.choice(base), rng.choice(base)
        texts.append(prose(rng, 5) + a[rng.randrange(20) :] + rng.choice(["", "é", "zz"]) + b[: rng.randrange(300)])
    texts += ["ab" * 200, "q" * 99, "q" * 500, "é" * 120, base[0], base[0]]
    assert sum(r[2] for r in check_repeats(corpus(spark, texts))) > 1000


def test_suffix_dedup_odd(odd, empty):
    check_repeats(odd)
    assert suffix_dedup.dedup(empty).count() == 0


# 7

def test_targets():
    assert mixing.targets([100, 10, 50], [3, 1, 2], 1.5, 2) == pytest.approx([132, 20, 88])
    assert mixing.targets([0, 0], [3, 1], 1.5, 2) == [0, 0] and mixing.targets([10], [3], 1.5, 2) == [15]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=6), st.integers(1, 9))
def test_split_tree(quotas, shards):
    tree = mixing.split_tree(quotas, shards, 1)
    assert tree.sum(0).tolist() == quotas and tree.min() >= 0 and np.ptp(tree.sum(1)) <= 1


def test_mix(spark):
    rng = random.Random(9)
    docs = corpus(spark, [prose(rng, rng.randint(1, 400)) for _ in range(400)])
    out, again = (sorted(rows_of(mixing.mix(d)), key=lambda r: r["doc_id"]) for d in (docs, docs.repartition(7)))
    assert out == again and len(out) == 400
    for source in {r["source"] for r in out}:
        own = [r for r in out if r["source"] == source]
        assert {r["source_size"] for r in own} == {sum(r["__size"] for r in own)}
        assert abs(sum(r["__taken"] for r in own) - own[0]["target"]) <= 0.01 * own[0]["target"] + 5
    assert all(0 <= r["__taken"] <= 2 * r["__size"] for r in out)
    words = sum(r["__size"] for r in out)
    assert sum({r["source"]: r["target"] for r in out}.values()) == pytest.approx(1.5 * words)
    drawn = mixing.draw(docs)
    assert drawn.columns == docs.columns and 0.8 * 1.5 * words < sum(len(r.text.split()) for r in drawn.collect()) < 1.2 * 1.5 * words


def test_mix_by_brute_force(spark):
    """Words taken and shards of every row, worked out one by one from the plan of the sources."""
    rng = random.Random(19)
    docs = corpus(spark, [prose(rng, rng.choice([0, 1, 7, 300])) for _ in range(300)], rows=[(7, "twice", "en", "s1", 5, "x", "x", "x", "x")] * 2)
    rows = [r.asDict() for r in mixing.planned(docs, shards=5, block_words=16).collect()]
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    made = mixing.plan(list(sizes.items()), 1.5, 2.0, mixing.WEIGHTS, 5, 20, 16)
    assert all(0 <= t[6] <= t[5] and [e[-1] for e in t[9]] == [t[5]] * t[3] + [t[6]] for t in made)  # every draw's quota is dealt out, exactly
    for source, size, target, passes, words, blocks, quota, step, first, ends in made:
        own = sorted((r for r in rows if r["source"] == source), key=lambda r: (r["mark"] & (2**64 - 1), r["key"] is not None, r["key"] or 0))
        # rows with few buckets stand in the order of their marks: first by the top bits without a sign, then as signed numbers
        bits = max(0, math.ceil(math.log2(max(1, max(sum(r["source"] == x[0] for r in rows) for x in made) / mixing.BUCKET_ROWS))))
        own.sort(key=lambda r: ((r["mark"] & (2**64 - 1)) >> (64 - bits), r["mark"]))
        shard = lambda b, draw: sum(e <= (b * step + first + draw) % blocks for e in ends[draw])
        stream = [k for k, r in enumerate(own) for _ in range(r["size"])]
        taken, at = [0] * len(own), 0
        for place, k in enumerate(stream):
            taken[k] += passes + (shard(place // words, passes) < 5)
        for k, r in enumerate(own):
            middle = (at + r["size"] // 2) // words
            shards = [s for d in range(passes + 1) if (s := shard(middle, d)) < 5] if r["size"] else []
            assert (r["taken"], r["shards"], r["source_size"], r["target"]) == (taken[k], shards, size, target)
            at += r["size"]


def test_mix_clashing_columns(spark):
    docs = corpus(spark, ["a b c", "d e", None, "f"]).withColumns({c: F.lit("x") for c in ("words", "target", "passes", "blocks", "quota", "step", "first", "ends", "source_size", "mark", "bucket")})
    assert mixing.mix(docs).count() == 4 and mixing.draw(docs).columns == docs.columns


def test_mix_odd(odd, empty):
    out = rows_of(mixing.mix(odd))
    assert len(out) == odd.count() and all(r["__taken"] <= 2 * r["__size"] for r in out) and all(r["__size"] == len((r["text"] or "").encode().split()) for r in out)
    assert mixing.mix(empty).count() == 0 and mixing.draw(empty).count() == 0


# 8

def test_language_id(spark):
    rng = random.Random(10)
    kinds = {"aa": ["tion", "ing", "the", "and"], "bb": ["keit", "ung", "der", "ß"], "cc": ["ción", "que", "los", "ñ"]}
    rows = []
    for i in range(450):
        lang = list(kinds)[i % 3]
        rows.append((i, " ".join("".join(rng.choices(kinds[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(20, 200))), lang))
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !!", "bb"), (1003, "some text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.learn(docs)
    out = {r["doc_id"]: r for r in rows_of(langid.identify(docs, net))}
    held = [r for i, r in out.items() if r["held_out"] and i < 450]
    assert sum(r["lang_pred"] == list(kinds)[r["doc_id"] % 3] for r in held) / len(held) > 0.95
    assert [out[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and out[1003]["lang_pred"] in kinds
    kept = langid.accept(docs, net)
    assert kept.columns == docs.columns and kept.where("doc_id between 1000 and 1002").count() == 0


def test_language_id_odd(odd, empty):
    net = langid.learn(odd)
    out = rows_of(langid.identify(odd, net))
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert langid.identify(empty, langid.learn(empty)).count() == 0 and all(r["lang_pred"] == "und" for r in rows_of(langid.identify(odd, langid.learn(empty))))


def test_network_tables():
    net = langid.ByteCNN(["a", "b"])
    x = np.random.default_rng(1).integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    assert np.allclose(np.exp(net.log_probs(x)), net._forward(x)[1], atol=1e-4)


# 9

def test_token_files(spark, odd, empty, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    manifest = token_files.write_files(odd, path, 2, files=3)
    rows = sorted(((r.doc_id, (r.text or "")) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    start, want = 0, []
    for key, text in rows:
        ids = whole.encode(text, add_special_tokens=False).ids + [2]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in token_files.read_files(manifest).collect()), key=repr) == sorted(want, key=repr)
    one = manifest.orderBy("ordinal").collect()[-1]
    reader = token_files._open(one.path)
    every = {k: i.tolist() for k, i in reader.walk()}
    assert every and token_files.lookup(one.path, {k}) == {k: every[k]} if (k := max(every, key=lambda x: x or -1)) else True
    assert token_files.read_files(token_files.write_files(empty, path, 2)).count() == 0


def test_damage_is_found(tmp_path):
    import pyarrow.fs as pafs

    fs = pafs.LocalFileSystem()
    at = str(tmp_path / "f.zst")
    w = token_files.FrameWriter(fs.open_output_stream(at, compression=None))
    w.add(5, np.arange(1000)), w.add(None, np.array([7])), w.close()
    r = token_files.FrameReader(fs.open_input_file(at))
    assert [(k, i.tolist()[:2]) for k, i in r.walk()] == [(5, [0, 1]), (None, [7])] and r.ids(1).tolist() == [7]
    data = bytearray(open(at, "rb").read())
    data[20] ^= 1
    open(at, "wb").write(data)
    with pytest.raises(Exception):
        token_files.FrameReader(fs.open_input_file(at)).ids(0)


def test_wide_ids(tmp_path):
    import pyarrow.fs as pafs

    fs, at = pafs.LocalFileSystem(), str(tmp_path / "w.zst")
    w = token_files.FrameWriter(fs.open_output_stream(at, compression=None), wide=True)
    w.add(1, np.array([70000, 3])), w.close()
    assert token_files.FrameReader(fs.open_input_file(at)).ids(0).tolist() == [70000, 3]
    with pytest.raises(ValueError):
        token_files.FrameWriter(fs.open_output_stream(at, compression=None)).add(1, np.array([70000]))
    assert token_files.WordEncoder('{"model": {"vocab": {"a": 1}}, "pre_tokenizer": {"type": "ByteLevel"}}').apart is False


def test_words_are_enough():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, rng = Tokenizer.from_file(path), random.Random(11)
    texts = ["".join(rng.choice("ab É1²'s,.\n\n  \t\r\x1c\x0b　日é́<|Σσ") for _ in range(rng.randint(0, 60))) for _ in range(500)] + ["a<|endoftext|>b", "x <|startoftext|>"]
    e = token_files.WordEncoder(open(path, encoding="utf-8").read(), 50)
    assert [i.tolist() for i in e.encode([t.encode() for t in texts], None)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_cache():
    c = Cache(3)
    for words in ({1, 2}, {2, 3}, {4}, {2, 5}, {1}):
        c.now.update((w, w) for w in c.unknown(set(words))) or None
        c.now.update((w, w) for w in words)
        assert words <= set(c.now) and len(c.now) <= 3


# 10

@settings(max_examples=60, deadline=None)
@given(st.integers(0, 300), st.integers(0, 575), st.booleans())
def test_ogg_round_trip(packets, more, hard):
    payload = (os.urandom(packets * 576) if hard else bytes(packets * 576)) or b"\xff" * 576
    media = ogg.store(payload)
    assert ogg.load(media) == (payload, pytest.approx(len(payload) / ogg.RATE))


def crc_plainly(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c >> 31 else c << 1
            c &= 0xFFFFFFFF
    return c


def test_ogg_pages():
    assert all(ogg.page_crc(x) == crc_plainly(x) for x in (b"", b"a", b"123456789", bytes(range(256))))
    x = b"".join(ogg.pages(1, [(b"h", 0), (b"x" * 255 * 300, 5), (b"", 6), (b"y" * 510, 7)]))
    assert [(len(p), g) for p, g in ogg.demux(x)[1]] == [(1, 0), (76500, None), (0, None), (510, 7)]
    for bad in (x[:-1], x[:40] + b"?" + x[41:], x[1:], x[: x.index(b"OggS", 4)]):
        with pytest.raises(ValueError):
            ogg.demux(bad)


def test_ogg_documents(odd, empty):
    out = rows_of(ogg.media_column(odd))
    for r, text in zip(sorted(out, key=lambda r: (r["n_bytes"], r["media_sha256"])), sorted(((t.text or "").encode() for t in odd.collect()), key=len)):
        size = 576 * max(1, -(-len(text) // 576))
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(text), size, len(r["media"]))
    assert {r["payload_sha256"] for r in out} == {hashlib.sha256((t.text or "").encode() + b"\xff" * (576 * max(1, -(-len((t.text or "").encode()) // 576)) - len((t.text or "").encode()))).hexdigest() for t in odd.collect()}
    assert ogg.media_column(empty).count() == 0


# the registered queries and the pipeline

def test_fold(spark):
    rows = spark.createDataFrame([(i,) for i in [0, 7, None]], "doc_id long").select("doc_id", fold("doc_id", 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    assert "doc_id" in df.columns or "query_id" in df.columns
    assert df.count() > 0


def test_query_repeats(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = sorted((tuple(r) for r in queries.QUERIES["op6_suffix_dedup"](spark, data).collect()), key=repr)
    assert got == repeats_plainly([(r.doc_id, (r.text or "").encode()) for r in docs.collect()])


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    stages, now = corpus_pipeline.STAGES, docs
    for name, stage in stages[:-1]:
        now = stage(spark, now, data).cache()
        assert now.columns == docs.columns and now.count() > 0, name
    out = stages[-1][1](spark, now, data)
    assert out.count() == now.count()
    assert corpus_pipeline.run(spark, data).count() == out.count()


def test_pipeline_leaves_memory_to_the_encoder(spark, odd, monkeypatch):
    """Small batches and caches of the pipeline's encoder, and the same ids."""
    import corpus_pipeline

    seen, plain = [], bpe.ByteBPE.__init__
    monkeypatch.setattr(bpe.ByteBPE, "__init__", lambda self, ranks, pattern, entries=bpe.CACHE_ENTRIES: seen.append(entries) or plain(self, ranks, pattern, entries))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        got = rows_of(corpus_pipeline.encode(spark, odd, ""))
        assert spark.conf.get(name) == str(corpus_pipeline.BATCH_ROWS) and seen == [corpus_pipeline.ENCODER_CACHE] and sum(seen[0]) <= sum(bpe.CACHE_ENTRIES) / 4
        assert got == rows_of(bpe.encode_documents(odd, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))
        spark.conf.set(name, "7")
        corpus_pipeline.encode(spark, odd, "")
        assert spark.conf.get(name) == "7"
    finally:
        spark.conf.set(name, before)
