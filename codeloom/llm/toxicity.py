"""Toxicity by class-conditional Kneser-Ney models.

Two character models of words (one learned from toxic rows, one from ordinary
rows) share their lower orders: a class's discounted counts back off half to its
own lower order and half to continuation counts over both classes, so an
expression that is rare in either class is judged by what both have seen. A
text's main evidence is the difference of its two log-likelihoods divided by its
letters; its strongest expressions stand beside that. A small logistic model
turns evidence into a score.

The counts come from every labelled row outside the held-out fold, gathered by
distributed sums of words and then of n-grams. Only a bounded sample of rows,
which the counts leave out, reaches the driver to fit the logistic weights.
Contexts are folded into ``CONTEXT_BINS`` numbers an order, which bounds the
model that is broadcast; all rows count at every size.

Defined results: null and empty texts have no evidence and score the base rate;
labels that are null are not learned from, of labels that differ for one key the
greatest counts; one class missing gives the base rate everywhere; repeated rows
are scored alike. Only the text enters a score.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, map_rows

#: Bound on the rows of each class that the logistic weights are fitted on; one in SAMPLE_SHARE rows may be taken for it.
ROWS_PER_CLASS, SAMPLE_SHARE = 2000, 4
#: Longest n-gram, discount, bins of contexts an order.
ORDER, DISCOUNT, CONTEXT_BINS = 5, 0.75, 1 << 21
#: Letters that a shorter word counts as.
SHORT = 6
#: Words of the cache that each Python worker keeps, and of a task's counts before they are handed on.
CACHE_ENTRIES, COUNT_ENTRIES = 600_000, 300_000
_WORDS = re.compile(r"\w+").findall
_N_FEATURES = 8
_LETTER_BITS = 21


def _grams(words: list[str], order: int):
    """For each order: n-grams that end at each letter or word's end (context's bin and letter), and the contexts' bins."""
    codes = np.frombuffer("".join("\x02" + w + "\x03" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    starts = np.flatnonzero(codes == 2)
    length = np.diff(np.append(starts, len(codes)))
    place, word = np.arange(len(codes)) - np.repeat(starts, length), np.repeat(np.arange(len(words)), length)
    keep = place > 0  # the start mark is never predicted
    out, context = [], np.zeros(len(codes), np.uint64)
    for n in range(1, order + 1):
        bins = (context >> np.uint64(32)) % np.uint64(CONTEXT_BINS)
        out.append((((bins << np.uint64(_LETTER_BITS)) | codes)[keep].astype(np.int64), bins[keep].astype(np.int64)))
        # one letter more to the left; before the start mark stands nothing
        back = np.zeros(len(codes), np.uint64)
        back[n:] = codes[: len(codes) - n]
        back[place < n] = 1
        context = (context ^ back) * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(n)
        context ^= context >> np.uint64(29)
    return word[keep], out


class _Table:
    """Sorted 64-bit keys with a row of numbers each; keys that it lacks have zeros."""

    def __init__(self, keys: np.ndarray, columns: list[np.ndarray]):
        self.keys, at = np.unique(keys, return_inverse=True)
        self.values = np.zeros((len(self.keys) + 1, len(columns)), np.float32)
        for k, c in enumerate(columns):
            self.values[:-1, k] = np.bincount(at, c, len(self.keys))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return self.values[np.zeros(len(keys), np.int64)]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.values[np.where(self.keys[at] == keys, at, len(self.keys))]


def _sums(words: list[str], counts: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the n-grams of these words, and in how many words and tokens of either class (rows) they stand."""
    word, grams = _grams(words, order)
    out = []
    for gram, _ in grams:
        keys, at = np.unique(gram, return_inverse=True)
        out.append((keys, np.array([np.bincount(at, w, len(keys)) for w in (np.ones(len(word)), counts[0][word], counts[1][word])])))
    return out


class KneserNey:
    """Class-conditional models with shared backoff, from each order's n-grams and their sums.

    For each order one table by n-gram and one by context hold, for the shared
    model and both classes, the counts, their totals and the kinds that follow.
    The shared model counts in how many different words of either class an
    n-gram stands; a class counts its own tokens.
    """

    def __init__(self, sums: list[tuple[np.ndarray, np.ndarray]], discount: float = DISCOUNT):
        self.order, self.discount = len(sums), discount
        self.grams, self.contexts = [], []
        for keys, (w, c0, c1) in sums:
            self.grams.append(_Table(keys, [w, c0, c1]))
            self.contexts.append(_Table(keys >> _LETTER_BITS, [w, c0, c1, w > 0, c0 > 0, c1 > 0]))

    @classmethod
    def of(cls, counts: tuple[dict[str, int], dict[str, int]], order: int = ORDER) -> KneserNey:
        """From word counts of (ordinary, toxic) texts."""
        vocabulary = sorted(set(counts[0]) | set(counts[1]))
        return cls(_sums(vocabulary, np.array([[c.get(x, 0) for x in vocabulary] for c in counts], float), order))

    def _level(self, count, total, kinds, lower):
        d = self.discount * np.minimum(1, total / np.maximum(kinds, 1))
        p = (np.maximum(count - d, 0) + d * kinds * lower) / np.maximum(total, 1e-9)
        return np.where(total > 0, p, lower)

    def ratios(self, words: list[str]) -> np.ndarray:
        """Length-normalised log-likelihood ratio (toxic : ordinary) of each word; short words count as of SHORT letters."""
        if not words:
            return np.zeros(0, np.float32)
        word, grams = _grams(words, self.order)
        lower = np.full(len(word), 1 / 256, np.float32)
        classes = [lower, lower]
        for n, (gram, ctx) in enumerate(grams):
            count, of = self.grams[n](gram).T, self.contexts[n](ctx).T
            lower = self._level(count[0], of[0], of[3], lower)
            if n < 2:
                classes = [lower, lower]
                continue
            # the class's counts of this order back off half to its own lower order, half to the shared one
            classes = [self._level(count[c + 1], of[c + 1], of[c + 4], 0.5 * classes[c] + 0.5 * lower) for c in (0, 1)]
        diff = np.log(classes[1]) - np.log(classes[0])
        return (np.bincount(word, diff, len(words)) / np.maximum(np.bincount(word, minlength=len(words)), SHORT)).astype(np.float32)


class ToxicityModel:
    def __init__(self, model: KneserNey, weights: np.ndarray, base: float):
        self.model, self.weights, self.base, self.ratio = model, weights, base, {}

    def __getstate__(self):
        return self.__dict__ | {"ratio": {}}

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Per text: ratio of the whole text a letter, mean ratio of words, the three strongest words, log of the sum and share of strong words, whether it has words."""
        return _evidence(self.model, self.ratio, texts)

    def score(self, texts: list[str]) -> np.ndarray:
        x = self.evidence(texts)
        z = x @ self.weights[:-1] + self.weights[-1]
        return np.where(x[:, -1] > 0, 1 / (1 + np.exp(-np.clip(z, -40, 40))), self.base)


def _evidence(model: KneserNey, cache: dict[str, float], texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), _N_FEATURES))
    for at in range(0, len(texts), 64):
        parts = [_WORDS(t.lower()) for t in texts[at : at + 64]]
        seen = set().union(*parts)
        if new := list(seen.difference(cache)):
            if len(cache) + len(new) > CACHE_ENTRIES:
                cache.clear()
                new = list(seen)
            cache.update(zip(new, model.ratios(new).tolist()))
        for k, p in enumerate(parts):
            if p:
                r = np.array(list(map(cache.__getitem__, p)), np.float32)
                top = np.sort(np.partition(r, -3)[-3:] if len(r) > 3 else r)[::-1]
                high = r[r > 0.25]
                letters = np.fromiter(map(len, p), np.float32, len(p)) + 1
                out[at + k] = (r @ np.maximum(letters, SHORT) / letters.sum(), r.mean(), top[0], top[min(1, len(top) - 1)], top[-1], np.log1p(high.sum()), len(high) / len(r), 1)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1.0) -> np.ndarray:
    """Weights, the last for the constant, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def calibrate(model: KneserNey, texts: list[str], labels: list[int], base: float) -> ToxicityModel:
    """Fit the logistic weights on texts that the model hasn't seen; ``base`` is the toxic share of all labelled rows."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(model, np.r_[np.zeros(_N_FEATURES), np.log((base + 1e-6) / (1 - base + 1e-6))], base)
    w = _logistic(_evidence(model, {}, texts), y)
    # the sample holds the classes in other shares than the table
    w[-1] += np.log(base / (1 - base)) - np.log(y.mean() / (1 - y.mean())) if 0 < base < 1 else 0
    return ToxicityModel(model, w, base)


def _count_words(batches):
    """(text, label) rows to words and their counts in both classes; a task hands its counts on when they fill their bound."""
    counts = (Counter(), Counter())

    def done():
        both = list(set(counts[0]) | set(counts[1]))
        for at in range(0, len(both), 50_000):
            part = both[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([c[x] for x in part], pa.int64()) for c in counts)], ["word", "c0", "c1"])

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[label].update(_WORDS((text or "").lower()))
            if len(counts[0]) + len(counts[1]) > COUNT_ENTRIES:
                yield from done()
                counts = (Counter(), Counter())
    yield from done()


def _count_grams(batches):
    """Words and counts to n-grams, their order and their sums, each batch by itself."""
    for batch in batches:
        if batch.num_rows:
            own = np.array([batch.column(k).to_numpy() for k in (1, 2)], float)
            for n, (keys, sums) in enumerate(_sums(batch.column(0).to_pylist(), own, ORDER)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), n, np.int32)), pa.array(keys), *map(pa.array, sums)], ["n", "gram", "w", "c0", "c1"])


def language_models(rows: DataFrame) -> KneserNey:
    """Both classes' models from all rows of (__text, __label): sums over words, then over n-grams, shuffle only partial sums."""
    words = rows.select("__text", "__label").mapInArrow(_count_words, "word string, c0 long, c1 long").groupBy("word").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    grams = words.mapInArrow(_count_grams, "n int, gram long, w double, c0 double, c1 double").groupBy("n", "gram").agg(*(F.sum(c).alias(c) for c in ("w", "c0", "c1")))
    found = grams.toArrow()
    order, keys, *sums = (found.column(c).to_numpy() for c in found.column_names)
    return KneserNey([(keys[order == n], np.array([s[order == n] for s in sums])) for n in range(ORDER)])


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, held: int = 0, rows_per_class: int = ROWS_PER_CLASS) -> ToxicityModel:
    """Counts from all labelled rows outside the held-out fold but a keyed sample of at most ``rows_per_class`` of each class, which fits the weights."""
    marks = labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__label")).where(F.col("__label").isin(0, 1) & F.col("__key").isNotNull()).where(fold("__key", folds) != held)
    marks = marks.groupBy("__key").agg(F.max("__label").alias("__label"))
    totals = {r[0]: r[1] for r in marks.groupBy("__label").count().collect()}
    if not totals:
        return calibrate(KneserNey.of(({}, {})), [], [], 0.0)
    drawn = marks.where(F.pmod(F.xxhash64("__key"), F.lit(SAMPLE_SHARE)) == 0)
    chosen = [drawn.where(F.col("__label") == c).orderBy(F.xxhash64(F.lit("sample"), "__key"), "__key").limit(rows_per_class) for c in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))
    given = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    # labels grow with the texts, so they meet by a sort-merge join at every size
    model = language_models(given.join(marks.join(chosen, ["__key", "__label"], "left_anti").hint("merge"), "__key"))
    # a key may come in many rows: one of each is enough to fit the weights, and bounds what the driver holds
    sample = given.join(chosen, "__key").groupBy("__key", "__label").agg(F.min("__text").alias("__text")).orderBy("__key").collect()
    return calibrate(model, [r["__text"] or "" for r in sample], [r["__label"] for r in sample], totals.get(1, 0) / sum(totals.values()))


def score_documents(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text", folds: int = 5, held: int = 0) -> DataFrame:
    """Per row: key, held_out, score, predicted. No shuffle; the model is broadcast, its size bounded by the sample."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, held_out boolean, score double, predicted int"

    def setup():
        m = shared.value

        def one(batch):
            s = m.score([x or "" for x in batch.column(2).to_pylist()])
            return {key: batch.column(0), "held_out": batch.column(1), "score": s, "predicted": (s >= 0.5).astype(np.int32)}

        return one

    return map_rows(docs.select(docs[key].alias(key), (fold(key, folds) == held).alias("__held"), docs[text].alias("__text")), None, schema, setup)
