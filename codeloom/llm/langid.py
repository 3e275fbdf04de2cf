"""Language identification by a byte convolutional network in numpy.

Bytes are embedded; filters of widths 2, 3 and 4 run over windows of a fixed
length; each filter's largest answer in a window goes through a softmax layer.
A text's languages are the mean of its windows' log-probabilities, so whole
texts are read whatever their length.

Defined results: a text that is null or has no letter is ``und`` with score 0;
with no labelled row to learn from every text is; rows without a language are
not learned from; repeated rows get the same answer. Only the text is an input.
"""

from __future__ import annotations

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, give_back, map_rows

#: Bytes of a window; size of a byte's embedding; filters of each width.
WINDOW, EMBED, FILTERS, WIDTHS = 256, 8, 16, (2, 3, 4)
#: Bounds of the training sample: rows of a language, windows of a row.
ROWS_PER_LANG, WINDOWS_PER_ROW = 600, 4
_LETTER = regex.compile(r"\p{L}").search
UND = "und"


def windows(raw: bytes) -> np.ndarray:
    """All windows of a text, one row each; the last is filled up with zeros."""
    n = max(1, -(-len(raw) // WINDOW))
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


class ByteCNN:
    def __init__(self, langs: list[str], seed: int = 8):
        rng, self.langs = np.random.default_rng(seed), langs
        hidden = FILTERS * len(WIDTHS)
        self.p = {"embed": rng.normal(0, 0.5, (256, EMBED)), "out": rng.normal(0, 0.1, (hidden, len(langs))), "bias": np.zeros(len(langs)), "shift": np.zeros(hidden)}
        for w in WIDTHS:
            self.p[f"conv{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.tables = None

    # training

    def _forward(self, x: np.ndarray):
        e = self.p["embed"][x]
        pooled, where = [], []
        for w in WIDTHS:
            n = WINDOW - w + 1
            stack = np.concatenate([e[:, k : k + n] for k in range(w)], axis=2)
            a = stack @ self.p[f"conv{w}"]
            at = a.argmax(1)
            where.append(at)
            pooled.append(np.take_along_axis(a, at[:, None], 1)[:, 0])
        h = np.tanh(np.hstack(pooled) + self.p["shift"])
        z = h @ self.p["out"] + self.p["bias"]
        z -= z.max(1, keepdims=True)
        prob = np.exp(z)
        return h, prob / prob.sum(1, keepdims=True), where, e

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 4e-3, seed: int = 8) -> None:
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                xb, yb = x[own], y[own]
                h, prob, where, e = self._forward(xb)
                dz = prob
                dz[np.arange(len(own)), yb] -= 1
                dz /= len(own)
                g = {"out": h.T @ dz, "bias": dz.sum(0)}
                dh = (dz @ self.p["out"].T) * (1 - h * h)
                g["shift"] = dh.sum(0)
                g["embed"] = np.zeros_like(self.p["embed"])
                rows = np.arange(len(own))[:, None]
                for i, w in enumerate(WIDTHS):
                    d, top = dh[:, i * FILTERS : (i + 1) * FILTERS], where[i]
                    conv, grad = self.p[f"conv{w}"], np.zeros_like(self.p[f"conv{w}"])
                    for k in range(w):
                        part = slice(k * EMBED, (k + 1) * EMBED)
                        grad[part] = np.einsum("bfe,bf->ef", e[rows, top + k], d)
                        np.add.at(g["embed"], xb[rows, top + k], d[:, :, None] * conv[part].T[None])
                    g[f"conv{w}"] = grad
                t += 1
                for k, a in self.p.items():
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    a -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    # prediction: a filter's answer is a sum over its bytes, looked up by pairs of bytes

    def _prepare(self) -> None:
        e = self.p["embed"]
        single = {w: [e @ self.p[f"conv{w}"][k * EMBED : (k + 1) * EMBED] for k in range(w)] for w in WIDTHS}
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
        s2, s3, s4 = (single[w] for w in WIDTHS)
        # all that depends on the pair at a place: width 2, and the first two bytes of widths 3 and 4
        self.tables = np.ascontiguousarray(np.hstack([pair(*s2), pair(*s3[:2]), pair(*s4[:2])])), s3[2], np.ascontiguousarray(pair(*s4[2:]))

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities of the languages for windows of bytes."""
        if self.tables is None:
            self._prepare()
        head, third, tail = self.tables
        f, out = FILTERS, np.empty((len(x), len(self.langs)), np.float32)
        for at in range(0, len(x), 64):
            b = x[at : at + 64]
            pairs = (b[:, :-1].astype(np.int32) << 8) | b[:, 1:]
            a = head[pairs]
            end = WINDOW - 1
            h2 = a[:, :end, :f].max(1)
            h3 = (a[:, : end - 1, f : 2 * f] + third[b[:, 2:]]).max(1)
            h4 = (a[:, : end - 2, 2 * f :] + tail[pairs[:, 2:]]).max(1)
            z = np.tanh(np.hstack([h2, h3, h4]) + self.p["shift"]) @ self.p["out"] + self.p["bias"]
            z -= z.max(1, keepdims=True)
            out[at : at + 64] = z - np.log(np.exp(z).sum(1, keepdims=True))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        raw = [t.encode() if t and _LETTER(t) else b"" for t in texts]
        names, scores = [UND] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return names, scores
        group: list[int] = []
        size = 0
        for i, r in enumerate(raw):
            if r:
                group.append(i)
                size += len(r)
            if group and (size > 1 << 18 or i == len(raw) - 1):
                w = [windows(raw[j]) for j in group]
                starts = np.cumsum([0] + [len(a) for a in w[:-1]])
                lp = self.log_probs(np.concatenate(w))
                mean = np.add.reduceat(lp, starts, 0) / np.array([len(a) for a in w])[:, None]
                p = np.exp(mean - mean.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                for j, k, s in zip(group, best.tolist(), p.max(1).tolist()):
                    names[j], scores[j] = self.langs[k], min(1.0, s)
                group, size = [], 0
        return names, scores


def train(texts: list[str], langs: list[str]) -> ByteCNN:
    names = sorted(set(langs))
    net = ByteCNN(names)
    x, y = [], []
    for t, lang in zip(texts, langs):
        w = windows(t.encode())
        if len(w) > WINDOWS_PER_ROW:  # evenly from the whole text
            w = w[np.linspace(0, len(w) - 1, WINDOWS_PER_ROW).astype(int)]
        x.append(w)
        y += [names.index(lang)] * len(w)
    if x and len(names) > 1:
        x = np.concatenate(x)
        # texts shorter than a window: as many again cut to part of one
        short, rng = x.copy(), np.random.default_rng(8)
        for row, n in zip(short, rng.integers(24, WINDOW, len(short))):
            row[n:] = 0
        net.fit(np.concatenate([x, short]), np.array(y + y))
    return net


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, held: int = 2, rows_per_lang: int = ROWS_PER_LANG) -> ByteCNN:
    """Sample about ``rows_per_lang`` rows of each language outside the held-out fold, by a keyed hash."""
    known = docs.select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(fold("k", folds) != held)
    totals = known.groupBy("lang").count().orderBy("lang").collect()  # one row a language
    if not totals:
        return train([], [])
    spread = 1 << 30
    share = docs.sparkSession.createDataFrame([(r[0], min(spread, round(spread * rows_per_lang / r[1]))) for r in totals], "lang string, share long")
    # the key and the text decide, so rows that repeat a key only aren't taken or left together
    some = known.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64(F.lit(8), "k", "text"), F.lit(spread)) < F.col("share"))
    rows = some.select("text", "lang").distinct().collect()
    rows = sorted(((r[0], r[1]) for r in rows), key=lambda r: (xxhash.xxh64_intdigest(r[0]), r))
    return train([r[0] for r in rows], [r[1] for r in rows])


def identify(docs: DataFrame, net: ByteCNN, key: str = "doc_id", text: str = "text", folds: int = 4, held: int = 2) -> DataFrame:
    """Per row: key, held_out, lang_pred, score. No shuffle; the network is a few hundred KB."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, held_out boolean, lang_pred string, score double"

    def setup():
        model = shared.value

        def one(batch):
            names, scores = model.predict(batch.column(2).to_pylist())
            return {key: batch.column(0), "held_out": batch.column(1), "lang_pred": names, "score": scores}

        return one

    return map_rows(docs.select(docs[key].alias(key), (fold(key, folds) == held).alias("__held"), docs[text].alias("__text")), None, schema, setup)


def accept(docs: DataFrame, net: ByteCNN, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows whose language is told with a score of ``least`` or more; all columns stay."""
    shared, columns = docs.sparkSession.sparkContext.broadcast(net), docs.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            names, scores = shared.value.predict(batch.column(columns.index(text)).to_pylist())
            yield batch.filter(pa.array([n != UND and s >= least for n, s in zip(names, scores)], pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)
