"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A word enters as the embedding of the word itself (of words seen in training) joined with the mean embedding of its
hashed character runs, so unseen forms of a word still speak. Two gated recurrent layers read a window of words in both
directions, attention pools their states, and a logistic unit gives the window's score. A document is scored over
all overlapping windows of its whole text; its score is that of its most toxic window. Training picks, in each epoch,
the window of each training document that scores highest, which is how a document's label is meant.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import hash60

#: Words of a window, words from one window to the next, and the score from which a text counts as toxic.
WINDOW, STRIDE, TOXIC = 64, 48, 0.3
WORD_DIM, CHAR_DIM, HIDDEN = 12, 12, 12
CHAR_RUNS, CHAR_BUCKETS, WORDS = (3, 4, 5), 1 << 14, 4000
#: Only letters matter: other ASCII bytes separate words.
LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
MEMO = 60_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(LETTERS).split()


def char_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character runs of all words (with word ends marked), and where each word's begin."""
    joined = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    of = np.repeat(np.arange(len(words)), lengths)
    left = ends[of] - np.arange(len(joined))  # bytes from here to the word's end
    found, owner, h = [], [], joined.copy()
    for n in range(2, max(CHAR_RUNS) + 1):
        h = h[:-1] * np.uint64(0x100000001B3) ^ joined[n - 1 :]
        if n in CHAR_RUNS:
            at = np.flatnonzero(left[: len(h)] >= n)
            x = (h[at] ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            found.append((x >> np.uint64(50)).astype(np.int64) % CHAR_BUCKETS)
            owner.append(of[at])
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return found[order], np.searchsorted(owner[order], np.arange(len(words)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def windows_of(n: int) -> list[int]:
    """Starts of the overlapping windows over n words; the last one ends with the text."""
    if n <= WINDOW:
        return [0] if n else []
    starts = list(range(0, n - WINDOW, STRIDE))
    return [*starts, n - WINDOW]


class Network:
    """Parameters, forward pass and gradients."""

    def __init__(self, vocabulary: list[bytes], seed: int = 5) -> None:
        rng, d = np.random.default_rng(seed), WORD_DIM + CHAR_DIM
        near = lambda *shape, s=None: rng.normal(0, s or shape[0] ** -0.5, shape).astype(np.float32)
        self.number = {w: i + 1 for i, w in enumerate(vocabulary)}  # 0: a word not seen in training
        self.p = {"words": near(len(vocabulary) + 1, WORD_DIM, s=0.1), "chars": near(CHAR_BUCKETS, CHAR_DIM, s=0.3)}
        for way in "fb":
            self.p |= {f"x{way}": near(d, 3 * HIDDEN), f"h{way}": near(HIDDEN, 3 * HIDDEN), f"b{way}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"look": near(2 * HIDDEN, 1, s=0.3)[:, 0], "out": near(2 * HIDDEN, 1, s=0.3)[:, 0], "bias": np.zeros(1, np.float32)}

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """Input vector of each word."""
        if len(words) > 4096:  # bounds what is held at once
            return np.concatenate([self.inputs(words[i : i + 4096]) for i in range(0, len(words), 4096)])
        buckets, starts = char_buckets(words)
        sums = np.add.reduceat(self.p["chars"][buckets], starts, axis=0)
        counts = np.diff(np.append(starts, len(buckets)))
        known = np.fromiter((self.number.get(w, 0) for w in words), np.int64, len(words))
        return np.concatenate([self.p["words"][known], sums / np.sqrt(counts)[:, None]], axis=1)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """What a word adds to the gates of both directions; the last row stands for no word and keeps the state."""
        g = np.concatenate([x @ self.p["xf"] + self.p["bf"], x @ self.p["xb"] + self.p["bb"]], axis=1)
        none = np.zeros((1, g.shape[1]), np.float32)
        none[:, :HIDDEN] = none[:, 3 * HIDDEN : 4 * HIDDEN] = 30
        return np.concatenate([g, none]).astype(np.float32)

    def table(self, words: list[bytes]) -> np.ndarray:
        """gates of many words, filled in parts so that no second copy is held."""
        out = np.empty((len(words) + 1, 6 * HIDDEN), np.float32)
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            out[i : i + len(part)] = self.gates(self.inputs(part))[:-1]
        out[-1] = self.gates(np.zeros((0, WORD_DIM + CHAR_DIM), np.float32))[0]
        return out

    def _run(self, gates: np.ndarray, at: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """States (windows, WINDOW, HIDDEN) of one direction. at: gate rows (windows, WINDOW)."""
        g, u = gates[:, : 3 * HIDDEN] if way == "f" else gates[:, 3 * HIDDEN :], self.p[f"h{way}"]
        h, out = np.zeros((len(at), HIDDEN), np.float32), np.empty((at.shape[1], len(at), HIDDEN), np.float32)
        for t in range(at.shape[1]) if way == "f" else range(at.shape[1] - 1, -1, -1):
            a, b = g[at[:, t]], h @ u
            zr = 1 / (1 + np.exp(-(a[:, : 2 * HIDDEN] + b[:, : 2 * HIDDEN])))
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(a[:, 2 * HIDDEN :] + r * b[:, 2 * HIDDEN :])
            if keep is not None:
                keep.append((t, h, z, r, n, b[:, 2 * HIDDEN :]))
            h = n + z * (h - n)
            out[t] = h
        return out.transpose(1, 0, 2)

    def forward(self, gates: np.ndarray, at: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each window. at: gate rows, the last row of gates where a window has no more words."""
        kept = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        h = np.concatenate([self._run(gates, at, w, kept[w]) for w in "fb"], axis=2)
        look = h @ self.p["look"]
        look[at == len(gates) - 1] = -1e9
        weight = np.exp(look - look.max(1, keepdims=True))
        weight /= weight.sum(1, keepdims=True)
        pooled = (weight[:, :, None] * h).sum(1)
        if keep is not None:
            keep |= {"runs": kept, "h": h, "weight": weight, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def gradients(self, gates: np.ndarray, at: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the weighted log loss by parameter, and by gates."""
        keep: dict = {}
        error = ((_sigmoid(self.forward(gates, at, keep)) - label) * weight / weight.sum()).astype(np.float32)
        out = {"out": keep["pooled"].T @ error, "bias": error.sum(keepdims=True)}
        d_pooled = error[:, None] * self.p["out"]
        d_weight = (keep["h"] * d_pooled[:, None]).sum(2)
        d_look = keep["weight"] * (d_weight - (keep["weight"] * d_weight).sum(1, keepdims=True))
        out["look"] = np.einsum("bt,bth->h", d_look, keep["h"])
        d_h = keep["weight"][:, :, None] * d_pooled[:, None] + d_look[:, :, None] * self.p["look"]
        d_gates, order = np.zeros_like(gates), np.argsort(at, axis=None, kind="stable")
        first, begin = np.unique(at.ravel()[order], return_index=True)
        for k, way in enumerate("fb"):
            u, side, h_side = self.p[f"h{way}"], slice(3 * HIDDEN * k, 3 * HIDDEN * (k + 1)), slice(HIDDEN * k, HIDDEN * (k + 1))
            carry, d_u, d_all = np.zeros((len(at), HIDDEN), np.float32), np.zeros_like(u), np.empty((*at.shape, 3 * HIDDEN), np.float32)
            for t, h, z, r, n, b in reversed(keep["runs"][way]):
                d = carry + d_h[:, t, h_side]
                d_n, d_z = d * (1 - z) * (1 - n * n), d * (h - n) * z * (1 - z)
                d_r, d_b = d_n * b * r * (1 - r), d_n * r
                d_all[:, t], d_mul = np.concatenate([d_z, d_r, d_n], axis=1), np.concatenate([d_z, d_r, d_b], axis=1)
                d_u += h.T @ d_mul
                carry = d * z + d_mul @ u.T
            out[f"h{way}"] = d_u
            d_gates[first, side] = np.add.reduceat(d_all.reshape(-1, 3 * HIDDEN)[order], begin, axis=0)
        return out, d_gates


class Scorer:
    """Scores texts with a fitted network; remembers the gates of words up to a bound."""

    def __init__(self, network: Network) -> None:
        self.net = network
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.gates = np.zeros((0, 6 * HIDDEN), np.float32)

    def _numbers(self, words: list[bytes], new: list[bytes]) -> np.ndarray:
        index, out = self.index, []
        for w in words:
            i = index.get(w)
            if i is None:
                i = index[w] = len(index)
                new.append(w)
            out.append(i)
        return np.array(out, np.int64)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Score of each text: its highest window's; 0 where there is no word."""
        if len(self.index) > MEMO:
            self.clear()
        new: list[bytes] = []
        numbers = [self._numbers(words_of(t), new) for t in texts]
        if new:
            self.gates = np.concatenate([self.gates, self.net.gates(self.net.inputs(new))[:-1]])
        table = np.concatenate([self.gates, self.net.gates(np.zeros((0, WORD_DIM + CHAR_DIM), np.float32))])
        spans = [(k, s) for k, x in enumerate(numbers) for s in windows_of(len(x))]
        out = np.full(len(texts), -np.inf)
        for i in range(0, len(spans), 2048):
            part = spans[i : i + 2048]
            at = np.full((len(part), WINDOW), len(table) - 1)
            for row, (k, s) in zip(at, part, strict=True):
                x = numbers[k][s : s + WINDOW]
                row[: len(x)] = x
            np.maximum.at(out, [k for k, _ in part], self.net.forward(table, at))
        return np.where(np.isinf(out), 0.0, _sigmoid(out))


def evidence(holds: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """How far each feature leans to toxic texts, from (toxic, clean) counts of texts that hold it: 0 for chance, about 2 for sure.

    A z score of the difference of shares, with two toxic texts less so that rare features need more than luck.
    """
    a, b = np.maximum(holds[0] - 2, 0), holds[1]
    share = np.maximum(a + b, 1) / (toxic + clean)
    z = (a / toxic - b / clean) / np.sqrt(share * (1 - np.minimum(share, 0.99)) * (1 / toxic + 1 / clean))
    return (np.clip(z - 2, 0, 6) / 3).astype(np.float32)


def fit(texts: list[str], labels: list[int], steps: int = 500, batch: int = 48, rate: float = 0.01, seed: int = 5) -> Network | None:
    """Fit by about so many steps of Adam on the highest window of each text, five times at least. None without texts of both labels.

    A pass over few texts is one step, so the number of passes is bounded by steps, however few the texts.
    """
    place: dict[bytes, int] = {}
    numbers, label = [], []
    for t, y in zip(texts, labels, strict=True):
        found = words_of(t)
        if found:
            numbers.append(np.fromiter((place.setdefault(w, len(place)) for w in found), np.int32, len(found)))
            label.append(y)
    label = np.array(label, np.float32)
    if len(set(label.tolist())) < 2:
        return None
    vocabulary = list(place)
    seen = np.bincount(np.concatenate([np.unique(x) for x in numbers]), minlength=len(vocabulary))
    common = sorted(np.flatnonzero(seen > 2).tolist(), key=lambda i: (-seen[i], vocabulary[i]))[:WORDS]
    net = Network([vocabulary[i] for i in common], seed)
    parts = [char_buckets(vocabulary[i : i + 4096]) for i in range(0, len(vocabulary), 4096)]
    shifts = np.cumsum([0, *(len(x) for x, _ in parts)])
    buckets, starts = np.concatenate([x for x, _ in parts]).astype(np.int32), np.concatenate([x + k for (_, x), k in zip(parts, shifts, strict=False)])
    counts = np.diff(np.append(starts, len(buckets)))
    known = np.fromiter((net.number.get(w, 0) for w in vocabulary), np.int64, len(vocabulary))
    # One coordinate of the embeddings starts as the feature's evidence, the rest at random.
    holds, bucket_holds = np.zeros((2, len(vocabulary))), np.zeros((2, CHAR_BUCKETS))
    for x, y in zip(numbers, label, strict=True):
        own = np.unique(x)
        holds[int(1 - y), own] += 1
        bucket_holds[int(1 - y), np.unique(np.concatenate([buckets[starts[w] : starts[w] + counts[w]] for w in own]))] += 1
    n_toxic = int(label.sum())
    net.p["words"][:, 0] = 0
    net.p["words"][known, 0] = evidence(holds, n_toxic, len(label) - n_toxic)
    net.p["words"][0, 0] = 0
    net.p["chars"][:, 0] = evidence(bucket_holds, n_toxic, len(label) - n_toxic)
    spans = [(k, s) for k, x in enumerate(numbers) for s in windows_of(len(x))]
    owner, none = np.array([k for k, _ in spans]), len(vocabulary)
    all_at = np.full((len(spans), WINDOW), none, np.int32)
    for row, (k, s) in zip(all_at, spans, strict=True):
        row[: len(numbers[k][s : s + WINDOW])] = numbers[k][s : s + WINDOW]
    balance = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean())).astype(np.float32)
    rng, moments, step = np.random.default_rng(seed), {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}, 0
    epochs = max(5, round(steps / max(1, len(label) / batch)))
    for epoch in range(epochs):
        if epoch:
            gates = net.table(vocabulary)
            logits = np.concatenate([net.forward(gates, all_at[i : i + 2048]) for i in range(0, len(all_at), 2048)])
        else:
            lean = np.append(net.inputs(vocabulary)[:, [0, WORD_DIM]].sum(1), 0)
            logits = np.concatenate([lean[all_at[i : i + 2048]].max(1) for i in range(0, len(all_at), 2048)])
        order = np.lexsort((logits, owner))
        best = order[np.append(owner[order][1:] != owner[order][:-1], True)]  # the last, highest, of each text
        for chunk in np.array_split(rng.permutation(best), max(1, len(best) // batch)):
            used, at = np.unique(all_at[chunk], return_inverse=True)
            at = at.reshape(len(chunk), WINDOW)
            real = used[used < none]
            inner = np.concatenate([[0], np.cumsum(counts[real])[:-1]]).astype(np.int64)
            take = np.repeat(starts[real] - inner, counts[real]) + np.arange(counts[real].sum())
            dropped = rng.random(len(real)) < 0.5  # so that characters alone must do for many words
            x = np.concatenate([net.p["words"][np.where(dropped, 0, known[real])], np.add.reduceat(net.p["chars"][buckets[take]], inner, axis=0) / np.sqrt(counts[real])[:, None]], axis=1)
            grads, d_gates = net.gradients(net.gates(x), at, label[owner[chunk]], balance[owner[chunk]])
            d_gates = d_gates[: len(real)]
            d_x = np.zeros_like(x)
            for k, way in enumerate("fb"):
                part = d_gates[:, 3 * HIDDEN * k : 3 * HIDDEN * (k + 1)]
                grads[f"x{way}"], grads[f"b{way}"] = x.T @ part, part.sum(0)
                d_x += part @ net.p[f"x{way}"].T
            grads["words"], grads["chars"] = np.zeros_like(net.p["words"]), np.zeros_like(net.p["chars"])
            np.add.at(grads["words"], np.where(dropped, 0, known[real]), d_x[:, :WORD_DIM])
            by_bucket = np.argsort(buckets[take], kind="stable")
            hit, begin = np.unique(buckets[take][by_bucket], return_index=True)
            grads["chars"][hit] = np.add.reduceat((d_x[:, WORD_DIM:] / np.sqrt(counts[real])[:, None])[np.repeat(np.arange(len(real)), counts[real])[by_bucket]], begin, axis=0)
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g *= min(1.0, 5 / (norm + 1e-9))
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.p[k] -= (rate * (1 - 0.8 * epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def training_sample(docs: DataFrame, labels: DataFrame, per_label: int = 1000, max_bytes: int = 40_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(text, label) of at most per_label texts of each label, by a hash order of their ids, none above max_bytes, in one sorted partition.

    Never rows with crc32(id as text) mod 4 = 2, which are held out. Ids with both labels are left out, so are null ids,
    labels other than 0 and 1, null and empty texts. Repeated rows of one id teach once (any of its texts).
    """
    sizes = docs.select(id_col, F.octet_length(text_col).alias("bytes")).where(F.col("bytes").between(1, max_bytes)).select(id_col)
    marked = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2))
        .groupBy(id_col).agg(F.min(label_col).alias("label"), F.max(label_col).alias("high")).where("label = high").select(id_col, "label").join(sizes, id_col, "left_semi")
    )
    mixed = hash60(F.lit("toxicity"), id_col)
    chosen = marked.where("label = 1").orderBy(mixed, id_col).limit(per_label).unionByName(marked.where("label = 0").orderBy(mixed, id_col).limit(per_label))
    rows = docs.select(id_col, F.col(text_col).alias("text")).where(F.octet_length("text").between(1, max_bytes)).join(F.broadcast(chosen), id_col).dropDuplicates([id_col])  # 2 * per_label at most
    return rows.repartition(1).sortWithinPartitions(F.col(id_col).cast("string")).select("text", F.col("label").cast("int").alias("label"))


def training_rows(docs: DataFrame, labels: DataFrame, **how) -> list[tuple[str, int]]:
    """training_sample as a list."""
    return [(r["text"], r["label"]) for r in training_sample(docs, labels, **how).collect()]


def fit_in_task(sample: DataFrame) -> Network | None:
    """fit over a bounded sample in one task, so that only the parameters, about a megabyte, reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            labels += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, labels))], pa.binary())], names=["network"])

    found = sample.mapInArrow(run, "network binary").collect()
    return pickle.loads(found[0]["network"]) if found else None


def score(docs: DataFrame, network: Network | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs plus score_col (double, 0 to 1). Texts that are null or have no word score 0, and so does all without a network.

    A column of that name is replaced; the others pass through.
    """
    base = docs.drop(score_col)
    if network is None:
        return base.withColumn(score_col, F.lit(0.0))
    schema, place = StructType([*base.schema.fields, StructField(score_col, StructType.fromDDL("x double")["x"].dataType)]), base.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(network)
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scorer.scores(part.column(place).to_pylist()), pa.float64())], names=schema.names)

    return base.mapInArrow(run, schema)


def fit_and_score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", score_col: str = "score", **bounds: int) -> DataFrame:
    """Fit on a bounded sample of labelled rows, then score every row of docs.

    Every row comes out as often as it came in, also with a null id. Null texts and those without any letter score 0,
    and so does everything where the sample lacks one of the labels or is empty.
    """
    sample = training_sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, **bounds)
    return score(docs, fit_in_task(sample), text_col, score_col)
