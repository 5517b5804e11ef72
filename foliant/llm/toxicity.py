"""Toxicity scores from a bidirectional GRU with attention pooling, in numpy.

Each word is read twice: as a row of a word table (words of the training sample; others are zero) and as the mean of its
hashed character trigrams. Two gated recurrent units run over a window of words in both directions, attention pools their
states, and a logistic unit scores the pool. A text's score is that of its most toxic window; windows overlap by half,
and all of them are scored.

Training: a sample of at most SAMPLE labelled rows of each class (those with the smallest hashes of their ids, texts of
at most SAMPLE_CHARS characters) goes to the driver. A toxic text labels only its strongest window, chosen first by word
log-odds and then, each epoch, by the model itself. A final scale and shift bring the best windows' logits to the
classes' true shares.

Defined cases: null text counts as empty; a text without words gets the model's score of an empty window; without
labelled rows of both classes every score is the share of toxic rows (0 without any); null ids and repeated rows are
scored and kept, and a null id is not held out; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import held, numbered, pick, release, slices

WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM, ATTEND = 8, 8, 8, 8
CHAR_ROWS = 1 << 13
SAMPLE, SAMPLE_CHARS, VOCABULARY = 1500, 40_000, 20_000
EPOCHS, STEPS, BATCH, RATE, SEED = 8, 350, 128, 0.01, 7  # STEPS: at least about so many when rows are few
MAX_WORDS = 250_000  # of a scorer's cache
_EDGES = ".,;:!?\"'()[]{}<>|#*%&$@~^_=+-/\\`"


def words_of(text: str | None) -> list[str]:
    """Lower-cased words without punctuation at their ends."""
    return [s for w in (text or "").lower().split() if (s := w.strip(_EDGES))]


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed trigram rows of all words, where each word's begin)."""
    raw = [b"\x02" + w.encode("utf-8", "replace") + b"\x03" for w in words]
    lengths = np.array([len(r) for r in raw])
    data = np.frombuffer(b"".join(raw) + b"\0\0", dtype=np.uint8).astype(np.uint32)
    code = (data[:-2] * np.uint32(65599) + data[1:-1]) * np.uint32(65599) + data[2:]
    rows = ((code * np.uint32(2654435761)) >> np.uint32(32 - 13)).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    inside = np.ones(len(rows), dtype=bool)
    inside[starts + lengths - 1] = False
    inside[starts + lengths - 2] = False
    return rows[inside], np.cumsum(lengths - 2) - (lengths - 2)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """The weights, forward and backward passes."""

    def __init__(self, vocabulary: dict[str, int], seed: int = SEED):
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.vocabulary = vocabulary
        self.scale, self.shift = 1.0, 0.0
        self.p = {
            "word": 0.3 * r.standard_normal((len(vocabulary) + 1, WORD_DIM)).astype(np.float32), "char": 0.3 * r.standard_normal((CHAR_ROWS, CHAR_DIM)).astype(np.float32),
            "wx": g(WORD_DIM + CHAR_DIM, 6 * HIDDEN), "bx": np.zeros(6 * HIDDEN, np.float32), "u0": g(HIDDEN, 3 * HIDDEN), "u1": g(HIDDEN, 3 * HIDDEN),
            "wa": g(2 * HIDDEN, ATTEND), "va": g(ATTEND), "wo": g(2 * HIDDEN), "bo": np.zeros(1, np.float32),
        }
        self.p["word"][0] = 0

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """(word inputs, word rows, trigrams) of distinct words."""
        rows = np.array([self.vocabulary.get(w, 0) for w in words], dtype=np.int64)
        tri, at = trigrams(words)
        counts = np.diff(np.append(at, len(tri)))[:, None]
        chars = np.add.reduceat(self.p["char"][tri], at, axis=0) / counts
        return np.concatenate([self.p["word"][rows], chars.astype(np.float32)], axis=1), rows, (tri, at)

    def project(self, words: list[str]) -> np.ndarray:
        return self.inputs(words)[0] @ self.p["wx"] + self.p["bx"] if words else np.zeros((0, 6 * HIDDEN), np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, u: np.ndarray, back: bool, keep: list | None) -> np.ndarray:
        n, t, h_ = x.shape[0], x.shape[1], HIDDEN
        h, out = np.zeros((n, h_), np.float32), np.empty((n, t, h_), np.float32)
        for k in range(t - 1, -1, -1) if back else range(t):
            a = h @ u
            zr = _sigmoid(x[:, k, : 2 * h_] + a[:, : 2 * h_])
            z, r, m = zr[:, :h_], zr[:, h_:], mask[:, k, None]
            c = np.tanh(x[:, k, 2 * h_ :] + r * a[:, 2 * h_ :])
            new = c + z * (h - c)
            if keep is not None:
                keep.append((k, h, z, r, c, a[:, 2 * h_ :]))
            h = np.where(m, new, h)
            out[:, k] = h
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """Logits of windows; x: (windows, words, 6 * HIDDEN) projected inputs."""
        keep0, keep1 = ([], []) if tape is not None else (None, None)
        h = np.concatenate([self._run(x[:, :, : 3 * HIDDEN], mask, self.p["u0"], False, keep0), self._run(x[:, :, 3 * HIDDEN :], mask, self.p["u1"], True, keep1)], axis=2)
        e = np.tanh(h @ self.p["wa"])
        s = np.where(mask, e @ self.p["va"], -1e9)
        w = np.exp(s - s.max(1, keepdims=True)) * mask
        w = w / np.maximum(w.sum(1, keepdims=True), 1e-9)
        pool = (w[:, :, None] * h).sum(1)
        if tape is not None:
            tape |= {"h": h, "e": e, "w": w, "pool": pool, "keep": (keep0, keep1), "mask": mask}
        return pool @ self.p["wo"] + self.p["bo"][0]

    def _back(self, dh: np.ndarray, keep: list, u: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h_ = HIDDEN
        dx, du, carry = np.zeros((*dh.shape[:2], 3 * h_), np.float32), np.zeros_like(u), np.zeros((len(dh), h_), np.float32)
        for k, h, z, r, c, un in reversed(keep):
            d = dh[:, k] + carry
            m = mask[:, k, None]
            live = np.where(m, d, 0)
            dc = live * (1 - z) * (1 - c * c)
            dz, dr = live * (h - c) * z * (1 - z), dc * un * r * (1 - r)
            pre = np.concatenate([dz, dr, dc * r], axis=1)
            dx[:, k] = np.concatenate([dz, dr, dc], axis=1)
            du += h.T @ pre
            carry = np.where(m, live * z, d) + pre @ u.T
        return dx, du

    def gradients(self, words: list[str], ids: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over windows of indices into distinct words."""
        inputs, rows, (tri, at) = self.inputs(words)
        projected = inputs @ self.p["wx"] + self.p["bx"]
        tape: dict = {}
        p = _sigmoid(self.forward(projected[ids], mask, tape))
        d = ((p - y) / len(y)).astype(np.float32)
        h, e, w = tape["h"], tape["e"], tape["w"]
        dpool = d[:, None] * self.p["wo"]
        dw = (dpool[:, None, :] * h).sum(2)
        ds = w * (dw - (w * dw).sum(1, keepdims=True))
        de = ds[:, :, None] * self.p["va"] * (1 - e * e)
        dh = w[:, :, None] * dpool[:, None, :] + de @ self.p["wa"].T
        g = {"wo": tape["pool"].T @ d, "bo": np.array([d.sum()]), "va": (ds[:, :, None] * e).sum((0, 1)), "wa": np.einsum("nth,nta->ha", h, de)}
        dx0, g["u0"] = self._back(dh[:, :, :HIDDEN], tape["keep"][0], self.p["u0"], mask)
        dx1, g["u1"] = self._back(dh[:, :, HIDDEN:], tape["keep"][1], self.p["u1"], mask)
        dproj = np.zeros_like(projected)
        np.add.at(dproj, ids[mask], np.concatenate([dx0, dx1], axis=2)[mask])
        g["wx"], g["bx"] = inputs.T @ dproj, dproj.sum(0)
        din = dproj @ self.p["wx"].T
        g["word"], g["char"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["char"])
        np.add.at(g["word"], rows, din[:, :WORD_DIM])
        g["word"][0] = 0
        counts = np.diff(np.append(at, len(tri)))
        np.add.at(g["char"], tri, np.repeat(din[:, WORD_DIM:] / counts[:, None], counts, axis=0))
        return g


def windows(n: int) -> np.ndarray:
    """Starts of all overlapping windows over n words; one empty or short window where there are few."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)


def _cut(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices, mask) of a text's windows."""
    at = windows(len(ids))[:, None] + np.arange(WINDOW)
    mask = at < len(ids)
    return np.where(mask, np.append(ids, 0)[np.minimum(at, len(ids))], 0), mask


class Scorer:
    """Scores texts; remembers the projected inputs of words it has seen, up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self.index: dict[str, int] = {}
        self.table = np.zeros((1, 6 * HIDDEN), np.float32)

    def _ids(self, texts: list[list[str]]) -> list[np.ndarray]:
        new = list(set().union(*texts).difference(self.index)) if texts else []
        if len(self.index) + len(new) > MAX_WORDS:
            self.index, new = {}, list(set().union(*texts))
        at = len(self.index)
        if at + len(new) > len(self.table):
            grown = np.empty((max(at + len(new), min(MAX_WORDS, 2 * len(self.table))), 6 * HIDDEN), np.float32)
            grown[:at] = self.table[:at]
            self.table = grown
        self.index.update(zip(new, range(at, at + len(new))))
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            self.table[at + k : at + k + len(part)] = self.model.project(part)
        get = self.index.__getitem__
        return [np.fromiter(map(get, t), dtype=np.int64, count=len(t)) for t in texts]

    def logits(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The logits of all windows of each text."""
        cuts = [_cut(i) for i in self._ids(texts)]
        table = self.table
        ids, mask = np.concatenate([c[0] for c in cuts]), np.concatenate([c[1] for c in cuts])
        flat = np.concatenate([self.model.forward(table[ids[k : k + 1024]], mask[k : k + 1024]) for k in range(0, len(ids), 1024)])
        return np.split(flat, np.cumsum([len(c[0]) for c in cuts])[:-1])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out, k = np.zeros(len(texts)), 0
        while k < len(texts):
            part, size = [], 0
            while k + len(part) < len(texts) and (not part or size < 100_000):
                part.append(words_of(texts[k + len(part)]))
                size += len(part[-1])
            out[k : k + len(part)] = [x.max() for x in self.logits(part)]
            k += len(part)
        return _sigmoid(self.model.scale * out + self.model.shift)


def train(texts: list[str | None], labels: list[int], shares: tuple[float, float] | None = None) -> Model:
    """A model from labelled texts. shares: how many rows of each class stand behind the sample."""
    batch = int(np.clip(len(texts) // 20, 8, BATCH))
    epochs = int(np.clip(STEPS * batch // max(1, len(texts)), EPOCHS, 10 * EPOCHS))
    one: dict[str, str] = {}  # a word is held once, however often it occurs
    split = [[one.setdefault(w, w) for w in words_of(t)] for t in texts]
    y = np.array(labels, dtype=int)
    seen = {c: Counter(w for t, k in zip(split, y) if k == c for w in set(t)) for c in (0, 1)}
    both = seen[0] + seen[1]
    vocabulary = {w: k + 1 for k, (w, n) in enumerate(sorted(both.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY]) if n >= 3}
    model = Model(vocabulary)
    n = [max(1, int((y == c).sum())) for c in (0, 1)]
    if not (y == 0).any() or not (y == 1).any():
        model.scale, share = 0.0, float((y == 1).mean()) if len(y) else 0.0
        model.shift = float(np.clip(np.log(max(share, 1e-13) / max(1 - share, 1e-13)), -30, 30))
        return model
    odds = {w: float(np.log((seen[1][w] + 0.5) / (n[1] + 1)) - np.log((seen[0][w] + 0.5) / (n[0] + 1))) for w in vocabulary}
    del one, seen, both
    release()  # the driver keeps what is not given back, beside its JVM
    r = np.random.default_rng(SEED)
    adam = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    step = 0
    best = [int(np.argmax([max((odds.get(w, 0.0) for w in t[a : a + WINDOW]), default=0.0) for a in windows(len(t))])) for t in split]
    for epoch in range(epochs):
        if epoch >= 2 and epoch % 2 == 0:
            scorer = Scorer(model)
            best = [int(x.argmax()) for k in range(0, len(split), 200) for x in scorer.logits(split[k : k + 200])]
        # a toxic text's strongest window; of a clean text the strongest and another one
        chosen = [(k, best[k]) for k in range(len(split))] + [(k, int(r.integers(len(windows(len(split[k])))))) for k in range(len(split)) if not y[k]]
        for at in np.array_split(r.permutation(len(chosen)), max(1, len(chosen) // batch)):
            parts = [split[k][STRIDE * w : STRIDE * w + WINDOW] for k, w in (chosen[i] for i in at)]
            words = sorted(set().union(*parts)) or ["-"]
            place = {w: i for i, w in enumerate(words)}
            ids, mask = np.zeros((len(parts), WINDOW), dtype=np.int64), np.zeros((len(parts), WINDOW), dtype=bool)
            for i, p in enumerate(parts):
                ids[i, : len(p)], mask[i, : len(p)] = [place[w] for w in p], True
            step += 1
            for k, g in model.gradients(words, ids, mask, y[[chosen[i][0] for i in at]]).items():
                m, v = adam[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                model.p[k] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    scorer = Scorer(model)
    top = np.array([x.max() for k in range(0, len(split), 200) for x in scorer.logits(split[k : k + 200])])
    weight = np.where(y == 1, (shares or n)[1] / n[1], (shares or n)[0] / n[0])
    weight = weight / weight.mean()
    scale, shift = 1.0, 0.0
    for _ in range(400):  # logistic regression on the strongest logit
        d = weight * (_sigmoid(scale * top + shift) - y)
        scale, shift = scale - 0.05 * float((d * top).mean() + 0.01 * (scale - 1)), shift - 0.2 * float(d.mean())
    model.scale, model.shift = max(0.05, scale), shift
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels training never sees."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Trains on a bounded sample of docs (doc_id, text) with labels (doc_id, toxic)."""
    docs, labels = pick(docs, "doc_id", "text"), pick(labels, "doc_id", "toxic")
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    some = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    picked = some[0].unionByName(some[1])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS).join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic").toPandas().sort_values("doc_id")  # at most 2 * sample rows
    try:
        return train(rows["text"].tolist(), rows["toxic"].tolist(), (float(counts.get(0, 0)), float(counts.get(1, 0))))
    finally:
        release()


def score(docs: DataFrame, model: Model, column: str = "__toxicity") -> DataFrame:
    """docs with one more column, the score of its text; docs must not have a column of that name."""
    import uuid

    key, names = uuid.uuid4().hex, docs.columns
    if column.lower() in (n.lower() for n in names):
        raise ValueError(f"there is a column {column}")
    inside, found = numbered(docs, "text")
    at = int(found[0][1:])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by VOCABULARY and CHAR_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(key, lambda: Scorer(sent.value))
        for b in slices(batches, at):
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scorer.scores(b.column(at).to_pylist()))], names=[*[f"c{k}" for k in range(len(names))], "s"])

    schema = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema)) + ", s double"
    return inside.mapInArrow(run, schema).toDF(*names, column)
