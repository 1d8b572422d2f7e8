"""Quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded by the make-up of its bytes and words, gated
attention weighs the passages, and a logistic unit scores the weighted sum. Attention weights,
encoder and unit are learned together from document labels alone.

Only the fit is bounded: at most ``SAMPLE`` labelled documents, chosen by a hash of doc_id, are
encoded on the executors and their passages are brought to one place. Scoring covers whole texts of
every row. Defined results: null and empty texts are one empty passage and get a score like any
other; labels of rows that are held out, null or contradictory are never used; without any usable
label every score is 0.5; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skimdex.llm.common import session

#: bytes of a passage
PASSAGE = 512
#: most labelled documents of a fit, and most bytes of a text that may take part in it
SAMPLE, SAMPLE_BYTES = 6000, 1_000_000
HIDDEN, ATTENTION, EPOCHS, RATE, DECAY = 16, 8, 250, 0.02, 1e-4
THRESHOLD = 0.3
#: bytes handled at once
CHUNK = 1 << 21
CLASSES = ["lower", "upper", "digit", "space", "break", "high", "stop", "exclaim", "bar", "sign", "other"]


def _byte_classes() -> np.ndarray:
    table = np.full(256, CLASSES.index("other"), np.uint8)
    for name, members in {
        "lower": bytes(range(97, 123)), "upper": bytes(range(65, 91)), "digit": bytes(range(48, 58)), "space": b" \t\r\x0b\x0c",
        "break": b"\n", "high": bytes(range(128, 256)), "stop": b".,;:?'\"()-", "exclaim": b"!", "bar": b"|", "sign": b"*#$%&@^~<>=+_/\\{}[]",
    }.items():
        table[list(members)] = CLASSES.index(name)
    return table


TABLE = _byte_classes()
N_FEATURES = len(CLASSES) + 6


def encode(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the number of passages, of texts at ``data[bounds[i]:bounds[i+1]]``."""
    sizes = np.diff(bounds)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    first = np.concatenate([[0], np.cumsum(counts)])
    within = np.arange(first[-1]) - np.repeat(first[:-1], counts)
    begins = np.repeat(bounds[:-1], counts) + within * PASSAGE
    lengths = np.minimum(np.repeat(bounds[1:], counts) - begins, PASSAGE)
    out = np.zeros((len(begins), N_FEATURES), np.float32)
    full = lengths > 0
    if not full.any():
        return out, counts
    at, width = begins[full], lengths[full].astype(np.float32)
    stop = at[-1] + lengths[full][-1]
    lo = at[0]
    data, at = data[lo:stop], at - lo
    kinds = TABLE[data]
    rows = np.zeros((len(at), N_FEATURES), np.float32)
    for k in range(len(CLASSES)):
        rows[:, k] = np.add.reduceat(kinds == k, at, dtype=np.int32) / width
    blank = (kinds == CLASSES.index("space")) | (kinds == CLASSES.index("break"))
    head = ~blank
    head[1:] &= blank[:-1]
    head[at] |= ~blank[at]  # passages cut words
    starts = np.flatnonzero(head)
    if len(starts):
        sums = np.concatenate([[0], np.cumsum(data, dtype=np.int64)])
        tail = np.concatenate([starts[1:], [len(data)]])
        letters = np.concatenate([[0], np.cumsum(head | ~blank, dtype=np.int64)])
        long = letters[tail] - letters[starts]
        code = (sums[tail] - sums[starts]) * 4099 + long * 257 + data[starts]  # equal words have equal codes
        of = np.searchsorted(at, starts, side="right") - 1
        words = np.bincount(of, minlength=len(at)).astype(np.float32)
        some = np.maximum(words, 1)
        same = lambda gap: np.concatenate([np.zeros(min(gap, len(code)), bool), code[gap:] == code[:-gap]])
        upper = TABLE[data[starts]] == CLASSES.index("upper")
        second = TABLE[data[np.minimum(starts + 1, len(data) - 1)]] == CLASSES.index("upper")
        sign = TABLE[data[np.maximum(tail - 2, 0)]] == CLASSES.index("sign")
        base = len(CLASSES)
        rows[:, base] = words * 5 / width
        rows[:, base + 1] = np.bincount(of, weights=long, minlength=len(at)) / some / 10
        for j, flag in enumerate((same(1), same(2), upper & second, sign)):
            rows[:, base + 2 + j] = np.bincount(of, weights=flag, minlength=len(at)) / some
    out[full] = rows
    return out, counts


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, bounds) over the rows of a large-string array, some ``CHUNK`` bytes at a time."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
        end = min(end, len(texts))
        part = data[offsets[row] : offsets[end]]
        yield row, end, part, offsets[row : end + 1] - offsets[row]
        row = end


class Model:
    """Parameters of encoder, gated attention and output, with forward and backward passes."""

    NAMES = ("w", "b", "v", "u", "q", "c", "d")

    def __init__(self, mean, scale, **arrays):
        self.mean, self.scale = mean, scale
        self.p = arrays

    @classmethod
    def start(cls, x: np.ndarray, seed: int = 1) -> Model:
        r = np.random.default_rng(seed)
        f, h, a = x.shape[1], HIDDEN, ATTENTION
        one = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        return cls(x.mean(0), x.std(0) + 1e-3, w=one(f, h), b=np.zeros(h), v=one(h, a), u=one(h, a), q=one(a), c=one(h), d=np.zeros(1))

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = np.exp(np.clip((t * g) @ p["q"], -30, 30))
        bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
        a = e / np.add.reduceat(e, first[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return x, h, t, g, a, bag, z, s

    def scores(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.forward(x, np.concatenate([[0], np.cumsum(counts)]))[-1]

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> Model:
        first = np.concatenate([[0], np.cumsum(counts)])
        weight = np.ones(len(y))
        mom = {k: np.zeros_like(v) for k, v in self.p.items()}
        var = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, EPOCHS + 1):
            xs, h, t, g, a, bag, z, s = self.forward(x, first)
            p = self.p
            ds = (s - y) * weight / len(y)
            dz = ds[:, None] * p["c"]
            da = (dz[bag] * h).sum(1)
            de = a * (da - np.add.reduceat(a * da, first[:-1])[bag])
            dtg = de[:, None] * p["q"]
            dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
            dh = a[:, None] * dz[bag] + dt @ p["v"].T + dg @ p["u"].T
            dx = dh * (1 - h * h)
            grad = {"w": xs.T @ dx, "b": dx.sum(0), "v": h.T @ dt, "u": h.T @ dg, "q": (t * g).T @ de, "c": z.T @ ds, "d": np.array([ds.sum()])}
            for k, v in grad.items():
                v = v + DECAY * p[k]
                mom[k] = 0.9 * mom[k] + 0.1 * v
                var[k] = 0.99 * var[k] + 0.01 * v * v
                p[k] = p[k] - RATE * (mom[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.99**step)) + 1e-8)
        return self


def held_out_of(doc_id) -> F.Column:
    """Whether crc32 of doc_id as text leaves no remainder modulo five."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, bounds in _chunks(batch.column(0)):
            x, counts = encode(data, bounds)
            ends = np.concatenate([[0], np.cumsum(counts)])
            rows = [x[i:j].tobytes() for i, j in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1).slice(a, b - a)], ["x", "y"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on at most ``sample`` labelled rows that are not held out; None without usable labels."""
    session(docs)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("y"), F.max("quality").alias("y2")
    )
    known = known.where("y = y2").where(~held_out_of(F.col("doc_id")))
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rank = F.xxhash64(F.lit("sample"), "doc_id")
    # choose by slim rows first, so that only texts of the sample are moved
    short = texts.where(F.octet_length("text") <= SAMPLE_BYTES).select("doc_id")
    ids = short.join(known, "doc_id").orderBy(rank, "doc_id").limit(sample)
    chosen = texts.join(F.broadcast(ids), "doc_id").where(F.octet_length("text") <= SAMPLE_BYTES)
    rows = chosen.select("text", F.col("y").cast("double").alias("y")).mapInArrow(_encoded, "x binary, y double").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (zlib.crc32(bytes(r.x)), bytes(r.x), r.y))  # the same fit for any order of arrival
    bags = [np.frombuffer(r.x, np.float32).reshape(-1, N_FEATURES) for r in rows]
    x = np.concatenate(bags).astype(np.float64)
    return Model.start(x).fit(x, np.array([len(b) for b in bags]), np.array([r.y for r in rows]))


def _score(texts: pa.Array, model: Model | None) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    parts = [model.scores(*encode(data, bounds)) for _, _, data, bounds in _chunks(texts)]
    return np.concatenate(parts) if parts else np.zeros(0)


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _score(batch.column(1), model)
            cols = [batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` whose score reaches the threshold, all columns."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = _score(batch.column(batch.schema.get_field_index("text")), model) >= threshold
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))
