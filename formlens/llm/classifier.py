"""Quality classifier by attention over passages, fitted with numpy on a bounded sample.

A text is cut into passages of PASSAGE words, and each is encoded as shares and means of
its bytes and words. A gate gives each passage a weight that is learned from labels of
whole documents, and the weighted sum of the passages' hidden layers is scored.

Defined cases: null, empty and wordless text is one passage without words; repeated rows
are scored each; an empty table gives no rows; columns named as the added ones are
replaced. Training takes TRAIN_ROWS labelled documents at most, those with the least hash of
their id, with all their passages; where these are over TRAIN_ROWS * TRAIN_PASSAGES in all,
documents that don't fit in are left out whole. Scoring takes all passages. Without labels of both kinds the score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formlens.llm.arrow import chunks, flat_bytes, with_columns
from formlens.llm.common import documents, stored

PASSAGE = 64
TRAIN_ROWS = 6_000
#: Mean passages a row that training has room for.
TRAIN_PASSAGES = 64
HIDDEN, ATTENTION = 24, 12
EPOCHS, BATCH, RATE, DECAY = 30, 64, 0.01, 1e-4
CHUNK = 2 << 20
HASHED = 24
#: Kinds of bytes: other, space, line feed, lower, upper, digit, of other scripts, and marks one by one.
MARKS = ".,;:!?'\"()-#*$%&|<>@=/_"
KINDS = 7 + len(MARKS)
_KIND = np.zeros(256, np.int64)
_KIND[[9, 11, 12, 13, 32]] = 1
_KIND[10] = 2
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 3, 4, 5, 6
for _i, _c in enumerate(MARKS):
    _KIND[ord(_c)] = 7 + _i
#: Shares of bytes, and of hashed pairs of bytes; then words, mean and spread of their length, long and one-byte ones, distinct ones, words and windows found before in the text, and length of lines.
WIDTH = KINDS + HASHED + 9
_ODD = np.random.default_rng(3).integers(1 << 62, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)


def encoded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of all passages of some texts in a row, and the text that each belongs to."""
    n_texts, n = len(offsets) - 1, len(data)
    kind = _KIND[data]
    text_of = np.repeat(np.arange(n_texts), np.diff(offsets))
    is_word = (kind != 1) & (kind != 2)
    fresh = np.ones(n, bool)
    fresh[1:] = ~is_word[:-1]
    fresh[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(is_word & fresh)
    word_text = text_of[starts]
    words = np.bincount(word_text, minlength=n_texts)
    passages = np.maximum(1, -(-words // PASSAGE))
    first = np.concatenate([[0], np.cumsum(passages)])
    word_at = np.arange(len(starts)) - np.concatenate([[0], np.cumsum(words)])[word_text]
    word_passage = first[word_text] + word_at // PASSAGE
    total = int(first[-1])
    owner = np.repeat(np.arange(n_texts), passages)
    # bytes go to the passage of the last word that started before them
    number = np.cumsum(is_word & fresh) - 1
    byte_passage = np.where(number >= 0, word_passage[np.maximum(number, 0)] if len(starts) else 0, 0)
    byte_passage = np.maximum(byte_passage, first[text_of])
    size = np.bincount(byte_passage, minlength=total).astype(np.float64)
    kinds = np.bincount(byte_passage * KINDS + kind, minlength=total * KINDS).reshape(total, KINDS) / np.maximum(size, 1)[:, None]
    pairs = np.zeros((total, HASHED))
    if n > 1:
        code = ((data[:-1].astype(np.uint32) * 257 + data[1:]) * np.uint32(2654435761) >> np.uint32(16)) % HASHED
        pairs = np.bincount(byte_passage[1:] * HASHED + code, minlength=total * HASHED).reshape(total, HASHED) / np.maximum(size, 1)[:, None]
    count = np.bincount(word_passage, minlength=total).astype(np.float64)
    some = np.maximum(count, 1)
    rest = np.zeros((total, 9))
    rest[:, 0] = np.log1p(count)
    rest[:, 8] = np.log1p(size / (1 + kinds[:, 2] * size))
    if len(starts):
        length = np.add.reduceat(is_word.astype(np.int64), starts)
        mean = np.bincount(word_passage, length, total) / some
        rest[:, 1] = np.log1p(mean)
        rest[:, 2] = np.log1p(np.sqrt(np.maximum(0, np.bincount(word_passage, length.astype(float) ** 2, total) / some - mean**2)))
        rest[:, 3] = np.bincount(word_passage, length > 20, total) / some
        rest[:, 4] = np.bincount(word_passage, length == 1, total) / some
        powers = np.multiply.accumulate(np.full(n, _ODD[0], np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(is_word, data + np.uint64(1), np.uint64(0)) * powers)])
        inverse = np.multiply.accumulate(np.full(n, pow(int(_ODD[0]), -1, 1 << 64), np.uint64))
        name = (sums[np.append(starts[1:], n)] - sums[starts]) * inverse[starts]
        name = (name ^ (name >> np.uint64(31))) * _ODD[1]
        rest[:, 5] = np.bincount(word_passage, _seen(name * _ODD[2] + word_passage.astype(np.uint64) * _ODD[3]), total) / some
        rest[:, 6] = np.bincount(word_passage, _seen(name * _ODD[2] + word_text.astype(np.uint64) * _ODD[3]), total) / some
        if len(name) > 3:
            gram = name[:-3] * _ODD[4] + name[1:-2] * _ODD[5] + name[2:-1] * _ODD[6] + name[3:] * _ODD[7]
            rest[:, 7] = np.bincount(word_passage[:-3], _seen(gram + word_text[:-3].astype(np.uint64) * _ODD[3]), total) / some
    return np.hstack([kinds, pairs, rest]).astype(np.float32), owner


def _seen(keys: np.ndarray) -> np.ndarray:
    """Whether the key stood before."""
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return again


class Model:
    """Hidden layer, gated attention and score; parameters are numpy arrays."""

    def __init__(self, width: int = WIDTH, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.p = {"W": init(width, HIDDEN), "b": np.zeros(HIDDEN), "V": init(HIDDEN, ATTENTION), "U": init(HIDDEN, ATTENTION), "w": init(ATTENTION), "c": np.zeros(HIDDEN), "d": np.zeros(1)}
        self.trained = False

    def forward(self, x: np.ndarray, owner: np.ndarray, n: int) -> tuple:
        """Scores of n texts before the logistic function, and what the gradients need. owner is in order, and each text has a passage."""
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        first = np.searchsorted(owner, np.arange(n))
        e = np.exp(e - np.maximum.reduceat(e, first)[owner])
        a = e / np.add.reduceat(e, first)[owner]
        z = np.add.reduceat(a[:, None] * h, first)
        return z @ p["c"] + p["d"], (x, h, t, g, a, z)

    def score(self, x: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        if not self.trained:
            return np.full(n, 0.5)
        return 1 / (1 + np.exp(-np.clip(self.forward(x, owner, n)[0], -30, 30)))

    def gradients(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(y)
        s, (x, h, t, g, a, z) = self.forward(x, owner, n)
        ds = (1 / (1 + np.exp(-s)) - y) / n
        dz = ds[:, None] * p["c"]
        da = (dz[owner] * h).sum(1)
        of_text = np.add.reduceat(a * da, np.searchsorted(owner, np.arange(n)))
        de = a * (da - of_text[owner])
        dt, dg = de[:, None] * p["w"] * g * (1 - t**2), de[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz[owner] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h**2)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ ds, "d": ds.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray) -> None:
        """Adam over shuffled batches of documents."""
        self.trained = len(set(labels.tolist())) > 1
        if not self.trained:
            return
        every = np.vstack(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 1e-3
        rng, step = np.random.default_rng(7), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for _ in range(EPOCHS):
            order = rng.permutation(len(bags))
            for k in range(0, len(order), BATCH):
                some, step = order[k : k + BATCH], step + 1
                owner = np.repeat(np.arange(len(some)), [len(bags[i]) for i in some])
                for name, d in self.gradients(np.vstack([bags[i] for i in some]), owner, labels[some]).items():
                    d = d + DECAY * self.p[name]
                    m[name] = 0.9 * m[name] + 0.1 * d
                    v[name] = 0.999 * v[name] + 0.001 * d * d
                    self.p[name] = self.p[name] - RATE * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def fitting(sizes: list[tuple[int, int]], most: int) -> list[int]:
    """The ids of (id, size), in order, that together have a size of most at most; what doesn't fit in is passed over."""
    out = []
    for key, n in sizes:
        if n <= most:
            out.append(key)
            most -= n
    return out


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, passages: int = TRAIN_PASSAGES) -> pa.Table:
    """(doc_id, quality, bag) of labelled documents that aren't held out, each with all its passages; rows * passages vectors at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK):
            x, owner = encoded(*flat_bytes(batch.column("text")))
            bags = [x[a:b] for a, b in zip(*(np.searchsorted(owner, np.arange(batch.num_rows), side) for side in ("left", "right")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([x.tobytes() for x in bags], pa.binary())], names=["doc_id", "quality", "bag"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    drawn = labels.filter(F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    order = [F.xxhash64(F.lit("mil"), "doc_id"), F.col("doc_id")]
    drawn = drawn.orderBy(*order).limit(rows)
    found = stored(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").mapInArrow(run, f"doc_id {kind}, quality int, bag binary"), "train-bags")
    sizes = found.groupBy("doc_id").agg(F.sum(F.octet_length("bag")).alias("n")).orderBy(*order).toArrow()
    taken = fitting(list(zip(sizes["doc_id"].to_pylist(), sizes["n"].to_pylist(), strict=True)), rows * passages * WIDTH * 4)
    whole = found if len(taken) == sizes.num_rows else found.join(F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in taken], f"doc_id {kind}")), "doc_id", "left_semi")
    return whole.toArrow().sort_by("doc_id")


def trained(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model of a sample of the labelled documents that aren't held out."""
    found = sample(docs, labels, rows)
    model = Model()
    model.fit([np.frombuffer(x.as_py(), np.float32).reshape(-1, WIDTH) for x in found["bag"]], found["quality"].to_numpy().astype(np.float64))
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score and predicted, which come from text alone."""
    docs = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK):
            x, owner = encoded(*flat_bytes(batch.column("text")))
            score = model.score(x, owner, batch.num_rows)
            yield with_columns(batch, {"score": pa.array(score, pa.float64()), "predicted": pa.array((score >= 0.5).astype(np.int32))})

    from pyspark.sql.types import StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *StructType.fromDDL("score double, predicted int").fields]))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
