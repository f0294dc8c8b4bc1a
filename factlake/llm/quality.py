"""Operator 10: quality classifier by Bradley-Terry pairwise ranking.

Labelled documents give preference pairs (a good one over a bad one). A linear score is learned
by logistic loss on the pairs' feature differences. Features are hashed words and pairs of words,
hashed runs of three bytes, both as square roots of shares, so that the length of a text does not
matter, and a few measures of form. The cut between good and bad is the quantile of the labelled
scores that classifies them best; scores are then put on 0..1 so that this cut is 0.7.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm.hashing import _U, SPACE_SEPARATORS, _mix, hash_words, small_chunks
from factlake.llm.tables import map_rows, text_bytes

#: Labelled rows the ranking is learned from at most, the first by a hash of their id.
TRAINING_ROWS = 20_000
#: Preferred documents each bad document of these rows is paired with at most, drawn with a fixed seed.
PARTNERS = 40
#: Buckets of words and pairs of words, and of runs of three bytes.
WORD_BUCKETS, BYTE_BUCKETS = 512, 256
#: Bytes of text measured at once.
MEASURED_BYTES = 200_000
CUT = 0.7
HELD_OUT_OF, HELD_OUT = 4, 2

_UPPER = bytes(range(65, 91))
_LETTERS = bytes((*range(65, 91), *range(97, 123)))
_DIGITS = bytes(range(48, 58))
_PLAIN = bytes(b for b in range(256) if b >= 128 or chr(b).isalnum() or chr(b) in " \t\n\r.,;:'\"-()?")
FEATURES = ("symbols", "symbols_any", "upper", "shouting", "bars", "repeats", "vocabulary", "distinct", "top_word", "digits", "word_length", "same_lines")
SIZE = len(FEATURES) + WORD_BUCKETS + BYTE_BUCKETS


def features(data: bytes) -> list[float]:
    """Measures of one text, all 0..1 and high for what looks wrong; all 0 for an empty text."""
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(data)
    share = lambda chars: (size - len(data.translate(None, chars)))
    symbols = len(data.translate(None, _PLAIN)) / size
    letters = max(1, share(_LETTERS))
    distinct = len(set(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        min(1.0, 5 * symbols),
        min(1.0, symbols * size / n),
        share(_UPPER) / letters,
        min(1.0, data.count(b"!") / n),
        min(1.0, 2 * data.count(b"|") / n),
        sum(map(eq, words, words[1:])) / n,
        1 - math.log(1 + distinct) / math.log(1 + n),
        1 - distinct / n,
        max(Counter(words).values()) / n if n >= 20 else 0.0,
        min(1.0, 5 * share(_DIGITS) / size),
        min(1.0, abs(size / n - 6.5) / 20),
        1 - len(set(lines)) / len(lines),
    ]


def _rooted(n: np.ndarray) -> np.ndarray:
    return np.sqrt(n / np.maximum(1, n.sum(1, keepdims=True)))


def _byte_runs(text: bytes, block: int = 1 << 16) -> np.ndarray:
    """How many runs of three bytes fall in each bucket; a long text is counted in blocks."""
    out = np.zeros(BYTE_BUCKETS, np.int64)
    data = np.frombuffer(text, np.uint8)
    for k in range(0, len(data) - 2, block):
        d = data[k : k + block + 2].astype(np.uint32)
        mixed = d[:-2] * np.uint32(0x9E3779B1) + d[1:-1] * np.uint32(0x85EBCA77) + d[2:] * np.uint32(0xC2B2AE3D)
        out += np.bincount((mixed >> np.uint32(16)) % np.uint32(BYTE_BUCKETS), minlength=BYTE_BUCKETS)
    return out


def grams(docs: list[bytes]) -> np.ndarray:
    """A row for each text: roots of the shares of its hashed words and word pairs, then of its runs of three bytes."""
    words, counts = hash_words(docs, SPACE_SEPARATORS, lower=True)
    owner = np.repeat(np.arange(len(docs)), counts)
    with np.errstate(over="ignore"):
        pairs = _mix(words[:-1] * _U(3) + words[1:])
    inside = owner[:-1] == owner[1:]
    n = np.zeros(len(docs) * WORD_BUCKETS, np.int64)
    for of, hashes in ((owner, words), (owner[:-1][inside], pairs[inside])):
        n += np.bincount(of * WORD_BUCKETS + (hashes % _U(WORD_BUCKETS)).astype(np.int64), minlength=len(n))
    by_byte = np.array([_byte_runs(d) for d in docs]).reshape(-1, BYTE_BUCKETS)
    return np.concatenate((_rooted(n.reshape(-1, WORD_BUCKETS)), _rooted(by_byte)), 1)


def measures(docs: list[bytes]) -> np.ndarray:
    """All features of texts, a row each; all 0 for an empty text."""
    return np.concatenate((np.array([features(d) for d in docs], np.float64).reshape(-1, len(FEATURES)), grams(docs)), 1)


def _solve(product: Callable[[np.ndarray], np.ndarray], target: np.ndarray, steps: int = 50) -> np.ndarray:
    """Conjugate gradients."""
    out, rest = np.zeros_like(target), target.copy()
    direction, size = rest.copy(), rest @ rest
    least = 1e-8 * size
    for _ in range(steps):
        if size <= least:
            break
        image = product(direction)
        step = size / (direction @ image)
        out += step * direction
        rest -= step * image
        size, before = rest @ rest, size
        direction = rest + size / before * direction
    return out


def fit_ranking(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, seed: int = 7, partners: int = PARTNERS) -> tuple[np.ndarray, float]:
    """(weights, cut): Newton steps on the logistic loss of feature differences; then the best score quantile."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return np.zeros(x.shape[1]), 0.0
    rng = np.random.default_rng(seed)
    per = min(partners, len(good))
    # every good document is in a pair as well
    better = np.concatenate((rng.choice(good, (len(bad), per)).ravel(), good))
    worse = np.concatenate((np.repeat(bad, per), rng.choice(bad, len(good))))
    ahead = lambda v: (s := x @ v)[better] - s[worse]
    back = lambda c: (np.bincount(better, c, len(x)) - np.bincount(worse, c, len(x))).astype(x.dtype) @ x / len(better)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(ahead(w.astype(x.dtype)), -40, 40)))
        slope = p * (1 - p)
        step = _solve(lambda v, c=slope: back(c * ahead(v.astype(x.dtype))) + ridge * v, back(p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-3:
            break
    score = x @ w
    order = np.argsort(score, kind="stable")
    s, label = score[order], y[order]
    # quantile k: the k lowest are bad; right of the two classes, each class counting the same
    right = np.concatenate(([0], np.cumsum(label == 0))) / len(bad) + (len(good) - np.concatenate(([0], np.cumsum(label == 1)))) / len(good)
    edges = np.concatenate(([s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]))
    usable = np.concatenate(([True], s[1:] > s[:-1], [True]))
    best = np.flatnonzero(usable & (right >= right[usable].max() - 1e-9))
    return w, float(edges[best[len(best) // 2]])


def place(score: np.ndarray, cut: float) -> np.ndarray:
    """Scores on 0..1, rising, with ``cut`` at CUT."""
    return 1 / (1 + np.exp(-np.clip(score - cut + math.log(CUT / (1 - CUT)), -40, 40)))


def _measure(weights=None, cut: float = 0.0):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, docs in small_chunks(list(range(batch.num_rows)), batch.column(batch.num_columns - 1), MEASURED_BYTES, 64):
                x = measures(docs)
                if weights is None:
                    made = pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())
                else:
                    made = pa.array(place(x @ weights, cut))
                kept = batch.slice(at[0], len(at)).columns[:-1]
                yield pa.RecordBatch.from_arrays([*kept, made], [*batch.schema.names[:-1], "made"])

    return run


def held_out(key):
    return F.crc32(key.cast("string")) % HELD_OUT_OF == HELD_OUT


def learn(docs: DataFrame, labels: DataFrame, *, training_rows: int = TRAINING_ROWS, partners: int = PARTNERS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, float]:
    """(weights, cut) from labelled documents that are not held out: at most ``training_rows`` labels and ``partners`` pairs of a bad one."""
    chosen = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(~held_out(F.col("doc_id")))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(training_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    p = map_rows(rows, _measure(), "doc_id long, label int, made binary").drop("doc_id").toPandas()
    y = p["label"].to_numpy()
    x = np.frombuffer(b"".join(p.pop("made")), np.float16).reshape(-1, SIZE).astype(np.float32)
    return fit_ranking(x, y, partners=partners)


def score_quality(docs: DataFrame, labels: DataFrame, *, training_rows: int = TRAINING_ROWS, partners: int = PARTNERS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Only the text enters a score. Empty and null texts have all measures 0. Without labels of
    both classes nothing is learned: every score is 0.7 and every document is kept. Null ids pass
    through, with held_out false; ids and labels outside 0 and 1 or null are not learned from.
    Repeated rows each give a row, other columns are ignored, an empty table gives an empty result.
    """
    weights, cut = learn(docs, labels, training_rows=training_rows, partners=partners, id_col=id_col, text_col=text_col, label_col=label_col)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    scored = map_rows(source, _measure(weights, cut), "doc_id long, made double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("made").alias("score"), (F.col("made") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that ``score_quality`` predicts as good."""
    text_col = options.get("text_col", "text")
    weights, cut = learn(docs, labels, **options)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, docs in small_chunks(list(range(batch.num_rows)), batch.column(at).cast(pa.binary()), MEASURED_BYTES, 64):
                yield batch.slice(rows[0], len(rows)).filter(pa.array(place(measures(docs) @ weights, cut) >= CUT))

    return map_rows(docs, run, docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
