"""Language identification with error-correcting output codes.

Every language has a codeword of bits. One binary classifier per bit, a logistic regression on hashed
character n-grams, predicts its bit of a text; loss-weighted decoding then takes the language whose
codeword has the smallest weighted loss. A close second codeword marks the text as ambiguous.

The classifiers learn from a bounded sample, ``per_language`` different rows of each language (of the smallest
hashes of doc_id and text; doc_id is never an input of a prediction) and ``rows`` in all, dealt evenly to the
languages: the first of each, then the second of each. Prediction reads every whole text.

Results: a null text or one without a letter is ``und`` with score 0; without any labelled row every
text is. Texts are read in blocks of characters. Repeated rows are learnt once and give repeated results.
Of equally near codewords that of the first language by code point is taken, and the text is ambiguous.
Columns named lang_pred, score or ambiguous are replaced, other columns pass.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
BUCKETS = 4_096
PER_LANGUAGE = 300
ROWS = 8_000
PARTS = 64
STEPS = 300
AMBIGUOUS = 0.1
CHARS_PER_BLOCK = 1_000_000
EXHAUSTIVE_UP_TO = 6
RANDOM_BITS_PER_LANGUAGE = 3


def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str | None, letters: np.ndarray) -> np.ndarray:
    """Hashed counts of the one to three characters that end at each letter; other characters count as one blank."""
    counts = np.zeros(BUCKETS, np.int64)
    tail = np.zeros(2, np.uint32)
    for k in range(0, len(text or ""), CHARS_PER_BLOCK):
        codes = np.frombuffer(text[k : k + CHARS_PER_BLOCK].lower().encode("utf-32-le"), np.uint32)
        codes = np.concatenate([tail, np.where(letters[codes], codes, 0).astype(np.uint32)])
        tail = codes[-2:]
        c, b, a = codes[2:], codes[1:-1], codes[:-2]
        here = c != 0
        c, b, a = c[here], b[here], np.where(b == 0, 0, a)[here]
        one = c * np.uint32(0x9E3779B1)
        two = (one ^ (b + np.uint32(1))) * np.uint32(0x85EBCA6B)
        three = (two ^ (a + np.uint32(3))) * np.uint32(0xC2B2AE35)
        for h in (one, two, three):
            counts += np.bincount(h >> np.uint32(20), minlength=BUCKETS)
    return counts


def features(counts: np.ndarray) -> np.ndarray:
    """Square roots of shares: frequent n-grams don't drown the others, and the length of a text has no weight."""
    return np.sqrt(counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1)).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each of ``n`` languages, with large distances between rows."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= EXHAUSTIVE_UP_TO:  # every way to part the languages in two
        return np.array([[1, *(-1 if (k >> i) & 1 else 1 for i in range(n - 1))] for k in range(1, 2 ** (n - 1))]).T
    best = None
    for seed in range(200):
        bits = np.random.default_rng(seed).choice([-1, 1], (n, RANDOM_BITS_PER_LANGUAGE * n))
        bits = bits[:, np.abs(bits.sum(axis=0)) < n]
        apart = min(int((x != y).sum()) for x, y in itertools.combinations(bits, 2))
        if best is None or apart > best[0]:
            best = (apart, bits)
    return best[1]


@dataclass
class CodeModel:
    languages: list[str]
    words: np.ndarray  # codewords
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit, its share in the loss
    letters: np.ndarray

    @classmethod
    def fit(cls, labels: list[str], counts: np.ndarray) -> CodeModel:
        languages = sorted(set(labels))
        words = codewords(len(languages))
        number = np.array([languages.index(x) for x in labels], int)
        x, y = features(counts), words[number].astype(np.float32)
        rows = 1 / np.bincount(number, minlength=len(languages))[number][:, None] / max(len(languages), 1)
        w, b = np.zeros((BUCKETS, words.shape[1]), np.float32), np.zeros(words.shape[1], np.float32)
        speed_w, speed_b = np.zeros_like(w), np.zeros_like(b)
        for _ in range(STEPS if words.size else 0):
            slope = (-y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) * rows).astype(np.float32)
            speed_w = 0.9 * speed_w + x.T @ slope + 1e-4 * w
            speed_b = 0.9 * speed_b + slope.sum(axis=0)
            w, b = w - 4 * speed_w, b - 4 * speed_b
        right = ((y * (x @ w + b) > 0) * rows).sum(axis=0)
        trust = np.maximum(2 * right - 1, 0.01)
        return cls(languages, words, w, b, trust / trust.sum() if len(trust) else trust, letter_table())

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether a second codeword is about as near."""
        counts = ngram_counts(text, self.letters)
        if not counts.any() or not self.languages:
            return UNKNOWN, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        margins = features(counts) @ self.weights + self.bias
        loss = (np.logaddexp(0, -margins * self.words) * self.trust).sum(axis=1)
        near = np.exp(-len(self.trust) * (loss - loss.min()))
        near /= near.sum()
        order = np.argsort(-near, kind="stable")
        return self.languages[order[0]], float(near[order[0]]), bool(near[order[0]] - near[order[1]] < AMBIGUOUS)


def train(docs: DataFrame, labelled: Column, per_language: int = PER_LANGUAGE, rows: int = ROWS) -> CodeModel:
    """Fits the classifiers on at most ``per_language`` rows of each language, ``rows`` in all, of the ``labelled`` rows with a lang."""
    known = docs.where(labelled & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # Equal rows are one candidate, so a repeated row stays once.
    known = known.withColumn("h", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    ids = known.select("lang", "h").distinct().withColumn("part", F.pmod("h", F.lit(PARTS)))
    # First the candidates of each part of a language, so that the whole of a frequent language meets in no task.
    for group in (["lang", "part"], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*group).orderBy("h"))
        ids = ids.withColumn("place", place).where(F.col("place") <= per_language)
    chosen = ids.orderBy("place", "lang").limit(rows).select("lang", "h")
    sample = known.join(F.broadcast(chosen), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")
    letters = letter_table()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [ngram_counts(t.as_py(), letters) for t in batch.column("text")]
            places = pa.array([np.flatnonzero(c).astype("<u2").tobytes() for c in counts], pa.binary())
            values = pa.array([c[c > 0].astype("<u4").tobytes() for c in counts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), places, values], ["lang", "places", "counts"])

    found = sample.mapInArrow(task, "lang string, places binary, counts binary").collect()
    found.sort(key=lambda r: (r.lang, bytes(r.places), bytes(r.counts)))
    counts = np.zeros((len(found), BUCKETS), np.uint32)
    for row, r in zip(counts, found):
        row[np.frombuffer(r.places, "<u2")] = np.frombuffer(r.counts, "<u4")
    return CodeModel.fit([r.lang for r in found], counts)


def identify(docs: DataFrame, model: CodeModel) -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous. Columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    made = ("lang_pred", "score", "ambiguous")
    kept = [c for c in docs.columns if c not in made]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = CodeModel(**shared.value)
        for batch in batches:
            found = [own.predict(t.as_py()) for t in batch.column("text")]
            new = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*kept, *made])

    rows = docs.select(*(F.col(f"`{c}`") for c in kept))
    new = {"lang_pred": F.lit(""), "score": F.lit(0.0), "ambiguous": F.lit(False)}
    return rows.mapInArrow(task, rows.withColumns(new).schema)
