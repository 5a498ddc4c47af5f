"""Language ID by error-correcting output codes.

Each language has a codeword. For each bit a logistic classifier over hashed byte n-grams (one to three bytes,
lower-cased text, relative frequencies of the whole text) gives a margin; the language whose codeword has the least
logistic loss over the margins is predicted, and its share of exp(-loss) is the score. A lead of the best over the
second under `margin` is flagged as ambiguous.

The classifiers are fitted on a bounded sample: each language's first documents by a hash, `per_language` of them at most
and no more than its share of `sample`, one at least. Every language of the labels takes part. Prediction reads every
whole text in one pass without a shuffle; a long text is worked on in parts of `CHUNK` bytes.

Codes: all non-trivial splits for up to seven languages, any two words of which differ in 2^(n-2) bits; else 8 *
ceil(log2 n) random splits, drawn so that any two words differ in a quarter of the bits or more.

Defined cases: null text, empty text or text without a letter is `und` with score 0; documents without doc_id or
language are not learned from; repeated rows are predicted alike; ties go to the first language by code point; without
any labelled row all is `und`; an empty table gives an empty result; extra columns pass through `identified`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vettle.llm.words import own, slices

BUCKETS, ORDERS = 4096, (1, 2, 3)
PER_LANGUAGE, SAMPLE = 400, 4000
CHUNK = 1 << 18
UNKNOWN = "und"


def codes(n: int, seed: int = 7) -> np.ndarray:
    """Codewords of n languages, entries 1 and -1."""
    if n <= 7:
        bits = max(1, 2 ** (n - 1) - 1)
        return np.array([[1 if (b + 1) >> (n - 1 - i) & 1 else -1 for b in range(bits)] if i else [-1] * bits for i in range(n)], dtype=np.float64)
    rng = np.random.default_rng(seed)
    bits = 8 * math.ceil(math.log2(n))
    while True:
        m = np.zeros((n, bits))
        for i in range(n):
            while True:
                word = rng.choice([-1.0, 1.0], size=bits)
                if (m[:i] @ word <= bits - 2 * (bits // 4)).all():  # they differ in bits // 4 places at least
                    break
            m[i] = word
        if (np.abs(m.sum(0)) < n).all():
            return m


def _bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased texts' bytes in a row, and offsets."""
    text = pc.utf8_lower(pc.fill_null(own(text).cast(pa.large_string()), ""))
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], dtype=np.uint8) if text.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _grams(data: np.ndarray, left: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the bucket of the n-gram that begins at each byte; BUCKETS where it passes the text's end."""
    wide = data.astype(np.uint32)
    for n in ORDERS:
        code = np.zeros(len(wide), dtype=np.uint32)
        for j in range(n):
            code[: len(wide) - j] = code[: len(wide) - j] * np.uint32(257) + wide[j:] + np.uint32(1)
        bucket = (code * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(32 - 12)
        yield np.where(left >= n, bucket, BUCKETS)


def _parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Parts of CHUNK bytes: bytes (with two more for the n-grams), bytes left in the text, the text of each, the part's length."""
    for a in range(0, len(data), CHUNK):
        b = min(a + CHUNK, len(data))
        row = np.searchsorted(offsets, np.arange(a, b), side="right") - 1
        left = offsets[row + 1] - np.arange(a, b)
        tail = min(len(data), b + max(ORDERS)) - b
        yield data[a : b + tail], np.concatenate([left, np.zeros(tail, dtype=left.dtype)]), row, b - a


def counts(text: pa.Array) -> np.ndarray:
    """n-gram frequencies, a row of BUCKETS for each text."""
    data, offsets = _bytes(text)
    out = np.zeros((len(offsets) - 1, BUCKETS + 1), dtype=np.float32)
    for part, left, row, n in _parts(data, offsets):
        for bucket in _grams(part, left):
            np.add.at(out, (row, bucket[:n].astype(np.int64)), 1)
    out = out[:, :BUCKETS]
    return out / np.maximum(out.sum(1, keepdims=True), 1)


def margins(text: pa.Array, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Each classifier's margin for each text."""
    data, offsets = _bytes(text)
    table = np.vstack([np.hstack([weights, np.ones((BUCKETS, 1))]), np.zeros((1, weights.shape[1] + 1))]).astype(np.float32)
    total = np.zeros((len(offsets) - 1, table.shape[1]))
    for part, left, row, n in _parts(data, offsets):
        begins = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        own = np.zeros((n, table.shape[1]), dtype=np.float32)
        for bucket in _grams(part, left):
            own += table[bucket[:n]]
        total[row[begins]] += np.add.reduceat(own, begins, axis=0, dtype=np.float64)
    return total[:, :-1] / np.maximum(total[:, -1:], 1) + bias


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 300, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Logistic classifiers, one for each column of y (1 and -1), by accelerated gradient on standardised features."""
    mean, std = x.mean(0), x.std(0) + 1e-4
    z = ((x - mean) / std / math.sqrt(x.shape[1])).astype(np.float32)
    w = np.zeros((x.shape[1], y.shape[1]), dtype=np.float32)
    b = np.zeros(y.shape[1], dtype=np.float32)
    v, vb = w.copy(), b.copy()
    step = 4.0
    for _ in range(rounds):
        g = -y / (1 + np.exp(np.clip(y * (z @ (w + 0.9 * v) + b), -30, 30))) / len(y)
        v, vb = 0.9 * v - step * (z.T @ g + l2 * w), 0.9 * vb - step * g.sum(0)
        w, b = w + v, b + vb
    scale = (w / std[:, None] / math.sqrt(x.shape[1])).astype(np.float64)
    return scale, b - mean @ scale


def remainder(doc_id: Column) -> Column:
    """crc32 of doc_id as text, mod 3; null for no doc_id."""
    return F.crc32(doc_id.cast("string")) % 3


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(languages, codes, weights, biases) from a sample of the documents whose remainder is not 1."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang is not null").filter(remainder(F.col("doc_id")) != 1)
    counted = rows.groupBy("lang").count().collect()  # a row for each language
    if not counted:
        return [], np.zeros((0, 1)), np.zeros((BUCKETS, 1)), np.zeros(1)
    each = max(1, min(per_language, sample // len(counted)))
    # about twice what is needed by hash, then the first of each language
    share = {r["lang"]: min(1.0, (2 * each + 20) / r["count"]) for r in counted}
    shares = F.broadcast(rows.sparkSession.createDataFrame(list(share.items()), "l string, share double"))
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1_000_000_007)) / 1_000_000_007
    drawn = rows.withColumn("draw", draw).join(shares, F.col("lang") == F.col("l")).filter(F.col("draw") < F.col("share")).select("doc_id", "lang", "draw", "text")
    drawn = drawn.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))).filter(F.col("nth") <= each)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=1 << 20):
            raw = [x.astype("<f4").tobytes() for x in counts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("draw"), pa.array(raw, pa.binary())], names=["lang", "draw", "x"])

    got = drawn.select("lang", "draw", "text").mapInArrow(features, "lang string, draw double, x binary").collect()
    got.sort(key=lambda r: (r["draw"], r["lang"], r["x"]))
    languages = sorted(share)
    m = codes(len(languages))
    if not got or len(languages) == 1:
        return languages, m, np.zeros((BUCKETS, m.shape[1])), np.zeros(m.shape[1])
    x = np.stack([np.frombuffer(r["x"], "<f4") for r in got])
    return languages, m, *fit(x, m[[languages.index(r["lang"]) for r in got]].astype(np.float32))


def decode(f: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest codeword, its share, its lead over the second) by logistic loss."""
    loss = np.stack([np.logaddexp(0, -f * word).sum(1) for word in m], axis=1)
    best = loss.argmin(1)
    share = np.exp(-(loss - loss.min(1, keepdims=True)))
    share /= share.sum(1, keepdims=True)
    ranked = np.sort(loss, axis=1)
    lead = ranked[:, 1] - ranked[:, 0] if m.shape[0] > 1 else np.full(len(f), np.inf)
    return best, share[np.arange(len(f)), best], lead


def identified(docs: DataFrame, model: tuple, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous"), margin: float = 0.7) -> DataFrame:
    """`docs` with prediction, score and the flag under `names`, which must be new to it."""
    languages, m, weights, bias = model
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            letters = pc.match_substring_regex(pc.fill_null(b.column(text), ""), r"\p{L}").to_numpy(zero_copy_only=False)
            if not languages:
                letters = np.zeros(b.num_rows, dtype=bool)
                best, share, lead = np.zeros(b.num_rows, dtype=int), np.zeros(b.num_rows), np.zeros(b.num_rows)
            else:
                best, share, lead = decode(margins(b.column(text), weights, bias), m)
            lang = [languages[i] if ok else UNKNOWN for i, ok in zip(best, letters)]
            out = [pa.array(lang, pa.string()), pa.array(np.where(letters, share, 0.0)), pa.array(~letters | (lead < margin))]
            yield pa.RecordBatch.from_arrays([*b.columns, *out], names=[*b.schema.names, *names])

    return docs.mapInArrow(run, schema)
