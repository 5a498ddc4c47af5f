"""LM scoring with a log-frequency Bloom filter.

Counting. Texts are cut into slices, written as compressed word numbers. Each slice sends its distinct words and word
pairs, packed by hash segment, to the segment's task, which sums the counts over the corpus and answers each slice with
its words' exact counts; no vocabulary is gathered anywhere. Over `MOST_SLICES` slices, a segment's slices are dealt to
several tasks that sum and then answer a share of them each, with one more step of sums between, so that a word which
stands in every slice does not fill one task.

Filter. A segment enters its words, and the pairs seen `LEAST_PAIR` times or more, into its part of a Bloom filter: an
n-gram whose count has quantised logarithm q (base 2, from 1) is entered with each of 1..q. Parts have `BITS` bits an
entry, so the filter grows with the corpus; each part lives in its segment's task only and nothing is broadcast.

Scoring. A segment probes its part for each n-gram of a slice with 1, 2, ... until one misses, and answers with a byte,
the quantised logarithm found. A slice meets its answers in one task, which scores its texts. A word's probability after another is (c(v, w) + S p(w)) / (c(v) + S) with p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)), S the
prior's strength.

Words are known by a 64-bit hash (an error in V or a count is expected once in 10^9 distinct words).

Defined cases: null text is empty and is the end token alone; rows without doc_id are not learned from and not held
out; rows that repeat are rows of their own, scored alike; without training text all counts are 0 and every score is 0;
texts are read whole at any length, one longer than a slice is a slice of its own; ties in a count do not matter; an
empty table gives an empty result; columns other than key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vettle.llm import words as W
from vettle.llm.common import written
from vettle.llm.near_dedup import grouped

SLICE, SEGMENT = 6 << 20, 8_000_000
#: Slices of a segment that one task holds; segments that a task works on, one after the other.
MOST_SLICES, TOGETHER = 4096, 4
BITS, LEAST_PAIR, STRENGTH = 12, 2, 100.0
END = np.uint64(0x5EED0FE0D0FE0D01)
STEP = np.uint64(0x9E3779B97F4A7C15)


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 10


def segment(h: np.ndarray, n: int) -> np.ndarray:
    """Ranges of the hash, so that sorted hashes are sorted by segment."""
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return W.mixed(W.mixed(v) * W.PLACES[0] + w * W.PLACES[1])


def classes(c: np.ndarray) -> np.ndarray:
    """Quantised logarithm of counts: 1 for 1, 2 for 2 and 3, 3 for 4 to 7, ..."""
    return np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))).astype(np.int64) + 1, 0)


#: The count that a class stands for.
MEANS = np.array([0.0, *((2.0 ** (q - 1) + 2.0**q - 1) / 2 for q in range(1, 64))])


def _word_and_mask(h: np.ndarray, j: np.ndarray | int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = W.mixed(h + np.asarray(j, dtype=np.uint64) * STEP)
    mask = np.zeros(len(h), dtype=np.uint64)
    for i in range(4):
        mask |= np.uint64(1) << ((g >> np.uint64(6 * i)) & np.uint64(63))
    return ((g >> np.uint64(32)) % words).astype(np.int64), mask


def build(h: np.ndarray, count: np.ndarray, least: np.ndarray, most_bytes: int | None = None) -> np.ndarray:
    """A segment's part of the filter; with `most_bytes`, one too large leaves out its lowest count classes."""
    q = np.where(count >= least, classes(count), 0)
    low = 1
    while most_bytes is not None and q.sum() * BITS > most_bytes * 8 and low <= q.max(initial=0):
        q = np.where(q <= low, 0, q)
        low += 1
    n = max(1, int(-(-q.sum() * BITS // 64)))
    bits = np.zeros(n, dtype=np.uint64)
    for j in range(1, int(q.max(initial=0)) + 1):
        x = h[q >= j]
        at, mask = _word_and_mask(x, j, np.full(len(x), n, dtype=np.uint64))
        np.bitwise_or.at(bits, at, mask)
    return bits


class Filter:
    """The parts side by side. `found` has the quantised logarithms of n-grams' counts, by repeated probes."""

    def __init__(self, parts: list[np.ndarray]):
        self.bits = np.concatenate(parts)
        self.size = np.array([len(p) for p in parts], dtype=np.uint64)
        self.begin = np.concatenate([[0], np.cumsum(self.size.astype(np.int64))])[:-1]

    def found(self, h: np.ndarray) -> np.ndarray:
        q, live, j = np.zeros(len(h), dtype=np.int64), np.arange(len(h)), 1
        seg = segment(h, len(self.size))
        while len(live) and j < len(MEANS):
            s = seg[live]
            at, mask = _word_and_mask(h[live], j, self.size[s])
            live = live[(self.bits[self.begin[s] + at] & mask) == mask]
            q[live] = j
            j += 1
        return q

    def counts(self, h: np.ndarray) -> np.ndarray:
        return MEANS[self.found(h)]


def ngrams(word_hash: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashes of the pairs of each text with its end tokens: one more than the text has words, text after text."""
    place = offsets + np.arange(len(offsets))
    token = np.full(place[-1], END, dtype=np.uint64)
    is_word = np.ones(place[-1], dtype=bool)
    is_word[place[1:] - 1] = False
    token[is_word] = word_hash
    before = np.roll(token, 1)
    before[place[:-1]] = END
    return pair(before, token)


def _pack(x: np.ndarray) -> bytes:
    """Unsigned numbers byte by byte, compressed where they are many."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()
    many = len(x) >= 512
    return len(x).to_bytes(4, "little") + bytes([many]) + (pa.compress(planes, codec="zstd", asbytes=True) if many else planes)


def _unpack(raw: bytes, type_: str) -> np.ndarray:
    n, width = int.from_bytes(raw[:4], "little"), np.dtype(type_).itemsize
    planes = pa.decompress(raw[5:], n * width, codec="zstd", asbytes=True) if raw[4] else raw[5:]
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(width, n).T).view(type_).ravel()


#: Rows of slices and of answers: ids are null but in kind 3.
SCHEMA = "slice long, segment int, kind int, a binary, b binary, c binary, d binary, ids array<{}>"
NAMES = ["slice", "segment", "kind", "a", "b", "c", "d", "ids"]


def _batch(rows: list[tuple], *ids: pa.Array) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([*(pa.array(list(x), t) for x, t in zip(zip(*rows), types)), *ids], names=NAMES[: 7 + len(ids)])


def sliced(docs: DataFrame, kind: str) -> DataFrame:
    """Slices of texts, written: kind 3 (a: words of each text, b: 1 where it's learned from, 2 where held out, c: the words' numbers, d: the hash of each number). `docs`: doc_id, text, train, out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        nth = TaskContext.get().partitionId() << 32
        for b in W.slices(batches, most=SLICE):
            nth += 1
            offsets, vocabulary, index = W.split(b.column("text"))
            # the most frequent words have the least numbers
            often = np.argsort(-np.bincount(index, minlength=len(vocabulary)), kind="stable")
            number = np.empty(len(often), dtype="<u4")
            number[often] = np.arange(len(often))
            train, out = (b.column(c).to_numpy(zero_copy_only=False).astype("u1") for c in ("train", "out"))
            row = (nth, 0, 3, _pack(np.diff(offsets).astype("<u8")), _pack(train + 2 * out), _pack(number[index]), W.hashes(vocabulary)[often].tobytes())
            yield _batch([row], pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column("doc_id")))

    return written(docs.mapInArrow(run, SCHEMA.format(kind)), "slices")


def _texts(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, flags, word numbers, hashes) of a slice."""
    offsets = np.concatenate([[0], np.cumsum(_unpack(row["a"], "<u8").astype(np.int64))])
    return offsets, _unpack(row["b"], "u1"), _unpack(row["c"], "<u4").astype(np.int64), np.frombuffer(row["d"], "<u8")


def asked(slices: DataFrame, segments: int) -> DataFrame:
    """(segment, kind, slice, a, b): a slice's words (kind 1) and pairs (2), by segment: differences of the sorted hashes, and counts in the texts that are learned from (0 for what only others have)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                offsets, flags, number, h = _texts(row)
                train = (flags & 1).astype(np.float64)
                pairs, where = np.unique(ngrams(h[number], offsets), return_inverse=True)
                order = np.argsort(h)
                words = np.bincount(number, weights=np.repeat(train, np.diff(offsets)), minlength=len(h))[order]
                sides = [(1, h[order], words), (2, pairs, np.bincount(where, weights=np.repeat(train, np.diff(offsets) + 1), minlength=len(pairs)))]
                rows = []
                for kind, x, n in sides:
                    cuts = np.searchsorted(segment(x, segments), np.arange(segments + 1))
                    for s in np.flatnonzero(np.diff(cuts)).tolist():
                        at = slice(cuts[s], cuts[s + 1])
                        rows.append((s, kind, row["slice"], _pack(np.diff(x[at], prepend=np.uint64(0))), _pack(n[at].astype("<u8"))))
                if rows:
                    yield _blobs(rows)

    return slices.select("slice", "a", "b", "c", "d").mapInArrow(run, BLOBS)


BLOBS = "segment int, kind int, slice long, a binary, b binary"


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), types)], names=["segment", "kind", "slice", "a", "b"])


def _summed(part: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray, list[int], list[np.ndarray]]:
    """(n-grams, counts, slices, each slice's places among the n-grams) of a kind in a segment's blobs."""
    mine = part.filter(pa.array(part["kind"].to_numpy() == kind))
    h = [np.cumsum(_unpack(x, "<u8"), dtype=np.uint64) for x in mine["a"].to_pylist()]
    n = [_unpack(x, "<u8").astype(np.float64) for x in mine["b"].to_pylist()]
    grams, inverse = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *h]), return_inverse=True)
    sums = np.bincount(inverse, weights=np.concatenate([np.zeros(0), *n]), minlength=len(grams)).astype(np.int64)
    return grams, sums, mine["slice"].to_pylist(), np.split(inverse, np.cumsum([len(x) for x in h])[:-1]) if h else []


def _totals(counts: np.ndarray) -> bytes:
    return f"{counts.sum()},{(counts > 0).sum()}".encode()


def tables(blobs: DataFrame, keys: list[str]) -> DataFrame:
    """Blobs of each group of `keys` (the segment first) summed to one of a kind; slice is null."""

    def run(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
            part = t.slice(s, e - s)
            seg, out = int(part["segment"][0].as_py()), []
            for kind in (1, 2):
                grams, sums, _, _ = _summed(part, kind)
                out.append((seg, kind, None, _pack(np.diff(grams, prepend=np.uint64(0))), _pack(sums.astype("<u8"))))
            yield _blobs(out)

    return grouped(blobs, keys, run, BLOBS)


def merged(blobs: DataFrame, segments: int, filter_bytes: int | None, kind: str, slices: int) -> DataFrame:
    """What the segments answer, written: kind 0 (a: tokens and distinct words), 1 (a: counts of a slice's words, b: their classes), 2 (b: classes of its pairs)."""
    salts = max(1, -(-slices // MOST_SLICES))

    def run(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
            part = t.slice(s, e - s)
            seg, own = int(part["segment"][0].as_py()), pa.array(part["slice"].is_null().to_numpy())
            sides = []
            for k in (1, 2):
                if salts == 1:
                    sides.append(_summed(part, k))
                else:  # the sums over all slices are there as a blob without a slice
                    grams, sums, _, _ = _summed(part.filter(own), k)
                    mine, _, of, places = _summed(part.filter(pc.invert(own)), k)
                    at = np.searchsorted(grams, mine)
                    sides.append((grams, sums, of, [at[x] for x in places]))
            (words, word_counts, word_of, word_places), (pairs, pair_counts, pair_of, pair_places) = sides
            least = np.concatenate([np.ones(len(words)), np.full(len(pairs), LEAST_PAIR)])
            both = np.concatenate([words, pairs])
            bits = build(both, np.concatenate([word_counts, pair_counts]), least, filter_bytes // segments if filter_bytes is not None else None)
            # the part alone: all these n-grams are of its segment
            found = Filter([bits]).found(both).astype("u1")
            first = salts == 1 or part["salt"][0].as_py() == 0
            out = [(0, seg, 0, _totals(word_counts), b"", b"", b"")] if first else []
            out += [(nth, seg, 1, _pack(word_counts[at].astype("<u8")), _pack(found[at]), b"", b"") for nth, at in zip(word_of, word_places)]
            out += [(nth, seg, 2, b"", _pack(found[len(words) + at]), b"", b"") for nth, at in zip(pair_of, pair_places)]
            if out:
                yield _batch(out)

    schema = SCHEMA.format(kind).rpartition(",")[0]
    if salts == 1:
        answers = grouped(blobs, ["segment"], run, schema, -(-segments // TOGETHER), F.floor(F.col("segment") / TOGETHER).cast("int"))
    else:
        dealt = written(blobs, "slice-blobs").withColumn("salt", F.pmod(F.xxhash64("slice"), F.lit(salts)).cast("int"))
        sums = written(tables(tables(dealt, ["segment", "salt"]), ["segment"]), "segment-sums")
        each = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        answers = grouped(dealt.unionByName(each), ["segment", "salt"], run, schema)
    return written(answers, "segments").withColumn("ids", F.lit(None).cast(f"array<{kind}>"))


def scores(slices: DataFrame, answers: DataFrame, tokens: int, distinct: int, ends: int, kind: str, strength: float) -> DataFrame:
    """(doc_id, held_out, words, sums, known, score) of each text, from the slices and the segments' answers."""

    def run(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
            part = t.slice(s, e - s).sort_by("segment")
            kinds = part["kind"].to_numpy()
            about = part.filter(pa.array(kinds == 3))
            offsets, flags, number, h = _texts({c: about[c][0].as_py() for c in "abcd"})
            # answers by segment stand in the order of the sorted hashes
            get = lambda k, name, type_: np.concatenate([np.zeros(0, type_), *(_unpack(x, type_) for x in part.filter(pa.array(kinds == k))[name].to_pylist())])  # noqa: B023, E731
            count, alone, order = np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=np.int64), np.argsort(h)
            count[order], alone[order] = get(1, "a", "<u8"), get(1, "b", "u1")
            row = np.repeat(np.arange(len(flags)), np.diff(offsets))
            sums = np.bincount(row, weights=np.log10(count + 0.1)[number], minlength=len(flags))
            known = np.bincount(row, weights=(count > 0)[number], minlength=len(flags)).astype(np.int64)
            _, where = np.unique(ngrams(h[number], offsets), return_inverse=True)
            place = offsets + np.arange(len(offsets))
            is_word = np.ones(place[-1], dtype=bool)
            is_word[place[1:] - 1] = False
            c = np.full(place[-1], float(ends))
            c[is_word] = MEANS[alone][number]
            cb = np.roll(c, 1)
            cb[place[:-1]] = ends
            c2 = np.minimum(MEANS[get(2, "b", "u1")][where], cb)
            p1 = (c + 0.1) / (tokens + 0.1 * (distinct + 1))
            score = np.add.reduceat(np.log10((c2 + strength * p1) / (cb + strength)), place[:-1])
            ids = about["ids"].combine_chunks().flatten()
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x) for x in (flags & 2 > 0, np.diff(offsets), sums, known, score))], names=["doc_id", "held_out", "words", "sums", "known", "score"])

    both = answers.filter("kind > 0").unionByName(slices)
    return grouped(both, ["slice"], run, f"doc_id {kind}, held_out boolean, words long, sums double, known long, score double")


def lm_scores(docs: DataFrame, text: str = "text", key: str = "doc_id", held_out: Column | None = None, filter_bytes: int | None = None, strength: float = STRENGTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learns from the rows that are not held out.

    The filter has all it needs unless `filter_bytes` bounds it.
    """
    kind = docs.schema[key].dataType.simpleString()
    out = F.coalesce(held_out if held_out is not None else remainder(F.col(key)) == 0, F.lit(False))
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (~out & F.col(key).isNotNull()).alias("train"), out.alias("out"))
    size, ends = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if("train")).first()
    segments = max(12, -(-size // SEGMENT))
    slices = sliced(rows, kind)
    answers = merged(asked(slices, segments), segments, filter_bytes, kind, slices.count())
    total = lambda i: F.coalesce(F.sum(F.split(F.col("a").cast("string"), ",")[i].cast("long")), F.lit(0))
    tokens, distinct = answers.filter("kind = 0").agg(total(0), total(1)).first()
    tokens, distinct = tokens + ends, distinct + (ends > 0)
    met = scores(slices, answers, tokens, distinct, ends, kind, strength)
    n = F.col("words") + 1
    return met.select(
        "doc_id",
        "held_out",
        n.alias("n_tokens"),
        (F.col("known") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("sums") + F.log10(F.lit(ends + 0.1)) - n * F.log10(F.lit(tokens + 0.1 * (distinct + 1)))).alias("base_score"),
        "score",
    )
