"""Substring dedup by sliding sentence spans.

A text is cut into pieces: sentences and lines. Sentences of more than twelve words, and neighbouring ones of under
`SHORT` characters together, are cut where a word's (or short sentence's) hash is the least within `SHORT` characters on
both sides, so that equal passages get equal pieces wherever they begin; a piece has `SHORT` characters at least. Where
no hash leads for `FAR` characters, as in text that repeats itself, cuts follow by length. From every piece on, the run of
`RUN` consecutive pieces, or of as many more as give `LEAST` characters, is hashed, so that passages of some twenty words
or less, which stock phrases and lists share, stay. Hashes are counted over the corpus and their first
place (least doc_id, then position) is kept; pieces covered by a run that is not its first place are removed. What
remains of a text is joined as it stood.

One pass writes the runs as (hash, text, place) rows; counts combine on the map side, so a passage that a third of all
texts hold is a row a task; places meet the repeated hashes by a shuffled join whose hot keys adaptive execution splits.

Texts are joined with what goes from them by document and hash, once; where that is few bytes, adaptive execution
broadcasts it and no text moves.

Defined cases: null text stays null, empty text empty; texts are cut whole at any length, in time in proportion; rows
that repeat doc_id and text are one document and are treated alike; a text with fewer than RUN pieces is one run of all
its pieces; ties go to the least doc_id, null first; an empty table gives an empty result; extra columns pass through,
whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vettle.llm import words as W
from vettle.llm.common import fresh, written

RUN, LEAST, WORDS = 3, 100, 12
SHORT, FAR = 20, 200
#: A run is known by its place times this and its pieces: more than a run can have, as LEAST characters bound it.
WIDEST = 256
SPACE = " \t\n\r\x0b\x0c"
#: Leading space, words that end no sentence (an end may have a quote or bracket or two after it) and no line, one more word.
SENTENCE = re.compile(
    r"[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++(?<![.!?…。！？؟।])(?<![.!?…。！？؟।][\"')\]}”’»」』）])(?<![.!?…。！？؟।][\"')\]}”’»」』）]{2})[\x20\x09\x0B-\x0D]++(?!\n))*[^\x20\x09-\x0D]++"
)
UNIT = re.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++")


def parted(units: list[str]) -> list[str]:
    """Units (words or short sentences) joined to pieces, cut at content-defined places."""
    bare = [u.strip(SPACE) for u in units]
    h = [xxhash.xxh64_intdigest(u) for u in bare]
    at, total = [], 0
    for u in bare:
        total += len(u) + 1
        at.append(total)
    n = len(units)
    leads = []
    for i in range(n):
        x, y = at[i], h[i]
        if not SHORT < x < total - SHORT:
            continue
        j = i - 1
        while j >= 0 and x - at[j] <= SHORT and h[j] > y:
            j -= 1
        if j >= 0 and x - at[j] <= SHORT:
            continue
        j = i + 1
        while j < n and at[j] - x <= SHORT and h[j] >= y:
            j += 1
        if j == n or at[j] - x > SHORT:
            leads.append(i)
    out, begin, last = [], 0, 0
    for end in [*leads, n - 1]:
        if at[end] - last > FAR:
            for i in range(begin, end):
                if at[i] - last > LEAST and at[end] - at[i] > SHORT:
                    out.append("".join(units[begin : i + 1]))
                    begin, last = i + 1, at[i]
        out.append("".join(units[begin : end + 1]))
        begin, last = end + 1, at[end]
    return out


class Piece:
    def __init__(self, text: str, end: int):
        self._text, self._end = text, end

    def group(self) -> str:
        return self._text

    def end(self) -> int:
        return self._end


class Pieces:
    """Cuts texts; used like a compiled pattern. Pieces side by side are the text without the space at its end."""

    def findall(self, text: str) -> list[str]:
        out: list[str] = []
        short: list[str] = []
        lead = ""

        def close() -> None:
            nonlocal lead
            if sum(len(x.strip(SPACE)) + 1 for x in short) > SHORT:
                out.extend(parted(short))
            elif out:
                out[-1] += "".join(short)
            else:
                lead = "".join(short)
            short.clear()

        for x in SENTENCE.findall(text):
            if len(x.strip(SPACE)) < SHORT:
                short.append(x)
                continue
            if short:
                close()
            units = UNIT.findall(x)
            out += parted(units) if len(units) > WORDS else [x]
            if lead:
                out[0], lead = lead + out[0], ""
        if short:
            close()
        return out or ([lead] if lead else [])

    def finditer(self, text: str) -> Iterator[Piece]:
        end = 0
        for x in self.findall(text):
            end += len(x)
            yield Piece(x, end)


PIECE = Pieces()


def run_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, pieces, hash) of every run in the texts: from each piece on, as many as give RUN pieces and LEAST characters."""
    count, size, hash_ = [], [], []
    for t in texts:
        pieces = [p.strip(" \t\n\r\x0b\x0c") for p in PIECE.findall(t)] if t else []
        count.append(len(pieces))
        size += map(len, pieces)
        hash_ += [xxhash.xxh64_intdigest(p) for p in pieces]
    n = np.array(count, dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(n)])
    upto = np.concatenate([[0], np.cumsum(np.array(size, dtype=np.int64))])
    start = np.arange(offsets[-1])
    row = np.repeat(np.arange(len(n)), n)
    stop = np.maximum(np.searchsorted(upto, upto[start] + LEAST), start + np.minimum(RUN, n[row]))
    fits = stop <= offsets[row + 1]
    start, row, width = start[fits], row[fits], (stop - start)[fits]
    spread, total = W.mixed(np.array(hash_, dtype=np.uint64)), width.astype(np.uint64) * W.PLACES[63]
    for j in range(int(width.max(initial=0))):
        on = j < width
        total[on] += spread[start[on] + j] * W.PLACES[j % 63]
    return row, start - offsets[row], width, W.mixed(total)


def without(text: str, drop: set[int]) -> str:
    """`text` without the pieces at the places in `drop`."""
    out, end = [], 0
    for i, m in enumerate(PIECE.finditer(text)):
        if i not in drop:
            out.append(m.group())
        end = m.end()
    return "".join(out) + text[end:]


def substring_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, dict[str, str]]:
    """`docs` with repeated spans removed from its text, and n_removed (pieces) and removed (their places) under names that clash with nothing."""
    kind = docs.schema[key].dataType.simpleString()
    name = fresh(docs, "hash", "i", "h", "removed", "n_removed")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.slices(batches):
            row, place, width, value = run_hashes(b.column("text").to_pylist())
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("h").take(take), pa.array(place * WIDEST + width, pa.int64()), pa.array(value.view(np.int64))], names=["doc_id", "h", "place", "run"])

    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    found = written(rows.mapInArrow(runs, f"doc_id {kind}, h long, place long, run long"), "runs")
    where = F.struct("doc_id", "h", "place")
    repeated = found.groupBy("run").agg(F.min(where).alias("first"), F.max(where).alias("last")).filter("first <> last").select("run", "first")
    repeated = written(repeated, "repeated-runs")  # a plain side, so that adaptive execution can split a hot run's rows
    later = found.join(repeated, "run").filter(where != F.col("first"))
    gone = later.groupBy(F.col("doc_id").alias(name["i"]), F.col("h").alias(name["h"])).agg(F.array_sort(F.collect_set("place")).alias(name["removed"]))
    met = docs.withColumn(name["hash"], F.xxhash64(text)).join(gone, F.col(key).eqNullSafe(F.col(name["i"])) & (F.col(name["hash"]) == F.col(name["h"])), "left").drop(name["i"], name["h"], name["hash"])
    fields = [f for f in met.schema.fields if f.name != name["removed"]]
    schema = T.StructType([*fields, T.StructField(name["n_removed"], T.LongType()), T.StructField(name["removed"], T.ArrayType(T.IntegerType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text)
            texts, places = b.column(at).to_pylist(), [sorted({p // WIDEST + j for p in x for j in range(p % WIDEST)}) if x else [] for x in b.column(name["removed"]).to_pylist()]
            new, gone_ = [], []
            for t, p in zip(texts, places):
                drop = set(p)
                if drop:
                    n = sum(1 for _ in PIECE.finditer(t))
                    drop = {x for x in drop if x < n}
                    t = without(t, drop)
                new.append(t)
                gone_.append(sorted(drop))
            cols = {f.name: b.column(f.name) for f in fields} | {text: pa.array(new, b.column(at).type)}
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array([len(x) for x in gone_], pa.int64()), pa.array(gone_, pa.list_(pa.int32()))], names=[*cols, name["n_removed"], name["removed"]])

    return met.mapInArrow(cut, schema), name
