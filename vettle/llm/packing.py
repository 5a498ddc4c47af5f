"""Packing: concatenate and cut, by two-pass prefix sums over partition token totals.

Pass one tokenizes each text once and writes its ids with its partition and its place there. The partitions' totals are
prefix-summed, which gives every document its global offset without moving it. Pass two cuts the stream into windows of
`length` tokens and returns the pieces, the boundary records, without a shuffle. Only the last sequence is padded.

Ids are those of the library tokenizers for the vocabulary file. They are computed faster: a text is split at single
spaces, where the vocabulary's splitting rule always cuts, and only the distinct pieces of a slice are encoded, in one
call, by the same vocabulary's ranks. Texts with two white-space characters in a row are encoded whole, and texts with
characters outside ASCII and Latin letters, or with the special token's string, by the library tokenizers.

Defined cases: null text is empty and has its end token alone; texts are tokenized whole at any length, and a text of
more than one sequence has a piece in each; the special token's string in a text becomes its id, as the library has it;
repeated rows are packed as often as they stand there, rows that tie follow the table's order; an empty table gives an
empty result; columns other than key and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vettle.llm.common import sized_join, written
from vettle.llm.words import own, slices

LENGTH, END = 1024, 0
SPECIAL = "<|endoftext|>"
#: Characters for which both libraries split texts alike: ASCII and the letters of Latin-1.
PLAIN = "^[\x00-\x1b\x20-\x7eÀ-ÖØ-öø-ÿ]*$"
_CODERS: dict[tuple, Coder] = {}


class Coder:
    """Token ids of many texts at once."""

    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        import base64

        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._exact, self._file = None, vocabulary
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.opens = np.zeros(max(table.values()) + 1, dtype=bool)
        for piece, i in table.items():
            self.opens[i] = piece[:1] == b" "

    @property
    def exact(self):
        """The library tokenizer, made when a text needs it."""
        if self._exact is None:
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_file(self._file)
        return self._exact

    def whole(self, texts: list[str], plain: list[bool]) -> list[np.ndarray]:
        odd = iter([] if all(plain) else self.exact.encode_batch([t for t, p in zip(texts, plain) if not p], add_special_tokens=False))
        return [np.array(self.fast.encode_ordinary(t) if p else next(odd).ids, dtype=np.int64) for t, p in zip(texts, plain)]

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets)."""
        n = len(text)
        text = pc.fill_null(own(text).cast(pa.large_string()), "")
        plain = pc.and_(pc.match_substring_regex(text, PLAIN), pc.invert(pc.match_substring(text, SPECIAL)))
        quick = pc.and_(plain, pc.invert(pc.match_substring_regex(text, r"\s\s")))
        quick_np, plain_np = (x.to_numpy(zero_copy_only=False) for x in (quick, plain))
        at = np.flatnonzero(quick_np)
        parts = pc.split_pattern(text.filter(quick), " ")
        bounds = parts.offsets.to_numpy().astype(np.int64)
        values = parts.values
        # the first piece of each text has no space before it, the others do
        first = np.zeros(len(values), dtype=bool)
        first[bounds[:-1][np.diff(bounds) > 0]] = True
        rest = pc.dictionary_encode(values.filter(pa.array(~first)))
        heads = pc.dictionary_encode(values.filter(pa.array(first)))
        words = rest.dictionary.to_pylist()
        ids = np.array(self.fast.encode_ordinary(" " + " ".join(words)) if words else [], dtype=np.int64)
        starts = np.flatnonzero(self.opens[ids]) if len(ids) else np.zeros(0, dtype=np.int64)
        head_ids = [np.array(self.fast.encode_ordinary(w), dtype=np.int64) for w in heads.dictionary.to_pylist()]
        assert len(starts) == len(words)
        others = np.flatnonzero(~quick_np)
        whole = self.whole([text[int(i)].as_py() for i in others], [bool(plain_np[i]) for i in others])
        # one table of id runs: words, then heads, then whole texts
        runs = [ids, *head_ids, *whole]
        length = np.concatenate([np.diff(np.append(starts, len(ids))), np.array([len(x) for x in runs[1:]], dtype=np.int64)])
        table = np.concatenate(runs) if runs else ids
        begin = np.concatenate([[0], np.cumsum(length)])[:-1]
        run = np.empty(len(values), dtype=np.int64)
        run[~first] = rest.indices.to_numpy(zero_copy_only=False)
        run[first] = len(words) + heads.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # runs in the order of the texts
        count = np.ones(n, dtype=np.int64)
        count[at] = np.diff(bounds)
        place = np.concatenate([[0], np.cumsum(count)])
        order = np.empty(place[-1], dtype=np.int64)
        row = np.repeat(np.arange(n), count)
        order[quick_np[row]] = run
        order[place[others]] = len(words) + len(head_ids) + np.arange(len(others))
        sizes = length[order]
        ends = np.cumsum(sizes)
        out = table[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - begin[order], sizes)]
        upto = np.concatenate([[0], ends])
        return out, upto[place]


def coder(*files: str) -> Coder:
    if files not in _CODERS:
        _CODERS[files] = Coder(*files)
    return _CODERS[files]


def tokenized(docs: DataFrame, files: tuple[str, str, str], text: str = "text", key: str = "doc_id", end: int = END) -> DataFrame:
    """(part, start, doc_id, tokens, ids): each text's ids and end token as bytes, with its place in its partition; written."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in slices(batches):
            ids, offsets = coder(*files).encode(b.column("text"))
            data = np.insert(ids, offsets[1:], end).astype("<u4" if ids.max(initial=0) > 65535 else "<u2")
            offsets = offsets + np.arange(len(offsets))
            size = np.diff(offsets)
            width = data.itemsize
            raw = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((offsets * width).astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(size), part), pa.int64()), pa.array(at + offsets[:-1], pa.int64()), b.column("doc_id"), pa.array(size, pa.int64()), raw],
                names=["part", "start", "doc_id", "tokens", "ids"],
            )
            at += int(offsets[-1])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return written(rows.mapInArrow(run, f"part long, start long, doc_id {kind}, tokens long, ids binary"), "tokens")


def pack(docs: DataFrame, files: tuple[str, str, str], text: str = "text", key: str = "doc_id", length: int = LENGTH, end: int = END) -> DataFrame:
    """The pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = tokenized(docs, files, text, key, end)
    totals = rows.groupBy("part").agg(F.sum("tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = written(totals.select(F.col("part").alias("p"), F.coalesce(before, F.lit(0)).alias("base")), "token-bases")
    placed = sized_join(rows, bases, F.col("part") == F.col("p")).select("doc_id", "tokens", (F.col("base") + F.col("start")).alias("at"), "ids")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at, size = b.column("at").to_numpy(), b.column("tokens").to_numpy()
            pieces = (at + size - 1) // length - at // length + 1
            row = np.repeat(np.arange(b.num_rows), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = np.maximum((at[row] // length + nth) * length, at[row])
            stop = np.minimum((begin // length + 1) * length, at[row] + size[row])
            crc, have, wide = [], -1, b""
            for r, x, y in zip(row.tolist(), (begin - at[row]).tolist(), (stop - at[row]).tolist()):
                if r != have:
                    raw = b.column("ids")[r].as_py()
                    have, wide = r, memoryview(np.frombuffer(raw, "<u2" if len(raw) == 2 * size[r] else "<u4").astype("<u4").tobytes())
                crc.append(zlib.crc32(wide[4 * x : 4 * y]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (begin - at[row], stop - begin, crc, size[row], begin // length, begin % length))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return placed.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
