"""MinHash near-dedup with sequential Bayesian verification.

1. Each text gets its set of distinct five-word shingles, a signature of `BANDS * ROWS` minima of which one byte each is
   kept, and a key for each band. Texts with equal sets are one class; only its smallest doc_id goes on.
2. Classes that share a band key are candidates. Within a bucket, signatures are compared batch by batch: a pair is
   pruned as soon as the posterior probability that its similarity reaches the threshold falls under `MISS`.
   A bucket returns a spanning forest of the pairs that survive, never all pairs; its components are clusters.
3. Within a cluster pairs are verified on full shingle sets, by counting each text's shingles in all others at once,
   and again only a spanning forest of the true links is returned. Their components are the result.

A pair already joined by others is not compared. A bucket or cluster over the block size is cut into parts by hash, each
with a copy of the group's leader, its least id: rows that are joined to the leader within their part are done with one
another, and only the others, few in a group of true copies, are sent to all parts. So a group's rows are sent once,
and once more where it has others, unless so many are unlike the leader that these fill blocks of their own; no pair
that could join two components is lost, and no group is gathered into one task.

At the threshold of 0.85, banding (25 bands of 5 rows) misses a pair with probability 4e-7 and the pruning steps together
with under 1e-4, if no other link joins the two.

Defined cases: null or empty text, or one without words, has an empty set and is linked with nothing; a text with fewer
than five words has its whole sequence as one shingle; very long texts are worked on whole, a few at a time; rows that
share a doc_id are one node, linked with what any of them is linked with; a null doc_id is linked with nothing; an empty
table gives an empty result; columns other than key and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vettle.llm import words as W
from vettle.llm.common import written
from vettle.llm.graph import components

K, PERCENT, MISS = 5, 85, 1e-5
BANDS, ROWS, BATCH = 25, 5, 25
#: Rows of a part of a bucket; shingles of a part of a cluster, where each text counts for LEAST_WEIGHT at least.
BLOCK, BLOCK_SHINGLES, LEAST_WEIGHT = 512, 200_000, 100
_RNG = np.random.default_rng(20)
FACTORS = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
SHIFTS = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def least_matches(percent: int = PERCENT, miss: float = MISS, n: int = BANDS * ROWS, batch: int = BATCH) -> list[tuple[int, int]]:
    """(compared, matches): after so many compared bytes, a pair with fewer matches is pruned.

    Uniform prior on the similarity s; a byte matches with probability s + (1 - s) / 256.
    """
    s = np.linspace(0, 1, 4001)[1:-1]
    p = s + (1 - s) / 256
    out = []
    for c in range(batch, n + 1, batch):
        for m in range(c + 1):
            ll = m * np.log(p) + (c - m) * np.log1p(-p)
            post = np.exp(ll - ll.max())
            if post[s >= percent / 100].sum() / post.sum() >= miss:
                out.append((c, m))
                break
    return out


def minima(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each row of distinct shingles its signature of 32-bit minima."""
    out = np.full((len(offsets) - 1, len(FACTORS)), 2**32 - 1, dtype=np.uint32)
    some = np.flatnonzero(np.diff(offsets))
    begin = 0
    step = 8192
    while begin < len(some):  # rows of `step` shingles together; a longer row is folded in parts
        end = begin + 1
        while end < len(some) and offsets[some[end] + 1] - offsets[some[begin]] <= step:
            end += 1
        a, b = offsets[some[begin]], offsets[some[end - 1] + 1]
        if end == begin + 1:
            for lo in range(a, b, step):
                x = values[lo : min(lo + step, b)]
                out[some[begin]] = np.minimum(out[some[begin]], [((x * f + s) >> np.uint64(32)).min() for f, s in zip(FACTORS, SHIFTS)])
        else:
            x, cuts = values[a:b], offsets[some[begin:end]] - a
            for k in range(len(FACTORS)):
                out[some[begin:end], k] = np.minimum.reduceat((x * FACTORS[k] + SHIFTS[k]) >> np.uint64(32), cuts)
        begin = end
    return out


def shingle_sets(text: pa.Array, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    offsets, vocabulary, index = W.split(text)
    row, value = W.shingles(offsets, W.hashes(vocabulary)[index] if len(index) else np.zeros(0, dtype=np.uint64), k)
    return W.distinct(row, value, len(text))


def signatures(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, sig, bands) of each row, written."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.slices(batches):
            offsets, values = shingle_sets(b.column("text"))
            n = np.diff(offsets)
            sums = []
            for seed in (3, 5):
                total = np.concatenate([[np.uint64(0)], np.cumsum(W.mixed(values * np.uint64(2 * seed + 1) + np.uint64(seed)))])
                sums.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
            sig = minima(offsets, values)
            keys = np.zeros((len(n), BANDS), dtype=np.uint64)
            for j in range(ROWS):
                keys = W.mixed(keys + sig[:, j::ROWS].astype(np.uint64) * W.PLACES[j])
            keys = W.mixed(keys + np.arange(BANDS, dtype=np.uint64) * W.PLACES[9]).view(np.int64)
            raw = np.ascontiguousarray(sig.astype(np.uint8))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array(n, pa.int64()),
                    *(pa.array(x, pa.int64()) for x in sums),
                    pa.array([x.tobytes() for x in raw], pa.binary()),
                    pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * BANDS, pa.array(keys.ravel())),
                ],
                names=["doc_id", "n_shingles", "set_a", "set_b", "sig", "bands"],
            )

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return written(rows.mapInArrow(run, f"doc_id {kind}, n_shingles long, set_a long, set_b long, sig binary, bands array<long>"), "signatures")


def grouped(df: DataFrame, keys: list[str], run, schema: str, parts: int | None = None, part: Column | None = None) -> DataFrame:
    """`run(columns, starts)` over whole groups: partitions are dealt and sorted by the keys, batches are cut at groups.

    With `parts`, each of so many partitions gets the groups whose `part`, a number under it, is its own.

    Spares the cost of a Python call for each of many small groups; no more than one group and a batch are held.
    """

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy() for k in keys]
            new = np.zeros(b.num_rows, dtype=bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            new[0] = last is not None and last != tuple(c[0] for c in cols)
            last = tuple(c[-1] for c in cols)
            at = np.flatnonzero(new)
            if len(at) == 0:
                held.append(b)
                continue
            yield from emit([*held, b.slice(0, int(at[-1]))])
            held = [b.slice(int(at[-1]))]
        yield from emit(held)

    def emit(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks() if parts else None
        if t is None or not t.num_rows:
            return
        cols = [t[k].to_numpy() for k in keys]
        new = np.ones(t.num_rows, dtype=bool)
        new[1:] = False
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        yield from run(t, np.append(np.flatnonzero(new), t.num_rows))

    dealt = df.repartitionById(parts, part) if parts else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys).mapInArrow(partition, schema)


class Joined:
    """Components of n nodes while links are found; `links` is a spanning forest."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def apart(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of `others` that nothing joins to i so far."""
        return others[self.label[others] != self.label[i]]

    def join(self, i: int, hit: np.ndarray) -> None:
        groups, first = np.unique(self.label[hit], return_index=True)
        self.links += [(i, int(h)) for h in hit[first]]
        self.label[np.isin(self.label, groups)] = self.label[i]


def within(n: int, lead: int, alike: Callable) -> Joined:
    """Links among n rows, the leader's first. `alike(i, others)` tells which of `others` are linked with i."""
    out = Joined(n)
    order = np.concatenate([[lead], np.delete(np.arange(n), lead)])
    for k, i in enumerate(order[:-1].tolist()):
        rest = out.apart(i, order[k + 1 :])
        if len(rest):
            hit = rest[alike(i, rest)]
            if len(hit):
                out.join(i, hit)
    return out


def across(n: int, sent: np.ndarray, alike: Callable) -> Joined:
    """Links between the rows in `sent` and the rest of n rows."""
    out, rest = Joined(n), np.flatnonzero(~sent)
    for i in np.flatnonzero(sent).tolist():
        x = out.apart(i, rest)
        if len(x):
            hit = x[alike(i, x)]
            if len(hit):
                out.join(i, hit)
    return out


class Signatures:
    """Compares signatures batch by batch."""

    def __init__(self, percent: int, miss: float):
        self.limits = least_matches(percent, miss)

    def chunks(self, t: pa.Table, starts: np.ndarray) -> Iterator[tuple[int, int]]:
        self.sig = np.frombuffer(b"".join(t["payload"].to_pylist()), dtype=np.uint8).reshape(t.num_rows, -1)
        yield 0, len(starts) - 1

    def tested(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which of the pairs (x, y) survive."""
        live, match, done = np.arange(len(x)), np.zeros(len(x), dtype=np.int32), 0
        for c, m in self.limits:
            match[live] += (self.sig[x[live], done:c] == self.sig[y[live], done:c]).sum(1, dtype=np.int32)
            live, done = live[match[live] >= m], c
        return live

    def pairs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self.tested(x, y)

    def alike(self, start: int) -> Callable:
        def which(i: int, others: np.ndarray) -> np.ndarray:
            return self.tested(np.full(len(others), start + i), start + others)

        return which


class Texts:
    """Compares full shingle sets: percent * union <= 100 * intersection."""

    def __init__(self, percent: int, most: int = W.SLICE_BYTES):
        self.percent, self.most = percent, most

    def chunks(self, t: pa.Table, starts: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of whole groups with about `most` bytes of text, whose sets are made together."""
        size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(t["payload"]), 0).to_numpy())])
        a = 0
        while a < len(starts) - 1:
            b = a + 1
            while b < len(starts) - 1 and size[starts[b + 1]] - size[starts[a]] <= self.most:
                b += 1
            part = t["payload"].slice(int(starts[a]), int(starts[b] - starts[a]))
            self.begin = int(starts[a])
            self.offsets, values = shingle_sets(part.combine_chunks() if isinstance(part, pa.ChunkedArray) else part)
            self.size = np.diff(self.offsets)
            _, self.local = np.unique(values, return_inverse=True)
            self.mark = np.zeros(self.local.max(initial=0) + 1, dtype=np.uint8)
            yield a, b
            a = b

    def alike(self, start: int) -> Callable:
        return lambda i, others: self.linked(start - self.begin + i, start - self.begin + others)

    def linked(self, i: int, others: np.ndarray) -> np.ndarray:
        """Which of `others` are linked with i."""
        n, m = int(self.size[i]), self.size[others]
        near = np.flatnonzero((m > 0) & (100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)))
        if n == 0 or len(near) == 0:
            return near[:0]
        m, begin = m[near], self.offsets[others[near]]
        ends = np.cumsum(m)
        own = self.local[self.offsets[i] : self.offsets[i + 1]]
        self.mark[own] = 1
        both = np.add.reduceat(self.mark[self.local[np.arange(ends[-1]) + np.repeat(begin - (ends - m), m)]], ends - m, dtype=np.int64)
        self.mark[own] = 0
        return near[100 * both >= self.percent * (n + m - both)]

    def pairs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ok = [len(self.linked(a - self.begin, np.array([b - self.begin]))) > 0 for a, b in zip(x.tolist(), y.tolist())]
        return np.flatnonzero(np.array(ok, dtype=bool))


FOUND = "other boolean, g long, part int, a long, b long"


def _found(id_: np.ndarray, links: list[tuple[np.ndarray, np.ndarray]], others: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    """Links between places of `id_`, and ids not joined to the leader of their group and part."""
    none = [np.zeros(0, dtype=np.int64)]
    a = np.concatenate(none + [id_[x] for x, _ in links] + [x for *_, x in others])
    b = np.concatenate(none + [id_[y] for _, y in links] + [x for *_, x in others])
    n = sum(len(x) for x, _ in links)
    g = np.concatenate([np.zeros(n, dtype=np.int64), *(np.full(len(x), g) for g, _, x in others)])
    part = np.concatenate([np.zeros(n, dtype=np.int32), *(np.full(len(x), p, dtype=np.int32) for _, p, x in others)])
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(a)) >= n), pa.array(g, pa.int64()), pa.array(part, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["other", "g", "part", "a", "b"])


def linked(rows: DataFrame, weight: Column, most: int, payload: DataFrame, make: Callable, tag: str) -> DataFrame:
    """(a, b): spanning forests of the links in each group. `rows`: g (group), id; `payload`: id, payload; `make()`: Signatures or Texts."""
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"), F.sum(weight).alias("w"), F.min("id").alias("leader")).filter("n > 1")
    sizes = written(sizes.select(F.col("g").alias("group"), F.ceil(F.col("w") / most).cast("int").alias("parts"), "leader"), f"{tag}-sizes")
    part = F.pmod(F.xxhash64("id", F.lit("part")), "parts").cast("int")
    dealt = rows.join(sizes, F.col("g") == F.col("group")).select("g", "id", "parts", part.alias("part"), (F.col("id") == F.col("leader")).alias("lead"))
    more = sizes.filter("parts > 1").select(F.col("group").alias("g"), F.col("leader").alias("id"), "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))
    more = more.filter(F.col("p") != part).select("g", "id", "parts", F.col("p").alias("part"), F.lit(True).alias("lead"))

    def inside(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        c = make()
        id_, parts, lead = (t[x].to_numpy() for x in ("id", "parts", "lead"))
        links, others = [], []
        for ga, gb in c.chunks(t, starts):
            at = starts[ga : gb + 1]
            two = at[:-1][(np.diff(at) == 2) & (parts[at[:-1]] == 1)]
            if len(two):
                keep = two[c.pairs(two, two + 1)]
                links.append((keep, keep + 1))
            for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
                if e - s < 2 or (e - s == 2 and parts[s] == 1):
                    continue
                first = int(np.argmax(lead[s:e]))
                got = within(e - s, first, c.alike(s))
                if got.links:
                    x, y = np.array(got.links).T
                    links.append((s + x, s + y))
                if parts[s] > 1:
                    others.append((int(t["g"][s].as_py()), int(t["part"][s].as_py()), id_[s:e][got.label != got.label[first]]))
        yield _found(id_, links, others)

    found = written(grouped(dealt.unionByName(more).join(payload, "id"), ["g", "part"], inside, FOUND), tag)
    links = found.filter("not other").select("a", "b")
    alone = found.filter("other").select("g", F.col("part").alias("own"), F.col("a").alias("id"))
    if alone.isEmpty():
        return links
    # what is not joined to its leader meets the other parts of its group, a block of such rows at a time
    weighed = written(alone.join(rows.select("g", "id", weight.alias("w")), ["g", "id"]).withColumnRenamed("g", "group"), f"{tag}-others")
    blocks = weighed.groupBy("group").agg(F.ceil(F.sum("w") / most).cast("int").alias("blocks"))
    blocks = written(blocks.join(sizes.select("group", "parts"), "group"), f"{tag}-blocks")
    block = F.pmod(F.xxhash64("id", F.lit("block")), "blocks").cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    sent = weighed.join(blocks, "group").withColumn("block", block).withColumn("part", each("parts")).filter("part <> own").select(F.col("group").alias("g"), "id", "part", "block", F.lit(True).alias("sent"))
    stay = rows.select("g", "id").join(blocks, F.col("g") == F.col("group")).withColumn("part", part).withColumn("block", each("blocks")).select("g", "id", "part", "block", F.lit(False).alias("sent"))

    def between(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        c = make()
        id_, sent_ = t["id"].to_numpy(), t["sent"].to_numpy()
        links = []
        for ga, gb in c.chunks(t, starts):
            for s, e in zip(starts[ga:gb].tolist(), starts[ga + 1 : gb + 1].tolist()):
                got = across(e - s, sent_[s:e], c.alike(s))
                if got.links:
                    x, y = np.array(got.links).T
                    links.append((s + x, s + y))
        yield _found(id_, links, [])

    again = written(grouped(stay.unionByName(sent).join(payload, "id"), ["g", "part", "block"], between, FOUND), f"{tag}-again")
    return links.unionByName(again.select("a", "b"))


def near_components(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of `docs`, whose key is a long."""
    sigs = signatures(docs, text, key)
    some = sigs.filter("n_shingles > 0 and doc_id is not null")
    same = ["set_a", "set_b", "n_shingles"]
    classes = written(some.groupBy(*same).agg(F.min("doc_id").alias("id")), "classes")
    first = some.join(classes, same).filter("doc_id = id").dropDuplicates(["id", *same]).select("id", "sig", "bands")
    first = written(first, "class-signatures")
    bands = first.select(F.explode("bands").alias("g"), "id")
    survived = linked(bands, F.lit(1), BLOCK, first.select("id", F.col("sig").alias("payload")), lambda: Signatures(percent, miss), "buckets")
    clusters = written(components(survived, "clusters"), "clusters")
    weights = clusters.join(classes.groupBy("id").agg(F.max("n_shingles").alias("n")), "id").select(F.col("component").alias("g"), "id", "n")
    weights = written(weights, "cluster-rows")
    # equal sets may come from unequal texts, any of them will do; all texts move here once, what follows meets those of clusters only
    texts = written(docs.select(F.col(key).alias("id"), F.col(text).alias("payload")).join(weights.select("id"), "id", "left_semi"), "cluster-texts")
    links = linked(weights, F.greatest("n", F.lit(LEAST_WEIGHT)), BLOCK_SHINGLES, texts, lambda: Texts(percent), "links")
    comps = written(components(links, "links"), "links")
    out = sigs.join(classes, same, "left").join(comps.withColumnRenamed("id", "c"), F.col("id") == F.col("c"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id", "doc_id")).alias("component_id"))
