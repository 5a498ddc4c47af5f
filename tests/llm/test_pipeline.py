"""The pipeline's stages: columns, decisions, and each stage against brute force on its own input."""

import re
import shutil
from collections import Counter

import corpus_pipeline as P
from compare import connect
from tokenizers import Tokenizer

from vettle.llm.oracles import ORACLES
from vettle.llm.queries import vocabulary

SMALL = "/root/testdata/sf0.001"


def sql_over(docs, folder, sql):
    """Rows of SQL whose documents are `docs`; the labels are those of the small tables."""
    shutil.rmtree(folder, ignore_errors=True)
    docs.write.parquet(f"{folder}/documents.parquet")
    shutil.copy(f"{SMALL}/labels.parquet", f"{folder}/labels.parquet")
    return connect(str(folder)).execute(sql).fetch_df()


def test_stages_on_the_small_table(spark, tmp_path):
    """Every stage on what the one before kept, against SQL or a scan of its own, to the last row."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    again = lambda df, at: (df.write.parquet(f"{tmp_path}/{at}"), spark.read.parquet(f"{tmp_path}/{at}"))[1]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    language = again(P.language_stage(spark, docs, SMALL), "language")
    assert ids(language) == sorted(r.doc_id for r in docs.collect() if re.search(r"[^\W\d_]", r.text or ""))
    exact = again(P.exact_stage(spark, language, SMALL), "exact")
    want = sql_over(language, tmp_path / "a", ORACLES["op10_exact_dedup"])
    assert ids(exact) == sorted(want[want.kept].doc_id)
    near = again(P.near_stage(spark, exact, SMALL), "near")
    assert "100 * i >= 85 *" in ORACLES["op8_near_dedup"]
    want = sql_over(exact, tmp_path / "b", ORACLES["op8_near_dedup"].replace("100 * i >= 85 *", "100 * i >= 80 *"))
    assert ids(near) == sorted(want[want.kept].doc_id) and len(ids(near)) < len(ids(exact)) < len(ids(docs))
    mixed = again(P.mixing_stage(spark, near, SMALL), "mixed")
    want = sql_over(near, tmp_path / "c", ORACLES["op7_mixing"])
    assert Counter(ids(mixed)) == Counter({int(r.doc_id): round(r.taken / r["size"]) for _, r in want.iterrows() if r.taken})
    k = Tokenizer.from_file(vocabulary()[0])
    tokens = {r.doc_id: k.encode(r.text, add_special_tokens=False).ids + [0] for r in mixed.collect()}
    count, placed = Counter(ids(mixed)), {}
    for r in P.packing_stage(spark, mixed, SMALL).collect():
        for j in range(r.length):
            assert placed.setdefault((r.sequence_id, r.offset + j), (r.doc_id, r.start + j)) == (r.doc_id, r.start + j)
    assert Counter(placed.values()) == Counter({(i, j): n for i, n in count.items() for j in range(len(tokens[i]))})
    total = sum(len(tokens[i]) * n for i, n in count.items())
    assert {s * 1024 + o for s, o in placed} == set(range(total))


def test_stages(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in P.STAGES] == ["language ID", "exact dedup", "near dedup", "mixing", "packing"]
    language = P.language_stage(spark, docs, odd_dir)
    kept = sorted((r.doc_id, r.text) for r in language.collect())
    assert language.columns == columns and kept == sorted((r.doc_id, r.text) for r in docs.collect() if re.search(r"[^\W\d_]", r.text or ""))
    exact = P.exact_stage(spark, language, odd_dir)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    texts = Counter(norm(r.text) for r in exact.collect())
    assert exact.columns == columns and set(texts.values()) == {1} and set(texts) == {norm(t) for _, t in kept}
    near = P.near_stage(spark, exact, odd_dir)
    assert near.columns == columns and {r.doc_id for r in exact.collect()} - {r.doc_id for r in near.collect()} == {7}
    mixed = P.mixing_stage(spark, near, odd_dir)
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in near.collect()}
    packed = P.packing_stage(spark, mixed, odd_dir)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in mixed.collect()}


def test_near_stage_threshold(spark, prose_of):
    """Of pairs with a similarity from 0.80 up to 0.85 one goes; those under 0.80 stay."""
    import random

    rng = random.Random(6)
    rows, gone = [], set()
    for i in range(30):
        words = [f"{w}{i}" for w in prose_of(rng, 100).replace(".", "").split()]
        other, n = list(words), 3 if i % 3 == 0 else 2  # 81 of 111 shingles (0.73) or 86 of 106 (0.81)
        for k in range(n):
            other[20 + 25 * k] = "changed"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        if n == 2:
            gone.add(2 * i + 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in P.near_stage(spark, docs, "").collect()}
    assert {i for i, _ in rows} - kept == gone


def test_run(spark, empty_dir):
    assert P.run(spark, "/root/testdata/sf0.001").count() > 0
    assert P.run(spark, empty_dir).count() == 0
