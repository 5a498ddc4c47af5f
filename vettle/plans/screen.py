"""The screening plan: texts to ranked candidates, rejected ones, duplicates, failures and a summary.

Texts are dealt by file_ord once after dedup; lines, sections, blocks, skills and the gate are told document by document,
in a row for each. Only similarities need other documents; they come back by file_ord, a few numbers a document, and are
hashed there, so that no join sorts texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vettle.functions import text as T
from vettle.operators import dedup, enrich, parse, rank, scan, score, tfidf
from vettle.settings import Settings
from vettle.sources.tables import plain_unions, tasks, written

NO_HEADINGS = "No section headings recognised; using whole text as a single block"


@dataclass
class Parsed:
    docs: DataFrame
    sections: DataFrame
    blocks: DataFrame


def dealt(docs: DataFrame, rows: int | None = None) -> DataFrame:
    """`docs` dealt by file_ord to tasks of a bounded number of documents."""
    spark = plain_unions(docs.sparkSession)
    return docs.repartition(tasks(spark, docs.count() if rows is None else rows), "file_ord")


def parsed(docs: DataFrame) -> Parsed:
    """Structure of `docs` (file_ord, file, text, links), dealt by file_ord once."""
    docs = dealt(docs)
    told = parse.structure(docs)
    return Parsed(docs, parse.sections(told), parse.blocks(told))


def evidence_text(sections: Column) -> Column:
    """All sections of a document but education and certifications, in their order."""
    kept = F.filter(sections, lambda x: ~x["section"].isin("education", "certifications"))
    return F.array_join(F.transform(kept, lambda x: x["body"]), "\n")


def block_texts(blocks: Column) -> Column:
    """A document's scanned blocks as texts to compare."""
    return F.transform(blocks, lambda b: F.struct(b["block_idx"].alias("block_idx"), b["clean"].alias("text")))


def whole_text(text: Column) -> Column:
    """A document's evidence as a text to compare; no block has its number."""
    return F.array(F.struct(F.lit(-1).alias("block_idx"), text.alias("text")))


def similarities(told: DataFrame, texts: Column, names: tuple[str, ...], s: Settings) -> DataFrame:
    """(file_ord, block_idx, sim_<name> ...) of an array of texts (see `block_texts`) in each row of `told`, whose blocks are the corpus.

    `told` is read several times, so that it should be written.
    """
    prototypes = {"depth": s.depth_prototype, "thin": s.thin_prototype, "jd": s.job_description}
    fixed = told.sparkSession.createDataFrame([(t,) for t in prototypes.values()], "text string")
    corpus = told.select(F.explode("blocks.text").alias("text")).unionByName(fixed)
    frequencies = written(tfidf.document_frequencies(corpus, s.stop_words), "df")
    blocks, docs = told.agg(F.coalesce(F.sum(F.size("blocks")), F.lit(0)), F.count("*")).first()
    n = blocks + len(prototypes)
    # dealt, a task's sums are those of a bounded number of documents, and move no more
    dealt_texts = told.select("file_ord", texts.alias("x")).repartition(tasks(told.sparkSession, docs), "file_ord")
    rows = dealt_texts.select("file_ord", F.explode("x").alias("x")).select("file_ord", "x.*")
    return tfidf.cosines(rows, ["file_ord", "block_idx"], {k: prototypes[k] for k in names}, frequencies, n, s.stop_words)


def compared(scanned: DataFrame, s: Settings) -> DataFrame:
    """`scanned` (blocks, whole, ai, ...) with scored AI blocks and sim_jd; blocks and whole go.

    The similarities, a few numbers a document, are the side that is hashed: the documents' rows are moved but never sorted.
    """
    rows = similarities(scanned, F.concat(block_texts(F.col("blocks")), whole_text(F.col("whole"))), ("depth", "thin", "jd"), s)
    of_block = F.when(F.col("block_idx") >= 0, F.struct("block_idx", "sim_depth", "sim_thin"))
    sims = rows.groupBy("file_ord").agg(F.collect_list(of_block).alias("sims"), F.max(F.when(F.col("block_idx") < 0, F.col("sim_jd"))).alias("sim_jd"))
    df = scanned.drop("blocks", "whole").join(sims.hint("shuffle_hash"), "file_ord", "left")
    return df.withColumn("ai", score.score_blocks(F.col("ai"), F.col("sims"), s)).drop("sims")


def scored(docs: DataFrame, s: Settings, answers: DataFrame | None = None) -> DataFrame:
    """Gate, breakdown, penalties and explanations of every document, eligible or not; `docs` are dealt (see `dealt`).

    answers: (file_ord, json), a row for each document that has one; then json is a column of the result.
    """
    df = scan.gate(scan.scan_documents(docs, "file", "text", "links"), s)
    unknown = F.forall("blocks", lambda b: b["section"] == "unknown")
    df = df.withColumns(
        {
            "email": T.email(F.col("text"), F.col("links")),
            "github_username": parse.handle(F.col("text"), F.col("links")),
            "warnings": F.when(unknown, F.array(F.lit(NO_HEADINGS))).otherwise(F.array().cast("array<string>")),
            "whole": evidence_text(F.col("sections")),
        }
    )
    df = df.withColumn("candidate_name", T.name_of(F.col("text"), F.col("email"), F.col("file")))
    df = df.withColumn("blocks", F.transform("blocks", lambda b: F.struct(*(b[c].alias(c) for c in ("block_idx", "text", "clean")))))
    df = compared(written(df.drop("sections", "links"), "scanned"), s)
    if answers is not None:
        df = df.join(answers.hint("shuffle_hash"), "file_ord", "left")
    return score.score_documents(score.best_of(df), s)


@dataclass
class Report:
    """The parts of a report; `eligible` are the rows of `ranked` without their rank, which is told when it is first asked for."""

    summary: DataFrame
    eligible: DataFrame
    rejected: DataFrame
    failed: DataFrame
    duplicates: DataFrame

    @cached_property
    def ranked(self) -> DataFrame:
        return rank.ranked(self.eligible)

    def sections(self) -> dict[str, DataFrame]:
        return {"summary": self.summary, "ranked_candidates": self.ranked, "rejected_candidates": self.rejected, "failed_files": self.failed, "duplicate_files": self.duplicates}


def screen(raw: DataFrame, s: Settings, lookups: DataFrame | None = None, repos: DataFrame | None = None, judgements: DataFrame | None = None, now: Column | None = None) -> Report:
    """The report on raw documents (file_ord, file, text, links, error).

    lookups, repos: see operators.enrich; without them enrichment is disabled. judgements: (file_ord, json), the answers
    of a model, or none.
    """
    good = raw.filter("error is null")
    failed = raw.filter("error is not null").select("file", F.col("error").alias("reason"))
    keys = written(good.select("file_ord", "file", T.fingerprint(F.col("text")).alias("h"), T.email(F.col("text"), F.col("links")).alias("e")), "keys")
    verdict = written(dedup.first_wins(keys), "dedup")
    names = keys.select(F.col("file_ord").alias("duplicate_of"), F.col("file").alias("of"))
    duplicates = verdict.filter("not kept").join(keys.select("file_ord", "file"), "file_ord").join(names, "duplicate_of").select("file", F.col("of").alias("duplicate_of"))
    kept = verdict.filter("kept").select("file_ord").hint("shuffle_hash")  # texts are never sorted
    docs = dealt(good, keys.count()).join(kept, "file_ord", "left_semi").select("file_ord", "file", "text", "links")
    answers = None if judgements is None else judgements.groupBy("file_ord").agg(F.first("json").alias("json"))
    df = written(scored(docs, s, answers), "scored")
    ok = df.filter("eligible")
    if lookups is not None and repos is not None and s.repositories.enabled:
        ok = enrich.enrich(ok, lookups, repos, F.current_timestamp() if now is None else now, s)
    else:
        ok = ok.withColumns({"github_status": F.lit("disabled"), "github": F.lit(0.0), "github_summary": F.lit("GitHub enrichment disabled")})
    if judgements is not None:
        ok = score.blend_judgement(ok.withColumn("judgement", enrich.judgement(F.col("json"), F.col("text"))), s).drop("judgement", "json")
    else:
        ok = ok.withColumn("llm_status", F.lit("disabled"))
    note = F.when(F.col("github_status") == "no_profile", "No GitHub profile in resume (no score, not penalised beyond 0 GitHub points)").when(
        ~F.col("github_status").isin("ok", "disabled"), F.concat(F.lit("GitHub enrichment unavailable ("), F.col("github_status"), F.lit(")"))
    )
    ok = ok.withColumns({"total_score": score.total(s), "concerns": F.slice(F.array_compact(F.concat("concerns", F.array(note))), 1, 7)}).drop("text", "hits")
    ok = written(ok, "eligible")
    no = df.filter("not eligible")
    rejected = no.select("file", "candidate_name", "email", "eligible", "reasons", "matched_skills", "jd_similarity", "warnings")
    counted = ok.agg(
        F.count("*").alias("eligible"),
        F.count_if((F.col("github_status") == "ok") & F.col("github_username").isNotNull()).alias("github_ok"),
        F.count_if(F.col("github_status").isin("error", "rate_limited", "not_found") & F.col("github_username").isNotNull()).alias("github_failed"),
        F.count_if(F.col("llm_status").startswith("ok")).alias("llm_ok"),
        F.count_if(F.col("llm_status") == "failed").alias("llm_failed"),
    )
    files = raw.agg(F.count("*").alias("total_files"), F.count_if(F.col("error").isNotNull()).alias("failed_unreadable"))
    twice = verdict.agg(F.count("*").alias("parsed_ok"), F.count_if(~F.col("kept")).alias("duplicates_skipped"))
    summary = files.crossJoin(twice).crossJoin(counted).crossJoin(no.agg(F.count("*").alias("rejected")))  # one row each
    return Report(summary, ok, rejected, failed, duplicates)
