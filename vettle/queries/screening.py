"""Queries of the screening operators, over the synthetic résumés and the text tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vettle.functions import text as T
from vettle.operators import dedup, enrich, parse, rank, scan, score, service, tfidf
from vettle.plans import screen as plan
from vettle.queries import fixtures as X
from vettle.settings import Settings
from vettle.sources import files, sinks
from vettle.sources.tables import plain_unions, shared_dir, tasks, written

#: The queries' stop words, stated so that their SQL can use them too.
STOP = ("a", "about", "an", "and", "at", "by", "for", "from", "in", "into", "is", "it", "of", "on", "or", "that", "the", "to", "with")
SETTINGS = Settings(stop_words=STOP)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return plain_unions(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def made(spark: SparkSession, text: str, source: str, rows: DataFrame) -> DataFrame:
    """A fixture's SQL over one table's rows."""
    text = text.replace("varchar(10)", "string").replace("varchar(12)", "string").replace("{", "{{").replace("}", "}}")
    return spark.sql(text.replace(f"from {source}", "from {source}"), source=rows)


def sql(spark: SparkSession, sf_dir: str, text: str, source: str) -> DataFrame:
    """A fixture's SQL over one table."""
    return made(spark, text, source, table(spark, sf_dir, source))


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # keys are dealt before texts are made of them: a file that is small as keys would be the texts' only task
    keys = table(spark, sf_dir, "customer").select("c_custkey")
    keys = keys.repartition(tasks(spark, keys.count()), "c_custkey")
    return made(spark, X.RESUMES, "customer", keys).withColumns({"links": F.array().cast("array<string>"), "error": F.lit(None).cast("string")})


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _scalar(f):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _documents(spark, sf_dir).select("doc_id", F.md5(f(F.col("text"))).alias("digest"))

    return query


def ext_email(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.email(F.col("text")).alias("email"))


def ext_name(spark, sf_dir):
    mail = T.email(F.col("text"))
    return resumes(spark, sf_dir).select("file_ord", T.name_of(F.col("text"), mail, F.col("file")).alias("name"))


def ext_github(spark, sf_dir):
    return parse.github_handle(resumes(spark, sf_dir))


def hash_fingerprint(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.fingerprint(F.col("text")).alias("h"), T.content_hash(F.col("text")).alias("content"))


def flt_min_chars(spark, sf_dir):
    return _documents(spark, sf_dir).filter(F.length("text") >= 80).select("doc_id", F.length("text").cast("long").alias("n"))


def trim_ellipsis(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.trim_ellipsis(F.col("text")).alias("short"))


def json_extract(spark, sf_dir):
    return sql(spark, sf_dir, X.ANSWERS, "customer").select("file_ord", T.json_object(F.col("json")).alias("object"))


def dedup_hash(spark, sf_dir):
    keyed = _documents(spark, sf_dir).select("doc_id", T.fingerprint(F.col("text")).alias("h"))
    return dedup.dedup_by_hash(keyed, "doc_id").select("doc_id", F.col("first").alias("duplicate_of"), (F.col("doc_id") == F.col("first")).alias("kept"))


def _keys(spark, sf_dir):
    return resumes(spark, sf_dir).select("file_ord", T.fingerprint(F.col("text")).alias("h"), T.email(F.col("text")).alias("e"))


def dedup_first_wins(spark, sf_dir):
    return dedup.first_wins(_keys(spark, sf_dir)).withColumn("duplicate_of", F.coalesce("duplicate_of", F.lit(-1)))


def gen_sections(spark, sf_dir):
    return plan.parsed(resumes(spark, sf_dir)).sections.withColumn("section_pos", F.col("section_pos").cast("long"))


def gen_blocks(spark, sf_dir):
    b = plan.parsed(resumes(spark, sf_dir)).blocks
    return b.select("file_ord", F.col("block_idx").cast("long").alias("block_idx"), "section", "title", F.size("bullets").cast("long").alias("n_bullets"), "text")


def _scanned(spark, sf_dir):
    """What `scan.scan_documents` tells, a row for each document."""
    return scan.scan_documents(plan.dealt(resumes(spark, sf_dir)))


def _blocks(spark, sf_dir):
    """(file_ord, block_idx, ...) of scanned blocks."""
    told = scan.exploded(_scanned(spark, sf_dir).select("file_ord", "blocks"), "blocks").select("file_ord", "f.*")
    return told.withColumn("block_idx", F.col("block_idx").cast("long"))


def _told(spark, sf_dir):
    """(file_ord, sections, blocks), a row for each document."""
    return parse.structure(plan.dealt(resumes(spark, sf_dir)))


def gen_lexicon_scan(spark, sf_dir):
    return scan.exploded(_blocks(spark, sf_dir).select("file_ord", "block_idx", "found"), "found").select("file_ord", "block_idx", "f.name", "f.tier")


def _hits(spark, sf_dir):
    """(file_ord, name, tier, blocks, in_claims)."""
    return scan.exploded(_scanned(spark, sf_dir).select("file_ord", "hits"), "hits").select("file_ord", "f.*")


def flt_tier(spark, sf_dir):
    hits = written(_hits(spark, sf_dir), "hits")
    built, claimed = (scan.by_tier(hits, "strong", "llm", in_blocks=x).withColumn("built", F.lit(x)) for x in (True, False))
    return built.unionByName(claimed).select("file_ord", "name", "built")


def clean_title(spark, sf_dir):
    b = plan.parsed(resumes(spark, sf_dir)).blocks
    return b.select("file_ord", F.col("block_idx").cast("long").alias("block_idx"), T.clean_title(F.col("title")).alias("title"))


def win_top3_blocks(spark, sf_dir):
    best = score.best_of(_compared(spark, sf_dir)).filter("depth is not null")
    return best.select("file_ord", F.round("depth", 5).alias("depth"))


def scan_github_ttl(spark, sf_dir):
    cache = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    return enrich.valid_cache(cache, F.to_timestamp(F.lit(X.NOW)), 8760.0).select("o_orderkey")


def agg_hits(spark, sf_dir):
    return _hits(spark, sf_dir).select("file_ord", "name", "tier", F.array_join(F.col("blocks").cast("array<string>"), ",").alias("blocks"), "in_claims")


def gate(spark, sf_dir):
    g = scan.gate(_scanned(spark, sf_dir), SETTINGS)
    lists = {c: F.array_join(c, ",") for c in ("ai_terms", "matched_skills", "reasons")}
    return g.select("file_ord", "python_level", "ai_level", "eligible", *(x.alias(c) for c, x in lists.items()))


def _fixed(spark):
    return spark.createDataFrame([(t,) for t in (SETTINGS.depth_prototype, SETTINGS.thin_prototype, SETTINGS.job_description)], "text string")


def _corpus(spark, sf_dir):
    return plan.parsed(resumes(spark, sf_dir)).blocks.select("text").unionByName(_fixed(spark))


def tfidf_df(spark, sf_dir):
    return tfidf.document_frequencies(_corpus(spark, sf_dir), STOP)


def _weighed(spark, sf_dir):
    """Weights of the blocks' terms, before normalisation: blocks and frequencies are written once."""
    blocks, fixed = written(plan.parsed(resumes(spark, sf_dir)).blocks, "blocks"), _fixed(spark)
    frequencies = written(tfidf.document_frequencies(blocks.select("text").unionByName(fixed), STOP), "df")
    return tfidf.weights(tfidf.term_counts(blocks, ["file_ord", "block_idx"], STOP), frequencies, blocks.count() + fixed.count())


def tfidf_weight(spark, sf_dir):
    w = tfidf.normalized(_weighed(spark, sf_dir), ["file_ord", "block_idx"])
    return w.select("file_ord", F.col("block_idx").cast("long").alias("block_idx"), "term", F.round("w", 9).alias("w"))


def tfidf_distinctive(spark, sf_dir):
    d = tfidf.most_distinctive(_weighed(spark, sf_dir), ["file_ord", "block_idx"])
    return d.select("file_ord", F.col("block_idx").cast("long").alias("block_idx"), F.array_join("terms", ",").alias("terms"))


def tfidf_cosine(spark, sf_dir):
    block = lambda b: F.struct(b["block_idx"].alias("block_idx"), b["text"].alias("text"), T.clean(b["text"]).alias("clean"))
    told = written(_told(spark, sf_dir).select("file_ord", F.transform("blocks", block).alias("blocks")), "blocks")
    return plan.similarities(told, plan.block_texts(F.col("blocks")), ("depth", "thin"), SETTINGS).withColumn("block_idx", F.col("block_idx").cast("long"))


def tfidf_jd(spark, sf_dir):
    told = written(_told(spark, sf_dir).select("file_ord", "blocks", plan.evidence_text(F.col("sections")).alias("whole")), "parsed")
    return plan.similarities(told, plan.whole_text(F.col("whole")), ("jd",), SETTINGS).select("file_ord", "sim_jd")


def _compared(spark, sf_dir):
    scanned = _scanned(spark, sf_dir).select("file_ord", "blocks", "ai", plan.evidence_text(F.col("sections")).alias("whole"))
    return plan.compared(written(scanned, "scanned"), SETTINGS)


def score_block(spark, sf_dir):
    b = scan.exploded(_compared(spark, sf_dir).select("file_ord", "ai"), "ai").select("file_ord", "f.*")
    return b.select("file_ord", F.col("block_idx").cast("long").alias("block_idx"), F.array_join("dims", ",").alias("dims"), F.round(-F.col("k"), 5).alias("score"))


def win_best_bullets(spark, sf_dir):
    return _blocks(spark, sf_dir).select("file_ord", "block_idx", F.array_join("best", "|").alias("best"))


def _scored(spark, sf_dir):
    return plan.scored(plan.dealt(resumes(spark, sf_dir)), SETTINGS)


def score_categories(spark, sf_dir):
    return _scored(spark, sf_dir).select("file_ord", F.round("ai_project_depth", 4).alias("ai"), "python_backend", "cloud_fullstack", "engineering_depth", "jd_similarity")


def pen_all(spark, sf_dir):
    p = F.transform("penalties", lambda x: F.concat(T.general(x["points"]), F.lit(" "), x["reason"]))
    return _scored(spark, sf_dir).select("file_ord", F.array_join(p, "; ").alias("penalties"))


def explain(spark, sf_dir):
    return _scored(spark, sf_dir).select("file_ord", F.array_join("strengths", "; ").alias("strengths"), F.array_join("concerns", "; ").alias("concerns"), "project_summary")


def agg_github(spark, sf_dir):
    r = _repos(spark, sf_dir)
    g = enrich.score_repositories(r, F.to_timestamp(F.lit(X.NOW)))
    return g.select("key", "activity", "repo", "maintained", "relevant", "last_push")


def _repos(spark, sf_dir):
    none = F.lit(None).cast("string")
    return sql(spark, sf_dir, X.REPOS, "orders").withColumns({"description": none, "topics": F.array().cast("array<string>")})


def join_github_left(spark, sf_dir):
    docs = resumes(spark, sf_dir).join(ext_github(spark, sf_dir), "file_ord", "left").select("file_ord", "github_username")
    e = enrich.enrich(docs, sql(spark, sf_dir, X.LOOKUPS, "customer"), _repos(spark, sf_dir), F.to_timestamp(F.lit(X.NOW)), SETTINGS)
    return e.select("file_ord", "github_status", "github", "maintained_repos", "github_summary")


def verify_evidence(spark, sf_dir):
    df = resumes(spark, sf_dir).join(sql(spark, sf_dir, X.ANSWERS, "customer"), "file_ord")
    j = enrich.judgement(F.col("json"), F.col("text"))
    return df.select("file_ord", j.isNotNull().alias("valid"), F.coalesce(F.size(j["projects"]).cast("long"), F.lit(-1)).alias("kept"), F.coalesce(j["overall_ai_depth"].cast("long"), F.lit(-1)).alias("depth"))


def _report(spark, sf_dir):
    return plan.screen(resumes(spark, sf_dir), SETTINGS, sql(spark, sf_dir, X.LOOKUPS, "customer"), _repos(spark, sf_dir), sql(spark, sf_dir, X.ANSWERS, "customer"), F.to_timestamp(F.lit(X.NOW)))


def win_rank(spark, sf_dir):
    return _report(spark, sf_dir).ranked.select("file", "candidate_name", F.round("total_score", 1).alias("total_score"), F.round("ai_project_depth", 1).alias("ai"), "llm_status", "rank")


def report_rows(spark, sf_dir):
    r = _report(spark, sf_dir)
    rows = sinks.flat(r.ranked.unionByName(r.rejected, allowMissingColumns=True))
    return rows.select("file", "eligible", "total_score", "penalties", "github_status", "rejection_reasons")


def limit_top(spark, sf_dir):
    return rank.top(_report(spark, sf_dir).eligible, 10).select("file", "total_score")


def agg_summary(spark, sf_dir):
    return _report(spark, sf_dir).summary


def bloom_membership(spark, sf_dir):
    """Customers that may have orders: every order fills the filter, every customer asks."""
    owners = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("h")).distinct()
    m, k = dedup.bloom_size(max(1, owners.count()), 0.05)
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("h"))
    return dedup.bloom_contains(asked, "h", dedup.bloom_filter(owners, "h", m, k), m, k, "c_custkey")


def _pages(spark, sf_dir):
    return sql(spark, sf_dir, X.PAGES, "nation")


def norm_nfkc(spark, sf_dir):
    return T.normalized_rows(_pages(spark, sf_dir), "text").select(F.col("n").cast("long").alias("n"), "text")


def parse_ts(spark, sf_dir):
    said = F.concat(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 3 == 0, "T10:20:30Z").when(F.col("o_orderkey") % 3 == 1, "T10:20:30+02:00").otherwise(" nonsense"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.unix_timestamp(T.timestamp_iso(said)).alias("at"))


def _folder(spark, sf_dir):
    """The pages as files of a folder, each in a folder of its own."""
    at = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    _pages(spark, sf_dir).repartition("n").write.partitionBy("n").option("lineSep", "\n").text(at)
    # the writer's names are unlike on every run
    return at


def scan_text(spark, sf_dir):
    rows = files.load(spark, _folder(spark, sf_dir), 100)
    return rows.select("file_ord", F.regexp_extract("path", "/n=([0-9]+)/", 1).cast("long").alias("n"), "text", "error")


def scan_discover(spark, sf_dir):
    found = files.discover(spark, _folder(spark, sf_dir))
    return found.select(F.regexp_extract("path", "/n=([0-9]+)/", 1).cast("long").alias("n"), F.octet_length("content").cast("long").alias("bytes"), F.lower(F.regexp_extract("file", r"\.([^.]+)$", 1)).alias("suffix"))


def scan_github_cache(spark, sf_dir):
    """A JSON cache written, read again, and asked for entries of the last 24 hours."""
    at = f"{shared_dir(spark)}/handles-{uuid.uuid4().hex}"
    now = F.to_timestamp(F.lit(X.NOW))
    repo = F.struct(F.concat(F.lower("username"), F.lit("-tool")).alias("name"), F.lit(False).alias("fork"), F.lit(False).alias("archived"), F.lit("1998-07-01T00:00:00Z").alias("pushed_at"), F.lit("Python").alias("language"), F.array(F.lit("rag")).alias("topics"), F.lit(None).cast("string").alias("description"), F.lit(3).alias("stargazers_count"))
    entries = sql(spark, sf_dir, X.HANDLES, "customer").select("username", (now - F.make_dt_interval(hours=F.col("hours"))).alias("at"), F.when(F.col("has") == 1, F.array(repo)).otherwise(F.array().cast(f"array<{service.REPOSITORY}>")).alias("repos"))
    service.write_handle_cache(entries, at)
    found = service.cached_repositories(service.read_handle_cache(spark, at), now, 24.0)
    return found.select("username", "name", "language", F.unix_timestamp("pushed_at").alias("pushed"))


def _written_report(spark, sf_dir):
    r = _report(spark, sf_dir)
    return r, f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"


def sink_csv(spark, sf_dir):
    r, at = _written_report(spark, sf_dir)
    sinks.write_csv(r.ranked.unionByName(r.rejected, allowMissingColumns=True), at)
    rows = spark.read.csv(at, header=True)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select("file", F.col("eligible").cast("boolean").alias("eligible"), F.col("total_score").cast("double").alias("total_score"), text("penalties"), "github_status", text("rejection_reasons"))


def sink_json(spark, sf_dir):
    r, at = _written_report(spark, sf_dir)
    sinks.write_sections(r.sections(), at)
    return spark.read.json(f"{at}/ranked_candidates").select("file", "candidate_name", F.round("total_score", 1).alias("total_score"), F.round("ai_project_depth", 1).alias("ai"), "llm_status", "rank")


def sink_terminal(spark, sf_dir):
    """The lines of counts; the head is fixed, and the best are as `limit_top` has them."""
    r = _report(spark, sf_dir)
    return sinks.report_lines(r.summary, r.eligible, r.failed, 10).filter("part = 0 and at < 2").select(F.col("at").cast("long").alias("at"), "line")


def sink_cache(spark, sf_dir):
    at = f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    for hours in (8760.0, 87600.0):  # the second replaces the first as a whole
        cache = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))
        sinks.write_cache(enrich.valid_cache(cache, F.to_timestamp(F.lit(X.NOW)), hours), at)
    return spark.read.parquet(at).select("o_orderkey")


QUERIES = {
    "norm_space": _scalar(T.spaces), "norm_ctrl": _scalar(T.drop_controls), "norm_bullets": _scalar(T.bullets), "norm_dehyphen": _scalar(T.dehyphen), "norm_blank": _scalar(T.blank_lines),
    "norm_alnum": _scalar(T.alnum), "clean_noise": _scalar(T.clean), "truncate_chars": _scalar(T.truncated),
} | {
    f.__name__: f
    for f in (
        ext_email, ext_name, ext_github, hash_fingerprint, flt_min_chars, trim_ellipsis, json_extract, dedup_hash, dedup_first_wins, gen_sections, gen_blocks, gen_lexicon_scan, flt_tier, clean_title, win_top3_blocks, scan_github_ttl, agg_hits, gate,
        tfidf_df, tfidf_weight, tfidf_distinctive, tfidf_cosine, tfidf_jd, score_block, win_best_bullets, score_categories, pen_all, explain, agg_github, join_github_left, verify_evidence, win_rank,
        report_rows, limit_top, agg_summary, bloom_membership, norm_nfkc, parse_ts, scan_text, scan_discover, scan_github_cache, sink_csv, sink_json, sink_terminal, sink_cache,
    )
}
