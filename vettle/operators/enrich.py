"""External evidence as tables: repositories by handle, judgements by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vettle import lexicon as L
from vettle.functions.text import alnum, json_object, let
from vettle.settings import Settings
from vettle.sources.tables import written

JUDGEMENT = "struct<projects:array<struct<name:string,kind:string,depth:int,evidence:string>>,overall_ai_depth:int,strengths:array<string>,concerns:array<string>,summary:string>"
KINDS = ("agentic", "rag", "llm_wrapper", "classical_ml", "tutorial", "non_ai")


def valid_cache(cache: DataFrame, now: Column, ttl_hours: float) -> DataFrame:
    """Rows of a cache (username, at, ...) that haven't expired."""
    return cache.filter(F.col("at") > now - F.make_dt_interval(hours=F.lit(int(ttl_hours)), secs=F.lit((ttl_hours % 1) * 3600)))


def score_repositories(repos: DataFrame, now: Column) -> DataFrame:
    """(key, activity, repo, maintained, relevant, last_push, dated) by lower-cased username, over own repositories."""
    own = ~F.coalesce("fork", F.lit(False))
    recent = F.coalesce(F.col("pushed_at") >= now - F.expr("interval 365 days"), F.lit(False))
    kept = own & ~F.coalesce("archived", F.lit(False)) & recent
    about = F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("description", F.lit("")), F.array_join(F.coalesce("topics", F.array().cast("array<string>")), " "))
    fits = kept & (F.coalesce(F.col("language") == "Python", F.lit(False)) | about.rlike(L.java(L.AI_REPO)))
    g = repos.groupBy(F.lower("username").alias("key")).agg(
        F.max(F.when(own, F.col("pushed_at"))).alias("last"), F.count_if(kept).alias("maintained"), F.count_if(fits).alias("relevant"), F.count_if(own).alias("own")
    )
    days = F.floor((F.unix_micros(now) - F.unix_micros("last")) / 86_400_000_000)
    activity = F.when(days <= 30, 5.0).when(days <= 90, 4.0).when(days <= 180, 3.0).when(days <= 365, 1.5).otherwise(0.0)
    n, r = F.col("maintained"), F.col("relevant")
    points = F.when(n >= 5, 3.0).when(n >= 3, 2.0).when(n >= 1, 1.0).otherwise(0.0) + F.when(r >= 2, 2.0).when(r >= 1, 1.0).otherwise(0.0)
    dated = (F.col("own") == 0) | F.col("last").isNotNull()
    return g.select("key", F.when(F.col("own") == 0, 0.0).otherwise(activity).alias("activity"), F.least(F.lit(5.0), points).alias("repo"), "maintained", "relevant", F.date_format("last", "yyyy-MM-dd").alias("last_push"), dated.alias("dated"))


def lookup_status(http: Column, remaining: Column) -> Column:
    return F.when(http == 404, "not_found").when((http == 429) | ((http == 403) & (remaining == "0")), "rate_limited").when(http.between(200, 299), "ok").otherwise("error")


def enrich(docs: DataFrame, lookups: DataFrame, repos: DataFrame, now: Column, s: Settings) -> DataFrame:
    """`docs` (with github_username) and its status, scores and summary.

    lookups: (username, http_status, ratelimit_remaining), one row for each answered handle; a handle without a row is an error.
    Handles are looked up once each, case-insensitively, whatever number of documents names them.
    """
    asked = lookups.groupBy(F.lower("username").alias("key")).agg(F.min(F.struct("http_status", "ratelimit_remaining")).alias("x"))
    found = asked.join(score_repositories(repos, now), "key", "left").withColumn("status", lookup_status(F.col("x.http_status"), F.col("x.ratelimit_remaining")))
    # written, its size is known: where it is small, documents are neither moved nor sorted
    df = docs.withColumn("key", F.lower("github_username")).join(written(found, "handles"), "key", "left")
    status = F.when(F.col("key").isNull(), "no_profile").when(F.col("status").isNull() | ((F.col("status") == "ok") & ~F.coalesce("dated", F.lit(True))), "error").otherwise(F.col("status"))
    df = df.withColumn("github_status", status if s.repositories.enabled else F.lit("disabled"))
    ok = F.col("github_status") == "ok"
    zero = lambda c, z: F.when(ok, F.coalesce(F.col(c), F.lit(z))).otherwise(F.lit(z))
    df = df.withColumns({"activity_score": zero("activity", 0.0), "repo_score": zero("repo", 0.0), "maintained_repos": zero("maintained", 0).cast("long"), "relevant_repos": zero("relevant", 0).cast("long")})
    pushed = F.concat(F.lit("Last push "), F.col("last_push"), F.lit("; "), F.col("maintained_repos").cast("string"), F.lit(" maintained repos ("), F.col("relevant_repos").cast("string"), F.lit(" Python/AI-relevant)"))
    summary = (
        F.when(ok, F.coalesce(pushed, F.lit("No original public repositories")))
        .when(F.col("github_status") == "no_profile", "No GitHub profile found in resume")
        .when(F.col("github_status") == "not_found", "GitHub user not found / private")
        .when(F.col("github_status") == "rate_limited", "GitHub API rate-limited")
        .when(F.col("github_status") == "disabled", "GitHub enrichment disabled")
        .otherwise("GitHub enrichment failed")
    )
    score = F.when(ok, F.least(F.lit(10.0), F.col("activity_score") + F.col("repo_score"))).otherwise(s.repositories.missing_score)
    df = df.withColumns({"github_summary": summary, "github": F.round(F.least(F.lit(s.weights.github), score), 1)})
    return df.drop("key", "x", "status", "activity", "repo", "maintained", "relevant", "dated")


def judgement(json: Column, text: Column) -> Column:
    """The judgement in a model's answer: null unless it fits the schema; projects whose quote isn't in the text are dropped."""
    none = F.array().cast("array<string>")
    no_projects = F.array().cast("array<struct<name:string,kind:string,depth:int,evidence:string>>")
    given = lambda p: p["name"].isNotNull() & p["evidence"].isNotNull() & F.coalesce(p["kind"].isin(*KINDS), F.lit(False)) & F.coalesce(p["depth"].between(0, 10), F.lit(False))
    quoted = lambda hay: lambda p: let(alnum(p["evidence"]), lambda e: (F.length(e) >= 12) & F.contains(hay, e))

    def checked(j: Column) -> Column:
        projects = F.coalesce(j["projects"], no_projects)
        fits = j["overall_ai_depth"].between(0, 10) & F.forall(projects, given)
        kept = let(alnum(text), lambda hay: F.filter(projects, quoted(hay)))
        rest = {c: F.coalesce(j[c], none) for c in ("strengths", "concerns")}
        out = F.struct(kept.alias("projects"), j["overall_ai_depth"].alias("overall_ai_depth"), *(x.alias(c) for c, x in rest.items()), F.coalesce(j["summary"], F.lit("")).alias("summary"))
        return F.when(F.coalesce(fits, F.lit(False)), out)

    return let(F.from_json(json_object(json), JUDGEMENT, {"mode": "PERMISSIVE"}), checked)
