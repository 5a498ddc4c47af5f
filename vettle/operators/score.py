"""The deterministic 100-point rubric: block scores, category scores, penalties, explanations, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vettle import lexicon as L
from vettle.functions.text import clean_title, distinct_capped, let
from vettle.settings import Settings

# Reasons and sentences of the report.
THIN = "Thin LLM wrapper: best AI project shows no retrieval, orchestration/state, tool use, evaluation or data-processing"
SHALLOW = "Shallow AI project: single depth signal and no agent/RAG framework"
TUTORIAL = "Tutorial-style / no ownership evidence in best AI project"
SKILLS_ONLY = "AI frameworks listed only in skills/summary, no implementation evidence"
JUDGED_THIN = "LLM judge: AI projects are thin wrappers/tutorial-style"
ONLY_CLAIMED = "No AI project found; AI/LLM terms appear only in skills/summary."

STRINGS = "array<string>"
SIMS = "array<struct<block_idx:int,sim_depth:double,sim_thin:double>>"


def _none() -> Column:
    return F.array().cast(STRINGS)


def semantic_points(depth: Column, thin: Column, s: Settings) -> Column:
    raw = (depth - 0.6 * thin) / s.semantic_scale
    return s.semantic_max_points * F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def score_blocks(ai: Column, sims: Column, s: Settings) -> Column:
    """`ai` (see `scan.scan_documents`) with k, the score's negative, first. `sims`: array of (block_idx, sim_depth, sim_thin), or null."""

    def score(b: Column) -> Column:
        sim = F.get(F.filter(F.coalesce(sims, F.array().cast(SIMS)), lambda x: x["block_idx"] == b["block_idx"]), F.lit(0))
        sem = let(sim, lambda x: semantic_points(F.coalesce(x["sim_depth"], F.lit(0.0)), F.coalesce(x["sim_thin"], F.lit(0.0)), s))
        base = F.when(F.size(b["strong"]) > 0, 6.0).otherwise(3.0)
        extra = F.least(F.lit(2), F.greatest(F.lit(0), F.size(b["strong"]) - 1))
        return F.least(F.lit(40.0), base + 3.5 * F.size(b["dims"]) + extra + sem)

    return F.transform(ai, lambda b: F.struct((-score(b)).alias("k"), *(b[c].alias(c) for c in ("block_idx", "title", "dims", "strong", "llm", "evidence", "tutorial"))))


def best_of(scored: DataFrame) -> DataFrame:
    """`scored` (ai, see `score_blocks`, ...) with depth and best instead: the top three blocks' weighted sum, the best block."""
    df = scored.withColumn("ai", F.slice(F.array_sort("ai"), 1, 3))
    part = lambda i: -F.coalesce(F.get("ai", F.lit(i))["k"], F.lit(0.0))
    return df.withColumns({"depth": F.when(F.size("ai") > 0, part(0) + 0.2 * part(1) + 0.1 * part(2)), "best": F.get("ai", F.lit(0))}).drop("ai")


def _points(name: str, built: float, claimed: float) -> Column:
    h = F.element_at("hits", name)
    return F.when(h.isNull(), 0.0).when(F.size(h["blocks"]) > 0, built).when(h["in_claims"], claimed).otherwise(0.0)


def _has(name: str) -> Column:
    return F.coalesce(F.map_contains_key("hits", name), F.lit(False))


def _built(name: str) -> Column:
    return F.coalesce(F.size(F.element_at("hits", name)["blocks"]) > 0, F.lit(False))


def score_documents(gated: DataFrame, s: Settings) -> DataFrame:
    """`gated` (with depth, best, cats, practices, concurrent, deploys and sim_jd) with the breakdown, penalties, strengths, concerns, evidence,
    project_summary and jd_similarity."""
    w, p = s.weights, s.penalties
    df = gated.withColumn("hits", F.map_from_entries(F.transform("hits", lambda h: F.struct(h["name"].alias("k"), F.struct(h["tier"].alias("tier"), h["blocks"].alias("blocks"), h["in_claims"].alias("in_claims")).alias("v")))))
    entries = F.map_entries("hits")
    py = F.filter(entries, lambda e: e["value"]["tier"].isin("python", "pyfw", "pylib") | e["key"].isin(*L.PY_BLOCK_SKILLS))
    df = df.withColumns(
        {
            "py_blocks": F.size(F.array_distinct(F.flatten(F.transform(py, lambda e: e["value"]["blocks"])))),
            "built_ai": (F.col("ai_level") == "implemented") & F.col("best").isNotNull(),
        }
    )
    ai = (
        F.when(F.col("built_ai"), F.least(F.lit(w.ai_project_depth), F.col("depth")))
        .when(F.col("ai_level") == "skills_only", F.least(F.lit(6.0), 2.0 * F.size("ai_terms")))
        .when(F.col("ai_level") == "ml_only", 6.0)
        .otherwise(0.0)
    )
    python = (
        F.when(F.col("python_level") != "none", 3.0).otherwise(0.0)
        + 6.0 * F.least(F.col("py_blocks"), F.lit(2))
        + _points("FastAPI", 5.0, 2.0)
        + F.greatest(_points("Flask", 3.0, 1.0), _points("Django", 3.0, 1.0))
        + F.when(F.col("concurrent"), 3.0).otherwise(0.0)
        + F.when(_has("PostgreSQL"), _points("PostgreSQL", 3.0, 1.0)).otherwise(_points("MySQL/SQLite/SQL", 1.5, 0.5))
        + _points("Redis", 3.0, 1.0)
        + F.least(F.lit(2), F.col("practices"))
    )
    front = (_built("React") | _built("Next.js")) & (F.col("python_level") != "none")
    cloud = (
        F.when(_has("GCP"), _points("GCP", 4.0, 1.5)).otherwise(F.greatest(_points("AWS", 2.5, 1.0), _points("Azure", 2.5, 1.0)))
        + _points("Docker", 4.0, 1.5)
        + _points("Kubernetes", 1.5, 0.5)
        + _points("CI/CD", 1.0, 0.5)
        + F.when(F.col("deploys"), 2.0).otherwise(0.0)
        + F.when(front, 2.0).otherwise(0.0)
    )
    df = df.withColumns(
        {
            "ai_project_depth": ai,
            "python_backend": F.least(F.lit(w.python_backend), python),
            "cloud_fullstack": F.least(F.lit(w.cloud_fullstack), cloud),
            "engineering_depth": F.least(F.lit(w.engineering_depth), F.size("cats").cast("double")),
            "best_title": clean_title(F.col("best.title")),
            "structural": F.size(F.filter(F.coalesce("best.dims", _none()), lambda d: d.isin(*L.STRUCTURAL))),
            "evidence": F.when(F.col("built_ai"), F.col("best.evidence")).otherwise(_none()),
        }
    )
    penalty = lambda cond, reason, points: F.when(cond, F.struct(F.lit(reason).alias("reason"), F.lit(points).alias("points")))
    built = F.col("built_ai")
    shallow = (F.col("structural") == 1) & (F.size("best.strong") == 0)
    df = df.withColumn(
        "penalties",
        F.array_compact(
            F.array(
                penalty(built & (F.col("structural") == 0), THIN, p.thin_wrapper_no_depth),
                penalty(built & shallow, SHALLOW, p.thin_wrapper_one_dim),
                penalty(built & F.col("best.tutorial"), TUTORIAL, p.tutorial_style),
                penalty(~built & (F.col("ai_level") == "skills_only"), SKILLS_ONLY, p.skills_only_ai),
            )
        ),
    )
    others = F.filter("best.dims", lambda d: d != "production")
    with_dims = F.when(F.size(others) > 0, F.concat(F.lit(" with "), F.array_join(F.transform(others, lambda d: F.replace(d, F.lit("_"), F.lit(" "))), ", "))).otherwise("")
    stack = F.array_join(F.slice(F.concat("best.strong", "best.llm"), 1, 5), ", ")
    said = lambda cond, text_: F.when(cond, text_ if isinstance(text_, Column) else F.lit(text_))
    strengths = F.array(
        said(built, F.concat(F.lit("AI project '"), F.col("best_title"), F.lit("' uses "), stack, with_dims)),
        said(_built("FastAPI"), "FastAPI used in project/experience work"),
        said(F.col("py_blocks") >= 2, "Python used across multiple projects/roles"),
        said(_built("Docker") & (_has("GCP") | _has("AWS") | _has("Azure")), "Containerised/cloud deployment experience"),
        said(F.size("cats") >= 3, F.concat(F.lit("Non-trivial engineering signals: "), F.array_join(F.slice("cats", 1, 4), ", "))),
    )
    concerns = F.array(
        said(built & ~F.array_contains("best.dims", "evaluation"), "No evaluation/metrics evidence in the AI project"),
        said(~built & (F.col("ai_level") == "skills_only"), "AI keywords appear only in the skills list"),
        said(~_built("PostgreSQL"), "Limited PostgreSQL evidence"),
        said(~_built("Redis"), "Limited Redis evidence"),
        said(~_has("Docker"), "No Docker/deployment evidence"),
        said(~F.array_contains("cats", "testing"), "No testing evidence"),
    )
    df = df.withColumns(
        {
            "strengths": distinct_capped(F.array_compact(strengths), 5),
            "concerns": distinct_capped(F.concat(F.array_compact(concerns), F.transform("penalties", lambda x: x["reason"])), 6),
            "project_summary": F.when(built, F.concat_ws(": ", "best_title", F.get("evidence", F.lit(0)))).when(F.col("ai_level") == "skills_only", ONLY_CLAIMED).otherwise(""),
            "jd_similarity": F.round(F.coalesce("sim_jd", F.lit(0.0)), 3),
        }
    )
    return df.drop("depth", "best", "py_blocks", "cats", "practices", "concurrent", "deploys", "built_ai", "best_title", "structural", "sim_jd")


def blend_judgement(scored: DataFrame, s: Settings) -> DataFrame:
    """Judgements (columns judgement, may be null) refine the depth, within bounds; adds llm_status."""
    j, base, w = F.col("judgement"), F.col("ai_project_depth"), s.weights.ai_project_depth
    mixed = (1 - s.judge.blend) * base + s.judge.blend * (j["overall_ai_depth"] / 10 * w)
    works = j.isNotNull() & (base > 0)
    deep = F.transform(F.filter(j["projects"], lambda x: x["depth"] >= 4), lambda x: x["kind"])
    thin = (
        works
        & ~F.arrays_overlap(deep, F.array(F.lit("agentic"), F.lit("rag")))
        & (F.size(j["projects"]) > 0)
        & F.forall(j["projects"], lambda x: x["kind"].isin("llm_wrapper", "tutorial"))
        & ~F.exists("penalties", lambda x: x["reason"].startswith("Thin"))
    )
    more = F.array(F.struct(F.lit(JUDGED_THIN).alias("reason"), F.lit(s.penalties.thin_wrapper_no_depth).alias("points")))
    ahead = lambda c, n: F.when(works, distinct_capped(F.concat(F.coalesce(j[c], _none()), F.col(c)), n)).otherwise(F.col(c))
    return scored.withColumns(
        {
            "llm_status": F.when(j.isNull(), "failed").when(base <= 0, "ok(no-op: no deterministic AI evidence)").otherwise("ok"),
            "ai_project_depth": F.when(works, F.round(F.least(F.lit(w), base + s.judge.max_uplift, mixed), 1)).otherwise(base),
            "penalties": F.when(thin, F.concat("penalties", more)).otherwise(F.col("penalties")),
            "project_summary": F.when(works & (j["summary"] != ""), j["summary"]).otherwise(F.col("project_summary")),
            "strengths": ahead("strengths", 5),
            "concerns": ahead("concerns", 6),
        }
    )


def total(s: Settings) -> Column:
    """The total, from the breakdown and the penalties."""
    off = F.least(F.lit(s.penalties.max_total), F.aggregate("penalties", F.lit(0.0), lambda a, x: a + x["points"]))
    five = F.col("ai_project_depth") + F.col("python_backend") + F.col("cloud_fullstack") + F.col("github") + F.col("engineering_depth")
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), five - off)), 1)
