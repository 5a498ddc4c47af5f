"""Behaviour of the screening pipeline on invented documents, and its queries against SQL."""

import json
import random
import re
import zipfile

import pytest
from compare import same
from pyspark.sql import functions as F

from vettle import lexicon as L
from vettle.functions import find
from vettle.functions import text as T
from vettle.operators import dedup, enrich, parse, rank, scan, score
from vettle.plans.screen import dealt, parsed, scored, screen
from vettle.queries import ORACLES, QUERIES
from vettle.queries.screening import resumes
from vettle.settings import Settings, load, overridden
from vettle.sources import files, sinks
from vettle.sources.tables import DEALT, tasks

SMALL = "/root/testdata/sf0.001"
HEAD = "{name}\n{mail} | github.com/{user}\n"
DEEP = HEAD.format(name="Ada Stone", mail="ada@mail.example.com", user="adastone") + (
    "Skills\nPython, FastAPI, PostgreSQL, Redis, Docker, LangGraph\nProjects\nResearch Desk\n"
    "• Built a stateful multi-agent workflow with LangGraph and tool calling\n• Added a vector database with embeddings, reranking and an evaluation benchmark\n• Deployed on Cloud Run with Docker, async FastAPI, Redis caching and pytest tests\n"
)
THIN = HEAD.format(name="Ben Hill", mail="ben@mail.example.com", user="benhill") + "Skills\nPython, Flask, OpenAI\nProjects\nHelper\n• Made a chatbot that answers questions with the OpenAI API for Python users of a shop\n"
JS_ONLY = HEAD.format(name="Cy Moor", mail="cy@mail.example.com", user="cymoor") + "Skills\nJavaScript, React, Node.js\nProjects\nShop\n• Developed a web shop with GitHub Copilot and AI-assisted development of pages\n"
PY_NO_AI = HEAD.format(name="Di Lund", mail="di@mail.example.com", user="dilund") + "Skills\nPython, Django, PostgreSQL\nProjects\nLedger\n• Designed a REST service with Django and PostgreSQL for accounting\n"
EDU_ONLY = HEAD.format(name="Ed Fink", mail="ed@mail.example.com", user="edfink") + "Projects\nFinder\n• Built a RAG search in Node.js with embeddings over company documents\nEducation\nB.Sc., courses in Python programming\n"
SKILLS_ONLY = HEAD.format(name="Flo Amsel", mail="flo@mail.example.com", user="floamsel") + "Skills\nPython, LangChain, RAG, LLM\nProjects\nBlog\n• Created a Django blog with PostgreSQL and comments for readers\n"
ML_ONLY = HEAD.format(name="Gus Dorn", mail="gus@mail.example.com", user="gusdorn") + "Skills\nPython, scikit-learn\nProjects\nChurn\n• Developed an XGBoost model with scikit-learn for churn of customers\n"
INLINE = "Hal Crane\nhal@mail.example.com\nSkills: Python, FastAPI, LangGraph\nExperience:\nDeveloper, Red Mill 2023\n• Built LangGraph agents in Python with evaluation and retrieval\n"
DOCS = {"deep": DEEP, "thin": THIN, "js": JS_ONLY, "pynoai": PY_NO_AI, "edu": EDU_ONLY, "claims": SKILLS_ONLY, "ml": ML_ONLY, "inline": INLINE, "zdup": DEEP}
STOP = ("a", "an", "and", "for", "in", "of", "on", "that", "the", "with")


@pytest.fixture(scope="module")
def report(spark):
    rows = [(i, f"{k}.txt", t, [], None) for i, (k, t) in enumerate(DOCS.items())] + [(50, "bad.pdf", "", [], "ValueError: PDF unreadable"), (51, "empty.txt", "", [], files.NO_TEXT)]
    raw = spark.createDataFrame(rows, "file_ord long, file string, text string, links array<string>, error string")
    return screen(raw, Settings(stop_words=STOP))


def test_gate_and_scores(report):
    ranked = {r.file: r for r in report.ranked.collect()}
    rejected = {r.file: r for r in report.rejected.collect()}
    assert set(ranked) == {"deep.txt", "thin.txt", "claims.txt", "inline.txt"} and ranked["deep.txt"]["rank"] == 1
    assert rejected["js.txt"].reasons == ["No evidence of Python stack", "No AI/agentic project evidence"]
    assert rejected["pynoai.txt"].reasons == ["No AI/agentic project evidence"]
    assert rejected["edu.txt"].reasons == ["Python only mentioned in education/coursework"]
    assert "classical" in rejected["ml.txt"].reasons[0]
    deep, thin, claims = ranked["deep.txt"], ranked["thin.txt"], ranked["claims.txt"]
    assert deep.ai_level == "implemented" and not any(p.reason.startswith("Thin") for p in deep.penalties)
    assert deep.ai_project_depth > thin.ai_project_depth + 15
    assert any(p.reason.startswith("Thin") for p in thin.penalties) and 5 <= sum(p.points for p in thin.penalties) <= 15
    assert claims.ai_level == "skills_only" and claims.ai_project_depth <= 6
    for r in ranked.values():
        assert r.ai_project_depth <= 40 and r.python_backend <= 30 and r.cloud_fullstack <= 15 and r.engineering_depth <= 5 and r.github == 0
        assert r.candidate_name and r.email and len(r.strengths) <= 5 and len(r.concerns) <= 7
    assert deep.candidate_name == "Ada Stone" and deep.github_username == "adastone"


def test_summary_and_sides(report):
    s = report.summary.first().asDict()
    assert (s["total_files"], s["parsed_ok"], s["duplicates_skipped"], s["failed_unreadable"], s["eligible"], s["rejected"]) == (11, 9, 1, 2, 4, 4)
    assert [(r.file, r.duplicate_of) for r in report.duplicates.collect()] == [("zdup.txt", "deep.txt")]
    assert {r.file for r in report.failed.collect()} == {"bad.pdf", "empty.txt"}


def test_reports(report, tmp_path):
    sinks.write_json(report.sections(), f"{tmp_path}/r.json")
    got = json.loads((tmp_path / "r.json").read_text())
    assert got["summary"]["eligible"] == 4 and len(got["ranked_candidates"]) == 4 and "•" not in str(got["failed_files"])
    sinks.write_csv(report.ranked.unionByName(report.rejected, allowMissingColumns=True), f"{tmp_path}/csv")
    assert "Ada Stone" in sinks.terminal(report.summary, report.ranked, report.failed)
    page = sinks.terminal(report.summary, report.ranked, report.failed, 2).split("\n")
    assert page[2] == "" and page[3] == f"{'#':>3} {'Candidate':<24}{'Total':>6}  {'AI':>5}{'Py':>5}{'Cloud':>6}{'GH':>5}{'Eng':>4}  Pen"
    best = report.ranked.orderBy("rank").first()
    assert page[4].startswith(f"  1 {best.candidate_name:<24}{best.total_score:>6}  {best.ai_project_depth:>5.1f}") and page[6].startswith("  [failed] bad.pdf: ValueError")


def test_folder(spark, tmp_path):
    for name, text in {"good.txt": DEEP, "dup.txt": DEEP, "thin.txt": THIN, "js.txt": JS_ONLY, "empty.txt": "", ".hidden.txt": DEEP, "~$lock.docx": "x", "other.md": DEEP}.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "corrupt.pdf").write_bytes(b"%PDF-1.4 nothing")
    (tmp_path / "sub").mkdir()
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in EDU_ONLY.split("\n"))
    with zipfile.ZipFile(tmp_path / "sub" / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Type="x/hyperlink" Target="https://github.com/linked"/></Relationships>')
    raw = files.load(spark, str(tmp_path))
    rows = {r.file: r for r in raw.collect()}
    assert set(rows) == {"good.txt", "dup.txt", "thin.txt", "js.txt", "empty.txt", "corrupt.pdf", "a.docx"}
    assert rows["empty.txt"].error == files.NO_TEXT and rows["corrupt.pdf"].error and rows["a.docx"].text.endswith("x | y") and rows["a.docx"].links == ["https://github.com/linked"]
    assert [r.file for r in raw.orderBy("file_ord").collect()] == ["corrupt.pdf", "dup.txt", "empty.txt", "good.txt", "js.txt", "a.docx", "thin.txt"]
    s = screen(raw, Settings(stop_words=STOP)).summary.first()
    assert (s.total_files, s.duplicates_skipped, s.failed_unreadable, s.eligible, s.rejected) == (7, 1, 2, 2, 2)
    with pytest.raises(FileNotFoundError):
        files.discover(spark, f"{tmp_path}/nowhere")
    (tmp_path / "_under.txt").write_text(DEEP)
    (tmp_path / ".git" / "deep [x]").mkdir(parents=True)
    (tmp_path / ".git" / "deep [x]" / "note.TXT").write_text(THIN)
    (tmp_path / ".git" / "_void.txt").write_text("")
    more = {r.path.rpartition(f"{tmp_path.name}/")[2]: bytes(r.content) for r in files.discover(spark, str(tmp_path)).collect()}
    assert set(more) == {f"sub/{x}" if x == "a.docx" else x for x in rows} | {"_under.txt", ".git/deep [x]/note.TXT", ".git/_void.txt"}
    assert more["_under.txt"] == DEEP.encode() and more[".git/deep [x]/note.TXT"] == THIN.encode() and more[".git/_void.txt"] == b""


def test_pdf_readers(monkeypatch):
    """Readers in turn: the first that finds text; what the last says if none does; links of all."""

    def reader(pages, error=None):
        def run(data):
            yield from pages
            if error:
                raise error

        return run

    def tried(*readers):
        monkeypatch.setattr(files, "PDF_READERS", list(readers))
        return files.extracted("x.PDF", b"")

    assert tried(reader([("a", ["u"]), ("b", [])]), reader([("c", [])])) == ("a\nb", ["u"], None)
    assert tried(reader([(" ", ["u"])]), reader([("c", [])])) == ("c", ["u"], None)
    assert tried(reader([], ImportError("no")), reader([("c", [])])) == ("c", [], None)
    assert tried(reader([]), reader([("", [])])) == ("", [], None)
    assert tried(reader([]), reader([], KeyError("k"))) == ("", [], "ValueError: PDF unreadable: KeyError: 'k'")


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.normalized(F.lit("ﬁne​ ●  a b\r\nex-\nample\n\n\n\nend  "))) == "fine • a b\nexample\n\nend"
    assert one(T.email(F.lit("x josé@exámple.com. y"), F.array())) == "josé@exámple.com"
    assert one(T.email(F.lit("none"), F.array(F.lit("http://a"), F.lit("mailto:b@c.d")))) == "b@c.d"
    assert one(T.name_of(F.lit("CURRICULUM VITAE\nANN O'BRIEN-LEE\nx"), F.lit(None).cast("string"), F.lit("f.txt"))) == "Ann O'Brien-Lee"
    assert one(T.name_of(F.lit("engineer"), F.lit("jo_do.99@x.y"), F.lit("f.txt"))) == "Jo Do"
    assert one(T.name_of(F.lit("engineer"), F.lit(None).cast("string"), F.lit("a.b.txt"))) == "a.b"
    assert one(T.trim_ellipsis(F.lit("a" * 300))) == "a" * 219 + "…"
    assert one(T.clean_title(F.lit("Tool | x"))) == "Tool" and one(T.clean_title(F.lit("Tool May 2023 – now"))) == "Tool" and one(T.clean_title(F.lit("|"))) == "Project"
    assert one(T.py_round1(F.lit(0.35))) == 0.3 and one(T.py_round1(F.lit(0.25))) == 0.2
    assert one(T.general(F.lit(10.0))) == "10" and one(T.general(F.lit(2.5))) == "2.5"
    assert one(T.clean(F.lit("AI-assisted development work and RAG"))).split() == ["and", "RAG"]


def test_blocks(spark):
    text = "X Y\nProjects\nTitle one\nTitle two\n• first\ncontinues here\n• second.\nNew Title 2023\nplain\nSkills\nPython\nProjects\n- dash\nExperience\nJob | A\n"
    docs = spark.createDataFrame([(1, "f", text, []), (2, "f", "Just A Line\nand more", [])], "file_ord long, file string, text string, links array<string>")
    p = parsed(docs)
    b = [(r.file_ord, r.block_idx, r.section, r.title, r.bullets) for r in p.blocks.orderBy("file_ord", "block_idx").collect()]
    assert b == [
        (1, 0, "projects", "Title one | Title two", ["first continues here", "second."]),
        (1, 1, "projects", "New Title 2023 | plain", ["dash"]),
        (1, 2, "experience", "Job | A", []),
        (2, 0, "unknown", "Just A Line | and more", []),
    ]
    assert {r.section: r.body for r in p.sections.filter("file_ord = 1").collect()}["skills"] == "Python"


def test_handle(spark):
    rows = [(1, "see github.com/Text and github.com/Text/repo", ["https://github.com/link/x"]), (2, "github.com/features github.com/b/x github.com/a", []), (3, "none", None)]
    got = {r.file_ord: r.github_username for r in parse.github_handle(spark.createDataFrame(rows, "file_ord long, text string, links array<string>")).collect()}
    assert got == {1: "link", 2: "a"}


def greedy(rows):
    seen, out = {}, {}
    for o, h, e in sorted(rows):
        keys = [("h", h)] + ([("e", e.lower())] if e else [])
        of = next((seen[k] for k in keys if k in seen), None)
        out[o] = of
        if of is None:
            seen.update(dict.fromkeys(keys, o))
    return out


def test_first_wins(spark):
    rng = random.Random(3)
    for n in (0, 4, 40):
        rows = [(i, f"h{rng.randrange(n // 2 + 1)}", rng.choice([None, "", f"E{rng.randrange(n // 2 + 1)}@x", f"e{rng.randrange(n // 2 + 1)}@X"])) for i in range(n)]
        if n == 4:
            rows = [(0, "h1", "e1"), (1, "h1", "e2"), (2, "h2", "e2"), (3, "h2", None)]
        got = {r.file_ord: (r.kept, r.duplicate_of) for r in dedup.first_wins(spark.createDataFrame(rows, "file_ord long, h string, e string")).collect()}
        assert got == {o: (of is None, of) for o, of in greedy(rows).items()}


def test_bloom(spark):
    m, k = dedup.bloom_size(10_000, 0.001)
    assert (m, k) == (143775, 10)
    items = spark.range(2000).select("id", F.col("id").cast("string").alias("s"))
    f = dedup.bloom_filter(items.filter("id < 1000"), "s", *dedup.bloom_size(1000, 0.01))
    got = {r.id: r.maybe for r in dedup.bloom_contains(items, "s", f, *dedup.bloom_size(1000, 0.01), "id").collect()}
    assert all(got[i] for i in range(1000)) and sum(got[i] for i in range(1000, 2000)) < 30


def test_repositories(spark):
    now = F.to_timestamp(F.lit("2026-10-08 00:00:00"))
    ago = lambda u, d, **x: (u, x.get("name", "n"), x.get("fork", False), x.get("archived", False), d, x.get("language", "Go"))
    rows = [ago("five", 10, language="Python")] * 5 + [ago("old", 900), ago("old", 1, fork=True), ago("fork", 3, fork=True), ago("B30", 30), ago("b31", 31), ago("b90", 90), ago("b91", 91), ago("b365", 365, name="storage"), ago("b366", 366), ago("none", None)]
    df = spark.createDataFrame(rows, "username string, name string, fork boolean, archived boolean, days int, language string")
    df = df.withColumns({"pushed_at": now - F.make_dt_interval("days"), "description": F.lit(None).cast("string"), "topics": F.array().cast("array<string>")})
    got = {r.key: (r.activity, r.repo, r.maintained, r.relevant, r.dated) for r in enrich.score_repositories(df, now).collect()}
    assert got["five"] == (5.0, 5.0, 5, 5, True) and got["old"] == (0.0, 0.0, 0, 0, True) and got["fork"] == (0.0, 0.0, 0, 0, True) and not got["none"][4]
    assert [got[k][0] for k in ("b30", "b31", "b90", "b91", "b365", "b366")] == [5.0, 4.0, 4.0, 3.0, 1.5, 0.0] and got["b365"][3] == 1
    docs = spark.createDataFrame([(1, "Five"), (2, None), (3, "gone"), (4, "busy"), (5, "lost"), (6, "none")], "file_ord long, github_username string")
    lookups = spark.createDataFrame([("five", 200, "9"), ("gone", 404, "9"), ("busy", 403, "0"), ("none", 200, "9")], "username string, http_status int, ratelimit_remaining string")
    e = {r.file_ord: (r.github_status, r.github) for r in enrich.enrich(docs, lookups, df, now, Settings()).collect()}
    assert e == {1: ("ok", 10.0), 2: ("no_profile", 0.0), 3: ("not_found", 0.0), 4: ("rate_limited", 0.0), 5: ("error", 0.0), 6: ("error", 0.0)}
    cache = spark.createDataFrame([("a", 3), ("b", 30)], "username string, h int").withColumn("at", now - F.make_dt_interval(hours="h"))
    assert [r.username for r in enrich.valid_cache(cache, now, 24.0).collect()] == ["a"]


def test_judgements(spark):
    text = "Built a multi-agent workflow with LangGraph and more"
    good = {"projects": [{"name": "a", "kind": "agentic", "depth": 8, "evidence": "multi-agent WORKFLOW, with langgraph"}, {"name": "b", "kind": "rag", "depth": 5, "evidence": "never said in there"}], "overall_ai_depth": 9, "summary": "s"}
    rows = [json.dumps(good), f"```json\n{json.dumps(good)}\n```", "not json", '{"overall_ai_depth": 99}', '{"overall_ai_depth": 3, "projects": [{"name": "a", "kind": "other", "depth": 1, "evidence": "e"}]}']
    got = [r.j for r in spark.createDataFrame([(x,) for x in rows], "x string").coalesce(1).select(enrich.judgement(F.col("x"), F.lit(text)).alias("j")).collect()]
    assert [j and len(j.projects) for j in got] == [1, 1, None, None, None] and got[0].overall_ai_depth == 9
    base = spark.createDataFrame([(10.0, rows[0]), (0.0, rows[0]), (10.0, "no")], "ai_project_depth double, x string").withColumns(
        {"judgement": enrich.judgement(F.col("x"), F.lit(text)), "penalties": F.array().cast("array<struct<reason:string,points:double>>"), "project_summary": F.lit(""), "strengths": F.array().cast("array<string>"), "concerns": F.array().cast("array<string>")}
    )
    assert [(r.ai_project_depth, r.llm_status) for r in score.blend_judgement(base, Settings()).collect()] == [(18.0, "ok"), (0.0, "ok(no-op: no deterministic AI evidence)"), (10.0, "failed")]


def test_ranks(spark):
    df = spark.range(500).select(F.col("id").alias("file_ord"), (F.col("id") % 7).cast("double").alias("total_score"), F.lit(1.0).alias("ai_project_depth"), F.lit(None).cast("double").alias("jd_similarity"), F.lit("n").alias("candidate_name"))
    got = rank.ranked(df).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 501)) and [(-r.total_score, r.file_ord) for r in got] == sorted((-(i % 7), i) for i in range(500))


def test_settings(tmp_path):
    (tmp_path / "s.json").write_text('{"weights": {"github": 5}, "accept_classical_ml": true}')
    s = load(f"{tmp_path}/s.json", {"LLM_PROVIDER": "OpenAI"})
    assert s.weights.github == 5 and s.accept_classical_ml and s.judge.provider == "openai" and s.weights.python_backend == 30
    with pytest.raises(AttributeError):
        overridden(s, {"nothing": 1})
    with pytest.raises(AttributeError):
        overridden(s, {"weights": {"nothing": 1}})
    (tmp_path / "words").write_text("of the\nand")
    assert overridden(s, {"stop_words": ["a"], "judge": {}}).stop_words == ("a",)
    (tmp_path / "t.json").write_text(json.dumps({"stop_words_file": f"{tmp_path}/words"}))
    assert load(f"{tmp_path}/t.json", {}).stop_words == ("of", "the", "and") and load(None, {}) == Settings()
    assert len(L.SKILLS) == 54 and len({n for n, _, _ in L.SKILLS}) == 54 and len({t for _, _, t in L.SKILLS}) == 17


def test_title_and_ascii(spark):
    """Capitals as Python's title; only texts beyond ASCII take the way through Python."""
    said = ["o'neil mc-coy", "ÉLAN vital 3d", "a1b c_d", "", "x. y", "ΑΒΓ δε"]
    df = spark.createDataFrame([(x,) for x in said], "t string")
    assert [r[0] for r in df.select(T.title(F.col("t"))).collect()] == [x.title() for x in said]
    odd = spark.createDataFrame([("ﬁne ²",), ("plain",), (None,)], "t string")
    assert sorted(str(r.t) for r in T.by_ascii(odd, "t", T.nfkc).collect()) == ["None", "fine 2", "plain"]


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_weights_have_norm_one(spark):
    sums = QUERIES["tfidf_weight"](spark, SMALL).groupBy("file_ord", "block_idx").agg(F.sum(F.col("w") * F.col("w")).alias("s"))
    assert sums.filter("abs(s - 1) > 1e-6").isEmpty() and not sums.isEmpty()


@pytest.mark.parametrize("name", ["tfidf_weight", "tfidf_distinctive"])
def test_counts_are_not_broadcast(spark, name):
    """The blocks' terms, which grow with the input, are the left side: they stay where they are."""
    assert "BuildLeft" not in planned(QUERIES[name](spark, SMALL))


def test_structure_is_told_by_document(spark):
    """No window and no sort over lines, whatever the number of documents."""
    for name in ("gen_blocks", "gen_sections", "win_best_bullets"):
        plan = planned(QUERIES[name](spark, SMALL))
        assert "Window" not in plan and "Sort" not in plan and "Aggregate" not in plan


def test_hits_parse_once(spark):
    """Blocks and sections come from one written parse, and both tiers from one table of hits."""
    assert "MapInArrow" not in (plan := planned(QUERIES["flt_tier"](spark, SMALL))) and "Window" not in plan


def test_documents_stay_in_their_row(spark):
    """Skills and the gate move and group nothing; documents meet their similarities by a hash of these, never sorted."""
    for name in ("agg_hits", "gate"):
        plan = planned(QUERIES[name](spark, SMALL))
        assert "Aggregate" not in plan and "Join" not in plan
    for name in ("score_block", "pen_all", "explain", "score_categories"):
        plan = planned(QUERIES[name](spark, SMALL))
        assert plan.count("ShuffledHashJoin") == 1 and "BuildRight" in plan and "SortMergeJoin" not in plan


def test_tasks_grow_with_rows(spark):
    n = spark.sparkContext.defaultParallelism
    assert tasks(spark, 0) == tasks(spark, DEALT) == n and tasks(spark, 100 * n * DEALT) == 100 * n
    docs = spark.range(3).select(F.col("id").alias("file_ord"))
    assert dealt(docs).rdd.getNumPartitions() == n and dealt(docs, 2 * n * DEALT).rdd.getNumPartitions() == 2 * n


def test_odd_documents_in_a_row(spark):
    """No text, an empty one, links that are null, claims alone: each document has its row."""
    rows = [(1, "a", None, None), (2, "b", "", []), (3, "c", "Projects\nnone\nSkills\nPython, RAG", [None, "https://github.com/x"]), (4, "d", "Projects\nP\n- RAG agent in Python\n- RAG", [])]
    docs = spark.createDataFrame(rows, "file_ord long, file string, text string, links array<string>")
    got = {r.file_ord: r for r in scored(dealt(docs), Settings(stop_words=STOP)).collect()}
    assert [got[i].ai_level for i in (1, 2, 3, 4)] == ["none", "none", "skills_only", "implemented"] and got[3].github_username == "x"
    assert got[3].hits["RAG"].in_claims and got[3].hits["RAG"].blocks == []
    assert got[4].hits["Agents"].blocks == [0] and not got[4].hits["RAG"].in_claims and got[1].candidate_name == "a" and not got[2].eligible


def test_spared_patterns(spark):
    """The plain search for needed literals never hides a match."""
    patterns = [p for _, p, _ in L.SKILLS] + [p for _, p in (*L.DEPTH_DIMS, *L.ENG_DEPTH)] + [L.NOISE, L.AGENT]
    assert all(L.needed(p) for p in patterns) and L.needed(r"\d+") == () and L.needed("a(?:bc|de)f?") == ("bc", "de")
    said = ["LangGraph and lang-CHAIN, RAG rag MCP, Cloud Run", "\u017fql\u0130te my\u017fql \u212aafka Red\u0131s", "AI-assisted development", "c++ K8S s3 REACT.JS pgVector", "", "nothing here"]
    texts = spark.createDataFrame([(x,) for x in [*said, DEEP, THIN, JS_ONLY, ML_ONLY, INLINE]], "t string")
    both = texts.select(*(F.array(F.col("t").rlike(L.java(p)), T.with_small(F.col("t"), lambda t, s, p=p: T.has(t, s, p))).alias(f"p{i}") for i, p in enumerate(patterns))).collect()
    assert all(a == b for r in both for a, b in r) and sum(a for r in both for a, _ in r) > 40


def test_odd_structure():
    """Line ends, marks and signs that Unicode counts otherwise than Python does."""
    assert parse.heading(" :Key Projects:\u2003") == "projects" and parse.heading("Education & Training") == "education" and parse.heading("Education & training") is None
    assert not parse.continuation("x", "In 2023\u00b2") and parse.continuation("x", "In 2023\u0301") and not parse.continuation("x", "Pre\u017fent") and parse.continuation("end.", "élan") and not parse.continuation("end.", "Up")
    sections, blocks = parse.structure_of("A B\nProjects\nOne\n- b\nEducation\nx\nPROJECTS:\nTwo\n\u2022 c\nand on")
    assert [(s["section"], s["section_pos"], s["body"]) for s in sections] == [("header", 0, "A B"), ("projects", 1, "One\n- b\nTwo\n\u2022 c\nand on"), ("education", 4, "x")]
    assert [(b["title"], b["bullets"]) for b in blocks] == [("One", ["b Two", "c and on"])]
    assert parse.structure_of(None) == ([], []) and parse.structure_of("") == ([], [])


def test_found_as_java(spark):
    """Walks in Python find, blank and cut what Java's patterns do, whatever signs and letters stand around."""
    patterns = {str(i): p for i, p in enumerate([*(p for _, p, _ in L.SKILLS), *(p for _, p in (*L.DEPTH_DIMS, *L.ENG_DEPTH)), L.AGENT, L.BACKEND, L.ASYNC, L.DEPLOY, L.TUTORIAL, L.OWNERSHIP])}
    assert all(L.begins(p) for p in (*patterns.values(), L.NOISE)) and L.begins(r"\d+a") == () and L.begins(r"\b(?:ab|cd)e?") == ("ab", "cd")
    words = sorted({x for p in patterns.values() for x in (*L.needed(p), *L.begins(p))} | {"RAG", "rag", "ADK", "SQL", "MCP", "CNN", "AI-assisted work", "LLM assisted\u2003code\u00a0now", "copilot", "agents", "my\u017fql", "\u212aafka", "Red\u0131s", "re\u015ft", "restful", "calling", "tools"})
    signs = ["", " ", " ", " ", "-", "\n", "_", ".", "\u2022", "\u00e9", "\u0301", "\u200d", "\u2160", "\u24d0", "\u00b2", "\u203f", "\u0663", "\U0001f600", "\u00a0", "\u0085", "\x1f", "\U0001d400"]
    r = random.Random(5)
    texts = ["", *("".join(r.choice((str, str.upper, str.title))(r.choice(words)) + r.choice(signs) + r.choice(signs) for _ in range(r.randrange(1, 9))) for _ in range(600)), DEEP, THIN, INLINE]
    c = F.col("t")
    java = [F.array(*(c.rlike(L.java(p)) for p in patterns.values())), T.clean(c), T.trim_ellipsis(F.repeat(c, 5)), F.regexp_extract_all(c, F.lit(L.java(L.BACKEND)), F.lit(0))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", *(x.alias(f"c{i}") for i, x in enumerate(java))).collect()
    search, some = find.Searches(patterns), 0
    for i, found, clean, cut, backend in rows:
        text, plain = texts[i], find.plain(texts[i])
        places = search.places(plain, plain.lower())
        assert [k in places for k in patterns] == found, text
        assert (find.clean(text), find.trim_ellipsis(text * 5)) == (clean, cut)
        assert [text[a:b] for a, b in search.spans(str(list(patterns.values()).index(L.BACKEND)), plain, places)] == backend
        some += sum(found)
    assert len(rows) == len(texts) and some > 1000


def test_blocks_of_a_walk():
    """Each block and line has its own matches, with the copilot blanked; the best lines by signals."""
    text = "A B\nProjects\nOne\n- plain\n- RAG agents with tool calling\n- RAG\n- github copilot.\nTwo\n- Python\u00e9 agents\n- Redis cache\nSkills\nRAG, Docker"
    sections, blocks, ai, hits, cats, practices, concurrent, deploys = scan.scanned_of(text)
    assert [[x["name"] for x in b["found"]] for b in blocks] == [["RAG", "Tool Calling", "Agents"], ["Redis"]]
    assert blocks[0]["best"] == ["RAG agents with tool calling", "RAG"] and blocks[1]["best"] == ["Redis cache"] and "copilot" not in blocks[0]["clean"]
    assert [(x["block_idx"], x["dims"], x["strong"], x["tutorial"]) for x in ai] == [(0, ["tools"], ["Agents", "RAG", "Tool Calling"], True)]
    assert [(h["name"], h["blocks"], h["in_claims"]) for h in hits] == [("RAG", [0], True), ("Tool Calling", [0], False), ("Agents", [0], False), ("Redis", [1], False), ("Docker", [], True)]
    assert (cats, practices, concurrent, deploys) == (["caching"], 0, False, False)
    assert scan.scanned_of(None)[1:5] == ([], [], [], []) and scan.scanned_of("")[5:] == (0, False, False)


def test_lexicon_is_walked_once(spark):
    """No pattern of the lexicon is tried apart from the walk over a document; texts are made in every task."""
    assert "RLIKE" not in planned(QUERIES["agg_hits"](spark, SMALL)) and "RLIKE" not in planned(QUERIES["win_best_bullets"](spark, SMALL))
    assert resumes(spark, SMALL).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_sums_stay_with_their_documents(spark):
    """A task's sums are those of the documents dealt to it, a bounded number, and don't move again."""
    for name in ("tfidf_jd", "tfidf_cosine", "score_block"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and not re.search(r"hashpartitioning\(file_ord#\d+L?, block_idx", plan)


def test_ranks_are_told_when_asked_for(spark, monkeypatch):
    """The best few, the counts and the lines need no order of all rows."""
    monkeypatch.setattr(rank, "numbered", lambda *_: pytest.fail("all rows are ordered"))
    for name in ("limit_top", "agg_summary", "sink_terminal"):
        assert not QUERIES[name](spark, SMALL).isEmpty()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    same(QUERIES[name](spark, SMALL), ORACLES[name], SMALL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1 and set(e.oracle_sql()) <= set(e.queries())
