"""Synthetic tables as SQL that Spark and DuckDB run alike: résumés, repositories, lookups, model answers, call logs.

All people are invented. Phrases are picked by the customer key, so the same rows come out at every scale and engine.
"""

from __future__ import annotations


def pick(key: str, *options: str) -> str:
    """The option that `key` modulo their number names."""
    said = ["'" + o.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for o in options]
    return f"(case ({key}) % {len(options)} " + " ".join(f"when {i} then {o}" for i, o in enumerate(said)) + " end)"


K = "c_custkey"
#: Copies share their text with an earlier key; others share an e-mail address only.
SOURCE = f"(case when {K} % 37 = 5 and {K} > 37 then {K} - 37 else {K} end)"
S = "src"
FIRST = pick(S, "Alva", "Bram", "Cleo", "Dario", "Edda", "Falk", "Gina", "Hugo", "Ilka", "Jarl", "Kaya")
LAST = pick(f"floor({S} / 11)", "Amsel", "Birke", "Crane", "Dorn", "Elster", "Fink", "Gamper", "Hall", "Iltis", "Jonas", "Kranz", "Lund", "Moor")
MAIL = f"lower({FIRST}) || '.' || lower({LAST}) || (case when {K} % 41 = 7 and {K} > 41 then {K} - 41 else {S} end) || '@mail.example.com'"
GITHUB = f"(case when {S} % 5 = 0 then 'no profile' else 'github.com/user' || ({S} % 400) || (case when {S} % 3 = 0 then '/tool' else '' end) end)"
SKILLS = pick(
    S,
    "Python, FastAPI, PostgreSQL, Redis, Docker, LangGraph",
    "Python, Flask, MySQL, OpenAI, React",
    "JavaScript, React, Node.js, Next.js, TypeScript",
    "Python, Django, PostgreSQL, GitHub Actions",
    "Java, Spring Boot, AWS, Kubernetes",
    "Python, LangChain, RAG, embeddings, MCP",
    "Python, scikit-learn, XGBoost, pandas, numpy",
)
PROJECT = pick(
    S,
    "Research Desk | 2024\n• Built a stateful multi-agent workflow with LangGraph, tool calling and an\nevaluation set for retrieval over pgvector\n• Deployed async FastAPI service with Redis caching on Cloud Run using Docker\n• Added pytest tests, tracing and retries with backoff",
    "Help Bot\n- Built a chatbot using the OpenAI API that answers questions",
    "Shop Front | React\n* Developed a web shop with GitHub Copilot and AI-assisted development work\n* Hosted on Vercel",
    "Ledger Service (2022)\n• Designed a REST service in Django with PostgreSQL, JWT and Celery workers\n• Introduced CI/CD and test coverage",
    "Clone of a tutorial\n• Following the YouTube course project, a Gemini API prompt wrapper",
    "Paper Finder\nNovember 2023\n• Implemented a RAG pipeline with chunking, embeddings and FAISS, precision and recall measured\n• Integrated an agent with function calling\nand structured output in JSON",
    "Churn Model\n• Developed an XGBoost model with scikit-learn; accuracy 0.91",
    "Router\n• Engineered conditional routing between LLM agents with guardrails\n• Microservices on Kafka, Kubernetes and Prometheus monitoring",
    "Notes\nplain lines without bullets\nmore of them",
)
JOB = pick(
    f"floor({S} / 3)",
    "EXPERIENCE\nIntern, Blue Harbour Systems 2023 – present\n• Optimized SQL queries and wrote Python scripts with pandas\n• Owned GraphQL gateway, rate limit and timeout handling",
    "Work Experience:\nDeveloper at Red Mill\nBerlin, current\n• Created Azure functions in C++ and Java",
    "Employment\n• Integrated Kafka queues and background jobs in FastAPI\nwith graceful shutdown",
    "",
)
SCHOOL = pick(f"floor({S} / 7)", "EDUCATION\nB.Sc. Computing, Python and machine learning courses", "Education & Training\nB.A. Design", "Certifications\nPython for everyone", "")
SUMMARY = pick(f"floor({S} / 2)", "SUMMARY\nBuilds agents and LLM products", "Profile\nBackend work", "", "About Me\nAgentic systems, multi-agent and LLM evaluation")
PLAIN = f"({S} % 23 = 4)"

RESUMES = f"""
select file_ord, file, text from (
  select {K} as file_ord, 'r' || lpad(cast({K} as varchar(10)), 7, '0') || '.txt' as file,
    case when {PLAIN} then {FIRST} || ' ' || {LAST} || chr(10) || 'wrote Python tools and LLM agents for ' || lower({LAST}) || ' in many small steps, over and over, for years' || chr(10) || {PROJECT}
    else {FIRST} || ' ' || {LAST} || chr(10) || {MAIL} || ' | ' || {GITHUB} || chr(10)
      || {SUMMARY} || chr(10) || 'Technical Skills' || chr(10) || {SKILLS} || chr(10) || chr(10)
      || {pick(f"floor({S} / 5)", "PROJECTS", "Key Projects:", "Selected Projects")} || chr(10) || {PROJECT} || chr(10) || {JOB} || chr(10) || {SCHOOL}
    end as text
  from (select {K}, {SOURCE} as src from customer) c
) r
"""

#: Invented answers of a judging model, about the résumés.
ANSWERS = f"""
select {K} as file_ord,
  case {K} % 5 when 0 then 'not json'
    when 1 then '```json' || chr(10) || '{{"projects":[{{"name":"P","kind":"agentic","depth":8,"evidence":"multi-agent workflow with LangGraph"}},{{"name":"Q","kind":"rag","depth":6,"evidence":"this was never written there"}}],"overall_ai_depth":8,"strengths":["deep"],"concerns":[],"summary":"strong"}}' || chr(10) || '```'
    when 2 then '{{"projects":[{{"name":"P","kind":"llm_wrapper","depth":3,"evidence":"chatbot using the OpenAI API"}}],"overall_ai_depth":2,"strengths":[],"concerns":["thin"],"summary":""}}'
    when 3 then '{{"projects":[],"overall_ai_depth":99}}'
    else '{{"projects":[],"overall_ai_depth":5,"strengths":[],"concerns":[],"summary":"ok"}}' end as json
from customer
"""

#: Repositories from orders: the customer is the user.
REPOS = """
select 'User' || cast(o_custkey % 400 as varchar(10)) as username, 'repo-' || cast(o_orderkey as varchar(12)) || (case o_orderkey % 7 when 0 then '-rag' else '' end) as name,
  o_orderstatus = 'P' as fork, o_orderkey % 11 = 0 as archived, cast(o_orderdate as timestamp) as pushed_at,
  case o_orderkey % 3 when 0 then 'Python' else 'Go' end as language
from orders
"""
LOOKUPS = """
select username, case n % 10 when 3 then 404 when 5 then 403 when 6 then 429 when 8 then 500 else 200 end as http_status, case when n % 10 = 5 then '0' else '9' end as ratelimit_remaining
from (select distinct 'user' || cast(c_custkey % 400 as varchar(10)) as username, c_custkey % 400 as n from customer) u where n % 50 <> 49
"""
NOW = "1998-08-02 00:00:00"
CALLS_SPARK = "select cast(user_id as string) as key, timestampdiff(microsecond, timestamp_ntz'1970-01-01 00:00:00', ts) / 1000000.0D as ts, event_id as seq, 1.0D + event_id % 3 as cost, event_type, value from events"
CALLS_DUCK = "select cast(user_id as varchar) as key, epoch_us(ts) / 1000000.0::double as ts, event_id as seq, (1 + event_id % 3)::double as cost, event_type, value from events"
#: Tries of a model's service, a few for each customer: an HTTP error, or an answer that is good or bad.
ATTEMPTS = " union all ".join(
    f"select c_custkey as file_ord, {i} as attempt, case (c_custkey * 7 + {i * 3}) % 6 when 0 then 503 when 1 then 401 when 2 then 429 end as http_status, case when (c_custkey + {i}) % 3 = 0 then 'good{i}' else 'bad' end as answer from customer"
    for i in range(4)
)
#: A text a nation, long enough to be read, with letters that normalisation changes in some.
PAGES = """
select n_nationkey as n, 'Notes on ' || n_name || chr(10) || case when n_nationkey % 3 = 0 then 'ﬁne ² Ａｂ ①' else 'plain words' end || ' of region ' || cast(n_regionkey as varchar(10)) || ', written down at some length by hand over years' || case when n_nationkey % 5 = 0 then '' else ' and more' end as text
from nation
"""
#: What normalisation makes of it, by the letters that occur.
PAGE_LETTERS = {"ﬁ": "fi", "²": "2", "Ａ": "A", "ｂ": "b", "①": "1"}
#: A cache of handles: entries of different age, every third without repositories.
HANDLES = """
select 'User' || cast(c_custkey as varchar(10)) as username, c_custkey % 40 as hours, case when c_custkey % 3 = 0 then 0 else 1 end as has from customer
"""
