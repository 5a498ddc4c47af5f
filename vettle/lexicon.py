"""The screening vocabulary as data: patterns are Java and RE2 alike, but for the marked look-ahead.

`java(p)` makes a pattern case-insensitive as the engine uses it: Unicode classes, Unix lines.
"""

from __future__ import annotations

import re
from functools import cache

# Fixed values, in natural order.

#: Phrases about using AI tools, which are blanked before any match.
NOISE = (
    r"\b(?:ai|llm|gen(?:erative)?[- ]?ai)[- ]assisted\s+\w+(?:\s+\w+)?|\bgithub copilot\b|\bcopilot\b|"
    r"\bai (?:coding |development )?tools?\b|\bvibe[- ]?coding\b|\bcursor ide\b"
)

#: (name, pattern, tier)
SKILLS: tuple[tuple[str, str, str], ...] = (
    ("LangChain", r"\blang[- ]?chain\b", "strong"),
    ("LangGraph", r"\blang[- ]?graph\b", "strong"),
    ("LlamaIndex", r"\bllama[- ]?index\b", "strong"),
    ("Google ADK", r"\bgoogle adk\b|\bagent development kit\b|(?-i:\bADK\b)", "strong"),
    ("CrewAI", r"\bcrew ?ai\b", "strong"),
    ("AutoGen", r"\bauto-?gen\b", "strong"),
    ("Semantic Kernel", r"\bsemantic kernel\b", "strong"),
    ("Haystack/DSPy", r"\bhaystack\b|\bdspy\b", "strong"),
    ("RAG", r"(?-i:\bRAG\b)|retrieval[- ]augmented", "strong"),
    ("Vector DB", r"\bvector (?:db|database|store|search|index)\w*|\bfaiss\b|\bchroma(?:db)?\b|\bpinecone\b|\bqdrant\b|\bweaviate\b|\bpgvector\b|\bmilvus\b", "strong"),
    ("Embeddings", r"\bembeddings?\b|\bsemantic search\b", "strong"),
    ("Tool Calling", r"\btool[- ]?(?:calling|use)\b|\bfunction[- ]calling\b", "strong"),
    ("MCP", r"(?-i:\bMCP\b)|model context protocol", "strong"),
    ("Agentic", r"\bagentic\b|\bmulti[- ]agents?\b|\b(?:ai|llm|autonomous|conversational|voice|research|coding) agents?\b|\breact agent\b", "strong"),
    ("LLM Evaluation", r"\bllm[- ]as[- ](?:a[- ])?judge\b|\bragas\b|\bllm eval\w*|\bevals\b", "strong"),
    ("LLM", r"\bllms?\b|\blarge language models?\b|\bgenerative ai\b|\bgenai\b|\bprompt engineering\b", "llm"),
    ("OpenAI", r"\bopenai\b|\bgpt[- ]?(?:3|4|5|4o)\w*|\bchatgpt\b", "llm"),
    ("Gemini", r"\bgemini\b", "llm"),
    ("Claude/Anthropic", r"\bclaude\b|\banthropic\b", "llm"),
    ("Open-source LLMs", r"\bollama\b|\bvllm\b|\bmistral\b|\bllama ?[23]\b|\bgroq\b", "llm"),
    ("HuggingFace", r"\bhugging ?face\b|\btransformers\b", "llm"),
    ("Chatbot", r"\bchat ?bots?\b|\bconversational ai\b", "llm"),
    ("NLP", r"\bnlp\b|natural language processing", "llm"),
    ("Scikit-learn", r"\bscikit-?learn\b|\bsklearn\b", "ml"),
    ("PyTorch", r"\bpytorch\b", "ml"),
    ("TensorFlow/Keras", r"\btensorflow\b|\bkeras\b", "ml"),
    ("ML/DL", r"\bmachine learning\b|\bdeep learning\b|\bneural networks?\b|\bcomputer vision\b|\bopencv\b|\byolo\w*\b|(?-i:\bCNN\b)|\bxgboost\b|\blightgbm\b", "ml"),
    ("Python", r"\bpython ?3?\b", "python"),
    ("FastAPI", r"\bfast ?api\b", "pyfw"),
    ("Flask", r"\bflask\b", "pyfw"),
    ("Django", r"\bdjango\b", "pyfw"),
    ("Pydantic", r"\bpydantic\b", "pylib"),
    ("Pandas/NumPy", r"\bpandas\b|\bnumpy\b", "pylib"),
    ("Streamlit/Gradio", r"\bstreamlit\b|\bgradio\b", "pylib"),
    ("Celery", r"\bcelery\b", "pylib"),
    ("Pytest", r"\bpytest\b", "pylib"),
    ("SQLAlchemy", r"\bsqlalchemy\b", "pylib"),
    ("PostgreSQL", r"\bpostgres(?:ql)?\b|\bpsql\b|\bsupabase\b", "db_pg"),
    ("Redis", r"\bredis\b", "db_redis"),
    ("MySQL/SQLite/SQL", r"\bmysql\b|\bsqlite\b|\bsql server\b|(?-i:\bSQL\b)|\bmongodb\b|\bdynamodb\b", "db_other"),
    ("Kafka/RabbitMQ", r"\bkafka\b|\brabbitmq\b|\bsqs\b|\bpub/?sub\b", "queue"),
    ("GCP", r"\bgcp\b|\bgoogle cloud\b|\bcloud run\b|\bbigquery\b|\bvertex ai\b|\bgke\b|\bfirebase\b", "cloud_gcp"),
    ("AWS", r"\baws\b|\bamazon web services\b|\bec2\b|\blambda\b|\bs3\b|\bsagemaker\b|\bbedrock\b", "cloud_other"),
    ("Azure", r"\bazure\b", "cloud_other"),
    ("Docker", r"\bdocker\b|\bcontainer(?:s|ized|ised)?\b", "docker"),
    ("Kubernetes", r"\bkubernetes\b|\bk8s\b|\bhelm\b", "k8s"),
    ("CI/CD", r"\bci/?cd\b|\bgithub actions\b|\bjenkins\b|\bgitlab ci\b", "cicd"),
    ("JavaScript/TypeScript", r"\bjavascript\b|\btypescript\b", "lang"),
    ("Java", r"\bjava\b", "lang"),  # a look-ahead against "script" would add nothing after \b
    ("C/C++", r"\bc\+\+\b", "lang"),
    ("React", r"\breact(?:\.?js)?\b", "frontend"),
    ("Next.js", r"\bnext\.?js\b", "frontend"),
    ("Node.js", r"\bnode(?:\.?js)?\b|\bexpress(?:\.?js)?\b|\bnestjs\b", "frontend"),
    ("Spring Boot", r"\bspring ?boot\b", "lang"),
)
PYTHON_IMPLIED = ("pyfw", "pylib")
AGENT = r"\bagents?\b"

DEPTH_DIMS: tuple[tuple[str, str], ...] = (
    ("retrieval", r"retriev|vector|embedding|faiss|chroma|pinecone|qdrant|weaviate|pgvector|semantic search|rerank|chunk|bm25|hybrid search|knowledge base"),
    ("orchestration_state", r"langgraph|state ?machine|stateful|orchestrat|multi[- ]agent|checkpoint|agent memory|conversation memory|planner|supervisor|react agent|crew|workflow engine|agent(?:ic)? workflows?|conditional routing|routing|human[- ]in[- ]the[- ]loop"),
    ("tools", r"tool[- ]?(?:calling|use)|function[- ]calling|\bmcp\b|model context protocol|(?:agent|api|external|custom|function) tools?\b"),
    ("evaluation", r"\bevals?\b|evaluat|benchmark|ragas|precision|recall|\bf1\b|accuracy|hallucinat|guardrail|llm[- ]as|test set"),
    ("data_processing", r"\bpars(?:e|ing|er)\b|ingest|\bocr\b|extract|\bpipeline|\betl\b|preprocess|schema|pydantic|structured output|json|classif|dedup|normaliz"),
    ("production", r"deployed|production|latency|throughput|real-?time|async|queue|cache|caching|streaming|\bsse\b|docker|kubernetes|cloud run|rate[- ]limit|concurren"),
)
STRUCTURAL = ("retrieval", "orchestration_state", "tools", "evaluation", "data_processing")

THIN = r"\bchat ?bots?\b|\bchatgpt\b|\bopenai api\b|\bgemini api\b|\bgpt[- ]?[345]\b|\bai[- ]powered\b|\bwrapper\b|\bprompt"
TUTORIAL = r"\btutorial\b|\budemy\b|\bcoursera\b|\bfollowing (?:a|the)\b|\bcourse project\b|\bclone of\b|\byoutube\b|\bbootcamp\b|\breplica of\b"
OWNERSHIP = r"\b(?:built|designed|implemented|architected|engineered|developed|created|led|owned|deployed|optimi[sz]ed|integrated|established|introduced)\b"

ENG_DEPTH: tuple[tuple[str, str], ...] = (
    ("testing", r"\bpytest\b|unit test|integration test|test coverage|\btdd\b|\btests?\b|\bqa\b"),
    ("architecture", r"microservice|event[- ]driven|clean architecture|design pattern|system design|modular|layered|domain[- ]driven|\bcqrs\b|architect"),
    ("caching", r"\bcach(?:e|ing|ed)\b|\blru\b|memoiz"),
    ("queues", r"\bkafka\b|rabbitmq|\bcelery\b|\bsqs\b|pub/?sub|message queue|job queue|background (?:job|task|worker)s?"),
    ("observability", r"observab|monitoring|prometheus|grafana|sentry|tracing|opentelemetry|cloudwatch|logging|telemetry"),
    ("concurrency", r"\basync\w*|concurren|\bthread|parallel|multiprocess|\bworkers?\b"),
    ("failure_handling", r"\bretr(?:y|ies)\b|fallback|circuit[- ]breaker|idempoten|rate[- ]limit|graceful|dead[- ]letter|timeout|backoff|fault[- ]toleran"),
)
BACKEND = r"\brest(?:ful)?\b|microservice|websocket|\bjwt\b|oauth|\bgraphql\b|\bgrpc\b|\bsse\b"
ASYNC = r"\basync\w*|\bawait\b|\bconcurren\w+|\bcelery\b|\bbackground (?:job|task|worker)s?\b"
DEPLOY = r"\bdeploy\w*|\bhosted\b|\bvercel\b|\brender\b|\bheroku\b|\bcloud run\b|\blive (?:link|demo)\b"
AI_REPO = r"llm|rag|agent|gpt|langchain|langgraph|embedding|vector|openai|gemini|nlp|transformer|chatbot|mcp|retriev|ml\b|machine.?learning|deep.?learning"

SECTIONS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("summary", ("summary", "professional summary", "profile", "objective", "career objective", "about me", "about")),
    ("skills", ("skills", "technical skills", "core competencies", "technologies", "tech stack", "skills & tools", "skills and tools", "technical proficiency", "tools & technologies", "key skills")),
    ("experience", ("experience", "work experience", "professional experience", "employment", "work history", "internships", "internship experience", "employment history", "relevant experience")),
    ("projects", ("projects", "key projects", "personal projects", "academic projects", "selected projects", "project experience", "notable projects", "side projects", "technical projects")),
    ("education", ("education", "academic background", "academics", "qualifications", "academic qualifications")),
    ("certifications", ("certifications", "certificates", "courses", "licenses", "licenses & certifications", "training", "coursework")),
    ("other", ("achievements", "awards", "honors", "extracurricular", "extracurriculars", "activities", "leadership", "publications", "positions of responsibility", "hobbies", "interests", "languages", "open source", "open-source contributions", "accomplishments", "volunteering")),
)
NON_EVIDENCE = ("education", "certifications")
BLOCK_SECTIONS = ("experience", "projects", "other")

BULLETS = "•●▪■◦‣∙○◆►➢"
EMAIL = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
GITHUB = r"github\.com/([A-Za-z0-9](?:[A-Za-z0-9-]{0,38}))(?:/([\w.-]+))?"
RESERVED = ("features", "about", "pricing", "topics", "marketplace", "sponsors", "orgs", "settings", "login", "enterprise", "collections", "explore", "apps", "notifications", "issues", "pulls", "security", "trending", "readme", "site", "contact", "customer-stories")
DATE = r"\b(?:19|20)\d{2}\b|\bpresent\b|\bcurrent\b"
NOT_A_NAME = r"resume|curriculum|vitae|engineer|developer|summary|profile|intern|\||/"
PY_BLOCK_SKILLS = ("LangGraph", "LangChain", "LlamaIndex", "PyTorch", "Scikit-learn")


def java(pattern: str, case: bool = False) -> str:
    """The pattern with Unicode classes and Unix lines, case-insensitive unless `case`."""
    return ("(?Ud)" if case else "(?iUd)") + pattern


@cache
def needed(pattern: str) -> tuple[str, ...]:
    """Small-letter literals of which every match has one, whatever its case; none if the pattern has no such."""
    return _needed(re._parser.parse(pattern)) or ()


@cache
def begins(pattern: str) -> tuple[str, ...]:
    """Small-letter literals of which every match begins with one, whatever its case; none if the pattern has no such."""
    return _begins(re._parser.parse(pattern)) or ()


def _begins(parts) -> tuple[str, ...] | None:
    run = ""
    for op, arg in [*parts, (None, None)]:
        op = str(op)
        if op == "LITERAL":
            run += chr(arg)
        elif run:
            return (run.lower(),)
        elif op == "SUBPATTERN":
            return _begins(arg[3])
        elif op == "BRANCH":
            each = [_begins(x) for x in arg[1]]
            return None if None in each else tuple(dict.fromkeys(x for e in each for x in e))
        elif op == "MAX_REPEAT" and arg[0] > 0:
            return _begins(arg[2])
        elif op != "AT":
            return None
    return None


def _needed(parts) -> tuple[str, ...] | None:
    """The best of the places that each match has: the one whose shortest literal is longest."""
    found, run = [], ""
    for op, arg in [*parts, (None, None)]:
        op = str(op)
        if op == "LITERAL":
            run += chr(arg)
            continue
        found += [(run,)] if run else []
        run = ""
        if op == "SUBPATTERN":
            found.append(_needed(arg[3]))
        elif op == "BRANCH":
            each = [_needed(x) for x in arg[1]]
            found.append(None if None in each else tuple(dict.fromkeys(x for e in each for x in e)))
        elif op == "MAX_REPEAT" and arg[0] > 0:
            found.append(_needed(arg[2]))
    return max((tuple(x.lower() for x in f) for f in found if f), key=lambda f: (min(map(len, f)), -len(f)), default=None)
