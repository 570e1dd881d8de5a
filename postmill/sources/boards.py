"""Postings from files, structured payloads and listing pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.base import any_in, first_true
from ..functions.identity import canonical_url, external_id
from ..functions.markup import job_posting, with_fallback

RAW = """source string, source_job_id string, title string, company_name string, location string, remote_type string, employment_type string, experience_raw string,
salary_raw string, posted_time_raw string, source_url string, application_url string, description string, required_skills array<string>, preferred_skills array<string>"""

#: Schema of a board's structured payload.
PAYLOAD = """jobDetails array<struct<jobId string, title string, companyName string, jobDescription string, salary string, experienceStr string, experienceText string, workMode string,
jdURL string, staticUrl string, footerPlaceholderLabel string, createdDate string, tagsAndSkills string, placeholders array<struct<type string, label string>>>>"""


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of raw postings, or many such files; rows that do not parse go to _corrupt."""
    return spark.read.schema(RAW + ", _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def search(rows: DataFrame, query: str | None = None, roles: list[str] = (), locations: list[str] = (), include_remote: bool = True, limit: int | None = None) -> DataFrame:
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    keep = F.lit(True)
    if query:
        keep = keep & F.lower(F.concat_ws(" ", "title", "description", "company_name", "location")).contains(query.lower())
    if roles:
        keep = keep & any_in(low("title"), [r.lower() for r in roles])
    if locations:
        keep = keep & (any_in(low("location"), [x.lower() for x in locations]) | (F.lit(include_remote) & (F.col("remote_type") == "REMOTE")))
    out = rows.filter(keep)
    return out.limit(limit) if limit else out


def by_url(rows: DataFrame, url: str) -> DataFrame:
    return rows.filter((F.col("source_url") == url) | (F.col("application_url") == url)).limit(1)


def from_payload(payload: Column, base_url: str) -> Column:
    """array<struct> of raw postings in a structured payload."""
    parsed = F.from_json(payload, PAYLOAD)["jobDetails"]
    some = lambda c: F.nullif(c, F.lit(""))

    def posting(j: Column) -> Column:
        label = lambda kind: F.get(F.transform(F.filter(j["placeholders"], lambda p: p["type"] == kind), lambda p: p["label"]), 0)
        place = F.coalesce(some(label("location")), F.lit("India"))
        mode = F.lower(F.concat_ws(" ", j["workMode"], place))
        url = F.coalesce(some(j["jdURL"]), some(j["staticUrl"]), F.concat(F.lit("/job-listings-"), j["jobId"]))
        millis = F.try_to_number(j["createdDate"], F.lit("9999999999999")).cast("long")
        tags = F.coalesce(F.from_json(j["tagsAndSkills"], "array<string>"), F.split(j["tagsAndSkills"], ","), F.array().cast("array<string>"))
        return F.struct(
            j["jobId"].alias("source_job_id"),
            F.coalesce(j["title"], F.lit("")).alias("title"),
            F.coalesce(j["companyName"], F.lit("")).alias("company_name"),
            F.coalesce(some(j["jobDescription"]), F.concat(j["title"], F.lit(" role at "), j["companyName"], F.lit("."))).alias("description"),
            place.alias("location"),
            first_true((mode.contains("remote") | mode.contains("work from home"), F.lit("REMOTE")), (mode.contains("hybrid"), F.lit("HYBRID")), otherwise=F.lit("ONSITE")).alias("remote_type"),
            F.coalesce(some(j["experienceStr"]), some(j["experienceText"]), label("experience")).alias("experience_raw"),
            F.coalesce(some(j["salary"]), label("salary")).alias("salary_raw"),
            F.coalesce(some(j["footerPlaceholderLabel"]), F.when(millis > 0, F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd HH:mm:ss"))).alias("posted_time_raw"),
            F.when(url.startswith("http"), url).otherwise(F.concat(F.lit(base_url), url)).alias("source_url"),
            F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != "").alias("skills"),
        )

    return F.transform(parsed, posting)


class _Cards(HTMLParser):
    """Cards of a page: elements with a card class, or the page itself without one. A field has classes (or tag names) in order of preference; the text of the first one that has any counts."""

    VOID = {"img", "br", "hr", "input", "meta", "link"}

    def __init__(self, card: str | None, fields: dict[str, list[str]]):
        super().__init__(convert_charrefs=True)
        self.card, self.names = card, {c: (f, k) for f, classes in fields.items() for k, c in enumerate(classes)}
        self.cards: list[dict] = [] if card else [{"texts": {}}]
        self.stack: list[tuple[str, tuple[str, int] | None]] = []
        self.open: int | None = None if card else -1

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        classes = (attrs.get("class") or "").split()
        if self.open is None and self.card in classes:
            self.open = len(self.stack)
            self.cards.append({"urn": attrs.get("data-entity-urn") or attrs.get("data-job-id") or attrs.get("data-id"), "texts": {}})
        name = None
        if self.open is not None:
            name = min((self.names[c] for c in (*classes, tag) if c in self.names), key=lambda x: x[1], default=None)
            row = self.cards[-1]
            if tag == "a" and attrs.get("href"):
                row.setdefault("href", attrs["href"])
            if tag == "time" and attrs.get("datetime"):
                row.setdefault("datetime", attrs["datetime"])
        if tag not in self.VOID:
            self.stack.append((tag, name))

    def handle_endtag(self, tag):
        if not (self.stack and self.stack[-1][0] == tag) and all(t != tag for t, _ in self.stack):  # never opened
            return
        while self.stack:
            top, _ = self.stack.pop()
            if self.open is not None and len(self.stack) <= self.open:
                self.open = None
            if top == tag:
                break

    def handle_data(self, data):
        text = " ".join(data.split()) if self.open is not None else ""
        name = next((n for _, n in reversed(self.stack) if n), None) if text else None
        if name:
            texts = self.cards[-1]["texts"]
            texts[name] = f"{texts[name]} {text}" if name in texts else text

    def rows(self) -> list[dict]:
        """Cards with the text of each field."""
        best = lambda texts: {f: texts[f, k] for f, k in sorted(texts, key=lambda x: -x[1])}
        return [{**c, **best(c["texts"])} for c in self.cards]


class _Page(HTMLParser):
    """What a parser is told of a page, in order, to be told again to several; reading the page costs more than they do."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.told: list[tuple] = []
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.told.append((_Cards.handle_starttag, tag, attrs))

    def handle_endtag(self, tag):
        self.told.append((_Cards.handle_endtag, tag))

    def handle_data(self, data):
        self.told.append((_Cards.handle_data, data))

    def tell(self, cards: _Cards) -> None:
        for handle, *what in self.told:
            handle(cards, *what)


CARD = "id string, title string, company string, location string, time string, url string"
# Card classes and field classes of the boards, the likeliest first.
BOARDS = {
    "board1": (["base-search-card", "base-card"], {"title": ["base-search-card__title", "h3"], "company": ["base-search-card__subtitle", "h4"], "location": ["job-search-card__location"], "time": ["time"]}),
    "board2": (["srp-jobtuple-wrapper", "jobTuple"], {"title": ["title"], "company": ["comp-name", "subTitle"], "location": ["locWdth", "location"], "time": ["job-post-day"]}),
    "board3": (["individual_internship", "internship_meta"], {"title": ["job-internship-name", "profile"], "company": ["company-name", "company_name"], "location": ["locations", "location_link"], "time": ["status-success", "status-info"]}),
}
# Classes of a posting's own page.
DETAIL = {
    "title": ["top-card-layout__title", "topcard__title", "h1"], "company": ["topcard__org-name-link", "topcard__flavor", "sub-nav-cta__optional-url"],
    "description": ["show-more-less-html__markup", "description__text"], "location": ["topcard__flavor--bullet", "top-card-layout__first-subline"], "time": ["posted-time-ago__text", "time"],
}
# Company names that stand for none.
NO_COMPANY = ("company", "confidential", "hiring company")
#: Cards of a page that are looked at to choose its card class.
LOOKED_AT = 10


def choose_cards(page: str, classes: list[str], fields: dict[str, list[str]]) -> list[dict]:
    """The cards of the class that has the most with title and company among its first ones; ties go to the earlier class."""
    best, most, told = [], 0, None
    for card in classes:
        if card in page:
            told = told or _Page(page)
            parser = _Cards(card, fields)
            told.tell(parser)
            found = parser.rows()
            usable = sum(bool(c.get("title") and c.get("company")) for c in found[:LOOKED_AT])
            if usable > most or not best:
                best, most = found, usable
    return best


def cards(pages: DataFrame, key: str, html: str, classes: list[str], fields: dict[str, list[str]]) -> DataFrame:
    """key and one row per card with a title; ids within a page once. Nesting needs a parser, hence Arrow batches; pages without a card class never reach it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, page in zip(batch[key], batch[html]):
                for place, c in enumerate(choose_cards(page, classes, fields)):
                    if c.get("title"):
                        company = c.get("company")
                        rows.append((k, place, c.get("urn"), c["title"], None if company and company.lower() in NO_COMPANY else company, c.get("location"), c.get("datetime") or c.get("time"), c.get("href")))
            yield pd.DataFrame(rows, columns=[key, "place", "id", "title", "company", "location", "time", "url"])

    kind = pages.schema[key].dataType.simpleString()
    found = pages.filter(any_in(F.col(html), classes)).select(key, html).mapInPandas(run, f"{key} {kind}, place int, {CARD}")
    found = found.withColumns({"url": canonical_url(F.col("url")), "id": F.coalesce(external_id(F.col("id")), external_id(F.col("url")), F.col("url"))})
    first = found.groupBy(key, "id").agg(F.min_by(F.struct("title", "company", "location", "time", "url"), "place").alias("c"))  # on the page
    return first.select(key, "id", "c.*")


def extract(pages: DataFrame, key: str, html: str, schema: dict[str, list[str]]) -> DataFrame:
    """key and a column per field of the schema: the text of the first of its classes or tags that the page has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, page in zip(batch[key], batch[html]):
                parser = _Cards(None, schema)
                parser.feed(page or "")
                rows.append((k, *map(parser.rows()[0].get, schema)))
            yield pd.DataFrame(rows, columns=[key, *schema])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, " + ", ".join(f"{f} string" for f in schema))


def detail(pages: DataFrame, key: str, html: str, board: str = "board1") -> DataFrame:
    """key, record (title, company, location, description) and provenance: linked data first, then a card, then the page's headers."""
    record = lambda title, company, location, description: F.when(
        (F.coalesce(title, F.lit("")) != "") & (F.coalesce(company, F.lit("")) != ""),
        F.struct(title.alias("title"), company.alias("company"), F.coalesce(F.nullif(location, F.lit("")), F.lit("India")).alias("location"), F.coalesce(F.nullif(description, F.lit("")), F.concat(title, F.lit(" at "), company, F.lit("."))).alias("description")),
    )
    none = F.lit(None).cast("string")
    ld = job_posting(F.col(html))
    first = pages.withColumn("linked", record(ld["title"], ld["company_name"], ld["location"], ld["description"]))
    rest = first.filter("linked IS NULL").select(key, html)
    c = cards(rest, key, html, *BOARDS[board]).select(key, record(F.col("title"), F.col("company"), F.col("location"), none).alias("card"), F.col("id").alias("card_id")).filter("card IS NOT NULL")
    c = c.groupBy(key).agg(F.min_by("card", F.coalesce("card_id", F.lit(""))).alias("card"))
    h = extract(rest.join(c, key, "left_anti"), key, html, DETAIL).select(key, record(*[F.col(f) for f in ("title", "company", "location", "description")]).alias("header"))
    both = first.select(key, "linked").join(c, key, "left").join(h, key, "left")
    got = with_fallback(JSON_LD=F.col("linked"), CARD=F.col("card"), CSS_SELECTOR=F.col("header"))
    return both.select(key, got["record"].alias("record"), got["provenance"].alias("provenance"))


def yields(found: DataFrame, least: float = 0.85) -> DataFrame:
    """Share of cards with each field, and whether the page's layout has drifted."""
    share = lambda c: F.round(F.avg(F.when(F.coalesce(F.col(c), F.lit("")) != "", 1.0).otherwise(0.0)), 4)
    out = found.agg(F.count("*").alias("cards"), *[share(c).alias(f"{c}_yield") for c in ("title", "company", "location", "time")])
    return out.withColumn("degraded", (F.col("title_yield") < least) | (F.col("company_yield") < least))


# Search variants of skills, and the roles searched by default.
EXPANSIONS = {
    "javascript": ["javascript", "js"],
    "js": ["javascript", "js"],
    "typescript": ["typescript", "ts"],
    "ts": ["typescript", "ts"],
    "react": ["react", "react.js", "reactjs"],
    "react.js": ["react", "react.js", "reactjs"],
    "reactjs": ["react", "react.js", "reactjs"],
    "node.js": ["node.js", "nodejs", "node js"],
    "nodejs": ["node.js", "nodejs", "node js"],
    "node js": ["node.js", "nodejs", "node js"],
    "node": ["node.js", "nodejs", "node js"],
    "python": ["python", "python3"],
    "python3": ["python", "python3"],
}
CORE_ROLES = ["Software Engineer", "Full Stack Developer", "Backend Developer", "Frontend Developer"]


def search_terms(query: str | None, roles: list[str], skills: list[str], hours: int) -> list[str]:
    """Terms to search a board for; fewer for tight windows. A request is one row, known when the search is planned."""
    terms = [query.strip()] if query and query.strip() else []
    wanted = roles or ([] if terms else CORE_ROLES)
    terms += [r.strip() for r in wanted[: 2 if hours <= 1 else 3 if hours <= 4 else None]]
    if hours > 4:
        for s in (s.strip().lower() for s in skills):
            terms += EXPANSIONS.get(s, [s])[: 1 if hours <= 8 else None]
    unique = {}
    for t in terms:
        key = re.sub("[^a-z0-9]", "", t.lower())
        if key:
            unique.setdefault(key, t)
    return (list(unique.values()) or CORE_ROLES)[: 2 if hours <= 4 else 4 if hours <= 8 else 8]


def keyword_terms(query: str | None, roles: list[str], skills: list[str], hours: int) -> list[str]:
    """Terms to search board 2 for: the tightest window gets no variants of skills, a tight one four terms."""
    own = [query.strip()] if query and query.strip() else []
    if hours <= 1:
        return own or (roles or CORE_ROLES)[:2]
    terms = own + list(roles) if own else list(roles or CORE_ROLES)
    terms += [v for s in skills if (k := s.strip().lower()) for v in EXPANSIONS.get(k, [k])]
    unique = list(dict.fromkeys(terms))
    return unique[:4] if hours <= 4 else unique


# Categories of board 3 by skill, synonyms of roles, and words that say nothing.
SKILL_CATEGORIES = {
    "python": ["python-django"],
    "django": ["python-django"],
    "javascript": ["front-end-development", "full-stack-development"],
    "js": ["front-end-development", "full-stack-development"],
    "typescript": ["front-end-development", "full-stack-development"],
    "ts": ["front-end-development", "full-stack-development"],
    "react": ["front-end-development", "full-stack-development"],
    "react.js": ["front-end-development", "full-stack-development"],
    "reactjs": ["front-end-development", "full-stack-development"],
    "node.js": ["backend-development", "full-stack-development"],
    "nodejs": ["backend-development", "full-stack-development"],
    "node": ["backend-development", "full-stack-development"],
}
SYNONYMS = {
    "ai": ["ai", "machine learning", "ml", "genai", "llm", "deep learning", "nlp", "artificial intelligence"], "ml": ["machine learning", "ml", "data science"], "python": ["python", "django", "fastapi", "flask"],
    "full stack": ["full stack", "full-stack", "mern", "web development", "software engineer"], "backend": ["backend", "api developer", "platform engineer", "sde", "node", "express"],
    "frontend": ["frontend", "react", "next.js", "javascript", "typescript", "ui developer"],
}
GENERIC = ("software", "tech", "jobs", "internships", "it", "fresher", "engineering")
# For each kind of posting on board 3 its path, the category of the tightest window, those always searched beside skills, all of them, and categories by word.
PATHS = {
    "jobs": (
        "/jobs/{}-jobs/", "computer-science", ["computer-science", "full-stack-development"],
        ["computer-science", "backend-development", "full-stack-development", "python-django", "artificial-intelligence-ai", "machine-learning", "front-end-development"],
        {"ai": "artificial-intelligence-ai", "artificial intelligence": "artificial-intelligence-ai", "ml": "machine-learning", "machine learning": "machine-learning", "python": "python-django", "django": "python-django", "full stack": "full-stack-development",
         "fullstack": "full-stack-development", "backend": "backend-development", "frontend": "front-end-development", "front end": "front-end-development", "software": "computer-science", "computer science": "computer-science", "cs": "computer-science"},
    ),
    "internships": (
        "/internships/{}-internship/", "software-development", ["software-development", "computer-science"],
        ["software-development", "computer-science", "backend-development", "full-stack-development", "python-django", "artificial-intelligence-ai", "machine-learning", "front-end-development", "data-science"],
        {"software": "software-development", "cs": "computer-science", "computer science": "computer-science", "python": "python-django", "django": "python-django", "backend": "backend-development", "full stack": "full-stack-development", "fullstack": "full-stack-development",
         "ai": "artificial-intelligence-ai", "genai": "artificial-intelligence-ai", "ml": "machine-learning", "machine learning": "machine-learning", "frontend": "front-end-development", "front end": "front-end-development", "data science": "data-science"},
    ),
}


def category_paths(query: str | None, roles: list[str], skills: list[str], hours: int, kinds: tuple[str, ...] = ("jobs", "internships")) -> list[str]:
    """Paths of board 3 to read: by skills, or else by the words of query and roles, or else all; two of a kind for tight windows."""
    said = " ".join([(query or "").strip().lower(), *(r.strip().lower() for r in roles)]).strip()
    known = [c for s in skills for c in SKILL_CATEGORIES.get(s.strip().lower(), [])]
    found = []
    for path, tightest, core, every, words in (PATHS[k] for k in kinds):
        if hours <= 1:
            own = [tightest]
        elif skills:
            own = known + core
        elif said and said not in GENERIC:
            own = [c for w, c in words.items() if w in said] + [words[role] for role, names in SYNONYMS.items() if role in words and any(n in said for n in names)]
        else:
            own = every
        found.append([path.format(c) for c in dict.fromkeys(own)])
    # A kind for which nothing was found gets all of its paths.
    full = [own or [PATHS[k][0].format(c) for c in PATHS[k][3]] for k, own in zip(kinds, found)]
    return [p for own in full for p in (own[:2] if hours <= 4 else own)]


def classify_error(message: Column, status: Column) -> Column:
    """struct(category, retryable). What a source was told wrongly (no such board, a field map that is missing) is ``source_config``."""
    low = F.lower(F.coalesce(message, F.lit("")))
    blocked = status.isin(429, 999, 403) | any_in(low, ["rate limit", "too many requests", "challenge", "perimeter", "captcha", "blocked", "status 999", "status 429"])
    network = (status >= 500) | any_in(low, ["timeout", "timed out", "connection reset", "connecterror", "connection refused", "remotedisconnected", "ssl"])
    parse = any_in(low, ["jsondecodeerror", "attributeerror", "keyerror", "selector", "parse"])
    kind = first_true((F.coalesce(blocked, F.lit(False)), F.lit("rate_limit_block")), (F.coalesce(network, F.lit(False)), F.lit("transient_network")), (parse, F.lit("parse_extraction")), (low.startswith("source config"), F.lit("source_config")), otherwise=F.lit("fatal"))
    return F.struct(kind.alias("category"), (kind == "transient_network").alias("retryable"))


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def upload_problem(name: Column, content: Column, most: int = 10 * 1024 * 1024) -> Column:
    """Why an upload is refused; null for a good one."""
    ext = F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))
    starts = lambda magic: F.substring(content, 1, len(magic)) == F.lit(magic)
    return first_true(
        (content.isNull() | (F.length(content) == 0), F.lit("empty")),
        (F.length(content) > most, F.lit("too_large")),
        (~ext.isin(".pdf", ".docx", ".txt"), F.lit("unsupported")),
        ((ext == ".pdf") & ~starts(b"%PDF"), F.lit("bad_header")),
        ((ext == ".docx") & ~starts(b"PK\x03\x04"), F.lit("bad_header")),
    )


def quality(company: Column, salary: Column, url: Column, confidence: Column, n_skills: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    add = lambda test, points: F.when(F.coalesce(test, F.lit(False)), points).otherwise(0.0)
    total = (
        40.0 + add(F.length(F.trim(company)) > 2, 20.0) + add((salary != "") & ~F.lower(salary).contains("not disclosed"), 15.0) + add(low.contains("apply") | low.contains("careers"), 15.0)
        + F.when(confidence == "HIGH", 10.0).when(confidence == "MEDIUM", 5.0).otherwise(0.0) + add(n_skills >= 3, 5.0)
    )
    return F.least(F.lit(100.0), total)


def quality_by_salary(salary: Column, confidence: Column) -> Column:
    """Of boards 1 and 2; salary: true where one is given."""
    return 75.0 + F.when(F.coalesce(salary, F.lit(False)), 15.0).otherwise(0.0) + F.when(confidence == "HIGH", 10.0).otherwise(0.0)


def quality_by_detail(salary: Column, description: Column, confidence: Column, n_skills: Column, extraction: Column) -> Column:
    """Of board 3: detail and skills count too, and an uncertain extraction takes off; 100 at most."""
    length = F.length(F.coalesce(description, F.lit("")))
    text = F.when(length >= 350, 10.0).when(length >= 200, 5.0).otherwise(0.0)
    skills = F.when(n_skills >= 3, 10.0).when(n_skills >= 1, 5.0).otherwise(0.0)
    return F.least(F.lit(100.0), quality_by_salary(salary, confidence) + text + skills - F.when(F.coalesce(extraction < 0.6, F.lit(False)), 10.0).otherwise(0.0))


def described(description: Column, title: Column, company: Column) -> Column:
    """struct(description, confidence): a stand-in where there is none; sure from 200 characters on."""
    text = F.btrim(F.coalesce(description, F.lit("")))
    text = F.when(text == "", F.concat(title, F.lit(" at "), company, F.lit("."))).otherwise(text)
    return F.struct(text.alias("description"), F.when(F.length(text) >= 200, "HIGH").otherwise("LOW").alias("confidence"))
