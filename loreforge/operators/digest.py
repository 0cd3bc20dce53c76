"""Summaries of the store: session digest, dashboard, listings, contexts and candidates for a wider scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreforge.functions.text import first_line, query_terms
from loreforge.operators.joins import hot_key_join
from loreforge.operators.retrieve import severity_boosts

DIGEST, EXTRA = 12, 4

# Words that speak for a lesson about tools; a parameter of scope_candidates.
TOOL_MARKERS = (
    "bash", "zsh", "shell", "pipefail", "sigpipe", "stdin", "stdout", "stderr",
    "cron", "crontab", "ssh", "scp", "rsync", "chmod", "sudo", "grep", "sed", "awk",
    "git", "rebase", "commit", "branch", "worktree", "stash", "checkout", "merge",
    "npm", "npx", "node", "pnpm", "yarn", "pip", "composer", "brew", "docker",
    "nvm", "fnm", "asdf", "gyp", "abi", "prebuilt",
    "http", "https", "json", "yaml", "regex", "utf", "unicode", "sql", "sqlite",
    "fts5", "wal", "curl", "webhook", "oauth",
    "mcp", "hook", "hooks", "agent", "llm", "prompt", "token", "tokens",
)


def severity_rank(s: Column) -> Column:
    return F.when(s == "critical", 0).when(s.isin("important", "high"), 1).otherwise(2)


def session_digest(lessons: DataFrame, projects: DataFrame, named: list[str] | None = None) -> DataFrame:
    """``(project, rank, id)``: what a session in each of ``projects(project)`` opens with.

    First the project's own lessons (a work tree inherits its parent's: the lesson's project is
    a prefix), by severity and recency, at most 12; then global ones of other projects, at most
    4; then critical ones of the ``named`` projects, up to 16 in all. Equal contents are shown
    once, the earliest stage first (the first stage keeps its own repeats).
    """
    names = projects.select(F.col("project").alias("asked")).distinct()
    prefixes = names.withColumn("p", F.explode(F.transform(F.sequence(F.lit(1), F.length("asked")), lambda n: F.substring("asked", F.lit(1), n))))
    cols = ["asked", "id", "content", "severity", "updated_at"]
    own = prefixes.join(lessons.withColumnRenamed("project", "p"), "p").select(*cols, F.lit(0).alias("stage"))
    far = lessons.filter(F.coalesce("scope", F.lit("project")) == "global")
    w0 = Window.partitionBy("asked").orderBy(severity_rank(F.col("severity")), F.desc("updated_at"), "id")
    own = own.withColumn("n", F.row_number().over(w0)).filter(F.col("n") <= DIGEST)
    crit = F.when(F.col("severity") == "critical", 0).otherwise(1)
    # a global lesson serves every project, so each project needs only the best few of the others
    wg = Window.partitionBy("project").orderBy(crit, F.desc("updated_at"), "id")
    heads = far.withColumn("g", F.row_number().over(wg)).filter(F.col("g") <= EXTRA).drop("g")
    total = heads.orderBy(crit, F.desc("updated_at"), "id").limit(EXTRA * 2)  # at most 4 can belong to the asking project
    wide = names.join(F.broadcast(total), ~F.col("asked").eqNullSafe(F.col("project"))).select(*cols, F.lit(1).alias("stage"))
    w1 = Window.partitionBy("asked").orderBy(crit, F.desc("updated_at"), "id")
    wide = wide.withColumn("n", F.row_number().over(w1)).filter(F.col("n") <= EXTRA)
    rows = own.unionByName(wide)
    if named:
        more = lessons.filter((F.col("severity") == "critical") & F.col("project").isin(named)).orderBy(F.desc("updated_at"), "id").limit(EXTRA)
        rows = rows.unionByName(names.join(F.broadcast(more.select("id", "content", "severity", "updated_at")), F.lit(True)).select(*cols, F.lit(2).alias("stage"), F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("updated_at"), "id")).alias("n")))
    seen = Window.partitionBy("asked", "content").orderBy("stage", "n")
    kept = rows.withColumn("first", F.min("stage").over(Window.partitionBy("asked", "content"))).withColumn("d", F.row_number().over(seen))
    kept = kept.filter((F.col("stage") == 0) | ((F.col("first") == F.col("stage")) & (F.col("d") == 1)))
    order = Window.partitionBy("asked").orderBy("stage", "n")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= DIGEST + EXTRA).select(F.col("asked").alias("project"), "rank", "id")


def dashboard(lessons: DataFrame, as_of: Column | None = None) -> DataFrame:
    """``(section, name, n, value)``: totals, categories, projects, severities with their boost, and use.

    ``use`` has the lessons shown, and those older than 30 days that never were; a ``warning``
    row appears when critical and important lessons make up 60 % or more, as their boost then
    says little.
    """
    now = F.current_timestamp() if as_of is None else as_of
    none = F.lit(None).cast("double")
    per = lambda section, c: lessons.groupBy(F.coalesce(F.col(c), F.lit("")).alias("name")).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), "name", "n", none.alias("value"))
    boosts = severity_boosts(lessons).withColumnRenamed("severity", "name")
    sev = per("severity", "severity").drop("value").join(boosts, "name", "left").select("section", "name", "n", F.round(F.coalesce("boost", F.lit(1.0)), 9).alias("value"))
    old = F.col("created_at") < now - F.expr("INTERVAL 30 DAYS")
    one = lessons.agg(
        F.count("*").alias("lessons"), F.count_if(F.coalesce("shown_count", F.lit(0)) > 0).alias("shown"),
        F.count_if(old & (F.coalesce("shown_count", F.lit(0)) == 0)).alias("stale"), F.count_if(F.col("severity").isin("critical", "important")).alias("loud"),
    )
    lines = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(n).alias("name"), F.col(c).alias("n")) for s, n, c in (("total", "lessons", "lessons"), ("use", "shown", "shown"), ("use", "older than 30 days and never shown", "stale"), ("warning", "too many critical and important", "loud"))])
    facts = one.select(F.explode(lines).alias("x"), "lessons").filter((F.col("x.section") != "warning") | (F.col("x.n") >= 0.6 * F.col("lessons")) & (F.col("lessons") > 0))
    return facts.select("x.section", "x.name", "x.n", none.alias("value")).unionByName(per("category", "category")).unionByName(per("project", "project")).unionByName(sev)


def coverage_counts(lessons: DataFrame, passages: DataFrame, embedded: DataFrame) -> DataFrame:
    """One row of health counts: lessons, those without passages, global ones, passages, orphans, vectors, pending."""
    ids = lessons.select(F.col("id").alias("lesson_id"))
    p = passages.select("id", "lesson_id")
    e = embedded.select("id").distinct()
    parts = [
        lessons.agg(F.count("*").alias("lessons"), F.count_if(F.col("scope") == "global").alias("global_lessons")),
        ids.join(p.select("lesson_id").distinct(), "lesson_id", "left_anti").agg(F.count("*").alias("without_passages")),
        p.agg(F.count("*").alias("passages")),
        p.join(ids, "lesson_id", "left_anti").agg(F.count("*").alias("orphan_passages")),
        e.join(p, "id", "left_semi").agg(F.count("*").alias("embedded_passages")),
        e.join(p, "id", "left_anti").agg(F.count("*").alias("orphan_vectors")),
        p.join(e, "id", "left_anti").agg(F.count("*").alias("pending_passages")),
        p.join(e, "id", "left_semi").agg(F.countDistinct("lesson_id").alias("embedded_lessons")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.crossJoin(x)  # single rows
    return out


def project_names(lessons: DataFrame, projects: DataFrame) -> DataFrame:
    """``(name)``: projects of lessons and of the project index, lower case, of three letters or more."""
    every = lessons.select(F.col("project").alias("name")).unionByName(projects.select("name"))
    return every.select(F.lower(F.trim("name")).alias("name")).filter(F.length("name") >= 3).distinct()


def scope_candidates(lessons: DataFrame, projects: DataFrame, limit: int | None = 50, markers: tuple[str, ...] = TOOL_MARKERS, least: int = 2) -> DataFrame:
    """Lessons of one project that speak of tools and name no project: the first ``limit`` by id, most evidence first.

    A name counts as named when all its words are among the lesson's terms: names are joined on
    one of their words and only then held against the rest.
    """
    local = lessons.filter(F.coalesce("scope", F.lit("project")) != "global").select("id", "project", "severity", "content", query_terms(F.col("content")).alias("terms"))
    parts = project_names(lessons, projects).select(query_terms(F.col("name")).alias("parts")).filter(F.size("parts") > 0).distinct()
    keyed = parts.withColumn("word", F.array_max("parts"))
    naming = local.select("id", "terms", F.explode("terms").alias("word")).join(keyed, "word").filter(F.forall("parts", lambda p: F.array_contains("terms", p)))
    free = local.join(naming.select("id").distinct(), "id", "left_anti")
    found = free.withColumn("matched", F.array_sort(F.array_intersect("terms", F.array(*[F.lit(m) for m in markers])))).filter(F.size("matched") >= least)
    first = found if limit is None else found.orderBy("id").limit(limit)
    out = first.select("id", "project", "severity", first_line(F.col("content")).alias("preview"), "matched", F.size("matched").alias("n_matched"))
    return out.orderBy(F.desc("n_matched"), "id")


def lesson_listing(lessons: DataFrame, limit: int = 200) -> DataFrame:
    """The newest lessons with address and title."""
    title = F.concat(F.lit("["), F.coalesce("severity", F.lit("info")), F.lit("] "), F.substring(F.coalesce("content", F.lit("")), 1, 80))
    return lessons.orderBy(F.desc("created_at"), F.desc("id")).limit(limit).select("id", F.concat(F.lit("lesson://"), F.col("id").cast("string")).alias("uri"), title.alias("title"))


def project_listing(projects: DataFrame, limit: int = 200) -> DataFrame:
    uri = F.concat(F.lit("project://"), F.regexp_replace(F.url_encode("name"), r"\+", "%20"))
    return projects.orderBy("name").limit(limit).select("name", uri.alias("uri"))


def named_by(uri: Column) -> Column:
    """The id or name that an address of a listing stands for; null for any other text."""
    tail = F.regexp_extract(uri, "^(?:lesson|project)://(.+)$", 1)
    return F.when(tail != "", F.url_decode(F.replace(tail, F.lit("+"), F.lit("%2B"))))


def project_summary(lessons: DataFrame, projects: DataFrame) -> DataFrame:
    """``(name, status, description, stack, lesson, severity, created_at)``: every project of either table with its lessons, one row each.

    A project without lessons has one row with a null lesson. Readers sort by name, severity
    (descending by name), newest first; no project's lessons are ever gathered in one row.
    """
    mine = lessons.filter(F.col("project").isNotNull()).select(F.col("project").alias("name"), F.col("id").alias("lesson"), "severity", "created_at")
    index = projects.select("name", "status", "description", F.array_join("stack", ",").alias("stack"))
    return hot_key_join(mine, index.filter(F.col("name").isNotNull()), "name", "left").select("name", "status", "description", "stack", "lesson", "severity", "created_at").unionByName(
        index.join(mine.select("name").distinct(), "name", "left_anti").select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("lesson", "long"), ("severity", "string"), ("created_at", "timestamp"))])
    )
