"""The store as a whole: what learning, forgetting and repairing do to lessons, archive, passages, vectors and index together.

``Knowledge`` holds one version of all tables; every operation gives the next one and
touches only the rows of the lessons concerned. Nothing is computed before it is read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreforge.operators import chunking, embed, store
from loreforge.operators.index import Index, update
from loreforge.operators.retrieve import FIELDS

EMPTY_VECTORS = "id long, v array<float>, model string"


@dataclass(frozen=True)
class Knowledge:
    """``lessons``, ``archive``, ``passages(id, lesson_id, ord, text)``, ``vectors(id, v, model)`` and, where kept, the two indexes."""

    lessons: DataFrame
    archive: DataFrame
    passages: DataFrame
    vectors: DataFrame
    lesson_index: Index | None = None
    passage_index: Index | None = None

    def _changed(self, lessons: DataFrame, archive: DataFrame, made: DataFrame | None, gone: DataFrame) -> Knowledge:
        """After ``lessons`` replaced the table: ``made`` are its new or rewritten rows, ``gone(id)`` those to be followed everywhere."""
        dropped = self.passages.join(gone.select(F.col("id").alias("lesson_id")).distinct(), "lesson_id", "left_semi").select("id")
        passages = chunking.remove(self.passages, gone.select(F.col("id").alias("lesson_id"))).select("id", "lesson_id", "ord", "text")
        fresh = None if made is None else chunking.chunk(made.select("id", "content"))
        if fresh is not None:
            passages = passages.unionByName(fresh.select("id", "lesson_id", F.col("ord").cast("int").alias("ord"), "text"))
        none = self.lessons.limit(0)
        words = self.lesson_index and update(self.lesson_index, none if made is None else made, FIELDS, gone)
        texts = self.passage_index and update(self.passage_index, self.passages.limit(0) if fresh is None else fresh, ["text"], dropped)
        return Knowledge(lessons, archive, passages, self.vectors.join(dropped, "id", "left_anti").select(self.vectors.columns), words, texts)

    def learn(self, new: DataFrame) -> Knowledge:
        """New lessons with their passages and index entries; rows that ``store.problems`` names are an error to be looked for before."""
        lessons, made = store.learned(self.lessons, new)
        return self._changed(lessons, self.archive, made, made.select("id").limit(0))

    def forget(self, ids: DataFrame, reason: str | None = None, confirm: bool = False) -> Knowledge:
        """Lessons to the archive, their passages, vectors and index entries away; nothing without ``confirm``."""
        if not confirm:
            return self
        lessons, archive = store.forget(self.lessons, self.archive, ids, reason, True)
        return self._changed(lessons, archive, None, ids.select("id"))

    def restore(self, ids: DataFrame, confirm: bool = False) -> Knowledge:
        """The inverse of ``forget``: passages are made anew, vectors stay pending."""
        if not confirm:
            return self
        lessons, archive = store.restore(self.lessons, self.archive, ids, True)
        back = lessons.join(self.lessons.select("id"), "id", "left_anti").select(self.lessons.columns)
        return self._changed(lessons, archive, back, back.select("id"))

    def without_vectors(self, lesson_ids: DataFrame | None = None) -> Knowledge:
        """Without the vectors of these ``lesson_ids(lesson_id)``, or without any."""
        if lesson_ids is None:
            return replace(self, vectors=self.vectors.limit(0))
        own = self.passages.join(lesson_ids.select("lesson_id").distinct(), "lesson_id", "left_semi").select("id")
        return replace(self, vectors=self.vectors.join(own, "id", "left_anti").select(self.vectors.columns))

    def reindex(self, embedder: embed.Embedder, dim: int, model: str, force: bool = False, limit: int | None = None) -> tuple[Knowledge, DataFrame]:
        """All passages made anew, then vectors for those without one of ``model`` (all of them with ``force``); and a report.

        Vectors of another model and of passages that are gone are dropped, as they can no longer
        be compared. ``report`` is one row ``(embedded, failed, remaining)``.
        """
        passages = chunking.chunk(self.lessons.select("id", "content")).select("id", "lesson_id", F.col("ord").cast("int").alias("ord"), "text")
        kept = self.vectors.filter(F.col("model").eqNullSafe(F.lit(model))).select("id", "v").join(passages.select("id"), "id", "left_semi")
        after, report = embed.backfill(passages.select("id", "text"), kept, embedder, dim, limit, force)
        return replace(self, passages=passages, vectors=after.withColumn("model", F.lit(model))), report

    def counts(self) -> DataFrame:
        """``(place, n)``: rows of each table, and what is stranded or pending."""
        live = self.lessons.select(F.col("id").alias("lesson_id"))
        parts = {
            "lessons": self.lessons,
            "archive": self.archive,
            "passages": self.passages,
            "vectors": self.vectors,
            "stranded passages": self.passages.join(live, "lesson_id", "left_anti"),
            "stranded vectors": self.vectors.join(self.passages.select("id"), "id", "left_anti"),
            "pending passages": self.passages.join(self.vectors.select("id").distinct(), "id", "left_anti"),
        }
        rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("place"), "n") for name, df in parts.items()]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out


PATTERN = "id long, name string, pattern_type string, description string, example string, projects array<string>"


def store_patterns(patterns: DataFrame, new: DataFrame) -> DataFrame:
    """``patterns`` with ``new(name, pattern_type, description, example, projects)`` appended, numbered on by name."""
    made = store.numbered(new, patterns, [F.col("name"), F.col("description")])
    return patterns.unionByName(made.select("id", "name", "pattern_type", "description", "example", F.coalesce("projects", F.array().cast("array<string>")).alias("projects")))


def project_context(lessons: DataFrame, projects: DataFrame, patterns: DataFrame, asked: DataFrame) -> DataFrame:
    """``(project, kind, key, text)`` of each of ``asked(project)``: its index entry, all its lessons, and the patterns that list it.

    ``key`` is the name of the project or pattern or the id of the lesson. A project that is
    nowhere has no rows. Repeated names of the index give repeated entries.
    """
    names = asked.select("project").filter(F.col("project").isNotNull()).distinct()
    entry = projects.select(F.col("name").alias("project"), F.lit("project").alias("kind"), F.col("name").alias("key"), F.concat_ws(": ", "status", "description").alias("text"))
    own = lessons.select("project", F.lit("lesson").alias("kind"), F.col("id").cast("string").alias("key"), F.col("content").alias("text"))
    how = patterns.select(F.explode(F.array_distinct("projects")).alias("project"), F.lit("pattern").alias("kind"), F.col("name").alias("key"), F.col("description").alias("text"))
    return entry.unionByName(own).unionByName(how).join(names, "project", "left_semi").select("project", "kind", "key", "text")


def derive_project(folders: DataFrame, names: DataFrame) -> DataFrame:
    """``folders(folder)`` with ``project``: the longest of ``names(name)`` with which the flattened folder ends, else its last part.

    Separators and underscores are dashes in a flattened folder. Every ending of a folder at a
    dash is looked up, so that folders and names meet in an equi-join. Names of equal length:
    the first in the order of the alphabet. A folder without any part is ``unknown``.
    """
    flat = F.replace(F.col("folder"), F.lit("_"), F.lit("-"))
    parts = F.split(flat, "-")
    # the endings that begin after a dash
    endings = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(parts))), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "-"))
    known = names.select(F.col("name"), F.replace(F.col("name"), F.lit("_"), F.lit("-")).alias("ending")).filter(F.length("ending") > 0).distinct()
    ends = folders.select("folder").distinct().withColumn("ending", F.explode(endings)).join(known, "ending")
    best = ends.groupBy("folder").agg(F.min_by("name", F.struct(-F.length("name"), F.col("name"))).alias("named"))
    last = F.element_at(parts, -1)
    return folders.join(best, "folder", "left").withColumn("project", F.coalesce("named", F.when(last != "", last), F.lit("unknown"))).drop("named")
