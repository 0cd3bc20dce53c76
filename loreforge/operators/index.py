"""Inverted index at any grain: postings, document frequencies, positions for phrases, and BM25 over batches of queries.

A document is one row, so its postings are made where it is: documents are hashed by id
once, and the words of one never leave their task. Postings carry the length of their
document, which spares scoring a join, and the vocabulary carries document frequencies,
which spares it a pass over the hits. Positions are a table of their own, made only when
a query has a phrase.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreforge.functions.text import index_tokens, query_terms, stem
from loreforge.session import observed_table, table

K1, B = 1.2, 0.75
COLUMN_GAP = 1 << 20  # phrases never reach from one column into the next
SENT = 200_000  # query words that are broadcast at most; a larger batch of queries is shuffled to the postings


@dataclass(frozen=True)
class Index:
    """``postings(term, id, tf, dl)``, ``lengths(id, dl)``, ``vocabulary(term, df)`` and ``spots(term, id, positions)``.

    ``keep(name, frame)`` stores a table when it is first read; without it tables are computed on each use.
    """

    made_postings: DataFrame
    made_lengths: DataFrame
    made_spots: DataFrame
    keep: Callable[[str, Callable[[], DataFrame]], DataFrame] | None = None

    def _kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        return self.keep(name, make) if self.keep else make()

    @cached_property
    def postings(self) -> DataFrame:
        return self.keep("postings", lambda: self.made_postings.sortWithinPartitions("term")) if self.keep else self.made_postings

    @cached_property
    def lengths(self) -> DataFrame:
        return self._kept("lengths", lambda: self.made_lengths)

    @cached_property
    def vocabulary(self) -> DataFrame:
        return self._kept("vocabulary", lambda: self.postings.groupBy("term").agg(F.count("*").alias("df")))

    @cached_property
    def spots(self) -> DataFrame:
        return self.keep("spots", lambda: self.made_spots.sortWithinPartitions("term")) if self.keep else self.made_spots

    def stored(self, keep: Callable[[str, Callable[[], DataFrame]], DataFrame] | None = None) -> Index:
        """The index with tables that are written when first read: by ``keep``, or to the shared folder of this session.

        Rows are sorted by term within files, so that lookups skip row groups. Files stay hashed
        by document: a word that is in every document is spread over all of them.
        """
        return Index(self.made_postings, self.made_lengths, self.made_spots, keep or (lambda name, make: table(make(), name)))

    def write(self, folder: str) -> None:
        """The index as parquet tables under ``folder``, to be opened by ``opened`` in any later session."""
        for name in ("postings", "lengths", "spots", "vocabulary"):
            getattr(self, name).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")

    @cached_property
    def stats(self) -> DataFrame:
        return self._kept("stats", lambda: self.lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")))


def opened(spark: SparkSession, folder: str) -> Index:
    """The index that ``Index.write`` left in a folder."""
    at = lambda name: spark.read.parquet(f"{folder}/{name}")
    return Index(at("postings"), at("lengths"), at("spots"), lambda name, make: make() if name == "stats" else at(name))


def build(docs: DataFrame, columns: list[str], key: str = "id") -> Index:
    """Index the text of ``columns``. Null columns count as empty; repeated ids must be resolved before."""
    tokens = [index_tokens(F.col(c)) for c in columns]
    parts = docs.select(F.col(key).alias("id"), F.array(*tokens).alias("t")).withColumn("dl", F.aggregate("t", F.lit(0), lambda s, x: s + F.size(x)))
    here = parts.repartition("id")
    words = here.select("id", "dl", F.explode(F.flatten("t")).alias("term"))
    postings = words.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl")).select("term", "id", "tf", "dl")
    placed = here.select("id", F.posexplode("t").alias("c", "w")).select("id", "c", F.posexplode("w").alias("p", "term"))
    spots = placed.groupBy("id", "term").agg(F.array_sort(F.collect_list(F.col("c") * COLUMN_GAP + F.col("p"))).alias("positions")).select("term", "id", "positions")
    return Index(postings, parts.select("id", "dl"), spots)


def update(index: Index, changed: DataFrame, columns: list[str], removed: DataFrame | None = None, key: str = "id") -> Index:
    """The index after ``changed`` documents were rewritten and ``removed(id)`` dropped: old rows out, new rows in."""
    fresh = build(changed, columns, key)
    gone = changed.select(F.col(key).alias("id"))
    if removed is not None:
        gone = gone.unionByName(removed.select(F.col(key).alias("id")))
    gone = gone.distinct()
    after = lambda old, new: old.join(gone, "id", "left_anti").select(old.columns).unionByName(new)
    return Index(after(index.postings, fresh.postings), after(index.lengths, fresh.lengths), after(index.spots, fresh.spots))


def plan_queries(queries: DataFrame) -> DataFrame:
    """``queries(query_id, query)`` to their plan: terms, stems and which retrievers apply.

    ``has_all``: two terms or more. ``has_prefix``: some stem differs from its term.
    """
    q = queries.withColumn("terms", query_terms(F.col("query")))
    q = q.withColumn("stems", F.transform("terms", stem))
    q = q.withColumn("has_all", F.size("terms") >= 2).withColumn("has_prefix", F.exists(F.zip_with("terms", "stems", lambda a, b: a != b), lambda x: x))
    return table(q, "plan")  # every retriever reads it


def phrases(plan: DataFrame, source: str) -> DataFrame:
    """``(query_id, phrase, parts)``: one row per term; a term with ``_`` is a phrase of several index tokens."""
    rows = plan.select("query_id", F.explode(source).alias("phrase")).withColumn("parts", index_tokens(F.col("phrase")))
    return rows.filter(F.size("parts") > 0)


def _prefix_words(index: Index, prefixes: DataFrame) -> DataFrame:
    """``(prefix, term)``: the index words that begin with each prefix, as an equi-join on the heads of words up to the longest prefix."""
    asked = prefixes.distinct()
    longest = asked.agg(F.coalesce(F.max(F.length("prefix")), F.lit(0)).alias("most"))
    heads = index.vocabulary.select("term").crossJoin(F.broadcast(longest)).filter("most > 0")  # one row
    cut = F.transform(F.sequence(F.lit(1), F.least("most", F.length("term"))), lambda n: F.substring("term", F.lit(1), n))
    return heads.select("term", F.explode(cut).alias("prefix")).join(asked, "prefix").select("prefix", "term")


def _sent(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def matches(index: Index, wanted: DataFrame, prefix: bool = False, several: bool = True, few: bool = False) -> DataFrame:
    """``(phrase, id, tf, dl)`` of distinct ``wanted(phrase, parts)``; with ``prefix`` the last part is a prefix.

    Single words read their postings; phrases line up the positions of their parts.
    ``several``: whether some phrase may have more than one part; ``few``: whether the phrases
    are few enough to be sent to the postings.
    """
    w = wanted.select("phrase", "parts").dropDuplicates(["phrase"]).withColumn("m", F.size("parts"))
    one = w.filter("m = 1").select("phrase", F.col("parts")[0].alias("term"))
    many = w.filter(F.col("m") > 1 if several else F.lit(False)).select("phrase", "m", F.posexplode("parts").alias("j", "term"))
    if prefix:
        last = many.filter(F.col("j") == F.col("m") - 1).withColumnRenamed("term", "prefix")
        grown = _prefix_words(index, one.select(F.col("term").alias("prefix")).unionByName(last.select("prefix")))
        one = one.withColumnRenamed("term", "prefix").join(grown, "prefix").select("phrase", "term")
        few = False  # the words grown from them may be many
        many = many.filter(F.col("j") < F.col("m") - 1).unionByName(last.join(grown, "prefix").select("phrase", "m", "j", "term"))
    single = index.postings.join(_sent(one, few), "term").select("phrase", "id", "tf", "dl")
    if prefix:
        single = single.groupBy("phrase", "id").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))
    if not several:
        return single
    spots = index.spots.join(_sent(many, few), "term").select("phrase", "m", "id", "j", F.explode("positions").alias("pos"))
    spots = spots.withColumn("at", F.col("pos") - F.col("j"))
    lined = spots.groupBy("phrase", "m", "id", "at").count().filter(F.col("count") == F.col("m"))
    lined = lined.groupBy("phrase", "id").agg(F.count("*").alias("tf")).join(index.lengths, "id")
    return single.unionByName(lined.select("phrase", "id", "tf", "dl"))


def bm25(index: Index, wanted: DataFrame, prefix: bool = False) -> DataFrame:
    """``(query_id, id, score, n_matched)`` of ``wanted(query_id, phrase, parts)``; lower scores are better.

    A phrase in more than half of the documents keeps a tiny weight instead of a negative
    one. Scores are rounded to nine places, so that equal ones tie.
    """
    facts = {"several": F.count_if(F.size("parts") > 1), "words": F.sum(F.size("parts"))}
    wanted, seen = observed_table(wanted.select("query_id", "phrase", "parts").distinct(), "wanted", **facts)
    few = (seen["words"] or 0) <= SENT
    hits = matches(index, wanted, prefix, seen["several"] > 0, few)
    if prefix or seen["several"]:
        hits = table(hits, "hits")  # read for the frequencies and for the scores
        df = hits.groupBy("phrase").agg(F.count("*").alias("df"))
    else:
        df = wanted.select("phrase", F.col("parts")[0].alias("term")).distinct().join(index.vocabulary, "term").select("phrase", "df")
    idf = F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = df.crossJoin(F.broadcast(index.stats)).select("phrase", "avgdl", F.greatest(idf, F.lit(1e-6)).alias("idf"))  # one row of statistics
    norm = K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    gain = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    asked = wanted.select("query_id", "phrase")
    if few:  # one row per phrase with its queries: the gain of a hit is worked out once for all of them
        by_phrase = asked.groupBy("phrase").agg(F.collect_list("query_id").alias("queries")).join(weights, "phrase")
        scored = hits.join(F.broadcast(by_phrase), "phrase").select(F.explode("queries").alias("query_id"), "id", gain.alias("gain"))
    else:
        scored = hits.join(weights, "phrase").select("phrase", "id", gain.alias("gain")).join(asked, "phrase").select("query_id", "id", "gain")
    return scored.groupBy("query_id", "id").agg(F.round(-F.sum("gain"), 9).alias("score"), F.count("*").alias("n_matched"))
