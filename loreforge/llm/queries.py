"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreforge.llm import lang, leak, neardup, pack, repeat, runs, setjoin, split, vectors
from loreforge.llm.sql import SQL  # noqa: F401
from loreforge.session import table
from loreforge.tables import current, one_per_key, read, tag_array


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Lessons and passages that must be cut: those with more than one piece.

    Cutting comes first and picks its rows after, so that no text is shuffled.
    """
    made = read(spark, d, "lessons").withColumn("n", F.size(split.cuts(F.col("content"))))
    les = current(made.select("id", "updated_at", "loaded_at", "n"), "n").select(F.lit("lessons").alias("table_name"), F.col("id").alias("row_id"), "n")
    cut = read(spark, d, "lesson_chunks").withColumn("n", F.size(split.cuts(F.col("text"))))
    chu = one_per_key(cut.select("id", "loaded_at", "n"), "id", "n").select(F.lit("lesson_chunks").alias("table_name"), F.col("id").alias("row_id"), "n")
    return les.unionByName(chu).filter(F.col("n") > 1).select("table_name", "row_id")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every lesson and passage."""
    les = current(read(spark, d, "lessons"), "content").select(F.lit("lessons").alias("table_name"), F.col("id").alias("row_id"), F.col("content").alias("text"))
    chu = one_per_key(read(spark, d, "lesson_chunks"), "id", "text").select(F.lit("lesson_chunks").alias("table_name"), F.col("id").alias("row_id"), "text")
    return split.pieces(les.unionByName(chu))


def p1_whole(spark: SparkSession, d: str) -> DataFrame:
    """Every text put together again from what is new in each of its pieces: its hash, and whether all pieces keep the limit."""
    new = F.substring("text", F.col("overlap") + 1, F.length("text"))
    rows = p1_pieces(spark, d).select("table_name", "row_id", "ord", new.alias("new"), (F.length("text") <= split.LIMIT).alias("fits"))
    whole = F.array_join(F.array_sort(F.collect_list(F.struct("ord", "new")))["new"], "")  # no longer than the text
    return rows.groupBy("table_name", "row_id").agg(F.sha2(whole, 256).alias("hash"), F.every("fits").alias("fits"))


def _tag_sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tagged = current(read(spark, d, "lessons"), "tags").select("id", tag_array(F.col("tags")).alias("items"))
    members, reps = setjoin.classes(tagged, least=4)
    return table(members, "members"), table(reps, "reps")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of lessons with tag sets of similarity 0.6 or more."""
    members, reps = _tag_sets(spark, d)
    return runs.expand_pairs(setjoin.similar_pairs(reps, 0.6), members)


def p2_links(spark: SparkSession, d: str) -> DataFrame:
    """Every lesson with its class of equal tag sets and its number of similar lessons."""
    members, reps = _tag_sets(spark, d)
    return runs.links_per_id(setjoin.similar_pairs(reps, 0.6), members)


def p2_archive(spark: SparkSession, d: str) -> DataFrame:
    """Between two tables: archived lessons with the current lessons of similar tags."""
    arch = read(spark, d, "lessons_archive").groupBy("id").agg(F.max_by("tags", "archived_at").alias("tags")).select("id", tag_array(F.col("tags")).alias("items"))
    les = current(read(spark, d, "lessons"), "tags").select("id", tag_array(F.col("tags")).alias("items"))
    near = setjoin.similar_between(arch, les, 0.6, least=4)
    return near.select(F.col("id_left").alias("archived_id"), F.col("id_right").alias("lesson_id"), F.round("similarity", 6).alias("similarity"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "chunks_vec").select(F.col("chunk_id").alias("id"), F.col("embedding").alias("v"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of passages of cosine 0.90 or more, one among the five most similar of the other."""
    top = vectors.top_close(_vectors(spark, d), floor=0.9)
    return top.select(F.least("id", "neighbour").alias("chunk_a"), F.greatest("id", "neighbour").alias("chunk_b")).distinct()


def p3_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar passages, at any cosine, of each passage whose id is divisible by 100."""
    every = _vectors(spark, d)
    return vectors.nearest(every.filter(F.col("id") % 100 == 0), every)


def _near_lessons(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    texts = current(read(spark, d, "lessons"), "content").select("id", F.col("content").alias("text"))
    return neardup.near_duplicates(texts, size=3, threshold=0.5, least_words=10)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of lessons whose sets of three consecutive words have similarity 0.5 or more."""
    members, pairs = _near_lessons(spark, d)
    return runs.expand_pairs(pairs, members)


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every lesson with the group of near-duplicates it belongs to; one with fewer than ten words is alone."""
    members, pairs = _near_lessons(spark, d)
    found = neardup.groups(members, table(pairs, "pairs"))
    every = current(read(spark, d, "lessons"), "content").select("id")
    return every.join(found, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))


def p4_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its class of equal texts and its number of near-duplicates (five words, 0.8)."""
    texts = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    members, pairs = neardup.near_duplicates(texts, size=5, threshold=0.8, least_words=5)
    return runs.links_per_id(pairs, neardup.with_short(texts, table(members, "members"), 5))


def _model(spark: SparkSession, d: str) -> tuple[lang.Model, DataFrame]:
    labels = lang.latest_labels(read(spark, d, "lesson_labels"))
    texts = read(spark, d, "lessons").select("id", F.col("content").alias("text"))
    return lang.train(lang.training_sample(texts, labels)), labels


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Lessons in one language with a missing or wrong label; lessons and passages that mix languages."""
    model, labels = _model(spark, d)
    les = read(spark, d, "lessons").select("id", F.col("content").alias("text"), "updated_at", "loaded_at")
    les = current(lang.document_languages(les, model, ("updated_at", "loaded_at")), "languages").join(labels, "id", "left")
    wrong = (F.size("languages") > 1) | F.col("lang").isNull() | (F.col("lang") != F.element_at("languages", 1))
    les = les.filter((F.size("languages") > 0)).filter(wrong).select(F.lit("lesson").alias("unit"), F.col("id").alias("unit_id"), F.explode("languages").alias("lang"))
    chu = read(spark, d, "lesson_chunks").select("id", "text", "loaded_at")
    chu = one_per_key(lang.document_languages(chu, model, ("loaded_at",)), "id", "languages").filter(F.size("languages") > 1)
    return les.unionByName(chu.select(F.lit("passage").alias("unit"), F.col("id").alias("unit_id"), F.explode("languages").alias("lang")))


def p7_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every lesson with its main language, a confidence, and the languages with whole sentences."""
    model, _ = _model(spark, d)
    les = current(read(spark, d, "lessons"), "content").select("id", F.col("content").alias("text"))
    return lang.document_languages(les, model)


def p7_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every segment of every lesson and passage with its language and confidence."""
    model, _ = _model(spark, d)
    les = current(read(spark, d, "lessons"), "content").select("id", F.col("content").alias("text"))
    chu = one_per_key(read(spark, d, "lesson_chunks"), "id", "text")
    both = [lang.segment_languages(x, model).withColumn("unit", F.lit(u)) for x, u in ((les, "lesson"), (chu, "passage"))]
    return both[0].unionByName(both[1])


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document's pieces with their containers of 1,024 tokens.

    ``counted`` tells tokens counted by the tokenizer from the loader's estimates, taken where no tokenizer is at hand.
    """
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "n_tokens")
    tokenizer = pack.at_hand()
    sized = table(pack.count_tokens(docs, tokenizer), "sized")
    return pack.pack(sized).withColumnRenamed("id", "doc_id").withColumn("counted", F.lit(tokenizer is not None))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, the fewest that could hold the tokens, the share of unused room, and whether the tokens are counted."""
    used = p8_containers(spark, d).filter(F.col("container").isNotNull())
    n, t = F.countDistinct("container"), F.sum("tokens")
    unused = F.round(1 - t / (n * pack.CAPACITY), 6)
    return used.agg(n.alias("containers"), F.ceil(t / pack.CAPACITY).alias("least"), unused.alias("unused"), F.every("counted").alias("counted"))


def p8_whole(spark: SparkSession, d: str) -> DataFrame:
    """By the loader's estimates: every document's tokens over all its pieces, and whether every container it is in keeps the capacity."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "n_tokens")
    packed = table(pack.pack(pack.count_tokens(docs, None)), "packed")
    full = packed.groupBy("container").agg((F.sum("tokens") <= pack.CAPACITY).alias("fits"))
    rows = packed.join(full, "container", "left").withColumn("fits", F.coalesce("fits", F.col("tokens") == 0))
    return rows.groupBy(F.col("id").alias("doc_id")).agg(F.sum("tokens").alias("tokens"), F.every("fits").alias("fits"))


def _passages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return docs, read(spark, d, "eval_items").select("item_id", "passage")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the evaluation items that leaked into them."""
    return leak.leaked(*_passages(spark, d)).withColumnRenamed("id", "doc_id")


def p9_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """How documents and evaluation items overlap, with substitutions tolerated."""
    return leak.overlaps(*_passages(spark, d)).withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Documents and items with a run of 12 words or a quarter of the runs of four in common, and the share of them."""
    found = leak.overlaps(*_passages(spark, d)).filter(F.col("run12") | (F.col("shared") >= 0.25))
    return found.select(F.col("id").alias("doc_id"), "item_id", "run12", F.round("shared", 9).alias("shared"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which 30 % or more of the runs of five words are repeats."""
    return repeat.repetitive(_documents(spark, d)).select(F.col("id").alias("doc_id"))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """Every document's runs of five words and the share of them that are repeats."""
    every = repeat.bands(_documents(spark, d), exact=None)
    return every.select(F.col("id").alias("doc_id"), "runs", F.round("share", 9).alias("share"))


def p10_bands(spark: SparkSession, d: str) -> DataFrame:
    """Every document's compression ratios and band; runs and share of those in the repetitive band."""
    return repeat.bands(_documents(spark, d)).withColumnRenamed("id", "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_pieces, p1_whole, p2_found, p2_links, p2_archive, p3_found, p3_nearest, p4_found, p4_groups, p4_documents,
        p7_found, p7_languages, p7_segments, p8_containers, p8_fill, p8_whole, p9_found, p9_overlaps, p9_shares, p10_found, p10_shares, p10_bands,
    )
}
