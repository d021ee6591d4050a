"""Benchmark decontamination with a distributed positional inverted index.

Queries are sequences of words, all of whose windows are sought. A first pass over the corpus counts their terms. A second
one stores the index: the postings (term, document, position, and the words about it) of the rarest terms of windows, and
the length of each document. Then lists are intersected. The postings of a window's rarest term, and those of its second
rarest one shifted by the distance between the two, meet in one join, by term, distance and term, so that a frequent term
alone is no key; the other words are intersected from the inside out with the words that the posting holds, which gives
the whole range that document and query have in common. Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hirelake.llm._common import ascii_lower, checkpointed, free_name, read

WINDOW = 13
#: What separates words, after A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Terms that a pass over the corpus looks for, at most: they are broadcast. More take further passes.
MAX_BROADCAST = 200_000
#: Passes over the corpus; terms that would need more are met by a shuffle.
MOST_PASSES = 3
#: The term under which the index has the length of each document; no word has a separator.
LENGTH = "\n"


def split_words(text: Column) -> Column:
    """Words in order. Text that begins or ends with separators has an empty first or last word, which no query has."""
    return F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS)


def count_words(words: Column) -> Column:
    n = F.size(words)
    return (n - F.when(words[0] == "", 1).otherwise(0) - F.when((n > 1) & (F.element_at(words, -1) == ""), 1).otherwise(0)).cast("long")


def query_places(queries: DataFrame, window: int) -> DataFrame:
    """query (id), query_digest, n (words of the query), size (of its windows), word and place (from 0), and the words before
    and behind, for each word of queries. No row holds more of a query than is about its place."""
    words = F.filter(split_words(F.col("text")), lambda w: w != "")
    rows = queries.select(F.col("item_id").alias("query"), words.alias("words"), F.xxhash64("item_id", "text").alias("query_digest")).distinct()
    rows = rows.withColumns({"n": F.size("words"), "size": F.least(F.size("words"), F.lit(window))}).select("*", F.posexplode("words").alias("place", "word"))
    return rows.select("query", "query_digest", "n", "size", "place", "word", *around(F.col("words"), F.col("place"), window))


def passes_of(n: int) -> int:
    return max(1, -(-2 * n // MAX_BROADCAST)) if n > MAX_BROADCAST else 1


def occurrences(documents: DataFrame, terms: DataFrame, *columns: str, window: int = WINDOW) -> DataFrame:
    """The places (at, from 0) of the terms (column word) in documents (columns, words), and of LENGTH at -1. A few passes
    over documents with broadcast terms; if they would be more, one with a shuffle by term. Terms may have others, an array of
    words, all of which count as terms here."""
    parts = passes_of(terms.agg(F.coalesce(F.sum(F.size("others")), F.lit(0))).first()[0] if "others" in terms.columns else terms.count())
    rows = documents.select(*columns, "words", F.posexplode(F.concat(F.array(F.lit(LENGTH)), "words")).alias("after", "word"))
    if parts > MOST_PASSES:
        # Places and contexts go through the shuffle, not whole texts.
        n, context = count_words(F.col("words")), around(F.col("words"), F.col("after") - 1, window)
        return rows.select(*columns, "word", (F.col("after") - 1).alias("at"), n.alias("n_words"), *context).join(terms, "word")
    passes = [terms if parts == 1 else terms.where(F.pmod(F.xxhash64("word"), F.lit(parts)) == k) for k in range(parts)]
    found = reduce(DataFrame.unionByName, (rows.join(F.broadcast(part), "word") for part in passes))
    return found.withColumn("at", F.col("after") - 1).drop("after")


def counted(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """How often the terms (word) are in documents (words): word, n."""
    if passes_of(terms.count()) > MOST_PASSES:
        return documents.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).join(terms, "word", "left_semi")
    return occurrences(documents, terms).groupBy("word").agg(F.count("*").alias("n"))


def rarest_places(places: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """Of each window the places of its words from the rarest in the corpus on: query, query_digest, size, ranked (of words
    that the corpus has: n, word, place)."""
    by_query = Window.partitionBy("query", "query_digest").orderBy("place").rowsBetween(0, window - 1)
    places = places.select("query", "query_digest", F.col("n").alias("n_words"), "size", "place", "word")
    rated = places.join(counts, "word", "left").withColumn("ranked", F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "place")).over(by_query)))
    # A window starts wherever enough words follow.
    whole = rated.where(F.col("place") + F.col("size") <= F.col("n_words"))
    return whole.select("query", "query_digest", "size", F.filter("ranked", lambda x: x["n"] > 0).alias("ranked"))


def around(words: Column, place: Column, window: int) -> tuple[Column, Column]:
    """Up to window - 1 words before a place, the nearest first, and behind it."""
    low = F.greatest(place - (window - 1), F.lit(0))
    return F.reverse(F.slice(words, low + 1, F.greatest(place - low, F.lit(0)))).alias("before"), F.slice(words, place + 2, window - 1).alias("behind")


def sought_pairs(windows: DataFrame, places: DataFrame, pairs: tuple[tuple[int, int], ...]) -> DataFrame:
    """The places by which windows are sought, each once: query, size, word, step to the place of another word, other, and
    the query's words before and behind. pairs has ranks of words; in a window of one word the other is the word itself."""
    rank = lambda k: F.col("ranked")[F.least(F.lit(k), F.size("ranked") - 1)]
    chosen = [windows.where(F.size("ranked") > 0).select("query", "query_digest", rank(a).alias("one"), rank(b).alias("two")) for a, b in pairs]
    step = (F.col("two.place") - F.col("one.place")).alias("step")
    chosen = reduce(DataFrame.unionByName, chosen).select(F.col("query").alias("of_query"), F.col("query_digest").alias("of_digest"), F.col("one.place").alias("of_place"), step, F.col("two.word").alias("other")).distinct()
    here = F.col("query").eqNullSafe(F.col("of_query")) & (F.col("query_digest") == F.col("of_digest")) & (F.col("place") == F.col("of_place"))
    return places.join(chosen, here).select("query", "size", "word", "step", "other", "before", "behind")


def index(documents: DataFrame, terms: DataFrame, window: int) -> DataFrame:
    """The stored index of documents (key, words): word, key, at, doc_before and doc_behind for each place of a term; and
    with the word LENGTH, at being the number of words, a row for each document. Of terms with others only the places are
    stored that have one of these about them or are one themselves, and met names them."""
    length = terms.sparkSession.createDataFrame([(LENGTH,)], "word string")
    others = ["others"] if "others" in terms.columns else []
    found = occurrences(documents, terms.unionByName(length, allowMissingColumns=True), "key", window=window)
    is_length = F.col("word") == LENGTH
    if "words" in found.columns:
        found = found.select("word", "key", "at", *others, count_words(F.col("words")).alias("n_words"), *around(F.col("words"), F.col("at"), window))
    context = [F.when(~is_length, F.col(n)).alias(f"doc_{n}") for n in ("before", "behind")]
    if others:
        here = F.concat(F.array("word"), "before", "behind")
        found = found.where(is_length | F.arrays_overlap(here, "others"))
        context.append(F.when(~is_length, F.array_intersect(here, "others")).alias("met"))
    return checkpointed(found.select("word", "key", F.when(is_length, F.col("n_words")).otherwise(F.col("at")).cast("long").alias("at"), *context))


def common_prefix(a: Column, b: Column) -> Column:
    """Words that two arrays have in common at their starts."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return (F.when(differs == 0, F.least(F.size(a), F.size(b))).otherwise(differs - 1)).cast("int")


def farthest(words: Column, among: Column) -> Column:
    """How many words on the last one is that is among others; 0 for none."""
    return F.coalesce(F.array_max(F.transform(words, lambda w, i: F.when(F.array_contains(among, w), i + 1))), F.lit(0))


def exact_matches(postings: DataFrame, sought: DataFrame) -> DataFrame:
    """query, key, low, high: intersects the lists of two terms by a join, and the rest within the posting."""
    steps = sought.groupBy("word").agg(F.collect_set("step").alias("steps"))  # fewer than two windows' words of each term
    at_step = F.when(F.col("step") == 0, F.col("word")).when(F.col("step") < 0, F.try_element_at("doc_before", -F.col("step"))).otherwise(F.try_element_at("doc_behind", F.when(F.col("step") > 0, F.col("step")).otherwise(1)))
    asked = postings.join(steps, "word").select("word", "key", "at", "doc_before", "doc_behind", F.explode("steps").alias("step")).withColumn("other", at_step)
    found = asked.join(sought, ["word", "step", "other"])
    found = found.withColumn("left", common_prefix(F.col("before"), F.col("doc_before"))).withColumn("right", common_prefix(F.col("behind"), F.col("doc_behind")))
    found = found.where(F.col("left") + F.col("right") + 1 >= F.col("size"))
    return found.select("query", "key", (F.col("at") - F.col("left")).alias("low"), (F.col("at") + F.col("right")).alias("high")).distinct()


def near_matches(postings: DataFrame, sought: DataFrame, near: float) -> DataFrame:
    """query, key, low, high: a posting of a term with the other one about it, in any order, where a share of near of the
    query's words about the term is as well. low and high are the first and last of these words."""
    wanted = sought.select("query", "word", "other", F.array_union("before", "behind").alias("about")).distinct()
    asked = postings.select("word", "key", "at", "doc_before", "doc_behind", F.explode("met").alias("other"))
    shared = F.array_intersect("about", F.concat(F.array("word"), "doc_before", "doc_behind"))
    found = asked.join(wanted, ["word", "other"]).where(F.size(shared) >= near * F.size("about"))
    return found.select("query", "key", (F.col("at") - farthest(F.col("doc_before"), F.col("about"))).alias("low"), (F.col("at") + farthest(F.col("doc_behind"), F.col("about"))).alias("high")).distinct()


def find_phrases(documents: DataFrame, queries: DataFrame, window: int = WINDOW, near: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Matches of queries (item_id, text) in documents (key, words), and the lengths of documents (key, n_words).

    Matches have query, key, low, high, exact. Exact ones: the places low to high of a document equal part of a query and
    hold one of its windows (window words, or all words of a shorter query); each window that occurs lies within one.
    With near, also proximity matches, exact being False, of windows that any two of their three rarest terms in the
    corpus lead to, so that one of these may be another word; see near_matches.
    """
    places = checkpointed(query_places(queries, window))  # in proportion to the queries, as is what follows
    counts = checkpointed(counted(documents, places.select("word").distinct()))
    windows = checkpointed(rarest_places(places, counts, window))
    sought = checkpointed(sought_pairs(windows.where(F.size("ranked") == F.col("size")), places, ((0, 1),)))
    loose = checkpointed(sought_pairs(windows, places, ((0, 1), (0, 2), (1, 2)))) if near is not None else None
    if loose is None:
        terms = sought.select("word").distinct()
    else:  # a place is of use if one of the words is about it that a match by it has
        terms = sought.select("word", "other").unionByName(loose.select("word", "other")).groupBy("word").agg(F.collect_set("other").alias("others"))
    stored = index(documents, checkpointed(terms), window)
    postings = stored.where(F.col("word") != LENGTH)
    found = exact_matches(postings, sought).withColumn("exact", F.lit(True))
    if loose is not None:
        found = found.unionByName(near_matches(postings, loose, near).withColumn("exact", F.lit(False)))
    return found, stored.where(F.col("word") == LENGTH).select("key", F.col("at").alias("n_words"))


def covered(ranges: Column) -> Column:
    """Places in any of the ranges, an array of structs low, high."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end"))
    return F.aggregate(F.array_sort(ranges), start, lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["high"] - F.greatest(s["end"], r["low"] - 1))).alias("n"), F.greatest(s["end"], r["high"]).alias("end")))["n"]


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: float | None = None) -> DataFrame:
    """Returns doc_id, digest, n_words, n_hit, n_items, items (ids as text, sorted), items_sha256, contaminated: a row
    for each row of documents. With near, also n_near, the words in ranges that match exactly or by proximity, and near_items,
    the items of these ranges; see find_phrases.

    A null or empty text has no words, hits or items. A very long text is searched as a whole; its words are held in one
    row. A null item_id is hit like others but not named. Repeated rows of documents give repeated results; repeated items
    count once, and of windows that tie for the rarest term any gives the same hits. An empty benchmark hits nothing, no
    documents give no rows. Other columns are ignored.
    """
    rows = documents.select(F.struct("doc_id", F.xxhash64("doc_id", "text").alias("digest")).alias("key"), split_words(F.col("text")).alias("words"))
    found, lengths = find_phrases(rows, benchmark, window, near)

    def in_ranges(only: Column, words: str, items: str) -> list[Column]:
        ranges, named = F.when(only, F.struct("low", "high")), F.when(only, F.col("query").cast("string"))
        return [covered(F.collect_set(ranges)).alias(words), F.sort_array(F.collect_set(named)).alias(items)]

    wanted = [*in_ranges(F.col("exact"), "n_hit", "items"), *(in_ranges(F.lit(True), "n_near", "near_items") if near is not None else [])]
    hits = found.groupBy("key").agg(*wanted)
    hits = hits.withColumnsRenamed({"key": "hit"}).select(F.col("hit.doc_id").alias("hit_id"), F.col("hit.digest").alias("hit_digest"), *hits.columns[1:])
    out = lengths.select("key.doc_id", "key.digest", "n_words")
    out = out.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("digest") == F.col("hit_digest")), "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    more = [] if near is None else [F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.coalesce("near_items", F.array().cast("array<string>")).alias("near_items")]
    return out.select("doc_id", "digest", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), *more)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the benchmark's items in every document, by windows of 13 words."""
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("digest", "items")


def decontamination_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its exact hits and its words in ranges that share 0.8 of the words about a rare one."""
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), near=0.8).drop("digest", "items")


def keep_clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents without the contaminated ones. The ids of these meet the texts by a shuffle, without sorting texts."""
    id_, digest = free_name(documents, "bad_id"), free_name(documents, "bad_digest")
    bad = contamination(documents, benchmark).where("contaminated").select(F.col("doc_id").alias(id_), F.col("digest").alias(digest)).distinct()
    return documents.join(bad.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("doc_id", "text") == F.col(digest)), "left_anti")


OP5_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), sizes AS (SELECT DISTINCT least(len(w), 13) AS n FROM items WHERE len(w) > 0
), item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, list_slice(w, k, k + least(len(w), 13) - 1) AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS k FROM items WHERE len(w) > 0)
), doc_windows AS (
  SELECT r, n, k, list_slice(w, k, k + n - 1) AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM docs, sizes WHERE len(w) >= n)
), found AS (SELECT r, k, d.n, item_id FROM doc_windows d JOIN item_windows i ON d.n = i.n AND d.g = i.g
), places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT r, k, n FROM found)) GROUP BY r
), named AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN places USING (r) LEFT JOIN named USING (r)
"""
