"""Removal of repeated and nearly repeated lines by a deletion-neighbourhood join, with DataFrame functions only.

Lines are compared as sequences of words. Two lines are near if one insertion, deletion or substitution of a word makes
them equal; that is so exactly if a line without one word equals the other, or both without their word at the same place
are equal. So each line emits hashed keys of itself and of itself without each of its words, and equal keys are joined.

Two filters come first, neither of which can lose a near pair. Equal lines are merged. And since one edit leaves the
beginning or the end of both lines as it is, a line only emits its variants if another line has the same words at its
beginning or its end: first the same SIDE words, then, of those, the same half among lines of about its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm._common import checkpointed, free_name, read

#: Lines of fewer words are only compared for equality: one word of four is too much to differ.
MIN_WORDS = 5
#: Words at the beginning or the end that near lines of at least twice as many words have in common.
SIDE = 4
WHITE = " \t\r\x0b\x0c"
ORDER = ("no_id", "doc_id", "digest", "line")


def row_key(documents: DataFrame) -> DataFrame:
    return documents.withColumns({"no_id": F.col("doc_id").isNull(), "digest": F.xxhash64("doc_id", "text")})


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(WHITE))


def words_of(content: Column) -> Column:
    """Words of a trimmed line: what is between single blanks, so a second blank counts as an empty word."""
    return F.split(content, " ")


def has_words(content: Column, n: int) -> Column:
    """Whether a trimmed line has n words or more."""
    return F.substring_index(content, " ", n - 1) != content


def lines_of(documents: DataFrame, min_words: int) -> DataFrame:
    """Of each line with a word its place (no_id, doc_id, digest, line from 0), a hash of 128 bits, whether it may be near
    others and has 2 * SIDE words at most (short), and hashes of its beginning and its end if these are apart."""
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = row_key(documents.select("doc_id", "text")).select("no_id", "doc_id", "digest", F.posexplode_outer(split).alias("line", "content"))
    content = F.col("content")
    side = has_words(content, max(2 * SIDE, min_words))
    rows = rows.select(*ORDER, trimmed(content).alias("content")).where(content != "")
    return rows.select(
        *ORDER,
        F.xxhash64("content").alias("h1"),
        F.xxhash64(F.lit(1), "content").alias("h2"),
        (has_words(content, min_words) & ~has_words(content, 2 * SIDE + 1)).alias("short"),
        F.when(side, F.xxhash64(F.lit(0), F.substring_index("content", " ", SIDE))).alias("begins"),
        F.when(side, F.xxhash64(F.lit(1), F.substring_index("content", " ", -SIDE))).alias("ends"),
    )


def shared(keyed: DataFrame) -> DataFrame:
    """The rows whose key (column key) another row has too."""
    common = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return keyed.join(common, "key", "left_semi")


def half_keys(words: Column) -> Column:
    """Lines that differ in length by one at most have a class of lengths in common: classes are four lengths wide and
    begin at each even length. Of each class, the first and last words, as many as an edit cannot reach on both sides."""
    n = F.size(words)
    keys = []
    for shift in (0, 2):
        kind = F.floor((n + shift) / 4)
        half = F.greatest(F.floor((kind * 4 - shift - 1) / 2), F.lit(0)).cast("int")
        keys += [F.xxhash64(F.lit(shift), kind, F.slice(words, 1, half)), F.xxhash64(F.lit(shift + 1), kind, F.slice(words, n - half + 1, half))]
    return F.array(*keys)


def near_lines(lines: DataFrame) -> DataFrame:
    """lines has id, order (a struct that sorts by place) and content (trimmed); a line may be there twice in the same
    place. Returns the id of those that are near an earlier line. No pairs are made: of the lines with a key only the
    earliest is joined to the rest."""
    words, n = F.col("words"), F.size("words")
    # Keys are made once and stored: counting them and choosing by the counts are two passes over them.
    halves = lines.select("id", words_of(F.col("content")).alias("words")).select("id", half_keys(words).alias("keys"))
    some = shared(checkpointed(halves.select("id", F.explode("keys").alias("key")))).select("id").distinct()
    variants = lines.join(some, "id").select("id", words_of(F.col("content")).alias("words")).select("id", "words", F.explode(F.sequence(F.lit(0), n)).alias("place"))
    # Place 0 is the line itself.
    rest = [F.when(F.col("place") == 0, words).otherwise(F.slice(words, 1, F.greatest(F.col("place") - 1, F.lit(0)))), F.slice(words, F.col("place") + 1, F.when(F.col("place") == 0, 0).otherwise(n))]
    variants = checkpointed(variants.select("id", "place", F.xxhash64(*rest).alias("key"), F.xxhash64(F.lit(1), *rest).alias("k2")))
    # Few variants are left here, and they get the places of their lines.
    variants = checkpointed(shared(variants).withColumn("key", F.struct("key", "k2")).drop("k2").join(lines.select("id", "order"), "id"))
    itself = F.col("place") == 0
    # Substitutions: the same place deleted. Insertions and deletions: a line itself, and others without a word.
    same = variants.where(~itself).groupBy("key", "place").agg(F.min("order").alias("near"))
    other = variants.groupBy("key").agg(F.min(F.when(itself, F.col("order"))).alias("whole"), F.min(F.when(~itself, F.col("order"))).alias("part"))
    found = variants.where(~itself).join(same, ["key", "place"]).select("id", "order", "near")
    found = found.unionByName(variants.join(other, "key").select("id", "order", F.when(itself, F.col("part")).otherwise(F.col("whole")).alias("near")))
    found = checkpointed(found.where(F.col("near") < F.col("order")).groupBy("id").agg(F.min("near").alias("near")))
    # The distance is verified on the words of the line and its witness.
    witness = lines.select(F.col("order").alias("near"), F.col("content").alias("near_content"))
    checked = found.join(lines.select("id", "content"), "id").join(witness, "near")
    checked = checked.select("id", words_of(F.col("content")).alias("words"), words_of(F.col("near_content")).alias("near_words"))
    return checked.where(within_one_edit(words, F.col("near_words"))).select("id")


def within_one_edit(a: Column, b: Column) -> Column:
    """True if at most one word has to be inserted, deleted or replaced: what remains between the common beginning and
    the common end is one word at most on either side."""

    def common(x: Column, y: Column) -> Column:
        differs = F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), False)
        return F.when(differs == 0, F.least(F.size(x), F.size(y))).otherwise(differs - 1)

    left, right = common(a, b), common(F.reverse(a), F.reverse(b))
    longer = F.greatest(F.size(a), F.size(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (left + right >= longer - 1)


def repeated_lines(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, digest and lines (numbers from 0) of the lines to remove, for documents that have any."""
    order = F.struct(*ORDER)
    hashed = lines_of(documents, min_words)
    distinct = hashed.groupBy("h1", "h2", "short", "begins", "ends").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    distinct = checkpointed(distinct.select("h1", "h2", "short", "begins", "ends", "n", "first.*"))
    place = ["h1", "h2", *ORDER]
    some = shared(distinct.where(F.col("begins").isNotNull()).select(*place, F.explode(F.array("begins", "ends")).alias("key"))).select(*place)
    # A line of 2 * SIDE words is there in any case: it may be near one that is too short to have keys.
    some = some.unionByName(distinct.where("short").select(*place))
    wanted = checkpointed(some.groupBy("no_id", "doc_id", "digest").agg(F.collect_set(F.struct("line", "h1", "h2")).alias("wanted")))
    # Texts meet the few bytes that are wanted of each by a shuffle and without being sorted, whatever the number of lines.
    texts = row_key(documents.select("doc_id", "text")).withColumn("id", F.coalesce("doc_id", F.lit(0)))
    wanted = wanted.withColumn("id", F.coalesce("doc_id", F.lit(0))).drop("doc_id")
    found = texts.join(wanted.hint("shuffle_hash"), ["no_id", "id", "digest"]).select("no_id", "doc_id", "digest", F.split("text", "\n").alias("content"), F.explode("wanted").alias("x"))
    found = found.select(F.col("x.h1").alias("h1"), F.col("x.h2").alias("h2"), F.struct("no_id", "doc_id", "digest", F.col("x.line").alias("line")).alias("order"), trimmed(F.element_at("content", F.col("x.line") + 1)).alias("content"))
    found = checkpointed(found.withColumn("id", F.monotonically_increasing_id()))
    near = found.join(near_lines(found), "id").select("h1", "h2", F.lit(True).alias("near")).distinct()
    bad = distinct.join(near, ["h1", "h2"], "left").where((F.col("n") > 1) | F.col("near")).select("h1", "h2", F.struct(*ORDER).alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    places = hashed.select("h1", "h2", *ORDER).join(checkpointed(bad), ["h1", "h2"]).where(F.col("near") | (order > F.col("first")))
    return checkpointed(places.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set("line")).alias("lines")))


def without(items: Column, places: Column) -> Column:
    """An array without the items at some places, which are sorted: the slices between them, so that its work is in
    proportion to the array, whatever the number of places."""

    def gaps(x: Column) -> Column:
        before, after = F.concat(F.array(F.lit(-1)), places), F.concat(places, F.array(F.size(x)))
        return F.flatten(F.zip_with(before, after, lambda a, b: F.slice(x, a + 2, b - a - 1)))

    return F.transform(F.array(items), gaps)[0]  # a lambda's argument is made once, however often it is used


COUNTS = ("n_lines", "n_removed")


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS, counts: tuple[str, str] = COUNTS) -> DataFrame:
    """Removes each line that equals an earlier line or, if it has min_words words or more, is near one.

    Lines end at \\n; white space at their ends doesn't count, and words are what is between single blanks. Earlier: in a
    document with a smaller doc_id (a null one comes last; of equal ids the smaller digest of the text comes first), or
    above in the same. Lines are judged against all earlier lines of the input, removed ones included. Lines without a
    word stay.

    Returns the columns of documents, with text replaced, and n_lines and n_removed (long) or other names from counts,
    for each row. A null text stays null and has no line; an empty text stays empty. Rows alike in id and text keep the
    same lines. No rows give none. Other columns are carried along; those named like a count are replaced. A very long text
    is split in one task, whose work and memory are in proportion to its lines.
    """
    gone = repeated_lines(documents, min_words)
    columns = [c for c in documents.columns if c not in counts]
    rows = documents.select(*columns)
    id_, digest, lines, new = (free_name(documents, n) for n in ("gone_id", "gone_digest", "gone_lines", "new_text"))
    gone = gone.select(F.col("doc_id").alias(id_), F.col("digest").alias(digest), F.col("lines").alias(lines))
    rows = rows.join(gone.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("doc_id", "text") == F.col(digest)), "left")
    content, unchanged = F.split("text", "\n"), F.col(lines).isNull()
    out = rows.withColumns({
        new: F.when(unchanged, F.col("text")).otherwise(F.array_join(without(content, F.col(lines)), "\n")),
        counts[0]: F.when(F.col("text").isNull(), 0).otherwise(F.size(content)).cast("long"),
        counts[1]: F.when(unchanged, 0).otherwise(F.size(lines)).cast("long"),
    })
    return out.select(*(F.col(new).alias("text") if c == "text" else c for c in columns), *counts)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text without repeated lines."""
    return dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, k, ls[k] AS line, trim(ls[k], ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS content FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM d)),
first AS (SELECT content, string_split(content, ' ') AS w, min(doc_id * 1000000 + k) AS o FROM lines WHERE content <> '' GROUP BY content),
variants AS (SELECT content, o, k, list_concat(w[1:k - 1], w[k + 1:len(w)]) AS v FROM (SELECT content, o, w, unnest(range(1, len(w) + 1)) AS k FROM first WHERE len(w) >= 5)),
same AS (SELECT content FROM (SELECT content, o, min(o) OVER (PARTITION BY v, k) AS least FROM variants) WHERE least < o),
shorter AS (SELECT a.content AS longer, a.o AS longer_o, b.content AS shorter, b.o AS shorter_o FROM variants a JOIN first b ON a.v = b.w WHERE len(b.w) >= 5),
near AS (SELECT content FROM same UNION SELECT longer FROM shorter WHERE shorter_o < longer_o UNION SELECT shorter FROM shorter WHERE longer_o < shorter_o),
judged AS (SELECT l.doc_id, l.k, l.line, l.content <> '' AND (l.doc_id * 1000000 + l.k > f.o OR l.content IN (SELECT content FROM near)) AS gone FROM lines l LEFT JOIN first f ON l.content = f.content)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT coalesce(gone, false)), '') AS text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed FROM judged GROUP BY doc_id
"""
