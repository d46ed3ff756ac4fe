"""Filter interaction audit by a recursive common table expression.

Every document's failing filters are the bits of its mask; documents are counted in cells (part, mask). The recursion starts
with an empty prefix for each possible mask cell and extends the prefixes by the letters they haven't used, an equi join on the
bits applied so far. Each level carries the applied bits on and emits what its step does to each mask cell; the counts of the
cells then turn this into documents for every part. Its rows are bounded by the number of filters alone: 325 prefixes times
32 masks for five filters, however many documents or parts there are.

Null texts are empty, a null source is the part "". A null doc_id is no smaller id than another and has none below it, so
such a row never fails as a copy; rows with equal ids are no copies of each other. A document with several label rows is good
or toxic if one of them says so. Extra columns aren't read. Without documents there is no part and no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.llm.common import SPACE, let, stored, table, text_or_empty

MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 2
SYMBOLS = "#$%&*|"
#: The filter that looks at other documents: identical to a text with a smaller id.
COPIES = "E"


LETTERS = ("A", "B", "C", "D", COPIES)


def failures(text: Column, words: Column) -> dict[str, Column]:
    """The conditions under which a text fails the filters that look at it alone."""
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * F.size(words),
        "C": 100 * upper > MAX_UPPER_PERCENT * F.length(text),
        "D": text.rlike(f"[{SYMBOLS}]"),
    }


def bit(letter: str) -> int:
    return 1 << LETTERS.index(letter)


# -- masks ------------------------------------------------------------------------------------


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text and the bits of the filters that look at the text alone, in one projection."""

    def bits(both: Column) -> Column:
        found = [F.when(fails, bit(letter)).otherwise(0) for letter, fails in failures(both["text"], both["words"]).items()]
        return sum(found[1:], found[0])

    text = text_or_empty()
    both = F.struct(text.alias("text"), F.array_remove(F.split(text, f"[{SPACE}]+"), "").alias("words"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        let(both, bits).alias("bits"),
    )


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents of each part and mask: n, good and toxic ones.

    Nothing of a text but its digest is shuffled. Equal rows are summed before each exchange: neither a text nor an id that a
    third of the rows share gathers in one task.
    """
    rows = stored(judged(docs).groupBy("doc_id", "part", "digest", "bits").agg(F.count("*").alias("n")), "judged")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    masks = rows.join(firsts, ["digest", "doc_id"], "left").select("doc_id", "part", "n", F.when(copy, F.col("bits") + bit(COPIES)).otherwise(F.col("bits")).alias("mask"))
    masks = masks.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    of = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c)
    return masks.join(known, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


# -- the recursion ----------------------------------------------------------------------------


def steps(spark: SparkSession, letters: tuple[str, ...] = LETTERS) -> DataFrame:
    """prefix, step, letter, mask and 0/1: kept, removed, redundant, alone; a row for each prefix of the letters and each mask."""
    unused = ", ".join(f"({applied}, '{x}', {1 << i})" for applied in range(1 << len(letters)) for i, x in enumerate(letters) if not applied >> i & 1)
    return spark.sql(f"""
        WITH RECURSIVE unused (applied, letter, bit) AS (VALUES {unused}),
        walk (prefix, step, letter, applied, mask, kept, removed, redundant, alone) AS (
            SELECT '', 0, '', 0, CAST(id AS INT), 1, 0, 0, 0 FROM range(0, {1 << len(letters)}, 1, 1)
            UNION ALL
            SELECT concat(w.prefix, u.letter), w.step + 1, u.letter, w.applied | u.bit, w.mask,
                   IF(w.mask & (w.applied | u.bit) = 0, 1, 0),
                   IF(w.mask & u.bit <> 0 AND w.mask & w.applied = 0, 1, 0),
                   IF(w.mask & u.bit <> 0 AND w.mask & w.applied <> 0, 1, 0),
                   IF(w.mask = u.bit, 1, 0)
            FROM walk w JOIN unused u ON w.applied = u.applied
        )
        SELECT prefix, step, letter, mask, kept, removed, redundant, alone FROM walk WHERE step > 0
    """)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for every part, order of the filters and step."""
    spark, counted = docs.sparkSession, cells(docs, labels)
    walk = stored(steps(spark), "steps")  # of a fixed size
    of = lambda flag, n="n": F.sum(F.col(flag) * F.col(n)).cast("long")
    done = counted.join(F.broadcast(walk), "mask").groupBy("part", "prefix", "step", "letter").agg(
        of("kept").alias("kept"), of("removed").alias("removed"), of("redundant").alias("redundant"), of("alone").alias("unique_fails"),
        of("removed", "good").alias("good_lost"), of("removed", "toxic").alias("toxic_lost"),
    )
    orders = walk.where((F.col("step") == len(LETTERS)) & (F.col("mask") == 0)).select(F.col("prefix").alias("filter_order"))
    prefixes = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("k")).select("filter_order", F.expr("substring(filter_order, 1, k)").alias("prefix"))
    every = done.join(F.broadcast(prefixes), "prefix")  # of a fixed size as well
    share = F.sum("removed").over(Window.partitionBy("part", "letter"))  # one row for each order
    return every.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", share.cast("long").alias("shapley"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def sql() -> str:
    """The same rows by plain counting: every document against every order and step."""
    return r"""
WITH RECURSIVE judged AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), firsts AS (
    SELECT t, min(doc_id) AS first_id FROM judged GROUP BY t
), known AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), fails AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, concat(
        CASE WHEN len(w) < 200 THEN 'A' ELSE '' END,
        CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
        CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END,
        CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
        CASE WHEN j.doc_id > first_id THEN 'E' ELSE '' END) AS failed
    FROM judged j JOIN firsts USING (t) LEFT JOIN known k ON j.doc_id = k.doc_id
), counted AS (
    SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fails GROUP BY part, failed
), orders (o) AS (
    SELECT a.x || b.x || c.x || d.x || e.x
    FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) a (x), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) b (x), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) c (x),
         (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) d (x), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) e (x)
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), walked AS (
    SELECT part, o AS filter_order, s AS step, substr(o, s, 1) AS letter, failed, n, good, toxic,
           contains(failed, substr(o, s, 1)) AS fails_here,
           len(list_intersect(string_split(failed, ''), string_split(substr(o, 1, s - 1), ''))) > 0 AND s > 1 AND failed <> '' AS gone
    FROM counted, orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)
), summed AS (
    SELECT part, filter_order, step, letter,
           coalesce(sum(n) FILTER (NOT gone AND NOT fails_here), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fails_here), 0) AS removed,
           coalesce(sum(n) FILTER (gone AND fails_here), 0) AS redundant, coalesce(sum(n) FILTER (failed = letter), 0) AS unique_fails,
           coalesce(sum(good) FILTER (NOT gone AND fails_here), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails_here), 0) AS toxic_lost
    FROM walked GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM summed
"""
