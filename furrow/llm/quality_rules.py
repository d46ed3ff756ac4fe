"""Quality rules: a threshold table compiled into one projection.

Every ratio is an expression of built-in functions, so the scan, the ratios and the verdict stay in one stage
without a shuffle and without user functions.

Null and empty texts have no words and fail. Extra columns pass through untouched; a column named like a
result is replaced. Repeated rows are judged one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import SPACE, let, text_or_empty

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_STOP_RATIO = 0.015625
#: Frequent function words of the corpus' languages.
STOP_WORDS = (
    "the of and to in is that for it was on are with as be this by at from or an a not have had "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an "
    "le la les de des et un une du que qui en dans pour sur pas par au avec est ce il "
    "el los las y del se por con una para no su lo como más"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= value <= high``; a missing bound always holds."""

    value: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("n_words", low=MIN_WORDS),
    Rule("mean_word_chars", low=2.0, high=15.0),
    Rule("symbol_ratio", high=0.2),
    Rule("upper_ratio", high=0.4),
    Rule("stop_shortfall", high=0.5),  # short texts may lack function words by chance
    Rule("dup_line_ratio", high=0.5),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words inside windows that occur at least twice, the first occurrence included.

    Windows are compared by a 64-bit hash of word hashes. Texts in which all windows differ are done after
    one hash set; else equal windows become neighbours by a sort and the covered words are summed over the gaps.
    """

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - window), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)]))

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda s, k: F.coalesce(F.least(F.lit(window), F.get(starts, k + 1) - s), F.lit(window)))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    def repeated(ordered: Column) -> Column:
        same = lambda x, k: (F.get(ordered, k - 1)["h"] == x["h"]) | (F.get(ordered, k + 1)["h"] == x["h"])
        hits = F.filter(ordered, lambda x, k: F.coalesce(same(x, k), (F.get(ordered, k + 1)["h"] == x["h"]), F.lit(False)))
        return let(F.sort_array(F.transform(hits, lambda x: x["i"])), covered)

    def count(grams: Column) -> Column:
        ordered = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(ordered, repeated))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < window, F.lit(0)).otherwise(let(hashes, lambda h: let(windows(h), count)))


def counts(docs: DataFrame, column: str = "text") -> DataFrame:
    """Add the base counts and the ratios that the rules read."""
    text = text_or_empty(column)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    wanted = sorted({v for w in STOP_WORDS for v in (w, w.capitalize(), w.upper())})

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.size(F.filter(words, lambda w: w.isin(wanted))).cast("long").alias("n_stop"),
            repeat_words(words).cast("long").alias("n_repeat_words"),
        )

    def of_lines(xs: Column) -> Column:
        return F.struct(F.size(xs).cast("long").alias("n_lines"), (F.size(xs) - F.size(F.array_distinct(xs))).cast("long").alias("n_dup_lines"))

    left = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("long")
    out = docs.withColumns({"_w": let(words_of(text), of_words), "_l": let(lines, of_lines), "n_symbols": left(r"[^#*$%&|<>]+"), "_upper": left(r"\P{Lu}+"), "_letters": left(r"\P{L}+")})
    each = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return out.withColumns(
        {k: F.col(f"_w.{k}") for k in ("n_words", "word_chars", "n_repeat_words")}
        | {"n_dup_lines": F.col("_l.n_dup_lines")}
        | {
            "mean_word_chars": each(F.col("_w.word_chars"), F.col("_w.n_words")),
            "symbol_ratio": each(F.col("n_symbols"), F.col("_w.n_words")),
            "upper_ratio": each(F.col("_upper"), F.col("_letters")),
            "stop_shortfall": F.col("_w.n_words") * F.lit(MIN_STOP_RATIO) - F.col("_w.n_stop"),
            "dup_line_ratio": each(F.col("_l.n_dup_lines"), F.col("_l.n_lines")),
        }
    ).drop("_w", "_l", "_upper", "_letters")


def passes(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one condition."""
    verdict = F.lit(True)
    for rule in rules:
        if rule.low is not None:
            verdict &= F.col(rule.value) >= rule.low
        if rule.high is not None:
            verdict &= F.col(rule.value) <= rule.high
    return verdict


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, column: str = "text") -> DataFrame:
    """Add the counts, the ratios, ``base_failed`` and ``kept``."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counts(docs, column).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & passes(rules))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that the rules keep, with their own columns alone."""
    return judge(docs.select(F.struct("*").alias("_row"), F.col("text")), rules).where("kept").select("_row.*")


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", *COUNTS, "base_failed", "kept")


def sql() -> str:
    """The same rows in plain SQL, the windows as relations."""
    low = [f"{r.value} >= {r.low}" for r in RULES if r.low is not None]
    high = [f"{r.value} <= {r.high}" for r in RULES if r.high is not None]
    stops = ", ".join(f"'{v}'" for w in STOP_WORDS for v in (w, w.capitalize(), w.upper()))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
n AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(ws[i:i+4], ' ')) AS times FROM g),
r AS (SELECT rid, count(DISTINCT i + k) AS covered FROM n, (SELECT unnest(range(5)) AS k) WHERE times > 1 GROUP BY rid),
c AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(covered, 0) AS n_repeat_words, len(ls) AS n_lines,
        len(list_filter(ws, lambda x: x IN ({stops}))) AS n_stop,
        length(regexp_replace(text, '\P{{Lu}}+', '', 'g')) AS n_upper, length(regexp_replace(text, '\P{{L}}+', '', 'g')) AS n_letters
      FROM w LEFT JOIN r USING (rid)),
q AS (SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbol_ratio,
        coalesce(n_upper / nullif(n_letters, 0), 0) AS upper_ratio, n_words * CAST({MIN_STOP_RATIO} AS DOUBLE) - n_stop AS stop_shortfall,
        coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio,
        n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(low + high)} AS kept FROM q
"""
