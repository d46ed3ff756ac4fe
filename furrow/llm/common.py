"""Pieces that several text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from furrow.functions.arrays import bind
from furrow.session import cut_lineage, discard, scratch_path

#: White space between words, as a regular expression class body.
SPACE = r"\x20\x09-\x0D"
SHINGLE_WORDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Write a table to the shared folder and read it back; delete the rows of such a table; a new path there.
stored, emptied, new_path = cut_lineage, discard, scratch_path


def sampled(texts: DataFrame, most: int, part: Callable[[str, int], list | None], schema: str) -> list[Row]:
    """``part`` of at most ``most`` hashed distinct texts of ``texts`` (one string column), in the order of their hashes.

    ``part`` gets a text of any length and its hash where the text is read, and gives the values of ``schema`` in bounded size.
    """
    column = texts.columns[0]
    distinct = texts.agg(F.approx_count_distinct(F.xxhash64(column)).alias("n")).first()["n"]
    hashed = texts.select(F.xxhash64(column).alias("hash"), column)
    drawn = hashed.where(F.pmod("hash", F.lit(1_000_000)) < min(1_000_000, 1_000_000 * 1.5 * most / max(distinct, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()  # of the few drawn
        for batch in batches:
            for i, key in enumerate(batch.column(0).to_pylist()):
                if key not in known:
                    known.add(key)
                    if (values := part(batch.column(1)[i].as_py(), key)) is not None:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, [key, *values], strict=True))], to_arrow_schema(out))

    out = StructType.fromDDL(f"hash long, {schema}")
    names = out.fieldNames()
    return drawn.mapInArrow(run, out).dropDuplicates(["hash"]).orderBy("hash").limit(most).collect()


def drawn_apart(rows: DataFrame, by: str, names: list[str], most: int) -> DataFrame:
    """At most ``most`` distinct rows (by a hash of ``names``), shared out evenly over the values of ``by``: of each the first in the order of hashes.

    Neither copies nor the order of rows nor the share of a value change what is drawn. The groups themselves are few.
    """
    hashed = rows.withColumn("_hash", F.xxhash64(*names))
    sizes = {r[by]: r["n"] for r in hashed.groupBy(by).agg(F.approx_count_distinct("_hash").alias("n")).collect()}  # the values of ``by``
    if not sizes:
        return hashed.drop("_hash").limit(0)
    each = max(1, most // len(sizes))
    share = F.create_map(*[F.lit(x) for value, n in sizes.items() for x in (value, int(min(1_000_000, 1_000_000 * 1.5 * each / n)) + 1)])
    some = hashed.where(F.pmod("_hash", F.lit(1_000_000)) < share[F.col(by)]).dropDuplicates([by, "_hash"])
    place = F.row_number().over(Window.partitionBy(by).orderBy("_hash"))
    return some.withColumn("_place", place).where(F.col("_place") <= each).drop("_hash", "_place")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_sql(column: str = "text") -> str:
    """A text's words in DuckDB's SQL, A-Z as a-z."""
    return f"regexp_extract_all(translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{SPACE}]+')"


def shingles_sql(width: str) -> str:
    """All runs of ``width`` words of the list ``w``, in DuckDB's SQL."""
    return f"[array_to_string(w[j:j + {width} - 1], ' ') for j in range(1, len(w) - {width} + 2)]"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for the row."""
    return bind(value, body)


# -- word shingles in numpy -------------------------------------------------------------------


def _weights() -> np.ndarray:
    """Odd 64-bit multipliers: a row for each word of a shingle."""
    return np.random.default_rng(20_240_501).integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_MIX = _weights()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_BYTE = np.random.default_rng(77).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of a public hash)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and the number of words of each text.

    A-Z count as a-z unless ``lower`` is off. Nulls are empty texts. A word's hash is a polynomial of its bytes modulo 2**64, mixed.
    """
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    space = _IS_SPACE[data]
    edge = np.empty(len(data), bool)
    edge[0] = not space[0]
    np.logical_and(~space[1:], space[:-1], out=edge[1:])
    starts = np.flatnonzero(edge)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    edge[0] = False
    np.logical_and(space[1:], ~space[:-1], out=edge[1:])
    stops = np.flatnonzero(edge)
    length = stops - starts
    data = _LOWER[data] if lower else data
    h = length.astype(np.uint64)
    short = np.arange(len(starts))
    for k in range(int(length.max())):  # one step for each letter position, over the words that reach it
        short = short[length[short] > k] if k else short
        h[short] = h[short] * np.uint64(0x9E3779B97F4A7C15) + _BYTE[data[starts[short] + k]]
        if k == 63 and len(short):  # very long words one by one, by a digest
            import hashlib

            for i in short[length[short] > 64]:
                h[i] = np.frombuffer(hashlib.blake2b(data[starts[i] : stops[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
            break
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    return mixed(h), counts


def shingle_hashes(words: np.ndarray, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Hash of every run of ``n`` words; a shorter text is one run of all its words."""
    if not len(words):
        return words
    n = min(n, len(words))
    total = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        total += words[j : len(words) - n + 1 + j] * _MIX[j]
    return mixed(total)


def by_text(words: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    return np.split(words, np.cumsum(counts)[:-1])
