"""Small document tables with awkward rows."""

from pyspark.sql import Row

SF = "/root/testdata/sf0.01"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, **more):
    """A documents table of (doc_id, text) pairs."""
    rows = [Row(doc_id=i, text=t, lang=None, source=None, n_chars=len(t) if t else None) for i, t in texts]
    return spark.createDataFrame(rows, COLUMNS)


def write_tables(spark, folder, **tables):
    """A folder that a query takes for its tables."""
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


LONG = "the long text of many words and a few more " * 3000
AWKWARD = [
    (5, None),
    (3, ""),
    (4, " \n\t "),
    (9, "one two three"),
    (9, "one two three"),
    (7, "Ünï cödé 漢字 🙂 'll don't  two  spaces\n\nand lines \n x"),
    (8, "a" * 5000),
    (None, "no key"),
    (1, LONG),
    (2, "<|endoftext|> is ordinary text"),
]
