"""Small tables with every odd case, and plain Python forms of what the operators do."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")

LONG = " ".join(f"w{i}" for i in range(120))

DOCS = [
    (1, "", "en", "a", 0),
    (2, None, "en", None, 0),
    (3, "one two three one two three", "en", "b", 10),
    (4, LONG, "en", "b", 10),
    (5, "before " + LONG + " after", "de", "c", 10),
    (5, "before " + LONG + " after", "de", "c", 10),
    (6, "  spaced  out\n\nlines \t here ", "de", None, 10),
    (None, "no number here, none at all", "fr", "a", 10),
    (None, LONG, "fr", "a", 10),
    (7, "Zwölf Größe naïve 漢字 \U0001f600 it's <|endoftext|> done", "de", "c", 10),
    (8, LONG.upper(), "de", "c", 10),
    (9, "x" * 3000, "de", "c", 10),
]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows=None):
    return spark.createDataFrame(DOCS if rows is None else rows, SCHEMA)


def key(row):
    return tuple((x is not None, x) for x in row)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=key)
