"""Small inputs with every awkward case, for all corpus operators."""

import random

import duckdb

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, _key string, component_id int"


def rows(sf=SMALL):
    return duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()


def awkward():
    """Nulls in any column, empty and very long texts, ties, repeated rows, near copies."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    base = [rng.choice(words) for _ in range(120)]
    near = list(base)
    near[60] = "changed"
    lines = "\n".join(f"line number {i} of the shared block" for i in range(8))
    return [
        (900_001, None, "en", "s", None), (900_002, "", None, None, 0), (900_003, " \n\t ", "en", None, None),
        (900_004, "One", "xx", "s", 3), (900_005, "one", None, "s", 3), (900_006, "a b c d", "en", "s", 7), (900_006, "a b c d", "en", "s", 7),
        (900_007, long, "en", "s", len(long)), (900_008, " ".join(base), "en", "s", 1), (900_009, " ".join(near), "fr", "s", 1),
        (900_010, " ".join(base).upper(), "en", "s", 1), (900_011, lines + "\n\nown end of text", "en", "s", 1),
        (900_012, "own start of text\n" + lines, "en", "s", 1), (900_013, "é" * 450, "fr", "s", 450), (900_014, "ab " * 400, "en", "s", 1200),
        (None, "a text without an id that nobody else has " * 3, "en", "s", 1), (900_015, "x\x00y z <|endoftext|> #*$", "en", "s", 9),
        (900_016, "solo solo solo", "zz", "s", 14), (900_017, long, "en", "s", len(long)),
    ]


def frame(spark, data):
    return spark.createDataFrame([(*r, "clash", "clash", 7) for r in data], SCHEMA)
