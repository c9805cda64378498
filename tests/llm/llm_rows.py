"""Rows that every operator must survive."""

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, columns with clashing names."""

    long_text = " ".join(f"word{i % 97} é日本 {'x' * (i % 40)}" for i in range(3000)) + "\n" + "a" * 5000
    rows = [
        (1, "Hello there.\nA second line here.\nA third one stands here.", "en", "s", 10),
        (2, "Hello there.\nA second line here.\nA third one stands here.", "en", "s", 10),
        (2, "Hello there.\nA second line here.\nA third one stands here.", "en", "s", 10),
        (3, None, "en", "s", None), (4, "", None, None, 0), (5, "   \n\t\n ", "de", None, 5),
        (None, "no id", None, "t", 5), (None, "no id", None, "t", 5), (None, None, None, None, None),
        (6, long_text, "en", "s", len(long_text)), (7, "1 2 3 !!! ###", "fr", "t", 13),
        (8, "mail me@example.org or +1 (743) 555-3824, 10.0.0.1 <|endoftext|>", "en", "s", 3),
        (9, "\x00\x0b\x0c    \U0001f600", "xx", "t", 3),
    ]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    for name in ("n_tokens", "n_bytes", "bits", "key", "ord", "h", "chunk", "first", "root", "hashes", "texts", "grp",
                 "bin", "words", "held_out", "score", "spans", "row_id", "sequence_id", "length", "start", "a.b"):
        docs = docs.withColumn(name, docs["n_chars"] + 1)
    return docs


def empty_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
