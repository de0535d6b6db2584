"""Rows with nulls, blanks, long texts, ties, repeated rows and clashing column names, for every operator."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, piece string, salt string, k long, anchor string, ids string, count long, _ID string, _t string, _gone string, _got int, _told int, `a.b` int, `c``d` string"
REST = ("x", "y", "z", 1, "w", "v", 2, "u", "t", "s", 3, 4, 5, "r")


def documents(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", len(t or ""), *REST) for i, t in enumerate(texts)], SCHEMA)


def odd(spark):
    rows = [(None, None), (None, "a b c d e"), (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "one two three four five six " * 4000), (6, "same text here for all of you"), (6, "same text here for all of you"), (7, "same text here for all of you"), (8, "é ü \U0001f600 漢字 \x1c \x85x"), (9, "a" * 20000), (10, "<|endoftext|> it's 's  \n\n x")]
    return spark.createDataFrame([(i, t, None, None, None, *REST) for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
