"""Rows that every operator has to stand."""


def frame(spark, rows, extra=False):
    """Documents from (doc_id, text); ``extra`` adds columns whose names operators use themselves."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        docs = docs.selectExpr(
            "doc_id", "text", "'x' as place", "1 as text_key", "2L as n_words", "3 as rest",
            "4 as bucket", "5 as runs", "6 as score", "7 as n",
        )
    return docs


def awkward():
    long = " ".join(f"t{i % 977}" for i in range(30_000))
    copy = "one two three four five six seven eight nine ten eleven twelve"
    return [
        (None, None), (None, "a b c d e f g"), (3, None), (4, ""), (5, "   \n\t "), (6, "word"),
        (7, copy), (8, copy), (9, copy), (9, copy), (9, "a b c d e f g other text under one id"),
        (10, long), (11, long + " tail"), (12, "x " * 300), (13, " \u0085é ß \x00 z"),
        (14, "a b c d e f g"), (-5, "ONE two three FOUR five six seven"),
    ]
