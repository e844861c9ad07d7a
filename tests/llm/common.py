"""Rows that every operator on documents has to take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, fp string, word string, pos int, shard int"


def hard_rows(texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "One word"), (504, "one"), (505, "x" * 50_000), (506, "Ünïcödé 🙂 ﬁ"), (507, "a b c d " * 4000)]
    rows += [(7, texts[7])] * 2 + [(900, texts[3]), (901, texts[3]), (902, texts[3].replace(" ", "\t \n")), (None, texts[4]), (None, "no id here"), (None, "no id here")]
    return [(i, t, "en", "s", len(t or ""), "k", "f", "w", 1, 2) for i, t in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def texts(spark, sf, n=60):
    found = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(n).collect()
    return [r["text"] for r in found]
