"""Rows that every operator must survive."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, word string, key string"

LONG = "lorem ipsum dolor sit amet " * 8000

TEXTS = [
    None, "", " ", "\n\n", "one", "One TWO three four five six", "one two three four five six", "one two three four five seven\none two three four five six",
    "Écoute l'été — naïve café 😀 ﬁ　x\t\x00end", "You are an idiot. The rest is fine and long enough.", "mail a.b@c.d_e@f.gh, ip 1.2.3.4.5 and 300.1.1.1, card 4111 1111 1111 1111, +1 (017) 555-7713.", LONG, LONG,
    "same line here for all of us\nother", "same line here for all of us\nother\nsame line here for all of us", "a b c d e f g h", "a b c d e f g h", "a b c x e f g h", "a b c d e f g", "iban GB82 WEST 1234 5698 7654 32 here",
]


def documents(spark, texts=TEXTS, partitions=3):
    rows = [(i, t, "en", None if i % 7 == 3 else f"s{i % 3}", len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]
    rows += [(0, "one two three four five six", "de", "s1", 3, "x", "y", "z"), (3, "\n\n", "en", "s0", 2, "x", "y", "z"), (None, "no id", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
