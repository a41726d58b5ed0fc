"""Small tables and brute-force versions for the tests of the text operations."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")

TEXTS = {
    "null": None,
    "empty": "",
    "blank": " \t\n\x0b \r ",
    "one": "word",
    "accents": "Élan vital — naïve café\u00a0ÄÖÜ ß\u3000wide",
    "odd": "a\x1cb \x85 c\u2028d <|endoftext|>x it's 1234 ½ İstanbul ΑΣ",
}


def words(text):
    return WORD.findall(text or "")


def invented(rng, n, size=400):
    """n words of an invented vocabulary."""
    return " ".join(f"w{rng.integers(size)}" for _ in range(n))


def sorted_rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def documents(spark, texts, **more):
    """doc_id, text, lang, source, n_chars of the texts, and a column that clashes with the operators' own."""
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t or ""), "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + more.get("clash", "key") + " string")
