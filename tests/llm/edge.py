"""Rows that every operator has to bear: nulls, empty and very long texts, ties, repeats, foreign columns."""

from __future__ import annotations

LONG = " ".join(f"w{i % 4001}" for i in range(60_000))
WORD = "x" * 50_000
TEXTS = [None, "", "   \n\t ", "one", "one two three", "A b C d E f G h", LONG, WORD, "Ärger über ΣΟΦΟΣ, naïve 日本語   x\x1cy 😀", "one two three"]
EXTRA = ("key", "row", "found", "hits", "gaps", "n", "i", "doc", "text_", "media", "ids", "score", "lang_pred", "n_entities", "band", "sub")


def documents(spark, texts=TEXTS):
    """(doc_id, text, lang, source, n_chars) with a null id, a repeated row, and columns that clash with names used inside."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else f"src{i}", len(t or ""), *[f"kept{i}"] * len(EXTRA)) for i, t in enumerate(texts)]
    rows += [(None, "a text without an id", "en", "s", 20, *["kept"] * len(EXTRA)), rows[4]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA))


def empty(spark):
    return documents(spark).limit(0)
