import re

import pytest

WORD = re.compile("[^\x20\x09-\x0d]+")

#: Texts that any operator must take: null, empty, blank, ties, repeats, long words, odd characters.
ODD = [
    None, "", "  \t\n ", "one", "one two three four", "one two three four five", "One TWO three four five",
    "a" * 5000, "x " * 3000, "café naïve 日本語 \U0001f600     end", "tab\tand\x0bvertical\x0cfeed\r\n", "<|endoftext|> it's we'll 12 345 ... \x00 \x1f _ ²",
]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words_of(text, fold=True):
    return WORD.findall(lower(text) if fold else text or "")


@pytest.fixture
def make(spark):
    """A documents table with columns that clash with names used inside the operators."""

    def f(texts, ids=None, **columns):
        n = len(texts)
        ids = list(range(n)) if ids is None else ids
        names = ["doc_id", "text", "source", "lang", *columns, "size", "row", "class", "key", "cell", "copies", "toxic", "block"]
        fixed = [columns.get("source", ["s"] * n), columns.get("lang", ["en"] * n)]
        columns.pop("source", None), columns.pop("lang", None)
        names = ["doc_id", "text", "source", "lang", *columns, "size", "row", "class", "key", "cell", "copies", "toxic", "block"]
        rows = [(ids[i], texts[i], fixed[0][i], fixed[1][i], *[c[i] for c in columns.values()], 1, 2, "c", "k", 3, 4, 0, 5) for i in range(n)]
        kinds = "doc_id long, text string, source string, lang string" + "".join(f", {c} string" for c in columns) + ", size int, row int, class string, key string, cell int, copies int, toxic int, block int"
        assert len(names) == len(kinds.split(","))
        return spark.createDataFrame(rows, kinds)

    return f
