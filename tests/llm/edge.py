"""Small tables with the cases every operator has to take."""

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(6000))
BASE = " ".join(f"word{i}" for i in range(60))
NEAR = " ".join(f"word{i}" if i != 58 else "other" for i in range(60))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, BASE, "en", "b", 1), (2, NEAR, "en", "b", 1), (3, None, None, None, None), (4, "", "de", "a", 0), (5, " \t\n", "de", None, 3),
    (6, LONG, "en", "a", 1), (7, LONG, "en", "c", 1), (8, "short one", "fr", "c", 9), (8, "short one", "fr", "c", 9), (None, "no id here at all, really", "en", "b", 5),
    (9, "short one", None, "\U0001F600", 9), (10, "12345 !!", "en", "b", 8), (11, "Été à la plage", "fr", "b", 14),
]


def documents(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    import re

    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    return [w.translate(lower) for w in re.findall(r"[^ \t-\r]+", text or "")]
