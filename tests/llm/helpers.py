"""Small tables with every awkward row, shared by the operators' tests."""

from __future__ import annotations

SF = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, row string, kept string, "
    "size string, fp string, target string, id string, key string, spans string, suspect string"
)
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3000


def awkward(spark):
    """Null ids, texts, languages and sources; empty, blank, long and repeated rows; clashing names."""
    texts = [
        (1, "One two three four five six.", "en", "s1"),
        (2, "One two three four five six.", "en", "s1"),
        (2, "One two three four five six.", "en", "s1"),
        (None, "One two three four five six.", "en", None),
        (3, None, None, None),
        (4, "", "en", "s2"),
        (5, "   \n\t ", None, "s2"),
        (6, LONG, "en", "s1"),
        (7, LONG + "omega", "en", "s1"),
        (None, None, None, None),
        (None, "only null id", "fr", "sé"),
        (8, "éè 中文 \U0001f600 mail a.b@c.de ▁ \u0000 end", "fr", "s3"),
        (9, "12345 !!! 777", "en", "s3"),
        (10, "x", "de", ""),
        (11, "y z", "de", ""),
    ]
    rows = [(*t, None, "r", "k", "s", "f", "t", "i", "k", "p", "q") for t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return awkward(spark).limit(0)
