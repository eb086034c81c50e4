"""Small tables with every awkward case: nulls, blanks, repeats, ties, long texts, clashing columns."""

import random

AWKWARD = [
    (1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, "One"), (6, "two words"), (7, "a b c"), (7, "a b c"), (8, "A B C"),
    (9, "word " * 30_000), (10, "déjà vu — naïve £5 \u2028 line"), (None, "a row without an id"), (11, "x\x00y \x1c z"), (12, "🙂 🙃 émoji"),
    (13, "1234 5678 !!! ???"), (14, "no-space-" * 2000),
]


def documents(spark, rows=AWKWARD):
    """As documents, with columns that clash with names an operator may use inside."""
    data = [(i, t, "en", "src", len(t or ""), "x", 1.5) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, id string, score double")


def prose(seed, n, words=("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau").split()):
    r = random.Random(seed)
    return " ".join(r.choice(words) + r.choice(words) for _ in range(n))
