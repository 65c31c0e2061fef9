"""Small tables and brute-force versions that the tests share."""

import random

SYLLABLES = "the and of ing ver ein los que ción été schön Ça ÜBER x 1 22".split()

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows, schema=DOC):
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows] if schema == DOC else rows
    return spark.createDataFrame(full, schema)


def prose(seed, words):
    r = random.Random(seed)
    out = []
    for _ in range(words):
        out.append("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))))
    return " ".join(out)
