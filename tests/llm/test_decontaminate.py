import re

import pytest
from loomhouse.llm import decontaminate

from .helpers import DOC, documents, prose


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(docs, items):
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, it in items:
            own = words(it)
            n = min(10, len(own))
            for k in range(max(1, len(own) - 9) if own else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == own[k : k + n]:
                        hit |= set(range(p, p + n))
                        if item is not None:
                            found.add(str(item))
        out[i] = (len(w), len(hit), sorted(found))
    return out


ITEMS = [(10, prose(1, 40)), (9, prose(2, 12)), (8, "Only four Words here"), (7, None), (6, ""), (10, prose(3, 15)), (None, prose(4, 11)), (5, "the the the the the the the the the the the the")]
ITEMS += [(100, prose(1, 25))]  # shares its windows with item 10


def fixture():
    a, b = prose(1, 40), prose(2, 12)
    return [
        (0, None), (1, ""), (2, prose(50, 300)), (3, prose(51, 30) + ". " + a.upper() + "! " + prose(52, 30)), (4, " ".join(a.split()[5:16])), (5, " ".join(a.split()[:9])),
        (6, "only, four; words -- HERE only four words here"), (7, b + " " + b), (8, "the " * 30), (9, prose(4, 11) + " x"), (10, prose(53, 20000) + " " + prose(3, 15)), (11, " ".join(a.split()[:9])), (12, prose(1, 40)),
    ]


@pytest.mark.parametrize("most", [250_000, 7])
def test_against_brute_force(spark, most):
    docs, items = fixture(), ITEMS
    out = decontaminate.contamination(documents(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"), windows_a_pass=most)
    got = {r["doc_id"]: (r["contamination"]["n_words"], r["contamination"]["n_hit"], r["contamination"]["item_ids"]) for r in out.collect()}
    assert got == brute(docs, items)
    for r in out.collect():
        spans = list(zip(r["contamination"]["starts"], r["contamination"]["ends"]))
        assert sum(e - s for s, e in spans) == r["contamination"]["n_hit"]
        assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_clean_keeps_columns_and_clean_rows(spark):
    rows = [(1, prose(1, 40), 5), (2, prose(60, 40), 6), (2, prose(60, 40), 6), (3, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, contamination int")
    out = decontaminate.clean(docs, spark.createDataFrame(ITEMS[:1], "item_id bigint, text string"))
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [2, 2, 3]


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item_id bigint, text string")
    out = decontaminate.contamination(documents(spark, [(1, "a b"), (2, None)]), items).collect()
    assert [(r["contamination"]["n_words"], r["contamination"]["n_hit"]) for r in out] == [(2, 0), (0, 0)]
    assert decontaminate.contamination(spark.createDataFrame([], DOC), spark.createDataFrame(ITEMS, "item_id bigint, text string")).collect() == []
