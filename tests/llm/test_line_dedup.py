import hashlib
import math
import random

import pytest
from loomhouse.llm import line_dedup

from .helpers import DOC, documents, prose


def chunks(text):
    """(lines, chunks): each chunk is (s, e, lo, hi), lines s to e - 1 and how far its sides reach."""
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    begin, out = None, []
    for k in range(len(lines) - 1):
        m = (h[k] * 31 + h[k + 1]) % 9
        if m % 3:
            begin = k
        if m >= 3:  # the chunk from the last beginning, unless an end came since
            if begin is not None:
                size = k + 2 - begin
                many = math.ceil(size / line_dedup.MAX_LINES)
                out += [(begin + j * size // many, begin + (j + 1) * size // many) for j in range(many)]
            begin = None
    return lines, [(s, e, out[i - 1][0] if i else 0, out[i + 1][1] if i + 1 < len(out) else len(lines)) for i, (s, e) in enumerate(out)]


def brute(rows):
    """Rows are (id, text) with ids that differ."""
    first, cut = {}, {}
    for i, t in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0])):
        cut[i] = lines, own = chunks(t)
        for s, e, lo, hi in own:
            first.setdefault(tuple(lines[s:e]), (i, s, lo, hi))
    out = {}
    for i, t in rows:
        if t is None:
            out[i] = (None, 0, 0)
            continue
        lines, own = cut[i]
        gone = set()
        for s, e, lo, hi in own:
            j, s0, lo0, hi0 = first[tuple(lines[s:e])]
            if (j, s0) == (i, s):
                continue
            other, shift = cut[j][0], s0 - s
            while s > lo and s + shift > lo0 and lines[s - 1] == other[s - 1 + shift]:
                s -= 1
            while e < hi and e + shift < hi0 and lines[e] == other[e + shift]:
                e += 1
            gone.update(range(s, e))
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone))
    return out


def rows():
    r = random.Random(11)
    line = lambda: " ".join(prose(r.randrange(10**6), r.randint(1, 8)).split())
    passage = [line() for _ in range(12)]
    out = []
    for i in range(40):
        own = [line() for _ in range(r.randint(1, 30))]
        if i % 2:
            at = r.randrange(len(own) + 1)
            own[at:at] = passage
        out.append((i, "\n".join(own)))
    long = prose(77, 60)
    out += [(100, out[3][1]), (101, out[3][1]), (102, long), (103, f"x\n{long}\ny"), (104, f"{long}\n{long}"), (105, None), (106, ""), (107, "\n\n\n"), (108, "\n\n\n\n"), (109, "\n".join([line()] * 3000)), (110, "one"), (111, "one")]
    out += [(112, f"{long}\n{long}\n"), (113, "\n".join([line()] * 3000)), (114, out[-3][1] + "\nz")]
    return out


def test_against_brute_force(spark):
    some = rows()
    got = {r["doc_id"]: (r["text"], r["line_dedup"]["n_lines"], r["line_dedup"]["n_removed"]) for r in line_dedup.dedup(documents(spark, some).repartition(3)).collect()}
    assert got == brute(some)
    assert got[102][2] == got[103][2] == 0  # a long line that is repeated by itself stays
    assert sum(g[2] == 12 for i, g in got.items() if i < 40) > 15  # passages of twelve lines go whole


def test_borders_do_not_depend_on_what_stands_around():
    """Inside a passage, all chunks are the same whatever stands before and after it."""
    passage = [prose(k, 4) for k in range(40)]
    inner = lambda lines: {tuple(lines[s:e]) for s, e, *_ in chunks("\n".join(lines))[1]}
    alone = inner(passage)
    assert len(alone) > 10 and all(len(c) >= 2 for c in alone)
    for before, after in ((["a", "b", "c"], ["x"]), (["q"], ["r", "s"])):
        assert alone <= inner(before + passage + after)


def test_chunks_are_cut_at_the_most_lines(spark, monkeypatch):
    """Cut into equal pieces, with no line left out."""
    monkeypatch.setattr(line_dedup, "MAX_LINES", 2)
    text = "\n".join(prose(k, 5) for k in range(300))
    sizes = [e - s for s, e, *_ in chunks(text)[1]]
    assert max(sizes) == 2 and 1 in sizes  # chunks of three lines are cut into one and two
    some = [(1, text), (2, "x\n" + text), (3, None)]
    assert {r["doc_id"]: r["text"] for r in line_dedup.clean(documents(spark, some)).collect()} == {i: t[0] for i, t in brute(some).items()}


def missed(lines, draws=400):
    """The share of passages of so many lines, between other lines in two documents, of which nothing goes."""
    r, out = random.Random(lines), 0
    line = lambda: " ".join(str(r.randrange(10**5)) for _ in range(14))
    for _ in range(draws):
        passage = [line() for _ in range(lines)]
        put = lambda: "\n".join([*(line() for _ in range(r.randint(1, 12))), *passage, *(line() for _ in range(r.randint(1, 12)))])
        gone = brute([(1, put()), (2, put())])[2][2]
        assert gone in (0, lines)  # what is found goes whole, and nothing else goes
        out += not gone
    return out / draws


def test_short_passages_are_found():
    assert missed(4) < 0.2 and missed(6) < 0.06 and missed(10) < 0.01


def _pair(start):
    """A text of two lines that are a chunk."""
    return next(t for k in range(10**6) if chunks(t := f"{start}{k:03}\nend")[1])


def test_hashes_that_collide_are_told_apart(spark, monkeypatch):
    """With a hash of length only, chunks that differ in bytes stay."""
    from pyspark.sql import functions as F

    real = F.xxhash64
    monkeypatch.setattr(line_dedup.F, "xxhash64", lambda c: F.length(c).cast("bigint") if isinstance(c, str) and c == "chunk" else real(c))
    monkeypatch.setattr(line_dedup.F, "hash", lambda *c: F.lit(1))
    a, b = _pair("a"), _pair("b")
    assert len(a) == len(b)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(documents(spark, [(1, a), (2, b), (3, a)])).collect()}
    assert got[1] == a and got[2] == b and got[3] == ""


def test_columns_repeats_and_null_ids(spark):
    long = _pair("some line ")
    frame = spark.createDataFrame([(2, long, 1, 2, 3), (2, long, 1, 2, 3), (None, long, 4, 5, 6), (3, long + "\nz", 7, 8, 9)], "doc_id bigint, text string, spans int, th int, line_dedup int")
    out = line_dedup.dedup(frame)
    assert out.columns == [*frame.columns, "line_dedup_"]
    assert sorted((str(r["doc_id"]), r["text"], r["spans"]) for r in out.collect()) == [("2", "", 1), ("2", "", 1), ("3", "z", 7), ("None", long, 4)]
    assert line_dedup.clean(frame).columns == frame.columns


@pytest.mark.parametrize("i", [None, 5])
def test_rows_equal_in_id_and_text_are_places(spark, i):
    """One row keeps the text, whether its id is null or repeated; other columns are those of each row."""
    text = f"{_pair('one ')}\n{prose(6, 3)}\n{_pair('two ')}"
    rows = [(i, text, k) for k in range(4)] + [(9, f"own line\n{text}", 4), (8, "alone", 5), (8, "alone", 6)]
    out = line_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string, again int").repartition(3)).collect()
    assert sorted(r["text"] for r in out if r["doc_id"] == i) == ["", "", "", text]
    assert sorted(r["line_dedup"]["n_removed"] for r in out if r["doc_id"] == i) == [0, 5, 5, 5]
    assert sorted(r["again"] for r in out) == list(range(7))
    assert sorted(r["text"] for r in out if r["doc_id"] not in (i,)) == ["alone", "alone", "own line"]


def test_no_python_in_the_plan(spark):
    plan = line_dedup.dedup(documents(spark, rows()))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_empty_table(spark):
    assert line_dedup.dedup(spark.createDataFrame([], DOC)).collect() == []


@pytest.mark.parametrize("text", ["a", "a\nb", ""])
def test_single_documents_stay(spark, text):
    assert line_dedup.dedup(documents(spark, [(1, text)])).first()["text"] == text
