"""The subpackage's queries against their SQL, and the pipeline stage by stage against brute force."""

import os

import corpus_pipeline
import duckdb
import public_tokenizers
import pytest
import tiktoken
from loomhouse.llm import bpe
from loomhouse.llm.queries import oracle_sql, queries

from .test_decontaminate import brute as brute_decontaminate
from .test_jaccard import brute as brute_alike
from .test_line_dedup import brute as brute_lines

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for f in os.listdir(DATA):
        connection.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return connection


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_against_sql(spark, duck, name):
    told = duck.execute(oracle_sql()[name])
    names = [c[0] for c in told.description]
    frame = queries()[name](spark, DATA)
    assert sorted(names) == sorted(frame.columns)
    want = sorted(repr([row[names.index(c)] for c in sorted(names)]) for row in told.fetchall())
    assert sorted(repr([row[c] for c in sorted(names)]) for row in frame.collect()) == want


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries() if n.startswith("op")) == list(range(1, 11)) and "pipeline" in queries()


def test_contract_columns(spark):
    want = {
        "op1": ["doc_id", "held_out", "lang_pred", "score"],
        "op2": ["page_id", "url", "text", "n_chars"],
        "op4": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        "op5": ["doc_id", "fingerprint", "component_id"],
        "op6": ["doc_id", "held_out", "score", "predicted"],
        "op7": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op9": ["doc_id", "held_out", "score", "predicted"],
    }
    docs = spark.read.parquet(f"{DATA}/documents.parquet").count()
    for name, run in queries().items():
        key = name.split("_")[0]
        if key in want:
            out = run(spark, DATA)
            assert out.columns[: len(want[key])] == want[key]
            assert out.count() == (docs if key != "op2" else spark.read.parquet(f"{DATA}/pages.parquet").count())


def test_pipeline_by_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "decontamination", "bpe"]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in stages.items():
        out = stage(spark, docs, DATA).persist()
        before = {r["doc_id"]: r for r in docs.collect()}
        after = {r["doc_id"]: r for r in out.collect()}
        rows = [(i, r["text"]) for i, r in before.items()]
        if name != "bpe":
            assert out.columns == columns
        if name == "language_id":
            assert len(after) > 0.97 * len(before) and all(after[i] == before[i] for i in after)
        elif name == "line_dedup":
            want = brute_lines(rows)
            assert {i: r["text"] for i, r in after.items()} == {i: w[0] for i, w in want.items()}
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        elif name == "near_dedup":
            rows.sort()  # by both of the stage's rules: fingerprints within 3 bits, and five-word shingles 0.8 alike
            assert set(after) == {rows[k][0] for k in brute_alike([t for _, t in rows])}
        elif name == "decontamination":
            assert set(after) == {i for i, w in brute_decontaminate(rows, items).items() if not w[1]}
        else:
            own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
            assert all(after[i]["ids"] == own.encode_ordinary(t) and after[i]["round_trip"] for i, t in rows)
        docs = out
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, DATA).collect()) == sorted(r["doc_id"] for r in docs.collect())


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp int, th int, spans int, langid string, bpe int, contamination int, line_dedup int, gone int, lines int, stay int, row int, id int, bits int, h int"


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_odd_tables(spark, empty):
    """Nulls in every column, empty and long texts, repeated rows, clashing names, and no rows at all."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40).collect()
    extra = tuple(range(14))
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], *extra) for r in docs]
    rows += [rows[0], rows[0], (None, rows[1][1], None, None, None, *[None] * 14), (7000, None, "en", None, None, *extra), (7001, "", None, "s", 0, *extra), (7002, "the and " * 40_000, "en", "s", 1, *extra), (None, None, None, None, None, *[None] * 14)]
    rows = [r[:8] + (None if r[8] is None else str(r[8]),) + r[9:] for r in rows]
    frame = spark.createDataFrame([] if empty else rows, ODD)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, DATA)
        if name != "bpe":
            assert out.columns == frame.columns
        assert (out.count() > 0) != empty
        if name == "near_dedup" and not empty:
            assert out.where("doc_id = %d" % rows[0][0]).count() == 1


def test_score_is_bounded_and_und_is_for_no_letters(spark):
    got = queries()["op1_langid"](spark, DATA).collect()
    assert all(0 <= r["score"] <= 1 for r in got) and {r["lang_pred"] for r in got} <= {"en", "de", "fr", "es", "und"}
