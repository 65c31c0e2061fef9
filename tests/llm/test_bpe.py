import random

import public_tokenizers
import pytest
import tiktoken
from loomhouse.llm import bpe

from .helpers import DOC, documents, prose

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


TEXTS = [
    None,
    "",
    " ",
    "\n\n\n  a  b\t\tc   d　e\x1cf\x85g   ",
    "I'll can't 's'S we've 12345 678abc ½²Ⅷ１２ ~~~!!! <|endoftext|>",
    "日本語のテキスト 🙂🙂👩‍👩‍👧 Ünïcödé naïve Ελληνικά русский العربية",
    "a" * 3000,
    "abc" * 500 + "    " * 300,
    "x" * 255 + " " + "y" * 256 + " " + "z" * 257,
    prose(3, 4000),
]


def test_encode_like_the_library(spark, reference):
    docs = documents(spark, list(enumerate(TEXTS + TEXTS[-1:])))
    for r in bpe.encode(docs, PATH, public_tokenizers.PATTERN).collect():
        text = (TEXTS + TEXTS[-1:])[r["doc_id"]] or ""
        assert r["bpe"]["ids"] == reference.encode_ordinary(text)
        assert bytes(r["bpe"]["decoded"]) == text.encode()


def one_by_one(row, ranks):
    """Leftmost pair of least rank, one merge at a time."""
    parts = [bytes([b]) for b in row]
    while pairs := [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]:
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_rounds_are_merges_one_by_one():
    ranks = bpe.read_ranks(PATH)
    merger = bpe.Merger(ranks, public_tokenizers.PATTERN)
    r = random.Random(5)
    rows = [b"internationalisation", "schönheit".encode(), b"aaaaaaa", b"\xff\xfe\x00", b"zz" * 60, b"a" * 700]
    for letters in (b"ab", b"aeinrst", bytes(range(97, 123)), bytes(range(256))):
        rows += [bytes(r.choice(letters) for _ in range(r.randint(1, 150))) for _ in range(150)]
    rows += ["".join(r.choice("the and ing tion éü öß la de que 日本語".split()) for _ in range(r.randint(1, 90))).encode() for _ in range(50)]
    flat, first, many = merger.merge(rows)
    for k, row in enumerate(rows):
        assert flat[first[k] : first[k] + many[k]].tolist() == ([ranks[row]] if row in ranks else one_by_one(row, ranks))


@pytest.mark.parametrize("seed", range(20))
def test_any_ranks(seed):
    """Ranks in no sensible order: a merge may make a pair of lower rank, which then comes first."""
    r = random.Random(seed)
    tokens = [bytes([b]) for b in range(256)]
    longer = {bytes(r.choice(b"abc") for _ in range(r.randint(2, 6))) for _ in range(60)}
    numbers = list(range(256, 256 + len(longer)))
    r.shuffle(numbers)
    ranks = {t: i for i, t in enumerate(tokens)} | dict(zip(sorted(longer), numbers))
    merger = bpe.Merger(ranks, public_tokenizers.PATTERN)
    rows = [bytes(r.choice(b"abc") for _ in range(r.randint(1, 80))) for _ in range(200)]
    flat, first, many = merger.merge(rows)
    for k, row in enumerate(rows):
        assert flat[first[k] : first[k] + many[k]].tolist() == ([ranks[row]] if row in ranks else one_by_one(row, ranks))


def test_another_pattern(spark):
    """Texts are split by the pattern that is given, whatever it is."""
    pattern = r"[^\s]+\s*|\s+"
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    texts = ["one  two\n\nthree 1234567", "", " x", "can't stop"]
    got = bpe.encode(documents(spark, list(enumerate(texts))), PATH, pattern).collect()
    assert {r["doc_id"]: r["bpe"]["ids"] for r in got} == {k: own.encode_ordinary(t) for k, t in enumerate(texts)}


def test_a_very_long_match(reference):
    merger = bpe.Merger(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    text = "".join(random.Random(3).choice("etaoinshrdlu") for _ in range(20_000))
    assert merger.encode([text])[0].tolist() == reference.encode_ordinary(text)


def test_memory_is_emptied_when_full(reference, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    merger = bpe.Merger(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    for text in ("one two three four", "five one", "two three"):
        ids, many = merger.encode([text, ""])
        assert ids.tolist() == reference.encode_ordinary(text) and many.tolist() == [len(ids), 0]


def test_decode_table_and_bad_ids(spark):
    ids = bpe.encode(documents(spark, [(1, "hello Welt"), (2, None)]), PATH, public_tokenizers.PATTERN)
    out = bpe.decode(ids.selectExpr("doc_id", "bpe.ids as ids"), PATH, public_tokenizers.PATTERN)
    assert {r["doc_id"]: bytes(r["decoded"]) for r in out.collect()} == {1: b"hello Welt", 2: b""}
    odd = spark.createDataFrame([(None, 1), ([], 2), ([72], 3)], "ids array<int>, Decoded int")
    told = bpe.decode(odd, PATH, public_tokenizers.PATTERN)
    assert told.columns == ["ids", "Decoded", "decoded_"] and [len(r[2]) for r in told.orderBy("Decoded").collect()][:2] == [0, 0]
    for ids in ([999999], [-1], [None]):
        bad = spark.createDataFrame([(ids,)], "ids array<int>")
        with pytest.raises(Exception, match="outside the vocabulary"):
            bpe.decode(bad, PATH, public_tokenizers.PATTERN).collect()


def test_clashing_names_pass_through(spark):
    frame = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id bigint, text string, bpe int, Ids int")
    out = bpe.encode(frame, PATH, public_tokenizers.PATTERN)
    assert out.columns == [*frame.columns, "bpe_"] and out.first()["bpe"] == 5


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], DOC), PATH, public_tokenizers.PATTERN).collect() == []
