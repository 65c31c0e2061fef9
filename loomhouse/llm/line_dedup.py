"""Line dedup by content-defined line chunks, with DataFrame functions only.

A text is cut into lines at each \\n.  A rolling hash covers the hashes of two adjacent lines at a
time; one part of it says whether a chunk may begin with the first of the two, another whether a
chunk may end with the second.  A chunk reaches from a beginning to the next end, without another
beginning or end between them.  Both borders depend on lines of the chunk alone, so a passage is cut
alike wherever it stands.  Chunks have two lines at least and MAX_LINES at most: longer ones are
cut into equal pieces, which skips no line.

A chunk found more than once over all documents is removed from all places but the first (smallest id,
then smallest hash of the text, then first line).  Chunks are matched by hash and removed only if
their bytes equal those of the place that stays.  The lines beside a removed chunk, up to the
beginning of the chunk before and the end of the chunk after, go as far as they too equal, without a
gap, the lines beside the place that stays.  A single line that is repeated by itself always stays.

What is shuffled: a row of numbers for each chunk, the documents to meet their chunks (twice),
and the bytes of repeated chunks with the lines beside them.  Hot chunks are counted before the
shuffle, and in joins AQE splits them.  What documents meet grows with the corpus, so it is never broadcast.

Defined results: null texts stay null, empty texts empty; a text that loses all lines becomes
empty; the order of the lines that stay is kept; null ids come first in the order; rows equal in id and
text are places of their own, so only one of them, any, can keep a chunk; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, release, remove, written

#: Lines of a chunk at most.
MAX_LINES = 32
#: One pair of lines in BORDER is no beginning, and one in BORDER no end.
BORDER = 3


def _barrier(df: DataFrame, *columns: str, **made: Column) -> DataFrame:
    """df's `columns` and `made`, computed once: the optimizer does not copy them into later expressions."""
    return df.select(*columns, F.inline(F.array(F.struct(*[v.alias(k) for k, v in made.items()]))))


def _cut(df: DataFrame, *keep: str) -> DataFrame:
    """For each row with a text: `keep`, its lines, and its chunks in order: s, e (lines s to e - 1, from 0)."""
    lines = _barrier(df, *keep, lines=F.split("text", "\n", -1))
    hashed = _barrier(lines, *keep, "lines", h=F.transform("lines", lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("bigint")))
    rolled = F.transform(F.slice("h", 1, F.size("h") - 1), lambda x, i: F.struct(i.alias("k"), ((x * 31 + F.get("h", i + 1)) % (BORDER * BORDER)).alias("m")))
    begins = lambda x: x["m"] % BORDER != 0
    ends = lambda x: x["m"] >= BORDER
    borders = _barrier(hashed, *keep, "lines", pairs=F.filter(rolled, lambda x: begins(x) | ends(x)))
    last = lambda i: F.get("pairs", i - 1)
    from_to = lambda x, i: F.when(
        ends(x) & (begins(x) | F.coalesce(begins(last(i)) & ~ends(last(i)), F.lit(False))),
        F.struct(F.when(begins(x), x["k"]).otherwise(last(i)["k"]).alias("s"), (x["k"] + 2).alias("e")),
    )
    whole = _barrier(borders, *keep, "lines", whole=F.filter(F.transform("pairs", from_to), lambda c: c.isNotNull()))

    def cut(c: Column) -> Column:
        size = c["e"] - c["s"]
        many = F.ceil(size / MAX_LINES).cast("int")
        at = lambda j: (c["s"] + F.floor(j * size / many)).cast("int")
        return F.transform(F.sequence(F.lit(0), many - 1), lambda j: F.struct(at(j).alias("s"), at(j + 1).alias("e")))

    return _barrier(whole, *keep, "lines", chunks=F.flatten(F.transform("whole", cut)))


def _spans(cut: DataFrame, *keep: str) -> DataFrame:
    """One row for each chunk: `keep`, s, e, lo, hi (where the chunk before begins and the one after ends), two hashes."""

    def made(c: Column, i: Column) -> Column:
        lo = F.coalesce(F.get("chunks", i - 1)["s"], F.lit(0))
        hi = F.coalesce(F.get("chunks", i + 1)["e"], F.size("lines"))
        return F.struct(c["s"].alias("s"), c["e"].alias("e"), lo.alias("lo"), hi.alias("hi"), _text(c["s"], c["e"]).alias("chunk"))

    rows = cut.select(*keep, F.inline(F.transform("chunks", made)))
    return rows.select(*keep, "s", "e", "lo", "hi", F.xxhash64("chunk").alias("h1"), F.hash("chunk").alias("h2"))


def _lines(s: Column, e: Column) -> Column:
    return F.slice("lines", s + 1, e - s)


def _text(s: Column, e: Column) -> Column:
    return F.array_join(_lines(s, e), "\n")


def _alike(a: str, b: str) -> Column:
    """How many elements the arrays a and b have in common from their beginnings on."""
    least = F.least(F.size(a), F.size(b))
    differ = F.array_position(F.transform(F.slice(a, 1, least), lambda x, i: x == F.get(b, i)), False)
    return F.when(differ > 0, differ - 1).otherwise(least).cast("int")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated chunks taken out of the texts, and a struct column: n_lines, n_removed."""
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    base = base.withColumn("th", F.xxhash64("text"))
    keys = ["id", "th", "s", "e", "lo", "hi", "h1", "h2"]
    places, places_path = written(_spans(_cut(base, "id", "th"), "id", "th").groupBy(*keys).agg(F.count(F.lit(1)).alias("times")), "places")
    chosen = places.groupBy("h1", "h2").agg(F.sum("times").alias("n"), F.min(F.struct("id", "th", "s")).alias("first")).where("n > 1")
    first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th")) & (F.col("s") == F.col("first.s"))
    repeated = places.join(chosen, ["h1", "h2"]).select("id", "th", F.struct("s", "e", "lo", "hi", "h1", "h2", "times", first.alias("stays")).alias("span"))
    of_doc, of_doc_path = written(repeated.groupBy("id", "th").agg(F.collect_list("span").alias("spans")), "spans")
    remove(spark, places_path)
    release(spark)

    # the bytes of the repeated chunks and of the lines beside them, each against those of the place that stays
    named = of_doc.select(F.col("id").alias("r_id"), F.col("th").alias("r_th"), "spans").hint("merge")
    told = base.join(named, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("th") == F.col("r_th"))).select("id", "th", "text", "spans")
    told = _barrier(told, "id", "th", "spans", lines=F.split("text", "\n", -1))

    def chunk(x: Column) -> Column:
        numbers = [x[c].alias(c) for c in ("s", "e", "lo", "hi", "h1", "h2", "times", "stays")]
        return F.struct(*numbers, _text(x["s"], x["e"]).alias("chunk"), F.reverse(_lines(x["lo"], x["s"])).alias("before"), _lines(x["e"], x["hi"]).alias("after"))

    told, told_path = written(told.select("id", "th", F.inline(F.transform("spans", chunk))), "told")
    remove(spark, of_doc_path)
    release(spark)
    kept, kept_path = written(told.where("stays").select("h1", "h2", F.col("chunk").alias("k_chunk"), F.col("before").alias("k_before"), F.col("after").alias("k_after")).dropDuplicates(["h1", "h2"]), "kept")
    equal = told.where("not stays").join(kept, ["h1", "h2"]).where("chunk = k_chunk")
    gone = equal.select("id", "th", F.struct((F.col("s") - _alike("before", "k_before")).alias("s"), (F.col("e") + _alike("after", "k_after")).alias("e"), F.lit(False).alias("twin")).alias("span"), "times")
    # a further row equal in id and text loses the chunks of the place that stays as well, and all that is beside them
    twin = told.where("stays and times > 1").select("id", "th", F.struct(F.col("lo").alias("s"), F.col("hi").alias("e"), F.lit(True).alias("twin")).alias("span"), "times")
    of_doc, _ = written(gone.unionByName(twin).groupBy("id", "th").agg(F.array_sort(F.collect_list("span")).alias("spans"), F.max("times").alias("times")), "gone")
    for path in (told_path, kept_path):
        remove(spark, path)
    release(spark)

    # documents meet their own spans, once
    spans, th, r_id, r_th, lines, gone_name, rest_name, name, again, place = (fresh(docs, n) for n in ("spans", "th", "r_id", "r_th", "lines", "gone", "rest", "line_dedup", "again", "place"))
    own = F.col(f"`{id_col}`").eqNullSafe(F.col(r_id)) & (F.col(th) == F.col(r_th))
    left = docs.withColumn(th, F.xxhash64(F.col(f"`{text_col}`")))
    twins = of_doc.where("times > 1").select(F.col("id").alias(r_id), F.col("th").alias(r_th))
    if twins.isEmpty():
        left = left.withColumn(again, F.lit(False))
    else:  # of rows equal in id and text, all but one are further places
        rows, _ = written(left.join(twins, own, "left_semi").withColumn(place, F.monotonically_increasing_id()), "twins")
        one = rows.groupBy(f"`{id_col}`", th).agg(F.min(place).alias(place)).select(place, F.lit(False).alias(again))
        rows = rows.join(one, place, "left").withColumn(again, F.coalesce(again, F.lit(True))).drop(place)
        left = left.join(twins, own, "left_anti").withColumn(again, F.lit(False)).unionByName(rows)
    right = of_doc.select(F.col("id").alias(r_id), F.col("th").alias(r_th), F.col("spans").alias(spans)).hint("merge")
    out = left.join(right, own, "left")
    gone = F.filter(F.coalesce(spans, F.array().cast(of_doc.schema["spans"].dataType)), lambda x: ~x["twin"] | F.col(again))
    columns = [f"`{c}`" for c in docs.columns]
    out = _barrier(out, *columns, **{gone_name: gone, lines: F.split(F.col(f"`{text_col}`"), "\n", -1)})
    # spans may overlap, but both their beginnings and their ends are in order
    stop = lambda k: F.coalesce(F.get(gone_name, k)["s"], F.size(lines))
    start = lambda k: F.coalesce(F.get(gone_name, k - 1)["e"], F.lit(0))
    rest = F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone_name)), lambda k: F.slice(lines, start(k) + 1, F.greatest(stop(k) - start(k), F.lit(0)))))
    out = _barrier(out, *columns, gone_name, lines, **{rest_name: F.when(F.size(gone_name) > 0, rest)})
    text = F.when(F.size(gone_name) > 0, F.array_join(rest_name, "\n")).otherwise(F.col(f"`{text_col}`"))
    lost = F.when(F.size(gone_name) > 0, F.size(lines) - F.size(rest_name)).otherwise(0)
    told = F.struct(F.when(F.col(f"`{text_col}`").isNull(), 0).otherwise(F.size(lines)).cast("bigint").alias("n_lines"), lost.cast("bigint").alias("n_removed")).alias(name)
    return out.select(*[(text.alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns], told)


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without their repeated chunks; columns as they were."""
    return dedup(docs, id_col, text_col).select(*[F.col(f"`{c}`") for c in docs.columns])
