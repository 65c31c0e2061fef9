"""Bounded samples of labelled documents, met with their texts without a shuffle of the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label_col: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(label, text) of about `most` labelled documents: all, or a share chosen by a hash of the id.

    The share's ids and labels are broadcast: `most` rows of two numbers.  Rows with a null id
    or label are not learnt from; a null text counts as empty; repeated labels count each.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    n = known.count()
    grid = 1 << 40
    if n > most:
        known = known.where(F.pmod(F.xxhash64("id", F.lit(label_col)), F.lit(grid)) < int(grid * most / n))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(known), "id").select("label", "text")
