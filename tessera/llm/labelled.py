"""A bounded sample of labelled documents to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Whether a document belongs to the fold that no model may learn from; a NULL id is held out."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == fold, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, most: int,
           key: str = "doc_id", text: str = "text") -> DataFrame:
    """``text, label`` of at most ``most`` labelled rows outside the fold, picked by a hash of their ids.

    The pick is made on the labels alone, so its ids are at most ``most`` and are broadcast; texts are not
    shuffled before they are picked. A document labelled 0 and 1 counts as 1; a NULL label is none; of
    rows that share an id the least text counts, so an id with very many rows is still one."""
    known = (labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__id"))
             .agg(F.max(F.col(label).cast("int")).alias("__label")).where(~held_out(F.col("__id"), folds, fold)))
    picked = known.orderBy(F.xxhash64("__id"), "__id").limit(most)
    rows = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return (rows.join(F.broadcast(picked), F.col("__key") == F.col("__id")).groupBy("__id")
            .agg(F.min("text").alias("text"), F.first("__label").alias("label")).select("text", "label"))
