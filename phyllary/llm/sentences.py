"""Texts split into sentences (problem 10)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phyllary.llm.segmentation import sentences
from phyllary.session import in_batches


def split_sentences(df: DataFrame, key: str, text: str, with_text: bool = False, lang: str | None = None) -> DataFrame:
    """One row for each sentence: key, sent_no (from 1), start_char, end_char (code points from 0, end exclusive), and sent_text if asked.

    No blank stands at either end of a sentence; blank lines end sentences, other line breaks do not. Null and blank texts have none;
    texts are taken whole, however long; lang names the column with the declared language, which may be null, unknown or wrong; repeated rows are split each; other columns are not carried. An empty df gives an empty
    result. One pass over the rows without shuffle.
    """
    kind = df.select(key).schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, sent_no long, start_char long, end_char long" + ", sent_text string" * with_text
    rows = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"), (F.col(lang).cast("string") if lang else F.lit(None).cast("string")).alias("__lang")).where(F.col("__text").isNotNull())

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t, l in zip(b["__key"], b["__text"], b["__lang"], strict=True):
                out += [(k, i, s, e, t[s:e])[: 4 + with_text] for i, (s, e) in enumerate(sentences(t, l), 1)]
            if out:
                yield pd.DataFrame(out, columns=[key, "sent_no", "start_char", "end_char", "sent_text"][: 4 + with_text])

    return in_batches(rows, split, schema)
