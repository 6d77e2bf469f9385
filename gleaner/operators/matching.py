"""Many words sought in many texts at once, by one automaton of the words."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of one automaton (about 200 bytes each); more words take several passes over the texts.
BLOCK_WORDS = 100_000


def word_blocks(words: DataFrame, word: str, block: int) -> Iterator[list[str]]:
    """The distinct words that are not empty, ``block`` at a time."""
    held: list[str] = []
    for row in words.select(F.col(word).alias("w")).where("w is not null and w <> ''").distinct().toLocalIterator():
        held.append(row["w"])
        if len(held) >= block:
            yield held
            held = []
    if held:
        yield held


def word_hits(rows: DataFrame, keep: list[str], fields: list[str], words: DataFrame, word: str, block: int = BLOCK_WORDS) -> DataFrame:
    """(keep..., word, n ARRAY<INT>): for each row and each word that stands in one of the ``fields``, how often it does in each.

    Occurrences are substrings and do not overlap. Texts are read once for each ``block`` of words and never shuffled;
    null fields hold nothing.
    """
    spark = rows.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields) + ", word string, n array<int>"
    base, out = rows.select(*keep, *fields), None
    for some in word_blocks(words, word, block):
        shared = spark.sparkContext.broadcast(some)

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            import ahocorasick

            auto = ahocorasick.Automaton()
            for w in shared.value:
                auto.add_word(w, w)
            auto.make_automaton()
            for pdf in batches:
                found = []
                for kept, texts in zip(pdf[keep].itertuples(index=False, name=None), pdf[fields].itertuples(index=False, name=None)):
                    counts: dict[str, list[int]] = {}
                    for k, text in enumerate(texts):
                        free: dict[str, int] = {}
                        for end, w in auto.iter(text or ""):
                            if end - len(w) + 1 >= free.get(w, 0):
                                counts.setdefault(w, [0] * len(fields))[k] += 1
                                free[w] = end + 1
                    found += [(*kept, w, n) for w, n in counts.items()]
                yield pd.DataFrame(found, columns=[*keep, "word", "n"])

        part = base.mapInPandas(scan, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)
