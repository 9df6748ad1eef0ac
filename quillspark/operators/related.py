"""The most related documents of the same chapter, compared in the task that holds the chapter; pairs are never rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents of a chapter that one task looks for; it meets all documents of the chapter.
OWN = 8192
#: Cells of words by documents that a task holds at once.
CELLS = 1 << 25
WORDS = 50


def _nearest(k: int, shared_only: bool):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc_id").combine_chunks()
        n = rows.num_rows
        column = lambda name: rows.column(name).combine_chunks()
        numbers = lambda name: pc.dictionary_encode(column(name)).indices.to_numpy()
        lists = column("w")
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        word, at = pc.dictionary_encode(lists.flatten()).indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(n), sizes)
        several = (np.bincount(word) > 1)[word] if len(word) else np.zeros(0, bool)
        _, word = np.unique(word[several], return_inverse=True)
        at, ids, sections = at[several], numbers("doc_id"), numbers("section_title")
        ends = np.searchsorted(at, np.arange(n + 1))
        terms = int(word.max()) + 1 if len(word) else 0
        own, out = np.flatnonzero(column("own").to_numpy(zero_copy_only=False)), []
        width = max(256, CELLS // max(1, terms))
        for lo in range(0, n, width):
            hi = min(n, lo + width)
            holds = np.zeros((terms, hi - lo), np.uint8)
            holds[word[ends[lo] : ends[hi]], at[ends[lo] : ends[hi]] - lo] = 1
            for i in own.tolist():
                # 1 and the shared words, 64 more for the same section: at most 115; documents are in the order of their ids
                value = np.add.reduce(holds[word[ends[i] : ends[i + 1]]], axis=0, dtype=np.uint8)
                met = (ids[lo:hi] != ids[i]) & (value > 0) if shared_only else ids[lo:hi] != ids[i]
                value = (value + 1 + np.where(sections[lo:hi] == sections[i], np.uint8(64), np.uint8(0))) * met
                for _ in range(min(k, hi - lo)):
                    j = int(value.argmax())
                    if not value[j]:
                        break
                    out.append((i, lo + j, int(value[j])))
                    value[j] = 0
        i, j, value = np.array(out, np.int64).reshape(-1, 3).T
        order = np.lexsort((j, -value, i))
        i, j, value = i[order], j[order], value[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        i, j, value = i[keep], j[keep], value[keep]
        same = value > 64
        names = column("doc_id")
        return pa.table([names.take(pa.array(i)), names.take(pa.array(j)), pa.array(same), pa.array(value - 1 - 64 * same), pa.array(sizes[i])], ["doc_id", "other_id", "same", "both", "n"])

    return run


def nearest_of_chapter(docs: DataFrame, k: int, shared_only: bool) -> DataFrame:
    """``(doc_id, other_id, same, both, n)`` of ``(doc_id, chapter_title, section_title, w)``: for each row the ``k`` rows of
    other documents of its chapter that are of the same section first, then share most words, ties by id.

    ``w``: at most ``WORDS`` distinct words; ``shared_only``: only documents that share a word. A large chapter is dealt out to several tasks.
    """
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "chapter_title", "section_title", "w")
    blocks = docs.groupBy("chapter_title").agg(F.ceil(F.count("*") / OWN).cast("long").alias("blocks"))
    dealt = docs.join(blocks, "chapter_title").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")) == F.col("block")).drop("blocks")
    kind = dict(docs.dtypes)["doc_id"]
    return dealt.groupBy("chapter_title", "block").applyInArrow(_nearest(k, shared_only), f"doc_id {kind}, other_id {kind}, same boolean, both long, n long")
