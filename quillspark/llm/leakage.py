"""Evaluation items that occur, wholly or partly, in corpus documents.

Both sides are normalised (NFKC, lower case, letters and digits only) and cut into windows: items at
every character, documents at every ``RUN - WINDOW + 1``-th. A run of ``RUN`` characters that a document
shares with an item then holds a whole document window, which also is an item window. Each window gets a
64-bit SimHash of its shingles; two fingerprints within ``RADIUS`` bits agree in at least one of
``RADIUS + 1`` blocks, so an equi-join on the blocks meets all of them. A candidate is then verified on the
texts: the exact shared run, and the weighted-shingle similarity of the item and the item-sized stretch of the
document that covers most of it, in which a shingle weighs the less the more items have it; shingles of the
stretch that the item lacks weigh like those of a single item. ``leaks`` selects by the run, ``edited_leaks`` by the similarity, so that
it also has items that were changed in a few places.

Scale: document windows never leave their task but as (id, fingerprint); items are a small
table whose windows are broadcast only below ``BROADCAST_WINDOWS`` and joined by shuffle above. Blocks are 32 bits wide, so
a block of a large corpus meets few others by chance. Shingle weights are a table that is joined to the items. Texts
meet candidates only, after they shrank to distinct document-item pairs.

Edge cases: null and short texts (below ``RUN`` normalised characters) share no run; equal items and equal
documents each give their own rows; repeated rows count once; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.tables import table

RUN = 60
WINDOW = 40
SHINGLE = 5
#: With one more block than this many differing bits a block is 32 bits wide.
RADIUS = 1
#: Least weighted similarity of an edited leak.
SIMILAR = 0.8
#: Below this number of item windows their blocks are broadcast.
BROADCAST_WINDOWS = 400_000

_OTHER = re.compile(r"[\W_]+")
#: Distance of document windows: a shared run of RUN characters holds one of them wholly.
DOCUMENT_STRIDE = RUN - WINDOW + 1


def normalise(text: str) -> str:
    return _OTHER.sub("", unicodedata.normalize("NFKC", text).lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(codes) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = h * np.uint64(0x100000001B3) + codes[k : k + n]
    return _mix(h)


def fingerprints(text: str, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit SimHash of the windows of a normalised text at every ``stride``-th position."""
    h = shingle_hashes(text)
    per = WINDOW - SHINGLE + 1
    if len(h) < per:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.zeros((len(h) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=total[1:])
    starts = np.arange(0, len(h) - per + 1, stride)
    ones = total[starts + per] - total[starts]
    packed = np.packbits(2 * ones > per, axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return starts.astype(np.int32), packed.view(np.int64)


def _windows(stride: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, pos, prints = [], [], []
            for r, text in enumerate(batch.column(1).to_pylist()):
                norm = normalise(text)
                # long texts in stretches, which overlap by a window
                for lo in range(0, max(1, len(norm)), 100_000 // stride * stride):
                    starts, fp = fingerprints(norm[lo : lo + 100_000 // stride * stride + WINDOW - 1], stride)
                    take.append(np.full(len(fp), r, np.int64))
                    pos.append(starts + lo)
                    prints.append(fp)
            index = pa.array(np.concatenate(take) if take else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(index), pa.array(np.concatenate(pos).astype(np.int32) if pos else np.zeros(0, np.int32)), pa.array(np.concatenate(prints) if prints else np.zeros(0, np.int64))],
                ["id", "pos", "print"],
            )

    return run


def windows(texts: DataFrame, id_column: str, text_column: str, stride: int) -> DataFrame:
    """``(id, pos, print)`` of the windows of distinct texts."""
    rows = texts.where(F.col(text_column).isNotNull() & (F.col(text_column) != "")).select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(_windows(stride), "id long, pos int, print long")


def blocks(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per fingerprint and block of it."""
    width = 64 // (radius + 1)
    mask = (1 << width) - 1
    parts = F.array(*[F.struct(F.lit(k).alias("number"), F.shiftrightunsigned("print", k * width).bitwiseAND(F.lit(mask)).alias("value")) for k in range(radius + 1)])
    return prints.select("id", "print", F.explode(parts).alias("block"))


def candidates(documents: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, item_id)`` that have windows within ``radius`` bits of each other."""
    item_blocks = blocks(windows(items, "item_id", "text", 1).select("id", "print").distinct(), radius).select(F.col("id").alias("item_id"), F.col("print").alias("item_print"), "block")
    doc_blocks = blocks(windows(documents, "doc_id", "text", DOCUMENT_STRIDE).select("id", "print"), radius).select(F.col("id").alias("doc_id"), F.col("print").alias("doc_print"), "block")
    small = item_blocks.select("item_id").limit(BROADCAST_WINDOWS * (radius + 1) + 1).count() <= BROADCAST_WINDOWS * (radius + 1)
    other = F.broadcast(item_blocks) if small else item_blocks
    near = F.bit_count(F.col("doc_print").bitwiseXOR(F.col("item_print"))) <= radius
    return doc_blocks.join(other, "block").where(near).select("doc_id", "item_id").distinct()


def weighted_items(items: DataFrame) -> DataFrame:
    """Adds ``features`` and ``weights`` to distinct items: each shingle and ``log(1 + items / items that have it)``, and the weight ``rare`` of a single item's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(normalise(t))).view(np.int64) for t in batch.column(1).to_pylist()]
            index = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], ["item_id", "h"])

    total = items.count()
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, h long")
    weights = rows.groupBy("h").agg(F.log1p(F.lit(float(max(1, total))) / F.count("*")).alias("w"))
    lists = rows.join(weights, "h").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("h", "w"))).alias("pairs"))
    return items.join(lists, "item_id", "left").select("item_id", "text", F.coalesce(F.col("pairs.h"), F.array().cast("array<long>")).alias("features"), F.coalesce(F.col("pairs.w"), F.array().cast("array<double>")).alias("weights"), F.lit(float(np.log1p(max(1, total)))).alias("rare"))


def weighted_similarity(document: str, size: int, features: np.ndarray, weights: np.ndarray, rare: float) -> float:
    """Weighted Jaccard similarity of an item's shingles and those of the stretch of ``size`` characters of the normalised document that covers most of them."""
    h = shingle_hashes(document).view(np.int64)
    if not len(h) or not len(features):
        return 0.0
    at = np.minimum(np.searchsorted(features, h), len(features) - 1)
    known = features[at] == h
    per = min(len(h), max(1, size - SHINGLE + 1))
    total = np.concatenate([[0.0], np.cumsum(np.where(known, weights[at], 0.0))])
    start = int(np.argmax(total[per:] - total[: len(total) - per]))
    stretch, mine = h[start : start + per], known[start : start + per]
    both = float(weights[np.unique(at[start : start + per][mine])].sum())
    other = rare * len(np.unique(stretch[~mine]))
    return both / (float(weights.sum()) + other)


def shared_run(document: str, item: str, run: int = RUN) -> tuple[int, int]:
    """Length of the longest run that the normalised texts share, if it has at least ``run`` characters, and its start in the document."""
    grams: dict[str, list[int]] = {}
    for k in range(0, len(item) - run + 1):
        grams.setdefault(item[k : k + run], []).append(k)
    best, at = 0, -1
    p = 0
    while p <= len(document) - run:
        hits = grams.get(document[p : p + run])
        if hits:
            length = 0
            for k in hits:
                n = run
                while p + n < len(document) and k + n < len(item) and document[p + n] == item[k + n]:
                    n += 1
                length = max(length, n)
            if length > best:
                best, at = length, p
            p += length - run + 1
        else:
            p += 1
    return best, at


def _verify(run_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, share, alike = [], [], []
            last, norm = None, ""
            columns = [batch.column(k).to_pylist() for k in (2, 3)] + [batch.column(k) for k in (4, 5, 6)]
            for r, (doc, item) in enumerate(zip(columns[0], columns[1], strict=True)):
                if doc != last:
                    last, norm = doc, normalise(doc)
                other = normalise(item)
                n, _ = shared_run(norm, other, run_length)
                lengths.append(n)
                share.append(n / max(1, len(other)))
                features, weights = columns[2][r].values.to_numpy(), columns[3][r].values.to_numpy()
                alike.append(weighted_similarity(norm, len(other), features, weights, columns[4][r].as_py()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths, pa.int32()), pa.array(share, pa.float64()), pa.array(alike, pa.float64())], ["doc_id", "item_id", "run_chars", "item_share", "similarity"])

    return run


def judged_candidates(documents: DataFrame, items: DataFrame, run_length: int = RUN) -> DataFrame:
    """``(doc_id, item_id, run_chars, item_share, similarity)`` of all candidates; ``run_chars`` is 0 below ``run_length``."""
    if run_length < RUN:
        raise ValueError(f"windows are laid out for runs of at least {RUN} characters")
    documents = documents.select("doc_id", "text").where("text IS NOT NULL").distinct()
    items = items.select("item_id", "text").where("text IS NOT NULL").distinct()
    found = candidates(documents, items)
    texts = found.join(documents, "doc_id").select("doc_id", "item_id", F.col("text").alias("doc_text"))
    pairs = texts.join(weighted_items(items), "item_id").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("item_id").cast("long").alias("item_id"), "doc_text", F.col("text").alias("item_text"), "features", "weights", "rare")
    return pairs.mapInArrow(_verify(run_length), "doc_id long, item_id long, run_chars int, item_share double, similarity double")


def leaks(documents: DataFrame, items: DataFrame, run_length: int = RUN) -> DataFrame:
    """The candidates that share a run of at least ``run_length`` characters."""
    return judged_candidates(documents, items, run_length).where(F.col("run_chars") >= run_length)


def edited_leaks(documents: DataFrame, items: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The candidates that hold a whole item but for small edits: a weighted similarity of at least ``similar`` to an item-sized stretch.

    An item that is edited so often that no run of ``RUN`` characters is left is found where some window of it is left by chance.
    """
    return judged_candidates(documents, items).where(F.col("similarity") >= similar)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), table(spark, folder, "heldout_items")).select("doc_id", "item_id").distinct()


def p6_leaks_by_item(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents each leaked item occurs in, and the longest share of it found."""
    found = leaks(table(spark, folder, "documents"), table(spark, folder, "heldout_items"))
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.round(F.max("item_share"), 6).alias("largest_share"), F.max("run_chars").alias("longest_run"))


def p6_edited(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a whole item but for small edits."""
    found = edited_leaks(table(spark, folder, "documents"), table(spark, folder, "heldout_items"))
    return found.groupBy("doc_id", "item_id").agg(F.round(F.max("similarity"), 6).alias("similarity"))


QUERIES = {"p6_edited": p6_edited, "p6_found": p6_found, "p6_leaks_by_item": p6_leaks_by_item}
