"""The best documents of each query by BM25, kept in the task that reads the documents.

Pairs of a query and a document are never rows: ``field_scores`` lists them all, which grows with queries times
documents. Here the documents become counts of the queries' terms, grouped and sorted by id; a task sums up the scores of a
block of its documents for all queries at once and hands on the best ``k`` of each query. Queries that have more than
``TERMS`` terms together are taken in several passes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property, reduce
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import tokens
from quillspark.operators.keyword import B, K1, top_hits
from quillspark.session import cut_lineage

#: Terms of queries that a task holds at once.
TERMS = 500_000
#: Documents and queries whose scores are summed up at once.
ROWS, QUERIES = 512, 256


class Found:
    """What a field of a block of documents has for a block of queries, as arrays of queries by documents."""

    def __init__(self, weights: np.ndarray, groups: np.ndarray, words: list[str], at: np.ndarray, starts: np.ndarray, counts: np.ndarray):
        self._weights, self._groups, self._words, self._at, self._starts, self._counts = weights, groups, words, at, starts, counts

    @cached_property
    def score(self) -> np.ndarray:
        return _sums(self._weights, self._at, self._starts, self._counts)

    @cached_property
    def matched(self) -> np.ndarray:
        """How many terms of the query occur."""
        return _sums(self._groups, self._at, self._starts, self._counts)

    def any_term(self, pattern: str) -> np.ndarray:
        """Whether a term of the query that fits the pattern occurs."""
        fits = np.array([re.fullmatch(pattern, w) is not None for w in self._words], bool)
        return _sums(self._groups * fits[:, None], self._at, self._starts, self._counts) > 0


def _sums(rows: np.ndarray, at: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of ``rows[at[start : start + count]]`` of each query: of all queries the first row, then the second."""
    order = np.argsort(-counts, kind="stable")
    most = -counts[order]
    sums, taken = np.zeros((len(counts), rows.shape[1])), np.empty((len(counts), rows.shape[1]))
    for j in range(-int(most[0]) if len(most) else 0):
        n = int(np.searchsorted(most, -j))
        np.take(rows, at[starts[order[:n]] + j], axis=0, out=taken[:n], mode="clip")
        sums[:n] += taken[:n]
    taken[order] = sums
    return taken


def _counted(vocabulary: list[str], fields: int, first: int):
    """The terms of each row and how often they occur, and the length of each field; ``first``: column of the first field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, size = pa.array(vocabulary, pa.string()), max(1, fields * len(vocabulary))
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                n, cells, lengths = part.num_rows, [], []
                for k in range(fields):
                    lists = part.column(first + k)
                    lengths.append(pc.list_value_length(lists).cast(pa.int32()))
                    codes = pc.index_in(lists.flatten(), value_set=words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                    owner = np.repeat(np.arange(n), lengths[-1].to_numpy(zero_copy_only=False))
                    cells.append((owner * size + k * len(vocabulary) + codes)[codes >= 0])
                cell, tf = np.unique(np.concatenate(cells), return_counts=True)
                pairs = np.stack([cell % size, tf], axis=1).astype("<u4")
                ends = np.searchsorted(cell, np.arange(n + 1) * size)
                packed = [zlib.compress(pairs[a:b].tobytes(), 1) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:first], *lengths, pa.array(packed, pa.binary())], [*part.schema.names[:first], *(f"l{k}" for k in range(fields)), "packed"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch], size: int = 0) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """About ``size`` (else ``ROWS``) rows at a time and the number of the id of each; rows come sorted by id, and an id is never torn."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = (rows if rest is None else pa.concat_tables([rest, rows])).combine_chunks()
        ends = np.asarray(pc.run_end_encode(rows.column("id").combine_chunks()).run_ends)
        last = int(ends[-2]) if len(ends) > 1 else 0
        yield from _cut(rows, ends[:-1], size or ROWS)
        rest = rows.slice(last)
    if rest is not None:
        yield from _cut(rest, np.array([rest.num_rows]), size or ROWS)


def _cut(rows: pa.Table, ends: np.ndarray, size: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    lo = done = 0
    while lo < len(ends):
        hi = min(len(ends), int(np.searchsorted(ends, done + size)) + 1)
        sizes = np.diff(np.concatenate([[done], ends[lo:hi]]))
        yield rows.slice(done, int(ends[hi - 1]) - done), np.repeat(np.arange(hi - lo), sizes)
        lo, done = hi, int(ends[hi - 1])


def _postings(rows: pa.Table, number: np.ndarray, terms: int, fields: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each field the term, document, length and frequency; rows of one id and length count as one document."""
    raw = [zlib.decompress(x) for x in rows.column("packed").to_pylist()]
    pairs = np.frombuffer(b"".join(raw), "<u4").reshape(-1, 2).astype(np.int64)
    owner = np.repeat(np.arange(len(raw)), [len(x) // 8 for x in raw])
    single = len(number) == number[-1] + 1
    for k in range(fields):
        mine = pairs[:, 0] // max(1, terms) == k
        code, tf, of = pairs[mine, 0] - k * terms, pairs[mine, 1], owner[mine]
        length = rows.column(f"l{k}").to_numpy()
        if single:
            yield code, of, length[of], tf
        else:
            _, first, group = np.unique(np.stack([number, length]), axis=1, return_index=True, return_inverse=True)
            cell, inverse = np.unique(group.reshape(-1)[of] * terms + code, return_inverse=True)
            row = first[cell // max(1, terms)]
            yield cell % max(1, terms), number[row], length[row], np.bincount(inverse, tf, minlength=len(cell))


def _statistics(terms: int, fields: int):
    """``(key, n)``: documents of each field's terms, behind them each field's tokens and the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(fields * terms + fields + 1, np.int64)
        for rows, number in _blocks(batches):
            for k, (code, _, _, _) in enumerate(_postings(rows, number, terms, fields)):
                total[k * terms : (k + 1) * terms] += np.bincount(code, minlength=terms)
                total[fields * terms + k] += int(rows.column(f"l{k}").to_numpy().sum(dtype=np.int64))
            total[-1] += rows.num_rows
        key = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(total[key])], ["key", "n"])

    return run


def _best(vocabulary: list[str], asked: pa.Array, starts: np.ndarray, flat: np.ndarray, statistics: np.ndarray, fields: list[str], combine: Callable, k: int, weighted: bool):
    terms, queries = len(vocabulary), len(asked)
    total = max(1, int(statistics[-1]))
    needed = np.diff(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, means = statistics[: len(fields) * terms].reshape(len(fields), terms), statistics[len(fields) * terms : -1] / total
        idf = np.log(1 + (total - df + 0.5) / (df + 0.5)) * (K1 + 1)
        of_query = np.repeat(np.arange(queries), needed)
        score, place, bound = np.full((queries, k), -np.inf), np.full((queries, k), -1), np.zeros(queries)
        ids, seen = [], 0
        for rows, number in _blocks(batches):
            n = int(number[-1]) + 1
            parts = []
            for f, (code, of, length, tf) in enumerate(_postings(rows, number, terms, len(fields))):
                there, local = np.unique(code, return_inverse=True)
                w = idf[f, code] * tf / (tf + K1 * (1 - B + B * length / max(means[f], 1e-300)))
                cell = local.reshape(-1) * n + of
                dense = lambda x=None, cell=cell, m=len(there): np.bincount(cell, x, minlength=m * n).reshape(m, n).astype(float)
                where = np.full(terms, -1)
                where[there] = np.arange(len(there))
                at = where[flat]
                counts = np.bincount(of_query[at >= 0], minlength=queries)
                parts.append((dense(w), dense(), [vocabulary[c] for c in there.tolist()], at[at >= 0], np.cumsum(counts) - counts, counts))
            for lo in range(0, queries, QUERIES):
                hi = min(queries, lo + QUERIES)
                found = {name: Found(*p[:4], p[4][lo:hi], p[5][lo:hi]) for name, p in zip(fields, parts, strict=True)}
                sums = combine(found, needed[lo:hi, None])
                if weighted:
                    sums = sums[:, number] * np.where(np.asarray(rows.column("id").is_valid()), rows.column("weight").to_numpy(), 0.0)
                _take(score, place, bound, np.arange(lo, hi), sums, seen, k)
            one = rows.column("id") if weighted else rows.column("id").take(pa.array(np.unique(number, return_index=True)[1]))
            ids.append(one)
            seen += len(one)
        q, j = np.nonzero(place >= 0)
        if len(q):
            every = pa.chunked_array([c for x in ids for c in x.chunks])
            yield from pa.table([asked.take(pa.array(q)), every.take(pa.array(place[q, j])), pa.array(score[q, j])], ["query_id", "id", "score"]).combine_chunks().to_batches(10_000)

    return run


def _take(score: np.ndarray, place: np.ndarray, bound: np.ndarray, queries: np.ndarray, sums: np.ndarray, seen: int, k: int) -> None:
    """Takes up documents; a later one has a larger id and must be better than the last one kept."""
    least = bound[queries]
    if (fresh := np.isinf(score[queries, -1])).any() and sums.shape[1] > k:
        least[fresh] = np.maximum(least[fresh], np.partition(sums[fresh], sums.shape[1] - k, axis=1)[:, sums.shape[1] - k] - 2e-6)
    q, d = np.nonzero(sums > least[:, None])
    if len(q):
        _merge(score, place, bound, queries[q], np.floor(sums[q, d] * 1e6 + 0.5) / 1e6, d + seen, k)


def _merge(score: np.ndarray, place: np.ndarray, bound: np.ndarray, q: np.ndarray, value: np.ndarray, at: np.ndarray, k: int) -> None:
    """Takes up new places of queries into their best, ties by place."""
    touched = np.unique(q)
    rows = np.concatenate([np.repeat(touched, k), q])
    values, places = np.concatenate([score[touched].reshape(-1), value]), np.concatenate([place[touched].reshape(-1), at])
    order = np.lexsort((places, -values, rows))
    rows = rows[order]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = nth < k
    score[rows[keep], nth[keep]], place[rows[keep], nth[keep]] = values[order][keep], places[order][keep]
    last = score[touched, -1]
    bound[touched] = np.where(np.isinf(last), 0.0, last + 4.9e-7)


def best_documents(terms: DataFrame, documents: DataFrame, id_column: str, fields: list[str], k: int, combine: Callable | None = None, weight: Column | None = None) -> DataFrame:
    """``(query_id, id, score, hit_rank)``: the ``k`` best documents of each query by rounded score, ties by id.

    ``combine`` makes the score of the fields' ``Found``, by name, and the number of terms of each query (default: the score of the
    only field); documents without a score above 0 are no hits. With ``weight``, rows of an id that has several are
    hits of their own, each with its weight.
    """
    terms = cut_lineage(terms.select("query_id", "term"))
    passes = max(1, ceil(terms.count() / TERMS))
    own = F.pmod(F.xxhash64("query_id"), F.lit(passes))
    hits = [_pass(terms.where(own == n) if passes > 1 else terms, documents, id_column, fields, k, combine or (lambda found, needed, f=fields[0]: found[f].score), weight) for n in range(passes)]
    return top_hits(reduce(DataFrame.unionByName, hits), k)


def _asked(terms: DataFrame) -> tuple[pa.Array, np.ndarray, np.ndarray, list[str]]:
    """The queries, where the terms of each begin, the terms by number, and the words of the numbers."""
    asked = terms.toArrow().combine_chunks()
    query, term = (pc.dictionary_encode(asked.column(c).combine_chunks()) for c in ("query_id", "term"))
    query, term = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (query, term))
    order = np.argsort(query.indices.to_numpy(), kind="stable")
    flat = term.indices.to_numpy()[order].astype(np.int64)
    starts = np.searchsorted(query.indices.to_numpy()[order], np.arange(len(query.dictionary) + 1))
    return query.dictionary, starts, flat, term.dictionary.to_pylist()


def _pass(terms: DataFrame, documents: DataFrame, id_column: str, fields: list[str], k: int, combine: Callable, weight: Column | None) -> DataFrame:
    queries, starts, flat, vocabulary = _asked(terms)
    first = ["id"] if weight is None else ["id", "weight"]
    rows = documents.select(F.col(id_column).alias("id"), *([] if weight is None else [weight.cast("double").alias("weight")]), *[tokens(F.coalesce(f, F.lit(""))).alias(f"t{n}") for n, f in enumerate(fields)])
    kinds = dict(rows.dtypes)
    counted = rows.mapInArrow(_counted(vocabulary, len(fields), len(first)), ", ".join([*(f"{c} {kinds[c]}" for c in first), *(f"l{n} int" for n in range(len(fields))), "packed binary"]))
    # read twice below, for the statistics and for the scores
    counted = cut_lineage(counted.repartition("id").sortWithinPartitions(F.col("id").asc_nulls_last()))
    found = counted.mapInArrow(_statistics(len(vocabulary), len(fields)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    statistics = np.zeros(len(fields) * len(vocabulary) + len(fields) + 1, np.int64)
    statistics[found.column("key").to_numpy()] = found.column("n").to_numpy()
    run = _best(vocabulary, queries, starts, flat, statistics, fields, combine, k, weight is not None)
    return counted.mapInArrow(run, f"query_id {dict(terms.dtypes)['query_id']}, id {kinds['id']}, score double")


def clauses_of(clauses: list[tuple[tuple[str, ...], float]]) -> Callable:
    """``combine`` of ``best_documents``: the sum over clauses of a clause's boost times its best field."""

    def combine(found: dict[str, Found], _: np.ndarray) -> np.ndarray:
        return sum(reduce(np.maximum, [found[f].score for f in fields]) * boost for fields, boost in clauses)

    return combine


def best_field_of(boosts: dict[str, float]) -> Callable:
    """``combine`` of ``best_documents``: the best boosted field."""

    def combine(found: dict[str, Found], _: np.ndarray) -> np.ndarray:
        return reduce(np.maximum, [found[f].score * boost for f, boost in boosts.items()])

    return combine


def _points(vocabulary: list[str], weights: list[int]):
    heads: dict[str, list[tuple[int, str]]] = {}
    for code, word in enumerate(vocabulary):
        heads.setdefault(word[:2], []).append((code, word))
    known = heads.keys()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, codes, points = [], [], []
            for row, texts in enumerate(zip(*(batch.column(1 + n).to_pylist() for n in range(len(weights))), strict=True)):
                found: dict[int, int] = {}
                for text, weight in zip(texts, weights, strict=True):
                    for head in known & {text[i : i + 2] for i in range(len(text) - 1)}:
                        for code, word in heads[head]:
                            if word in text:
                                found[code] = found.get(code, 0) + weight
                at += [row] * len(found)
                codes += found.keys()
                points += found.values()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(codes, pa.int32()), pa.array(points, pa.int32())], ["id", "code", "points"])

    return run


def _best_points(asked: pa.Array, starts: np.ndarray, flat: np.ndarray, terms: int, k: int):
    queries = len(asked)
    of_query = np.repeat(np.arange(queries), np.diff(starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, place, bound = np.full((queries, k), -np.inf), np.full((queries, k), -1), np.zeros(queries)
        ids, seen = [], 0
        for rows, number in _blocks(batches, 16 * ROWS):
            n = int(number[-1]) + 1
            there, local = np.unique(rows.column("code").to_numpy(), return_inverse=True)
            points = np.bincount(local.reshape(-1) * n + number, rows.column("points").to_numpy(), minlength=len(there) * n).reshape(len(there), n)
            where = np.full(terms, -1)
            where[there] = np.arange(len(there))
            at = where[flat]
            counts = np.bincount(of_query[at >= 0], minlength=queries)
            begins, at, met = np.cumsum(counts) - counts, at[at >= 0], np.flatnonzero(counts)
            for lo in range(0, len(met), QUERIES):
                own = met[lo : lo + QUERIES]
                _take(score, place, bound, own, _sums(points, at, begins[own], counts[own]), seen, k)
            ids.append(rows.column("id").take(pa.array(np.unique(number, return_index=True)[1])))
            seen += n
        q, j = np.nonzero(place >= 0)
        if len(q):
            every = pa.chunked_array([c for x in ids for c in x.chunks])
            yield from pa.table([asked.take(pa.array(q)), every.take(pa.array(place[q, j])), pa.array(score[q, j].astype(np.int64))], ["query_id", "id", "points"]).combine_chunks().to_batches(10_000)

    return run


def most_points(terms: DataFrame, documents: DataFrame, id_column: str, weights: dict[str, int], k: int) -> DataFrame:
    """``(query_id, id, points, nth)``: the ``k`` documents with the most points of each query, ties by id.

    A term (two characters at least) that a text column contains gives the column's points. Queries with equal terms are one.
    """
    terms = cut_lineage(terms.select("query_id", "term").distinct())
    sets = cut_lineage(terms.groupBy("query_id").agg(F.sort_array(F.collect_set("term")).alias("terms")).withColumn("first", F.min("query_id").over(Window.partitionBy("terms"))).select("query_id", "first"))
    terms = cut_lineage(terms.join(sets.where("query_id = first"), "query_id", "left_semi"))
    passes = max(1, ceil(terms.count() / TERMS))
    own = F.pmod(F.xxhash64("query_id"), F.lit(passes))
    found = []
    for n in range(passes):
        asked, starts, flat, vocabulary = _asked(terms.where(own == n))
        rows = documents.select(F.col(id_column).alias("id"), *weights)
        kind = dict(rows.dtypes)["id"]
        points = rows.mapInArrow(_points(vocabulary, list(weights.values())), f"id {kind}, code int, points int")
        points = points.repartition("id").sortWithinPartitions(F.col("id").asc_nulls_last())
        found.append(points.mapInArrow(_best_points(asked, starts, flat, len(vocabulary), k), f"query_id {dict(terms.dtypes)['query_id']}, id {kind}, points long"))
    best = Window.partitionBy("query_id").orderBy(F.col("points").desc(), F.col("id").asc_nulls_last())
    ranked = reduce(DataFrame.unionByName, found).withColumn("nth", F.row_number().over(best).cast("long")).where(F.col("nth") <= k)
    return sets.join(ranked.withColumnRenamed("query_id", "first"), "first").select("query_id", "id", "points", "nth")
