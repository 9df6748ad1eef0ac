"""Mix the documents of several sources to target shares of the total size.

1. Sizes are tokens of a public tokenizer (its vocabulary file is a parameter).
2. Soft membership: a document with a known source belongs to it wholly; one without gets posterior
   probabilities from a multinomial naive Bayes classifier over hashed character trigrams, fitted on a
   bounded sample of the labelled documents (``MAX_TRAIN_PER_SOURCE`` for each source).
3. For each mixture the total size is the largest that no listed source exceeds with its documents used
   ``max_repeats`` times each, and not more than the corpus; shares of listed sources without documents
   are reported as unreachable and the rest is scaled up. Projected gradient descent on the squared
   distance between expected and wanted tokens per source then fits a rate in [0, max_repeats] for every
   document. A document's rate depends only on its posteriors and on the sequence of residuals (a few numbers per
   round and mixture), so one round is one aggregation and no state is kept per document. The descent ends when no source
   of any mixture is further than ``TOLERANCE`` of the mixture's size from its goal, or after ``MAX_ROUNDS``; the distance left is reported.
4. Rates become whole numbers of copies by systematic rounding inside hash buckets of each source, so the
   totals of small sources come out close, too.

Scale: one pass tokenises and classifies; the documents' sizes and sparse posteriors are written once to the
checkpoint folder. Documents of equal membership fold into one row with their token total for the descent, so
only documents with soft membership are aggregated one by one. The driver holds one number per
mixture, source and round, and the classifier ``FEATURES`` weights a source (more than ``MAX_SOURCES`` sources are refused). Rounding windows are bounded by the bucket size, whatever a source's share is.

Edge cases: null and empty texts have no size and no copies; spelling variants of a source count as one
source; a mixture without any available source is reported with zero tokens; repeated rows count once;
other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.session import cut_lineage
from quillspark.sources.tables import table

TOKENIZER = os.environ.get("QUILLSPARK_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
MAX_TRAIN_PER_SOURCE = 2000
FEATURES = 1 << 14
#: Sources that the classifier tells apart; its weights take 128 KiB a source.
MAX_SOURCES = 1000
TOLERANCE, MAX_ROUNDS = 0.0005, 60
BUCKET_DOCUMENTS = 5000


def source_name(c: Column) -> Column:
    """One spelling: trimmed, lower case, with underscores; null for blanks."""
    name = F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")
    return F.when(name != "", name)


def encoder(path: str):
    """A function from texts to token counts."""
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def count(texts: list[str]) -> list[int]:
        return [len(encoding.encode_ordinary(t)) for t in texts]

    return count


def trigram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and count of the hashed character trigrams of the texts."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), np.fromiter((len(t) for t in texts), np.int64, len(texts)))
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] * np.uint64(0x165667B19E3779F9)) >> np.uint64(50)
    same = owner[:-2] == owner[2:]
    key, n = np.unique(owner[:-2][same] * FEATURES + h[same].astype(np.int64), return_counts=True)
    return key // FEATURES, key % FEATURES, n


class SourceClassifier:
    """Multinomial naive Bayes with add-one smoothing; evidence is scaled by document length to keep posteriors soft."""

    def __init__(self, names: list[str], counts: np.ndarray, documents: np.ndarray):
        self.names = names
        self.prior = np.log(documents / documents.sum()) if len(names) else np.zeros(0)
        self.weights = np.log((counts + 1.0) / (counts.sum(axis=1, keepdims=True) + FEATURES)) if len(names) else np.zeros((0, FEATURES))

    def posteriors(self, texts: list[str]) -> np.ndarray:
        row, feature, n = trigram_counts(texts)
        out = np.zeros((len(texts), len(self.names)))
        for k in range(len(self.names)):
            out[:, k] = np.bincount(row, weights=self.weights[k][feature] * n, minlength=len(texts))
        size = np.bincount(row, weights=n, minlength=len(texts))
        out = out * (30.0 / np.maximum(30.0, size))[:, None] + self.prior
        out = np.exp(out - out.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)


def fit_classifier(labelled: DataFrame) -> SourceClassifier:
    """Fits on up to ``MAX_TRAIN_PER_SOURCE`` documents of each source, those with the least hashes of their texts."""
    totals = labelled.groupBy("source").agg(F.count("*").alias("n"))
    found = sorted((r["source"], r["n"]) for r in totals.limit(MAX_SOURCES + 1).collect())
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; join rare ones under one name first")
    names = [name for name, _ in found]
    documents = np.array([n for _, n in found], float)
    # a share of each source by hash keeps the sample small without a sort of the whole source
    place = F.xxhash64("text") / F.lit(2.0**64) + 0.5
    sample = labelled.join(F.broadcast(totals), "source").where(place * F.col("n") < MAX_TRAIN_PER_SOURCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        position = {name: k for k, name in enumerate(names)}
        for batch in batches:
            label = np.array([position[s] for s in batch.column(0).to_pylist()], np.int64)
            row, feature, n = trigram_counts(batch.column(1).to_pylist())
            key, inverse = np.unique(label[row] * FEATURES + feature, return_inverse=True) if len(row) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            total = np.bincount(inverse, weights=n, minlength=len(key)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key // FEATURES), pa.array(key % FEATURES), pa.array(total)], ["label", "feature", "n"])

    rows = sample.select("source", "text").mapInArrow(run, "label long, feature long, n long").groupBy("label", "feature").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(names), FEATURES))
    counts[rows["label"].to_numpy(), rows["feature"].to_numpy()] = rows["n"].to_numpy()
    return SourceClassifier(names, counts, documents)


def membership(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, source, tokens, members)``: members are the sources a document belongs to, with probabilities."""
    rows = documents.where(F.col("text").isNotNull() & (F.col("text") != "")).select("doc_id", source_name(F.col("source")).alias("source"), "text").distinct()
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(fit_classifier(rows.where("source IS NOT NULL")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(tokenizer)
        classifier = model.value
        for batch in batches:
            source, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            unknown = [i for i, s in enumerate(source) if s is None]
            soft = classifier.posteriors([texts[i] for i in unknown]) if unknown and classifier.names else np.zeros((0, 0))
            members: list[list[dict]] = [[{"name": s, "p": 1.0}] if s is not None else [] for s in source]
            for k, i in enumerate(unknown):
                if classifier.names:
                    members[i] = [{"name": name, "p": float(p)} for name, p in zip(classifier.names, soft[k], strict=True)]
            kind = pa.list_(pa.struct([("name", pa.string()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count(texts), pa.int64()), pa.array(members, kind)], ["doc_id", "source", "tokens", "members"])

    return rows.mapInArrow(run, "doc_id long, source string, tokens long, members array<struct<name:string,p:double>>")


class MixPlan:
    """Goals and caps of the mixtures over all ``names`` of sources, and the steps of the descent so far.

    ``goals`` and ``caps`` have a row a mixture and a column a source; a source that a mixture does not list has a cap of -1.
    """

    def __init__(self, mixes: list[str], names: list[str]):
        self.mixes, self.names, self.place = mixes, names, {n: k for k, n in enumerate(names)}
        self.goals = np.zeros((len(mixes), len(names)))
        self.caps = np.full((len(mixes), len(names)), -1.0)
        self.sizes = np.zeros(len(mixes))
        self.residuals = np.zeros(len(mixes))
        self.steps: list[np.ndarray] = []

    def shares(self, members: pa.ListArray) -> np.ndarray:
        """Membership of each document in each source."""
        out = np.zeros((len(members), len(self.names)))
        values = members.flatten()
        column = np.array([self.place[n] for n in values.field(0).to_pylist()], np.int64)
        row = np.repeat(np.arange(len(members)), members.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        out[row, column] = values.field(1).to_numpy()
        return out

    def rates(self, shares: np.ndarray) -> np.ndarray:
        """A document's rate in each mixture: every step by its membership, each time projected to [0, its cap], the least one of the listed sources it belongs to."""
        out = np.zeros((len(shares), len(self.mixes)))
        belongs = shares > 0
        for m in range(len(self.mixes)):
            listed = self.goals[m] > 0
            cap = np.where(belongs & (self.caps[m] >= 0), self.caps[m], np.inf).min(axis=1, initial=np.inf)
            use = (belongs & listed).any(axis=1)
            rate = np.zeros(len(shares))
            for step in self.steps:
                rate = np.clip(rate + shares @ step[m], 0.0, cap)
            out[:, m] = np.where(use, rate, 0.0)
        return out


def fit_rates(members: DataFrame, targets: DataFrame) -> MixPlan:
    """Fits the rates of all mixtures to their goals, one aggregation of the documents a round."""
    asked = targets.select("mix_name", source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("double").alias("cap")).where("mix_name IS NOT NULL AND source IS NOT NULL").distinct().collect()
    # documents of equal membership share their rate: fold them
    folded = cut_lineage(members.groupBy("members").agg(F.sum("tokens").cast("double").alias("tokens")))
    each = folded.select(F.explode("members").alias("m"), "tokens").groupBy("m.name").agg(F.sum(F.col("m.p") * F.col("tokens")).alias("tokens"), F.sum(F.col("m.p") * F.col("m.p") * F.col("tokens")).alias("weight")).collect()
    names = sorted({r["name"] for r in each} | {r["source"] for r in asked})
    plan = MixPlan(sorted({r["mix_name"] for r in asked}), names)
    have, weight = np.zeros(len(names)), np.ones(len(names))
    for r in each:
        have[plan.place[r["name"]]], weight[plan.place[r["name"]]] = r["tokens"], max(r["weight"], 1e-9)
    wanted = np.zeros_like(plan.goals)
    for r in asked:
        m, k = plan.mixes.index(r["mix_name"]), plan.place[r["source"]]
        wanted[m, k] += r["share"] or 0.0
        plan.caps[m, k] = max(plan.caps[m, k], r["cap"] or 0.0)
    for m in range(len(plan.mixes)):
        usable = (wanted[m] > 0) & (have > 0) & (plan.caps[m] > 0)
        if usable.any():
            share = wanted[m][usable] / wanted[m][usable].sum()
            plan.sizes[m] = min(have.sum(), float((plan.caps[m][usable] * have[usable] / share).min()))
            plan.goals[m][usable] = plan.sizes[m] * share
    steps = np.where(plan.goals > 0, plan.goals / weight, 0.0)
    for _ in range(MAX_ROUNDS):
        plan.steps.append(steps)
        gap = plan.goals - expected_tokens(folded, plan)
        plan.residuals = np.abs(np.where(plan.goals > 0, gap, 0.0)).max(axis=1, initial=0.0) / np.maximum(plan.sizes, 1.0)
        if (plan.residuals <= TOLERANCE).all():
            break
        steps = np.where(plan.goals > 0, gap / weight, 0.0)
    return plan


def expected_tokens(folded: DataFrame, plan: MixPlan) -> np.ndarray:
    """Tokens of each mixture (row) and source (column) under the rates so far; only these sums come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(plan.goals)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                shares = plan.shares(part.column(0))
                total += (plan.rates(shares) * part.column(1).to_numpy()[:, None]).T @ shares
        m, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(k, pa.int64()), pa.array(total[m, k])], ["mix", "source", "tokens"])

    out = np.zeros_like(plan.goals)
    for r in folded.select("members", "tokens").mapInArrow(run, "mix long, source long, tokens double").groupBy("mix", "source").agg(F.sum("tokens").alias("tokens")).collect():
        out[r["mix"], r["source"]] = r["tokens"]
    return out


def copies(members: DataFrame, plan: MixPlan) -> DataFrame:
    """``(mix_name, doc_id, source, tokens, copies)`` of the documents used in each mixture."""
    kind = dict(members.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                shares = plan.shares(part.column("members"))
                rates = plan.rates(shares)
                row, mix = np.nonzero(rates > 0)
                known, likely = part.column("source").to_pylist(), shares.argmax(axis=1)
                source = [known[r] if known[r] is not None else plan.names[likely[r]] for r in row.tolist()]
                index = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([plan.mixes[m] for m in mix.tolist()], pa.string()), part.column("doc_id").take(index), pa.array(source, pa.string()), part.column("tokens").take(index), pa.array(rates[row, mix])],
                    ["mix_name", "doc_id", "source", "tokens", "rate"],
                )

    rows = members.where("tokens > 0").select("doc_id", "source", "tokens", "members").mapInArrow(run, f"mix_name string, doc_id {kind}, source string, tokens long, rate double")
    sizes = rows.groupBy("mix_name", "source").agg(F.count("*").alias("n"))
    rows = rows.join(sizes, ["mix_name", "source"])
    # systematic rounding along a bucket in the order of size: a document that loses its fraction is followed by one
    # of nearly the same size that gains it, so the token total stays near its expectation
    bucket = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET_DOCUMENTS)))
    w = Window.partitionBy("mix_name", "source", bucket).orderBy("tokens", F.xxhash64("doc_id"), "doc_id")
    expected = F.sum("rate").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    start = F.col("upto") - F.col("rate")
    rows = rows.withColumn("upto", expected)
    n = F.floor(F.col("upto") + 0.5 + 1e-9) - F.floor(start + 0.5 + 1e-9)
    return rows.withColumn("copies", n.cast("int")).where("copies > 0").select("mix_name", "doc_id", "source", "tokens", "copies")


def mix_sources(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The mixtures and a report of wanted and reached shares.

    Mixture: ``(mix_name, doc_id, source, tokens, copies)``. Report: ``(mix_name, source, target_share,
    actual_share, tokens, documents, most_copies, max_repeats, available, fit_residual)``; the last is the distance
    between expected and wanted tokens of the mixture that was left, as a share of its size.
    """
    members = cut_lineage(membership(documents, tokenizer))
    plan = fit_rates(members, targets)
    mixture = cut_lineage(copies(members, plan))
    left = members.sparkSession.createDataFrame([(m, float(r)) for m, r in zip(plan.mixes, plan.residuals, strict=True)], "mix_name string, fit_residual double")
    goals = targets.select("mix_name", source_name(F.col("source")).alias("source"), "target_share", "max_repeats").distinct().groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    reached = mixture.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    available = members.where("source IS NOT NULL").select("source").distinct().withColumn("available", F.lit(True))
    report = goals.join(reached, ["mix_name", "source"], "full").join(available, "source", "left").join(left, "mix_name", "left")
    report = report.withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    total = F.sum("tokens").over(Window.partitionBy("mix_name"))
    report = report.withColumn("actual_share", F.when(total > 0, F.col("tokens") / total).otherwise(0.0))
    return mixture, report.select(
        "mix_name", "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.round("actual_share", 6).alias("actual_share"), "tokens", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats", F.coalesce("available", F.lit(False)).alias("available"), F.round("fit_residual", 6).alias("fit_residual")
    )


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


QUERIES = {"p7_mixture": p7_mixture, "p7_shares": p7_shares}
