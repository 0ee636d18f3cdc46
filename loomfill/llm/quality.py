"""Quality classifier on supervised subword embeddings.

Every word of a text (any run without ASCII white space, as it stands) gives
one word feature, its character n-grams, and a feature of how large a share of
the document's words it is (by its length, so that repetition shows), each
hashed into ``buckets`` rows of a table of vectors. A document is the mean of its features' vectors; a
linear layer and softmax turn it into label probabilities. Vectors and layer
are trained together by stochastic gradient descent in numpy.

Only fitting is bounded: it takes labelled rows in the order of their ids'
digests, up to ``max_rows`` rows and ``max_bytes`` bytes of whole texts. Scoring
covers every row and whole texts. Texts are bytes here, valid UTF-8 or not.

As the mean and the layer are both linear, the fitted model folds into one
number per bucket (a document's log-odds are the mean of its features' numbers
plus a bias), which is what workers get: ``4 * buckets`` bytes, whatever the data.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfill.llm.common import release_memory, small_batches, table, tidy

#: At most so many labelled rows, and bytes of their texts, are used for fitting.
MAX_ROWS, MAX_BYTES = 3_000, 32 << 20
MEMO = 100_000


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 18
    dim: int = 8
    n_min: int = 2
    n_max: int = 4
    epochs: int = 4
    rate: float = 2.0
    share_weight: int = 6
    seed: int = 7


def word_features(word: bytes, s: Settings) -> list[int]:
    """Buckets of a word and its character n-grams. Long words give n-grams of their whole length too."""
    marked = b"<" + word + b">"
    crc, buckets = zlib.crc32, s.buckets
    out = [crc(b"\x00" + marked) % buckets]
    for n in range(s.n_min, s.n_max + 1):
        out += [crc(marked[i : i + n], n) % buckets for i in range(len(marked) - n + 1)]
    return out


def share_key(length: int, count: int, n_words: int) -> tuple[int, int, int]:
    """What tells of repetition: a word's length, its share of the words and their number, in powers of two."""
    return (length if length < 12 else 12, min(n_words // count, 4096).bit_length(), min(n_words, 128).bit_length())


def share_feature(key: tuple[int, int, int], s: Settings) -> int:
    return zlib.crc32(b"%d %d %d" % key, 0xFFFF) % s.buckets


class FeatureMemo(dict):
    """Holds at most two generations of ``MEMO`` keys; those in use survive a change."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, word):
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


@dataclass
class Model:
    """Log-odds of label 1 of each bucket, and the bias."""

    settings: Settings
    odds: np.ndarray
    bias: float

    def scorer(self):
        """A function from text to the probability of label 1."""
        odds, s = self.odds, self.settings

        values = odds.tolist()  # plain floats: a word has too few features for numpy to pay

        def summed(word: bytes) -> tuple[float, int, int]:
            found = word_features(word, s)
            return sum(map(values.__getitem__, found)), len(found), min(len(word), 12)

        memo = FeatureMemo(summed)
        # By length and share in powers of two, for each size of a document in powers of two.
        shares = [[[s.share_weight * values[share_feature((a, b, c), s)] for b in range(14)] for a in range(13)] for c in range(9)]

        def score(text: bytes) -> float:
            words = text.split()  # of bytes: at ASCII white space
            n, total, features = len(words), 0.0, s.share_weight * len(words)
            table = shares[min(n, 128).bit_length()]
            for word, count in Counter(words).items():
                own, size, length = memo[word]
                total += count * (own + table[length][min(n // count, 4096).bit_length()])
                features += count * size
            x = self.bias + (total / features if features else 0.0)
            return 1.0 / (1.0 + float(np.exp(-min(max(x, -500.0), 500.0))))

        return score


def fit(texts: list[bytes], labels: list[int], settings: Settings = Settings()) -> Model:
    """Train on whole texts. Without rows, or with one label only, the model gives that label's share (0.5 without rows)."""
    s = settings
    ones = sum(labels)
    prior = float(np.log((ones + 0.5) / (len(labels) - ones + 0.5)))
    if not labels or ones in (0, len(labels)):
        return Model(s, np.zeros(s.buckets, np.float32), prior if labels else 0.0)
    rng = np.random.default_rng(s.seed)
    # Arrays, as lists of numbers would take the driver several times the memory.
    memo = FeatureMemo(lambda w: np.array(word_features(w, s), np.int32))
    rows = []
    for text in texts:
        counted = Counter(text.split())
        n = sum(counted.values())
        parts = [memo[w] for w in counted]
        shares = [share_feature(share_key(len(w), count, n), s) for w, count in counted.items()]
        counts = np.fromiter(counted.values(), np.int64, len(counted))
        found = np.concatenate([*parts, np.array(shares, np.int32)])
        weights = np.concatenate([np.repeat(counts, [len(p) for p in parts]), counts * s.share_weight])
        ids, index = np.unique(found, return_inverse=True)
        rows.append((ids, (np.bincount(index, weights, len(ids)) / max(1, weights.sum())).astype(np.float32)))
    del memo
    vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim)).astype(np.float32)
    layer, bias = np.zeros((2, s.dim), np.float32), np.zeros(2, np.float32)
    steps, done = s.epochs * len(rows), 0
    for _ in range(s.epochs):
        for k in rng.permutation(len(rows)):
            ids, share = rows[k]
            rate = s.rate * (1 - done / steps)
            done += 1
            own = vectors[ids]
            hidden = share @ own
            logit = layer @ hidden + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[labels[k]] -= 1  # the gradient by the logits
            back = p @ layer
            layer -= rate * np.outer(p, hidden)
            bias -= 0.1 * rate * p
            vectors[ids] = own - rate * len(ids) ** 0.5 * share[:, None] * back
    turn = layer[1] - layer[0]
    return Model(s, (vectors @ turn).astype(np.float32), float(bias[1] - bias[0]))


def held_out(id_col: Column) -> Column:
    """Rows never used for fitting: crc32 of the id as text leaves 1 modulo 3. A null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int, max_bytes: int) -> list:
    """Labelled, not held-out rows in the order of their ids' digests, up to ``max_rows``, and while they hold ``max_bytes`` at most.

    The ids are chosen first, from the small table, so that only the chosen
    rows' texts travel. Of several texts of one id the smallest is taken.
    """
    chosen = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("fit_id"))
        .agg(F.max(label_col).cast("int").alias("fit_label"))
        .withColumn("fit_order", F.sha2(F.col("fit_id").cast("string"), 256))
        .orderBy("fit_order", "fit_id")
        .limit(max_rows)
    )
    rows = docs.select(F.col(id_col).alias("fit_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("fit_text"))
    once = rows.join(F.broadcast(chosen), "fit_id").groupBy("fit_id", "fit_label", "fit_order").agg(F.min("fit_text").alias("fit_text"))  # max_rows rows at most
    upto = F.sum(F.octet_length("fit_text")).over(Window.orderBy("fit_order", "fit_id"))
    found = once.withColumn("fit_bytes", upto).where(F.col("fit_bytes") <= max_bytes).select("fit_id", "fit_label", "fit_text").collect()
    return sorted(found, key=lambda r: str(r.fit_id))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_rows: int = MAX_ROWS,
    max_bytes: int = MAX_BYTES,
    settings: Settings = Settings(),
) -> Model:
    """Fit on the labelled rows of ``docs`` that :func:`training_rows` takes; the driver keeps nothing but the model."""
    rows = training_rows(docs, labels, id_col, text_col, label_col, max_rows, max_bytes)
    labelled = [r.fit_label for r in rows]
    texts = [bytes(r.fit_text) for r in rows]
    del rows
    model = fit(texts, labelled, settings)
    del texts
    release_memory()
    return model


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Fit on labelled rows and score every row: ``doc_id, held_out, score, predicted``.

    Takes the options of :func:`train`. Null texts count as empty and get the
    bias alone. Labels other than 0 and 1 are not used; of several labels of one
    id the larger one is. Without usable labels every score is 0.5. Texts of any
    length are scored whole. Repeated rows get equal scores, an empty table gives
    an empty result, and columns other than id and text are not read.
    """
    return score_with(train(docs, labels, id_col, text_col, **options), docs, id_col, text_col)


def score_with(model: Model, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every row by a fitted model, under the rules of :func:`score_documents`."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = sent.value.scorer()
        for batch in batches:
            scores = np.array([score(t.as_py()) for t in batch.column(2)], np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = small_batches(docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), text.alias("text")))
    return rows.mapInArrow(tidy(run), f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs``, all columns as they are, without the rows that score below ``threshold``.

    Texts are scored where they stand, without a join by id, so null and repeated
    ids and columns of any name do no harm; the other rules are those of
    :func:`score_documents`, and so are the options.
    """
    model = train(docs, labels, id_col, text_col, **options)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at, schema = docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = sent.value.scorer()
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())  # as bytes, whether they are valid or not
            yield batch.filter(pa.array([score(t.as_py() or b"") >= threshold for t in texts], pa.bool_()))

    return small_batches(docs).mapInArrow(tidy(run), schema)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
