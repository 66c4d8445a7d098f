"""Toxicity scores by a small convolutional text classifier, trained in numpy.

A word is the sum of three hashed embeddings: of the whole word and of its first four and six bytes, so that endings
matter less. Filters over one, two and three words, a maximum over all places of the whole text, and a logistic unit
make the score. Thresholds are set for each language, which is told from common words of the text, and scores are
shifted so that the threshold is the same number, 0.3, for all.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import staged, text_or_empty
from .words import PIECE_BYTES, cut_text, documents_hashes, separators, word_hashes

#: Labelled rows that the classifier is fitted on, at most, of each label, and the most bytes of a text among them; the
#: word hashes of this bounded sample are all that comes to the driver. Thresholds have no such bound.
TRAIN_ROWS = {1: 2500, 0: 5500}
TRAIN_BYTES = 200_000
#: One in so many labelled rows sets thresholds and teaches nothing.
CALIBRATION = 4
#: Rows that the errors of all languages count for in the threshold of one.
COMMON_ROWS = 64
#: Words that are convolved at a time.
PIECE_WORDS = 20_000
THRESHOLD = 0.3
#: Logits are counted in bins of this many a unit, those further out in the last one on either side.
BINS, FARTHEST = 64, 4096
PREFIXES = (4, 6)
WORD_BITS, PREFIX_BITS = 14, 13
#: Rows of the embedding table: words, two kinds of prefixes, and a row of zeros for padding and rare words.
TABLE = (1 << WORD_BITS) + 2 * (1 << PREFIX_BITS) + 1
DIMENSIONS, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
EPOCHS, BATCH, RATE = 8, 32, 0.02
PAD = max(WIDTHS) - 1
#: Frequent words that tell a text's language.
COMMON_WORDS = {
    "en": "the of and to in is that it was for",
    "de": "der die und das ist zu mit den von sie",
    "fr": "le et les des un une du est pour dans",
    "es": "el los las del una por con se su y",
}

_SEPARATORS = separators(string.punctuation)


def _common() -> np.ndarray:
    """Number of the language (from 1) of a word's row, 0 for words that tell nothing."""
    out = np.zeros(1 << WORD_BITS, dtype=np.int8)
    for i, words in enumerate(COMMON_WORDS.values(), 1):
        _, hashes = word_hashes(words.encode(), _SEPARATORS)
        out[(hashes & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)] = i
    return out


def _rows(word: np.ndarray, short: np.ndarray, long: np.ndarray) -> np.ndarray:
    return np.stack([word & np.uint64((1 << WORD_BITS) - 1), (1 << WORD_BITS) + (short & np.uint64((1 << PREFIX_BITS) - 1)), (1 << WORD_BITS) + (1 << PREFIX_BITS) + (long & np.uint64((1 << PREFIX_BITS) - 1))], axis=1).astype(np.uint16)


def feature_rows(texts) -> Iterator[np.ndarray]:
    """For each text its words' rows of the table, an array of three uint16 columns. Hashes of a long text are made, and
    become rows, piece by piece."""
    short: list[str] = []
    for text in texts:
        if len(text) <= PIECE_BYTES // 4:
            short.append(text)
            continue
        yield from (_rows(*words) for run in documents_hashes(short, _SEPARATORS, PREFIXES) for words in run)
        short = []
        yield np.concatenate([_rows(*word_hashes(piece, _SEPARATORS, PREFIXES)[1:]) for piece in cut_text(text.encode("utf-8", "surrogatepass"), _SEPARATORS)])
    yield from (_rows(*words) for run in documents_hashes(short, _SEPARATORS, PREFIXES) for words in run)


class Classifier:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.table = np.zeros((TABLE, DIMENSIONS), dtype=np.float32)
        self.table[:-1] = rng.normal(0, 0.05, (TABLE - 1, DIMENSIONS))
        #: One block of filters for each width and place in it.
        self.filters = rng.normal(0, 0.3, (DIMENSIONS, sum(WIDTHS) * FILTERS)).astype(np.float32)
        self.bias = np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32)
        self.weights = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.shift = np.float32(0)
        #: Logit thresholds by language, 0 being unknown.
        self.thresholds = np.zeros(len(COMMON_WORDS) + 1, dtype=np.float32)
        self.common = _common()

    def _pool(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maxima (documents, filters), the rows of all places, and the convolved values of all places."""
        zero = np.full((PAD, 3), TABLE - 1, dtype=np.int64)
        rows = np.concatenate([x for d in docs for x in (zero, d)] + [zero])
        lengths = np.array([len(d) + PAD for d in docs])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        words = self.table[rows[:, 0]] + self.table[rows[:, 1]] + self.table[rows[:, 2]]
        parts = words @ self.filters
        n, at, out = len(rows) - PAD, 0, []
        for width in WIDTHS:
            value = parts[:n, at : at + FILTERS].copy()
            for k in range(1, width):
                value += parts[k : n + k, at + k * FILTERS : at + (k + 1) * FILTERS]
            out.append(value)
            at += width * FILTERS
        values = np.concatenate(out, axis=1)
        return np.maximum.reduceat(values, starts, axis=0), rows, values

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        """Long documents are pooled in pieces that overlap by the widest filter."""
        pieces = [d[low : low + PIECE_WORDS + PAD] for d in docs for low in range(0, max(len(d), 1), PIECE_WORDS)]
        owner = np.repeat(np.arange(len(docs)), [max(1, -(-len(d) // PIECE_WORDS)) for d in docs])
        pooled, low = [], 0
        while low < len(pieces):
            high, n = low, 0
            while high < len(pieces) and (high == low or n + len(pieces[high]) <= PIECE_WORDS):
                n += len(pieces[high])
                high += 1
            pooled.append(self._pool(pieces[low:high])[0])
            low = high
        most = np.maximum.reduceat(np.concatenate(pooled), np.searchsorted(owner, np.arange(len(docs))), axis=0)
        return np.maximum(most + self.bias, 0) @ self.weights + self.shift

    def language(self, doc: np.ndarray) -> int:
        return int(np.bincount(self.common[doc[:, 0]], minlength=len(self.thresholds))[1:].argmax()) + 1 if len(doc) and self.common[doc[:, 0]].any() else 0

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        raw = self.logits(docs) - self.thresholds[[self.language(d) for d in docs]]
        return 1 / (1 + np.exp(-np.clip(raw.astype(np.float64) + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, seed: int = 3) -> None:
        """Adam on the logistic loss; rows seen in one document only stay zero, so that no document is learned by heart."""
        rng = np.random.default_rng(seed)
        toxic, clean = np.zeros(TABLE), np.zeros(TABLE)
        for d, y in zip(docs, labels):
            (toxic if y else clean)[np.unique(d)] += 1
        # The first component starts as the evidence of a row, and the first filter of width one reads it.
        odds = np.log((toxic + 0.5) / (labels.sum() + 1)) - np.log((clean + 0.5) / (len(labels) - labels.sum() + 1))
        self.table[:, 0] = np.maximum(odds, 0) * (1 - np.exp(-toxic / 3)) * 0.5
        self.table[(toxic + clean) < 2] = 0
        self.filters[:, 0], self.filters[0, 0], self.weights[0] = 0, 1, 2
        self.shift = np.float32(-3)
        params = [self.table, self.filters, self.bias, self.weights]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        fixed, steps = self.table[:, 1] == 0, 0
        moment = [0.0, 0.0]
        toxic_share = labels.sum() / max(1, len(labels))
        weight = np.where(labels == 1, 0.5 / max(toxic_share, 1e-6), 0.5 / max(1 - toxic_share, 1e-6))
        for _ in range(EPOCHS if len(set(labels.tolist())) > 1 else 0):
            for part in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // BATCH)):
                some = [docs[i] for i in part]
                pooled, rows, values = self._pool(some)
                z = pooled + self.bias
                active = np.maximum(z, 0)
                error = (1 / (1 + np.exp(-np.clip(active @ self.weights + self.shift, -30, 30))) - labels[part]) * weight[part] / len(part)
                back = np.where(z > 0, error[:, None] * self.weights, 0).astype(np.float32)
                grads = [np.zeros_like(self.table), np.zeros_like(self.filters), back.sum(0), (error[:, None] * active).sum(0)]
                # The first place of each maximum; its words get the gradient.
                start = 0
                for i, d in enumerate(some):
                    end = start + len(d) + PAD
                    hit = values[start:end].argmax(axis=0) + start
                    start = end
                    at = 0
                    for w, width in enumerate(WIDTHS):
                        own = slice(w * FILTERS, (w + 1) * FILTERS)
                        for k in range(width):
                            block = slice(at + k * FILTERS, at + (k + 1) * FILTERS)
                            r = rows[hit[own] + k]
                            word = self.table[r].sum(axis=1)
                            grads[1][:, block] += (word * back[i, own, None]).T
                            np.add.at(grads[0], r, (self.filters[:, block].T * back[i, own, None])[:, None, :])
                        at += width * FILTERS
                steps += 1
                grads[0][fixed] = 0
                for p, g, m, v in zip(params, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-6)
                g = error.sum()
                moment = [moment[0] + 0.1 * (g - moment[0]), moment[1] + 0.001 * (g * g - moment[1])]
                self.shift = np.float32(self.shift - RATE * (moment[0] / (1 - 0.9**steps)) / (np.sqrt(moment[1] / (1 - 0.999**steps)) + 1e-6))

    def calibrate(self, docs: list[np.ndarray], labels: np.ndarray) -> None:
        """Thresholds from these rows."""
        if not len(docs):
            return
        raw = np.concatenate([self.logits(docs[i : i + 64]) for i in range(0, len(docs), 64)])
        bins = np.clip(np.floor(raw.astype(np.float64) * BINS), -FARTHEST, FARTHEST).astype(np.int64)
        self.set_thresholds(np.array([self.language(d) for d in docs]), bins, labels, np.ones(len(docs), dtype=np.int64))

    def set_thresholds(self, language: np.ndarray, bins: np.ndarray, labels: np.ndarray, count: np.ndarray) -> None:
        """Thresholds from counts of rows by language, bin and label: each language's has the fewest errors, those of
        all languages counting for COMMON_ROWS rows beside its own; it lies halfway between the bins on both sides. A
        language with few rows so takes nearly the common threshold. Without rows of both labels all stay 0."""
        self.thresholds[:] = 0
        if len(set(labels[count > 0].tolist())) < 2:
            return
        x, at = np.unique(bins, return_inverse=True)

        def errors(pick: np.ndarray) -> np.ndarray:
            """For each cut the toxic rows under it and the clean rows from it on."""
            toxic = np.bincount(at, weights=count * (pick & (labels == 1)), minlength=len(x))
            clean = np.bincount(at, weights=count * (pick & (labels == 0)), minlength=len(x))
            return np.concatenate([[0], np.cumsum(toxic)]) + np.concatenate([np.cumsum(clean[::-1])[::-1], [0]])

        everything = errors(np.ones(len(at), dtype=bool))
        for k in range(len(self.thresholds)):
            wrong = errors(language == k) + everything * (COMMON_ROWS / count.sum())
            least = np.flatnonzero(wrong <= wrong.min() + 1e-9)
            cut = int(least[len(least) // 2])
            low, high = x[max(cut - 1, 0)] + (cut > 0), x[min(cut, len(x) - 1)] + (cut == len(x))
            self.thresholds[k] = float(low + high) / (2 * BINS)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2


def _known(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labels that may teach; of two rows of one doc_id the toxic one."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    return known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id")))


def calibrates(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(5)), F.lit(CALIBRATION)) == 0


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    """A classifier without thresholds from labels(doc_id, toxic) and docs(doc_id, text).

    Only rows that are neither held out nor set aside for the thresholds teach it: at most TRAIN_ROWS of each label,
    taken by hash, of texts up to TRAIN_BYTES. Of rows that repeat a doc_id the one with the least text hash counts.
    Without labels of both kinds every text gets the same score.
    """
    known = _known(labels).filter(~calibrates(F.col("doc_id")))
    text = text_or_empty()
    sizes = docs.select("doc_id", F.xxhash64(text).alias("key"), F.octet_length(text).alias("n")).join(known, "doc_id").filter(F.col("n") <= TRAIN_BYTES)
    sizes = staged(sizes.groupBy("doc_id").agg(F.min("key").alias("key"), F.max("toxic").alias("toxic")), "toxic-known")
    chosen = [sizes.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in TRAIN_ROWS.items()]
    chosen = staged(chosen[0].unionByName(chosen[1]), "toxic-sample")

    @F.pandas_udf("binary")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([x.tobytes() for x in feature_rows(texts)], dtype=object)

    own = docs.select("doc_id", text.alias("text")).withColumn("key", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "key"])
    # Rows with one doc_id and text have the same features.
    rows = {r["doc_id"]: (r["x"], r["toxic"]) for r in own.select("doc_id", "toxic", features("text").alias("x")).toLocalIterator()}
    rows = [rows[k] for k in sorted(rows)]
    data = [np.frombuffer(x, dtype=np.uint16).reshape(-1, 3) for x, _ in rows]
    model = Classifier()
    model.fit(data, np.array([y for _, y in rows], dtype=np.int64))
    return model


def read(text: Column, model: Classifier, spark) -> Column:
    """(logit, language) of a whole text, before thresholds; null counts as empty."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("logit double, language int")
    def reads(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for texts in batches:
            logits, languages, run, size = [], [], [], 0
            for x in feature_rows(texts):
                run.append(x)
                size += len(x)
                languages.append(own.language(x))
                if size > PIECE_WORDS:
                    logits.append(own.logits(run))
                    run, size = [], 0
            if run:
                logits.append(own.logits(run))
            yield pd.DataFrame({"logit": np.concatenate(logits).astype(np.float64) if logits else np.empty(0), "language": np.array(languages, dtype=np.int32)})

    return reads(text_or_empty(text))


def set_thresholds(read_docs: DataFrame, labels: DataFrame, model: Classifier) -> None:
    """The model's thresholds from all labelled rows set aside for that, in read_docs(doc_id, key, logit, language).

    At their own class ratio, whatever the ratio in the sample that taught it. Of rows that repeat a doc_id the one
    with the least text hash counts. What comes to the driver is bounded by languages, bins and labels.
    """
    bin_ = F.greatest(F.lit(-FARTHEST), F.least(F.lit(FARTHEST), F.floor(F.col("logit") * BINS)))
    known = _known(labels).filter(calibrates(F.col("doc_id")))
    rows = read_docs.select("doc_id", "key", "language", bin_.cast("int").alias("bin")).join(known, "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("key", "language", "bin", "toxic")).alias("r"))
    counts = rows.groupBy("r.language", "r.bin", "r.toxic").count().collect()
    if counts:
        model.set_thresholds(*(np.array([r[i] for r in counts], dtype=np.int64) for i in range(4)))


def score_documents(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns + (score, predicted) for each row of docs(doc_id, text, ...), with a classifier taught by labels.

    predicted is 1 from a score of 0.3 on. Null and empty texts get the score of no words. Repeated rows are scored
    alike, each in its row; extra columns are not read; an empty table gives no rows.
    """
    model = train(docs, labels)
    # The kept columns go along, so that texts are read by the model once.
    kept = F.struct(*[F.col(c) for c in keep]).alias("kept")
    done = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("key"), kept, read(F.col("text"), model, docs.sparkSession).alias("r"))
    done = staged(done.select("doc_id", "key", "kept", "r.logit", "r.language"), "toxic-read")
    set_thresholds(done, labels, model)
    over = F.col("logit") - F.element_at(F.array(*[F.lit(float(t)) for t in model.thresholds]), F.col("language") + 1)
    # At the threshold the score is that of the threshold, without rounding.
    x = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), over + float(np.log(THRESHOLD / (1 - THRESHOLD)))))
    scored = done.select("kept.*", F.when(over == 0, THRESHOLD).otherwise(1 / (1 + F.exp(-x))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
