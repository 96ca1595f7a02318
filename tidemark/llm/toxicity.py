"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on what sets
toxic text apart. Each window of a few words of a text is compressed twice, with
the ordinary dictionary alone and with both. The bytes that the second one saves
say how much of the window is made of toxic material; a logistic model,
calibrated on rows that trained no dictionary, turns a text's savings into a
probability.

Most of a toxic text is like any other, so a dictionary of such texts as they
are differs from an ordinary one mainly by chance. Therefore the toxic one is
trained on those pieces of toxic samples that come back in many contexts there
and hardly ever in ordinary samples, and is laid over the ordinary one, which
makes the lengths differ by toxic pieces alone.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words in a window, and bytes after which a longer word is cut.
WINDOW, LONGEST = 8, 256
LEVEL = 12
ORDINARY_BYTES, TOXIC_BYTES = 16384, 8192
#: Labelled rows of each class that are read to fit at most, and the characters of a text up to which it is among them.
SAMPLE, SAMPLE_CHARS = 2500, 50_000
#: A word or a beginning of STEM bytes is toxic material if it has this many contexts (or this part of the toxic samples, if more), and is in this many times as large a part of them as of ordinary samples.
CONTEXTS, CONTEXT_SHARE, TIMES, STEM = 3, 0.005, 6, (4, 8)
EDGES = b".,;:!?()[]{}\"'*"


def windows(text: str | None) -> list[bytes]:
    """The text in lower case (A-Z only), cut to windows; an empty text is one empty window."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if any(len(w) > LONGEST for w in words):
        words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return [b" " + b" ".join(words[i : i + WINDOW]) for i in range(0, len(words), WINDOW)] or [b""]


def _trained(size: int, samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, k=32, d=6).as_bytes()
    except zstandard.ZstdError:  # too few or too short: the samples themselves are a dictionary as well
        return b"".join(dict.fromkeys(samples))[:size]


def _words(text: str) -> list[bytes]:
    return [w for x in text.encode("utf-8", "replace").lower().split() if (w := x.strip(EDGES))]


def _forms(word: bytes) -> list[bytes]:
    """The word and its beginnings, longest first: endings vary more than stems."""
    return [word, *(word[:k] for k in range(min(STEM[1], len(word) - 1), STEM[0] - 1, -1))]


def _frequencies(texts: list[str]) -> Counter:
    found: Counter = Counter()
    for t in texts:
        found.update({form for word in set(_words(t)) for form in _forms(word)})
    return found


def toxic_pieces(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Every occurrence in toxic samples of a word, or of its beginning, that sets them apart."""
    here, there = _frequencies(toxic), _frequencies(ordinary)
    least = max(CONTEXTS, math.ceil(CONTEXT_SHARE * len(toxic)))
    rate = TIMES * len(toxic) / max(1, len(ordinary))
    apart = {w for w, n in here.items() if n >= least and len(w) >= 3 and n > rate * (there.get(w, 0) + 1)}
    contexts: dict[bytes, set] = defaultdict(set)
    found = []
    for t in toxic:
        before = b""
        for word in _words(t):
            if form := next((f for f in _forms(word) if f in apart), None):
                contexts[form].add(before)
                found.append(form)
            before = word
    return [b" " + form for form in found if len(contexts[form]) >= least]  # not what merely stands in copies of one text


@dataclass
class Coders:
    ordinary: bytes
    both: bytes

    def __post_init__(self) -> None:
        how = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        self.coders = []
        for content in (self.ordinary, self.both):
            if len(content) >= 8:
                known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                known.precompute_compress(level=LEVEL)
                self.coders.append(zstandard.ZstdCompressor(dict_data=known, compression_params=how))
            else:
                self.coders.append(zstandard.ZstdCompressor(compression_params=how))

    def features(self, text: str | None) -> list[float]:
        """From the bytes saved in each window of the whole text."""
        plain, toxic = (c.compress for c in self.coders)
        saved = np.array([len(plain(w)) - len(toxic(w)) for w in windows(text)], dtype=np.float64)
        most = -np.sort(-saved)[:8]
        return [most[0], most[:2].mean(), most[:4].mean(), most.mean(), *(math.log1p((saved >= k).sum()) for k in (2, 3, 4, 5, 7)), *((saved >= k).mean() for k in (2, 3, 4)), saved.mean(), math.log1p(len(saved))]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.c_[np.ones(len(x)), (x - mean) / scale]
    w, penalty = np.zeros(a.shape[1]), ridge * np.eye(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w += np.linalg.solve((a.T * (weight * p * (1 - p) + 1e-9)) @ a + penalty, a.T @ (weight * (y - p)) - ridge * w)
    return mean, scale, w


@dataclass
class Model:
    """What ``score`` needs; some 40 KB. Without dictionaries every text gets ``prior``."""

    ordinary: bytes = b""
    both: bytes = b""
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    prior: float = 0.5

    def of(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None or not texts:
            return np.full(len(texts), self.prior)
        coders = Coders(self.ordinary, self.both)
        x = np.array([coders.features(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(x)), (x - self.mean) / self.scale] @ self.weights, -30, 30)))


def fit_texts(toxic: list[str], ordinary: list[str], share: float | None = None) -> Model:
    """Three of five samples train the dictionaries, the others calibrate, weighed for ``share``
    of all texts to be toxic (if null, as among the samples). Fewer than 5 samples of a class: every text gets that share."""
    share = (len(toxic) + 0.5) / (len(toxic) + len(ordinary) + 1) if share is None else share
    if min(len(toxic), len(ordinary)) < 5:
        return Model(prior=share)
    train = [[t for i, t in enumerate(ts) if i % 5 < 3] for ts in (toxic, ordinary)]
    rest = [[t for i, t in enumerate(ts) if i % 5 >= 3] for ts in (toxic, ordinary)]
    pieces = toxic_pieces(*train)
    plain = _trained(ORDINARY_BYTES, [w for t in train[1] for w in windows(t)])
    # the ordinary part last in both, so that distances to it, and their costs, are the same
    model = Model(plain, (_trained(TOXIC_BYTES, pieces) if pieces else b"") + plain, prior=share)
    coders = Coders(model.ordinary, model.both)
    x = np.array([coders.features(t) for ts in rest for t in ts])
    y = np.array([1.0] * len(rest[0]) + [0.0] * len(rest[1]))
    real = len(rest[0]) / len(y)
    model.mean, model.scale, model.weights = _logistic(x, y, np.where(y == 1, share / real, (1 - share) / (1 - real)))
    return model


def held_out(doc_id: str | Column) -> Column:
    """The fifth of the rows that no label is learnt from."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, longest: int = SAMPLE_CHARS) -> Model:
    """A model from labelled documents (doc_id, text) outside the held-out fifth.

    Of each class the ``sample`` ids with the smallest hashes are taken; this
    bounds what comes to the driver, as does ``longest``: longer texts teach nothing, though all are scored. Rows with null ids, labels or texts teach nothing either.
    """
    known = labels.where(F.col(label).isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max(label).alias("__label"))
    n, toxic = known.agg(F.count(F.lit(1)), F.count_if(F.col("__label") == 1)).first()
    pick = [known.where(F.col("__label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (1, 0)]
    few = pick[0].unionByName(pick[1]).withColumnRenamed("doc_id", "__id")
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(few), F.col("doc_id") == F.col("__id"))
        .where(F.length("text") <= longest)
        .select("__label", "text", F.xxhash64("doc_id").alias("at"))
        .orderBy("at", "text")
        .limit(2 * sample)
        .collect()
    )
    return fit_texts([r.text for r in rows if r["__label"] == 1], [r.text for r in rows if r["__label"] == 0], (toxic + 0.5) / (n + 1))


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds ``out`` double, 0 to 1, from the whole text alone. A null text counts as empty.

    All other columns stay, but for one named ``out``. There is no shuffle. Rows with a null id, and rows that come again, are scored like any other.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(shared.value.of(texts.to_pylist()), pa.float64())

    return df.withColumn(out, probability(F.col(text)))


def query(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    got = score(docs.select("doc_id", "text"), fit(docs, labels))
    return got.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
