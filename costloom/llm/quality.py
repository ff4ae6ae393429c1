"""Quality by compression: zstandard dictionaries of good and bad text, a calibrated size difference.

Each block of a text is compressed with a dictionary trained on good text and with one trained on bad
text (pairs of several sizes: small ones hold what is typical, large ones what is frequent). Summed over the whole text, the normalised difference of the two sizes says which kind it
resembles; a logistic curve, fitted on labelled rows the dictionaries haven't seen, turns it into a
probability. Beside the difference the curve sees the size under the good dictionary and the length, without which
empty repetition looks like prose (that they decide too is an addition to the method). Fitting uses a bounded sample on the driver; scoring is one pass without a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costloom.llm.common import emit, sliced, whole_text

#: The fit reads at most this many labelled rows for each label and fold, none of over SAMPLE_CHARS characters, together
#: of at most SAMPLE_TEXT characters.
SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_TEXT = 1200, 60_000, 8_000_000
DICTIONARY_BYTES, BLOCK_BYTES, LEVEL = (8 << 10, 32 << 10), 1024, 1


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3: 1 is held out, 0 trains dictionaries, 2 fits the curve."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


@dataclass
class Model:
    """pairs: (good, bad) dictionaries, each with whether it is raw text; mean, scale, weights: the curve."""

    pairs: list[tuple[tuple[bytes, bool], tuple[bytes, bool]]]
    mean: list[float]
    scale: list[float]
    weights: list[float]


class Scorer:
    """A model made ready on one worker."""

    def __init__(self, model: Model):
        self.packers = [_packer(*x) for pair in model.pairs for x in pair]
        self.mean, self.scale, self.weights = (np.array(x) for x in (model.mean, model.scale, model.weights))

    def features(self, text: str) -> list[float]:
        data = text.encode()
        sizes = [0] * len(self.packers)
        for i in range(0, len(data), BLOCK_BYTES):
            part = data[i : i + BLOCK_BYTES]
            for k, packer in enumerate(self.packers):
                sizes[k] += len(packer.compress(part))
        length = math.log1p(len(data))
        out = [length]
        for good, bad in zip(sizes[::2], sizes[1::2], strict=True):
            difference = (bad - good) / max(1, good + bad)
            # How far the good dictionary shrinks the text tells empty repetition from prose.
            ratio = good / max(1, len(data))
            out += [difference, difference * abs(difference), difference * length, ratio, ratio * ratio, ratio * length]
        return out

    def score(self, text: str) -> float:
        x = (np.array(self.features(text)) - self.mean) / self.scale
        z = float(self.weights[0] + x @ self.weights[1:])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _packer(content: bytes, raw: bool) -> zstandard.ZstdCompressor:
    found = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_AUTO)
    found.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=found, write_content_size=False, write_checksum=False, write_dict_id=False)


def _dictionary(texts: list[str], size: int) -> tuple[bytes, bool]:
    blocks = [b[i : i + 2048] for b in (t.encode() for t in texts) for i in range(0, len(b), 2048)]
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes(), False
    except zstandard.ZstdError:  # too few samples to train: the texts themselves serve as dictionary
        return b"".join(blocks)[-size:] or b" " * 8, True


def fit_texts(train: list[tuple[str, int]], curve: list[tuple[str, int]], share: float = 0.5) -> Model:
    """train, curve: (text, label) for the dictionaries and for the logistic curve; share of label 1 overall."""
    by = {k: [t for t, label in train if label == k] for k in (1, 0)}
    pairs = [(_dictionary(by[1], size), _dictionary(by[0], size)) for size in DICTIONARY_BYTES]
    n = 1 + 6 * len(pairs)
    blank = Model(pairs, [0.0] * n, [1.0] * n, [0.0] * (n + 1))
    y = np.array([label for _, label in curve], float)
    if not by[1] or not by[0] or len(set(y)) < 2:
        return blank
    scorer = Scorer(blank)
    x = np.array([scorer.features(t) for t, _ in curve])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    a = np.c_[np.ones(len(x)), (x - mean) / scale]
    w, ridge = np.zeros(a.shape[1]), np.array([1e-6] + [1e-1] * n)
    # The sample is balanced; each label counts as it does among all labelled rows.
    each = np.where(y == 1, share, 1 - share) / np.where(y == 1, y.mean(), 1 - y.mean())

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float((each * (np.logaddexp(0, z) - y * z)).sum() + (ridge * w * w).sum() / 2)

    for _ in range(100):  # Newton's steps of a ridge-penalised logistic regression, halved until they help
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (each * p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(ridge), a.T @ (each * (y - p)) - ridge * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if abs(size * step).max() < 1e-8 or size <= 1e-6:
            break
    return Model(pairs, mean.tolist(), scale.tolist(), w.tolist())


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on labelled documents that aren't held out; the sample's bound is sample_rows a label and fold.

    Rows are taken in order of a hash of doc_id. Labels other than 0 and 1, null ids and labels without a
    document are passed over. With one label missing every text scores 0.5.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"), fold(F.col("doc_id")).alias("fold")).distinct()
    parts = [known.filter((F.col("quality") == q) & (F.col("fold") == k)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for q in (0, 1) for k in (0, 2)]
    sample = parts[0]
    for part in parts[1:]:
        sample = sample.unionAll(part)
    # Bounded by sample_rows, so the broadcast is as well.
    texts = docs.select("doc_id", whole_text().alias("text")).filter(F.length("text") <= SAMPLE_CHARS)
    met = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "fold", "quality", "text")
    so_far = Window.partitionBy("fold", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)
    found = met.withColumn("chars", F.sum(F.length("text")).over(so_far)).filter(F.col("chars") <= SAMPLE_TEXT).drop("chars").toArrow().to_pylist()
    found.sort(key=lambda r: (r["doc_id"], r["quality"], r["text"]))
    share = known.filter("fold <> 1").agg(F.avg("quality")).first()[0]
    return fit_texts(*([(r["text"], r["quality"]) for r in found if r["fold"] == k] for k in (0, 2)), 0.5 if share is None else share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 where score >= 0.5).

    Scores depend on the text alone, whole and in blocks; null is the empty text, which scores what the
    curve gives for it. Repeated rows score each, equal texts score the same, an empty table gives no rows,
    extra columns are ignored.
    """

    def run(batches):
        scorer = Scorer(model)
        rows = emit(pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())]))
        for batch in sliced(batches):
            for r in batch.to_pylist():
                s = scorer.score(r["text"])
                yield from rows.add({"doc_id": r["doc_id"], "held_out": r["held_out"], "score": s, "predicted": int(s >= 0.5)})
        yield from rows.rest()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 1).alias("held_out"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def good_only(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those the classifier rejects, with all columns as they were.

    Each row stands or falls by the score of its own text, whatever its doc_id; a null text is the empty text.
    Repeated rows stand or fall together, other columns are carried along, no rows give no rows.
    """
    model = fit(docs, labels)

    def run(batches):
        scorer = Scorer(model)
        for batch in sliced(batches):
            yield batch.filter(pa.array([scorer.score(t or "") >= 0.5 for t in batch["text"].to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, fit(docs, labels))
