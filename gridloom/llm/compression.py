"""Quality classifier by compression.

Two zstandard dictionaries are built from pieces of good and bad labelled text.
A text closer to one class compresses better with that class's dictionary, so
the difference of the two compressed sizes per byte is a quality signal; logistic
regression on labelled texts that built no dictionary calibrates it to a
probability.  Sizes are taken over the whole text at once and over consecutive
blocks: blocks keep repetition inside a text from hiding which dictionary fits.
"""

import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import fit_logistic, held_out, logistic, training_ids

BLOCK = 512
LEVEL = 3


@functools.lru_cache(maxsize=4)
def _compressor(dictionary):
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False)


def features(text, good, bad):
    """Size differences per byte (bad minus good), whole and in blocks, and the share of bytes left."""
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return 0.0, 0.0, 0.0, 0.0, 0.0
    g, b = _compressor(good), _compressor(bad)
    whole_g, whole_b = len(g.compress(raw)), len(b.compress(raw))
    cut = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
    cut_g, cut_b = sum(len(g.compress(x)) for x in cut), sum(len(b.compress(x)) for x in cut)
    n = len(raw)
    return (whole_b - whole_g) / n, (cut_b - cut_g) / n, (cut_b - cut_g) / (cut_b + cut_g), whole_g / n, 1 / (1 + n / 100)


@dataclass
class CompressionModel:
    """Dictionaries and calibration; without dictionaries every score is ``base``."""

    good: bytes = b""
    bad: bytes = b""
    weights: tuple = ()
    base: float = 0.5

    def score(self, column):
        """Probability column of good quality for a text column."""
        good, bad, w, base = self.good, self.bad, np.array(self.weights), self.base

        @F.pandas_udf("double")
        def scores(texts: pd.Series) -> pd.Series:
            if not len(w):
                return pd.Series(np.full(len(texts), base))
            return pd.Series(logistic([features(t, good, bad) for t in texts], w))

        return scores(F.coalesce(column, F.lit("")))


def _pieces(sample, per_doc):
    """Evenly spaced blocks of each sampled text, at most ``per_doc``: (label, piece)."""
    def cut(batches):
        for b in batches:
            out = []
            for label, text in zip(b.label, b.text):
                raw = (text or "").encode("utf-8", "replace")
                starts = range(0, len(raw), BLOCK)
                for i in starts[:: max(1, -(-len(starts) // per_doc))]:
                    out.append((label, raw[i : i + BLOCK]))
            yield pd.DataFrame(out, columns=["label", "piece"])

    return sample.select("label", "text").mapInPandas(cut, "label int, piece binary")


def _train(pieces, size):
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text for a trained dictionary: plain content serves as one
        return b"".join(pieces)[-size:].ljust(8, b" ")


def fit(docs: DataFrame, labels: DataFrame, dictionary_docs=2500, calibration_docs=4000, pieces_per_doc=6, dictionary_bytes=112640) -> CompressionModel:
    """Fit on a bounded sample of labelled rows outside the held-out fold (crc32(doc_id) mod 5 = 0).

    Bounds: ``dictionary_docs`` documents of each class give at most
    ``pieces_per_doc`` blocks each to the dictionaries; ``calibration_docs``
    other documents, whole texts, calibrate.  A class without rows: every score
    is the share of good rows (0.5 without labels).
    """
    built = training_ids(labels, "quality", 5, 0, dictionary_docs, per_class=True)
    ids = F.broadcast(built.where(F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)) != 0))
    text = docs.select("doc_id", "text")
    rows = _pieces(text.join(ids, "doc_id"), pieces_per_doc).collect()
    good, bad = ([bytes(r.piece) for r in rows if r.label == k] for k in (1, 0))
    rest = training_ids(labels, "quality", 5, 0, calibration_docs).where(F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)) == 0)
    if not good or not bad:
        share = labels.where(F.col("quality").isNotNull()).where(~held_out("doc_id", 5, 0)).agg(F.avg("quality")).first()[0]
        return CompressionModel(base=0.5 if share is None else float(share))
    g, b = _train(sorted(good), dictionary_bytes), _train(sorted(bad), dictionary_bytes)

    @F.pandas_udf("array<double>")
    def measure(texts: pd.Series) -> pd.Series:
        return pd.Series([list(features(t, g, b)) for t in texts])

    cal = text.join(F.broadcast(rest), "doc_id").select("doc_id", "label", measure(F.coalesce("text", F.lit(""))).alias("x")).collect()
    cal.sort(key=lambda r: (r.doc_id, r.x))
    y = [r.label for r in cal]
    if len(set(y)) < 2:
        y, x = [1, 0], [features(good[0].decode("utf-8", "replace"), g, b), features(bad[0].decode("utf-8", "replace"), g, b)]
    else:
        x = [r.x for r in cal]
    return CompressionModel(g, b, tuple(fit_logistic(x, y)))


def quality(docs: DataFrame, labels: DataFrame, threshold=0.3, **bounds) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Nulls and empty texts get a score as any other text; repeated rows get equal
    scores; an empty table gives an empty result.
    """
    model = fit(docs, labels, **bounds)
    return docs.select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), model.score(F.col("text")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold=0.3, **bounds) -> DataFrame:
    """The documents with a score of at least ``threshold``, with all their columns."""
    return docs.where(fit(docs, labels, **bounds).score(F.col("text")) >= threshold)
