"""Toxicity by compression distance.

Two zstandard dictionaries are trained on a bounded sample of labelled texts: one on ordinary text,
one on the parts of toxic text that ordinary text lacks (words whose opening letters are
over-represented beyond chance). Every 80-byte window of a text, overlapping by 24 bytes, is compressed with
the ordinary dictionary and with the ordinary and toxic ones joined; the bytes that the toxic part
saves are the distance. A logistic curve, fitted on the half of the sample that trained no
dictionary, turns a document's distances into a score. The sample takes other shares of the two classes
than the labels have; the curve's intercept is set back by the log of the two rates.

Defined results: null and empty texts have no window that the toxic part shortens and get the score
of such a text; without labels of both kinds every score is the smoothed share of toxic labels;
several labels of one doc_id count as toxic if one of them is; long texts are compressed window by window,
whole; a score of exactly 0.5 is predicted toxic; repeated rows are scored each; other columns, of any name,
are not read; an empty table gives no rows.

The plain method, two dictionaries of whole windows, did not tell the classes apart well enough here (README
has the figures), so the toxic dictionary lists word openings that a count of the labelled texts contrasts.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, lower_bytes, map_batches, mix64, read_table, shingle_hashes, word_hashes

WINDOW, STEP = 80, 56
DICTIONARY = 16 * 1024
TOXIC_DICTIONARY = 4 * 1024
#: The classifier is fitted on a sample of labelled texts of about so many bytes in each class.
SAMPLE_BYTES = 12_000_000
ROW_BYTES = 64
STEMS = range(4, 13)
_WORD = re.compile(r"\S+")


def windows(text: str | None) -> list[bytes]:
    data = (text or "").lower().encode("utf-8", "surrogatepass")
    return [data[i : i + WINDOW] for i in range(0, max(1, len(data) - WINDOW + STEP), STEP)]


def one_of_each_family(texts: list[str]) -> list[str]:
    """Texts without near copies of earlier ones (any of four min-hashes seen), which would make chance words look common."""
    seen: set[tuple[int, int]] = set()
    out = []
    for text in texts:
        shingles = shingle_hashes(word_hashes(lower_bytes(text)), 5)
        if len(shingles):
            marks = {(i, int(mix64(shingles ^ np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64))).min())) for i in range(4)}
            if marks & seen:
                continue
            seen |= marks
        out.append(text)
    return out


def _stem_counts(texts: list[str]) -> Counter:
    out: Counter = Counter()
    for text in texts:
        out.update({w[:n] for w in set(_WORD.findall(text.lower())) for n in STEMS if len(w) >= n})
    return out


def contrasting_stems(toxic: list[str], ordinary: list[str], least_z: float = 8.0) -> list[str]:
    """Openings of words in more toxic texts than chance explains, as long as they stay as common."""
    toxic, ordinary = one_of_each_family(toxic), one_of_each_family(ordinary)
    a, b = _stem_counts(toxic), _stem_counts(ordinary)
    n, m = len(toxic), len(ordinary)

    def over(stem: str, count: int) -> bool:
        expected = n * (b[stem] + 1) / (m + 1)
        return count >= max(4, 0.015 * n) and count > 8 * expected and (count - expected) / np.sqrt(expected + 0.25) >= least_z

    kept = {s for s, c in a.items() if over(s, c)}
    shortest = {s for s in kept if not any(s[:k] in kept for k in range(STEMS.start, len(s)))}
    out = []
    for stem in shortest:
        longer = [s for s in kept if s.startswith(stem) and a[s] >= 0.8 * a[stem]]
        out.append(max(longer, key=lambda s: (len(s), s)))
    return sorted(out, key=lambda s: (a[s], s))


def _train(size: int, samples: list[bytes]) -> bytes:
    """The content that zstandard's trainer selects; what there is of it where that is too little to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=64, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _last(content: bytes, size: int) -> bytes:
    """The last bytes of a content, none where there is no room."""
    return content[max(0, len(content) - size) :] if size > 0 else b""


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def compressors(self):
        made = []
        for content in (self.ordinary, self.ordinary + self.toxic):
            if len(content) < 8:
                content = content.ljust(8, b" ")
            params = zstandard.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=15, search_log=5, min_match=4, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False)
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(compression_params=params)
            made.append(zstandard.ZstdCompressor(dict_data=data, compression_params=params))
        return made

    def scorer(self):
        plain, both = self.compressors()

        def score(text: str | None) -> tuple[float, list[float]]:
            x = features(text, plain, both)
            z = float(((x - self.mean) / self.scale) @ self.weights[1:] + self.weights[0])
            return 1 / (1 + np.exp(-np.clip(z, -30, 30))), x.tolist()

        return score


def features(text: str | None, plain, both) -> np.ndarray:
    w = windows(text)
    saved = np.sort(np.array([len(plain.compress(x)) - len(both.compress(x)) for x in w], float))[::-1]
    hits = int((saved >= 2).sum())
    return np.array([min(saved[0], 8), min(float(saved[:3].mean()), 8), np.log1p(hits), np.log1p(hits) - np.log1p(len(w))])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(x.shape[1])
    keep[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(toxic: list[str], ordinary: list[str], rates: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Dictionaries from every other text, the curve from the rest; rates: the shares of the labelled toxic and ordinary texts that the sample took."""
    n = 4
    if not toxic or not ordinary:
        a, b = len(toxic) / rates[0], len(ordinary) / rates[1]
        share = (a + 0.5) / (a + b + 1)
        return Model(b"", b"", np.array([np.log(share / (1 - share)), *[0.0] * n]), np.zeros(n), np.ones(n))
    ta, tb = toxic[::2], toxic[1::2] or toxic
    oa, ob = ordinary[::2], ordinary[1::2] or ordinary
    stems = contrasting_stems(ta, oa)
    opening = tuple(stems)
    samples = [b" ".join(x) for t in ta if (x := [s.encode() for w in _WORD.findall(t.lower()) if w.startswith(opening) for s in stems if w.startswith(s)])] if opening else []
    listed = b" " + b" ".join(s.encode() for s in stems) + b" "
    model = Model(_train(DICTIONARY, [w for t in oa for w in windows(t)]), _last(_train(TOXIC_DICTIONARY, samples), TOXIC_DICTIONARY - len(listed)) + listed, np.zeros(n + 1), np.zeros(n), np.ones(n))
    plain, both = model.compressors()
    x = np.array([features(t, plain, both) for t in [*tb, *ob]])
    y = np.array([1.0] * len(tb) + [0.0] * len(ob))
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    model.weights = _logistic((x - model.mean) / model.scale, y)
    # the odds of the sample are those of the labels times the ratio of the rates
    model.weights[0] -= np.log(rates[0] / rates[1])
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> tuple[list[str], list[str], tuple[float, float]]:
    """Toxic and ordinary texts of rows outside the held-out fold, about sample_bytes of each at most, picked by hash, and the rates of the picks."""
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter(~held_out(5, 0))
    # every text counts some bytes more, which bounds the number of ids as well
    known = docs.select("doc_id", (F.octet_length("text") + ROW_BYTES).alias("n")).join(marks, "doc_id")
    sums = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.sum("n").alias("n")).collect()}
    wide = 1 << 60  # so that the rate is above 0 and the sample within its bound at any size
    rank = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(wide))
    limits = {toxic: wide if n <= sample_bytes else max(1, wide * sample_bytes // n) for toxic, n in sums.items()}
    most = F.lit(0).cast("long")
    for toxic, limit in limits.items():
        most = F.when(F.col("toxic") == toxic, F.lit(limit)).otherwise(most)
    # at most about sample_bytes / ROW_BYTES ids a class, so texts never move for the others
    picked = known.filter(rank < most).select("doc_id", "toxic").distinct()
    rows = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "text").collect()  # bounded by sample_bytes
    rows.sort(key=lambda r: (r.doc_id, r.text))
    rates = tuple(limits.get(toxic, wide) / wide for toxic in (1, 0))
    return [r.text for r in rows if r.toxic == 1], [r.text for r in rows if r.toxic == 0], rates


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, saved (largest distance), hits (windows the toxic part shortens)."""
    frozen = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # two dictionaries of bounded size

    def make():
        score = pickle.loads(frozen.value).scorer()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [score(t) for t in batch.column("text").to_pylist()]
            scores = [float(s) for s, _ in rows]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array([x[0] for _, x in rows]), pa.array([round(np.expm1(x[2])) for _, x in rows], pa.int32())], ["doc_id", "held_out", "score", "predicted", "saved", "hits"])

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(5, 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, f"doc_id {kind}, held_out boolean, score double, predicted int, saved double, hits int", make)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(*labelled_sample(docs, read_table(spark, sf_dir, "labels"))))
