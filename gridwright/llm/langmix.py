"""Language identification as mixture inference.

Hashed letter trigrams give each language a distribution. For every document, expectation
maximisation estimates the share of each language from the trigram likelihoods; languages leave the
set as long as the penalised likelihood does not fall. The prediction is the language with the
largest share.

Defined results: a text that is null or has no letter is ``und`` with score 0 and no shares, and so
is every text where nothing could be learned; ties go to the first language in code-point order;
rows without lang or doc_id teach nothing and are only predicted; every lang value is learned; long
texts count whole, in memory of the buckets; repeated rows count and are predicted each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, map_batches, read_table

#: Buckets of the trigram hash, the same however many languages there are: a model has 256 KB a language.
BUCKETS = 1 << 16
#: Texts are picked for the sample by hashes below a share of this: rates far below one in 10^12 are still above 0.
PICKS = 1 << 60
#: The trigram model is fitted on about so many documents of each language, picked by hash.
SAMPLE_DOCS = 1500
#: Penalty for each language of the set beyond the first, times log(number of trigrams).
PENALTY = 4.0
ROUNDS = 25
SCHEMA = "held_out boolean, lang_pred string, score double, shares array<struct<lang:string,share:double>>"


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def pick_limit(sample: int, n: int) -> int:
    """Hashes below this number of PICKS give about `sample` of n rows; at least one hash does."""
    return PICKS if n <= sample else max(1, PICKS * sample // n)


def trigram_counts(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the letter trigrams of a text, words padded with one space."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = (code >= 128) | ((code >= 97) & (code <= 122))
    code = np.where(letter, code, 32)
    code = code[letter | np.append(True, letter[:-1])]  # one space for any run of other characters
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(0)
    with np.errstate(over="ignore"):
        h = (code[:-2] * np.uint32(0x9E3779B1) ^ code[1:-1] * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35) + code[2:] * np.uint32(0x27D4EB2F)
        h = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    h = (h >> np.uint32(16))[code[1:-1] != 32] & np.uint32(buckets - 1)
    if len(h) > buckets:
        n = np.bincount(h, minlength=buckets)
        kinds = np.flatnonzero(n)
        return kinds, n[kinds].astype(float)
    kinds, n = np.unique(h, return_counts=True)
    return kinds.astype(np.int64), n.astype(float)


def expectation_maximisation(p: np.ndarray, n: np.ndarray, start: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Shares that maximise sum(n log(shares @ p)), and that value."""
    share, total = start / start.sum(), n.sum()
    mixed = share @ p
    for _ in range(rounds):
        new = share * (p @ (n / mixed)) / total
        done = np.abs(new - share).max() < 1e-4
        share, mixed = new, new @ p
        if done:
            break
    return share, float(n @ np.log(mixed))


def infer_mixture(p: np.ndarray, n: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Shares by language, 0 outside the set with the best penalised likelihood.

    The full set's likelihood bounds every other's, so one language that comes within one penalty
    of it is the answer at once; else languages leave in order of their shares."""
    each = np.log(p) @ n
    cost = penalty * np.log(n.sum() + 1)
    best = int(each.argmax())
    share, value = expectation_maximisation(p, n, np.ones(len(p)))
    out = np.zeros(len(p))
    if value - each[best] <= cost:
        out[best] = 1.0
        return out
    keep = np.arange(len(p))
    while len(keep) > 1:
        less = np.delete(np.arange(len(keep)), share.argmin())
        if len(less) == 1:
            s, v = np.ones(1), float(each[keep[less[0]]])
        else:
            s, v = expectation_maximisation(p[keep[less]], n, share[less] + 1e-6)
        if v + cost < value:
            break
        keep, share, value = keep[less], s, v
    out[keep] = share
    return out


class LanguageModel:
    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        share = counts.sum(0) + 1.0
        share /= share.sum()
        counts = counts + 200 * share  # smoothed towards all languages together
        self.p = (counts / counts.sum(1, keepdims=True)).astype(np.float32)

    def predict(self, text: str | None) -> tuple[str, float, list[dict]]:
        if not self.languages or not has_letter(text):
            return "und", 0.0, []
        kinds, n = trigram_counts(text, self.p.shape[1])
        if not len(kinds):
            kinds, n = np.zeros(1, np.int64), np.ones(1)
        p = self.p[:, kinds].astype(float)
        shares = infer_mixture(p, n)
        best = int(shares.argmax())
        listed = [{"lang": self.languages[i], "share": float(shares[i])} for i in np.argsort(-shares, kind="stable") if shares[i] > 0]
        # how much of the text the language explains: its share when all languages compete
        score = float(expectation_maximisation(p, n, np.ones(len(p)), 8)[0][best]) if len(listed) == 1 and len(p) > 1 else float(shares[best])
        return self.languages[best], min(1.0, max(0.0, score)), listed


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> LanguageModel:
    """Trigram counts by language from rows outside the held-out fold; counting runs on the executors."""
    known = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.filter("doc_id is not null and text is not null and lang is not null").filter(~held_out(3, 1))
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((0, BUCKETS)))
    number = {lang: i for i, lang in enumerate(languages)}
    most = F.lit(0).cast("long")
    for lang, n in sizes.items():
        most = F.when(F.col("lang") == lang, F.lit(pick_limit(sample_docs, n)).cast("long")).otherwise(most)
    sample = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(PICKS)) < most).select("lang", "text")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sums: dict[str, np.ndarray] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                kinds, n = trigram_counts(text)
                sums.setdefault(lang, np.zeros(BUCKETS))[kinds] += n
            names, kinds, counts = [], [], []
            for lang, total in sums.items():
                at = np.flatnonzero(total)
                names.append(np.full(len(at), number[lang]))
                kinds.append(at)
                counts.append(total[at])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in ((names, pa.int32()), (kinds, pa.int32()), (counts, pa.float64()))], ["lang", "bucket", "n"])

        return each

    rows = map_batches(sample, "lang int, bucket int, n double", make).groupBy("lang", "bucket").agg(F.sum("n").cast("float").alias("n")).toArrow()  # 12 bytes a bucket that a language uses
    counts = np.zeros((len(languages), BUCKETS))
    counts[rows["lang"].to_numpy(), rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return LanguageModel(languages, counts)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The columns of docs and SCHEMA's; columns of docs with those names are replaced."""
    made = [x.split()[0] for x in SCHEMA.split(", ")]
    keep = [c for c in docs.columns if c.lower() not in made]
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    send = docs.sparkSession.sparkContext.broadcast((model.languages, model.p))  # 256 KB a language
    shares_type = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def make():
        local = LanguageModel.__new__(LanguageModel)
        local.languages, local.p = send.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [local.predict(t) for t in batch.column("text").to_pylist()]
            columns = [batch.column("held_out"), pa.array([x[0] for x in found]), pa.array([x[1] for x in found]), pa.array([x[2] for x in found], shares_type)]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], [*keep, *made])

        return each

    rows = docs.select(*keep).withColumn("held_out", held_out(3, 1))
    return map_batches(rows, kinds + SCHEMA, make)


def keep_identified(docs: DataFrame, model: LanguageModel, least_share: float = 0.5) -> DataFrame:
    """Documents of one main language, as they are; those without a language go."""
    made = [x.split()[0] for x in SCHEMA.split(", ")]
    own = {c: f"_gw_own_{c}" for c in docs.columns if c.lower() in made}
    kept = identify(docs.withColumnsRenamed(own), model).filter((F.col("lang_pred") != "und") & (F.col("shares")[0]["share"] >= least_share))
    return kept.drop(*made).withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def op5_langmix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs.select("doc_id", F.col("text").cast("string").alias("text")), fit(docs)).drop("text")
