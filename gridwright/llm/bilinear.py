"""Language-model scores of texts: a log-bilinear model trained with noise-contrastive estimation.

Words of all training texts are counted. The most frequent ones are outcomes of their own; every other word
belongs to a class (its first two characters and its ending), and a class is an outcome. The context,
four words back, gives a predicted vector: the sum of their vectors, each weighted by position. A
token's log-probability is the softmax over all outcomes of the products with the predicted vector,
plus the word's add-one share of its class, so all words of a vocabulary and one unseen word a class
have probabilities that sum to one.

Training is noise-contrastive estimation in numpy: a start on a bounded sample, then one pass over every
training text, in which each task goes on from the start and the results are averaged by tokens.

Frequent words (a bounded number, found by a histogram of counts) are known to every task; the
others of a text are joined to the counts by a shuffle. So counts, the base and the share of a class are
exact for every word, however large the vocabulary.

Defined results: null and empty texts, and texts of white space, have the end token alone; rows without doc_id are training
rows (crc32 of null is no remainder) and keep their null id; repeated rows count and are scored each; long texts whole, a
word of any length too; without training rows every base is 0; other columns, of any name, are not
read; an empty table gives no rows. The end token counts as known if there is a training row.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, held_out, map_batches, materialise, read_table

#: Outcomes: frequent words (the end is one) and classes of the others (one takes what is left).
WORDS, CLASSES = 128, 256
DIMENSIONS, CONTEXT = 16, 4
#: Outcomes drawn for a step; tokens of a step in the start and in the pass; tokens scored at once.
NOISE, START_STEP, PASS_STEP, SCORED = 32, 512, 2048, 512
#: The start is trained on about so many tokens, picked by hash, this number of times.
START_TOKENS, START_ROUNDS = 400_000, 4
#: Words that every task knows: at most so many, none longer than so many bytes.
KNOWN_WORDS, KNOWN_BYTES = 1 << 18, 64
#: Words and bytes of words that a counting task holds before it passes them on.
HELD_WORDS, HELD_BYTES = 400_000, 32 << 20
END = b""


def words_of(text: str | None) -> list[bytes]:
    """Words cut at ASCII white space, A-Z lower-cased, and the end."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    found.append(END)
    return found


def class_key(word: bytes) -> str:
    """First two characters and, unless it is a letter, the last one."""
    text = word.decode("utf-8", "replace")
    last = text[-1:]
    return text[:2] + "\0" + ("" if "a" <= last <= "z" or last >= "\x80" else last)


def count_words(docs: DataFrame) -> DataFrame:
    """word, key, n over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        size = 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            every = list(held)
            for at in range(0, len(every), 50_000):
                some = every[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()).cast(pa.string()), pa.array(map(held.__getitem__, some), pa.int64())], ["word", "n"])
            held.clear()

        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.update(words_of(text))
                size += len(text or "")
            if len(held) > HELD_WORDS or size > HELD_BYTES and sum(map(len, held)) > HELD_BYTES:
                yield from passed_on()
                size = 0
        yield from passed_on()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [class_key(w) for w in batch.column("word").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(keys), batch.column("n")], ["word", "key", "n"])

    bounded_batches(docs.sparkSession)
    counts = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.mapInArrow(keyed, "word string, key string, n long")


@dataclass
class Vocabulary:
    """What every task knows: outcomes, class sizes and the frequent words."""

    total: int
    different: int
    words: list[bytes]
    classes: dict[str, int]
    class_totals: np.ndarray
    outcome_counts: np.ndarray
    known: list[bytes]
    known_counts: np.ndarray

    def __post_init__(self) -> None:
        self.place = {w: i for i, w in enumerate(self.known)}
        self.own = {w: i for i, w in enumerate(self.words)}
        self.known_outcome = np.array([self.outcome_of(w) for w in self.known], np.int32)
        #: log10(count + 1) less the class's denominator; 0 for words that are outcomes
        self.known_share = np.where(self.known_outcome < len(self.words), 0.0, np.log10(self.known_counts + 1) - self.class_share()[self.known_outcome]) if len(self.known) else np.zeros(0)
        self.recent: dict[bytes, int] = {}

    def outcome_of(self, word: bytes) -> int:
        own = self.own.get(word)
        return self.classes.get(class_key(word), len(self.outcome_counts) - 1) if own is None else own

    def class_share(self) -> np.ndarray:
        """log10 of N + V + 1 of the classes, by outcome; 0 for words."""
        return np.concatenate([np.zeros(len(self.words)), np.log10(self.class_totals + 1)])

    def outcomes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Outcomes of words and their places among the known ones (-1: not among them)."""
        places = np.fromiter(map(self.place.get, words, repeat(-1)), np.int32, len(words))
        out = self.known_outcome[places] if len(self.known) else np.zeros(len(words), np.int32)
        recent = self.recent
        if len(recent) > 100_000:
            recent.clear()
        for i in np.flatnonzero(places < 0).tolist():
            word = words[i]
            found = recent.get(word)
            if found is None:
                found = self.outcome_of(word)
                if len(word) <= KNOWN_BYTES:
                    recent[word] = found
            out[i] = found
        return out, places


def learn_vocabulary(counts: DataFrame) -> Vocabulary:
    """counts: word, key, n. What comes back is bounded by WORDS, CLASSES, KNOWN_WORDS and KNOWN_BYTES."""
    sums = counts.agg(F.sum("n"), F.count("*")).first()
    short = counts.filter(F.octet_length("word") <= KNOWN_BYTES)
    top = [r.word for r in short.filter("word <> ''").orderBy(F.desc("n"), "word").limit(WORDS - 1).collect()]
    end = counts.filter("word = ''").collect()
    level = F.floor(F.log2("n") * 16)
    sizes = sorted(((r.level, r.words) for r in short.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()), reverse=True)  # some 16 rows a doubling
    least, so_far = None, 0
    for at, number in sizes:
        if so_far + number > KNOWN_WORDS:
            break
        least, so_far = at, so_far + number
    # the outcomes are known in any case
    frequent = F.lit(False) if least is None else level >= least
    known = short.filter(frequent | F.col("word").isin(top)).select("word", "n").collect()
    known = sorted((r.word.encode("utf-8", "surrogatepass"), r.n) for r in known if r.word)
    number = {w: n for w, n in known}
    words = [END, *(w.encode("utf-8", "surrogatepass") for w in top)]
    of_class = counts.filter(~F.col("word").isin(["", *top])).groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("words"))
    largest = of_class.orderBy(F.desc("n"), "key").limit(CLASSES - 1).collect()
    all_others = counts.filter(~F.col("word").isin(["", *top])).agg(F.sum("n"), F.count("*")).first()
    left = [(all_others[i] or 0) - sum(r[i + 1] for r in largest) for i in (0, 1)]
    n_words = [end[0].n if end else 0, *(number[w] for w in words[1:])]
    n_classes = [*(r.n for r in largest), left[0]]
    class_totals = np.array([*(r.n + r.words for r in largest), sum(left)], float)
    known = [(END, n_words[0]), *known] if end else known
    return Vocabulary(sums[0] or 0, sums[1], words, {r.key: len(words) + i for i, r in enumerate(largest)}, class_totals, np.array([*n_words, *n_classes], float), [w for w, _ in known], np.array([n for _, n in known], np.int64))


# --- the model -----------------------------------------------------------------------------------


@dataclass
class Model:
    """Vectors of context words (the last row stands before a text), position weights, outcome vectors, biases."""

    context: np.ndarray
    positions: np.ndarray
    outcome: np.ndarray
    bias: np.ndarray
    noise: np.ndarray

    @classmethod
    def start(cls, outcome_counts: np.ndarray, dimensions: int = DIMENSIONS, context: int = CONTEXT) -> Model:
        """Small vectors and the shares of the outcomes as biases: the model of single outcomes."""
        r, k = np.random.default_rng(11), len(outcome_counts)
        share = (outcome_counts + 1) / (outcome_counts + 1).sum()
        small = lambda *s: (r.standard_normal(s) * 0.1).astype(np.float32)
        return cls(small(k + 1, dimensions), np.ones((context, dimensions), np.float32), small(k, dimensions), np.log(share).astype(np.float32), share)

    def parameters(self) -> list[np.ndarray]:
        return [self.context, self.positions, self.outcome, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parameters()])

    def with_flat(self, values: np.ndarray) -> Model:
        made, at = [], 0
        for p in self.parameters():
            made.append(values[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Model(*made, self.noise)

    def contexts(self, outcomes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The outcomes before each token of texts laid end to end, nearest first."""
        c, before = len(self.positions), len(self.outcome)
        place = np.arange(len(outcomes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        back = np.arange(1, c + 1)
        at = np.arange(len(outcomes))[:, None] - back
        return np.where(place[:, None] >= back, outcomes[np.maximum(at, 0)], before)

    def predicted(self, contexts: np.ndarray) -> np.ndarray:
        return np.einsum("bcd,cd->bd", self.context.take(contexts, 0), self.positions)

    def log10_probabilities(self, outcomes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Normalised over all outcomes: a matrix product for each lot of tokens."""
        contexts, out = self.contexts(outcomes, lengths), np.empty(len(outcomes))
        weights, d = np.vstack([self.outcome.T, self.bias]), self.outcome.shape[1]
        q, scores = np.ones((SCORED, d + 1), np.float32), np.empty((SCORED, len(self.outcome)), np.float32)
        for at in range(0, len(outcomes), SCORED):
            targets = outcomes[at : at + SCORED]
            n = len(targets)
            q[:n, :d] = self.predicted(contexts[at : at + n])
            some = np.matmul(q[:n], weights, out=scores[:n])
            some -= some.max(1)[:, None]
            own = some[np.arange(n), targets]
            out[at : at + n] = own - np.log(np.exp(some, out=some).sum(1))
        return out / np.log(10)


class Trainer:
    """Noise-contrastive estimation: each token is told from outcomes drawn by their frequency, with steps by AdaGrad."""

    def __init__(self, model: Model, rate: float, seed: int, step_tokens: int = START_STEP):
        self.model, self.rate, self.step_tokens = model.with_flat(model.flat()), rate, step_tokens
        self.squares = [np.full(p.shape, 1.0, np.float32) for p in model.parameters()]
        self.random = np.random.default_rng(seed)
        self.cumulative = np.cumsum(model.noise)
        self.log_noise = np.log(NOISE * model.noise).astype(np.float32)
        k, d = model.context.shape
        self.cells = np.arange(k * d).reshape(k, d)
        self.tokens = 0

    def step(self, contexts: np.ndarray, targets: np.ndarray) -> None:
        m, b, (k, d) = self.model, len(targets), self.model.outcome.shape
        drawn = np.minimum(np.searchsorted(self.cumulative, self.random.random(NOISE) * self.cumulative[-1]), k - 1)
        q, own, other = m.predicted(contexts), m.outcome.take(targets, 0), m.outcome[drawn]
        # differences of the log-odds from which the two kinds are told
        true = 1 / (1 + np.exp(np.clip(np.einsum("bd,bd->b", q, own) + m.bias[targets] - self.log_noise[targets], -30, 30)))
        false = -1 / (1 + np.exp(-np.clip(q @ other.T + m.bias[drawn] - self.log_noise[drawn], -30, 30)))
        to_q = (true[:, None] * own + false @ other).astype(float).ravel()
        outcome = np.bincount(self.cells.take(targets, 0).ravel(), (true[:, None] * q).ravel(), k * d).reshape(k, d)
        np.add.at(outcome, drawn, false.T @ q)
        bias = np.bincount(targets, true, k)
        np.add.at(bias, drawn, false.sum(0))
        # sums by position and outcome, from which both gradients of the context follow
        sums = np.array([np.bincount(self.cells.take(c, 0).ravel(), to_q, (k + 1) * d).reshape(k + 1, d) for c in contexts.T])
        context, positions = np.einsum("ckd,cd->kd", sums, m.positions), np.einsum("ckd,kd->cd", sums, m.context)
        scale = 1 / np.sqrt(b)
        for p, g, s in zip(m.parameters(), (context, positions, outcome, bias), self.squares, strict=True):
            g = (g * scale).astype(np.float32)
            s += g * g
            p += self.rate * g / np.sqrt(s)
        self.tokens += b

    def learn(self, outcomes: np.ndarray, lengths: np.ndarray) -> None:
        contexts = self.model.contexts(outcomes, lengths)
        for at in range(0, len(outcomes), self.step_tokens):
            self.step(contexts[at : at + self.step_tokens], outcomes[at : at + self.step_tokens])


_vocabularies: dict[str, Vocabulary] = {}


def _here(sent) -> Vocabulary:
    """The vocabulary of a broadcast, kept by each Python worker between its tasks."""
    if sent.value[0] not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[sent.value[0]] = Vocabulary(*sent.value[1])
    return _vocabularies[sent.value[0]]


def _sent(spark: SparkSession, v: Vocabulary):
    fields = (v.total, v.different, v.words, v.classes, v.class_totals, v.outcome_counts, v.known, v.known_counts)
    return spark.sparkContext.broadcast((uuid.uuid4().hex, fields))


def _flat_words(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    words: list[bytes] = []
    lengths = []
    for text in texts:
        found = words_of(text)
        lengths.append(len(found))
        words += found
    return words, np.array(lengths)


def train(docs: DataFrame, vocabulary: Vocabulary, sent, start_tokens: int = START_TOKENS) -> Model:
    """A start on a sample in the driver's numpy, then a pass over all docs in Spark's tasks, averaged by tokens."""
    spark = docs.sparkSession
    model = Model.start(vocabulary.outcome_counts)
    if not vocabulary.total:
        return model
    wide = 1 << 60
    limit = int(wide * min(1.0, start_tokens / vocabulary.total))
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(wide)) < limit).select("text")

    def make_outcomes():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [_here(sent).outcomes(words_of(t))[0].astype("<i4").tobytes() for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["outcomes"])

        return each

    texts = [np.frombuffer(r.outcomes, "<i4") for r in map_batches(sample, "outcomes binary", make_outcomes).collect()]  # some start_tokens numbers
    trainer = Trainer(model, 0.2, 1)
    order = np.random.default_rng(2)
    for _ in range(START_ROUNDS if texts else 0):
        mixed = [texts[i] for i in order.permutation(len(texts))]
        trainer.learn(np.concatenate(mixed).astype(np.int64), np.array([len(t) for t in mixed]))
    started = spark.sparkContext.broadcast(trainer.model)  # K * (2 D + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Trainer(started.value, 0.05, 100 + TaskContext.get().partitionId(), PASS_STEP)
        for batch in batches:
            if batch.num_rows:
                words, lengths = _flat_words(batch.column("text").to_pylist())
                own.learn(_here(sent).outcomes(words)[0].astype(np.int64), lengths)
        if own.tokens:
            values = own.model.flat().astype(float) * own.tokens
            rows = np.array_split(values, -(-len(values) // 256))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([float(own.tokens)] * len(rows)), pa.array([x.tobytes() for x in rows], pa.binary())], ["part", "tokens", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for part, tokens, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                have = sums.setdefault(part, [0.0, 0.0])
                have[0] += tokens
                have[1] = have[1] + np.frombuffer(values)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x for x, _ in sums.values()], pa.float64()), pa.array([x.tobytes() for _, x in sums.values()], pa.binary())], ["part", "tokens", "sums"])

    bounded_batches(spark)
    schema = "part int, tokens double, sums binary"
    parts = docs.select("text").mapInArrow(run, schema).repartition("part").mapInArrow(added, schema).collect()  # one model
    if not parts:
        return trainer.model
    return trainer.model.with_flat(np.concatenate([np.frombuffer(r.sums) / r.tokens for r in sorted(parts, key=lambda r: r.part)]))


@dataclass
class Fitted:
    vocabulary: Vocabulary
    sent: Broadcast
    model: Model
    counts: DataFrame


def fit(docs: DataFrame, start_tokens: int = START_TOKENS) -> Fitted:
    """Word counts (a written table, to be released by the caller) and the model of all texts of docs."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    counts = materialise(count_words(texts), "bilinear-counts")
    vocabulary = learn_vocabulary(counts)
    sent = _sent(docs.sparkSession, vocabulary)
    return Fitted(vocabulary, sent, train(texts, vocabulary, sent, start_tokens), counts)


def score_texts(docs: DataFrame, fitted: Fitted) -> DataFrame:
    """doc_id, held_out (if docs has it), n_tokens, n_known, train_tokens, base_score and score of every text."""
    spark = docs.sparkSession
    vocabulary, sent, counts = fitted.vocabulary, fitted.sent, fitted.counts
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("held_out") if "held_out" in docs.columns else F.lit(False).alias("held_out"))
    model_sent = spark.sparkContext.broadcast(fitted.model)
    base_total = float(np.log10(vocabulary.total + vocabulary.different + 1))
    rare_type = pa.list_(pa.struct([("word", pa.string()), ("times", pa.int64())]))

    def make():
        m = model_sent.value
        row = [TaskContext.get().partitionId() << 40]

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            v = _here(sent)
            of_known, class_share = np.log10(v.known_counts + 1), v.class_share()
            words, lengths = _flat_words(batch.column("text").to_pylist())
            outcomes, places = v.outcomes(words)
            outcomes = outcomes.astype(np.int64)
            known = places >= 0
            at = np.where(known, places, 0)
            base = (np.where(known, of_known[at], 0.0) if len(of_known) else np.zeros(len(words))) - base_total
            share = np.where(known, v.known_share[at], -class_share[outcomes]) if len(of_known) else -class_share[outcomes]
            first = np.cumsum(lengths) - lengths
            total = lambda x: np.add.reduceat(x, first)
            rare: list[list[dict]] = [[] for _ in lengths]
            text_of = np.repeat(np.arange(len(lengths)), lengths)
            gone = np.flatnonzero(~known)
            for text, of_text in _grouped(text_of[gone], gone):
                rare[text] = [{"word": w.decode("utf-8", "surrogatepass"), "times": n} for w, n in Counter(words[i] for i in of_text.tolist() if words[i] != END).items()]
            n = len(lengths)
            made = [pa.array(np.arange(row[0], row[0] + n)), batch.column("doc_id"), batch.column("held_out"), pa.array(lengths, pa.int64()), pa.array(total(known.astype(np.int64))), pa.array(total(base)), pa.array(total(m.log10_probabilities(outcomes, lengths) + share)), pa.array(rare, rare_type)]
            row[0] += n
            return pa.RecordBatch.from_arrays(made, ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"])

        return each

    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<struct<word:string,times:long>>"
    scored = materialise(map_batches(texts, schema, make), "bilinear-scores")
    # the words that tasks do not know: only their counts are missing, which raise both scores by log10(count + 1)
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times")
    found = rare.join(counts.select("word", "n"), "word").groupBy("row", "n").agg(F.sum("times").alias("times"))
    raised = found.groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("raised"))
    out = scored.drop("rare").join(raised, "row", "left").na.fill(0, ["more_known", "raised"])
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("more_known")).alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"), (F.col("base_score") + F.col("raised")).alias("base_score"), (F.col("score") + F.col("raised")).alias("score"))


def _grouped(keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Values by key, for sorted keys."""
    if len(keys):
        edges = np.flatnonzero(np.diff(keys)) + 1
        for key, some in zip(keys[np.concatenate(([0], edges))].tolist(), np.split(values, edges), strict=True):
            yield key, some


def op11_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", held_out(7, 2).alias("held_out"))
    return score_texts(docs, fit(docs.filter("not held_out")))
