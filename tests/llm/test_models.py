"""Whitening, divergence of sources and language-model scores against direct computations, and on awkward tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridwright.llm import bilinear, divergence, whitening

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, p string, item string, total double"


# --- whitening -----------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<float>, x int, n string")


def direct(rows, k=4):
    """n, deviations, eigenvalues and vectors from numpy's dense solver over the different vectors."""
    kept = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    d = max(len(x) for _, x in kept)
    kept = [(i, np.pad(x, (0, d - len(x)))) for i, x in kept]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, sums = len(fit), fit.sum(0)
    c = fit - sums / n
    values, basis = np.linalg.eigh(c.T @ c / n)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    return kept, n, sums, values, basis, np.trace(c.T @ c / n)


def test_whitening_equals_a_dense_solver(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((400, 24)) * np.linspace(2, 0.2, 24) + 5
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000, rows[3][1]), (1000, rows[3][1]), (None, rows[4][1]), (7, None), (8, [None, *rows[0][1][1:]]), (9, [float("nan"), *rows[0][1][1:]]), (10, [float("-inf"), *rows[0][1][1:]])]
    table = vectors(spark, rows)
    fitted = whitening.fit(table)
    kept, n, sums, values, basis, trace = direct(rows)
    got = whitening.whiten(table, fitted).collect()
    assert len(got) == 4 * len(kept) and {g.n for g in got} == {n} and fitted.residual < 1e-10
    by = defaultdict(list)
    for g in got:
        by[g.vec_id, g.component].append(g)
    sign = np.sign((fitted.vectors * basis).sum(0))
    for i, x in kept:
        for k in range(4):
            g = by[i, k + 1].pop()
            assert g.deviation == int(((n * x - sums) ** 2).sum())
            assert g.whitened == pytest.approx(float((x - sums / n) @ basis[:, k] / math.sqrt(values[k])) * sign[k], abs=1e-8)
            assert g.explained == pytest.approx(values[k] / trace, rel=1e-10)
            assert g.identity_error < 1e-9
    assert not any(by.values())


@pytest.mark.parametrize(("rows", "components"), [([], 0), ([(1, None)], 0), ([(1, [])], 0), ([(1, [0.5, 1.0]), (2, [0.5, 1.0])], 0), ([(1, [0.5, 1.0]), (2, [1.5, 1.0])], 1), ([(1, [1.0]), (2, [2.0]), (3, [4.0])], 1), ([(1, [1.0, 0.0]), (2, [1.0]), (3, [0.0, 3.0]), (4, [2.0, 2.0])], 2)])
def test_whitening_of_few_vectors(spark, rows, components):
    table = vectors(spark, rows)
    fitted = whitening.fit(table)
    got = whitening.whiten(table, fitted).collect()
    assert len(got) == components * len([1 for _, v in rows if v])
    if components:
        _, n, _, values, _, trace = direct(rows)
        assert fitted.n == n and np.allclose(fitted.values / fitted.trace, values[:components] / trace)


def test_lobpcg_with_close_eigenvalues():
    r = np.random.default_rng(1)
    q, _ = np.linalg.qr(r.standard_normal((60, 60)))
    values = np.concatenate([[10, 9.99, 9.98, 9.97, 9.96, 9.0], np.linspace(8, 0, 54)])
    matrix = (q * values) @ q.T
    found, x, residual = whitening.lobpcg((matrix + matrix.T) / 2, 60, 4)
    assert np.allclose(found, values[:4], atol=1e-10) and residual < 1e-10
    assert np.allclose(np.abs((x * q[:, :4]).sum(0)), 1)
    with pytest.raises(RuntimeError):
        whitening.lobpcg(matrix, 60, 4, rounds=2)


# --- divergence ----------------------------------------------------------------------------------


def by_hand(rows, least=3, top=200):
    """lang, source, part, item, value, rank from plain dictionaries."""
    used, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        terms = [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        used[lang or "", source or ""].update(terms)
        seen[lang or ""].update(set(terms))
        groups[lang or ""].add(source or "")
    out = []

    def ranked(lang, source, part, found):
        found = sorted(found, key=lambda x: (-x[1], x[0].encode()))
        out.extend((lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(found[: top if part == "term" else None]))

    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= least]

        def shares(count):
            total = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (count[t] + 1) // total for t in kept}  # noqa: B023

        p = {s: shares(used[lang, s]) for s in sources}
        q = shares(sum((used[lang, s] for s in sources), Counter()))
        for s in sources:
            ranked(lang, s, "pair", [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources - {s}])
            ranked(lang, s, "term", [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if used[lang, s][t] and p[s][t] > q[t]])
    return sorted(out)


def divergence_rows(seed):
    r = random.Random(seed)
    words = [a + b for a in "abcdefghij" for b in ("x", "Y", "é", "ß", "Z")]
    texts = [" ".join(r.choice(words[: r.randint(2, 50)]) + r.choice([" ", ".", "7", "-"]) for _ in range(r.randint(0, 40))) for _ in range(120)]
    rows = [(t, r.choice(["en", "de", None]), r.choice(["a", "b", "c", "d", "e", "ü", None])) for t in texts]
    return rows + [(None, "en", "silent"), ("", "fr", "one"), ("", "fr", "two"), ("alone", "it", "only"), rows[0], rows[0], ("Long " * 50_000, "en", "a")]


@pytest.mark.parametrize(("chunk", "block", "span"), [(1 << 14, 32, 64), (5, 2, 1), (7, 1, 2)])
def test_divergence_equals_plain_dictionaries(spark, monkeypatch, chunk, block, span):
    monkeypatch.setattr(divergence, "SPAN_CHUNKS", span)
    monkeypatch.setattr(divergence, "PIECE", 1000)
    rows = divergence_rows(chunk)
    table = spark.createDataFrame([(i, *x, 1, 2, "p", "i", 0.5) for i, x in enumerate(rows)], SCHEMA)
    got = divergence.divergence(table, top_terms=5, chunk_terms=chunk, block_groups=block).collect()
    assert sorted(map(tuple, got)) == by_hand(rows, top=5)


def test_divergence_of_an_empty_table(spark):
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_stay_exact_beyond_a_long():
    for count, total in ((0, 1), (8, 9), (9 * 10**12, 10**13 + 7), (3 * 10**13, 9 * 10**13 + 1)):
        assert divergence._share(np.array([count]), total).tolist() == [1 + 10**9 * (count + 1) // total]


def test_packed_vectors_round_trip():
    places, counts = np.array([9, 2, 70_000]), np.array([1, 300, 1 << 40])
    back = divergence.unpack(divergence.pack(places, counts))
    assert back[0].tolist() == [2, 9, 70_000] and back[1].tolist() == [300, 1, 1 << 40]


# --- language model ------------------------------------------------------------------------------


def lm_table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1, 2, "p", "i", 0.5) for i, t in texts], SCHEMA)


def lm_texts(seed=5, n=150):
    r = random.Random(seed)
    a = ["the", "of", "and", *(x + y for x in ("th", "er", "on") for y in ("ing", "tion", "ed,", "ly."))]
    b = ["der", "die", "und", *(x + y for x in ("sch", "ich", "ung") for y in ("en", "keit", "er,", "te."))]
    texts = [" ".join(r.choices(kind, k=r.randint(1, 60))) for kind in (r.choice([a, b]) for _ in range(n))]
    texts += [None, "", " \t\n", "THE The the", "né é x", "w" * 5000, "rare" + "x" * 70 + " rare" + "x" * 70, texts[0], texts[0], "\x1c \x85 |"]
    return [*enumerate(texts), (None, texts[1]), (3, texts[3])]


def lm_by_hand(texts, held):
    """Counts, known tokens and base scores from a plain dictionary."""
    cut = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})), "\0"]
    counts = Counter(w for i, t in texts if not held(i) for w in cut(t))
    n, v = sum(counts.values()), len(counts)
    return n, [(i, len(cut(t)), sum(counts[w] > 0 for w in cut(t)), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in cut(t)), t) for i, t in texts]


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


@pytest.mark.parametrize("known", [1 << 18, 40, 0])
def test_language_model_scores(spark, monkeypatch, known):
    monkeypatch.setattr(bilinear, "KNOWN_WORDS", known)
    monkeypatch.setattr(bilinear, "WORDS", 9)
    monkeypatch.setattr(bilinear, "CLASSES", 12)
    texts = lm_texts()
    docs = lm_table(spark, texts).withColumn("held_out", bilinear.held_out(7, 2))
    fitted = bilinear.fit(docs.filter("not held_out"), start_tokens=3000)
    got = by_id([(r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score, r.train_tokens) for r in bilinear.score_texts(docs, fitted).collect()])
    total, want = lm_by_hand(texts, lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2)
    want = by_id(want)
    counts = {r.word.encode(): r.n for r in fitted.counts.collect()}
    v = fitted.vocabulary
    assert {g[5] for g in got} == {total} and len(got) == len(want)
    assert known or len(v.known) == 9
    sizes = Counter()
    for w, n in counts.items():
        sizes[v.outcome_of(w)] += n + 1
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], abs=1e-9)
        # the score from the model's vectors alone: softmax of every token, then the word's share of its class
        words = bilinear.words_of(w[4])
        outcomes = [v.outcome_of(x) for x in words]
        score = 0.0
        for i, (x, o) in enumerate(zip(words, outcomes, strict=True)):
            before = [*reversed(outcomes[max(0, i - 4) : i]), *[len(v.outcome_counts)] * 4][:4]
            q = sum(fitted.model.context[c].astype(float) * fitted.model.positions[k] for k, c in enumerate(before))
            s = fitted.model.outcome @ q + fitted.model.bias
            score += (s[o] - s.max() - math.log(np.exp(s - s.max()).sum())) / math.log(10)
            if o >= len(v.words):
                score += math.log10((counts.get(x, 0) + 1) / (sizes[o] + 1))
        assert g[4] == pytest.approx(score, rel=1e-4, abs=1e-3)


def test_language_model_learns(spark):
    """Two kinds of text: held-out ones are likelier than by the base, and than before training."""
    texts = [(i, t) for i, (_, t) in enumerate(lm_texts(9, 700)) if t and len(t) < 1000]
    docs = lm_table(spark, texts).withColumn("held_out", bilinear.held_out(7, 2))
    fitted = bilinear.fit(docs.filter("not held_out"))
    held = [r for r in bilinear.score_texts(docs, fitted).collect() if r.held_out]
    assert len(held) > 60 and sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)
    start = bilinear.Fitted(fitted.vocabulary, fitted.sent, bilinear.Model.start(fitted.vocabulary.outcome_counts), fitted.counts)
    untrained = [r for r in bilinear.score_texts(docs, start).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.score for r in untrained)


@pytest.mark.parametrize("texts", [[], [(2, "only held out")], [(None, None)]])
def test_language_model_of_few_texts(spark, texts):
    docs = lm_table(spark, texts).withColumn("held_out", bilinear.held_out(7, 2) if texts and texts[0][0] is None else bilinear.F.lit(True))
    got = bilinear.score_texts(docs, bilinear.fit(docs.filter("not held_out"))).collect()
    assert len(got) == len(texts) and all(math.isfinite(r.score) and r.base_score <= 0 for r in got)


def test_noise_contrastive_step_follows_the_gradient():
    """One step on many tokens raises the objective that it descends."""
    r = np.random.default_rng(0)
    counts = np.array([50.0, 30, 15, 5])
    model = bilinear.Model.start(counts, 3, 2)
    outcomes = r.choice(4, 4000, p=[0.1, 0.2, 0.3, 0.4])
    trainer = bilinear.Trainer(model, 0.1, 1)
    before = model.log10_probabilities(outcomes, np.array([4000])).mean()
    for _ in range(5):
        trainer.learn(outcomes, np.array([4000]))
    after = trainer.model.log10_probabilities(outcomes, np.array([4000])).mean()
    entropy = float(np.log10([0.1, 0.2, 0.3, 0.4]) @ [0.1, 0.2, 0.3, 0.4])
    assert before < after <= 0 and after == pytest.approx(entropy, abs=0.05)
