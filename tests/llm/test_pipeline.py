"""The pipeline and the registered queries over the smallest tables, against brute force."""

import hashlib
import re
import sys
import zlib
from pathlib import Path

import pytest

import __spark_entry__
import corpus_pipeline
from gridwright.llm.common import read_table

sys.path.insert(0, str(Path(__file__).parent))
from test_operators import brute_components, brute_repeats, check_packing, crc, ids_of, library  # noqa: E402, F401

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in read_table(spark, FOLDER, "documents").collect()]


@pytest.fixture(scope="module")
def query(spark):
    known = __spark_entry__.queries()
    return lambda name: known[name](spark, FOLDER)


def leaks(spark, rows):
    words = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    items = [(r.item_id, words(r.text)) for r in read_table(spark, FOLDER, "benchmark").collect()]
    return {(d, i) for d, t in rows for x in [words(t)] for i, y in items if y in x}


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontamination", "packing"]


def test_op1(spark, query, documents):
    assert {(r.doc_id, r.item_id) for r in query("op1_decontaminate").collect()} == leaks(spark, documents)


def test_op2(spark, query):
    rows = query("op2_url_rules").collect()
    assert {r.page_id for r in rows} == {r.page_id for r in read_table(spark, FOLDER, "pages").collect()}
    for r in rows:
        fits = [(len(x), x, v) for v, x in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")) if ("." + r.host).endswith("." + x.split("/")[0]) and r.path.startswith("/" + x.split("/", 1)[1])]
        assert (r.rule, r.verdict) == max(fits)[1:] if fits else r.rule is None and r.verdict in ("allow", "block")


def test_op3(query, documents):
    rows = query("op3_toxicity").collect()
    assert {r.doc_id for r in rows} == {d for d, _ in documents}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_op4(query, documents):
    rows = {r.doc_id: r for r in query("op4_media").collect()}
    seen = {}
    for d, t in documents:
        data = t.encode()
        padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        r = rows[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])) and r.media_bytes > len(padded)
        assert seen.setdefault(t, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_op5(spark, query):
    lang = {r.doc_id: r.lang for r in read_table(spark, FOLDER, "documents").collect()}
    rows = [r for r in query("op5_langmix").collect() if r.held_out]
    assert len(rows) > 30 and sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.97 * len(rows)


def test_op7(query, documents, library):  # noqa: F811
    start = 0
    for (d, t), r in zip(sorted(documents), sorted(query("op7_token_store").collect()), strict=True):
        ids = ids_of(library, t)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, start, len(ids), crc(ids))
        start += len(ids)


def test_op8(query, documents, library):  # noqa: F811
    rows = query("op8_packing").collect()
    n = check_packing(rows, 2048)
    assert n <= 1.02 * sum(r.length for r in rows) / 2048 + 1
    texts = dict(documents)
    for r in rows:
        assert r.ids_crc32 == crc(ids_of(library, texts[r.doc_id])[r.start : r.start + r.length])


def test_op9(query, documents):
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in query("op9_suffix_dedup").collect())
    assert got == [(*x[:4], hashlib.sha256(x[4]).hexdigest()) for x in brute_repeats(documents, 200)]


def test_op10(query, documents):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in query("op10_jaccard_join").collect()}
    assert got == brute_components(documents, 90, 3)


def test_pipeline_stages(spark, tmp_path, library):  # noqa: F811
    docs = read_table(spark, FOLDER, "documents")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, FOLDER).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        rows = docs.collect()
        kept.append(len(rows))
        after = {r.doc_id: getattr(r, "text", None) for r in rows}
        if name != "packing":
            assert docs.columns == columns and len(after) == len(rows)
        if name == "language_id":
            assert after == {d: t for d, t in before.items() if any(map(str.isalpha, t))}
        elif name == "line_dedup":
            assert set(after) == set(before)
            for d, t in before.items():
                rest = iter(t.split("\n"))
                assert not after[d] or all(line in rest for line in after[d].split("\n"))  # lines go, none changes
        elif name == "jaccard_join":
            components = brute_components(sorted(before.items()), 80, 5)
            assert after == {d: before[d] for d, (n, c) in components.items() if c == d}
        elif name == "decontamination":
            bad = {d for d, _ in leaks(spark, before.items())}
            assert after == {d: t for d, t in before.items() if d not in bad}
        else:
            check_packing(rows, 2048)
            assert {(r.doc_id, r.start, r.ids_crc32) for r in rows} == {(d, s, crc(ids[s:e])) for d, t in before.items() for ids in [ids_of(library, t)] for s, e in pieces(len(ids))}
    assert sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, FOLDER).collect()) == sorted(tuple(r)[:5] for r in rows)


def pieces(n, capacity=2048):
    ends = range(n % capacity or capacity, n + 1, capacity)
    return list(zip([0, *ends], ends, strict=False))
