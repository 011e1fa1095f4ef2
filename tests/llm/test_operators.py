"""Each operator against a brute-force version or an exact round trip, and on awkward tables."""

import hashlib
import itertools
import random
import re
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridwright.llm import decontaminate, jaccard_join, langmix, line_templates, media, packing, suffix_dedup, token_store, toxicity, url_rules
from gridwright.llm.common import PieceEncoder, tokenizer_path
from gridwright.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, spans int, score double, held_out string, n_dropped int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def words(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


def awkward(spark, texts=None):
    """Nulls, empty and blank texts, repeated rows, ties, a long text, columns whose names operators use."""
    base = words(1, 120)
    if texts is None:
        texts = [None, "", " \n\t", "one", "two words", base, base, base.replace("alpha", "omega", 1), base + " tail", words(2, 90), "é ß ñ " * 30, "x" * 5000, words(3, 4000), "123 456", "\n".join(["same line here"] * 30)]
    rows = [(i, t, "en" if i % 2 else None, None, None, "r", 1, 0.5, "h", 7) for i, t in enumerate(texts)]
    rows += [rows[5], (None, base, "en", "s", 1, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


@pytest.fixture(scope="module")
def docs(spark):
    return awkward(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return PieceEncoder(tokenizer_path()).library


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pieces_equal_the_library(library):
    e = PieceEncoder(tokenizer_path())
    e.KEEP = 300
    r = random.Random(5)
    bits = [" ", "\n", "a", "b", ".", ",", "'s", "é", "1", "23", "\t", " ", "Ab", "!", "<|endoftext|>", "\r", "ß", "\0"]
    texts = [None, "", *("".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(3000))]
    for t, x in zip(texts, e.encode(texts), strict=True):
        assert x.tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_kept_pieces_have_a_bound_in_bytes(library):
    """Texts without spaces, each a piece of its own: right ids, and nothing of them is kept."""
    e = PieceEncoder(tokenizer_path())
    r = random.Random(6)
    texts = ["".join(r.choice("\u4e2d\u6587\u5b57abc=") for _ in range(r.randint(49, 3000))) for _ in range(60)] + ["short words only, here.", "x" * 49 + " y"]
    for t, x in zip(texts, e.encode(texts), strict=True):
        assert x.tolist() == library.encode(t, add_special_tokens=False).ids
    assert max(map(len, e.kept)) <= e.KEEP_CHARS and len(e.kept) < 30


def test_dropped_lines_take_linear_time(spark):
    n = 100_000
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(2 * n - 1)), lambda i: i.cast("string")).alias("lines"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (2 * i).cast("int")).alias("gone"))
    began = time.monotonic()
    kept = df.select(line_templates.lines_between(F.col("lines"), F.col("gone")).alias("k")).first().k
    assert kept == [str(i) for i in range(1, 2 * n, 2)] and time.monotonic() - began < 20
    few = spark.createDataFrame([(["a", "b", "c"], g) for g in ([0], [2], [1], [0, 1, 2], [])], "lines array<string>, gone array<int>")
    assert [r.k for r in few.select(line_templates.lines_between(F.col("lines"), F.col("gone")).alias("k")).collect()] == [["b", "c"], ["a", "b"], ["a", "c"], [], ["a", "b", "c"]]


def test_elias_fano():
    r = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (5, 3), (1000, 10**6), (3000, 40)):
        values = np.sort(r.integers(0, top, n))
        f = token_store.EliasFano.from_bytes(memoryview(token_store.EliasFano.encode(values).to_bytes()))
        assert f.decode().tolist() == values.tolist()
        assert [f.select(i) for i in range(n)] == values.tolist()
        assert len(f.low) + len(f.high) <= n * (2 + np.log2(max(2, top / max(n, 1)))) / 8 + 8 + n / 8
    with pytest.raises(IndexError):
        f.select(n)


@pytest.mark.parametrize("shard", [20, 1 << 20])
def test_token_store(spark, docs, library, tmp_path, monkeypatch, shard):
    monkeypatch.setattr(token_store, "SHARD_IDS", shard)
    path = f"file://{tmp_path}/store"
    token_store.write_store(docs, path, tokenizer_path())
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_store(spark, path).collect())
    start, want = 0, []
    for d, t in sorted(((-1 if d is None else d), t or "") for d, t in texts_of(docs)):
        ids = ids_of(library, t)
        want.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want


def test_token_store_without_rows(spark, empty, tmp_path):
    token_store.write_store(empty, f"file://{tmp_path}/store", tokenizer_path())
    assert token_store.read_store(spark, f"file://{tmp_path}/store").count() == 0


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(docs, library, capacity):
    rows = packing.pack(docs, tokenizer_path(), capacity, groups=8).collect()
    check_packing(rows, capacity)
    want = []
    for d, t in texts_of(docs):
        ids = ids_of(library, t)
        start, end = 0, len(ids) % capacity or capacity
        for piece in range(-(-len(ids) // capacity)):
            want.append((d, piece, start, end - start, crc(ids[start:end])))
            start, end = end, end + capacity
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)


def test_packing_plan_is_tight():
    r = random.Random(3)
    for _ in range(20):
        sizes = [min(2048, max(1, int(r.expovariate(1 / r.choice([60, 400, 900]))))) for _ in range(2000)]
        histogram = {s: sizes.count(s) for s in set(sizes)}
        runs = packing.plan_bins(histogram)
        placed = {}
        for n, slots in runs:
            assert n > 0 and sum(slots) <= 2048
            for s in slots:
                placed[s] = placed.get(s, 0) + n
        assert placed == histogram
        assert sum(n for n, _ in runs) <= 1.02 * sum(sizes) / 2048 + 2


def test_media_round_trip(docs):
    rows = {r.doc_id: r for r in media.media_digests(media.encode_media(docs)).collect()}
    for d, t in texts_of(docs):
        data = (t or "").encode()
        padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        r = rows[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


def test_media_probe_reads_no_payload(spark):
    for size in (1, 64, 65, 1024, 1025, 40_000):
        stored = media.build_container(media.pad_payload(bytes(size)))
        at = stored.index(b"mdat") + 4
        t = media.sample_tables(stored[:at] + b"\xff" * (len(stored) - at))[0]
        assert t["codec"] == "raw " and t["duration"] == t["sizes"].sum() and (t["offsets"][t["sync"]] == at + 1024 * np.arange(len(t["sync"]))).all()
    bad = spark.createDataFrame([(1, b""), (2, None), (3, b"nothing like a box at all"), (4, stored[:200])], "doc_id long, media binary")
    assert all(r.error and r.codec is None for r in media.probe_media(bad).collect())


def fragmented(rows, style, defaults=(10, 7, 0x10000)):
    """A container of two tracks whose samples (track, bytes, duration, key) stand in fragments, a fragment for each row."""
    word = lambda *x: struct.pack(f">{len(x)}I", *x)
    tables = b"".join(media.full_box(k, word(0, 0) if k == b"stsz" else word(0)) for k in (b"stts", b"stsc", b"stsz", b"stco"))

    def track(i):
        entry = media.full_box(b"stsd", word(1), media.box(b"raw ", bytes(28)))
        mdia = media.box(b"mdia", media.full_box(b"mdhd", word(0, 0, 100, 0, 0)), media.full_box(b"hdlr", bytes(4), b"vide", bytes(12)), media.box(b"minf", media.box(b"stbl", entry, tables)))
        return media.box(b"trak", media.full_box(b"tkhd", word(0, 0, i, 0, 0)), mdia)

    usual = [media.full_box(b"trex", word(i, 1, *defaults)) for i in (1, 2)]
    out = media.box(b"moov", track(1), track(2), media.box(b"mvex", *usual))
    for number, samples in enumerate(rows):
        def moof(start, ends, at=len(out), samples=samples, number=number):
            trafs = []
            for i in (1, 2):
                mine = [s for s in samples if s[0] == i]
                if not mine:
                    continue
                plain = all((d, len(x), key) == (defaults[0], defaults[1], False) for _, x, d, key in mine)
                fields = [] if plain else [word(d, len(x), 0 if key else 0x10000) for _, x, d, key in mine]
                head = {"base": media.full_box(b"tfhd", word(i), struct.pack(">Q", start), flags=1), "moof": media.full_box(b"tfhd", word(i), flags=0x20000), "chain": media.full_box(b"tfhd", word(i))}[style]
                place = {"base": 0, "moof": start - at, "chain": start - at if not trafs else None}[style]
                offset = b"" if place is None else struct.pack(">i", place)
                trafs.append(media.box(b"traf", head, media.full_box(b"trun", word(len(mine)), offset, *fields, flags=(0 if place is None else 1) | (0 if plain else 0x700))))
                start += sum(len(x) for _, x, _, _ in mine)
            return media.box(b"moof", media.full_box(b"mfhd", word(number)), *trafs)

        head = moof(len(out), 0)
        data = b"".join(x for i in (1, 2) for t, x, _, _ in samples if t == i)
        out += moof(len(out) + len(head) + 8, 0) + media.box(b"mdat", data)
    return out


@pytest.mark.parametrize("style", ["base", "moof", "chain"])
def test_media_fragments(spark, style):
    r = random.Random(5)
    rows = [[(r.choice((1, 2)), r.randbytes(r.randrange(0, 50)), r.randrange(30), r.random() < 0.3) for _ in range(r.randrange(1, 20))] for _ in range(30)]
    rows += [[(1, b"sevenby", 10, False)] * 5, []]
    stored = fragmented(rows, style)
    for i, t in enumerate(media.sample_tables(stored), 1):
        mine = [s for row in rows for s in row if s[0] == i]
        assert [stored[a : a + n] for a, n in zip(t["offsets"], t["sizes"], strict=True)] == [x for _, x, _, _ in mine]
        assert t["duration"] == sum(d for _, _, d, _ in mine) and t["sync"].tolist() == [k for k, s in enumerate(mine) if s[3]]
    assert media.read_payload(stored) == b"".join(x for row in rows for t, x, _, _ in row if t == 1)
    many = media.full_box(b"trun", struct.pack(">I", 2**32 - 1))
    lost = [stored[:-40], stored + media.box(b"moof", media.box(b"traf", media.full_box(b"tfhd", b"\0\0\0\1"), many)), stored + media.box(b"moof", media.box(b"traf", many)),
        stored + media.box(b"moof", media.box(b"traf", media.full_box(b"tfhd", b"\0\0\0\1", b"\xff" * 8, flags=1)))]
    found = media.probe_media(spark.createDataFrame(list(enumerate([stored, *lost])), "doc_id long, media binary")).orderBy("doc_id").collect()
    assert found[0].error is None and found[0].n_samples == sum(s[0] == 1 for row in rows for s in row) and len(found[0].keyframes) == found[0].n_keyframes > 0
    assert all(x.error and x.n_samples is None for x in found[1:])


def test_media_of_a_broken_second_track():
    good = media.build_container(media.pad_payload(bytes(range(256)) * 9))
    moov = good.index(b"moov") - 4
    size = int.from_bytes(good[moov : moov + 4], "big")
    bad = media.box(b"trak", media.box(b"mdia", media.box(b"minf", media.box(b"stbl", media.full_box(b"stsz", b"\xff" * 8)))))
    # the second track stands before the samples, whose places it moves
    stored = good[:moov] + (size + len(bad)).to_bytes(4, "big") + good[moov + 4 : moov + size] + bad + good[moov + size :]
    chunks = stored.index(b"stco") + 8
    n = int.from_bytes(stored[chunks : chunks + 4], "big")
    places = np.frombuffer(stored, ">u4", n, chunks + 4) + len(bad)
    stored = stored[: chunks + 4] + places.astype(">u4").tobytes() + stored[chunks + 4 + 4 * n :]
    assert "error" in media.sample_tables(stored)[1] and media.read_payload(stored) == bytes(range(256)) * 9
    beyond = stored[: chunks + 4] + (places + 1).astype(">u4").tobytes() + stored[chunks + 4 + 4 * n :]
    assert media._probe(beyond)["error"] == "ValueError: a sample lies beyond the file"


def test_languages(spark, empty):
    german, french = "der und die nicht schule werden durch über", "le une est dans pour avec être leçon"
    make = lambda lang, i: " ".join(random.Random(f"{lang}{i}").choices((german if lang == "de" else french).split(), k=60))
    rows = [(i, make(lang, i), lang) for i, lang in enumerate(["de", "fr"] * 60)]
    rows += [(1000, None, "de"), (1001, "", "fr"), (1002, "12 34 !!", "de"), (1003, make("de", 1) + " " + make("fr", 1), None), (None, make("fr", 5), "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("own"))
    model = langmix.fit(docs)
    got = {r.doc_id: r for r in langmix.identify(docs, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:120])
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and not got[i].shares for i in (1000, 1001, 1002))
    assert sorted(s.lang for s in got[1003].shares) == ["de", "fr"] and abs(got[1003].shares[0].share - 0.5) < 0.15
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(120))
    kept = langmix.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == 122 and {r.score for r in kept.collect()} == {"own"}
    assert langmix.identify(empty, langmix.fit(empty)).count() == 0


def test_toxicity(spark, empty):
    r = random.Random(1)
    rows, marks = [], []
    for i in range(400):
        toxic = i % 5 == 0
        t = words(f"t{i}", 80).split()
        for _ in range(6 * toxic):
            t.insert(r.randrange(80), r.choice(["vileword", "hatespeak", "slurring"]))
        rows.append((i, " ".join(t)))
        marks.append((i, 1, int(toxic)))
    rows += [(900, None), (901, "")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*marks, (None, 1, 1), (7, None, None), (901, 1, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.score_toxicity(docs, toxicity.fit(*toxicity.labelled_sample(docs, labels))).collect()}
    out = [i for i in range(400) if got[i].held_out]
    assert len(out) > 40 and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(400))
    assert sum(got[i].predicted == (i % 5 == 0) for i in out) >= 0.95 * len(out)
    assert got[900].predicted == got[901].predicted == 0 and got[900].score == got[901].score
    assert toxicity.score_toxicity(empty, toxicity.fit([], [])).count() == 0


def test_toxicity_does_not_depend_on_the_sampling_rates(spark):
    """Half of the marked texts are toxic, and the mean score is the share of toxic labels, whatever share of the ordinary texts the sample holds."""

    def marked(seed):
        r, t = random.Random(seed), words(seed, 40).split()
        for _ in range(6):
            t.insert(r.randrange(40), r.choice(["vileword", "hatespeak", "slurring"]))
        return " ".join(t)

    rows = [(i, marked(f"r{i}") if i % 16 < 2 else words(f"r{i}", 40), int(i % 16 == 0)) for i in range(3200)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string").cache()
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows], "doc_id long, quality int, toxic int")
    toxic_bytes = sum(len(t) + toxicity.ROW_BYTES for _, t, x in rows if x)
    means = []
    for sample_bytes in (toxicity.SAMPLE_BYTES, toxic_bytes):
        sample = toxicity.labelled_sample(docs, labels, sample_bytes)
        score = toxicity.fit(*sample).scorer()
        means.append([np.mean([score(t)[0] for t in x]) for x in ([t for _, t, _ in rows], [marked(f"new{i}") for i in range(40)])])
    assert len(sample[1]) < 600  # the second sample left most ordinary texts out
    assert all(abs(share - 1 / 16) < 0.025 for share, _ in means)
    assert abs(means[0][1] - means[1][1]) < 0.2


def test_line_templates(spark, docs, empty):
    rows = []
    for i in range(30):
        lines = [words(f"{i}a", 12), f"Updated at {i}:{i * 7} by user{i}", words(f"{i}b", 9), "Share this page with friends now" if i % 2 else "Share this page with people now", words(f"{i}c", 7)]
        rows.append((i, "\n".join(lines)))
    copied = "\n".join(words(f"copy{k}", 10) for k in range(5))
    rows += [(100 + i, copied) for i in range(20)]
    out = {r.doc_id: r for r in line_templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(30):
        assert out[i].n_lines == 5 and out[i].n_dropped == 2 and len(out[i].text.split("\n")) == 3
    assert all(out[100 + i].n_dropped == 0 and out[100 + i].text == copied for i in range(20))  # copies are left to other operators
    x = line_templates.without_recurring_lines(docs)
    assert x.columns == docs.columns and x.count() == docs.count()
    key = lambda t: (t[0] is None, t[0], t[1] is None, t[1])
    assert sorted(texts_of(x), key=key) == sorted(texts_of(docs), key=key)
    assert line_templates.drop_recurring(empty).count() == 0


def test_line_blocks_of_the_pipeline(spark):
    """Blocks go whole, a frequent footer goes, copied documents stay."""
    rows, want = [], {}

    def put(lines, kept):
        want[len(rows)] = "\n".join(kept)
        rows.append((len(rows), "\n".join(lines)))

    own = lambda i, k: words(f"own{i}-{k}", 11)
    block = [words(f"block{k}", 6 + k) for k in range(4)]
    end = [words(f"end{k}", 6 + k) for k in range(2)]
    for i in range(30):
        body = [own(i, k) for k in range(12)]
        put([*body[:5], *block, *body[5:], *end], body)
    footer, kinds = words("footer", 14), [words(f"kind{k}", 13) for k in range(20)]
    for i in range(120):
        body = [own(1000 + i, k) for k in range(3)]
        put([*body, kinds[i % 20], footer], [*body, kinds[i % 20]])  # 20 neighbours in 120 documents; each of them in six only
    copied = [words(f"copied{k}", 10) for k in range(16)]
    for i in range(20):
        put(copied, copied)
    near = [words(f"near{k}", 10) for k in range(16)]
    for i in range(60):
        changed = [own(2000 + i, 0) if k == i % 16 else t for k, t in enumerate(near)]
        put(changed, changed)
    for i in range(20):  # a copied text under a title of its own loses its first line only, as before
        text = [words(f"titled{k}", 10) for k in range(6)]
        put([own(3000 + i, 0), *text], [own(3000 + i, 0), *text[1:]])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert dict(texts_of(corpus_pipeline.line_dedup(spark, docs, ""))) == want


def brute_components(rows, percent, n):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    sets, root = {}, {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[d] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
        root[d] = d
    names = sorted(sets)
    for a in names:
        for b in names:
            i = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    return {d: (len(sets[d]), root[d]) for d in names}


@pytest.mark.parametrize(("percent", "n", "block"), [(90, 3, 1 << 21), (80, 5, 1 << 21), (80, 3, 900)])
def test_jaccard_components(spark, percent, n, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    r = random.Random(percent + n)
    rows = [(i, t) for i, t in enumerate([None, "", " \t\n", "A b", "a B", "a b", "solo", words(1, 3), words(1, 3).upper()])]
    for base in range(6):
        text = words(f"base{base}", [8, 30, 60, 120, 200, 500][base]).split()
        for _ in range(25):
            t = list(text)
            for _ in range(r.randrange(0, 1 + len(t) // 12)):
                t[r.randrange(len(t))] = r.choice(WORDS)
            rows.append((len(rows) + 3, " ".join(t[: len(t) - r.randrange(3)])))
    monkeypatch.setattr(jaccard_join, "COMMON_SHARE", 0.2 if block == 900 else 0.005)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), percent, n)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got.collect()} == brute_components(rows, percent, n)


def test_sent_shingles_of_linked_sets_meet():
    r = np.random.default_rng(2)
    numbers = lambda n: r.integers(0, 1 << 63, n).astype(np.uint64)
    linked = 0
    for percent in (80, 90, 95):
        for _ in range(300):
            n = int(r.integers(1, 400))
            a = np.unique(numbers(n))
            drop = int(r.integers(0, max(1, n * (100 - percent) // 100 + 1)))
            b = np.unique(np.concatenate([a[drop:], numbers(int(r.integers(0, 1 + n * (100 - percent) // 200)))]))
            common = len(np.intersect1d(a, b))
            if common and 100 * common >= percent * (len(a) + len(b) - common):
                linked += 1
                for last in (a[:0], np.sort(r.choice(a, len(a) // 2, replace=False))):
                    x, y = (jaccard_join.sent(s, percent, last) for s in (a, b))
                    assert len(np.intersect1d(x, y)) >= max(jaccard_join.need(len(s), percent) for s in (a, b))
    assert linked > 500


def test_near_duplicates_keep_one(docs, empty):
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    names = [r.doc_id for r in kept.collect()]
    assert 5 in names and 6 not in names and 7 not in names and {0, 1, 2, 3, 4} <= set(names) and None in names
    assert jaccard_join.one_of_each(empty).count() == 0 and jaccard_join.jaccard_components(empty).count() == 0


def test_jaccard_of_a_repeated_id(spark):
    """Rows that repeat a doc_id with other texts are one document, with the links of each text."""
    a, b = words("ra", 80), words("rb", 90)
    rows = [(7, a), (7, b), (9, a + " more"), (3, b + " more"), (12, words("rc", 50)), (None, a), (7, None)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 80, 5).collect()
    assert len(got) == 7 and {(r.doc_id, r.component_id) for r in got} == {(7, 3), (9, 3), (3, 3), (12, 12), (None, None), (7, 7)}


def test_components(spark):
    r = random.Random(8)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5)]
    root = {x: x for ab in links for x in ab}
    for a, b in links:
        x, y = sorted((root[a], root[b]))
        root = {k: x if v == y else v for k, v in root.items()}
    alone = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if k not in alone}


def brute_repeats(rows, n):
    count = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for _, x in data:
        for k in range(len(x) - n + 1):
            count[x[k : k + n]] = count.get(x[k : k + n], 0) + 1
    out = []
    for d, x in data:
        cover = bytearray(len(x))
        for k in range(len(x) - n + 1):
            if count[x[k : k + n]] > 1:
                cover[k : k + n] = b"\1" * n
        kept = bytes(c for c, gone in zip(x, cover, strict=True) if not gone)
        out.append((-1 if d is None else d, len(x), sum(cover), len(re.findall(b"\1+", bytes(cover))), kept))
    return sorted(out)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_dedup(spark, docs, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPLIT_CLASSES", hot)
    monkeypatch.setattr(suffix_dedup, "RANGE_SUFFIXES", 40 if hot > 1 else 16_384)
    monkeypatch.setattr(suffix_dedup, "RUN_BYTES", 6000)
    r = random.Random(4)
    shared = words("shared", 60)
    rows = texts_of(docs)
    for i in range(25):
        cut = r.randrange(0, len(shared) - 150)
        rows.append((100 + i, words(f"s{i}", r.randrange(3, 60)) + shared[cut : cut + r.randrange(120, 420)] + words(f"e{i}", r.randrange(0, 60))))
    rows += [(200, "ab" * 400), (201, shared + shared), (202, shared[:199]), (203, shared[:200]), (204, "z" * 200)]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((-1 if x.doc_id is None else x.doc_id, x.n_bytes, sum(s.b - s.a for s in x.spans), len(x.spans), bytes(x.kept)) for x in out.collect())
    assert got == brute_repeats(rows, 200)


def test_suffix_dedup_without_rows(empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_loser_tree_merges_with_common_prefixes():
    r = random.Random(6)
    for runs in (0, 1, 2, 3, 7, 8):
        data = [sorted(bytes(r.choice(b"ab") for _ in range(r.randrange(0, 9))) for _ in range(r.randrange(0, 40))) for _ in range(runs)]
        coded = [suffix_dedup.front_decode(suffix_dedup.front_code(x)) for x in data]
        assert [x for x, _ in coded] == data
        order, prefixes = suffix_dedup.merge_runs(coded)
        merged = [data[a][b] for a, b in order]
        assert merged == sorted(x for run in data for x in run)
        assert prefixes[1:] == [suffix_dedup.common_prefix(a, b) for a, b in zip(merged, merged[1:], strict=False)]


def test_decontamination(spark, docs, empty):
    items = [(i, words(f"item{i}", n)) for i, n in enumerate([5, 12, 30, 60, 90])] + [(5, "What is the capital of France? Paris"), (6, None), (7, ""), (8, words("item1", 12))]
    items.append((9, items[2][1]))
    rows = [(i, words(f"d{i}", 150)) for i in range(40)] + [(100 + i, words(f"x{i}", 40 * i) + " " + t + " " + words(f"y{i}", 70)) for i, t in items if t]
    rows += [(200, " ".join(items[3][1].split()[:30])), (201, "  WHAT is the Capital, of france? -- paris!"), (202, None), (203, "")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    want = {(100 + i, j) for i, t in items for j, u in items if t and u and t == u} | {(201, 5)}
    assert got == want
    assert decontaminate.without_leaks(docs, bench).count() == docs.count()
    assert decontaminate.find_leaks(empty, bench).count() == 0
    assert decontaminate.find_leaks(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_wand_equals_plain_scores():
    r = random.Random(9)
    items = [(i, " ".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(1, 12)))) for i in range(150)]
    frequency = {}
    for _, t in items:
        for k in np.unique(decontaminate.words_of(t)).view(np.int64).tolist():
            frequency[k] = frequency.get(k, 0) + 1
    index = decontaminate.Index.build(items, 150, frequency, 6.0, 12)
    for _ in range(200):
        terms = sorted(r.sample(range(len(index.terms)), r.randrange(1, len(index.terms))))
        scores = np.zeros(150)
        for t in terms:
            scores[index.postings[t][0]] += index.postings[t][1]
        got = dict(index.search(terms, 0.5))
        assert set(got) == set(np.flatnonzero(scores >= 0.5 - 1e-6).tolist()) and all(abs(scores[i] - s) < 1e-9 for i, s in got.items())


def test_url_rules(spark):
    pages = [(0, "HTTP://A.B.Net/x?q#f"), (1, "https://www.example.NET/en/1"), (2, "http://example.com/de/9"), (3, "http://example.com/dee"), (4, "http://x.org/fr/"), (5, None), (6, "no scheme"), (7, "http://a.net"), (8, "http://planet/x"), (9, "a://b://c/d"), (10, "http://h#/p"), (11, "https://example.net/en/1?://x.com/")]
    pages += [(100 + i, f"http://site{i % 3}.com/{'spam' if i % 2 else 'ham'}/{i}") for i in range(80)] + [(100, "http://site0.com/ham/0")]
    labels = [(100 + i, bool(i % 2)) for i in range(80)]
    df, marks = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "id long, block boolean")
    mined = url_rules.mine_rules(df.withColumnRenamed("page_id", "id"), marks, 0.05, 0.8)
    assert ["p:spam"] in [r.antecedent for r in mined.collect()] and all(len(r.antecedent) == 1 for r in mined.collect())
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(df, mined).collect()}
    assert got[0] == ("a.b.net", "/x", "net/", "block") and got[1] == ("www.example.net", "/en/1", "example.net/en/", "allow") and got[11][2] == "example.net/en/"
    assert got[2][2:] == ("example.com/de/", "block") and got[3][2:] == (None, "allow") and got[4][2:] == ("org/fr/", "allow")
    assert got[5] == got[6] == ("", "", None, "allow") and got[7] == ("a.net", "", None, "allow") and got[8][2] is None
    assert got[9][:2] == ("b:", "//c/d") and got[10][:2] == ("h", "")
    assert all(got[100 + i][3] == ("block" if i % 2 else "allow") for i in range(80))
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge(none, url_rules.mine_rules(none.withColumnRenamed("page_id", "id"), marks)).count() == 0


def test_mined_rules_equal_enumeration(spark):
    """All token sets by brute force: support, confidence and the pruning of needless ones; a planted pair decides."""
    r = random.Random(12)
    rows = []
    for i in range(1500):
        segments = [s for s in ("shop", "win", "news", "blog") if r.random() < 0.5]
        bad = r.random() < (0.95 if {"shop", "win"} <= set(segments) else 0.15)
        rows.append((i, f"http://{r.choice(['a', 'b'])}.com/" + "/".join(segments), bad))
    rows += [(1500 + i, rows[i][1], rows[i][2]) for i in range(40)]
    pages, labels = spark.createDataFrame([x[:2] for x in rows], "id long, url string"), spark.createDataFrame([(i, b) for i, _, b in rows], "id long, block boolean")
    got = {tuple(x.antecedent): round(x.confidence, 9) for x in url_rules.mine_rules(pages, labels, 0.02, 0.5, float("inf")).collect()}
    sets = []
    for _, url, bad in rows:
        host, *path = url[len("http://"):].split("/")
        sets.append(({f"h:{x}" for x in host.split(".")} | {f"p:{x}" for x in path if x}, bad))
    tokens, rules = sorted(set().union(*(s for s, _ in sets))), {}
    for k in range(1, len(tokens) + 1):
        for chosen in itertools.combinations(tokens, k):
            marks = [bad for s, bad in sets if s.issuperset(chosen)]
            if marks and sum(marks) >= 0.02 * len(sets) and sum(marks) >= 0.5 * len(marks):
                rules[chosen] = sum(marks) / len(marks)
    want = {a: round(c, 9) for a, c in rules.items() if not any(rules.get(tuple(x for x in a if x != y), -1) >= c for y in a)}
    assert got == want and ("p:shop", "p:win") in got
    judged = {x.page_id: x.verdict for x in url_rules.judge(pages.withColumnRenamed("id", "page_id"), url_rules.mine_rules(pages, labels, 0.02, 0.8), []).collect()}
    assert all(judged[i] == ("block" if "/shop/win" in url else "allow") for i, url, _ in rows)


def test_few_pages_are_mined_too(spark):
    pages = spark.createDataFrame([(i, f"http://x.com/{'bad' if i < 3 else 'good'}") for i in range(3)], "id long, url string")
    mined = url_rules.mine_rules(pages, spark.createDataFrame([(i, True) for i in range(3)], "id long, block boolean"), chance=float("inf"))
    assert {tuple(r.antecedent) for r in mined.collect()} == {("h:com",), ("h:x",), ("p:bad",)}


def test_chance_gives_no_rules(spark):
    """Labels that do not depend on the url: no rule, though some sets reach the confidence; a planted token stays."""
    for seed in range(6):
        r = random.Random(seed)
        urls = [f"http://{r.choice('abc')}.com/" + "/".join(r.sample(["shop", "win", "news", "blog", "x", "y"], 3)) for _ in range(400)]
        pages = spark.createDataFrame(list(enumerate(urls)), "id long, url string")
        shuffled = spark.createDataFrame([(i, r.random() < 0.35) for i in range(400)], "id long, block boolean")
        assert url_rules.mine_rules(pages, shuffled, 0.01).count() == 0
        assert seed or url_rules.mine_rules(pages, shuffled, 0.01, chance=float("inf")).count() > 0
    planted = spark.createDataFrame([(i, "/win" in u and r.random() < 0.8 or r.random() < 0.05) for i, u in enumerate(urls)], "id long, block boolean")
    assert ("p:win",) in {tuple(x.antecedent) for x in url_rules.mine_rules(pages, planted, 0.01).collect()}


def test_a_long_url_on_many_pages(spark):
    """Sixty tokens that always stand together are mined as one, and each of them makes a rule."""
    long = "http://long.org/" + "/".join(f"s{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(58))
    rows = [(i, long if i % 4 == 0 else f"http://other.com/{'good' if i % 2 else 'fine'}") for i in range(200)]
    marks = spark.createDataFrame([(i, i % 4 == 0) for i in range(200)], "id long, block boolean")
    began = time.monotonic()
    mined = {tuple(x.antecedent) for x in url_rules.mine_rules(spark.createDataFrame(rows, "id long, url string"), marks).collect()}
    assert len(mined) == 60 and all(len(x) == 1 for x in mined) and ("p:saa",) in mined and time.monotonic() - began < 120


def test_mixtures_equal_an_exhaustive_search():
    """Every set of languages by plain expectation maximisation to convergence; the chosen set has the best penalised likelihood."""
    r = np.random.default_rng(4)
    p = r.dirichlet(np.full(40, 0.3), 4) * 0.99 + 0.01 / 40

    def plain(rows, n):
        share = np.full(len(rows), 1 / len(rows))
        for _ in range(3000):
            share = share * (rows @ (n / (share @ rows))) / n.sum()
        return float(n @ np.log(share @ rows)), share

    for _ in range(25):
        truth = r.dirichlet(np.full(4, 0.4))
        n = r.multinomial(400, truth @ p).astype(float)
        seen = n > 0
        cost = langmix.PENALTY * np.log(n.sum() + 1)
        found = {s: plain(p[list(s)][:, seen], n[seen]) for k in range(1, 5) for s in itertools.combinations(range(4), k)}
        best = max(found, key=lambda s: found[s][0] - cost * (len(s) - 1))
        got = langmix.infer_mixture(p[:, seen], n[seen])
        chosen = tuple(np.flatnonzero(got).tolist())
        assert found[chosen][0] - cost * (len(chosen) - 1) >= found[best][0] - cost * (len(best) - 1) - 0.5
        if chosen == best:
            assert np.abs(got[list(best)] - found[best][1]).max() < 0.02


def test_sample_rates_do_not_vanish():
    for n in (1, 1500, 1501, 2 * 10**9, 10**10, 10**14):
        limit = langmix.pick_limit(1500, n)
        assert 0 < limit <= langmix.PICKS and abs(limit / langmix.PICKS * n - min(n, 1500)) < 1e-3 * n + 1


def test_forged_containers(spark, empty):
    """Tables that claim what the file cannot hold, deep nesting and entries out of range give an error, no crash."""
    good = media.build_container(media.pad_payload(bytes(5000)))
    at = {k: good.index(k) + 4 for k in (b"stsz", b"stss", b"stsc", b"stco")}
    put = lambda k, skip, value: good[: at[k] + skip] + value.to_bytes(4, "big") + good[at[k] + skip + 4 :]
    forged = [put(b"stsz", 8, 2**32 - 1), put(b"stsz", 4, 0), put(b"stss", 8, 0), put(b"stss", 8, 10**6), put(b"stsc", 12, 2**32 - 1), put(b"stsc", 8, 7), put(b"stco", 4, 2**31)]
    nested = b""
    for _ in range(3000):
        nested = media.box(b"moov", nested)
    rows = media.probe_media(spark.createDataFrame(list(enumerate([*forged, nested, good[:60]])), "doc_id long, media binary")).collect()
    assert all(r.error and r.codec is None for r in rows)
    assert media.media_digests(media.encode_media(empty)).count() == 0
    compact = media.full_box(b"stz2", bytes(3), b"\4", (3).to_bytes(4, "big"), b"\x12\x30")
    body = b"".join((media.full_box(b"stsc", (1).to_bytes(4, "big"), (1).to_bytes(4, "big"), (3).to_bytes(4, "big"), (1).to_bytes(4, "big")), compact, media.full_box(b"stco", (1).to_bytes(4, "big"), (40).to_bytes(4, "big"))))
    track = media.sample_tables(media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.box(b"minf", media.box(b"stbl", body))))))[0]
    assert track["sizes"].tolist() == [1, 2, 3] and track["offsets"].tolist() == [40, 41, 43]


def test_templates_of_one_leaf(spark):
    """Two kinds of lines with the same length and opening become two templates; short lines with a common opening stay."""
    rows, kept = [], []
    for i in range(24):
        own = [words(f"p{i}{k}", 9) for k in range(3)]
        a, b = f"see also the {words(i, 1)} page of our great archive", f"see also the other {words(i + 100, 1)} story in a book"
        rows.append((i, "\n".join([own[0], a, own[1], b, own[2], f"He said that {words(i + 200, 1)}"])))
        kept.append("\n".join([*own, rows[-1][1].split("\n")[-1]]))
    out = {r.doc_id: r.text for r in line_templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[i] for i in range(24)] == kept


def test_all_templates_of_a_leaf(spark):
    """A leaf of six templates: with rounds=None all of them recur, the later ones as well; only later places are compared."""
    rows = []
    for i in range(24):
        lines = []
        for k in range(6):
            lines += [words(f"q{i}{k}", 8), f"see also the {words(i * 6 + k, 1)} {words(f'z{k}', 5)}"]
        rows.append((i, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dropped = lambda n: {r.n_dropped for r in line_templates.drop_recurring(docs, line_templates.TreeSettings(rounds=n)).collect()}
    assert dropped(3) == {3} and dropped(None) == {6}
