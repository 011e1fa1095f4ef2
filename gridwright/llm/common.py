"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes in one Arrow batch: texts vary from nothing to megabytes, so rows are no bound.
BATCH_BYTES = 2 << 20

CRC_MOD = "crc32(encode(cast(doc_id as string), 'utf-8'))"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of one Arrow batch, the same for every Python stage of the session, lazy ones included."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the cluster names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        named = "file://" + tempfile.mkdtemp(prefix="gridwright-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/gridwright/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads any more; other tables are left alone."""
    for df in tables:
        path = getattr(df, "written_at", None) if "written_at" in vars(df) else None
        if path:
            spark = df.sparkSession
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def let_go(spark: SparkSession) -> None:
    """Have the driver collect its garbage: Spark drops broadcasts, shuffle files and generated classes of jobs that are over
    only then, and by itself asks for it every half hour."""
    spark.sparkContext._jvm.System.gc()


#: Tables of ids are broadcast up to so many rows (some 24 bytes each).
BROADCAST_ROWS = 1_000_000


def bounded(df: DataFrame) -> DataFrame:
    """A written table of short rows, to be broadcast if it is small enough, else shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def salted_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", salts: int = 8) -> DataFrame:
    """left joined to right, a table of one row a key: the rows of a hot key, nulls included, are dealt to several tasks."""
    dealt = left.withColumn("_gw_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    copies = right.withColumn("_gw_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*([on] if isinstance(on, str) else on), "_gw_salt"], how).drop("_gw_salt")


def join_few(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    """left joined to a written table of one row a key: by broadcast if that has few rows, else by salted keys."""
    return left.join(F.broadcast(right), on) if right.count() <= BROADCAST_ROWS else salted_join(left, right, on)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """mapInArrow with state that is made once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                yield each(batch)

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


# --- hashing of words inside byte arrays -------------------------------------------------------

_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        size = max(n, 1 << 16, 2 * len(have))
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _powers[kind] = have
    return have[:n]


def prefix_codes(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any slice follows; one longer than the data."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * _power("up", _P, len(data)), dtype=np.uint64, out=out[1:])
    return out


def slice_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]; equal slices have equal hashes wherever they stand."""
    down = _power("down", _P_INVERSE, len(prefix))
    return mix64((prefix[ends] - prefix[starts]) * down[starts])


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


#: Word bytes for words cut at ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes for words cut at ASCII white space and punctuation.
WORD_BYTES = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_bytes(text: str | None) -> np.ndarray:
    """UTF-8 bytes with A-Z lower-cased."""
    return _LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]


def word_hashes(data: np.ndarray, word_bytes: np.ndarray = NOT_SPACE) -> np.ndarray:
    if not len(data):
        return np.zeros(0, np.uint64)
    starts, ends = spans_of(word_bytes[data])
    return slice_hashes(prefix_codes(data), starts, ends)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word shingles in order; fewer words make one shingle, none makes none."""
    if not len(words):
        return words
    k = min(n, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = (out + words[i : len(words) - k + 1 + i]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return mix64(out + np.uint64(k))


# --- tokens ------------------------------------------------------------------------------------


class PieceEncoder:
    """Ids of the tokenizers library, with what it returned for each space-delimited piece kept.

    The pre-tokenizer of a byte-level BPE starts a new token at every single space or line break
    between two visible characters, and between a letter and a final full stop or comma, so such
    pieces encode alike alone and in a text. Texts with double spaces, a final space or the marks of
    special tokens go to the library whole.
    """

    #: A line break beside other white space, where a text is not cut.
    BESIDE_BREAK = re.compile(r"\n(?:\s|(?<=\s\n))")
    #: Pieces kept in each of two generations; what the older one holds is kept if used again. Longer ones (texts
    #: without spaces, codes) are encoded whenever they come, so what is kept has a bound in bytes as well.
    KEEP, KEEP_CHARS = 500_000, 48

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.ends = {c: self._whole([c])[0] for c in ".,\n"}
        self.line_break = int(np.frombuffer(self.ends["\n"], self.dtype)[0])
        self.opens = self._opens()
        self.cuts = self._cuts()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _cuts(self) -> bool:
        """Does the loaded tokenizer cut a text where this class does? If not, every text goes to the library whole."""
        probe = "One two, three.\nFour (five) 6.7 it's \u00e9t\u00e9, \u4e2d\u6587.\nSix\n\nseven!"
        pieces = probe.replace(" ", "\0 ").split("\0")
        fine = [x for p in ("One", " two", ",", " three", ".", "\n", "Four", *pieces[3:]) for x in [p]]
        whole, *rest = self._whole([probe, *fine])
        return whole == b"".join(rest)

    def _opens(self) -> np.ndarray:
        """By id: does the token open with a space?"""
        vocabulary = self.library.get_vocab()
        space = self.library.id_to_token(int(np.frombuffer(self._whole([" "])[0], self.dtype)[0]))
        out = np.zeros(max(vocabulary.values()) + 1, bool)
        out[[i for token, i in vocabulary.items() if token.startswith(space)]] = True
        return out

    def _spaced(self, words: list[str]) -> list[bytes]:
        """Ids of pieces that open with a space and hold no other white space: one text, in which their first tokens are
        those that open with a space."""
        ids = np.frombuffer(self._whole(["".join(words)])[0], self.dtype)
        return self._parts(words, ids, np.flatnonzero(self.opens[ids]), 0)

    def _lines(self, words: list[str]) -> list[bytes]:
        """Ids of words without white space: one text, a word a line."""
        ids = np.frombuffer(self._whole(["\n".join(words)])[0], self.dtype)
        return self._parts(words, ids, np.concatenate(([-1], np.flatnonzero(ids == self.line_break))) + 1, 1)

    def _parts(self, words: list[str], ids: np.ndarray, starts: np.ndarray, gap: int) -> list[bytes]:
        if len(starts) != len(words):
            return self._whole(words)
        data, width = ids.tobytes(), self.dtype.itemsize
        ends = np.append(starts[1:] - gap, len(ids)) * width
        return [data[x:y] for x, y in zip((starts * width).tolist(), ends.tolist(), strict=True)]

    def _learn(self, pieces: list[str]) -> None:
        """Fill `kept` for the pieces: plain words, those with a stop, lines around a break, else the library. What the
        older generation holds is kept again."""
        kept, older, ends = self.kept, self.older, self.ends
        plain: list[str] = []
        stopped: list[str] = []
        others: list[str] = []
        for piece in pieces:
            bare = piece[1:] if piece[0] == " " else piece
            if piece in older:
                kept[piece] = older[piece]
            elif bare.isalpha():
                plain.append(piece)
            elif piece[-1] in ".," and bare[:-1].isalpha():
                stopped.append(piece)
            else:
                others.append(piece)
        joined: list[tuple[str, list[str]]] = []
        asked: set[str] = set()

        def need(piece: str) -> None:
            if piece not in kept:
                if piece in older:
                    kept[piece] = older[piece]
                else:
                    asked.add(piece)

        for piece in stopped:
            need(piece[:-1])
        for piece in others:
            parts = piece.split("\n")
            if len(parts) > 1 and not all(p and not p[0].isspace() | p[-1].isspace() for p in (parts[0][1:] or parts[0].strip(), *parts[1:])):
                asked.add(piece)
                continue
            made: list[str] = []
            for i, part in enumerate(parts):
                if i:
                    made.append("\n")
                if part[-1:] in (".", ",") and part[-2:-1].isalpha():
                    need(part[:-1])
                    made += [part[:-1], part[-1]]
                else:
                    need(part)
                    made.append(part)
            if len(made) > 1:
                joined.append((piece, made))
        asked.difference_update(plain)
        spaced, lines, rest = [], [], []
        for piece in plain:
            (spaced if piece[0] == " " else lines).append(piece)
        for piece in asked:
            alone = piece[:1] == " " and len(piece) > 1 and piece[1:].split() == [piece[1:]]
            (spaced if alone else lines if piece.isalpha() else rest).append(piece)
        for mine, ids_of in ((spaced, self._spaced), (lines, self._lines), (rest, self._whole)):
            kept.update(zip(mine, ids_of(mine) if mine else [], strict=True))
        kept.update({p: kept[p[:-1]] + ends[p[-1]] for p in stopped})
        for piece, made in joined:
            kept[piece] = b"".join(ends[x] if x in ends else kept[x] for x in made)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out = [np.zeros(0, self.dtype)] * len(texts)
        odd, cut, marked = [], [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.cuts or "  " in text or "<|" in text or text[-1] == " " or "\0" in text:
                odd.append(i)
            else:
                cut.append(i)
                marked.append(text if self.BESIDE_BREAK.search(text) else text.replace("\n", "\0\n\0"))
        for i, ids in zip(odd, self._whole([texts[i] for i in odd]), strict=True):
            out[i] = np.frombuffer(ids, self.dtype)
        if not cut:
            return out
        if len(self.kept) > self.KEEP:
            self.kept, self.older = {}, self.kept
        kept = self.kept
        kept[""] = b""
        lists = pc.split_pattern(pc.replace_substring(pa.array(marked, pa.large_string()), " ", "\0 "), "\0")
        pieces = lists.flatten().dictionary_encode()
        kinds = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()  # ten times as fast as to_pylist()
        known = list(map(kept.get, kinds))
        missing = [p for p, x in zip(kinds, known, strict=True) if x is None]
        if missing:
            self._learn([p for p in missing if len(p) <= self.KEEP_CHARS])
            long = [p for p in missing if len(p) > self.KEEP_CHARS]
            passing = dict(zip(long, self._whole(long), strict=True)) if long else {}
            known = [passing[p] if p in passing else kept[p] for p in kinds] if passing else list(map(kept.__getitem__, kinds))
        n = np.fromiter(map(len, known), np.int64, len(known)) // self.dtype.itemsize
        first = np.cumsum(n) - n
        at = pieces.indices.to_numpy()
        ends = np.concatenate(([0], np.cumsum(n[at])))
        # place k of the output is place k + shift of the known ids, one after another
        shift = np.repeat(first[at] - ends[:-1], n[at])
        ids = np.frombuffer(b"".join(known), self.dtype)[np.arange(ends[-1]) + shift]
        edges = ends[lists.offsets.to_numpy()].tolist()
        for i, a, b in zip(cut, edges, edges[1:], strict=False):
            out[i] = ids[a:b]
        return out


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each Python worker, kept between its tasks."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(mod: int, rest: int):
    """Column: does crc32 of doc_id as text leave this rest? False where doc_id is null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest, F.lit(False))
