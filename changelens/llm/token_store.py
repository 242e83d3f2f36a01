"""Token-id files: short documents compressed one by one with a shared dictionary.

A store is a folder with three tables:
  dictionary  one row: sha256 (hex) and bytes of a zstandard dictionary that was
              trained on serialised id arrays of a bounded sample
  blobs       about 1 MB each: dictionary_sha256, part, blob, first (ids before it
              in its part), payload (frames, one after another) and the index:
              doc_ids, offsets, counts
  parts       ids in each part and before it
Parts follow each other by doc_id, and so do documents in them. A frame holds one
document's ids as little-endian unsigned integers of `width` bytes (two where the
vocabulary fits, else four), and opens with nothing but its offset and the dictionary. Tables are committed as wholes by
Spark, so a lost executor repeats its part and leaves nothing half written.

Cases: a null or empty text has only the end id. A null doc_id sorts first. Very
long texts are one long frame. Equal doc_ids stand together in an order by text
hash. With too few samples there is no dictionary (empty bytes). An empty table
makes an empty store. Further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_rows, shuffles

#: The dictionary is trained on this many documents at most, none longer than SAMPLE_BYTES.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 1024, 1 << 16, 112 << 10
BLOB_BYTES = 1 << 20
#: Units a worker remembers, none longer than LONGEST. Bounds memory, not results.
REMEMBERED, LONGEST = 1_500_000, 64

#: Texts of these characters alone: normalisation leaves them as they are but for
#: lower case, which maps one to one, and the tokenizer cuts them as _UNIT does.
_PLAIN = re.compile("[\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ÿ]*")
_UNIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")
_LETTERS = re.compile("[a-zß-öø-ÿ]+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")


class WordEncoder:
    """The tokenizers library behind a memory of the units it cuts texts into; no
    token reaches across them. Texts with rarer characters are cut at white space,
    which the tokenizer drops, and what lies between is remembered as it is."""

    def __init__(self, path: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.type = f"<u{width}"
        self.width = width
        self.last = np.zeros(self.lib.get_vocab_size(), bool)
        self.last[[i for t, i in self.lib.get_vocab().items() if t.endswith("</w>")]] = True
        self.memo: dict[str, bytes] = {}  # units of plain texts, in lower case
        self.rare: dict[str, bytes] = {}  # what stands between white space elsewhere

    def pack(self, ids: list[int]) -> bytes:
        return b"".join([i.to_bytes(self.width, "little") for i in ids])

    def fill(self, memo: dict[str, bytes], chunks: list[str]) -> None:
        for c in chunks:
            memo[c] = self.pack(self.lib.encode(c, add_special_tokens=False).ids)

    def fill_letters(self, words: list[str]) -> None:
        """Words of letters in one call: each is one unit that ends in a final token.
        They need no normalisation, so the same model does without it."""
        got = self.bare.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids
        ids = np.array(got, self.type)
        raw = ids.tobytes()
        ends = ((np.flatnonzero(self.last[ids]) + 1) * self.width).tolist()
        if len(ends) != len(words) or ends[-1] != len(raw):
            self.fill(self.memo, words)
        else:
            self.memo.update(zip(words, [raw[a:b] for a, b in zip([0, *ends], ends)]))

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        plain = not any(c in text for c in "\x1c\x1d\x1e\x1f") if text.isascii() else _PLAIN.fullmatch(text)
        if plain and "<|" not in text:
            memo, units = self.memo, _UNIT.findall(text.lower())
        elif _ODD_SPACE.search(text):
            return self.pack(self.lib.encode(text, add_special_tokens=False).ids)
        else:
            memo, units = self.rare, text.split()
        found = list(map(memo.get, units))
        if None in found:
            if len(memo) >= REMEMBERED:
                memo.clear()
            new = {u for u in units if u not in memo}
            letters = [u for u in new if _LETTERS.fullmatch(u)] if memo is self.memo else []
            if letters:
                self.fill_letters(letters)
            self.fill(memo, [u for u in new if u not in memo])
            found = [memo[u] for u in units]
            for u in new:
                if len(u) > LONGEST:
                    del memo[u]
        return b"".join(found)


@lru_cache(maxsize=2)
def encoder(path: str, width: int) -> WordEncoder:
    return WordEncoder(path, width)


def id_bytes(tokenizer_path: str, end_id: int) -> int:
    """Bytes that hold each id: two or four."""
    from tokenizers import Tokenizer

    largest = max([*Tokenizer.from_file(tokenizer_path).get_vocab().values(), end_id])
    return 2 if largest < 1 << 16 else 4


def sampled(docs: DataFrame) -> DataFrame:
    """The texts whose rows have the smallest hashes, SAMPLE_DOCS at most and none over
    SAMPLE_BYTES. Rows are counted first (Parquet's own counts), and a threshold on the
    hash lets about twice as many through as are wanted, so no task sorts more than that."""
    place, n = F.xxhash64("doc_id", "text"), docs.count()
    own = docs.where(F.octet_length("text") <= SAMPLE_BYTES)
    if n > 2 * SAMPLE_DOCS:
        own = own.where(place < F.lit(-(2**63) + int(2**64 * (2 * SAMPLE_DOCS / n))))
    return own.select("text", place.alias("place")).orderBy("place", "text").limit(SAMPLE_DOCS).select("text")


def _dictionary(docs: DataFrame, tokenizer_path: str, width: int) -> bytes:
    import zstandard

    enc = encoder(tokenizer_path, width)
    samples = [enc.ids(r[0]) for r in sampled(docs).toLocalIterator()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_store(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 1,
    width: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encodes every text, appends end_id and writes the store under path."""
    spark = docs.sparkSession
    width = width or id_bytes(tokenizer_path, end_id)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    trained = _dictionary(src, tokenizer_path, width)
    sha = hashlib.sha256(trained).hexdigest()
    spark.createDataFrame([(sha, bytearray(trained), width)], "sha256 string, bytes binary, width int").coalesce(
        1
    ).write.parquet(f"{path}/dictionary")
    schema = pa.schema(
        [
            ("dictionary_sha256", pa.string()),
            ("part", pa.int32()),
            ("blob", pa.int32()),
            ("first", pa.int64()),
            ("payload", pa.binary()),
            ("doc_ids", pa.list_(pa.int64())),
            ("offsets", pa.list_(pa.int32())),
            ("counts", pa.list_(pa.int64())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        enc = encoder(tokenizer_path, width)
        own = zstandard.ZstdCompressionDict(trained) if trained else None
        if own is not None:
            own.precompute_compress(level=3)  # not again for each short frame
        pack = zstandard.ZstdCompressor(level=3, dict_data=own)
        part, blob, first, ids_in = TaskContext.get().partitionId(), 0, 0, 0
        end = end_id.to_bytes(width, "little")
        held: list[bytes] = []
        ids: list[int] = []
        at: list[int] = []
        counts: list[int] = []
        size = 0

        def full():
            return pa.RecordBatch.from_pylist(
                [
                    {
                        "dictionary_sha256": sha,
                        "part": part,
                        "blob": blob,
                        "first": first,
                        "payload": b"".join(held),
                        "doc_ids": ids,
                        "offsets": at,
                        "counts": counts,
                    }
                ],
                schema=schema,
            )

        for b in batches:
            for i, text in zip(b.column(0), b.column(1)):
                raw = enc.ids(text.as_py()) + end
                frame = pack.compress(raw)
                held.append(frame)
                ids.append(i.as_py())
                at.append(size)
                counts.append(len(raw) // width)
                size += len(frame)
                ids_in += counts[-1]
                if size >= BLOB_BYTES:
                    yield full()
                    blob, first = blob + 1, ids_in
                    held, ids, at, counts, size = [], [], [], [], 0
        if held:
            yield full()

    ddl = (
        "dictionary_sha256 string, part int, blob int, first long, payload binary, "
        "doc_ids array<long>, offsets array<int>, counts array<long>"
    )
    text_hash = F.xxhash64("text")
    ordered = src.repartitionByRange(shuffles(spark), F.col("doc_id"), text_hash).sortWithinPartitions("doc_id", text_hash)
    ordered.select("doc_id", "text").mapInArrow(run, ddl).write.option("compression", "none").parquet(f"{path}/blobs")
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    sums = spark.read.parquet(f"{path}/blobs").groupBy("part").agg(F.sum(total).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = sums.select("part", "n", F.coalesce(before, F.lit(0)).alias("before"))  # a row for each part
    parts.coalesce(1).write.parquet(f"{path}/parts")


def read_store(spark: SparkSession, path: str, only=None) -> DataFrame:
    """(doc_id, start, ids binary as little-endian unsigned 32-bit integers) of
    all documents, or of the doc_ids in `only`: then just their frames are opened."""
    return _frames(spark, path, only, False)


def store_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files."""
    return _frames(spark, path, None, True)


def _frames(spark: SparkSession, path: str, only, digest: bool) -> DataFrame:
    sha, trained, width = spark.read.parquet(f"{path}/dictionary").first()
    trained = bytes(trained)
    if hashlib.sha256(trained).hexdigest() != sha:
        raise ValueError("the dictionary is damaged")
    wanted = None if only is None else frozenset(only)
    last = pa.int64() if digest else pa.binary()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("x", last)])

    def run(batches):
        import zstandard

        from .common import rows_to_batches

        own = zstandard.ZstdCompressionDict(trained) if trained else None
        unpack = zstandard.ZstdDecompressor(dict_data=own)

        def rows():
            for b in batches:
                for r in range(b.num_rows):
                    mark, start, payload, ids, at, counts = (c[r].as_py() for c in b.columns)
                    if mark != sha:
                        raise ValueError("a blob was written with another dictionary")
                    for k, i in enumerate(ids):
                        if wanted is None or i in wanted:
                            end = at[k + 1] if k + 1 < len(at) else len(payload)
                            raw = unpack.decompress(payload[at[k] : end], max_output_size=counts[k] * width)
                            full = np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()
                            yield i, start, len(full) // 4, zlib.crc32(full) if digest else full
                        start += counts[k]

        yield from rows_to_batches(rows(), schema)

    blobs = spark.read.parquet(f"{path}/blobs")
    if wanted is not None:
        blobs = blobs.where(F.arrays_overlap("doc_ids", F.array(*(F.lit(int(x)) for x in wanted))))
    parts = spark.read.parquet(f"{path}/parts").select("part", "before")
    src = blobs.join(parts, "part").select(
        "dictionary_sha256", (F.col("first") + F.col("before")).alias("start"), "payload", "doc_ids", "offsets", "counts"
    )
    ddl = f"doc_id long, start long, n_tokens long, x {'long' if digest else 'binary'}"
    return src.mapInArrow(run, ddl).withColumnRenamed("x", "ids_crc32" if digest else "ids")
