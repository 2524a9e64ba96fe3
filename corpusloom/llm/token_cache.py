"""Token counts through a digest cache.

A document's key is the digest of its content and the digest of the tokenizer's
file. Keys are joined to stored counts; of the misses each distinct text is
encoded once, and the new counts are appended to the cache. The content is not
normalised further than null to empty: any other change could change a count.

Digests are compared before any text moves: a text of one row is encoded where it
is, and only those of several rows are moved, to be encoded once. Which is which
the tasks see in two bitmaps of fixed size over the digests.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE, join_unique, mapped, materialise, scratch_path, table

#: Pieces of text that a generation of a worker's memo holds; the last two generations are kept.
MEMO = 200_000
#: Longer pieces aren't remembered, which bounds the memory.
MEMO_CHARS = 64


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: its own if it is visible in Latin-1, else the next from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


def tokenizer_digest(path: str) -> str:
    """Version of a tokenizer: the digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class JsonCounter:
    """Counts as the tokenizers library gives them, through a bounded memo of pre-tokens.

    A byte-level BPE encodes each pre-token apart, so a text's count is the sum
    over its pre-tokens; those not in the memo go to the library's own BPE model,
    written in its letters for bytes. That holds for a tokenizer without normaliser
    whose pre-tokens are the matches of the public pattern; any other one encodes
    whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        # the library cuts out its added tokens' strings before anything else
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        import json

        model = json.loads(self.tokenizer.to_str())
        pre = model.get("pre_tokenizer") or {}
        self.by_piece = model.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.memo: dict[str, int] = {}
        self.former: dict[str, int] = {}

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if not self.by_piece or (self.special and self.special.search(text)):
            return self.whole(text)
        pieces, known = self.pattern.findall(text), self.memo
        passing = {}  # long pieces
        for piece in set(pieces).difference(known):
            n = self.former.get(piece)
            if n is None:
                n = self.piece(piece)
            if len(piece) <= MEMO_CHARS:
                known[piece] = n
            else:
                passing[piece] = n
        total = sum(map(known.__getitem__, pieces)) if not passing else sum(known[p] if p in known else passing[p] for p in pieces)
        if len(known) > MEMO:
            self.former, self.memo = known, {}
        return total

    def piece(self, piece: str) -> int:
        """Tokens of one pre-token."""
        if piece.isascii() and piece.isprintable():
            mapped_piece = piece.replace(" ", self.letters[0x20])
        else:
            mapped_piece = piece.encode().decode("latin-1").translate(self.letters)
        return len(self.model.tokenize(mapped_piece))


class ModelCounter:
    """Counts as the sentencepiece library gives them."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def __call__(self, text: str) -> int:
        return len(self.model.encode(text)) if text else 0


@functools.lru_cache(maxsize=4)
def counter(path: str):
    """A worker's counter for a tokenizer file, made once."""
    return ModelCounter(path) if path.endswith(".model") else JsonCounter(path)


def encode_counts(texts: DataFrame, path: str) -> DataFrame:
    """(digest, text) -> (digest, n_tokens)."""

    def make():
        count = counter(path)
        return lambda found: ([count(t or "") for t in found],)

    return mapped(texts, ["digest"], ["text"], make, {"n_tokens": ("long", pa.int64())})


#: Parts of the cache by the digest's first byte; a run reads those that it has digests of.
BUCKETS = 256
#: Bits of the bitmaps for each digest, at least and at most (128 MB); with more digests than that has bits for, texts are joined to them by a
#: shuffle. They decide which texts move, not what is counted. Digests that a task remembers to have sent.
BITS_EACH, LEAST_BITS, MOST_BITS, SEEN = 32, 2**16, 2**30, 1_000_000
_ROW = "digest binary, n_tokens long, bucket int"


def _bucket(digest: Column) -> Column:
    return F.conv(F.hex(F.substring(digest, 1, 1)), 16, 10).cast("int")


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """The counts (digest, n_tokens, bucket) that a cache folder has for a tokenizer version, null if it has none. A digest may be there twice."""
    home = f"{cache}/version={version}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(home)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(_ROW).parquet(home)


def _bitmap(digests: DataFrame, size: int) -> np.ndarray:
    """`size` bits, those set that some digest falls on. Made in parts of 4 kB by Spark; all of it is size / 8 bytes at most."""
    place = (F.conv(F.hex(F.substring("digest", 2, 4)), 16, 10).cast("long") % size + 1).alias("place")
    parts = digests.select(place).groupBy(F.bitmap_bucket_number("place").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    out = np.zeros(-(-size // 32768) * 4096, np.uint8)
    for r in parts.collect():  # part p, from 1, holds 32768 places
        start = (r["part"] - 1) * 4096
        out[start : start + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _on(bits: np.ndarray, n: int, digests: list[bytes]) -> np.ndarray:
    place = np.array([int.from_bytes(d[1:5], "big") % n for d in digests], np.int64)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def _encoded(rows: DataFrame, wanted: DataFrame, path: str) -> DataFrame:
    """(digest, n_tokens) of the wanted digests (digest, rows): those of one row where they are, others once after a move.

    Beyond MOST_BITS digests a bitmap would let all pass, and texts move to their digests.
    """
    n, several = wanted.agg(F.count("*"), F.count_if(F.col("rows") > 1)).first()
    sizes = [min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * k).bit_length())) for k in (n, several)]
    if n > MOST_BITS:
        own = rows.join(wanted.select(F.col("digest").alias("__digest")), F.col("digest") == F.col("__digest"), "left_semi").dropDuplicates(["digest"])
        return encode_counts(own, path)
    sent = rows.sparkSession.sparkContext.broadcast((_bitmap(wanted, sizes[0]), _bitmap(wanted.where("rows > 1"), sizes[1]), *sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        missing, several, size, size_several = sent.value
        count, seen = counter(path), set()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                digests = batch.column("digest").to_pylist()
                due, moved = _on(missing, size, digests), _on(several, size_several, digests)
                if len(seen) > SEEN:  # what is sent once more is dropped where it meets
                    seen.clear()
                keep = []
                for i in np.nonzero(due)[0].tolist():
                    if digests[i] not in seen:
                        keep.append(i)
                        if moved[i]:
                            seen.add(digests[i])
                texts = batch.column("text")
                here = [None if moved[i] else count(texts[i].as_py()) for i in keep]
                there = [texts[i].as_py() if moved[i] else None for i in keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digests[i] for i in keep], pa.binary()), pa.array(here, pa.int64()), pa.array(there, pa.string())], names=["digest", "n_tokens", "text"]
                )

    found = materialise(rows.mapInArrow(run, "digest binary, n_tokens long, text string"), "token-texts")
    moved = found.where("text is not null").select("digest", "text").dropDuplicates(["digest"])
    return found.where("n_tokens is not null").select("digest", "n_tokens").unionByName(encode_counts(moved, path))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_tokens.

    cache is a folder that all executors see; without one a fresh one is used,
    and every distinct text is a miss. Of the cache only the run's own digests are kept. Null texts count as empty: 0 bytes, 0
    tokens. Texts of any length are encoded whole; repeated rows are answered each; columns of other
    names are ignored; an empty table gives an empty result. Appending twice the same counts
    (two runs at once, or a task tried again) is harmless: reads keep one.
    """
    spark = docs.sparkSession
    cache = cache or scratch_path(spark, "token-cache")
    version = tokenizer_digest(tokenizer_path)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    small = materialise(keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "token-keys")
    asked = materialise(small.groupBy("digest").agg(F.count("*").alias("rows")), "token-digests")
    stored = read_cache(spark, cache, version)
    if stored is None:
        counts = asked.select("digest", "rows", F.lit(None).cast("long").alias("n_tokens"))
    else:
        buckets = [r["b"] for r in asked.select(_bucket(F.col("digest")).alias("b")).distinct().collect()]  # BUCKETS at most
        own = stored.where(F.col("bucket").isin(buckets)).join(asked.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
        counts = materialise(asked.join(own, "digest", "left"), "token-hits")
    missing = counts.where("n_tokens is null").select("digest", "rows")
    known = counts.where("n_tokens is not null").select("digest", "n_tokens")
    if missing.limit(1).count():
        fresh = _encoded(keyed.select("digest", "text"), missing, tokenizer_path)
        # a digest that shares a bit with a missing one may have been encoded in vain
        fresh = fresh.join(missing.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])
        fresh = materialise(fresh, "token-counts")
        filed = fresh.withColumn("bucket", _bucket(F.col("digest"))).repartition("bucket")
        filed.write.mode("append").partitionBy("bucket").option("compression", "zstd").parquet(f"{cache}/version={version}")
        known = known.unionByName(fresh)
    known = materialise(known.withColumnRenamed("digest", "__digest"), "token-known")
    return join_unique(small, known, "digest", "__digest").select("doc_id", "n_bytes", "n_tokens")


def count_in_batches(docs: DataFrame, tokenizer_path: str, batches: int = 2, cache: str | None = None) -> DataFrame:
    """count_tokens() of docs as they would come in batches (by a hash of the id, each row in one): later ones meet the counts stored by former ones."""
    cache = cache or scratch_path(docs.sparkSession, "token-cache")
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    parts = [count_tokens(docs.where(turn == k), tokenizer_path, cache) for k in range(batches)]
    return functools.reduce(DataFrame.unionByName, parts)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """count_in_batches() of the whole table `documents`: all rows, in two batches, the second meeting what the first stored; awkward rows as there."""
    found = count_in_batches(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
