"""Content-addressed token store (operator 6).

Texts become token ids; a rolling hash over the ids cuts each document's
stream into chunks, so equal passages give equal chunks wherever they stand; a
chunk is named by the SHA-256 of its bytes and stored once.  A store is a
folder of Parquet tables:

``chunks``    digest, n_ids, ids (little-endian, two bytes an id while the
              vocabulary allows it, else four); one row for each distinct
              chunk, dealt over files by digest.
``recipes``   doc_id, n_tokens and the digests of the document's chunks in
              order; files are range-partitioned, and rows sorted, by doc_id.
              Rows are numbered (``seq``) in their ``part``, ``GROUP`` of them
              to a ``bunch``.
``manifest``  one row for each bunch: its first id position, counts, bytes an
              id, and the Merkle root over its documents; a document's leaf is
              the hash of its chunk digests.  Bunches do not depend on how
              files are split when they are read.

Defined results: a null or empty text has just the end id.  A null doc_id
sorts first.  Repeated doc_ids keep a recipe each, in order of their lengths
and a hash of their digests; their ids still stand side by side.  An empty table gives empty tables.  Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrail.llm.common import Scratch, materialize, remove

_WINDOW, GROUP = 8, 4_096
_TOKENIZED = "doc_id long, n_tokens long, chunks array<struct<digest: binary, n_ids: int, ids: binary>>"


def chunk_ends(ids: np.ndarray, ends: np.ndarray, mean: int, longest: int) -> list[int]:
    """Where to cut documents laid end to end in ``ids``, each ending at one of ``ends``.

    After each id at which the rolling hash over the last ``_WINDOW`` ids of
    its document is among the lowest of ``mean``, at ``longest`` ids at most, and at the
    documents' ends.
    """
    rolled = (ids + np.uint32(1)) * np.uint32(0x9E3779B1)
    for width, factor in ((1, 0x85EBCA6B), (2, 0xC2B2AE35), (4, 0x27D4EB2F)):  # up to ``_WINDOW`` ids
        older = rolled[:-width] * np.uint32(factor)
        rolled[width:] = rolled[width:] * np.uint32(0x2C1B3C6D) + older
    trigger = np.flatnonzero(rolled < np.uint32((1 << 32) // mean)) + 1
    # A document's first ids have no whole window of their own.
    starts = np.concatenate([[0], ends])
    trigger = trigger[trigger - starts[np.searchsorted(starts, trigger - 1, side="right") - 1] >= _WINDOW]
    out, last = [], 0
    for cut in np.union1d(trigger, ends).tolist():
        while cut - last > longest:
            last += longest
            out.append(last)
        if cut > last:
            out.append(cut)
            last = cut
    return out


def tokenize_chunks(docs: DataFrame, tokenizer_path: str, end_id: int, width: int, mean_chunk: int, longest_chunk: int) -> DataFrame:
    """doc_id, n_tokens and the document's chunks in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from veritrail.llm.tokens import encoder

        enc = encoder(tokenizer_path)
        kind, tail = f"<u{width}", np.array([end_id], dtype="<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 2_500):
                batch = whole.slice(at, 2_500)
                raw = enc.encode(batch.column(1).to_pylist())
                ends = np.cumsum([len(one) // 4 + 1 for one in raw])
                ids = np.frombuffer(b"".join([x for one in raw for x in (one, tail)]), dtype="<u4")
                cuts = np.array([0, *chunk_ends(ids, ends, mean_chunk, longest_chunk)])
                small = ids.astype(kind).tobytes()
                bounds = (cuts * width).tolist()
                data = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * width).astype("<i4").tobytes()), pa.py_buffer(small)])
                digests = pa.array([hashlib.sha256(small[a:b]).digest() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())
                inner = pa.StructArray.from_arrays([digests, pa.array(np.diff(cuts).astype("<i4")), data], names=["digest", "n_ids", "ids"])
                offsets = np.concatenate([[0], np.searchsorted(cuts, ends)]).astype("<i4")
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.diff(ends, prepend=0).astype("<i8")), pa.ListArray.from_arrays(pa.array(offsets), inner)], names=["doc_id", "n_tokens", "chunks"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _TOKENIZED)


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root over leaf hashes; an odd node rises unpaired; no leaves give the hash of nothing."""
    level = leaves or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _leaf(n_tokens: int, digests: list[bytes]) -> bytes:
    return hashlib.sha256(b"\x00" + n_tokens.to_bytes(8, "little") + b"".join(digests)).digest()


def _bunch_roots(recipes: DataFrame) -> DataFrame:
    """part, bunch, n_docs, n_tokens, root: the Merkle root over each bunch's documents, ``GROUP`` hashes at most."""

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_leaf(n, digests) for n, digests in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.binary())], names=["part", "bunch", "seq", "n_tokens", "leaf"])

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [merkle_root(x) for x in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.binary())], names=["part", "bunch", "n_docs", "n_tokens", "root"])

    own = recipes.select("part", "bunch", "seq", "n_tokens", "digests").mapInArrow(leaves, "part long, bunch long, seq long, n_tokens long, leaf binary")
    lists = own.groupBy("part", "bunch").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("seq", "leaf"))).alias("l"))
    return lists.select("part", "bunch", "n_docs", "n_tokens", F.col("l.leaf").alias("leaves")).mapInArrow(roots, "part long, bunch long, n_docs long, n_tokens long, root binary")


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, mean_chunk: int = 256, longest_chunk: int = 2_048, parts: int | None = None) -> None:
    """Tokenize ``docs`` (doc_id, text) and write a store at ``path``, which every executor must reach.

    The token stream is dealt once, by chunk digest; recipes carry digests only.
    """
    from veritrail.llm.tokens import vocabulary_size

    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = 2 if max(vocabulary_size(tokenizer_path), end_id + 1) <= 65_536 else 4
    tokenized = tokenize_chunks(docs, tokenizer_path, end_id, width, mean_chunk, longest_chunk)
    # The tokenizer runs once: its output is written as it comes, chunks beside recipes, until both are dealt.
    tokenized.write.option("compression", "zstd").parquet(f"{path}/stream")
    stream = spark.read.schema(_TOKENIZED).parquet(f"{path}/stream")
    chunk = stream.select(F.explode("chunks").alias("c")).select("c.*")
    chunk.groupBy("digest").agg(F.first("n_ids").alias("n_ids"), F.first("ids").alias("ids")).write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipe = stream.select("doc_id", "n_tokens", F.col("chunks.digest").alias("digests")).withColumn("tie", F.xxhash64("digests"))
    order = ["doc_id", "n_tokens", "tie"]
    by_doc = recipe.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
    # The id counts a partition's rows in its lower 33 bits.
    seq = F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    by_doc.select("doc_id", "n_tokens", "digests", F.shiftrightunsigned("row", 33).alias("part"), seq.alias("seq"), F.floor(seq / GROUP).alias("bunch")).write.option("compression", "zstd").parquet(f"{path}/recipes")
    remove(spark, f"{path}/stream")
    roots = _bunch_roots(spark.read.parquet(f"{path}/recipes"))
    before = Window.partitionBy("part").orderBy("bunch").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    roots = roots.withColumn("run", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    with Scratch(spark) as scratch:
        roots = scratch.keep(roots, "bunches")
        bases = roots.groupBy(F.col("part").alias("p")).agg(F.sum("n_tokens").alias("n")).select("p", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
        manifest = roots.join(bases, F.col("part") == F.col("p")).select("part", "bunch", "n_docs", "n_tokens", "root", (F.col("base") + F.col("run")).alias("start"), F.lit(width).alias("width"))
        manifest.write.parquet(f"{path}/manifest")


def _width(spark: SparkSession, path: str) -> int:
    """Bytes an id, from the manifest; that of an empty store doesn't matter."""
    row = spark.read.parquet(f"{path}/manifest").select("width").first()
    return row["width"] if row else 4


class CrcJoiner:
    """CRC-32 of byte strings laid end to end, from their CRCs and lengths.

    Appending zero bytes is linear over a CRC's bits, so it is four look-ups,
    a byte each, for every power of two of ids (four bytes) appended.
    """

    def __init__(self) -> None:
        bits = np.array([0xEDB88320, *[1 << i for i in range(31)]], dtype=np.uint32)
        for _ in range(5):  # 1 bit, then twice as many: up to 32 bits, one id
            bits = self._apply(self._table(bits), bits)
        self.tables = []
        for _ in range(40):
            self.tables.append(self._table(bits))
            bits = self._apply(self.tables[-1], bits)

    @staticmethod
    def _table(bits: np.ndarray) -> np.ndarray:
        table = np.zeros((4, 256), dtype=np.uint32)
        for byte in range(4):
            for i in range(8):
                table[byte, 1 << i : 2 << i] = table[byte, : 1 << i] ^ bits[8 * byte + i]
        return table

    @staticmethod
    def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]

    def join(self, crcs: np.ndarray, n_ids: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
        """CRC of each owner's parts in order; parts of one owner stand together."""
        crcs = crcs.astype(np.uint32)
        total = np.concatenate([[0], np.cumsum(n_ids)])
        first = np.searchsorted(owner, np.arange(owners))
        last = np.searchsorted(owner, np.arange(owners), side="right")
        after = np.repeat(total[last], last - first) - total[1:]  # ids behind each part
        for k, table in enumerate(self.tables):
            if not (after >> k).any():
                break
            crcs = np.where((after >> k) & 1 == 1, self._apply(table, crcs), crcs)
        out = np.zeros(owners, dtype=np.uint32)
        np.bitwise_xor.at(out, owner, crcs)
        return out


def _chunk_sums(chunks: DataFrame, width: int) -> DataFrame:
    """digest, n_ids, crc of each stored chunk, whose bytes must hash to its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            sums, sizes = [], []
            for digest, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if hashlib.sha256(ids).digest() != digest:
                    raise ValueError(f"token store: chunk {digest.hex()} does not hash to its name")
                whole = np.frombuffer(ids, dtype=f"<u{width}").astype("<u4")
                sums.append(zlib.crc32(whole.tobytes()))
                sizes.append(len(whole))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], names=["digest", "n_ids", "crc"])

    return chunks.select("digest", "ids").mapInArrow(run, "digest binary, n_ids long, crc long")


def verify_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a bunch: whether its recipes still hash to the manifest's Merkle root, with both counts."""
    keys = ["part", "bunch"]
    now = _bunch_roots(spark.read.parquet(f"{path}/recipes")).select(*keys, F.col("root").alias("now_root"), F.col("n_docs").alias("now_docs"), F.col("n_tokens").alias("now_tokens"))
    kept = spark.read.parquet(f"{path}/manifest")
    return kept.join(now, keys, "full_outer").select(*keys, "n_docs", "n_tokens", "start", (F.col("root").eqNullSafe(F.col("now_root")) & F.col("n_docs").eqNullSafe(F.col("now_docs")) & F.col("n_tokens").eqNullSafe(F.col("now_tokens"))).alias("intact"))


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, digests of every document, from the files; a bunch that fails its Merkle root raises."""
    recipes = spark.read.parquet(f"{path}/recipes")
    bunches = verify_manifest(spark, path).select("part", "bunch", F.when(F.col("intact"), F.col("start")).otherwise(F.raise_error(F.lit("token store: a bunch of recipes fails its Merkle root"))).alias("base"))
    before = Window.partitionBy("part", "bunch").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return recipes.withColumn("run", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).join(bunches.hint("merge"), ["part", "bunch"]).select("doc_id", (F.col("base") + F.col("run")).alias("start"), "n_tokens", "digests")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (array of int): every document rebuilt from its chunks."""
    width = _width(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(parts), dtype=f"<u{width}").astype("<i4") for parts in batch.column(2).to_pylist()]
            offsets = np.cumsum([0, *map(len, ids)]).astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, "<i4")])))], names=["doc_id", "start", "ids"])

    recipes = read_recipes(spark, path).select("doc_id", "start", F.posexplode("digests").alias("pos", "digest"))
    joined = recipes.join(spark.read.parquet(f"{path}/chunks"), "digest", "left")
    parts = joined.groupBy("doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("p"))
    return parts.select("doc_id", "start", F.col("p.ids").alias("parts")).mapInArrow(run, "doc_id long, start long, ids array<int>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_chunks of every document, from the files.

    Each stored chunk is read, checked against its name and summed where it
    lies; only sums meet the recipes, and a document's CRC is joined from its
    chunks' CRCs in order.
    """
    width = _width(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner = CrcJoiner()
        for batch in batches:
            lists = batch.column(3)
            flat, sizes = lists.flatten(), np.array([len(p) for p in lists])
            if flat.field("crc").null_count:
                raise ValueError("token store: a recipe names a chunk that is not stored")
            owner = np.repeat(np.arange(len(sizes)), sizes)
            n_ids = flat.field("n_ids").to_numpy(zero_copy_only=False)
            crcs = joiner.join(flat.field("crc").to_numpy(zero_copy_only=False), n_ids, owner, len(sizes)).astype(np.int64)
            totals = np.bincount(owner, weights=n_ids, minlength=len(sizes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(totals), pa.array(crcs), pa.array(sizes.astype(np.int32))], names=["doc_id", "start", "n_tokens", "ids_crc32", "n_chunks"])

    recipes = read_recipes(spark, path).select("doc_id", "start", "n_tokens", F.posexplode("digests").alias("pos", "digest"))
    joined = recipes.join(_chunk_sums(spark.read.parquet(f"{path}/chunks"), width), "digest", "left")
    parts = joined.groupBy("doc_id", "start", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("pos", "n_ids", "crc"))).alias("p"))
    return parts.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, n_chunks int")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through a store and back: doc_id, start, n_tokens, ids_crc32, n_chunks."""
    import public_tokenizers

    with Scratch(spark) as scratch:
        path = scratch.path("token-store")
        write_store(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path, public_tokenizers.path("byte_bpe_50k.json"))
        return materialize(read_digests(spark, path), "token-digests")
