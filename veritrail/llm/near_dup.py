"""Near-duplicate documents by b-bit MinHash and a multi-index Hamming join (operator 4).

A document's set is that of its distinct 5-word shingles.  Its signature has
``SYMBOLS`` symbols of 16 bits, each the hash of a minimum; two signatures'
distance is the number of differing symbols.  Signatures are cut into chunks;
by the pigeonhole principle, two within the distance allowed (see
``distance_for``; ``DISTANCE`` at 85 percent) agree on some chunk up to one symbol, so each chunk is indexed once with each symbol left
out, and all pairs within the distance share a key.  Documents that share keys
form families; inside a family, pairs within the distance are confirmed on the
full sets.

Equal sets are one class from the start.  No list of pairs is ever held: a task
keeps at most ``BLOCK`` sets, meets the other rows one by one, and returns
links that join documents.  In a family larger than ``BLOCK`` all members first
meet ``LEADERS`` of their own, those that share the most keys, so a family of
alike texts costs its size and not its square; then the members that this
did not join to the family's largest group meet all members, block by block.

Defined results: documents with no word have an empty set, n_shingles 0 and no
link.  A null doc_id has null component_id, is not kept and links nothing.
Rows that share a doc_id are one
vertex, so they are kept together or not.  Repeated rows are all returned.  An
empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm.common import Scratch, materialize
from veritrail.llm.components import components

SHINGLE = 5
SYMBOLS = 64
#: The share of pairs exactly at the threshold that may be farther apart than the distance allows.
MISSED = 1e-4
BLOCK, LEADERS = 256, 16
_U = np.uint64


def distance_for(percent: int) -> int:
    """The least distance that leaves out at most ``MISSED`` of the pairs at ``percent`` similarity, and fewer above."""
    from math import comb

    alike = percent / 100
    beyond = 1.0
    for d in range(SYMBOLS):
        beyond -= comb(SYMBOLS, d) * (1 - alike) ** d * alike ** (SYMBOLS - d)
        if beyond <= MISSED:
            return d
    return SYMBOLS


def cuts_for(distance: int) -> list[int]:
    """Edges of the chunks that may each hide one error: more than half the distance."""
    chunks = distance // 2 + 1
    return [round(i * SYMBOLS / chunks) for i in range(chunks + 1)]


DISTANCE = distance_for(85)
_CUTS = cuts_for(DISTANCE)
_SIGNED = "doc_id long, n_shingles long, h1 long, h2 long, sig binary, text_key long"
_MEMBERS = "family long, size long, doc_id long, degree long, sig binary, shingles binary"


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _WordHashes(dict):
    """64-bit hashes of words; emptied when it holds 200,000."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, memo: dict) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes: words are runs of bytes other than ASCII white space, A-Z in lower case."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(memo.__getitem__, found), dtype=np.uint64, count=len(found))
    width = min(SHINGLE, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - width + 1, _U(width))
        for k in range(width):
            out = _mix(out * _U(0x9E3779B97F4A7C15) + h[k : k + len(out)])
    return np.unique(out)


def signature(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """``SYMBOLS`` 16-bit symbols of a non-empty set."""
    low = np.full(len(seeds), 0xFFFFFFFF, dtype=np.uint32)
    x = (shingles >> _U(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), 4_096):
            y = x[None, at : at + 4_096] ^ seeds[:, None]
            y *= np.uint32(0x85EBCA6B)
            y ^= y >> np.uint32(13)
            y *= np.uint32(0xC2B2AE35)
            y ^= y >> np.uint32(16)
            np.minimum(low, y.min(axis=1), out=low)
        low = low * np.uint32(0x9E3779B1)
    return (low >> np.uint32(16)).astype("<u2")


def _seeds() -> np.ndarray:
    return (_mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) & _U(0xFFFFFFFF)).astype(np.uint32)


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash of the set, the signature, and text_key, a hash of the text as it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        memo, seeds = _WordHashes(), _seeds()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sizes, hashes, sigs = [], [], []
                for text in batch.column(1).to_pylist():
                    s = shingle_set(text, memo)
                    sizes.append(len(s))
                    hashes.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sigs.append(signature(s, seeds).tobytes() if len(s) else b"")
                h1, h2 = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(h1), pa.array(h2), pa.array(sigs, pa.binary()), batch.column(2)], names=["doc_id", "n_shingles", "h1", "h2", "sig", "text_key"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key")).mapInArrow(run, _SIGNED)


def member_sets(members: DataFrame) -> DataFrame:
    """Rows (family, size, doc_id, degree, text) with the signature and the set, as sorted 48-bit numbers (little-endian), for the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seeds = _WordHashes(), _seeds()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [shingle_set(text, memo) for text in part.column(4).to_pylist()]
                sigs = [signature(s, seeds).tobytes() for s in found]
                sets = [np.ascontiguousarray((s >> _U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes() for s in found]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(sigs, pa.binary()), pa.array(sets, pa.binary())], names=["family", "size", "doc_id", "degree", "sig", "shingles"])

    return members.select("family", "size", "doc_id", "degree", "text").mapInArrow(run, _MEMBERS)


def chunk_keys(signed: DataFrame, distance: int) -> DataFrame:
    """(key, doc_id): each chunk of the signature with each of its symbols left out in turn."""
    cuts = cuts_for(distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _mix(np.arange(SYMBOLS, dtype=np.uint64) + _U(7))
        for batch in batches:
            for at in range(0, batch.num_rows, 2_048):
                part = batch.slice(at, 2_048)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype="<u2").reshape(-1, SYMBOLS)
                with np.errstate(over="ignore"):
                    each = _mix(sig.astype(np.uint64) * _U(0x100000001B3) + place)
                    keys = np.empty_like(each)
                    for a, b in zip(cuts, cuts[1:], strict=False):
                        keys[:, a:b] = each[:, a:b].sum(axis=1, dtype=np.uint64)[:, None] - each[:, a:b]
                    keys = _mix(keys + place)
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), SYMBOLS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids, pa.int64())], names=["key", "doc_id"])

    return signed.select("doc_id", "sig").mapInArrow(run, "key long, doc_id long")


def _decode(raw: bytes) -> np.ndarray:
    six = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return np.ascontiguousarray(np.pad(six, ((0, 0), (0, 2)))).view("<u8").ravel()


class _Group:
    """The held rows of one group, and which of them are joined so far."""

    def __init__(self, percent: int, distance: int):
        self.percent, self.distance = percent, distance
        self.ids: list[int] = []
        self.sigs = np.zeros((BLOCK, SYMBOLS), dtype="<u2")
        self.sets: list[bytes | np.ndarray] = []
        self.parent: list[int] = []
        self.alone = True

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def hold(self, doc_id: int, sig: bytes, shingles: bytes) -> None:
        if len(self.ids) == len(self.sigs):
            self.sigs = np.concatenate([self.sigs, np.zeros_like(self.sigs)])
        self.sigs[len(self.ids)] = np.frombuffer(sig, dtype="<u2")
        self.parent.append(len(self.ids))
        self.ids.append(doc_id)
        self.sets.append(shingles)

    def _set(self, x: int) -> np.ndarray:
        if isinstance(self.sets[x], bytes):
            self.sets[x] = _decode(self.sets[x])
        return self.sets[x]

    def meet(self, doc_id: int, sig: bytes, shingles: bytes | np.ndarray, among: int) -> tuple[list[tuple[int, int]], int]:
        """Confirmed links of a row with the first ``among`` held rows, one for each group of them; those become one group, whose root is returned (-1: none)."""
        away = (self.sigs[:among] != np.frombuffer(sig, dtype="<u2")).sum(axis=1)
        near = np.flatnonzero(away <= self.distance)
        links: list[tuple[int, int]] = []
        own, joined = None, -1
        for x in near[np.argsort(away[near], kind="stable")].tolist():
            top = self.root(x)
            if top == joined:
                continue
            if self.ids[x] != doc_id:
                if own is None:
                    own = _decode(shingles) if isinstance(shingles, bytes) else shingles
                other = self._set(x)
                if 100 * min(len(own), len(other)) < self.percent * max(len(own), len(other)):
                    continue
                shared = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * shared < self.percent * (len(own) + len(other) - shared):
                    continue
                links.append((self.ids[x], doc_id))
            if joined >= 0:
                self.parent[top] = joined
            else:
                joined = top
        return links, joined

    def among_held(self) -> list[tuple[int, int]]:
        """Links among the held rows, of a group that nothing else meets."""
        links = []
        for y in range(1, len(self.ids)):
            found, joined = self.meet(self.ids[y], self.sigs[y].tobytes(), self._set(y), y)
            links += found
            if joined >= 0:
                self.parent[y] = joined
        return links


def compare(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) links from rows (family, lo, hi, meets, doc_id, sig, shingles): in each (family, lo, hi), rows that meet the others, or the others one another where none does."""
    distance = distance_for(percent)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["family", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, group, links = None, _Group(percent, distance), []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for *key, meets, doc_id, sig, shingles in zip(*[c.to_pylist() for c in batch.slice(at, 256).columns], strict=True):
                    if key != last:
                        if group.alone:
                            links += group.among_held()
                        last, group = key, _Group(percent, distance)
                    if meets:
                        group.alone = False
                        links += group.meet(doc_id, sig, shingles, len(group.ids))[0]
                    else:
                        group.hold(doc_id, sig, shingles)
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])
                    links = []
        if group.alone:
            links += group.among_held()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    dealt = rows.select(*keys, "meets", "doc_id", "sig", "shingles").repartition(parts, *keys).sortWithinPartitions(*keys, "meets", "doc_id")
    return dealt.mapInArrow(run, "a long, b long")


def _with_leaders(members: DataFrame) -> DataFrame:
    """Rows for ``compare`` that let all members of large families meet their leaders, ``BLOCK`` members to a group."""
    large = members.where(F.col("size") > BLOCK).withColumn("groups", F.ceil(F.col("size") / F.lit(BLOCK)).cast("int"))
    # The member of most shared keys in each of LEADERS shares of the family: spread over it, the best connected among them.
    share = F.pmod(F.xxhash64(F.lit("leader"), "doc_id"), F.lit(LEADERS)).alias("share")
    chosen = large.groupBy("family", share).agg(F.max(F.struct("degree", "doc_id")).alias("top")).select("family", F.col("top.doc_id").alias("doc_id")).distinct()
    leaders = large.join(chosen.hint("merge"), ["family", "doc_id"], "left_semi").withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).withColumn("meets", F.lit(False))
    others = large.withColumn("lo", F.pmod(F.xxhash64("doc_id"), F.col("groups")).cast("int")).withColumn("meets", F.lit(True))
    return leaders.unionByName(others).withColumn("hi", F.lit(-1))


def _by_blocks(members: DataFrame, joined: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows for ``compare``: members outside their family's largest group so far meet all members of the family.

    Small families have no group yet, so all their members meet.
    """
    label = members.select("family", "size", "doc_id").join(joined.hint("merge"), F.col("doc_id") == F.col("node"), "left").select("family", "doc_id", F.when(F.col("size") > BLOCK, F.coalesce("component", "doc_id")).alias("label"))
    label = scratch.keep(label, "labels")
    sizes = label.groupBy("family", "label").count()
    whole = sizes.groupBy("family").agg(F.max(F.when(F.col("label").isNotNull(), F.struct("count", "label"))).alias("top"), F.sum("count").alias("all"))
    in_core = F.coalesce(F.col("top.count"), F.lit(0))
    whole = whole.select("family", F.col("top.label").alias("core"), F.ceil((F.col("all") - in_core) / BLOCK).cast("int").alias("open_blocks"), F.ceil(in_core / BLOCK).cast("int").alias("core_blocks")).where("open_blocks > 0")
    whole = scratch.keep(whole, "family-sizes")
    state = label.join(whole.hint("merge"), "family").withColumn("open", ~F.coalesce(F.col("label") == F.col("core"), F.lit(False)))
    spread = F.xxhash64("doc_id")
    block = F.when(F.col("open"), F.pmod(spread, "open_blocks")).otherwise(F.col("open_blocks") + F.pmod(spread, F.greatest("core_blocks", F.lit(1)))).cast("int")
    others = F.when(F.col("open"), F.col("open_blocks") + F.col("core_blocks")).otherwise(F.col("open_blocks"))
    placed = state.select("family", "doc_id", block.alias("block"), others.alias("others")).distinct()
    rows = members.join(placed.hint("merge"), ["family", "doc_id"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    return rows.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).withColumn("meets", F.col("block") > F.col("other"))


def near_duplicates(docs: DataFrame, percent: int = 85, text_key: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text); with ``text_key`` also the text's 64-bit hash."""
    with Scratch(docs.sparkSession, batch=1_000) as scratch:
        signed = scratch.keep(sign(docs), "signed")
        linkable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
        # What grows with the corpus meets in merge joins at every size, and is never broadcast while it is still small.
        classes = scratch.keep(signed.where(linkable).groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
        heads = signed.where(linkable).join(classes.hint("merge"), ["h1", "h2"]).where(F.col("doc_id") == F.col("rep"))
        keys = chunk_keys(heads.select("doc_id", "sig"), distance_for(percent))
        shared = keys.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).where(F.col("lo") < F.col("hi")).select("key", "lo", "n")
        shared = scratch.keep(shared, "shared-keys")
        touching = scratch.keep(keys.join(shared.hint("merge"), "key").select(F.col("doc_id").alias("a"), F.col("lo").alias("b"), "n"), "touching")
        family = scratch.keep(components(touching.select("a", "b"), scratch), "families")
        # Written before it is joined, so that the join's sides are plain exchanges, whose hot families adaptive execution splits.
        sizes = scratch.keep(family.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "sizes")
        degrees = touching.groupBy("a").agg(F.sum("n").alias("degree"))
        placed = family.join(sizes.hint("merge"), "component").join(degrees.hint("merge"), F.col("node") == F.col("a")).select(F.col("node").alias("doc_id"), F.col("component").alias("family"), "size", "degree")
        # Only members of families are looked at again, so the sets are made anew for them and never written for all.
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
        members = scratch.keep(member_sets(texts.join(placed.hint("merge"), "doc_id").dropDuplicates(["doc_id", "text"])), "members")
        first = scratch.keep(compare(_with_leaders(members), percent), "links")
        rest = scratch.keep(compare(_by_blocks(members, components(first, scratch), scratch), percent), "links")
        joined = components(first.union(rest), scratch)
        by_class = classes.join(joined.hint("merge"), F.col("rep") == F.col("node"), "left").select("h1", "h2", F.coalesce("component", "rep").alias("found"))
        out = signed.select("doc_id", "n_shingles", "h1", "h2", "text_key").join(by_class.hint("merge"), ["h1", "h2"], "left")
        component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("found"))).otherwise(F.col("doc_id"))
        out = out.select("doc_id", "n_shingles", component.alias("component_id"), *(["text_key"] if text_key else []))
        return materialize(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))), "near-dup")


def op4_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document: doc_id, n_shingles, component_id, kept."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
