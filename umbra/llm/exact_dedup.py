"""Exact dedup over a cuckoo-filter index of content digests.

The index is sharded by digest. A shard is a :class:`CuckooIndex`: a table of
16-bit fingerprints, four to a bucket, and beside it the bucketed content (the
whole SHA-256 digest and the byte length of the text, with the group's state).
A fingerprint hit counts only when the content of that slot is the same; a
chain of evictions that runs too long resizes the table from its stored keys.
Live digests can be inserted and deleted.

Two levels build it: every input partition folds its rows into an index of its
own (so that a group of copies leaves one row per partition, however large it
is), and the shards merge those rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import discard, lower_az, materialise, whole_ids, with_row_id, without_ids

SLOTS = 4
MAX_KICKS = 200
#: Live keys of a partition's own index before it hands them on and starts anew.
FLUSH_AT = 200_000
#: Rows for each shard of the index, at most as many keys: some 400 bytes of a worker's memory a key.
ROWS_PER_SHARD = 250_000

_ENTRY = "digest binary, n_bytes long, keep_id long, keep_uid long, n long"


class CuckooIndex:
    """Cuckoo filter over digests with the content it vouches for kept by slot.

    ``put`` inserts a digest or folds into the live entry, ``drop`` takes
    members away and deletes the digest when none is left, ``find`` verifies.
    """

    def __init__(self, buckets: int = 256):
        self._clear(buckets)
        self.live = 0
        self.resizes = 0

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = [0] * (buckets * SLOTS)
        self.content: list = [None] * (buckets * SLOTS)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "big") or 1
        first = int.from_bytes(digest[2:10], "big") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & self.mask)

    def find(self, digest: bytes, n_bytes: int) -> int:
        """Slot of the live digest, or -1. A fingerprint hit is verified against the slot's content."""
        mark, first, second = self._places(digest)
        prints, content = self.prints, self.content
        for base in (first * SLOTS, second * SLOTS):
            for slot in range(base, base + SLOTS):
                if prints[slot] == mark and content[slot][0] == digest and content[slot][1] == n_bytes:
                    return slot
        return -1

    def put(self, digest: bytes, n_bytes: int, keep: tuple, n: int) -> None:
        slot = self.find(digest, n_bytes)
        if slot < 0:
            self._insert([digest, n_bytes, keep, n])
            self.live += 1
            return
        entry = self.content[slot]
        entry[2] = max(entry[2], keep)
        entry[3] += n

    def drop(self, digest: bytes, n_bytes: int, n: int = 1) -> bool:
        """Delete ``n`` members of a live digest; False if it isn't live."""
        slot = self.find(digest, n_bytes)
        if slot < 0:
            return False
        self.content[slot][3] -= n
        if self.content[slot][3] <= 0:
            self.prints[slot], self.content[slot] = 0, None
            self.live -= 1
        return True

    def _insert(self, entry: list) -> None:
        mark, first, second = self._places(entry[0])
        if self._take_free(first, mark, entry) or self._take_free(second, mark, entry):
            return
        bucket = second
        for turn in range(MAX_KICKS):
            slot = bucket * SLOTS + (turn + mark) % SLOTS
            mark, self.prints[slot] = self.prints[slot], mark
            entry, self.content[slot] = self.content[slot], entry
            bucket = self._other(bucket, mark)
            if self._take_free(bucket, mark, entry):
                return
        self._resize(entry)

    def _take_free(self, bucket: int, mark: int, entry: list) -> bool:
        for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.prints[slot]:
                self.prints[slot], self.content[slot] = mark, entry
                return True
        return False

    def _resize(self, homeless: list) -> None:
        stored = [x for x in self.content if x is not None]
        self.resizes += 1
        self._clear(2 * (self.mask + 1))
        for entry in [*stored, homeless]:
            self._insert(entry)

    def entries(self) -> Iterator[list]:
        return (x for x in self.content if x is not None)


#: keep = (has an id, id, -uid): the largest doc_id wins, null last, then the first row.
def _keep(doc_id, uid) -> tuple:
    return (doc_id is not None, doc_id or 0, -uid)


def _batch(entries) -> pa.RecordBatch:
    rows = list(entries)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([x[0] for x in rows], pa.binary()),
            pa.array([x[1] for x in rows], pa.int64()),
            pa.array([x[2][1] if x[2][0] else None for x in rows], pa.int64()),
            pa.array([-x[2][2] for x in rows], pa.int64()),
            pa.array([x[3] for x in rows], pa.int64()),
        ],
        names=["digest", "n_bytes", "keep_id", "keep_uid", "n"],
    )


def _pieces(index: CuckooIndex, step: int = 20_000) -> Iterator[pa.RecordBatch]:
    part: list = []
    for entry in index.entries():
        part.append(entry)
        if len(part) == step:
            yield _batch(part)
            part = []
    if part:
        yield _batch(part)


#: More than any group has.
ALL = 1 << 60


def _fold(flush_at: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for digest, n_bytes, doc_id, uid, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n < 0:
                    index.drop(digest, n_bytes, -n)
                else:
                    index.put(digest, n_bytes, _keep(doc_id, uid), n)
            if flush_at and index.live >= flush_at:
                yield from _pieces(index)
                index = CuckooIndex()
        yield from _pieces(index)

    return run


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, doc_id, digest, n_bytes), written once so that uid names a row for good.

    The digest is SHA-256 of the text in UTF-8 with A-Z lower-cased; null counts as empty.
    """
    text = lower_az(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), whole_ids(docs, id_col).alias("doc_id"), text.alias("t"))
    return materialise(rows.select("uid", "doc_id", F.unhex(F.sha2("t", 256)).alias("digest"), F.octet_length("t").cast("long").alias("n_bytes")), "digests")


def _shards(*tables: DataFrame) -> int:
    least = int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(sum(t.count() for t in tables) / ROWS_PER_SHARD))


def _single(rows: DataFrame) -> DataFrame:
    return rows.select("digest", "n_bytes", F.col("doc_id").alias("keep_id"), F.col("uid").alias("keep_uid"), F.lit(1).cast("long").alias("n"))


def build_index(rows: DataFrame) -> DataFrame:
    """Index of all live digests of ``rows`` (as of :func:`digests`): one row each with the row that stays and the group's size.

    Repeated rows count each; an empty table gives an empty index.
    """
    return _single(rows).mapInArrow(_fold(FLUSH_AT), _ENTRY).repartition(_shards(rows), "digest").mapInArrow(_fold(None), _ENTRY)


def update_index(index: DataFrame, content: DataFrame, inserts: DataFrame | None = None, deletes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(index, content) after rows are inserted and then rows deleted.

    ``content`` holds the live rows that ``index`` was built from, as of
    :func:`digests`, as do ``inserts``; inserted rows get new uids. ``deletes``
    (doc_id, digest, n_bytes) takes every live row of that id and text away,
    repeated ones and null ids too. Deletion takes the digest out of the
    filter; it goes in again, with the row that stays and the size counted
    from the content, if copies are still alive. Deleting what isn't live
    changes nothing; empty tables are fine on either side.
    """
    live = content.select("uid", "doc_id", "digest", "n_bytes")
    turns = [index.select("digest", "n_bytes", "keep_id", "keep_uid", "n", F.lit(0).alias("turn"))]
    if inserts is not None:
        above = (live.agg(F.max("uid")).first()[0] or 0) + 1
        new = inserts.select((F.col("uid") + above).alias("uid"), "doc_id", "digest", "n_bytes")
        turns.append(_single(new).mapInArrow(_fold(FLUSH_AT), _ENTRY).withColumn("turn", F.lit(1)))
        live = live.unionByName(new)
    if deletes is not None:
        gone = deletes.select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone"), F.col("n_bytes").alias("gone_bytes")).distinct()
        live = live.join(gone, (live["digest"] == gone["gone"]) & (live["n_bytes"] == gone["gone_bytes"]) & live["doc_id"].eqNullSafe(gone["gone_id"]), "left_anti")
        touched = gone.select(F.col("gone").alias("digest"), F.col("gone_bytes").alias("n_bytes")).distinct()
        turns.append(touched.select("digest", "n_bytes", F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("keep_uid"), F.lit(-ALL).cast("long").alias("n"), F.lit(2).alias("turn")))
        left = live.join(touched, ["digest", "n_bytes"], "left_semi")
        turns.append(_single(left).mapInArrow(_fold(FLUSH_AT), _ENTRY).withColumn("turn", F.lit(3)))
    every = turns[0]
    for turn in turns[1:]:
        every = every.unionByName(turn)
    # Turns keep their order for each digest.
    dealt = every.repartition(_shards(index, *([inserts] if inserts is not None else [])), "digest").sortWithinPartitions("digest", "turn")
    return dealt.drop("turn").mapInArrow(_fold(None), _ENTRY), live


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts (A-Z lower-cased, null as empty) the row with the largest id
    stays; null ids come last; of repeated rows with that id just one stays.
    An empty table gives no rows. Other columns of ``docs`` are not read; texts
    of any length are digested whole.

    The join that hands the group's state back to its members is a sort-merge
    join on the digest, whose hot side adaptive execution splits.
    """
    rows = digests(docs, id_col, text_col)
    return _decide(rows).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _decide(rows: DataFrame) -> DataFrame:
    groups = build_index(rows).select("digest", "keep_id", "keep_uid", F.col("n").alias("group_size"))
    return rows.join(groups, "digest").select(
        "uid", "doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the copies that :func:`exact_dedup` drops, columns unchanged.

    Null and empty texts are equal; null ids go before others; one of repeated
    rows stays; any columns of other names and an empty table are fine. Texts of
    any length are digested whole.
    """
    held, uid = with_row_id(docs, id_col)
    text = lower_az(F.coalesce(F.col(text_col), F.lit("")))
    rows = held.select(F.col(uid).alias("uid"), whole_ids(docs, id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    rows = materialise(rows, "digests")
    gone = rows.select(F.col("uid").alias(uid)).join(build_index(rows).select(F.col("keep_uid").alias(uid)), uid, "left_anti")
    gone = materialise(gone, "gone")
    discard(rows)
    return without_ids(held, uid, gone).select(*docs.columns)
