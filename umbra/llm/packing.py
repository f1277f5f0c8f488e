"""Variable-capacity best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import tasks_for, whole_ids

CAPACITIES = (2048, 4096, 8192, 16384)
#: Chunks packed together: a block's loss is a part of its last open bins, and memory holds one block.
BLOCK_CHUNKS = 20_000


def default_cost(capacity: int) -> float:
    """Cost of a sequence: linear work, attention's quadratic part, a fixed charge per sequence."""
    return capacity + capacity * capacity / 65_536 + 64


def best_fit(lengths: Sequence[int], capacities: Sequence[int], cost: Callable[[int], float]) -> tuple[list[int], list[int], float]:
    """Pack ``lengths`` (none over the largest capacity) in the given order.

    Each item goes to the open bin that it leaves the least room in; if none
    has room, a bin opens. This is done for every choice of the largest size
    allowed to open (larger items still open what they need), both with bins of
    that very size and with the size of the least cost per token up to it. At the
    end each bin shrinks to the least costly size that holds its contents, or is
    divided where the same passes find smaller bins that cost less in all. The
    choice with the least total cost wins, the first on ties.

    Returns the bin of each item (numbered as opened), the size of each bin and
    the total cost.
    """
    sizes = sorted(set(capacities))
    # The size that opens for items whose smallest fitting size is the one at the same place.
    passes = []
    for most in sizes:
        passes.append(tuple(min([x for x in sizes if s <= x <= most] or [s], key=lambda x: (cost(x) / x, x)) for s in sizes))
        passes.append(tuple(max(s, most) for s in sizes))
    passes = list(dict.fromkeys(passes))
    best: tuple[float, list[int], list[int]] | None = None
    for opens in passes:
        bins, opened = _divided(lengths, *_packed(lengths, sizes, opens, cost), sizes, passes, cost)
        total = math.fsum(map(cost, opened))
        if best is None or total < best[0]:
            best = total, bins, opened
    return best[1], best[2], best[0]


def _divided(lengths, of, opened, sizes, passes, cost):
    """The bins, those divided whose items cost less in smaller bins."""
    items: dict[int, list[int]] = {}
    for i, b in enumerate(of):
        items.setdefault(b, []).append(i)
    least = min(cost(s) / s for s in sizes)
    for b, own in items.items():
        mine, price, found = [lengths[i] for i in own], cost(opened[b]), None
        if len(own) == 1 or least * sum(mine) >= price:
            continue
        for opens in passes:
            if opens[0] < opened[b]:
                parts, smaller = _packed(mine, sizes, opens, cost)
                if (total := math.fsum(map(cost, smaller))) < price:
                    price, found = total, (parts, smaller)
        if found:
            parts, smaller = found
            for i, part in zip(own, parts, strict=True):
                of[i] = b if part == 0 else len(opened) + part - 1
            opened[b] = smaller[0]
            opened += smaller[1:]
    return of, opened


def _packed(lengths, sizes, opens, cost):
    of, used, room_of, free = [], [], [], {}
    mask = 0  # bit r: some open bin has r tokens of room
    for n in lengths:
        above = mask >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            mine = free[room]
            b = mine.pop()
            if not mine:
                mask ^= 1 << room
        else:
            room = opens[bisect_left(sizes, n)]
            b = len(used)
            used.append(0)
            room_of.append(room)
        of.append(b)
        used[b] += n
        left = room - n
        if left:
            free.setdefault(left, []).append(b)
            mask |= 1 << left
    shrunk = [min((s for s in sizes if s >= u), key=lambda s: (cost(s), s)) for u in used]
    return of, shrunk


_PACKED = "doc_id long, start long, length long, block long, part int, bin int, capacity int, at int"


def _pack(capacities, cost, block_chunks):
    largest = max(capacities)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part, rows = None, 0, []

        def close():
            of, sizes, _ = best_fit([r[2] for r in rows], capacities, cost)
            at, filled = [], [0] * len(sizes)
            for r, b in zip(rows, of, strict=True):
                at.append(filled[b])
                filled[b] += r[2]
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([shard] * n, pa.int64()), pa.array([part] * n, pa.int32())]
                + [pa.array(x, pa.int32()) for x in (of, [sizes[b] for b in of], at)],
                names=["doc_id", "start", "length", "block", "part", "bin", "capacity", "at"],
            )

        for batch in batches:
            for of_shard, doc_id, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and (of_shard != shard or len(rows) >= block_chunks):
                    yield from close()
                    part = part + 1 if of_shard == shard else 0
                    rows = []
                elif not rows:
                    part = 0
                shard = of_shard
                assert 0 < length <= largest
                rows.append((doc_id, start, length))
        if rows:
            yield from close()

    return run


def byte_tokens(text: Column) -> Column:
    """Length in byte-level tokens: UTF-8 bytes and one end mark."""
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 1


def pack_documents(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = default_cost, length: Column | None = None, id_col: str = "doc_id", text_col: str = "text", block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """One row per chunk: doc_id, start, length, block, part, bin, capacity, at.

    ``length`` counts a document's tokens; by default byte-level tokens with an
    end mark, so that an empty or null text is one token. Documents longer than
    the largest capacity are cut into chunks of it and a rest (``start`` is the
    chunk's first token in the document); no token is lost. A sequence is
    (block, part, bin), its size ``capacity``, the chunk's place in it ``at``.

    Documents are dealt to blocks by a hash of id and text, about half of
    ``block_chunks`` to a block, so blocks are even whatever the ids; identical
    rows that pile up in a block are cut into further parts at ``block_chunks``.
    Inside a block chunks go from longest to shortest (then by id and start),
    which is best-fit decreasing. Null ids are packed like others; rows with a
    null or non-positive custom length have nothing to pack and are left out.
    Repeated rows are packed each. Texts of any length are packed whole. An empty
    table gives no rows; other columns are not read.
    """
    top = int(max(capacities))
    rows = docs.select(whole_ids(docs, id_col).alias("doc_id"), (byte_tokens(F.col(text_col)) if length is None else length.cast("long")).alias("tokens"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h")).where("tokens > 0")
    n_blocks = max(1, math.ceil(docs.count() / (block_chunks / 2)))
    chunks = rows.select(
        F.pmod("h", F.lit(n_blocks)).alias("block"), "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(tokens - 1) div {top}"))).alias("i"), "tokens"
    ).select("block", "doc_id", (F.col("i") * top).alias("start"), F.least(F.lit(top).cast("long"), F.col("tokens") - F.col("i") * top).alias("length"))
    dealt = chunks.repartition(min(n_blocks, tasks_for(chunks, 1 << 30)) if n_blocks > 1 else 1, "block")
    ordered = dealt.sortWithinPartitions("block", F.col("length").desc(), "doc_id", "start")
    return ordered.select("block", "doc_id", "start", "length").mapInArrow(_pack(tuple(capacities), cost, block_chunks), _PACKED)
