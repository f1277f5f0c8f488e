"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

Sketch (Dahlgaard, Knudsen and Thorup, 2017): round i < t places every shingle
in a hashed one of t bins with value i + hash, round t + b fills bin b from all
shingles; each bin keeps its least value. All t coordinates are filled however
small the set, and the share of equal coordinates concentrates around the
Jaccard similarity. Bands of coordinates name buckets; documents that share one
are candidates, and links count only after the whole sets have been compared.

The candidates of a bucket are not expanded into all pairs. Links only matter
for components, so

1. equal sets become one representative;
2. each representative is compared with one pivot, that of most of its buckets;
3. in buckets that still hold several components, every member is compared with
   the bucket's pivot, and members outside the bucket's largest component with
   one of that component drawn by hash;
4. the members of buckets that are still open go into an index of their rarest
   shingles: with the shingles of all sets in one order, rare ones first, two
   sets of so large an intersection share one near the front of both, and what
   stands before the first that they share bounds the intersection. Members of
   different components that meet there under this bound are compared.

In steps 2 and 3 a pair is compared only if its whole sketches allow the link:
in a linked pair so many coordinates differ with a probability of at most
``MISS``. This spares documents that merely share a passage. Step 4 is exact: a
large family just below the threshold differs in rare shingles, so its members
don't meet, though all of them share buckets.

After step 4 no two documents of different components share a bucket without
having been compared or ruled out. Banding misses a pair right at the
threshold with a probability of at most ``MISS``, too, and less above it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import discard, materialise, split_by_ids, tasks_for, whole_ids, with_row_id, without_ids
from umbra.llm.components import connected_components

MISS = 1e-7
MAX_COORDINATES = 300
#: Members compared with one copy of a pivot's text; hot pivots are dealt to several tasks.
MEMBERS_PER_PIVOT = 200
#: Words whose hashes a worker keeps.
WORD_CACHE = 300_000

_K1, _K2, _K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S30, _S27, _S31, _S32 = (np.uint64(x) for x in (30, 27, 31, 32))
_LOW = np.uint64(0xFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> _S30)) * _K2
    x = (x ^ (x >> _S27)) * _K3
    return x ^ (x >> _S31)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(text: str | None, k: int, words: dict) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence if it has fewer words; empty without words.

    Words are runs without space and U+0009 to U+000D, A-Z lower-cased
    (``bytes.lower`` and ``bytes.split`` do just that).
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    k = min(k, len(w))
    n = len(w) - k + 1
    with np.errstate(over="ignore"):
        h = np.full(n, np.uint64(k), np.uint64)
        for i in range(k):
            h = _mix((h + _K1) ^ w[i : i + n])
    return np.unique(h)


def sketch(x: np.ndarray, t: int) -> np.ndarray:
    """t coordinates of the fast similarity sketch of a non-empty set."""
    n = len(x)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    s = np.full(t, full)
    done = 0
    with np.errstate(over="ignore"):
        # As many rounds at once as fill all bins most of the time; later rounds never beat earlier ones.
        step = max(1, math.ceil(t * (math.log(t) + 2) / n))
        while done < t and (s == full).any():
            rounds = np.arange(done, min(t, done + step), dtype=np.uint64)[:, None]
            h = _mix(x[None, :] + (rounds + np.uint64(1)) * _K1)
            bins = ((h >> _S32) * np.uint64(t)) >> _S32
            np.minimum.at(s, bins.ravel().astype(np.intp), ((rounds << _S32) | (h & _LOW)).ravel())
            done += step
        if len(left := np.flatnonzero(s == full)):
            i = (t + left).astype(np.uint64)[:, None]
            s[left] = ((i << _S32) | (_mix(x[None, :] + (i + np.uint64(1)) * _K1) & _LOW)).min(axis=1)
    return s


def band_keys(s: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A signed 64-bit key for each band, the band's number mixed in."""
    with np.errstate(over="ignore"):
        key = _mix(np.arange(1, bands + 1, dtype=np.uint64) * _K1)
        for column in s.reshape(bands, rows).T:
            key = _mix((key + _K1) ^ column)
    return key.view(np.int64)


def two_bits(s: np.ndarray) -> np.ndarray:
    """The two lowest bits of each coordinate, 32 coordinates to a word."""
    low = np.zeros(-(-len(s) // 32) * 32, np.uint64)
    low[: len(s)] = s & np.uint64(3)
    return np.bitwise_or.reduce(low.reshape(-1, 32) << np.arange(0, 64, 2, dtype=np.uint64), axis=1).view(np.int64)


def most_different(t: int, threshold: float) -> int:
    """Coordinates whose two bits may differ: more, with a similarity at the threshold, has a probability of at most MISS (binomial tail)."""
    differ = (1 - threshold) * 0.75
    log_p = lambda i: math.lgamma(t + 1) - math.lgamma(i + 1) - math.lgamma(t - i + 1) + i * math.log(differ) + (t - i) * math.log1p(-differ)
    tail, limit = 0.0, t
    while limit > 0 and differ and tail + (more := math.exp(log_p(limit))) <= MISS:
        tail, limit = tail + more, limit - 1
    return limit


def alike(a, b, words: int, limit: int) -> Column:
    """Whether two sketches (columns of two_bits) can belong to a linked pair."""
    differ = F.lit(0)
    for i in range(words):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return differ <= limit


def banding(threshold: float) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands miss a pair at the threshold with probability MISS at most, within MAX_COORDINATES."""
    best = None
    for rows in range(1, 33):
        bands = math.ceil(math.log(MISS) / math.log1p(-(threshold**rows)))
        if bands * rows <= MAX_COORDINATES:
            best = bands, rows
    return best or (math.ceil(math.log(MISS) / math.log1p(-threshold)), 1)


def _sketches(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            uids, texts = (c for c in batch.columns)
            for start in range(0, batch.num_rows, 1000):
                part = texts.slice(start, 1000)
                sizes, one, two, keys, bits = [], [], [], [], []
                for text in part:
                    x = shingle_hashes(text.as_py(), k, words)
                    sizes.append(len(x))
                    if not len(x):
                        one.append(0), two.append(0), keys.append(None), bits.append(None)
                        continue
                    raw = xxhash.xxh3_128_intdigest(x.tobytes())
                    one.append((raw >> 64) - (1 << 63)), two.append((raw & (1 << 64) - 1) - (1 << 63))
                    coordinates = sketch(x, bands * rows)
                    keys.append(band_keys(coordinates, bands, rows))
                    bits.append(two_bits(coordinates))
                yield pa.RecordBatch.from_arrays(
                    [uids.slice(start, 1000), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                    names=["uid", "n", "set1", "set2", "keys", "bits"],
                )

    return run


def _sets(k: int):
    """(rep, n, label, text) to (rep, n, label, h): the hashes of the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sets = [shingle_hashes(text.as_py(), k, words).view(np.int64) for text in part.column(3)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "n", "label", "h"])

    return run


_VERIFIED = "pivot long, rep long, inter long, joined long, link boolean"


def _verify(k: int, percent: int):
    """Rows come by (pivot, salt), the pivot's own text first: compare each member's whole set with the pivot's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        at, base = None, None
        for batch in batches:
            out: list[tuple] = []
            pivots, reps, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for pivot, rep, text in zip(pivots, reps, texts, strict=True):
                x = shingle_hashes(text.as_py(), k, words)
                if rep is None:
                    at, base = pivot, x
                    continue
                assert at == pivot, "a pivot's text comes before its members'"
                inter = len(np.intersect1d(base, x, assume_unique=True))
                joined = len(base) + len(x) - inter
                out.append((pivot, rep, inter, joined, 100 * inter >= percent * joined))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64()] * 4 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["pivot", "rep", "inter", "joined", "link"])

    return run


def _compared(pairs: DataFrame, texts: DataFrame, k: int, percent: int, label: str) -> DataFrame:
    """(pivot, rep, inter, joined, link) of every pair, from whole texts.

    Each member's text travels once for each of its pairs, a pivot's once for
    every MEMBERS_PER_PIVOT members: a pivot of any number of members fits.
    """
    pairs = materialise(pairs.select("pivot", "rep"), label)
    groups = pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).select("pivot", F.ceil(F.col("n") / MEMBERS_PER_PIVOT).cast("int").alias("salts"))
    members = pairs.join(groups, "pivot").select(F.col("rep").alias("uid"), "pivot", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int").alias("salt"), "rep")
    owners = groups.select(F.col("pivot").alias("uid"), "pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("rep"))
    both = owners.unionByName(members).join(texts, "uid")
    dealt = both.repartition(tasks_for(texts, 32 << 20), "pivot", "salt").sortWithinPartitions("pivot", "salt", F.col("rep").asc_nulls_first())
    out = materialise(dealt.select("pivot", "rep", "text").mapInArrow(_verify(k, percent), _VERIFIED), f"{label}-links")
    discard(pairs)
    return out


def _labels(reps: DataFrame, links: DataFrame) -> DataFrame:
    found = connected_components(links.select(F.col("pivot").alias("u"), F.col("rep").alias("v")))
    out = materialise(reps.join(found, F.col("rep") == F.col("node"), "left").select("rep", "n", F.coalesce("component", "rep").alias("label")), "labels")
    discard(found)
    return out


def _components(sk: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(uid, n, label): label is the least uid of the component."""
    sets = sk.where("n > 0").groupBy("set1", "set2", "n").agg(F.min("uid").alias("rep"))
    member = materialise(sk.where("n > 0").select("uid", "set1", "set2").join(sets, ["set1", "set2"]).select("uid", "rep", "n"), "members")
    reps = member.where("uid = rep").select("rep", "n")
    # Bucket rows of representatives only; buckets of one are dropped at once.
    rows = sk.select("uid", "keys").join(reps.select(F.col("rep").alias("uid")), "uid", "left_semi").select(F.col("uid").alias("rep"), F.explode("keys").alias("key"))
    pivots = rows.groupBy("key").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("m")).where("m > 1").select("key", "pivot")
    buckets = materialise(rows.join(pivots, "key"), "buckets")
    sizes_fit = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)

    bands, height = banding(percent / 100)
    words, limit = -(-bands * height // 32), most_different(bands * height, percent / 100)
    fits = lambda a, b: alike(a, b, words, limit)
    wanted = buckets.select(F.col("rep").alias("uid")).distinct()
    bits = materialise(sk.select("uid", "n", "bits").join(wanted, "uid", "left_semi").withColumnRenamed("uid", "rep"), "bits")
    pivot_bits = bits.select(F.col("rep").alias("pivot"), F.col("n").alias("pivot_n"), F.col("bits").alias("pivot_bits"))
    stars = buckets.where("rep <> pivot").groupBy("rep", "pivot").agg(F.count(F.lit(1)).alias("shared"))
    stars = materialise(stars.join(pivot_bits, "pivot").join(bits, "rep").where(sizes_fit(F.col("n"), F.col("pivot_n")) & fits(F.col("bits"), F.col("pivot_bits"))).select("rep", "pivot", "shared"), "stars")
    wanted = materialise(wanted, "wanted")
    texts = materialise(split_by_ids(texts, "uid", wanted)[0].join(wanted, "uid", "left_semi"), "candidates")
    discard(wanted)
    first = stars.groupBy("rep").agg(F.max(F.struct("shared", (-F.col("pivot")).alias("p"))).alias("x")).select("rep", (-F.col("x.p")).alias("pivot"))
    done = _compared(first, texts, k, percent, "first")
    label = _labels(reps, done.where("link"))

    def settle(pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Compare pairs; the comparisons so far and the labels that their links give."""
        more = _compared(pairs.select("rep", "pivot").distinct().join(done, ["rep", "pivot"], "left_anti"), texts, k, percent, name)
        links = done.unionByName(more)
        if more.where("link").isEmpty():
            return links, label
        named = _labels(reps, links.where("link"))
        discard(label)
        return links, named

    opened = _open(buckets, label)
    if not opened.isEmpty():
        own = opened.where("rep <> pivot").join(stars.select("rep", "pivot"), ["rep", "pivot"], "left_semi").select("rep", "pivot")
        done, label = settle(own.unionByName(_drawn(opened, bits, sizes_fit, fits)), "second")
        discard(opened)
        opened = _open(buckets, label)
        done, label = settle(_rare_pairs(opened, texts, k, percent), "third")
    discard(opened, buckets, bits, stars, texts)
    return member.join(label.select("rep", "label"), "rep").select("uid", "n", "label")


def _open(buckets: DataFrame, label: DataFrame) -> DataFrame:
    """Rows, with sizes and labels, of the buckets that hold more than one component."""
    named = buckets.join(label, "rep")
    several = named.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("key")
    return materialise(named.join(several, "key", "left_semi"), "open")


def _main(rows: DataFrame, key: str) -> DataFrame:
    """(key, main): the label of most rows, for every key of rows with several labels."""
    counts = rows.groupBy(key, "label").agg(F.count(F.lit(1)).alias("m"))
    return counts.groupBy(key).agg(F.max(F.struct("m", "label")).alias("x"), F.count(F.lit(1)).alias("of")).where("of > 1").select(key, F.col("x.label").alias("main"))


def _pair(a: str, b: str) -> list:
    return [F.greatest(a, b).alias("rep"), F.least(a, b).alias("pivot")]


def _drawn(open_rows: DataFrame, bits: DataFrame, sizes_fit, fits) -> DataFrame:
    """Members outside a bucket's largest component, each with one member of it drawn by hash: its buckets give it many partners."""
    rows = open_rows.join(_main(open_rows, "key"), "key")
    drawn = rows.where("label = main").groupBy("key").agg(F.min(F.struct(F.xxhash64("rep", "key").alias("h"), "rep", "n")).alias("x")).select("key", F.col("x.rep").alias("other"), F.col("x.n").alias("n_other"))
    pairs = rows.where("label <> main").join(drawn, "key").where(sizes_fit(F.col("n"), F.col("n_other"))).select("rep", "other").distinct()
    both = pairs.join(bits.select("rep", "bits"), "rep").join(bits.select(F.col("rep").alias("other"), F.col("bits").alias("bits_other")), "other")
    return both.where(fits(F.col("bits"), F.col("bits_other"))).select(*_pair("rep", "other"))


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(1.03)).cast("int")


def _rare_pairs(open_rows: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs of different components among the members of open buckets whose rarest shingles allow a link.

    All sets are read in one order: by the number of open members that have the
    shingle, then by hash. A set of n shingles can lose ``at`` of them and still
    be linked while 100 * (n - at) >= percent * n, so it is indexed under its
    shingles in these places only (those that no other set has need no index,
    but take their places). Where two sets meet at ``at_a`` and ``at_b`` for the
    first time, they share min(n_a - at_a, n_b - at_b) shingles at most. Looking
    up is done from outside the component of most sets under a shingle, and only
    among the sizes that this bound leaves, so a large component is never
    matched with itself.
    """
    members = open_rows.select("rep", "n", "label").distinct()
    held = members.join(texts.withColumnRenamed("uid", "rep"), "rep").select("rep", "n", "label", "text")
    sets = materialise(held.mapInArrow(_sets(k), "rep long, n long, label long, h array<long>"), "open-sets")
    each = sets.select("rep", "n", "label", F.explode("h").alias("h"))
    several = each.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = each.join(several, "h").groupBy("rep", "n", "label").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("s"))
    places = F.transform("s", lambda x, i: F.struct((F.col("n") - F.size("s") + i).alias("at"), x["h"].alias("h")))
    front = F.filter(places, lambda x: 100 * (F.col("n") - x["at"]) >= percent * F.col("n"))
    index = shared.select("rep", "n", "label", F.explode(front).alias("x")).select("rep", "n", "label", "x.at", "x.h")
    index = materialise(index.withColumn("size", _size_class(F.col("n"))), "rare")
    discard(sets)
    # The bound as sizes: from percent of one's own up to where (100 + percent) * (n - at) = percent * (n + n_b), and the same the other way.
    few = index.join(_main(index, "h"), "h").where("label <> main")
    few = few.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("label").alias("l_a"), F.col("at").alias("at_a"), "h", "main")
    least = F.ceil(F.col("n_a") * percent / 100 - 1e-6)
    most = F.least(F.floor(F.col("n_a") * 100 / percent + 1e-6), F.floor((100 + percent) * (F.col("n_a") - F.col("at_a")) / percent + 1e-6) - F.col("n_a"))
    few = few.withColumn("least", least).withColumn("most", most).where("least <= most")
    few = few.select("a", "n_a", "l_a", "at_a", "h", "main", F.explode(F.sequence(_size_class(F.greatest("least", F.lit(1))), _size_class(F.col("most")))).alias("size"))
    met = few.join(index, ["h", "size"]).where(
        (F.col("label") != F.col("l_a"))
        & ((F.col("label") == F.col("main")) | (F.col("a") < F.col("rep")))
        & (100 * F.least("n", "n_a") >= percent * F.greatest("n", "n_a"))
        & ((100 + percent) * F.least(F.col("n") - F.col("at"), F.col("n_a") - F.col("at_a")) >= percent * (F.col("n") + F.col("n_a")))
    )
    pairs = materialise(met.select(*_pair("a", "rep")).distinct(), "rare-pairs")
    discard(index)
    return pairs


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their
    sets of k-word shingles (with fewer words, the whole sequence is one
    shingle). component_id is the least id reachable over links. Texts without
    words, or null, have an empty set and are linked with nothing. Null ids come
    after all others; rows that repeat an id and a text form one component, of
    which one row is kept. An empty table gives no rows; other columns of
    ``docs`` are not read.
    """
    rows = docs.select(whole_ids(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _grouped(*with_row_id(rows, "doc_id"), "doc_id", "text", k, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _grouped(held: DataFrame, uid: str, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """(uid, doc_id, n_shingles, component_id, kept) of ``held``, whose column ``uid`` names its rows."""
    bands, rows = banding(percent / 100)
    texts = held.select(F.col(uid).alias("uid"), F.col(text_col).cast("string").alias("text"))
    sk = materialise(texts.mapInArrow(_sketches(k, bands, rows), "uid long, n long, set1 long, set2 long, keys array<long>, bits array<long>"), "sketches")
    found = _components(sk, texts, k, percent)
    ids = held.select(F.col(uid).alias("uid"), F.col(id_col).cast("long").alias("doc_id"))
    named = materialise(ids.join(found, "uid", "left").select("uid", "doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("label", "uid").alias("label")), "named")
    discard(sk)
    first = named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "uid")).alias("x")).select("label", F.col("x.doc_id").alias("component_id"), F.col("x.uid").alias("keep_uid"))
    return named.join(first, "label").select("uid", "doc_id", "n_shingles", "component_id", (F.col("uid") == F.col("keep_uid")).alias("kept"))


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of :func:`near_dedup` (its least id), columns unchanged.

    Documents without words, or null, are all kept; of rows that repeat an id and a
    text one stays; null ids, any columns of other names and an empty table are fine.
    Texts of any length are taken whole.
    """
    whole_ids(docs, id_col)
    held, uid = with_row_id(docs, id_col)
    gone = materialise(_grouped(held, uid, id_col, text_col, k, percent).where(~F.col("kept")).select(F.col("uid").alias(uid)), "gone")
    return without_ids(held, uid, gone).select(*docs.columns)
