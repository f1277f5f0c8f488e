"""Quality rules for documents: base statistics and cross-document line frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import BLANKS, LOWER, UPPER, discard, fresh, materialise, split_by_ids, whole_ids, with_row_id

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: A line is boilerplate on its host when more distinct documents have it than this, however large the host.
LINE_MIN_DOCS = 20
#: A document is depleted when boilerplate lines hold more than this share of its words, or fewer than MIN_WORDS are left.
DEPLETED_SHARE = 0.5
MIN_WORDS = 50


def normal_line(line: Column) -> Column:
    """A-Z lower-cased, runs of digits as 0, runs of blanks as one space, trimmed."""
    line = F.regexp_replace(F.translate(line, UPPER, LOWER), "[0-9]+", "0")
    return F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))


def _stats(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Base statistics and the hashed lines of every row, in one pass over the text.

    Repeated words come from sorting the text's own 3-word windows by hash, so
    the work stays near n log n for a text of n words however it repeats.
    """
    out = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    out = out.select("*", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("words"), F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    windows = F.expr("transform(slice(words, 1, greatest(size(words) - 2, 0)), (w, i) -> struct(xxhash64(w, get(words, i + 1), get(words, i + 2)) AS h, i AS i))")
    out = out.select(
        "uid",
        "doc_id",
        "host",
        F.xxhash64("t").alias("content"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("lines", lambda x: F.struct(F.xxhash64(normal_line(x)).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("w"), F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long").alias("d"))).alias("lines"),
        F.sort_array(windows).alias("s"),
    )
    again = F.expr("filter(s, (x, i) -> x.h = get(s, i + 1).h OR (i > 0 AND x.h = get(s, i - 1).h))")
    out = out.withColumn("at", F.sort_array(F.transform(again, lambda x: x["i"])))
    repeated = F.expr("aggregate(at, struct(0L AS n, -3 AS last), (a, i) -> struct(a.n + least(3, i - a.last) AS n, i AS last), a -> a.n)")
    return out.withColumn("n_repeat_words", repeated).drop("s", "at")


def judge_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = LINE_MIN_DOCS,
    share: float = 0.0,
    depleted: float = DEPLETED_SHARE,
    count_copies: bool = False,
) -> DataFrame:
    """One row per document: statistics, base_failed, kept, n_line_words_removed, n_words_left, lines_left_digest.

    Lines are normalised, hashed and counted per host by the distinct documents
    that have them. Exact copies are one document, so that a text isn't made
    boilerplate by being copied; with ``count_copies`` every row is a document.
    A line of more documents than ``min_docs`` (and than ``share`` of the host's,
    if one is given) is removed. What is left decides: a document that loses more
    than ``depleted`` of its words or keeps fewer than 50 is rejected, as is one
    that fails the base rules (fewer than 50 words, or over half of them in
    repeated windows). ``lines_left_digest`` sums the first 32 bits of the MD5 of
    each line with a word that is left.

    Null text counts as empty, a null host as a host of its own. Repeated rows
    are judged each; other columns are not read; an empty table gives no rows.
    Texts of any length are taken whole.
    """
    whole_ids(docs, id_col)
    return _judged(materialise(_stats(docs, id_col, text_col, host_col), "lines"), min_docs, share, depleted, count_copies).drop("uid", "gone")


def _judged(held: DataFrame, min_docs: int, share: float, depleted: float, count_copies: bool) -> DataFrame:
    who = "uid" if count_copies else "content"
    lines = held.select("uid", "host", "content", F.explode("lines").alias("x")).select("uid", "host", "content", "x.h", "x.w", "x.d")
    frequent = lines.select("host", "h", who).distinct().groupBy("host", "h").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > min_docs)
    if share:
        hosts = held.select("host", who).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("of"))
        frequent = frequent.join(hosts, "host").where(F.col("n_docs") > F.col("of") * share)
    removed = lines.join(frequent.select("host", "h"), ["host", "h"], "left_semi").groupBy("uid").agg(F.sum("w").alias("removed"), F.sum("d").alias("removed_d"), F.collect_set("h").alias("gone"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    digest = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["d"])
    out = held.select("uid", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", digest.alias("digest")).join(removed, "uid", "left")
    gone = F.coalesce("removed", F.lit(0)).cast("long")
    left = F.col("n_words") - gone
    return out.select(
        "uid",
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        (~base & (gone <= F.col("n_words") * depleted) & (left >= MIN_WORDS)).alias("kept"),
        gone.alias("n_line_words_removed"),
        left.alias("n_words_left"),
        (F.col("digest") - F.coalesce("removed_d", F.lit(0))).alias("lines_left_digest"),
        "gone",
    )


def keep_good_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = LINE_MIN_DOCS,
    share: float = 0.0,
    depleted: float = DEPLETED_SHARE,
    count_copies: bool = False,
) -> DataFrame:
    """The rows of ``docs`` that :func:`judge_documents` keeps, without the lines it removes.

    Columns are the same; texts without such lines are unchanged, other lines
    (blank ones too) stay as they are, and a column ``n_chars`` is brought up to
    date where a text changes. Null and empty texts fail the base rules and go;
    repeated rows stay or go together; null ids, clashing names of other columns
    and an empty table are fine; texts of any length are taken whole.
    """
    held, uid = with_row_id(docs, id_col)
    kept, gone_lines, doc = fresh(held, "__kept", "__gone", "__doc")
    stats = materialise(_stats(held.withColumn(doc, F.col(uid)), doc, text_col, host_col), "lines")
    judged = _judged(stats, min_docs, share, depleted, count_copies)
    touched = judged.where(~F.col("kept") | F.col("gone").isNotNull()).select(F.col("doc_id").alias(uid), F.col("kept").alias(kept), F.col("gone").alias(gone_lines))
    touched = materialise(touched, "touched")
    discard(stats)
    maybe, no = split_by_ids(held, uid, touched)
    left = maybe.join(touched, uid, "left").where(F.coalesce(F.col(kept), F.lit(True)))
    gone = F.col(gone_lines)
    rest = F.filter(F.split(F.col(text_col), "\n"), lambda x: ~F.array_contains(gone, F.xxhash64(normal_line(x))))
    left = left.withColumn(text_col, F.when(gone.isNull(), F.col(text_col)).otherwise(F.array_join(rest, "\n")))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(gone.isNull(), F.col("n_chars")).otherwise(F.length(text_col).cast(docs.schema["n_chars"].dataType)))
    if no is not None:
        left = no.select(*docs.columns).unionAll(left.select(*docs.columns))
    return left.select(*docs.columns)
