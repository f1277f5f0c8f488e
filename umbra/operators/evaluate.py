"""Evaluation: greedy matching of spans, precision and recall, regression gate, leak report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.operators.finders import find_entities
from umbra.operators.spans import find_all, inside

#: Well-formed placeholders.
PLACEHOLDERS = r"\[(?:GESCHWÄRZT:[A-ZÄÖÜ_]+|(?:PRÜFEN:)?[A-ZÄÖÜ_]+_\d+)\]"
_PAIRS = "array<struct<iou:double,p:int,g:int>>"


def iou(a: Column, b: Column) -> Column:
    both = F.greatest(F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))
    return F.when(both == 0, 0.0).otherwise(both / (F.greatest(a["end"], b["end"]) - F.least(a["start"], b["start"])))


def match(predicted: Column, truth: Column, threshold: float = 0.5) -> Column:
    """Pairs (iou, p, g) of a greedy one-to-one matching: same category, overlap at the threshold, best first, then by place."""

    def with_truth(e: Column, p: Column) -> Column:
        fit = F.transform(truth, lambda g, j: F.struct((-iou(e, g)).alias("k"), p.alias("p"), j.alias("g"), (e["entity_group"] == g["type"]).alias("same")))
        return F.filter(fit, lambda c: c["same"] & (-c["k"] >= threshold))

    candidates = F.array_sort(F.flatten(F.transform(predicted, with_truth)))

    def step(acc: Column, c: Column) -> Column:
        taken = F.exists(acc, lambda x: (x["p"] == c["p"]) | (x["g"] == c["g"]))
        pair = F.struct((-c["k"]).alias("iou"), c["p"].alias("p"), c["g"].alias("g"))
        return F.when(taken, acc).otherwise(F.concat(acc, F.array(pair)).cast(_PAIRS))

    return F.aggregate(candidates, F.array().cast(_PAIRS), step)


def outcomes(df: DataFrame, threshold: float = 0.5, predicted: str = "predicted", truth: str = "truth") -> DataFrame:
    """(category, tp, fp, fn) rows of every prediction and every annotation of ``df``."""
    held = df.withColumn("__m", match(F.col(predicted), F.col(truth), threshold))
    row = lambda category, tp, fp, fn: F.struct(category.alias("category"), F.lit(tp).alias("tp"), F.lit(fp).alias("fp"), F.lit(fn).alias("fn"))
    hit = F.transform("__m", lambda m: row(F.get(F.col(predicted), m["p"])["entity_group"], 1, 0, 0))
    over = F.transform(F.filter(F.col(predicted), lambda e, i: ~F.exists("__m", lambda m: m["p"] == i)), lambda e: row(e["entity_group"], 0, 1, 0))
    missed = F.transform(F.filter(F.col(truth), lambda g, j: ~F.exists("__m", lambda m: m["g"] == j)), lambda g: row(g["type"], 0, 0, 1))
    return held.select(F.explode(F.concat(hit, over, missed)).alias("o")).select("o.*")


def scores(counts: DataFrame) -> DataFrame:
    """``counts`` (tp, fp, fn) with precision, recall and f1; zero where there is nothing to divide by."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    df = counts.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn"))})
    total = F.col("precision") + F.col("recall")
    return df.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def evaluate(df: DataFrame, threshold: float = 0.5, predicted: str = "predicted", truth: str = "truth") -> DataFrame:
    """Counts and scores by category, and overall (category null), in one pass."""
    sums = outcomes(df, threshold, predicted, truth).rollup("category").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    return scores(sums)


def evaluate_layers(df: DataFrame, threshold: float = 0.5, predicted: str = "predicted", truth: str = "truth") -> DataFrame:
    """Counts and scores of every layer by itself; a layer without predictions in a document still misses its annotations."""
    of = F.when(F.col("x.source") == "", "unknown").otherwise(F.col("x.source"))
    layers = df.select(F.explode(predicted).alias("x")).select(of.alias("layer")).distinct()
    # A row per layer: a handful of detectors, whatever the corpus.
    each = df.crossJoin(F.broadcast(layers))
    own = F.filter(F.col(predicted), lambda e: F.when(e["source"] == "", "unknown").otherwise(e["source"]) == F.col("layer"))
    held = each.withColumn("__own", own)
    held = held.withColumn("__m", match(F.col("__own"), F.col(truth), threshold))
    n = F.size("__m")
    sums = held.groupBy("layer").agg(F.sum(n).alias("tp"), F.sum(F.size("__own") - n).alias("fp"), F.sum(F.size(F.col(truth)) - n).alias("fn"))
    return scores(sums)


def compare(baseline: DataFrame, current: DataFrame, abs_drop: float = 0.02, rel_drop: float = 0.05, critical: Sequence[str] = ("SVN", "IBAN", "EMAIL"), min_recall: float = 0.95) -> DataFrame:
    """(reason) rows, one for each rule that ``current`` breaks; none: the gate is passed. Both as of :func:`evaluate`."""
    spark = current.sparkSession
    over = lambda df, name: df.where("category IS NULL").agg(F.coalesce(F.max("f1"), F.lit(0.0)).alias(name))
    f1 = over(baseline, "b").crossJoin(over(current, "c")).withColumn("d", F.col("b") - F.col("c"))
    drops = f1.select(F.explode(F.array(F.when(F.col("d") > abs_drop, F.format_string("overall f1 dropped by %.3f", "d")), F.when(F.when(F.col("b") > 0, F.col("d") / F.col("b")).otherwise(0.0) > rel_drop, F.format_string("overall f1 dropped by %.1f %%", F.col("d") / F.col("b") * 100)))).alias("reason"))
    wanted = spark.createDataFrame([(c,) for c in critical], "category string")
    recall = wanted.join(current, "category", "left").select("category", F.coalesce("recall", F.lit(0.0)).alias("recall")).where(F.col("recall") < min_recall)
    return drops.where("reason IS NOT NULL").unionByName(recall.select(F.format_string("critical category %s has a recall of %.3f", "category", "recall").alias("reason")))


#: From harmless to worst.
SEVERITIES = ("NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL")
#: Fixed value: categories whose leaks weigh more.
DIRECT = ("SVN", "IBAN", "BIC", "UID", "REISEPASS", "PERSONALAUSWEIS", "FUEHRERSCHEIN", "KFZ", "ZMR", "FIRMENBUCH", "HEALTH_DIAGNOSIS", "HEALTH_MEDICATION", "RELIGION", "ETHNICITY", "POLITICAL", "UNION", "SEXUAL_ORIENTATION", "BIOMETRIC")


def severity(channel: Column, kind: Column) -> Column:
    """Rank of a leak: medium, a step up in public output and a step up for direct identifiers."""
    return F.lit(SEVERITIES.index("MEDIUM")) + F.when(channel == "ifg", 1).otherwise(0) + F.when(kind.isin(list(DIRECT)), 1).otherwise(0)


def leak_report(df: DataFrame, output: str = "output", channel: str = "channel", truth: str = "truth", text: str = "text") -> DataFrame:
    """(doc_id, channel, kind, how, start, snippet, severity) of what the finders or a verbatim search still find in outputs."""
    held = df.withColumn("__p", find_all(F.col(output), PLACEHOLDERS))
    found = F.transform(F.filter(find_entities(F.col(output)), lambda e: ~inside(e["start"], e["end"], F.col("__p"))), lambda e: F.struct(e["entity_group"].alias("kind"), F.lit("regex").alias("how"), e["start"].alias("start"), e["end"].alias("end")))
    values = F.transform(F.col(truth), lambda g: F.struct(g["type"].alias("kind"), F.substring(F.col(text), g["start"] + 1, g["end"] - g["start"]).alias("v")))
    at = lambda v: F.instr(F.col(output), v) - 1
    left = F.filter(values, lambda v: (F.length(v["v"]) >= 4) & F.col(output).contains(v["v"]))
    verbatim = F.transform(left, lambda v: F.struct(v["kind"].alias("kind"), F.lit("verbatim").alias("how"), at(v["v"]).cast("int").alias("start"), (at(v["v"]) + F.length(v["v"])).cast("int").alias("end")))
    rows = held.select("doc_id", channel, output, F.explode(F.concat(found, verbatim)).alias("l")).select("doc_id", F.col(channel).alias("channel"), F.col(output).alias("o"), "l.*")
    n = F.col("end") - F.col("start")
    left_at = F.greatest(F.col("start") - 20, F.lit(0))
    safe = F.concat(F.lit("..."), F.substring("o", left_at + 1, F.col("start") - left_at), F.lit("<LEAK["), n.cast("string"), F.lit("ch]>"), F.substring("o", F.col("end") + 1, F.lit(20)), F.lit("..."))
    return rows.select("doc_id", "channel", "kind", "how", "start", safe.alias("snippet"), severity(F.col("channel"), F.col("kind")).alias("severity"))


def leak_summary(report: DataFrame) -> DataFrame:
    """(doc_id, channel, worst, leaks) of a leak report."""
    names = F.array(*map(F.lit, SEVERITIES))
    return report.groupBy("doc_id", "channel").agg(F.get(names, F.max("severity")).alias("worst"), F.count(F.lit(1)).alias("leaks"))
