"""Evaluation of predicted rows and texts against truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.dates import parse_date
from ledgerloom.functions.money import net_amount, parse_amount

# Acceptance thresholds of the release gate.
THRESHOLDS = {"transaction_recall": 0.995, "date_exact": 0.995, "amount_exact": 0.995, "balance_exact": 0.995, "row_association": 0.99}
MAX_REVIEW_RATE, MAX_SILENT_ERRORS = 0.10, 0
# What a truth name may be called in a prediction, in order.
ALIASES = {
    "transaction_date": ("transaction_date", "accounting_date", "date"),
    "accounting_date": ("accounting_date", "transaction_date", "date"),
    "date": ("date", "transaction_date", "accounting_date"),
    "balance": ("balance", "online_balance", "closing_balance"),
    "online_balance": ("online_balance", "balance", "closing_balance"),
    "closing_balance": ("closing_balance", "balance", "online_balance"),
    "transaction_amount": ("transaction_amount", "amount"),
    "amount": ("amount", "transaction_amount"),
}
DATE_FIELDS, AMOUNT_FIELDS, BALANCE_FIELDS = ("transaction_date", "accounting_date", "date"), ("transaction_amount", "amount"), ("balance", "online_balance")
NET_OF = {"income": ("income_amount", "income"), "expense": ("expense_amount", "expense")}
CRITICAL_FIELDS = ("transaction_date", "accounting_date", "date", "amount", "transaction_amount", "balance", "online_balance")


def truth_rows(samples: DataFrame) -> DataFrame:
    """Truth rows of golden samples (S12): sample_id, page_index, row_index, fields; a row loaded twice counts once.

    Of rows that differ under one key the one whose name=value pairs, sorted and joined, come first stands;
    ``repeated_truth`` lists such keys.
    """
    rows = samples.select("sample_id", F.inline("transactions"))
    return rows.groupBy(*TRUTH_KEY).agg(F.min_by("fields", _pairs_text("fields")).alias("fields"))


TRUTH_KEY = ["sample_id", "page_index", "row_index"]


def _pairs_text(fields: str) -> Column:
    pairs = F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return F.coalesce(F.array_join(F.sort_array(pairs), ";"), F.lit(""))


def repeated_truth(samples: DataFrame) -> DataFrame:
    """Keys of golden samples that hold different rows: the key and versions, how many."""
    rows = samples.select("sample_id", F.inline("transactions")).groupBy(*TRUTH_KEY, _pairs_text("fields").alias("p")).count()
    return rows.groupBy(*TRUTH_KEY).agg(F.count(F.lit(1)).alias("versions")).where("versions > 1")


def normal_value(name: str, text: Column) -> Column:
    """A predicted value as truth writes it (F21): ISO date, two-decimal amount, else the text itself."""
    if name in DATE_FIELDS:
        return F.coalesce(parse_date(text).cast("string"), text)
    if name in (*AMOUNT_FIELDS, "balance", "online_balance", "opening_balance", "closing_balance", "income_amount", "expense_amount"):
        return F.coalesce(parse_amount(text).cast("string"), text)
    return text


def predicted_value(fields: str, name: str) -> Column:
    """Value of a truth name in a prediction's MAP<STRING,STRING>, by alias and normalised; an amount that is not there is income less expense."""
    shown = normal_value(name, first_value(fields, *ALIASES.get(name, (name,))))
    return F.coalesce(shown, derived_net(fields).cast("string")) if name in AMOUNT_FIELDS else shown


def first_value(fields: str, *names: str) -> Column:
    """Value of the first of some names that a MAP<STRING,STRING> has."""
    return F.coalesce(*[F.try_element_at(fields, F.lit(n)) for n in names])


def derived_net(fields: str) -> Column:
    """Income less expense of a prediction (F21, F31); a missing or unreadable side is zero, null where both are."""
    side = {k: F.nullif(first_value(fields, *names), F.lit("")) for k, names in NET_OF.items()}
    read = {k: F.coalesce(parse_amount(v), v.try_cast("decimal(38,2)")) for k, v in side.items()}
    return net_amount(read["income"], read["expense"]).cast("decimal(38,2)")


def compare_fields(truth: DataFrame, predicted: DataFrame, key: list[str]) -> DataFrame:
    """Verdict on each truth field and each extra row (J12, A18): key, field_name, verdict exact, mismatch, missing or extra.

    Both hold the key and fields MAP<STRING,STRING>; a key occurs once. A predicted null is missing.
    """
    t = truth.select(*key, F.explode("fields").alias("field_name", "expected"))
    p = predicted.select(*key, F.col("fields").alias("got"))
    actual = F.try_element_at("got", F.col("field_name"))
    verdict = F.when(actual.isNull(), "missing").when(actual == F.col("expected"), "exact").otherwise("mismatch")
    on = t.join(p, key, "left").select(*key, "field_name", verdict.alias("verdict"))
    extra = predicted.join(truth.select(*key), key, "left_anti").select(*key, F.lit(None).cast("string").alias("field_name"), F.lit("extra").alias("verdict"))
    return on.unionByName(extra)


def field_accuracy(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """Counts and accuracy per group (A18): total_fields, exact_matches, missing, mismatches, extra_rows, accuracy (0 without fields)."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    df = verdicts.groupBy(*by).agg(n("exact").alias("exact_matches"), n("missing").alias("missing"), n("mismatch").alias("mismatches"), n("extra").alias("extra_rows"))
    total = F.col("exact_matches") + F.col("missing") + F.col("mismatches")
    return df.withColumn("total_fields", total).withColumn("accuracy", F.when(total > 0, F.col("exact_matches") / total).otherwise(0.0))


def field_labels(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """Sorted labels page:row:field of what is wrong per group (A18): missing, mismatches, and page:row of extra rows; empty where nothing is."""
    row = F.concat_ws(":", "page_index", "row_index")
    label = F.concat_ws(":", row, "field_name")
    told = lambda v, c: F.sort_array(F.collect_list(F.when(F.col("verdict") == v, c)))
    return verdicts.groupBy(*by).agg(told("missing", label).alias("missing"), told("mismatch", label).alias("mismatches"), told("extra", row).alias("extra"))


def review_keys(candidates: DataFrame, reports: DataFrame, issues: DataFrame, page: list[str]) -> DataFrame:
    """Rows a person has to look at (P18): all of page_review pages; of review pages the rows with issues, or all where none has."""
    key = [*page, "row_index"]
    status = reports.select(*page, F.col("status").alias("report"))
    flagged = issues.select(*key).distinct()
    some = flagged.select(*page).distinct().withColumn("some", F.lit(True))
    rows = candidates.select(*key).distinct().join(status, page).join(some, page, "left")
    whole = rows.where("report = 'page_review' or (report = 'review' and some is null)").select(*key)
    part = flagged.join(status.where("report = 'review'"), page, "left_semi").select(*key)
    return whole.unionByName(part).distinct()


def gate_metrics(truth: DataFrame, predicted: DataFrame, reviewed: DataFrame, key: list[str]) -> DataFrame:
    """One row of release metrics (A19): recall, exactness by kind, association, review rate, silent errors, gate_passed, gate_reasons.

    truth and predicted hold the key and fields MAP<STRING,STRING>; reviewed holds keys that a person looks at.
    """
    t = truth.select(*key, F.col("fields").alias("t"), F.lit(True).alias("in_truth"))
    p = predicted.select(*key, F.col("fields").alias("p"), F.lit(True).alias("in_prediction"))
    r = reviewed.select(*key).distinct().withColumn("in_review", F.lit(True))
    df = t.join(p, key, "full_outer").join(r, key, "left").fillna(False, ["in_truth", "in_prediction", "in_review"])
    has = lambda n: F.coalesce(F.map_contains_key("t", n), F.lit(False))

    def exact(names: tuple[str, ...]) -> tuple[Column, Column]:
        wanted, hit = F.lit(False), F.lit(False)
        for n in reversed(names):
            hit = F.when(has(n), predicted_value("p", n) == F.element_at("t", n)).otherwise(hit)
            wanted = wanted | has(n)
        return F.col("in_truth") & wanted, F.col("in_truth") & F.col("in_prediction") & wanted & F.coalesce(hit, F.lit(False))

    wrong = F.lit(False)
    for n in CRITICAL_FIELDS:
        expected = F.try_element_at("t", F.lit(n))
        wrong = wrong | (expected.isNotNull() & ~F.coalesce(predicted_value("p", n) == expected, F.lit(False)))
    both = F.col("in_truth") & F.col("in_prediction")
    kinds = {"date": exact(DATE_FIELDS), "amount": exact(AMOUNT_FIELDS), "balance": exact(BALANCE_FIELDS)}
    marks = {f"{k}_{n}": c for k, pair in kinds.items() for n, c in zip(("total", "hit"), pair)}
    marked = df.select("in_truth", "in_prediction", "in_review", wrong.alias("wrong"), *[c.alias(n) for n, c in marks.items()])
    counts = marked.agg(
        F.count_if("in_truth").alias("truth_rows"), F.count_if("in_prediction").alias("predicted_rows"), F.count_if(both).alias("matched"),
        F.count_if(F.col("in_prediction") & F.col("in_review")).alias("reviewed"), F.count_if(both & ~F.col("in_review") & F.col("wrong")).alias("silent_critical_errors"),
        *[F.count_if(n).alias(n) for n in marks],
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    values = {
        "transaction_recall": share("matched", "truth_rows"), **{f"{k}_exact": share(f"{k}_hit", f"{k}_total") for k in kinds},
        "row_association": F.col("matched") / F.greatest("truth_rows", "predicted_rows", F.lit(1)),
    }
    out = counts.select("truth_rows", "predicted_rows", "silent_critical_errors", *[v.alias(n) for n, v in values.items()], (F.col("reviewed") / F.greatest("predicted_rows", F.lit(1))).alias("review_rate"))
    reasons = [F.when(F.col(n) < least, F.lit(f"{n}<{least:g}")) for n, least in THRESHOLDS.items()]
    reasons += [F.when(F.col("review_rate") > MAX_REVIEW_RATE, F.lit(f"review_rate>{MAX_REVIEW_RATE:g}")), F.when(F.col("silent_critical_errors") != MAX_SILENT_ERRORS, F.lit("silent_critical_errors!=0"))]
    out = out.withColumn("gate_reasons", F.array_compact(F.array(*reasons)))
    return out.withColumn("gate_passed", F.size("gate_reasons") == 0)


def character_accuracy(results: DataFrame, truth: DataFrame, page: list[str]) -> DataFrame:
    """One row (A17): pages, exact_pages, character_accuracy = 1 - edits / characters, not below 0.

    Both hold page and text. Pages must be the same on both sides (J13, U9); a page on one side only counts
    as an empty text on the other and in ``unmatched_pages``, which a caller may refuse.
    """
    t = truth.select(*page, F.col("text").alias("_t"), F.lit(1).alias("_a"))
    r = results.select(*page, F.col("text").alias("_r"), F.lit(1).alias("_b"))
    df = t.join(r, page, "full_outer").select(F.coalesce("_t", F.lit("")).alias("t"), F.coalesce("_r", F.lit("")).alias("r"), (F.col("_a").isNull() | F.col("_b").isNull()).alias("lone"))
    edits, size = F.coalesce(F.sum(F.levenshtein("t", "r").cast("bigint")), F.lit(0)), F.coalesce(F.sum(F.length("t").cast("bigint")), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("t") == F.col("r")).alias("exact_pages"), F.count_if("lone").alias("unmatched_pages"),
        F.greatest(F.lit(0.0), 1 - edits / F.greatest(size, F.lit(1))).alias("character_accuracy"),
    )


def reading_baseline(blocks: DataFrame, page: list[str], confident: float = 0.80) -> DataFrame:
    """Blocks, characters and weak blocks per page (A20); an unknown confidence counts as 0."""
    weak = F.coalesce("confidence", F.lit(0.0)) < confident
    return blocks.groupBy(*page).agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("characters"), F.count_if(weak).alias("weak_blocks"))


def write_gate_report(metrics: DataFrame, path: str) -> bool:
    """Write release metrics as JSON and CSV below path (K11); whether the gate is passed, for an exit code."""
    row = metrics.withColumn("gate_reasons", F.array_join("gate_reasons", ";"))
    row.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    row.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    return bool(metrics.select("gate_passed").first()[0])
