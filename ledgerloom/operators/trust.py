"""Evidence chains, trust scores, duplicate documents and partial-match flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.storage import materialize
from ledgerloom.functions.text import contains_any

#: Words that mark a tip, a currency conversion or a refund.
TIP = ("TIP", "GRATUITY", "TIP ADJUSTMENT", "GRATUITY ADDED")
CURRENCY = ("EUR", "€", "GBP", "£", "CAD", "¥", "JPY", "INR", "₹", "FOREIGN TXN", "CONVERSION RATE")
REFUND = ("REFUND", "RETURN", "CREDIT", "REVERSAL")


def composite_confidence(ocr: Column, extraction: Column, quality: Column) -> Column:
    return F.bround(ocr * extraction * quality, 4)


def evidence_status(confidence: Column, threshold: float = 0.7) -> Column:
    return F.when(confidence >= threshold, "verified").when(confidence >= 0.5,
        "low_confidence").otherwise("manual_review")


def build_chain(value: Column, field: Column, text: Column, confidence: Column, threshold: float = 0.7) -> Column:
    """A fact's record: field, value as text, the text's first 200 characters, confidence and status."""
    return F.struct(field.alias("field"), value.cast("string").alias("value"),
        F.substring(text, 1, 200).alias("snippet"), confidence.alias("confidence"),
        evidence_status(confidence, threshold).alias("status"))


def explode_facts(df: DataFrame, fields: dict[str, str], text: str, confidence: str,
    threshold: float = 0.7) -> DataFrame:
    """A row for each field that is there. ``fields``: name of a fact by column."""
    made = [F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""),
        build_chain(F.col(c), F.lit(name), F.col(text), F.col(confidence), threshold)) for c, name in fields.items()]
    return df.select("document_id", F.explode(F.array_compact(F.array(*made))).alias("fact")).select("document_id",
        "fact.*")


def needs_review(facts: DataFrame) -> DataFrame:
    """Facts for manual review, then those of low confidence."""
    return facts.where("status in ('manual_review', 'low_confidence')").withColumn("place",
        F.when(F.col("status") == "manual_review", 0).otherwise(1))


def evidence_report(facts: DataFrame) -> DataFrame:
    statuses = [F.count_if(F.col("status") == x).alias(x) for x in ("verified", "low_confidence", "manual_review")]
    return facts.agg(F.count_distinct("document_id").alias("documents"), F.count("*").alias("facts"), *statuses)


def completeness(doc_type: Column, receipt: list[Column], statement: list[Column], invoice: list[Column]) -> Column:
    """Share of a type's required fields that are there; each list has a boolean per field. Other types ask for a receipt's."""
    share = lambda xs: sum((F.coalesce(x, F.lit(False)).cast("int") for x in xs),
        F.lit(0)) / float(len(xs))
    return F.when(doc_type == "statement", share(statement)).when(doc_type == "invoice",
        share(invoice)).otherwise(share(receipt))


def _present(x: Column) -> Column:
    return x.isNotNull() & (x != 0)


def consistency(date: Column, total: Column, subtotal: Column, tax: Column, today: Column,
    zero_is_wrong: Column | bool = False) -> Column:
    """1, less 0.3 for a future date, 0.3 for a total below 0 and 0.2 where subtotal and tax do not make the total; a missing or zero part is not checked.

    ``zero_is_wrong``: a total of 0 costs 0.3 as well, as it does for an invoice; a receipt's counts as missing.
    """
    zero = F.lit(zero_is_wrong) if isinstance(zero_is_wrong, bool) else zero_is_wrong
    bad = (total < 0) | ((total == 0) & zero)
    score = F.lit(1.0) - F.when(date > today, 0.3).otherwise(0.0) - F.when(bad, 0.3).otherwise(0.0)
    checked = _present(subtotal) & _present(tax) & _present(total)
    return F.greatest(score - F.when(checked & (F.abs(total - (subtotal + tax)) > 0.01), 0.2).otherwise(0.0),
        F.lit(0.0))


def unit(x: Column) -> Column:
    """A share between 0 and 1; over 1 it counts as percent, a missing one as 0."""
    x = F.coalesce(x, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(x > 1, x / 100).otherwise(x)))


def trust_score(quality: Column, ocr: Column, complete: Column, consistent: Column) -> Column:
    """Struct (trust_score, image_quality, ocr_confidence, status); inputs over 1 count as percent."""
    q, o = unit(quality), unit(ocr)
    raw = F.bround(q * 0.3 + o * 0.3 + complete * 0.2 + consistent * 0.2,
        10)  # so that the order of the sum decides no tie
    return F.struct(F.bround(raw, 4).alias("trust_score"), F.bround(q, 4).alias("image_quality"),
        F.bround(o, 4).alias("ocr_confidence"), trust_status(raw).alias("status"))


def trust_status(score: Column) -> Column:
    return F.when(score >= 0.75, "verified").when(score >= 0.5, "low_confidence").otherwise("manual_review")


def content_fingerprint(text: Column) -> Column:
    """16 hexadecimal digits of the distinct amounts, the distinct dates and the first line of three characters or more."""
    found = lambda p, none: F.coalesce(
        F.nullif(F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(0)))), ","),
            F.lit("")), F.lit(none))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 2)
    head = F.coalesce(F.lower(F.substring(F.get(lines, F.lit(0)), 1, 30)), F.lit(""))
    content = F.concat(found(r"\$\d+\.\d{2}", "no_amounts"), F.lit(":"),
        found(r"\d{1,2}/\d{1,2}/\d{2,4}", "no_dates"), F.lit(":"), head)
    return F.when(F.coalesce(text, F.lit("")) == "", "empty_text").otherwise(F.substring(F.md5(content), 1, 16))


def duplicate_flags(docs: DataFrame, order: str, text: str, phash: Column | None = None) -> DataFrame:
    """(``order``, phash, fingerprint, is_duplicate): an earlier row, by ``order``, has the same image hash and fingerprint.

    Fingerprints are made once and written without their texts. The first of each key is found by an aggregate and joined back, so
    a key with very many copies is no single task.
    """
    keyed = docs.select(order, (phash if phash is not None else F.lit("invalid_image")).alias("phash"),
        content_fingerprint(F.col(text)).alias("fingerprint"))
    keyed = materialize(keyed, "fingerprints")
    first = keyed.groupBy("phash", "fingerprint").agg(F.min(order).alias("__first"))
    return keyed.join(first, ["phash", "fingerprint"]).withColumn("is_duplicate",
        F.col(order) != F.col("__first")).drop("__first")


def duplicates(docs: DataFrame, order: str, text: str, phash: Column | None = None) -> DataFrame:
    """``docs``, in which ``order`` is unique, with the columns of ``duplicate_flags``."""
    return docs.join(duplicate_flags(docs, order, text, phash), order)


def seen_count(docs: DataFrame, text: str) -> DataFrame:
    return docs.agg(F.count_distinct(content_fingerprint(F.col(text))).alias("seen"))


def partial_match_flag(text: Column, subtotal: Column, tax: Column, total: Column) -> Column:
    """Struct (eligible, reason, confidence_penalty, suggested_tolerance): tip, currency, refund by words, in this order; else sums that do not add up."""
    up = F.upper(text)
    made = lambda r, p, t: F.struct(F.lit(r is not None).alias("eligible"), F.lit(r).cast("string").alias("reason"),
        F.lit(p).alias("confidence_penalty"), F.lit(t).alias("suggested_tolerance"))
    wrong = _present(subtotal) & _present(tax) & _present(total) & (F.abs(total - (subtotal + tax)) > 0.01)
    return (F.when(contains_any(up, TIP), made("tip_detected", 0.05, 0.20))
        .when(contains_any(up, CURRENCY), made("currency_conversion", 0.03, 0.05))
            .when(contains_any(up, REFUND), made("refund", 0.02, 0.02))
            .when(wrong, made("internal_math_discrepancy", 0.03, 0.03)).otherwise(made(None, 0.0, 0.0)))


def partial_explanation(flag: Column) -> Column:
    says = F.lit(None)
    for reason, text in (
        ("tip_detected", "Tip may cause amount mismatch with bank transaction"),
        ("currency_conversion", "Foreign currency conversion may cause small discrepancy"),
        ("refund", "Refund transaction - negative amount expected"),
        ("internal_math_discrepancy", "Receipt math error detected"),
    ):
        says = F.when(flag["reason"] == reason, text).otherwise(says)
    return F.when(~flag["eligible"],
        "Exact match expected").otherwise(
        F.concat(says, F.lit(" (tolerance: "),
            F.bround(flag["suggested_tolerance"] * 100, 0).cast("int").cast("string"), F.lit("%)")))
