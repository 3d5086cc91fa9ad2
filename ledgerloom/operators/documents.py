"""Document decisions and field extraction from recognised text.

Pixel work (sharpness, noise, rotation, recognition) needs libraries of its own; its figures and
text come in as columns. What is decided from them is here, in built-in expressions, but for
receipt items, whose pattern cascade runs in an Arrow UDF.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from ledgerloom.functions.storage import materialize
from ledgerloom.functions.text import chain, contains_any, first_match, let, squeeze, title
from ledgerloom.operators import trust

#: Keywords of each document type; some stand twice and count twice.
TYPE_KEYWORDS = {
    "receipt": (
        "total", "change", "cashier", "thank you", "receipt", "subtotal", "tax", "payment", "cash", "credit", "debit",
        "transaction", "store", "purchase", "item", "qty", "mcdonald", "starbucks",
        "walmart", "target", "cvs", "trader", "joe", "whole", "foods", "grocery", "supermarket", "gas", "grocery",
        "restaurant", "coffee", "debit", "credit", "trans", "reg:"),
    "statement": (
        "statement", "account", "balance", "deposit", "withdrawal", "transaction history", "beginning balance",
        "ending balance", "account number", "routing number", "summary", "period", "checking",
        "savings", "credit card", "bank", "federal"),
    "invoice": (
        "invoice", "bill to", "ship to", "due date", "payment due", "line item", "description", "quantity",
        "unit price", "subtotal", "total due", "amount due", "please remit", "purchase order",
        "po number", "terms", "net 30", "net 15"),
}
AMOUNT = r"([\d,]+\.\d{2})"


def number(x: Column) -> Column:
    """A figure with thousands separators; null where there is none."""
    return F.try_to_number(F.replace(x, F.lit(","), F.lit("")), F.lit("999999999999.99")).cast("double")


def amount_after(text: Column, pattern: str) -> Column:
    return F.regexp_replace(first_match(text, f"(?i){pattern}"), ",", "").try_cast("double")


# image quality and geometry -------------------------------------------------


def quality_overall(sharpness: Column, noise: Column, contrast: Column, pixels: Column) -> Column:
    return F.bround(0.4 * sharpness + 0.25 * noise + 0.25 * contrast + 0.1 * F.least(pixels / 1e6, F.lit(1.0)), 4)


def quality_route(overall: Column, sharpness: Column) -> Column:
    return F.when((overall >= 0.7) & (sharpness >= 0.6), "direct_ocr").when(overall >= 0.4,
        "enhance_then_ocr").otherwise("reject_or_manual")


def quality_recommendations(sharpness: Column, noise: Column, contrast: Column, resolution: Column) -> Column:
    return F.array_compact(F.array(F.when(sharpness < 0.5, "sharpen"), F.when(noise < 0.6, "denoise"),
        F.when(contrast < 0.5, "contrast_enhance"), F.when(resolution < 0.3, "upscale")))


def sharpness(laplacian_variance: Column) -> Column:
    return F.least(laplacian_variance / 500, F.lit(1.0))


def noise(median_deviation: Column, flat_pixels: Column) -> Column:
    return F.when(flat_pixels < 100, 0.5).otherwise(1 - F.least(median_deviation / 20, F.lit(1.0)))


def contrast(low: Column, high: Column, clipped: Column) -> Column:
    """From the 2.5 and 97.5 percentiles of brightness and the share of black pixels."""
    return F.when(clipped > 0.15, 0.3).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(1.0), (high - low) / 150)))


def orientation(width: Column, height: Column, detected: Column | None = None,
    confidence: Column | None = None) -> Column:
    """Degrees to turn: as detected with confidence, else 90 for a very wide page."""
    guess = F.when(width / height > 1.3, 90).otherwise(0)
    return guess if detected is None else F.when(confidence >= 1, detected).otherwise(guess)


def deskew_angle(measured: Column) -> Column:
    """The measured angle; 0 under half a degree or beyond five."""
    return F.when((F.abs(measured) < 0.5) | (F.abs(measured) > 5), 0.0).otherwise(measured)


def geometry_steps(turn: Column, skew: Column, cropped: Column) -> Column:
    return F.array_compact(F.array(F.when(turn != 0, F.concat(F.lit("rotate_"), turn.cast("string"))),
        F.when(skew != 0, "deskew"), F.when(cropped, "crop")))


# recognised text ------------------------------------------------------------


def words_text(words: Column, least: float = 30) -> Column:
    """Struct (text, confidence) of ``array<struct<text, conf>>``: words over ``least`` and their mean confidence, 0 to 100."""
    kept = F.filter(words, lambda w: (w["conf"] > least) & (F.trim(w["text"]) != ""))
    return let(kept, lambda k: F.struct(
        F.array_join(F.transform(k, lambda w: w["text"]), " ").alias("text"),
        F.coalesce(F.try_divide(F.aggregate(k, F.lit(0.0), lambda s, w: s + w["conf"].cast("double")), F.size(k)),
            F.lit(0.0)).alias("confidence")))


def extract_simple(text: Column, confidence: Column) -> Column:
    """Struct (text on one line, confidence 0 to 1); empty and 0 without text."""
    return F.struct(F.coalesce(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("")).alias("text"),
        F.when(text.isNull(), 0.0).otherwise(confidence / 100).alias("confidence"))


def text_structure(text: Column) -> Column:
    """Headers, amounts, dates, number of lines and their mean length."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    dates = [r"\d{1,2}/\d{1,2}/\d{2,4}", r"\d{1,2}-\d{1,2}-\d{2,4}", r"\d{4}-\d{2}-\d{2}"]
    return let(lines, lambda ls: F.struct(
        F.slice(F.filter(ls, lambda x: (F.length(x) < 50) & (x == F.upper(x)) & F.rlike(x, F.lit("[A-Za-z]"))), 1, 5)
        .alias("headers"),
        F.slice(F.flatten(F.transform(ls, lambda x: F.regexp_extract_all(x, F.lit(r"\$?\d+\.\d{2}"), F.lit(0)))), 1,
            10).alias("amounts"),
        F.slice(F.flatten(F.transform(ls,
            lambda x: F.concat(*(F.regexp_extract_all(x, F.lit(p), F.lit(0)) for p in dates)))), 1, 5).alias("dates"),
        F.size(ls).alias("line_count"),
        F.coalesce(F.try_divide(F.aggregate(ls, F.lit(0), lambda s, x: s + F.length(x)), F.size(ls)), F.lit(0.0))
        .alias("avg_line_length")))


def type_score(text: Column, words: tuple[str, ...]) -> Column:
    """Three times the share of a type's keywords found, less where they repeat."""
    return let(F.lower(text), lambda low: _type_score(low, words))


def _type_score(low: Column, words: tuple[str, ...]) -> Column:
    once = tuple(dict.fromkeys(words))
    hits = lambda ws: sum((F.contains(low, F.lit(w)).cast("int") for w in ws), F.lit(0))
    again = hits([w for k, w in enumerate(words) if w in words[:k]])
    return let(F.struct(hits(once).alias("u"), again.alias("a")),
        lambda z: (z["u"] + z["a"]) / float(len(words)) * 3 * (0.5 + 0.5 * F.coalesce(F.try_divide(z["u"], z["u"] + z["a"]), F.lit(0.0))))


def table_like(text: Column) -> Column:
    """Over 30 % of the lines have two numbers or more."""
    return let(F.split(text, "\n"),
        lambda ls: F.size(F.filter(ls,
            lambda x: F.size(F.regexp_extract_all(x, F.lit(r"\$?\d+\.?\d*"), F.lit(0))) >= 2)) / F.size(ls) > 0.3)


def layout_scores(text: Column, width: Column, height: Column) -> Column:
    return let(F.lower(text), lambda low: _layout_scores(text, low, width, height))


def _layout_scores(text: Column, low: Column, width: Column, height: Column) -> Column:
    ratio = width / height

    def scores(table: Column) -> Column:
        extra = lambda x: F.when(table, x).otherwise(0.0)
        return F.struct(
            F.when(ratio.between(0.5, 0.8) & (height > width), 0.5).otherwise(0.0).alias("receipt"),
            (F.when(ratio.between(0.7, 1.0) & F.contains(low, F.lit("statement")), 0.8).otherwise(0.0) + extra(0.3))
            .alias("statement"),
            (F.when(F.contains(low, F.lit("invoice")), 1.0).otherwise(0.0) + extra(0.4)).alias("invoice"))
    return let(table_like(text), scores)


def doc_type(text: Column, width: Column, height: Column) -> Column:
    """Struct (type, confidence, status, margin): the best of keywords and layout; ties go to receipt, then statement."""
    def decide(z: Column) -> Column:
        ranked = F.array_sort(F.array(
            *(F.struct((-(z["k"][k] + 0.3 * z["l"][name])).alias("s"), F.lit(k).alias("i"),
                F.lit(name).alias("t")) for k, name in enumerate(TYPE_KEYWORDS))))

        def settle(r: Column) -> Column:
            best, margin = -r[0]["s"], r[1]["s"] - r[0]["s"]
            conf = F.least(best / 2.0, F.lit(1.0))
            status = F.when((conf >= 0.7) & (margin > 0.3), "high_confidence").when(conf >= 0.4,
                "medium_confidence").otherwise("low_confidence")
            return F.struct(F.when(conf >= 0.4, r[0]["t"]).otherwise("unknown").alias("type"),
                F.bround(conf, 4).alias("confidence"), status.alias("status"), F.bround(margin, 4).alias("margin"))
        return let(ranked, settle)

    def scored(low: Column) -> Column:
        scores = F.array(*(_type_score(low, words) for words in TYPE_KEYWORDS.values()))
        return let(F.struct(scores.alias("k"), _layout_scores(text, low, width, height).alias("l")), decide)
    return let(F.lower(text), scored)


def routing_decision(kind: Column, confidence: Column) -> Column:
    route = F.when(kind == "receipt", "key_value_extraction").when(kind == "statement",
        "table_extraction").when(kind == "invoice", "structured_parsing").otherwise("generic_ocr")
    return F.when(confidence < 0.4, "manual_review").otherwise(route)


# receipts -------------------------------------------------------------------


def nonblank_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def day(year: Column, month: Column, dom: Column) -> Column:
    """An ISO date, null where there is no such day; two-digit years from 50 on are of the last century."""
    y = F.when(F.length(year) == 2, F.concat(F.when(year >= "50", "19").otherwise("20"), year)).otherwise(year)
    return F.date_format(F.try_to_date(F.concat_ws("-", y, F.lpad(month, 2, "0"), F.lpad(dom, 2, "0"))), "yyyy-MM-dd")


def _parts(text: Column, pattern: str, order: tuple[int, int, int]) -> Column:
    return F.when(F.rlike(text, F.lit(pattern)), day(*(F.regexp_extract(text, pattern, g) for g in order)))


def receipt_normalize(text: Column) -> Column:
    return F.trim(chain(text, [(r"(\d)x([A-Za-z])", "$1x $2"), (r"(\d)\s(\d{2})(?=\s|$|\n)", "$1.$2")]))


#: Lines with these words are no merchant's name.
NOT_MERCHANTS = ("receipt", "invoice", "statement", "date", "time", "trans", "welcome", "thank", "customer", "copy",
    "store")


def receipt_merchant(text: Column) -> Column:
    heads = F.transform(F.filter(F.slice(nonblank_lines(text), 1, 5),
        lambda x: ~contains_any(F.lower(x), NOT_MERCHANTS)), lambda x: F.trim(F.regexp_replace(x, r"#\d+", "")))
    good = F.filter(heads, lambda x: (F.length(x) >= 3) & ~F.rlike(x, F.lit(r"^\d+$"))
        & (F.length(F.regexp_replace(x, r"[^A-Za-z]", "")) / F.length(x) > 0.6))
    return F.replace(title(F.get(good, F.lit(0))), F.lit("'S"), F.lit("'s"))


def receipt_date(text: Column, iso_first: bool = True) -> Column:
    """The receipt's day. The dash form also matches inside ISO dates, so those come first unless ``iso_first`` is off."""
    slash = _parts(text, r"(\d{1,2})/(\d{1,2})/(\d{2,4})", (3, 1, 2))
    dash, iso = _parts(text, r"(\d{1,2})-(\d{1,2})-(\d{2,4})", (3, 1, 2)), _parts(text, r"(\d{4})-(\d{2})-(\d{2})",
        (1, 2, 3))
    return F.coalesce(slash, iso, dash) if iso_first else F.coalesce(slash, dash, iso)


def receipt_total(text: Column) -> Column:
    said = [amount_after(text, p + r"[:\s]*\$?" + AMOUNT) for p in (r"\bTOTAL\b", r"GRAND\s+TOTAL", r"AMOUNT\s+DUE",
        r"BALANCE\s+DUE")]
    every = F.transform(F.regexp_extract_all(text, F.lit(r"\$?(\d{1,3}(?:,\d{3})*\.\d{2})"), F.lit(1)),
        lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))
    return F.coalesce(*said, F.array_max(every))


def receipt_subtotal(text: Column) -> Column:
    return amount_after(text, r"SUBTOTAL[:\s]*\$?" + AMOUNT)


def receipt_tax(text: Column) -> Column:
    return amount_after(text, r"TAX[\s\d\.%]*[:\s]*\$?" + AMOUNT)


def percent_rate(text: Column) -> Column:
    return first_match(text, r"(\d+(?:\.\d+)?)\s*%").cast("double")


ITEM = StructType([StructField("quantity", IntegerType()), StructField("name", StringType()),
    StructField("price", DoubleType())])
#: Line forms of an item, in the order they are tried, with the groups of quantity, name and price.
ITEM_FORMS = (
    (re.compile(r"(\d+)\s*x\s*([^\n$]+?)\s*\$?(\d+\.\d{2})", re.I), (1, 2, 3)),
    (re.compile(r"([^\n$]+?)\s*x\s*(\d+)\s*\$?(\d+\.\d{2})", re.I), (2, 1, 3)),
    (re.compile(r"([^\n$]+?)\s+(\d+)\s*\$?(\d+\.\d{2})", re.I), (2, 1, 3)),
    (re.compile(r"([A-Za-z][^\n$]*?)\s*\$?(\d+\.\d{2})", re.I), (0, 1, 2)),
)
#: What every form ends with.
PRICE = re.compile(r"\d\.\d{2}")
#: Lines with these words are no items.
NOT_ITEMS = ("SUBTOTAL", "TOTAL", "TAX", "BALANCE", "AMOUNT DUE")


def items_of(text: str | None) -> list[dict]:
    """A receipt's items: on each line the first form that gives a plausible and new one."""
    found, seen = [], set()
    for line in (x.strip() for x in (text or "").split("\n") if PRICE.search(x)):
        for form, (q, n, p) in ITEM_FORMS if "x" in line or "X" in line else ITEM_FORMS[2:]:  # the first two have an x
            m = form.search(line)
            if not m:
                continue
            name = re.sub(r"^\d+\s*x\s*", "", m[n].strip(), flags=re.I).replace("@", "")
            name = re.sub(r"#\d+", "", " ".join(name.split())).strip()
            quantity, price = int(m[q]) if q else 1, float(m[p])
            key = (name.lower(), price)
            if name and not any(w in name.upper() for w in NOT_ITEMS) and not (price > 500
                and quantity == 1) and key not in seen and quantity < 2**31:
                seen.add(key)
                found.append({"quantity": quantity, "name": name, "price": price})
                break
    return found


@F.pandas_udf(ArrayType(ITEM))
def receipt_items(text: pd.Series) -> pd.Series:
    return text.map(items_of)


#: Else a filter on the items, such as an explode brings with it, would run the function once more below it.
receipt_items = receipt_items.asNondeterministic()


#: Ways to pay, the first of which that occurs counts.
PAYMENT_METHODS = ("CASH", "CREDIT", "DEBIT", "MOBILE PAY", "CHECK", "GIFT CARD")


def payment_method(text: Column) -> Column:
    out = F.upper(first_match(text, r"(?i)Paid[:\s]*(\w+)"))
    for m in reversed(PAYMENT_METHODS):
        out = F.when(F.contains(F.upper(text), F.lit(m)), m).otherwise(out)
    return out


def count_of(column: str) -> Column:
    return F.coalesce(F.size(column), F.lit(0))


def _has(x: Column) -> Column:
    return F.coalesce(x.cast("string") != "", F.lit(False)) & F.coalesce(x.try_cast("double") != 0, F.lit(True))


def _points(*parts: tuple[Column, float]) -> Column:
    return sum((F.when(_has(x), p).otherwise(0.0) for x, p in parts), F.lit(0.0))


def receipt_confidence(merchant, date, total, subtotal, tax, n_items: Column) -> Column:
    return F.bround(F.least(F.lit(1.0),
        _points((merchant, 0.15), (date, 0.15), (total, 0.2), (subtotal, 0.1), (tax, 0.1))
        + F.least(n_items * 0.05, F.lit(0.1))), 4)


def receipt_record() -> Column:
    """A receipt's facts as one nested record, items included."""
    return F.struct("merchant", "date", "total_amount", "subtotal", "tax", "tax_rate", "items", "payment_method",
        "extraction_confidence")


def found_once(facts: DataFrame, tag: str, *columns: str) -> DataFrame:
    """``facts`` as a table in the shared folder, or ``columns`` of them.

    What is decided from facts would else be evaluated together with their patterns: a filter on a total repeats its search, and
    the code of all patterns with their uses outgrows what the JVM compiles.
    """
    return materialize(facts.select(*columns) if columns else facts, tag)


def receipt_facts(docs: DataFrame, text: str = "raw_text") -> DataFrame:
    t = F.col("__t")
    rows = docs.withColumn("__t", receipt_normalize(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.withColumns({
        "merchant": receipt_merchant(t), "date": receipt_date(t), "total_amount": receipt_total(t),
        "subtotal": receipt_subtotal(t), "tax": receipt_tax(t), "tax_rate": percent_rate(t),
        "items": receipt_items(t), "payment_method": payment_method(t)}).drop("__t")
    c = F.col
    return rows.withColumn("extraction_confidence",
        receipt_confidence(c("merchant"), c("date"), c("total_amount"), c("subtotal"), c("tax"), count_of("items")))


# statements -----------------------------------------------------------------


def statement_normalize(text: Column) -> Column:
    """Dates and amounts that recognition split are joined; a reference number keeps its distance from the amount after it."""
    return F.trim(chain(text,
        [(r"(\d{2})\s+(\d{2})\s+(\d{4})", "$1/$2/$3"), (r"(?<!#\d{0,12})(\d)\s(\d{3}\.\d{2})", "$1$2"),
            (r"[ \t]+", " ")]))


#: Words of a statement's head that are no holder's name.
NOT_HOLDERS = ("STATEMENT", "ACCOUNT", "BALANCE", "PERIOD")


def account_holder(text: Column) -> Column:
    heads = F.filter(F.slice(nonblank_lines(text), 1, 5),
        lambda x: F.rlike(x, F.lit(r"^[A-Z]{2,20}\s+[A-Z]{2,20}$")) & ~contains_any(x, NOT_HOLDERS))
    return title(F.get(heads, F.lit(0)))


def _slash_day(x: Column) -> Column:
    return F.when(F.rlike(x, F.lit(r"^\d{1,2}/\d{1,2}/\d{4}$")), _parts(x, r"(\d{1,2})/(\d{1,2})/(\d{4})", (3, 1, 2)))


def statement_period(text: Column) -> Column:
    """Struct (start, end), null unless both are slash dates."""
    p = r"(?i)(?:Statement\s+)?Period[:\s]+(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\s+(?:to|through|-)\s+(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"
    a, b = (_slash_day(first_match(text, p, g)) for g in (1, 2))
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("start"), b.alias("end")))


def beginning_balance(text: Column) -> Column:
    return amount_after(text, r"Beginning\s+Balance[:\s]*\$?" + AMOUNT)


def ending_balance(text: Column) -> Column:
    return amount_after(text, r"Ending\s+Balance[:\s]*\$?" + AMOUNT)


def statement_transactions(text: Column) -> Column:
    """``array<struct<date, description, amount, transaction_type, balance>>`` of the lines that start with a date and have two amounts."""
    figure = r"([\-\d,]+\.\d{2})"

    def parse(line: Column) -> Column:
        rest = F.trim(F.regexp_replace(line, r"^\d{1,2}/\d{1,2}/\d{4}\s+", ""))
        plain = lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")
        return let(F.struct(rest.alias("rest"), F.regexp_extract_all(rest, F.lit(figure), F.lit(1)).alias("a")),
            lambda z: F.struct(
            _slash_day(first_match(line, r"^(\d{1,2}/\d{1,2}/\d{4})")).alias("date"),
            squeeze(F.regexp_replace(z["rest"], figure, "")).alias("description"),
            plain(F.replace(F.try_element_at(z["a"], F.lit(-2)), F.lit("-"), F.lit(""))).alias("amount"),
            F.when(contains_any(F.upper(z["rest"]), ("DEPOSIT", "TRANSFER")), "credit").otherwise("debit")
            .alias("transaction_type"), plain(F.try_element_at(z["a"], F.lit(-1))).alias("balance")))

    dated = F.filter(nonblank_lines(text),
        lambda x: F.rlike(x, F.lit(r"^\d{1,2}/\d{1,2}/\d{4}\s+"))
        & (F.size(F.regexp_extract_all(F.regexp_replace(x, r"^\S+\s+", ""), F.lit(figure), F.lit(1))) >= 2))
    return F.transform(dated, parse)


def statement_confidence(holder, period, begin, end, n: Column) -> Column:
    return F.bround(F.least(F.lit(1.0),
        _points((holder, 0.2), (F.when(period.isNotNull(), "x"), 0.2), (begin, 0.15), (end, 0.15))
        + F.least(n * 0.03, F.lit(0.3))), 2)


def statement_facts(docs: DataFrame, text: str = "raw_text") -> DataFrame:
    t = F.col("__t")
    rows = docs.withColumn("__t", statement_normalize(F.coalesce(F.col(text), F.lit("")))).withColumns({
        "account_holder": account_holder(t), "statement_period": statement_period(t),
        "beginning_balance": beginning_balance(t), "ending_balance": ending_balance(t),
        "transactions": statement_transactions(t)}).drop("__t")
    c = F.col
    return rows.withColumn("extraction_confidence",
        statement_confidence(c("account_holder"), c("statement_period"), c("beginning_balance"), c("ending_balance"),
            count_of("transactions")))


# invoices -------------------------------------------------------------------


def invoice_number(text: Column) -> Column:
    first = F.upper(first_match(text, r"(?i)Invoice\s*(?:#|No|Number)\s*[:\s]*([A-Z0-9\-]{5,30})"))
    return F.coalesce(F.nullif(first, F.lit("INVOICE")), F.upper(first_match(text, r"(?i)(INV[-\d]{5,30})")))


def invoice_vendor(text: Column) -> Column:
    """The first of five lines that is no heading, number line or short."""
    heads = F.filter(F.slice(nonblank_lines(text), 1, 5),
        lambda x: ~F.contains(F.lower(x), F.lit("invoice")) & ~F.startswith(x, F.lit("#")) & (F.length(x) > 5)
        & F.rlike(x, F.lit("[A-Za-z]")))
    return title(F.get(heads, F.lit(0)))


def invoice_client(text: Column) -> Column:
    return title(F.trim(first_match(text, r"(?im)^\s*(?:Bill To|Billed To|Client|Customer|To)\b[:\s]*\n?([^\n]+)")))


def invoice_date(text: Column) -> Column:
    """The day after ``Date``, not after ``Due Date``."""
    return _short(first_match(text, r"(?i)(?<!Due )(?<!Due  )\bDate[:\s]+(\d{1,2}/\d{1,2}/\d{2,4})"))


def due_date(text: Column) -> Column:
    return _short(first_match(text, r"(?i)Due\s+Date[:\s]+(\d{1,2}/\d{1,2}/\d{2,4})"))


def _short(x: Column) -> Column:
    year = F.regexp_extract(x, r"/(\d{2,4})$", 1)
    full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    return F.date_format(F.try_to_date(
        F.concat_ws("-", full, F.lpad(F.regexp_extract(x, r"^(\d+)/", 1), 2, "0"),
            F.lpad(F.regexp_extract(x, r"^\d+/(\d+)/", 1), 2, "0"))), "yyyy-MM-dd")


def invoice_line_items(text: Column) -> Column:
    """``array<struct<description, quantity, unit_price, amount>>`` of lines with four parts that parse."""
    cells = F.transform(F.split(text, "\n"), lambda x: F.transform(F.split(x, r"\|"), lambda p: F.trim(p)))
    money = lambda x: F.regexp_replace(x, "[$,]", "").try_cast("double")
    rows = F.transform(F.filter(cells, lambda p: F.size(p) == 4),
        lambda p: F.struct(p[0].alias("description"), p[1].try_cast("int").alias("quantity"),
            money(p[2]).alias("unit_price"), money(p[3]).alias("amount")))
    return F.filter(rows, lambda r: r["quantity"].isNotNull() & r["unit_price"].isNotNull() & r["amount"].isNotNull())


def payment_terms(text: Column) -> Column:
    return F.trim(first_match(text, r"(?i)(?:Payment\s+Terms|Terms)[:\s]+([^\n]+)"))


#: Words that make an invoice more certain.
INVOICE_WORDS = ("invoice", "total", "payment", "subtotal")


def invoice_confidence(number_, vendor, date, due, n: Column, subtotal, total, text: Column) -> Column:
    hits = sum((F.contains(F.lower(text), F.lit(w)).cast("int") for w in INVOICE_WORDS), F.lit(0))
    base = _points((number_, 0.15), (vendor, 0.15), (date, 0.15), (due, 0.1), (subtotal, 0.1), (total, 0.1))
    return F.bround(F.least(F.lit(1.0), base + F.least(n * 0.05, F.lit(0.15)) + F.least(hits * 0.02, F.lit(0.1))), 4)


def invoice_facts(docs: DataFrame, text: str = "raw_text") -> DataFrame:
    t, c = F.coalesce(F.col(text), F.lit("")), F.col
    rows = docs.withColumns({
        "invoice_number": invoice_number(t), "vendor": invoice_vendor(t), "client": invoice_client(t),
        "invoice_date": invoice_date(t), "due_date": due_date(t), "line_items": invoice_line_items(t),
        "subtotal": amount_after(t, r"Subtotal[:\s]*\$?" + AMOUNT), "tax": amount_after(t, r"Tax.*?\$" + AMOUNT),
        "tax_rate": percent_rate(t), "total_due": amount_after(t, r"Total\s+Due[:\s]*\$?" + AMOUNT),
        "payment_terms": payment_terms(t)})
    return rows.withColumn("extraction_confidence",
        invoice_confidence(c("invoice_number"), c("vendor"), c("invoice_date"), c("due_date"), count_of("line_items"),
            c("subtotal"), c("total_due"), t))


# transactions of documents --------------------------------------------------

#: Words that make a document's transaction income or a transfer, and stand-in categories without a model.
INCOME_WORDS = ("payroll", "deposit", "salary", "refund", "direct deposit", "payment received", "interest")
TRANSFER_WORDS = ("transfer", "atm", "withdrawal", "move money")
MOCK = {
    "food": ("grocery", "restaurant", "cafe", "food", "trader", "yogurt"),
    "transport": ("gas", "uber", "shell", "fuel", "oil"), "income": ("payroll", "deposit", "salary"),
    "business": ("consulting", "software", "services", "license"),
}


def transaction_type(merchant: Column, description: Column) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(merchant, F.lit("")), F.coalesce(description, F.lit(""))))
    return F.when(contains_any(text, INCOME_WORDS), "income").when(contains_any(text, TRANSFER_WORDS),
        "transfer").otherwise("expense")


def mock_categorize(merchant: Column, description: Column) -> Column:
    """Struct (category, confidence) by words; ``other`` at 0.5."""
    text = F.lower(F.concat_ws(" ", F.coalesce(merchant, F.lit("")), F.coalesce(description, F.lit(""))))
    out = F.struct(F.lit("other").alias("category"), F.lit(0.5).alias("confidence"))
    for name, words in reversed(MOCK.items()):
        out = F.when(contains_any(text, words),
            F.struct(F.lit(name).alias("category"), F.lit(0.75).alias("confidence"))).otherwise(out)
    return out


def signed_amount(kind: Column, amount: Column) -> Column:
    return F.when(kind == "expense", -F.abs(amount)).when(kind == "income", F.abs(amount)).otherwise(amount)


def final_confidence(evidence: Column, category: Column) -> Column:
    return F.bround(0.6 * evidence + 0.4 * category, 4)


def final_status(final: Column, category: Column, evidence: Column) -> Column:
    return F.when((category < 0.25) | (evidence < 0.4), "manual_review").when(final >= 0.6,
        "verified").when(final >= 0.45, "low_confidence").otherwise("manual_review")


def process_documents(docs: DataFrame) -> DataFrame:
    """Transactions of typed documents (document_id, doc_type, raw_text, ocr_confidence): one for a receipt or an invoice that has a total and a date, one for each row of a statement."""
    ocr = lambda default: F.when(F.coalesce("ocr_confidence", F.lit(0.0)) <= 0,
        default).otherwise(F.col("ocr_confidence"))
    base = ("document_id", "doc_type", "ocr_confidence", "extraction_confidence")
    receipts = found_once(receipt_facts(docs.where("doc_type = 'receipt'")), "receipts", *base, "merchant", "items", "date", "total_amount").where(
        "total_amount is not null and total_amount <> 0 and date is not null").select(
        "document_id", "doc_type", "merchant",
        F.array_join(F.transform(F.slice("items", 1, 3), lambda x: x["name"]), ", ").alias("description"), "date",
        F.col("total_amount").alias("amount"),
        trust.composite_confidence(ocr(0.95), F.col("extraction_confidence"), F.lit(0.92)).alias("evidence"))
    rows = found_once(statement_facts(docs.where("doc_type = 'statement'")), "statements", *base, "transactions").select("document_id", "doc_type",
        trust.composite_confidence(ocr(0.93), F.col("extraction_confidence"), F.lit(0.90)).alias("evidence"),
        F.explode("transactions").alias("t"))
    statements = rows.select("document_id", "doc_type",
        F.array_join(F.slice(F.split("t.description", " "), 1, 2), " ").alias("merchant"),
        F.col("t.description").alias("description"), F.col("t.date").alias("date"), F.col("t.amount").alias("amount"),
        "evidence")
    invoices = found_once(invoice_facts(docs.where("doc_type = 'invoice'")), "invoices", *base, "vendor", "line_items", "invoice_date", "total_due").where(
        "total_due is not null and total_due <> 0 and invoice_date is not null").select(
        "document_id", "doc_type", F.col("vendor").alias("merchant"),
        F.array_join(F.transform(F.slice("line_items", 1, 3), lambda x: x["description"]), ", ").alias("description"),
        F.col("invoice_date").alias("date"),
        F.col("total_due").alias("amount"),
        trust.composite_confidence(ocr(0.94), F.col("extraction_confidence"), F.lit(0.91)).alias("evidence"))
    out = receipts.unionByName(statements).unionByName(invoices).withColumn("c",
        mock_categorize(F.col("merchant"), F.col("description")))
    out = out.withColumns({"category": F.col("c.category"),
        "transaction_type": transaction_type(F.col("merchant"), F.col("description")),
        "confidence": final_confidence(F.col("evidence"), F.col("c.confidence"))})
    return out.withColumn("status",
        final_status(F.col("confidence"), F.col("c.confidence"), F.col("evidence"))).drop("c")


def preprocess(docs: DataFrame) -> DataFrame:
    """All stages before extraction: load checks, quality gate, geometry, recognition's output, type and route, text structure.

    ``docs``: document_id, raw_text, ocr_confidence, width, height, sharpness, noise, contrast, and if there are such:
    ``load_error`` (a file that could not be loaded), ``turn`` (detected orientation), ``skew_angle`` (measured) and ``cropped``.
    What fails says so in ``error`` and ``status`` and has no later stage: ``load_failed``, ``validation_failed``, ``quality_too_low``.
    Adds quality_score, resolution, route, preprocessing_applied, orientation_angle, skew_angle, doc_type, type_confidence,
    type_status, strategy, structure.
    """
    c = F.col
    given = lambda name, kind: c(name).cast(kind) if name in docs.columns else F.lit(None).cast(kind)
    rows = docs.withColumns({
        "resolution": F.least(c("width") * c("height") / 1e6, F.lit(1.0)),
        "quality_score": quality_overall(c("sharpness"), c("noise"), c("contrast"), c("width") * c("height"))})
    rows = rows.withColumn("route", quality_route(c("quality_score"), c("sharpness")))
    poor = (c("quality_score") < 0.3) | (c("route") == "reject_or_manual")
    error = F.when(given("load_error", "string").isNotNull(),
        "load_failed").when((c("width") < 200) | (c("height") < 200), "validation_failed").when(poor, "quality_too_low")
    rows = rows.withColumn("error", error)
    fine = lambda x: F.when(c("error").isNull(), x)
    rows = rows.withColumns({
        "orientation_angle": fine(F.coalesce(given("turn", "int"), orientation(c("width"), c("height")))),
        "skew_angle": fine(deskew_angle(F.coalesce(given("skew_angle", "double"), F.lit(0.0)))),
        "t": fine(doc_type(c("raw_text"), c("width"), c("height")))})
    advice = quality_recommendations(c("sharpness"), c("noise"), c("contrast"), c("resolution"))
    steps = F.concat(advice,
        geometry_steps(c("orientation_angle"), c("skew_angle"), F.coalesce(given("cropped", "boolean"), F.lit(False))))
    return rows.withColumns({
        "preprocessing_applied": fine(F.array_distinct(steps)), "doc_type": c("t.type"),
        "type_confidence": c("t.confidence"), "type_status": c("t.status"),
        "strategy": routing_decision(c("t.type"), c("t.confidence")),
        "structure": fine(text_structure(F.coalesce("raw_text", F.lit("")))),
        "status": F.when(c("error").isNull(), "success").otherwise("error")}).drop("t")


def enhanced(docs: DataFrame, today: Column) -> DataFrame:
    """Transactions of preprocessed documents without duplicates, each with trust, partial-match flag and evidence chain; unknown types count as receipts.

    A receipt or an invoice with amount and date gives one row, a statement a row for each of its transactions, all with the
    document's trust. Columns: document_id, doc_type, merchant, description, date, amount, completeness, consistency,
    confidence (the trust score), status, partial (null for statements' rows), chain. Documents are typed and freed of duplicates once,
    before the three kinds of extraction.
    """
    c = F.col
    rows = trust.duplicates(docs, "document_id", "raw_text").where("not is_duplicate")
    kind = F.when(c("doc_type") == "unknown", "receipt").otherwise(c("doc_type"))
    rows = materialize(rows.select("document_id", "raw_text", "quality_score", "ocr_confidence",
        kind.alias("doc_type")), "typed")
    of = lambda k: rows.where(c("doc_type") == k)
    nothing = F.lit(None).cast("double")
    filled = lambda *xs: [c(x).isNotNull() for x in xs]

    def scored(facts: DataFrame, complete: list[Column], date: Column, total: Column, subtotal: Column, tax: Column,
        zero_is_wrong: bool = False) -> DataFrame:
        share = sum((F.coalesce(x, F.lit(False)).cast("int") for x in complete), F.lit(0)) / float(len(complete))
        out = facts.withColumns({"completeness": share,
            "consistency": trust.consistency(F.to_date(date), total, subtotal, tax, today, zero_is_wrong)})
        out = out.withColumn("trust",
            trust.trust_score(c("quality_score"), c("ocr_confidence"), c("completeness"), c("consistency")))
        evidence = trust.composite_confidence(trust.unit(c("ocr_confidence")), c("extraction_confidence"),
            trust.unit(c("quality_score")))
        return out.withColumns({"partial": trust.partial_match_flag(c("raw_text"), subtotal, tax, total),
            "evidence": evidence})

    def made(facts: DataFrame, merchant: Column, description: Column, date: Column, amount: Column, fact: str,
        value: Column, partial: Column) -> DataFrame:
        chain_ = trust.build_chain(F.to_json(value), F.lit(fact), c("raw_text"), c("evidence"),
            0.6).withField("status", c("trust.status"))
        return facts.select(
            "document_id", "doc_type", merchant.alias("merchant"), description.alias("description"),
            date.alias("date"), amount.alias("amount"), "completeness", "consistency",
            c("trust.trust_score").alias("confidence"), c("trust.status").alias("status"), partial.alias("partial"),
            chain_.alias("chain"))

    def single(facts: DataFrame, merchant: str, date: str, amount: str, fact: str) -> DataFrame:
        value = F.struct(c(merchant).alias("merchant"), c(amount).alias("amount"), c(date).alias("date"))
        return made(facts.where(c(amount).isNotNull() & c(date).isNotNull()), c(merchant), F.lit(None).cast("string"),
            c(date), c(amount), fact, value, c("partial"))

    receipts = scored(found_once(receipt_facts(of("receipt")), "receipts"), filled("merchant", "date", "total_amount"), c("date"),
        c("total_amount"), c("subtotal"), c("tax"))
    invoices = scored(found_once(invoice_facts(of("invoice")), "invoices"), filled("vendor", "invoice_date", "total_due"), c("invoice_date"),
        c("total_due"), c("subtotal"), c("tax"), True)
    statements = scored(found_once(statement_facts(of("statement")), "statements"),
        [*filled("account_holder", "statement_period"), F.size("transactions") > 0], F.lit(None).cast("string"),
        nothing, nothing, nothing)
    lines = statements.withColumn("t", F.explode("transactions"))
    words = F.slice(F.split(F.trim("t.description"), r"\s+"), 1, 2)
    name = F.when(F.coalesce("t.description", F.lit("")) == "", "Unknown").otherwise(F.array_join(words, " "))
    value = F.struct(c("t.description").alias("desc"), c("t.amount").alias("amount"))
    none = F.lit(None).cast(receipts.schema["partial"].dataType)
    each = made(lines, name, c("t.description"), c("t.date"), c("t.amount"), "statement_transaction", value, none)
    return single(receipts, "merchant", "date", "total_amount",
        "receipt").unionByName(each).unionByName(single(invoices, "vendor", "invoice_date", "total_due", "invoice"))
