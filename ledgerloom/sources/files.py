"""Files in and out: CSV, JSON, document folders, uploaded bank statements and generated test ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.sources.headers import with_headers

RAW_SCHEMA = "transaction_id string, date date, amount double, merchant_raw string, description string, category_hint string"
#: Which column an uploaded one becomes, by the first of these that its name contains.
UPLOAD_RULES = (("date", ("date",)), ("amount", ("amount", "debit", "credit")),
    ("merchant_raw", ("merchant", "description", "narration")), ("category", ("category",)))
EXTENSIONS = ("png", "jpg", "jpeg", "tiff", "bmp", "pdf")
MAX_BYTES = 10 * 1024 * 1024


def read_csv(spark: SparkSession, path: str, schema: str | StructType = RAW_SCHEMA) -> DataFrame:
    """A CSV scan with a given schema: no pass over the data to infer one."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_goals(spark: SparkSession, path: str) -> DataFrame:
    """(goal_name, limit, target) of a JSON file's ``user_goals`` object."""
    raw = spark.read.option("multiLine", True).option("primitivesAsString",
        True).schema("user_goals map<string, struct<limit: double, target: double, period: string>>").json(path)
    return raw.select(F.explode("user_goals").alias("goal_name", "g")).select("goal_name", "g.limit", "g.target")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def as_report(df: DataFrame, name: str) -> DataFrame:
    """One JSON text with all rows of a small result under ``name``, for a report file."""
    return df.agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))).alias("json"))


def normalize_upload(df: DataFrame) -> DataFrame:
    """An uploaded bank table in the library's columns: transaction_id, date, amount, merchant_raw, category, and what else it has.

    Names are lower-cased and matched by what they contain, first rule first. Where several columns become one, the first that is not null counts;
    separate credits are income and separate debits are negative. Dates that do not parse are null. Missing ids are numbered in the order of all
    columns' hash, so they do not depend on partitioning; a missing category is ``uncategorized``.
    """
    found: dict[str, list[Column]] = {}
    both = {n.strip().lower() for n in df.columns}
    split = not any("amount" in n for n in both) and any("debit" in n for n in both) and any(
        "credit" in n for n in both)
    for name in df.columns:
        low = name.strip().lower()
        target = next((t for t, words in UPLOAD_RULES if any(w in low for w in words)), low)
        value = F.col(f"`{name}`")
        if target == "amount":
            value = F.regexp_replace(value.cast("string"), r"[$,\s]", "").try_cast("double")
            value = -F.abs(value) if split and "debit" in low else F.abs(value) if split else value
        if target == "date":
            s = value.cast("string")
            value = F.coalesce(s.try_cast("date"), *(F.try_to_date(s, f) for f in ("M/d/yyyy", "d/M/yyyy")))
        found.setdefault(target, []).append(value)
    out = df.select(*(F.coalesce(*v).alias(k) for k, v in found.items()))
    if "category" not in found:
        out = out.withColumn("category", F.lit("uncategorized"))
    if "transaction_id" not in found:
        # numbered within hash buckets and offset by the buckets' sizes: no single task sorts the table
        from pyspark.sql import Window

        hashed = out.withColumn("__h", F.xxhash64(*out.columns)).withColumn("__b", F.pmod("__h", F.lit(1024)))
        sizes = hashed.groupBy("__b").agg(F.count("*").alias("__n"))
        start = sizes.select("__b",
            (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__o"))  # 1024 rows at most
        rank = F.row_number().over(Window.partitionBy("__b").orderBy("__h", *out.columns))
        out = hashed.withColumn("__r", rank).join(start, "__b").withColumn("transaction_id",
            F.format_string("txn_%04d", F.col("__r") + F.col("__o"))).drop("__h", "__b", "__n", "__o", "__r")
    return out


def read_documents(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Document files with their metadata and, instead of exceptions, an ``error`` column. Content is read only where it is selected."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup",
        True).load(folder)
    return with_file_errors(files.withColumnRenamed("length", "size"))


def load_documents(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Document files with size, width, height, mode and pages from their own bytes, or an ``error``; see ``headers.with_headers``. Files without a byte are not listed."""
    return with_headers(read_documents(spark, folder, pattern))


def with_file_errors(files: DataFrame) -> DataFrame:
    """``files`` (path, size) with ``extension`` and ``error``: an unknown type or over 10 MB."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    error = F.when(~ext.isin(*EXTENSIONS),
        F.concat(F.lit("unsupported format: "), ext)).when(F.col("size") > MAX_BYTES, "file too large")
    return files.withColumns({"extension": ext, "error": error})


def valid_documents(files: DataFrame) -> DataFrame:
    """Files without an error, at least 200 by 200, in RGB or grey."""
    return files.where("error is null and width >= 200 and height >= 200 and mode in ('RGB', 'L')")


def document_summary(path: Column, extension: Column, size: Column, width: Column, height: Column, pages: Column,
    valid: Column) -> Column:
    return F.format_string("File: %s\nFormat: %s\nSize: %d bytes\nDimensions: %dx%d\nPages: %d\nValid: %s", path,
        extension, size, width, height, pages, valid.cast("string"))


def counts_by_type(files: DataFrame) -> DataFrame:
    return files.groupBy("extension").agg(F.count("*").alias("files"),
        F.count_if(F.col("error").isNull()).alias("loaded"))


def generate_transactions(spark: SparkSession, months: int = 6, per_month: int = 48, start: str = "2026-01-01",
    seed: int = 42) -> DataFrame:
    """A ledger of test transactions with planted patterns, from row numbers and hashes alone: any size, in parallel, the same each time.

    Groceries rise by 10 % a month from April on, dining is 2.5 times as high in April, one purchase in 89 is 3.5
    times too high, and in May a paycheck is missing and there are 1.5 times as many dining and shopping rows. ``pattern_tag`` says which applies: anomaly, dining_spike, grocery_drift, savings_drop or baseline.
    """
    c = F.col
    u = lambda k: F.pmod(F.xxhash64(c("id"), F.lit(seed + k)), F.lit(10_000)) / 10_000.0
    rows = spark.range(months * per_month).withColumns(
        {"m": (c("id") / per_month).cast("int"), "i": c("id") % per_month})
    rows = rows.withColumn("date",
        F.date_add(F.add_months(F.lit(start).cast("date"), c("m")), (c("i") % 28).cast("int")))
    kinds = ("dining", "groceries", "shopping", "transportation", "utilities")
    category = F.when(c("i") < 2,
        "income").otherwise(F.element_at(F.array(*map(F.lit, kinds)), (c("i") % len(kinds) + 1).cast("int")))
    rows = rows.withColumn("category", category).withColumn("month_no", F.month("date"))
    # dining is every fifth row from the sixth on and shopping from the third: every second of a month is doubled, rounded down
    second = F.when(c("category") == "dining", 0).when(c("category") == "shopping", 1)
    more = rows.where((c("month_no") == 5) & ((c("i") / len(kinds)).cast("int") % 2 == second))
    rows = rows.union(more.withColumn("id", c("id") + months * per_month))
    odd = (c("id") % 89 == 50) & (c("category") != "income")
    tag = F.when(odd, "anomaly").when((c("category") == "dining") & (c("month_no") == 4),
        "dining_spike").when((c("category") == "groceries") & (c("month_no") >= 4),
        "grocery_drift").when(c("month_no") == 5, "savings_drop").otherwise("baseline")
    factor = F.when(odd, 3.5).when(tag == "dining_spike", 2.5).when(tag == "grocery_drift",
        1 + 0.1 * (c("month_no") - 3)).otherwise(1.0)
    rows = rows.where(~((c("category") == "income") & (c("month_no") == 5) & (c("i") == 1)))
    amount = F.when(c("category") == "income", 2500.0).otherwise(-(10 + 80 * u(1)) * factor)
    return rows.select(
        F.format_string("txn_%04d", c("id") + 1).alias("transaction_id"), "date",
        F.bround(amount, 2).cast("decimal(18,2)").alias("amount"),
        F.concat(F.upper("category"), F.lit(" MERCHANT #"), F.pmod(F.xxhash64("id"), F.lit(20)).cast("string"))
        .alias("merchant_raw"),
        "category", odd.alias("is_anomaly"), (c("category").isin("income", "utilities")).alias("is_recurring"),
        tag.alias("pattern_tag"))


#: Merchants, bank customers and vendors of generated documents.
STORES, HOLDERS, VENDORS = ("CORNER MARKET", "GREEN GROCER", "CITY HARDWARE"), ("MARY MAJOR",
    "RICHARD ROE"), ("NORTHWIND SUPPLIES LTD", "LAKESIDE CONSULTING LLC")
#: Degradations of generated documents, with what they leave of sharpness, noise and contrast.
DEGRADATIONS = {"clean": (0.9, 0.9, 0.9), "blur": (0.35, 0.85, 0.8), "noise": (0.7, 0.3, 0.75),
    "faded": (0.75, 0.8, 0.2)}


def generate_documents(spark: SparkSession, per_type: int = 10, start: str = "2026-01-01", seed: int = 42) -> DataFrame:
    """Test documents of the three types as recognised text, with their true values, from row numbers and hashes alone: any size, in parallel.

    Columns: document_id, doc_type, raw_text, degradation, sharpness, noise, contrast, width, height, ocr_confidence, and the truth: merchant,
    date, amount (a statement's ending balance).
    """
    c, line = F.col, lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)),
        (F.pmod(F.xxhash64(c("id"), F.lit(seed + k)), F.lit(len(values))) + 1).cast("int"))
    cents = lambda k, least, most: F.lit(least) + F.pmod(F.xxhash64(c("id"), F.lit(seed + k)),
        F.lit(most - least))
    money = lambda x: F.format_string("%.2f", x / 100.0)
    rows = spark.range(3 * per_type).withColumn("doc_type",
        F.element_at(F.array(*map(F.lit, ("receipt", "statement", "invoice"))), (c("id") % 3 + 1).cast("int")))
    rows = rows.withColumns({
        "one": cents(1, 200, 4000), "two": cents(2, 200, 4000), "store": pick(STORES, 3), "holder": pick(HOLDERS, 4),
        "vendor": pick(VENDORS, 5), "degradation": pick(tuple(DEGRADATIONS), 6),
        "day": F.date_add(F.lit(start).cast("date"),
            F.pmod(F.xxhash64(c("id"), F.lit(seed + 7)), F.lit(28)).cast("int"))})
    rows = rows.withColumns({"sub": c("one") + c("two"), "slashes": F.date_format("day", "M/d/yyyy")}).withColumn(
        "tax", F.floor(c("sub") * 6 / 100))
    receipt = line(c("store"), "\n", c("slashes"), "\n", "2x Green Tea $", money(c("one")), "\n", "Brown Bread $",
        money(c("two")), "\n",
                   "SUBTOTAL $", money(c("sub")), "\n", "TAX 6.0% $", money(c("tax")), "\n", "TOTAL $",
                   money(c("sub") + c("tax")), "\nPaid: VISA")
    statement = line("SECOND NATIONAL BANK STATEMENT\n", c("holder"), "\n",
        "Statement Period: 1/1/2026 to 1/31/2026\n", "Beginning Balance: $", money(c("sub")), "\n",
                     c("slashes"), " ", c("store"), " ", money(c("one")), " ", money(c("two")), "\n", c("slashes"),
                     " DIRECT DEPOSIT ", money(c("sub")), " ", money(c("sub") + c("two")), "\n",
                     "Ending Balance: $", money(c("sub") + c("two")))
    invoice = line(c("vendor"), "\n", "Invoice #INV-", (c("id") + 1000).cast("string"), "\n", "Date: ", c("slashes"),
        "\n", "Due Date: 12/31/2026\nBill To:\nsample client\n", "Item | Qty | Price | Amount\n",
                   "Consulting | 1 | $", money(c("sub")), " | $", money(c("sub")), "\n", "Subtotal: $",
                   money(c("sub")), "\n", "Tax (6%): $", money(c("tax")), "\n",
                   "Total Due: $", money(c("sub") + c("tax")), "\nPayment Terms: Net 30")
    kind = lambda r, s, i: F.when(c("doc_type") == "receipt", r).when(c("doc_type") == "statement",
        s).otherwise(i)
    left = lambda k: F.element_at(F.create_map(*(F.lit(x) for d, v in DEGRADATIONS.items() for x in (d, v[k]))),
        c("degradation"))
    return rows.select(
        F.format_string("doc_%04d", c("id") + 1).alias("document_id"), "doc_type",
        kind(receipt, statement, invoice).alias("raw_text"), "degradation",
        left(0).alias("sharpness"), left(1).alias("noise"), left(2).alias("contrast"), F.lit(800).alias("width"),
        F.lit(1200).alias("height"), (60 + 39 * left(0)).alias("ocr_confidence"),
        kind(c("store"), c("holder"), c("vendor")).alias("merchant"), "day",
        (kind(c("sub") + c("tax"), c("sub") + c("two"), c("sub") + c("tax")) / 100.0)
        .alias("amount")).withColumnRenamed("day", "date")
