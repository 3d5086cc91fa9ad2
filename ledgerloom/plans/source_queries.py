"""Queries of sources, explanations and streaming forms, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.storage import shared_dir
from ledgerloom.operators import documents, explain, reconcile
from ledgerloom.plans.behavior_queries import _EVENTS, _events
from ledgerloom.plans.enrich_queries import _title
from ledgerloom.sources import files as f
from ledgerloom.sources.headers import with_headers
from ledgerloom.sources.tables import TRANSACTIONS, transactions
from ledgerloom.streaming import live

c = F.col
#: The tables of a data folder, a file each.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _upload(s, d) -> DataFrame:
    tx = transactions(s, d)
    return tx.select(c("transaction_id").alias("Transaction_ID"), F.date_format("date", "MM/dd/yyyy").alias("Posting Date"), F.when(c("amount") < 0, F.abs("amount").cast("string")).alias("Debit"),
                     F.when(c("amount") >= 0, F.concat(F.lit("$"), c("amount").cast("string"))).alias("Credit"), c("merchant_raw").alias(" Narration "))


def _files(s, d) -> DataFrame:
    o = s.read.parquet(f"{d}/orders.parquet")
    ext = F.element_at(F.array(*map(F.lit, ("png", "PDF", "docx", "jpg"))), (c("o_orderkey") % 4 + 1).cast("int"))
    rows = o.select(F.concat(F.lit("/in/doc"), c("o_orderkey").cast("string"), F.lit("."), ext).alias("path"), (c("o_orderkey") * 1000).alias("size"), (100 + c("o_orderkey") % 500).cast("int").alias("width"), F.lit(400).alias("height"), F.when(c("o_orderkey") % 5 == 0, "CMYK").otherwise("RGB").alias("mode"))
    return f.with_file_errors(rows)


def _little(x, size: int):
    """The hexadecimal digits of a number, lowest byte first."""
    digits = F.lpad(F.hex(x), 2 * size, "0")
    return F.concat(*(F.substring(digits, 2 * k - 1, 2) for k in range(size, 0, -1)))


def _contents(s, d) -> DataFrame:
    """A file of each kind for each order, as bytes with sizes from its key; every eleventh is cut off after ten bytes."""
    o = s.read.parquet(f"{d}/orders.parquet").select(c("o_orderkey").cast("bigint").alias("k"))
    o = o.withColumns({"w": 100 + c("k") % 1000, "h": 150 + c("k") % 700, "kind": F.element_at(F.array(*map(F.lit, ("png", "jpg", "bmp", "tiff", "pdf", "txt"))), (c("k") % 6 + 1).cast("int"))})
    big = lambda x, n: F.lpad(F.hex(x), 2 * n, "0")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(c("w"), 4), big(c("h"), 4), F.lit("08"), F.when(c("k") % 4 == 0, "06").otherwise("02"), F.lit("000000"))
    jpg = F.concat(F.lit("FFD8FFE00010"), F.lit("00" * 14), F.lit("FFDB0004AAAAFFC2001108"), big(c("h"), 2), big(c("w"), 2), F.lit("03"))
    bmp = F.concat(F.lit("424D" + "00" * 16), _little(c("w"), 4), F.when(c("k") % 4 == 2, _little(4294967296 - c("h"), 4)).otherwise(_little(c("h"), 4)), F.lit("01001800"))
    entry = lambda tag, kind, value: F.concat(F.lit(tag), F.lit(kind), F.lit("01000000"), value)
    page = lambda after: F.concat(F.lit("0300"), entry("0001", "0300", F.concat(_little(c("w"), 2), F.lit("0000"))), entry("0101", "0400", _little(c("h"), 4)), entry("0601", "0300", F.lit("02000000")), F.lit(after))
    tiff = F.concat(F.lit("49492A0008000000"), page("32000000"), page("00000000"))
    pdf = F.hex(F.concat(F.lit("%PDF-1.4 1 0 obj << /Type /Pages >> 2 0 obj << /Type /Page /MediaBox [0 0 "), c("w").cast("string"), F.lit(" "), c("h").cast("string"), F.lit("] >> 3 0 obj << /Type/Page >>")))
    hexes = F.lit("00")
    for name, x in (("png", png), ("jpg", jpg), ("bmp", bmp), ("tiff", tiff), ("pdf", pdf)):
        hexes = F.when(c("kind") == name, x).otherwise(hexes)
    content = F.unhex(F.when(c("k") % 11 == 0, F.substring(hexes, 1, 20)).otherwise(hexes))
    return f.with_file_errors(o.select(F.concat(F.lit("/in/"), c("k").cast("string"), F.lit("."), "kind").alias("path"), content.alias("content")).withColumn("size", F.octet_length("content")))


def _parquet_events(s, d) -> DataFrame:
    return s.read.parquet(f"{d}/events.parquet")


def _written(spark, df: DataFrame, write) -> str:
    """Write ``df`` to a new place in the shared folder; returns the place."""
    path = f"{shared_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    write(df, path)
    return path


def _csv(s, d) -> DataFrame:
    """Raw bank rows, written as CSV and read again with the fixed schema."""
    tx = transactions(s, d)
    raw = tx.select("transaction_id", "date", c("amount").cast("double").alias("amount"), "merchant_raw", F.when(c("ord") % 3 == 0, 'a "quoted", text').alias("description"), c("category").alias("category_hint"))
    return f.read_csv(s, _written(s, raw, f.write_csv))


def _goals_file(s, d) -> DataFrame:
    """Goals of a JSON file, one per market segment."""
    segments = s.read.parquet(f"{d}/customer.parquet").groupBy(F.lower("c_mktsegment").alias("name")).agg(F.count("*").alias("n"))
    entry = F.concat(F.lit('"'), "name", F.lit('_budget": {"limit": '), c("n").cast("string"), F.lit(', "period": "monthly"}'))
    text = segments.agg(F.concat(F.lit('{"user_goals": {'), F.array_join(F.sort_array(F.collect_list(entry)), ", "), F.lit(', "savings_rate": {"target": 0.25}}}')).alias("value"))
    return f.read_goals(s, _written(s, text, lambda df, path: df.write.text(path)))


def _json(s, d) -> DataFrame:
    events = _events(s, d).groupBy("event_type", "severity").agg(F.count("*").alias("n"))
    return s.read.schema("event_type string, severity string, n bigint").json(_written(s, events, f.write_json))


def _folder(s, d) -> DataFrame:
    """The tables in their own folder, without reading their content: a file each, or a folder of part files, which is one table."""
    top = str(d).rstrip("/").rpartition("/")[2]
    name = F.regexp_extract("path", rf"/\Q{top}\E/([a-z]+[.]parquet)(/.*)?$", 1)
    return f.read_documents(s, d, "*.parquet").select(name.alias("name"), "extension", "error").where("name <> ''").distinct()


def _size(s, d, table: str) -> int:
    return s.read.parquet(f"{d}/{table}.parquet").count()


def _generated(s, d) -> DataFrame:
    """Generated documents, three for each customer, and of how many the extraction gives back the true amount."""
    docs = f.generate_documents(s, _size(s, d, "customer"))
    facts = {"receipt": (documents.receipt_facts, "total_amount"), "statement": (documents.statement_facts, "ending_balance"), "invoice": (documents.invoice_facts, "total_due")}
    parts = [read(docs.where(c("doc_type") == kind).select("document_id", "doc_type", "raw_text", c("amount").alias("truth"))).select("doc_type", "truth", c(found).alias("found")) for kind, (read, found) in facts.items()]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("doc_type").agg(F.count("*").alias("n"), F.count_if(F.abs(c("found") - c("truth")) < 0.005).alias("right"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "S1_S2_csv": lambda s, d: _csv(s, d).withColumn("date", c("date").cast("string")),
    "S3_goals": _goals_file,
    "E3_json": _json,
    "S7_read_documents": _folder,
    "S10_documents": _generated,
    "S4_report": lambda s, d: f.as_report(_events(s, d).groupBy("event_type").agg(F.count("*").alias("n")), "events"),
    "S5_normalize_upload": lambda s, d: f.normalize_upload(_upload(s, d)).select("transaction_id", c("date").cast("string").alias("date"), "amount", "merchant_raw", "category"),
    "S7_S8_files": lambda s, d: f.valid_documents(_files(s, d)).select("path", "extension"),
    "S7_S8_headers": lambda s, d: with_headers(_contents(s, d)).select("path", "size", "width", "height", "stored_mode", "mode", "pages", "error"),
    "S8b_summary": lambda s, d: _files(s, d).select("path", f.document_summary(c("path"), c("extension"), c("size"), c("width"), c("height"), F.lit(1), c("error").isNull()).alias("summary")),
    "S9_counts_by_type": lambda s, d: f.counts_by_type(_files(s, d)),
    "S10_generate": lambda s, d: f.generate_transactions(s, per_month=_size(s, d, "customer")).groupBy("category", "pattern_tag").agg(F.count("*").alias("n")),
    "B16_explain_events": lambda s, d: explain.explain_events(_events(s, d)).select("event_type", "category", "month", "goal_name", "transaction_id", "headline", "body", "request", "evidence", "confidence_text", "action"),
    "W1_windowed_spending": lambda s, d: live.spending(_parquet_events(s, d)).withColumn("total", F.bround("total", 2)),
    "W2_sessions": lambda s, d: live.sessions(_parquet_events(s, d)),
}

_CATEGORY = "coalesce(category, case when type = 'goal_status' then replace(coalesce(goal_name, 'goal'), '_budget', '') end, 'spending')"


def _filled(template: str) -> str:
    """SQL of a text template."""
    parts, at = [], 0
    for m in explain._FIELD.finditer(template):
        name, titled, comma, digits, _ = m.groups()
        parts.append("'" + template[at : m.start()].replace("'", "''") + "'")
        at = m.end()
        if digits is not None:
            value = {"target_rate_pct": "coalesce(target_rate_pct, 20.0)"} | {k: f"abs(coalesce({v}, 0.0))" for k, v in explain.SIZES.items()}
            value = value.get(name, f"coalesce({name}, 0.0)")
            parts.append(f"format('{{:{comma}.{digits}f}}', cast({value} as double))")
        else:
            value = _CATEGORY if name == "category" else f"coalesce({name}, '{explain.DEFAULTS[name]}')"
            parts.append(_title(value) if titled else value)
    return " || ".join([*parts, "'" + template[at:].replace("'", "''") + "'"])


def _explained() -> str:
    pick = lambda part, other: "case kind " + " ".join(f"when '{k}' then {_filled(getattr(t, part))}" for k, t in explain.TEXTS.items() if getattr(t, part)) + f" else {other} end"
    return f"""{_EVENTS}, k as (select *, case when type <> 'goal_status' then type when goal_name like '%savings_rate%' then case when status = 'on_track' then 'savings_met' else 'savings_missed' end
        when status = 'exceeded' then 'budget_exceeded' when pct_used > 80 then 'budget_almost_full' else 'budget_on_track' end as kind from ev)
        select event_type, category, month, goal_name, transaction_id, {pick("headline", "null")} as headline, {pick("body", f"'{explain.NO_MODEL}'")} as body, {pick("request", "null")} as request, {pick("evidence", "null")} as evidence,
        {pick("action", "null")} as action, format('{{:.0f}}', confidence * 100) || '%' as confidence_text from k"""


_FILES = """with f as (select *, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) as extension from (select '/in/doc' || o_orderkey || '.' || ['png', 'PDF', 'docx', 'jpg'][o_orderkey % 4 + 1] as path, o_orderkey * 1000 as size, cast(100 + o_orderkey % 500 as int) as width, 400 as height,
  case when o_orderkey % 5 = 0 then 'CMYK' else 'RGB' end as mode from orders)),
e as (select *, case when extension not in ('png', 'jpg', 'jpeg', 'tiff', 'bmp', 'pdf') then 'unsupported' when size > 10485760 then 'large' end as error from f)"""

ORACLE_SQL: dict[str, str] = {
    "S1_S2_csv": f"""with tx as ({TRANSACTIONS}) select transaction_id, cast(date as varchar) as date, cast(amount as double) as amount, merchant_raw, case when ord % 3 = 0 then 'a "quoted", text' end as description, category as category_hint from tx""",
    "S3_goals": """select lower(c_mktsegment) || '_budget' as goal_name, count(*)::double as "limit", null::double as target from customer group by 1 union all select 'savings_rate', null, 0.25""",
    "E3_json": f"{_EVENTS} select event_type, severity, count(*) as n from ev group by 1, 2",
    "S7_read_documents": "select unnest(['" + "', '".join(f"{t}.parquet" for t in TABLES) + "']) as name, 'parquet' as extension, 'unsupported format: parquet' as error",
    "S10_documents": """select unnest(['receipt', 'statement', 'invoice']) as doc_type, count(*) as n, count(*) as "right" from customer""",
    "S10_generate": """with p as (select count(*) as n from customer), i as (select id, id // n as m, id % n as i, n from (select n, unnest(range(6 * n)) as id from p)),
        k as (select *, case when i < 2 then 'income' else ['dining', 'groceries', 'shopping', 'transportation', 'utilities'][i % 5 + 1] end as category from i),
        r as (select id, m, i, category from k union all select id + 6 * n, m, i, category from k where m = 4 and (i // 5) % 2 = case category when 'dining' then 0 when 'shopping' then 1 end)
        select category, case when id % 89 = 50 and category <> 'income' then 'anomaly' when category = 'dining' and m = 3 then 'dining_spike' when category = 'groceries' and m >= 3 then 'grocery_drift'
          when m = 4 then 'savings_drop' else 'baseline' end as pattern_tag, count(*) as n from r where not (category = 'income' and m = 4 and i = 1) group by 1, 2""",
    "S4_report": f"""{_EVENTS} select '{{"events":[' || string_agg('{{"event_type":"' || event_type || '","n":' || n || '}}', ',' order by event_type) || ']}}' as json from (select event_type, count(*) as n from ev group by 1)""",
    "S5_normalize_upload": f"with tx as ({TRANSACTIONS}) select transaction_id, cast(date as varchar) as date, cast(amount as double) as amount, merchant_raw, 'uncategorized' as category from tx",
    "S7_S8_files": f"{_FILES} select path, extension from e where error is null and width >= 200 and height >= 200 and mode in ('RGB', 'L')",
    "S7_S8_headers": """with o as (select o_orderkey as k, 100 + o_orderkey % 1000 as w, 150 + o_orderkey % 700 as h, ['png', 'jpg', 'bmp', 'tiff', 'pdf', 'txt'][o_orderkey % 6 + 1] as kind from orders),
        f as (select *, k % 11 <> 0 and kind <> 'txt' as good, case kind when 'png' then 29 when 'jpg' then 36 - 0 when 'bmp' then 30 when 'tiff' then 92 when 'txt' then 1
            else length('%PDF-1.4 1 0 obj << /Type /Pages >> 2 0 obj << /Type /Page /MediaBox [0 0 ' || w || ' ' || h || '] >> 3 0 obj << /Type/Page >>') end as full_size from o)
        select '/in/' || k || '.' || kind as path, case when k % 11 = 0 then least(10, full_size) else full_size end::int as size, case when good then case when kind = 'pdf' then ceil(w * 200 / 72.0) else w end end::int as width,
          case when good then case when kind = 'pdf' then ceil(h * 200 / 72.0) else h end end::int as height, case when good then case when kind = 'png' and k % 4 = 0 then 'RGBA' else 'RGB' end end as stored_mode,
          case when good then 'RGB' end as mode, case when good then case when kind in ('tiff', 'pdf') then 2 else 1 end end::int as pages,
          case when kind = 'txt' then 'unsupported format: txt' when not good then 'load error: no ' || kind || ' header' end as error from f""",
    "S8b_summary": f"{_FILES} select path, 'File: ' || path || chr(10) || 'Format: ' || extension || chr(10) || 'Size: ' || size || ' bytes' || chr(10) || 'Dimensions: ' || width || 'x' || height || chr(10) || 'Pages: 1' || chr(10) || 'Valid: ' || (error is null) as summary from e",
    "S9_counts_by_type": f"{_FILES} select extension, count(*) as files, count(*) filter (error is null) as loaded from e group by 1",
    "B16_explain_events": _explained(),
    "W1_windowed_spending": "select date_trunc('day', ts)::timestamp as start, event_type, count(*) as n, round_even(sum(value), 2) as total from events group by 1, 2",
    "W2_sessions": """select min(ts) as start, max(ts) + interval 30 minutes as "end", user_id, count(*) as n from (select *, sum(g) over (partition by user_id order by ts rows unbounded preceding) as k
        from (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as g from events)) group by user_id, k""",
}
