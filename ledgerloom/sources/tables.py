"""Ledger inputs derived from the driver's tables, in SQL that Spark and DuckDB both run.

The same text is the FROM clause of a query here and of its oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Merchants as banks print them; chosen by customer key.
MERCHANTS = (
    "SQ *BLUE BOTTLE COFFEE #1234", "TST* JOES DINER NY", "AMAZON.COM*MKTP US", "PAYPAL *NETFLIX.COM", "ONLINE PAYMENT - COMCAST INTERNET", "WHOLE FOODS 12345678",
    "Shell Oil CA", "UBER TRIP", "SPOTIFY USA", "MCDONALDS F1203 TX", "CVS PHARMACY #0042", "ZELLE TRANSFER", "ACME PAYROLL DEPOSIT", "TARGET T-1042", "DELTA AIR LINES",
    "UNKNOWN VENDOR XYZ", "BLUE BOTTLE COFFEE", "AMZN MKTP", "CITY PARKING GARAGE", "GREEN MARKET PRODUCE",
)


def _pick(key: str, values: tuple[str, ...]) -> str:
    cases = " ".join(f"when {k} then '{v}'" for k, v in enumerate(values))
    return f"case cast({key} % {len(values)} as int) {cases} end"


TRANSACTIONS = f"""
select cast(o_orderkey as bigint) as ord, cast(o_orderkey as varchar(20)) as transaction_id, cast(o_orderdate as date) as date,
       cast(case when o_orderpriority = '1-URGENT' then 3 * o_totalprice else -o_totalprice end as decimal(18,2)) as amount,
       {_pick('(o_custkey + o_orderkey % 3)', MERCHANTS)} as merchant_raw,
       case cast(o_orderkey % 5 as int) when 0 then 'Recurring Payment' when 1 then 'Deposit' when 2 then 'Purchase' when 3 then 'Bill Payment' else 'Debit Card' end as description,
       case when o_orderpriority = '1-URGENT' then 'income' else lower(c_mktsegment) end as category
from orders join customer on o_custkey = c_custkey
"""


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank transactions: ord, transaction_id, date, amount (decimal), merchant_raw, description, category."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return shared_sql(spark, TRANSACTIONS, orders=read("orders"), customer=read("customer"))


def shared_sql(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    """Run SQL of the common dialect over frames by name, without registering session views."""
    names = {n: df for n, df in frames.items()}
    heads = ", ".join(f"{n} as (select * from {{{n}}})" for n in names)
    return spark.sql(f"with {heads} {sql.strip()}", **names)


_CENTS = "cast(cast({} as decimal(18,2)) / 100 as decimal(18,2))"
_TEXT = "cast({} as varchar(40))"

#: Documents with rendered text, and the values that were rendered, which extraction must give back.
DOCUMENTS = f"""
select k as document_id, case cast(k % 3 as int) when 0 then 'receipt' when 1 then 'statement' else 'invoice' end as doc_type, sub, tax, total, iso, store,
  case cast(k % 3 as int)
    when 0 then 'TRADER JOES #' || store || chr(10) || 'Main Street' || chr(10) || day || chr(10) || '2x Greek Yogurt $' || {_TEXT.format('sub')} || chr(10) || 'Organic Bananas $1.29' || chr(10)
      || 'SUBTOTAL $' || {_TEXT.format('sub')} || chr(10) || 'TAX 6.0% $' || {_TEXT.format('tax')} || chr(10) || 'TOTAL $' || {_TEXT.format('total')} || chr(10) || case when k % 2 = 0 then 'DEBIT' else 'Paid: VISA' end || case when k % 7 = 0 then ' TIP' else '' end
    when 1 then 'FIRST NATIONAL BANK STATEMENT' || chr(10) || 'JOHN DOE' || chr(10) || 'Statement Period: 1/1/2024 to 1/31/2024' || chr(10) || 'Beginning Balance: $' || {_TEXT.format('sub')} || chr(10)
      || day || ' GROCERY STORE #' || store || ' ' || {_TEXT.format('tax')} || ' ' || {_TEXT.format('sub')} || chr(10) || day || ' DIRECT DEPOSIT ' || {_TEXT.format('sub')} || ' ' || {_TEXT.format('total')} || chr(10) || 'Ending Balance: $' || {_TEXT.format('total')}
    else 'ACME SUPPLIES LTD' || chr(10) || 'Invoice #INV-2024-' || store || chr(10) || 'Due Date: 12/31/2025' || chr(10) || 'Date: ' || day || chr(10) || 'Bill To:' || chr(10) || 'client corp ' || store || chr(10)
      || 'Item | Qty | Price | Amount' || chr(10) || 'Widget | 2 | $' || {_TEXT.format('tax')} || ' | $' || {_TEXT.format('sub')} || chr(10) || 'Subtotal: $' || {_TEXT.format('sub')} || chr(10) || 'Tax (6%): $' || {_TEXT.format('tax')} || chr(10)
      || 'Total Due: $' || {_TEXT.format('total')} || chr(10) || 'Payment Terms: Net 30'
  end as raw_text,
  cast((k % 100) as double) as ocr_confidence, cast((k % 10) as double) / 10 as sharpness, cast((k % 9) as double) / 9 as noise, cast((k % 5) as double) / 5 as contrast,
  cast(150 + k % 1000 as int) as width, cast(400 + k % 900 as int) as height
from (select k, {_CENTS.format('cents')} as sub, {_CENTS.format('tax_cents')} as tax, {_CENTS.format('cents + tax_cents')} as total, store,
        {_TEXT.format('mm')} || '/' || {_TEXT.format('dd')} || '/2024' as day, '2024-' || lpad({_TEXT.format('mm')}, 2, '0') || '-' || lpad({_TEXT.format('dd')}, 2, '0') as iso
      from (select cast(o_orderkey as bigint) as k, 1000 + o_orderkey % 40000 as cents, cast(floor((1000 + o_orderkey % 40000) * 6 / 100.0) as bigint) as tax_cents, cast(1000 + o_custkey % 9000 as varchar(10)) as store,
                   1 + o_orderkey % 12 as mm, 1 + o_orderkey % 28 as dd from orders) a) b
"""

#: Documents for reconciliation: orders with other amounts, days and names; a fifth are over a year away.
RECON_DOCUMENTS = f"""
select cast(o_orderkey as bigint) as ord, 'doc_' || cast(o_orderkey as varchar(20)) as id, cast(case when o_orderkey % 6 = 0 then 1.004 * o_totalprice else o_totalprice + o_orderkey % 4 end as decimal(18,2)) as amount,
       cast(cast(o_orderdate as date) + cast(o_orderkey % 4 + case when o_orderkey % 5 = 0 then 400 else 0 end as int) as varchar(10)) as date,
       {_pick('(o_custkey + case when o_orderkey % 7 = 0 then 16 else o_orderkey % 3 end)', MERCHANTS)} as merchant,
       case cast(o_orderkey % 3 as int) when 0 then 'receipt' when 1 then 'statement' else 'invoice' end as doc_type, 0.4 + (o_orderkey % 60) / cast(100 as double) as trust_score
from orders
"""

RECON_TRANSACTIONS = f"""
select cast(o_orderkey as bigint) as ord, 'txn_' || cast(o_orderkey as varchar(20)) as id, '$' || cast(cast(o_totalprice as decimal(18,2)) as varchar(30)) as amount, cast(cast(o_orderdate as date) as varchar(10)) as date,
       {_pick('(o_custkey + o_orderkey % 3)', MERCHANTS)} as merchant, case cast(o_orderkey % 6 as int) when 0 then 'income' when 1 then 'fees' when 2 then 'rent' else 'other' end as category
from orders
"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_sql(spark, DOCUMENTS, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def recon_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(transactions, documents) for reconciliation."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return shared_sql(spark, RECON_TRANSACTIONS, orders=orders), shared_sql(spark, RECON_DOCUMENTS, orders=orders)
