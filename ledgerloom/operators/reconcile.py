"""Reconciliation of transactions and documents: candidates by buckets, three tiers, one-to-one assignment, mismatches.

Rows that agree in day, amount, merchant and trust are one class: whatever a tier says of one, it says of all. Classes, not rows, meet
and are scored; members come in where a result lists them. Names stand in a table of distinct merchants. First the pairs of names that some
day and amount allow are found from cells of both and compared once; then classes meet by an equality of (day bucket, amount bucket,
merchant), only with merchants that are similar enough for some tier. Pairs are neither written nor shuffled: what is made of them is
combined where they are formed, and results that list pairs of rows form them from rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.storage import discard, together
from ledgerloom.functions.storage import materialize_lean as materialize
from ledgerloom.functions.text import chain, contains_any, let, name_ratios, squeeze

#: Processor prefixes that each tier strips, and words that the last one spells out.
EXACT_PREFIXES = ("sq *", "tst *", "tse *", "sp *", "square ", "paypal *")
FUZZY_PREFIXES = (*EXACT_PREFIXES, "pp *")
SEMANTIC_PREFIXES = ("sq * ", "tst * ", "tse * ", "sp * ", "square ", "paypal * ", "pp * ")
SUFFIXES = (" - ", " #", " ltd", " inc", " llc", " corp")
EXPANSIONS = {"amzn": "amazon", "mktp": "marketplace", "mkt": "market", "fd": "food", "f00d": "food"}
TIERS = ("EXACT", "FUZZY", "SEMANTIC")


def parse_amount(x: Column) -> Column:
    return F.trim(F.regexp_replace(x.cast("string"), r"[$,]|EUR|GBP", "")).try_cast("decimal(18,4)")


def parse_date(x: Column) -> Column:
    """A timestamp from ISO text, ``m/d/Y`` or ``d/m/Y``, in this order; null where none fits."""
    s = x.cast("string")
    return F.coalesce(s.try_cast("timestamp_ntz"),
        *(F.try_to_timestamp(s, F.lit(f)).cast("timestamp_ntz") for f in ("M/d/yyyy", "d/M/yyyy")))


def _strip(x: Column, prefixes: tuple[str, ...]) -> Column:
    """Each prefix off once, in order, with the white space after it."""
    return chain(x, [("^" + re.escape(p).replace("\\ ", " ") + r"\s*", "") for p in prefixes])


def merchant_exact(x: Column) -> Column:
    return squeeze(_strip(F.lower(F.coalesce(x, F.lit(""))), EXACT_PREFIXES))


def merchant_fuzzy(x: Column) -> Column:
    y = _strip(F.lower(F.coalesce(x, F.lit(""))), FUZZY_PREFIXES)
    for s in SUFFIXES:
        y = F.trim(F.substring_index(y, s, 1))
    return squeeze(y)


def merchant_semantic(x: Column) -> Column:
    return squeeze(_strip(F.lower(F.coalesce(x, F.lit(""))), SEMANTIC_PREFIXES))


def expand_abbreviation(x: Column) -> Column:
    book = F.create_map(*(F.lit(v) for kv in EXPANSIONS.items() for v in kv))
    return F.array_join(F.transform(F.split(squeeze(F.lower(x)), " "),
        lambda w: F.coalesce(F.try_element_at(book, F.regexp_replace(w, r"[*-]", "")), w)), " ")


def match_confidence(string: Column, amount: Column, date: Column, trust: Column) -> Column:
    return 0.4 * string + 0.3 * amount + 0.2 * date + 0.1 * trust


def day_gap(a: Column, b: Column, floors: bool = False) -> Column:
    """Days between: calendar days, or with ``floors`` the size of the floored difference in time."""
    if floors:
        return F.abs(F.floor((a.cast("timestamp").cast("double") - b.cast("timestamp").cast("double")) / 86400))
    return F.abs(F.datediff(a, b))


@dataclass(frozen=True)
class Reach:
    """How far two rows of a match may lie apart: days, and an amount or a share of the larger amount."""

    days: int
    amount: float
    share: float


#: What each tier can reach; the last one reaches all pairs that any tier does.
REACH = {"exact": Reach(1, 0.02, 0.0), "fuzzy": Reach(3, 5.0, 0.01), "semantic": Reach(5, 5.0, 0.05)}


#: What a match may lose against the most that its name and the most trusted document allow: a transaction's best document is sought among such matches first, the narrowest first.
LOSSES = (0.016, 0.032, 0.048)
#: With so few classes of documents, all that is within reach meets at once.
FEW_CLASSES = 400_000


def _loss_reach(loss: float) -> Reach:
    """Beyond it a match loses ``loss`` or more: at least 0.2 * 0.08 a day and 0.3 * 0.4 / 0.05 of the amounts' share, but nothing where amounts are equal within rounding and days a day apart (for losses up to 0.09)."""
    return Reach(max(1, math.ceil(loss / 0.016 - 1e-9) - 1), REACH["exact"].amount, loss / 2.4)


@dataclass(frozen=True)
class Levels:
    """How far rows meet by what a match may lose, narrowest first; the last level is all that is within reach.

    ``trust`` is the largest one of documents. Transactions have a column level; ``first`` and ``last`` are the levels that occur in them.
    """

    losses: tuple[float, ...]
    trust: float
    first: int
    last: int

    def of(self, column: str, reach: Reach, value: Callable[[Reach], Column]) -> Column:
        """``value`` of the reach of the level in ``column``."""
        if self.first == self.last:
            return value(_loss_reach(self.losses[self.first]) if self.first < len(self.losses) else reach)
        out = F.when(F.lit(False), value(reach))
        for k, loss in enumerate(self.losses):
            if self.first <= k <= self.last:
                out = out.when(F.col(column) == k, value(_loss_reach(loss)))
        return out.otherwise(value(reach))

    def lowest(self) -> Column:
        """The first level in which a document may match a name (lose: by the names, trust)."""
        lost = F.col("lose") + 0.1 * (self.trust - F.col("trust"))
        out = F.when(F.lit(False), 0)
        for k, loss in enumerate(self.losses):
            out = out.when(lost <= loss, k)
        return F.greatest(out.otherwise(len(self.losses)), F.lit(self.first))

    def sure(self, level: int) -> Column:
        """A confidence from which on no pair outside of the level is as good, nor equally good (up: the most that the name adds); null in the last one."""
        if level == len(self.losses):
            return F.lit(None).cast("double")
        return F.col("up") + (0.5 + 0.1 * self.trust - self.losses[level] + 1e-9)


def _levels(docs: DataFrame) -> Levels:
    """The levels for these classes of documents: only the last one where they are few or the largest trust is no number of usual size."""
    n, trust = docs.agg(F.count("*"), F.max(F.col("trust").cast("double"))).first()
    graded = n > FEW_CLASSES and trust is not None and abs(trust) <= 100
    losses = LOSSES if graded else ()
    return Levels(losses, trust if graded else 0.0, 0, len(losses))


def _amount_place(a: Column, reach: Reach) -> Column:
    """A scale on which two amounts within reach are less than 1 apart."""
    unit = 1.1 * reach.amount
    if not reach.share:
        return a / unit
    turn = reach.amount / reach.share
    return F.when(a < turn, a / unit).otherwise(turn / unit + F.ln(F.greatest(a, F.lit(turn)) / turn) / math.log(1 + 1.2 * reach.share))


def _day_number(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def _day_bucket(number: Column, reach: Reach) -> Column:
    return F.floor(number / (2 * reach.days + 1)).cast("int")


def _amount_bucket(amount: Column, reach: Reach) -> Column:
    return F.floor(_amount_place(amount.cast("double"), reach)).cast("bigint")


def _cell(bucket: Column) -> Column:
    return F.floor(bucket / CELL).cast("int")


def _buckets(rows: DataFrame, reach: Reach) -> DataFrame:
    """``rows`` (amount, day) with the buckets db and ab that they lie in."""
    return rows.withColumns({"db": _day_bucket(_day_number(F.col("day")), reach), "ab": _amount_bucket(F.col("amount"), reach)})


def merchant_names(*sides: DataFrame) -> DataFrame:
    """(merchant, name, m1, m2, m3, x3): a number and the normal forms of each distinct merchant, a table in the shared folder."""
    merchants = [df.select(F.coalesce("merchant", F.lit("")).alias("merchant")) for df in sides]
    distinct = reduce(DataFrame.union, merchants).distinct()
    c = F.col("merchant")
    forms = {"m1": merchant_exact(c), "m2": merchant_fuzzy(c), "m3": merchant_semantic(c)}
    forms = distinct.withColumn("name", F.monotonically_increasing_id()).withColumns(forms)
    return materialize(forms.withColumn("x3", expand_abbreviation(F.col("m3"))), "names")


_KEY = ["amount", "day", "name", "trust"]


@dataclass(frozen=True)
class Side:
    """One side's classes (class, amount, day, name, trust, first, first_id, n), a table in the shared folder, and its rows (the same, id, ord) or, without, members (class, id, ord)."""

    classes: DataFrame
    rows: DataFrame | None = None
    listed: DataFrame | None = None

    @property
    def members(self) -> DataFrame:
        if self.listed is not None:
            return self.listed
        return self.rows.join(self.classes.select(*_KEY, "class"), _KEY).select("class", "id", "ord")

    def spread(self, found: DataFrame, p: str) -> DataFrame:
        """``found`` (p_class and more) once for each member, with its id and ord; rows are shuffled once, by what makes a class."""
        if self.listed is not None:
            return found.join(_members(self.listed, p), f"{p}_class")
        keyed = found.join(self.classes.select(F.col("class").alias(f"{p}_class"), *(F.col(x).alias(f"__{x}") for x in _KEY)), f"{p}_class")
        rows = self.rows.select(*(F.col(x).alias(f"__{x}") for x in _KEY), F.col("id").alias(f"{p}_id"), F.col("ord").alias(f"{p}_ord"))
        return keyed.join(rows, [f"__{x}" for x in _KEY]).drop(*(f"__{x}" for x in _KEY))


def rows_of(df: DataFrame, names: DataFrame) -> DataFrame:
    """(id, ord, amount (its size), day, name, trust) of the rows that have an amount and a date."""
    c = F.col
    trust = F.coalesce(c("trust_score"), F.lit(1.0)) if "trust_score" in df.columns else F.lit(1.0)
    rows = df.select(
        "id", "ord", F.abs(parse_amount(c("amount"))).alias("amount"), parse_date(c("date")).cast("date").alias("day"),
        F.coalesce("merchant", F.lit("")).alias("merchant"), trust.alias("trust"))
    return rows.where("amount is not null and day is not null").join(names.select("merchant", "name"), "merchant").drop("merchant")


def classes_of(df: DataFrame, names: DataFrame) -> Side:
    """Rows of equal amount (its size), day, merchant and, where there is one, trust as a class; rows without an amount or a date are in none.

    Where there is trust, ``leads`` says that no more trusted class of the same amount, day and merchant surpasses it in every match.
    """
    rows = rows_of(df, names)
    classes = rows.groupBy(*_KEY).agg(F.min("ord").alias("first"), F.min_by("id", "ord").alias("first_id"), F.count("*").alias("n"))
    if "trust_score" in df.columns:
        classes = classes.withColumn("leads", _leads())
    return Side(materialize(classes.withColumn("class", F.monotonically_increasing_id()), "classes"), rows)


def _leads() -> Column:
    """Trusts closer than what survives rounding lead as well, as their confidences may be equal; so do those that are no numbers."""
    most = F.max(F.nanvl(F.col("trust").cast("double"), F.lit(None).cast("double"))).over(Window.partitionBy("amount", "day", "name"))
    return let(most, lambda m: m.isNull() | F.isnan("trust") | (F.col("trust") >= m - F.greatest(F.abs(m), F.lit(1.0)) * 1e-9))


#: So many day buckets and amount buckets on a side make a cell, by which rows are dealt out: most rows reach into no other one.
CELL = 16
#: Where a transaction or its class is dealt to, once; pairs stay there.
PLACE = ("dc", "ac", "t_name")


def _dealt(left: DataFrame, reach: Reach, *keys: str, levels: Levels | None = None) -> DataFrame:
    """Transactions or their classes (columns with the prefix t_), each in its cell."""
    number = _day_number(F.col("t_day"))
    day, amount = _day_bucket(number, reach), _amount_bucket(F.col("t_amount"), reach)
    rows = left.withColumns({"dc": _cell(day), "ac": _cell(amount)}).repartition(*keys)
    if levels is None:
        return rows.withColumns({"db": day, "ab": amount})
    of = lambda value: levels.of("t_level", reach, value)
    return rows.withColumns({"db": of(lambda r: _day_bucket(number, r)), "ab": of(lambda r: _amount_bucket(F.col("t_amount"), r))})


def close_pairs(tx: DataFrame, docs: DataFrame, reach: Reach, scores: DataFrame | None = None, levels: Levels | None = None) -> DataFrame:
    """Pairs of rows or classes within reach, and with ``scores`` only those whose names are in it.

    ``tx``, ``docs``: amount, day, name and what else is to be kept, which gets a prefix (but trust); docs also trust. Rows are shuffled by
    cells of many buckets, few documents twice, and documents stand in every bucket that they reach only where the cell is worked on. A
    transaction has one cell, so what is found for it is found in one place (``PLACE``). With ``levels``, transactions have a level, and
    at least all pairs that lose no more than it allows are among those formed; buckets within a cell are those of the level.
    """
    c = F.col
    together(tx.sparkSession)
    named = lambda df, p: df.select(*(c(x) if x == "trust" else c(x).alias(f"{p}_{x}") for x in df.columns))
    left, right, keys = named(tx.drop("trust"), "t"), named(docs, "d"), ["dc", "ac"]
    if scores is not None:
        right, keys = right.join(scores, "d_name"), list(PLACE)
    n, place, most = _day_number(c("d_day")), _amount_bucket(c("d_amount"), reach), CELL - 1
    days = (_day_bucket(n - reach.days, reach), _day_bucket(n + reach.days, reach))
    span = lambda a, b: F.explode(F.sequence(_cell(a), _cell(b)))
    inside = lambda a, b, k: F.explode(F.sequence(F.greatest(a, c(k) * CELL), F.least(b, c(k) * CELL + most)))
    met = ["db", "ab"]
    if levels is not None:
        right, met = right.where(levels.lowest() <= levels.last), ["t_level", "db", "ab"]
    right = right.withColumn("dc", span(*days)).withColumn("ac", span(place - 1, place + 1))
    right = _counted(right.repartition(*keys), "d")
    if levels is None:
        of = lambda value: value(reach)
        right = right.withColumn("db", inside(*days, "dc")).withColumn("ab", inside(place - 1, place + 1, "ac"))
    else:
        of = lambda value: levels.of("t_level", reach, value)
        right = right.withColumn("t_level", F.explode(F.sequence(levels.lowest(), F.lit(levels.last))))
        right = right.withColumn("db", F.explode(F.sequence(of(lambda r: _day_bucket(n - r.days, r)), of(lambda r: _day_bucket(n + r.days, r)))))
        right = right.withColumn("ab", of(lambda r: _amount_bucket(c("d_amount"), r))).withColumn("ab", F.explode(F.sequence(c("ab") - 1, c("ab") + 1)))
    left = _dealt(left, reach, *keys, levels=levels)
    left = _counted(left.withColumns({"t_days": of(lambda r: F.lit(r.days)), "t_share": of(lambda r: F.lit(r.share)), "t_parts_off": of(lambda r: F.lit(round(r.amount * 10000)))}), "t")
    apart, larger, days = F.abs(c("t_parts") - c("d_parts")), F.greatest("t_parts", "d_parts"), F.abs(c("t_number") - c("d_number"))
    near = (days <= c("t_days")) & ((apart <= c("t_parts_off")) | (apart.cast("double") / larger <= c("t_share") * (1 + 1e-9)))
    if levels is None:
        near = (days <= c("t_days")) & ((apart <= c("t_parts_off")) | (_share(apart, larger) <= c("t_share")))
    return left.join(right, [*keys, *met]).where(near).withColumns(_numbers()).drop("db", "ab", "d_day", "t_days", "t_share", "t_parts_off", "t_number", "d_number")


def picked(won: DataFrame, docs: DataFrame, reach: Reach, scores: DataFrame) -> DataFrame:
    """``won`` (t_amount, t_day, t_name, d_first and more) with the document's columns and the numbers of the pair, in the transaction's place."""
    c = F.col
    n, place = _day_number(c("d_day")), _amount_bucket(c("d_amount"), reach)
    span = lambda a, b: F.explode(F.sequence(_cell(a), _cell(b)))
    right = docs.join(scores, "d_name").withColumn("dc", span(_day_bucket(n - reach.days, reach), _day_bucket(n + reach.days, reach)))
    right = right.withColumn("ac", span(place - 1, place + 1)).repartition(*PLACE)
    pairs = _dealt(won, reach, *PLACE).drop("db", "ab").join(right, [*PLACE, "d_first"])
    return _counted(_counted(pairs, "t"), "d").withColumns(_numbers())


def _counted(rows: DataFrame, p: str) -> DataFrame:
    """``rows`` with an amount's ten thousandths and cents and the day as whole numbers: what pairs compare, made once for each row."""
    amount = F.col(f"{p}_amount")
    return rows.withColumns({f"{p}_parts": (amount * 10000).cast("bigint"), f"{p}_cents": (F.bround(amount, 2) * 100).cast("bigint"), f"{p}_number": _day_number(F.col(f"{p}_day"))})


def _share(apart: Column, larger: Column) -> Column:
    return F.coalesce(F.try_divide(apart / 10000.0, larger / 10000.0), F.lit(0.0))


def _numbers() -> dict[str, Column]:
    """What a pair compares. Amounts under 4.5e11 give the same doubles as their decimals do."""
    c = F.col
    apart = F.abs(c("t_parts") - c("d_parts"))
    return {"diff": apart / 10000.0, "pct": _share(apart, F.greatest("t_parts", "d_parts")), "days": F.abs(c("t_number") - c("d_number"))}


def _members(side: DataFrame, p: str) -> DataFrame:
    return side.select(*(F.col(x).alias(f"{p}_{x}") for x in ("class", "id", "ord")))


def candidates(tx: DataFrame, docs: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Pairs of rows within five days and within 5 or 5 % of the amount: ids and numbers.

    ``tx`` and ``docs``: id, ord, amount, date, merchant; docs also trust_score.
    """
    names = merchant_names(tx, docs) if names is None else names
    return close_pairs(rows_of(tx, names), rows_of(docs, names), REACH["semantic"])


def exact_gate() -> Column:
    """Whether amount and date allow an exact match."""
    return (F.abs(F.col("t_cents") - F.col("d_cents")) <= 1) & (F.col("days") <= 1)


def exact_tier(similarity: float = 0.90) -> Column:
    match = _match("EXACT", F.col("s1"), F.lit(1.0), F.lit(1.0), F.lit("SUPPORTED"), F.lit(None), F.lit(None))
    return F.when(exact_gate() & (F.col("s1") >= similarity), match)


def _match(tier: str, string, amount, date, status, reason, discrepancy) -> Column:
    return F.struct(
        match_confidence(string, amount, date, F.col("trust")).alias("confidence"), F.lit(tier).alias("match_type"),
        status.alias("status"), reason.cast("string").alias("reason"), string.alias("string_similarity"),
        amount.cast("double").alias("amount_match"), date.cast("double").alias("date_proximity"),
        F.col("trust").alias("document_trust"), discrepancy.cast("double").alias("amount_discrepancy"))


def fuzzy_amount(diff: Column, pct: Column, either_zero: Column) -> Column:
    """Struct (score, reason): 1 for equal amounts, falling to 0.7 at one percent and staying there up to a difference of 5; else 0."""
    score = F.when(either_zero, F.when(diff == 0, 1.0).otherwise(0.0)).when((diff <= 5) | (pct <= 0.01),
        1 - F.least(pct / 0.01, F.lit(1.0)) * 0.3).otherwise(0.0)
    reason = F.when(diff <= 0.01, F.lit(None)).when((diff <= 5) & (pct > 0.01), "tip_adjustment").when(pct <= 0.01,
        "currency_or_fee")
    return F.struct(score.alias("score"), reason.alias("reason"))


def _either_zero() -> Column:
    return (F.col("t_amount") == 0) | (F.col("d_amount") == 0)


def _fuzzy_parts() -> tuple[Column, Column, Column]:
    """Amount (score, reason), date score, and whether they allow a fuzzy match."""
    c = F.col
    amount = fuzzy_amount(c("diff"), c("pct"), _either_zero())
    return amount, F.when(c("days") <= 3,
        1 - c("days") * 0.1).otherwise(0.0), (amount["score"] >= 0.7) & (c("days") <= 3)


def fuzzy_tier(similarity: float = 0.85) -> Column:
    amount, date, gate = _fuzzy_parts()
    status = F.when(amount["score"] == 1, "SUPPORTED").otherwise("PARTIAL")
    discrepancy = F.when(amount["score"] < 1, F.col("diff"))
    return F.when(gate & (F.col("s2") >= similarity),
        _match("FUZZY", F.col("s2"), amount["score"], date, status, amount["reason"], discrepancy))


def _semantic_parts() -> tuple[Column, Column, Column]:
    """Amount score, date score, and whether they allow a semantic match."""
    c = F.col
    amount = F.when(_either_zero(), F.when(c("diff") == 0, 1.0).otherwise(0.0)).when(c("pct") <= 0.05,
        1 - c("pct") / 0.05 * 0.4).otherwise(0.0)
    date = 1 - c("days") * 0.08
    return amount, date, (amount >= 0.6) & (date >= 0.6)


def semantic_tier(similarity: float = 0.65, cosine: Column | None = None) -> Column:
    """Expanded names by indel ratio from 0.75 on, else by the embedding column ``cosine`` if there is one, else by the ratio again."""
    amount, date, gate = _semantic_parts()
    ratio = F.col("s3")
    s = F.when(ratio >= 0.75, ratio).otherwise(F.coalesce(cosine, ratio) if cosine is not None else ratio)
    kind = F.when(F.col("digits"), "ocr_correction").when(F.col("spelled"), "abbreviation")
    kind = kind.when(ratio >= 0.75, "rapidfuzz_fallback").otherwise("semantic_similarity")
    status = F.when(amount >= 0.9, "SUPPORTED").otherwise("PARTIAL")
    return F.when(gate & (s >= similarity),
        _match("SEMANTIC", s, amount, date, status, kind, F.when(amount < 1, F.col("diff"))))


def name_cells(rows: DataFrame, reach: Reach) -> DataFrame:
    """(name, db, ab) in which there are rows, with the least and the largest day and amount: as many as there are rows at most, and no more than the buckets allow."""
    n, a = _day_number(F.col("day")), F.col("amount").cast("double")
    ends = {"day0": F.min(n), "day1": F.max(n), "amount0": F.min(a), "amount1": F.max(a)}
    return _buckets(rows, reach).groupBy("name", "db", "ab").agg(*(v.alias(k) for k, v in ends.items()))


#: Up to so many pairs of distinct names are all compared, as finding those that some day and amount allow costs more.
FEW_NAME_PAIRS = 250_000


def _met_names(tx: DataFrame, docs: DataFrame, reach: Reach) -> DataFrame:
    """(t_name, d_name, g1, g2, g3): pairs of names that some day and amount allow, and the tiers for which they do.

    Cells of a name, a day bucket and an amount bucket meet, not rows; a cell of one row is as exact as the row.
    """
    c = F.col
    cell = lambda df, p: df.select("db", "ab", *(c(x).alias(f"{p}_{x}") for x in df.columns if x not in ("db", "ab")))
    near = lambda n: F.explode(F.sequence(c(n) - 1, c(n) + 1)).alias(n)
    left = cell(name_cells(tx, reach), "t")
    left = left.select(*(x for x in left.columns if x != "db"), near("db")).select(*(x for x in left.columns if x != "ab"), near("ab"))
    met = left.join(cell(name_cells(docs, reach), "d"), ["db", "ab"])
    gap = lambda x: F.greatest(c(f"t_{x}0") - c(f"d_{x}1"), c(f"d_{x}0") - c(f"t_{x}1"), F.lit(0))
    amount = gap("amount") * (1 - 1e-9) - 1e-9
    most = F.greatest("t_amount1", "d_amount1")
    within = lambda r: (gap("day") <= r.days) & ((amount <= r.amount) | (amount <= r.share * most))
    gates = {f"g{k}": within(REACH[x]) for k, x in enumerate(("exact", "fuzzy", "semantic"), 1)}
    return met.groupBy("t_name", "d_name").agg(*(F.max(g).alias(k) for k, g in gates.items())).where("g1 or g2 or g3")


def name_scores(tx: DataFrame, docs: DataFrame, names: DataFrame, reach: Reach = REACH["semantic"]) -> DataFrame:
    """(t_name, d_name, s1, s2, s3, digits, spelled) of the distinct pairs of names that can matter, a table in the shared folder.

    Where names are few, these are all pairs: cells of few names would meet as often as rows do, to find the same pairs again and again. Else
    they are those that some day and amount allow. A pair too many changes no result, as tiers ask for day and amount themselves.
    """
    c = F.col
    if names.count() ** 2 <= FEW_NAME_PAIRS:
        one = lambda df, p: df.select(c("name").alias(f"{p}_name")).distinct()
        wanted = one(tx, "t").crossJoin(one(docs, "d")).withColumns({g: F.lit(True) for g in ("g1", "g2", "g3")})
    else:
        wanted = _met_names(tx, docs, reach)
    side = lambda p: names.select(*(c(x).alias(f"{p}_{x}") for x in ("name", "m1", "m2", "m3", "x3")))
    named = wanted.join(side("t"), "t_name").join(side("d"), "d_name")
    asked = [F.when(c(g), c(f"{p}_{x}")) for g, x in (("g1", "m1"), ("g2", "m2"), ("g3", "x3")) for p in ("t", "d")]
    spelled = (c("t_x3") != c("t_m3")) | (c("d_x3") != c("d_m3"))
    digits = F.rlike(F.concat("t_m3", "d_m3"), F.lit(r"\d"))
    scored = named.select("t_name", "d_name", name_ratios(*asked).alias("s"), digits.alias("digits"),
        spelled.alias("spelled"))
    return materialize(scored.select("t_name", "d_name", "s.*", "digits", "spelled"), "name-scores")


@dataclass(frozen=True)
class Scored:
    """Both sides, and how classes of them meet: pairs with a struct (or null) of each tier and ``best``, the largest confidence of them.

    Columns that are added to either side's classes come back with the prefix of the side; with ``Levels`` classes of transactions meet as far as
    their level reaches, where ``graded`` says that levels hold. ``say`` gives the same of pairs (t_class, d_class) that are known.
    ``deal`` brings rows of transactions to the place where their class meets, and ``pick`` says the same there of pairs that are known by d_first, from the classes of documents that there are.
    """

    tx: Side
    docs: Side
    meet: Callable[..., DataFrame]
    say: Callable[[DataFrame], DataFrame]
    deal: Callable[[DataFrame], DataFrame] | None = None
    pick: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    graded: bool = False

    @property
    def pairs(self) -> DataFrame:
        return self.meet(self.tx.classes, self.docs.classes)

    @staticmethod
    def of_rows(df: DataFrame) -> Scored:
        """Scored pairs of rows (t_id, t_ord, d_id, d_ord, days, a column per tier), each row as a class of its own."""
        c = F.col

        def side(p: str) -> Side:
            rows = df.select(c(f"{p}_ord").alias("class"), c(f"{p}_id").alias("id"), c(f"{p}_ord").alias("ord")).distinct()
            return Side(rows.select("class", c("ord").alias("first"), c("id").alias("first_id"), F.lit(1).alias("n")), listed=rows)

        pairs = df.withColumns({"t_class": c("t_ord"), "d_class": c("d_ord"), "best": F.greatest(*(c(x)["confidence"] for x in ("exact", "fuzzy", "semantic")))})
        pairs = pairs.drop("t_id", "t_ord", "d_id", "d_ord").where("best is not null")
        named = lambda rows, p: rows.select(*(c(x).alias(f"{p}_{x}") for x in rows.columns))
        return Scored(side("t"), side("d"), lambda tx, docs: pairs.drop("d_first").join(named(tx, "t"), "t_class").join(named(docs, "d"), "d_class"),
            lambda found: found.join(pairs.withColumn("d_first", c("d_class")), ["t_class", "d_class"]))


def _tier_columns(cosine: Column | None = None) -> dict[str, Column]:
    return {"exact": exact_tier(), "fuzzy": fuzzy_tier(), "semantic": semantic_tier(cosine=cosine)}


def _gates() -> tuple[Column, Column, Column]:
    """Whether day and amount allow a match of each tier, as the tiers say, but shorter."""
    c = F.col
    alike = (c("pct") <= 0.01) | ((c("diff") <= 5) & (F.least("t_parts", "d_parts") > 0))
    return exact_gate(), (c("days") <= 3) & alike, (c("days") <= 5) & (c("pct") <= 0.05)


def _best_confidence(cosine: Column | None = None) -> Column:
    """The largest confidence that a tier gives a pair, null where none matches; as the tiers say, without their structs.

    Without embeddings it is made of what names (``_graded``) and documents add, so that pairs need little code: a larger one is not compiled.
    """
    c = F.col
    if cosine is None:
        share, trust = c("pct"), 0.1 * c("trust")
        exact, fuzzy, semantic = _gates()
        return F.greatest(
            F.when(exact, c("add1") + trust),
            F.when(fuzzy, c("add2") + 0.3 * (1 - F.least(share / 0.01, F.lit(1.0)) * 0.3) + 0.2 * (1 - c("days") * 0.1) + trust),
            F.when(semantic, c("add3") + 0.3 * (1 - share / 0.05 * 0.4) + 0.2 * (1 - c("days") * 0.08) + trust))
    (fa, fd, fg), (sa, sd, sg) = _fuzzy_parts(), _semantic_parts()
    s = F.when(c("s3") >= 0.75, c("s3")).otherwise(F.coalesce(cosine, c("s3")))
    sure = lambda *x: match_confidence(*x, c("trust"))
    return F.greatest(F.when(exact_gate() & (c("s1") >= 0.90), sure(c("s1"), F.lit(1.0), F.lit(1.0))),
        F.when(fg & (c("s2") >= 0.85), sure(c("s2"), fa["score"], fd)), F.when(sg & (s >= 0.65), sure(s, sa, sd)))


#: From which similarity on a tier matches.
_SIMILAR = {"exact": "s1 >= 0.90", "fuzzy": "s2 >= 0.85", "semantic": "s3 >= 0.65"}


def _similar(scores: DataFrame, cosine: Column | None = None, names: tuple[str, ...] = tuple(_SIMILAR)) -> DataFrame:
    """The pairs of names that are similar enough for one of these tiers; with a column of embeddings' similarity, all."""
    return scores if cosine is not None else scores.where(" or ".join(_SIMILAR[x] for x in names))


def _graded(scores: DataFrame) -> DataFrame:
    """Pairs of names with what they add to each tier's confidence (add1 with an exact match's day and amount), null where they do not match; up, the most that a transaction's name can add; lose, what another one adds less; and kind, the number of a semantic match's reason."""
    c = F.col
    add = {f"add{k}": F.when(F.expr(_SIMILAR[x]), 0.4 * c(f"s{k}")) for k, x in enumerate(_SIMILAR, 1)}
    added = scores.withColumns(add).withColumn("lose", F.greatest(*add))
    kind = F.when(c("digits"), 4).when(c("spelled"), 5).when(c("s3") >= 0.75, 6).otherwise(7)
    added = added.withColumn("kind", kind)
    ups = added.groupBy("t_name").agg(F.max("lose").alias("up"))
    return added.join(ups, "t_name").withColumns({"lose": c("up") - c("lose"), "add1": c("add1") + 0.3 + 0.2})


def tiers(tx: DataFrame, docs: DataFrame, cosine: Column | None = None, tier: str = "semantic") -> Scored:
    """Pairs of classes that some tier matches, with what each tier says of them; only as far as ``tier`` reaches.

    Similarities run on the distinct pairs of names alone, in one Python step; the rest are columns.
    """
    names, reach = merchant_names(tx, docs), REACH[tier]
    left, right = classes_of(tx, names), classes_of(docs, names)
    scores = materialize(_graded(_similar(name_scores(left.classes, right.classes, names, reach), cosine)), "graded")

    def scored(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("best", _best_confidence(cosine)).where("best is not null").withColumns(_tier_columns(cosine))

    def meet(t: DataFrame, d: DataFrame, levels: Levels | None = None) -> DataFrame:
        pairs = close_pairs(t.drop("first", "first_id"), d.drop("first_id"), reach, scores, levels)
        return scored(pairs) if levels is None else pairs.withColumn("best", _best_confidence(cosine))

    def say(found: DataFrame) -> DataFrame:
        side = lambda x, p, *more: x.classes.select(*(F.col(k).alias(f"{p}_{k}") for k in ("class", "amount", "day", "name", *more)), *(["trust"] if p == "d" else []))
        known = found.join(side(left, "t"), "t_class").join(side(right, "d", "first"), "d_class")
        return scored(_counted(_counted(known, "t"), "d").withColumns(_numbers()).join(scores, ["t_name", "d_name"]))

    def pick(won: DataFrame, taken: DataFrame) -> DataFrame:
        docs = taken.select(F.col("name").alias("d_name"), *(F.col(x).alias(f"d_{x}") for x in ("class", "amount", "day", "first", "first_id")), "trust")
        return picked(won, docs, reach, scores).withColumns(_tier_columns(cosine))

    return Scored(left, right, meet, say, lambda rows: _dealt(rows, reach, *PLACE).drop("db", "ab"), pick, cosine is None)


def listed_tiers(tx: DataFrame, docs: DataFrame, cosine: Column | None = None, tier: str = "semantic", names_of: tuple[str, ...] = tuple(_SIMILAR)) -> DataFrame:
    """Pairs of rows that some tier matches, with what each tier says of them; only as far as ``tier`` reaches, and of the names that one of the tiers ``names_of`` takes for the same.

    For results that list such pairs: rows meet with their ids, so that each pair is formed where it is written, without another shuffle.
    """
    names, reach = merchant_names(tx, docs), REACH[tier]
    left, right = rows_of(tx, names), rows_of(docs, names)
    pairs = close_pairs(left, right, reach, _similar(name_scores(left, right, names, reach), cosine, names_of))
    return pairs.withColumns(_tier_columns(cosine))


def listed_matches(pairs: DataFrame, *names: str) -> DataFrame:
    """Of ``listed_tiers``, each pair's first of these tiers that matches."""
    rows = pairs.withColumn("m", F.coalesce(*(F.col(x) for x in names))).where("m is not null")
    return rows.select("t_id", "t_ord", "d_id", "d_ord", "days", "m.*")


def _matched(pairs: DataFrame, match: Column, *more: str) -> DataFrame:
    return pairs.withColumn("m", match).where("m is not null").select("t_class", "d_class", "d_first", "days", *more, "m.*")


def _expanded(s: Scored, matched: DataFrame) -> DataFrame:
    """Matched classes as the pairs of their members."""
    rows = s.docs.spread(s.tx.spread(matched, "t"), "d")
    return rows.select("t_id", "t_ord", "d_id", "d_ord", *(x for x in matched.columns if x not in ("t_class", "d_class", "d_first")))


#: Reasons of a match, by number; the first two are an exact match and a fuzzy one without a reason.
_REASONS = (None, None, "tip_adjustment", "currency_or_fee", "ocr_correction", "abbreviation", "rapidfuzz_fallback", "semantic_similarity")


def class_matches(s: Scored, *names: str) -> DataFrame:
    """Pairs of classes at their first of these tiers that matches, counted by days and reason: ``n`` is the number of pairs of rows, what counts need, without the rows."""
    c = F.col
    n = (c("t_n") * c("d_n")).alias("n")
    if not s.graded:
        rows = s.pairs.withColumn("m", F.coalesce(*(c(x) for x in names))).where("m is not null")
        return rows.select("days", "m.*", n)
    exact, fuzzy, semantic = _gates()
    fuzzy_reason = F.when(c("diff") <= 0.01, 1).when((c("diff") <= 5) & (c("pct") > 0.01), 2).otherwise(3)
    says = {"exact": F.when(exact & c("add1").isNotNull(), 0), "fuzzy": F.when(fuzzy & c("add2").isNotNull(), fuzzy_reason), "semantic": F.when(semantic & c("add3").isNotNull(), c("kind"))}
    pairs = s.meet(s.tx.classes.withColumn("level", F.lit(0)), s.docs.classes, Levels((), 0.0, 0, 0))
    counts = pairs.select("days", F.coalesce(*(says[x] for x in names)).alias("reason"), n).groupBy("days", "reason").agg(F.sum("n").alias("n")).where("reason is not null")
    reasons = F.array(*(F.lit(x).cast("string") for x in _REASONS))
    return counts.select("days", F.get(reasons, c("reason")).alias("reason"), "n")


def cascade(s: Scored, n_tiers: int = 3) -> DataFrame:
    """Each pair's first tier that matches, of the first two or all three."""
    return _expanded(s, _matched(s.pairs, F.coalesce(*(F.col(x) for x in ("exact", "fuzzy", "semantic")[:n_tiers]))))


def tier_matches(s: Scored, tier: str) -> DataFrame:
    return _expanded(s, _matched(s.pairs, F.col(tier)))


def edges(pairs: DataFrame, least: float = 0.0, more: tuple[str, ...] = ()) -> DataFrame:
    """Each pair of classes at its best tier, the earlier one at equal confidence, from ``least`` on, with columns ``more`` of the pair."""
    ranked = F.array_max(F.array(
        *(F.struct(F.col(n)["confidence"].alias("c"), F.lit(-k).alias("k"),
            F.col(n).alias("m")) for k, n in enumerate(("exact", "fuzzy", "semantic")))))
    return _matched(pairs, let(ranked, lambda r: F.when(r["c"].isNotNull(), r["m"])), *more).where(F.col("confidence") >= least)


def best_classes(s: Scored) -> DataFrame:
    """Each class of transactions' best document, the first of its class (d_id, d_ord), with ``t_n``, the number of its members; ties go to the earlier document.

    The largest confidence of each class is found first, by an aggregate that combines where pairs are formed; then classes meet again,
    for the first document of that confidence. Both end where the pairs are formed, and so does the meeting of a class with that one document,
    which fills in the rest: what is found for a class is not shuffled by classes. Where documents
    are many, a class meets those near to it first: what it finds there is the largest confidence if no document that is farther off in day,
    amount, name or trust can have as much, and only classes for which that is not so meet more of them (``Levels``).
    """
    c = F.col
    docs = s.docs.classes.where("leads") if "leads" in s.docs.classes.columns else s.docs.classes
    open_ = s.tx.classes.withColumn("own", c("trust"))
    key = [*PLACE, "t_amount", "t_day", "t_own", "t_n", "t_class"]
    levels, found = _levels(docs if s.graded else docs.limit(0)), []
    for k in range(len(levels.losses) + 1):
        most = s.meet(open_.withColumn("level", F.lit(k)), docs, replace(levels, first=k, last=k)).groupBy(*key, "t_level", "up").agg(F.max("best").alias("most"))
        most = most.where(c("most") >= levels.sure(k) if k < len(levels.losses) else c("most").isNotNull())
        found.append(materialize(most.select(*(c(x).alias(x.removeprefix("t_")) for x in key[2:]), c("t_level").alias("level"), "most"), "best"))
        if k < len(levels.losses):
            last, open_ = open_, materialize(open_.join(found[-1].select("class"), "class", "left_anti"), "open")
            if k:
                discard(last)
            if not open_.head(1):
                break
    pairs = s.meet(reduce(DataFrame.union, found), docs, replace(levels, last=len(found) - 1)).where("best <=> t_most")
    won = materialize(pairs.groupBy(*key, "t_most").agg(F.min("d_first").alias("d_first")).drop("dc", "ac"), "won")
    for table in [*found, open_] if levels.losses else []:
        discard(table)
    taken = materialize(docs.join(won.select(c("d_first").alias("first")).distinct(), "first", "left_semi"), "taken")
    match = F.coalesce(*(F.when(c(x)["confidence"].eqNullSafe(c("t_most")), c(x)) for x in ("exact", "fuzzy")), c("semantic"))
    return s.pick(won, taken).select(*key, c("d_first_id").alias("d_id"), c("d_first").alias("d_ord"), "days", match.alias("m")).select(*key, "d_id", "d_ord", "days", "m.*")


def best_match(s: Scored) -> DataFrame:
    """Each transaction's best document; ties go to the earlier document. The members of a class have the same one."""
    best, key = best_classes(s), [*PLACE, "t_amount", "t_day", "t_own"]
    rows = s.deal(s.tx.rows.select("id", "ord", "amount", "day", "name", F.col("trust").alias("own")).toDF("t_id", "t_ord", *key[3:5], "t_name", "t_own"))
    kept = [x for x in best.columns if x not in (*key, "t_class", "t_n", "d_id", "d_ord")]
    return rows.join(best, key).select("t_id", "t_ord", "d_id", "d_ord", *kept)


def _page(s: Scored, asking: DataFrame, least: float, levels: Levels) -> tuple[DataFrame, DataFrame]:
    """The next part of the lists of classes of transactions (class, wanted, below), as (t_class, d_class, c) and as (class, below, whole), tables in the shared folder.

    A part goes from the hundredth of confidence ``below``, or from the top, down to the hundredth in which so many documents as are ``wanted`` have come;
    which one that is, counts by hundredths say, so that no list is sorted or kept in full. Classes that find as many among the documents near to
    them, in hundredths that no other document can be in, ask no further (``Levels``).
    """
    c = F.col
    pages, parts = [], []
    for k in range(len(levels.losses) + 1):
        level, last = replace(levels, first=k, last=k), k == len(levels.losses)

        def rest(rows: DataFrame) -> DataFrame:
            met = s.meet(rows.withColumn("level", F.lit(k)), s.docs.classes, level) if s.graded else s.meet(rows, s.docs.classes)
            found = met.withColumn("step", F.floor(c("best") * 100).cast("int")).where((c("best") >= least) & (c("t_below").isNull() | (c("step") < c("t_below"))))
            return found if last else found.where(c("step") > F.floor(levels.sure(k) * 100))

        left = s.tx.classes.join(asking, "class")
        steps = rest(left).groupBy("t_class", "step", "t_wanted").agg(F.sum("d_n").alias("n"))
        before = F.sum("n").over(Window.partitionBy("t_class").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1))
        cut = F.min(F.when(F.coalesce(c("before"), F.lit(0)) < c("t_wanted"), c("step")))
        enough = F.lit(True) if last else F.sum("n") >= F.max("t_wanted")
        cuts = steps.withColumn("before", before).groupBy(c("t_class").alias("class")).agg(cut.alias("below"), F.min("step").alias("last"), enough.alias("enough"))
        cuts = materialize(cuts.where("enough").select("class", "below", ((c("below") == c("last")) & F.lit(last)).alias("whole")), "cuts")
        page = rest(left.join(cuts.select("class", c("below").alias("cut")), "class")).where("step >= t_cut")
        pages.append(materialize(page.select("t_class", "d_class", (-c("best")).alias("c")), "edges"))
        parts.append(cuts)
        if not last:
            asking = materialize(asking.join(cuts.select("class"), "class", "left_anti"), "asking")
    return reduce(DataFrame.union, pages), reduce(DataFrame.union, parts)


def assign(scored: Scored | DataFrame, least: float = 0.6) -> DataFrame:
    """One-to-one matches: in order, each transaction takes its best remaining document of confidence ``least`` or more.

    That is the only stable matching in which all documents prefer earlier transactions, so it is found in rounds of proposals. All
    transactions of a class have the same list of documents: by confidence, then by order. In a round, a class's
    transactions without a document, in order, are dealt the first documents of that list that are free or whose holder is later than the
    first of them: the second one would be refused what the first one asks for, and so on. Every document keeps the earliest; who is refused asks
    again, until none is left that has a document to ask for. Lists are made in parts, of which most classes need one: who finds no document
    in the parts there are waits until nobody else asks, and then gets the next part if the list goes on. No pair of a transaction
    and a document is formed but a proposal.
    """
    s = scored if isinstance(scored, Scored) else Scored.of_rows(scored)
    c = F.col
    docs = materialize(s.docs.members.select(c("class").alias("d_class"), c("id").alias("d_id"), c("ord").alias("d_ord")), "members")
    tx = materialize(_members(s.tx.members, "t"), "members")
    levels = _levels(s.docs.classes if s.graded else s.docs.classes.select(F.lit(0.0).alias("trust")).limit(0))
    wish, parts = _page(s, s.tx.classes.select("class", (8 + 2 * c("n")).alias("wanted"), F.lit(None).cast("int").alias("below")), least, levels)
    open_ = materialize(tx.join(parts.select(c("class").alias("t_class")), "t_class", "left_semi").select("t_class", "t_ord"), "open")
    held, wanted = None, 8
    in_order = Window.partitionBy("t_class").orderBy("t_ord")
    listed = Window.partitionBy("t_class").orderBy("c", "d_ord")
    while True:
        batch = open_.groupBy("t_class").agg(F.count("*").alias("k"), F.min("t_ord").alias("first"))
        lists = batch.join(wish, "t_class").join(docs, "d_class").select("t_class", "k", "first", "c", "d_ord")
        if held is not None:
            lists = lists.join(held.select("d_ord", F.col("t_ord").alias("holder")), "d_ord", "left").where("holder is null or holder > first")
        alone = lists.where("k = 1").groupBy("t_class").agg(F.min(F.struct("c", "d_ord"))["d_ord"].alias("d_ord"))
        alone = alone.join(batch.select("t_class", F.col("first").alias("t_ord")), "t_class").select("t_ord", "d_ord")
        several = lists.where("k > 1").withColumn("r", F.row_number().over(listed)).where("r <= k").select("t_class", "r", "d_ord")
        dealt = open_.join(batch.where("k > 1").select("t_class"), "t_class").withColumn("r", F.row_number().over(in_order))
        asked = materialize(alone.union(dealt.join(several, ["t_class", "r"]).select("t_ord", "d_ord")), "asked")
        offers = asked if held is None else held.union(asked)
        last, held = held, materialize(offers.groupBy("d_ord").agg(F.min("t_ord").alias("t_ord")).select("t_ord", "d_ord"), "held")
        refused = offers.join(held, ["t_ord", "d_ord"], "left_anti").select("t_ord")
        again = tx.join(refused, "t_ord").select("t_class", "t_ord")
        idle = open_.join(asked.select("t_ord"), "t_ord", "left_anti").join(parts.where("not whole").select(c("class").alias("t_class")), "t_class", "left_semi")
        done, open_ = open_, materialize(again.union(idle.select("t_class", "t_ord")), "open")
        quiet = not asked.head(1)
        for table in (asked, done, *([last] if last is not None else [])):
            discard(table)
        if not open_.head(1):
            break
        if quiet:
            wanted *= 4
            asking = open_.groupBy(c("t_class").alias("class")).agg((wanted + 2 * F.count("*")).alias("wanted")).join(parts.select("class", "below"), "class")
            page, cuts = _page(s, asking, least, levels)
            found = parts.join(asking.select("class"), "class", "left_anti").union(cuts)
            wish, parts = wish.union(page), materialize(found, "parts")
            rest = open_.join(cuts.select(c("class").alias("t_class")), "t_class", "left_semi")
            done, open_ = open_, materialize(rest.select("t_class", "t_ord"), "open")
            discard(done)
            if not open_.head(1):
                break
    discard(open_)
    sides = held.join(tx, "t_ord").join(docs, "d_ord")
    matched = edges(s.say(sides.select("t_class", "d_class").distinct()), least)
    return sides.join(matched.drop("d_first"), ["t_class", "d_class"]).drop("t_class", "d_class")


def tier_stats(matches: DataFrame, processed: Column) -> DataFrame:
    """Counts of matched pairs of rows, by reason; ``matches`` with a column n stand for so many each."""
    c = F.col
    each = c("n") if "n" in matches.columns else F.lit(1).cast("bigint")
    n = lambda x: F.coalesce(F.sum(F.when(x, each)), F.lit(0).cast("bigint"))
    stats = matches.agg(
        n(F.lit(True)).alias("matched"), n(c("reason") == "tip_adjustment").alias("tip_adjustments"),
        n(c("reason") == "currency_or_fee").alias("currency_matches"),
        n(c("reason") == "abbreviation").alias("abbreviation_matches"),
        n(c("reason") == "ocr_correction").alias("ocr_error_matches"))
    return stats.withColumns(
        {"rejected": processed - c("matched"),
            "match_rate": F.coalesce(F.try_divide(c("matched").cast("double"), processed), F.lit(0.0))})


def unsupported(tx: DataFrame, matches: DataFrame, least: float = 0.6) -> DataFrame:
    """Transactions without a match of confidence ``least``, with reason and label."""
    rows = tx.join(matches.where(F.col("confidence") >= least).select(F.col("t_id").alias("id")), "id", "left_anti")
    return rows.withColumns({"reason": unsupported_reason(F.col("merchant"), F.col("category")),
        "label": unsupported_label(F.col("merchant"), F.col("category"))})


def unreconciled(docs: DataFrame, matches: DataFrame, least: float = 0.6) -> DataFrame:
    matched = matches.where(F.col("confidence") >= least).select(F.col("d_id").alias("id"))
    rows = docs.join(matched.distinct(), "id", "left_anti")  # one document may be the best of very many transactions
    return rows.withColumns({"reason": unreconciled_reason(F.col("doc_type"), F.col("trust_score")),
        "label": unreconciled_label(F.col("doc_type"), F.col("trust_score"))})


#: Words and categories that explain a transaction without a document, and its label, in the order in which they apply.
DIGITAL = ("amazon", "uber", "netflix", "spotify", "paypal", "apple")
RECURRING_CATEGORIES, TRANSFER_CATEGORIES = ("subscriptions", "utilities", "rent"), ("transfer", "fees", "atm")
CASH = ("atm", "cash")
SUBSCRIPTIONS, ONLINE = ("netflix", "spotify", "adobe", "github", "apple"), ("amazon", "uber", "paypal", "doordash")
LABEL_TRANSFERS = ("transfer", "fees")


def _lowered(merchant: Column, category: Column) -> tuple[Column, Column]:
    return F.lower(F.coalesce(merchant, F.lit(""))), F.lower(F.coalesce(category, F.lit("")))


def unsupported_reason(merchant: Column, category: Column) -> Column:
    m, k = _lowered(merchant, category)
    return (F.when(contains_any(m, DIGITAL), "digital_purchase_no_receipt")
        .when(k.isin(*RECURRING_CATEGORIES), "recurring_payment_no_receipt").when(k == "income", "income_deposit")
            .when(k.isin(*TRANSFER_CATEGORIES), "transfer_or_fee").when(contains_any(m, CASH), "cash_withdrawal")
            .otherwise("no_document_found"))


def unsupported_label(merchant: Column, category: Column) -> Column:
    m, k = _lowered(merchant, category)
    return (F.when(k == "income", "Direct deposit").when(k.isin(*LABEL_TRANSFERS), "Bank transfer or fee")
        .when(contains_any(m, CASH), "Cash withdrawal")
            .when(contains_any(m, SUBSCRIPTIONS), "Digital subscription")
            .when(contains_any(m, ONLINE), "Online purchase").otherwise("Card transaction"))


def unreconciled_reason(doc_type: Column, trust: Column) -> Column:
    t = F.coalesce(trust, F.lit(0.0))
    return F.when(t < 0.5, "low_trust_document").when(t >= 0.8, "likely_cash_purchase").when(doc_type == "invoice",
        "unpaid_invoice").otherwise("no_transaction_found")


def unreconciled_label(doc_type: Column, trust: Column) -> Column:
    poor = F.coalesce(trust, F.lit(0.0)) < 0.5
    return F.when(doc_type == "invoice", "Unpaid invoice").when(doc_type == "statement",
        "Unmatched statement").when(poor, "Unverified document").otherwise("Possible cash purchase")


def mismatch_summary(unsupported_: DataFrame, unreconciled_: DataFrame, matches: DataFrame,
    least: float = 0.6) -> DataFrame:
    """(kind, reason, n): reasons of both kinds, and matches supported and of low confidence; each kind's counts are a table, made after the other's."""
    kind = lambda df, k: materialize(df.groupBy("reason").agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "reason",
        "n"), "reasons")
    ok = matches.select(F.when(F.col("confidence") >= least, "supported").otherwise("low_confidence").alias("reason"))
    return kind(unsupported_,
        "unsupported").unionByName(kind(unreconciled_, "unreconciled")).unionByName(kind(ok, "matches"))


def markers(unsupported_: DataFrame, unreconciled_: DataFrame) -> DataFrame:
    """One note for each item without a counterpart."""
    money = lambda x: F.concat(F.lit("$"), F.format_string("%.2f", x.cast("double")))
    a = unsupported_.select(F.lit("unsupported_spending").alias("type"), F.col("id").alias("transaction_id"),
        F.col("label").alias("user_label"),
        F.concat(money(parse_amount(F.col("amount"))), F.lit(" at "), "merchant", F.lit(" — no receipt found"))
        .alias("story_note"))
    who = F.coalesce(F.nullif(F.col("merchant"), F.lit("")),
        F.when(F.col("amount").isNull(), "unknown").otherwise("unknown merchant"))
    note = F.concat(F.lit("Receipt from "), who,
        F.when(F.col("amount").isNull(), "")
        .otherwise(F.concat(F.lit(" ("), money(parse_amount(F.col("amount"))), F.lit(")"))),
        F.lit(" — no matching bank transaction"))
    b = unreconciled_.select(F.lit("unreconciled_receipt").alias("type"), F.col("id").alias("document_id"),
        F.col("label").alias("user_label"), note.alias("story_note"))
    return a.unionByName(b, allowMissingColumns=True)


def coverage(n_supported: Column, n_unsupported: Column, n_unreconciled: Column) -> dict[str, Column]:
    share = lambda rest: F.coalesce(F.try_divide(n_supported.cast("double"), n_supported + rest),
        F.lit(0.0))
    return {"match_rate": share(n_unsupported), "transaction_coverage": share(n_unsupported),
        "document_coverage": share(n_unreconciled)}


def coverage_stats(matches: DataFrame, unsupported_: DataFrame, unreconciled_: DataFrame) -> DataFrame:
    one = lambda df, n: df.agg(F.count("*").alias(n))
    counts = one(matches, "supported").crossJoin(one(unsupported_, "unsupported")).crossJoin(
        one(unreconciled_, "unreconciled"))  # a row each
    return counts.withColumns(coverage(F.col("supported"), F.col("unsupported"), F.col("unreconciled")))


def evidence_chains(matches: DataFrame) -> DataFrame:
    """A match's components and stages, under an id that depends on the pair only."""
    return matches.select(
        F.substring(F.sha2(F.concat_ws(":", "t_id", "d_id"), 256), 1, 16).alias("match_id"),
        F.col("t_id").alias("transaction_id"), F.col("d_id").alias("document_id"), "confidence",
        F.struct("string_similarity", "amount_match", "date_proximity", "document_trust").alias("components"),
        F.array(F.concat(F.lit("reconcile_"), F.lower("match_type"))).alias("stages"))


def load_transactions(df: DataFrame) -> DataFrame:
    """Bank rows as reconciliation takes them: size of the amount as text, canonical name or else the raw one."""
    name = F.coalesce(*(F.col(c) for c in ("merchant_canonical", "merchant_raw") if c in df.columns), F.lit("Unknown"))
    return df.select("ord", F.col("transaction_id").alias("id"), F.abs("amount").cast("string").alias("amount"),
        F.col("date").cast("string").alias("date"), name.alias("merchant"),
        F.coalesce("category", F.lit("")).alias("category"))
