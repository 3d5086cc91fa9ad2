"""Operator 6: quality rules whose thresholds come from quantile sketches per language and source.

Everything here is DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.runtime import materialize

#: White space of the word rule, as a regular expression class and as characters.
SPACE_CLASS, SPACE_CHARS = r"[\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MARKS = ".,;!?" + SYMBOLS
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÀÂÇÈÉÊËÎÏÔÙÛÁÍÓÚÑ"
#: Sub-buckets of each power of two in a sketch, so a quantile is within 1/32 of its value.
SUB_BITS = 5
#: Measures (long, not negative) that are outliers beyond their group's fence. Each is well above 0 in ordinary text, so
#: its quantiles are: marks per 10,000 characters of words; 10,000 less the ratio of the logarithms of distinct words and
#: words, which hardly depends on a text's length; hundredths of characters per word; capitals per 10,000 characters.
RULES = ("mark_share", "monotony", "word_length", "capital_share")
#: A fence is this many times the distance from lower quartile to median above the median.
SPREAD = 14
#: Rows of its language (and, for a language, of all) that count beside a group's own.
PRIOR_ROWS = 50


def _but_first(a: Column, step: int) -> Column:
    return F.slice(a, step + 1, F.greatest(F.size(a) - step, F.lit(0)))


def _but_last(a: Column, step: int) -> Column:
    return F.slice(a, 1, F.greatest(F.size(a) - step, F.lit(0)))


def measures(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """Counts of each whole text, by array functions; nothing is shuffled.

    Windows of eight words are hashed by doubling (1, 2, 4, 8 words). Only texts in which some window occurs twice sort their
    windows to count the words that such windows cover.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    df = docs.select(
        F.col(f"`{id_col}`").alias("__id"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("source"), text.alias("text"))
    body = F.btrim("text", F.lit(SPACE_CHARS))
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACE_CHARS, "") != "")
    count = lambda chars: (F.length("text") - F.length(F.translate("text", chars, ""))).cast("bigint")
    df = df.withColumns({"words": F.when(body == "", F.array().cast("array<string>"))
        .otherwise(F.split(body, SPACE_CLASS)), "lines": lines})
    df = df.select(
        "__id", "lang", "source", F.size("words").cast("bigint").alias("n_words"),
        F.length(F.translate("text", SPACE_CHARS, "")).cast("bigint").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"), count(CAPITALS).alias("n_capitals"), count(MARKS).alias("n_marks"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    df = df.withColumn("n_distinct", F.size(F.array_distinct("h")).cast("bigint"))
    for step in (1, 2, 4):
        df = df.withColumn("h", F.zip_with(_but_last(F.col("h"), step), _but_first(F.col("h"), step),
            lambda a, b: F.xxhash64(a, b)))
    placed = F.when(F.size(F.array_distinct("h")) < F.size("h"),
        F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("p")))))
    df = df.withColumn("s", placed).drop("h")
    same = lambda x, at: F.coalesce(F.get(F.col("s"), at)["h"] == x["h"], F.lit(False))
    again = F.filter("s", lambda x, i: same(x, i - 1) | same(x, i + 1))
    df = df.withColumn("at",
        F.when(F.col("s").isNotNull() & (F.size("s") > 0), F.sort_array(F.transform(again, lambda x: x["p"]))))
    covered = F.aggregate(
        "at", F.struct(F.lit(-8).alias("last"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(8), p - acc["last"])).alias("n")),
        lambda acc: acc["n"])
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop("s", "at")


def bucket(v: Column) -> Column:
    """The sketch bucket of a non-negative long: exact below 64, then 32 to each power of two."""
    shift = F.greatest(F.length(F.bin(v)) - (SUB_BITS + 1), F.lit(0))
    return (shift * (1 << SUB_BITS) + F.call_function("shiftright", v, shift)).cast("int")


def upper_edge(b: Column) -> Column:
    """The largest value that a bucket holds."""
    shift = F.greatest(F.floor(b / (1 << SUB_BITS)).cast("int") - 1, F.lit(0))
    return F.call_function("shiftleft", (b - shift * (1 << SUB_BITS) + 1).cast("bigint"), shift) - 1


def fences(rows: DataFrame, rules: tuple[str, ...], spread: int, prior_rows: int) -> DataFrame:
    """(lang, source, rule, fence) from mergeable bucket-count sketches of each language and source.

    A sketch is the count of each bucket; sketches merge by adding, to those of the languages and of all rows.
    A fence is ``median + spread * (median - lower quartile)``: it is set by the better half of a group, so bad rows do
    not move it until they are half of the group. A group's quantiles are the mean of its own and its language's, weighted
    by its rows and ``prior_rows``; a language's likewise with those of all rows. So no group is too small, and none
    changes its rule at some size. Where copies make a group narrower than its language, the language's distance counts,
    and at least one part in 32 of the median, the sketch's own width.
    """
    pairs = ", ".join(f"'{r}', {r}" for r in rules)
    long = rows.selectExpr("lang", "source", f"stack({len(rules)}, {pairs}) as (rule, v)")
    own = long.groupBy("lang", "source", "rule", bucket(F.col("v")).alias("b")).agg(F.count("*").alias("n"))
    own = materialize(own, "sketches")

    def quantiles(keys: list[str], tag: str) -> DataFrame:
        merged = own.groupBy(*keys, "rule", "b").agg(F.sum("n").alias("n"))
        group = Window.partitionBy(*keys, "rule")
        cum = F.sum("n").over(group.orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
        run = merged.withColumns({"cum": cum, "all": F.sum("n").over(group)})
        at = lambda q: upper_edge(F.min(F.when(F.col("cum") * 100 >= F.col("all") * q, F.col("b"))))
        return run.groupBy(*keys, "rule").agg(F.max("all").alias(f"n_{tag}"), at(25).alias(f"low_{tag}"),
            at(50).alias(f"mid_{tag}"))

    def merged(quantile: str, tag: str, other: str) -> Column:
        total = F.col(f"n_{tag}") * F.col(f"{quantile}_{tag}") + prior_rows * F.col(f"{quantile}_{other}")
        return F.call_function("div", total, F.col(f"n_{tag}") + prior_rows)

    langs = quantiles(["lang"], "l").join(quantiles([], "a"), "rule")
    langs = langs.withColumns({"low_l": merged("low", "l", "a"), "mid_l": merged("mid", "l", "a")}).select("lang",
        "rule", "low_l", "mid_l")
    both = quantiles(["lang", "source"], "s").join(langs, ["lang", "rule"])
    both = both.withColumns({"low_s": merged("low", "s", "l"), "mid_s": merged("mid", "s", "l")})
    width = F.greatest(F.col("mid_s") - F.col("low_s"), F.col("mid_l") - F.col("low_l"),
        F.call_function("div", "mid_s", F.lit(1 << SUB_BITS)))
    return both.select("lang", "source", "rule", (F.col("mid_s") + spread * width).alias("fence"))


def adaptive_rules(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    source_col: str = "source",
    rules: tuple[str, ...] = RULES, spread: int = SPREAD, prior_rows: int = PRIOR_ROWS,
) -> DataFrame:
    """Judge every document by base rules and by its group's adaptive fences.

    Returns ``id_col``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words`` (long), ``base_failed`` (under 20 words, or over 30 % of them in repeated
    eight-word windows), ``kept``, and the measures, their fences (``fence_<rule>``) and ``broken`` (names of the rules beyond their fence).

    The sketches cover every row that the base rules pass. Counts are combined before the shuffle,
    so a source with a third of all rows is a few hundred rows by then. The join with the fences is
    left to the planner, which broadcasts them only when they are measured to be small.

    Defined cases: a null text has no words, fails the base rules and counts zero
    everywhere; very long texts are measured whole; a measure equal to its fence keeps the document; null language or source is the empty string; a null id stays null; repeated rows are
    judged alike; other columns are ignored; no rows give no rows.
    """
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    share = lambda part, of, whole: F.call_function("div", F.col(part) * of, whole)
    richness = F.ln(F.greatest("n_distinct", F.lit(1))) / F.ln(F.greatest("n_words", F.lit(2)))
    rows = measures(docs, id_col, text_col, lang_col, source_col).withColumns({
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        "mark_share": share("n_marks", 10000, chars),
        "monotony": F.lit(10000) - F.round(10000 * richness).cast("bigint"),
        "word_length": share("word_chars", 100, n), "capital_share": share("n_capitals", 10000, chars)})
    rows = materialize(rows, "measures")
    limits = fences(rows.where("not base_failed"), rules, spread, prior_rows)
    wide = limits.groupBy("lang",
        "source").agg(*(F.max(F.when(F.col("rule") == x, F.col("fence"))).alias(f"fence_{x}") for x in rules))
    wide = materialize(wide,
        "fences")  # with a known size, a small table is broadcast without dealing the rows out by source first
    broken = F.array_compact(F.array(*(F.when(F.col(x) > F.col(f"fence_{x}"), F.lit(x)) for x in rules)))
    out = rows.join(wide, ["lang", "source"], "left").withColumn("broken", broken)
    return out.select(
        F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"), *rules, *(f"fence_{x}" for x in rules),
        "broken")


#: The same in DuckDB SQL, for the tables of the driver.
ORACLE_SQL = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
w as (select *, list_filter(string_split_regex(t, '{SPACE_CLASS}'), lambda x: x <> '') as ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from d),
win as (select r, i, ws[i:i + 7] as win from (select r, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) >= 8)),
rep as (select r, i from (select r, i, count(*) over (partition by r, win) as c from win) where c > 1),
cov as (select r, count(distinct i + k) as n from rep, range(8) as x(k) group by r),
m as (select w.r, doc_id, lang, source, cast(len(ws) as bigint) as n_words, cast(len(list_aggregate(ws, 'string_agg', '')) as bigint) as wc0,
             cast(length(t) - length(translate(t, '{SYMBOLS}', '')) as bigint) as n_symbols, cast(length(t) - length(translate(t, '{CAPITALS}', '')) as bigint) as n_capitals,
             cast(length(t) - length(translate(t, '{MARKS}', '')) as bigint) as n_marks, len(list_distinct(ws)) as n_distinct,
             cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(coalesce(cov.n, 0) as bigint) as n_repeat_words
      from w left join cov on w.r = cov.r),
f as (select * exclude (wc0), coalesce(wc0, 0) as word_chars, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
             n_marks * 10000 // greatest(coalesce(wc0, 0), 1) as mark_share,
             10000 - cast(round(10000 * (ln(greatest(n_distinct, 1)) / ln(greatest(n_words, 2)))) as bigint) as monotony,
             coalesce(wc0, 0) * 100 // greatest(n_words, 1) as word_length, n_capitals * 10000 // greatest(coalesce(wc0, 0), 1) as capital_share from m),
long as (unpivot (select lang, source, {", ".join(RULES)} from f where not base_failed) on {", ".join(RULES)} into name rule value v),
b as (select lang, source, rule, greatest(length(bin(v)) - 6, 0) as s, v from long),
own as (select lang, source, rule, s, (v >> s) as sub, s * 32 + (v >> s) as b, count(*) as n from b group by all),
cum as (select *, sum(n) over (partition by lang, source, rule order by b) as c1, sum(n) over (partition by lang, source, rule) as a1,
               sum(n) over (partition by lang, rule order by b) as c2, sum(n) over (partition by lang, rule) as a2,
               sum(n) over (partition by rule order by b) as c3, sum(n) over (partition by rule) as a3, ((sub + 1) << s) - 1 as edge from own),
q1 as (select lang, source, rule, max(a1) as n, min(edge) filter (c1 * 100 >= a1 * 25) as low, min(edge) filter (c1 * 100 >= a1 * 50) as mid from cum group by all),
q2 as (select lang, rule, max(a2) as n, min(edge) filter (c2 * 100 >= a2 * 25) as low, min(edge) filter (c2 * 100 >= a2 * 50) as mid from cum group by all),
q3 as (select rule, min(edge) filter (c3 * 100 >= a3 * 25) as low, min(edge) filter (c3 * 100 >= a3 * 50) as mid from cum group by all),
l as (select lang, rule, (q2.n * q2.low + {PRIOR_ROWS} * q3.low) // (q2.n + {PRIOR_ROWS}) as low, (q2.n * q2.mid + {PRIOR_ROWS} * q3.mid) // (q2.n + {PRIOR_ROWS}) as mid from q2 join q3 using (rule)),
g as (select lang, source, rule, l.mid - l.low as width, (q1.n * q1.low + {PRIOR_ROWS} * l.low) // (q1.n + {PRIOR_ROWS}) as low, (q1.n * q1.mid + {PRIOR_ROWS} * l.mid) // (q1.n + {PRIOR_ROWS}) as mid
      from q1 join l using (lang, rule)),
fence as (select lang, source, rule, mid + {SPREAD} * greatest(mid - low, width, mid // {1 << SUB_BITS}) as fence from g),
bad as (select distinct f.r from f join fence using (lang, source) where case rule {" ".join(f"when '{x}' then {x}" for x in RULES)} end > fence)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and bad.r is null as kept
from f left join bad on f.r = bad.r
"""
