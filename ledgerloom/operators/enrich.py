"""Transaction enrichment: clean names, cluster merchants, categorise, fingerprint, label recurrence.

All scalar steps are built-in expressions and fuse into one stage. Steps that need a model take its output as a column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.rules import CATEGORIES, KEYWORDS, MERCHANT_FIRST
from ledgerloom.functions.storage import materialize
from ledgerloom.functions.text import alnum_id, chain, let, name_grams, name_similarity, name_words, squeeze, title

#: Fixed value.
TEMPLATE = "This bank transaction belongs to the {} spending category."
_STATES = r"\b(NY|CA|TX|FL|MI|WA)\b"
#: Prefix and noise rules of each cleaning variant, in order.
CLEANING = {
    "current": [(r"^SQ \*\s*", ""), (r"^TST\*\s*", ""), (r"^AMAZON\.COM\*", "AMAZON "), (r"^PAYPAL \*", ""),
        (r"^ONLINE PAYMENT\s*[-–]?\s*", ""), (r"#\d+", ""), (r"\d{8,}", ""), (_STATES, "")],
    "first": [(r"^SQ \*\s*", ""), (r"^TST\*\s*", ""), (r"^AMAZON\.COM\*", "AMAZON "), (r"^PAYPAL \*", ""),
        (r"#\d+", ""), (r"\d{8,}", ""), (r"\b(NY|CA|TX|FL|MI)\b", "")],
    "draft": [(r"^(SQ \*)+", ""), (r"^PAYPAL \*", "PAYPAL "), (r"#\d+", ""), (r"\d{5,}", "")],
}


def clean_merchant(raw: Column, variant: str = "current") -> Column:
    """A merchant's name without processor prefixes, store numbers and states; null gives the empty text. ``draft`` keeps the case."""
    x = F.trim(F.coalesce(raw, F.lit("")))
    if variant == "draft":
        return squeeze(chain(x, CLEANING[variant]))
    return title(squeeze(chain(F.upper(x), CLEANING[variant])))


def extract_entity(text: Column, entity: Column | None = None) -> Column:
    """The name that an entity model found (its column), or the text itself."""
    return F.coalesce(F.nullif(F.trim(entity), F.lit("")), text) if entity is not None else text


def first_words(text: Column, n: int = 2) -> Column:
    """The first words: what is left when a model finds nothing."""
    return F.array_join(F.slice(F.split(squeeze(text), " "), 1, n), " ")


def normalize_merchant(extracted: Column, clean: Column) -> Column:
    """The extracted name in letters, digits and title case, where it is long enough; else the clean name."""
    name = title(squeeze(F.regexp_replace(extracted, r"[^a-zA-Z0-9\s]", " ")))
    return F.when((F.length(extracted) > 3) & (F.length(name) > 2), name).otherwise(clean)


def _ladder(text: Column, rules: dict[str, str], value) -> Column:
    out = None
    for key, category in rules.items():
        hit = F.contains(text, F.lit(key))
        out = F.when(hit, value(key, category)) if out is None else out.when(hit, value(key, category))
    return out


def rule_classify(raw: Column, clean: Column, description: Column, merchants: dict[str, str] | None = None,
    keywords: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Struct (category, confidence, rule): the first merchant rule that applies, else the category with most keywords, else nulls with confidence 0."""
    merchants = MERCHANT_FIRST if merchants is None else merchants
    keywords = KEYWORDS if keywords is None else keywords
    text = F.lower(F.concat_ws(" ", *(F.coalesce(x, F.lit("")) for x in (raw, clean, description))))
    made = lambda c, p, r: F.struct(c.cast("string").alias("category"), p.cast("double").alias("confidence"),
        r.cast("string").alias("rule"))
    def decide(t: Column) -> Column:
        counts = F.array(*(F.struct(reduce(lambda a, b: a + b, (F.contains(t, F.lit(w)).cast("int") for w in words))
            .alias("n"), F.lit(-k).alias("first"),
            F.lit(c).alias("category")) for k, (c, words) in enumerate(keywords.items())))
        by_keyword = let(F.array_max(counts),
            lambda x: F.when(x["n"] > 0,
                made(x["category"], F.bround(F.least(0.6 + x["n"] * 0.1, F.lit(0.85)), 3),
                    F.concat(F.lit("keyword_match:"), x["category"]))))
        by_merchant = _ladder(t, merchants,
            lambda k, c: made(F.lit(c), F.lit(0.75), F.lit(f"merchant_first:{k}"))) if merchants else F.lit(None)
        return F.coalesce(by_merchant, by_keyword, made(F.lit(None), F.lit(0.0), F.lit(None)))

    return let(text, decide)


def top_scores(scores: Column) -> Column:
    """A score map as an array of (category, score), best first, ties by name."""
    entries = F.transform(F.map_entries(scores),
        lambda e: F.struct((-e["value"]).alias("key"), e["key"].alias("category"), e["value"].alias("score")))
    return F.transform(F.array_sort(entries),
        lambda e: F.struct(e["category"].alias("category"), e["score"].alias("score")))


def categorize(scores: Column, fallback: Column, auto: float = 0.7, suggested: float = 0.5, weak: float | None = None,
    allowed: tuple[str, ...] = CATEGORIES) -> Column:
    """Struct (category, confidence, confidence_level, status, method) from a model's scores and the rules' answer.

    Above ``auto`` the model's category is accepted, from ``suggested`` on it is suggested; below, the rules decide if they
    have an allowed category. With ``weak``, scores from there to ``suggested`` stay suggestions of low confidence and only lower ones fall back.
    """
    made = lambda c, p, level, status, method: F.struct(c.alias("category"), F.bround(p, 4).alias("confidence"),
        F.lit(level).alias("confidence_level"), F.lit(status).alias("status"),
        F.lit(method).alias("method"))

    def decide(z: Column) -> Column:
        top, score, ruled = z["best"]["category"], F.coalesce(z["best"]["score"], F.lit(0.0)), z["ruled"]
        out = F.when(score > auto, made(top, score, "high", "auto-accepted", "zero-shot")).when(score >= suggested,
            made(top, score, "medium", "suggested", "zero-shot"))
        if weak is not None:
            out = out.when(score >= weak, made(top, score, "low", "suggested", "zero-shot-weak"))
        return (out.when(ruled["category"].isin(*allowed),
            made(ruled["category"], ruled["confidence"], "medium", "fallback", "fallback-rules"))
                .otherwise(made(top, score, "low", "uncategorized", "zero-shot-failed")))

    return let(F.struct(F.get(top_scores(scores), F.lit(0)).alias("best"), fallback.alias("ruled")), decide)


def confidence_band(score: Column, high: float, medium: float) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def category_evidence(text: Column, scores: Column) -> Column:
    """What a category rests on: input, template, scores to 4 places, the best three and the margin of the first."""

    def describe(ranked: Column) -> Column:
        rounded = F.transform(ranked,
            lambda e: F.struct(e["category"].alias("category"), F.bround(e["score"], 4).alias("score")))
        margin = F.when(F.size(ranked) > 1,
            F.bround(F.get(ranked, F.lit(0))["score"] - F.get(ranked, F.lit(1))["score"], 4)).otherwise(1.0)
        return F.struct(
            text.alias("input_text"), F.lit(TEMPLATE).alias("hypothesis_template"),
            F.transform_values(scores, lambda k, v: F.bround(v, 4)).alias("all_scores"),
            F.slice(rounded, 1, 3).alias("top_3"), margin.alias("margin_to_second"))

    return let(top_scores(scores), describe)


def fingerprint(amount: Column, date: Column, merchant_id: Column) -> Column:
    """``12.50_20260131_merchant``: size of the amount, day, id."""
    return F.concat_ws("_", F.format_string("%.2f", F.abs(amount).cast("double")), F.date_format(date, "yyyyMMdd"),
        alnum_id(merchant_id))


def fingerprint_draft(amount: Column, date: Column, merchant_id: Column) -> Column:
    """The draft variant, with the amount as it is."""
    return F.concat_ws("_", F.abs(amount).cast("string"), F.replace(date.cast("string"), F.lit("-"), F.lit("")),
        merchant_id)


def exact_duplicates(tx: DataFrame, key: str = "fingerprint") -> DataFrame:
    """All rows whose key occurs more than once.

    Keys are counted with a combine before the shuffle and joined back, so a key with very many rows is no single task.
    """
    twice = tx.groupBy(key).agg(F.count("*").alias("copies")).where("copies > 1")
    return tx.join(twice, key)


def recurrence(tx: DataFrame, by: str = "canonical_id", bands: tuple[tuple[int, int], ...] = ((25, 35), (13, 15)),
    least: int = 3) -> DataFrame:
    """``tx`` with ``transaction_type``: recurring where all day gaps of a merchant lie in one band, repeat from two rows on, else one-time.

    A row of a null merchant is one-time. Days are reduced to distinct (merchant, day) with counts before they are
    ordered, so the window is over days, not rows; the label, a row per merchant, is joined back.
    """
    days = tx.where(F.col(by).isNotNull()).groupBy(by, "date").agg(F.count("*").alias("n"))
    gap = F.datediff("date", F.lag("date").over(Window.partitionBy(by).orderBy("date")))
    days = days.withColumn("gap", gap)
    # several rows on one day are gaps of 0, which lie in no band
    inside = [F.min(F.when(F.col("n") > 1, F.lit(lo <= 0 <= hi))
        .otherwise(F.coalesce(F.col("gap").between(lo, hi), F.lit(True)))) for lo, hi in bands]
    each = days.groupBy(by).agg(F.sum("n").alias("rows"), *(x.alias(f"b{k}") for k, x in enumerate(inside)))
    steady = reduce(lambda a, b: a | b, (F.col(f"b{k}") for k in range(len(bands))))
    label = F.when(steady & (F.col("rows") >= least), "recurring").when(F.col("rows") > 1,
        "repeat").otherwise("one-time")
    return tx.join(each.select(by, label.alias("__t")), by, "left").withColumn("transaction_type",
        F.coalesce("__t", F.lit("one-time"))).drop("__t")


def frequency_label(tx: DataFrame, by: str = "canonical_id") -> DataFrame:
    """A merchant's label by its number of rows: over three recurring, over one repeat."""
    n = tx.groupBy(by).agg(F.count("*").alias("n"))
    return n.withColumn("frequency",
        F.when(F.col("n") > 3, "recurring").when(F.col("n") > 1, "repeat").otherwise("one-time"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def hint_accuracy(df: DataFrame, found: str = "category", hint: str = "category_hint") -> DataFrame:
    return df.agg(F.bround(F.avg(F.coalesce(F.col(found) == F.col(hint), F.lit(False)).cast("int")), 4)
        .alias("accuracy"))


#: The patterns that are looked for in raw names, regular expressions, in order.
PATTERNS = ("SQ *", "TST*", "AMAZON", "UBER", "PAYPAL", "ONLINE PAYMENT")


def pattern_counts(df: DataFrame, patterns: tuple[str, ...] = PATTERNS, column: str = "merchant_raw") -> DataFrame:
    """Rows that each pattern, a regular expression, occurs in; case does not count."""
    counts = df.agg(*(F.count_if(F.rlike(column, F.lit(f"(?i){p}"))).alias(f"p{k}") for k, p in enumerate(patterns)))
    each = F.array(*(F.struct(F.lit(p).alias("pattern"), F.col(f"p{k}").alias("n")) for k, p in enumerate(patterns)))
    return counts.select(F.explode(each).alias("x")).select("x.*")


def _all_pairs(distinct: DataFrame) -> DataFrame:
    """(early, late): all pairs of names. Names are dealt over blocks of some 1,000, and each pair of blocks is a join key of its own."""
    n = distinct.count() // 1000 + 1
    own = distinct.select("name", F.pmod(F.xxhash64("name"), F.lit(n)).cast("int").alias("block"))
    side = lambda lesser, greater: F.struct(lesser.alias("i"), greater.alias("j"))
    other = F.sequence(F.lit(0), F.lit(n - 1))
    low = own.select(F.col("name").alias("early"), F.explode(F.transform(other, lambda k: side(F.col("block"), k))).alias("key"))
    high = own.select(F.col("name").alias("late"), F.explode(F.transform(other, lambda k: side(k, F.col("block")))).alias("key"))
    return low.join(high, "key").where("early < late").select("early", "late")


def _word_candidates(distinct: DataFrame, threshold: float) -> DataFrame:
    """(early, late): pairs whose shared words alone make one of the names similar to them.

    With lengths m of a name's joined words and c of the shared ones, 2 c / (c + m) is ``threshold`` or more only if c is at least
    threshold / (2 - threshold) of m; a name all of whose words are shared is the extreme case. So a name looks for others by its rarest words
    only, up to the first before which more than the rest of m has gone by. A word of very many names is thus a name's key only where
    nothing rarer stands beside it, and what met is kept only if enough is shared.
    """
    least = threshold / (2 - threshold)
    sets = materialize(distinct.select("name", name_words(F.lower("name")).alias("words")), "name-words")
    long = lambda words: F.aggregate(words, F.lit(-1), lambda n, w: n + F.length(w) + 1)
    sets = sets.withColumn("size", long(F.col("words")))
    each = sets.select("name", "words", "size", F.explode("words").alias("word"))
    ranked = each.join(each.groupBy("word").agg(F.count("*").alias("n")), "word")
    before = Window.partitionBy("name").orderBy("n", "word").rowsBetween(Window.unboundedPreceding, -1)  # the words of one name
    probes = ranked.withColumn("passed", F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0)))
    probes = probes.where(F.col("passed") <= F.col("size") * (1 - least) + 1e-9).select("word", F.col("name").alias("a"), F.col("words").alias("a_words"), "size")
    met = probes.join(each.select("word", F.col("name").alias("b"), F.col("words").alias("b_words")), "word").where("a <> b")
    met = met.where(long(F.array_intersect("a_words", "b_words")) >= F.col("size") * least - 1e-9)
    return met.select(F.least("a", "b").alias("early"), F.greatest("a", "b").alias("late"))


def _similar_candidates(distinct: DataFrame, threshold: float) -> DataFrame:
    """(early, late): all pairs of names that may be similar at ``threshold``, and few others.

    Either the words that a pair shares suffice (``_word_candidates``), or the indel similarity of one of its forms (plain, sorted words, distinct
    words in some order) is ``threshold`` or more. With lengths m and n and d <= (1 - threshold)(m + n) characters
    that are not common, the texts share (m + n - d) / 2 + 1 - d pairs of neighbouring characters at least, end marks included, and
    the shorter has threshold / (2 - threshold) of the longer's length. The order of words does not change a text's pairs, as an end mark is a
    space. So each text is found by its rarest pairs, as many as leave fewer than that number, and kept if it shares so many. Two
    letters tell short names poorly apart: how many meet depends on how rare their rarest pairs are. Under a threshold of 2/3 no shared pair is
    certain and all names are compared, block by block.
    """
    if threshold < 2 / 3:
        return _all_pairs(distinct)
    each = distinct.select("name", F.explode(name_grams(F.lower("name"))).alias("x")).select("name", "x.form",
        "x.size", F.explode("x.grams").alias("gram"))
    each = materialize(each, "grams")
    ranked = each.join(each.groupBy("form", "gram").agg(F.count("*").alias("n")), ["form", "gram"])
    texts = materialize(ranked.groupBy("name", "form",
        "size").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("grams")), "gram-sets")
    shared = F.ceil(F.col("size") * (2 / (2 - threshold) * (1.5 * threshold - 1)) + (1 - 1e-9))
    rare = F.slice("grams", F.lit(1), F.greatest(F.col("size") + 2 - shared, F.lit(1)).cast("int"))
    keyed = texts.select("name", "size", "grams.gram", F.explode(rare).alias("x"), "form").select("name", "size", "gram",
        F.struct("form", "x.gram").alias("key"))
    met = keyed.alias("a").join(keyed.alias("b"), F.expr("a.key = b.key and a.name < b.name"))
    alike = F.least("a.size", "b.size") >= F.greatest("a.size", "b.size") * (threshold / (2 - threshold)) - 1e-9
    total = F.col("a.size") + F.col("b.size")
    apart = F.floor(total * (1 - threshold) + 1e-9)
    common = F.size(F.array_intersect("a.gram", "b.gram"))
    met = met.where(alike).where(common >= (total - apart) / 2 + 1 - apart).select(F.col("a.name").alias("early"), F.col("b.name").alias("late"))
    return _word_candidates(distinct, threshold).union(met).distinct()


def cluster_merchants(names: DataFrame, threshold: float = 0.80, column: str = "merchant_normalized") -> DataFrame:
    """(name, canonical, canonical_id): greedy star clusters of distinct names in alphabetical order.

    A name leads a cluster unless an earlier leader is similar to it; every other name joins its earliest similar leader. Rather than one pass
    in order, rounds of joins settle all names whose earlier similar names are settled. Similarity is the best of
    plain, token-sort and token-set ratio. All pairs that can reach the threshold are compared (``_similar_candidates``); distinct names,
    not rows, are compared. The shortest member is the cluster's name, ties to the first.
    """
    distinct = materialize(names.select(F.col(column).alias("name")).where("name is not null and name <> ''")
        .distinct(), "names")
    pairs = _similar_candidates(distinct, threshold)
    edges = materialize(pairs.where(name_similarity(F.lower("early"), F.lower("late")) >= threshold), "similar")
    leaders = distinct.join(edges.select(F.col("late").alias("name")), "name", "left_anti").withColumn("leads",
        F.lit(True))
    state = materialize(leaders, "leaders")  # (name, leads) of settled names
    while True:
        open_ = edges.join(state.select(F.col("name").alias("late")), "late", "left_anti")
        known = open_.join(state.select(F.col("name").alias("early"), "leads"), "early", "left")
        # joins: some earlier neighbour leads; leads itself: all are settled and none leads
        verdict = known.groupBy(F.col("late").alias("name")).agg(F.max(F.coalesce("leads", F.lit(False)))
            .alias("led"), F.min(F.col("leads").isNotNull()).alias("all"))
        fresh = materialize(verdict.where("led or all").select("name", (~F.col("led")).alias("leads")), "round")
        if not fresh.head(1):
            break
        state = materialize(state.union(fresh), "settled")
    follows = edges.join(state.where("leads").select(F.col("name").alias("early")),
        "early").groupBy(F.col("late").alias("name")).agg(F.min("early").alias("leader"))
    placed = state.join(follows, "name", "left").select("name",
        F.when(F.col("leads"), F.col("name")).otherwise(F.col("leader")).alias("leader"))
    canonical = placed.groupBy("leader").agg(F.min(F.struct(F.length("name").alias("n"), "name"))["name"]
        .alias("canonical"))
    return placed.join(canonical, "leader").select("name", "canonical",
        alnum_id(F.col("canonical")).alias("canonical_id"))


def process(tx: DataFrame, scores: Column | None = None, entity: Column | None = None) -> DataFrame:
    """The whole chain. Without a model's ``scores`` (a map column) the rules decide; without ``entity`` names are their own.

    Names are cleaned, clustered and ruled once for each distinct (raw name, description, entity), of which a ledger has far fewer
    than rows, in a table in the shared folder that is joined back.
    """
    c = F.col
    found = entity if entity is not None else F.lit(None).cast("string")
    keys = ["merchant_raw", "description", "__entity"]
    rows = tx.withColumn("__entity", found)
    names = rows.select(*keys).distinct().withColumn("merchant_clean", clean_merchant(c("merchant_raw")))
    names = names.withColumn("merchant_extracted", extract_entity(c("merchant_clean"), c("__entity")))
    names = names.withColumn("merchant_normalized", normalize_merchant(c("merchant_extracted"), c("merchant_clean")))
    names = names.withColumns(
        {"normalized_id": alnum_id(c("merchant_normalized")),
            "ruled": rule_classify(c("merchant_raw"), c("merchant_clean"), c("description"))})
    names = materialize(names, "merchants")
    clusters = cluster_merchants(names).select(c("name").alias("merchant_normalized"),
        c("canonical").alias("merchant_canonical"), "canonical_id")
    known = materialize(names.join(clusters, "merchant_normalized", "left"), "known-merchants")
    known = known.select(*(c(k).alias(f"__k{n}") for n, k in enumerate(keys)),
        *(x for x in known.columns if x not in keys))
    same = [rows[k].eqNullSafe(known[f"__k{n}"]) for n, k in enumerate(keys)]
    rows = rows.join(known, reduce(lambda a, b: a & b, same)).drop("__entity", *(f"__k{n}" for n in range(len(keys))))
    given = scores if scores is not None else F.create_map().cast("map<string,double>")
    rows = rows.withColumn("decision", categorize(given, c("ruled"))).drop("ruled")
    rows = rows.withColumn("fingerprint", fingerprint(c("amount"), c("date"), c("canonical_id")))
    keep = [x for x in rows.columns if x not in ("decision", "category")]
    return recurrence(rows.select(*keep, "decision.*"))
