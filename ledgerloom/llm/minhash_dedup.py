"""Operator 7: near-duplicate groups by MinHash banding, exact confirmation and star components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import connected_components
from ledgerloom.llm.hashing import MinHasher, set_digest, shingle_hashes, words_of
from ledgerloom.llm.runtime import arrow_map, discard, id_and_text, materialize, ship, utf8_bytes

#: Members of one block of a bucket whose signatures are compared pair by pair, and of a part of it whose texts are.
BLOCK_MEMBERS, TEXT_MEMBERS = 2048, 256
#: A signature estimate this far under the threshold rules a pair out: with 128 minima, a pair at 0.8 with probability 8e-8.
SLACK = 0.2


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    both = _overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def signatures(docs: DataFrame, words: int, hasher: MinHasher) -> DataFrame:
    """Per row: id, set size, digest of the shingle set, band keys, 16-bit signature."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        sizes, digests = np.zeros(n, np.int64), [None] * n
        minima = np.zeros((n, hasher.bands * hasher.rows), np.uint64)
        for k, text in enumerate(utf8_bytes(batch.column("__text"))):
            got = shingle_hashes(words_of(text), words)
            sizes[k] = len(got)
            if len(got):
                digests[k] = set_digest(got)
                minima[k] = hasher.minima(got)
        keys = hasher.band_keys(minima)
        sig = hasher.signature(minima)
        bands = pa.ListArray.from_arrays(np.arange(0, n * hasher.bands + 1, hasher.bands, dtype=np.int32),
            pa.array(keys.ravel()))
        return pa.RecordBatch.from_arrays(
            [batch.column("__id"), pa.array(sizes), pa.array(digests, pa.binary()), bands,
                pa.array([x.tobytes() for x in sig], pa.binary())],
            names=["__id", "n", "digest", "bands", "sig"])

    return arrow_map(docs, fn, "__id bigint, n bigint, digest binary, bands array<bigint>, sig binary")


def _confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The (u, v) of ``pairs`` (u, v) that are linked on their full sets."""
    left = texts.select(F.col("__id").alias("u"), F.col("__text").alias("text_u"))
    right = texts.select(F.col("__id").alias("v"), F.col("__text").alias("text_v"))
    joined = pairs.join(left, "u").join(right, "v").select("u", "v", "text_u", "text_v")

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        last, keep = (None, None), []
        for a, b in zip(utf8_bytes(batch.column("text_u")), utf8_bytes(batch.column("text_v")), strict=True):
            if b != last[0]:
                last = (b, shingle_hashes(words_of(b), words))
            keep.append(_linked(shingle_hashes(words_of(a), words), last[1], percent))
        return batch.select(["u", "v"]).filter(pa.array(keep))

    return arrow_map(joined, fn, "u bigint, v bigint")


def _similar(pairs: DataFrame, base: DataFrame, percent: int) -> DataFrame:
    """The pairs whose signatures do not rule a link out (signature verification)."""
    left = base.select(F.col("__id").alias("u"), F.col("sig").alias("sig_u"))
    right = base.select(F.col("__id").alias("v"), F.col("sig").alias("sig_v"))
    joined = pairs.join(left, "u").join(right, "v").select("u", "v", "sig_u", "sig_v")

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16)
            .reshape(batch.num_rows, -1) for c in ("sig_u", "sig_v"))
        return batch.select(["u", "v"]).filter(pa.array((a == b).mean(axis=1) >= percent / 100 - SLACK))

    return arrow_map(joined, fn, "u bigint, v bigint")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, as a product of 0/1 matrices over the shingles that two sets or more have, by column blocks."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[column]
    keep = place >= 0
    owner, place = owner[keep], place[keep]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    width = 2048
    for first in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        lo, hi = np.searchsorted(place, [first, first + width])
        grid = np.zeros((len(sets), width), np.float32)
        grid[owner[lo:hi], place[lo:hi] - first] = 1
        total += grid @ grid.T
    return total.astype(np.int64)


def _open_pairs(group: pa.Table, percent: int) -> np.ndarray:
    """Which (home, away) pairs of a block are to be tested: of different roots, in the first band they share, not ruled out by
    their signatures. A pair of which neither has the bucket's main root meets in two blocks and counts in one."""
    ids, roots, home, away = (group[c].to_numpy(zero_copy_only=False) for c in ("__id", "root", "is_home", "is_away"))
    h, a = np.flatnonzero(home), np.flatnonzero(away)
    main, band = group["main"][0].as_py(), group["band"][0].as_py()
    open_ = (roots[h][:, None] != roots[a][None, :]) & ((roots[h] == main)[:, None]
        | (ids[h][:, None] < ids[a][None, :]))
    keys = np.array(group["bands"].to_pylist(), np.int64)
    for k in range(band):
        open_ &= keys[h, k][:, None] != keys[a, k][None, :]
    sig = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint16).reshape(len(ids), -1)
    sig_h, sig_a = sig[h], sig[a]
    for y in np.flatnonzero(open_.any(axis=0)):
        xs = np.flatnonzero(open_[:, y])
        open_[xs, y] = (sig_h[xs] == sig_a[y]).mean(axis=1) >= percent / 100 - SLACK
    full = np.zeros((len(ids), len(ids)), bool)
    full[np.ix_(h, a)] = open_
    return full


def _explore(members: DataFrame, mixed: DataFrame, base: DataFrame, texts: DataFrame, words: int,
    percent: int) -> DataFrame:
    """Links inside buckets that still hold several components, by blocks of members.

    ``members``: (bucket, band, __id, root); ``mixed``: (bucket, main, n_home, n_away). Only members outside of a bucket's most
    frequent root (``main``) have partners to be sought, so each member has one home block, each of the others one away
    block as well, and a group is one home block with one away block: ``2 * BLOCK_MEMBERS`` members or so, some 600 bytes each. Members that are linked
    already are never paired, and a bucket of which all but a few members are linked is not multiplied.

    Ids, bands and signatures alone meet first; texts are fetched for members that some signature leaves a partner, and meet
    by parts of ``TEXT_MEMBERS`` of either block. A pair is
    tested in the first band that it shares, on full sets: many pairs at once as a matrix product, few one by one. A
    group returns only links that join two components, never more than its members.
    """
    kinds = "bucket bigint, home int, away int, band int, main bigint, __id bigint, root bigint, is_home boolean, is_away boolean"
    names = [x.split()[0] for x in kinds.split(", ")]
    every = members.join(mixed, "bucket").withColumn("sought", F.col("root") != F.col("main"))
    mine = lambda n, seed: F.pmod(F.xxhash64("__id", F.lit(seed)), F.col(n)).cast("int")
    numbers = lambda n: F.sequence(F.lit(0), F.col(n).cast("int") - 1)
    place = lambda home, away, is_home, is_away: F.struct(
        home.alias("home"), away.alias("away"), is_home.alias("is_home"), is_away.alias("is_away"))
    yes, no, first = F.lit(True), F.lit(False), F.lit(0)
    homes = F.transform(numbers("n_away"), lambda away: place(mine("n_home", 1), away, yes, no))
    aways = F.transform(numbers("n_home"), lambda home: place(home, mine("n_away", 2), no, yes))
    both = F.when(F.col("sought"), F.concat(homes, aways)).otherwise(homes)
    # in a bucket of one block a member meets all others as it is
    both = F.when(F.col("n_home") == 1, F.array(place(first, first, yes, F.col("sought")))).otherwise(both)
    placed = every.withColumn("p", F.explode(both)).select(*names[:1], "p.home", "p.away", *names[3:7], "p.is_home", "p.is_away")
    prints = base.select("__id", "sig", "bands")

    def hopeful(group: pa.Table) -> pa.Table:
        open_, out, part = _open_pairs(group, percent), [], []
        h, a = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
        for i in range(0, len(h), TEXT_MEMBERS):
            for j in range(0, len(a), TEXT_MEMBERS):
                some_h, some_a = h[i : i + TEXT_MEMBERS], a[j : j + TEXT_MEMBERS]
                here = open_[np.ix_(some_h, some_a)]
                here = np.union1d(some_h[here.any(axis=1)], some_a[here.any(axis=0)])
                out.append(here)
                part += [(i << 16) + j] * len(here)
        found = group.select(names).take(pa.array(np.concatenate([np.empty(0, np.int64), *out])))
        return found.append_column("part", pa.array(part, pa.int64()))

    def linked(group: pa.Table) -> pa.Table:
        open_, out = _open_pairs(group, percent), []
        if open_.any():
            ids, roots = group["__id"].to_pylist(), group["root"].to_pylist()
            raw = utf8_bytes(group["__text"].combine_chunks())
            used = np.flatnonzero(open_.any(axis=0) | open_.any(axis=1))
            sets = {int(k): shingle_hashes(words_of(raw[k]), words) for k in used}
            if open_.sum() > 4 * len(used):
                at = {int(k): n for n, k in enumerate(used)}
                both, n = intersections([sets[int(k)] for k in used]), np.array([len(sets[int(k)]) for k in used])
                xs, ys = np.nonzero(open_)
                i, j = np.array([at[k] for k in xs.tolist()]), np.array([at[k] for k in ys.tolist()])
                good = 100 * both[i, j] >= percent * (n[i] + n[j] - both[i, j])
                found = zip(xs[good].tolist(), ys[good].tolist(), strict=True)
            else:
                found = ((x, y) for x, y in zip(*(z.tolist() for z in np.nonzero(open_)), strict=True)
                    if _linked(sets[x], sets[y], percent))
            parent = {r: r for r in roots}

            def find(x: int) -> int:
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            for x, y in found:
                a, b = find(roots[x]), find(roots[y])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((ids[y], ids[x]))
        return pa.table({"u": pa.array([u for u, _ in out], pa.int64()),
            "v": pa.array([v for _, v in out], pa.int64())})

    ship(members.sparkSession)
    some = materialize(placed.join(prints, "__id").groupBy("bucket", "home", "away")
        .applyInArrow(hopeful, f"{kinds}, part bigint"), "hopeful")
    return some.join(prints, "__id").join(texts, "__id").groupBy("bucket", "home", "away",
        "part").applyInArrow(linked, "u bigint, v bigint")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80,
    bands: int = 32, rows: int = 4, seed: int = 7,
) -> DataFrame:
    """Group documents whose sets of word shingles have a Jaccard similarity of ``percent`` or more.

    Returns one row per input row: ``id_col``, ``n_shingles``, ``component_id``
    (smallest id reachable over links, itself included), ``kept`` (the id is
    that smallest one).

    1. A pass over the texts makes the shingle set of each row, its 128-bit digest and
       ``bands * rows`` universal hash minima. Equal sets collapse by digest to
       one representative, so a group of exact copies costs one row.
    2. Representatives meet in band buckets. Each is first paired with the
       smallest id among its buckets, then with the other buckets' smallest ids
       where components still differ. Pairs pass a signature estimate and then
       the exact test on full sets.
    3. Components come from alternating large-star and small-star.
    4. Buckets that still hold several components are examined in blocks, so no link that
       banding proposes is lost; already connected members are neither paired nor multiplied.

    A pair exactly at 0.8 is missed with probability ``(1 - 0.8**4)**32``, 5e-8, by the bands and with 8e-8 by the
    signatures, if nothing else links its ends.

    Defined cases: null and word-less texts have an empty set, ``n_shingles`` 0,
    and link with nothing; very long texts enter with their full sets; a similarity of exactly ``percent`` links; fewer words than a shingle make the whole sequence one shingle; a null id
    links with nothing and is kept (``component_id`` null); rows that share an
    id are one node; other columns are ignored; an empty table gives no rows.
    """
    hasher = MinHasher(bands, rows, seed)
    rows_in = id_and_text(docs, id_col, text_col).withColumn("__id", F.col("__id").cast("bigint"))
    base = materialize(signatures(rows_in, shingle_words, hasher), "minhash")
    known = base.where("n > 0 and __id is not null")
    classes = materialize(known.groupBy("digest").agg(F.min("__id").alias("rep"), F.count("*").alias("members")),
        "classes")
    reps = known.join(classes.select("digest", "rep"), "digest").where("__id = rep")

    buckets = reps.select("__id", F.posexplode("bands").alias("band", "bucket")).distinct()
    heads = buckets.groupBy("bucket").agg(F.min("__id").alias("head"), F.count("*").alias("size")).where("size > 1")
    shared = materialize(buckets.join(heads, "bucket"), "buckets")
    links = roots = None
    heads_of = shared.where("__id <> head").groupBy("__id").agg(F.min("head").alias("head"))
    first = heads_of.select(F.col("__id").alias("u"), F.col("head").alias("v"))
    wanted = shared.select("__id").distinct()
    texts = materialize(rows_in.join(wanted, "__id", "left_semi"), "texts")

    def settle(new: DataFrame) -> DataFrame:
        nonlocal links
        new = materialize(new, "links")
        if links is not None and not new.head(1):
            return roots
        links = new if links is None else links.union(new)
        return materialize(connected_components(links), "roots")

    roots = settle(_confirm(_similar(first, base, percent), texts, shingle_words, percent))

    def rooted(df: DataFrame, col: str, name: str) -> DataFrame:
        r = roots.select(F.col("node").alias(col), F.col("root").alias("__r"))
        return df.join(r, col, "left").withColumn(name, F.coalesce("__r", col)).drop("__r")

    rest = shared.where("__id <> head").select(F.col("__id").alias("u"),
        F.col("head").alias("v")).distinct().join(first, ["u", "v"], "left_anti")
    rest = materialize(rooted(rooted(rest, "u", "ru"), "v", "rv").where("ru <> rv").select("u", "v"), "rest")
    if rest.head(1):
        roots = settle(_confirm(_similar(rest, base, percent), texts, shingle_words, percent))

    # every head was paired with its whole bucket, so only pairs without it are left to examine
    others = shared.where("size > 2 and __id <> head").select("bucket", "band", "__id")
    others = materialize(rooted(others, "__id", "root"), "memberships")
    sizes = others.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("most"),
        F.sum("n").alias("size")).where("size > most.n")
    in_blocks = lambda n: F.ceil(n / BLOCK_MEMBERS).cast("bigint")
    mixed = materialize(sizes.select("bucket", F.col("most.root").alias("main"),
        in_blocks(F.col("size")).alias("n_home"),
                                     in_blocks(F.col("size") - F.col("most.n")).alias("n_away")), "mixed")
    if mixed.head(1):
        roots = settle(_explore(others, mixed, base, texts, shingle_words, percent))

    discard(texts)
    out = (base.join(classes.select("digest", "rep"), "digest", "left")
        .join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
           .select(F.col("__id").alias(id_col), F.col("n").alias("n_shingles"),
               F.when(F.col("__id").isNotNull(), F.coalesce("root", "rep", "__id")).alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col(f"`{id_col}`") == F.col("component_id"), F.lit(True)))
