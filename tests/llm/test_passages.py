"""Repeated passages against a plain pass over all runs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from ledgerloom.llm.line_dedup import remove_repeated_units
from ledgerloom.llm.queries import op1_substring_dedup
from ledgerloom.llm.passages import fingerprints, open_windows, run_hashes, smallest_prints
from tests.llm.test_dedup import DOCS

WORDS = 51


def brute_passages(rows, words=WORDS, least=WORDS):
    """Words that stay after repeated lines of ``least`` words and repeated windows are cut, by id."""
    first, texts = {}, {i: (t or "").lower().split() for i, t in rows}
    gone = {i: np.zeros(len(w), bool) for i, w in texts.items()}
    lines, given = {}, dict(rows)
    for i in sorted(texts):
        at = 0
        for n, line in enumerate((given[i] or "").lower().split("\n")):
            form = line.split()
            if len(form) >= least and lines.setdefault(tuple(form), (i, n)) != (i, n):
                gone[i][at : at + len(form)] = True
            at += len(form)
        for n in range(len(texts[i]) - words + 1):
            if first.setdefault(tuple(texts[i][n : n + words]), (i, n)) != (i, n):
                gone[i][n : n + words] = True
    return {i: [w for w, g in zip(texts[i], gone[i], strict=True) if not g] for i in texts}


def cut_again(text, spans):
    out, at = "", 0
    for a, b in spans:
        assert at <= a < b <= len(text)
        out, at = out + text[at:a], b
    return out + text[at:]


@pytest.mark.parametrize("size", [1, 2, 3, 20, 51])
def test_run_hashes_and_fingerprints(size):
    rng = np.random.default_rng(size)
    h = rng.integers(0, 2**63, 400).astype(np.uint64)
    h[300:360] = h[100:160]
    got = run_hashes(h, size)
    assert len(got) == 400 - size + 1
    assert len({tuple(h[i : i + size]) for i in range(len(got))}) == len(set(got.tolist()))
    if size >= 20:
        low = smallest_prints(h, WORDS)
        assert np.array_equal(low[100:110], low[300:310])
        assert set(fingerprints(h, WORDS).tolist()) == set(low.tolist())
        open_ = np.arange(len(low)) < 90
        assert set(fingerprints(h, WORDS, open_).tolist()) == set(low[open_].tolist())
        assert len(fingerprints(h, WORDS)) < 60 and len(fingerprints(h[: WORDS - 1], WORDS)) == 0


def test_windows_within_a_cut_unit_are_done():
    text = "a b c\nd e f g\nh i"
    spans = [{"start": 6, "end": 14}, {"start": 0, "end": 6}]
    assert open_windows(text, spans, 7, 3).tolist() == [False, True, True, False, False, True, True]
    assert open_windows(text, None, 7, 3).all()


def test_passages_inside_lines(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    run = [[word() for _ in range(n)] for n in (50, 51, 60, 90, 200)]
    own = lambda n: [word() for _ in range(n)]
    rows = []
    for k in range(40):
        parts = [own(rng.randrange(60)), rng.choice(run), own(rng.randrange(9)), rng.choice(run)[rng.randrange(30) :], own(rng.randrange(5))]
        text = " ".join(w.upper() if rng.random() < 0.1 else w for p in parts for w in p)
        rows.append((k, text if k % 3 else text.replace(" ", "\n", rng.randrange(4)).replace(" ", "  \t", 5)))
    rows += [(100, " ".join(["same"] * 200)), (101, None), (102, ""), (103, " ".join(run[4])), (104, "é " + " ".join(run[3]) + " ü\nlast")]
    rows += [(105, rows[1][1]), (106, "x " + rows[1][1].replace("  ", " ") + "\ny"), (107, "\n".join(run[4][:30]) + "\n" + " ".join(run[4][30:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("place", F.lit("x"))
    for least in (WORDS, 5):
        got = {r.doc_id: r for r in remove_repeated_units(df, min_words=least, passage_words=WORDS).collect()}
        assert {i: (r.text or "").lower().split() for i, r in got.items()} == brute_passages(rows, least=least)
        for i, t in rows:
            assert got[i].place == "x" and got[i].n_removed == len(got[i].removed)
            assert (got[i].text or "").split() == cut_again(t or "", got[i].removed).split()
        assert got[104].text == "é ü\nlast" and got[103].text == "" and got[101].text is None and got[105].text == ""


def test_passages_of_documents_match_brute_force(spark):
    docs = spark.read.parquet(DOCS)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.text for r in op1_substring_dedup(spark, DOCS.rpartition("/")[0]).collect()}
    assert {i: (t or "").lower().split() for i, t in got.items()} == brute_passages(rows)


def test_very_long_texts_and_string_ids(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    rows = [("b", " ".join(words)), ("a", " ".join(words[20_000:50_000])), (None, " ".join([*words[:100], "end"])), ("c", "\n".join(words[59_000:]))]
    df = spark.createDataFrame(rows, "name string, text string")
    got = {r.name: r.text.split() for r in remove_repeated_units(df, id_col="name", min_words=WORDS, passage_words=WORDS).collect()}
    assert got == {"a": words[20_000:50_000], "b": words[:20_000] + words[50_000:], "c": [], None: ["end"]}


def test_no_rows_and_one_id(spark):
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(1, "a " + text), (1, "a " + text), (None, "b " + text + " c")], "doc_id long, text string")
    df = df.withColumns({"slot": F.lit("mine"), "bits": F.lit("mine"), "print": F.lit("mine")})
    assert all((r.slot, r.bits, r.print) == ("mine", "mine", "mine") for r in remove_repeated_units(df, passage_words=WORDS).collect())
    assert sorted(r.text for r in remove_repeated_units(df, passage_words=WORDS).collect()) == ["a " + text, "a " + text, "b c"]
    assert remove_repeated_units(df.limit(0), passage_words=WORDS).count() == 0


def test_the_pipeline_cuts_passages(spark, tmp_path, monkeypatch):
    run = " ".join(f"w{i}" for i in range(60))
    spark.createDataFrame([(1, "a " + run, 0), (2, "b " + run + " c", 0)], "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(pipeline, "STAGES", [("substring dedup", pipeline.substring_dedup), ("last", lambda spark, docs, sf_dir: docs)])
    assert {r.doc_id: (r.text, r.n_chars) for r in pipeline.run(spark, str(tmp_path)).collect()} == {1: ("a " + run, len(run) + 2), 2: ("b c", 3)}
