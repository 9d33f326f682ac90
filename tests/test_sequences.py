import math
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelweave.functions import scoring, sequences
from labelweave.operators import pooling, tfidf


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r["x"] for r in df.select("i", expr(F.col("s")).alias("x")).orderBy("i").collect()]


def test_numeric_ids(spark):
    assert column(spark, ["P12", "12", "P12x", "AB007", ""], sequences.numeric_id) == [12, -1, -1, 7, -1]


@pytest.mark.parametrize("length,count", [(1022, 1), (1023, 2), (1534, 2), (1535, 3), (5, 1), (0, 1)])
def test_chunk_counts(spark, length, count):
    (parts,) = column(spark, ["A" * length], lambda c: sequences.chunks(c, 1022, 512))
    assert len(parts) == count


def test_short_last_chunk_is_dropped(spark):
    (parts,) = column(spark, ["A" * 25], lambda c: sequences.chunks(c, 20, 20))
    assert parts == ["A" * 20]


@pytest.mark.parametrize("max_len", [9, 10, 11])
def test_token_ids(spark, max_len):
    texts = ["ACD", "ACDEFGHIK", "ACDEFGHIKL", "ACDEFGHIKLMNPQRSTVWY", "AxYz" * 9]
    got = column(spark, texts, lambda c: sequences.token_ids(c, max_len))
    for text, ids in zip(texts, got):
        known = [sequences.STANDARD_RESIDUES.find(c) + 1 or 21 for c in text]
        third, size = max_len // 3, len(known)
        if size > max_len:
            keep = max_len - 2 * third
            start = max(0, size // 2 - keep // 2)
            known = known[:third] + known[start : start + keep] + known[-third:]
        assert ids == known + [0] * (max_len - len(known))


def test_composition_denominator_and_empty(spark):
    df = spark.createDataFrame([("AAx",), ("",)], "s string").select(
        *[c.alias(n) for n, c in sequences.composition(F.col("s")).items()]
    )
    full, empty = df.collect()
    assert full["frac_A"] == pytest.approx(2 / 3) and full["log_length"] == pytest.approx(math.log1p(3))
    assert sum(empty) == 0.0


def test_cleaning(spark):
    assert column(spark, ["abouzx"], sequences.clean_sequence) == ["AXXXXX"]


TEXTS = ["abcabc", "ab  \n c", "", "aé😀b😀b", "abc abc abc", "xy"]


def brute_counts(text, cfg):
    text = tfidf._RUN_OF_SPACE.sub(" ", text)
    return Counter(text[i : i + n] for n in range(cfg.ngram_min, cfg.ngram_max + 1) for i in range(len(text) - n + 1))


@pytest.mark.parametrize("low,high", [(1, 1), (2, 4), (3, 5)])
def test_ngram_counts(spark, low, high):
    cfg = tfidf.TfidfConfig(low, high)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "row_idx bigint, sequence string")
    got = {(r["row_idx"], r["term"]): r["tf"] for r in tfidf.term_counts(df, cfg).collect()}
    want = {(i, t): n for i, text in enumerate(TEXTS) for t, n in brute_counts(text, cfg).items()}
    assert got == want


def test_equal_terms_follow_one_another(spark):
    """Stored by term, rows of one group of texts take about two thirds of the bytes."""
    df = spark.createDataFrame(list(enumerate(TEXTS * 10)), "row_idx bigint, sequence string")
    rows = tfidf.term_counts(df, tfidf.TfidfConfig(2, 2)).groupBy(F.spark_partition_id().alias("p"))
    for part in rows.agg(F.collect_list("term").alias("terms")).collect():
        runs = 1 + sum(a != b for a, b in zip(part["terms"], part["terms"][1:]))
        assert runs == len(set(part["terms"]))


def test_texts_are_read_a_group_at_a_time():
    batch = pa.RecordBatch.from_arrays([pa.array(range(80)), pa.array(["ab" * 50_000] * 80)], names=["row_idx", "sequence"])
    tracemalloc.start()
    sizes = [sum(map(len, texts)) for _, texts in tfidf._groups(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == 8_000_000
    assert peak < 3_000_000


def test_rounding_is_that_of_decimals(spark):
    ties = [k / 1e6 + d for k in (0, 1, 12_345, 999_999) for d in (5e-7, 5e-7 + 1e-17, 5e-7 - 1e-17, 4.9e-7, 5.1e-7)]
    values = [*ties, *(-v for v in ties), 0.1234565, 1.0000005, 123456.1234565, 1e12 + 0.5, float("nan"), float("inf"), None, 0.0, -1e-9]
    values += [(i * 7919 % 1_000_003) / 1_000_003 for i in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert df.where(~scoring.rounded(F.col("v"), 6).eqNullSafe(F.round("v", 6))).count() == 0


def test_long_form_of_vectors_made_as_they_are_read(spark):
    cfg = tfidf.TfidfConfig(2, 3, 2, 4)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "row_idx bigint, sequence string")
    _, kept, _ = tfidf.fit_transform(df, None, cfg)
    _, made, _ = tfidf.fit_transform(df, None, cfg, stored=False)
    assert kept.inputFiles() and not made.inputFiles()
    want = [(r["row_idx"], i, x) for r in kept.collect() for i, x in zip(r["idx"], r["val"])]
    for vectors in (kept, made):
        assert sorted(tuple(r) for r in tfidf.long_form(vectors).collect()) == sorted(want)


def test_tfidf_vectors(spark):
    cfg = tfidf.TfidfConfig(2, 3, 2, 4)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "row_idx bigint, sequence string")
    vocab, vectors, _ = tfidf.fit_transform(df, None, cfg)
    counts = [brute_counts(t, cfg) for t in TEXTS]
    df_, cf = Counter(t for c in counts for t in c), sum(counts, Counter())
    kept = sorted(sorted((t for t in cf if df_[t] >= 2), key=lambda t: (-cf[t], t))[:4])
    assert [r["term"] for r in vocab.orderBy("term_idx").collect()] == kept
    for r in vectors.collect():
        c = counts[r["row_idx"]]
        w = {i: (1 + math.log(c[t])) * (math.log((1 + len(TEXTS)) / (1 + df_[t])) + 1) for i, t in enumerate(kept) if c[t]}
        norm = math.sqrt(sum(v * v for v in w.values()))
        assert r["idx"] == list(w)
        assert r["val"] == pytest.approx([v / norm for v in w.values()])


def test_masked_mean_drops_first_and_last_attended(spark):
    rows = [(0, p, [float(p), 1.0], p < 4) for p in range(6)] + [(1, 0, [5.0, 5.0], True)]
    got = pooling.masked_mean(spark.createDataFrame(rows, "seq_id bigint, pos bigint, vector array<double>, attended boolean"))
    values = {(r["seq_id"], r["dim"]): r["value"] for r in got.collect()}
    assert values == {(0, 0): 1.5, (0, 1): 1.0, (1, 0): 0.0, (1, 1): 0.0}


def test_task_code_needs_no_installed_package(spark):
    from pyspark import cloudpickle

    payload = cloudpickle.dumps(tfidf._coded)
    assert b"_first_uses" in payload
