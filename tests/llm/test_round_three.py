"""Hard negatives, fill-in-the-middle and substring dedup against brute force, edge cases included."""

import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelweave.llm import common, fim, hardneg, lines, secret_scan, substrings

# ---------------------------------------------------------------- hard negatives


def plain_hard_negatives(rows, every, positives, negatives, low, high):
    best = {}
    for vec, values, label in rows:
        sound = vec is not None and label is not None and values is not None and all(v is not None and math.isfinite(v) for v in values)
        if sound:
            best[vec] = min(best.get(vec, (label, list(values))), (label, list(values)))
    units = {v: (lab, [math.floor(256 * x) for x in xs]) for v, (lab, xs) in best.items()}
    out = []
    for a, (label, x) in units.items():
        if a % every:
            continue
        scores = [(-sum(p * q for p, q in zip(x, y)), v, lab) for v, (lab, y) in units.items() if v != a and len(y) == len(x)]
        for s, p, _ in sorted(t for t in scores if t[2] == label)[:positives]:
            fit = sorted((t, v) for t, v, lab in scores if lab != label and low * -s <= 100 * -t <= high * -s)
            out += [(a, p, i + 1, v, -s, -t) for i, (t, v) in enumerate(fit[:negatives])]
    return sorted(out)


def vector_rows():
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0.1, 0.2, 12)], int(rng.integers(0, 3))) for i in range(160)]
    rows += [(200 + i, rows[i // 2][1], i % 3) for i in range(30)]  # ties under other labels
    rows += [(300, None, 1), (310, [None] * 12, 1), (320, [math.nan] * 12, 1), (330, [math.inf] * 12, 1), (340, rows[3][1], None), (None, rows[3][1], 1)]
    rows += [(350, [0.0] * 12, 0), (360, [], 0), (370, [], 0), (380, [], 1), (390, [1.0, 2.0], 0), (391, [1.0, 1.9], 0), (392, [1.0, 1.8], 1)]
    return rows + [rows[0], rows[0], (1, rows[2][1], 5)]


def test_hard_negatives(spark):
    rows = vector_rows()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rank", F.lit("x"))
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    for options in ({}, {"block_rows": 16, "anchor_rows": 4}):
        out = hardneg.mine_hard_negatives(frame, every=10, **options)
        assert tuple(out.columns) == names and dict(out.dtypes)["rank"] == "int"
        assert sorted(tuple(r) for r in out.collect()) == plain_hard_negatives(rows, 10, 5, 5, 80, 100)
    other = hardneg.mine_hard_negatives(frame, every=10, positives=2, negatives=3, share=(50, 90), block_rows=40)
    assert sorted(tuple(r) for r in other.collect()) == plain_hard_negatives(rows, 10, 2, 3, 50, 90)
    assert hardneg.mine_hard_negatives(frame.limit(0)).count() == 0
    assert hardneg.mine_hard_negatives(frame.where("vec_id = 10")).count() == 0


def test_vertical_scan_is_exact_and_prunes():
    rng = np.random.default_rng(2)
    units = np.floor(rng.normal(0, 30, (2000, 48)))
    units[:40] += 60
    block = hardneg.Block({"width": 48, "ids": np.arange(2000).astype("<i8").tobytes(), "labels": np.zeros(2000, "<i8").tobytes(), "units": np.ascontiguousarray(units.T).tobytes(), "targets": b"", "scores": b""})
    for anchor in (units[0], units[100], np.zeros(48), units[0] * 2.0**40):
        exact = np.array([sum(int(a) * int(b) for a, b in zip(anchor, u)) for u in units], object)
        rows, sums = hardneg.scan(anchor, block, np.ones(2000, bool), keep=5)
        assert (exact[rows] == sums).all()
        fifth = sorted(exact)[-5]
        assert set(np.flatnonzero(exact >= fifth)) <= set(rows)
        low, high = sorted(exact)[1200], sorted(exact)[1300]
        rows, sums = hardneg.scan(anchor, block, np.arange(2000) % 2 == 0, low, high)
        assert rows.tolist() == [i for i in range(0, 2000, 2) if low <= exact[i] <= high] and (exact[rows] == sums).all()
    few, _ = hardneg.scan(units[0], block, np.ones(2000, bool), keep=5)
    assert len(few) < 20


# ---------------------------------------------------------------- fill in the middle


def test_skip_list_reaches_every_rank():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5, 40, 3000):
        lengths = rng.integers(1, 90, n).tolist()
        lines, ends = fim.SkipList(lengths), np.cumsum([0, *lengths])
        for rank in range(n + 1) if n < 100 else [0, 1, n - 1, n, *rng.integers(0, n, 200).tolist()]:
            assert lines.seek(rank)[0] == ends[rank]
    followed = [fim.SkipList([1] * 100_000).seek(r)[1] for r in (99_999, 50_001, 77_777)]
    assert max(followed) < 150  # a walk along the lowest lane takes tens of thousands


def plain_cut(doc, text, rate=100, spm=50):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{doc}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate or doc is None:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle(docs_of):
    pick = random.Random(4)
    rows = [(1, None), (2, ""), (3, "\n"), (4, "\n\n"), (5, "one line"), (6, "has <P> inside\nx"), (7, "<M"), (8, "é🤦🏼\nab\n" * 3000), (9, "x" * 300_000), (None, "a\nb\n"), (10, "a\r\nb"), (10, "a\r\nb")]
    rows += [(20 + i, "".join(pick.choice("ab é\n🤦") for _ in range(pick.randrange(60)))) for i in range(200)]
    for rate, spm in ((100, 50), (30, 90)):
        out = fim.fill_in_middle(docs_of(rows), rate=rate, spm=spm)
        out = out.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
        got = sorted((str(r["doc_id"]), r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out)
        assert got == sorted((str(d), *plain_cut(d, t or "", rate, spm)) for d, t in rows)
        assert sorted((str(r["doc_id"]), r["back"]) for r in out) == sorted((str(d), t or "") for d, t in rows)
        assert all(r["n_lines"] == 7 and r["lang"] == "en" for r in out)
    clash = docs_of(rows[:3]).withColumn("form", F.lit("mine")).withColumn("output", F.lit(1))
    assert {r["form"] for r in fim.fill_in_middle(clash).collect()} <= {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs_of([])).count() == 0


# ---------------------------------------------------------------- substring dedup


def plain_substrings(rows, k):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    first = {}
    for (doc, _), w in zip(rows, words):
        for s in range(len(w) - k + 1):
            if doc is not None:
                first[tuple(w[s : s + k])] = min(first.get(tuple(w[s : s + k]), doc), doc)
    out = []
    for (doc, _), w in zip(rows, words):
        gone = {p for s in range(len(w) - k + 1) if doc is not None and first[tuple(w[s : s + k])] < doc for p in range(s, s + k)}
        out.append((str(doc), " ".join(x for p, x in enumerate(w) if p not in gone), len(w), len(gone)))
    return sorted(out)


def substring_rows():
    pick = random.Random(6)
    some = [f"w{i}" for i in range(400)]
    shared = [" ".join(pick.choices(some, k=n)) for n in (9, 10, 11, 40)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "x " * 60), (5, "x " * 25), (None, shared[3]), (None, shared[3]), (6, " a\x1cb " * 12), (7, " a\x1cb\n" * 12)]
    for i in range(120):
        parts = [" ".join(pick.choices(some, k=pick.randrange(12))), pick.choice(shared), "\t".join(pick.choices(some, k=pick.randrange(12)))]
        rows.append((100 + i, " ".join(pick.sample(parts, pick.randrange(1, 4)))))
    return [*rows, (100, rows[12][1]), (300, rows[12][1]), (300, rows[12][1]), (301, rows[12][1] + " " + rows[12][1])]


def test_substrings(spark, docs_of):
    rows = substring_rows()
    want = plain_substrings(rows, 10)
    for _ in range(2):
        out = substrings.dedup_substrings(docs_of(rows).repartition(13), 10)
        assert sorted((str(r["doc_id"]), r["text"], r["n_words"], r["n_removed"]) for r in out.collect()) == want
    assert sum(w[3] for w in want) > 500
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_words", "n_removed"]
    clash = docs_of(rows).withColumn("n_words", F.lit("x")).withColumn("doc", F.lit(0)).withColumn("h1", F.lit(0))
    assert sorted((str(r["doc_id"]), r["text"], r["n_words"], r["n_removed"]) for r in substrings.dedup_substrings(clash, 10).collect()) == want
    assert substrings.dedup_substrings(docs_of([]), 10).count() == 0
    assert sorted((str(r["doc_id"]), r["text"], r["n_words"], r["n_removed"]) for r in substrings.dedup_substrings(docs_of(rows), 1).collect()) == plain_substrings(rows, 1)


def test_one_window_in_all_documents_spreads_over_tasks(spark):
    """A window that every document holds is more than one slice of the sorted rows."""
    rows = spark.range(4000).selectExpr("7L AS h1", "3 AS h2", "id AS doc").unionByName(spark.range(100).selectExpr("id - 50 AS h1", "0 AS h2", "id AS doc"))
    lost = substrings.later_holders(rows.unionByName(rows.where("doc = 5")))
    assert sorted({r["doc"] for r in lost.where("h1 = 7").collect()}) == list(range(1, 4000))
    assert lost.where("h1 <> 7").count() == 0


def test_sketch_never_underestimates(spark):
    """Every mark that two documents hold is kept, whatever the size of the sketch; few others are in a large one."""
    rng = np.random.default_rng(7)
    texts = [(i, " ".join(f"t{x}" for x in rng.integers(0, 10**6, 150))) for i in range(400)]
    texts += [(1000 + i, texts[i][1]) for i in range(40)]
    slim = spark.createDataFrame(texts, "doc long, text string").select("doc", common.as_bytes("text").alias("_raw")).repartition(7)
    windows = substrings.Windows([t.encode() for _, t in texts], 50)
    marks = windows.marks()
    twice = np.isin(windows.doc % 400, np.arange(40)) & ((windows.doc < 40) | (windows.doc >= 400))
    for log2_cells, false_share in ((16, 1.0), (20, 0.02)):
        sketch = substrings.build_sketch(slim, 50, log2_cells)
        kept = sketch.repeated(marks)
        assert kept[twice].all() and kept[~twice].mean() <= false_share


def test_words_are_cut_and_told_apart():
    pick = random.Random(9)
    texts = ["".join(pick.choice("ab\x00\x1c\x85é \t\n\x0b\x0c\r") for _ in range(pick.randrange(40))).encode() for _ in range(3000)]
    values, counts = substrings.word_hashes(texts)
    words = [w for t in texts for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in texts]
    assert len(set(zip(values.tolist(), words))) == len(set(values.tolist())) == len(set(words))


def test_rolling_hash_and_minimum():
    rng = np.random.default_rng(8)
    values = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    inverse = pow(substrings.BASES[0], -1, 1 << 64)
    for k in (1, 2, 50):
        want = [sum(int(values[i + j]) * pow(inverse, j, 1 << 64) for j in range(k)) % (1 << 64) for i in range(len(values) - k + 1)]
        assert substrings.rolling(values, k, substrings.BASES[0]).tolist() == want
        assert substrings.sliding_min(values, k).tolist() == [values[i : i + k].min() for i in range(len(values) - k + 1)]
    assert len(substrings.rolling(values[:3], 4, substrings.BASES[0])) == 0
    assert pytest.approx(0) == len(substrings.Windows([b"", b" "], 50).marks())


# ---------------------------------------------------------------- BPE over rows that come in another order each time


def test_bpe_rows_may_move_between_scans(spark, docs_of):
    import public_tokenizers
    from tokenizers import Tokenizer

    from labelweave.llm import bpe

    path = public_tokenizers.path("byte_bpe_50k.json")
    model, pick = Tokenizer.from_file(path), random.Random(10)
    texts = [" ".join(pick.choice(["aha", "rarely", "xq" + str(pick.randrange(10**6)), "é", "the"]) for _ in range(pick.randrange(40))) for _ in range(300)]
    rows = [(i // 2, t) for i, t in enumerate(texts)] + [(0, texts[0])] * 50

    def shuffled(batches):
        for batch in batches:
            yield batch.sample(frac=1)  # unseeded: every scan has its own order

    docs = docs_of(rows)
    moved = docs.mapInPandas(shuffled, docs.schema)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for head in (0, 20):
        out = bpe.encode_decode(moved, path, head).collect()
        want = {(d, t): model.encode(t, add_special_tokens=False).ids for d, t in rows}
        assert len(out) == len(rows)
        assert all(np.frombuffer(r["ids"], "<u4").tolist() == want[r["doc_id"], bytes(r["decoded"]).decode()] for r in out)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


# ---------------------------------------------------------------- secrets: many matches in one text, spans against plain loops


def test_eighty_thousand_matches_in_one_text(docs_of):
    pick = random.Random(11)
    keys = ["".join(pick.choices("0123456789abcdef", k=32)) for _ in range(40_000)]
    words = ["".join(pick.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=40)) for _ in range(40_000)]
    text = "\n".join(f"é {k} {w}" for k, w in zip(keys, words))
    docs, text_of = docs_of([(1, text)]), F.coalesce(F.col("text"), F.lit(""))
    start = time.monotonic()
    made = docs.select(secret_scan._base_spans(text_of).alias("base"), secret_scan._candidates(text_of, 20).alias("runs"))
    row = made.select("base", "runs", secret_scan._outside(F.col("runs"), F.col("base")).alias("left")).collect()[0]
    assert time.monotonic() - start < 60
    want = [(m.start(), m.end()) for m in re.finditer("[0-9a-f]{24,}", text)]
    assert [(s["start"], s["end"]) for s in row["base"] if s["kind"] == "hex"] == want and len(want) >= 40_000
    assert len(row["runs"]) >= 80_000 and {text[s["start"] : s["end"]] for s in row["left"]} == set(words)


def test_span_helpers_against_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "PIECE", 3)
    pick = random.Random(12)
    texts = ["".join(pick.choice("aaab1 ") for _ in range(pick.randrange(60))) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", secret_scan._spans(F.col("t"), "[a-b]{2,}").alias("s")).collect()
    assert all([(x["start"], x["end"], x["hit"]) for x in r["s"]] == [(m.start(), m.end(), m[0]) for m in re.finditer("[a-b]{2,}", r["t"])] for r in rows)
    spans = lambda n: [(a, a + pick.randrange(1, 6)) for a in (pick.randrange(60) for _ in range(n))]
    cases = [(i, spans(pick.randrange(12)), spans(pick.randrange(6))) for i in range(100)]
    kind = "array<struct<start:int,end:int>>"
    frame = spark.createDataFrame(cases, f"row long, runs {kind}, base {kind}")
    for r in frame.select("runs", "base", secret_scan._outside(F.col("runs"), F.col("base")).alias("o")).collect():
        assert sorted(map(tuple, r["o"])) == sorted(tuple(x) for x in r["runs"] if not any(b["start"] < x["end"] and x["start"] < b["end"] for b in r["base"]))
    joined = {r["row"]: [(x["start"], x["end"]) for x in r["found"]] for r in secret_scan._joined(frame.select("row", F.inline("runs"))).collect()}
    for i, runs, _ in cases:
        want = []
        for a, b in sorted(runs):
            if want and a < want[-1][1]:
                want[-1] = (want[-1][0], max(b, want[-1][1]))
            else:
                want.append((a, b))
        assert joined.get(i, []) == want


# ---------------------------------------------------------------- lines: frequent keys are found where they are


def test_line_dedup_with_frequent_lines(docs_of, monkeypatch):
    pick = random.Random(13)
    pool = ["a very common line", *(f"another line {i}" for i in range(50))]
    rows = [(pick.randrange(150), "\n".join(["A very common line", *pick.choices(pool, k=4), f"own line of {i}"])) for i in range(200)]
    first = {}
    for d, t in rows:
        for line in t.split("\n"):
            first[line.lower()] = min(first.get(line.lower(), d), d)
    want = sorted((d, "\n".join(x for x in t.split("\n") if first[x.lower()] == d)) for d, t in rows)
    for hot in (2000, 20, 1):
        monkeypatch.setattr(lines, "HOT", hot)
        assert sorted((r["doc_id"], r["text"]) for r in lines.dedup_lines(docs_of(rows)).collect()) == want


# ---------------------------------------------------------------- Jaccard join


def test_jaccard_rows_go_in_small_batches(spark, docs_of):
    from labelweave.llm import setjoin

    words = [f"w{i}" for i in range(60)]
    docs = docs_of([(i, " ".join(words[i % 2 :])) for i in range(4)] + [(9, "apart from all others here")])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    out = setjoin.jaccard_classes(docs)
    assert out.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in out.collect()) == [(0, 0, 3), (1, 0, 3), (2, 0, 3), (3, 0, 3), (9, 9, 0)]
    kept = docs.join(out.where("doc_id = class_id").select("doc_id"), "doc_id", "left_semi")  # the session of docs takes it up
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 9]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
