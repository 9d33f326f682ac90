"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, by operator."""

import math
import random
import tracemalloc

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from labelweave.llm import bpe, common, decontam, langmodel, lines, revisits, secret_scan, setjoin, sharding, toxicity, vecdedup

EDGES = [
    (1, None), (2, ""), (3, " \t\n "), (4, "word"), (5, "é" * 50_000), (6, "one two three four five six seven"),
    (6, "one two three four five six seven"), (None, "no id here at all, none"), (7, "x\n" * 3),
]
RECORD = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, body string, status string"


# ---------------------------------------------------------------- 1


def test_canonical_url(spark):
    same = ["http://www.Ex.com:80/a/?b=2&a=1&utm_source=x#top", "https://u@ex.com/a?a=1&b=2&ref=z", "EX.com/a//?a=1&b=2"]
    rows = spark.createDataFrame([(u,) for u in same], "u string").select(revisits.canonical_url(F.col("u"))).collect()
    assert {r[0] for r in rows} == {"ex.com/a?a=1&b=2"}


def test_revisits(spark):
    head = {"Content-Length": "9", "X": "old", "x": "new"}
    rows = [
        (1, "http://a/", 10, "response", '"v1"', "d1", head, "one", "?"),
        (2, "https://a", 20, "response", '"v2"', None, None, "two", "?"),
        (3, "http://a", 20, "response", '"v3"', None, {}, "three", "?"),
        (4, "http://a", 20, "revisit", 'W/"v1"', None, {"X": "fresh", "content-length": "0", "Date": "t"}, None, "?"),
        (5, "http://a", 21, "revisit", '"v3"', None, None, None, "?"),
        (6, "http://a", 21, "revisit", '"v2"', None, None, None, "?"),
        (7, "http://a", 21, "revisit", None, None, None, None, "?"),
        (8, "http://a", 5, "revisit", '"v1"', None, None, None, "?"),
        (9, None, 30, "revisit", '"v1"', None, None, None, "?"),
        (10, "http://a", None, "revisit", '"v1"', None, None, None, "?"),
        (11, "http://a", 15, "revisit", None, "d1", None, None, "?"),
        (12, "http://a", 15, "revisit", None, "d9", None, None, "?"),
        (5, "http://a", 21, "revisit", '"v3"', None, None, None, "?"),
        (13, "http://a", 15, None, None, None, None, None, "?"),
        (14, None, 1, "response", '"v1"', None, None, "nobody", "?"),
    ]
    out = revisits.resolve_revisits(spark.createDataFrame(rows, RECORD), ["body"]).collect()
    got = sorted((r["record_id"], r["status"], r["refers_to"], r["body"]) for r in out)
    assert got == sorted([
        (4, "resolved", 1, "one"), (5, "resolved", 3, "three"), (5, "resolved", 3, "three"), (6, "mismatch", None, None), (7, "unverified", None, None),
        (8, "orphan", None, None), (9, "orphan", None, None), (10, "orphan", None, None), (11, "resolved", 1, "one"), (12, "mismatch", None, None),
    ], key=lambda r: (r[0], r[1]))
    assert {r["record_id"]: r["headers"] for r in out}[4] == {"content-length": "9", "x": "fresh", "date": "t"}
    assert revisits.resolve_revisits(spark.createDataFrame([], RECORD), ["body"]).count() == 0


def test_one_url_over_many_slices(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("record_id"), F.lit("http://a/").alias("url"), F.col("id").alias("ts"), F.when(F.col("id") % 100 == 0, "response").otherwise("revisit").alias("kind"),
        F.lit("t").alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("map<string,string>").alias("headers"),
    )
    out = revisits.resolve_revisits(rows, []).collect()
    assert len(out) == 2970 and all(r["refers_to"] == r["record_id"] // 100 * 100 for r in out)


# ---------------------------------------------------------------- 2


def test_schedule_equals_heap():
    rng = np.random.default_rng(0)
    for _ in range(50):
        sizes = np.sort(rng.choice(np.arange(1, 60), 6, replace=False))[::-1].astype(float)
        many = rng.integers(1, 120, 6)
        dealt = sharding.longest_first(sizes, many, 5)
        loads, want = [0.0] * 5, np.zeros((6, 5), int)
        for c, (s, m) in enumerate(zip(sizes, many)):
            for _ in range(m):
                i = loads.index(min(loads))
                loads[i] += s
                want[c, i] += 1
        assert (dealt.sum(1) == many).all()
        assert sorted(dealt.T @ sizes) == pytest.approx(sorted(loads))


def test_sharding_edges(docs_of):
    rows = sharding.shard_groups(docs_of(EDGES), 3).collect()
    assert len(rows) == len(EDGES)
    assert len({r["shard"] for r in rows if r["doc_id"] == 6}) == 1
    assert sorted(r["size"] for r in rows)[:2] == [1, 1]
    for s in range(3):
        slots = [r["slot"] for r in rows if r["shard"] == s]
        assert sorted(slots) == list(range(len(slots)))
    assert sharding.shard_groups(docs_of([]), 3).count() == 0


# ---------------------------------------------------------------- 3


def test_secret_edges(docs_of):
    rng = np.random.default_rng(1)
    alphabet = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
    keys = ["".join(rng.choice(alphabet, 64)) for _ in range(40)]
    dull = ["abab1abab1abab1abab1abab1abab1abab1abab1", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1"]
    texts = [*EDGES, *((100 + i, f"é key {k} end") for i, k in enumerate(keys)), *((200 + i, d) for i, d in enumerate(dull))]
    texts.append((300, 'PassWord = "abc123" secret:x AKIA' + "Q7" * 8 + " " + "0123456789abcdef" * 2))
    rows = secret_scan.scan_secrets(docs_of(texts)).collect()
    assert len(rows) == len(texts)
    by = {r["doc_id"]: r for r in rows}
    found = [r for r in rows if r["doc_id"] is not None and 100 <= r["doc_id"] < 200 and r["found"]]
    assert len(found) >= 36 and all((r["found"][0]["start"], r["found"][0]["end"]) == (6, 70) for r in found)
    assert not any(by[200 + i]["found"] for i in range(len(dull)))
    assert [(s["kind"], s["start"], s["end"]) for s in by[300]["base"]] == [("assign", 0, 18), ("access", 29, 49), ("hex", 50, 82)]
    assert all(not by[i]["base"] and not by[i]["found"] for i in (1, 2, 3, 4, 5, 6, 7))
    assert secret_scan.scan_secrets(docs_of([])).count() == 0


def test_secrets_behind_names_and_in_paths(docs_of):
    rng = np.random.default_rng(5)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def key(alphabet, n):
        return "".join(rng.choice(list(alphabet), n))

    frames = [
        ("SESSION_ID={}", signs + "+/"), ("https://a.example/v1/items?sig={}&x=1", signs), ("AccountKey={}==", signs + "+/"),
        ("https://a.example/my-files/some_path/{}", signs), ("user-{}/part", signs), ("é {} end", signs[:52]),
    ]
    rows, want = [], {}
    for i in range(60):
        frame, alphabet = frames[i % len(frames)]
        k = key(alphabet, 64)
        text = frame.format(k)
        rows.append((i, text))
        want[i] = (text.index(k), text.index(k) + 64)
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["found"]] for r in secret_scan.scan_secrets(docs_of(rows)).collect()}
    for f in range(len(frames)):
        hit = [i for i in range(f, 60, len(frames)) if any(a <= want[i][0] and want[i][1] <= b for a, b in found[i])]
        assert len(hit) >= 8, frames[f]
    assert all(a[1] <= b[0] for spans in found.values() for a, b in zip(spans, spans[1:]))


def test_short_secrets_among_identifiers(spark, docs_of):
    rng = np.random.default_rng(6)
    prose = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r[0]]
    words = sorted({w for t in prose for w in regex.findall("[a-z]{4,9}", t)})

    def name(kind):
        w = [str(x) for x in rng.choice(words, 5)]
        return {0: "_".join(w), 1: w[0] + "".join(x.title() for x in w[1:]), 2: "-".join(w), 3: "_".join(w).upper(), 4: "/".join(w[:3]) + "/" + w[3] + str(rng.integers(9999))}[kind]

    dull = [n for n in (name(i % 5) for i in range(1500)) if len(n) >= 20]
    base62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    alphabets = {"base62": base62, "base64": base62 + "+/", "base32": base62[:26] + "234567"}
    keys = {}
    for a, signs in alphabets.items():
        for n in (20, 24, 28, 32, 36, 40, 44):
            for _ in range(20):
                keys["".join(rng.choice(list(signs), n))] = (a, n)
    items = [(t, None) for t in prose] + [(f"see {d} here", None) for d in dull] + [(f"see {k} here", k) for k in keys]
    rows = secret_scan.scan_secrets(docs_of([(i, t) for i, (t, _) in enumerate(items)])).collect()
    found = {r["doc_id"]: r["found"] for r in rows}
    hits = {}
    for i, (_, k) in enumerate(items):
        if k:
            hits.setdefault(keys[k], []).append(bool(found[i]) and any(s["start"] <= 4 + len(k) // 4 and s["end"] >= 4 + len(k) * 3 // 4 for s in found[i]))
    recall = {at: sum(h) / len(h) for at, h in hits.items()}
    assert min(recall.values()) >= 0.7 and sum(recall.values()) / len(recall) >= 0.85
    wrong = sum(bool(found[i]) for i in range(len(prose), len(prose) + len(dull)))
    assert wrong <= 0.05 * (wrong + sum(map(sum, hits.values())))


def test_battery_against_numpy(spark):
    token, alphabet = "0a9f3c77be10d4512afc", "0123456789abcdef"
    t = spark.createDataFrame([(token, alphabet)], "t string, a string").select(secret_scan.battery(F.col("t"), F.col("a")).alias("b")).head()["b"]
    x = np.array([alphabet.index(c) + 1 for c in token])
    counts, n, k = np.bincount(x, minlength=17)[1:], len(x), 16
    chi = ((counts - n / k) ** 2 / (n / k)).sum()
    assert t["chi_z"] == pytest.approx(((chi / 15) ** (1 / 3) - (1 - 2 / 135)) / math.sqrt(2 / 135))
    high = (x > 8.5).sum()
    mean = 2 * high * (n - high) / n + 1
    runs = 1 + ((x[1:] > 8.5) != (x[:-1] > 8.5)).sum()
    assert t["runs_z"] == pytest.approx((runs - mean) / math.sqrt((mean - 1) * (mean - 2) / (n - 1)))
    assert t["serial_z"] == pytest.approx(((x[1:] - 8.5) * (x[:-1] - 8.5)).sum() / (255 / 12) / math.sqrt(n - 1))
    z = spark.createDataFrame([(v,) for v in (-2.0, 0.0, 1.5, 4.0)], "z double").select(secret_scan.upper_tail(F.col("z"))).collect()
    assert [r[0] for r in z] == pytest.approx([0.5 * math.erfc(v / math.sqrt(2)) for v in (-2, 0, 1.5, 4)], abs=1e-7)


# ---------------------------------------------------------------- 4


def test_toxicity_edges(spark, docs_of):
    bad = [(10 + i, f"you are a moron and an idiot {i}") for i in range(40)]
    good = [(60 + i, f"a quiet day at the sea number {i}") for i in range(40)]
    docs = docs_of([*EDGES, *bad, *good, (200, "such a morron"), (201, "idiott you")])
    labels = spark.createDataFrame([*((i, 1) for i, _ in bad), *((i, 0) for i, _ in good), (None, 1), (4, None), (10, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(EDGES) + 82
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["score"] == by[2]["score"] == by[3]["score"] == pytest.approx(1 / (1 + math.exp(-model[1])))
    assert by[200]["predicted"] == by[201]["predicted"] == 1  # misspellings share n-grams
    assert all(by[i]["predicted"] == 0 for i, _ in good)
    assert toxicity.score(docs_of([]), model).count() == 0
    empty = toxicity.fit(docs, labels.limit(0))
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, empty).collect())


# ---------------------------------------------------------------- 5


def test_bpe_edges(docs_of):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    odd = ["a\x1cb  c", "x   y", "hi <|endoftext|> there  ", "<|endoftext|><|endoftext|>", " it's  \n\n x'll", "\u0085a 　b", "🤦🏼‍♂️ ﬁ ​", "1½Ⅷ ²", "tab\t\tend\n"]
    rows = [*EDGES, *((20 + i, t) for i, t in enumerate(odd))]
    for head in (0, 3, 65_535):
        out = bpe.encode_decode(docs_of(rows), path, head).collect()
        assert len(out) == len(rows)
        want = {t or "": model.encode(t or "", add_special_tokens=False).ids for _, t in rows}
        have = {bytes(r["decoded"]).decode(): (np.frombuffer(r["ids"], "<u4").tolist(), r["n_tokens"]) for r in out}
        assert have == {model.decode(ids, skip_special_tokens=False): (ids, len(ids)) for ids in want.values()}
    assert bpe.encode_decode(docs_of([]), path).count() == 0


# ---------------------------------------------------------------- 6


def test_line_edges(docs_of):
    rows = [
        *EDGES, (20, "Shared line here\nown a"), (21, " \tSHARED line here\x0b\nown b\nshared LINE here"), (22, "shared line here"),
        (None, "shared line here"), (23, "short\nshort"), (24, "short"), (25, "ÄÄÄÄÄÄÄÄÄÄ"), (26, "ääääääääää"), (22, "shared line here\nx"),
    ]
    out = lines.dedup_lines(docs_of(rows)).collect()
    got = sorted(((r["doc_id"] or 0, r["text"], r["n_lines"], r["n_dropped"]) for r in out))
    assert len(out) == len(rows) and {type(r["n_lines"]) for r in out} == {int}
    for want in [(20, "Shared line here\nown a", 2, 0), (21, "own b", 3, 2), (22, "", 1, 1), (22, "x", 2, 1), (0, "shared line here", 1, 0), (23, "short\nshort", 2, 0), (25, "ÄÄÄÄÄÄÄÄÄÄ", 1, 0), (1, "", 1, 0), (2, "", 1, 0), (7, "x\nx\nx\n", 4, 0)]:
        assert want in got
    assert [g for g in got if g[0] == 6] == [(6, EDGES[5][1], 1, 0)] * 2  # rows of one document are no second document
    assert lines.dedup_lines(docs_of([])).count() == 0
    kept = lines.dedup_lines(docs_of([(1, "a line of three"), (2, "a line of three"), (3, "a line of two!!"), (4, "a line of three"), (5, "a line of two!!")]), max_docs=2)
    assert sorted((r["doc_id"], r["n_dropped"]) for r in kept.collect()) == [(1, 0), (2, 1), (3, 0), (4, 1), (5, 0)]


# ---------------------------------------------------------------- 7


def test_winnowing_guarantee():
    rng = np.random.default_rng(2)
    for _ in range(300):
        grams = common.mix(rng.integers(0, 4, rng.integers(6, 40)).astype(np.uint64))
        marks = decontam.winnow(grams, 6)
        for s in range(len(grams) - 5):
            window = grams[s : s + 6]
            inside = [m for m in marks if s <= m < s + 6]
            assert inside and any(grams[m] == window.min() for m in inside)


def test_decontamination_edges(spark, docs_of):
    item = [f"w{i}" for i in range(30)]
    bench = spark.createDataFrame(
        [(1, " ".join(item)), (2, "Short ITEM!"), (3, None), (4, "..."), (None, "no id"), (5, "a " * 25), (6, " ".join(item[5:20])), (1, " ".join(item))], "item_id long, text string"
    )
    rows = [
        *EDGES, (20, "pre " + " ".join(item[3:13]) + " post"), (21, " ".join(item[3:12])), (22, "a short, item. Short item"),
        (23, "a " * 12), (24, " ".join(item[:15] + ["x"] + item[4:16])), (24, "clean"),
    ]
    out = decontam.contamination(docs_of(rows), bench).collect()
    got = {(r["doc_id"], r["n_words"]): (r["n_hit"], r["items"], r["contaminated"]) for r in out}
    assert len(out) == len(rows)
    assert got[20, 12] == (10, ["1"], True)
    assert got[21, 9] == (0, [], False)
    assert got[22, 5] == (4, ["2"], True)
    assert got[23, 12] == (12, ["5"], True)
    assert got[24, 28] == (27, ["1", "6"], True) and got[24, 1] == (0, [], False)
    assert got[1, 0] == got[2, 0] == got[3, 0] == (0, [], False)
    assert decontam.contamination(docs_of([]), bench).count() == 0
    assert not any(r["contaminated"] for r in decontam.contamination(docs_of(rows), bench.limit(0)).collect())


# ---------------------------------------------------------------- 8


def plain_classes(rows, threshold=0.8):
    memo = common.WordHash()
    sets = [set(setjoin.shingle_set(t.encode() if t else None, 5, memo).tolist()) for _, t in rows]
    links = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold] for i in range(len(rows))]
    out = []
    for i, (doc, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((doc, min(ids) if ids else None, len(links[i])))
    return sorted(out, key=str)


def test_jaccard_edges_and_blocks(docs_of):
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in rng.integers(0, 500, 60)]
    near = []
    for i in range(60):
        own = list(base)
        for at in rng.integers(0, 60, 1 if i % 3 else 2):
            own[at] = f"n{i}"
        near.append((100 + i, " ".join(own)))
    rows = [*EDGES, *near, (None, near[0][1]), (300, near[1][1]), (301, "a b"), (302, "A. b"), (303, "a"), (304, "one two three four five six seven eight")]
    for options in ({}, {"bucket_rows": 8, "block_rows": 10}, {"depth": 1, "bucket_rows": 2, "block_shingles": 300}):
        out = setjoin.jaccard_classes(docs_of(rows), **options).collect()
        assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in out), key=str) == plain_classes(rows)
    assert setjoin.jaccard_classes(docs_of([])).count() == 0
    assert [r["n_links"] for r in setjoin.jaccard_classes(docs_of([(1, None), (2, "")])).collect()] == [0, 0]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (7, None), (100, 90)]
    out = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in out} == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


# ---------------------------------------------------------------- 9


def test_bounds_hold():
    rng = np.random.default_rng(4)
    for width in (8, 64, 130):
        units = rng.normal(size=(300, width))
        units[1::2] = units[::2] + 0.1 * rng.normal(size=(150, width))
        units /= np.linalg.norm(units, axis=1, keepdims=True)
        turn = vecdedup.rotation(width, vecdedup.code_width(width), 9)
        assert turn @ turn.T == pytest.approx(np.eye(width), abs=1e-9)
        bits, own = vecdedup.encode(units, turn)
        estimate, half = vecdedup.bounds(bits, own, units @ turn)
        error = estimate - units @ units.T
        assert (np.abs(error) <= half[:, None] + 1e-5).all()
        assert abs(error[~np.eye(300, dtype=bool)].mean()) < 0.01


def test_vector_edges(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=16)
    rows = [(i, [float(x) for x in centre + 0.05 * rng.normal(size=16)], i % 2) for i in range(80)]
    rows += [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0), (203, [None] * 16, 0), (204, rows[0][1], None), (205, [1.0], 0), (206, rows[0][1], 0), (206, rows[0][1], 0), (None, rows[0][1], 0), (207, [x * 1e200 for x in rows[0][1]], 0), (208, [], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("links", F.lit(1))
    usable = {r[0]: (np.array(r[1]) / np.abs(r[1]).max(), r[2]) for r in rows if r[0] is not None and r[1] and r[2] is not None and r[1] != [0.0] * 16 and None not in r[1] and r[1][0] == r[1][0]}
    link = {a: {b for b, (y, m) in usable.items() if a != b and m == lab and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98} for a, (x, lab) in usable.items()}
    for block_rows in (1024, 7):
        out = {r["vec_id"]: r for r in vecdedup.near_duplicates(frame, block_rows=block_rows).collect()}
        assert set(out) == {r[0] for r in rows} - {None}
        for v, r in out.items():
            seen, todo = {v}, [v]
            while todo:
                for w in link.get(todo.pop(), ()):
                    if w not in seen:
                        seen.add(w)
                        todo.append(w)
            assert (r["n_links"], r["component_id"], r["kept"]) == (len(link.get(v, ())), min(seen), min(seen) == v)
    assert vecdedup.near_duplicates(frame.limit(0)).count() == 0


# ---------------------------------------------------------------- 10


def test_language_model_edges(docs_of):
    rows = [*EDGES, *((20 + i, "the cat sat on the mat " * 4) for i in range(30))]
    out = langmodel.score_documents(docs_of(rows)).collect()
    assert len(out) == len(rows) and all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)
    assert {r["n_tokens"] for r in out if r["doc_id"] in (1, 2, 3)} == {1}
    one = langmodel.score_documents(docs_of([(1, "a b")])).collect()  # crc32("1") % 7 decides the side
    assert len(one) == 1 and math.isfinite(one[0]["score"])
    assert langmodel.score_documents(docs_of([])).count() == 0


def deep_words(spark, listed):
    cfg = langmodel.LmConfig(head=5, classes=3, hidden=4, shared=7, listed=listed)
    counts = spark.createDataFrame([(bytes(f"w{i}", "ascii"), 1 + 200_000 // (i + 1)) for i in range(5000)] + [(b"", 900)], "word binary, n long")
    return cfg, langmodel.Words(counts, cfg)


def test_every_listed_word_follows_the_state(spark):
    cfg, words = deep_words(spark, 100_000)
    assert words.deep == 4996 and words.numbering()[words.words[5]] == 7
    rng = np.random.default_rng(2)
    model = langmodel.Gru(words, cfg).start_from_counts()
    for part in (model.wa, model.wb):
        part[:, :-1] += rng.normal(0, 0.5, part[:, :-1].shape)
    every = np.r_[np.arange(6), np.arange(7, 7 + words.deep)]
    for state in rng.normal(size=(3, 4)).astype(np.float32):
        logp, _ = model.outputs(np.repeat(state[None], len(every), 0), every, None)
        assert np.exp(logp.astype(float)).sum() == pytest.approx(1, abs=1e-4)
    a, b = (model.outputs(np.full((len(every), 4), x, np.float32), every, None)[0] for x in (0.9, -0.9))
    moved = (a - b)[7 + langmodel.SMALL :] - (a - b)[6]  # the share of a small class depends on the state
    assert (np.abs(moved) > 1e-4).mean() > 0.98
    # gradients of both choices against differences
    states, targets = rng.normal(size=(40, 4)).astype(np.float32), np.r_[np.full(5, 8), rng.integers(7, 5000, 35)]
    grads = {k: np.zeros(s, np.float32) for k, s in model.shapes.items()}
    model.outputs(states, targets, grads)
    for name in ("wa", "wb"):
        for at in ((0, 0, 1), (0, 2, 1), (0, 4, 1)):
            w, ends = getattr(model, name), []
            for d in (1e-2, -1e-2):
                w[at] += d
                ends.append(float(model.outputs(states, targets, None)[0].astype(float).sum()))
                w[at] -= d
            assert (ends[0] - ends[1]) / 2e-2 == pytest.approx(float(grads[name][at]), rel=0.02, abs=0.02)


def test_score_against_a_plain_loop(docs_of):
    """One token after another, the whole softmax written out."""
    pick = random.Random(3)
    words = [f"w{min(int(pick.expovariate(0.005)), 900)}" for _ in range(30_000)]
    rows = [(i, " ".join(words[i * 100 : i * 100 + pick.randrange(1, 100)])) for i in range(300)] + [(900, " ".join(words[:700])), (901, "w1 never w2 seen"), (902, None)]
    docs = docs_of(rows)
    cfg = langmodel.LmConfig(hidden=4, head=8, classes=3, shared=5, listed=700)
    slim = docs.select(F.col("doc_id").alias("row"), "doc_id", common.as_bytes("text").alias("_raw"))
    trained = langmodel.fit(slim.where(langmodel.in_training(F.col("doc_id"))), cfg)
    m, numbering, counts = langmodel.Gru(trained.words, cfg, trained.flat), trained.words.numbering(), {bytes(r["word"]): r["n"] for r in trained.counts.collect()}
    assert trained.words.deep > langmodel.SMALL and len(counts) > len(numbering)  # all three kinds of words
    sig = lambda v: 1 / (1 + np.exp(-v))
    soft = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    rest = trained.words.n - sum(counts[w] for w in numbering) + trained.words.v - len(numbering) + 1
    size = {}
    for w, i in numbering.items():
        if i > trained.words.head:
            small = (i - trained.words.head - 2) // langmodel.SMALL
            size[small] = size.get(small, 0) + counts[w] + 1

    def plain(text):
        state, last, total, h = np.zeros(4), trained.words.head + 1, 0.0, 4
        for w in langmodel.tokens_of(text.encode() if text else None):
            at = last if last < trained.words.head + 2 else trained.words.head + 2 + (last - trained.words.head - 2) % cfg.shared
            x, rec = m.x[at].astype(float), state @ m.u.astype(float)
            z, r = sig(x[:h] + rec[:h]), sig(x[h : 2 * h] + rec[h : 2 * h])
            new = np.tanh(x[2 * h :] + r * rec[2 * h :])
            state = (1 - z) * new + z * state
            i = numbering.get(w, trained.words.head)
            by_class = soft(state @ m.wc + m.bc)
            if i < trained.words.head:
                c = trained.words.class_of[i]
                a, b = trained.words.first[c], trained.words.first[c + 1]
                p = by_class[c] * soft(state @ m.ww[:, a:b] + m.bw[a:b])[i - a]
            elif i == trained.words.head:
                p = by_class[cfg.classes] * (counts.get(w, 0) + 1) / rest
            else:
                small, own = (i - trained.words.head - 2) // langmodel.SMALL, np.append(state, 1)
                group, place = divmod(small, trained.words.fan)
                p = by_class[cfg.classes + 1] * soft(own @ m.wa[0])[group] * soft(own @ m.wb[group])[place] * (counts[w] + 1) / size[small]
            total, last = total + math.log10(p), i
        return total

    got = {r["doc_id"]: r for r in langmodel.score_rows(slim, trained).collect()}
    for i in (0, 1, 17, 250, 900, 901, 902):
        assert got[i]["score"] == pytest.approx(plain(dict(rows)[i]), rel=1e-4)


def test_probabilities_sum_to_one():
    cfg = langmodel.LmConfig(head=5, classes=3, hidden=4)
    words = langmodel.Words.__new__(langmodel.Words)
    words.head, words.class_of, words.first = 5, np.array([0, 1, 1, 2, 2]), np.array([0, 1, 3, 5])
    model = langmodel.Gru(words, cfg, np.random.default_rng(0).normal(size=7 * 12 + 4 * 12 + 16 + 4 + 20 + 5))
    states = np.random.default_rng(1).normal(size=(1, 4)).astype(np.float32)
    total = sum(math.exp(model.outputs(states, np.array([w]), None)[0][0]) for w in range(6))
    assert total == pytest.approx(1, abs=1e-5)


def test_gradients():
    cfg = langmodel.LmConfig(head=5, classes=3, hidden=4)
    words = langmodel.Words.__new__(langmodel.Words)
    words.head, words.class_of, words.first = 5, np.array([0, 1, 1, 2, 2]), np.array([0, 1, 3, 5])
    rng = np.random.default_rng(2)
    model = langmodel.Gru(words, cfg, rng.normal(0, 0.5, 7 * 12 + 4 * 12 + 16 + 4 + 20 + 5))
    inputs, targets = rng.integers(0, 7, (6, 3)), rng.integers(0, 6, (6, 3))
    fresh, live = np.zeros((6, 3), np.float32), rng.random((6, 3)) < 0.8
    fresh[[0, 3], [0, 1]] = 1
    state = rng.normal(size=(3, 4)).astype(np.float32)
    _, _, grad = model.window(state, inputs, fresh, targets, live, True)
    way = rng.normal(size=len(grad)).astype(np.float32)
    total = []
    for step in (1e-3, -2e-3):
        model.flat += step * way
        total.append(model.window(state, inputs, fresh, targets, live, False)[0].astype(float).sum())
    assert (total[0] - total[1]) / 2e-3 == pytest.approx(float(grad @ way), rel=2e-2)


def test_ascii_words_are_cut_like_any_others():
    cut, plain, pick = bpe.cutter([]), regex.compile(bpe.WORD).findall, random.Random(5)
    for _ in range(20000):
        text = "".join(pick.choice("   \x00\x1c\x7f\n\t\x0b ab1'sdltremv!?'") for _ in range(pick.randrange(14)))
        assert cut(text) == plain(text)


def test_windows_hold_every_token_once_in_bounded_memory():
    rng, words = np.random.default_rng(4), langmodel.Words.__new__(langmodel.Words)
    words.head = 50
    docs = [rng.integers(0, 51, n).astype(np.int32) for n in [200_000, 33, 1, 16, 17, *rng.integers(1, 90, 600)]]
    cfg, seen = langmodel.LmConfig(), {i: ([], []) for i in range(len(docs))}
    tracemalloc.start()
    for inputs, fresh, target, number in langmodel._runs(docs, words, cfg):
        assert len(inputs) <= cfg.window and (number[0] >= 0).all()
        for i, lead, token, new in zip(number.T.ravel(), inputs.T.ravel(), target.T.ravel(), fresh.T.ravel()):
            if i >= 0:
                assert (new == 1) == (not seen[i][0])
                seen[i][0].append(lead)
                seen[i][1].append(token)
            else:
                assert new == 0
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # 200,000 steps of 256 lanes would take gigabytes
    for i, doc in enumerate(docs):
        assert seen[i][1] == doc.tolist() and seen[i][0] == [51, *doc[:-1].tolist()]
