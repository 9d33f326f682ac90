"""Registered training-data queries against SQL or a plain re-computation on the smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import connect, difference

from labelweave.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    assert difference(QUERIES[name](spark, SF).toPandas(), connect(SF).execute(ORACLES[name]).df()) is None


def test_shards(spark, texts):
    rows = QUERIES["op2_sharding"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    by_text, loads, slots = {}, Counter(), {}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        assert by_text.setdefault(raw, r["shard"]) == r["shard"]
        loads[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(loads) == set(range(8))
    assert max(loads.values()) - min(loads.values()) <= 0.01 * sum(loads.values()) / 8 + 200
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_base_secrets(spark, texts):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for r in QUERIES["op3_secret_scan"](spark, SF).collect():
        t = texts[r["doc_id"]] or ""
        spans = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
        assert r["base_sha256"] == sha(joined)
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


def test_toxicity_held_out(spark):
    out = QUERIES["op4_toxicity"](spark, "/root/testdata/sf0.1").toPandas().set_index("doc_id")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas().set_index("doc_id")
    both = out.join(labels, how="inner")
    test = both[both["held_out"]]
    assert len(out) == 10_000 and out["score"].between(0, 1).all() and (out["predicted"] == (out["score"] >= 0.5)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in out["held_out"].items())
    assert test.loc[test["toxic"] == 1, "predicted"].mean() > 0.55
    assert test.loc[test["toxic"] == 0, "predicted"].mean() < 0.02


def test_bpe_against_library(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in QUERIES["op5_bpe"](spark, SF).collect():
        ids = model.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == sha(model.decode(ids, skip_special_tokens=False))


def test_language_model(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    tokens = {i: (t or "").encode().lower().split() + [b""] for i, t in texts.items()}
    counts = Counter()
    for i, ws in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(ws)
    n, v = sum(counts.values()), len(counts)
    rows = QUERIES["op10_language_model"](spark, sf).collect()
    for r in rows:
        ws = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(w in counts for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), abs=1e-6)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.97 * sum(r["base_score"] for r in held)


def test_pipeline_against_its_operators(spark, texts):
    """Each stage against a plain re-computation of its decisions from its own input."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in cp.STAGES:
        from labelweave.session import materialize

        out = materialize(stage(spark, docs, SF))
        seen.append((name, docs, out))
        docs = out
    assert [n for n, _, _ in seen] == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "bpe"]
    assert all(out.columns == before.columns for _, before, out in seen[:-1])
    (_, raw, clean), (_, _, cut), (_, _, single), (_, _, fresh), (_, _, coded) = seen
    toxic = {r["doc_id"] for r in raw.select("doc_id").exceptAll(clean.select("doc_id")).collect()}
    predicted = {r["doc_id"] for r in QUERIES["op4_toxicity"](spark, SF).where("predicted = 1").collect()}
    assert toxic == predicted

    before = {r["doc_id"]: r["text"] for r in clean.collect()}
    key = lambda line: line.encode().strip(b" \t\n\r\x0b\x0c").lower()
    first = {}
    for i, t in before.items():
        for line in t.split("\n"):
            first.setdefault(key(line), set()).add(i)
    want = {i: "\n".join(x for x in t.split("\n") if len(key(x).decode()) < 10 or min(first[key(x)]) == i) for i, t in before.items()}
    now = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cut.collect()}
    assert now == {i: (t, len(t)) for i, t in want.items()}

    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.encode().lower().decode())
    grams = lambda t: {tuple(w[i : i + min(5, len(w))]) for w in [words(t)] if w for i in range(max(1, len(w) - 4))}
    sets = {i: grams(t) for i, t in want.items()}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    order = sorted(sets)
    for x, a in enumerate(order):
        for b in order[x + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    assert sorted(r["doc_id"] for r in single.collect()) == [i for i in order if find(i) == i]

    bench = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(b[s : s + min(10, len(b))]) for b in bench if b for s in range(len(b) - min(10, len(b)) + 1)}
    left = {r["doc_id"]: r["text"] for r in single.collect()}
    sizes = {len(w) for w in windows}
    hit = {i for i, t in left.items() for n in sizes for w in [words(t)] if any(tuple(w[s : s + n]) in windows for s in range(len(w) - n + 1))}
    assert {r["doc_id"] for r in fresh.collect()} == set(left) - hit

    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in coded.collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == model.encode(left[r["doc_id"]], add_special_tokens=False).ids
