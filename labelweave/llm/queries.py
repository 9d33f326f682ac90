"""The training-data operators over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm import bpe, decontam, fim, hardneg, langmodel, lines, revisits, secret_scan, setjoin, sharding, substrings, toxicity, vecdedup
from labelweave.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---------------------------------------------------------------- 1 revisits


def captures(pages: DataFrame) -> DataFrame:
    """Archive records made from pages: each page is captured once and asked for again three times.

    The first revisit echoes the page's entity tag in weak form, the second its modification date
    only, the third comes much later and has, by page, a stale tag or no validator.
    """
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.col("html")), 1, 16), F.lit('"'))
    day = F.concat(F.lit("day "), F.col("page_id"))
    late = F.when(F.col("page_id") % 2 == 0, F.lit('"stale"'))

    def record(n, kind, ts, etag, modified, headers):
        return F.struct(
            (F.col("page_id") * 4 + n).alias("record_id"), F.col("page_id").alias("page_id"), F.col("url").alias("url"), ts.cast("long").alias("ts"),
            F.lit(kind).alias("kind"), etag.alias("etag"), modified.cast("string").alias("last_modified"),
            F.create_map(*[x for k, v in headers.items() for x in (F.lit(k), v)]).alias("headers"),
            (F.md5(F.col("html")) if kind == "response" else F.lit(None).cast("string")).alias("payload_md5"),
            (F.octet_length("html") if kind == "response" else F.lit(None)).cast("long").alias("payload_bytes"),
        )

    at, none = F.col("page_id") * 10, F.lit(None).cast("string")
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("string")
    records = F.array(
        record(0, "response", at, tag, day, {"Content-Type": F.lit("text/html"), "Content-Length": size, "Cache-Control": F.lit("max-age=60"), "Server": F.lit("origin")}),
        record(1, "revisit", at + 3, F.concat(F.lit("W/"), tag), none, {"cache-control": F.lit("max-age=600"), "Content-Length": F.lit("0"), "Connection": F.lit("close")}),
        record(2, "revisit", at + 6, none, day, {"Date": at.cast("string")}),
        record(3, "revisit", at + 100_000, late, none, {"server": F.lit("edge")}),
    )
    return pages.select(F.inline(records))


@query
def op1_revisits(spark, sf):
    records = captures(table(spark, sf, "pages"))
    out = revisits.resolve_revisits(records, ["page_id", "payload_md5", "payload_bytes"])
    pairs = F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    out = out.withColumn("headers", F.array_join(F.array_sort(pairs), "|"))
    return out.fillna(-1, ["refers_to", "page_id", "payload_bytes"]).fillna("", ["canonical_url", "headers", "payload_md5"])


_CANONICAL = """
rest AS (SELECT *, regexp_replace(regexp_replace(url, '(?s)#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
cut AS (SELECT *,
  regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^.*@', ''), ':(80|443)$', ''), '^www\\.', '') AS host,
  regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
  list_sort(list_filter(string_split(regexp_extract(rest, '(?s)\\?(.*)$', 1), '&'),
    lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))) AS params FROM rest),
keyed AS (SELECT page_id, html, host || CASE WHEN path = '' THEN '/' ELSE path END ||
  CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical_url,
  '"' || left(md5(html), 16) || '"' AS tag, 'day ' || page_id AS day FROM cut)"""

ORACLES["op1_revisits"] = f"""
WITH {_CANONICAL},
asked AS (
  SELECT page_id * 4 + 1 AS record_id, canonical_url, page_id * 10 + 3 AS ts, tag AS etag, NULL AS modified, page_id AS p, 1 AS n FROM keyed
  UNION ALL SELECT page_id * 4 + 2, canonical_url, page_id * 10 + 6, NULL, day, page_id, 2 FROM keyed
  UNION ALL SELECT page_id * 4 + 3, canonical_url, page_id * 10 + 100000, CASE WHEN page_id % 2 = 0 THEN '"stale"' END, NULL, page_id, 3 FROM keyed),
met AS (
  SELECT a.*, k.page_id AS full_page, k.tag, k.day, k.html FROM asked a LEFT JOIN keyed k
    ON k.canonical_url = a.canonical_url AND k.page_id * 10 < a.ts
  QUALIFY row_number() OVER (PARTITION BY a.record_id ORDER BY k.page_id DESC NULLS LAST) = 1),
judged AS (
  SELECT *, CASE WHEN full_page IS NULL THEN 'orphan' WHEN etag IS NULL AND modified IS NULL THEN 'unverified'
    WHEN coalesce(CASE WHEN etag IS NOT NULL THEN etag = tag ELSE modified = day END, false) THEN 'resolved' ELSE 'mismatch' END AS status FROM met)
SELECT record_id, coalesce(canonical_url, '') AS canonical_url, ts, status,
  CASE WHEN status = 'resolved' THEN full_page * 4 ELSE -1 END AS refers_to,
  CASE WHEN status = 'resolved' THEN
    CASE n WHEN 1 THEN 'cache-control: max-age=600' ELSE 'cache-control: max-age=60' END ||
    '|content-length: ' || coalesce(strlen(html), 0) || '|content-type: text/html' ||
    CASE n WHEN 2 THEN '|date: ' || (p * 10) ELSE '' END || '|server: origin' ELSE '' END AS headers,
  CASE WHEN status = 'resolved' THEN full_page ELSE -1 END AS page_id,
  CASE WHEN status = 'resolved' THEN coalesce(md5(html), '') ELSE '' END AS payload_md5,
  CASE WHEN status = 'resolved' THEN coalesce(strlen(html), -1) ELSE -1 END AS payload_bytes
FROM judged"""


# ---------------------------------------------------------------- 2 sharding


@query
def op2_sharding(spark, sf):
    out = sharding.shard_groups(table(spark, sf, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# ---------------------------------------------------------------- 3 secrets


@query
def op3_secret_scan(spark, sf):
    out = secret_scan.scan_secrets(table(spark, sf, "documents"))
    counts = [secret_scan.count_of(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    every = F.array_sort(F.concat("base", "found"))
    return out.select(
        "doc_id", *counts, F.sha2(secret_scan.as_text(F.col("base")), 256).alias("base_sha256"),
        secret_scan.as_text(every).alias("spans"), F.size("found").cast("long").alias("n_random"),
    )


# ---------------------------------------------------------------- 4 toxicity


@query
def op4_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    model = toxicity.fit(docs, table(spark, sf, "labels"))
    out = toxicity.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


# ---------------------------------------------------------------- 5 BPE


@query
def op5_bpe(spark, sf, vocabulary=None):
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    out = bpe.encode_decode(table(spark, sf, "documents").select("doc_id", "text"), path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


# ---------------------------------------------------------------- 6 line dedup


@query
def op6_line_dedup(spark, sf):
    out = lines.dedup_lines(table(spark, sf, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op6_line_dedup"] = f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM cut),
k AS (SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
shared AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT k.*, s.key IS NULL OR s.keeper = k.doc_id AS stays FROM k LEFT JOIN shared s ON s.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


# ---------------------------------------------------------------- 7 decontamination


@query
def op7_decontamination(spark, sf):
    out = decontam.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES["op7_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bl AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS win FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM bl)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.n, dw.s, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""


# ---------------------------------------------------------------- 8 Jaccard join


@query
def op8_jaccard_join(spark, sf):
    return setjoin.jaccard_classes(table(spark, sf, "documents"))


ORACLES["op8_jaccard_join"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b, c, na.n AS n1, nb.n AS n2 FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE c / (na.n + nb.n - c) >= 0.8),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) AS class_id,
  (SELECT count(*) FROM links WHERE links.a = d.doc_id) AS n_links,
  (SELECT count(*) FROM links WHERE links.a = d.doc_id AND c = n1 AND c = n2) AS n_copies
FROM d"""


# ---------------------------------------------------------------- 9 embedding near-dedup


@query
def op9_embedding_dedup(spark, sf):
    return vecdedup.near_duplicates(table(spark, sf, "embeddings"))


ORACLES["op9_embedding_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links,
  (SELECT min(b) FROM reach WHERE reach.a = vec_id) AS component_id,
  (SELECT min(b) FROM reach WHERE reach.a = vec_id) = vec_id AS kept
FROM v"""


# ---------------------------------------------------------------- 10 language model


@query
def op10_language_model(spark, sf):
    return langmodel.score_documents(table(spark, sf, "documents"))


# ---------------------------------------------------------------- 11 hard negatives


@query
def op11_hard_negatives(spark, sf):
    vectors = table(spark, sf, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine_hard_negatives(vectors.withColumn("label", moved))


ORACLES["op11_hard_negatives"] = """
WITH u AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, list_inner_product(a.e, r.e)::BIGINT AS score
  FROM u a JOIN u r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id AND len(a.e) = len(r.e)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""


# ---------------------------------------------------------------- 12 fill in the middle


@query
def op12_fill_in_middle(spark, sf):
    out = fim.fill_in_middle(table(spark, sf, "documents").select("doc_id", "text"))
    restored = fim.restore(F.col("output"), F.col("form"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256")
    )


ORACLES["op12_fill_in_middle"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS x FROM documents),
h AS (SELECT *, len(u) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p"""


# ---------------------------------------------------------------- 13 substring dedup


@query
def op13_substring_dedup(spark, sf):
    out = substrings.dedup_substrings(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op13_substring_dedup"] = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS s, w FROM d WHERE len(w) >= 50),
y AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS g FROM x),
k AS (SELECT g, min(doc_id) AS keeper FROM y GROUP BY g HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM y JOIN k USING (g) WHERE doc_id > keeper),
l AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
m AS (SELECT l.*, gone.p IS NOT NULL AS lost FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.p = l.p),
o AS (SELECT doc_id, count(*) FILTER (WHERE lost) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT lost), '') AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN o ON o.doc_id = d.doc_id"""
