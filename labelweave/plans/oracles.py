"""Independent SQL for the registered queries, over the same tables, for a plain SQL engine.

Each text is a chain of common table expressions (named in ``_CTES``) and a final select. The SQL
follows the definitions directly: full windows, full joins and recursion, none of the shortcuts the
DataFrame operators take.
"""

from __future__ import annotations

_CTES: dict[str, str] = {
    "proteins": """
        SELECT doc_id AS row_idx,
               'P' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(7, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') AS protein_id,
               "text" AS sequence,
               lang = 'fr' AND doc_id >= (SELECT max(doc_id) / 2 FROM documents) AS is_test
        FROM documents""",
    "train": "SELECT row_idx, protein_id, sequence, CAST(substr(protein_id, 2) AS BIGINT) AS num_id FROM proteins WHERE NOT is_test",
    "test": "SELECT row_idx, protein_id, sequence, CAST(substr(protein_id, 2) AS BIGINT) AS num_id FROM proteins WHERE is_test",
    "truth": """
        SELECT d.doc_id AS row_idx, o.ord, 'label_' || o.ord AS label,
               CAST(CASE WHEN o.ord < 4 THEN d.lang = (['de', 'en', 'es', 'fr'])[o.ord + 1]
                         WHEN o.ord < 24 THEN d.source = 'src' || (o.ord - 4)
                         WHEN o.ord = 24 THEN coalesce(l.quality, 0) = 1
                         ELSE coalesce(l.toxic, 0) = 1 END AS INTEGER) AS y
        FROM documents d
        CROSS JOIN (SELECT CAST(unnest(range(26)) AS INTEGER) AS ord) o
        LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "emb_truth": """
        SELECT e.vec_id AS row_idx, o.ord, 'label_' || o.ord AS label, CAST(e.label = o.ord AS INTEGER) AS y
        FROM embeddings e CROSS JOIN (SELECT CAST(unnest(range(10)) AS INTEGER) AS ord) o""",
    "random_split": """
        SELECT row_idx, CASE WHEN md5(sequence || '~42') IN (
                   SELECT h FROM (SELECT DISTINCT md5(sequence || '~42') AS h FROM train) ORDER BY h
                   LIMIT (SELECT CAST(ceil(count(DISTINCT sequence) * CAST(0.2 AS DOUBLE)) AS BIGINT) FROM train))
               THEN 'val' ELSE 'train' END AS part
        FROM train""",
    "tail_split": """
        SELECT row_idx, sequence,
               CASE WHEN num_id >= (SELECT min(num_id) FROM test) THEN 'val' ELSE 'train' END AS part
        FROM train""",
    "tail_clean": """
        SELECT row_idx, sequence, part FROM tail_split
        WHERE part = 'train' OR sequence NOT IN (SELECT sequence FROM tail_split WHERE part = 'train')""",
    "chrono": """
        SELECT t.row_idx, t.sequence,
               CASE WHEN g.before < greatest(1, (SELECT round_even(count(*) * CAST(0.2 AS DOUBLE), 0) FROM train))
                    THEN 'val' ELSE 'train' END AS part
        FROM train t JOIN (
            SELECT sequence, sum(n) OVER (ORDER BY first_id DESC, sequence ROWS UNBOUNDED PRECEDING) - n AS before
            FROM (SELECT sequence, min(num_id) AS first_id, count(*) AS n FROM train GROUP BY sequence)) g USING (sequence)""",
    "fold_groups": """
        SELECT sequence, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, sha256(sequence)) AS rn
        FROM proteins GROUP BY sequence""",
    "greedy": """
        SELECT 0 AS rn, CAST(0 AS HUGEINT) AS load0, CAST(0 AS HUGEINT) AS load1, -1 AS fold
        UNION ALL
        SELECT g.rn, r.load0 + CASE WHEN r.load0 <= r.load1 THEN g.n ELSE 0 END,
               r.load1 + CASE WHEN r.load0 <= r.load1 THEN 0 ELSE g.n END,
               CASE WHEN r.load0 <= r.load1 THEN 0 ELSE 1 END
        FROM greedy r JOIN fold_groups g ON g.rn = r.rn + 1""",
    "folds": """
        SELECT p.row_idx, CAST(r.fold AS INTEGER) AS fold
        FROM proteins p JOIN fold_groups g USING (sequence) JOIN greedy r ON r.rn = g.rn""",
}

_RECURSIVE = {"greedy", "epochs"}


def _scores(model: int, truth: str = "truth") -> str:
    return f"""
        SELECT row_idx, ord, label, y,
               round(((row_idx * 7919 + CAST(ord AS BIGINT) * 104729 + {model * 1299709}) % 1009)
                     / CAST(1009 AS DOUBLE) * CAST(0.7 AS DOUBLE) + CAST(0.3 AS DOUBLE) * y, 6) AS prob
        FROM {truth}"""


for _m in range(4):
    _CTES[f"scores{_m}"] = _scores(_m)
_CTES["emb_scores0"] = _scores(0, "emb_truth")

_CTES["models"] = " UNION ALL ".join(
    f"SELECT row_idx, label, y, prob, {m} AS model FROM scores{m}" for m in range(3)
)
_CTES["cells"] = """
        SELECT a.row_idx, a.label, a.y, a.prob AS p0, b.prob AS p1, c.prob AS p2
        FROM scores0 a JOIN scores1 b USING (row_idx, label) JOIN scores2 c USING (row_idx, label)"""
_CTES["folded_cells"] = "SELECT c.*, f.fold FROM cells c JOIN folds f USING (row_idx)"
_CTES["calibration_cells"] = "SELECT *, 1 - fold AS cal_fold FROM folded_cells"
_CTES["folded"] = "SELECT s.row_idx, s.label, s.y, s.prob, f.fold FROM scores1 s JOIN folds f USING (row_idx)"
_CTES["calibration"] = "SELECT row_idx, label, y, prob, 1 - fold AS cal_fold FROM folded"


def _f1(tp: str, support: str, predicted: str) -> str:
    return (
        f"CASE WHEN {support} + {predicted} = 0 THEN CAST(0 AS DOUBLE) "
        f"ELSE CAST(2 AS DOUBLE) * {tp} / ({support} + {predicted}) END"
    )


def _counts(source: str, pred: str, by: str = "") -> str:
    """Per-label counts of a source with a boolean prediction expression."""
    return f"""
        SELECT *, {_f1('tp', 'support', 'predicted')} AS f1 FROM (
            SELECT {by} label, count(*) AS n, CAST(sum(y) AS BIGINT) AS support,
                   CAST(sum(CAST({pred} AS INTEGER)) AS BIGINT) AS predicted,
                   CAST(sum(CASE WHEN {pred} THEN y ELSE 0 END) AS BIGINT) AS tp
            FROM {source} GROUP BY ALL)"""


def _macro(counts: str, by: str = "") -> str:
    group = f"GROUP BY {by.rstrip(', ')}" if by else ""
    return f"""
        SELECT {by} coalesce(avg(f1) FILTER (WHERE support > 0), 0) AS macro_f1,
               CAST(sum(support) AS DOUBLE) / sum(n) AS true_positive_rate,
               CAST(sum(predicted) AS DOUBLE) / sum(n) AS predicted_positive_rate,
               CAST(sum(support) AS DOUBLE) / max(n) AS true_labels_per_sample,
               CAST(sum(predicted) AS DOUBLE) / max(n) AS predicted_labels_per_sample
        FROM ({counts}) {group}"""


def _prefix(source: str, low: float, high: float, by: str = "label") -> str:
    """Best-F1 prefix of each group's ranking, by full windows."""
    return f"""
        SELECT {by}, support, first(prob ORDER BY f1 DESC NULLS LAST, place) AS threshold, max(f1) AS f1 FROM (
            SELECT {by}, support, place, CASE WHEN ok THEN prob END AS prob,
                   CASE WHEN ok THEN CAST(2 AS DOUBLE) * tp / (support + place) END AS f1
            FROM (SELECT *, support > 0 AND prob BETWEEN {low} AND {high} AS ok FROM (
                SELECT {by}, prob,
                       CAST(sum(y) OVER (PARTITION BY {by}) AS BIGINT) AS support,
                       row_number() OVER w AS place,
                       sum(y) OVER (w ROWS UNBOUNDED PRECEDING) AS tp
                FROM {source} WINDOW w AS (PARTITION BY {by} ORDER BY prob DESC, row_idx))))
        GROUP BY {by}, support"""


def _shrink(local: str, prior: str, k: int) -> str:
    share = f"(support / (support + CAST({k} AS DOUBLE)))"
    return f"({share} * {local} + (CAST(1 AS DOUBLE) - {share}) * {prior})"


_GRID = "(SELECT unnest(range(81)) AS i)"


def _grid(source: str, by: str = "") -> str:
    points = f"(SELECT s.*, g.i, round(CAST(0.1 AS DOUBLE) + g.i * CAST(0.01 AS DOUBLE), 6) AS t FROM {source} s CROSS JOIN {_GRID} g)"
    return _macro(_counts(points, "prob >= t", f"{by} i, t,"), f"{by} i, t,")


def _best_global(source: str, by: str = "") -> str:
    keys = f"PARTITION BY {by.rstrip(', ')}" if by else ""
    return f"""
        SELECT {by} t AS global_threshold, macro_f1, predicted_labels_per_sample FROM (
            SELECT *, row_number() OVER ({keys} ORDER BY round(macro_f1, 12) DESC, i) AS pick
            FROM ({_grid(source, by)})) WHERE pick = 1"""


def _fitted(prefix: str, by: str = "") -> str:
    """Raw and shrunk thresholds from ``prefix`` rows joined to a ``global_threshold``."""
    return f"""
        SELECT {by} label, support, raw_threshold,
               CASE WHEN support >= 5 THEN {_shrink('raw_threshold', 'global_threshold', 200)} ELSE global_threshold END AS shrunk_threshold
        FROM (SELECT *, CASE WHEN support >= 5 THEN coalesce(threshold, global_threshold) ELSE global_threshold END AS raw_threshold
              FROM ({prefix}))"""


_CTES["global1"] = _best_global("scores1")
_CTES["prefix1"] = _prefix("scores1", 0.05, 0.95)
_CTES["simple1"] = f"""
        SELECT label, CASE WHEN support > 0 THEN {_shrink("coalesce(threshold, 0.5)", 'CAST(0.5 AS DOUBLE)', 200)}
                           ELSE 0.5 END AS threshold FROM prefix1"""
_CTES["variants"] = """
        SELECT label, scale, greatest(0.001, least(0.999, threshold * scale)) AS threshold
        FROM simple1 CROSS JOIN (SELECT CAST(unnest([1.00, 1.03, 1.06]) AS DOUBLE) AS scale)"""
_CTES["fold_global"] = _best_global("calibration", "cal_fold,")
_CTES["fold_prefix"] = _prefix("calibration", 0.05, 0.95, "cal_fold, label")
_CTES["fold_fitted"] = _fitted("SELECT * FROM fold_prefix JOIN fold_global USING (cal_fold)", "cal_fold,")
_CTES["fold_predictions"] = """
        SELECT s.row_idx, s.label, s.y, s.fold, s.prob >= t.shrunk_threshold AS pred
        FROM folded s JOIN fold_fitted t ON t.cal_fold = s.fold AND t.label = s.label"""


# ---- blending

def _adaptive(source: str, by: str = "") -> tuple[str, str, str]:
    points = f"""
        SELECT {by} row_idx, label, y, i, w, w * p0 + (CAST(1 AS DOUBLE) - w) * p1 AS prob
        FROM {source} CROSS JOIN (SELECT i, round(i * CAST(0.1 AS DOUBLE), 6) AS w FROM (SELECT unnest(range(11)) AS i))"""
    return points, f"{by} label, i, w", by


def _adaptive_params(prefix: str, by: str = "") -> str:
    return f"""
        SELECT {by} label, support,
               CASE WHEN support > 0 THEN {_shrink('w', 'CAST(0.4 AS DOUBLE)', 300)} ELSE 0.4 END AS weight,
               CASE WHEN support > 0 THEN {_shrink('t', 'CAST(0.48 AS DOUBLE)', 300)} ELSE 0.48 END AS threshold
        FROM (SELECT *, row_number() OVER (PARTITION BY {by} label ORDER BY round(f1, 12) DESC, i) AS pick
              FROM (SELECT {by} label, support, i, w, coalesce(threshold, 0.48) AS t, coalesce(f1, 0) AS f1 FROM {prefix}))
        WHERE pick = 1"""


_CTES["adaptive_points"] = _adaptive("cells")[0]
_CTES["adaptive_prefix"] = _prefix("adaptive_points", 0.05, 0.95, "label, i, w")
_CTES["adaptive_params"] = _adaptive_params("adaptive_prefix")
_CTES["adaptive_pred"] = """
        SELECT c.label, c.y, w * p0 + (CAST(1 AS DOUBLE) - w) * p1 >= t AS pred
        FROM cells c JOIN (SELECT label, round(weight, 9) AS w, round(threshold, 9) AS t FROM adaptive_params) USING (label)"""
_CTES["fold_adaptive_points"] = _adaptive("calibration_cells", "cal_fold,")[0]
_CTES["fold_adaptive_prefix"] = _prefix("fold_adaptive_points", 0.05, 0.95, "cal_fold, label, i, w")
_CTES["fold_adaptive_params"] = _adaptive_params("fold_adaptive_prefix", "cal_fold,")
_CTES["fold_adaptive_pred"] = """
        SELECT c.fold, c.label, c.y, w * p0 + (CAST(1 AS DOUBLE) - w) * p1 >= t AS pred
        FROM folded_cells c JOIN (SELECT cal_fold, label, round(weight, 9) AS w, round(threshold, 9) AS t FROM fold_adaptive_params) p
        ON p.cal_fold = c.fold AND p.label = c.label"""
_CTES["selector_prefix"] = _prefix("models", 0.02, 0.98, "label, model")
_CTES["selector_scored"] = f"""
        SELECT label, model, t, support, {_f1('tp', 'support', 'predicted')} AS f1 FROM (
            SELECT m.label, m.model, any_value(p.t) AS t, CAST(sum(y) AS BIGINT) AS support,
                   sum(CAST(prob >= p.t AS INTEGER)) AS predicted, sum(CASE WHEN prob >= p.t THEN y ELSE 0 END) AS tp
            FROM models m JOIN (SELECT label, model, coalesce(threshold, 0.48) AS t FROM selector_prefix) p
            ON p.label = m.label AND p.model = m.model GROUP BY m.label, m.model)"""
_CTES["selector"] = """
        SELECT label, support,
               CAST(CASE WHEN support > 0 AND moved THEN top_model ELSE 0 END AS INTEGER) AS model,
               CASE WHEN support = 0 THEN 0.48 WHEN moved THEN top_t ELSE home_t END AS threshold,
               CASE WHEN support > 0 THEN top_f1 ELSE 0 END AS best_f1,
               CASE WHEN support > 0 THEN home_f1 ELSE 0 END AS home_f1
        FROM (SELECT *, top_model <> 0 AND top_f1 >= home_f1 + CAST(0.01 AS DOUBLE) AS moved FROM (
            SELECT label, any_value(support) AS support,
                   first(model ORDER BY f1 DESC, model) AS top_model, first(t ORDER BY f1 DESC, model) AS top_t,
                   max(f1) AS top_f1, max(f1) FILTER (WHERE model = 0) AS home_f1, max(t) FILTER (WHERE model = 0) AS home_t
            FROM selector_scored GROUP BY label))"""

_CTES["calibration_models"] = """
        SELECT m.*, 1 - f.fold AS cal_fold FROM models m JOIN folds f USING (row_idx)"""
_CTES["fold_selector_prefix"] = _prefix("calibration_models", 0.02, 0.98, "cal_fold, label, model")
_CTES["fold_selector_scored"] = f"""
        SELECT cal_fold, label, model, t, support, {_f1('tp', 'support', 'predicted')} AS f1 FROM (
            SELECT m.cal_fold, m.label, m.model, any_value(p.t) AS t, CAST(sum(y) AS BIGINT) AS support,
                   sum(CAST(prob >= p.t AS INTEGER)) AS predicted, sum(CASE WHEN prob >= p.t THEN y ELSE 0 END) AS tp
            FROM calibration_models m JOIN (SELECT cal_fold, label, model, coalesce(threshold, 0.48) AS t FROM fold_selector_prefix) p
            ON p.cal_fold = m.cal_fold AND p.label = m.label AND p.model = m.model GROUP BY m.cal_fold, m.label, m.model)"""
_CTES["fold_selector"] = """
        SELECT cal_fold AS fold, label, CASE WHEN support > 0 AND moved THEN top_model ELSE 0 END AS model,
               CASE WHEN support = 0 THEN 0.48 WHEN moved THEN top_t ELSE home_t END AS threshold
        FROM (SELECT *, top_model <> 0 AND top_f1 >= home_f1 + CAST(0.01 AS DOUBLE) AS moved FROM (
            SELECT cal_fold, label, any_value(support) AS support, first(model ORDER BY f1 DESC, model) AS top_model, first(t ORDER BY f1 DESC, model) AS top_t,
                   max(f1) AS top_f1, max(f1) FILTER (WHERE model = 0) AS home_f1, max(t) FILTER (WHERE model = 0) AS home_t
            FROM fold_selector_scored GROUP BY cal_fold, label))"""
_CTES["fold_selected"] = """
        SELECT f.fold, m.label, m.y, m.prob >= s.threshold AS pred FROM models m JOIN folds f USING (row_idx)
        JOIN fold_selector s ON s.fold = f.fold AND s.label = m.label AND s.model = m.model"""
_CTES["history"] = f"SELECT model, i AS epoch, round(macro_f1, 9) AS value FROM ({_grid('models', 'model,')})"
_CTES["epochs"] = """
        SELECT model, epoch, epoch AS best, value AS best_value, 0 AS misses FROM history WHERE epoch = 0
        UNION ALL
        SELECT h.model, h.epoch, CASE WHEN h.value > e.best_value + 1e-6 THEN h.epoch ELSE e.best END,
               CASE WHEN h.value > e.best_value + 1e-6 THEN h.value ELSE e.best_value END,
               CASE WHEN h.value > e.best_value + 1e-6 THEN 0 ELSE e.misses + 1 END
        FROM epochs e JOIN history h ON h.model = e.model AND h.epoch = e.epoch + 1 WHERE e.misses < 5"""

# ---- label graph

_CTES["pairs"] = """
        SELECT a.label AS src, b.label AS dst, count(*) AS n
        FROM truth a JOIN truth b ON a.row_idx = b.row_idx AND a.y = 1 AND b.y = 1 AND a.label <> b.label
        GROUP BY a.label, b.label"""
_CTES["edges"] = """
        SELECT src, dst, s / sum(s) OVER (PARTITION BY dst) AS weight FROM (
            SELECT *, row_number() OVER (PARTITION BY dst ORDER BY round(s, 12) DESC, src) AS pick FROM (
                SELECT p.src, p.dst,
                       greatest(ln((p.n + CAST(1e-8 AS DOUBLE)) / (a.s * b.s / a.rows + CAST(1e-8 AS DOUBLE))), 0) * (p.n / (p.n + 100.0)) AS s
                FROM pairs p
                JOIN (SELECT label, CAST(sum(y) AS DOUBLE) AS s, count(*) AS rows FROM truth GROUP BY label) a ON a.label = p.src
                JOIN (SELECT label, CAST(sum(y) AS DOUBLE) AS s FROM truth GROUP BY label) b ON b.label = p.dst
                WHERE p.n >= 30) WHERE s > 0) WHERE pick <= 20"""
_CTES["spread"] = """
        SELECT s.row_idx, s.label, s.y, s.prob, coalesce(p.v, 0) AS propagated
        FROM scores1 s LEFT JOIN (
            SELECT s.row_idx, e.dst AS label, sum(s.prob * e.weight) AS v
            FROM scores1 s JOIN edges e ON e.src = s.label GROUP BY s.row_idx, e.dst) p USING (row_idx, label)"""
_CTES["beta_points"] = """
        SELECT row_idx, label, y, beta, round((CAST(1 AS DOUBLE) - beta) * prob + beta * propagated, 9) AS prob
        FROM spread CROSS JOIN (SELECT CAST(unnest([0, 0.025, 0.05, 0.075, 0.10, 0.15, 0.20, 0.25, 0.30]) AS DOUBLE) AS beta)"""

# ---- embeddings

_CTES["emb"] = """
        SELECT vec_id, vec_id >= (SELECT count(*) * CAST(0.8 AS DOUBLE) FROM embeddings) AS held_out,
               list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
        FROM embeddings"""
_CTES["emb_pairs"] = """
        SELECT a.vec_id AS q, b.vec_id AS n, list_cosine_similarity(a.v, b.v) AS cosine
        FROM emb a JOIN emb b ON a.held_out AND NOT b.held_out"""


def _nearest(pairs: str, k: int) -> str:
    return f"""
        SELECT q, n, rank, greatest(0, least(1, cosine)) AS sim FROM (
            SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(cosine, 9) DESC, n) AS rank FROM {pairs})
        WHERE rank <= {k}"""


def _label_probs(neighbors: str, truth: str, settings: str) -> str:
    """``settings`` selects (k, power); every eval cell is kept."""
    return f"""
        SELECT t.row_idx, t.label, t.y, CAST(s.k AS INTEGER) AS k, s.power, coalesce(v.hit / d.total, 0) AS prob
        FROM {truth} t JOIN (SELECT DISTINCT q FROM {neighbors}) e ON e.q = t.row_idx
        CROSS JOIN ({settings}) s
        LEFT JOIN (SELECT q, label, k, power, sum(pow(sim + CAST(1e-8 AS DOUBLE), power)) AS hit
                   FROM {neighbors} nb CROSS JOIN ({settings}) JOIN {truth} ft ON ft.row_idx = nb.n AND ft.y = 1
                   WHERE rank <= k GROUP BY q, label, k, power) v
               ON v.q = t.row_idx AND v.label = t.label AND v.k = s.k AND v.power = s.power
        LEFT JOIN (SELECT q, k, power, greatest(sum(pow(sim + CAST(1e-8 AS DOUBLE), power)), 1e-8) AS total
                   FROM {neighbors} CROSS JOIN ({settings}) WHERE rank <= k GROUP BY q, k, power) d
               ON d.q = t.row_idx AND d.k = s.k AND d.power = s.power"""


_ONE = "SELECT 20 AS k, CAST(2 AS DOUBLE) AS power"


def _settings(powers: str) -> str:
    return f"SELECT k, CAST(power AS DOUBLE) AS power FROM (SELECT unnest([5, 10, 20, 40, 80]) AS k) CROSS JOIN (SELECT unnest([{powers}]) AS power)"


_CTES["emb_nearest"] = _nearest("emb_pairs", 20)
_CTES["emb_nearest80"] = _nearest("emb_pairs", 80)
_CTES["emb_probs"] = _label_probs("emb_nearest", "emb_truth", _ONE)
for _name, _powers in (("tune_candidates", "1, 2, 4"), ("candidates", "2, 4, 6")):
    _CTES[_name] = f"""
        SELECT c.row_idx, c.label, c.y, c.k, c.power, round(c.prob, 9) AS prob, b.prob AS base
        FROM ({_label_probs('emb_nearest80', 'emb_truth', _settings(_powers))}) c JOIN emb_scores0 b USING (row_idx, label)"""
_CTES["tune_grid"] = _macro(
    _counts(
        "(SELECT *, round(i * CAST(0.05 AS DOUBLE), 6) AS w FROM tune_candidates CROSS JOIN (SELECT unnest(range(21)) AS i))",
        "w * base + (CAST(1 AS DOUBLE) - w) * prob >= 0.5",
        "k, power, i, w,",
    ),
    "k, power, i, w,",
)
_CTES["v9_points"] = """
        SELECT row_idx, label, y, k, power, w, w * base + (CAST(1 AS DOUBLE) - w) * prob AS prob
        FROM candidates CROSS JOIN (SELECT CAST(unnest([0.2, 0.3, 0.4, 0.5, 0.6]) AS DOUBLE) AS w)"""
_CTES["v9_prefix"] = _prefix("v9_points", 0.05, 0.95, "label, k, power, w")
_CTES["v9_scored"] = f"""
        SELECT label, k, power, w, t, support, {_f1('tp', 'support', 'predicted')} AS f1 FROM (
            SELECT label, k, power, w, any_value(t) AS t, CAST(sum(y) AS BIGINT) AS support,
                   sum(CAST(prob >= t AS INTEGER)) AS predicted, sum(CASE WHEN prob >= t THEN y ELSE 0 END) AS tp
            FROM v9_points JOIN (SELECT label, k, power, w, coalesce(threshold, 0.48) AS t FROM v9_prefix)
            USING (label, k, power, w) GROUP BY label, k, power, w)"""
_CTES["v9_params"] = f"""
        SELECT label, support,
               CAST(CASE WHEN support > 0 THEN k ELSE 40 END AS INTEGER) AS k,
               CASE WHEN support > 0 THEN power ELSE 4 END AS power,
               CASE WHEN support > 0 THEN {_shrink('w', 'CAST(0.4 AS DOUBLE)', 500)} ELSE 0.4 END AS weight,
               CASE WHEN support > 0 THEN {_shrink('t', 'CAST(0.48 AS DOUBLE)', 500)} ELSE 0.48 END AS threshold
        FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, k, power, w) AS pick FROM v9_scored) WHERE pick = 1"""

_CTES["fold_v9_points"] = "SELECT *, 1 - row_idx % 2 AS cal_fold FROM v9_points"
_CTES["fold_v9_prefix"] = _prefix("fold_v9_points", 0.05, 0.95, "cal_fold, label, k, power, w")
_CTES["fold_v9_scored"] = f"""
        SELECT cal_fold, label, k, power, w, t, support, {_f1('tp', 'support', 'predicted')} AS f1 FROM (
            SELECT cal_fold, label, k, power, w, any_value(t) AS t, CAST(sum(y) AS BIGINT) AS support,
                   sum(CAST(prob >= t AS INTEGER)) AS predicted, sum(CASE WHEN prob >= t THEN y ELSE 0 END) AS tp
            FROM fold_v9_points JOIN (SELECT cal_fold, label, k, power, w, coalesce(threshold, 0.48) AS t FROM fold_v9_prefix)
            USING (cal_fold, label, k, power, w) GROUP BY cal_fold, label, k, power, w)"""
_CTES["fold_v9_params"] = f"""
        SELECT cal_fold AS fold, label, CASE WHEN support > 0 THEN k ELSE 40 END AS k, CASE WHEN support > 0 THEN power ELSE 4 END AS power,
               round(CASE WHEN support > 0 THEN {_shrink('w', 'CAST(0.4 AS DOUBLE)', 500)} ELSE 0.4 END, 9) AS w,
               round(CASE WHEN support > 0 THEN {_shrink('t', 'CAST(0.48 AS DOUBLE)', 500)} ELSE 0.48 END, 9) AS t
        FROM (SELECT *, row_number() OVER (PARTITION BY cal_fold, label ORDER BY f1 DESC, k, power, w) AS pick FROM fold_v9_scored) WHERE pick = 1"""
_CTES["fold_v9_pred"] = """
        SELECT p.fold, c.label, c.y, p.w * c.base + (CAST(1 AS DOUBLE) - p.w) * c.prob >= p.t AS pred
        FROM candidates c JOIN fold_v9_params p ON p.fold = c.row_idx % 2 AND p.label = c.label AND p.k = c.k AND p.power = c.power"""

# ---- TF-IDF


def _grams(source: str, low: int, high: int) -> str:
    cut = " UNION ALL ".join(
        "SELECT row_idx, unnest(list_transform(range(1, len(ch) - {}), lambda i: {})) AS term FROM chars".format(
            n - 2, " || ".join(f"ch[i + {j}]" for j in range(n))
        )
        for n in range(low, high + 1)
    )
    return f"""
        SELECT row_idx, term, count(*) AS tf FROM (
            WITH chars AS (SELECT row_idx, string_split(regexp_replace(sequence, '\\s{{2,}}', ' ', 'g'), '') AS ch FROM {source})
            {cut}) GROUP BY row_idx, term"""


_CTES["fit_docs"] = "SELECT * FROM chrono WHERE part = 'train'"
_CTES["eval_docs"] = "SELECT * FROM chrono WHERE part = 'val'"
for _name, _low, _high, _cap in (("35", 3, 5, 120000),):
    _CTES[f"fit_tf{_name}"] = _grams("fit_docs", _low, _high)
    _CTES[f"eval_tf{_name}"] = _grams("eval_docs", _low, _high)
    _CTES[f"vocab{_name}"] = f"""
        SELECT term, df, cf, row_number() OVER (ORDER BY term) - 1 AS term_idx,
               ln((CAST(1 AS DOUBLE) + (SELECT count(*) FROM fit_docs)) / (CAST(1 AS DOUBLE) + df)) + 1 AS idf
        FROM (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM fit_tf{_name} GROUP BY term
              HAVING count(*) >= 5 ORDER BY cf DESC, term LIMIT {_cap})"""
    for _side in ("fit", "eval"):
        _CTES[f"{_side}_x{_name}"] = f"""
        SELECT row_idx, term, w / sqrt(sum(w * w) OVER (PARTITION BY row_idx)) AS x
        FROM (SELECT row_idx, term, (CAST(1 AS DOUBLE) + ln(tf)) * idf AS w FROM {_side}_tf{_name} JOIN vocab{_name} USING (term))"""
_CTES["doc_pairs"] = """
        SELECT a.row_idx AS q, b.row_idx AS n, coalesce(d.cosine, 0) AS cosine
        FROM eval_docs a CROSS JOIN fit_docs b
        LEFT JOIN (SELECT q.row_idx AS q, f.row_idx AS n, sum(q.x * f.x) AS cosine
                   FROM eval_x35 q JOIN fit_x35 f USING (term) GROUP BY q.row_idx, f.row_idx) d
               ON d.q = a.row_idx AND d.n = b.row_idx"""
_CTES["doc_nearest"] = _nearest("doc_pairs", 20)
_CTES["doc_probs"] = _label_probs("doc_nearest", "truth", _ONE)

# ---- pooling

_CTES["tokens"] = """
        SELECT vec_id // 8 AS seq_id, vec_id % 8 AS pos, embedding AS vector, vec_id % 8 <= ((vec_id // 8) // 7) % 8 AS attended
        FROM embeddings"""


def _build(final: str, *names: str) -> str:
    """Prefix ``final`` with every table expression it needs, in dependency order."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for other in _CTES:
            if other != name and _mentions(_CTES[name], other):
                add(other)
        order.append(name)

    for name in _CTES:
        if _mentions(final, name):
            add(name)
    keyword = "WITH RECURSIVE" if _RECURSIVE & set(order) else "WITH"
    ctes = ",\n".join(f"    {n} AS ({_CTES[n]})" for n in order)
    return f"{keyword}\n{ctes}\n{final}" if order else final


def _mentions(text: str, name: str) -> bool:
    import re

    return re.search(rf"(FROM|JOIN)\s+\(?{name}\b", text) is not None


def _r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


_MACRO_COLUMNS = (
    "macro_f1", "true_positive_rate", "predicted_positive_rate", "true_labels_per_sample", "predicted_labels_per_sample",
)
_COUNT_COLUMNS = "label, n, support, predicted, tp, round(f1, 6) AS f1"
_DESCRIBE = """count(v) AS "count", round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, CAST(min(v) AS DOUBLE) AS "min",
               round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75,
               CAST(max(v) AS DOUBLE) AS "max" """


def _audit_side(side: str) -> str:
    metrics = {
        "n_rows": f"SELECT count(*) FROM {side}",
        "duplicate_protein_id": f"SELECT count(*) - count(DISTINCT protein_id) FROM {side}",
        "duplicate_sequence_rows": f"SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM {side} GROUP BY sequence HAVING count(*) > 1)",
        "duplicate_sequence_groups": f"SELECT count(*) FROM (SELECT sequence FROM {side} GROUP BY sequence HAVING count(*) > 1)",
        "missing_cells": f"SELECT sum(CAST(protein_id IS NULL AS INTEGER) + CAST(sequence IS NULL AS INTEGER)) FROM {side}",
        "length_count": f"SELECT count(*) FROM {side}",
        "length_mean": f"SELECT avg(length(sequence)) FROM {side}",
        "length_std": f"SELECT stddev_samp(length(sequence)) FROM {side}",
        "length_min": f"SELECT min(length(sequence)) FROM {side}",
        "length_p25": f"SELECT quantile_cont(length(sequence), 0.25) FROM {side}",
        "length_p50": f"SELECT quantile_cont(length(sequence), 0.5) FROM {side}",
        "length_p75": f"SELECT quantile_cont(length(sequence), 0.75) FROM {side}",
        "length_max": f"SELECT max(length(sequence)) FROM {side}",
    }
    return " UNION ALL ".join(
        f"SELECT '{name}' AS metric, round(CAST(({sql}) AS DOUBLE), 6) AS value, '{side}' AS side" for name, sql in metrics.items()
    )


_RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
_LEAKS = " UNION ALL ".join(
    f"""SELECT count(*) AS leaked, '{label}' AS split FROM (
            SELECT t.sequence FROM train t JOIN {cte} s USING (row_idx) GROUP BY t.sequence HAVING min(s.part) <> max(s.part))"""
    for label, cte in (("random", "random_split"), ("tail", "tail_split"), ("tail_clean", "tail_clean"), ("chronological", "chrono"))
)
_DUPLICATES = """SELECT CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS duplicate_sequence_rows,
                        count(*) FILTER (WHERE n > 1) AS duplicate_sequence_groups
                 FROM (SELECT count(*) AS n FROM proteins GROUP BY sequence)"""

_FINAL: dict[str, str] = {
    "numeric_ids": "SELECT row_idx, protein_id, CASE WHEN regexp_matches(protein_id, '^[A-Za-z]+[0-9]+$') THEN CAST(regexp_extract(protein_id, '[0-9]+$') AS BIGINT) ELSE -1 END AS num_id FROM proteins",
    "audit_summary": _audit_side("train") + " UNION ALL " + _audit_side("test"),
    "audit_length_stats": f"SELECT {_DESCRIBE} FROM (SELECT length(sequence) AS v FROM proteins)",
    "audit_nonstandard": f"SELECT residue, count(*) AS n FROM (SELECT unnest(string_split(sequence, '')) AS residue FROM proteins) WHERE NOT contains('{_RESIDUES}', residue) GROUP BY residue",
    "audit_labels": """SELECT count(*) AS label_count, round(CAST(sum(pos) AS DOUBLE) / sum(n), 6) AS density, min(pos) AS positive_count_min,
               round(quantile_cont(pos, 0.5), 6) AS positive_count_median, round(avg(pos), 6) AS positive_count_mean, max(pos) AS positive_count_max
        FROM (SELECT label, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos FROM truth GROUP BY label)""",
    "audit_overlap": """SELECT 'protein_id' AS key, count(*) AS shared FROM (SELECT protein_id FROM train INTERSECT SELECT protein_id FROM test)
        UNION ALL SELECT 'exact_sequence', count(*) FROM (SELECT sequence FROM train INTERSECT SELECT sequence FROM test)""",
    "audit_id_ranges": "SELECT min(CAST(substr(protein_id, 2) AS BIGINT)) AS numeric_min, max(CAST(substr(protein_id, 2) AS BIGINT)) AS numeric_max FROM proteins",
    "audit_tail": """SELECT count(*) FILTER (WHERE part = 'val') AS tail_samples, count(*) FILTER (WHERE part = 'train') AS head_samples,
               round(avg(length(sequence)) FILTER (WHERE part = 'val'), 6) AS length_mean,
               round(quantile_cont(length(sequence), 0.5) FILTER (WHERE part = 'val'), 6) AS length_median,
               round(avg(pos) FILTER (WHERE part = 'val'), 6) AS labels_per_sample_mean,
               round(sum(pos) FILTER (WHERE part = 'val') / (26.0 * count(*) FILTER (WHERE part = 'val')), 6) AS label_density
        FROM tail_split JOIN (SELECT row_idx, CAST(sum(y) AS DOUBLE) AS pos FROM truth GROUP BY row_idx) p USING (row_idx)""",
    "dup_groups": _DUPLICATES,
    "split_random_group": "SELECT row_idx, part FROM random_split",
    "split_tail": "SELECT row_idx, part FROM tail_split",
    "split_tail_overlap": "SELECT row_idx FROM tail_split WHERE part = 'val' AND sequence IN (SELECT sequence FROM tail_split WHERE part = 'train')",
    "split_tail_clean": "SELECT row_idx, part FROM tail_clean",
    "split_chronological": "SELECT row_idx, part FROM chrono",
    "split_drift": """SELECT part, round(avg(abs(p - a)), 6) AS drift
        FROM (SELECT s.part, t.label, avg(t.y) AS p FROM truth t JOIN random_split s USING (row_idx) GROUP BY s.part, t.label)
        JOIN (SELECT t.label, avg(t.y) AS a FROM truth t JOIN random_split s USING (row_idx) GROUP BY t.label) o USING (label)
        GROUP BY part""",
    "split_leakage": _LEAKS,
    "group_kfold": "SELECT row_idx, fold FROM folds",
    "composition_features": "SELECT row_idx, "
    + ", ".join(
        f"round(CASE WHEN length(sequence) = 0 THEN 0 ELSE CAST(length(sequence) - length(replace(sequence, '{r}', '')) AS DOUBLE) / length(sequence) END, 6) AS frac_{r}"
        for r in _RESIDUES
    )
    + ", round(ln(1 + CAST(length(sequence) AS DOUBLE)), 6) AS log_length FROM proteins",
    "clean_sequence": "SELECT row_idx, translate(upper(replace(sequence, 'ß', 'SS')), 'BOUZ', 'XXXX') AS cleaned FROM proteins",
    "chunks": """SELECT row_idx, CAST(i AS INTEGER) AS chunk_no, CASE WHEN length(s) <= 1022 THEN s ELSE substr(s, i * 512 + 1, 1022) END AS chunk
        FROM (SELECT row_idx, s, unnest(range(CASE WHEN length(s) <= 1022 THEN 1 ELSE CAST(ceil((length(s) - 1022) / 512.0) AS BIGINT) + 1 END)) AS i
              FROM (SELECT row_idx, translate(upper(replace(sequence, 'ß', 'SS')), 'BOUZ', 'XXXX') AS s FROM proteins))
        WHERE length(s) <= 1022 OR length(substr(s, i * 512 + 1, 1022)) > 10""",
    "encode_ids": f"""SELECT row_idx, array_to_string(list_concat(
               list_transform(string_split(kept, ''), lambda c: CASE WHEN instr('{_RESIDUES}', c) > 0 THEN instr('{_RESIDUES}', c) ELSE 21 END),
               list_transform(range(greatest(0, 1536 - size)), lambda i: 0)), ' ') AS ids
        FROM (SELECT row_idx, length(sequence) AS size, CASE WHEN length(sequence) <= 1536 THEN sequence ELSE
                  substr(sequence, 1, 512) || substr(sequence, greatest(0, length(sequence) // 2 - 256) + 1, 512) || right(sequence, 512) END AS kept
              FROM proteins)""",
    "char_ngrams": "SELECT row_idx, term, tf FROM (" + _grams("proteins", 3, 5) + ")",
    "vocab_topn": "SELECT term, term_idx, df, cf, round(idf, 6) AS idf FROM vocab35",
    "tfidf_fit": "SELECT row_idx, term, round(x, 6) AS x FROM fit_x35",
    "tfidf_transform": "SELECT row_idx, term, round(x, 6) AS x FROM eval_x35",
    "masked_mean_pool": """SELECT seq_id, CAST(dim AS INTEGER) AS dim, round(coalesce(sum(x) FILTER (WHERE keep), 0) / greatest(count(*) FILTER (WHERE keep), 1), 6) AS value
        FROM (SELECT t.seq_id, unnest(range(64)) AS dim, CAST(unnest(vector) AS DOUBLE) AS x, attended AND pos > 0 AND pos < size - 1 AS keep
              FROM tokens t JOIN (SELECT seq_id, count(*) FILTER (WHERE attended) AS size FROM tokens GROUP BY seq_id) s USING (seq_id))
        GROUP BY seq_id, dim""",
    "chunk_mean": """SELECT seq_id, CAST(dim AS INTEGER) AS dim, round(avg(x), 6) AS value
        FROM (SELECT seq_id, unnest(range(64)) AS dim, CAST(unnest(vector) AS DOUBLE) AS x FROM tokens) GROUP BY seq_id, dim""",
    "linear_predict": """
        SELECT row_idx, 'label_' || i AS label, round(1 / (1 + exp(-(coalesce(base, 0) + i * coalesce(slope, 0) + 0.25 - 0.125 * i))), 6) AS prob
        FROM (SELECT row_idx, sum(x * (h % 13 - 6) / 4.0) AS base, sum(x * (h % 7 - 3) / 40.0) AS slope FROM (
            SELECT row_idx, x, CAST('0x' || left(md5(term), 4) AS INTEGER) AS h FROM eval_x35) GROUP BY row_idx)
        CROSS JOIN (SELECT unnest(range(26)) AS i)""",
    "knn_tfidf": "SELECT q, n, rank, round(sim, 6) AS sim FROM doc_nearest",
    "knn_embedding": "SELECT q, n, rank, round(sim, 6) AS sim FROM emb_nearest",
    "knn_embedding_rings": "SELECT q, n, rank, round(sim, 6) AS sim FROM emb_nearest",
    "knn_similarity_stats": "SELECT round(avg(sim) FILTER (WHERE rank = 1), 6) AS mean_top1_similarity, round(avg(sim), 6) AS mean_topk_similarity FROM emb_nearest",
    "knn_label_probs": "SELECT row_idx, label, y, round(round(prob, 9), 6) AS prob FROM emb_probs",
    "knn_document_probs": "SELECT row_idx, label, y, round(prob, 6) AS prob FROM doc_probs",
    "knn_document_f1": f"SELECT {_COUNT_COLUMNS} FROM ({_counts('doc_probs', 'round(prob, 9) >= 0.5')})",
    "label_support": "SELECT label, CAST(sum(y) AS BIGINT) AS support FROM truth GROUP BY label",
    "labels_per_sample": "SELECT row_idx, CAST(sum(y) AS BIGINT) AS n_labels FROM truth GROUP BY row_idx",
    "labels_per_sample_stats": f"SELECT {_DESCRIBE} FROM (SELECT CAST(sum(y) AS BIGINT) AS v FROM truth GROUP BY row_idx)",
    "apply_thresholds": "SELECT row_idx, label, CAST(prob >= 0.5 AS INTEGER) AS pred FROM scores1",
    "per_label_f1": f"SELECT {_COUNT_COLUMNS} FROM ({_counts('scores1', 'prob >= 0.5')})",
    "per_label_report": f"""SELECT label, support, CASE WHEN support > 0 THEN round(f1, 6) END AS f1,
               round(CAST(predicted AS DOUBLE) / n, 6) AS predicted_positive_rate, round(CAST(support AS DOUBLE) / n, 6) AS true_positive_rate
        FROM ({_counts('scores1', 'prob >= 0.5')})""",
    "macro_f1": f"SELECT round(macro_f1, 6) AS macro_f1 FROM ({_macro(_counts('scores1', 'prob >= 0.5'))})",
    "threshold_metrics": f"SELECT {_r(*_MACRO_COLUMNS)} FROM ({_macro(_counts('scores1', 'prob >= 0.48'))})",
    "score_alignment_check": """SELECT label, count(*) AS misaligned FROM (
            SELECT coalesce(a.label, b.label) AS label FROM scores0 a
            FULL JOIN (SELECT * FROM scores1 WHERE NOT (label = 'label_25' AND y = 1)) b ON a.row_idx = b.row_idx AND a.label = b.label
            WHERE a.y IS DISTINCT FROM b.y) GROUP BY label""",
    "pos_weight": """SELECT label, round(greatest(1, least(20, CAST(n - pos AS DOUBLE) / greatest(pos, 1))), 6) AS pos_weight,
               round(n / (2.0 * (n - pos)), 6) AS balanced_0, round(n / (2.0 * pos), 6) AS balanced_1
        FROM (SELECT label, CAST(sum(y) AS BIGINT) AS pos, count(*) AS n FROM truth GROUP BY label)""",
    "sigmoid_link": """SELECT row_idx, CAST(dim AS INTEGER) AS dim, round(1 / (1 + exp(-z)), 6) AS plain, round(1 / (1 + exp(-greatest(-30, least(30, z)))), 6) AS clipped
        FROM (SELECT vec_id AS row_idx, unnest(range(64)) AS dim, CAST(unnest(embedding) AS DOUBLE) * 40 AS z FROM embeddings)""",
    "best_threshold_per_label": "SELECT label, support, round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM prefix1",
    "global_threshold_grid": f"SELECT round(t, 6) AS threshold, {_r('macro_f1', 'predicted_labels_per_sample')} FROM ({_grid('scores1')})",
    "global_threshold": f"SELECT {_r('global_threshold', 'macro_f1', 'predicted_labels_per_sample')} FROM global1",
    "fit_thresholds_shrunk": f"SELECT label, support, {_r('raw_threshold', 'shrunk_threshold')} FROM ({_fitted('SELECT * FROM prefix1 CROSS JOIN (SELECT global_threshold FROM global1)')})",
    "crossfit_thresholds": f"SELECT cal_fold AS fold, label, support, {_r('raw_threshold', 'shrunk_threshold')} FROM fold_fitted",
    "crossfit_metrics": f"""SELECT fold, {_r(*_MACRO_COLUMNS)} FROM ({_macro(_counts('fold_predictions', 'pred', 'fold,'), 'fold,')})
        UNION ALL SELECT -1 AS fold, {_r(*_MACRO_COLUMNS)} FROM ({_macro(_counts('fold_predictions', 'pred'))})""",
    "threshold_variants": "SELECT label, scale, round(threshold, 6) AS threshold FROM variants",
    "variant_summary": "SELECT scale, round(predicted_labels_per_sample, 6) AS predicted_labels_per_sample, round(predicted_positive_rate, 6) AS predicted_positive_rate FROM ("
    + _macro(
        _counts(
            "(SELECT s.label, s.y, s.prob, v.scale, round(v.threshold, 9) AS t FROM scores2 s JOIN test USING (row_idx) JOIN variants v USING (label))",
            "prob >= t",
            "scale,",
        ),
        "scale,",
    )
    + ")",
    "blend_two_way_grid": f"SELECT w AS weight_a, {_r(*_MACRO_COLUMNS)} FROM ("
    + _macro(
        _counts(
            "(SELECT *, round(i * CAST(0.05 AS DOUBLE), 6) AS w FROM cells CROSS JOIN (SELECT unnest(range(21)) AS i))",
            "w * p0 + (CAST(1 AS DOUBLE) - w) * p1 >= 0.5",
            "w,",
        ),
        "w,",
    )
    + ")",
    "blend_two_way_best": f"SELECT w AS weight_a, {_r(*_MACRO_COLUMNS)} FROM ("
    + _macro(
        _counts(
            "(SELECT *, round(i * CAST(0.025 AS DOUBLE), 6) AS w FROM cells CROSS JOIN (SELECT unnest(range(41)) AS i))",
            "w * p0 + (CAST(1 AS DOUBLE) - w) * p1 >= 0.5",
            "w,",
        ),
        "w,",
    )
    + ") ORDER BY round(macro_f1, 12) DESC, w LIMIT 1",
    "blend_three_way_top10": f"SELECT wa AS weight_a, wb AS weight_b, wc AS weight_c, {_r(*_MACRO_COLUMNS)} FROM ("
    + _macro(
        _counts(
            """(SELECT *, round(a * CAST(0.05 AS DOUBLE), 6) AS wa, round(b * CAST(0.05 AS DOUBLE), 6) AS wb, round((20 - a - b) * CAST(0.05 AS DOUBLE), 6) AS wc
                FROM cells JOIN (SELECT a, b FROM (SELECT unnest(range(21)) AS a), (SELECT unnest(range(21)) AS b)) g ON a + b <= 20)""",
            "wa * p0 + wb * p1 + wc * p2 >= 0.5",
            "wa, wb, wc,",
        ),
        "wa, wb, wc,",
    )
    + ") ORDER BY round(macro_f1, 12) DESC, wa, wb LIMIT 10",
    "tune_knn_blend": f"""SELECT b.k, b.power, round(a.macro_f1, 6) AS knn_macro_f1, b.w AS base_weight, round(b.macro_f1, 6) AS blend_macro_f1,
               round(b.predicted_labels_per_sample, 6) AS predicted_labels_per_sample
        FROM (SELECT *, row_number() OVER (PARTITION BY k, power ORDER BY round(macro_f1, 12) DESC, i) AS pick FROM tune_grid) b
        JOIN (SELECT * FROM tune_grid WHERE i = 0) a ON a.k = b.k AND a.power = b.power WHERE b.pick = 1""",
    "adaptive_blend": f"SELECT label, support, {_r('weight', 'threshold')} FROM adaptive_params",
    "adaptive_blend_f1": f"SELECT {_COUNT_COLUMNS} FROM ({_counts('adaptive_pred', 'pred')})",
    "adaptive_crossfit": f"SELECT fold, {_r(*_MACRO_COLUMNS)} FROM ({_macro(_counts('fold_adaptive_pred', 'pred', 'fold,'), 'fold,')})",
    "label_specific_knn": f"SELECT label, support, k, {_r('power', 'weight', 'threshold')} FROM v9_params",
    "label_specific_f1": f"SELECT {_COUNT_COLUMNS} FROM ("
    + _counts(
        """(SELECT c.label, c.y, w * base + (CAST(1 AS DOUBLE) - w) * prob >= t AS pred FROM candidates c
            JOIN (SELECT label, k, power, round(weight, 9) AS w, round(threshold, 9) AS t FROM v9_params) p USING (label, k, power))""",
        "pred",
    )
    + ")",
    "param_histogram": """SELECT 'k' AS parameter, CAST(k AS DOUBLE) AS value, count(*) AS n_labels FROM v9_params GROUP BY k
        UNION ALL SELECT 'power', CAST(power AS DOUBLE), count(*) FROM v9_params GROUP BY power""",
    "weight_summary": "SELECT round(avg(weight), 6) AS mean_weight, round(quantile_cont(weight, 0.5), 6) AS median_weight FROM adaptive_params",
    "label_specific_crossfit": f"SELECT CAST(fold AS INTEGER) AS fold, {_r(*_MACRO_COLUMNS)} FROM ({_macro(_counts('fold_v9_pred', 'pred', 'fold,'), 'fold,')})",
    "selector_scores": "SELECT label, model, support, round(t, 6) AS threshold, round(f1, 6) AS f1 FROM selector_scored",
    "select_crossfit": f"SELECT fold, {_r(*_MACRO_COLUMNS)} FROM ({_macro(_counts('fold_selected', 'pred', 'fold,'), 'fold,')})",
    "thresholds_optimistic": f"SELECT {_r(*_MACRO_COLUMNS)} FROM ("
    + _macro(
        _counts(
            f"""(SELECT s.label, s.y, s.prob >= round(t.shrunk_threshold, 9) AS pred FROM scores1 s
                 JOIN ({_fitted("SELECT * FROM prefix1 CROSS JOIN (SELECT global_threshold FROM global1)")}) t USING (label))""",
            "pred",
        )
    )
    + ")",
    "early_stop_epoch": """
        SELECT model, best AS best_epoch, round(best_value, 6) AS best_value, epoch AS stop_epoch
        FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY epoch DESC) AS back FROM epochs) WHERE back = 1""",
    "running_loss": """
        SELECT model, batch, rows, round(loss, 6) AS loss, round(sum(rows * loss) OVER w / sum(rows) OVER w, 6) AS running_loss FROM (
            SELECT model, row_idx // 64 AS batch, count(DISTINCT row_idx) AS rows,
                   avg(-ln(CASE WHEN y = 1 THEN p ELSE CAST(1 AS DOUBLE) - p END)) AS loss
            FROM (SELECT *, greatest(1e-6, least(CAST(1 AS DOUBLE) - 1e-6, prob)) AS p FROM models) GROUP BY model, batch)
        WINDOW w AS (PARTITION BY model ORDER BY batch ROWS UNBOUNDED PRECEDING)""",
    "rf_skipped_labels": """
        SELECT label, CAST(sum(y) AS BIGINT) AS positives FROM truth t JOIN random_split s USING (row_idx) WHERE s.part = 'train'
        GROUP BY label HAVING sum(y) < 10""",
    "split_metadata": """
        SELECT 42 AS seed, CAST(0.2 AS DOUBLE) AS val_size,
               (SELECT count(*) FROM random_split WHERE part = 'train') AS random_train_rows, (SELECT count(*) FROM random_split WHERE part = 'val') AS random_val_rows,
               (SELECT count(*) FROM tail_split WHERE part = 'train') AS tail_train_rows, (SELECT count(*) FROM tail_split WHERE part = 'val') AS tail_val_rows,
               (SELECT count(*) FROM tail_clean WHERE part = 'train') AS tail_clean_train_rows, (SELECT count(*) FROM tail_clean WHERE part = 'val') AS tail_clean_val_rows,
               (SELECT count(*) FROM chrono WHERE part = 'train') AS chronological_train_rows, (SELECT count(*) FROM chrono WHERE part = 'val') AS chronological_val_rows,
               (SELECT round(avg(abs(a.p - b.p)), 6) FROM (SELECT label, avg(y) AS p FROM truth JOIN random_split USING (row_idx) WHERE part = 'train' GROUP BY label) a
                    JOIN (SELECT label, avg(y) AS p FROM truth JOIN random_split USING (row_idx) GROUP BY label) b USING (label)) AS drift_train,
               (SELECT round(avg(abs(a.p - b.p)), 6) FROM (SELECT label, avg(y) AS p FROM truth JOIN random_split USING (row_idx) WHERE part = 'val' GROUP BY label) a
                    JOIN (SELECT label, avg(y) AS p FROM truth JOIN random_split USING (row_idx) GROUP BY label) b USING (label)) AS drift_val,
               (SELECT min(num_id) FROM test) AS test_min,
               (SELECT count(*) FROM tail_split WHERE part = 'val' AND sequence IN (SELECT sequence FROM tail_split WHERE part = 'train')) AS tail_overlap_rows,
               (SELECT count(DISTINCT sequence) FROM tail_split WHERE part = 'val' AND sequence IN (SELECT sequence FROM tail_split WHERE part = 'train')) AS tail_overlap_groups,
               (SELECT min(CAST(substr(p.protein_id, 2) AS BIGINT)) FROM proteins p WHERE NOT p.is_test AND p.sequence IN (SELECT sequence FROM chrono WHERE part = 'val')) AS chronological_cutoff""",
    "select_model": f"SELECT label, support, model, {_r('threshold', 'best_f1', 'home_f1')} FROM selector",
    "select_model_f1": f"SELECT {_COUNT_COLUMNS} FROM ("
    + _counts("(SELECT m.label, m.y, m.prob >= s.threshold AS pred FROM models m JOIN selector s ON s.label = m.label AND s.model = m.model)", "pred")
    + ")",
    "cooccurrence": "SELECT src, dst, n FROM pairs",
    "label_graph": "SELECT src, dst, round(weight, 6) AS weight FROM edges",
    "propagate": "SELECT row_idx, label, round(propagated, 6) AS propagated FROM spread",
    "propagate_beta_grid": f"SELECT {_r('beta', 'global_threshold', 'macro_f1', 'predicted_labels_per_sample')} FROM ({_best_global('beta_points', 'beta,')})",
    "submission_wide": "SELECT p.protein_id, "
    + ", ".join(f"max(CASE WHEN s.label = 'label_{i}' THEN CAST(s.prob >= 0.5 AS INTEGER) END) AS label_{i}" for i in range(26))
    + " FROM test p JOIN scores1 s USING (row_idx) GROUP BY p.row_idx, p.protein_id",
    "feature_cache_key": """SELECT substr(sha256('{"config": {"max_features": 120000, "min_df": 5, "ngram_max": 5, "ngram_min": 3}, "mode": "submit"}|'
               || count(*) || '|' || sum(CAST('0x' || substr(md5(row_idx || '|' || sequence), 1, 16) AS UBIGINT))
               || '|' || sum(CAST('0x' || substr(md5(row_idx || '|' || sequence), 17, 16) AS UBIGINT))), 1, 12) AS cache_key FROM proteins""",
}

_Z = " + ".join(f"({i + 1} + ord * CAST({0.5 - i / 4} AS DOUBLE)) * p{i}" for i in range(4))
_FINAL["stack_predict"] = f"""
        SELECT row_idx, label, round(1 / (1 + exp(-greatest(-30, least(30, (-2 - ord / CAST(10 AS DOUBLE)) + {_Z})))), 6) AS prob
        FROM (SELECT a.row_idx, a.label, a.ord, a.prob AS p0, b.prob AS p1, c.prob AS p2, d.prob AS p3 FROM scores0 a
              JOIN scores1 b USING (row_idx, label) JOIN scores2 c USING (row_idx, label) JOIN scores3 d USING (row_idx, label))"""


def _auc(source: str, by: str = "") -> str:
    """Mid-rank AUC per label by full windows."""
    return f"""
        SELECT {by} label, (sum(mid) FILTER (WHERE y = 1) - any_value(p) * (any_value(p) + 1) / 2.0) / (any_value(p) * (any_value(n) - any_value(p))) AS auc
        FROM (SELECT *, rank() OVER (PARTITION BY {by} label ORDER BY prob) + (count(*) OVER (PARTITION BY {by} label, prob) - 1) / 2.0 AS mid,
                     CAST(sum(y) OVER (PARTITION BY {by} label) AS DOUBLE) AS p, CAST(count(*) OVER (PARTITION BY {by} label) AS DOUBLE) AS n
              FROM {source})
        WHERE p > 0 AND p < n GROUP BY {by} label"""


_FINAL["label_auc"] = f"SELECT label, round(auc, 6) AS auc FROM ({_auc('scores0')})"
_FINAL["macro_auc"] = f"SELECT round(coalesce(avg(auc), 0), 6) AS macro_auc FROM ({_auc('scores1')})"
_FINAL["candidate_ranking"] = f"""
        SELECT a.model, round(a.macro_auc, 6) AS macro_auc, round(f.macro_f1, 6) AS macro_f1, round(f.predicted_labels_per_sample, 6) AS predicted_labels_per_sample
        FROM (SELECT model, avg(auc) AS macro_auc FROM ({_auc('models', 'model,')}) GROUP BY model) a
        JOIN ({_macro(_counts('models', 'prob >= 0.5', 'model,'), 'model,')}) f USING (model)
        ORDER BY a.macro_auc DESC, f.macro_f1 DESC"""

ORACLES: dict[str, str] = {name: _build(sql) for name, sql in _FINAL.items()}
