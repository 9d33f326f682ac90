"""Secret scan: three fixed patterns, and strings that pass as random, in SQL functions only."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelweave.session import materialize

# Kinds, patterns and least lengths (in code points) of the base spans. Letters of the
# first pattern's key may be of either case.
ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
# A run of one class of signs is matched whole, so its least length stands in the pattern: a text is
# full of short runs of a-f.
BASE = [("assign", ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]{16,}", 0, 20), ("hex", "[0-9a-f]{24,}", 0, 24)]

# Strings that may be keys: the longest runs over each of these alphabets, so that a key counts by itself
# behind a name and "=", in a path, or between words joined by signs. Padding belongs to a key if nothing follows.
RUNS = ["A-Za-z0-9+/", "A-Za-z0-9_-", "A-Za-z0-9"]
PADDING = "(?:={1,6}(?![A-Za-z0-9+/_=-]))?"
# Encodings by their alphabets, narrowest first; a string has the first one that holds it.
ENCODINGS = [
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("upper36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
]
# Text-like strings repeat symbols: two of them agree with at least this chance (letters of the usual
# European languages: 0.065 to 0.08), and at least so many times as often as random ones.
TEXT_AGREES = 0.06
TEXT_RATIO = 1.6
# Coefficients of the usual rational approximation of the normal tail (error below 1e-7).
NORMAL = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]
# Fixed values of the text null: letters' shares by 1,000 in usual prose, which count as PRIOR pairs behind
# each letter before any pair of the documents; the share of letters that follow no habit (abbreviations);
# the largest share of symbols that begin another class (upper, lower, digit, sign) in identifiers.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
LETTER_SHARES = [82, 15, 28, 43, 127, 22, 20, 61, 70, 1.5, 7.7, 40, 24, 67, 75, 19, 0.95, 60, 63, 91, 28, 9.8, 24, 1.5, 20, 0.74]
PRIOR = 50
HABITLESS = 0.2
MOST_CHANGES = 0.25
BIN = 0.05
BINS = 400
PIECE = 256
SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def upper_tail(z: Column) -> Column:
    """P(standard normal > z)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (NORMAL[0] + t * (NORMAL[1] + t * (NORMAL[2] + t * (NORMAL[3] + t * NORMAL[4]))))
    tail = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _pieces(values: Column) -> Column:
    """An array cut into arrays of ``PIECE``. Folds that grow an array copy it at every step, so they run over pieces."""
    last = F.greatest(F.ceil(F.size(values) / PIECE).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(values, i * PIECE + 1, F.lit(PIECE)))


def _given(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def _spans(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, hit>>`` of the leftmost non-overlapping matches, in code points.

    The text is split at the matches; the lengths of the pieces between and of the matches add up to
    the positions: first over pieces of the list of matches, then inside each piece.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    steps = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))
    empty = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    width = lambda x: x["gap"] + F.length(x["hit"])

    def upto(sums, piece):
        here = F.element_at(sums, -1) + F.aggregate(piece, F.lit(0), lambda acc, x: acc + width(x))
        return F.array_append(sums, here)

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["hit"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("hit"))).alias("out"))

    def placed(pieces):
        starts = F.aggregate(pieces, F.array(F.lit(0)), upto)
        both = F.arrays_zip(pieces.alias("piece"), F.slice(starts, F.lit(1), F.size(pieces)).alias("at"))
        return F.flatten(F.transform(both, lambda b: F.aggregate(b["piece"], F.struct(b["at"].alias("at"), empty.alias("out")), step, lambda acc: acc["out"])))

    found = _given(_given(steps, _pieces), placed)
    return F.when(text.rlike(pattern), found).otherwise(empty)


def _outside(runs: Column, base: Column) -> Column:
    """The runs that overlap no span of ``base``: sorted, piece by piece against the base spans in the piece's range."""
    def piece(p):
        span = F.struct(F.array_min(F.transform(p, lambda r: r["start"])).alias("low"), F.array_max(F.transform(p, lambda r: r["end"])).alias("high"))
        near = _given(span, lambda s: F.filter(base, lambda b: (b["start"] < s["high"]) & (s["low"] < b["end"])))
        return _given(near, lambda n: F.filter(p, lambda r: ~F.exists(n, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))))

    kept = _given(F.array_sort(runs), lambda sorted_: F.flatten(F.transform(_pieces(sorted_), piece)))
    return F.when((F.size(runs) == 0) | (F.size(base) == 0), runs).otherwise(kept)


def _base_spans(text: Column) -> Column:
    """All base spans: ``array<struct<start, rank, kind, end>>`` by start, then kind."""
    def of(rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
        value = (lambda hit: F.regexp_extract(hit, pattern, group)) if group else (lambda hit: hit)
        kept = F.filter(_spans(text, pattern), lambda s: F.length(value(s["hit"])) >= least)
        return F.transform(kept, lambda s: F.struct(s["start"], F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"]))

    parts = [of(rank, *base) for rank, base in enumerate(BASE)]
    return F.array_sort(F.concat(*parts))


def _candidates(text: Column, least: int) -> Column:
    """Longest runs of at least ``least`` signs of each alphabet in RUNS, with their padding: distinct spans."""
    found = [_spans(text, f"[{signs}]{{{least},}}{PADDING}") for signs in RUNS]
    return _given(F.array_sort(F.concat(*found)), lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1))))


def _joined(spans: DataFrame) -> DataFrame:
    """``(row, found)`` of ``spans(row, start, end)``: spans of kind ``random`` by start, overlapping ones as one, as a key
    may lie in several runs. A span that starts behind the end of all earlier ones of its row begins a new one."""
    earlier = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = F.coalesce(F.max("end").over(earlier) <= F.col("start"), F.lit(True)).cast("int")
    islands = spans.withColumn("begins", begins).withColumn("island", F.sum("begins").over(upto))
    whole = islands.groupBy("row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    one = F.struct("start", F.lit(len(BASE)).alias("rank"), F.lit("random").alias("kind"), "end")
    return whole.groupBy("row").agg(F.array_sort(F.collect_list(one)).alias("found"))


def battery(token: Column, alphabet: Column) -> Column:
    """``struct<n, k, chi_z, runs_z, serial_z, text_p>`` of a token over its alphabet.

    chi_z: the chi-squared statistic of uniform symbols as a normal score (cube-root transform).
    runs_z: number of runs above and below the alphabet's middle against its mean and deviation.
    serial_z: correlation of neighbouring symbol numbers, times the root of the length.
    text_p: chance that a text-like string (symbols agreeing as often as TEXT_AGREES and TEXT_RATIO
    say, the statistic's deviation as for random ones, scaled alike) spreads its symbols this evenly.
    """
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(alphabet, c).cast("double"))
    k = F.length(alphabet).cast("double")
    given = F.struct(codes.alias("codes"), k.alias("k"))

    def scores(x):
        codes, k = x["codes"], x["k"]
        n = F.size(codes).cast("double")
        ordered = F.array_sort(codes)
        zero = F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
        # the sum of squared counts grows by 2 * count + 1 with every further equal symbol
        squares = F.aggregate(ordered, zero, lambda a, c: F.when(a["last"] == c, F.struct(c.alias("last"), (a["run"] + 1).alias("run"), (a["sum"] + 2 * a["run"] + 1).alias("sum"))).otherwise(F.struct(c.alias("last"), F.lit(1.0).alias("run"), (a["sum"] + 1).alias("sum"))))["sum"]
        chi = squares * k / n - n
        df = k - 1
        chi_z = (F.pow(chi / df, 1.0 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        middle = (k + 1) / 2
        pairs = F.arrays_zip(F.slice(codes, F.lit(1), F.greatest(F.size(codes) - 1, F.lit(0))).alias("a"), F.slice(codes, F.lit(2), F.greatest(F.size(codes) - 1, F.lit(0))).alias("b"))
        runs = 1 + F.size(F.filter(pairs, lambda p: (p["a"] > middle) != (p["b"] > middle))).cast("double")
        high = F.size(F.filter(codes, lambda c: c > middle)).cast("double")
        mean = 2 * high * (n - high) / n + 1
        spread = (mean - 1) * (mean - 2) / F.greatest(n - 1, F.lit(1.0))
        runs_z = F.when(spread > 0, (runs - mean) / F.sqrt(spread)).otherwise(F.lit(99.0))
        total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + f(p))
        cov, var = total(lambda p: (p["a"] - middle) * (p["b"] - middle)), (k * k - 1) / 12
        serial_z = cov / var / F.sqrt(F.greatest(n - 1, F.lit(1.0)))
        ratio = F.greatest(TEXT_AGREES * k, F.lit(TEXT_RATIO))
        expected = (ratio - 1) * (n - 1) + df
        text_p = 1 - upper_tail((chi - expected) / (F.sqrt(2 * df) * ratio))
        return F.struct(n.alias("n"), k.alias("k"), chi_z.alias("chi_z"), runs_z.alias("runs_z"), serial_z.alias("serial_z"), text_p.alias("text_p"))

    return F.transform(F.array(given), scores)[0]


def letter_pairs(docs: DataFrame, least: int) -> list[float]:
    """log10 of the chance of each letter behind each letter (26 x 26), then behind none (26), cases folded.

    Pairs are counted over all documents, outside runs that are long enough to be keys: every document's
    words meet by word first, so what is cut into pairs is each distinct word once.
    """
    text = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), f"[A-Za-z0-9+/_-]{{{least},}}", " ")
    words = docs.select(F.explode(F.split(F.lower(text), "[^a-z]+")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("word != ''")
    cut = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.when(i == 1, F.substring("word", 1, 1)).otherwise(F.col("word").substr(i - 1, F.lit(2))))
    rows = words.select("n", F.explode(cut).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n")).collect()  # 702 at most
    counts = [[0.0] * 26 for _ in range(27)]
    for r in rows:
        before = LETTERS.index(r["pair"][0]) if len(r["pair"]) == 2 else 26
        counts[before][LETTERS.index(r["pair"][-1])] += r["n"]
    out = []
    for row in counts:
        chance = [(n + PRIOR * f / sum(LETTER_SHARES)) / (sum(row) + PRIOR) for n, f in zip(row, LETTER_SHARES)]
        out += [math.log10((1 - HABITLESS) * c + HABITLESS / 26) for c in chance]
    return out


def pair_p(token: Column, alphabet: Column, logs: Column) -> Column:
    """log10 of a bound on the chance that text or an identifier looks as random as the token, at most 0.

    The bound is the token's chance under the null over its chance as independent uniform symbols; by
    Markov's inequality the ratio is a p-value at any length. Null: letters follow each other by ``logs``
    (see letter_pairs); digits and signs are even; a symbol begins another class than the last one's
    with the share seen in the token, up to MOST_CHANGES; lower case behind upper case begins none.
    """
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    has = lambda signs: alphabet.rlike(signs)
    both = has("[a-z]") & has("[A-Z]")
    classes = sum(has(signs).cast("double") for signs in ("[a-z]", "[A-Z]", "[0-9]", "[+/_-]"))
    given = F.struct(chars.alias("chars"), both.alias("both"), F.greatest(classes - 1, F.lit(1.0)).alias("others"), F.length(alphabet).cast("double").alias("k"), logs.alias("logs"))

    def score(x):
        n = F.size(x["chars"]).cast("double")
        zero = F.struct(F.lit(26).alias("last"), F.lit("").alias("kind"), F.lit(0.0).alias("changes"), F.lit(0.0).alias("halves"), F.lit(0.0).alias("sum"))

        def step(a, c):
            kind = F.when(c.rlike("[a-z]"), "l").when(c.rlike("[A-Z]"), "u").when(c.rlike("[0-9]"), "d").otherwise("s")
            letter = F.instr(F.lit(LETTERS), F.lower(c)) - 1
            is_letter = letter >= 0
            half = x["both"] & (a["kind"] == "u") & is_letter
            change = (a["kind"] != "") & (a["kind"] != kind) & ~((a["kind"] == "u") & (kind == "l"))
            gain = F.when(is_letter, F.get(x["logs"], a["last"] * 26 + letter)).when(kind == "d", F.lit(-1.0)).otherwise(F.lit(-math.log10(2)))
            return F.struct(
                F.when(is_letter, letter).otherwise(F.lit(26)).alias("last"), kind.alias("kind"), (a["changes"] + change.cast("double")).alias("changes"),
                (a["halves"] + half.cast("double")).alias("halves"), (a["sum"] + gain).alias("sum"),
            )

        def end(a):
            share = F.least(a["changes"] / F.greatest(n - 1, F.lit(1.0)), F.lit(MOST_CHANGES))
            changed = F.when(a["changes"] > 0, a["changes"] * F.log10(F.greatest(share, F.lit(1e-9)) / x["others"])).otherwise(F.lit(0.0))
            kept = (n - 1 - a["changes"]) * F.log10(1 - share)
            return F.least(a["sum"] + changed + kept - a["halves"] * math.log10(2) + n * F.log10(x["k"]), F.lit(0.0))

        return F.aggregate(x["chars"], zero, step, end)

    return F.transform(F.array(given), score)[0]


def _encoding(token: Column) -> Column:
    """Name and alphabet of the narrowest encoding that holds the token (padding signs aside)."""
    bare = F.regexp_replace(token, "=+$", "")
    out = F.lit(None).cast("struct<name:string,alphabet:string>")
    for name, alphabet in reversed(ENCODINGS):
        inside = "^[" + alphabet.replace("-", "\\-") + "]+$"
        out = F.when(bare.rlike(inside), F.struct(F.lit(name).alias("name"), F.lit(alphabet).alias("alphabet"))).otherwise(out)
    return out


def _random_enough(t: Column, level: float) -> Column:
    """No test of the battery rejects uniform independent symbols at ``level`` (shared by three)."""
    limit = NormalDist().inv_cdf(1 - level / 6)
    return (F.abs(t["chi_z"]) <= limit) & (F.abs(t["runs_z"]) <= limit) & (F.abs(t["serial_z"]) <= limit)


def scan_secrets(docs: DataFrame, false_share: float = 0.05, level: float = 0.01, least: int = 20) -> DataFrame:
    """``(doc_id, base, found)`` for every row of ``docs(doc_id, text, ...)``.

    ``base``: spans of the fixed patterns, ``found``: spans of kind ``random`` that overlap no base
    span; both ``array<struct<start, rank, kind, end>>`` in code points, end exclusive, by start.

    Candidates are the longest runs of at least ``least`` signs over each alphabet in RUNS, whatever
    stands around them; found spans that overlap are given as one. Each candidate has an encoding
    inferred from its alphabet and a battery of tests: symbols as even as chance (chi-squared), runs,
    serial correlation. A candidate that fails none of them at ``level`` is tested against being text
    or an identifier: by its changes of class and its pairs of letters against those of all documents
    (pair_p), digits alone by how evenly they spread (text_p of the battery). These p-values
    go through step-up false-discovery control at ``false_share``, apart by encoding
    and length (by doublings), over the distinct candidates of all documents: short strings, which
    hold less evidence, get their own cut. P-values are binned in steps of 0.05 of their decimal
    logarithm, rounding up, so the control is at least as strict as on exact values.

    Texts are read twice (pairs of letters, candidates); words' counts and candidates are shuffled. Null and empty texts have no spans. Whole
    texts count, however long. Repeated rows give a row each; extra columns are ignored; an empty
    table gives an empty table.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = materialize(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", _base_spans(text).alias("base"), _candidates(text, least).alias("runs")))
    read = read.withColumn("runs", _outside(F.col("runs"), F.col("base")))

    bare = F.regexp_replace("token", "=+$", "")
    tokens = read.select(F.explode("runs.hit").alias("token")).distinct().withColumn("enc", _encoding(F.col("token"))).where("enc is not null")
    pairs = docs.sparkSession.createDataFrame([(letter_pairs(docs, least),)], "logs array<double>")
    tokens = tokens.crossJoin(F.broadcast(pairs))  # one row
    tested = tokens.select("token", F.col("enc.name").alias("encoding"), battery(bare, F.col("enc.alphabet")).alias("t"), pair_p(bare, F.col("enc.alphabet"), F.col("logs")).alias("pair_p"))
    passed = tested.where((F.col("t.n") >= least) & _random_enough(F.col("t"), level))
    stratum = F.floor(F.log2(F.col("t.n"))).cast("int")
    log_p = F.when(F.col("encoding") == "decimal", F.log10(F.greatest(F.col("t.text_p"), F.lit(1e-30)))).otherwise(F.col("pair_p"))
    step = F.least(F.floor(-log_p / BIN), F.lit(BINS)).cast("int")
    passed = materialize(passed.select("token", "encoding", stratum.alias("doubling"), step.alias("bin")))
    counts = passed.groupBy("encoding", "doubling", "bin").agg(F.count("*").alias("m"))
    # the counts have at most 9 encodings x 31 lengths x 401 bins
    one = counts.groupBy("encoding", "doubling").agg(F.sum("m").alias("total"), F.collect_list(F.struct("bin", "m")).alias("bins"))
    below = lambda b: F.aggregate(F.filter("bins", lambda x: x["bin"] >= b), F.lit(0).cast("long"), lambda acc, x: acc + x["m"])
    good = F.filter(F.transform("bins", lambda x: x["bin"]), lambda b: F.pow(F.lit(10.0), -b * BIN) * F.col("total") <= false_share * below(b))
    cuts = one.select("encoding", "doubling", F.array_min(good).alias("cut")).where("cut is not null")
    secret = passed.join(F.broadcast(cuts), ["encoding", "doubling"]).where("bin >= cut").select("token")

    spans = read.select("row", F.inline("runs")).withColumnRenamed("hit", "token").join(secret, "token")
    found = _joined(spans.select("row", "start", "end"))
    none = F.array().cast(SPANS)
    return read.join(found, "row", "left").select("doc_id", "base", F.coalesce("found", none).alias("found"))


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
