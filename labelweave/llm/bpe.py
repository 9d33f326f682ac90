"""Byte-level BPE over a distinct-word table: each word is encoded once, ids go back by position."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labelweave.llm import common
from labelweave.session import materialize

# The pattern that cuts text into words before merging, with Unicode white space.
WORD = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""

# The same for ASCII text, letters first: no other alternative can start where letters can.
ASCII_WORD = r""" ?[A-Za-z]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""

HEAD = 1_000_000
HEAD_TEXT_BYTES = 64 << 20
PART_ROWS = 250


def byte_of_sign() -> dict[str, int]:
    """The vocabulary's sign for every byte: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """The tokenizer file: its text travels with tasks (its size is fixed); parts are made on use, in tasks.

    The library's objects take much memory, and a driver that has made them keeps most of it.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.json = f.read()

    def tokenizer(self) -> Tokenizer:
        out = Tokenizer.from_str(self.json)
        out.no_truncation()
        out.no_padding()
        return out

    def pieces(self, spark: SparkSession) -> tuple[pa.Array, list[str]]:
        """The id-to-piece table: every id's bytes, by id, empty where an id has no piece; and the special strings, longest first."""

        def make(batches):
            for _ in batches:
                model, signs = self.tokenizer(), byte_of_sign()
                special = {i: t.content for i, t in model.get_added_tokens_decoder().items()}
                known = {i: special[i].encode() if i in special else bytes(signs[c] for c in piece) for piece, i in model.get_vocab(with_added_tokens=True).items()}
                ids = range(max(known, default=-1) + 1)
                columns = [pa.array(ids, pa.int32()), pa.array([known.get(i, b"") for i in ids], pa.binary()), pa.array([i in special for i in ids], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "special"])

        made = spark.range(0, 1, 1, 1).mapInArrow(make, "id int, piece binary, special boolean").toArrow().sort_by("id")
        special = made.column("piece").filter(made.column("special")).to_pylist()
        return _one_array(made.column("piece")), sorted((s.decode() for s in special), key=len, reverse=True)


def _one_array(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays([pa.array([], column.type), *column.chunks])


def cutter(special: list[str]):
    """Function from a text to its words; a special string is a word of its own."""
    any_text, ascii_text = regex.compile(WORD).findall, re.compile(ASCII_WORD).findall

    def find(text: str) -> list[str]:
        return ascii_text(text) if text.isascii() else any_text(text)

    if not special:
        return find
    apart = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split

    def cut(text: str) -> list[str]:
        if not any(s in text for s in special):
            return find(text)
        return [w for i, part in enumerate(apart(text)) for w in ([part] if i % 2 else find(part))]

    return cut


def head_words(docs: DataFrame, vocabulary: Vocabulary, special: list[str], limit: int) -> pa.Table:
    """``(word, ids)`` of words that are likely to be met again, from a random sample of at most about 64 MiB of text.

    Only speed depends on this list: it says which words need no row of their own. In a large table even
    a word that the sample holds once is met about as often as the table is larger.
    """
    size = docs.agg(F.sum(F.octet_length("_text"))).head()[0] or 0
    part = docs if size <= HEAD_TEXT_BYTES else docs.sample(HEAD_TEXT_BYTES / size, 11)

    def count(batches):
        cut, tally = cutter(special), {}
        for batch in parts(batches):
            for text in batch.column("_text").to_pylist():
                for word in cut(text or ""):
                    tally[word] = tally.get(word, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(tally.keys(), pa.string()), pa.array(tally.values(), pa.int64())], ["word", "n"])

    counted = part.select("_text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))

    def encode(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        model = vocabulary.tokenizer()
        for part in parts(batches, 1000):  # a thousand words are objects at a time
            made = model.encode_batch_fast(part.column("word").to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([part.column("word"), part.column("n"), pa.array([one.ids for one in made], pa.list_(pa.int32()))], ["word", "n", "ids"])

    listed = common.frequent(materialize(counted), limit).mapInArrow(encode, "word string, n long, ids array<int>")
    return listed.toArrow().sort_by([("n", "descending"), ("word", "ascending")]).select(["word", "ids"])


def parts(batches, rows: int = PART_ROWS):
    """Small pieces of the batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    pa.default_memory_pool().release_unused()  # the worker process goes on with other stages


def _narrow(ids: list[int]) -> bytes:
    """Ids of one word on their way: two bytes each, or four after a zero byte."""
    return np.array(ids, "<u2").tobytes() if max(ids, default=0) < 1 << 16 else b"\0" + np.array(ids, "<u4").tobytes()


def _wide(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed[1:], "<u4") if len(packed) % 2 else np.frombuffer(packed, "<u2")


def _planes(codes: np.ndarray, press: zstandard.ZstdCompressor) -> bytes:
    """Packed word numbers: all lowest bytes, then the middle ones, then the highest, compressed."""
    raw = codes.astype("<u4").view(np.uint8).reshape(-1, 4)
    return press.compress(raw[:, :3].T.tobytes())


def _codes(packed: bytes) -> np.ndarray:
    low, mid, high = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(3, -1).astype(np.int64)
    return low | mid << 8 | high << 16


class WordList:
    """The frequent words, found by hash, and the ids of each, in flat arrays: some 30 bytes a word in every worker."""

    def __init__(self, listed: pa.Table):
        words, ids = _one_array(listed.column("word")), _one_array(listed.column("ids"))
        self.words, self.size = words, len(words)
        self.ids = ids.flatten().to_numpy(zero_copy_only=False).astype(np.uint32)
        self.ends = np.append(0, np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))).astype(np.uint32)
        hashes = self.hashes(self.words)
        self.order = np.argsort(hashes).astype(np.uint32)
        self.sorted = hashes[self.order]

    @staticmethod
    def hashes(words: pa.Array) -> np.ndarray:
        if not len(words):
            return np.zeros(0, np.uint64)
        _, offsets, data = words.buffers()
        ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data, out = np.frombuffer(data or b"", np.uint8), []
        for start in range(0, len(words), 1 << 16):
            own = ends[start : start + (1 << 16) + 1]
            out.append(common.span_hashes(data[own[0] : own[-1]], own[:-1] - own[0], own[1:] - own[0]))
        return np.concatenate(out)

    def numbers(self, found: pa.Array) -> np.ndarray:
        """Every word's place in the list; ``size`` for a word that is not in it. A hash only says where to look."""
        if not self.size or not len(found):
            return np.full(len(found), self.size, np.int64)
        place = self.order[np.minimum(np.searchsorted(self.sorted, self.hashes(found)), self.size - 1)].astype(np.int64)
        same = pc.equal(found, self.words.take(pa.array(place))).to_numpy(zero_copy_only=False)
        return np.where(same, place, self.size)

    def spell(self, codes: np.ndarray, fills: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a run of word numbers, one after another, and how many each word has; ``fills`` are the ids of unlisted ones in turn."""
        gap = codes == self.size
        starts, counts = np.empty(len(codes), np.int64), np.empty(len(codes), np.int64)
        starts[~gap] = self.ends[codes[~gap]]
        counts[~gap] = self.ends[codes[~gap] + 1] - self.ends[codes[~gap]]
        own = np.array([len(f) for f in fills], np.int64)
        starts[gap], counts[gap] = len(self.ids) + np.cumsum(own) - own, own
        source = np.concatenate([self.ids, *fills]) if fills else self.ids
        at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return source[at].astype("<u4"), counts


def cut_part(texts: list[str | None], cut) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts in one array, and how many each text has."""
    flat, counts = [], []
    for text in texts:
        found = cut(text or "")
        flat += found
        counts.append(len(found))
    return pa.array(flat, pa.string()), np.array(counts, np.int64)


def encode_rows(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``(_row, _at, ids)`` for ``(_row, _at, word)``: rows are brought together and sorted by
    word, so each task encodes a word once and remembers no more than a piece of a batch; ids packed by
    ``_narrow``. A very frequent word may be split over tasks."""

    def encode(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        model, last = vocabulary.tokenizer(), {}
        for part in parts(batches, 2000):
            words = part.column("word").to_pylist()
            new = list(set(words).difference(last))
            made = model.encode_batch_fast(new, add_special_tokens=False)
            table = last | {word: _narrow(one.ids) for word, one in zip(new, made)}
            yield pa.RecordBatch.from_arrays([part.column("_row"), part.column("_at"), pa.array([table[w] for w in words], pa.binary())], ["_row", "_at", "ids"])
            last = {w: table[w] for w in words[-1:]}

    return rows.hint("rebalance", F.col("word")).sortWithinPartitions("word").mapInArrow(encode, "_row long, _at long, ids binary")


def _joined(ends: np.ndarray, data) -> pa.Array:
    """A binary column whose rows lie one after another in ``data``."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def encode_decode(docs: DataFrame, path: str, head: int = HEAD) -> DataFrame:
    """Columns of ``docs(text, ...)`` plus ``n_tokens, ids (binary), decoded (binary)`` as the tokenizer file says.

    ``ids`` are little-endian unsigned 32-bit integers, without added special tokens; a special
    string inside a text is its special id, as the library has it by default. ``decoded`` is the
    UTF-8 text that the ids' pieces give (malformed parts as U+FFFD).

    1. Texts are cut into words inside the scan. A word of the frequent list (at most ``head``, under
       2**24) becomes a 3-byte number; any other word becomes a row (row key, position, word).
    2. The rows are shuffled by word; each distinct word is encoded once (a very frequent one once per
       task). The frequent words are encoded once beforehand.
    3. The ids are gathered by document and fill the gaps by position.
    4. Ids become pieces by a join with the id-to-piece table, which has the vocabulary's size.

    The scan runs twice, for the words and for the numbers, rather than being stored. A row is known
    in both by 80 bits of hash over its columns (64 to meet by, 16 to tell apart), so it does not matter how either scan is split;
    a document whose gaps and fills differ in number raises. Only rare words are shuffled as rows.
    Null and empty texts give no ids and the empty text. Very long texts are one row throughout.
    Repeated rows are encoded each. Columns named like the added ones are replaced; an empty table
    gives an empty table.
    """
    vocabulary, docs = Vocabulary(path), common.small_batches(docs)
    plain = docs.drop("n_tokens", "ids", "decoded")
    kept = [c for c in plain.columns if c != "text"]
    texts = plain.select(*kept, F.col("text").cast("string").alias("_text"))
    pieces, special = vocabulary.pieces(docs.sparkSession)
    # one copy of the list and of the pieces for all stages; their size is fixed by ``head`` and the vocabulary
    shared = docs.sparkSession.sparkContext.broadcast((WordList(head_words(texts, vocabulary, special, head)), pieces))

    def cut_rare(batches):
        cut, (frequent, _) = cutter(special), shared.value
        for part in parts(batches):
            words, counts = cut_part(part.column("_text").to_pylist(), cut)
            gaps = np.flatnonzero(frequent.numbers(words) == frequent.size)
            row = np.repeat(np.arange(len(counts)), counts)[gaps]
            at = gaps - (np.cumsum(counts) - counts)[row] | part.column("_tag").to_numpy().astype(np.int64)[row] << 32
            yield pa.RecordBatch.from_arrays([part.column("_row").take(pa.array(row)), pa.array(at, pa.int64()), words.take(pa.array(gaps))], ["_row", "_at", "word"])

    def number_head(batches):
        cut, press, (frequent, _) = cutter(special), zstandard.ZstdCompressor(level=6), shared.value
        for part in parts(batches):
            words, counts = cut_part(part.column("_text").to_pylist(), cut)
            numbers = np.split(frequent.numbers(words), np.cumsum(counts)[:-1])
            names = [c for c in part.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array([_planes(n, press) for n in numbers], pa.binary())], [*names, "_codes"])

    hashed = [F.col(c) for c, t in texts.dtypes if "map<" not in t and "variant" not in t]
    keyed = texts.select(F.xxhash64(*hashed).alias("_row"), F.shiftright(F.xxhash64(F.lit("tag"), *hashed), 48).cast("short").alias("_tag"), *kept, "_text")
    rare = keyed.select("_row", "_tag", "_text").mapInArrow(cut_rare, "_row long, _at long, word string")
    # the rows of a document are spread over all tasks: they travel as they are, and meet once
    back = encode_rows(rare, vocabulary).repartition("_row")
    filled = back.groupBy("_row").agg(F.array_sort(F.collect_set(F.struct("_at", "ids"))).alias("_fill"))
    coded = keyed.mapInArrow(number_head, keyed.drop("_text").withColumn("_codes", F.lit(b"")).schema)
    whole = coded.join(filled, "_row", "left").withColumns({"_at": F.col("_fill._at"), "_fill": F.col("_fill.ids")})

    def join_back(batches):
        frequent, pieces = shared.value
        for part in parts(batches):
            codes = [_codes(c) for c in part.column("_codes").to_pylist()]
            tags = part.column("_tag").to_pylist()
            fills = [
                [x for a, x in zip(at or (), fill or ()) if a >> 32 == tag] for tag, at, fill in zip(tags, part.column("_at").to_pylist(), part.column("_fill").to_pylist())
            ]
            if any(int((c == frequent.size).sum()) != len(f) for c, f in zip(codes, fills)):
                raise RuntimeError("the two scans of a document found different words; its rows are not stable")
            ids, counts = frequent.spell(np.concatenate(codes), [_wide(x) for f in fills for x in f])
            ends = np.append(0, np.cumsum(counts))[np.append(0, np.cumsum([len(c) for c in codes]))]
            spelled = pieces.take(pa.array(ids, pa.uint32()))
            _, offsets, data = spelled.buffers()
            edges = np.frombuffer(offsets, np.int32)[ends] if len(ids) else np.zeros(len(ends), np.int32)
            decoded = [data[a:b].to_pybytes().decode("utf-8", "replace").encode() if b > a else b"" for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            names = [c for c in part.schema.names if c not in ("_codes", "_fill", "_at", "_tag")]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(np.diff(ends), pa.int64()), _joined(ends * 4, ids), pa.array(decoded, pa.binary())], [*names, "n_tokens", "ids", "decoded"])

    out = plain.select(*kept, F.lit(0).cast("long").alias("n_tokens"), F.lit(b"").alias("ids"), F.lit(b"").alias("decoded")).schema
    return whole.select(*kept, "_tag", "_codes", "_at", "_fill").mapInArrow(join_back, out)
