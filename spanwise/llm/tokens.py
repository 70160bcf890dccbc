"""Token ids as Parquet files made for selective reads.

``write_tokens`` encodes whole texts with the tokenizers library and writes one row per document: ``doc_id``,
``part`` (the file), ``start_in_part`` (ids of the part's documents before it), ``n_tokens`` and ``token_ids``,
a list column. Rows ascend by doc_id through the files and within each. Spark's own Parquet writer is told how to lay
them out: ids fit a dictionary of vocabulary size and so take 16 bits or fewer before compression; the ascending
number columns take delta encoding (format version 2); row groups and pages are bounded, so that page indexes,
which the writer always adds, let a reader with a filter on doc_id skip pages, and one that wants
counts alone never touches the ids.

Texts are cut at white space, which the vocabulary drops, and the pieces, where they keep to Latin-1, into words in lower case, as the
vocabulary's own pattern has them. A slice's distinct pieces and words are found by Arrow's dictionaries; the library encodes
distinct words, once as long as a worker's cache of ``CACHE_WORDS`` and ``CACHE_BYTES`` holds them, and ids of words, pieces and texts are gathered
from each other as arrays.

Results: a null text is empty and has the end id alone. Rows without doc_id come first, copies of an id stand together,
ordered by text. Other columns play no part. An empty table writes no row and reads back as an empty frame.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanwise.llm.bpe import LATIN, WHITE, load_vocabulary
from spanwise.llm.common import pieces, slices, small, stored, text_bytes, texts_of

PART_BYTES = 32 << 20
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 512
CACHE_WORDS, CACHE_BYTES = 600_000, 64 << 20
BATCH_WORDS, COMMA_WORDS = 10_000, 100
SLICE = 2 << 20
END_ID = 1

LAYOUT = {
    "compression": "snappy",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#start_in_part": "false",
}

_PIECES = re.compile(f"[^{WHITE}]+")
_LETTERS, _NUMBERS, _BLANKS = LATIN
_LATIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_BLANKS}{_LETTERS}{_NUMBERS}]+")
# Between two pieces: a line break is in none.
_PIECE_WORDS = re.compile(_LATIN_WORDS.pattern + "|\n")


def _arrow_blank(c: str) -> bool:
    return len(pc.utf8_split_whitespace(pa.array([f"a{c}b"]))[0]) > 1


# What is a blank to Arrow alone or to the vocabulary alone needs the general way.
_ODD = bytes(c for c in range(256) if _arrow_blank(chr(c)) != bool(re.match(f"[{WHITE}]", chr(c))))


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _lines(texts: pa.Array) -> str:
    """The texts as the lines of one."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts)
    return pc.binary_join(whole, "\n")[0].as_py()


class WordIds:
    """Ids of words: a bounded cache that, when full, keeps the words that came again. All of it is flat arrays."""

    def __init__(self, library: Tokenizer, limit: int = CACHE_WORDS) -> None:
        self._library, self._limit = library, limit
        self._comma = library.encode(",", add_special_tokens=False).ids
        self.words = pa.array([], pa.string())
        self.flat = np.empty(0, np.int32)
        self._starts, self._sizes, self._again = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def find(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``flat`` the ids of distinct words begin, and how many they are."""
        if len(self.words) + len(words) > self._limit or self.flat.nbytes + self.words.nbytes > CACHE_BYTES:
            self._shrink()
        rows = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        new = rows < 0
        self._again[rows[~new]] = True
        rows[new] = len(self.words) + np.arange(new.sum())
        self._learn(words.filter(pa.array(new)))
        return self._starts[rows], self._sizes[rows]

    def _learn(self, words: pa.Array) -> None:
        flat, sizes = [self.flat], []
        for i in range(0, len(words), BATCH_WORDS):
            ids, each = self._encoded(words.slice(i, BATCH_WORDS).to_pylist())
            flat.append(ids)
            sizes.append(each)
        sizes = np.concatenate([np.empty(0, np.int64), *sizes])
        starts = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate(flat)
        self._starts, self._sizes = np.concatenate([self._starts, starts]), np.concatenate([self._sizes, sizes])
        self._again = np.concatenate([self._again, np.zeros(len(words), bool)])
        self.words = pa.concat_arrays([self.words, words])

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each has.

        Words without a comma go as one text with a comma between each two, whose id is that of nothing else.
        """
        encode = self._library.encode_batch_fast
        if len(self._comma) == 1 and not any("," in w for w in words):
            ids = np.array(encode([" , ".join(words)], add_special_tokens=False)[0].ids, np.int32)
            commas = np.flatnonzero(ids == self._comma[0])
            if len(commas) == len(words) - 1:
                bounds = np.concatenate([[-1], commas, [len(ids)]])
                return np.delete(ids, commas), np.diff(bounds) - 1
        if len(words) > COMMA_WORDS:  # look for those with a comma apart
            parts = [self._encoded(words[i:i + COMMA_WORDS]) for i in range(0, len(words), COMMA_WORDS)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        ids = [e.ids for e in encode(words, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _shrink(self) -> None:
        # Long words are not kept in mind.
        kept = self._again & (pc.binary_length(self.words).to_numpy() <= 64)
        if kept.sum() > self._limit * 3 // 4:
            kept[:] = False
        self.words = self.words.filter(pa.array(kept))
        self.flat = gathered(self.flat, self._starts[kept], self._sizes[kept])
        self._sizes = self._sizes[kept]
        self._starts = np.cumsum(self._sizes) - self._sizes
        self._again = np.zeros(len(self.words), bool)


class PieceEncoder:
    """The library's ids of texts, by distinct pieces between white space and distinct words in these."""

    def __init__(self, content: bytes):
        # One thread for each task: the scheduler counts on it.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_str(content.decode())
        self.library.no_truncation()
        self.library.no_padding()
        self.words = WordIds(self.library)

    @staticmethod
    def simple(text: str) -> bool:
        """Whether Arrow cuts and lowers the text as the vocabulary does. Names of special tokens stay whole."""
        try:
            octets = text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return "<|" not in text and len(octets.translate(None, _ODD)) == len(octets)

    @staticmethod
    def words_of(piece: str) -> list[str]:
        """The words of a piece that the vocabulary's pattern tells apart; the piece itself beyond Latin-1."""
        try:
            piece.encode("latin-1")
        except UnicodeEncodeError:
            return [piece]
        return [piece] if "<|" in piece else _LATIN_WORDS.findall(piece.lower())

    def encode(self, texts: list[str]) -> pa.ListArray:
        """The ids of each text."""
        simple = np.fromiter(map(self.simple, texts), bool, len(texts))
        cut = pc.utf8_split_whitespace(pc.utf8_lower(pa.array([t for t, s in zip(texts, simple) if s], pa.string())))
        # A leading or trailing blank leaves an empty piece, which has no words.
        first = self._gather(cut, lambda pieces: _PIECE_WORDS.findall(_lines(pieces)))
        if simple.all():
            return first
        other = pa.array([_PIECES.findall(t) for t, s in zip(texts, simple) if not s], pa.list_(pa.string()))
        rest = self._gather(other, lambda pieces: [w for p in pieces.to_pylist() for w in ("\n", *self.words_of(p))][1:])
        place = np.empty(len(texts), np.int64)
        place[np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)])] = np.arange(len(texts))
        return pa.concat_arrays([first, rest]).take(pa.array(place))

    def _gather(self, texts: pa.ListArray, cut) -> pa.ListArray:
        """Ids of lists of pieces; ``cut`` gives the words of an array of distinct pieces with a line break between pieces."""
        ends = texts.offsets.to_numpy()
        pieces = texts.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        distinct = pieces.dictionary
        if not len(distinct):
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, np.int32)), pa.array([], pa.int32()))
        words = pa.array(cut(distinct), pa.string()).dictionary_encode()
        starts, sizes = self.words.find(words.dictionary)
        line_break = pc.index(words.dictionary, "\n").as_py()
        if line_break >= 0:
            sizes[line_break] = 0
        word = words.indices.to_numpy()
        in_pieces = gathered(self.words.flat, starts[word], sizes[word])
        # The ids of a piece lie between two line breaks, which have none themselves.
        breaks = np.flatnonzero(word == line_break)
        totals = np.concatenate([[0], np.cumsum(sizes[word])])
        bounds = totals[np.concatenate([[0], breaks, [len(word)]])]
        piece = pieces.indices.to_numpy()
        found = gathered(in_pieces, bounds[piece], np.diff(bounds)[piece])
        totals = np.concatenate([[0], np.cumsum(np.diff(bounds)[piece])])
        return pa.ListArray.from_arrays(pa.array(totals[ends - ends[0]].astype(np.int32)), pa.array(found))


@lru_cache(maxsize=2)
def piece_encoder(content: bytes) -> PieceEncoder:
    return PieceEncoder(content)


def with_end(ids: pa.ListArray, end_id: int) -> pa.ListArray:
    """Each list with ``end_id`` after its last."""
    ends = ids.offsets.to_numpy().astype(np.int64)
    flat = np.insert(ids.values.to_numpy(), ends[1:], end_id)
    return pa.ListArray.from_arrays(pa.array((ends + np.arange(len(ends))).astype(np.int32)), pa.array(flat, pa.int32()))


def write_tokens(df: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, doc_id: str = "doc_id",
                 text: str = "text", part_bytes: int = PART_BYTES) -> None:
    """Encode all texts, append ``end_id`` to each, and write them below ``path`` in order of ``doc_id``."""
    content = load_vocabulary(df, vocabulary)
    names = ["doc_id", "part", "start_in_part", "n_tokens", "token_ids"]

    def run(batches):
        encoder = piece_encoder(content.value)
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in slices(batch, "text", SLICE):
                ids = with_end(encoder.encode(texts_of(rows)), end_id)
                counts = ids.value_lengths().to_numpy().astype(np.int64)
                ends = at + np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(np.full(len(counts), part, np.int32)), pa.array(ends - counts),
                     pa.array(counts), ids], names)
                at = int(ends[-1])

    parts = pieces(text_bytes(df, text), part_bytes)
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if parts > 1:
        rows = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    else:
        rows = rows.coalesce(1).sortWithinPartitions("doc_id", "text")
    kind = df.schema[doc_id].dataType.simpleString()
    encoded = rows.mapInArrow(
        run, f"doc_id {kind}, part int, start_in_part long, n_tokens long, token_ids array<int>")
    encoded.write.options(**LAYOUT).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Per document ``doc_id``, ``n_tokens`` and ``start``, the ids of all documents before it; no ids are read."""
    rows = spark.read.parquet(path).select("doc_id", "part", "start_in_part", "n_tokens")
    return _with_start(rows, rows)


def read_tokens(spark: SparkSession, path: str, first=None, last=None) -> DataFrame:
    """The same with ``token_ids``, of documents ``first`` to ``last`` only where given: other pages are skipped."""
    rows = spark.read.parquet(path)
    chosen = rows
    if first is not None:
        chosen = chosen.where(F.col("doc_id") >= first)
    if last is not None:
        chosen = chosen.where(F.col("doc_id") <= last)
    return _with_start(chosen, rows)


def _with_start(chosen: DataFrame, rows: DataFrame) -> DataFrame:
    # One row per file: their running total is the only thing that one task sees whole. It goes to the rows, up to
    # its checked size, so that no ids move.
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = small(stored(sizes.selectExpr(
        "part AS of_part", "sum(size) OVER (ORDER BY part ROWS UNBOUNDED PRECEDING) - size AS before"), "part-starts"))
    joined = chosen.join(before, chosen.part == before.of_part)
    return joined.withColumn("start", F.col("before") + F.col("start_in_part")).drop(
        "of_part", "part", "before", "start_in_part")


def token_crc(tokens: DataFrame) -> DataFrame:
    """Per document of ``read_tokens``: ``ids_crc32``, CRC-32 of its ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        for batch in batches:
            ids = batch.column("token_ids")
            ends = ids.offsets.to_numpy()
            data = pc.cast(ids.values, pa.int32()).to_numpy().astype("<i4", copy=False)
            crcs = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crcs, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    picked = tokens.select("doc_id", "start", "n_tokens", "token_ids")
    return picked.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
