"""Byte-level BPE: encode whole texts to token ids, and decode ids to texts.

A text is cut at the special tokens, then into words as the vocabulary's pattern says. The parts of a word
stand in one contiguous array beside the merge ranks of adjacent parts; the lowest rank is found by scanning,
its boundary is deleted and the two neighbouring ranks are looked up anew, until no rank is left. The words that a
slice of texts has and the cache has not are merged together, as the rows of one matrix of parts and one of ranks: each
round scans, deletes and refreshes once in every word. Words of more than ``SCAN_BYTES`` bytes take a heap over the
same ranks, so that a text without blanks is not quadratic. The cache of a worker holds about ``CACHE_WORDS`` words.

Results: a null text is an empty one, with no ids. Rows are kept as they come, repeated or not, and columns
that are not named play no part, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanwise.llm.common import Kept, map_texts, texts_of

SCAN_BYTES = 64
CACHE_WORDS = 500_000
MATRIX_WORDS = 20_000
NONE = 1 << 30

# Fixed values of the public byte-level format: the white space and the pattern of words.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# The same pattern for texts within Latin-1, whose letters, numbers and blanks can be listed.
LATIN = _L, _N, _W = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_LATIN_WORDS = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_W}{_L}{_N}]+|[{_W}]+(?![^{_W}])|[{_W}]+")
_WORDS = regex.compile(WORDS)
# Letters up to here are the same in every version of Unicode that the library may be built with.
_STABLE = re.compile("[^\x00-\u0500]")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class PairRanks:
    """Merge rank of two adjacent ids, for whole arrays at once: a table with open addressing."""

    def __init__(self, pairs: list[tuple[int, int]]):
        keys = np.array([a << 32 | b for a, b in pairs], np.uint64)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, 2**64 - 1, np.uint64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        self.reach = 1
        slots = self._slot(keys).tolist()
        for rank, (slot, key) in enumerate(zip(slots, keys.tolist())):
            tries = 1
            while self.ranks[slot] != NONE:
                slot, tries = (slot + 1) & (1 << self.bits) - 1, tries + 1
            self.keys[slot], self.ranks[slot] = key, rank
            self.reach = max(self.reach, tries)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, ``NONE`` where the two never merge."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slots = self._slot(keys)
        ranks = np.full(keys.shape, NONE, np.int32)
        for step in range(self.reach):
            at = slots + step & (1 << self.bits) - 1
            same = self.keys[at] == keys
            ranks[same] = self.ranks[at[same]]
        return ranks


class Codec:
    """Vocabulary, merges and special tokens of a byte-level BPE file."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        vocab, to_byte = spec["model"]["vocab"], byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")"
                                if self.special else "(?!)")
        self.text_of = {i: bytes(to_byte[c] for c in t) for t, i in vocab.items()}
        self.text_of |= {i: t.encode() for t, i in self.special.items()}
        self.byte_id = np.array([vocab[c] for c, _ in sorted(to_byte.items(), key=lambda x: x[1])], np.int32)
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        pairs = [(vocab[a], vocab[b]) for a, b in merges]
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)  # by rank
        self.rank = {a << 32 | b: r for r, (a, b) in enumerate(pairs)}
        self.ranks = PairRanks(pairs)
        self.library = Tokenizer.from_str(content.decode()).pre_tokenizer
        self.cache = Kept(CACHE_WORDS)

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, as little-endian unsigned 32-bit integers."""
        split = [self._words(t) for t in texts]
        ids = self.cache
        wanted = set().union(*split) - self.special.keys()
        new = ids.missing(wanted)
        ids.update(zip(new, self.merge([w.encode() for w in new])))
        ids.update((t, i.to_bytes(4, "little")) for t, i in self.special.items())
        out = [b"".join(map(ids.__getitem__, words)) for words in split]
        for word in new:
            if len(word) > 64:
                ids.drop(word)
        return out

    def _words(self, text: str) -> list[str]:
        if self.special and self.split.search(text):
            return [w for p in self.split.split(text) for w in ([p] if p in self.special else self._plain(p))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if _STABLE.search(text):
                return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
            return _WORDS.findall(text)
        return _LATIN_WORDS.findall(text)

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.text_of.__getitem__, ids)).decode("utf-8", "replace")

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of words, in groups of like length."""
        out: list = [None] * len(words)
        by_length: dict[int, list[int]] = {}
        for at, word in enumerate(words):
            if len(word) > SCAN_BYTES:
                out[at] = np.array(self.heap(self.byte_id[np.frombuffer(word, np.uint8)].tolist()), "<u4").tobytes()
            else:
                by_length.setdefault(len(word), []).append(at)
        for length, places in by_length.items():
            for first in range(0, len(places), MATRIX_WORDS):
                some = places[first:first + MATRIX_WORDS]
                octets = np.frombuffer(b"".join([words[at] for at in some]), np.uint8).reshape(-1, length)
                for at, ids in self.scan(self.byte_id[octets]):
                    for row, place in enumerate(at.tolist()):
                        out[some[place]] = ids[row].tobytes()
        return out

    def scan(self, parts: np.ndarray):
        """Merge the words that are the rows of a matrix of ids: yields rows and their ids as they end."""
        rows = np.arange(len(parts))
        ranks = self.ranks(parts[:, :-1], parts[:, 1:])
        while ranks.shape[1]:
            at = ranks.argmin(axis=1)
            least = np.take_along_axis(ranks, at[:, None], 1)[:, 0]
            go = least < NONE
            if not go.all():
                yield rows[~go], parts[~go]
                rows, parts, ranks, at, least = rows[go], parts[go], ranks[go], at[go], least[go]
            if not len(rows):
                return
            every = np.arange(len(rows))
            parts[every, at] = self.merged[least]
            columns = np.arange(parts.shape[1] - 1)
            parts = np.where(columns > at[:, None], parts[:, 1:], parts[:, :-1])
            ranks = np.where(columns[:-1] >= at[:, None], ranks[:, 1:], ranks[:, :-1])
            for side in (at - 1, at):  # the pairs that hold the merged part
                known = np.flatnonzero((side >= 0) & (side < ranks.shape[1]))
                here = side[known]
                ranks[known, here] = self.ranks(parts[known, here], parts[known, here + 1])
        yield rows, parts

    def heap(self, parts: list[int]) -> list[int]:
        """The same merges in the same order, by rank and then from the left, of one long word."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def rank(a: int, b: int) -> int:
            return self.rank.get(a << 32 | b, NONE)

        queue = [(r, i) for i in range(n - 1) if (r := rank(parts[i], parts[i + 1])) != NONE]
        heapq.heapify(queue)
        while queue:
            least, at = heapq.heappop(queue)
            to = after[at] if parts[at] >= 0 else n
            if to >= n or rank(parts[at], parts[to]) != least:
                continue
            parts[at] = int(self.merged[least])
            parts[to] = -1
            after[at] = after[to]
            if after[at] < n:
                before[after[at]] = at
                if (r := rank(parts[at], parts[after[at]])) != NONE:
                    heapq.heappush(queue, (r, at))
            if before[at] >= 0 and (r := rank(parts[before[at]], parts[at])) != NONE:
                heapq.heappush(queue, (r, before[at]))
        return [p for p in parts if p >= 0]


@lru_cache(maxsize=2)
def codec(content: bytes) -> Codec:
    """The codec of a vocabulary file; one for all tasks of a worker."""
    return Codec(content)


def load_vocabulary(df: DataFrame, path: str):
    """The file at ``path``, read by the driver and sent to the executors (a few MB, whatever the corpus)."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def id_lists(encoded: list[bytes]) -> pa.ListArray:
    """Arrow lists of 32-bit ids."""
    ends = np.cumsum([0, *(len(e) // 4 for e in encoded)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(encoded), "<i4")))


def encode_documents(df: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep``, with ``n_tokens`` and ``token_ids`` (array of int) of each text."""
    content = load_vocabulary(df, path)
    names = list(dict.fromkeys([*keep, text]))

    def make():
        encode = codec(content.value).encode

        def step(batch):
            ids = id_lists(encode(texts_of(batch, text)))
            counts = ids.value_lengths().cast(pa.int64())
            return pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), counts, ids], [*keep, "n_tokens", "token_ids"])

        return step

    schema = ", ".join(filter(None, [_fields(df, keep), "n_tokens long, token_ids array<int>"]))
    return map_texts(df.select(*names), schema, make, text)


def decode_documents(df: DataFrame, path: str, keep: list[str], ids: str = "token_ids") -> DataFrame:
    """The columns ``keep``, with ``decoded`` (string) of each list of ids; a null list gives an empty text."""
    content = load_vocabulary(df, path)
    names = list(dict.fromkeys([*keep, ids]))

    def run(batches):
        text_of = codec(content.value).decode
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists = part.column(ids)
                texts = [text_of(lists[i].values.to_pylist()) if lists[i].is_valid else ""
                         for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in keep), pa.array(texts, pa.string())], [*keep, "decoded"])

    schema = ", ".join(filter(None, [_fields(df, keep), "decoded string"]))
    return df.select(*names).mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its id, the number of ids, and SHA-256 of the ids and of the text they decode to."""
    content = load_vocabulary(df, path)
    encoded = encode_documents(df, path, [doc_id], text)

    def run(batches):
        decode = codec(content.value).decode
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists = part.column("token_ids")
                ids = [lists[i].values for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column("n_tokens"),
                     pa.array([i.to_numpy(zero_copy_only=False).astype("<u4").tobytes() for i in ids], pa.binary()),
                     pa.array([decode(i.to_pylist()) for i in ids], pa.string())],
                    [doc_id, "n_tokens", "ids_bytes", "decoded"])

    schema = f"{_fields(df, [doc_id])}, n_tokens long, ids_bytes binary, decoded string"
    return encoded.mapInArrow(run, schema).select(
        doc_id, "n_tokens", F.sha2("ids_bytes", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
