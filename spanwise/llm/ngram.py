"""Language model scores of whole texts, by a weighted backoff automaton.

Tokens are words between ASCII white space, A-Z in lower case, then one end token per text. All training texts count:
c(w) of every token, c(h, w) of every token and its predecessor (the end token stands before a first word).

The model interpolates: p(w | h) = L c(h, w) / c(h) + (1 - L) p1(w), with p1(w) = (c(w) + 1) / (N + V + 1), which
keeps one more share for all unknown words, and Witten-Bell weights L = c(h) / (c(h) + f(h)), where the number f of a word's
different followers is taken to be c(h) ** ``FOLLOWERS``. Probabilities after any h sum to one.

As an automaton: the root reads any word with weight log10 p1; each word seen in training is a state, with an arc for
every pair seen, weight log10 p(w | h), and a failure arc to the root, weight log10 (1 - L). A text's score is one
traversal from the end token's state, left to right, that follows failure arcs until a state reads the word.

The automaton of a corpus fits no executor, so texts are dealt into buckets of about ``BUCKET_BYTES``, and a
bucket needs only the arcs that its own texts can read. Each bucket counts its tokens and pairs once, as hashes
of 64 bits, and asks for them in packed runs, one to each range of hashes; the range adds up what all buckets counted and answers with
totals in the order of the question. Every pair crosses the network once for each bucket that holds it, never more, so a
word that is everywhere is no hot key. Rows are dealt by their place, so neither ids nor texts can overfill a bucket.

Results: a null text has the end token alone. Rows without id are held out and scored. Rows are kept as they come; other columns
play no part, and an empty table gives an empty one. Where nothing is left for training, N and V are 0 and every
token has probability 1. Words are told apart by hash: of 10^9 words two may share one.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import pieces, slices, text_bytes

FOLLOWERS = 0.75
BUCKET_BYTES = 4 << 20
RANGE_BYTES = 6 << 20
END = np.uint64(0x8E9D5A1F3C2B7E61)  # stands for the end token among the hashes of words
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
WORD, PAIR = 0, 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _ODD
    x = (x ^ x >> np.uint64(29)) * _ODD2
    return x ^ x >> np.uint64(32)


@lru_cache(maxsize=4)
def _coefficients(size: int) -> np.ndarray:
    """A pseudo-random odd number for each place within a word."""
    return _mixed(np.arange(1, size + 1, dtype=np.uint64) * _ODD) | np.uint64(1)


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of texts, one after the other, as hashes; and how many each text has, its end included."""
    data = b"\n".join(texts).lower() + b"\n"
    octets = np.frombuffer(data, np.uint8)
    inside = ~_WHITE[octets]
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & ~before)
    lengths = np.flatnonzero(~inside & before) - starts
    kept = octets[inside]
    place = np.arange(len(kept)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    size = 1 << max(6, int(lengths.max(initial=1) - 1).bit_length())
    each = (kept.astype(np.uint64) + np.uint64(1)) * _coefficients(size)[place]
    words = np.add.reduceat(each, np.cumsum(lengths) - lengths) if len(starts) else np.empty(0, np.uint64)
    words = _mixed(words + lengths.astype(np.uint64) * _ODD2)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    per_text = np.bincount(np.searchsorted(np.cumsum(sizes), starts, "right"), minlength=len(texts))
    tokens = np.full(len(words) + len(texts), END)
    tokens[np.arange(len(words)) + np.repeat(np.arange(len(texts)), per_text)] = words
    return tokens, per_text + 1


def pair_hashes(tokens: np.ndarray) -> np.ndarray:
    """The hash of every token with the one before it; an end token comes before the first."""
    before = np.concatenate([[END], tokens[:-1]])
    return _mixed(before * _ODD + _mixed(tokens + _ODD))


class Automaton:
    """States with arcs, failure arcs, and weights in log10; state 0 is the root."""

    def __init__(self, size: int):
        self.size = size  # words are numbered from 0
        self.arc: dict[int, int] = {}
        self.weight: list[float] = []
        self.target: list[int] = []
        self.fail: list[int] = [0]
        self.fail_weight: list[float] = [0.0]

    def add_arcs(self, states: np.ndarray, words: np.ndarray, weights: np.ndarray, targets: np.ndarray) -> None:
        keys = states.astype(np.int64) * self.size + words
        self.arc.update(zip(keys.tolist(), range(len(self.weight), len(self.weight) + len(keys))))
        self.weight.extend(weights.tolist())
        self.target.extend(targets.tolist())

    def traverse(self, words: list[int], state: int) -> float:
        """The sum of weights along the words. The root must read every one of them."""
        arc, size, weight, target = self.arc.get, self.size, self.weight, self.target
        total = 0.0
        for word in words:
            found = arc(state * size + word)
            while found is None:
                total += self.fail_weight[state]
                state = self.fail[state]
                found = arc(state * size + word)
            total += weight[found]
            state = target[found]
        return total


class _Bucket:
    """Tokens of the texts of a bucket, numbered, with their distinct hashes and pairs."""

    def __init__(self, texts: list[bytes]):
        self.tokens, self.counts = token_hashes(texts)
        self.words, self.number = np.unique(self.tokens, return_inverse=True)
        self.pairs, at = np.unique(pair_hashes(self.tokens), return_index=True)
        before = np.concatenate([[np.searchsorted(self.words, END)], self.number[:-1]])
        self.left, self.right = before[at], self.number[at]

    def asked(self, kind: int) -> np.ndarray:
        return self.words if kind == WORD else self.pairs

    def counted(self, kind: int, training: np.ndarray) -> np.ndarray:
        """How often each of ``asked`` occurs in the texts that train."""
        learn = np.repeat(training, self.counts)
        if kind == WORD:
            return np.bincount(self.number[learn], minlength=len(self.words))
        place = np.searchsorted(self.pairs, pair_hashes(self.tokens)[learn])
        return np.bincount(place, minlength=len(self.pairs))


def _texts(table) -> list[bytes]:
    return [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]


def _runs(hashes: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """The runs of sorted hashes that fall in each range: range, first, last."""
    if not len(hashes):
        return []
    ranges = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    heads = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]]))
    return list(zip(ranges[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(hashes)]))


def _packed(hashes: np.ndarray, bits: int) -> bytes:
    """The 48 bits of each hash below those of its range."""
    return (hashes << np.uint64(bits) >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view("<u8")[:, 0]


def _squeezed(counts: np.ndarray) -> bytes:
    """Whole numbers of which nearly all are small: one byte each, then in full those that need more."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def _stretched(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<i8", offset=n)
    return counts


def vocabulary_size(training: DataFrame, bits: int) -> tuple[int, int]:
    """N and V: tokens of the training texts, and how many are distinct. Two numbers reach the driver."""

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, _ = token_hashes(_texts(part))
                words = np.unique(tokens)
                runs = _runs(words, bits)
                share = [len(tokens)] + [0] * (len(runs) - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r for r, _, _ in runs], pa.int64()), pa.array([_packed(words[a:b], bits) for _, a, b in runs], pa.binary()),
                     pa.array(share, pa.int64())], ["range", "words", "n"])

    def distinct(table: pa.Table) -> pa.Table:
        words = np.unique(_unpacked(b"".join(table.column("words").to_pylist())))
        n = sum(table.column("n").to_pylist())
        return pa.Table.from_arrays([pa.array([n], pa.int64()), pa.array([len(words)], pa.int64())], ["n", "v"])

    runs = training.select("text").mapInArrow(count, "range long, words binary, n long")
    sums = runs.groupBy("range").applyInArrow(distinct, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    return sums[0] or 0, sums[1] or 0


def score_texts(df: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text",
                followers: float = FOLLOWERS) -> DataFrame:
    """Per row: ``doc_id``, ``training``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``."""
    total_bytes = text_bytes(df, text)
    buckets = pieces(total_bytes, BUCKET_BYTES)
    bits = (pieces(total_bytes, RANGE_BYTES) - 1).bit_length()
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), training.alias("training"))
    n_tokens, n_words = vocabulary_size(rows.where("training"), bits)
    shares = n_tokens + n_words + 1

    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).cast("int")
    dealt = rows.withColumn("bucket", place).repartition(buckets, "bucket")

    def ask(key, table):
        bucket = _Bucket(_texts(table))
        learn = table.column("training").to_numpy(zero_copy_only=False).astype(bool)
        out = []
        for kind in (WORD, PAIR):
            hashes, counts = bucket.asked(kind), bucket.counted(kind, learn)
            out += [(key[0].as_py(), kind, r, _packed(hashes[a:b], bits), _squeezed(counts[a:b]))
                    for r, a, b in _runs(hashes, bits)]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                    ["bucket", "kind", "range", "asked", "counted"])

    def answer(key, table):
        asked = table.column("asked").to_pylist()
        sizes = [len(a) // 6 for a in asked]
        counted = np.concatenate([_stretched(c, n) for c, n in zip(table.column("counted").to_pylist(), sizes)])
        distinct, place = np.unique(_unpacked(b"".join(asked)), return_inverse=True)
        totals = np.zeros(len(distinct), np.int64)
        np.add.at(totals, place, counted)
        parts = np.split(totals[place], np.cumsum(sizes)[:-1])
        return pa.Table.from_arrays(
            [table.column("bucket"), table.column("kind"), table.column("range"),
             pa.array([_squeezed(p) for p in parts], pa.binary()), pa.array(sizes, pa.int32())],
            ["bucket", "kind", "range", "totals", "n"])

    def totals_of(replies: pa.Table, kind: int) -> np.ndarray:
        rows = zip(*(replies.column(c).to_pylist() for c in ("kind", "range", "totals", "n")))
        return np.concatenate([_stretched(t, n) for _, t, n in sorted((r, t, n) for k, r, t, n in rows if k == kind)])

    names = ["doc_id", "training", "n_tokens", "n_known", "base_score", "score"]

    def score(key, texts, replies):
        bucket = _Bucket(_texts(texts))
        c, pairs = totals_of(replies, WORD), totals_of(replies, PAIR)
        p1 = (c + 1) / shares
        root = np.log10(p1)
        seen = c > 0
        lam = np.where(seen, c / np.maximum(c + np.maximum(c, 1).astype(float) ** followers, 1), 0.0)
        state = np.where(seen, np.cumsum(seen), 0)  # the root stands for words that never were a context
        automaton = Automaton(len(c))
        automaton.fail += [0] * int(seen.sum())
        automaton.fail_weight += np.log10(1 - lam[seen]).tolist()
        every = np.arange(len(c))
        automaton.add_arcs(np.zeros(len(c), np.int64), every, root, state)
        held = np.flatnonzero(pairs > 0)
        left, right = bucket.left[held], bucket.right[held]
        weights = np.log10(lam[left] * pairs[held] / c[left] + (1 - lam[left]) * p1[right])
        automaton.add_arcs(state[left], right, weights, state[right])
        first = int(state[np.searchsorted(bucket.words, END)])
        ends = np.cumsum(bucket.counts)
        starts = ends - bucket.counts
        numbers = bucket.number.tolist()
        scores = [automaton.traverse(numbers[a:b], first) for a, b in zip(starts.tolist(), ends.tolist())]
        base = np.add.reduceat(root[bucket.number], starts)
        known = np.add.reduceat(seen[bucket.number].astype(np.int64), starts)
        return pa.Table.from_arrays(
            [texts.column("doc_id"), texts.column("training"), pa.array(bucket.counts.astype(np.int64)), pa.array(known),
             pa.array(base), pa.array(scores, pa.float64())], names)

    asked = dealt.groupBy("bucket").applyInArrow(ask, "bucket int, kind int, range long, asked binary, counted binary")
    answered = asked.groupBy("range", "kind").applyInArrow(
        answer, "bucket int, kind int, range long, totals binary, n int")
    kind = df.schema[doc_id].dataType.simpleString()
    scored = dealt.groupBy("bucket").cogroup(answered.groupBy("bucket")).applyInArrow(
        score, f"doc_id {kind}, training boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(n_tokens).cast("long"))
