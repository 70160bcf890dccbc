"""Language of whole texts and of their parts: scripts narrow, word scores speak, Viterbi decides.

A word is a run of letters. Each language scores it by the log-likelihood of its letter pairs and triples, counted in
labelled texts. A language is a candidate for a word only if the word's script holds a share of
``SCRIPT_SHARE`` or more of its training letters (all languages are, where none does). Viterbi labels the words of
a text with the sequence of languages of the highest total, less ``SWITCH`` for every change between neighbours; runs
of one label are spans. The language of the text is the one whose spans hold most letters; the score is its share.

Counts come from a sample of at most about ``SAMPLE_DOCS`` labelled texts a language, each read whole, chosen by a hash of
the text among those that the caller allows for training; that is the model's only bound. It holds ``FEATURES`` counts a
language and is sent to all executors; there it scores whole texts, however long, step by step across the texts of a
slice.

Results: a text that is null or has no letter is ``und`` with score 0 and no spans, and so is every text if nothing
is labelled. Of equal totals the language first by name wins. Rows are kept as they come. Other columns play no part, and an
empty table gives an empty one.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import map_texts, texts_of

SAMPLE_DOCS = 1_000
#: Labels that are learned at most: a worker holds a table of the features for each.
LANGUAGES = 120
FEATURES = 1 << 17
SWITCH = 10.0
SCRIPT_SHARE = 0.01
FAR = -60.0
UNKNOWN = "und"
SLICE = 2 << 20
STEP_CHARS = 1 << 18

# First and last code point of the blocks of each script.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF), (0xFB1D, 0xFB4F)),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "devanagari": ((0x900, 0x97F),), "bengali": ((0x980, 0x9FF),), "gurmukhi": ((0xA00, 0xA7F),),
    "gujarati": ((0xA80, 0xAFF),), "tamil": ((0xB80, 0xBFF),), "telugu": ((0xC00, 0xC7F),),
    "kannada": ((0xC80, 0xCFF),), "malayalam": ((0xD00, 0xD7F),), "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF)), "ethiopic": ((0x1200, 0x139F),),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
}
N_SCRIPTS = len(SCRIPTS) + 1

SPANS = "array<struct<start:int,end:int,lang:string,letters:int>>"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("letters", pa.int32())])
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: whether it is a letter (or joins one), its lower case, its script."""
    letter = np.zeros(sys.maxunicode + 1, bool)
    lower = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    script = np.zeros(sys.maxunicode + 1, np.uint8)
    for point in range(sys.maxunicode + 1):
        if unicodedata.category(char := chr(point))[0] in "LM":
            letter[point] = True
            if len(low := char.lower()) == 1:
                lower[point] = ord(low)
    for number, ranges in enumerate(SCRIPTS.values(), 1):
        for first, last in ranges:
            script[first:last + 1] = number
    return letter, lower, script


class Words:
    """The words of some texts, in order, with the feature numbers of their letters."""

    def __init__(self, texts: list[str]):
        letter, lower, script = _tables()
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
        inside = letter[points]
        before = np.concatenate([[False], inside[:-1]])
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(~inside & before)
        first = np.cumsum(sizes) - sizes
        self.text = np.searchsorted(first, starts, "right") - 1  # of each word
        self.start, self.end = starts - first[self.text], ends - first[self.text]
        self.letters = ends - starts
        self.script = script[points[starts]]
        kept = np.flatnonzero(inside | before)  # letters, and one end after each word
        chars = np.where(inside[kept], lower[points[kept]], 0).astype(np.uint64)
        back = np.concatenate([np.zeros(1, np.uint64), chars])[:-1]
        back2 = np.where(back == 0, np.uint64(0), np.concatenate([np.zeros(2, np.uint64), chars])[:-2])
        pair = back << np.uint64(21) | chars
        shift = np.uint64(64 - (FEATURES.bit_length() - 1))
        self.pairs = ((pair | np.uint64(1 << 63)) * _MIX >> shift).astype(np.int32)
        self.triples = ((back2 << np.uint64(42) | pair) * _MIX >> shift).astype(np.int32)
        self.at = np.cumsum(self.letters + 1) - (self.letters + 1)  # of each word's first feature


class Model:
    """Log-likelihoods of features and candidate scripts of each language."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.5
        self.log = np.log(smooth / smooth.sum(0, keepdims=True)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(0, keepdims=True), 1)
        able = share >= SCRIPT_SHARE
        able[~able.any(1)] = True
        self.narrow = np.where(able, 0.0, FAR).astype(np.float32)

    def word_scores(self, words: Words) -> np.ndarray:
        if not len(words.at):
            return np.empty((0, len(self.languages)), np.float32)
        each = self.log[words.pairs] + self.log[words.triples]
        return np.add.reduceat(each, words.at, axis=0) + self.narrow[words.script]


def viterbi(scores: np.ndarray, counts: np.ndarray, switch: float) -> np.ndarray:
    """Labels of the words of several texts at once; counts: words of each text, which stand one after the other."""
    labels = np.zeros(len(scores), np.int8 if scores.shape[1] < 128 else np.int32)
    first = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    first, counts = first[order], counts[order]
    longest = int(counts[0]) if len(counts) else 0
    alive = np.searchsorted(-counts, -np.arange(longest), "left")  # texts that have a word at each step
    came = np.zeros(len(scores), labels.dtype)
    switched = np.zeros(scores.shape, bool)
    value = scores[first[:alive[0]]] if longest else None
    for step in range(longest):
        n = alive[step]
        at = first[:n] + step
        if step:
            value = value[:n]
            best = value.argmax(1)
            other = value[np.arange(n), best] - switch
            turn = other[:, None] > value
            came[at], switched[at] = best, turn
            value = np.where(turn, other[:, None], value) + scores[at]
        stay = alive[step + 1] if step + 1 < longest else 0
        if stay < n:  # texts that end here
            labels[at[stay:]] = value[stay:].argmax(1)
    for step in range(longest - 1, 0, -1):
        at = first[:alive[step]] + step
        label = labels[at]
        labels[at - 1] = np.where(switched[at, label], came[at], label)
    return labels


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS,
          languages: int = LANGUAGES) -> Model:
    """Count the features of a bounded sample of labelled texts, at most about ``sample_docs`` distinct ones a language.

    A text that is repeated is drawn, or not, as one. Labels are learned up to ``languages`` of them, those of the most texts.
    """
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(text).alias("key"))
    found = known.groupBy("lang", "key").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["lang"]: r["n"] for r in found.orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not sizes:
        return Model([], np.zeros((FEATURES, 0)), np.zeros((N_SCRIPTS, 0)))
    share = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample_docs / n))))
    drawn = F.pmod(F.col("key"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000
    sample = known.where(drawn).groupBy("lang", "key").agg(F.first("text").alias("text"))
    names = sorted(sizes)
    place = {n: i for i, n in enumerate(names)}

    def run(batches):
        counts = np.zeros((FEATURES, len(names)), np.int64)
        scripts = np.zeros((N_SCRIPTS, len(names)), np.int64)
        for batch in batches:
            for row, name in zip(texts_of(batch), batch.column("lang").to_pylist()):
                words = Words([row])
                for features in (words.pairs, words.triples):
                    np.add.at(counts[:, place[name]], features, 1)
                np.add.at(scripts[:, place[name]], words.script, words.letters)
        for kind, table in enumerate((counts, scripts)):
            at, of = np.nonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(of.astype(np.int32)),
                 pa.array(table[at, of])], ["kind", "at", "of", "n"])

    rows = (sample.select("text", "lang").mapInArrow(run, "kind int, at int, of int, n long")
            .groupBy("kind", "at", "of").agg(F.sum("n").alias("n")).toArrow())
    kind, at, of, n = (rows.column(c).to_numpy() for c in ("kind", "at", "of", "n"))
    counts, scripts = np.zeros((FEATURES, len(names))), np.zeros((N_SCRIPTS, len(names)))
    counts[at[kind == 0], of[kind == 0]] = n[kind == 0]
    scripts[at[kind == 1], of[kind == 1]] = n[kind == 1]
    return Model(names, counts, scripts)


def label_texts(model: Model, texts: list[str], switch: float = SWITCH):
    """For the texts together: words, scores by word, labels by word, and words of each text."""
    groups, size = [[]], 0
    for t in texts:  # scores are made in steps, so that their features stay small
        if size > STEP_CHARS:
            groups.append([])
            size = 0
        groups[-1].append(t)
        size += len(t)
    text, start, end, letters, scores, base = [], [], [], [], [], 0
    for group in groups:
        words = Words(group)
        text.append(words.text + base)
        start.append(words.start), end.append(words.end), letters.append(words.letters)
        scores.append(model.word_scores(words))
        base += len(group)
    text, start, end, letters = (np.concatenate(x) for x in (text, start, end, letters))
    counts = np.bincount(text, minlength=len(texts))
    return text, start, end, letters, viterbi(np.concatenate(scores), counts, switch)


def identify(df: DataFrame, model: Model, keep: list[str], text: str = "text", switch: float = SWITCH,
             prefix: str = "") -> DataFrame:
    """The columns ``keep``, with ``lang_pred``, ``score`` and ``lang_spans`` (in code points) of each text.

    A ``prefix`` before these three names keeps them apart from columns of the same name.
    """
    added = [prefix + n for n in ("lang_pred", "score", "lang_spans")]
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value
        size = len(model.languages)
        names = pa.array([*model.languages, UNKNOWN])

        def step(batch):
            texts = texts_of(batch, text)
            n = len(texts)
            if size:
                of, start, end, letters, labels = label_texts(model, texts, switch)
            else:
                of = start = end = letters = labels = np.zeros(0, np.int64)
            by_text = np.bincount(of * max(size, 1) + labels, weights=letters, minlength=n * max(size, 1)).reshape(n, -1)
            total = by_text.sum(1)
            best = np.where(total > 0, by_text.argmax(1), size)
            score = by_text.max(1) / np.maximum(total, 1)
            heads = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (labels[1:] != labels[:-1])])[:len(of)])
            tails = np.concatenate([heads[1:], [len(of)]])[:len(heads)] - 1
            spans = pa.StructArray.from_arrays(
                [pa.array(start[heads].astype(np.int32)), pa.array(end[tails].astype(np.int32)),
                 names.take(pa.array(labels[heads].astype(np.int32))),
                 pa.array((np.add.reduceat(letters, heads) if len(heads) else heads).astype(np.int32))],
                fields=list(_SPAN))
            offsets = np.searchsorted(of[heads], np.arange(n + 1)).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), names.take(pa.array(best.astype(np.int32))), pa.array(score),
                 pa.ListArray.from_arrays(pa.array(offsets), spans)], [*keep, *added])

        return step

    fields = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep]
    schema = ", ".join([*fields, *(f"`{n}` {t}" for n, t in zip(added, ("string", "double", SPANS)))])
    return map_texts(df.select(*dict.fromkeys([*keep, text])), schema, make, text, SLICE)


def recognised(df: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows whose text has a language with a score of ``least`` or more, with all their columns."""
    prefix = "_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    found = identify(df, model, df.columns, prefix=prefix)
    known = (F.col(f"{prefix}lang_pred") != UNKNOWN) & (F.col(f"{prefix}score") >= least)
    return found.where(known).select(df.columns)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; rows without id are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(True))
