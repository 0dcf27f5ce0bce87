"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text.

Terms are whole words or word beginnings. Their weights, the exception phrases and the scale of the
score are learned from labelled documents; homoglyphs and digits that stand for letters are folded
before learning and before matching.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crivo.llm.common import raw_texts
from crivo.session import ship_package

#: Most labelled documents learned from, by class.
TOXIC_SAMPLE, CLEAN_SAMPLE = 3000, 6000
#: Lengths of word beginnings that may become terms.
STEMS = range(4, 9)
#: A term needs this many toxic documents, near copies counted once, and these odds against clean ones.
LEAST_SUPPORT, LEAST_ODDS = 5, 10.0
#: Most chance that a term both classes use alike is found in as many toxic documents.
CHANCE = 1e-5
#: Share of either class added before weights are taken, so that they do not move with the sample.
SMOOTHING = 1 / 6000
#: Words added to every text's length, so that a single word of a short text isn't everything.
PRIOR_WORDS = 12.0
THRESHOLD = 0.7
#: Rows a task holds before it hands them on.
ROWS_HELD = 1 << 15

# Letters of other scripts that look like Latin ones, and digits read as letters.
HOMOGLYPHS = dict(
    zip(
        "аАвВсСеЕһНіІјЈкКӏмМоОрРѕЅтТуУхХԁԛԝαΑΒεΕηΗιΙκΚΜνΝοΟρΡτΤυΥχΧΖ",
        "aabbcceehhiijjkklmmooppssttuuxxdqwaabeehhiikkmvnooppttuyxxz",
    )
)
LEET = dict(zip("013457@$8", "oieastas" "b"))

_GLYPHS = re.compile("[" + "".join(HOMOGLYPHS) + "]")
_GLYPH_TABLE = str.maketrans(HOMOGLYPHS)
_LEET = re.compile(r"[013457@$8](?:(?=[^\W\d_])|(?<=[^\W\d_].))")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case, compatibility forms, Latin look-alikes and letters for digits next to letters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text))
        if _GLYPHS.search(text):
            text = text.translate(_GLYPH_TABLE)
    text = text.lower()
    for _ in range(2):  # a digit after a digit becomes a letter's neighbour only once that is folded
        text = _LEET.sub(lambda m: LEET[m[0]], text)
    return text


def terms_of(words: Iterable[str]) -> Iterator[str]:
    """Each word as ` word ` and its beginnings as ` word`."""
    for word in words:
        yield f" {word} "
        for n in STEMS:
            if n < len(word):
                yield f" {word[:n]}"


def phrases_of(words: list[str], terms: set[str]) -> Iterator[tuple[str, str]]:
    """(phrase, term): a lexicon word with the word before and with the word after."""
    for at, word in enumerate(words):
        held = [t for t in (f" {word} ", *(f" {word[:n]}" for n in STEMS)) if t in terms]
        if held:
            if at:
                yield f" {words[at - 1]} {word} ", held[0]
            if at + 1 < len(words):
                yield f" {word} {words[at + 1]} ", held[0]


@dataclass
class Lexicon:
    """Weights of terms, phrases in which they do not count, and the scale of the score."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    scale: float = 1.0

    def matcher(self) -> ahocorasick.Automaton | None:
        """Automaton over terms and phrases; phrases carry no weight."""
        automaton = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            automaton.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            automaton.add_word(phrase, (len(phrase), None))
        if not len(automaton):
            return None
        automaton.make_automaton()
        return automaton


def density(text: str | None, automaton: ahocorasick.Automaton | None) -> float:
    """Summed weights of the matched terms outside exceptions over the length in words.

    Of terms that begin at the same word the heaviest counts.
    """
    if not text or automaton is None:
        return 0.0
    words = _WORD.findall(fold(text))
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(f" {' '.join(words)} "):
        start = end - size + 1
        if weight is None:
            spared.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    spared.sort(reverse=True)
    total, until = 0.0, 0
    for start in sorted(best):
        while spared and spared[-1][0] <= start:
            until = max(until, spared.pop()[1])
        if start >= until:
            total += best[start]
    return total / (len(words) + PRIOR_WORDS)


def marks_toxic(n: int, toxic: int, c: int, clean: int) -> bool:
    """Whether a term in `n` of `toxic` and `c` of `clean` documents is one of a lexicon.

    It must be likelier by `LEAST_ODDS` in a toxic document, and more often there than chance explains
    (Chernoff's bound on a draw by the classes' sizes). Both look at shares, so a term that many
    times as large a sample holds many times as often is judged the same or with more confidence.
    """
    if n < LEAST_SUPPORT or (n + 0.5) * (clean + 1) < LEAST_ODDS * (c + 0.5) * (toxic + 1):
        return False
    share, drawn = n / (n + c), (toxic + 1) / (toxic + clean + 2)
    surprise = n * math.log(share / drawn)
    if c:
        surprise += c * math.log((1 - share) / (1 - drawn))
    return share > drawn and surprise >= -math.log(CHANCE)


def held_out(doc_id: F.Column) -> F.Column:
    """Rows no label of which may be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC_SAMPLE, clean: int = CLEAN_SAMPLE) -> DataFrame:
    """`text`, `toxic` of at most so many labelled documents of each class, the first by id hash.

    Held-out rows and rows without a label or id are left out. Only the sampled ids are broadcast;
    the texts are filtered where they are.
    """
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
        .filter(~held_out(F.col("doc_id")))
    )
    first = F.xxhash64("doc_id")
    sample = known.filter("toxic = 1").orderBy(first, "doc_id").limit(toxic).unionByName(
        known.filter("toxic = 0").orderBy(first, "doc_id").limit(clean)
    )
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")


def _per_document(rows: DataFrame, found: Callable, *names: str) -> DataFrame:
    """Rows that `found(words, toxic)` makes of each text, in columns of strings."""

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic")):
                out.extend(found(_WORD.findall(fold(text.as_py() or "")), toxic.as_py()))
                if len(out) >= ROWS_HELD:
                    yield packed(out)
                    out = []
        if out:
            yield packed(out)

    return rows.mapInArrow(run, ", ".join(f"{n} string" for n in names))


def _support(rows: DataFrame) -> dict[str, int]:
    """Toxic documents of each term that has enough of them, and of all under the empty term.

    A document counts by the smallest hash among its word triples, which near copies mostly share.
    """

    def marked(words: list[str], _: int) -> set[tuple[str, str]]:
        if not words:
            return set()
        triples = zip(words, words[1:], words[2:]) if len(words) > 2 else [words]
        mark = str(min(xxhash.xxh64_intdigest(" ".join(t)) for t in triples))
        return {(t, mark) for t in {"", *terms_of(words)}}

    found = _per_document(rows.filter("toxic = 1"), marked, "term", "mark")
    marks = found.groupBy("term", F.xxhash64("mark").alias("mark")).agg(F.lit(1).alias("one"))
    often = marks.groupBy("term").agg(F.sum("one").alias("n")).filter(F.col("n") >= LEAST_SUPPORT)
    return {r.term: r.n for r in often.collect()}


def _weights(rows: DataFrame, support: dict[str, int]) -> dict[str, float]:
    """Log-odds of the terms that mark toxic documents; a longer term must beat its beginning.

    Every such term is kept; their number is bounded by the sample alone.
    """
    toxic = support.get("", 0)
    wanted = rows.sparkSession.sparkContext.broadcast(frozenset(support))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                sums.update({t for t in terms_of(dict.fromkeys(_WORD.findall(fold(text or "")))) if t in wanted.value})
                sums[""] += 1  # documents
        yield pa.record_batch({"term": pa.array(list(sums), pa.string()), "n": pa.array(list(sums.values()), pa.int64())})

    partial = rows.filter("toxic = 0").mapInArrow(counted, "term string, n long")
    clean = {r.term: r.n for r in partial.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    documents = clean.get("", 0)
    odds = {
        t: math.log((n / toxic + SMOOTHING) / (clean.get(t, 0) / max(1, documents) + SMOOTHING))
        for t, n in support.items()
        if t and marks_toxic(n, toxic, clean.get(t, 0), documents)
    }
    chosen: dict[str, float] = {}
    for term in sorted(odds, key=lambda t: (len(t), t)):
        begun = max((chosen.get(term[: n + 1], 0.0) for n in STEMS if n + 1 < len(term)), default=0.0)
        if odds[term] > begun + 0.7:
            chosen[term] = odds[term]
    return chosen


def _exceptions(rows: DataFrame, terms: set[str]) -> list[str]:
    """Phrases around a term that at least two clean documents hold and no toxic one."""
    wanted = rows.sparkSession.sparkContext.broadcast(terms)
    found = _per_document(
        rows,
        lambda words, toxic: {(phrase, str(toxic)) for phrase, _ in phrases_of(words, wanted.value)},
        "phrase", "toxic",
    )
    counts = found.groupBy("phrase").agg(F.count("*").alias("n"), F.max("toxic").alias("toxic"))
    return sorted(r.phrase for r in counts.filter("toxic = '0' and n >= 2").collect())


def _scale(pairs: list[tuple[float, int]]) -> float:
    """Scale at which the density that parts the classes best gets the threshold's score."""
    values = np.array([p[0] for p in pairs])
    toxic = np.array([p[1] for p in pairs], dtype=bool)
    order = np.argsort(-values, kind="stable")
    values, hits = values[order], np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(hits) + 1) + max(1, hits[-1]))
    last = np.flatnonzero(np.append(values[1:] < values[:-1], True) & (values > 0))  # ends of ties
    if not len(last):
        return 1.0
    at = last[np.argmax(f1[last])]
    below = values[at + 1] if at + 1 < len(values) else 0.0
    cut = math.sqrt(values[at] * max(below, values[at] / 4))
    return cut * (1 - THRESHOLD) / THRESHOLD


def fit_lexicon(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC_SAMPLE, clean: int = CLEAN_SAMPLE) -> Lexicon:
    """Learns a lexicon from a bounded sample of labelled documents (whole texts).

    What reaches the driver grows with the sample's bounds, not with the tables. Without toxic
    labels the lexicon is empty.
    """
    ship_package(docs.sparkSession)
    rows = training_rows(docs, labels, toxic, clean).persist()
    try:
        weights = _weights(rows, _support(rows))
        lexicon = Lexicon(weights, _exceptions(rows, set(weights)))
        if weights:
            scored = with_density(rows, lexicon, "density").select("density", "toxic")
            lexicon.scale = _scale([(r.density, r.toxic) for r in scored.collect()])
    finally:
        rows.unpersist()
    return lexicon


def with_density(docs: DataFrame, lexicon: Lexicon, name: str) -> DataFrame:
    """Adds the weighted density of lexicon terms in `text`."""
    known = docs.sparkSession.sparkContext.broadcast(lexicon)
    state: dict = {}

    @F.arrow_udf("double")
    def measured(texts: pa.Array) -> pa.Array:
        if "matcher" not in state:
            state["matcher"] = known.value.matcher()
        read = (raw and raw.decode("utf-8", "replace") for raw in raw_texts(texts))
        return pa.array([density(t, state["matcher"]) for t in read], pa.float64())

    return docs.withColumn(name, measured(F.col("text")))


def with_toxicity(docs: DataFrame, lexicon: Lexicon, name: str) -> DataFrame:
    """Adds the score of each text, from 0 to 1; null and empty texts get 0.

    Whole texts are scored in one narrow stage from nothing but the text, so repeated rows score
    alike; an empty table gives no rows and a column of the same name is replaced.
    """
    ship_package(docs.sparkSession)
    measured = with_density(docs, lexicon, name)
    return measured.withColumn(name, F.col(name) / (F.col(name) + F.lit(lexicon.scale)))
