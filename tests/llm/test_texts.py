"""Licences, toxicity, decontamination and language-model scores against brute force."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from crivo.llm import queries
from crivo.llm.decontaminate import cut_spans, decontaminate, with_hits
from crivo.llm.licenses import TEMPLATES, scan_licenses
from crivo.llm.lm import lm_scores, pack_keys, pack_numbers, unpack_keys, unpack_numbers
from crivo.llm.oracles import OP6
from crivo.llm.toxicity import Lexicon, density, fit_lexicon, fold, held_out, marks_toxic, with_toxicity

from tests.compare import connect, difference, spark_rows, sql_rows
from tests.llm.test_links import TRICKY, docs_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def given(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def slow_places(words, phrase):
    n = len(phrase)
    return [i for i in range(len(words) - n + 1) if words[i : i + n] == phrase]


LICENSED = [
    (50, "CC BY-NC 4.0, cc BY; All  Rights-Reserved"), (51, "All rights all rights reserved"),
    (52, "This is the GNU General Public License, version 3. general public license"),
    (53, "cc"), (54, "reserved rights all by cc"), (55, "Kcc by É general public licenseé"),
    (56, "Licensed under the Apache License, Version 2.0"), (57, "the mit license"),
    (58, ("filler " * 5000) + "cc by"), (59, "cc by " * 400),
]


def test_license_base_equals_brute_force(spark, folder):
    pairs = given(spark, folder) + [(i and i + 5000, t) for i, t in TRICKY] + LICENSED
    base = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
    expected = []
    for i, text in pairs:
        words = words_of(text)
        places = {label: slow_places(words, phrase) for label, phrase in base.items()}
        every = sorted(p for found in places.values() for p in found)
        labels = ",".join(sorted(label for label, found in places.items() if found))
        expected.append((i, len(words), len(every), *((every[0], every[-1]) if every else (None, None)), labels))
    rows = scan_licenses(docs_of(spark, pairs)).collect()
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows]
    assert sorted(got, key=str) == sorted(expected, key=str)
    for r in rows:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_license_notices_need_their_key_words(spark):
    found = {r.doc_id: r for r in scan_licenses(docs_of(spark, LICENSED)).collect()}
    assert found[50].labels == "cc-by,cc-by-nc,reserved"
    assert found[56].labels == "apache-2.0" and found[56].score == pytest.approx(1.0)
    assert found[57].labels == "mit" and found[57].score < 1.0
    assert found[52].labels == "gpl,gpl-3"
    assert all(t.words[t.key_at : t.key_at + len(t.key)] == t.key for t in TEMPLATES)


def test_license_scan_runs_no_python(spark, folder):
    df = scan_licenses(spark.read.parquet(f"{folder}/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


BENCH = [
    ("a", " ".join(f"w{k}" for k in range(14))), ("b", "Short item"), ("c", None), ("d", "..."),
    (None, "unnamed item of exactly ten words which has no id"), ("b", "short, ITEM"), ("e", "é ñandú über"),
]
DIRTY = [
    (70, "x " + " ".join(f"W{k}" for k in range(14)) + " y"), (71, " ".join(f"w{k}" for k in range(9))),
    (72, "a short-item, then short item"), (73, "Unnamed item of exactly ten words which has no id!"),
    (74, "short short item item"), (75, "é ñandú über"), (76, " ".join(f"w{k}" for k in range(3, 13)) + " w0"),
]


def slow_hits(text, bench, size=10):
    words, hit, items = words_of(text), set(), set()
    for item, body in bench:
        w = words_of(body)
        for k in range(max(1, len(w) - size + 1)) if w else ():
            window = w[k : k + size]
            for at in slow_places(words, window):
                hit.update(range(at, at + len(window)))
                items |= {item} - {None}
    return len(words), len(hit), sorted(items), bool(hit)


@pytest.mark.parametrize("block", [1_000_000, 3])
def test_benchmark_hits_equal_brute_force(spark, folder, block):
    pairs = DIRTY + TRICKY
    bench = spark.createDataFrame(BENCH, "item_id string, text string")
    docs = docs_of(spark, pairs).withColumns({"h_0": F.lit(5), "spans": F.lit(6), "h": F.lit(7)})
    rows = with_hits(docs, bench, "h", block=block).select("doc_id", "text", "h", "h_0", "spans").collect()
    assert {(r.h_0, r.spans) for r in rows} == {(5, 6)}
    for r in rows:
        n, hit, items, _ = slow_hits(r.text, BENCH)
        assert (r.h.n_words, sum(s.end - s.first for s in r.h.spans), r.h["items"]) == (n, hit, items), r.text[:50]
    assert len(rows) == len(pairs)


def test_benchmark_query_equals_brute_force(spark, folder):
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    texts = dict(given(spark, folder))
    rows = queries.op5_decontaminate(spark, folder).collect()
    hits = [r.doc_id for r in rows if r.contaminated]
    assert hits
    for i in hits[:15] + [r.doc_id for r in rows if not r.contaminated][:25]:
        r = next(x for x in rows if x.doc_id == i)
        n, hit, items, dirty = slow_hits(texts[i], bench)
        digest = hashlib.sha256(",".join(items).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(items), digest, dirty)


def test_decontamination_removes_documents_or_spans(spark):
    bench = spark.createDataFrame(BENCH, "item_id string, text string")
    docs = docs_of(spark, DIRTY + [(80, "clean text"), (81, None), (82, "")]).withColumn("spans", F.lit(1))
    whole = decontaminate(docs, bench)
    assert whole.columns == docs.columns and {r.doc_id for r in whole.collect()} == {71, 80, 81, 82}
    cut = {r.doc_id: r.text for r in decontaminate(docs, bench, "spans").collect()}
    assert cut[70] == "x  y" and cut[72] == "a , then " and cut[80] == "clean text" and cut[81] is None
    none = decontaminate(docs, bench.filter("item_id = 'zzz'"))
    assert none.count() == docs.count()
    with pytest.raises(ValueError):
        decontaminate(docs, bench, "other")
    assert cut_spans("É a b É".encode(), [{"first": 1, "end": 3}]).decode() == "É  É"


def slow_scores(pairs, order, least, alpha=0.4):
    counts = Counter()
    for _, text in pairs:
        w = words_of(text)
        for k in range(1, order + 1):
            counts.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        counts[()] += len(w)

    def score(history, word):
        if not history:
            return counts[(word,)] / counts[()]
        if counts[(*history, word)] >= least:
            return counts[(*history, word)] / counts[tuple(history)]
        return alpha * score(history[1:], word)

    out = []
    for i, text in pairs:
        w = words_of(text)
        logs = [math.log(score(w[max(0, k - order + 1) : k], w[k])) for k in range(len(w))]
        out.append((i, len(w), sum(logs)))
    return out


@pytest.mark.parametrize("order, least, block", [(2, 2, 8 << 20), (3, 1, 2000), (4, 2, 500), (1, 1, 9000)])
def test_backoff_scores_equal_brute_force(spark, order, least, block):
    pairs = TRICKY[:6] + TRICKY[8:] + [(200 + k, f"the cat {k % 7} sat on the mat {k % 3} the cat sat") for k in range(60)]
    got = lm_scores(docs_of(spark, pairs), order, least, block_bytes=block).collect()
    expected = slow_scores(pairs, order, least)
    key = lambda r: (str(r[0]), r[1], round(r[2], 6))
    for a, b in zip(sorted(got, key=key), sorted(expected, key=key), strict=True):
        assert a[:2] == b[:2] and a.log_score == pytest.approx(b[2], abs=1e-6)
        assert a.mean_score == (pytest.approx(a.log_score / a.n_words) if a.n_words else None)
    assert lm_scores(docs_of(spark, [])).count() == 0


def test_backoff_counts_very_long_and_repeated_texts(spark):
    pairs = [TRICKY[6], TRICKY[7], TRICKY[6]]
    got = {(r.doc_id, r.n_words): r.log_score for r in lm_scores(docs_of(spark, pairs)).collect()}
    for i, n, total in slow_scores(pairs, 2, 2):
        assert got[i, n] == pytest.approx(total, rel=1e-9)


def test_registered_lm_scores_with_trigrams(spark, tmp_path):
    pairs = [(k, f"the cat {k % 7} sat on the mat {k % 3} the cat sat") for k in range(40)]
    docs_of(spark, pairs).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.log_score for r in queries.QUERIES["op6_lm_order3"](spark, str(tmp_path)).collect()}
    shorter = {i: total for i, _, total in slow_scores(pairs, 2, 2)}
    for i, _, total in slow_scores(pairs, 3, 2):
        assert got[i] == pytest.approx(total, abs=1e-6) and abs(got[i] - shorter[i]) > 0.1


def test_bigram_scores_equal_their_sql(spark, folder):
    got = lm_scores(spark.read.parquet(f"{folder}/documents.parquet"), order=2)
    rounded = got.withColumns({c: F.round(c, 6) for c in ("log_score", "mean_score")})
    assert difference(spark_rows(rounded), sql_rows(connect(folder), OP6)) is None


def test_packed_counts_come_back(spark):
    draw = np.random.default_rng(5)
    for n, low in ((1, 0), (2, 0), (5000, 0), (5000, 1 << 63), (70_000, 1 << 40)):
        keys = np.unique(draw.integers(low, 2**64 - 1, n, dtype=np.uint64, endpoint=True))
        assert (unpack_keys(pack_keys(keys)) == keys).all()
    for top in (0, 1, 255, 256, 1 << 20, 1 << 40):
        values = np.append(draw.integers(0, top + 1, 999), top)
        assert (unpack_numbers(pack_numbers(values)) == values).all()


def test_folding_undoes_homoglyphs_and_digits():
    assert fold("1D10T") == "idiot" and fold("m0r0n") == "moron" and fold("іdіоt") == "idiot"
    assert fold("ｉｄｉｏｔ") == "idiot" and fold("in 2024 we sold 15") == "in 2024 we sold 15"


def test_exception_phrases_and_length_lower_the_score():
    lexicon = Lexicon({" idiot ": 4.0, " foolhard": 3.0}, [" idiot box "], 0.1)
    automaton = lexicon.matcher()
    assert density("you idiot", automaton) == pytest.approx(4 / 14)
    assert density("the idiot box", automaton) == 0
    assert density("the idiot box of an idiot", automaton) == pytest.approx(4 / 18)
    assert density("foolhardy man", automaton) == pytest.approx(3 / 14)
    assert density("idiotic", automaton) == 0 and density(None, automaton) == 0 and density("", automaton) == 0
    assert density("you idiot " + "word " * 1000, automaton) < density("you idiot", automaton)


def slow_density(text, lexicon):
    """The rule word by word, without an automaton."""
    words = re.findall(r"[^\W_]+", fold(text or ""))
    line = f" {' '.join(words)} "
    starts = [i for i, c in enumerate(line) if c == " "]
    spared = [(i, i + len(p) - 1) for p in lexicon.exceptions for i in starts if line.startswith(p, i)]
    total = 0.0
    for i in starts:
        found = [w for t, w in lexicon.weights.items() if line.startswith(t, i)]
        if found and not any(a <= i < b for a, b in spared):
            total += max(found)
    return total / (len(words) + 12.0)


def test_density_equals_brute_force():
    lexicon = Lexicon(
        {" bad ": 2.0, " bada": 1.5, " badab": 2.5, " ugly ": 3.0},
        [" bad luck ", " luck bad ", " badabing club ", " ugly bad "], 0.1,
    )
    automaton, draw = lexicon.matcher(), random.Random(8)
    vocabulary = ["bad", "badabing", "badaboom", "club", "luck", "ugly", "B4D", "fine", "_", "é", "2024"]
    texts = [" ".join(draw.choices(vocabulary, k=draw.randrange(40))) for _ in range(400)]
    for text in [*texts, "", None, " ", "\x00", "bad" * 1000, "bad " * 3000]:
        assert density(text, automaton) == pytest.approx(slow_density(text, lexicon)), text


def test_exceptions_of_a_long_text_take_linear_time():
    lexicon = Lexicon({" bad ": 2.0}, [" bad luck "], 0.1)
    automaton = lexicon.matcher()
    started = time.monotonic()
    got = density("bad luck bad day " * 40_000, automaton)
    assert time.monotonic() - started < 5
    assert got == pytest.approx(2.0 * 40_000 / (160_000 + 12))


def test_a_term_is_judged_alike_at_every_sample_size():
    for scale in (1, 3, 10):
        assert marks_toxic(20 * scale, 300 * scale, 2 * scale, 600 * scale)
        assert not marks_toxic(6 * scale, 300 * scale, 6 * scale, 600 * scale)
    assert marks_toxic(5, 500, 0, 6000) and marks_toxic(11, 3000, 0, 6000)
    assert not marks_toxic(4, 500, 0, 6000) and not marks_toxic(5, 3000, 0, 6000)
    assert not marks_toxic(0, 0, 0, 0) and not marks_toxic(9, 9, 0, 0)


def test_very_long_and_repeated_texts_are_scored_whole(spark):
    lexicon = Lexicon({" idiot ": 4.0}, [], 0.001)
    long = "word " * 300_000 + "idiot"
    docs = docs_of(spark, [(1, long), (1, long), (2, "word " * 300_000), (None, "idiot")])
    got = sorted((r.doc_id or 0, r.s) for r in with_toxicity(docs, lexicon, "s").collect())
    alone = 4 / (300_001 + 12)
    assert [s for _, s in got] == pytest.approx([4 / 13 / (4 / 13 + 0.001), alone / (alone + 0.001), alone / (alone + 0.001), 0])


def insults(spark, n=400):
    rng = random.Random(3)
    rude = ["grumbler", "numbskull"]
    rows, labels = [], []
    for k in range(n):
        words = ["".join(rng.choice("aeioulnrst") for _ in range(6)) for _ in range(40)]
        if k % 4 == 0:
            words[rng.randrange(40)] = words[rng.randrange(40)] = rng.choice(rude)
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(k % 4 == 0)))
    return docs_of(spark, rows + [(None, "x"), (9000, None), (9001, "")]), spark.createDataFrame(
        labels + [(None, 1, 1), (5, 1, None), (7, 1, 0)], "doc_id long, quality int, toxic int"
    )


def test_lexicon_is_learned_and_holds_on_held_out_rows(spark):
    docs, labels = insults(spark)
    lexicon = fit_lexicon(docs, labels)
    assert {" grumbler ", " numbskull "} & set(lexicon.weights) or any(t.startswith(" grum") for t in lexicon.weights)
    scored = with_toxicity(docs.withColumn("score", F.lit(9.0)), lexicon, "score").join(labels, "doc_id", "left")
    rows = scored.select("doc_id", "score", "toxic", held_out(F.col("doc_id")).alias("held")).collect()
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held and r.toxic is not None]
    assert held and all((r.score >= 0.7) == bool(r.toxic) for r in held)
    assert {r.score for r in rows if r.doc_id in (9000, 9001)} == {0.0}


def test_no_labels_or_documents_give_a_defined_score(spark):
    docs, labels = insults(spark, 8)
    lexicon = fit_lexicon(docs, labels.filter("toxic > 5"))
    assert lexicon.weights == {}
    assert {r.s for r in with_toxicity(docs, lexicon, "s").collect()} == {0.0}
    assert with_toxicity(docs.limit(0), fit_lexicon(docs.limit(0), labels), "s").count() == 0


def test_held_out_labels_are_never_learned(spark):
    docs, labels = insults(spark)
    noisy = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert fit_lexicon(docs, noisy) == fit_lexicon(docs, labels)
