"""Mixing, sharding, URL filter, WARC round trip and the pipeline."""

import base64
import hashlib
import io
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from crivo.llm import queries, sharding, warc
from crivo.llm.mixing import mix_sources, tempered_rates, weighted_rates
from crivo.llm.sharding import block_sizes, matrix_row, shard_rows
from crivo.llm.urls import Rule, filter_urls, fit_url_model, ngrams
from crivo.session import scratch_path

from tests.llm.test_links import TRICKY, docs_of


def sized(row):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def poisson_draw(row, rate, number=0, seed=42):
    """Inverts each step's distribution at the number hashed from seed, row, its number and step."""
    steps = max(1, math.ceil(rate / 16.0))
    mean, total = rate / steps, 0
    for j in range(1, steps + 1):
        whole = hashlib.md5(sized(row).encode()).hexdigest()
        digest = hashlib.md5(f"{seed}:{whole}:{number}:{j}".encode()).hexdigest()
        u = int(digest[:13], 16) / (1 << 52)
        p = c = math.exp(-mean)
        k = 0
        while c <= u and k < 63:
            k += 1
            p = p * mean / k
            c += p
        total += k if c > u else k + 1
    return total


def sources(spark, sizes):
    rows, at = [], 0
    for source, n in sizes.items():
        rows += [(at + k, f"text {at + k}", "en", source, 1) for k in range(n)]
        at += n
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_mix_draws_equal_brute_force(spark):
    docs = sources(spark, {"hot": 600, "b": 90, None: 30, "one": 1})
    rates = {r.source: r.rate for r in tempered_rates(docs).collect()}
    roots = {s: math.sqrt(n) for s, n in {"hot": 600, "b": 90, None: 30, "one": 1}.items()}
    for s, n in {"hot": 600, "b": 90, None: 30, "one": 1}.items():
        assert rates[s] == pytest.approx(roots[s] / sum(roots.values()) * 721 / n)
    rows = mix_sources(docs, tempered_rates(docs)).collect()
    copies = Counter(r.doc_id for r in rows)
    expected = {r.doc_id: poisson_draw(r, rates[r.source]) for r in docs.collect()}
    assert copies == {i: n for i, n in expected.items() if n}
    assert {(r.doc_id, r.copy) for r in rows} == {(i, k) for i, n in expected.items() for k in range(n)}


def test_mix_reaches_explicit_weights(spark):
    docs = sources(spark, {"a": 4000, "b": 1000, "c": 500, "unnamed": 50})
    rates = weighted_rates(docs, {"a": 1.0, "b": 1.0, "c": 2.0, "absent": 0.0}, total=8000)
    got = Counter(r.source for r in mix_sources(docs, rates).select("source").collect())
    for source, share in {"a": 2000, "b": 2000, "c": 4000}.items():
        assert abs(got[source] - share) < 5 * math.sqrt(share)
    assert got["unnamed"] == 0
    large = weighted_rates(docs, {"unnamed": 1.0}, total=50_000)  # a mean of 1000 a document
    assert abs(mix_sources(docs, large).count() - 50_000) < 1200
    with pytest.raises(ValueError):
        weighted_rates(docs, {"a": -1.0})


def test_mix_of_tricky_rows(spark):
    docs = docs_of(spark, TRICKY).withColumn("copy", F.lit("theirs")).withColumn("rate", F.lit("x"))
    mixed = mix_sources(docs, weighted_rates(docs, {"s": 1.0}, total=100))
    assert set(mixed.columns) == set(docs.columns) and mixed.schema["copy"].dataType.typeName() == "integer"
    rate, expected, seen = 100 / len(TRICKY), Counter(), Counter()
    for r in docs.drop("copy").collect():
        expected[r.doc_id, r.text] += poisson_draw(r, rate, seen[r])
        seen[r] += 1
    assert Counter((r.doc_id, r.text) for r in mixed.collect()) == +expected
    plain = mix_sources(docs, weighted_rates(docs, {"s": 1.0}), copy_column=None)
    assert plain.columns == docs.columns
    empty = docs.limit(0)
    assert mix_sources(empty, tempered_rates(empty)).count() == 0


@pytest.mark.parametrize("doc_id", [None, 7])
def test_mix_draws_apart_without_ids(spark, doc_id):
    """Rows that share an id, and equal rows, draw on their own: the target is met within 5 deviations."""
    docs = sources(spark, {"a": 3000}).withColumn("doc_id", F.lit(doc_id).cast("long"))
    same = docs.withColumn("text", F.lit("same"))
    for rows, seed, wanted in ((docs, 1, 1500), (same, 2, 1500), (docs.union(same), 3, 9000)):
        got = mix_sources(rows, weighted_rates(rows, {"a": 1.0}, total=wanted), seed=seed)
        assert abs(got.count() - wanted) < 5 * math.sqrt(wanted)
    assert mix_sources(docs, tempered_rates(docs)).select("text").distinct().count() > 1700  # 1896 expected


def test_matrix_rows_have_the_drawn_sums_and_are_uniform():
    counts, sizes = np.array([50, 0, 30, 20]), block_sizes(100, 7)[0]
    rows = np.array([matrix_row(sizes, counts, k, 3) for k in range(4)])
    assert rows.sum(axis=1).tolist() == counts.tolist() and rows.sum(axis=0).tolist() == sizes.tolist()
    cells = np.array([matrix_row(sizes, counts, 0, s)[0] for s in range(3000)])
    n, k, m = 100, int(sizes[0]), 50
    mean = m * k / n
    variance = mean * (1 - k / n) * (n - m) / (n - 1)
    assert abs(cells.mean() - mean) < 5 * math.sqrt(variance / 3000)
    assert cells.var() == pytest.approx(variance, rel=0.15)


@pytest.mark.parametrize("block_rows", [50_000, 40])
def test_shards_are_exact_and_gapless(spark, folder, block_rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("slot", F.lit("theirs"))
    docs = docs.union(docs).union(docs.limit(37))
    total = docs.count()
    rows = shard_rows(docs, 7, source_rows=50, block_rows=block_rows).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == total and set(slots) == set(range(7))
    assert {len(s) for s in slots.values()} <= {total // 7, total // 7 + 1}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())
    again = {(r.doc_id, r.shard, r.slot) for r in shard_rows(docs.repartition(5), 7, source_rows=50, block_rows=block_rows).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}  # arrival order does not matter


def test_shards_spread_neighbours_and_copies(spark):
    docs = sources(spark, {"a": 4000}).withColumn("doc_id", F.col("doc_id") % 50).withColumn("text", F.lit("same"))
    rows = shard_rows(docs, 8, source_rows=500).collect()
    per = Counter((r.doc_id, r.shard) for r in rows)
    assert all(0 < per[i, s] < 30 for i in range(50) for s in range(8))  # 10 expected
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert sum(a == b for a, b in zip(order, order[1:])) < 200  # 80 expected


def test_few_or_no_rows_leave_shards_empty(spark):
    rows = shard_rows(docs_of(spark, TRICKY), 40).collect()
    assert len(rows) == len(TRICKY) and {r.slot for r in rows} == {0}
    assert shard_rows(docs_of(spark, []), 40).count() == 0


def slow_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


def slow_rule(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


URLS = [
    None, "", "no scheme", "http://", "https://ORG/", "https://a.org", "https://a.org?x=/y", "x://y://example.org/es/1",
    "https://notexample.org/es/", "https://m.example.org/es/1#t", "https://example.org/en/12?q", "http://x.com/de/",
    "http://com/fr/", "http://x.com/fr", "http://É.COM/de/é", "http://casino.example.net/\n/x", "ftp://u@h:21/p",
]


def test_url_parts_and_rules_equal_brute_force(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    extra = spark.createDataFrame([(None if u is None else 10_000 + k, u) for k, u in enumerate(URLS)], "page_id long, url string")
    both = pages.union(extra).union(extra).withColumn("host", F.lit(1)).withColumn("verdict", F.lit(1))
    labelled = spark.createDataFrame([("http://casino-win.com/x", 1), ("http://bets.com/", 1), ("http://school.edu/a", 0), ("http://news.net/b", 0), (None, 0), ("x", None)], "url string, block int")
    rows = filter_urls(both, queries.RULES, fit_url_model(labelled)).collect()
    assert len(rows) == both.count()
    expected = Counter()
    for r in both.collect():
        host, path = slow_parts(r.url)
        rule = slow_rule(host, path, queries.RULES)
        expected[r.page_id, host, path, rule and rule.text, rule and rule.verdict] += 1
    got = Counter((r.page_id, r.host, r.path, r.rule, r.rule and r.verdict) for r in rows)
    assert got == expected
    assert {r.verdict for r in rows} <= {"allow", "block"}


def test_url_model_learns_held_out_hosts(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(8))
    urls = [(f"https://{rng.choice(['casino', 'pills']) + '-' if k % 3 == 0 else ''}{word()}.net/{word()}", int(k % 3 == 0)) for k in range(900)]
    table = spark.createDataFrame(urls, "url string, block int").withColumn("page_id", F.lit(1))
    model = fit_url_model(table.limit(600))
    test = table.offset(600)
    rows = filter_urls(test.withColumn("page_id", F.col("block")), (), model).collect()
    right = sum((r.verdict == "block") == (r.page_id == 1) for r in rows)
    assert right >= 0.97 * len(rows)


def test_url_model_learns_a_class_of_one_in_a_thousand(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(8))
    urls = [(k, f"https://{'casino-' if k % 1000 == 0 else ''}{word()}.net/{word()}", int(k % 1000 == 0)) for k in range(8000)]
    table = spark.createDataFrame(urls, "page_id long, url string, block int")
    rows = filter_urls(table, (), fit_url_model(table, sample=100)).collect()
    assert {r.page_id for r in rows if r.verdict == "block"} == {k for k, _, block in urls if block}


def test_ngrams_equal_brute_force_and_long_urls_are_judged_whole(spark):
    texts = [("a.b", ""), ("", "/x\ny"), ("é", "/ü/" + "z" * 9), ("", "")]
    rows = spark.createDataFrame(texts, "host string, path string")
    for r in rows.select("host", "path", ngrams(F.col("host"), F.col("path")).alias("grams")).collect():
        expected = [
            mark + text[i : i + n]
            for mark, text in (("h", f"^{r.host}$"), ("p", f"^{r.path}$")) for n in (3, 4, 5) for i in range(len(text) - n + 1)
        ]
        assert r.grams == expected
    draw = random.Random(5)
    urls = ["http://a.net/" + "".join(draw.choices("abcdefgh/", k=k)) for k in (12_000, 100_000)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labelled = spark.createDataFrame([("http://casino.com/x", 1), ("http://school.edu/a", 0)], "url string, block int")
    model = fit_url_model(labelled)
    started = time.monotonic()
    got = {r.page_id: r.path for r in filter_urls(pages, (), model).collect()}
    assert time.monotonic() - started < 20
    assert got == {k: url[len("http://a.net") :] for k, url in enumerate(urls)}


def test_url_models_without_examples(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    none = fit_url_model(spark.createDataFrame([], "url string, block int"))
    one = fit_url_model(spark.createDataFrame([("http://x/", 1)], "url string, block int"))
    assert [r.verdict for r in filter_urls(pages, (), none).collect()] == ["allow"]
    assert [r.verdict for r in filter_urls(pages, (), one).collect()] == ["block"]
    assert filter_urls(pages.limit(0), (Rule("allow", "b", "/"),), one).count() == 0


PAGES = [
    (1, "http://a/", "<p>é</p>"), (2, "http://b/", "<p>é</p>"), (3, None, None), (4, "http://d/\r\nX: y", ""),
    (5, "http://e/", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 50), (6, "http://f/", "x" * 3_000_000),
    (7, "http://g/", "".join(map(chr, range(0x20, 0x3000)))), (8, "u", "same"), (8, "u", "same"), (9, "u", "other"), (9, "u", "other"),
    (None, "u", "lonely"), (None, "u", "<p>é</p>"), (None, "u", "twice"), (None, "u", "twice"),
]


def slow_warc(rows, least=0):
    groups = defaultdict(list)
    for i, _, html in rows:
        groups[(html or "").encode()].append(i)
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        first = max((k for k in groups[raw] if k is not None), default=None)
        other = len(raw) >= least and i != first
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((i, len(raw), digest, "revisit" if other else "response", first if other else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least, split, archive", [(0, 1 << 24, 1 << 30), (0, 700, 4000), (10, 1, 1 << 30)])
def test_warc_round_trip(spark, least, split, archive):
    rows = PAGES if split > 1 else PAGES[:5]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(2)
    manifest = warc.write_warc(pages, scratch_path(spark, "w"), least, archive)
    read = warc.read_warc(manifest, split).collect()
    got = sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read], key=str)
    assert got == slow_warc(rows, least)
    for r in read:
        assert (r.payload is None) == (r.record_type == "revisit")
        assert r.payload is None or len(r.payload) == r.payload_bytes
    assert len({(r.path, r.offset) for r in read}) == len(rows)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)


def test_warc_keeps_long_headers_and_counts_records(spark):
    url = "http://a/" + "".join(random.Random(4).choices("abcdefgh", k=1_200_000))
    pages = spark.createDataFrame([(1, url, "x"), (2, "http://b/", "y")], "page_id long, url string, html string")
    manifest = warc.write_warc(pages.coalesce(1), scratch_path(spark, "w"))
    assert {r.page_id: r.url for r in warc.read_warc(manifest).collect()} == {1: url, 2: "http://b/"}
    with pytest.raises(ValueError, match="2 records in archives of 3"):
        warc.read_warc(manifest.withColumn("records", F.lit(3)))


def test_warc_of_nothing(spark):
    manifest = warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), scratch_path(spark, "w"))
    assert manifest.count() == 0 and warc.read_warc(manifest).count() == 0


def test_false_members_are_not_records():
    record = warc.make_record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    fake = zlib.compressobj(6, zlib.DEFLATED, 31)
    other = fake.compress(b"WARC/1.0 but no header at all") + fake.flush()
    torn = record[: len(record) // 2]
    data = b"\x1f\x8b\x08junk" + other + record + torn + b"\x1f\x8b\x08" + record
    found = [at for at, _ in warc.members(pa.BufferReader(data), 0, len(data))]
    start = data.index(record)
    assert found == [start, len(data) - len(record)]
    for cut in range(0, len(data) + 1, 7):
        halves = [a for lo, hi in ((0, cut), (cut, len(data))) for a, _ in warc.members(pa.BufferReader(data), lo, hi)]
        assert halves == found
    assert list(warc.members(pa.BufferReader(b""), 0, 0)) == []


def test_archive_is_plain_gzip(spark):
    pages = spark.createDataFrame(PAGES[:4], "page_id long, url string, html string").coalesce(1)
    path = warc.write_warc(pages, scratch_path(spark, "w")).first().path
    import gzip

    with open(path.removeprefix("file://"), "rb") as raw:
        text = gzip.GzipFile(fileobj=io.BytesIO(raw.read())).read()
    assert text.count(b"WARC/1.1\r\n") == 4 and text.startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    out, before = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, folder).persist()
        if name != "sharding":
            assert after.columns == docs.columns
        out[name] = [r.doc_id for r in after.select("doc_id").collect()]
        before = after
    ids = [r.doc_id for r in docs.collect()]
    assert set(out["near_duplicates"]) <= set(out["toxicity"]) <= set(ids)
    assert len(out["near_duplicates"]) == len(set(out["near_duplicates"]))
    assert set(out["mixing"]) <= set(out["decontamination"]) < set(out["near_duplicates"])
    assert Counter(out["sharding"]) == Counter(out["mixing"])
    final = corpus_pipeline.run(spark, folder)
    assert Counter(r.doc_id for r in final.collect()) == Counter(out["sharding"])


def test_pipeline_of_tricky_and_no_rows(spark, folder):
    for pairs in (TRICKY, []):
        docs = docs_of(spark, pairs)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
        docs.collect()


def test_mix_query_and_registered_names(spark, folder):
    rows = queries.op3_mix(spark, folder).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert all(r.text_md5 == hashlib.md5(docs[r.doc_id].text.encode()).hexdigest() for r in rows)
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)] + ["pipeline"]


def test_draws_beyond_numpys_bound_follow_the_same_law(monkeypatch):
    good, bad, taken = 3_000, 9_000, 2_000
    plain = np.random.default_rng(1).hypergeometric(good, bad, taken, size=4000)
    monkeypatch.setattr(sharding, "NUMPY_BOUND", 0)
    rng = np.random.default_rng(2)
    drawn = np.array([sharding.hypergeometric(rng, good, bad, taken) for _ in range(4000)])
    assert drawn.mean() == pytest.approx(plain.mean(), abs=1.5)
    assert drawn.std() == pytest.approx(plain.std(), rel=0.06)
    # the ends: nothing to choose
    assert sharding.hypergeometric(rng, 5, 0, 3) == 3
    assert sharding.hypergeometric(rng, 0, 5, 3) == 0
    assert sharding.hypergeometric(rng, 4, 5, 9) == 4
    rows = np.array([sharding.matrix_row(np.array([30, 30, 40]), np.array([50, 0, 20, 30]), k, 7) for k in range(4)])
    assert rows.sum(axis=0).tolist() == [30, 30, 40] and rows.sum(axis=1).tolist() == [50, 0, 20, 30]


def test_matrix_of_a_hundred_terabytes_is_bounded():
    total = 20_000_000_000
    sizes, per = block_sizes(total, 40)
    assert len(sizes) == 40 * per <= sharding.MOST_BLOCKS and sizes.sum() == total
    by_shard = sizes.reshape(40, per).sum(axis=1)
    assert by_shard.max() - by_shard.min() <= 1
    left = np.array([total // 40] * 40)
    drawn = sharding.draw_columns(np.random.default_rng(3), left, total // 2)
    assert drawn.sum() == total // 2 and (drawn <= left).all()
    assert np.abs(drawn - total // 80).max() < 200_000
