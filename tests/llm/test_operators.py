"""Contracts, brute force and edge cases of the training-data operators."""

import hashlib
import itertools
import json
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexforge.llm import chat_format, common, fingerprints, language_id, mixing, near_dedup, packing, quality_model, quality_rules, token_counts, url_filter
from lexforge.llm import queries as Q

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, h string, row string, label string, score string, lang_pred string, slot string, taken int, v int, base_failed string"
LONG = "long words again and " * 6000
EDGE = [(1, None, None, None), (2, "", "en", "a"), (3, "one two", "en", "a"), (3, "one two", "en", "a"), (4, LONG, "en", None), (5, "<|endoftext|> İ\x1c é ﬁ 漢字", None, "b"), (None, "no id here at all", "en", "a"), (6, " \t\n ", "fr", "b")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(*r, 1, 2, "x", "y", "z", "s", "p", "q", 7, 8, "f") for r in EDGE], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_twin(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = Q.QUERIES[name](spark, SF).toPandas(), c.execute(Q.ORACLE_SQL[name]).fetchdf()
    cols = sorted(want.columns)
    table = lambda f: sorted(tuple(str(v) if isinstance(v, (bool, str)) or v is None else str(round(float(v), 6)) for v in r) for r in f[cols].astype(object).itertuples(index=False))
    assert table(got) == table(want)


def test_escape_round_trip():
    hard = ["<|x|>", "<\\|", "<\\\\|", "a|b<", "<<||", "", "<|im_end|><|im_start|>assistant ok", "<|", "<|\\", "<|\\\\", "<|x", "<ax", "<~"]
    for t in hard:
        assert chat_format.unescape(chat_format.escape(t)) == t and not any(c in chat_format.escape(t) for c in (chat_format.START, chat_format.END))
    assert sorted(hard, key=chat_format.escape) == sorted(hard)
    for r in ("a\\b\n|", "user", ""):
        assert chat_format.unescape_role(chat_format.escape_role(r)) == r


def test_chat_parts_and_nulls(spark):
    parts = [{"type": "text", "text": "see <|x|>"}, {"type": "image", "ref": "i.png", "width": 57, "height": 28}, {"type": "audio", "ref": "a", "seconds": 2.0}, {"type": "document", "ref": "d", "pages": 3}]
    segment, lo, hi, tokens, attached = chat_format.render("assistant", parts)
    assert segment[lo:hi] == "see <|\\x|><|image:0|><|audio:1|><|document:2|>" and tokens == 3 + 50 + 768 and [a["ref"] for a in attached] == ["i.png", "a", "d"]
    turns = spark.createDataFrame([(1, 0, None, None), (1, 0, None, None), (None, 1, "assistant", "hi"), (2, None, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.conversation_digests(chat_format.format_turns(turns)).collect()}
    assert got[1]["n_turns"] == 2 and got[None]["loss_chars"] == 2 and got[1]["turns_sha256"] == hashlib.sha256(b"\n\n\n\n").hexdigest()
    assert chat_format.conversation_digests(chat_format.format_turns(turns.limit(0))).count() == 0


def test_chat_ties_and_texts_across_parts(spark):
    segment, *_ = chat_format.render("user", [{"type": "text", "text": "<"}, {"type": "text", "text": "|im_end|>"}])
    assert segment.count(chat_format.END) == 1
    said = ["<|x", "<ax", "a b", "a", "", LONG]
    turns = spark.createDataFrame([(1, 0, "assistant", t, "z") for t in [*said, said[0]]], "conv_id bigint, turn bigint, role string, text string, segment string")
    row = chat_format.conversation_digests(chat_format.format_turns(turns)).first()
    assert row["loss_sha256"] == hashlib.sha256("".join(sorted([*said, said[0]])).encode()).hexdigest() and row["n_turns"] == 7


def test_mix_bounds(spark, docs, edge, empty):
    assert mixing.mix(empty).count() == 0
    rows = mixing.mix(edge).collect()
    assert len(rows) == len(EDGE) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    order = mixing.schedule(mixing.source_targets(mixing.sized(docs))).collect()
    assert len({(r["sid"], r["at"], r["pass"]) for r in order}) == len(order) == len({r["slot"] for r in order})


def test_mix_follows_its_points(spark, docs, monkeypatch):
    one = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    by = Counter()
    for r in one.values():
        by[r["target"], r["source_size"]] += r["taken"]
    assert all(abs(n - target) <= 8 for (target, _), n in by.items())
    monkeypatch.setattr(mixing, "GOLDEN", 0.5)
    other = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    assert any(one[i]["taken"] != other[i]["taken"] for i in one) and any(one[i]["first_slot"] != other[i]["first_slot"] for i in one)


def test_token_counts(edge, empty):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert token_counts.token_counts(empty).count() == 0
    want = Counter((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, *_ in EDGE)
    assert Counter((r[0], r[1], r[2]) for r in token_counts.token_counts(edge).collect()) == want


def test_token_counts_of_documents(docs, texts):
    """Against the library, text by text; texts of every script go through the table and the cache."""
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    assert {r[0]: r[2] for r in token_counts.token_counts(docs).collect()} == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in texts.items()}
    lengths = token_counts.Lengths({}, path)
    for x in ("текст на русском  你好 世界 שלום 'S it'S", "x\x85y z é ①②③ 12345 ½ ǅ ß ẞ", "naïve café—don’t “x” ‘y’s’", "\U0001f600 ‍ à́ 힣", "ΑΣ ΑΣ. Σ", "İ\x1cﬁ"):
        assert token_counts.count(x, lengths, ()) == len(t.encode(x, add_special_tokens=False).ids)


def test_url_shrinkage(spark):
    """A host of one bad page under a domain of bad hosts is blocked, one under a clean domain is not."""
    rows = [(f"http://h{h}.bad.example/p{i}", "!!") for h in range(8) for i in range(6)] + [(f"http://h{h}.good.example/p{i}", "ok") for h in range(8) for i in range(6)]
    rows += [("http://new.bad.example/x", "!!"), ("http://new.good.example/x", "!!"), ("http://unseen.bad.example/x", None)] + [(f"http://a{h}.co.uk/{i}", "ok" if h else "!!") for h in range(2) for i in range(20)]
    pages = spark.createDataFrame([(i, u, h, "clash", 1) for i, (u, h) in enumerate(rows)], "page_id bigint, url string, html string, host string, bad int")
    got = {r["host"]: r["verdict"] for r in url_filter.judge_urls(pages).collect()}
    assert got["new.bad.example"] == got["unseen.bad.example"] == "block" and got["new.good.example"] == "allow" and got["h3.good.example"] == "allow"
    assert got["a0.co.uk"] == "block" and got["a1.co.uk"] == "allow"
    assert url_filter.judge_urls(spark.createDataFrame([(1, "http://x.org/" + "long" * 50_000, "ok")], "page_id bigint, url string, html string")).first()["host"] == "x.org"


@pytest.mark.parametrize("x, a, b", [(0.1, 0.7, 9.3), (0.1, 3.0, 2.0), (0.5, 40.0, 55.0), (0.1, 120.0, 900.0)])
def test_beta_cdf(spark, x, a, b):
    got = spark.createDataFrame([(a, b)], "a double, b double").select(url_filter._beta_cdf(x, "a", "b")).first()[0]
    t = (np.arange(2_000_000) + 0.5) / 2_000_000
    log = (a - 1) * np.log(t) + (b - 1) * np.log1p(-t)
    f = np.exp(log - log.max())
    assert abs(got - f[t < x].sum() / f.sum()) < 2e-3 * (1 if a < 1 else 0.01)


def test_url_edges(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "no scheme", "x"), (3, "http://A.example.ORG/es/1?q", "x"), (4, "http://example.org/en/12", None), (5, "https://org?x=/", "y"), (None, "ftp://10.0.0.1:8/p#f", "z")], "page_id bigint, url string, html string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge_urls(pages).collect()}
    assert got[1][:3] == ("", "", None) and got[3] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[4][2:] == ("example.org/en/1", "block") and got[5][:3] == ("org", "", None) and got[None][:2] == ("10.0.0.1:8", "/p")
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def brute_base(text):
    text = text or ""
    words = text.encode().split()
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_base(spark, docs, edge, empty, texts):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for r in quality_rules.base_stats(docs, ["doc_id"]).select("row.doc_id", *names).collect():
        assert tuple(r)[1:] == brute_base(texts[r["doc_id"]])
    got = Counter(tuple(r) for r in quality_rules.judge_quality(edge, ["doc_id"]).select("row.doc_id", *names).collect())
    assert got == Counter((i, *brute_base(x)) for i, x, *_ in EDGE)
    assert quality_rules.judge_quality(empty, empty.columns).count() == 0


def test_mcd_rejects_outliers(spark):
    rng = np.random.default_rng(1)
    rows = [("=a", "=b", [5 + float(x), 1.5, 0.0, 0.0, 0.0, 0.0, 0.0]) for x in rng.normal(0, 0.3, 300)] + [("=a", "=b", [5.0, 1.5, 3.0, 0.0, 0.0, 0.0, 0.0])] * 30
    frame = spark.createDataFrame(rows, "g string, s string, v array<double>")
    far = quality_rules._filtered_distances(frame, quality_rules.robust_model(frame, quality_rules.Groups(1)), ("g", "s")).select("v", "d2", "bad_side").collect()
    assert all((r["d2"] > quality_rules.CUT and r["bad_side"]) == (r["v"][2] == 3.0) for r in far)


@pytest.mark.parametrize("junk", [0.27, 0.4, 0.45])
def test_mcd_withstands_alike_junk(spark, junk):
    rng = np.random.default_rng(3)
    n = int(1000 * junk)
    clean = [[5 + float(x), 1.5 + float(y), 0.0, abs(float(z)), 0.0, 0.0, 0.0] for x, y, z in rng.normal(0, (0.3, 0.1, 0.2), (1000 - n, 3))]
    spam = [[5 + float(x), 1.5, 3 + float(y), 0.0, 0.0, 0.0, 0.0] for x, y in rng.normal(0, (0.3, 0.05), (n, 2))]
    frame = spark.createDataFrame([("=a", "=b", v) for v in clean + spam], "g string, s string, v array<double>")
    far = quality_rules._filtered_distances(frame, quality_rules.robust_model(frame, quality_rules.Groups(1)), ("g", "s")).select("v", "d2", "bad_side").collect()
    assert all((r["d2"] > quality_rules.CUT and r["bad_side"]) == (r["v"][2] > 2) for r in far)


def brute_mcd(v):
    """Minimum covariance determinant of rows v by numpy: three starts to convergence, the least determinant, reweighted."""
    n, d = v.shape
    floors = np.diag(np.square(list(quality_rules.STATS.values())))

    def estimate(x, factor):
        m = x.mean(0)
        return m, factor * ((x.T @ x) / len(x) - np.outer(m, m)) + floors

    def far(x, m, c):
        y = np.linalg.solve(np.linalg.cholesky(c), (x - m).T)
        return (y * y).sum(0)

    lower = lambda x: np.sort(x, axis=0)[-(-len(x) // 2) - 1]
    c = lower(v)
    a = np.sqrt((1.4826 * lower(np.abs(v - c))) ** 2 + np.diag(floors))
    z = (v - c) / a
    size = (z * z).sum(1)
    starts = [size, far(v, *estimate(c + a * np.tanh(z), 1.0)), far(v, *estimate(c + a * z * np.sqrt(d / np.maximum(size, 1e-12))[:, None], 1.0))]
    at = int(min(np.ceil(100 * (n + d + 1) / n), 200)) - 100
    share, factor = quality_rules.SHARES[at], quality_rules.FACTORS[at]
    best = None
    for d2 in starts:
        was = None
        while True:
            m, cov = estimate(v[d2 <= np.sort(d2)[max(0, int(np.ceil(share * n)) - 1)]], factor)
            det = np.linalg.slogdet(cov)[1]
            if best is None or det < best[0]:
                best = (det, m, cov)
            if was is not None and was - det <= quality_rules.STILL:
                break
            was, d2 = det, far(v, m, cov)
    return estimate(v[far(v, *best[1:]) <= quality_rules.NEAR], quality_rules.NEAR_FACTOR)


def test_kept_by_numpy(spark, docs):
    """On sf0.001 every group is small: pools by language, then of all such, judge."""
    rows = quality_rules.base_stats(docs, ["doc_id"]).select("row.doc_id", "lang", "base_failed", "v").collect()
    kept = {r[0]: r[1] for r in quality_rules.judge_quality(docs, ["doc_id"]).select("row.doc_id", "kept").collect()}
    good = [r for r in rows if not r["base_failed"]]
    n = Counter(r["lang"] for r in good)
    pool = lambda r: r["lang"] if n[r["lang"]] >= quality_rules.LEAST else "*"
    size = Counter(map(pool, good))
    groups = {p: [r for r in good if pool(r) == p] if size[p] >= quality_rules.LEAST else good for p in {*size, *map(pool, rows)}}
    models = {p: brute_mcd(np.array([r["v"] for r in g])) for p, g in groups.items()}
    floor = np.array(list(quality_rules.STATS.values()))
    either = np.array([k in quality_rules.EITHER for k in quality_rules.STATS])
    for r in rows:
        m, c = models[pool(r)]
        off = np.array(r["v"]) - m
        bad = (np.where(either, np.abs(off), off) > 3 * floor).any()
        assert kept[r["doc_id"]] == (not r["base_failed"] and not (bad and off @ np.linalg.solve(c, off) > quality_rules.CUT))


NOUNS = "river stone harbour winter garden letter market bridge window teacher forest journey morning kitchen village"


def prose(rng, n):
    return " ".join(rng.choice(NOUNS.split(), n))


@pytest.mark.parametrize("others", [0, 300])
def test_small_pools_are_judged(spark, others):
    """An outlier in a language of 40 rows, alone or beside a large group, is rejected as one in a large pool is."""
    rng = np.random.default_rng(4)
    rows = [(i, prose(rng, 80), "en" if i < others else "xx", "a") for i in range(others + 39)]
    rows.append((-1, " ".join(w + " ####" for w in prose(rng, 80).split()), "xx", "a"))
    rows.append((-2, " ".join(w + " ####" for w in prose(rng, 80).split()), None, None))
    kept = {r[0]: r[1] for r in quality_rules.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), ["doc_id"]).select("row.doc_id", "kept").collect()}
    assert len(kept) == len(rows) and all(k == (i >= 0) for i, k in kept.items())


def test_word_length_alone_rejects(spark):
    rng = np.random.default_rng(5)
    rows = [(i, prose(rng, 80), "en", "a") for i in range(300)]
    rows.append((-1, " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 64)) for _ in range(80)), "en", "a"))
    rows.append((-2, " ".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 80)), "en", "a"))
    rows.append((-3, prose(rng, 20000).replace("river", "brook"), "en", "a"))
    got = {r[0]: r for r in quality_rules.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), ["doc_id"]).select("row.doc_id", "kept", "d2", "base_failed").collect()}
    assert all(got[i]["d2"] > quality_rules.CUT and not got[i]["base_failed"] for i in (-1, -2, -3))
    assert all(r["kept"] == (i >= 0) for i, r in got.items())


def test_quality_model(spark, edge, empty):
    rows = Q.op6_quality_model(spark, SF.replace("0.001", "0.01")).collect()
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(SF.replace("0.001", "0.01") + "/labels.parquet").collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r["score"] for r in quality_model.score_documents(edge, none).collect()} == {0.5}
    assert quality_model.score_documents(empty, none).count() == 0


def test_quality_model_by_numpy(spark, docs):
    """The normal equations summed by partitions against one product over all labelled rows."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    stats = {r["doc_id"]: quality_model.statistics(r["text"] or "") for r in docs.collect()}
    ids = sorted(truth.keys() & stats.keys())
    x, y = np.array([stats[i] for i in ids]), np.array([float(truth[i]) for i in ids])
    f = quality_model.Fourier(x.mean(0), x.std(0))
    z = f(x)
    ridge = np.full(z.shape[1], quality_model.RIDGE * np.sqrt(len(y)) / quality_model.FEATURES)
    ridge[0] = 0
    w = np.linalg.solve(z.T @ z + np.diag(ridge), z.T @ y)
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y double")
    model = quality_model.fit(rows)
    assert np.allclose(model.weights, w, atol=1e-6) and (np.diff(model.levels) >= -1e-12).all()
    got = {r["doc_id"]: r["score"] for r in quality_model.score_documents(docs, labels).collect()}
    assert all(abs(got[i] - model.score(stats[i][None])[0]) < 1e-6 for i in stats)


def test_language(spark, docs, edge, empty):
    rows = language_id.identify(docs, carry=True).select("lang", "lang_pred").collect()
    assert np.mean([r[0] == r[1] for r in rows]) > 0.95
    got = language_id.identify(edge).collect()
    assert len(got) == len(EDGE) and all(r["lang_pred"] == "und" for r in got if r["doc_id"] in (1, 2, 6))
    assert language_id.identify(empty).count() == 0


def test_language_carries_columns(spark, docs, edge):
    assert language_id.identify(docs, carry=True).columns == [*docs.columns, "lang_pred", "score"]
    got = language_id.identify_rows(edge, [edge[c] for c in edge.columns])
    assert got.columns == ["row", "lang_pred", "score"] and got.select("row.*").columns == edge.columns


def test_tables_of_the_estimate_release_the_driver(spark):
    """Each written table of the estimate ends with a full collection on the driver."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    groups, before = quality_rules.Groups(1), full()
    assert groups.cut(spark.range(3).toDF("x"), "test-release").count() == 3 and full() > before


def test_release_gives_native_memory_back(spark):
    """Freed blocks below ones in use: a collection leaves them in the C library, release() does not."""
    jvm = spark._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status")
    mb = lambda: int(re.search(r"VmRSS:\s+(\d+)", status.read_text())[1]) // 1024
    held = [jvm.java.util.zip.Deflater() for _ in range(800)]  # about 0.26 MB each, outside the heap
    for k, x in enumerate(held):
        if k % 10 != 9:
            x.end()
    jvm.System.gc()
    before = mb()
    common.release(spark)
    after = mb()
    for x in held[9::10]:
        x.end()
    assert after < before - 60


def test_gradient():
    net = language_id.Network(["a", "b"])
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 5, (6, 3)), np.array([0, 1, 0])
    loss = lambda: -np.log(net.positions(x)[:, y, np.arange(3)]).mean()
    for own, grad in net.step(x, y):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        old = own[at]
        own[at] = old + 1e-2
        up = loss()
        own[at] = old - 1e-2
        down = loss()
        own[at] = old
        assert abs((up - down) / 2e-2 - grad[at]) < 0.05 * abs(grad[at]) + 1e-3


def test_near_dedup_edges(spark, edge, empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    rows = near_dedup.near_duplicates(edge).collect()
    assert len(rows) == len(EDGE) and all(r["n_shingles"] == 0 and r["kept"] for r in rows if r["doc_id"] in (1, 2, 6))
    assert [r["n_shingles"] for r in rows if r["doc_id"] == 3] == [1, 1]


def test_repeated_ids_link_their_classes(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (5, b), (7, a), (9, b), (3, "other words of their own here"), (None, a)]
    got = sorted(((r["doc_id"] or 0, r["component_id"] or 0) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(0, 0), (3, 3), (5, 5), (5, 5), (7, 5), (9, 5)]


def test_planted_pairs(spark):
    """Pairs of 300 shingles from similarity 0.78 to 0.85, among them a family of one original: links as by full sets."""
    rng = np.random.default_rng(8)
    rows, sets = [], {}
    for k in range(300):
        words = [f"p{k if k < 250 else 0}x{i}" for i in range(303)]
        other = words.copy()
        for at in rng.choice(np.arange(0, 300, 4), int(rng.integers(7, 11)), replace=False):
            other[at] = f"q{k}y{at}"
        for j, w in enumerate((words, other)):
            rows.append((2 * k + j, " ".join(w)))
            sets[2 * k + j] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)}
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    same = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    pairs = [(2 * k, 2 * k + 1) for k in range(1, 250)]
    above = [p for p in pairs if same(*p)]
    assert len(above) > 100 and len(pairs) - len(above) > 50
    assert sum(got[b] == a for a, b in above) >= 0.99 * len(above) and all(got[b] == b for a, b in set(pairs) - set(above))
    assert all(got[2 * k + 1] == 0 for k in range(250, 300) if same(0, 2 * k + 1))


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (103, 102)], "a bigint, b bigint")
    got = {r["id"]: r["component"] for r in near_dedup.components(edges).collect()}
    assert {got[i] for i in range(2, 41)} == {1} and {got[i] for i in (101, 102, 103)} == {100}


def test_packing(edge, docs, empty, texts):
    assert packing.pack(empty).count() == 0
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs).collect()
    ids = {i: np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4") for i, x in texts.items()}
    seen, bins = Counter(), {}
    for r in rows:
        assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        seen[r["doc_id"]] += r["length"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(seen[i] == len(x) for i, x in ids.items())
    for b in bins.values():
        assert all(o == sum(n for _, n in sorted(b)[:k]) for k, (o, _) in enumerate(sorted(b))) and sum(n for _, n in b) <= 1024
    assert len(bins) <= 1.03 * sum(seen.values()) / 1024 + 1
    assert Counter(r["doc_id"] for r in packing.pack(edge).where("piece = 0").collect()) == Counter(i for i, *_ in EDGE)


def test_packing_ids(texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.by_rank(path) is not None
    hard = [*texts.values(), *(x or "" for _, x, *_ in EDGE), " " * 2_000_000 + "a", "é ² ¼'s don't  x\t\n y\r\n _a_9 " * 50, "a" * 50_000, "\n" * 9, "x\x1c\x85\xa0y"]
    for text in hard:
        assert packing.token_bytes(text, path, True, ("<|endoftext|>",)) == packing.encode(text, path)


def test_packing_refuses_merges_out_of_order(tmp_path):
    """Merges (a, b), (b, c) with the token bc before ab: by rank, abc would be a, bc."""
    vocab = {c: i for i, c in enumerate(("a", "b", "c", "bc", "ab"))}
    made = {"version": "1.0", "added_tokens": [], "model": {"type": "BPE", "vocab": vocab, "merges": ["a b", "b c"]}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}
    (tmp_path / "t.json").write_text(json.dumps(made))
    assert packing.by_rank(str(tmp_path / "t.json")) is None


def plain_sketch(text):
    """Locally consistent parsing symbol by symbol, without numpy: the least name of each bin over all levels."""
    mask = 0xFFFFFFFF

    def mix(x):
        x ^= x >> 16
        x = x * 0x7FEB352D & mask
        x ^= x >> 15
        x = x * 0x846CA68B & mask
        return x ^ x >> 16

    def toss(x, before, bits):
        low = (x ^ before) & -(x ^ before)
        return 2 * (low.bit_length() - 1) + (x & low != 0) if low else 2 * bits

    def labels(x, widths):
        for bits in widths:
            x = [toss(s, x[i - 1] if i else ~s & (1 << bits) - 1, bits) for i, s in enumerate(x)]
        return x

    def phrases(x, label, level):
        at = [i for i in range(len(x)) if i == 0 or i < len(x) - 1 and label[i - 1] < label[i] > label[i + 1]]
        out = []
        for a, b in zip(at, [*at[1:], len(x)], strict=True):
            total = 0
            for v in reversed(x[a:b]):
                total = (total * 0x2545F491 + v) & mask
            out.append(mix((total + (b - a) * 0x27D4EB2F + level) & mask))
        return out

    bins = [mask] * fingerprints.BINS
    raw = list(text.encode())
    if not raw:
        return bins
    x = phrases([mix((b + 1) * 0x9E3779B9 & mask) for b in raw], labels(raw, (8, 5, 5)), 0)
    for level in range(1, fingerprints.LEVELS):
        for s in x:
            h = mix((s + 0x85EBCA6B * level) & mask)
            k = h % fingerprints.BINS
            bins[k] = min(bins[k], mix(h) & 0xFFFFFFFE)
        runs = [(s, len(list(g))) for s, g in itertools.groupby(x)]
        x = [mix((s + n * 0xC2B2AE35) & mask) if n > 1 else s for s, n in runs]
        if len(x) == 1:
            break
        x = phrases(x, labels(x, (32, 8, 8)), level)
    return bins


def test_fingerprints_symbol_by_symbol(docs, texts):
    rows = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(docs).collect()}
    order = sorted(texts, reverse=True)
    for i, after in list(zip(order, order[1:] + order[:1], strict=True))[::10]:
        k = len(texts[i]) // 3
        changed = texts[i][: len(texts[i]) - k] + texts[after][:k]
        a, b, c = plain_sketch(texts[i]), plain_sketch(changed), plain_sketch(texts[after])
        share = lambda p, q: (sum(u == v != 0xFFFFFFFF for u, v in zip(p, q, strict=True)) / max(1, sum((u, v) != (0xFFFFFFFF, 0xFFFFFFFF) for u, v in zip(p, q, strict=True))))
        assert rows[i]["fingerprint"] == "".join(f"{u:08x}" for u in a) and rows[i]["edited_fingerprint"] == "".join(f"{u:08x}" for u in b)
        assert rows[i]["near_edited"] == pytest.approx(share(a, b)) and rows[i]["near_next"] == pytest.approx(share(a, c))


def test_fingerprints(edge, docs, empty, texts):
    assert fingerprints.fingerprint_documents(empty).count() == 0
    assert Counter(r["doc_id"] for r in fingerprints.fingerprint_documents(edge).collect()) == Counter(i for i, *_ in EDGE)
    order = sorted(texts, reverse=True)
    rows = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(docs).collect()}
    for i, after in zip(order, order[1:] + order[:1], strict=True):
        changed = fingerprints.edited(texts[i], texts[after])
        a, b, c = fingerprints.sketch([texts[i], changed, texts[after]])
        assert rows[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest() and rows[i]["fingerprint"] == fingerprints.hexed(a)
        assert rows[i]["near_edited"] == fingerprints.likeness(a[None], b[None])[0] and rows[i]["near_next"] == fingerprints.likeness(a[None], c[None])[0]


def test_shift_keeps_inside():
    rng = np.random.default_rng(3)
    body = "".join(rng.choice(list("abcdefgh "), 4000))
    a, b = fingerprints.sketch([body, "shift" + body])
    assert fingerprints.likeness(a[None], b[None])[0] > 0.9


def test_whole_bitmaps_never_exceed_the_difference():
    rng = np.random.default_rng(4)
    for n in (1, 40, 300, 3000):
        a = rng.integers(0, 1 << 63, n, np.uint64)
        b = np.concatenate([a[n // 5 :], rng.integers(0, 1 << 63, n // 3, np.uint64)])
        x = near_dedup.parity(a, near_dedup.WHOLE_WORDS) ^ near_dedup.parity(b, near_dedup.WHOLE_WORDS)
        assert sum(int(w).bit_count() for w in x.view(np.uint64)) <= len(np.setxor1d(a, b))
