"""Language model, language ID, token counts, BPE, url filter and mixing against brute force on small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from featurelake.llm import bpe, language, language_model, mixing, queries, token_counts, url_filter
from featurelake.llm.common import crc_part, tokenizer_file
from featurelake.session import scratch_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, size string, score string, __row string"


def odd_documents(spark):
    """Nulls in each column, empty and white texts, repeated rows and ids, one very long text, clashing column names."""
    clash = ("x", "y", "z", "w")
    rows = [(1, "the cat sat on the mat", "en", "a", 22, *clash), (1, "the cat sat on the mat", "en", "a", 22, *clash),
            (2, None, "en", "a", None, *clash), (None, "the dog sat", None, None, 11, None, None, None, None),
            (3, "", "de", "b", 0, *clash), (4, " \t\n ", "de", "b", 4, *clash), (5, "der hund und die katze", "de", "b", 22, *clash),
            (5, "die katze und der hund", "de", None, 22, *clash), (6, "123 !!! 456", None, "c", 11, *clash),
            (7, "the cat der hund 漢字 \U0001F600 " * 3000, "en", "c", 90000, *clash), (8, "a" * 70000, "en", "c", 70000, *clash)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return odd_documents(spark)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark, sf):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# -- language model -----------------------------------------------------------------------------------

def tokens(text):
    return [*(text or "").encode().lower().split(), "end"]


def brute_chance(rows, order, prior):
    """p(word | words before) by the formula, the counts it rests on, and the number of training tokens."""
    grams, words = Counter(), Counter()
    for _, text in rows:
        mine = tokens(text)
        words.update(mine)
        marked = ["begin", *mine]
        grams.update(tuple(marked[i:i + n]) for n in range(1, order + 1) for i in range(len(marked) - n + 1))
    total = sum(words.values())

    def chance(word, before):
        if not before:
            return (words[word] + 0.5) / (total + 0.5 * (len(words) + 1))
        lower, seen = chance(word, before[1:]), grams[before]
        return (grams[(*before, word)] + prior * lower) / (seen + prior) if seen else lower

    return chance, words, total


def brute_model(rows, learn, order, prior):
    chance, words, total = brute_chance([r for r in rows if learn(r[0])], order, prior)
    out = []
    for doc_id, text in rows:
        mine = tokens(text)
        marked = ["begin", *mine]
        score = sum(math.log10(chance(marked[i], tuple(marked[max(0, i - order + 1):i]))) for i in range(1, len(marked)))
        base = sum(math.log10(chance(w, ())) for w in mine)
        out.append((doc_id, learn(doc_id), len(mine), sum(words[w] > 0 for w in mine), total, round(base, 6), round(score, 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model_equals_the_formula(spark, documents, odd, order):
    chosen = [(i, documents[i]["text"]) for i in list(documents)[:60]] + [(r["doc_id"], r["text"]) for r in odd.collect()]
    docs = spark.createDataFrame(chosen, "doc_id long, text string").repartition(3)
    learn = F.coalesce(crc_part("doc_id", 5) != 1, F.lit(True))
    got = language_model.score(docs, learn, order, 5.0, shards=4).collect()
    mine = sorted(((*r[:5], round(r[5], 6), round(r[6], 6)) for r in got), key=str)
    assert mine == brute_model(chosen, lambda i: i is None or zlib.crc32(str(i).encode()) % 5 != 1, order, 5.0)


def test_the_formula_is_a_distribution():
    chance, words, _ = brute_chance([(0, "a b a c"), (1, "b a"), (2, "c c a")], 3, 3.0)
    for before in [(), (b"a",), ("begin",), (b"b", b"a"), (b"never seen",)]:
        assert sum(chance(w, before) for w in [*words, "unknown"]) == pytest.approx(1)


def test_language_model_without_training_or_rows(spark, odd, none):
    lone = language_model.score(odd, F.lit(False), shards=2).collect()
    assert len(lone) == odd.count() and {r["train_tokens"] for r in lone} == {0} and {r["base_score"] for r in lone} == {0.0}
    assert language_model.score(none, F.lit(True), shards=2).collect() == []


def test_language_model_beats_its_base_on_held_out_texts(spark, sf):
    rows = queries.op1(spark, sf).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


# -- language ID --------------------------------------------------------------------------------------

def test_language_of_held_out_documents(spark, sf, documents):
    rows = queries.op3(spark, sf).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(documents) and held
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == documents[r["doc_id"]]["lang"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_spans_of_mixed_text(spark, sf, documents):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit(docs, F.lit(True))
    pick = lambda lang: next(" ".join(d["text"].split()[:40]) for d in documents.values() if d["lang"] == lang and d["n_chars"] > 600)
    mixed = spark.createDataFrame([(1, pick("de") + " " + pick("es") + " " + pick("es"))], "doc_id long, text string")
    row = language.label(mixed, model).first()
    assert row["lang_pred"] == "es" and [s["lang"] for s in row["spans"]] == ["de", "es"]
    assert abs(row["spans"][0]["words"] - 40) < 6


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    random.seed(4)
    for _ in range(30):
        counts = [random.randint(0, 6) for _ in range(3)]
        scores = np.array([[random.uniform(-5, 0) for _ in range(3)] for _ in range(sum(counts))]).reshape(-1, 3)
        before = np.concatenate([[0], np.cumsum(counts)])
        labels = language.viterbi(scores, before, 2.0)
        value = lambda p, s: sum(s[i][x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
        for a, b in zip(before, before[1:]):
            best = max(value(p, scores[a:b]) for p in itertools.product(range(3), repeat=b - a))
            assert value(labels[a:b], scores[a:b]) == pytest.approx(best)


def test_language_edges(spark, odd, none):
    model = language.fit(odd, F.lit(True))
    assert model.languages == ["de", "en"]
    rows = {(r["doc_id"], r["lang_pred"]) for r in language.label(odd, model).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (6, "und"), (1, "en"), (None, "en")} <= rows
    assert language.label(none, model).collect() == []
    empty = language.fit(none, F.lit(True))
    assert {r["lang_pred"] for r in language.label(odd, empty).collect()} == {"und"}
    assert language.filtered(odd, model, 0.5).columns == odd.columns


def test_script_narrows_candidates(spark):
    rows = [(1, "привет мир как дела", "ru"), (2, "hello world how are you", "en"), (3, "γειά σου κόσμε", "el")]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    asked = spark.createDataFrame([(9, "дом и сад"), (8, "house and garden"), (7, "漢字"), (6, "́"), (5, "σπίτι")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language.label(asked, model).collect()} == {9: "ru", 8: "en", 7: "el", 6: "und", 5: "el"}


def test_stage_rejects_what_was_not_learned(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    langs = sorted(r["lang"] for r in docs.select("lang").distinct().collect() if r["lang"])
    model = language.fit(docs, F.lit(True))
    han = spark.createDataFrame([(1, "漢字仮名" * 20), (2, "漢字仮名" * 20 + " the house and the garden")], "doc_id long, text string")
    assert {r["doc_id"]: r["score"] < 0.5 for r in language.label(han, model).collect()} == {1: True, 2: True}
    assert language.filtered(han, model, 0.5).count() == 0
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto"
    assert language.filtered(spark.createDataFrame([(3, finnish)], "doc_id long, text string"), model, 0.5).count() == 0
    assert language.filtered(docs, model, 0.5).count() == docs.filter("n_chars > 0").count()
    assert len(langs) > 1


# -- token counts -------------------------------------------------------------------------------------

def library(name):
    made = Tokenizer.from_file(tokenizer_file(name))
    made.no_truncation()
    made.no_padding()
    return made


TRICKY = [" ", "  ", "\n", "\t", "'s", "'LL", "A", "The", "é", "e\u0301", "漢字", "\x1c", "\x85", "\xa0", "<|endoftext|>", "<|", "1", "23",
          "!!", "\u0301", "\U0001F600", "Ⅷ", "½", "İ", "Σ", "ΑΣ", "\r\n", "\u200b", "ا", "_", "\x0b", "ﬁ", "<|startoftext|>"]


def tricky_texts(n):
    random.seed(11)
    return ["".join(random.choice(TRICKY) for _ in range(random.randint(0, 14))) for _ in range(n)]


def test_counts_equal_the_library(spark, documents, odd):
    texts = tricky_texts(3000) + [d["text"] for d in documents.values()] + [r["text"] for r in odd.collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    path = tokenizer_file("word_bpe_49k.json")
    counted = token_counts.count_tokens(docs, path, scratch_path(spark, "cache")).collect()
    tool = library("word_bpe_49k.json")
    want = {i: (len((t or "").encode()), len(tool.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in counted} == want and len(counted) == len(texts)


def test_cache_keeps_distinct_misses_only(spark, odd, none):
    cache, path = scratch_path(spark, "cache"), tokenizer_file("word_bpe_49k.json")
    assert token_counts.count_tokens(odd, path, cache).count() == odd.count()
    first = spark.read.parquet(cache)
    assert first.count() == first.select("digest").distinct().count() == 9
    again = odd.select("doc_id", F.concat("text", F.when(F.col("doc_id") == 5, " new").otherwise("")).alias("text"))
    assert token_counts.count_tokens(again, path, cache).count() == odd.count()
    assert spark.read.parquet(cache).count() == 11
    assert token_counts.count_tokens(none, path, cache).collect() == []
    with pytest.raises(ValueError):
        token_counts.count_tokens(odd, tokenizer_file("byte_bpe_50k.json"), cache)


# -- byte-pair encoding -------------------------------------------------------------------------------

def test_ids_equal_the_library():
    tool, mine = library("byte_bpe_50k.json"), bpe.load(tokenizer_file("byte_bpe_50k.json"))
    random.seed(5)
    wild = ["".join(chr(random.choice([random.randint(32, 126), random.randint(0, 0xD7FF), random.randint(0x10000, 0x1FFFF)]))
                    for _ in range(random.randint(0, 30))) for _ in range(500)]
    for text in tricky_texts(3000) + wild + ["ab" * 5000, "the" * 3000]:
        ids = tool.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == ids
        assert mine.decode(ids).decode() == tool.decode(ids, skip_special_tokens=False) == text


def test_walk_steps_back_when_greedy_fails():
    mine = bpe.load(tokenizer_file("byte_bpe_50k.json"))
    tool = library("byte_bpe_50k.json")
    random.seed(6)
    words = ["".join(random.choice("etaoinshrdlu") for _ in range(random.randint(2, 14))) for _ in range(3000)]
    greedy = sum([t for _, t in mine.matcher.iter_long(w)] != mine.walk(w) for w in words)
    assert greedy > 20 and all(mine.encode(w) == tool.encode(w, add_special_tokens=False).ids for w in words)


def test_round_trip_of_odd_documents(spark, odd, none):
    path = tokenizer_file("byte_bpe_50k.json")
    tool = library("byte_bpe_50k.json")

    def row(r):
        ids = tool.encode(r["text"] or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return r["doc_id"], len(ids), digest(",".join(map(str, ids))), digest(r["text"] or "")

    assert Counter(tuple(r) for r in bpe.round_trip(odd, path).collect()) == Counter(map(row, odd.collect()))
    decoded = bpe.decode_documents(bpe.encode_documents(odd, path), path).collect()
    assert Counter((r["doc_id"], r["text"]) for r in decoded) == Counter((r["doc_id"], r["text"] or "") for r in odd.collect())
    assert bpe.round_trip(none, path).collect() == []


# -- url filter ---------------------------------------------------------------------------------------

def brute_url(url):
    after = (url or "").partition("://")[2] if "://" in (url or "") else ""
    end = min([after.find(c) for c in "/?#" if c in after], default=len(after))
    path = after[end:]
    stop = min([path.find(c) for c in "?#" if c in path], default=len(path))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in after[:end])
    path = path[:stop]
    fits = [r for r, _ in queries.RULES for h, p in [(r[:r.index("/")], r[r.index("/"):])]
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


LARGER = "/root/testdata/sf0.01"
URLS = [None, "", "nothing", "http://", "://x", "HTTP://WWW.Example.COM/en/a?b#c", "http://example.com/en/x", "https://a.www.example.com/en/",
        "http://com/", "http://xcom/", "http://a.net/es/1", "http://a.net/es", "http://a.net/fr/", "http://a.org/en/1", "http://a.org?x=/y",
        "http://a.org#/z", "http://a.com", "x://y://z/w", "http://ÄÖ.net/es/", "http://a.net/de/2", "ftp://b.org/en/9?q://r"]


def test_hosts_paths_and_rules(spark, sf):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(None, "http://a.net/es/1")], "page_id long, url string").withColumn("host", F.lit("q"))
    rows = url_filter.judge(pages, queries.RULES).collect()
    for r in rows:
        url = URLS[r["page_id"]] if r["page_id"] is not None else "http://a.net/es/1"
        assert (r["host"], r["path"], r["rule"]) == brute_url(url)
        if r["rule"]:
            assert r["verdict"] == dict(queries.RULES)[r["rule"]]
        else:
            assert r["verdict"] == ("block" if r["block_probability"] > 0.5 else "allow")
    assert len(rows) == len(URLS) + 1


def test_model_agrees_with_labels(spark, sf):
    rows = queries.op7(spark, sf).filter("rule IS NULL")
    assert rows.count() > 0 and rows.filter("block_probability IS NULL").count() == 0
    held = spark.read.parquet(f"{LARGER}/pages.parquet").filter("page_id % 2 = 1")
    name, decision = url_filter.rule_columns(queries.RULES)
    host, path = url_filter.split_url()
    split = held.select(host.alias("host"), path.alias("path")).withColumns({"rule": name, "decision": decision})
    taught = spark.read.parquet(f"{LARGER}/pages.parquet").filter("page_id % 2 = 0").select(host.alias("host"), path.alias("path")) \
        .withColumns({"rule": name, "decision": decision})
    model = url_filter.fit(url_filter.labelled_sample(taught, 1000))
    scored = model.transform(url_filter.featured(split.filter("rule IS NOT NULL")))
    right = scored.agg(F.avg(((F.col("prediction") > 0.5) == (F.col("decision") == "block")).cast("int"))).first()[0]
    assert right > 0.9


def test_urls_without_labels(spark):
    shape = "page_id long, url string"
    assert url_filter.judge(spark.createDataFrame([], shape), queries.RULES).collect() == []
    assert url_filter.judge(spark.createDataFrame([(1, "http://a.org/x")], shape), queries.RULES).first()["verdict"] == "allow"
    only = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://a.net/es/")], shape)
    assert {r["verdict"] for r in url_filter.judge(only, queries.RULES).collect()} == {"block"}


# -- mixing -------------------------------------------------------------------------------------------

def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Share by weight, stop at the limit, share the excess anew until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= most * sizes[s]
        open_ -= over
    return target


def test_targets_and_words_taken(spark, sf, odd):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd):
        rows = mixing.mix(docs).collect()
        assert len(rows) == docs.count()
        sizes = Counter()
        for r in rows:
            sizes[r["source"]] += r["size"]
            assert r["taken"] == r["copies"] * r["size"] and r["taken"] <= 3 * r["size"]
        want = brute_targets(dict(sizes))
        longest = max(r["size"] for r in rows)
        for source in sizes:
            mine = [r for r in rows if r["source"] == source]
            assert {r["source_size"] for r in mine} == {sizes[source]}
            assert mine[0]["target"] == pytest.approx(want[source])
            assert abs(sum(r["taken"] for r in mine) - want[source]) <= 2 * longest
            rate = want[source] / sizes[source] if sizes[source] else 0
            assert all(math.floor(rate - 1e-9) <= r["copies"] <= math.ceil(rate + 1e-9) for r in mine)
            assert abs(sum(r["copies"] for r in mine) - rate * len(mine)) <= 1
        assert sorted(map(str, mixing.mix(docs.repartition(5)).collect())) == sorted(map(str, rows))


def test_mixed_rows_keep_their_columns(spark, odd, none):
    mixed = mixing.mixed_rows(odd)
    copies = Counter()
    for r in mixing.mix(odd).collect():
        copies[r["doc_id"]] += r["copies"]
    assert mixed.columns == odd.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == +copies
    assert mixing.mix(none).collect() == [] and mixing.mixed_rows(none).collect() == []


def test_encoding_holds_the_ids_of_one_slice(monkeypatch):
    """A batch of Arrow rows comes back in parts of bounded text; together they are the batch."""
    import pyarrow as pa

    texts = ["one two " * 40, None, "", "x", "é" * 700, "three " * 60, "end"] * 5
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    monkeypatch.setattr(bpe, "SLICE_BYTES", 1000)
    mine = bpe.load(tokenizer_file("byte_bpe_50k.json"))
    parts = list(bpe.checked_slices(mine, batch))
    assert len(parts) > 5
    for part in parts:
        held = [len((texts[i] or "").encode()) for i in part["doc_id"].to_pylist()]
        assert sum(held) <= 1000 or len(held) == 1 or sum(held[:-1]) == 0
    assert [i for p in parts for i in p["doc_id"].to_pylist()] == list(range(len(texts)))
    assert [i for p in parts for i in p["ids"]] == [mine.encode(t or "") for t in texts]
    assert all(s for p in parts for s in p["same"])
