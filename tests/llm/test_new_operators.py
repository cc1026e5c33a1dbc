"""Whitening, substring dedup and conversation repair against brute force, and on odd input."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurelake.llm import conversations, queries, substrings, whitening

# -- whitening ----------------------------------------------------------------------------------------


def symmetric(kind, d, random):
    basis = np.linalg.qr(random.normal(size=(d, d)))[0]
    values = {"spread": 2.0 ** -np.arange(d), "equal": np.repeat([5.0, 2.0, 1.0], [3, 3, d - 6]) if d > 6 else np.ones(d),
              "low": np.r_[np.arange(3.0, 0, -1), np.zeros(max(d - 3, 0))][:d], "one": np.ones(d)}[kind]
    matrix = basis * values @ basis.T
    return (matrix + matrix.T) / 2


@pytest.mark.parametrize("d", [1, 2, 3, 5, 17, 64, 130])
@pytest.mark.parametrize("kind", ["spread", "equal", "low", "one"])
def test_leading_pairs_equal_a_full_decomposition(d, kind):
    matrix = symmetric(kind, d, np.random.default_rng(d))
    values, vectors = whitening.leading_pairs(matrix, 4)
    wanted = np.linalg.eigvalsh(matrix)[::-1][:4]
    assert np.allclose(values, wanted, atol=1e-13 * wanted[0])
    assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-12)
    assert np.allclose(matrix @ vectors.T, vectors.T * values, atol=1e-12 * wanted[0])


def test_blocks_and_zero_matrices():
    blocks = np.kron(np.eye(6), np.array([[2.0, 1.0], [1.0, 2.0]]))
    values, vectors = whitening.leading_pairs(blocks, 4)
    assert np.allclose(values, 3) and np.allclose(vectors @ vectors.T, np.eye(4))
    assert np.allclose(whitening.leading_pairs(np.zeros((5, 5)), 4)[0], 0)


def brute_whitening(rows):
    """Per id: n, exact deviation, whitened up to sign, explained."""
    whole = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows]
    fit = sorted({tuple(v) for _, v in whole})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    out = {i: (n, sum((n * c - s) ** 2 for c, s in zip(v, sums)), (np.array(v) - np.array(sums) / n) @ vectors / np.sqrt(values)) for i, v in whole}
    return out, values / (centred**2).sum() * n


def test_op11_equals_brute_force(spark, sf):
    got = queries.QUERIES["op11_whitening"](spark, sf).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, explained = brute_whitening(rows)
    assert len(got) == 4 * len(rows)
    signs = {}
    for r in got:
        n, deviation, w = want[r["vec_id"]]
        mine = w[r["component"] - 1]
        sign = signs.setdefault(r["component"], np.sign(r["whitened"] * mine))
        assert (r["n"], r["deviation"]) == (n, deviation) and abs(r["whitened"] * sign - mine) < 1e-9
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9
    assert len({r["identity_error"] for r in got}) == 1


VECTORS = "vec_id long, embedding array<float>, n string, x string, id string, d string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], VECTORS)


def test_whitening_drops_unusable_vectors_only(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, 0.25, -0.0]), (1, [0.5, 0.25, 0.0]), (None, [1.0, -2.0, 3.0]), (4, [-1.0, 0.125, 0.5]), (5, [2.0, 2.0, 2.0]),
            (6, [0.1, 0.7, -3.0]), (6, [0.1, 0.7, -3.0])]
    bad = [(10, None), (11, [None, 1.0, 2.0]), (12, [nan, 1.0, 2.0]), (13, [1.0, inf, 2.0]), (14, [1.0, 2.0, -inf])]
    got = whitening.whiten(vectors(spark, good + bad)).collect()
    assert sorted(r["vec_id"] or 0 for r in got) == sorted((i or 0) for i, _ in good for _ in range(3))
    assert {r["n"] for r in got} == {5} and all(r["identity_error"] < 1e-9 for r in got)
    assert len({(r["deviation"], round(r["whitened"], 9)) for r in got if r["vec_id"] == 6}) == 3


def test_whitening_without_variance_and_empty(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [])])).count() == 0
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0])] * 3)).collect()
    assert len(one) == 6
    assert {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(1, 0, None, None, None)}
    two = whitening.whiten(vectors(spark, [(1, [1.0, 2.0, 0.0]), (2, [3.0, 2.0, 0.0])])).collect()
    assert sorted((r["vec_id"], r["component"]) for r in two if r["whitened"] is not None) == [(1, 1), (2, 1)]
    assert all(abs(abs(r["whitened"]) - 1) < 1e-12 and r["explained"] == 1 for r in two if r["component"] == 1)


def test_whitening_fits_lengths_apart_and_holds_huge_entries(spark):
    rows = [(i, [float(i), float(i * i)]) for i in range(5)] + [(i, [float(i % 3)]) for i in range(10, 16)]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert {r["n"] for r in got if r["vec_id"] < 5} == {5} and {r["n"] for r in got if r["vec_id"] >= 10} == {3}
    huge = whitening.whiten(vectors(spark, [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 2.0])])).collect()
    assert len(huge) == 6 and {r["deviation"] for r in huge if r["vec_id"] == 1} == {None}


# -- substring dedup ----------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, h string, ord string, marks string"


def texts(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "y", "z") for i, t in rows], DOCS)


def brute_substrings(rows, window=13):
    order = lambda i: float("inf") if i is None else i
    firsts = {}
    for i, text in rows:
        words = (text or "").encode().split()
        for at in range(len(words) - window + 1):
            key = tuple(words[at:at + window])
            firsts[key] = min(firsts.get(key, float("inf")), order(i))
    out = []
    for i, text in rows:
        words = (text or "").encode().split()
        gone = {at + k for at in range(len(words) - window + 1) if firsts[tuple(words[at:at + window])] < order(i) for k in range(window)}
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), kept.decode()))
    return sorted(out, key=str)


def substring_rows(df, hot=None):
    return sorted([tuple(r) for r in substrings.dedup_substrings(df, hot).select("doc_id", "n_words", "n_removed", "kept").collect()], key=str)


@pytest.mark.parametrize("hot", [None, 0, 5])
def test_substrings_equal_brute_force_on_planted_passages(spark, hot):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "漢字", "a"]
    passages = [" ".join(rng.choices(vocabulary, k=n)) for n in (13, 14, 30, 60)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts.append(rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choices(vocabulary, k=rng.randint(1, 30))))
        rows.append((rng.randint(0, 90) if i % 20 else None, rng.choice([" ", "\n", " \t "]).join(parts)))
    rows += [(200, "a " * 700), (201, "a " * 13), (202, "a " * 12), (203, None), (204, ""), (205, " \n\t"), (206, "a b " * 14), rows[3], rows[3],
             (300, " ".join(rng.choices(vocabulary, k=5000)) + " " + passages[3])]
    assert substring_rows(texts(spark, rows), hot) == brute_substrings(rows)


def test_op12_equals_brute_force(spark, sf):
    got = queries.QUERIES["op12_substring_dedup"](spark, sf).collect()
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute_substrings(rows)}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == want


def test_substrings_of_an_empty_table(spark):
    assert substring_rows(texts(spark, [])) == []


def test_hot_minimisers_are_found_and_leave_no_large_bucket(spark):
    """A phrase in every document with other words around it: its windows spread over buckets of their own."""
    rng = random.Random(3)
    phrase = min((f"so it goes{i}" for i in range(100)), key=lambda p: substrings.Words([p.encode()]).grams(2).min())
    rows = [(i, " ".join([*(f"x{rng.random()}" for _ in range(10)), phrase, *(f"y{rng.random()}" for _ in range(10))])) for i in range(400)]
    keyed = substrings.keyed(texts(spark, rows))
    hot = substrings.hot_minimisers(keyed, 50)
    largest = lambda h: substrings.packed_strings(keyed, h).groupBy("bucket").count().agg(F.max("count")).first()[0]
    assert len(hot) == 1 and largest(hot[:0]) > 50 >= largest(hot)


def test_equal_passages_leave_a_task_once_per_slice(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    df = texts(spark, [(i, passage) for i in range(3000)]).coalesce(1)
    keyed = substrings.keyed(df)
    strings = substrings.packed_strings(keyed, substrings.hot_minimisers(keyed, 100))
    assert strings.count() <= 60 and strings.where("start IS NOT NULL").count() == 0
    got = substring_rows(df, 100)
    assert got == substring_rows(df)
    assert sum(r[2] for r in got) == 50 * 2999


# -- conversation repair ------------------------------------------------------------------------------

FORM = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """Of rows (role, text) in order: their first faults."""
    seen, out = set(), []
    for role, text in rows:
        ink = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_edits(rows):
    """Least (cost, audit, repaired lines) over every way to edit the rows, up to two inserts at each place."""
    inserts = [[]] + [[a] for a in ("user", "assistant")] + [list(p) for p in itertools.product(("user", "assistant"), repeat=2)]
    best = None
    choices = []
    for (role, text), fault in zip(rows, faults(rows)):
        late = fault == "truncated"
        edits = [(3, "D", [])]
        if fault not in ("blank", "duplicate"):
            edits += [(late, "K", [(role, text)])] + [(2 + late, "R", [(r, text)]) for r in ("user", "assistant")]
        choices.append(edits)
    for edits in itertools.product(*choices):
        for puts in itertools.product(inserts, repeat=len(rows) + 1):
            cost = sum(e[0] for e in edits) + 2 * sum(map(len, puts))
            if best is not None and cost > best[0]:
                continue
            lines, audit = [], ""
            for put, edit in itertools.zip_longest(puts, edits, fillvalue=(0, "", [])):
                lines += [(r, "") for r in put] + edit[2]
                audit += "I" * len(put) + edit[1]
            if FORM.fullmatch("".join(r[:1] or "-" for r, _ in lines)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in lines))
    return best


def longest_first_edits(rows):
    """The same by whole strings over prefixes, for conversations of any length."""
    states = {"": (0, "", ())}
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def better(found, state, value):
        if state not in found or value[:2] < found[state][:2]:
            found[state] = value

    def opened(found):
        found = dict(found)
        for _ in range(3):
            for state, (cost, audit, lines) in list(found.items()):
                for role in ("user", "assistant"):
                    if (state, role[0]) in step:
                        better(found, step[state, role[0]], (cost + 2, audit + "I", (*lines, f"{role}:")))
        return found

    for (role, text), fault in zip(rows, faults(rows)):
        late, after = int(fault == "truncated"), {}
        # Ways with and without inserts before the row are compared with the row's letter behind them.
        for found in (states, opened(states)):
            for state, (cost, audit, lines) in found.items():
                better(after, state, (cost + 3, audit + "D", lines))
                if fault not in ("blank", "duplicate"):
                    if (state, role[:1]) in step:
                        better(after, step[state, role[:1]], (cost + late, audit + "K", (*lines, f"{role}:{text}")))
                    for new in ("user", "assistant"):
                        if (state, new[0]) in step:
                            better(after, step[state, new[0]], (cost + 2 + late, audit + "R", (*lines, f"{new}:{text}")))
        states = after
    ends = [v for s, v in opened(states).items() if s in ("", "a")]
    cost, audit, lines = min(ends, key=lambda v: v[:2])
    return cost, audit, "\n".join(lines)


TURNS = "conv_id long, turn long, role string, text string, key string, first string, live string, blank string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "k", "f", "l", "b") for r in rows], TURNS)


def repaired(df, live=None):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))
            for r in conversations.repair(df, live=live).collect()}


def brute_result(rows, edits):
    """Result of rows (turn, role, text) of one conversation, in order."""
    pairs = [(r, t) for _, r, t in rows]
    told = faults(pairs)
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    initials = [r[:1] for r, _ in pairs]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, text = edits(pairs)
    return (gaps, *(told.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


ROLES = ["system", "user", "assistant", "", "tool", "sage", "User"]
TEXTS = ["Hello.", "Yes!  ", "and then", "", " \n", "Why?", "é.", "Hello. ", "a.b"]


def sample(rng, longest):
    out, turn = [], 0
    for _ in range(rng.randint(0, longest)):
        turn += rng.choice([0, 1, 1, 1, 2])
        out.append((None if rng.random() < 0.1 else turn, rng.choice(ROLES[:3] * 3 + ROLES), rng.choice(TEXTS)))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def test_repairs_equal_every_way_to_edit(spark):
    rng = random.Random(11)
    given = {i: sample(rng, 3) for i in range(150)}
    got = repaired(turns(spark, [(i, *r) for i, rows in given.items() for r in rows]))
    want = {i: brute_result(rows, brute_edits) for i, rows in given.items() if rows}
    assert got == want


def test_repairs_of_long_conversations_equal_whole_strings(spark):
    rng = random.Random(12)
    given = {i: sample(rng, 60) for i in range(120)}
    got = repaired(turns(spark, [(i, *r) for i, rows in given.items() for r in rows]))
    assert got == {i: brute_result(rows, longest_first_edits) for i, rows in given.items() if rows}


def test_state_is_carried_over_batches_and_spilled(spark, monkeypatch):
    rng = random.Random(13)
    rows = [(t, rng.choice(ROLES[:3]), f"{t} said{rng.choice(['.', ''])}") for t in range(400)]
    want = brute_result(rows, longest_first_edits)
    monkeypatch.setattr(conversations, "SPILL", 64)
    monkeypatch.setattr(conversations, "BACK", 3 * 7)
    frame = turns(spark, [(None, *r) for r in rows])
    frames = (frame.select(F.lit(None).cast("string").alias("key"), (F.col("turn") == 0).alias("first"), F.lit(True).alias("live"), "role", "text",
                           F.lit(False).alias("no_turn"), "turn", F.lit(False).alias("blank"), F.lit(False).alias("repeated"),
                           (~F.col("text").endswith(".")).alias("cut")).orderBy("turn").toPandas())
    parts = [frames.iloc[a:a + 33] for a in range(0, 400, 33)]
    (out,) = list(conversations.repair_batches(iter(parts)))
    assert out.iloc[0]["audit"] == want[6] and out.iloc[0]["repaired_sha256"] == want[7] and out.iloc[0]["cost"] == want[5]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert repaired(frame) == {None: want}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(name.encode()) % 20
        role = "user" if fault == 4 else role
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def brute_op13(rows):
    harmed = brute_damage(rows)
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in harmed if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        out[conv] = brute_result(mine, longest_first_edits)
    return out


def test_op13_equals_brute_force(spark, sf):
    got = queries.QUERIES["op13_conversation_repair"](spark, sf).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute_op13(rows)
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_damage_and_repair_of_odd_rows(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2, 3, 2**62]), rng.choice([None, *range(-3, 30), 2**62]), rng.choice([None, *ROLES]), rng.choice([None, *TEXTS]))
            for _ in range(400)]
    rows += [(50, t, "user", "gone.") for t in range(60) if zlib.crc32(f"50:{t}".encode()) % 20 == 0]
    rows += [(51, 0, "user", "long " * 200_000)]
    got = repaired(conversations.damaged(turns(spark, rows)), live="live")
    assert got == brute_op13(rows)
    assert got[50] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repaired(conversations.damaged(turns(spark, []))) == {}
