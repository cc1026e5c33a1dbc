"""Language identification of whole texts and of spans in mixed text.

``fit`` counts byte n-grams of a bounded sample of labelled rows into a hashed table per language, and notes in which
scripts a language is written. ``label`` splits a text into words (runs of letters). The script of a word narrows its
candidates; each candidate's score is the sum of its n-grams' log-probabilities. A Viterbi pass over the words of a
text, in which each change of language costs a penalty, labels spans. The text's language is the one with most letters
in its spans, and its score that language's share of the letters, from 0 to 1. Letters of words in scripts that no learned
language uses count in the whole only. A text's evidence is the mean log-probability of the n-grams in that language's
spans over that of n-grams spread evenly, as a share of what the language's own learned texts have: about 1 for a text in
a learned language, lower for one that was not learned but shares the script. ``filtered`` asks for both.

The passes of all texts in a batch advance together, one word at a time, so numpy does the work; the table has a fixed
number of buckets per language and is the only thing sent to the tasks. There is no shuffle.

The sample: at most about ``SAMPLE`` labelled rows of each language, those with the smallest hashed ids, so it is the
same on each run.

Defined results: null, empty and letterless texts are ``und`` with score and evidence 0. A text wholly in scripts that no
learned language uses has score and evidence 0 as well. Ties go to the language first in code-point
order. Rows without a label, or with an empty one, teach nothing; without any labelled row every text is ``und``.
Repeated rows each get a row; extra columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurelake.llm.common import arrow_map, binary_sizes, ship, slices, text_bytes

#: Labelled rows per language that are learned from; hashed n-grams; their length in bytes; cost of a change.
SAMPLE, BUCKETS, NGRAM, PENALTY = 3000, 1 << 16, 4, 12.0
#: Most languages of a model.
LANGUAGES = 200
#: Least share of a language's letters in a script for the script to admit it.
SCRIPT_SHARE = 0.02
#: Least evidence of a document that ``filtered`` keeps.
LEAST_EVIDENCE = 0.4
#: Bytes of text whose words advance together, words scored at a time.
BATCH_BYTES, WORDS_AT_ONCE = 1 << 20, 50_000
UNDETERMINED = "und"

# First and last code point of the letters of each script.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
    "hangul": [(0xAC00, 0xD7A3), (0x1100, 0x11FF)],
}
_NAMES = [*SCRIPTS, "other"]


def _letter_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point below 65536: whether it belongs in a word, is a letter, and its script's number."""
    import unicodedata

    kind = np.array([unicodedata.category(chr(c))[0] for c in range(1 << 16)])
    script = np.full(1 << 16, len(SCRIPTS), np.int8)
    for i, ranges in enumerate(SCRIPTS.values()):
        for first, last in ranges:
            script[first:last + 1] = i
    return (kind == "L") | (kind == "M"), kind == "L", script


_IN_WORD, _LETTER, _SCRIPT = _letter_tables()


def is_letter(points: np.ndarray) -> np.ndarray:
    import unicodedata

    found = _LETTER[np.minimum(points, 0xFFFF)]
    for c in np.unique(points[points > 0xFFFF]):
        found[points == c] = unicodedata.category(chr(c))[0] == "L"
    return found


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # by n-gram bucket and language
    admitted: np.ndarray  # by script and language
    usual: np.ndarray  # mean excess of the learned texts' log-probability by language


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of the texts: code points of letters with one zero before each word, the words' starts among them,
    their letters, their scripts, and for each text the number of words before it (one more at the end)."""
    points = np.frombuffer(b"\n".join(texts).decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32) \
        if texts else np.zeros(0, np.uint32)
    points = np.concatenate([points, np.array([10], np.uint32)])
    low = np.minimum(points, 0xFFFF)
    letter = _IN_WORD[low]
    high = points > 0xFFFF
    if high.any():
        letter[high] = is_letter(points[high])
    start = letter & ~np.concatenate([[False], letter[:-1]])
    counts = [len(t.decode("utf-8", "replace").lower()) + 1 for t in texts]
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    at = np.flatnonzero(start)
    before = np.searchsorted(at, bounds)
    # Keep the letters and, as one zero, the place before each word.
    gap = np.zeros(len(points), bool)
    inside = at[at > 0] - 1
    gap[inside] = True
    keep = letter | gap
    body = np.where(letter, points, 0)[keep]
    if len(at) and at[0] == 0:
        body = np.concatenate([np.zeros(1, body.dtype), body])
    first = np.flatnonzero(body == 0)
    lengths = np.add.reduceat(is_letter(body).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    scripts = np.where(points[at] > 0xFFFF, list(SCRIPTS).index("han"), _SCRIPT[low[at]]) if len(at) else np.zeros(0, np.int8)
    return body, first, lengths, scripts, before


def gram_buckets(body: np.ndarray) -> np.ndarray:
    """Bucket of the n-gram that ends at each letter (and, at the zero before a word, of the word's beginning)."""
    padded = np.concatenate([body, np.zeros(NGRAM, body.dtype)]).astype(np.uint64)
    h = np.zeros(len(body), np.uint64)
    open_ = np.ones(len(body), bool)
    for k in range(NGRAM):
        part = padded[k:k + len(body)]
        if k:
            open_ &= part != 0  # an n-gram stops at the next word
        h = h * np.uint64(0x100000001B3) + np.where(open_, part + np.uint64(1), np.uint64(0))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(48)).astype(np.int64) % BUCKETS


def sampled(docs: DataFrame, teach: Column, size: int = SAMPLE) -> DataFrame:
    """About ``size`` labelled rows per language: those whose hashed id is below the language's share."""
    labelled = docs.filter(teach & (F.coalesce("lang", F.lit("")) != "") & F.col("text").isNotNull())
    counts = labelled.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} distinct labels; a model has a table for each")
    # One number per language, so the rows are sampled in the scan and only those kept move on.
    shares = F.coalesce(*[F.when(F.col("lang") == r["lang"], min(1.0, size / r["count"])) for r in counts], F.lit(0.0))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return labelled.filter(place < shares).select("lang", "text")


def fit(docs: DataFrame, teach: Column, size: int = SAMPLE) -> Model:
    """Learn from the text and lang of rows for which ``teach`` holds. Each task adds up one table per language; the
    tables have a fixed size."""

    def count(batch):
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            total, scripts = np.zeros(BUCKETS), np.zeros(len(_NAMES))
            for a, b in slices(map(len, texts), BATCH_BYTES):
                body, first, lengths, script, _ = words_of(texts[a:b])
                total += np.bincount(gram_buckets(body), minlength=BUCKETS)
                scripts += np.bincount(script, lengths, minlength=len(_NAMES))
            kept = np.flatnonzero(total)
            yield {"lang": [lang] * (len(kept) + len(_NAMES)),
                   "slot": np.concatenate([kept, BUCKETS + np.arange(len(_NAMES))]),
                   "n": np.concatenate([total[kept], scripts])}

    rows = sampled(docs, teach, size).select("lang", text_bytes().alias("text"))
    summed = arrow_map(rows, count, "lang string, slot long, n double").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    found = summed.toArrow()  # at most BUCKETS + scripts rows per language
    names = found.column("lang").to_numpy(zero_copy_only=False).astype(object)
    languages = sorted(set(names))
    counts = np.zeros((BUCKETS + len(_NAMES), len(languages)))
    where = {lang: i for i, lang in enumerate(languages)}
    np.add.at(counts, (found.column("slot").to_numpy(), [where[x] for x in names]), found.column("n").to_numpy())
    grams, scripts = counts[:BUCKETS], counts[BUCKETS:]
    scores = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * BUCKETS)).astype(np.float32)
    admitted = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
    usual = (grams * scores).sum(axis=0) / np.maximum(grams.sum(axis=0), 1) + np.log(BUCKETS)
    return Model(languages, scores, admitted, np.maximum(usual, 1e-9))


def word_scores(model: Model, body: np.ndarray, first: np.ndarray, scripts: np.ndarray) -> np.ndarray:
    """Score of each word (row) in each language; languages not written in its script are out, and a word in a script
    of none speaks for none."""
    out = np.empty((len(first), len(model.languages)), np.float32)
    ends = [*first[1:], len(body)]
    for a in range(0, len(first), WORDS_AT_ONCE):  # the arrays over letters stay small
        b = min(a + WORDS_AT_ONCE, len(first))
        grams = gram_buckets(body[first[a]:ends[b - 1]])
        for k in range(len(model.languages)):
            out[a:b, k] = np.add.reduceat(model.scores[:, k][grams], first[a:b] - first[a])
    allowed = model.admitted[scripts]
    known = allowed.any(axis=1)
    out[known[:, None] & ~allowed] = -1e6
    out[~known] = 0
    return out


def viterbi(scores: np.ndarray, before: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word. All texts advance one word at a time, longest first, so those still running are a
    prefix; coming from the best language so far costs the penalty, staying costs nothing."""
    counts = np.diff(before)
    order = np.argsort(-counts, kind="stable")
    sizes, starts = counts[order], before[:-1][order]
    longest = int(sizes[0]) if len(sizes) else 0
    running = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")
    best = np.zeros((len(order), scores.shape[1]), np.float64)
    switched = np.zeros(scores.shape, bool)
    source = np.zeros(len(scores), np.int16)
    for t in range(longest):
        n = running[t]
        rows, now = starts[:n] + t, best[:n]
        if t:
            top = now.argmax(axis=1)
            change = now[np.arange(n), top][:, None] - penalty
            move = change > now
            switched[rows], source[rows] = move, top
            np.maximum(now, change, out=now)
        now += scores[rows]
    labels = np.zeros(len(scores), np.int16)
    current = best.argmax(axis=1) if scores.shape[1] else np.zeros(len(order), int)
    for t in range(longest - 1, -1, -1):
        n = running[t]
        rows, lang = starts[:n] + t, current[:n]
        labels[rows] = lang
        current[:n] = np.where(switched[rows, lang], source[rows], lang)
    return labels


def labelled_texts(model: Model, texts: list[bytes], penalty: float = PENALTY):
    """Language, score, spans (language, first word, number of words) and evidence of each text."""
    body, first, lengths, scripts, before = words_of(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(before))
    if not model.languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts)), [[] for _ in texts], np.zeros(len(texts))
    scores = word_scores(model, body, first, scripts)
    labels = viterbi(scores, before, penalty)
    letters = np.zeros((len(texts), len(model.languages)))
    known = model.admitted[scripts].any(axis=1)
    np.add.at(letters, (owner[known], labels[known]), lengths[known])
    total = np.bincount(owner, lengths, minlength=len(texts))
    best = letters.argmax(axis=1)
    share = letters[np.arange(len(texts)), best] / np.maximum(total, 1)
    spoken = known & (labels == best[owner])
    grams = np.diff([*first, len(body)])
    sums = [np.bincount(owner[spoken], x[spoken], minlength=len(texts))
            for x in (scores[np.arange(len(labels)), labels].astype(np.float64), grams)]
    evidence = np.where(sums[1] > 0, (sums[0] / np.maximum(sums[1], 1) + np.log(BUCKETS)) / model.usual[best], 0.0)
    names = [model.languages[b] if t else UNDETERMINED for b, t in zip(best, total)]
    cut = np.flatnonzero(np.concatenate([[True], (labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1])])) if len(labels) else []
    ends = [*cut[1:], len(labels)] if len(cut) else []
    spans = [[] for _ in texts]
    for a, b in zip(cut, ends):
        spans[owner[a]].append({"lang": model.languages[labels[a]], "first_word": int(a - before[owner[a]]), "words": int(b - a)})
    return names, share, spans, evidence


def label(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """doc_id, lang_pred, score, spans and evidence of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages, a fixed size

    def run(batch):
        for a, b in slices(binary_sizes(batch.column("text")), BATCH_BYTES):
            part = batch.slice(a, b - a)
            names, share, spans, evidence = labelled_texts(shared.value, part.column("text").to_pylist(), penalty)
            yield {"doc_id": part.column("doc_id"), "lang_pred": names, "score": share, "spans": spans,
                   "evidence": evidence}

    return arrow_map(docs.select("doc_id", text_bytes().alias("text")), run,
                     "doc_id long, lang_pred string, score double, spans array<struct<lang:string,first_word:int,words:int>>, "
                     "evidence double")


def filtered(docs: DataFrame, model: Model, least: float, penalty: float = PENALTY) -> DataFrame:
    """The documents with a language whose share of the letters is at least ``least`` and whose evidence is at least
    ``LEAST_EVIDENCE``, with their own columns only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            column = batch.column("text").fill_null("")
            for a, b in slices(binary_sizes(column), BATCH_BYTES):  # what goes back is no larger than a slice
                texts = [t.as_py().encode() for t in column.slice(a, b - a)]
                names, share, _, evidence = labelled_texts(shared.value, texts, penalty)
                keep = (np.array(names, object) != UNDETERMINED) & (share >= least) & (evidence >= LEAST_EVIDENCE)
                yield batch.slice(a, b - a).filter(pa.array(keep))

    return ship(docs).mapInArrow(run, docs.schema)
