"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

``encode_documents`` gives every text its token ids, ``decode_documents`` turns ids back into text. The work is one
pass over the rows with no shuffle; the vocabulary (a file of fixed size) is loaded once per Python worker.

A piece of text between pre-token boundaries is encoded by a depth-first walk. One Aho-Corasick pass finds the longest
token that begins at each byte. The walk takes it if it is compatible with the token before it, that is, if merging the
two texts together would have kept them apart; else it takes the next shorter token, and when none is left it steps
back and marks the place as a dead end. Each place dies once, so the walk is linear.

Defined results: null counts as empty, an empty text has no ids and decodes to the empty text. Rows are independent, so
ties and repeated rows need no rule; extra columns are left out. Special strings in a text become their own id.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from featurelake.llm.common import arrow_map, binary_sizes, slices

# Fixed value: the split pattern of the byte-level vocabulary, with the white space of Unicode spelled out.
SPLIT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
         r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Entries of half of a worker's memo of encoded chunks, of its memo of compatible pairs, and the longest chunk kept.
MEMO_ENTRIES, PAIR_ENTRIES, MEMO_CHARS = 120_000, 300_000, 48
#: Bytes of text whose ids are held at a time.
SLICE_BYTES = 1 << 20


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file: itself, or the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Tables of one vocabulary. Inside, tokens are numbered by rank: bytes first, then merges in order."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        vocab = {bytes(letters[c] for c in k): v for k, v in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        pieces = [b""] * size
        for text, number in [*vocab.items(), *((k.encode(), v) for k, v in self.special.items())]:
            pieces[number] = text
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])

        self.text = [bytes([b]) for b in range(256)]
        self.left, self.right = list(range(256)), list(range(256))
        self.merged: dict[tuple[int, int], int] = {}
        rank = {t: i for i, t in enumerate(self.text)}
        for merge in spec["model"]["merges"]:
            a, b = (rank[bytes(letters[c] for c in part)] for part in (merge.split(" ") if isinstance(merge, str) else merge))
            new = rank.setdefault(self.text[a] + self.text[b], len(self.text))
            if new == len(self.text):
                self.text.append(self.text[a] + self.text[b])
                self.left.append(a)
                self.right.append(b)
            self.merged.setdefault((a, b), new)
        missing = [t for t in self.text if t not in vocab]
        if missing:
            raise ValueError(f"the vocabulary has no entry for {missing[:3]}")
        self.ids = [vocab[t] for t in self.text]
        # A token whose two halves are not compatible never comes out of the merges.
        reachable = [True] * 256
        for t in range(256, len(self.text)):
            a, b = self.left[t], self.right[t]
            reachable.append(reachable[a] and reachable[b] and self.compatible(a, b, below=t))
        self.shorter = [-1] * len(self.text)
        self.matcher = ahocorasick.Automaton()
        for t, text in enumerate(self.text):
            if reachable[t]:
                self.matcher.add_word(text.decode("latin-1"), t)
                self.shorter[t] = next((s for n in range(len(text) - 1, 0, -1)
                                        if (s := rank.get(text[:n], -1)) >= 0 and reachable[s]), -1)
        self.matcher.make_automaton()
        self.lengths = [len(t) for t in self.text]
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None
        self.fits = Pairs(self)
        self.head, self.tail = Memo(self, ""), Memo(self, " ")

    def compatible(self, a: int, b: int, below: int | None = None) -> bool:
        """Whether two tokens side by side stay apart: no merge across their border comes before they are whole.

        The later-made of the two is taken apart again and again; each pair of neighbours at the border must not
        merge earlier than the piece just taken apart was made.
        """
        limit = len(self.text) if below is None else below
        while True:
            if self.merged.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, self.right[a]
                if limit == a:  # a byte: only the right one can still be taken apart
                    limit, b = b + 1, self.left[b]
                    if limit == b + 1:
                        return True
            else:
                limit, b = b + 1, self.left[b]
                if limit == b + 1:
                    limit, a = a, self.right[a]
                    if limit == a:
                        return True

    def merge_bytes(self, piece: str) -> list[int]:
        """Ids of one pre-token. If the longest matches in a row are all compatible, the walk never steps back and
        they are its result; else it goes on from the first two that are not."""
        text = piece if piece.isascii() else piece.encode().decode("latin-1")
        greedy = [token for _, token in self.matcher.iter_long(text)]
        fits, ids, before = self.fits, self.ids, -1
        for i, token in enumerate(greedy):
            if before >= 0 and not fits[before << 20 | token]:
                return [ids[t] for t in self.walk(text, greedy[:i])]
            before = token
        return [ids[t] for t in greedy]

    def walk(self, text: str, begun: list[int] | tuple = ()) -> list[int]:
        """Backtracking from the tokens ``begun``, which are longest matches and compatible."""
        out, size = list(begun), len(text)
        longest = [0] * size
        lengths, shorter, fits = self.lengths, self.shorter, self.fits
        for end, token in self.matcher.iter(text):
            longest[end + 1 - lengths[token]] = token  # ends come in order, so the longest comes last
        alive = bytearray(b"\1") * (size + 1)
        place = sum(map(lengths.__getitem__, out))
        token = longest[place]
        while place < size:
            before = out[-1] << 20 if out else -1
            while token >= 0:
                end = place + lengths[token]
                if alive[end] and (before < 0 or fits[before | token]):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                place = end
                token = longest[place] if place < size else -1
            else:
                alive[place] = 0
                token = out.pop()
                place -= lengths[token]
                token = shorter[token]
        return out

    def pieces(self, text: str) -> list[int]:
        """Ids of a stretch of text that begins and ends with a pre-token."""
        if text[0] == " " and text.isascii() and text[1:].isalpha():
            return self.merge_bytes(text)
        found = _SPLIT.findall(text)
        if len(found) == 1:
            return self.merge_bytes(text)
        out: list[int] = []
        for piece in found:
            # Words come back with other marks after them, so they are remembered by themselves too.
            if piece[0] != " ":
                out += self.head[piece]
            elif len(piece) > 1:
                out += self.tail[piece[1:]]
            else:
                out += self.merge_bytes(piece)
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text, special strings included."""
        if self.splitter is None or not any(s in text for s in self.special):
            return self.encode_ordinary(text)
        out: list[int] = []
        for part in self.splitter.split(text):
            out += [self.special[part]] if part in self.special else self.encode_ordinary(part)
        return out

    def encode_ordinary(self, text: str) -> list[int]:
        """A blank after something else than white space always begins a pre-token, so what lies between such blanks
        is encoded once and remembered. Where white space precedes a blank, those chunks stay together."""
        if not text:
            return []
        chunks = text.split(" ")
        if _RUN.search(text):
            joined = [chunks[0]]
            for chunk in chunks[1:]:
                if not joined[-1] or joined[-1][-1].isspace():
                    joined[-1] += " " + chunk
                else:
                    joined.append(chunk)
            chunks = joined
        tail = self.tail
        ids = list(self.head[chunks[0]])
        ids.extend(chain.from_iterable(map(tail.__getitem__, chunks[1:])))
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids: each one's stretch of the blob, copied in one gather."""
        numbers = np.array(ids, np.int64)
        begin = self.offsets[numbers]
        sizes = self.offsets[numbers + 1] - begin
        ends = np.cumsum(sizes)
        place = np.repeat(begin - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.blob[place].tobytes()


class Pairs(dict):
    """Answers of ``compatible`` by both tokens in one number; starts anew when it is full."""

    def __init__(self, bpe: Bpe) -> None:
        super().__init__()
        self.bpe = bpe

    def __missing__(self, pair: int) -> bool:
        if len(self) >= PAIR_ENTRIES:
            self.clear()
        answer = self[pair] = self.bpe.compatible(pair >> 20, pair & 0xFFFFF)
        return answer


class Memo(dict):
    """Ids by chunk. When it is full it becomes the older half and starts anew; what is met again comes back from there,
    so frequent chunks stay and a worker's memory is bounded."""

    def __init__(self, bpe: Bpe, before: str) -> None:
        super().__init__()
        self.bpe, self.before = bpe, before
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        ids = self.older.get(chunk)
        if ids is None:
            ids = tuple(self.bpe.pieces(self.before + chunk)) if chunk or self.before else ()
        if len(chunk) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


_SPLIT = regex.compile(SPLIT)
_RUN = re.compile(r"\s ")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def text_of(data: bytes) -> str:
    return data.decode("utf-8", errors="replace")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of every text."""

    def run(batch):
        bpe = load(path)
        texts = batch.column("text").to_pylist()
        yield {"doc_id": batch.column("doc_id"), "ids": [bpe.encode(t or "") for t in texts]}

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every list of ids; null counts as an empty list."""

    def run(batch):
        bpe = load(path)
        yield {"doc_id": batch.column("doc_id"),
               "text": [text_of(bpe.decode(ids or [])) for ids in batch.column("ids").to_pylist()]}

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def encode_checked(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and same of every text: whether the ids decode to the text; a null text counts as empty."""

    return arrow_map(docs.select("doc_id", "text"), lambda batch: checked_slices(load(path), batch),
                     "doc_id long, ids array<int>, same boolean")


def checked_slices(bpe: Bpe, batch) -> Iterator[dict]:
    """The columns of ``encode_checked`` for about ``SLICE_BYTES`` of text at a time; only one slice's texts and ids are Python objects."""
    sizes = [n or 0 for n in binary_sizes(batch.column("text"))]
    for a, b in slices(sizes, SLICE_BYTES):
        part = batch.slice(a, b - a)
        texts = [t or "" for t in part.column("text").to_pylist()]
        ids = [bpe.encode(t) for t in texts]
        yield {"doc_id": part.column("doc_id"), "ids": ids, "same": [text_of(bpe.decode(i)) == t for i, t in zip(ids, texts)]}


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode every text, decode its ids, and return both as digests: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batch):
        bpe = load(path)
        names = [str(i) for i in range(len(bpe.offsets) - 1)]
        counts, ids_sha, text_sha = [], [], []
        for value in batch.column("text"):
            ids = bpe.encode(value.as_py() or "")
            data = text_of(bpe.decode(ids)).encode()
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
            text_sha.append(hashlib.sha256(data).hexdigest())
        yield {"doc_id": batch.column("doc_id"), "n_tokens": counts, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

    return arrow_map(docs.select("doc_id", "text"), run,
                     "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
