"""Byte-level BPE by prefix sharing, without a merge loop per word.

The encoding of a word's prefix ends in one token, and what stands before that token is the
encoding of a shorter prefix. So one number for each prefix, its last token, holds the
encodings of the word and of all its prefixes. The distinct new words of a batch form a trie;
it is walked depth first (sorted words are that walk, the common part of neighbours being the
shared nodes), and each node gets its last token from the states above it. A token can be last
if it may stand after the token in front of it: merging the two tokens' bytes alone yields
just these two. Which tokens a prefix ends in is known from its state, its longest end that
begins a token.

Encoded words are kept for the rest of the task, ``CACHE_WORDS`` at most; then the cache
starts anew, which costs time and changes nothing.
"""

from __future__ import annotations

import hashlib
import gc
import json
from collections.abc import Iterator
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_WORDS = 300_000
CACHE_PAIRS = 1_000_000
#: Texts are cut and their new words walked together up to so many characters.
TRIE_CHARS = 2_000_000

#: The public pattern that cuts text into words, and the printable stand-ins
#: for bytes in the vocabulary file (printable Latin-1 bytes stand for themselves, the
#: others follow from 256 on).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Vocabulary:
    """Tokens, merges and special tokens of a vocabulary file in the tokenizers format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            parsed = json.load(file)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        model = parsed["model"]
        self.ids = {raw(token): i for token, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * size
        self.sizes: list[int] = []
        self.shown = [str(i) for i in range(size)]
        for token, i in self.ids.items():
            self.bytes[i] = token
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.sizes = [len(t) for t in self.bytes]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = map(raw, merge.split(" ") if isinstance(merge, str) else merge)
            self.ranks[self.ids[left], self.ids[right]] = rank, self.ids[left + right]
        #: when a token is made (its merge's rank; bytes: -1), of which two, and by pair
        self.born = [-1] * size
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge_rank = {a << 32 | b: rank for (a, b), (rank, _) in self.ranks.items()}
        for pair, (rank, made) in self.ranks.items():
            if made not in self.parts:
                self.parts[made], self.born[made] = pair, rank
        #: Beginnings of tokens are states: a text's state is its longest end that is one, so all
        #: tokens it ends in are ends of the state. States and steps are made when first met.
        self.beginnings = {token[:n] for token in self.ids for n in range(1, len(token) + 1)}
        self.states: dict[bytes, int] = {b"": 0}
        self.state_bytes: list[bytes] = [b""]
        #: by state: (length, token) of the tokens it ends in, longest first
        self.ends: list[list[tuple[int, int]]] = [[]]
        self.steps: dict[int, int] = {}
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]

    def step(self, state: int, byte: int) -> int:
        """The state after one more byte; kept for the next time."""
        end = self.state_bytes[state] + bytes([byte])
        while end not in self.beginnings:
            end = end[1:]
        after = self.states.get(end)
        if after is None:
            after = self.states[end] = len(self.ends)
            self.state_bytes.append(end)
            tails = (end[at:] for at in range(len(end)))
            self.ends.append([(len(t), self.ids[t]) for t in tails if t in self.ids])
        if len(self.steps) >= CACHE_PAIRS:
            self.steps.clear()
        self.steps[state << 8 | byte] = after
        return after

    def merged(self, word: bytes) -> list[int]:
        """Plain BPE: the best-ranked pair first, leftmost among equals."""
        ids = [self.byte_ids[b] for b in word]
        while len(ids) > 1:
            rank, at = min(
                (self.ranks[pair][0], i) if pair in self.ranks else (len(self.ranks), i)
                for i, pair in enumerate(zip(ids, ids[1:]))
            )
            if rank == len(self.ranks):
                break
            ids[at : at + 2] = [self.ranks[ids[at], ids[at + 1]][1]]
        return ids


class Encoder:
    """Encodes and decodes texts; keeps the words it has met."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.pattern = regex.compile(PATTERN)
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")")
        self.special_names = special
        #: word -> (ids as little-endian unsigned 32-bit bytes, ids as decimal text, bytes of the ids' tokens)
        self.words: dict[str, tuple[bytes, str, bytes]] = {}
        self.pairs: dict[int, bool] = {}
        gc.freeze()  # long-lived and free of cycles: not worth a look at every collection
        gc.disable()

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of two tokens gives these two tokens again.

        Merges run in order of rank. Seen backwards, the younger token beside the border is
        undone again and again, and what touches the border must never have been a pair that
        merges earlier than what is undone. Equal ranks go to the left one first.
        """
        key = left << 32 | right
        v = self.vocabulary
        limit, good = len(v.born), True
        while True:
            merge = v.merge_rank.get(left << 32 | right)
            if merge is not None and merge < limit:
                good = False
                break
            if v.born[left] < 0 and v.born[right] < 0:
                break
            if v.born[left] > v.born[right]:
                limit = v.born[left]
                left = v.parts[left][1]
            else:
                limit = v.born[right] + 1
                right = v.parts[right][0]
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[key] = good
        return good

    def walk(self, words: list[bytes]) -> Iterator[list[int]]:
        """Token ids of each word; ``words`` are distinct and sorted, which is trie order."""
        v, known, fits = self.vocabulary, self.pairs.get, self._fits
        step, ends, size_of = v.steps.get, v.ends, v.sizes
        path = b""
        last: list[int] = [-1]  # last[i]: last token of the prefix of i bytes
        states: list[int] = [0]  # and its state
        for word in words:
            shared, end = 0, min(len(path), len(word))
            while shared < end and path[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], states[shared + 1 :]
            state, size = states[shared], shared
            for byte in word[shared:]:
                size += 1
                after = step(state << 8 | byte)
                state = v.step(state, byte) if after is None else after
                states.append(state)
                for n, token in ends[state]:
                    if n == size:
                        break
                    fit = known(last[size - n] << 32 | token)
                    if fit or fit is None and fits(last[size - n], token):
                        break
                else:
                    raise ValueError(f"no last token for {word[:size]!r}")
                last.append(token)
            path = word
            out, at = [], len(word)
            while at:
                token = last[at]
                out.append(token)
                at -= size_of[token]
            out.reverse()
            yield out

    def learn(self, pieces: set[str]) -> None:
        """Encodes pieces of text (each cut by the pattern first) into the cache."""
        words, shown, table = self.words, self.vocabulary.shown, self.vocabulary.bytes
        new: dict[bytes, str] = {}
        cut: dict[str, list[str]] = {}
        for piece in pieces:
            # A to Z alone, or after one blank, are one word of the pattern.
            bare = piece[1:] if piece[0] == " " else piece
            if bare.isascii() and bare.isalpha():
                new[piece.encode()] = piece
            else:
                cut[piece] = self.pattern.findall(piece)
        new |= {w.encode(): w for ws in cut.values() for w in ws if w not in words}
        order = sorted(new)
        for word, ids in zip(order, self.walk(order)):
            words[new[word]] = (
                pack(f"<{len(ids)}I", *ids), ",".join([shown[i] for i in ids]), b"".join([table[i] for i in ids])
            )
        for piece, ws in cut.items():
            if len(ws) > 1:
                own = [words[w] for w in ws]
                words[piece] = (
                    b"".join([w[0] for w in own]), ",".join([w[1] for w in own]), b"".join([w[2] for w in own])
                )

    def _pieces(self, text: str) -> list[str]:
        """Parts that the pattern cuts independently of each other.

        Where white space stands singly between words, a blank opens the next word and a
        line feed is a word of its own. Other texts are cut by the pattern as a whole.
        """
        words = text.split()
        if len(text) != sum(map(len, words)) + len(words) - 1:
            return self.pattern.findall(text)
        pieces: list[str] = []
        lines = text.split("\n")
        for n, line in enumerate(lines):
            if n:
                pieces.append("\n")
            if line:
                first, *rest = line.split(" ")
                if first:
                    pieces.append(first)
                pieces += [" " + word for word in rest]
        return pieces

    def pieces(self, text: str) -> list[str]:
        """Pieces of a text; special tokens stand alone, as their literal names."""
        if not any(name in text for name in self.special_names):
            return self._pieces(text)
        out: list[str] = []
        for n, part in enumerate(self.special.split(text)):
            if n % 2:
                out.append(part)
            elif part:
                out += self._pieces(part)
        return out

    def encode(self, texts: list[str]) -> Iterator[list[tuple[bytes, str, bytes]]]:
        """Encoded pieces of each text, in order; new words share tries of ``TRIE_CHARS``."""
        part, size = [], 0
        for text in texts:
            part.append(text)
            size += len(text)
            if size >= TRIE_CHARS:
                yield from self._encode(part)
                part, size = [], 0
        yield from self._encode(part)

    def _encode(self, texts: list[str]) -> Iterator[list[tuple[bytes, str, bytes]]]:
        cut = [self.pieces(text) for text in texts]
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        new = set().union(*cut).difference(self.words)
        for name in new.intersection(self.special_names):
            i = self.vocabulary.special[name]
            self.words[name] = pack("<I", i), str(i), self.vocabulary.bytes[i]
        self.learn(new.difference(self.special_names))
        words = self.words
        for pieces in cut:
            yield [words[p] for p in pieces]

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        for pieces in self.encode(texts):
            yield b"".join([ids for ids, _, _ in pieces])

    def decode(self, ids: list[int]) -> str:
        table = self.vocabulary.bytes
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


def encoded(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` with ``token_ids`` array<int>, the ids of its column ``text`` (null: empty).

    Other columns stay as they are; a column called token_ids is replaced.
    """
    path = path or default_vocabulary()

    @F.pandas_udf("array<int>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(path)
        for batch in texts:
            yield pd.Series([
                np.frombuffer(ids, "<u4").astype("int32")
                for ids in encoder.ids([t or "" for t in batch])
            ])

    return df.withColumn("token_ids", encode("text"))


def decoded(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` with ``decoded``, the text of its column ``token_ids`` (null: empty)."""
    path = path or default_vocabulary()

    @F.pandas_udf("string")
    def decode(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(path)
        for batch in ids:
            yield pd.Series([encoder.decode([] if x is None else x.tolist()) for x in batch])

    return df.withColumn("decoded", decode("token_ids"))


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: token count and digests of its ids and of the text decoded from them.

    ``docs`` has doc_id and text; null texts count as empty; every row gives a row, repeated
    rows too. Columns beside these two are not read. A map over the table: no shuffle.
    """
    path = path or default_vocabulary()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for pieces in encoder.encode([t or "" for t in batch.column(1).to_pylist()]):
                # Ids are decoded once for each distinct piece; a text's bytes are those of its pieces.
                ids, shown, raw = zip(*pieces) if pieces else ((), (), ())
                counts.append(sum(map(len, ids)) // 4)
                ids_sha.append(hashlib.sha256(",".join(shown).encode()).hexdigest())
                text = b"".join(raw).decode("utf-8", "replace")
                text_sha.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()),
                 pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(digest, schema)


__all__ = ["Encoder", "Vocabulary", "decoded", "default_vocabulary", "encoded", "token_digests"]
