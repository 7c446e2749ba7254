"""Operator 8: byte-level BPE encoding and decoding by batched numpy merge rounds.

The words of many texts are reduced to their distinct ones; those not seen before are merged together, all symbols in one
flat array: each round finds the rank of every neighbouring pair by binary search over the sorted pair keys, takes the
lowest rank of each word, and merges it wherever it stands in that word.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import others

#: How byte-level BPE cuts a text into words: a fixed value of the public vocabulary.
WORD = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct words that a worker remembers; beyond it, it forgets all and starts anew, which changes no result.
REMEMBERED = 250_000
#: Bytes of the longest word that is remembered.
LONGEST = 64


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes for themselves, the
    others, in order, from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, n = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(0x100 + n)
            n += 1
    return [out[b] for b in range(256)]


class Bpe:
    """A byte-level BPE vocabulary of the tokenizers library's JSON form."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.first = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.width = 1 << (max(vocab.values()) + 1).bit_length()
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        of = {c: b for b, c in enumerate(letters)}
        self.bytes = {i: bytes(of[c] for c in token) for token, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.named = {str(i): b for i, b in self.bytes.items()}
        self.split = regex.compile(WORD).findall
        # Alternatives in order of length: the longest special token wins where several begin.
        marks = sorted(self.special, key=len, reverse=True)
        self.mark = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.seen: dict[str, str] = {}

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each non-empty word."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        sym = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = np.int64(len(self.ranks))
        while len(sym) > 1:
            pair = sym[:-1] * self.width + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where((self.keys[at] == pair) & (word[:-1] == word[1:]), self.ranks[at], none)
            start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            rank_of = np.concatenate((rank, [none]))
            least = np.minimum.reduceat(rank_of, start)
            length = np.diff(np.concatenate((start, [len(sym)])))
            low = np.repeat(least, length)
            over = low == none
            if over.any():
                done.append((word[over], sym[over]))
            hit = (rank_of == low) & ~over
            # Of overlapping occurrences (a pair of equal symbols) every other one counts, from the left.
            i = np.flatnonzero(hit)
            if not len(i):
                break
            head = np.concatenate(([True], i[1:] != i[:-1] + 1))
            run = np.maximum.accumulate(np.where(head, np.arange(len(i)), 0))
            i = i[(np.arange(len(i)) - run) % 2 == 0]
            sym[i] = self.merged[rank_of[i]]
            stay = ~over
            stay[i + 1] = False
            sym, word = sym[stay], word[stay]
        else:
            done.append((word, sym))
        words_, syms = np.concatenate([w for w, _ in done]), np.concatenate([s for _, s in done])
        order = np.argsort(words_, kind="stable")
        return np.split(syms[order], np.cumsum(np.bincount(words_, minlength=len(words)))[:-1])

    def learn(self, words: set[str]) -> None:
        """Remembers the ids of words, as the decimal ids joined by commas."""
        new = [w for w in words if w not in self.seen]
        if len(self.seen) + len(new) > REMEMBERED:
            self.seen.clear()
            new = list(words)
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            for w, ids in zip(part, self.merge([w.encode() for w in part]), strict=True):
                self.seen[w] = ",".join(map(str, ids.tolist()))

    def pieces(self, text: str) -> Iterator[str | int]:
        """The words of a text; a special token is given as its id."""
        for part in self.mark.split(text) if self.mark and self.mark.search(text) else (text,):
            if part in self.special:
                yield self.special[part]
            elif part:
                yield from self.split(part)

    def encode(self, texts: list[str]) -> list[tuple[int, str]]:
        """(number of ids, the ids in decimal joined by commas) of each text."""
        cut = [self.split(t) if not (self.mark and self.mark.search(t)) else list(self.pieces(t)) for t in texts]
        distinct = set().union(*cut)
        for x in [x for x in distinct if isinstance(x, int)]:
            distinct.discard(x)
        self.learn(distinct)
        seen = self.seen
        out = []
        for words in cut:
            try:
                ids = ",".join(map(seen.__getitem__, words))
            except KeyError:
                ids = ",".join(str(w) if isinstance(w, int) else seen[w] for w in words)
            out.append((ids.count(",") + 1 if ids else 0, ids))
        # Long words would fill the memory without ever coming back.
        for w in distinct:
            if len(w) > LONGEST:
                seen.pop(w, None)
        return out

    def decode(self, ids: str) -> str:
        """The text of ids in decimal joined by commas; bytes that are no UTF-8 become U+FFFD."""
        if not ids:
            return ""
        return b"".join(map(self.named.__getitem__, ids.split(","))).decode("utf-8", errors="replace")


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The vocabulary at ``path``, read once a worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def _texts(column: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows of about ``most`` characters."""
    at, run, size = 0, [], 0
    for i, x in enumerate(column):
        t = x.as_py() or ""
        if run and size + len(t) > most:
            yield at, run
            at, run, size = i, [], 0
        run.append(t)
        size += len(t)
    if run:
        yield at, run


def _encoder(path: str, finish: Callable[[Bpe, str, int, str], tuple], kinds: list[pa.DataType]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for at, texts in _texts(batch.column(batch.num_columns - 1)):
                made = [finish(bpe, t, n, ids) for t, (n, ids) in zip(texts, bpe.encode(texts), strict=True)]
                rest = [batch.column(i).slice(at, len(texts)) for i in range(batch.num_columns - 1)]
                yield rest, list(zip(*made, strict=True))

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rest, made in run(batches):
            arrays = [*rest, *(pa.array(x, type=t) for x, t in zip(made, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=[str(i) for i in range(len(arrays))])

    return arrow


def _digests(bpe: Bpe, text: str, n: int, ids: str) -> tuple[int, str, str]:
    return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()


def _ids_only(n: int, ids: str) -> tuple[int, list[int]]:
    return n, list(map(int, ids.split(","))) if ids else []


def _ids(bpe: Bpe, text: str, n: int, ids: str) -> tuple[int, list[int], str]:
    return *_ids_only(n, ids), bpe.decode(ids)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of ``docs`` (doc_id, text): the ids of the whole text
    (special tokens in it included) and the text that they decode to.

    - A null text counts as empty: no ids, and the digests of the empty string.
    - Texts of any length are encoded whole. Repeated rows give repeated results; an empty table gives an empty one.
    """
    out = "doc_id {}, n_tokens long, ids_sha256 string, decoded_sha256 string".format(dict(docs.dtypes)["doc_id"])
    return docs.select("doc_id", "text").mapInArrow(_encoder(path, _digests, [pa.int64(), pa.string(), pa.string()]), out)


def _passing(docs: DataFrame, path: str, types: dict[str, pa.DataType], finish: Callable[[Bpe, str, int, str], tuple]) -> DataFrame:
    new = [x.split()[0] for x in types]
    kept = others(docs, [*new, "text"])
    given = docs.select(*kept, F.col("text").alias("_gl_text"))
    schema = "".join(f"`{i}` {t}, " for i, (_, t) in enumerate(given.dtypes[:-1]))
    made = given.mapInArrow(_encoder(path, finish, list(types.values())), schema + ", ".join(types))
    return made.toDF(*given.columns[:-1], *new)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with n_tokens (long), token_ids (array of int) and decoded (string) in place of text; other input columns of
    these names are left out, all others pass through. Texts are treated as by ``digests``."""
    types = {"n_tokens long": pa.int64(), "token_ids array<int>": pa.list_(pa.int32()), "decoded string": pa.string()}
    return _passing(docs, path, types, _ids)


def encode_checked(docs: DataFrame, path: str) -> DataFrame:
    """As ``encode``, with the digests of ids and decoded text in place of the decoded text."""

    def finish(bpe: Bpe, text: str, n: int, ids: str) -> tuple[int, list[int], str, str]:
        return (*_ids_only(n, ids), *_digests(bpe, text, n, ids)[1:])

    digest = {"ids_sha256 string": pa.string(), "decoded_sha256 string": pa.string()}
    return _passing(docs, path, {"n_tokens long": pa.int64(), "token_ids array<int>": pa.list_(pa.int32())} | digest, finish)
