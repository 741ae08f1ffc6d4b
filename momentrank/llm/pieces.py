"""SentencePiece encoding and decoding with forward scores shared over common prefixes.

White space becomes marks, and no piece goes on from a character to a mark, so a text is a run of marked words. A
block's distinct words are sorted, which lists their trie depth first: a word keeps the forward states of the prefix it
shares with the word before, and only its own characters are worked out. A state holds its last piece alone, which points
back to the state before it, so a word of a million letters takes a million numbers. Words that a worker has coded
lately are kept, up to 200 letters each.

A forward state is the best last piece of a prefix. For a unigram model that is Viterbi's, by the sum of scores. A BPE
model's scores are merge ranks, whose sum says nothing; its segmentation is the one in which every two neighbouring
pieces are what their joint text is coded to, and exactly one last piece of a prefix continues such a chain. So for
BPE the state takes the piece that is feasible after the state it starts from, and ids equal the library's.

Defined results: a null or empty text has no ids and decodes to ''; characters without a piece become their bytes, or the
unknown id in a model without byte pieces; a mark in the text decodes to a space, as with the library. Rows are coded
where they stand, repeated ones too. Extra columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
#: Characters coded at once, and words that a worker remembers.
BLOCK = 3_000_000
CACHE = 40_000
#: A longer word is coded and forgotten, so that what a worker remembers is bounded in letters too.
LONG = 200
#: Pairs of pieces that a worker remembers.
PAIRS = 300_000
#: Where the query finds its model; a parameter of all functions below.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


class Codec:
    def __init__(self, model: bytes, kind: str = "bpe") -> None:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(sp.get_piece_size())
        plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.kind, self.unknown = kind, sp.unk_id()
        self.pieces = {sp.id_to_piece(i): i for i in plain}
        self.scores = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.bytes = {int(sp.id_to_piece(i)[1:-1], 16): i for i in ids if sp.is_byte(i)}
        self.texts = [b""] * len(ids)
        for p, i in self.pieces.items():
            self.texts[i] = p.replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            self.texts[i] = bytes([b])
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece goes over the end of a word")
        joint = "".join(sorted({c for p in self.pieces if len(p) > 1 for c in p if c != MARK}))
        among = lambda c: f"[{re.escape(c)}]+" if c else r"(?!)"
        kinds = [among(joint)]
        if not any(a.isalpha() != b.isalpha() for p in self.pieces for a, b in zip(p, p[1:]) if a != MARK):
            # no piece joins a letter and something else, so a word ends between them
            kinds = [among("".join(c for c in joint if c.isalpha())), among("".join(c for c in joint if not c.isalpha()))]
        self.word = re.compile(f"{MARK}*(?:{'|'.join(kinds)})|{MARK}+|.", re.S)
        self.longest = max(map(len, self.pieces), default=1)
        #: Lengths, longest first, of the pieces that may end with these three characters, or be these two; two always may.
        self.lengths: dict[str, list[int]] = {}
        for p in self.pieces:
            if len(p) > 1:
                self.lengths.setdefault(p[-3:], []).append(len(p))
        self.lengths = {t: sorted({*n, 2}, reverse=True) for t, n in self.lengths.items()}
        self.names = [""] * len(ids)
        for p, i in self.pieces.items():
            self.names[i] = p
        self.single: dict[str, int] = {}  # characters that are no piece get numbers after the pieces
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.worst = min(self.scores.values(), default=0.0) - 10.0  # of an unknown character, in a unigram model

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: the best pair, leftmost first, until no pair is a piece."""
        parts = list(text)
        while True:
            pairs = [(-self.scores[p], i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.scores]
            if not pairs:
                return parts
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def follows(self, a: int, b: int) -> bool:
        """Whether the joint text of two pieces is coded to just these; -1 is the word's start."""
        both = [self.names[i] for i in (a, b) if i >= 0]
        return self.merged("".join(both)) == both

    def number(self, c: str) -> int:
        """Of a single character, which need not be a piece."""
        found = self.pieces.get(c)
        if found is None:
            found = self.single.get(c)
        if found is None:
            found = self.single[c] = len(self.names)
            self.names.append(c)
        return found

    def output(self, i: int) -> tuple[int, ...]:
        if i < len(self.texts):
            return (i,)
        return tuple(self.bytes[b] for b in self.names[i].encode("utf-8", "replace")) if self.bytes else (self.unknown,)

    def best_score(self, word: str, end: int, scores: list[float]) -> tuple[float, int]:
        """Viterbi's step of a unigram model: the last piece that gives the prefix its best score."""
        best = (scores[end - 1] + self.scores.get(word[end - 1], self.worst), self.number(word[end - 1]))
        for start in range(max(0, end - self.longest), end - 1):
            score = self.scores.get(word[start:end])
            if score is not None and scores[start] + score > best[0]:
                best = (scores[start] + score, self.pieces[word[start:end]])
        return best

    def learn(self, words: Iterable[str]) -> None:
        """Code distinct words, in the order of their trie; each prefix has its last piece and its ids."""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        (self.learn_bpe if self.kind == "bpe" else self.learn_unigram)(sorted(words))

    def traced(self, last: list[int], end: int) -> tuple[int, ...]:
        """The ids of a prefix, from each state's last piece back to the word's start."""
        names, found = self.names, []
        while end:
            i = last[end]
            found.append(i)
            end -= len(names[i])
        found.reverse()
        if max(found) < len(self.texts):
            return tuple(found)
        return tuple(chain.from_iterable(map(self.output, found)))

    def learn_unigram(self, words: list[str]) -> None:
        scores, last, before = [0.0], [-1], ""
        for word in words:
            same = len(os.path.commonprefix((before, word)))
            del scores[same + 1 :], last[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                score, piece = self.best_score(word, end, scores)
                scores.append(score)
                last.append(piece)
            self.known[word], before = self.traced(last, len(word)), word

    def learn_bpe(self, words: list[str]) -> None:
        """A prefix's last piece is the one that may follow the state it starts from; exactly one does."""
        known, pairs, follows = self.known, self.pairs, self.follows
        piece, lengths, number, traced = self.pieces.get, self.lengths.get, self.number, self.traced
        two = (2,)
        last, before = [-1], ""  # the last piece of each prefix, which is its back-pointer too; -1 is the start
        for word in words:
            same = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                same += 1
            del last[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                tail = word[end - 3 : end] if end > 2 else word[:end]
                for n in lengths(tail, two):
                    if n > end:
                        continue
                    b = piece(word[end - n : end])
                    if b is None:
                        continue
                    key = (last[end - n] + 1) << 24 | b
                    fits = pairs.get(key)
                    if fits is None:
                        fits = pairs[key] = follows(last[end - n], b)
                    if fits:
                        last.append(b)
                        break
                else:
                    last.append(number(word[end - 1]))  # no longer one fits, so this one does
            known[word] = traced(last, len(word))
            before = word

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ends of each text's ids, from 0, and all ids."""
        ends, parts, at = [0], [], 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (to == at or size + len(texts[to] or "") <= BLOCK):
                size += len(texts[to] or "")
                to += 1
            words = [self.word.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts[at:to]]
            if len(self.known) > CACHE:  # words of the last generation stay in reach, and move over when they are met
                self.known, self.older = {}, self.known
            known, older = self.known, self.older
            new = set().union(*words) - known.keys()
            again = new & older.keys()
            known.update((w, older[w]) for w in again)
            self.learn(new - again)
            for own in words:
                ids = np.fromiter(chain.from_iterable(map(known.__getitem__, own)), np.int32)
                parts.append(ids)
                ends.append(ends[-1] + len(ids))
            for w in [w for w in new if len(w) > LONG]:
                del known[w]
            at = to
        return np.array(ends, np.int64), np.concatenate([np.zeros(0, np.int32), *parts])

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.texts.__getitem__, ids))
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def codec_of(model: bytes, kind: str) -> Codec:
    """One a worker: pairs of pieces are worked out once and not again in each task."""
    return Codec(model, kind)


def slices(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Parts of batches with about BLOCK characters each."""
    for b in batches:
        size = pc.fill_null(pc.utf8_length(b.column(text)), 0).to_numpy(zero_copy_only=False).cumsum() // BLOCK
        edges = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), b.num_rows]
        for a, z in zip(edges, edges[1:]):
            if z > a:
                yield b.slice(a, z - a)


def read_model(path: str) -> bytes:
    """On the driver; the model, under a megabyte, goes to the workers with the function."""
    with open(path, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, model: str = MODEL, text_col: str = "text", ids_col: str = "ids", kind: str = "bpe") -> DataFrame:
    """``docs`` with an array column of ids; a column that has its name already is replaced."""
    data = read_model(model)
    rows = docs.drop(ids_col)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(data, kind)
        for b in slices(batches, text_col):
            ends, ids = codec.encode(b.column(text_col).to_pylist())
            yield b.append_column(ids_col, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)))

    return rows.mapInArrow(each, T.StructType([*rows.schema, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decoded(docs: DataFrame, model: str = MODEL, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``docs`` with a text column made from ids; null ids give ''."""
    data = read_model(model)
    rows = docs.drop(text_col)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(data, "bpe")
        for b in batches:
            yield b.append_column(text_col, pa.array([codec.decode(x or ()) for x in b.column(ids_col).to_pylist()], pa.string()))

    return rows.mapInArrow(each, T.StructType([*rows.schema, T.StructField(text_col, T.StringType())]))


def coded(docs: DataFrame, model: str = MODEL, kind: str = "bpe") -> DataFrame:
    """``doc_id, n_ids, ids_sha256, decoded_sha256, exact``: ids as little-endian 32-bit integers, and whether they decode to the text."""
    data = read_model(model)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(data, kind)
        for b in slices(batches, "text"):
            texts = b.column("text").to_pylist()
            ends, ids = codec.encode(texts)
            out: list[tuple] = []
            for t, a, z in zip(texts, ends, ends[1:]):
                back = codec.decode(ids[a:z].tolist())
                sha = lambda x: hashlib.sha256(x).hexdigest()
                out.append((z - a, sha(ids[a:z].astype("<i4").tobytes()), sha(back.encode()), back == (t or "")))
            n, own, other, same = zip(*out)
            columns = [pa.array(n, pa.int64()), pa.array(own), pa.array(other), pa.array(same)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "n_ids", "ids_sha256", "decoded_sha256", "exact"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(each, "doc_id long, n_ids long, ids_sha256 string, decoded_sha256 string, exact boolean")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
