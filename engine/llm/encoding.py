"""p8: texts as ids of a public byte-level BPE vocabulary, and back.

An Aho-Corasick automaton over the vocabulary gives the longest token at each place of a piece. Tokens are laid one after the other; a token that
doesn't stand beside the one before it in the exact merge order gives way to its longest proper prefix, and if there is none, the one before it is
taken back. A place that was taken back is never reached again, so the time is linear in the length of a piece. Ids are turned back into bytes by
a table of offsets into all tokens' bytes.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engine.functions.partitions import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the split into pieces that this vocabulary was made with.
PIECES = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Pieces up to this length are kept with their ids; longer ones are encoded each time.
KEPT = 64


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: visible Latin-1 for itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, source: str) -> None:
        """source: the text of the vocabulary's file, with model.vocab and model.merges."""
        model = json.loads(source)["model"]
        letters = byte_letters()
        vocab: dict[str, int] = model["vocab"]
        merges = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        used = {*letters, *("".join(x) for x in merges)}
        size = max(vocab.values()) + 1
        # tokens as strings of one character a byte
        spell = {vocab[w]: "".join(chr(letters[c]) for c in w) for w in used}
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(merges)}
        self.halves = {vocab[a + b]: (vocab[a], vocab[b], r) for r, (a, b) in enumerate(merges)}
        self.length = [0] * size
        self.automaton = ahocorasick.Automaton()
        of = {}
        for i, x in spell.items():
            self.length[i] = len(x)
            of[x] = i
            self.automaton.add_word(x, (i, len(x)))
        self.automaton.make_automaton()
        self.shorter = {i: next((of[x[:n]] for n in range(len(x) - 1, 0, -1) if x[:n] in of), None) for i, x in spell.items()}
        whole = b"".join(spell[i].encode("latin-1") if i in spell else b"" for i in range(size))
        self.bytes = np.frombuffer(whole, np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        self.compatible = lru_cache(1 << 20)(self._compatible)
        self.small = lru_cache(1 << 19)(self._piece)

    def _spine(self, token: int, right: bool) -> list[tuple[int, float]]:
        """The token and its parts along one edge, each with the rank of the merge that consumes it."""
        out, until = [], float("inf")
        while True:
            out.append((token, until))
            if token not in self.halves:
                return out
            a, b, until = self.halves[token]
            token = b if right else a

    def _compatible(self, a: int, b: int) -> bool:
        """Whether b can follow a: no merge over the seam comes before both of its parts are consumed; of equal ranks the left one goes first."""
        for x, x_until in self._spine(a, True):
            for y, y_until in self._spine(b, False):
                r = self.rank.get((x, y))
                if r is not None and r < x_until and r <= y_until:
                    return False
        return True

    def _piece(self, piece: str) -> tuple[int, ...]:
        text = piece.encode().decode("latin-1")
        n = len(text)
        longest = [0] * n
        for end, (token, size) in self.automaton.iter(text):
            longest[end - size + 1] = token  # of one start, longer ones end later
        length, shorter, compatible = self.length, self.shorter, self.compatible
        dead = bytearray(n + 1)
        out: list[int] = []
        at = 0
        token: int | None = longest[0]
        while at < n:
            while token is not None and (dead[at + length[token]] or out and not compatible(out[-1], token)):
                token = shorter[token]
            if token is None:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
            else:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else None
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in PIECES.findall(text):
            out += self.small(piece) if len(piece) <= KEPT else self._piece(piece)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        i = np.asarray(ids if isinstance(ids, np.ndarray) else list(ids), np.int64)
        if not len(i):
            return ""
        sizes = self.offsets[i + 1] - self.offsets[i]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) + np.repeat(self.offsets[i] - (ends - sizes), sizes)
        return self.bytes[places].tobytes().decode("utf-8", "replace")


@lru_cache(4)
def encoder(source: str) -> Encoder:
    """Built once in each Python worker."""
    return Encoder(source)


def encode_texts(frame: DataFrame, id_column: str, text_column: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """id_column and ids ARRAY<INT> for every row; null and empty texts give an empty list. The vocabulary file (1.5 MB, fixed) goes to the workers."""
    with open(vocabulary, encoding="utf-8") as f:
        source = frame.sparkSession.sparkContext.broadcast(f.read())
    kind = frame.schema[id_column].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(source.value)
        for batch in batches:
            ids = [own.encode(x) if x else [] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_column, "ids"])

    return spread(frame.select(F.col(id_column), F.col(text_column))).mapInArrow(encode, f"{id_column} {kind}, ids array<int>")


def decode_ids(frame: DataFrame, id_column: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The text of each row's ids; null ids give an empty text."""
    with open(vocabulary, encoding="utf-8") as f:
        source = frame.sparkSession.sparkContext.broadcast(f.read())
    kind = frame.schema[id_column].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(source.value)
        for batch in batches:
            texts = [own.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_column, "text"])

    return frame.select(F.col(id_column), F.col("ids")).mapInArrow(decode, f"{id_column} {kind}, text string")


def p8_ids(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", vocabulary)
