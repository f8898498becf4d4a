"""Best-fit packing by hierarchical residual packing.

Each partition tokenizes its documents, cuts those over `capacity` ids into pieces, and packs its pieces best-fit in
descending order. Bins whose free space is at most the round's slack are emitted; underfull bins go on as single items:
partitions merge `fan_in` to one (coalesce, no shuffle) and repeat best-fit, so bins fill bins. The last round emits
everything, so nothing is lost; a merged task holds only the underfull bins of fan_in tasks.

A row is a bin: its pieces as parallel arrays. Each round is written to the shared folder, emitted bins once.

Defined cases: a null or empty text is one piece holding id 0 alone; repeated rows are separate documents; ties in
length keep their order of arrival; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import loose_id, materialize, solid_id

CAPACITY = 2048
FAN_IN = 4
SLACKS = (8, 32, 96)
FIELDS = ("doc_id", "piece", "start", "length", "ids_crc32")
BIN_SCHEMA = "sequence_id long, fill long, done boolean, " + ", ".join(f"{c} array<long>" for c in FIELDS)
CACHE_WORDS = 400_000
WINDOW = 1 << 20
SPACE = re.compile(rb"[\t-\r ]")
TASK_PIECES = 1_000_000
BATCH_BINS = 4096

_tokenizers: dict = {}


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class WordCache(dict):
    """Words (bytes) and their ids: this tokenizer never joins across ASCII white space, so each word is encoded once.

    Words of ASCII and Latin letters are cut by the tokenizer's own pattern and go straight to its merges, which run on
    bytes: the vocabulary's numbers rise in the order of its merges, so merging the pair with the lowest number first is
    the same; END, a byte that no text has, stands for the mark of a word's end. All other words go through the whole
    tokenizer. Special tokens are found first, as they are written and even within a word; what lower-casing makes look like one
    is none, so the tokenizer behind the cache is told to take them as plain text. The cache is emptied when it holds CACHE_WORDS
    words, which bounds its memory and changes no result.
    """

    END = b"\xff"
    LATIN = "".join(c for c in map(chr, range(0x80, 0x250)) if c.isalpha() and len(c.lower()) == 1 and ord(c.lower()) < 0x250)
    KNOWN = re.compile(rf"[!-~{LATIN}]+")
    PIECE = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[a-z{LATIN}]+|[0-9]|[^a-z0-9{LATIN}]+")

    def __init__(self, path: str):
        from tiktoken import _tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        letters, ranks, mark, file = _byte_letters(), {}, "</w>", json.loads(Path(path).read_text())
        self.special = {t["content"].encode(): struct.pack("<I", t["id"]) for t in file["added_tokens"]}
        self.marks = re.compile(b"(" + b"|".join(map(re.escape, self.special)) + b")") if self.special else None
        for token, n in file["model"]["vocab"].items():
            ended = token.endswith(mark)
            raw = bytes(letters[c] for c in (token[: -len(mark)] if ended else token))
            if self.END not in raw or not ended:
                ranks[raw + (self.END if ended else b"")] = n
        self.merged = _tiktoken.CoreBPE(ranks, {}, r"\S+").encode_single_piece

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        shown = word.decode()
        if self.KNOWN.fullmatch(shown):
            ids = []
            for p in self.PIECE.findall(shown.lower()):
                ids += self.merged(p.encode() + self.END)
        else:
            ids = self.whole.encode(shown, add_special_tokens=False).ids
        out = self[word] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def encode(self, text: str) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of a text, window by window; windows end at white space."""
        raw, get = text.encode("utf-8", "replace"), self.__getitem__
        at = 0
        while at < len(raw):
            end = at + WINDOW
            if end < len(raw):
                space = SPACE.search(raw, end)
                end = space.start() if space else len(raw)
            for k, part in enumerate(self.marks.split(raw[at:end]) if self.marks else (raw[at:end],)):
                yield self.special[part] if k % 2 else b"".join(map(get, part.lower().split()))  # lower() changes A-Z alone, as the tokenizer would
            at = end


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: FIELDS. The path of the tokenizer file must exist on every executor."""
    path = tokenizer or default_tokenizer()

    def cut(coder: WordCache, doc: int, text: str) -> Iterator[tuple]:
        held, k = b"", 0
        for ids in chain(coder.encode(text), (b"\0\0\0\0",)):
            held += ids
            while len(held) > 4 * capacity:
                own, held = held[: 4 * capacity], held[4 * capacity :]
                yield doc, k, k * capacity, capacity, zlib.crc32(own)
                k += 1
        yield doc, k, k * capacity, len(held) // 4, zlib.crc32(held)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _tokenizers.get(path) or WordCache(path)
        _tokenizers[path] = coder
        for part in parts:
            out = chain.from_iterable(cut(coder, d, t) for d, t in zip(part["doc_id"], part["text"].fillna(""), strict=True))
            yield pd.DataFrame(list(out), columns=list(FIELDS))

    return docs.select(solid_id(F.col("doc_id")).alias("doc_id"), "text").mapInPandas(run, ", ".join(f"{c} long" for c in FIELDS))


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Item numbers of each bin: best-fit decreasing. Bins are found by free space through one bit mask."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        rest = mask >> n
        if rest:
            room = n + (rest & -rest).bit_length() - 1
            at = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
            bins[at].append(k)
        else:
            room, at = capacity, len(bins)
            bins.append([k])
        left = room - n
        free[left].append(at)
        mask |= 1 << left
    return bins


def _packed(lengths: np.ndarray, sizes: np.ndarray, flat: list[np.ndarray], level: int, slack: int, capacity: int) -> Iterator[pd.DataFrame]:
    """Bins over items of the given lengths; an item is the next `sizes` pieces of the flat fields."""
    found = best_fit(lengths, capacity)
    base = (level << 56) | (TaskContext.get().partitionId() << 32)
    starts = np.cumsum(sizes) - sizes
    for first in range(0, len(found), BATCH_BINS):
        own = found[first : first + BATCH_BINS]
        items = np.fromiter(chain.from_iterable(own), np.int64)
        ends = np.cumsum([len(b) for b in own])
        n = sizes[items]
        upto = np.cumsum(n)
        at = np.repeat(starts[items] - upto + n, n) + np.arange(upto[-1])
        fill = np.add.reduceat(lengths[items], np.concatenate(([0], ends[:-1])))
        out = {"sequence_id": base + first + np.arange(len(own)), "fill": fill, "done": fill >= capacity - slack}
        yield pd.DataFrame(out | {c: np.split(f[at], upto[ends[:-1] - 1]) for c, f in zip(FIELDS, flat, strict=True)})


def _first_round(all_pieces: DataFrame, slack: int, capacity: int) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(parts) or [pd.DataFrame(columns=list(FIELDS))])
        if len(part):
            flat = [part[c].to_numpy(np.int64) for c in FIELDS]
            yield from _packed(flat[FIELDS.index("length")], np.ones(len(part), np.int64), flat, 1, slack, capacity)

    return all_pieces.mapInPandas(run, BIN_SCHEMA)


def _next_round(open_bins: DataFrame, level: int, slack: int, capacity: int) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(parts) or [pd.DataFrame({"fill": []})])
        if len(part):
            sizes = np.fromiter(map(len, part["length"]), np.int64, len(part))
            flat = [np.concatenate(part[c].to_numpy()) for c in FIELDS]
            yield from _packed(part["fill"].to_numpy(np.int64), sizes, flat, level, slack, capacity)

    return open_bins.mapInPandas(run, BIN_SCHEMA)


def pack(all_pieces: DataFrame, capacity: int = CAPACITY, fan_in: int = FAN_IN, slacks=SLACKS) -> DataFrame:
    """FIELDS plus sequence_id and offset, one row per piece; input: FIELDS, lengths from 1 to capacity."""
    pieces_ = materialize(all_pieces, "pack-pieces")  # tokenizing and packing then never share a task's memory
    n = -(-pieces_.count() // TASK_PIECES)
    if n > pieces_.rdd.getNumPartitions():  # pieces are small, so one task may read those of many
        pieces_ = pieces_.repartition(n)
    level = materialize(_first_round(pieces_, slacks[0], capacity), "pack-1")
    levels = [level.where("done")]
    for k, slack in enumerate((*slacks[1:], capacity), 2):
        left = level.where("not done")
        left = left.coalesce(max(1, -(-left.rdd.getNumPartitions() // fan_in)))
        level = materialize(_next_round(left, k, slack, capacity), f"pack-{k}")
        levels.append(level.where("done") if slack < capacity else level)
    one = F.posexplode(F.arrays_zip(*FIELDS)).alias("k", "x")
    bins = reduce(DataFrame.union, levels).select("sequence_id", F.col("length").alias("lengths"), one)
    before = F.aggregate(F.slice("lengths", 1, F.col("k")), F.lit(0).cast("long"), lambda a, x: a + x)
    out = bins.select(*(f"x.{c}" for c in FIELDS), "sequence_id", before.alias("offset"))
    return out.withColumn("doc_id", loose_id(F.col("doc_id")))
