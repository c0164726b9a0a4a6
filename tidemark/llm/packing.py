"""Packing of token sequences into windows by Karmarkar-Karp multiway differencing.

Documents are tokenised once and cut into pieces: whole windows first, the rest into
pieces of PIECE ids and a shorter last one; the short ones even out the windows. Pieces
of a whole window fill one alone and are only numbered. The others are dealt at random into groups of bounded size; in each group differencing
merges the two partial partitions with the largest spread, largest sums against
smallest, until one partition into near-equal windows is left. It starts from the
least window count that could hold the group, which rises while any window exceeds
the capacity.
"""

from __future__ import annotations

import gc
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import Kept, fresh, map_rows, materialize

WINDOW = 2048
PIECE = 256
#: Windows in a group: so many are balanced together, and about half of one is padding.
GROUP_WINDOWS = 192
#: Words that a worker keeps at most of each of two kinds, and bytes of both with their ids, of which whole words have most.
CACHE = 500_000
CACHE_BYTES = 256 << 20
#: Fixed value: how byte-level BPE of this family splits a text before merging.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]
_CUT = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """Byte-level BPE ids of whole texts, as little-endian unsigned 32-bit bytes.

    Such a tokenizer never merges across a space between two characters that are not
    white space, so each word there goes to the tokenizer's model once and is kept.
    The ids are those of encode(text, add_special_tokens=False): strings of added
    tokens in a text become their ids, and what stands between is encoded by itself.
    """

    def __init__(self, path: str, kept_bytes: int | None = None) -> None:
        import os

        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        tokenizer = Tokenizer.from_file(path)
        if tokenizer.normalizer is not None or not isinstance(tokenizer.pre_tokenizer, ByteLevel) or tokenizer.pre_tokenizer.add_prefix_space:
            raise ValueError("a plain byte-level tokenizer is needed")
        added = tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens that match by what is beside them are not supported")
        self.added = {t.content: struct.pack("<I", i) for i, t in added.items()}
        self.cut_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split
        self.tokenize = tokenizer.model.tokenize
        self.split = regex.compile(BYTE_LEVEL_PATTERN).findall
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        other = [b for b in range(256) if b not in set(plain)]
        self.symbol = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
        self.space = self.symbol[32]
        kept_bytes = kept_bytes or CACHE_BYTES
        self.known = Kept(self._word, kept_bytes * 3 // 4, CACHE)
        self.parts = Kept(self._part, kept_bytes // 4, CACHE)

    def _ids(self, part: str) -> bytes:
        if part.isascii() and part[1:].isalpha():  # each byte but a first space is its own symbol
            part = self.space + part[1:] if part[0] == " " else part if part.isalpha() else self._symbols(part)
        else:
            part = self._symbols(part)
        return self._of(part)

    def _of(self, symbols: str) -> bytes:
        found = [t.id for t in self.tokenize(symbols)]
        return _PACK[len(found)](*found) if len(found) < len(_PACK) else struct.pack(f"<{len(found)}I", *found)

    def _symbols(self, part: str) -> str:
        return "".join(map(self.symbol.__getitem__, part.encode()))

    def _word(self, word: str) -> bytes:
        """Ids of a space and a word; letters, with or without a mark after them, need no split."""
        if word.isalpha():
            return self._of(self.space + word if word.isascii() else self._symbols(" " + word))
        if not word or word[0].isspace() or word[-1].isspace():
            raise ValueError("not between two characters that are not white space")
        if word[-1] in ".,;:!?" and word[:-1].isalpha():
            return self.known[word[:-1]] + self.parts[word[-1]]
        return self.encode_whole(" " + word)

    def _part(self, part: str) -> bytes:
        return self.known[part[1:]] if part[0] == " " and part[1:].isalpha() else self._ids(part)

    def encode_whole(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, self.split(text)))

    def encode(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            return b"".join([self.added[t] if i % 2 else self._between(t) for i, t in enumerate(self.cut_added(text))])
        return self._between(text)

    def _between(self, text: str) -> bytes:
        words = text.split(" ")
        try:
            return b"".join([self.encode_whole(words[0]), *map(self.known.__getitem__, words[1:])])
        except ValueError:
            words = _CUT.split(text)
            return b"".join([self.encode_whole(words[0]), *[self.encode_whole(" " + w) if w[-1].isspace() else self.known[w] for w in words[1:]]])


_encoders: dict[tuple[str, int | None], Encoder] = {}


def cut(n: int, window: int = WINDOW, piece: int = PIECE) -> Iterator[tuple[int, int]]:
    """Start and length of the pieces of n ids."""
    whole = n - n % window
    yield from ((at, window) for at in range(0, whole, window))
    yield from ((at, min(piece, n - at)) for at in range(whole, n, piece))


def tokenize(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = 1, window: int = WINDOW, piece: int = PIECE, kept_bytes: int | None = None) -> DataFrame:
    """Pieces of every document: key, start, length, doc_tokens and ids (binary, little-endian 32 bit).

    The ids are those of the text, then end_id. A null text counts as empty and gives
    one piece, of end_id alone; a text of any length is cut as a whole. Repeated rows, and
    rows with a null key, each give their own pieces. Other columns are not kept. A
    worker keeps words of kept_bytes, CACHE_BYTES if not given, and as many old ones.
    """
    kind = df.schema[key].dataType.simpleString()
    end = struct.pack("<I", end_id)

    def run(columns: dict[str, list]) -> dict[str, list]:
        if (path, kept_bytes) not in _encoders:
            gc.set_threshold(200_000)  # what is kept has no cycles, and is long to go through
            _encoders[path, kept_bytes] = Encoder(path, kept_bytes)
        out: dict[str, list] = {key: [], "start": [], "length": [], "doc_tokens": [], "ids": []}
        for doc, value in zip(columns[key], columns[text], strict=True):
            ids = _encoders[path, kept_bytes].encode(value or "") + end
            for a, n in cut(len(ids) // 4, window, piece):
                out[key].append(doc)
                out["start"].append(a)
                out["length"].append(n)
                out["doc_tokens"].append(len(ids) // 4)
                out["ids"].append(ids[4 * a : 4 * (a + n)])
        return out

    return map_rows(df, [key, text], run, f"`{key}` {kind}, start long, length long, doc_tokens long, ids binary")


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Split the items into `windows` lists of near-equal sums (Karmarkar and Karp's largest differencing).

    A partial partition is the sums of its windows that aren't empty, in falling
    order, each with the number of a node that says what it was merged from.
    """
    bits = 32
    mask = (1 << bits) - 1
    nodes: list[tuple[int, int] | None] = [None] * len(sizes)
    heap = [(-n if windows > 1 else 0, i, [n << bits | i]) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, i, b = heap[0]
        free = windows - len(b)  # so many of the largest of a meet an empty window of b
        b = b[::-1]
        merged = a[:free]
        for x, y in zip(a[free:], b):
            merged.append(((x >> bits) + (y >> bits)) << bits | len(nodes))
            nodes.append((x & mask, y & mask))
        merged += b[max(0, len(a) - free) :]
        merged.sort(reverse=True)
        spread = (merged[0] >> bits) - (merged[-1] >> bits if len(merged) == windows else 0)
        heapq.heapreplace(heap, (-spread, i, merged))
    out = []
    for x in heap[0][2] if heap else []:
        items, todo = [], [x & mask]
        while todo:
            node = todo.pop()
            if (pair := nodes[node]) is None:
                items.append(node)
            else:
                todo += pair
        out.append(sorted(items))
    return out


def fill(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most `capacity` that hold all items, as few as near-equal sums allow."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, windows)
        over = max((sum(sizes[i] for i in w) for w in found), default=0) - capacity
        if over <= 0:
            return found
        windows += max(1, over * windows // (16 * capacity))


def pack(pieces: DataFrame, length: str = "length", window: int = WINDOW, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """Add sequence_id and offset to every piece; offsets in a sequence have no gaps.

    Pieces longer than the window are an error. All columns are kept; those named
    sequence_id or offset are replaced. The pieces are written once, so that their
    groups, drawn from row numbers, stay the same when a task is repeated; equal
    rows spread like any others. An empty table stays empty.
    """
    kept = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    number, group = fresh(kept, "_row", "_group")
    rows = materialize(pieces.select(*kept, F.monotonically_increasing_id().alias(number)), "pieces")
    loose = rows.where(F.col(length) < window)
    part, longest = rows.agg(F.sum(F.when(F.col(length) < window, F.col(length))), F.max(length)).first()
    if (longest or 0) > window:
        raise ValueError(f"a piece of {longest} ids exceeds the window of {window}")
    groups = max(1, -(-(part or 0) // (window * group_windows)))
    loose = loose.withColumn(group, F.pmod(F.xxhash64(number), F.lit(groups)))
    schema = rows.select(*kept).schema.add("sequence_id", "long").add("offset", "long")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(number, ignore_index=True)
        sizes = frame[length].to_numpy()
        sequence, offset = np.zeros(len(frame), dtype=np.int64), np.zeros(len(frame), dtype=np.int64)
        for k, items in enumerate(fill(sizes.tolist(), window)):
            sequence[items] = k
            offset[items] = np.cumsum(sizes[items]) - sizes[items]
        frame["sequence_id"] = 2 * ((int(frame[group].iloc[0]) << 32) + sequence)
        frame["offset"] = offset
        return frame[schema.names]

    # A whole window needs no group: its number, odd where those of groups are even, is its row's.
    whole = rows.where(F.col(length) == window).select(*kept, (2 * F.col(number) + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return whole.unionByName(loose.groupBy(group).applyInPandas(run, schema))
