"""SentencePiece encoding and decoding of a BPE model by a streaming Viterbi search.

A piece sequence is the model's encoding of a text exactly if every two neighbours
encode, on their own, to themselves: merging never crosses the boundary between them.
So the search runs over positions. Each keeps one survivor, the last piece of the
encoding of the text up to there with a pointer back to where that piece begins: the
one piece that fits the survivor at its beginning. A new character looks back over
the longest piece only. Whenever the paths of all positions that can still be looked
back at meet in one boundary, the ids before it are given out and forgotten, so the
state does not grow with the text.

(The model's scores order its merges; they are not likelihoods, so the greatest sum
of scores would be another segmentation than the model's own.)
"""

from __future__ import annotations

import gc
import re
import struct
from codecs import getincrementaldecoder
from functools import cached_property
from itertools import chain
from operator import add

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm._common import Kept, append_columns

SPACE = "▁"
#: Pairs of pieces that a worker keeps at most, and bytes of words with their ids; parts of long words may take a quarter of these.
CACHE = 300_000
CACHE_BYTES = 64 << 20
#: Characters after which paths are traced back.
_TRACE = 64
_UNITS = re.compile(" *[^ ]+| +")


class Vocabulary:
    """Pieces, scores and ids of a model file."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        if model.encode("a  a", out_type=str)[:1] == ["a"]:
            raise ValueError("a model that puts a space before the text is needed")
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes: list[int] = [model.unk_id()] * 256
        self.texts: list[bytes] = []
        for i in range(len(model)):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.texts.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i):
                self.texts.append(b"")
            elif model.is_unknown(i):
                self.texts.append(" ⁇ ".encode())
            else:
                self.texts.append(piece.replace(SPACE, " ").encode())
                if not model.is_unused(i):
                    self.ids[piece] = i
                    self.scores[piece] = model.get_score(i)
        self.longest = max(map(len, self.ids), default=1)
        #: No piece goes on past a word: spaces stand before all else in it.
        self.by_word = all(SPACE not in p.lstrip(SPACE) for p in self.ids)
        #: What fits() has found, by the piece before.
        self.rows: dict[str, dict[str, bool]] = {}
        self.known = 0

    @cached_property
    def inner(self) -> set[str]:
        """Neighbouring characters inside pieces: every path has a boundary between any others."""
        return {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}

    @cached_property
    def root(self) -> list:
        """Beginnings of pieces, from that of no character on.

        Each has those that are a character longer, the longest beginning that it ends with,
        the pieces of several characters that it ends with, the longest first, each with
        its length and row, and its last character with its row.
        """
        root: list = [{}, None, (), None]
        single = {c: (c, self.row(c)) for c in set(chain.from_iterable(self.ids))}
        for piece in self.ids:
            node = root
            for c in piece:
                if (below := node[0].get(c)) is None:
                    below = node[0][c] = [{}, root, (), single[c]]
                node = below
            if len(piece) > 1:
                node[2] = ((len(piece), piece, self.row(piece)),)
        level = list(root[0].values())
        while level:
            for node in level:
                for c, below in node[0].items():
                    end = node[1]
                    while c not in end[0] and end is not root:
                        end = end[1]
                    below[1] = end[0].get(c, root)
                    below[2] = below[2] + below[1][2] if below[2] else below[1][2]
            level = [below for node in level for below in node[0].values()]
        return root

    def merge(self, text: str) -> list[str]:
        """The model's pieces of a short text: the best-scored neighbours merge first, the left ones on ties."""
        parts, score, none = list(text), self.scores.get, float("-inf")
        scores = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > none:
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = score(parts[at - 1] + parts[at], none)
            if at < len(scores):
                scores[at] = score(parts[at] + parts[at + 1], none)
        return parts

    def row(self, before: str) -> dict[str, bool]:
        """What is known of the boundaries behind a piece."""
        if (found := self.rows.get(before)) is None:
            found = self.rows[before] = {}
        return found

    def fits(self, before: str, piece: str) -> bool:
        """Whether the model would leave this boundary alone; before may be empty."""
        if self.known >= CACHE:
            for row in self.rows.values():  # survivors hold rows, which stay in use
                row.clear()
            self.known = 0
        self.known += 1
        found = self.row(before)[piece] = self.merge(before + piece) == ([before, piece] if before else [piece])
        return found

    def survivors(self, text: str, last: list[str], rows: list[dict[str, bool]], node: list) -> list:
        """Extend `last`, the survivors at the first positions of text, to all positions; rows are theirs.

        `node` is the longest beginning of a piece at the last of these; returned is that at the end.
        """
        root, fits = self.root, self.fits
        add_last, add_row = last.append, rows.append
        for end, c in enumerate(text[len(last) - 1 :], len(last)):
            while (below := node[0].get(c)) is None and node is not root:
                node = node[1]
            node = below or root
            for length, piece, row in node[2]:
                fit = rows[end - length].get(piece)
                if fits(last[end - length], piece) if fit is None else fit:
                    break
            else:  # one piece fits, so this does; a character that is no piece stands for its bytes
                piece, row = node[3] or (c, self.row(c))
            add_last(piece)
            add_row(row)
        return node

    def ids_of(self, pieces: list[str]) -> list[int]:
        """Ids; a character that is no piece gives those of its bytes."""
        try:
            return [self.ids[p] for p in pieces]
        except KeyError:
            return list(chain.from_iterable([self.ids[p]] if p in self.ids else [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")] for p in pieces))


class StreamingEncoder:
    """Ids of a text that comes in parts, spaces being SPACE already."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        #: Text since the last boundary given out, and the survivor at each position from there on.
        self.text = ""
        self.last = [""]
        self.rows = [vocabulary.row("")]
        self.node = vocabulary.root

    def feed(self, text: str) -> list[int]:
        """Take more text; returns the ids that no further text can change."""
        out: list[int] = []
        for at in range(0, len(text), _TRACE):
            self.text += text[at : at + _TRACE]
            self.node = self.vocabulary.survivors(self.text, self.last, self.rows, self.node)
            if len(self.text) > self.vocabulary.longest:
                recent = range(max(0, len(self.text) - self.vocabulary.longest + 1), len(self.text) + 1)
                out += self._give(self._meet(set(recent)))
        return out

    def finish(self) -> list[int]:
        return self._give(len(self.text))

    def _meet(self, positions: set[int]) -> int:
        """The latest boundary that the paths from all these positions share."""
        while len(positions) > 1:
            far = max(positions)
            positions.remove(far)
            positions.add(far - len(self.last[far]) if far else 0)
        return positions.pop()

    def _give(self, end: int) -> list[int]:
        pieces = trace(self.last, end)
        if end:
            self.text, self.last, self.rows = self.text[end:], self.last[end:], self.rows[end:]
        return self.vocabulary.ids_of(pieces)


def trace(last: list[str], end: int) -> list[str]:
    """The pieces on the path that survives at a position."""
    pieces = []
    while end:
        pieces.append(last[end])
        end -= len(last[end])
    return pieces[::-1]


class Codec:
    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.runs = Kept(self._run, CACHE_BYTES // 4)
        self.words = Kept(self._word, CACHE_BYTES)

    def _run(self, text: str) -> bytes:
        v = self.vocabulary
        if len(text) <= _TRACE:  # the whole of it is in the window
            last, rows = [""], [v.row("")]
            v.survivors(text, last, rows, v.root)
            ids = v.ids_of(trace(last, len(text)))
        else:
            stream = StreamingEncoder(v)
            ids = stream.feed(text) + stream.finish()
        return struct.pack(f"<{len(ids)}I", *ids)

    def _unit(self, text: str) -> bytes:
        """Ids of any text, cut first where all paths must meet."""
        text = text.replace(" ", SPACE)
        inner = self.vocabulary.inner
        out, begin = [], 0
        for i, pair in enumerate(map(add, text, text[1:]), 1):
            if pair not in inner:
                out.append(self.runs[text[begin:i]])
                begin = i
        out.append(self.runs[text[begin:]])
        return b"".join(out)

    def _word(self, word: str) -> bytes:
        if not word:
            raise ValueError("two spaces")
        return self._run(SPACE + word) if len(word) < _TRACE else self._unit(" " + word)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes; those of an empty text are none."""
        if not text:
            return b""
        text = text.replace(SPACE, " ")
        if not self.vocabulary.by_word:
            return self._unit(" " + text)
        try:
            return b"".join(map(self.words.__getitem__, text.split(" ")))
        except ValueError:
            return b"".join([self.words[u[1:]] if u[1:] and u[1] != " " else self._unit(u) for u in _UNITS.findall(" " + text)])

    def decode(self, ids: bytes) -> str:
        """The text of the ids; bytes that aren't UTF-8 become replacement characters."""
        texts = self.vocabulary.texts
        stream = getincrementaldecoder("utf-8")("replace")
        parts = []
        numbers = np.frombuffer(ids, dtype="<u4")
        for at in range(0, len(numbers), 1 << 16):
            parts.append(stream.decode(b"".join([texts[i] for i in numbers[at : at + (1 << 16)].tolist()])))
        text = "".join(parts) + stream.decode(b"", final=True)
        return text.removeprefix(" ")


_codecs: dict[str, Codec] = {}


def _codec(path: str) -> Codec:
    if path not in _codecs:
        gc.set_threshold(200_000)  # what is kept has no cycles, and is long to go through
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add the ids of every text as little-endian unsigned 32-bit bytes; null for a null text.

    With `decoded`, a column of that name has the text that decode() gives for the ids, without
    sending them to Python again. Keeps every row and column; those of these names are replaced.
    """

    def run(texts: list[str | None]) -> dict[str, list]:
        codec = _codec(path)
        found = {ids: [None if t is None else codec.encode(t) for t in texts]}
        return found | {decoded: [None if i is None else codec.decode(i) for i in found[ids]]} if decoded else found

    return append_columns(df, [text], run, f"`{ids}` binary" + (f", `{decoded}` string" if decoded else ""))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of the ids; null for null ids. Keeps every row and column."""
    return append_columns(df, [ids], lambda rows: {text: [None if r is None else _codec(path).decode(r) for r in rows]}, f"`{text}` string")
