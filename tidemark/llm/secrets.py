"""Secret scan: fixed patterns, and an assignment-aware lexer with constant propagation.

The patterns give the base spans. The lexer reads source and configuration syntax
(NAME = "literal", name: value, "name": "value", name => value, NAME := value,
map["name"] = "value", name: Type = "value", attributes and elements of XML, and entries
that give a name and its value apart) into pairs of a name and a value. What a value is
made of is followed: strings, names that are assigned elsewhere (the last assignment before
counts, else the first one after), names inside a string ("${name}"), and anchors of
YAML. Each literal takes the most sensitive name that it reaches, and is scored by that
and by how random it looks. The lexer adds spans of kind `literal`.

A null text counts as empty; an empty one has no spans. Spans are code points, the
end exclusive. The whole text is scanned, in time linear in its length: every place where
a value can begin is read once, whatever the number of pairs that lead there.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import append_columns

KINDS = ("assign", "access", "hex", "literal")
# A match that fails its length would begin no later or longer match, so the least
# length of access and hex is part of the pattern.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_MIN = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

#: Weight of a word, or of two words in a row, in the name that a literal is assigned to.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.8, "credentials": 0.8, "accesskey": 0.9, "privatekey": 1.0, "secretkey": 1.0, "signingkey": 0.9, "encryptionkey": 0.9, "authkey": 0.9}
#: Words that say the name holds something about a secret and not the secret.
BENIGN = {"count", "counts", "length", "len", "size", "limit", "max", "min", "type", "name", "field", "label", "hint", "policy", "expiry", "expires", "ttl", "url", "uri", "path", "file", "id", "ids", "index", "regex", "pattern", "format", "prompt", "placeholder", "enabled", "required", "version"}
PLACEHOLDERS = re.compile(r"change.?me|example|placeholder|your|dummy|sample|redacted|xxxx|\*\*\*|<[^<>]*>", re.IGNORECASE)
NOTHING = frozenset(("none", "null", "true", "false", "undefined"))
#: Least product of the name's weight and the literal's randomness.
THRESHOLD = 0.5
MIN_LITERAL = 8

_ASSIGN_STEMS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_STEMS = ("pass", "pwd", "secret", "token", "credential", "key")
_STEM = re.compile(r"pass[\W\d_]*(?:word|wd|phrase)|pwd|secret|token|credential|(?:api|access|private|signing|encryption|auth)[\W\d_]*key", re.ASCII)
_PAIR = re.compile(r"""(?<![\w.$-])([A-Za-z_$][\w.$-]*)(?:["'][ \t]*\]|["'?!])?[ \t]*(?::=|=>|=(?!=)|:(?!:))[ \t]*""", re.ASCII)
#: A declared type and the operator after it, at the place of a value; its brackets and unions are bounded, so that time stays linear.
_ONE_TYPE = r"(?:&[ \t]*(?:'[a-z]\w*[ \t]+)?)?[A-Za-z_][\w.]*+(?:[\[<][\w.,|&?*: \t\[\]<>]{1,200}[\]>])?+[?!]?(?:\[\])*+"
_TYPE = re.compile(rf"{_ONE_TYPE}(?:[ \t]*\|[ \t]*{_ONE_TYPE}){{0,9}}+[ \t]*:?=(?![=>])[ \t]*", re.ASCII)
_TYPES = frozenset("any char charsequence final none null object optional str string text undefined".split())
_STRING = re.compile(r'''"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`''')
_PREFIX = re.compile(r"""[fFrRbBuU]{1,2}(?=["'])|&([A-Za-z_][\w-]*)[ \t]+""", re.ASCII)
_NAME = re.compile(r"""\$\{([A-Za-z_][\w.]*)\}|\*([A-Za-z_][\w-]*)(?![\w-])|\$?([A-Za-z_][\w.]*+)(?![/=-])(?!\+(?![ \t]*["'`$A-Za-z_]))""", re.ASCII)
_INSIDE = re.compile(r"\$\{([A-Za-z_][\w.]*)\}|#\{([A-Za-z_][\w.]*)\}|%\(([A-Za-z_]\w*)\)s|\$?\{([A-Za-z_]\w*)\}|\$([A-Za-z_]\w*)", re.ASCII)
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]+""")
_PLUS = re.compile(r"[ \t]*[+.][ \t]*(?=[\"'`$A-Za-z_])")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)(?:\s[^<>]*)?>([^<>]+)</\1\s*>", re.ASCII)
#: Names of pairs that hold another's name, and of those that hold its value.
_NAMING, _VALUED = frozenset("name key id variable setting env".split()), frozenset("value val default content".split())
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", re.ASCII)

Span = tuple[str, int, int, str, float]


def name_weight(name: str) -> float:
    """How sensitive a target name is, from the words that it is made of."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if BENIGN & set(words):
        return 0.0
    pairs = [a + b for a, b in zip(words, words[1:]) if a == "pass" or b == "key"]
    return max([SENSITIVE.get(w, 0.0) for w in words + pairs], default=0.0)


def _random(counts: Counter, n: int) -> float:
    bits = -sum(c / n * math.log2(c / n) for c in counts.values() if c)
    mixed = any(k.isdigit() or not k.isalnum() for k, c in counts.items() if c)
    return min(1.0, bits / 3.5) * (1.0 if mixed else 0.5)


def randomness(literal: str) -> float:
    """0 to 1: bits of entropy per character against 3.5, with words alone counting half."""
    if len(literal) < MIN_LITERAL or " " in literal or literal.lower() in NOTHING or PLACEHOLDERS.search(literal):
        return 0.0
    return _random(Counter(literal), len(literal))


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    lower = text.lower()
    if any(stem in lower for stem in _ASSIGN_STEMS):  # a plain search is much faster than the pattern
        found += [("assign", m.start(), m.end(), m[1].lower(), 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), "", 1.0) for m in ACCESS.finditer(text)]
    return found + [("hex", m.start(), m.end(), "", 1.0) for m in HEX.finditer(text)]


class Lexer:
    """The pairs of a text, what their values are made of, and the literals that sensitive names reach."""

    def __init__(self, text: str) -> None:
        self.text = text
        #: Name, where the value begins, and where a type and what follows it begin (-1: no type).
        self.pairs: list[tuple[str, int, int, int]] = []
        self.places: dict[str, list[int]] = {}
        self.held: dict[str, list[int]] = {}
        self.targets: list[tuple[float, int, str, int]] = []
        self.elements: list[tuple[float, int, str, tuple[int, int]]] = []
        self.nodes: dict[int, tuple[str, tuple[int, int] | str, int]] = {}
        self.unclosed: dict[str, int] = {}
        self.run = (0, 0)
        self.counted: tuple[int, int, Counter, int] = (0, 0, Counter(), -1)
        self._read()

    def _read(self) -> None:
        for m in _PAIR.finditer(self.text):
            at, typed = m.end(), -1
            if self.text[m.end(1) : at].rstrip().endswith(":") and (found := _TYPE.match(self.text, at)):
                typed = found.end()
            if (prefix := _PREFIX.match(self.text, at)) and prefix[1]:
                self._define("*" + prefix[1], at)
            self.pairs.append((m[1], at, typed, m.start(1)))
            i = len(self.pairs) - 1
            if weight := name_weight(m[1]):
                self.targets.append((weight, m.start(1), m[1], i))
            if m[1].lower() not in _TYPES:  # a type is no constant
                self._define(m[1], i)
        for i, (name, at, _, begin) in enumerate(self.pairs):
            if name.rpartition(".")[2].lower() in _NAMING:
                value = next((j for j in (i + 1, i + 2) if j < len(self.pairs) and self.pairs[j][0].rpartition(".")[2].lower() in _VALUED), None)
                if value is not None and (called := self._plain(at)):
                    if weight := name_weight(called):
                        self.targets.append((weight, begin, called, value))
                    self._define(called, value)
        for m in _ELEMENT.finditer(self.text):
            if weight := name_weight(m[1]):
                a, b = m.span(2)
                a, b = a + len(m[2]) - len(m[2].lstrip()), b - len(m[2]) + len(m[2].rstrip())
                self.elements.append((weight, m.start(), m[1], (a, b)))

    def _define(self, name: str, pair: int) -> None:
        """Anchors are held by where their value begins, names by their pair."""
        place = pair if name[0] == "*" else self.pairs[pair][1]
        before = self.places.setdefault(name, [])
        if not before or place > before[-1]:
            before.append(place)
            self.held.setdefault(name, []).append(pair)
        else:
            at = bisect_left(before, place)
            if before[at] != place:
                before.insert(at, place)
                self.held[name].insert(at, pair)

    def _plain(self, at: int) -> str:
        kind, what, _ = self.node(at)
        span = what if kind == "string" else self._bare(at)
        return self.text[slice(*span)] if span and span[1] - span[0] <= 200 else ""

    def _bare(self, at: int) -> tuple[int, int] | None:
        """The bare word from `at` on, behind an anchor; words that share their end are measured once."""
        if prefix := _PREFIX.match(self.text, at):
            at = prefix.end()
        if not self.run[0] <= at < self.run[1]:
            if not (m := _BARE.match(self.text, at)):
                return None
            self.run = m.span()
        return at, self.run[1]

    def node(self, at: int) -> tuple[str, tuple[int, int] | str, int]:
        """What stands where a value begins or goes on: its kind, its span or name, and where it goes on (-1: nowhere)."""
        if (known := self.nodes.get(at)) is not None:
            return known
        text, begin = self.text, at
        if prefix := _PREFIX.match(text, at):
            at = prefix.end()
        mark = text[at : at + 1]
        m = None
        kind, what = "", ""
        if mark and mark in "\"'`" and at >= self.unclosed.get(mark, -1):
            if m := _STRING.match(text, at):
                kind, what = "string", m.span(m.lastindex)
            else:  # no such mark closes a string on the rest of this line
                end = text.find("\n", at)
                self.unclosed[mark] = end if end >= 0 else len(text)
        elif m := _NAME.match(text, at):
            kind, what = "name", m[1] or (m[2] and "*" + m[2]) or m[3]
        follows = _PLUS.match(text, m.end()) if m else None
        found = self.nodes[begin] = kind, what, follows.end() if follows else -1
        return found

    def _resolved(self, name: str, at: int) -> int | None:
        """The pair (of an anchor: the place) that a name used at `at` stands for."""
        if not (places := self.places.get(name)):
            return None
        i = bisect_left(places, at)
        if i:
            return self.held[name][i - 1]
        later = bisect_right(places, at)
        return self.held[name][later] if later < len(places) else None

    def _score(self, a: int, b: int, bare: bool) -> float:
        """randomness() of a span; of bare words with the same end, the characters are counted once."""
        if not bare:
            return randomness(self.text[a:b])
        start, end, counts, placeholder = self.counted
        if b == end and start <= a:
            counts.subtract(self.text[start:a])
        else:
            counts = Counter(self.text[a:b])
            placeholder = max((m.start() + a for m in PLACEHOLDERS.finditer(self.text[a:b])), default=-1)
        self.counted = a, b, counts, placeholder
        if b - a < MIN_LITERAL or placeholder >= a or b - a <= 9 and self.text[a:b].lower() in NOTHING:
            return 0.0
        return _random(counts, b - a)

    def literals(self, threshold: float) -> list[Span]:
        """The literals that reach the threshold by the most sensitive name that leads to them, the first of equal ones."""
        best: dict[tuple[int, int], tuple[float, str]] = {}
        seen: set[tuple[int, int]] = set()
        pairs, nodes = set(), set()

        def judge(span: tuple[int, int], bare: bool) -> None:
            if span not in seen:
                seen.add(span)
                if (score := weight * self._score(*span, bare)) >= threshold:
                    best[span] = score, name

        todo: list[tuple[int, int]] = []  # where a value goes on, and where it begins

        def follow(target: str, head: int) -> bool:
            found = self._resolved(target, head)
            if found is None:
                return False
            if target[0] == "*":
                todo.append((found, found))
            elif found not in pairs:
                pairs.add(found)
                todo.extend(self._heads(found))
            return True

        for weight, _, name, target in sorted([*self.targets, *self.elements], key=lambda t: (-t[0], t[1])):
            if isinstance(target, tuple):
                judge(target, False)
                continue
            if target not in pairs:
                pairs.add(target)
                todo.extend(self._heads(target))
            while todo:
                at, head = todo.pop()
                if at in nodes:
                    continue
                nodes.add(at)
                kind, what, goes_on = self.node(at)
                if kind == "string":
                    inside = list(_INSIDE.finditer(self.text, *what))
                    for m in inside:
                        follow(next(g for g in m.groups() if g), head)
                    # A string of nothing but names is none itself.
                    if not inside or what[1] - what[0] - sum(m.end() - m.start() for m in inside) >= MIN_LITERAL:
                        judge(what, False)
                elif kind == "name" and follow(what, head):
                    pass
                elif kind == "name" and goes_on >= 0 and goes_on >= self._bare(at)[1]:
                    pass  # a name that nothing is known of, and more behind it
                else:
                    if at == head and self.text[at : at + 1] != "$" and (span := self._bare(at)):
                        judge(span, True)
                    continue
                if goes_on >= 0:
                    todo.append((goes_on, head))
        return [("literal", a, b, name, score) for (a, b), (score, name) in best.items()]

    def _heads(self, pair: int) -> list[tuple[int, int]]:
        """Where the value of a pair begins; behind a type that is declared, and in what looks like one, if there are digits in it."""
        _, at, typed, _ = self.pairs[pair]
        if typed < 0:
            return [(at, at)]
        kind, what, _ = self.node(typed)
        if kind == "string" or kind == "name" and self._resolved(what, at) is not None:
            return [(typed, typed)] + ([(at, at)] if any(map(str.isdigit, self.text[at:typed])) else [])
        return [(at, at)]


def literal_spans(text: str, threshold: float = THRESHOLD) -> list[Span]:
    """Literals that reach a sensitive name, directly or through other names."""
    lower = text.lower()
    if not (any(stem in lower for stem in _STEMS) and _STEM.search(lower)):  # no name can be sensitive
        return []
    return Lexer(text).literals(threshold)


def find_spans(text: str | None, threshold: float = THRESHOLD) -> list[Span]:
    """All spans by start, then kind in the order of KINDS, then end."""
    text = text or ""
    return sorted(base_spans(text) + literal_spans(text, threshold), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redacted(text: str, spans: list[Span], mark: str) -> str:
    """The text with each run of overlapping spans replaced by mark."""
    out, end = [], 0
    for _, a, b, *_ in spans:
        if a >= end:
            out += [text[end:a], mark]
        end = max(end, b)
    return "".join([*out, text[end:]])


SPANS = "secrets array<struct<kind:string,start:int,end:int,name:string,score:double>>"


def scan(df: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add `secrets`: the spans of every text with kind, name and score.

    Keeps every row, repeated ones too, and every column but one of that name.
    """

    def run(texts: list[str | None]) -> dict[str, list]:
        return {"secrets": [[dict(zip(("kind", "start", "end", "name", "score"), s)) for s in find_spans(t, threshold)] for t in texts]}

    return append_columns(df, [text], run, SPANS)


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]", threshold: float = THRESHOLD) -> DataFrame:
    """Replace the secrets of every text by mark; null texts stay null."""

    def run(texts: list[str | None]) -> dict[str, list]:
        return {text: [t and redacted(t, find_spans(t, threshold), mark) for t in texts]}

    return append_columns(df, [text], run, f"`{text}` string").select(*df.columns)


def span_string(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
