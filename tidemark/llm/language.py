"""Language identification as a mixture of languages, fitted to each document by EM.

Each letter gives one n-gram: itself with its neighbours, in lower case, other
characters being one boundary mark; n-grams are hashed to BUCKETS counts for each
language. A word's likelihood under a language is the product of its n-grams'. EM
estimates the shares of all languages from the words; then languages are taken in
order of their share while the likelihood, penalised by half the logarithm of the
word count for each, still rises. The largest share names the document.

The model is fitted on a bounded sample of labelled rows (ROWS_PER_LANGUAGE). A null
text, or one without letters, is `und` with score 0, as is every text where no
labelled row exists. Whole texts are read, in slices of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import append_columns, map_rows

BUCKETS = 1 << 15
#: The documented bound of the training sample: about so many rows of each language, chosen by hash.
ROWS_PER_LANGUAGE = 2000
#: Characters handled at once; a longer text is read in slices of this length.
SLICE = 1 << 19
ROUNDS = 25
SET_ROUNDS = 8
#: A document's shares have settled when none moves by more in a round.
SETTLED = 1e-3
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _is_letter(codes: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool))
    return _letters[0][codes]


def _ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each letter's n-gram, and for each word the index of its first letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _is_letter(codes)
    padded = np.zeros(len(codes) + 2, dtype=np.uint32)
    padded[1:-1] = np.where(letter, codes, 1)
    mixed = padded[:-2] * np.uint32(0x9E3779B1) + padded[1:-1] * np.uint32(0x85EBCA77) + padded[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    bucket = (mixed * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    begins = letter & ~np.concatenate([[False], letter[:-1]])
    at = np.flatnonzero(letter)
    return bucket[at], np.searchsorted(at, np.flatnonzero(begins))


@dataclass
class Model:
    languages: list[str]
    #: log P(bucket | language), one row for each bucket.
    logp: np.ndarray = field(repr=False)

    def words(self, text: str) -> np.ndarray:
        """Log-likelihood of each word under each language."""
        parts = []
        for at in range(0, len(text), SLICE):
            buckets, starts = _ngrams(text[at : at + SLICE])
            if len(starts):
                parts.append(np.add.reduceat(self.logp[buckets], starts, axis=0))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)))

    def predict(self, texts: list[str | None]) -> list[list[tuple[str, float]]]:
        """The languages chosen for each text with their shares, the largest first."""
        if not self.languages:
            return [[] for _ in texts]
        out: list[list[tuple[str, float]]] = [[] for _ in texts]
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        for i, text in enumerate(texts):
            if len(words := self.words(text or "")):
                held.append((i, words))
                size += len(words)
            if held and (size > SLICE // 4 or i == len(texts) - 1):
                for (j, _), found in zip(held, self._mixtures([w for _, w in held]), strict=True):
                    out[j] = found
                held, size = [], 0
        if held:
            for (j, _), found in zip(held, self._mixtures([w for _, w in held]), strict=True):
                out[j] = found
        return out

    def _mixtures(self, docs: list[np.ndarray]) -> list[list[tuple[str, float]]]:
        n = np.array([len(d) for d in docs])
        rows = np.concatenate(docs)
        top = rows.max(axis=1)
        likely = np.exp(np.maximum(rows - top[:, None], -60.0))  # one word rules out no language
        base = np.add.reduceat(top, np.concatenate([[0], np.cumsum(n)[:-1]]))
        every = np.arange(len(docs))
        share, _ = _em(likely, n, np.full((len(docs), len(self.languages)), 1.0 / len(self.languages)), ROUNDS)
        order = np.argsort(-share, axis=1, kind="stable")
        chosen = np.zeros_like(share)
        best = np.full(len(docs), -np.inf)
        open_ = every
        for k in range(1, len(self.languages) + 1):
            mask = np.zeros((len(open_), len(self.languages)))
            np.put_along_axis(mask, order[open_, :k], 1.0, axis=1)
            begin = (share[open_] + 1e-6) * mask
            take = np.repeat(np.isin(every, open_), n)
            part, loglik = _em(likely[take], n[open_], begin / begin.sum(axis=1, keepdims=True), SET_ROUNDS if k > 1 else 0)
            value = base[open_] + loglik - (k - 1) / 2 * np.log(n[open_] + 1.0)
            better = value > best[open_] + 1e-9
            best[open_[better]] = value[better]
            chosen[open_[better]] = part[better]
            open_ = open_[better]
            if not len(open_):
                break
        return [[(self.languages[j], float(row[j])) for j in np.argsort(-row, kind="stable") if row[j] > 0] for row in chosen]


def _em(likely: np.ndarray, n: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares after EM from `share`, and the log-likelihood (above the words' largest) that they give.

    Documents whose shares have settled leave the rounds.
    """
    share = share.copy()
    going, rows, counts = np.arange(len(n)), likely, n
    for _ in range(rounds):
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        before = share[going]
        joint = rows * np.repeat(before, counts, axis=0)
        joint *= (1.0 / joint.sum(axis=1))[:, None]
        share[going] = np.add.reduceat(joint, starts, axis=0) / counts[:, None]
        moves = np.abs(share[going] - before).max(axis=1) >= SETTLED
        if not moves.any():
            break
        if moves.sum() < 0.7 * len(moves):
            rows, going, counts = rows[np.repeat(moves, counts)], going[moves], counts[moves]
    total = np.einsum("ij,ij->i", likely, np.repeat(share, n, axis=0))
    return share, np.add.reduceat(np.log(total), np.concatenate([[0], np.cumsum(n)[:-1]]))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = ROWS_PER_LANGUAGE, smoothing: float = 0.1) -> Model:
    """Fit on about `rows` rows of each language, chosen by a hash of the key.

    Rows with a null text or language teach nothing. What the driver receives is one
    count for each language and bucket that occurs.
    """
    labelled = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = labelled.groupBy(lang).agg(F.count(F.lit(1)).alias("_n"))
    total = {r[lang]: r["_n"] for r in counts.collect()}
    if not total:
        return Model([], np.zeros((BUCKETS, 0)))
    draw = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 20))
    limit = F.lit(0)
    for name, n in total.items():
        limit = F.when(F.col(lang) == name, F.lit(int((1 << 20) * min(1.0, rows / n)) + 1)).otherwise(limit)
    sample = labelled.where(draw < limit).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(columns: dict[str, list]) -> dict[str, list]:
        seen: dict[str, np.ndarray] = {}
        for name, text in zip(columns["lang"], columns["text"], strict=True):
            for at in range(0, len(text), SLICE):
                buckets, _ = _ngrams(text[at : at + SLICE])
                seen[name] = seen.get(name, 0) + np.bincount(buckets, minlength=BUCKETS)
        out: dict[str, list] = {"lang": [], "bucket": [], "n": []}
        for name, row in seen.items():
            at = np.flatnonzero(row)
            out["lang"] += [name] * len(at)
            out["bucket"] += at.tolist()
            out["n"] += row[at].tolist()
        return out

    found = map_rows(sample, ["lang", "text"], count, "lang string, bucket int, n long", rows=4096)
    table = found.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(total)
    where = {name: i for i, name in enumerate(languages)}
    weights = np.full((BUCKETS, len(languages)), smoothing)
    column = np.array([where[x] for x in table.column("lang").to_pylist()], dtype=np.int64)
    np.add.at(weights, (table.column("bucket").to_numpy(), column), table.column("n").to_numpy())
    return Model(languages, np.log(weights / weights.sum(axis=0)))


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add `languages` (language and share, the largest first), `lang_pred` and `score`, its share.

    Keeps every row, repeated ones too, and every column but those of these names. Of languages
    with equal shares the first by name counts as larger.
    """

    def run(texts: list[str | None]) -> dict[str, list]:
        found = model.predict(texts)
        return {
            "languages": [[{"lang": a, "share": b} for a, b in f] for f in found],
            "lang_pred": [f[0][0] if f else UNKNOWN for f in found],
            "score": [min(1.0, f[0][1]) if f else 0.0 for f in found],
        }

    return append_columns(df, [text], run, "languages array<struct<lang:string,share:double>>, lang_pred string, score double")


def is_held_out(key: Column) -> Column:
    """A quarter of the rows, by crc32 of the key as text, that no model learns from."""
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2
