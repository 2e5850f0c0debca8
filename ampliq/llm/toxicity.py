"""Toxicity of documents after noisy-channel deobfuscation."""

import functools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from ampliq.llm.common import with_columns

#: Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
#: Costs of the channel in nats: a sign for a letter, one of a doubled letter dropped, each letter of a longer run dropped.
SIGN_COST, DOUBLE_COST, REPEAT_COST = 1.0, 6.0, 0.3
#: Costs of leaving a sign, or a run of three and more, as it stands.
KEEP_SIGN_COST, KEEP_RUN_COST = 4.0, 6.0
#: Gaps: (cost of dropping one, cost of keeping it) between letters set apart one by one, and between parts of a token.
SPELLED_GAP, TOKEN_GAP = (0.5, 2.5), (2.0, 0.0)
#: Cost of a space that does not belong between two fragments; marks between parts of a token that are as good as a space.
SPACE_COST, SPACE_MARKS = 7.0, frozenset(",;:?()[]{}/\\\"")

#: Letters of the language model: a-z, Latin-1 letters, and one for all that separates words.
_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100)))
_N = len(_LETTERS) + 2
_END, _OTHER = 0, _N - 1
_CODE = {letter: i + 1 for i, letter in enumerate(_LETTERS)}
_CODES = np.zeros(0x250, dtype=np.int64)
for _letter, _code in _CODE.items():
    _CODES[ord(_letter)] = _code

_GAPPED = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+€])(?:[ .,/*_\-]+(?:[^\W_]|[@$!|+€])){2,}(?![^\s.,;:?!])")
_DOUBLE = re.compile(r"([^\W\d_])\1")
_GAPS = re.compile("(?:[^\\w" + re.escape("".join(c for c in LEET if not c.isalnum())) + "]|_)+")
#: A run of an equal letter, digit or sign (group 1), or a gap.
_RUN = re.compile("(?s)" + _GAPS.pattern + "|(.)\\1*")
_EDGES = ".,;:?\"'()[]{}<>«»„“”*#%&~=_-/\\"


def code_array(text: str) -> np.ndarray:
    """Letter codes of a text, lower-cased; runs of anything else count as one end of a word each character."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    return np.where(points < len(_CODES), _CODES[np.minimum(points, len(_CODES) - 1)], np.where(points < 0x2000, _OTHER, _END))


def _trigram_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros(_N**3, dtype=np.int64)
    for frame in frames:
        for text in frame["text"]:
            if text:
                for at in range(0, len(text), 1 << 20):  # pieces overlap by the two letters of context
                    codes = np.concatenate([[_END], code_array(text[max(0, at - 2) : at + (1 << 20)]), [_END]])
                    counts += np.bincount(codes[:-2] * _N * _N + codes[1:-1] * _N + codes[2:], minlength=_N**3)
    seen = np.nonzero(counts)[0]
    yield pd.DataFrame({"gram": seen, "n": counts[seen]})


@dataclass(frozen=True)
class LetterModel:
    """Costs (negative log probabilities) of a letter after two others, smoothed with shorter contexts."""

    costs: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> "LetterModel":
        three = counts.reshape(_N, _N, _N).astype(float)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + _N)
        p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
        p3 = (three + 20 * p2) / (three.sum(axis=2, keepdims=True) + 20)
        return cls(-np.log(p3))

    @functools.cached_property
    def table(self) -> list:
        return self.costs.ravel().tolist()


def letter_model(docs: DataFrame) -> LetterModel:
    """Trigram model of all texts; the table has one cell per triple of letters, however large the corpus."""
    grams = docs.select("text").mapInPandas(_trigram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(_N**3)
    for row in grams.collect():  # at most one row per triple of letters
        counts[row.gram] = row.n
    return LetterModel.of(counts)


def _option(letters: str, cost: float) -> tuple[str, tuple[int, ...], float]:
    return letters, tuple(_CODE.get(letter, _OTHER) for letter in letters), cost


def lattice(token: str, gap: tuple[float, float] = TOKEN_GAP) -> Iterator[list[tuple[str, tuple[int, ...], float]]]:
    """For each run of an equal character the texts it may stand for, their letter codes and the channel's costs.

    A run of signs that are neither letters, digits nor in ``LEET`` is a gap: dropped, or kept as the end of a word.
    """
    for found in _RUN.finditer(token):
        sign, n = found.group(1) or " ", found.end() - found.start()
        if not found.group(1):
            spaced = gap == TOKEN_GAP and not SPACE_MARKS.isdisjoint(found.group(0))
            yield [("", (), SPACE_COST if spaced else gap[0]), (found.group(0), (_END,), gap[1])]
            continue
        options = [_option(sign * n, (KEEP_SIGN_COST if sign in LEET else 0.0) * n + (KEEP_RUN_COST if n > 2 else 0.0))]
        for letter in LEET.get(sign, sign if sign.isalpha() else ""):
            for k in (1, 2):
                if k < n or (k == n and letter != sign):
                    dropped = DOUBLE_COST if n == 2 and k == 1 else REPEAT_COST * (n - k)
                    options.append(_option(letter * k, (0.0 if letter == sign else SIGN_COST) * n + dropped))
        yield options


def _spelt(path: tuple | None) -> str:
    parts = []
    while path:
        path, letters = path
        parts.append(letters)
    return "".join(reversed(parts))


def decoded(token: str, model: LetterModel, gap: tuple[float, float] = TOKEN_GAP) -> str:
    """The likeliest text behind a token of any length: Viterbi over its lattice, with the last two letters as the state.

    Paths share their beginnings, and what all have in common is put down once a single state is left, so time and
    memory grow with the token alone.
    """
    table = model.table
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(_END, _END): (0.0, None)}
    settled: list[str] = []
    for options in lattice(token, gap):
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, path) in states.items():
            for letters, codes, channel in options:
                x, y, total = a, b, cost + channel
                for z in codes:
                    total += table[(x * _N + y) * _N + z]
                    x, y = y, z
                if (x, y) not in after or total < after[x, y][0]:
                    after[x, y] = (total, (path, letters))
        states = after
        if len(states) == 1:
            (state, (_, path)), = states.items()
            settled.append(_spelt(path))
            states = {state: (0.0, None)}
    _, best = min(((cost + table[(a * _N + b) * _N + _END], path) for (a, b), (cost, path) in states.items()), key=lambda s: s[0])
    return "".join(settled) + _spelt(best)


def joined_fragments(text: str, model: LetterModel) -> str:
    """A lower-cased text without the spaces that the letters around them make unlikely.

    Each single space between two letters is decided by itself, within the text as it stands: the cost of the two
    letters before and after it with an end of a word between them against ``SPACE_COST`` and the cost without it.
    Beyond two letters on either side the trigrams are the same, so for fragments of two and more letters this is the best path.
    """
    if len(text) < 3:
        return text
    codes = np.concatenate([[_END], code_array(text), [_END]])
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    at = np.nonzero(points[1:-1] == 0x20)[0] + 2  # places in ``codes``
    at = at[(codes[at - 1] != _END) & (codes[at - 1] != _OTHER) & (codes[at + 1] != _END) & (codes[at + 1] != _OTHER)]
    a, b, x, y = codes[at - 2], codes[at - 1], codes[at + 1], codes[at + 2]
    costs = model.costs
    kept = costs[a, b, _END] + costs[b, _END, x] + costs[_END, x, y]
    wrong = at[kept > costs[a, b, x] + costs[b, x, y] + SPACE_COST] - 1
    if not len(wrong):
        return text
    ends = [0, *(wrong + 1).tolist(), len(text) + 1]
    return "".join(text[start : end - 1] for start, end in zip(ends, ends[1:]))


class Restorer:
    """Restores texts; short tokens that came before are looked up in a table of bounded size.

    Every token is decoded that has more than one path through its lattice.  A token without any letter is a number or
    a mark and stays as it is.
    """

    def __init__(self, model: LetterModel, remembered: int = 100_000, remembered_length: int = 64):
        self.model = model
        self.remembered_length = remembered_length
        self._decoded = functools.lru_cache(remembered)(functools.partial(decoded, model=model))

    def _decode(self, token: str, gap: tuple[float, float] = TOKEN_GAP) -> str:
        return self._decoded(token, gap=gap) if len(token) <= self.remembered_length else decoded(token, self.model, gap)

    def word(self, word: str) -> str:
        """A lower-cased word as it was meant."""
        core = word.strip(_EDGES)
        core = core.rstrip("!") or core  # at the end it is a mark, not a letter
        if core.isalpha():
            return self._decode(core) if _DOUBLE.search(core) else core
        return self._decode(core) if any(c.isalpha() for c in core) else core

    def _pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text in pieces: what was spelled out letter by letter, restored (true), and all else, fragments joined."""
        low, last = text.lower(), 0
        for found in _GAPPED.finditer(low):
            yield joined_fragments(low[last : found.start()], self.model), False
            yield self._decode(found.group(0), SPELLED_GAP), True
            last = found.end()
        yield joined_fragments(low[last:], self.model), False

    def text(self, text: str) -> str:
        return "".join(
            piece if done else re.sub(r"[^\x20\x09-\x0D]+", lambda m: self.word(m.group(0)), piece)
            for piece, done in self._pieces(text)
        )

    def words(self, text: str) -> set[str]:
        """Distinct words of the restored text."""
        raw, found = set(), set()
        for piece, done in self._pieces(text):
            (found if done else raw).update(piece.split())
        found.update(map(self.word, raw))
        return {part for word in found for part in ((word,) if word.isalnum() else _GAPS.split(word))}


def _buckets(words: set[str], n: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) % n for w in words), dtype=np.int64, count=len(words))


def _evidence(toxic: np.ndarray, seen: np.ndarray, base: float, caution: float) -> np.ndarray:
    """How much a word raises the log odds: the lower confidence bound of its toxic share against the base rate, or 0."""
    n = np.maximum(seen, 1e-9)
    share = np.clip(toxic / n, 0, 1)
    room = caution * np.sqrt(share * (1 - share) / n + caution**2 / (4 * n**2))
    least = np.clip((share + caution**2 / (2 * n) - room) / (1 + caution**2 / n), 1e-6, 1 - 1e-6)
    return np.where(seen >= 1, np.maximum(0, np.log(least / (1 - least)) - np.log(base / (1 - base))), 0.0)


@dataclass(frozen=True)
class ToxicityModel:
    letters: LetterModel
    weights: np.ndarray
    slope: float
    bias: float

    def score(self, words: set[str]) -> float:
        total = np.log1p(self.weights[_buckets(words, len(self.weights))].sum()) if words else 0.0
        return float(1 / (1 + np.exp(-np.clip(self.slope * total + self.bias, -30, 30))))


def _fit(rows: list[np.ndarray], answers: np.ndarray, buckets: int, caution: float) -> tuple[np.ndarray, float, float]:
    """Word weights, and a logistic curve from their sum in a document to the chance of the label.

    For the curve, each document is weighed with the counts of all others, so that rare words, which only say that
    a document is itself, carry nothing.
    """
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    base = answers.mean()
    seen = np.bincount(flat, minlength=buckets).astype(float)
    toxic = np.bincount(flat, weights=answers[owner], minlength=buckets)
    others = _evidence(toxic[flat] - answers[owner], seen[flat] - 1, base, caution)
    sums = np.log1p(np.bincount(owner, weights=others, minlength=len(rows)))
    design, found = np.stack([sums, np.ones(len(rows))], axis=1), np.zeros(2)
    penalty = np.diag([0.1, 1e-3])
    for _ in range(50):  # Newton steps
        chance = 1 / (1 + np.exp(-np.clip(design @ found, -30, 30)))
        slope = design.T @ (chance - answers) + penalty @ found
        bend = (design * (chance * (1 - chance))[:, None]).T @ design + penalty
        found = found - np.linalg.solve(bend, slope)
    return _evidence(toxic, seen, base, caution), float(max(found[0], 0.0)), float(found[1])


def train(
    docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, buckets: int = 1 << 20, caution: float = 3.0
) -> ToxicityModel:
    """Letter model of all documents; word weights from labelled ones outside the held-out fifth.

    At most ``max_rows`` labelled documents are used, half of each label where there are more, chosen by a hash of the id.
    Without both labels every document has the score that the known label implies (0 without any).
    """
    letters = letter_model(docs)
    told = labels.where("toxic in (0, 1) and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    told = told.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    numbers = {row.toxic: row["count"] for row in told.groupBy("toxic").count().collect()}
    sample = functools.reduce(DataFrame.unionByName, [
        told.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows // 2) for label in (0, 1)
    ])

    def prepared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(letters)
        for frame in frames:
            rows = [np.unique(_buckets(restorer.words(text or ""), buckets)).astype(np.int32).tobytes() for text in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "toxic": frame["toxic"], "words": rows})

    # At most max_rows ids are broadcast and as many rows of word numbers come back.
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = sorted(chosen.mapInPandas(prepared, "doc_id long, toxic int, words binary").collect(), key=lambda r: (r.doc_id, r.words))
    answers = np.array([r.toxic for r in rows], dtype=float)
    if not len(rows) or answers.min() == answers.max():
        return ToxicityModel(letters, np.zeros(buckets), 0.0, 30.0 if len(rows) and answers[0] else -30.0)
    weights, slope, bias = _fit([np.frombuffer(r.words, np.int32) for r in rows], answers, buckets, caution)
    # Where the sample holds the labels in other proportions than the table, the real odds come back in.
    sampled = answers.sum() / (1 - answers).sum()
    return ToxicityModel(letters, weights, slope, bias + float(np.log(numbers[1] / numbers[0] / sampled)))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Every row with ``score`` in 0 to 1 and ``predicted``; input columns are kept, those of the same names replaced.

    Texts are restored and scored whole, however long, each row on its own, so repeated rows get equal scores.  Null,
    empty and blank texts have the score of a document without words; an empty table gives an empty result.
    """
    @F.pandas_udf(DoubleType())
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        restorer = Restorer(model.letters)
        for batch in texts:
            yield pd.Series([model.score(restorer.words(text or "")) for text in batch], dtype=float)

    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["text"].alias("text"))
    rows = rows.withColumn("score", score("text"))
    return with_columns(rows, "row", {"score": F.col("score"), "predicted": (F.col("score") >= 0.5).cast("int")})


def restore(docs: DataFrame, model: LetterModel) -> DataFrame:
    """Every row with the ``restored`` text, lower-cased, punctuation at word ends removed; null stays null."""
    @F.pandas_udf(StringType())
    def restored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        restorer = Restorer(model)
        for batch in texts:
            yield pd.Series([None if text is None else restorer.text(text) for text in batch], dtype=object)

    return docs.withColumn("restored", restored("text"))
