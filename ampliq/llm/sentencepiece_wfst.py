"""SentencePiece encoding and decoding as shortest paths in a composed weighted finite-state transducer."""

import functools
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Fixed values of the public model format: the mark for a space, and the kinds of pieces.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_INF = float("inf")


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Numbered fields of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            yield number, varint()
        elif kind == 1:
            at += 8
            yield number, data[at - 8 : at]
        elif kind == 5:
            at += 4
            yield number, data[at - 4 : at]
        else:
            size = varint()
            at += size
            yield number, data[at - size : at]


@dataclass(frozen=True)
class PieceModel:
    """What the model file holds: pieces with ranks, byte pieces, and the normaliser's switches."""

    pieces: list[str]
    kinds: list[int]
    scores: list[float]
    dummy_prefix: bool
    squeeze_spaces: bool

    @classmethod
    def read(cls, path: str) -> "PieceModel":
        with open(path, "rb") as file:
            data = file.read()
        pieces, kinds, scores, normaliser = [], [], [], {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
                if trainer.get(3, 1) != 2:
                    raise ValueError("the transducer is compiled for models whose pieces come from merges")
            elif number == 3:
                normaliser = dict(_fields(value))
        if normaliser.get(2):
            raise ValueError("models with a character map in the normaliser are not supported")
        return cls(pieces, kinds, scores, bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)))


@dataclass
class Transducer:
    """Normaliser o pieces with byte fallback o neighbours, composed lazily with each input.

    The normaliser maps a space to the mark and puts one before the text.  The piece machine reads letters and
    writes a piece at weight 1; a letter that no piece covers is written as its bytes.  The neighbour machine has
    the last piece as its state: it lets a piece follow at weight 0 if merging their joint letters by rank gives back
    just these two pieces, and otherwise not at all.  The path of least weight is then the model's own encoding,
    since merges act on neighbours only.
    """

    model: PieceModel
    remembered: int = 400_000
    ids: dict = field(init=False)
    ranks: dict = field(init=False)
    trie: dict = field(init=False)
    byte_ids: list = field(init=False)
    bytes_of: list = field(init=False)
    splits: bool = field(init=False)
    longest: int = field(init=False)

    def __post_init__(self) -> None:
        model = self.model
        usable = [(p, i) for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k in (NORMAL, USER, UNUSED)]
        self.ids = dict(usable)
        self.ranks = {p: -model.scores[i] for p, i in usable}
        self.trie = {}
        for piece, _ in usable:
            node = self.trie
            for letter in piece:
                node = node.setdefault(letter, {})
            node[""] = piece
        self.longest = max(map(len, self.ids), default=1)
        self.byte_ids = [i for i, k in enumerate(model.kinds) if k == BYTE]
        self.bytes_of = [
            bytes([i - self.byte_ids[0]]) if kind == BYTE else b"" if kind == CONTROL else piece.encode()
            for i, (piece, kind) in enumerate(zip(model.pieces, model.kinds))
        ]
        # Where no piece has a mark after another letter, words can be encoded one by one.
        self.splits = not any(MARK in p.lstrip(MARK) for p, _ in usable)
        self.follows = functools.lru_cache(self.remembered // 2)(self._follows)
        self.word = functools.lru_cache(self.remembered)(self._shortest)

    def forget(self) -> None:
        """Drop what was remembered, so that an idle worker holds the machine only."""
        self.word.cache_clear()
        self.follows.cache_clear()

    def normalised(self, text: str) -> str:
        if self.model.squeeze_spaces:
            text = " ".join(part for part in text.split(" ") if part)
        if not text:
            return ""
        return (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)

    def _merged(self, letters: str) -> list[str]:
        """The letters after all merges, best rank first and leftmost among equals."""
        rank_of, parts = self.ranks.get, list(letters)
        ranks = [rank_of(a + b, _INF) for a, b in zip(parts, parts[1:])]
        while ranks:
            rank = min(ranks)
            if rank == _INF:
                break
            at = ranks.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of(parts[at - 1] + parts[at], _INF)
            if at < len(ranks):
                ranks[at] = rank_of(parts[at] + parts[at + 1], _INF)
        return parts

    def _follows(self, before: str, piece: str) -> bool:
        if not before:
            return self._merged(piece) == [piece]
        return self._merged(before + piece) == [before, piece]

    def _arcs(self, letters: str, at: int) -> list[str]:
        """Pieces that can be written from here, short ones first; a single letter always can."""
        arcs, node = [letters[at]], self.trie.get(letters[at])
        for letter in letters[at + 1 : at + self.longest]:
            node = node.get(letter) if node else None
            if node is None:
                break
            if "" in node:
                arcs.append(node[""])
        return arcs

    def _shortest(self, letters: str) -> bytes:
        """Ids (int32) on the path of least weight through the composed machine.

        Each place is reached with finite weight by one path at most, the encoding of the letters before it.  So a
        place that led nowhere is closed for good, and the first path to the end, found by trying long pieces first,
        is the path of least weight.
        """
        n, follows = len(letters), self.follows
        path, closed, at, before = [], set(), 0, ""
        open_arcs = [self._arcs(letters, 0)]
        while at < n:
            arcs = open_arcs[-1]
            while arcs:
                piece = arcs.pop()
                end = at + len(piece)
                if end not in closed and follows(before, piece):
                    path.append(piece)
                    at, before = end, piece
                    open_arcs.append(self._arcs(letters, at) if at < n else [])
                    break
            else:
                closed.add(at)
                open_arcs.pop()
                at -= len(path.pop())
                before = path[-1] if path else ""
        return array("i", [i for piece in path for i in self._written(piece)]).tobytes()

    def _written(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]

    def encode(self, text: str) -> np.ndarray:
        letters = self.normalised(text)
        if not self.splits:
            return np.frombuffer(self._shortest(letters), np.int32)
        out = []
        # A word begins at a run of marks; only the last mark of the run can belong to a piece of letters.
        parts = letters.split(MARK)
        marks = 0
        for i, part in enumerate(parts):
            marks += i > 0
            if part or i == len(parts) - 1:
                word = MARK * marks + part
                if word:
                    out.append(self.word(word) if len(word) <= 64 else self._shortest(word))
                marks = 0
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The normalised text: pieces joined, bytes read as UTF-8, marks as spaces, without the one put before."""
        text = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def encode_texts(docs: DataFrame, model: PieceModel, text: str = "text") -> DataFrame:
    """Every row with ``ids`` (array<int>) and ``decoded``, the text that the ids give back; input columns are kept.

    Whole texts are encoded, each row on its own; rows are handed on in small batches.  Null texts have no ids (null
    in both); empty texts have an empty array.  Columns named ``ids`` or ``decoded`` are replaced.  The compiled
    machine is as large as the model and goes to every task.
    """
    kept = [c for c in docs.columns if c.lower() not in ("ids", "decoded")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    more = [StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())]
    schema = StructType([*rows.schema.fields, *more])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(model)
        place = kept.index(text)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists, decoded = [], []
                for value in part.column(place).to_pylist():
                    ids = None if value is None else machine.encode(value)
                    lists.append(ids)
                    decoded.append(None if ids is None else machine.decode(ids))
                columns = [*part.columns, pa.array(lists, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "ids", "decoded"])
        machine.forget()

    return rows.mapInArrow(encoded, schema)


_MACHINES: dict = {}


def _machine(model: PieceModel) -> Transducer:
    """One machine per worker, kept for its next tasks."""
    key = (len(model.pieces), hash(tuple(model.pieces)))
    if key not in _MACHINES:
        _MACHINES.clear()
        _MACHINES[key] = Transducer(model)
    return _MACHINES[key]
