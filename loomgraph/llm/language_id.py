"""Language ID by prediction by partial matching (PPM).

For each language a tree of byte contexts of up to three bytes counts what follows them. A byte costs minus log2 of
its share in the longest known context; where it has not been seen there, an escape is paid (method C: as many
chances as the context has different successors) and the next shorter context is asked, down to 1/256. Statistics
are frozen after fitting, so the cost of a byte depends on the three bytes before it alone: all trees become one
table of costs by context, byte and language, and a text's code lengths are sums of looked-up rows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import aside, map_batches, restored, slices, texts
from .sampling import by_hash

ORDER = 3
_PAD = b"\n" * ORDER
_ASCII_LETTER = re.compile(r"[A-Za-z]")
#: Bytes that are scored at once; a longer text goes in pieces.
PIECE = 1 << 19
UNDETERMINED = "und"


def has_letter(text: str) -> bool:
    """Whether any character is of the Unicode categories of letters (½, ² and ① are numbers)."""
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text)))


def count_grams(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Runs of four bytes, the last one being what follows the context of the others, and their counts."""
    b = np.frombuffer(_PAD + raw, np.uint8).astype(np.uint32)
    return np.unique(b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:], return_counts=True)


@dataclass
class Model:
    """Counts by language; the tables are made where they are used."""

    languages: list[str]
    grams: list[np.ndarray]
    counts: list[np.ndarray]
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def tables(self) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
        """(symbol of each byte, number of symbols, row of each context, costs by row and symbol).

        Symbol 0 stands for all bytes that no language has. A context's row is that of its longest suffix that
        some language has.
        """
        used = np.unique(np.concatenate([g >> s & 255 for g in self.grams for s in (0, 8, 16, 24)] + [np.array([10], np.uint32)]))
        symbol = np.zeros(256, np.int64)
        symbol[used] = np.arange(1, len(used) + 1)
        size = len(used) + 1
        n = len(self.languages)
        known = [np.unique(np.concatenate([self._split(g, symbol, size, order)[0] for g in self.grams])) for order in range(ORDER + 1)]
        begins = np.cumsum([0, *map(len, known)])
        # Rows of order 0 begin with 1/256, those of each longer order with the rows of the shorter one.
        rows = np.empty((begins[-1], size, n), np.float32)
        rows[0] = 8.0
        at = np.zeros(1, np.int64)
        for order in range(ORDER + 1):
            begin = begins[order]
            if order:
                rows[begin : begins[order + 1]] = rows[at[known[order] % size ** (order - 1)]]
                at = np.tile(at, size)  # a context that is not known keeps the row of its suffix
                at[known[order]] = begin + np.arange(len(known[order]))
            for i, (g, c) in enumerate(zip(self.grams, self.counts)):
                context, follows = self._split(g, symbol, size, order)
                pair, where = np.unique(context * size + follows, return_inverse=True)
                seen = np.bincount(where, c)
                own, of = np.unique(pair // size, return_inverse=True)
                total, different = np.bincount(of, seen), np.bincount(of)
                row = begin + np.searchsorted(known[order], own)
                rows[row, :, i] += np.log2((total + different) / different)[:, None]
                rows[row[of], pair % size, i] = np.log2((total + different)[of] / seen)
        return symbol, size, at.astype(np.int32), rows.reshape(-1, n)

    @staticmethod
    def _split(grams: np.ndarray, symbol: np.ndarray, size: int, order: int) -> tuple[np.ndarray, np.ndarray]:
        context = np.zeros(len(grams), np.int64)
        for shift in range(8 * order, 0, -8):
            context = context * size + symbol[grams >> shift & 255]
        return context, symbol[grams & 255]


class Scorer:
    def __init__(self, model: Model):
        self.languages = model.languages
        if not self.languages:
            return
        self.symbol, self.size, self.at, self.cost = model.tables()

    def code_lengths(self, raws: list[bytes]) -> np.ndarray:
        """Bits of each text under each language. Texts are read in pieces, each after the bytes that are the
        context of its first ones, so that memory does not grow with a text."""
        out = np.zeros((len(raws), len(self.languages)))
        if not self.languages:
            return out
        rows, pieces, size = [], [], 0
        for i, raw in enumerate(raws):
            for at in range(0, len(raw), PIECE):
                piece = raw[at : at + PIECE]
                rows.append(i), pieces.append((_PAD + raw[max(0, at - ORDER) : at])[-ORDER:] + piece)
                size += len(piece)
                if size >= PIECE:
                    np.add.at(out, rows, self._bits(pieces))
                    rows, pieces, size = [], [], 0
        if pieces:
            np.add.at(out, rows, self._bits(pieces))
        return out

    def _bits(self, pieces: list[bytes]) -> np.ndarray:
        """Bits of pieces, none of them empty, without the first bytes of each, which are context alone."""
        s = self.symbol[np.frombuffer(b"".join(pieces), np.uint8)]
        context = (s[:-3] * self.size + s[1:-2]) * self.size + s[2:-1]
        bits = self.cost[self.at[context] * self.size + s[3:]]
        ends = np.cumsum([len(p) for p in pieces])
        begins = ends - [len(p) for p in pieces]
        # The bits of a byte stand at its context's first byte; the last ones of a piece are of the next one's context.
        borders = np.column_stack([begins, ends - ORDER]).ravel()[:-1]
        return np.add.reduceat(bits, borders, axis=0, dtype=np.float64)[::2]


def fit(train: DataFrame, most: int = 1500) -> Model:
    """Fit to train(doc_id, text, lang), from about `most` rows of each language (the bound of the sample)."""
    sample = by_hash(train.select("doc_id", "text", "lang"), "doc_id", "lang", most, "ppm").filter(F.col("text").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 20):
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(2).to_pylist(), texts(batch)):
                by_lang.setdefault(lang, []).append(text)
            for lang, own in by_lang.items():
                grams, n = count_grams(_PAD.join(t.encode() for t in own))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    found = map_batches(sample, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, gram, n = (found.column(i).to_numpy() for i in range(3))
    languages = sorted(set(lang.tolist()))
    of = [np.flatnonzero(lang == x) for x in languages]
    return Model(languages, [gram[i].astype(np.uint32) for i in of], [n[i] for i in of])


_made: dict[str, Scorer] = {}


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs(text, ...), with lang_pred, score (the share of the best language if all were equally
    likely before) and bits_per_byte (its code length).

    Of languages with equal code lengths the first by name is taken. A text that is null or has no letter, or a model
    without languages, gives `und` with score 0. Columns of docs
    with these names are replaced; repeated rows stay; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # counts of a bounded sample
    names = ("lang_pred", "score", "bits_per_byte")
    kept = docs.drop(*names)
    inner = aside(kept)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        if own.key not in _made:
            _made.clear()
            _made[own.key] = Scorer(own)
        scorer = _made[own.key]
        for batch in slices(batches, most=1 << 19):
            whole = texts(batch)
            raws = [t.encode() for t in whole]
            bits = scorer.code_lengths(raws)
            pred, share, per_byte = [], [], []
            for text, raw, b in zip(whole, raws, bits):
                if not len(b) or not has_letter(text):
                    pred.append(UNDETERMINED), share.append(0.0), per_byte.append(None)
                    continue
                best = int(b.argmin())
                pred.append(scorer.languages[best]), per_byte.append(float(b[best]) / len(raw))
                share.append(1 / sum(2.0 ** max(-1000.0, b[best] - x) for x in b))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(share, pa.float64()), pa.array(per_byte, pa.float64())], [*batch.schema.names, *names])

    added = _parse_datatype_string("lang_pred string, score double, bits_per_byte double")
    return restored(map_batches(inner, score, StructType([*inner.schema.fields, *added.fields]), _made), kept.columns, more=names)


def accepted(docs: DataFrame, model: Model, most_bits: float = 12.0) -> DataFrame:
    """Rows of docs in a determined language. All columns stay as they are.

    A text in none of the learned languages is one that costs more than `most_bits` a byte even in the best one: most
    of its bytes escape all contexts. Keys, numbers and other runs of known characters stay well below.
    """
    found = identify(aside(docs), model)
    return restored(found.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("bits_per_byte") <= most_bits)), docs.columns)
