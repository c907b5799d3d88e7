"""Exact token counts at every prefix of a text.

A text is a row of units, each a run of white space with the run of other characters after it. No token spans two
units and no unit changes the tokens of those before it, so the count at a prefix is the sum over the whole units
before it plus the count of the part of the last one. Within a unit the counts come from dynamic programming over
its bytes: of all tokens that end at a byte, exactly one can follow the last token of what is before it (two
neighbours are possible if encoding their joined bytes gives them back), and the count there is one more than
the count where that token begins. Counts of a unit are kept per worker, so frequent units are found once.

The stored form is one signed byte for each code point: how much the count changes there. Its running sum answers
how many tokens a prefix has, or how long a prefix fits a budget, without encoding again.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import map_batches, slices, texts
from .tokens import SPECIAL, vocabulary

#: Unicode's White_Space, which the tokenizer's pattern means by \\s.
_SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNIT = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: With no two neighbouring white-space characters, splitting at blanks and newlines gives the units.
_IRREGULAR = re.compile(f"[{_SPACE}]{{2}}|" + f"[{_SPACE}]".replace(r"\n", "").replace(r"\x20", ""))
_LEADING = re.compile(f"[{_SPACE}]*")
_CONTRACTION = re.compile("'(?:s|t|re|ve|m|ll|d)")
_LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_MARKS = r"!-&(-/:-@\[-`{-~"
#: Runs of one class, none of which a longer or shorter text would cut elsewhere (no apostrophes).
_PLAIN = re.compile(f"[ \n]?(?:[{_LETTERS}]++|[0-9]++|[{_MARKS}]++)++")
_STEM, _TAIL = re.compile(f"[{_LETTERS}]+"), ",.!?:;%$#&*"
_RUN = re.compile(f" ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+|\n")


def _byte_letters() -> dict[str, int]:
    """The character by which a byte-level vocabulary writes each byte: printable Latin-1 stands for itself, the
    other bytes follow in order from code point 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter(dict):
    """Maps a unit, without the blank before it, to the changes of the count at its code points."""

    def __init__(self, library: str, most: int = 450_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.library, self.most = Tokenizer.from_file(library), most
        letters = _byte_letters()
        with open(library) as f:
            model = json.load(f)["model"]
        raw = lambda word: bytes(letters[c] for c in word)
        self.known = {raw(w) for w in model["vocab"] if all(c in letters for c in w)}
        self.longest = max(map(len, self.known))
        pairs = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.halves = {a + b: (a, b) for a, b in reversed(pairs)}
        self.follows: dict[tuple[bytes, bytes], bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts of a token that lie at its edge while it is merged, each with the rank of the merge that takes it up."""
        out, taken = [(token, 1 << 30)], token
        while taken in self.halves:
            rank = self.rank[self.halves[taken]]
            taken = self.halves[taken][side]
            out.append((taken, rank))
        return out

    def may_follow(self, a: bytes, b: bytes) -> bool:
        """Whether the tokens stay as they are side by side: no merge across their border comes before the merges
        that take up the two parts at it (of equal merges, the left one comes first)."""
        if (known := self.follows.get((a, b))) is None:
            if len(self.follows) > 2 * self.most:
                self.follows.clear()
            left, right = self.edge(a, 1), self.edge(b, 0)
            known = self.follows[a, b] = not any((m := self.rank.get((x, y))) is not None and m < end_x and m <= end_y for x, end_x in left for y, end_y in right)
        return known

    def run(self, raw: bytes) -> list[int]:
        """Counts at each byte of one pre-token, by dynamic programming over the last token."""
        known, follows, most = self.known, self.follows, self.longest
        last, count, begin = [b""], [0], 0
        for end in range(1, len(raw) + 1):
            # Only one begin is right. Most often it is that of the last token, which grows, or a new one.
            token = raw[begin:end]
            if token not in known or begin and not self.may_follow(last[begin], token):
                for begin in range(end - 1, max(0, end - most) - 1, -1):
                    token = raw[begin:end]
                    if token in known:
                        if not begin:
                            break
                        if (fits := follows.get((last[begin], token))) is None:
                            fits = self.may_follow(last[begin], token)
                        if fits:
                            break
            last.append(token)
            count.append(count[begin] + 1)
        return count[1:]

    def encoded(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def at_characters(self, piece: str) -> list[int]:
        """Counts at each code point of one pre-token, which ends where the next byte does not go on with it."""
        raw = piece.encode()
        counts = self.run(raw)
        if len(raw) > len(piece):
            counts = [n for i, n in enumerate(counts) if i + 1 == len(raw) or raw[i + 1] & 0xC0 != 0x80]
        return counts

    def word(self, piece: str) -> bytes:
        """Changes of the count at the code points of one pre-token."""
        if (changes := self.words.get(piece)) is None:
            before, out = 0, []
            for n in self.at_characters(piece):
                out.append(n - before & 255)
                before = n
            changes = bytes(out)
            if len(piece) <= 64:
                if len(self.words) >= self.most:
                    self.words.clear()
                self.words[piece] = changes
        return changes

    def unit(self, unit: str) -> bytes:
        """Changes of the count at the code points of one unit."""
        if _PLAIN.fullmatch(unit):
            return b"".join(map(self.word, _RUN.findall(unit)))
        counts, before = [], 0
        pieces = [unit[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(unit)]
        for piece in pieces:
            # a part of 're is tokenized as other text
            inside = [self.encoded(piece[:i]) for i in range(1, len(piece) + 1)] if _CONTRACTION.fullmatch(piece) else self.at_characters(piece)
            counts += [before + n for n in inside]
            before += inside[-1]
        blank = _LEADING.match(unit)[0]
        if len(blank) > 1:  # as long as nothing follows, the white space is one pre-token
            counts[: len(blank)] = self.at_characters(blank)
        return bytes([(b - a) & 255 for a, b in zip([0, *counts], counts)])

    def __missing__(self, key: str) -> bytes:
        if (changes := self.older.get(key)) is None:
            stem = key.rstrip(_TAIL)
            if _STEM.fullmatch(stem):
                changes = self.word(" " + stem)
                if len(stem) < len(key):
                    changes += self.word(key[len(stem) :])
            else:
                changes = self.unit(key if key[:1] == "\n" else " " + key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = changes
        return changes

    def segment(self, text: str) -> bytes:
        """Changes at the code points of a text without the special string."""
        if not text:
            return b""
        if _IRREGULAR.search(text):
            return b"".join(self[u[1:]] if u[0] == " " and len(_LEADING.match(u)[0]) == 1 else self.unit(u) for u in _UNIT.findall(text))
        first, *rest = text.replace("\n", " \n").split(" ")
        return (self.unit(first) if first else b"") + b"".join(map(self.__getitem__, rest))

    def changes(self, text: str) -> bytes:
        """Changes at all code points of any text; the special string is one token once it is whole."""
        first, *rest = text.split(SPECIAL)
        out = [self.segment(first)]
        before = first
        for part in rest:
            unit = (_UNIT.findall(before) or [""])[-1]
            inside = [self.encoded(unit + SPECIAL[:i]) for i in range(len(SPECIAL))] + [self.encoded(unit) + 1]
            out += [np.diff(inside).astype(np.int8).tobytes(), self.segment(part)]
            before = part
        return b"".join(out)


_made: dict[str, PrefixCounter] = {}


def prefix_counts(docs: DataFrame, library: str | None = None) -> DataFrame:
    """Token counts at every prefix of all rows of docs(doc_id, text).

    Returns doc_id, n_bytes, n_tokens and prefix_changes (binary, one signed byte for each code point). Null and
    empty texts have no tokens. Repeated rows stay, further columns are dropped, an empty table gives no rows.
    library: the vocabulary file (default: byte_bpe_50k.json).
    """
    library = library or vocabulary("byte_bpe_50k.json")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _made.get(library) or _made.setdefault(library, PrefixCounter(library))
        gc.disable()  # the counter's many small objects form no cycles
        for batch in slices(batches):
            found = [counter.changes(x) for x in texts(batch)]
            total = [int(np.frombuffer(x, np.int8).sum(dtype=np.int64)) for x in found]
            n_bytes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), n_bytes, pa.array(total, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "n_bytes", "n_tokens", "prefix_changes"])

    return map_batches(docs.select("doc_id", "text"), count, "doc_id long, n_bytes long, n_tokens long, prefix_changes binary")


def tokens_at(changes: bytes, length: int) -> int:
    """Tokens of the first `length` code points."""
    return int(np.frombuffer(changes, np.int8, min(length, len(changes))).sum(dtype=np.int64))


def longest_within(changes: bytes, budget: int) -> int:
    """Code points of the longest prefix of at most `budget` tokens."""
    counts = [0, *accumulate(np.frombuffer(changes, np.int8).tolist())]
    return max(i for i, n in enumerate(counts) if n <= budget)
