"""Secret scans: three patterns, and strings in a sensitive context that zstandard cannot compress.

A candidate is a long run of letters, digits and marks near a word such as `secret` or `key`. Its novelty is what it
adds to the compressed size of the text around it, per character, under a dictionary of identifiers and common
words: names and words are known or repeat and add little, random strings add nearly all their characters.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import aside, map_batches, restored, slices, texts

KINDS = ("assign", "access", "hex", "novel")
# The patterns of the contract. Letters of the first one are matched in either case, ASCII alone.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# A run that is long enough is what the shorter pattern finds there, as both take the longest run.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Words that make the text around them sensitive.
CONTEXT = ("password", "passwd", "secret", "token", "apikey", "api_key", "api-key", "credential", "authorization", "bearer", "private key", "private_key", "access key", "access_key", "client_id")
_CONTEXT = re.compile("|".join(CONTEXT), re.IGNORECASE | re.ASCII)
_CONTEXT_BYTES = [w.encode() for w in CONTEXT]
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{20,}")
#: What code and configuration hold around secrets; the rest of the dictionary are its parts joined in usual ways.
_PARTS = (
    "access account address api app application array auth authorization aws azure base64 bearer bool bucket build byte cache "
    "callback class client code column config configuration connection const content context cookie create credential data "
    "database debug default delete dev digest domain email enable encoding endpoint env environment error event example export "
    "false file filter format function google group handler hash header host http https id import index info input instance "
    "int integer interface item java json key label length license link list local localhost log login main manager map "
    "message method model module name namespace node null number object option output package parameter parse password path "
    "port print private process prod production project property protocol provider public query queue random read record "
    "region remote request resource response result return role root route schema script secret section server service "
    "session set setting source space sql static status storage string struct system table target task template test text "
    "timeout timestamp title token true type update upload url user username utf valid value vector version view void web "
    "window work write xml yaml the and of to in is that for with as on this be are from have not which will can"
)


def identifiers() -> bytes:
    """The dictionary: the parts, and each part with its successors as snake, kebab and camel case."""
    parts = _PARTS.split()
    joined = [f"{a}_{b} {a}-{b} {a}{b.title()} {a.upper()}_{b.upper()}=" for i, a in enumerate(parts) for b in (parts[(7 * i + 3) % len(parts)], "key", "id")]
    return "\n".join([" ".join(joined), " ".join(parts), "0123456789", "https://www.example.com/"]).encode()


class Novelty:
    """Marginal compressed bytes of a string, per character."""

    def __init__(self, dictionary: bytes, level: int = 6):
        data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)

    def __call__(self, before: str, candidate: str, after: str) -> float:
        rest = before + "\n" + after
        added = len(self.compressor.compress((rest + "\n" + candidate).encode())) - len(self.compressor.compress(rest.encode()))
        return max(0.0, added / len(candidate))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the three patterns, by start and then by kind as listed; code points, end exclusive."""
    out: list[tuple[int, int, int]] = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(a, KINDS[k], b) for a, k, b in sorted(out)]


def novel_spans(text: str, taken: list[tuple[int, str, int]], novelty: Novelty, reach: int, least: float, around: int) -> list[tuple[int, str, int]]:
    """Incompressible candidates within `reach` characters of a sensitive word, apart from the spans taken (by start).

    One pass over the whole runs of the text: of the sensitive words that end late enough for a run the first one
    begins earliest, so it alone decides whether one is near. Likewise one number, the furthest end of the spans
    that begin before a run's end, tells whether one of them overlaps it.
    """
    raw = text.encode().lower()
    if not any(w in raw for w in _CONTEXT_BYTES):
        return []
    sensitive = [(m.start(), m.end()) for m in _CONTEXT.finditer(text)]
    starts, furthest = [a for a, _, _ in taken], list(accumulate((b for _, _, b in taken), max))
    found, word = [], 0
    for c in _CANDIDATE.finditer(text):
        begin, end = c.span()
        while word < len(sensitive) and sensitive[word][1] + reach < begin:
            word += 1
        if word == len(sensitive):
            break
        if sensitive[word][0] - reach > end:
            continue
        before = bisect_left(starts, end)
        if before and furthest[before - 1] > begin:
            continue
        if novelty(text[max(0, begin - around) : begin], c[0], text[end : end + around]) >= least:
            found.append((begin, "novel", end))
    return found


def scan(docs: DataFrame, dictionary: bytes | None = None, reach: int = 80, least: float = 0.75, around: int = 256) -> DataFrame:
    """Secrets in all rows of docs(doc_id, text, ...).

    Runs within `reach` characters of a sensitive word are measured against the dictionary and the `around`
    characters on each side of them; those that add `least` bytes a character or more are reported.

    Returns all columns of docs and spans, an array of (kind, start, end, text) by start and then kind, in code
    points with the end exclusive. Null texts have no spans; repeated rows stay; an empty table gives no rows.
    A column of docs named spans is replaced. Runs of fewer than 20 characters are not measured.
    """
    primed = identifiers() if dictionary is None else dictionary
    kept = docs.drop("spans")
    inner = aside(kept)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(primed)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))
        for batch in slices(batches):
            spans = []
            for text in texts(batch):
                base = base_spans(text)
                every = sorted(base + novel_spans(text, base, novelty, reach, least, around), key=lambda s: (s[0], KINDS.index(s[1])))
                spans.append([{"kind": k, "start": a, "end": b, "text": text[a:b]} for a, k, b in every])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], [*batch.schema.names, "spans"])

    added = _parse_datatype_string("spans array<struct<kind:string,start:bigint,end:bigint,text:string>>")
    return restored(map_batches(inner, find, StructType([*inner.schema.fields, *added.fields])), kept.columns, more=("spans",))


def redact(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """docs with every span of text replaced by a mark; overlapping spans get one. All other columns stay."""
    found = scan(aside(docs), **options)
    step = """aggregate(spans, named_struct('upto', 0L, 'out', ''), (a, s) -> named_struct(
        'upto', greatest(a.upto, s.end),
        'out', CASE WHEN s.start >= a.upto THEN concat(a.out, substring(text, int(a.upto) + 1, int(s.start - a.upto)), '{mark}') ELSE a.out END),
        a -> concat(a.out, substring(text, int(a.upto) + 1, length(text))))"""
    text = F.when(F.size("spans") > 0, F.expr(step.format(mark=mark.replace("\\", "\\\\").replace("'", "\\'")))).otherwise(F.col("text"))
    return restored(found, docs.columns, text)


def digest(spans: list[tuple[int, str, int]]) -> str:
    """kind:start:end of spans, comma-joined, as lowercase hex of SHA-256 (for tests)."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
