"""Secret scan with multipart credential linking.

Strong patterns (assignments, access ids, long hex) count on their own. Weak parts - something that looks
like an account name, a mixed random-looking string, an endpoint - mean nothing alone, and are reported
only where complementary parts meet in a scope (a block of text without an empty line): an interval join looks for
the parts that each lacks, over the whole scope or within ``window`` characters to either side.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import append_columns, position

#: The base patterns and the order of their kinds. Lengths are of the whole match, for assign of the value.
KINDS = ("assign", "access", "hex", "ident", "key", "endpoint")
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_CHARS = 12
#: Runs are maximal, so asking for the length in the pattern is the same as dropping short matches.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

#: Weak parts. An identifier is named as one; a key mixes capitals, small letters and digits.
IDENT = re.compile(r"""(?:access[_-]?key[_-]?id|client[_-]?id|account[_-]?id|user(?:name)?|login)["']?\x20?[:=]\x20?["']?([A-Za-z0-9._@-]{4,})""", re.ASCII | re.IGNORECASE)
IDENT_WORDS = ("key", "client", "account", "user", "login")
KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])")
#: A scheme begins with the first letter of its run.
ENDPOINT = re.compile(r"""(?<![a-z0-9+.-])[0-9+.-]*+([a-z][a-z0-9+.-]++)://[^\s"'<>]{4,}""")
SCOPE_END = re.compile(r"\n[ \t\r]*\n")

Span = tuple[int, int, int]  # kind by place in KINDS, start, end


def base_spans(text: str) -> list[Span]:
    """The strong matches, in code points, by start and then kind."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += ((0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS)
    if "AKIA" in text:
        out += ((1, m.start(), m.end()) for m in ACCESS.finditer(text))
    out += ((2, m.start(), m.end()) for m in HEX.finditer(text))
    return sorted(out, key=lambda s: (s[1], s[0]))


def _mixed(word: str) -> bool:
    return any(c.isdigit() for c in word) and any(c.islower() for c in word) and any(c.isupper() for c in word)


def weak_parts(text: str) -> list[Span]:
    """Candidates that need company, without regard to the base spans."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in IDENT_WORDS):
        out += ((3, m.start(1), m.end(1)) for m in IDENT.finditer(text))
    out += ((4, m.start(), m.end()) for m in KEY.finditer(text) if _mixed(m[0]))
    if "://" in text:
        out += ((5, m.start(1), m.end()) for m in ENDPOINT.finditer(text))
    return out


class _Intervals:
    """Spans of one role by start, with the two furthest ends up to each: tells in logarithmic time whether any comes within reach."""

    def __init__(self, spans: list[Span]):
        spans = sorted(spans, key=lambda s: s[1])
        self.starts = [s[1] for s in spans]
        self.furthest: list[tuple[Span | None, Span | None]] = []
        first = second = None
        for s in spans:
            if first is None or s[2] > first[2]:
                first, second = s, first
            elif second is None or s[2] > second[2]:
                second = s
            self.furthest.append((first, second))

    def meets(self, lo: int, hi: int, but: Span | None = None) -> bool:
        """Whether a span other than ``but`` starts at ``hi`` or before and ends at ``lo`` or after."""
        at = bisect_right(self.starts, hi)
        if not at:
            return False
        first, second = self.furthest[at - 1]
        best = second if first == but else first
        return best is not None and best[2] >= lo


def link_parts(text: str, base: list[Span], weak: list[Span], window: int | None) -> list[Span]:
    """The weak parts whose complements co-occur in their scope, within ``window`` characters if that is given.

    A key needs an identifier; an identifier needs a key, an assigned secret or a hex string; an endpoint
    needs both. Weak parts that overlap a base span are part of it and are left out.
    """
    if not weak:
        return []
    taken = _Intervals(base)
    weak = [w for w in weak if not taken.meets(w[1] + 1, w[2] - 1)]
    ends = [m.start() for m in SCOPE_END.finditer(text)] if weak else []
    scope = lambda s: bisect_right(ends, s[1])
    found: list[Span] = []
    for _, group in groupby(sorted([*base, *weak], key=lambda s: (s[1], s[0])), key=scope):
        parts = list(group)
        idents = _Intervals([s for s in parts if s[0] in (1, 3)])
        secrets = _Intervals([s for s in parts if s[0] in (0, 2, 4)])
        for s in parts:
            lo, hi = (0, len(text)) if window is None else (s[1] - window, s[2] + window)
            if s[0] == 4 and idents.meets(lo, hi, s) or s[0] == 3 and secrets.meets(lo, hi, s) or s[0] == 5 and idents.meets(lo, hi, s) and secrets.meets(lo, hi, s):
                found.append(s)
    return found


def scan_text(text: str | None, window: int | None = 200) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, by start and then kind."""
    base = base_spans(text or "")
    more = link_parts(text or "", base, weak_parts(text or ""), window)
    return base, sorted([*base, *more], key=lambda s: (s[1], s[0]))


SPAN_TYPE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(df: DataFrame, text_col: str = "text", window: int | None = None) -> DataFrame:
    """Adds ``secret_spans`` (array of kind, start, end in code points), all spans of the whole text; without a ``window`` the scope
    alone bounds what is joined.

    Null and empty texts have none. Rows are independent; clashing columns are replaced.
    """
    at = position(df, text_col)

    def make():
        def step(b: pa.RecordBatch) -> list:
            rows = [scan_text(t, window)[1] for t in b.column(at).to_pylist()]
            return [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in r] for r in rows], _ARROW_SPAN)]

        return step

    return append_columns(df, [T.StructField("secret_spans", SPAN_TYPE)], make)


def digests(df: DataFrame) -> DataFrame:
    """The digest columns, derived from ``secret_spans`` of the scan. Null and empty texts have no span; rows are independent."""
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*KINDS[:3]))
    text = lambda some: F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(df.select("doc_id", "text")).select("doc_id", *map(count, KINDS[:3]), F.sha2(text(base), 256).alias("base_sha256"), text(spans).alias("spans"))
