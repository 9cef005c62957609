"""Secrets in texts, with parts of multipart credentials linked within scopes.

Base kinds are found by pattern: assignments (assign), access identifiers (access) and long hexadecimal strings (hex).
A credential has up to three parts: an identifier, a secret and an endpoint. Strong parts are the base spans; weak
ones (account names, random-looking strings, addresses of services) say little alone and are looked for in the whole
text. Within a scope - one paragraph, at most SCOPE code points apart - an interval join brings parts together:

* a weak secret (candidate) is reported where a strong identifier is in reach, or a weak one and an endpoint;
* a weak identifier where a strong secret is in reach, or a weak one and an endpoint;
* an endpoint where an identifier and a secret are, strong or weak.

So a credential of weak parts alone is reported where all three stand together. Weak parts that overlap base spans are
left out; of weak ones that overlap, endpoints go before identifiers and these before candidates. The join looks up
the nearest ends and beginnings of sorted intervals by binary search, so a text full of parts needs no pairs.

Defined results: null and empty texts have no spans; long texts are read whole; repeated rows are reported each;
columns other than the id and the text are never read; spans count code points, ends are exclusive; an empty table
gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, slices, texts_of

#: Code points between two linked parts, at the most.
SCOPE = 200
#: Bits per character from which a string counts as random-looking.
ENTROPY = 3.6
KINDS = ("assign", "access", "hex", "identifier", "candidate", "endpoint")


def _either_case(words: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


_ACCOUNTS = ("client", "account", "user", "login")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(_either_case("(password|passwd|secret|token|api_?key)") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones need no match of their own
_IDENTIFIER = re.compile(_either_case("(?:client_?id|account_?id|user_?name|user|login)") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]+")
_PARAGRAPH = re.compile(r"\n[ \t]*\n")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds, by start and then kind."""
    out: list[Span] = []
    if "=" in text or ":" in text:
        low = text.lower()
        if any(w in low for w in _KEYWORDS):
            out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def _random_looking(part: str) -> bool:
    if not (any(c.isdigit() for c in part) and any(c.isalpha() for c in part)):
        return False
    n = len(part)
    return -sum(k / n * math.log2(k / n) for k in Counter(part).values()) >= ENTROPY


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak parts that complementary parts stand beside, by start."""
    weak = _weak_spans(text, base)
    if not weak:
        return []
    paragraphs = [m.start() for m in _PARAGRAPH.finditer(text)]
    of = {
        "strong identifier": _Intervals([x for x in base if x[0] == "access"], paragraphs),
        "strong secret": _Intervals([x for x in base if x[0] != "access"], paragraphs),
        "weak identifier": _Intervals([x for x in weak if x[0] == "identifier"], paragraphs),
        "weak secret": _Intervals([x for x in weak if x[0] == "candidate"], paragraphs),
        "endpoint": _Intervals([x for x in weak if x[0] == "endpoint"], paragraphs),
    }
    out = []
    for kind, s, e in weak:
        near = lambda *parts: any(of[p].reach(s, e) for p in parts)  # noqa: B023, E731
        if kind == "candidate":
            ok = near("strong identifier") or near("weak identifier") and near("endpoint")
        elif kind == "identifier":
            ok = near("strong secret") or near("weak secret") and near("endpoint")
        else:
            ok = near("strong identifier", "weak identifier") and near("strong secret", "weak secret")
        if ok:
            out.append((kind, s, e))
    return out


def _weak_spans(text: str, base: list[Span]) -> list[Span]:
    """Disjoint weak parts outside the base spans, by start."""
    taken = [(s, e) for _, s, e in base]
    out: list[Span] = []
    if "://" in text:
        out += _outside(taken, [("endpoint", *m.span()) for m in _ENDPOINT.finditer(text)])
    low = text.lower()
    if any(w in low for w in _ACCOUNTS):
        out += _outside(taken + [(s, e) for _, s, e in out], [("identifier", *m.span()) for m in _IDENTIFIER.finditer(text)])
    if out or base:  # a candidate alone is never reported
        found = [("candidate", *m.span()) for m in _CANDIDATE.finditer(text) if _random_looking(m[0])]
        out += _outside(taken + [(s, e) for _, s, e in out], found)
    return sorted(out, key=_order)


def _outside(taken: list[tuple[int, int]], spans: list[Span]) -> list[Span]:
    """The spans that overlap none of the taken intervals."""
    if not taken or not spans:
        return spans
    taken = sorted(taken)
    starts, ends = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    out = []
    for span in spans:
        i = bisect_left(starts, span[2])  # those that begin before the span ends
        if not i or ends[i - 1] <= span[1]:
            out.append(span)
    return out


class _Intervals:
    """Parts of one role, for the question whether one is in reach of a span that overlaps none of them."""

    def __init__(self, spans: list[Span], paragraphs: list[int]):
        self.paragraphs = paragraphs
        self.starts = sorted(s for _, s, _ in spans)
        self.ends = sorted(e for _, _, e in spans)

    def reach(self, s: int, e: int) -> bool:
        """Is a part in the span's paragraph and at most SCOPE away?"""
        own = bisect_left(self.paragraphs, s)
        before, after = bisect_right(self.ends, s), bisect_left(self.starts, e)
        if before and s - self.ends[before - 1] <= SCOPE and bisect_left(self.paragraphs, self.ends[before - 1]) == own:
            return True
        return after < len(self.starts) and self.starts[after] - e <= SCOPE and bisect_left(self.paragraphs, self.starts[after]) == own


_SPANS = "array<struct<kind:string,start:int,end:int>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _spans_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    named = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]
    for batch in batches:
        for part in slices(batch):
            base, linked = [], []
            for text in texts_of(part):
                own = base_spans(text)
                base.append(named(own))
                linked.append(named(linked_spans(text, own)))
            yield pa.record_batch([part.column("doc_id"), pa.array(base, _TYPE), pa.array(linked, _TYPE)], ["doc_id", "base", "linked"])


def find(documents: DataFrame) -> DataFrame:
    """(doc_id, base, linked) for each row: arrays of kind, start and end by start."""
    prepare(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_spans_in, f"doc_id long, base {_SPANS}, linked {_SPANS}")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(documents: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row."""
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = lambda spans: F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("at"), s["end"].alias("end"), s["kind"].alias("kind"))
    )
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find(documents).select(
        "doc_id",
        *[count(k) for k in KINDS[:3]],
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat(keyed(F.col("base")), keyed(F.col("linked"))))).alias("spans"),
    )
