"""Secret scans with multipart credential linking.

Base patterns find strong findings. Weak parts (identifiers, opaque secrets, endpoints) are common in clean text, so a
weak part is reported only when complementary parts stand in the same scope: intervals around the parts are joined by
sorted sweeps within a document, and a part is kept if each complementary kind has a member whose interval meets its own.

A scope is a paragraph (text between blank lines), and parts in it count as near if at most ``reach`` code points lie
between them. The sweeps are existence tests on sorted arrays: n log n, no pairs are made.

Defined results: null text is empty and has no findings; matches are leftmost and non-overlapping within a kind; kinds
may overlap; every row gets its own result, repeated rows too; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.llm import runtime

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
# weak parts
IDENTIFIER = re.compile(r"""\b(?:user_?(?:name|id)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})""", re.IGNORECASE | re.ASCII)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""\b(?:https?|ftps?|s3|jdbc:\w+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]{3,}|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?([A-Za-z0-9.-]+\.[A-Za-z]{2,}(?::\d+)?)""", re.IGNORECASE | re.ASCII)
BLANK = re.compile(r"\n[\x20\t\r]*\n")


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, in order."""
    low = text.lower()
    found = []
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    return found


def _opaque(s: str) -> bool:
    """Looks random: upper and lower case and digits mixed."""
    return any(c.isdigit() for c in s) and any(c.isupper() for c in s) and any(c.islower() for c in s)


def _near(parts: list[tuple[int, int]], others: list[tuple[int, int]], breaks: list[int], reach: int) -> list[bool]:
    """For each part: does a part of the other kind lie within reach and in the same paragraph? All lists are sorted.

    Of the others that begin early enough, the one that reaches furthest within the paragraph decides: a running maximum.
    """
    starts = [s for s, _ in others]
    paragraph = [bisect_right(breaks, s) for s in starts]
    furthest: list[int] = []
    for i, (_, e) in enumerate(others):
        furthest.append(max(e, furthest[-1]) if i and paragraph[i] == paragraph[i - 1] else e)
    out = []
    for s, e in parts:
        k = bisect_right(breaks, s)
        end = breaks[k] if k < len(breaks) else 1 << 62
        j = bisect_right(starts, min(end - 1, e + reach)) - 1
        out.append(j >= 0 and paragraph[j] == k and furthest[j] >= s - reach)
    return out


def _apart(parts: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those parts that overlap nothing that is taken. parts are sorted and do not overlap each other."""
    merged: list[list[int]] = []
    for s, e in sorted(taken):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    starts = [s for s, _ in merged]
    out = []
    for s, e in parts:
        i = bisect_left(starts, e) - 1  # the last that begins before the part ends
        if i < 0 or merged[i][1] <= s:
            out.append((s, e))
    return out


def linked_parts(text: str, base: list[tuple[int, int, int]], reach: int) -> list[tuple[int, str, int]]:
    """Weak parts that complement each other (or a strong finding) within a scope. An identifier's own value is no secret of its own."""
    ids = [m.span() for m in IDENTIFIER.finditer(text)] if ":" in text or "=" in text else []
    ends = [m.span() for m in ENDPOINT.finditer(text)] if "://" in text or "=" in text or ":" in text else []
    strong_id = [(s, e) for s, k, e in base if k == 1]
    strong_secret = [(s, e) for s, k, e in base if k != 1]
    if not (ids or ends or strong_id):
        return []
    opaque = _apart([m.span() for m in OPAQUE.finditer(text) if _opaque(m[0])], strong_id + strong_secret + ends + ids)
    breaks = [m.end() for m in BLANK.finditer(text)]
    all_id, all_secret = sorted(strong_id + ids), sorted(strong_secret + opaque)
    near_secret = _near(ids, all_secret, breaks, reach)
    out = [(s, "id", e) for (s, e), ok in zip(ids, near_secret, strict=True) if ok]
    out += [(s, "key", e) for (s, e), ok in zip(opaque, _near(opaque, all_id, breaks, reach), strict=True) if ok]
    with_id, with_secret = _near(ends, all_id, breaks, reach), _near(ends, all_secret, breaks, reach)
    return out + [(s, "endpoint", e) for (s, e), a, b in zip(ends, with_id, with_secret, strict=True) if a and b]


def scan_text(text: str | None, reach: int = 200) -> tuple[list[tuple[int, int, int]], list[tuple[int, str, int]]]:
    """Base findings, and all findings as (start, kind, end) in order."""
    text = text or ""
    base = base_findings(text)
    spans = [(s, KINDS[k], e) for s, k, e in base]
    rank = {k: i for i, k in enumerate((*KINDS, "id", "key", "endpoint"))}
    return base, sorted(spans + linked_parts(text, base, reach), key=lambda x: (x[0], rank[x[1]], x[2]))


SCHEMA = pa.schema([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("redacted", pa.string())])


def find_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", reach: int = 200, redact: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each row: key, counts, digest and spans of the findings; with ``redact`` the text with findings masked.

    carry: columns that are passed on as they are, behind the key. A result whose name is taken gets an underscore before it.
    """
    runtime.prepare(df.sparkSession)
    rows = df.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__carry_{c}") for c in carry), F.col(text).alias("__text"))
    fields = [f for f in SCHEMA if redact or f.name != "redacted"]
    names = rows.columns[:-1]
    schema = StructType(rows.schema.fields[:-1])
    for f in fields:
        schema = schema.add(f.name, "long" if f.type == pa.int64() else "string")

    def kernel(it):
        for batch in it:
            out: dict[str, list] = {f.name: [] for f in fields}
            for t in batch.column("__text").to_pylist():
                base, spans = scan_text(t, reach)
                for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                    out[name].append(sum(x[1] == k for x in base))
                out["base_sha256"].append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest())
                out["spans"].append(",".join(f"{k}:{s}:{e}" for s, k, e in spans))
                if redact:
                    out["redacted"].append(None if t is None else mask(t, spans))
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), *(pa.array(out[f.name], f.type) for f in fields)], names=[*names, *(f.name for f in fields)])

    found = rows.mapInArrow(runtime.lean(kernel), schema)
    results = runtime.fresh(df.select(key, *carry), *(f.name for f in fields))
    return found.select(F.col("__key").alias(key), *(F.col(f"__carry_{c}").alias(c) for c in carry), *(F.col(f.name).alias(r) for f, r in zip(fields, results, strict=True)))


def mask(text: str, spans: list[tuple[int, str, int]]) -> str:
    """Each maximal stretch of findings becomes [SECRET]."""
    parts, at = [], 0
    for s, _, e in spans:
        if s >= at:
            parts += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join(parts) + text[at:]
