"""Secret scans: multipart credential linking by an interval join of identifiers, secrets and endpoints."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: The base patterns and the least lengths of what they must find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_VALUE = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")

#: Every access identifier, hex run and bare secret lies in such a run, so one scan finds where to look closer.
LONG_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])")
WEAK_ID = re.compile(r"""\b(?:user(?:name)?|login|account|client_id|tenant)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", re.I | re.A)
ENDPOINT = re.compile(r"\b(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp|s3)://[^\s\"'<>]{4,}", re.I | re.A)
ROLE = {"assign": "secret", "hex": "secret", "weak_secret": "secret", "access": "id", "weak_id": "id", "endpoint": "endpoint"}

OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, links string"


def _strong_alnum(value: str) -> bool:
    return bool(re.search("[a-z]", value) and re.search("[A-Z]", value) and re.search("[0-9]", value)) and len(set(value)) >= 12


def parts_of(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the base spans, and of the weak candidates; positions in code points."""
    base, weak = [], []
    if "=" in text or ":" in text:
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
        weak += [(m.start(), 3, m.end()) for m in WEAK_ID.finditer(text)]
        if "://" in text:
            weak += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    for run in LONG_RUN.finditer(text):
        at, to = run.span()
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, at, to)]
        base += [(m.start(), 2, m.end()) for m in HEX.finditer(text, at, to)]
        weak += [(m.start(), 4, m.end()) for m in WEAK_SECRET.finditer(text, at, to) if _strong_alnum(m[0])]
    return sorted(base), sorted(weak)


def link_parts(base: list[tuple[int, int, int]], weak: list[tuple[int, int, int]], scope: int) -> tuple[list[tuple[int, int, int]], list[str]]:
    """Weak candidates that have their complement within ``scope`` code points (between the nearer ends), and the links. An identifier needs a secret, a
    secret needs an identifier, an endpoint needs both. A weak span that overlaps a base one is that base one.

    A link says where all partners of an identifier or endpoint lie: from the first one's start to the furthest end. By start, partners are those before the scope's
    end whose own end reaches the scope; with the furthest end so far beside each start, two bisections find them among any number of
    parts, nested or not.
    """

    def sweep(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
        reach, far = [], -1
        for _, e in spans:
            far = max(far, e)
            reach.append(far)
        return [s for s, _ in spans], reach

    starts, reach = sweep(sorted((s, e) for s, _, e in base))
    loose = [w for w in weak if not ((k := bisect_left(starts, w[2])) and reach[k - 1] > w[0])]
    by_role: dict[str, list[tuple[int, int]]] = {"secret": [], "id": [], "endpoint": []}
    for s, k, e in sorted(base + loose):
        by_role[ROLE[KINDS[k]]].append((s, e))
    index = {r: sweep(sorted(v)) for r, v in by_role.items()}

    def partners(role: str, s: int, e: int) -> tuple[int, int] | None:
        starts, reach = index[role]
        last, first = bisect_right(starts, e + scope), bisect_left(reach, s - scope)
        return (starts[first], reach[last - 1]) if first < last else None

    added, links = [], []
    for s, k, e in sorted(base + loose):
        role = ROLE[KINDS[k]]
        others = {"secret": ("id",), "id": ("secret",), "endpoint": ("id", "secret")}[role]
        found = [partners(r, s, e) for r in others]
        if all(found):
            if k >= 3:
                added.append((s, k, e))
            if role != "secret":
                links += [f"{s}:{e}>{p[0]}:{p[1]}" for p in found]
    return added, links


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan_secrets(docs: DataFrame, scope: int = 400) -> DataFrame:
    """One row per document: the base spans' counts and digest, all spans, and which identifiers or endpoints link to which secrets.

    Map only: scopes never cross documents, so nothing is shuffled and any lost task is simply run again. Null and empty texts give
    counts of 0, the digest of an empty string and empty spans; repeated rows are scanned each; other columns are not read.
    """

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base, weak = parts_of(text or "")
                added, links = link_parts(base, weak, scope) if base or weak else ([], [])
                rows.append((doc_id, *(sum(k == j for _, k, _ in base) for j in range(3)), hashlib.sha256(_written(base).encode()).hexdigest(), _written(base + added), ",".join(links)))
            types = [pa.int64()] * 4 + [pa.string()] * 3
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, OUT)


def op5_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))
