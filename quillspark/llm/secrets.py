"""Secret scans: known forms and sliding-window entropy.

Known forms (`assign`, `access`, `hex`) are found by pattern, leftmost and
without overlap for each kind. The entropy method adds spans of kind
`entropy`: candidates are maximal runs of `[A-Za-z0-9+/_=-]`; for each
character class a candidate may be in (hexadecimal digits, base 64), a
window of that class's width slides over it and its Shannon entropy is
carried along by counts: moving by one character changes two counts, and
only those terms of the sum are replaced. A candidate whose best window
reaches the class's threshold, and that mixes letters with digits (or the
cases), is a secret, unless the allow-list suppresses it: UUIDs, path-like
words, repeated or consecutive runs, names of hash algorithms, words made of
letters of one case only, and candidates that a known form already covers.

Windows are reckoned with integer counts and a table of n*log2(n), so that
equal windows have equal entropy wherever they begin.

Defined cases: a null text is empty; offsets are code points, end exclusive;
repeated rows are scanned each for itself; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import DataFrame, SparkSession

from . import common

#: The known forms.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run, as for [0-9a-f]+, of 24 or more
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
HEXADECIMAL = re.compile(r"[0-9A-Fa-f]+")
#: (class, window, bits a character that its best window must reach)
CLASSES = (("hexadecimal", 32, 3.2), ("base64", 24, 3.9))
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(r"/?(?:[A-Za-z_]+/)+[A-Za-z_]*"),
    re.compile(r"(?:[A-Za-z]+[-_])+[A-Za-z]+"),
    re.compile(r"sha(?:1|224|256|384|512)-.*|md5-.*"),
)
_TERM = [0.0] + [n * math.log2(n) for n in range(1, 65)]


def window_entropy(s: str, width: int) -> float:
    """The highest Shannon entropy of a window of `width` characters (of the
    whole, where it is shorter), in bits a character."""
    width = min(width, len(s))
    if not width:
        return 0.0
    counts: dict[str, int] = {}
    for c in s[:width]:
        counts[c] = counts.get(c, 0) + 1
    total = least = sum(_TERM[n] for n in counts.values())
    for gone, come in zip(s, s[width:], strict=False):
        if gone != come:
            n, m = counts[gone], counts.get(come, 0)
            total += _TERM[n - 1] - _TERM[n] + _TERM[m + 1] - _TERM[m]
            counts[gone], counts[come] = n - 1, m + 1
            least = min(least, total)
    return math.log2(width) - least / width


def is_random(s: str) -> bool:
    """Whether a candidate looks drawn at random and is not on the allow-list."""
    digits, upper, lower = (any(a <= c <= b for c in s) for a, b in ("09", "AZ", "az"))
    if digits + upper + lower < 2 or any(p.fullmatch(s) for p in ALLOWED):
        return False
    name, width, bits = CLASSES[0] if HEXADECIMAL.fullmatch(s) else CLASSES[1]
    if name == "base64" and not digits:
        return False
    need = bits if len(s) >= width else bits * math.log2(len(s)) / math.log2(width)
    return window_entropy(s, width) >= need - 1e-9


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the known forms, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def entropy_spans(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that no known span touches; `known` is sorted by start."""
    out, covered, i = [], 0, 0  # covered: the farthest end of the spans that start before the candidate's end
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while i < len(known) and known[i][0] < b:
            covered = max(covered, known[i][2])
            i += 1
        if covered <= a and is_random(m[0]):
            out.append((a, 3, b))
    return out


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(text: str | None) -> tuple[int, int, int, str, str]:
    text = text or ""
    base = base_spans(text)
    n = [sum(k == i for _, k, _ in base) for i in range(3)]
    return *n, hashlib.sha256(_said(base).encode()).hexdigest(), _said(sorted(base + entropy_spans(text, base)))


SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return common.per_text(docs, scan, ["n_assign", "n_access", "n_hex", "base_sha256", "spans"], SCHEMA, key, text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_texts(common.table(spark, sf_dir, "documents"))
