"""Secrets in texts: known shapes, and strings too random to be words.

Three shapes are looked for as they are written: an assignment to a name such as ``password``, an access key, a run of
hexadecimal digits. Every other candidate is a long run of one character class (:data:`CLASSES`). A window slides over it; the
counts of its characters and the sum of c * log2(c) over them change by the character that comes in and the one that goes out,
so the Shannon entropy of every window costs the same whatever its length. Windows at or over the class's threshold
that hold letters as well as digits join to spans. A span whose candidate the allow-list knows is
suppressed, as is one that lies inside a span found before; the three shapes are never suppressed.

Edge cases: a null or empty text has no spans. Texts are scanned whole, in linear time. Offsets count code points, the end is
exclusive. Repeated rows are scanned one by one, an empty table gives an empty one. Columns of the input stay, except those in
``drop`` and those with the name of a result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from clauseloom.llm.common import beside, fields

#: The shapes (fixed values): kind, pattern, the group whose length counts, and its least length. A run of hexadecimal digits
#: that is too short is left at once; as runs end at the same places, the others stay the same.
SHAPES = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),
)


@dataclass(frozen=True)
class Class:
    """A character class: the run that makes a candidate, the window's length, and the entropy in bits that is too much for words."""

    kind: str
    run: str
    window: int
    bits: float


CLASSES = (
    Class("entropy_hex", r"[0-9A-Fa-f]{20,}", 20, 3.0),
    Class("entropy_alnum", r"[0-9A-Za-z]{20,}", 20, 3.7),
    Class("entropy_base64", r"[0-9A-Za-z+/_=-]{32,}", 32, 4.1),
)

#: Whole candidates that are no secrets: UUIDs, words or numbers joined by marks, and series from the alphabet.
ALLOWED = (
    r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
    r"[/_=+-]*([A-Za-z]+|[0-9]+)([/_=+-]+([A-Za-z]+|[0-9]+))*[/_=+-]*",
    r"(?i:(0123456789)?abcdefghijklmnopqrstuvwxyz(0123456789)?|(0123456789)?abcdef)+[0-9]*",
)

#: Digests of nothing, which stand in many manifests: MD5, SHA-1, SHA-256.
KNOWN = frozenset(hashlib.new(name, b"").hexdigest() for name in ("md5", "sha1", "sha256"))

RESULTS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _weight(count: int) -> float:
    return count * math.log2(count) if count else 0.0


def windows(text: str, size: int) -> Iterator[tuple[float, bool]]:
    """Entropy in bits of each window of ``size`` characters, and whether it holds a letter and a digit."""
    weight = [_weight(c) for c in range(size + 1)]
    counts = Counter(text[:size])
    total, digits = sum(weight[c] for c in counts.values()), sum(c.isdigit() for c in text[:size])
    letters = sum(c.isalpha() for c in text[:size])
    whole = math.log2(size)
    yield whole - total / size, bool(digits and letters)
    for gone, come in zip(text, text[size:]):
        if gone != come:
            n = counts[gone]
            total += weight[n - 1] - weight[n]
            counts[gone] = n - 1
            n = counts[come]
            total += weight[n + 1] - weight[n]
            counts[come] = n + 1
            digits += come.isdigit() - gone.isdigit()
            letters += come.isalpha() - gone.isalpha()
        yield whole - total / size, bool(digits and letters)


def random_spans(text: str, kind: Class, run: re.Pattern) -> Iterator[tuple[str, int, int]]:
    """Candidates of a class with the parts of them whose windows are over the threshold: candidate, start, end."""
    for found in run.finditer(text):
        start, open_at, upto = found.start(), None, -1
        for i, (bits, mixed) in enumerate(windows(found[0], kind.window)):
            # Sums that change step by step drift by less than this.
            if mixed and bits >= kind.bits - 1e-9:
                if open_at is not None and i > upto:
                    yield found[0], start + open_at, start + upto
                    open_at = None
                open_at = i if open_at is None else open_at
                upto = i + kind.window
        if open_at is not None:
            yield found[0], start + open_at, start + upto


class Scanner:
    """Finds the spans of a text; made once per task."""

    def __init__(self, classes: tuple[Class, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED, known: frozenset[str] = KNOWN) -> None:
        self.classes = [(c, re.compile(c.run)) for c in classes]
        self.allowed = [re.compile(a) for a in allowed]
        self.known = known

    def base(self, text: str) -> list[tuple[str, int, int]]:
        """Spans of the three shapes by start, then by kind as listed."""
        found = []
        for order, (kind, pattern, group, least) in enumerate(SHAPES):
            for m in pattern.finditer(text):
                if m.end(group) - m.start(group) >= least:
                    found.append((m.start(), order, kind, m.end()))
        return [(kind, start, end) for start, _, kind, end in sorted(found)]

    def lets_pass(self, candidate: str) -> bool:
        return candidate in self.known or any(a.fullmatch(candidate) for a in self.allowed)

    def more(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Spans of too much entropy outside those found before."""
        taken, added = [(s, e) for _, s, e in base], []
        for kind, run in self.classes:
            found = [(s, e) for candidate, s, e in random_spans(text, kind, run) if not self.lets_pass(candidate)]
            new = outside(found, taken)
            added += [(kind.kind, s, e) for s, e in new]
            taken += new
        return added

    def scan(self, text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        text = text or ""
        base = self.base(text)
        return base, self.more(text, base)


def outside(found: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans of ``found`` that no single span of ``taken`` covers."""
    rest, before, reach, i = [], sorted(taken), -1, 0
    for start, end in sorted(found):
        while i < len(before) and before[i][0] <= start:
            reach = max(reach, before[i][1])
            i += 1
        if end > reach:
            rest.append((start, end))
    return rest


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan(df: DataFrame, text: str, drop: tuple[str, ...] = (), **settings: object) -> DataFrame:
    """``df`` with the counts of the three shapes, the digest of their spans, and all spans. ``settings`` go to :class:`Scanner`."""
    made = [f.split()[0] for f in RESULTS.split(", ")]
    hidden = {*made, *(d.lower() for d in drop)}
    names = [c for c in df.columns if c.lower() not in hidden]
    kinds = [kind for kind, *_ in SHAPES]
    order = {kind: i for i, kind in enumerate([*kinds, *(c.kind for c in settings.get("classes", CLASSES))])}

    def rows(texts: list[str | None], scanner: Scanner) -> dict[str, list]:
        out: dict[str, list] = {name: [] for name in made}
        for one in texts:
            base, more = scanner.scan(one)
            for kind in kinds:
                out[f"n_{kind}"].append(sum(k == kind for k, _, _ in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(sorted([*base, *more], key=lambda s: (s[1], order[s[0]], s[2]))))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(**settings)
        for batch in batches:
            found = rows(batch.column(text).to_pylist(), scanner)
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield beside(batch, names, {name: pa.array(found[name], kind) for name, kind in zip(made, types)})

    return df.mapInArrow(run, ", ".join([*fields(df.select(*names)), RESULTS]))
