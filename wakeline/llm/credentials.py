"""Credentials (keys, tokens, passwords) by candidate gradient boosting, as a further kind of personal data.

Generators propose every long opaque run, every value assigned to a name that speaks of a secret, and private key
blocks. Boosted trees judge a proposal by its letters and by what stands before it. No labelled credentials are at hand,
so the trees learn from examples written by a fixed rule: random keys and passwords under telling names or with the
prefixes of well-known issuers, against digests, identifiers, paths, words and placeholders under other names. They
depend on no corpus; the threshold is calibrated on a held-out fifth.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from functools import lru_cache

import numpy as np

from wakeline.llm import boosting

#: Held-out precision that the threshold must reach.
PRECISION = 0.98

_RUN = re.compile(r"[A-Za-z0-9_+/=.-]{16,}+")
_NAME = r"(?:token|secret|passw(?:or)?d|passphrase|pwd|credential|bearer|(?:api|access|private|secret|auth)[ _-]?key)"
_ASSIGNED = re.compile(_NAME + r"\w{0,16}[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"'<>,;]{8,}+)", re.I)
_BLOCK = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?")
#: One of these stands in every text that ``_ASSIGNED`` matches.
_MARKS = ("token", "secret", "passw", "passphrase", "pwd", "credential", "bearer", "key")
_HINT = re.compile(_NAME, re.I)
_OTHER = re.compile(r"sha|md5|hash|digest|commit|etag|checksum|uuid|version|isbn|order|invoice|file|path|href|url", re.I)
_SIGN = re.compile(r"[:=]\s{0,3}[\"']?\Z")
_PREFIX = re.compile(r"sk[-_]|pk[-_]|gh[pousr]_|xox[abprs]-|AKIA|ASIA|AIza|glpat-|eyJ|-----BEGIN")
_UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)
_LETTERS = re.compile(r"[A-Za-z]+")

Range = tuple[int, int]


def proposals(text: str) -> list[Range]:
    """Overlapping stretches worth judging."""
    found: set[Range] = set()
    for m in _RUN.finditer(text):
        body = m[0].rstrip(".")
        if len(body) >= 16 and not body.isalpha() and any(c.isalpha() for c in body):
            found.add((m.start(), m.start() + len(body)))
    low = text.lower()
    if any(x in low for x in _MARKS):
        found.update(m.span(1) for m in _ASSIGNED.finditer(text))
    if "-----BEGIN " in text:
        found.update(m.span() for m in _BLOCK.finditer(text))
    return sorted(found)


def features(text: str, start: int, end: int) -> list[float]:
    """Letters and context of a proposal."""
    body, left = text[start:end], text[max(0, start - 32) : start]
    n = len(body)
    counts = Counter(body)
    words = [len(x) for x in _LETTERS.findall(body)]
    kinds = [sum(c.isdigit() for c in body), sum(c.islower() for c in body), sum(c.isupper() for c in body)]
    return [
        float(n), len(counts), -sum(c / n * math.log2(c / n) for c in counts.values()), *(k / n for k in kinds), 1 - sum(kinds) / n,
        float(sum(k > 0 for k in kinds)), sum(body[i].isdigit() != body[i + 1].isdigit() for i in range(n - 1)) / n,
        float(set(body) <= set(string.hexdigits)), float(max(words, default=0)), float(bool(_HINT.search(left))), float(bool(_OTHER.search(left))),
        float(bool(_SIGN.search(left))), float(left[-1:] in "\"'" and bool(left)), float(bool(_PREFIX.match(body))), float(bool(_UUID.fullmatch(body))),
        float(body.count("/")), float(body.count(".")), float(body.count("_") + body.count("-")), float("@" in body),
    ]


def examples(n: int = 120, seed: int = 1) -> list[tuple[str, int, int, bool]]:
    """Texts, a stretch in each, and whether it is a credential."""
    draw = random.Random(seed)
    letters = string.ascii_letters + string.digits
    some = lambda among, *sizes: "".join(draw.choices(among, k=draw.choice(sizes)))
    word = lambda: some("etaoinshrdlu", 2, 3, 5, 7, 9)
    out = []

    def put(name: str, body: str, true: bool) -> None:
        sign, quote = draw.choice((" = ", "=", ": ", ":", " ")), draw.choice(("", '"', "'"))
        if true and name and sign == " ":
            sign = " = "
        left = f"{word()} {word()} {name}{sign if name else ''}{quote}"
        out.append((f"{left}{body}{quote} {word()}", len(left), len(left) + len(body), true))

    for _ in range(n):
        told = draw.choice(("token", "api_key", "API-KEY", "secret", "client_secret", "password", "passwd", "access_key", "auth_token", "Bearer token", "aws_secret_access_key"))
        other = draw.choice(("sha256", "commit", "md5", "etag", "checksum", "digest", "id", "file", "path", "version", "name", "see", "", "url", "order", "invoice"))
        hexes, mixed = some("0123456789abcdef", 24, 32, 40, 64), some(letters, 20, 24, 32, 43, 64)
        put(told, hexes, True)
        put(told, mixed, True)
        put(told, some(letters + "+/", 27, 40, 43, 86) + draw.choice(("", "=", "==")), True)
        put(told, some(letters + "!#$%&*+-", 10, 12, 14, 18), True)
        put(draw.choice((told, other)), draw.choice(("sk-", "sk_live_", "ghp_", "xoxb-", "AKIA", "glpat-", "AIza")) + some(letters, 20, 24, 36), True)
        put(draw.choice((told, other)), f"eyJ{some(letters, 17, 33)}.eyJ{some(letters, 40, 60)}.{some(letters + '_-', 43)}", True)
        put(other, hexes, False)
        put(other, draw.choice((mixed, some(string.digits, 16, 20) + word())), False)
        put(draw.choice((other, told)), "-".join(some("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)), False)
        put(other, "/".join((word(), word(), word(), word() + some(string.digits, 1, 2))), False)
        put(other, f"{word()}_{word()}-{word()}_{word()}{some(string.digits, 1, 4)}", False)
        put(other, f"{word()}.{some(string.digits, 2)}@mail.{word()}.com", False)
        put(told, draw.choice((word() + word() + word(), "xxxxxxxxxxxx", "************", "<redacted>", "example-value", f"os.environ.{word()}{word()}", f"get_{word()}_{word()}()", "12345678", "----------")), False)
        put(other, draw.choice(("----------------a", "====================b1", f"{word()}{word()}{word()}2", f"{word()}-{word()}-{word()}-{word()}-1")), False)
    return out


class Model:
    """Trees with a calibrated threshold."""

    def __init__(self) -> None:
        rows = examples()
        x, y = np.array([features(t, s, e) for t, s, e, _ in rows]), np.array([float(true) for *_, true in rows])
        held = np.arange(len(rows)) // 14 % 5 == 0
        self.trees = boosting.fit(x[~held], y[~held])
        margin = self.trees.margin(x[held])
        self.slope, self.intercept = boosting.calibrate(margin, y[held])
        p = self._probability(margin)
        order = np.argsort(-p, kind="stable")
        good = np.flatnonzero(np.cumsum(y[held][order]) / np.arange(1, len(order) + 1) >= PRECISION)
        self.threshold = max(0.5, p[order][good[-1]]) if len(good) else np.inf

    def _probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * margin + self.intercept)))

    def find(self, text: str) -> list[Range]:
        """The likelier of overlapping proposals, if over the threshold, by start."""
        spans = proposals(text)
        if not spans:
            return []
        p = self._probability(self.trees.margin(np.array([features(text, *s) for s in spans])))
        out: list[Range] = []
        end_of = -1
        groups: list[list[int]] = []
        for i, (start, end) in enumerate(spans):
            if start >= end_of:
                groups.append([])
            groups[-1].append(i)
            end_of = max(end_of, end)
        for group in groups:
            held: list[Range] = []
            for i in sorted(group, key=lambda i: (-round(float(p[i]), 9), spans[i][0] - spans[i][1], spans[i])):
                if p[i] >= self.threshold and all(spans[i][1] <= s or e <= spans[i][0] for s, e in held):
                    held.append(spans[i])
            out += sorted(held)
        return out


@lru_cache(1)
def model() -> Model:
    """The same trees wherever they are fitted."""
    return Model()
