"""Personal data by candidate gradient boosting.

Fixed patterns find the base spans of four kinds. Next to them, generators with high recall propose overlapping spans
that the patterns miss or swallow: one number among several in a run, numbers without a plus sign, spelled-out or
defanged addresses. Boosted trees judge each proposal by its format and context, and a threshold for each kind,
calibrated on held-out proposals, selects what is added to the base spans.

Training needs no labels: base spans of a bounded sample of documents are positive, proposals that break a rule of
their kind (check digit, range, length) are negative, and base spans rewritten into the other forms, in their own
context, give positives and negatives of those forms.

Keys, tokens and passwords are a further kind, ``secret``, with generators and trees of its own (``credentials``). It is
redacted like the others and has its own columns, since the spans' text lists the four kinds.

Defined results: null reads as empty; a text without personal data has no spans and the hash of an empty string;
repeated rows get the same result each; positions are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from wakeline.llm import boosting, common, credentials

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Stands after the kinds that ``Model`` judges.
SECRET = len(KINDS)
NAMES = (*KINDS, "secret")
#: Documents that training reads, by a hash of their id.
SAMPLE_DOCS = 6000
#: Held-out precision that a threshold must reach.
PRECISION = 0.98

Span = tuple[int, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_RUN = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]++")
_DIGITS = re.compile(r"[0-9]++")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield EMAIL, start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def chains(text: str) -> Iterator[list[tuple[int, int]]]:
    """Numbers joined by dots, as the ranges of their parts."""
    for m in _CHAIN.finditer(text):
        if "." in m[0]:
            yield [x.span() for x in _DIGITS.finditer(text, m.start(), m.end())]


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by kind, then start."""
    out = list(emails(text)) if "@" in text else []
    for parts in chains(text):
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            if all(e - s < 10 and int(text[s:e]) <= 255 or not text[s:e].lstrip("0") or int(text[s:e].lstrip("0")[:4]) <= 255 for s, e in four):
                out.append((IP, four[0][0], four[3][1]))
    for m in _RUN.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((CARD, *m.span()))
    if "+" in text:
        for m in _PLUS.finditer(text):
            run = m[0].rstrip(" ().-")
            if len(run) >= 4 and 8 <= len(_NOT_DIGIT.sub("", run)) <= 15:
                out.append((PHONE, m.start(), m.start() + len(run)))
    return out


# Generators.

_SPELLED = re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64} ?(?:@|\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}| dot ) ?[A-Za-z0-9-]{1,63}){1,4}", re.I)
_DEFANGED = re.compile(r"(?<![0-9])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)) ?[0-9]{1,3}){3}(?![0-9])", re.I)
_LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:00[1-9][0-9]{0,2}[ .-]?|1[ .-])?\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_TEN = re.compile(r"[0-9]{3}[ .-][0-9]{4}")
#: One of these stands in every text that ``_SPELLED``, or ``_DEFANGED``, matches.
_AT = ("@", "(at)", "[at]", "{at}", " at ")
_DOT = ("dot)", "dot]", "[.]", "(.)")


def proposals(text: str, base: list[Span]) -> list[Span]:
    """Overlapping spans worth judging, base spans left out."""
    found: set[Span] = set()
    for m in _RUN.finditer(text):
        if m.end() - m.start() > 16:
            groups = [x.span() for x in _DIGITS.finditer(text, *m.span())]
            for i, (s, e) in enumerate(groups):
                n = e - s
                for j in range(i, len(groups)):
                    n += groups[j][1] - groups[j][0] if j > i else 0
                    if n > 19:
                        break
                    if n >= 13:
                        found.add((CARD, s, groups[j][1]))
    for parts in chains(text):
        for i in range(len(parts) - 3):
            found.add((IP, parts[i][0], parts[i + 3][1]))
    if "+" in text:
        for m in _PLUS.finditer(text):
            ends = [x.end() for x in _DIGITS.finditer(text, m.start(), m.end())]
            n, at = 0, m.start()
            for e in ends:
                n += len(_NOT_DIGIT.sub("", text[at:e]))
                at = e
                if n > 15:
                    break
                if 7 <= n <= 15:
                    found.add((PHONE, m.start(), e))
    if _TEN.search(text):
        found.update((PHONE, *m.span()) for m in _LOCAL_PHONE.finditer(text))
    low = text.lower()
    if any(x in low for x in _AT):
        found.update((EMAIL, *m.span()) for m in _SPELLED.finditer(text))
    if any(x in low for x in _DOT):
        found.update((IP, *m.span()) for m in _DEFANGED.finditer(text))
    return sorted(found.difference(base))


_HINTS = re.compile(r"mail|contact|card|visa|credit|pan\b|iban|phone|tel\b|call|mobile|fax|ip\b|host|addr|server|konto|tarjeta|carte|correo", re.I)
_CODE = re.compile(r"token|sha|hash|isbn|version|order|invoice|uuid|key", re.I)


def features(text: str, span: Span) -> list[float]:
    """Format and context of a proposal."""
    kind, start, end = span
    body = text[start:end]
    digits = _NOT_DIGIT.sub("", body)
    left, right = text[max(0, start - 24) : start], text[end : end + 24]
    before, after = left[-1:], right[:1]
    groups = [x.end() - x.start() for x in _DIGITS.finditer(body)]
    parts = [int(x[-6:]) for x in _DIGITS.findall(body)]
    return [
        *(float(kind == k) for k in range(4)),
        len(body), len(digits), len(groups), max(groups, default=0), min(groups, default=0),
        float(len(set(groups)) == 1), float(luhn(digits)) if digits else 0.0, float(max(parts, default=0) <= 255),
        float(digits[:1] in "3456" and bool(digits)), len(set(digits)), float(len(set(body) - set("0123456789"))),
        float(body.startswith("+")), body.count("(") + body.count("["), float("@" in body), float(any(x.isalpha() for x in body)), body.count(" "),
        float(before.isalnum()), float(after.isalnum()), float(before in ".-_/:#=+" and bool(before)), float(after in "-_/:#=%" and bool(after)),
        float(after == "." and right[1:2].isdigit()), float(bool(_HINTS.search(left))), float(bool(_CODE.search(left))),
        sum(c.isdigit() for c in left), sum(c.isdigit() for c in right), float(bool(re.search(r"[(\[{](?:at|dot|\.)[)\]}]", body, re.I))), float(bool(re.search(r"(?:\.|dot[)\]}]?) ?(?:com|net|org|edu|gov|io|info|de|fr|es|uk|eu)$", body, re.I))),
    ]


def broken(text: str, span: Span) -> bool:
    """Whether a proposal breaks a rule of its kind, so that it is none."""
    kind, start, end = span
    digits = _NOT_DIGIT.sub("", text[start:end])
    if kind == CARD:
        return len(digits) < 16 or not luhn(digits)
    if kind == IP:
        inner = text[max(0, start - 1)] in "0123456789." and start > 0 or text[end : end + 1] == "." and text[end + 1 : end + 2].isdigit()
        return inner or any(int(x[-6:]) > 255 for x in _DIGITS.findall(text[start:end]))
    if kind == PHONE:
        return len(digits) < 8 or len(digits) > 15
    return False


def rewritten(text: str, span: Span) -> list[tuple[str, Span, bool]]:
    """The same span in the forms that the patterns miss, in its context: a text, the span there, whether it is personal data."""
    kind, start, end = span
    left, body, right = text[max(0, start - 30) : start], text[start:end], text[end : end + 30]
    out = []

    def put(form: str, keep: str | None = None, true: bool = True) -> None:
        keep = keep or form
        at = len(left) + form.index(keep)
        out.append((left + form + right, (kind, at, at + len(keep)), true))

    if kind == EMAIL:
        name, _, domain = body.partition("@")
        for at, dot in ((" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot ")):
            put(name + at + domain.replace(".", dot))
        for at in (" @ ", "@ ", " @", " at "):
            put(name + at + domain)
        for form in ("jane.doe (at) example (dot) com", "info[at]example[dot]org", "maria_lopez at example dot net"):
            put(form)
        for form in ("look at this dot matrix", f"{name} at 7 dot 30", "best at polka dot", "look at this. Then", "arrived at noon. It", f"{name} at home. We", "met at last.next"):
            put(form, true=False)
    elif kind == IP:
        put(body.replace(".", "[.]"))
        put(body + ".7", body, False)
        put("3." + body, body, False)
    elif kind == CARD:
        digits = _NOT_DIGIT.sub("", body)
        put(body + " 4111111111111111", body)
        put("12 " + body, body)
        put(digits[:4] + "-" + digits[4:8] + "-" + digits[8:12] + "-" + digits[12:] + " 15", digits[:4] + "-" + digits[4:8] + "-" + digits[8:12] + "-" + digits[12:])
        wrong = digits[:-1] + str((int(digits[-1]) + 1) % 10)
        put(wrong + " 7", wrong, False)
        put("88 " + wrong, wrong, False)
    else:
        plain = body.lstrip("+")
        put(body + " 190.137.223.204", body)
        put(body + " 2353820953013749", body)
        put(plain)
        digits = _NOT_DIGIT.sub("", body)
        ten = digits[-10:]
        put(f"({ten[:3]}) {ten[3:6]}-{ten[6:]}")
        put(f"{ten[:3]}-{ten[3:6]}-{ten[6:]}")
        put(f"{ten[:3]} {ten[3:6]} {ten[6:]} 88", f"{ten[:3]} {ten[3:6]} {ten[6:]}", False)
        put(body + " 190.137.223.204", body + " 190", False)
    return out


def _examples(texts: list[str]) -> Iterator[tuple[int, int, list[float]]]:
    for text in texts:
        base = base_spans(text)
        for span in base:
            yield span[0], 1, features(text, span)
            for form, at, true in rewritten(text, span):
                if true or at not in base_spans(form):
                    yield span[0], int(true), features(form, at)
        for span in proposals(text, base):
            if broken(text, span):
                yield span[0], 0, features(text, span)


class Model:
    """Trees with calibrated thresholds; without examples of both classes nothing is ever added."""

    def __init__(self, kind: np.ndarray, y: np.ndarray, x: np.ndarray, held: np.ndarray) -> None:
        self.trees = None
        self.threshold = np.full(len(KINDS), np.inf)
        if not len(y) or y.min() == y.max() or held.all() or not held.any():
            return
        self.trees = boosting.fit(x[~held], y[~held])
        margin = self.trees.margin(x[held])
        self.slope, self.intercept = boosting.calibrate(margin, y[held])
        p = self._probability(margin)
        for k in range(len(KINDS)):
            own = kind[held] == k
            order = np.argsort(-p[own], kind="stable")
            if len(order):
                hits = np.cumsum(y[held][own][order]) / np.arange(1, len(order) + 1)
                good = np.flatnonzero(hits >= PRECISION)
                if len(good):
                    self.threshold[k] = max(0.5, p[own][order][good[-1]])

    def _probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * margin + self.intercept)))

    def accepted(self, text: str, spans: list[Span]) -> list[Span]:
        """The likelier of overlapping proposals of a kind, if over the threshold."""
        if not spans or self.trees is None:
            return []
        p = self._probability(self.trees.margin(np.array([features(text, s) for s in spans])))
        out: list[Span] = []
        for i in sorted(range(len(spans)), key=lambda i: (-round(float(p[i]), 9), spans[i][1] - spans[i][2], spans[i])):
            kind, start, end = spans[i]
            if p[i] >= self.threshold[kind] and not broken(text, spans[i]) and all(end <= s or e <= start for k, s, e in out if k == kind):
                out.append(spans[i])
        return out


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fits the trees on the proposals of about ``sample_docs`` documents (all, if fewer), a fifth of them held out."""
    docs = common.keyed(df, id_col, text_col)
    share = min(1 << 30, (sample_docs << 30) // max(1, df.count()))
    chosen = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share).select((F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0).alias("held"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, *row) for h, text in zip(batch.column("held").to_pylist(), common.strings(batch, "text"), strict=True) for row in _examples([text])]
            held, kind, y, x = map(list, zip(*rows, strict=True)) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.bool_()), pa.array(kind, pa.int32()), pa.array(y, pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["held", "kind", "y", "x"])

    got = chosen.mapInArrow(common.settled(run), "held boolean, kind int, y int, x array<double>").toPandas()
    rows = sorted(zip(got["kind"], got["y"], map(tuple, got["x"]), got["held"], strict=True))
    kind, y, x, held = (np.array([r[i] for r in rows]) for i in range(4))
    return Model(kind, y.astype(float), x.reshape(len(rows), -1) if rows else x, held.astype(bool))


def find(model: Model, text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans (the base ones and what the method adds), by kind, then start."""
    base = base_spans(text)
    more = [s for s in proposals(text, base) if all(s[0] != b[0] or s[2] <= b[1] or b[2] <= s[1] for b in base)]
    return base, sorted({*base, *model.accepted(text, more)})


def secrets(model: credentials.Model, text: str) -> list[Span]:
    return [(SECRET, s, e) for s, e in model.find(text)]


def written(spans: list[Span]) -> str:
    return ",".join(f"{NAMES[k]}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[Span]) -> str:
    """Each stretch that spans cover becomes the name of its first kind in brackets."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{NAMES[kind].upper()}]"]
        done = max(done, end)
    return "".join(out) + text[done:]


def detect(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row: doc_id, counts of base spans, the hash of the base spans, all spans, the number added, the number of all,
    the number of secrets, their spans, the number of spans and secrets."""
    rows = common.keyed(df, id_col, text_col)
    schema = StructType([rows.schema["doc_id"]])
    for k in KINDS:
        schema = schema.add(f"n_{k}", LongType())
    schema = schema.add("base_sha256", StringType()).add("spans", StringType()).add("n_added", LongType()).add("n_spans", LongType())
    schema = schema.add("n_secret", LongType()).add("secrets", StringType()).add("n_private", LongType())
    held = df.sparkSession.sparkContext.broadcast((model, credentials.model()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees, keys = held.value
            texts = common.strings(batch, "text")
            both = [find(trees, t) for t in texts]
            opaque = [secrets(keys, t) for t in texts]
            counts = [[sum(s[0] == k for s in base) for base, _ in both] for k in range(4)]
            digest = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in both]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array([written(a) for _, a in both], pa.string()), pa.array([len(a) - len(b) for b, a in both], pa.int64()), pa.array([len(a) for _, a in both], pa.int64()),
                 pa.array([len(x) for x in opaque], pa.int64()), pa.array([written(x) for x in opaque], pa.string()), pa.array([len(a) + len(x) for (_, a), x in zip(both, opaque, strict=True)], pa.int64())],
                schema.names,
            )

    return rows.mapInArrow(common.settled(run), schema)


def redacted(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with the personal data and the secrets in its text replaced; null texts stay null."""
    held = df.sparkSession.sparkContext.broadcast((model, credentials.model()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            trees, keys = held.value
            texts = [t if t is None else redact(t, find(trees, t)[1] + secrets(keys, t)) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, text_col, pa.array(texts, pa.string()))

    return df.mapInArrow(common.settled(run), df.schema)


def op1_candidate_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return detect(docs, train(docs))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redacts personal data and secrets in the text; ``n_chars`` follows the new text. Every document stays."""
    out = redacted(docs, train(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select("doc_id", "text", "lang", "source", "n_chars")
