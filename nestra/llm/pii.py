"""Personal data: generators propose spans, boosted trees judge them, calibrated thresholds choose.

Base spans are those of exact formats: email, ip, card (with its check digit)
and phone, leftmost and not overlapping within a kind; they always stay. Wider
generators add candidates, also overlapping ones: written-out addresses
(`name (at) host (dot) org`), phone numbers without a plus sign, long addresses
with colons, and secrets (values that are assigned to a name, and long mixed
runs). Trees over the format and the words around give each candidate a
probability; the threshold of each kind is the least from which candidates held
out from training are precise enough. Of added spans that overlap, the likelier
stays; none overlaps a base span.

The trees learn from texts of the corpus, a bounded sample, into which written
forms are put at random places: personal data and secrets, with and without a
word that tells of them, and look-alikes (order numbers, hashes, times, versions,
parts). So the label is what was put in, not the answer of a format's check, which
is no feature either. What such texts hold of themselves has no label and does not
count. A third of the texts is held out for the thresholds.

Cases: a null text is empty and has no span. Empty tables give no rows; with no
text in the corpus the forms stand alone. No pattern backtracks over more than it
consumes, or over 200 characters, so very long texts and runs are safe. Repeated
rows get equal answers. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestra.llm import boosting

KINDS = ("email", "ip", "card", "phone", "secret")
#: Documents into which forms are put to train the trees, as an expected number, and forms in each.
SAMPLE_DOCS, FORMS_EACH = 2000, 8
#: What the added spans of each kind must reach on held-out candidates, how many of these there must be, and the least probability.
PRECISION, LEAST_HELD, LEAST_PROBABILITY = 0.98, 25, 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

_WRITTEN = re.compile(r"\x20?(?:\(at\)|\[at\]|\bat\b)\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\(dot\)|\[dot\]|\bdot\b)\x20?[A-Za-z0-9-]{2,24})+")
_NATIONAL = re.compile(r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])")
_DOUBLE_ZERO = re.compile(r"(?<![0-9])00[1-9][0-9]?[\x20-][0-9\x20-]{6,16}[0-9](?![0-9])")
_GROUPS = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_ASSIGNED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z][A-Za-z0-9_-]{1,40}[\"']?\x20{0,3}[=:]\x20{0,3}[\"']?([A-Za-z0-9_+/.=~!@#$%^&*-]{8,200})(?![A-Za-z0-9_+/.=~!@#$%^&*-])")
_RUN = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,200}(?![A-Za-z0-9_+/=-])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _before(text: str, at: int, floor: int) -> int:
    """The first place from which all up to `at` may be the local part of an address."""
    while at > floor and text[at - 1] in _LOCAL:
        at -= 1
    return at


def _emails(text: str) -> Iterator[tuple[int, int]]:
    floor = 0
    for m in _HOST.finditer(text):
        start = _before(text, m.start(), floor)
        if start < m.start():
            floor = m.end()
            yield start, floor


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _ip_valid(s: str) -> bool:
    return all(len(x) < 4 and int(x or "0") <= 255 for x in (p.lstrip("0") for p in s.split(".")))


def _base(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        for a, b in _emails(text):
            yield "email", a, b
    if not _DIGITS.search(text):
        return
    for m in _IP.finditer(text):
        if _ip_valid(m[0]):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _digits(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                yield "phone", *m.span()


def _wider(text: str) -> Iterator[tuple[str, int, int]]:
    if "dot" in text:
        floor = 0
        for m in _WRITTEN.finditer(text):
            start = _before(text, m.start(), floor)
            if start < m.start():
                floor = m.end()
                yield "email", start, floor
    if ":" in text or "=" in text:
        for m in _GROUPS.finditer(text):
            yield "ip", *m.span()
        for m in _ASSIGNED.finditer(text):
            yield "secret", *m.span(1)
    for m in _RUN.finditer(text):
        if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]):
            yield "secret", *m.span()
    if _DIGITS.search(text):
        for pattern in (_NATIONAL, _DOUBLE_ZERO):
            for m in pattern.finditer(text):
                yield "phone", *m.span()


def proposals(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) of all candidates, each span of a kind once."""
    base = list(_base(text))
    known = set(base)
    return [(*c, True) for c in base] + [(*c, False) for c in dict.fromkeys(_wider(text)) if c not in known]


#: Starts of words that speak of a kind, and of those that speak of something else.
_SPEAKS = {
    "email": ("mail", "e-mail", "email", "contact", "write", "reach"),
    "ip": ("ip", "host", "server", "address", "from", "login", "client"),
    "card": ("card", "visa", "credit", "pay"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "contact", "dial", "text"),
    "secret": ("token", "secret", "key", "password", "passwd", "pwd", "auth", "bearer", "credential", "api"),
}
_SPEAKS_NOT = ("part", "order", "invoice", "version", "serial", "sku", "isbn", "sum", "total", "values", "table", "row", "item", "hash", "sha", "md", "commit", "checksum", "etag", "digest", "uuid", "id", "time", "date", "ratio", "score", "path", "color", "name", "file", "build")
_WORD = re.compile(r"[A-Za-z]+")


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Of the format of a span, and of the 40 characters on each side; no check of a format is among them."""
    span = text[start:end]
    left, right = text[max(0, start - 40) : start], text[end : end + 40]
    digits, short = _digits(span), span[:200]
    near = [w.lower() for w in _WORD.findall(left)[-4:] + _WORD.findall(right)[:2]]
    last = near[len(_WORD.findall(left)[-4:]) - 1] if _WORD.search(left) else ""
    parts = re.findall(r"[0-9]+", span)
    seen = np.unique(list(short), return_counts=True)[1] / max(1, len(short))
    told = lambda words, starts: float(sum(any(w.startswith(s) for s in starts) for w in words))
    return [
        float(KINDS.index(kind)),
        float(min(len(span), 200)),
        float(min(len(digits), 60)),
        float(len(digits) / max(1, len(span))),
        float(sum(not c.isalnum() for c in short)),
        float(span.count(".")),
        float(span.count("-") + span.count(" ")),
        float(span.startswith("00")),
        float("(at)" in span or "[at]" in span),
        float("(dot)" in span or "[dot]" in span),
        float(span.startswith("(")),
        float(span.count(":")),
        float(len(parts)),
        float(max((len(p) for p in parts), default=0)),
        float(10 <= len(digits) <= 15),
        float(-(seen * np.log2(seen)).sum()) if len(short) else 0.0,
        float(any(c.isupper() for c in short)) + float(any(c.islower() for c in short)),
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", short))),
        told(near, _SPEAKS[kind]),
        told([last], _SPEAKS[kind]),
        told(near, _SPEAKS_NOT),
        told([last], _SPEAKS_NOT),
        float(left.rstrip("\"' ")[-1:] in ("=", ":")),
        float(left[-1:] in ("\"", "'")),
        float(left[-1:].isalnum()),
        float(right[:1].isalnum()),
        float(sum(c.isdigit() for c in left + right)),
    ]


def _forms(rng: np.random.Generator) -> tuple[str, str, str, int]:
    """(text before, form, kind, label): personal data or a secret, or what looks like it, as it may be written."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    number = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(3, 9))))
    mixed = lambda letters, low, high: "".join(letters[i] for i in rng.integers(0, len(letters), int(rng.integers(low, high))))
    hexa, full = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    local = pick(word(), f"{word()}.{word()}", f"{word()}{number(2)}")
    at, dot = pick(("(at)", "(dot)"), ("[at]", "[dot]"), ("at", "dot"))
    gap = pick(" ", "") if at != "at" else " "
    phone = pick(f"{number(3)}-{number(3)}-{number(4)}", f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}.{number(3)}.{number(4)}", f"{number(4)} {number(3)} {number(3)}", f"00{pick('44', '49', '33', '1')} {number(3)} {number(6)}")
    groups = ":".join(f"{int(x):x}" for x in rng.integers(1, 65535, 8))
    cut = ":".join(f"{int(x):x}" for x in rng.integers(4096, 65535, 3)) + "::" + f"{int(rng.integers(1, 65535)):x}"
    value = pick(mixed(hexa, 20, 65), mixed(full, 16, 48), mixed(full + "_-", 20, 44), mixed(full + "!#%", 9, 20))
    quote = pick('"', "'", "")
    which = int(rng.integers(12))
    if which == 0:
        return pick("mail me: ", "contact ", "email ", "write to ", "reach us ", ""), f"{local}{gap}{at}{gap}{word()}{gap}{dot}{gap}{pick('com', 'org', 'net', 'de', 'fr')}", "email", 1
    if which == 1:
        return pick("look ", "the ", "we stood "), f"{pick('point', 'stone', word())} at {pick('this', 'every', word())} dot {pick('and', 'then', 'product', word())}", "email", 0
    if which in (2, 3):
        return pick("call ", "phone ", "tel. ", "mobile: ", "fax ", "dial ", "text me on "), phone, "phone", 1
    if which == 4:
        return pick("part ", "order no. ", "invoice ", "serial ", "isbn ", "sku ", "values ", "the sum of "), phone, "phone", 0
    if which == 5:
        return pick("of ", "about ", "with "), f"{number(3)} {number(3)} {number(3)}", "phone", 0
    if which == 6:
        return pick("server ", "host ", "from ", "client ", "address ", "login by ", ""), pick(groups, cut), "ip", 1
    if which == 7:
        return pick("at ", "time ", "ratio ", "lasted ", ""), pick(f"{number(2)}:{number(2)}:{number(2)}", ":".join(number(1) for _ in range(4)), ":".join(number(2) for _ in range(8))), "ip", 0
    if which in (8, 9):
        name = pick("token", "secret", "api_key", "password", "access_key", "auth", "client_secret", "passwd", "API-KEY", "private_key", "apiToken")
        return name + pick(" = ", "=", ": ", ":") + quote, value, "secret", 1
    if which == 10:
        name = pick("hash", "sha1", "md5", "commit", "checksum", "etag", "digest", "uuid", "id", "color", "path", "version", "file", "build", "name")
        return name + pick(" = ", "=", ": ", ":", " ") + quote, pick(mixed(hexa, 32, 65), f"{mixed(hexa, 8, 9)}-{mixed(hexa, 4, 5)}-{mixed(hexa, 4, 5)}-{mixed(hexa, 12, 13)}", f"/usr/{word()}/{word()}/{word()}{number(1)}.so", f"{number(1)}.{number(2)}.{number(1)}-{word()}"), "secret", 0
    return pick("see ", "the ", ""), pick(f"{word()}_{word()}_{word()}_{word()}{number(1)}", f"{word()}-{word()}-{word()}-{word()}-{number(2)}", f"https-{word()}/{word()}/{word()}/{number(4)}"), "secret", 0


def examples(text: str, seed: int, n: int = FORMS_EACH) -> Iterator[tuple[list[float], int]]:
    """(features, label) of candidates that overlap one of n forms put between the words of a text."""
    rng = np.random.default_rng(seed)
    gaps = [m.start() for m in re.finditer(" ", text[:100_000])] or [len(text[:100_000])]
    for _ in range(n):
        before, form, kind, label = _forms(rng)
        at = gaps[int(rng.integers(len(gaps)))]
        close = before[-1:] if before[-1:] in ("\"", "'") else ""
        left, right = text[max(0, at - 200) : at] + " " + before, close + " " + text[at + 1 : at + 200]
        whole = left + form + right
        start, end = len(left), len(left) + len(form)
        for k, a, b, _ in proposals(whole):
            if k == kind and a < end and b > start:
                # A span that takes in more than the form, or less than most of it, is none.
                yield features(whole, k, a, b), int(label and a >= start - 1 and b <= end + 1 and 10 * (min(b, end) - max(a, start)) >= 9 * (end - start))


@dataclass(frozen=True)
class Model:
    trees: boosting.Trees
    thresholds: dict[str, float]


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Trees and thresholds from forms put into about `sample_docs` documents, chosen by a hash of the text."""
    n = docs.count()
    share = min(1.0, sample_docs / max(1, n))
    sample = docs.select("text").where(F.pmod(F.xxhash64("text", F.lit("pii")), F.lit(1 << 20)) < share * (1 << 20)).distinct().select("text", F.pmod(F.xxhash64("text"), F.lit(1 << 31)).alias("seed"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(x, y, seed) for t, seed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x, y in examples(t or "", seed)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.float64())), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], ["x", "y", "seed"])

    rows = sorted((r.seed, tuple(r.x), r.y) for r in sample.mapInArrow(learn, "x array<double>, y int, seed long").collect())
    rows += [(seed, tuple(x), y) for seed in range(max(0, 150 - len({r[0] for r in rows}))) for x, y in examples("", seed)]  # forms alone, where texts are few
    return learned(rows)


def learned(rows: list[tuple]) -> Model:
    """The model of (seed, features, label): seeds that 3 divides are held out."""
    held = np.array([r[0] % 3 == 0 for r in rows])
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)
    trees = boosting.fit(x[~held], y[~held])
    p = trees.probability(x[held])
    own = [(x[held][:, 0] == i) for i in range(len(KINDS))]
    return Model(trees, {k: boosting.calibrated_threshold(p[own[i]], y[held][own[i]], PRECISION, LEAST_HELD, LEAST_PROBABILITY) for i, k in enumerate(KINDS)})


def spans_of(text: str, model: Model) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) of all chosen spans, by start and kind."""
    found = proposals(text)
    base, more = [c for c in found if c[3]], [c[:3] for c in found if not c[3]]
    if more:
        p = model.trees.probability(np.array([features(text, *c) for c in more]))
        chosen = sorted((-q, c) for q, c in zip(p, more, strict=True) if q >= model.thresholds[c[0]])
        # Chosen spans do not overlap one another; base spans may, so their ends are taken as a running maximum.
        taken = _Intervals([(a, b) for _, a, b, _ in base])
        for _, (kind, a, b) in chosen:
            if taken.free(a, b):
                taken.add(a, b)
                base.append((kind, a, b, False))
    return sorted(base, key=lambda s: (s[1], KINDS.index(s[0])))


class _Intervals:
    """Covered stretches, kept sorted and merged."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b) - 1  # the last stretch that starts before b
        return i < 0 or self.ends[i] <= a

    def add(self, a: int, b: int) -> None:
        i = bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def find_pii(docs: DataFrame, model: Model, redact: bool = False) -> DataFrame:
    """(doc_id, spans: array of kind, start, end, base) of (doc_id, text); redact adds `redacted`, the text with [KIND] for spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found, texts = [], []
            for value in batch.column(1):
                text = value.as_py()
                spans = spans_of(text or "", model)
                found.append([dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in spans])
                if redact:
                    texts.append(redacted(text, spans))
            columns = [batch.column(0).cast(pa.int64()), pa.array(found, pa.list_(span))] + ([pa.array(texts, pa.string())] if redact else [])
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "spans", "redacted"][: len(columns)])

    return docs.select("doc_id", "text").mapInArrow(find, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>" + (", redacted string" if redact else ""))


def redacted(text: str | None, spans: list[tuple[str, int, int, bool]]) -> str | None:
    """The text with [KIND] for each span; spans that overlap are one, of the first one's kind."""
    if text is None or not spans:
        return text
    out, at, end = [], 0, -1
    for kind, a, b, _ in spans:
        if a >= end:
            out += [text[at:a], f"[{kind.upper()}]"]
        end = at = max(end, b)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame) -> DataFrame:
    """Documents, all kept and with their columns as they are, but for the text and n_chars after redaction."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))
    names = docs.columns
    at = names.index("text")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redacted(t, spans_of(t or "", shared.value)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns)], names)

    out = docs.mapInArrow(rewrite, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def span_text(spans) -> object:
    """kind:start:end of each span, comma-joined, as a column."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
