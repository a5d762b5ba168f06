"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them.

Base spans (e-mail, IP address, card, phone; leftmost, not overlapping within a kind) always stand.
Wider candidates (loose phones, identity numbers, account numbers, secrets, names) get the votes of
five labelers: the kind's strict rules (check digits, valid ranges, known formats), the shape of
the span, a gazetteer (calling codes, issuers, countries, domains, first names), cue words around
it and contrary words around it. Counts of vote patterns over ALL documents, a table whose size the
kinds and votes bound, go through expectation-maximisation (a two-class label model with each
labeler's reliability by kind). Its posteriors are the targets of a logistic span classifier that
sees more than the votes: the span's shape and character trigrams and the words around it, hashed.
It is fitted on a bounded sample (SAMPLE spans of each kind at most, those of least hash) and
decides on all candidates.

Positions are code points. A null text counts as empty and has no spans; repeated rows are judged
alike; an empty table trains nothing and stays empty. Texts are read whole. Further columns are not
read (find_pii) or stay as they are (redact_documents).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone", "idno", "account", "secret", "name")
N_BASE = 4

#: The base patterns. A run can only begin where the character before isn't part of it.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_HAS_DIGIT = re.compile(r"[0-9]")
_LOOSE = (
    ("phone", re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    ("idno", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("account", re.compile(r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|[0-9]{9,19})(?![A-Za-z0-9])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])")),
)
#: Spans of each kind that the classifier is fitted on at most; features for shapes, trigrams and words.
SAMPLE, HASHED = 4000, 2048
_TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Monsieur", "Madame")
_TITLED = re.compile(rf"\b(?:{'|'.join(_TITLES)})\.? ([A-Z][a-z]+(?: [A-Z][a-z]+)?)")
_SIGNED = re.compile(r"\b(?:[Nn]ame|[Aa]uthor|[Ss]igned|[Rr]egards|[Dd]ear)[:,]? {1,2}([A-ZÀ-Þ][^\W\d_]+ [A-ZÀ-Þ][^\W\d_]+)")
_TITLE_BEFORE = re.compile(rf"\b(?:{'|'.join(_TITLES)})\.? $")
_TWO_CAPITALISED = re.compile(r"[A-Z][a-z]{2,} [A-Z][a-z]{2,}")

#: Gazetteers.
FIRST_NAMES = frozenset(
    "James Mary John Robert Michael Linda David William Richard Susan Thomas Sarah Charles Karen Nancy Daniel Matthew Laura Emily Peter Paul Anna Maria Martin Julia Emma Helen Alice George Edward Henry Kevin Brian "
    "Hans Klaus Petra Sabine Jürgen Wolfgang Andreas Stefan Monika Ursula Heike Karin Otto Frieda Lukas Lena Jonas Mia Juan Carlos Carmen José Jose Luis Ana Miguel Javier Lucía Pablo Elena Sofía Diego Rosa "
    "Pierre Jean Marie Claire Sophie Louis Camille Julien Nicolas Antoine François Isabelle Chloé Léa Hugo".split()
)
PUBLIC_DOMAINS = frozenset("com org net edu gov mil int info biz io dev app co ai me tv eu uk de fr es it nl be ch at pt pl cz se no dk fi ie gr ru ua tr us ca mx br ar cl au nz jp cn in kr za".split())
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 234 254 351 352 353 354 358 370 371 372 380 385 386 420 421 852 880 886 966 971 972".split())
ACCOUNT_COUNTRIES = frozenset("AD AE AT BE BG BR CH CY CZ DE DK EE ES FI FR GB GI GR HR HU IE IL IS IT LI LT LU LV MC MT NL NO PL PT QA RO RS SA SE SI SK SM TR UA".split())
_CUES = {
    "email": "mail contact write e-mail correo courriel", "ip": "ip host server address login from logged", "card": "card visa mastercard amex payment karte tarjeta carte", "phone": "phone tel call mobile fax telefon anruf teléfono téléphone",
    "idno": "ssn social security identity id", "account": "account iban konto cuenta compte customer", "secret": "token key secret password passwd api auth bearer credential", "name": "name author contact regards signed dear",
}
_CUE = {k: re.compile("|".join(rf"\b{c}" for c in v.split()), re.I) for k, v in _CUES.items()}
_NOT = re.compile(r"\b(?:version|page|figure|table|chapter|isbn|issn|doi|order|lines?|sha|commit|checksum|license|example|release|section)\b", re.I)
_NOT_AFTER = re.compile(r"\s*(?:street|avenue|road|gmbh|inc|ltd|university|museum|strasse|straße|calle|rue)\b", re.I)
_KNOWN_SECRET = re.compile(r"[0-9a-f]{32,64}|[0-9A-F]{32,64}|gh[a-z]_\w+|AKIA\w+|sk[-_]\w+|xox[a-z]-[\w-]+|eyJ[\w-]+")
_BEFORE, _AFTER = 32, 24
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every address, from its @ outwards: linear even where a run of word characters is very long."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, sorted."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _HAS_DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Loose spans that overlap no base span and, of themselves, the leftmost and then longest."""
    found = []
    if _HAS_DIGIT.search(text):
        for kind, pattern in _LOOSE:
            k = KINDS.index(kind)
            found += [(m.start(), k, m.end()) for m in pattern.finditer(text) if kind != "secret" or (_HAS_DIGIT.search(m[0]) and re.search("[A-Za-z]", m[0]))]
    found += [(m.start(1), 7, m.end(1)) for m in _SIGNED.finditer(text)]
    if any(t in text for t in _TITLES):
        found += [(m.start(1), 7, m.end(1)) for m in _TITLED.finditer(text)]
    for m in _TWO_CAPITALISED.finditer(text):
        if m[0].partition(" ")[0] in FIRST_NAMES and not text[m.start() - 1 : m.start()].isalnum():
            found.append((m.start(), 7, m.end()))
    out, end = [], -1
    i = 0
    for s, k, e in sorted(found, key=lambda x: (x[0], -x[2])):
        while i < len(base) and base[i][2] <= s:
            i += 1
        if s >= end and not any(b[0] < e and s < b[2] for b in base[i : i + 8]):
            out.append((s, k, e))
            end = e
    return out


def _iban(span: str) -> bool:
    """The check digits of an international account number."""
    turned = span[4:] + span[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _strict(span: str, kind: str, text: str, s: int, e: int, before: str) -> int:
    """By the rules that real values keep."""
    digits = "".join(c for c in span if "0" <= c <= "9")
    if kind == "email":
        local, _, domain = span.partition("@")
        return 1 if ".." not in local and local[0] != "." and domain.rpartition(".")[2].isalpha() else -1
    if kind == "ip":
        parts = span.split(".")
        longer = text[s - 1 : s] == "." or (text[e : e + 1] == "." and text[e + 1 : e + 2].isdigit())
        return -1 if longer or any(len(p) > 1 and p[0] == "0" for p in parts) or parts[0] == "0" else 1
    if kind == "card":
        return 1 if re.fullmatch(r"\d{12,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5}", span) else -1
    if kind == "phone":
        return -1 if span.count("(") != span.count(")") or not 9 <= len(digits) <= 15 else 1
    if kind == "idno":
        return -1 if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else 1
    if kind == "account":
        return (1 if _iban(span) else -1) if span[0].isalpha() else 1 if luhn(span) else 0
    if kind == "secret":
        return 1 if _KNOWN_SECRET.fullmatch(span) else 0
    return 1 if _TITLE_BEFORE.search(before) else 0


def _shape(span: str, kind: str) -> int:
    if kind == "secret":  # letters and digits that take turns
        changes = sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:], strict=False))
        return 1 if changes * 4 >= len(span) else -1
    if kind == "name":
        return 1 if " " in span else 0
    if kind == "email":
        return 1 if any(c.isalpha() for c in span.partition("@")[0]) else -1
    if kind == "ip":  # four single digits are more often a version
        return -1 if len(span) == 7 else 1
    return -1 if len({c for c in span if c.isdigit()}) <= 2 else 1


def _gazette(span: str, kind: str) -> int:
    digits = "".join(c for c in span if "0" <= c <= "9")
    if kind == "email":
        return 1 if span.rpartition(".")[2].lower() in PUBLIC_DOMAINS else -1
    if kind == "ip":
        return -1 if span.startswith(("127.", "255.", "224.")) else 0
    if kind == "card":
        return 1 if digits[0] in "34" or "51" <= digits[:2] <= "55" or digits[:2] in ("65", "22", "23", "24", "25", "26", "27") or digits[:4] == "6011" else -1
    if kind == "phone":
        return (1 if any(digits[:k] in CALLING_CODES for k in (1, 2, 3)) else -1) if span[0] == "+" else 1 if digits[0] in "23456789" else -1
    if kind == "account":
        return (1 if span[:2] in ACCOUNT_COUNTRIES else -1) if span[0].isalpha() else 0
    if kind == "secret":  # words between dashes or underscores are an identifier
        words = re.split(r"[_/+-]", span)
        return -1 if len(words) > 2 and sum(w.isalpha() for w in words) * 2 > len(words) else 0
    if kind == "name":
        return 1 if span.split(" ")[0] in FIRST_NAMES else -1
    return 0


def votes(text: str, s: int, k: int, e: int) -> tuple[int, int, int, int, int]:
    """Each labeler's vote, -1, 0 or 1: strict rules, shape, gazetteer, cue words, contrary words."""
    span, kind = text[s:e], KINDS[k]
    before, after = text[max(0, s - _BEFORE) : s], text[e : e + _AFTER]
    against = _NOT.search(before) or (kind == "name" and _NOT_AFTER.match(after))
    return _strict(span, kind, text, s, e, before), _shape(span, kind), _gazette(span, kind), 1 if _CUE[kind].search(before) else 0, -1 if against else 0


def _sketch(span: str) -> str:
    """Letters as a or A, digits as 9, other characters as they are; runs shortened to two."""
    out: list[str] = []
    for c in span:
        x = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        if out[-2:] != [x, x]:
            out.append(x)
    return "".join(out)


def span_features(text: str, s: int, k: int, e: int) -> list[int]:
    """Hashed features of a span: its shape, the trigrams of its shape, and the words around it by side."""
    span = text[s:e]
    shape = _sketch(span[:64])
    near = [f"-{w.lower()}" for w in _WORD.findall(text[max(0, s - _BEFORE) : s])[-3:]] + [f"+{w.lower()}" for w in _WORD.findall(text[e : e + _AFTER])[:2]]
    names = {f"{k}={shape}", *(f"{k}~{shape[i : i + 3]}" for i in range(len(shape) - 2)), *(f"{k}{w}" for w in near), *near}
    return sorted({zlib.crc32(n.encode()) % HASHED for n in names})


def _bucket(s: int, e: int) -> int:
    return min(7, (e - s).bit_length())


def spans_of(text: str) -> tuple[list, list]:
    """(base spans, [(start, kind, end, votes, length bucket)] of all spans that are voted on)."""
    base = base_spans(text)
    spans = base + candidates(text, base)
    return base, [(s, k, e, votes(text, s, k, e), _bucket(s, e)) for s, k, e in spans]


def pattern_counts(docs: DataFrame) -> DataFrame:
    """kind, v0..v4, bucket, n: how often each pattern occurs over all documents."""
    schema = "kind int, v0 int, v1 int, v2 int, v3 int, v4 int, bucket int, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}  # bounded: 8 kinds, 3^5 votes, 8 buckets
        for b in batches:
            for t in b.column(0).to_pylist():
                for _, k, _, v, size in spans_of(t or "")[1]:
                    seen[(k, *v, size)] = seen.get((k, *v, size), 0) + 1
        cols = list(zip(*((*key, n) for key, n in sorted(seen.items())), strict=True)) or [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64() if i == 7 else pa.int32()) for i, c in enumerate(cols)], names=["kind", "v0", "v1", "v2", "v3", "v4", "bucket", "n"])

    part = docs.select(F.col("text").cast("string")).mapInArrow(run, schema)
    return part.groupBy("kind", "v0", "v1", "v2", "v3", "v4", "bucket").agg(F.sum("n").alias("n"))


def label_model(patterns: list[tuple], rounds: int = 50) -> np.ndarray:
    """P(personal) of each pattern: EM over kinds' priors and labelers' vote tables by class.

    Labelers start as better than chance (a vote is right 8 times in 10) and counts are smoothed, so
    that rare kinds fall back on that start.
    """
    kind = np.array([p[0] for p in patterns])
    vote = np.array([p[1:6] for p in patterns]) + 1
    n = np.array([p[7] for p in patterns], dtype=float)
    start = np.array([[0.4, 0.4, 0.2], [0.1, 0.4, 0.5]])  # class x vote
    table = np.tile(start, (len(KINDS), 5, 1, 1))
    prior = np.full(len(KINDS), 0.5)
    strength = 20.0
    for _ in range(rounds):
        logit = np.log(prior[kind]) - np.log1p(-prior[kind])
        for j in range(5):
            logit = logit + np.log(table[kind, j, 1, vote[:, j]]) - np.log(table[kind, j, 0, vote[:, j]])
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        for k in range(len(KINDS)):
            own = kind == k
            total = n[own].sum()
            prior[k] = (p[own] @ n[own] + 0.5 * strength) / (total + strength)
            for c, w in ((1, p), (0, 1 - p)):
                for j in range(5):
                    got = np.bincount(vote[own, j], weights=(w * n)[own], minlength=3) + strength * start[c]
                    if got[2 * c] < got[2 - 2 * c]:  # a labeler isn't taken to be worse than chance
                        got[[0, 2]] = got[[0, 2]].mean()
                    table[k, j, c] = got / got.sum()
    return p


def _features(kind: np.ndarray, vote: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    x = np.zeros((len(kind), len(KINDS) + 10 + 8))
    rows = np.arange(len(kind))
    x[rows, kind] = 1
    for j in range(5):
        x[:, len(KINDS) + 2 * j] = vote[:, j] > 0
        x[:, len(KINDS) + 2 * j + 1] = vote[:, j] < 0
    x[rows, len(KINDS) + 10 + bucket] = 1
    return x


def span_sample(docs: DataFrame, totals: dict[int, int], sample: int = SAMPLE) -> DataFrame:
    """key, kind, v0..v4, bucket, features of about `sample` different candidates of each kind: those
    whose hash lies below a threshold that the kind's number of candidates sets."""
    least = {k: min(1.0, sample / n) for k, n in totals.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(0).to_pylist():
                if not t:
                    continue
                base, voted = spans_of(t)
                for s, k, e, v, size in voted[len(base) :]:
                    around = t[max(0, s - _BEFORE) : e + _AFTER]
                    key = int.from_bytes(hashlib.blake2b(f"{k} {around}".encode(), digest_size=8).digest())
                    if key < least.get(k, 1.0) * 2**64:
                        rows.append((key - 2**63, k, *v, size, span_features(t, s, k, e)))
            cols = list(zip(*rows, strict=True)) or [[]] * 9
            types = (pa.int64(), *[pa.int32()] * 7, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["key", "kind", "v0", "v1", "v2", "v3", "v4", "bucket", "features"])

    part = docs.select(F.col("text").cast("string")).mapInArrow(run, "key long, kind int, v0 int, v1 int, v2 int, v3 int, v4 int, bucket int, features array<int>")
    return part.dropDuplicates(["key"])


def train(patterns: list[tuple], spans: list[tuple] = (), steps: int = 300) -> np.ndarray:
    """Weights of the final classifier: logistic regression on the label model's posteriors, over the
    vote patterns (weighed by the roots of their counts) and over the sampled spans with all features."""
    n_votes = len(KINDS) + 18
    weights = np.zeros(n_votes + HASHED)
    if not patterns:
        return weights
    target = label_model(patterns)
    of = {p[:7]: t for p, t in zip(patterns, target, strict=True)}
    plain = [(*p[:7], ()) for p in patterns] + [(*x[:7], x[7]) for x in spans if tuple(x[:7]) in of]
    y = np.array([of[tuple(p[:7])] for p in plain])
    n = np.concatenate([np.sqrt([p[7] for p in patterns]), np.ones(len(plain) - len(patterns))])
    x = _features(np.array([p[0] for p in plain]), np.array([p[1:6] for p in plain]), np.array([p[6] for p in plain]))
    rows = np.repeat(np.arange(len(plain)), [len(p[7]) for p in plain])
    cols = np.array([f for p in plain for f in p[7]], dtype=np.int64)
    moved = spread = np.zeros(len(weights))
    for step in range(1, steps + 1):
        z = x @ weights[:n_votes] + np.bincount(rows, weights[n_votes + cols], minlength=len(plain))
        r = n * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n.sum()
        grad = np.concatenate([x.T @ r, np.bincount(cols, r[rows], minlength=HASHED)]) + 1e-4 * weights
        moved, spread = 0.9 * moved + 0.1 * grad, 0.99 * spread + 0.01 * grad**2
        weights = weights - 0.05 * (moved / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
    return weights


def fit(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The classifier's weights, from the pattern counts of all documents and a sample of their spans
    (both of bounded size)."""
    rows = sorted(tuple(int(v) for v in r) for r in pattern_counts(docs).collect())
    totals: dict[int, int] = {}
    for r in rows:
        totals[r[0]] = totals.get(r[0], 0) + r[7]
    spans = span_sample(docs, {k: n for k, n in totals.items() if k >= 3}, sample).drop("key").collect() if any(k >= 3 for k in totals) else []
    return train(rows, sorted((*(int(v) for v in r[:7]), tuple(r[7])) for r in spans))


def decide(text: str, weights: np.ndarray) -> tuple[list, list]:
    """(base spans, all spans that stand), each (start, kind number, end), sorted."""
    base, voted = spans_of(text)
    extra = voted[len(base) :]
    if extra:
        n_votes = len(KINDS) + 18
        x = _features(np.array([v[1] for v in extra]), np.array([v[3] for v in extra]), np.array([v[4] for v in extra])) @ weights[:n_votes]
        x += [weights[n_votes + np.array(span_features(text, *v[:3]), dtype=np.int64)].sum() for v in extra]
        extra = [v[:3] for v, keep in zip(extra, x > 0, strict=True) if keep]
    return base, sorted([*base, *extra])


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span, or run of spans that overlap, becomes the first one's kind in brackets."""
    out, done = [], 0
    for s, k, e in spans:
        if s >= done:
            out += [text[done:s], f"[{KINDS[k].upper()}]"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_FOUND = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS[:N_BASE]], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64()), ("redacted", pa.string())])


def find_pii(docs: DataFrame, weights: np.ndarray | None = None, with_text: bool = True) -> DataFrame:
    """doc_id, counts of base spans, base_sha256, spans and their number, and (with_text) the redacted text of each document."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    weights = fit(docs) if weights is None else weights
    names = _FOUND.names if with_text else _FOUND.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                base, spans = decide(t or "", weights)
                n = [sum(k == j for _, k, _ in base) for j in range(N_BASE)]
                rows.append((i, *n, hashlib.sha256(_join(base).encode()).hexdigest(), _join(spans), len(spans), *([redact(t or "", spans)] if with_text else [])))
            cols = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=_FOUND.field(n).type) for n, c in zip(names, cols, strict=True)], names=names)

    ddl = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long" + ", redacted string" * with_text
    return docs.mapInArrow(run, ddl)


def redact_documents(docs: DataFrame) -> DataFrame:
    """The documents, each span of personal data in text replaced and n_chars brought up to date."""
    weights, at = fit(docs), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if t is None else redact(t, decide(t, weights)[1]) for t in b.column(at).to_pylist()]
            yield b.set_column(at, "text", pa.array(texts, type=b.schema.field(at).type))

    out = docs.mapInArrow(run, T.StructType(docs.schema.fields))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
