"""Secret scans: a character convolutional network over every candidate and its surrounding context.

Base findings (assign, access, hex; leftmost, not overlapping within a kind) always stand. Wider
candidates that overlap none of them (key-like tokens, private key blocks, credentials in URLs,
values after other key words) are accepted by the network. It sees the characters of the whole
candidate and BEFORE and AFTER characters around it: embedded, marked by region, convolved, pooled
by region and fed to one hidden layer, all in numpy; candidates of any length go through in pieces.

It is trained on labelled findings (a table of your own, or :func:`generated`: known formats and
their look-alikes, FINDINGS of them, set into windows of at most SNIPPETS texts of the corpus).
A part of them is held out to calibrate the scores (a logistic fit of label on output) and to set
each kind's threshold: 0.5, or the highest that keeps RECALL of its held-out secrets if that is less.

Positions are code points. A null or empty text has no findings; repeated rows are judged alike; an
empty table trains on generated findings alone and stays empty; texts are scanned whole. Further
columns are not read.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "token", "pem", "login", "field")
N_BASE = 3
BEFORE, AFTER = 40, 20
#: Bounds of the training set, and the share of held-out secrets that each kind's threshold keeps.
FINDINGS, SNIPPETS, RECALL = 4200, 200, 0.95

#: The base patterns.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
_KEY_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=.-])(?:eyJ[\w-]+\.[\w-]+\.[\w-]+|[A-Za-z0-9+/_-]{16,}={0,2})(?![A-Za-z0-9+/_=-])", re.A)
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*(?:-----END [A-Z ]*PRIVATE KEY-----)?")
_LOGIN = re.compile(r"://[^\s/:@]+:([^\s/@]+)@")
_FIELD = re.compile(r"""\b(?:pwd|pass(?:word|wd|phrase)?|bearer|credentials?|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key)["']?\s{0,3}(?::|=>?|->|is|was)?\s{0,3}["']?([^\s"'<>,;]{8,})""", re.I | re.A)
_FIELD_WORDS = ("pwd", "pass", "bearer", "credential", "secret", "token", "key")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")

Span = tuple[int, int, int]


def base_findings(text: str) -> list[Span]:
    """(start, kind number, end) of the base kinds, sorted."""
    low = text.lower()
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12] if any(w in low for w in _KEY_WORDS) else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)])


def wider_candidates(text: str, base: list[Span]) -> list[Span]:
    """Spans that overlap no base finding and, of themselves, the leftmost and then longest."""
    found = [(m.start(), 3, m.end()) for m in _TOKEN.finditer(text) if _DIGIT.search(m[0]) and _LETTER.search(m[0])]
    if "PRIVATE KEY-----" in text:
        found += [(m.start(), 4, m.end()) for m in _PEM.finditer(text)]
    if "://" in text:
        found += [(m.start(1), 5, m.end(1)) for m in _LOGIN.finditer(text)]
    low = text.lower()
    if any(w in low for w in _FIELD_WORDS):
        found += [(m.start(1), 6, m.end(1)) for m in _FIELD.finditer(text) if _DIGIT.search(m[1])]
    taken, out, end, i = _merged(base), [], -1, 0
    for s, k, e in sorted(found, key=lambda x: (x[0], -x[2], x[1])):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if s >= end and not (i < len(taken) and taken[i][0] < e):
            out.append((s, k, e))
            end = e
    return out


def _merged(spans: list[Span]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, _, e in spans:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


# The network ---------------------------------------------------------------------------------------

#: Codes: 0 between candidates, 1-95 printable ASCII, 96 line ends, 97 other controls, 98 all else.
_CODES = np.array([97] * 10 + [96] + [97] * 21 + list(range(1, 96)) + [97] + [98], dtype=np.int64)
N_CODES, EMBED, WIDTH, FILTERS, HIDDEN, PIECE = 99, 8, 5, 24, 24, 1 << 16
_HALF = WIDTH // 2


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _CODES[np.minimum(points, 128)]


@dataclass
class Batch:
    """Candidates end to end: codes and regions (0 before, 1 span, 2 after) of all characters; three
    segments a candidate, each with _HALF zeros at the outer side so that none sees its neighbour."""

    codes: np.ndarray
    region: np.ndarray
    starts: np.ndarray
    side: np.ndarray  # kind, and the logarithm of the span's length


def batch_of(found: Iterable[tuple[str, str, str, int]]) -> Batch:
    """From (before, span, after, kind number)."""
    gap, codes, lengths, side = np.zeros(_HALF, dtype=np.int64), [], [], []
    for before, span, after, kind in found:
        parts = [np.concatenate([gap, _codes(before)]), _codes(span), np.concatenate([_codes(after), gap])]
        codes += parts
        lengths += [len(p) for p in parts]
        side.append([float(kind == k) for k in range(len(KINDS))] + [np.log1p(len(span)) / 4])
    sizes = np.array(lengths, dtype=np.int64)
    region = np.repeat(np.tile([0, 1, 2], len(sizes) // 3), sizes)
    return Batch(np.concatenate([*codes, gap[:0]]), region, np.cumsum(sizes) - sizes, np.array(side).reshape(-1, len(KINDS) + 1))


@dataclass
class Network:
    weights: dict[str, np.ndarray]
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: list[float] = field(default_factory=lambda: [0.5] * len(KINDS))

    def _activations(self, codes: np.ndarray, region: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows (with halo given by zeros at the ends of codes) and rectified filters of the inner positions."""
        w = self.weights
        x = np.zeros((len(codes), EMBED + 3))
        x[:, :EMBED] = w["embed"][codes]
        x[np.arange(len(codes)), EMBED + region] = 1
        x[codes == 0] = 0
        n = len(codes) - 2 * _HALF
        windows = np.concatenate([x[k : k + n] for k in range(WIDTH)], axis=1)
        return windows, np.maximum(windows @ w["conv"] + w["conv_bias"], 0)

    def pooled(self, b: Batch) -> np.ndarray:
        """Largest filters of each region and the span's means, piece by piece."""
        n_seg = len(b.starts)
        top, total = np.zeros((n_seg, FILTERS)), np.zeros((n_seg, FILTERS))
        codes, region = np.pad(b.codes, _HALF), np.pad(b.region, _HALF)
        for at in range(0, len(b.codes), PIECE):
            stop = min(len(b.codes), at + PIECE)
            _, h = self._activations(codes[at : stop + 2 * _HALF], region[at : stop + 2 * _HALF])
            first, last = np.searchsorted(b.starts, at, side="right") - 1, np.searchsorted(b.starts, stop)
            cut = np.maximum(b.starts[first:last] - at, 0)
            top[first:last] = np.maximum(top[first:last], np.maximum.reduceat(h, cut))
            total[first:last] += np.add.reduceat(h, cut)
        lengths = np.diff(np.append(b.starts, len(b.codes)))
        return np.concatenate([top.reshape(-1, 3 * FILTERS), (total / lengths[:, None])[1::3]], axis=1)

    def outputs(self, b: Batch) -> np.ndarray:
        if not len(b.starts):
            return np.zeros(0)
        w, x = self.weights, np.concatenate([self.pooled(b), b.side], axis=1)
        return np.maximum(x @ w["hidden"] + w["hidden_bias"], 0) @ w["out"] + w["out_bias"]

    def scores(self, b: Batch) -> np.ndarray:
        """Calibrated probabilities."""
        return _sigmoid(self.scale[0] * self.outputs(b) + self.scale[1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def gradients(net: Network, b: Batch, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean log loss of a batch and its gradient by every weight."""
    w, n = net.weights, len(y)
    codes, region = np.pad(b.codes, _HALF), np.pad(b.region, _HALF)
    windows, h = net._activations(codes, region)
    lengths = np.diff(np.append(b.starts, len(b.codes)))
    seg = np.repeat(np.arange(len(b.starts)), lengths)
    top = np.maximum.reduceat(h, b.starts)
    mean = (np.add.reduceat(h, b.starts) / lengths[:, None])[1::3]
    x = np.concatenate([top.reshape(n, -1), mean, b.side], axis=1)
    hidden = np.maximum(x @ w["hidden"] + w["hidden_bias"], 0)
    p = _sigmoid(hidden @ w["out"] + w["out_bias"])
    loss = -np.mean(np.log(np.where(y > 0, p, 1 - p) + 1e-12))
    dz = (p - y) / n
    dh = np.outer(dz, w["out"]) * (hidden > 0)
    dx = dh @ w["hidden"].T
    dtop = dx[:, : 3 * FILTERS].reshape(-1, FILTERS)
    first = ((h == top[seg]) & (h > 0)).astype(float)  # equal windows share the gradient of their segment's largest
    da = dtop[seg] * first / np.maximum(np.add.reduceat(first, b.starts), 1)[seg]
    inside = b.region == 1
    da[inside] += (dx[:, 3 * FILTERS : 4 * FILTERS] / lengths[1::3, None])[seg[inside] // 3] * (h[inside] > 0)
    dwin = da @ w["conv"].T
    dcodes = np.zeros((len(codes), EMBED))
    for k in range(WIDTH):
        dcodes[k : k + len(b.codes)] += dwin[:, k * (EMBED + 3) : k * (EMBED + 3) + EMBED]
    embed = np.zeros_like(w["embed"])
    np.add.at(embed, codes, dcodes)
    embed[0] = 0
    return loss, {"embed": embed, "conv": windows.T @ da, "conv_bias": da.sum(0), "hidden": x.T @ dh, "hidden_bias": dh.sum(0), "out": hidden.T @ dz, "out_bias": dz.sum()}


def new_network(seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    n_in, n_x = WIDTH * (EMBED + 3), 4 * FILTERS + len(KINDS) + 1
    return Network({
        "embed": rng.normal(0, 0.5, (N_CODES, EMBED)), "conv": rng.normal(0, (2 / n_in) ** 0.5, (n_in, FILTERS)), "conv_bias": np.zeros(FILTERS),
        "hidden": rng.normal(0, (2 / n_x) ** 0.5, (n_x, HIDDEN)), "hidden_bias": np.zeros(HIDDEN), "out": rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), "out_bias": np.zeros(()),
    })


Finding = tuple[str, str, str, int, int]  # before, span, after, kind number, label


def train(findings: list[Finding], epochs: int = 10, rate: float = 4e-3, seed: int = 7, recall: float = RECALL) -> Network:
    """A network fitted on seven tenths of the findings; the rest calibrates it and sets thresholds."""
    rng, order = np.random.default_rng(seed), np.random.default_rng(seed).permutation(len(findings))
    fit, held = order[: len(order) * 7 // 10], order[len(order) * 7 // 10 :]
    net = new_network(seed)
    moved = {k: np.zeros_like(v) for k, v in net.weights.items()}
    spread = {k: np.zeros_like(v) for k, v in net.weights.items()}
    step = 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for at in range(0, len(fit), 64):
            chosen = [findings[i] for i in fit[at : at + 64]]
            _, grad = gradients(net, batch_of(c[:4] for c in chosen), np.array([c[4] for c in chosen], dtype=float))
            step += 1
            for k, g in grad.items():
                g = g + 1e-5 * net.weights[k]
                moved[k], spread[k] = 0.9 * moved[k] + 0.1 * g, 0.999 * spread[k] + 0.001 * g**2
                net.weights[k] = net.weights[k] - rate * (moved[k] / (1 - 0.9**step)) / (np.sqrt(spread[k] / (1 - 0.999**step)) + 1e-8)
    chosen = [findings[i] for i in held]
    calibrate(net, batch_of(c[:4] for c in chosen), np.array([c[3] for c in chosen]), np.array([c[4] for c in chosen]), recall)
    return net


def calibrate(net: Network, held: Batch, kind: np.ndarray, label: np.ndarray, recall: float = RECALL) -> None:
    """Fit scale and shift of the outputs to held-out labels (smoothed, so that none is certain), then
    take for each kind 0.5 or, where that loses too many, the highest threshold that keeps `recall` of its secrets."""
    z = net.outputs(held)
    target = np.where(label > 0, (label.sum() + 1) / (label.sum() + 2), 1 / ((1 - label).sum() + 2))
    ab = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(ab[0] * z + ab[1])
        g = np.array([(p - target) @ z, (p - target).sum()])
        r = p * (1 - p) + 1e-9
        hess = np.array([[r @ (z * z), r @ z], [r @ z, r.sum()]]) + 1e-6 * np.eye(2)
        ab = ab - np.linalg.solve(hess, g)
    net.scale = (float(ab[0]), float(ab[1]))
    p = _sigmoid(ab[0] * z + ab[1])
    for k in range(len(KINDS)):
        own = np.sort(p[(kind == k) & (label > 0)])
        if len(own):
            net.thresholds[k] = min(0.5, float(own[int(np.floor((1 - recall) * len(own)))]))


# Labelled findings ---------------------------------------------------------------------------------

_ALNUM, _B64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
_WORDS = "account alpha array author backup branch build cache channel chapter client cluster common config content counter default delta device document engine error example feature field filter format gateway group handler header image index input item label layer ledger license limit list local main manager market matrix member model module network number object option order output package page panel parent path plan point policy portal price profile project queue range record region release remote report request result return river sample schema screen search section server service session shape signal source stage state status store stream string style system table target task template theme thread title total trace update user value vector version view volume window worker zone".split()
_SECRET_CUE = ("Authorization: Bearer ", "key: ", "export AUTH=", "api key ", "x-api-key: ", "client_id=3&sig=", "credentials ", "auth ", "signing key ", "deploy key: ", "private ", "login with ")
_PLAIN_CUE = ("commit ", "sha1 ", "md5: ", "checksum ", "integrity ", "etag ", "image data:image/png;base64,", "ISBN ", "order no. ", "invoice ", "see /wiki/", "build ", "id ", "version ", "digest ", "file ")


def _random(rng: random.Random, letters: str, low: int, high: int) -> str:
    return "".join(rng.choices(letters, k=rng.randint(low, high)))


def _phrase(rng: random.Random, join: str = " ", low: int = 2, high: int = 4) -> str:
    return join.join(rng.choices(_WORDS, k=rng.randint(low, high)))


def _strong(rng: random.Random) -> str:
    return rng.choice([
        lambda: _random(rng, _ALNUM, 16, 48), lambda: _random(rng, _B64, 24, 64) + rng.choice(["", "=", "=="]), lambda: _random(rng, "0123456789abcdef", 32, 64),
        lambda: _random(rng, string.ascii_letters, 5, 9) + _random(rng, string.digits, 2, 4) + _random(rng, "!#%&*_-+?", 1, 2) + _random(rng, _ALNUM, 3, 9),
    ])()


def _weak(rng: random.Random) -> str:
    """What stands where a secret would, but is none."""
    return rng.choice([
        lambda: _phrase(rng, rng.choice("_-.")) + rng.choice(["", "_1", "_v2", "-2024", "3"]), lambda: "x" * rng.randint(12, 24), lambda: "0" * rng.randint(12, 20), lambda: "your-" + _phrase(rng, "-") + "-1here",
        lambda: "process.env." + _phrase(rng, "_").upper() + "1", lambda: "example" + _random(rng, "123", 5, 9), lambda: "12345678" + "90" * rng.randint(2, 4), lambda: _phrase(rng, "/") + "/v1/" + rng.choice(_WORDS),
    ])()


def _span(rng: random.Random, kind: str, secret: bool) -> tuple[str, str, str]:
    """before, span, after of one finding."""
    cue = rng.choice(_SECRET_CUE if secret else _PLAIN_CUE) if rng.random() < 0.7 else ""
    quote = rng.choice(["", '"', "'"])
    if kind == "assign":
        word = rng.choice(["password", "passwd", "secret", "token", "api_key", "apikey", "API_KEY", "Token", "SECRET"])
        value = _strong(rng) if secret else _weak(rng)
        value = re.sub(r"[^A-Za-z0-9+/_.=-]", "x", value).ljust(12, "7" if secret else "x")
        return "", word + rng.choice(["=", " = ", ": ", ":", '": "', "' : '"]) + rng.choice(["", '"', "'"]) + value, quote
    if kind == "access":
        return cue + quote, "AKIA" + (_random(rng, string.ascii_uppercase + string.digits, 16, 16) if secret else rng.choice(["EXAMPLE" * 3, "X" * 16, "0" * 16, "SAMPLEKEY" * 2, _phrase(rng, "").upper()[:16].ljust(14, "A")])), quote
    if kind == "hex":
        if secret:
            return rng.choice(_SECRET_CUE) + quote, _random(rng, "0123456789abcdef", 32, 64), quote
        return rng.choice([*_PLAIN_CUE, ""]) + quote, rng.choice([lambda: _random(rng, string.digits, 16, 20), lambda: _random(rng, "0123456789abcdef", 32, 64), lambda: rng.choice("0af") * rng.randint(16, 40)])(), quote
    if kind == "token":
        if secret:
            value = rng.choice([
                lambda: rng.choice(["ghp_", "gho_", "glpat-", "sk-", "sk_live_", "rk_live_", "xoxb-", "xoxp-", "AIza", "SG_", "npm_", "hf_"]) + _random(rng, _ALNUM, 20, 44),
                lambda: "eyJ" + _random(rng, _ALNUM, 20, 40) + "." + _random(rng, _ALNUM, 30, 80) + "." + _random(rng, _ALNUM + "-_", 30, 43), lambda: _random(rng, _B64, 24, 64) + rng.choice(["", "=", "=="]), lambda: _random(rng, _ALNUM, 24, 48),
            ])()
            return cue + quote, value if _DIGIT.search(value) else value + "7", quote
        value = rng.choice([
            lambda: "".join(w.title() for w in rng.choices(_WORDS, k=3)) + _random(rng, string.digits, 1, 4), lambda: _phrase(rng, "_", 3, 5) + f"_{rng.randint(1, 999)}", lambda: _phrase(rng, "-", 3, 6) + f"-{rng.randint(1990, 2030)}",
            lambda: _phrase(rng, "/", 3, 5) + f"/{rng.randint(1, 99)}", lambda: _phrase(rng, "_", 3, 4).upper() + f"_{rng.randint(1, 99)}", lambda: "-".join(_random(rng, "0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12)),
            lambda: "/".join([_phrase(rng, "-"), str(rng.randint(2000, 2030)), f"{rng.randint(1, 12):02d}", _phrase(rng, "-")]), lambda: _random(rng, string.digits, 10, 14) + rng.choice(_WORDS) + rng.choice(_WORDS),
        ])().ljust(16, "0")
        if rng.random() < 0.15:
            return rng.choice(["image data:image/png;base64,", "integrity sha512-", "checksum "]), _random(rng, _B64, 40, 120) + "=", quote
        return cue + quote, value, quote
    if kind == "pem":
        name = rng.choice(["RSA ", "EC ", "", "OPENSSH ", "ENCRYPTED "]) + "PRIVATE KEY-----"
        body = "\n".join(_random(rng, _B64, 64, 64) for _ in range(rng.randint(2, 12))) if secret else rng.choice(["...", "(your key here)", "", "<snip>", "xxxx\nxxxx", _phrase(rng)])
        return cue, f"-----BEGIN {name}\n{body}\n" + (f"-----END {name}" if secret or rng.random() < 0.7 else ""), "\n"
    if kind == "login":
        value = _strong(rng) if secret else rng.choice(["password", "pass", "${PASS}", "{password}", "$PW", "xxxx", "PASSWORD", "<secret>", "****", "user"])
        return rng.choice(["postgres", "https", "mysql", "redis", "amqp", "ftp"]) + "://" + rng.choice(_WORDS) + ":", re.sub(r"[\s/@]", "x", value), "@" + _phrase(rng, ".") + rng.choice([".com/", ":5432/db", ".internal"])
    word = rng.choice(["pwd", "pass", "password", "passphrase", "bearer", "credentials", "secret", "token", "api key", "access key", "private key"])
    value = _strong(rng)[:32] if secret else rng.choice([lambda: _weak(rng), lambda: f"{rng.randint(1, 31)}/{rng.randint(1, 12)}/2024", lambda: rng.choice(_WORDS) + f"({rng.randint(0, 9)}).", lambda: _phrase(rng, "-", 2, 3) + "-2"])()
    return word + quote + rng.choice([" is ", ": ", " = ", " ", " -> ", " => ", " was "]), re.sub(r"[\s\"'<>,;]", "x", value).ljust(8, "3"), quote


def generated(snippets: list[str] = (), n: int = FINDINGS, seed: int = 11) -> list[Finding]:
    """n labelled findings, as many secrets as look-alikes of each kind, set into texts or plain phrases."""
    rng, out = random.Random(seed), []
    for i in range(n):
        kind, secret = KINDS[i % len(KINDS)], (i // len(KINDS)) % 2 == 0
        before, span, after = _span(rng, kind, secret)
        around = rng.choice(snippets) if snippets and rng.random() < 0.7 else _phrase(rng, " ", 6, 12)
        cut = rng.randrange(len(around) + 1)
        left, right = (around[:cut] + rng.choice([" ", "\n", ""]) + before)[-BEFORE:] if rng.random() < 0.95 else before, after + rng.choice([" ", "\n", ". ", ""]) + around[cut:]
        out.append((left, span, right[:AFTER], KINDS.index(kind), int(secret)))
    return out


def context_snippets(docs: DataFrame, most: int = SNIPPETS, width: int = 400) -> list[str]:
    """Windows of at most `most` different texts, those of least hash, to set generated findings into."""
    sparse = max(1, docs.count() // (20 * most))
    key, text = F.xxhash64("text"), F.col("text")
    near = docs.where(F.length(text) > 0).withColumn("_key", key).where(F.pmod("_key", F.lit(sparse)) == 0)
    at = F.pmod(F.col("_key"), F.greatest(F.length(text) - width, F.lit(0)) + 1) + 1
    cut = near.select("_key", F.substr(text, at.cast("int"), F.lit(width)).alias("cut")).groupBy("_key").agg(F.min("cut").alias("cut"))
    return [r["cut"] for r in cut.orderBy("_key").limit(most).collect()]


# The scan ------------------------------------------------------------------------------------------


def scan(text: str, net: Network) -> list[tuple[int, int, int, float]]:
    """(start, kind number, end, score) of all findings that stand, sorted."""
    base = base_findings(text)
    spans = base + wider_candidates(text, base)
    if not spans:
        return []
    score = net.scores(batch_of((text[max(0, s - BEFORE) : s], text[s:e], text[e : e + AFTER], k) for s, k, e in spans)).tolist()
    return sorted((*x, p) for i, (x, p) in enumerate(zip(spans, score, strict=True)) if i < len(base) or p >= net.thresholds[x[1]])


def redact(text: str, findings: list[tuple[int, int, int, float]]) -> str:
    """Each finding, or run of findings that overlap, becomes the first one's kind in brackets."""
    out, done = [], 0
    for s, k, e, _ in findings:
        if s >= done:
            out += [text[done:s], f"[{KINDS[k].upper()}]"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def find_secrets(docs: DataFrame, net: Network | None = None, with_text: bool = True) -> DataFrame:
    """doc_id, findings (kind, start, end, score, base; by start and kind) and (with_text) the redacted text of each document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    net = train(generated(context_snippets(docs))) if net is None else net
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            found = [scan(t, net) for t in texts]
            lists = pa.array([[{"kind": KINDS[k], "start": s, "end": e, "score": p, "base": k < N_BASE} for s, k, e, p in f] for f in found], pa.list_(item))
            redacted = [pa.array(map(redact, texts, found), pa.string())] if with_text else []
            yield pa.RecordBatch.from_arrays([b.column(0), lists, *redacted], names=["doc_id", "findings", "redacted"][: 2 + with_text])

    ddl = "doc_id long, findings array<struct<kind: string, start: long, end: long, score: double, base: boolean>>" + ", redacted string" * with_text
    return docs.mapInArrow(run, ddl)
