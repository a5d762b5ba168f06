"""Pieces, personal data, decontamination, near duplicates, repeated passages, the pipeline."""

import hashlib
import itertools
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from curvecast.llm import common, decontaminate, jaccard, pieces, pii, quality, run_index
from tests.llm.test_small_operators import plain_quality

ODD = [None, "", " ", "  a  b\n\n c\t", "▁x▁ y", "日本語 テスト 🙂", "a" * 1000, "\n", "é" * 70 + " ö"]


def frame(spark, texts, ids=None):
    rows = list(zip(ids or range(len(texts)), texts, strict=True))
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS node", "3 AS pieces", "4 AS spans")


# Pieces


def test_pieces_are_lossless_and_reproducible(spark):
    df = frame(spark, ODD + ODD, [1] * len(ODD) + [None] * len(ODD))
    enc = pieces.encode_documents(df)
    rows = enc.collect()
    assert all(r["lossless"] for r in rows) and len(rows) == 2 * len(ODD)
    assert sorted(map(repr, rows)) == sorted(map(repr, pieces.encode_documents(df.repartition(3)).collect()))
    assert Counter(r["text"] for r in pieces.decode_documents(enc).collect()) == Counter((t or "") for t in ODD + ODD)
    assert pieces.encode_documents(df.where("false")).count() == 0


def test_pieces_follow_the_lattice_distribution():
    p = pieces.pieces_at(pieces.MODEL, 1.0)
    n = 40_000
    ids, count = pieces.encode(["there"] * n, np.arange(n), p)
    ends = np.cumsum(count)
    seen = Counter(tuple(ids[e - c : e].tolist()) for e, c in zip(ends.tolist(), count.tolist(), strict=True))
    vocab = {b: i for i, b in enumerate(p.bytes) if p.weights[i] > 0}

    def paths(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if s[:k].encode() in vocab:
                yield from ((vocab[s[:k].encode()], *rest) for rest in paths(s[k:]))

    every = list(paths(" there"))
    w = np.array([np.prod([p.weights[i] for i in path]) for path in every])
    assert max(abs(seen[path] / n - x) for path, x in zip(every, w / w.sum(), strict=True)) < 0.01


def test_texts_without_spaces_form_one_lattice(monkeypatch):
    p = pieces.pieces_at(pieces.MODEL, 1.0)
    text = "x" * 61 + "the" + "y" * 61 + "there" + "z" * 200  # pieces lie over every border of 64 code points
    ids, count = pieces.encode([text] * 2000, np.arange(2000), p)
    ends = np.cumsum(count)
    spans = Counter()
    for e, n in zip(ends.tolist(), count.tolist(), strict=True):
        at = 0
        for i in ids[e - n : e].tolist():
            spans[(at, at + len(p.bytes[i]))] += 1
            at += len(p.bytes[i])
    assert any(a < 64 < b for a, b in spans) and any(a < 128 < b for a, b in spans)
    rng = random.Random(2)
    odd = "".join(rng.choice("theringandof日本語のテスト") for _ in range(3000))
    whole = pieces.encode([odd, "a b " + odd, "x" * 900], np.array([3, 4, 5]), p)
    monkeypatch.setattr(pieces, "LONG", 100)
    for block in (64, 1000):
        monkeypatch.setattr(pieces, "BLOCK", block)
        parts = pieces.encode([odd, "a b " + odd, "x" * 900], np.array([3, 4, 5]), p)
        assert (whole[1] == parts[1]).all() and (whole[0] == parts[0]).all()


def test_long_texts_cut_into_segments(monkeypatch):
    p = pieces.pieces_at(pieces.MODEL, 1.0)
    text = " ".join(random.Random(1).choice(["alpha", "beta", "gamma"]) for _ in range(500))
    whole = pieces.encode([text, "x"], np.array([3, 4]), p)
    monkeypatch.setattr(pieces, "SEGMENT", 100)
    parts = pieces.encode([text, "x"], np.array([3, 4]), p)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


# Personal data

_E = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_I = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_C = re.compile(r"[0-9]([\x20-]?[0-9])+")
_P = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    digits = lambda s: "".join(c for c in s if c.isdigit())
    out = [(m.start(), 0, m.end()) for m in _E.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in _I.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in _C.finditer(t) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in _P.finditer(t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_base_spans_equal_plain_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice("a@b.c1234 -+()_%é4") for _ in range(rng.randrange(60)))
        assert pii.base_spans(t) == plain_spans(t)
    assert [pii.luhn(x) for x in ("4111111111111111", "4111111111111112")] == [True, False]


PII = [
    "write to ann@mail.example.com or call +1 (017) 555-7713 now",
    "server ip 10.0.0.1 and card 4111 1111 1111 1111.",
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"',
    "plain words only", "", None, "Dear Mr. John Smith, version 1.2.3.400", "call 017-555-7713 please",
]


def test_pii_rows(spark):
    df = frame(spark, PII * 3)
    rows = {r["doc_id"]: r for r in pii.find_pii(df).collect()}
    assert len(rows) == 3 * len(PII)
    for i, r in rows.items():
        t = PII[i % len(PII)] or ""
        base = plain_spans(t)
        said = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS[:4]] == [sum(b[1] == j for b in base) for j in range(4)]
        assert set(said.split(",")) <= set(r["spans"].split(",")) | {""}
        assert r["redacted"] == rows[i % len(PII)]["redacted"]
    assert "secret" in rows[2]["spans"] and rows[3]["spans"] == ""
    assert rows[0]["redacted"] == "write to [EMAIL] or call [PHONE] now"
    assert pii.find_pii(df.where("false")).count() == 0


@pytest.mark.parametrize("size", [19, 20, 128, 129, 1000])
def test_long_tokens_are_secret_candidates(size):
    rng = random.Random(size)
    token = "".join(rng.choice("abcXYZ0189_-") for _ in range(size))
    secret = dict(pii._LOOSE)["secret"]
    assert [m.span() for m in secret.finditer(f"key: {token} end")] == ([(5, 5 + size)] if size >= 20 else [])


def test_label_model_recovers_reliabilities():
    rng = random.Random(5)
    counts = Counter()
    for _ in range(4000):
        y = rng.random() < 0.5
        v = tuple((1 if (rng.random() < good) == y else -1) for good in (0.95, 0.9, 0.85, 0.6, 0.9))
        counts[(4, *v, 3, y)] += 1
    patterns = sorted({k[:7] for k in counts})
    rows = [(*p, counts[(*p, True)] + counts[(*p, False)]) for p in patterns]
    post = pii.label_model(rows)
    right = sum(counts[(*p, True)] if x > 0.5 else counts[(*p, False)] for p, x in zip(patterns, post, strict=True))
    assert right / 4000 > 0.95


def planted(rng, n):
    """Sentences with (kind, value) of what is personal in them; half of the look-alikes are not."""
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: rng.choice("river market paper garden window summer letter bread music winter".split())
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))

    def iban():
        body = digits(18)
        return f"DE{98 - int(body + '131400') % 97:02d}{body}"

    makers = [
        lambda: (f"my social security number is {rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", "idno"),
        lambda: (f"please pay to account {iban()}", "account"),
        lambda: (f"api token = {hexes(40)}", "secret"),
        lambda: (f"the secret key was {hexes(36)}", "secret"),
        lambda: (f"it was signed by Dr. {rng.choice(sorted(pii.FIRST_NAMES))} {word().capitalize()}", "name"),
        lambda: (f"call {rng.randint(201, 989)}-{rng.randint(200, 999)}-{digits(4)} tonight", "phone"),
        lambda: (f"see order {digits(10)} of the catalogue", None),
        lambda: (f"the function {word()}_{word()}_{word()}_{word()}2 was renamed", None),
        lambda: (f"chapter 000-00-0000 of the table", None),
        lambda: (f"on page {word().capitalize()} {word().capitalize()} you read more", None),
        lambda: (f"the commit checksum AB12{digits(11)} in release notes", None),
    ]
    return [rng.choice(makers)() for _ in range(n)]


def test_pii_precision_and_recall_by_kind(spark):
    rng = random.Random(8)
    train = planted(rng, 1500)
    weights = pii.fit(frame(spark, [f"We walked on. So {t}. And more." for t, _ in train]))
    right, found, wanted = Counter(), Counter(), Counter()
    for text, kind in planted(random.Random(99), 1500):
        base, spans = pii.decide(f"It rained today. Now {text}; then home.", weights)
        kinds = {pii.KINDS[k] for s, k, e in spans if (s, k, e) not in base}
        wanted.update([kind] * (kind is not None))
        found.update(kinds)
        right.update(kinds & {kind})
    for kind in ("idno", "account", "secret", "name", "phone"):
        assert right[kind] >= 0.9 * wanted[kind] and right[kind] >= 0.9 * found[kind], (kind, right[kind], found[kind], wanted[kind])


# Decontamination

ITEM = "A train leaves Boston at 9 and covers 120 km in 3 hours before Anna meets it near the old stone bridge by noon"


def test_templates(spark):
    bench = spark.createDataFrame([(7, ITEM), (8, "too short"), (9, None), (10, "one two three four five six")], "item_id long, text string")
    other = ITEM.replace("Boston", "Denver").replace("120", "95").replace("3 hours", "2 days").replace("Anna", "Maria")
    twisted = ITEM.replace("9", "120")  # two slots with one value against two values: no consistent mapping
    clean = "the quick brown fox jumps over the lazy dog and then sleeps for a long while in the warm sun of the yard"
    texts = [f"some words here. {ITEM}. the end", other.upper().lower() and f"intro text\n{other} and more", clean, "", None, ITEM, ITEM, "x one two three four five six y", twisted]
    df = frame(spark, texts)
    rows = decontaminate.find_leaks(df, bench).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert {(0, 7), (1, 7), (5, 7), (6, 7), (7, 10)} <= got and not {i for i, _ in got} & {2, 3, 4, 8}
    assert {r["doc_id"]: r["same_slots"] for r in rows}[1] is False and {r["doc_id"]: r["same_slots"] for r in rows}[0] is True
    kept = decontaminate.drop_leaks(df, bench)
    assert kept.schema == df.schema and {r["doc_id"] for r in kept.collect()} == {2, 3, 4, 8}
    assert decontaminate.find_leaks(df, bench.where("false")).count() == 0
    assert decontaminate.find_leaks(df.where("false"), bench).count() == 0


def test_items_short_of_literals_leak_verbatim_only(spark):
    items = ["Compute 12 + 30 - 5 * 7", "Anna Bob Carla David Emil Frida Gustav Hanna Ivan", "3 kg 4 m 5 s 6 km 7 g 8 mm", f"9 8 7 6 5 4 3 2 1 0 11 22 33 44 55 66 77 88 99 {ITEM}"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [f"some words here {t} and so on" for t in items]
    texts += ["some words: Compute 12 + 30 - 5 * 8", "We met Anna Bob Carla David Otto Frida Gustav Hanna Ivan", "take 3 kg 4 m 5 s 1 km 7 g 8 mm", "9 8 7 6 5 4 3 2 1 0 11 22", ITEM]
    texts += [items[3][:55].upper(), items[3].replace("Boston", "Denver")]
    rows = decontaminate.find_leaks(frame(spark, texts), bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [(0, 0), (1, 1), (2, 2), (3, 3), (8, 3), (10, 3)]
    assert all(r["n_matched"] <= r["n_windows"] for r in rows)
    assert {r["doc_id"] for r in decontaminate.drop_leaks(frame(spark, texts), bench).collect()} == {4, 5, 6, 7, 9}


def plain_tokens(text):
    """(symbol, slot value or None) of each token, read plainly."""
    out, end, raw = [], 0, text
    for m in re.finditer(r"[^ \t\n\v\f\r]+", raw):
        core = re.search(r"[0-9A-Za-z\u0080-\U0010ffff](?:.*[0-9A-Za-z\u0080-\U0010ffff])?", m[0], re.S)
        if not core:
            continue
        w, first = core[0], m.start() + core.start()
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
        begins = not out or any(c in ".!?\n" for c in raw[end:first])
        letters = [c for c in w if c.isalpha() or ord(c) > 127]
        if w[0] in "0123456789":
            out.append(("NUM" if not letters else "QTY", low))
        elif out and out[-1][0] == "NUM" and not begins and low in decontaminate.UNITS:
            out.append(("UNIT", low))
        elif "A" <= w[0] <= "Z" and sum("A" <= c <= "Z" for c in w) == 1 and len(w) > 1 and not begins:
            out.append(("NAME", low))
        else:
            out.append((low, None))
        end = first + len(w)
    return out


def plain_leaks(text, item):
    """(matched, windows) by comparing all windows of both as tuples."""
    a, b = plain_tokens(item), plain_tokens(text or "")
    if len(a) < 5:
        return None
    size = min(8, len(a))
    view = lambda t, i: [x[0] for x in t[i : i + size]] if sum(x[1] is None for x in t[i : i + size]) >= min(4, size - 1) else [(x[1] or x[0], "exact") for x in t[i : i + size]]
    ok = [sum(x[1] is None for x in a[i : i + size]) >= min(4, size - 1) for i in range(len(a) - size + 1)]
    hits = [(i, j) for i in range(len(a) - size + 1) for j in range(len(b) - size + 1) if view(a, i) == view(b, j)]
    sets, verbatim = [], {i for i, _ in hits if not ok[i]}
    shifts = Counter(j - i for i, j in hits)
    for shift, _ in sorted(shifts.items(), key=lambda x: (-x[1], x[0])):
        own = {i for i, j in hits if j - i == shift and ok[i]}
        pairs = {(a[k][1], b[k + shift][1]) for i in own for k in range(i, i + size) if a[k][1]}
        one_to_one = lambda p: len({x for x, _ in p}) == len(p) == len({y for _, y in p})
        if not own or not one_to_one(pairs):
            continue
        home = next((s for s in sets if one_to_one(s[0] | pairs)), None) if len(own) < 0.5 * sum(ok) else None
        if home:
            home[0].update(pairs)
            home[1].update(own)
        else:
            sets.append((pairs, own))
    covered = max((s[1] for s in sets), key=len, default=set())
    if covered and len(covered) >= 0.5 * sum(ok):
        return len(covered), sum(ok)
    return (len(covered) + len(verbatim), len(ok)) if hits and len(covered) + len(verbatim) >= 0.5 * len(ok) else None


def test_leaks_equal_brute_force(spark):
    rng = random.Random(12)
    words = "the a of old river bridge town stands near where people walk Anna Bob Carla 3 7 12 120 km kg hours. 5km naïve, (so) - ITEMS said; Öl".split()
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [say(rng.randint(3, 30)) for _ in range(25)] + [ITEM, "", None]
    items += [items[0], items[0]]
    texts = ["", None, "a\nb"]
    for _ in range(150):
        w = rng.choice(items[:26]).split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        cut = rng.randrange(len(w)) if rng.random() < 0.4 else len(w)
        texts.append(" ".join([say(rng.randrange(9)), *w[:cut], say(rng.randrange(3)), *w[cut:], say(rng.randrange(9)), *(w[: rng.randrange(len(w))] if rng.random() < 0.3 else [])]))
    texts += texts[:10] + [" ".join([ITEM] * 200)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").selectExpr("*", "1 AS th", "2 AS h")
    got = Counter((r["doc_id"], r["item_id"], r["n_matched"], r["n_windows"]) for r in decontaminate.find_leaks(frame(spark, texts), bench).collect())
    want = Counter((d, i, *x) for d, t in enumerate(texts) for i, item in enumerate(items) if (x := plain_leaks(t, item or "")))
    assert got == want and len(want) > 50
    assert {r["item_id"] for r in decontaminate.short_items(bench).collect()} == {i for i, t in enumerate(items) if len(plain_tokens(t or "")) < 5}


def test_long_periodic_texts_and_items(spark):
    """Neither rows nor work grow with the product of the two lengths; other numbers in each period included."""
    line = "the old river bridge stands near a small town where people walk at noon "
    table = lambda n, k: " ".join(f"the old river bridge stands near a small town with {i % k} people" for i in range(n))
    bench = spark.createDataFrame([(1, line * 120), (2, table(120, 7)), (3, "one more item of no text at all here")], "item_id long, text string")
    texts = [line * 14_000, table(14_000, 7), table(4_000, 4_001), line * 50, "nothing of the kind"]
    began = time.time()
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(frame(spark, texts), bench).collect()}
    assert {(0, 1), (1, 2), (3, 1)} <= got and not {d for d, _ in got} & {4} and 3 not in {i for _, i in got}
    assert time.time() - began < 120


def test_copies_with_other_numbers_do_not_lend_windows(spark):
    item = "one old train leaves the station with 40 guests and then comes back again with 40 guests before the night falls on us"
    first, second = item.replace("40", "50").split(), item.replace("40", "60").split()
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [" ".join(first[:12]) + " xx yy zz " + " ".join(second[12:]), " ".join(first[:12]) + " xx yy zz " + " ".join(first[12:])]
    assert {r["doc_id"] for r in decontaminate.find_leaks(frame(spark, texts), bench).collect()} == {i for i, t in enumerate(texts) if plain_leaks(t, item)}


# Near duplicates


def shingles(t):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_classes(texts, ids):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    out = []
    for i in range(len(texts)):
        own = [ids[j] for j in range(len(texts)) if root(j) == root(i) and ids[j] is not None]
        out.append((ids[i], len(sets[i]), (min(own) if own else None) if sets[i] else ids[i]))
    return Counter(out)


def corpus(seed=1, n=90):
    rng = random.Random(seed)
    say = lambda k: [f"w{rng.randrange(300)}" for _ in range(k)]
    bases, passage = [say(rng.randint(5, 90)) for _ in range(6)], say(40)
    out = []
    for _ in range(n):
        w = list(rng.choice(bases)) if rng.random() < 0.7 else say(rng.randint(0, 60))
        for _ in range(rng.randint(0, 4)):
            if w:
                w[rng.randrange(len(w))] = f"w{rng.randrange(300)}"
        if rng.random() < 0.3:
            w = passage + w[: rng.randrange(20)]
        out.append(" ".join(w).upper() if rng.random() < 0.1 else " ".join(w))
    return out + ["", None, " \n", "one", "ONE", "one two", out[0], out[0]]


@pytest.mark.parametrize("small, unit, salted, block", [(8, 1 << 24, 5000, 2000), (2, 1 << 24, 5000, 1 << 12), (2, 1500, 3, 1 << 12)])
def test_classes_equal_all_pairs(spark, monkeypatch, small, unit, salted, block):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "UNIT_BYTES", unit)
    monkeypatch.setattr(jaccard, "SALTED", salted)
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", block)
    texts = corpus(small)
    ids = [None if i == 5 else i // 2 if i < 6 else i for i in range(len(texts))]
    got = jaccard.classes(frame(spark, texts, ids).repartition(3)).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == plain_classes(texts, ids)


def test_keep_one(spark):
    texts = ["a b c d e f g h i j", "A b c d e f g h i j", "x y z", "x y z", "", None, "q r"]
    df = frame(spark, texts)
    assert {r["doc_id"] for r in jaccard.keep_one(df).collect()} == {0, 2, 4, 5, 6}
    assert jaccard.keep_one(df.where("false")).count() == 0


def test_error_bounds_equal_brute_force(spark):
    sizes = range(1, 300)
    for n in sizes:
        for band, d in jaccard.bands(n):
            partners = [b for b in range(1, 2 * n) if 75 * max(n, b) <= 100 * min(n, b) and max(jaccard.band_of(n), jaccard.band_of(b)) == band]
            assert d >= max(jaccard.most_errors(n, b) for b in partners)
    # 14 members with 12 in common differ by 4; such a document is thin when but 4 of its parts are in small groups.
    large = spark.createDataFrame([(28, 0, k, 20 + k, 10) for k in range(6)], "a long, b long, key long, size long, parts long")
    thin = jaccard._thin_members(large, spark.createDataFrame([(28, 14)], "node long, n long")).collect()
    assert [(r["key"], r["node"]) for r in thin] == [(0, 28)]


def test_small_linked_sets_always_share_a_key():
    rng = np.random.default_rng(5)
    for a, b, common, n in [(3, 4, 3, 5000), (4, 5, 4, 5000), (7, 7, 6, 5000), *((a, b, -(-3 * (a + b) // 7), 3) for a in range(1, 32) for b in range(a, 32) if 4 * a >= 3 * b)]:
        band = jaccard.band_of(b)
        for _ in range(n):
            h = rng.integers(0, 1 << 63, a + b - common).astype(np.uint64)
            x, y = np.sort(h[:a]), np.sort(h[a - common :])
            assert band in dict(jaccard.bands(a)) and np.isin(jaccard.part_keys(x, band), jaccard.part_keys(y, band)).any()


def test_variants_of_a_template_equal_all_pairs(spark):
    rng = random.Random(14)
    say = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    texts = []
    for _ in range(6):
        template = say(16)
        for _ in range(14):  # 14 shingles, of which two variants have 12 in common
            texts.append(" ".join(rng.choice([say(2) + template, template + say(2), say(1) + template + say(1), say(4) + template[:14]])))
    got = jaccard.classes(frame(spark, texts)).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == plain_classes(texts, range(len(texts)))


def test_short_linked_texts_lose_no_link(spark):
    one = "jvbkji ldaqxs wbzvec otbjdt xxgrez mvtjhw fejpdx mwomlc"
    assert {r["component_id"] for r in jaccard.classes(frame(spark, [one, one + " zogciw"])).collect()} == {0}
    rng, texts = random.Random(9), []
    for i in range(30_000):  # each text but for its last word: 3 of 4, 4 of 5 and 5 of 6 shingles in common
        w = [f"{rng.randrange(36**5)}" for _ in range(8 + i % 3)]
        texts += [" ".join(w), " ".join(w[:-1])]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.classes(frame(spark, texts)).collect()}
    assert all(got[i] == i - i % 2 for i in range(len(texts)))


def test_sketch_distance_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    for _ in range(50):
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 900))) for _ in range(2))
        assert jaccard.hamming(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b))


# Repeated passages


def plain_repeats(texts, size):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + size] for b in raw for i in range(len(b) - size + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def test_matching_statistics_equal_brute_force():
    rng = random.Random(3)
    for _ in range(120):
        parts = [bytes(rng.choice(b"ab\x00"[: rng.choice([1, 2, 3])]) for _ in range(rng.randrange(1, 25))) for _ in range(rng.randrange(1, 5))]
        text = [(p, i) for p in range(len(parts)) for i in range(len(parts[p]))]

        def common(x, y):
            a, b = parts[x[0]][x[1] :], parts[y[0]][y[1] :]
            return next((k for k, (c, d) in enumerate(zip(a, b, strict=False)) if c != d), min(len(a), len(b)))

        assert run_index.matching_statistics(parts).tolist() == [max((common(x, y) for y in text if y != x), default=0) for x in text]


@pytest.mark.parametrize("hot", [1 << 22, 3000, 1])
def test_repeats_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(run_index, "HOT_BYTES", hot)
    rng = random.Random(hot)
    say = lambda n: " ".join(rng.choice(["the", "of", "ingre", "thé", "and"]) + str(rng.randrange(50)) for _ in range(n))
    bases, passage = [say(150) for _ in range(4)], say(90)
    texts = []
    for _ in range(25):
        w = (rng.choice(bases) if rng.random() < 0.5 else say(rng.randrange(5, 200))).split(" ")
        if rng.random() < 0.5:
            w.insert(rng.randrange(len(w)), passage[rng.choice([0, 90]) :])
        if rng.random() < 0.5:
            w[rng.randrange(len(w))] = "EDIT"
        texts.append(" ".join(w))
    texts += ["", None, "x" * 3000, "abc " * 300, texts[0], texts[0], "x" * 399, "y" * 400, "ab" * 201, "z" * 401]
    rows = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in run_index.remove_repeats(frame(spark, texts).repartition(3)).collect()}
    assert [rows[i] for i in range(len(texts))] == plain_repeats(texts, run_index.LENGTH)
    for r in run_index.remove_repeats(frame(spark, texts)).collect():
        raw, spans = (texts[r["doc_id"]] or "").encode(), [tuple(map(int, x.split(":"))) for x in r["spans"].split(",") if x]
        assert sum(b - a for a, b in spans) == r["n_removed"] and len(spans) == r["n_spans"]
        kept = b"".join(raw[b:c] for (_, b), (c, _) in zip([(0, 0), *spans], [*spans, (len(raw), 0)], strict=True))
        assert kept.decode("utf-8", "replace") == r["text"]
    assert run_index.remove_repeats(frame(spark, texts).where("false")).count() == 0


def test_rows_of_one_text_are_split_over_tasks(spark):
    wanted = {
        "spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        sha = F.sha2(F.when(F.col("id") % 2 == 0, F.lit("copy")).otherwise(F.col("id").cast("string")), 256)
        narrow = common.settle(spark.range(0, 20_000, 1, 8).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("th"), sha.alias("sha")))
        copied = narrow.join(run_index._recurring(narrow), "sha", "left_semi")
        rows = Counter(r["task"] for r in copied.withColumn("task", F.spark_partition_id()).collect())
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert rows.total() == 10_000 and max(rows.values()) <= 4_000


# Pipeline


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] == counts[4] > 0
    last = corpus_pipeline.run(spark, sf)
    assert last.count() == counts[-1] and last.where("not lossless").count() == 0


def test_stages_of_an_empty_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def plain_kept(text):
    """The quality stage by itself: base rule, then the ratios of whole and chunks against the bands."""
    raw, size = (text or "").encode(), lambda b: len(zstandard.ZstdCompressor(level=3).compress(b))
    if plain_quality(text)[-1]:
        return False
    low, high = next(x[1:] for x in quality.BANDS if len(raw) < x[0])
    whole = [raw[i : i + 4096] for i in range(0, len(raw) - 4095, 4096)]
    outside = sum(not 0.40 <= size(c) / 4096 <= 0.62 for c in whole)
    return low <= size(raw) / len(raw) <= high and (not whole or outside / len(whole) <= 0.5)


def plain_pipeline(rows, items, weights_of):
    """doc_id and redacted text that the first four stages leave, by plain means; ids differ."""
    rows = [(i, t) for i, t in rows if plain_kept(t)]
    home = {i: c for i, _, c in plain_classes([t for _, t in rows], [i for i, _ in rows])}
    rows = [(i, t) for i, t in rows if home[i] == i]
    rows = [(i, t) for i, t in rows if not any(plain_leaks(t, item) for item in items)]
    weights, out = weights_of(rows), {}
    for i, t in rows:
        done, parts = 0, []
        for s, k, e in pii.decide(t, weights)[1]:
            if s >= done:
                parts.append(t[done:s] + f"[{pii.KINDS[k].upper()}]")
            done = max(done, e)
        out[i] = "".join(parts) + t[done:]
    return out


def test_pipeline_equals_plain(spark, tmp_path, monkeypatch):
    """Near copies, leaks, personal data, junk, null and empty texts, and a column of the caller's own."""
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    prose = [r["text"] for r in given if 400 < len(r["text"]) < 3000 and plain_kept(r["text"])][:40]
    items = [ITEM, "Each of the 12 small boats carries 30 people over the wide lake and returns to the harbour before the evening bell rings"]
    texts = list(prose)
    for t in prose[:12]:
        w = t.split(" ")
        texts += [" ".join([*w[:-1], "changed"]), " ".join([*w[: len(w) // 2], items[len(texts) % 2].replace("12", "15"), *w[len(w) // 2 :]])]
        texts.append(f"{t} Please write to ann{len(texts)}@mail.example.com or call +1 (017) 555-7713 from 10.0.0.{len(texts)} now, as was agreed at the town hall that day.")
    texts += [None, "", " \n", "few words", "same words again " * 60, prose[0], prose[0].upper()]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    data = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "own") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, th string")
    data.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = plain_pipeline(rows, items, lambda kept: pii.fit(spark.createDataFrame(kept, "doc_id long, text string")))
    made, settle = [], common.settle
    monkeypatch.setattr(common, "settle", lambda df: made.append(settle(df)) or made[-1])
    got = corpus_pipeline.run(spark, str(tmp_path)).cache()
    assert got.where("not lossless").count() == 0
    assert {r["doc_id"]: r["text"] for r in pieces.decode_documents(got).collect()} == want and got.count() == len(want)
    assert 10 < len(want) < len(rows) - 20 and any("[EMAIL]" in t and "[IP]" in t for t in want.values())
    # Of the stages' own tables only the one that the last stage reads is left.
    there = [common._place(df)[1].exists(common._place(df)[0]) for df in made]
    assert len(there) == 4 and there == [False, False, False, True]


def test_settled_tables_go_with_their_scope(spark):
    seen = []

    def make():
        seen.append(common.settle(spark.range(5)))
        seen.append(common.settle_last(lambda: common.settle(spark.range(3)).union(seen[0])))
        return seen[1].distinct()

    exists = lambda df: common._place(df)[1].exists(common._place(df)[0])
    out = common.settle_last(make)
    assert out.count() == 5 and exists(out) and not any(map(exists, seen))
    with pytest.raises(ZeroDivisionError):
        common.settle_last(lambda: 1 // 0)
    assert common._on_the_way.get() is None and exists(common.settle(spark.range(1)))
