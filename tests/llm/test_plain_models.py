"""The classifiers' numbers against plain versions, gram by gram and row by row."""

import math
from collections import Counter

import numpy as np
import pytest

from lakescribe.llm import language_id, ngrams, pu_quality, toxicity

MASK = 0xFFFFFFFF
TEXTS = [
    ("en", "The old house by the river was quiet, and 12 people walked slowly toward the town."),
    ("en", "In the morning the market opened early. The morning was bright!"),
    ("en", "Stones and water, water and stones; nothing else was there to see."),
    ("fr", "La maison était près de la rivière, et les gens marchaient vers la ville."),
    ("fr", "Le marché ouvre tôt le matin. C'est un beau matin d'hiver."),
    ("fr", "De l'eau et des pierres, rien que de l'eau; où est le chemin ?"),
    ("de", "Das Haus am Fluß war still, und die Leute gingen langsam in die Stadt."),
    ("de", "Am Morgen öffnet der Markt früh. Es ist ein schöner Wintermorgen."),
    ("de", "Wasser und Steine, sonst nichts; wo ist der Weg über den Fluß?"),
]


def gram_hash(gram: bytes, bits: int) -> int:
    h = gram[0]
    for x in gram[1:]:
        h = (h * 0x01000193 + x) & MASK
    mixed = (h ^ (h >> 15) ^ (len(gram) * 0x9E3779B1 & MASK)) * 0x2C1B3C6D & MASK
    return ((mixed ^ (mixed >> 13)) * 0x85EBCA6B & MASK) >> (32 - bits)


def grams(data: bytes, sizes, bits: int) -> Counter:
    return Counter(gram_hash(data[k : k + n], bits) for n in sizes for k in range(len(data) - n + 1))


def test_hashes_across_parts(monkeypatch):
    monkeypatch.setattr(ngrams, "PART", 7)
    data = "é quick brown fox, and more".encode()
    for sizes in ((2, 3), (3, 4, 5, 6)):
        found = {int(h) for part in ngrams.parts(data, max(sizes)) for hs in ngrams.hashed(part, sizes, 18) for h in hs}
        assert found == set(grams(data, sizes, 18))


def plain_counts(text: str) -> Counter:
    letters = bytes(x if 97 <= x <= 122 or x >= 128 else 32 for x in text.lower().encode())
    words = b" ".join(letters.split())
    return grams(b" " + words + b" ", language_id.SIZES, language_id.BITS) if words else Counter()


def plain_vector(counts: Counter, idf: dict[int, float]) -> dict[int, float]:
    v = {k: math.log1p(n) * idf[k] for k, n in counts.items()}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / norm for k, x in v.items()}


def test_language(spark):
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(TEXTS)] + [(50, None, "en"), (51, "12 ½ Ⅷ", "en"), (52, "no language", None)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    n, df = len(TEXTS), Counter(k for _, t in TEXTS for k in plain_counts(t))
    idf = {k: math.log((1 + n) / (1 + df.get(k, 0))) + 0.05 for k in range(1 << language_id.BITS)}
    assert np.allclose(model.idf, [idf[k] for k in range(1 << language_id.BITS)], atol=1e-6)
    for lang in ("de", "en", "fr"):  # three texts of a language are their own centroids
        own = [plain_vector(plain_counts(t), idf) for x, t in TEXTS if x == lang]
        for c in model.centroids[[x == lang for x in model.langs]]:
            assert max(sum(c[k] * x for k, x in v.items()) for v in own) > 1 - 1e-5
    tests = ["The people of the town", "les gens de la ville", "der Weg in die Stadt", "zzz qqq xxx jjj", "a", None, "", "10 ½", "² ③ Ⅷ", "¡!"]
    found = language_id.predict(spark.createDataFrame(list(enumerate(tests)), "doc_id int, text string"), model).collect()
    for r in found:
        text = tests[r["doc_id"]]
        if text is None or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"], r["distance"], r["rejected"]) == ("und", 0, 1, True)
            continue
        v = plain_vector(plain_counts(text), idf)
        best = {}
        for c, lang in zip(model.centroids, model.langs, strict=True):
            best[lang] = max(best.get(lang, -1), sum(float(c[k]) * x for k, x in v.items()))
        top = max(best.values())
        assert r["lang_pred"] == max(sorted(best), key=best.get)
        assert abs(r["score"] - 1 / sum(math.exp(language_id.SHARPNESS * (x - top)) for x in best.values())) < 1e-5
        assert abs(r["distance"] - (1 - top)) < 1e-6 and r["rejected"] == (top < model.least)
    assert [r["lang_pred"] for r in sorted(found, key=lambda r: r["doc_id"])][:3] == ["en", "fr", "de"]
    assert next(r for r in found if r["doc_id"] == 3)["rejected"]


def test_k_means():
    rng = np.random.default_rng(5)
    rows = rng.random((40, 12)).astype(np.float32)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    points = [[float(x) for x in r] for r in rows]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    mean = [sum(p[k] for p in points) for k in range(12)]
    centres = [max(points, key=lambda p: dot(p, mean))]
    while len(centres) < 3:
        centres.append(min(points, key=lambda p: max(dot(p, c) for c in centres)))
    for _ in range(20):
        groups = [[] for _ in centres]
        for p in points:
            groups[max(range(3), key=lambda k, p=p: dot(p, centres[k]))].append(p)
        sums = [[sum(p[k] for p in g) for k in range(12)] if g else c for g, c in zip(groups, centres, strict=True)]
        centres = [[x / math.sqrt(dot(s, s)) for x in s] for s in sums]
    assert np.allclose(language_id.k_means(rows, 3), centres, atol=1e-5)


def plain_present(text: str) -> set[int]:
    return set(grams(b" " + text.lower().encode() + b" ", toxicity.SIZES, toxicity.BITS))


def plain_regression(rows: list[list[float]], y: list[int]) -> tuple[list[float], float]:
    n, d = len(rows), len(rows[0])
    w, b = [0.0] * (d + 1), math.log((sum(y) + 1) / (n - sum(y) + 1))
    w[d] = b
    m, v = [0.0] * (d + 1), [0.0] * (d + 1)
    for t in range(1, toxicity.ROUNDS + 1):
        g = [toxicity.DECAY * x for x in w[:d]] + [0.0]
        for row, target in zip(rows, y, strict=True):
            p = 1 / (1 + math.exp(-(w[d] + sum(x * c for x, c in zip(row, w, strict=False)))))
            for k in range(d):
                g[k] += (p - target) * row[k] / n
            g[d] += (p - target) / n
        for k in range(d + 1):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
            w[k] -= toxicity.RATE * (m[k] / (1 - 0.9**t)) / (math.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return w[:d], w[d]


def test_toxicity(spark):
    rows = [(k, t + (" you grubby zorp" if k % 3 == 0 else ""), int(k % 3 == 0)) for k, (_, t) in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), features=12)
    has = [(plain_present(t), y) for _, t, y in rows]
    n = Counter(y for _, y in has)
    toxic, clean = (Counter(k for g, y in has if y == kind for k in g) for kind in (1, 0))

    def apart(k):
        share = (toxic[k] + clean[k]) / len(rows)
        return abs(toxic[k] / n[1] - clean[k] / n[0]) / math.sqrt(share * (1.0001 - share))

    kept = sorted((k for k in set(toxic) | set(clean) if toxic[k] + clean[k] >= 3), key=lambda k: (-apart(k), k))[:12]
    assert sorted(np.flatnonzero(model.numbers >= 0).tolist()) == sorted(kept)
    ratio = {k: math.log((toxic[k] + 1) / (n[1] + 2)) - math.log((clean[k] + 1) / (n[0] + 2)) for k in kept}
    w, b = plain_regression([[ratio[k] if k in g else 0.0 for k in kept] for g, _ in has], [y for _, y in has])
    tests = [t for _, t, _ in rows] + ["", "ZORP zorp, and nothing else", "plain words"]
    for r in toxicity.predict(spark.createDataFrame(list(enumerate(tests)), "doc_id int, text string"), model).collect():
        z = b + sum(w[j] * ratio[k] for j, k in enumerate(kept) if k in plain_present(tests[r["doc_id"]]))
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-4, tests[r["doc_id"]]
        own = model.bias + sum(float(model.weights[model.numbers[k]]) for k in plain_present(tests[r["doc_id"]]) if model.numbers[k] >= 0)
        assert abs(r["score"] - 1 / (1 + math.exp(-own))) < 1e-6


def plain_features(text: str) -> list[float]:
    data = text.encode()
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    size = pu_quality.N_SHARES
    if words:
        n, distinct = len(words), len(set(words))
        kinds = [sum(x in members for x in data) for members in pu_quality._KINDS]
        again = sum(a == b for a, b in zip(words, words[1:], strict=False))
        shares = [x / len(data) for x in kinds] + [math.log(1 + n), sum(map(len, words)) / n, distinct / n, math.log((1 + n) / (1 + distinct)), again / n, math.log(1 + n / len(lines)), 1 - len(set(lines)) / len(lines), kinds[10] / n, kinds[9] / n, 0.0]
    else:
        shares = [0.0] * (size - 1) + [1.0]
    counts = grams(text.lower().encode(), pu_quality.SIZES, pu_quality.BITS)
    total = sum(counts.values()) + pu_quality.FEW
    return shares + [math.sqrt(counts.get(k, 0) / total) for k in range(1 << pu_quality.BITS)]


def test_quality(spark):
    texts = [t for _, t in TEXTS] + ["", " \n ", "word", "a|b | a|b\n\na|b | a|b\nx", "!!! ### $$$", "中文 字符"]
    assert np.allclose(pu_quality.features(texts), [plain_features(t) for t in texts], atol=1e-6)
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(TEXTS)], "doc_id long, text string")
    model = pu_quality.fit(docs, spark.createDataFrame([(0, 1), (1, 1), (2, 1), (3, 0)], "doc_id long, quality int"))
    for r in pu_quality.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).collect():
        x = [min(6.0, max(-6.0, (a - m) / s)) for a, m, s in zip(plain_features(texts[r["doc_id"]]), model.mean, model.scale, strict=True)]
        w, bias, to_out, last = model.weights
        hidden = [math.tanh(sum(a * float(b) for a, b in zip(x, w[:, k], strict=True)) + float(bias[k])) for k in range(len(to_out))]
        z = sum(a * float(b) for a, b in zip(hidden, to_out, strict=True)) + float(last)
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-5


@pytest.mark.parametrize("prior", [0.1, 0.5, 0.9])
def test_risk(prior):
    """The slopes are those of the risk as it is written down, by differences."""
    rng = np.random.default_rng(int(10 * prior))
    for shift in (-2, 0, 2):
        out, n = rng.normal(shift, 2, 30), 12
        loss = lambda z: math.log(1 + math.exp(-z))
        of_negatives = lambda z: sum(map(loss, -z[n:])) / len(z[n:]) - prior * sum(map(loss, -z[:n])) / n
        whole = lambda z: prior * sum(map(loss, z[:n])) / n + of_negatives(z)
        risk = whole if of_negatives(out) >= 0 else lambda z: -of_negatives(z)
        slopes = pu_quality.risk_slopes(out, n, prior)
        for k in range(len(out)):
            up, down = out.copy(), out.copy()
            up[k] += 1e-5
            down[k] -= 1e-5
            assert abs((risk(up) - risk(down)) / 2e-5 - slopes[k]) < 1e-6


def test_prior_is_the_least_ratio():
    rng = np.random.default_rng(3)
    p, u = rng.normal(1, 1, 400), np.concatenate([rng.normal(1, 1, 60), rng.normal(-2, 1, 2940)])
    cuts = np.quantile(p, np.linspace(0, 0.5, 51))
    want = min((sum(u >= c) / len(u) + 0.1 * (1 / math.sqrt(len(u)) + 1 / math.sqrt(len(p)))) / (sum(p >= c) / len(p)) for c in cuts)
    assert abs(pu_quality.estimate_prior(p, u) - want) < 1e-9 and want < 0.05
