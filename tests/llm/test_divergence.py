"""Source divergence against dense sums in plain Python."""

import random
import re
from collections import Counter, defaultdict

from paperloom.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def plain(rows, least=30, top=50):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source, terms = lang or "", source or "", TERM.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    share = lambda c, n, v: 1 + 10**9 * (c + 5) // (n + 5 * v)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)
        names = sorted(s for g, s in groups if g == lang)
        n = {s: sum(count[lang, s][t] for t in kept) for s in names}
        p = {s: {t: share(count[lang, s][t], n[s], v) for t in kept} for s in names}
        whole = {t: sum(count[lang, s][t] for s in names) for t in kept}
        q = {t: share(whole[t], sum(n.values()), v) for t in kept}
        for s in names:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in names if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -x, k + 1) for k, (x, _, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t, -x, k + 1) for k, (x, _, t) in enumerate(sorted(terms)[:top])]
    return sorted(out)


def rows(n_sources=7):
    rng = random.Random(6)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)] + ["İ", "ÀB", "Zß", "it's", "x-Y", "日本", "a1b2"]
    out = []
    for k in range(900):
        lang = rng.choice(["en", "en", "de", None])
        source = rng.choice([f"s{int(rng.random() ** 3 * n_sources)}", "s0", "s0", "é", "Z"])
        weight = [1 + (hash_(source + w) % 7) ** 2 / (1 + k2) for k2, w in enumerate(words)]
        out.append((lang, source, " ".join(rng.choices(words, weight, k=rng.randrange(60)))))
    out += [("fr", "a", "rare"), ("fr", "b", None), ("fr", None, ""), ("en", "mute", "..."), ("en", "", "waa waa")]
    return out + out[:40]


def hash_(text):
    return sum(ord(c) * 31**k for k, c in enumerate(text))


def found(spark, data):
    docs = spark.createDataFrame(data, "lang string, source string, text string").repartition(3)
    return sorted(tuple(r) for r in divergence.divergence(docs).collect())


def test_equals_dense_sums(spark):
    data = rows()
    want = plain(data)
    assert {r[2] for r in want} == {"pair", "term"} and any(r[4] == 0 for r in want)
    assert found(spark, data) == want


def test_several_tiles_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", 3)
    monkeypatch.setattr(divergence, "BLOCK", 20)
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "SHARES", 20)
    data = rows(14)
    assert found(spark, data) == plain(data)


def test_empty_table_and_odd_columns(spark):
    assert divergence.divergence(spark.createDataFrame([], "lang string, source string, text string")).count() == 0
    docs = spark.createDataFrame([("x", "a", "one", 1, 2), ("x", "b", "two", 1, 2)], "lang string, source string, text string, `a.b` int, value int")
    assert sorted(tuple(r) for r in divergence.divergence(docs).collect()) == [("x", "a", "pair", "b", 0, 1), ("x", "b", "pair", "a", 0, 1)]
