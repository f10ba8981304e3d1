"""The source audit beside a dense computation over all terms and groups."""

import collections
import random
import re

import pyarrow as pa
import pytest

from gazetteer.llm import divergence
from gazetteer.llm.divergence import audit

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, term string, p long, z long, item string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def dense(rows, least):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(FOLD))) for _, text, lang, source, *_ in rows]
    groups = sorted({d[:2] for d in docs})
    have, df, all_of = collections.Counter(), collections.Counter(), collections.Counter()
    for lang, source, terms in docs:
        for t in terms:
            have[lang, source, t] += 1
            all_of[lang, t] += 1
        df.update((lang, t) for t in set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (tongue, t), n in df.items() if tongue == lang and n >= least]
        own = [s for tongue, s in groups if tongue == lang]
        share = lambda counts: {t: 1 + 10**9 * (c + 2) // (sum(counts.values()) + 2 * len(kept)) for t, c in counts.items()}
        p = {s: share({t: have[lang, s, t] for t in kept}) for s in own}
        q = share({t: all_of[lang, t] for t in kept})
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in own if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if have[lang, s, t] and p[s][t] > q[t]]
            for part, found, cut in (("pair", pairs, None), ("term", terms, 10)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(found[:cut], 1)]
    return sorted(out)


def odd_rows():
    g = random.Random(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)] + ["Écoute", "ÉCOUTE", "straße", "日本語", "İx", "don"]
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, "42 -- \x00\x1f", "fr", "only"), (4, "x", "", ""), (None, "one a ONE", "en", None)]
    rows += [(5, " ".join(g.choice(words) for _ in range(5000)), "en", "long"), (6, "UP up\x00Up\x0bUP", "en", "a")]
    for i in range(160):
        lang = ["en", "de", None][i % 3]
        source = "hot" if i % 2 else f"s{i % 5}"
        text = " ".join(g.choice(words[: 20 + i % 60]) for _ in range(g.randrange(40)))
        rows.append((10 + i, text.upper() if i % 7 == 0 else text, lang, source))
    rows += rows[20:30]  # repeated rows are documents of their own
    rows += [(500 + i, "sole words here", "xx", "one") for i in range(12)]
    return [(*r, "t", 1, 2, "i") for r in rows]


@pytest.mark.parametrize("least", [1, 3, 10, 10**6])
def test_same_as_dense(spark, least):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, audit(df, least_docs=least).collect())) == dense(rows, least)


def test_slices_end_with_terms(spark, monkeypatch):
    monkeypatch.setattr(divergence, "COUNT_BYTES", 500)
    monkeypatch.setattr(divergence, "SLICE", 7)
    monkeypatch.setattr(divergence, "SCATTER", 5)
    index = [("en", t, s, p, 2) for t, s, p in
             sorted((f"t{k % 9}", f"s{k}", 10 + k * k % 37) for k in range(60))]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("lang", "term", "source", "p", "z"), r, strict=True)) for r in index[a:a + 4]])
               for a in range(0, 60, 4)]
    got = collections.Counter()
    for out in divergence._scatter(iter(batches)):
        for r in out.to_pylist():
            got[r["source"], r["item"]] += r["value"]
    want = collections.Counter()
    f = lambda a, b: (a - b) ** 2 // (a + b)
    for _, t, s, p, z in index:
        for _, u, o, q, y in index:
            if t == u and s != o:
                want[s, o] += f(p, q) - f(p, y) - f(z, q) + f(z, y)
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_empty_table(spark):
    assert audit(spark.createDataFrame([], SCHEMA)).collect() == []
