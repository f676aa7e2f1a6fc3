"""Source divergence against plain Python on small tables; the whole table is compared with SQL in test_queries."""

import random
import re
from collections import Counter, defaultdict

import pytest

from isochron.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least=30, top=50):
    """Rows of the report from (text, lang, source), by the definition: every term of every pair."""
    n, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        groups.add((lang or "", source or ""))
        n[lang or "", source or ""].update(terms)
        held[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, k in held[lang].items() if k >= least)
        mine = {s: n[lang, s] for of, s in groups if of == lang}
        whole = sum(mine.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in mine.items()}, share(whole)
        for s in mine:
            pair = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in mine if o != s))
            term = sorted((q[t] - p[s][t], t.encode()) for t in kept if mine[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item.decode(), -v, k + 1) for part, found in (("pair", pair), ("term", term)) for k, (v, item) in enumerate(found)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def made(seed, n_rows, n_sources, n_words):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}é"[: 3 + i % 2] for i in range(n_words)]
    row = lambda: (" ".join(rng.choices(words, [1 / (i + 1) for i in range(n_words)], k=rng.randint(0, 40))), rng.choice(["en", "fr", "", None]), rng.choice([f"s{i}" for i in range(n_sources)] + [None]))
    return [row() for _ in range(n_rows)]


@pytest.mark.parametrize(("tile", "block"), [(64, 16_384), (3, 7)])
def test_equals_the_definition(spark, tile, block):
    """Small tiles and blocks deal the same terms over many tasks."""
    rows = made(tile, 500, 9, 60)
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "text string, lang string, source string, n int, term int, no int")
    assert rows_of(divergence.divergence(docs, least_docs=8, top=5, block_terms=block, tile=tile)) == brute(rows, 8, 5)


def test_sources_without_terms_ties_and_languages_without_terms(spark):
    rows = [("Alpha BETA alpha", "en", "a")] * 40 + [("beta alpha alpha", "en", "b")] * 40 + [(None, "en", "c"), ("rare", "en", "d"), ("", "en", None)] + [("once", "de", "x"), ("twice", "de", "y"), (None, None, None)]
    got = rows_of(divergence.divergence(spark.createDataFrame(rows, "text string, lang string, source string")))
    assert got == brute(rows)
    assert {r[4] for r in got if r[0] == "de"} == {0}
    assert not [r for r in got if r[0] == "" and r[1] == ""]


def test_upper_case_beyond_ascii_stays_and_long_texts_are_cut_at_terms(spark):
    assert [w for part in divergence.term_pieces("ÀB1c_d É".encode(), 1) for w in part] == [x.encode() for x in ("Àb", "c", "d", "É")]
    text = "lorem ipsum dolor " * 300_000
    rows = [(text, "en", "a")] + [("ipsum", "en", "b")] * 30
    got = rows_of(divergence.divergence(spark.createDataFrame(rows, "text string, lang string, source string"), least_docs=1))
    assert got == brute(rows, 1)


def test_empty_table(spark):
    assert divergence.divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
