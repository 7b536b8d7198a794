import re
from collections import Counter, defaultdict

import corpus_pipeline as P
from tests.llm.test_operators import brute_hits, brute_links, brute_quality

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = docs.collect()
    kept = P.by_quality_rules(spark, docs, SF)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not any(brute_quality(r.text)[5] for r in rows if r.doc_id in ids)

    one = P.by_jaccard_join(spark, kept, SF)
    got = {r.doc_id for r in one.collect()}
    rep, links = brute_links([(r.doc_id, r.text) for r in kept.collect()])
    parent = {i: i for i in rep}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in [(a, b) for a in links for b in links[a]] + list(rep.items()):
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got == {i for i in parent if find(i) == i}

    clean = P.by_decontamination(spark, one, SF)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect() if not brute_hits(r.text, items)[1]}

    mixed = P.by_mixing(spark, clean, SF)
    assert mixed.columns == docs.columns
    times = Counter(r.doc_id for r in mixed.collect())
    assert max(times.values()) <= 3 and set(times) <= {r.doc_id for r in clean.collect()}
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    per = defaultdict(lambda: [0, 0, 0])
    for r in clean.collect():
        per[r.source][0] += size(r.text)
        per[r.source][1] += size(r.text) * times[r.doc_id]
        per[r.source][2] = max(per[r.source][2], size(r.text))
    total = sum(v[0] for v in per.values())
    assert abs(sum(v[1] for v in per.values()) - total) < sum(v[2] for v in per.values())

    out = P.to_token_files(spark, mixed, SF)
    assert Counter(r.doc_id for r in out.collect()) == times
    assert P.run(spark, SF).count() == sum(times.values())


def test_pipeline_with_odd_rows(spark):
    """Null and shared ids, repeated rows, null and empty texts, columns that clash with the stages' own, an empty table."""
    import random

    rng = random.Random(21)
    stop = ["the", "of", "and", "to", "in", "is", "that", "was"]
    prose = lambda: " ".join(rng.choice(stop) if rng.random() < 0.4 else f"word{rng.randint(0, 10**6)}" for _ in range(120)) + "."
    a, b, c, d, e = (prose() for _ in range(5))
    texts = [(1, a), (1, b), (None, c), (None, d), (None, d), (2, e), (2, e), (3, a.upper()), (4, None), (5, ""), (None, None)]
    rows = [(i, t, "en", f"s{k % 2}", 1, "x", 2, 3, "y") for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality_rules string, _times int, _row_id int, `a.b` string")
    kept = P.by_quality_rules(spark, docs, SF)
    assert kept.columns == docs.columns
    from gridloom.llm.shared import stage

    kept = stage(kept, "odd")
    one = P.by_jaccard_join(spark, kept, SF)
    assert one.columns == docs.columns
    good = {(i, t) for i, t in texts if t and not brute_quality(t)[5]}
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((i, t) for i, t in texts if (i, t) in good)
    got = Counter((r.doc_id, r.text) for r in one.collect())
    assert got == Counter({(1, a): 1, (1, b): 1, (None, c): 1, (None, d): 1, (2, e): 1})
    clean = P.by_decontamination(spark, one, SF)
    assert clean.columns == docs.columns
    mixed = P.by_mixing(spark, stage(clean, "odd"), SF)
    assert mixed.columns == docs.columns
    times = Counter((r.doc_id, r.text) for r in mixed.collect())
    assert set(times) <= set(got) and max(times.values()) <= 3
    assert P.to_token_files(spark, mixed, SF).count() == sum(times.values())
    none = docs.limit(0)
    for _, apply in P.STAGES:
        none = apply(spark, none, SF)
        assert none.count() == 0
