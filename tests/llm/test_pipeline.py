"""The pipeline against its stages written out plainly, on a small corpus."""
import collections
import random

from test_llm_operators import brute_components, brute_contamination, brute_schedule, edited

import corpus_pipeline
from attestor.llm import mixing

TONGUES = {"aa": "abcde", "bb": "fghij"}
CARD = "4111 1111 1111 1111"


def test_pipeline(spark, tmp_path):
    rng = random.Random(5)
    make = lambda lang, n=80: " ".join("".join(rng.choice(TONGUES[lang]) for _ in range(5)) for _ in range(n))
    rows = [(k, make(lang), lang, rng.choice(["hot"] * 5 + ["mid", "low", None])) for k in range(240) for lang in [list(TONGUES)[k % 2]]]
    item = make("aa", 25)
    rows += [(300 + k, edited(rng, rows[4][1], 1) if k % 2 else rows[4][1], "aa", "hot") for k in range(12)]  # near and exact copies
    rows += [(400 + k, f"{make('aa', 20)} {item[k:]} {make('aa', 20)}", "aa", "mid") for k in (0, 6, 12)]  # hold the item
    rows += [(500, None, "aa", "hot"), (501, "", "aa", "hot"), (502, "12 34 !!", "bb", "hot"), (503, "Ω" * 9 + " " + "Ж" * 30, None, "hot")]
    rows += [(600 + k, f"{make('bb')} {CARD if k else CARD.replace(' ', '')}", "bb", "low") for k in range(2)]
    rows += [(700, make("aa", 6000), "aa", "low")]
    frame = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars int")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    bench = [(1, item), (2, None), (3, make("bb", 14))]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    out = corpus_pipeline.run(spark, str(tmp_path)).orderBy("position").collect()

    text = {r[0]: r[1] for r in rows}
    kept = [(k, t) for k, t in text.items() if k not in (500, 501, 502, 503)]  # no running text of a learned language
    roots = {k: root for k, _, root in brute_components(kept)}
    kept = [(k, t) for k, t in kept if roots[k] == k]
    assert 4 in dict(kept) and not any(300 <= k < 312 for k, _ in kept)
    kept = [k for k, _, hit, _ in brute_contamination(kept, bench) if not hit]
    assert not any(400 <= k < 500 for k in kept)
    assert sorted(r.doc_id for r in out) == sorted(kept)

    by_id = {r.doc_id: r for r in out}
    assert all(by_id[k].text == text[k] for k in kept if k not in (600, 601)) and all(r.n_chars == len(r.text) for r in out)
    one, other = ("".join(c for c in by_id[k].text if c.isdigit()) for k in (600, 601))
    assert one == other != CARD.replace(" ", "") and len(one) == 16 and by_id[600].text[:200] == text[600][:200]

    counts = collections.Counter(r.source or "" for r in out)
    want = brute_schedule({s: -(-n // mixing.BLOCK_DOCS) for s, n in counts.items()}, mixing.root_weights(dict(counts)))
    assert sorted({(r.slot, r.source or "", r.block) for r in out}) == [(t, s, b) for t, (s, b) in enumerate(want)]
    assert len({r.position for r in out}) == len(out) and all(r.position // mixing.BLOCK_DOCS == r.slot for r in out)
