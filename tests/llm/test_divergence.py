"""The divergence audit and its transducers against plain counting."""
import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from attestor.llm import divergence, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute(rows):
    rows = [(words(t), lang or "", source or "") for t, lang, source in rows]
    docs, count, out = defaultdict(Counter), defaultdict(Counter), []
    for w, lang, source in rows:
        docs[lang].update(set(w))
    kept = {lang: {t for t, n in c.items() if n >= 3} for lang, c in docs.items()}
    for w, lang, source in rows:
        count[lang, source].update(x for x in w if x in kept[lang])
        count[lang, None].update(x for x in w if x in kept[lang])

    def share(key, t):
        return 1 + 10**9 * (count[key][t] + 1) // (sum(count[key].values()) + len(kept[key[0]]))

    f = lambda p, q: (p - q) * (p - q) // q
    for lang, source in sorted({(lang, source) for _, lang, source in rows}):
        others = {s for _, x, s in rows if x == lang and s != source}
        pair = sorted((-sum(f(share((lang, source), t), share((lang, s), t)) for t in kept[lang]), s.encode()) for s in others)
        out += [(lang, source, "pair", s.decode(), -v, k + 1) for k, (v, s) in enumerate(pair)]
        term = []
        for t in kept[lang]:
            p, q = share((lang, source), t), share((lang, None), t)
            if count[lang, source][t] and p > q:
                term.append((-f(p, q), t.encode()))
        out += [(lang, source, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(sorted(term)[:200])]
    return sorted(out)


def rows(n=120, seed=1):
    rng = random.Random(seed)
    vocabulary = [("".join(rng.choice("abcdeéß漢") for _ in range(rng.randrange(1, 7)))) for _ in range(400)]
    out = []
    for k in range(n):
        source = rng.choice(["hot", "hot", "s1", "s2", "S2", "é", None])
        some = vocabulary[:300] if source != "s1" else vocabulary[100:]
        out.append((" ".join(rng.choice(some).upper() if rng.random() < 0.2 else rng.choice(some) for _ in range(rng.randrange(60))), rng.choice(["en", "en", "fr", None]), source))
    out += [(None, "en", "empty"), ("", "de", "x"), ("12 34 ?", "de", "y"), ("only once here", "de", "z"), ("x" * 5000, "en", "s1"), (out[0][0], "en", "s2"), (out[0][0], "en", "s2")]
    return out + [("alone", "it", "one")] * 3


def frame(spark, data):
    return spark.createDataFrame([(k, t, lang, s, 1, "x", 2) for k, (t, lang, s) in enumerate(data)], "doc_id long, text string, lang string, source string, n_chars long, term string, ord int")


def test_transducer_is_minimal_and_ordered():
    rng = random.Random(3)
    terms = sorted({bytes(rng.choice(b"abc\xc3\xa9") for _ in range(rng.randrange(1, 6))) for _ in range(300)} | {b"stations", b"station", b"nations", b"nation"})
    fst = divergence.build(terms)
    assert list(divergence.listed(fst)) == terms
    others = [b"zz", b"nat", b"nationss", b"\xff"]
    asked = pa.array(terms + others, pa.large_binary())
    assert divergence.places(fst, asked).tolist() == [*range(len(terms)), -1, -1, -1, -1]
    assert divergence.places(fst, asked.slice(5, 9)).tolist() == [*range(5, 14)]
    # minimal: no two states have the same right language
    right = {}
    moves = defaultdict(list)
    for key, target in zip(fst["keys"].tolist(), fst["targets"].tolist()):
        moves[key // 256].append((key % 256, target))
    for s in range(len(fst["finals"])):
        right[s] = frozenset([b""] if fst["finals"][s] else []) | {bytes([b]) + w for b, t in moves[s] for w in right[t]}
    assert len(set(right.values())) == len(right)


@pytest.mark.parametrize("piece, limit", [(1 << 16, 64 << 20), (37, 64 << 20), (37, 6000)])
def test_audit_equals_brute_force(spark, piece, limit):
    data = rows()
    got = divergence.audit(frame(spark, data), piece=piece, limit=limit)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = brute(data)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert any(r[2] == "term" for r in want) and ("it", "one", "pair") not in {r[:3] for r in want} and ("de", "x", "pair", "y", 0, 1) in want


def test_query_equals_its_sql(spark, tmp_path):
    data = rows(60, 2)
    frame(spark, data).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in queries.QUERIES["op11_source_divergence_audit"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == brute(data) == sorted(con.execute(queries.ORACLES["op11_source_divergence_audit"]).fetchall())


def test_empty_table(spark):
    assert divergence.audit(frame(spark, []).limit(0)).collect() == []
