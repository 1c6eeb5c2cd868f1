"""SimHash components against brute force."""
import random
import re

import numpy as np
import pytest
import xxhash

from attestor.llm import queries, simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(prints, near=3):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= near:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def same_parts(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_fingerprint_equals_definition_also_in_pieces(monkeypatch):
    rng = random.Random(1)
    texts = ["", " \t\n", "one", "Two words", "three short words", "ÄÖ é Ü ÀB", "a\x0bb\x0cc\x1cd e f g", " ".join(rng.choice(["the", "of", "x" * 40, "Ab"]) for _ in range(3000))]
    texts += [" ".join(str(rng.randrange(9)) for _ in range(n)) for n in range(12)]
    want = [brute_print(t) for t in texts]
    assert [simhash.fingerprint(t.encode()) for t in texts] == want
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert [simhash.fingerprint(t.encode()) for t in texts] == want


def test_spark_hash_is_the_same(spark):
    assert spark.sql("SELECT xxhash64('abc def ghi') h").first().h & (2**64 - 1) == xxhash.xxh64_intdigest("abc def ghi", 42)


@pytest.fixture(scope="module")
def cloud():
    """Centres with clouds of few flipped bits, chains, and dense neighbourhoods of one segment."""
    rng = random.Random(2)
    out = {0, 7, 2**64 - 1, 2**63}
    for _ in range(30):
        c = rng.getrandbits(64)
        for _ in range(12):
            out.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))))
    c = rng.getrandbits(64)
    for _ in range(40):  # a chain of steps of three bits
        c ^= sum(1 << b for b in rng.sample(range(64), 3))
        out.add(c)
    high = rng.getrandbits(32) << 32
    out |= {high | rng.getrandbits(9) * 4099 % 2**32 for _ in range(150)}  # one hot segment value
    out |= {(high ^ 1 << 40) | rng.getrandbits(9) * 4099 % 2**32 for _ in range(60)}
    return sorted(out)


@pytest.mark.parametrize("half", [4096, 20, 1])
def test_links_have_all_components(spark, cloud, half):
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in cloud], "fp long")
    found = [(r.u % 2**64, r.v % 2**64) for r in simhash.links(df, half).collect()]
    assert all((u ^ v).bit_count() <= 3 and u != v for u, v in found)
    assert len(found) <= 64 * (1 if half == 4096 else 33) * len(cloud)
    at = {x: i for i, x in enumerate(cloud)}
    root = list(range(len(cloud)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in found:
        root[find(at[u])] = find(at[v])
    assert same_parts([find(i) for i in range(len(cloud))], brute_components(cloud))


def test_spanning_is_a_forest():
    x = np.unique(np.random.default_rng(3).integers(0, 2**14, 500).astype(np.uint64))
    u, v = simhash.spanning(x)
    parts = brute_components([int(a) for a in x])
    assert sum(len(a) for a in u) == sum(len(a) for a in v) == len(x) - len(set(parts))


def rows():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    base = [[rng.choice(words) for _ in range(rng.randrange(20, 90))] for _ in range(25)]
    out = [(i, " ".join(w)) for i, w in enumerate(base)]
    for k in range(60):
        w = list(base[k % 6])
        w[rng.randrange(len(w))] = f"new{k}"
        out.append((100 + k, " ".join(w)))
    out += [(200 + k, " ".join(base[7]).upper()) for k in range(10)]
    return out + [(300, None), (301, ""), (302, " \n"), (303, "one"), (304, "ONE"), (0, " ".join(base[0])), (None, "one"), (None, "quite alone here"), (305, "é" * 3), (306, " ".join(rng.choice(words) for _ in range(20_000)))]


def test_components_equal_brute_force(spark, tmp_path):
    data = rows()
    prints = [brute_print(t) for _, t in data]
    parts = brute_components(prints)
    low = {}
    for (i, _), p in zip(data, parts):
        if i is not None:
            low[p] = min(i, low.get(p, i))
    want = sorted(((i, f"{x:016x}", low.get(p)) for (i, _), x, p in zip(data, prints, parts)), key=str)
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in data], "doc_id long, text string, fp string, root string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op12_simhash_near_duplicates"](spark, str(tmp_path))
    assert got.columns[:3] == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(r)[:3] for r in got.collect()), key=str) == want
    assert len({c for _, _, c in want}) < len(want) - 20


def test_empty_table(spark):
    assert simhash.components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
