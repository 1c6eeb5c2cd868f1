"""The operators against brute force on small frames with nulls, empty and long texts, ties, repeated rows and clashing columns."""
import collections
import datetime
import hashlib
import html
import math
import random
import re
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.llm import decontaminate, fingerprints, language, licenses, mixing, ngram_jaccard, page_text, pseudonyms, quality, toxicity
from attestor.llm.components import connected

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "the", "of", "and", "to", "in"]


def text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def edited(rng, t, k):
    w = t.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    base = [text(rng, 60) for _ in range(12)]
    passage = text(rng, 50)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + k, edited(rng, base[0], rng.randrange(1, 6))) for k in range(40)]  # a cloud of near copies
    rows += [(200 + k, base[1].upper()) for k in range(10)]  # copies but for case
    rows += [(300 + k, passage + " " + text(rng, 30)) for k in range(30)]  # a shared passage
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "one two"), (404, "ONE  two"), (405, "!!! ???"), (406, text(rng, 20_000)), (0, base[0]), (None, base[2]), (407, "é" * 9)]
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, node string, n string"), rows


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)].append(i)
    return [(i, len(sets[k]), (min(low[find(k)], default=None) if sets[k] else i)) for k, (i, _) in enumerate(rows)]


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_jaccard_components(corpus, monkeypatch):
    docs, rows = corpus
    monkeypatch.setattr(ngram_jaccard, "UNIT", 4)  # salted units
    got = [tuple(r) for r in ngram_jaccard.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect()]
    assert in_order(got) == in_order(brute_components(rows))


def test_jaccard_does_not_depend_on_the_order_hints(corpus, monkeypatch):
    docs, rows = corpus
    monkeypatch.setattr(ngram_jaccard, "HINTS", 3)
    got = [tuple(r) for r in ngram_jaccard.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect()]
    assert in_order(got) == in_order(brute_components(rows))


def test_deduplicated_keeps_one_of_each_group(corpus):
    docs, rows = corpus
    kept = ngram_jaccard.deduplicated(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect())
    want = sorted({(False, c) for _, n, c in brute_components(rows) if n} | {(False, i) for i, n, _ in brute_components(rows) if not n})
    assert got == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert ngram_jaccard.jaccard_components(docs).count() == 0
    assert decontaminate.contamination(docs, bench).count() == 0
    assert language.identify(docs, language.fit(docs)).count() == 0
    assert fingerprints.with_edits(docs).count() == 0
    assert pseudonyms.pseudonymised(docs).count() == 0
    assert mixing.mixed(docs).count() == 0
    assert licenses.scanned(docs).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.scored(docs, toxicity.fit(docs, labels)).count() == 0
    assert quality.scored(docs, quality.fit(docs, labels)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert page_text.extracted(pages, page_text.fit(pages)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, 101 + k) for k in range(50)] + [(5, 5), (7, None)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 151), 100)}


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute_contamination(rows, items):
    out = []
    for i, t in rows:
        w, hit, found = alnum(t), set(), set()
        for item, bt in items:
            b = alnum(bt)
            k = min(10, len(b))
            windows = {tuple(b[j : j + k]) for j in range(len(b) - k + 1)} if k else set()
            for p in range(len(w) - k + 1):
                if k and tuple(w[p : p + k]) in windows:
                    hit.update(range(p, p + k))
                    found.add(str(item))
        out.append((i, len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("piece", [500_000, 60])
def test_contamination(corpus, spark, monkeypatch, piece):
    docs, rows = corpus
    rng = random.Random(8)
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", piece)
    items = [(1, rows[3][1]), (2, " ".join(rows[5][1].split()[5:30]) + " other words here"), (3, "ONE-two"), (4, None), (5, ""), (6, text(rng, 30)), (7, rows[3][1]), (10, "two")]
    items.append((8, " ".join(rows[-5][1].split()[:9])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in decontaminate.contamination(docs, bench).collect()]
    want = brute_contamination(rows, items)
    assert in_order([(a, b, c, tuple(d)) for a, b, c, d in got]) == in_order([(a, b, c, tuple(d)) for a, b, c, d in want])
    left = decontaminate.decontaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == sum(not n for _, _, n, _ in want)


def test_a_text_that_repeats_a_passage_is_met_in_bounded_memory(monkeypatch):
    data = " ".join(["a b c"] * 14_000).encode()
    w = decontaminate.B.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), decontaminate.B.IS_ALNUM)
    item = w.hash[1:1000]
    test = decontaminate.TestSuffixes((["i"], np.array([0]), np.array([999]), np.array([0, 999]), item), 10)
    tracemalloc.start()
    row, doc, _, start, length = decontaminate.longest_matches(w, test)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6  # 14 million pairs of places would take four times that
    assert len(doc) == len(range(1, 41_991, 3)) + len(range(2, 990, 3))  # places of the item's first word, and the text's first word in the item
    assert all(s == 0 or d == 0 for d, s in zip(doc, start)) and length.max() == 999
    few = decontaminate.longest_matches(w, test)
    monkeypatch.setattr(decontaminate, "PAIRS_AT_ONCE", 777)
    assert all((a == b).all() for a, b in zip(few, decontaminate.longest_matches(w, test)))


def test_longest_matches_are_prolonged(spark):
    item = " ".join(f"w{k}" for k in range(25))
    docs = spark.createDataFrame([(1, "a b " + item + " c"), (2, " ".join(f"w{k}" for k in range(4, 17)))], "doc_id long, text string")
    bench = spark.createDataFrame([("q", item)], "item_id string, text string")
    got = {r["doc_id"]: [tuple(m) for m in r["matches"]] for r in decontaminate.with_matches(docs, bench).collect()}
    assert got == {1: [("q", 2, 0, 25)], 2: [("q", 0, 4, 13)]}


def test_language(spark):
    rng = random.Random(2)
    tongue = {"aa": "abcde", "bb": "fghij", "cc": "abfgk"}
    make = lambda lang: " ".join("".join(rng.choice(tongue[lang]) for _ in range(5)) for _ in range(30))
    rows = [(k, make(lang), lang, "s") for k in range(150) for lang in [list(tongue)[k % 3]]]
    extra = [(900, None, "aa", "s"), (901, "", "aa", "s"), (902, "12 34 !?", "bb", "s"), (903, "q", None, "s"), (904, make("bb") * 300, None, "s"), (0, rows[0][1], "aa", "s")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, score string")
    model = language.fit(docs.filter(language.learned(docs)))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs, model).collect()}
    assert all(got[k][0] == lang and 0 <= got[k][1] <= 1 for k, _, lang, _ in rows)
    assert [got[k] for k in (900, 901, 902)] == [("und", 0.0)] * 3 and got[904][0] == "bb" and got[903][1] == 0
    kept = language.recognised(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) + 2


def weights(t):
    c = collections.Counter(re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)))
    return {k: 1 + math.log(v) for k, v in c.items()}


def similarity(a, b):
    x, y = weights(a), weights(b)
    union = sum(max(x.get(k, 0), y.get(k, 0)) for k in x | y)
    return sum(min(x.get(k, 0), y.get(k, 0)) for k in x | y) / union if union else 1.0


def test_fingerprints(corpus, monkeypatch):
    docs, rows = corpus
    rows = [r for r in rows if r[0] is not None]
    docs = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = sorted(dict(rows).items())
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 7)
    got = {r["doc_id"]: r for r in fingerprints.with_edits(docs).collect()}
    assert len(got) == len(rows)
    errors = []
    for k, (i, t) in enumerate(rows):
        own, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        change = len(own) // 4
        new = own[: len(own) - change] + after[:change]
        assert got[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and got[i]["n_chars"] == len(own)
        errors += [got[i]["near_edited"] - similarity(own, new), got[i]["near_next"] - similarity(own, after)]
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    assert len({got[200 + k]["fingerprint"] for k in range(10)} | {got[1]["fingerprint"]}) == 1


def test_pseudonyms(spark):
    rows = [
        (1, "card 4111 1111 1111 1111, 4111111111111112 no"), (2, "mail x.y-1@mail.example.com! and 4111 1111 1111 1111"), (3, "2024-02-29 2024-02-30 31/12/1999 01.02.2003 1850-01-01"),
        (4, "10.0.0.1 256.1.1.1 1.2.3.4.5"), (5, "+1 (319) 555-5132 or 319-555-5132, 123-45-6789"), (6, None), (7, ""), (8, "nothing 12 here"), (9, "a" * 50_000 + " z@q.org"), (9, "z@q.org"),
    ]
    df = spark.createDataFrame(rows, "n long, text string").withColumn("found", F.lit(1))
    got = pseudonyms.pseudonymised(df, "k", count="hits")
    out = [(r["n"], r["text"], r["hits"]) for r in got.collect()]
    by = dict((a, b) for a, b, _ in out)
    assert [h for *_, h in out] == [1, 2, 3, 1, 3, 0, 0, 0, 1, 1]
    card = re.search(r"card (.{19}),", by[1])[1]
    luhn = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(card.replace(" ", "")))]
    assert sum(x - 9 * (x > 9) for x in luhn) % 10 == 0 and card in by[2] and card != "4111 1111 1111 1111" and "4111111111111112 no" in by[1]
    assert re.fullmatch(r"mail [a-z]\.[a-z]-\d@[a-z]{4}\.[a-z]{7}\.com! and .*", by[2]) and "x.y-1" not in by[2]
    a, b, c, d, e = by[3].split()
    assert (b, e) == ("2024-02-30", "1850-01-01")
    assert datetime.date.fromisoformat(a) and datetime.datetime.strptime(c, "%d/%m/%Y") and datetime.datetime.strptime(d, "%d.%m.%Y")
    assert all(int(x) < 256 for x in by[4].split()[0].split(".")) and by[4].endswith(" 256.1.1.1 1.2.3.4.5")
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} or \d{3}-\d{3}-\d{4}, \d{3}-\d\d-\d{4}", by[5]) and "5132" not in by[5]
    assert (by[6], by[7], by[8]) == (None, "", "nothing 12 here")
    assert pseudonyms.pseudonymised(df, "other").filter("n = 1").first()["text"] != by[1]


def test_pseudonyms_beside_other_numbers(spark):
    def luhn(t):
        d = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(re.sub(r"\D", "", t)))]
        return sum(x - 9 * (x > 9) for x in d) % 10 == 0

    card, plain = r"(\d{4} \d{4} \d{4} \d{4})", r"(\d{16})"
    cases = [
        ("4111 1111 1111 1111 123", card + " 123"), ("4111111111111111 12/27", plain + " 12/27"), ("7 4111 1111 1111 1111", "7 " + card),
        ("1235 4111 1111 1111 1111", "1235 " + card), ("4111 1111 1111 1111 12a", card + " 12a"), ("+1 4111 1111 1111 1111", r"\+1 " + card),
        ("4111 1111 1111 1111 5500-0000-0000-0004", card + r" (\d{4}-\d{4}-\d{4}-\d{4})"), ("4111 1111 1111 1111 319-555-5132", card + r" (?!319-555-5132)\d{3}-\d{3}-\d{4}"),
        ("77 123-45-6789 12", r"77 (?!123-45-6789)\d{3}-\d\d-\d{4} 12"), ("2024-03-05T10:00:00Z", r"(?!2024-03-05)\d{4}-\d\d-\d\dT10:00:00Z"),
        ("on 12/31/2024.", r"on (?!12/31/2024)\d\d/\d\d/\d{4}\."), ("02/29/2024", r"02/29/\d{4}"), ("02/29/2023 13/32/2024 12/31/1850", "02/29/2023 13/32/2024 12/31/1850"), ("1 " * 5_000, r"[\d ]+"),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "n long, text string")
    got = pseudonyms.pseudonymised(df, "k", count="hits").orderBy("n").collect()
    for (was, form), r in zip(cases, got):
        m = re.fullmatch(form, r["text"])
        assert m and all(luhn(x) and x not in was for x in m.groups()), (was, r["text"])
    assert [r["hits"] for r in got[:13]] == [1, 1, 1, 1, 1, 1, 2, 2, 1, 1, 1, 1, 0]
    assert datetime.datetime.strptime(got[10]["text"], "on %m/%d/%Y.").day > 12
    days = [f"{m:02d}/{d:02d}/{y}" for y in (1999, 2000) for m in range(1, 13) for d in range(13, 29)] + [f"02/29/{y}" for y in range(1904, 2100, 4)]
    new = [r[0] for r in pseudonyms.pseudonymised(spark.createDataFrame([(d,) for d in days], "text string"), "k").collect()]
    assert len(set(new)) == len(days) and all(datetime.datetime.strptime(x, "%m/%d/%Y").day > 12 for x in new)


def test_permutations_are_permutations(spark):
    n = spark.range(17 * 30)
    moved = n.select(pseudonyms.permuted_number(F.col("id"), 17, 30, "k", "t").alias("x"))
    assert sorted(r[0] for r in moved.collect()) == list(range(17 * 30))
    texts = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("t")).select(pseudonyms.permuted_text(F.col("t"), "k", "t").alias("x"))
    assert len({r[0] for r in texts.collect()}) == 1000


def brute_schedule(blocks, weight):
    """Slot by slot over all blocks, with a new schedule whenever a source runs out."""
    out, done = [], dict.fromkeys(blocks, 0)
    while any(done[s] < blocks[s] for s in blocks):
        active = {s: weight[s] for s in blocks if done[s] < blocks[s]}
        total, since, slot = sum(active.values()), dict(done), 0
        while all(done[s] < blocks[s] for s in active):
            ready = []
            for s, w in active.items():
                i = done[s] - since[s] + 1
                if (i - 1) * total // w <= slot:
                    ready.append((-(-i * total // w), -w, s))
            s = min(ready)[2]
            out.append((s, done[s]))
            done[s] += 1
            slot += 1
    return out


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["big"] * 12 + ["mid"] * 4 + ["low", None]), "t", 5) for k in range(700)] + [(3, "big", "t", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, slot int")
    weight = {"big": 3, "mid": 4, "low": 1, "": 2}
    got = mixing.mixed(docs, weight, block_docs=4)
    out = got.orderBy("position").collect()
    assert len(out) == len(rows) and len({r["position"] for r in out}) == len(rows)
    counts = collections.Counter(s or "" for _, s, *_ in rows)
    want = brute_schedule({s: -(-n // 4) for s, n in counts.items()}, weight)
    slots = sorted({(r["slot"], r["source"] or "", r["block"]) for r in out})
    assert [(s, b) for _, s, b in slots] == want and [t for t, *_ in slots] == list(range(len(want)))
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in out)
    assert mixing.mixed(docs, weight, block_docs=4).select("doc_id", "position").exceptAll(got.select("doc_id", "position")).isEmpty()


@pytest.mark.parametrize("most", [200_000, 0])
def test_mixing_many_sources(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", most)
    rows = [(k, f"s{k % 137 if k % 3 else 0}") for k in range(3_000)]
    weight = {f"s{k}": 1 + k % 7 for k in range(137)}
    out = mixing.mixed(spark.createDataFrame(rows, "doc_id long, source string"), weight, block_docs=2).orderBy("position").collect()
    counts = collections.Counter(s for _, s in rows)
    want = brute_schedule({s: -(-n // 2) for s, n in counts.items()}, weight)
    slots = sorted({(r["slot"], r["source"], r["block"]) for r in out})
    assert len(out) == len(rows) and [(s, b) for _, s, b in slots] == want and [t for t, *_ in slots] == list(range(len(want)))
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in out)


def test_more_languages_than_bits_of_a_word(spark):
    names = [f"l{k:02d}" for k in range(70)]
    letters = lambda k: [chr(0x4E00 + 40 * k + j) for j in range(5)]
    rng = random.Random(1)
    rows = [(k * 10 + j, "".join(rng.choice(letters(k)) for _ in range(60)), x) for k, x in enumerate(names) for j in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(docs, language.fit(docs)).collect()
    assert len(got) == len(rows) and all(r["lang_pred"] == r["lang"] for r in got)


def test_pfair_lag_is_below_one_block():
    weight = {"a": 90, **{f"s{k}": 1 for k in range(10)}}
    have = collections.Counter()
    for slot, (s, *_) in enumerate(mixing.one_period(weight), 1):
        have[s] += 1
        assert all(abs(have[x] - slot * w / 100) < 1 for x, w in weight.items())


PAGE = """<html><head><title>Head</title><style>p{}</style></head><body><nav><ul><li><a href=/a>Home</a><li><a>About us</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, please accept all of them now.</p></div><article><h1>A &amp; B</h1><p>First  paragraph, it has
some words, and it goes on.<p>Second &lt;one&gt;.<div class="ad">Buy this thing today.</div><p><b>Third one, with <a href=x>a link</a> in it.<br></article>
<div id="comments"><p>I think this is a great article. Thanks for it.</p></div><form><p>Your mail</p></form><footer>&copy; 2020</footer>"""


def test_page_text(spark):
    pages = [(k, "u", PAGE.replace("First", f"First{k}")) for k in range(20)] + [(50, "u", None), (51, "u", ""), (52, None, "<p>"), (53, "u", "<!-- a"), (0, "u", PAGE)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in page_text.extracted(frame, page_text.fit(frame)).collect()}
    want = "A & B First7 paragraph, it has some words, and it goes on. Second <one>. Third one, with a link in it."
    assert got[7] == (want, len(want)) and [got[k] for k in (50, 51, 52, 53)] == [("", 0)] * 4


def plain_tokens(page):
    """One regular expression over the page, which takes the square of the length on unclosed quotes."""
    token = re.compile(rf"<!--.*?(?:-->|\Z)|<({page_text.HIDDEN})\b[^>]*>.*?(?:</\1\s*>|(?=<body\b)|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|[^<]+|<", re.S | re.I)
    for m in token.finditer(page):
        if m[3]:
            yield "", m[2] + m[3].lower(), m[4]
        elif m[0][0] != "<" or m[0] == "<":
            yield m[0], "", ""


def test_page_tokens_are_those_of_a_plain_expression():
    rng = random.Random(3)
    bits = ["<p>", "</p>", "<a href='x>y'>", '<div class="a b">', "<", ">", "'", '"', "text ", "<!-- c -->", "<!--", "-->", "<script>", "</script >", "<body>", "<!doctype html>", "</", "<br/>", "<1", "<A ", "<style x", "<head>", "<header>", "\n"]
    for _ in range(3000):
        page = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        assert list(page_text.tokens(page)) == list(plain_tokens(page)), page


@pytest.mark.parametrize("piece", ["<a '", "<a \"x' ", "<script ", "<!", "<div>", "</p>", "<div></p>", "<p class='x", "<!--", "&amp", "<a href=\"'\" "])
def test_long_broken_pages_take_linear_time(piece):
    page, weights = piece * (400_000 // len(piece)), page_text.START
    for end in ("", "'\">", ">"):
        t = time.perf_counter()
        page_text.blocks(page + end)
        assert time.perf_counter() - t < 20


def test_min_cut_is_a_minimum():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randrange(1, 9)
        gain = [rng.uniform(-2, 2) for _ in range(n)]
        edges = {(a, b): rng.uniform(0, 2) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5}
        cost = lambda lab: sum((-g if x else g) for g, x in zip(gain, lab)) / 2 + sum(c for (a, b), c in edges.items() if lab[a] != lab[b])
        best = min(cost([m >> k & 1 for k in range(n)]) for m in range(2**n))
        assert abs(cost(page_text.min_cut(gain, edges)) - best) < 1e-6


def test_licenses(spark):
    rng = random.Random(6)
    mit = licenses.TEMPLATES["mit"]
    rows = [(1, text(rng, 50) + "\n" + mit), (2, "licensed UNDER the apache license; version 2.0"), (3, "the license of the version"), (4, None), (5, ""), (6, (mit + " ") * 3), (7, text(rng, 30_000))]
    rows.append((8, "Licensed under some Apache License, the Version 2.0"))
    got = {r["doc_id"]: [(m["license"], round(m["coverage"], 2)) for m in r["matches"]] for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string").withColumn("matches", F.lit(0))).collect()}
    assert got[1] == [("mit", 1.0)] and got[2] == [("apache-2.0", 1.0)] and got[6] == [("mit", 1.0)] * 3 and got[8] == [("apache-2.0", 0.88)]
    assert all(got[k] == [] for k in (3, 4, 5, 7))


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_licenses_without_single_words(spark):
    rows, want, around = [], {}, "some words before it"
    for name, notice in licenses.TEMPLATES.items():
        w = alnum(notice)
        for k in range(len(w)):
            want[len(rows)] = (name, w, (len(w) - 1) / len(w))
            rows.append((len(rows), " ".join([around, *w[:k], *w[k + 1 :], around])))
    gpl = licenses.TEMPLATES["gpl-3.0-header"].split(", or (at")[0]
    rows += [(9000, gpl), (9001, "x Licensed under CC BY-NC 4.0. y"), (9002, "Licensed under CC BY 4.0."), (9003, "Released under the MIT. Under the MIT License.")]
    got = {r["doc_id"]: r["matches"] for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (name, w, coverage) in want.items():
        if coverage >= 0.8:  # another notice may cover the same place with as many words
            assert any(m["license"] == name or m["coverage"] * len(alnum(licenses.TEMPLATES[m["license"]])) >= len(w) - 1 for m in got[k]), (k, name)
    assert [(m["license"], round(m["coverage"], 2)) for m in got[9000]] == [("gpl-3.0-header", 0.83)]
    assert [[m["license"] for m in got[k]] for k in (9001, 9002, 9003)] == [["cc-by-nc-4.0-line"], ["cc-by-4.0-line"], ["mit", "mit"]]


def test_license_places_are_those_of_brute_force(spark):
    rng = random.Random(8)
    notices = {"a": "k1 k2 k3 k4 k5", "b": "k2 k6 k7 k2 k8 k9 k1 k3 k5 k4"}
    rows = []
    for k in range(150):
        w = [x for name in rng.choices("ab", k=rng.randrange(1, 3)) for x in [*notices[name].split(), *["x"] * rng.randrange(6)] if rng.random() > 0.12]
        for _ in range(rng.randrange(4)):
            w.insert(rng.randrange(len(w) + 1), rng.choice(["y", "k2", "k5", "k9"]))
        rows.append((k, " ".join(w)))
    for name, notice in notices.items():
        n = notice.split()
        got = {r["doc_id"]: r["matches"] for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string"), {name: notice}).collect()}
        for k, t in rows:
            w = t.split()
            best = max((longest(w[s : s + 4 * len(n)], n) for s in range(len(w))), default=0)
            assert bool(got[k]) == (best >= 0.8 * len(n)), (k, t)
            for m in got[k]:
                assert longest(w[m["start_word"] : m["end_word"]], n) == round(m["coverage"] * len(n)) >= 0.8 * len(n)
                assert len(licenses.aligned(w[m["start_word"] : m["end_word"]], n)) <= round(m["coverage"] * len(n))


def test_license_matches_are_those_of_all_patience_alignments(spark):
    rng = random.Random(11)
    notice = "k1 k2 k3 k2 k4 k5 k6 k7 k8 k9".split()
    rows = []
    for k in range(60):
        w = [x for x in notice * rng.randrange(1, 3) if rng.random() > 0.1]
        for _ in range(rng.randrange(5)):
            w.insert(rng.randrange(len(w) + 1), rng.choice(["y", "k2", "k5", "k9"]))
        if rng.random() < 0.3 and len(w) > 4:
            i = rng.randrange(len(w) - 3)
            w[i : i + 3] = w[i : i + 3][::-1]
        rows.append((k, " ".join(w)))
    got = {r["doc_id"]: r["matches"] for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string"), {"n": " ".join(notice)}).collect()}
    for k, t in rows:
        w = t.split()
        best = max((len(licenses.aligned([x for x in w[a:b] if x in notice], notice)) for a in range(len(w)) for b in range(a + 1, min(len(w), a + 40) + 1)), default=0)
        assert bool(got[k]) == (best >= 8), (k, t)
        for m in got[k]:
            assert len(licenses.aligned([x for x in w[m["start_word"] : m["end_word"]] if x in notice], notice)) == round(m["coverage"] * 10) >= 8


def test_short_notices_do_not_take_another_name(spark):
    lines = {
        "Released under the ISC License.": "isc", "Released under the terms of the License.": "unnamed", "Released under the Foo License.": "unnamed", "Licensed under the LGPL License, Version 2.0.": "unnamed-2.0",
        "Released under the MIT License.": "mit", "Released under the BSD License.": "bsd-line", "Licensed under the Apache License, Version 2.0.": "apache-2.0", licenses.TEMPLATES["mit-full"]: "mit-full",
    }
    rows = [(k, f"some words before it {t} and after it") for k, t in enumerate(lines)]
    got = {r["doc_id"]: [m["license"] for m in r["matches"]] for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(rows))] == [[x] for x in lines.values()]


def test_patience_alignment_is_increasing_and_equal():
    rng = random.Random(5)
    for _ in range(50):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(20))] for _ in "ab")
        pairs = licenses.aligned(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert licenses.increasing([(0, 3), (1, 1), (2, 2), (3, 0), (4, 5)]) == [(1, 1), (2, 2), (4, 5)]


def labelled(spark, column, bad):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(400):
        mark = int(rng.random() < 0.3)
        t = text(rng, rng.choice([20, 60, 150]))
        rows.append((k, bad(rng, t) if mark else t, "en", f"s{k % 5}", len(t)))
        labels.append((k, mark if column == "toxic" else 1 - mark))
    rows += [(900, None, None, None, None), (901, "", "en", "s0", 0), (902, text(rng, 20_000), "en", "s0", 9), (0, rows[0][1], "en", "s0", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("x"))
    return docs, spark.createDataFrame(labels + [(5, None), (None, 1), (6, 7)], f"doc_id long, {column} int"), dict(labels)


def test_toxicity(spark):
    def bad(rng, t):
        w = t.split()
        w.insert(rng.randrange(len(w)), rng.choice(["vilest", "vileness", "vilely"]))
        return " ".join(w)

    docs, labels, want = labelled(spark, "toxic", bad)
    net = toxicity.fit(docs, labels.filter(toxicity.learned(labels)))
    out = [(r["doc_id"], r["score"]) for r in toxicity.scored(docs, net).collect()]
    held = {r[0] for r in docs.filter(~toxicity.learned(docs)).select("doc_id").collect()}
    assert len(out) == docs.count() and all(0 <= s <= 1 for _, s in out)
    assert np.mean([(s >= 0.5) == want[i] for i, s in out if i in held and i in want]) > 0.9


def test_network_gradient():
    x = toxicity.inputs(np.frombuffer(b"one two three four five six one two", np.uint8), np.array([0, 35]))
    rng = np.random.default_rng(0)
    index, _ = toxicity.windows(x)
    for seed in range(2):
        net = toxicity.new_network(np.zeros(toxicity.WORDS, np.float32), np.zeros(toxicity.CHARS, np.float32), seed)
        loss = [toxicity.train_batch(net, x, index, np.ones(1, np.float32), np.ones(1, np.float32), 0.02) for _ in range(30)]
        assert loss[-1] < 0.5 * loss[0]
    assert rng is not None


def test_quality(spark):
    docs, labels, want = labelled(spark, "quality", lambda rng, t: " ".join(w + rng.choice(["###", "%%%"]) for w in t.split()))
    model = quality.fit(docs, labels.filter(quality.learned(labels)))
    out = [(r["doc_id"], r["score"]) for r in quality.scored(docs, model).collect()]
    held = {r[0] for r in docs.filter(~quality.learned(docs)).select("doc_id").collect()}
    assert len(out) == docs.count() and all(0 <= s <= 1 for _, s in out)
    assert np.mean([(s >= 0.5) == want[i] for i, s in out if i in held and i in want]) > 0.95


def test_entities_are_decoded_once():
    assert page_text.main_text("<article><p>&amp;lt; x</p></article>", page_text.START) == html.unescape("&amp;lt; x")


def test_spellings_of_a_number_share_its_pseudonym(spark):
    digits = lambda t: re.sub(r"\D", "", t)
    cards = ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "41111111 1111-1111"]
    phones = ["(319) 555-5132", "319-555-5132", "319.555.5132", "(319)555-5132"]
    abroad = ["+1 319 555 5132", "+13195555132", "+1 (319) 555-5132", "+1-319-555-5132"]
    other = ["+49 30 1234567", "+49301234567", "+353 1 234 5678", "+353 1234 5678"]
    social = ["123-45-6789", "899-99-9999", "665-01-0001", "667-01-0001", "001-01-0001", "900-70-1234", "000-12-3456", "666-12-3456", "123-00-4567", "123-45-0000"]
    texts = cards + phones + abroad + other + social
    got = [r["text"] for r in pseudonyms.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "n long, text string").coalesce(1), "k").orderBy("n").collect()]
    out = dict(zip(texts, got))
    assert all(re.sub(r"\d", "0", a) == re.sub(r"\d", "0", b) for a, b in out.items())
    assert len({digits(out[c]) for c in cards}) == 1 and digits(out[cards[0]]) != digits(cards[0])
    assert len({digits(out[p]) for p in phones}) == 1 and {digits(out[p]) for p in abroad} == {"1" + digits(out[phones[0]])}
    assert digits(out[other[0]]) == digits(out[other[1]]) and out[other[0]].startswith("+49 ") and digits(out[other[2]]) == digits(out[other[3]]) and digits(out[other[2]]).startswith("353")
    real = lambda t: "001" <= t[:3] <= "899" and t[:3] != "666" and t[4:6] != "00" and t[7:] != "0000"
    assert all(real(out[t]) and out[t] != t for t in social[:5]) and "900" <= out[social[5]][:3] <= "999" and out[social[5]] != social[5]
    assert [out[t] for t in social[6:]] == social[6:]
    some = [f"{a:03d}-{g:02d}-{s:04d}" for a in (1, 665, 667, 899, 950) for g in (1, 50, 99) for s in (1, 77, 9999)]
    new = [r[0] for r in pseudonyms.pseudonymised(spark.createDataFrame([(t,) for t in some], "text string"), "k").collect()]
    assert len(set(new)) == len(some) and all(real(t) or "900" <= t[:3] <= "999" for t in new)


def test_weights_follow_the_roots_for_any_number_of_sources():
    for n in (2, 20, 200, 1_000):
        counts = {f"s{k}": 60 * (k + 1) ** 2 for k in range(n)}  # roots 1 : 2 : 3 ...
        w = mixing.root_weights(counts)
        whole = sum(w.values())
        roots = sum(range(1, n + 1))
        assert all(abs(w[f"s{k}"] - max(1, (k + 1) * whole / roots)) <= 1 + (k + 1) * 0.02 for k in range(n))
    some = mixing.root_weights({f"s{k}": n for k, n in enumerate([100] * 100 + [6_000] * 100)})
    assert some["s199"] / some["s0"] == pytest.approx(60**0.5, rel=0.1)
    many = mixing.root_weights({f"s{k}": 2 + (k * 5_000) for k in range(5_000)})
    assert many["s0"] == 1 and many["s4999"] >= 5 and sum(many.values()) <= 30_000
