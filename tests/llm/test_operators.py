"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from emipanel.llm import fagin, jaccard, langid, mixing, packing, pii, quality, substring, urls, vptree

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(autouse=True)
def checkpoints(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 5))) for _ in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 80, 300]))] for _ in range(30)]
    passage = [rng.choice(vocabulary) for _ in range(70)]
    texts = [" ".join(b) for b in base]
    for _ in range(60):  # near copies, some close to the limit
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 1 + len(words) // 25)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append("\n".join(words))
    texts += [" ".join(rng.choices(vocabulary, k=40) + passage + rng.choices(vocabulary, k=40)) for _ in range(10)]
    texts += ["the " * 300, "a b " * 200, "a b " * 200, "", " \t", None, None, "Éa\xa0b c", "x", "X", " ".join(vocabulary * 20)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 7 == 0 else f"s{i % 3}", 1, "x") for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, component_id int, n_words string").repartition(4)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def words(text):
    return WORD.findall(text or "")


def test_repeats(docs, empty):
    seen, want = {}, {}
    for i, t in corpus():
        w = words(t)
        cut = set()
        for k in range(len(w) - 49):
            if seen.setdefault(tuple(w[k:k + 50]), i) < i:
                cut.update(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in cut)
        want[i] = (len(w), len(cut), hashlib.sha256(kept.encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.without_repeats(docs).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 500
    assert substring.without_repeats(empty).count() == 0


def test_repeats_in_texts_that_share_an_id(spark):
    long, short, tail = ([f"{c}{i}" for i in range(n)] for c, n in (("l", 160), ("s", 20), ("t", 70)))
    rows = [(1, long[100:]), (2, long), (2, short), (2, tail), (2, long[100:] + tail), (3, tail + short), (3, tail + short), (4, short)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(3)
    seen = {}
    for i, w in rows:
        for k in range(len(w) - 49):
            seen[tuple(w[k:k + 50])] = min(i, seen.get(tuple(w[k:k + 50]), i))
    want = []
    for i, w in rows:
        cut = {x for k in range(len(w) - 49) if seen[tuple(w[k:k + 50])] < i for x in range(k, k + 50)}
        want.append((i, len(w), len(cut), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in cut).encode()).hexdigest()))
    assert sorted(map(tuple, substring.without_repeats(df).collect())) == sorted(want)
    assert sorted(x[2] for x in want) == [0, 0, 0, 0, 60, 60, 70, 70]


def test_jaccard(docs, empty):
    sets = {}
    for i, t in corpus():
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(docs).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert jaccard.similar_documents(empty).count() == 0


def test_jaccard_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(5, text), (5, text), (2, text), (None, text)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.similar_documents(df).collect())) == [(2, 36, 2), (5, 36, 2)]


def test_jaccard_texts_that_share_an_id(spark):
    """Each text of a document is compared with its own set, not with that of the document's first text."""
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    texts = spark.createDataFrame([(1, one), (1, two), (2, two)], "doc_id long, text string").withColumn("text", F.col("text").cast("binary"))
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    got = jaccard.overlaps(pairs.coalesce(1), texts.coalesce(1), 5, "bigint").collect()
    assert sorted((r.common, r.either) for r in got) == [(0, 112), (56, 56)]


def test_jaccard_group_at_the_limit(spark):
    """Copies of one text at similarities around the limit, to it and to each other: links must survive all products."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(90):
        w = list(base)
        for at in rng.sample(range(120), rng.randint(1, 6)):
            w[at] = f"x{rng.randrange(60)}"
        texts.append(w)
    sets = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    assert len(set(label)) > 5
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in jaccard.similar_documents(df).collect()} == dict(enumerate(label))


def test_jaccard_fewest_shared_columns(spark):
    """The bound of a column's sizes is the smallest over all of them, also where only one of its ceilings steps."""
    for num, den in ((75, 100), (3, 10)):
        spans = [(n, lo, hi) for n in (5, 12, 30, 31, 57) for lo in range(-(-n * num // den), n * den // num + 1, 3) for hi in range(lo, n * den // num + 1)]
        df = spark.createDataFrame(spans, "n long, lo long, hi long").select("*", jaccard.fewest_shared("n", "lo", "hi", num, den).alias("k"))

        def least(n, b):
            return max(-(-(n + b) * num // (num + den)) - -(-max(n, b) * num // den) + 1, 1)
        assert [r for r in df.collect() if r.k != min(least(r.n, b) for b in range(r.lo, r.hi + 1))] == []


def test_jaccard_keeps_links_beside_larger_partners(spark):
    """Sizes 30 and 35 link by two deciding n-grams; the many of size 36 in the same columns would have to share three."""
    passage = [f"p{i}" for i in range(32)]
    own = {i: 8 for i in range(40)} | {40: 2, 41: 7}
    texts = {i: passage + [f"d{i}-{k}" for k in range(n)] for i, n in own.items()}
    sets = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for i, w in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert links == [(40, 41)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.component_id for r in jaccard.similar_documents(df).collect()} == {i: 40 if i == 41 else i for i in texts}


def column_lists(spark, sets, n):
    """Lists as open_lists gives them: a component per document, columns in one order common to all."""
    rows = [(i, n, i, i, 0.0, [(1, g, 1) for g in sorted(s)], len(s), 1) for i, s in enumerate(sets)]
    return spark.createDataFrame(rows, "doc_id long, n long, component_id long, star long, far double, cells array<struct<m:int,gram:long,k:long>>, cols int, k long")


def test_jaccard_pairs_meet_once(spark):
    lists = column_lists(spark, [set(range(60)) for _ in range(20)], 240)
    met = [(r.a, r.b) for r in jaccard.meetings(lists, 75, 100).collect()]
    assert sorted(met) == [(a, b) for a in range(20) for b in range(a + 1, 20)]


def test_jaccard_pairs_that_meet_hold_all_that_share_enough(spark):
    rng = random.Random(3)
    pool = [[*rng.sample(range(400), 14)] for _ in range(4)]
    # runs of shared columns with gaps longer and shorter than what is looked back at
    sets = [{g for g in rng.choice(pool) if rng.random() < 0.8} | {*rng.sample(range(400), rng.choice((2, 12, 40)))} for _ in range(50)]
    lists = column_lists(spark, sets, 48)
    need = 42 - 36 + 1
    expected = {frozenset((a, b)) for a in range(50) for b in range(a) if len(sets[a] & sets[b]) >= need}
    got = [frozenset((r.a, r.b)) for r in jaccard.possible_pairs(lists, 75, 100).collect()]
    assert expected and set(got) == expected and len(got) == len(expected)


def test_jaccard_lists_are_sorted_once(spark):
    entries = spark.createDataFrame([(1, 1, 9, 1, 1, 0.0), (1, 2, 9, 2, 2, 0.0), (2, 1, 9, 1, 1, 0.0)], "gram long, doc_id long, n long, component_id long, star long, far double")
    lists = jaccard.open_lists(entries, 75, 100)
    # the second would have to share two columns and has one
    assert {r.doc_id: (r.cols, [c.gram for c in r.cells]) for r in lists.collect()} == {1: (2, [2, 1]), 2: (0, [])}
    plan = lists._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [line for line in plan if re.search(r"Filter .*lambda", line)]


def test_jaccard_word_hashes():
    rng = random.Random(4)
    hashes = jaccard.WordHashes()
    texts = ["".join(rng.choice("ab\u00e9 \t\x0b\x1c\x85\n") for _ in range(rng.randrange(60))).encode() for _ in range(400)] + [b" x" * 20000 + b"y" * 70 + b" ab", b"\0 \0\0 ab"]
    met = {}
    for text in texts:
        got = hashes(text).tolist()
        assert len(got) == len(text.split())
        for word, h in zip(text.split(), got):
            assert met.setdefault(word, h) == h
    assert len(set(met.values())) == len(met) and len(hashes(None)) == len(hashes(b"")) == len(hashes(b" \n")) == 0
    # strings on which sums of powers modulo 2 to the 64 collide
    thue = b"".join(b"ab"[bin(i).count("1") % 2:][:1] for i in range(2048))
    first, second = hashes(thue + b" " + thue.translate(bytes.maketrans(b"ab", b"ba"))).tolist()
    assert first != second


def test_mix(docs, empty):
    got = mixing.mix(docs, block=4, shard_words=1000).collect()
    size = {i: len(words(t)) for i, t in corpus()}
    assert {r.doc_id: r.size for r in got} == size
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(r.source, [r.target, 0, r.source_size])[1] += r.taken
    assert sum(t for t, _, _ in by.values()) == pytest.approx(1.5 * sum(size.values()))
    assert all(abs(t - k) <= 12 and t <= 2 * s for t, k, s in by.values())
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3), block=4, shard_words=1000).collect()))
    assert mixing.mix(empty).count() == 0


def test_seats_are_sainte_lague():
    rng = np.random.default_rng(0)
    for _ in range(60):
        w, total = rng.integers(0, 50, 6).astype(float), int(rng.integers(0, 60))
        want = np.zeros(6, int)
        for _ in range(total if w.sum() else 0):
            want[np.argmax(w / (2 * want + 1))] += 1
        got = mixing.seats(w, total, np.full(6, 10 ** 6))
        assert got.sum() == want.sum() and (np.sort(w / (2 * got + 1)) == np.sort(w / (2 * want + 1))).all()


def test_pack(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in corpus()}
    got = packing.pack(docs, window=256, open_windows=4).toPandas()
    for i, g in got.sort_values("start").groupby("doc_id"):
        assert list(g.start) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() == len(ids[i])
        for r in g.itertuples():
            assert zlib.crc32(np.array(ids[i][r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    assert set(got.doc_id) == set(ids)
    filled = []
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]]
        filled.append(g.length.sum())
    assert max(filled) <= 256 and sum(f < 256 for f in filled) <= 1
    assert packing.pack(empty).count() == 0


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in text.split(".")),
            "card": lambda: 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]()


def test_personal_data(spark):
    rng = random.Random(3)
    bits = ["a@b.c", "@", ".", "1.2.3.4", "4111 1111 1111 1111", "5000677111630122", "+1 (652) 555-4544", "+", "-", " ", "x.y@z", "é", "256", "0", "007",
            "x+1@d-e.fr", "(", ")", "1", "token = \"04dbebab91ab\"", "IBAN DE89370400440532013000", "https://h.org/users/jane"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(1500)] + ["a@b.c@d.e", "9" * 5000, "a" * 3000 + "@", None, ""]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id int, text string, spans string")
    for r in pii.personal_data(df).collect():
        text = texts[r.doc_id] or ""
        want = [(k, m.start(), m.end()) for k, p in BASE for m in re.finditer(p, text) if valid(k, m.group())]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans.startswith(joined), text
    text = "mail me: a@b.c, token = \"04dbebab91ab\", https://h.org/users/jane!"
    assert pii.redact(text, pii.find_spans(text, pii.anchors())) == "mail me: [EMAIL], token = \"[ACCOUNT]\", https://[PROFILE]!"
    assert [r.text for r in pii.without_personal_data(df.filter("text is null or doc_id = 1500")).orderBy("text").collect()] == [None, "[EMAIL]@d.e"]


def test_language(spark):
    rng = random.Random(5)
    stock = {"aa": ["the", "and", "shing", "ation"], "bb": ["das", "und", "keit", "schön"], "cc": ["que", "ción", "para", "él"]}
    rows = [(i, " ".join(rng.choices(stock[lang], k=40)), lang) for i, lang in enumerate(list(stock) * 40)]
    filters = langid.learn(spark.createDataFrame([*rows, (900, None, "aa"), (901, "zzz", None)], "doc_id long, text string, lang string"))
    new = [(i, " ".join(rng.choices(stock[lang], k=9)), lang) for i, lang in enumerate(list(stock) * 5)]
    more = [(100, None, "und"), (101, "", "und"), (102, "12 ..! ²", "und"), (103, "的", "cc")]
    got = langid.identify(spark.createDataFrame([*new, *more], "doc_id long, text string, score string"), filters).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {i: lang for i, _, lang in [*new, *more]}
    assert all(0 <= r.score <= 1 for r in got)
    nothing = langid.learn(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert nothing.decide(b"abc") == ("und", 0.0)


def test_language_filters_hold_every_ngram(spark):
    texts = [("en", "the quick brown fox"), ("de", "der schnelle fuchs"), ("en", "fox"), *[(f"l{i}", f"word{'abcdefgh'[i]} qz{'hgfedcba'[i]}q") for i in range(8)]]
    filters = langid.learn(spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string"))
    assert len(filters.planes) == 4 and len(filters.languages) == 10  # two planes of all n-grams, two of the common ones
    holds: dict[int, set[str]] = {}
    for lang, t in texts:
        for g in langid.grams(t.encode()).tolist():
            holds.setdefault(g, set()).add(lang)
    at = langid.probes(np.array(list(holds), np.uint64), len(filters.planes[0]))
    for k, lang in enumerate(filters.languages):
        found = [bool((filters.planes[k // 8][a] & filters.planes[k // 8][b]) >> (k % 8) & 1) for a, b in zip(*at)]
        assert all(f for f, langs in zip(found, holds.values()) if lang in langs)  # a Bloom filter forgets nothing
        assert sum(f for f, langs in zip(found, holds.values()) if lang not in langs) <= 1
    assert [filters.decide(t.encode())[0] for _, t in texts] == [lang for lang, _ in texts]
    assert filters.decide(b"\xe7\x9a\x84")[1] == 0.0


def test_quality(spark):
    rng = random.Random(9)
    good, bad = ["the", "of", "river", "Stone"], ["BUY!!", "x%%%", "|"]
    rows = [(i, " ".join(rng.choices(bad if i % 4 == 0 else good, k=60))) for i in range(400)]
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(200)] + [(None, 1), (7, None), (1, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert all(got[i].predicted == int(i % 4 != 0) for i in range(200, 400))
    assert got[1000].score == got[1001].score and all(0 <= r.score <= 1 for r in got.values())
    assert quality.fit(docs, labels.filter("false")).score(np.zeros(0, np.int64)) == 0.5


def test_urls(spark):
    rows = [(1, "http://shop.com/a"), (2, "HTTP://Example.COM/en/x?y"), (3, "https://www.example.com/en/"), (4, "http://a.net/es/1"), (5, "http://a.org#/x"),
            (6, None), (7, "nothing"), (8, "http://notcom/a"), (9, "http://x.com"), (10, "http://blog.www.example.com/en/1")]
    df = spark.createDataFrame([(*r, "<p>the cat</p>", "z") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert {i: r.rule for i, r in got.items()} == {1: "com/", 2: "example.com/en/", 3: "www.example.com/en/", 4: "net/es/", 5: None, 6: None, 7: None,
                                                   8: None, 9: None, 10: "www.example.com/en/"}
    assert (got[2].host, got[2].path, got[5].host, got[5].path, got[6].host, got[7].path) == ("example.com", "/en/x", "a.org", "", "", "")
    assert (got[1].verdict, got[2].verdict, got[3].verdict, got[4].verdict) == ("allow", "block", "allow", "block")
    assert urls.segment("freebetsxq", {"free": -1.0, "bets": -2.0, "be": -3.0}) == ["free", "bets", "xq"]
    assert urls.judge(df.filter("false")).count() == 0


def plain_verdicts(pages, rules=urls.RULES):
    """Verdicts and scores of (page_id, url, html), by plain counting."""
    import math
    import re
    from collections import Counter

    words = Counter(w for _, _, html in pages if html
                    for w in re.findall("[a-z]+", re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ", html).lower()) if len(w) <= 63)
    total = sum(words.values())
    logs = {w: math.log(n / total) for w, n in words.items()}
    floor = min(logs.values()) - 2

    def best(name):
        found = [(0.0, [])]
        for end in range(1, len(name) + 1):
            found.append(max(((found[i][0] + logs.get(name[i:end], floor - 3 * (end - i)), found[i][1] + [name[i:end]]) for i in range(max(0, end - 63), end)),
                             key=lambda x: x[0]))
        return found[-1][1]

    def parts(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0].lower()
        return host, re.match(r"[^?#]*", rest[len(host):])[0]

    def tokens(host, path):
        out = []
        for p in re.findall("[a-z]+|[0-9]+", ".".join(host.split(".")[:-1] or [host])):
            out += ["h:" + w for w in (best(p) if p[0].isalpha() else "0")]
        return out + ["p:" + (p if p[0].isalpha() else "0") for p in re.findall("[a-z]+|[0-9]+", path.lower())]

    def ruled(host, path):
        fits = [(len(r), v) for r, v in rules for name, start in [r.split("/", 1)]
                if (host == name or host.endswith("." + name)) and path.startswith("/" + start)]
        return max(fits)[1] if fits else None

    count, docs = {"block": Counter(), "allow": Counter()}, Counter()
    for _, url, _ in pages:
        if v := ruled(*parts(url)):
            docs[v] += 1
            count[v].update(tokens(*parts(url)))
    known = set(count["block"]) | set(count["allow"])
    norm = {v: math.log(sum(count[v].values()) + len(known) + 1) for v in count}
    out = {}
    for i, url, _ in pages:
        verdict, score = ruled(*parts(url)), None
        if verdict is None:
            one = {v: math.log(docs[v] + 1) + sum(math.log(count[v][t] + 1) - norm[v] for t in tokens(*parts(url))) for v in count}
            score = round(one["block"] - one["allow"], 6)
            verdict = "block" if score > 0 else "allow"
        out[i] = (verdict, score)
    return out


def test_urls_against_plain_counting(spark):
    rng = np.random.default_rng(8)
    words = ["free", "bets", "news", "daily", "cat", "casino", "win", "x" * 70, "e"]

    def name():
        return "".join(rng.choice(words[:7], rng.integers(1, 4)))

    pages = []
    for i in range(160):
        host = f"{name()}{rng.integers(0, 9) or ''}.{name()}.{rng.choice(['com', 'net', 'org', 'de'])}"
        path = "/" + "/".join(rng.choice(["es", "fr", "en", "A7", name(), "win"], rng.integers(0, 4)))
        html = f"<p title='a>b'>{' '.join(rng.choice(words, 12))}</p><SCRIPT>cat win</Script ><style>e{'</style>' if i % 9 else ''} <script bets"
        pages.append((i, f"http://{host}{path}?q=1", None if i % 17 == 0 else html))
    pages += [(200, "http://example.com/en/", ""), (201, None, "cat"), (202, "x", "<"), (203, "http://LOCALHOST", ">"), (203, "http://LOCALHOST", ">"),
              (204, "http://" + "qz" * 500 + ".org/" + "cat/" * 3000, None), (205, "http://.org\n", "<b"), (None, "http://a.b.org/1", "bets")]
    df = spark.createDataFrame([(*p, "z", 1) for p in pages], "page_id long, url string, html string, token string, n int")
    got = urls.judge(df).collect()
    assert len(got) == len(pages)
    assert {r.page_id: (r.verdict, None if r.score is None else round(r.score, 6)) for r in got} == plain_verdicts(pages)
    assert {r.verdict for r in got if r.score is not None} == {"block", "allow"}


def test_text_outside_tags_is_one_pass():
    import time

    start = time.time()
    for piece in (b"<script a ", b"<style>x</script", b"<", b"<script></script "):
        urls.outside_tags(piece * 40_000)
    assert time.time() - start < 5
    assert urls.outside_tags(b"a<B>c</b>D<script>e</script\n>f<").split() == [b"a", b"c", b"d", b"f", b"<"]


def vectors(seed=2):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(20)]
    return rows, [(400, None), (500, []), (600, [0.0] * 8), (700, [None] + [1.0] * 7), (800, [float("nan")] + [1.0] * 7)]


@pytest.mark.parametrize("factor", [1.0, 3.0])
def test_nearest(spark, factor):
    rows, odd = vectors()
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<float>, score int")
    got = [tuple(r) for r in vptree.nearest(df, df.filter("vec_id % 20 = 0"), k=5, factor=factor, shard=100, block=7).collect()]
    want = []
    for i, q in rows:
        if i % 20 == 0:
            scores = sorted(((-float(np.cumsum(np.array(q) * np.array(v))[-1]), j) for j, v in rows if j != i))[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scores)]
    if factor == 1.0:
        assert sorted(got) == sorted(want)
    assert len({(a, c) for a, _, c, _ in got} & {(a, c) for a, _, c, _ in want}) >= 0.9 * len(want)
    assert vptree.nearest(df.filter("false"), df.filter("false")).count() == 0


def test_top_scores(spark):
    rows, odd = vectors()
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<float>, rank int")
    whole = {i: np.floor(256 * np.array(v)).astype(int) for i, v in [*rows, odd[2]]}
    got = [tuple(r) for r in fagin.top_scores(df, df.filter("vec_id % 50 = 0"), shard=100, block=3).collect()]
    want = []
    for i, q in whole.items():
        if i % 50 == 0:
            scores = sorted((-int(q @ v), j) for j, v in whole.items() if j != i)[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scores)]
    assert sorted(got) == sorted(want)


def test_first_words(spark):
    df = spark.createDataFrame([(" a\tb  c\n", 2), ("é x", 1), ("a", 3)], "text string, n long")
    assert [r[0] for r in df.select(mixing.first_words(F.col("text"), F.col("n"))).collect()] == [" a\tb", "é", "a"]


def test_pipeline_stages_keep_the_columns(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    texts = [" ".join(rng.choices(["river", "stone", "walks", "under", "old", "the", "of", "tree"], k=80)) for _ in range(40)]
    texts += [texts[0], "BUY!! x%%% | " * 30, "write to a@b.com " + texts[1], None, ""]
    rows = [(i, t, "aa", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int("%" not in (t or "")), 0) for i, t in enumerate(texts)] * 2, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.schema == docs.schema
    kept = now.toPandas()
    assert 40 not in set(kept.doc_id) and not kept.text.str.contains("@").any()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
