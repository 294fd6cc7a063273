"""Token files, tokenizer alignment and the conversation trie against brute force."""

import gc
import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emipanel.llm import alignment, common, trie, wavelet

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "the", "Thé", "'s", "'", "s", "re", "1", "23", ".", ",", "!", " ", " ", "  ", "\n", "\n\n", " \n", "\n ", "\t", "\xa0", "　", "é", "ß", "中文", "😀",
         "<|endoftext|>", "<s>", "<0x41>", "▁", "​", "\r\n", "a.", "x,", ".", " .", " ,", "…", "\x1c", "ⅷ", "ﬁ", "\x00"]


@pytest.fixture(autouse=True)
def checkpoints(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def odd_texts(n, seed=2):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def corpus():
    rng = random.Random(8)
    prose = [" ".join(rng.choice(["under", "Thé", "standing.", "of,", "words\nand", "lines", "x1"]) for _ in range(rng.randint(1, 60))) for _ in range(25)]
    texts = [None, "", " ", "same text", "same text", *prose, *odd_texts(40), "z" * 150_000, "long words, many. " * 9000]
    return [*((i - 3 if i != 8 else None, t) for i, t in enumerate(texts)), (5, "another text of five"), (5, "another text of five"), (None, "no id")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1, 2.0, "y") for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, start int, words double, batch string").repartition(4)


# ---- files

@pytest.mark.parametrize("n,width", [(0, 16), (1, 1), (64, 5), (512, 3), (513, 16), (6000, 16)])
def test_wavelet_matrix(n, width):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 1 << width, n) if n < 6000 else rng.zipf(1.3, n) % 50_000
    matrix = wavelet.WaveletMatrix(n, *wavelet.WaveletMatrix.encode(ids, width))
    assert (matrix.decode() == ids).all() and (matrix.access(np.arange(n)) == ids).all()
    for token in {*ids[:20].tolist(), 0, (1 << width) - 1, 1 << width, -1}:
        for lo, hi in ((0, n), (n // 3, n - n // 5)):
            where = lo + np.nonzero(ids[lo:hi] == token)[0]
            assert (matrix.occurrences(token, lo, hi) == where).all() and matrix.count(token, lo, hi) == len(where)


def test_byte_encoder_equals_the_tokenizer():
    plain, special = Tokenizer.from_file(BYTES), wavelet.ByteEncoder(BYTES)
    for text in odd_texts(4000):
        assert special.ids(text.encode()).tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_column_equals_the_tokenizer():
    plain, encoder = Tokenizer.from_file(BYTES), wavelet.ByteEncoder(BYTES)
    texts = ["", " ", "", *odd_texts(3000, seed=5), "", "under Thé under", " under ", "\n", "it's 'tis x'll!!'s <|endoftext|>a.b.c"]
    for raw in ([t.encode() for t in texts], [b"bro\xffken \xc3 words", b"", b"whole words \xe2\x80"], [b""], []):
        ids, ends = encoder.column(pa.array(raw, pa.binary()))
        asked = [plain.encode(t.decode(errors="replace"), add_special_tokens=False).ids for t in raw]
        assert [part.tolist() for part in np.split(ids, ends[:-1])[:len(raw)]] == asked and ends.tolist() == np.cumsum(list(map(len, asked))).tolist()


def test_words_are_met_again_in_parts():
    encoder, asked = wavelet.ByteEncoder(BYTES), []
    encode, encoder.encode = encoder.encode, lambda piece: asked.append(piece) or encode(piece)
    words = [w + end for w in ("under", "standing", "Thé") for end in ("!!", "'s", "-17", ",!!", "")]
    encoder.column(pa.array([" ".join(words).encode(), " ".join(words[::-1]).encode()], pa.binary()))
    assert sorted(asked) == sorted({"!!", "'s", "-", "17", ",!!"})


def test_crc_of_joined_pieces():
    for cut in (0, 1, 7, 20):
        a, b = b"twenty bytes of text"[:cut], b"twenty bytes of text"[cut:]
        assert wavelet.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("segment", [97, 1 << 18])
def test_token_files(spark, docs, segment):
    tokenizer = Tokenizer.from_file(BYTES)
    ids = {t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for _, t in corpus()}
    files = wavelet.open_files(spark, wavelet.encode_to_files(docs, segment_tokens=segment))
    got = wavelet.documents(files).collect()
    want = Counter((i, len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())) for i, t in corpus())
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    # starts follow the ids of the documents, null first, and leave no gap
    order = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in order] == np.cumsum([0, *[r["n_tokens"] for r in order]])[:-1].tolist()
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in order]
    assert keys == sorted(keys)
    if segment == 97:
        everything = np.zeros(sum(r["n_tokens"] for r in got), np.int64)
        by_crc = {zlib.crc32(np.array(v, "<u4").tobytes()): v for v in ids.values()}
        for r in order:
            everything[r["start"]:r["start"] + r["n_tokens"]] = by_crc[r["ids_crc32"]]
        asked = [2, 262, 11, 50_255, 99_999]
        assert {r["token"]: r["n"] for r in wavelet.token_counts(files, asked).collect()} == {t: int((everything == t).sum()) for t in asked}
        found = wavelet.token_occurrences(files, [2, 11]).collect()
        assert sorted((r["token"], r["position"]) for r in found) == sorted((t, int(p)) for t in (2, 11) for p in np.nonzero(everything == t)[0])
        owner = {(r["start"] + r["n_tokens"] - 1): r["doc_id"] for r in order}
        assert all(owner[r["position"]] == r["doc_id"] for r in found if r["token"] == 2)
        places = spark.createDataFrame([(p,) for p in (0, 5, 96, 97, 98, 500, len(everything) - 1, len(everything), -1, None)], "position long")
        assert sorted(map(tuple, wavelet.tokens_at(files, places).collect())) == [(p, int(everything[p])) for p in (0, 5, 96, 97, 98, 500, len(everything) - 1)]


# ---- alignment

def aligned_by_hand(text):
    tokenizer, pieces = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    tokenizer.encode_special_tokens = True
    byte_of = {c: b for b, c in wavelet.ByteEncoder(BYTES).letters.items()}
    out = {}
    for t in {t for t in text if t}:
        a, b = tokenizer.encode(" " + t, add_special_tokens=False).ids, pieces.encode(t)
        a_bytes = [bytes(byte_of[c] for c in tokenizer.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + t).encode():
            continue
        a_ends, b_ends = (np.cumsum(list(map(len, x))).tolist() for x in (a_bytes, b_bytes))
        both, groups, i, j = set(a_ends) & set(b_ends), [], 0, 0
        a_at, b_at = {e: k + 1 for k, e in enumerate(a_ends)}, {e: k + 1 for k, e in enumerate(b_ends)}
        for end in sorted(both):
            groups.append((a[i:a_at[end]], b[j:b_at[end]]))
            i, j = a_at[end], b_at[end]
        links, j = [], 0
        for i, end in enumerate(a_ends):
            start = a_ends[i - 1] if i else 0
            while j and b_ends[j - 1] > start:
                j -= 1
            while b_ends[j] <= start:
                j += 1
            k = j
            while k < len(b) and (b_ends[k - 1] if k else 0) < end:
                links.append((a[i], b[k]))
                k += 1
        out[t] = len(a), len(b), groups, links
    return out


def test_alignment(docs):
    known = aligned_by_hand([t for _, t in corpus()])
    assert any(t and t not in known for _, t in corpus())
    count = Counter(link for _, t in corpus() if t in known for link in known[t][3])
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    want = []
    for i, t in corpus():
        if t not in known:
            want.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = known[t]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        want.append((i, n_a, n_b, len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    assert Counter(map(tuple, alignment.aligned(docs, batch_bytes=1000).collect())) == Counter(want)
    text = next(t for _, t in corpus() if t in known and 20 < len(t) < 400)
    one = docs.filter(F.col("text") == text).limit(1)
    got = alignment.token_groups(one).orderBy("group").collect()
    assert [(r["a_ids"], r["b_ids"]) for r in got] == known[text][2]
    assert got[0]["start"] == 0 and got[-1]["stop"] == len(text.encode()) + 1 and all(x["stop"] == y["start"] for x, y in zip(got, got[1:]))


@pytest.mark.parametrize("numbers", [[], [0], [1, 255, 256, 65_535, 65_536, (1 << 32) - 1], list(range(3000, 0, -1))])
def test_squeezed(numbers):
    assert alignment.unsqueezed(alignment.squeezed(np.array(numbers, np.int64))).tolist() == numbers


def test_aligned_batches_stay_small(spark, monkeypatch):
    """What a row of the stored batches, a row group of them and a worker's Arrow batch hold doesn't grow with a task's text."""
    rng = random.Random(4)
    syllables = ["an", "er", "tion", "the", "ing", "ou", "st", "re", "wh", "é"]
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 5))) for _ in range(60_000)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=10_000))) for i in range(90)], "doc_id long, text string").coalesce(1)
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    assert text_bytes > 7 << 20
    kept, plain = [], alignment.stored
    monkeypatch.setattr(alignment, "stored", lambda df, name, *more: kept.append((name, plain(df, name, *more))) or kept[-1][1])
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    got = alignment.aligned(docs)
    assert spark.conf.get(key) == before
    batches = dict(kept)["aligned"]
    sizes = batches.select(F.size("doc_id").alias("n"), sum(F.octet_length(c) for c in ("words", "word_links", "links")).alias("size")).collect()
    assert len(sizes) > 3 and sum(r["n"] for r in sizes) == 90 and max(r["size"] for r in sizes) < 1 << 20
    groups = [pq.ParquetFile(re.sub("^file:/+", "/", f)).metadata for f in batches.inputFiles()]
    assert max(g.row_group(i).num_rows for g in groups for i in range(g.num_row_groups)) <= alignment.GROUP_ROWS
    one = alignment.aligned(docs, batch_bytes=64 << 20)
    assert sorted(got.collect()) == sorted(one.collect())


def test_aligner_keeps_little(monkeypatch):
    rng = random.Random(5)
    words = list(dict.fromkeys("".join(rng.choices("aeinrst", k=rng.randint(3, 9))) for _ in range(20_000)))
    aligner = alignment.Aligner(BYTES, PIECES)
    first = aligner.learn(words)
    gc.collect()
    assert sum(map(sys.getsizeof, [*aligner.known.values(), *(x for r in aligner.known.values() if not isinstance(r, bytes) for x in r)])) < 170 * len(words)
    monkeypatch.setattr(alignment, "MEMO_WORDS", 1000)
    long = "x" * (wavelet.MEMO_CHARS + 1)
    for at in range(0, len(words), 500):
        assert aligner.learn([*words[at:at + 500], long, words[at] + "."])[:-2] == first[at:at + 500]
        assert long not in aligner.known
    assert len(aligner.known) + len(aligner.older) < 3500
    assert alignment.parts_of([b"", *aligner.learn(["a."])])[0].tolist()[0] == [0, 0, 0, 0]


def test_kept_in_worker_can_be_forgotten():
    assert common.kept_in_worker("kept by a test", lambda: [1]) is common.kept_in_worker("kept by a test", lambda: [2])
    common.forgotten_in_worker("kept by a test")
    common.forgotten_in_worker("kept by a test")
    assert common.kept_in_worker("kept by a test", lambda: [2]) == [2]
    common.forgotten_in_worker("kept by a test")


def test_empty_documents(docs):
    empty = docs.filter("false")
    assert wavelet.token_files(empty).count() == 0 and alignment.aligned(empty).count() == 0 and alignment.token_groups(empty).count() == 0


# ---- trie

def nodes_by_hand(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        turns = own.get(c - int(np.fmod(c, 20)), [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, leaves, saved = [], {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = sum(saved[k] for k in children[node]) + (len(members[node]) - 1) * words
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]), leaves[node], saved[node],
                    hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()))
    return Counter(out)


def conversations():
    rng = random.Random(6)
    say = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["hi", "hi there", "what is it", "", None, "a  b\tc", "long " * 30]))
    rows = []
    for c in [*range(-25, 60), 200, 201, 219]:
        rows += [(c, t, *say()) for t in range(rng.randint(1, 5))]
    rows += [(100, t, "user", f"turn {t}") for t in range(300)] + [(c, t, "user", f"turn {t}") for c in (119, 118, 139) for t in range(0, 300, 2)]
    rows += [(c, 0, "user", "the same") for c in range(1000, 1700)]  # one large group of copies
    rows += [(7, None, "user", "first"), (7, 1, "user", "tie"), (7, 1, "assistant", "tie"), (7, 1, "user", "tie"), (None, 0, "user", "nobody")]
    return rows


def test_trie(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, depth string").repartition(5)
    assert Counter(map(tuple, trie.prefix_trie(df).collect())) == nodes_by_hand(rows)


def test_empty_conversations_and_turnless_ones(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(df.filter("false")).count() == 0
    # crc32("1") % 4 = 3, so conversation 1 loses its only turn and has no base
    assert Counter(map(tuple, trie.prefix_trie(df).collect())) == nodes_by_hand([(1, 0, "user", "x")])
