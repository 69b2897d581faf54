"""The training-data operators against brute force on small tables with awkward rows."""

import hashlib
import random
import struct
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

T = pytest.importorskip("public_tokenizers")

from tidegrain.llm import bpe, decontaminate, html_text, ngram_join, pii, pretokens, quality, substring, token_orc, toxicity, warc  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, c string, hub long"


def docs_of(spark, rows):
    """Documents with columns whose names the operators use inside as well."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1) for i, t in rows], SCHEMA)


def vocabulary(seed=1, n=400):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    r, words = random.Random(7), vocabulary()
    base = [" ".join(r.choice(words) for _ in range(r.randint(1, 120))) for _ in range(60)]
    out = list(enumerate(base))
    for k in range(25):  # near copies: a few words changed
        w = base[k % 8].split()
        for _ in range(k % 4):
            w[r.randrange(len(w))] = r.choice(words)
        out.append((100 + k, " ".join(w).upper() if k % 2 else "\n ".join(w)))
    passage = " ".join(r.choice(words) for _ in range(45))
    out += [(200 + k, f"{base[k]} {passage}. {base[k + 9]}") for k in range(4)]
    out += [(300, None), (301, ""), (302, "one"), (303, "one"), (304, "ONE"), (305, "a b c"), (306, " \t\n\x0b\x0c\r "), (307, "日本 語 😀 ñ é"), (None, base[3]), (0, base[0]), (308, "ab " * 3000)]
    return out


def sets_of(text, n=4):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_ngram_join_brute_force(spark, rows):
    s = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b]):
            parent[find(a)] = find(b)
    expected = Counter()
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        expected[d, len(s[i]), min(ids) if ids else None] += 1
    got = ngram_join.components(docs_of(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected
    kept = {r.doc_id for r in ngram_join.keep_one(docs_of(spark, rows)).collect()}
    assert kept == {None} | {c for _, _, c in expected if c is not None}


def test_ngram_keep_one_counts_rows(spark):
    r, words = random.Random(6), vocabulary(5)
    a, b, c, d = (" ".join(r.choice(words) for _ in range(60)) for _ in range(4))
    near = a.replace(a.split()[30], "changed", 1)
    data = [(1, a), (1, a), (2, a.upper()), (None, near), (None, b), (None, b), (3, c), (3, a), (4, d), (4, d + " " + d.split()[0]), (5, ""), (5, ""), (6, None), (7, b + " " + " ".join(reversed(c.split())))]
    docs = docs_of(spark, data).repartition(3)
    kept = ngram_join.keep_one(docs, null_ids_stay=False)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    got = Counter((x.doc_id, x.text) for x in kept.collect())
    four = [x for x in got if x[0] == 4]
    assert len(four) == 1 and four[0] in data
    assert got == Counter([(1, a), (None, b), (3, c), *four, (5, ""), (5, ""), (6, None), data[-1]])
    got = Counter((x.doc_id, x.text) for x in ngram_join.keep_one(docs).collect())
    assert got == Counter([(1, a), (None, near), (None, b), (None, b), (3, c), *four, (5, ""), (5, ""), (6, None), data[-1]])


def test_ngram_prefixes_meet():
    r = np.random.default_rng(3)
    levels = r.integers(0, 4, 1 << 10).astype(np.uint64)
    for _ in range(300):
        a = np.unique(r.integers(0, 1 << 63, 60).astype(np.uint64))
        b = np.unique(np.concatenate([a[: r.integers(50, 60)], r.integers(0, 1 << 63, 3).astype(np.uint64)]))
        if 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)):
            assert all(len(np.intersect1d(ngram_join.prefix(a, levels, o), ngram_join.prefix(b, levels, o))) for o in range(ngram_join.ORDERS))


def test_ngram_filter_lets_all_wanted_rows_through(spark):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("text_key"), F.col("id").alias("extra"))
    keys = rows.filter("extra % 10 = 0").select(F.col("text_key").alias("key"))
    got = {r.extra for r in ngram_join.wanted(rows, "text_key", keys, 2000).collect()}
    assert got >= set(range(0, 20_000, 10)) and len(got) < 3000
    assert ngram_join.wanted(rows, "text_key", keys.limit(0), 0).isEmpty()


def test_ngram_frequency_levels(spark):
    r = random.Random(8)
    data = [(i, " ".join(r.choice("abcdefgh") + str(r.randrange(40)) for _ in range(60))) for i in range(50)] + [(100 + i, "the same four words") for i in range(900)]
    buckets = 2 * ngram_join.BLOCK
    exact = np.zeros(buckets, np.int64)
    for _, t in data:
        np.add.at(exact, (ngram_join.shingle_set(t) & np.uint64(buckets - 1)).astype(np.int64), 1)
    counts = ngram_join.survey(docs_of(spark, data).repartition(3), buckets).filter("kind = 1")
    levels = ngram_join.frequency_levels(counts, buckets)
    assert levels.max() == levels[exact.argmax()] > 0
    assert (levels == ngram_join._levels(exact, exact.mean())).all()
    assert not ngram_join.frequency_levels(counts.limit(0), buckets).any()


@pytest.mark.parametrize("window", [1, 5, 35])
def test_substring_brute_force(spark, rows, window):
    w = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(x[i : i + window]) for x in w for i in range(len(x) - window + 1))
    expected = Counter()
    for (d, _), x in zip(rows, w, strict=True):
        keep = [True] * len(x)
        for i in range(len(x) - window + 1):
            if seen[tuple(x[i : i + window])] > 1:
                keep[i : i + window] = [False] * window
        expected[d, len(x), keep.count(False), hashlib.sha256(b" ".join(a for a, k in zip(x, keep, strict=True) if k)).hexdigest()] += 1
    got = substring.digests(docs_of(spark, rows), window).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == expected


def test_substring_hash_collision(monkeypatch):
    monkeypatch.setattr(substring, "run_hashes", lambda h, size: np.zeros(len(h) - size + 1, np.uint64))
    ids = np.array([1, 2, 3, 9, 1, 2, 3, 4, 5], np.int32)
    assert substring.repeated_windows(ids, np.array([0, 1, 4, 6]), 3).tolist() == [True, False, True, False]


def test_substring_hot_minimiser_is_split(spark, rows):
    r, words = random.Random(4), vocabulary(3, 3000)
    # Runs of four words with the smallest hashes, each in many texts that share nothing else; some texts come twice.
    runs = [[f"h{i}", "x", "y", "z"] for i in range(20_000)]
    hot = min(runs, key=lambda w: int(substring.run_hashes(substring._hashes([x.encode() for x in w]), 4)[0]))
    long = hot + [r.choice(words) for _ in range(30)]
    text = lambda middle: " ".join([*(r.choice(words) for _ in range(40)), *middle, *(r.choice(words) for _ in range(40))])
    texts = [text(hot) for _ in range(300)] + [text(long) for _ in range(300)]
    data = list(enumerate(texts + texts[:5] + texts[-5:])) + rows
    window, bound = 35, 40_000
    docs = docs_of(spark, data).repartition(3)
    buckets = -(-3 * sum(len(t or "") for _, t in data) // bound)
    flags = substring.hot_slots(docs.fillna("", ["text"]), window, buckets, bound)
    assert flags[0].any() and flags[1].any()
    frame = __import__("pandas").DataFrame({"doc_key": [d or -1 for d, _ in data], "text_key": range(len(data)), "text": [t or "" for _, t in data]})

    def largest(hot):
        size = Counter()
        for b in substring.pack(iter([frame]), window, buckets, hot):
            for bucket, payload in zip(b["bucket"], b["payload"], strict=True):
                size[bucket] += len(substring.zstandard.decompress(payload)) if payload is not None else 0
        return max(size.values())

    assert largest(None) > 4 * bound and largest(flags) < 3 * bound
    spans = substring.marked(docs, window, bucket_bytes=bound).collect()
    got = Counter((x.doc_id, x.text, substring.kept_words(x.text, x.spans)[1:]) for x in spans)
    seen = Counter(tuple(w[i : i + window]) for _, t in data for w in [(t or "").encode().split()] for i in range(len(w) - window + 1))
    expected = Counter()
    for d, t in data:
        w = (t or "").encode().split()
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                keep[i : i + window] = [False] * window
        expected[d, t or "", (keep.count(False), b" ".join(a for a, k in zip(w, keep, strict=True) if k))] += 1
    assert got == expected


def test_substring_weights_do_not_depend_on_what_a_worker_keeps(monkeypatch):
    r, words = random.Random(6), vocabulary(3, 300)
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 300))) for _ in range(60)]
    sums = []
    for kept, portion in ((1 << 20, 8 << 20), (10, 2000)):
        monkeypatch.setattr(substring, "PORTION", portion)
        total = Counter()
        for b in substring.weigh(iter(texts), 35, 1 << 16, kept):
            for longer, slot, n in zip(b["longer"], b["slot"], b["bytes"], strict=True):
                total[longer, slot] += n
        sums.append(total)
    assert sums[0] == sums[1] and len(sums[0]) > 500


def test_substring_removed_of_awkward_rows(spark):
    twice = " ".join(f"w{i}" for i in range(40))
    docs = docs_of(spark, [(1, None), (2, ""), (None, "a  b"), (3, twice + " own"), (4, "x " + twice), (3, twice + " own")])
    assert sorted(((r.doc_id or 0, r.text) for r in substring.removed(docs).collect())) == [(0, "a b"), (1, ""), (2, ""), (3, ""), (3, ""), (4, "x")]
    assert substring.removed(docs.limit(0)).count() == 0


def test_bpe_like_tiktoken(spark, rows):
    import tiktoken

    path = T.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    more = [(400 + i, t) for i, t in enumerate(["a  b", "a   b", "", " a ", "getURL fooBar ÉcoleÀ x.y", "a \n b", "a\n \nb", "it's we'll 'S 12 3!!  \t\n", "x\x1c \x1cy", "<|endoftext|> x", "é" * 300])]
    got = {r.doc_id: r for r in bpe.encode(docs_of(spark, rows + more), path, T.PATTERN).collect()}
    digest = {r.doc_id: r for r in bpe.round_trip_digests(docs_of(spark, rows + more), path, T.PATTERN).collect()}
    for d, t in rows + more:
        ids = own.encode_ordinary(t or "")
        assert got[d].ids == ids and got[d].n_tokens == len(ids) and bytes(got[d].decoded) == (t or "").encode()
        assert (digest[d].n_tokens, digest[d].ids_sha256, digest[d].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    back = bpe.decode(spark.createDataFrame([(1, got[0].ids), (2, None)], "doc_id long, ids array<int>"), path, T.PATTERN)
    assert {r.doc_id: bytes(r.decoded) for r in back.collect()} == {1: rows[0][1].encode(), 2: b""}


def test_word_ids_are_those_of_whole_texts():
    import numpy as np
    import pyarrow as pa
    import regex
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=bpe.read_ranks(T.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})

    def merge(pieces):
        ids = [own._core_bpe.encode_single_piece(p.encode()) for p in pieces]
        return np.array([i for x in ids for i in x], "<i4"), np.array([len(x) for x in ids], np.int64)

    r = random.Random(5)
    texts = ["".join(r.choice(["a", "b", " ", " ", "\n", "\t", ".", "é", "\u00a0", "12", "'s"]) for _ in range(r.randint(0, 14))) for _ in range(4000)]
    # A small store starts anew every few batches.
    store = pretokens.WordIds(regex.compile(T.PATTERN).findall, merge, kept=150)
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        flat, sizes = store.lookup(pa.array(some, pa.string()))
        ends = np.cumsum(sizes)
        assert [flat[e - n : e].tolist() for e, n in zip(ends, sizes, strict=True)] == [own.encode_ordinary(t) for t in some]
    assert store.words.count < 1000


def test_token_orc_round_trip(spark, rows, tmp_path):
    from tokenizers import Tokenizer

    path = T.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    some = [x for x in rows if x[0] is not None and x != (0, rows[0][1]) or x is rows[0]]
    some += [(400 + i, t) for i, t in enumerate(["a <|endoftext|> b", "x<|endoftext|>", "<|endoftext|>", "it's.\nThe  end.\n x!?\n\ny 12,5% $a", " a", "a ", "z" * 300])]
    token_orc.write(docs_of(spark, some), str(tmp_path / "orc"), path, 2, 5)
    got = sorted(token_orc.read(spark, str(tmp_path / "orc")).collect(), key=lambda r: r.start)
    start, expected = 0, []
    for d, t in sorted(some, key=lambda x: x[0]):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        expected.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == expected
    found = token_orc.lookup(spark, str(tmp_path / "orc"), [302])
    assert [r.ids for r in found.collect()] == [[*tok.encode("one").ids, 2]]
    # As ordinary text, if asked for.
    tok.encode_special_tokens = True
    token_orc.write(docs_of(spark, [(1, "a <|endoftext|> b"), (None, "x"), (1, "a <|endoftext|> b")]), str(tmp_path / "plain"), path, 2, special_as_text=True)
    ids = [*tok.encode("a <|endoftext|> b", add_special_tokens=False).ids, 2]
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_orc.read(spark, str(tmp_path / "plain")).collect())
    assert got == [(0, None, 2), (2, 1, len(ids)), (2 + len(ids), 1, len(ids))]


def test_words_as_the_library_encodes_them():
    from tokenizers import Tokenizer

    pa = pytest.importorskip("pyarrow")
    path = T.path("byte_bpe_50k.json")
    tok, words = Tokenizer.from_file(path), token_orc._words(path, False)
    assert words.split.__self__.plain
    r = random.Random(1)
    parts = ["a", "B", "é", "ñ", " ", "  ", "\n", ".", " .", "'s", "'ll", " '", "1", " 3", "<|endoftext|>", "日", "\t", " ", "ß", "###", "$", "Ā", "ɏ", "ɐ", "×", "ª", "\r", "\x1c", "\x00"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 9))) for _ in range(5000)]
    ids, sizes = words.lookup(pa.array(texts))
    got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    small = pretokens.WordIds(words.split, words.merge, kept=20)
    for t, ids in zip(texts[:200], got, strict=False):
        assert small.lookup(pa.array([t, ""]))[0].tolist() == ids


def test_pii_against_plain_patterns():
    import re

    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    r = random.Random(2)
    for _ in range(20_000):
        t = "".join(r.choice("a@.1_-+ (9") for _ in range(r.randint(0, 30)))
        assert pii.emails(t) == [m.span() for m in email.finditer(t)]
        assert pii.ips(t) == [m.span() for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def check(digits):
        odd, even = digits[::-1][::2], digits[::-1][1::2]
        return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0

    for _ in range(20_000):
        t = "".join(r.choice(["1", "4", "0", "9", " ", "-", "+", "(", ")", ".", "x", "41111111", "+49 30"]) for _ in range(r.randint(0, 40)))
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        assert pii.cards(t) == [m.span() for m in card.finditer(t) if 16 <= len(digits(m)) <= 19 and check(digits(m))]
        assert pii.phones(t) == [m.span() for m in phone.finditer(t) if 8 <= len(digits(m)) <= 15]
        found = pii.find(t)
        kinds = [(k, a) for k, a, _, _ in found]
        assert kinds == sorted(kinds, key=lambda x: (pii.KINDS.index(x[0]), x[1]))
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE89370400440532013001")
    assert pii.ips("1" * 200_000) == [] and pii.emails("a" * 200_000) == []


def test_pii_tables(spark):
    text = "mail é a@b.co card 4111 1111 1111 1111 tel +49 (30) 1234-567 iban DE89 3704 0044 0532 0130 00 v 1.2.3.4"
    docs = docs_of(spark, [(1, text), (2, None), (3, ""), (1, text)])
    got = pii.digests(docs).collect()
    assert sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == [(1, 1, 1, 1, 1), (1, 1, 1, 1, 1), (2, 0, 0, 0, 0), (3, 0, 0, 0, 0)]
    base = "email:7:13,ip:96:103,card:19:38,phone:43:60"
    assert {r.base_sha256 for r in got if r.doc_id == 1} == {hashlib.sha256(base.encode()).hexdigest()}
    masked = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert masked[1] == "mail é [EMAIL] card [CARD] tel [PHONE] iban [IBAN] v [IP]" and masked[2] is None
    assert pii.redact(docs).columns == docs.columns


def test_pii_iban_before_other_words(spark):
    de, gb, no = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO9386011117947"
    for after in ("", " BIC COBADEFFXXX", " 2024", " A", ", X", f" {gb}", f" {no} 12", " AB12", "\nX", "é", " Bank"):
        for iban in (de, de.replace(" ", ""), gb, no):
            text = f"IBAN {iban}{after}"
            assert (5, 5 + len(iban)) in pii.ibans(text), text
    assert [f"{de} {gb} {no} 1"[a:b] for a, b in pii.ibans(f"{de} {gb} {no} 1")] == [de, gb, no]
    assert pii.ibans("DE89370400440532013000 EUR 500") == [(0, 22)] and pii.ibans(f"{de} NOW") == [(0, 27)]
    # A word against it drops a span of the method unless another word speaks for it; base spans stay.
    assert pii.find(f"serial {de}") == [] and [x[0] for x in pii.find(f"bank serial {de}")] == ["iban"]
    assert [x[0] for x in pii.find("version 1.2.3.4")] == ["ip"]
    assert pii.ibans(f"AB12 CDEF {de} BIC") == [(10, 10 + len(de))]
    assert pii.ibans("DE89370400440532013000X") == pii.ibans("xDE89370400440532013000") == pii.ibans("DE89370400440532013000b 1") == []
    assert pii.ibans("AA11 " * 40_000) is not None
    docs = docs_of(spark, [(1, f"{de} BIC COBADEFFXXX"), (2, f"{de} 2024"), (3, f"{de} {gb}")])
    assert {r.doc_id: r.spans for r in pii.digests(docs).collect()} == {1: "iban:0:27", 2: "iban:0:27", 3: "iban:0:27,iban:28:55"}
    assert {r.doc_id: r.text for r in pii.redact(docs).collect()} == {1: "[IBAN] BIC COBADEFFXXX", 2: "[IBAN] 2024", 3: "[IBAN] [IBAN]"}


def test_decontamination(spark):
    r, words = random.Random(9), vocabulary(4, 900)
    item = " ".join(r.choice(words) for _ in range(40)).capitalize() + "."
    filler = [" ".join(r.choice(words) for _ in range(150)) for _ in range(6)]
    near = item.lower().replace(item.split()[20], "changed").split()
    docs = docs_of(spark, [(1, f"{filler[0]} {item} {filler[1]}"), (2, filler[2]), (3, f"{filler[3]} {' '.join(near)} {filler[4]}"), (4, None), (5, ""), (6, item.upper()), (None, item)])
    bench = spark.createDataFrame([(7, item, 1), (8, None, 1), (9, "", 1), (10, filler[5], 1)], "item_id long, text string, doc_id long")
    index = decontaminate.Index([(7, item), (10, filler[5])])
    for passes in (16_000_000, 200):
        got = decontaminate.find(docs, bench, pass_chars=passes).collect()
        assert {(r.doc_id, r.item_id) for r in got} == {(1, 7), (6, 7), (None, 7)}
    assert {x.doc_id for x in decontaminate.remove(docs, bench).collect()} == {2, 3, 4, 5}
    # All windows by brute force.
    for _, text in [(1, f"{filler[0]} {item} {filler[1]}"), (3, f"{filler[3]} {' '.join(near)} {filler[4]}")]:
        w = decontaminate.tokens(text)
        target = Counter(decontaminate.shingles(decontaminate.tokens(item)))
        best = max(decontaminate.similarity(Counter(decontaminate.shingles(w[i : i + 40])), target) for i in range(len(w) - 39))
        assert [m[1] for m in index.matches(text)] == ([best] if best >= 0.8 else [])


def test_decontamination_by_items_without_id(spark):
    r, words = random.Random(11), vocabulary(4, 900)
    a, b = (" ".join(r.choice(words) for _ in range(40)) for _ in range(2))
    other = " ".join(r.choice(words) for _ in range(150))
    docs = docs_of(spark, [(1, f"{other} {a}"), (2, f"{b} {other}"), (3, other)])
    big = (1 << 60) + 1
    bench = spark.createDataFrame([(None, a), (big, b), (None, None)], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.find(docs, bench).collect()} == {(1, None), (2, big)}
    assert [x.doc_id for x in decontaminate.remove(docs, bench).collect()] == [3]


def test_simhash_of_similar_windows_is_within_the_radius():
    """Of random pairs at a weighted similarity of 0.8 or more, none is further apart than the guaranteed radius."""
    r, furthest, n = random.Random(21), 0, 0
    for _ in range(1500):
        size = r.choice([6, 12, 30, 80, 200])
        a = Counter({f"s{r.randrange(10**9)}": r.choice([1, 1, 1, 4]) for _ in range(size)})
        b = a.copy()
        for s in r.sample(sorted(a), max(1, size // 12)):
            b[f"x{r.randrange(10**9)}"] = b.pop(s)
        if decontaminate.similarity(a, b) >= 0.8:
            n += 1
            furthest = max(furthest, (decontaminate.fingerprint(a) ^ decontaminate.fingerprint(b)).bit_count())
    assert n > 500 and furthest <= decontaminate.RADIUS


def test_simhash_blocks_reach_the_radius():
    r = random.Random(1)
    index = decontaminate.Index([(1, " ".join(vocabulary(2, 40)))])
    for _ in range(500):
        flips = sum(1 << b for b in r.sample(range(64), decontaminate.RADIUS))
        assert index.near(index.prints[0] ^ flips, 40) == [0]


def brute_quality(rows, trusted, buckets):
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def grams(t):
        w = (t or "").encode().split()
        one = [xxhash.xxh64_intdigest(x, 42) for x in w]
        return w, [signed(h) % buckets for h in one] + [signed(xxhash.xxh64_intdigest(b, a)) % buckets for a, b in zip(one, w[1:], strict=False)]

    half = lambda d: signed(42 if d is None else xxhash.xxh64_intdigest(struct.pack("<q", d), 42)) % 2
    target, raw = (Counter(), Counter()), (Counter(), Counter())
    for d, t in rows:
        g = grams(t)[1]
        raw[half(d)].update(g)
        if d in trusted:
            target[half(d)].update(g)
    out = []
    for d, t in rows:
        w, g = grams(t)
        have, all_ = target[1 - half(d)], raw[1 - half(d)]
        nt, nr, k = sum(have.values()), sum(all_.values()), quality.SMOOTHING
        s = sum(np.log((have[b] + k) / (all_[b] * (nt / nr) + k)) for b in g) / max(1, len(g)) if nt and nr else 0.0
        three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        out.append((d, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit), failed, not failed and s >= quality.THRESHOLD, round(float(s), 8)))
    return Counter(out)


def test_quality_brute_force(spark, rows):
    more = [(500, "x### y&&& <b>|\n" * 30), (501, "a b c d e f\na b c d e f\n\n\ng"), (502, "a a a a"), (0, "zz " + " ".join(map(str, range(90))))]
    r, junk = random.Random(2), [f"junk{i}" for i in range(40)]
    more += [(600 + i, " ".join(r.choice(junk) for _ in range(80))) for i in range(60)]
    data = rows + more
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0, "x") for i in range(60)] + [(0, 0, 1, "x"), (None, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    trusted = {i for i in range(60) if i % 3 == 0}
    got = quality.score(docs_of(spark, data), labels).collect()
    cells = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, round(r.score, 8)) for r in got)
    assert cells == brute_quality(data, trusted, quality.BUCKETS)
    assert {r.kept for r in got if not r.base_failed} == {True, False}
    kept = quality.keep(docs_of(spark, data), labels)
    assert kept.columns == docs_of(spark, data).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)
    odd = docs_of(spark, data).withColumn("a`b.c", F.lit(1)).withColumn("own", F.lit(2)).withColumn("ratios", F.lit(3))
    assert quality.keep(odd, labels).columns == odd.columns and quality.keep(odd, labels).count() == kept.count()
    none = quality.score(docs_of(spark, data), labels.limit(0)).collect()
    assert all(r.score == 0 for r in none)


def test_quality_counts_about_so_many_trusted_documents(spark):
    labels = spark.range(5000).selectExpr("id doc_id", "1 quality")
    some = {r.trusted_id for r in quality.trusted_ids(labels.unionByName(labels), 1000).collect()}
    assert 850 < len(some) < 1150
    assert {r.trusted_id for r in quality.trusted_ids(labels.repartition(7), 1000).collect()} == some
    assert quality.trusted_ids(labels, 5000).count() == 5000
    # No document's own words are in its score: alone in its half, it scores as any other.
    docs = docs_of(spark, [(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(40)])
    assert all(abs(r.score) < 0.02 for r in quality.score(docs, labels.filter("doc_id < 20"), buckets=1 << 18).collect())


def test_quality_counts_every_trusted_document(spark):
    """More labels of quality 1 than a bounded sample would have, repeated and null ids among the rows."""
    r, words = random.Random(5), vocabulary(8, 300)
    data = [(i, " ".join(r.choice(words) for _ in range(60))) for i in range(0, 60_000, 1000)]
    data += [(1000, data[0][1]), (1000, data[0][1]), (None, data[3][1]), (None, None), (70_000, data[4][1])]
    labels = spark.range(60_000).selectExpr("id doc_id", "1 quality")
    got = quality.score(docs_of(spark, data), labels.unionByName(labels)).collect()
    cells = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, round(r.score, 8)) for r in got)
    assert cells == brute_quality(data, set(range(60_000)), quality.BUCKETS)


def test_toxicity_held_out(spark):
    r, words = random.Random(3), vocabulary(8, 600)
    bad = ["zorble", "zorbling", "idiot", "vexnak"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 7 == 0
        w = [r.choice(words) for _ in range(r.randint(20, 80))]
        for _ in range(3 if toxic else 0):
            w[r.randrange(len(w))] = r.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    data = rows + [(None, None), (601, ""), (600, "idiot " * 20_000)]
    got = toxicity.score(docs_of(spark, data), table).collect()
    assert len(got) == len(data) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    truth = {i: t for i, _, t in labels}
    held = [x for x in got if x.held_out and x.doc_id in truth]
    assert {x.doc_id for x in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(x.predicted == truth[x.doc_id] for x in held) / len(held) > 0.95
    assert len(toxicity.score(docs_of(spark, rows[:5]), table.limit(0)).collect()) == 5
    # Repeated doc_ids, with one text and with several, in any order of the rows.
    again = docs_of(spark, data + rows[:50] + [(i, t) for i, (_, t) in zip(range(50), rows[50:100], strict=True)] * 2)
    runs = [Counter((x.doc_id, round(x.score, 9)) for x in toxicity.score(again.repartition(n), table, 100).collect()) for n in (2, 5)]
    assert runs[0] == runs[1] and sum(runs[0].values()) == len(data) + 150


def test_toxicity_label_model_learns_without_gold():
    masks = np.array([0, 1, 7, 15, 31, 2, 63])
    n = np.array([900.0, 40, 30, 30, 40, 50, 30])
    alone = toxicity.LabelModel(masks, n)
    guided = toxicity.LabelModel(masks, n, np.array([0.1, 0.2, 0.8, 0.9, 0.9, 0.2, 0.9]))
    assert ((alone.posterior(masks) > 0.5) == (guided.posterior(masks) > 0.5)).all()


def test_toxicity_label_model_is_that_of_single_documents():
    """Rounds of EM over patterns with counts equal rounds over the documents one by one, in plain Python."""
    import math

    r, v = random.Random(9), toxicity.VOTERS
    rows = [sum((r.random() < (0.7 if toxic else 0.1)) << k for k in range(v)) for toxic in (r.random() < 0.3 for _ in range(120))]
    masks = sorted(set(rows))
    model = toxicity.LabelModel(np.array(masks), np.array([rows.count(m) for m in masks], float), rounds=7)
    bit = lambda m, j: m >> j & 1
    first = toxicity.LabelModel(np.array(masks), np.array([rows.count(m) for m in masks], float), rounds=1)
    second = toxicity.LabelModel(np.array(masks), np.array([rows.count(m) for m in masks], float), rounds=6)
    for fitted, rounds, parents in ((first, 1, [first.parent]), (model, 7, [first.parent, second.parent])):
        q = [1 / (1 + math.exp(-(bin(m).count("1") - 3.0))) for m in rows]
        for k in range(rounds):
            parent = parents[k // 5]
            prior = [(sum(1 - x for x in q) + 1) / (len(q) + 2), (sum(q) + 1) / (len(q) + 2)]
            fire = {}
            for j in range(v):
                for a in (0, 1):
                    for y in (0, 1):
                        w = [(x if y else 1 - x) for x in q]
                        base = (sum(x * bit(m, j) for x, m in zip(w, rows, strict=True)) + 0.5) / (sum(w) + 1)
                        own = [(x, m) for x, m in zip(w, rows, strict=True) if (bit(m, parent[j]) if parent[j] >= 0 else 0) == a]
                        fire[j, a, y] = (sum(x * bit(m, j) for x, m in own) + 2 * base) / (sum(x for x, _ in own) + 2)
            chance = lambda m, y: prior[y] * math.prod(fire[j, bit(m, parent[j]) if parent[j] >= 0 else 0, y] if bit(m, j) else 1 - fire[j, bit(m, parent[j]) if parent[j] >= 0 else 0, y] for j in range(v))  # noqa: B023, E731
            q = [chance(m, 1) / (chance(m, 0) + chance(m, 1)) for m in rows]
        assert np.allclose(fitted.posterior(np.array(rows)), q, atol=1e-9)
    q = model.posterior(np.array(rows))
    assert np.allclose(model.accuracies(), [np.mean([x if bit(m, j) else 1 - x for x, m in zip(q, rows, strict=True)]) for j in range(v)])


def test_toxicity_training_rows_are_bounded(spark):
    docs = docs_of(spark, [(i % 7, "x" if i % 2 else f"y{i}") for i in range(400)])
    voted = toxicity.vote(docs, toxicity.Lexicon(["y", "x"], [5.0, 5.0]))
    a, b = (toxicity.training_rows(voted.repartition(n), 5) for n in (1, 6))
    assert a == b and len(a) == 5


def test_label_model_separates_and_sees_correlation():
    r = np.random.default_rng(0)
    y = r.random(20_000) < 0.2
    fire = np.where(y[:, None], r.random((20_000, toxicity.VOTERS)) < 0.8, r.random((20_000, toxicity.VOTERS)) < 0.05)
    fire[:, 5] = fire[:, 4]  # a copy of another voter
    masks, n = np.unique(fire @ (1 << np.arange(toxicity.VOTERS)), return_counts=True)
    model = toxicity.LabelModel(masks, n.astype(float))
    q = model.posterior(fire @ (1 << np.arange(toxicity.VOTERS)))
    assert ((q > 0.5) == y).mean() > 0.99
    assert model.parent[5] == 4 or model.parent[4] == 5
    assert (model.accuracies() > 0.5).all()


def test_html_layout():
    v = html_text.visible_text
    assert v(None) == v("") == v("<script>x</script><title>t</title>") == ""
    assert v("<p>a  <b>b</b>c<p>d<br>e") == "a bc\n\nd\ne"
    assert v("<ul><li>x<ol start=9><li>y<li>z</ol><li>w</ul>") == "- x\n  9. y\n  10. z\n- w"
    assert v("<table><tr><th>Name<th>N<tr><td>alpha<td>1<tr><td>b<td>22</table>") == "Name  | N\nalpha | 1\nb     | 22"
    assert v("<div hidden>a</div><p style='display: none'>b</p><span style='visibility:hidden'>c<i style='visibility:visible'>d</i></span>") == "d"
    assert v("<pre>a\n  b</pre>") == "a\n  b"
    assert v("<details><summary>s</summary>x</details><details open><summary>t</summary>y</details>") == "s\nt\ny"
    assert v("<div>" * 100_000 + "x") == "x"
    assert v("<head><title>t</title><p>x") == "x"
    assert v("a &amp; &lt;b&gt; &nbsp;c") == "a & <b>  c"


def test_html_controls_drawings_and_open_head():
    v = html_text.visible_text
    assert v("<p>a<textarea>\n b &amp; <b>c</b>\nd</textarea>e") == "a  b & <b>c</b>\nd e"
    assert v("<textarea placeholder=Note></textarea>") == "Note" and v("x<textarea>y") == "x y"
    assert v("<select><option>a<option selected>b  c<option>d</select>") == "b c"
    assert v("<select><option disabled>a<optgroup label=g><option label=L>b</select>z") == "L z"
    assert v("x<select multiple><option>a<optgroup label=g><option>b<optgroup label=h><option hidden>c</select>y") == "x\na\ng\nb\nh\ny"
    assert v("<input value=q><input type=submit value=Send><input placeholder=Name><input type=hidden value=h><input type=password value=p><input type=checkbox value=c>") == "q Send Name"
    assert v("<svg><title>t</title><defs><text>no</text></defs><rect/>x<g><text x=1>One <tspan>two</tspan></text></g><text/><text>three</text></svg> end") == "One two three end"
    assert v("<svg><g display=none><text>a</text></g><g visibility=hidden><text>b</text></g><foreignObject><p>c</p></foreignObject></svg>") == "c"
    assert v("<svg><g>lost<p>para") == "para" and v("a<svg/>b<p>c") == "ab\n\nc"
    assert v("<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation>x=1</annotation></semantics></math>") == "x=1"
    assert v("<object data=x><param name=a>shown <em>here</em></object>") == "shown here"
    for tag in ("em", "i", "strong", "button", "label", "svg", "font"):
        assert v(f"<head><title>t</title>Hello <{tag}>") == "Hello", tag
        assert v(f"<head><meta a=b><title>t</title><{tag}></{tag}>x") == "x", tag
    assert v("<head><title>t</title>Hello <em>x</em>") == "Hello x"
    assert v("<head> <noscript>a <em>b</em> c</noscript><style>s</style> <title>t <em>u</em> v</title></head><body>x") == "x"
    assert v("<script>a</script><style>b</style><template>c</template><datalist><option>d</datalist><audio>e</audio><iframe>f</iframe>") == ""


def test_html_spans_widths_and_style_sheets():
    v = html_text.visible_text
    assert v("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>") == "a | b\n  | c"
    assert v("<table><tr><td rowspan=2 colspan=2>a<td>b<tr><td>c<tr><td>d<td>e<td>f</table>").split("\n")[1].split() == ["|", "|", "c"]
    assert v("<table><tr><td colspan=2>long heading<td>x<tr><td>a<td>b<td>y</table>") == "long heading | x\na | b        | y"
    assert v("<table><tr><td>\u65e5\u672c<td>x<tr><td>abcd<td>y</table>") == "\u65e5\u672c | x\nabcd | y"
    assert v("<ol><li>a<li value=7>b<li>c</ol>") == "1. a\n7. b\n8. c"
    sheet = "<style>.x, #y, p.z{display:none} @media print{b{display:none}} em{color:red} /* i{display:none} */</style>"
    assert v(sheet + "<b>1</b><i class='q x'>2</i><u id=y>3</u><p class=z>4</p><div class=z>5</div><em>6</em>") == "1\n5\n6"
    assert v("<div>" * 600 + "<script>x</script><p hidden>y</p>z") == "z"


def test_html_shows_the_words_of_random_trees():
    """Words that no hidden ancestor has, in order, by a recursive walk over the tree the page was written from."""
    r = random.Random(17)
    tags = ["div", "p", "span", "b", "ul", "section", "blockquote", "td", "pre", "h2"]

    def tree(depth):
        kind = r.random()
        if depth == 0 or kind < 0.3:
            return f"w{r.randrange(10**6)}"
        tag = r.choice(tags)
        hidden = r.random() < 0.2
        return (tag, hidden, [tree(depth - 1) for _ in range(r.randint(0, 4))])

    def page(x):
        if isinstance(x, str):
            return f" {x} "
        tag, hidden, inside = x
        mark = r.choice([" hidden", " style='color: red; display:none'"]) if hidden else ""
        body = "".join(map(page, inside))
        if tag == "ul":
            body = "".join(f"<li>{page(y)}" for y in inside)
        if tag == "td":
            return f"<table{mark}><tr><td>{body}</table>"
        if tag == "p":  # a paragraph ends where a block begins
            return f"<div{mark}>{''.join(f'<p>{page(y)}' if isinstance(y, str) else page(y) for y in inside)}</div>"
        return f"<{tag}{mark}>{body}</{tag}>"

    def words(x):
        return [x] if isinstance(x, str) else [] if x[1] else [w for y in x[2] for w in words(y)]

    import re

    for _ in range(400):
        t = tree(5)
        assert re.findall(r"w\d+", html_text.visible_text(page(t))) == words(t)


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a", 1), (2, None, None, 1), (1, "u", "<p>a", 1)], "page_id long, url string, html string, text int")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(pages).collect()) == [(1, "a", 1), (1, "a", 1), (2, "", 0)]


def test_warc_audit(spark):
    rows = [(i, f"http://x/{i}", "é" * (i % 50), 1) for i in range(700)] + [(5, "http://x/5", None, 1), (None, None, None, 1), (5, "http://x/5", None, 1)]
    got = Counter(tuple(r) for r in warc.audit_pages(spark.createDataFrame(rows, "page_id long, url string, html string, ordinal int")).collect())
    name = lambda i: "" if i is None else str(i)
    ours = sorted(((name(i), hashlib.sha256(warc.record(i, u, h)).hexdigest(), warc.record(i, u, h), i) for i, u, h, _ in rows), key=lambda x: x[:2])
    theirs = {}
    for key, _, data, i in ours:
        theirs.setdefault(key, []).extend(hashlib.sha256(x).hexdigest() for x in warc.copies(i, data))
    at, expected, own = 0, Counter(), Counter()
    for k, (key, digest, data, i) in enumerate(ours):
        there = sorted(theirs[key])
        nth, own[key] = own[key], own[key] + 1
        finding = "LOST" if nth >= len(there) else "INTACT" if there[nth] == digest else "CHANGED"
        expected[i, k, at, len(data), digest, finding] += 1
        at += len(data)
    for key, there in theirs.items():
        expected[int(key) if key else None, None, None, None, None, "ADDED"] += max(0, len(there) - own[key])
    assert got == +expected
    assert {x[5] for x in got} == {"INTACT", "CHANGED", "LOST", "ADDED"}


def test_warc_lost_record_is_one_finding(spark):
    a = [(f"{i:04d}", i, 10 * i, 10, f"d{i}") for i in range(300)]
    b = [(k, i, 10 * i, n, d) for i, (k, _, _, n, d) in enumerate(a[:3] + a[4:])]
    x, y = warc.aligned(*(spark.createDataFrame(t, "record_id string, ordinal long, offset long, length long, digest string") for t in (a, b)))
    assert [(r.place, r.finding) for r in warc.corrupt(x, y, 8).collect()] == [(3, "LOST")]
    assert [(r.place, r.finding) for r in warc.corrupt(y, x, 8).collect()] == [(3, "ADDED")]
    assert warc.corrupt(x, x, 8).count() == 0
    swapped = [(k, i, o, n, a[{7: 8, 8: 7}.get(i, i)][4]) for k, i, o, n, d in a]
    z = spark.createDataFrame(swapped, "record_id string, ordinal long, offset long, length long, digest string")
    x, z = warc.aligned(spark.createDataFrame(a, "record_id string, ordinal long, offset long, length long, digest string"), z)
    assert sorted((r.place, r.finding) for r in warc.corrupt(x, z, 8).collect()) == [(7, "CHANGED"), (8, "CHANGED")]


def test_empty_tables(spark, tmp_path):
    none = docs_of(spark, [])
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    path, ranks = T.path("byte_bpe_50k.json"), T.path("byte_bpe_multi_50k.tiktoken")
    token_orc.write(none, str(tmp_path / "orc"), path)
    for out in (
        toxicity.score(none, labels),
        ngram_join.components(none),
        decontaminate.find(none, bench),
        decontaminate.remove(none, bench),
        substring.digests(none),
        bpe.round_trip_digests(none, ranks, T.PATTERN),
        html_text.extract(pages),
        quality.score(none, labels),
        token_orc.read(spark, str(tmp_path / "orc")),
        pii.digests(none),
        warc.audit_pages(pages),
    ):
        assert out.count() == 0
