"""The corpus pipeline against a version in plain Python, and each stage on awkward rows."""

import hashlib
import random
from collections import Counter
from itertools import combinations

import pytest

T = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tests.llm.test_operators import brute_quality, sets_of, vocabulary  # noqa: E402
from tidegrain.llm import bpe, decontaminate, pii, quality  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r, words = random.Random(31), vocabulary(12, 900)
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, text(r.randint(40, 140))) for i in range(60)]
    rows += [(100 + k, rows[k][1].replace(" ", "\n", 1)) for k in range(8)]
    rows += [(120 + k, " ".join([*rows[k][1].split()[1:], "changed"])) for k in range(8)]
    items = [(k, text(50)) for k in range(3)]
    rows += [(140 + k, f"{text(30)} {items[k][1]} {text(30)}") for k in range(3)]
    rows += [(150, f"{text(60)} mail a@b.co or +49 30 1234567"), (151, None), (152, ""), (153, "x " * 200), (154, text(70) + " é日"), (20, rows[20][1]), (20, rows[20][1])]
    junk = [f"junk{i}" for i in range(40)]
    rows += [(200 + i, " ".join(r.choice(junk) for _ in range(80))) for i in range(40)]
    labels = [(i, 1, 0) for i in range(0, 60, 2)] + [(200 + i, 0, 0) for i in range(5)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([*items, (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, labels, items


def expected(rows, labels, items):
    trusted = {i for i, q, _ in labels if q == 1}
    verdict = {d: x[7] for x in brute_quality(rows, trusted, quality.BUCKETS) for d in [x[0]]}
    kept = [(i, t) for i, t in rows if verdict[i]]
    sets = [sets_of(t, 5) for _, t in kept]
    group = list(range(len(kept)))
    for a, b in combinations(range(len(kept)), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    one = [min((kept[i] for i in range(len(kept)) if group[i] == g), key=lambda x: x[0]) for g in dict.fromkeys(group)]
    wanted = [Counter(decontaminate.shingles(decontaminate.tokens(t))) for _, t in items]
    sizes = [len(decontaminate.tokens(t)) for _, t in items]

    def leaks(t):
        w = decontaminate.tokens(t)
        return any(decontaminate.similarity(Counter(decontaminate.shingles(w[i : i + n])), c) >= 0.8 for n, c in zip(sizes, wanted, strict=True) for i in range(max(1, len(w) - n + 1)))

    return kept, one, [(i, pii.redact_text(t)) for i, t in one if not leaks(t)]


def test_pipeline_like_plain_python(spark, corpus):
    import tiktoken

    folder, rows, labels, items = corpus
    kept, one, masked = expected(rows, labels, items)
    assert len(rows) > len(kept) > len(one) > len(masked) > 20
    coder = tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=bpe.read_ranks(T.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = Counter()
    for i, t in masked:
        ids = coder.encode_ordinary(t)
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in got) == want
    assert any("[EMAIL]" in t for _, t in masked)


def test_every_stage_takes_awkward_tables(spark, corpus):
    folder, _, _, _ = corpus
    odd = spark.createDataFrame([(1, None, "en", "s", 0, "a", 1), (1, None, "en", "s", 0, "a", 1), (None, "", "en", None, None, None, None), (2, "one", None, "s", 3, "b", 2), (2, "one", None, "s", 3, "b", 2)], f"{SCHEMA}, `drop_id` string, `a``b.c` int")
    # Rows without text fail the rules; later stages keep them, one of each group of equal texts.
    sizes = [len(stage(spark, odd, folder).collect()) for _, stage in corpus_pipeline.STAGES]
    assert sizes == [0, 4, 5, 5, 5]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == odd.columns
        assert stage(spark, odd.limit(0), folder).count() == 0


def test_quality_stage_counts_every_trusted_document(spark, tmp_path):
    """More labels of quality 1 than a bounded sample would have; a word common among the trusted documents decides."""
    spark.range(60_000).selectExpr("id doc_id", "1 quality", "0 toxic").write.parquet(f"{tmp_path}/labels.parquet")
    good, junk = [f"good{i}" for i in range(30)], [f"junk{i}" for i in range(30)]
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(good) for _ in range(60))) for i in range(0, 60_000, 1000)] + [(70_000 + i, " ".join(r.choice(junk) for _ in range(60))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x.doc_id: round(x.score, 8) for x in quality.score(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    brute = {x[0]: x for x in brute_quality(rows, set(range(60_000)), quality.BUCKETS)}
    assert found == {d: x[8] for d, x in brute.items()}
    assert {x.doc_id for x in corpus_pipeline.quality_rules(spark, docs, str(tmp_path)).collect()} == {d for d, x in brute.items() if x[7]}
