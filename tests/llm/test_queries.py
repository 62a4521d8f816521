"""The registered queries' contract columns against brute force over whole small tables, and the pipeline's stages."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quirework.llm import queries

public_tokenizers = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents():
    duckdb = pytest.importorskip("duckdb")
    import os

    if not os.path.isdir(SF):
        pytest.skip("no tables")
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


def test_op1(spark, documents):
    got = {r.doc_id: r for r in queries.op1_toxicity(spark, SF).collect()}
    assert got.keys() == documents.keys()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_op2(spark, documents):
    from tests.llm.test_small import brute_fingerprint

    got = {r.doc_id: r for r in queries.op2_simhash(spark, SF).collect()}
    fps = {i: brute_fingerprint(t) for i, t in documents.items()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{x:016x}" for i, x in fps.items()}
    group = {i: i for i in sorted(fps)}
    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2 and group[a] != group[b]:
                old, new = sorted((group[a], group[b]))[::-1]
                group = {i: new if g == old else g for i, g in group.items()}
    assert {i: r.component_id for i, r in got.items()} == group


def test_op3_op4(spark, documents):
    import sentencepiece
    from tokenizers import Tokenizer

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in queries.op4_token_counts(spark, SF).collect():
        t = documents[r.doc_id] or ""
        n = len(sp.encode(t))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 4096)
    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = {}, {}
    for r in queries.op3_packing(spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == documents.keys()
    for i, found in pieces.items():
        ids = b"".join(x.to_bytes(4, "little") for x in [*bpe.encode(documents[i] or "", add_special_tokens=False).ids, 1])
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) // 4 and r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(ids) // 4
    filled = 0
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
        filled += at
    assert filled / sum(2048 if (n := sum(x for _, x in s)) & (n - 1) else n for s in sequences.values()) > 0.9


def test_op5(spark, documents):
    from tests.llm.test_small import brute_counts

    for r in queries.op5_quality(spark, SF).collect():
        want = brute_counts(documents[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and (not r.kept or not r.base_failed)


def test_op10(spark, documents):
    kinds = {
        "assign": (re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 8),
        "access": (re.compile("AKIA[A-Z0-9]+"), 0, 16),
        "hex": (re.compile("[0-9a-f]+"), 0, 32),
    }
    for r in queries.op10_secrets(spark, SF).collect():
        found = []
        for k, (kind, (pattern, part, least)) in enumerate(kinds.items()):
            found += [(m.start(), k, kind, m.end()) for m in pattern.finditer(documents[r.doc_id] or "") if m.end(part) - m.start(part) >= least]
        base = [f"{kind}:{s}:{e}" for s, _, kind, e in sorted(found)]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[2] == kind for x in found) for kind in kinds)
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r.spans.split(","))


ODD = [(1, None), (2, ""), (3, " \n\t"), (None, "no id here at all, but words enough for a rule of ten words"), (4, "x" * 4000)]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of documents, with copies, near copies and odd rows, and labels; and the rows."""
    r = random.Random(11)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "ru") for b in ("ba", "den", "fir", "gol", "hum", "jas")]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(40, 90))) for _ in range(60)]
    texts = [t + "\n" + " ".join(r.choice(words) for _ in range(25)) for t in texts]
    texts += [texts[3], texts[5].replace(words[0], words[1], 1), texts[7] + "\n" + texts[8].split("\n")[1][:-1] + "x", " ".join(["spam!!"] * 40), "too short"]
    rows = [(i + 10, t) for i, t in enumerate(texts)] + ODD + [(12, texts[2])]
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int("spam" not in (t or "spam")), int(i % 7 == 0)) for i, t in rows if i and i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_pipeline_stages(spark, small):
    """Quality rules, line dedup and near-dedup against brute force on what the stage before kept; then mixing and packing."""
    from tests.llm.test_small import brute_counts, brute_edits

    path, rows = small
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "mixing", "packing"]
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)

    kept = stages["quality_rules"](spark, docs, path).cache()
    base = [(i, t) for i, t in rows if (c := brute_counts(t))[0] >= 10 and 100 * c[4] <= 20 * c[0]]
    assert kept.columns == docs.columns and set(pairs(kept)) <= set(base) and len(pairs(kept)) >= 0.9 * len([x for x in base if "spam" not in x[1]])

    lined = stages["line_dedup"](spark, kept, path).cache()
    order = sorted(set(pairs(kept)), key=lambda x: (x[0] is None, x[0] or 0))
    lines = [(x, k, s.strip(" \t\n\x0b\x0c\r")) for x in order for k, s in enumerate(x[1].split("\n"))]
    lines = [x for x in lines if x[2]]
    group = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            x, y = lines[a][2], lines[b][2]
            if group[a] != group[b] and (x == y or min(len(x), len(y)) >= 20 and abs(len(x) - len(y)) <= 2 and brute_edits(x, y) <= 2):
                group = [group[b] if g == group[a] else g for g in group]
    gone, seen = {}, set()
    for (x, k, _), g in zip(lines, group, strict=True):
        if g in seen:
            gone.setdefault(x, set()).add(k)
        seen.add(g)
    want = []
    for x in pairs(kept):
        left = "\n".join(s for k, s in enumerate(x[1].split("\n")) if k not in gone.get(x, ()))
        want += [(x[0], left)] if x not in gone or left.strip() else []
    assert pairs(lined) == sorted(want, key=repr) and lined.columns == docs.columns

    near = stages["near_dedup"](spark, lined, path).cache()
    grams = lambda t: {tuple(w[k : k + 5]) for w in [WORD.findall(t)] for k in range(max(1, len(w) - 4))}
    order = sorted(set(pairs(lined)), key=lambda x: (x[0] is None, x[0] or 0))
    group = list(range(len(order)))
    for a in range(len(order)):
        for b in range(a):
            x, y = grams(order[a][1]), grams(order[b][1])
            if group[a] != group[b] and len(x & y) >= 0.8 * len(x | y):
                group = [group[b] if g == group[a] else g for g in group]
    assert pairs(near) == sorted((order[g] for g in sorted(set(group))), key=repr) and near.columns == docs.columns

    mixed = stages["mixing"](spark, near, path).cache()
    assert mixed.columns == docs.columns and set(pairs(mixed)) <= set(pairs(near))

    packed = stages["packing"](spark, mixed, path).collect()
    assert sum(r.start == 0 for r in packed) == mixed.count()


def test_pipeline_on_odd_rows(spark, small):
    """Nulls, empty texts, clashing names and empty tables in every stage."""
    path, _ = small
    docs = spark.read.parquet(f"{path}/documents.parquet")
    odd = spark.createDataFrame([(i, t, "kept", 1.5, 2) for i, t in ODD + ODD[3:]], "doc_id long, text string, kept string, llr double, pos int").withColumns({c: F.lit("mine") for c in ("key", "id", "n", "component", "rate", "class")})
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, path)
        assert name == "packing" or got.columns == odd.columns
        assert got.count() <= 3 * odd.count() and stage(spark, docs.limit(0), path).count() == 0


def test_pipeline_run(spark, small):
    path, _ = small
    out = corpus_pipeline.run(spark, path)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 20
    assert all(math.log2(n).is_integer() or n <= 2048 for n in (r.length for r in out.collect()))
