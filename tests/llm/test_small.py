"""Every operator on tiny tables against brute force, and on nulls, empty and repeated rows."""

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirework.llm import line_dedup, mixing, packing, quality, secret_scan, simhash, token_counts, topk, toxicity
from quirework.llm._common import Scratch, connected_components

public_tokenizers = pytest.importorskip("public_tokenizers")

ODD = [(1, "Hello world, this is a text about nothing at all, really."), (2, None), (3, ""), (4, " \n\t "), (None, "no id here"), (5, "twice"), (5, "twice"), (6, "x" * 5000), (7, "Ünïcode 🙂 " * 50)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "name", 1) for i, t in ODD], "doc_id long, text string, key string, pos int").repartition(2)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 102), (102, 100)] + [(200, 200 + i) for i in range(1, 40)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "t")).collect()))
    assert all(got[i] == 0 for i in range(21)) and got[102] == 100 and got[239] == 200 and len(got) == 21 + 3 + 40


def brute_fingerprint(text, k=3):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, odd):
    texts = [" ".join(f"w{(i * 7 + j) % 50}" for j in range(40)) for i in range(6)]
    rows = list(enumerate(texts)) + [(10 + i, t + (" extra" if i % 2 else "")) for i, t in enumerate(texts)] + [(30, None), (31, " ")]
    got = {r.id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = {i: brute_fingerprint(t) for i, t in rows}
    assert {i: r.fp % (1 << 64) for i, r in got.items()} == fps
    group = {i: i for i in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 2:
                    group[a] = group[b] = min(group[a], group[b])
    assert {i: r.component_id for i, r in got.items()} == group
    assert simhash.near_duplicates(odd).count() == len(ODD)
    kept = simhash.one_of_each(odd)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 5, 6, 7] and kept.columns == odd.columns
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_near_copies(spark, odd):
    """Against brute force; two-bit balls found few of these pairs."""
    import random

    from corpus_pipeline import near_dedup
    from quirework.llm import near_copies

    r = random.Random(5)
    passage = [f"p{i}" for i in range(30)]
    texts = [[f"w{r.randrange(400)}" for _ in range(r.randrange(3, 150))] + (passage if i % 3 else []) for i in range(60)]
    for i in range(120):
        copy = list(texts[r.randrange(len(texts))])
        for _ in range(r.choice((0, 1, 1, 2, 3))):
            copy[r.randrange(len(copy))] = f"w{r.randrange(400)}"
        texts.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    grams = [{tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))} for t in texts]
    group, far = list(range(len(rows))), 0
    fps = [brute_fingerprint(t, 5) for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b]):
                far += (fps[a] ^ fps[b]).bit_count() > 2
                group = [group[b] if g == group[a] else g for g in group]
    assert far > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    firsts = {}
    for i, g in enumerate(group):
        firsts.setdefault(g, i)
    assert sorted(r.doc_id for r in near_dedup(spark, docs, "").collect()) == sorted(firsts.values())
    kept = near_copies.one_of_each(odd)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 5, 6, 7] and kept.columns == odd.columns
    assert near_copies.one_of_each(odd.limit(0)).count() == 0


def test_near_copies_by_balls(spark):
    """Sets whose SimHash fingerprints are within two bits, by brute force, are connected by the pairs that are verified first."""
    import random

    from quirework.llm import near_copies
    from quirework.llm._common import connected_components

    r = random.Random(9)
    fps = [r.getrandbits(64) for _ in range(60)]
    fps += [fps[r.randrange(60)] ^ sum(1 << b for b in r.sample(range(64), r.randrange(4))) for _ in range(120)]
    rows = [(i, 9, fp - (1 << 64) if fp >> 63 else fp) for i, fp in enumerate(fps)]
    group = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                group = [group[b] if g == group[a] else g for g in group]
    firsts = [group.index(g) for g in group]
    scratch = Scratch(spark, "balls")
    pairs = near_copies.ball_pairs(spark.createDataFrame([*rows, (999, 0, 0)], "fold long, n int, fp long"), scratch)
    got = {x.node: x.component for x in connected_components(pairs, scratch).collect()}
    assert 999 not in got and [got.get(i, i) for i in range(len(fps))] == firsts and len(got) > 60
    text = "A b c d e f g h b c d e f"
    signed = near_copies.signatures(spark.createDataFrame([(1, text)], "_qw_key long, text string"), 5, 80, near_copies.np.zeros(0, "int64")).first()
    words = text.lower().split()
    distinct = {" ".join(words[k : k + 5]) for k in range(len(words) - 4)}
    hashes = [near_copies.xxhash.xxh64_intdigest(g, 42) for g in distinct]
    assert signed.fp % (1 << 64) == sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_chance_shingles(spark):
    """Of rows with one shingle, those stay that may be similar to another one: all of these by brute force, and few others."""
    import random

    from quirework.llm import near_copies

    r = random.Random(7)
    rows = [(g, 1000 * g + k, r.randrange(n // 5 + 1), n) for g in range(300) for k in range(r.choice((1, 2, 2, 3, 9))) for n in [int(10 ** r.uniform(0.5, 4))]]
    got = {tuple(x) for x in near_copies.with_partner(spark.createDataFrame(rows, "gram long, fold long, at int, n int").repartition(3), 80).collect()}
    meet = [(x, y) for x in rows for y in rows if x[0] == y[0] and x[1] != y[1]]
    need = {x for x, y in meet if min(x[3] - x[2], y[3] - y[2]) * 180 >= 80 * (x[3] + y[3])}
    assert need <= got <= set(rows) and len(need) > 20 and len(got) < len({x for x, _ in meet}) / 2


def test_token_counts(odd):
    model = public_tokenizers.path("piece_bpe_32k.model")
    counter = token_counts.PieceCounter(model)
    assert counter.cuttable
    texts = ["", " ", "a", " a  b ", "a\n b", "x▁ y", "<s> </s>", "中 文", "  ", "\t "] + [t or "" for _, t in ODD]
    texts += ["a" * 200, "b " + "中" * 300 + " c", "a" * 200 + " b"]
    assert counter.counts(texts) == counter.counts(texts) == [len(x) for x in counter.sp.encode(texts)]
    assert max(map(len, counter.known)) <= token_counts.LONGEST
    assert token_counts.token_counts(odd.limit(0), model).count() == 0 and token_counts.token_counts(odd.withColumn("n_tokens", F.lit(1)).withColumn("id", F.lit(2)), model).count() == len(ODD)
    got = {r.id: r for r in token_counts.token_counts(odd, model, limit=100).collect()}
    assert (got[2].n_bytes, got[2].n_tokens, got[2].over_limit) == (0, 0, False) and got[6].n_bytes == 5000 and got[6].over_limit
    assert list(token_counts.by_bytes([5, 5, 20, 1], 10)) == [(0, 2), (2, 3), (3, 4)]


def test_packing(odd):
    path, fast = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = packing.Encoder(path, fast, public_tokenizers.PATTERN)
    texts = ["a  b", "it's 'll", "x <|endoftext|> y", "\n a\t b", "中 文²", "a　 b"] + [t or "" for _, t in ODD]
    for t in texts:
        assert enc.encode(t) == b"".join(i.to_bytes(4, "little") for i in enc.slow.encode(t, add_special_tokens=False).ids)
    assert max(map(len, [*enc.heads, *enc.tails])) <= packing.LONGEST
    named = odd.withColumnsRenamed({"key": "id", "pos": "start"}).withColumn("length", F.lit(1))
    assert packing.pack(odd.limit(0), path).count() == 0 and packing.pack(named, path).where("start = 0").count() == len(ODD)
    rows = packing.pack(odd, path, tiers=(64, 32), ranks_file=fast, pattern=public_tokenizers.PATTERN, pool_tokens=256).collect()
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 64 and at & (at - 1) == 0
    ids = enc.encode(ODD[7][1]) + (1).to_bytes(4, "little")
    pieces = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.id == 6)
    assert sum(p[1] for p in pieces) == len(ids) // 4 and all(zlib.crc32(ids[4 * s : 4 * (s + n)]) == c for s, n, c in pieces)
    assert sum(r.length for r in rows if r.id == 2) == 1 and sum(r.length for r in rows if r.id == 5) == 2 * rows[[r.id for r in rows].index(5)].doc_tokens


def brute_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen, covered = {}, set()
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    for v in seen.values():
        if len(v) > 1:
            covered.update(k for i in v for k in range(i, i + 5))
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    good = [f"the quick brown fox number {i} jumps over a lazy dog near river {i % 3} today again" for i in range(40)]
    junk = ["BUY!! NOW!! " * 6 + f"{i}" for i in range(10)] + ["a b c d e f\na b c d e f\n# $ | x"]
    rows = list(enumerate(good + junk + [None, ""]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(51)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.QualityModel(docs, labels, Scratch(spark, "q"), n_buckets=1024).judge(docs, "").collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(t)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    assert all(got[i].kept for i in range(40)) and not any(got[i].kept for i in range(40, 53))


def test_quality_counts_all_trusted(spark, monkeypatch):
    """Over 20,000 trusted documents all count, and all held-out ones set the threshold, broadcast or joined."""
    n = 60_000
    docs = spark.range(0, n, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    held = sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(n))
    assert quality.trusted_ids(labels).count() == n - held and quality.trusted_ids(labels, held=True).count() == held
    totals = []
    for few in (quality.FEW, 10):
        monkeypatch.setattr(quality, "FEW", few)
        scratch = Scratch(spark, "q")
        model = quality.QualityModel(docs, labels, scratch, n_buckets=64)
        counts = spark.read.parquet(scratch.path("counts"))
        totals.append((*counts.agg(F.sum("raw"), F.sum("target")).first(), model.threshold))
    assert totals[0][:2] == (2 * n, 2 * (n - held)) and totals[0] == totals[1]


def test_quality_ratios(spark, tmp_path):
    """Scores and verdicts against brute force, with counts by n-gram instead of by bucket; odd rows, clashing names and empty tables."""
    import math
    import random

    from quirework.llm.queries import op5_quality

    r = random.Random(2)
    rows = [(i, " ".join(r.choice(("alpha", "beta", "gamma", "delta") if i < 80 else ("omega", "psi", "gamma", "chi")) for _ in range(40)).replace("a b", "a\nb")) for i in range(120)]
    rows += [(120, rows[3][1]), (3, rows[3][1]), (121, None), (122, ""), (None, rows[5][1]), (123, "alpha beta " * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 80), 0) for i in range(120)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.QualityModel(docs, labels, Scratch(spark, "q"))
    got = model.judge(docs).collect()

    def found(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        return [("w", x) for x in w] + [("p", *x) for x in zip(w, w[1:])] + [("w", x[-3:]) for x in w]

    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(found(t))
        if i is not None and i < 80 and not held(i):
            target.update(found(t))
    share = sum(target.values()) / sum(raw.values())
    score = lambda t: sum(round(1000 * math.log((target[g] + 5) / (raw[g] * share + 5))) for g in found(t)) / 1000 / max(1, len(found(t)))
    good = sorted(score(t) for i, t in rows if i is not None and i < 80 and held(i))
    at = 0.005 * (len(good) - 1)
    least = good[0] + (good[1] - good[0]) * at - 0.1
    assert abs(model.threshold - least) < 1e-9 and len(got) == len(rows)
    for x in got:
        words, _, _, _, repeats = brute_counts(x.text)
        assert abs(x._qw_llr - score(x.text)) < 1e-9
        assert x._qw_kept == (words >= 10 and 100 * repeats <= 20 * words and score(x.text) >= least)
    assert len({x._qw_llr for x in got if x.text == rows[3][1]}) == 1
    clash = docs.withColumns({c: F.lit(7.5) for c in ("_t", "_w", "h", "bucket", "llr", "n_words", "kept", "ratio")})
    again = quality.QualityModel(clash, labels, Scratch(spark, "q")).judge(clash)
    assert again.columns[:10] == clash.columns and {x.llr for x in again.collect()} == {7.5}
    none = quality.QualityModel(docs.limit(0), labels, Scratch(spark, "q"))
    assert none.judge(docs.limit(0)).count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert op5_quality(spark, str(tmp_path)).columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"]


def test_line_dedup(spark, odd):
    a, b = "a line that is long enough to count", "another line that is long enough too"
    rows = [(1, f"{a}\n{b}"), (2, f"{a}!\nshort\n\n{b[:-1]}"), (3, f"{a}"), (4, None), (5, "short\nshort"), (3, f"{a}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, line_dedup.dedup_lines(docs).collect()))
    assert got == [(1, f"{a}\n{b}"), (2, "short\n"), (4, None)]
    assert line_dedup.dedup_lines(odd).columns == odd.columns and line_dedup.dedup_lines(odd).count() == len(ODD)
    named = odd.withColumnsRenamed({"key": "id", "pos": "line"}).withColumn("class", F.lit(1)).withColumn("n", F.lit(2)).withColumn("component", F.lit(3))
    assert line_dedup.dedup_lines(named).columns == named.columns
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def brute_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_edit_components(spark):
    """Against brute force: mutated lines of three characters and more, and a large group of near copies."""
    import random

    r = random.Random(3)
    letters = "etaoin bcé🙂"
    lines = {"".join(r.choice(letters) for _ in range(r.choice((3, 4, 5, 7, 20, 21, 40)))) for _ in range(40)}
    lines |= {f"page {i:03d} of the 999 pages of this book" for i in range(0, 1000, 25)}
    for x in sorted(lines)[:60]:
        for _ in range(2):
            y = list(x)
            for _ in range(r.randrange(1, 5)):
                at = r.randrange(len(y))
                y[at : at + r.choice((0, 1))] = r.choice(([], [r.choice(letters)]))
            lines.add("".join(y))
    lines = sorted(x for x in lines if len(x) > 2)
    group = list(range(len(lines)))
    for i, x in enumerate(lines):
        for j in range(i):
            if abs(len(x) - len(lines[j])) <= 2 and group[i] != group[j] and brute_edits(x, lines[j]) <= 2:
                group = [group[j] if g == group[i] else g for g in group]
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string").repartition(3)
    got = {r.node: r.component for r in line_dedup.edit_components(df, Scratch(spark, "t")).collect()}
    first = {}
    for i, g in enumerate(group):
        first.setdefault(g, i)
    assert {i: got.get(i, i) for i in range(len(lines))} == {i: first[g] for i, g in enumerate(group)}
    assert len(first) < len(lines) - 40
    ids = {r.id for r in line_dedup.candidates(df, 2).collect()}
    assert ids >= set(got)


def test_short_lines(spark, tmp_path):
    """The query and the pipeline's stage fold exact copies of lines of any length, and only those of short ones."""
    from corpus_pipeline import line_dedup as stage
    from quirework.llm.queries import op7_line_dedup

    long = "a line that is long enough to count"
    rows = [(1, f"Les.\n{long}\nLis."), (2, f" Les. \n\n{long}!\nx"), (3, "x\nnew\nx"), (4, "Les.\nx"), (5, None), (6, "\n \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.removed for r in op7_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: [], 2: [0, 2], 3: [0, 2], 4: [0, 1], 5: [], 6: []}
    assert sorted(map(tuple, stage(spark, docs, "").collect())) == [(1, rows[0][1]), (2, "\nx"), (3, "new"), (5, None), (6, "\n \n")]


def test_topk(spark, odd, monkeypatch):
    import math

    texts = ["the cat sat on the mat", "a dog and a cat", "", None, "dog dog dog", "the mat", "a dog and a cat"] + [f"filler {i} the" for i in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "the CAT dog"), (2, "mat mat"), (3, "absent"), (4, None)], "query_id long, text string")
    got = [(r.query_id, r.rank, r.id, r.score) for r in topk.search(docs, asked, k=4).orderBy("query_id", "rank").collect()]
    words = [topk.terms(t) for t in texts]
    n, avg = len(texts), sum(map(len, words)) / len(texts)
    df = Counter(w for x in words for w in set(x))
    want = []
    for q, t in ((1, "the CAT dog"), (2, "mat mat")):
        hits = []
        for i, x in enumerate(words):
            s = 0
            for w, k in Counter(topk.terms(t)).items():
                if f := x.count(w):
                    s += k * math.floor(1e6 * topk.idf(n, df[w]) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(x) / avg)) + 0.5)
            if s:
                hits.append((-s, i))
        want += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(hits)[:4], 1)]
    assert got == want
    assert topk.search(odd, asked).count() == 0 and topk.search(odd.limit(0), asked).count() == 0
    monkeypatch.setattr(topk, "QUERIES", 2)
    clash = docs.withColumns({c: F.lit(1) for c in ("id", "query_id", "score", "rank", "n", "terms")})
    extra = asked.withColumn("rank", F.lit(0)).union(spark.createDataFrame([(None, "dog", 1)], "query_id long, text string, rank int"))
    assert [(r.query_id, r.rank, r.id, r.score) for r in topk.search(clash, extra, k=4).orderBy("query_id", "rank").collect()] == want


def test_topk_blocks():
    """Pruned scores equal full ones on random segments, and some blocks of postings are never read."""
    import random

    r = random.Random(9)
    texts = [" ".join(f"w{min(r.randrange(1, 400), r.randrange(1, 400))}" for _ in range(r.randrange(0, 60))) for _ in range(700)]
    words = [topk.terms(t) for t in texts]
    average = sum(map(len, words)) / len(words)
    df = Counter(w for x in words for w in set(x))
    idfs = {w: topk.idf(len(texts), k) for w, k in df.items()} | {b"none": 1.0}
    made = topk.segment_of(texts)
    seg = topk.Segment(made.pop("terms"), idfs, average, list(range(len(texts))), **made)
    counts = [0, 0]
    for _ in range(60):
        q = Counter(r.choice([*df, b"none"]) for _ in range(r.randrange(1, 6)))
        best = []
        seg.search(q, best, 5, counts)
        full = sorted(((-sum(int(seg.impact(w, topk.np.array([x.count(w)]), topk.np.array([len(x)]))[0]) * k for w, k in q.items() if w in x), i) for i, x in enumerate(words)))
        assert sorted((-s, h.id) for s, h in best) == [h for h in full[:5] if h[0]]
    assert 0 < counts[0] < counts[1]


def test_secrets(odd):
    texts = ["PassWord='abcdefgh1' api_key : zzzzzzzz9 apikey=short", "AKIA1234567890AB AKIAS", "f" * 31 + " " + "0a" * 16 + "G" + "a" * 40, "ſecret=abcdefghij", "x" * 9 + "toKen=abcdefghij", "https://u:pass1@h/"]
    scanner = secret_scan.Scanner(secret_scan.BASE + secret_scan.MORE)
    for t, found in zip(texts, scanner.spans(texts), strict=True):
        want = sorted(((m.start(), m.end(), k) for k, r in enumerate(scanner.rules) for m in re.finditer(r.pattern, t) if m.end(r.part) - m.start(r.part) >= r.least), key=lambda s: (s[0], s[2]))
        assert found == want
    assert [bool(q) for q in scanner.queries] == [True, True, False] + [True] * len(secret_scan.MORE)
    assert secret_scan.scan(odd).where(F.size("spans") > 0).count() == 0 and secret_scan.scan(odd).count() == len(ODD)


def test_toxicity(spark, odd):
    rows = [(i, f"this is plain text number {i} about things and people walking around town {i * 7}" + (" you are an idiot and a moron" if i % 3 == 0 else "")) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    s = model.scores(["an idiot here", "an id*iot here", "an i d i o t here", "an idxiot here", "walking around town", ""])
    assert min(s[:4]) > max(s[4:])
    got = {r.id: r.score for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(150) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((got[i] >= 0.5) == (i % 3 == 0) for i in held)
    assert toxicity.score(odd, model).count() == len(ODD)
    assert toxicity.fit(docs, labels.limit(0)).scores(["x"])[0] < 0.5 and toxicity.score(odd.limit(0), model).count() == 0
    clash = docs.withColumns({c: F.lit(1) for c in ("id", "score", "toxic", "words", "word", "margin")})
    again = toxicity.fit(clash, labels)
    assert {r.id: r.score for r in toxicity.score(clash, again).collect()} == got


def test_toxicity_languages(spark):
    """Gapped and inserted-character insults in two languages; a decoy that clean texts have stays clean."""
    import random

    r = random.Random(1)
    plain = {"en": "the people walk around town and talk about many things today".split(), "de": "die leute gehen heute durch die kleine stadt und reden viel zusammen".split()}
    bad = {"en": ["blockhead", "numskull", "dimwit"], "de": ["dummkopf", "schwachkopf", "trottel"]}
    rows = []
    for i in range(240):
        lang = "en" if i % 2 else "de"
        text = [r.choice(plain[lang]) for _ in range(25)] + (["kopf"] if i % 5 == 0 else [])
        if i % 3 == 0:
            for w in r.sample(bad[lang], 2):
                text.insert(r.randrange(len(text)), w)
        rows.append((i, " ".join(text), int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    hidden = ["you block-head and num.skull", "b l o c k h e a d and dimxwit", "ein dumm*kopf und trotttel", "ein t r o t t e l und schwachtkopf", "du dummkqopf, du schwach_kopf"]
    assert min(model.scores(hidden)) >= 0.5
    clean = ["die leute reden heute viel im kopf", "many people walk around the town today", "", "\U0001f642", "привет 中文"]
    assert max(model.scores(clean)) < 0.5
    assert model.scores(["\U0001d41dimwit numskull"])[0] >= 0.5


def test_mixing(spark, odd):
    import numpy as np

    texts = [(i, ("good words here and more " * 5) if i % 2 else ("BAD!! JUNK!! " * 8)) for i in range(80)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "good" if i % 2 else "bad") for i in range(40)], "doc_id long, domain string")
    rows, domains, aims, told = mixing.mix(docs, labels, {"good": 3.0, "bad": 1.0}, ["doc_id"])
    got = rows.collect()
    total = sum(r._qw_tokens for r in got)
    share = [sum(r._qw_rate * r._qw_tokens * r._qw_posteriors[k] / 100 for r in got) / total for k in range(2)]
    assert domains == ["bad", "good"] and np.allclose(share, aims, atol=0.001) and np.allclose(share, told) and min(r._qw_rate for r in got) >= 0
    assert mixing.hundredths(np.array([[1 / 3, 1 / 3, 1 / 3]])).sum() == 100
    rows, domains, _, _ = mixing.mix(odd, labels.limit(0), {}, odd.columns)
    assert domains == ["all"] and {r._qw_rate for r in rows.collect()} == {1.0}
    clash = docs.withColumns({c: F.lit(1) for c in ("domain", "rate", "posteriors", "n_tokens", "h", "rank")})
    assert mixing.mixed_documents(clash, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).columns == clash.columns
    assert mixing.mixed_documents(docs.limit(0), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).count() == 0


@pytest.mark.parametrize("aim", [[0.93, 0.06, 0.01], [0.2, 0.2, 0.6], [0.0, 1.0, 0.0]])
def test_fit_rates(spark, aim):
    """Against projected gradient steps of the whole problem, one rate for each document, in numpy; the last aim can't be met."""
    import numpy as np

    r = np.random.default_rng(4)
    p = mixing.hundredths(r.dirichlet([1.5, 0.4, 0.2], 60))
    n = r.integers(1, 400, 60)
    df = spark.createDataFrame([(x.tolist(), int(k)) for x, k in zip(p, n, strict=True)], "posteriors array<long>, n_tokens long")
    prices, shares = mixing.fit_rates(df, aim, Scratch(spark, "t"), pull=1e-2)
    got = np.array([x[0] for x in df.select(mixing.rate(F.col("posteriors"), prices)).collect()])
    w, q = n / n.sum(), p / 100
    first = w @ q
    weight = 1 / np.maximum(np.maximum(first, aim), 1e-9)
    want = ahead = np.ones(60)
    # The gradient over each document's tokens; accelerated
    size = 1 / (1e-2 + (weight * (w[:, None] * q**2).sum(axis=0)).sum())
    for k in range(20000):
        slope = q @ (weight * ((w * ahead) @ q - aim)) + 1e-2 * (ahead - 1)
        new = np.maximum(0, ahead - size * slope)
        ahead, want = new + min(0.98, k / (k + 3)) * (new - want), new
    assert np.abs(got - want).max() < 1e-3 and np.allclose((w * got) @ q, shares, atol=1e-6)


def brute_licenses(texts, least=0.75):
    """By text, its matching units' numbers with licence and cosine; every unit against every template."""
    import math

    from quirework.llm import licenses as lic

    terms = lambda t: re.findall("[a-z0-9]+", t.lower())
    vocabulary = {t for _, u in lic.units() for t in u}
    n, df = len(texts), Counter(t for x in texts for t in set(terms(x or "")))
    idf = lambda t: math.log((1 + n) / (1 + df[t])) + 1 if t in vocabulary else math.log(1 + n) + 1
    vector = lambda counts: {t: (1 + math.log(k)) * idf(t) for t, k in counts.items()}
    norm = lambda v: math.sqrt(sum(w * w for w in v.values()))
    templates = [(name, vector(u)) for name, u in lic.units()]
    out = []
    for x in texts:
        found = {}
        if x:
            paragraphs = re.split(r"\n\s*\n", x)
            for k, part in enumerate([x] + (paragraphs if len(paragraphs) > 1 else []) + re.split(lic._CUT, x)):
                v = vector(Counter(terms(part)))
                best = min(((-round(sum(w * v.get(t, 0) for t, w in u.items()) / norm(v) / norm(u), 9), name) for name, u in templates if v), default=(0, ""))
                if -best[0] >= least:
                    found[k] = (best[1], -best[0])
        out.append(found)
    return out


def test_license_cosines(spark):
    import random

    from quirework.llm import licenses as lic

    r = random.Random(8)
    plain = "some words of a text about the software and its use by any person in the world with a notice".split()
    texts = [None, "", "  \n ", "x" * 3000, "Licensed under CC BY 4.0.", "licensed licensed LICENSED under under CC BY 4.0"]
    for _, t in lic.TEMPLATES:
        w = t.split()
        texts += [t, "# " + "\n# ".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9)), " ".join(r.choice(plain) for _ in range(30)) + ". " + t]
        texts.append(" ".join(x if r.random() < 0.8 else r.choice(plain) for x in w) + "\n\n" + " ".join(r.choice(plain) for _ in range(12)))
    want = brute_licenses(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "key long, text string").repartition(3)
    got = {}
    for x in lic.matches(df).collect():
        got.setdefault(x.key, {})[x.unit] = (x.license, x.cosine)
    for i, found in enumerate(want):
        mine = got.get(i, {})
        assert mine.keys() == found.keys(), texts[i]
        assert all(abs(mine[k][1] - found[k][1]) < 1e-8 and mine[k][0] == found[k][0] for k in found)
    assert sum(map(len, want)) > 100


def test_license_rows(spark, monkeypatch):
    """Clashing names, repeated rows, ties, empty tables; the salted join gives what the broadcast gives."""
    from quirework.llm import licenses as lic

    f = [(1, "a/LICENSE", "Licensed under CC BY 4.0."), (2, "a/b/x", "nothing"), (2, "a/b/x", "nothing"), (3, "c/y", None), (None, None, ""), (4, "a/COPYING", "Licensed under CC BY 4.0.")]
    docs = spark.createDataFrame(f, "doc_id long, path string, text string")
    names = ("best", "license", "cosine", "key", "unit", "near", "n_units", "size")
    clash = docs.withColumns({c: F.lit("mine") for c in names})
    got = sorted(map(str, lic.scan(docs).collect()))
    out = lic.scan(clash)
    assert out.columns == ["doc_id", "path", "best", "key", "unit", "near", "size", *lic.RESULT] and sorted(map(str, out.select(*lic.scan(docs).columns).collect())) == got
    monkeypatch.setattr(lic, "FEW", -1)
    assert sorted(map(str, lic.scan(docs).collect())) == got and len(got) == len(f)
    assert lic.scan(docs.limit(0)).count() == 0


def test_licenses(spark):
    from quirework.llm import licenses as lic

    f = [(1, "a/b/LICENSE", lic.TEMPLATES[1][1]), (2, "a/b/c/x.py", "hello world"), (3, "a/y.py", "nothing here"), (4, "LICENSE", "Licensed under CC BY-NC 4.0."), (5, "a/b/c/z.py", "# Licensed under the Apache License, Version 2.0."), (6, None, None), (7, "q", "")]
    got = {r.doc_id: (r.license, r.own, r.inherited) for r in lic.scan(spark.createDataFrame(f, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", True, False), 2: ("MIT", False, True), 3: ("CC-BY-NC-4.0", False, True), 4: ("CC-BY-NC-4.0", True, False), 5: ("Apache-2.0", True, False), 6: (None, False, False), 7: ("CC-BY-NC-4.0", False, True)}
