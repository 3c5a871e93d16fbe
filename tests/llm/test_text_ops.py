import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.llm import mixing, packing, quality_classifier, quality_rules, token_counts, toxicity
from weirflow.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def rule_counts(t):
    t = t or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = [False] * len(w)
    for i in range(len(w) - 7):
        if grams[tuple(w[i : i + 8])] > 1:
            hit[i : i + 8] = [True] * 8
    lines = [x for x in t.split("\n") if WORD.search(x)]
    repeats = sum(hit)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeats, len(w) < 20 or 100 * repeats > 30 * len(w)


def test_rule_counts(docs, rows, odd, empty, labels):
    got = by_id(quality_rules.judged(docs, labels))
    for r in rows:
        g = got[r[0]]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == rule_counts(r[1]), r[0]
        assert not (g.base_failed and g.kept)
    assert quality_rules.judged(odd, labels).count() == odd.count()
    assert quality_rules.judged(empty, labels).count() == 0


def test_binomial_tail(spark):
    from pyspark.sql import functions as F

    cases = [(100, 0), (100, 3), (1000, 12), (50_000, 480), (7, 7), (0, 0)]
    got = spark.createDataFrame(cases, "n long, k long").select("n", "k", quality_rules.tail(F.col("n"), F.col("k"), 0.01).alias("p")).collect()
    for r in got:
        want = 1.0 if r.k > r.n * 0.01 else sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.01) + (r.n - i) * math.log(0.99)) for i in range(r.k + 1))
        assert r.p == pytest.approx(want, rel=1e-6)


def test_certified_cutoffs_reject_junk_only(spark):
    good = "plain words that make up a quiet text of some length and say little but repeat nothing much of what was said".split()
    rows = []
    for i in range(4000):
        words = [good[(i * 7 + k * k + k * i) % len(good)] + str((i * k) % 97) for k in range(30)]
        junk = i % 8 == 0
        rows.append((i, " ".join(w + "***" if junk else w for w in words), int(not junk)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = quality_rules.judged(df.select("doc_id", "text"), df.select("doc_id", "quality")).where("not base_failed").join(df, "doc_id").groupBy("quality", "kept").count().collect()
    assert sorted((r.quality, r.kept) for r in got) == [(0, False), (1, True)] and sum(r["count"] for r in got) > 3500


def test_token_counts(docs, rows, odd, empty):
    path = tokenizer_path("piece_bpe_32k.model")
    m = token_counts.model(path)
    assert token_counts.separable(path)
    got = by_id(token_counts.token_counts(docs, path, 100))
    for r in rows:
        t, g = r[1] or "", got[r[0]]
        assert (g.n_bytes, g.n_tokens, g.over_limit) == (len(t.encode()), len(m.encode(t)), len(m.encode(t)) > 100), r[0]
    assert token_counts.token_counts(odd, path).count() == odd.count()
    assert token_counts.token_counts(empty, path).count() == 0


def test_token_counts_of_odd_texts():
    path = tokenizer_path("piece_bpe_32k.model")
    m = token_counts.model(path)
    lengths = token_counts.Lengths({}, path)
    for t in ["", " ", "  ", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "\n", "\na", "a\n", "a \n b", "a▁b", "▁", "a ▁b", "x\ty\r\nz", "<s> </s>", "\x00", "𝔘nicode ﬁ é", "a　b"]:
        assert token_counts.count_text(t, lengths) == len(m.encode(t)), repr(t)


def test_cache_halves(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 5)
    path = tokenizer_path("piece_bpe_32k.model")
    lengths, m = token_counts.Lengths({"the": 1}, path), token_counts.model(path)
    for k in range(50):
        assert lengths[f"w{k % 11}"] == len(m.encode(f"w{k % 11}"))
    assert len(lengths) <= 6 and len(lengths.older) <= 6 and lengths["the"] == 1


def pack_checks(got, rows, capacity, most=None):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    by = defaultdict(list)
    bins = defaultdict(list)
    for g in got:
        by[g.doc_id].append(g)
        bins[g.sequence_id].append(g)
    for r in rows:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by[r[0]], key=lambda g: g.piece)
        assert [p.piece for p in pieces] == list(range(-(-len(ids) // capacity)))
        for p in pieces:
            part = ids[p.piece * capacity : (p.piece + 1) * capacity]
            assert (p.start, p.length, p.ids_crc32) == (p.piece * capacity, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    total = 0
    for b in bins.values():
        at = 0
        for g in sorted(b, key=lambda g: g.offset):
            assert g.offset == at
            at += g.length
        assert at <= capacity and (most is None or len(b) <= most)
        total += at
    return len(bins), -(-total // capacity)


def test_packing(docs, rows, odd, empty):
    path = tokenizer_path("word_bpe_49k.json")
    used, least = pack_checks(packing.pack(docs, path, 512).collect(), rows, 512)
    assert used <= 1.05 * least + 2
    pack_checks(packing.pack(docs, path, 512, most_documents=2).collect(), rows, 512, 2)
    assert packing.pack(odd, path).count() >= odd.count()
    assert packing.pack(empty, path).count() == 0


def test_best_fit_keeps_every_constraint():
    rng = np.random.default_rng(4)
    length = np.sort(rng.integers(1, 900, 700))[::-1].astype(float)
    demand = np.stack([length, np.ones_like(length), length**2], axis=1)
    for capacity in ((1000, 1000, 1e9), (1000, 3, 1e9), (1000, 1000, 500_000)):
        bins = packing.vector_best_fit(demand, np.array(capacity, float), np.array([1.0, 0.1, 0.1]))
        sums = np.zeros((bins.max() + 1, 3))
        np.add.at(sums, bins, demand)
        alone = np.bincount(bins) == 1
        assert ((sums <= np.array(capacity) + 1e-6).all(axis=1) | alone).all()


def test_each_resource_decides_on_bins():
    """Two bins with the same tokens left: the norm's other weights choose the one with fewer documents, or with less cost, left."""
    first = np.array([[300, 1], [150, 1], [150, 1]], float)  # one bin of a single piece, one of two
    demand = lambda rows: np.column_stack([rows, rows[:, 0] ** 2])
    rows = demand(np.r_[[[900.0, 1]], [[700, 1]], [[200, 1]], [[50, 1]]])  # 900 | 700 + 200 | the last fits both
    capacity = np.array([1000, 4, 1_000_000], float)
    alone = packing.vector_best_fit(rows, capacity, np.array([1.0, 0.0, 0.0]))
    assert alone.tolist() == [0, 1, 1, 0]
    assert packing.vector_best_fit(rows, capacity, np.array([1.0, 1.0, 0.0])).tolist() == [0, 1, 1, 1]  # the bin with more documents is nearer to full
    assert packing.vector_best_fit(rows, capacity, np.array([1.0, 0.0, 1.0])).tolist() == [0, 1, 1, 0]  # the one with more cost
    assert packing.vector_best_fit(demand(first), np.array([1000, 2, 1e6]), np.array(packing.WEIGHTS)).tolist() == [0, 0, 1]  # two documents at most


def test_other_rules_of_a_tokenizer_are_left_to_it(tmp_path):
    import json

    with open(tokenizer_path("word_bpe_49k.json")) as f:
        spec = json.load(f)
    assert packing.plain_rules(spec)
    spec["normalizer"]["normalizers"] = spec["normalizer"]["normalizers"][:2]
    (tmp_path / "cased.json").write_text(json.dumps(spec))
    words = packing.Words(str(tmp_path / "cased.json"))
    assert words.merge is None
    for t in ("Hello World", "plain words."):
        assert words.encode([t])[0] == np.array(words.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_word_encoder_agrees_with_the_tokenizer(rows):
    words = packing.Words(tokenizer_path("word_bpe_49k.json"))
    assert words.merge is not None
    odd = ["a<|endoftext|>b  c", "'s don't I'LL x've", "ﬁ Ａb é́ ́ a b \x1c\x1dx\x85y İI ẞß ǅ 12½² ٣ --..!!''\"", " ​ zero", "÷×µªº ÿŸ", "naïve-Über,École!!!"]
    for t in [r[1] or "" for r in rows] + odd:
        assert words.encode([t])[0] == np.array(words.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t[:80]


def filled(sizes, budget, most, weights):
    """Targets by raising them together and stopping the full ones."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = budget * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def test_mixing(docs, rows, odd, empty):
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    by_source = defaultdict(int)
    for r in rows:
        by_source[r[3]] += size[r[0]]
    targets = filled(dict(by_source), 1.5, 2.0, (3, 1, 2))
    got = by_id(mixing.mix(docs))
    assert {d: g.taken for d, g in by_id(mixing.mix(docs.repartition(2))).items()} == {d: g.taken for d, g in got.items()}
    taken = defaultdict(int)
    for r in rows:
        g = got[r[0]]
        assert (g.size, g.source_size) == (size[r[0]], by_source[r[3]])
        assert g.target == pytest.approx(targets[r[3]])
        assert 0 <= g.taken <= 2 * g.size
        taken[r[3]] += g.taken
    for s, t in targets.items():
        assert abs(taken[s] - t) <= max(48, 0.02 * t), s
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(empty).count() == 0
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    by_doc = defaultdict(list)
    for r in mixed.collect():
        by_doc[r.doc_id].append(r)
    for r in rows:
        texts, words = [x.text for x in by_doc[r[0]]], WORD.findall(r[1] or "")
        assert sum(len(WORD.findall(t)) for t in texts) == got[r[0]].taken
        assert all(x.n_chars == len(x.text) and x.source == r[3] for x in by_doc[r[0]])
        left = [t for t in texts if t != r[1]]  # the words of chosen blocks, in their order
        assert len(left) <= 1
        at = iter(words)
        assert all(w in at for t in left for w in WORD.findall(t))
    twin = odd.withColumn("plan", F.lit("x")).withColumn("plan_doc", F.lit(1)).withColumn("plan_size", F.lit(2))
    again = mixing.mixed(twin)
    assert again.columns == twin.columns and again.count() > 0 and mixing.mixed(empty).count() == 0
    wide = mixing.mixed(docs, block=64, shard=300).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()
    assert all(abs(r.n - targets[r.source]) <= 32 + 64 * (1 + by_source[r.source] / 300) for r in wide)


def test_blocks_of_sources_go_by_highest_quotients(docs, rows):
    """Blocks that all sources still lack are dealt one by one; the shards of a source get all of its blocks."""
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    by_source = defaultdict(int)
    for r in rows:
        by_source[r[3]] += size[r[0]]
    targets = filled(dict(by_source), 1.5, 2.0, (3, 1, 2))
    plan = mixing._placed(mixing._sized(docs), 1.5, 2.0, 64, 400, 7).collect()
    rest = {s: targets[s] - int(targets[s] // by_source[s]) * by_source[s] for s in by_source}
    key = {r.source: r.key for r in plan}
    won = sainte_lague({key[s]: v for s, v in rest.items() if v > 1e-6}, round(sum(rest.values()) / 64))
    quota = {(r.key, r.part): r.quota for r in plan}
    for k, n in won.items():
        assert sum(q for (a, _), q in quota.items() if a == k) == n
    chosen = {(r.key, r.part): sum((k * mixing._STEP + r.turn) % r.blocks < r.quota for k in range(r.blocks)) for r in plan if r.blocks}
    assert all(n == min(quota[p], next(r.blocks for r in plan if (r.key, r.part) == p)) for p, n in chosen.items())
    for r in plan:
        assert r.taken == r.rounds * r.size + sum(b - a for a, b in mixing.chosen_words(*[r[c] for c in mixing._PLAN]))


def sainte_lague(weights, seats):
    quota = dict.fromkeys(weights, 0)
    for _ in range(seats):
        best = max(sorted(weights), key=lambda p: weights[p] / (2 * quota[p] + 1))
        quota[best] += 1
    return quota


def test_apportionment(spark):
    import random

    rng = random.Random(6)
    seats, weights, want = [], [], {}
    for key in range(12):
        w = {p: rng.choice([0, 1, 5, 40, 333, 1000]) for p in range(rng.randint(1, 9))}
        if not any(w.values()):
            w[0] = 3
        n = rng.choice([0, 1, 2, 7, 50, 211])
        seats.append((key, n))
        weights += [(key, p, v) for p, v in w.items()]
        want |= {(key, p): q for p, q in sainte_lague({p: v for p, v in w.items() if v}, n).items()}
    got = mixing.sainte_lague(spark.createDataFrame(seats, "key long, blocks long"), spark.createDataFrame(weights, "key long, part int, weight long"), ["key"])
    assert {(r.key, r.part): r.quota for r in got.collect()} == want


def auc(pairs):
    good = [s for s, y in pairs if y == 1]
    bad = [s for s, y in pairs if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_toxicity_on_held_out_rows(corpus, odd, empty, labels):
    docs, marks = corpus
    got = toxicity.toxicity(docs, marks).join(marks, "doc_id").where("held_out").collect()
    assert auc([(r.score, r.toxic) for r in got]) > 0.9
    assert sum(r.predicted != r.toxic for r in got) <= 0.08 * len(got)
    assert toxicity.toxicity(odd, labels).count() == odd.count()
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(odd, labels.limit(0)).count() == odd.count()


def test_lexicon_folds_copies_only(spark):
    """Different texts that share a frequent word are all learned from; copies in other case or spacing count once."""
    words = ["quorl", "zimbed", "vantic", "ploster"]
    rows = [(i, f"the {words[i % 4]} a{i} b{i} c{i}", 1) for i in range(80)] + [(100 + i, f"the d{i} e{i} f{i}", 0) for i in range(80)]
    rows += [(200 + i, "The  only\ncopied text" if i % 2 else "the only copied TEXT ", 1) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert {f" {w} " for w in words} <= set(lexicon.weights)
    assert " copied " not in lexicon.weights and " the " not in lexicon.weights


def plain_score(lexicon, text):
    """A score by regular expressions and sums, without the automaton."""
    folded = toxicity.fold(text)
    words = folded.split()
    spared = [False] * len(words)
    for phrase in lexicon.exceptions:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                spared[i : i + len(p)] = [True] * len(p)
    total = 0.0
    for w, s in zip(words, spared):
        own = [v for t, v in lexicon.weights.items() if (t == f" {w} " if t.endswith(" ") else f" {w}".startswith(t))]
        total += 0.0 if s else max(own, default=0.0)
    z = sum(c * v for c, v in zip(lexicon.curve, (1.0, float(total > 0), math.log1p(total), math.log1p(100 * total / (len(words) + 11)))))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_scores_by_brute_force(corpus):
    """held_out, score and predicted of every row, by plain code and from the labels outside the fold alone."""
    from pyspark.sql import functions as F

    docs, marks = corpus
    out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    turned = marks.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    lexicon = toxicity.learn(docs, marks.where(~out))
    got, texts = by_id(toxicity.toxicity(docs, turned)), {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == set(texts)
    for d, g in got.items():
        assert g.held_out == (zlib.crc32(str(d).encode()) % 3 == 1)
        assert g.score == pytest.approx(plain_score(lexicon, texts[d] or ""))
        assert g.predicted == int(g.score >= 0.7)


def test_exception_phrases_are_learned(spark):
    """A word of insults that clean texts have in a fixed phrase counts elsewhere only."""
    rng = __import__("random").Random(2)
    filler = lambda: " ".join(f"f{rng.randrange(400)}" for _ in range(12))
    rows = [(i, f"{filler()} you zorp {filler()}", 1) for i in range(120)] + [(200 + i, filler(), 0) for i in range(700)]
    rows += [(1000 + i, f"{filler()}, the zorp museum. {filler()}", 0) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert " zorp " in lexicon.weights and " the zorp museum " in lexicon.exceptions and " you zorp " not in lexicon.exceptions
    low, high = lexicon.score("we saw the  Zorp museum today"), lexicon.score("you z0rp and the zorp museum")
    assert low == lexicon.score("we saw the old museum today") and low < 0.3 < 0.7 < high
    assert lexicon.score("the zorp museum") == pytest.approx(plain_score(lexicon, "the zorp museum"))


def test_lexicon_sees_through_disguises_and_spares_exceptions():
    lexicon = toxicity.Lexicon({" stupid ": 3.0, " lowei": 2.0}, [" not stupid "], (-3.0, 4.0, 0.0, 0.0))
    hits = lambda t: lexicon.features(t)[0]
    assert all(hits(t) for t in ["You STUPID!", "5tup1d,", "ѕtupіd", "Loweischaft", "ｓｔｕｐｉｄ"])
    assert not any(hits(t) for t in ["", "stupidity", "alowei", "it is not stupid at all"])
    assert hits("not stupid but stupid")


def test_quality_on_held_out_rows(corpus, odd, empty, labels):
    docs, marks = corpus
    got = quality_classifier.quality(docs, marks).join(marks, "doc_id").where("held_out").collect()
    assert auc([(r.score, r.quality) for r in got]) > 0.9
    assert quality_classifier.quality(odd, labels).count() == odd.count()
    assert quality_classifier.quality(empty, labels).count() == 0
    assert quality_classifier.quality(odd, labels.limit(0)).count() == odd.count()
    assert all(0 <= r.score <= 1 for r in quality_classifier.quality(odd, labels).collect())


def test_quality_scores_by_brute_force(corpus):
    """held_out, score and predicted of every row: densities by inverse matrices and determinants, from the rows outside the fold."""
    docs, marks = corpus
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    known = {r.doc_id: r.quality for r in marks.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in texts}
    x = np.array([quality_classifier.statistics(texts[d]) for d in sorted(known)])
    y = np.array([known[d] for d in sorted(known)])
    scale = x.std(axis=0) + 1e-3
    z = x / scale
    own = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum(own[c] * (y == c).mean() for c in (0, 1))
    spread = []
    for c in (0, 1):
        s = 0.8 * own[c] + 0.2 * pooled
        spread.append(0.9 * s + 0.1 * np.diag(np.diag(s)) + 0.01 * np.eye(len(s)))

    def gap(rows):
        density = []
        for c in (0, 1):
            off = rows / scale - z[y == c].mean(axis=0)
            density.append(-0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(spread[c]), off) - 0.5 * np.linalg.slogdet(spread[c])[1])
        d = density[1] - density[0]
        return np.sign(d) * np.log1p(np.abs(d))

    curve = toxicity.fit_logistic(np.column_stack([np.ones(len(y)), gap(x)]), y.astype(float))
    got = by_id(quality_classifier.quality(docs, marks))
    ids = sorted(texts)
    want = 1 / (1 + np.exp(-np.clip(curve[0] + curve[1] * gap(np.array([quality_classifier.statistics(texts[d]) for d in ids])), -30, 30)))
    assert len(got) == len(ids)
    for d, w in zip(ids, want.tolist()):
        assert got[d].score == pytest.approx(w, abs=1e-6)
        assert (got[d].held_out, got[d].predicted) == (zlib.crc32(str(d).encode()) % 5 == 0, int(got[d].score >= 0.3))


@pytest.mark.parametrize("name", ["op1_ngram_join", "op2_exact_dedup", "op3_substring_dedup", "op4_quality_rules", "op5_suffix_dedup"])
def test_queries_against_sql(spark, name):
    import duckdb

    from weirflow.llm import queries

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got, want = queries.queries()[name](spark, folder), con.sql(queries.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = [tuple(r[got.columns.index(n)] for n in names) for r in got.collect()]
    assert sorted(rows) == sorted(tuple(r[want.columns.index(n)] for n in names) for r in want.fetchall())


def test_a_repeated_labelled_id_counts_once(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(quality_classifier, "Discriminant", lambda x, y: seen.update(rows=len(y)))
    monkeypatch.setattr(toxicity, "fit_logistic", lambda x, y: seen.update(points=len(y)) or np.zeros(4))
    rows = [(i, f"text number {i} of some kind", int(i % 2)) for i in range(20)]
    marks = spark.createDataFrame(rows, "doc_id long, text string, mark int").selectExpr("doc_id", "mark as quality", "mark as toxic")
    docs = spark.createDataFrame([r[:2] for r in rows] + [(3, f"other text {i}") for i in range(50)], "doc_id long, text string")
    quality_classifier.learn(docs, marks)
    toxicity.learn(docs, marks)
    assert seen == {"rows": 20, "points": 20}


def test_labels_of_the_fold_are_not_learned(corpus):
    """Turning the labels of the held-out fold around changes no score."""
    from pyspark.sql import functions as F

    docs, marks = corpus
    out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    turned = marks.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = by_id(quality_classifier.quality(docs, marks)), by_id(quality_classifier.quality(docs, turned))
    assert all(a[d].score == b[d].score for d in a)
