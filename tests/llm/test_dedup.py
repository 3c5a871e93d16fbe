import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from weirflow.llm import exact_dedup, ngram_join, substring_dedup, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def squeezed(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def exact_expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[squeezed(r[1])].append((-len(r[1] or ""), r[0]))
    return {r[0]: (min(groups[squeezed(r[1])])[1], len(groups[squeezed(r[1])])) for r in rows}


@pytest.mark.parametrize("primes", [exact_dedup.PRIMES, (3, 5)])
def test_exact_groups(docs, rows, primes):
    """With tiny primes most fingerprints collide, and the comparison has to tell the texts apart."""
    got, want = by_id(exact_dedup.exact_groups(docs, primes=primes, piece=16)), exact_expected(rows)
    assert len(got) == len(rows)
    for r in rows:
        g = got[r[0]]
        assert (g.keep_id, g.group_size, g.kept) == (*want[r[0]], want[r[0]][0] == r[0])
        assert g.text_sha256 == hashlib.sha256(squeezed(r[1]).encode()).hexdigest()


def test_pieces_of_long_texts_are_hashed_apart(spark, odd, monkeypatch):
    """Texts beyond the limit are hashed and compared in pieces of many tasks, across pieces whose borders white space moves."""
    body = "".join(chr(33 + k * k % 90) + "é" * (k % 3) for k in range(40_000))
    texts = [body, body[:70_000] + " \n" + body[70_000:], " " * 3_000 + body, body[:-1] + "~", body + "x", None, "", "short", "sh ort"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(2, texts[2]), (None, body)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for primes in (exact_dedup.PRIMES, (3, 5)):
        got = exact_dedup.exact_groups(df, primes, 1 << 12, 1 << 14).collect()
        plain = exact_dedup.exact_groups(df, primes).collect()
        key = lambda r: (r.text_sha256, r.doc_id is None, r.doc_id or 0, r.kept)
        assert sorted(got, key=key) == sorted(plain, key=key)
    marks = exact_dedup.long_marks(df.where("doc_id = 1").selectExpr("5L as row", "text"), exact_dedup.PRIMES, 1 << 12).collect()
    assert [(r.row, r.fp_a, r.fp_b, r.length) for r in marks] == [(5, *exact_dedup.fingerprint(squeezed(texts[1]).encode()), len(squeezed(texts[1]).encode()))]


def test_fingerprints_compose():
    data = bytes(range(256)) * 3000
    whole = exact_dedup.fingerprint(data)
    for cut in (0, 1, 1000, len(data) // 2):
        a, b = exact_dedup.fingerprint(data[:cut]), exact_dedup.fingerprint(data[cut:])
        assert whole == tuple(exact_dedup.combine(a[k], b[k], len(data) - cut, k) for k in (0, 1))


def test_exact_odd(odd, empty):
    got = exact_dedup.exact_groups(odd).collect()
    assert len(got) == odd.count()
    by = defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    assert all(sum(r.kept for r in g) == 1 for g in by.values())
    odd = odd.withColumns({n: F.lit("u") for n in ("_doc", "_sha0", "_sha", "group_doc", "group_sha", "key", "least", "row")})
    kept = exact_dedup.dedup(odd)
    assert {r.group_sha for r in kept.collect()} == {r["_sha0"] for r in kept.collect()} == {"u"}
    near = ngram_join.one_of_each(odd)
    assert near.columns == odd.columns and near.count() > 0
    assert kept.columns == odd.columns and kept.count() == len(by)
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.dedup(empty).count() == 0


def shingles(t, n):
    w = WORD.findall(lower(t))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def components(rows, n, percent):
    sets = [(r[0], shingles(r[1], n)) for r in rows]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        r = root(i)
        least[r] = d if least.get(r) is None else (least[r] if d is None else min(least[r], d))
    return [(d, len(s), least[root(i)]) for i, (d, s) in enumerate(sets)]


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (2, 50)])
def test_links(docs, rows, n, percent):
    got = by_id(ngram_join.linked(docs, n, percent))
    for d, size, component in components(rows, n, percent):
        assert (got[d].n_shingles, got[d].component_id) == (size, component), d


def test_links_odd(odd, empty):
    rows = [tuple(r)[:2] for r in odd.select("doc_id", "text").collect()]
    got = ngram_join.linked(odd, 4, 85).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(map(key, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(map(key, components(rows, 4, 85)))
    assert ngram_join.linked(empty).count() == 0
    assert ngram_join.one_of_each(odd).columns == odd.columns


def test_one_row_of_each_component_stays_under_null_and_repeated_ids(spark):
    copied = " ".join(f"w{k}" for k in range(60))
    alone = lambda name: " ".join(f"{name}{k}" for k in range(12))
    family = " ".join(f"n{k}" for k in range(60))
    rows = [(1, copied, "s"), (None, copied + " end", "s"), (None, alone("x"), "s"), (None, alone("y"), "s")]
    rows += [(5, copied + " tail", "s"), (5, alone("z"), "s"), (None, family, "s"), (None, family + " more", "s")]
    rows += [(8, alone("q"), "a"), (8, alone("q"), "b"), (8, alone("q"), "b"), (9, "", "s"), (9, "", "s"), (None, None, "s"), (None, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [tuple(r) for r in ngram_join.one_of_each(df.repartition(4)).collect()]
    families = [r for r in got if r[1] and r[1].startswith("n0 ")]
    assert len(families) == 1 and families[0][0] is None
    want = [(1, copied, "s"), (None, alone("x"), "s"), (None, alone("y"), "s"), (5, alone("z"), "s"), (8, alone("q"), "a"), (9, "", "s"), (9, "", "s"), (None, None, "s"), (None, None, "s")]
    assert sorted(map(str, got)) == sorted(map(str, want + families))


def test_bitmaps_bound_overlaps():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, m, shared in ((10, 12, 8), (300, 40, 40), (2000, 2100, 1900), (5, 5, 0)):
        pool = rng.integers(0, 2**63, n + m, dtype=np.uint64)
        a, b = np.unique(pool[:n]), np.unique(np.r_[pool[:shared], pool[n : n + m - shared]])
        assert ngram_join.overlap_bound(ngram_join.bitmap(a), ngram_join.bitmap(b), len(a), len(b)) >= len(np.intersect1d(a, b))


def test_prefixes_share_what_they_promise():
    """Of two sets that are similar enough, the first shingles of the overlap lie in both prefixes."""
    rng = __import__("random").Random(9)
    for percent in (50, 80, 85):
        for _ in range(400):
            n = rng.choice([1, 2, 3, 5, 9, 40, 41, 90, 200])
            a = set(rng.sample(range(1000), n))
            b = set(a)
            for _ in range(rng.randint(0, max(1, n // 5))):
                b.discard(rng.choice(sorted(a)))
                b.add(rng.randrange(1000))
            if not b or 100 * len(a & b) < percent * len(a | b):
                continue
            prefix = lambda s: set(sorted(s)[: ngram_join.prefix_length(len(s), percent)])
            shared = int(ngram_join.shared_least(min(len(a), len(b)), percent))
            assert len(prefix(a) & prefix(b)) >= shared
            for s in (a, b):  # what a set asks for by its own size alone
                low = -(-percent * len(s) // 100)
                assert shared >= min(1 + low // ngram_join.SHARED, -(-percent * low // 100))


def random_entries(rng, nodes, tiles):
    """Entries of nodes in tiles, as a shard has them, in order; and a label for each."""
    import numpy as np

    out = np.zeros(nodes, ngram_join._ENTRY)
    out["tile"], out["size"] = rng.integers(0, tiles, nodes), rng.integers(8, 40, nodes)
    out["place"], out["sid"] = rng.integers(0, 6, nodes), rng.permutation(nodes)
    return out[ngram_join.in_order(out)], rng.choice([1, 1, 1, 2, 3, 4, 5], nodes)


def plain_pairs(e, label, percent):
    found = set()
    for i in range(len(e)):
        for j in range(i + 1, len(e)):
            a, b = e[i], e[j]
            rest = min(int(a["size"]) - int(a["place"]), int(b["size"]) - int(b["place"])) + int(ngram_join.shared_least(min(int(a["size"]), int(b["size"])), percent)) - 1
            both = int(a["size"]) + int(b["size"])
            fine = a["tile"] == b["tile"] and label[i] != label[j] and 100 * int(a["size"]) >= percent * int(b["size"]) and 100 * rest >= percent * (both - rest)
            if fine and (a["side"] == 0 or a["side"] != b["side"]):
                found.add((i, j))
    return found


@pytest.mark.parametrize("hold", [7, 1 << 20])
def test_pairs_of_tiles_by_brute_force(monkeypatch, hold):
    import numpy as np

    monkeypatch.setattr(ngram_join, "HOLD", hold)
    rng = np.random.default_rng(3)
    for percent in (60, 85):
        entries, label = random_entries(rng, 150, 4)
        want = plain_pairs(entries, label, percent)
        got = [tuple(sorted(p)) for a, b in ngram_join.allowed_pairs(entries, label, percent) for p in zip(a.tolist(), b.tolist())]
        assert len(got) == len(set(got)) and set(got) == want and want
        partner = ngram_join.with_partner(entries, label, percent)
        assert {i for p in want for i in p} == set(np.flatnonzero(partner).tolist())
        monkeypatch.setattr(ngram_join, "LOOK", 3)
        assert {i for p in want for i in p} <= set(np.flatnonzero(ngram_join.with_partner(entries, label, percent)).tolist())
        monkeypatch.setattr(ngram_join, "LOOK", 64)


def test_blocks_of_large_tiles_hold_every_pair_once():
    import numpy as np

    rng = np.random.default_rng(5)
    entries, label = random_entries(rng, 200, 3)
    named = dict(zip(entries["sid"].tolist(), label.tolist()))
    whole = {frozenset(entries["sid"][list(p)].tolist()) for p in plain_pairs(entries, label, 85)}
    parts = list(ngram_join.blocks(entries, 85, 16))
    got = []
    for _, own in parts:
        own = own[ngram_join.in_order(own)]
        labels = np.array([named[s] for s in own["sid"].tolist()])
        got += [frozenset((int(own["sid"][i]), int(own["sid"][j]))) for a, b in ngram_join.allowed_pairs(own, labels, 85) for i, j in zip(a, b)]
    assert len(got) == len(set(got)) and set(got) == whole and len(parts) > 3
    assert max(len(own) for number, own in parts if number) <= 32


def test_forests_hold_back_what_they_do_not_give():
    import numpy as np

    rng = np.random.default_rng(6)
    sid, label = rng.permutation(60), rng.integers(0, 9, 60)
    for hold in (5, 1 << 20):
        forest = ngram_join.Forest(sid, label, True)
        asked = [(i, j) for i in range(60) for j in range(i) if label[i] != label[j] and rng.random() < 0.2]
        ngram_join.HOLD, before = hold, ngram_join.HOLD
        for i, j in asked:
            forest.add(np.array([i]), np.array([j]), np.array([rng.random()]))
        forest.settle()
        ngram_join.HOLD = before
        given = {frozenset(p) for p in zip(forest.a.tolist(), forest.b.tolist())}
        assert len(given) <= 8 and given <= {frozenset(p) for p in asked}
        assert all(frozenset(p) in given or (forest.held[p[0]] and forest.held[p[1]]) for p in asked)


def test_links_across_salts_blocks_and_passes(spark, monkeypatch):
    """A chain of near copies in frequent words, with every bound made small: links are those of brute force."""
    for name, value in (("SALT", 20), ("SHARD_BYTES", 2_000), ("LOOK", 2), ("HELD", 1), ("SEEN", 5), ("BROADCAST_ROWS", 0), ("WORD_CACHE", 50)):
        monkeypatch.setattr(ngram_join, name, value)
    monkeypatch.setattr(ngram_join, "SHARED", 7)
    monkeypatch.setattr(ngram_join.blocks, "__defaults__", (8,))
    rng = __import__("random").Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    rows, words = [], list(base)
    for k in range(90):
        words = list(words)
        words[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, " ".join(rng.sample(base, 30) + base[:30])) for k in range(30)] + [(200 + k, rows[k][1]) for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = by_id(ngram_join.linked(df, 3, 70))
    for d, size, component in components(rows, 3, 70):
        assert (got[d].n_shingles, got[d].component_id) == (size, component), d


def windows_expected(rows, width):
    words = [WORD.findall(r[1] or "") for r in rows]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for r, w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("width", [35, 50])
def test_substrings(docs, rows, width, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK", 100)
    got = by_id(substring_dedup.without_repeats(docs, width))
    for d, n, removed, sha in windows_expected(rows, width):
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (n, removed, sha), d


def test_substrings_odd(odd, empty):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    got = substring_dedup.without_repeats(odd, 35).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(key((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in got) == sorted(map(key, windows_expected(rows, 35)))
    assert substring_dedup.without_repeats(empty, 35).count() == 0


def test_fm_index_counts():
    import numpy as np

    rng = np.random.default_rng(2)
    text = np.concatenate([np.r_[rng.integers(1, 4, k), 0] for k in (30, 1, 17, 50)])
    index = substring_dedup.FMIndex(text, 5)
    plain = "".join(map(str, text))
    for length in (1, 2, 3, 5):
        patterns = rng.integers(1, 4, (40, length))
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high):
            s = "".join(map(str, p))
            assert b - a == sum(plain.startswith(s, i) for i in range(len(plain))), s


def bytes_expected(rows, width):
    first = {}
    rank = lambda d: (d is None, d or 0)
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    for d, b in data:
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            first[w] = min(first.get(w, rank(d)), rank(d))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < rank(d):
                gone[i : i + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffixes(docs, rows):
    got = by_id(suffix_dedup.without_earlier(docs, 50))
    for d, n, removed, spans, sha in bytes_expected(rows, 50):
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (n, removed, spans, sha), d


def test_suffixes_odd(odd, empty, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH", 3)
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    got = suffix_dedup.without_earlier(odd, 50).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(key((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == sorted(map(key, bytes_expected(rows, 50)))
    assert suffix_dedup.without_earlier(empty, 50).count() == 0


def test_levels_halve():
    """Levels are suffix arrays: starts into bytes, merged by scans, that answer like a table of windows."""
    import numpy as np

    rng = np.random.default_rng(7)
    family, seen, width = suffix_dedup.Family(), {}, 5
    for i in range(25):
        pieces = [bytes(rng.integers(0, 3, rng.integers(3, 30)).astype(np.uint8)) for _ in range(6)]
        data, starts, owner = suffix_dedup.piece_starts(pieces, width)
        ranks = np.array([100 * i + k for k in range(6)])[owner]
        own, place = suffix_dedup.Level.of(data, starts, ranks, width)
        assert own.windows().tolist() == sorted(set(own.windows().tolist())) and own.starts.dtype == np.int64
        text = data.tobytes()
        windows = [text[s : s + width] for s in starts.tolist()]
        for w, r in zip(windows, ranks.tolist()):
            seen[w] = min(seen.get(w, r), r)
        own.ranks = family.least(own)
        assert own.ranks[place].tolist() == [seen[w] for w in windows]
        family.add(own)
        sizes = [len(x) for x in family.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
    assert len({w for level in family.levels for w in level.windows().tolist()}) == len({w.rstrip(b"\0") for w in seen})


def test_matching_statistics():
    """The longest run that ends at a place and occurs twice, up to the depth, pieces that occur twice counting as such."""
    import numpy as np

    rng = np.random.default_rng(4)
    depth, parts = 4, [rng.integers(1, 4, k) for k in (40, 1, 25, 60)]
    text = np.concatenate([np.r_[p, 0] for p in parts])
    heavy = np.repeat([False, True, True, False], [41, 2, 26, 61])
    index = substring_dedup.FMIndex(text, depth, heavy)
    ends = np.flatnonzero(text)
    plain = "".join(map(str, text))
    for end, got in zip(ends.tolist(), index.statistics(text, ends).tolist()):
        want = 0
        for k in range(1, depth + 1):
            run = plain[end - k + 1 : end + 1]
            if end - k + 1 < 0 or "0" in run:
                break
            at = [i for i in range(len(plain)) if plain.startswith(run, i)]
            if sum(1 + heavy[i] for i in at) < 2:
                break
            want = k
        assert got == want, end
    assert not any(hasattr(index, n) for n in ("order", "text"))


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_components_of_chains_and_stars(spark, few, monkeypatch):
    """Both ways give the smallest node of each component; few edges take no rounds, each of which is a table and many small stages."""
    import random

    from weirflow.llm.common import Scratch
    from weirflow.llm.linkage import components as linked_nodes

    draw = random.Random(5)
    edges = [(7 * i, 7 * i + 7) for i in range(40)] + [(-5, 1000 + i) for i in range(30)] + [(3000 + i, 3000 + draw.randrange(60)) for i in range(60)] + [(9, 9), (-5, 1000), (1000, -5)]
    least = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in least:
        for u, v in edges:
            if u != v:
                least[u] = least[v] = min(least[u], least[v])
    tables, replaced = [], Scratch.replaced
    monkeypatch.setattr(Scratch, "replaced", lambda self, df, label, keep=1: tables.append(label) or replaced(self, df, label, keep))
    with Scratch(spark) as scratch:
        found = linked_nodes(spark.createDataFrame(edges, "u long, v long"), scratch, *([few] if few == 0 else []))
        assert {r.node: r.label for r in found.collect()} == least
    assert (len(tables) > 2) == (few == 0)


def test_a_shard_costs_no_square_of_its_size(monkeypatch):
    """Levels much larger than a batch are searched, not read as a whole for each batch; merges hold a part of a level at a time."""
    import numpy as np

    rng, plain = np.random.default_rng(8), suffix_dedup._windows
    monkeypatch.setattr(suffix_dedup, "BATCH", 8)
    monkeypatch.setattr(suffix_dedup, "PART", 100, raising=False)

    def touched(batches):
        read = []
        monkeypatch.setattr(suffix_dedup, "_windows", lambda data, starts, width: read.append(len(starts)) or plain(data, starts, width))
        pieces = [bytes(rng.integers(0, 9, 20).astype(np.uint8)) for _ in range(8 * batches)]
        ranks, width = rng.permutation(len(pieces)), 5
        masks = suffix_dedup._judge(width)(pieces, np.arange(len(pieces)), ranks, np.ones(len(pieces)))
        first = {}
        for p, r in zip(pieces, ranks.tolist()):
            for k in range(len(p) - width + 1):
                first[p[k : k + width]] = min(first.get(p[k : k + width], r), r)
        assert masks.tolist() == [sum(1 << k for k in range(len(p) - width + 1) if first[p[k : k + width]] < r) for p, r in zip(pieces, ranks.tolist())]
        return sum(read)

    assert touched(256) < 8 * touched(64)


def test_pairs_are_looked_at_in_small_blocks():
    """Pairs of a tile grow with the square of its nodes: what is held of them at once must not add up to a large part of a worker."""
    import tracemalloc

    import numpy as np

    entries = np.zeros(3000, ngram_join._ENTRY)
    entries["size"], entries["sid"] = 300, np.arange(3000)
    label = np.where(np.arange(3000) < 1500, 1, np.arange(3000))
    tracemalloc.start()
    try:
        pairs = sum(len(a) for a, _ in ngram_join.allowed_pairs(entries, label, 80))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert pairs == 1500 * 1500 + 1500 * 1499 // 2
    assert peak < 48 << 20
