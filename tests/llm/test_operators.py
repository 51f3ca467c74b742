"""Each operator against a brute-force version, on small texts with every awkward case."""

import collections
import hashlib
import json
import random
import zlib

import numpy as np
import pytest
import xxhash

from ledgerloom.llm import debruijn, decontaminate, exact_dedup, html_extract, mixing, overlap, quality, simhash, suffix_index, token_counts, tool_calls
from ledgerloom.llm.components import components

#: Columns whose names an operator uses for itself.
CLASHING = ["batch", "addr", "digest", "fp", "part", "score", "copy", "size", "words", "Sha", "lost_id", "mix_rate", "own", "text_key"]


def texts() -> list[tuple]:
    rng = random.Random(3)
    words = ["Tubo", "de", "pvc", "ação", "ESGOTO", "25mm", "the", "of", "a,", "|"]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", str(rng.randint(0, 99))]) for _ in range(n))
    base = [prose(rng.randint(1, 90)) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t) for i, t in enumerate(base[:6])]  # copies
    rows += [(200 + i, t.upper()) for i, t in enumerate(base[:3])]
    rows += [(300 + i, prose(30) + " " + base[i] + "\n" + prose(5)) for i in range(8)]  # passages
    rows += [(400 + i, base[9].replace("pvc", "aço", 1) + f" {i}") for i in range(5)]  # near copies
    rows += [(500, None), (501, ""), (502, None), (503, " \t\n"), (504, "x"), (505, "a " * 60), (506, "ab" * 200), (507, "ab" * 90), (508, "z\x00y" * 40), (508, "z\x00y" * 40)]
    rows += [(None, base[0]), (None, "ninguém"), (600, "w" * 9000 + " fim"), (601, "w" * 9000), (7, base[7])]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if n % 7 == 0 else f"s{n % 4}", n, *[f"{c}{n}" if n % 5 else None for c in CLASHING]) for n, (i, t) in enumerate(texts())]
    extra = ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, n_chars long, {extra}").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def counted(rows) -> collections.Counter:
    return collections.Counter(tuple(r) for r in rows)


def test_exact_groups(docs, empty):
    groups = collections.defaultdict(list)
    for i, t in texts():
        groups[hashlib.sha256((t or "").encode().lower()).hexdigest()].append(i)
    for keep, best in (("max", max), ("min", min)):
        want = collections.Counter()
        for sha, ids in groups.items():
            known = [i for i in ids if i is not None]
            stays = best(known) if known else None
            for n, i in enumerate(sorted(ids, key=lambda x: (x is None, x))):
                again = sorted(ids, key=lambda x: (x is None, x))[:n].count(i)
                want[i, stays, len(ids), i == stays and not again, sha] += 1
        got = exact_dedup.exact_groups(docs, keep).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
        assert counted(got) == want
    assert exact_dedup.exact_groups(empty).count() == 0


def test_drop_exact_copies(docs, empty):
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns
    shas = [hashlib.sha256((r.text or "").encode().lower()).hexdigest() for r in left.collect()]
    assert len(shas) == len(set(shas)) == len({hashlib.sha256((t or "").encode().lower()).hexdigest() for _, t in texts()})
    assert exact_dedup.drop_exact_copies(empty).count() == 0


def brute_bytes(rows, length):
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], float("inf") if i is None else i)
    out = collections.Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < (float("inf") if i is None else i):
                gone[p : p + length] = True
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int), [0]))) == 1).sum())
        out[i, len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("length", "k"), [(50, 20), (12, 5)])
def test_suffix_dedup(docs, empty, length, k):
    assert counted(suffix_index.remove_repeats(docs, length, k).collect()) == brute_bytes(texts(), length)
    assert suffix_index.remove_repeats(empty, length, k).count() == 0


def test_suffix_dedup_keeps_bytes(docs):
    for r in suffix_index.remove_repeats(docs, keep_bytes=True).collect():
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed


def test_among_two_tells_equal_first_halves_apart():
    from ledgerloom.llm.anchors import among_two

    known, known2 = np.array([3, 5, 5, 5, 9], np.uint64), np.array([1, 1, 4, 6, 0], np.uint64)
    values, values2 = np.array([5, 5, 5, 5, 3, 3, 9, 9, 7], np.uint64), np.array([1, 4, 6, 5, 1, 2, 0, 1, 1], np.uint64)
    hit, at = among_two(values, values2, known, known2)
    assert hit.tolist() == [True, True, True, False, True, False, True, False, False]
    assert at[hit].tolist() == [1, 2, 3, 0, 4]
    assert not among_two(values, values2, known[:0], known2[:0])[0].any()


def test_suffix_dedup_of_chunks_and_a_hot_passage(spark):
    """More than a chunk of text in a batch, and one passage in most documents."""
    rng = random.Random(12)
    passage = " ".join(str(rng.random()) for _ in range(8))
    rows = [(i, " ".join(str(rng.random()) for _ in range(400)) + (passage if i % 4 else "") + f" {i}") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_index.remove_repeats(df).collect()}
    first: dict[bytes, int] = {}
    for i, t in rows:
        b = t.encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    for i, t in rows:
        b, gone = t.encode(), bytearray(len(t))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\x01" * 50
        spans = sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1]))
        assert got[i] == (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())


def test_suffix_index_levels_grow_geometrically():
    text = np.frombuffer(("abcde" * 400 + "xyz" * 300).encode(), np.uint8)
    at = np.arange(len(text) - 9)
    index = suffix_index.SuffixIndex(text, at, at.copy(), 10)
    for start in range(0, len(at), 64):
        index.add(np.arange(start, min(start + 64, len(at))))
    sizes = [len(x) for x in index.levels if x is not None]
    assert sorted(sizes) == sizes and all(b >= 2 * a for a, b in zip(sizes[1:], sizes[2:]))
    raw = text.tobytes()
    first = {}
    for p in at:
        first.setdefault(raw[p : p + 10], p)
    assert index.close().tolist() == [first[raw[p : p + 10]] for p in at]


def brute_words(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    count = collections.Counter(tuple(w[p : p + window]) for _, w in words for p in range(len(w) - window + 1))
    out = collections.Counter()
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if count[tuple(w[p : p + window])] > 1:
                gone[p : p + window] = [True] * window
        out[i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("window", "k"), [(35, 16), (6, 3)])
def test_debruijn_dedup(docs, empty, window, k):
    got = debruijn.remove_passages(docs, window, k).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert counted(got) == brute_words(texts(), window)
    assert debruijn.remove_passages(empty, window, k).count() == 0


def test_spans_come_from_the_compacted_graph(spark, docs, monkeypatch):
    rows = spark.createDataFrame([(i, "um dois três quatro cinco seis sete oito " * 12 + f"fim {i}") for i in range(4)], "doc_id long, text string")
    assert {r.n_removed > 0 for r in debruijn.remove_passages(rows).collect()} == {True}
    whole = debruijn.compacted
    monkeypatch.setattr(debruijn, "compacted", lambda segments: whole(segments).where("false"))
    assert {r.n_removed for r in debruijn.remove_passages(rows).collect()} == {0}


def test_spans_of_other_words_are_not_removed(spark, monkeypatch):
    """With edges that all collide, the words at the source decide."""
    monkeypatch.setattr(debruijn, "_edges", lambda tokens, window: np.full(max(0, len(tokens) - window + 1), 7, np.uint64))
    words = lambda a: " ".join(f"{a}{i}" for i in range(60))
    rows = spark.createDataFrame([(1, "gleich " * 40), (2, words("a")), (3, words("b"))], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in debruijn.remove_passages(rows).collect()}
    assert got[2] == got[3] == 0


def test_paths_are_compacted(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(words[:300])), (1, "a b c " + " ".join(words[50:250])), (2, "p q " + " ".join(words[300:]))]
    got = debruijn.repeated_paths(spark.createDataFrame(rows, "doc_id long, text string"), 10, 4).collect()
    assert [(r.n_edges, r.times) for r in got] == [(191, 2)]
    around = debruijn.repeated_paths(spark.createDataFrame([(0, "u v w " * 30)], "doc_id long, text string"), 10, 4).collect()
    assert sum(r.n_edges for r in around) == 3  # a path that closes on itself


def brute_simhash(rows, k, budget):
    def fp(t):
        w = (t or "").encode().lower().split()
        if not w:
            return 0
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [fp(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= budget:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    least = collections.defaultdict(list)
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[top(n)].append(i)
    return collections.Counter((i, f"{p:016x}", min(least[top(n)], default=None)) for n, ((i, _), p) in enumerate(zip(rows, prints)))


@pytest.mark.parametrize(("k", "budget"), [(4, 4), (2, 12), (4, 0)])
def test_simhash(docs, empty, k, budget):
    assert counted(simhash.near_groups(docs, k, budget).collect()) == brute_simhash(texts(), k, budget)
    assert simhash.near_groups(empty).count() == 0


def test_trie_finds_every_link():
    rng = np.random.default_rng(0)
    for n, budget in ((300, 4), (200, 14), (60, 64)):
        f = rng.integers(0, 2**62, 40).astype(np.uint64)[rng.integers(0, 40, n)]
        for _ in range(4):
            f = f ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        group = rng.integers(0, 3, n)
        forest = simhash.Forest()
        simhash.trie_links(f, group, budget, forest, np.arange(n))
        a, b, _ = forest.links()

        def labels(pairs):
            up = list(range(n))

            def top(x):
                while up[x] != x:
                    x = up[x]
                return x

            for x, y in pairs:
                x, y = top(x), top(y)
                up[max(x, y)] = min(x, y)
            return [top(i) for i in range(n)]

        near = (np.bitwise_count(f[:, None] ^ f[None]) <= budget) & (group[:, None] == group[None])
        assert labels(zip(a.tolist(), b.tolist())) == labels(zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1)))))
        assert len(a) < n


def shingles(t, k=5):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_drop_near_copies(docs, empty):
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns
    rows = [(10**9 if i is None else i, t) for i, t in texts()]
    sets = [shingles(t) for _, t in rows]
    same = [b" ".join((t or "").encode().lower().split()) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if same[a] == same[b] or both >= 0.8 * len(sets[a] | sets[b]) and sets[a]:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    want = collections.defaultdict(list)
    for n, (i, _) in enumerate(rows):
        want[top(n)].append(i)
    assert sorted({10**9 if r.doc_id is None else r.doc_id for r in left.collect()}) == sorted({min(v) for v in want.values()})
    assert simhash.drop_near_copies(empty).count() == 0


def left_by_force(rows):
    """The smallest id of each group of texts that shingle sets link."""
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i for n, (i, _) in enumerate(rows) if top(n) == n}


def test_drop_near_copies_in_a_group_of_one_template(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    form = [word() for _ in range(165)]
    rows = [(i, " ".join(form + [word() for _ in range(35)])) for i in range(500)]  # unlike, but within the bits of one another
    for i in range(60):
        w = rows[i][1].split()
        for at in (20, 60, 100, 140):
            w[at + i % 30] = word()
        rows.append((1000 + i, " ".join(w)))
    want = left_by_force(rows)
    assert len(want) == 500
    assert {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_drop_near_copies_with_repeated_lines_and_of_few_words(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    rows = []
    for i in range(30):
        w = [word() for _ in range(150)]
        rows += [(i, " ".join(w)), (1000 + i, " ".join(w + 20 * w[-15:]))]
    for i in range(200):  # four of five shingles
        w = [word() for _ in range(8)]
        rows += [(2000 + i, " ".join(w)), (3000 + i, " ".join([*w, word()]))]
    want = left_by_force(rows)
    assert len(want) == 230
    assert {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_prefix_pairs_lose_no_similar_pair():
    rng = np.random.default_rng(6)
    for _ in range(20):
        base = rng.integers(0, 2**64, 60, dtype=np.uint64)
        sets = [np.unique(rng.choice(base, rng.integers(1, 60))) for _ in range(60)]
        sets += [np.unique(np.concatenate((x[: rng.integers(0, 3)], x[rng.integers(0, 4) :]))) for x in sets]
        known = np.sort(base[:20])
        cut = [overlap.prefix(x, 0.8, known, np.arange(1, 21)) for x in sets]
        n = [len(x) for x in cut]
        same = np.repeat(np.arange(len(sets)), n)
        label = same // 3 if _ % 2 else same
        rows = (np.concatenate(cut).view(np.int64), same, label, np.repeat([len(x) for x in sets], n))
        met = collections.Counter()
        bit = rows[0].view(np.uint64) % np.uint64(128)
        words = np.zeros((len(sets), 2), np.uint64)
        np.bitwise_or.at(words, (same, (bit // np.uint64(64)).astype(int)), np.uint64(1) << bit % np.uint64(64))
        glance = () if _ % 3 else (np.bincount(same, minlength=len(sets))[same], words[same])
        for x, y, shared, least in overlap.block_pairs(*rows, 0.8, *glance):
            for a, b, k, w in zip(x.tolist(), y.tolist(), shared.tolist(), least.tolist()):
                met[a, b] += k
                met[a, b, "least"] = w
        got = {p for p in met if len(p) == 2 and met[p] >= met[*p, "least"]}
        for b in range(len(sets)):
            for a in range(b):
                both = len(np.intersect1d(sets[a], sets[b]))
                assert _ % 2 and a // 3 == b // 3 or both == 0 or both < 0.8 * (len(sets[a]) + len(sets[b]) - both) or (a, b) in got


def test_drop_near_copies_in_groups_of_many_differing_copies(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    rows = []
    for g in range(6):
        base = [word() for _ in range(rng.randint(60, 240))]
        for i in range(120):  # copies of copies, each a little off
            w = list(base)
            for _ in range(max(1, len(w) * rng.choice((1, 2, 3)) // 100)):
                w[rng.randrange(len(w))] = word()
            rows.append((1000 * g + i, " ".join(w)))
            if rng.random() < 0.2:
                base = w
    want = left_by_force(rows)
    assert len(want) < 200
    assert {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_counts_name_the_most_frequent(monkeypatch):
    monkeypatch.setattr(overlap, "KNOWN", 2000)
    rng = np.random.default_rng(1)
    counts = overlap.Counts()
    for _ in range(300):
        counts.add([np.unique(np.concatenate((np.arange(20, dtype=np.uint64), rng.integers(100, 2**60, 50).astype(np.uint64))))])
    value, n = counts.most()
    assert sorted(value.tolist()) == list(range(20)) and set(n.tolist()) == {300}


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(1000, i) for i in range(1001, 1400)] + [(i, i + 1) for i in range(2000, 2100)] + [(None, 3), (4, 4)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    assert got == {x: top(x) for x in list(up)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


PIECES = [b" ", b" a", b" ab", b"a", b"b", b"c", b"abc", b"bcx", b" abcd", b"d", b"x", b"cd"]


def greedy(word, pieces):
    n = 0
    while word:
        for size in range(len(word), 0, -1):
            if word[:size] in pieces:
                break
        else:
            return 1
        word, n = word[size:], n + 1
    return n


def test_automaton_counts_greedy_pieces():
    rng = random.Random(1)
    auto = token_counts.Automaton(PIECES)
    for _ in range(3000):
        w = b" " + bytes(rng.choice(b"abcdxq") for _ in range(rng.randint(1, 12)))
        assert auto.count(w) == greedy(w, set(PIECES)), w


def test_token_counts(docs, empty):
    pieces = set(token_counts.read_pieces(token_counts.VOCABULARY))
    want = collections.Counter((i, len((t or "").encode().split()), sum(greedy(b" " + w, pieces) for w in (t or "").encode().split() if len(w) < 2000) + sum(token_counts.Automaton(list(pieces)).count(b" " + w) for w in (t or "").encode().split() if len(w) >= 2000)) for i, t in texts())
    assert counted(token_counts.token_counts(docs).collect()) == want
    assert token_counts.token_counts(empty).count() == 0


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else share[s] for s in names}
        full |= over


def test_mix(docs, empty, spark):
    got = mixing.plan_mix(docs).collect()
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r.source] += len((r.text or "").encode().split())
    want = brute_targets(sizes)
    assert len(got) == docs.count()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.taken in (r.size * k for k in range(3))
        chance = int(hashlib.md5(f"mix-1{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16) / 2**32
        rate = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert r.copies == int(rate) + (chance < rate - int(rate))
    assert mixing.mix(docs).count() == sum(r.copies for r in got)
    assert mixing.plan_mix(empty).count() == mixing.mix(empty).count() == 0
    many = spark.range(4000).selectExpr("id as doc_id", "concat('s', id % 5) as source", "repeat('w ', cast(20 + id % 7 as int)) as text")
    by = collections.Counter()
    targets = {}
    for r in mixing.plan_mix(many).collect():
        by[r.source] += r.taken
        targets[r.source] = r.target
    assert all(abs(by[s] - t) < 0.1 * t for s, t in targets.items())


HTML = [
    ("<html><head><title>T</title></head><body><nav><a href=/>Menu, x</a></nav><article><h1>Head</h1><p>One, two &amp; three.<p>Four<br>five <b>six</b></article><footer>foot</footer></body>", "Head One, two & three. Four five six"),
    ("<body><div id=sidebar><p>links, many, commas, here, and, there</p></div><div class='main'><p>" + "Long text, with commas, and more. " * 8 + "</p><p>Second.</p></div><div class=comments><p>First, nice post, thanks</p></div></body>", ("Long text, with commas, and more. " * 8 + "Second.").strip()),
    ("", ""), (None, ""), ("<p>", ""), ("plain text", "plain text"), ("<script>var x='<p>no</p>'</script><p>yes</p>", "yes"), ("<!-- <p>no</p> --><p>a\n\t b&nbsp;c</p>", "a b c"),
    ("<div><p>unclosed <i>x<p>y</div>z", "unclosed x y z"),
    ("<ul><li>a<li>b</ul>" * 2, "a b a b"), ("<p>" * 3000 + "deep", "deep"), ("<div>" * 3000 + "deep", "deep"), ("<p title='>'>q</p>", "q"), ("<p>1 < 2</p>", "1 < 2"),
]


LONG = ("Long text, with commas, and more. " * 8).strip()
HTML += [  # names that mention what is no article, and parts of one that are short
    (f"<body><div class='site has-sidebar'><div class=content><p>{LONG}</p><p>End.</p></div><div class=sidebar><p>Side, a, b</p></div></div></body>", f"{LONG} End."),
    (f"<body><div class='post share-enabled'><p>{LONG}</p></div><div><p>Short, block.</p></div></body>", LONG),
    (f"<body><article><section id=search-algorithms><p>{LONG}</p></section><p class=related-work>Earlier work.</p></article></body>", f"{LONG} Earlier work."),
    (f"<body><article><p>{LONG}</p><figure><img src=x><figcaption>A caption.</figcaption></figure><p>The sum <math><mi>x</mi>+<mi>y</mi></math> is <label>named</label>.</p></article></body>", f"{LONG} A caption. The sum x+y is named."),
    (f"<body><div id=page><h1>Title</h1><section><h2>One</h2><p>{LONG}</p></section><h2>Between</h2><p>Brief.</p><ul><li>item</li></ul><section><h2>Two</h2><p>Small part.</p></section></div></body>", f"Title One {LONG} Between Brief. item Two Small part."),
    (f"<body><div class=widget><div><p>{LONG}</p><p>{LONG}</p></div><div class=comments><p>Nice, post</p></div></div></body>", f"{LONG} {LONG}"),
    (f"<body><div class=comment-list><p>{LONG}</p></div><article><p>{LONG} Yes.</p></article><div class='ad-banner'><p>{LONG}</p></div></body>", f"{LONG} Yes."),
]


def random_page(rng):
    """A page and its article, in one of many layouts."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n)) + "."
    para = lambda: f"{line(rng.randint(20, 60))} {line(12)[:-1]}, {line(9)}"
    text, body = [], []
    for _ in range(rng.randint(2, 6)):
        kind = rng.choice(("p", "p", "p", "h2", "li", "figcaption", "pre"))
        s = line(4) if kind in ("h2", "li", "figcaption") else para()
        text.append(s)
        body.append({"li": f"<ul><li>{s}</li></ul>", "figcaption": f"<figure><figcaption>{s}</figcaption></figure>"}.get(kind, f"<{kind}>{s}</{kind}>"))
    s = para()
    text.append(s)
    body.append(f"<p>{s}</p>")
    article = "".join(body)
    around = rng.choice(("<article>%s</article>", "<div class='post-content share-enabled'>%s</div>", "<main><div>%s</div></main>", "<div id=wrapper class=with-sidebar><div class=entry>%s</div></div>"))
    links = lambda: "".join(f"<li><a href=/{word()}>{line(3)}</a></li>" for _ in range(5))
    noise = [f"<div class='{c}'><p>{line(15)}</p></div>" for c in ("sidebar", "comment-list", "cookie-notice", "social-share", "newsletter signup", "ad")]
    noise += [f"<nav><ul>{links()}</ul></nav>", f"<footer><p>{line(8)}</p></footer>", f"<form><label>{line(2)}</label><input></form>", f"<script>{line(5)}</script>", f"<aside><p>{line(20)}</p></aside>"]
    rng.shuffle(noise)
    cut = rng.randint(0, 5)
    return f"<html><head><title>{line(3)}</title></head><body>{''.join(noise[:cut])}{around % article}{''.join(noise[cut : cut + 4])}</body></html>", " ".join(text)


def test_main_text_of_generated_pages():
    rng = random.Random(2)
    for _ in range(300):
        page, want = random_page(rng)
        assert html_extract.main_text(page) == want, page


@pytest.mark.parametrize(("page", "want"), HTML)
def test_main_text(page, want):
    assert html_extract.main_text(page) == want


def test_extract(spark):
    rows = [(i, f"u{i}", h, "clash") for i, (h, _) in enumerate(HTML)] + [(0, None, HTML[0][0], None), (None, "u", "<p>x</p>", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract(pages).collect()
    assert counted((r.page_id, r.url, r.text, r.n_chars) for r in got) == collections.Counter([(i, f"u{i}", w, len(w)) for i, (_, w) in enumerate(HTML)] + [(0, None, HTML[0][1], len(HTML[0][1])), (None, "u", "x", 1)])
    assert html_extract.extract(pages.where("false")).count() == 0


def test_quality_on_held_out_labels(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    out = [(got[i].predicted, q) for i, q in truth.items() if i in got and got[i].held_out]
    assert sum(a == b for a, b in out) >= 0.9 * len(out)


def test_quality_awkward_rows(docs, empty, spark):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(12)] + [(None, 1, 0), (3, None, 0), (99, 0, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels)
    assert got.count() == docs.count() and {r.predicted for r in got.collect()} <= {0, 1}
    assert quality.classify(empty, labels).count() == 0
    one = quality.classify(docs, labels.where("false")).select("score").distinct().collect()
    assert [r.score for r in one] == [0.5]
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_quality_features_see_the_whole_text():
    base = quality.features("x" * 64)
    for tail in ("y0" * 6000, "#" * 200, "A" * 64 + "b"):
        assert set(quality.features("x" * 64 + tail).tolist()) != set(base.tolist())
    long = "wörter " * 50 + "1a" * 100_000
    assert set(quality.features(long).tolist()) != set(quality.features(long + "!?" * 50_000).tolist())


def test_dual_descent_meets_the_conditions_of_the_optimum():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 40, 8)) for _ in range(60)]
    good = np.array([3 in r or 5 in r for r in rows])
    ratio = quality._ratios(rows, good)
    w, bias = quality._descend(rows, good, ratio, 1.0, 400, 1)
    x = np.zeros((60, 40))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.sqrt(len(r))
    x = np.hstack([x, np.ones((60, 1))])
    y = np.where(good, 1, -1)
    primal = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v)).sum()
    best = np.append(w[:40], bias)
    assert all(primal(best) <= primal(best + rng.normal(0, 0.05, 41)) + 1e-3 for _ in range(200))


def leak_rows(spark):
    rng = random.Random(9)
    vocab = [f"palavra{i}" for i in range(800)] + ["de", "a", "the", "of"] * 60
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, prose(rng.randint(12, 60)).capitalize() + ".") for i in range(12)] + [(50, None), (51, ""), (52, "!!")]
    docs, want = [], set()
    for d in range(150):
        t = prose(rng.randint(5, 300))
        if d % 10 == 0:
            i = d // 10 % 12
            item = items[i][1]
            w = item.split()
            if d % 20 == 0 and len(w) >= 20:  # a paraphrase: every eighth word another
                w = [rng.choice(vocab) if n % 8 == 4 else x for n, x in enumerate(w)]
                item = " ".join(w)
            t = f"{t} {item.upper() if d % 30 == 0 else item} {prose(20)}"
            want.add((d, i))
        docs.append((d, t))
    docs += [(900, None), (901, ""), (None, prose(40))]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), want


def test_leaks(spark):
    docs, items, want = leak_rows(spark)
    got = decontaminate.leaks(docs, items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    clean = decontaminate.drop_contaminated(docs, items)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in want}
    assert decontaminate.leaks(docs, items.where("false")).count() == 0
    assert decontaminate.leaks(docs.where("false"), items).count() == 0
    assert decontaminate.drop_contaminated(docs, items.where("item_id >= 50")).count() == docs.count()


def test_leaks_of_short_items_among_words_of_the_benchmark(spark):
    rng = random.Random(12)
    vocab = [f"p{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(15, 24)))) for i in range(40)]
    rows = []
    for d in range(160):
        few = rng.sample(vocab, 2)
        heavy = [rng.choice(few) for _ in range(rng.randint(80, 160))]
        w = items[d % 40][1].split()
        if d >= 80:  # a few words more, a few others
            w[3] = w[9] = "outra"
            w[6:6] = ["mais", "uma"]
        at = rng.randint(0, len(heavy))
        rows.append((d, " ".join(heavy[:at] + w + heavy[at:])))
    search = lambda w, part: (decontaminate.common_words(w, part) >= 0.7 * len(w)) and decontaminate.common_words(a := w[-max(1, len(w) // 4) :], part) >= 0.5 * len(a)
    want = set()
    for d, t in rows:
        t = t.split()
        for i, w in items:
            w = w.split()
            if any(search(w, t[at : at + len(w) + decontaminate.SPARE]) for at in range(len(t))):
                want.add((d, i))
    assert {(d, d % 40) for d in range(160)} <= want
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert want <= got


def test_common_words():
    rng = random.Random(4)
    for _ in range(300):
        a, b = [rng.randint(0, 5) for _ in range(rng.randint(1, 12))], [rng.randint(0, 5) for _ in range(rng.randint(0, 30))]
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.common_words(a, b) == t[-1, -1]


def test_vocabulary_finds_all_and_only_its_words():
    rng = np.random.default_rng(1)
    words = np.unique(np.concatenate((rng.integers(0, 2**63, 3000).astype(np.uint64), np.arange(50, dtype=np.uint64) << np.uint64(40))))
    v = decontaminate.Vocabulary(words)
    assert (v.find(words) == np.arange(len(words))).all()
    assert (v.find(words + np.uint64(1)) == np.where(np.isin(words + np.uint64(1), words), np.searchsorted(words, words + np.uint64(1)), -1)).all()


TOOL = {"tools": [{"name": "soma", "parameters": {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "number"}, "s": {"type": "string"}}, "required": ["a"], "additionalProperties": False}}]}


def call(i, name, args):
    return {"id": i, "name": name, "arguments": args}


def test_chat_records(spark):
    rows = [
        (1, 0, "system", json.dumps(TOOL)),
        (1, 1, "user", 'olá "x"\n'),
        (1, 2, "assistant", json.dumps({"content": "ok", "tool_calls": [call("c1", "soma", {"b": 2.5, "a": 1}), call("c2", "soma", {"b": "x", "a": 1}), call("c3", "soma", {}), call("c4", "nada", {"a": 1}), call("c5", "soma", {"a": 1, "z": 2}), call("c6", "soma", "texto")]})),
        (1, 3, "tool", json.dumps({"tool_call_id": "c1", "content": "3.5"})),
        (1, 4, "tool", json.dumps({"tool_call_id": "c1", "content": "again"})),
        (1, 5, "tool", json.dumps({"tool_call_id": "lost", "content": "?"})),
        (2, 0, "tool", json.dumps({"tool_call_id": "k", "content": "early"})),
        (2, 1, "assistant", json.dumps({"tool_calls": [call("k", "soma", {"a": 1})]})),
        (2, 1, "assistant", json.dumps({"tool_calls": [call("k", "soma", {"a": 1})]})),
        (3, 0, "user", None), (3, 1, None, "{broken"), (None, None, "assistant", "{broken"), (3, 2, "assistant", "[]"), (3, 2, "assistant", "[]"), (3, 3, "assistant", '{"tool_calls": []}'),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, json string")
    got = tool_calls.chat_records(df).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.conv_id].append(r)
    one = {r.turn: r for r in by[1]}
    record = json.loads(one[2].json)
    errors = [c.get("error") for c in record["tool_calls"]]
    assert errors == [None, "wrong type b", "missing a", "unknown tool", "unexpected z", "arguments are no object"]
    assert (one[2].n_calls, one[2].n_linked, one[2].n_invalid) == (6, 1, 5) and record["tool_calls"][0]["linked"] is True
    assert '"arguments":{"a":1,"b":2.5}' in one[2].json
    assert [one[t].status for t in (0, 1, 2, 3, 4, 5)] == ["plain", "plain", "calls", "linked", "repeated", "orphan"]
    assert json.loads(one[1].json) == {"content": 'olá "x"\n', "role": "user"}
    order = [r.role for r in sorted(by[2], key=lambda r: (r.ord_turn, r.ord_kind, r.ord_pos))]
    assert order == ["assistant", "assistant", "tool"]  # the result moves behind its call
    assert sum(r.json == '{"content":"[]","role":"assistant"}' for r in by[3]) == 2
    assert tool_calls.chat_records(df.where("false")).count() == 0


SCHEMA = {
    "properties": {
        "unit": {"enum": ["m", "kg", 3, None]}, "n": {"type": ["integer", "null"], "minimum": 1, "exclusiveMaximum": 10}, "code": {"type": "string", "pattern": "^[A-Z]+$", "maxLength": 4},
        "place": {"type": "object", "required": ["city"], "additionalProperties": False, "properties": {"city": {"type": "string"}, "tags": {"type": "array", "items": {"type": "string"}, "maxItems": 2}}},
        "rows": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["id"], "properties": {"id": {"type": "number"}}}}, "kind": {"const": "a"}, "free": {},
    },
    "required": ["n"],
}
ARGUMENTS = [
    ({"n": 1}, None), ({"n": None}, None), ({"n": 1.5}, "wrong type n"), ({"n": "1"}, "wrong type n"), ({"n": 0}, "out of range n"), ({"n": 10}, "out of range n"), ({}, "missing n"),
    ({"n": 2, "unit": "kg"}, None), ({"n": 2, "unit": 3}, None), ({"n": 2, "unit": None}, None), ({"n": 2, "unit": "3"}, "not in enum unit"), ({"n": 2, "unit": ["m"]}, "not in enum unit"),
    ({"n": 2, "code": "AB"}, None), ({"n": 2, "code": "ab"}, "not of the pattern code"), ({"n": 2, "code": "ABCDE"}, "out of range code"),
    ({"n": 2, "place": {"city": "x", "tags": ["a"]}}, None), ({"n": 2, "place": {}}, "missing place.city"), ({"n": 2, "place": {"city": "x", "zip": 1}}, "unexpected place.zip"), ({"n": 2, "place": {"city": 1}}, "wrong type place.city"),
    ({"n": 2, "place": {"city": "x", "tags": ["a", 1]}}, "wrong type place.tags[1]"), ({"n": 2, "place": {"city": "x", "tags": ["a", "b", "c"]}}, "wrong length place.tags"), ({"n": 2, "place": []}, "wrong type place"),
    ({"n": 2, "rows": []}, "wrong length rows"), ({"n": 2, "rows": [{"id": 1}, {"id": 2.5}]}, None), ({"n": 2, "rows": [{"id": 1}, {}]}, "missing rows[1].id"), ({"n": 2, "rows": [{"id": "1"}]}, "wrong type rows[0].id"),
    ({"n": 2, "kind": "a"}, None), ({"n": 2, "kind": "b"}, "not the constant kind"), ({"n": 2, "free": {"any": [1, None]}, "more": 1}, None), ([], "arguments are no object"), (None, "arguments are no object"),
]


def test_arguments_are_validated_by_nested_schemas(spark):
    rows = [(i, json.dumps(a), json.dumps(SCHEMA), want) for i, (a, want) in enumerate(ARGUMENTS)]
    rows += [(100, '{"n": 1', json.dumps(SCHEMA), "arguments are no object"), (101, None, json.dumps(SCHEMA), "arguments are no object"), (102, "{}", None, "unknown tool"), (103, '{"a": 1}', "{}", None), (104, "{}", "no schema", None)]
    df = spark.createDataFrame(rows, "i int, arguments string, parameters string, want string")
    from pyspark.sql import functions as F

    got = df.select("i", "want", tool_calls.argument_error(F.col("arguments"), F.col("parameters")).alias("got")).collect()
    assert [(r.i, r.got) for r in got] == [(r.i, r.want) for r in got]


def test_many_calls_and_results_link(spark):
    """Generated conversations, a third of all messages in one of them, null ids and long texts among them, against a plain-Python version."""
    rng = random.Random(21)
    rows = []
    for n in range(400):
        conv, turn = (7 if rng.random() < 0.33 else rng.randint(0, 40)), rng.randint(0, 30)
        ident = lambda: rng.choice([None, *(f"c{i}" for i in range(25))])
        if rng.random() < 0.5:
            rows.append((conv, turn, "assistant", json.dumps({"content": "x" * rng.choice((1, 5000)), "tool_calls": [{"id": ident(), "name": "f", "arguments": "{}"} for _ in range(rng.randint(1, 3))]})))
        else:
            rows.append((conv, turn, "tool", json.dumps({"tool_call_id": ident(), "content": str(n)})))
    got = tool_calls.chat_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    owners, answers = {}, {}
    for conv, turn, role, text in rows:
        m = json.loads(text)
        if role == "assistant":
            for pos, c in enumerate(m["tool_calls"]):
                if c["id"] is not None:
                    owners[conv, c["id"]] = min(owners.get((conv, c["id"]), (turn, text.encode(), pos)), (turn, text.encode(), pos))
        elif m["tool_call_id"] is not None:
            answers[conv, m["tool_call_id"]] = min(answers.get((conv, m["tool_call_id"]), (turn, text.encode())), (turn, text.encode()))
    linked = sum(1 for k in owners if k in answers)
    assert sum(r.n_linked for r in got) == linked
    assert sum(r.status == "linked" for r in got) == linked
    assert all(r.n_invalid == r.n_calls for r in got)  # no tools are declared
    place = {}
    for r in got:
        place.setdefault(r.conv_id, []).append((r.ord_turn, r.ord_kind, r.ord_pos, r.status))
    assert sum(s[3] == "orphan" for v in place.values() for s in v) == sum(1 for conv, _, role, text in rows if role == "tool" and json.loads(text)["tool_call_id"] is not None and (conv, json.loads(text)["tool_call_id"]) not in owners)


def test_chat_records_stay_in_the_engine(spark, sf_dir):
    plan = tool_calls.chat_records(spark.read.parquet(f"{sf_dir}/conversations.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_oracle_sql(spark, sf_dir):
    from ledgerloom.llm import queries

    from ..oracle import assert_same

    for name, sql in queries.ORACLE_SQL.items():
        assert assert_same(queries.QUERIES[name], sql, spark, sf_dir) > 0


def test_chain_pairs_try_texts_of_unlike_parts_and_grow_with_the_rows():
    rng = np.random.default_rng(3)
    found = {}
    for n in (200, 1000):  # one block in forty tokens; two parts, one of them small; neither text that names a part need be similar to another's
        same = np.sort(rng.choice(10**9, n, replace=False)).astype(np.int64)
        part = np.where(np.arange(n) % 10 == 3, same[3], same[0])
        token, rows = np.repeat(np.arange(40), n), [np.tile(x, 40) for x in (same, part, np.full(n, 200))]
        turns = [overlap.chain_pairs(token, *rows, 0.8, turn) for turn in (1, 2)]
        label = dict(zip(same.tolist(), part.tolist()))
        for a, b, shared, least in turns:
            assert all(label[x] != label[y] and x < y for x, y in zip(a.tolist(), b.tolist()))
            assert (shared == 40).all() and (shared >= least).all()
            assert set(a.tolist()) | set(b.tolist()) == set(same.tolist())  # every text is tried with one of the other part
            assert len(a) <= (overlap.BESIDE + 2) * n
        assert set(zip(*(x.tolist() for x in turns[0][:2]))) != set(zip(*(x.tolist() for x in turns[1][:2])))
        found[n] = len(turns[0][0])
    assert found[1000] <= 6 * found[200]
    token, rows = np.zeros(2, np.int64), [np.array(x) for x in ([1, 2], [1, 2], [10, 13])]
    assert not len(overlap.chain_pairs(token, *rows, 0.8)[0])  # sizes that cannot be similar
    assert not len(overlap.chain_pairs(*[np.empty(0, np.int64)] * 4, 0.8)[0])
