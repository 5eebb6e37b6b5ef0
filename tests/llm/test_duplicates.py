import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from kindler.llm import common, rindex_dedup, signature_join, suffix_dedup
from kindler.llm import textkernel as K


@pytest.mark.parametrize("chunk", [1_500_000, 600])
def test_near_duplicates(spark, frame, docs, monkeypatch, chunk):
    """Also with blocks cut into many chunks, as large ones are."""
    monkeypatch.setattr(signature_join, "CHUNK_TOKENS", chunk)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in signature_join.near_duplicates(frame).collect()}
    assert got == brute.near_duplicates(docs)


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    rows = [(3, "a b c d e f g"), (3, "h i j k l m"), (2, "a b c d e f g"), (5, "H I j k l m"), (None, "a b c d e f g"), (None, "q"), (None, None), (2, "a b c d e f g")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in signature_join.near_duplicates(d).collect()), key=str)
    assert got == sorted([(3, 3, 2), (3, 2, 2), (2, 3, 2), (2, 3, 2), (5, 2, 2), (-1, 3, 2), (-1, 1, None), (-1, 0, None)], key=str)


def test_near_duplicates_where_nothing_meets(spark):
    """One row, and different rows on more partitions than rows."""
    for n, parts in ((1, 1), (40, 8), (3, 5)):
        docs = [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(n)]
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            got = signature_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (26, i) for i in range(n)}


def test_empty_tables(empty):
    assert signature_join.near_duplicates(empty).count() == 0
    assert suffix_dedup.dedup(empty).count() == 0
    assert rindex_dedup.dedup(empty).count() == 0


def sets_of(groups):
    flat = [np.unique(np.array(g, np.uint64)) for g in groups]
    return np.concatenate(flat), np.concatenate([[0], np.cumsum([len(f) for f in flat])])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(0, 60), min_size=1, max_size=30), min_size=1, max_size=40), st.integers(50, 95))
def test_tree_links_connect_what_all_pairs_do(groups, percent):
    tokens, bounds = sets_of([list(g) for g in groups])
    ids = np.arange(10, 10 + len(groups))
    a, b = signature_join.tree_links(ids, tokens, bounds, percent)

    def classes(pairs):
        root = {int(i): int(i) for i in ids}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in pairs:
            root[max(find(x), find(y))] = min(find(x), find(y))
        return [find(int(i)) for i in ids]

    every = [(int(ids[i]), int(ids[j])) for i in range(len(groups)) for j in range(i) if 100 * len(groups[i] & groups[j]) >= percent * len(groups[i] | groups[j])]
    assert classes(zip(a.tolist(), b.tolist(), strict=True)) == classes(every)
    assert {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)} <= {tuple(sorted(p)) for p in every}


def test_signature_tree_loses_no_pair():
    r = np.random.RandomState(0)
    groups = [r.randint(0, 3000, r.randint(5, 80)).tolist() for _ in range(150)]
    groups += [g[:-1] + [9999] for g in groups[:40]]
    tokens, bounds = sets_of(groups)
    tree = signature_join.SignatureTree(tokens, bounds, np.arange(len(groups)))
    found = {(int(x), int(y)) for a, b in tree.candidate_pairs(80) for x, y in zip(a, b, strict=True)}
    s = [set(g) for g in groups]
    want = {(i, j) for j in range(len(s)) for i in range(j) if 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])}
    assert want and want <= found and len(found) < 0.2 * len(s) ** 2 / 2


def test_components(spark):
    r = np.random.RandomState(4)
    pairs = [(int(a), int(b)) for a, b in r.randint(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(50)]
    got = {x["node"]: x["component"] for x in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {n: n for p in pairs for n in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {n: find(n) for n in root}


def removed(col="spans"):
    return F.aggregate(col, F.lit(0), lambda t, s: t + s["end"] - s["start"])


def test_substring_dedup(frame, docs):
    rows = {r["doc_id"]: r for r in suffix_dedup.dedup(frame).withColumn("n", removed()).collect()}
    for d, n_words, n_removed, kept in brute.substring_dedup(docs):
        assert (rows[d]["n_words"], rows[d]["n"], rows[d]["kept"]) == (n_words, n_removed, kept), d


@pytest.mark.parametrize("crowd", [False, True])
def test_substring_dedup_rows_and_prefixes(spark, monkeypatch, crowd):
    """Repeated rows are repeats of each other; ids may repeat or be null; small groups and crowded anchors give the same."""
    text = " ".join(str(i) for i in range(40))
    rows = [(1, text), (1, text), (1, "x y"), (None, "a " + text), (None, None), (2, text[:-3]), (3, "b a " * 300), (4, "c " + "a b " * 60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((str(a), b, c, e) for a, b, c, e in brute.substring_dedup(rows))
    if crowd:
        monkeypatch.setattr(suffix_dedup.R, "crowded", lambda *a: np.ones(1 << 14, bool))
        base = suffix_dedup.repeated_spans
        monkeypatch.setattr(suffix_dedup, "repeated_spans", lambda x, s, g: base(x, s, g, group=1))
    got = sorted((str(r["doc_id"]), r["n_words"], r["n"], r["kept"]) for r in suffix_dedup.dedup(d).withColumn("n", removed()).collect())
    assert got == want
    same = {r["doc_id"]: r["kept"] for r in suffix_dedup.dedup(spark.createDataFrame([(7, "a  b")], "doc_id long, text string"), carry=F.lit(1), verbatim=True).collect()}
    assert same == {7: "a  b"}


def test_crowded_cells_are_found(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup.R, "CROWD", 5)
    d = spark.createDataFrame([(" ".join(f"{i}x{k}" for k in range(40)) + " " + " ".join(f"c{k}" for k in range(45)) + " " + " ".join(f"{i}y{k}" for k in range(40)),) for i in range(60)], "text string")
    hot = suffix_dedup.R.crowded(d, "word", 35, 12, 4)
    assert len(hot) == 1 << 14 and 0 < hot.sum() < 12


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=30), min_size=1, max_size=12), st.integers(1, 5), st.integers(1, 40))
def test_subtrees_against_a_naive_tree(spans, size, most):
    """Internal nodes, their depths and leaves, and the words they cover, however the suffixes are split by prefixes."""
    symbol = np.array([ord(c) - 96 for s in spans for c in s])
    words = suffix_dedup.Words(symbol, np.array([len(s) for s in spans]))
    places: dict = {}
    for s, text in enumerate(spans):
        for i in range(len(text)):
            for j in range(i + size, len(text) + 1):
                places.setdefault(text[i:j], []).append((s, i, text[j] if j < len(text) else (s, i)))
    want = sorted((x, sorted(p[:2] for p in ps)) for x, ps in places.items() if len({p[2] for p in ps}) > 1)
    got, flat = [], [(s, i) for s, text in enumerate(spans) for i in range(len(text) + 1)]
    for leaves in words.groups(np.flatnonzero(words.rest >= size), size, most):
        tree = suffix_dedup.Subtree(words, leaves)
        for depth, a, b in tree.nodes(size):
            own = [flat[p] for p in tree.leaves[a : b + 1].tolist()]
            s, i = own[0]
            got.append((spans[s][i : i + depth], sorted(own)))
    assert sorted(got) == want
    covered = {(s, i + k) for x, ps in places.items() if len(ps) > 1 for s, i, _ in ps for k in range(len(x))}
    assert {flat[p] for p in np.flatnonzero(suffix_dedup.repeated(words, size, most)).tolist()} == covered


def test_byte_dedup(frame, docs):
    rows = {r["doc_id"]: r for r in rindex_dedup.dedup(frame).withColumn("n", removed()).collect()}
    for d, n, gone, spans, kept in brute.byte_dedup(docs):
        assert (rows[d]["n_bytes"], rows[d]["n"], len(rows[d]["spans"]), bytes(rows[d]["kept"])) == (n, gone, spans, kept), d


def test_byte_dedup_of_repeated_and_missing_ids_and_crowded_grams(spark, monkeypatch):
    text = "the quick brown fox jumps over the lazy dog and then some more words follow here"
    rows = [(5, text), (5, text), (5, text + "!"), (9, "x" + text), (None, text), (None, "q" * 70), (None, "q" * 70), (7, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((str(a), b, c, e, f) for a, b, c, e, f in brute.byte_dedup(rows))
    for crowd in (False, True):
        if crowd:  # all grams count as crowded: windows travel singly
            monkeypatch.setattr(rindex_dedup.R, "crowded", lambda *a: np.ones(1 << 14, bool))
        got = sorted((str(r["doc_id"]), r["n_bytes"], r["n"], len(r["spans"]), bytes(r["kept"])) for r in rindex_dedup.dedup(d).withColumn("n", removed()).collect())
        assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=6, max_size=40), min_size=1, max_size=25, unique=True), st.randoms(use_true_random=False))
def test_earlier_spans(spans, r):
    """Windows that a span of the same gram and a smaller document has, against plain search."""
    window = 6
    raw = [s.encode() for s in spans]
    doc = np.array([r.randint(0, 9) for _ in raw])
    gram = np.array([r.randint(0, 1) for _ in raw])
    least: dict = {}
    for s, d, g in zip(raw, doc.tolist(), gram.tolist(), strict=True):
        for i in range(len(s) - window + 1):
            least[g, s[i : i + window]] = min(least.get((g, s[i : i + window]), 99), d)
    # equal windows have equal grams in use; here the two grams are told apart by their alphabet
    raw_of = [s if g == 0 else s.translate(bytes.maketrans(b"ab", b"cd")) for s, g in zip(raw, gram.tolist(), strict=True)]
    hit, first = rindex_dedup.earlier(raw_of, doc, gram, window)
    want = [[least[g, s[i : i + window]] < d for i in range(len(s) - window + 1)] for s, d, g in zip(raw, doc.tolist(), gram.tolist(), strict=True)]
    assert [hit[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=30), min_size=1, max_size=10), st.lists(st.text("abcd", min_size=1, max_size=30), min_size=1, max_size=8), st.randoms(use_true_random=False))
def test_matching_statistics_of_other_texts(indexed, asked, r):
    """Longest matches of texts that are not in the index, in blocks that do not match each other, and a place of each."""
    data = lambda x: (np.frombuffer("".join(x).encode(), np.uint8), np.array([len(s) for s in x], np.int64))
    blocks, wanted = np.array([r.randint(0, 2) for _ in indexed]), np.array([r.randint(0, 2) for _ in asked])
    index = rindex_dedup.RunLengthIndex(*data(indexed), blocks)
    raw, size = data(asked)
    start = np.cumsum(size) - size
    lengths = [[0] * len(s) for s in asked]
    for back, own, length, place in index.matching_statistics(index.query(raw, size, wanted), start, size):
        for i, m, p in zip(own.tolist(), length.tolist(), place.tolist(), strict=True):
            at = len(asked[i]) - 1 - back
            lengths[i][at] = m
            if m:
                span = int(np.searchsorted(index.begin, p, "right")) - 1
                inside = p - int(index.begin[span])
                assert indexed[span][inside : inside + m] == asked[i][at : at + m] and blocks[span] == wanted[i]
    for text, block, got in zip(asked, wanted.tolist(), lengths, strict=True):
        own = [s for s, b in zip(indexed, blocks.tolist(), strict=True) if b == block]
        want = [max(k for k in range(len(text) - i + 1) if k == 0 or any(text[i : i + k] in s for s in own)) for i in range(len(text))]
        assert got == want


@given(st.lists(st.text(max_size=30), min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_words_of(texts):
    import pyarrow as pa

    offs, raw = K.offsets_of(pa.array(texts))
    start, end, first = K.words_of(offs, raw)
    data = raw.tobytes()
    got = [[data[start[j] : end[j]].decode() for j in range(first[i], first[i + 1])] for i in range(len(texts))]
    assert got == [brute.words(t) for t in texts]
