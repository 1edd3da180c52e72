"""Operators 1, 2, 5 and connected components: awkward rows and brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from pactum.llm import cover_sort, graph, itq, jaccard, suffix_dedup
from pactum.llm.queries import QUERIES

from ..conftest import SF_SMALL
from .helpers import awkward_texts, by_row, documents, prose


def union_find(n, links):
    label = list(range(n))

    def find(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# --- connected components --------------------------------------------------------------------------

@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    n = 60
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(45)]
    edges += [(k, k + 1) for k in range(100, 130)] + [(200, k) for k in range(201, 230)] + edges[:5]
    want = union_find(300, edges)
    got = dict(by_row(graph.components(spark.createDataFrame(edges, "a bigint, b bigint")), "id", "component_id"))
    assert all(want[i] == c for i, c in got.items())
    assert {i for e in edges if e[0] != e[1] for i in e} == set(got)


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- embeddings ------------------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, n_links string, v int"


def test_awkward_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3, 8))
    rows = [(1, x[0]), (2, x[0]), (3, x[0] * 5), (4, x[0] + 0.01 * x[1]), (4, x[0] + 0.01 * x[1]), (5, x[1]),
            (6, None), (7, []), (8, np.zeros(8)), (9, [1.0, None] * 4), (10, [float("nan")] * 8),
            (11, [float("inf")] * 8), (None, x[0]), (12, x[0][:4]), (13, -x[0]), (14, x[2] * 1e-30), (15, x[2] * 1e30)]
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], "x", 0) for i, v in rows]
    got = by_row(itq.near_duplicates(spark.createDataFrame(rows, VECTORS)), "vec_id", "n_links", "component_id", "kept")
    want = [(None, 0, None, True), (1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 3, 1, False), (4, 3, 1, False)]
    want += [(i, 0, i, True) for i in range(5, 14)] + [(14, 1, 14, True), (15, 1, 14, False)]
    assert got == want
    assert itq.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((150, 32))
    near = np.concatenate([base + s * rng.standard_normal(base.shape) for s in (0.1, 0.3, 0.48)])
    x = np.concatenate([base, near]).astype(np.float32).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = np.triu(u @ u.T >= 0.9, 1)
    rows = [(i, v.tolist(), "x", 0) for i, v in enumerate(x)]
    got = itq.near_duplicates(spark.createDataFrame(rows, VECTORS)).toPandas().set_index("vec_id").sort_index()
    links = (true | true.T).sum(1)
    assert (got.n_links.values <= links).all()  # nothing below the threshold
    assert got.n_links.sum() >= 0.95 * links.sum()


def test_one_large_bucket_is_tiled(spark, monkeypatch):
    monkeypatch.setattr(itq, "TILE_ROWS", 16)
    rng = np.random.default_rng(2)
    x = rng.standard_normal(16) + 0.01 * rng.standard_normal((100, 16))
    rows = [(i, v.tolist(), "x", 0) for i, v in enumerate(x)]
    got = itq.near_duplicates(spark.createDataFrame(rows, VECTORS)).toPandas()
    assert (got.n_links == 99).all() and (got.component_id == 0).all() and got.kept.sum() == 1


def pairs_at(rng, n, dim, cosine):
    """``2 n`` unit vectors: a random one, then one at the given cosine from it."""
    x, away = rng.standard_normal((2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away -= (away * x).sum(1, keepdims=True) * x
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    return np.stack([x, cosine * x + np.sqrt(1 - cosine ** 2) * away], axis=1).reshape(-1, dim)


def test_few_vectors_of_a_length_lose_no_link(spark):
    """Forty lengths with one to three pairs each, just inside the threshold."""
    rng = np.random.default_rng(5)
    x = [v for dim in range(40, 80) for v in pairs_at(rng, 1 + dim % 3, dim, 0.905)]
    rows = [(i, v.tolist(), "x", 0) for i, v in enumerate(x)]
    got = itq.near_duplicates(spark.createDataFrame(rows, VECTORS)).toPandas().set_index("vec_id").sort_index()
    assert (got.n_links == 1).all() and (got.component_id == got.index // 2 * 2).all()


@pytest.mark.parametrize("rows,dim", [(1100, 64), (3000, 64), (3000, 8), (1100, 200)])
def test_recall_of_pairs_that_no_rotation_has_seen(rows, dim):
    rng = np.random.default_rng(rows)
    sample = rng.standard_normal((rows, dim))
    index = itq.Index(sample / np.linalg.norm(sample, axis=1, keepdims=True), rows, 0.9)
    keys = index.keys(pairs_at(rng, 20000, dim, 0.9))
    assert index.key_bits and (keys[::2] == keys[1::2]).any(axis=1).mean() >= 0.975


def test_keys_get_shorter_when_the_tables_do_not_reach_the_recall(monkeypatch):
    monkeypatch.setattr(itq, "MAX_TABLES", 3)
    rng = np.random.default_rng(6)
    sample = rng.standard_normal((3000, 32))
    index = itq.Index(sample / np.linalg.norm(sample, axis=1, keepdims=True), 3000, 0.9)
    keys = index.keys(pairs_at(rng, 20000, 32, 0.9))
    assert index.n_tables <= 3 and (keys[::2] == keys[1::2]).any(axis=1).mean() >= 0.975


# --- n-gram Jaccard --------------------------------------------------------------------------------

def shingles(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return set(zip(w, w[1:], w[2:], w[3:], w[4:]))


def brute_jaccard(rows):
    """Expected (doc_id, n_shingles, component_id) rows."""
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and rows[a][0] is not None
             and rows[b][0] is not None and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    label = union_find(len(rows), links)
    least = {}
    for (i, _), c in zip(rows, label):
        least[c] = i if least.get(c) is None or (i is not None and i < least[c]) else least[c]
    return [(i, len(s), i if not s else least[c]) for (i, _), s, c in zip(rows, sets, label)]


def nulls_first(rows):
    return sorted(rows, key=lambda r: [(x is not None, x) for x in r])


def test_jaccard_awkward_rows(spark):
    rows = awkward_texts()
    got = by_row(jaccard.jaccard_components(documents(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert got == nulls_first(brute_jaccard(rows))
    assert jaccard.jaccard_components(documents(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_jaccard_near_the_threshold(spark, seed, monkeypatch):
    """Many variants around 0.75, chains among them, and a passage that half of the texts share."""
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    rng = random.Random(seed)
    passage = prose(rng, 40).split()
    rows = []
    for k in range(120):
        if k % 10 == 0:
            words = [rng.choice("abcdefgh") * rng.randint(1, 3) + str(rng.randint(0, 99)) for _ in range(rng.randint(6, 90))]
        words = list(words)
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = f"w{rng.randint(0, 999)}"
        rows.append((k, " ".join(words + (passage if rng.random() < 0.5 else []))))
    got = by_row(jaccard.jaccard_components(documents(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert got == brute_jaccard(rows)


def test_second_pass_finds_links_that_the_first_centre_misses(spark):
    """Pairs of one key whose common centre is similar to neither."""
    rng = random.Random(4)
    core = [f"c{i}" for i in range(30)]
    rows = []
    for k in range(12):
        own = [f"x{k // 2}_{i}" for i in range(60)]
        rows.append((k, " ".join(core + own + [f"end{k}"])))
    rng.shuffle(rows)
    got = by_row(jaccard.jaccard_components(documents(spark, rows)), "doc_id", "component_id")
    assert got == [(k, k - k % 2) for k in range(12)]


def test_keep_one(spark):
    rows = awkward_texts()
    got = jaccard.keep_one(documents(spark, rows))
    assert got.columns == documents(spark, []).columns
    ids = sorted(r.doc_id for r in got.collect() if r.doc_id is not None)
    want = sorted({i for i, n, c in brute_jaccard(rows) if i is not None and i == c})
    assert ids == want
    assert sum(r.doc_id is None for r in got.collect()) == sum(i is None for i, _ in rows)


def test_keep_one_judges_each_text_of_a_repeated_id(spark):
    rng = random.Random(8)
    a, b, c, d = (prose(rng, 120) for _ in range(4))
    near = [t + " one more word" for t in (a, c)]
    rows = [(3, near[0]), (5, a), (5, b), (5, b), (6, c), (6, c), (6, near[1]), (6, d), (7, ""), (7, None), (7, " "),
            (8, near[0]), (8, d), (None, a), (None, a)]
    got = [(r.doc_id, r.text or "") for r in jaccard.keep_one(documents(spark, rows)).collect()]
    of_c = [t for i, t in got if i == 6 and t != d]
    assert len(of_c) == 1 and of_c[0] in (c, near[1])
    want = [(3, near[0]), (5, b), (6, of_c[0]), (6, d), (7, ""), (7, " "), (None, a), (None, a)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_rows_of_one_id_are_one_document_of_the_graph(spark):
    rng = random.Random(9)
    a, b, c = (prose(rng, 120) for _ in range(3))
    rows = [(5, a), (5, b), (9, a + " one more"), (8, b + " one more"), (3, b + " and two more"), (4, c)]
    got = jaccard.jaccard_components(documents(spark, rows)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 3), (9, 3), (8, 3), (3, 3), (4, 4)}


def test_bitmap_bound_never_drops_a_link(spark):
    rng = np.random.default_rng(3)
    pairs = []
    for _ in range(200):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        keep = a[rng.random(len(a)) < 0.9]
        b = np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 10)), dtype=np.uint64)]))
        if len(b) == 0:
            continue
        a, b = sorted((a, b), key=len)
        both = len(np.intersect1d(a, b))
        band = [int(np.searchsorted(jaccard.BANDS, len(x), side="right")) - 1 for x in (a, b)]
        if 100 * both >= 75 * (len(a) + len(b) - both):
            assert band[1] - band[0] in (0, 1)
            pairs.append((n, jaccard.bitmap(a, band[0]).tolist(), band[0], jaccard.bitmap(b, band[1]).tolist(), band[1],
                          len(a), len(b)))
    frame = spark.createDataFrame(
        [((x, nx, ax), (y, ny, ay)) for _, x, ax, y, ay, nx, ny in pairs],
        "p struct<bits: array<bigint>, n: bigint, band: int>, q struct<bits: array<bigint>, n: bigint, band: int>")
    assert len(pairs) > 50 and frame.where(jaccard.likely("p", "q") & jaccard.likely("q", "p")).count() == len(pairs)


# --- suffix-array dedup ----------------------------------------------------------------------------

def brute_suffix(rows, length=100):
    """Expected (doc_id, n_bytes, n_removed, n_spans, kept_sha256); rows of one id and text count once."""
    out, seen = {}, set()
    for i, t in sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, r[0] or 0)):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if b[k: k + length] in seen:
                gone[k: k + length] = True
            seen.add(b[k: k + length])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[(i, t)] = (i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return nulls_first([out[(i, t or "")] for i, t in rows])


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("hot", [10_000, 1])
def test_suffix_awkward_rows(spark, monkeypatch, hot):
    """Also with every anchor of several contexts treated as a hot one."""
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", hot)
    rows = [r for r in awkward_texts() if r[1] is None or len(r[1]) < 5000]
    got = suffix_dedup.suffix_dedup(documents(spark, rows))
    assert by_row(got, *COLUMNS) == brute_suffix(rows)
    for r in got.where("doc_id = 13").collect():
        text = dict((i, t) for i, t in rows)[13].encode()
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert hashlib.sha256(suffix_dedup.kept_bytes(
            text, np.array([s.start for s in r.spans]), np.array([s.end for s in r.spans]))).hexdigest() == r.kept_sha256
    assert suffix_dedup.suffix_dedup(documents(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_suffix_shared_passages(spark, seed):
    rng = random.Random(seed)
    letters = "ab" if seed == 0 else "abcdefg "
    passages = ["".join(rng.choice(letters) for _ in range(rng.randint(80, 400))) for _ in range(5)]
    rows = []
    for k in range(40):
        parts = [rng.choice(passages)[rng.randint(0, 60):] if rng.random() < 0.6
                 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 150))) for _ in range(3)]
        rows.append((k * 3 % 41, "é".join(parts)))
    assert by_row(suffix_dedup.suffix_dedup(documents(spark, rows)), *COLUMNS) == brute_suffix(rows)


def test_op5_query(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert by_row(QUERIES["op5_suffix_dedup"](spark, SF_SMALL), *COLUMNS) == brute_suffix([(r.doc_id, r.text) for r in docs])


@pytest.mark.parametrize("seed", range(10))
def test_cover_sort_against_a_set(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(cover_sort, "BUCKET", int(rng.choice([64, 1000, 1 << 18])))
    base = rng.integers(97, 97 + rng.integers(1, 5), rng.integers(150, 700)).astype(np.uint8)
    parts = [base]
    for _ in range(6):
        x = base.copy()
        x[rng.integers(0, len(x), rng.integers(0, 4))] = 101
        parts += [x[rng.integers(0, len(x)):], rng.integers(97, 110, rng.integers(0, 60)).astype(np.uint8)]
    text = np.concatenate(parts)
    starts = np.arange(len(text) - 99)
    starts = starts[rng.random(len(starts)) < 0.8]
    seen, want = set(), []
    for s in starts:
        want.append(text[s: s + 100].tobytes() in seen)
        seen.add(text[s: s + 100].tobytes())
    assert cover_sort.repeats(text, starts, 100).tolist() == want


def test_codes_of_vectors_with_a_common_mean_are_balanced():
    import numpy as np

    from pactum.llm.itq import Index, unit_rows
    rng = np.random.default_rng(1)
    x = unit_rows(rng.standard_normal((4000, 32)) + 2 * rng.standard_normal(32))
    own = Index(x[:3000], len(x), 0.9)
    keys = own.keys(x)
    met = sum((np.unique(k, return_counts=True)[1].astype(float) ** 2).sum() for k in keys.T)
    assert own.key_bits and met < len(x) ** 2
    bits = np.concatenate([(x - own.mean) @ r >= 0 for r in own.rotations], axis=1)
    assert 0.35 < bits.mean(axis=0).min() and bits.mean(axis=0).max() < 0.65


def test_jaccard_frees_its_intermediates(spark, tmp_path):
    import os

    from pactum.llm import jaccard
    from pactum.session import scratch_root
    root = scratch_root(spark).removeprefix("file:")
    before = set(os.listdir(root))
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 7}x{k}" for k in range(30))) for i in range(60)], "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()}
    assert got == {i: i % 7 for i in range(60)}
    left = {d.rsplit("-", 1)[0] for d in set(os.listdir(root)) - before}
    assert not left & {"jaccard-signatures", "jaccard-keys", "jaccard-sets", "jaccard-pairs", "jaccard-mixed", "jaccard-lists", "jaccard-tiles"}


@pytest.mark.parametrize("tail, linked", [(30, False), (24, True)])
def test_template_pages_leave_a_chunk_as_rows_not_as_pairs(spark, monkeypatch, tail, linked):
    """200 pages of one template, all just below or just above the threshold, in several chunks."""
    monkeypatch.setattr(jaccard, "TILE_ROWS", 64)
    monkeypatch.setattr(jaccard, "STAR_TURNS", 0)
    written = {}

    def tile_pairs(lists, classes):
        got = plain(lists, classes)
        written["pairs"], written["rows"] = got.where("b IS NOT NULL").count(), got.where("chunk IS NOT NULL").count()
        return got

    plain = jaccard.tile_pairs
    monkeypatch.setattr(jaccard, "tile_pairs", tile_pairs)
    template = [f"t{i}" for i in range(176)]
    rows = [(k, " ".join(template + [f"own{k}x{i}" for i in range(tail)])) for k in range(200)]
    got = by_row(jaccard.jaccard_components(documents(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert got == [(k, 176 + tail - 4, 0 if linked else k) for k in range(200)] == brute_jaccard(rows)
    if not linked:
        assert written["rows"] > 0 and written["pairs"] < 1000


@pytest.mark.parametrize("seed", range(4))
def test_forest_connects_exactly_the_linked_sets(seed, monkeypatch):
    monkeypatch.setattr(jaccard, "DENSE_COLUMNS", 16)
    rng = np.random.default_rng(seed)
    core = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = []
    for _ in range(40):
        mine = core[rng.random(60) < rng.choice([0.8, 0.95])]
        sets.append(np.unique(np.concatenate([mine, rng.integers(0, 1 << 63, int(rng.integers(0, 12)), dtype=np.uint64)])))
    left, right = (np.arange(20), np.arange(20, 40)) if seed % 2 else (np.arange(40), np.arange(40))

    def linked(a, b):
        both = len(np.intersect1d(sets[a], sets[b]))
        return 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both)

    edges = jaccard.forest(sets, left, right)
    assert all(linked(a, b) for a, b in edges) and len(edges) < 40
    want = union_find(40, [(a, b) for a in left.tolist() for b in right.tolist() if linked(a, b)])
    assert union_find(40, edges) == want
