"""Operators 3, 4, 6, 7, 8: awkward rows, brute force and round trips."""

import random
import zlib

import numpy as np
import pytest

from pactum.llm import line_rules, packing, pieces, records, subwords, trie_counts, viterbi
from pactum.llm.queries import QUERIES

from ..conftest import SF_SMALL
from .helpers import awkward_texts, by_row, documents, prose


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(subwords.default_path())
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# --- quality rules ---------------------------------------------------------------------------------

def brute_quality(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:]))
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def test_quality_counts_match_brute_force(spark):
    rows = [r for r in awkward_texts() if r[1] is None or len(r[1]) < 5000]
    got = by_row(line_rules.quality_rules(documents(spark, rows)), "doc_id", "n_words", "word_chars", "n_symbols",
                 "n_dup_lines", "n_repeat_words", "base_failed")
    want = sorted(((i, *brute_quality(t)) for i, t in rows), key=lambda r: [(x is not None, x) for x in r])
    assert got == want


def test_line_rules_remove_lines_and_reject(spark):
    rng = random.Random(1)
    good = prose(rng, 120)
    nav = "home | about | news | sport | contact"
    rows = [(1, good), (2, good + "\n" + nav + "\nAll rights reserved."), (3, "\n".join([nav + f" | {i}" for i in range(40)])),
            (4, good + "\n" + "\n".join(f"$$$ %%% item{i} *** ###." for i in range(60)))]
    got = {r.doc_id: r for r in line_rules.quality_rules(documents(spark, rows), carry=True).collect()}
    assert [got[i].kept for i in (1, 2, 3, 4)] == [True, True, False, False]
    assert got[2].clean_text == good and got[2].n_lines_removed == 2 and got[1].clean_text == good
    assert got[1].row.kept == "no" and got[1].row.length == 1.5  # clashing names are carried inside row


# --- token ids -------------------------------------------------------------------------------------

def test_word_encoder_equals_library_on_whole_texts():
    texts = [t for _, t in awkward_texts()]
    encoder = subwords.Encoder()
    assert [encoder.array(t or "").tolist() + [1] for t in texts] == reference_ids(texts)


def test_word_encoder_equals_library_on_odd_characters():
    rng = random.Random(5)
    alphabet = "aAbZéÉßİſΣσς '’.,!?<|>#$%&*()[]{}~^_`-\t\n\r\x0b\x0c\x1c\x1f\x85\xa0  　́ë漢字1٣😀µªº"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 20))) for _ in range(3000)]
    encoder = subwords.Encoder()
    assert [encoder.array(t).tolist() + [1] for t in texts] == reference_ids(texts)


def test_records_round_trip(spark, tmp_path):
    rows = awkward_texts()
    manifest = records.write_records(documents(spark, rows), path=str(tmp_path / "out"), shards=3)
    got = sorted(records.read_records(manifest).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len(got) == len(rows)
    want = sorted((str(i), tuple(e)) for (i, _), e in zip(rows, reference_ids([t for _, t in rows])))
    assert sorted((str(r.doc_id), tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
    # shuffled reads through the offset index
    shard = manifest.orderBy("n_records", ascending=False).first()
    starts = records.offsets(shard.file)
    assert len(starts) == shard.n_records + 1 and starts[-1] == shard.n_bytes
    own = [r for r in got if r.shard == shard.shard]
    for i in random.Random(2).sample(range(len(own)), min(4, len(own))):
        doc_id, back = records.read_one(shard.file, starts, i)
        assert (doc_id, back.tolist()) == (own[i].doc_id, np.frombuffer(own[i].ids, "<u4").tolist())


def test_damaged_record_is_found():
    record = bytearray(records.frame(records.serialize(5, np.array([1, 2, 3], "<u2"))))
    assert records.parse(records.unframe(bytes(record)))[1].tolist() == [1, 2, 3]
    for at in (0, 9, 14, len(record) - 1):
        broken = bytearray(record)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            records.unframe(bytes(broken))
    with pytest.raises(ValueError):
        records.unframe(bytes(record[:-3]))


def test_empty_tables(spark):
    empty = documents(spark, []).repartition(2)
    assert records.read_records(records.write_records(empty)).count() == 0
    assert packing.pack(empty).count() == 0
    assert line_rules.quality_rules(empty, carry=True).count() == 0
    assert trie_counts.token_counts(empty).count() == 0
    assert viterbi.decode(viterbi.encode(empty)).count() == 0


def test_op4_query_against_library(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    ids = reference_ids([r.text for r in docs])
    want, start = [], 0
    for r, e in zip(docs, ids):
        want.append((r.doc_id, start, len(e), crc(e)))
        start += len(e)
    assert by_row(QUERIES["op4_records"](spark, SF_SMALL), "doc_id", "start", "n_tokens", "ids_crc32") == want


# --- packing ---------------------------------------------------------------------------------------

def check_packing(rows, ids, capacity):
    assert all(1 <= r.length <= capacity for r in rows)
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) <= capacity
    assert sum(r.length for r in rows) == sum(map(len, ids))
    return len(by_seq)


def test_pack_awkward_rows(spark):
    rows = awkward_texts()
    ids = reference_ids([t for _, t in rows])
    got = packing.pack(documents(spark, rows), capacity=64).collect()
    n = check_packing(got, ids, 64)
    assert n <= 1.03 * -(-sum(map(len, ids)) // 64) + 1
    want = sorted((str(i), k, k * 64, tuple(e[k * 64: k * 64 + 64])) for (i, _), e in zip(rows, ids)
                  for k in range(-(-len(e) // 64)))
    assert sorted((str(r.doc_id), r.piece, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    assert all(r.ids_crc32 == zlib.crc32(r.ids) for r in got)


def test_op8_query(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    ids = dict(zip((r.doc_id for r in docs), reference_ids([r.text for r in docs])))
    got = QUERIES["op8_packing"](spark, SF_SMALL).collect()
    n = check_packing(got, list(ids.values()), 4096)
    assert n == -(-sum(map(len, ids.values())) // 4096)  # no sequence more than there must be
    assert all(crc(ids[r.doc_id][r.start: r.start + r.length]) == r.ids_crc32 and r.start == 4096 * r.piece for r in got)


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = 50
    sizes = rng.integers(1, [51, 10, 51, 20, 51, 51][seed], [0, 300, 40, 200, 1000, 5][seed])
    counts = np.bincount(sizes, minlength=capacity + 1)
    patterns = packing.plan(counts)
    used = np.zeros(capacity + 1, int)
    for pattern, times in patterns:
        assert times > 0 and sum(n * k for n, k in pattern.items()) <= capacity
        for n, k in pattern.items():
            used[n] += k * times
    assert (used == counts).all()


def optimum(sizes, capacity):
    """Fewest bins by branch and bound over first-fit placements (tiny inputs)."""
    best = len(sizes)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for free in sorted(set(bins)):
            if free >= sizes[k]:
                i = bins.index(free)
                place(k + 1, bins[:i] + [free - sizes[k]] + bins[i + 1:])
        place(k + 1, [*bins, capacity - sizes[k]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_near_the_optimum(seed):
    rng = np.random.default_rng(100 + seed)
    sizes = sorted(rng.integers(3, 30, 9).tolist(), reverse=True)
    n = sum(t for _, t in packing.plan(np.bincount(sizes, minlength=31)))
    assert n <= optimum(sizes, 30) + 1


# --- pieces ----------------------------------------------------------------------------------------

def unigram_library():
    """The same pieces read by the library as a unigram model."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(pieces.default_path(), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def test_viterbi_equals_library_lattice(spark):
    lib = unigram_library()
    encoder = viterbi.Encoder()
    words = sorted({w for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").limit(60).collect()
                    for w in r.text.split()})[:2500]
    words += ["漢字 test", "a\nb", "  x  ", " ", "😀é", "é", "▁x"]
    got = [np.frombuffer(b, "<i4").tolist() for b in encoder(words)]
    assert got == [lib.nbest_encode(w, nbest_size=2)[0] for w in words]


def brute_viterbi(text, v):
    """Best segmentation by plain dynamic programming over dictionaries."""
    score = {"".join(map(chr, c[c > 0])): (s, int(i)) for c, s, i in zip(v.codes, v.score, v.id)}
    marked = pieces.SPACE + text.replace(" ", pieces.SPACE) if text else ""
    best = [(0.0, [])] + [None] * len(marked)
    for j in range(1, len(marked) + 1):
        for i in range(max(0, j - v.max_len), j):
            if marked[i:j] in score:
                s, k = score[marked[i:j]]
                got = (best[i][0] + s, best[i][1] + [k])
            elif i == j - 1:
                got = (best[i][0] + v.unknown_score, best[i][1] + v.unknown_ids(ord(marked[i])))
            else:
                continue
            if best[j] is None or got[0] > best[j][0]:
                best[j] = got
    return best[-1][1]


def test_encode_decode_and_counts_on_awkward_rows(spark):
    rows = awkward_texts()
    docs = documents(spark, rows)
    v = pieces.Pieces()
    encoded = viterbi.encode(docs)
    for r in encoded.where("length(text) < 400 OR text IS NULL").collect():
        assert r.ids == brute_viterbi(r.text or "", v)
    back = viterbi.decode(encoded).collect()
    assert all(r.decoded == (r.text or "") for r in back) and len(back) == len(rows)
    counts = by_row(trie_counts.token_counts(docs), "doc_id", "n_tokens")
    assert counts == by_row(viterbi.decode(encoded), "doc_id", "n_tokens")
    assert viterbi.decode(spark.createDataFrame([(1, "x", [None, -1, 10 ** 6])], "doc_id bigint, text string, ids array<int>")
                          ).first().n_tokens == 0


def test_trie_equals_viterbi_on_random_words():
    rng = random.Random(9)
    v = pieces.Pieces()
    words = sorted({pieces.SPACE * rng.randint(0, 2) + "".join(rng.choice("theinoré漢x.") for _ in range(rng.randint(1, 40)))
                    for _ in range(800)})
    ids = viterbi.encode_words(words, v)
    assert trie_counts.trie_counts(words, v).tolist() == [len(ids[w]) // 4 for w in words]


def test_op3_and_op7_queries_agree(spark):
    counts = by_row(QUERIES["op3_trie_counts"](spark, SF_SMALL), "doc_id", "n_tokens")
    encoded = QUERIES["op7_viterbi"](spark, SF_SMALL)
    assert counts == by_row(encoded, "doc_id", "n_tokens")
    assert encoded.where("NOT round_trip").count() == 0
