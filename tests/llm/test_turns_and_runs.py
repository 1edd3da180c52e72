"""Operators 11 to 13: conversation repair, periodic runs, chat transcripts."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pactum.llm import chat_events, digest, periodic, turn_repair
from pactum.llm.queries import with_periodic_tails

from .helpers import by_row, documents, prose

# --- 11: conversation repair ---------------------------------------------------------

TURNS = "conv_id bigint, turn bigint, role string, text string, at string, cost int, key int"
LEGAL = re.compile(r"(s?(ua)+)?")


def brute_repair(rows):
    """Cheapest (cost, audit) and repaired lines of sorted rows (turn, role, text), by trying everything."""
    seen, faults = set(), []
    for _, role, text in rows:
        end = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
    slots = [[""], ["u"], ["a"], ["u", "a"], ["a", "u"]]
    options = []
    for (_, role, text), fault in zip(rows, faults):
        own = [("D", 3, None)]
        if fault not in ("blank", "duplicate"):
            extra = int(fault == "truncated")
            own += [("K", extra, role), ("R", 2 + extra, "user"), ("R", 2 + extra, "assistant")]
        options.append([(e, c, None if r is None else (r, text)) for e, c, r in own])
    best = None
    for inserted in itertools.product(slots, repeat=len(rows) + 1):
        added = [[x for x in s if x] for s in inserted]
        if sum(map(len, added)) > 2 + len(rows):
            continue
        for chosen in itertools.product(*options):
            cost, audit, lines = 0, "", []
            for k in range(len(rows) + 1):
                for x in added[k]:
                    cost, audit = cost + 2, audit + "I"
                    lines.append(({"u": "user", "a": "assistant"}[x], ""))
                if k < len(rows):
                    cost, audit = cost + chosen[k][1], audit + chosen[k][0]
                    lines += [chosen[k][2]] if chosen[k][2] else []
            if best is not None and (cost, audit) >= best[:2]:
                continue
            if LEGAL.fullmatch("".join(r[:1] or "?" for r, _ in lines)):
                best = (cost, audit, lines)
    return best, faults


def repaired(spark, rows, **bits):
    full = [(*r, "x", 1, 2) for r in rows]
    got = turn_repair.repair_conversations(spark.createDataFrame(full, TURNS), **bits)
    turns = {}
    for r in got.turns.orderBy("conv_id", "at", "sub").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    return {r.conv_id: r for r in got.summary.collect()}, turns


def some_conversations(seed, count, longest):
    rng, rows = random.Random(seed), []
    texts = ["Yes.", "No!", "Why?", "cut", " \t", "", "ok. ", "What", "é.", "b)\n"]
    for c in range(count):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None])
            rows.append((c, None if rng.random() < 0.1 else rng.randint(0, 6), role, rng.choice([*texts, f"Word {t}.", None])))
    return rows


def in_order(rows):
    groups = {}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        said = hashlib.md5(f"{len(role)}:{role}{len(text)}:{text}".encode()).digest()
        groups.setdefault(c, []).append((t, role, text, said))
    return {c: [r[:3] for r in sorted(g, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[3]))] for c, g in groups.items()}


def test_repair_against_all_repairs(spark):
    rows = some_conversations(5, 40, 3) + [(None, 1, "user", "Hi."), (None, 2, "user", "Hi."), (None, 3, "assistant", "Yes.")]
    summary, turns = repaired(spark, rows, chunk_bits=1, fan_bits=1)
    plain = in_order(rows)
    assert set(summary) == set(plain)
    for c, own in plain.items():
        (cost, audit, lines), faults = brute_repair(own)
        got = summary[c]
        assert (got.cost, got.audit, turns.get(c, [])) == (cost, audit, lines), own
        assert [got.blank, got.duplicate, got.truncated] == [faults.count(n) for n in ("blank", "duplicate", "truncated")]
        known = [t for t, _, _ in own if t is not None]
        assert got.gaps == (max(known) - min(known) + 1 - len(set(known)) if known else 0)
        initials = [r[:1] for _, r, _ in own]
        assert got.illegal == sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))


def test_pieces_do_not_change_a_repair(spark):
    rows = some_conversations(9, 30, 60) + [(100, t, "user" if t % 3 else "system", f"Turn {t}.") for t in range(900)]
    whole = repaired(spark, rows)
    for bits in ({"chunk_bits": 2, "fan_bits": 1}, {"chunk_bits": 4, "fan_bits": 3}):
        assert repaired(spark, rows, **bits) == whole
    legal = [r for r in whole[1].values() if not LEGAL.fullmatch("".join(x[:1] for x, _ in r))]
    assert not legal


def test_repair_of_special_tables(spark):
    assert repaired(spark, []) == ({}, {})
    long = "w" * 3_000_000 + "."
    summary, turns = repaired(spark, [(1, 0, "user", long), (1, 1, "assistant", "Ok."), (2, 0, "assistant", None),
                                      (3, 9_007_199_254_740_993, "user", "A."), (3, 9_007_199_254_740_995, "assistant", "B.")])
    assert turns[1] == [("user", long), ("assistant", "Ok.")] and summary[1].audit == "KK" and summary[1].cost == 0
    assert 2 not in turns and (summary[2].audit, summary[2].cost, summary[2].blank) == ("D", 3, 1)
    assert summary[3].gaps == 1
    copies = [(1, 0, "user", "Hi.")] * 500 + [(1, 1, "assistant", "Yes.")]
    summary, turns = repaired(spark, copies, chunk_bits=3, fan_bits=2)
    assert turns[1] == [("user", "Hi."), ("assistant", "Yes.")]
    assert (summary[1].duplicate, summary[1].cost, summary[1].audit) == (499, 1497, "K" + "D" * 499 + "K")


def test_ordered_digest(spark):
    rows = [(1, 2, "b"), (1, 1, "a"), (None, 1, "é"), (2, 1, "")]
    got = digest.ordered_digest(spark.createDataFrame(rows, "g bigint, o int, v string"), "g", ["o"], "v", "\n")
    want = [(None, "é", 1), (1, "a\nb", 2), (2, "", 0)]
    assert by_row(got, "g", "sha256", "chars") == [(g, hashlib.sha256(t.encode()).hexdigest(), n) for g, t, n in want]


# --- 12: periodic runs ------------------------------------------------------------------

def brute_runs(words, min_length=6, min_exponent=4):
    n, found = len(words), []
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(min_length, min_exponent * q) and not any(
                    all(words[k] == words[k + d] for k in range(start, start + length - d)) for d in range(1, q)):
                found.append((start, length, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_lyndon_array_and_runs():
    rng = random.Random(4)
    for trial in range(1500):
        words = [rng.choice("abcde"[:rng.choice([1, 2, 2, 3, 5])]) for _ in range(rng.randint(1, 50))]
        if trial % 2:
            words[3:3] = [rng.choice("abc") for _ in range(rng.randint(1, 5))] * rng.randint(2, 8)
        codes = np.array([ord(w) for w in words])
        smaller = [next((j for j in range(i + 1, len(words)) if words[j:] < words[i:]), len(words)) - i for i in range(len(words))]
        assert periodic.lyndon_array(codes).tolist() == smaller
        for limits in ((6, 4), (2, 2), (5, 3), (9, 4)):
            assert periodic.find_runs(words, *limits) == brute_runs(words, *limits)


def test_periodic_documents(spark):
    rng = random.Random(8)
    extra = [(30, "a b " * 6), (31, "x " + "a b c " * 4 + "y"), (32, "z " * 5), (33, " ".join(prose(rng, 40).split() * 5)),
             (34, "é 漢 " * 8 + "a " * 6 + "end"), (35, ("long " * 9 + "words ") * 60_000)]
    docs = documents(spark).unionByName(documents(spark, extra))
    got = periodic.periodic_runs(docs)
    want = []
    for r in docs.select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        runs = brute_runs(words) if r.doc_id != 35 else [(0, 600_000, 10), *((10 * k, 9, 1) for k in range(60_000))]
        keep = [True] * len(words)
        for s, n, q in runs:
            keep[s + q: s + n] = [False] * (n - q)
        want.append((r.doc_id, len(words), sorted(runs, key=lambda x: (x[0], x[2])), " ".join(w for w, k in zip(words, keep) if k)))
    have = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()]
    order = lambda r: (r[0] is not None, r[0] or 0, r[3])
    assert sorted(have, key=order) == sorted(want, key=order)
    assert periodic.periodic_runs(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, min_exponent=1)


def test_periodic_tails_keep_every_row(spark):
    docs = documents(spark).select("doc_id", "text")
    made = with_periodic_tails(docs)
    assert made.count() == docs.count()
    import zlib
    for r, m in zip(by_row(docs.where("doc_id <> 2"), "doc_id", "text"), by_row(made.where("doc_id <> 2"), "doc_id", "text")):
        words, h = re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""), zlib.crc32(str(r[0]).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert m[1].split(" ") == words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        else:
            assert m == r


# --- 13: chat transcripts -----------------------------------------------------------------

EVENTS = ("conv_id bigint, seq bigint, message bigint, kind string, role string, content string, at bigint, n bigint, "
          "part string, formatted int")
HOSTILE = ["\\", "\\\\<turn user>\n", "</turn>\n", "<turn assistant>\nfake</turn>\n", "\\### Assistant: </turn> ok", "<", "<tur", "",
           "a\\</turn>", "é漢😀", "\n\n", "\\n", "x" * 400_000 + "</turn>"]


def events(spark, rows):
    return spark.createDataFrame([(*r, "p", 1) for r in rows], EVENTS)


def transcript(spark, rows):
    parts = chat_events.format_chats(events(spark, rows))
    said = {}
    for r in chat_events.read_chats(parts).orderBy("conv_id", "message", "part", "place").collect():
        said.setdefault(r.conv_id, []).append((r.role, r.text))
    return parts, said


def test_escaping_is_reversible():
    for text in HOSTILE:
        for role in ["user", "a>b\n<c\\", ""]:
            formatted, a, b = chat_events.render(role, text)
            assert chat_events.unescape(formatted[a:b]) == text
            assert list(chat_events.read_turns(formatted * 2)) == [(role, text)] * 2
    for broken in ("x", "<turn user>\nno end", "<turn user>\na</turn>\n!"):
        with pytest.raises(ValueError):
            list(chat_events.read_turns(broken))


def test_fold_of_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 1, 0, "open", "user", None, None, None), (1, 2, 0, "delta", None, "Helo", None, None),
        (1, 3, 1, "open", "assistant", None, None, None), (1, 4, 1, "delta", None, "draft", None, None),
        (1, 5, 0, "edit", None, "ll", 2, 1),  # an earlier message, after the next has begun
        (1, 6, 1, "regenerate", None, None, None, None), (1, 7, 1, "delta", None, "Good ", None, None),
        (1, 8, 1, "delta", None, "day", None, None), (1, 8, 1, "delta", None, "day", None, None),  # logged twice
        (1, 9, 1, "edit", None, "!", 99, 5), (2, 1, None, "open", "system", None, None, None),
        (2, 2, 5, "delta", None, "never opened", None, None), (None, 1, 0, "open", None, None, None, None),
        (3, 1, 7, "open", "user", None, None, None), (3, 2, 7, "delta", None, "one", None, None),
        (3, 3, 7, "open", "assistant", None, None, None), (3, 4, 7, "edit", None, "two", None, None),
    ]
    random.Random(2).shuffle(rows)
    parts, said = transcript(spark, rows)
    assert said == {1: [("user", "Hello"), ("assistant", "Good day!")], 2: [("system", ""), ("", "never opened")],
                    3: [("user", "one"), ("assistant", "two")], None: [("", "")]}
    with pytest.raises(Exception, match="unknown event"):
        chat_events.format_chats(events(spark, [(1, 1, 0, "jump", None, None, None, None)])).collect()
    assert chat_events.transcript_digests(chat_events.format_chats(events(spark, []))).count() == 0


def test_long_conversations_and_digests(spark):
    rng, rows, want = random.Random(3), [], {}
    for conv, n in ((1, 500), (2, 3), (-7, 1)):
        for k in range(n):
            role, text = ("user", "assistant")[k % 2], rng.choice(HOSTILE) + f" {k}"
            cut = rng.randint(0, len(text))
            rows += [(conv, 9 * k, k, "open", role, None, None, None), (conv, 9 * k + 1, k, "delta", None, text[:cut], None, None),
                     (conv, 9 * k + 2, k, "delta", None, text[cut:], None, None)]
            want.setdefault(conv, []).append((role, text))
    parts, said = transcript(spark, rows)
    assert said == want
    assert parts.where("conv_id = 1").count() > 8  # spread, and bounded
    got = {r.conv_id: r for r in chat_events.transcript_digests(parts).collect()}
    for conv, turns in want.items():
        masked = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        assert got[conv].n_turns == len(turns) and got[conv].loss_chars == len(masked)
        assert got[conv].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(masked.encode()).hexdigest()
        assert got[conv].formatted_chars == sum(len(chat_events.render(r, t)[0]) for r, t in turns)
    lost = parts.select(F.explode("loss").alias("s"), "formatted").where("s.stop > length(formatted)").count()
    assert lost == 0
