"""Line dedup, collocations and conversation repair against brute force, with the odd rows each must stand."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from sitegrain.llm.collocations import CollocationOptions, collocations
from sitegrain.llm.cuckoo import Cuckoo
from sitegrain.llm.lines import LineIndex, LineOptions, deduplicated_lines, line_keys
from sitegrain.llm.turns import Node, Program, damaged, path, precedes, repaired_turns, repairs
from sitegrain.session import work_folder

DOCS = "doc_id bigint, text string, lang string, n_dropped string, `a.b` int, Kept string"
ODD = [(900, None), (901, ""), (902, "\n\n"), (903, " \t\n"), (904, "no end"), (905, "A line of its own\n"), (906, "ééééééééé"), (907, "éééééééééé"), (None, "A line of its own")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, rest[0] if rest else None, "x", 7, "k") for i, t, *rest in rows], DOCS)


# -- cuckoo filters


def test_cuckoo_filter_counts_copies_and_forgets():
    rng = np.random.default_rng(3)
    keys = rng.integers(-(2**62), 2**62, 200_000)
    one = Cuckoo()
    one.add(keys)
    one.add(keys[:1000])
    one = Cuckoo(one.to_bytes())
    assert (one.copies(keys) >= 1).all() and (one.copies(keys[:1000]) >= 2).all()
    assert (one.copies(rng.integers(-(2**62), 2**62, 100_000)) > 0).mean() < 0.001
    one.discard(keys[100_000:])
    assert (one.copies(keys[:100_000]) >= 1).all() and (one.copies(keys[100_000:]) > 0).mean() < 0.001
    one.discard(keys[:100_000])
    one.discard(keys[:1000])
    assert not one.slots.any() and not len(one.stash)


def test_overfull_filter_keeps_the_rest_in_its_stash():
    one = Cuckoo()
    same = np.repeat(np.array([5], np.int64), 20)
    one.add(same)
    assert len(one.stash) == 12 and one.copies(same[:1]) == 20
    one.discard(same)
    assert one.copies(same[:1]) == 0 and not one.slots.any()


# -- lines


def brute_lines(rows, shortest=10):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= shortest:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def line_rows(seed, n=120):
    rng = random.Random(seed)
    pool = [f"Shared line number {k} of the pool" for k in range(25)]
    out = []
    for i in range(n):
        lines = [rng.choice(pool) if rng.random() < 0.5 else f"own {rng.random()}" for _ in range(rng.randint(1, 8))]
        lines = [rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", "\r", "  "]) for x in lines]
        out.append((i, "\n".join([*lines, *(["This line is everywhere."] if i % 3 == 0 else [])])))
    return out


def cleaned(index, df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in index.cleaned(df).collect()), key=str)


def test_lines_equal_brute_force_in_any_number_of_batches(spark):
    rows = line_rows(1) + ODD
    rows.append(rows[5])
    df = table(spark, rows)
    index, out = deduplicated_lines(df, work_folder(spark, "t"), 3, LineOptions(capacity=100))
    assert cleaned(index, df) == brute_lines(rows)
    assert out.columns == ["doc_id", "text", "lang", "a.b", "n_lines", "n_dropped", "kept"]
    assert index.batches[-1]["shards"] > 5  # the filters were dealt to more shards


def test_removed_documents_leave_no_trace(spark):
    rows = line_rows(2)
    path_ = work_folder(spark, "t")
    index = LineIndex(spark, path_)
    index.insert(table(spark, rows[:60]))
    first = cleaned(index, table(spark, rows[:60]))
    index.insert(table(spark, rows[60:]))
    gone = [i for i, _ in rows if i % 3 == 0] + [555_555]
    index.remove(spark.createDataFrame([(i,) for i in gone] * 2 + [(None,)], "doc_id bigint"))
    left = [r for r in rows if r[0] not in gone]
    assert cleaned(LineIndex.open(spark, path_), table(spark, left)) == brute_lines(left)
    index.remove(spark.createDataFrame([(i,) for i, _ in rows[60:]], "doc_id bigint"))
    index.insert(table(spark, [r for r in rows[:60] if r[0] in gone]))
    assert cleaned(index, table(spark, rows[:60])) == first
    # The filters know exactly the keys that are left: none that only removed documents held.
    left = {tuple(r)[1:] for r in line_keys(table(spark, rows[:60])).collect()}
    others = spark.createDataFrame([tuple(r)[1:] for r in line_keys(table(spark, rows[60:])).collect() if tuple(r)[1:] not in left], "k1 bigint, k2 bigint")
    assert index._seen(others, index.batches[-1]["shards"]).count() == 0


def test_lines_of_nothing(spark):
    index, out = deduplicated_lines(table(spark, []), work_folder(spark, "t"))
    assert out.count() == 0
    index.remove(spark.createDataFrame([(1,)], "doc_id bigint"))
    assert cleaned(index, table(spark, [(1, None)])) == [(1, 1, 0, "")]


def test_long_lines_and_texts(spark):
    rows = [(2, "x" * 3_000_000 + "\n" + "short\n" * 100_000), (1, "X" * 3_000_000)]
    index, _ = deduplicated_lines(table(spark, rows), work_folder(spark, "t"))
    assert cleaned(index, table(spark, rows)) == brute_lines(rows)


# -- collocations


def brute_phrases(rows, o):
    sizes, counts = Counter(), {}
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]+", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            sizes[lang] += len(w)
            for k in range(1, 5):
                counts.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p for p, n in f.items() if n >= o.least and len(p) > 1}
        longer = Counter()
        for p in candidates:
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], f[p])
        found = []
        for p in candidates:
            if 100 * longer[p] >= o.absorb * f[p]:
                continue
            cuts = [(int(Fraction(2_000_000 * f[p], f[p[:k]] + f[p[k:]])), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            found.append((-score, -f[p], " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[: o.top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def phrase_rows(seed, n=60):
    rng = random.Random(seed)
    words = ["a", "b", "c", "dd", "é", "Über", "x y", "end"]
    out = []
    for _ in range(n):
        text = ""
        for _ in range(rng.randint(0, 40)):
            text += " ".join(rng.choice([["a", "b", "c", "dd"], ["Über", "é"], [rng.choice(words)]])) + rng.choice([" ", " ", "\t ", ". ", "\n", "!?"])
        out.append((rng.choice(["en", "de", None, "und"]), text))
    return out


@pytest.mark.parametrize("o", [CollocationOptions(least=6), CollocationOptions(least=3, top=5, budget=16, held=50, bits=256, absorb=50)])
def test_collocations_equal_brute_force(spark, o):
    rows = phrase_rows(1) + [("en", None), ("fr", ""), ("en", "a"), ("en", " . "), ("en", "a a a a a a a a a a")]
    df = table(spark, [(i, t, lang) for i, (lang, t) in enumerate(rows)] + [(0, rows[0][1], rows[0][0])])
    got = sorted(map(tuple, collocations(df, o).collect()))
    assert got == brute_phrases(rows + rows[:1], o) and got


def test_collocations_start_anew_when_words_share_a_hash(spark, monkeypatch):
    from sitegrain.llm import collocations as module

    tried = []

    def ranked(docs, o, seed, scratch):
        tried.append(seed)
        return None if seed < 2 else docs

    monkeypatch.setattr(module, "_ranked", ranked)
    module.collocations(table(spark, []))
    assert tried == [0, 1, 2]


def test_collocations_of_nothing(spark):
    out = collocations(table(spark, []))
    assert out.count() == 0 and out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert collocations(table(spark, [(1, None, None), (2, "a b", "en")])).count() == 0


def test_long_text_of_one_phrase(spark):
    rows = [("en", "the same words " * 40_000)]
    assert sorted(map(tuple, collocations(table(spark, [(1, rows[0][1], "en")])).collect())) == brute_phrases(rows, CollocationOptions())


# -- conversations

STATES = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
LEGAL = re.compile("(s?(ua)+)?")


def every_repair(turns):
    """Cheapest edits by trying all of them."""
    best = (2 * len(turns), "D" * len(turns), ())

    def go(i, roles, cost, audit, kept):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(turns) and LEGAL.fullmatch("".join(r[0] for r, _ in kept)):
            best = min(best, (cost, audit, kept))
        for role in ("user", "assistant"):
            go(i, roles, cost + 5, audit + "I", (*kept, (role, "")))
        if i < len(turns):
            role, text, gone, broken = turns[i]
            go(i + 1, roles, cost + 2, audit + "D", kept)
            if not gone:
                go(i + 1, roles, cost + 5 * broken, audit + "K", (*kept, (role or "?", text)))
                for new in ("user", "assistant"):
                    go(i + 1, roles, cost + 5 * broken + 1, audit + "R", (*kept, (new, text)))

    go(0, "", 0, "", ())
    return best


def strings(turns):
    """Cheapest edits by the same program over plain strings."""
    def inserted(best):
        for _ in range(2):
            for state, (cost, audit) in list(best.items()):
                new = "a" if state == "u" else "u"
                offer(best, STATES[state, new], cost + 5, audit + "I")
        return best

    def offer(best, state, cost, audit):
        best[state] = min(best.get(state, (10**9, "")), (cost, audit))

    now = inserted({"": (0, "")})
    for role, _, gone, broken in turns:
        after = {}
        for state, (cost, audit) in now.items():
            offer(after, state, cost + 2, audit + "D")
            if not gone:
                if (state, role[:1]) in STATES:
                    offer(after, STATES[state, role[:1]], cost + 5 * broken, audit + "K")
                offer(after, STATES[state, "a" if state == "u" else "u"], cost + 5 * broken + 1, audit + "R")
        now = inserted(after)
    return min(now[s] for s in ("", "a") if s in now)


def read(rows):
    """(role, text, must go, breaks off) and the counts of faults of rows in order."""
    out, seen, faults = [], set(), Counter()
    for role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        blank, again = not solid, (role, text) in seen
        seen.add((role, text))
        broken = not blank and not again and solid[-1] not in ".!?"
        faults.update(blank=blank, duplicate=not blank and again, truncated=broken)
        out.append((role, text, blank or again, broken))
    faults["illegal"] = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(rows, rows[1:]))
    return out, faults


TURNS = "conv_id bigint, turn bigint, role string, text string, cost string, `a.b` int"


def conversations(seed, n=250, longest=5):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        turn = rng.choice([0, 0, 5])
        for _ in range(rng.randint(1, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""])
            rows.append((c, turn, role, rng.choice(["Yes.", "No!", "Why?", "well", " ", "", "Yes.\n", f"t{rng.random()}."])))
            turn += rng.choice([1, 1, 1, 2])
    return rows


def test_repairs_equal_a_trial_of_all(spark):
    rows = conversations(1)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)
    got = {r.conv_id: r for r in repairs(df).collect()}
    turns = {}
    for r in repaired_turns(df).orderBy("conv_id", "position").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    assert len(got) == 250
    for c, r in got.items():
        own = [(role, text) for i, _, role, text in rows if i == c]
        facts, faults = read(own)
        cost, audit, kept = every_repair(facts)
        numbers = [t for i, t, _, _ in rows if i == c]
        assert (r.cost, r.audit) == (cost, audit) == strings(facts)
        assert turns.get(c, []) == list(kept)
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in kept).encode()).hexdigest()
        assert (r.blank, r.duplicate, r.truncated, r.illegal) == tuple(faults[k] for k in ("blank", "duplicate", "truncated", "illegal"))
        assert r.gaps == max(numbers) - min(numbers) + 1 - len(set(numbers))


def test_long_conversations(spark):
    rows = [(1, t, role, text) for t, (_, _, role, text) in enumerate(conversations(7, 1500))] + conversations(8, 1, 40)
    got = {r.conv_id: r for r in repairs(spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)).collect()}
    for c, r in got.items():
        facts, _ = read([(role, text) for i, _, role, text in rows if i == c])
        assert (r.cost, r.audit) == strings(facts)


def test_program_frees_what_is_settled():
    rng = random.Random(5)
    program, settled = Program(), ""
    turns = [(rng.choice("suauax"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(5000)]
    for k, turn in enumerate(turns):
        program.read(*turn)
        if k % 100 == 99:
            settled += program.settled()
            assert max(node.depth for _, node in program.best.values()) < 100
    cost, node = program.final()
    assert (cost, settled + path(node)) == strings([(role, "", gone, broken) for role, gone, broken in turns])


def test_nodes_compare_like_strings_even_if_hashes_collide(monkeypatch):
    from sitegrain.llm import turns

    rng = random.Random(2)
    for modulus in (turns._MODULUS, 2):
        monkeypatch.setattr(turns, "_MODULUS", modulus)
        root, nodes = Node("", None), {}
        nodes[""] = root
        for _ in range(400):
            s = rng.choice(list(nodes)) + rng.choice("DIKR")
            nodes.setdefault(s, Node(s[-1], nodes[s[:-1]]))
        for _ in range(3000):
            a, b = rng.choice(list(nodes)), rng.choice(list(nodes))
            assert precedes(nodes[a], nodes[b]) == (a < b) and path(nodes[a]) == a


def test_odd_conversations(spark):
    rows = [
        (1, None, "user", "Hi."), (1, None, None, "What?"), (1, 3, "assistant", None), (2, None, None, None), (None, 1, "user", "A."),
        (None, 2, "assistant", "B."), (3, 1, "user", "A."), (3, 1, "user", "A."), (3, 1, "assistant", "A."),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)
    empty = df.limit(0)
    got = {r.conv_id: r for r in repairs(df, df.union(spark.createDataFrame([(4, 1, "user", "gone", "x", 1)], TURNS))).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    facts, _ = read([(" ", "What?"), ("user", "Hi."), ("assistant", " ")])
    assert (got[1].gaps, got[1].blank, (got[1].cost, got[1].audit)) == (0, 1, strings(facts))
    assert (got[2].gaps, got[2].blank, got[2].audit, got[2].cost) == (0, 1, "D", 2)
    assert (got[None].audit, got[None].cost, got[None].gaps) == ("KK", 0, 0)
    assert (got[3].duplicate, got[3].audit, got[3].gaps) == (1, strings(read([("assistant", "A."), ("user", "A."), ("user", "A.")])[0])[1], 0)
    assert tuple(got[4])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repairs(empty).count() == 0 and repaired_turns(empty).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(40) for t in range(10)] + [(None, None, None, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)
    want = Counter()
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        fault = zlib.crc32(key.encode()) % 20
        role, text = "user" if fault == 4 else role or " ", "" if fault == 1 else re.sub("[.!?]", "", text or " ") if fault == 2 else text or " "
        want[c, t, role, text] += {0: 0, 3: 2}.get(fault, 1)
    got = Counter(tuple(r)[:4] for r in damaged(df).collect())
    assert got == +want and damaged(df).columns == df.columns
