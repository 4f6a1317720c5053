"""Conversation repair: the search against all edits, round trips through tables, awkward rows."""

import hashlib
import itertools
import re
import time

import numpy as np

from graphloom.llm import conversations as C
from graphloom.llm.queries import damaged

SHAPE = "conv_id long, turn long, role string, text string, conv string, kind long, audit string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SHAPE)


def exhaustive(codes):
    """Least (cost, audit) over all edits with up to three inserts in each gap."""
    best = None
    grammar = re.compile(r"(s?(ua)+)?")
    for edits in itertools.product("KuaD", repeat=len(codes)):
        cost, base = 0, []
        for c, e in zip(codes, edits, strict=True):
            fault, role = divmod(c, 4)
            if e != "D" and fault in (C.BLANK, C.DUPLICATE):
                break
            cost += {"K": 0, "D": 4}.get(e, 3) + (3 if fault == C.CUT and e != "D" else 0)
            base.append((e if e in "KD" else "R", "" if e == "D" else "xsua"[role] if e == "K" else e))
        else:
            for gaps in itertools.product(("", "u", "a", "ua", "au"), repeat=len(codes) + 1):
                out, audit = "", ""
                for g, b in itertools.zip_longest(gaps, base):
                    out, audit = out + g, audit + "I" * len(g)
                    if b:
                        out, audit = out + b[1], audit + b[0]
                if grammar.fullmatch(out):
                    key = (cost + 3 * sum(map(len, gaps)), audit)
                    best = key if best is None or key < best else best
    return best


def test_search_finds_the_cheapest_and_least_edits():
    rng = np.random.default_rng(11)
    for n in (0, 1, 2, 3):
        for _ in range(6 if n == 3 else 25):
            codes = bytes(int(rng.choice([0, 0, 0, 1, 2, 3])) * 4 + int(rng.integers(0, 4)) for _ in range(n))
            assert C.cheapest(codes) == exhaustive(codes), codes


def layered(codes):
    """The same by a table of whole strings, row by row."""
    best = {0: (0, "")}

    def close(b):
        for _ in range(3):
            for s, (c, a) in list(b.items()):
                t = C.NEXT[s]
                if t not in b or (c + 3, a + "I") < b[t]:
                    b[t] = (c + 3, a + "I")
        return b

    best = close(best)
    for code in codes:
        fault, role = divmod(code, 4)
        new = {}
        for s, (c, a) in best.items():
            ways = [(4, "D", s)]
            if fault in (C.SOUND, C.CUT):
                more = 3 if fault == C.CUT else 0
                ways.append((3 + more, "R", C.NEXT[s]))
                if role == C.WANTS[s]:
                    ways.append((more, "K", C.NEXT[s]))
                elif role == C.SYSTEM and s == 0:
                    ways.append((more, "K", 1))
            for w, e, t in ways:
                if t not in new or (c + w, a + e) < new[t]:
                    new[t] = (c + w, a + e)
        best = close(new)
    return min(best[s] for s in C.ACCEPTS if s in best)


def test_search_on_long_conversations():
    rng = np.random.default_rng(4)
    for n in (10, 40, 300):
        for kinds in ((0, 1, 2, 3), (0, 3), (0,)):
            codes = bytes(int(rng.choice(kinds)) * 4 + int(rng.integers(0, 4)) for _ in range(n))
            assert C.cheapest(codes) == layered(codes)
    begun = time.time()
    cost, audit = C.cheapest(bytes(rng.integers(0, 4, 30000).tolist()))
    assert len(audit) >= 30000 and time.time() - begun < 60


def report(rows, ids):
    """All columns by plain Python."""
    out = {}
    for conv in ids:
        mine = sorted(((t is not None, t or 0), r, hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).digest(), x) for c, t, r, x in rows if c == conv)
        mine = [(t[1] if t[0] else None, r, x) for t, r, _, x in mine]
        seen, codes = set(), []
        for _, r, x in mine:
            body = x.strip(" \t\n\x0b\x0c\r")
            fault = C.BLANK if not body else C.DUPLICATE if (r, x) in seen else C.CUT if body[-1] not in ".!?" else C.SOUND
            seen.add((r, x))
            codes.append(4 * fault + "xsua".find(r[:1] if r[:1] in "sua" and r else "x"))
        cost, audit = layered(bytes(codes))
        said, state, at = [], 0, 0
        for e in audit:
            role, text = (None, "") if e == "I" else mine[at][1:]
            at += e != "I"
            if e == "D":
                continue
            if e == "K" and state == 0 and role[:1] == "s":
                said.append(f"{role}:{text}")
                state = 1
                continue
            said.append(f"{role if e == 'K' else C.NAMES[C.WANTS[state]]}:{text}")
            state = C.NEXT[state]
        turns = [t for t, _, _ in mine if t is not None]
        faults = [c // 4 for c in codes]
        illegal = sum((a % 4, b % 4) not in ((1, 2), (2, 3), (3, 2)) for a, b in zip(codes, codes[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def plain(rows):
    return [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]


def test_report_with_awkward_rows(spark):
    rng = np.random.default_rng(2)
    texts = ["Yes.", "no", "What?\n", " ", "", "Go! \t", "été…", "\U0001f600.", None, "Yes.", "a\x0b"]
    rows = [(int(rng.integers(0, 60)), int(rng.integers(0, 9)) if rng.random() > 0.1 else None, str(rng.choice(["user", "assistant", "system", "tool", "", "User"])), texts[int(rng.integers(0, len(texts)))]) for _ in range(500)]
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (70, None, None, None), (70, None, None, None), (71, -5, "user", "x" * 300000), (71, 10**12, "assistant", "y.")]
    want = report(plain(rows), {r[0] for r in rows} | {99})
    ids = frame(spark, [*rows, (99, 1, "user", "gone")])
    got = C.repair_report(frame(spark, rows), ids)
    assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == want


def test_damage_and_empty_tables(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Turn {t} of {c}. So?") for c in range(80) for t in range(6)]
    hurt = [tuple(r)[:4] for r in damaged(frame(spark, rows)).collect()]
    got = C.repair_report(damaged(frame(spark, rows)), frame(spark, rows)).collect()
    want = report(hurt, {r[0] for r in rows})
    assert {r.conv_id: tuple(r)[1:] for r in got} == want and sum(r.cost > 0 for r in got) > 20
    none = frame(spark, rows).limit(0)
    assert C.repair_report(none, none).count() == 0
    assert [tuple(r)[1:] for r in C.repair_report(none, frame(spark, [(5, 1, "user", "x")])).collect()] == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_a_conversation_of_a_third_of_all_rows(spark):
    rng = np.random.default_rng(8)
    hot = [(1, t, str(rng.choice(["user", "assistant"])), f"{rng.integers(0, 900)}.") for t in range(4000)]
    rows = hot + [(c, t, "user", "Hm") for c in range(2, 2000) for t in range(4)]
    got = C.find_edits(frame(spark, rows), "conv_id").where("conv = 1").first()
    assert got.audit.count("I") + 4000 == len(got.audit) and got.duplicate > 2000
